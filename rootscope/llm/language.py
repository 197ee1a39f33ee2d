"""Language identification by Viterbi over per-word scores, candidates narrowed by script.

Model: for each language, log frequencies of letter trigrams (each letter with its neighbours, none at a
word's edge), hashed to BUCKETS values, and the scripts that hold at least SCRIPT_SHARE of its letters.
A word's score under a language is the sum over its letters; languages that do not use the word's script
are out unless none does. The label sequence that scores best, each change of language costing SWITCH,
is the Viterbi path; its runs are the spans of a mixed text, and the language that holds most
letters is the document's. score is that language's share of the letters.

If one language's total leads, no stretch of words gains SWITCH under any other, nor do the best first and
last stretches together, then no path with a change can score better: each stretch pays for a change of
its own, but for one at an end. The path is constant then, an exact shortcut.

Marks without a letter are no word. Very long texts are scored in parts of PIECE characters, cut between words, and decided
as one. Repeated rows are judged one by one, an empty table gives none; extra columns go along if they are kept.

Fitting uses a sample of at most about PER_LANGUAGE labelled texts of each language, chosen by a hash of the
whole row id; everything else covers whole texts of all rows. Null or letterless text: `und`, score 0, no spans.
Without any labelled text every prediction is `und`. Ties go to the language first in order.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import unique_name

BUCKETS, SMOOTH, SWITCH, SCRIPT_SHARE, PER_LANGUAGE = 1 << 16, 0.5, 12.0, 0.01, 1500
OUT_OF_SCRIPT, PIECE = 60.0, 1 << 18
#: First and last code point of each block, by script.
SCRIPTS = {
    "latin": [(0x41, 0x24F), (0x1E00, 0x1EFF)], "greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "cyrillic": [(0x400, 0x52F)], "armenian": [(0x530, 0x58F)], "hebrew": [(0x590, 0x5FF)],
    "arabic": [(0x600, 0x6FF), (0x750, 0x77F)], "devanagari": [(0x900, 0x97F)], "bengali": [(0x980, 0x9FF)],
    "gurmukhi": [(0xA00, 0xA7F)], "gujarati": [(0xA80, 0xAFF)], "tamil": [(0xB80, 0xBFF)], "telugu": [(0xC00, 0xC7F)],
    "kannada": [(0xC80, 0xCFF)], "malayalam": [(0xD00, 0xD7F)], "thai": [(0xE00, 0xE7F)], "georgian": [(0x10A0, 0x10FF)],
    "hangul": [(0x1100, 0x11FF), (0xAC00, 0xD7AF)], "kana": [(0x3040, 0x30FF)],
    "han": [(0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0x20000, 0x2FA1F)],
}


@cache
def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each code point: its lower case if it belongs to words, else 0; whether it is a letter; its script."""
    low = np.zeros(sys.maxunicode + 1, np.uint32)
    letter = np.zeros(sys.maxunicode + 1, bool)
    for i in range(sys.maxunicode + 1):
        c = chr(i)
        if c.isalpha():
            letter[i] = True
            x = c.lower()
            low[i] = ord(x) if len(x) == 1 else i
        elif unicodedata.category(c)[0] == "M":
            low[i] = i
    script = np.zeros(sys.maxunicode + 1, np.uint8)
    for k, blocks in enumerate(SCRIPTS.values(), 1):
        for a, b in blocks:
            script[a : b + 1] = k
    return low, letter, script


def pieces(text: str, most: int = PIECE) -> Iterator[str]:
    """text in parts of about most characters, cut between words where that is possible."""
    at = 0
    while len(text) - at > most:
        end = next((i for i in range(at + most, at + most // 2, -1) if unicodedata.category(text[i])[0] not in "LM"), at + most)
        yield text[at:end]
        at = end
    yield text[at:] if at else text


def grams(text: str):
    """Of each letter in words: its trigram's bucket and its code point; where each word begins among them, and in text."""
    low, letter, _ = tables()
    cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    x = np.zeros(len(cp) + 2, np.uint32)
    x[1:-1] = low[cp]
    at = np.flatnonzero(x[1:-1])
    starts = np.flatnonzero(x[at] == 0)
    if len(at):
        spelt = np.logical_or.reduceat(letter[cp[at]], starts)
        if not spelt.all():  # marks without any letter are no word
            on = np.repeat(spelt, np.diff(starts, append=len(at)))
            x[1 + at[~on]] = 0
            at = at[on]
    h = x[at] * np.uint32(0x9E3779B1) + x[at + 1] * np.uint32(0x85EBCA77) + x[at + 2] * np.uint32(0xC2B2AE3D)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    starts = np.flatnonzero(x[at] == 0)
    return h >> np.uint32(16), cp[at], starts, at[starts] if len(at) else at


class Model:
    def __init__(self, langs: list[str], counts: np.ndarray, scripts: np.ndarray):
        """counts: by language and bucket; scripts: letters by language and script."""
        self.langs = langs
        total = counts.sum(1, keepdims=True)
        self.logs = np.ascontiguousarray(np.log((counts + SMOOTH) / (total + SMOOTH * BUCKETS)).T.astype(np.float32))
        used = scripts >= SCRIPT_SHARE * np.maximum(1, scripts.sum(1, keepdims=True))
        self.out = np.where(used | ~used.any(0), 0, -OUT_OF_SCRIPT).T.astype(np.float32)

    def words(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scores by word and language, letters of each word, and where each begins in text."""
        _, _, script = tables()
        h, cp, starts, where = grams(text)
        if not len(starts):
            return np.zeros((0, len(self.langs)), np.float32), starts, where
        scores = np.add.reduceat(self.logs[h], starts, axis=0) + self.out[script[cp[starts]]]
        return scores, np.diff(starts, append=len(h)), where

    def path(self, s: np.ndarray, switch: float = SWITCH) -> np.ndarray:
        """The best label of each word."""
        k = int(s.sum(0, dtype=np.float64).argmax())
        run = np.cumsum(s - s[:, k : k + 1], axis=0, dtype=np.float64)
        low = np.minimum(0, np.minimum.accumulate(run, axis=0))
        ends = run.max() + (run[-1] - low).max()
        if (run[1:] - low[:-1]).max(initial=run[0].max()) < switch and ends < switch:
            return np.full(len(s), k)
        return viterbi(s, switch)

    def label(self, text: str | None, switch: float = SWITCH) -> tuple[str, float, list[dict]]:
        if not text or not self.langs:
            return "und", 0.0, []
        parts, at = [], 0
        for p in pieces(text):
            s, n, where = self.words(p)
            parts.append((s, n, where + at))
            at += len(p)
        s, n, where = (np.concatenate(x) for x in zip(*parts)) if len(parts) > 1 else parts[0]
        return self.decide(s, n, where, switch)

    def decide(self, s, n, where, switch: float = SWITCH) -> tuple[str, float, list[dict]]:
        if not len(s):
            return "und", 0.0, []
        path = self.path(s, switch)
        share = np.bincount(path, n, len(self.langs))
        best = int(share.argmax())
        cut = np.flatnonzero(np.diff(path, prepend=-1))
        ends = [*where[cut[1:]].tolist(), int(where[-1] + n[-1])]
        spans = [{"start": a, "end": b, "lang": self.langs[path[c]]} for a, b, c in zip(where[cut].tolist(), ends, cut)]
        return self.langs[best], float(share[best] / share.sum()), spans


def viterbi(s: np.ndarray, switch: float) -> np.ndarray:
    rows = s.tolist()
    best = rows[0]
    seen = [best]
    for row in rows[1:]:
        low = max(best) - switch
        best = [(b if b >= low else low) + x for b, x in zip(best, row)]
        seen.append(best)
    k = best.index(max(best))
    out = np.empty(len(rows), np.int64)
    for i in range(len(rows) - 1, -1, -1):
        out[i] = k
        if i and seen[i - 1][k] < max(seen[i - 1]) - switch:
            k = seen[i - 1].index(max(seen[i - 1]))
    return out


def _counted(langs: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((len(langs), BUCKETS), np.int64)
        scripts = np.zeros((len(langs), len(SCRIPTS) + 1), np.int64)
        _, _, script = tables()
        where = {x: i for i, x in enumerate(langs)}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for p in pieces(text):
                    h, cp, _, _ = grams(p)
                    counts[where[lang]] += np.bincount(h, minlength=BUCKETS)
                    scripts[where[lang]] += np.bincount(script[cp], minlength=scripts.shape[1])
        for kind, c in ((0, counts), (1, scripts)):
            lang, bucket = np.nonzero(c)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(lang), kind), pa.int32()), pa.array(lang, pa.int32()), pa.array(bucket, pa.int32()), pa.array(c[lang, bucket], pa.int64())],
                names=["kind", "lang", "bucket", "n"],
            )

    return run


def fit(labelled: DataFrame, row_id: str, text: str = "text", lang: str = "lang", per_language: int = PER_LANGUAGE) -> Model:
    """labelled: rows to learn from. Rows with null text or lang teach nothing."""
    known = labelled.filter(F.col(lang).isNotNull() & F.col(text).isNotNull())
    sizes = {r[0]: r[1] for r in known.groupBy(lang).count().collect()}
    langs = sorted(sizes)
    if not langs:
        return Model([], np.zeros((0, BUCKETS)), np.zeros((0, len(SCRIPTS) + 1)))
    limit = F.create_map(*(F.lit(v) for x in langs for v in (x, int(min(1, per_language / sizes[x]) * (1 << 30)))))
    sample = known.filter(F.pmod(F.xxhash64(F.col(row_id).cast("string")), F.lit(1 << 30)) < limit[F.col(lang)])
    rows = (
        sample.select(lang, text)
        .mapInArrow(_counted(langs), "kind int, lang int, bucket int, n long")
        .groupBy("kind", "lang", "bucket")
        .agg(F.sum("n").alias("n"))
        .toPandas()  # at most BUCKETS rows a language
    )
    counts, scripts = np.zeros((len(langs), BUCKETS)), np.zeros((len(langs), len(SCRIPTS) + 1))
    for kind, into in ((0, counts), (1, scripts)):
        r = rows[rows["kind"] == kind]
        into[r["lang"], r["bucket"]] = r["n"]
    return Model(langs, counts, scripts)


def _labels(model, switch: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in batches:
            *others, text = batch.columns
            rows = list(labelled_batch(m, text.to_pylist(), switch))
            own = [pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 3, _TYPES)]
            yield pa.RecordBatch.from_arrays([*others, *own], names=[*batch.schema.names[:-1], "lang_pred", "score", "spans"])

    return run


def labelled_batch(m: Model, texts: list[str | None], switch: float) -> Iterator[tuple]:
    """As label() for each text; short texts are scored many at a time."""
    held: list[str] = []
    size = 0

    def flush():
        joined = "\n".join(held)
        s, n, where = m.words(joined)
        at = np.cumsum([0, *(len(x) + 1 for x in held)])
        cut = np.searchsorted(where, at)
        for i in range(len(held)):
            a, b = cut[i], cut[i + 1]
            yield m.decide(s[a:b], n[a:b], where[a:b] - at[i], switch)
        held.clear()

    for t in texts:
        if not m.langs or (t and len(t) > PIECE):
            yield from flush()
            size = 0
            yield m.label(t, switch)
            continue
        held.append(t or "")
        size += len(held[-1])
        if size > PIECE:
            yield from flush()
            size = 0
    yield from flush()


_SPAN = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))
_TYPES = [pa.string(), pa.float64(), _SPAN]
SCHEMA = "lang_pred string, score double, spans array<struct<start:long,end:long,lang:string>>"


def identify(df: DataFrame, model: Model, keep: list[str], text: str = "text", switch: float = SWITCH) -> DataFrame:
    """The columns keep of df and each text's language, score and spans (in code points)."""
    own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keep).schema.fields)
    sent = df.sparkSession.sparkContext.broadcast(model)  # BUCKETS floats a language
    return df.select(*keep, F.col(text).alias(unique_name(df.select(*keep), "text"))).mapInArrow(_labels(sent, switch), f"{own}, {SCHEMA}")


def op1(spark, sf_dir):
    from .common import table

    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False)).alias("held_out")
    docs = docs.select("doc_id", held_out, "text", "lang")
    model = fit(docs.filter(~F.col("held_out") & F.col("doc_id").isNotNull()), "doc_id")
    out = identify(docs, model, ["doc_id", "held_out"])
    return out.select("doc_id", "held_out", "lang_pred", "score", F.size("spans").cast("long").alias("n_spans"))
