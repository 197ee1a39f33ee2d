"""Quality rules by compression bands.

Base figures of a text (words, symbols, repeated lines, words in repeated 3-word windows) come with
zstandard ratios, input bytes by compressed bytes, over the whole text and over its fixed chunks.
Repetitive text compresses too well for its length and noise too badly, so each length has a band of
its own (a text's first kilobyte has little to refer back to).

The bands are fitted on all texts: for each kind (whole texts, chunks) and each class of lengths (CLASSES to an octave),
the median ratio, and SPREADS times the robust spread below and above it. The fit is one pass that counts
ratios in steps, so it needs no sample and its size does not depend on the corpus. Classes of fewer than LEAST texts
take hand-set bands (BANDS).

A text is kept if the base rules hold, its own ratio is in the band of its length and at most MAX_BAD_CHUNKS of its chunks,
the last and shorter one among them, are out of those of theirs.

Null or empty text: no words, base_failed. An empty table gives none; its bands are the hand-set ones. Very long texts are
judged whole. Extra columns, ties and repeated rows: each row is judged alone. Columns that are kept must not have names of
SCHEMA.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from math import log2

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import unique_name

LEVEL, CHUNK_BYTES, MIN_WORDS, MAX_REPEAT_PERCENT, MAX_BAD_CHUNKS = 3, 1024, 50, 50, 0.5
#: Of the fit: classes to a doubling of length, texts of a class at least, robust spreads of a band; steps of a ratio, and the most.
CLASSES, LEAST, SPREADS, STEPS, MOST = 4, 100, 5.0, 200, 50
WHOLE, CHUNK = 0, 1
#: From so many bytes on: the least and the most ratio where there is nothing to fit.
BANDS = [
    (0, 0.0, 2.0),
    (128, 0.8, 2.2),
    (256, 1.0, 2.4),
    (512, 1.15, 2.5),
    (1024, 1.25, 2.6),
    (2048, 1.35, 2.8),
    (4096, 1.4, 2.9),
    (8192, 1.45, 3.0),
    (16384, 1.5, 3.2),
    (65536, 1.5, 3.6),
]
_STARTS = [b[0] for b in BANDS]
SCHEMA = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
    "kept boolean, ratio double, n_chunks long, n_bad_chunks long, ratio_failed boolean, chunks_failed boolean"
)
#: (kind, class) to least and most ratio.
Bands = dict[tuple[int, int], tuple[float, float]]


def length_class(n_bytes: int) -> int:
    return int(CLASSES * log2(n_bytes)) if n_bytes else -1


def in_band(n_bytes: int, ratio: float, kind: int = WHOLE, bands: Bands | None = None) -> bool:
    if bands and (own := bands.get((kind, length_class(n_bytes)))):
        low, high = own
    else:
        _, low, high = BANDS[bisect_right(_STARTS, n_bytes) - 1]
    return low <= ratio <= high


def ratios(raw: bytes, packer: zstandard.ZstdCompressor, chunk_bytes: int = CHUNK_BYTES) -> tuple[float, list[tuple[int, float]]]:
    """Of the whole text; length and ratio of each chunk."""
    if not raw:
        return 0.0, []
    whole = len(raw) / len(packer.compress(raw))
    if len(raw) <= chunk_bytes:
        return whole, [(len(raw), whole)]
    chunks = [raw[i : i + chunk_bytes] for i in range(0, len(raw), chunk_bytes)]
    return whole, [(len(x), len(x) / len(packer.compress(x))) for x in chunks]


def _measured(chunk_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=LEVEL)
        seen: Counter = Counter()
        step = lambda r: min(int(r * STEPS), MOST * STEPS)
        for batch in batches:
            for x in batch.column(0).to_pylist():
                if x:
                    whole, chunks = ratios(x, packer, chunk_bytes)
                    seen[WHOLE, length_class(len(x)), step(whole)] += 1
                    seen.update((CHUNK, length_class(n), step(r)) for n, r in chunks)
        keys = list(seen)
        columns = [pa.array([k[i] for k in keys], pa.int32()) for i in range(3)]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(list(seen.values()), pa.int64())], names=["kind", "class", "step", "n"])

    return run


def fit_bands(df: DataFrame, text: str = "text", chunk_bytes: int = CHUNK_BYTES) -> Bands:
    """Bands of all texts' ratios. What reaches the driver is a count for each kind, class and step: MOST * STEPS of each at most."""
    own = df.select(F.col(text).cast("binary").alias("raw")).mapInArrow(_measured(chunk_bytes), "kind int, class int, step int, n long")
    held: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for r in own.groupBy("kind", "class", "step").agg(F.sum("n").alias("n")).collect():
        held.setdefault((r["kind"], r["class"]), []).append((r["step"], r["n"]))
    bands: Bands = {}
    for name, counts in held.items():
        steps, n = (np.array(x) for x in zip(*sorted(counts)))
        if n.sum() >= LEAST:
            low, middle, high = steps[np.searchsorted(np.cumsum(n), np.array([0.25, 0.5, 0.75]) * n.sum())] + 0.5
            spread = lambda x: SPREADS * max(x, 1.0) / 0.6745  # noqa: E731  a quarter of a normal distribution lies within 0.6745
            bands[name] = (middle - spread(middle - low)) / STEPS, (middle + spread(high - middle)) / STEPS
    return bands


def repeated_words(words: list[bytes]) -> int:
    """Words in 3-word windows that the text has twice or more."""
    windows = list(zip(words, words[1:], words[2:]))
    first: dict[tuple, int] = {}
    twice = bytearray(len(windows))
    for i, w in enumerate(windows):
        j = first.setdefault(w, i)
        if j != i:
            twice[i] = twice[j] = 1
    if 1 not in twice:
        return 0
    total, end = 0, 0
    i = twice.find(1)
    while i >= 0:
        total += i + 3 - max(i, end)
        end = i + 3
        i = twice.find(1, i + 1)
    return total


def base_figures(raw: bytes) -> tuple[int, int, int, int, int]:
    words = raw.split()
    # A code point has one byte that is no continuation byte (0x80-0xBF).
    word_chars = sum(map(len, words)) - len(raw.translate(None, _NOT_CONTINUATION))
    symbols = len(raw) - len(raw.translate(None, b"#*$%&|<>"))
    lines = [x for x in raw.split(b"\n") if x.strip()] if b"\n" in raw else ()
    return len(words), word_chars, symbols, len(lines) - len(set(lines)), repeated_words(words)


_NOT_CONTINUATION = bytes(i for i in range(256) if not 0x80 <= i < 0xC0)


def judge(raw: bytes, packer: zstandard.ZstdCompressor, chunk_bytes: int = CHUNK_BYTES, bands: Bands | None = None) -> tuple:
    n_words, word_chars, symbols, dup_lines, repeats = base_figures(raw)
    base_failed = n_words < MIN_WORDS or 100 * repeats > MAX_REPEAT_PERCENT * n_words
    ratio, chunks = ratios(raw, packer, chunk_bytes)
    bad = sum(not in_band(n, r, CHUNK, bands) for n, r in chunks)
    ratio_failed, chunks_failed = not in_band(len(raw), ratio, WHOLE, bands), bad > MAX_BAD_CHUNKS * len(chunks)
    kept = not (base_failed or ratio_failed or chunks_failed)
    return n_words, word_chars, symbols, dup_lines, repeats, base_failed, kept, ratio, len(chunks), bad, ratio_failed, chunks_failed


def _judged(chunk_bytes: int, bands: Bands):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=LEVEL)
        for batch in batches:
            *others, text = batch.columns
            rows = [judge(x or b"", packer, chunk_bytes, bands) for x in text.to_pylist()]
            own = [pa.array(c) for c in zip(*rows)] if rows else [pa.array([], t) for t in _TYPES]
            own = [c.cast(t) for c, t in zip(own, _TYPES)]
            yield pa.RecordBatch.from_arrays(
                [*others, *own], names=[*batch.schema.names[:-1], *(x.split()[0] for x in SCHEMA.split(", "))]
            )

    return run


_TYPES = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()] + [pa.int64()] * 2 + [pa.bool_()] * 2


def quality_figures(df: DataFrame, keep: list[str], text: str = "text", chunk_bytes: int = CHUNK_BYTES, bands: Bands | None = None) -> DataFrame:
    """The columns keep of df and each text's figures (SCHEMA). bands: fitted on df if not given."""
    bands = fit_bands(df, text, chunk_bytes) if bands is None else bands
    own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keep).schema.fields)
    return df.select(*keep, F.col(text).cast("binary").alias(unique_name(df.select(*keep), "text"))).mapInArrow(
        _judged(chunk_bytes, bands), f"{own}, {SCHEMA}" if own else SCHEMA
    )


def keep_good(df: DataFrame, text: str = "text", chunk_bytes: int = CHUNK_BYTES, bands: Bands | None = None) -> DataFrame:
    """The rows of df, all columns, whose text is kept. bands: fitted on df if not given."""
    bands = fit_bands(df, text, chunk_bytes) if bands is None else bands

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=LEVEL)
        for batch in batches:
            raw = batch.column(text).cast(pa.binary()).to_pylist()
            yield batch.filter(pa.array([judge(x or b"", packer, chunk_bytes, bands)[6] for x in raw], pa.bool_()))

    return df.mapInArrow(run, df.schema)


def op9(spark, sf_dir):
    from .common import table

    return quality_figures(table(spark, sf_dir, "documents"), ["doc_id"])
