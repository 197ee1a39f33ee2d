"""Benchmark decontamination by Wu-Manber search over words.

Every 10 consecutive words of a benchmark item (the whole item if it has fewer) are a pattern. Patterns are
grouped by length, at most ten lengths. For each, a table gives the shift that a block of two
words (one, for patterns of one word) at the end of the search window allows: the least distance from the
block to the end of a pattern that holds it, or the most that is safe if none does. Where the shift is
zero, the patterns that end in this block are the bucket, and each is compared directly.

The benchmark is read in blocks of about BLOCK_BYTES of text, each sent to the executors once, where a worker
builds its tables once; they take some 50 bytes a byte of text. Long items are cut into parts with all their windows. The
documents run through one search per block without any shuffle, and their hits are gathered in their rows.

Null text or item: no words. Items with equal ids count once per id, ids compared as strings; items with
null ids are patterns too, under the empty id. Documents' repeated rows are judged one by one, and very long texts whole.
Empty tables: no rows, or no hits.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM, unique_name

WINDOW, BLOCK_BYTES = 10, 4 << 20


class Patterns:
    """Shift tables and buckets of one length. Patterns are places in the items' words, not copies of them."""

    def __init__(self, length: int):
        self.length, self.block = length, min(2, length)
        self.far = length - self.block + 1
        self.shift: dict[bytes, int] = {}
        self.bucket: dict[int, tuple | list] = {}  # by the hash of the words: (item, its words, end) or several of them

    def add(self, item: str, words: list[bytes]) -> None:
        n, shift = self.length, self.shift
        last = len(words) - n
        for end in range(self.block, len(words) + 1):
            key = words[end - 2] + b" " + words[end - 1] if self.block == 2 else words[end - 1]
            # The pattern that ends soonest from here on.
            far = max(0, n - end)
            if (was := shift.get(key)) is None or far < was:
                shift[key] = far
        for at in range(last + 1):
            place = (item, words, at + n)
            was = self.bucket.setdefault(hash(tuple(words[at : at + n])), place)
            if was is not place:
                if type(was) is tuple:
                    self.bucket[hash(tuple(words[at : at + n]))] = was = [was]
                was.append(place)

    def search(self, words: list[bytes], spans: list[tuple[int, int]], items: set[str]) -> None:
        n, last, block, far, shift, bucket = self.length, len(words), self.block, self.far, self.shift, self.bucket
        end = n
        while end <= last:
            key = words[end - 2] + b" " + words[end - 1] if block == 2 else words[end - 1]
            step = shift.get(key, far)
            if step:
                end += step
                continue
            own = words[end - n : end]
            if held := bucket.get(hash(tuple(own))):
                same = [item for item, of, stop in ([held] if type(held) is tuple else held) if of[stop - n : stop] == own]
                if same:
                    spans.append((end - n, end))
                    items.update(same)
            end += 1


def patterns(rows: list[tuple], window: int = WINDOW) -> list[Patterns]:
    by: dict[int, Patterns] = {}
    known: dict[bytes, bytes] = {}  # equal words are one object
    for item, raw in rows:
        words = [known.setdefault(w, w) for w in bytes(raw or b"").translate(ALNUM).split()]
        if n := min(window, len(words)):
            by.setdefault(n, Patterns(n)).add("" if item is None else str(item), words)
    return list(by.values())


_TABLES: dict[str, list[Patterns]] = {}  # the last block's, kept from task to task of a worker


def _tables(sent, window: int) -> list[Patterns]:
    """sent: a broadcast block of the benchmark with a name, or None."""
    if sent is None:
        return []
    name, rows = sent.value
    if name not in _TABLES:
        _TABLES.clear()
        _TABLES[name] = patterns(rows, window)
    return _TABLES[name]


def covered(spans: list[tuple[int, int]]) -> int:
    total, end = 0, 0
    for a, b in sorted(spans):
        total += max(0, b - max(a, end))
        end = max(end, b)
    return total


def _search(sent, window: int, first: bool, text: str, found: tuple[str, str, str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = _tables(sent, window)
        n_words, spans_, items_ = found
        for batch in batches:
            raw = batch.column(text).cast(pa.binary()).to_pylist()
            n = len(raw)
            old = [[()] * n, [()] * n] if first else [batch.column(spans_).to_pylist(), batch.column(items_).to_pylist()]
            counts, all_spans, all_items = [], [], []
            for x, was, items in zip(raw, *old):
                words = (x or b"").translate(ALNUM).split()
                spans, items = list(zip(was[::2], was[1::2])), set(items)
                for t in tables:
                    t.search(words, spans, items)
                counts.append(len(words))
                all_spans.append([v for s in spans for v in s])
                all_items.append(sorted(items))
            keep = [c for c in batch.schema.names if c not in found]
            own = pa.array(counts, pa.int64()), pa.array(all_spans, pa.list_(pa.int32())), pa.array(all_items, pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *own], names=[*keep, *found])

    return run


def _pieces(window: int, most: int):
    """Long items in parts that have all their windows between them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, raw in zip(*(c.to_pylist() for c in batch.columns)):
                if raw is None:
                    continue
                parts = [raw]
                if len(raw) > most:
                    words = raw.translate(ALNUM).split()
                    step = max(window, most // 16)
                    parts = [b" ".join(words[i : i + step + window - 1]) for i in range(0, max(1, len(words) - window + 1), step)]
                yield pa.RecordBatch.from_arrays([pa.array([item] * len(parts), pa.string()), pa.array(parts, pa.binary())], names=["item", "raw"])

    return run


def _blocks(benchmark: DataFrame, item: str, text: str, block_bytes: int, window: int) -> Iterator[tuple[str, list]]:
    """The benchmark's items in blocks of about block_bytes, each with a name."""
    b = benchmark.select(F.col(item).cast("string").alias("item"), F.col(text).cast("binary").alias("raw"))
    b = b.mapInArrow(_pieces(window, block_bytes), "item string, raw binary")
    n = 1 + (b.agg(F.sum(F.octet_length("raw") + 64)).first()[0] or 0) // block_bytes
    part = F.pmod(F.xxhash64("item", "raw"), F.lit(n))
    for i in range(n):
        yield uuid.uuid4().hex, [(r.item, bytes(r.raw)) for r in (b.filter(part == i) if n > 1 else b).collect()]


def contamination(
    docs: DataFrame, benchmark: DataFrame, item: str = "item_id", text: str = "text", bench_text: str = "text",
    window: int = WINDOW, block_bytes: int = BLOCK_BYTES, names: tuple[str, str, str] = ("n_words", "spans", "items"),
) -> DataFrame:
    """docs and, for each, its number of words, the hit windows as start, end, start, end ... and the items found.

    names: of the three columns, lengthened where docs has such a column.
    """
    out = docs
    found = tuple(unique_name(docs, x) for x in names)
    own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    for i, block in enumerate(_blocks(benchmark, item, bench_text, block_bytes, window)):
        sent = docs.sparkSession.sparkContext.broadcast(block)
        out = out.mapInArrow(_search(sent, window, i == 0, text, found), f"{own}, `{found[0]}` long, `{found[1]}` array<int>, `{found[2]}` array<string>")
    return out


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of docs, all columns, that hold no window of the benchmark."""
    found = contamination(docs, benchmark, **options)
    return found.filter(F.size(found.columns[-2]) == 0).select(*docs.columns)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        spans, items = batch.column("spans").to_pylist(), batch.column("items").to_pylist()
        hit = [covered(list(zip(s[::2], s[1::2]))) for s in spans]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"), batch.column("n_words"), pa.array(hit, pa.int64()),
                pa.array([len(x) for x in items], pa.int64()),
                pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in items], pa.string()),
                pa.array([h > 0 for h in hit], pa.bool_()),
            ],
            names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
        )


def op3(spark, sf_dir):
    from .common import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = contamination(docs, table(spark, sf_dir, "benchmark")).drop("text")
    return found.mapInArrow(
        _digest, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
    )


OP3_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
p AS (SELECT DISTINCT item, len AS n, array_to_string(w[i:i + len - 1], ' ') AS pat FROM (SELECT item, w, least(10, len(w)) AS len, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
k AS (SELECT DISTINCT n FROM p),
h AS (SELECT DISTINCT doc_id, i, n, item FROM (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS pat FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, k WHERE len(w) >= n)) JOIN p USING (n, pat)),
c AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS pos FROM h) GROUP BY doc_id),
m AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM h GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN m USING (doc_id)
"""
