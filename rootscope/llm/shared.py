"""Exact search for strings that several documents share, by content-defined units.

A plan cuts each document into units, each with a 64-bit key that depends on its content alone, so that
equal strings lie in units of equal keys (for windows: the least hash of the grams in a window is the
window's key, and a unit is a run of windows with one key). The search has three steps.

1. Keys. A task finds which keys several of its own documents have; of every key one document at most goes
   on to the key's bucket, with the number of its documents, so a key that a third of all documents have
   costs a bucket one entry per task. Buckets hold sorted 48-bit keys, counts and document ids as packed arrays.
   A run that later batches meet also has the key's other documents, as their windows may differ.
2. Units. Documents meet the lists of their shared keys. A task compares the contents of its units: a
   content's later holders are marked in full at once, and its first holder goes on, with the content, to the
   bucket of its key. A key of more than HOT documents (by the counts of step 1) is split: its units are
   cut into single windows, each with a key of its own, so no bucket gets all contents of such a key.
3. Contents. In a bucket, equal contents keep their first holder. Where a key has several contents, the
   plan's resolver finds the windows of one that occur in another of an earlier document.

What goes from step to step is packed in rows of arrays, one per task and bucket; marks go to buckets of
documents, where each document's spans are joined. All comparisons are of bytes; hashes only bring candidates
together. Documents are joined by sort and merge at any size, so that a small input takes the same way as a large one.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shuffle_partitions, stored, unique_name

#: Units of a task's keys that are compared at once; units of its contents; bytes for a resolver; bytes of text.
KEYS_AT_ONCE, UNITS_AT_ONCE, RESOLVE_BYTES, CHUNK = 1 << 20, 150_000, 1 << 21, 1 << 20
#: Documents of a key that is split; such keys are HOT_KEYS at most, as a key must also have that share of all units.
HOT, HOT_KEYS = 50_000, 1 << 21
PARTS_PER_TASK = 8
KEYS, LOCAL, RUN, MORE, FREQUENT, TOTAL = 0, 1, 2, 3, 4, 5
MARK, UNIT = 0, 1
KEY_SCHEMA = "kind int, bucket int, doc_id long, keys binary"
UNIT_SCHEMA = "kind int, bucket int, held binary"


class Units:
    """Of some documents: which document each unit is in, its start and end there, its key."""

    def __init__(self, doc, start, end, key, content):
        self.doc, self.start, self.end, self.key, self.content = doc, start, end, key, content


def least_runs(h: np.ndarray, off: np.ndarray, n: np.ndarray, window: int, gram: int):
    """Units of `window` items from gram hashes h. off, n: first item and number of items of each document."""
    width = window - gram + 1
    if len(h) < width:
        z = np.zeros(0, np.int64)
        return z, z, z, z.astype(np.uint64)
    m, span = h, 1
    while span * 2 <= width:
        m = np.minimum(m[: len(m) - span], m[span:])
        span *= 2
    if span < width:
        m = np.minimum(m[: len(m) - (width - span)], m[width - span :])
    many = np.maximum(0, n - window + 1)
    has = many > 0
    first, stop = off[has], off[has] + many[has]
    if not len(first):
        return least_runs(h[:0], off, n, window, gram)
    size = len(m) + 2
    edge = np.zeros(size, np.int8)
    np.add.at(edge, first, 1)
    np.add.at(edge, stop, -1)
    valid = np.cumsum(edge[: len(m)]).astype(bool)
    begins = np.empty(len(m), bool)
    begins[0] = True
    np.not_equal(m[1:], m[:-1], out=begins[1:])
    begins[first] = True
    begins &= valid
    starts = np.flatnonzero(begins)
    nxt = np.append(starts[1:], len(m))
    doc_of = np.searchsorted(first, starts, "right") - 1
    ends = np.minimum(nxt, stop[doc_of])
    docs = np.flatnonzero(has)[doc_of]
    return docs, starts, ends - 1 + window, m[starts]


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(29))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def bucket_of(key: np.ndarray, buckets: int) -> np.ndarray:
    return ((key >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def short(key: np.ndarray, buckets: int) -> np.ndarray:
    """The 48 or so bits of a key by which buckets compare: the bucket and the low 40 bits."""
    return (bucket_of(key, buckets).astype(np.uint64) << np.uint64(40)) | (key & np.uint64((1 << 40) - 1))


def _five(a: np.ndarray) -> bytes:
    return np.ascontiguousarray(a.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()


def _from_five(b: bytes) -> np.ndarray:
    out = np.zeros((len(b) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(b, np.uint8).reshape(-1, 5)
    return out.view("<u8").ravel()


def encode(low: np.ndarray, many: np.ndarray, docs: np.ndarray) -> bytes:
    """Sorted low key bits, how many documents have each, and a document."""
    base = int(docs.min()) if len(docs) else 0
    rest = (docs - base).astype("<u8")
    wide = 8 if len(rest) and int(rest.max()) >> 32 else 4
    packed = zstandard.ZstdCompressor(level=1).compress(rest.astype(f"<u{wide}").tobytes() + many.astype("<u4").tobytes())
    return np.array([len(low), base, wide], "<i8").tobytes() + _five(low) + packed


def decode(b: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n, base, wide = (int(x) for x in np.frombuffer(b[:24], "<i8"))
    rest = zstandard.ZstdDecompressor().decompress(b[24 + 5 * n :])
    docs = np.frombuffer(rest[: wide * n], f"<u{wide}").astype(np.int64) + base
    return _from_five(b[24 : 24 + 5 * n]), np.frombuffer(rest[wide * n :], "<u4").astype(np.int64), docs


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    fields = [x.split() for x in schema.split(", ")]
    columns = zip(*rows) if rows else [[]] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, (_, t) in zip(columns, fields)], names=[f[0] for f in fields])


def packed(docs: DataFrame, text: str = "text", th=None) -> DataFrame:
    """doc_id, a hash of the text, and the text's bytes compressed (null if it is null)."""
    th = F.xxhash64(text) if th is None else th

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor(level=3)
        for b in batches:
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([None if x is None else z.compress(x) for x in b.column(2).to_pylist()], pa.binary())],
                names=["doc_id", "th", "z"],
            )

    kind = docs.select(th.alias("th")).dtypes[0][1]
    return docs.select("doc_id", th.alias("th"), F.col(text).cast("binary").alias("z")).mapInArrow(run, f"doc_id long, th {kind}, z binary")


def chunks(batches: Iterator[pa.RecordBatch], text: str, *columns: str) -> Iterator[tuple[list[bytes], list]]:
    """Texts of about CHUNK bytes together, and the other columns' values."""
    unpack = zstandard.ZstdDecompressor().decompress if text == "z" else bytes
    raw, others, size = [], [[] for _ in columns], 0
    for b in batches:
        values = [b.column(c).to_pylist() for c in columns]
        for i, x in enumerate(b.column(text).to_pylist()):
            x = unpack(x)
            raw.append(x)
            size += len(x)
            for o, v in zip(others, values):
                o.append(v[i])
            if size > CHUNK:
                yield raw, others
                raw, others, size = [], [[] for _ in columns], 0
    if raw:
        yield raw, others


def _keys(plan, buckets: int, column: str, keep_run: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, docs, held = [], [], 0
        for raw, (ids,) in chunks(batches, column, "doc_id"):
            u = plan.units(raw)
            keys.append(u.key)
            docs.append(np.array(ids, np.int64)[u.doc])
            held += len(u.key)
            if held > KEYS_AT_ONCE:
                yield _batch(sent(keys, docs), KEY_SCHEMA)
                keys, docs, held = [], [], 0
        if held:
            yield _batch(sent(keys, docs), KEY_SCHEMA)

    def sent(keys, docs) -> list[tuple]:
        key, doc = np.concatenate(keys), np.concatenate(docs)
        bucket, low = bucket_of(key, buckets), key & np.uint64((1 << 40) - 1)
        order = np.lexsort((doc, low, bucket))
        bucket, low, doc = bucket[order], low[order], doc[order]
        new = np.ones(len(low), bool)
        new[1:] = (low[1:] != low[:-1]) | (bucket[1:] != bucket[:-1])
        if not plan.same_doc:
            once = new.copy()
            once[1:] |= doc[1:] != doc[:-1]
            bucket, low, doc, new = bucket[once], low[once], doc[once], new[once]
        first = np.flatnonzero(new)
        n = np.diff(first, append=len(low))
        local = np.repeat(n > 1, n)
        rows = by_document(doc[local], (bucket[local].astype(np.uint64) << np.uint64(40)) | low[local], buckets)
        rows += by_bucket(KEYS, bucket[first], low[first], n, doc[first])
        if keep_run:
            rows += by_bucket(MORE, bucket[~new], low[~new], np.zeros(int((~new).sum()), np.int64), doc[~new])
        return rows

    return run


def by_bucket(kind: int, bucket: np.ndarray, low: np.ndarray, many: np.ndarray, doc: np.ndarray) -> list[tuple]:
    """Sorted keys with documents, packed by bucket, in rows of limited size."""
    if not len(bucket):
        return []
    cut = np.flatnonzero(np.diff(bucket)) + 1
    cut = sorted({0, *cut.tolist(), *range(0, len(bucket), KEYS_AT_ONCE), len(bucket)})
    return [(kind, int(bucket[i]), None, encode(low[i:j], many[i:j], doc[i:j])) for i, j in zip(cut, cut[1:])]


def home_of(doc: np.ndarray, buckets: int) -> np.ndarray:
    return (((doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)


def by_document(doc: np.ndarray, key: np.ndarray, buckets: int) -> list[tuple]:
    """Documents with keys, packed by bucket of documents."""
    if not len(doc):
        return []
    home = home_of(doc, buckets)
    order = np.lexsort((key, doc, home))
    home, doc, key = home[order], doc[order], key[order].astype("<u8")
    cut = [0, *(np.flatnonzero(np.diff(home)) + 1).tolist(), len(doc)]
    pack = zstandard.ZstdCompressor(level=1).compress
    return [(LOCAL, int(home[i]), None, pack(doc[i:j].astype("<i8").tobytes() + key[i:j].tobytes())) for i, j in zip(cut, cut[1:])]


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    unpack = zstandard.ZstdDecompressor().decompress
    docs, keys = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for b in batches:
        for x in map(unpack, b.column(0).to_pylist()):
            docs.append(np.frombuffer(x[: len(x) // 2], "<i8"))
            keys.append(np.frombuffer(x[len(x) // 2 :], "<u8"))
    doc, key = np.concatenate(docs), np.concatenate(keys)
    order = np.lexsort((key, doc))
    doc, key = doc[order], key[order].astype("<u8")
    cut = [0, *(np.flatnonzero(np.diff(doc)) + 1).tolist(), len(doc)] if len(doc) else [0]
    held = [[key[i:j].tobytes()] for i, j in zip(cut, cut[1:])]
    yield pa.RecordBatch.from_arrays([pa.array(doc[cut[:-1]]), pa.array(held, pa.list_(pa.binary()))], names=["doc_id", "keys"])


def _met(buckets: int, keep_run: bool, hot: int):
    """Merge-join a batch's sorted keys of each bucket with one another and with those of earlier runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        new: dict[int, list[bytes]] = {}
        old: dict[int, list[bytes]] = {}
        for b in batches:
            rest = []
            for kind, bucket, doc, keys in zip(*(c.to_pylist() for c in b.columns)):
                if kind in (LOCAL, MORE):  # MORE is for later batches alone: LOCAL has these documents in this one
                    rest.append((RUN if kind == MORE else LOCAL, bucket, doc, keys))
                else:
                    (new if kind == KEYS else old).setdefault(bucket, []).append(keys)
            if rest:
                yield _batch(rest, KEY_SCHEMA)
        found_docs, found_keys, size, total = [], [], 0, 0
        frequent: list[tuple] = []
        for bucket in sorted(new.keys() | old.keys()):
            top = np.uint64(bucket) << np.uint64(40)
            low, many, doc = (np.concatenate(x) for x in zip(*map(decode, new.pop(bucket, []) or [encode(*_NOTHING)])))
            order = np.lexsort((doc, low))
            low, many, doc = low[order], many[order], doc[order]
            hit = _repeated(low, doc)
            was = [decode(r) for r in old.pop(bucket, [])]
            for k, _, d in was:  # each a sorted, immutable run
                at = np.searchsorted(k, low)
                at[at == len(k)] = 0
                hit |= k[at] == low if len(k) else False
                mine = np.isin(k, low)
                found_docs.append(d[mine])
                found_keys.append(top | k[mine])
            found_docs.append(doc[hit])
            found_keys.append(top | low[hit])
            size += sum(map(len, found_docs[-1 - len(was) :]))
            if keep_run and len(low):
                yield _batch([(RUN, bucket, None, encode(low, many, doc))], KEY_SCHEMA)
            counts = [(low, many), *((k[m := np.isin(k, low)], n[m]) for k, n, _ in was)]
            every, n = (np.concatenate(x) for x in zip(*counts))
            total += int(n.sum())
            order = np.argsort(every)
            first = np.flatnonzero(np.diff(every[order], prepend=every[order][:1] + np.uint64(1)))
            n = np.add.reduceat(n[order], first) if len(first) else n[:0]
            for i in np.flatnonzero(n > hot).tolist():
                frequent.append((FREQUENT, bucket, int(n[i]), int(top | every[order][first[i]]).to_bytes(8, "little")))
            if size > KEYS_AT_ONCE:
                yield _batch(by_document(np.concatenate(found_docs), np.concatenate(found_keys), buckets), KEY_SCHEMA)
                found_docs, found_keys, size = [], [], 0
        if found_docs:
            yield _batch(by_document(np.concatenate(found_docs), np.concatenate(found_keys), buckets), KEY_SCHEMA)
        yield _batch([*frequent, (TOTAL, 0, total, b"")], KEY_SCHEMA)

    return run


_NOTHING = (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))


def _repeated(low: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Entries whose key another entry has."""
    same = low[1:] == low[:-1]
    hit = np.zeros(len(low), bool)
    hit[1:] |= same
    hit[:-1] |= same
    return hit


def n_buckets(spark) -> int:
    return PARTS_PER_TASK * shuffle_partitions(spark)


def shared_keys(
    docs: DataFrame, plan, buckets: int, column: str, earlier: DataFrame | None = None, keep_run: bool = False, hot: int = HOT
) -> DataFrame:
    """KEY_SCHEMA: LOCAL rows with a document's shared keys, RUN rows, the batch's own sorted keys by bucket, and FREQUENT keys."""
    known = docs.filter(F.col("doc_id").isNotNull() & F.col(column).isNotNull())
    rows = known.select("doc_id", F.col(column).cast("binary").alias(column)).mapInArrow(_keys(plan, buckets, column, keep_run), KEY_SCHEMA)
    if earlier is not None:
        rows = rows.union(earlier.select("kind", "bucket", "doc_id", "keys"))
    return rows.repartition(shuffle_partitions(docs.sparkSession), "bucket").mapInArrow(_met(buckets, keep_run, hot), KEY_SCHEMA)


def hot_keys(rows: DataFrame, least: int = HOT, most: int = HOT_KEYS) -> np.ndarray:
    """Of shared_keys() that is stored: keys of more than `least` documents and of more than a part in `most` of all units.

    So there are `most` at most, whatever the input.
    """
    total = rows.filter(F.col("kind") == TOTAL).agg(F.sum("doc_id")).first()[0] or 0
    found = rows.filter((F.col("kind") == FREQUENT) & (F.col("doc_id") > max(least, total // most))).select("keys").collect()
    return np.sort(np.frombuffer(b"".join(bytes(r[0]) for r in found), "<u8"))


class Holders:
    """First holders of contents; what later ones hold becomes marks."""

    def __init__(self, plan, buckets: int):
        self.plan, self.buckets = plan, buckets
        self.marks: list[tuple[int, int, int, int]] = []

    def mark(self, doc: int, th: int, starts, length: int) -> None:
        self.marks.extend([(doc, th, s, s + length) for s in starts])

    def put(self, held: dict, content: bytes, doc: int, th: int, starts: list[int]) -> None:
        """held: content to [document, {text hash: starts}]."""
        was = held.get(content)
        if was is None:
            held[content] = [doc, {th: starts}]
        elif self.plan.same_doc:
            self._earliest(held, content, was, doc, th, starts)
        elif was[0] == doc:
            was[1].setdefault(th, []).extend(starts)
        elif was[0] < doc:
            self.mark(doc, th, starts, self.plan.length(content))
        else:
            held[content] = [doc, {th: starts}]
            for t, s in was[1].items():
                self.mark(was[0], t, s, self.plan.length(content))

    def _earliest(self, held, content, was, doc, th, starts) -> None:
        t, (s,) = next(iter(was[1].items()))
        every = sorted([(was[0], t, s), *((doc, th, x) for x in starts)])
        d, t, s = every[0]
        held[content] = [d, {t: [s]}]
        n = self.plan.length(content)
        for e, u, x in every[1:]:
            if (e, u, x) != every[0]:
                # What the first holder itself covers stays.
                a = max(x, s + n) if (e, u) == (d, t) else x
                self.marks.append((e, u, a, x + n))

    def rows(self) -> list[tuple]:
        """Marks so far, packed by bucket of documents."""
        out = by_home(*np.array(self.marks, np.int64).reshape(-1, 4).T, self.buckets)
        self.marks = []
        return out


def by_home(doc: np.ndarray, th: np.ndarray, a: np.ndarray, b: np.ndarray, buckets: int) -> list[tuple]:
    doc, th, a, b = merged(doc, th, a, b)
    if not len(doc):
        return []
    home = home_of(doc, buckets)
    order = np.argsort(home, kind="stable")
    home, doc, th, a, b = home[order], doc[order], th[order], a[order], b[order]
    cut = [0, *(np.flatnonzero(np.diff(home)) + 1).tolist(), len(doc)]
    pack = zstandard.ZstdCompressor(level=1).compress
    parts = lambda i, j: b"".join([doc[i:j].tobytes(), th[i:j].tobytes(), a[i:j].astype("<i4").tobytes(), b[i:j].astype("<i4").tobytes()])
    return [(MARK, int(home[i]), pack(parts(i, j))) for i, j in zip(cut, cut[1:])]


def merged(doc: np.ndarray, th: np.ndarray, a: np.ndarray, b: np.ndarray):
    """Spans of each document and text sorted, overlapping or touching ones made one."""
    some = b > a
    doc, th, a, b = doc[some], th[some], a[some], b[some]
    order = np.lexsort((a, th, doc))
    doc, th, a, b = doc[order], th[order], a[order], b[order]
    if not len(doc):
        return doc, th, a, b
    group = np.cumsum((np.diff(doc, prepend=doc[0]) != 0) | (np.diff(th, prepend=th[0]) != 0))
    reach = np.maximum.accumulate(b + (group << 33)) - (group << 33)
    new = np.ones(len(a), bool)
    new[1:] = (group[1:] != group[:-1]) | (a[1:] > reach[:-1])
    first = np.flatnonzero(new)
    return doc[first], th[first], a[first], np.maximum.reduceat(b, first)


def joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted, overlapping or touching ones made one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            if b > out[-1][1]:
                out[-1] = out[-1][0], b
        else:
            out.append((a, b))
    return out


class Packed:
    """First holders of contents on their way to the buckets of their keys."""

    def __init__(self, buckets: int):
        self.buckets = buckets
        self.rest: list[tuple[int, int, int, list[int], bytes]] = []

    def add(self, key: int, contents: dict) -> None:
        for content, (doc, by) in contents.items():
            for th, starts in by.items():
                self.rest.append((key, doc, th, starts, content))

    def rows(self) -> list[tuple]:
        if not self.rest:
            return []
        key, doc, th, starts, content = zip(*self.rest)
        self.rest = []
        key = np.array(key, np.uint64)
        bucket = bucket_of(key, self.buckets)
        order = np.lexsort((key, bucket))
        cut = [0, *(np.flatnonzero(np.diff(bucket[order])) + 1).tolist(), len(order)]
        doc, th = np.array(doc, np.int64), np.array(th, np.int64)
        n, size = np.array([len(s) for s in starts], "<i4"), np.array([len(c) for c in content], "<i4")
        pack = zstandard.ZstdCompressor(level=1).compress
        out = []
        for i, j in zip(cut, cut[1:]):
            own = order[i:j]
            which = own.tolist()
            flat = np.array([x for k in which for x in starts[k]], "<i4")
            head = np.array([len(own), len(flat)], "<i4").tobytes()
            arrays = (key[own], doc[own], th[own], n[own], size[own], flat)
            out.append((UNIT, int(bucket[own[0]]), pack(b"".join([head, *(x.tobytes() for x in arrays), *(content[k] for k in which)]))))
        return out


def _unpacked(x: bytes) -> tuple[np.ndarray, list[int], list[int], list[list[int]], list[bytes]]:
    x = zstandard.ZstdDecompressor().decompress(x)
    m, f = (int(v) for v in np.frombuffer(x, "<i4", 2))
    at = 8
    arrays = []
    for kind, k in (("<u8", m), ("<i8", m), ("<i8", m), ("<i4", m), ("<i4", m), ("<i4", f)):
        a = np.frombuffer(x, kind, k, at)
        at += a.nbytes
        arrays.append(a)
    key, doc, th, n, size, flat = arrays
    ends = np.cumsum(size, dtype=np.int64) + at
    cut = np.cumsum(n, dtype=np.int64)
    flat = flat.tolist()
    contents = [x[e - s : e] for e, s in zip(ends.tolist(), size.tolist())]
    starts = [flat[e - s : e] for e, s in zip(cut.tolist(), n.tolist())]
    return key, doc.tolist(), th.tolist(), starts, contents


def _uncollected(run):
    """run without cycle collection: it makes many small objects and no cycles."""

    def inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        was = gc.isenabled()
        gc.disable()
        try:
            yield from run(batches)
        finally:
            if was:
                gc.enable()

    return inner


def _units(plan, buckets: int, hot):
    """hot: a broadcast array of keys to be split, or None."""

    @_uncollected
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        holders, packed_ = Holders(plan, buckets), Packed(buckets)
        split = hot.value if hot is not None and plan.cuts else np.zeros(0, np.uint64)
        held: dict[int, dict] = {}
        n = 0

        def out() -> list[tuple]:
            windows: dict = {}
            own = np.fromiter(held, np.uint64, len(held))
            cut = set(own[np.isin(short(own, buckets), split)].tolist())
            for key, contents in held.items():
                if key not in cut:
                    packed_.add(key, contents)
                    continue
                for content, (doc, by) in contents.items():
                    for th, starts in by.items():
                        for i, w in plan.windows(content):
                            holders.put(windows, w, doc, th, [s + i for s in starts])
            for w, holder in windows.items():
                packed_.add(xxhash.xxh64_intdigest(w), {w: holder})
            held.clear()
            return packed_.rows() + holders.rows()

        for raw, (ids, ths, lists) in chunks(batches, "z", "doc_id", "th", "keys"):
            u = plan.units(raw)
            allowed = [np.frombuffer(b"".join(x), "<u8") for x in lists]
            which = np.repeat(np.arange(len(raw), dtype=np.uint64), [len(a) for a in allowed])
            salt = np.uint64(0x9E3779B97F4A7C15)
            wanted = np.concatenate(allowed) ^ (which * salt)
            chosen = np.flatnonzero(np.isin(short(u.key, buckets) ^ (u.doc.astype(np.uint64) * salt), wanted))
            put = holders.put
            for d, s, k, c in zip(u.doc[chosen].tolist(), u.start[chosen].tolist(), u.key[chosen].tolist(), u.content(chosen)):
                put(held.setdefault(k, {}), c, ids[d], ths[d], [s])
            n += len(chosen)
            if n > UNITS_AT_ONCE:
                yield _batch(out(), UNIT_SCHEMA)
                n = 0
        yield _batch(out(), UNIT_SCHEMA)

    return run


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, list[bytes]]]:
    """Kind, bucket and what is held of rows sorted by kind and bucket."""
    from itertools import groupby
    from operator import itemgetter

    rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns)))
    for (kind, bucket), own in groupby(rows, itemgetter(0, 1)):
        yield kind, bucket, [r[2] for r in own]


def _contents(plan, buckets: int):
    @_uncollected
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        holders = Holders(plan, buckets)
        waiting: list[list] = []

        def resolve() -> None:
            if not waiting:
                return
            for group, spans in zip(waiting, plan.resolve([[(c, d) for c, (d, _) in g] for g in waiting])):
                for (_, (doc, by)), own in zip(group, spans):
                    for a, b in own:
                        for th, starts in by.items():
                            holders.mark(doc, th, [s + a for s in starts], b - a)
            waiting.clear()

        size = 0
        for kind, bucket, held in _by_bucket(batches):
            if kind == MARK:  # passes through, so that the units are made once
                yield _batch([(kind, bucket, x) for x in held], UNIT_SCHEMA)
                continue
            parts = [_unpacked(x) for x in held]
            held.clear()
            key = np.concatenate([p[0] for p in parts])
            rest = [[x for p in parts for x in p[k]] for k in range(1, 5)]
            del parts
            order = np.argsort(key, kind="stable")
            for a, n in _runs(key[order]):
                contents: dict = {}
                for i in order[a : a + n].tolist():
                    holders.put(contents, rest[3][i], rest[0][i], rest[1][i], rest[2][i])
                if len(contents) > 1 and plan.cuts:
                    waiting.append(sorted(contents.items(), key=lambda x: x[1][0]))
                    size += sum(map(len, contents))
                    if size > RESOLVE_BYTES:
                        resolve()
                        size = 0
            if len(holders.marks) > UNITS_AT_ONCE:
                yield _batch(holders.rows(), UNIT_SCHEMA)
        resolve()
        yield _batch(holders.rows(), UNIT_SCHEMA)

    return run


def _runs(key: np.ndarray) -> Iterator[tuple[int, int]]:
    """Place and number of equal keys that stand together, where there are two or more."""
    at = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    n = np.diff(at, append=len(key))
    yield from zip(at[n > 1].tolist(), n[n > 1].tolist())


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    unpack = zstandard.ZstdDecompressor().decompress
    for _, _, held in _by_bucket(batches):
        parts = []
        for x in map(unpack, held):
            m = len(x) // 24
            parts.append((np.frombuffer(x, "<i8", m), np.frombuffer(x, "<i8", m, 8 * m), np.frombuffer(x, "<i4", 2 * m, 16 * m)))
        doc, th = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
        a, b = (np.concatenate([np.split(p[2], 2)[k] for p in parts]).astype(np.int64) for k in (0, 1))
        doc, th, a, b = merged(doc, th, a, b)
        pairs = np.stack([a, b], 1).astype("<i4")
        first = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (th[1:] != th[:-1])))
        own = [pairs[i:j].tobytes() for i, j in zip(first.tolist(), [*first[1:].tolist(), len(doc)])]
        yield pa.RecordBatch.from_arrays([pa.array(doc[first]), pa.array(th[first]), pa.array(own, pa.binary())], names=["doc_id", "th", "spans"])


def wanted_keys(lists: DataFrame) -> DataFrame:
    """lists: LOCAL rows. Each document once, with its keys."""
    n = shuffle_partitions(lists.sparkSession)
    packed_ = lists.filter(F.col("kind") == LOCAL).repartition(n, "bucket").select("keys")
    return packed_.mapInArrow(_lists, "doc_id long, keys array<binary>")


def marks_of(docs: DataFrame, wanted: DataFrame, plan, buckets: int, hot: np.ndarray | None = None) -> DataFrame:
    """docs: packed. wanted: keys by document. Returns doc_id, th and spans, packed (start, end) pairs, joined."""
    rows = docs.filter("z is not null").join(wanted.hint("merge"), "doc_id").select("doc_id", "th", "z", "keys")
    return marks_from(rows, plan, buckets, hot)


def marks_from(rows: DataFrame, plan, buckets: int, hot: np.ndarray | None = None) -> DataFrame:
    """As marks_of, from rows that have their keys."""
    n = shuffle_partitions(rows.sparkSession)
    sent = rows.sparkSession.sparkContext.broadcast(hot) if hot is not None and len(hot) else None  # HOT_KEYS at most
    units = rows.mapInArrow(_units(plan, buckets, sent), UNIT_SCHEMA)
    spread = lambda df: df.repartition(n, "bucket").sortWithinPartitions("kind", "bucket")
    found = spread(units).mapInArrow(_contents(plan, buckets), UNIT_SCHEMA)
    return spread(found).mapInArrow(_spans, "doc_id long, th long, spans binary")


def spans_of(packed_: bytes | None) -> list[tuple[int, int]]:
    flat = np.frombuffer(packed_ or b"", "<i4").tolist()
    return list(zip(flat[::2], flat[1::2]))


def finished(docs: DataFrame, marks: DataFrame, figures, schema: str, text: str = "text") -> DataFrame:
    """doc_id and figures(text's bytes, spans) of each row of docs."""
    return with_figures(packed(docs, text).join(marks.hint("merge"), ["doc_id", "th"], "left"), figures, schema)


def with_figures(rows: DataFrame, figures, schema: str, more: tuple[str, ...] = ()) -> DataFrame:
    """doc_id and figures(text's bytes, spans, more columns' values) of rows with z and spans."""
    fields = [x.split() for x in schema.split(", ")]
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for b in batches:
            rows = [figures(b"" if z is None else unpack(z), spans_of(s), *x) for z, s, *x in zip(*(c.to_pylist() for c in b.columns[1:]))]
            own = [pa.array(c, kinds[t]) for c, (_, t) in zip(zip(*rows) if rows else [[]] * len(fields), fields)]
            yield pa.RecordBatch.from_arrays([b.column(0), *own], names=["doc_id", *(f[0] for f in fields)])

    return rows.select("doc_id", "z", "spans", *more).mapInArrow(run, f"doc_id long, {schema}")


def rewritten(docs: DataFrame, marks: DataFrame, change, text: str = "text") -> DataFrame:
    """docs, all rows and columns, with text as change(text's bytes, spans) where there are spans."""
    names = docs.columns
    held = unique_name(docs, "spans")
    m = marks.select(F.col("doc_id").alias("m_id"), F.col("th").alias("m_th"), F.col("spans").alias(held)).hint("merge")
    out = docs.join(m, (docs["doc_id"] == m["m_id"]) & (F.xxhash64(docs[text]) == m["m_th"]), "left").select(*(docs[c] for c in names), m[held])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spans = b.column(held).to_pylist()
            raw = b.column(text).cast(pa.binary()).to_pylist()
            new = [x if not s or x is None else change(x, spans_of(s)) for x, s in zip(raw, spans)]
            columns = [pa.array(new, pa.binary()).cast(pa.string()) if c == text else b.column(c) for c in names]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return out.mapInArrow(run, own)
