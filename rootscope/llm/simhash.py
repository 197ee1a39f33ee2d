"""SimHash near-duplicates: a grid range join of segment bit counts.

A fingerprint is cut into segments of SEGMENT_BITS bits and mapped to the vector of their bit counts. The
Manhattan distance of two vectors is at most the Hamming distance of the fingerprints, so pairs
within DISTANCE bits lie in a Manhattan ball of that radius. The grid's axes are GROUPS groups of segments:
vectors within the radius differ in at most DISTANCE groups, so they share a cell of the grid in which
that many axes are left out, and each fingerprint goes to the cells of all such choices. In a cell the
Manhattan bound is tested, then the Hamming distance itself.

Copies come down to one fingerprint first. A cell yields a spanning forest of its links, not all pairs: a
search from fingerprint to fingerprint, each looking only at those not yet reached. A cell of more than
CELL fingerprints is cut by a second grid, of another embedding: the bits are dealt out to segments in another order, which
keeps all distances, so no link is lost; and so on, through TURNS.

Null or empty text: no words, fingerprint zero. Null doc_id: fingerprinted, component null, linked to none.
Repeated doc_ids: each row is fingerprinted, and the id takes the least component of its rows. A bit that half of the
hashes have is zero. Very long texts are hashed whole, in parts; an empty table gives none; extra columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, shuffle_partitions, stored
from .components import components

SHINGLE, SEED, DISTANCE = 3, 42, 2
SEGMENT_BITS, GROUPS, CELL = 2, 8, 4096
#: Steps by which the bits are dealt out anew for a cell of more than CELL fingerprints; odd, so that each is an order of the bits.
TURNS = (5, 13, 27)


def fingerprint(raw: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    words = raw.translate(LOWER).split()
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        parts = [b" ".join(words)]
    elif shingle == 3:
        parts = [a + b" " + b + b" " + c for a, b, c in zip(words, words[1:], words[2:])]
    else:
        parts = [b" ".join(words[i : i + shingle]) for i in range(len(words) - shingle + 1)]
    ones = np.zeros(64, np.int64)
    for at in range(0, len(parts), 1 << 16):
        h = np.array([digest(p, seed) for p in parts[at : at + (1 << 16)]], "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(parts), bitorder="little").view("<u8")[0])


def _fingerprints(shingle: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(x or b"", shingle, seed) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.array(found, np.uint64).view(np.int64))], names=["doc_id", "fp"]
            )

    return run


def counts(fp: np.ndarray, bits: int = SEGMENT_BITS) -> np.ndarray:
    """The embedding: bit counts of the segments, by fingerprint and segment."""
    mask = np.uint64((1 << bits) - 1)
    shifts = np.arange(0, 64, bits, dtype=np.uint64)
    return np.bitwise_count((fp[:, None] >> shifts) & mask)


def cells(fp: np.ndarray, distance: int = DISTANCE, bits: int = SEGMENT_BITS, groups: int = GROUPS) -> Iterator[np.ndarray]:
    """A key for each fingerprint, for each choice of the grid's axes."""
    axes = []
    for part in np.array_split(counts(fp, bits), groups, axis=1):
        axis = np.zeros(len(fp), np.uint64)
        for column in part.T:
            axis = axis * np.uint64(bits + 1) + column
        axes.append(axis)
    for k, chosen in enumerate(combinations(range(groups), max(0, groups - distance))):
        key = np.full(len(fp), k + 1, np.uint64)
        for g in chosen:
            key = (key ^ axes[g]) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(29)
        yield key.view(np.int64)


def _in_cells(distance: int):
    groups = min(max(GROUPS, distance + 1), 64 // SEGMENT_BITS)  # more than may differ, if there are so many

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0)
            for key in cells(fp.to_numpy().view(np.uint64), distance, groups=groups):
                yield pa.RecordBatch.from_arrays([pa.array(key), fp], names=["key", "fp"])

    return run


def turned(fp: np.ndarray, step: int) -> np.ndarray:
    """The bits of each fingerprint in another order, so that other bits share a segment; distances stay."""
    out = np.zeros_like(fp)
    for i in range(64):
        out |= ((fp >> np.uint64(i)) & np.uint64(1)) << np.uint64(i * step % 64)
    return out


def links(fp: np.ndarray, distance: int = DISTANCE, cell: int = CELL, turn: int = 0) -> list[tuple[int, int]]:
    """Links among distinct fingerprints that span their components. A large cell is cut by the grid of another embedding."""
    if len(fp) <= cell or turn == len(TURNS):
        return _forest(fp, distance)
    out = []
    groups = min(max(GROUPS, distance + 1), 64 // SEGMENT_BITS)
    for key in cells(turned(fp, TURNS[turn]), distance, groups=groups):
        order = np.argsort(key, kind="stable")
        for run in np.split(fp[order], np.flatnonzero(np.diff(key[order])) + 1):
            if len(run) > 1:
                out += links(run, distance, cell, turn + 1)
    return out


def _forest(fp: np.ndarray, distance: int) -> list[tuple[int, int]]:
    out = []
    near = counts(fp).astype(np.int8)
    left = np.arange(len(fp))
    while len(left):
        reached, left = [left[0]], left[1:]
        while reached and len(left):
            i = reached.pop()
            close = np.abs(near[left] - near[i]).sum(1) <= distance
            at = left[close]
            at = at[np.bitwise_count(fp[at] ^ fp[i]) <= distance]
            if len(at):
                out += [(int(fp[i]), int(fp[j])) for j in at]
                reached += at.tolist()
                left = left[~np.isin(left, at, assume_unique=True)]
    return out


def _linked(distance: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, int]] = []

        def full():
            a = np.array(out, np.uint64).reshape(-1, 2).view(np.int64)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(a[:, 0].copy()), pa.array(a[:, 1].copy())], names=["a", "b"])

        for _, parts in _pairs_only(batches):
            out += links(parts, distance)
            if len(out) > 50_000:
                yield full()
        yield full()

    return run


def _pairs_only(batches):
    """(key, fingerprints) of the keys with two fingerprints or more."""
    rest_k, rest_f = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for batch in batches:
        k = np.concatenate([rest_k, batch.column("key").to_numpy()])
        f = np.concatenate([rest_f, batch.column("fp").to_numpy()])
        if not len(k):
            continue
        last = int(np.searchsorted(k, k[-1]))  # the last key may go on in the next batch
        yield from _equal(k[:last], f[:last])
        rest_k, rest_f = k[last:], f[last:]
    yield from _equal(rest_k, rest_f)


def _equal(k, f):
    if not len(k):
        return
    at = np.flatnonzero(np.diff(k, prepend=k[0] - 1))
    n = np.diff(at, append=len(k))
    for a, m in zip(at[n > 1].tolist(), n[n > 1].tolist()):
        yield int(k[a]), np.unique(f[a : a + m]).view(np.uint64)


def near_duplicates(docs: DataFrame, text: str = "text", shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """docs: doc_id and text. Returns doc_id, fp (long) and component_id."""
    spark = docs.sparkSession
    raw = docs.select("doc_id", F.col(text).cast("binary").alias("raw"))
    fps = stored(raw.mapInArrow(_fingerprints(shingle, SEED), "doc_id long, fp long"), "fingerprints")
    known = fps.filter(F.col("doc_id").isNotNull())
    reps = stored(known.groupBy("fp").agg(F.min("doc_id").alias("rep")), "groups")
    n = shuffle_partitions(spark)
    found = (
        reps.select("fp")
        .mapInArrow(_in_cells(distance), "key long, fp long")
        .repartition(n, "key")
        .sortWithinPartitions("key")
        .mapInArrow(_linked(distance), "a long, b long")
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .distinct()
    )
    return grouped(fps, reps, stored(found, "links"))


def grouped(fps: DataFrame, reps: DataFrame, found: DataFrame) -> DataFrame:
    """fps: doc_id and fp; reps: fp and its least doc_id, rep; found: links a and b of fps. Returns doc_id, fp and component_id."""
    known = fps.filter(F.col("doc_id").isNotNull())
    ends = found.join(reps.select(F.col("fp").alias("a"), F.col("rep").alias("u")), "a").join(
        reps.select(F.col("fp").alias("b"), F.col("rep").alias("v")), "b"
    )
    rows = ends.select("u", "v")
    # A repeated id may have several fingerprints: its rows are one node then.
    twice = known.groupBy("doc_id").agg(F.min("fp").alias("a"), F.max("fp").alias("b")).filter("a <> b").select("doc_id")
    again = known.join(twice, "doc_id").join(reps, "fp").select(F.col("doc_id").alias("u"), F.col("rep").alias("v"))
    roots = components(rows.union(again))
    # A node is named by an id, which may be that of several rows, or stand for a fingerprint.
    groups = stored(
        reps.join(roots.withColumnRenamed("node", "rep"), "rep", "left").select("fp", F.coalesce("root", "rep").alias("component_id")),
        "components",
    )
    out = fps.join(groups, "fp", "left")
    return out.select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs, all columns, without those whose component holds a smaller doc_id; of rows with one id all stay."""
    found = near_duplicates(docs, **options)
    gone = found.filter("component_id <> doc_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def op7(spark, sf_dir):
    from .common import table

    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
