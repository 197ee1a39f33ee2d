"""Incremental removal of repeated word windows with a log-structured fingerprint index.

The index is a folder. For each batch that came it holds an immutable run: by bucket, the sorted fingerprints of the
batch's windows (one per run of windows that share their least gram hash) with the ids of all documents that
have them, beside the batch's texts in a table bucketed by document. A new batch's sorted fingerprints are merge-joined with
one another and with each run; documents of both sides that share fingerprints meet again in shared.py, where windows
are compared word by word, and those of the new batch that an earlier document starts too are marked. Of the
texts that came before, only those with a shared fingerprint leave their buckets. Then the batch becomes a run of
level 0, and FAN_IN runs of one level are compacted to one of the next, texts and all: each bucket's runs are merged.
So a batch meets a number of runs that grows with the logarithm of their number, and each row is rewritten as often.

A manifest names the runs. It is written last, under a new number, so an index that was left in the midst of a
batch opens as it was before it. Batches come in order of doc_id, as a window counts as repeated if it starts in a document
with a smaller one; ids at or below one that came before are refused.

Null text: no words. Null doc_id: nothing removed, and it removes nothing. Rows of one doc_id are one document's, so there
are no ties. Very long texts are taken whole. An empty batch is a run without rows; extra columns play no part.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import file_system, shared_dir, shuffle_partitions, stored
from .hashing import _BYTE, powers
from .shared import (
    KEY_SCHEMA, LOCAL, RUN, Units, _batch, by_bucket, decode, finished, hot_keys, joined, least_runs, marks_from, mixed, n_buckets, packed,
    shared_keys, wanted_keys,
)
from .suffix_dedup import without

WINDOW, GRAM, FAN_IN, BATCHES = 50, 20, 2, 3
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True


class WordsPlan:
    same_doc, cuts = False, True

    def __init__(self, window: int = WINDOW, gram: int = GRAM):
        self.window, self.gram = window, gram

    def units(self, raw: list[bytes]) -> Units:
        data = b"\n".join([*raw, b""])
        b = np.frombuffer(data, np.uint8)
        space = _SPACE[b]
        edge = np.flatnonzero(np.diff(space, prepend=True))
        begin, stop = edge[::2], edge[1::2]
        size = np.array([len(x) + 1 for x in raw], np.int64)
        off = np.searchsorted(begin, np.cumsum(size) - size)
        n = np.diff(off, append=len(begin))
        up, down = powers(len(b))
        total = np.append(np.uint64(0), np.cumsum(_BYTE[b] * up))
        words = mixed((total[stop] - total[begin]) * down[begin])
        total = np.append(np.uint64(0), np.cumsum(words * up[: len(words)]))
        k = max(0, len(words) - self.gram + 1)
        grams = mixed((total[self.gram : self.gram + k] - total[:k]) * down[:k])
        doc, start, end, key = least_runs(grams, off, n, self.window, self.gram)

        def content(chosen):
            spans = zip(begin[start[chosen]].tolist(), stop[end[chosen] - 1].tolist())
            return [b" ".join(data[x:y].split()) for x, y in spans]

        return Units(doc, start - off[doc], end - off[doc], key, content)

    def length(self, content: bytes) -> int:
        return content.count(b" ") + 1

    def windows(self, content: bytes):
        words = content.split(b" ")
        return ((i, b" ".join(words[i : i + self.window])) for i in range(len(words) - self.window + 1))

    def resolve(self, groups):
        out = []
        for group in groups:
            first: dict[bytes, int] = {}
            every = [(d, list(self.windows(c))) for c, d in group]
            for d, windows in every:  # by document
                for _, w in windows:
                    first.setdefault(w, d)
            out.append([joined([(i, i + self.window) for i, w in windows if first[w] < d]) for d, windows in every])
        return out


def _compacted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[int, list[bytes]] = {}
    for b in batches:
        for bucket, keys in zip(b.column("bucket").to_pylist(), b.column("keys").to_pylist()):
            held.setdefault(bucket, []).append(keys)
    for bucket, runs in held.items():
        low, many, doc = (np.concatenate(x) for x in zip(*map(decode, runs)))
        order = np.lexsort((doc, low))
        yield _batch(by_bucket(RUN, np.full(len(low), bucket), low[order], many[order], doc[order]), KEY_SCHEMA)


class FingerprintIndex:
    """An index in the folder `path`: the one that is there, or a new one."""

    def __init__(self, spark, path: str, window: int = WINDOW, gram: int = GRAM, fan_in: int = FAN_IN):
        self.spark, self.path, self.fan_in = spark, path.rstrip("/"), max(2, fan_in)
        self.state = self._read() or {
            "number": 0, "window": window, "gram": gram, "buckets": n_buckets(spark), "parts": shuffle_partitions(spark), "last": None, "runs": [],
        }
        if (self.state["window"], self.state["gram"]) != (window, gram):
            raise ValueError(f"the index has windows of {self.state['window']} words and grams of {self.state['gram']}")
        self.plan, self.buckets, self.parts = WordsPlan(window, gram), self.state["buckets"], self.state["parts"]

    @property
    def runs(self) -> list[dict]:
        return self.state["runs"]

    def _read(self) -> dict | None:
        fs, folder = file_system(self.spark, self.path)
        if not fs.exists(folder):
            return None
        found = sorted(x.getPath().toString() for x in fs.listStatus(folder) if x.getPath().getName().startswith("manifest-"))
        return json.loads("".join(r[0] for r in self.spark.read.text(found[-1], wholetext=True).collect())) if found else None

    def _write(self) -> None:
        self.state["number"] += 1
        fs, p = file_system(self.spark, f"{self.path}/manifest-{self.state['number']:012d}")
        out = fs.create(p, True)
        out.write(bytearray(json.dumps(self.state).encode()))
        out.close()

    def _texts(self, path: str) -> DataFrame:
        """The table of texts at path, bucketed by doc_id, so that joins by it leave the texts where they are."""
        name = "texts_" + path.rsplit("-", 1)[1]
        if not self.spark.catalog.tableExists(name):
            self.spark.sql(
                f"CREATE TABLE {name} (doc_id BIGINT, th BIGINT, z BINARY) USING parquet CLUSTERED BY (doc_id) SORTED BY (doc_id) "
                f"INTO {self.parts} BUCKETS LOCATION '{path}'"
            )
        return self.spark.table(name)

    def _store_texts(self, rows: DataFrame) -> str:
        path = f"{self.path}/texts-{uuid.uuid4().hex}"
        name = "texts_" + path.rsplit("-", 1)[1]
        rows = rows.repartition(self.parts, "doc_id").sortWithinPartitions("doc_id")
        rows.write.format("parquet").bucketBy(self.parts, "doc_id").sortBy("doc_id").option("path", path).saveAsTable(name)
        return path

    def _store_run(self, rows: DataFrame) -> str:
        path = f"{self.path}/run-{uuid.uuid4().hex}"
        rows.write.parquet(path)
        return path

    def _run(self, path: str) -> DataFrame:
        return self.spark.read.schema(KEY_SCHEMA).parquet(path)

    def _drop(self, runs: list[dict]) -> None:
        for r in runs:
            self.spark.sql("DROP TABLE IF EXISTS texts_" + r["texts"].rsplit("-", 1)[1])
            for path in (r["run"], r["texts"]):
                fs, p = file_system(self.spark, path)
                fs.delete(p, True)

    def ingest(self, docs: DataFrame, text: str = "text") -> DataFrame:
        """Add a batch. Returns doc_id, th (a hash of the text) and spans of words that earlier documents have."""
        last = self.state["last"]
        new = packed(docs.select("doc_id", F.col(text).alias("text"))).filter("doc_id is not null and z is not null")
        at = self._store_texts(new)
        new = self._texts(at)
        low, high = new.agg(F.min("doc_id"), F.max("doc_id")).first()
        if last is not None and low is not None and low <= last:
            self._drop([{"run": at, "texts": at}])
            raise ValueError(f"doc_id {low} comes after {last}")
        earlier = reduce(DataFrame.union, (self._run(r["run"]) for r in self.runs)) if self.runs else None
        rows = stored(shared_keys(new, self.plan, self.buckets, "z", earlier, keep_run=True), "fingerprints")
        wanted = stored(wanted_keys(rows.filter(F.col("kind") == LOCAL)), "wanted")
        held = [new, *(self._texts(r["texts"]) for r in self.runs)]
        found = reduce(DataFrame.union, (t.join(wanted.hint("merge"), "doc_id").select("doc_id", "th", "z", "keys") for t in held))
        marks = marks_from(found, self.plan, self.buckets, hot_keys(rows))
        marks = stored(marks if last is None else marks.filter(F.col("doc_id") > last), "marks")
        run = self._store_run(rows.filter(F.col("kind") == RUN))
        self.runs.append({"run": run, "texts": at, "level": 0})
        self.state["last"] = high if high is not None else last
        self._write()
        while crowded := [n for n in sorted({r["level"] for r in self.runs}) if sum(r["level"] == n for r in self.runs) >= self.fan_in]:
            self.compact(crowded[0])
        return marks

    def compact(self, level: int) -> None:
        """Merge all runs of a level into one of the next."""
        old = [r for r in self.runs if r["level"] == level]
        every = reduce(DataFrame.union, (self._run(r["run"]) for r in old)).repartition(shuffle_partitions(self.spark), "bucket")
        run = self._store_run(every.mapInArrow(_compacted, KEY_SCHEMA))
        texts = self._store_texts(reduce(DataFrame.union, (self._texts(r["texts"]) for r in old)))
        self.state["runs"] = [*(r for r in self.runs if r["level"] != level), {"run": run, "texts": texts, "level": level + 1}]
        self._write()
        self._drop(old)


def figures(raw: bytes, spans: list[tuple[int, int]]) -> tuple:
    words = raw.split()
    kept = [w for i in range(len(spans) + 1) for w in words[spans[i - 1][1] if i else 0 : spans[i][0] if i < len(spans) else None]]
    return len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()


def repeated_words(docs: DataFrame, batches: int = BATCHES, text: str = "text", path: str | None = None, **options) -> DataFrame:
    """All of docs through an index, in batches by doc_id. Returns as ingest. Without a path the index goes when the driver ends."""
    spark = docs.sparkSession
    if path is None:
        path = f"{shared_dir(spark)}/index-{uuid.uuid4().hex}"
        fs, p = file_system(spark, path)
        fs.deleteOnExit(p)
    index = FingerprintIndex(spark, path, **options)
    cuts = docs.agg(F.percentile_approx("doc_id", [i / batches for i in range(1, batches)], 1000)).first()[0] if batches > 1 else []
    edges = [None, *sorted(set(cuts or [])), None]
    found = []
    for a, b in zip(edges, edges[1:]):
        part = docs if a is None else docs.filter(F.col("doc_id") > a)
        found.append(index.ingest(part if b is None else part.filter(F.col("doc_id") <= b), text))
    return reduce(DataFrame.union, found)


def op8(spark, sf_dir):
    from .common import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return finished(docs, repeated_words(docs), figures, "n_words long, n_removed long, kept_sha256 string")


OP8_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, i, hash(array_to_string(w[i:i + 49], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
m AS (SELECT h, min(doc_id) AS first FROM p GROUP BY h HAVING count(*) > 1),
c AS (SELECT DISTINCT doc_id, pos FROM (SELECT doc_id, unnest(range(i, i + 50)) AS pos FROM p JOIN m USING (h) WHERE first < doc_id)),
g AS (SELECT doc_id, list(pos) AS gone FROM c GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
sha256(array_to_string(CASE WHEN gone IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(gone, i)) END, ' ')) AS kept_sha256
FROM d LEFT JOIN g USING (doc_id)
"""
