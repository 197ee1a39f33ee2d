"""Line dedup by windows, or by content-defined chunks, of lines.

Windows (whole=True, as the query and the pipeline have it): each stretch of MIN_LINES lines with words, with the
blank lines between, is looked up over all documents (shared.py). Of equal windows the first stays, by
doc_id and then place, and the lines of the others go, so that every run of MIN_LINES lines or more that stands
earlier goes whole. In one document, lines of the first window itself stay.

Chunks (whole=False) cost fewer keys, but runs that hold no full chunk stay, and so do the ends of others.

A hash over each line and the one before it, rolling through the document, ends a chunk after the line
where it is divisible by MEAN_LINES: boundaries depend on nearby lines only, so an inserted line moves
at most its neighbours'. Chunks of at least MIN_LINES lines with words are looked up over all documents
(shared.py): of equal chunks the first stays, by doc_id and then place, the others go. Chunks
are compared byte for byte, hashes only bring them together. Chunks with fewer lines always stay.

Either way, single lines without a repeated neighbour stay.

Null text stays null. Null doc_id: nothing removed, and it removes nothing. Rows alike in doc_id and text are one.
"""

from __future__ import annotations

import hashlib

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Units, finished, marks_of, mixed, n_buckets, packed, rewritten, shared_keys, wanted_keys

MEAN_LINES, MIN_LINES = 3, 2


def chunks(lines: list[bytes], mean: int = MEAN_LINES) -> list[tuple[int, int]]:
    out, start, before = [], 0, 0
    for i, line in enumerate(lines):
        own = xxhash.xxh64_intdigest(line)
        rolling = (before * 0x9E3779B97F4A7C15 + own) & 0xFFFFFFFFFFFFFFFF
        before = own
        if (rolling >> 20) % mean == 0:
            out.append((start, i + 1))
            start = i + 1
    if start < len(lines):
        out.append((start, len(lines)))
    return out


class LinesPlan:
    same_doc, cuts = True, False

    def __init__(self, mean: int = MEAN_LINES, least: int = MIN_LINES, whole: bool = False):
        self.mean, self.least, self.whole = mean, least, whole

    def units(self, raw: list[bytes]) -> Units:
        return self._windows(raw) if self.whole else self._chunks(raw)

    def _windows(self, raw: list[bytes]) -> Units:
        lines = [x.split(b"\n") for x in raw]
        place = [[i for i, y in enumerate(own) if y.strip()] for own in lines]
        doc = np.repeat(np.arange(len(raw)), [len(p) for p in place])
        at = np.array([i for p in place for i in p], np.int64)
        h = np.array([xxhash.xxh64_intdigest(own[i]) for own, p in zip(lines, place) for i in p], np.uint64)
        n = max(0, len(at) - self.least + 1)
        key = np.zeros(n, np.uint64)
        for k in range(self.least):
            key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n])
        one = np.flatnonzero(doc[:n] == doc[self.least - 1 : self.least - 1 + n])
        doc, start, end, key = doc[one], at[one], at[one + self.least - 1] + 1, key[one]

        def content(chosen):
            return [b"\n".join(lines[d][a:b]) for d, a, b in zip(doc[chosen].tolist(), start[chosen].tolist(), end[chosen].tolist())]

        return Units(doc, start, end, key, content)

    def _chunks(self, raw: list[bytes]) -> Units:
        doc, start, end, key, held = [], [], [], [], []
        for d, x in enumerate(raw):
            lines = x.split(b"\n")
            for a, b in chunks(lines, self.mean) if len(lines) >= self.least else ():
                if b - a >= self.least and sum(bool(y.strip()) for y in lines[a:b]) >= self.least:
                    text = b"\n".join(lines[a:b])
                    doc.append(d)
                    start.append(a)
                    end.append(b)
                    key.append(xxhash.xxh64_intdigest(text, 1))
                    held.append(text)
        a = lambda v, t=np.int64: np.array(v, t)
        return Units(a(doc), a(start), a(end), a(key, np.uint64), lambda chosen: [held[i] for i in chosen.tolist()])

    def length(self, content: bytes) -> int:
        return content.count(b"\n") + 1


def repeated_chunks(docs: DataFrame, mean: int = MEAN_LINES, least: int = MIN_LINES, text: str = "text", whole: bool = False) -> DataFrame:
    """doc_id, th (a hash of the text) and spans of lines to be removed."""
    plan, buckets = LinesPlan(mean, least, whole), n_buckets(docs.sparkSession)
    docs = docs.select("doc_id", F.col(text).alias("text"))
    return marks_of(packed(docs), wanted_keys(shared_keys(docs, plan, buckets, "text")), plan, buckets)


def kept_lines(raw: bytes, spans: list[tuple[int, int]]) -> list[bytes]:
    lines = raw.split(b"\n")
    edges = [0, *(x for s in spans for x in s), len(lines)]
    return [x for a, b in zip(edges[::2], edges[1::2]) for x in lines[a:b]]


def remove_lines(docs: DataFrame, text: str = "text", **options) -> DataFrame:
    """docs, all rows and columns, without repeated chunks, or with whole without repeated runs of lines, in text."""
    return rewritten(docs, repeated_chunks(docs, text=text, **options), lambda raw, spans: b"\n".join(kept_lines(raw, spans)), text)


def figures(raw: bytes, spans: list[tuple[int, int]]) -> tuple:
    n, kept = raw.count(b"\n") + 1, kept_lines(raw, spans)
    return n, n - len(kept), len(spans), hashlib.sha256(b"\n".join(kept)).hexdigest()


def op6(spark, sf_dir):
    from .common import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return finished(docs, repeated_chunks(docs, whole=True), figures, "n_lines long, n_removed long, n_runs long, kept_sha256 string")
