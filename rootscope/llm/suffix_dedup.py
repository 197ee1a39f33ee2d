"""Exact removal of repeated byte strings with a run-length index.

A byte is removed if a WINDOW-byte string that covers it also starts in a document with a smaller doc_id.
shared.py brings contents (runs of windows) that share a key together, equal ones once. Those of a key that differ
are matched here, many keys in one block, so that each two documents meet once, the earlier one in the index:

* windows of which the first or last 37 bytes stand nowhere else in the block (by a table of hashes) are left out;
* the earlier contents' suffix array gives their Burrows-Wheeler transform, kept as runs, with samples of the
  suffix array at the runs' two ends only;
* the later contents are streamed through it from right to left. The state of each is a run, a place in it and the
  sampled position that it stands for; these give its matching statistics, the length of the longest match from each byte on;
* windows whose match is as long as they are stand in the earlier document, and are marked.

Of documents with equal texts (MD5), the first stands for all; the others lose every window.

Null text: empty. Null doc_id: nothing removed, and it removes nothing. Rows of one doc_id are one document's: no row
removes what another has. Ties cannot be: of two documents one has the smaller id. Very long texts are streamed in parts
of STREAMED windows that overlap. An empty table gives an empty result; extra columns play no part.
"""

from __future__ import annotations

import hashlib

import numpy as np

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import released, stored
from .hashing import _BYTE, powers
from .shared import HOT, Units, hot_keys, joined, least_runs, marks_from, mixed, n_buckets, packed, shared_keys, wanted_keys, with_figures

#: Bytes of a window and of the grams that choose units.
WINDOW, GRAM = 50, 24
#: Windows of a string that are streamed as one, longer strings go in parts; bits of a table of hashes; bytes of a block.
STREAMED, SLOTS, BLOCK = 128, 23, 1 << 20


class RunIndex:
    """Run-compressed transform of strings, with samples of the suffix array at run ends.

    Each string has a tag, and only strings of a tag are alike: a tag and a byte make a symbol. Strings end in symbols of
    their own, in the order in which they stand.
    """

    def __init__(self, text: np.ndarray, starts: np.ndarray, lengths: np.ndarray, tags: np.ndarray, window: int):
        """text: bytes; starts, lengths, tags: of each string in it. window: the length from which matches count."""
        self.window = window
        own = lengths + 1
        off = np.cumsum(own) - own
        n = int(own.sum())
        where = np.repeat(starts - off, own) + np.arange(n)
        self.rest = np.repeat(off + lengths, own) - np.arange(n)  # bytes up to the string's end
        tag = np.repeat(tags, own)
        raw = np.where(self.rest > 0, text[np.minimum(where, len(text) - 1)], 0).astype(np.uint8)
        symbol = np.where(self.rest > 0, tag * 256 + raw, -1)
        sa = suffix_array(raw, self.rest, tag)
        bwt = symbol[sa - 1]  # of a string's first byte: the end before it
        new = np.ones(n, bool)
        new[1:] = (bwt[1:] != bwt[:-1]) | (bwt[1:] < 0)
        self.start = np.flatnonzero(new)
        self.head = bwt[self.start]
        self.length = np.diff(self.start, append=n)
        self.at_start, self.at_end = sa[self.start], sa[self.start + self.length - 1]
        self.run_of = np.repeat(np.arange(len(self.start)), self.length)  # directory from rows to runs
        # Where a step leads: rows of one symbol stand together, in the order of the runs they come from.
        self.stride = len(self.start)
        self.order = np.argsort(self.head, kind="stable")
        self.keys = self.head[self.order] * self.stride + self.order
        size = self.length[self.order]
        before = np.cumsum(size) - size
        self.to = np.zeros(len(self.start), np.int64)
        self.to[self.order] = self._first_rows(symbol[sa], before)
        pad = np.zeros(len(raw) + window + 16, np.uint64)
        pad[: len(raw)] = raw
        for s in (1, 2, 4):
            pad[: len(pad) - s] |= pad[s:] << np.uint64(8 * s)
        self.words = pad

    def _first_rows(self, first: np.ndarray, before: np.ndarray) -> np.ndarray:
        """Row of the first suffix that a run leads to, by runs in the order of their symbols. first: symbols of the rows."""
        heads = self.head[self.order]
        lead = np.flatnonzero(np.append(True, first[1:] != first[:-1]) & (first >= 0))
        at = lead[np.searchsorted(first[lead], np.maximum(heads, 0))] if len(lead) else np.zeros(len(heads), np.int64)
        new = np.append(True, heads[1:] != heads[:-1])
        group = np.flatnonzero(new)[np.cumsum(new) - 1]
        return np.where(heads >= 0, at + before - before[group], 0)

    def common(self, a: np.ndarray, b: np.ndarray, words: int) -> np.ndarray:
        """Length of the common prefix of suffixes a and b, 8 * words at most."""
        x = self.words[a] ^ self.words[b]
        out = (np.bitwise_count(~x & (x - np.uint64(1))) >> 3).astype(np.int64)  # zero bytes from the first one on
        live = np.flatnonzero(x == 0)
        for k in range(8, 8 * words, 8):
            if not len(live):
                break
            x = self.words[a[live] + k] ^ self.words[b[live] + k]
            out[live] += np.bitwise_count(~x & (x - np.uint64(1))) >> 3
            live = live[x == 0]
        return np.minimum(out, np.minimum(self.rest[a], self.rest[b]))

    def matching_statistics(self, text: np.ndarray, starts: np.ndarray, lengths: np.ndarray, tags: np.ndarray):
        """Places in text where a string of the index matches `window` bytes or more from there on.

        All strings advance together, longest first, each from its own right end, one byte to the left a step: a
        run of the byte leads on; from another run, the nearest runs of the byte before and after it do, of which
        the one whose sample shares most with the match so far. Lengths are exact up to `window`.
        """
        by = np.argsort(-lengths, kind="stable")
        ends, lengths, tags = (starts + lengths)[by], lengths[by], tags[by]
        words = self.window // 8 + 1
        m, last = len(by), len(self.keys) - 1
        run, skip, at, n = (np.zeros(m, np.int64) for _ in range(4))
        found = []
        for step in range(int(lengths[0]) if m else 0):
            live = int(np.searchsorted(-lengths, -step, "left"))
            place = ends[:live] - 1 - step
            c = tags[:live] * 256 + text[place]
            r, o, p, k = run[:live], skip[:live], at[:live], n[:live]
            p -= 1
            k += 1
            jump = np.flatnonzero((self.head[r] != c) | (k == 1))
            if len(jump):
                cj, was = c[jump], k[jump] - 1
                i = np.searchsorted(self.keys, cj * self.stride + r[jump])
                down, up = self.order[np.minimum(i, last)], self.order[np.maximum(i - 1, 0)]
                has_down, has_up = self.head[down] == cj, self.head[up] == cj
                pos = p[jump] + 1
                share_down = np.where(has_down, np.minimum(was, self.common(pos, self.at_start[down], words)), -1)
                share_up = np.where(has_up, np.minimum(was, self.common(pos, self.at_end[up], words)), -1)
                lower = share_down > share_up
                r[jump] = np.where(lower, down, up)
                o[jump] = np.where(lower, 0, self.length[up] - 1)
                p[jump] = np.where(lower, self.at_start[down], self.at_end[up]) - 1
                k[jump] = np.maximum(share_down, share_up) + 1
            row = self.to[r] + o
            r[:] = self.run_of[row]
            o[:] = row - self.start[r]
            np.maximum(p, 0, out=p)
            found.append(place[k >= self.window])
        return np.concatenate(found) if found else np.zeros(0, np.int64)


def suffix_array(raw: np.ndarray, rest: np.ndarray, tag: np.ndarray) -> np.ndarray:
    """Suffixes by tag and bytes up to their strings' ends (ends of all tags first), alike ones by place.

    Prefix doubling; each round sorts only suffixes that are not told apart yet.
    """
    n = len(raw)
    bits = int(tag.max()).bit_length() if n else 0
    span = (63 - bits) // 9
    key = np.where(rest > 0, tag, 0).astype(np.int64)
    symbol = np.where(rest > 0, raw.astype(np.int64) + 1, 0)
    inside = np.zeros(n + span, np.int64)
    inside[:n] = symbol
    for i in range(span):
        key = (key << 9) | np.where(rest > i, inside[i : i + n], 0)
    order = np.argsort(key, kind="stable")
    key = key[order]
    new = np.ones(n, bool)
    new[1:] = key[1:] != key[:-1]
    rank = np.empty(n, np.int64)
    first = np.flatnonzero(new)
    rank[order] = np.repeat(first, np.diff(first, append=n))
    while True:
        # Places in the order whose suffix is not told apart; those that have ended are in order, by place.
        group = rank[order]
        tied = np.zeros(n, bool)
        tied[1:] = group[1:] == group[:-1]
        tied[:-1] |= tied[1:]
        open_ = np.flatnonzero(tied & (rest[order] >= span))
        if not len(open_):
            return order
        own = order[open_]
        key = (group[open_] << 32) | rank[own + span]
        by = np.argsort(key, kind="stable")
        own, key = own[by], key[by]
        order[open_] = own
        new = np.ones(len(own), bool)
        new[1:] = key[1:] != key[:-1]
        first = np.flatnonzero(new)
        rank[own] = np.repeat(open_[first], np.diff(first, append=len(own)))
        span *= 2


class Twins:
    """Which windows may stand elsewhere: those whose first and last part have twins, by a table of hashes."""

    def __init__(self):
        self.table: tuple[np.ndarray, np.ndarray] | None = None

    def __getstate__(self):
        return {"table": None}

    def keep(self, left: np.ndarray, slot, apart: int) -> None:
        """left: places of windows, narrowed in place. slot(places): of the part from each on; apart: from first to last part."""
        if self.table is None:
            self.table = np.empty(1 << SLOTS, np.int32), np.zeros(1 << SLOTS, bool)
        last, shared = self.table
        at = np.flatnonzero(left)
        ends = np.zeros(len(left), bool)
        ends[at] = ends[at + apart] = True
        places = np.flatnonzero(ends)
        found = slot(places)
        own = np.arange(len(found), dtype=np.int32)
        last[found] = own
        twice = found[last[found] != own]
        shared[twice] = True
        ends[places] = shared[found]
        shared[twice] = False
        left[at] = ends[at] & ends[at + apart]


class BytesPlan:
    same_doc, cuts = False, True

    def __init__(self, window: int = WINDOW, gram: int = GRAM):
        self.window, self.gram, self.twins = window, gram, Twins()

    def units(self, raw: list[bytes]) -> Units:
        data = b"".join(raw)
        n = np.array([len(x) for x in raw], np.int64)
        off = np.cumsum(n) - n
        doc, start, end, key = least_runs(self.grams(data), off, n, self.window, self.gram)

        def content(chosen):
            return [data[a:b] for a, b in zip(start[chosen].tolist(), end[chosen].tolist())]

        return Units(doc, start - off[doc], end - off[doc], key, content)

    def grams(self, data: bytes) -> np.ndarray:
        """A hash of the `gram` bytes from each place on, from words of eight bytes."""
        size = max(0, len(data) - self.gram + 1)
        x = np.frombuffer(data + bytes(8), np.uint8).astype(np.uint64)
        for s in (1, 2, 4):
            x = x[:-s] | (x[s:] << np.uint64(8 * s))
        h = np.zeros(size, np.uint64)
        for k, at in enumerate([*range(0, self.gram - 8, 8), self.gram - 8]):
            h = (h ^ x[at : at + size]) * np.uint64(0x9E3779B97F4A7C15 + 2 * k)
            h ^= h >> np.uint64(31)
        return mixed(h)

    def length(self, content: bytes) -> int:
        return len(content)

    def windows(self, content: bytes):
        return ((i, content[i : i + self.window]) for i in range(len(content) - self.window + 1))

    def resolve(self, groups):
        """Spans of windows that an earlier document's content of the group has too, for each content.

        Groups go in blocks of about BLOCK bytes. What a block took goes back to the system before the next one: workers
        live on from task to task, and what they keep counts as their executor's.
        """
        size = np.array([sum(len(c) for c, _ in g) for g in groups], np.int64)
        block = (np.cumsum(size) - size) // BLOCK
        cut = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(groups)]
        out = []
        for i, j in zip(cut, cut[1:]):
            out += self._block(groups[i:j])
            released()
        return out

    def _block(self, groups):
        """resolve() of one block.

        Documents of a group are numbered in their order. In round r, those of each even block of 2 ** r numbers are
        indexed, and those of the odd block after it are streamed: each two documents meet once, the earlier
        one in the index. The blocks of a group have tags of their own, so all groups' blocks go into one index.
        What a round marks leaves the next ones, as an earlier document has it, and so do windows of which a part has no twin.
        """
        flat = [x for g in groups for x in g]
        if not flat:
            return [[] for _ in groups]
        w = self.window
        text = np.frombuffer(b"".join(c for c, _ in flat), np.uint8)
        size = np.array([len(c) for c, _ in flat], np.int64)
        off = np.cumsum(size) - size
        group = np.repeat(np.arange(len(groups)), [len(g) for g in groups])
        doc = np.array([d for _, d in flat], np.int64)
        step = np.append(0, (doc[1:] != doc[:-1]).astype(np.int64))
        first = np.flatnonzero(np.diff(group, prepend=-1))
        step[first] = 0
        number = np.cumsum(step)
        number -= number[first][group]  # contents of a group come in order of their documents
        left = np.zeros(len(text), bool)  # places of windows that no earlier document is known to have
        left[np.repeat(off, np.maximum(0, size - w + 1)) + _counted(np.maximum(0, size - w + 1))] = True
        gone = np.zeros(len(text), bool)
        most = np.zeros(len(groups), np.int64)
        np.maximum.at(most, group, number)
        part = (w + self.gram) // 2
        up, down = powers(len(text))
        total = np.append(np.uint64(0), np.cumsum(_BYTE[text] * up))
        del up

        def slot(at: np.ndarray) -> np.ndarray:
            h = (total[at + part] - total[at]) * down[at] + group[np.searchsorted(off, at, "right") - 1].astype(np.uint64)
            return ((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SLOTS)).astype(np.int64)

        r = 0
        while (most >> r).any():
            self.twins.keep(left, slot, w - part)
            starts = np.flatnonzero(left & ~np.append(False, left[:-1]))
            ends = np.flatnonzero(left & ~np.append(left[1:], False)) + 1
            of = np.searchsorted(off, starts, "right") - 1
            block, own = number[of] >> r, group[of]
            pair = block >> 1
            name = own * (int(number.max()) + 1) + pair
            odd = (block & 1).astype(bool)
            early, late = np.flatnonzero(~odd), np.flatnonzero(odd)
            early, late = early[np.isin(name[early], name[late])], late[np.isin(name[late], name[early])]
            if len(early) and len(late):
                index = RunIndex(text, starts[early], ends[early] - starts[early] + w - 1, pair[early], w)
                parts = -(-(ends[late] - starts[late]) // STREAMED)
                a = np.repeat(starts[late], parts) + STREAMED * _counted(parts)
                n = np.minimum(STREAMED, np.repeat(ends[late], parts) - a)
                found = index.matching_statistics(text, a, n + w - 1, np.repeat(pair[late], parts))
                gone[found], left[found] = True, False
            r += 1
        starts = np.flatnonzero(gone & ~np.append(False, gone[:-1]))
        ends = np.flatnonzero(gone & ~np.append(gone[1:], False)) + w
        of = np.searchsorted(off, starts, "right") - 1
        spans: list[list[tuple[int, int]]] = [[] for _ in flat]
        for i, a, b in zip(of.tolist(), (starts - off[of]).tolist(), (ends - off[of]).tolist()):
            spans[i].append((a, b))
        out = iter(joined(x) if len(x) > 1 else x for x in spans)
        return [[next(out) for _ in g] for g in groups]


def _counted(many: np.ndarray) -> np.ndarray:
    """0, 1, ... up to each number."""
    return np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)


def text_hash(text: str):
    return F.md5(F.col(text).cast("binary"))


def repeated_bytes(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, text: str = "text", hot: int = HOT) -> DataFrame:
    """th (the text's MD5), first (the least doc_id with this text) and spans of what that document loses.

    Of equal texts only the first takes part: the others' windows all start in it.
    """
    plan, buckets = BytesPlan(window, gram), n_buckets(docs.sparkSession)
    docs = docs.filter(F.col("doc_id").isNotNull() & F.col(text).isNotNull()).select("doc_id", F.col(text).alias("text"))
    th = text_hash("text")
    name = F.conv(F.substring("th", 1, 15), 16, 10).cast("long")  # tells texts apart while their keys are counted
    firsts = stored(docs.groupBy(th.alias("th")).agg(F.min("doc_id").alias("first")), "texts").withColumn("long", name)
    texts = docs.withColumn("th", th).select(name.alias("doc_id"), "text")
    rows = stored(shared_keys(texts, plan, buckets, "text", hot=hot), "keys")
    lists = wanted_keys(rows).withColumnRenamed("doc_id", "long")
    wanted = firsts.join(lists.hint("merge"), "long").select(F.col("first").alias("doc_id"), "th", "keys")
    whole = packed(docs, th=th).join(wanted.hint("merge"), ["doc_id", "th"]).select("doc_id", name.alias("th"), "z", "keys")
    marks = marks_from(whole, plan, buckets, hot_keys(rows, hot)).withColumnsRenamed({"doc_id": "first", "th": "long"})
    return firsts.join(marks.hint("merge"), ["first", "long"], "left").select("th", "first", "spans")


def without(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    out, at = [], 0
    for a, b in spans:
        out.append(raw[at:a])
        at = b
    return b"".join([*out, raw[at:]])


def figures(raw: bytes, spans: list[tuple[int, int]], later: bool = False, window: int = WINDOW) -> tuple:
    """later: an earlier document has the whole text."""
    spans = ([(0, len(raw))] if len(raw) >= window else []) if later else spans
    kept = without(raw, spans)
    return len(raw), len(raw) - len(kept), len(spans), hashlib.sha256(kept).hexdigest()


def result(docs: DataFrame, found: DataFrame, text: str = "text") -> DataFrame:
    """docs: doc_id and text; found: repeated_bytes(). doc_id and figures of each row."""
    rows = packed(docs, text, text_hash(text)).join(stored(found, "marks").hint("merge"), "th", "left")
    rows = rows.withColumn("later", F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False)))
    rows = rows.withColumn("spans", F.when(F.col("doc_id").isNotNull(), F.col("spans")))
    return with_figures(rows, figures, "n_bytes long, n_removed long, n_spans long, kept_sha256 string", ("later",))


def op4(spark, sf_dir):
    from .common import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return result(docs, repeated_bytes(docs))
