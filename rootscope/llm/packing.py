"""Best-fit packing by hierarchical residual merging.

Each partition tokenises its documents and packs the pieces best-fit, longest first. Bins that lack at most
NEAR tokens are done. The rest become items: rounds of best-fit merge the bins of FAN partitions, then of
FAN of these, up to one root; after each round nearly full bins leave.

Bins of one length are interchangeable, so a round sees no bins, only how many of each length each child
holds: at most FAN * capacity counts, whatever the number of documents. It returns which ranges of each
class go to which ranges of the merged classes and at what place, and the pieces follow these ranges in
one join per round. A document's pieces may lie in any sequences.

Null text: empty, so only the end id. Repeated rows: each row is packed. Null doc_id: kept as null. Ties: equal lengths are
interchangeable, the first open bin of the tightest room takes a piece. Very long texts are cut into as many pieces as they need;
an empty table gives none. Extra columns play no part.
"""

from __future__ import annotations

import os
import unicodedata
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, stored

CAPACITY, NEAR, FAN, END_ID, CACHED_WORDS = 2048, 2, 64, 0, 500_000
#: Fixed value: the tokenizer's split. Words beyond the last Latin letter here are left to the tokenizer itself.
_SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
_LATIN = "\u024f"
#: The tokenizer's characters for bytes: printable ones stand for themselves, the others follow from 256 on.
_SELF = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE_LEVEL = {b: 256 + i for i, b in enumerate(sorted(set(range(256)) - set(_SELF)))}


class WordTokens:
    """Ids of texts by a tokenizer that drops white space and lower-cases: each word's ids are found once.

    The ids of a text are those of its parts between white space, and those of a part are its pieces' by the
    tokenizer's split; equal words and pieces are looked up.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.known: dict[bytes, bytes] = {}  # a cache in two generations, kept from task to task
        self.old: dict[bytes, bytes] = {}

    def _plain(self, words: list[bytes]) -> list[bytes]:
        coded = self.tokenizer.encode_batch([w.decode("utf-8", "replace") for w in words], add_special_tokens=False)
        return [np.array(x.ids, "<u4").tobytes() for x in coded]

    def _piece(self, piece: str) -> bytes:
        """By the model alone, of what splitting yields."""
        if not piece.isascii():
            piece = piece.encode().decode("latin-1").translate(_BYTE_LEVEL)
        return b"".join([t.id.to_bytes(4, "little") for t in self.tokenizer.model.tokenize(piece)])

    def learn(self, words: set[bytes]) -> None:
        known, old, rest = self.known, self.old, []
        for w in words:
            if w in known:
                continue
            if (ids := old.get(w)) is None:
                text = w.decode("utf-8", "replace")
                if text.isascii() and text.isalpha():
                    ids = self._piece(text)
                elif not text.isascii() and max(text) > _LATIN:
                    rest.append(w)
                    continue
                else:
                    if not text.isascii():
                        text = "".join([c.lower() for c in unicodedata.normalize("NFC", text)])
                    ids = b""
                    for piece in _SPLIT.findall(text):
                        key = piece.encode()
                        part = known.get(key) or old.get(key)
                        if part is None or key == w:
                            part = self._piece(piece)
                            known[key] = part
                        ids += part
            known[w] = ids
        known.update(zip(rest, self._plain(rest)))

    def ids(self, texts: list[bytes]) -> Iterator[bytes]:
        """Of each text: its ids as little-endian unsigned 32-bit numbers."""
        for at in range(0, len(texts), 256):
            some = texts[at : at + 256]
            low = [t.translate(LOWER) for t in some]
            # Special tokens' strings are matched before lower-casing, so such a text is coded as it is.
            whole = [any(s in t for s in self.special) for t in low]
            words = [[] if w else t.split() for t, w in zip(low, whole)]
            if len(self.known) > CACHED_WORDS:
                self.old, self.known = self.known, {}
            self.learn(set().union(*words))
            for t, w, own in zip(some, whole, words):
                yield self._plain([t])[0] if w else b"".join(map(self.known.__getitem__, own))


@cache
def word_tokens(path: str) -> WordTokens:
    return WordTokens(path)


def best_fit(classes: list[tuple[int, int]], capacity: int = CAPACITY) -> list[tuple[int, list[tuple[int, int]]]]:
    """Pack items given as (length, how many). Returns groups of alike bins: how many, and their slots.

    A slot (length, first): bin j of the group holds item first + j of that length's items there.
    """
    open_groups: dict[int, list] = {}
    rooms: list[int] = []
    done = []

    def put(room: int, group) -> None:
        if room == 0:
            done.append(group)
        elif open_groups.setdefault(room, []):
            open_groups[room].append(group)
        else:
            open_groups[room].append(group)
            insort(rooms, room)

    for length, left in sorted(classes, reverse=True):
        nxt = 0
        while left:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                many, slots = open_groups[room].pop()
                if not open_groups[room]:
                    del rooms[at]
            else:
                room, many, slots = capacity, left, []
            each = room // length
            full = min(many, left // each)
            take, bins = (each, full) if full else (left, 1)
            new = [(length, nxt + u * bins) for u in range(take)]
            nxt += take * bins
            left -= take * bins
            put(room - take * length, (bins, slots + new))
            if slots and many > bins:
                put(room, (many - bins, [(a, b + bins) for a, b in slots]))
    return done + [g for gs in open_groups.values() for g in gs]


def merged(rows: pd.DataFrame, capacity: int) -> pd.DataFrame:
    """One round at one node. rows: child, size, n. Returns ranges: child, size, lo, hi to psize, plo at poff."""
    rows = rows.sort_values(["size", "child"])
    held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for size, r in rows.groupby("size"):
        held[int(size)] = r["child"].to_numpy(), np.concatenate([[0], np.cumsum(r["n"].to_numpy())])
    out = []
    count: dict[int, int] = {}
    for many, slots in best_fit([(s, int(c[1][-1])) for s, c in held.items()], capacity):
        total = sum(s for s, _ in slots)
        base = count.get(total, 0)
        count[total] = base + many
        offset = 0
        for size, first in slots:
            children, ends = held[size]
            k = int(np.searchsorted(ends, first, "right")) - 1
            at = first
            while at < first + many:
                stop = min(first + many, int(ends[k + 1]))
                if stop > at:
                    out.append((int(children[k]), size, at - int(ends[k]), stop - int(ends[k]), total, base + at - first, offset))
                at, k = stop, k + 1
            offset += size
    return pd.DataFrame(out, columns=["child", "size", "lo", "hi", "psize", "plo", "poff"])


def _local(path: str, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, node = word_tokens(path), TaskContext.get().partitionId()
        end = np.array([END_ID], "<u4").tobytes()
        docs, piece, start, length, crc = [], [], [], [], []
        for batch in batches:
            raw = [x or b"" for x in batch.column(1).to_pylist()]
            for doc, ids in zip(batch.column(0).to_pylist(), tokens.ids(raw)):
                ids += end
                n = len(ids) // 4
                for k, a in enumerate(range(0, n, capacity)):
                    docs.append(doc)
                    piece.append(k)
                    start.append(a)
                    length.append(min(capacity, n - a))
                    crc.append(zlib.crc32(ids[4 * a : 4 * (a + capacity)]))
        lengths = np.array(length, np.int64)
        order = np.argsort(-lengths, kind="stable")
        sizes, counts = np.unique(lengths, return_counts=True)
        first = {int(s): int(np.searchsorted(-lengths[order], -s)) for s in sizes}
        size, idx, offset = (np.zeros(len(lengths), np.int64) for _ in range(3))
        count: dict[int, int] = {}
        for many, slots in best_fit(list(zip(sizes.tolist(), counts.tolist())), capacity):
            total, at = sum(s for s, _ in slots), 0
            base = count.get(total, 0)
            count[total] = base + many
            for s, a in slots:
                own = order[first[s] + a : first[s] + a + many]
                size[own], offset[own], idx[own] = total, at, base + np.arange(many)
                at += s
        columns = [
            pa.array(docs, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(lengths),
            pa.array(crc, pa.int64()), pa.array(np.full(len(docs), node), pa.int64()), pa.array(size), pa.array(idx), pa.array(offset),
        ]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", "ids_crc32", "node", "size", "idx", "offset"])

    return run


LOCAL_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long, node long, size long, idx long, offset long"


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, near: int = NEAR, fan: int = FAN) -> DataFrame:
    """docs: doc_id and text. Returns a row for each piece, with sequence_id and offset."""
    own = docs.select("doc_id", F.col("text").cast("binary").alias("raw"))
    open_ = stored(own.mapInArrow(_local(tokenizer, capacity), LOCAL_SCHEMA), "pieces")
    full = F.col("size") >= capacity - near
    nodes = 1 + (open_.agg(F.max("node")).first()[0] or 0)
    level, bits = 0, max(1, (nodes - 1).bit_length())

    def placed(rows: DataFrame) -> DataFrame:
        # level, node, length and rank within the class make a bin's number; there are fewer nodes at each level.
        number = F.lit(level << 59) + F.shiftleft("node", 59 - bits) + F.shiftleft("size", 59 - bits - capacity.bit_length()) + F.col("idx")
        return rows.select("doc_id", "piece", "start", "length", "ids_crc32", number.alias("sequence_id"), "offset")

    done = placed(open_.filter(full | F.lit(nodes == 1)))
    classes = open_.filter(~full).groupBy("node", "size").agg((F.max("idx") + 1).alias("n"))
    while nodes > 1:
        level += 1
        nodes = -(-nodes // fan)
        bits = max(1, (nodes - 1).bit_length())

        def run(key, rows):
            out = merged(rows, capacity)
            out.insert(0, "pnode", key[0])
            return out

        ranges = stored(
            classes.select((F.col("node") / fan).cast("long").alias("pnode"), F.col("node").alias("child"), "size", "n")
            .groupBy("pnode")
            .applyInPandas(run, "pnode long, child long, size long, lo long, hi long, psize long, plo long, poff long"),
            "ranges",
        )
        # Only pieces of bins that are still open meet the ranges; the others are done.
        r = ranges.select("pnode", F.col("child").alias("node"), "size", "lo", "hi", "psize", "plo", "poff")
        moved = open_.filter(~full).join(r, ["node", "size"]).filter((F.col("idx") >= F.col("lo")) & (F.col("idx") < F.col("hi")))
        open_ = stored(
            moved.select(
                "doc_id", "piece", "start", "length", "ids_crc32", F.col("pnode").alias("node"), F.col("psize").alias("size"),
                (F.col("plo") + F.col("idx") - F.col("lo")).alias("idx"), (F.col("offset") + F.col("poff")).alias("offset"),
            ),
            "moved",
        )
        done = done.union(placed(open_.filter(full | F.lit(nodes == 1))))
        classes = (
            ranges.select(F.col("pnode").alias("node"), F.col("psize").alias("size"), (F.col("plo") + F.col("hi") - F.col("lo")).alias("n"))
            .filter(~full)
            .groupBy("node", "size")
            .agg(F.max("n").alias("n"))
        )
    return done


def op5(spark, sf_dir):
    import public_tokenizers

    from .common import table

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
