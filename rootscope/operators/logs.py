"""Log templates and novelty."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.logs import WILDCARD, severity_of_text, signature
from ..tables import together


@dataclass
class Template:
    id: int
    words: list[str]
    count: int
    first_seen: int


class _Leaf:
    """The templates of a leaf, oldest first, and their words' numbers, a column a template, so that a line meets them all at once."""

    def __init__(self, length: int):
        self.members: list[int] = []
        self.words = np.zeros((length, 4), np.int32)
        self.stars = np.zeros(4, np.int32)  # wildcards of each template
        self.count = np.uint8 if length < 256 else np.int32

    def add(self, template: int, numbers: np.ndarray) -> None:
        n = len(self.members)
        if n == self.words.shape[1]:
            self.words, self.stars = (np.concatenate([x, np.zeros_like(x)], axis=-1) for x in (self.words, self.stars))
        self.members.append(template)
        self.put(n, numbers)

    def put(self, at: int, numbers) -> None:
        self.words[:, at] = numbers
        self.stars[at] = (self.words[:, at] == 0).sum()

    def remove(self, template: int) -> None:
        at, n = self.members.index(template), len(self.members)
        for x in (self.words, self.stars):
            x[..., at : n - 1] = x[..., at + 1 : n]
        self.members.pop(at)

    def nearest(self, numbers: np.ndarray) -> tuple[int, int, int]:
        """Place of the template that shares most words, then has most wildcards elsewhere, then is oldest; the two counts."""
        n = len(self.members)
        equal = (self.words[:, :n] == numbers[:, None]).view(np.uint8)
        same = equal.sum(0, dtype=self.count).astype(np.int32)
        loose = self.stars[:n] - equal[numbers == 0].sum(0, dtype=self.count)
        at = int((same * (len(numbers) + 1) + loose).argmax())
        return at, int(same[at]), int(loose[at])


@dataclass
class _Node:
    children: dict[str, _Node] = field(default_factory=dict)
    leaf: _Leaf | None = None


class Miner:
    """Online template mining by a tree over line length and first words; a leaf's best template takes a line or a new one is made."""

    def __init__(self, depth: int = 4, similarity: float = 0.4, max_children: int = 100, max_templates: int = 5000):
        self.prefix, self.least, self.most_children, self.most = max(3, depth) - 2, similarity, max_children, max_templates
        self.roots: dict[int, _Node] = {}
        self.templates: OrderedDict[int, Template] = OrderedDict()  # least recently used first
        self.homes: dict[int, _Leaf] = {}
        self.made = self.evicted = 0
        self.numbers: dict[str, int] = {WILDCARD: 0}  # of words that stand in templates
        self.most_numbers = 1 << 18

    def _leaf(self, words: list[str]) -> _Leaf:
        node = self.roots.setdefault(len(words), _Node())
        for w in words[: self.prefix]:
            if w not in node.children and len(node.children) >= self.most_children:
                w = WILDCARD
            node = node.children.setdefault(w, _Node())
        if node.leaf is None:
            node.leaf = _Leaf(len(words))
        return node.leaf

    def _numbered(self, words: list[str]) -> np.ndarray:
        """Numbers of a template's words. Those of words that are in no template any more go when there are many."""
        if len(self.numbers) > self.most_numbers:
            self.numbers = {WILDCARD: 0}
            for t in self.templates.values():
                for w in t.words:
                    self.numbers.setdefault(w, len(self.numbers))
            self.most_numbers = max(self.most_numbers, 2 * len(self.numbers))
            for leaf in {id(x): x for x in self.homes.values()}.values():
                for i, m in enumerate(leaf.members):
                    leaf.put(i, [self.numbers[w] for w in self.templates[m].words])
        return np.array([self.numbers.setdefault(w, len(self.numbers)) for w in words], np.int32)

    def add(self, words: list[str], ts: int) -> Template:
        """words: masked tokens of a line."""
        leaf, n = self._leaf(words), len(words)
        if leaf.members:
            get = self.numbers.get
            at, same, loose = leaf.nearest(np.array([get(w, -1) for w in words], np.int32))
            if (same / n if n else 1.0) >= self.least:
                best = self.templates[leaf.members[at]]
                if same + loose < n:
                    best.words = [a if a == b else WILDCARD for a, b in zip(best.words, words)]
                    leaf.put(at, [self.numbers[w] for w in best.words])
                best.count += 1
                self.templates.move_to_end(best.id)
                return best
        numbers = self._numbered(words)
        t = self.templates[self.made] = Template(self.made, list(words), 1, ts)
        leaf.add(t.id, numbers)
        self.homes[t.id] = leaf
        self.made += 1
        if len(self.templates) > self.most:
            old, _ = self.templates.popitem(last=False)
            self.homes.pop(old).remove(old)
            self.evicted += 1
        return t


MINED = "service string, ts_us long, body string, template_id long, template string, first_seen long"


def mined(lines: DataFrame, **options) -> DataFrame:
    """lines: service, ts_us, body. Each line's template as it stood then, mined by service in the order of time.

    The order decides, so a service's lines fold in one task; sorted Arrow batches pass through it, and its state is bounded.
    """
    from ..functions.logs import masked

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, miner = None, None
        for b in batches:
            rows = []
            for service, ts, body, words in zip(*(b.column(c).to_pylist() for c in ("service", "ts_us", "body", "words"))):
                if miner is None or service != of:
                    of, miner = service, Miner(**options)
                t = miner.add(words or [], ts)
                rows.append((service, ts, body, t.id, " ".join(t.words), t.first_seen))
            kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            columns = [pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * 6, kinds)]
            yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in MINED.split(", ")])

    rows = lines.select("service", "ts_us", "body", masked(F.col("body")).alias("words"))
    return together(rows, "service").sortWithinPartitions("service", "ts_us", "body").mapInArrow(run, MINED)


def catalogue(mined_: DataFrame) -> DataFrame:
    """service, template_id: text at last, lines, first seen."""
    return mined_.groupBy("service", "template_id").agg(
        F.max_by("template", "ts_us").alias("template"), F.count("*").alias("count"), F.min("first_seen").alias("first_seen")
    )


def with_severity(lines: DataFrame) -> DataFrame:
    return lines.withColumn("severity", F.coalesce("severity", severity_of_text(F.col("body"))) if "severity" in lines.columns else severity_of_text(F.col("body")))


def with_novelty(lines: DataFrame, after_us: int, inclusive: bool = False) -> DataFrame:
    """novel: the line's signature was first seen after a time (in streams, at or after it)."""
    t = lines.withColumn("template", signature(F.col("body")))
    first = F.min("ts_us").over(Window.partitionBy("service", "template"))
    return t.withColumn("first_seen", first).withColumn("novel", F.col("first_seen") >= after_us if inclusive else F.col("first_seen") > after_us)


def with_streaming_novelty(lines: DataFrame, started_us: int, warmup_us: int, horizon_us: int) -> DataFrame:
    """novel: the line's signature was first seen within the horizon before it, and not during the warm-up."""
    t = lines.withColumn("template", signature(F.col("body")))
    first = F.min("ts_us").over(Window.partitionBy("service", "template"))
    since = F.greatest(F.lit(started_us + warmup_us).cast("long"), F.col("ts_us") - horizon_us)
    return t.withColumn("first_seen", first).withColumn("novel", F.col("first_seen") >= since)
