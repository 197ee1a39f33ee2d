"""Traces: parent links, clock skew, service visits with local time, call edges, error origins.

The skew offsets and entry spans pass from parents to children, to any depth, and visits, calls and origins follow
from them. One shuffle by trace and one pass over sorted Arrow batches give them all; a task holds one trace at a time.
Links, orphans and unions of intervals are joins and windows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..tables import together

SPAN = ["trace_id", "span_id", "parent_id", "service", "operation", "kind", "start_ns", "end_ns", "status", "peer"]


def deduplicated(spans: DataFrame, order: list[str] = ("start_ns", "service")) -> DataFrame:
    """The first span of each id in its trace; every column takes part in the order, so that ties cannot differ."""
    by = [*order, *(c for c in spans.columns if c not in order)]
    w = Window.partitionBy("trace_id", "span_id").orderBy(*by)
    return spans.withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").drop("__rn")


def linked(spans: DataFrame) -> DataFrame:
    """With its parent's service, or null for roots; orphan: the parent is named but missing, or itself."""
    p = spans.select(F.col("trace_id").alias("__pt"), F.col("span_id").alias("__pid"), F.col("service").alias("parent_service"))
    on = (F.col("trace_id") == F.col("__pt")) & (F.col("parent_id") == F.col("__pid")) & (F.col("parent_id") != 0) & (F.col("__pid") != F.col("span_id"))
    out = spans.join(p, on, "left").drop("__pt", "__pid")
    return out.withColumn("orphan", (F.col("parent_id") != 0) & F.col("parent_service").isNull())


def orphans(spans: DataFrame) -> DataFrame:
    p = spans.select(F.col("trace_id").alias("__pt"), F.col("span_id").alias("__pid"))
    on = (F.col("trace_id") == F.col("__pt")) & (F.col("parent_id") == F.col("__pid")) & (F.col("span_id") != F.col("__pid"))
    return spans.filter("parent_id <> 0").join(p, on, "left_anti")


def walk(spans: list[tuple]) -> list[tuple[int, int | None, bool, bool]]:
    """spans of one trace: id, parent, service, start, end. Of each: offset, entry span, root, and whether it was moved.

    The entry is None for spans that no root reaches.
    """
    at = {s[0]: i for i, s in enumerate(spans)}
    children: dict[int, list[int]] = {}
    out: list = [None] * len(spans)
    stack = []
    for i, (sid, parent, *_) in enumerate(spans):
        p = at.get(parent) if parent else None
        if p is None or p == i:
            out[i] = (0, sid, True, False)
            stack.append(i)
        else:
            children.setdefault(p, []).append(i)
    while stack:
        u = stack.pop()
        offset, entry, _, _ = out[u]
        _, _, service, start, end = spans[u]
        start, end = start + offset, end + offset
        length = max(0, spans[u][4] - spans[u][3])
        for c in children.get(u, ()):
            if out[c] is not None:
                continue
            sid, _, own, a, b = spans[c]
            took, extra = max(0, b - a), 0
            if own != service and (a + offset < start or b + offset > end) and took <= length:
                extra = start + (length - took) // 2 - (a + offset)
            out[c] = (offset + extra, entry if own == service else sid, False, extra != 0 or _moved(own, service, a + offset, b + offset, start, end, took, length))
            stack.append(c)
    return [x if x is not None else (0, None, False, False) for x in out]


def _moved(own, service, a, b, start, end, took, length) -> bool:
    return own != service and (a < start or b > end) and took <= length


_ORDER = ["trace_id", "span_id", "start_ns", "service", "parent_id", "operation", "kind", "end_ns", "status", "peer"]


def _by_trace(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple]]]:
    """Each trace and its spans (columns of _ORDER but the trace), of rows sorted by _ORDER; the first of each span id."""
    trace, held = None, []
    for b in batches:
        for t, *span in zip(*(b.column(n).to_pylist() for n in _ORDER)):
            if t != trace:
                if held:
                    yield trace, held
                trace, held = t, []
            if not held or held[-1][0] != span[0]:
                held.append(span)
    if held:
        yield trace, held


def _traced(spans: DataFrame) -> DataFrame:
    return together(spans.select(*_ORDER), "trace_id").sortWithinPartitions(*_ORDER)


def _flushed(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    out = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [()] * len(schema), schema)], schema=schema)
    rows.clear()
    return out


_OFFSETS = pa.schema([("trace_id", pa.int64()), ("span_id", pa.int64()), ("offset_ns", pa.int64()), ("entry_id", pa.int64()), ("root", pa.bool_()), ("moved", pa.bool_())])


def offsets(spans: DataFrame) -> DataFrame:
    """Of each deduplicated span: offset_ns, entry_id, root and whether it was moved."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for trace, held in _by_trace(batches):
            found = walk([(s[0], s[3], s[2], s[1], s[6]) for s in held])
            rows += [(trace, s[0], *x) for s, x in zip(held, found)]
            if len(rows) > 20_000:
                yield _flushed(rows, _OFFSETS)
        yield _flushed(rows, _OFFSETS)

    return _traced(spans).mapInArrow(run, "trace_id long, span_id long, offset_ns long, entry_id long, root boolean, moved boolean")


def _union(intervals: list[tuple[int, int]]) -> int:
    total, reached = 0, None
    for a, b in sorted(intervals):
        if b > a:
            total += max(0, b - (a if reached is None else max(a, reached)))
            reached = b if reached is None else max(reached, b)
    return total


def parts_of(held: list[tuple]) -> list[tuple]:
    """Visits, calls and error origins of one trace's deduplicated spans, as rows of PARTS but the trace."""
    outward = ("client", "producer")
    place = walk([(s[0], s[3], s[2], s[1], s[6]) for s in held])
    at = {s[0]: i for i, s in enumerate(held)}
    below: dict[int, list[int]] = {}  # children that are named so, by their parent's id
    for i, s in enumerate(held):
        if s[3] and s[3] != s[0]:
            below.setdefault(s[3], []).append(i)
    moved = [(s[1] + x[0], s[6] + x[0]) for s, x in zip(held, place)]
    rows, waits = [], {}
    for i, (sid, _, service, _, operation, kind, _, status, peer) in enumerate(held):
        (start, end), (_, entry, root, _) = moved[i], place[i]
        near = below.get(sid, ())
        if status == "error" and not any(held[c][7] == "error" for c in near):
            answered = any(held[c][2] != service for c in near)
            blamed = peer if kind in outward and peer and not answered else service
            rows.append(("origin", sid, None, blamed, None, None, end, None, None, None, None, None))
        if entry is None:
            continue
        cross = [c for c in near if not place[c][2] and place[c][1] is not None and held[c][2] != service]
        if kind in outward:
            callee = held[min(cross, key=lambda c: held[c][0])][2] if cross else None
            failed = status == "error" or any(held[c][7] == "error" for c in cross)
            calls = [(callee or peer, start, end, failed, callee is None)] if callee or peer else []
        else:
            calls = [(held[c][2], *moved[c], held[c][7] == "error", False) for c in cross]
        lo, hi = moved[at[entry]]
        for callee, a, b, failed, virtual in calls:
            rows.append(("call", sid, entry, service, callee, a, b, max(0, b - a), None, failed, None, virtual))
            waits.setdefault(entry, []).append((max(a, lo), min(b, hi)))
    for i, (s, (_, entry, root, _)) in enumerate(zip(held, place)):
        if entry == s[0]:
            start, end = moved[i]
            took = max(0, end - start)
            local = max(0, took - _union(waits.get(entry, [])))
            rows.append(("visit", s[0], entry, s[2], s[4], start, end, took, local, s[7] == "error", root, None))
    return rows


PARTS = (
    "part string, trace_id long, span_id long, entry_id long, service string, other string, start_ns long, end_ns long, duration_ns long, "
    "local_ns long, error boolean, root boolean, virtual boolean"
)
_PARTS = pa.schema([(n, {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}[t]) for n, t in (x.split() for x in PARTS.split(", "))])


def assembled(spans: DataFrame) -> DataFrame:
    """Visits, calls and error origins of all traces, in one shuffle by trace and one pass; a task holds one trace at a time.

    Store it where more than one of visits(), calls() and error_origins() is wanted.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for trace, held in _by_trace(batches):
            rows += [(x[0], trace, *x[1:]) for x in parts_of(held)]
            if len(rows) > 20_000:
                yield _flushed(rows, _PARTS)
        yield _flushed(rows, _PARTS)

    return _traced(spans).mapInArrow(run, PARTS)


def calls(parts: DataFrame) -> DataFrame:
    """Each call that leaves a service: trace, entry span, caller, callee, the caller's wait, error, virtual."""
    return parts.filter("part = 'call'").select(
        "trace_id", "entry_id", F.col("service").alias("caller"), F.col("other").alias("callee"), "start_ns", "end_ns", "error",
        F.col("virtual").alias("virtual_callee"), "duration_ns",
    )


def visits(parts: DataFrame) -> DataFrame:
    """Each entry into a service, with the time it was not waiting for others."""
    return parts.filter("part = 'visit'").select(
        "trace_id", "span_id", "service", F.col("other").alias("operation"), "end_ns", "duration_ns", "local_ns", "error", "root"
    )


def error_origins(parts: DataFrame) -> DataFrame:
    """Failing spans without a failing child; an unanswered call blames its peer."""
    return parts.filter("part = 'origin'").select("trace_id", "span_id", "service", "end_ns")


def union_length(df: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """Total length of the union of each group's intervals."""
    before = Window.partitionBy(*keys).orderBy(start, end).rowsBetween(Window.unboundedPreceding, -1)
    reached = F.coalesce(F.max(end).over(before), F.col(start))
    return (
        df.filter(F.col(end) > F.col(start))
        .withColumn("__new", F.greatest(F.lit(0).cast("long"), F.col(end) - F.greatest(F.col(start), reached)))
        .groupBy(*keys)
        .agg(F.sum("__new").alias("length"))
    )
