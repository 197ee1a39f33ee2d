"""Window summaries as fact tables: partial aggregates that merge in any order, and the series they give."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import window_of
from . import sketch

GRAPH_TTL_WINDOWS = 360


def service_counts(visits: DataFrame, origins: DataFrame, resolution: int) -> DataFrame:
    """win, service: requests, errors, roots, error_origins. Visits count in the window of their end."""
    v = visits.withColumn("win", window_of(F.col("end_ns"), resolution))
    a = v.groupBy("win", "service").agg(
        F.count("*").alias("requests"), F.count_if("error").alias("errors"), F.count_if("root").alias("roots"), F.lit(0).cast("long").alias("error_origins")
    )
    o = origins.groupBy(window_of(F.col("end_ns"), resolution).alias("win"), "service").agg(F.count("*").alias("error_origins"))
    zero = F.lit(0).cast("long")
    b = o.select("win", "service", zero.alias("requests"), zero.alias("errors"), zero.alias("roots"), "error_origins")
    return merge_counts(a.unionByName(b), ["win", "service"])


def merge_counts(df: DataFrame, keys: list[str]) -> DataFrame:
    """Partial summaries of the same keys as one; booleans by or."""
    kinds = dict(df.dtypes)
    return df.groupBy(*keys).agg(
        *((F.bool_or(c) if kinds[c] == "boolean" else F.sum(c)).alias(c) for c in df.columns if c not in keys)
    )


def edge_counts(edges: DataFrame, resolution: int) -> DataFrame:
    return edges.groupBy(window_of(F.col("end_ns"), resolution).alias("win"), "caller", "callee").agg(
        F.count("*").alias("calls"), F.count_if("error").alias("errors"), F.bool_or("virtual_callee").alias("any_virtual")
    )


def edge_catalogue(edge_windows: DataFrame, last: Column | None = None) -> DataFrame:
    """Total calls and last window of each edge, but for those not seen for long."""
    out = edge_windows.groupBy("caller", "callee").agg(F.sum("calls").alias("calls"), F.max("win").alias("last_window"))
    newest = edge_windows.agg(F.max("win").alias("__now"))
    return out.crossJoin(F.broadcast(newest)).filter(F.col("__now") - F.col("last_window") <= GRAPH_TTL_WINDOWS).drop("__now")  # one row


def entry_points(service_windows: DataFrame, configured: list[str] | None = None) -> DataFrame:
    """Services that traces start in, but for those not seen for long; the configured ones instead, if there are any."""
    if configured:
        return service_windows.filter(F.col("service").isin(configured)).groupBy("service").agg(F.max("win").alias("last_window"))
    seen = service_windows.filter("roots > 0").groupBy("service").agg(F.max("win").alias("last_window"))
    newest = service_windows.agg(F.max("win").alias("__now"))
    return seen.crossJoin(F.broadcast(newest)).filter(F.col("__now") - F.col("last_window") <= GRAPH_TTL_WINDOWS).drop("__now")  # one row


def calendar(df: DataFrame, keys: list[str], fill: dict[str, float] | None = None) -> DataFrame:
    """Every window from the first to the last for every key, filled or null where there was none."""
    ends = df.agg(F.min("win").alias("a"), F.max("win").alias("b"))
    grid = df.select(*keys).distinct().crossJoin(F.broadcast(ends)).select(*keys, F.explode(F.sequence("a", "b")).alias("win"))  # one row
    out = grid.join(df, [*keys, "win"], "left")
    return out.fillna(fill) if fill else out


def metric_windows(points: DataFrame, resolution: int) -> DataFrame:
    """points: service, name, stream, ts, value, agg (level, rate or stream_rate). Sum, count, least, most, streams and the value.

    Levels are averaged, rates summed over the window's seconds, stream rates averaged times their streams.
    """
    p = points.filter(F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") != float("inf")))
    seconds = resolution / 1e6
    out = p.groupBy(window_of(F.col("ts_us"), resolution).alias("win"), "service", "name", "agg").agg(
        F.sum("value").alias("total"), F.count("*").alias("n"), F.min("value").alias("least"), F.max("value").alias("most"),
        F.count_distinct("stream").alias("streams"),
    )
    mean = F.col("total") / F.col("n")
    value = F.when(F.col("agg") == "level", mean).when(F.col("agg") == "rate", F.col("total") / seconds).otherwise(mean * F.col("streams"))
    return out.withColumn("value", value)


def log_windows(lines: DataFrame, resolution: int) -> DataFrame:
    """lines: service, ts_us, severity, novel."""
    return lines.groupBy(window_of(F.col("ts_us"), resolution).alias("win"), "service").agg(
        F.count("*").alias("lines"), F.count_if(F.col("severity") == "error").alias("errors"), F.count_if("novel").alias("novel")
    )


def _long(df: DataFrame, owner: str, columns: dict[str, tuple[str, str, Column]]) -> DataFrame:
    cells = F.array(
        *(F.struct(F.lit(n).alias("name"), F.lit(c).alias("category"), F.lit(f).alias("fill"), v.cast("double").alias("value")) for n, (c, f, v) in columns.items())
    )
    return df.select("win", F.col(owner).alias("service"), F.inline(cells))


def trace_series(visits: DataFrame, edges: DataFrame, origins: DataFrame, resolution: int) -> DataFrame:
    """Series of services and of calls into them: win, service, name, category, fill, value. Latencies are in ms."""
    seconds = resolution / 1e9
    counts = service_counts(visits, origins, resolution)
    v = visits.withColumn("win", window_of(F.col("end_ns"), resolution))
    took = sketch.quantiles(sketch.add(v, ["win", "service"], "duration_ns"), ["win", "service"], {"p50": 0.5, "p95": 0.95})
    local = sketch.quantiles(sketch.add(v, ["win", "service"], "local_ns"), ["win", "service"], {"l95": 0.95})
    wide = counts.join(took.select("win", "service", "p50", "p95"), ["win", "service"], "left").join(local.select("win", "service", "l95"), ["win", "service"], "left")
    has = F.col("requests") > 0
    own = _long(wide, "service", {
        "trace_requests": ("traffic", "zero", F.col("requests") / seconds),
        "trace_error_rate": ("errors", "missing", F.when(has, F.col("errors") / F.col("requests"))),
        "trace_latency_p50": ("latency", "missing", F.when(has, F.col("p50") / 1e6)),
        "trace_latency_p95": ("latency", "missing", F.when(has, F.col("p95") / 1e6)),
        "trace_local_p95": ("self_time", "missing", F.when(has, F.col("l95") / 1e6)),
        "trace_error_origins": ("error_origin", "zero", F.col("error_origins")),
    })
    return own.unionByName(inbound_series(edges, resolution))


def inbound_series(edges: DataFrame, resolution: int) -> DataFrame:
    e = edges.withColumn("win", window_of(F.col("end_ns"), resolution))
    counts = e.groupBy("win", "callee").agg(F.count("*").alias("calls"), F.count_if("error").alias("errors"))
    took = sketch.quantiles(sketch.add(e, ["win", "callee"], "duration_ns"), ["win", "callee"], {"p95": 0.95})
    wide = counts.join(took.select("win", "callee", "p95"), ["win", "callee"])
    return _long(wide, "callee", {
        "inbound_requests": ("traffic", "zero", F.col("calls") / (resolution / 1e9)),
        "inbound_error_rate": ("errors", "missing", F.col("errors") / F.col("calls")),
        "inbound_latency_p95": ("latency", "missing", F.col("p95") / 1e6),
    })


def log_series(log_windows_: DataFrame, resolution: int) -> DataFrame:
    s = resolution / 1e6
    return _long(log_windows_, "service", {
        "log_lines": ("traffic", "zero", F.col("lines") / s), "log_errors": ("logs", "zero", F.col("errors") / s),
        "log_novel_lines": ("logs", "zero", F.col("novel") / s),
    })


def retained(series: DataFrame, keep: int) -> DataFrame:
    """The last `keep` windows, and of each series what came since it was created."""
    last = series.agg((F.max("win") - keep).alias("__from"))
    return series.crossJoin(F.broadcast(last)).filter(F.col("win") > F.col("__from")).drop("__from")  # one row


def created(series: DataFrame, most: int) -> DataFrame:
    """The first window of each series; beyond `most` series, the earliest ones."""
    out = series.groupBy("service", "name").agg(F.min("win").alias("created"))
    return out.orderBy("created", "service", "name").limit(most)


def merge_all(parts: list[DataFrame], keys: list[str]) -> DataFrame:
    return merge_counts(reduce(DataFrame.unionByName, parts), keys)


def collected(messages: DataFrame, keys: list[str]) -> DataFrame:
    """Summaries sent by edges: each (edge, epoch, seq) counts once, then equal windows merge.

    messages: edge, epoch, seq, win, keys and counters; repeats of a message are equal.
    """
    once = messages.dropDuplicates(["edge", "epoch", "seq"])
    return merge_counts(once.drop("edge", "epoch", "seq"), ["win", *keys])


def gaps(messages: DataFrame) -> DataFrame:
    """Sequence numbers that each edge's epoch lacks between its first and last, and repeats."""
    return messages.groupBy("edge", "epoch").agg(
        (F.max("seq") - F.min("seq") + 1 - F.count_distinct("seq")).alias("missing"), (F.count("*") - F.count_distinct("seq")).alias("repeated")
    )


def latest(df: DataFrame, key: str, order: str) -> DataFrame:
    """The last written row of each key."""
    return df.withColumn("__rn", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).filter("__rn = 1").drop("__rn")


def service_view(observed: DataFrame) -> DataFrame:
    """observed: service, name, anomalous. How many series each service has, and which of them are anomalous."""
    series = observed.groupBy("service", "name").agg(F.bool_or("anomalous").alias("anomalous"))
    names = F.array_sort(F.collect_list(F.when(F.col("anomalous"), F.col("name"))))
    return series.groupBy("service").agg(F.count("*").alias("series"), names.alias("anomalous"))


def pilot_traffic(spans: DataFrame, seconds: float = 60.0) -> DataFrame:
    """Calls a second to each peer."""
    return spans.filter("peer <> ''").groupBy("peer").agg((F.count("*") / seconds).alias("per_s"))
