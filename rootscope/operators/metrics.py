"""Metric points: kinds, counter increments and validity."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

NO_RECORDED_VALUE = 1


def valid(points: DataFrame) -> DataFrame:
    """With a time, a finite value, and not flagged as without one."""
    ok = (F.col("ts_us") > 0) & F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") != float("inf"))
    return points.filter(ok & (F.col("flags").bitwiseAND(NO_RECORDED_VALUE) == 0)) if "flags" in points.columns else points.filter(ok)


def kind_of(points: DataFrame) -> DataFrame:
    """otlp_type, monotonic and temporality to kind: gauge, delta or cumulative."""
    summed = F.when(~F.col("monotonic"), "gauge").when(F.col("temporality") == "delta", "delta").otherwise("cumulative")
    return points.withColumn("kind", F.when(F.col("otlp_type") == "gauge", "gauge").otherwise(summed))


def counter_rates(points: DataFrame) -> DataFrame:
    """Increment and elapsed time since the stream's previous point, and their rate.

    A counter restarts when its value falls or its start is new and later than the previous point: then the
    value itself is the increment, since its start if that lies between the two points, else since the
    previous one. Repeated times keep their first point; first points give nothing.
    """
    w = Window.partitionBy("stream", "service", "name").orderBy("ts_us")
    first = points.withColumn("__rn", F.row_number().over(Window.partitionBy("stream", "service", "name", "ts_us").orderBy("value"))).filter("__rn = 1")
    p = first.withColumns({"__pv": F.lag("value").over(w), "__pt": F.lag("ts_us").over(w), "__ps": F.lag("start_us").over(w)}).filter("__pt is not null")
    reset = (F.col("value") < F.col("__pv")) | ((F.col("start_us") != 0) & (F.col("start_us") != F.col("__ps")))
    since = F.when(reset & (F.col("start_us") > F.col("__pt")) & (F.col("start_us") < F.col("ts_us")), F.col("start_us")).otherwise(F.col("__pt"))
    delta = F.when(reset, F.col("value")).otherwise(F.col("value") - F.col("__pv"))
    out = p.withColumns({"delta": delta, "elapsed_us": F.col("ts_us") - since, "reset": reset})
    return out.withColumn("rate", F.col("delta") / (F.col("elapsed_us") / 1e6)).drop("__pv", "__pt", "__ps", "__rn")


def as_points(points: DataFrame) -> DataFrame:
    """Points with agg: gauges are levels, deltas rates, cumulative counters stream rates."""
    p = valid(points)
    level = p.filter("kind = 'gauge'").withColumn("agg", F.lit("level"))
    delta = p.filter("kind = 'delta'").withColumn("agg", F.lit("rate"))
    counters = counter_rates(p.filter("kind = 'cumulative'")).withColumns({"value": F.col("rate"), "agg": F.lit("stream_rate")})
    columns = ["service", "name", "stream", "ts_us", "value", "agg"]
    return level.select(columns).unionByName(delta.select(columns)).unionByName(counters.select(columns))


def shown_rates(points: DataFrame) -> DataFrame:
    """Rates of counters as a chart shows them: a point after a fall starts anew and has none."""
    w = Window.partitionBy("stream", "service").orderBy("ts_us")
    p = points.withColumns({"__pv": F.lag("value").over(w), "__pt": F.lag("ts_us").over(w)})
    ok = (F.col("value") >= F.col("__pv")) & (F.col("ts_us") > F.col("__pt"))
    return p.filter(ok).withColumn("rate", (F.col("value") - F.col("__pv")) / ((F.col("ts_us") - F.col("__pt")) / 1e6)).drop("__pv", "__pt")
