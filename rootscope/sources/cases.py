"""Benchmark cases: wide metric frames, traces and logs on one grid of series."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import rfc3339_seconds


def wide_metrics(frame: DataFrame, time: str = "time") -> DataFrame:
    """time and <service>_<metric> columns to service, name, time_s, value: the last row of each time; memory in MB."""
    w = Window.partitionBy(time).orderBy(F.desc("__order"))
    once = frame.withColumn("__order", F.monotonically_increasing_id()).withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").drop("__rn", "__order")
    columns = [c for c in frame.columns if c != time]
    long = once.unpivot([time], columns, "column", "value")
    name = F.substring_index("column", "_", -1)
    value = F.when(name == "mem", F.col("value") / 1e6).otherwise(F.col("value"))
    return long.select(F.expr("substring(column, 1, length(column) - length(substring_index(column, '_', -1)) - 1)").alias("service"), name.alias("name"), F.col(time).cast("double").alias("time_s"), value.cast("double").alias("value"))


def aligned(parts: list[DataFrame], grid: DataFrame, aliases: dict[str, str] | None = None) -> DataFrame:
    """Series of several sources on one grid of times (time_s): services renamed by aliases, null where missing."""
    from functools import reduce

    every = reduce(DataFrame.unionByName, parts)
    if aliases:
        names = F.create_map(*(F.lit(x) for kv in aliases.items() for x in kv))
        every = every.withColumn("service", F.coalesce(F.try_element_at(names, F.col("service")), F.col("service")))
    return every.select("service", "name").distinct().join(grid.select("time_s").distinct(), how="cross").join(every, ["service", "name", "time_s"], "left")


def cases(index: DataFrame, datasets: list[str] | None = None, include_defective: bool = False) -> DataFrame:
    out = index if datasets is None else index.filter(F.col("dataset").isin(datasets))
    return out if include_defective or "defective" not in index.columns else out.filter(~F.coalesce("defective", F.lit(False)))


def firing(alerts: DataFrame, most: int = 20) -> DataFrame:
    """Firing alerts, at most `most`, with the time to analyse."""
    t = rfc3339_seconds(F.col("startsAt"))
    return alerts.filter(F.col("status") == "firing").select("fingerprint", t.alias("t0_s")).orderBy("t0_s", "fingerprint").limit(most)
