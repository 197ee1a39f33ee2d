"""Connected components by alternating large-star and small-star rounds, without any driver-side graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _least(both: DataFrame) -> DataFrame:
    # A table of its own, so that a hub's rows can be split among tasks when it is joined.
    return stored(both.groupBy("u").agg(F.min("v").alias("m")), "least")


def components(edges: DataFrame) -> DataFrame:
    """edges: u and v, long. Returns node and root, the least node reachable, for each node with an edge."""
    e = stored(edges.select("u", "v").filter("u <> v").distinct(), "edges")
    was = _state(e)
    while was[0]:
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = (
            both.join(_least(both), "u")
            .filter("v > u")
            .select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
            .distinct()
        )
        large = stored(large, "large-star")
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        joined = down.join(_least(down), "u")
        e = stored(
            joined.filter("v <> m")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(joined.select("u", F.col("m").alias("v")))
            .distinct(),
            "small-star",
        )
        now = _state(e)
        if now == was:
            break
        was = now
    out = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return out.union(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
