"""Relative-error quantile sketches as tall tables of bucket counts, so that merging is a sum."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ALPHA = 0.01


def gamma(alpha: float = ALPHA) -> float:
    return (1 + alpha) / (1 - alpha)


def bucket(value: Column, alpha: float = ALPHA) -> Column:
    """Null for the zero bucket, which takes what is below one."""
    return F.when(value >= 1, F.ceil(F.ln(value) * (1 / math.log(gamma(alpha)))).cast("long"))


def add(df: DataFrame, keys: list[str], value: str, alpha: float = ALPHA) -> DataFrame:
    """Keys, bucket, n, and least, most and total of the bucket. Non-finite values are ignored, negative ones zero."""
    v = F.greatest(F.col(value), F.lit(0.0))
    df = df.filter(F.col(value).isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf"))).select(*keys, v.alias("__v"))
    return df.groupBy(*keys, bucket(F.col("__v"), alpha).alias("bucket")).agg(
        F.count("*").alias("n"), F.min("__v").alias("least"), F.max("__v").alias("most"), F.sum("__v").alias("total")
    )


def merge(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    return remerge(a.unionByName(b), keys)


def remerge(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys, "bucket").agg(
        F.sum("n").alias("n"), F.min("least").alias("least"), F.max("most").alias("most"), F.sum("total").alias("total")
    )


def collapse(df: DataFrame, keys: list[str], bins: int) -> DataFrame:
    """At most `bins` buckets of each sketch: the lowest become one."""
    floor = F.max("bucket").over(Window.partitionBy(*keys)) - (bins - 1)
    return remerge(df.withColumn("bucket", F.when(F.col("bucket").isNotNull(), F.greatest("bucket", floor))), keys)


def quantiles(df: DataFrame, keys: list[str], qs: dict[str, float], alpha: float = ALPHA) -> DataFrame:
    """A column for each of qs: the value of the bucket that holds rank floor(q (n - 1)), within least and most."""
    by = Window.partitionBy(*keys).orderBy(F.col("bucket").asc_nulls_first())
    whole = Window.partitionBy(*keys)
    df = df.withColumns(
        {
            "__cum": F.sum("n").over(by.rowsBetween(Window.unboundedPreceding, 0)), "__n": F.sum("n").over(whole),
            "__lo": F.min("least").over(whole), "__hi": F.max("most").over(whole),
        }
    )
    g = gamma(alpha)
    value = F.when(F.col("bucket").isNull(), F.greatest(F.lit(0.0), F.col("__lo"))).otherwise(
        F.least(F.greatest(2 * F.pow(F.lit(g), F.col("bucket")) / (g + 1), F.col("__lo")), F.col("__hi"))
    )
    aggs = []
    for name, q in qs.items():
        if q <= 0:
            aggs.append(F.min("__lo").alias(name))
        elif q >= 1:
            aggs.append(F.max("__hi").alias(name))
        else:
            aggs.append(F.min(F.when(F.col("__cum") > F.floor(q * (F.col("__n") - 1)), value)).alias(name))
    return df.groupBy(*keys).agg(*aggs, F.sum("n").alias("count"), F.sum("total").alias("sum"), F.min("least").alias("least"), F.max("most").alias("most"))
