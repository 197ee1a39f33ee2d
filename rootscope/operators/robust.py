"""Robust summaries, online moments and sliding statistics of series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values.
MAD_TO_SIGMA, IQR_TO_SIGMA = 1.4826, 0.7413


def finite(value: Column) -> Column:
    """Missing values are null."""
    return F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)


def sigma(mad: Column, iqr: Column) -> Column:
    return F.greatest(MAD_TO_SIGMA * mad, IQR_TO_SIGMA * iqr)


def summary(df: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """n, median, mad, iqr, mean, sd, least, most of each group."""
    v = finite(F.col(value))
    df = df.select(*keys, v.alias("__v")).filter("__v is not null")
    base = df.groupBy(*keys).agg(
        F.count("*").alias("n"), F.percentile("__v", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("__q"),
        F.avg("__v").alias("mean"), F.stddev_samp("__v").alias("sd"), F.min("__v").alias("least"), F.max("__v").alias("most"),
    )
    base = base.withColumns({"median": F.col("__q")[1], "iqr": F.col("__q")[2] - F.col("__q")[0]}).drop("__q")
    mad = df.join(base.select(*keys, "median"), keys).groupBy(*keys).agg(F.percentile(F.abs(F.col("__v") - F.col("median")), 0.5).alias("mad"))
    return base.join(mad, keys).withColumn("sigma", sigma(F.col("mad"), F.col("iqr")))


def merged_moments(df: DataFrame, keys: list[str]) -> DataFrame:
    """Partial (n, mean, m2) rows of the same keys as one, whatever the order.

    Sums are of differences from a value near the means, the least of them, so that large means lose no digits.
    """
    near = df.groupBy(*keys).agg(F.min("mean").alias("__near"))
    d = df.join(near, keys).withColumn("__d", F.col("mean") - F.col("__near"))
    total = d.groupBy(*keys).agg(
        F.sum("n").alias("n"), F.min("__near").alias("__near"), (F.sum(F.col("n") * F.col("__d")) / F.sum("n")).alias("__d"),
        F.sum(F.col("m2") + F.col("n") * F.col("__d") * F.col("__d")).alias("__s"),
    )
    variance = (F.col("__s") - F.col("n") * F.col("__d") * F.col("__d")) / (F.col("n") - 1)
    return total.select(*keys, "n", (F.col("__near") + F.col("__d")).alias("mean"), variance.alias("variance"))


def moments(df: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    return df.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), (F.var_pop(value) * F.count(value)).alias("m2"))


def weighted_mean(df: DataFrame, keys: list[str], order: str, half_life: float, value: str = "value") -> DataFrame:
    """Exponentially weighted mean and variance after the last value; the first one initialises."""
    alpha = 1 - 0.5 ** (1 / half_life)
    values = F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda s: s[value])
    start = F.struct(F.lit(None).cast("double").alias("m"), F.lit(0.0).alias("v"))

    def step(a, x):
        d = x - a["m"]
        return F.struct(
            F.when(a["m"].isNull(), x).otherwise(a["m"] + alpha * d).alias("m"),
            F.when(a["m"].isNull(), F.lit(0.0)).otherwise((1 - alpha) * (a["v"] + alpha * d * d)).alias("v"),
        )

    out = df.filter(F.col(value).isNotNull()).groupBy(*keys).agg(F.aggregate(values, start, step).alias("__e"))
    return out.select(*keys, F.col("__e.m").alias("ewm_mean"), F.col("__e.v").alias("ewm_var"))


def frame(keys: list[str], order: str, points: int, ahead: int = -1):
    """The `points` values before the present one."""
    return Window.partitionBy(*keys).orderBy(order).rowsBetween(-points, ahead)


def sliding(df: DataFrame, keys: list[str], order: str, points: int, value: str = "value") -> DataFrame:
    """Median, MAD, IQR and sample sd of the last `points` values before each; null values take no place."""
    w = frame(keys, order, points)
    df = df.filter(F.col(value).isNotNull()).withColumn("__w", F.collect_list(value).over(w))
    at = lambda a, q: _quantile(a, q)
    df = df.withColumn("__s", F.array_sort("__w")).withColumn("median", at("__s", 0.5))
    df = df.withColumn("__d", F.expr("array_sort(transform(__w, x -> abs(x - median)))"))
    return df.withColumns(
        {
            "n": F.size("__w").cast("long"), "mad": at("__d", 0.5), "iqr": at("__s", 0.75) - at("__s", 0.25),
            "sd": F.stddev_samp(value).over(w),
        }
    ).drop("__s", "__d")


def _quantile(column: str, q: float) -> Column:
    """Linear interpolation in a sorted array."""
    at = f"{q} * (size({column}) - 1)"
    low = f"element_at({column}, cast(floor({at}) as int) + 1)"
    high = f"element_at({column}, cast(ceil({at}) as int) + 1)"
    return F.expr(f"CASE WHEN size({column}) > 0 THEN {low} + ({high} - {low}) * ({at} - floor({at})) END")


def conformal_p(window: str, value: str, direction: str) -> Column:
    """(1 + how many of the window are at least as bad) / (n + 1)."""
    up = F.expr(f"(1 + size(filter({window}, v -> v >= {value}))) / (1 + size({window}))")
    down = F.expr(f"(1 + size(filter({window}, v -> v <= {value}))) / (1 + size({window}))")
    d = F.col(direction)
    return F.when(d == "up", up).when(d == "down", down).otherwise(F.least(2 * F.least(up, down), F.lit(1.0)))


def cusum(df: DataFrame, keys: list[str], order: str, z: str, k: float, h: float) -> DataFrame:
    """Two-sided cumulative sums by their closed form: the running total less its least value so far."""
    run = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    df = df.filter(F.col(z).isNotNull())
    df = df.withColumns({"__u": F.sum(F.col(z) - k).over(run), "__l": F.sum(-F.col(z) - k).over(run), "__i": F.row_number().over(run)})
    df = df.withColumns(
        {f"cusum_{n}": F.col(c) - F.least(F.lit(0.0), F.min(c).over(run)) for n, c in (("up", "__u"), ("down", "__l"))}
    )
    zero = lambda c: F.coalesce(F.max(F.when(F.col(c) <= 1e-9, F.col("__i"))).over(run), F.lit(0))
    return df.withColumns(
        {
            "alarm_up": F.col("cusum_up") > h, "alarm_down": F.col("cusum_down") > h,
            "onset": F.when(
                (F.col("cusum_up") > h) & ((F.col("cusum_down") <= h) | (F.col("cusum_up") >= F.col("cusum_down"))), zero("cusum_up")
            ).when(F.col("cusum_down") > h, zero("cusum_down")).cast("long"),
        }
    ).drop("__u", "__l", "__i")


def change_point(df: DataFrame, keys: list[str], order: str, value: str = "value") -> DataFrame:
    """The split that most separates the two means, and the shift in units of the spread within."""
    run = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    v = F.col(value)
    df = df.withColumns(
        {
            "tau": F.row_number().over(Window.partitionBy(*keys).orderBy(order)) - 1,
            "n1": F.count(v).over(run), "s1": F.sum(v).over(run), "n": F.count(v).over(whole), "s": F.sum(v).over(whole),
            "var": F.var_pop(v).over(whole), "len": F.count(F.lit(1)).over(whole),
        }
    )
    df = df.withColumns({"n2": F.col("n") - F.col("n1")}).filter("tau >= 2 and tau < len - 1 and n1 >= 2 and n2 >= 2 and n >= 4")
    df = df.withColumns({"m1": F.col("s1") / F.col("n1"), "m2": (F.col("s") - F.col("s1")) / F.col("n2")})
    df = df.withColumn("between", F.col("n1") * F.col("n2") / F.col("n") * F.pow(F.col("m2") - F.col("m1"), 2))
    best = df.groupBy(*keys).agg(F.max(F.struct(F.round("between", 9).alias("b"), (-F.col("tau")).alias("t"), "between", "m1", "m2", "var", "n")).alias("x"))
    within = F.sqrt(F.greatest(F.col("x.var") - F.col("x.between") / F.col("x.n"), F.lit(1e-12)))
    return best.select(*keys, (-F.col("x.t")).cast("long").alias("tau"), ((F.col("x.m2") - F.col("x.m1")) / within).alias("shift"))
