"""Windows of time, number formats, coercions and tail probabilities."""

from __future__ import annotations

import math
from statistics import NormalDist

import pandas as pd
from pyspark.sql import Column, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def window_of(ts: Column, resolution: int) -> Column:
    """Index of the window that holds ts, also before the epoch."""
    r = F.lit(resolution).cast("long")
    return ((ts - F.pmod(ts, r)) / r).cast("long")


def window_start(win: Column, resolution: int) -> Column:
    return win * F.lit(resolution).cast("long")


def windows_in(span: int, resolution: int) -> int:
    return max(1, -(-span // resolution))


def rfc3339_seconds(text: Column) -> Column:
    return F.unix_micros(F.try_to_timestamp(text)) / 1e6


def long_any(x: Column) -> Column:
    """A 64-bit number given as JSON number or string."""
    return x.try_cast("long")


def double_any(x: Column) -> Column:
    return F.nanvl(x.try_cast("double"), F.lit(None).cast("double"))


def significant(x: Column) -> Column:
    """Three significant digits."""
    decimals = F.greatest(F.lit(0), F.least(F.lit(8), 2 - F.floor(F.log10(F.abs(x))))).cast("int")
    text = F.format_string("%.8f", x)
    for d in range(8):
        text = F.when(decimals == d, F.format_string(f"%.{d}f", x)).otherwise(text)
    return F.when(x.isNull() | F.isnan(x), "n/a").when(x == 0, "0").otherwise(text)


def onset_phrase(onset: Column) -> Column:
    return (
        F.when(onset.isNull(), "")
        .when(F.abs(onset) < 0.5, ", from the begin of the incident on")
        .when(onset < 0, F.format_string(", from %.0f s before the incident on", -onset))
        .otherwise(F.format_string(", from %.0f s into the incident on", onset))
    )


def softmax(score: Column, *group: str) -> Column:
    w = Window.partitionBy(*group)
    top = F.max(score).over(w)
    return F.exp(score - top) / F.sum(F.exp(score - top)).over(w)


def normal_sf(x: float) -> float:
    return 0.5 * math.erfc(x / math.sqrt(2))


def normal_cdf(x: float) -> float:
    return normal_sf(-x)


def normal_quantile(p: float) -> float:
    return NormalDist().inv_cdf(p) if 0 < p < 1 else math.copysign(math.inf, p - 0.5)


@F.pandas_udf(T.DoubleType())
def normal_sf_udf(x: pd.Series) -> pd.Series:
    """P(Z > x); Spark has no error function."""
    return x.map(lambda v: None if pd.isna(v) else normal_sf(v))
