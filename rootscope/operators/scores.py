"""Series scores: how far each series departs from its reference once the incident has begun.

series: keys, value (null: missing), t_s (seconds from the incident's begin; below 0: reference), category, direction.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import ScoreConfig
from ..functions.signals import category, direction, harmful
from .robust import summary

TINY = 10 * 2.220446049250313e-16
KEYS = ["service", "name"]
DAY_S = 86_400


def split(series: DataFrame, incidents: DataFrame) -> DataFrame:
    """Rows of each incident's reference and abnormal periods: a range join by days, with any number of incidents.

    incidents: incident, t0_s, from_s, to_s (finite); series: time_s. Adds incident and t_s.
    """
    day = lambda c: F.floor(c / DAY_S)
    days = F.sequence(day(F.col("from_s")), day(F.col("to_s")))
    i = incidents.filter("from_s < to_s").withColumn("__day", F.explode(days))
    inside = (F.col("time_s") >= i["from_s"]) & (F.col("time_s") < i["to_s"])
    out = series.withColumn("__day", day(F.col("time_s"))).join(i, "__day").filter(inside)
    return out.withColumn("t_s", F.col("time_s") - F.col("t0_s")).drop("t0_s", "from_s", "to_s", "__day")


def classified(series: DataFrame) -> DataFrame:
    c = category(F.col("name"))
    return series.withColumns({"category": c, "direction": direction(c)})


def _onset(scored: DataFrame, keys: list[str], cfg: ScoreConfig) -> DataFrame:
    """First row of the first run of harmful rows; missing rows neither make nor break a run."""
    w = Window.partitionBy(*keys).orderBy("t_s")
    rows = scored.filter((F.col("t_s") >= -cfg.onset_lookback_s) & F.col("value").isNotNull())
    rows = rows.withColumn("__bad", F.col("harm") > cfg.threshold).withColumn("__island", F.sum((~F.col("__bad")).cast("int")).over(w))
    runs = rows.filter("__bad").groupBy(*keys, "__island").agg(F.count("*").alias("n"), F.min("t_s").alias("t"))
    return runs.filter(F.col("n") >= cfg.onset_persistence).groupBy(*keys).agg(F.min("t").alias("onset_s"))


def scores(series: DataFrame, scaling: str = "robust", cfg: ScoreConfig = ScoreConfig(), keys: list[str] = KEYS) -> DataFrame:
    """max, sustained, shift, onset_s, reference_median, scale, peak_value, peak_offset_s by series.

    scaling: robust (harmful direction, median and robust sigma), iqr or nsigma (signed; constant series are left out).
    """
    reference, abnormal = series.filter("t_s < 0"), series.filter("t_s >= 0")
    has = abnormal.groupBy(*keys).agg(
        (F.count("value") > 0).alias("__any"), ((F.count("value") == F.count("*")) & (F.min("value") == F.max("value"))).alias("__still"),
        F.percentile("value", 0.5).alias("__median"), F.count("value").alias("__finite"),
    )
    whole = reference.groupBy(*keys).agg(
        ((F.count("value") == F.count("*")) & (F.min("value") == F.max("value"))).alias("constant"), F.stddev_pop("value").alias("__sdp")
    )
    base = summary(reference, keys).join(whole, keys).join(has, keys).filter(F.col("__any") & (F.col("n") >= cfg.min_reference))
    if scaling == "robust":
        s = F.when(F.col("sigma") > 0, F.col("sigma")).otherwise(F.coalesce("sd", F.lit(0.0)))
        base = base.withColumns({"center": F.col("median"), "scale": F.greatest(s, cfg.rel_floor * F.abs("median"))})
    else:
        base = base.filter(~F.col("constant") & ~F.coalesce("__still", F.lit(False)))
        raw, center = (F.col("iqr"), F.col("median")) if scaling == "iqr" else (F.col("__sdp"), F.col("mean"))
        base = base.withColumns({"center": center, "scale": F.when(raw < TINY, 1.0).otherwise(raw), "constant": F.lit(False)})
    base = base.select(*keys, "constant", "center", "scale", F.col("median").alias("reference_median"), "__median", "__finite")
    z = (F.col("value") - F.col("center")) / F.nullif("scale", F.lit(0.0))
    harm = harmful(z, F.col("direction")) if scaling == "robust" else z
    departure = harmful(F.col("value") - F.col("center"), F.col("direction"))
    rows = series.join(base, keys).withColumn("harm", F.when(F.col("constant"), departure).otherwise(harm))
    late = rows.filter("t_s >= 0 and value is not null")
    first = F.struct(F.col("harm").alias("h"), (-F.col("t_s")).alias("t"), F.col("value").alias("v"))
    agg = late.groupBy(*keys).agg(
        F.max("harm").alias("__max"), F.percentile("harm", 0.5).alias("__sustained"), F.max(first).alias("__peak"),
        F.count_if(F.col("harm") > 0).alias("__deviating"), F.min(F.when(F.col("harm") > 0, F.col("t_s"))).alias("__first"),
    )
    out = base.join(agg, keys).join(_onset(rows.filter("not constant"), keys, cfg), keys, "left")
    share = F.col("__deviating") / F.col("__finite")
    steady = F.when(F.col("__deviating") > 0, cfg.threshold * (1 + 9 * share)).otherwise(0.0)
    held = F.when(share >= 0.5, steady).otherwise(0.0)
    either = lambda a, b: F.coalesce(F.when(F.col("constant"), a).otherwise(b), F.lit(0.0))
    quiet = F.col("constant") & (F.col("__deviating") == 0)
    return out.select(
        *keys, either(steady, F.col("__max")).alias("max"), either(held, F.col("__sustained")).alias("sustained"),
        either(held, (F.col("__median") - F.col("center")) / F.nullif("scale", F.lit(0.0))).alias("shift"),
        F.when(F.col("constant"), F.col("__first")).otherwise(F.col("onset_s")).alias("onset_s"), "reference_median",
        F.when(F.col("constant"), 0.0).otherwise(F.col("scale")).alias("scale"),
        F.when(quiet, F.col("reference_median")).otherwise(F.col("__peak.v")).alias("peak_value"),
        (-F.col("__peak.t")).cast("double").alias("peak_offset_s"),
    )


def went_silent(series: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Whether a series that should have reported in five abnormal windows did so in at most a tenth of them."""
    n = series.groupBy(*keys).agg(
        F.count_if(F.expr("t_s < 0")).alias("r"), F.count_if(F.expr("t_s < 0 and value is not null")).alias("rf"),
        F.count_if(F.expr("t_s >= 0")).alias("a"), F.count_if(F.expr("t_s >= 0 and value is not null")).alias("af"),
    )
    rate = F.col("rf") / F.nullif("r", F.lit(0))
    expected = rate * F.col("a")
    silent = F.coalesce((rate >= 0.1) & (expected >= 5) & (F.col("af") <= 0.1 * expected), F.lit(False))
    return n.select(*keys, silent.alias("silent"))
