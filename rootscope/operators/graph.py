"""The service graph: edges, entries, closure and the anomaly walk."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import WalkConfig
from ..tables import stored


def edges(df: DataFrame) -> DataFrame:
    """caller, callee, weight: summed; weights that are not positive numbers count one; loops only make a node."""
    w = F.when((F.col("weight") > 0) & (F.col("weight") < float("inf")), F.col("weight")).otherwise(1.0)
    return df.filter("caller <> callee").groupBy("caller", "callee").agg(F.sum(w).alias("weight"))


def nodes(df: DataFrame) -> DataFrame:
    return df.select(F.col("caller").alias("service")).union(df.select(F.col("callee").alias("service"))).distinct()


def entry_nodes(df: DataFrame) -> DataFrame:
    called = df.filter("caller <> callee").select(F.col("callee").alias("service"))
    return nodes(df).join(called, "service", "left_anti")


def neighbours(df: DataFrame) -> DataFrame:
    out = df.groupBy(F.col("caller").alias("service")).agg(F.array_sort(F.collect_set("callee")).alias("callees"))
    back = df.groupBy(F.col("callee").alias("service")).agg(F.array_sort(F.collect_set("caller")).alias("callers"))
    return nodes(df).join(out, "service", "left").join(back, "service", "left")


def closure(df: DataFrame) -> DataFrame:
    """Every (service, descendant) pair but a service with itself, cycles and all.

    Paths double each round until no pair is new, so there are as many rounds as the longest shortest path has doublings.
    """
    pairs = df.filter("caller <> callee").select(F.col("caller").alias("service"), F.col("callee").alias("descendant")).distinct()
    pairs = stored(pairs, "closure")
    n, was = pairs.count(), -1
    while n != was:
        onward = pairs.select(F.col("service").alias("descendant"), F.col("descendant").alias("next"))
        longer = pairs.join(onward, "descendant").filter("service <> next").select("service", F.col("next").alias("descendant"))
        pairs = stored(pairs.union(longer).distinct(), "closure")
        n, was = pairs.count(), n
    return pairs


def walk(names: list[str], pairs: list[tuple[str, str]], score: np.ndarray, cfg: WalkConfig = WalkConfig()) -> np.ndarray:
    """Random walk with restart towards anomalous callees; the stationary distribution."""
    n = len(names)
    if not n:
        return np.zeros(0)
    s = np.where(np.isfinite(score), np.maximum(score, 0), 0)
    if s.sum() <= 0:
        return np.full(n, 1 / n)
    at = {x: i for i, x in enumerate(names)}
    move = np.zeros((n, n))
    near = np.zeros(n)
    for a, b in pairs:
        i, j = at[a], at[b]
        move[i, j] += s[j]
        move[j, i] += cfg.backward * s[i]
        near[i], near[j] = max(near[i], s[j]), max(near[j], s[i])
    move[np.arange(n), np.arange(n)] += np.maximum(0, s - near)
    total = move.sum(1)
    stuck = total <= 0
    move /= np.where(stuck, 1, total)[:, None]
    restart = s / s.sum()
    pi = restart
    for _ in range(cfg.iterations):
        new = cfg.damping * (pi @ move) + ((1 - cfg.damping) + cfg.damping * pi[stuck].sum()) * restart
        close = np.abs(new - pi).sum() < cfg.tolerance
        pi = new
        if close:
            break
    return pi / pi.sum()


def anomaly_walk(scores: DataFrame, graph: DataFrame, cfg: WalkConfig = WalkConfig()) -> DataFrame:
    """scores: incident, service, score for each incident's graph nodes. Returns incident, service, walk.

    An incident's walk folds in one task, over its nodes and, as one array on one of its rows, the edges between services.
    """
    pairs = edges(graph).agg(F.array_sort(F.collect_list(F.struct("caller", "callee"))).alias("pairs"))  # one row
    ids = scores.select("incident").distinct()
    given = ids.crossJoin(nodes(graph)).join(scores, ["incident", "service"], "left").fillna({"score": 0.0})
    rows = given.select("incident", "service", "score", F.lit(None).cast(pairs.schema["pairs"].dataType).alias("pairs"))
    rows = rows.union(ids.crossJoin(pairs).select("incident", F.lit(None).cast("string"), F.lit(None).cast("double"), "pairs"))

    def run(frames: pd.DataFrame) -> pd.DataFrame:
        f = frames[frames["service"].notna()].sort_values("service")
        held = frames.loc[frames["service"].isna(), "pairs"].iloc[0]
        out = f[["incident", "service"]].copy()
        out["walk"] = walk(f["service"].tolist(), [(x["caller"], x["callee"]) for x in held], f["score"].to_numpy(float), cfg)
        return out

    return rows.groupBy("incident").applyInPandas(run, "incident string, service string, walk double")
