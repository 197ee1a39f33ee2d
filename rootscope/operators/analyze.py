"""End to end: series, a graph and the incident's begin to ranked services with reasons."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import ScoreConfig, WalkConfig
from ..functions.signals import category
from ..tables import stored
from . import graph as g
from . import ranking as r
from . import scores as s

METHODS = ["model", "max_score", "baro", "nsigma", "random_walk"]


class InputError(ValueError):
    pass


def checked(series: DataFrame) -> None:
    """Raises InputError if nothing can be analysed."""
    n = series.agg(F.count("*").alias("n"), F.count_if(F.col("t_s") < 0).alias("before"), F.count_if(F.col("t_s") >= 0).alias("after")).first()
    if not n.n:
        raise InputError("no series")
    if not n.before or not n.after:
        raise InputError("the incident's begin must lie inside the series' times")


def service_features(
    series: DataFrame, graph: DataFrame | None, cfg: ScoreConfig = ScoreConfig(), walk: WalkConfig | None = WalkConfig(), scaling: str = "robust"
) -> tuple[DataFrame, DataFrame]:
    """series: incident, service, name, t_s, value. Returns features and the series' scores, for many incidents at once.

    What is read more than once is stored: the windows around incidents, a row per series, a row per service.
    """
    k = ["incident", "service", "name"]
    series = stored(s.classified(series), "series")
    graph = graph if graph is None else stored(g.edges(graph), "graph")
    found = stored(s.scores(series, scaling, cfg, k).withColumn("category", category(F.col("name"))), "scores")
    e = stored(r.evidence(found, s.went_silent(series, k), graph, threshold=cfg.threshold), "evidence")
    walks = None
    if graph is not None and walk is not None:
        top = F.max("max_score").over(Window.partitionBy("incident"))
        near = F.when(top > 0, F.least(F.greatest(F.col("max_score") / top, F.lit(0.0)), F.lit(1.0))).otherwise(0.0)
        on_graph = e.select("incident", "service", near.alias("score")).join(g.nodes(graph), "service", "left_semi")
        walks = stored(g.anomaly_walk(on_graph, graph, walk), "walks")
    return stored(r.features(e, graph, walks, threshold=cfg.threshold), "features"), found


def ranking(feats: DataFrame, method: str = "model", models: list[dict] | None = None, graph: bool = True) -> DataFrame:
    """Features with score, rank and probability by a method of METHODS. graph: whether there was one."""
    if method == "model":
        models = models or [r.model(r.HEURISTIC)]
        return r.ranked(r.ensemble(feats, models) if len(models) > 1 else r.linear(feats, models[0]))
    score = r.walk_score(F.col("walk"), F.col("max_score")) if method == "random_walk" and graph else F.col("max_score")
    return r.ranked(feats.withColumn("score", score), False)


def analyze(
    series: DataFrame, graph: DataFrame | None = None, method: str = "model", models: list[dict] | None = None, cfg: ScoreConfig = ScoreConfig(),
    exclude: tuple[str, ...] = (),
) -> DataFrame:
    """incident, rank, service, score, probability, features, signals, reasons. Raises InputError where nothing can be analysed."""
    if method not in METHODS:
        raise InputError(f"unknown method {method}")
    if exclude:
        series = series.filter(~F.col("service").isin(*exclude))
    checked(series)
    scaling = {"baro": "iqr", "nsigma": "nsigma"}.get(method, "robust")
    feats, found = service_features(series, graph, cfg, WalkConfig() if method in ("model", "random_walk") else None, scaling)
    out = stored(ranking(feats, method, models, graph is not None), "ranking")
    parts = r.contributions(feats, (models or [r.model(r.HEURISTIC)])[0] if method == "model" else r.model(dict.fromkeys(r.TELLING, 1.0)))
    tops = r.top_signals(found)
    listed = tops.groupBy("incident", "service").agg(
        F.array_sort(F.collect_list(F.struct("position", "name", "category", "max", "sustained", "shift", "onset_s", "peak_value", "peak_offset_s"))).alias("signals")
    )
    why = r.reasons(out, tops, parts, threshold=cfg.threshold)
    return out.join(listed, ["incident", "service"], "left").join(why, ["incident", "service"], "left")
