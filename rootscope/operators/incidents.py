"""Anomalous windows and the life of incidents."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import IncidentConfig, parse_duration
from ..functions.signals import is_host_scoped


def window_anomalies(observed: DataFrame, entries: DataFrame, cfg: IncidentConfig = IncidentConfig()) -> DataFrame:
    """observed: win, service, name, category, state, surprise, episode_age. By window and service: onset window,
    greatest surprise and its signal, and whether users see it.
    """
    o = observed.filter((F.col("state") == "anomalous") & (F.col("episode_age") + 1 >= cfg.confirm_windows) & (F.col("surprise") >= cfg.min_surprise))
    o = o.filter(~is_host_scoped(F.col("name")))
    if cfg.exclude:
        o = o.filter(~F.col("service").isin(*cfg.exclude))
    e = entries.select("service", F.lit(True).alias("__entry")).distinct()
    o = o.join(e, "service", "left").withColumn("__entry", F.coalesce("__entry", F.lit(False)))
    o = o.filter((F.col("category") != "traffic") | F.col("__entry"))
    seen = F.col("__entry") & F.col("category").isin("latency", "errors", "traffic")
    return o.groupBy("win", "service").agg(
        F.min(F.col("win") - F.col("episode_age")).alias("onset"), F.max("surprise").alias("surprise"),
        F.min_by("name", F.struct(-F.col("surprise"), "name")).alias("signal"), F.bool_or(seen).alias("user_facing"),
    )


def triggers(anomalies: DataFrame, cfg: IncidentConfig = IncidentConfig()) -> DataFrame:
    """By window: how many services, and whether an incident would open."""
    w = anomalies.groupBy("win").agg(
        F.count("*").alias("services"), F.bool_or("user_facing").alias("user_facing"), F.max("surprise").alias("surprise"), F.min("onset").alias("onset")
    )
    opens = (F.col("services") >= max(1, cfg.min_services)) | F.col("user_facing") | (F.col("surprise") >= cfg.severe_surprise)
    return w.withColumn("opens", opens)


def warmed_up(anomalies: DataFrame, windows: DataFrame, warmup: int) -> DataFrame:
    """Without the anomalies of the first `warmup` windows, in which nothing is known yet."""
    first = windows.agg((F.min("win") + warmup).alias("__from"))
    return anomalies.crossJoin(F.broadcast(first)).filter(F.col("win") >= F.col("__from")).drop("__from")  # one row


def analysis_bounds(actions: DataFrame, resolution_s: float, reference_s: float) -> DataFrame:
    """actions: incident, action, at_s, start_s, last_anomaly_s. The bounds of each analysis, as scores.split() takes them.

    An incident is analysed when it opens, at intervals, and when it is resolved, then up to two windows after its last anomaly.
    """
    end = F.when(F.col("action") == "resolved", F.col("last_anomaly_s") + 2 * resolution_s).otherwise(F.col("at_s"))
    return actions.select("incident", "action", F.col("start_s").alias("t0_s"), (F.col("start_s") - reference_s).alias("from_s"), end.alias("to_s"))


def recent(incidents_: DataFrame, limit: int = 50, start: str = "start", name: str = "id") -> DataFrame:
    """The last incidents, newest first: `limit`, at most 500."""
    return incidents_.orderBy(F.desc(start), name).limit(min(max(1, limit), 500))


def found(ids: DataFrame, live: DataFrame, kept: DataFrame, name: str = "id") -> DataFrame:
    """Each wanted incident as it is held live, or else as it was kept; columns of live and kept are alike."""
    columns = [c for c in live.columns if c != name]
    a = live.select(name, F.struct(*columns).alias("__a"))
    b = kept.select(name, F.struct(*columns).alias("__b"))
    both = ids.select(name).distinct().join(a, name, "left").join(b, name, "left")
    return both.select(name, F.coalesce("__a", "__b").alias("__c")).filter("__c is not null").select(name, "__c.*")


class Lifecycle:
    """One incident at a time: opens on a trigger, is analysed after a delay and then at intervals, resolves after quiet."""

    def __init__(self, cfg: IncidentConfig = IncidentConfig()):
        self.cfg = cfg
        self.delay, self.interval, self.quiet = (parse_duration(x) for x in (cfg.rca_delay, cfg.rca_interval, cfg.resolve_after))
        self.open: dict | None = None
        self.done: list[dict] = []

    def on_window(self, end: int, services: dict[str, tuple[int, float]], user_facing: bool) -> list[tuple[str, str]]:
        """services: onset and surprise of each; times in ns. Returns (action, incident id)."""
        i = self.open
        if i is not None:
            if services:
                i["last_anomaly"] = end
                for s, (_, x) in services.items():
                    i["services"][s] = max(i["services"].get(s, 0.0), x)
            if end - i["last_anomaly"] >= self.quiet:
                i["resolved"], self.open = end, None
                self.done.append(i)
                return [("resolved", i["id"])]
            if end >= i["next"]:
                i["next"] = end + max(1, self.interval)
                i["analyses"] += 1
                return [("analyze", i["id"])]
            return []
        c = self.cfg
        if not (len(services) >= max(1, c.min_services) or user_facing or any(x >= c.severe_surprise for _, x in services.values())):
            return []
        start = min((o for o, _ in services.values()), default=end)
        name = f"inc-{start // 1_000_000_000}-{pd.util.hash_array(pd.array(['|'.join(sorted(services))], dtype=object).to_numpy())[0] & 0xFFFFFFFF:08x}"
        self.open = {
            "id": name, "start": start, "opened": end, "resolved": None, "last_anomaly": end, "trigger": sorted(services),
            "services": {s: x for s, (_, x) in services.items()}, "analyses": 0, "next": end + self.delay,
        }
        if self.delay:
            return [("opened", name)]
        self.open["next"], self.open["analyses"] = end + max(1, self.interval), 1
        return [("opened", name), ("analyze", name)]


INCIDENT = (
    "id string, status string, start long, opened long, resolved long, last_anomaly long, trigger array<string>, services map<string,double>, analyses long"
)


def incidents(anomalies: DataFrame, windows: DataFrame, resolution: int, cfg: IncidentConfig = IncidentConfig(), deployment: str | None = None) -> DataFrame:
    """The incidents that these windows give. A deployment has one open incident at a time, so its windows fold in order.

    deployment: a column of anomalies that names it, and a task's share of the work; without it, all are of one.

    windows: win, all of them, as quiet ones resolve incidents; only windows with anomalies and the bounds of quiet
    stretches reach the fold, so its input grows with anomalies, not with time.
    """
    anomalies = anomalies.withColumn("deployment", F.lit("") if deployment is None else F.col(deployment))
    a = anomalies.groupBy("deployment", "win").agg(
        F.map_from_entries(F.collect_list(F.struct("service", F.struct("onset", "surprise")))).alias("services"), F.bool_or("user_facing").alias("user_facing")
    )
    last = windows.agg(F.max("win").alias("last"))
    rows = a.crossJoin(F.broadcast(last))  # one row

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("win", ignore_index=True)
        life = Lifecycle(cfg)
        at, final = None, int(f["last"].iloc[0])
        for win, services, seen in zip(f["win"], f["services"], f["user_facing"]):
            at = int(win) if at is None or life.open is None else at + 1
            while life.open is not None and at < win:
                life.on_window((at + 1) * resolution, {}, False)
                at += 1
            at = int(win)
            life.on_window((at + 1) * resolution, {k: (v["onset"] * resolution, v["surprise"]) for k, v in dict(services).items()}, bool(seen))
        while life.open is not None and at is not None and at < final:
            at += 1
            life.on_window((at + 1) * resolution, {}, False)
        every = life.done + ([life.open] if life.open else [])
        rows = [
            (i["id"], "open" if i["resolved"] is None else "resolved", i["start"], i["opened"], i["resolved"], i["last_anomaly"], i["trigger"], i["services"], i["analyses"])
            for i in every
        ]
        out = pd.DataFrame(rows, columns=[x.split()[0] for x in INCIDENT.split(", ")])
        out["resolved"] = out["resolved"].astype("Int64")
        return out

    return rows.groupBy("deployment").applyInPandas(run, INCIDENT)
