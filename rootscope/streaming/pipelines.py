"""Structured Streaming: window summaries, trace assembly, per-series detection, collected summaries.

Watermarks drop what is late; points too far ahead are filtered before they can move it. Windows close in
event time, and a batch run over the same rows gives the windows that the watermark leaves open.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..config import DetectorConfig, EngineConfig
from ..operators.detector import Detector
from ..operators.incidents import IncidentConfig, Lifecycle

MAX_AHEAD_WINDOWS = 360


def timed(df: DataFrame, ts_us: str = "ts_us") -> DataFrame:
    """With ts, a timestamp, for watermarks."""
    return df.withColumn("ts", F.timestamp_micros(ts_us))


def not_ahead(df: DataFrame, now_us: int, resolution_us: int, name: str = "points") -> DataFrame:
    """Without points too far in the future. A query's progress has, under `name`, how many were seen and how many left out."""
    far = F.col("ts_us") >= now_us + MAX_AHEAD_WINDOWS * resolution_us
    return df.observe(name, F.count(F.lit(1)).alias("seen"), F.count_if(far).alias("ahead")).filter(~far)


def dropped(query, name: str = "points") -> dict[str, int]:
    """Of a query so far: points seen, too far ahead, and too late for their windows."""
    out = {"seen": 0, "ahead": 0, "late": 0}
    for p in query.recentProgress:
        if (row := p.observedMetrics.get(name)) is not None:
            out["seen"] += row["seen"]
            out["ahead"] += row["ahead"]
        out["late"] += sum(o.numRowsDroppedByWatermark for o in p.stateOperators)
    return out


def metric_windows(points: DataFrame, cfg: EngineConfig = EngineConfig()) -> DataFrame:
    """Tumbling windows of metric points: sum, count, least, most, distinct streams; for append mode."""
    w = timed(points).withWatermark("ts", _interval(cfg.lateness)).groupBy(F.window("ts", _interval(cfg.resolution)).alias("w"), "service", "name")
    out = w.agg(F.sum("value").alias("total"), F.count("*").alias("n"), F.min("value").alias("least"), F.max("value").alias("most"), F.size(F.collect_set("stream")).cast("long").alias("streams"))
    return out.select(F.unix_micros("w.start").alias("start_us"), "service", "name", "total", "n", "least", "most", "streams")


def log_windows(lines: DataFrame, cfg: EngineConfig = EngineConfig()) -> DataFrame:
    w = timed(lines).withWatermark("ts", _interval(cfg.lateness)).groupBy(F.window("ts", _interval(cfg.resolution)).alias("w"), "service")
    return w.agg(F.count("*").alias("lines"), F.count_if(F.col("severity") == "error").alias("errors")).select(F.unix_micros("w.start").alias("start_us"), "service", "lines", "errors")


def traces(spans: DataFrame, cfg: EngineConfig = EngineConfig()) -> DataFrame:
    """Traces released after they were idle: trace_id and all of its spans."""
    s = spans.withColumn("ts", F.timestamp_micros(F.expr("end_ns div 1000"))).withWatermark("ts", _interval(cfg.lateness))
    g = s.groupBy(F.session_window("ts", _interval(cfg.trace_timeout)), "trace_id")
    return g.agg(F.collect_list(F.struct(*(c for c in spans.columns if c != "trace_id"))).alias("spans")).select("trace_id", "spans")


def exploded(assembled: DataFrame) -> DataFrame:
    return assembled.select("trace_id", F.inline("spans"))


def collected(messages: DataFrame, keys: list[str], lateness: str = "20 seconds") -> DataFrame:
    """messages: edge, epoch, seq, ts_us, keys, counters. Each message counts once; equal windows merge."""
    once = timed(messages).withWatermark("ts", lateness).dropDuplicatesWithinWatermark(["edge", "epoch", "seq"])
    counters = [c for c in messages.columns if c not in {"edge", "epoch", "seq", "ts_us", *keys}]
    return once.groupBy(F.window("ts", "10 seconds").alias("w"), *keys).agg(*(F.sum(c).alias(c) for c in counters)).select(F.unix_micros("w.start").alias("start_us"), *keys, *counters)


OBSERVED = "service string, name string, win long, value double, state string, z double, p double, surprise double, episode_age long"


def detected(series: DataFrame, cfg: DetectorConfig = DetectorConfig()) -> DataFrame:
    """series: service, name, win, value, direction, in the order of win from batch to batch. The detector is the state."""
    import pickle

    def run(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        f = pd.concat(list(frames), ignore_index=True).sort_values("win", ignore_index=True)
        d = pickle.loads(state.get[0]) if state.exists else Detector(f["direction"].iloc[0], cfg)
        found = d.observe_many(f["value"].astype(float).tolist())
        state.update((pickle.dumps(d),))
        out = pd.concat([f[["service", "name", "win", "value"]], found[["state", "z", "p", "surprise", "episode_age"]]], axis=1)
        yield out

    return series.groupBy("service", "name").applyInPandasWithState(run, OBSERVED, "detector binary", "append", GroupStateTimeout.NoTimeout)


def incident_actions(windows: DataFrame, resolution_ns: int, cfg: IncidentConfig = IncidentConfig()) -> DataFrame:
    """windows: deployment, win, services (map of service to struct of onset and surprise), user_facing; every window, quiet ones too."""
    import pickle

    def run(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        life = pickle.loads(state.get[0]) if state.exists else Lifecycle(cfg)
        rows = []
        for f in frames:
            for win, services, seen in f.sort_values("win")[["win", "services", "user_facing"]].itertuples(index=False):
                at = {k: (v["onset"] * resolution_ns, v["surprise"]) for k, v in dict(services or {}).items()}
                rows += [(key[0], int(win), a, i) for a, i in life.on_window((int(win) + 1) * resolution_ns, at, bool(seen))]
        life.done = []
        state.update((pickle.dumps(life),))
        yield pd.DataFrame(rows, columns=["deployment", "win", "action", "incident"])

    return windows.groupBy("deployment").applyInPandasWithState(run, "deployment string, win long, action string, incident string", "life binary", "append", GroupStateTimeout.NoTimeout)


def _interval(duration: str) -> str:
    from ..config import parse_duration

    return f"{parse_duration(duration) // 1_000_000} milliseconds"


def run_available(stream: DataFrame, checkpoint: str, name: str) -> DataFrame:
    """Process what there is, then stop; the rows are in a memory table."""
    q = stream.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)


def upsert_batches(stream: DataFrame, path: str, checkpoint: str, key: str = "id", order: str = "seq"):
    """Keep the last row of each key in a table of versions: each batch writes a new one from the newest before it."""
    from ..sources.sinks import upserted
    from ..tables import file_system

    def before(spark, number: int) -> int | None:
        fs, folder = file_system(spark, path)
        names = [x.getPath().getName() for x in fs.listStatus(folder)] if fs.exists(folder) else []
        done = [int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit() and fs.exists(file_system(spark, f"{path}/{n}/_SUCCESS")[1])]
        return max((n for n in done if n < number), default=None)

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        was = before(spark, number)
        old = batch.limit(0) if was is None else spark.read.schema(batch.schema).parquet(f"{path}/v{was}")
        upserted(old, batch, key, order).write.mode("overwrite").parquet(f"{path}/v{number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
