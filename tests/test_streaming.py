"""Streams give what a batch gives for closed windows."""

import tempfile

from pyspark.sql import functions as F

from rootscope.config import DetectorConfig
from rootscope.operators import windows
from rootscope.operators.detector import Detector
from rootscope.streaming import pipelines as p


def written(spark, rows, schema):
    path = tempfile.mkdtemp(dir="/tmp") + "/in"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(path)
    return spark.readStream.schema(schema).parquet(path), tempfile.mkdtemp(dir="/tmp")


def test_metric_windows_match_batch(spark):
    schema = "service string, name string, stream long, ts_us long, value double"
    rows = [("s", "cpu", k % 3, k * 1_000_000, float(k)) for k in range(100)]
    stream, at = written(spark, rows, schema)
    got = {r.start_us: (r.total, r.n, r.streams) for r in p.run_available(p.metric_windows(stream), at, "m").collect()}
    batch = windows.metric_windows(spark.createDataFrame(rows, schema).withColumn("agg", F.lit("level")), 10_000_000)
    want = {r.win * 10_000_000: (r.total, r.n, r.streams) for r in batch.collect()}
    assert got and all(want[k] == v for k, v in got.items()) and len(got) >= len(want) - 3


def test_detector_state(spark):
    schema = "service string, name string, win long, value double, direction string"
    values = [10.0 + (i * 7 % 5) for i in range(60)] + [90.0] * 5
    stream, at = written(spark, [("s", "cpu", i, v, "up") for i, v in enumerate(values)], schema)
    got = [r.state for r in p.run_available(p.detected(stream), at, "d").orderBy("win").collect()]
    assert got == Detector("up", DetectorConfig()).observe_many(values).state.tolist()


def test_sessions(spark):
    schema = "trace_id long, span_id long, end_ns long"
    rows = [(t, s, (t * 100 + s) * 1_000_000_000) for t in range(1, 5) for s in range(3)]
    stream, at = written(spark, rows, schema)
    got = {r.trace_id: len(r.spans) for r in p.run_available(p.traces(stream), at, "t").collect()}
    assert got and set(got.values()) == {3}


def test_late_and_future_points_are_counted(spark):
    schema = "service string, name string, stream long, ts_us long, value double"
    path, second = tempfile.mkdtemp(dir="/tmp") + "/in", 1_000_000
    rows = lambda *times: spark.createDataFrame([("s", "cpu", 1, t * second, 1.0) for t in times], schema).coalesce(1)
    rows(1000, 1005, 10_000_000).write.parquet(path)  # the last is too far ahead
    out = p.metric_windows(p.not_ahead(spark.readStream.schema(schema).parquet(path), 1_000 * second, 10 * second))
    at = tempfile.mkdtemp(dir="/tmp")
    start = lambda: out.writeStream.format("parquet").option("path", at + "/out").outputMode("append").option("checkpointLocation", at + "/state").trigger(availableNow=True).start()
    found = {"seen": 0, "ahead": 0, "late": 0}
    for more in (None, (2000,), (1001, 2005)):  # 1001 comes after the watermark has passed it
        if more:
            rows(*more).write.mode("append").parquet(path)
        q = start()
        q.awaitTermination()
        found = {k: v + found[k] for k, v in p.dropped(q).items()}
    assert found == {"seen": 6, "ahead": 1, "late": 1}
