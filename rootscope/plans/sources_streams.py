"""Queries of OpenTelemetry documents, streams, training and the simulator."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F

from ..operators import analyze as oa
from ..operators import evaluation as oe
from ..operators import ranking as ork
from ..operators import simulate as sim
from ..operators import traces as ot
from ..operators import windows as ow
from ..sources import cases, otlp_json, sinks
from ..sources import otlp_proto as proto
from ..tables import stored
from .common import QUERIES, query, r, rounded


#: What documents and requests must give, read from the views that they are made from.
_TRACES_SQL = "SELECT lower(lpad(to_hex(trace_id + 1), 32, '0')) AS trace_id, lower(lpad(to_hex(span_id), 16, '0')) AS span_id, CASE WHEN parent_id > 0 THEN lower(lpad(to_hex(parent_id), 16, '0')) ELSE '' END AS parent_id, service, operation, kind, start_ns, end_ns, status, peer FROM spans"
_METRICS_SQL = f"SELECT service, name, kind, count(*) AS n, count(DISTINCT stream) AS streams, {r('sum(value)')} AS total FROM (SELECT service, 'jobs' AS name, 'cumulative' AS kind, stream, value FROM counters WHERE stream % 2 = 0 UNION ALL SELECT service, 'jobs', 'gauge', stream, value FROM counters WHERE stream % 2 = 1) GROUP BY 1, 2, 3"
_LOGS_SQL = "SELECT service, ts_us, coalesce(body, '') AS body, CASE (ts_us // 1000000) % 3 WHEN 0 THEN 'error' WHEN 1 THEN 'info' ELSE 'warn' END AS severity FROM logs WHERE ts_us > 0"


def trace_documents(spans):
    """One OTLP/JSON document per span: some fields in snake case, enums by name or number, 64-bit numbers as strings or numbers."""
    attr = lambda k, v: F.struct(F.lit(k).alias("key"), F.struct(v.alias("stringValue")).alias("value"))
    hex_ = lambda c, n: F.lower(F.lpad(F.hex(c), n, "0"))
    body = F.struct(
        hex_(F.col("trace_id") + 1, 32).alias("traceId"), hex_("span_id", 16).alias("spanId"), F.when(F.col("parent_id") > 0, hex_("parent_id", 16)).alias("parentSpanId"),
        F.col("operation").alias("name"), F.when(F.col("kind") == "client", "SPAN_KIND_CLIENT").otherwise("2").alias("kind"), F.col("start_ns").cast("string").alias("startTimeUnixNano"),
        F.col("end_ns").alias("end_time_unix_nano"), F.array(attr("peer.service", F.col("peer")), attr("other", F.lit("x"))).alias("attributes"),
        F.struct(F.when(F.col("status") == "error", "STATUS_CODE_ERROR").otherwise("1").alias("code")).alias("status"),
    )
    scope = F.array(F.struct(F.array(body).alias("spans")))
    resource = F.struct(F.array(attr("service.name", F.col("service"))).alias("attributes"))
    return spans.select(F.to_json(F.struct(F.array(F.struct(resource.alias("resource"), scope.alias("scopeSpans"))).alias("resourceSpans"))).alias("value"))


@query("otlp_json_traces", ["spans"], _TRACES_SQL)
def otlp_json_traces(spans):
    return otlp_json.spans(trace_documents(spans))


@query("otlp_json_metrics", ["counters"], _METRICS_SQL)
def otlp_json_metrics(counters):
    attr = lambda k, v: F.struct(F.lit(k).alias("key"), F.struct(v.alias("stringValue")).alias("value"))
    point = F.struct(
        F.array(attr("stream", F.col("stream").cast("string"))).alias("attributes"), (F.col("ts_us") * 1000).cast("string").alias("timeUnixNano"),
        (F.col("start_us") * 1000).alias("startTimeUnixNano"), F.col("value").alias("asDouble"),
    )
    even = F.col("stream") % 2 == 0
    total = F.when(even, F.struct(F.array(point).alias("dataPoints"), F.lit("AGGREGATION_TEMPORALITY_CUMULATIVE").alias("aggregationTemporality"), F.lit(True).alias("isMonotonic")))
    gauge = F.when(~even, F.struct(F.array(point).alias("dataPoints")))
    metric = F.struct(F.lit("jobs").alias("name"), gauge.alias("gauge"), total.alias("sum"))
    resource = F.struct(F.array(attr("service.name", F.col("service"))).alias("attributes"))
    doc = F.struct(F.array(F.struct(resource.alias("resource"), F.array(F.struct(F.array(metric).alias("metrics"))).alias("scopeMetrics"))).alias("resourceMetrics"))
    p = otlp_json.metric_points(counters.select(F.to_json(doc).alias("value")))
    return p.groupBy("service", "name", "kind").agg(F.count("*").alias("n"), F.count_distinct("stream").alias("streams"), F.sum("value").alias("total"))


@query("otlp_json_logs", ["logs"], _LOGS_SQL)
def otlp_json_logs(logs):
    attr = lambda k, v: F.struct(F.lit(k).alias("key"), F.struct(v.alias("stringValue")).alias("value"))
    text = F.coalesce("body", F.lit(""))
    n = F.element_at(F.array(F.lit(17), F.lit(9), F.lit(13)), ((F.expr("ts_us div 1000000") % 3) + 1).cast("int"))
    # Every other body is a map with a message.
    flat = F.expr("ts_us div 1000000") % 2 == 0
    body = F.struct(F.when(flat, text).alias("stringValue"), F.when(~flat, F.struct(F.array(attr("message", text)).alias("values"))).alias("kvlistValue"))
    record = F.struct((F.col("ts_us") * 1000).cast("string").alias("timeUnixNano"), n.alias("severityNumber"), body.alias("body"))
    resource = F.struct(F.array(attr("service.name", F.col("service"))).alias("attributes"))
    doc = F.struct(F.array(F.struct(resource.alias("resource"), F.array(F.struct(F.array(record).alias("logRecords"))).alias("scopeLogs"))).alias("resourceLogs"))
    return otlp_json.log_lines(logs.filter("ts_us > 0").select(F.to_json(doc).alias("value")))


def _requests(rows, columns, message):
    """A protobuf request for each row: resource and scope around message(row's values)."""

    def run(batches):
        for b in batches:
            out = [message(*x) for x in zip(*(b.column(c).to_pylist() for c in columns))]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["content"])

    return rows.select(*columns).mapInArrow(run, "content binary")


def _in_service(service, inner):
    return proto.put(1, proto.put(1, proto.put_attribute(1, "service.name", service)) + proto.put(2, proto.put(2, inner)))


def _span_message(trace, span, parent, operation, kind, start, end, peer, status, service):
    put = proto.put
    ids = put(1, (trace + 1).to_bytes(16, "big")) + put(2, span.to_bytes(8, "big")) + (put(4, parent.to_bytes(8, "big")) if parent > 0 else b"")
    rest = put(5, operation) + put(6, 3 if kind == "client" else 2) + proto.put_time(7, start) + proto.put_time(8, end)
    return _in_service(service, ids + rest + proto.put_attribute(9, "peer.service", peer) + put(15, put(3, 2 if status == "error" else 1)))


def _point_message(stream, ts, start, value, service):
    put = proto.put
    point = proto.put_attribute(7, "stream", str(stream)) + proto.put_time(2, start * 1000) + proto.put_time(3, ts * 1000) + put(4, float(value))
    data = put(7, put(1, point) + put(2, 2) + put(3, 1)) if stream % 2 == 0 else put(5, put(1, point))
    return _in_service(service, put(1, "jobs") + data)


def _record_message(service, ts, body):
    put, second = proto.put, ts // 1_000_000
    text = put(1, body or "") if second % 2 == 0 else put(6, proto.put_attribute(1, "message", body or ""))
    return _in_service(service, proto.put_time(1, ts * 1000) + put(2, (17, 9, 13)[second % 3]) + put(5, text))


@query("otlp_proto_traces", ["spans"], _TRACES_SQL)
def otlp_proto_traces(spans):
    columns = ["trace_id", "span_id", "parent_id", "operation", "kind", "start_ns", "end_ns", "peer", "status", "service"]
    return proto.decoded(_requests(spans, columns, _span_message), "traces")


@query("otlp_proto_metrics", ["counters"], _METRICS_SQL)
def otlp_proto_metrics(counters):
    p = proto.decoded(_requests(counters, ["stream", "ts_us", "start_us", "value", "service"], _point_message), "metrics")
    return p.groupBy("service", "name", "kind").agg(F.count("*").alias("n"), F.count_distinct("stream").alias("streams"), F.sum("value").alias("total"))


@query("otlp_proto_logs", ["logs"], _LOGS_SQL)
def otlp_proto_logs(logs):
    return proto.decoded(_requests(logs.filter("ts_us > 0"), ["service", "ts_us", "body"], _record_message), "logs")


_HOURLY = "SELECT service, CASE stream % 3 WHEN 0 THEN 'cpu' WHEN 1 THEN 'mem' ELSE 'latency' END AS name, CAST(floor(ts_us / 3.6e9) * 3600 AS DOUBLE) AS time_s, avg(value * CASE stream % 3 WHEN 1 THEN 1e6 ELSE 1e0 END) AS value FROM metrics GROUP BY ALL"
_GRID = "(SELECT DISTINCT {service} AS service, name FROM h) k CROSS JOIN (SELECT DISTINCT time_s FROM h) t"


def _hourly(metrics):
    name = F.when(F.col("stream") % 3 == 0, "cpu").when(F.col("stream") % 3 == 1, "mem").otherwise("latency")
    return metrics.groupBy("service", name.alias("name"), (F.floor(F.col("ts_us") / 3.6e9) * 3600).cast("double").alias("time_s")).agg(F.avg(F.col("value") * F.when(F.col("stream") % 3 == 1, 1e6).otherwise(1.0)).alias("value"))


@query(
    "wide_metrics", ["metrics"],
    f"""WITH h AS ({_HOURLY}) SELECT k.service, k.name, t.time_s, {r("CASE WHEN k.name = 'mem' THEN value / 1e6 ELSE value END")} AS value
    FROM {_GRID.format(service="service")} LEFT JOIN h ON h.service = k.service AND h.name = k.name AND h.time_s = t.time_s""",
)
def wide_metrics(metrics):
    """One row a time and one column a series, as benchmark cases have them, and back."""
    h = _hourly(metrics).withColumn("column", F.concat_ws("_", "service", "name"))
    columns = [c[0] for c in h.select("column").distinct().orderBy("column").collect()]  # names of series
    return cases.wide_metrics(h.groupBy(F.col("time_s").alias("time")).pivot("column", columns).agg(F.first("value")))


@query(
    "aligned_series", ["metrics"],
    f"""WITH h AS ({_HOURLY}), g AS (SELECT CASE service WHEN 'view' THEN 'page' ELSE service END AS service, name, time_s, value FROM h)
    SELECT k.service, k.name, t.time_s, {r("value")} AS value FROM {_GRID.format(service="service").replace("FROM h", "FROM g")} LEFT JOIN g ON g.service = k.service AND g.name = k.name AND g.time_s = t.time_s""",
)
def aligned_series(metrics):
    h = _hourly(metrics)
    parts = [h.filter(F.col("name") == n) for n in ("cpu", "mem", "latency")]
    return cases.aligned(parts, h.select("time_s"), {"view": "page"})


@query(
    "firing_alerts", ["ranks"],
    "SELECT CAST(case_id AS VARCHAR) AS fingerprint, 1704067200e0 + case_id % 1000 AS t0_s FROM ranks WHERE rank IS NOT NULL ORDER BY t0_s, fingerprint LIMIT 20",
)
def firing_alerts(ranks):
    """The alerts that an analysis starts from: 20 at most, by their begin."""
    at = F.date_format(F.timestamp_seconds(1704067200 + F.col("case_id") % 1000), "yyyy-MM-dd'T'HH:mm:ssXXX")
    status = F.when(F.col("rank").isNull(), "resolved").otherwise("firing")
    return cases.firing(ranks.select(F.col("case_id").cast("string").alias("fingerprint"), status.alias("status"), at.alias("startsAt")))


def _pad(secret: bytes, byte: int) -> str:
    return "unhex('" + bytes(x ^ byte for x in secret.ljust(64, b"\0")).hex() + "')"


#: HMAC by its definition, from two hashes.
_HMAC = f"'sha256=' || sha256({_pad(b'secret', 0x5C)} || unhex(sha256({_pad(b'secret', 0x36)} || encode(body))))"


@query(
    "webhook_payloads", ["ranks"],
    f"""SELECT event, id, body, {_HMAC} AS signature FROM (SELECT 'opened' AS event, 'inc-' || CAST(case_id AS VARCHAR) AS id, '{{"event":"opened","id":"inc-' || CAST(case_id AS VARCHAR) || '","dataset":"' || dataset || '"'
    || CASE WHEN rank IS NULL THEN '' ELSE ',"rank":' || CAST(rank AS VARCHAR) END || '}}' AS body FROM ranks)""",
)
def webhook_payloads(ranks):
    events = ranks.select(F.lit("opened").alias("event"), F.concat(F.lit("inc-"), F.col("case_id").cast("string")).alias("id"), "dataset", "rank")
    return sinks.payloads(events, "secret")


@query("engine_counters", ["spans", "metrics", "logs"], "SELECT 'spans' AS name, count(*) AS value FROM spans UNION ALL SELECT 'metrics', count(*) FROM metrics UNION ALL SELECT 'logs', count(*) FROM logs")
def engine_counters(spans, metrics, logs):
    return sinks.counters(spans=spans, metrics=metrics, logs=logs)


@query("feedback_list", ["ranks"], "SELECT case_id AS incident, dataset AS root_cause, rank AS recorded_at FROM ranks WHERE rank IS NOT NULL")
def feedback_list(ranks):
    return sinks.feedback(ranks.filter("rank is not null").select(F.col("case_id").alias("incident"), F.col("dataset").alias("root_cause"), F.col("rank").alias("recorded_at")))


def sim_scenario(spark, sf_dir):
    """A CPU fault in a simulated shop: services ranked from its series."""
    out = sim.run(sim.shop(), [sim.parse_fault("cpu=8:payment@180s+60s")], 240, rate=2.0)
    spans, metrics = (spark.createDataFrame(out[k]) for k in ("spans", "metrics"))
    c = stored(ot.assembled(spans), "traces")
    calls = ot.calls(c)
    res = 10_000_000_000
    series = ow.trace_series(ot.visits(c), calls, ot.error_origins(c), res).select("service", "name", "win", "value")
    m = metrics.withColumn("agg", F.lit("level"))
    series = series.unionByName(ow.metric_windows(m, res // 1000).select("service", "name", "win", "value"))
    whole = ow.calendar(series, ["service", "name"]).withColumns({"incident": F.lit("sim"), "t_s": F.col("win") * 10 - 1_700_000_180})
    graph = calls.groupBy("caller", "callee").agg(F.count("*").cast("double").alias("weight"))
    ranked = oa.analyze(whole, graph)
    return rounded(ranked.select("rank", "service", "score", "probability"))


QUERIES["sim_scenario"] = sim_scenario


@query("ltr_fit", ["ranks"])
def ltr_fit(ranks):
    """Weights trained on synthetic features whose first column tells the truth."""
    u = lambda i: F.pmod(F.xxhash64("case_id", "service", F.lit(i)), F.lit(1000)) / 1000.0
    f = ranks.select("case_id", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("service"))
    f = f.withColumn("truth", F.col("service") == F.col("case_id") % 5)
    f = f.withColumns({n: u(i) for i, n in enumerate(ork.FEATURES)}).withColumn("rel_max", F.when(F.col("truth"), 0.7).otherwise(0.2) + 0.3 * F.col("rel_max"))
    m = oe.fit(f.withColumn("incident", F.col("case_id").cast("string")), "truth")
    return ranks.sparkSession.createDataFrame(sorted(m["weights"].items()), "feature string, weight double")
