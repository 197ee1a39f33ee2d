"""Queries of names, spans' attributes and log lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import logs as fl
from ..functions import numbers as fn
from ..functions import signals as fg
from ..functions import spans as fs
from ..operators import logs as ol
from ..operators import windows as ow
from .common import case, query, r

#: Metric-like names made of part types and event types.
NAMES = """
    SELECT DISTINCT concat(lower(a.service), sep, b.name) AS name FROM
    (SELECT DISTINCT service FROM metrics UNION SELECT DISTINCT service FROM logs) a
    CROSS JOIN (SELECT unnest({names}) AS name) b CROSS JOIN (SELECT unnest(['.', '_']) AS sep) c"""
_SAMPLE = [
    "cpu.usage", "mem_rss", "heap_bytes", "gc_pause_ms", "http.server.duration", "requests_total", "error.count", "io_wait", "disk_reads",
    "net_rx", "conn_pool", "self_time", "error_origin", "queue_depth", "p95_rt", "log_lines", "5xx", "thread_count", "bytes_sent", "oom_kills",
]


def _names(metrics, logs):
    services = metrics.select("service").union(logs.select("service")).distinct()
    parts = F.explode(F.array(*map(F.lit, _SAMPLE)))
    return (
        services.withColumn("n", parts).withColumn("sep", F.explode(F.array(F.lit("."), F.lit("_"))))
        .select(F.concat(F.lower("service"), "sep", "n").alias("name")).distinct()
    )


def _tests(label, has, whole):
    parts = [f"contains(n, '{x}')" for x in has] + [f"list_contains(t, '{x}')" for x in whole]
    return "(" + " OR ".join(parts) + ")", label


_NAMES_SQL = NAMES.format(names="[" + ", ".join(f"'{x}'" for x in _SAMPLE) + "]")
_CLASSED = f"WITH n AS (SELECT name, lower(name) AS n, regexp_split_to_array(lower(name), '[^a-z0-9]') AS t FROM ({_NAMES_SQL})), k AS (SELECT name, {case([_tests(*x) for x in fg.RULES], 'other')} AS category FROM n)"


@query("classify_metric", ["metrics", "logs"], f"{_CLASSED} SELECT name, category FROM k")
def classify_metric(metrics, logs):
    return _names(metrics, logs).withColumn("category", fg.category(F.col("name")))


@query(
    "metric_direction", ["metrics", "logs"],
    f"""{_CLASSED} SELECT name, CASE WHEN category IN ('traffic', 'network', 'other') THEN 'both' ELSE 'up' END AS direction,
    category IN ({", ".join(repr(x) for x in fg.LOCAL)}) AS is_local, starts_with(name, 'system.') OR starts_with(name, 'host.') OR starts_with(name, 'node_') AS host_scoped,
    CASE WHEN category IN ('cpu','memory','disk','network','connections','runtime') THEN 'resource' WHEN category IN ('self_time','error_origin') THEN 'trace_local'
    WHEN category = 'other' THEN 'other' ELSE category END AS grp FROM k""",
)
def metric_direction(metrics, logs):
    n = _names(metrics, logs)
    c = fg.category(F.col("name"))
    return n.select("name", fg.direction(c).alias("direction"), fg.is_local(c).alias("is_local"), fg.is_host_scoped(F.col("name")).alias("host_scoped"), fg.group(c).alias("grp"))


@query(
    "harmful_deviation", ["series"],
    f"""SELECT service, name, win, {r("greatest(value - 50, 0)")} AS up, {r("greatest(50 - value, 0)")} AS down, {r("abs(value - 50)")} AS both_ways FROM series WHERE value IS NOT NULL""",
)
def harmful_deviation(series):
    z = F.col("value") - 50
    return series.filter("value is not null").select("service", "name", "win", *(fg.harmful(z, F.lit(d)).alias(n) for d, n in (("up", "up"), ("down", "down"), ("both", "both_ways"))))


def _attributed(spans):
    """Spans with attribute maps such as instrumentation sends."""
    http = F.when(F.col("status") == "error", 400 + (F.col("span_id") % 3) * 50).otherwise(200)
    pairs = F.array(
        F.struct(F.lit("http.status_code").alias("k"), http.cast("string").alias("v")), F.struct(F.lit("peer.service").alias("k"), F.when(F.col("span_id") % 2 == 0, F.col("peer")).otherwise("").alias("v")),
        F.struct(F.lit("server.address").alias("k"), F.concat(F.lit("host-"), (F.col("trace_id") % 7).cast("string")).alias("v")),
    )
    return spans.withColumns({"attrs": F.map_from_entries(pairs), "http": http.cast("int"), "grpc": (F.col("trace_id") % 17).cast("int"), "code": F.when(F.col("span_id") % 5 == 0, F.col("trace_id") % 3).cast("int")})


@query(
    "otlp_status", ["spans"],
    """WITH s AS (SELECT trace_id, span_id, kind, CASE WHEN span_id % 5 = 0 THEN trace_id % 3 END AS code, CASE WHEN span_id % 3 = 0 THEN CASE WHEN status = 'error' THEN 400 + (span_id % 3) * 50 ELSE 200 END END AS http, trace_id % 17 AS grpc FROM spans)
    SELECT trace_id, span_id, CASE WHEN code = 1 THEN 'ok' WHEN code = 2 THEN 'error' WHEN http IS NOT NULL THEN CASE WHEN http >= CASE WHEN kind IN ('client', 'producer') THEN 400 ELSE 500 END THEN 'error' ELSE 'unset' END
    WHEN kind IN ('client', 'producer') AND grpc <> 0 OR kind NOT IN ('client', 'producer') AND grpc IN (2, 4, 12, 13, 14, 15) THEN 'error' ELSE 'unset' END AS derived FROM s""",
)
def otlp_status(spans):
    s = _attributed(spans)
    http = F.when(F.col("span_id") % 3 == 0, F.col("http"))
    return s.select("trace_id", "span_id", fs.status(F.col("code"), http, F.col("grpc"), F.col("kind")).alias("derived"))


@query(
    "peer_select", ["spans"],
    """SELECT trace_id, span_id, CASE WHEN kind IN ('client', 'producer') THEN coalesce(nullif(CASE WHEN span_id % 2 = 0 THEN peer ELSE '' END, ''), concat('host-', CAST(trace_id % 7 AS VARCHAR))) ELSE '' END AS chosen,
    kind IN ('server', 'consumer') AS inbound, greatest(end_ns - start_ns, 0) AS duration_ns FROM spans""",
)
def peer_select(spans):
    s = _attributed(spans)
    return s.select("trace_id", "span_id", fs.peer(F.col("attrs"), F.col("kind")).alias("chosen"), fs.is_inbound(F.col("kind")).alias("inbound"), fs.duration(F.col("start_ns"), F.col("end_ns")).alias("duration_ns"))


@query(
    "entity_name", ["logs"],
    """SELECT DISTINCT service, n, CASE n WHEN 0 THEN concat('ns/', service) WHEN 1 THEN concat(service, '-deploy') WHEN 2 THEN concat('host:', service) ELSE 'unknown_service' END AS entity FROM (SELECT service, (ts_us // 1000000) % 4 AS n FROM logs)""",
)
def entity_name(logs):
    n = (F.expr("ts_us div 1000000") % 4).alias("n")
    base = logs.select("service", n).distinct()
    e = lambda k, v: F.struct(F.lit(k).alias("k"), v.alias("v"))
    maps = F.when(F.col("n") == 0, F.array(e("service.name", F.col("service")), e("service.namespace", F.lit("ns")))).when(
        F.col("n") == 1, F.array(e("service.name", F.lit("unknown_service:x")), e("k8s.deployment.name", F.concat("service", F.lit("-deploy"))))
    ).when(F.col("n") == 2, F.array(e("host.name", F.col("service")))).otherwise(F.array(e("other", F.lit("x"))))
    return base.select("service", "n", fs.entity(F.map_from_entries(maps), True).alias("entity"))


@query(
    "stream_identity", ["spans"],
    "SELECT count(*) AS spans, count(DISTINCT concat(peer, '|', CAST(trace_id % 7 AS VARCHAR), '|', service)) AS streams FROM spans WHERE kind = 'client'",
)
def stream_identity(spans):
    c = spans.filter("kind = 'client'")
    pair = lambda k, v: F.struct(F.lit(k).alias("k"), v.alias("v"))
    a, b = pair("peer", F.col("peer")), pair("slot", (F.col("trace_id") % 7).cast("string"))
    # The same attributes in another order are the same stream.
    m = F.when(F.col("span_id") % 2 == 0, F.map_from_entries(F.array(a, b))).otherwise(F.map_from_entries(F.array(b, a)))
    return c.agg(F.count("*").alias("spans"), F.count_distinct(fs.attribute_hash(m, F.col("service"))).alias("streams"))


@query(
    "severity_number", ["logs"],
    "SELECT service, ts_us, n, CASE WHEN n BETWEEN 1 AND 12 THEN 'info' WHEN n BETWEEN 13 AND 16 THEN 'warn' WHEN n BETWEEN 17 AND 24 THEN 'error' END AS severity FROM (SELECT service, ts_us, (ts_us // 1000000) % 27 AS n FROM logs)",
)
def severity_number(logs):
    n = F.expr("ts_us div 1000000") % 27
    return logs.select("service", "ts_us", n.alias("n"), fl.severity_of_number(n).alias("severity"))


#: Bodies with words that decide a severity, as the texts themselves hold none.
BODY = "concat(CASE (ts_us // 1000000) % 6 WHEN 0 THEN 'ERROR ' WHEN 1 THEN 'java.lang.NullPointerException: ' WHEN 2 THEN 'warning: ' WHEN 3 THEN 'request 42 from 10.0.0.1 ' ELSE '' END, coalesce(body, ''))"
_WORDS = "list_filter(regexp_split_to_array(lower(b), '[^a-z0-9]'), lambda w: length(w) BETWEEN 4 AND 64)"
_SEVERITY = f"""CASE WHEN len(list_filter({_WORDS}, lambda w: length(w) > 9 AND (ends_with(w, 'exception') OR ends_with(w, 'error')))) > 0
    OR list_has_any({_WORDS}, [{", ".join(repr(w) for w in fl.ERROR_WORDS)}]) THEN 'error' WHEN list_has_any({_WORDS}, ['warn', 'warning']) THEN 'warn' ELSE 'info' END"""


def bodies(logs):
    lead = F.expr("CASE (ts_us div 1000000) % 6 WHEN 0 THEN 'ERROR ' WHEN 1 THEN 'java.lang.NullPointerException: ' WHEN 2 THEN 'warning: ' WHEN 3 THEN 'request 42 from 10.0.0.1 ' ELSE '' END")
    return logs.withColumn("body", F.concat(lead, F.coalesce("body", F.lit(""))))


@query("severity_text", ["logs"], f"SELECT service, ts_us, {_SEVERITY} AS severity FROM (SELECT service, ts_us, {BODY} AS b FROM logs)")
def severity_text(logs):
    return bodies(logs).select("service", "ts_us", fl.severity_of_text(F.col("body")).alias("severity"))


_TOKENS = "list_filter(regexp_split_to_array(b, '[ \\t\\n\\r\\f]+'), lambda t: t <> '')[1:64]"
_MASKED = f"list_transform({_TOKENS}, lambda t: CASE WHEN regexp_matches(t, '[0-9]') OR regexp_matches(t, '^[0-9a-fA-F]{{12,}}$') THEN '<*>' ELSE t END)"
_SIGNED = f"SELECT service, ts_us, b, array_to_string({_MASKED}, ' ') AS template FROM (SELECT service, ts_us, {BODY} AS b FROM logs)"


@query("mask_tokens", ["logs"], f"SELECT service, ts_us, len({_TOKENS}) AS n_tokens, coalesce(array_to_string({_MASKED}, ' '), '') AS template FROM (SELECT service, ts_us, {BODY} AS b FROM logs)")
def mask_tokens(logs):
    b = bodies(logs)
    return b.select("service", "ts_us", F.size(fl.tokens(F.col("body"))).cast("long").alias("n_tokens"), fl.signature(F.col("body")).alias("template"))


@query(
    "line_similarity", ["logs"],
    f"""SELECT service, ts_us, {r("CASE WHEN len(t) = 0 THEN 1 ELSE list_sum(list_transform(range(1, len(t) + 1), lambda i: CAST(t[i] = u[i] AS INT))) / CAST(len(t) AS DOUBLE) END")} AS similarity
    FROM (SELECT *, list_reverse(t) AS u FROM (SELECT service, ts_us, {_MASKED} AS t FROM (SELECT service, ts_us, {BODY} AS b FROM logs)))""",
)
def line_similarity(logs):
    """Of each line's masked words and the same words in reverse."""
    words = fl.masked(F.col("body"))
    return bodies(logs).select("service", "ts_us", fl.similarity(words, F.reverse(words)).alias("similarity"))


@query("template_signature", ["logs"], f"SELECT service, template, count(*) AS n, min(ts_us) AS first_seen FROM ({_SIGNED}) GROUP BY 1, 2")
def template_signature(logs):
    return bodies(logs).groupBy("service", fl.signature(F.col("body")).alias("template")).agg(F.count("*").alias("n"), F.min("ts_us").alias("first_seen"))


@query("parsed_category", ["metrics", "logs"], f"{_CLASSED} SELECT name, category FROM k")
def parsed_category(metrics, logs):
    return _names(metrics, logs).select("name", fg.parse_category(fg.category(F.col("name"))).alias("category"))


@query("parsed_id", ["spans"], "SELECT DISTINCT trace_id, span_id, trace_id * 4096 + span_id AS id FROM spans")
def parsed_id(spans):
    hex_ = F.lower(F.hex(F.col("trace_id") * 4096 + F.col("span_id")))
    return spans.select("trace_id", "span_id", fs.parsed_id(hex_).alias("id")).distinct()


_AFTER = 200_000_000
_NOVEL = f"SELECT *, min(ts_us) OVER (PARTITION BY service, template) AS first_seen FROM ({_SIGNED})"


@query("log_novelty", ["logs"], f"SELECT service, ts_us, first_seen, first_seen > {_AFTER} AS novel FROM ({_NOVEL})")
def log_novelty(logs):
    return ol.with_novelty(bodies(logs), _AFTER).select("service", "ts_us", "first_seen", "novel")


@query("log_novelty_streaming", ["logs"], f"SELECT service, ts_us, first_seen, first_seen >= greatest({_AFTER}, ts_us - 500000000) AS novel FROM ({_NOVEL})")
def log_novelty_streaming(logs):
    out = ol.with_streaming_novelty(bodies(logs), _AFTER // 2, _AFTER // 2, 500_000_000)
    return out.select("service", "ts_us", "first_seen", "novel")


_LOGWIN = f"""SELECT ts_us // 100000000 AS win, service, count(*) AS lines, count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (first_seen > {_AFTER}) AS novel
    FROM (SELECT *, {_SEVERITY} AS severity FROM ({_NOVEL})) GROUP BY 1, 2"""


@query("log_window_stats", ["logs"], _LOGWIN)
def log_window_stats(logs):
    return ow.log_windows(ol.with_severity(ol.with_novelty(bodies(logs), _AFTER)), 100_000_000)


@query(
    "log_series", ["logs"],
    f"""WITH w AS ({_LOGWIN}) SELECT win, service, name, category, 'zero' AS fill, {r("v / 100.0e0")} AS value FROM (SELECT win, service, 'log_lines' AS name, 'traffic' AS category, lines AS v FROM w
    UNION ALL SELECT win, service, 'log_errors', 'logs', errors FROM w UNION ALL SELECT win, service, 'log_novel_lines', 'logs', novel FROM w)""",
)
def log_series(logs):
    return ow.log_series(log_window_stats(logs), 100_000_000)


@query("drain_templates", ["logs"])
def drain_templates(logs):
    return ol.catalogue(ol.mined(bodies(logs)))


@query(
    "window_assign", ["metrics"],
    "SELECT ts_us, ts_us // 3600000000 AS win, (ts_us // 3600000000) * 3600000000 AS start_us, (ts_us - 1710000000000000) // 3600000000 - CASE WHEN ts_us < 1710000000000000 AND (ts_us - 1710000000000000) % 3600000000 <> 0 AND (ts_us - 1710000000000000) // 3600000000 > (ts_us - 1710000000000000) / 3600000000e0 THEN 1 ELSE 0 END AS before_epoch FROM metrics",
)
def window_assign(metrics):
    h = 3_600_000_000
    win = fn.window_of(F.col("ts_us"), h)
    return metrics.select("ts_us", win.alias("win"), fn.window_start(win, h).alias("start_us"), fn.window_of(F.col("ts_us") - 1710000000000000, h).alias("before_epoch"))


@query(
    "significant_digits", ["series"],
    """SELECT service, name, win, CASE WHEN value = 0 THEN '0' ELSE CASE CAST(greatest(0, least(8, 2 - floor(log10(abs(value))))) AS INTEGER)
    WHEN 0 THEN printf('%.0f', value) WHEN 1 THEN printf('%.1f', value) WHEN 2 THEN printf('%.2f', value) WHEN 3 THEN printf('%.3f', value) ELSE printf('%.4f', value) END END AS text
    FROM (SELECT service, name, win, round(value, 5) + 0.0000012345e0 AS value FROM series WHERE value IS NOT NULL)""",
)
def significant_digits(series):
    v = F.round("value", 5) + 0.0000012345
    return series.filter("value is not null").select("service", "name", "win", fn.significant(v).alias("text"))
