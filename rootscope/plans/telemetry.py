"""Queries of metrics, sketches, robust statistics and series."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics as om
from ..operators import robust as ro
from ..operators import sketch as sk
from ..operators import windows as ow
from .common import query, r

H = 3_600_000_000
G = sk.gamma()
_K = "service, name"


@query(
    "metric_windows", ["metrics"],
    f"""SELECT ts_us // {H} AS win, service, name, CASE WHEN name = 'error.count' THEN 'rate' WHEN name = 'cpu.usage' THEN 'level' ELSE 'stream_rate' END AS agg, {r("sum(value)")} AS total, count(*) AS n,
    {r("min(value)")} AS least, {r("max(value)")} AS most, count(DISTINCT stream) AS streams, {r("CASE WHEN name = 'error.count' THEN sum(value) / 3600 WHEN name = 'cpu.usage' THEN sum(value) / count(*) ELSE sum(value) / count(*) * count(DISTINCT stream) END")} AS value
    FROM metrics GROUP BY 1, 2, 3""",
)
def metric_windows(metrics):
    agg = F.when(F.col("name") == "error.count", "rate").when(F.col("name") == "cpu.usage", "level").otherwise("stream_rate")
    return ow.metric_windows(metrics.withColumn("agg", agg), H)


@query(
    "calendar_fill", ["metrics"],
    f"""WITH w AS (SELECT service, name, ts_us // {H} AS win, avg(value) AS value FROM metrics GROUP BY 1, 2, 3), g AS (SELECT service, name, win FROM (SELECT DISTINCT service, name FROM w), (SELECT unnest(range((SELECT min(win) FROM w), (SELECT max(win) + 1 FROM w))) AS win))
    SELECT g.service, g.name, g.win, {r("coalesce(value, 0)")} AS value FROM g LEFT JOIN w USING (service, name, win)""",
)
def calendar_fill(metrics):
    w = metrics.groupBy("service", "name", F.expr(f"ts_us div {H}").alias("win")).agg(F.avg("value").alias("value"))
    return ow.calendar(w, ["service", "name"], {"value": 0.0})


@query(
    "series_created", ["metrics"],
    f"SELECT service, name, min(ts_us // {H}) AS created FROM metrics GROUP BY 1, 2 ORDER BY created, service, name LIMIT 10",
)
def series_created(metrics):
    return ow.created(metrics.withColumn("win", F.expr(f"ts_us div {H}")), 10)


@query("series_retained", ["series"], f"SELECT service, name, win, {r('value')} AS value, t_s FROM series WHERE win > (SELECT max(win) FROM series) - 40")
def series_retained(series):
    return ow.retained(series, 40)


_COUNTER = """SELECT *, CASE WHEN reset THEN value ELSE value - pv END AS delta, ts_us - CASE WHEN reset AND start_us > pt AND start_us < ts_us THEN start_us ELSE pt END AS elapsed_us
    FROM (SELECT *, value < pv OR start_us <> 0 AND start_us <> ps AS reset FROM (SELECT *, lag(value) OVER w AS pv, lag(ts_us) OVER w AS pt, lag(start_us) OVER w AS ps
    FROM counters WINDOW w AS (PARTITION BY stream, service ORDER BY ts_us)) WHERE pt IS NOT NULL)"""


@query(
    "counter_rates", ["counters"],
    f"SELECT stream, service, ts_us, reset, {r('delta')} AS delta, elapsed_us, {r('delta / (elapsed_us / 1e6)')} AS rate FROM ({_COUNTER})",
)
def counter_rates(counters):
    return om.counter_rates(counters.withColumn("name", F.lit("count"))).select("stream", "service", "ts_us", "reset", "delta", "elapsed_us", "rate")


@query(
    "metric_points", ["counters"],
    f"""SELECT service, agg, count(*) AS n, {r("sum(value)")} AS total FROM (SELECT service, 'level' AS agg, value FROM counters WHERE stream % 3 = 0 UNION ALL SELECT service, 'rate', value FROM counters WHERE stream % 3 = 1
    UNION ALL SELECT service, 'stream_rate', delta / (elapsed_us / 1e6) FROM ({_COUNTER}) WHERE stream % 3 = 2) GROUP BY 1, 2""",
)
def metric_points(counters):
    kind = F.element_at(F.array(F.lit("gauge"), F.lit("delta"), F.lit("cumulative")), (F.col("stream") % 3 + 1).cast("int"))
    p = om.as_points(counters.withColumns({"kind": kind, "name": F.lit("count")}))
    return p.groupBy("service", "agg").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


@query(
    "metric_kinds", ["counters"],
    "SELECT service, CASE WHEN stream % 4 = 0 THEN 'gauge' WHEN stream % 2 = 0 THEN 'gauge' WHEN stream % 3 = 0 THEN 'delta' ELSE 'cumulative' END AS kind, count(*) AS n FROM counters GROUP BY 1, 2",
)
def metric_kinds(counters):
    s = F.col("stream")
    c = counters.withColumns({"otlp_type": F.when(s % 4 == 0, "gauge").otherwise("sum"), "monotonic": s % 2 == 1, "temporality": F.when(s % 3 == 0, "delta").otherwise("unspecified")})
    return om.kind_of(c).groupBy("service", "kind").agg(F.count("*").alias("n"))


_X = "value * 1000000"
_BUCKET = f"CASE WHEN v >= 1 THEN CAST(ceil(ln(v) * (1 / ln({G!r}e0))) AS BIGINT) END"
_ADD = f"SELECT {_K}, {_BUCKET} AS bucket, count(*) AS n, min(v) AS least, max(v) AS most, sum(v) AS total FROM (SELECT {_K}, {_X} AS v FROM metrics) GROUP BY 1, 2, 3"


def quantile_sql(source: str, keys: str, qs: dict[str, float]) -> str:
    value = f"CASE WHEN bucket IS NULL THEN greatest(0, lo) ELSE least(greatest(2 * pow({G!r}e0, bucket) / ({G!r}e0 + 1), lo), hi) END"
    picks = ", ".join(f"min(CASE WHEN cum > floor({q}e0 * (tn - 1)) THEN {value} END) AS {n}" for n, q in qs.items())
    return f"""SELECT {keys}, {picks}, sum(n) AS cnt, sum(total) AS total, min(least) AS least, max(most) AS most FROM (SELECT *, sum(n) OVER (PARTITION BY {keys} ORDER BY bucket NULLS FIRST) AS cum, sum(n) OVER (PARTITION BY {keys}) AS tn,
        min(least) OVER (PARTITION BY {keys}) AS lo, max(most) OVER (PARTITION BY {keys}) AS hi FROM ({source})) GROUP BY {keys}"""


_Q = {"p50": 0.5, "p95": 0.95, "p99": 0.99}
_OUT = f"{_K}, {r('p50 / 1e6')} AS p50, {r('p95 / 1e6')} AS p95, {r('p99 / 1e6')} AS p99, CAST(cnt AS BIGINT) AS count, {r('least / 1e6')} AS least, {r('most / 1e6')} AS most"


def _out(q):
    return q.select("service", "name", "count", *((F.col(c) / 1e6).alias(c) for c in ("p50", "p95", "p99", "least", "most")))


def _scaled(metrics):
    return metrics.withColumn("v", F.col("value") * 1000000)


@query("ddsketch_quantiles", ["metrics"], f"SELECT {_OUT} FROM ({quantile_sql(_ADD, _K, _Q)})")
def ddsketch_quantiles(metrics):
    return _out(sk.quantiles(sk.add(_scaled(metrics), ["service", "name"], "v"), ["service", "name"], _Q))


@query("ddsketch_merge", ["metrics"], f"SELECT {_OUT} FROM ({quantile_sql(_ADD, _K, _Q)})")
def ddsketch_merge(metrics):
    k = ["service", "name"]
    a, b = (sk.add(_scaled(metrics).filter(F.col("stream") % 2 == i), k, "v") for i in (0, 1))
    return _out(sk.quantiles(sk.merge(a, b, k), k, _Q))


@query(
    "ddsketch_collapse", ["metrics"],
    f"SELECT {_K}, bucket, CAST(sum(n) AS BIGINT) AS n FROM (SELECT {_K}, n, CASE WHEN bucket IS NOT NULL THEN greatest(bucket, max(bucket) OVER (PARTITION BY {_K}) - 63) END AS bucket FROM ({_ADD})) GROUP BY 1, 2, 3",
)
def ddsketch_collapse(metrics):
    k = ["service", "name"]
    return sk.collapse(sk.add(_scaled(metrics), k, "v"), k, 64).select(*k, "bucket", "n")


SUMMARY = f"""WITH b AS (SELECT {_K}, count(value) AS n, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS iqr, avg(value) AS mean, stddev_samp(value) AS sd, min(value) AS least, max(value) AS most
    FROM {{t}} WHERE value IS NOT NULL GROUP BY 1, 2), m AS (SELECT x.service, x.name, quantile_cont(abs(value - median), 0.5) AS mad FROM {{t}} x JOIN b ON x.service = b.service AND x.name = b.name WHERE value IS NOT NULL GROUP BY 1, 2),
    s AS (SELECT b.*, mad, greatest(1.4826e0 * mad, 0.7413e0 * iqr) AS sigma FROM b JOIN m USING (service, name))"""


@query(
    "robust_summary", ["metrics"],
    f"{SUMMARY.format(t='metrics')} SELECT {_K}, n, {', '.join(f'{r(c)} AS {c}' for c in ('mean', 'sd', 'least', 'most', 'median', 'iqr', 'mad'))}, round(sigma, 5) AS sigma FROM s",
)
def robust_summary(metrics):
    return ro.summary(metrics, ["service", "name"]).withColumn("sigma", F.round("sigma", 5))


@query("welford_merge", ["metrics"], f"SELECT {_K}, count(*) AS n, {r('avg(value)')} AS mean, {r('var_samp(value)')} AS variance FROM metrics GROUP BY 1, 2")
def welford_merge(metrics):
    k = ["service", "name"]
    parts = ro.moments(metrics.withColumn("part", F.col("stream") % 8), [*k, "part"]).drop("part")
    return ro.merged_moments(parts, k)


@query(
    "ewm", ["series"],
    f"""WITH x AS (SELECT {_K}, value, row_number() OVER (PARTITION BY {_K} ORDER BY win) AS i FROM series WHERE value IS NOT NULL),
    e AS (SELECT {_K}, i, value AS m, 0e0 AS v FROM x WHERE i = 1 UNION ALL SELECT x.service, x.name, x.i, e.m + {1 - 0.5 ** 0.1!r}e0 * (x.value - e.m), (1 - {1 - 0.5 ** 0.1!r}e0) * (e.v + {1 - 0.5 ** 0.1!r}e0 * (x.value - e.m) * (x.value - e.m))
    FROM e JOIN x ON x.service = e.service AND x.name = e.name AND x.i = e.i + 1) SELECT {_K}, {r("m")} AS ewm_mean, {r("v")} AS ewm_var FROM e WHERE (service, name, i) IN (SELECT service, name, max(i) FROM x GROUP BY 1, 2)""",
    recursive=True,
)
def ewm(series):
    return ro.weighted_mean(series, ["service", "name"], "win", 10)


SLIDING = f"""WITH w AS (SELECT *, list(value) OVER f AS ws, stddev_samp(value) OVER f AS sd, quantile_cont(value, 0.5) OVER f AS median, quantile_cont(value, 0.75) OVER f - quantile_cont(value, 0.25) OVER f AS iqr FROM series WHERE value IS NOT NULL
    WINDOW f AS (PARTITION BY {_K} ORDER BY win ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING)), d AS (SELECT *, len(ws) AS n, list_sort(list_transform(ws, lambda x: abs(x - median))) AS ds FROM w)"""
_MAD = "CASE WHEN n > 0 THEN (ds[CAST(floor(0.5e0 * (n - 1)) AS INT) + 1] + ds[CAST(ceil(0.5e0 * (n - 1)) AS INT) + 1]) / 2 END"


@query("sliding_robust", ["series"], f"{SLIDING} SELECT {_K}, win, coalesce(n, 0) AS n, {r('median')} AS median, {r('iqr')} AS iqr, {r('sd')} AS sd, {r(_MAD)} AS mad FROM d")
def sliding_robust(series):
    return ro.sliding(series, ["service", "name"], "win", 60).select("service", "name", "win", "n", "median", "iqr", "sd", "mad")


@query(
    "conformal_p", ["series"],
    f"""{SLIDING}, p AS (SELECT *, (1 + len(list_filter(ws, lambda v: v >= value))) / (1e0 + n) AS up, (1 + len(list_filter(ws, lambda v: v <= value))) / (1e0 + n) AS down FROM d WHERE n >= 20)
    SELECT {_K}, win, {r("CASE win % 3 WHEN 0 THEN up WHEN 1 THEN down ELSE least(2 * least(up, down), 1) END")} AS p FROM p""",
)
def conformal_p(series):
    s = ro.sliding(series, ["service", "name"], "win", 60).filter("n >= 20")
    s = s.withColumn("direction", F.element_at(F.array(F.lit("up"), F.lit("down"), F.lit("both")), (F.col("win") % 3 + 1).cast("int")))
    return s.select("service", "name", "win", ro.conformal_p("__w", "value", "direction").alias("p"))


CUSUM = """c0 AS (SELECT *, sum(z - {k}e0) OVER o AS pu, sum(-z - {k}e0) OVER o AS pl, row_number() OVER o AS i FROM {t} WINDOW o AS (PARTITION BY service, name ORDER BY win)),
    c1 AS (SELECT *, pu - least(0, min(pu) OVER o) AS up, pl - least(0, min(pl) OVER o) AS down FROM c0 WINDOW o AS (PARTITION BY service, name ORDER BY win)),
    c2 AS (SELECT *, coalesce(max(CASE WHEN up <= 1e-9 THEN i END) OVER o, 0) AS u0, coalesce(max(CASE WHEN down <= 1e-9 THEN i END) OVER o, 0) AS d0 FROM c1 WINDOW o AS (PARTITION BY service, name ORDER BY win))"""
_Z = f"z AS (SELECT {_K}, win, (value - avg(value) OVER (PARTITION BY {_K})) / stddev_pop(value) OVER (PARTITION BY {_K}) AS z FROM series WHERE value IS NOT NULL)"


@query(
    "cusum", ["series"],
    f"""WITH {_Z}, {CUSUM.format(k=0.5, t="z")} SELECT {_K}, win, {r("up")} AS cusum_up, {r("down")} AS cusum_down, up > 3 AS alarm_up, down > 3 AS alarm_down, CASE WHEN up > 3 AND (down <= 3 OR up >= down) THEN u0 WHEN down > 3 THEN d0 END AS onset FROM c2""",
)
def cusum(series):
    from pyspark.sql import Window

    w = Window.partitionBy("service", "name")
    z = series.filter("value is not null").withColumn("z", (F.col("value") - F.avg("value").over(w)) / F.stddev_pop("value").over(w))
    c = ro.cusum(z, ["service", "name"], "win", "z", 0.5, 3.0)
    return c.select("service", "name", "win", "cusum_up", "cusum_down", "alarm_up", "alarm_down", "onset")


@query(
    "change_point", ["series"],
    f"""WITH x AS (SELECT {_K}, win, value, row_number() OVER o - 1 AS tau, count(value) OVER b AS n1, sum(value) OVER b AS s1, count(value) OVER g AS n, sum(value) OVER g AS s, var_pop(value) OVER g AS va, count(*) OVER g AS len FROM series
    WINDOW o AS (PARTITION BY {_K} ORDER BY win), b AS (PARTITION BY {_K} ORDER BY win ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), g AS (PARTITION BY {_K})),
    y AS (SELECT *, s1 / n1 AS m1, (s - s1) / (n - n1) AS m2, n1 * (n - n1) / CAST(n AS DOUBLE) * pow((s - s1) / (n - n1) - s1 / n1, 2) AS bt FROM x WHERE tau >= 2 AND tau < len - 1 AND n1 >= 2 AND n - n1 >= 2 AND n >= 4),
    z AS (SELECT *, row_number() OVER (PARTITION BY {_K} ORDER BY round(bt, 9) DESC, tau) AS k FROM y) SELECT {_K}, tau, {r("(m2 - m1) / sqrt(greatest(va - bt / n, 1e-12))")} AS shift FROM z WHERE k = 1""",
)
def change_point(series):
    return ro.change_point(series, ["service", "name"], "win")


@query(
    "incident_upsert", ["ranks"],
    "SELECT dataset AS id, method, case_id AS seq FROM (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY case_id DESC) AS k FROM ranks) WHERE k = 1",
)
def incident_upsert(ranks):
    from ..sources.sinks import upserted

    rows = ranks.select(F.col("dataset").alias("id"), "method", F.col("case_id").alias("seq"))
    return upserted(rows.filter("seq % 2 = 0"), rows.filter("seq % 2 = 1"))


@query(
    "shown_rates", ["counters"],
    f"""SELECT stream, service, ts_us, {r("(value - pv) / ((ts_us - pt) / 1e6)")} AS rate FROM (SELECT *, lag(value) OVER (PARTITION BY stream, service ORDER BY ts_us) AS pv,
    lag(ts_us) OVER (PARTITION BY stream, service ORDER BY ts_us) AS pt FROM counters) WHERE value >= pv AND ts_us > pt""",
)
def shown_rates(counters):
    return om.shown_rates(counters).select("stream", "service", "ts_us", "rate")
