"""Queries of traces, graphs, scores, rankings, incidents and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import ScoreConfig
from ..operators import analyze as oa
from ..operators import detector as od
from ..operators import evaluation as oe
from ..operators import graph as og
from ..operators import incidents as oi
from ..operators import ranking as ork
from ..operators import scores as os_
from ..operators import traces as ot
from ..operators import windows as ow
from ..tables import stored
from .common import case, query, r
from .telemetry import CUSUM, SLIDING, SUMMARY, quantile_sql, G
from ..functions import signals as fg

W = 7 * 86_400_000_000_000
_T = 604_800  # seconds of a window

_LINK = """p AS (SELECT s.*, q.service AS pservice FROM (SELECT *, CASE WHEN parent_id <> 0 AND parent_id <> span_id THEN parent_id END AS link FROM spans) s
    LEFT JOIN (SELECT trace_id AS qt, span_id AS qid, service FROM spans) q ON s.trace_id = q.qt AND s.link = q.qid)"""
#: Offsets and entry spans by recursion from the roots.
TREE = f"""{_LINK}, t AS (SELECT trace_id, span_id, service, kind, status, peer, start_ns AS a, end_ns AS b, span_id AS entry_id, true AS root, false AS moved FROM p WHERE pservice IS NULL
    UNION ALL SELECT c.trace_id, c.span_id, c.service, c.kind, c.status, c.peer, c.start_ns + c.off, c.end_ns + c.off, CASE WHEN c.service = c.ps THEN c.pe ELSE c.span_id END, false, c.mv FROM
    (SELECT c.*, t.service AS ps, t.entry_id AS pe, t.a - q.start_ns + CASE WHEN {{m}} THEN t.a + (greatest(t.b - t.a, 0) - greatest(c.end_ns - c.start_ns, 0)) // 2 - (c.start_ns + t.a - q.start_ns) ELSE 0 END AS off, {{m}} AS mv
    FROM t JOIN spans q ON q.trace_id = t.trace_id AND q.span_id = t.span_id JOIN p c ON c.trace_id = t.trace_id AND c.parent_id = t.span_id AND c.pservice IS NOT NULL) c)""".replace(
    "{m}", "(c.service <> t.service AND (c.start_ns + t.a - q.start_ns < t.a OR c.end_ns + t.a - q.start_ns > t.b) AND greatest(c.end_ns - c.start_ns, 0) <= greatest(t.b - t.a, 0))"
)
CALLS = """x AS (SELECT u.trace_id, u.span_id, u.entry_id, u.service, u.kind, c.span_id AS cid, c.service AS cservice, c.a AS ca, c.b AS cb, c.status = 'error' AS cerr FROM t u JOIN spans o ON o.trace_id = u.trace_id AND o.parent_id = u.span_id
    JOIN t c ON c.trace_id = o.trace_id AND c.span_id = o.span_id AND NOT c.root WHERE c.service <> u.service),
    y AS (SELECT trace_id, span_id, arg_min(cservice, cid) AS answered, bool_or(cerr) AS cerr FROM x WHERE kind = 'client' GROUP BY 1, 2),
    e AS (SELECT trace_id, entry_id, service AS caller, cservice AS callee, ca AS a, cb AS b, cerr AS error, false AS virtual_callee FROM x WHERE kind <> 'client'
    UNION ALL SELECT * FROM (SELECT t.trace_id, t.entry_id, t.service, coalesce(answered, nullif(peer, '')) AS callee, t.a, t.b, t.status = 'error' OR coalesce(cerr, false), answered IS NULL FROM t LEFT JOIN y USING (trace_id, span_id) WHERE kind = 'client') WHERE callee IS NOT NULL)"""
VISITS = """i AS (SELECT e.trace_id, e.entry_id, greatest(e.a, t.a) AS lo, least(e.b, t.b) AS hi FROM e JOIN t ON t.trace_id = e.trace_id AND t.span_id = e.entry_id),
    j AS (SELECT *, max(hi) OVER (PARTITION BY trace_id, entry_id ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached FROM i WHERE hi > lo),
    k AS (SELECT trace_id, entry_id, sum(greatest(0, hi - greatest(lo, coalesce(reached, lo)))) AS waited FROM j GROUP BY 1, 2),
    v AS (SELECT t.trace_id, t.span_id, t.service, t.b AS end_ns, greatest(t.b - t.a, 0) AS duration_ns, CAST(greatest(greatest(t.b - t.a, 0) - coalesce(waited, 0), 0) AS BIGINT) AS local_ns, t.status = 'error' AS error, t.root
    FROM t LEFT JOIN k ON k.trace_id = t.trace_id AND k.entry_id = t.span_id WHERE t.entry_id = t.span_id)"""
ORIGINS = """g AS (SELECT s.trace_id, s.span_id, s.b AS end_ns, CASE WHEN s.kind = 'client' AND s.peer <> '' AND NOT EXISTS (SELECT 1 FROM spans c WHERE c.trace_id = s.trace_id AND c.parent_id = s.span_id AND c.service <> s.service) THEN s.peer ELSE s.service END AS service
    FROM t s WHERE s.status = 'error' AND NOT EXISTS (SELECT 1 FROM spans c WHERE c.trace_id = s.trace_id AND c.parent_id = s.span_id AND c.status = 'error'))"""


@query("span_dedup", ["spans"], "SELECT count(*) AS n, count(DISTINCT trace_id) AS traces, CAST(sum(span_id) AS BIGINT) AS ids FROM spans")
def span_dedup(spans):
    twice = spans.union(spans.filter("span_id % 2 = 0"))
    return ot.deduplicated(twice).agg(F.count("*").alias("n"), F.count_distinct("trace_id").alias("traces"), F.sum("span_id").alias("ids"))


@query("span_parent_join", ["spans"], f"WITH {_LINK} SELECT trace_id, span_id, pservice AS parent_service, parent_id <> 0 AND pservice IS NULL AS orphan FROM p")
def span_parent_join(spans):
    return ot.linked(spans).select("trace_id", "span_id", "parent_service", "orphan")


@query("orphan_spans", ["spans"], "SELECT trace_id, span_id, service FROM spans s WHERE parent_id <> 0 AND NOT EXISTS (SELECT 1 FROM spans q WHERE q.trace_id = s.trace_id AND q.span_id = s.parent_id AND q.span_id <> s.span_id)")
def orphan_spans(spans):
    return ot.orphans(spans).select("trace_id", "span_id", "service")


@query("skew_offsets", ["spans"], f"WITH {TREE} SELECT t.trace_id, t.span_id, t.a - s.start_ns AS offset_ns, entry_id, root, moved FROM t JOIN spans s USING (trace_id, span_id)", recursive=True)
def skew_offsets(spans):
    return ot.offsets(spans).select("trace_id", "span_id", "offset_ns", "entry_id", "root", "moved")


@query("call_edges", ["spans"], f"WITH {TREE}, {CALLS} SELECT trace_id, caller, callee, b AS end_ns, greatest(b - a, 0) AS duration_ns, error, virtual_callee FROM e", recursive=True)
def call_edges(spans):
    return ot.calls(ot.assembled(spans)).select("trace_id", "caller", "callee", "end_ns", "duration_ns", "error", "virtual_callee")


@query("service_visits", ["spans"], f"WITH {TREE}, {CALLS}, {VISITS} SELECT * FROM v", recursive=True)
def service_visits(spans):
    return ot.visits(ot.assembled(spans)).drop("operation")


@query("interval_union", ["spans"], """WITH j AS (SELECT *, max(end_ns) OVER (PARTITION BY trace_id ORDER BY start_ns, end_ns ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached FROM spans WHERE end_ns > start_ns)
    SELECT trace_id, CAST(sum(greatest(0, end_ns - greatest(start_ns, coalesce(reached, start_ns)))) AS BIGINT) AS length FROM j GROUP BY 1""")  # fmt: skip
def interval_union(spans):
    return ot.union_length(spans, ["trace_id"], "start_ns", "end_ns")


@query("error_origins", ["spans"], f"WITH {TREE}, {ORIGINS} SELECT trace_id, span_id, service, end_ns FROM g", recursive=True)
def error_origins(spans):
    return ot.error_origins(ot.assembled(spans))


_COUNTS = f"""n AS (SELECT win, service, CAST(sum(q) AS BIGINT) AS requests, CAST(sum(e) AS BIGINT) AS errors, CAST(sum(o) AS BIGINT) AS roots, CAST(sum(g) AS BIGINT) AS error_origins FROM (SELECT end_ns // {W} AS win, service, 1 AS q, CAST(error AS INT) AS e, CAST(root AS INT) AS o, 0 AS g FROM v
    UNION ALL SELECT end_ns // {W}, service, 0, 0, 0, 1 FROM g) GROUP BY 1, 2)"""


@query("window_services", ["spans"], f"WITH {TREE}, {CALLS}, {VISITS}, {ORIGINS}, {_COUNTS} SELECT * FROM n", recursive=True)
def window_services(spans):
    c = stored(ot.assembled(spans), "traces")
    return ow.service_counts(ot.visits(c), ot.error_origins(c), W)


@query("window_edges", ["spans"], f"WITH {TREE}, {CALLS} SELECT b // {W} AS win, caller, callee, count(*) AS calls, count(*) FILTER (error) AS errors, bool_or(virtual_callee) AS any_virtual FROM e GROUP BY 1, 2, 3", recursive=True)
def window_edges(spans):
    return ow.edge_counts(ot.calls(ot.assembled(spans)), W)


@query("edge_catalogue", ["spans"], f"WITH {TREE}, {CALLS} SELECT caller, callee, count(*) AS calls, max(b // {W}) AS last_window FROM e GROUP BY 1, 2 HAVING (SELECT max(b // {W}) FROM e) - max(b // {W}) <= 360", recursive=True)
def edge_catalogue(spans):
    return ow.edge_catalogue(window_edges(spans))


@query("entry_points", ["spans"], f"WITH {TREE}, {CALLS}, {VISITS} SELECT service, max(end_ns // {W}) AS last_window FROM v WHERE root GROUP BY 1 HAVING (SELECT max(end_ns // {W}) FROM v) - max(end_ns // {W}) <= 360", recursive=True)
def entry_points(spans):
    return ow.entry_points(window_services(spans))


def _sketch_sql(source: str, keys: str, value: str) -> str:
    return f"SELECT {keys}, CASE WHEN x >= 1 THEN CAST(ceil(ln(x) * (1 / ln({G!r}e0))) AS BIGINT) END AS bucket, count(*) AS n, min(x) AS least, max(x) AS most, sum(x) AS total FROM (SELECT {keys}, {value} AS x FROM {source}) GROUP BY ALL"


_INBOUND = f"""qi AS ({quantile_sql(_sketch_sql(f"(SELECT b // {W} AS win, callee, CAST(greatest(b - a, 0) AS DOUBLE) AS d FROM e)", "win, callee", "d"), "win, callee", {"p95": 0.95})}),
    ci AS (SELECT b // {W} AS win, callee, count(*) AS calls, count(*) FILTER (error) AS errors FROM e GROUP BY 1, 2)"""
_INBOUND_ROWS = f"""SELECT win, callee AS service, 'inbound_requests' AS name, 'traffic' AS category, 'zero' AS fill, {r(f"calls / {_T}e0")} AS value FROM ci UNION ALL SELECT win, callee, 'inbound_error_rate', 'errors', 'missing', {r("errors / CAST(calls AS DOUBLE)")} FROM ci
    UNION ALL SELECT win, callee, 'inbound_latency_p95', 'latency', 'missing', {r("p95 / 1e6")} FROM qi"""


@query("inbound_series", ["spans"], f"WITH {TREE}, {CALLS}, {_INBOUND} {_INBOUND_ROWS}", recursive=True)
def inbound_series(spans):
    return ow.inbound_series(ot.calls(ot.assembled(spans)), W)


_VW = f"(SELECT end_ns // {W} AS win, service, CAST(duration_ns AS DOUBLE) AS d, CAST(local_ns AS DOUBLE) AS l FROM v)"
_OWN = f"""qd AS ({quantile_sql(_sketch_sql(_VW, "win, service", "d"), "win, service", {"p50": 0.5, "p95": 0.95})}), ql AS ({quantile_sql(_sketch_sql(_VW, "win, service", "l"), "win, service", {"l95": 0.95})}),
    z AS (SELECT n.*, p50, p95, l95 FROM n LEFT JOIN qd USING (win, service) LEFT JOIN ql USING (win, service))"""


@query(
    "trace_series", ["spans"],
    f"""WITH {TREE}, {CALLS}, {VISITS}, {ORIGINS}, {_COUNTS}, {_OWN}, {_INBOUND} SELECT win, service, 'trace_requests' AS name, 'traffic' AS category, 'zero' AS fill, {r(f"requests / {_T}e0")} AS value FROM z
    UNION ALL SELECT win, service, 'trace_error_rate', 'errors', 'missing', CASE WHEN requests > 0 THEN {r("errors / CAST(requests AS DOUBLE)")} END FROM z UNION ALL SELECT win, service, 'trace_latency_p50', 'latency', 'missing', CASE WHEN requests > 0 THEN {r("p50 / 1e6")} END FROM z
    UNION ALL SELECT win, service, 'trace_latency_p95', 'latency', 'missing', CASE WHEN requests > 0 THEN {r("p95 / 1e6")} END FROM z UNION ALL SELECT win, service, 'trace_local_p95', 'self_time', 'missing', CASE WHEN requests > 0 THEN {r("l95 / 1e6")} END FROM z
    UNION ALL SELECT win, service, 'trace_error_origins', 'error_origin', 'zero', CAST(error_origins AS DOUBLE) FROM z UNION ALL {_INBOUND_ROWS}""",
    recursive=True,
)
def trace_series(spans):
    c = stored(ot.assembled(spans), "traces")
    return ow.trace_series(ot.visits(c), ot.calls(c), ot.error_origins(c), W)


@query("summary_merge", ["spans"], f"WITH {TREE}, {CALLS}, {VISITS}, {ORIGINS}, {_COUNTS} SELECT * FROM n", recursive=True)
def summary_merge(spans):
    """Summaries of two halves of the traces, merged, are those of the whole."""
    parts = []
    for i in (0, 1):
        c = stored(ot.assembled(spans.filter(F.col("trace_id") % 2 == i)), "traces")
        parts.append(ow.service_counts(ot.visits(c), ot.error_origins(c), W))
    return ow.merge_all(parts, ["win", "service"])


@query("collector_merge", ["spans"], f"SELECT win, service, count(*) AS spans, count(*) FILTER (status = 'error') AS errors FROM (SELECT end_ns // {W} AS win, service, status FROM spans) GROUP BY 1, 2")
def collector_merge(spans):
    """Summaries from three edges, some sent twice."""
    s = spans.groupBy(
        (F.col("trace_id") % 3).cast("string").alias("edge"), F.expr(f"end_ns div {W}").alias("win"), "service"
    ).agg(F.count("*").alias("spans"), F.count_if(F.col("status") == "error").alias("errors"))
    m = s.withColumns({"epoch": F.lit(1), "seq": F.xxhash64("win", "service")})
    return ow.collected(m.union(m.filter("win % 2 = 0")), ["service"])


@query("graph_edges", ["graph"], "SELECT caller, callee, weight FROM graph")
def graph_edges(graph):
    halves = graph.withColumn("weight", F.col("weight") / 2)
    return og.edges(halves.union(halves).union(graph.select("caller", F.col("caller").alias("callee"), "weight")))


@query("graph_entry_points", ["graph"], "SELECT DISTINCT caller AS service FROM graph WHERE caller NOT IN (SELECT callee FROM graph)")
def graph_entry_points(graph):
    return og.entry_nodes(graph)


@query("graph_neighbours", ["graph"], "SELECT service, array_to_string((SELECT list_sort(list(callee)) FROM graph WHERE caller = service), ',') AS callees, array_to_string((SELECT list_sort(list(caller)) FROM graph WHERE callee = service), ',') AS callers FROM (SELECT caller AS service FROM graph UNION SELECT callee FROM graph)")
def graph_neighbours(graph):
    return og.neighbours(graph).select("service", F.array_join("callees", ",").alias("callees"), F.array_join("callers", ",").alias("callers"))


CLOSURE = "c AS (SELECT caller AS service, callee AS descendant FROM graph UNION SELECT c.service, g.callee FROM c JOIN graph g ON g.caller = c.descendant)"


@query("graph_closure", ["graph"], f"WITH {CLOSURE} SELECT service, descendant FROM c WHERE service <> descendant", recursive=True)
def graph_closure(graph):
    return og.closure(graph)


def _incident(series):
    return series.withColumn("incident", F.lit("a"))


_CAT = f"WITH q AS (SELECT *, lower(name) AS n, regexp_split_to_array(lower(name), '[^a-z0-9]') AS t FROM series), s AS (SELECT *, {case([('(' + ' OR '.join([f'contains(n, {x!r})' for x in h] + [f'list_contains(t, {x!r})' for x in w]) + ')', lab) for lab, h, w in fg.RULES], 'other')} AS category FROM q)"
_CFG = ScoreConfig()


def scores_sql(scaling: str) -> str:
    """CTEs ending in `sc`, the scores of `series`; no series of the adapter has a constant reference."""
    base = SUMMARY.format(t="(SELECT * FROM series WHERE t_s < 0)").removeprefix("WITH b AS").replace("s AS (SELECT b.*", "su AS (SELECT b.*")
    center, scale = {
        "robust": ("median", f"greatest(CASE WHEN sigma > 0 THEN sigma ELSE coalesce(sd, 0) END, {_CFG.rel_floor!r}e0 * abs(median))".replace("0.001e0", "1e-3")),
        "iqr": ("median", "CASE WHEN iqr < 2.22e-15 THEN 1 ELSE iqr END"), "nsigma": ("mean", "sd * sqrt((n - 1) / CAST(n AS DOUBLE))"),
    }[scaling]
    harm = "z" if scaling != "robust" else "CASE WHEN category IN ('traffic', 'network', 'other') THEN abs(z) ELSE greatest(z, 0) END"
    return f"""{_CAT}, b AS{base}, ce AS (SELECT service, name, {center} AS center, {scale} AS scale, median AS reference_median FROM su WHERE n >= 10),
        hz AS (SELECT s.*, center, scale, reference_median, (value - center) / scale AS z FROM s JOIN ce USING (service, name)), hh AS (SELECT *, {harm} AS harm FROM hz),
        ag AS (SELECT service, name, any_value(category) AS category, max(harm) AS mx, quantile_cont(harm, 0.5) AS sustained, (quantile_cont(value, 0.5) - any_value(center)) / any_value(scale) AS shift, any_value(reference_median) AS reference_median, any_value(scale) AS scale,
            arg_min(value, (-harm, t_s)) AS peak_value, arg_min(t_s, (-harm, t_s)) AS peak_offset_s FROM hh WHERE t_s >= 0 AND value IS NOT NULL GROUP BY 1, 2),
        ix AS (SELECT *, harm > 3 AS bad, sum(CASE WHEN harm > 3 THEN 0 ELSE 1 END) OVER (PARTITION BY service, name ORDER BY t_s) AS island FROM hh WHERE t_s >= -30 AND value IS NOT NULL),
        oy AS (SELECT service, name, min(ts) AS onset_s FROM (SELECT service, name, island, count(*) AS k, min(t_s) AS ts FROM ix WHERE bad GROUP BY 1, 2, 3) WHERE k >= 3 GROUP BY 1, 2),
        sc AS (SELECT ag.*, CAST(onset_s AS DOUBLE) AS onset_s FROM ag LEFT JOIN oy USING (service, name))"""


_SCORE = f"SELECT service, name, {r('mx')} AS max, {r('sustained')} AS sustained, {r('shift')} AS shift, onset_s, {r('reference_median')} AS reference_median, round(scale, 4) AS scale, {r('peak_value')} AS peak_value, CAST(peak_offset_s AS DOUBLE) AS peak_offset_s FROM sc"


def _scored(series, scaling):
    out = os_.scores(os_.classified(series), scaling)
    return out.withColumns({"onset_s": F.col("onset_s").cast("double"), "scale": F.round("scale", 4)})


for _name, _scaling in (("series_scores_robust", "robust"), ("series_scores_baro", "iqr"), ("series_scores_nsigma", "nsigma")):
    query(_name, ["series"], f"{scores_sql(_scaling)} {_SCORE}")(lambda series, s=_scaling: _scored(series, s))


@query(
    "went_silent", ["metrics"],
    """WITH k AS (SELECT DISTINCT service, stream % 40 AS name FROM metrics), w AS (SELECT DISTINCT ts_us // 21600000000 AS win FROM metrics), g AS (SELECT k.service, CAST(k.name AS VARCHAR) AS name, w.win, w.win * 21600 - 1705795200 AS t_s, v.value FROM k CROSS JOIN w
    LEFT JOIN (SELECT service, stream % 40 AS name, ts_us // 21600000000 AS win, avg(value) AS value FROM metrics WHERE NOT (stream % 5 = 0 AND ts_us > 1705795200000000) GROUP BY 1, 2, 3) v ON v.service = k.service AND v.name = k.name AND v.win = w.win),
    n AS (SELECT service, name, count(*) FILTER (t_s < 0) AS r, count(value) FILTER (t_s < 0) AS rf, count(*) FILTER (t_s >= 0) AS a, count(value) FILTER (t_s >= 0) AS af FROM g GROUP BY 1, 2)
    SELECT service, name, rf / CAST(r AS DOUBLE) >= 0.1e0 AND rf / CAST(r AS DOUBLE) * a >= 5 AND af <= 0.1e0 * (rf / CAST(r AS DOUBLE) * a) AS silent FROM n""",
)
def went_silent(metrics):
    m = metrics.withColumns({"name": F.col("stream") % 40, "win": F.expr("ts_us div 21600000000")})
    kept = m.filter("not (stream % 5 = 0 and ts_us > 1705795200000000)").groupBy("service", "name", "win").agg(F.avg("value").alias("value"))
    grid = m.select("service", "name").distinct().join(m.select("win").distinct(), how="cross").join(kept, ["service", "name", "win"], "left")
    return os_.went_silent(grid.withColumns({"t_s": F.col("win") * 21600 - 1705795200, "name": F.col("name").cast("string")}))


#: The series' services stand on the graph as its first nodes.
def _on_graph(graph):
    names = ["click", "error", "purchase", "signup", "view"]
    m = F.create_map(*(F.lit(x) for i, n in enumerate(names) for x in (f"n{i}", n)))
    return graph.select(*(F.coalesce(F.try_element_at(m, F.col(c)), F.col(c)).alias(c) for c in ("caller", "callee")), "weight")


_NODE = "CASE {c} WHEN 'n0' THEN 'click' WHEN 'n1' THEN 'error' WHEN 'n2' THEN 'purchase' WHEN 'n3' THEN 'signup' WHEN 'n4' THEN 'view' ELSE {c} END"
_OR = "CASE WHEN x > 0 THEN x ELSE 0 END"
#: The walk's dense matrix, restart and dangling nodes included, applied as often as the operator does at most.
_WALK = """ws AS (SELECT nd.service, CASE WHEN t.m > 0 THEN least(greatest(f0.mx / t.m, 0), 1) ELSE 0 END AS s FROM nd JOIN f0 USING (service), (SELECT max(mx) AS m FROM f0) t),
    er AS (SELECT DISTINCT caller, callee FROM gr WHERE caller <> callee), sr0 AS (SELECT sum(s) AS total FROM ws),
    ne AS (SELECT service, max(s) AS s FROM (SELECT caller AS service, x.s FROM er JOIN ws x ON x.service = callee UNION ALL SELECT callee, x.s FROM er JOIN ws x ON x.service = caller) GROUP BY 1),
    mv AS (SELECT a, b, sum(v) AS v FROM (SELECT caller AS a, callee AS b, x.s AS v FROM er JOIN ws x ON x.service = callee UNION ALL SELECT callee, caller, 0.2e0 * x.s FROM er JOIN ws x ON x.service = caller
        UNION ALL SELECT ws.service, ws.service, greatest(0, ws.s - coalesce(ne.s, 0)) FROM ws LEFT JOIN ne USING (service)) GROUP BY 1, 2),
    mt AS (SELECT a, sum(v) AS t FROM mv GROUP BY 1),
    dm AS (SELECT i.service AS a, j.service AS b, CASE WHEN coalesce(mt.t, 0) > 0 THEN 0.85e0 * coalesce(mv.v, 0) / mt.t ELSE 0 END + (CASE WHEN coalesce(mt.t, 0) > 0 THEN 0.15e0 ELSE 1e0 END) * j.s / (SELECT total FROM sr0) AS v
        FROM ws i CROSS JOIN ws j LEFT JOIN mv ON mv.a = i.service AND mv.b = j.service LEFT JOIN mt ON mt.a = i.service),
    wk AS (SELECT 0 AS k, service, s / (SELECT total FROM sr0) AS p FROM ws UNION ALL SELECT k + 1, dm.b, sum(wk.p * dm.v) FROM wk JOIN dm ON dm.a = wk.service WHERE k < 200 GROUP BY k, dm.b),
    wf AS (SELECT service, p / sum(p) OVER () AS p, p / max(p) OVER () AS walk FROM wk WHERE k = 200)"""


def features_sql(scaling: str = "robust") -> str:
    """CTEs ending in `fe`, the features of the services of `series` on `graph`."""
    return f"""{scores_sql(scaling)}, gr AS (SELECT {_NODE.format(c="caller")} AS caller, {_NODE.format(c="callee")} AS callee FROM graph),
    c AS (SELECT caller AS service, callee AS descendant FROM gr UNION SELECT c.service, g.callee FROM c JOIN gr g ON g.caller = c.descendant), nd AS (SELECT caller AS service FROM gr UNION SELECT callee FROM gr),
    ev AS (SELECT service, max(CASE WHEN category <> 'traffic' THEN mx END) AS mx, max(CASE WHEN category <> 'traffic' THEN sustained END) AS su, count(*) FILTER (category <> 'traffic') AS n, count(*) FILTER (category <> 'traffic' AND mx > 3) AS na, min(CASE WHEN category <> 'traffic' AND mx > 3 THEN onset_s END) AS onset_s,
        {", ".join(f"greatest(0, max(CASE WHEN category IN ({', '.join(repr(m) for m in members)}) THEN mx END)) AS top_{g}" for g, members in fg.GROUPS.items())} FROM sc GROUP BY 1),
    ca AS (SELECT service FROM ev UNION SELECT service FROM nd), f0 AS (SELECT service, coalesce(mx, 0) AS mx, coalesce(su, 0) AS su, coalesce(n, 0) AS n, coalesce(na, 0) AS na, onset_s, {", ".join(f"coalesce(top_{g}, 0) AS top_{g}" for g in fg.GROUPS)} FROM ca LEFT JOIN ev USING (service)),
    {_WALK},
    ce2 AS (SELECT o.service, greatest(0, max(least(x.mx / greatest(o.top_latency, o.top_errors), 1))) AS v FROM f0 o JOIN gr ON gr.caller = o.service JOIN f0 x ON x.service = gr.callee WHERE greatest(o.top_latency, o.top_errors) > 3 GROUP BY 1),
    dn AS (SELECT c.service, avg(CAST(x.mx > 3 AS INT)) AS v FROM c JOIN f0 x ON x.service = c.descendant WHERE c.service <> c.descendant GROUP BY 1), up AS (SELECT c.descendant AS service, avg(CAST(x.mx > 3 AS INT)) AS v FROM c JOIN f0 x ON x.service = c.service WHERE c.service <> c.descendant GROUP BY 1),
    fe AS (SELECT 'a' AS incident, service, mx AS max_score, onset_s, ln(1 + greatest(mx, 0)) AS log_max, CASE WHEN max(mx) OVER () > 0 THEN least(greatest(mx / max(mx) OVER (), 0), 1) ELSE 0 END AS rel_max, 1 - (rank() OVER (ORDER BY mx DESC) - 1) / CAST(count(*) OVER () - 1 AS DOUBLE) AS rank_score,
        ln(1 + greatest(su, 0)) AS log_sustained, {", ".join(f"ln(1 + greatest(top_{g}, 0)) AS log_{g}" for g in fg.GROUPS)}, CASE WHEN n > 0 THEN na / CAST(n AS DOUBLE) ELSE 0 END AS frac_anomalous,
        CASE WHEN onset_s IS NULL THEN 0 WHEN max(onset_s) OVER () > min(onset_s) OVER () THEN (max(onset_s) OVER () - onset_s) / (max(onset_s) OVER () - min(onset_s) OVER ()) ELSE 1 END AS onset_lead, CASE WHEN onset_s IS NULL THEN 0e0 ELSE 1e0 END AS has_onset, coalesce(wf.walk, 0) AS walk,
        coalesce(ce2.v, 0) AS callee_explained, coalesce(up.v, 0) AS upstream_anomalous, coalesce(dn.v, 0) AS downstream_anomalous, CASE WHEN service IN (SELECT service FROM nd) AND service NOT IN (SELECT callee FROM gr) THEN 1e0 ELSE 0e0 END AS is_entry, CASE WHEN service IN (SELECT service FROM nd) THEN 1e0 ELSE 0e0 END AS in_graph, 0e0 AS frac_silent
        FROM f0 LEFT JOIN ce2 USING (service) LEFT JOIN up USING (service) LEFT JOIN dn USING (service) LEFT JOIN wf USING (service))"""


FEATURES_SQL = features_sql()


def _features(series, graph, scaling="robust"):
    return oa.service_features(_incident(series), _on_graph(graph), scaling=scaling)


@query("service_features", ["series", "graph"], f"{FEATURES_SQL} SELECT incident, service, {r('max_score')} AS max_score, onset_s, {', '.join(f'{r(x)} AS {x}' for x in ork.FEATURES)} FROM fe", recursive=True)
def service_features(series, graph):
    return _features(series, graph)[0].withColumn("onset_s", F.col("onset_s").cast("double"))


def _linear_sql(weights: dict[str, float]) -> str:
    return " + ".join(f"({w!r}e0) * {f}" for f, w in weights.items())


_FLAT = {f: 1.0 for f in ork.FEATURES if f.startswith("log_")}
_RANK = f"row_number() OVER (ORDER BY {{s}} DESC, service)"


def _shares_sql(scaling: str, score: str) -> str:
    share = "CASE WHEN sum(greatest(score, 0)) OVER () > 0 THEN greatest(score, 0) / sum(greatest(score, 0)) OVER () ELSE 0 END"
    return f"""{features_sql(scaling)}, sx AS (SELECT incident, service, {score} AS score FROM fe LEFT JOIN (SELECT service, p FROM wf) USING (service))
        SELECT incident, service, {r('score')} AS score, {_RANK.format(s='score')} AS rank, {r(share)} AS probability FROM sx QUALIFY rank <= 20"""


def _ranked(series, graph, method, scaling="robust"):
    f, _ = _features(series, graph, scaling)
    return oa.ranking(f, method).select("incident", "service", "score", F.col("rank").cast("long"), "probability")


@query("rank_max_score", ["series", "graph"], _shares_sql("robust", "max_score"), recursive=True)
def rank_max_score(series, graph):
    return _ranked(series, graph, "max_score")


@query("rank_baro", ["series", "graph"], _shares_sql("iqr", "max_score"), recursive=True)
def rank_baro(series, graph):
    return _ranked(series, graph, "baro", "iqr")


@query("rank_nsigma", ["series", "graph"], _shares_sql("nsigma", "max_score"), recursive=True)
def rank_nsigma(series, graph):
    return _ranked(series, graph, "nsigma", "nsigma")


@query("rank_random_walk", ["series", "graph"], _shares_sql("robust", "coalesce(walk, 0) + 1e-9 * max_score"), recursive=True)
def rank_random_walk(series, graph):
    return _ranked(series, graph, "random_walk")


_HEUR = f"sl AS (SELECT *, {_linear_sql(ork.HEURISTIC)} AS score, {_linear_sql(_FLAT)} AS other FROM fe), sr AS (SELECT *, exp(score - max(score) OVER ()) AS ex, {_RANK.format(s='score')} AS rank FROM sl)"


@query("rank_heuristic", ["series", "graph"], f"{FEATURES_SQL}, {_HEUR} SELECT incident, service, {r('score')} AS score, rank, {r('ex / (SELECT sum(ex) FROM sr)')} AS probability FROM sr WHERE rank <= 20", recursive=True)
def rank_heuristic(series, graph):
    return _ranked(series, graph, "model")


@query("ensemble_rank", ["series", "graph"], f"{FEATURES_SQL}, {_HEUR}, se AS (SELECT *, (score - avg(score) OVER ()) / stddev_pop(score) OVER () + (other - avg(other) OVER ()) / stddev_pop(other) OVER () AS total FROM sl) SELECT incident, service, {r('total')} AS score, {_RANK.format(s='total')} AS rank FROM se QUALIFY rank <= 20", recursive=True)
def ensemble_rank(series, graph):
    s = ork.ensemble(_features(series, graph)[0], [ork.model(ork.HEURISTIC), ork.model(_FLAT, name="flat")])
    return ork.ranked(s).select("incident", "service", "score", F.col("rank").cast("long"))


@query("contributions", ["series", "graph"], f"{FEATURES_SQL} " + " UNION ALL ".join(f"SELECT incident, service, '{f}' AS feature, {r(f'({w!r}e0) * {f}')} AS contribution FROM fe" for f, w in ork.HEURISTIC.items()), recursive=True)
def contributions(series, graph):
    return ork.contributions(_features(series, graph)[0], ork.model(ork.HEURISTIC))


@query("top_signals", ["series"], f"{scores_sql('robust')} SELECT service, name, {r('mx')} AS max, row_number() OVER (PARTITION BY service ORDER BY mx DESC, name) AS position FROM sc QUALIFY position <= 5")
def top_signals(series):
    s = _scored(series, "robust").withColumn("incident", F.lit("a"))
    return ork.top_signals(s).select("service", "name", "max", F.col("position").cast("long"))


def _digits(x: str) -> str:
    cases = " ".join(f"WHEN {d} THEN printf('%.{d}f', {x})" for d in range(9))
    return f"CASE WHEN {x} IS NULL THEN 'n/a' WHEN {x} = 0 THEN '0' ELSE CASE CAST(greatest(0, least(8, 2 - floor(log10(abs({x}))))) AS INTEGER) {cases} END END"


_SHARE = "CAST(CAST(round(100 * {}) AS INTEGER) AS VARCHAR) || '%'"
_ONSET = """CASE WHEN onset_s IS NULL THEN '' WHEN abs(onset_s) < 0.5 THEN ', from the begin of the incident on' WHEN onset_s < 0 THEN printf(', from %.0f s before the incident on', -onset_s)
    ELSE printf(', from %.0f s into the incident on', onset_s) END"""
_ODD = "printf('%.1f', exp({}) - 1)"
#: Feature, condition and words, as ranking.reasons() has them.
_STATEMENTS = [
    *((f, "rank_score >= 1", "'no other service departs further from its usual values'") for f in ("rel_max", "rank_score", "log_max")),
    ("log_resource", "exp(log_resource) - 1 > 3", f"'CPU, memory or disk of the service itself are ' || {_ODD.format('log_resource')} || ' deviations off'"),
    ("log_trace_local", "exp(log_trace_local) - 1 > 3", "'spans show that time or errors arise in the service and not in what it calls'"),
    ("log_logs", "exp(log_logs) - 1 > 3", "'it logs more errors than before'"),
    ("onset_lead", "has_onset > 0 AND onset_lead >= 1", "'nothing else became anomalous earlier'"),
    ("walk", "walk >= 0.99", "'following anomalies along calls leads here most often'"),
    ("upstream_anomalous", "upstream_anomalous > 0", f"{_SHARE.format('upstream_anomalous')} || ' of its direct and indirect callers are anomalous'"),
    ("frac_silent", "frac_silent >= 0.5", f"{_SHARE.format('frac_silent')} || ' of its series have fallen silent'"),
    ("frac_anomalous", "frac_anomalous >= 0.5", f"{_SHARE.format('frac_anomalous')} || ' of its series are anomalous'"),
]
_SAID = " UNION ALL ".join(
    f"SELECT service, {words} AS text, ({ork.HEURISTIC[f]!r}e0) * {f} AS w FROM fe WHERE {when} AND ({ork.HEURISTIC[f]!r}e0) * {f} > 0.05" for f, when, words in _STATEMENTS
)
_REASONS = f"""t1 AS (SELECT *, row_number() OVER (PARTITION BY service ORDER BY mx DESC, name) AS position FROM sc),
    said AS ({_SAID} UNION ALL SELECT service, name || ' [' || category || '] went ' || CASE WHEN peak_value >= reference_median THEN 'up' ELSE 'down' END || ' from ' || {_digits("reference_median")} || ' to ' || {_digits("peak_value")}
        || printf(', %.1f robust deviations', mx) || {_ONSET}, 1e300 FROM t1 WHERE position = 1 AND mx > 3
        UNION ALL SELECT service, 'it is slow, and no service that it calls is anomalous enough to be the cause', -1 FROM fe WHERE in_graph > 0 AND callee_explained < 0.25 AND exp(log_latency) - 1 > 3),
    once AS (SELECT service, text, max(w) AS w FROM said GROUP BY 1, 2), five AS (SELECT *, row_number() OVER (PARTITION BY service ORDER BY w DESC, text) AS k FROM once QUALIFY k <= 5),
    why AS (SELECT service, string_agg(text, '; ' ORDER BY k) AS reasons FROM five GROUP BY 1), ns AS (SELECT service, count(*) AS n FROM t1 WHERE position <= 5 GROUP BY 1)"""


@query(
    "rca_reasons", ["series", "graph"],
    f"""{FEATURES_SQL}, {_HEUR}, {_REASONS} SELECT incident, rank, service, {r('score')} AS score, {r('ex / (SELECT sum(ex) FROM sr)')} AS probability, coalesce(n, 0) AS n_signals, coalesce(reasons, '') AS reasons
    FROM sr LEFT JOIN ns USING (service) LEFT JOIN why USING (service) WHERE rank <= 20""",
    recursive=True,
)
def rca_reasons(series, graph):
    """The analysis from end to end."""
    out = oa.analyze(_incident(series), _on_graph(graph))
    n = F.coalesce(F.size("signals"), F.lit(0)).cast("long").alias("n_signals")
    return out.select("incident", F.col("rank").cast("long"), "service", "score", "probability", F.greatest(n, F.lit(0)).alias("n_signals"), F.array_join("reasons", "; ").alias("reasons"))


@query("random_walk", ["series", "graph"], f"{FEATURES_SQL} SELECT incident, service, {r('walk')} AS walk FROM fe", recursive=True)
def random_walk(series, graph):
    f, _ = _features(series, graph)
    return f.select("incident", "service", "walk")


@query("incident_split", ["series"], "SELECT id AS incident, count(*) FILTER (time_s < t0) AS reference, count(*) FILTER (time_s >= t0) AS abnormal FROM (SELECT t_s + 1705795200 AS time_s FROM series), (VALUES ('a', 1705795200), ('b', 1705000000)) v(id, t0) WHERE time_s >= t0 - 400000 AND time_s < t0 + 200000 GROUP BY 1")
def incident_split(series):
    spark = series.sparkSession
    i = spark.createDataFrame([("a", 1705795200), ("b", 1705000000)], "incident string, t0_s long").withColumns({"from_s": F.col("t0_s") - 400000, "to_s": F.col("t0_s") + 200000})
    s = os_.split(series.withColumn("time_s", F.col("t_s") + 1705795200).drop("t_s"), i)
    return s.groupBy("incident").agg(F.count_if(F.col("t_s") < 0).alias("reference"), F.count_if(F.col("t_s") >= 0).alias("abnormal"))


_DET = f"""{SLIDING.replace("WITH w AS (SELECT *,", "WITH w AS (SELECT *, CASE WHEN service IN ('click', 'view') THEN 'both' ELSE 'up' END AS direction,").replace("BETWEEN 60 PRECEDING", "BETWEEN 240 PRECEDING")},
    h0 AS (SELECT *, {"CASE WHEN n > 0 THEN (ds[CAST(floor(0.5e0 * (n - 1)) AS INT) + 1] + ds[CAST(ceil(0.5e0 * (n - 1)) AS INT) + 1]) / 2 END"} AS mad FROM d WHERE n >= 30), h1 AS (SELECT *, greatest(1.4826e0 * mad, 0.7413e0 * iqr, CASE WHEN greatest(1.4826e0 * mad, 0.7413e0 * iqr) > 0 THEN 0 ELSE coalesce(sd, 0) END, 0.02e0 * abs(median)) AS scale FROM h0),
    h2 AS (SELECT *, (value - median) / scale AS zz FROM h1), h3 AS (SELECT *, greatest(least(zz, 4), -4) AS z, CASE WHEN direction = 'both' THEN abs(zz) ELSE greatest(zz, 0) END AS harm FROM h2), {CUSUM.format(k=1.0, t="h3")},
    dt AS (SELECT service, name, win, zz, harm, up, down, harm > 6 OR up > 12 OR direction = 'both' AND down > 12 AS anomalous FROM c2)"""


def _directed(series):
    return series.withColumn("direction", F.when(F.col("service").isin("click", "view"), "both").otherwise("up"))


@query("detector_slice", ["series"], f"{_DET} SELECT service, name, win, {r('zz')} AS z, {r('harm')} AS harm, {r('up')} AS cusum_up, {r('down')} AS cusum_down, anomalous FROM dt")
def detector_slice(series):
    return od.detect_relational(_directed(series)).select("service", "name", "win", "z", "harm", "cusum_up", "cusum_down", "anomalous")


@query("window_anomalies", ["series"], f"{_DET} SELECT win, service, win AS onset, {r('max(least(harm, 30))')} AS surprise, arg_min(name, (-least(harm, 30), name)) AS signal, bool_or(service = 'view') AS user_facing FROM dt WHERE harm >= 2 AND harm IS NOT NULL GROUP BY 1, 2")
def window_anomalies(series):
    from ..config import IncidentConfig

    o = od.detect_relational(_directed(series)).filter("harm >= 2").withColumns({"state": F.lit("anomalous"), "surprise": F.least("harm", F.lit(30.0)), "episode_age": F.lit(0).cast("long"), "category": F.lit("latency")})
    entries = series.filter("service = 'view'").select("service").distinct()
    return oi.window_anomalies(o, entries, IncidentConfig(confirm_windows=1))


@query("incident_triggers", ["series"], f"""{_DET} SELECT win, count(*) AS services, bool_or(service = 'view') AS user_facing, {r("max(sp)")} AS surprise, count(*) >= 2 OR bool_or(service = 'view') OR max(sp) >= 8 AS opens FROM (SELECT win, service, max(least(harm, 30)) AS sp FROM dt WHERE harm >= 2 GROUP BY 1, 2) GROUP BY 1""")
def incident_triggers(series):
    return oi.triggers(window_anomalies(series)).drop("onset")


@query("incident_islands", ["series"], f"""{_DET}, iw AS (SELECT DISTINCT win FROM dt WHERE harm >= 3), il AS (SELECT win, sum(nw) OVER (ORDER BY win) AS run FROM (SELECT win, CASE WHEN win - lag(win) OVER (ORDER BY win) < 5 THEN 0 ELSE 1 END AS nw FROM iw)) SELECT min(win) AS first, max(win) AS last, count(*) AS n FROM il GROUP BY run""")
def incident_islands(series):
    w = od.detect_relational(_directed(series)).filter("harm >= 3").select("win").distinct()
    return od.islands(w, 5).drop("run")


@query("incidents_full", ["series"])
def incidents_full(series):
    o = window_anomalies(series)
    from ..config import IncidentConfig

    out = oi.incidents(o, series.select("win").distinct(), 21_600_000_000_000, IncidentConfig(resolve_after="24h", rca_delay="6h", rca_interval="12h"))
    return out.select("id", "status", "start", "opened", "resolved", "last_anomaly", F.array_join("trigger", ",").alias("trigger"), "analyses")


@query("detect_spot", ["series"])
def detect_spot(series):
    from ..config import DetectorConfig, SpotConfig

    return od.detect(_directed(series), DetectorConfig(spot=SpotConfig(calibration=40)))


_XI = "(stream % 5 - 2) / 10e0"
_SF = f"CASE WHEN y <= 0 THEN 1 WHEN abs({_XI}) < 1e-9 THEN exp(-y / 40) WHEN 1 + {_XI} * y / 40 <= 0 THEN 0 ELSE pow(1 + {_XI} * y / 40, -1 / nullif({_XI}, 0)) END"


@query("gpd_sf", ["metrics"], f"SELECT service, name, stream, ts_us, {r(_SF)} AS sf FROM (SELECT *, value - 100 AS y FROM metrics)")
def gpd_sf(metrics):
    xi = (F.col("stream") % 5 - 2) / 10.0
    return metrics.select("service", "name", "stream", "ts_us", od.pareto_sf(F.col("value") - 100, F.lit(40.0), xi).alias("sf"))


@query("gpd_fit", ["metrics"])
def gpd_fit(metrics):
    return od.fit_tails(metrics.withColumn("value", F.col("value") - 100).filter("value > 0"), ["service", "name"])


_AC = f"{r('avg(CASE WHEN rank <= {k} THEN 1e0 ELSE 0e0 END)')} AS ac_{{k}}"


@query("ac_at_k", ["ranks"], f"SELECT dataset, method, count(*) AS cases, {', '.join(_AC.format(k=k) for k in (1, 3, 5))}, {r('(' + ' + '.join(f'avg(CASE WHEN rank <= {k} THEN 1e0 ELSE 0e0 END)' for k in range(1, 6)) + ') / 5')} AS avg_5, {r('avg(coalesce(1e0 / rank, 0))')} AS mrr FROM ranks GROUP BY 1, 2")
def ac_at_k(ranks):
    return oe.accuracy(ranks, ["dataset", "method"])


@query("grouping_report", ["ranks"], f"SELECT dataset, method, count(*) AS cases, {r('avg(CASE WHEN rank <= 1 THEN 1e0 ELSE 0e0 END)')} AS ac_1, {r('avg(CASE WHEN rank <= 5 THEN 1e0 ELSE 0e0 END)')} AS ac_5, {r('avg(coalesce(1e0 / rank, 0))')} AS mrr FROM ranks GROUP BY GROUPING SETS ((dataset, method), (method), (dataset))")
def grouping_report(ranks):
    return oe.report(ranks, [("dataset", "method"), ("method",), ("dataset",)])


@query("paired_compare", ["ranks"], "SELECT count(*) AS cases, count(*) FILTER (coalesce(a, 99) < coalesce(b, 99)) AS first_better, count(*) FILTER (coalesce(b, 99) < coalesce(a, 99)) AS second_better, count(*) FILTER (coalesce(a, 99) = coalesce(b, 99)) AS equal FROM (SELECT rank AS a, CASE WHEN case_id % 8 = 7 THEN NULL ELSE case_id % 8 + 1 END AS b FROM ranks)")
def paired_compare(ranks):
    other = ranks.withColumn("rank", F.when(F.col("case_id") % 8 == 7, None).otherwise(F.col("case_id") % 8 + 1))
    return oe.paired(ranks, other, "case_id")


@query("truth_rank", ["graph"], "SELECT caller AS case_id, 'n' || CAST((CAST(substr(caller, 2) AS INT) * 3) % 25 AS VARCHAR) AS root_cause, (SELECT k FROM (SELECT callee, row_number() OVER (ORDER BY weight DESC, callee) AS k FROM graph g WHERE g.caller = c.caller) WHERE callee = 'n' || CAST((CAST(substr(c.caller, 2) AS INT) * 3) % 25 AS VARCHAR)) AS rank FROM (SELECT DISTINCT caller FROM graph) c")
def truth_rank(graph):
    from pyspark.sql import Window

    g = graph.select(F.col("caller").alias("case_id"), F.col("callee").alias("service"), F.row_number().over(Window.partitionBy("caller").orderBy(F.desc("weight"), "callee")).alias("position"))
    again = g.union(g.withColumn("position", F.col("position") + 100))
    truth = g.select("case_id").distinct().withColumn("root_cause", F.concat(F.lit("n"), ((F.substring("case_id", 2, 9).cast("int") * 3) % 25).cast("string")))
    return oe.truth_rank(again, truth, "case_id").withColumn("rank", F.col("rank").cast("long"))


@query("bootstrap_ci", ["ranks"])
def bootstrap_ci(ranks):
    hits = ranks.withColumn("hit", (F.coalesce("rank", F.lit(99)) <= 1).cast("double"))
    return oe.bootstrap(hits.select("case_id", "method", "hit"), ["method"], "hit", rounds=50)


@query("services_view", ["series"], f"{_DET} SELECT service, count(*) AS series, coalesce(string_agg(CASE WHEN odd THEN name END, ',' ORDER BY name), '') AS anomalous FROM (SELECT service, name, bool_or(anomalous) AS odd FROM dt GROUP BY 1, 2) GROUP BY 1")
def services_view(series):
    v = ow.service_view(od.detect_relational(_directed(series)))
    return v.select("service", "series", F.array_join("anomalous", ",").alias("anomalous"))


@query("warmup_gate", ["series"], f"{_DET} SELECT win, service, {r('max(least(harm, 30))')} AS surprise FROM dt WHERE harm >= 2 AND win >= (SELECT min(win) + 60 FROM series) GROUP BY 1, 2")
def warmup_gate(series):
    return oi.warmed_up(window_anomalies(series), series.select("win"), 60).select("win", "service", "surprise")


@query("recent_incidents", ["ranks"], "SELECT case_id AS id, case_id % 977 AS start FROM ranks ORDER BY start DESC, id LIMIT 50")
def recent_incidents(ranks):
    return oi.recent(ranks.select(F.col("case_id").alias("id"), (F.col("case_id") % 977).alias("start")))


@query("incident_lookup", ["ranks"], "SELECT case_id AS id, CASE WHEN case_id % 3 = 0 THEN 'open' ELSE 'resolved' END AS status FROM ranks WHERE case_id % 3 = 0 OR case_id % 2 = 0")
def incident_lookup(ranks):
    i = ranks.select(F.col("case_id").alias("id"))
    live, kept = i.filter("id % 3 = 0").withColumn("status", F.lit("open")), i.filter("id % 2 = 0").withColumn("status", F.lit("resolved"))
    return oi.found(i, live, kept)


@query("analysis_bounds", ["ranks"], "SELECT case_id AS incident, CASE case_id % 3 WHEN 0 THEN 'opened' WHEN 1 THEN 'analyze' ELSE 'resolved' END AS action, case_id * 60e0 AS t0_s, case_id * 60e0 - 1200 AS from_s, CASE WHEN case_id % 3 = 2 THEN case_id * 60e0 + 320 ELSE case_id * 60e0 + 500 END AS to_s FROM ranks")
def analysis_bounds(ranks):
    t = (F.col("case_id") * 60).cast("double")
    action = F.element_at(F.array(F.lit("opened"), F.lit("analyze"), F.lit("resolved")), (F.col("case_id") % 3 + 1).cast("int"))
    return oi.analysis_bounds(ranks.select(F.col("case_id").alias("incident"), action.alias("action"), (t + 500).alias("at_s"), t.alias("start_s"), (t + 300).alias("last_anomaly_s")), 10.0, 1200.0)


_SETS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
_HIT5 = "(" + " + ".join(f"CASE WHEN rank <= {k} THEN 1e0 ELSE 0e0 END" for k in range(1, 6)) + ") / 5"


@query("results_table", ["ranks"], "SELECT method, " + ", ".join(r(f"avg(CASE WHEN dataset = '{c}' THEN {_HIT5} END)") + f' AS "{c}"' for c in _SETS) + f", {r(f'avg({_HIT5})')} AS \"all\" FROM ranks GROUP BY 1")
def results_table(ranks):
    return oe.results_table(ranks, "method", "dataset", _SETS)


_RUNS = "(SELECT dataset AS kind, case_id % 3 AS size, CASE WHEN rank IS NULL THEN NULL ELSE (case_id % 17) * 1e0 END AS delay_s, rank AS first_rank, case_id % 5 // 4 AS false_incidents FROM ranks)"


@query("scenario_outcomes", ["ranks"], f"SELECT size, kind, count(*) AS runs, count(delay_s) AS detected, CAST(sum(false_incidents) AS BIGINT) AS false_incidents, {r('avg(CASE WHEN first_rank = 1 THEN 1e0 ELSE 0e0 END)')} AS ac_1, list_sort(list(delay_s) FILTER (delay_s IS NOT NULL))[CAST(count(delay_s) // 2 + 1 AS INT)] AS median_delay_s FROM {_RUNS} GROUP BY GROUPING SETS ((size), (kind))")
def scenario_outcomes(ranks):
    delay = F.when(F.col("rank").isNotNull(), (F.col("case_id") % 17).cast("double"))
    runs = ranks.select(F.col("dataset").alias("kind"), (F.col("case_id") % 3).alias("size"), delay.alias("delay_s"), F.col("rank").alias("first_rank"), F.expr("case_id % 5 div 4").alias("false_incidents"))
    return oe.outcomes(runs, [("size",), ("kind",)])


@query("pilot_traffic", ["spans"], f"SELECT peer, {r('count(*) / 60e0')} AS per_s FROM spans WHERE peer <> '' GROUP BY 1")
def pilot_traffic(spans):
    return ow.pilot_traffic(spans)
