"""Telemetry views over the driver's tables: spans, metrics, counters, logs, a call graph and benchmark ranks.

Each view is one SELECT that Spark and DuckDB both run; {us:x} is microseconds since the epoch, {lines:x} each line of a text.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    "lines": """
        SELECT *, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate,
            l_extendedprice, l_quantity, l_discount, l_tax, l_returnflag, l_linestatus) AS BIGINT) AS rn FROM lineitem""",
    # Orders divisible by 50 have no root span, so that their lines are orphans.
    "spans": """
        SELECT o_orderkey AS trace_id, CAST(1 AS BIGINT) AS span_id, CAST(0 AS BIGINT) AS parent_id,
            concat('gw-', substr(o_orderpriority, 1, 1)) AS service, 'order' AS operation, 'server' AS kind,
            {us:o_orderdate} * 1000 AS start_ns, {us:o_orderdate} * 1000 + 200000000 AS end_ns,
            CASE WHEN o_orderstatus = 'F' THEN 'error' ELSE 'ok' END AS status, '' AS peer
        FROM orders WHERE o_orderkey % 50 <> 0 AND o_orderkey IN (SELECT l_orderkey FROM lineitem)
        UNION ALL
        SELECT o_orderkey, rn + 1, CASE WHEN rn % 3 = 0 THEN rn ELSE 1 END, concat('svc-', CAST(l_suppkey % 10 AS STRING)),
            'line', CASE WHEN rn % 4 = 1 THEN 'client' ELSE 'server' END,
            {us:o_orderdate} * 1000 + rn * 7000000 - CASE WHEN rn % 5 = 0 THEN 1000000000 ELSE 0 END,
            {us:o_orderdate} * 1000 + rn * 7000000 - CASE WHEN rn % 5 = 0 THEN 1000000000 ELSE 0 END + CAST(l_quantity AS BIGINT) * 1000000,
            CASE WHEN l_returnflag = 'R' THEN 'error' ELSE 'ok' END,
            CASE WHEN rn % 4 = 1 THEN concat('db-', CAST(l_partkey % 5 AS STRING)) ELSE '' END
        FROM lines JOIN orders ON l_orderkey = o_orderkey""",
    "metrics": """
        SELECT event_type AS service, CASE user_id % 3 WHEN 0 THEN 'cpu.usage' WHEN 1 THEN 'request.latency' ELSE 'error.count' END AS name,
            user_id AS stream, {us:ts} AS ts_us, value FROM events""",
    "counters": """
        SELECT user_id AS stream, event_type AS service, ts_us, sum(value) OVER (PARTITION BY user_id, segment ORDER BY ts_us
            ROWS UNBOUNDED PRECEDING) AS value, min(ts_us) OVER (PARTITION BY user_id, segment) - 1000 AS start_us
        FROM (SELECT *, CAST(floor((row_number() OVER (PARTITION BY user_id ORDER BY ts_us) - 1) / 20) AS BIGINT) AS segment
            FROM (SELECT user_id, event_type, value, {us:ts} AS ts_us FROM events))""",
    # Every line of every text.
    "logs": """
        SELECT source AS service, doc_id * 1000000 AS ts_us, {lines:text} AS body FROM documents
        UNION ALL
        SELECT role, (conv_id * 1000 + turn) * 1000000, {lines:text} FROM conversations""",
    # Nations call nations, mostly those with higher keys; order priorities stand for entries.
    "graph": """
        SELECT concat('n', CAST(CASE WHEN (c + s) % 7 = 0 THEN greatest(c, s) ELSE least(c, s) END AS STRING)) AS caller,
            concat('n', CAST(CASE WHEN (c + s) % 7 = 0 THEN least(c, s) ELSE greatest(c, s) END AS STRING)) AS callee, CAST(sum(n) AS DOUBLE) AS weight
        FROM (SELECT c_nationkey AS c, s_nationkey AS s, count(*) AS n
            FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
            WHERE c_nationkey <> s_nationkey GROUP BY c_nationkey, s_nationkey) GROUP BY 1, 2
        UNION ALL
        SELECT concat('p', substr(o_orderpriority, 1, 1)), concat('n', CAST(c_nationkey AS STRING)), CAST(count(*) AS DOUBLE)
        FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2""",
    "ranks": """
        SELECT o_orderkey AS case_id, o_orderpriority AS dataset, o_orderstatus AS method,
            CASE WHEN o_custkey % 8 = 7 THEN NULL ELSE o_custkey % 8 + 1 END AS rank FROM orders""",
    # Six-hour means of each series on a gap-free calendar; the incident begins on 21 January 2024.
    "series": """
        SELECT k.service, k.name, c.win, v.value, c.win * 21600 - 1705795200 AS t_s
        FROM (SELECT DISTINCT service, name FROM metrics) k CROSS JOIN (SELECT DISTINCT {window:ts_us:21600000000} AS win FROM metrics) c
        LEFT JOIN (SELECT service, name, {window:ts_us:21600000000} AS win, avg(value) AS value FROM metrics GROUP BY 1, 2, 3) v
            ON v.service = k.service AND v.name = k.name AND v.win = c.win""",
}
USES = {"spans": ["lines"], "series": ["metrics"]}
TABLES = "region nation customer supplier part orders lineitem events documents conversations".split()


def text(name: str, dialect: str) -> str:
    sql = VIEWS[name]
    us = "unix_micros(CAST({} AS TIMESTAMP))" if dialect == "spark" else "epoch_us({})"
    sql = re.sub(r"\{us:(\w+)\}", lambda m: us.format(m[1]), sql)
    lines = "explode(split({}, chr(10)))" if dialect == "spark" else "unnest(string_split({}, chr(10)))"
    sql = re.sub(r"\{lines:(\w+)\}", lambda m: lines.format(m[1]), sql)
    sql = re.sub(r"\{window:(\w+):(\d+)\}", lambda m: f"CAST(floor(({m[1]}) / {float(m[2])!r}) AS BIGINT)".replace("0.0)", "0.0)"), sql)
    return sql if dialect == "spark" else sql.replace("AS STRING)", "AS VARCHAR)")


def needs(names: list[str]) -> list[str]:
    out: list[str] = []
    for n in names:
        for x in [*needs(USES.get(n, [])), n]:
            if x not in out:
                out.append(x)
    return out


def oracle(names: list[str], body: str, recursive: bool = False) -> str:
    """DuckDB SQL of a query over views; body may begin with CTEs of its own, as `WITH a AS (...) SELECT ...`."""
    ctes = [f"{n} AS ({text(n, 'duckdb')})" for n in needs(names)]
    body = body.strip()
    own = body[5:] if body[:5].upper() == "WITH " else None
    if not ctes:
        return body if own is None or not recursive else "WITH RECURSIVE " + own
    return f"WITH {'RECURSIVE ' * recursive}{', '.join(ctes)}{', ' + own if own is not None else ' ' + body}"


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view as a DataFrame; nothing is registered in the session."""
    sql = text(name, "spark")
    for other in needs([name])[:-1][::-1]:
        sql = re.sub(rf"\b(FROM|JOIN) {other}\b", lambda m, o=other: f"{m[1]} ({text(o, 'spark')})", sql)
    used = [t for t in TABLES if re.search(rf"\b(FROM|JOIN) {t}\b", sql)]
    sql = re.sub(rf"\b(FROM|JOIN) ({'|'.join(TABLES)})\b", r"\1 {\2}", sql)
    return spark.sql(sql, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in used})
