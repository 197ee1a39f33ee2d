"""Every query with a SQL twin gives the same rows on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
QUERIES, ORACLE = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in os.listdir(DATA):
        path = f"{DATA}/{t}" + ("/*.parquet" if os.path.isdir(f"{DATA}/{t}") else "")
        c.execute(f"CREATE VIEW {t.split('.')[0]} AS SELECT * FROM '{path}'")
    return c


def canonical(rows, columns):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    cell = lambda x: f"{x:.5e}" if isinstance(x, float) else str(x)
    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
def test_every_rank_is_delivered_and_trained_on(spark, con, monkeypatch):
    from rootscope.operators import evaluation

    assert QUERIES["webhook_payloads"](spark, DATA).count() == con.execute("SELECT count(*) FROM orders").fetchone()[0]
    seen = []
    monkeypatch.setattr(evaluation, "fit", lambda f, *a, **k: seen.append(f.select("incident").distinct().count()) or {"weights": {"x": 0.0}})
    QUERIES["ltr_fit"](spark, DATA)
    assert seen == [con.execute("SELECT count(DISTINCT o_orderkey) FROM orders").fetchone()[0]]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
@pytest.mark.parametrize("name", sorted(n for n in ORACLE if not n.startswith(("op", "pipeline"))))
def test_matches_sql(spark, con, name):
    df = QUERIES[name](spark, DATA)
    r = con.execute(ORACLE[name])
    columns = [c[0] for c in r.description]
    assert sorted(df.columns) == sorted(columns)
    assert canonical([tuple(x) for x in df.collect()], df.columns) == canonical(r.fetchall(), columns)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
@pytest.mark.parametrize("name", ["skew_offsets", "call_edges", "service_visits", "error_origins", "window_services"])
def test_traces_stay_whole_where_joins_shuffle(spark, con, name):
    """As on large tables: nothing is broadcast, and the sides of the union of spans are coalesced differently."""
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20k", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1k", "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false"}
    was = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        df = QUERIES[name](spark, DATA)
        got = canonical([tuple(x) for x in df.collect()], df.columns)
    finally:
        for k, v in was.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    r = con.execute(ORACLE[name])
    assert got == canonical(r.fetchall(), [c[0] for c in r.description])


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
def test_training_goes_on_until_it_converges(spark, monkeypatch):
    import numpy as np

    from rootscope.operators import evaluation

    fit, seen = evaluation.fit, []
    monkeypatch.setattr(evaluation, "fit", lambda f, *a, **k: seen.append((f, fit(f, *a, **k))) or seen[0][1])
    QUERIES["ltr_fit"](spark, DATA)
    feats, m = seen[0]
    names = list(m["weights"])
    w, mean, scale = (np.array([m[k][n] for n in names]) for k in ("weights", "mean", "scale"))
    rows = feats.select("incident", "truth", *names).toPandas()
    slope = w.copy()
    for _, g in rows.groupby("incident"):
        x = (g[names].to_numpy(float) - mean) / scale
        p = np.exp(x @ w - (x @ w).max())
        slope += p @ x / p.sum() - x[g["truth"].to_numpy()].mean(0)
    assert abs(slope).max() < 1e-3
