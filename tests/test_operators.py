"""Small cases with known results, and properties against plain recomputation."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rootscope.config import DetectorConfig, EngineConfig, SpotConfig, format_duration, parse_duration
from rootscope.functions import logs as fl
from rootscope.functions import numbers as fn
from rootscope.functions import signals as fg
from rootscope.operators import analyze, detector, evaluation, graph, incidents, metrics, ranking, robust, scores, simulate, sketch, traces, windows
from rootscope.operators.logs import Miner
from rootscope.sources import otlp_json, otlp_proto, sinks

MS = 1_000_000
SPANS = "trace_id long, span_id long, parent_id long, service string, operation string, kind string, start_ns long, end_ns long, status string, peer string"


def span(sid, parent, service, a, b, kind="server", status="ok", peer=""):
    return (1, sid, parent, service, "op", kind, a * MS, b * MS, status, peer)


def visits_of(spark, rows):
    spans = spark.createDataFrame(rows, SPANS)
    c = traces.assembled(spans)
    return {r.service: r for r in traces.visits(c).collect()}, traces.calls(c).collect(), c


def test_local_time(spark):
    rows = [span(1, 0, "frontend", 0, 100), span(2, 1, "frontend", 10, 70, "client"), span(3, 2, "cart", 15, 65), span(4, 3, "cart", 20, 40, "internal")]
    v, edges, _ = visits_of(spark, rows)
    assert v["frontend"].local_ns == 40 * MS and v["cart"].local_ns == 50 * MS
    assert [(e.caller, e.callee, e.virtual_callee) for e in edges] == [("frontend", "cart", False)]


def test_parallel_children(spark):
    rows = [span(1, 0, "a", 0, 100), span(2, 1, "b", 10, 60), span(3, 1, "c", 30, 80)]
    assert visits_of(spark, rows)[0]["a"].local_ns == 30 * MS


def test_clock_skew(spark):
    rows = [span(1, 0, "a", 1000, 1100), span(2, 1, "b", 10, 70)]
    v, _, _ = visits_of(spark, rows)
    assert v["b"].end_ns == 1080 * MS and v["a"].local_ns == 40 * MS
    assert traces.offsets(spark.createDataFrame(rows, SPANS)).filter("moved").count() == 1


def test_unanswered_call_blames_peer_and_cycles_have_no_visit(spark):
    rows = [span(1, 0, "a", 0, 100, "server", "ok"), span(2, 1, "a", 5, 50, "client", "error", "db"), span(8, 9, "x", 0, 1), span(9, 8, "x", 0, 1)]
    v, edges, c = visits_of(spark, rows)
    assert [(r.service) for r in traces.error_origins(c).collect()] == ["db"]
    assert "x" not in v and edges[0].callee == "db" and edges[0].virtual_callee


def test_union_length(spark):
    rows = [(1, max(a, 0), min(b, 25)) for a, b in ((0, 10), (5, 15), (20, 30), (-5, 2))]
    assert traces.union_length(spark.createDataFrame(rows, "k long, a long, b long"), ["k"], "a", "b").first().length == 20


def test_robust_summary(spark):
    r = robust.summary(spark.createDataFrame([("a", float(x)) for x in (1, 2, 3, 4, 100)], "k string, value double"), ["k"]).first()
    assert (r.median, r.mad, r["iqr"]) == (3, 1, 2)


def test_metric_window_values(spark):
    rows = [("s", "g", 1, 1, 100.0, "level"), ("s", "g", 1, 2, 300.0, "level"), ("s", "d", 1, 1, 50.0, "rate"), ("s", "d", 1, 2, 30.0, "rate")]
    out = windows.metric_windows(spark.createDataFrame(rows, "service string, name string, stream long, ts_us long, value double, agg string"), 10_000_000)
    assert {r.name: r.value for r in out.collect()} == {"g": 200.0, "d": 8.0}


def test_counters_add_up(spark):
    rows = [("s", "c", k, int(t * 1e6), float(rate * t), 0) for k, rate in ((1, 100.0), (2, 50.0)) for t in np.arange(1, 30, 0.7).tolist()]
    r = metrics.counter_rates(spark.createDataFrame(rows, "service string, name string, stream long, ts_us long, value double, start_us long"))
    by = {x.stream: x.m for x in r.groupBy("stream").agg(F.avg("rate").alias("m")).collect()}
    assert by[1] + by[2] == pytest.approx(150, abs=1e-6)


def series(values, reference, name="queue_depth"):
    return [("a", "svc", name, float(i - reference) * 10, None if v is None else float(v)) for i, v in enumerate(values)]


def test_constant_reference(spark):
    df = spark.createDataFrame(series([0] * 20 + [0, 0, 0, 0, 0, 1, 1, 1, 1, 1], 20, "error.count"), "incident string, service string, name string, t_s double, value double")
    r = scores.scores(scores.classified(df)).first()
    assert r["max"] == pytest.approx(16.5) and r.onset_s == 50


def test_scores_missing_everywhere(spark):
    df = spark.createDataFrame(series([None] * 30, 20), "incident string, service string, name string, t_s double, value double")
    assert scores.scores(scores.classified(df)).count() == 0


def test_walk_finds_payment():
    names = ["catalog", "checkout", "frontend", "payment"]
    pairs = [("frontend", "checkout"), ("checkout", "payment"), ("frontend", "catalog")]
    pi = graph.walk(names, pairs, np.array([0.0, 0.8, 0.7, 1.0]))
    assert names[int(pi.argmax())] == "payment" and pi[0] == 0 and pi.sum() == pytest.approx(1)


def test_miner():
    m = Miner()
    mask = lambda line: ["<*>" if any(c.isdigit() for c in w) else w for w in line.split()]
    m.add(mask("user 42 logged in from 10.0.0.1"), 1)
    assert " ".join(m.add(mask("user 7 logged in from 10.0.0.2"), 2).words) == "user <*> logged in from <*>"
    assert m.made == 1


def test_miner_evicts_least_used():
    m = Miner(max_templates=2)
    for i, line in enumerate(("a b c", "d e f g", "h i")):
        m.add(line.split(), i)
    assert m.evicted == 1 and set(m.templates) == {1, 2}


def test_accuracy(spark):
    r = evaluation.accuracy(spark.createDataFrame([("m", x) for x in (1, 2, None, 5)], "method string, rank int"), ["method"]).first()
    assert (r.ac_1, r.ac_5) == (0.25, 0.75) and r.avg_5 == pytest.approx(0.5) and r.mrr == pytest.approx(0.425)


def test_severity_and_masks(spark):
    lines = ["NullPointerException at x", "warning: low", "all fine", "connection REFUSED", "took 12ms deadbeefcafe x"]
    got = spark.createDataFrame([(x,) for x in lines], "b string").select(fl.severity_of_text(F.col("b")).alias("s"), fl.signature(F.col("b")).alias("t")).collect()
    assert [r.s for r in got] == ["error", "warn", "info", "error", "info"] and got[4].t == "took <*> <*> x"


def test_significant(spark):
    got = spark.createDataFrame([(x,) for x in (22.14, 3.541, 0.00412, 12345.0, 0.0)], "x double").select(fn.significant(F.col("x"))).collect()
    assert [r[0] for r in got] == ["22.1", "3.54", "0.00412", "12345", "0"]


def test_durations():
    assert parse_duration("1m30s") == 90_000_000_000 and parse_duration("5") == 5_000_000_000 and format_duration(90_000_000_000) == "1m30s"
    with pytest.raises(ValueError):
        parse_duration("x")
    with pytest.raises(ValueError):
        EngineConfig(lateness="1s")


@settings(max_examples=25, deadline=None)
@given(st.lists(st.floats(-5, 5), min_size=1, max_size=60))
def test_cusum_is_the_recursion(xs):
    d = detector.Drift(1.0, 12.0)
    up = down = 0.0
    for x in xs:
        up, down = max(0.0, up + x - 1), max(0.0, down - x - 1)
        rises, falls, _ = d.push(x)
        assert d.sums == [up, down] and (rises, falls) == (up > 12, down > 12)


def test_sketch_error_and_merge(spark):
    rng = np.random.default_rng(0)
    x = np.exp(rng.normal(10, 2, 4000))
    df = spark.createDataFrame([("k", float(v)) for v in x], "k string, v double")
    a, b = (sketch.add(df.filter(F.pmod(F.xxhash64("v"), F.lit(2)) == i), ["k"], "v") for i in (0, 1))
    r = sketch.quantiles(sketch.merge(a, b, ["k"]), ["k"], {"p50": 0.5, "p99": 0.99}).first()
    s = np.sort(x)
    for q, got in ((0.5, r.p50), (0.99, r.p99)):
        assert abs(got / s[int(q * (len(s) - 1))] - 1) <= 0.0101
    assert r["count"] == 4000


def test_tail_fit_recovers():
    rng = np.random.default_rng(1)
    y = 2.0 / 0.3 * (rng.random(4000) ** -0.3 - 1)
    p = detector.fit_pareto(y)
    assert p.xi == pytest.approx(0.3, abs=0.08) and p.sigma == pytest.approx(2.0, rel=0.1)
    assert p.sf(p.isf(0.01)) == pytest.approx(0.01)
    assert detector.fit_pareto(np.array([1.0])) is None and detector.fit_pareto(np.array([1.0, 1.0])).xi == 0


def test_spot_false_alarms():
    rng = np.random.default_rng(2)
    s = detector.Spot(SpotConfig(risk=1e-3, calibration=1000))
    alarms = sum(s.observe(x)[0] == "alarm" for x in rng.normal(size=12_000))
    assert 2 <= alarms <= 40


def test_detector_finds_a_step_and_skips_gaps():
    rng = np.random.default_rng(3)
    xs = [*rng.normal(100, 3, 300), float("nan"), *rng.normal(160, 3, 10)]
    out = detector.Detector("up").observe_many(xs)
    assert out.state[300] == "missing" and (out.state[301:] == "anomalous").all() and (out.state[60:300] == "anomalous").mean() < 0.02


def test_constant_series_needs_a_run():
    d = detector.Detector("up")
    out = d.observe_many([0.0] * 60 + [1.0] + [0.0] * 5 + [1.0] * 10)
    assert out.state[60] == "normal" and (out.state[70:] == "anomalous").any()


def test_lifecycle():
    life = incidents.Lifecycle()
    s = 1_000_000_000
    assert life.on_window(10 * s, {}, False) == []
    assert [a for a, _ in life.on_window(20 * s, {"a": (5 * s, 3.0), "b": (6 * s, 2.0)}, False)] == ["opened"]
    assert [a for a, _ in life.on_window(50 * s, {}, False)] == ["analyze"]
    assert [a for a, _ in life.on_window(200 * s, {}, False)] == ["resolved"]
    assert life.done[0]["start"] == 5 * s and life.open is None


def test_model_checks():
    with pytest.raises(ranking.ModelError):
        ranking.model({"nonsense": 1.0})
    with pytest.raises(ranking.ModelError):
        ranking.model({"walk": float("nan")})


def test_bad_input(spark):
    df = spark.createDataFrame([], "incident string, service string, name string, t_s double, value double")
    with pytest.raises(analyze.InputError):
        analyze.checked(df)
    with pytest.raises(analyze.InputError):
        analyze.analyze(df, method="x")


def test_unknown_category_is_an_error(spark):
    with pytest.raises(Exception, match="unknown category"):
        spark.createDataFrame([("x",)], "c string").select(fg.parse_category(F.col("c"))).collect()


def test_proto_is_json(spark):
    p = otlp_proto
    one = p.put(1, bytes(range(1, 17))) + p.put(2, bytes(range(1, 9))) + p.put(5, "op") + p.put(6, 3) + bytes([7 << 3 | 1]) + (5).to_bytes(8, "little")
    one += bytes([8 << 3 | 1]) + (9).to_bytes(8, "little") + p.put_attribute(9, "peer.service", "db") + p.put(15, p.put(3, 2)) + p.put(99, "skipped")
    request = p.put(1, p.put(1, p.put_attribute(1, "service.name", "shop")) + p.put(2, p.put(2, one)))
    got = p.decoded(spark.createDataFrame([(bytearray(request),), (bytearray(b"\xff\xff"),), (None,)], "content binary"), "traces").collect()
    assert len(got) == 1
    r = got[0]
    assert (r.service, r.kind, r.status, r.peer, r.start_ns, r.end_ns, r.span_id) == ("shop", "client", "error", "db", 5, 9, "0102030405060708")


def test_proto_metrics_and_logs(spark):
    p = otlp_proto
    resource = p.put(1, p.put_attribute(1, "service.name", "shop"))
    t = bytes([3 << 3 | 1]) + (2_000_000).to_bytes(8, "little")
    point = t + p.put(4, 1.5) + p.put_attribute(7, "k", "v")
    metric = p.put(1, "cpu") + p.put(5, p.put(1, point))
    got = p.decoded(spark.createDataFrame([(bytearray(p.put(1, resource + p.put(2, p.put(2, metric)))),)], "content binary"), "metrics").collect()
    assert [(r.service, r.name, r.ts_us, r.value, r.kind) for r in got] == [("shop", "cpu", 2000, 1.5, "gauge")]
    record = bytes([1 << 3 | 1]) + (3_000_000).to_bytes(8, "little") + p.put(2, 17) + p.put(5, p.put(1, "boom"))
    got = p.decoded(spark.createDataFrame([(bytearray(p.put(1, resource + p.put(2, p.put(2, record)))),)], "content binary"), "logs").collect()
    assert [(r.service, r.ts_us, r.body, r.severity) for r in got] == [("shop", 3000, "boom", "error")]


def test_histograms_and_invalid_points(spark):
    doc = """{"resourceMetrics":[{"resource":{"attributes":[]},"scopeMetrics":[{"metrics":[{"name":"h","histogram":{"aggregationTemporality":1,"dataPoints":[
      {"timeUnixNano":"1000","count":"3","sum":4.5},{"timeUnixNano":"0","count":"1","sum":1},{"timeUnixNano":"1000","count":"1","sum":"NaN","flags":1}]}},
      {"name":"s","summary":{"dataPoints":[{"timeUnixNano":1000,"count":2,"sum":3,"quantileValues":[{"quantile":0.99,"value":7}]}]}}]}]}]}"""
    got = {r.name: (r.value, r.kind) for r in otlp_json.metric_points(spark.createDataFrame([(doc,)], "value string")).collect()}
    assert got == {"h.count": (3.0, "delta"), "h.sum": (4.5, "delta"), "s.count": (2.0, "cumulative"), "s.sum": (3.0, "cumulative"), "s.p99": (7.0, "gauge")}


def test_webhooks():
    assert sinks.sign(b"k", b"x").startswith("sha256=") and sinks.delays() == [500, 1000, 2000] and sinks.retried(429) and not sinks.retried(404)


def test_simulator_is_deterministic():
    f = [simulate.parse_fault("crash:cart@10s+5s")]
    a, b = (simulate.run(simulate.shop(), f, 20, seed=4)["spans"] for _ in range(2))
    assert a.equals(b) and len(a) > 50
    simulate.checked(simulate.layered(12, 1))
    with pytest.raises(simulate.TopologyError):
        simulate.checked([simulate.Service("a", ["a"])])


def test_collected_messages_count_once(spark):
    rows = [("e1", 1, 1, 5, "s", 2), ("e1", 1, 1, 5, "s", 2), ("e2", 1, 1, 5, "s", 3), ("e1", 1, 3, 6, "s", 1)]
    df = spark.createDataFrame(rows, "edge string, epoch long, seq long, win long, service string, n long")
    assert {(r.win, r.n) for r in windows.collected(df, ["service"]).collect()} == {(5, 5), (6, 1)}
    g = {r.edge: (r.missing, r.repeated) for r in windows.gaps(df).collect()}
    assert g == {"e1": (1, 1), "e2": (0, 0)}


def test_normal_tail():
    assert fn.normal_sf(0) == 0.5 and fn.normal_cdf(1.0) == pytest.approx(0.8413447461) and fn.normal_quantile(0.975) == pytest.approx(1.959964, abs=1e-6) and math.isinf(fn.normal_quantile(1.0))


def test_split_joins_every_incident(spark):
    n = 10_500
    i = spark.range(n).select(F.col("id").alias("incident"), (F.col("id") * 60).alias("t0_s"), (F.col("id") * 60 - 60).alias("from_s"), (F.col("id") * 60 + 60).alias("to_s"))
    series = spark.range(n).select(F.lit("s").alias("service"), (F.col("id") * 60).alias("time_s"), F.col("id").cast("double").alias("value"))
    out = scores.split(series, i)
    assert sorted(out.columns) == ["incident", "service", "t_s", "time_s", "value"]
    assert out.groupBy("t_s").count().sort("t_s").collect() == [(-60, n - 1), (0, n)]
    odd = spark.createDataFrame([("long", 0.5, -400_000.25, 500_000.0), ("none", 5.0, 9.0, 9.0), ("null", 5.0, None, 9.0)], "incident string, t0_s double, from_s double, to_s double")
    times = spark.createDataFrame([(x,) for x in (-400_000.5, -400_000.25, -86_400.0, 0.0, 86_399.5, 432_000.0, 499_999.5, 500_000.0, None)], "time_s double")
    assert sorted((r.incident, r.t_s) for r in scores.split(times, odd).collect()) == [("long", x - 0.5) for x in (-400_000.25, -86_400.0, 0.0, 86_399.5, 432_000.0, 499_999.5)]


def test_training_is_plain_newton(spark, monkeypatch):
    """Loss, gradient and Hessian over blocks of cases, and the weights, against a loop over cases; some cases have no true candidate, some two."""
    rng = np.random.default_rng(5)
    names = [f for f in evaluation.FEATURES if f != "in_graph"]
    groups = []
    for n in rng.integers(1, 9, 60):
        x, y = rng.normal(size=(n, len(names))), rng.random(n) < 0.3
        x[:, 0] += y
        groups.append((x, y))
    rows = [(str(i), bool(t), 0.0, *map(float, v)) for i, (x, y) in enumerate(groups) for t, v in zip(y, x)]
    df = spark.createDataFrame(rows, "incident string, truth boolean, in_graph double, " + ", ".join(f"{n} double" for n in names))
    every = np.vstack([x for x, _ in groups])
    mean, scale = every.mean(0), every.std(0)

    def plain(w):
        loss, g, h = 0.0, np.zeros(len(w)), np.zeros((len(w), len(w)))
        for x, y in groups:
            if y.any():
                x = (x - mean) / scale
                p = np.exp(x @ w) / np.exp(x @ w).sum()
                m = p @ x
                loss, g, h = loss - np.log(p[y].sum()), g + m - x[y].mean(0), h + (x * p[:, None]).T @ x - np.outer(m, m)
        return loss, g, h

    monkeypatch.setattr(evaluation, "BLOCK", 10)
    w = rng.normal(size=len(names))
    for a, b in zip(evaluation.partials(evaluation.cases(df, "truth", dict(zip(names, mean.tolist())), dict(zip(names, scale.tolist()))), w), plain(w)):
        np.testing.assert_allclose(a, b, rtol=1e-9, atol=1e-9)
    w = np.zeros(len(names))
    for _ in range(50):
        _, g, h = plain(w)
        w = w - np.linalg.solve(h + np.eye(len(w)), g + w)
    fitted = evaluation.fit(df, "truth")["weights"]
    np.testing.assert_allclose([fitted[n] for n in names], w, atol=1e-5)


def plain_template(templates, words, least):
    """By a loop over a leaf's templates: the one that takes the line, or None."""
    best, how = None, (-1.0, -1)
    for t in templates:
        same = sum(a == b for a, b in zip(t.words, words))
        loose = sum(a != b and a == "<*>" for a, b in zip(t.words, words))
        if (key := (same / len(words) if words else 1.0, loose)) > how:
            best, how = t, key
    return best if best is not None and how[0] >= least else None


def test_miner_is_the_plain_loop():
    rng = np.random.default_rng(7)
    m = Miner(max_children=4, max_templates=12)
    m.most_numbers = 20
    for i in range(4000):
        words = [str(w) if w < 9 else "<*>" for w in rng.integers(0, 10, rng.integers(0, 6))] + [f"n{i % 300}"] * bool(rng.random() < 0.3)
        leaf = m._leaf(words)
        expected = plain_template([m.templates[x] for x in leaf.members], words, m.least)
        merged = [a if a == b else "<*>" for a, b in zip(expected.words, words)] if expected else words
        got = m.add(words, i)
        assert got.words == merged and (got is expected if expected else got.id == m.made - 1)
        assert len(m.templates) <= 12
    assert m.evicted > 100 and len(m.numbers) <= 100


def test_miner_meets_many_templates_at_once():
    import time

    lines = [["a", "b", *(f"{i}-{k}" for k in range(58))] for i in range(4000)]
    m = Miner()
    began = time.process_time()
    for i, words in enumerate(lines[:4000:2] + lines[:4000:2]):
        m.add(words, i)
    assert m.made == 2000 and time.process_time() - began < 20


def test_attributes_and_ids_of_documents(spark):
    value = lambda k, v: '{"key":%s,"value":{"stringValue":"%s"}}' % (k, v)
    one = lambda trace, *a: ('{"resourceSpans":[{"resource":{"attributes":[%s]},"scopeSpans":[{"spans":[{"traceId":"%s","spanId":"00000000000000AB","kind":3,"attributes":[%s]}]}]}]}' % (value('"service.name"', "shop"), trace, ",".join(a)),)
    good, peer = "0" * 31 + "1", '"peer.service"'
    rows = [one(good, value(peer, "a"), value(peer, "b")), one(good, value("null", "x"), value(peer, "c")), one(good, value(peer, "d"), value('"k"', "e")), one(good)]
    rows += [one("0" * 32, value(peer, "z")), one("0" * 30 + "1", value(peer, "y")), one("g" * 32, value(peer, "x")), one("0" * 31 + "1\\n", value(peer, "w"))]
    got = otlp_json.spans(spark.createDataFrame(rows, "value string")).collect()
    assert sorted(r.peer for r in got) == ["", "b", "c", "d"] and {r.span_id for r in got} == {"00000000000000ab"}


def test_wire_fields_of_one_and_more_bytes():
    b = otlp_proto.put(1, 5) + otlp_proto.put(300, 1 << 40) + otlp_proto.put(2, "x" * 200) + otlp_proto.put(3, "y")
    assert list(otlp_proto.fields(b)) == [(1, 0, 5), (300, 0, 1 << 40), (2, 2, b"x" * 200), (3, 2, b"y")]
    for bad in (b"\x0a\x05ab", b"\x08", b"\x08\x80", b"\x0a", b"\x02\x01", b"\x0b"):
        with pytest.raises(otlp_proto.WireError):
            list(otlp_proto.fields(bad))
