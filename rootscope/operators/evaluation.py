"""Accuracy of rankings, intervals by resampling, reports, and listwise training of the linear model."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..tables import stored
from .ranking import FEATURES, model


def accuracy(ranks: DataFrame, keys: list[str], ks: tuple[int, ...] = (1, 3, 5)) -> DataFrame:
    """AC@k for ks, Avg@5 and MRR; a null rank is a miss."""
    hit = lambda k: F.avg(F.coalesce((F.col("rank") <= k).cast("double"), F.lit(0.0)))
    return ranks.groupBy(*keys).agg(
        F.count("*").alias("cases"), *(hit(k).alias(f"ac_{k}") for k in ks),
        (sum((hit(k) for k in range(1, 6)), F.lit(0.0)) / 5).alias("avg_5"), F.avg(F.coalesce(1.0 / F.col("rank"), F.lit(0.0))).alias("mrr"),
    )


def report(ranks: DataFrame, sets: list[tuple[str, ...]]) -> DataFrame:
    """accuracy at several levels at once, by grouping sets; columns not grouped are null."""
    columns = list(dict.fromkeys(c for s in sets for c in s))
    spark = ranks.sparkSession
    groups = ", ".join("(" + ", ".join(s) + ")" for s in sets)
    return spark.sql(
        f"""SELECT {", ".join(columns)}, count(*) AS cases, avg(CASE WHEN rank <= 1 THEN 1.0D ELSE 0.0D END) AS ac_1,
            avg(CASE WHEN rank <= 5 THEN 1.0D ELSE 0.0D END) AS ac_5, avg(CASE WHEN rank IS NULL THEN 0.0D ELSE 1.0D / rank END) AS mrr
        FROM {{ranks}} GROUP BY GROUPING SETS ({groups})""",
        ranks=ranks,
    )


def results_table(ranks: DataFrame, row: str, column: str, columns: list[str]) -> DataFrame:
    """Avg@5 as a table: a row a method, a column a data set, and their mean over all cases."""
    hit = sum((F.coalesce((F.col("rank") <= k).cast("double"), F.lit(0.0)) for k in range(1, 6)), F.lit(0.0)) / 5
    return ranks.groupBy(row).agg(*(F.avg(F.when(F.col(column) == c, hit)).alias(c) for c in columns), F.avg(hit).alias("all"))


def outcomes(runs: DataFrame, sets: list[tuple[str, ...]]) -> DataFrame:
    """runs: scenario outcomes with delay_s (null: not detected), first_rank, false_incidents. Summaries at several levels at once.

    The median of an even number of delays is the upper one.
    """
    columns = list(dict.fromkeys(c for s in sets for c in s))
    groups = ", ".join("(" + ", ".join(s) + ")" for s in sets)
    return runs.sparkSession.sql(
        f"""SELECT {", ".join(columns)}, count(*) AS runs, count(delay_s) AS detected, sum(false_incidents) AS false_incidents,
            avg(CASE WHEN first_rank = 1 THEN 1.0D ELSE 0.0D END) AS ac_1,
            try_element_at(array_sort(collect_list(delay_s)), CAST(count(delay_s) DIV 2 + 1 AS INT)) AS median_delay_s
        FROM {{runs}} GROUP BY GROUPING SETS ({groups})""",
        runs=runs,
    )


def paired(a: DataFrame, b: DataFrame, case: str) -> DataFrame:
    """Cases that both methods have: how often each is better."""
    j = a.select(case, F.col("rank").alias("ra")).join(b.select(case, F.col("rank").alias("rb")), case)
    far = F.lit(1 << 30)
    x, y = F.coalesce("ra", far), F.coalesce("rb", far)
    return j.agg(F.count("*").alias("cases"), F.count_if(x < y).alias("first_better"), F.count_if(y < x).alias("second_better"), F.count_if(x == y).alias("equal"))


def truth_rank(ranking: DataFrame, truth: DataFrame, case: str) -> DataFrame:
    """Rank of the true service: its first place in the ranking with repeats left out. Null if it is not there."""
    first = ranking.groupBy(case, "service").agg(F.min("position").alias("position"))
    placed = first.withColumn("rank", F.row_number().over(Window.partitionBy(case).orderBy("position")))
    return truth.join(placed.select(case, F.col("service").alias("root_cause"), "rank"), [case, "root_cause"], "left")


def bootstrap(values: DataFrame, keys: list[str], value: str, rounds: int = 1000, level: float = 0.95, seed: int = 0) -> DataFrame:
    """Percentile interval of the mean by Poisson resampling: each row counts a Poisson(1) number of times in each round.

    The counts come from a hash of row and round, so rows need no order and partial sums combine.
    """
    row = F.xxhash64(*values.columns)
    r = values.select(*keys, F.col(value).cast("double").alias("__v"), row.alias("__h"), F.explode(F.sequence(F.lit(1), F.lit(rounds))).alias("__b"))
    u = F.pmod(F.xxhash64("__h", "__b", F.lit(seed)), F.lit(1 << 40)) / float(1 << 40)
    cut, total, term = F.lit(0), 0.0, np.exp(-1.0)
    for k in range(8):
        total += term
        cut = cut + (u >= total).cast("int")
        term /= k + 1
    n = r.withColumn("__n", cut)
    means = n.groupBy(*keys, "__b").agg((F.sum(F.col("__n") * F.col("__v")) / F.nullif(F.sum("__n"), F.lit(0))).alias("m"))
    tail = (1 - level) / 2
    return means.groupBy(*keys).agg(F.avg("m").alias("mean"), F.percentile("m", tail).alias("low"), F.percentile("m", 1 - tail).alias("high"))


def standardiser(feats: DataFrame) -> tuple[dict[str, float], dict[str, float]]:
    row = feats.agg(*(f(c).alias(f"{n}_{c}") for c in FEATURES for n, f in (("m", F.avg), ("s", F.stddev_pop)))).first()
    mean = {c: row[f"m_{c}"] or 0.0 for c in FEATURES}
    return mean, {c: s if (s := row[f"s_{c}"]) and s >= 1e-9 else 1.0 for c in FEATURES}


def cases(feats: DataFrame, truth: str, mean: dict[str, float], scale: dict[str, float]) -> DataFrame:
    """One row a case: y, which candidates are true, and x, their standardised features, one candidate after the other."""
    x = [(F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))) - mean[c]) / scale[c] for c in mean]
    row = F.struct(F.coalesce(F.col(truth), F.lit(False)).alias("y"), F.array(*x).alias("x"))
    held = feats.select("incident", row.alias("row")).groupBy("incident").agg(F.collect_list("row").alias("rows"))
    return held.select(F.col("rows.y").alias("y"), F.flatten("rows.x").alias("x"))


#: Candidates that are taken at once.
BLOCK = 1 << 12


def _sums(y: np.ndarray, x: np.ndarray, starts: np.ndarray, weights: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Loss, gradient and Hessian of cases that begin at starts; those without a true candidate count nothing."""
    sizes = np.diff(np.append(starts, len(y)))
    s = x @ weights
    e = np.exp(s - np.repeat(np.maximum.reduceat(s, starts), sizes))
    p = e / np.repeat(np.add.reduceat(e, starts), sizes)
    n = np.add.reduceat(y.astype(float), starts)
    some = n > 0
    share = y / np.repeat(np.where(some, n, 1.0), sizes)
    p = p * np.repeat(some, sizes)
    px = x * p[:, None]
    m = np.add.reduceat(px, starts)
    return -np.log(np.add.reduceat(p * y, starts)[some]).sum(), p @ x - share @ x, px.T @ x - m.T @ m


def partials(held: DataFrame, weights: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Listwise cross-entropy, gradient and Hessian, summed over cases(): one row a task leaves the executors."""
    k = len(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loss, grad, hess = 0.0, np.zeros(k), np.zeros((k, k))
        for b in batches:
            ys, xs = b.column(0), b.column(1)
            ends = ys.offsets.to_numpy()
            lo = 0
            while lo < len(b):
                hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + BLOCK, "right")) - 1)
                y = ys.slice(lo, hi - lo).flatten().to_numpy(zero_copy_only=False)
                x = xs.slice(lo, hi - lo).flatten().to_numpy().reshape(-1, k)
                got = _sums(y, x, ends[lo:hi] - ends[lo], weights)
                loss, grad, hess, lo = loss + got[0], grad + got[1], hess + got[2], hi
        yield pa.RecordBatch.from_arrays([pa.array([v]) for v in (loss, grad.tolist(), hess.ravel().tolist())], names=["loss", "grad", "hess"])

    rows = held.select("y", "x").mapInArrow(run, "loss double, grad array<double>, hess array<double>").collect()
    total = lambda c, n: np.sum([r[c] for r in rows], axis=0) if rows else np.zeros(n)
    return float(total("loss", ())), total("grad", k), total("hess", k * k).reshape(k, k)


def fit(feats: DataFrame, truth: str, l2: float = 1.0, prior: dict[str, float] | None = None, rounds: int = 100, tolerance: float = 1e-12, name: str = "trained") -> dict:
    """Damped Newton steps on the listwise loss with a Gaussian prior; feats: incident, features and a boolean truth.

    Ends where the next step would lower the loss by no more than this share of it. The cases are stored once, a row each, and
    a step is one pass over them without a shuffle.
    """
    names = [f for f in FEATURES if f != "in_graph"]
    mean, scale = standardiser(feats)
    held = stored(cases(feats, truth, {c: mean[c] for c in names}, scale), "cases")
    mu = np.array([(prior or {}).get(f, 0.0) for f in names])
    w = mu.copy()

    def at(x):
        loss, g, h = partials(held, x)
        d = x - mu
        return loss + 0.5 * l2 * d @ d, g + l2 * d, h + l2 * np.eye(len(x))

    loss, g, h = at(w)
    for _ in range(rounds):
        step = np.linalg.solve(h, g)
        if not 0.5 * g @ step > tolerance * max(1.0, loss):
            break
        size = 1.0
        while size > 1e-4:
            new = at(w - size * step)
            if new[0] <= loss:
                break
            size /= 2
        else:
            break
        w = w - size * step
        loss, g, h = new
    return model(dict(zip(names, w.tolist())), {f: mean[f] for f in names}, {f: scale[f] for f in names}, name)


def cross_validated(feats: DataFrame, truth: str, fold: str, grid: tuple[float, ...] = (0.1, 1.0, 10.0), rounds: int = 100) -> DataFrame:
    """Leave one fold out; the penalty is chosen by the folds that are left. Returns incident, service, score, the truth and the fold."""
    from functools import reduce

    from .ranking import linear

    folds = [r[0] for r in feats.select(fold).distinct().orderBy(fold).collect()]  # named systems
    w = Window.partitionBy("incident").orderBy(F.desc("score"), "service")

    def quality(m: dict, held: DataFrame) -> DataFrame:
        placed = linear(held, m).withColumn("rank", F.row_number().over(w)).filter(truth)
        return placed.select((1.0 / F.col("rank")).alias("rr"))

    out = []
    for f in folds:
        rest, test = feats.filter(F.col(fold) != f), feats.filter(F.col(fold) == f)
        inner = [x for x in folds if x != f]
        found: list[tuple[float, float]] = []
        for l2 in grid if len(inner) > 1 else ():
            # Each inner fold is left out once; the penalty's worth is the mean over all their cases.
            parts = [quality(fit(rest.filter(F.col(fold) != x), truth, l2, rounds=rounds), rest.filter(F.col(fold) == x)) for x in inner]
            got = reduce(DataFrame.union, parts).agg(F.avg("rr")).first()[0]
            found.append((-1.0 if got is None else got, -l2))
        best = -max(found)[1] if found else grid[0]
        out.append(linear(test, fit(rest, truth, best, rounds=rounds)).select("incident", "service", "score", truth, fold))
    return reduce(DataFrame.unionByName, out)
