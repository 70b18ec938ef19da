"""Replicates without one block: against plain Python, and without a row for each pair of blocks."""
import math
import random

import numpy as np
from pyspark.sql import functions as F

from freqforge.operators import models as M
from freqforge.operators import resample as R
from freqforge.operators import resampled as Z
from freqforge.plans import queries as Q


def shuffled(spark) -> int:
    """Bytes written to shuffles so far."""
    sc = spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty()
    nodes = sc.statusStore().executorList(False)
    return sum(nodes.apply(i).totalShuffleWrite() for i in range(nodes.size()))


def plain(e, n):
    """Jackknife of one table: est, se."""
    r = n / n.sum()
    loo = (r @ e - e * r) / (1 - r)
    est = (loo * (1 - r)).sum() / (1 - r).sum()
    return est, math.sqrt(np.mean((est - loo) ** 2 * (1 / r - 1)))


def test_statistics_without_each_block(spark):
    """Weights alike and not, one larger than all others, a key that lacks blocks, one with two blocks, one with one."""
    rng = random.Random(8)
    rows = [("p", b, 5 + rng.gauss(0, 1), n) for b, n in enumerate([7, 7, 7, 3, 25, 25, 1, 100])]
    rows += [("q", b, rng.gauss(0, 1e-3), 1 + b) for b in (1, 2, 6)] + [("q", 3, None, 9), ("r", 4, 1.0, 6), ("r", 5, 2.0, 6), ("s", 9, 1.0, 2)]
    df = spark.createDataFrame(rows, "key string, block int, est double, n long").repartition(3)
    got = {(r["key"], r["rep"]): (r["est"], r["se"]) for r in Z.statistics(df, ["key"]).collect()}
    want = {}
    for key in "pqrs":
        for rep in {b for _, b, *_ in rows}:
            t = [(e, n) for k, b, e, n in rows if k == key and b != rep and e is not None]
            if len(t) > 1:
                want[key, rep] = plain(*map(np.array, zip(*t)))
    assert set(got) == set(want)
    assert all(math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-15) for k in want for a, b in zip(got[k], want[k]))


def test_statistics_move_rows_a_block(spark):
    """1500 blocks: pairs of blocks would be 4.5 million rows."""
    df = spark.range(3000).selectExpr("id % 2 AS key", "CAST(id DIV 2 AS INT) AS block", "sin(id) AS est", "1 + id % 7 AS n")
    before = shuffled(spark)
    assert Z.statistics(df, ["key"]).count() == 3000
    assert shuffled(spark) - before < 2_000_000


def test_moments_without_each_block():
    """Against grid_stats on the other blocks; one weight is larger than all others, some weights are alike."""
    rng = np.random.default_rng(3)
    b, w = rng.normal(2, 1, (9, 4)), np.array([7, 7, 7, 3, 25, 25, 1, 200, 12.0])
    seen = {}
    for u, at, x, shared in Z.left_out(b, w):
        for k, row in zip(at, x):
            seen[k] = Z.moments(row, shared)
        if u == 0:
            whole = Z.moments(np.zeros(4), shared)
    for k, got in [*seen.items(), (None, whole)]:
        keep = np.arange(9) != k
        want = M.grid_stats(b[keep], w[keep])
        assert all(np.allclose(g, v, rtol=1e-10, atol=1e-14) for g, v in zip(got, want))
    assert len(seen) == 9


def test_models_move_rows_a_block(spark, monkeypatch):
    """1500 blocks of a model, two of them incomplete, in several pieces: each replicate is the model of the other blocks."""
    monkeypatch.setattr(Z, "PIECE", 500)
    pops = list("ABCDE")
    pairs = [(p, q) for i, p in enumerate(pops) for q in pops[i + 1 :]]
    rng = random.Random(2)
    rows = [(b, p, q, rng.random(), 1 + b % 9) for b in range(1500) for p, q in pairs if not (b in (3, 700) and p == "A")]
    f2 = spark.createDataFrame(rows, "block int, pop1 string, pop2 string, est double, n_snps long").cache()
    f2.count()
    models = M.models_table(f2, [{"left": ["A", "B"], "right": ["C", "D", "E"]}, {"left": ["B", "C"], "right": ["D", "E"]}])
    before = shuffled(spark)
    got = {(r["model"], r["rep"]): r for r in Z.qpwave(f2, models).collect()}
    assert shuffled(spark) - before < 2_000_000
    assert len(got) == 3000 and {r["f4rank"] for r in got.values()} == {0}
    for rep in (0, 3, 8, 1499):
        one = {r["model"]: r for r in M.qpwave(f2.where(f"block <> {rep}"), models).collect()}
        for m in one:
            assert all(math.isclose(got[m, rep][c], one[m][c], rel_tol=1e-8, abs_tol=1e-12) for c in ("chisq", "p"))


def test_means_without_each_block(spark):
    """As of the tables themselves: weights alike and not, a key that lacks blocks, one with a single block."""
    rows = [("p", b, 0.1 * b * b, n) for b, n in enumerate([7, 7, 3, 25, 100])] + [("q", 1, 2.0, 4), ("q", 3, None, 5), ("q", 4, 1.0, 2), ("s", 9, 1.0, 2)]
    df = spark.createDataFrame(rows, "key string, block int, est double, n long").repartition(3)
    got = {(r["key"], r["rep"]): r["est"] for r in R.loo_means(df, ["key"]).collect()}
    want = {(r["key"], r["rep"]): r["est"] for r in R.loo_list(df).where("est IS NOT NULL").groupBy("key", "rep").agg((F.sum(F.col("est") * F.col("n")) / F.sum("n")).alias("est")).collect()}
    assert set(got) == set(want) and all(math.isclose(got[k], want[k], rel_tol=1e-12) for k in want)
    more = R.loo_means(df, ["key"], spark.range(9, 12).withColumnRenamed("id", "block"))  # a block without rows leaves the whole
    assert {(r["key"], r["rep"]): round(r["est"], 9) for r in more.where("key <> 'p'").collect()} == {("q", k): round(10 / 6, 9) for k in (9, 10, 11)} | {("s", 10): 1.0, ("s", 11): 1.0}


def test_loo_list_has_no_row_for_each_pair_of_blocks(spark):
    """No join by inequality is left in the query, whose rows would be pairs of blocks."""
    plan = Q.queries()["loo_list"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" in plan and "NOT (" not in "".join(line for line in plan.splitlines() if "Join" in line)
