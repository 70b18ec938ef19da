import math
import random

import numpy as np
import pytest

from freqforge.functions import graph as G
from freqforge.functions import numerics as N
from freqforge.operators import fstats as S
from freqforge.operators import graphfit as T
from freqforge.operators import models as M
from freqforge.operators import resample as R


def blocks_of(spark, g, drift=None, alpha=None, nblocks=40, noise=1e-4, seed=0):
    """f2 blocks of a graph with a little noise that keeps the mean."""
    f2 = G.expected_f2(g, drift, alpha)
    rng = np.random.default_rng(seed)
    rows = []
    for pair, v in f2.items():
        e = rng.standard_normal(nblocks) * noise
        rows += [(b, *pair, float(v + x), 10 + b % 3) for b, x in enumerate(e - e.mean())]
    rows += [(b, x, x, 0.0, 10 + b % 3) for x in g.leaves for b in range(nblocks)]
    return spark.createDataFrame(rows, "block int, pop1 string, pop2 string, est double, n_snps int")


MIX = G.Graph([("R", "O"), ("R", "a"), ("a", "b"), ("a", "c"), ("b", "B"), ("b", "b2"), ("c", "C"), ("c", "c2"), ("b2", "X1"), ("c2", "Y1"), ("b2", "m"), ("c2", "m"), ("m", "T")])


def test_tails():
    assert math.isclose(N.normal_two_sided(1.959963984540054), 0.05, rel_tol=1e-9)
    for x, d, p in ((3.841458820694124, 1, 0.05), (18.307038053275146, 10, 0.05), (0.5, 4, 0.9735009788392561)):
        assert math.isclose(N.chi2_sf(x, d), p, rel_tol=1e-9)
    assert math.isclose(N.t_two_sided(2.2281388519649385, 10), 0.05, rel_tol=1e-9) and N.chi2_sf(1, 0) is None


@pytest.mark.parametrize("seed", range(10))
def test_quadratic_program_meets_its_conditions(seed):
    rng = np.random.default_rng(seed)
    a = rng.standard_normal((8, 6))
    h, g = a.T @ a + 0.1 * np.eye(6), rng.standard_normal(6)
    for total in (None, 1.0):
        x = N.bounded_qp(h, g, 0.0, np.inf, total)
        assert (x >= 0).all() and (total is None or abs(x.sum() - 1) < 1e-9)
        best = 0.5 * x @ h @ x - g @ x
        for _ in range(200):
            y = np.abs(rng.standard_normal(6)) * rng.integers(0, 2, 6)
            y = y / y.sum() if total and y.sum() else y
            if total is None or abs(y.sum() - 1) < 1e-9:
                assert 0.5 * y @ h @ y - g @ y >= best - 1e-9


def test_jackknife_is_direct_deletion(spark):
    rng = np.random.default_rng(1)
    est, n = rng.standard_normal(12), rng.integers(5, 20, 12)
    df = spark.createDataFrame([("k", i, float(e), int(w)) for i, (e, w) in enumerate(zip(est, n))] + [("k", 12, None, 4)], "k string, block int, est double, n int")
    loo = {r["block"]: r["loo"] for r in R.est_to_loo(df, ["k"]).collect()}
    for i in range(12):
        keep = np.arange(12) != i
        assert math.isclose(loo[i], np.average(est[keep], weights=n[keep]), rel_tol=1e-9)
    l = np.array([loo[i] for i in range(12)])
    r = n / n.sum()
    e = (l * (1 - r)).sum() / (1 - r).sum()
    got = R.jackknife(R.est_to_loo(df, ["k"]), ["k"]).first()
    assert math.isclose(got["est"], e, rel_tol=1e-9) and math.isclose(got["se"], math.sqrt(np.mean((e - l) ** 2 * (1 / r - 1))), rel_tol=1e-9)
    back = {r["block"]: r["est"] for r in R.loo_to_est(R.est_to_loo(df, ["k"]).drop("est"), ["k"]).collect()}
    assert all(math.isclose(back[i], est[i], rel_tol=1e-6) for i in range(12))


def test_f4_symmetries(spark):
    f = blocks_of(spark, MIX)
    c = S.combs_table(f, [("O", "B", "C", "T"), ("B", "O", "C", "T"), ("C", "T", "O", "B"), ("O", "B", "T", "C"), ("O", "C", "B", "T"), ("O", "T", "C", "B")])
    got = {tuple(r[k] for k in ("pop1", "pop2", "pop3", "pop4", "block")): r["est"] for r in S.f4_blocks(f, c).collect()}
    for b in range(40):
        x = got["O", "B", "C", "T", b]
        assert math.isclose(x, -got["B", "O", "C", "T", b], abs_tol=1e-12) and math.isclose(x, got["C", "T", "O", "B", b], abs_tol=1e-12) and math.isclose(x, -got["O", "B", "T", "C", b], abs_tol=1e-12)
        assert math.isclose(x - got["O", "C", "B", "T", b], got["O", "T", "C", "B", b], abs_tol=1e-12)


def test_mixture_comes_back(spark):
    f = blocks_of(spark, MIX, {e: 0.05 for e in MIX.normedges}, {"m": 0.7})
    models = M.models_table(f, [{"target": "T", "left": ["X1", "Y1"], "right": ["O", "B", "C"]}])
    w = {r["source"]: r for r in M.qpadm(f, models).collect()}
    share = 0.7 if MIX.up["m"][0] == "b2" else 0.3
    assert abs(w["X1"]["weight"] - share) < 0.02 and abs(w["X1"]["weight"] + w["Y1"]["weight"] - 1) < 1e-9
    ranks = {r["f4rank"]: r for r in M.qpadm_rankdrop(f, models).collect()}
    assert ranks[1]["p"] > 1e-3 and ranks[0]["p"] < 1e-6 and ranks[1]["dof"] == 1 and ranks[0]["dof"] == 4
    pops = {r["pat"]: r for r in M.qpadm_popdrop(f, models).collect()}
    assert set(pops) == {"00", "01", "10"} and pops["00"]["feasible"] and pops["00"]["best"]
    lz = {r["source"]: r["weight"] for r in M.lazadm(f, models).collect()}
    assert abs(lz["X1"] - share) < 0.05
    sweep = M.qpadm_sweep(f, ["T"], {"good": ["X1", "Y1"], "bad": ["X1"]}, {"r": ["O", "B", "C"]})
    p = {r["source_set"]: r["p"] for r in sweep.collect()}
    assert p["good"] > 1e-3 > p["bad"]
    assert len(M.rotate_models(["X1", "Y1", "O", "B", "C"], "T")) == 15


def test_smoothing_keeps_a_complete_table(spark):
    f = blocks_of(spark, MIX)
    combs = [(a, b, a, b) for a, b in S.popcombs(MIX.leaves, 2)] + S.popcombs(MIX.leaves, 4)
    got = M.smooth_f2(S.f4_blocks(f, S.combs_table(f, combs)), MIX.leaves, f.where("pop1 < pop2"))
    both = got.join(f.withColumnRenamed("est", "want"), ["block", "pop1", "pop2"])
    assert both.selectExpr("max(abs(est - want)) AS d").first()["d"] < 1e-4


def test_graph_fits_its_own_statistics(spark):
    drift = {e: 0.02 + 0.01 * k for k, e in enumerate(MIX.normedges)}
    f = blocks_of(spark, MIX, drift, {"m": 0.3}, noise=1e-5)
    s = T.f3_stats(f, MIX.leaves)
    wrong = G.newick_to_graph("(O,((B,(C,T)),(X1,Y1)))")
    got = T.qpgraph(T.graphs_table(spark, [MIX, wrong]), s, starts=4)
    score = {r["graph_id"]: r["score"] for r in got.select("graph_id", "score").distinct().collect()}
    assert score[1] > 100 * max(score[0], 1)
    weight = {(r["from"], r["to"]): r["weight"] for r in got.where("graph_id = 0 AND type = 'admix'").collect()}
    assert abs(weight["b2", "m"] - 0.3) < 0.1
    reps = T.qpgraph_resample(T.graphs_table(spark, [wrong]), s, nboot=4, starts=1).collect()
    assert len(reps) == 4 and all(r["error"] is None for r in reps)
    found = T.find_graphs(spark, s, numadmix=0, outpop="O", numgraphs=4, stop_gen=2, starts=1, initgraph=wrong).collect()
    assert found[0]["generation"] == 0 and min(r["score"] for r in found) <= score[1] + 1e-6


def test_counts_of_graphs():
    for n in (2, 3, 4, 5):
        trees = list(G.all_trees([f"l{i}" for i in range(n)]))
        assert len(trees) == G.numtrees(n) == len({G.graph_hash(t) for t in trees}) and all(t.is_valid() for t in trees)
    assert [G.numdags(n) for n in range(5)] == [1, 1, 3, 25, 543] and [G.catalan(n) for n in range(5)] == [1, 1, 2, 5, 14]


@pytest.mark.parametrize("seed", range(12))
def test_edits_keep_graphs_valid(seed):
    rng = random.Random(seed)
    g = G.random_graph(list("ABCDEF"), seed % 3, "A", seed)
    assert g.is_valid() and g.numadmix == seed % 3 and g.outpop == "A"
    for name, f in G.MUTATIONS.items():
        h = f(g, rng)
        assert h is None or (h.is_valid() and h.leaves == g.leaves and h.numadmix == g.numadmix), name
    for h in G.plusone(g):
        assert h.is_valid() and h.numadmix == g.numadmix + 1 and h.leaves == g.leaves
        break
    for h in G.minusone(g):
        assert h.is_valid() and h.numadmix < g.numadmix and h.leaves == g.leaves
    assert len(list(G.split_trees(g))) == 2**g.numadmix and all(t.numadmix == 0 and t.leaves == g.leaves for t in G.split_trees(g))
    assert G.graph_hash(G.canonical(g)) == G.graph_hash(g) == G.graph_hash(G.simplify(G.desimplify(g)))
    assert G.delete_leaf(g, "C").leaves == list("ABDEF") and G.satisfies_zerof4(g, G.zero_f4(g)) and G.satisfies_nonzerof4(g, [])
    p, j = G.jacobian(g)
    assert j.shape == (15, len(p)) and G.graph_rank(g) <= len(p)


def test_equations_agree_with_numbers():
    g = MIX
    drift = {e: 0.01 * (k + 1) for k, e in enumerate(g.normedges)}
    env = {f"e{k + 1}": v for k, v in enumerate(drift.values())} | {"a1": 0.3}
    for pair, text in G.graph_equations(g).items():
        assert math.isclose(eval(text.replace("^", "**"), {}, env), G.expected_f2(g, drift, {"m": 0.3})[pair], rel_tol=1e-9)  # noqa: S307
