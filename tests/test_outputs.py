"""Parsers, simulator input, node tables, LEGOFIT models, layouts, arrays."""
import math

import numpy as np
import pytest

from freqforge.functions import arrays as R
from freqforge.functions import graph as G
from freqforge.functions import layout as L
from freqforge.functions import nodes as N
from freqforge.sources import formats as T
from freqforge.sources import legofit as X
from freqforge.sources import outputs as O

MIX = G.Graph([("R", "o"), ("R", "u"), ("u", "v"), ("u", "w"), ("v", "b"), ("v", "m"), ("w", "m"), ("w", "c"), ("m", "x")])
ROWS = [{"from": a, "to": b, "type": "admix" if b == "m" else "normal", "weight": {("v", "m"): 0.7, ("w", "m"): 0.3}.get((a, b), 0.1)} for a, b in MIX.edges]


def test_qpadm_text():
    text = """
left pops:
T
S1
S2

right pops:
O1
O2

best coefficients:     0.700     0.300
totmean:      0.690     0.310
      std. errors:     0.050     0.050

  fixed pat  wt  dof     chisq       tail prob
           00  0     2     1.500         0.47     0.700     0.300
           01  1     3     9.000         0.01     1.000     0.000
           10  1     3     8.000         0.02    -0.100     1.100 infeasible
best pat:           00         0.47
"""
    got = O.parse_qpadm(text)
    assert got["weights"][0] == {"target": "T", "left": "S1", "weight": 0.7, "mean": 0.69, "se": 0.05, "z": 0.69 / 0.05}
    assert [(r["pat"], r["chisq"], r["S2"], r["feasible"]) for r in got["popdrop"]] == [("00", 1.5, 0.3, True), ("01", 9.0, 0.0, True), ("10", 8.0, 1.1, False)]
    assert [r["pop"] for r in got["right"]] == ["O1", "O2"]


def test_qpgraph_text():
    text = """population:   0   Out
population:   1   Aa
population:   2   Bb
final score      3.25  dof: 1
Out Aa f2:   0.1  0.11  0.01  0.002  5.0
Out Bb f2:   0.2  0.21  0.01  0.002  5.0
Aa Bb f2:   0.3  0.31  0.01  0.002  5.0
worst f-stat:  Out Aa Out Bb 0.1 0.2 0.1 0.03 3.3
label Out Out
edge e1 R Out 10
admix M P Q 60 40
"""
    got = O.parse_qpgraph_output(text)
    assert got["score"] == 3.25 and got["worst"] == 3.3 and got["f2"][2] == {"pop1": "Aa", "pop2": "Bb", "fit": 0.3, "est": 0.31, "diff": 0.01, "se": 0.002, "z": 5.0}
    assert {(e["from"], e["to"], e["weight"]) for e in got["edges"]} == {("R", "Out", 10.0), ("P", "M", 0.6), ("Q", "M", 0.4)}


def test_fstats_texts(spark, tmp_path):
    text = "##fbasis. basepop: O ::f3*1000 covar*1000000\nA A 10\nA B 4\nB B 20\nA A A A 9\nA A A B 1\nA B A B 4\nB B B B 16\nA A B B 2\nA B B B 3\n"
    got = O.parse_fstats(text)
    assert got["pops"] == ["O", "A", "B"] and got["f3"][1] == {"pop1": "O", "pop2": "A", "pop3": "B", "est": 0.004, "se": 0.002}
    assert np.allclose(got["cov"], np.array([[9, 1, 2], [1, 4, 3], [2, 3, 16]]) / 1e6)
    text = "pop: O 0\npop: A 1\npop: B 2\nfstat: 0 1 0 2 0.5 0.1 5.0\nbasis: 0 1 0.1 0.01 :: 0.2 0.02\njest: x 1 0 1 0 2 0.3 0.4 0.01\n"
    got = O.parse_qpfstats(text)
    assert got["fstat"] == [{"pop1": "O", "pop2": "A", "pop3": "O", "pop4": "B", "est": 0.5, "se": 0.1, "z": 5.0}]
    assert got["basis"] == [{"pop1": "O", "pop2": "A", "f21": 0.1, "se1": 0.01, "f22": 0.2, "se2": 0.02}] and got["jest"][0]["p22"] == "B"
    assert O.parse_qpfmv("x\nresult: A B C D 0.1 2.5 end\n") == [{"pop1": "A", "pop2": "B", "pop3": "C", "pop4": "D", "est": 0.1, "z": 2.5}]
    text = "end of inpack\n 0 A\n 1 B\noutpop: x basepop: y\nfst:\n   A B\nA 0 100\nB 100 0\n\nf2:\n  A B\nA 0 30\nB 30 0\n\nff3 (unscaled):\n"
    assert O.parse_ff3base(text)[1] == {"pop1": "A", "pop2": "B", "fst": 0.1, "f2": 0.03}
    for i in range(3):
        (tmp_path / f"{i}.out").write_text(f"result: A B C D 0.{i} {i} end\n")
    rows = O.read_outputs(spark, str(tmp_path), O.parse_qpfmv, "pop1 string, est double, z double").collect()
    assert sorted((r["pop1"], r["est"]) for r in rows) == [("A", 0.0), ("A", 0.1), ("A", 0.2)]
    assert O.write_parfile({"f4mode": True, "skip": None, "blgsize": 0.05}) == "f4mode: YES\nblgsize: 0.05\n" and O.poplists([("A", "B")]) == "A B\n"


def test_simulator_input(spark):
    at = O.pseudo_dates(MIX, 100)
    assert all(at[a] > at[b] for a, b in MIX.edges) and O.pseudo_dates(MIX, fix_leaf=True)["o"] == 0
    model = {d["name"]: d for d in O.demes(MIX, admix={"m": 0.7})["demes"]}
    assert model["m"]["proportions"] == [0.7, pytest.approx(0.3)] and model["x"]["ancestors"] == ["m"] and "ancestors" not in model["R"]
    for kw in ({}, {"seq_length": 1000, "nchr": 2}):
        compile(O.msprime_script(MIX, **kw), "script", "exec")
    par = O.fastsimcoal_files(MIX)["par"].splitlines()
    assert par[1] == str(len(MIX.nodes)) and f"{len(MIX.edges)} historical event" in par
    times = [float(x.split()[0]) for x in par[par.index(f"{len(MIX.edges)} historical event") + 1 :][: len(MIX.edges)]]
    assert times == sorted(times)
    two = O.fastsimcoal_files(MIX, template=True)
    assert "A1$" in two["tpl"] and "A1$" in two["est"]
    sfs = O.parse_sfs(O.sfs_text([1, 2, 3, 4, 5, 6]), {"a": 1, "b": 2})
    assert sfs[-1] == {"a": 1, "b": 2, "n": 6} and sfs[1] == {"a": 0, "b": 1, "n": 2}
    got = O.graph_blocks(spark, ROWS, 400, 0.1).groupBy("pop1", "pop2").agg({"est": "avg"}).collect()
    want = G.expected_f2(MIX, {e: 0.1 for e in MIX.normedges}, {"m": 0.7 if MIX.up["m"][0] == "v" else 0.3})
    assert all(abs(r["avg(est)"] / want[r["pop1"], r["pop2"]] - 1) < 0.03 for r in got) and len(got) == 6


def test_node_tables(spark):
    edges = spark.createDataFrame([(1, a, b, "admix" if b == "m" else "normal", 0.1) for a, b in MIX.edges], "graph_id long, from string, to string, type string, weight double")
    nodes = N.graph_nodes(edges)
    assert nodes.count() == len(MIX.nodes)
    change = spark.createDataFrame([(1, "v", 2, 5.0), (1, "b", 1, 0.0), (1, "new", 1, 1.0)], "graph_id long, name string, samples int, time double")
    nodes = N.set_node_attrs(nodes, change)
    assert {r["name"]: r["samples"] for r in nodes.where("samples > 0").collect()} == {"v": 2, "b": 1, "new": 1}
    nodes = N.prune_nodes(nodes, edges)
    assert nodes.count() == len(MIX.nodes) and [r["name"] for r in N.internal_sampled(nodes, edges).collect()] == ["v"]
    e2, n2 = N.add_sampled_tips(edges, nodes)
    g = G.Graph((r["from"], r["to"]) for r in e2.collect())
    assert set(g.leaves) == {*MIX.leaves, "v"} and g.up["v"] == ["v_anc"] and {r["name"]: r["samples"] for r in n2.collect()}["v_anc"] is None
    times = spark.createDataFrame([(1, n, float(t)) for n, t in O.pseudo_dates(MIX, 1).items()], "graph_id long, name string, time double")
    good = N.refresh_edge_times(edges, times)
    assert good.where("time_from <= time_to").isEmpty() and N.inconsistent_times(good, times).isEmpty()
    assert N.inconsistent_times(good.withColumn("time_to", good.time_to + 1), times).count() == len(MIX.edges)


@pytest.mark.parametrize("how", [{}, {"twoN": 2.0}, {"twoN": {n: 1.5 for n in MIX.nodes}, "time_handling": "free"}, {"time_handling": "init", "fix_times": True}])
def test_models_go_out_and_come_back(how):
    text = X.to_lgo(ROWS, **how)
    edges, nodes = X.from_lgo(text)
    assert {(e["from"], e["to"]) for e in edges} == set(MIX.edges) and len(nodes) == len(MIX.nodes) and X.is_lgo(text)
    w = {(e["from"], e["to"]): e.get("weight") for e in edges}
    assert math.isclose(w["w", "m"], 0.3) and math.isclose(w["v", "m"], 0.7)
    assert ("time free" in text) is not how.get("fix_times", False)
    assert {n["name"]: n["samples"] for n in nodes}["x"] == 1 and all(n["admix_event_time"] is not None for n in nodes if n["name"] == "m")


def test_models_refuse_what_cannot_be():
    assert {r["to"] for r in X.without_outgroup(ROWS, "o")} == {"v", "w", "b", "c", "m", "x"}
    for bad in (lambda: X.without_outgroup(ROWS, "b"), lambda: X.to_lgo(ROWS, twoN={"R": 1.0}), lambda: X.to_lgo(ROWS, samples={"nobody": 1}), lambda: X.times(ROWS, "sometimes"), lambda: X.walk_up(ROWS, {e: 0.1 * len(e[1] + e[0]) * (1 + (e[1] == "o")) for e in MIX.edges}, dict.fromkeys(MIX.leaves, 0.0), strict=True)):
        with pytest.raises(X.InvalidInput):
            bad()
    clash = [r | {"to": "m_v" if r["to"] == "b" else r["to"]} for r in ROWS]
    with pytest.raises(X.InvalidInput):
        X.parameter_names(clash)
    assert X.node_depths(ROWS)["R"] == 4 and X.admix_parents(ROWS) == {"m": ("v", "w", 0.3)}
    t = X.times(ROWS, "init")
    assert math.isclose(t["v"], max(0.1, 0.7 + 0.1)) and math.isclose(X.times(ROWS)["v"], 0.1)


FITTED = """DiffEv reached_goal. cost=0.001 spread=1e-05
Initial parameter values
Fixed:
   one = 1
   T_x = 0
Free:
   T_v = 2
   T_u = 3
   T_admix_m = 1
   m_m = 0.2
Fitted parameter values
Fixed:
   one = 1
   T_x = 0
Free:
   T_v = 2.5
   T_u = 7
   T_admix_m = 1
   m_m = 0.25
"""


def test_fitted_values(spark):
    got = X.read_output(FITTED, ROWS)
    by = {(e["from"], e["to"]): e for e in got["edges"]}
    assert by["u", "v"]["time"] == 2.5 and by["v", "m"]["admix_prop"] == 0.25 and by["v", "m"]["admix_event_time"] == 1 and by["u", "v"]["twoN"] == 1 and by["u", "v"]["admix_event"] is None
    kinds = {r["parameter"]: r["identifiability"] for r in got["identifiability"]}
    assert kinds == {"one": "fixed", "T_x": "fixed", "T_v": "identifiable", "T_u": "weak_unconstrained", "T_admix_m": "structural_none", "m_m": "identifiable"}
    assert got["convergence"] == {"status": "reached_goal", "cost": 0.001, "spread": 1e-05} and got["node_times"]["R"] is None
    assert got["mismatches"] == {"missing": ["T_R", "T_b", "T_c", "T_m", "T_o", "T_w"], "extra": []}
    free = [{"name": n, "value": 1.0, "family": X.family(n), "free": True} for n in ("T_u", "twoN_u", "m_m")]
    assert [r["identifiability"] for r in X.identifiability(free)] == ["scale_degenerate", "scale_degenerate", "identifiable"]
    cis = X.read_bootstrap("# c\npar est low high\nT_v 2 1 3\nT_admix_m 1 0 2\n", ROWS)
    assert [(r["family"], r["identifiability"]) for r in cis] == [("time", "identifiable"), ("admix_time", "structural_none")]
    table = X.parameter_table(spark.createDataFrame([("a", FITTED), ("b", FITTED)], "file string, value string")).collect()
    assert {(r["name"], r["value"], r["free"], r["family"]) for r in table if r["file"] == "a"} == {(p["name"], p["value"], p["free"], p["family"]) for p in X.parameters(FITTED)} and len(table) == 12


def test_layouts():
    at = L.node_places(MIX)
    assert all(at[a][1] > at[b][1] for a, b in MIX.edges) and len({at[x][0] for x in MIX.leaves}) == 4
    assert L.crossing((0, 0), (1, 1), (0, 1), (1, 0)) and not L.crossing((0, 0), (1, 1), (1, 0), (2, 1))
    assert L.num_crossings(MIX, L.untangled(MIX)) <= L.num_crossings(MIX, at) and L.num_same_place({"a": (0, 0), "b": (0, 0)}) == 1
    data = L.plot_data(MIX, {("v", "m"): 0.7, ("R", "o"): 0.012})
    assert {e["label"] for e in data["edges"]} == {"70%", "12", ""} and sum(n["leaf"] for n in data["nodes"]) == 4
    assert L.shift_down(MIX, at, "m")["x"][1] == at["x"][1] - 1 and L.shift_down(MIX, at, "m")["b"] == at["b"]
    flat = L.collapse_edges(MIX, {e: 0.0 if e == ("R", "u") else 1.0 for e in MIX.edges})
    assert "R.u" in flat.nodes and len(flat.nodes) == len(MIX.nodes) - 1
    where = L.node_coordinates(MIX, {"b": (10.0, 0.0), "x": (20.0, 10.0)})
    assert where["v"][:2] == (15.0, 5.0) and "o" not in where


def test_arrays():
    rng = np.random.default_rng(0)
    a = rng.random((4, 4, 3))
    a = a + a.transpose(1, 0, 2)
    assert np.allclose(R.from_pair_rows(R.pair_rows(a), 4), a) and np.allclose(R.as_array(R.as_matrix(a), 4), a)
    x, y = rng.random((5, 2)), rng.random((5, 3))
    assert R.outer_array(x, y).shape == (2, 3, 5) and np.allclose(R.outer_array(x, y, np.add)[1, 2], x[:, 1] + y[:, 2])
    assert np.allclose(R.row_products(x, x), (x * x).sum(1)) and R.repeat_each(x, 2).shape == R.repeat_all(x, 2).shape == (5, 4)
    assert np.allclose(R.diagonal(a)[2], a[2, 2]) and R.interleave("ac", "bd") == list("abcd") and R.chunks(5, 2) == [(0, 2), (2, 4), (4, 5)]
    assert np.isnan(R.finite(np.array([1, np.inf]))[1])
    p = rng.random((4, 50))
    p[1, 3] = np.nan
    combs = np.array([(0, 1, 2, 3), (0, 2, 1, 3), (0, 1, 0, 3)])
    got, n = R.quad_means(p, combs)
    want = [np.nansum((p[i] - p[j]) * (p[k] - p[m])) for i, j, k, m in combs]
    assert np.allclose(got, want) and n.tolist() == [49, 49, 49]
    assert len(T.edge_rows(MIX)) == len(MIX.edges)
