"""Registered queries without SQL, against plain rebuilds that share no code with the operators.

Block statistics come from DuckDB; fits are compared with the minimum over all sets of free edges, graphs with their clades.
"""
import itertools
import math
from collections import Counter

import duckdb
import numpy as np
import pytest

from freqforge.plans import model_queries as MQ
from freqforge.plans import queries as Q

SF = "/root/testdata/sf0.001"
POPS = Q.POPS
FUDGE = 1e-4


@pytest.fixture(scope="module")
def blocks():
    """block -> (f2 and ap of pairs, variants)"""
    c = duckdb.connect()
    for t in "region nation supplier part lineitem".split():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    out = {}
    for b, p, q, f2, ap, n in c.execute(f"WITH RECURSIVE {Q.CTE} SELECT pb.b, pop1, pop2, f2, ap, n_snps FROM pb JOIN bn ON bn.b = pb.b").fetchall():
        f, a, _ = out.setdefault(b, ({}, {}, n))
        f[p, q] = f[q, p] = f2
        a[p, q] = a[q, p] = 0.0 if p == q else -2 * ap
    return out


def f4_of(t, a, b, c, d):
    return (t[a, d] + t[b, c] - t[a, c] - t[b, d]) / 2


def moments(x, n):
    """Jackknifed means and their covariance by leaving blocks out one by one."""
    x, n = np.asarray(x, float), np.asarray(n, float)
    tot = n @ x / n.sum()
    loo = np.array([np.delete(n, i) @ np.delete(x, i, 0) / (n.sum() - n[i]) for i in range(len(n))])
    h = n.sum() / n
    est = len(n) * tot - ((1 - 1 / h)[:, None] * loo).sum(0)
    dev = ((h[:, None] * est - (h - 1)[:, None] * loo) - tot) / np.sqrt(h - 1)[:, None]
    return est, dev.T @ dev / len(n)


def rows(spark, name):
    return [r.asDict(recursive=True) for r in Q.queries()[name](spark, SF).collect()]


def f3_world(blocks, drop=None):
    base, rest = sorted(POPS)[0], sorted(POPS)[1:]
    pairs = list(itertools.combinations_with_replacement(rest, 2))
    use = [b for b in sorted(blocks) if b != drop]
    f2 = lambda t, p, q: 0.0 if p == q else t[p, q]
    x = [[(f2(blocks[b][0], base, p) + f2(blocks[b][0], base, q) - f2(blocks[b][0], p, q)) / 2 for p, q in pairs] for b in use]
    est, cov = moments(x, [blocks[b][2] for b in use])
    return base, pairs, est, cov, np.linalg.inv(cov + 1e-5 * np.trace(cov) * np.eye(len(cov)))


def weights_of(edges, leaf, alpha):
    """Edge -> share of the leaf's ancestry that passes it, walking up from the leaf."""
    ups = {}
    for a, b in edges:
        ups.setdefault(b, []).append(a)
    out, todo = Counter(), [(leaf, 1.0)]
    while todo:
        n, w = todo.pop()
        for k, p in enumerate(ups.get(n, [])):
            share = w if len(ups[n]) == 1 else w * (alpha[n] if k == 0 else 1 - alpha[n])
            if len(ups[n]) == 1:
                out[p, n] += share
            todo.append((p, share))
    return out, [e for e in edges if len(ups[e[1]]) == 1], [n for n, p in ups.items() if len(p) > 1]


def best_fit(edges, world, alpha=()):
    """Score and fitted f3 at the best non-negative lengths, over all sets of edges of positive length."""
    base, pairs, est, _, inv = world
    norm = weights_of(edges, base, alpha)[1]
    w = {p: np.array([weights_of(edges, p, alpha)[0][e] for e in norm]) for p in sorted(POPS)}
    d = np.array([(w[p] - w[base]) * (w[q] - w[base]) for p, q in pairs])
    h, g = d.T @ inv @ d, d.T @ inv @ est
    s = np.sqrt(np.maximum(np.diag(h), 1e-300))
    hs, gs = h / np.outer(s, s), g / s
    hs = hs + 1e-4 * np.mean(np.diag(hs)) * np.eye(len(hs))
    top = (0.0, np.zeros(len(gs)))
    for k in range(1, len(gs) + 1):
        for free in map(list, itertools.combinations(range(len(gs)), k)):
            y = np.linalg.solve(hs[np.ix_(free, free)], gs[free])
            if (y >= 0).all():
                x = np.zeros(len(gs))
                x[free] = y
                top = min(top, (0.5 * x @ hs @ x - gs @ x, x), key=lambda t: t[0])
    x = top[1] / s
    r = d @ x - est
    return float(r @ inv @ r), d @ x, dict(zip(norm, x))


def test_graph_fits(spark, blocks):
    world = f3_world(blocks)
    got = rows(spark, "graph_fit")
    tree = {(r["from"], r["to"]): r for r in got if r["graph_id"] == 0}
    score, fit, lengths = best_fit(MQ.TREE.edges, world)
    assert set(tree) == set(MQ.TREE.edges)
    assert all(math.isclose(r["score"], score, rel_tol=1e-6, abs_tol=1e-6) and abs(r["weight"] - lengths[e]) < 1e-6 for e, r in tree.items())
    graph = {(r["from"], r["to"]): r for r in got if r["graph_id"] == 1}
    edges = MQ.G.simplify(MQ.GRAPH).edges
    (node,) = {b for (a, b), r in graph.items() if r["type"] == "admix"}
    at = [r["weight"] for (a, b), r in graph.items() if r["type"] == "admix"]
    assert math.isclose(sum(at), 1, abs_tol=1e-8)
    first = next(a for a, b in edges if b == node)
    found = best_fit(edges, world, {node: graph[first, node]["weight"]})[0]
    grid = min(best_fit(edges, world, {node: v})[0] for v in np.linspace(0, 1, 41))
    assert math.isclose(found, next(iter(graph.values()))["score"], rel_tol=1e-5) and found <= grid * (1 + 1e-4) + 1e-6
    z = np.abs(fit - world[2]) / np.sqrt(np.diag(world[3]))
    assert all(math.isclose(r["worst_residual"], z.max(), rel_tol=1e-5) for r in tree.values())
    for r in rows(spark, "graph_f3_residuals"):
        k = world[1].index((r["pop2"], r["pop3"]))
        assert r["pop1"] == world[0] and abs(r["est"] - world[2][k]) < 1e-8 and abs(r["fit"] - fit[k]) < 1e-6 and math.isclose(r["se"], math.sqrt(world[3][k, k]), rel_tol=1e-6, abs_tol=1e-8)
        assert abs(r["z"] - (fit[k] - world[2][k]) / math.sqrt(world[3][k, k])) < 1e-4 and abs(r["p"] - math.erfc(abs(r["z"]) / math.sqrt(2))) < 1e-6


def test_graph_replicates_are_fits_of_blocks(spark, blocks):
    """Each replicate's score is that of the blocks drawn, a block taken twice being two blocks."""
    got = {r["rep"]: r for r in rows(spark, "graph_resample")}
    ids = sorted(blocks)
    assert sorted(got) == list(range(8)) and all(r["error"] is None for r in got.values())
    for rep in range(8):
        drawn = np.random.default_rng([0, rep]).integers(0, len(ids), len(ids))
        world = f3_world({k: blocks[ids[i]] for k, i in enumerate(sorted(drawn))})
        assert math.isclose(got[rep]["score"], best_fit(MQ.TREE.edges, world)[0], rel_tol=1e-4, abs_tol=1e-6)


def test_search_scores(spark, blocks):
    """Every graph that was met has the score of its own best fit, and the start is among them."""
    world = f3_world(blocks)
    stats = MQ.T.f3_stats(MQ._f2(spark, SF), POPS)
    log = MQ.T.find_graphs(spark, stats, numgraphs=4, stop_gen=3, starts=1).collect()
    reg = rows(spark, "graph_search")
    assert sorted((r["generation"], r["hash"], round(r["score"], 6)) for r in log) == sorted((r["generation"], r["hash"], round(r["score"], 6)) for r in reg)
    assert len({r["hash"] for r in log}) == len(log)
    for r in log:
        assert math.isclose(r["score"], best_fit([(e["from"], e["to"]) for e in r["edges"]], world)[0], rel_tol=1e-5, abs_tol=1e-6)


def clades(edges):
    """The leaf sets of a tree's nodes, which tell it from all others."""
    down = {}
    for a, b in edges:
        down.setdefault(a, []).append(b)
    under = lambda n: frozenset([n]) if n not in down else frozenset().union(*map(under, down[n]))
    return frozenset(under(n) for e in edges for n in e)


def cut(tree, keep):
    return frozenset(x for c in tree if (x := c & keep))


def all_trees(leaves):
    """Rooted binary trees as sets of clades, by splitting the leaves in two at the top."""
    leaves = frozenset(leaves)
    if len(leaves) == 1:
        yield frozenset([leaves])
        return
    first, *rest = sorted(leaves)
    for k in range(len(rest)):
        for more in itertools.combinations(rest, k):
            left = frozenset([first, *more])
            for a in all_trees(left):
                for b in all_trees(leaves - left):
                    yield a | b | {leaves}


def test_tree_neighbours(spark):
    """A subtree is cut off and hung elsewhere, not above the root: both trees have it as a clade and agree without it."""
    mine = clades(MQ.TREE.edges)
    got = {clades([(e["from"], e["to"]) for e in r["edges"]]) for r in MQ.T.enumerate_graphs(MQ.T.graphs_table(spark, [MQ.TREE]), "tree_neighbours").collect()}
    every = frozenset(POPS)

    def near(t):
        for s in mine & t - {every}:
            rest = every - s
            if cut(mine, s) == cut(t, s) and cut(mine, rest) == cut(t, rest) and (len(rest) == 1 or rest not in t or rest in mine):
                return True
        return False

    assert len(list(all_trees(POPS))) == 105
    assert got == {t for t in all_trees(POPS) if t != mine and near(t)} and len(rows(spark, "graph_tree_neighbours")) == len(got)


def test_embedded_trees(spark):
    g = MQ.G.simplify(MQ.GRAPH)
    got = {clades([(e["from"], e["to"]) for e in r["edges"]]) for r in MQ.T.enumerate_graphs(MQ.T.graphs_table(spark, [g]), "split_trees").collect()}
    (node,) = {b for _, b in g.edges if sum(y == b for _, y in g.edges) > 1}
    want = {clades([e for e in g.edges if e[1] != node or e == keep]) for keep in g.edges if keep[1] == node}
    assert got == want and len(rows(spark, "graph_split_trees")) == len(want)


def trimmed(edges):
    """Without dead ends and nodes that only pass on."""
    edges = set(edges)
    while True:
        ups, downs = ({n: [e for e in edges if e[k] == n] for e in edges for n in e} for k in (1, 0))
        dead = [e for e in edges if not downs[e[1]] and e[1] not in POPS]
        thin = next((n for n in ups if len(ups[n]) == 1 and len(downs[n]) == 1), None)
        top = next((n for n in ups if not ups[n] and len(downs[n]) == 1), None)
        if dead:
            edges -= set(dead)
        elif top is not None:
            edges -= set(downs[top])
        elif thin is not None:
            (a, _), (_, b) = ups[thin][0], downs[thin][0]
            edges = (edges - {(a, thin), (thin, b)}) | {(a, b)}
        else:
            return edges


def shape(edges):
    """Names of nodes by what is below them: equal for graphs that differ in the names of inner nodes only, as long as no two
    nodes have the same below them."""
    down = {}
    for a, b in edges:
        down.setdefault(a, []).append(b)
    name = lambda n: n if n not in down else "(" + ",".join(sorted(map(name, down[n]))) + ")"
    return tuple(sorted((name(a), name(b)) for a, b in edges))


def with_one_more(edges):
    """An admixture edge between any two edges that hang neither on one node nor below each other the wrong way round; the
    outgroup's side of the root stays free of it. Only of binary graphs."""
    edges, out = trimmed(edges), set()
    if max(Counter(a for a, _ in edges).values()) > 2:
        return out
    root = ({a for a, _ in edges} - {b for _, b in edges}).pop()
    reach = lambda n: {n}.union(*(reach(b) for a, b in edges if a == n))
    outgroup = any(a == root and b in POPS for a, b in edges)
    free = [e for e in edges if not (outgroup and e[0] == root)]
    for x, y in itertools.permutations(free, 2):
        if x[0] != y[0] and x[0] not in reach(y[1]):
            new = trimmed((edges - {x, y}) | {(x[0], "s"), ("s", x[1]), (y[0], "d"), ("d", y[1]), ("s", "d")})
            out.add(shape(new))
    return out


def test_one_edge_more(spark):
    of = lambda what, g: {shape([(e["from"], e["to"]) for e in r["edges"]]) for r in MQ.T.enumerate_graphs(MQ.T.graphs_table(spark, [g]), what).collect()}
    want = with_one_more(MQ.TREE.edges)
    assert of("plusone", MQ.TREE) == want and len(rows(spark, "graph_plusone")) == len(want)
    g = MQ.G.simplify(MQ.GRAPH)
    less = [[e for e in g.edges if e != x] for x in g.edges if sum(y == x[1] for _, y in g.edges) > 1]
    want = set().union(*map(with_one_more, less))
    assert of("minusplus", g) == want and len(rows(spark, "graph_minusplus")) == len(want)


def test_mixture_models_of_a_graph(spark):
    """Ranks of f4 matrices at random parameters, paths walked by hand."""
    g = MQ.G.simplify(MQ.GRAPH)
    rng = np.random.default_rng(8)
    (node,) = {b for _, b in g.edges if sum(y == b for _, y in g.edges) > 1}
    w = {p: weights_of(g.edges, p, {node: 0.37})[0] for p in POPS}
    drift = {e: rng.uniform(0.5, 1.5) for e in g.edges}
    f4 = lambda a, b, c, d: sum(drift[e] * (w[a][e] - w[b][e]) * (w[c][e] - w[d][e]) for e in drift)
    rank = lambda left, right: int(np.linalg.matrix_rank(np.array([[f4(left[0], x, right[0], y) for y in right[1:]] for x in left[1:]]), tol=1e-9))
    got = rows(spark, "graph_to_qpadm")
    assert len(got) == 6
    for r in got:
        a, b = rank(r["l"], r["r"]), rank([r["target"], *r["l"]], r["r"])
        assert (r["rank1"], r["rank2"], r["valid"]) == (a, b, a == b == len(r["l"]) - 1)


def test_models_without_one_block(spark, blocks):
    """qpwave with each block left out; qpadm over drawn blocks is a mixture whose weights add up to 1."""
    a, b, c, d, e = POPS
    got = {(r["rep"], r["f4rank"]): r for r in rows(spark, "qpwave_resampled")}
    assert {k for _, k in got} == {0} and {r for r, _ in got} == set(blocks)
    for rep in sorted(blocks)[::7]:
        use = [k for k in blocks if k != rep]
        est, cov = moments([[f4_of(blocks[k][1], a, b, c, x) for x in (d, e)] for k in use], [blocks[k][2] for k in use])
        s = cov + FUDGE * np.trace(cov) * np.eye(2)
        q = est @ np.linalg.solve(s, est)
        assert math.isclose(got[rep, 0]["chisq"], q, rel_tol=1e-6) and math.isclose(got[rep, 0]["p"], math.exp(-q / 2), rel_tol=1e-6, abs_tol=1e-8)
    sums = Counter()
    for r in rows(spark, "qpadm_resampled"):
        sums[r["rep"]] += r["weight"]
    assert len(sums) == 10 and all(abs(s - 1) < 1e-6 for s in sums.values())


def test_simulated_frequencies(spark):
    """Drift of 0.02 an edge: squared differences of leaves from their root and from each other grow with the edges between."""
    x = Q.queries()["graph_simulation"](spark, SF).toPandas()
    assert len(x) == 500 and ((x[POPS] >= 0) & (x[POPS] <= 1)).all().all()
    g = MQ.G.simplify(MQ.GRAPH)
    (node,) = {b for _, b in g.edges if sum(y == b for _, y in g.edges) > 1}
    w = {p: weights_of(g.edges, p, {node: 0.5})[0] for p in POPS}
    for p, q in itertools.combinations(POPS, 2):
        want = 0.02 / 6 * sum((w[p][e] - w[q][e]) ** 2 for e in g.edges)  # p(1 - p) is 1/6 on average
        assert 0.5 * want < ((x[p] - x[q]) ** 2).mean() < 1.6 * want
    pc = {r["pop"]: r["pc1"] for r in rows(spark, "graph_pcs")}
    m = x[POPS].to_numpy() - x[POPS].to_numpy().mean(1, keepdims=True)
    m = m - m.mean(0)
    val, vec = np.linalg.eigh(m.T @ m / (len(m) - 1))
    assert all(abs(pc[p] - abs(vec[i, -1]) * math.sqrt(val[-1])) < 1e-6 for i, p in enumerate(POPS))
