"""Fitting and searching admixture graphs.

Graphs are rows (graph_id, edges); each is fitted in a task of its own. What they are fitted to, f3 statistics of
all pairs against a base population per block, is a small table (blocks x pairs of populations) that is computed
by Spark once and broadcast; its size is checked.
"""
from __future__ import annotations

import itertools
import random
import time
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import graph as G
from ..functions import topology as Y
from ..functions.numerics import bounded_qp, minimise, normal_two_sided, t_two_sided
from .fstats import F3_TERMS, combine, combs_table
from .models import grid_stats

DIAG, DIAG_F3, STARTS = 1e-4, 1e-5, 10
#: cells of the broadcast block table
MAX_CELLS = 50_000_000
EDGES = "array<struct<from:string,to:string>>"


@dataclass
class Stats:
    """f3(base; i, j) of pairs of the other populations."""

    pops: list[str]
    pairs: list[tuple[int, int]]
    blocks: np.ndarray
    weights: np.ndarray
    est: np.ndarray
    cov: np.ndarray
    inv: np.ndarray

    @classmethod
    def of(cls, pops, pairs, blocks, weights, diag_f3=DIAG_F3, lsq=False) -> Stats:
        est, cov, _ = grid_stats(blocks, weights)
        ridge = cov + diag_f3 * np.trace(cov) * np.eye(len(cov))
        return cls(pops, pairs, blocks, weights, est, cov, np.eye(len(cov)) if lsq else np.linalg.inv(ridge))

    def drawn(self, times: np.ndarray) -> Stats:
        """The same with block k taken times[k] times."""
        i = np.repeat(np.arange(len(times)), times)
        return Stats.of(self.pops, self.pairs, self.blocks[i], self.weights[i])


def f3_stats(f2: DataFrame, pops: list[str], base: str | None = None, lsq: bool = False) -> Stats:
    pops = sorted(pops)
    base = base or pops[0]
    rest = [p for p in pops if p != base]
    pairs = list(itertools.combinations_with_replacement(range(len(rest)), 2))
    blocks_n = f2.select("block").distinct().count()
    if blocks_n * len(pairs) > MAX_CELLS:
        raise ValueError(f"{blocks_n} blocks x {len(pairs)} pairs of populations are more than {MAX_CELLS} cells")
    f3 = combine(f2, combs_table(f2, [(base, rest[i], rest[j]) for i, j in pairs]), F3_TERMS).where("est IS NOT NULL").toPandas()
    wide = f3.pivot_table(index="block", columns=["pop2", "pop3"], values="est")[[(rest[i], rest[j]) for i, j in pairs]].dropna()
    w = f3.groupby("block")["n_snps"].max().reindex(wide.index).to_numpy(float)
    return Stats.of([base, *rest], pairs, wide.to_numpy(), w, lsq=lsq)


def fit_graph(g: G.Graph, s: Stats, starts: int = STARTS, seed: int = 0, diag: float = DIAG, constrained: bool = True) -> dict:
    """Edges with weights, score, worst residual."""
    adm = g.admixnodes
    at = {x: i for i, x in enumerate(g.leaves)}
    cols = [at[p] for p in s.pops]

    def lengths(alpha: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        w = G.path_weights(g, dict(zip(adm, alpha)))[:, cols]
        d = w[:, 1:] - w[:, :1]
        p = np.array([d[:, i] * d[:, j] for i, j in s.pairs])
        h = p.T @ s.inv @ p
        scale = np.sqrt(np.maximum(np.diag(h), 1e-300))
        hs = h / scale[:, None] / scale
        hs += diag * np.mean(np.diag(hs)) * np.eye(len(hs))
        x = bounded_qp(hs, (p.T @ s.inv @ s.est) / scale, 0.0 if constrained else -np.inf) / scale
        return x, p @ x

    def score(alpha: np.ndarray) -> float:
        r = lengths(alpha)[1] - s.est
        return float(r @ s.inv @ r)

    best = (np.zeros(0), score(np.zeros(0))) if not adm else None
    rng = np.random.default_rng(seed)
    for _ in range(starts if adm else 0):
        got = minimise(score, rng.uniform(0.05, 0.95, len(adm)), np.zeros(len(adm)), np.ones(len(adm)))
        if best is None or got[1] < best[1]:
            best = got
    x, fit = lengths(best[0])
    z = (fit - s.est) / np.sqrt(np.maximum(np.diag(s.cov), 1e-300))
    rows = [(a, b, "normal", float(v)) for (a, b), v in zip(g.normedges, x)]
    for n, v in zip(adm, best[0]):
        rows += [(g.up[n][0], n, "admix", float(v)), (g.up[n][1], n, "admix", float(1 - v))]
    return {"edges": rows, "score": best[1], "worst_residual": float(np.abs(z).max()), "fit": fit}


def graphs_table(spark: SparkSession, graphs: list[G.Graph]) -> DataFrame:
    return spark.createDataFrame([(i, list(g.edges)) for i, g in enumerate(graphs)], f"graph_id long, edges {EDGES}")


def _graph(edges) -> G.Graph:
    return G.Graph((e["from"], e["to"]) for e in edges)


def _per_graph(graphs: DataFrame, make, schema: str) -> DataFrame:
    """make(graph) -> rows; a graph a task row."""
    names = ["graph_id", *(c.strip().split()[0] for c in schema.split(", "))]

    def run(frames):
        for pdf in frames:
            yield pd.DataFrame([(i, *row) for i, e in zip(pdf.graph_id, pdf.edges) for row in make(_graph(e))], columns=names)

    return graphs.select("graph_id", "edges").mapInPandas(run, f"graph_id long, {schema}")


def qpgraph(graphs: DataFrame, s: Stats, starts: int = STARTS, seed: int = 0) -> DataFrame:
    """graph_id, from, to, type, weight, score, worst_residual."""
    shared = graphs.sparkSession.sparkContext.broadcast(s)

    def make(g):
        got = fit_graph(g, shared.value, starts, seed)
        return [(*e, got["score"], got["worst_residual"]) for e in got["edges"]]

    return _per_graph(graphs, make, "from string, to string, type string, weight double, score double, worst_residual double")


def qpgraph_f3(graphs: DataFrame, s: Stats, starts: int = STARTS) -> DataFrame:
    """Estimated and fitted f3: graph_id, pop1, pop2, pop3, est, se, fit, diff, z, p."""
    shared = graphs.sparkSession.sparkContext.broadcast(s)

    def make(g):
        t = shared.value
        fit, se = fit_graph(g, t, starts)["fit"], np.sqrt(np.diag(t.cov))
        for (i, j), e, d, f in zip(t.pairs, t.est, se, fit):
            z = (f - e) / d if d else None
            yield t.pops[0], t.pops[1 + i], t.pops[1 + j], float(e), float(d), float(f), float(f - e), z, normal_two_sided(z)

    return _per_graph(graphs, make, "pop1 string, pop2 string, pop3 string, est double, se double, fit double, diff double, z double, p double")


def qpgraph_resample(graphs: DataFrame, s: Stats, nboot: int | None = None, starts: int = 3, seed: int = 0) -> DataFrame:
    """Every graph fitted to each replicate, blocks left out one by one or, with nboot, drawn; scored on the blocks not
    in it: graph_id, rep, score, score_test, error."""
    spark = graphs.sparkSession
    shared = spark.sparkContext.broadcast(s)
    reps = nboot or len(s.weights)
    rows = graphs.select("graph_id", "edges", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))).alias("rep")).repartition("graph_id", "rep")

    def run(frames):
        t = shared.value
        m = len(t.weights)
        for pdf in frames:
            out = []
            for gid, e, rep in zip(pdf.graph_id, pdf.edges, pdf.rep):
                times = np.bincount(np.random.default_rng([seed, rep]).integers(0, m, m), minlength=m) if nboot else (np.arange(m) != rep).astype(int)
                try:
                    got = fit_graph(_graph(e), t.drawn(times), starts, seed)
                    out_ = times == 0
                    test = t.weights[out_] @ t.blocks[out_] / t.weights[out_].sum() if out_.any() else t.est
                    r = got["fit"] - test
                    out.append((gid, rep, got["score"], float(r @ t.inv @ r), None))
                except np.linalg.LinAlgError as err:
                    out.append((gid, rep, None, None, str(err)))
            yield pd.DataFrame(out, columns=["graph_id", "rep", "score", "score_test", "error"])

    return rows.mapInPandas(run, "graph_id long, rep int, score double, score_test double, error string")


def score_pvalue(fits: list[float], tests: list[float]) -> float:
    """t-test of fitted against out-of-sample scores."""
    d = np.array(tests) - np.array(fits)
    return t_two_sided(float(d.mean() / (d.std(ddof=1) / np.sqrt(len(d)))), len(d) - 1)


def enumerate_graphs(graphs: DataFrame, what) -> DataFrame:
    """Neighbours of each graph, one row each and none twice: parent, hash, edges. what: plusone, minusone, minusplus,
    flips, split_trees, tree_neighbours, decomposed_tree_neighbours, or a function from a graph to graphs."""
    step = what if callable(what) else getattr(G, what)

    def run(frames):
        for pdf in frames:
            yield pd.DataFrame([(i, G.graph_hash(h), [{"from": a, "to": b} for a, b in h.edges]) for i, e in zip(pdf.graph_id, pdf.edges) for h in step(_graph(e))], columns=["parent", "hash", "edges"])

    return graphs.select("graph_id", "edges").mapInPandas(run, f"parent long, hash string, edges {EDGES}").dropDuplicates(["parent", "hash"])


def summaries(graphs: DataFrame, what: str) -> DataFrame:
    """Per graph: descendants (node, leaf), numadmix (pop, n), zerof4 (pop1..pop4), eventorder (earlier1, earlier2, later1,
    later2), triples (pop1, pop2, pop3, outgroup, n), proxies (pop, source, proxy), pair_percentages (pop1, pop2, share), and
    those of functions.topology: count_admix, edge_targets, triplets, triplesig, triple_topology, root_paths, path_triples,
    node_names, node_signature, condensed, pair_admix, invariants."""
    forms = {
        "descendants": ("node string, leaf string", lambda g: [(n, x) for n, ls in G.descendants(g).items() for x in ls]),
        "numadmix": ("pop string, n int", lambda g: list(G.numadmix_by_leaf(g).items())),
        "zerof4": ("pop1 string, pop2 string, pop3 string, pop4 string", G.zero_f4),
        "eventorder": ("earlier1 string, earlier2 string, later1 string, later2 string", lambda g: [(*a, *b) for a, b in G.event_order(g)]),
        "triples": ("pop1 string, pop2 string, pop3 string, outgroup string, n int", lambda g: [(*t, o, n) for t, k in G.triples(g).items() for o, n in k.items()]),
        "proxies": ("pop string, source string, proxy string", G.proxies),
        "pair_percentages": ("pop1 string, pop2 string, share double", lambda g: [(*k, v) for k, v in G.pair_percentages(g).items()]),
        "count_admix": ("pop string, n int", lambda g: list(Y.count_admix(g).items())),
        "edge_targets": ("from string, to string, targets array<string>, identifiable boolean", Y.edge_targets),
        "triplets": ("outgroup string, pop1 string, pop2 string", lambda g: sorted(Y.tree_triplets(g))),
        "triplesig": ("pop1 string, pop2 string, other string, inside boolean", lambda g: [(*k, v) for k, v in Y.triplesig(g).items()]),
        "triple_topology": ("pop1 string, pop2 string, pop3 string, topo string", Y.triple_topology),
        "root_paths": ("pop string, path array<string>, admedges array<string>", lambda g: [(p["pop"], p["path"], p["admedges"]) for p in Y.root_paths(g)]),
        "path_triples": ("pop1 string, pop2 string, pop3 string, outgroup string", lambda g: [(p["pop1"], p["pop2"], p["pop3"], p["outgroup"]) for p in Y.path_triples(g)]),
        "node_names": ("node string, name string", lambda g: list(zip(g.nodes, Y.rename_internal(g).nodes))),
        "node_signature": ("node string, signature string", lambda g: list(Y.node_signature(g).items())),
        "condensed": ("from string, to string", Y.condense_graph),
        "pair_admix": ("pop1 string, pop2 string, dir int", lambda g: [(*k, v) for k, v in Y.pair_admix(g).items()]),
        "invariants": ("pop1 string, pop2 string, pop3 string, pop4 string", Y.find_invariants),
    }
    schema, make = forms[what]
    return _per_graph(graphs, make, schema)


def summary_support(summary: DataFrame) -> DataFrame:
    """How many of the graphs have each row of a summary: the columns, n, share."""
    keys = [c for c in summary.columns if c != "graph_id"]
    total = summary.agg(F.count_distinct("graph_id").alias("total"))
    n = summary.groupBy(*keys).agg(F.count_distinct("graph_id").alias("n_graphs"))
    return n.crossJoin(F.broadcast(total)).withColumn("share", F.col("n_graphs") / F.col("total")).drop("total")


def find_graphs(spark: SparkSession, s: Stats, *, numadmix: int = 0, outpop: str | None = None, numgraphs: int = 10, stop_gen: int = 100, stop_gen2: int = 15, stop_score: float = 0.0, stop_sec: float | None = None, initgraph: G.Graph | None = None, accept=None, seed: int = 0, starts: int = 3) -> DataFrame:
    """Hill climbing with mutations; each generation's candidates are fitted in parallel. Stops after stop_gen
    generations, stop_gen2 without gain, at a score or a time. generation, hash, lasthash, mutations, score, edges."""
    rng = random.Random(seed)
    now = initgraph or G.random_graph(sorted(s.pops), numadmix, outpop, seed, accept)
    if now is None:
        raise ValueError("no graph meets the constraints")
    seen: dict[str, float] = {}
    log, best, idle, began = [], float("inf"), 0, time.monotonic()
    lasthash = ""
    for gen in range(stop_gen):
        cands: dict[str, tuple[G.Graph, int]] = {} if gen else {G.graph_hash(now): (now, 0)}
        for _ in range(20 * numgraphs):
            if len(cands) >= numgraphs:
                break
            k = rng.randint(1, 2)
            h = G.mutate(now, k, rng)
            if G.graph_hash(h) not in seen and (accept is None or accept(h)):
                cands.setdefault(G.graph_hash(h), (h, k))
        if not cands:
            break
        keys = list(cands)
        got = qpgraph(graphs_table(spark, [cands[h][0] for h in keys]).repartition(len(keys)), s, starts, seed).groupBy("graph_id").agg(F.first("score").alias("score")).collect()  # numgraphs rows
        for r in got:
            h = keys[r["graph_id"]]
            seen[h] = r["score"]
            log.append((gen, h, lasthash, cands[h][1], r["score"], list(cands[h][0].edges)))
        top = min(keys, key=lambda h: seen[h])
        if seen[top] < best - 1e-9:
            best, now, lasthash, idle = seen[top], cands[top][0], top, 0
        else:
            idle += 1
        if idle >= stop_gen2 or best <= stop_score or stop_sec and time.monotonic() - began > stop_sec:
            break
    return spark.createDataFrame(log, f"generation int, hash string, lasthash string, mutations int, score double, edges {EDGES}")


def simulate_frequencies(spark: SparkSession, g: G.Graph, nsnps: int = 10_000, drift: float = 0.02, admix: float = 0.5, seed: int = 0, leaves_only: bool = True) -> DataFrame:
    """Frequencies drifting down a graph, a column a node: variant_idx, ..."""
    df = spark.range(nsnps).withColumnRenamed("id", "variant_idx").withColumn(g.root, F.rand(seed))
    for k, n in enumerate(g.order[1:]):
        up = g.up[n]
        if len(up) == 2:
            df = df.withColumn(n, admix * F.col(up[0]) + (1 - admix) * F.col(up[1]))
        else:
            p = F.col(up[0])
            df = df.withColumn(n, F.greatest(F.lit(0.0), F.least(F.lit(1.0), p + F.randn(seed + k + 1) * F.sqrt(drift * p * (1 - p)))))
    return df.select("variant_idx", *(g.leaves if leaves_only else g.order))


def pcs(wide: DataFrame, pops: list[str], k: int = 2) -> DataFrame:
    """Principal components of populations from their frequencies; the covariance (populations squared) is
    summed by Spark."""
    cells = [F.covar_samp(a, b).alias(f"{i}_{j}") for i, a in enumerate(pops) for j, b in enumerate(pops)]
    row = wide.agg(*cells).first()
    c = np.array(row).reshape(len(pops), len(pops))
    m = np.eye(len(pops)) - 1 / len(pops)
    val, vec = np.linalg.eigh(m @ c @ m)
    top = np.argsort(val)[::-1][:k]
    return wide.sparkSession.createDataFrame([(p, *map(float, vec[i, top] * np.sqrt(np.maximum(val[top], 0)))) for i, p in enumerate(pops)], ", ".join(["pop string", *(f"pc{i + 1} double" for i in range(k))]))


# --- guided search: scoring of variants, and the search as a table


def evaluate(graphs: DataFrame, what, s: Stats, *, accept=None, ntry: int | None = None, starts: int = 3, seed: int = 0) -> DataFrame:
    """The variants of each graph that ``enumerate_graphs`` gives, those that accept (graph -> bool) lets through, ntry of a
    parent at most (a feature: the ones of the least hash), each fitted: parent, hash, edges, score, worst_residual."""
    cands = enumerate_graphs(graphs, what)
    if accept is not None:
        cands = cands.where(F.udf(lambda e: bool(accept(_graph(e))), "boolean")("edges"))
    if ntry is not None:
        cands = cands.withColumn("k", F.row_number().over(Window.partitionBy("parent").orderBy("hash"))).where(F.col("k") <= ntry).drop("k")
    shared = graphs.sparkSession.sparkContext.broadcast(s)

    def run(frames):
        for pdf in frames:
            got = [fit_graph(_graph(e), shared.value, starts, seed) for e in pdf.edges]
            yield pdf.assign(score=[x["score"] for x in got], worst_residual=[x["worst_residual"] for x in got])

    # one parent's variants are many fits: they are dealt over all tasks by their own hash
    return cands.repartition("hash").mapInPandas(run, f"parent long, hash string, edges {EDGES}, score double, worst_residual double")


def eval_plusnadmix(graphs: DataFrame, s: Stats, n: int = 1, **how) -> DataFrame:
    return evaluate(graphs, lambda g: Y.plusn([g], n), s, **how)


def eval_minusnadmix(graphs: DataFrame, s: Stats, n: int = 1, **how) -> DataFrame:
    return evaluate(graphs, lambda g: Y.minusn([g], n), s, **how)


def eval_plusminusn(graphs: DataFrame, s: Stats, n: int = 1, **how) -> DataFrame:
    """n admixture edges more and then n less."""
    return evaluate(graphs, lambda g: Y.minusn(Y.plusn([g], n), n), s, **how)


def eval_plusonepop(graphs: DataFrame, pop: str, s: Stats, **how) -> DataFrame:
    """A population hung on every edge."""
    return evaluate(graphs, lambda g: G.addleaf(g, pop), s, **how)


def evaluate_moreadmix(spark: SparkSession, g: G.Graph, s: Stats, maxadmix: int, **how) -> DataFrame:
    """The best graph of each number of admixture edges, each made from the one before: numadmix, hash, score, edges."""
    rows, now = [], g
    for n in range(g.numadmix + 1, maxadmix + 1):
        best = eval_plusnadmix(graphs_table(spark, [now]), s, **how).orderBy("score", "hash").limit(1).collect()  # one row
        if not best:
            break
        now = _graph([e.asDict() for e in best[0]["edges"]])
        rows.append((n, best[0]["hash"], best[0]["score"], list(now.edges)))
    return spark.createDataFrame(rows, f"numadmix int, hash string, score double, edges {EDGES}")


def search_tree(log: DataFrame) -> DataFrame:
    """The search of ``find_graphs`` as a tree: hash, lasthash, generation, score, children, best score among them, and the gain
    over the graph it was made from."""
    below = log.where("lasthash <> ''").groupBy(F.col("lasthash").alias("hash")).agg(F.count("*").alias("children"), F.min("score").alias("best_child"))
    parent = log.groupBy(F.col("hash").alias("lasthash")).agg(F.min("score").alias("parent_score"))
    own = log.select("hash", "lasthash", "generation", "score")
    return own.join(below, "hash", "left").join(parent, "lasthash", "left").select(
        "hash", "lasthash", "generation", "score", F.coalesce("children", F.lit(0)).alias("children"), "best_child", (F.col("parent_score") - F.col("score")).alias("gain"))


def graph_potential(tree: DataFrame) -> DataFrame:
    """How much a graph of the search is worth coming back to: the less its score above the best, the fewer its children and the
    more they gained, the higher."""
    top = tree.agg(F.min("score").alias("top"))
    worth = F.col("top") / F.col("score") * F.coalesce(F.col("score") / F.col("best_child"), F.lit(1.0)) / (F.col("children") + 1)
    return tree.crossJoin(F.broadcast(top)).withColumn("potential", worth).drop("top")  # top: one row


def pick_graph(tree: DataFrame, *, patience: int = 3, greedy: float = 0.5, seed: int = 0) -> DataFrame:
    """The graph of ``search_tree`` to go on from, one row: the best one while nothing has been made from it, while it is no older
    than patience generations, or in the share greedy of all cases; else one of those nothing has been made from, drawn with
    weight potential to the tenth power."""
    rng = random.Random(seed)
    best = tree.orderBy("score", "hash").limit(1)
    first, last = best.select("children", "generation").first(), tree.agg(F.max("generation")).first()[0]
    if first is None or not first["children"] or last - first["generation"] < patience or rng.random() < greedy:
        return best
    u = (F.pmod(F.xxhash64("hash", F.lit(seed)), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    open_ = graph_potential(tree).where("children = 0")  # the least of exponential waiting times is a weighted draw
    return open_.orderBy(-F.log(u) / F.pow("potential", F.lit(10.0)), "hash").limit(1).select(tree.columns)


def pick_earlier(tree: DataFrame, generation: int) -> DataFrame:
    """Going back: the best graph nothing has been made from, of the last generation before this one that has any; one row."""
    return tree.where((F.col("generation") < generation) & (F.col("children") == 0)).orderBy(F.desc("generation"), "score", "hash").limit(1)


def evolve(spark: SparkSession, s: Stats, *, numadmix: int = 0, outpop: str | None = None, numrep: int = 1, numgraphs: int = 50, numgen: int = 5, numsel: int = 5, initgraphs: list[G.Graph] | None = None, seed: int = 0, starts: int = 3) -> DataFrame:
    """Independent repeats of an evolutionary search, all of a generation's graphs in one job: rep, generation, hash, score, edges.
    Of each repeat numsel graphs are drawn by ``topology.score_to_prob`` and mutated."""
    rng = random.Random(seed)
    pops = sorted(s.pops)
    now = {r: [*(initgraphs or []), *(G.random_graph(pops, numadmix, outpop, rng.randrange(1 << 30)) for _ in range(numgraphs - len(initgraphs or [])))] for r in range(numrep)}
    log = []
    for gen in range(numgen):
        flat = [(r, g) for r, gs in now.items() for g in gs if g is not None]
        got = {x["graph_id"]: x["score"] for x in qpgraph(graphs_table(spark, [g for _, g in flat]).repartition(len(flat)), s, starts, seed).groupBy("graph_id").agg(F.first("score").alias("score")).collect()}  # numrep * numgraphs rows
        log += [(r, gen, G.graph_hash(g), got[i], list(g.edges)) for i, (r, g) in enumerate(flat)]
        for r in now:
            mine = [(got[i], g) for i, (x, g) in enumerate(flat) if x == r]
            best = min(mine, key=lambda m: m[0])[1]
            chosen = [best, *rng.choices([g for _, g in mine], [p + 1e-12 for p in Y.score_to_prob(max(v, 1.1) for v, _ in mine)], k=numsel - 1)]
            now[r] = [best, *(G.mutate(rng.choice(chosen), rng.randint(1, 2), rng) for _ in range(numgraphs - 1))]
    return spark.createDataFrame(log, f"rep int, generation int, hash string, score double, edges {EDGES}")
