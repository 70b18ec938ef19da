"""Rank tests and mixture models on f4 grids: qpwave, qpadm and their families.

The block table of all models comes from one pass over the f2 blocks; each model's grid (blocks x left x
right, a few thousand numbers) is then one group of a grouped map, so models run in parallel on executors.
"""
from __future__ import annotations

import itertools
from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numerics import bounded_qp, chi2_sf, normal_two_sided
from .fstats import f4_blocks

FUDGE = 1e-4
ITERATIONS = 20


def grid_stats(blocks: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """blocks x cells and block weights -> estimates, covariance, leave-one-out values."""
    r = weights / weights.sum()
    tot = r @ blocks
    loo = (tot - blocks * r[:, None]) / (1 - r)[:, None]
    est = (tot - loo).sum(0) + r @ loo
    h = (1 / r)[:, None]
    tau = (h * est - (h - 1) * loo - tot) / np.sqrt(h - 1)
    return est, tau.T @ tau / len(r), loo


def inverse_covariance(cov: np.ndarray, fudge: float = FUDGE) -> np.ndarray:
    return np.linalg.inv(cov + fudge * np.trace(cov) * np.eye(len(cov)))


def _ridge(m: np.ndarray, q: np.ndarray, x: np.ndarray, fudge: float) -> np.ndarray:
    a = m.T @ q @ m
    return np.linalg.solve(a + fudge * np.trace(a) * np.eye(len(a)), m.T @ q @ x)


def factorise(x: np.ndarray, q: np.ndarray, rank: int, fudge: float = FUDGE, iterations: int = ITERATIONS) -> tuple[np.ndarray, np.ndarray]:
    """x (left x right) near a b of this rank in the metric q of its row-major cells: an SVD start, then generalised
    least squares for one factor at a time."""
    nl, nr = x.shape
    if rank == 0:
        return np.zeros((nl, 0)), np.zeros((0, nr))
    b = np.linalg.svd(x)[2][:rank]
    a = x @ b.T
    flat = x.ravel()
    for _ in range(iterations):
        a = _ridge(np.kron(np.eye(nl), b.T), q, flat, fudge).reshape(nl, rank)
        b = _ridge(np.kron(a, np.eye(nr)), q, flat, fudge).reshape(rank, nr)
    return a, b


def mixture_weights(x: np.ndarray, q: np.ndarray, fudge: float = FUDGE, iterations: int = ITERATIONS, constrained: bool = False) -> np.ndarray:
    a, _ = factorise(x, q, len(x) - 1, fudge, iterations)
    m = np.c_[a, np.ones(len(a))].T
    y = np.r_[np.zeros(m.shape[0] - 1), 1.0]
    if constrained:
        h = m.T @ m
        w = bounded_qp(h + 1e-10 * np.trace(h) * np.eye(len(h)), m.T @ y, 0.0, np.inf, 1.0)
    else:
        w = np.linalg.lstsq(m, y, rcond=None)[0]
    return w / w.sum()


def dof(nl: int, nr: int, rank: int) -> int:
    return (nl - rank) * (nr - rank)


def rank_fit(x: np.ndarray, q: np.ndarray, rank: int, fudge: float = FUDGE) -> dict:
    a, b = factorise(x, q, rank, fudge)
    r = (x - a @ b).ravel()
    chisq, d = float(r @ q @ r), dof(*x.shape, rank)
    return {"f4rank": rank, "dof": d, "chisq": chisq, "p": chi2_sf(chisq, d)}


def _nested(rows: list[dict]) -> list[dict]:
    for row, less in itertools.zip_longest(rows, rows[1:]):
        diff = less["dof"] - row["dof"] if less else None
        row["dofdiff"] = diff
        row["chisqdiff"] = less["chisq"] - row["chisq"] if less else None
        row["p_nested"] = chi2_sf(row["chisqdiff"], diff) if less and diff > 0 else None
    return rows


def rankdrop(x: np.ndarray, q: np.ndarray, fudge: float = FUDGE) -> list[dict]:
    return _nested([rank_fit(x, q, r, fudge) for r in range(min(x.shape) - (x.shape[0] <= x.shape[1]), -1, -1)])


def _part(x: np.ndarray, q: np.ndarray, keep: list[int]) -> tuple[np.ndarray, np.ndarray]:
    cells = np.concatenate([np.arange(i * x.shape[1], (i + 1) * x.shape[1]) for i in keep])
    return x[keep], np.linalg.inv(np.linalg.inv(q)[np.ix_(cells, cells)])


def popdrop(x: np.ndarray, q: np.ndarray, fudge: float = FUDGE, constrained: bool = False) -> list[dict]:
    """A row for each non-empty set of sources, ties in the order of the pattern."""
    n, rows = len(x), []
    for pat in sorted(itertools.product((0, 1), repeat=n), key=lambda p: (sum(p), p)):
        keep = [i for i in range(n) if not pat[i]]
        if not keep:
            continue
        xs, qs = _part(x, q, keep)
        row = rank_fit(xs, qs, len(keep) - 1, fudge)
        w = mixture_weights(xs, qs, fudge, constrained=constrained)
        full = [None] * n
        for i, v in zip(keep, w):
            full[i] = float(v)
        rows.append({"pat": "".join(map(str, pat)), "wt": sum(pat), **row, "weights": full, "feasible": bool(((w >= 0) & (w <= 1)).all())})
    best = {}
    for row in rows:
        k = (row["wt"], not row["feasible"], row["chisq"], row["pat"])
        if row["wt"] not in best or k < best[row["wt"]][0]:
            best[row["wt"]] = (k, row["pat"])
    for row in rows:
        row["best"] = best[row["wt"]][1] == row["pat"]
    return rows


def weight_errors(loo: np.ndarray, shape: tuple[int, int], q: np.ndarray, fudge: float = FUDGE, constrained: bool = False) -> np.ndarray:
    """Standard errors over leave-one-out replicates, scaled by sqrt(m - 1); a single source's weight is 1 without error."""
    if shape[0] == 1:
        return np.zeros(1)
    w = np.array([mixture_weights(row.reshape(shape), q, fudge, constrained=constrained) for row in loo]) * np.sqrt(len(loo) - 1)
    return w.std(0, ddof=1)


def models_table(df: DataFrame, models: Iterable[dict]) -> DataFrame:
    """models: dicts with left, right and, for mixtures, target."""
    rows = [(i, m.get("target"), list(m["left"]), list(m["right"])) for i, m in enumerate(models)]
    return df.sparkSession.createDataFrame(rows, "model int, target string, left array<string>, right array<string>")


def model_combinations(models: DataFrame) -> DataFrame:
    """model, i, j, pop1..pop4: f4(first, i-th left; first right, j-th right), first being the target or, without one, the first left."""
    m = models.withColumn("first", F.coalesce("target", F.element_at("left", 1)))
    m = m.withColumn("ls", F.when(F.col("target").isNull(), F.slice("left", 2, F.size("left"))).otherwise(F.col("left")))
    m = m.select("model", "first", F.posexplode("ls").alias("i", "pop2"), "right")
    return m.select("model", "i", F.col("first").alias("pop1"), "pop2", F.element_at("right", 1).alias("pop3"), F.posexplode(F.slice("right", 2, F.size("right"))).alias("j", "pop4"))


def model_blocks(f2: DataFrame, models: DataFrame) -> DataFrame:
    """model, block, i, j, est, n_snps for all models in one pass."""
    return f4_blocks(f2, model_combinations(models)).select("model", "block", "i", "j", "est", "n_snps").where("est IS NOT NULL")


def complete_rows(pdf: pd.DataFrame) -> tuple[pd.DataFrame, pd.Series]:
    """blocks x cells of the blocks that have all cells, and their weights."""
    wide = pdf.pivot_table(index="block", columns=["i", "j"], values="est").dropna()
    return wide, pdf.groupby("block")["n_snps"].max().reindex(wide.index)


def _grid(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, tuple[int, int]]:
    wide, w = complete_rows(pdf)
    return wide.to_numpy(), w.to_numpy(float), (int(pdf["i"].max()) + 1, int(pdf["j"].max()) + 1)


def fit_grid(blocks: np.ndarray, w: np.ndarray, shape: tuple[int, int], *, fudge: float = FUDGE, constrained: bool = False, getcov: bool = True) -> dict:
    est, cov, loo = grid_stats(blocks, w)
    x, q = est.reshape(shape), inverse_covariance(cov, fudge)
    weights = mixture_weights(x, q, fudge, constrained=constrained)
    se = weight_errors(loo, shape, q, fudge, constrained) if getcov else np.full(len(weights), np.nan)
    ev = np.linalg.eigvalsh(cov)
    return {"weights": weights, "se": se, "rankdrop": rankdrop(x, q, fudge), "popdrop": popdrop(x, q, fudge, constrained), "rcond": float(ev[0] / ev[-1]) if ev[-1] > 0 else 0.0}


def _mapped(blocks: DataFrame, models: DataFrame, make, schema: str) -> DataFrame:
    fit = blocks.groupBy("model").applyInPandas(lambda key, pdf: pd.DataFrame([{"model": key[0], **row} for row in make(pdf)], columns=[c.strip().split()[0] for c in schema.split(", ")]), schema)
    return fit.join(models, "model")


def qpadm(f2: DataFrame, models: DataFrame, *, fudge: float = FUDGE, constrained: bool = False, getcov: bool = True) -> DataFrame:
    """model, target, left, right, source, weight, se, z."""
    def make(pdf):
        b, w, shape = _grid(pdf)
        got = fit_grid(b, w, shape, fudge=fudge, constrained=constrained, getcov=getcov)
        return [{"k": i, "weight": a, "se": s, "z": a / s if s else None, "rcond": got["rcond"]} for i, (a, s) in enumerate(zip(got["weights"], got["se"]))]
    out = _mapped(model_blocks(f2, models), models, make, "model int, k int, weight double, se double, z double, rcond double")
    return out.select("model", "target", F.element_at("left", F.col("k") + 1).alias("source"), "weight", "se", "z", "rcond")


def qpadm_rankdrop(f2: DataFrame, models: DataFrame, fudge: float = FUDGE) -> DataFrame:
    """Rank tests (qpwave where target is null): model, f4rank, dof, chisq, p, dofdiff, chisqdiff, p_nested."""
    def make(pdf):
        b, w, shape = _grid(pdf)
        est, cov, _ = grid_stats(b, w)
        return rankdrop(est.reshape(shape), inverse_covariance(cov, fudge), fudge)
    return _mapped(model_blocks(f2, models), models, make, "model int, f4rank int, dof int, chisq double, p double, dofdiff int, chisqdiff double, p_nested double").drop("left", "right")


def qpadm_popdrop(f2: DataFrame, models: DataFrame, fudge: float = FUDGE, constrained: bool = False) -> DataFrame:
    def make(pdf):
        b, w, shape = _grid(pdf)
        est, cov, _ = grid_stats(b, w)
        return popdrop(est.reshape(shape), inverse_covariance(cov, fudge), fudge, constrained)
    return _mapped(model_blocks(f2, models), models, make, "model int, pat string, wt int, dof int, chisq double, p double, f4rank int, weights array<double>, feasible boolean, best boolean").drop("right")


def qpadm_p(f2: DataFrame, models: DataFrame, fudge: float = FUDGE, rank: int | None = None) -> DataFrame:
    """Reduced result: model, f4rank, dof, chisq, p, feasible."""
    def make(pdf):
        b, w, shape = _grid(pdf)
        est, cov, _ = grid_stats(b, w)
        x, q = est.reshape(shape), inverse_covariance(cov, fudge)
        weights = mixture_weights(x, q, fudge)
        return [{**rank_fit(x, q, shape[0] - 1 if rank is None else rank, fudge), "feasible": bool(((weights >= 0) & (weights <= 1)).all())}]
    return _mapped(model_blocks(f2, models), models, make, "model int, f4rank int, dof int, chisq double, p double, feasible boolean")


qpwave = qpadm_rankdrop


def test_cladality(f2: DataFrame, models: DataFrame) -> DataFrame:
    return qpadm_p(f2, models, rank=0)


test_cladality.__test__ = False  # not a test


def qpwave_pairs(f2: DataFrame, left: list[str], right: list[str]) -> DataFrame:
    """Rank-0 p of each pair of left populations, both ways round: pop1, pop2, chisq, p."""
    models = models_table(f2, [{"left": pair, "right": right} for pair in itertools.combinations(left, 2)])
    got = qpadm_p(f2, models, rank=0).select(F.col("left")[0].alias("pop1"), F.col("left")[1].alias("pop2"), "chisq", "p")
    return got.unionByName(got.select(F.col("pop2").alias("pop1"), F.col("pop1").alias("pop2"), "chisq", "p"))


def rotate_models(leftright: list[str], target: str, rightfix: list[str] = ()) -> list[dict]:
    """Every split of a pool into sources and right populations, with more right ones than sources."""
    pool = [p for p in leftright if p != target]
    out = []
    for k in range(1, len(pool)):
        for left in itertools.combinations(pool, k):
            right = [p for p in pool if p not in left] + list(rightfix)
            if len(right) > k:
                out.append({"target": target, "left": list(left), "right": right})
    return out


def qpadm_rotate(f2: DataFrame, leftright: list[str], target: str, rightfix: list[str] = ()) -> DataFrame:
    return qpadm_p(f2, models_table(f2, rotate_models(leftright, target, rightfix)))


def qpadm_sweep(f2: DataFrame, targets: list[str], source_sets: dict[str, list[str]], right_sets: dict[str, list[str]]) -> DataFrame:
    """Targets x source sets x right sets, one shared f4 computation."""
    keys = [(t, s, r) for t in targets for s in source_sets for r in right_sets]
    models = [{"target": t, "left": source_sets[s], "right": right_sets[r]} for t, s, r in keys]
    names = f2.sparkSession.createDataFrame([(i, s, r) for i, (_, s, r) in enumerate(keys)], "model int, source_set string, right_set string")
    return qpadm_p(f2, models_table(f2, models)).join(names, "model")


def all_splits(pops: list[str]) -> list[dict]:
    """All disjoint non-empty left and right sets, left no larger than right."""
    out = []
    for k in range(1, len(pops) // 2 + 1):
        for left in itertools.combinations(pops, k):
            out.append({"left": list(left), "right": [p for p in pops if p not in left]})
    return out


def lazadm(f2: DataFrame, models: DataFrame, constrained: bool = True) -> DataFrame:
    """Least-squares weights: f4(target, r1; r2, r3) as a mixture of the sources' over all right triples."""
    m = models.select("model", "target", "left", "right", F.explode("right").alias("pop2"))
    m = m.select("*", F.explode("right").alias("pop3")).select("*", F.explode("right").alias("pop4")).where("pop3 < pop4 AND pop2 <> pop3 AND pop2 <> pop4")
    m = m.select("model", "pop2", "pop3", "pop4", F.posexplode(F.concat(F.array("target"), "left")).alias("i", "pop1"))
    rows = f4_blocks(f2, m).where("est IS NOT NULL")
    rows = rows.select("model", "block", "i", F.concat_ws("|", "pop2", "pop3", "pop4").alias("j"), "est", "n_snps")

    def solve(x):
        y, a = x[0], x[1:].T
        h = a.T @ a
        return bounded_qp(h + 1e-12 * np.trace(h) * np.eye(len(h)), a.T @ y, 0.0 if constrained else -np.inf, np.inf, 1.0)

    def make(pdf):
        wide = pdf.pivot_table(index="block", columns=["i", "j"], values="est").dropna()
        w = pdf.groupby("block")["n_snps"].max().reindex(wide.index).to_numpy(float)
        n = int(pdf["i"].max()) + 1
        r = w / w.sum()
        b = wide.to_numpy()
        tot = r @ b
        loo = (tot - b * r[:, None]) / (1 - r)[:, None]
        weights = solve(tot.reshape(n, -1))
        reps = np.array([solve(x.reshape(n, -1)) for x in loo])
        se = np.sqrt((((reps - reps.mean(0)) ** 2) * (1 / r - 1)[:, None]).mean(0))
        return [{"k": i, "weight": a, "se": s, "z": a / s if s else None} for i, (a, s) in enumerate(zip(weights, se))]

    out = _mapped(rows, models, make, "model int, k int, weight double, se double, z double")
    return out.select("model", "target", F.element_at("left", F.col("k") + 1).alias("source"), "weight", "se", "z")


def smooth_f2(f4_and_f2: DataFrame, pops: list[str], f2: DataFrame, ridge: float = 1e-5) -> DataFrame:
    """f2 per block from a joint regression of all given f4 statistics (f2 is f4(a, b; a, b)) on the f2 basis; blocks are
    fitted on their own, without the statistics they miss, then moved to f2's overall means."""
    names = sorted(pops)
    basis = {p: k for k, p in enumerate(itertools.combinations(names, 2))}

    def fit(key, pdf):
        x = np.zeros((len(pdf), len(basis)))
        for i, q in enumerate(zip(pdf.pop1, pdf.pop2, pdf.pop3, pdf.pop4)):
            for a, b, c in ((q[0], q[3], 0.5), (q[1], q[2], 0.5), (q[0], q[2], -0.5), (q[1], q[3], -0.5)):
                if a != b:
                    x[i, basis[min(a, b), max(a, b)]] += c
        a = x.T @ x
        y = np.linalg.solve(a + ridge * np.eye(len(a)), x.T @ pdf.est.to_numpy())
        return pd.DataFrame([(key[0], p, q, y[k]) for (p, q), k in basis.items()], columns=["block", "pop1", "pop2", "est"])

    got = f4_and_f2.where("est IS NOT NULL").groupBy("block").applyInPandas(fit, "block int, pop1 string, pop2 string, est double")
    n = f2.select("block", "n_snps").distinct()
    mean = got.join(n, "block").groupBy("pop1", "pop2").agg((F.sum(F.col("est") * F.col("n_snps")) / F.sum("n_snps")).alias("m"))
    goal = f2.groupBy("pop1", "pop2").agg((F.sum(F.col("est") * F.col("n_snps")) / F.sum("n_snps")).alias("g"))
    return got.join(mean, ["pop1", "pop2"]).join(goal, ["pop1", "pop2"]).join(n, "block").select("block", "pop1", "pop2", (F.col("est") - F.col("m") + F.col("g")).alias("est"), "n_snps")


def with_p(df: DataFrame, z: str = "z") -> DataFrame:
    """Two-sided normal p of a column."""
    p = F.pandas_udf(lambda s: s.map(normal_two_sided).astype(float), "double")
    return df.withColumn("p", p(z))
