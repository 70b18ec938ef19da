"""Statistics and models on resampled blocks or individuals: replicates are tagged, and one plan makes them all."""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import af as A
from . import models as M
from . import resample as R
from .blocks import block_lengths

#: copies of a block within a replicate are told apart by this much
COPIES = 1 << 20


def with_reps(blocks: DataFrame, nboot: int | None = None, seed: str = "0") -> DataFrame:
    """A table of block statistics for each replicate: rep is the block that is left out or, with nboot, a number; a block that is
    drawn more than once is so many blocks. Without nboot its rows grow with the square of the blocks."""
    if nboot is None:
        return R.loo_list(blocks)
    drawn = R.draws(blocks, nboot, seed).select("rep", F.col("block").alias("__b"), F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))).alias("__copy"))
    return blocks.join(drawn, F.col("block") == F.col("__b")).withColumn("block", F.col("block").cast("long") * COPIES + F.col("__copy")).drop("__b", "__copy")


def statistics(blocks: DataFrame, keys: list[str], nboot: int | None = None, seed: str = "0") -> DataFrame:
    """rep, keys, est, se, z of f2, f3 or f4 block statistics (keys, block, est, n), each replicate jackknifed on its own."""
    if nboot is None:
        return R.with_z(R.loo_jackknife(blocks, keys))
    k = ["rep", *keys]
    return R.with_z(R.jackknife(R.est_to_loo(with_reps(blocks, nboot, seed), k), k))


#: replicates in a piece of a model's, and the numbers they may have
PIECE, NUMBERS = 1024, 1 << 16


def left_out(b: np.ndarray, w: np.ndarray):
    """blocks x cells and block weights -> for each distinct weight u, and for 0 (a replicate that lacks no block): u, the rows with
    it, and what the replicates without one of them share; moments() makes the rest of it.

    The covariance of the rest is the mean of n (e - t)(e - t)' / (R - n), as in grid_stats, with its mean t and weight R. R - n only
    depends on the two weights, so sums over the blocks of other weights and of u serve all replicates without a block of weight u."""
    total = w.sum()
    tot = w @ b / total
    x = b - tot
    for u in [0.0, *np.unique(w)]:
        at, other, rest, m = np.flatnonzero(w == u), w != u, total - u, len(w) - bool(u)
        coef = w[other] / (rest - w[other]) if m > 1 else np.zeros(other.sum())
        q = u / (rest - u) if u and len(at) > 1 and m > 1 else 0.0
        s0, s1, s2 = coef.sum() + q * len(at), coef @ x[other], (x[other] * coef[:, None]).T @ x[other]
        s1, s2 = s1 + q * x[at].sum(0), s2 + q * x[at].T @ x[at]
        if m < 2:  # a single block has no covariance
            s2 = np.full_like(s2, np.nan)
        yield u, at, x[at], np.r_[u, rest, q, m, s0, s1, tot, s2.ravel()]


def moments(x: np.ndarray, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Estimates and covariance without a block whose cells are x more than the whole estimates."""
    (u, rest, q, m, s0), c = shared[:5], len(x)
    s1, tot, s2 = shared[5 : 5 + c], shared[5 + c : 5 + 2 * c], shared[5 + 2 * c :].reshape(c, c)
    d = -u * x / rest
    side = np.outer(s1 - q * x, d)
    return tot + d, (s2 - q * np.outer(x, x) - side - side.T + (s0 - q) * np.outer(d, d)) / m


def _without_blocks(blocks: DataFrame, make, schema: str, fudge: float) -> DataFrame:
    """make(grid, its inverse covariance) -> rows of each model without each block. A model's grid is gone through once; pieces of its
    replicates, with the sums that they share, are then tasks of their own."""
    kind, names = dict(blocks.dtypes)["block"], [c.strip().split()[0] for c in schema.split(", ")]
    reps = blocks.select("block").distinct()  # a row a block
    marks = blocks.select("model").distinct().crossJoin(F.broadcast(reps)).withColumns({"i": F.lit(0), "j": F.lit(0), "est": F.lit(None).cast("double"), "n_snps": F.lit(None).cast(dict(blocks.dtypes)["n_snps"])})

    def pieces(key, pdf):
        have, rows = pdf[pdf["est"].notna()], []
        wide, w = M.complete_rows(have)
        nl, nr = int(have["i"].max()) + 1, int(have["j"].max()) + 1
        step = max(1, min(PIECE, NUMBERS // (nl * nr)))
        if len(wide):
            for u, at, x, shared in left_out(wide.to_numpy(), w.to_numpy(float)):
                ids = wide.index.to_numpy()[at] if u else np.setdiff1d(pdf["block"].to_numpy(), wide.index.to_numpy())
                x = x if u else np.zeros((len(ids), nl * nr))
                if shared[3] > 0:
                    rows += [(key[0], len(rows) + k, nl, nr, ids[s : s + step], x[s : s + step].ravel(), shared) for k, s in enumerate(range(0, len(ids), step))]
        return pd.DataFrame(rows, columns=["model", "piece", "nl", "nr", "reps", "x", "shared"])

    def fit(key, pdf):
        out = []
        for nl, nr, ids, x, shared in zip(pdf["nl"], pdf["nr"], pdf["reps"], pdf["x"], pdf["shared"]):
            for rep, row in zip(ids, x.reshape(len(ids), -1)):
                est, cov = moments(row, shared)
                out += [{"model": key[0], "rep": rep, **r} for r in make(est.reshape(nl, nr), M.inverse_covariance(cov, fudge))]
        return pd.DataFrame(out, columns=["model", "rep", *names])

    cut = blocks.unionByName(marks).groupBy("model").applyInPandas(pieces, f"model int, piece int, nl int, nr int, reps array<{kind}>, x array<double>, shared array<double>")
    tasks = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # pieces are few bytes and much work
    return cut.repartition(tasks, "model", "piece").groupBy("model", "piece").applyInPandas(fit, f"model int, rep {kind}, {schema}")


def _mapped(blocks: DataFrame, models: DataFrame, make, schema: str, nboot: int | None, seed: str, fudge: float) -> DataFrame:
    """make(a model's grid in a replicate, its inverse covariance) -> rows."""
    if nboot is None:
        return _without_blocks(blocks, make, schema, fudge).join(models, "model")
    names = [c.strip().split()[0] for c in schema.split(", ")]

    def fit(key, pdf):
        b, w, shape = M._grid(pdf)
        est, cov, _ = M.grid_stats(b, w)
        return pd.DataFrame([{"model": key[0], "rep": key[1], **row} for row in make(est.reshape(shape), M.inverse_covariance(cov, fudge))], columns=["model", "rep", *names])

    grid = with_reps(blocks, nboot, seed)
    return grid.groupBy("model", "rep").applyInPandas(fit, f"model int, rep {dict(grid.dtypes)['rep']}, {schema}").join(models, "model")


def qpadm(f2: DataFrame, models: DataFrame, nboot: int | None = None, seed: str = "0", fudge: float = M.FUDGE, constrained: bool = False) -> DataFrame:
    """Weights in each replicate: model, rep, target, source, weight. The f4 grids of all models are computed once; replicates are
    made of their blocks."""

    def make(x, q):
        return [{"k": k, "weight": float(w)} for k, w in enumerate(M.mixture_weights(x, q, fudge, constrained=constrained))]

    got = _mapped(M.model_blocks(f2, models), models, make, "k int, weight double", nboot, seed, fudge)
    return got.select("model", "rep", "target", F.element_at("left", F.col("k") + 1).alias("source"), "weight")


def qpwave(f2: DataFrame, models: DataFrame, nboot: int | None = None, seed: str = "0", fudge: float = M.FUDGE) -> DataFrame:
    """Rank tests in each replicate: model, rep, f4rank, dof, chisq, p."""
    got = _mapped(M.model_blocks(f2, models), models, lambda x, q: M.rankdrop(x, q, fudge), "f4rank int, dof int, chisq double, p double", nboot, seed, fudge)
    return got.select("model", "rep", "f4rank", "dof", "chisq", "p")


def without_individuals(geno: DataFrame, blocks: DataFrame) -> DataFrame:
    """f2 blocks without one individual at a time, of populations that have others: rep (its name), block, pop1, pop2, est, n_snps.

    Only the individual's own population changes, so its frequencies are the population's less its alleles; pairs of other
    populations are the same in all replicates and are only computed once."""
    from .fstats import pair_blocks

    whole = A.allele_frequencies(geno).where("p IS NOT NULL AND n > 0")
    who = geno.select("sample_id", "pop").distinct()
    others = who.groupBy("pop").agg(F.count("*").alias("k")).where("k > 1")
    reps = who.join(others, "pop").select(F.col("sample_id").alias("rep"), F.col("pop").alias("own"))
    mine = geno.groupBy("variant_idx", F.col("sample_id").alias("rep"), F.col("pop").alias("own")).agg(F.sum("dosage").cast("double").alias("a"), (2.0 * F.count("dosage")).alias("m"))
    # the own population in each replicate: all its variants, less what the individual has there
    less = whole.join(reps, F.col("pop") == F.col("own")).join(mine, ["variant_idx", "rep", "own"], "left").na.fill(0.0, ["a", "m"])
    less = less.select("rep", "own", "variant_idx", (F.col("n") - F.col("m")).alias("n1"), F.try_divide(F.col("p") * F.col("n") - F.col("a"), F.col("n") - F.col("m")).alias("p1")).where("n1 > 0")
    at = blocks.select("variant_idx", "block")
    pairs = less.join(whole.select("variant_idx", F.col("pop").alias("other"), F.col("p").alias("p2"), F.col("n").alias("n2")), "variant_idx").where("own <> other").join(at, "variant_idx")
    h = lambda p, n: F.col(p) * (1 - F.col(p)) / F.greatest(F.lit(1.0), F.col(n) - 1)
    f2 = F.pow(F.col("p1") - F.col("p2"), 2) - h("p1", "n1") - h("p2", "n2")
    changed = pairs.groupBy("rep", "block", F.least("own", "other").alias("pop1"), F.greatest("own", "other").alias("pop2")).agg(F.avg(f2).alias("est"))
    same = pair_blocks(geno_af(whole), blocks).where("pop1 <> pop2").select("block", "pop1", "pop2", F.col("f2").alias("est"))
    rest = same.join(reps, (F.col("pop1") != F.col("own")) & (F.col("pop2") != F.col("own"))).select("rep", "block", "pop1", "pop2", "est")
    return changed.unionByName(rest).join(block_lengths(blocks), "block")


def geno_af(af: DataFrame) -> DataFrame:
    """Frequencies with the columns that pair statistics read."""
    return af.select("variant_idx", "pop", "p", "n")
