"""What fitted models say of f2, f3 and f4, beside what was estimated; comparisons of fits; sets of models."""
from __future__ import annotations

import itertools

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numerics import normal_two_sided
from .fstats import combs_table, f4_blocks, mirrored
from .resample import est_to_loo, jackknife, with_z

K4 = ["pop1", "pop2", "pop3", "pop4"]
FIT = "fit"


def add_weighted_f2(f2: DataFrame, weights: dict[str, float], name: str = FIT) -> DataFrame:
    """f2 blocks with a further population, the sources' weighted mean: of its f2 with another one the weighted mean of the
    sources'. (The term that the sources' own f2 would take away is the same for all and cancels in f4.)"""
    table = f2.sparkSession.createDataFrame(list(weights.items()), "source string, w double")  # a row a source
    full = mirrored(f2).unionByName(_diagonal(f2))
    other = [c for c in f2.columns if c not in ("pop1", "pop2", "est")]
    more = full.join(table, F.col("pop1") == F.col("source")).groupBy("pop2", *other).agg(F.sum(F.col("w") * F.col("est")).alias("est"))
    own = f2.select(*other).distinct().select(*other, F.lit(name).alias("pop1"), F.lit(name).alias("pop2"), F.lit(0.0).alias("est"))
    rows = more.select(F.least("pop2", F.lit(name)).alias("pop1"), F.greatest("pop2", F.lit(name)).alias("pop2"), "est", *other)
    return f2.unionByName(rows.select(*f2.columns)).unionByName(own.select(*f2.columns))


def _diagonal(f2: DataFrame) -> DataFrame:
    """A zero f2 of each population with itself, where the table hasn't one."""
    other = [c for c in f2.columns if c not in ("pop1", "pop2", "est")]
    pops = f2.select(*other, F.explode(F.array("pop1", "pop2")).alias("pop1")).distinct()
    zero = pops.select(*[F.lit(0.0).alias(c) if c == "est" else F.col("pop1").alias(c) if c == "pop2" else F.col(c) for c in f2.columns])
    return zero.join(f2.where("pop1 = pop2").select(*other, "pop1"), [*other, "pop1"], "left_anti").select(*f2.columns)


def fitted_f4(f2: DataFrame, target: str, weights: dict[str, float], right: list[str]) -> DataFrame:
    """f4(target, x; r1, r2) for each source x and for the fitted mixture: pop1..pop4, est, se, z, weight."""
    total = sum(weights.values())
    w = {k: v / total for k, v in weights.items()}
    combs = [(target, x, a, b) for x in [*w, FIT] for a, b in itertools.combinations(right, 2)]
    f2 = add_weighted_f2(f2, w)
    rows = f4_blocks(f2, combs_table(f2, combs)).withColumnRenamed("n_snps", "n")
    share = F.create_map(*[F.lit(v) for pair in w.items() for v in pair])
    return with_z(jackknife(est_to_loo(rows, K4), K4)).withColumn("weight", F.try_element_at(share, "pop2"))


def fitted_from_blocks(f4: DataFrame, weights: dict[str, float]) -> DataFrame:
    """The same from f4 blocks (block, pop1..pop4, est, n) of the sources: the mixture's are added."""
    total = sum(weights.values())
    table = f4.sparkSession.createDataFrame([(k, v / total) for k, v in weights.items()], "pop2 string, w double")
    fit = f4.join(table, "pop2").groupBy("block", "pop1", "pop3", "pop4").agg(F.sum(F.col("w") * F.col("est")).alias("est"), F.max("n").alias("n"))
    rows = f4.select("block", *K4, "est", "n").unionByName(fit.select("block", "pop1", F.lit(FIT).alias("pop2"), "pop3", "pop4", "est", "n"))
    return with_z(jackknife(est_to_loo(rows, K4), K4))


def fitted_f2(f3: DataFrame) -> DataFrame:
    """f3 fits (pop1 the base; pop2, pop3, fit) -> pop1, pop2, fit: f2 of all pairs that they imply."""
    own = f3.where("pop2 = pop3").select(F.col("pop2").alias("p"), F.col("fit").alias("own"))
    base = f3.where("pop2 = pop3").select(F.least("pop1", "pop2").alias("pop1"), F.greatest("pop1", "pop2").alias("pop2"), "fit")
    both = f3.where("pop2 <> pop3").join(own.withColumnsRenamed({"p": "pop2", "own": "a"}), "pop2").join(own.withColumnsRenamed({"p": "pop3", "own": "b"}), "pop3")
    pairs = both.select(F.least("pop2", "pop3").alias("pop1"), F.greatest("pop2", "pop3").alias("pop2"), (F.col("a") + F.col("b") - 2 * F.col("fit")).alias("fit"))
    return base.unionByName(pairs).distinct()


def compare_f2(estimates: DataFrame, f3: DataFrame) -> DataFrame:
    """Estimated f2 (pop1, pop2, est, se) beside what a graph's f3 imply: fit, diff, z."""
    return estimates.join(fitted_f2(f3), ["pop1", "pop2"]).withColumn("diff", F.col("est") - F.col("fit")).withColumn("z", F.try_divide("diff", "se"))


def compare_f4(estimates: DataFrame, f3: DataFrame) -> DataFrame:
    """Estimated f4 (pop1..pop4, est, se) beside what a graph's f3 imply: fit, diff, z."""
    f2 = mirrored(fitted_f2(f3))
    out = estimates
    for i, (a, b) in enumerate((("pop1", "pop4"), ("pop2", "pop3"), ("pop1", "pop3"), ("pop2", "pop4"))):
        out = out.join(f2.select(F.col("pop1").alias(a), F.col("pop2").alias(b), F.col("fit").alias(f"c{i}")), [a, b], "left").withColumn(f"c{i}", F.when(F.col(a) == F.col(b), 0.0).otherwise(F.col(f"c{i}")))
    fit = (F.col("c0") + F.col("c1") - F.col("c2") - F.col("c3")) / 2
    return out.withColumn("fit", fit).withColumn("diff", F.col("est") - F.col("fit")).withColumn("z", F.try_divide("diff", "se")).select(*estimates.columns, "fit", "diff", "z")


def compare_scores(a: list[float], b: list[float], boot: bool = False) -> dict:
    """Two graphs' out-of-sample scores in the same replicates: mean difference, its error, z and p; with boot also the empirical
    p and interval. Left-out replicates spread as means do, drawn ones as the statistic itself does."""
    d = np.asarray(a, float) - np.asarray(b, float)
    d = d[np.isfinite(d)]
    se = float(d.std(ddof=1)) if boot else float(np.sqrt((len(d) - 1) / len(d) * ((d - d.mean()) ** 2).sum()))
    z = float(d.mean() / se) if se else None
    out = {"diff": float(d.mean()), "se": se, "z": z, "p": normal_two_sided(z)}
    if boot:
        below = float((d < 0).mean())
        low, high = np.quantile(d, [0.025, 0.975])
        out |= {"p_emp": 2 * min(below, 1 - below), "ci_low": float(low), "ci_high": float(high)}
    return out


# --- sets of models


def power_set(items: list[str], most: int | None = None) -> list[tuple[str, ...]]:
    """Non-empty subsets by size."""
    return [c for k in range(1, (most or len(items)) + 1) for c in itertools.combinations(items, k)]


def models_by_right(target: str, left: list[str], pool: list[str]) -> list[dict]:
    """Right sets from a pool, larger than the left one."""
    return [{"target": target, "left": list(left), "right": list(r)} for r in power_set(pool) if len(r) > len(left)]


def models_by_left(target: str, pool: list[str], right: list[str]) -> list[dict]:
    """Left sets from a pool: of two at least, and smaller than the right one."""
    return [{"target": target, "left": list(x), "right": list(right)} for x in power_set(pool) if 2 <= len(x) < len(right)]


def splits(pops: list[str], fixed_right: int = 0) -> list[tuple[list[str], list[str]]]:
    """All left sets, the rest being right, as long as right and the fixed ones are more than left."""
    most = min(len(pops), (len(pops) + fixed_right - 1) // 2)
    return [(list(x), [p for p in pops if p not in x]) for x in power_set(pops, most) if most > 0]


def find_right(f4: DataFrame, target: str, left: list[str], alpha: float = 0.01) -> DataFrame:
    """Pairs of populations that tell the target from some source: pop3, pop4 and the number of sources for which
    f4(target, source; pop3, pop4) has p below alpha, the most first."""
    rows = f4.where((F.col("pop1") == target) & F.col("pop2").isin(left) & (F.col("p") < alpha))
    return rows.groupBy("pop3", "pop4").agg(F.count("*").alias("sources"), F.min("p").alias("p")).orderBy(F.desc("sources"), "p", "pop3", "pop4")


def f4_to_triples(f4: DataFrame) -> DataFrame:
    """f4(outgroup, pop2; pop3, pop4) with z -> of each triple of the other populations the one that is most clearly outside of
    the other two: p1, p2, p3, out, support (mean |z|). A negative z says that pop2 is nearer to pop3."""
    rows = f4.where("pop2 <> pop3 AND pop2 <> pop4 AND pop3 < pop4 AND z IS NOT NULL")
    t = F.sort_array(F.array("pop2", "pop3", "pop4"))
    rows = rows.select(t[0].alias("p1"), t[1].alias("p2"), t[2].alias("p3"), F.when(F.col("z") < 0, F.col("pop4")).otherwise(F.col("pop3")).alias("out"), F.abs("z").alias("a"))
    mean = rows.groupBy("p1", "p2", "p3", "out").agg(F.avg("a").alias("support"))
    top = mean.groupBy("p1", "p2", "p3").agg(F.max(F.struct("support", "out")).alias("m"))
    return top.select("p1", "p2", "p3", F.col("m.out").alias("out"), F.col("m.support").alias("support"))
