"""Leave-one-out, jackknife and bootstrap over blocks, as window and group aggregates.

Tables are long: keys, block, est, n (weight). A key's blocks are few (hundreds to thousands), so
windows by key are bounded by the genome, not by the data.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def est_to_loo(df: DataFrame, keys: list[str], est: str = "est", n: str = "n") -> DataFrame:
    """Adds loo, the weighted mean without the block, tot and r (the block's share of the weight); blocks
    without a value are left out."""
    w = Window.partitionBy(*keys)
    d = df.where(F.col(est).isNotNull())
    d = d.withColumn("tot", F.try_divide(F.sum(F.col(est) * F.col(n)).over(w), F.sum(n).over(w))).withColumn("r", F.try_divide(F.col(n).cast("double"), F.sum(n).over(w)))
    return d.withColumn("loo", F.try_divide(F.col("tot") - F.col(est) * F.col("r"), 1 - F.col("r")))


def loo_to_est(df: DataFrame, keys: list[str], loo: str = "loo", n: str = "n") -> DataFrame:
    """The inverse: est from leave-one-out values and weights."""
    w = Window.partitionBy(*keys)
    d = df.withColumn("r", F.try_divide(F.col(n).cast("double"), F.sum(n).over(w)))
    d = d.withColumn("tot", F.try_divide(F.sum(F.col(loo) * (1 - F.col("r"))).over(w), F.sum(1 - F.col("r")).over(w)))
    return d.withColumn("est", F.try_divide(F.col("tot") - F.col(loo) * (1 - F.col("r")), F.col("r")))


def jackknife(loo: DataFrame, keys: list[str], boot: bool = False) -> DataFrame:
    """keys, est, se, from loo and r, the total being the weighted mean of loo."""
    w = Window.partitionBy(*keys)
    d = loo.where("loo IS NOT NULL").withColumn("e", F.try_divide(F.sum(F.col("loo") * (1 - F.col("r"))).over(w), F.sum(1 - F.col("r")).over(w)))
    var = F.avg(F.pow(F.col("e") - F.col("loo"), 2) * (F.try_divide(F.lit(1.0), F.col("r")) - 1))
    return d.groupBy(*keys).agg(F.first("e").alias("est"), _se(var, boot).alias("se"))


def jackknife_tot(loo: DataFrame, keys: list[str], boot: bool = False) -> DataFrame:
    """keys, est, se with pseudo-values around the given tot; needs loo, n and tot."""
    w = Window.partitionBy(*keys)
    d = loo.where("loo IS NOT NULL").withColumn("h", F.try_divide(F.sum("n").over(w).cast("double"), F.col("n")))
    mean = F.try_divide(F.sum(F.col("loo") * F.col("n")).over(w), F.sum("n").over(w))
    d = d.withColumn("e", F.sum(F.col("tot") - F.col("loo")).over(w) + mean)
    tau = F.col("h") * F.col("tot") - (F.col("h") - 1) * F.col("loo")
    var = F.avg(F.try_divide(F.pow(tau - F.col("e"), 2), F.col("h") - 1))
    return d.groupBy(*keys).agg(F.first("e").alias("est"), _se(var, boot).alias("se"))


def _se(var: Column, boot: bool) -> Column:
    k = F.count("*").cast("double")
    return F.sqrt(var * F.try_divide(k, F.pow(k - 1, 2))) if boot else F.sqrt(var)


def with_z(df: DataFrame) -> DataFrame:
    return df.withColumn("z", F.try_divide(F.col("est"), F.col("se")))


def draws(blocks: DataFrame, nboot: int, seed: str = "0") -> DataFrame:
    """rep, block, times: nboot times as many blocks as there are, drawn with replacement by a hash of the
    seed, the replicate and the draw; the table of blocks has a row a block."""
    order = Window.orderBy("block")
    ids = blocks.select("block").distinct().withColumn("k", F.row_number().over(order) - 1)
    m = ids.count()
    grid = ids.sparkSession.range(nboot * m).select((F.col("id") / m).cast("int").alias("rep"), (F.col("id") % m).alias("draw"))
    h = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), "rep", "draw").cast("binary")), 1, 8), 16, 10).cast("bigint")
    return grid.select("rep", (h % m).cast("int").alias("k")).groupBy("rep", "k").agg(F.count("*").alias("times")).join(ids, "k").select("rep", "block", "times")


def est_to_boo(df: DataFrame, keys: list[str], nboot: int, seed: str = "0") -> DataFrame:
    """keys, rep, boo: weighted mean over drawn blocks."""
    d = df.where("est IS NOT NULL").join(draws(df, nboot, seed), "block")
    return d.groupBy(*keys, "rep").agg(F.try_divide(F.sum(F.col("est") * F.col("n") * F.col("times")), F.sum(F.col("n") * F.col("times"))).alias("boo"))


def boot_stats(boo: DataFrame, keys: list[str]) -> DataFrame:
    return boo.groupBy(*keys).agg(F.avg("boo").alias("est"), F.stddev_samp("boo").alias("se"))


def loo_list(df: DataFrame) -> DataFrame:
    """df once for each block, without it: rep is the block left out. Its rows grow with the square of the blocks; loo_means and
    loo_jackknife give the replicates' means and errors without them."""
    reps = df.select(F.col("block").alias("rep")).distinct()
    return df.join(reps, F.col("block") != F.col("rep"))


def _reps(df: DataFrame) -> DataFrame:
    return df.where("block IS NOT NULL").select(F.col("block").alias("rep")).distinct()


def loo_means(df: DataFrame, keys: list[str], reps: DataFrame | None = None) -> DataFrame:
    """rep, keys, est: weighted means of each table of loo_list, from the whole ones less a block. df has one row a key and block and is
    read twice; reps has the blocks to leave out where they aren't those of df."""
    loo = est_to_loo(df.where("block IS NOT NULL"), keys)
    whole = loo.groupBy(*keys).agg(F.first("tot").alias("tot"))
    own = loo.select(*keys, F.col("block").alias("rep"), "loo", F.lit(True).alias("there"))
    got = whole.crossJoin(F.broadcast(_reps(df if reps is None else reps))).join(own, [*keys, "rep"], "left")  # reps has a row a block
    return got.select("rep", *keys, F.when(F.col("there"), F.col("loo")).otherwise(F.col("tot")).alias("est")).where("est IS NOT NULL")


def loo_jackknife(df: DataFrame, keys: list[str]) -> DataFrame:
    """rep, keys, est, se: each table of loo_list jackknifed on its own. df has one row a key and block.

    With the rest's mean t and weight R, the variance is the mean of n (e - t)^2 / (R - n) over its blocks. R - n is the same for all
    blocks of a weight, so sums by weight (number, x and x^2, x being e less the whole mean) serve all replicates in which a block of
    the same weight is left out. Weights are numbers of variants, so pairs of different ones are at most twice as many as variants."""
    w = Window.partitionBy(*keys)
    x, n, o, rest = F.col("x"), F.col("n"), F.col("o"), F.col("weight") - F.col("o")
    d = df.where("est IS NOT NULL AND n IS NOT NULL AND block IS NOT NULL").select(*keys, F.col("block").alias("rep"), n.cast("double").alias("n"), "est")
    d = d.withColumn("tot", F.try_divide(F.sum(F.col("est") * n).over(w), F.sum("n").over(w))).withColumn("x", F.col("est") - F.col("tot"))
    whole = d.groupBy(*keys).agg(F.sum("n").alias("weight"), F.first("tot").alias("tot"), F.count("*").alias("k"), F.count_if(n != 0).alias("m"))
    same = d.where("n <> 0").groupBy(*keys, "n").agg(F.count("*").cast("double").alias("c0"), F.sum("x").alias("c1"), F.sum(x * x).alias("c2"))
    # o, the weight that is left out: some block's, or 0 where the key has no such block; o0 to o2 are the sums of its blocks
    none = whole.select(*keys, *[F.lit(0.0).alias(c) for c in ("o", "o0", "o1", "o2")])
    out = same.withColumnsRenamed({"n": "o", "c0": "o0", "c1": "o1", "c2": "o2"}).select(*none.columns).unionByName(none).join(whole, keys)
    share = F.when(n != o, F.try_divide(n, rest - n))
    sums = out.join(same, keys).groupBy(*out.columns).agg(*[F.coalesce(F.sum(share * F.col(f"c{i}")), F.lit(0.0)).alias(f"a{i}") for i in range(3)])
    # a row a key and replicate; reps has a row a block
    own = d.select(*keys, "rep", n.alias("o"), "x")
    grid = whole.select(*keys).crossJoin(F.broadcast(_reps(df))).join(own, [*keys, "rep"], "left").withColumn("there", x.isNotNull().cast("int")).na.fill(0.0, ["o", "x"])
    got = grid.join(sums, [*keys, "o"]).withColumn("k", F.col("k") - F.col("there")).withColumn("m", F.col("m") - (o != 0).cast("int")).withColumn("d", -F.try_divide(o * x, rest))
    q = F.coalesce(F.when(F.col("o0") > 1, F.try_divide(o, rest - o)), F.lit(0.0))
    b0, b1, b2 = (F.col(f"a{i}") + q * (F.col(f"o{i}") - v) for i, v in enumerate((1.0, x, x * x)))
    var = (b2 - 2 * F.col("d") * b1 + F.col("d") * F.col("d") * b0) / F.col("m")
    got = got.where("m > 1 OR m = 1 AND k > 1")  # a single block has no value without itself
    return got.select("rep", *keys, (F.col("tot") + F.col("d")).alias("est"), F.when(F.col("m") > 1, F.sqrt(F.greatest(var, F.lit(0.0)))).alias("se"))


def boo_list(df: DataFrame, nboot: int, seed: str = "0") -> tuple[DataFrame, DataFrame]:
    """Replicates of df by drawn blocks (times), and for each the blocks that weren't drawn."""
    d = draws(df, nboot, seed)
    reps = d.select("rep").distinct()
    test = df.crossJoin(F.broadcast(reps)).join(d.select("rep", "block"), ["rep", "block"], "left_anti")  # nboot numbers
    return df.join(d, "block"), test


def matrix_jackknife(df: DataFrame, keys: list[str], numer: str = "numer", cnt: str = "cnt") -> DataFrame:
    """Jackknife estimates from sums and counts of any number of combinations."""
    d = df.withColumn("est", F.try_divide(F.col(numer), F.col(cnt))).withColumn("n", F.col(cnt))
    return jackknife(est_to_loo(d, keys), keys)


def snp_jackknife(snps: DataFrame, columns: list[str], by: list[str]) -> DataFrame:
    """Jackknife over blocks of SNP-level columns: by, column, est, se."""
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("x")) for c in columns])
    keys = [*by, "column"]
    b = snps.select(*by, "block", F.inline(cells)).where("x IS NOT NULL").groupBy(*keys, "block").agg(F.avg("x").alias("est"), F.count("*").alias("n"))
    return jackknife(est_to_loo(b, keys), keys)


def ratio(num: DataFrame, den: DataFrame, keys: list[str], least: float = 1e-6) -> DataFrame:
    """Jackknife of a ratio of two block statistics with keys, block, est, n; a denominator below `least` masks both."""
    d = num.withColumnRenamed("est", "x").join(den.select(*keys, "block", F.col("est").alias("y")), [*keys, "block"])
    ok = F.abs("y") >= least
    d = d.withColumn("x", F.when(ok, F.col("x"))).withColumn("y", F.when(ok, F.col("y"))).where("x IS NOT NULL AND y IS NOT NULL")
    a = est_to_loo(d.withColumn("est", F.col("x")), keys).select(*keys, "block", "n", F.col("loo").alias("lx"), F.col("tot").alias("tx"))
    b = est_to_loo(d.withColumn("est", F.col("y")), keys).select(*keys, "block", F.col("loo").alias("ly"), F.col("tot").alias("ty"))
    both = a.join(b, [*keys, "block"]).withColumn("loo", F.try_divide("lx", "ly")).withColumn("tot", F.try_divide("tx", "ty"))
    return jackknife_tot(both, keys)


def summarize_fits(fits: DataFrame, low: float = 0.05, high: float = 0.95) -> DataFrame:
    """Mean and exact quantiles of each edge's weight over fits."""
    return fits.groupBy("from", "to", "type").agg(F.expr(f"percentile(weight, {low})").alias("low"), F.expr(f"percentile(weight, {high})").alias("high"), F.avg("weight").alias("weight"))


def compare_fits(scores: DataFrame, low: float = 0.025, high: float = 0.975) -> DataFrame:
    """scores: rep, score1, score2 of two graphs on the same replicates. Differences of zero are dropped."""
    d = scores.select((F.col("score1") - F.col("score2")).alias("d")).where("d <> 0")
    k = F.count("*").cast("double")
    frac = F.avg((F.col("d") > 0).cast("double"))
    return d.agg(F.avg("d").alias("diff"), F.stddev_samp("d").alias("se"), F.try_divide(F.avg("d"), F.stddev_samp("d")).alias("z"),
                 F.greatest(2 * F.least(frac, 1 - frac), F.try_divide(F.lit(1.0), k)).alias("p_emp"), (2 * F.least(frac, 1 - frac)).alias("p_emp_nocorr"),
                 F.expr(f"percentile(d, {low})").alias("ci_low"), F.expr(f"percentile(d, {high})").alias("ci_high"))
