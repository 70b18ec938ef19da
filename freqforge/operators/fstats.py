"""f2, allele products, Fst, f3, f4 and D per block.

A variant's populations are gathered in one array (as many as there are populations), so all pairs
and quadruples of a variant come from one shuffle by variant; what follows is partially aggregated.
"""
from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def by_variant(af: DataFrame, blocks: DataFrame) -> DataFrame:
    """variant_idx, block, pops: sorted array of (pop, p, n)."""
    rows = af.join(blocks.select("variant_idx", "block"), "variant_idx")
    return rows.groupBy("variant_idx", "block").agg(F.sort_array(F.collect_list(F.struct("pop", "p", "n"))).alias("pops"))


def pairs(af: DataFrame, blocks: DataFrame) -> DataFrame:
    """A row for each variant and unordered pair of observed populations: block, pop1, p1, n1, pop2, p2, n2."""
    v = by_variant(af.where("p IS NOT NULL AND n > 0"), blocks)
    each = F.flatten(F.transform("pops", lambda a, i: F.transform(F.slice("pops", i + 1, F.size("pops")), lambda b: F.struct(a["pop"].alias("pop1"), a["p"].alias("p1"), a["n"].alias("n1"), b["pop"].alias("pop2"), b["p"].alias("p2"), b["n"].alias("n2")))))
    return v.select("variant_idx", "block", F.inline(each))


def _h(p: str, n: str, floor: bool = True) -> Column:
    """Unbiased half heterozygosity p (1 - p) / (n - 1)."""
    less = F.greatest(F.lit(1.0), F.col(n) - 1) if floor else F.col(n) - 1
    return F.try_divide(F.col(p) * (1 - F.col(p)), less)


def pair_blocks(af: DataFrame, blocks: DataFrame, *, apply_corr: bool = True, snpwt: DataFrame | None = None) -> DataFrame:
    """block, pop1, pop2, f2, ap, fst, n (variants with both populations). snpwt: variant_idx, w."""
    rows = pairs(af, blocks)
    w = F.lit(1.0)
    if snpwt is not None:
        rows, w = rows.join(snpwt, "variant_idx"), F.col("w")
    same = F.col("pop1") == F.col("pop2")
    d2 = F.pow(F.col("p1") - F.col("p2"), 2)
    f2 = d2 - _h("p1", "n1") - _h("p2", "n2") if apply_corr else d2
    num = d2 - _h("p1", "n1", False) - _h("p2", "n2", False) if apply_corr else d2
    den = num + sum(_h(p, n, False) * F.col(n) for p, n in (("p1", "n1"), ("p2", "n2")))
    ap = (F.col("p1") * F.col("p2") + (1 - F.col("p1")) * (1 - F.col("p2"))) / 2
    odd = F.max(((F.col("n1") <= 1) | (F.col("n2") <= 1)).cast("int")) == 1  # one allele: not a number
    return rows.groupBy("block", "pop1", "pop2").agg(
        F.avg(F.when(~same, f2 * w).otherwise(0.0)).alias("f2"), F.avg(ap * w).alias("ap"),
        F.when(F.max(same.cast("int")) == 1, 0.0).when(~odd, F.try_divide(F.avg(num * w), F.avg(den))).alias("fst"), F.count("*").alias("n"))


def count_blocks(af: DataFrame, blocks: DataFrame) -> DataFrame:
    """block, pop1, pop2, share of the block's variants with both observed."""
    total = blocks.groupBy("block").agg(F.count("*").alias("total"))
    both = pairs(af, blocks).groupBy("block", "pop1", "pop2").agg(F.count("*").alias("n"))
    return both.join(total, "block").select("block", "pop1", "pop2", (F.col("n") / F.col("total")).alias("share"))


def scale_ap(ap: DataFrame, start: float | None = None, stop: float | None = None) -> DataFrame:
    """-2 ap, shifted so that the least value is `start` (default: 0) and scaled up to `stop`; zero diagonal."""
    raw = ap.withColumn("est", -2 * F.col("est"))
    ends = raw.agg(F.min("est").alias("lo"), F.max("est").alias("hi"))
    scale = F.lit(1.0) if stop is None else F.try_divide(F.lit(stop - (start or 0.0)), F.col("hi") - F.col("lo"))
    moved = raw.crossJoin(F.broadcast(ends))  # one row
    return moved.withColumn("est", F.when(F.col("pop1") == F.col("pop2"), 0.0).otherwise((F.col("est") - F.col("lo")) * scale + (start or 0.0))).drop("lo", "hi")


def complete_blocks(f2: DataFrame, value: str = "est") -> DataFrame:
    """Blocks in which every pair has a value."""
    cells = f2.select("pop1", "pop2").distinct().count()
    whole = f2.where(F.col(value).isNotNull()).groupBy("block").agg(F.count("*").alias("k")).where(F.col("k") == cells)
    return f2.join(whole.select("block"), "block", "left_semi")


def mirrored(f2: DataFrame) -> DataFrame:
    return f2.unionByName(f2.where("pop1 <> pop2").select(*[F.col({"pop1": "pop2", "pop2": "pop1"}.get(c, c)).alias(c) for c in f2.columns]))


def popcombs(pops: list[str], k: int, unique_only: bool = True, sure: bool = False) -> list[tuple[str, ...]]:
    """Combinations of k populations: pairs; three rotations of each triple, the first against the others;
    three pairings of each quadruple. Without unique_only all ordered ones."""
    pops = sorted(pops)
    if not unique_only:
        out = list(itertools.product(pops, repeat=k))
    elif k == 2:
        out = list(itertools.combinations(pops, 2))
    elif k == 3:
        out = [r for a, b, c in itertools.combinations(pops, 3) for r in ((a, b, c), (b, a, c), (c, a, b))]
    else:
        out = [r for a, b, c, d in itertools.combinations(pops, 4) for r in ((a, b, c, d), (a, c, b, d), (a, d, b, c))]
    if len(out) > 1_000_000 and not sure:
        raise ValueError(f"{len(out)} combinations; pass sure=True to go on")
    return out


def combs_table(df: DataFrame, combs: list[tuple[str, ...]], model: list[int] | None = None) -> DataFrame:
    names = [f"pop{i + 1}" for i in range(len(combs[0]))]
    rows = [(*c, *([model[i]] if model else [])) for i, c in enumerate(combs)]
    return df.sparkSession.createDataFrame(rows, ", ".join([f"{n} string" for n in names] + ["model int"] * bool(model)))


def combine(f2: DataFrame, combs: DataFrame, terms: list[tuple[str, str, float]]) -> DataFrame:
    """combs x block with est = sum of coefficient * f2 of the named pairs. One pass over f2: each of its rows
    goes to the combinations that use it, and they are summed. A missing cell makes the sum missing."""
    keys = combs.columns
    long = combs.select(*keys, F.inline(F.array(*[F.struct(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"), F.lit(c).alias("coef")) for a, b, c in terms])))
    long = long.groupBy(*keys, "a", "b").agg(F.sum("coef").alias("coef"), F.count("*").alias("uses"))
    got = f2.withColumnsRenamed({"pop1": "a", "pop2": "b"}).join(long, ["a", "b"])
    return got.groupBy(*keys, "block").agg(F.when(F.sum(F.when(F.col("est").isNotNull(), F.col("uses"))) == len(terms), F.sum(F.col("coef") * F.col("est"))).alias("est"), F.min("n_snps").alias("n_snps"))


F3_TERMS = [("pop1", "pop2", 0.5), ("pop1", "pop3", 0.5), ("pop2", "pop3", -0.5)]
F4_TERMS = [("pop1", "pop4", 0.5), ("pop2", "pop3", 0.5), ("pop1", "pop3", -0.5), ("pop2", "pop4", -0.5)]


def f3_blocks(f2: DataFrame, combs: DataFrame) -> DataFrame:
    return combine(f2, combs, F3_TERMS)


def f4_blocks(f2: DataFrame, combs: DataFrame) -> DataFrame:
    return combine(f2, combs, F4_TERMS)


def f2dat_f4dat(f2dat: DataFrame, combs: DataFrame) -> DataFrame:
    """Long f2 (pop1, pop2, est) -> f4 of the quadruples."""
    one = f2dat.select(F.least("pop1", "pop2").alias("pop1"), F.greatest("pop1", "pop2").alias("pop2"), "est").withColumn("block", F.lit(1)).withColumn("n_snps", F.lit(1))
    return f4_blocks(one, combs).select("pop1", "pop2", "pop3", "pop4", "est")


def complete_f4dat(f4: DataFrame) -> DataFrame:
    """All forms of each f4: pairs swapped, sides swapped."""
    def form(a, b, c, d, sign):
        return f4.select(F.col(a).alias("pop1"), F.col(b).alias("pop2"), F.col(c).alias("pop3"), F.col(d).alias("pop4"), (sign * F.col("est")).alias("est"))
    p = ("pop1", "pop2", "pop3", "pop4")
    out = None
    for side in (p, (p[2], p[3], p[0], p[1])):
        for i, j in ((0, 0), (1, 0), (0, 1), (1, 1)):
            a, b = (side[1], side[0]) if i else side[:2]
            c, d = (side[3], side[2]) if j else side[2:]
            f = form(a, b, c, d, -1 if i != j else 1)
            out = f if out is None else out.unionByName(f)
    return out.distinct()


def average_f4blockdat(f4: DataFrame) -> DataFrame:
    """est of each f4 replaced by the mean of four means: of all f4 of the block with the same population in the
    same two places, weighted by sqrt(n)."""
    w = F.sqrt("n")
    sides = [("pop1", "pop3"), ("pop1", "pop4"), ("pop2", "pop3"), ("pop2", "pop4")]
    out = f4
    for i, (a, b) in enumerate(sides):
        win = Window.partitionBy("block", a, b)
        seen = F.col("est").isNotNull()
        out = out.withColumn(f"m{i}", F.try_divide(F.sum(F.col("est") * w).over(win), F.sum(F.when(seen, w)).over(win)))
    return out.withColumn("est", (F.col("m0") + F.col("m1") + F.col("m2") + F.col("m3")) / 4).drop("m0", "m1", "m2", "m3")


#: combinations of a broadcast piece, and cells (combinations x variants) of a step in a task
COMBS_A_PIECE, CELLS = 1_000_000, 2_000_000


def _task(shared, kernel):
    """A block's rows -> the statistics of all combinations of a piece."""

    def run(pdf):
        names, c, model, rows = shared.value
        v, col = np.unique(pdf["variant_idx"].to_numpy(), return_inverse=True)
        row = pdf["pop"].map({p: i for i, p in enumerate(names)}).to_numpy()
        p, n = np.full((len(names), len(v)), np.nan), np.full((len(names), len(v)), np.nan)
        p[row, col], n[row, col] = pdf["p"].to_numpy(), pdf["n"].to_numpy()
        parts = [np.zeros(len(c)) for _ in range(4)]
        need = {m: np.isfinite(p[np.unique(c[model == m])]).all(0) for m in np.unique(model)}
        step = max(1, CELLS // max(1, len(v)))
        for m in np.unique(model):
            of = np.flatnonzero(model == m)
            for s in range(0, len(of), step):
                at = of[s : s + step]
                for part, x in zip(parts, kernel(p, n, c[at], need[m])):
                    part[at] = x
        got = parts[3] > 0
        out = rows[got].copy()
        out["block"] = pdf["block"].iloc[0]
        for name, x in zip(("est", "den"), parts):
            out[name] = x[got]
        out["n"] = parts[2][got].astype(np.int64)
        return out.reset_index(drop=True)

    return run


def _geno_blocks(af: DataFrame, blocks: DataFrame, combs: DataFrame, k: int, kernel) -> DataFrame:
    """kernel(p, n, c, need) -> est, den, n, seen: for populations x variants of a block, rows of k populations and, for each, which
    variants may count. A block's frequencies meet in one task as a matrix; its size follows from the genome and the number of
    populations. Combinations are broadcast in pieces of COMBS_A_PIECE."""
    keys = combs.columns
    table = combs.toPandas()  # what is asked for, as numbers: k a row
    names = sorted({p for i in range(k) for p in table[f"pop{i + 1}"]})
    at = {p: i for i, p in enumerate(names)}
    index = np.stack([table[f"pop{i + 1}"].map(at).to_numpy(np.int32) for i in range(k)], 1) if len(table) else np.zeros((0, k), np.int32)
    model = table["model"].to_numpy() if "model" in keys else np.zeros(len(table), np.int64)
    seen = af.where("p IS NOT NULL AND n > 0").where(F.col("pop").isin(names)).join(blocks.select("variant_idx", "block"), "variant_idx").select("block", "variant_idx", "pop", "p", F.col("n").cast("double").alias("n"))
    kinds = {f.name: f.dataType.simpleString() for f in combs.schema}
    schema = ", ".join(f"{c} {kinds[c]}" for c in keys) + f", block {dict(seen.dtypes)['block']}, est double, den double, n long"
    out = None
    for first in range(0, max(1, len(table)), COMBS_A_PIECE):
        piece = slice(first, first + COMBS_A_PIECE)
        shared = af.sparkSession.sparkContext.broadcast((names, index[piece], model[piece], table.iloc[piece]))

        got = seen.groupBy("block").applyInPandas(_task(shared, kernel), schema)
        out = got if out is None else out.unionByName(got)
    nan = lambda c: F.when(~F.isnan(c), F.col(c)).alias(c)
    return out.select(*keys, "block", nan("est"), nan("den"), "n")


def _means(num, den, counted, ok):
    """Means of terms over variants: of num where counted, of den where ok; numbers of both."""
    with np.errstate(invalid="ignore", divide="ignore"):
        n, all_ = counted.sum(1), ok.sum(1)
        return np.where(counted, num, 0.0).sum(1) / n, np.where(ok, den, 0.0).sum(1) / all_, n, all_


def f4_geno_blocks(af: DataFrame, blocks: DataFrame, combs: DataFrame, *, allsnps: bool = True, poly_only: bool = False) -> DataFrame:
    """f4 and D terms from frequencies: block, pop1..pop4[, model], est, den, n. allsnps=False uses, for
    a model (all combinations if there is no column model), variants seen in all of its populations."""

    def kernel(p, n, c, need):
        w, x, y, z = (p[c[:, i]] for i in range(4))
        ok = np.isfinite(w) & np.isfinite(x) & np.isfinite(y) & np.isfinite(z)
        if not allsnps:
            ok &= need
        counted = ok & ~((w == x) & (x == y) & (y == z)) if poly_only else ok
        return _means((w - x) * (y - z), (w + x - 2 * w * x) * (y + z - 2 * y * z), counted, ok)

    return _geno_blocks(af, blocks, combs, 4, kernel)


def f3_geno_blocks(af: DataFrame, blocks: DataFrame, combs: DataFrame, *, apply_corr: bool = True, outgroupmode: bool = False) -> DataFrame:
    """f3 terms from frequencies, unbiased for the first population: block, pop1..pop3, est, den, n."""

    def kernel(p, n, c, need):
        a, x, y, m = p[c[:, 0]], p[c[:, 1]], p[c[:, 2]], n[c[:, 0]]
        ok = np.isfinite(a) & np.isfinite(x) & np.isfinite(y)
        with np.errstate(invalid="ignore", divide="ignore"):
            h = np.where(m != 1, a * (1 - a) / (m - 1) * m, np.nan)  # heterozygosity / 2
        num = (a - x) * (a - y)
        if apply_corr:
            own = (c[:, 0] == c[:, 1]) | (c[:, 0] == c[:, 2])
            num = num - np.where(own[:, None], 0.0, h / m)
        den = np.ones_like(num) if outgroupmode else 2 * h
        counted = ok & np.isfinite(num)
        some = ok & np.isfinite(den)
        est, _, k, _ = _means(num, den, counted, counted)
        _, mean, _, _ = _means(num, den, some, some)
        return est, mean, k, ok.sum(1)

    return _geno_blocks(af, blocks, combs, 3, kernel)


def f4_from_afdat(wide: DataFrame, combs: list[tuple[str, str, str, str]], by: list[str] | None = None) -> DataFrame:
    """f4 of a table with a column a population, optionally by groups."""
    cells = [F.struct(*[F.lit(p).alias(f"pop{i + 1}") for i, p in enumerate(c)], ((F.col(c[0]) - F.col(c[1])) * (F.col(c[2]) - F.col(c[3]))).alias("x")) for c in combs]
    return wide.select(*(by or []), F.inline(F.array(*cells))).groupBy(*(by or []), "pop1", "pop2", "pop3", "pop4").agg(F.avg("x").alias("est"), F.count("x").alias("n"))


def joint_spectrum(af: DataFrame, pops: list[str]) -> DataFrame:
    """pattern (a digit a population, 1 = derived), proportion, total over variants with all populations."""
    v = af.where(F.col("pop").isin(pops)).groupBy("variant_idx").pivot("pop", pops).agg(F.first("p")).dropna()
    cells = []
    for bits in itertools.product((0, 1), repeat=len(pops)):
        x = F.lit(1.0)
        for pop, b in zip(pops, bits):
            x = x * (F.col(f"`{pop}`") if b else 1 - F.col(f"`{pop}`"))
        cells.append(F.struct(F.lit("".join(map(str, bits))).alias("pattern"), x.alias("x")))
    return v.select(F.inline(F.array(*cells))).groupBy("pattern").agg(F.avg("x").alias("proportion"), F.sum("x").alias("total"))


def joint_sfs(counts: DataFrame, tops: dict[str, int]) -> DataFrame:
    """Number of variants of each combination of allele counts, zeros too. counts: a column a population."""
    pops = list(tops)
    grid = None
    for p in pops:
        one = counts.sparkSession.range(tops[p] + 1).select(F.col("id").cast("int").alias(p))
        grid = one if grid is None else grid.crossJoin(one)  # the axes of the spectrum, not data
    seen = counts.groupBy(*pops).agg(F.count("*").alias("n"))
    return grid.join(seen, pops, "left").withColumn("n", F.coalesce("n", F.lit(0)))


def sfs_to_f2(sfs: DataFrame, tops: dict[str, int]) -> DataFrame:
    """f2 and Fst of each pair of populations from a spectrum."""
    cells = []
    for a, b in itertools.combinations(tops, 2):
        p, q, m, n = F.col(a) / tops[a], F.col(b) / tops[b], tops[a], tops[b]
        num = F.pow(p - q, 2) - p * (1 - p) / max(1, m - 1) - q * (1 - q) / max(1, n - 1)
        den = num + p * (1 - p) * m / max(1, m - 1) + q * (1 - q) * n / max(1, n - 1)
        cells.append(F.struct(F.lit(a).alias("pop1"), F.lit(b).alias("pop2"), num.alias("x"), den.alias("y")))
    rows = sfs.select("n", F.inline(F.array(*cells)))
    return rows.groupBy("pop1", "pop2").agg(F.try_divide(F.sum(F.col("n") * F.col("x")), F.sum("n")).alias("f2"), F.try_divide(F.sum(F.col("n") * F.col("x")), F.sum(F.col("n") * F.col("y"))).alias("fst"))


def individual_blocks(geno: DataFrame, blocks: DataFrame) -> DataFrame:
    """Per sample and block: a, mean allele count over both codings, and n, mean number of alleles."""
    g = geno.join(blocks.select("variant_idx", "block"), "variant_idx")
    n = F.when(F.col("dosage").isNull(), 0.0).otherwise(2.0)
    a = F.coalesce(F.col("dosage").cast("double"), F.lit(0.0))
    return g.groupBy("sample_id", "block").agg(((F.avg(a) + F.avg(n - a)) / 2).alias("a"), F.avg(n).alias("n"))


TILE = 2048


def individual_pairs(geno: DataFrame, blocks: DataFrame) -> DataFrame:
    """Per pair of samples and block: aa, nn over variants that both have. A block's genotypes are a matrix in one task and pairs are
    matrix products, TILE samples against TILE at a time."""
    g = geno.where("dosage IS NOT NULL").join(blocks.select("variant_idx", "block"), "variant_idx").select("block", "variant_idx", "sample_id", F.col("dosage").cast("double").alias("g"))

    def run(pdf):
        v, col = np.unique(pdf["variant_idx"].to_numpy(), return_inverse=True)
        names, row = np.unique(pdf["sample_id"].to_numpy().astype(str), return_inverse=True)
        x, m = np.zeros((len(names), len(v))), np.zeros((len(names), len(v)))
        x[row, col], m[row, col] = pdf["g"].to_numpy(), 1.0
        out = []
        for i in range(0, len(names), TILE):
            for j in range(i, len(names), TILE):
                a, b, p, q = x[i : i + TILE], x[j : j + TILE], m[i : i + TILE], m[j : j + TILE]
                k = p @ q.T
                aa = a @ b.T - a @ q.T - p @ b.T + 2 * k  # (x y + (2 - x) (2 - y)) / 2
                r, c = np.nonzero((k > 0) & (np.arange(len(a))[:, None] + i <= np.arange(len(b))[None, :] + j))
                out.append(pd.DataFrame({"s1": names[r + i], "s2": names[c + j], "block": pdf["block"].iloc[0], "aa": aa[r, c] / k[r, c], "nn": 4.0, "k": k[r, c].astype(np.int64)}))
        return pd.concat(out)

    return g.groupBy("block").applyInPandas(run, f"s1 string, s2 string, block {dict(g.dtypes)['block']}, aa double, nn double, k long")


def f2_from_individuals(pairs_: DataFrame, samples: DataFrame) -> DataFrame:
    """Population f2 per block from products of individuals, each individual's own product left out of its
    population's. samples: sample_id, pop."""
    s = lambda i: samples.select(F.col("sample_id").alias(f"s{i}"), F.col("pop").alias(f"q{i}"))
    rows = pairs_.where("s1 <> s2").join(s(1), "s1").join(s(2), "s2")
    sim = rows.groupBy("block", F.least("q1", "q2").alias("pop1"), F.greatest("q1", "q2").alias("pop2")).agg((F.sum(F.col("aa") * F.col("k")) / F.sum(F.col("nn") * F.col("k"))).alias("phi"))
    own = sim.where("pop1 = pop2").select("block", F.col("pop1").alias("q"), F.col("phi").alias("w"))
    a, b = own.withColumnsRenamed({"q": "pop1", "w": "w1"}), own.withColumnsRenamed({"q": "pop2", "w": "w2"})
    return sim.where("pop1 <> pop2").join(a, ["block", "pop1"]).join(b, ["block", "pop2"]).select("block", "pop1", "pop2", ((F.col("w1") + F.col("w2")) - 2 * F.col("phi")).alias("est"))
