"""Genotypes to allele frequencies, and SNP filters.

geno: variant_idx, sample_id, pop, dosage (0, 1, 2 or null). af: variant_idx, pop, p, n (observed
alleles). variant: variant_idx, snp, chr, cm, pos, a1, a2. Missing values are null everywhere.
"""
from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: highest autosome; letters before the number are ignored
AUTOSOMES = 22


def nan_to_null(c: Column) -> Column:
    """The one missing value is null."""
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def allele_frequencies(geno: DataFrame, ploidy: DataFrame | None = None) -> DataFrame:
    """af of diploid samples or, with ploidy (sample_id, ploidy), of samples that are counted as haploid;
    samples that ploidy doesn't name are haploid."""
    if ploidy is None:
        return geno.groupBy("variant_idx", "pop").agg((F.avg("dosage") / 2).alias("p"), (2 * F.count("dosage")).cast("double").alias("n"))
    g = geno.join(ploidy, "sample_id", "left").withColumn("ploidy", F.coalesce("ploidy", F.lit(1))).where("dosage IS NOT NULL")
    alleles = F.sum("ploidy").cast("double")
    return g.groupBy("variant_idx", "pop").agg((F.sum(F.col("dosage") / (3 - F.col("ploidy"))) / alleles).alias("p"), alleles.alias("n"))


def sample_ploidy(geno: DataFrame, ntest: int = 1000) -> DataFrame:
    """A sample without a heterozygote among the first ntest variants is haploid, one that isn't seen there too."""
    first = geno.select("variant_idx").distinct().orderBy("variant_idx").limit(ntest).withColumn("tested", F.lit(True))
    het = F.col("tested") & (F.col("dosage") == 1)
    return geno.join(first, "variant_idx", "left").groupBy("sample_id").agg((1 + F.coalesce(F.max(het.cast("int")), F.lit(0))).alias("ploidy"))


def halve_pseudohaploid(geno: DataFrame) -> DataFrame:
    """Samples with exactly two distinct values, the larger one 2, get half their dosage."""
    w = geno.groupBy("sample_id").agg(F.count_distinct("dosage").alias("k"), F.max("dosage").alias("m"))
    half = w.where("k = 2 AND m = 2").select("sample_id", F.lit(True).alias("half"))
    return geno.join(half, "sample_id", "left").withColumn("dosage", F.when("half", F.col("dosage") / 2).otherwise(F.col("dosage"))).drop("half")


def make_pseudohaploid(geno: DataFrame, seed: str = "0") -> DataFrame:
    """Heterozygotes become 0 or 2 by a seeded hash."""
    coin = F.substring(F.md5(F.concat_ws(":", F.lit(seed), "variant_idx", "sample_id").cast("binary")), 1, 1) < "8"
    return geno.withColumn("dosage", F.when(F.col("dosage") == 1, F.when(coin, 0).otherwise(2)).otherwise(F.col("dosage")))


def mean_impute(df: DataFrame, value: str, by: str) -> DataFrame:
    """Nulls of value become its mean within `by`."""
    return df.withColumn(value, F.coalesce(F.col(value).cast("double"), F.avg(value).over(Window.partitionBy(by))))


def snp_features(af: DataFrame, pops: int, outpop: str | None = None) -> DataFrame:
    """Per variant: miss (share of populations without data), maf, minac, poly, outaf."""
    seen = F.col("p").isNotNull() & (F.col("n") > 0)
    freq = F.try_divide(F.sum(F.col("p") * F.col("n")), F.sum(F.when(seen, F.col("n"))))
    alt, total = F.sum(F.col("p") * F.col("n")), F.sum(F.when(seen, F.col("n")))
    out = F.max(F.when(F.col("pop") == outpop, F.col("p"))) if outpop else F.lit(None).cast("double")
    return af.groupBy("variant_idx").agg(
        (1 - F.count(F.when(seen, 1)) / float(pops)).alias("miss"), F.least(freq, 1 - freq).alias("maf"), F.least(alt, total - alt).alias("minac"),
        (F.min("p") != F.max("p")).alias("poly"), out.alias("outaf"))


def _class(a1: str = "a1", a2: str = "a2") -> Column:
    """transition, transversion or null."""
    pair = F.array_join(F.sort_array(F.array(F.upper(a1), F.upper(a2))), "")
    return F.when(pair.isin("AG", "CT"), "transition").when(pair.isin("AC", "AT", "CG", "GT"), "transversion")


def keep_snps(features: DataFrame, variant: DataFrame, *, maxmiss: float = 0, minmaf: float = 0, maxmaf: float = 0.5, minac2: bool = False, outpop: bool = False, auto_only: bool = True, poly_only: bool = False, transitions: bool = True, transversions: bool = True, keepsnps: Iterable[str] | DataFrame | None = None) -> DataFrame:
    """variant rows that pass; keepsnps (names, or a table with `snp`) is instead of all tests."""
    if isinstance(keepsnps, DataFrame):
        return variant.join(keepsnps.select("snp").distinct(), "snp", "left_semi")
    if keepsnps is not None:
        return variant.where(F.col("snp").isin(list(keepsnps)))
    v = variant.join(features, "variant_idx")
    ok = (F.col("miss") <= maxmiss) & F.col("maf").between(minmaf, maxmaf)
    if minac2:
        ok &= F.col("minac") > 1
    if outpop:
        ok &= (F.col("outaf") > 0) & (F.col("outaf") < 1)
    if auto_only:
        ok &= F.regexp_replace("chr", "[A-Za-z]", "").try_cast("int") <= AUTOSOMES
    if poly_only:
        ok &= F.col("poly")
    if not transitions:
        ok &= _class() != "transition"
    if not transversions:
        ok &= _class() != "transversion"
    return v.where(ok).select(*variant.columns)


def discard_from_aftable(af: DataFrame, variant: DataFrame, pops: int, *, outpop: str | None = None, **tests) -> DataFrame:
    kept = keep_snps(snp_features(af, pops, outpop), variant, outpop=outpop is not None, **tests)
    return af.join(kept.select("variant_idx"), "variant_idx", "left_semi")


def discard_from_geno(geno: DataFrame, variant: DataFrame, samples: int, **tests) -> DataFrame:
    """The same tests on individuals: miss is the share of samples without a genotype."""
    g = geno.groupBy("variant_idx").agg((1 - F.count("dosage") / float(samples)).alias("miss"), (F.avg("dosage") / 2).alias("f"), F.sum("dosage").alias("ac"), (2 * F.count("dosage")).alias("n"), (F.min("dosage") != F.max("dosage")).alias("poly"))
    feats = g.select("variant_idx", "miss", F.least("f", 1 - F.col("f")).alias("maf"), F.least("ac", F.col("n") - F.col("ac")).cast("double").alias("minac"), "poly", F.lit(None).cast("double").alias("outaf"))
    return geno.join(keep_snps(feats, variant, **tests).select("variant_idx"), "variant_idx", "left_semi")


def structured_missingness(af: DataFrame, pops: list[str]) -> DataFrame:
    """Correlation of population i's frequency with the missingness of population j: pop1, pop2, r, n."""
    wide = af.groupBy("variant_idx").pivot("pop", pops).agg(F.first("p"))
    cells = [F.struct(F.lit(a).alias("pop1"), F.lit(b).alias("pop2"), F.col(f"`{a}`").alias("x"), F.col(f"`{b}`").isNull().cast("double").alias("y")) for a in pops for b in pops if a != b]
    long = wide.select(F.inline(F.array(*cells))).where("x IS NOT NULL")
    return long.groupBy("pop1", "pop2").agg(F.try_divide(F.covar_pop("x", "y"), F.stddev_pop("x") * F.stddev_pop("y")).alias("r"), F.count("*").alias("n"))
