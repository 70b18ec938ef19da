"""End to end: genotype files to an f2 cache, and models rerun on resampled blocks or individuals."""
from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import cache
from ..sources import geno as S
from . import af as A
from . import blocks as B
from . import fstats
from . import resample as R


def frequencies(spark: SparkSession, prefix: str, *, inds: list[str] | None = None, pops: list[str] | None = None, adjust_pseudohaploid: bool = True) -> DataFrame:
    """af of genotype files of any format."""
    g = S.genotypes(spark, prefix, inds, pops)
    return A.allele_frequencies(g, A.sample_ploidy(g) if adjust_pseudohaploid else None)


def _kept(spark, prefix, af, pops, outpop, filters):
    v = S.variants(spark, prefix)
    n = len(pops) if pops else af.select("pop").distinct().count()
    kept = A.keep_snps(A.snp_features(af, n, outpop), v, outpop=outpop is not None, **filters)
    return af.join(kept.select("variant_idx"), "variant_idx", "left_semi"), kept


def extract_f2(spark: SparkSession, prefix: str, outdir: str, *, inds: list[str] | None = None, pops: list[str] | None = None, blgsize: float = 0.05, outpop: str | None = None, adjust_pseudohaploid: bool = True, overwrite: bool = False, **filters) -> str:
    """Read, filter, cut into blocks, write f2, allele products and Fst; returns the cache id."""
    af, kept = _kept(spark, prefix, frequencies(spark, prefix, inds=inds, pops=pops, adjust_pseudohaploid=adjust_pseudohaploid), pops, outpop, filters)
    return cache.write_f2(af, B.assign_blocks(kept, blgsize), outdir, overwrite, prefix=prefix, inds=inds, pops=pops, blgsize=blgsize, outpop=outpop, **filters)


def f2_from_geno(spark: SparkSession, prefix: str, *, kind: str = "f2", pops: list[str] | None = None, blgsize: float = 0.05, outpop: str | None = None, **filters) -> DataFrame:
    """The same without a cache: block, pop1, pop2, est, n_snps, complete blocks only."""
    af, kept = _kept(spark, prefix, frequencies(spark, prefix, pops=pops), pops, outpop, filters)
    bl = B.assign_blocks(kept, blgsize)
    got = fstats.pair_blocks(af, bl).select("block", "pop1", "pop2", F.col(kind).alias("est")).join(F.broadcast(B.block_lengths(bl)), "block")
    return fstats.complete_blocks(fstats.scale_ap(got) if kind == "ap" else got)


def resample_snps(f2: DataFrame, run, nboot: int | None = None, seed: str = "0") -> DataFrame:
    """run(f2 blocks) -> result, on each replicate: one block left out or, with nboot, blocks drawn (n_snps counts a block as
    often as it is drawn). Replicates are tagged, so one plan serves them all where run keeps a column rep; here each is a plan of its own."""
    if nboot is None:
        reps = [r["block"] for r in f2.select("block").distinct().orderBy("block").collect()]  # a row a block
        parts = [run(f2.where(F.col("block") != b)).withColumn("rep", F.lit(b)) for b in reps]
    else:
        d = R.draws(f2, nboot, seed)
        parts = [run(f2.join(F.broadcast(d.where(F.col("rep") == k)), "block").withColumn("n_snps", F.col("n_snps") * F.col("times")).drop("rep", "times")).withColumn("rep", F.lit(k)) for k in range(nboot)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def resample_individuals(geno: DataFrame, blocks: DataFrame, run) -> DataFrame:
    """run(f2 blocks) without one individual at a time, of populations that have others: rep is its name."""
    who = geno.select("sample_id", "pop").distinct()
    n = who.groupBy("pop").agg(F.count("*").alias("k")).where("k > 1")
    names = sorted(r["sample_id"] for r in who.join(n, "pop").select("sample_id").collect())  # sample names
    out = None
    for x in names:
        af = A.allele_frequencies(geno.where(F.col("sample_id") != x))
        f2 = fstats.pair_blocks(af, blocks).select("block", "pop1", "pop2", F.col("f2").alias("est")).join(F.broadcast(B.block_lengths(blocks)), "block")
        got = run(f2).withColumn("rep", F.lit(x))
        out = got if out is None else out.unionByName(got)
    return out


def random_dates(edges: list[tuple[str, str]], least: float = 1000, most: float = 1000, seed: int = 0) -> dict[str, float]:
    """Node dates that increase towards the root by steps between least and most."""
    from ..functions.graph import Graph

    g, rng = Graph(edges), random.Random(seed)
    out: dict[str, float] = {}
    for n in reversed(g.order):
        out[n] = max((out[c] for c in g.down[n]), default=-1.0) + rng.uniform(least, most) if g.down[n] else 0.0
    return out
