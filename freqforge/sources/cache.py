"""The f2 cache: Parquet tables with a JSON sidecar and an id that follows from inputs and filters."""
from __future__ import annotations

import atexit
import hashlib
import json
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.blocks import block_lengths
from ..operators.fstats import complete_blocks, pair_blocks

SCHEMA_VERSION = 1


def cache_id(**inputs) -> str:
    """The same inputs and filters give the same id."""
    return "sha256:" + hashlib.sha256(json.dumps(inputs, sort_keys=True, default=str).encode()).hexdigest()


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Written beside and renamed, so that readers see all or nothing."""
    fs, p = _fs(spark, path)
    tmp = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path + ".tmp")
    out = fs.create(tmp, True)
    out.write(bytearray(text.encode()))
    out.close()
    fs.delete(p, False)
    fs.rename(tmp, p)


def written(df: DataFrame, what: str) -> DataFrame:
    """df as a Parquet table in the shared folder (spark.checkpoint.dir; where that is unset and Spark is one process, a
    temporary one), so that what reads it several times doesn't make it several times. The files go when the session ends."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and the executors share")
        folder = "file://" + tempfile.gettempdir()
    path = f"{folder}/freqforge-tables/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)

    def remove() -> None:
        try:
            fs, p = _fs(spark, path)
            fs.delete(p, True)
        except Exception:  # the session has ended
            pass

    atexit.register(remove)
    return spark.read.schema(df.schema).parquet(path)


def content_id(who: DataFrame, kept: DataFrame, blocks: DataFrame, **settings) -> str:
    """An id of what goes into a cache: samples and their populations, variants, and blocks, in any order; not where they are."""
    marks = [t.agg(F.count("*"), F.sum(F.xxhash64(*cols).cast("decimal(38,0)"))).first() for t, cols in ((who, ["sample_id", "pop"]), (kept, ["variant_idx", "snp"]), (blocks, ["variant_idx", "block"]))]
    return cache_id(contents=[[str(x) for x in m] for m in marks], **settings)


def read_metadata(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(f"{path}/metadata.json", wholetext=True).first()[0])


def write_f2(af: DataFrame, blocks: DataFrame, path: str, overwrite: bool = False, **inputs) -> str:
    """f2, allele products and Fst of all pairs, by pair; returns the id."""
    spark = af.sparkSession
    n = block_lengths(blocks)
    got = pair_blocks(af, blocks).join(F.broadcast(n), "block")  # a row a block
    got.repartition("pop1").write.mode("overwrite" if overwrite else "error").partitionBy("pop1").parquet(f"{path}/pairs")
    made = cache_id(**inputs)
    write_text(spark, f"{path}/metadata.json", json.dumps({"schema_version": SCHEMA_VERSION, "id": made, "inputs": inputs}, sort_keys=True, default=str))
    return made


def read_f2(spark: SparkSession, path: str, pops: list[str] | None = None, pops2: list[str] | None = None, kind: str = "f2", remove_na: bool = True) -> DataFrame:
    """block, pop1, pop2, est, n_snps; only blocks in which every pair has a value."""
    t = spark.read.parquet(f"{path}/pairs")
    if pops is not None:
        a, b = list(pops), list(pops2 or pops)
        t = t.where((F.col("pop1").isin(a) & F.col("pop2").isin(b)) | (F.col("pop1").isin(b) & F.col("pop2").isin(a)))
    t = t.select("block", "pop1", "pop2", F.col(kind).alias("est"), "n_snps")
    return complete_blocks(t) if remove_na else t


def extract_subset(spark: SparkSession, source: str, target: str, pops: list[str]) -> None:
    t = spark.read.parquet(f"{source}/pairs").where(F.col("pop1").isin(pops) & F.col("pop2").isin(pops))
    t.write.partitionBy("pop1").parquet(f"{target}/pairs")
    meta = read_metadata(spark, source)
    write_text(spark, f"{target}/metadata.json", json.dumps(meta | {"pops": sorted(pops)}, sort_keys=True))


def write_counts(geno: DataFrame, blocks: DataFrame, path: str) -> None:
    """Individuals' and pairs' sufficient statistics."""
    from ..operators.fstats import individual_blocks, individual_pairs

    individual_blocks(geno, blocks).write.mode("overwrite").parquet(f"{path}/individuals")
    individual_pairs(geno, blocks).write.mode("overwrite").parquet(f"{path}/individual_pairs")


def group_samples(spark: SparkSession, path: str, inds: list[str], group: str) -> DataFrame:
    """Samples added up to a group, appended to the table of individuals; a name that is there already is an error."""
    t = spark.read.parquet(f"{path}/individuals")
    if not t.where(F.col("sample_id") == group).isEmpty():
        raise ValueError(f"{group} is there already; delete_group first")
    g = t.where(F.col("sample_id").isin(inds)).groupBy("block").agg(F.sum("a").alias("a"), F.sum("n").alias("n")).select(F.lit(group).alias("sample_id"), "block", "a", "n")
    g.write.mode("append").parquet(f"{path}/individuals")
    write_text(spark, f"{path}/groups/{group}.json", json.dumps({"group": group, "samples": sorted(inds)}))
    return g


def is_group(spark: SparkSession, path: str, name: str) -> bool:
    fs, p = _fs(spark, f"{path}/groups/{name}.json")
    return bool(fs.exists(p))


def delete_group(spark: SparkSession, path: str, group: str) -> None:
    """The table without the group is written and put in place before the old one goes."""
    kept = spark.read.parquet(f"{path}/individuals").where(F.col("sample_id") != group)
    kept.write.mode("overwrite").parquet(f"{path}/individuals.new")
    fs, now = _fs(spark, f"{path}/individuals")
    new, old = (_fs(spark, f"{path}/individuals.{x}")[1] for x in ("new", "old"))
    fs.delete(old, True)
    fs.rename(now, old)
    fs.rename(new, now)
    fs.delete(old, True)
    fs.delete(_fs(spark, f"{path}/groups/{group}.json")[1], False)


def is_cache(spark: SparkSession, path: str) -> bool:
    """Whether a folder holds an f2 cache."""
    fs, p = _fs(spark, f"{path}/pairs")
    return bool(fs.exists(p))


# --- frequencies on disk, and the way from them to f2 in two steps


def write_frequencies(af: DataFrame, kept: DataFrame, path: str, overwrite: bool = False) -> None:
    """af and its variants, so that filters and blocks can be chosen later; frequencies lie by population."""
    mode = "overwrite" if overwrite else "error"
    af.repartition("pop").write.mode(mode).partitionBy("pop").parquet(f"{path}/frequencies")
    kept.write.mode(mode).parquet(f"{path}/variants")


def read_frequencies(spark: SparkSession, path: str, pops: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """af and variants; populations that aren't asked for aren't read."""
    af = spark.read.parquet(f"{path}/frequencies")
    return af.where(F.col("pop").isin(pops)) if pops else af, spark.read.parquet(f"{path}/variants")


def extend_counts(geno: DataFrame, blocks: DataFrame, path: str, new: list[str]) -> None:
    """Statistics of further samples, alone and with all that are there, appended. geno holds both."""
    from ..operators.fstats import individual_blocks, individual_pairs

    fresh = geno.where(F.col("sample_id").isin(new))
    individual_blocks(fresh, blocks).write.mode("append").parquet(f"{path}/individuals")
    pairs = individual_pairs(geno, blocks).where(F.col("s1").isin(new) | F.col("s2").isin(new))
    pairs.write.mode("append").parquet(f"{path}/individual_pairs")


def read_individuals(spark: SparkSession, path: str, inds: list[str] | None = None) -> DataFrame:
    t = spark.read.parquet(f"{path}/individuals")
    return t.where(F.col("sample_id").isin(inds)) if inds else t


def read_pairs(spark: SparkSession, path: str, inds: list[str] | None = None, inds2: list[str] | None = None) -> DataFrame:
    """Pairs of one list of samples with another, or within one."""
    t = spark.read.parquet(f"{path}/individual_pairs")
    if not inds:
        return t
    a, b = list(inds), list(inds2 or inds)
    return t.where((F.col("s1").isin(a) & F.col("s2").isin(b)) | (F.col("s1").isin(b) & F.col("s2").isin(a)))
