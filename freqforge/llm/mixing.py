"""Mixing sources to target weights: capped water-filling, then seeded repetitions.

A source's target is its weight's part of the mix, clamped at `epochs` times its own size;
what is clamped off is shared again by weight until no source is above. Sorted by the level
at which they clamp, the sources need one pass of running sums for that fixpoint.

Every document is taken floor(target / source size) times; for the rest of the target,
documents follow each other in the order of a seeded hash until their words reach it (the
last one by rounding, so a source misses its target by half a document at most). The running
sum is kept within (source, hash bucket) and bucket sums are added, so a source with a third
of all rows doesn't meet in one task.

Cases: null text has size 0; a null source is a source, the last; a source without words has
target 0; equal rows are taken one by one; an empty table gives no rows; other columns of the
input are ignored by ``mix``.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, read, table

SEED = "mix-1"
SHARE = 1.5
EPOCHS = 2
WEIGHTS = (5, 2, 1)


def targets(sizes: DataFrame, share: float = SHARE, epochs: int = EPOCHS, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """sizes: skey, source_size, a row for each source. Adds target. Sources are metadata: a
    row each, so the windows over all of them read as many rows as there are sources."""
    rank = F.row_number().over(Window.orderBy("skey")) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int"))
    s = sizes.withColumn("w", weight).withColumn("cap", F.col("source_size") * float(epochs))
    s = s.withColumn("level", F.col("cap") / F.col("w"))
    order = Window.orderBy("level", "skey")
    before, everything = order.rowsBetween(Window.unboundedPreceding, -1), Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = s.withColumn("c0", F.coalesce(F.sum("cap").over(before), F.lit(0.0))).withColumn("w0", F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    s = s.withColumn("lam", (F.sum("source_size").over(everything) * share - F.col("c0")) / (F.sum("w").over(everything) - F.col("w0")))
    s = s.withColumn("open", F.col("lam") < F.col("level"))
    s = s.withColumn("star", F.min(F.when(F.col("open"), F.struct("level", "skey", "lam"))).over(everything))
    above = F.col("star").isNotNull() & (F.struct("level", "skey") >= F.struct(F.col("star.level"), F.col("star.skey")))
    return s.select("skey", "source_size", F.when(above, F.col("star.lam") * F.col("w")).otherwise(F.col("cap")).alias("target"))


def _parts(docs: DataFrame, doc_id: str, text: str, source: str, seed: str):
    """Expressions of a row's size, source key and place in the order."""
    size = F.coalesce(F.regexp_count(docs[text], F.lit(WORD)), F.lit(0)).cast("long")
    skey = F.concat(F.when(docs[source].isNull(), "1").otherwise("0"), F.coalesce(docs[source], F.lit("")))
    h = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(docs[doc_id].cast("string"), F.lit(""))).cast("binary"))
    return size, skey, h


def mix(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source", share: float = SHARE, epochs: int = EPOCHS, weights: tuple[int, ...] = WEIGHTS, seed: str = SEED) -> DataFrame:
    """doc_id, size, source_size, target, taken, and reps (how often the document is in the mix),
    whole, skey and h."""
    size, skey, h = _parts(docs, doc_id, text, source, seed)
    rows = table(docs.select(docs[doc_id].alias("doc_id"), skey.alias("skey"), size.alias("size"), h.alias("h")), "mix-rows")
    rows = rows.withColumn("bucket", F.substring("h", 1, 3))
    sums = rows.groupBy("skey", "bucket").agg(F.sum("size").alias("n"))
    want = targets(sums.groupBy("skey").agg(F.sum("n").alias("source_size")), share, epochs, weights)
    offsets = sums.select("skey", "bucket", (F.sum("n").over(Window.partitionBy("skey").orderBy("bucket")) - F.col("n")).alias("before"))
    offsets = offsets.join(want, "skey")
    run = Window.partitionBy("skey", "bucket").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    got = rows.withColumn("upto", F.sum("size").over(run)).join(offsets, ["skey", "bucket"])
    whole = F.coalesce(F.floor(F.try_divide(F.col("target"), F.col("source_size"))), F.lit(0))
    rest = F.col("target") - whole * F.col("source_size")
    extra = (rest > 0) & (2 * (F.col("before") + F.col("upto")) - F.col("size") <= 2 * rest)
    reps = whole + extra.cast("long")
    return got.select("doc_id", "size", "source_size", "target", (F.col("size") * reps).alias("taken"), reps.alias("reps"), whole.alias("whole"), "skey", "h")


#: so many sources may be broadcast
SOURCES = 100_000


def mixed(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source", seed: str = SEED, **how) -> DataFrame:
    """The documents themselves, each as often as the mix takes it; columns stay. A source's documents are
    taken up to a place in its order, so rows need only their source's cut, and no text is shuffled."""
    got = mix(docs, doc_id=doc_id, text=text, source=source, seed=seed, **how)
    last = F.max(F.when(F.col("reps") > F.col("whole"), F.struct("h", F.col("doc_id").alias("i"), F.col("size").alias("s"))))
    cuts = table(got.groupBy("skey").agg(F.max("whole").alias("whole"), last.alias("last")), "mix-cuts")
    cuts = F.broadcast(cuts) if cuts.count() <= SOURCES else cuts
    size, skey, h = _parts(docs, doc_id, text, source, seed)
    here = F.struct(h.alias("h"), docs[doc_id].alias("i"), size.alias("s"))
    cut = cuts.select(F.struct("*").alias("__cut"))
    rows = docs.join(cut, F.col("__cut.skey") == skey)
    reps = F.col("__cut.whole") + F.coalesce((here <= F.col("__cut.last")).cast("long"), F.lit(0))
    return rows.withColumn("__reps", reps).where("__reps > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__reps")))).select(*[F.col(f"`{c}`") for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


ORACLE_SQL = rf"""
WITH d AS (
  SELECT doc_id, (CASE WHEN source IS NULL THEN '1' ELSE '0' END) || coalesce(source, '') AS skey,
         CAST(coalesce(len(regexp_extract_all(text, '{WORD}')), 0) AS BIGINT) AS size,
         md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM documents),
s0 AS (SELECT skey, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY skey),
s1 AS (SELECT *, [5e0, 2e0, 1e0][1 + (row_number() OVER (ORDER BY skey) - 1) % 3] AS w, source_size * 2e0 AS cap FROM s0),
s2 AS (SELECT *, cap / w AS level FROM s1),
s3 AS (SELECT *, ((SELECT sum(source_size) FROM s0) * 1.5e0 - coalesce(sum(cap) OVER (ORDER BY level, skey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0e0))
              / ((SELECT sum(w) FROM s1) - coalesce(sum(w) OVER (ORDER BY level, skey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0e0)) AS lam,
              row_number() OVER (ORDER BY level, skey) AS k FROM s2),
k0 AS (SELECT min(k) AS k FROM s3 WHERE lam < level),
s AS (SELECT skey, source_size, CASE WHEN s3.k >= k0.k THEN (SELECT lam FROM s3 JOIN k0 USING (k)) * w ELSE cap END AS target FROM s3, k0),
r AS (SELECT doc_id, size, source_size, target, coalesce(floor(target / nullif(source_size, 0)), 0) AS whole,
             sum(size) OVER (PARTITION BY d.skey ORDER BY h, doc_id, size ROWS UNBOUNDED PRECEDING) AS upto FROM d JOIN s ON d.skey = s.skey)
SELECT doc_id, size, source_size, target,
       CAST(size * (whole + CASE WHEN target - whole * source_size > 0 AND 2 * upto - size <= 2 * (target - whole * source_size) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM r
"""
