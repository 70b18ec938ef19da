"""The observation view: the star schema read as genotypes.

A line item is a diploid sample of its supplier's region, its part the variant, its quantity modulo 3
the number of derived alleles. A hundred parts are a chromosome, a part a hundredth of a Morgan.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def geno(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    pops = t("supplier").join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select("s_suppkey", F.col("r_name").alias("pop"))
    rows = t("lineitem").select("l_partkey", "l_suppkey", "l_quantity").join(pops, F.col("l_suppkey") == F.col("s_suppkey"))
    return rows.select(F.col("l_partkey").alias("variant_idx"), F.col("l_suppkey").cast("string").alias("sample_id"), "pop", (F.col("l_quantity").cast("int") % 3).alias("dosage"))


def individuals(g: DataFrame) -> DataFrame:
    """A genotype a (variant, sample): the largest where there are several."""
    return g.groupBy("variant_idx", "sample_id", "pop").agg(F.max("dosage").alias("dosage"))


def variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("variant_idx"), "p_size")
    i = F.col("variant_idx")
    letters = F.array(*map(F.lit, "ACGT"))
    return p.select("variant_idx", F.concat(F.lit("rs"), "variant_idx").alias("snp"), (1 + F.floor(i / 100)).cast("string").alias("chr"), (i % 100).cast("double").alias("cm"), (1000.0 * F.col("variant_idx")).alias("pos"), F.get(letters, (F.col("variant_idx") % 4).cast("int")).alias("a1"), F.get(letters, ((F.col("variant_idx") + 1 + F.col("p_size") % 3) % 4).cast("int")).alias("a2"))


#: the same as common table expressions for the SQL side; a block is 25 hundredths of a Morgan
CTE = """
g AS (SELECT l_partkey AS v, CAST(l_suppkey AS VARCHAR) AS s, r_name AS pop, CAST(l_quantity AS INT) % 3 AS g
      FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
af AS (SELECT v, pop, avg(g) / 2e0 AS p, 2e0 * count(*) AS n FROM g GROUP BY v, pop),
va AS (SELECT p_partkey AS v, 'rs' || p_partkey AS snp, 1 + p_partkey // 100 AS chr, p_partkey % 100 AS cm,
       substr('ACGT', CAST(1 + p_partkey % 4 AS INT), 1) AS a1, substr('ACGT', CAST(1 + (p_partkey + 1 + p_size % 3) % 4 AS INT), 1) AS a2 FROM part),
bl AS (SELECT v, CAST(1 + v // 25 AS INT) AS b FROM va),
bn AS (SELECT b, count(*) AS n_snps FROM bl GROUP BY b),
pr AS (SELECT x.v, bl.b, x.pop AS pop1, x.p AS p1, x.n AS n1, y.pop AS pop2, y.p AS p2, y.n AS n2
       FROM af x JOIN af y ON x.v = y.v AND x.pop <= y.pop JOIN bl ON bl.v = x.v),
pt AS (SELECT *, (p1 - p2) * (p1 - p2) - p1 * (1 - p1) / greatest(1e0, n1 - 1) - p2 * (1 - p2) / greatest(1e0, n2 - 1) AS f2,
       (p1 * p2 + (1 - p1) * (1 - p2)) / 2 AS ap,
       (p1 - p2) * (p1 - p2) - p1 * (1 - p1) / nullif(n1 - 1, 0) - p2 * (1 - p2) / nullif(n2 - 1, 0) AS num,
       p1 * (1 - p1) * n1 / nullif(n1 - 1, 0) + p2 * (1 - p2) * n2 / nullif(n2 - 1, 0) AS het FROM pr),
pb AS (SELECT b, pop1, pop2, CASE WHEN pop1 = pop2 THEN 0 ELSE avg(f2) END AS f2, avg(ap) AS ap,
       CASE WHEN pop1 = pop2 THEN 0 ELSE avg(num) / nullif(avg(num + het), 0) END AS fst, count(*) AS n FROM pt GROUP BY b, pop1, pop2)"""
BLOCK_CM = 25.0
