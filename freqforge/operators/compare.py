"""Tables held against each other, and rows against their neighbours: joins that keep what only one side has, offsets, fills,
runs, the best of a group, sets of keys. Variants are ordered within chromosomes, so no order is global."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def compare_tables(a: DataFrame, b: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, value_a, value_b, diff for keys of either table; null where one lacks the key. Null keys meet nothing."""
    x, y = (t.select(*keys, F.col(value).alias(f"{value}_{s}")) for t, s in ((a, "a"), (b, "b")))
    return x.join(y, keys, "full_outer").withColumn("diff", F.col(f"{value}_a") - F.col(f"{value}_b"))


def onto(df: DataFrame, whole: DataFrame, keys: list[str]) -> DataFrame:
    """Every row of whole, with df's values where it has the key and nulls where it doesn't."""
    return df.join(whole, keys, "right")


def neighbours(variants: DataFrame, column: str = "pos", by: str = "chr") -> DataFrame:
    """variant_idx, before, after: distances to the variants on both sides of the chromosome; null at its ends."""
    w = Window.partitionBy(by).orderBy(column, "variant_idx")
    return variants.select("variant_idx", (F.col(column) - F.lag(column).over(w)).alias("before"), (F.lead(column).over(w) - F.col(column)).alias("after"))


def fill(variants: DataFrame, column: str, order: str = "variant_idx", by: str = "chr") -> DataFrame:
    """Nulls of column become the last value before them in the chromosome or, at its start, the first one after them."""
    w = Window.partitionBy(by).orderBy(order)
    down = F.last(column, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    up = F.first(column, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    return variants.withColumn(column, F.coalesce(down, up))


def runs(variants: DataFrame, column: str, order: str = "variant_idx", by: str = "chr") -> DataFrame:
    """Runs of equal values along a chromosome, nulls being equal: by, start, stop, the value, length."""
    w = Window.partitionBy(by).orderBy(order)
    new = F.coalesce((~F.col(column).eqNullSafe(F.lag(column).over(w)) | (F.row_number().over(w) == 1)).cast("int"), F.lit(1))
    numbered = variants.withColumn("__new", new).withColumn("__run", F.sum("__new").over(w))
    got = numbered.groupBy(by, "__run").agg(F.min(order).alias("start"), F.max(order).alias("stop"), F.first(column).alias(column), F.count("*").alias("length"))
    return got.drop("__run")


def best(df: DataFrame, by: list[str], score: str, n: int = 1, *, largest: bool = True, ties: bool = False, then: str = "variant_idx") -> DataFrame:
    """The n best rows of each group; with ties all that equal the n-th, else the first ones by `then`. Null scores come last."""
    order = F.desc_nulls_last(score) if largest else F.asc_nulls_last(score)
    w = Window.partitionBy(*by)
    place = F.rank().over(w.orderBy(order)) if ties else F.row_number().over(w.orderBy(order, then))
    return df.withColumn("__place", place).where(F.col("__place") <= n).drop("__place")


def shared(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys that both have, once each."""
    return a.select(key).intersect(b.select(key))


def only(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys of a that b lacks, once each."""
    return a.select(key).subtract(b.select(key))
