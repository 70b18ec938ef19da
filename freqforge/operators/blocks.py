"""Greedy linkage blocks.

Variants are scanned in file order within a chromosome; a block is closed when the distance to its first
variant reaches the block size, and the next one starts there. The start moves with the data, so this is
a scan over a chromosome's positions in a grouped map, not a window.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BASE_PAIRS = 100
FALLBACK_BP = 2_000_000.0


def assign_blocks(variant: DataFrame, blgsize: float = 0.05, position: str | None = None) -> DataFrame:
    """variant with block, numbered from 1 in the order of chromosomes and positions. blgsize of 100 and more is in
    base pairs. Without a genetic map 2 Mb, without any position a block a chromosome."""
    if position is None:
        maps = variant.agg(F.count_distinct("cm").alias("cm"), F.count_distinct("pos").alias("pos")).first()
        position = "pos" if blgsize >= BASE_PAIRS else "cm"
        if position == "cm" and maps["cm"] < 2:
            position, blgsize = ("pos", FALLBACK_BP) if maps["pos"] > 2 else (None, 1.0)
    at = F.col(position).cast("double") if position else F.lit(0.0)
    scanned = variant.select("chr", "variant_idx", at.alias("at")).groupBy("chr").applyInArrow(_scan(float(blgsize)), "chr string, variant_idx long, k int, first long, n int")
    # a row a chromosome in this window
    tops = scanned.select("chr", "first", "n").distinct()
    before = F.coalesce(F.sum("n").over(Window.orderBy("first").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    tops = tops.select(F.col("first").alias("top"), before.alias("before"))
    return scanned.join(tops, F.col("first") == F.col("top")).select("variant_idx", (F.col("before") + F.col("k")).cast("int").alias("block")).join(variant, "variant_idx")


STEP = 4096


def block_starts(at: np.ndarray, size: float) -> list[int]:
    """Indices at which blocks start; a missing position starts one of its own and the next one, too."""
    out, i, n = [], 0, len(at)
    while i < n:
        out.append(i)
        j, upto = i + 1, at[i] + size
        while j < n and not np.isnan(upto):
            hit = np.flatnonzero(at[j : j + STEP] >= upto)
            if len(hit):
                j += int(hit[0])
                break
            j += STEP
        i = min(j, n)
    return out


def _scan(size: float):
    """A chromosome's variants -> chr, variant_idx, number of the block in the chromosome, first variant, number of blocks."""

    def run(t: pa.Table) -> pa.Table:
        idx, at = t.column("variant_idx").to_numpy(), t.column("at").to_numpy(zero_copy_only=False).astype(float)
        o = np.argsort(idx, kind="stable")
        starts = block_starts(at[o], size)
        mark = np.zeros(len(o), np.int32)
        mark[starts] = 1
        one = lambda v, kind: pa.array(np.full(len(o), v), kind)
        chr_ = pa.array([t.column("chr")[0].as_py()] * len(o), pa.string())
        return pa.table([chr_, pa.array(idx[o], pa.int64()), pa.array(np.cumsum(mark), pa.int32()), one(idx.min(), pa.int64()), one(len(starts), pa.int32())], names=["chr", "variant_idx", "k", "first", "n"])

    return run


def block_lengths(blocks: DataFrame) -> DataFrame:
    """block, n_snps."""
    return blocks.groupBy("block").agg(F.count("*").alias("n_snps"))
