"""Best-fit-decreasing sharding.

Groups of equal texts are indivisible. A group of at least 1/ITEMS of all bytes is an item
of its own; smaller ones share ITEMS hash cells, each an item as well, so the driver sees
at most 2 * ITEMS items whatever the input. With a fixed capacity an item is a group of at least 1/FINE
of it, cells are so many that they hold about as much, and a cell above capacity is taken apart
into its groups: the driver then sees some 2 * FINE items a shard. Sorted by size, each item enters the shard
with the tightest remaining capacity that holds it, found in a balanced tree (a treap).

``pack(items, capacity)`` minimises shards of a fixed capacity; ``balance(items, n)`` looks for
the smallest capacity at which n shards are enough, which makes their sizes near equal. An
item above the fair share of what is left gets a shard for itself.

Cases: null and empty text have size 1, crc32 0 and are equal texts; equal rows all get
slots; an empty table gives no rows; other columns of the input are ignored.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read, table

ITEMS = 1 << 14
FINE = 16
ROWS_A_BUCKET = 1 << 14


class Treap:
    """Ordered multiset of (remaining capacity, bin)."""

    __slots__ = ("root", "state")

    def __init__(self) -> None:
        self.root, self.state = None, 1

    def _split(self, t, key):
        if t is None:
            return None, None
        if t[0] < key:
            t[3], right = self._split(t[3], key)
            return t, right
        left, t[2] = self._split(t[2], key)
        return left, t

    def _merge(self, a, b):
        if a is None or b is None:
            return a or b
        if a[1] > b[1]:
            a[3] = self._merge(a[3], b)
            return a
        b[2] = self._merge(a, b[2])
        return b

    def add(self, key) -> None:
        self.state = self.state * 6364136223846793005 + 1442695040888963407 & (1 << 64) - 1
        left, right = self._split(self.root, key)
        self.root = self._merge(self._merge(left, [key, self.state >> 20, None, None]), right)

    def pop_at_least(self, size):
        """Take out the smallest key whose capacity is at least size; None if there is none."""
        left, right = self._split(self.root, (size, -1))
        if right is None:
            self.root = left
            return None
        parent, t = None, right
        while t[2] is not None:
            parent, t = t, t[2]
        if parent is None:
            right = t[3]
        else:
            parent[2] = t[3]
        self.root = self._merge(left, right)
        return t[0]


def pack(sizes: list[int], capacity: int, most: int | None = None) -> list[int] | None:
    """Bin of each of the sizes, which come in decreasing order; a size above capacity has
    a bin of its own. None as soon as more than `most` bins are needed."""
    tree, bins, out = Treap(), 0, []
    for size in sizes:
        got = tree.pop_at_least(size)
        if got is None:
            got, bins = (max(capacity, size), bins), bins + 1
            if most is not None and bins > most:
                return None
        out.append(got[1])
        tree.add((got[0] - size, got[1]))
    return out


def balance(sizes: list[int], n: int, steps: int = 12) -> list[int]:
    """Bins 0..n-1 for sizes in decreasing order, their sums near equal."""
    alone = 0
    left, total = n, sum(sizes)
    while alone < len(sizes) and left > 1 and sizes[alone] * left >= total:
        total -= sizes[alone]
        alone, left = alone + 1, left - 1
    rest = sizes[alone:]
    if not rest:
        return list(range(alone))
    low = max(-(-total // left), rest[0])
    best = pack(rest, low, left)
    high = low
    while best is None:
        low, high = high + 1, high + max(1, high // 64)
        best = pack(rest, high, left)
    for _ in range(steps):
        if high - low <= low // 10_000:
            break
        mid = (low + high) // 2
        got = pack(rest, mid, left)
        if got is None:
            low = mid + 1
        else:
            best, high = got, mid
    return [*range(alone), *(alone + b for b in best)]


def shard(docs: DataFrame, n_shards: int = 16, *, capacity: int | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, shard, slot. With capacity, as few shards as best-fit-decreasing
    needs of that many bytes, which only a single group can exceed, else n_shards of near equal size."""
    spark = docs.sparkSession
    t = F.coalesce(docs[text], F.lit(""))
    rows = table(docs.select(docs[doc_id].alias("doc_id"), (F.octet_length(t) + 1).cast("long").alias("size"), F.crc32(t.cast("binary")).alias("text_crc32"), F.xxhash64(t).alias("grp")), "shard-rows")
    groups = rows.groupBy("grp").agg(F.sum("size").alias("size"))
    total, count = rows.agg(F.sum("size"), F.count("*")).first()
    least, n_cells = -(-(total or 0) // ITEMS), ITEMS
    if capacity:
        least, n_cells = min(least, -(-capacity // FINE)), max(ITEMS, -(-FINE * (total or 0) // capacity))
    cell = F.pmod("grp", F.lit(n_cells))
    own = F.col("size") >= least
    if capacity:
        small = groups.where(~own).groupBy(cell.alias("cell")).agg(F.sum("size").alias("in_cell"))
        over = small.where(F.col("in_cell") > capacity).select("cell", F.lit(True).alias("over"))
        groups = groups.withColumn("cell", cell).join(over, "cell", "left")
        own = own | F.coalesce("over", F.lit(False))
    items = groups.groupBy(own.alias("own"), F.when(own, F.col("grp")).otherwise(cell).alias("item")).agg(F.sum("size").alias("size"))
    got = sorted(items.collect(), key=lambda r: (-r["size"], r["own"], r["item"]))  # at most 2 * ITEMS, with capacity some 2 * FINE a shard
    sizes = [r["size"] for r in got]
    bins = pack(sizes, capacity) if capacity else balance(sizes, n_shards)
    maps = {own: spark.createDataFrame([(r["item"], b) for r, b in zip(got, bins) if r["own"] == own], "item long, b int") for own in (True, False)}
    own = F.broadcast(maps[True].select(F.col("item").alias("grp"), F.col("b").alias("own_shard")))
    cells = F.broadcast(maps[False].select(F.col("item").alias("cell"), F.col("b").alias("cell_shard")))
    placed = rows.withColumn("cell", cell).join(own, "grp", "left").join(cells, "cell", "left")
    buckets = max(1, (count or 0) // (ROWS_A_BUCKET * max(1, len(set(bins)))))
    placed = placed.select("doc_id", "size", "text_crc32", F.coalesce("own_shard", "cell_shard").alias("shard"), F.pmod(F.xxhash64("doc_id", "grp"), F.lit(buckets)).alias("bucket"))
    return with_slot(placed)


def with_slot(placed: DataFrame) -> DataFrame:
    """slot: a gapless number from 0 within each shard; rows are numbered within (shard, bucket)
    and the buckets' counts are added up, so no shard has to meet in one task."""
    key = ["shard", "bucket"]
    counts = placed.groupBy(*key).agg(F.count("*").alias("n"))
    before = counts.select(*key, (F.sum("n").over(Window.partitionBy("shard").orderBy("bucket")) - F.col("n")).alias("before"))
    numbered = placed.withColumn("rn", F.row_number().over(Window.partitionBy(*key).orderBy("doc_id", "text_crc32", "size")) - 1)
    return numbered.join(before, key).select("doc_id", "size", "text_crc32", "shard", (F.col("before") + F.col("rn")).alias("slot"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = shard(read(spark, sf_dir, "documents"), 16)
    return got.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
