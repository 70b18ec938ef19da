"""Document fingerprints: bottom-k sketches of five-word shingle hashes, in DataFrame functions only.

A sketch is the sorted array of the K smallest distinct 48-bit hashes of a text's shingles (five
words, lower-cased; the whole sequence if it has fewer). Sketches of parts merge into the
sketch of the whole, and tell resemblance, containment and the number of distinct shingles.
The printed fingerprint is the base64 of the hashes, six bytes each, so equal texts have equal ones.

The query pairs each document with the next doc_id. Ranges of doc_id are windows of their own, cut
at sampled ids, into RANGES at most, so what the driver learns of the ids has a bound; the first document of a range also appears, as a ghost, at the end of the range
before, so no window spans the table and text is shuffled once.

Cases: null is an empty text; an empty text has an empty sketch, alike (1.0) to another empty one and unlike (0.0)
the rest; a null doc_id comes first; documents of one doc_id follow each other in the order of their
text's hash; a single document is its own next; an empty table gives no rows; other columns are ignored.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import let, read

K = 128
WORDS = 5
ROWS_A_RANGE = 2048
RANGES = 1 << 13


def sketch(text: Column, k: int = K, words: int = WORDS) -> Column:
    """Sorted array<bigint> of the k smallest hashes."""
    split = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]+"), lambda w: w != "")

    def shingles(h: Column) -> Column:
        n = F.size(h)
        long = F.transform(F.sequence(F.lit(0), F.greatest(n - words, F.lit(0))), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(words)]))
        return F.when(n >= words, long).when(n > 0, F.array(F.xxhash64(h))).otherwise(F.array().cast("array<bigint>"))

    hashes = let(F.transform(split, lambda w: F.xxhash64(w)), shingles)
    return bottom(F.transform(hashes, lambda x: F.shiftright(x, 16)), k)


def bottom(hashes: Column, k: int = K) -> Column:
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)


def merged(a: Column, b: Column, k: int = K) -> Column:
    """Sketch of the union of two sets."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def merge_parts(parts: DataFrame, key: str, sketch_col: str = "sketch", k: int = K, salt: int = 64) -> DataFrame:
    """key and the sketch of all its parts; parts are merged within (key, salt) first."""
    some = parts.groupBy(key, F.pmod(F.xxhash64(sketch_col), F.lit(salt)).alias("salt")).agg(bottom(F.flatten(F.collect_set(sketch_col)), k).alias("s"))
    return some.groupBy(key).agg(bottom(F.flatten(F.collect_set("s")), k).alias(sketch_col))


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard similarity; exact while both sketches hold their whole set."""

    def of(u: Column) -> Column:
        whole = (F.size(a) < k) & (F.size(b) < k)
        low = F.when(whole, u).otherwise(F.slice(F.sort_array(u), 1, k))
        shared = F.size(F.array_intersect(low, F.array_intersect(a, b))).cast("double")
        return F.when(F.size(u) == 0, 1.0).otherwise(shared / F.greatest(F.size(low), F.lit(1)))

    return let(F.array_union(a, b), of)


def distinct_count(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles; exact below k."""
    top = (F.element_at(a, -1) + (1 << 47)).cast("double") / float(1 << 48)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / top)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has too."""
    j = resemblance(a, b, k)
    shared = j / (1 + j) * (distinct_count(a, k) + distinct_count(b, k))
    return F.when(F.size(a) == 0, 1.0).otherwise(F.least(F.lit(1.0), shared / F.greatest(distinct_count(a, k), F.lit(1.0))))


def printed(a: Column) -> Column:
    digits = F.transform(a, lambda x: F.lpad(F.hex(x.bitwiseAND((1 << 48) - 1)), 12, "0"))
    return F.base64(F.unhex(F.array_join(digits, "")))


def ranges(docs: DataFrame, key: str, rows: int = ROWS_A_RANGE) -> list:
    """Ids that open a range, ascending; the least id is the first."""
    n = docs.count()
    parts = min(RANGES, max(1, n // rows))
    cuts = [i / parts for i in range(1, parts)]
    least, got = docs.agg(F.min(key), F.percentile_approx(key, cuts or [0.5], max(10_000, 10 * parts))).first()
    return sorted({least, *(got or [] if cuts else [])} - {None})


def range_of(key: Column, opens: list) -> Column:
    """Index of the range that holds key: a search in two steps, among blocks and in the block."""
    size = max(1, round(len(opens) ** 0.5))
    blocks = [opens[i : i + size] for i in range(0, len(opens), size)]
    literal = F.array(*[F.array(*map(F.lit, b)) for b in blocks])
    block = F.greatest(F.size(F.filter(F.array(*[F.lit(b[0]) for b in blocks]), lambda x: x <= key)) - 1, F.lit(0))
    return (block * size + F.greatest(F.size(F.filter(F.get(literal, block), lambda x: x <= key)) - 1, F.lit(0))).cast("int")


def with_next(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, text, sketch and next_text, next_sketch of the document that follows."""
    rows = docs.select(docs[doc_id].cast("long").alias("doc_id"), F.coalesce(docs[text], F.lit("")).alias("text"))
    rows = rows.withColumn("key", F.coalesce("doc_id", F.lit(-(1 << 63))))
    opens = ranges(rows.select("key"), "key")
    if not opens:
        opens = [0]
    own = range_of(F.col("key"), opens)
    before = F.pmod(F.col("own") - 1, F.lit(len(opens)))
    opener = F.get(F.array(*map(F.lit, opens)), F.col("own")) == F.col("key")
    places = F.when(opener, F.array(F.struct(F.col("own").alias("range"), F.lit(0).alias("ghost")), F.struct(before.alias("range"), F.lit(1).alias("ghost")))).otherwise(F.array(F.struct(F.col("own").alias("range"), F.lit(0).alias("ghost"))))
    dealt = rows.withColumn("own", own).select("doc_id", "key", "text", F.inline(places)).repartition("range").withColumn("sketch", sketch(F.col("text")))
    w = Window.partitionBy("range").orderBy("ghost", "key", F.xxhash64("text"), "text")
    return dealt.select("doc_id", "text", "sketch", "ghost", F.lead("text").over(w).alias("next_text"), F.lead("sketch").over(w).alias("next_sketch")).where("ghost = 0")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_next(read(spark, sf_dir, "documents"))
    n = F.char_length("text")
    quarter = F.floor(n / 4).cast("int")
    edited = F.concat(F.left("text", n - quarter), F.left("next_text", quarter))
    rows = rows.select("doc_id", "sketch", "next_sketch", n.cast("long").alias("n_chars"), edited.alias("edited"))
    rows = rows.withColumn("edited_sketch", sketch(F.col("edited")))
    return rows.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), printed(F.col("sketch")).alias("fingerprint"), printed(F.col("edited_sketch")).alias("edited_fingerprint"), resemblance(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"), resemblance(F.col("sketch"), F.col("next_sketch")).alias("near_next"))
