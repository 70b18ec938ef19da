"""Best-fit packing of tokenized documents into sequences of at most `capacity` tokens.

Pieces of equal length are interchangeable, so the plan is made over the histogram of
lengths: at most `capacity` numbers, whatever the input. Lengths are gone through from the
longest; a gap is filled exactly by an available single length, a pair or a triple, found
in an index of length sums, as often as all of them are available. What remains goes
best-fit, longest first, into the tightest open gap. The plan, a few thousand patterns of
lengths with a number of copies each, is broadcast, and each piece finds its sequence
by its rank among the pieces of its length. Ranks are counted within (length, hash bucket)
and bucket counts are added, so a length that a third of all pieces have is no hot task.

Token ids are those of the tokenizer file (a byte-level BPE in the JSON format of
`tokenizers`). The encoder takes the file's vocabulary as merge ranks and remembers the ids
of every blank-separated chunk it has met, up to CACHE chunks; at a blank between two
other characters that aren't white space the pre-tokenizer always cuts. A document with
other white space beside a blank is encoded as a whole. As `tokenizers` does, the file's added tokens are found in a
text first, the leftmost and longest, and what is between them is encoded piece by piece.

Cases: null and empty texts are one end token; equal rows are packed one by one; an
empty table gives no rows; other columns of the input are ignored.
"""
from __future__ import annotations

import json
import re
import zlib
from array import array
from bisect import insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.ship import ship
from .common import read, table

CAPACITY = 2048
END = 0
CACHE = 300_000
ROWS_A_BUCKET = 1 << 12

# The pre-tokenizer pattern of the byte-level BPE.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_ranks(tokenizer: bytes) -> dict[bytes, int]:
    """Merge ranks by token bytes. A byte-level vocabulary writes printable Latin-1 bytes as
    themselves and the others as characters from U+0100 on, in order."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    back = {chr(b): b for b in shown} | {chr(0x100 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}
    spec = json.loads(tokenizer)
    special = added_tokens(tokenizer)
    return {bytes(back[c] for c in tok): i for tok, i in spec["model"]["vocab"].items() if tok not in special}


def added_tokens(tokenizer: bytes) -> dict[str, int]:
    """Ids of the file's added tokens. Ones that take the white space beside them, or stand for whole words only,
    aren't known here."""
    spec = json.loads(tokenizer).get("added_tokens") or []
    if any(t.get(x) for t in spec for x in ("single_word", "lstrip", "rstrip")):
        raise ValueError("added tokens with single_word, lstrip or rstrip")
    return {t["content"]: t["id"] for t in spec}


class _Whole(Exception):
    """The text can't be cut at its blanks."""


class Encoder(dict):
    """encode(text): the ids as little-endian unsigned 32-bit numbers. As a dict: ids of a chunk
    that follows a blank."""

    def __init__(self, tokenizer: bytes) -> None:
        import tiktoken

        super().__init__()
        self.added = {t: np.array([i], dtype="<u4").tobytes() for t, i in added_tokens(tokenizer).items()}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.bpe = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=byte_ranks(tokenizer), special_tokens={})

    def ids(self, text: str) -> bytes:
        return np.array(self.bpe.encode_ordinary(text), dtype="<u4").tobytes()

    def __missing__(self, chunk: str) -> bytes:
        if not chunk or chunk[0].isspace() or chunk[-1].isspace():
            raise _Whole
        got = self.ids(" " + chunk)
        if len(chunk) <= 64:
            self[chunk] = got
        return got

    def encode(self, text: str) -> bytes:
        if self.cut is None or not any(map(text.__contains__, self.added)):
            return self.plain(text)
        return b"".join(self.added.get(t) or self.plain(t) for t in self.cut.split(text))

    def plain(self, text: str) -> bytes:
        """ids of a text without added tokens."""
        chunks = text.split(" ")
        if len(chunks) == 1 or not chunks[0] or chunks[0][-1].isspace():
            return self.ids(text)
        if len(self) > CACHE:
            self.clear()
        try:
            return self.ids(chunks[0]) + b"".join(map(self.__getitem__, chunks[1:]))
        except _Whole:
            return self.ids(text)


_ENCODERS: dict[int, Encoder] = {}


def _encoder(tokenizer: bytes) -> Encoder:
    key = zlib.crc32(tokenizer)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(tokenizer)
    return _ENCODERS[key]


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: full ones, after a first that may be shorter."""
    first = n % capacity or min(n, capacity)
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def pieces(docs: DataFrame, tokenizer: bytes, *, capacity: int = CAPACITY, end: int = END, doc_id: str = "doc_id", text: str = "text", keep_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, with keep_ids, ids as little-endian bytes."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(tokenizer)  # a file of fixed size
    src = docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].alias("text"))
    schema = "doc_id long, piece int, start long, length int, ids_crc32 long" + ", ids binary" * keep_ids
    tail = np.array([end], dtype="<u4").tobytes()

    def run(batches):
        enc = _encoder(shared.value)
        for b in batches:
            cols = ([], array("i"), array("q"), array("i"), array("q"), [])
            for d, t in zip(b.column(0), b.column(1)):
                d = d.as_py()
                raw = enc.encode(t.as_py() or "") + tail
                for k, (s, n) in enumerate(cut(len(raw) // 4, capacity)):
                    part = raw[4 * s : 4 * (s + n)]
                    for c, v in zip(cols, (d, k, s, n, zlib.crc32(part), part if keep_ids else None)):
                        c.append(v)
            out = [pa.array(cols[0], pa.int64()), *(pa.array(np.asarray(c)) for c in cols[1:5])] + [pa.array(cols[5], pa.binary())] * keep_ids
            yield pa.RecordBatch.from_arrays(out, names=["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * keep_ids)

    return src.mapInArrow(run, schema)


class SumIndex:
    """Combinations of available lengths by their sum."""

    def __init__(self, avail: list[int]) -> None:
        self.avail = avail
        have = [n for n in range(1, len(avail)) if avail[n]]
        self.have = have[::-1]
        self.pairs: dict[int, array] = {}
        for a in have:
            for b in have:
                if b > a or a + b >= len(avail):
                    break
                self.pairs.setdefault(a + b, array("H")).append(a)  # the longer one; longest last

    def fits(self, *lengths: int) -> int:
        """How often these lengths are all available at once."""
        return min(self.avail[n] // lengths.count(n) for n in lengths)

    def single(self, gap: int, with_: int):
        return (gap,) if self.fits(with_, gap) else None

    def pair(self, gap: int, *with_: int):
        """The pair with the longest member; pairs that are used up are dropped from the index."""
        left = self.pairs.get(gap)
        while left:
            a = left[-1]
            if self.fits(a, gap - a):
                break
            left.pop()
        for a in reversed(left or ()):
            if self.fits(*with_, a, gap - a):
                return (a, gap - a)
        return None

    def triple(self, gap: int, with_: int):
        for a in self.have:
            if a < gap - 1 and self.avail[a]:
                got = self.pair(gap - a, with_, a)
                if got and got[0] <= a:
                    return (a, *got)
        return None


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths, copies) that use up counts[length] pieces of each length."""
    avail = [0] * (capacity + 1)
    for n, c in counts.items():
        avail[n] = c
    made: dict[tuple[int, ...], int] = {}

    def use(lengths: tuple[int, ...], copies: int) -> None:
        for n in lengths:
            avail[n] -= copies
        made[lengths] = made.get(lengths, 0) + copies

    if avail[capacity]:
        use((capacity,), avail[capacity])
    index = SumIndex(avail)
    for n in range(capacity - 1, 0, -1):
        while avail[n]:
            gap = capacity - n
            rest = index.single(gap, n) or index.pair(gap, n) or index.triple(gap, n)
            if not rest:
                break
            use((n, *rest), index.fits(n, *rest))
    opened: dict[int, dict[tuple[int, ...], int]] = {}
    gaps: list[int] = []
    for n in range(capacity, 0, -1):
        while avail[n]:
            fit = next((g for g in gaps if g >= n), None)
            if fit is None:
                per, gap, old = min(capacity // n, avail[n]), capacity, ()
                copies = avail[n] // per
                new = (n,) * per
            else:
                old, have = opened[fit].popitem()
                per = max(1, min(fit // n, avail[n] // have if have <= avail[n] else 1))
                copies, gap, new = min(have, avail[n] // per), fit, old + (n,) * per
                if have > copies:
                    opened[fit][old] = have - copies
                if not opened[fit]:
                    del opened[fit]
                    gaps.remove(fit)
            avail[n] -= copies * per
            left = gap - n * per
            if left:
                if left not in opened:
                    opened[left] = {}
                    insort(gaps, left)
                opened[left][new] = opened[left].get(new, 0) + copies
            else:
                made[new] = made.get(new, 0) + copies
    for group in opened.values():
        for lengths, copies in group.items():
            made[lengths] = made.get(lengths, 0) + copies
    return list(made.items())


def slots(patterns: list[tuple[tuple[int, ...], int]]) -> tuple[np.ndarray, ...]:
    """Sorted by (length, first rank): key = length << 40 | first rank, first sequence, offset."""
    upto: dict[int, int] = {}
    out, seq = [], 0
    for lengths, copies in patterns:
        at = 0
        for n in lengths:
            out.append((n << 40 | upto.get(n, 0), seq, at))
            upto[n] = upto.get(n, 0) + copies
            at += n
        seq += copies
    return tuple(np.array(x, dtype=np.int64) for x in zip(*sorted(out))) if out else (np.zeros(0, np.int64),) * 3


def pack(parts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to a table of pieces, which should be cheap to read again."""
    spark = parts.sparkSession
    counts = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.count("*").alias("n")).collect()}  # capacity rows at most
    shared = spark.sparkContext.broadcast(slots(plan(counts, capacity)))
    buckets = 16 + sum(counts.values()) // ROWS_A_BUCKET
    rows = parts.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)))
    sums = rows.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = sums.select("length", "bucket", (F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n")).alias("before"))
    rank = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")) - 1
    ranked = rows.withColumn("rn", rank).join(before, ["length", "bucket"]).select(*parts.columns, (F.col("before") + F.col("rn")).alias("rank"))
    names = [*parts.columns, "sequence_id", "offset"]

    def place(batches):
        key, seq, at = shared.value
        for b in batches:
            n, rank = (b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "rank"))
            want = n << 40 | rank
            i = np.searchsorted(key, want, side="right") - 1
            cols = [b.column(k) for k in range(len(names) - 2)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(seq[i] + (want - key[i])), pa.array(at[i])], names=names)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in parts.schema) + ", sequence_id long, offset long"
    return ranked.mapInArrow(place, schema)


def tokenizer_file(name: str = "byte_bpe_50k.json") -> bytes:
    import public_tokenizers

    with open(public_tokenizers.path(name), "rb") as f:
        return f.read()


def pack_documents(docs: DataFrame, tokenizer: bytes, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    return pack(table(pieces(docs, tokenizer, capacity=capacity, end=end), "pieces"), capacity)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = pack_documents(read(spark, sf_dir, "documents"), tokenizer_file())
    return got.select("doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "sequence_id", "offset")
