"""N-gram Jaccard join by vertical partitioning.

The global order of n-grams is (document frequency up to HOT, hash), rare ones first, and a shared n-gram is known by its
number in it. To count frequencies, the hash space is cut into fragments; to count overlaps, the global order is. A document's set is five-word shingle hashes; equal sets are one class, known by
a 64-bit key, and only classes are compared.

1. Map: texts become sets; each fragment gets its segments of many sets as one block: sorted
   48-bit hashes as differences, and who has them. An n-gram that HOT classes share within a block is
   not listed again and again: only the fact is sent, and its holders are told at once.
2. Fragment: frequencies of its n-grams, and to each class the ones it shares with another.
3. Home: what a class shares, from all fragments. With fewer shared n-grams than 75 % of its
   set a class has no partner. The others keep their shared n-grams, in the global order, and
   the prefix of it within which partners must meet.
4. Join: classes meet in the buckets of prefix n-grams. Small buckets give pairs, filtered by length and
   position; pairs' overlaps are counted in each fragment of the order, between its CUTS, and summed per pair. Classes of larger
   buckets are dealt to blocks, and blocks that share a bucket are compared in a task, again
   summing partial overlaps over fragments of the order; what leaves the task is each class's number of links, and as many
   links as the components need. So no bucket's pairs are written out, and none is left out or counted twice.
5. Links become components.

Cases: null texts and texts without words have no shingle and are linked with nothing, their own least
id; shorter texts than five words are one shingle; equal texts are one class, and linked; a null doc_id is
never the least one but where there is no other; an empty table gives no rows; ``join`` ignores other columns. ``keep_one``
leaves one row of each component, equal rows included, and every row without words; all columns stay.
"""
from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ship import ship
from .common import read, table
from .graph import component_ids, components, forest

WORDS = 5
PERCENT = 75
BITS = 48
FLUSH = 500_000
FRAGMENT = 1_500_000
WORDS_KEPT = 150_000
MIN_FRAGMENTS = 24
HOT = 64
SMALL = 8
BLOCK = 256
#: fragments of the global order in which pairs' overlaps are counted: half of the n-grams of two classes, the other half, ...
CUTS = (0, 2 << BITS | 1 << BITS - 1, 3 << BITS, 6 << BITS, HOT + 1 << BITS)
BYTES_A_WORD = 6

_U = np.uint64


class _Words(dict):
    """Hash of a word, remembered."""

    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


_words = _Words()


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()  # ASCII letters, ASCII white space
    if not w:
        return np.zeros(0, _U)
    if len(_words) > WORDS_KEPT:
        _words.clear()
    h = np.fromiter(map(_words.__getitem__, w), _U, len(w))
    k = min(words, len(w))
    n = len(w) - k + 1
    a = np.full(n, 0x9E3779B97F4A7C15 * k & (1 << 64) - 1, _U)
    for i in range(k):
        a = (a ^ h[i : i + n]) * _U(0xD6E8FEB86659FD93)
        a ^= a >> _U(32)
    a *= _U(0xD6E8FEB86659FD93)
    a ^= a >> _U(29)
    return np.unique(a)


def set_key(s: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(s.tobytes())


def _zip(*arrays: np.ndarray) -> list[bytes]:
    c = zstandard.ZstdCompressor(level=1)
    return [c.compress(np.ascontiguousarray(a).tobytes()) for a in arrays]


def _unzip(raw: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(raw, max_output_size=1 << 31), kind)


# Blocks between the stages: part tells where to go, kind what it is.
_BLOCK = "part int, kind int, a binary, b binary, c binary, d binary"
_SHARED, _TOLD, _DOCS = 0, 1, 2


def _segments(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted 48-bit numbers as differences, in planes of 16 bits."""
    d = np.diff(h, prepend=_U(0))
    return (d & _U(0xFFFF)).astype("<u2"), (d >> _U(16) & _U(0xFFFF)).astype("<u2"), (d >> _U(32)).astype("<u2")


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [[]] * 6
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.int32(), pa.int32()] + [pa.binary()] * 4)], names=["part", "kind", "a", "b", "c", "d"])


def _told(keys: np.ndarray, h: np.ndarray, freq: np.ndarray, homes: int):
    """(home, blocks) of shared n-grams for the classes that have them."""
    home = (keys % _U(homes)).astype(np.int64)
    o = np.lexsort((keys, home))
    keys, h, freq, home = keys[o], h[o], freq[o], home[o]
    cut = np.flatnonzero(np.r_[True, home[1:] != home[:-1]]) if len(home) else []
    for s, e in zip(cut, [*cut[1:], len(home)]):
        yield int(home[s]), _zip(keys[s:e].astype("<u8"), h[s:e].astype("<u8"), freq[s:e].astype("u1"))


def _map(fragments: int, homes: int):
    def flush(docs: list, sets: dict):
        rows = []
        ids = np.array([d[0] for d in docs], np.int64)
        known = np.array([d[1] for d in docs], bool)
        keys, sizes, own_rows = np.array([d[2] for d in docs], _U), np.array([d[3] for d in docs], np.int64), np.array([d[4] for d in docs], np.int64)
        home = (keys % _U(homes)).astype(np.int64)
        for p in np.unique(home):
            m = home == p
            rows.append((int(p) % fragments, _DOCS, int(p).to_bytes(8, "little"), *_zip(ids[m], np.packbits(known[m]), np.c_[keys[m].view(np.int64), sizes[m], own_rows[m]])))
        own = np.fromiter(sets, _U, len(sets))
        h = np.concatenate([*sets.values(), np.zeros(0, _U)]) >> _U(64 - BITS)
        who = np.repeat(np.arange(len(own)), [len(s) for s in sets.values()])
        o = np.argsort(h, kind="stable")
        h, who = h[o], who[o]
        start = np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if len(h) else np.zeros(0, np.int64)
        count = np.diff(np.r_[start, len(h)])
        hot = np.repeat(count >= HOT, count)
        hots = h[start][count >= HOT]
        for p, blocks in _told(own[who[hot]], h[hot], np.full(int(hot.sum()), HOT), homes):
            rows.append((p % fragments, _TOLD, int(p).to_bytes(8, "little"), *blocks))
        h, who = h[~hot], who[~hot]
        edge = [(f << BITS) // fragments for f in range(fragments + 1)]
        at, hat = np.searchsorted(h, np.array(edge, _U)), np.searchsorted(hots, np.array(edge, _U))
        for f in range(fragments):
            part, w, marks = h[at[f] : at[f + 1]], who[at[f] : at[f + 1]], hots[hat[f] : hat[f + 1]]
            if len(part) or len(marks):
                have = np.unique(w)
                low, mid, high = _zip(*_segments(part))
                name, idx, hot_h = _zip(own[have].astype("<u8"), np.searchsorted(have, w).astype("<u4" if len(have) > 65536 else "<u2"), marks.astype("<u8"))
                wide = b"\1" if len(have) > 65536 else b"\0"
                rows.append((f, _SHARED, name, len(low).to_bytes(4, "little") + len(mid).to_bytes(4, "little") + low + mid + high, wide + idx, hot_h))
        return _rows(rows)

    def run(batches):
        docs, sets, n = [], {}, 0
        for b in batches:
            for d, t, r in zip(b.column(0), b.column(1), b.column(2)):
                s = shingles(t.as_py())
                key = set_key(s) if len(s) else 0
                d = d.as_py()
                docs.append((d or 0, d is not None, key, len(s), r.as_py()))
                if len(s) and key not in sets:
                    sets[key] = s
                    n += len(s)
                if n >= FLUSH or len(docs) >= 200_000:
                    yield flush(docs, sets)
                    docs, sets, n = [], {}, 0
        if docs:
            yield flush(docs, sets)

    return run


def _fragment(homes: int):
    def run(table_: pa.Table) -> pa.Table:
        rows, hs, ks, marks = [], [], [], []
        for i in range(table_.num_rows):  # row by row: a list of all would hold each block twice
            kind, a, b, c, d = (table_.column(x)[i].as_py() for x in ("kind", "a", "b", "c", "d"))
            if kind != _SHARED:
                rows.append((int.from_bytes(a, "little"), kind, b"", b, c, d))
                continue
            n1, n2 = int.from_bytes(b[:4], "little"), int.from_bytes(b[4:8], "little")
            h = _unzip(b[8 + n1 + n2 :], "<u2").astype(_U)
            for plane in (b[8 + n1 : 8 + n1 + n2], b[8 : 8 + n1]):
                h <<= _U(16)
                h |= _unzip(plane, "<u2")
            hs.append(np.cumsum(h, dtype=_U, out=h))
            ks.append(_unzip(a, "<u8")[_unzip(c[1:], "<u4" if c[:1] == b"\1" else "<u2")])
            marks.append(_unzip(d, "<u8"))
        if hs:
            h, k = np.concatenate(hs), np.concatenate(ks)
            hs.clear()
            ks.clear()
            o = np.argsort(h)
            h, k = h[o], k[o]
            del o
            # n-grams of one holder are dropped before the holders are put in order
            more = np.zeros(len(h), bool)
            more[1:] = h[1:] == h[:-1]
            more[:-1] |= more[1:]
            more |= np.isin(h, np.concatenate(marks))
            h, k = h[more], k[more]
            del more
            o = np.lexsort((k, h))
            h, k = h[o], k[o]
            if len(h):
                new = np.r_[True, (h[1:] != h[:-1]) | (k[1:] != k[:-1])]
                h, k = h[new], k[new]
                start = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
                count = np.diff(np.r_[start, len(h)])
                hot = np.isin(h[start], np.concatenate(marks))
                freq = np.repeat(np.where(hot, HOT, np.minimum(count, HOT)), count)
                m = freq > 1
                rows += [(p, _TOLD, b"", *blocks) for p, blocks in _told(k[m], h[m], freq[m], homes)]
        return pa.Table.from_batches([_rows(rows)])

    return run


def least_overlap(n: int, m: int) -> int:
    """Least intersection of sets of n and m that are PERCENT / 100 alike."""
    return -(-PERCENT * (n + m) // (100 + PERCENT))


_HOME = "doc_id long, row long, key long, n int, grams array<long>, prefix int"


def _home(table_: pa.Table) -> pa.Table:
    ids, docs, tk, tg = [], [], [], []
    for kind, b, c, d in zip(*(table_.column(x).to_pylist() for x in ("kind", "b", "c", "d"))):
        if kind == _DOCS:
            i = _unzip(b, "<i8")
            known = np.unpackbits(_unzip(c, "u1"), count=len(i)).astype(bool)
            ids += [x if y else None for x, y in zip(i.tolist(), known)]
            docs.append(_unzip(d, "<i8").reshape(-1, 3))
        else:
            tk.append(_unzip(b, "<u8"))
            tg.append(_unzip(d, "u1").astype(_U) << _U(BITS) | _unzip(c, "<u8"))
    key, n, row = np.concatenate([*docs, np.zeros((0, 3), np.int64)]).T
    k, g = (np.concatenate([*x, np.zeros(0, _U)]) for x in (tk, tg))
    o = np.lexsort((g, k))
    k, g = k[o].view(np.int64), g[o].view(np.int64)
    if len(k):  # the hot ones may have been told more than once for copies in several blocks
        new = np.r_[True, (k[1:] != k[:-1]) | (g[1:] != g[:-1])]
        k, g = k[new], g[new]
    uniq, first = np.unique(key, return_index=True)
    size = dict(zip(uniq.tolist(), n[first].tolist()))
    out: list[list] = [ids, row.tolist(), key.tolist(), n.tolist(), [None] * len(ids), [None] * len(ids)]
    start = np.flatnonzero(np.r_[True, k[1:] != k[:-1]]) if len(k) else []
    for s, e in zip(start, [*start[1:], len(k)]):
        who = int(k[s])
        m = size[who]
        # m - (e - s) n-grams, which come first in the order, are nobody else's
        prefix = m - -(-PERCENT * m // 100) + 1 - (m - (e - s))
        if prefix > 0:
            for col, v in zip(out, (None, None, who, m, g[s:e].tolist(), prefix)):
                col.append(v)
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.int32()]
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], names=["doc_id", "row", "key", "n", "grams", "prefix"])


def row_hash(docs: DataFrame, doc_id: str, text: str) -> Column:
    return F.xxhash64(docs[doc_id].cast("long"), docs[text])


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A table of documents (grams null; row tells rows of one doc_id apart) and of the classes that may have partners."""
    ship(docs.sparkSession)
    src = docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].alias("text"), row_hash(docs, doc_id, text).alias("row"))
    size = src.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    fragments = max(MIN_FRAGMENTS, math.ceil(size / BYTES_A_WORD / FRAGMENT))
    cut = src.mapInArrow(_map(fragments, fragments), _BLOCK)
    told = cut.groupBy("part").applyInArrow(_fragment(fragments), _BLOCK)
    return table(told.groupBy("part").applyInArrow(_home, _HOME), "classes")


def _compare_blocks(batches):
    """Rows of two blocks (lists of key, n, copies, grams) -> (u, v) links, as many as their components need, and
    (u, null, c): documents of the other block that u is linked with."""
    for batch in batches:
        us, vs, cs = [], [], []
        for left, right, same in zip(batch.column(0), batch.column(1), batch.column(2)):
            left, right, same = left.values, right.values, same.as_py()
            keys, n, copies = ([x.field(c).to_numpy().astype(np.int64) for x in (left, right)] for c in ("key", "n", "copies"))
            grams = [left.field("grams"), right.field("grams")]
            lens = [np.diff(g.offsets.to_numpy()) for g in grams]
            h = [g.flatten().to_numpy() for g in grams]
            both = np.intersect1d(h[0], h[1])
            overlap = np.zeros((len(left), len(right)), np.float32)
            owners = [np.repeat(np.arange(len(x)), x) for x in lens]
            for at in range(0, len(both), 4096):  # fragments of the order; partial overlaps are summed
                f = both[at : at + 4096]
                m = []
                for side in (0, 1):
                    i = np.searchsorted(f, h[side])
                    ok = (i < len(f)) & (f[np.minimum(i, len(f) - 1)] == h[side])
                    one = np.zeros((len(lens[side]), len(f)), np.float32)
                    one[owners[side][ok], i[ok]] = 1
                    m.append(one)
                overlap += m[0] @ m[1].T
            inter = np.rint(overlap).astype(np.int64)
            union = n[0][:, None] + n[1][None, :] - inter
            near = (100 * inter >= PERCENT * union) & (keys[0][:, None] != keys[1][None, :])
            a, b = np.nonzero(near)
            every = keys[0] if same else np.concatenate(keys)
            low = forest(len(every), a, b if same else b + len(left))
            m = np.flatnonzero(low != np.arange(len(every)))
            us += every[m].tolist()
            vs += every[low[m]].tolist()
            cs += [0] * len(m)
            count = near @ copies[1] if same else np.r_[near @ copies[1], copies[0] @ near]
            m = np.flatnonzero(count)
            us += every[m].tolist()
            vs += [None] * len(m)
            cs += count[m].tolist()
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (us, vs, cs)], names=["u", "v", "c"])


def links(found: DataFrame, copies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links (u, v) between classes, as many as their components need at least; and (key, c): with how many documents
    of other classes a class is linked. copies: key, copies."""
    sets = found.where("grams IS NOT NULL").select("key", "n", "grams", "prefix")
    entries = table(sets.select("key", "n", F.posexplode(F.slice("grams", 1, F.col("prefix"))).alias("at", "gram"), (F.col("n") - F.size("grams")).alias("own")), "prefixes")
    counts = entries.groupBy("gram").agg(F.count("*").alias("c")).where("c > 1")
    met = entries.join(counts, "gram")
    # larger buckets: a class goes with its largest bucket, in blocks of about BLOCK
    large = table(met.where(F.col("c") > SMALL).select("gram", "key", "c"), "buckets")
    led = table(large.groupBy("key").agg(F.max(F.struct("c", "gram")).alias("lead")).select("key", F.col("lead.gram").alias("lead")), "leads")
    dealt = led.join(led.groupBy("lead").agg(F.ceil(F.count("*") / BLOCK).alias("parts")), "lead")
    dealt = table(dealt.select("key", F.xxhash64("lead", F.pmod(F.xxhash64("key"), F.col("parts"))).alias("block")), "dealt")
    touch = table(large.join(dealt, "key").select("gram", "block").distinct(), "touch")
    meet = table(touch.join(touch.withColumnRenamed("block", "block2"), "gram").where("block <= block2").select("block", "block2").distinct(), "meet")
    blocks = table(sets.join(dealt, "key").join(copies, "key").groupBy("block").agg(F.collect_list(F.struct("key", "n", "copies", "grams")).alias("docs")), "blocks")  # about BLOCK at most
    many = meet.join(blocks.select("block", F.col("docs").alias("l")), "block").join(blocks.select(F.col("block").alias("block2"), F.col("docs").alias("r")), "block2")
    many = table(many.select("l", "r", (F.col("block") == F.col("block2")).alias("same")).mapInArrow(_compare_blocks, "u long, v long, c long"), "compared")
    # small buckets: pairs, each in the order of keys, but for those whose blocks meet
    group = met.where(F.col("c") <= SMALL).groupBy("gram").agg(F.sort_array(F.collect_list(F.struct("key", "n", (F.col("own") + F.col("at")).alias("at")))).alias("g"))  # SMALL at most
    pair = F.flatten(F.transform("g", lambda x, i: F.transform(F.slice(F.col("g"), i + 2, F.size("g")), lambda y: F.struct(x.alias("x"), y.alias("y")))))
    pairs = group.select(F.inline(pair)).select(F.col("x.key").alias("u"), F.col("y.key").alias("v"), F.col("x.n").alias("n"), F.col("y.n").alias("m"), F.col("x.at").alias("i"), F.col("y.at").alias("j"))
    need = F.ceil(PERCENT * (F.col("n") + F.col("m")) / (100 + PERCENT))
    pairs = pairs.where((F.least("n", "m") * 100 >= F.greatest("n", "m") * PERCENT) & (1 + F.least(F.col("n") - F.col("i"), F.col("m") - F.col("j")) - 1 >= need))
    pairs = pairs.select("u", "v", "n", "m").distinct()
    places = [dealt.select(F.col("key").alias(x), F.col("block").alias(f"{x}_block")) for x in "uv"]
    pairs = pairs.join(places[0], "u", "left").join(places[1], "v", "left")
    pairs = pairs.join(meet, (F.least("u_block", "v_block") == F.col("block")) & (F.greatest("u_block", "v_block") == F.col("block2")) & F.col("u_block").isNotNull() & F.col("v_block").isNotNull(), "left_anti")
    within = lambda a, b: F.filter("grams", lambda x: (x >= F.lit(a).cast("long")) & (x < F.lit(b).cast("long")))
    fragment = F.array(*map(within, CUTS, CUTS[1:]))
    parts = sets.select("key", F.posexplode(fragment).alias("f", "seg"))
    a, b = parts.select(F.col("key").alias("u"), "f", F.col("seg").alias("s")), parts.select(F.col("key").alias("v"), "f", F.col("seg").alias("t"))
    partial = pairs.join(a, "u").join(b, ["v", "f"]).select("u", "v", "n", "m", F.size(F.array_intersect("s", "t")).alias("o"))
    summed = partial.groupBy("u", "v", "n", "m").agg(F.sum("o").alias("o"))
    few = table(summed.where(100 * F.col("o") >= PERCENT * (F.col("n") + F.col("m") - F.col("o"))).select("u", "v"), "pairs")
    met_few = few.unionByName(few.select(F.col("v").alias("u"), F.col("u").alias("v"))).join(copies, F.col("v") == F.col("key")).select(F.col("u").alias("key"), F.col("copies").alias("c"))
    counted = met_few.unionByName(many.where("v IS NULL").select(F.col("u").alias("key"), "c")).groupBy("key").agg(F.sum("c").alias("c"))
    return few.unionByName(many.where("v IS NOT NULL").select("u", "v")), counted


def assigned(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, row, n_shingles, n_links, component_id, component; a row per row of docs. component: a key, null without shingles."""
    found = classes(docs, doc_id, text)
    rows = found.where("grams IS NULL").select("doc_id", "row", "key", F.col("n").cast("long").alias("n_shingles"))
    sets = table(rows.where("n_shingles > 0").groupBy("key").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies")), "sets")
    edges, counted = links(found, sets.select("key", "copies"))
    root = table(components(edges), "roots")
    ids = component_ids(root, sets.select(F.col("key").alias("node"), "least")).withColumnRenamed("node", "key")
    told = sets.join(ids, "key").join(counted, "key", "left").join(root.withColumnRenamed("node", "key"), "key", "left")
    told = table(told.select("key", (F.col("copies") - 1 + F.coalesce("c", F.lit(0))).alias("n_links"), "component_id", F.coalesce("root", "key").alias("component")), "told")
    columns = ["doc_id", "row", "n_shingles", "n_links", "component_id", "component"]
    none = rows.where("n_shingles = 0").withColumns({"n_links": F.lit(0).cast("long"), "component_id": F.col("doc_id"), "component": F.lit(None).cast("long")})
    return rows.where("n_shingles > 0").join(told, "key").select(*columns).unionByName(none.select(*columns))


def join(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, and n_links: with how many other rows a row is linked; a row per row of docs."""
    return assigned(docs, doc_id, text).select("doc_id", "n_shingles", "component_id", "n_links")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one row of each component: the one with the least doc_id, nulls last."""
    rows = table(assigned(docs, doc_id, text).where("component IS NOT NULL").select("component", F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row").alias("at")), "rows")
    best = table(rows.groupBy("component").agg(F.min("at").alias("best"), F.count("*").alias("n")).where("n > 1"), "best")
    members = rows.join(best, "component")
    gone = members.where("at.row <> best.row").select(F.col("at.row").alias("__row")).distinct()
    again = table(members.where("at.row = best.row").groupBy(F.col("at.row").alias("__row")).count().where("count > 1").select("__row"), "again")
    marked = docs.withColumn("__row", row_hash(docs, doc_id, text))
    kept = marked.join(gone, "__row", "left_anti")
    if not again.isEmpty():  # rows that are equal in doc_id and text
        whole = F.struct(*docs.columns)
        one = kept.join(again, "__row").groupBy("__row").agg(F.min_by(whole, F.xxhash64(*docs.columns)).alias("one"))
        kept = kept.join(again, "__row", "left_anti").select(*docs.columns).unionByName(one.select("one.*"))
    return kept.select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(read(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i+4], ' ') END AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT u, v FROM o JOIN n p ON p.doc_id = u JOIN n q ON q.doc_id = v WHERE 100 * o >= 75 * (p.n + q.n - o)),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT l.v, r.c FROM r JOIN l ON l.u = r.doc_id WHERE r.c < l.v),
k AS (SELECT u AS doc_id, count(*) AS k FROM l GROUP BY u)
SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.c) AS component_id, coalesce(any_value(k.k), 0) AS n_links
FROM documents d JOIN r ON r.doc_id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN k ON k.doc_id = d.doc_id GROUP BY d.doc_id
"""
