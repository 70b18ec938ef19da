"""Embedding near-duplicates by sorted projection passes.

Equal vectors of a label are one class. Labels of up to SMALL classes are compared in full. In the larger ones each pass
sorts the classes by (label, length, signature), a signature being the signs of random projections in
the pass's own order, and compares each with the WINDOW that follow; what is verified in any pass is
united. Vectors are centred on the mean of their label before they are projected, so a direction that all share takes no
bit of a signature.

How many passes are enough isn't guessed: SAMPLE classes are compared with all of their label, and passes are added, as
many again each time, until of their links no more than a share of 1 - TARGET lies between components. Labels that still miss
some after MAX_PASSES are compared in full, block against block, so dense labels cost time and no links.

A link only exists within a component, so once components are known their members are compared
with each other in full, block against block: every vector's links are counted exactly, windows notwithstanding, and
no pair leaves a task. Block i meets the blocks after it, going round, so all blocks have as many partners.

Cases: vectors that are null, zero, or hold null or non-finite components, and vectors of a null label,
link with nothing; vectors of unequal length don't either; equal rows count as one vector, each with
the result; labels may be of any type that can be hashed; an empty table gives no rows; other columns are ignored.
"""
from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import drop, read, table
from .graph import component_ids, components, forest

THRESHOLD = 0.98
WINDOW = 512
SMALL = 256
BITS = 48
CATCH = 0.95
TARGET = 0.999
SAMPLE = 1024
MAX_PASSES = 48
BLOCK = 512
MEANS_BYTES = 32 << 20
SEED = 20240


def passes(largest: int, threshold: float, window: int = WINDOW) -> int:
    """Passes after which a pair at the threshold has been neighbours once, with probability CATCH, where a label's vectors
    point everywhere."""
    bits = max(1.0, math.log2(max(2, largest) / window) + 1)
    one = (1 - math.acos(threshold) / math.pi) ** bits
    return max(2, math.ceil(math.log(1 - CATCH) / math.log(1 - one)))


def _planes(k: int, dim: int) -> np.ndarray:
    return np.random.default_rng([SEED, k, dim]).standard_normal((dim, BITS))


def _matrix(vecs: pa.ListArray, rows: np.ndarray, dim: int) -> np.ndarray:
    """Unit vectors of some rows, all of one length, in double precision."""
    flat = vecs.flatten().to_numpy().astype(np.float64)
    start = vecs.offsets.to_numpy()[:-1] - vecs.offsets[0].as_py()
    x = flat[start[rows][:, None] + np.arange(dim)]
    x /= np.abs(x).max(1)[:, None]
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def _by_dim(b: pa.RecordBatch):
    """(rows, dim, unit vectors) of a batch with columns dim and vec."""
    dims = b.column("dim").to_numpy()
    for dim in np.unique(dims):
        rows = np.flatnonzero(dims == dim)
        yield rows, int(dim), _matrix(b.column("vec"), rows, int(dim))


def _sums(batches):
    """Rows (label, dim, vec) -> label, dim, n and the sum of its unit vectors, for each batch."""
    for b in batches:
        label = b.column("label").to_numpy()
        out = [[], [], [], []]
        for rows, dim, x in _by_dim(b):
            names, at = np.unique(label[rows], return_inverse=True)
            total = np.zeros((len(names), dim))
            np.add.at(total, at, x)
            for col, v in zip(out, (names.tolist(), [dim] * len(names), np.bincount(at).tolist(), total.tolist())):
                col.extend(v)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.float64())))], names=["label", "dim", "n", "total"])


def _signed(first: int, last: int):
    """Rows (cls, label, dim, vec, mean) -> a row for each pass, with the signature."""

    def run(batches):
        weights = 1 << np.arange(BITS - 1, -1, -1, dtype=np.int64)
        for b in batches:
            for rows, dim, x in _by_dim(b):
                part = b.take(pa.array(rows))
                mean = part.column("mean")
                x = x - mean.flatten().to_numpy().reshape(len(rows), dim)
                for k in range(first, last):
                    sig = ((x @ _planes(k, dim) > 0) * weights).sum(1)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), k, np.int32)), *(part.column(c) for c in ("label", "dim")), pa.array(sig), part.column("cls"), part.column("vec")], names=["pass", "label", "dim", "sig", "cls", "vec"])

    return run


def _pairs(x: np.ndarray, group: np.ndarray, threshold: float, window: int, old: int):
    """Indices of links between rows up to window apart, the later one not among the first old rows."""
    for i in range(0, len(x), window):
        j = max(i, old)
        c = x[i : i + window] @ x[j : i + 2 * window].T
        a, b = np.nonzero(c >= threshold)
        a, b = a + i, b + j
        ok = (b > a) & (b - a <= window) & (group[a] == group[b])
        yield a[ok], b[ok]


def _windows(threshold: float, window: int):
    """Sorted rows -> links (u, v), as many as the components in a batch need."""

    def run(batches):
        held, old = None, 0
        for b in batches:
            t = pa.Table.from_batches([b])
            t = (t if held is None else pa.concat_tables([held, t])).combine_chunks()
            if t.num_rows == 0:
                continue
            held = t.slice(max(0, t.num_rows - window))
            b, cls = t.to_batches()[0], t.column("cls").to_numpy()
            same = np.ones(len(cls), bool)
            for c in ("pass", "label", "dim"):
                v = t.column(c).to_numpy()
                same[1:] &= v[1:] == v[:-1]
            group = np.cumsum(~same)
            us, vs = [], []
            for rows, _, x in _by_dim(b):
                for p, q in _pairs(x, group[rows], threshold, window, int((rows < old).sum())):
                    us.append(rows[p])
                    vs.append(rows[q])
            cat = lambda x: np.concatenate([*x, np.zeros(0, np.int64)])
            low = forest(len(cls), cat(us), cat(vs))
            m = low != np.arange(len(cls))
            old = held.num_rows
            yield pa.RecordBatch.from_arrays([pa.array(cls[m]), pa.array(cls[low[m]])], names=["u", "v"])

    return run


def _block_pairs(batches, threshold: float):
    """Rows of two blocks (lists of cls, n, vec) -> cls, n of both sides, and which are near."""
    for b in batches:
        for left, right, same in zip(b.column(0), b.column(1), b.column(2)):
            sides = []
            for s in (left.values, right.values):
                v = s.field("vec")
                dim = len(v[0])
                sides.append((s.field("cls").to_numpy(), s.field("n").to_numpy().astype(np.int64), _matrix(v, np.arange(len(s)), dim)))
            (lc, ln, lx), (rc, rn, rx) = sides
            yield lc, ln, rc, rn, (lx @ rx.T >= threshold) & (lc[:, None] != rc[None, :]), same.as_py()


def _counted(threshold: float):
    """Rows of two blocks -> (cls, links): a class's links to the other block."""

    def run(batches):
        for lc, ln, rc, rn, near, same in _block_pairs(batches, threshold):
            ids, counts = (lc, near @ rn) if same else (np.r_[lc, rc], np.r_[near @ rn, ln @ near])
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(counts)], names=["cls", "links"])

    return run


def _united(threshold: float):
    """Rows of two blocks -> links (u, v), as many as their components need."""

    def run(batches):
        for lc, _, rc, _, near, _ in _block_pairs(batches, threshold):
            a, b = np.nonzero(near)
            cls = np.r_[lc, rc]
            low = forest(len(cls), a, b + len(lc))
            m = low != np.arange(len(cls))
            yield pa.RecordBatch.from_arrays([pa.array(cls[m]), pa.array(cls[low[m]])], names=["u", "v"])

    return run


def block_pairs(members: DataFrame, key: list[str]) -> DataFrame:
    """members: key, cls, n, vec, size (of the key) -> l, r, same: each two blocks of a key once, and each block with itself."""
    dealt = members.withColumn("parts", F.ceil(F.col("size") / BLOCK).cast("int")).withColumn("block", F.pmod(F.xxhash64("cls"), F.col("parts")).cast("int"))
    blocks = table(dealt.groupBy(*key, "parts", "block").agg(F.collect_list(F.struct("cls", "n", "vec")).alias("docs")), "vec-blocks")  # about BLOCK
    half = F.floor(F.col("parts") / 2).cast("int")
    far = F.when((F.col("parts") % 2 == 0) & (F.col("block") >= half), half - 1).otherwise(half)
    left = blocks.select(*key, "block", F.col("docs").alias("l"), F.explode(F.transform(F.sequence(F.lit(0), far), lambda d: (F.col("block") + d) % F.col("parts"))).alias("other"))
    right = blocks.select(*key, F.col("block").alias("other"), F.col("docs").alias("r"))
    return left.join(right, [*key, "other"]).select("l", "r", (F.col("block") == F.col("other")).alias("same"))


def _probe(queries):
    """Rows (cls, label, dim, vec, root) -> for each query the roots of what is near it, with counts."""

    def run(batches):
        names, labels, dims, vecs, threshold = queries.value
        for b in batches:
            cls, label, root = (b.column(c).to_numpy() for c in ("cls", "label", "root"))
            out = [[], [], [], []]
            for rows, dim, x in _by_dim(b):
                mine = np.flatnonzero(dims == dim)
                if not len(mine):
                    continue
                q = np.array([vecs[i] for i in mine], np.float64)
                for lab in np.intersect1d(label[rows], labels[mine]):
                    r, m = rows[label[rows] == lab], mine[labels[mine] == lab]
                    at, who = np.nonzero(x[label[rows] == lab] @ q[labels[mine] == lab].T >= threshold)
                    found = np.c_[m[who], root[r[at]]]
                    uniq, back, count = np.unique(found, axis=0, return_inverse=True, return_counts=True)
                    own = np.zeros(len(uniq), np.int64)
                    np.maximum.at(own, back.reshape(-1), cls[r[at]] == names[m[who]])
                    for col, v in zip(out, (uniq[:, 0], uniq[:, 1], count, own)):
                        col.append(v)
            cat = lambda x: pa.array(np.concatenate([*x, np.zeros(0, np.int64)]))
            yield pa.RecordBatch.from_arrays([cat(c) for c in out], names=["q", "root", "c", "own"])

    return run


def _sample(large: DataFrame, threshold: float, rows: int = SAMPLE):
    """rows classes at most, by hash: names, labels, lengths, unit vectors."""
    got = large.select("cls", "label", "dim", "vec").orderBy(F.xxhash64("cls", F.lit(SEED)), "cls").limit(rows).collect()
    unit = lambda v: _matrix(pa.array([v], pa.list_(pa.float64())), np.arange(1), len(v))[0]
    return np.array([r["cls"] for r in got]), np.array([r["label"] for r in got]), np.array([r["dim"] for r in got]), [unit(r["vec"]) for r in got], threshold


def recall(large: DataFrame, root: DataFrame, sample) -> tuple[float, list[int]]:
    """Share of the sampled classes' links that lie within components, and the labels that miss some."""
    placed = large.join(root.withColumnRenamed("node", "cls"), "cls", "left").select("cls", "label", "dim", "vec", F.coalesce("root", "cls").alias("root"))
    shared = large.sparkSession.sparkContext.broadcast(sample)
    near = placed.mapInArrow(_probe(shared), "q long, root long, c long, own long").groupBy("q", "root").agg(F.sum("c").alias("c"), F.max("own").alias("own"))
    got = near.groupBy("q").agg(F.sum("c").alias("all"), F.sum(F.col("c") * F.col("own")).alias("found")).collect()  # SAMPLE rows at most
    links, found = (sum(r[c] - 1 for r in got) for c in ("all", "found"))
    missing = sorted({int(sample[1][r["q"]]) for r in got if r["found"] < r["all"]})
    return (found / links if links else 1.0), missing


def _centred(large: DataFrame) -> DataFrame:
    """large with the mean of the unit vectors of each label and length."""
    part = large.select("label", "dim", "vec").mapInArrow(_sums, "label long, dim int, n long, total array<double>")
    each = part.select("label", "dim", "n", F.posexplode("total").alias("pos", "x")).groupBy("label", "dim", "pos").agg((F.sum("x") / F.sum("n")).alias("x"))
    means = table(each.groupBy("label", "dim").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("mean")), "vec-means")  # as many as the vector is long
    size = means.agg(F.sum(F.size("mean") * F.lit(8).cast("long"))).first()[0] or 0
    return large.join(F.broadcast(means) if size <= MEANS_BYTES else means, ["label", "dim"])


def _linked(sets: DataFrame, threshold: float, window: int) -> DataFrame:
    """cls, root of the classes that have links."""
    kinds = table(sets.groupBy("label", "dim").agg(F.count("*").alias("size")), "vec-labels")
    least, largest = kinds.agg(F.min("size"), F.max("size")).first()
    members = sets.join(kinds, ["label", "dim"])
    found = sets.sparkSession.createDataFrame([], "u long, v long")
    if least is not None and least <= SMALL:
        found = block_pairs(members.where(F.col("size") <= SMALL), ["label", "dim"]).mapInArrow(_united(threshold), "u long, v long")
    if (largest or 0) <= SMALL:
        return components(found)
    large = table(members.where(F.col("size") > SMALL).select("cls", "label", "dim", "vec", "n", "size"), "vec-large")
    centred = _centred(large)
    sample = _sample(large, threshold)
    done, more = 0, passes(largest, threshold, window)
    while True:
        signed = centred.select("cls", "label", "dim", "vec", "mean").mapInArrow(_signed(done, done + more), _schema("pass int, label long, dim int, sig long, cls long", sets))
        ordered = signed.repartitionByRange("pass", "label", "dim", "sig", "cls").sortWithinPartitions("pass", "label", "dim", "sig", "cls")
        root = table(components(found.unionByName(ordered.mapInArrow(_windows(threshold, window), "u long, v long"))), "vec-roots")
        done += more
        share, missing = recall(large, root, sample)
        found = root.select(F.col("node").alias("u"), F.col("root").alias("v"))
        if share >= TARGET:
            break
        if done >= MAX_PASSES:
            rest = large.where(F.col("label").isin(missing))
            return components(found.unionByName(block_pairs(rest, ["label", "dim"]).mapInArrow(_united(threshold), "u long, v long")))
        more = done
    drop(large)
    return root


def _schema(head: str, sets: DataFrame) -> T.StructType:
    return T.StructType([*T.StructType.fromDDL(head).fields, T.StructField("vec", sets.schema["vec"].dataType)])


def _good(vec: Column) -> Column:
    return (F.size(vec) > 0) & F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(vec, lambda x: x != 0)


def near_dups(vectors: DataFrame, *, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", threshold: float = THRESHOLD, window: int = WINDOW) -> DataFrame:
    """vec_id, n_links, component_id, kept; a row per row of vectors."""
    kind = vectors.schema[embedding].dataType
    single = isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType)  # stays as it is and is read as doubles
    v = vectors.select(vectors[vec_id].cast("long").alias("vec_id"), vectors[label].alias("label"), (vectors[embedding] if single else vectors[embedding].cast("array<double>")).alias("vec"))
    v = v.withColumn("cls", F.when(F.coalesce(F.col("label").isNotNull() & _good(F.col("vec")), F.lit(False)), F.xxhash64("label", "vec")))
    rows = table(v.select("vec_id", "cls"), "vec-rows")
    counts = rows.where("cls IS NOT NULL").distinct().groupBy("cls").agg(F.count("*").alias("n"), F.min("vec_id").alias("least"))
    firsts = v.where("cls IS NOT NULL").groupBy("cls").agg(F.first(F.xxhash64("label")).alias("label"), F.first("vec").alias("vec"))
    sets = table(firsts.join(counts, "cls").withColumn("dim", F.size("vec")), "vec-classes")
    member = table(_linked(sets, threshold, window).withColumnRenamed("node", "cls"), "vec-components")
    # every pair within a component, block against block
    sizes = table(member.groupBy("root").agg(F.count("*").alias("size")), "vec-sizes")
    links = block_pairs(sets.join(member.join(sizes, "root"), "cls").select("root", "cls", "n", "vec", "size"), ["root"]).mapInArrow(_counted(threshold), "cls long, links long")
    links = links.groupBy("cls").agg(F.sum("links").alias("links"))
    ids = component_ids(member.withColumnRenamed("cls", "node"), sets.select(F.col("cls").alias("node"), "least")).withColumnRenamed("node", "cls")
    told = sets.select("cls", "n").join(ids, "cls").join(links, "cls", "left").select("cls", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id")
    got = rows.where("cls IS NOT NULL").join(told, "cls").select("vec_id", "n_links", "component_id")
    got = got.unionByName(rows.where("cls IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))
    return got.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dups(read(spark, sf_dir, "embeddings"))


ORACLE_SQL = f"""
WITH RECURSIVE e AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0 AND len(list_filter(embedding, lambda y: y <> 0)) > 0),
l AS (SELECT a.vec_id AS u, b.vec_id AS v FROM e a JOIN e b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x)
      WHERE list_dot_product(a.x, b.x) / (sqrt(list_dot_product(a.x, a.x)) * sqrt(list_dot_product(b.x, b.x))) >= {THRESHOLD}e0),
r(vec_id, c) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT l.v, r.c FROM r JOIN l ON l.u = r.vec_id WHERE r.c < l.v),
c AS (SELECT vec_id, min(c) AS component_id FROM r GROUP BY vec_id),
n AS (SELECT u AS vec_id, count(*) AS n_links FROM l GROUP BY u)
SELECT c.vec_id, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links, component_id, c.vec_id = component_id AS kept FROM c LEFT JOIN n ON n.vec_id = c.vec_id
"""
