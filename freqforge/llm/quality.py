"""Compression classifier of text quality.

Two zstandard dictionaries are trained, on good and on bad labelled text. A text is
compressed with both; the size difference over the larger size, and the density (the smaller
size over the text's bytes: endless repetition compresses like nothing else), go through a
logistic calibration fitted on labelled texts that are not in the dictionaries.

The sample is bounded: DICT_ROWS rows a class and CALIBRATE_ROWS rows, in the order of a hash of
doc_id, SAMPLE_BYTES bytes a class, the first SAMPLE_CHARS characters of a longer text. Only it reaches
the driver; every document is scored whole.

Cases: null is an empty text, and that has a score like any other; with a class
missing from the labels the score is the share of label 1 (0.5 without labels); where
labels of one doc_id differ the lower one holds, and where texts do the one with the least hash is learned from; equal rows get equal scores; an empty table
gives no rows; other columns go along, one that is named `score` gives way.
"""
from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read
from .zdict import BLOCK, add_columns, id_crc, id_order, sizer

THRESHOLD = 0.3
FOLDS, HELD_OUT = 5, 0
DICT_ROWS = 1500
CALIBRATE_ROWS = 2000
SAMPLE_BYTES = 16 << 20
SAMPLE_CHARS = SAMPLE_BYTES // 256  # of four bytes at most
DICT_BYTES = 1 << 17
#: COVER parameters: segment and d-mer length
SEGMENT, DMER = 200, 8


@dataclass
class Model:
    prior: float = 0.5
    dicts: tuple[bytes, ...] = ()
    mean: tuple[float, ...] = ()
    scale: tuple[float, ...] = ()
    weights: tuple[float, ...] = field(default=())

    def features(self):
        bad, good = (sizer(d, raw=False) for d in self.dicts)

        def of(text: str | None) -> tuple[float, float, float]:
            t = (text or "").encode()
            a, b = bad(t), good(t)
            density = float(np.log((min(a, b) + 4) / (len(t) + 8)))
            return 10 * (a - b) / max(a, b), density, density * density

        return of

    def scorer(self):
        if not self.weights:
            return lambda text: (self.prior,)
        of, (w0, *w) = self.features(), self.weights
        per = [(m, k / s) for m, s, k in zip(self.mean, self.scale, w)]

        def score(text: str | None) -> tuple[float]:
            u = w0 + sum((x - m) * k for x, (m, k) in zip(of(text), per))
            return (float(1 / (1 + np.exp(-min(30.0, max(-30.0, u))))),)

        return score


def _dictionary(texts: list[str]) -> bytes:
    parts = [t[i : i + BLOCK] for t in (t.encode() for t in texts) for i in range(0, len(t), BLOCK)]
    try:
        return zstandard.train_dictionary(DICT_BYTES, parts, k=SEGMENT, d=DMER).as_bytes()
    except zstandard.ZstdError:  # too few samples: their bytes are the dictionary
        return b"".join(parts)[:DICT_BYTES]


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    mean, scale = x.mean(0), x.std(0) + 1e-9
    a = np.c_[np.ones(len(x)), (x - mean) / scale]
    w = np.zeros(a.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        w += np.linalg.solve((a.T * (p * (1 - p))) @ a + 0.5 * np.eye(len(w)), a.T @ (y - p) - 0.5 * w)
    return mean, scale, w


def fit(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", label: str = "quality") -> Model:
    """labels: doc_id and a label of 0 or 1; only rows to learn from."""
    lab = labels.where(F.col(label).isin(0, 1) & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("id")).agg(F.min(label).cast("int").alias("y"))
    lab = lab.withColumn("h", id_order(F.col("id")))
    share = lab.agg(F.avg("y")).first()[0]
    if share is None or share in (0, 1):
        return Model(0.5 if share is None else float(share))
    takes = [lab.where(F.col("h") < "5").orderBy("h", "id").limit(CALIBRATE_ROWS).withColumn("part", F.lit(2))]
    takes += [lab.where((F.col("h") >= "5") & (F.col("y") == c)).orderBy("h", "id").limit(DICT_ROWS).withColumn("part", F.lit(c)) for c in (0, 1)]
    picked = takes[0].unionByName(takes[1]).unionByName(takes[2])  # CALIBRATE_ROWS + 2 * DICT_ROWS rows at most
    rows = docs.select(docs[doc_id].alias("id"), docs[text].alias("t")).where(F.col("t").isNotNull())
    rows = rows.select("id", F.xxhash64("t").alias("k"), F.left("t", F.lit(SAMPLE_CHARS)).alias("t"))
    got = rows.join(F.broadcast(picked), "id").groupBy("id", "y", "h", "part").agg(F.min(F.struct("k", "t")).alias("s"))
    got = got.select("id", "y", "h", "part", F.col("s.t").alias("t"), F.octet_length("s.t").alias("n")).collect()
    got.sort(key=lambda r: (r["h"], r["id"]))
    texts: list[list[str]] = [[], [], []]
    used, y = [0, 0, 0], []
    seen = {r["t"] for r in got if r["part"] < 2}
    for r in got:
        k = r["part"]
        if used[k] + r["n"] > SAMPLE_BYTES or k == 2 and r["t"] in seen:
            continue
        used[k] += r["n"]
        texts[k].append(r["t"])
        if k == 2:
            y.append(r["y"])
    if not texts[0] or not texts[1] or len(set(y)) < 2:
        return Model(float(share))
    model = Model(float(share), (_dictionary(texts[0]), _dictionary(texts[1])))
    mean, scale, w = _logistic(np.array([*map(model.features(), texts[2])]), np.array(y, float))
    model.mean, model.scale, model.weights = tuple(map(float, mean)), tuple(map(float, scale)), tuple(map(float, w))
    return model


def with_score(docs: DataFrame, model: Model, text: str = "text", score: str = "score") -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(model)  # two dictionaries of DICT_BYTES
    return add_columns(docs, text, f"{score} double", [pa.float64()], lambda: shared.value.scorer())


def kept(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs that aren't rejected, their columns as they are, one that is named `score` too."""
    name, taken = "score", {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return with_score(docs, model, text, name).where(F.col(name) >= THRESHOLD).select(*docs.columns)


def training_labels(labels: DataFrame) -> DataFrame:
    return labels.where(F.pmod(id_crc(labels["doc_id"]), F.lit(FOLDS)) != HELD_OUT)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    model = fit(docs, training_labels(labels))
    got = with_score(docs.select("doc_id", "text"), model)
    held = F.pmod(id_crc(F.col("doc_id")), F.lit(FOLDS)) == HELD_OUT
    return got.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
