import hashlib
import random
import re

import xxhash
from pyspark.sql import functions as F

from freqforge.llm import fingerprint as fp
from freqforge.llm import licenses


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def sketch(text, k=fp.K):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", (text or "").lower()) if x]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in w]

    def chain(part):
        seed = 42
        for x in part:
            seed = xxhash.xxh64_intdigest(x.to_bytes(8, "little"), seed)
        return signed(seed) >> 16

    s = {chain(h[i : i + 5]) for i in range(len(h) - 4)} if len(h) >= 5 else {chain(h)} if h else set()
    return sorted(s)[:k]


def test_sketch_is_the_brute_force_one(odd):
    for r in odd.select("text", fp.sketch(F.col("text")).alias("s")).collect():
        assert r["s"] == sketch(r["text"])


def test_estimates(spark):
    rng = random.Random(2)
    rows = []
    for _ in range(30):
        a = [str(rng.randint(0, 10**9)) for _ in range(600)]
        n = rng.randint(0, 600)
        b = a[:n] + [str(rng.randint(0, 10**9)) for _ in range(300)]
        rows.append((" ".join(a), " ".join(b)))
    df = spark.createDataFrame(rows, "a string, b string").select("a", "b", fp.sketch(F.col("a")).alias("x"), fp.sketch(F.col("b")).alias("y"))
    got = df.select("a", "b", fp.resemblance(F.col("x"), F.col("y")).alias("j"), fp.containment(F.col("x"), F.col("y")).alias("c"), fp.distinct_count(F.col("x")).alias("n"), fp.merged(F.col("x"), F.col("y")).alias("m")).collect()
    for r in got:
        s = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (r["a"].split(), r["b"].split())]
        assert abs(r["j"] - len(s[0] & s[1]) / len(s[0] | s[1])) < 0.2
        assert abs(r["c"] - len(s[0] & s[1]) / len(s[0])) < 0.3 and abs(r["n"] - 596) < 250
        assert r["m"] == sorted(set(sketch(r["a"], 10**6)) | set(sketch(r["b"], 10**6)))[: fp.K]
    parts = spark.createDataFrame([(1, "a b c d e f g"), (1, "c d e f g h i"), (2, "x")], "k int, t string").select("k", fp.sketch(F.col("t")).alias("sketch"))
    assert {r["k"]: len(r["sketch"]) for r in fp.merge_parts(parts, "k").collect()} == {1: 5, 2: 1}


def test_next_documents(spark, odd, none):
    assert not fp.with_next(none).collect()
    ids = [i * i for i in range(300)]
    df = spark.createDataFrame([(i, f"text {i}") for i in ids], "doc_id long, text string").repartition(5)
    try:
        fp.ROWS_A_RANGE, old = 16, fp.ROWS_A_RANGE
        fp.ranges.__defaults__ = (16,)
        got = {r["doc_id"]: r["next_text"] for r in fp.with_next(df).collect()}
    finally:
        fp.ROWS_A_RANGE = old
        fp.ranges.__defaults__ = (old,)
    assert got == {i: f"text {j}" for i, j in zip(ids, ids[1:] + ids[:1])}
    assert fp.with_next(odd).count() == odd.count()
    one = fp.with_next(spark.createDataFrame([(4, "alone")], "doc_id long, text string")).first()
    assert one["next_text"] == "alone"


def test_query(spark, tmp_path):
    rows = [(1, "ab cd ef gh"), (2, ""), (5, "naïve été 🙂🙂 abc"), (7, None), (9, "x")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r for r in fp.query(spark, str(tmp_path)).collect()}
    for (i, t), (_, u) in zip(rows, rows[1:] + rows[:1]):
        t, u = t or "", u or ""
        q = len(t) // 4
        e = t[: len(t) - q] + u[:q]
        assert got[i]["n_chars"] == len(t) and got[i]["edited_sha256"] == hashlib.sha256(e.encode()).hexdigest()
        assert 0 <= got[i]["near_edited"] <= 1 and (got[i]["fingerprint"] == got[i]["edited_fingerprint"]) == (sketch(t) == sketch(e))


def brute_license(text):
    w = [x for x in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if x]
    at = [(i, x) for p, x in licenses.PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    return len(w), len(at), min((i for i, _ in at), default=None), max((i for i, _ in at), default=None), ",".join(sorted({x for _, x in at}))


def test_licenses(spark, odd, none):
    assert not licenses.scan(none).collect()
    rng = random.Random(3)
    bits = ["gnu", "General", "public", "LICENSE", "apache", "license", "cc", "by", "mit", "été", "x1", "mit license", "GNU general public license", "cc-by", "\n", "--"]
    rows = [(i, " ".join(rng.choice(bits) for _ in range(rng.randint(0, 60)))) for i in range(150)] + [(7, "mit license")] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in licenses.scan(df).collect())
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(got, key=key) == sorted(((i, *brute_license(t)) for i, t in rows), key=key)
    out = licenses.scan(odd).collect()
    assert len(out) == odd.count() and all(0 <= r["score"] <= 1 for r in out)


def test_notices(spark):
    bsd = licenses.NOTICES["bsd"][0]
    changed = bsd.replace("forms with or without", "forms, also with, or without")
    texts = [(1, "foo " + changed + " bar"), (2, " ".join(bsd.split()[::2])), (3, "Licensed under CC BY-NC 4.0.")]
    got = {r["doc_id"]: r for r in licenses.scan(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert got[1]["labels"] == "bsd" and got[2]["labels"] == "" and got[3]["labels"] == "cc-by,cc-by-nc"
    assert got[1]["spans"][0]["start"] == 1


def test_kin_are_told_apart(spark):
    """Each notice's own sentence gives its label, and none that another one's sentence resembles."""
    texts = [(x, k, s.replace("*", "")) for x, ss in licenses.NOTICES.items() for k, s in enumerate(ss)]
    df = spark.createDataFrame([(i, "so " + t.upper() + " then") for i, (_, _, t) in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: set(r["labels"].split(",")) for r in licenses.scan(df).collect()}
    own = {"gpl", "apache", "cc-by", "mit"}
    for i, (label, _, _) in enumerate(texts):
        assert got[i] - own - ({"cc-by-nc"} if label.startswith("cc-by-nc-") else set()) == {label}, (label, got[i])
