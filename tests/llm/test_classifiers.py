import random

from pyspark.sql import functions as F

from freqforge.llm import langid, quality


def word(rng, letters):
    return "".join(rng.choice(letters) for _ in range(rng.randint(2, 7)))


def corpus(spark, n=400):
    rng = random.Random(5)
    docs, labels = [], []
    for i in range(n):
        lang, letters = (("xx", "abcde"), ("yy", "vwxyz"))[i % 2]
        vocab = [word(random.Random(k), letters) for k in range(60)]
        bad = i % 4 == 0
        text = " ".join(rng.choice(vocab) + ("%%#" if bad else "") for _ in range(80))
        docs.append((i, text, lang))
        labels.append((i, int(not bad), 0))
    return spark.createDataFrame(docs, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_quality(spark, odd, none):
    docs, labels = corpus(spark)
    model = quality.fit(docs, quality.training_labels(labels))
    got = quality.with_score(docs, model).join(labels, "doc_id")
    held = got.where(F.pmod(quality.id_crc(F.col("doc_id")), F.lit(5)) == 0)
    right = held.agg(F.avg(((F.col("score") >= quality.THRESHOLD).cast("int") == F.col("quality")).cast("double"))).first()[0]
    assert right > 0.95
    out = quality.with_score(odd, model)
    assert out.count() == odd.count() and out.where("score < 0 OR score > 1 OR score IS NULL").count() == 0 and out.schema["score"].dataType.simpleString() == "double"
    assert not quality.with_score(none, model).collect()
    for few in (labels.limit(0), labels.where("quality = 1"), spark.createDataFrame([(None, 1), (3, None), (4, 7)], "doc_id long, quality int")):
        m = quality.fit(docs, few)
        assert 0 <= quality.with_score(odd, m).first()["score"] <= 1


def test_labels_that_differ(spark):
    docs, labels = corpus(spark, 40)
    assert quality.fit(docs, labels.unionByName(labels)).prior == quality.fit(docs, labels).prior


def test_language(spark, odd, none):
    docs, _ = corpus(spark)
    model = langid.fit(docs.where("doc_id % 4 <> 2"))
    got = langid.with_language(docs.where("doc_id % 4 = 2"), model)
    assert got.where("lang_pred <> lang").count() == 0
    out = langid.with_language(odd, model)
    by = {r["doc_id"]: r for r in out.collect()}
    assert out.count() == odd.count() and all(by[i]["lang_pred"] == "und" for i in (0, 1, 2, 11)) and all(by[i]["lang_pred"] in ("xx", "yy") for i in (3, 4, 5, 9, 10, 12))
    assert all(0 <= r["score"] <= 1 for r in by.values())
    assert not langid.with_language(none, model).collect() and langid.fit(none) == {}
    assert {r["lang_pred"] for r in langid.with_language(odd, {}).collect()} == {"und"}
    one = langid.with_language(odd, {"xx": b"abc"}).collect()
    assert {r["lang_pred"] for r in one} == {"xx", "und"}


def test_languages_of_long_texts_are_learned(spark, monkeypatch):
    """Long texts give slices, and rows without letters don't use up the sample."""
    monkeypatch.setattr(langid, "DICT_ROWS", 20)
    rng = random.Random(6)
    vocab = {x: [word(rng, x) for _ in range(60)] for x in ("abcde", "vwxyz")}
    text = lambda letters, n: " ".join(rng.choices(vocab[letters], k=n))
    rows = [(i, "1 " * 20_000 + text("abcde", 4000), "xx") for i in range(30)]
    rows += [(100 + i, text("vwxyz", 80), "yy") for i in range(30)] + [(1000 + i, "12 34", "yy") for i in range(3000)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert set(model) == {"xx", "yy"} and len(model["xx"]) > 16 * 1024 and len(model["yy"]) > 8 * 1024
    new = spark.createDataFrame([(1, text("abcde", 50)), (2, text("vwxyz", 50))], "doc_id long, text string")
    assert {r["doc_id"]: r["lang_pred"] for r in langid.with_language(new, model).collect()} == {1: "xx", 2: "yy"}


def test_letters_are_unicode_letters(spark):
    """Numerals and lone marks are no letters; vowel signs stay in their words."""
    choose = langid.chooser({"hi": "हिन्दी की किताबें".encode(), "xx": b"abc"})
    for t in ("½ ² ①", "Ⅷ ٣ 12", "\u0301 \u093f", "_ - 🙂", "", None):
        assert choose(t) == ("und", 0.0, True), t
    assert langid.letters("हिन्दी 1 ABC²é") == "हिन्दी abc é"
    assert choose("हिन्दी")[0] == "hi" and choose("ªbc")[0] in ("hi", "xx")


def test_the_sample_repeats(spark, monkeypatch):
    """Long texts are cut and not left out; of texts that share a doc_id the same one is taken every time."""
    docs, labels = corpus(spark, 60)
    more = docs.unionByName(docs.withColumn("text", F.concat(F.lit("also "), "text")))
    assert quality.fit(more, labels) == quality.fit(more.repartition(5).orderBy(F.desc("text")), labels)
    monkeypatch.setattr(quality, "SAMPLE_CHARS", 100)
    assert len(quality.fit(docs, labels).dicts) == 2
