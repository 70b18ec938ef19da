from pyspark.sql import functions as F

import corpus_pipeline
from freqforge.llm import jaccard, quality, secrets

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    frames = [docs]
    for _, stage in corpus_pipeline.STAGES:
        frames.append(stage(spark, frames[-1], SF).cache())
    assert all(f.columns == columns for f in frames[:-1])
    good, unique, clean, mixed, packed = frames[1:]
    model = quality.fit(docs, quality.training_labels(spark.read.parquet(f"{SF}/labels.parquet")))
    score = model.scorer()
    want = {r["doc_id"] for r in docs.collect() if score(r["text"])[0] >= quality.THRESHOLD}
    assert {r["doc_id"] for r in good.collect()} == want
    comp = {r["doc_id"]: r["component_id"] for r in jaccard.join(good).collect()}
    assert sorted(r["doc_id"] for r in unique.collect()) == sorted(set(comp.values()))
    assert clean.count() == unique.count() and not any(secrets.base_spans(r["text"]) for r in clean.collect())
    assert all(r["n_chars"] == len(r["text"]) for r in clean.collect())
    assert {r["doc_id"] for r in mixed.collect()} <= {r["doc_id"] for r in clean.collect()}
    assert packed.where("piece = 0").count() == mixed.count()


def test_odd(spark, odd, none, tmp_path):
    labels = spark.createDataFrame([(5, 1, 0), (6, 0, 0)], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    for docs in (odd, none):
        for name, stage in corpus_pipeline.STAGES:
            before, docs = docs, stage(spark, docs, str(tmp_path)).cache()
            n, m = before.count(), docs.count()
            if name != "best_fit_packing":
                assert docs.columns == before.columns and docs.dtypes == before.dtypes
            if name in ("quality_classifier", "ngram_jaccard_join"):
                assert m <= n and not docs.exceptAll(before).count()
            if name == "ngram_jaccard_join":  # what has no words stays, and one of those that are alike
                blank = F.coalesce(F.trim(F.translate("text", "\t\n", "  ")), F.lit("")) == ""
                assert before.where(blank).count() == docs.where(blank).count() and docs.where("text LIKE 'the quick%' AND text NOT LIKE '%today'").count() <= 1
            if name == "secret_scans":
                assert m == n
            if name == "mixing":
                assert m <= 2 * n and not docs.subtract(before).count()
        assert docs.where("piece = 0").count() == before.count()
