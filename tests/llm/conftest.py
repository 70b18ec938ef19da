import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, shard string, score string, key string"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows, clashing columns."""
    long = " ".join(f"word{i % 5003}" for i in range(60_000))
    base = "the quick brown fox jumps over the lazy dog and runs far away into the deep dark forest beyond the old stone bridge"
    texts = [None, "", " \t\n", "one", "Two words", base, base, base.upper(), base + " today", "été naïve " * 30, long, "123 456", "x" * 70_000, "a  b \n c   d e f"]
    rows = [(i, t, "en", None if i % 5 == 0 else f"s{i % 3}", len(t or ""), "x", "y", "z") for i, t in enumerate(texts)]
    rows += [rows[5], rows[5], (None, "no id here at all", None, None, 17, "x", "y", "z"), (99, base, None, "s1", None, None, None, None)]
    random.Random(0).shuffle(rows)
    return spark.createDataFrame(rows, DOCS).repartition(3).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)
