"""License scans by diagonal voting, in DataFrame functions only.

The words' rolling 2-gram hashes of a text are joined to the positions of the templates' 2-grams;
at the join the words themselves are compared, so every vote is verified. A 2-gram whose hash no template has is dropped
before, so what is joined is a row a hit and not a row a word. Votes are counted by
diagonal (position in the text less position in the template). A phrase stands where its
diagonal has a vote for each of its 2-grams. For the longer notices neighbouring diagonals, a few words
apart, are merged, which bridges changed words; a notice is found where the votes cover
enough of its 2-grams, and those that end in a marked word, which tells it from its kin. 2-grams of two function words
aren't looked for in notices.

One pass reads the text: each document adds a sentinel gram, which joins to a sentinel position, so
that documents without a vote stay. The template table has a few hundred rows and is broadcast.

Cases: null is an empty text, without words, places and labels, score 0; equal rows each get
their result; texts are scanned whole; an empty table gives no rows; other columns are ignored.
"""
from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import let, read

# Phrases and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
SPLIT = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# Sentences of public licence notices, and labels of our own. *: the 2-gram that ends here must be there.
NOTICES = {
    "agpl": ["this program is free software you can redistribute it and or modify it under the terms of the gnu *affero general public license as published by the free software foundation"],
    "apache-2.0": ["licensed under the apache license version 2 0", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0"],
    "artistic-2.0": ["this is free software licensed under the *artistic license 2 0"],
    "boost": ["permission is hereby granted free of charge to any person or *organization obtaining a copy of the software and accompanying documentation covered by this license"],
    "bsd": ["redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"],
    "bsd-3-clause": ["neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"],
    "cc-by-nc": ["licensed under cc by *nc 4 0", "creative commons attribution *noncommercial 4 0 international license"],
    "cc-by-nc-nd": ["licensed under cc by nc *nd 4 0", "creative commons attribution noncommercial *noderivatives 4 0 international license"],
    "cc-by-nc-sa": ["licensed under cc by nc *sa 4 0", "creative commons attribution noncommercial *sharealike 4 0 international license"],
    "cc-by-nd": ["licensed under cc by *nd 4 0", "creative commons attribution *noderivatives 4 0 international license"],
    "cc-by-sa": ["licensed under cc by *sa 4 0", "creative commons attribution *sharealike 4 0 international license"],
    "cc0": ["to the extent possible under law the author s have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide", "cc0 1 0 *universal public domain dedication"],
    "cddl": ["the contents of this file are subject to the terms of the common *development and distribution license"],
    "epl-2.0": ["this program and the accompanying materials are made available under the terms of the *eclipse public license 2 0"],
    "eupl": ["licensed under the *eupl version 1 2 or as soon they will be approved by the european commission subsequent versions of the eupl"],
    "gfdl": ["permission is granted to copy distribute and or modify this document under the terms of the gnu free *documentation license"],
    "gpl-3.0": ["licensed under the gnu general public license version 3", "this program is free software you can redistribute it and or modify it under the terms of the gnu *general public license as published by the free software foundation"],
    "isc": ["permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"],
    "lgpl": ["this library is free software you can redistribute it and or modify it under the terms of the gnu *lesser general public license as published by the free software foundation"],
    "mit-notice": ["released under the mit license", "permission is hereby granted free of charge to any person *obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"],
    "mpl-2.0": ["this source code form is subject to the terms of the mozilla public license v 2 0"],
    "ofl": ["this font software is licensed under the sil open *font license version 1 1"],
    "unlicense": ["this is free and unencumbered software released into the public domain"],
    "wtfpl": ["everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed"],
    "zlib": ["this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software"],
}
FUNCTION_WORDS = frozenset("a an and any are as at be by can for from in is it of on or that the this to under with you".split())

#: diagonals up to so many words apart are one passage; share of a notice's 2-grams that must be there
REACH = 3
COVER = 0.7
SENTINEL = 0


def templates(spark: SparkSession, phrases: dict[str, str] = PHRASES, notices: dict[str, list[str]] = NOTICES) -> DataFrame:
    """gram, tid, tpos, w1, w2, grams (how many are looked for), must (positions that have to be there), label, phrase."""
    rows, tid = [], 0
    for text, label, phrase in [*((t, x, True) for t, x in phrases.items()), *((t, x, False) for x, ts in notices.items() for t in ts)]:
        must = [i - 1 for i, w in enumerate(text.split()) if w[0] == "*"]
        words = text.replace("*", "").split()
        want = [i for i in range(len(words) - 1) if phrase or i in must or not {words[i], words[i + 1]} <= FUNCTION_WORDS]
        rows += [(tid, i, words[i], words[i + 1], len(want), must, label, phrase) for i in want]
        tid += 1
    assert all(re.fullmatch(r"[a-z0-9.-]+", x) for r in rows for x in (r[2], r[3], r[6]))
    values = ", ".join(f"({t}, {p}, '{a}', '{b}', {n}, CAST(array({', '.join(map(str, m))}) AS ARRAY<INT>), '{x}', {str(q).lower()})" for t, p, a, b, n, m, x, q in rows)
    t = spark.sql(f"SELECT * FROM VALUES {values} AS t(tid, tpos, w1, w2, grams, must, label, phrase)")
    sentinel = spark.sql(f"SELECT {SENTINEL}L AS gram, -1 AS tid, -1 AS tpos, '' AS w1, '' AS w2, 0 AS grams, CAST(array() AS ARRAY<INT>) AS must, '' AS label, false AS phrase")
    return t.select(_gram(F.xxhash64("w1"), F.xxhash64("w2")).alias("gram"), *t.columns).unionByName(sentinel)


def _gram(h1: Column, h2: Column) -> Column:
    return F.xxhash64(h1, h2)


def votes(docs: DataFrame, index: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Verified votes and a sentinel a document: doc_id, k, n_words, tid, tpos, diag, ..."""
    known = sorted(r["gram"] for r in index.select("gram").distinct().collect())  # a few hundred, fixed
    t = F.coalesce(docs[text], F.lit(""))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    words = F.filter(F.split(F.translate(t, upper, upper.lower()), SPLIT), lambda w: w != "")
    rows = docs.select(docs[doc_id].alias("doc_id"), F.xxhash64(t).alias("k"), words.alias("words"))

    def hit(pos, gram, w1, w2):
        return F.struct(pos.cast("int").alias("pos"), gram.alias("gram"), w1.alias("w1"), w2.alias("w2"))

    def hits(h):
        some = F.filter(F.sequence(F.lit(0), F.greatest(F.size(h) - 2, F.lit(0))), lambda i: _gram(F.get(h, i), F.get(h, i + 1)).isin(known))
        return F.transform(some, lambda i: hit(i, _gram(F.get(h, i), F.get(h, i + 1)), F.get("words", i), F.get("words", i + 1)))

    sentinel = F.array(hit(F.lit(-1), F.lit(SENTINEL).cast("long"), F.lit(""), F.lit("")))
    found = F.when(F.size("words") >= 2, F.concat(sentinel, let(F.transform("words", lambda w: F.xxhash64(w)), hits))).otherwise(sentinel)
    grown = rows.select("doc_id", "k", F.size("words").cast("long").alias("n_words"), F.explode(found).alias("hit")).select("doc_id", "k", "n_words", "hit.*")
    voted = grown.join(F.broadcast(index), ["gram", "w1", "w2"])
    return voted.select("doc_id", "k", "n_words", "tid", "tpos", "grams", "must", "label", "phrase", F.when(F.col("tid") >= 0, F.col("pos") - F.col("tpos")).alias("diag"))


def scan(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", phrases: dict[str, str] = PHRASES, notices: dict[str, list[str]] = NOTICES, reach: int = REACH, cover: float = COVER) -> DataFrame:
    """A row per document: n_words, n_base, first_word, last_word, base_labels, labels, score, and
    spans: array of (label, start, end, cover), in words."""
    v = votes(docs, templates(docs.sparkSession, phrases, notices), doc_id, text)
    doc = ["doc_id", "k", "n_words"]
    kind = ["tid", "grams", "must", "label", "phrase"]
    diags = v.groupBy(*doc, *kind, "diag").agg(F.count("*").alias("n"), F.collect_set("tpos").alias("at"))  # at: positions in one template
    w = Window.partitionBy(*doc, *kind).orderBy("diag")
    fresh = F.col("phrase") | F.lag("diag").over(w).isNull() | (F.col("diag") - F.lag("diag").over(w) > reach)
    merged = diags.withColumn("run", F.sum(fresh.cast("int")).over(w))
    runs = merged.groupBy(*doc, *kind, "run").agg(F.min("diag").alias("diag"), F.max("diag").alias("diag2"), F.max("n").alias("n"), F.array_distinct(F.flatten(F.collect_list("at"))).alias("at"))
    part = F.size("at") / F.greatest(F.col("grams"), F.lit(1))
    found = runs.withColumn("cover", part).withColumn("ok", (F.col("tid") >= 0) & F.when(F.col("phrase"), part == 1).otherwise((part >= cover) & (F.size(F.array_except("must", "at")) == 0)))
    place = F.when(F.col("ok") & F.col("phrase"), F.col("diag"))
    span = F.when(F.col("ok"), F.struct("label", (F.col("diag") + F.array_min("at")).alias("start"), (F.col("diag2") + F.array_max("at") + 2).alias("end"), "cover"))
    got = found.groupBy(*doc).agg(
        F.max(F.when(F.col("tid") == -1, F.col("n"))).alias("copies"),
        F.count(place).alias("n_base"), F.min(place).cast("long").alias("first_word"), F.max(place).cast("long").alias("last_word"),
        F.array_join(F.sort_array(F.collect_set(F.when(place.isNotNull(), F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.collect_set(F.when(F.col("ok"), F.col("label")))), ",").alias("labels"),
        F.coalesce(F.max(F.when(F.col("tid") >= 0, F.when(F.col("ok"), F.col("cover")).otherwise(F.col("cover") / 2))), F.lit(0.0)).alias("score"),
        F.sort_array(F.collect_list(span)).alias("spans"))
    return got.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).drop("copies", "copy", "k")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = scan(read(spark, sf_dir, "documents"))
    return got.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
