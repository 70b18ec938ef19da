import random

import numpy as np
import pytest

from freqforge.llm import embed, graph, jaccard


def brute(rows):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    root = {i: i for i in sets}
    links = dict.fromkeys(sets, 0)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            k = len(sets[a] & sets[b])
            if k and 100 * k >= 75 * (len(sets[a]) + len(sets[b]) - k):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
                links[a] += 1
                links[b] += 1
    return {i: (len(sets[i]), find(i), links[i]) for i in ids}


def copies(seed, groups, size, words, edits):
    rng = random.Random(seed)
    out = []
    for _ in range(groups):
        base = [f"w{rng.randint(0, 4000)}" for _ in range(words)]
        for _ in range(rng.randint(1, size)):
            t = list(base)
            for _ in range(rng.randint(0, edits)):
                t[rng.randrange(len(t))] = f"e{rng.randint(0, 10**9)}"
            out.append(" ".join(t))
    passage = " ".join(f"p{k}" for k in range(60))
    out += [passage + " " + " ".join(f"u{rng.randint(0, 10**9)}" for _ in range(rng.randint(3, 60))) for _ in range(40)]
    rng.shuffle(out)
    return list(enumerate(out))


@pytest.mark.parametrize("hot, small, block, flush", [(64, 8, 256, 1_000_000), (3, 2, 4, 300)])
def test_components_are_the_brute_force_ones(spark, monkeypatch, hot, small, block, flush):
    for name, v in (("SMALL", small), ("BLOCK", block)):
        monkeypatch.setattr(jaccard, name, v)
    for name, v in (("HOT", hot), ("FLUSH", flush)):
        monkeypatch.setattr(jaccard, name, v)
    rows = copies(hot, 25, 14, 80, 6)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["n_links"]) for r in jaccard.join(df).collect()}
    assert got == brute(rows)


def test_the_threshold_itself(spark):
    """7 of 9.33 and 6 of 8 shingles: exactly 75 % links."""
    w = [f"a{i}" for i in range(11)]
    rows = [(1, " ".join(w)), (2, " ".join(w[:10] + ["z"])), (3, " ".join(w[1:])), (4, " ".join(["q", *w[1:11], "r"])), (5, "A0 a1\ta2 a3  a4 a5 a6 a7 a8 a9 a10")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["n_links"]) for r in jaccard.join(df).collect()} == brute(rows)


def test_odd(odd, none):
    assert not jaccard.join(none).collect()
    got = jaccard.join(odd).collect()
    assert len(got) == odd.count()
    by = {r["doc_id"]: r for r in got}
    assert {by[i]["component_id"] for i in (5, 6, 7, 8, 99)} == {5}
    assert all(by[i]["component_id"] == i and by[i]["n_shingles"] == 0 for i in (0, 1, 2))
    assert by[3]["n_shingles"] == 1 and by[None]["component_id"] is None
    assert by[5]["n_links"] == 6 and by[0]["n_links"] == 0


def test_one_row_stays_of_each_group(spark, odd, none):
    assert not jaccard.keep_one(none).collect()
    kept = jaccard.keep_one(odd)
    assert kept.columns == odd.columns
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept.collect())
    assert got == sorted([(False, i) for i in (0, 1, 2, 3, 4, 5, 9, 10, 11, 12, 13)] + [(True, 0)])
    base = " ".join(f"w{i}" for i in range(40))
    rows = [(1, base, "a"), (1, base, "b"), (1, base + " x", "c"), (None, base + " y", "d"), (None, "other text", "e"), (None, "other text", "e"), (2, None, "f"), (2, None, "f")]
    got = [jaccard.keep_one(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(n)).collect() for n in (1, 4)]
    assert sorted(map(repr, got[0])) == sorted(map(repr, got[1]))
    assert sorted((r["text"] or "", r["doc_id"] or 0) for r in got[0])[:3] == [("", 2), ("", 2), ("other text", 0)]
    assert len(got[0]) == 4 and sum(r["doc_id"] == 1 for r in got[0]) == 1


def test_graph_components(spark):
    rng = random.Random(4)
    edges = [(k, k + 1) for k in range(200, 260)] + [(rng.randint(0, 90), rng.randint(0, 90)) for _ in range(60)]
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    root = {x: x for e in edges for x in e}
    for _ in root:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    assert got == {x: r for x, r in root.items() if any(x in e and e[0] != e[1] for e in edges)}


def vectors(seed):
    rng = np.random.default_rng(seed)
    rows, i = [], 0
    for label in (0, 1, 1, 1, 2):
        for _ in range(8):
            c = rng.standard_normal(16)
            for _ in range(int(rng.integers(1, 20))):
                rows.append((i, [float(x) for x in np.float32(c + rng.standard_normal(16) * rng.choice([0.0, 0.05, 0.15]))], label))
                i += 1
    return rows


def test_embeddings_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(embed, "BLOCK", 5)
    rows = vectors(1) + [(1000, None, 1), (1001, [0.0] * 16, 1), (1002, [float("nan")] * 16, 1), (1003, [1.0, None], 1), (1004, [1.0] * 16, None), (1005, [], 1), (1006, [3.0, 4.0], 1), (1007, [3.0, 4.0], 1)]
    rows.append(rows[0])
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label int, cls string").repartition(4)
    got = {r["vec_id"]: r for r in embed.near_dups(df).collect()}
    assert embed.near_dups(df).count() == len(rows)
    good = {i: (np.array(v, float), lab) for i, v, lab in rows if lab is not None and v and None not in v and np.isfinite(v).all() and any(v)}
    links = {i: set() for i, *_ in rows}
    for a, (x, p) in good.items():
        for b, (y, q) in good.items():
            if a != b and p == q and len(x) == len(y) and x @ y / np.sqrt(x @ x) / np.sqrt(y @ y) >= 0.98:
                links[a].add(b)
    root = {i: i for i in links}
    for _ in range(40):
        for a in links:
            for b in links[a]:
                root[a] = root[b] = min(root[a], root[b])
    assert all(got[i]["n_links"] == len(links[i]) and got[i]["component_id"] == root[i] for i in links)
    assert all(got[i]["kept"] == (i == got[i]["component_id"]) for i in links)
    assert not embed.near_dups(df.limit(0)).collect()


@pytest.mark.parametrize("most", [48, 2])
def test_embeddings_that_share_a_direction(spark, monkeypatch, most):
    """Mean cosine 0.95, planted pairs: passes are added until the sampled links are found, or the label is compared in full."""
    monkeypatch.setattr(embed, "MAX_PASSES", most)
    rng = np.random.default_rng(7)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    x = unit(np.sqrt(0.95) * unit(rng.standard_normal(32)) + np.sqrt(0.05) * unit(rng.standard_normal((2000, 32))))
    d = rng.standard_normal((200, 32))
    p = x[:200]
    c = rng.uniform(0.981, 0.99, (200, 1))
    x = np.r_[x, c * p + np.sqrt(1 - c * c) * unit(d - (d * p).sum(1, keepdims=True) * p)]
    rows = [(i, v.tolist(), "a label") for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string").repartition(4)
    got = embed.near_dups(df, window=16).toPandas().sort_values("vec_id")["n_links"].to_numpy()
    want = (x @ x.T >= 0.98).sum(1) - 1
    assert (got <= want).all() and got.sum() >= 0.99 * want.sum() and want.sum() > 300
    if most == 2:
        assert (got == want).all()
