import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from freqforge.llm import mixing, packing, sharding


def rows(df):
    return [tuple(r) for r in df.collect()]


@given(st.lists(st.integers(1, 100), max_size=60), st.integers(100, 200))
@settings(max_examples=60, deadline=None)
def test_treap_packs_like_a_scan(sizes, capacity):
    sizes = sorted(sizes, reverse=True)
    bins, want = [], []
    for s in sizes:
        fit = min(((r, i) for i, r in enumerate(bins) if r >= s), default=None)
        if fit is None:
            bins.append(capacity)
            fit = (capacity, len(bins) - 1)
        bins[fit[1]] -= s
        want.append(fit[1])
    assert sharding.pack(sizes, capacity) == want


def test_balance_is_even_and_gives_giants_a_shard():
    rng = random.Random(1)
    sizes = sorted((rng.randint(1, 1000) for _ in range(3000)), reverse=True)
    total = Counter()
    for s, b in zip(sizes, sharding.balance(sizes, 16)):
        total[b] += s
    assert len(total) == 16 and max(total.values()) - min(total.values()) < 0.01 * sum(sizes) / 16
    assert sharding.balance([100, 1, 1, 1], 2) == [0, 1, 1, 1]


def test_shards(odd, none):
    got = rows(sharding.shard(odd, 4))
    assert len(got) == odd.count() and not rows(sharding.shard(none, 4))
    slots, texts = defaultdict(list), {}
    for d, size, crc, shard, slot in got:
        slots[shard].append(slot)
        assert texts.setdefault(crc, shard) == shard
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    by = {r["doc_id"]: r["text"] for r in odd.collect()}
    assert all(size == len((by[d] or "").encode()) + 1 and crc == zlib.crc32((by[d] or "").encode()) for d, size, crc, *_ in got)
    n = len({b for *_, b, _ in rows(sharding.shard(odd, capacity=100_000))})
    assert n == 2  # the one text above the capacity, and all others together


@pytest.mark.parametrize("fine", [16, 1])
def test_capacity_holds_for_many_small_groups(spark, monkeypatch, fine):
    monkeypatch.setattr(sharding, "ITEMS", 16)
    monkeypatch.setattr(sharding, "FINE", fine, raising=False)
    df = spark.createDataFrame([(i, f"{i % 2500} " + "x" * (i % 2500 % 67)) for i in range(3000)], "doc_id long, text string")
    filled = Counter()
    for _, size, _, shard, _ in rows(sharding.shard(df, capacity=1000)):
        filled[shard] += size
    assert max(filled.values()) <= 1000 and len(filled) <= 1.02 * -(-sum(filled.values()) // 1000) + 1


def test_mix_targets_and_repetitions(spark, odd, none):
    assert not rows(mixing.mix(none))
    data = [(i, "w " * (1 + i % 7), "a" if i < 300 else "b" if i < 320 else None if i < 330 else "empty", ) for i in range(335)]
    data = [(i, t if s != "empty" else "", s) for i, t, s in data]
    df = spark.createDataFrame(data, "doc_id long, text string, source string")
    got = mixing.mix(df).collect()
    taken, target, size = Counter(), {}, {}
    for r in got:
        taken[r["skey"]] += r["taken"]
        target[r["skey"]], size[r["skey"]] = r["target"], r["source_size"]
        assert r["taken"] <= 2 * r["size"]
    assert abs(sum(target.values()) - 1.5 * sum(size.values())) < 1e-6
    # water-filling by repeated clamping
    names = sorted(size)
    w = dict(zip(names, (5, 2, 1, 5)))
    want, open_, left = {}, set(names), 1.5 * sum(size.values())
    while True:
        share = {k: left * w[k] / sum(w[x] for x in open_) for k in open_}
        over = [k for k in open_ if share[k] > 2 * size[k]]
        if not over:
            want |= share
            break
        for k in over:
            want[k] = 2 * size[k]
            left -= want[k]
            open_.discard(k)
    assert all(abs(want[k] - target[k]) < 1e-6 for k in names)
    assert all(abs(taken[k] - target[k]) <= 4 for k in names)
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.mix(df.repartition(7)).collect()))
    again = Counter(r["doc_id"] for r in mixing.mixed(df).collect())
    assert again == Counter({r["doc_id"]: r["reps"] for r in got if r["reps"]})
    assert mixing.mixed(odd).columns == odd.columns and len(rows(mixing.mix(odd))) == odd.count()


@pytest.fixture(scope="module")
def tokenizer():
    return packing.tokenizer_file()


@given(st.text(alphabet=st.sampled_from("ab é\n\t  'sL0²Ⅷ🙂中.,!<|endoftext|>  "), max_size=60))
@settings(max_examples=300, deadline=None)
def test_encoder_is_the_tokenizer(text):
    import public_tokenizers
    from tokenizers import Tokenizer

    if not hasattr(test_encoder_is_the_tokenizer, "both"):
        t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
        test_encoder_is_the_tokenizer.both = t, packing.Encoder(packing.tokenizer_file())
    t, mine = test_encoder_is_the_tokenizer.both
    for x in (text, text + " word " + text):
        assert np.frombuffer(mine.encode(x), "<u4").tolist() == t.encode(x, add_special_tokens=False).ids


@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), max_size=30))
@settings(max_examples=80, deadline=None)
def test_plan_uses_every_piece_once(counts):
    made = packing.plan(counts, 64)
    used = Counter()
    for lengths, copies in made:
        assert sum(lengths) <= 64 and copies > 0
        for n in lengths:
            used[n] += copies
    assert used == Counter(counts)
    total = sum(n * c for n, c in counts.items())
    assert sum(c for _, c in made) <= 2 * total / 64 + 1


def test_plan_fills_exactly():
    assert dict(packing.plan({40: 3, 24: 3}, 64)) == {(40, 24): 3}
    assert dict(packing.plan({30: 1, 20: 1, 14: 1}, 64)) == {(30, 20, 14): 1}
    assert dict(packing.plan({30: 2, 20: 2, 9: 2, 5: 2}, 64)) == {(30, 20, 9, 5): 2}


def test_packs_the_odd_ones(odd, none, tokenizer):
    assert not rows(packing.pack_documents(none, tokenizer))
    parts = packing.pieces(odd, tokenizer, keep_ids=True).collect()
    got = packing.pack_documents(odd, tokenizer).collect()
    assert len(got) == len(parts)
    seqs, docs = defaultdict(list), defaultdict(list)
    for r in got:
        seqs[r["sequence_id"]].append((r["offset"], r["length"]))
        docs[r["doc_id"]].append((r["piece"], r["start"], r["length"]))
    for s in seqs.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at <= 2048
    assert Counter((r["doc_id"], r["piece"], r["ids_crc32"]) for r in got) == Counter((r["doc_id"], r["piece"], zlib.crc32(r["ids"])) for r in parts)
    for d, ps in docs.items():
        if d not in (5, None):  # repeated rows
            ends = [0]
            for p, s, n in sorted(ps):
                assert s == ends[-1] and (p == 0 or n == 2048)
                ends.append(s + n)
