"""Block kernels, replicates and fitted views against plain Python; file formats by literal bytes."""
import itertools
import math
import random

import numpy as np
import pytest

from freqforge.operators import af as A
from freqforge.operators import blocks as B
from freqforge.operators import fitted as V
from freqforge.operators import fstats as S
from freqforge.operators import models as M
from freqforge.operators import resampled as Z
from freqforge.sources import cache
from freqforge.sources import geno as Q

POPS = list("ABCDE")


@pytest.fixture(scope="module")
def world(spark):
    """Genotypes of 12 samples in 5 populations at 60 variants in 6 blocks, some missing."""
    rng = random.Random(4)
    who = [(f"i{k}", POPS[k % 5]) for k in range(12)]
    freq = {(v, p): min(1, max(0, rng.random() * 0.6 + 0.1 * POPS.index(p))) for v in range(60) for p in POPS}
    rows = [(v, s, p, None if rng.random() < 0.15 else sum(rng.random() < freq[v, p] for _ in range(2))) for v in range(60) for s, p in who]
    geno = spark.createDataFrame(rows, "variant_idx long, sample_id string, pop string, dosage int").repartition(3).cache()
    blocks = spark.createDataFrame([(v, 1 + v // 10) for v in range(60)], "variant_idx long, block int")
    return rows, geno, blocks


def frequencies(rows, skip=None):
    out = {}
    for v, s, p, g in rows:
        if g is not None and s != skip:
            a, n = out.get((v, p), (0, 0))
            out[v, p] = a + g, n + 2
    return {k: (a / n, n) for k, (a, n) in out.items()}


@pytest.mark.parametrize("at", [[3.0, 3.0, 4.9, 5.0, 5.1, 9.0, 7.5, 20.0], [float("nan"), 1.0, 1.5, float("nan"), 2.0], []])
def test_block_starts_are_the_scan(at, monkeypatch):
    monkeypatch.setattr(B, "STEP", 2)
    want, start = [], None
    for i, x in enumerate(at):
        if start is None or math.isnan(start) or x - start >= 2.0:
            want.append(i)
            start = x
    assert B.block_starts(np.array(at), 2.0) == want


@pytest.mark.parametrize("allsnps, poly", [(True, False), (False, False), (True, True)])
def test_f4_kernel(spark, world, monkeypatch, allsnps, poly):
    monkeypatch.setattr(S, "COMBS_A_PIECE", 3)
    monkeypatch.setattr(S, "CELLS", 25)
    rows, geno, blocks = world
    p = frequencies(rows)
    combs = [("A", "B", "C", "D"), ("A", "C", "B", "E"), ("E", "A", "A", "B"), ("B", "D", "C", "E")]
    got = {(r["pop1"], r["pop2"], r["pop3"], r["pop4"], r["block"]): r for r in S.f4_geno_blocks(A.allele_frequencies(geno), blocks, S.combs_table(geno, combs), allsnps=allsnps, poly_only=poly).collect()}
    for c, b in itertools.product(combs, range(1, 7)):
        num, den = [], []
        for v in range(10 * b - 10, 10 * b):
            x = [p.get((v, q)) for q in c]
            if None in x or not allsnps and any((v, q) not in p for q in POPS):
                continue
            w, x, y, z = (k[0] for k in x)
            den.append((w + x - 2 * w * x) * (y + z - 2 * y * z))
            if not poly or len({w, x, y, z}) > 1:
                num.append((w - x) * (y - z))
        r = got[(*c, b)]
        assert r["n"] == len(num) and math.isclose(r["est"], np.mean(num), abs_tol=1e-12) and math.isclose(r["den"], np.mean(den), abs_tol=1e-12)


def test_pairs_of_individuals(spark, world, monkeypatch):
    monkeypatch.setattr(S, "TILE", 5)
    rows, geno, blocks = world
    g = {(v, s): x for v, s, _, x in rows if x is not None}
    got = {(r["s1"], r["s2"], r["block"]): (r["aa"], r["k"]) for r in S.individual_pairs(geno, blocks).collect()}
    names = sorted({s for _, s, *_ in rows})
    for a, b in itertools.combinations_with_replacement(names, 2):
        for k in range(1, 7):
            x = [(g[v, a] * g[v, b] + (2 - g[v, a]) * (2 - g[v, b])) / 2 for v in range(10 * k - 10, 10 * k) if (v, a) in g and (v, b) in g]
            assert got[a, b, k][1] == len(x) and math.isclose(got[a, b, k][0], np.mean(x))


def test_without_one_individual(spark, world):
    rows, geno, blocks = world
    got = {(r["rep"], r["block"], r["pop1"], r["pop2"]): r["est"] for r in Z.without_individuals(geno, blocks).collect()}
    big = {p for p in POPS if len({s for _, s, q, _ in rows if q == p}) > 1}
    names = {s for _, s, p, _ in rows if p in big}
    assert {k[0] for k in got} == names
    for s in sorted(names)[:4]:
        p = frequencies(rows, s)
        for (a, b), k in itertools.product(itertools.combinations(POPS, 2), range(1, 7)):
            x = []
            for v in range(10 * k - 10, 10 * k):
                if (v, a) in p and (v, b) in p:
                    (q, n), (r, m) = p[v, a], p[v, b]
                    x.append((q - r) ** 2 - q * (1 - q) / max(1, n - 1) - r * (1 - r) / max(1, m - 1))
            assert math.isclose(got[s, k, a, b], np.mean(x), abs_tol=1e-12)


def test_models_in_replicates_are_models_of_the_blocks(spark, world):
    rows, geno, blocks = world
    f2 = S.pair_blocks(A.allele_frequencies(geno), blocks).select("block", "pop1", "pop2", "f2").withColumnRenamed("f2", "est").join(B.block_lengths(blocks), "block").cache()
    models = M.models_table(f2, [{"target": "A", "left": ["B", "C"], "right": ["D", "E"]}])
    got = {(r["rep"], r["source"]): r["weight"] for r in Z.qpadm(f2, models).collect()}
    assert len(got) == 12
    for b in (1, 4):
        one = {r["source"]: r["weight"] for r in M.qpadm(f2.where(f"block <> {b}"), models).collect()}
        assert all(math.isclose(got[b, s], w, rel_tol=1e-6) for s, w in one.items())
    boot = Z.qpadm(f2, models, nboot=5).collect()
    near = lambda rows: sorted((r["rep"], r["source"], round(r["weight"], 5)) for r in rows)
    assert len(boot) == 10 and near(boot) == near(Z.qpadm(f2.repartition(5), models, nboot=5).collect())
    waves = Z.qpwave(f2, M.models_table(f2, [{"left": ["A", "B"], "right": ["C", "D", "E"]}]), nboot=3)
    assert waves.groupBy("rep").count().count() == 3


def test_fitted_views(spark, world):
    rows, geno, blocks = world
    f2 = S.pair_blocks(A.allele_frequencies(geno), blocks).where("pop1 <> pop2").select("block", "pop1", "pop2", "f2").withColumnRenamed("f2", "est").join(B.block_lengths(blocks), "block")
    rows_ = {(r["pop2"], r["pop3"], r["pop4"]): r["est"] for r in V.fitted_f4(f2, "A", {"B": 3, "C": 1}, ["D", "E"]).collect()}
    assert math.isclose(rows_["fit", "D", "E"], 0.75 * rows_["B", "D", "E"] + 0.25 * rows_["C", "D", "E"], rel_tol=1e-9)
    f4 = S.f4_blocks(f2, S.combs_table(f2, [("A", "B", "D", "E"), ("A", "C", "D", "E")])).withColumnRenamed("n_snps", "n")
    same = {r["pop2"]: r["est"] for r in V.fitted_from_blocks(f4, {"B": 3, "C": 1}).collect()}
    assert math.isclose(same["fit"], rows_["fit", "D", "E"], rel_tol=1e-9)
    # f2 from f3 with a base, there and back
    f2s = {("A", "B"): 0.1, ("A", "C"): 0.2, ("B", "C"): 0.15}
    f3 = [("A", x, y, (f2s["A", x] + f2s["A", y] - f2s.get((min(x, y), max(x, y)), 0.0)) / 2) for x, y in (("B", "B"), ("B", "C"), ("C", "C"))]
    fit = spark.createDataFrame(f3, "pop1 string, pop2 string, pop3 string, fit double")
    assert {(r["pop1"], r["pop2"]): round(r["fit"], 9) for r in V.fitted_f2(fit).collect()} == f2s
    est = spark.createDataFrame([("A", "B", "A", "C", 0.5, 0.1)], "pop1 string, pop2 string, pop3 string, pop4 string, est double, se double")
    r = V.compare_f4(est, fit).first()
    assert math.isclose(r["fit"], (0.2 + 0.1 - 0 - 0.15) / 2) and math.isclose(r["z"], (0.5 - r["fit"]) / 0.1)
    assert V.compare_scores([1, 2, 3], [0, 0, 0])["diff"] == 2 and V.compare_scores([1, 2, 3, -1], [0] * 4, True)["p_emp"] == 0.5
    assert len(V.models_by_right("T", ["a", "b"], list("cdef"))) == 5 and len(V.models_by_left("T", list("abc"), list("xyz"))) == 3 and len(V.splits(list("abcd"))) == 4
    z = spark.createDataFrame([("T", "a", "x", "y", 0.001), ("T", "b", "x", "y", 0.002), ("T", "a", "x", "z", 0.5)], "pop1 string, pop2 string, pop3 string, pop4 string, p double")
    assert [(r["pop3"], r["pop4"], r["sources"]) for r in V.find_right(z, "T", ["a", "b"]).collect()] == [("x", "y", 2)]


# Three samples, five variants; missing is None.
DOSAGE = [[0, 1, 2], [2, None, 0], [1, 1, 1], [None, 2, 0], [2, 2, 2]]


def _files(tmp_path, name, ind):
    at = tmp_path / name
    (tmp_path / f"{name}.{ind}").write_text("s1 F P\ns2 M P\ns3 U O\n" if ind == "ind" else "P s1 0 0 2 -9\nP s2 0 0 1 -9\nO s3 0 0 0 -9\n")
    lines = [f"rs{i}\t1\t0.{i}\t{100 * i}\tA\tC" for i in range(5)] if ind == "ind" else [f"1\trs{i}\t0.{i}\t{100 * i}\tA\tC" for i in range(5)]
    (tmp_path / f"{name}.{'snp' if ind == 'ind' else 'bim'}").write_text("\n".join(lines) + "\n")
    return at


def _read(spark, at, **how):
    got = Q.genotypes(spark, str(at), **how).collect()
    return {(r["variant_idx"], r["sample_id"]): r["dosage"] for r in got}


def test_formats_by_literal_bytes(spark, tmp_path):
    want = {(v, f"s{s + 1}"): g for v, row in enumerate(DOSAGE) for s, g in enumerate(row)}
    # BED: two bits a sample, the first one lowest: 00 is two, 01 missing, 10 one, 11 none
    bed = _files(tmp_path, "bed", "fam")
    (tmp_path / "bed.bed").write_bytes(bytes([0x6C, 0x1B, 0x01, 0b00_00_10_11, 0b00_11_01_00, 0b00_10_10_10, 0b00_11_00_01, 0b00_00_00_00]))
    assert _read(spark, bed) == want
    # packed: a header record of 48 bytes, records of 48 bytes, the first sample highest: the number itself, 3 missing
    packed = _files(tmp_path, "packed", "ind")
    rec = lambda b: bytes([b]) + bytes(47)
    (tmp_path / "packed.geno").write_bytes(b"GENO   3   5 0 0".ljust(48, b"\0") + b"".join(map(rec, [0b00_01_10_00, 0b10_11_00_00, 0b01_01_01_00, 0b11_10_00_00, 0b10_10_10_00])))
    assert _read(spark, packed) == want
    # transposed: a record a sample, 5 variants
    turned = _files(tmp_path, "turned", "ind")
    rec2 = lambda a, b: bytes([a, b]) + bytes(46)
    (tmp_path / "turned.geno").write_bytes(b"TGEN   3   5 0 0".ljust(48, b"\0") + rec2(0b00_10_01_11, 0b10_000000) + rec2(0b01_11_01_10, 0b10_000000) + rec2(0b10_00_01_00, 0b10_000000))
    assert _read(spark, turned) == want
    assert _read(spark, turned, inds=["s2"], first=2, last=4) == {k: v for k, v in want.items() if k[1] == "s2" and 1 <= k[0] <= 3}
    # text: a line a variant, with and without a last line end, and with carriage returns
    for name, end, last in (("text", "\n", "\n"), ("open", "\n", ""), ("dos", "\r\n", "\r\n")):
        text = _files(tmp_path, name, "ind")
        (tmp_path / f"{name}.geno").write_bytes((end.join(["012", "290", "111", "920", "222"]) + last).encode())
        assert _read(spark, text) == want, name
    assert _read(spark, text, first=4) == {k: v for k, v in want.items() if k[0] >= 3}


def test_caches(spark, world, tmp_path):
    rows, geno, blocks = world
    at = f"file://{tmp_path}/c"
    some = [f"i{k}" for k in range(8)]
    cache.write_counts(geno.where(geno.sample_id.isin(some)), blocks, at)
    cache.extend_counts(geno, blocks, at, [f"i{k}" for k in range(8, 12)])
    whole = f"file://{tmp_path}/w"
    cache.write_counts(geno, blocks, whole)
    canon = lambda df: sorted(map(repr, df.collect()))
    assert canon(cache.read_pairs(spark, at)) == canon(cache.read_pairs(spark, whole)) and canon(cache.read_individuals(spark, at)) == canon(cache.read_individuals(spark, whole))
    assert cache.read_pairs(spark, at, ["i1"], ["i2", "i3"]).select("s1", "s2").distinct().count() == 2
    before = canon(cache.read_individuals(spark, at))
    cache.group_samples(spark, at, ["i0", "i1"], "both")
    assert cache.is_group(spark, at, "both") and not cache.is_group(spark, at, "i0")
    with pytest.raises(ValueError):
        cache.group_samples(spark, at, ["i2"], "both")
    cache.delete_group(spark, at, "both")
    assert canon(cache.read_individuals(spark, at)) == before and not cache.is_cache(spark, at)
    af = A.allele_frequencies(geno)
    cache.write_frequencies(af, blocks, f"{at}/af")
    got, v = cache.read_frequencies(spark, f"{at}/af", ["A", "B"])
    assert v.count() == 60 and {r["pop"] for r in got.select("pop").distinct().collect()} == {"A", "B"}
    near = lambda df: sorted((r["block"], r["pop1"], r["pop2"], round(r["f2"], 9), r["n"]) for r in df.collect())
    assert near(S.pair_blocks(got, v)) == near(S.pair_blocks(af.where("pop IN ('A', 'B')"), blocks))
    who = geno.select("sample_id", "pop").distinct()
    kept = blocks.selectExpr("variant_idx", "concat('rs', variant_idx) AS snp")
    ids = {cache.content_id(w, k, b, blgsize=0.05) for w, k, b in ((who, kept, blocks), (who.repartition(5), kept, blocks), (who.limit(3), kept, blocks))}
    assert len(ids) == 2
