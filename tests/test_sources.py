import json

import numpy as np
import pandas as pd
import pytest

from freqforge.functions import graph as G
from freqforge.operators import af as A
from freqforge.operators import blocks as B
from freqforge.plans.observations import geno, variants
from freqforge.sources import cache, formats
from freqforge.sources import geno as S


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    d = tmp_path_factory.mktemp("geno")
    g = np.random.default_rng(1).choice([0, 1, 2, -1], (20, 7), p=[0.4, 0.25, 0.25, 0.1]).astype(np.int8)
    who = pd.DataFrame({"sample_id": [f"i{k}" for k in range(7)], "sex": "U", "pop": ["p", "p", "p", "q", "q", "q", "r"]})
    snp = pd.DataFrame({"snp": [f"rs{k}" for k in range(20)], "chr": "1", "cm": 0.01 * np.arange(20), "pos": 100 * np.arange(20), "a1": "A", "a2": "G"})
    (d / "b.bed").write_bytes(S.BED_MAGIC + S.encode_bed(g))
    pd.DataFrame([who["pop"], who.sample_id]).T.assign(a=0, b=0, c="U", d=-9).to_csv(d / "b.fam", sep=" ", header=False, index=False)
    snp[["chr", "snp", "cm", "pos", "a1", "a2"]].to_csv(d / "b.bim", sep="\t", header=False, index=False)
    for name in ("k", "e"):
        who.to_csv(d / f"{name}.ind", sep=" ", header=False, index=False)
        snp.to_csv(d / f"{name}.snp", sep=" ", header=False, index=False)
    (d / "k.geno").write_bytes(b"GENO 7 20".ljust(48, b"\0") + S.encode_packed(g))
    (d / "e.geno").write_text("\n".join("".join("9" if x < 0 else str(x) for x in row) for row in g) + "\n")
    return d, g


@pytest.mark.parametrize("name, kind", [("b", "plink"), ("k", "packedancestrymap"), ("e", "eigenstrat")])
def test_readers(spark, files, name, kind):
    d, g = files
    assert S.format_of(str(d / name)) == kind
    rows = S.genotypes(spark, str(d / name)).collect()
    assert {(r["variant_idx"], r["sample_id"]): r["dosage"] for r in rows} == {(v, f"i{s}"): None if g[v, s] < 0 else int(g[v, s]) for v in range(20) for s in range(7)}
    some = S.genotypes(spark, str(d / name), pops=["q"], first=3, last=5).collect()
    assert {r["variant_idx"] for r in some} == {2, 3, 4} and {r["sample_id"] for r in some} == {"i3", "i4", "i5"}
    assert S.variants(spark, str(d / name)).count() == 20
    with pytest.raises(ValueError):
        S.genotypes(spark, str(d / name), pops=["zz"])


def test_conversion_and_frequencies(spark, files, tmp_path):
    d, g = files
    S.extract_samples(spark, str(d / "k"), str(tmp_path / "x"), pops=["p", "r"])
    got = {(r["variant_idx"], r["sample_id"]): r["dosage"] for r in S.genotypes(spark, str(tmp_path / "x")).collect()}
    assert got == {(v, f"i{s}"): None if g[v, s] < 0 else int(g[v, s]) for v in range(20) for s in (0, 1, 2, 6)}
    af = {(r["variant_idx"], r["pop"]): (r["p"], r["n"]) for r in A.allele_frequencies(S.genotypes(spark, str(d / "b"))).collect()}
    for v in range(20):
        x = g[v, :3][g[v, :3] >= 0]
        assert af[v, "p"] == ((pytest.approx(x.mean() / 2), 2.0 * len(x)) if len(x) else (None, 0.0))


def test_variant_tables(tmp_path):
    p = tmp_path / "a.pvar"
    p.write_text("##x\n#CHROM\tPOS\tID\tREF\tALT\n1\t5\trs1\tA\tC\n1\t9\trs2\tA\tC,T\n")
    with pytest.raises(ValueError):
        S.read_pvar(str(p))
    assert list(S.read_pvar(str(p), "skip").snp) == ["rs1"] and list(S.read_pvar(str(p), "first_alt").a2) == ["C", "C"]
    q = tmp_path / "a.psam"
    q.write_text("#IID\tSEX\nx\t1\n")
    assert S.read_psam(str(q)).values.tolist() == [["x", "1", "0"]]


def test_cache(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    af, bl = A.allele_frequencies(geno(spark, sf)), B.assign_blocks(variants(spark, sf), 25.0, "cm")
    at = f"file://{tmp_path}/f2"
    made = cache.write_f2(af, bl, at, blgsize=25, maxmiss=0)
    assert made == cache.cache_id(maxmiss=0, blgsize=25) != cache.cache_id(maxmiss=1, blgsize=25)
    assert cache.read_metadata(spark, at)["id"] == made
    assert {r["pop1"] for r in cache.read_f2(spark, at, ["ASIA", "EUROPE"]).collect()} == {"ASIA", "EUROPE"}
    cache.extract_subset(spark, at, f"file://{tmp_path}/sub", ["ASIA", "AFRICA"])
    assert cache.read_f2(spark, f"file://{tmp_path}/sub", kind="fst").select("pop1").distinct().count() == 2
    g = geno(spark, sf).groupBy("variant_idx", "sample_id", "pop").max("dosage").withColumnRenamed("max(dosage)", "dosage")
    cache.write_counts(g, bl, at)
    ids = [r["sample_id"] for r in g.select("sample_id").distinct().limit(2).collect()]
    n = spark.read.parquet(f"{at}/individuals").count()
    cache.group_samples(spark, at, ids, "both")
    assert spark.read.parquet(f"{at}/individuals").where("sample_id = 'both'").count() > 0
    cache.delete_group(spark, at, "both")
    assert spark.read.parquet(f"{at}/individuals").count() == n


ROWS = [{"from": a, "to": b, "type": t, "weight": w} for a, b, t, w in (("R", "A", "normal", 0.05), ("R", "B", "normal", 0.05), ("A", "M", "admix", 0.6), ("B", "M", "admix", 0.4), ("M", "X", "normal", 0.02), ("A", "Y", "normal", 0.01), ("B", "Z", "normal", 0.03))]


def shape(rows):
    return sorted((r["from"], r["to"], r["type"]) for r in rows)


def test_round_trips(tmp_path):
    formats.validate_edges(ROWS)
    assert shape(formats.parse_dot(formats.write_dot(ROWS))) == shape(ROWS)
    assert shape(formats.parse_qpgraph(formats.write_qpgraph(ROWS))) == shape(ROWS)
    formats.write_treemix(ROWS, str(tmp_path / "t"))
    back = formats.read_treemix(str(tmp_path / "t"))
    assert len(back) == len(ROWS) and {r["to"] for r in back} >= {"X", "Y", "Z"} and sorted(r["weight"] for r in back) == sorted(r["weight"] for r in ROWS)
    edges, nodes = formats.read_lgo(formats.graph_to_lgo(ROWS))
    assert shape(edges) == shape(ROWS) and {n["name"] for n in nodes} == set(G.Graph((r["from"], r["to"]) for r in ROWS).nodes)
    assert abs(next(e["weight"] for e in edges if e["type"] == "admix" and e["from"] == "A") - 0.6) < 1e-9
    with pytest.raises(ValueError):
        formats.validate_edges(ROWS[:3] + ROWS[4:])


def test_parsers():
    assert formats.arithmetic("2*(a+1)^2/4", {"a": 3}) == 8
    with pytest.raises((ValueError, KeyError)):
        formats.arithmetic("__import__('os')", {})
    fit = formats.read_fit("Initial parameter values\nFixed:\n T_x = 0\nFree:\n twoN_a = 1\nFitted parameter values\nFree:\n twoN_a = 2.5\nDiffEv reached_goal. cost=1e-3 spread=2\n")
    assert fit["fitted"] == {"twoN_a": 2.5} and fit["fixed"] == {"T_x"} and fit["cost"] == 1e-3
    assert formats.read_bootci("# c\npar est low high\nT_a 1 0 2\n") == [{"parameter": "T_a", "family": "time", "point_estimate": 1.0, "lo": 0.0, "hi": 2.0}]
    assert formats.read_patterns("# c\nx:y 0.14\n") == {"x:y": 0.14}
    assert formats.parse_qp3pop("result: A B C 0.1 0.01 10 500\n")[0]["z"] == 10
    assert formats.parse_parfile("genotypename: a.geno # x\nblgsize: 0.05\n") == {"genotypename": "a.geno", "blgsize": "0.05"}
    tree, moves = formats.parse_treeout("((A:1,B:2):1,C:3);\n0.2 NA NA NA A:1 (B:2,C:1)\n")
    assert tree.leaves == ["A", "B", "C"] and moves == [(frozenset("A"), frozenset("BC"), 0.2)]


def test_json(spark):
    df = spark.createDataFrame([(1, float("nan"))], "a int, b double")
    assert json.loads(formats.result_to_json(df, "f4", {"x": 1})) == {"schema_version": 1, "function": "f4", "args": {"x": 1}, "result": [{"a": 1, "b": None}]}


def test_from_files_to_a_cache(spark, files, tmp_path):
    from freqforge.operators import pipelines as P

    d, g = files
    made = P.extract_f2(spark, str(d / "b"), f"file://{tmp_path}/c", pops=["p", "q"], maxmiss=1, blgsize=0.05)
    assert made.startswith("sha256:")
    f2 = P.f2_from_geno(spark, str(d / "k"), pops=["p", "q"], maxmiss=1, blgsize=0.05).cache()
    a = {(r["block"], r["pop1"], r["pop2"]): r["est"] for r in f2.collect()}
    b = {(r["block"], r["pop1"], r["pop2"]): r["est"] for r in cache.read_f2(spark, f"file://{tmp_path}/c").collect()}
    assert a == pytest.approx(b, nan_ok=True) and len({k[0] for k in a}) >= 3
    mean = lambda f: f.where("pop1 < pop2").groupBy("pop1", "pop2").avg("est").withColumnRenamed("avg(est)", "est")
    assert P.resample_snps(f2, mean).count() == len({k[0] for k in a}) and P.resample_snps(f2, mean, nboot=3).count() == 3
    t = P.random_dates([("R", "a"), ("a", "X"), ("a", "Y"), ("R", "Z")])
    assert t["R"] > t["a"] > t["X"] == 0
