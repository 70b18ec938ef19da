"""Registered queries and operators on everything they are given."""
from freqforge.operators import af as A
from freqforge.operators import blocks as B
from freqforge.plans import queries as Q
from freqforge.plans.observations import geno, variants

SF = "/root/testdata/sf0.01"


def test_every_sample_has_a_ploidy(spark):
    rows = [(1, "a", "P", 1), (1, "b", "P", 2), (2, "a", "P", 0), (2, "c", "P", 1), (3, "c", "P", 2), (3, "d", "P", None)]
    g = spark.createDataFrame(rows, "variant_idx long, sample_id string, pop string, dosage int")
    p = A.sample_ploidy(g, 1)
    assert dict(map(tuple, p.collect())) == {"a": 2, "b": 1, "c": 1, "d": 1}
    assert dict(map(tuple, A.sample_ploidy(g).collect())) == {"a": 2, "b": 1, "c": 2, "d": 1}
    af = {r["variant_idx"]: (r["p"], r["n"]) for r in A.allele_frequencies(g, p.where("sample_id <> 'c'")).collect()}
    assert af == {1: (2 / 3, 3.0), 2: (0.5 / 3, 3.0), 3: (1.0, 1.0)}


def test_registered_ploidy_is_of_all_samples(spark):
    """Ploidies from the first 1000 variants, as in the reference, and frequencies with every genotype."""
    g = geno(spark, SF).toPandas()
    g = g.groupby(["variant_idx", "sample_id", "pop"], as_index=False)["dosage"].max()
    first = sorted(g["variant_idx"].unique())[:1000]
    het = set(g[g["variant_idx"].isin(first) & (g["dosage"] == 1)]["sample_id"])
    want = {s: 1 + (s in het) for s in g["sample_id"]}
    assert len(want) == 100 and dict(map(tuple, Q.queries()["sample_ploidy"](spark, SF).collect())) == want
    g["ploidy"] = g["sample_id"].map(want)
    g["a"] = g["dosage"] / (3 - g["ploidy"])
    s = g.groupby(["variant_idx", "pop"])[["a", "ploidy"]].sum()
    got = Q.queries()["pseudohaploid_frequencies"](spark, SF).toPandas().set_index(["variant_idx", "pop"]).sort_index()
    assert len(got) == len(s) and got["n"].tolist() == s["ploidy"].astype(float).tolist()
    assert ((got["p"] - s["a"] / s["ploidy"]).abs() < 1e-8).all()


def folded(vs, size):
    """(variant, chr, cm) in order -> block of each variant."""
    out, k, at = {}, 0, None
    for v, chrom, cm in vs:
        if at is None or at[0] != chrom or cm - at[1] >= size:
            k, at = k + 1, (chrom, cm)
        out[v] = k
    return out


def test_every_variant_has_a_block(spark):
    vs = [tuple(r) for r in variants(spark, SF).select("variant_idx", "chr", "cm").orderBy("variant_idx").collect()]
    want = folded(vs, 13.0)
    assert dict(map(tuple, Q.queries()["greedy_blocks"](spark, SF).collect())) == want
    sizes = {b: sum(x == b for x in want.values()) for b in set(want.values())}
    assert dict(map(tuple, Q.queries()["block_lengths"](spark, SF).collect())) == sizes


def test_blocks_over_irregular_gaps(spark):
    vs = [(i, str(1 + i // 100), float(i % 100)) for i in range(300) if i % 7 != 0 and i % 5 != 1]
    df = spark.createDataFrame(vs, "variant_idx long, chr string, cm double")
    assert dict(map(tuple, B.assign_blocks(df, 13.0, "cm").select("variant_idx", "block").collect())) == folded(vs, 13.0)
