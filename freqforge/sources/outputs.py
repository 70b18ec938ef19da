"""Tables from the text outputs of classic f-statistics programs, and run files for simulators."""
from __future__ import annotations

import itertools
import math
import re
from collections.abc import Callable, Iterable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.graph import Graph
from .formats import node_times, parse_qpgraph

_NUMBER = re.compile(r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?")


def _numbers(words: Iterable[str]) -> list[float]:
    return [float(w) for w in words if _NUMBER.fullmatch(w)]


def _section(lines: list[str], begin: str, skip: int = 1, end: str | None = None) -> list[str]:
    """Lines after the first that matches begin (skip - 1 more left out), up to one that matches end or is empty."""
    at = next((i for i, x in enumerate(lines) if re.search(begin, x)), None)
    if at is None:
        return []
    rest = lines[at + skip :]
    return list(itertools.takewhile(lambda x: x.strip() and not (end and re.search(end, x)), rest))


def parse_qpadm(text: str) -> dict[str, list[dict]]:
    """weights: target, left, weight, mean, se, z; popdrop: pat, wt, dof, chisq, p, the weight of each source, feasible."""
    lines = text.splitlines()
    pops = [x.strip() for x in _section(lines, r"left pops:")]
    target, left = pops[0], pops[1:]
    best = [i for i, x in enumerate(lines) if x.startswith("best coefficients:")][0]
    rows = [_numbers(x.split())[: len(left)] for x in lines[best : best + 3]]
    weights = [{"target": target, "left": p, "weight": w, "mean": m, "se": s, "z": m / s if s else None} for p, w, m, s in zip(left, *rows)]
    drop = []
    for x in _section(lines, r"fixed pat", end=r"^best pat:"):
        w = x.split()
        v = _numbers(w[1 : 5 + len(left)])
        drop.append({"pat": w[0], "wt": v[0], "dof": v[1], "chisq": v[2], "p": v[3]} | dict(zip(left, v[4:])) | {"feasible": w[-1] != "infeasible"})
    return {"weights": weights, "popdrop": drop, "right": [{"pop": x.strip()} for x in _section(lines, r"right pops:")]}


def parse_qpgraph_output(text: str) -> dict:
    """edges, score, f2 (estimated and fitted), worst: of a program's log and graph in one text."""
    lines = [" ".join(x.split()) for x in text.splitlines()]
    edges = parse_qpgraph("\n".join(x for x in lines if re.match(r"(label|edge|ledge|redge|admix) ", x)))
    score = next((_numbers(x.split())[0] for x in lines if x.startswith("final score")), None)
    pops = [x.split()[2] for x in lines if re.match(r"population: +\d+ \S", x)]
    pairs = itertools.combinations(pops, 2)
    f2 = [{"pop1": a, "pop2": b} | dict(zip(("fit", "est", "diff", "se", "z"), _numbers(x.split(" f2: ")[1].split()))) for (a, b), x in zip(pairs, (x for x in lines if " f2: " in x))]
    worst = next((_numbers(x.split())[-1] for x in lines if x.startswith("worst f-stat:")), None)
    return {"edges": edges, "score": score, "f2": f2, "worst": worst}


def parse_fstats(text: str, scale: float = 1e3, var_scale: float = 1e6) -> dict:
    """f3 of a base population and their covariance: pops, f3 (pop1, pop2, pop3, est, se), cov (a matrix in the order of f3)."""
    lines = [x.split() for x in text.splitlines() if x.strip()]
    base = lines[0][lines[0].index("basepop:") + 1] if "basepop:" in lines[0] else lines[0][2]
    est = {(r[0], r[1]): float(r[2]) / scale for r in lines[1:] if len(r) == 3}
    at = {k: i for i, k in enumerate(est)}
    cov = np.zeros((len(est), len(est)))
    for r in lines[1:]:
        if len(r) == 5:
            i, j = at[r[0], r[1]], at[r[2], r[3]]
            cov[i, j] = cov[j, i] = float(r[4]) / var_scale
    f3 = [{"pop1": base, "pop2": a, "pop3": b, "est": v, "se": math.sqrt(cov[i, i])} for (a, b), i, v in zip(est, at.values(), est.values())]
    return {"pops": list(dict.fromkeys([base, *(p for k in est for p in k)])), "f3": f3, "cov": cov}


def parse_qpfstats(text: str) -> dict[str, list[dict]]:
    """fstat: pop1..pop4, est, se, z; basis: pop1, pop2, f21, se1, f22, se2; jest: four populations and two f2."""
    lines = [x.split() for x in text.splitlines() if x.strip()]
    pops = [r[1] for r in lines if r[0] == "pop:"]
    name = lambda x: pops[int(float(x))]
    fstat = [{f"pop{i + 1}": name(x) for i, x in enumerate(r[1:5])} | dict(zip(("est", "se", "z"), map(float, r[5:8]))) for r in lines if r[0] == "fstat:"]
    basis, jest = [], []
    for r in lines:
        if r[0] == "basis:":
            v = [r[1], r[2], *_numbers(r[3:])]
            basis.append({"pop1": name(v[0]), "pop2": name(v[1])} | dict(zip(("f21", "se1", "f22", "se2"), v[2:])))
        elif r[0].startswith("jest"):
            v = r[-7:]
            jest.append(dict(zip(("p11", "p12", "p21", "p22"), map(name, v[:4]))) | dict(zip(("f21", "f22", "se"), map(float, v[4:]))))
    return {"fstat": fstat, "basis": basis, "jest": jest}


def parse_qpfmv(text: str) -> list[dict]:
    rows = [x.split() for x in text.splitlines() if x.startswith("result:")]
    return [dict(zip(("pop1", "pop2", "pop3", "pop4"), r[1:5])) | {"est": float(r[5]), "z": float(r[6])} for r in rows]


def parse_ff3base(text: str, scale: float = 1e3) -> list[dict]:
    """pop1, pop2, fst, f2 of two square tables that follow the list of populations."""
    lines = [x.strip() for x in text.splitlines()]
    pops = [x.split()[-1] for x in _section(lines, r"^end of inpack", end=r"^outpop:")]
    tables = []
    for mark in (r"^fst:", r"^f2:"):
        rows = _section(lines, mark, 2)[: len(pops)]
        tables.append([[float(v) / scale for v in r.split()[1:]] for r in rows])
    return [{"pop1": a, "pop2": b, "fst": tables[0][i][j], "f2": tables[1][i][j]} for i, a in enumerate(pops) for j, b in enumerate(pops)]


def read_outputs(spark: SparkSession, path: str, parse: Callable[[str], list[dict]], schema: str) -> DataFrame:
    """A parser over a folder of outputs, a file a task row: file, and the columns of schema."""
    names = [c.strip().split()[0] for c in schema.split(",")]

    def run(frames):
        import pandas as pd

        for pdf in frames:
            yield pd.DataFrame([(f, *(r.get(n) for n in names)) for f, t in zip(pdf.file, pdf.text) for r in parse(t)], columns=["file", *names])

    files = spark.read.option("wholetext", True).text(path).select(F.input_file_name().alias("file"), F.col("value").alias("text"))
    return files.mapInPandas(run, f"file string, {schema}")


# --- parameter files of the same programs


def yesno(x) -> str:
    return "YES" if x else "NO"


def write_parfile(settings: dict) -> str:
    """name: value lines; flags become YES and NO, missing values are left out."""
    return "".join(f"{k}: {yesno(v) if isinstance(v, bool) else v}\n" for k, v in settings.items() if v is not None)


def poplists(rows: Iterable[Iterable[str]]) -> str:
    """One combination of populations a line."""
    return "".join(" ".join(r) + "\n" for r in rows)


# --- dates, and simulator input


def pseudo_dates(g: Graph, time: float = 1000, fix_leaf: bool = False) -> dict[str, float]:
    """A date a node: its height over the lowest leaf in steps of the longest way down from the root, times `time`; with
    fix_leaf leaves are at 0."""
    depth: dict[str, int] = {}
    for n in g.order:
        depth[n] = max((depth[p] + 1 for p in g.up[n]), default=0)
    low = max(depth.values())
    return {n: 0.0 if fix_leaf and not g.down[n] else float((low - depth[n]) * time) for n in g.nodes}


def demes(g: Graph, time: float = 1000, neff: float = 1000, admix: dict[str, float] | None = None, fix_leaf: bool = False) -> dict:
    """A demographic model as data, in the layout of the `demes` format: a deme a node, with its ancestors and when it began."""
    at = pseudo_dates(g, time, fix_leaf)
    out = []
    for n in g.order:
        d = {"name": n, "epochs": [{"end_time": at[n], "start_size": neff}]}
        if g.up[n]:
            w = (admix or {}).get(n, 0.5)
            d |= {"ancestors": list(g.up[n]), "proportions": [w, 1 - w] if len(g.up[n]) == 2 else [1.0], "start_time": min(at[p] for p in g.up[n])}
        out.append(d)
    return {"time_units": "generations", "demes": out}


def msprime_script(g: Graph, out: str = "sim", nsnps: int = 1000, neff: float = 1000, ind_per_pop: int = 1, mutation_rate: float = 1e-3, time: float = 1000, admix: dict[str, float] | None = None, seq_length: int | None = None, recombination_rate: float = 2e-8, nchr: int = 1, seed: int = 1) -> str:
    """Text of a Python script for msprime: independent sites, or with seq_length nchr chromosomes of that length."""
    at = pseudo_dates(g, time)
    body = ["import msprime", "", "demography = msprime.Demography()"]
    body += [f"demography.add_population(name={n!r}, initial_size={neff}, default_sampling_time={at[n]})" for n in g.nodes]
    events = []
    for n in g.nodes:
        if len(g.up[n]) == 2:
            w = (admix or {}).get(n, 0.5)
            events.append((min(at[p] for p in g.up[n]), f"demography.add_admixture(time={min(at[p] for p in g.up[n])}, derived={n!r}, ancestral={list(g.up[n])!r}, proportions={[w, 1 - w]!r})"))
        elif g.up[n]:
            events.append((at[g.up[n][0]], f"demography.add_mass_migration(time={at[g.up[n][0]]}, source={n!r}, dest={g.up[n][0]!r}, proportion=1)"))
    body += [e for _, e in sorted(events)] + ["demography.sort_events()", f"samples = {dict.fromkeys(g.leaves, ind_per_pop)!r}"]
    if seq_length is None:
        body += [f"trees = msprime.sim_ancestry(samples, demography=demography, num_replicates={nsnps}, random_seed={seed})", f"rate, length = {mutation_rate}, 1"]
    else:
        body += [f"trees = (msprime.sim_ancestry(samples, demography=demography, sequence_length={seq_length}, recombination_rate={recombination_rate}, random_seed={seed} + k) for k in range({nchr}))", f"rate, length = {mutation_rate}, {seq_length}"]
    body += [f"with open({out + '.vcf'!r}, 'w') as f:", "    for k, t in enumerate(trees):", f"        msprime.sim_mutations(t, rate=rate, random_seed={seed} + k).write_vcf(f, contig_id=str(k + 1))"]
    return "\n".join(body) + "\n"


def fastsimcoal_files(g: Graph, nsnps: int = 10_000_000, recombination_rate: float = 1e-8, mutation_rate: float = 2e-8, time: float = 1000, template: bool = False, size: int = 10_000) -> dict[str, str]:
    """par, or tpl and est: populations are nodes; back in time each moves to its parent, an admixed one half to its first."""
    at, index = pseudo_dates(g, time), {n: i for i, n in enumerate(g.nodes)}
    events, rates = [], []
    for n in g.nodes:
        for k, p in enumerate(g.up[n]):
            part = "1"
            if len(g.up[n]) == 2 and k == 0:
                part = f"A{len(rates) + 1}$" if template else "0.5"
                rates.append(part)
            events.append((at[n] if template else at[p], f"{index[n]} {index[p]} {part} 1 0 0"))
    rows = lambda x: "\n".join(map(str, x))
    text = (
        f"//Number of population samples (demes)\n{len(index)}\n//Population effective sizes (number of genes)\n{rows([size] * len(index))}\n"
        f"//Sample sizes\n{rows(0 if g.down[n] else 2 for n in g.nodes)}\n//Growth rates: negative growth implies population expansion\n{rows([0] * len(index))}\n"
        f"//Number of migration matrices : 0 implies no migration between demes\n0\n//historical event: time, source, sink, migrants, new size, new growth rate, migr. matrix\n"
        f"{len(events)} historical event\n{rows(f'{t:g} {e}' for t, e in sorted(events))}\n//Number of independent loci [chromosome]\n1 0\n//Per chromosome: Number of linkage blocks\n1\n"
        f"//per Block: data type, num loci, rec. rate and mut rate + optional parameters\n{'FREQ' if template else 'SNP'} {nsnps} {recombination_rate:g} {mutation_rate:g}\n"
    )
    if not template:
        return {"par": text}
    est = "[PARAMETERS]\n" + "".join(f"0\t{a}\tunif\t0\t1\toutput\n" for a in rates) + "\n[RULES]\n\n[COMPLEX PARAMETERS]\n"
    return {"tpl": text, "est": est}


def sfs_text(counts: Iterable[float]) -> str:
    """A joint spectrum, flattened row by row, as a simulator's observation."""
    return "1 observations. No. of demes and sample sizes are on next line\n" + " ".join(f"{c:g}" for c in counts) + "\n"


def parse_sfs(text: str, popcounts: dict[str, int]) -> list[dict]:
    """The last line's counts with the number of derived alleles in each population."""
    values = [float(x) for x in text.strip().splitlines()[-1].split()]
    cells = itertools.product(*(range(n + 1) for n in popcounts.values()))
    return [dict(zip(popcounts, c)) | {"n": v} for c, v in zip(cells, values)]


def noisy_blocks(f2: DataFrame, nblocks: int = 1000, cv: float = 0.1, seed: int = 0) -> DataFrame:
    """pop1, pop2, f2 -> block, pop1, pop2, est, n_snps: each mean with normal noise of relative size cv, block by block."""
    noise = F.randn(seed)
    return f2.select("pop1", "pop2", "f2", F.explode(F.sequence(F.lit(1), F.lit(nblocks))).alias("block")).select("block", "pop1", "pop2", (F.col("f2") * (1 + cv * noise)).alias("est"), F.lit(1).cast("long").alias("n_snps"))


def graph_blocks(spark: SparkSession, rows: list[dict], nblocks: int = 1000, cv: float = 0.1, seed: int = 0) -> DataFrame:
    """Blocks around the f2 that a weighted graph predicts."""
    from ..functions.graph import expected_f2
    from .formats import graph_of

    g = graph_of(rows)
    w = {(r["from"], r["to"]): r["weight"] for r in rows}
    f2 = expected_f2(g, {e: w[e] for e in g.normedges}, {n: w[g.up[n][0], n] for n in g.admixnodes})
    return noisy_blocks(spark.createDataFrame([(a, b, float(v)) for (a, b), v in f2.items()], "pop1 string, pop2 string, f2 double"), nblocks, cv, seed)


def leaf_heights(rows: list[dict]) -> dict[str, float]:
    """Heights of a weighted graph's nodes over its leaves."""
    return node_times(rows)
