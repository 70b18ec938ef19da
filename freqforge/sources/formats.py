"""Text formats of graphs and results: DOT, TreeMix, qpGraph, LEGOFIT, JSON, and parsers of fit outputs.

An edge row is a dict: from, to, type (normal or admix), weight and, where known, low, high, lower, upper.
"""
from __future__ import annotations

import ast
import gzip
import json
import math
import operator
import re
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.graph import Graph, newick_to_graph

JSON_VERSION = 1


def edge_rows(g: Graph, weights: dict | None = None) -> list[dict]:
    w = weights or {}
    return [{"from": a, "to": b, "type": "admix" if len(g.up[b]) > 1 else "normal", "weight": w.get((a, b), 0.5 if len(g.up[b]) > 1 else 0.01)} for a, b in g.edges]


def graph_of(rows: Iterable[dict]) -> Graph:
    return Graph((r["from"], r["to"]) for r in rows)


def validate_edges(rows: list[dict]) -> None:
    """Columns, types and exactly two admixture edges into each admixture node."""
    for r in rows:
        if not {"from", "to", "type"} <= r.keys() or r["type"] not in ("normal", "edge", "admix"):
            raise ValueError(f"not an edge row: {r}")
    into: dict[str, int] = {}
    for r in rows:
        if r["type"] == "admix":
            into[r["to"]] = into.get(r["to"], 0) + 1
    if wrong := {n: k for n, k in into.items() if k != 2}:
        raise ValueError(f"admixture nodes need two admixture edges: {wrong}")
    g = graph_of(rows)
    if len(g.order) != len(g.nodes):
        raise ValueError("the graph has a cycle")


# --- DOT

def write_dot(rows: list[dict], title: str = "", hide_weights: bool = False) -> str:
    leaves = set(graph_of(rows).leaves)
    out = ["digraph G {", f'label = "{title}";', 'size = "7.5,10";']
    for n in sorted({x for r in rows for x in (r["from"], r["to"])}):
        out.append(f'"{n}" [shape = {"box" if n in leaves else "point"}, label = "{n if n in leaves else ""}"];')
    for r in rows:
        admix = r["type"] == "admix"
        text = "" if hide_weights else f'{r["weight"] * 100:.0f}%' if admix else f'{r["weight"] * 1000:.0f}'
        out.append(f'"{r["from"]}" -> "{r["to"]}" [label = "{text}"{", style = dotted" if admix else ""}];')
    return "\n".join([*out, "}"]) + "\n"


def parse_dot(text: str) -> list[dict]:
    out = []
    for m in re.finditer(r'"?([^\s"\[;{}]+)"?\s*->\s*"?([^\s"\[;{}]+)"?\s*(?:\[([^\]]*)\])?', text):
        attrs = m[3] or ""
        label = re.search(r'label\s*=\s*"?([-\d.]+)(%?)', attrs)
        admix = "dotted" in attrs or "dashed" in attrs
        weight = None if not label else float(label[1]) / (100 if label[2] else 1000)
        out.append({"from": m[1], "to": m[2], "type": "admix" if admix else "normal", "weight": weight})
    return out


# --- TreeMix

def geno_to_treemix(counts: DataFrame, pops: list[str], path: str) -> None:
    """counts: variant_idx and, a column a population, struct(alt, total); a line a variant, gzip text."""
    cells = [F.concat(F.col(f"`{p}`.alt").cast("string"), F.lit(","), (F.col(f"`{p}`.total") - F.col(f"`{p}`.alt")).cast("string")) for p in pops]
    head = counts.sparkSession.createDataFrame([(-1, " ".join(pops))], "variant_idx long, value string")
    body = counts.select(F.col("variant_idx").cast("long").alias("variant_idx"), F.concat_ws(" ", *cells).alias("value"))
    head.unionByName(body).repartitionByRange("variant_idx").sortWithinPartitions("variant_idx").select("value").write.mode("overwrite").option("compression", "gzip").text(path)


def write_treemix(rows: list[dict], stem: str) -> None:
    g = graph_of(rows)
    number = {n: i for i, n in enumerate(g.order)}
    with gzip.open(stem + ".vertices.gz", "wt") as f:
        for n in g.order:
            tip = not g.down[n]
            f.write(f"{number[n]} {n if tip else 'NA'} {'ROOT' if not g.up[n] else 'NOT_ROOT'} {'MIG' if len(g.up[n]) > 1 else 'NOT_MIG'} {'TIP' if tip else 'NOT_TIP'} {number[g.up[n][0]] if g.up[n] else number[n]}\n")
    with gzip.open(stem + ".edges.gz", "wt") as f:
        for r in rows:
            admix = r["type"] == "admix"
            f.write(f"{number[r['from']]} {number[r['to']]} {0 if admix else r['weight']} {r['weight'] if admix else 1} {'MIG' if admix else 'NOT_MIG'}\n")


def read_treemix(stem: str) -> list[dict]:
    names = {}
    with gzip.open(stem + ".vertices.gz", "rt") as f:
        for line in f:
            p = line.split()
            names[p[0]] = p[1] if p[1] != "NA" else f"n{p[0]}"
    with gzip.open(stem + ".edges.gz", "rt") as f:
        return [{"from": names[p[0]], "to": names[p[1]], "type": "admix" if p[4] == "MIG" else "normal", "weight": float(p[3] if p[4] == "MIG" else p[2])} for p in map(str.split, f)]


def parse_treeout(text: str) -> tuple[Graph, list[tuple[frozenset, frozenset, float]]]:
    """Newick line and migration lines: the tree and (leaves under source, leaves under target, weight)."""
    first, *rest = text.strip().splitlines()
    strip = lambda s: re.sub(r":[-\d.eE+]+", "", s)
    moves = []
    for line in rest:
        p = line.split()
        a, b = (frozenset(re.findall(r"[^(),;:\s]+", strip(x))) for x in p[-2:])
        moves.append((a, b, float(p[0])))
    return newick_to_graph(strip(first)), moves


# --- qpGraph

def write_qpgraph(rows: list[dict], sep: str = "\t", locks: bool = False) -> str:
    g = graph_of(rows)
    out = [f"root{sep}{g.root}"] + [f"label{sep}{x}{sep}{x}" for x in g.leaves]
    w = {(r["from"], r["to"]): r for r in rows}
    k = 0
    for a, b in g.normedges:
        k += 1
        r = w[a, b]
        lock = f"{sep}lock{sep}{r['lower']}{sep}{r['upper']}" if locks and "lower" in r else ""
        out.append(f"edge{sep}e{k}{sep}{a}{sep}{b}{lock}")
    for n in g.admixnodes:
        p, q = g.up[n]
        out.append(f"admix{sep}{n}{sep}{p}{sep}{q}{sep}{round(100 * w[p, n]['weight'])}{sep}{round(100 * w[q, n]['weight'])}")
    return "\n".join(out) + "\n"


def parse_qpgraph(text: str, uselabels: bool = False) -> list[dict]:
    labels, out = {}, []
    for line in text.splitlines():
        p = line.split()
        if not p or p[0].startswith("#"):
            continue
        if p[0] in ("label", "vertex") and len(p) >= 3:
            labels[p[2]] = p[1]
        elif p[0] in ("edge", "ledge", "redge"):
            row = {"from": p[2], "to": p[3], "type": "normal", "weight": float(p[4]) if len(p) > 4 and re.fullmatch(r"[-\d.eE+]+", p[4]) else None}
            if "lock" in p:
                row["lower"], row["upper"] = float(p[p.index("lock") + 1]), float(p[p.index("lock") + 2])
            out.append(row)
        elif p[0] == "admix":
            w = [float(x) / 100 if float(x) > 1 else float(x) for x in p[4:6]] if len(p) > 5 else [0.5, 0.5]
            out += [{"from": q, "to": p[1], "type": "admix", "weight": v} for q, v in zip(p[2:4], w)]
    if uselabels:
        out = [r | {"from": labels.get(r["from"], r["from"]), "to": labels.get(r["to"], r["to"])} for r in out]
    return out


def parse_parfile(text: str) -> dict[str, str]:
    pairs = [line.split("#")[0].split(":", 1) for line in text.splitlines()]
    return {p[0].strip(): p[1].strip() for p in pairs if len(p) == 2}


def parse_result_lines(text: str, mark: str = "result:") -> list[list[str]]:
    return [line.split()[1:] for line in text.splitlines() if line.strip().startswith(mark)]


def parse_qp3pop(text: str) -> list[dict]:
    return [dict(zip(("pop1", "pop2", "pop3"), r[:3])) | {"est": float(r[3]), "se": float(r[4]), "z": float(r[5]), "n": int(float(r[6]))} for r in parse_result_lines(text)]


def parse_qpdstat(text: str) -> list[dict]:
    out = []
    for r in parse_result_lines(text):
        nums = [float(x) for x in r[4:] if re.fullmatch(r"[-\d.eE+]+", x)]
        row = dict(zip(("pop1", "pop2", "pop3", "pop4"), r[:4])) | {"est": nums[0]}
        out.append(row | ({"se": nums[1], "z": nums[2]} if len(nums) > 5 else {"z": nums[1]}) | {"n": int(nums[-1])})
    return out


def parse_qpf4ratio(text: str) -> list[dict]:
    out = []
    for r in parse_result_lines(text):
        names = [x for x in r if x != ":" and not re.fullmatch(r"[-\d.]+", x)]
        nums = [float(x) for x in r if re.fullmatch(r"[-\d.]+", x)]
        out.append({f"pop{i + 1}": n for i, n in enumerate(dict.fromkeys(names))} | {"alpha": nums[0], "se": nums[1], "z": nums[2]})
    return out


# --- JSON

def _plain(x):
    if isinstance(x, DataFrame):
        return [_plain(r.asDict(True)) for r in x.collect()]  # results to be printed
    if isinstance(x, float) and not math.isfinite(x):
        return None
    if isinstance(x, dict):
        return {k: _plain(v) for k, v in x.items()}
    if isinstance(x, list | tuple):
        return [_plain(v) for v in x]
    return x


def result_to_json(result, fn: str | None = None, args: dict | None = None, pretty: bool = False) -> str:
    return json.dumps({"schema_version": JSON_VERSION, "function": fn, "args": args or {}, "result": _plain(result)}, indent=2 if pretty else None, default=str)


# --- LEGOFIT

_OPS = {ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.Div: operator.truediv, ast.Pow: operator.pow, ast.USub: operator.neg, ast.UAdd: operator.pos}


def arithmetic(expr: str, env: dict[str, float]) -> float:
    """Numbers, names of env, + - * / ** and parentheses; anything else is an error."""
    def ev(n):
        if isinstance(n, ast.Expression):
            return ev(n.body)
        if isinstance(n, ast.Constant) and isinstance(n.value, int | float):
            return float(n.value)
        if isinstance(n, ast.Name):
            return env[n.id]
        if isinstance(n, ast.BinOp) and type(n.op) in _OPS:
            return _OPS[type(n.op)](ev(n.left), ev(n.right))
        if isinstance(n, ast.UnaryOp) and type(n.op) in _OPS:
            return _OPS[type(n.op)](ev(n.operand))
        raise ValueError(f"not allowed in an expression: {ast.dump(n)}")
    return ev(ast.parse(expr.replace("^", "**").strip(), mode="eval"))


def node_times(rows: list[dict], leaf_times: dict[str, float] | float = 0.0) -> dict[str, float]:
    """Heights from the leaves up: the longest way down, by edge weights."""
    g = graph_of(rows)
    w = {(r["from"], r["to"]): 0.0 if r["type"] == "admix" else float(r.get("weight") or 0.0) for r in rows}
    t: dict[str, float] = {}
    for n in reversed(g.order):
        t[n] = max((t[c] + w[n, c] for c in g.down[n]), default=leaf_times.get(n, 0.0) if isinstance(leaf_times, dict) else leaf_times)
    return t


def graph_to_lgo(rows: list[dict], samples: dict[str, int] | int = 1, dates: dict[str, float] | float = 0.0, twoN: float = 1.0, fix_times: bool = False) -> str:
    """Time, population size and mixture declarations, segments, derivations and mixtures."""
    validate_edges(rows)
    g = graph_of(rows)
    t = node_times(rows, dates)
    kind = "fixed" if fix_times else "free"
    out = ["# graph"]
    for n in g.order[::-1]:
        out.append(f"time {'fixed' if not g.down[n] or not t[n] else kind} T_{n} = {t[n]:g}")
    out += [f"twoN free twoN_{n} = {twoN:g}" for n in g.order[::-1]]
    w = {(r["from"], r["to"]): r.get("weight") for r in rows}
    out += [f"mixFrac free m_{n} = {w[g.up[n][1], n] if w[g.up[n][1], n] is not None else 0.5:g}" for n in g.admixnodes]
    for n in g.order[::-1]:
        k = samples.get(n, 1) if isinstance(samples, dict) else samples
        out.append(f"segment {n} t=T_{n} twoN=twoN_{n}" + (f" samples={k}" if not g.down[n] else ""))
    for n in g.admixnodes:
        p, q = g.up[n]
        out.append(f"mix {n} from {p} + m_{n} * {q}")
    out += [f"derive {b} from {a}" for a, b in g.normedges]
    return "\n".join(out) + "\n"


def read_lgo(text: str) -> tuple[list[dict], list[dict]]:
    """Edges and nodes of a .lgo text."""
    joined, env, nodes, edges = [], {}, {}, []
    for line in text.splitlines():
        line = line.split("#")[0].rstrip()
        if joined and re.search(r"[-+*/]$", joined[-1]):
            joined[-1] += " " + line.strip()
        elif line.strip():
            joined.append(line.strip())
    for line in joined:
        p = line.split()
        if p[0] in ("time", "twoN", "mixFrac", "param"):
            name, value = (x.strip() for x in re.sub(r"^\w+\s+(free|fixed|constrained)\s+", "", line).split("=", 1))
            env[name] = arithmetic(value, env)
        elif p[0] == "segment":
            a = dict(re.findall(r"(\w+)\s*=\s*([^\s]+)", line))
            nodes[p[1]] = {"name": p[1], "samples": int(a["samples"]) if "samples" in a else None, "twoN_param": a.get("twoN"), "twoN": env.get(a.get("twoN")), "time_param": a.get("t"), "time": env.get(a.get("t"))}
        elif p[0] == "derive":
            edges.append({"from": p[3], "to": p[1], "type": "normal"})
        elif p[0] == "mix":
            m = re.match(r"mix\s+(\S+)\s+from\s+(\S+)\s*\+\s*(\S+)\s*\*\s*(\S+)", line)
            f = env[m[3]] if m[3] in env else float(m[3])
            edges += [{"from": m[2], "to": m[1], "type": "admix", "weight": 1 - f}, {"from": m[4], "to": m[1], "type": "admix", "weight": f}]
    for e in edges:
        if e["type"] == "normal" and nodes.get(e["from"], {}).get("time") is not None and nodes.get(e["to"], {}).get("time") is not None:
            e["weight"] = nodes[e["from"]]["time"] - nodes[e["to"]]["time"]
    return edges, list(nodes.values())


def parameter_family(name: str) -> str:
    """time, twoN, mixfrac or other, by the name's start."""
    return "time" if name.startswith("T_") else "twoN" if name.startswith("twoN") else "mixfrac" if name.startswith("m_") else "other"


def read_fit(text: str) -> dict:
    """Initial and fitted parameters (fixed or free), and how the optimiser ended."""
    out, part, state = {"initial": {}, "fitted": {}, "fixed": set()}, None, None
    for line in text.splitlines():
        if m := re.match(r"\s*(Initial|Fitted) parameter values", line):
            part = m[1].lower()
        elif re.match(r"\s*Fixed:?\s*$", line):
            state = "fixed"
        elif re.match(r"\s*Free:?\s*$", line):
            state = "free"
        elif part and (m := re.match(r"\s*([\w.]+)\s*=\s*([-+\d.eE]+)\s*$", line)):
            out[part][m[1]] = float(m[2])
            if state == "fixed":
                out["fixed"].add(m[1])
        elif m := re.search(r"DiffEv\s+(\S+)\.\s*cost=\s*([-+\d.eE]+)\s+spread=\s*([-+\d.eE]+)", line):
            out |= {"status": m[1], "cost": float(m[2]), "spread": float(m[3])}
    return out


def read_bootci(text: str) -> list[dict]:
    rows = [x.split() for x in text.splitlines() if x.strip() and not x.startswith("#")]
    head = rows[0]
    out = []
    for r in rows[1:]:
        d = dict(zip(head, r))
        out.append({"parameter": d["par"], "family": parameter_family(d["par"]), "point_estimate": float(d["est"]), "lo": float(d["low"]), "hi": float(d["high"])} | ({"lbl": d["lbl"]} if "lbl" in d else {}))
    return out


def read_patterns(text: str) -> dict[str, float]:
    """Site patterns: pattern and probability."""
    return {p[0]: float(p[1]) for p in (x.split() for x in text.splitlines() if x.strip() and not x.startswith("#"))}
