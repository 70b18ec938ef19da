"""LEGOFIT models from weighted graphs, and fitted values back onto their edges.

An edge row is a dict as in ``formats``. A `.lgo` text declares times, sizes and mixture fractions, then a segment for each node.
Both parents of a mixture have to share one time, so each gets a ghost segment, named <node>_<parent>, at the time of the
admixture event; reading takes the ghosts out again.
"""
from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .formats import graph_of, read_bootci, read_fit, read_lgo, validate_edges

MODES = ("fix_admix", "init", "free")
#: coalescent depths up to which a split time is well, and weakly, recovered: with a leaf right below, and without
DEPTHS = {True: (5.0, 9.0), False: (4.0, 6.0)}
LARGE_TREE = 8


class InvalidInput(ValueError):
    """The graph or an argument can't be made into a model."""


def ghost(node: str, parent: str) -> str:
    return f"{node}_{parent}"


def scalar_or_named(value, names: Iterable[str], default=None) -> dict:
    """A value for each name: the same for all, or by name, unknown names being an error."""
    names = list(names)
    if not isinstance(value, dict):
        return dict.fromkeys(names, default if value is None else value)
    if unknown := sorted(set(value) - set(names)):
        raise InvalidInput(f"no such nodes: {unknown}")
    if default is None and (missing := sorted(set(names) - set(value))):
        raise InvalidInput(f"no value for {missing}")
    return {n: value.get(n, default) for n in names}


def admix_parents(rows: list[dict]) -> dict[str, tuple[str, str, float]]:
    """For each admixture node the parent of more weight, the one of less, and the lesser weight."""
    out = {}
    for n in graph_of(rows).admixnodes:
        a, b = sorted((r for r in rows if r["to"] == n), key=lambda r: -(r.get("weight") if r.get("weight") is not None else 0.5))
        low = b.get("weight")
        out[n] = a["from"], b["from"], 0.5 if low is None else low
    return out


def parameter_names(rows: list[dict]) -> dict[str, dict[str, str]]:
    """Names of time, twoN, mixFrac and admix_time parameters by node."""
    g = graph_of(rows)
    if clash := sorted(f"admix_{n}" for n in g.admixnodes if f"admix_{n}" in g.nodes):
        raise InvalidInput(f"T_{clash[0]} would be both a node's time and an event's")
    if clash := sorted(ghost(n, p) for n in g.admixnodes for p in g.up[n] if ghost(n, p) in g.nodes):
        raise InvalidInput(f"nodes are named like ghost segments: {clash}")
    return {"time": {n: f"T_{n}" for n in g.nodes}, "twoN": {n: f"twoN_{n}" for n in g.nodes}, "mixFrac": {n: f"m_{n}" for n in g.admixnodes}, "admix_time": {n: f"T_admix_{n}" for n in g.admixnodes}}


def twoN_declarations(nodes: list[str], twoN: dict | float | None) -> tuple[list[str], dict[str, str]]:
    """Lines, and the parameter of each node: one fixed at 1, one shared, or a free one for each node."""
    if twoN is None:
        return ["twoN fixed one=1"], dict.fromkeys(nodes, "one")
    if not isinstance(twoN, dict):
        return [f"twoN fixed shared={twoN:g}"], dict.fromkeys(nodes, "shared")
    sizes = scalar_or_named(twoN, nodes)
    return [f"twoN free twoN_{n}={v:g}" for n, v in sizes.items()], {n: f"twoN_{n}" for n in nodes}


def without_outgroup(rows: list[dict], outpop: str) -> list[dict]:
    """The edges without the outgroup and the root above it; the outgroup has to be one of the root's two children."""
    g = graph_of(rows)
    if outpop not in g.leaves or len(g.down[g.root]) != 2 or outpop not in g.down[g.root]:
        raise InvalidInput(f"{outpop} is not a leaf beside one other child of the root")
    return [r for r in rows if r["from"] != g.root]


def node_depths(rows: list[dict]) -> dict[str, int]:
    """Steps of the longest way down to a leaf."""
    g = graph_of(rows)
    if len(g.order) != len(g.nodes):
        raise InvalidInput("the graph has a cycle")
    depth: dict[str, int] = {}
    for n in reversed(g.order):
        depth[n] = max((depth[c] + 1 for c in g.down[n]), default=0)
    return depth


def walk_up(rows: list[dict], lengths: dict[tuple[str, str], float], leaf_times: dict[str, float], tol: float = 1e-6, strict: bool = False) -> dict[str, float]:
    """Times from the leaves up: the longest way down; with strict all ways have to agree within tol."""
    g = graph_of(rows)
    t: dict[str, float] = {}
    for n in reversed(g.order):
        ways = [t[c] + lengths[n, c] for c in g.down[n]]
        if strict and ways and max(ways) - min(ways) > tol:
            raise InvalidInput(f"the times of {n} by its children differ: {sorted(ways)}")
        t[n] = max(ways) if ways else leaf_times[n]
    return t


def times(rows: list[dict], mode: str = "fix_admix", dates: dict | float = 0.0, drift_to_time: Callable[[float], float] | None = None) -> dict[str, float]:
    """Starting times. free: steps above the leaves; init: drift as time, or an edge's own time where it has one; fix_admix: the
    same, admixture edges taking none."""
    if mode not in MODES:
        raise InvalidInput(f"{mode} is none of {MODES}")
    g = graph_of(rows)
    at = scalar_or_named(dates, g.leaves, 0.0)
    if mode == "free":
        return {n: at[n] if n in at else float(d) for n, d in node_depths(rows).items()}
    to_time = drift_to_time or (lambda x: x)
    length = {(r["from"], r["to"]): 0.0 if mode == "fix_admix" and r["type"] == "admix" else r["time"] if r.get("time") is not None else to_time(r.get("weight") or 0.0) for r in rows}
    return walk_up(rows, length, at)


def to_lgo(rows: list[dict], *, samples: dict | int = 1, dates: dict | float = 0.0, outpop: str | None = None, twoN: dict | float | None = None, time_handling: str = "fix_admix", drift_to_time: Callable[[float], float] | None = None, fix_times: bool = False, validate: bool = True) -> str:
    """The model as text: times of leaves are fixed, the others free unless fix_times."""
    validate_edges(rows)
    if outpop is not None:
        rows = without_outgroup(rows, outpop)
    g, names, pairs = graph_of(rows), parameter_names(rows), admix_parents(rows)
    at = times(rows, time_handling, dates, drift_to_time)
    sizes, size_of = twoN_declarations(g.nodes, twoN)
    counts = scalar_or_named(samples, g.leaves, 1)
    nodes = [*g.leaves, *(n for n in reversed(g.order) if g.down[n])]
    state = lambda n: "fixed" if fix_times or not g.down[n] else "free"
    out = ["# times"] + [f"time {state(n)} {names['time'][n]}={at[n]:.12g}" for n in nodes]
    out += [f"time {'fixed' if fix_times else 'free'} {names['admix_time'][n]}={at[high]:.12g}" for n, (high, _, _) in pairs.items()]
    out += ["# sizes", *sizes]
    out += [f"mixFrac free {names['mixFrac'][n]}={w:.12g}" for n, (_, _, w) in pairs.items()]
    out += ["# segments"] + [f"segment {n} t={names['time'][n]} twoN={size_of[n]}" + (f" samples={counts[n]}" if n in counts else "") for n in nodes]
    out += [f"segment {ghost(n, p)} t={names['admix_time'][n]} twoN={size_of[p]}" for n, (high, low, _) in pairs.items() for p in (high, low)]
    out += [f"derive {ghost(n, p)} from {p}" for n, (high, low, _) in pairs.items() for p in (high, low)]
    out += [f"derive {b} from {a}" for a, b in g.normedges]
    out += [f"mix {n} from {ghost(n, high)} + {names['mixFrac'][n]} * {ghost(n, low)}" for n, (high, low, _) in pairs.items()]
    text = "\n".join(out) + "\n"
    if validate:
        check_roundtrip(text, rows)
    return text


def from_lgo(text: str) -> tuple[list[dict], list[dict]]:
    """Edges and nodes of a text, ghosts taken out; nodes get the time of their admixture event."""
    edges, nodes = read_lgo(text)
    up = {e["to"]: e["from"] for e in edges if e["type"] != "admix"}
    by = {n["name"]: n for n in nodes}
    ghosts = {e["from"]: up[e["from"]] for e in edges if e["type"] == "admix" and e["from"] in up and e["from"] == ghost(e["to"], up[e["from"]])}
    out = []
    for e in edges:
        if e["to"] in ghosts:
            continue
        if e["from"] in ghosts:
            by[e["to"]]["admix_event_time"] = by[e["from"]].get("time")
            e = e | {"from": ghosts[e["from"]]}
        out.append(e)
    return out, [n for n in nodes if n["name"] not in ghosts]


def check_roundtrip(text: str, rows: list[dict]) -> None:
    got = {(e["from"], e["to"], e["type"] == "admix") for e in from_lgo(text)[0]}
    want = {(r["from"], r["to"], r["type"] == "admix") for r in rows}
    if got != want:
        raise InvalidInput(f"the text reads as another graph: {sorted(got ^ want)}")


# --- fitted values


def family(name: str) -> str:
    for start, kind in (("T_admix_", "admix_time"), ("T_", "time"), ("twoN", "twoN"), ("m_", "mixFrac")):
        if name.startswith(start):
            return kind
    return "twoN" if name in ("one", "shared") else "other"


def parameters(text: str, include_fixed: bool = True) -> list[dict]:
    """Rows of a fit's text: name, value, initial, free, family."""
    got = read_fit(text)
    return [{"name": n, "value": v, "initial": got["initial"].get(n), "free": n not in got["fixed"], "family": family(n)} for n, v in got["fitted"].items() if include_fixed or n not in got["fixed"]]


def onto_edges(params: list[dict], rows: list[dict]) -> list[dict]:
    """Edges with time and twoN of their end and, on admixture edges, the event's time and name and its fitted fraction."""
    v = {p["name"]: p["value"] for p in params}
    out = []
    for r in rows:
        n, adm = r["to"], r["type"] == "admix"
        size = v.get(f"twoN_{n}", v.get("shared", 1.0 if "one" in v else None))
        out.append(r | {"time": v.get(f"T_{n}"), "twoN": size, "admix_event_time": v.get(f"T_admix_{n}") if adm else None, "admix_prop": v.get(f"m_{n}") if adm else None, "admix_event": f"m_{n}" if adm else None})
    return out


def mismatches(params: list[dict], rows: list[dict], include_fixed: bool = True) -> dict[str, list[str]]:
    """Parameters that the graph wants and the fit hasn't, and the other way round. One size for all, or sizes of one, need no
    size a node; without fixed ones, leaves' times aren't wanted."""
    names, g = parameter_names(rows), graph_of(rows)
    have = {p["name"] for p in params}
    want = {x for k, m in names.items() for n, x in m.items() if not (k == "time" and not include_fixed and not g.down[n]) and not (k == "twoN" and not any(h.startswith("twoN_") for h in have))}
    return {"missing": sorted(want - have), "extra": sorted(have - want - {"one", "shared"})}


def identifiability(params: list[dict], rows: list[dict] | None = None) -> list[dict]:
    """parameter, family, identifiability: fixed; structural_none (an admixture event's time: its segment has one lineage);
    scale_degenerate (free times and free sizes: only their ratios are fitted); weak_identified or weak_unconstrained (a split
    many coalescent units deep, which comes out too low); identifiable."""
    free = [p for p in params if p.get("free", True)]
    scale = {p["family"] for p in free} >= {"time", "twoN"}
    v = {p["name"]: p["value"] for p in params}
    g = graph_of(rows) if rows else None
    out = []
    for p in params:
        kind = "identifiable"
        if not p.get("free", True):
            kind = "fixed"
        elif p["family"] == "admix_time":
            kind = "structural_none"
        elif scale and p["family"] in ("time", "twoN"):
            kind = "scale_degenerate"
        elif g is not None and p["family"] == "time":
            n = p["name"].removeprefix("T_")
            size = v.get(f"twoN_{n}", v.get("shared", 1.0))
            if n in g.down and size and math.isfinite(size) and size > 0:
                less = 1.0 if len(g.leaves) >= LARGE_TREE else 0.0
                well, weak = (x - less for x in DEPTHS[any(c in g.leaves for c in g.down[n])])
                deep = p["value"] / size
                kind = "weak_unconstrained" if deep > weak else "weak_identified" if deep > well else kind
        out.append({"parameter": p["name"], "family": p["family"], "identifiability": kind})
    return out


def read_output(text: str, rows: list[dict] | None = None, include_fixed: bool = True) -> dict:
    """A fit's text: parameters, convergence and, with the graph's edges, fitted edges, node times, mismatches and what is
    identified."""
    params, got = parameters(text, include_fixed), read_fit(text)
    out = {"parameters": params, "convergence": {k: got.get(k) for k in ("status", "cost", "spread")}, "identifiability": identifiability(params, rows)}
    if rows is not None:
        v = {p["name"]: p["value"] for p in params}
        out |= {"edges": onto_edges(params, rows), "node_times": {n: v.get(f"T_{n}") for n in graph_of(rows).nodes}, "mismatches": mismatches(params, rows, include_fixed)}
    return out


def read_bootstrap(text: str, rows: list[dict] | None = None) -> list[dict]:
    """Confidence intervals with families and, with the graph's edges, what is identified."""
    cis = [r | {"family": family(r["parameter"])} for r in read_bootci(text)]
    if rows is None:
        return cis
    kinds = {x["parameter"]: x["identifiability"] for x in identifiability([{"name": r["parameter"], "value": r["point_estimate"], "family": r["family"], "free": True} for r in cis], rows)}
    return [r | {"identifiability": kinds[r["parameter"]]} for r in cis]


def parameter_table(texts: DataFrame, text: str = "value") -> DataFrame:
    """A table of fits' texts, a text a row -> name, value, free, family, beside the other columns; parsed in JVM functions."""
    keep = [c for c in texts.columns if c != text]
    fitted = F.regexp_extract(text, r"(?s)Fitted parameter values(.*)", 1)
    rows = texts.select(*keep, F.split(fitted, r"Free:").alias("__part"))  # fixed ones come before it
    parts = rows.select(*keep, F.posexplode("__part").alias("__k", "__lines")).select(*keep, (F.col("__k") > 0).alias("free"), F.explode(F.split("__lines", r"\n")).alias("line"))
    name, value = (F.regexp_extract("line", r"^\s*([A-Za-z_][\w.]*)\s*=\s*([-+0-9.eE]+)\s*$", k) for k in (1, 2))
    kind = F.when(name.startswith("T_admix_"), "admix_time").when(name.startswith("T_"), "time").when(name.startswith("twoN") | name.isin("one", "shared"), "twoN").when(name.startswith("m_"), "mixFrac").otherwise("other")
    return parts.where(name != "").select(*keep, name.alias("name"), value.cast("double").alias("value"), "free", kind.alias("family"))


def is_lgo(text: str) -> bool:
    return bool(re.search(r"(?m)^segment\s+\S+", text))
