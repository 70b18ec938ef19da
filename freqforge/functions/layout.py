"""Where a graph's nodes and edges go on a plane, and what lies on top of each other, as data."""
from __future__ import annotations

import itertools

from .graph import Graph
from .topology import identify_edge  # noqa: F401  edges of simplified graphs are found in full ones


def node_places(g: Graph) -> dict[str, tuple[float, float]]:
    """x: leaves side by side in the order of a walk from the root, inner nodes over the middle of theirs; y: the height, leaves at
    0 and each node above all its children."""
    walk, seen = [], set()

    def visit(n: str) -> None:
        if n not in seen:
            seen.add(n)
            for c in sorted(g.down[n], key=lambda c: (len(g.up[c]), min(g.below[c]))):
                visit(c)
            if not g.down[n]:
                walk.append(n)

    visit(g.root)
    x = {n: float(i) for i, n in enumerate(walk)}
    y: dict[str, float] = {}
    for n in reversed(g.order):
        y[n] = max((y[c] + 1 for c in g.down[n]), default=0.0)
        if g.down[n]:
            x[n] = sum(x[c] for c in g.down[n]) / len(g.down[n])
    return {n: (x[n], y[n]) for n in g.nodes}


def plot_data(g: Graph, weights: dict | None = None, fix: bool = True) -> dict[str, list[dict]]:
    """nodes: name, x, y, leaf; edges: from, to, type, label and both ends."""
    at = untangled(g) if fix else node_places(g)
    label = lambda e: "" if not weights or e not in weights else f"{round(100 * weights[e])}%" if len(g.up[e[1]]) > 1 else f"{round(1000 * weights[e])}"
    edges = [{"from": a, "to": b, "type": "admix" if len(g.up[b]) > 1 else "normal", "label": label((a, b)), "x": at[a][0], "y": at[a][1], "xend": at[b][0], "yend": at[b][1]} for a, b in g.edges]
    return {"nodes": [{"name": n, "x": x, "y": y, "leaf": not g.down[n]} for n, (x, y) in at.items()], "edges": edges}


def crossing(p: tuple, q: tuple, r: tuple, s: tuple) -> bool:
    """Whether the inner parts of the segments pq and rs cross."""
    side = lambda a, b, c: (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])
    return side(p, q, r) * side(p, q, s) < 0 and side(r, s, p) * side(r, s, q) < 0


def num_crossings(g: Graph, at: dict[str, tuple[float, float]]) -> int:
    return sum(crossing(at[a], at[b], at[c], at[d]) for (a, b), (c, d) in itertools.combinations(g.edges, 2) if len({a, b, c, d}) == 4)


def num_same_place(at: dict[str, tuple[float, float]]) -> int:
    """Nodes that lie on another one."""
    return len(at) - len(set(at.values()))


def untangled(g: Graph, rounds: int = 3) -> dict[str, tuple[float, float]]:
    """Places with fewer crossings: subtrees of nodes with two children are mirrored as long as that helps."""
    at = node_places(g)
    cost = lambda p: num_crossings(g, p) + num_same_place(p)
    now = cost(at)
    for _ in range(rounds):
        before = now
        for n in g.order:
            if len(g.down[n]) < 2 or not now:
                continue
            under = [m for m in g.reach[n] if m != n]
            xs = [at[m][0] for m in under]
            flip = {m: (min(xs) + max(xs) - at[m][0], at[m][1]) for m in under}
            if (c := cost(at | flip)) < now:
                at, now = at | flip, c
        if now == before:
            break
    return at


def shift_down(g: Graph, at: dict[str, tuple[float, float]], node: str, by: float = 1.0) -> dict[str, tuple[float, float]]:
    """The subgraph from a node on, lower."""
    return at | {m: (at[m][0], at[m][1] - by) for m in g.reach[node]}


def collapse_edges(g: Graph, weights: dict, below: float = 0.0) -> Graph:
    """Drift edges no longer than a bound are contracted, their ends becoming one node named by all of them; leaves stay apart."""
    top: dict[str, str] = {n: n for n in g.nodes}

    def find(n: str) -> str:
        while top[n] != n:
            n = top[n]
        return n

    for a, b in g.normedges:
        if g.down[b] and weights.get((a, b), below + 1) <= below:
            top[find(b)] = find(a)
    names: dict[str, list[str]] = {}
    for n in g.nodes:
        names.setdefault(find(n), []).append(n)
    label = {r: ".".join(sorted(ns)) if len(ns) > 1 else ns[0] for r, ns in names.items()}
    return Graph((label[find(a)], label[find(b)]) for a, b in g.edges if find(a) != find(b))


def node_coordinates(g: Graph, leaves: dict[str, tuple[float, float]]) -> dict[str, tuple[float, float, float]]:
    """Longitude, latitude and height of each node: the mean of the leaves below, and the place over them."""
    y = {n: p[1] for n, p in node_places(g).items()}
    out = {}
    for n in g.nodes:
        known = [leaves[x] for x in g.below[n] if x in leaves]
        if known:
            out[n] = (sum(k[0] for k in known) / len(known), sum(k[1] for k in known) / len(known), y[n])
    return out
