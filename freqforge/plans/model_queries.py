"""Registered queries of models and graphs; most have no SQL and are tested against closed forms."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import graph as G
from ..operators import edges as X
from ..operators import fstats as S
from ..operators import fitted as V
from ..operators import graphfit as T
from ..operators import models as M
from ..operators import resample as R
from ..operators import resampled as Z
from ..sources.cache import written
from .queries import _SYM, CTE, POPS, _f4sql, _jack, af_of, query, stat

A, B, C, D, E = POPS
GRAPH = G.Graph([("R", A), ("R", "u"), ("u", "v"), ("u", "w"), ("v", B), ("w", C), ("v", "m"), ("w", "m"), ("m", D), ("w", "x"), ("x", E)])
TREE = G.newick_to_graph(f"({A},(({B},{C}),({D},{E})))")
_TREE = "tr(f, t) AS (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in TREE.edges) + ")"
_GR = "tr(f, t) AS (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in G.simplify(GRAPH).edges) + ")"

#: Both graphs: ge (edges, admixture edges marked), le (leaves), te (the edges that embedded tree k keeps; one admixture node at
#: most), tc (k, a, t: t is a or below it).
_TWO_GRAPHS = """ge(i, f, t, adm) AS (SELECT *, count(*) OVER (PARTITION BY i, t) > 1 FROM (VALUES %s) v(i, f, t)), le AS (SELECT DISTINCT i, t AS x FROM ge WHERE NOT EXISTS (SELECT 1 FROM ge z WHERE z.i = ge.i AND z.f = ge.t)),
te AS (SELECT i, k, f, t FROM (SELECT *, row_number() OVER (PARTITION BY i, t ORDER BY f) AS o FROM ge) e JOIN (SELECT i, unnest(CASE WHEN bool_or(adm) THEN [1, 2] ELSE [1] END) AS k FROM ge GROUP BY i) USING (i) WHERE NOT adm OR o = k),
tc(i, k, a, t) AS (SELECT DISTINCT i, k, t, t FROM te UNION SELECT te.i, te.k, te.f, tc.t FROM tc JOIN te ON te.i = tc.i AND te.k = tc.k AND te.t = tc.a)""" % ", ".join(
    f"(CAST({i} AS BIGINT), '{a}', '{b}')" for i, g in enumerate((TREE, G.simplify(GRAPH))) for a, b in g.edges)


def _f2(spark, d, kind="f2"):
    """The block table, written once: models read it several times."""
    x = written(stat(spark, d, kind), "f2-blocks")
    return S.scale_ap(x) if kind == "ap" else x


# Grids of one or two cells have closed forms: their SQL knows nothing of factors, iterations or solvers.

_F = M.FUDGE


def _cells(models: list[tuple]) -> str:
    """cells(m, k, pop1..pop4) of (first, left after the first, right) a model."""
    rows = []
    for m, (first, left, right) in enumerate(models):
        grid = [(first, x, right[0], y) for x in left for y in right[1:]]
        rows += [(m, k + 1, *c) for k, c in enumerate(grid)]
    return "cells(m, k, pop1, pop2, pop3, pop4) AS (VALUES " + ", ".join(str(r) for r in rows) + ")"


def _grid_sql(models: list[tuple]) -> str:
    """CTEs lo (m, b, r, l1, l2), gs (m, nb, e1, e2, s11, s12, s22: jackknifed cells and the covariance; f11, f22, det: with the
    fudge), r0 (chi square of rank 0) and, for two sources, r1 (y1, y2: the fitted factor; w1, w2; chi square of rank 1)."""
    return f"""{CTE}, {_SYM}, {_cells(models)},
g0 AS (SELECT m, k, p.b, (p.a + q.a - r.a - s.a) / 2 AS est, p.n FROM cells JOIN sy p ON p.x = pop1 AND p.y = pop4 JOIN sy q ON q.x = pop2 AND q.y = pop3 AND q.b = p.b
JOIN sy r ON r.x = pop1 AND r.y = pop3 AND r.b = p.b JOIN sy s ON s.x = pop2 AND s.y = pop4 AND s.b = p.b),
g1 AS (SELECT m, b, max(est) FILTER (k = 1) AS x1, coalesce(max(est) FILTER (k = 2), 0) AS x2, max(n) AS n FROM g0 WHERE est IS NOT NULL GROUP BY m, b HAVING count(*) = (SELECT max(c.k) FROM cells c WHERE c.m = g0.m)),
g2 AS (SELECT *, n * 1e0 / sum(n) OVER (PARTITION BY m) AS r, sum(x1 * n) OVER (PARTITION BY m) / sum(n) OVER (PARTITION BY m) AS t1, sum(x2 * n) OVER (PARTITION BY m) / sum(n) OVER (PARTITION BY m) AS t2 FROM g1),
lo AS (SELECT *, (t1 - x1 * r) / (1 - r) AS l1, (t2 - x2 * r) / (1 - r) AS l2 FROM g2),
g3 AS (SELECT *, sum(t1 - l1) OVER (PARTITION BY m) + sum(r * l1) OVER (PARTITION BY m) AS e1, sum(t2 - l2) OVER (PARTITION BY m) + sum(r * l2) OVER (PARTITION BY m) AS e2 FROM lo),
g4 AS (SELECT *, ((1 / r) * e1 - (1 / r - 1) * l1 - t1) / sqrt(1 / r - 1) AS d1, ((1 / r) * e2 - (1 / r - 1) * l2 - t2) / sqrt(1 / r - 1) AS d2 FROM g3),
g5 AS (SELECT m, count(*) AS nb, any_value(e1) AS e1, any_value(e2) AS e2, avg(d1 * d1) AS s11, avg(d1 * d2) AS s12, avg(d2 * d2) AS s22 FROM g4 GROUP BY m),
g6 AS (SELECT *, s11 + {_F} * (s11 + s22) AS f11, s22 + {_F} * (s11 + s22) AS f22 FROM g5),
gs AS (SELECT *, f11 * f22 - s12 * s12 AS det FROM g6),
r0 AS (SELECT m, CASE WHEN s22 = 0 THEN e1 * e1 / f11 ELSE (f22 * e1 * e1 - 2 * s12 * e1 * e2 + f11 * e2 * e2) / det END AS chisq FROM gs),
y0 AS (SELECT *, {_F} * (f11 + f22) / det AS la FROM gs WHERE s22 > 0),
y1 AS (SELECT *, (1 + la * f11) * (1 + la * f22) - la * la * s12 * s12 AS dd FROM y0),
y2 AS (SELECT *, ((1 + la * f22) * e1 - la * s12 * e2) / dd AS y1, ((1 + la * f11) * e2 - la * s12 * e1) / dd AS y2 FROM y1),
y3 AS (SELECT *, y2 / (y2 - y1) AS w1, y1 / (y1 - y2) AS w2, (f22 * y1 * e1 - s12 * (y1 * e2 + y2 * e1) + f11 * y2 * e2) / ((f22 * y1 * y1 - 2 * s12 * y1 * y2 + f11 * y2 * y2) * {1 + _F}) AS c FROM y2),
r1 AS (SELECT *, (f22 * (e1 - c * y1) * (e1 - c * y1) - 2 * s12 * (e1 - c * y1) * (e2 - c * y2) + f11 * (e2 - c * y2) * (e2 - c * y2)) / det AS chisq FROM y3)"""


def _tail1(chisq: str) -> str:
    """Upper tail of a chi square of one degree, by Simpson's rule."""
    return f"(SELECT 1 - sqrt(2 / pi() * {chisq}) / 6000 * sum(CASE WHEN k IN (0, 2000) THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END * exp(-{chisq} * (k / 2000e0) * (k / 2000e0) / 2)) FROM range(0, 2001) t(k))"


_RCOND = "((s11 + s22) - sqrt((s11 - s22) * (s11 - s22) + 4 * s12 * s12)) / ((s11 + s22) + sqrt((s11 - s22) * (s11 - s22) + 4 * s12 * s12))"


@query(f"""SELECT CAST(m AS INT) AS model, '{A}' AS target, s.source, round(w, 9) AS weight, round(se, 9) AS se, round(w / se, 9) AS z, round({_RCOND}, 9) AS rcond FROM r1 JOIN
(SELECT m, '{B}' AS source, any_value(w1) AS w, stddev_samp(v) * sqrt(count(*) - 1) AS se FROM wl GROUP BY m UNION ALL SELECT m, '{C}', any_value(w2), stddev_samp(1 - v) * sqrt(count(*) - 1) FROM wl GROUP BY m) s USING (m) WHERE m = 0
UNION ALL SELECT 1, '{E}', '{B}', 1e0, 0e0, NULL, round({_RCOND}, 9) FROM gs WHERE m = 1""",
       _grid_sql([(A, [B, C], [D, E]), (E, [B], [A, C, D])]) + """,
wy AS (SELECT r1.m, w1, w2, ((1 + la * f22) * l1 - la * s12 * l2) / dd AS z1, ((1 + la * f11) * l2 - la * s12 * l1) / dd AS z2 FROM r1 JOIN lo ON lo.m = r1.m AND r1.m = 0),
wl AS (SELECT m, w1, w2, z2 / (z2 - z1) AS v FROM wy)""")
def qpadm_weights(spark, d):
    f = _f2(spark, d, "ap")
    return M.qpadm(f, M.models_table(f, [{"target": A, "left": [B, C], "right": [D, E]}, {"target": E, "left": [B], "right": [A, C, D]}]))


@query("""SELECT 0 AS model, 0 AS f4rank, 2 AS dof, round(chisq, 9) AS chisq, round(exp(-chisq / 2), 9) AS p, CAST(NULL AS DOUBLE) AS dofdiff, CAST(NULL AS DOUBLE) AS chisqdiff, CAST(NULL AS DOUBLE) AS p_nested FROM r0 WHERE m = 0
UNION ALL SELECT 1, 0, 2, round(chisq, 9), round(exp(-chisq / 2), 9), NULL, NULL, NULL FROM r0 WHERE m = 1
UNION ALL SELECT 1, 1, 0, round(r1.chisq, 9), NULL, 2e0, round(r0.chisq - r1.chisq, 9), round(exp((r1.chisq - r0.chisq) / 2), 9) FROM r1 JOIN r0 USING (m) WHERE m = 1""",
       _grid_sql([(A, [B], [C, D, E]), (A, [B, C], [D, E])]))
def qpwave_ranks(spark, d):
    f = _f2(spark, d, "ap")
    return M.qpwave(f, M.models_table(f, [{"left": [A, B], "right": [C, D, E]}, {"left": [A, B, C], "right": [D, E]}])).drop("target").withColumn("dofdiff", F.col("dofdiff").cast("double"))


@query(f"""SELECT '00' AS pat, 0 AS wt, 0 AS dof, round(chisq, 9) AS chisq, CAST(NULL AS DOUBLE) AS p, 1 AS f4rank, w1 BETWEEN 0 AND 1 AND w2 BETWEEN 0 AND 1 AS feasible, TRUE AS best FROM r1 WHERE m = 0
UNION ALL SELECT pat, 1, 1, round(q, 9), round({_tail1('q')}, 9), 0, TRUE, q = min(q) OVER () FROM (SELECT '01' AS pat, e1 * e1 / f11 AS q FROM gs UNION ALL SELECT '10', e2 * e2 / f22 FROM gs) u""", _grid_sql([(A, [B, C], [D, E])]))
def qpadm_popdrop(spark, d):
    f = _f2(spark, d, "ap")
    return M.qpadm_popdrop(f, M.models_table(f, [{"target": A, "left": [B, C], "right": [D, E]}])).select("pat", "wt", "dof", "chisq", "p", "f4rank", "feasible", "best")


@query(f"SELECT CAST(m AS INT) AS model, '{A}' AS target, 0 AS f4rank, 2 AS dof, round(chisq, 9) AS chisq, round(exp(-chisq / 2), 9) AS p, TRUE AS feasible FROM r0",
       _grid_sql([(A, [x], [y for y in POPS[1:] if y != x]) for x in POPS[1:]]))
def qpadm_rotate(spark, d):
    return M.qpadm_rotate(_f2(spark, d, "ap"), [B, C, D, E], A).select("model", "target", "f4rank", "dof", "chisq", "p", "feasible")


@query(f"""SELECT 'one' AS source_set, 'r' AS right_set, 0 AS f4rank, 1 AS dof, round(chisq, 9) AS chisq, round({_tail1('chisq')}, 9) AS p, TRUE AS feasible FROM r0 WHERE m = 0
UNION ALL SELECT 'two', 'r', 1, 0, round(chisq, 9), NULL, w1 BETWEEN 0 AND 1 AND w2 BETWEEN 0 AND 1 FROM r1 WHERE m = 1""", _grid_sql([(A, [B], [D, E]), (A, [B, C], [D, E])]))
def qpadm_sweep(spark, d):
    return M.qpadm_sweep(_f2(spark, d, "ap"), [A], {"one": [B], "two": [B, C]}, {"r": [D, E]}).select("source_set", "right_set", "f4rank", "dof", "chisq", "p", "feasible")


@query(f"SELECT pop1, pop2, round(chisq, 9) AS chisq, round(exp(-chisq / 2), 9) AS p FROM r0, (VALUES ('{A}', '{B}'), ('{B}', '{A}')) v(pop1, pop2)", _grid_sql([(A, [B], [C, D, E])]))
def qpwave_pairs(spark, d):
    return M.qpwave_pairs(_f2(spark, d, "ap"), [A, B], [C, D, E])


_LAZ = f"""{CTE}, {_SYM}, rt(p) AS (VALUES ('{C}'), ('{D}'), ('{E}')), tr AS (SELECT a.p AS p2, b.p AS p3, c.p AS p4 FROM rt a, rt b, rt c WHERE b.p < c.p AND a.p <> b.p AND a.p <> c.p),
po(i, p1) AS (VALUES (0, '{A}'), (1, '{B}'), (2, '{C}')),
z0 AS (SELECT i, p2, p3, p4, p.b, (p.e + q.e - r.e - s.e) / 2 AS est, p.n FROM po, tr JOIN sy p ON p.x = p1 AND p.y = p4 JOIN sy q ON q.x = p2 AND q.y = p3 AND q.b = p.b JOIN sy r ON r.x = p1 AND r.y = p3 AND r.b = p.b JOIN sy s ON s.x = p2 AND s.y = p4 AND s.b = p.b),
z1 AS (SELECT *, n * 1e0 / sum(n) OVER (PARTITION BY i, p2, p3, p4) AS r, sum(est * n) OVER (PARTITION BY i, p2, p3, p4) / sum(n) OVER (PARTITION BY i, p2, p3, p4) AS tot FROM z0),
z2 AS (SELECT i, p2, p3, p4, b, r, (tot - est * r) / (1 - r) AS v FROM z1 UNION ALL SELECT DISTINCT i, p2, p3, p4, CAST(-1 AS INT), CAST(0 AS DOUBLE), tot FROM z1),
z3 AS (SELECT p2, p3, p4, b, any_value(r) AS r, max(v) FILTER (i = 0) AS y, max(v) FILTER (i = 1) AS s, max(v) FILTER (i = 2) AS t FROM z2 GROUP BY p2, p3, p4, b),
z4 AS (SELECT b, any_value(r) AS r, 1e-12 * sum(s * s + t * t) AS ri, sum((s - t) * (y - t)) AS nu, sum((s - t) * (s - t)) AS de FROM z3 GROUP BY b),
z5 AS (SELECT b, r, greatest(0, least(1, (nu + ri) / (de + 2 * ri))) AS w FROM z4),
z6 AS (SELECT any_value(w) AS w FROM z5 WHERE b = -1),
z7 AS (SELECT sqrt(avg((w - mu) * (w - mu) * (1 / r - 1))) AS se FROM z5, (SELECT avg(w) AS mu FROM z5 WHERE b >= 0) x WHERE b >= 0)"""


@query(f"""SELECT 0 AS model, '{A}' AS target, source, round(v, 9) AS weight, round(se, 9) AS se, round(v / se, 9) AS z
FROM z7, (SELECT '{B}' AS source, w AS v FROM z6 UNION ALL SELECT '{C}', 1 - w FROM z6) x""", _LAZ)
def lazadm_weights(spark, d):
    f = _f2(spark, d)
    return M.lazadm(f, M.models_table(f, [{"target": A, "left": [B, C], "right": [C, D, E]}]))


# A complete design is symmetric in the five populations: f2 tables that are sums of a value a population have eigenvalue 1 in it,
# tables without such a part have 4, so the ridge shrinks the two parts by 1 / (1 + ridge) and 4 / (4 + ridge).
@query("SELECT CAST(b AS INT) AS block, pop1, pop2, round(y - sum(y * n) OVER w / sum(n) OVER w + sum(f2 * n) OVER w / sum(n) OVER w, 9) AS est, n AS n_snps FROM m2 WINDOW w AS (PARTITION BY pop1, pop2)",
       f"""{CTE}, m0 AS (SELECT pb.b, pop1, pop2, f2, n_snps AS n FROM pb JOIN bn ON bn.b = pb.b WHERE pop1 < pop2), mv AS (SELECT b, p, sum(f2) AS s FROM (SELECT b, pop1 AS p, f2 FROM m0 UNION ALL SELECT b, pop2, f2 FROM m0) GROUP BY b, p),
m1 AS (SELECT m0.*, (x.s + z.s) / 3 - sum(f2) OVER (PARTITION BY m0.b) / 6 AS part FROM m0 JOIN mv x ON x.b = m0.b AND x.p = pop1 JOIN mv z ON z.b = m0.b AND z.p = pop2),
m2 AS (SELECT *, part / 1.00001e0 + (f2 - part) * 4 / 4.00001e0 AS y FROM m1)""")
def smoothed_f2(spark, d):
    f = _f2(spark, d)
    combs = [(a, b, a, b) for a, b in S.popcombs(POPS, 2)] + S.popcombs(POPS, 4)
    return M.smooth_f2(S.f4_blocks(f, S.combs_table(f, combs)), POPS, f.where("pop1 < pop2"))


@query()
def graph_fit(spark, d):
    s = T.f3_stats(_f2(spark, d), POPS)
    return T.qpgraph(T.graphs_table(spark, [TREE, G.simplify(GRAPH)]), s, starts=3)


@query()
def graph_f3_residuals(spark, d):
    return T.qpgraph_f3(T.graphs_table(spark, [TREE]), T.f3_stats(_f2(spark, d), POPS))


@query()
def graph_resample(spark, d):
    return T.qpgraph_resample(T.graphs_table(spark, [TREE]), T.f3_stats(_f2(spark, d), POPS), nboot=8)


@query()
def graph_search(spark, d):
    return T.find_graphs(spark, T.f3_stats(_f2(spark, d), POPS), numgraphs=4, stop_gen=3, starts=1).drop("edges")


@query(f"SELECT 0 AS graph_id, a AS node, t AS leaf FROM cl WHERE t NOT IN (SELECT f FROM tr) AND a IN (SELECT f FROM tr)".replace("0 AS graph_id", "CAST(0 AS BIGINT) AS graph_id"),
       f"{_GR}, cl(a, t) AS (SELECT f, t FROM tr UNION SELECT cl.a, tr.t FROM cl JOIN tr ON tr.f = cl.t)")
def graph_descendants(spark, d):
    return T.summaries(T.graphs_table(spark, [G.simplify(GRAPH)]), "descendants")


@query("SELECT CAST(0 AS BIGINT) AS graph_id, t AS pop, CAST(max(k) AS INT) AS n FROM pa WHERE t NOT IN (SELECT f FROM tr) GROUP BY t",
       f"{_GR}, ad AS (SELECT t FROM tr GROUP BY t HAVING count(*) = 2), pa(t, k) AS (SELECT DISTINCT f, 0 FROM tr WHERE f NOT IN (SELECT t FROM tr) UNION ALL SELECT tr.t, k + CAST(tr.t IN (SELECT t FROM ad) AS INT) FROM pa JOIN tr ON tr.f = pa.t)")
def graph_numadmix(spark, d):
    return T.summaries(T.graphs_table(spark, [G.simplify(GRAPH)]), "numadmix")


@query("""SELECT CAST(0 AS BIGINT) AS graph_id, x.l AS pop1, y.l AS pop2, round(count(*) FILTER (x.a = y.a) * 1e0 / (max(x.n) + max(y.n) - count(*) FILTER (x.a = y.a)), 9) AS share FROM
(SELECT a, t AS l, count(*) OVER (PARTITION BY t) AS n FROM cl WHERE t NOT IN (SELECT f FROM tr)) x JOIN (SELECT a, t AS l, count(*) OVER (PARTITION BY t) AS n FROM cl WHERE t NOT IN (SELECT f FROM tr)) y ON x.l < y.l GROUP BY 2, 3""",
       f"{_GR}, cl(a, t) AS (SELECT f, t FROM tr UNION SELECT cl.a, tr.t FROM cl JOIN tr ON tr.f = cl.t)")
def graph_pair_percentages(spark, d):
    return T.summaries(T.graphs_table(spark, [G.simplify(GRAPH)]), "pair_percentages")


@query("""SELECT pop1, pop2, pop3, pop4, count(*) AS n_graphs, round(count(*) / 2e0, 9) AS share FROM qu WHERE NOT EXISTS (
SELECT 1 FROM df x JOIN df y ON x.i = y.i AND x.e = y.e WHERE x.i = qu.i AND x.p = pop1 AND x.q = pop2 AND y.p = pop3 AND y.q = pop4) GROUP BY 1, 2, 3, 4""", _TWO_GRAPHS + """,
ch AS (SELECT DISTINCT i, k FROM te), pa AS (SELECT ge.i, ch.k, ge.f || '>' || ge.t AS e, x, EXISTS (SELECT 1 FROM tc WHERE tc.i = ge.i AND tc.k = ch.k AND tc.a = ge.t AND tc.t = x) AS passes FROM ge JOIN ch ON ch.i = ge.i JOIN le ON le.i = ge.i WHERE NOT adm),
df AS (SELECT DISTINCT a.i, a.e, a.x AS p, b.x AS q FROM pa a JOIN pa b ON a.i = b.i AND a.k = b.k AND a.e = b.e AND a.passes <> b.passes),
fo AS (SELECT a.i, a.x AS a, b.x AS b, c.x AS c, d.x AS d FROM le a JOIN le b ON a.i = b.i AND a.x < b.x JOIN le c ON a.i = c.i AND b.x < c.x JOIN le d ON a.i = d.i AND c.x < d.x),
qu AS (SELECT i, a AS pop1, b AS pop2, c AS pop3, d AS pop4 FROM fo UNION ALL SELECT i, a, c, b, d FROM fo UNION ALL SELECT i, a, d, b, c FROM fo)""")
def graph_zero_f4(spark, d):
    return T.summary_support(T.summaries(T.graphs_table(spark, [TREE, G.simplify(GRAPH)]), "zerof4"))


@query("""SELECT CAST(0 AS BIGINT) AS graph_id, p.x AS earlier1, p.y AS earlier2, q.x AS later1, q.y AS later2 FROM sp p JOIN sp q ON q.n <> p.n AND EXISTS (SELECT 1 FROM tc WHERE i = 0 AND a = p.n AND t = q.n)""", _TWO_GRAPHS + """,
sp AS (SELECT u.a AS n, x.x, y.x AS y FROM le x JOIN le y ON x.i = 0 AND y.i = 0 AND x.x < y.x JOIN tc u ON u.i = 0 AND u.t = x.x JOIN tc w ON w.i = 0 AND w.t = y.x AND w.a = u.a
WHERE NOT EXISTS (SELECT 1 FROM te c JOIN tc m ON m.i = 0 AND m.a = c.t AND m.t = x.x JOIN tc o ON o.i = 0 AND o.a = c.t AND o.t = y.x WHERE c.i = 0 AND c.f = u.a))""")
def graph_event_order(spark, d):
    return T.summaries(T.graphs_table(spark, [TREE]), "eventorder")


@query("""SELECT i AS graph_id, x1 AS pop1, x2 AS pop2, x3 AS pop3, CASE WHEN ab THEN x3 WHEN ac THEN x2 WHEN bc THEN x1 ELSE '' END AS outgroup, CAST(count(*) AS INT) AS n FROM (
SELECT i, k, x1, x2, x3, bool_or(h1 AND h2 AND NOT h3) AS ab, bool_or(h1 AND h3 AND NOT h2) AS ac, bool_or(h2 AND h3 AND NOT h1) AS bc FROM (
SELECT tc.i, k, a, x1, x2, x3, bool_or(t = x1) AS h1, bool_or(t = x2) AS h2, bool_or(t = x3) AS h3 FROM tc JOIN th ON th.i = tc.i GROUP BY ALL) GROUP BY ALL) GROUP BY ALL""", _TWO_GRAPHS + """,
th AS (SELECT p.i, p.x AS x1, q.x AS x2, r.x AS x3 FROM le p JOIN le q ON p.i = q.i AND p.x < q.x JOIN le r ON p.i = r.i AND q.x < r.x)""")
def graph_triples(spark, d):
    return T.summaries(T.graphs_table(spark, [TREE, G.simplify(GRAPH)]), "triples")


@query("""SELECT CAST(0 AS BIGINT) AS graph_id, s.x AS pop, c.p AS source, o.t AS proxy FROM ct c JOIN un s ON s.a = c.n JOIN un o ON o.a = c.top WHERE NOT EXISTS (SELECT 1 FROM un z WHERE z.a = c.n AND z.x = o.x)
AND c.d = (SELECT min(y.d) FROM ct y WHERE y.n = c.n AND y.p = c.p AND EXISTS (SELECT 1 FROM un v WHERE v.a = y.top AND NOT EXISTS (SELECT 1 FROM un z WHERE z.a = c.n AND z.x = v.x)))""".replace("o.t AS", "o.x AS"), _TWO_GRAPHS + """,
un AS (SELECT DISTINCT a, x FROM tc JOIN le ON le.i = tc.i AND le.x = tc.t WHERE tc.i = 1), ct(n, p, top, d) AS (SELECT t, f, f, 0 FROM ge WHERE i = 1 AND adm UNION ALL SELECT n, p, f, d + 1 FROM ct JOIN ge ON i = 1 AND ge.t = ct.top)""")
def graph_proxies(spark, d):
    return T.summaries(T.graphs_table(spark, [G.simplify(GRAPH)]), "proxies")


@query()
def graph_plusone(spark, d):
    return T.enumerate_graphs(T.graphs_table(spark, [TREE]), "plusone").select("parent", "hash")


@query()
def graph_minusplus(spark, d):
    return T.enumerate_graphs(T.graphs_table(spark, [G.simplify(GRAPH)]), "minusplus").select("parent", "hash")


@query()
def graph_split_trees(spark, d):
    return T.enumerate_graphs(T.graphs_table(spark, [G.simplify(GRAPH)]), "split_trees").select("parent", "hash")


@query()
def graph_tree_neighbours(spark, d):
    return T.enumerate_graphs(T.graphs_table(spark, [TREE]), "tree_neighbours").select("parent", "hash")


@query()
def graph_simulation(spark, d):
    return T.simulate_frequencies(spark, G.simplify(GRAPH), 500)


@query()
def graph_pcs(spark, d):
    return T.pcs(T.simulate_frequencies(spark, G.simplify(GRAPH), 500), POPS).select("pop", F.abs("pc1").alias("pc1"))


@query()
def graph_to_qpadm(spark, d):
    rows = [(m["target"], m["l"], m["r"], m["rank1"], m["rank2"], m["valid"]) for m in G.graph_to_qpadm(G.simplify(GRAPH), D)]
    return spark.createDataFrame(rows, "target string, l array<string>, r array<string>, rank1 int, rank2 int, valid boolean")


# --- models with closed forms, and replicates

_ONE = f"c4 AS (SELECT '{A}' AS pop1, '{B}' AS pop2, '{D}' AS pop3, '{E}' AS pop4)"
_TWO = f"c4 AS (SELECT * FROM (VALUES ('{A}', '{B}', '{D}', '{E}'), ('{A}', '{C}', '{D}', '{E}')) v(pop1, pop2, pop3, pop4))"


@query(f"""SELECT 0 AS model, 0 AS f4rank, 1 AS dof, round(any_value(e) * any_value(e) / (avg(power((1 / r) * e - (1 / r - 1) * loo - tot, 2) / (1 / r - 1)) * {1 + M.FUDGE}), 6) AS chisq
FROM lo, (SELECT sum(tot - loo) + sum(r * loo) AS e FROM lo) x""", f"{CTE}, {_ONE}, {_SYM}" + _jack(_f4sql("a"), "pop1, pop2, pop3, pop4"))
def qpwave_two_pops(spark, d):
    """Whether two populations are a clade against two others: one f4, whose square over its variance is the statistic."""
    f = _f2(spark, d, "ap")
    return M.qpwave(f, M.models_table(f, [{"left": [A, B], "right": [D, E]}])).select("model", "f4rank", "dof", F.round("chisq", 6).alias("chisq"))


_FITTED = "SELECT * FROM f0 UNION ALL SELECT b, pop1, 'fit', pop3, pop4, sum(CASE WHEN pop2 = '%s' THEN 0.6 ELSE 0.4 END * est), any_value(n) FROM f0 GROUP BY b, pop1, pop3, pop4" % B


@query("SELECT pop1, pop2, pop3, pop4, round(est, 9) AS est, round(se, 9) AS se FROM jk", f"{CTE}, {_TWO}, {_SYM}, f0 AS ({_f4sql('a')})" + _jack(_FITTED, "pop1, pop2, pop3, pop4"))
def fitted_f4(spark, d):
    return V.fitted_f4(_f2(spark, d, "ap"), A, {B: 3.0, C: 2.0}, [D, E]).select("pop1", "pop2", "pop3", "pop4", "est", "se")


@query("SELECT rep, pop1, pop2, pop3, pop4, round(est, 9) AS est, round(se, 9) AS se FROM jk", f"{CTE}, {_TWO}, {_SYM}, f0 AS ({_f4sql('a')})" + _jack("SELECT f0.*, x.b AS rep FROM f0 JOIN (SELECT DISTINCT b FROM f0) x ON x.b <> f0.b", "rep, pop1, pop2, pop3, pop4"))
def f4_resampled(spark, d):
    f = _f2(spark, d, "ap")
    x = S.f4_blocks(f, S.combs_table(f, [(A, B, D, E), (A, C, D, E)])).where("est IS NOT NULL").withColumnRenamed("n_snps", "n")
    return Z.statistics(x, ["pop1", "pop2", "pop3", "pop4"]).drop("z")


_OUT = [(A, x, y, z) for x in POPS[1:] for y in POPS[1:] for z in POPS[1:] if y < z and x not in (y, z)]


@query("""SELECT p1, p2, p3, out, round(support, 9) AS support FROM (SELECT t[1] AS p1, t[2] AS p2, t[3] AS p3, out, avg(abs(z)) AS support FROM (
SELECT list_sort([pop2, pop3, pop4]) AS t, CASE WHEN est < 0 THEN pop4 ELSE pop3 END AS out, est / se AS z FROM jk) GROUP BY t, out) QUALIFY row_number() OVER (PARTITION BY p1, p2, p3 ORDER BY support DESC, out DESC) = 1""",
       f"{CTE}, c4 AS (SELECT * FROM (VALUES {', '.join(map(str, _OUT))}) v(pop1, pop2, pop3, pop4)), {_SYM}" + _jack(_f4sql("a"), "pop1, pop2, pop3, pop4"))
def triples_of_f4(spark, d):
    f = _f2(spark, d, "ap")
    k = ["pop1", "pop2", "pop3", "pop4"]
    x = S.f4_blocks(f, S.combs_table(f, _OUT)).withColumnRenamed("n_snps", "n")
    return V.f4_to_triples(R.with_z(R.jackknife(R.est_to_loo(x, k), k)))


@query()
def qpadm_resampled(spark, d):
    f = _f2(spark, d, "ap")
    return Z.qpadm(f, M.models_table(f, [{"target": A, "left": [B, C], "right": [D, E]}]), nboot=10)


@query()
def qpwave_resampled(spark, d):
    f = _f2(spark, d, "ap")
    return Z.qpwave(f, M.models_table(f, [{"left": [A, B], "right": [C, D, E]}]))


# --- edge tables

def _edges(spark):
    g = G.simplify(GRAPH)
    rows = [(0, a, b, "admix" if len(g.up[b]) > 1 else "normal", 0.0 if k % 4 == 0 else 0.01 * k) for k, (a, b) in enumerate(g.edges)]
    rows += [(1, a, b, "normal", 0.02 * k) for k, (a, b) in enumerate(TREE.edges)]
    return spark.createDataFrame(rows, "graph_id long, from string, to string, type string, weight double")


def _edge_values() -> str:
    g = G.simplify(GRAPH)
    rows = [(0, a, b, "admix" if len(g.up[b]) > 1 else "normal", 0.0 if k % 4 == 0 else 0.01 * k) for k, (a, b) in enumerate(g.edges)]
    rows += [(1, a, b, "normal", 0.02 * k) for k, (a, b) in enumerate(TREE.edges)]
    return "ed(i, f, t, ty, w) AS (VALUES " + ", ".join(f"(CAST({i} AS BIGINT), '{a}', '{b}', '{ty}', CAST({w} AS DOUBLE))" for i, a, b, ty, w in rows) + ")"


@query("SELECT i AS graph_id, n AS node, CAST(sum(a) AS BIGINT) AS indegree, CAST(sum(b) AS BIGINT) AS outdegree FROM (SELECT i, f AS n, 0 AS a, 1 AS b FROM ed UNION ALL SELECT i, t, 1, 0 FROM ed) GROUP BY i, n", _edge_values())
def edge_degrees(spark, d):
    return X.degrees(_edges(spark))


@query('SELECT i AS graph_id, f AS "from", t AS "to", CASE WHEN count(*) OVER (PARTITION BY i, t) = 2 THEN \'admix\' ELSE \'normal\' END AS type FROM ed', _edge_values())
def edge_classes(spark, d):
    return X.with_class(_edges(spark)).drop("weight")


@query("SELECT i AS graph_id, a AS node, t AS below FROM cl", _edge_values() + ", cl(i, a, t) AS (SELECT i, f, t FROM ed UNION SELECT cl.i, cl.a, ed.t FROM cl JOIN ed ON ed.i = cl.i AND ed.f = cl.t)")
def edge_closure(spark, d):
    return X.closure(_edges(spark))


@query("SELECT i AS graph_id, count(*) FILTER (w < 1e-6) AS zero_edges FROM ed WHERE ty <> 'admix' GROUP BY i", _edge_values())
def edge_zero_counts(spark, d):
    return X.count_zero_edges(_edges(spark))


@query("""SELECT e.i AS graph_id, coalesce(u.b, e.t) AS below, round(sum(w), 9) AS drift FROM ed e LEFT JOIN (SELECT i, a, string_agg(t, ',' ORDER BY t) AS b FROM cl WHERE NOT EXISTS (SELECT 1 FROM ed x WHERE x.i = cl.i AND x.f = cl.t) GROUP BY i, a) u ON u.i = e.i AND u.a = e.t
WHERE ty <> 'admix' GROUP BY 1, 2""", _edge_values() + ", cl(i, a, t) AS (SELECT i, f, t FROM ed UNION SELECT cl.i, cl.a, ed.t FROM cl JOIN ed ON ed.i = cl.i AND ed.f = cl.t)")
def edge_drift_partition(spark, d):
    leaves = T.summaries(T.graphs_table(spark, [G.simplify(GRAPH), TREE]), "descendants")
    return X.drift_partition(_edges(spark), leaves)


@query("""SELECT name, coalesce(substr(name, 1, CAST(min(k) FILTER (c = 1) AS INT)), name) AS prefix FROM (SELECT n_name AS name, k, count(*) OVER (PARTITION BY substr(n_name, 1, CAST(k AS INT))) AS c FROM (SELECT n_name, unnest(range(1, length(n_name) + 1)) AS k FROM nation)) GROUP BY name""", "")
def shortest_unique_prefixes(spark, d):
    return X.shortest_unique_prefixes(spark.read.parquet(f"{d}/nation.parquet"), "n_name")


@query("SELECT pop, round(sum(p * n) / sum(n), 9) AS mean FROM af GROUP BY pop")
def weighted_means(spark, d):
    return X.weighted_means(af_of(spark, d), ["pop"], "p", "n")


@query("SELECT pop1, pop2, round(avg(f2), 9) AS mean, round(stddev_samp(f2), 9) AS se, round(quantile_cont(f2, 0.025), 9) AS low, round(quantile_cont(f2, 0.975), 9) AS high FROM pb WHERE pop1 < pop2 GROUP BY pop1, pop2")
def confidence_intervals(spark, d):
    return X.confints(_f2(spark, d).where("pop1 < pop2"), ["pop1", "pop2"], "est")
