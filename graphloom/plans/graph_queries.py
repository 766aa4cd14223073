"""Queries of inheritance, reachability, flows, communities and cycles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import closure as C
from ..operators import communities as M
from ..operators import conventions as N
from ..operators import flows as L
from ..operators import hierarchy as H
from ..operators.graph import Graph
from ..session import tabled
from . import fixture as X
from .registry import query
from .text_queries import frame

c = F.col

# --- a hierarchy: class k extends k // 2 and implements k // 3 ------------------------------------

_PAR = """par AS (SELECT 'S' || s_suppkey AS child, 'S' || (s_suppkey // 2) AS parent, 0 AS ord, 'EXTENDS' AS type FROM supplier WHERE s_suppkey // 2 >= 1
  UNION ALL SELECT 'S' || s_suppkey, 'S' || (s_suppkey // 3), 1, 'IMPLEMENTS' FROM supplier WHERE s_suppkey // 3 >= 1 AND s_suppkey // 3 <> s_suppkey // 2),
r AS (SELECT child AS class, parent AS ancestor, 1 AS depth, lpad(ord::VARCHAR, 6, '0') AS path, type AS kind FROM par
  UNION ALL SELECT r.class, p.parent, r.depth + 1, r.path || ',' || lpad(p.ord::VARCHAR, 6, '0'), r.kind FROM r JOIN par p ON p.child = r.ancestor WHERE r.depth < 50),
up AS (SELECT class, ancestor, depth, kind, row_number() OVER (PARTITION BY class ORDER BY depth, path) - 1 AS mro_pos
  FROM (SELECT *, row_number() OVER (PARTITION BY class, ancestor ORDER BY depth, path) AS rn FROM r) WHERE rn = 1),
mem AS (SELECT 'S' || l_suppkey AS class, 'S' || l_suppkey || '.P' || p_partkey AS method, p_brand || '.' || (p_size % 9) AS name, p_size = 1 AS is_property,
    CASE WHEN p_size % 5 = 0 THEN []::VARCHAR[] ELSE [p_type] END AS types, CASE WHEN p_size % 7 = 0 THEN NULL ELSE p_size % 3 END AS n
  FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem) JOIN part ON p_partkey = l_partkey),
conf AS (SELECT u.class, m.name, arg_min(m.method, (u.mro_pos, u.ancestor, m.method)) AS first_def, count(DISTINCT m.method) AS k,
    arg_min(m.method, (u.mro_pos, u.ancestor, m.method)) FILTER (u.kind <> 'IMPLEMENTS') AS first_class
  FROM up u JOIN mem m ON m.class = u.ancestor AND NOT m.is_property GROUP BY 1, 2 HAVING count(DISTINCT m.method) >= 2),
own AS (SELECT DISTINCT class, name FROM mem),
conflict AS (SELECT * FROM conf WHERE NOT EXISTS (SELECT 1 FROM own WHERE own.class = conf.class AND own.name = conf.name))"""


def _h(body: str) -> str:
    return f"WITH RECURSIVE {_PAR}\n{body}"


def _parents(spark, sf):
    s = X.table(spark, sf, "supplier").select("s_suppkey")
    name = lambda x: F.concat(F.lit("S"), x.cast("string"))
    half, third = F.floor(c("s_suppkey") / 2), F.floor(c("s_suppkey") / 3)
    a = s.filter(half >= 1).select(name(c("s_suppkey")).alias("child"), name(half).alias("parent"), F.lit(0).alias("ord"), F.lit("EXTENDS").alias("type"))
    b = s.filter((third >= 1) & (third != half)).select(name(c("s_suppkey")), name(third), F.lit(1), F.lit("IMPLEMENTS"))
    return a.union(b)


def _members(spark, sf):
    part = X.table(spark, sf, "part")
    # dealt out by part once, for the repeats and for the join
    li = X.table(spark, sf, "lineitem").select("l_suppkey", "l_partkey").filter("l_partkey is not null").repartition("l_partkey").distinct()
    x = li.join(part.hint("shuffle_hash"), c("l_partkey") == c("p_partkey"))
    cls = F.concat(F.lit("S"), c("l_suppkey").cast("string"))
    return x.select(cls.alias("class"), F.concat(cls, F.lit(".P"), c("p_partkey").cast("string")).alias("method"), F.concat_ws(".", "p_brand", (c("p_size") % 9).cast("string")).alias("name"), (c("p_size") == 1).alias("is_property"), F.when(c("p_size") % 5 == 0, F.array().cast("array<string>")).otherwise(F.array("p_type")).alias("types"), F.when(c("p_size") % 7 != 0, c("p_size") % 3).alias("count"))


@query(_h("SELECT class, ancestor, depth, mro_pos FROM up"))
def f1_ancestors(spark, sf):
    return H.ancestors(_parents(spark, sf)).select("class", "ancestor", "depth", "mro_pos")


DIAMONDS = [("g1", "D", "B", 0), ("g1", "D", "C", 1), ("g1", "B", "A", 0), ("g1", "C", "A", 0), ("g2", "Z", "X", 0), ("g2", "Z", "Y", 1), ("g2", "X", "P", 0), ("g2", "X", "Q", 1), ("g2", "Y", "Q", 0), ("g2", "Y", "P", 1), ("g3", "U", "V", 0), ("g3", "V", "U", 0)]


@query("SELECT * FROM (VALUES ('D', 0, 'B'), ('D', 1, 'C'), ('D', 2, 'A'), ('B', 0, 'A'), ('C', 0, 'A'), ('X', 0, 'P'), ('X', 1, 'Q'), ('Y', 0, 'Q'), ('Y', 1, 'P'), ('Z', -1, NULL), ('U', -1, NULL), ('V', -1, NULL)) AS t(class, pos, ancestor)")
def f2_c3(spark, sf):
    return H.c3(spark.createDataFrame(DIAMONDS, "grp string, child string, parent string, ord int"), "grp")


@query(_h("SELECT class, ancestor, kind FROM up"))
def f3_edge_kind(spark, sf):
    return H.ancestors(_parents(spark, sf)).select("class", "ancestor", "kind")


def _conflicts(spark, sf, resolved=True):
    return H.conflicts(tabled(H.ancestors(_parents(spark, sf))), _members(spark, sf), resolved)


@query(_h("SELECT class, name, k AS definitions FROM conflict"))
def f4_conflicts(spark, sf):
    return _conflicts(spark, sf, resolved=False).select("class", "name", "definitions")


@query(_h("SELECT class, name, first_def AS resolved, 0.9::DOUBLE AS confidence FROM conflict"))
def f5_resolve_first(spark, sf):
    return H.resolve_first(_conflicts(spark, sf))


_SPLIT = "SELECT class, name, first_class AS resolved, CASE WHEN first_class IS NOT NULL THEN 0.95 ELSE 0.5 END::DOUBLE AS confidence FROM conflict"


@query(_h(_SPLIT))
def f6_resolve_split(spark, sf):
    return H.resolve_split(_conflicts(spark, sf))


@query(_h("SELECT class, name, NULL::VARCHAR AS resolved, 'requires qualified syntax' AS reason FROM conflict"))
def f7_qualified(spark, sf):
    return _conflicts(spark, sf, resolved=False).select("class", "name", F.lit(None).cast("string").alias("resolved"), F.lit("requires qualified syntax").alias("reason"))


@query(_h("SELECT class AS sourceId, first_def AS targetId, 'METHOD_OVERRIDES' AS type, 0.9::DOUBLE AS confidence FROM conflict"))
def f8_override_edges(spark, sf):
    return H.override_edges(H.resolve_first(_conflicts(spark, sf)))


_MATCH = "CASE WHEN ({a}.n IS NULL) <> ({b}.n IS NULL) THEN true WHEN len({a}.types) = 0 OR len({b}.types) = 0 THEN CASE WHEN {a}.n IS NULL THEN true ELSE {a}.n = {b}.n END ELSE {a}.types = {b}.types END"
_SURE = "CASE WHEN ({a}.n IS NULL) <> ({b}.n IS NULL) THEN false WHEN len({a}.types) = 0 OR len({b}.types) = 0 THEN CASE WHEN {a}.n IS NULL THEN false ELSE {a}.n = {b}.n END ELSE {a}.types = {b}.types END"


@query(
    _h(
        "SELECT class, method, overridden, 0.9::DOUBLE AS confidence FROM (SELECT o.class, o.method, a.method AS overridden, u.depth, min(u.depth) OVER (PARTITION BY o.class, o.method) AS d, count(*) OVER (PARTITION BY o.class, o.method, u.depth) AS k "
        f"FROM mem o JOIN up u ON u.class = o.class AND u.kind = 'EXTENDS' JOIN mem a ON a.class = u.ancestor AND a.name = o.name WHERE NOT o.is_property AND NOT a.is_property AND {_MATCH.format(a='o', b='a')}) WHERE depth = d AND k = 1"
    )
)
def f9_single_overrides(spark, sf):
    return H.single_overrides(H.ancestors(_parents(spark, sf)), _members(spark, sf))


_SIGS = "(VALUES (1, ['A'], 1, ['A'], 1), (2, ['A'], 1, ['B'], 1), (3, []::VARCHAR[], 2, ['B'], 2), (4, []::VARCHAR[], 2, []::VARCHAR[], 3), (5, []::VARCHAR[], NULL, []::VARCHAR[], NULL), (6, ['A'], NULL, ['A'], 1), (7, ['A', 'B'], 2, ['A'], 2)) AS t(id, x, xn, y, yn)"


@query(f"SELECT id, {_MATCH} AS match, {_SURE} AS sure FROM (SELECT id, x AS xt, xn, y AS yt, yn FROM {_SIGS})".replace("{a}.n", "xn").replace("{b}.n", "yn").replace("{a}.types", "xt").replace("{b}.types", "yt"))
def f10_signatures(spark, sf):
    rows = [(1, ["A"], 1, ["A"], 1), (2, ["A"], 1, ["B"], 1), (3, [], 2, ["B"], 2), (4, [], 2, [], 3), (5, [], None, [], None), (6, ["A"], None, ["A"], 1), (7, ["A", "B"], 2, ["A"], 2)]
    d = spark.createDataFrame(rows, "id int, x_types array<string>, x_count int, y_types array<string>, y_count int")
    match, sure = H.signature("x_", "y_")
    return d.select("id", match.alias("match"), sure.alias("sure"))


@query(
    _h(
        "SELECT sourceId, targetId, CASE WHEN sure THEN 1.0 ELSE 0.7 END::DOUBLE AS confidence FROM (SELECT o.method AS sourceId, a.method AS targetId, "
        + _SURE.format(a="o", b="a")
        + " AS sure, count(*) OVER (PARTITION BY o.class, a.method) AS k FROM mem o JOIN (SELECT DISTINCT class, ancestor FROM up WHERE kind = 'IMPLEMENTS') u ON u.class = o.class JOIN mem a ON a.class = u.ancestor AND a.name = o.name WHERE NOT o.is_property AND NOT a.is_property AND "
        + _MATCH.format(a="o", b="a")
        + ") WHERE k = 1"
    )
)
def f11_implementations(spark, sf):
    return H.implementations(H.ancestors(_parents(spark, sf)), _members(spark, sf))


@query(
    _h(
        "SELECT class, wanted, found FROM (SELECT *, min(depth) OVER (PARTITION BY class, wanted) AS d FROM (SELECT u.class, w.method AS wanted, a.method AS found, x.depth, count(*) OVER (PARTITION BY u.class, w.method, x.depth) AS k "
        "FROM (SELECT DISTINCT class, ancestor FROM up WHERE kind = 'IMPLEMENTS') u JOIN mem w ON w.class = u.ancestor AND NOT w.is_property JOIN up x ON x.class = u.class AND x.kind = 'EXTENDS' JOIN mem a ON a.class = x.ancestor AND a.name = w.name AND NOT a.is_property "
        f"WHERE NOT EXISTS (SELECT 1 FROM mem o WHERE o.class = u.class AND o.name = w.name AND NOT o.is_property) AND {_MATCH.format(a='w', b='a')}) WHERE k = 1) WHERE depth = d"
    )
)
def f12_inherited_implementations(spark, sf):
    return H.inherited_implementations(H.ancestors(_parents(spark, sf)), _members(spark, sf))


@query(_h("SELECT count(*) AS entries, count(*) FILTER (resolved IS NULL) AS ambiguous FROM (" + _SPLIT + ")"))
def f13_summary(spark, sf):
    return H.split_summary(_conflicts(spark, sf, resolved=False))


@query(_h("SELECT class, ancestor, depth, mro_pos FROM up"))
def f14_order_from_edges(spark, sf):
    """The same orders from the inheritance edges of a graph."""
    e = _parents(spark, sf).select(c("child").alias("sourceId"), c("parent").alias("targetId"), "type", c("ord").cast("long").alias("emit_ord"))
    return H.ancestors(H.parents_of(e)).select("class", "ancestor", "depth", "mro_pos")


# --- flows -----------------------------------------------------------------------------------------

_SCORES = "o AS (SELECT sourceId AS id, count(*) AS n FROM edges WHERE type = 'CALLS' AND confidence >= 0.5 GROUP BY 1), i AS (SELECT targetId AS id, count(*) AS n FROM edges WHERE type = 'CALLS' AND confidence >= 0.5 GROUP BY 1), scores AS (SELECT m.id, round(o.n / (coalesce(i.n, 0) + 1) * CASE WHEN m.isExported THEN 2.0 ELSE 1.0 END, 9) AS score FROM nodes m JOIN o ON o.id = m.id LEFT JOIN i ON i.id = m.id WHERE m.label = 'Method')"


def _scores(spark, sf):
    return L.entry_scores(X.nodes(spark, sf, {"Method"}), X.edges(spark, sf, {"CALLS"}))


@query(X.sql("SELECT id, score FROM scores", _SCORES))
def g1_entry_scores(spark, sf):
    return _scores(spark, sf)


NAMES = ["handleLogin", "main", "getUser", "processPayment", "UserController", "parseArgs", "_hidden", "Setup", "toString", "plain", "emitEvent", "StringUtils"]


@query("SELECT * REPLACE (multiplier::DOUBLE AS multiplier) FROM (VALUES ('handleLogin', 1.5), ('main', 1.5), ('getUser', 0.3), ('processPayment', 1.5), ('UserController', 1.5), ('parseArgs', 0.3), ('_hidden', 0.3), ('Setup', 1.5), ('toString', 0.3), ('plain', 1.0), ('emitEvent', 1.5), ('StringUtils', 0.3)) AS t(name, multiplier)")
def g1_name_multipliers(spark, sf):
    return frame(spark, [(n,) for n in NAMES], "name").select("name", N.name_multiplier(c("name")).alias("multiplier"))


PATHS = ["src/app.test.ts", "src/test/java/A.java", "pkg/a_test.go", "lib/utils/x.ts", "pages/index.tsx", "src/app/dash/page.tsx", "pages/api/x.ts", "app/_layout.tsx", "src/routes/a.ts", "shop/views.py", "a/controller/B.java", "c/UserController.java", "x/service/Y.java", "m/routes/R.kt", "README.md", "api/v1/x.py"]


@query("SELECT * FROM (VALUES ('src/app.test.ts', true, false), ('src/test/java/A.java', true, false), ('pkg/a_test.go', true, false), ('lib/utils/x.ts', false, true)) AS t(path, test, utility)")
def g2_file_predicates(spark, sf):
    return frame(spark, [(p,) for p in PATHS[:4]], "path").select("path", L.is_test_file(c("path")).alias("test"), L.is_utility_file(c("path")).alias("utility"))


@query("SELECT * REPLACE (multiplier::DOUBLE AS multiplier) FROM (VALUES ('pages/index.tsx', 3.0, 'nextjs-page'), ('src/app/dash/page.tsx', 3.0, 'nextjs-app-page'), ('pages/api/x.ts', 3.0, 'nextjs-api-route'), ('app/_layout.tsx', 2.0, 'expo-layout'), ('src/routes/a.ts', 2.5, 'routes-folder'), ('shop/views.py', 3.0, 'django-views'), ('a/controller/B.java', 3.0, 'spring-controller'), ('c/UserController.java', 3.0, 'spring-controller-file'), ('x/service/Y.java', 1.8, 'java-service'), ('m/routes/R.kt', 2.5, 'ktor-routes'), ('README.md', 1.0, NULL), ('api/v1/x.py', 2.0, 'api-folder')) AS t(path, multiplier, reason)")
def g3_framework_hints(spark, sf):
    m, r = N.path_hint(c("path"))
    return frame(spark, [(p,) for p in PATHS[4:]], "path").select("path", m.alias("multiplier"), r.alias("reason"))


@query(X.sql("SELECT id, score FROM scores WHERE score > 0 ORDER BY score DESC, id LIMIT 200", _SCORES))
def g4_candidates(spark, sf):
    return L.candidates(_scores(spark, sf))


_SITES = "sites AS (SELECT DISTINCT p_brand AS filePath, p_partkey * 10 + 7 AS line FROM part)"


@query(X.sql("SELECT filePath, line, id FROM (SELECT s.filePath, s.line, n.id, row_number() OVER (PARTITION BY s.filePath, s.line ORDER BY n.endLine - n.startLine, n.id) AS rn FROM sites s JOIN nodes n ON n.label = 'Method' AND n.filePath = s.filePath AND n.startLine <= s.line AND s.line <= n.endLine) WHERE rn = 1", _SITES))
def g5_enclosing_callable(spark, sf):
    sites = X.table(spark, sf, "part").select(c("p_brand").alias("filePath"), (c("p_partkey") * 10 + 7).alias("line"))
    return L.enclosing(sites, X.nodes(spark, sf, {"Method"}))


def _traced(spark, sf):
    from ..operators.graph import adjacency

    entries = L.candidates(_scores(spark, sf)).select("id")
    sinks = X.nodes(spark, sf, {"Method"}).filter(c("id").endswith("0")).select("id")
    return L.trace(entries, adjacency(X.edges(spark, sf, {"CALLS"})), sinks), sinks


@query()
def g6_traces(spark, sf):
    return _traced(spark, sf)[0]


_TRACES = "tr AS (SELECT l_orderkey AS o, list('Method:P' || l_partkey ORDER BY step) AS path FROM steps GROUP BY 1), ks AS (SELECT DISTINCT path, '->' || array_to_string(path, '->') || '->' AS k FROM tr)"


def _orders(spark, sf):
    s = X.steps(spark, sf)
    return s.groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("step", "l_partkey"))), lambda x: F.concat(F.lit("Method:P"), x["l_partkey"].cast("string"))).alias("path")).select("path")


def _no_sinks(spark):
    return spark.createDataFrame([("Method:P1",), ("Method:P2",)], "id string")


@query(X.sql("SELECT array_to_string(path, ',') AS path FROM ks a WHERE path[-1] IN ('Method:P1', 'Method:P2') OR k NOT IN (SELECT a.k FROM ks a JOIN (SELECT k, len(path) AS n, unnest(list_distinct(path)) AS node FROM ks) b ON b.node = a.path[1] AND b.n > len(a.path) AND contains(b.k, a.k))", _TRACES))
def g8_drop_contained(spark, sf):
    return L.drop_contained(_orders(spark, sf), _no_sinks(spark)).select(F.array_join("path", ",").alias("path"))


@query(X.sql("SELECT array_to_string(path, ',') AS path FROM (SELECT path, row_number() OVER (PARTITION BY path[1], path[-1] ORDER BY len(path) DESC, array_to_string(path, chr(0))) AS rn FROM tr) WHERE rn = 1", _TRACES))
def g9_longest_per_ends(spark, sf):
    return L.longest_per_ends(_orders(spark, sf)).select(F.array_join("path", ",").alias("path"))


_RR = ", ends9 AS (SELECT path FROM (SELECT path, row_number() OVER (PARTITION BY path[1], path[-1] ORDER BY len(path) DESC, array_to_string(path, chr(0))) AS rn FROM tr) WHERE rn = 1), rk AS (SELECT path, path[-1] AS t, (CASE WHEN path[-1] IN ('Method:P1', 'Method:P2') THEN 0 ELSE 1 END, -len(path), array_to_string(path, chr(0))) AS r FROM ends9), rr AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY r) AS round, min(r) OVER (PARTITION BY t) AS best FROM rk)"


@query(X.sql("SELECT array_to_string(path, ',') AS path, row_number() OVER (ORDER BY round, best) - 1 AS ord FROM rr QUALIFY row_number() OVER (ORDER BY round, best) <= 50", _TRACES + _RR))
def g10_round_robin(spark, sf):
    return L.round_robin(L.longest_per_ends(_orders(spark, sf)), _no_sinks(spark), 50).select(F.array_join("path", ",").alias("path"), "ord")


@query("SELECT s_suppkey AS symbols, greatest(20, floor(s_suppkey / 10 + 0.5))::INT AS cap FROM supplier")
def g11_process_cap(spark, sf):
    return X.table(spark, sf, "supplier").select(c("s_suppkey").alias("symbols"), L.process_cap(c("s_suppkey")).alias("cap"))


def _processes(spark, sf):
    traces, sinks = _traced(spark, sf)
    most = X.nodes(spark, sf).filter("label <> 'File'").select(L.process_cap(F.count("*"))).first()[0]
    chosen = L.round_robin(L.longest_per_ends(L.drop_contained(traces.select("path"), sinks)), sinks, most)
    m = X.nodes(spark, sf, {"Method"})
    return L.processes(chosen, m.select("id", "name"), m.select("id", c("filePath").alias("community")))


@query()
def g12_processes(spark, sf):
    return _processes(spark, sf)[0]


@query()
def g12_process_steps(spark, sf):
    return _processes(spark, sf)[1]


@query()
def g13_flow_stats(spark, sf):
    return L.flow_stats(_processes(spark, sf)[0])


@query(X.sql("SELECT r.o_orderkey::VARCHAR AS sourceId, p.id AS targetId, 'handler' AS reason FROM orders r JOIN nodes p ON p.label = 'Process' AND p.entryPointId = 'Method:P' || r.o_custkey UNION ALL SELECT r.o_orderkey::VARCHAR, p.id, 'file' FROM orders r JOIN nodes p ON p.label = 'Process' JOIN nodes m ON m.id = p.entryPointId AND m.filePath = 'Brand#1' || (r.o_orderkey % 5 + 1) WHERE 'Method:P' || r.o_custkey NOT IN (SELECT q.entryPointId FROM nodes q WHERE q.label = 'Process' AND q.entryPointId IS NOT NULL)"))
def g14_entry_links(spark, sf):
    src = X.table(spark, sf, "orders").select(c("o_orderkey").cast("string").alias("id"), F.concat(F.lit("Method:P"), c("o_custkey").cast("string")).alias("handlerId"), F.concat(F.lit("Brand#1"), (c("o_orderkey") % 5 + 1).cast("string")).alias("filePath"))
    n = X.nodes(spark, sf, {"Method", "Process"})
    return L.entry_links(src, n.filter("label = 'Process'").select("id", "entryPointId"), n.filter("label = 'Method'"))


# --- communities ----------------------------------------------------------------------------------

_PROJ = "proj AS (SELECT DISTINCT least(sourceId, targetId) AS a, greatest(sourceId, targetId) AS b FROM edges WHERE type IN ('CALLS', 'EXTENDS', 'IMPLEMENTS') AND sourceId <> targetId), mem AS (SELECT id, filePath AS community FROM nodes WHERE label = 'Method'), mp AS (SELECT p.* FROM proj p WHERE a LIKE 'Method%' AND b LIKE 'Method%')"


def _proj(spark, sf):
    return M.projection(X.graph(spark, sf, {"Method", "Class", "Interface"}, {"CALLS", "IMPLEMENTS"}), large=False)


def _brands(spark, sf):
    pairs = M.projection(X.graph(spark, sf, {"Method"}, {"CALLS"}), large=False)
    return pairs, X.nodes(spark, sf, {"Method"}).select("id", c("filePath").alias("community"))


@query(X.sql("SELECT a, b FROM proj", _PROJ))
def g15_projection(spark, sf):
    return _proj(spark, sf)


@query()
def g16_communities(spark, sf):
    return M.detect(_proj(spark, sf))


@query("SELECT DENSE_RANK() OVER (ORDER BY f) - 1 AS num, source FROM (SELECT source, min(doc_id) AS f FROM documents GROUP BY source)")
def g18_renumber(spark, sf):
    from pyspark.sql import Window as W

    return X.table(spark, sf, "documents").groupBy("source").agg(F.min("doc_id").alias("f")).select((F.dense_rank().over(W.orderBy("f")) - 1).alias("num"), "source")


@query(X.sql("SELECT community, count(*) AS symbolCount FROM mem GROUP BY 1 HAVING count(*) >= 2", _PROJ))
def g19_community_rows(spark, sf):
    return M.rows(_brands(spark, sf)[1])


MEMBERS = [("a1", "x#0", "loadUser", "app/users/a.ts"), ("a2", "x#0", "saveUser", "app/users/b.ts"), ("a3", "x#0", "z", "app/src/c.ts"), ("b1", "x#1", "orderNew", "src/a.ts"), ("b2", "x#1", "orderOld", "b.ts"), ("b3", "x#1", "orderMid", "lib/c.ts"), ("c1", "x#2", "q", "a.ts"), ("c2", "x#2", "r", "b.ts")]


@query("SELECT * FROM (VALUES ('x#0', 'Users'), ('x#1', 'Order'), ('x#2', 'Cluster_2')) AS t(community, label)")
def g20_labels(spark, sf):
    d = frame(spark, MEMBERS, "id, community, name, filePath")
    return M.labels(d.select("id", "community"), d.select("id", "name", "filePath"))


@query(X.sql("SELECT m.community, round(coalesce(least(1.0, sum(CASE WHEN o.community = f.community THEN 1 ELSE 0 END) FILTER (b2.n IS NOT NULL) / nullif(count(b2.n), 0)), 1.0), 9) AS cohesion FROM (SELECT DISTINCT community FROM mem) m LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY community ORDER BY id) AS rn FROM mem) WHERE rn <= 50) f ON f.community = m.community LEFT JOIN (SELECT a AS id, b AS n FROM mp UNION ALL SELECT b, a FROM mp) b2 ON b2.id = f.id LEFT JOIN mem o ON o.id = b2.n GROUP BY 1", _PROJ))
def g21_cohesion(spark, sf):
    return M.cohesion(*_brands(spark, sf))


@query(X.sql("SELECT round((SELECT count(*) FILTER (x.community = y.community) / count(*) FROM mp JOIN mem x ON x.id = a JOIN mem y ON y.id = b) - (SELECT sum(d * d) FROM (SELECT community, count(*)::DOUBLE AS d FROM (SELECT a AS id FROM mp UNION ALL SELECT b FROM mp) JOIN mem USING (id) GROUP BY 1)) / (4.0 * (SELECT count(*) FROM mp)::DOUBLE * (SELECT count(*) FROM mp)), 9) AS modularity", _PROJ))
def g22_modularity(spark, sf):
    return M.modularity(*_brands(spark, sf))


# --- cycles and reachability ---------------------------------------------------------------------

_SCC = "pairs AS MATERIALIZED (SELECT src, dst FROM calls), reach AS (SELECT src, dst FROM pairs UNION SELECT r.src, s.dst FROM reach r JOIN pairs s ON s.src = r.dst), back AS (SELECT a.src AS node, min(a.dst) AS least, count(*) AS n FROM reach a JOIN reach b ON b.src = a.dst AND b.dst = a.src GROUP BY 1), ns AS (SELECT src AS n FROM pairs UNION SELECT dst FROM pairs), scc AS (SELECT ns.n AS node, least(ns.n, coalesce(back.least, ns.n)) AS scc, back.n IS NOT NULL AS cyclic FROM ns LEFT JOIN back ON back.node = ns.n)"


def _pairs(spark, sf):
    return X.calls(spark, sf).select("src", "dst")


@query(X.sql("SELECT node, scc, count(*) OVER (PARTITION BY scc) AS size FROM scc", _SCC, recursive=True))
def g23_strong_components(spark, sf):
    return C.strongly_connected(_pairs(spark, sf)).select("node", "scc", "size")


@query(X.sql("SELECT DISTINCT scc FROM scc WHERE cyclic", _SCC, recursive=True))
def g24_cyclic_components(spark, sf):
    return C.strongly_connected(_pairs(spark, sf)).filter("cyclic").select("scc").distinct()


_CYCLES = "tr AS (SELECT event_type AS s, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS d FROM events), small AS (SELECT DISTINCT s, d FROM tr WHERE d IS NOT NULL), w AS (SELECT s AS start, d AS cur, [s] AS path FROM small WHERE d >= s UNION ALL SELECT w.start, e.d, list_append(w.path, w.cur) FROM w JOIN small e ON e.s = w.cur WHERE w.cur <> w.start AND NOT list_contains(w.path, w.cur) AND e.d >= w.start)"


def _transitions(spark, sf):
    from pyspark.sql import Window as W

    e = X.table(spark, sf, "events")
    nxt = F.lead("event_type").over(W.partitionBy("user_id").orderBy("ts", "event_id"))
    return e.select(c("event_type").alias("source"), nxt.alias("target")).filter("target is not null").distinct()


@query(f"WITH RECURSIVE {_CYCLES} SELECT DISTINCT array_to_string(path, '>') AS cycle, 'complete' AS kind FROM w WHERE cur = start")
def g25_elementary_cycles(spark, sf):
    return M.import_cycles(_transitions(spark, sf)).select(F.array_join("cycle", ">").alias("cycle"), "kind")


@query()
def g25_call_cycles(spark, sf):
    """Cycles of the whole call graph; where they are more than the limit, a representative of each component."""
    e = X.edges(spark, sf, {"CALLS"}).select(c("sourceId").alias("source"), c("targetId").alias("target"))
    return M.import_cycles(e).select("component", "size", "kind", F.array_join("cycle", ">").alias("cycle"))


#: The first shortest cycle from the least node of each cyclic component, in the order of its nodes' ids.
_SHORTEST = _SCC + """, comp AS MATERIALIZED (SELECT min('Method:P' || node) AS component, count(*) AS size, scc FROM scc WHERE cyclic GROUP BY scc),
e AS MATERIALIZED (SELECT 'Method:P' || a.src AS s, 'Method:P' || a.dst AS d FROM pairs a JOIN scc x ON x.node = a.src JOIN scc y ON y.node = a.dst AND x.scc = y.scc),
dist AS (SELECT component, component AS n, 0 AS depth FROM comp UNION SELECT dist.component, e.d, depth + 1 FROM dist JOIN e ON e.s = dist.n WHERE depth < 12 AND (depth = 0 OR n <> component)),
short AS (SELECT component, min(depth) AS k FROM dist WHERE n = component AND depth > 0 GROUP BY 1),
way AS (SELECT component, component AS n, [component] AS path FROM comp UNION ALL SELECT w.component, e.d, list_append(w.path, e.d) FROM way w JOIN e ON e.s = w.n JOIN short USING (component) WHERE len(w.path) < short.k)"""


@query(X.sql("SELECT component, size, 'representatives' AS kind, array_to_string(min(path), '>') AS cycle FROM way JOIN short USING (component) JOIN comp USING (component) JOIN e ON e.s = way.n AND e.d = component WHERE len(path) = short.k GROUP BY component, size", _SHORTEST, recursive=True))
def g26_representative_cycles(spark, sf):
    e = X.edges(spark, sf, {"CALLS"}).select(c("sourceId").alias("source"), c("targetId").alias("target"))
    return M.import_cycles(e, most=0).select("component", "size", "kind", F.array_join("cycle", ">").alias("cycle"))


_TREE = "small AS (SELECT sourceId AS s, targetId AS d FROM edges WHERE type = 'CALLS'), t AS (SELECT 'Method:P7' AS n, 0 AS depth UNION SELECT d, depth + 1 FROM t JOIN small ON s = t.n WHERE depth < 3)"


@query(X.sql("SELECT n AS node, min(depth) AS depth FROM t WHERE n <> 'Method:P7' GROUP BY 1", _TREE, recursive=True))
def g27_call_tree(spark, sf):
    e = X.edges(spark, sf, {"CALLS"}).select(c("sourceId").alias("src"), c("targetId").alias("dst"))
    return C.tree(e, "Method:P7", 3)


@query(X.sql("SELECT start, n AS node, min(depth) AS depth FROM t GROUP BY 1, 2", "t AS (SELECT x AS start, x AS n, 0 AS depth FROM (VALUES (7::BIGINT), (11), (250)) AS v(x) UNION SELECT t.start, s.dst, t.depth + 1 FROM t JOIN calls s ON s.src = t.n WHERE depth < 4)", recursive=True))
def g28_bounded_search(spark, sf):
    return C.bounded_search(_pairs(spark, sf), spark.createDataFrame([(7,), (11,), (250,)], "start long"), 4)


@query("SELECT * FROM (VALUES ('v1'), ('v4')) AS t(id)")
def g29_local_values(spark, sf):
    n = frame(spark, [("v1", "Const"), ("v2", "Variable"), ("v3", "Const"), ("v4", "Static"), ("f", "Function")], "id, label")
    e = frame(spark, [("file", "v1", "DEFINES"), ("file", "v2", "DEFINES"), ("f", "v2", "ACCESSES"), ("v3", "f", "USES"), ("file", "v3", "DEFINES"), ("file", "v4", "DEFINES")], "sourceId, targetId, type")
    return M.local_values(Graph(n, e))


@query(X.sql("SELECT * FROM (SELECT 'verified' AS what, count(*) AS n FROM edges WHERE confidence >= 1.0 OR contains(reason, 'LSP:') UNION ALL SELECT 'heuristic', count(*) FROM edges WHERE NOT (confidence >= 1.0 OR contains(reason, 'LSP:')))"))
def g31_precision(spark, sf):
    from ..operators.relational import verified

    v = F.coalesce(verified(), F.lit(False))
    return X.edges(spark, sf).groupBy(F.when(v, "verified").otherwise("heuristic").alias("what")).agg(F.count("*").alias("n"))
