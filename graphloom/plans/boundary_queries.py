"""Queries of boundaries, routes, injection, workflows, resolution, enrichment, program dependence, sinks and functions."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import boundary as B
from ..operators import enrichment as N
from ..operators import pdg as P
from ..operators import resolution as R
from ..operators import structure as E
from ..sources import writers
from . import fixture as X
from .registry import query
from .text_queries import _CODE, _sources, frame

c = F.col

RULES = [
    ("ingress", 0, "spring_web_rest", "java", "HTTP / REST API", r"\borg\.springframework\.web\.bind\.annotation", "Spring Web REST Controller"),
    ("ingress", 1, "fastapi_routes", "python", "HTTP / REST API", r"\bfastapi\b", "FastAPI Route Handler"),
    ("ingress", 2, "any_spring", "java", "Other", r"springframework", "Spring"),
    ("egress", 0, "python_requests", "python", "Outbound HTTP Client", r"\brequests\b", "Python Requests"),
    ("egress", 1, "axios_client", "typescript", "Outbound HTTP Client", r"\baxios\b", "Axios"),
]


def _rules(spark):
    return spark.createDataFrame(RULES, "boundary string, rule_ord int, id string, language string, category string, pattern string, description string")


@query("SELECT boundary, id FROM (VALUES ('egress', 'python_requests'), ('egress', 'axios_client')) AS t(boundary, id)")
def a8_registry_scan(spark, sf):
    return _rules(spark).filter("boundary = 'egress'").select("boundary", "id")


@query(
    X.sql(
        "SELECT boundary, category, package, path AS file FROM (SELECT *, CASE WHEN k = 1 AND p % 2 = 1 THEN 'ingress' WHEN k <> 1 AND p % 10 = 1 THEN 'egress' END AS boundary, CASE WHEN k = 1 AND p % 2 = 1 THEN 'Odd module' WHEN k <> 1 AND p % 10 = 1 THEN 'Ends in one' END AS category, "
        "CASE k WHEN 1 THEN 'from m' || p || ' import x' ELSE 'a.P' || p END AS package FROM src WHERE k IN (0, 1, 4) AND p % 3 > 0) WHERE boundary IS NOT NULL",
        _CODE,
    )
)
def h1_registry_match(spark, sf):
    rules = [("ingress", 0, "odd", "python", "Odd module", r"from m\d*[13579] import", ""), ("ingress", 1, "odd again", "python", "Never first", r"from m\d*[13] import", ""), ("egress", 0, "one", "", "Ends in one", r"\.P\d*1$", "")]
    r = spark.createDataFrame(rules, "boundary string, rule_ord int, id string, language string, category string, pattern string, description string")
    return B.match_rules(E.imports(_sources(spark, sf)), r).select("boundary", "category", "package", "file")


_URLS = "CASE WHEN regexp_matches(url, '/docs?/') THEN 'Docs' WHEN regexp_matches(url, '[0-9]') THEN 'Numbered' ELSE 'Other' END"


@query(f"SELECT 'ingress' AS boundary, {_URLS} AS category, count(*) AS n FROM pages GROUP BY 2")
def h1_page_rules(spark, sf):
    rules = [("ingress", 0, "a", "", "Docs", "/docs?/", ""), ("ingress", 1, "b", "", "Numbered", "[0-9]", ""), ("ingress", 2, "c", "", "Other", ".", "")]
    r = spark.createDataFrame(rules, "boundary string, rule_ord int, id string, language string, category string, pattern string, description string")
    p = X.table(spark, sf, "pages").select(c("page_id").cast("string").alias("path"), c("url").alias("package"))
    return B.match_rules(p, r).groupBy("boundary", "category").agg(F.count("*").alias("n"))


@query(X.sql("SELECT 'HTTP / REST Route' AS category, method || ' ' || name AS package FROM nodes WHERE label = 'Route'"))
def h2_route_findings(spark, sf):
    return B.route_findings(X.nodes(spark, sf, {"Route"})).select("category", "package")


@query("SELECT event_type AS category, arg_max(event_id::VARCHAR, event_id) AS description FROM events GROUP BY 1")
def h3_dedupe_findings(spark, sf):
    e = X.table(spark, sf, "events").select(F.lit("b").alias("boundary"), c("event_type").alias("category"), F.lit("p").alias("package"), F.lit("f").alias("file"), c("event_id").cast("string").alias("description"), "event_id")
    return B.dedupe_findings(e, "event_id").select("category", "description")


@query(X.sql("SELECT p.id, list_last(string_split(p.entryPointId, ':')) AS entry, list_last(string_split(p.terminalId, ':')) AS exit, e.n AS hops FROM nodes p JOIN (SELECT targetId, count(*) AS n FROM edges WHERE type = 'STEP_IN_PROCESS' GROUP BY 1) e ON e.targetId = p.id WHERE p.label = 'Process'"))
def h4_flow_summaries(spark, sf):
    n = X.edges(spark, sf, {"STEP_IN_PROCESS"}).groupBy(c("targetId").alias("id")).agg(F.count("*").alias("stepCount"))
    return B.flow_summaries(X.nodes(spark, sf, {"Process"}).join(n, "id"))


@query(X.sql("SELECT process, class, callee FROM (SELECT p.id AS process, h.sourceId AS class, e.targetId AS callee, row_number() OVER (PARTITION BY p.id, h.sourceId ORDER BY e.emit_ord, e.targetId) AS rn FROM nodes p JOIN edges h ON h.targetId = p.entryPointId AND h.type = 'HAS_METHOD' JOIN edges e ON e.sourceId = p.entryPointId AND e.type = 'CALLS' WHERE p.label = 'Process') WHERE rn <= 4"))
def h5_ingress_linking(spark, sf):
    from ..operators.relational import first_calls

    p = X.nodes(spark, sf, {"Process"}).select(c("id").alias("process"), "entryPointId")
    return first_calls(p, X.edges(spark, sf, {"HAS_METHOD"}), X.edges(spark, sf, {"CALLS"}), 4)


@query("SELECT * FROM (VALUES ('/api/users', 'GET', 'GET /api/users'), ('/v1', NULL, '/v1'), ('/', '*', '/'), ('/a/b', 'POST', 'POST /a/b')) AS t(path, method, key)")
def h6_route_paths(spark, sf):
    d = frame(spark, [("users/", "/api/", "get"), ("", "v1", "resource"), ("/", None, "*"), ("//b", "a//", " post ")], "p, prefix, m")
    return d.select(B.route_path(c("p"), c("prefix")).alias("path"), B.route_method(c("m")).alias("method")).withColumn("key", B.route_key(c("method"), c("path")))


@query("SELECT * FROM (VALUES ('app/api/x/route.ts', '/api/x'), ('src/app/(admin)/api/y/[id]/route.js', '/api/y/[id]'), ('app/blog/route.ts', NULL), ('pages/api/z/index.ts', '/api/z'), ('api/up.php', '/api/up'), ('lib/a.ts', NULL)) AS t(path, url)")
def h7_filesystem_routes(spark, sf):
    return frame(spark, [(p,) for p in ("app/api/x/route.ts", "src/app/(admin)/api/y/[id]/route.js", "app/blog/route.ts", "pages/api/z/index.ts", "api/up.php", "lib/a.ts")], "path").select("path", B.filesystem_route(c("path")).alias("url"))


@query("SELECT key, doc, duplicates FROM (SELECT CASE WHEN lang <> 'en' THEN lang || ' /' || source ELSE '/' || source END AS key, doc_id AS doc, row_number() OVER (PARTITION BY lang, source ORDER BY doc_id) AS rn, count(*) OVER (PARTITION BY lang, source) - 1 AS duplicates FROM documents WHERE lang IS NOT NULL) WHERE rn = 1")
def h8_route_registry(spark, sf):
    d = X.table(spark, sf, "documents").filter("lang is not null").select(F.when(c("lang") != "en", c("lang")).otherwise("*").alias("method"), F.concat(F.lit("/"), "source").alias("url"), c("doc_id").alias("doc"))
    return B.register_routes(d, ["doc"]).select("key", "doc", "duplicates")


#: Fetches of each order's items; routes of even parts, and one for all others.
_FETCH = "f AS (SELECT DISTINCT 'o' || l_orderkey AS source, '/p' || l_partkey || '/api' || CASE step % 4 WHEN 0 THEN '/[param]' WHEN 1 THEN '/' || step WHEN 2 THEN '/' || step ELSE '/a/b' END AS fetched, l_partkey AS p, step % 4 AS k FROM steps), hit AS (SELECT source, fetched, CASE WHEN k < 3 AND p % 2 = 0 THEN '/p' || p || '/api/[id]' WHEN k = 3 THEN '/[...rest]' END AS route FROM f)"


def _fetches(spark, sf):
    k, p, n = c("step") % 4, c("l_partkey").cast("string"), c("step").cast("string")
    tail = F.when(k == 0, F.lit("/${id}")).when(k == 1, F.concat(F.lit("/"), n)).when(k == 2, F.concat(F.lit("/"), n, F.lit("?x=1"))).otherwise(F.lit("/a/b"))
    return X.steps(spark, sf).select(F.concat(F.lit("o"), c("l_orderkey").cast("string")).alias("source"), F.concat(F.lit("/p"), p, F.lit("/api"), tail).alias("url"))


def _fetch_routes(spark, sf):
    own = X.table(spark, sf, "part").filter("p_partkey % 2 = 0").select(F.concat(F.lit("/p"), c("p_partkey").cast("string"), F.lit("/api/[id]")).alias("url"), F.lit(0).alias("ord"))
    return own.union(spark.createDataFrame([("/[...rest]", 1)], "url string, ord int"))


@query(X.sql("SELECT source, fetched, coalesce(route, '/[...rest]') AS route FROM hit", _FETCH))
def h9_fetch_matching(spark, sf):
    return B.match_fetches(_fetches(spark, sf), _fetch_routes(spark, sf)).select("source", c("fetch").alias("fetched"), "route")


FETCHES = [("a", "/api/users/${id}?x=1"), ("a", "/api/users/7/posts"), ("b", "/api/files/a/b/c"), ("b", "`/api/upload.php`"), ("c", "/api/" + "+ x"), ("c", "http://x/y"), ("c", "/api/none/at/all"), ("d", "/api/users/new")]
ROUTES = [("/api/users/[id]", 0), ("/api/users/new", 1), ("/api/users/[id]/posts", 2), ("/api/files/[...path]", 3), ("/api/upload", 4)]


@query("SELECT * FROM (VALUES ('a', '/api/users/[id]', 'fetch|keys:id,name|fetches:2'), ('a', '/api/users/[id]/posts', 'fetch|keys:id,name|fetches:2'), ('d', '/api/users/[id]', 'fetch')) AS t(source, route, reason)")
def h10_fetch_reasons(spark, sf):
    m = B.match_fetches(frame(spark, [f for f in FETCHES if f[0] in "ad"], "source, url"), spark.createDataFrame(ROUTES, "url string, ord int"))
    return B.fetch_reasons(m, frame(spark, [("a", "name"), ("a", "id"), ("a", "id")], "source, key"))


@query("""SELECT page_id, array_to_string(list_sort(list_distinct(list_concat(regexp_extract_all(html, '(?:href|action|src)=["''](/[^"''#?]*)', 1), regexp_extract_all(html, '\\burl:\\s*["''](/[^"''#?]*)', 1)))), ' ') AS urls FROM pages""")
def h11_template_urls(spark, sf):
    return X.table(spark, sf, "pages").select("page_id", F.array_join(F.array_sort(B.template_urls(c("html"))), " ").alias("urls"))


def _order_lines(spark, sf, text):
    """A file for each order: a first line, and a line for each item."""
    g = X.steps(spark, sf).select(F.concat(F.lit("o"), c("l_orderkey").cast("string"), F.lit(".ts")).alias("path"), "step", text.alias("t")).groupBy("path").agg(F.array_sort(F.collect_list(F.struct("step", "t"))).alias("ts"))
    return E.lines(g.select("path", F.concat(F.lit("// order\n"), F.array_join(F.transform("ts", lambda t: t["t"]), "\n")).alias("content")))


@query(X.sql("SELECT 'o' || l_orderkey || '.ts' AS path, step + 1 AS line, unnest(CASE l_partkey % 3 WHEN 0 THEN ['/api/a' || l_partkey] WHEN 1 THEN ['/api/b', '/c' || l_suppkey] ELSE []::VARCHAR[] END) AS url FROM steps"))
def h12_wrapper_urls(spark, sf):
    p, s = c("l_partkey").cast("string"), c("l_suppkey").cast("string")
    text = F.when(c("l_partkey") % 3 == 0, F.concat(F.lit("const r = apiFetch('/api/a"), p, F.lit("');"))).when(c("l_partkey") % 3 == 1, F.concat(F.lit('apiFetch("/api/b"); apiFetch(`/c'), s, F.lit("`)"))).otherwise(F.lit("myapiFetch('/no'); apiFetch(x)"))
    return B.wrapper_urls(_order_lines(spark, sf, text), "apiFetch")


_HANDLERS = "cls AS (SELECT 'C' || (s_suppkey % 70) AS class, min('f' || s_suppkey) AS file FROM supplier GROUP BY 1 HAVING count(*) = 1), sym AS (SELECT 'C' || (s_suppkey % 70) AS class, 'm' || (s_nationkey % 5) AS method, 'M' || s_suppkey AS id FROM supplier), r AS (SELECT 'r' || c_custkey AS file, 'C' || (c_custkey % 90) AS controller, 'm' || (c_nationkey % 5) AS action FROM customer)"


@query(f"WITH {_HANDLERS} SELECT 'File:' || r.file AS sourceId, coalesce(sym.id, 'Method:' || cls.file || ':' || action) AS targetId, CASE WHEN sym.id IS NULL THEN 0.8 ELSE 1.0 END::DOUBLE AS confidence FROM r JOIN cls ON cls.class = controller LEFT JOIN sym ON sym.class = controller AND sym.method = action")
def h16_handler_calls(spark, sf):
    name = lambda k, x: F.concat(F.lit(k), x.cast("string"))
    symbols = X.table(spark, sf, "supplier").select(name("C", c("s_suppkey") % 70).alias("class"), name("f", c("s_suppkey")).alias("file"), name("m", c("s_nationkey") % 5).alias("method"), name("M", c("s_suppkey")).alias("id"))
    routes = X.table(spark, sf, "customer").select(name("r", c("c_custkey")).alias("file"), name("C", c("c_custkey") % 90).alias("controller"), name("m", c("c_nationkey") % 5).alias("action"))
    return B.handler_calls(routes, symbols)


@query(
    X.sql(
        "SELECT 'o' || l_orderkey || '.ts' AS path, step AS line, unnest(CASE l_partkey % 3 WHEN 0 THEN [{'orm': 'prisma', 'model': 'm' || l_partkey, 'method': 'findMany'}, {'orm': 'prisma', 'model': 'post', 'method': 'create'}] "
        "WHEN 1 THEN [{'orm': 'supabase', 'model': 'i' || l_suppkey, 'method': 'select'}] ELSE [] END, recursive := true) FROM steps"
    )
)
def h17_orm_calls(spark, sf):
    p, s = c("l_partkey").cast("string"), c("l_suppkey").cast("string")
    text = F.when(c("l_partkey") % 3 == 0, F.concat(F.lit("await prisma.m"), p, F.lit(".findMany({}); prisma.post.create()"))).when(c("l_partkey") % 3 == 1, F.concat(F.lit("supabase.from('i"), s, F.lit("').select('*')"))).otherwise(F.lit("prisma.x.other(); supabase.rpc('y')"))
    return B.orm_calls(_order_lines(spark, sf, text))


@query("SELECT DISTINCT 'File:' || user_id AS sourceId, CASE WHEN event_type IN ('click', 'view') THEN 'Class:' || event_type ELSE 'CodeElement:orm.' || event_type END AS targetId, event_type NOT IN ('click', 'view') AS created FROM events")
def h18_query_edges(spark, sf):
    e = X.table(spark, sf, "events").select(c("user_id").cast("string").alias("path"), F.lit("orm").alias("orm"), c("event_type").alias("model"), F.lit("m").alias("method"))
    return B.query_edges(e, frame(spark, [("click", "Class:click"), ("view", "Class:view")], "name, id")).select("sourceId", "targetId", "created")


@query("SELECT * FROM (VALUES ('search', 'a.ts', 1), ('write', 'a.ts', 2)) AS t(name, path, line)")
def h19_tools(spark, sf):
    f = frame(spark, [("a.ts", "{ name: 'search', description: 'x' }\n{ name: \"write\", description: 'y' }"), ("b.ts", "{ name: 'search', description: 'again' }")], "path, content")
    return B.tool_definitions(E.lines(f))


@query("SELECT * REPLACE (confidence::DOUBLE AS confidence) FROM (VALUES ('c1', 'p1', 0.95), ('c2', 'p1', 0.5), ('c2', 'p2', 0.5), ('c3', 'q1', 0.9), ('c4', 'p1', 0.8), ('c4', 'p2', 0.8), ('c5', 'q1', 0.85), ('c6', 'r2', 0.95)) AS t(sourceId, targetId, confidence)")
def h20_injection(spark, sf):
    points = spark.createDataFrame([("c1", "P", "pone", False), ("c2", "P", None, False), ("c3", "Q", None, False), ("c4", "P", None, True), ("c5", "Q", "nope", False), ("c6", "R", None, False), ("q1", "Q", None, False)], "class string, type string, qualifier string, collection boolean")
    providers = spark.createDataFrame([("p1", "pone", False), ("p2", "ptwo", False), ("q1", "qone", False), ("r1", "rone", False), ("r2", "rtwo", True)], "id string, name string, primary boolean")
    subtypes = frame(spark, [("P", "p1"), ("P", "p2"), ("Q", "q1"), ("R", "r1"), ("R", "r2")], "type, id")
    return B.inject(points, providers, subtypes)


@query("SELECT * REPLACE (confidence::DOUBLE AS confidence) FROM (VALUES ('m2', 'log', 0.95), ('m3', 'log', 0.95)) AS t(method, aspect, confidence)")
def h22_inherited_advice(spark, sf):
    return B.inherited_advice(frame(spark, [("m1", "log")], "method, aspect"), frame(spark, [("m2", "m1"), ("m3", "m2"), ("x", "y")], "method, overridden"))


@query("SELECT * FROM (VALUES (2, 'ConditionalOnProperty', 'app.on'), (3, 'ConditionalOnClass', ''), (4, 'ConditionalOnMissingBean', '')) AS t(line, annotation, keys)")
def h23_conditionals(spark, sf):
    f = frame(spark, [("A.java", 'x\n@ConditionalOnProperty(prefix = "app", name = "on", havingValue = "true")\n@ConditionalOnClass(Foo.class)\n  @ConditionalOnMissingBean')], "path, content")
    return B.conditional_annotations(E.lines(f)).select("line", "annotation", F.array_join("keys", ",").alias("keys"))


@query("SELECT * FROM (VALUES ('s1', 'k1'), ('s2', 'k1'), ('s2', 'k2')) AS t(sourceId, targetId)")
def h24_config_bindings(spark, sf):
    b = spark.createDataFrame([("s1", "app.a.x", False), ("s2", "app.a", True), ("s3", "app.ax", False)], "symbol string, key string, prefix boolean")
    return B.config_bindings(b, frame(spark, [("k1", "app.a.x"), ("k2", "app.a.y"), ("k3", "app.ab")], "id, name"))


@query("SELECT DISTINCT 'File:o' || l_orderkey AS sourceId, CASE WHEN l_suppkey % 2 = 0 THEN 'Class:' || l_suppkey ELSE 'Class:synthetic:c.S' || l_suppkey END AS targetId, l_suppkey % 2 = 1 AS synthetic FROM lineitem")
def h25_auto_configuration(spark, sf):
    name = lambda k, x: F.concat(F.lit(k), x.cast("string"))
    told = X.table(spark, sf, "lineitem").select(name("o", c("l_orderkey")).alias("path"), name("c.S", c("l_suppkey")).alias("class")).distinct()
    return B.declared_configurations(told, X.table(spark, sf, "supplier").filter("s_suppkey % 2 = 0").select(name("Class:", c("s_suppkey")).alias("id"), name("c.S", c("s_suppkey")).alias("qualified")))


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN greatest(c_nationkey / 5.0, 3.0) ELSE c_nationkey / 5.0 END AS multiplier FROM customer")
def h26_handler_multiplier(spark, sf):
    s = X.table(spark, sf, "customer").select(c("c_custkey").alias("id"), (c("c_nationkey") / 5.0).alias("multiplier"))
    return B.raise_multiplier(s, s.filter("id % 2 = 0"))


_FILES = "files AS (SELECT 'Method:P' || p_partkey AS id, 'Method' AS label, p_name AS name, ['src/listener/a', 'src/client/b', 'src/controller/c', 'src/service/d', 'src/repo/e'][p_partkey % 5 + 1] AS filePath FROM part)"
_ROLE = "CASE WHEN contains(filePath, 'listener') THEN 'Ingress' WHEN contains(filePath, 'client') OR contains(filePath, 'repo') THEN 'Egress' WHEN contains(filePath, 'controller') THEN 'Controller' ELSE 'Service' END"


def _files(spark, sf):
    kinds = F.array(*(F.lit(p) for p in ("src/listener/a", "src/client/b", "src/controller/c", "src/service/d", "src/repo/e")))
    return X.table(spark, sf, "part").select(F.concat(F.lit("Method:P"), c("p_partkey").cast("string")).alias("id"), F.lit("Method").alias("label"), c("p_name").alias("name"), F.element_at(kinds, (c("p_partkey") % 5 + 1).cast("int")).alias("filePath"))


@query(f"WITH {_FILES} SELECT id, {_ROLE} AS role FROM files")
def h27_roles(spark, sf):
    return _files(spark, sf).select("id", B.role(c("filePath"), c("label")).alias("role"))


@query("SELECT * FROM (VALUES ('r1', 'm1'), ('r2', 'm2')) AS t(route, handler)")
def h28_route_handlers(spark, sf):
    return B.route_handlers(frame(spark, [("r1", "m1"), ("r2", None), ("r3", "gone")], "id, handlerSymbolId"), frame(spark, [("m3", "r1"), ("m2", "r2"), ("x", "r3")], "sourceId, targetId"), frame(spark, [("m1",), ("m2",), ("m3",)], "id"))


@query(f"WITH {_FILES} SELECT id, 'event' AS kind FROM files WHERE contains(filePath, 'listener') AND id <> 'Method:P5'")
def h29_entry_points(spark, sf):
    return B.entry_points(_files(spark, sf), frame(spark, [("Method:P5",)], "handler"))


_FLOW = (
    _FILES
    + ", ent AS (SELECT id FROM files WHERE contains(filePath, 'listener')), w AS (SELECT id AS entry, id AS node, 0 AS depth FROM ent UNION SELECT w.entry, e.targetId, w.depth + 1 FROM w JOIN edges e ON e.type = 'CALLS' AND e.sourceId = w.node AND e.confidence >= 0.8 WHERE depth < 2), best AS (SELECT entry, node, min(depth) AS depth FROM w GROUP BY 1, 2), "
    + f"st AS (SELECT entry, CASE WHEN {_ROLE} IN ('Egress', 'Controller') THEN {_ROLE} ELSE 'Service' END AS role, node AS id, name, depth FROM best JOIN files ON files.id = node WHERE node <> entry), uniq AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entry, role, name ORDER BY depth, id) AS rn FROM st) WHERE rn = 1)"
)


def _steps(spark, sf):
    files = _files(spark, sf)
    entries = files.filter(c("filePath").contains("listener"))
    calls = X.edges(spark, sf, {"CALLS"}).filter("confidence >= 0.8")
    return B.workflow_steps(entries, frame(spark, [("none", "none")], "route, handler"), files, calls, hops=2), entries


@query(X.sql("SELECT entry, role, id, name, depth FROM uniq", _FLOW, recursive=True))
def h30_workflow_steps(spark, sf):
    return _steps(spark, sf)[0]


@query(X.sql("SELECT entry, count(*) FILTER (role = 'Controller') AS controllers, count(*) FILTER (role = 'Service') AS services, count(*) FILTER (role = 'Egress') AS sinks, 1 + count(*) AS totalSteps FROM uniq GROUP BY entry", _FLOW, recursive=True))
def h31_workflows(spark, sf):
    w = B.workflows(*_steps(spark, sf))
    return w.select("entry", F.size("controllers").alias("controllers"), F.size("services").alias("services"), F.size("egressSinks").alias("sinks"), "totalSteps")


@query(X.sql("SELECT f.id, CASE WHEN contains(f.filePath, 'client') THEN 'Outbound HTTP / REST Client' ELSE 'Database / JPA / ORM' END AS category, coalesce(string_agg(DISTINCT e.sourceId, ', ' ORDER BY e.sourceId), '(Direct Ingress)') AS callers, '(Internal Domain)' AS origins FROM files f LEFT JOIN edges e ON e.type = 'CALLS' AND e.targetId = f.id AND e.confidence >= 0.95 WHERE contains(f.filePath, 'client') OR contains(f.filePath, 'repo') GROUP BY 1, 2", _FILES))
def h32_egress_report(spark, sf):
    sinks = _files(spark, sf).filter(c("filePath").contains("client") | c("filePath").contains("repo"))
    calls = X.edges(spark, sf, {"CALLS"}).filter("confidence >= 0.95").select(c("sourceId").alias("caller"), c("targetId").alias("sinkId"))
    return B.egress_report(sinks, calls, frame(spark, [("x", "y")], "ingress, sinkId"))


@query("SELECT conv_id AS processId, turn AS step, '[' || CASE WHEN turn = min(turn) OVER w THEN 'ENTRY' WHEN turn = max(turn) OVER w THEN 'EXIT' ELSE 'STEP' END || '] ' || role AS line FROM conversations WINDOW w AS (PARTITION BY conv_id)")
def h33_rendered_steps(spark, sf):
    return B.rendered_steps(X.table(spark, sf, "conversations").select(c("conv_id").alias("processId"), c("turn").alias("step"), c("role").alias("name")))


@query("SELECT * FROM (VALUES ('r1', 'm1')) AS t(route, id)")
def h34_text_handlers(spark, sf):
    files = frame(spark, [("r.ts", "import { saveUser } from './m'; own(); ab()")], "path, content")
    return B.text_handlers(frame(spark, [("r1", "r.ts")], "id, filePath"), files, frame(spark, [("m1", "saveUser", "m.ts"), ("m2", "own2", "m.ts"), ("m3", "import", "r.ts"), ("m4", "ab", "m.ts")], "id, name, filePath"))


# --- resolution -----------------------------------------------------------------------------------

_CAND = """cand AS (SELECT src AS site, 'P' || dst AS id, ['local', 'import', 'namespace', 'wildcard'][dst % 4 + 1] AS origin, dst % 3 = 0 AS unlinked, (dst % 5)::INT AS scope_depth,
  CASE WHEN dst % 2 = 0 THEN (dst % 7)::INT END AS mro_depth, dst % 11 = 0 AS owner_match, ['compatible', 'unknown', 'incompatible'][dst % 3 + 1] AS arity, dst % 13 = 0 AS dynamic FROM calls),
conf AS (SELECT *, round(greatest(0.0, least(1.0, CASE origin WHEN 'local' THEN 0.55 WHEN 'import' THEN 0.45 WHEN 'namespace' THEN 0.4 ELSE 0.3 END::DOUBLE * CASE WHEN unlinked THEN 0.5 ELSE 1.0 END::DOUBLE - 0.02::DOUBLE * scope_depth
  + CASE WHEN mro_depth IS NULL THEN 0.0 ELSE [0.5, 0.42, 0.36, 0.32, 0.3][least(mro_depth, 4) + 1] END::DOUBLE + CASE WHEN owner_match THEN 0.2 ELSE 0.0 END::DOUBLE + CASE arity WHEN 'compatible' THEN 0.1 WHEN 'unknown' THEN 0.0 ELSE -0.15 END::DOUBLE + CASE WHEN dynamic THEN 0.02 ELSE 0.0 END::DOUBLE)), 9) AS confidence FROM cand)"""


def _candidates(spark, sf):
    d = c("dst")
    pick = lambda names, n: F.element_at(F.array(*(F.lit(x) for x in names)), (d % n + 1).cast("int"))
    x = X.calls(spark, sf).select(c("src").alias("site"), F.concat(F.lit("P"), d.cast("string")).alias("id"), pick(["local", "import", "namespace", "wildcard"], 4).alias("origin"), (d % 3 == 0).alias("unlinked"), (d % 5).cast("int").alias("scope_depth"), F.when(d % 2 == 0, (d % 7).cast("int")).alias("mro_depth"), (d % 11 == 0).alias("owner_match"), pick(["compatible", "unknown", "incompatible"], 3).alias("arity"), (d % 13 == 0).alias("dynamic"))
    return x.withColumn("confidence", R.confidence())


@query(X.sql("SELECT site, id, confidence FROM conf", _CAND))
def m1_evidence(spark, sf):
    return _candidates(spark, sf).select("site", "id", "confidence")


@query(X.sql("SELECT site, id FROM (SELECT site, id, row_number() OVER (PARTITION BY site ORDER BY round(confidence, 3) DESC, scope_depth, coalesce(mro_depth, 2147483647), CASE origin WHEN 'local' THEN 0 WHEN 'import' THEN 1 WHEN 'namespace' THEN 3 ELSE 4 END, id) AS rn FROM conf) WHERE rn = 1", _CAND))
def m2_ranking(spark, sf):
    return R.rank(_candidates(spark, sf)).filter("rn = 1").select("site", "id")


#: Scopes: supplier k lies inside supplier k // 2; what a scope binds comes from the first lines of orders.
_SC = """sc AS MATERIALIZED (SELECT s_suppkey AS scope, CASE WHEN s_suppkey // 2 >= 1 AND s_suppkey // 2 <> s_suppkey THEN s_suppkey // 2 END AS parent FROM supplier),
up AS (SELECT scope, scope AS anc, 0 AS depth FROM sc UNION ALL SELECT up.scope, sc.parent, depth + 1 FROM up JOIN sc ON sc.scope = up.anc WHERE sc.parent IS NOT NULL),
bind AS MATERIALIZED (SELECT DISTINCT l_suppkey AS scope, 'n' || (l_partkey % 50) AS name, CASE WHEN l_partkey % 2 = 0 THEN 'var' ELSE 'fn' END AS kind FROM lineitem WHERE l_linenumber = 1),
site AS MATERIALIZED (SELECT DISTINCT l_orderkey || '-' || l_linenumber || '-' || l_partkey AS site, l_suppkey AS scope, 'n' || (l_partkey % 50) AS name, l_linenumber AS k FROM lineitem)"""


def _scopes(spark, sf):
    half = F.floor(c("s_suppkey") / 2)
    return X.table(spark, sf, "supplier").select(c("s_suppkey").alias("scope"), F.when((half >= 1) & (half != c("s_suppkey")), half).cast("long").alias("parent"))


def _bindings(spark, sf):
    b = X.table(spark, sf, "lineitem").filter("l_linenumber = 1").select(c("l_suppkey").alias("scope"), F.concat(F.lit("n"), (c("l_partkey") % 50).cast("string")).alias("name"), F.when(c("l_partkey") % 2 == 0, "var").otherwise("fn").alias("kind")).distinct()
    return b.withColumn("id", F.concat_ws(":", c("scope").cast("string"), "name", "kind"))


def _sites(spark, sf):
    return X.table(spark, sf, "lineitem").select(F.concat_ws("-", c("l_orderkey").cast("string"), c("l_linenumber").cast("string"), c("l_partkey").cast("string")).alias("site"), c("l_suppkey").alias("scope"), F.concat(F.lit("n"), (c("l_partkey") % 50).cast("string")).alias("name"), c("l_linenumber").alias("k")).distinct()


@query(
    "WITH RECURSIVE " + _SC + " SELECT site, id, depth FROM (SELECT s.site, s.k, b.kind, b.scope || ':' || b.name || ':' || b.kind AS id, u.depth, min(u.depth) OVER (PARTITION BY s.site) AS m FROM site s JOIN up u ON u.scope = s.scope JOIN bind b ON b.scope = u.anc AND b.name = s.name) "
    "WHERE depth = m AND (kind = 'fn' OR k % 2 = 0)"
)
def m3_lexical_lookup(spark, sf):
    sites = _sites(spark, sf).withColumn("kinds", F.when(c("k") % 2 == 0, F.array(F.lit("fn"), F.lit("var"))).otherwise(F.array(F.lit("fn"))))
    return R.lexical(sites, R.scope_chain(_scopes(spark, sf)), _bindings(spark, sf))


@query(
    "WITH RECURSIVE " + _SC + " SELECT site, id, mro_depth FROM (SELECT s.site, b.scope || ':' || b.name || ':' || b.kind AS id, u.depth AS mro_depth, min(u.depth) OVER (PARTITION BY s.site) AS m FROM site s JOIN up u ON u.scope = s.scope JOIN bind b ON b.scope = u.anc AND b.name = s.name) WHERE mro_depth = m"
)
def m4_receiver_members(spark, sf):
    mro = R.scope_chain(_scopes(spark, sf)).filter("depth > 0").select(c("scope").alias("class"), "ancestor", "depth")
    return R.members_of(_sites(spark, sf).select("site", c("scope").alias("type"), "name"), mro, _bindings(spark, sf).select(c("scope").alias("class"), "name", "id"))


@query("SELECT l_orderkey AS site, l_linenumber AS args, CASE WHEN l_linenumber >= 2 AND l_linenumber <= 4 THEN 'compatible' ELSE 'incompatible' END AS arity FROM lineitem WHERE l_linenumber >= 2 AND l_linenumber <= 4")
def m5_arity_filter(spark, sf):
    x = X.table(spark, sf, "lineitem").select(c("l_orderkey").alias("site"), c("l_linenumber").alias("args"), R.arity_verdict(c("l_linenumber"), F.lit(2), F.lit(4)).alias("arity"))
    return R.arity_filter(x)


@query("SELECT o_orderkey AS site, 'l' || o_custkey AS id, 'local' AS origin FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT o_orderkey, 'g' || n_nationkey, 'global-qualified' FROM orders JOIN nation ON n_nationkey = o_custkey % 40 WHERE o_orderstatus <> 'F'")
def m6_global_fallback(spark, sf):
    o = X.table(spark, sf, "orders")
    found = o.filter("o_orderstatus = 'F'").select(c("o_orderkey").alias("site"), F.concat(F.lit("l"), c("o_custkey").cast("string")).alias("id"), F.lit("local").alias("origin"))
    names = X.table(spark, sf, "nation").select(c("n_nationkey").cast("long").alias("qualified"), F.concat(F.lit("g"), c("n_nationkey").cast("string")).alias("id"))
    return R.with_fallback(found, o.select(c("o_orderkey").alias("site"), (c("o_custkey") % 40).alias("name")), names)


@query(
    "WITH RECURSIVE " + _SC + ", own AS (SELECT up.scope, arg_min(anc, depth) AS owner FROM up WHERE anc % 3 = 0 GROUP BY 1), refs AS (SELECT DISTINCT l_suppkey AS scope, 'P' || l_partkey AS id, CASE l_linenumber % 4 WHEN 0 THEN 'call' WHEN 1 THEN 'read' WHEN 2 THEN 'write' ELSE 'type' END AS kind FROM lineitem) "
    "SELECT DISTINCT 'S' || owner AS sourceId, id AS targetId, CASE kind WHEN 'call' THEN 'CALLS' WHEN 'type' THEN 'USES' ELSE 'ACCESSES' END AS type, CASE kind WHEN 'read' THEN 1 WHEN 'write' THEN 2 ELSE 0 END AS step FROM refs JOIN own USING (scope)"
)
def m8_reference_edges(spark, sf):
    scopes = _scopes(spark, sf)
    kinds = F.element_at(F.array(F.lit("call"), F.lit("read"), F.lit("write"), F.lit("type")), (c("l_linenumber") % 4 + 1).cast("int"))
    refs = X.table(spark, sf, "lineitem").select(c("l_suppkey").alias("scope"), F.concat(F.lit("P"), c("l_partkey").cast("string")).alias("id"), kinds.alias("kind"))
    return R.reference_edges(refs, scopes.withColumn("owner", F.when(c("scope") % 3 == 0, F.concat(F.lit("S"), c("scope").cast("string")))), R.scope_chain(scopes))


@query("SELECT DISTINCT site, id FROM (SELECT l_orderkey AS site, l_partkey AS id, CASE l_returnflag WHEN 'R' THEN 0 WHEN 'A' THEN 1 ELSE 2 END AS k, min(CASE l_returnflag WHEN 'R' THEN 0 WHEN 'A' THEN 1 ELSE 2 END) OVER (PARTITION BY l_orderkey) AS m FROM lineitem) WHERE k = m")
def m9_first_case(spark, sf):
    li = X.table(spark, sf, "lineitem").select(c("l_orderkey").alias("site"), c("l_partkey").alias("id"), "l_returnflag")
    return R.first_case([li.filter(c("l_returnflag") == f).select("site", "id").distinct() for f in ("R", "A", "N")]).select("site", "id")


#: Types: supplier k has fields a and b of the types 2k and 2k + 1; a chain for each customer, by the digits of its key.
_CHAIN = "chain AS MATERIALIZED (SELECT c_custkey AS chain, 1 + c_custkey % 3 AS type, list_transform(range(0, c_custkey % 5), lambda i: CASE WHEN (c_custkey // (2 ** i)::BIGINT) % 2 = 0 THEN 'a' ELSE 'b' END) AS parts FROM customer), w AS (SELECT chain, type, parts, 0 AS i FROM chain UNION ALL SELECT w.chain, 2 * w.type + CASE w.parts[w.i + 1] WHEN 'a' THEN 0 ELSE 1 END, w.parts, w.i + 1 FROM w JOIN supplier ON s_suppkey = w.type WHERE w.i < len(w.parts))"


@query(f"WITH RECURSIVE {_CHAIN} SELECT chain, type FROM w WHERE i = len(parts)")
def m10_compound_types(spark, sf):
    s = X.table(spark, sf, "supplier").select(c("s_suppkey").alias("type"), F.explode(F.array(F.struct(F.lit("a").alias("name"), (2 * c("s_suppkey")).alias("result")), F.struct(F.lit("b").alias("name"), (2 * c("s_suppkey") + 1).alias("result")))).alias("f"))
    k = c("c_custkey")
    bit = lambda i: F.when(F.floor(k / F.pow(F.lit(2), i)) % 2 == 0, "a").otherwise("b")
    parts = F.when(k % 5 > 0, F.transform(F.sequence(F.lit(0), (k % 5 - 1).cast("int")), bit)).otherwise(F.array().cast("array<string>"))
    chains = X.table(spark, sf, "customer").select(k.alias("chain"), (1 + k % 3).alias("type"), parts.alias("parts"))
    return R.compound_types(s.select("type", "f.name", "f.result"), chains)


_OVER = "o AS (SELECT DISTINCT l_orderkey AS site, l_partkey AS id, [CASE WHEN l_orderkey % 4 = 0 THEN NULL ELSE 'T' || (l_orderkey % 3) END, 'U' || (l_orderkey % 2)] AS args, CASE WHEN l_partkey % 5 = 0 THEN ['T0'] ELSE ['T' || (l_partkey % 3), CASE WHEN l_partkey % 7 = 0 THEN NULL ELSE 'U' || (l_partkey % 2) END] END AS types FROM lineitem), h AS (SELECT site, id, CASE WHEN args[1] = types[1] THEN 1 WHEN args[1] IS NULL THEN 0 ELSE -100 END + CASE WHEN types[2] IS NULL THEN 0 WHEN args[2] = types[2] THEN 1 ELSE -100 END AS hits FROM o WHERE len(types) = 2)"


@query(f"WITH {_OVER} SELECT site, id FROM (SELECT *, max(hits) OVER (PARTITION BY site) AS m FROM h WHERE hits >= 0) WHERE hits = m")
def m11_overloads(spark, sf):
    o, p = c("l_orderkey"), c("l_partkey")
    name = lambda k, x: F.concat(F.lit(k), x.cast("string"))
    x = X.table(spark, sf, "lineitem").select("l_orderkey", "l_partkey").distinct()
    args = F.array(F.when(o % 4 != 0, name("T", o % 3)), name("U", o % 2))
    types = F.when(p % 5 == 0, F.array(F.lit("T0"))).otherwise(F.array(name("T", p % 3), F.when(p % 7 != 0, name("U", p % 2))))
    return R.narrow_overloads(x.select(o.alias("site"), p.alias("id"), args.alias("args"), types.alias("types"))).select("site", "id")


@query("WITH RECURSIVE " + _SC + ", own AS (SELECT s_suppkey AS name, n_name AS type FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE s_suppkey % 4 = 0), t AS (SELECT up.scope AS name, arg_min(own.type, up.depth) AS type FROM up JOIN own ON own.name = up.anc GROUP BY 1) SELECT name, type FROM t")
def m12_return_types(spark, sf):
    own = X.table(spark, sf, "supplier").filter("s_suppkey % 4 = 0").join(X.table(spark, sf, "nation"), c("s_nationkey") == c("n_nationkey")).select(c("s_suppkey").alias("name"), c("n_name").alias("type"))
    return R.propagated_types(own, _scopes(spark, sf).filter("parent is not null").select(c("scope").alias("name"), c("parent").alias("callee")))


@query("SELECT DISTINCT 'P' || l.l_partkey AS sourceId, 'V' || e.s_suppkey AS targetId, 0.9::DOUBLE AS confidence FROM lineitem l JOIN supplier i ON i.s_suppkey = l.l_suppkey AND l.l_partkey % 5 = i.s_suppkey % 5 JOIN supplier e ON e.s_suppkey = i.s_suppkey // 2 AND (2 * e.s_suppkey) % 5 = i.s_suppkey % 5 WHERE e.s_suppkey <> i.s_suppkey")
def m13_imported_values(spark, sf):
    s = X.table(spark, sf, "supplier").select("s_suppkey")
    refs = X.table(spark, sf, "lineitem").select(c("l_suppkey").alias("file"), (c("l_partkey") % 5).alias("name"), F.concat(F.lit("P"), c("l_partkey").cast("string")).alias("source"))
    imports = s.select(c("s_suppkey").alias("file"), (c("s_suppkey") % 5).alias("name"), F.floor(c("s_suppkey") / 2).cast("long").alias("target"))
    return R.imported_values(refs, imports, s.select(c("s_suppkey").alias("file"), (2 * c("s_suppkey") % 5).alias("name"), F.concat(F.lit("V"), c("s_suppkey").cast("string")).alias("id")))


@query("SELECT c_name AS site, c_name AS sourceId, 'I' || min_key AS targetId, 0.5::DOUBLE AS confidence FROM customer JOIN (SELECT n_nationkey AS k, min(s_suppkey) AS min_key FROM nation JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1 HAVING count(*) = 1) ON k = c_nationkey WHERE c_custkey % 2 = 1")
def m15_unique_names(spark, sf):
    a = X.table(spark, sf, "customer").select(c("c_name").alias("site"), c("c_name").alias("source"), c("c_nationkey").alias("name"), "c_custkey")
    p = X.table(spark, sf, "supplier").select(c("s_nationkey").alias("name"), F.concat(F.lit("I"), c("s_suppkey").cast("string")).alias("id"))
    return R.unique_names(a, p, a.filter("c_custkey % 2 = 0"))


@query("SELECT DISTINCT c_name AS sourceId, 'S' || s_suppkey AS targetId, 0.7::DOUBLE AS confidence FROM customer JOIN supplier ON s_nationkey = c_nationkey WHERE c_nationkey IN (SELECT s_nationkey FROM supplier GROUP BY 1 HAVING count(*) <= 4)")
def m16_dispatch(spark, sf):
    reg = X.table(spark, sf, "supplier").select(c("s_nationkey").alias("key"), F.concat(F.lit("S"), c("s_suppkey").cast("string")).alias("handler"))
    return R.dispatched(reg, X.table(spark, sf, "customer").select(c("c_nationkey").alias("key"), c("c_name").alias("source")), fan_out=4)


@query(
    "WITH RECURSIVE " + _SC + ", pts AS (SELECT DISTINCT up.scope AS variable, 'f' || up.anc AS id FROM up WHERE up.anc % 5 = 1), x AS (SELECT DISTINCT c_name AS sourceId, variable, id AS targetId FROM customer JOIN pts ON variable = c_custkey % 97), n AS (SELECT *, count(*) OVER (PARTITION BY sourceId, variable) AS k FROM x) "
    "SELECT sourceId, targetId, max(CASE WHEN k = 1 THEN 0.8 ELSE 0.7 END)::DOUBLE AS confidence FROM n GROUP BY 1, 2"
)
def m17_value_flow(spark, sf):
    s = _scopes(spark, sf)
    assigned = s.filter("scope % 5 = 1").select(c("scope").alias("variable"), F.concat(F.lit("f"), c("scope").cast("string")).alias("id"))
    return R.value_flow(assigned, s.filter("parent is not null").select(c("parent").alias("from"), c("scope").alias("to")), X.table(spark, sf, "customer").select(c("c_name").alias("source"), (c("c_custkey") % 97).alias("variable")))


@query("SELECT user_id AS source, event_type AS target, CASE min(event_id % 3) WHEN 0 THEN 'import' WHEN 1 THEN 'import (deferred)' ELSE 'import (type-only)' END AS reason FROM events GROUP BY 1, 2")
def m18_import_edges(spark, sf):
    names = F.element_at(F.array(F.lit("runtime"), F.lit("deferred"), F.lit("type-only")), (c("event_id") % 3 + 1).cast("int"))
    return R.import_edges(X.table(spark, sf, "events").select(c("user_id").alias("source"), c("event_type").alias("target"), names.alias("presence")))


@query("SELECT user_id AS class, need AS interface FROM (SELECT DISTINCT user_id, event_type FROM events WHERE event_id % 7 = 0) JOIN (SELECT need, event_type, count(*) OVER (PARTITION BY need) AS k FROM (SELECT DISTINCT user_id % 3 AS need, event_type FROM events WHERE length(event_type) > 4)) USING (event_type) GROUP BY user_id, need, k HAVING count(*) = k")
def m21_structural_interfaces(spark, sf):
    e = X.table(spark, sf, "events")
    need = e.filter(F.length("event_type") > 4).select((c("user_id") % 3).alias("interface"), c("event_type").alias("name"))
    return R.satisfied(need, e.filter("event_id % 7 = 0").select(c("user_id").alias("class"), c("event_type").alias("name")))


# --- enrichment -----------------------------------------------------------------------------------


@query("SELECT 'f' || p_partkey || ext AS path, CASE ext WHEN '.java' THEN 'java' WHEN '.tsx' THEN 'typescript' WHEN '.py' THEN 'python' WHEN '.go' THEN 'go' END AS language FROM (SELECT p_partkey, ['.java', '.tsx', '.rb', '.py', '.go', ''][1 + p_partkey % 6] AS ext FROM part)")
def n1_languages(spark, sf):
    ext = F.element_at(F.array(*(F.lit(x) for x in (".java", ".tsx", ".rb", ".py", ".go", ""))), (c("p_partkey") % 6 + 1).cast("int"))
    return X.table(spark, sf, "part").select(F.concat(F.lit("f"), c("p_partkey").cast("string"), ext).alias("path")).select("path", N.language_of(c("path")).alias("language"))


_ACC = "a AS (SELECT 'm' || p_partkey AS id, ['get', 'set', 'run'][1 + p_partkey % 3] || (p_partkey % 700) AS name, p_partkey AS startLine, p_partkey + p_size % 4 AS endLine FROM part)"


@query(f"WITH {_ACC} SELECT id FROM (SELECT *, count(*) OVER (PARTITION BY name) AS n FROM a) WHERE NOT (endLine - startLine <= 1 AND n <= 1 AND (name LIKE 'get%' OR name LIKE 'set%'))")
def n2_accessors(spark, sf):
    k = c("p_partkey")
    kind = F.element_at(F.array(F.lit("get"), F.lit("set"), F.lit("run")), (k % 3 + 1).cast("int"))
    rows = X.table(spark, sf, "part").select(F.concat(F.lit("m"), k.cast("string")).alias("id"), F.concat(kind, (k % 700).cast("string")).alias("name"), k.alias("startLine"), (k + c("p_size") % 4).alias("endLine"))
    return N.worth_asking(rows).select("id")


@query(X.sql("SELECT n.id AS sourceId, 'I' AS targetId, 1.0::DOUBLE AS confidence FROM nodes n WHERE n.label = 'Class'"))
def n3_implementations(spark, sf):
    cls = X.nodes(spark, sf, {"Class"}).withColumn("filePath", c("name"))
    return N.implementation_edges(cls.select(c("name").alias("file"), F.lit("I").alias("interfaceId")), cls)


_LSP = "lsp AS (SELECT 'Method:P' || src AS callerId, p_name AS calleeName, p_brand AS calleeFile FROM calls JOIN part ON p_partkey = dst), loc AS (SELECT DISTINCT callerId AS caller, callee, calleeFile AS file FROM (SELECT l.*, n.id AS callee, row_number() OVER (PARTITION BY callerId, calleeName, calleeFile ORDER BY n.id) AS rn FROM lsp l JOIN nodes n ON n.label = 'Method' AND n.filePath = l.calleeFile AND n.name = l.calleeName) WHERE rn = 1 AND callee <> callerId), wrong AS (SELECT DISTINCT e.sourceId, e.targetId FROM edges e JOIN nodes t ON t.id = e.targetId JOIN loc ON loc.caller = e.sourceId AND loc.file = t.filePath AND loc.callee <> e.targetId WHERE e.type = 'CALLS' AND e.confidence < 1.0)"


def _lsp(spark, sf):
    part = X.table(spark, sf, "part").select("p_partkey", c("p_name").alias("calleeName"), c("p_brand").alias("calleeFile"))
    return X.calls(spark, sf).join(part, c("dst") == c("p_partkey")).select(F.concat(F.lit("Method:P"), c("src").cast("string")).alias("callerId"), "calleeName", "calleeFile")


@query(X.sql("SELECT caller, callee, file FROM loc", _LSP))
def n4_locate(spark, sf):
    return N.locate(_lsp(spark, sf), X.nodes(spark, sf, {"Method"}))


@query(X.sql("SELECT sourceId, targetId, confidence FROM edges e WHERE type = 'CALLS' AND NOT (confidence < 1.0 AND EXISTS (SELECT 1 FROM wrong w WHERE w.sourceId = e.sourceId AND w.targetId = e.targetId)) UNION ALL SELECT caller, callee, 1.0 FROM loc", _LSP))
def n5_conflict_pruning(spark, sf):
    g, _ = N.enrich(X.graph(spark, sf, {"Method"}, {"CALLS"}), _lsp(spark, sf))
    return g.edges.select("sourceId", "targetId", "confidence")


@query(X.sql("SELECT (SELECT count(*) FROM loc) AS calls, (SELECT count(*) FROM wrong) AS conflicts", _LSP))
def n6_enrichment_stats(spark, sf):
    return N.enrich(X.graph(spark, sf, {"Method"}, {"CALLS"}), _lsp(spark, sf))[1]


# --- program dependence and taint -------------------------------------------------------------------

CFG_TYPE = "fn string, n int, entry int, exit int, edges array<struct<src:int,dst:int,kind:string>>, facts array<struct<block:int,line:int,defs:array<string>,uses:array<string>,may:array<string>>>, sources array<struct<block:int,line:int,kind:string>>, sinks array<struct<block:int,line:int,kind:string>>, cleans array<struct<block:int,line:int,kind:string>>"
CFGS = [
    ("diamond", 5, 0, 4, [(0, 1, "cond-true"), (0, 2, "cond-false"), (1, 3, "seq"), (2, 3, "seq"), (3, 4, "return")], [(0, 1, ["x"], [], []), (1, 2, ["x"], ["x"], []), (3, 4, ["y"], ["x"], []), (3, 5, [], ["y"], [])], [(0, 1, "")], [(3, 5, "sql")], [(1, 2, "sql")]),
    ("loop", 4, 0, 3, [(0, 1, "seq"), (1, 2, "cond-true"), (2, 1, "loop-back"), (1, 3, "cond-false")], [(0, 1, ["i"], [], []), (1, 2, [], ["i"], []), (2, 3, ["i"], ["i"], [])], [], [], []),
    ("forever", 4, 0, 3, [(0, 1, "seq"), (1, 2, "seq"), (2, 1, "loop-back")], [], [], [], []),
    ("thrower", 4, 0, 3, [(0, 1, "seq"), (1, 2, "throw"), (1, 3, "seq"), (2, 3, "seq")], [(0, 1, ["a"], [], []), (1, 2, ["a"], [], []), (2, 3, [], ["a"], []), (3, 4, [], ["a"], [])], [(0, 1, "")], [(2, 3, "html")], []),
]


def _cfgs(spark):
    """Four functions whose facts are known by hand (tests)."""
    return spark.createDataFrame(CFGS, CFG_TYPE)


def _order_cfgs(spark, sf):
    """Each order as a function: a block for each item between entry and exit; returned items branch, some loop back, some throw.
    Item k stands in line k, defines one of three variables and uses one."""
    name = lambda x: F.concat(F.lit("v"), (x % 3).cast("string"))
    none = F.lit(None).cast("struct<src:int,dst:int,kind:string>")
    edge = lambda a, b, kind: F.struct(a.cast("int").alias("src"), b.cast("int").alias("dst"), F.lit(kind).alias("kind"))
    s = X.steps(spark, sf).select("l_orderkey", "step", c("l_partkey").alias("p"), c("l_suppkey").alias("s"), c("l_returnflag").alias("f"))
    s = s.withColumn("m", F.count("*").over(W.partitionBy("l_orderkey")))
    back = c("f") == "R"
    s = s.withColumn("edges", F.array_compact(F.array(
        F.when(c("step") == 1, edge(F.lit(0), F.lit(1), "seq")).otherwise(none), F.when(back, edge(c("step"), c("step") + 1, "cond-true")).otherwise(edge(c("step"), c("step") + 1, "seq")),
        F.when(back, edge(c("step"), F.least(c("step") + 2, c("m") + 1), "cond-false")), F.when(c("p") % 5 == 0, edge(c("step"), F.greatest(F.lit(1), c("step") - 2), "loop-back")), F.when(c("s") % 7 == 0, edge(c("step"), F.least(c("step") + 3, c("m") + 1), "throw")),
    )))
    at = [c("step").cast("int").alias("block"), c("step").cast("int").alias("line")]
    empty = F.array().cast("array<string>")
    fact = F.struct(*at, F.array(name(c("p"))).alias("defs"), F.array(name(c("s"))).alias("uses"), empty.alias("may"))
    role = lambda on, kind: F.array_sort(F.collect_list(F.when(on, F.struct(*at, kind.alias("kind")))))
    kind = F.when(c("f") == "N", "html").otherwise("sql")
    return s.groupBy("l_orderkey").agg(
        (F.max("m") + 2).cast("int").alias("n"), (F.max("m") + 1).cast("int").alias("exit"), F.flatten(F.collect_list("edges")).alias("edges"), F.collect_list(fact).alias("facts"),
        role(c("p") % 4 == 0, F.lit("")).alias("sources"), role(c("s") % 4 == 0, kind).alias("sinks"), role(c("p") % 6 == 5, F.lit("sql")).alias("cleans"),
    ).select(c("l_orderkey").cast("string").alias("fn"), "n", F.lit(0).alias("entry"), "exit", "edges", "facts", "sources", "sinks", "cleans")


#: The same in SQL: items st, edges ce, blocks bl; definitions that reach uses (df), and what they carry of sources.
_CFG = """st AS MATERIALIZED (SELECT l_orderkey::VARCHAR AS fn, step::INT AS k, l_partkey AS p, l_suppkey AS s, l_returnflag AS f, (count(*) OVER (PARTITION BY l_orderkey))::INT AS m FROM steps),
ce AS MATERIALIZED (SELECT fn, 0 AS src, 1 AS dst, 'seq' AS kind FROM st WHERE k = 1
  UNION ALL SELECT fn, k, k + 1, CASE WHEN f = 'R' THEN 'cond-true' ELSE 'seq' END FROM st
  UNION ALL SELECT fn, k, least(k + 2, m + 1), 'cond-false' FROM st WHERE f = 'R'
  UNION ALL SELECT fn, k, greatest(1, k - 2), 'loop-back' FROM st WHERE p % 5 = 0
  UNION ALL SELECT fn, k, least(k + 3, m + 1), 'throw' FROM st WHERE s % 7 = 0),
bl AS MATERIALIZED (SELECT fn, m + 1 AS x, unnest(range(0, m + 2))::INT AS b FROM st WHERE k = 1)"""
#: Post-dominance by its definition: every way from b to the exit has y on it.
_PDOM = _CFG + """, off AS (SELECT fn, b AS y, x AS b FROM bl WHERE b <> x UNION SELECT o.fn, o.y, e.src FROM off o JOIN ce e ON e.fn = o.fn AND e.dst = o.b WHERE e.src <> o.y),
pd AS MATERIALIZED (SELECT p.fn, p.b, q.b AS y FROM bl p JOIN bl q ON q.fn = p.fn AND q.b <> p.b AND p.b <> p.x WHERE NOT EXISTS (SELECT 1 FROM off o WHERE o.fn = p.fn AND o.y = q.b AND o.b = p.b))"""
_DOM = _CFG + """, off AS (SELECT fn, b AS y, 0 AS b FROM bl WHERE b <> 0 UNION SELECT o.fn, o.y, e.dst FROM off o JOIN ce e ON e.fn = o.fn AND e.src = o.b WHERE e.dst <> o.y),
pd AS MATERIALIZED (SELECT p.fn, p.b, q.b AS y FROM bl p JOIN bl q ON q.fn = p.fn AND q.b <> p.b AND p.b <> 0 WHERE NOT EXISTS (SELECT 1 FROM off o WHERE o.fn = p.fn AND o.y = q.b AND o.b = p.b))"""
#: The immediate one is the one that most others dominate.
_NEXT = "SELECT bl.fn, bl.b AS block, coalesce(i.y, -1)::INT AS {0} FROM bl LEFT JOIN (SELECT pd.fn, pd.b, arg_max(pd.y, coalesce(n.k, 0)) AS y FROM pd LEFT JOIN (SELECT fn, b, count(*) AS k FROM pd GROUP BY 1, 2) n ON n.fn = pd.fn AND n.b = pd.y GROUP BY 1, 2) i ON i.fn = bl.fn AND i.b = bl.b"
_DEFS = _CFG + """, live AS (SELECT DISTINCT st.fn, 'v' || (p % 3) AS v, k AS d, dst AS b FROM st JOIN ce ON ce.fn = st.fn AND ce.src = st.k
  UNION SELECT l.fn, l.v, l.d, e.dst FROM live l JOIN ce e ON e.fn = l.fn AND e.src = l.b LEFT JOIN st ON st.fn = l.fn AND st.k = l.b WHERE e.kind = 'throw' OR st.k IS NULL OR 'v' || (st.p % 3) <> l.v),
df AS MATERIALIZED (SELECT l.fn, l.v, l.d, st.k AS u FROM live l JOIN st ON st.fn = l.fn AND st.k = l.b AND 'v' || (st.s % 3) = l.v)"""
_TAINT = _DEFS + """, kinds AS (SELECT unnest(['sql', 'html', 'any']) AS kind), clean AS (SELECT fn, k, 'sql' AS kind FROM st WHERE p % 6 = 5),
t AS (SELECT fn, kind, k AS src, k AS at FROM st, kinds WHERE p % 4 = 0
  UNION SELECT t.fn, t.kind, t.src, df.u FROM t JOIN df ON df.fn = t.fn AND df.d = t.at WHERE NOT EXISTS (SELECT 1 FROM clean c WHERE c.fn = df.fn AND c.k = df.u AND c.kind = t.kind)),
found AS (SELECT DISTINCT t.fn, 'finding' AS kind_of, t.src AS src_block, t.src AS src_line, df.u AS block, df.u AS line, t.kind FROM t JOIN df ON df.fn = t.fn AND df.d = t.at
    JOIN st ON st.fn = df.fn AND st.k = df.u AND st.s % 4 = 0 AND CASE WHEN st.f = 'N' THEN 'html' ELSE 'sql' END = t.kind WHERE NOT EXISTS (SELECT 1 FROM clean c WHERE c.fn = df.fn AND c.k = df.u AND c.kind = t.kind)
  UNION ALL SELECT DISTINCT df.fn, 'kill', NULL, NULL, df.u, df.u, c.kind FROM t JOIN df ON df.fn = t.fn AND df.d = t.at JOIN clean c ON c.fn = df.fn AND c.k = df.u WHERE t.kind = 'any')"""


def _sql(body, ctes):
    return X.sql(body, ctes, recursive=True)


@query(_sql("SELECT fn, count(*) AS edges FROM ce GROUP BY fn", _CFG))
def k2_cfg_edges(spark, sf):
    return P.blocks(_order_cfgs(spark, sf)).groupBy("fn").agg(F.count("*").alias("edges"))


@query(_sql("SELECT fn, count(*) AS blocks FROM r GROUP BY fn", _CFG + ", r AS (SELECT fn, 0 AS b FROM bl WHERE b = 0 UNION SELECT r.fn, dst FROM r JOIN ce ON ce.fn = r.fn AND ce.src = r.b)"))
def k4_reachable_blocks(spark, sf):
    return P.reachable_blocks(_order_cfgs(spark, sf)).groupBy("fn").agg(F.count("*").alias("blocks"))


@query(_sql(_NEXT.format("ipdom"), _PDOM))
def k5_post_dominators(spark, sf):
    return P.post_dominator_edges(_order_cfgs(spark, sf))


@query(
    _sql(
        "SELECT DISTINCT e.fn, e.src AS controller, v.y AS dependent, CASE WHEN e.kind = 'cond-false' THEN 'F' ELSE 'T' END AS label FROM ce e JOIN (SELECT fn, b, b AS y FROM bl UNION ALL SELECT fn, b, y FROM pd) v ON v.fn = e.fn AND v.b = e.dst "
        "WHERE NOT EXISTS (SELECT 1 FROM pd q WHERE q.fn = e.fn AND q.b = e.src AND q.y = v.y) AND NOT (v.y = e.src AND e.dst = e.src)",
        _PDOM,
    )
)
def k7_control_dependence(spark, sf):
    return P.control_edges(_order_cfgs(spark, sf))


@query(_sql("SELECT f.fn, 'computed' AS status, v AS binding, d AS def_block, d AS def_line, u AS use_block, u AS use_line FROM (SELECT DISTINCT fn FROM st) f LEFT JOIN df ON df.fn = f.fn", _DEFS))
def k8_reaching_definitions(spark, sf):
    return P.definition_facts(_order_cfgs(spark, sf))


@query(_sql("SELECT fn, d AS def_block, u AS use_block, 'v1|' || v || '|' || d || '-' || u AS reason FROM df", _DEFS))
def k9_definition_edges(spark, sf):
    return P.definition_edges(P.definition_facts(_order_cfgs(spark, sf)))


@query(_sql(_NEXT.format("idom"), _DOM))
def k11_dominators(spark, sf):
    return P.dominator_edges(_order_cfgs(spark, sf))


@query(
    _sql(
        "SELECT DISTINCT e.fn, d.y AS block, e.dst AS frontier FROM ce e JOIN (SELECT fn, b, b AS y FROM bl UNION ALL SELECT fn, b, y FROM pd) d ON d.fn = e.fn AND d.b = e.src "
        "WHERE NOT EXISTS (SELECT 1 FROM pd q WHERE q.fn = e.fn AND q.b = e.dst AND q.y = d.y)",
        _DOM,
    )
)
def k11_frontiers(spark, sf):
    return P.frontier_rows(_order_cfgs(spark, sf))


@query(_sql("SELECT bl.fn, bl.b AS block, least(bl.b, coalesce(min(x.d), bl.b))::INT AS component FROM bl LEFT JOIN (SELECT p.fn, p.s, p.d FROM r p JOIN r q ON q.fn = p.fn AND q.s = p.d AND q.d = p.s) x ON x.fn = bl.fn AND x.s = bl.b GROUP BY bl.fn, bl.b", _CFG + ", r AS (SELECT fn, src AS s, dst AS d FROM ce UNION SELECT r.fn, r.s, ce.dst FROM r JOIN ce ON ce.fn = r.fn AND ce.src = r.d)"))
def k11_condensation(spark, sf):
    return P.block_components(_order_cfgs(spark, sf))


@query()
def k11_reverse_postorder(spark, sf):
    return P.block_order(_order_cfgs(spark, sf))


@query("SELECT l_orderkey AS o, 'p|' || l_partkey AS binding, count(*) AS n FROM lineitem GROUP BY 1, 2")
def k10_reason_codec(spark, sf):
    li = X.table(spark, sf, "lineitem").groupBy("l_orderkey", F.concat(F.lit("p|"), c("l_partkey").cast("string")).alias("binding")).agg(F.collect_list(F.struct(c("l_linenumber").alias("def_line"), c("l_linenumber").alias("use_line"))).alias("pairs"))
    d = li.select("l_orderkey", P.decode_reason(P.encode_reason(c("binding"), c("pairs"))).alias("d"))
    return d.select(c("l_orderkey").alias("o"), c("d.binding").alias("binding"), F.size("d.pairs").cast("long").alias("n"))


@query("SELECT user_id AS fn, event_id AS line, m.role, m.kind FROM events JOIN (VALUES ('sink', 'sql', 'purchase', 1), ('sink', 'html', 'view', NULL), ('source', '', 'click', NULL), ('source', '', 'click', 2)) AS m(role, kind, callee, receiver) ON m.callee = event_type AND (m.receiver IS NULL OR m.receiver = user_id % 3)")
def k14_site_matching(spark, sf):
    sites = X.table(spark, sf, "events").select(c("user_id").alias("fn"), F.lit(0).alias("block"), c("event_id").alias("line"), c("event_type").alias("callee"), (c("user_id") % 3).cast("int").alias("receiver"))
    model = spark.createDataFrame([("sink", "sql", "purchase", 1), ("sink", "html", "view", None), ("source", "", "click", None), ("source", "", "click", 2)], "role string, kind string, callee string, receiver int")
    return P.match_sites(sites, model).select("fn", "line", "role", "kind")


@query(_sql("SELECT fn, kind_of, src_block, src_line, block, line, kind FROM found", _TAINT))
def k15_taint(spark, sf):
    return P.taint(_order_cfgs(spark, sf))


@query(
    _sql(
        "SELECT *, substring(sha256(type || '|' || sourceId || '|' || targetId || '|' || reason), 1, 16) AS id FROM (SELECT DISTINCT CASE WHEN kind_of = 'finding' THEN 'TAINTED' ELSE 'SANITIZES' END AS type, "
        "'BasicBlock:' || fn || ':' || coalesce(src_block, block) AS sourceId, 'BasicBlock:' || fn || ':' || block AS targetId, kind AS reason FROM found)",
        _TAINT,
    )
)
def k16_taint_edges(spark, sf):
    return P.taint_edges(P.taint(_order_cfgs(spark, sf)))


#: Suppliers as functions: k calls 2k, 2k + 1 and k + 3; some are sources, sinks, and clean a kind on one way.
_FN = """e AS MATERIALIZED (SELECT DISTINCT k, d FROM (SELECT s_suppkey AS k, unnest([2 * s_suppkey, 2 * s_suppkey + 1, s_suppkey + 3]) AS d FROM supplier) JOIN supplier ON s_suppkey = d WHERE k <> d),
kinds AS (SELECT unnest(['sql', 'html']) AS kind),
t AS (SELECT k AS src, kind, d AS fn FROM e, kinds WHERE k % 7 = 1 AND d = 2 * k UNION SELECT t.src, t.kind, e.d FROM t JOIN e ON e.k = t.fn WHERE NOT (t.kind = 'sql' AND t.fn % 4 = 1 AND e.d = 2 * t.fn)),
found AS (SELECT DISTINCT 'S' || src AS source_fn, 'S' || fn AS sink_fn, kind FROM t WHERE (kind = 'sql' AND fn % 3 = 0) OR (kind = 'html' AND fn % 5 = 0)),
capped AS (SELECT * FROM found ORDER BY source_fn, sink_fn, kind LIMIT 2000),
fact AS (SELECT 'S' || k AS fn, 'source-call,,S' || d || ',0,' AS row FROM e WHERE k % 7 = 1 AND d = 2 * k UNION ALL SELECT 'S' || k, 'param-call,0,S' || d || ',0,' FROM e UNION ALL SELECT 'S' || k, 'param-clean,0,S' || d || ',0,sql' FROM e WHERE k % 4 = 1 AND d = 2 * k
  UNION ALL SELECT 'S' || s_suppkey, 'param-sink,0,,,sql' FROM supplier WHERE s_suppkey % 3 = 0 UNION ALL SELECT 'S' || s_suppkey, 'param-sink,0,,,html' FROM supplier WHERE s_suppkey % 5 = 0)"""


def _fn_edges(spark, sf):
    s = X.table(spark, sf, "supplier").select(c("s_suppkey").alias("k"))
    return s.select("k", F.explode(F.array(2 * c("k"), 2 * c("k") + 1, c("k") + 3)).alias("d")).distinct().join(s.select(c("k").alias("d")), "d").filter("k <> d")


def _facts(spark, sf):
    e, s = _fn_edges(spark, sf), X.table(spark, sf, "supplier").select(c("s_suppkey").alias("k"))
    name, none = lambda x: F.concat(F.lit("S"), x.cast("string")), F.lit(None)
    to = lambda rows, fact, param, kind: rows.select(name(c("k")).alias("fn"), F.lit(fact).alias("fact"), param.cast("int").alias("param"), name(c("d")).alias("callee"), F.lit(0).alias("arg"), kind.cast("string").alias("kind"))
    sink = lambda n, kind: s.filter(c("k") % n == 0).select(name(c("k")), F.lit("param-sink"), F.lit(0), none.cast("string"), none.cast("int"), F.lit(kind))
    calls = to(e.filter("k % 7 = 1 and d = 2 * k"), "source-call", none, none).union(to(e, "param-call", F.lit(0), none)).union(to(e.filter("k % 4 = 1 and d = 2 * k"), "param-clean", F.lit(0), F.lit("sql")))
    return calls.union(sink(3, "sql")).union(sink(5, "html"))


def _calls(spark, sf):
    name = lambda x: F.concat(F.lit("S"), x.cast("string"))
    return _fn_edges(spark, sf).select(name(c("k")).alias("caller"), name(c("d")).alias("callee"), name(c("d")).alias("name"), F.lit(1).alias("params"))


@query(f"WITH RECURSIVE {_FN} SELECT fn, substring(sha256(string_agg(DISTINCT row, ';' ORDER BY row)), 1, 16) AS version FROM fact GROUP BY fn")
def k17_summary_versions(spark, sf):
    return P.harvest(_facts(spark, sf))


@query(f"WITH RECURSIVE {_FN} SELECT * FROM capped")
def k18_interprocedural(spark, sf):
    return P.interprocedural(_facts(spark, sf), _calls(spark, sf)).select("source_fn", "sink_fn", "kind")


@query(f"WITH RECURSIVE {_FN} SELECT source_fn AS sourceId, sink_fn AS targetId, 0.6::DOUBLE AS confidence, kind AS reason FROM capped WHERE sink_fn IN (SELECT 'S' || s_suppkey FROM supplier WHERE s_suppkey % 2 = 0) AND source_fn IN (SELECT 'S' || s_suppkey FROM supplier WHERE s_suppkey % 2 = 0) ORDER BY 1, 2, 4 LIMIT 1000")
def k19_taint_paths(spark, sf):
    ids = X.table(spark, sf, "supplier").filter("s_suppkey % 2 = 0").select(F.concat(F.lit("S"), c("s_suppkey").cast("string")).alias("id"))
    return P.taint_paths(P.interprocedural(_facts(spark, sf), _calls(spark, sf)), ids).select("sourceId", "targetId", "confidence", "reason")


@query("SELECT l_orderkey AS o, CASE WHEN octet_length(encode(string_agg('P' || l_partkey, '->' ORDER BY l_partkey))) <= 4091 THEN string_agg('P' || l_partkey, '->' ORDER BY l_partkey) END AS path FROM lineitem GROUP BY 1")
def k20_path_codec(spark, sf):
    g = X.table(spark, sf, "lineitem").groupBy(c("l_orderkey").alias("o")).agg(F.transform(F.array_sort(F.collect_list("l_partkey")), lambda p: F.concat(F.lit("P"), p.cast("string"))).alias("hops"))
    return g.select("o", P.encode_path(c("hops")).alias("path"))


@query("SELECT l_orderkey AS o, array_to_string(list_sort(list(DISTINCT l_partkey % 100)), ' ') AS params FROM lineitem GROUP BY 1")
def k21_parameter_codec(spark, sf):
    g = X.table(spark, sf, "lineitem").groupBy(c("l_orderkey").alias("o")).agg(F.collect_set((c("l_partkey") % 100).cast("int")).alias("ps"))
    return g.select("o", F.array_join(P.decode_params(P.encode_params(c("ps"))), " ").alias("params"))


@query(X.sql("SELECT count(*) FILTER (endLine - startLine + 1 <= 30) AS kept, count(*) FILTER (endLine - startLine + 1 > 30) AS skipped FROM nodes WHERE label = 'Method'"))
def k22_collection(spark, sf):
    return P.collected(X.nodes(spark, sf, {"Method"}), 30)


# --- sinks and functions ---------------------------------------------------------------------------


@query(X.sql("SELECT CASE WHEN label IN ('File','Folder','Class','Interface','Method','Function','Property','Route','Process','Community','Section','Tool') THEN label ELSE 'CodeElement' END AS label, count(*) AS n FROM nodes GROUP BY 1"))
def b9_small_store(spark, sf):
    return writers.small_store(X.graph(spark, sf)).nodes.groupBy("label").agg(F.count("*").alias("n"))


@query(X.sql("SELECT split_part(sourceId, ':', 1) AS fromLabel, split_part(targetId, ':', 1) AS toLabel, count(*) AS n FROM edges WHERE type IN ('CALLS', 'HAS_METHOD', 'CONTAINS') GROUP BY 1, 2"))
def b2_edge_routing(spark, sf):
    return writers.routed(X.edges(spark, sf, {"CALLS", "HAS_METHOD", "CONTAINS"})).groupBy("fromLabel", "toLabel").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey AS k, CASE WHEN o_orderkey % 3 = 0 THEN 'new' ELSE o_orderstatus END AS v FROM orders UNION ALL SELECT -1, 'new'")
def b5_upsert(spark, sf):
    from ..operators.relational import upsert

    o = X.table(spark, sf, "orders").select(c("o_orderkey").alias("k"), c("o_orderstatus").alias("v"))
    return upsert(o, o.filter("k % 3 = 0").select("k").union(spark.range(1).select(F.lit(-1).cast("long").alias("k"))).withColumn("v", F.lit("new")), ["k"])


@query(X.sql("SELECT (SELECT count(*) FROM nodes) AS nodes, (SELECT count(*) FROM edges) AS edges, (SELECT count(*) FROM nodes WHERE label = 'File') AS files"))
def b10_metadata(spark, sf):
    m = writers.metadata(X.graph(spark, sf), "repo", "now").select(F.from_json("json", "stats struct<nodes:bigint,edges:bigint,files:bigint>").alias("m"))
    return m.select("m.stats.nodes", "m.stats.edges", "m.stats.files")


@query(X.sql("SELECT 'node' AS kind, count(*) AS n FROM nodes UNION ALL SELECT 'relationship', count(*) FROM edges"))
def b8_json_export(spark, sf):
    return writers.json_lines(X.graph(spark, sf)).groupBy("kind").agg(F.count("*").alias("n"))


@query("SELECT 'e' AS entry, 'flowchart TD' || chr(10) || '  s0([\"GET /x\"])' || chr(10) || '  s1[\"c\"]' || chr(10) || '  s2[\"s\"]' || chr(10) || '  s0 --> s1' || chr(10) || '  s1 --> s2' AS diagram")
def b12_mermaid(spark, sf):
    return writers.mermaid(spark.createDataFrame([("e", "GET /x", ["c"], ["s"], [])], "entry string, name string, controllers array<string>, services array<string>, egressSinks array<string>"))


@query("SELECT id FROM (VALUES ('spring_web_rest'), ('fastapi_routes'), ('python_requests'), ('axios_client'), ('new_rule')) AS t(id)")
def b15_registry_mutation(spark, sf):
    r = B.registry_remove(_rules(spark), "ingress", "any_spring")
    return B.registry_upsert(r, frame(spark, [("egress", "new_rule")], "boundary, id")).select("id")


@query(r"""SELECT doc_id, '"' || replace(regexp_replace(replace(text, chr(13) || chr(10), chr(10)), '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]', '', 'g'), '"', '""') || '"' AS field FROM documents""")
def b16_csv_fields(spark, sf):
    return X.table(spark, sf, "documents").select("doc_id", writers.csv_field(c("text")).alias("field"))


@query("SELECT p_partkey, floor(p_retailprice + 0.5)::BIGINT AS half_up, coalesce(try_cast(p_brand AS DOUBLE), -1.0) AS number, upper(left(p_name, 1)) || substring(p_name, 2) AS capital FROM part")
def o_scalars(spark, sf):
    from ..operators.flows import capitalised

    return X.table(spark, sf, "part").select("p_partkey", scalars.round_half_up(c("p_retailprice")).alias("half_up"), scalars.number_or(c("p_brand"), -1.0).alias("number"), capitalised(c("p_name")).alias("capital"))


@query("SELECT * FROM (VALUES ('a', 'e40c292c'), ('foobar', 'bf9cf968'), ('', '811c9dc5')) AS t(text, hash)")
def o_fnv1a(spark, sf):
    return frame(spark, [("a",), ("foobar",), ("",)], "text").select("text", scalars.fnv1a(c("text")).alias("hash"))


@query("SELECT a.vec_id, round(1 - list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) AS distance FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def o_cosine(spark, sf):
    v = X.table(spark, sf, "embeddings").select("vec_id", "embedding")
    w = v.select((c("vec_id") - 1).alias("vec_id"), c("embedding").alias("other"))
    return v.join(w, "vec_id").select("vec_id", F.round(scalars.cosine_distance(c("embedding"), c("other")), 9).alias("distance"))

