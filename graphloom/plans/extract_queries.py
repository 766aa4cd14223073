"""Queries of extraction, frameworks and orchestration over literal sources, and of taint models."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import extract as E
from ..operators import pdg as P
from ..operators import resolution as R
from . import fixture as X
from .registry import query
from .text_queries import frame

c = F.col

REPO = [
    ("app/main.py", "from util import helper\n\nclass Job:\n    def run(self):\n        return helper(1)\n\ndef main():\n    Job().run()\n    _hide()\n\ndef _hide():\n    pass"),
    ("app/util.py", "def helper(x):\n    return x"),
    ("svc/A.java", "import app.B;\npublic class A {\n    public int go(int x) {\n        return stop(x);\n    }\n    private int stop(int x) {\n        return x;\n    }\n}"),
]


@query("SELECT * FROM (VALUES ('app/main.py', 3, 'Class', 'Job', true), ('app/main.py', 4, 'Method', 'run', true), ('app/main.py', 7, 'Function', 'main', true), ('app/main.py', 11, 'Function', '_hide', false), ('app/util.py', 1, 'Function', 'helper', true), ('svc/A.java', 2, 'Class', 'A', true), ('svc/A.java', 3, 'Method', 'go', true), ('svc/A.java', 6, 'Method', 'stop', false)) AS t(path, line, label, name, isExported)")
def a12_symbols(spark, sf):
    return E.symbols(frame(spark, REPO, "path, content")).select("path", "line", "label", "name", "isExported")


@query("SELECT * FROM (VALUES ('CALLS', 4), ('CONTAINS', 3), ('DEFINES', 8), ('IMPORTS', 1)) AS t(type, n)")
def a12_repository_graph(spark, sf):
    return E.repository_graph(frame(spark, REPO, "path, content")).edges.groupBy("type").agg(F.count("*").alias("n"))


@query("SELECT * FROM (VALUES ('x.cbl', 1, 'program', 'PAYROLL'), ('x.cbl', 3, 'section', 'MAIN'), ('x.cbl', 4, 'perform', 'CALC-TAX'), ('x.cbl', 5, 'call', 'SUBPGM'), ('x.cbl', 6, 'copy', 'CUSTREC'), ('x.cbl', 7, 'sql', 'EMP'), ('x.cbl', 8, 'cics', 'LINK'), ('j.jcl', 1, 'job', 'NIGHT'), ('j.jcl', 2, 'exec', 'PAYROLL')) AS t(path, line, kind, name)")
def a14_cobol(spark, sf):
    files = [("x.cbl", "       PROGRAM-ID. PAYROLL.\n      * CALL 'COMMENT'\n       MAIN SECTION.\n           PERFORM CALC-TAX.\n           CALL 'SUBPGM'.\n           COPY CUSTREC.\n           EXEC SQL SELECT A FROM EMP END-EXEC.\n           EXEC CICS LINK END-EXEC."), ("j.jcl", "//NIGHT JOB\n//S1 EXEC PGM=PAYROLL\n//* EXEC PGM=NO")]
    return E.cobol(frame(spark, files, "path, content"))


@query("SELECT * FROM (VALUES ('a.ts', 'id,name', 'error'), ('b.ts', 'ok', 'code,why')) AS t(path, response, errors)")
def h13_response_shapes(spark, sf):
    files = [("a.ts", "return res.json({ id, name: 'x, y: {', })\nres.status(404).json({ error: { deep: 1 } })"), ("b.ts", "NextResponse.json({ ok: true, ...rest })\nNextResponse.json({ 'code': 1, why: [a, {b: 2}] }, { status: 500 })"), ("c.ts", "json(x)")]
    return E.response_shapes(frame(spark, files, "path, content")).select("path", F.array_join("responseKeys", ",").alias("response"), F.array_join("errorKeys", ",").alias("errors"))


@query("SELECT * FROM (VALUES ('a.ts', 'POST', 'withAuth,withLimit'), ('b.ts', 'default', 'withLog')) AS t(path, method, chain)")
def h14_middleware_chains(spark, sf):
    files = [("a.ts", "export const POST = withAuth(withLimit(async (r) => 1))"), ("b.ts", "export default withLog(handler)"), ("c.ts", "export const GET = wrap(x)"), ("d.ts", "export default function f() {}")]
    return E.middleware_chains(frame(spark, files, "path, content")).select("path", "method", F.array_join("chain", ",").alias("chain"))


@query("SELECT * FROM (VALUES ('/api'), ('/api/x'), ('/admin'), ('/v12/a')) AS t(url)")
def h14_middleware_matchers(spark, sf):
    return E.applied_middleware(frame(spark, [("/api",), ("/api/x",), ("/apix",), ("/admin",), ("/admin/y",), ("/v12/a",), ("/v/a",)], "url"), ["/api/:path*", "/admin", r"/v(\d+)/a"])


@query("SELECT * FROM (VALUES ('A.java', 'spring', 'GET', '/users/{id}', NULL), ('A.java', 'spring', 'POST', '/users', NULL), ('m.py', 'fastapi', 'DELETE', '/x', NULL), ('urls.py', 'django', '*', '/home', 'views.home'), ('r.php', 'laravel', 'GET', '/u', 'UserController'), ('s.ts', 'express', '*', '/all', 'h.all')) AS t(path, framework, method, url, handler)")
def h15_framework_routes(spark, sf):
    files = [("A.java", '@RequestMapping("/users")\nclass A {\n @GetMapping("/{id}")\n @PostMapping("")\n}'), ("m.py", '@router.delete("/x")'), ("urls.py", "path('home/', views.home)"), ("r.php", "Route::get('/u', [UserController::class, 'i']);"), ("s.ts", "app.all('/all', h.all)")]
    return E.framework_routes(frame(spark, files, "path, content")).select("path", "framework", "method", "url", "handler")


@query("SELECT * REPLACE (confidence::DOUBLE AS confidence) FROM (VALUES ('m1', 'log', 1.0), ('m2', 'log', 1.0), ('m2', 'tx', 0.95), ('m3', 'sec', 1.0), ('m1', 'sec', 1.0), ('m2', 'sec', 1.0)) AS t(method, aspect, confidence)")
def h21_aspects(spark, sf):
    aspects = frame(spark, [("log", "execution(* com.x.Svc.*(..))"), ("tx", "@annotation(org.T.Tx)"), ("sec", "within(com..*)"), ("none", "execution(* org.*.run(..))")], "aspect, pointcut")
    cand = spark.createDataFrame([("m1", "com.x.Svc.a", []), ("m2", "com.x.Svc.b", ["Tx"]), ("m3", "com.y.z.Other.c", ["No"])], "method string, qualified string, annotations array<string>")
    return E.advised(aspects, cand)


@query("SELECT user_id AS repo, event_type AS branch, max(ts) AS indexedAt FROM events GROUP BY 1, 2")
def i10_registry(spark, sf):
    return E.current_entries(X.table(spark, sf, "events").select(c("user_id").alias("repo"), c("event_type").alias("branch"), c("ts").alias("indexedAt")).distinct())


@query(X.sql("SELECT 'out' AS direction, type, targetId AS other FROM edges WHERE sourceId = 'Class:S3' UNION ALL SELECT 'in', type, sourceId FROM edges WHERE targetId = 'Class:S3'"))
def n7_context(spark, sf):
    return E.context(X.graph(spark, sf, {"Class"}), "Class:S3")


@query(X.sql("SELECT id FROM nodes WHERE label IN ('Class', 'Method') AND contains(lower(name), 'hot')"))
def b14_name_search(spark, sf):
    return E.name_search(X.nodes(spark, sf, {"Class", "Method"}), "HOT", ["Class", "Method"]).select("id")


@query("SELECT * FROM (VALUES ('e1', 1), ('e1', 2), ('e2', 1), ('e2', 2), ('e2', 3)) AS t(entry, n)")
def g7_first_traces(spark, sf):
    t = spark.createDataFrame([("e1", 1), ("e1", 2), ("e2", 1), ("e2", 2), ("e2", 3), ("e3", 1)], "entry string, n int")
    return E.first_traces(t, spark.createDataFrame([("e1", 3.0), ("e2", 2.0), ("e3", 1.0)], "id string, score double"), 2)


@query("SELECT * FROM (VALUES ('a1', 'a1'), ('a2', 'a1'), ('a3', 'a1'), ('b1', 'b1'), ('b2', 'b1'), ('b3', 'b1')) AS t(id, community)")
def g17_label_spreading(spark, sf):
    return E.label_spreading(frame(spark, [("a1", "a2"), ("a1", "a3"), ("a2", "a3"), ("b1", "b2"), ("b1", "b3"), ("b2", "b3")], "a, b"))


@query("SELECT * FROM (VALUES ('c1', 'user,load,save', 'Symbols about user, load, save'), ('c2', '', 'Symbols about ')) AS t(community, keywords, description)")
def g32_cluster_enrichment(spark, sf):
    x = E.enriched_clusters(frame(spark, [("c1",), ("c2",)], "community"), frame(spark, [("c1", "loadUser"), ("c1", "saveUser")], "community, name"))
    return x.select("community", F.array_join("keywords", ",").alias("keywords"), "description")


@query("SELECT doc_id AS filePath, round(1.0 / (60 + doc_id + 1), 9) AS score, 'semantic' AS sources FROM documents WHERE doc_id < 5")
def j8_hybrid(spark, sf):
    d = X.table(spark, sf, "documents").filter("doc_id < 5").select(c("doc_id").alias("filePath"), (c("doc_id") + 1).alias("rank"))
    return E.hybrid(lambda: d.select("missing_column"), lambda: d)


@query("SELECT * FROM (VALUES ('f', 0, 'g1,g2'), ('f', 1, 'h1')) AS t(fn, block, callees)")
def k3_block_callees(spark, sf):
    sites = spark.createDataFrame([("f", 0, 1, "g"), ("f", 0, 2, "g2"), ("f", 1, 5, "h"), ("f", 1, 6, "unknown")], "fn string, block int, line int, callee string")
    ids = spark.createDataFrame([("f", 1, "g", "g1"), ("f", 2, "g2", "g2"), ("f", 5, "h", "h1")], "fn string, line int, callee string, id string")
    return sites.join(ids, ["fn", "line", "callee"]).groupBy("fn", "block").agg(F.array_join(F.array_sort(F.collect_set("id")), ",").alias("callees"))


MODEL = [("python", "source", "", "input", None), ("python", "sink", "command", "system", "os"), ("python", "sink", "sql", "execute", None), ("python", "sanitizer", "command", "quote", "shlex"), ("typescript", "source", "", "param", "req"), ("typescript", "sink", "html", "send", "res"), ("typescript", "sink", "code", "eval", None), ("java", "source", "", "getParameter", "request"), ("java", "sink", "sql", "executeQuery", None), ("java", "sink", "path", "get", "Paths")]


@query("SELECT * FROM (VALUES ('java', 2), ('python', 2), ('typescript', 2)) AS t(language, sinks)")
def k13_taint_models(spark, sf):
    m = frame(spark, MODEL, "language, role, kind, callee, receiver")
    return m.filter(c("role") == "sink").filter(c("kind").isin(P.KINDS)).groupBy("language").agg(F.count("*").alias("sinks"))


@query("SELECT * FROM (VALUES ('s1', 'local1'), ('s2', 'g1')) AS t(site, id)")
def m7_resolution_driver(spark, sf):
    sites = spark.createDataFrame([("s1", "in", "x", ["fn"]), ("s2", "in", "n.y", ["fn"])], "site string, scope string, name string, kinds array<string>")
    chain = R.scope_chain(frame(spark, [("out", None), ("in", "out")], "scope, parent"))
    found = R.lexical(sites, chain, frame(spark, [("out", "x", "local1", "fn")], "scope, name, id, kind")).withColumn("origin", F.lit("local"))
    every = R.with_fallback(found, sites, frame(spark, [("n.y", "g1")], "qualified, id"))
    scored = every.select("site", "id", "origin", F.lit(False).alias("unlinked"), F.lit(0).alias("scope_depth"), F.lit(None).cast("int").alias("mro_depth"), F.lit(False).alias("owner_match"), F.lit("unknown").alias("arity"), F.lit(False).alias("dynamic"))
    return R.rank(scored.withColumn("confidence", R.confidence())).filter("rn = 1").select("site", "id")


@query("SELECT * REPLACE (confidence::DOUBLE AS confidence) FROM (VALUES ('u', 'field:id', 0.9)) AS t(sourceId, targetId, confidence)")
def m14_return_shapes(spark, sf):
    uses = frame(spark, [("u", "load", "id"), ("u", "load", "gone")], "source, callee, key")
    return uses.join(frame(spark, [("load", "id", "field:id")], "callee, key, id"), ["callee", "key"]).select(c("source").alias("sourceId"), c("id").alias("targetId"), F.lit(0.9).alias("confidence"))
