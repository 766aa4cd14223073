"""Queries of the relational surface and the graph kernel over the fixture graph."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import schema
from ..operators import graph as G
from ..operators import relational as R
from . import cypher
from . import fixture as X
from .registry import query

c = F.col


@query(X.sql("SELECT id, name FROM nodes WHERE label = 'Class'"))
def c1_label_scan(spark, sf):
    return X.nodes(spark, sf, {"Class"}).filter("label = 'Class'").select("id", "name")


@query("SELECT 'Folder:' || min(r_name) AS id FROM region")
def c2_any_node(spark, sf):
    return R.top_k(X.nodes(spark, sf, {"Folder"}).select("id"), [c("id")], 1)


@query(X.sql("SELECT label AS name, 'NODE' AS type, count(*) AS n FROM nodes GROUP BY label UNION ALL SELECT type, 'REL', count(*) FROM edges GROUP BY type"))
def c3_catalog(spark, sf):
    g = X.graph(spark, sf)
    return g.nodes.groupBy(c("label").alias("name")).agg(F.lit("NODE").alias("type"), F.count("*").alias("n")).union(g.edges.groupBy("type").agg(F.lit("REL"), F.count("*")))


@query("SELECT 'File' AS table_name, 'file_fts' AS index_name, 'FTS' AS index_type, count(*) AS n FROM documents UNION ALL SELECT 'CodeEmbedding', 'code_embedding_idx', 'HNSW', count(*) FROM embeddings")
def c4_index_catalog(spark, sf):
    rows = [("documents", "File", "file_fts", "FTS"), ("embeddings", "CodeEmbedding", "code_embedding_idx", "HNSW")]
    parts = [X.table(spark, sf, t).agg(F.lit(a).alias("table_name"), F.lit(b).alias("index_name"), F.lit(k).alias("index_type"), F.count("*").alias("n")) for t, a, b, k in rows]
    return parts[0].union(parts[1])


@query(X.sql("SELECT id, name, filePath FROM nodes WHERE id = 'Method:P7'"))
def c5_equality(spark, sf):
    return X.nodes(spark, sf, {"Method"}).filter("id = 'Method:P7'").select("id", "name", "filePath")


@query(X.sql("SELECT a.name AS caller, b.name AS callee, e.confidence FROM edges e JOIN nodes a ON a.id = e.sourceId JOIN nodes b ON b.id = e.targetId WHERE e.type = 'CALLS' AND contains(a.name, 'ea')"))
def c6_contains(spark, sf):
    g = X.graph(spark, sf, {"Method"}, {"CALLS"})
    return R.match_edge(g, ["CALLS"], src=c("name").contains("ea")).select(c("a_name").alias("caller"), c("b_name").alias("callee"), "confidence")


@query(X.sql("SELECT type, count(*) AS n FROM edges WHERE type IN ('CALLS', 'CONTAINS', 'HAS_METHOD') AND type NOT IN ('CONTAINS') GROUP BY type"))
def c7_membership(spark, sf):
    e = X.edges(spark, sf)
    return e.filter(c("type").isin("CALLS", "CONTAINS", "HAS_METHOD") & ~c("type").isin("CONTAINS")).groupBy("type").agg(F.count("*").alias("n"))


@query(X.sql("SELECT label, count(*) AS n FROM nodes WHERE isExported IS NULL OR isExported = false GROUP BY label"))
def c8_null_test(spark, sf):
    return X.nodes(spark, sf).filter(c("isExported").isNull() | ~c("isExported")).groupBy("label").agg(F.count("*").alias("n"))


@query(X.sql("SELECT sourceId, targetId FROM edges WHERE type = 'CALLS' AND confidence >= 0.9 AND contains(reason, 'LSP:')"))
def c9_boolean_logic(spark, sf):
    return X.edges(spark, sf, {"CALLS"}).filter((c("confidence") >= 0.9) & c("reason").contains("LSP:")).select("sourceId", "targetId")


@query(X.sql("SELECT type, reason, count(*) AS n FROM edges WHERE reason = 'LSP: fixture' OR reason = 'other' GROUP BY 1, 2"))
def c10_disjunction(spark, sf):
    return X.edges(spark, sf).filter(c("reason").isin("LSP: fixture", "other")).groupBy("type", "reason").agg(F.count("*").alias("n"))


@query(X.sql("SELECT a.filePath AS importer, b.filePath AS imported FROM edges e JOIN nodes a ON a.id = e.sourceId JOIN nodes b ON b.id = e.targetId WHERE e.type = 'CALLS' AND e.confidence >= 0.95"))
def c11_projection(spark, sf):
    g = X.graph(spark, sf, {"Method"}, {"CALLS"})
    return R.match_edge(G.Graph(g.nodes, g.edges.filter("confidence >= 0.95")), ["CALLS"], cols=("id", "filePath")).select(c("a_filePath").alias("importer"), c("b_filePath").alias("imported"))


@query(X.sql("SELECT e.type, a.label AS src, b.label AS dst, count(*) AS n, min(a.name) AS first, max(b.name) AS last FROM edges e JOIN nodes a ON a.id = e.sourceId JOIN nodes b ON b.id = e.targetId GROUP BY 1, 2, 3"))
def c12_edge_pattern(spark, sf):
    g = X.graph(spark, sf)
    return R.match_edge(g).groupBy("type", c("a_label").alias("src"), c("b_label").alias("dst")).agg(F.count("*").alias("n"), F.min("a_name").alias("first"), F.max("b_name").alias("last"))


@query(X.sql("SELECT b.id AS process, a.id AS method, e.step FROM edges e JOIN nodes a ON a.id = e.sourceId JOIN nodes b ON b.id = e.targetId WHERE e.type = 'STEP_IN_PROCESS' AND b.label = 'Process' AND e.step <= 2"))
def c13_reverse_pattern(spark, sf):
    g = X.graph(spark, sf, {"Method", "Process"}, {"STEP_IN_PROCESS"})
    return R.match_edge(G.Graph(g.nodes, g.edges.filter("step <= 2")), ["STEP_IN_PROCESS"], dst=c("label") == "Process").select(c("b_id").alias("process"), c("a_id").alias("method"), c("step").cast("long").alias("step"))


@query(X.sql("SELECT b.name AS interface, count(*) AS classes FROM edges e JOIN nodes a ON a.id = e.sourceId AND a.label = 'Class' JOIN nodes b ON b.id = e.targetId AND b.label = 'Interface' WHERE e.type = 'IMPLEMENTS' GROUP BY 1"))
def c14_labelled_endpoints(spark, sf):
    g = X.graph(spark, sf, {"Class", "Interface"}, {"IMPLEMENTS"})
    return R.match_edge(g, ["IMPLEMENTS"], src=c("label") == "Class", dst=c("label") == "Interface").groupBy(c("b_name").alias("interface")).agg(F.count("*").alias("classes"))


_BRANDS = "m AS (SELECT id, filePath AS community FROM nodes WHERE label = 'Method')"


@query(X.sql("SELECT x.community AS c1, y.community AS c2, count(*) AS calls FROM edges e JOIN m x ON x.id = e.sourceId JOIN m y ON y.id = e.targetId WHERE e.type = 'CALLS' AND x.community <> y.community GROUP BY 1, 2", _BRANDS))
def c15_cross_community_calls(spark, sf):
    g = X.graph(spark, sf, {"Method"}, {"CALLS"})
    pairs = R.match_edge(g, ["CALLS"], cols=("id", "filePath")).filter("a_filePath <> b_filePath")
    return pairs.groupBy(c("a_filePath").alias("c1"), c("b_filePath").alias("c2")).agg(F.count("*").alias("calls"))


@query(X.sql("SELECT p.id AS process, p.name, m.name AS entry, m.filePath FROM nodes p JOIN nodes m ON m.id = p.entryPointId WHERE p.label = 'Process' AND m.label = 'Method'"))
def c16_property_join(spark, sf):
    n = X.nodes(spark, sf, {"Process", "Method"})
    m = R.prefixed(n.filter("label = 'Method'"), "m_", ["id", "name", "filePath"])
    return n.filter("label = 'Process'").join(m, c("entryPointId") == c("m_id")).select(c("id").alias("process"), "name", c("m_name").alias("entry"), c("m_filePath").alias("filePath"))


@query(X.sql("SELECT p.id AS process, e.sourceId AS class, i.targetId AS interface FROM nodes p JOIN edges e ON e.targetId = p.entryPointId AND e.type = 'HAS_METHOD' JOIN edges i ON i.sourceId = e.sourceId AND i.type = 'IMPLEMENTS' WHERE p.label = 'Process'"))
def c17_chained_join(spark, sf):
    p = X.nodes(spark, sf, {"Process"}).select(c("id").alias("process"), "entryPointId")
    owner = R.hop(p, "entryPointId", X.edges(spark, sf, {"HAS_METHOD"}), "c_", reverse=True)
    return R.hop(owner, "c_id", X.edges(spark, sf, {"IMPLEMENTS"}), "i_").select("process", c("c_id").alias("class"), c("i_id").alias("interface"))


@query(X.sql("SELECT type, count(*) AS n FROM edges WHERE sourceId IN (SELECT id FROM nodes WHERE isExported) AND targetId IN (SELECT id FROM nodes WHERE isExported) GROUP BY type"))
def c18_semi_join(spark, sf):
    g = X.graph(spark, sf, {"Method"}, {"CALLS", "HAS_METHOD"})
    return R.endpoints_exist(g.edges, g.nodes.filter("isExported")).groupBy("type").agg(F.count("*").alias("n"))


@query(X.sql("SELECT id FROM nodes n WHERE label = 'Method' AND NOT EXISTS (SELECT 1 FROM nodes p WHERE p.entryPointId = n.id)"))
def c19_anti_join(spark, sf):
    n = X.nodes(spark, sf, {"Method", "Process"})
    entries = n.filter("label = 'Process'").select(c("entryPointId").alias("e"))
    return n.filter("label = 'Method'").select("id").join(entries, c("id") == c("e"), "left_anti")


@query(X.sql("SELECT n.id, coalesce(string_agg(DISTINCT e.sourceId, ', ' ORDER BY e.sourceId), '(Direct Ingress)') AS callers FROM nodes n LEFT JOIN edges e ON e.targetId = n.id AND e.type = 'CALLS' AND e.confidence >= 0.95 WHERE n.label = 'Method' GROUP BY n.id"))
def c20_left_outer_default(spark, sf):
    callers = X.edges(spark, sf, {"CALLS"}).filter("confidence >= 0.95").groupBy(c("targetId").alias("t")).agg(F.array_join(F.array_sort(F.collect_set("sourceId")), ", ").alias("callers"))
    return X.nodes(spark, sf, {"Method"}).select("id").join(callers, c("id") == c("t"), "left").select("id", F.coalesce("callers", F.lit("(Direct Ingress)")).alias("callers"))


@query(X.sql("SELECT label, count(*) AS n FROM nodes GROUP BY label"))
def c21_count_per_label(spark, sf):
    return X.nodes(spark, sf).groupBy("label").agg(F.count("*").alias("n"))


@query(X.sql("SELECT type, count(*) AS n FROM edges GROUP BY type ORDER BY n DESC"))
def c22_count_per_type(spark, sf):
    return X.edges(spark, sf).groupBy("type").agg(F.count("*").alias("n")).orderBy(F.desc("n"))


@query(X.sql("SELECT confidence, count(*) AS n FROM edges WHERE type = 'CALLS' GROUP BY confidence"))
def c23_count_per_confidence(spark, sf):
    return X.edges(spark, sf, {"CALLS"}).groupBy("confidence").agg(F.count("*").alias("n"))


@query(X.sql("SELECT type, count(*) AS total, sum(CASE WHEN confidence >= 1.0 OR contains(reason, 'LSP:') THEN 1 ELSE 0 END)::BIGINT AS verified, sum(CASE WHEN confidence >= 1.0 OR contains(reason, 'LSP:') THEN 0 ELSE 1 END)::BIGINT AS heuristic FROM edges GROUP BY type"))
def c24_conditional_aggregate(spark, sf):
    return R.precision(X.edges(spark, sf))


@query(X.sql("SELECT (SELECT count(*) FROM nodes) + (SELECT count(*) FROM edges) AS total"))
def c25_global_total(spark, sf):
    g = X.graph(spark, sf)
    return g.nodes.select("id").union(g.edges.select("sourceId")).agg(F.count("*").alias("total"))


@query(X.sql("SELECT (SELECT count(*) FROM nodes) AS nodes, count(*) AS edges, count(*) FILTER (type NOT IN ('CFG','REACHING_DEF','CDG','POST_DOMINATE','TAINTED','SANITIZES','TAINT_PATH','CALL_SUMMARY')) AS structural FROM edges"))
def c26_store_stats(spark, sf):
    g = X.graph(spark, sf)
    marked = g.nodes.select(F.lit(1).alias("n"), F.lit(0).alias("e"), F.lit(0).alias("s")).union(g.edges.select(F.lit(0), F.lit(1), F.when(c("type").isin(schema.PDG_TYPES), 0).otherwise(1)))
    return marked.agg(F.sum("n").alias("nodes"), F.sum("e").alias("edges"), F.sum("s").alias("structural"))


@query(X.sql("SELECT DISTINCT filePath FROM nodes WHERE label = 'Method'"))
def c27_distinct(spark, sf):
    return X.nodes(spark, sf, {"Method"}).select("filePath").distinct()


@query(X.sql("SELECT e.targetId AS id, string_agg(DISTINCT n.filePath, ',' ORDER BY n.filePath) AS callers FROM edges e JOIN nodes n ON n.id = e.sourceId WHERE e.type = 'CALLS' GROUP BY 1"))
def c28_distinct_list(spark, sf):
    g = X.graph(spark, sf, {"Method"}, {"CALLS"})
    return R.match_edge(g, ["CALLS"], cols=("id", "filePath")).groupBy(c("targetId").alias("id")).agg(F.array_join(F.array_sort(F.collect_set("a_filePath")), ",").alias("callers"))


@query(X.sql("SELECT sourceId, step FROM edges WHERE type = 'STEP_IN_PROCESS' AND targetId = 'proc_10' ORDER BY step"))
def c29_order_by(spark, sf):
    return X.edges(spark, sf, {"STEP_IN_PROCESS"}).filter("targetId = 'proc_10'").orderBy("step").select("sourceId", c("step").cast("long").alias("step"))


@query(X.sql("SELECT sourceId, targetId, confidence FROM edges WHERE type = 'CALLS' ORDER BY confidence DESC, sourceId, targetId LIMIT 25"))
def c30_top_k(spark, sf):
    return R.top_k(X.edges(spark, sf, {"CALLS"}).select("sourceId", "targetId", "confidence"), [F.desc("confidence"), c("sourceId"), c("targetId")], 25)


@query(X.sql("SELECT id FROM nodes WHERE label = 'Function' ORDER BY id LIMIT 8"))
def c31_limit(spark, sf):
    return R.top_k(X.nodes(spark, sf, {"Function"}).select("id"), [c("id")], 8)


@query(X.sql("SELECT process, callee, rn FROM (SELECT p.id AS process, e.targetId AS callee, row_number() OVER (PARTITION BY p.id ORDER BY e.emit_ord, e.targetId) AS rn FROM nodes p JOIN edges e ON e.sourceId = p.entryPointId AND e.type = 'CALLS' WHERE p.label = 'Process') WHERE rn <= 4"))
def c32_decorrelated_callees(spark, sf):
    p = X.nodes(spark, sf, {"Process"}).select(c("id").alias("process"), "entryPointId")
    j = p.join(X.edges(spark, sf, {"CALLS"}), c("entryPointId") == c("sourceId"))
    return R.first_k(j.select("process", c("targetId").alias("callee"), "emit_ord"), ["process"], ["emit_ord", "callee"], 4).select("process", "callee", c("rn").cast("long").alias("rn"))


@query(X.sql("SELECT e.targetId AS process, n.name, e.step, e.step = max(e.step) OVER (PARTITION BY e.targetId) AS is_last FROM edges e JOIN nodes n ON n.id = e.sourceId WHERE e.type = 'STEP_IN_PROCESS'"))
def c33_process_steps(spark, sf):
    g = X.graph(spark, sf, {"Method"}, {"STEP_IN_PROCESS"})
    m = R.match_edge(G.Graph(g.nodes.union(X.nodes(spark, sf, {"Process"})), g.edges), cols=("id", "name"))
    return m.select(c("targetId").alias("process"), c("a_name").alias("name"), c("step").cast("long").alias("step"), (c("step") == F.max("step").over(W.partitionBy("targetId"))).alias("is_last"))


@query(X.sql("SELECT 'out' AS direction, targetId AS other, confidence FROM edges WHERE type = 'CALLS' AND sourceId = 'Method:P7' UNION ALL SELECT 'in', sourceId, confidence FROM edges WHERE type = 'CALLS' AND targetId = 'Method:P7'"))
def c34_calls_of_node(spark, sf):
    e = X.edges(spark, sf, {"CALLS"})
    return e.filter("sourceId = 'Method:P7'").select(F.lit("out").alias("direction"), c("targetId").alias("other"), "confidence").union(e.filter("targetId = 'Method:P7'").select(F.lit("in"), "sourceId", "confidence"))


@query(X.sql("SELECT p.id AS process, e.step, e.sourceId AS method FROM nodes p JOIN edges e ON e.targetId = p.id AND e.type = 'STEP_IN_PROCESS' WHERE p.name = '1-URGENT'"))
def c35_steps_of_processes(spark, sf):
    p = X.nodes(spark, sf, {"Process"}).filter("name = '1-URGENT'").select(c("id").alias("process"))
    return p.join(X.edges(spark, sf, {"STEP_IN_PROCESS"}), c("process") == c("targetId")).select("process", c("step").cast("long").alias("step"), c("sourceId").alias("method"))


@query(X.sql("SELECT a.name AS caller, b.name AS callee, CASE WHEN e.confidence >= 1.0 OR contains(e.reason, 'LSP:') THEN 'LSP' ELSE 'AST' END AS source FROM edges e JOIN nodes a ON a.id = e.sourceId JOIN nodes b ON b.id = e.targetId WHERE e.type = 'CALLS'"))
def c36_calls_by_name(spark, sf):
    g = X.graph(spark, sf, {"Method"}, {"CALLS"})
    return R.match_edge(g, ["CALLS"]).select(c("a_name").alias("caller"), c("b_name").alias("callee"), F.when(R.verified(), "LSP").otherwise("AST").alias("source"))


@query(X.sql("SELECT b.name AS callee, count(*) AS calls FROM edges e JOIN nodes a ON a.id = e.sourceId AND a.label = 'Method' JOIN nodes b ON b.id = e.targetId AND b.label = 'Method' WHERE e.type = 'CALLS' AND e.confidence >= 0.8 AND contains(a.name, 'e') GROUP BY 1 ORDER BY calls DESC, callee LIMIT 20"))
def c37_pattern_text(spark, sf):
    return cypher.run(X.graph(spark, sf, {"Method"}, {"CALLS"}), "MATCH (a:Method)-[r:CALLS]->(b:Method) WHERE r.confidence >= 0.8 AND a.name CONTAINS $x RETURN b.name AS callee, count(*) AS calls ORDER BY calls DESC, callee LIMIT 20", {"x": "e"})


@query(X.sql("SELECT id, name FROM nodes WHERE label = 'Interface' AND name >= 'J'"))
def c38_bound_parameters(spark, sf):
    return cypher.run(X.graph(spark, sf, {"Interface"}, {"CONTAINS"}), "MATCH (n:Interface) WHERE n.name >= $from RETURN n.id AS id, n.name AS name", {"from": "J"})


@query(X.sql("SELECT DISTINCT a.filePath FROM edges e JOIN nodes a ON a.id = e.sourceId JOIN nodes b ON b.id = e.targetId WHERE e.type = 'CALLS' AND b.filePath IN ('Brand#11', 'Brand#22')"))
def c40_importers(spark, sf):
    g = X.graph(spark, sf, {"Method"}, {"CALLS"})
    return R.match_edge(g, ["CALLS"], dst=c("filePath").isin("Brand#11", "Brand#22"), cols=("id", "filePath")).select(c("a_filePath").alias("filePath")).distinct().orderBy("filePath")


@query(X.sql("SELECT type, count(*) AS n FROM edges WHERE NOT (type = 'CALLS' AND reason = 'fixture') GROUP BY type"))
def c41_delete_edges(spark, sf):
    return R.delete_edges(X.edges(spark, sf), ["CALLS"], ["fixture"]).groupBy("type").agg(F.count("*").alias("n"))


_GONE = "gone AS (SELECT id FROM nodes WHERE filePath IN ('Brand#11', 'Brand#12') AND label NOT IN ('Community', 'Process'))"


@query(X.sql("SELECT 'nodes' AS what, count(*) AS n FROM nodes WHERE id NOT IN (SELECT id FROM gone) UNION ALL SELECT 'edges', count(*) FROM edges WHERE sourceId NOT IN (SELECT id FROM gone) AND targetId NOT IN (SELECT id FROM gone)", _GONE))
def c42_delete_files(spark, sf):
    files = spark.createDataFrame([("Brand#11",), ("Brand#12",)], "filePath string")
    g = G.remove_files(X.graph(spark, sf), files)
    return g.nodes.agg(F.lit("nodes").alias("what"), F.count("*").alias("n")).union(g.edges.agg(F.lit("edges"), F.count("*")))


@query(X.sql("SELECT label, count(*) AS n FROM nodes WHERE label NOT IN ('Community', 'Process') GROUP BY label"))
def c43_drop_overlays(spark, sf):
    return X.nodes(spark, sf).filter(~c("label").isin("Community", "Process")).groupBy("label").agg(F.count("*").alias("n"))


@query(X.sql("SELECT count(*) AS n FROM nodes WHERE NOT (label = 'Function' AND name LIKE '%0')"))
def c44_drop_synthetic(spark, sf):
    return X.nodes(spark, sf).filter(~((c("label") == "Function") & c("name").endswith("0"))).agg(F.count("*").alias("n"))


@query(X.sql("SELECT p.entryPointId AS sourceId, p.terminalId AS targetId FROM nodes p WHERE p.label = 'Process' AND p.entryPointId IN (SELECT id FROM nodes) AND p.terminalId IN (SELECT id FROM nodes)"))
def c45_insert_edges(spark, sf):
    g = X.graph(spark, sf, {"Method", "Process"}, {"MEMBER_OF"})
    pairs = g.nodes.filter("label = 'Process'").select(c("entryPointId").alias("sourceId"), c("terminalId").alias("targetId"))
    return R.insert_edges(g, pairs, "FLOWS_TO").edges.filter("type = 'FLOWS_TO'").select("sourceId", "targetId")


@query(X.sql("SELECT label, count(*) AS n FROM nodes WHERE label IN ('Function', 'Class', 'Method', 'Interface', 'File') GROUP BY label"))
def c46_embeddable(spark, sf):
    return X.nodes(spark, sf).filter(c("label").isin(schema.EMBEDDABLE)).groupBy("label").agg(F.count("*").alias("n"))


@query("SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS rn FROM events) WHERE rn = 1")
def d1_first_write_wins(spark, sf):
    return G.first_write_wins(X.table(spark, sf, "events").select("user_id", "event_type", "event_id", "ts"), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id")


@query(X.sql("SELECT * FROM (SELECT sourceId, targetId, emit_ord, row_number() OVER (PARTITION BY least(sourceId, targetId), greatest(sourceId, targetId) ORDER BY emit_ord, sourceId) AS rn FROM edges WHERE type = 'CALLS') WHERE rn = 1").replace("SELECT * FROM (SELECT sourceId", "SELECT sourceId, targetId, emit_ord FROM (SELECT sourceId"))
def d2_first_edge_wins(spark, sf):
    e = X.edges(spark, sf, {"CALLS"}).select("sourceId", "targetId", "emit_ord", F.least("sourceId", "targetId").alias("a"), F.greatest("sourceId", "targetId").alias("b"))
    return G.first_write_wins(e, ["a", "b"], ["emit_ord", "sourceId"]).select("sourceId", "targetId", "emit_ord")


@query(X.sql("SELECT type, count(*) AS n FROM edges WHERE sourceId NOT LIKE '%7' AND targetId NOT LIKE '%7' GROUP BY type"))
def d3_remove_nodes(spark, sf):
    g = X.graph(spark, sf)
    return G.remove_nodes(g, g.nodes.filter(c("id").endswith("7")).select("id")).edges.groupBy("type").agg(F.count("*").alias("n"))


@query(X.sql("SELECT count(*) AS n FROM edges WHERE type <> 'CONTAINS'"))
def d4_remove_edges(spark, sf):
    return R.delete_edges(X.edges(spark, sf), ["CONTAINS"]).agg(F.count("*").alias("n"))


@query(X.sql("SELECT filePath, count(*) AS removed FROM nodes WHERE filePath IN ('Brand#21', 'Brand#31') GROUP BY 1"))
def d5_removed_per_file(spark, sf):
    return X.nodes(spark, sf, {"Method"}).filter(c("filePath").isin("Brand#21", "Brand#31")).groupBy("filePath").agg(F.count("*").alias("removed"))


@query(X.sql("SELECT sourceId, targetId FROM edges WHERE type = 'MEMBER_OF'"))
def d6_iterate_type(spark, sf):
    return X.graph(spark, sf, {"Function"}, {"MEMBER_OF"}).of_type("MEMBER_OF").select("sourceId", "targetId")


@query(X.sql("SELECT sourceId, targetId, type, confidence FROM edges WHERE type <> 'HAS_METHOD'"))
def d7_four_fields(spark, sf):
    return X.edges(spark, sf).filter("type <> 'HAS_METHOD'").select("sourceId", "targetId", "type", "confidence")


@query(X.sql("SELECT sourceId AS id, string_agg(targetId, ' ' ORDER BY emit_ord, targetId) AS neighbours FROM edges WHERE type = 'CALLS' AND confidence >= 0.5 GROUP BY 1"))
def d8_adjacency(spark, sf):
    return G.adjacency(X.edges(spark, sf, {"CALLS"})).select("id", F.array_join("neighbours", " ").alias("neighbours"))


@query(X.sql("SELECT id, sum(i)::BIGINT AS in_degree, sum(o)::BIGINT AS out_degree, count(*) AS degree FROM (SELECT sourceId AS id, 0 AS i, 1 AS o FROM edges UNION ALL SELECT targetId, 1, 0 FROM edges) GROUP BY id"))
def d9_degrees(spark, sf):
    return G.degrees(X.edges(spark, sf))


_PAIRS = "lab AS (SELECT *, CASE WHEN sourceId LIKE 'comm\\_%' ESCAPE '\\' THEN 'Community' WHEN sourceId LIKE 'proc\\_%' ESCAPE '\\' THEN 'Process' ELSE split_part(sourceId, ':', 1) END AS fromLabel, CASE WHEN targetId LIKE 'comm\\_%' ESCAPE '\\' THEN 'Community' WHEN targetId LIKE 'proc\\_%' ESCAPE '\\' THEN 'Process' ELSE split_part(targetId, ':', 1) END AS toLabel FROM edges)"


@query(X.sql("SELECT fromLabel, toLabel, count(*) AS edges, NOT (fromLabel = 'Function' AND toLabel = 'Community') AS declared FROM lab GROUP BY 1, 2", _PAIRS))
def d10_pair_report(spark, sf):
    known = [("Folder", "Interface"), ("Class", "Interface"), ("Class", "Method"), ("Method", "Method"), ("Method", "Process")]
    return schema.pair_report(X.edges(spark, sf), spark.createDataFrame(known, "fromLabel string, toLabel string"))


@query(X.sql("SELECT DISTINCT least(sourceId, targetId) AS a, greatest(sourceId, targetId) AS b FROM edges WHERE type = 'CALLS' AND sourceId <> targetId"))
def d11_undirected(spark, sf):
    return G.simple_undirected(X.edges(spark, sf, {"CALLS"}))


_CSR = "u AS (SELECT DISTINCT least(sourceId, targetId) AS a, greatest(sourceId, targetId) AS b FROM edges WHERE type = 'CALLS' AND confidence >= 0.9), r AS (SELECT id, string_agg(n, ' ' ORDER BY n) AS neighbours, count(*) AS k FROM (SELECT a AS id, b AS n FROM u UNION SELECT b, a FROM u) GROUP BY id)"


@query(X.sql("SELECT id, neighbours, coalesce(sum(k) OVER (ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS \"offset\" FROM r", _CSR))
def d12_csr(spark, sf):
    rows = G.csr(G.simple_undirected(X.edges(spark, sf, {"CALLS"}).filter("confidence >= 0.9")))
    return rows.select("id", F.array_join("neighbours", " ").alias("neighbours"), "offset")
