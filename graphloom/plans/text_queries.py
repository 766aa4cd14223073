"""Queries of sources, documents, search and incremental maintenance."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import schema
from ..operators import incremental as I
from ..operators import search as S
from ..operators import structure as E
from ..sources import readers
from . import fixture as X
from .registry import query

c = F.col


def literal(rows: list[tuple[str, ...]], names: str) -> str:
    """Rows as a SQL table expression."""
    quoted = ", ".join("(" + ", ".join("NULL" if v is None else "'" + str(v).replace("'", "''") + "'" for v in r) + ")" for r in rows)
    return f"(VALUES {quoted}) AS t({names})"


def frame(spark, rows, names: str):
    return spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names.split(", ")))


@query("SELECT 'node' AS kind, (SELECT count(*) FROM part) + (SELECT count(*) FROM supplier) AS n UNION ALL SELECT 'edge', (SELECT count(*) FROM nation)")
def a4_graph_document(spark, sf):
    n, e = readers.graph_document_rows(X.nodes(spark, sf, {"Method", "Class"}), X.edges(spark, sf, {"CONTAINS"}))
    back = readers.read_documents(n, e)
    return back.nodes.agg(F.lit("node").alias("kind"), F.count("*").alias("n")).union(back.edges.agg(F.lit("edge"), F.count("*")))


@query(X.sql("SELECT id, coalesce(startLine, 1) AS startLine, coalesce(method, 'GET') AS method FROM nodes WHERE label IN ('Class', 'Method', 'Route')"))
def a6_nodes_with_defaults(spark, sf):
    return readers.with_defaults(X.nodes(spark, sf, {"Class", "Method", "Route"})).select("id", "startLine", "method")


@query(X.sql("SELECT sourceId, targetId, CASE WHEN confidence IS NULL OR confidence = 0 THEN 1.0 ELSE confidence END AS confidence FROM edges WHERE type = 'CALLS'"))
def a7_edge_scan(spark, sf):
    return readers.edge_scan(X.edges(spark, sf), ["CALLS"]).select("sourceId", "targetId", "confidence")


_CODE = "src AS (SELECT CASE l_orderkey % 5 WHEN 0 THEN 'src/o' || l_orderkey || '.java' WHEN 1 THEN 'app/o' || l_orderkey || '.py' WHEN 2 THEN 'node_modules/o' || l_orderkey || '.ts' WHEN 3 THEN '.o' || l_orderkey || '.py' ELSE 'n/o' || l_orderkey || '.cs' END AS path, l_orderkey % 5 AS k, step, l_partkey AS p FROM steps)"


@query(X.sql("SELECT path, step + 1 AS line, CASE k WHEN 1 THEN 'from m' || p || ' import x' ELSE 'a.P' || p END AS package FROM src WHERE k IN (0, 1, 4) AND p % 3 > 0", _CODE))
def a9_import_lines(spark, sf):
    return E.imports(_sources(spark, sf))


def _sources(spark, sf):
    """A source for each order: a comment, then an import or another line for each item."""
    k, p, o = c("l_orderkey") % 5, c("l_partkey").cast("string"), c("l_orderkey").cast("string")
    path = F.when(k == 0, F.concat(F.lit("src/o"), o, F.lit(".java"))).when(k == 1, F.concat(F.lit("app/o"), o, F.lit(".py"))).when(k == 2, F.concat(F.lit("node_modules/o"), o, F.lit(".ts"))).when(k == 3, F.concat(F.lit(".o"), o, F.lit(".py"))).otherwise(F.concat(F.lit("n/o"), o, F.lit(".cs")))
    line = F.when(c("l_partkey") % 3 == 0, F.concat(F.lit("important a.P"), p)).when(k == 4, F.concat(F.lit("using a.P"), p, F.lit(";"))).when(k == 1, F.concat(F.lit("from m"), p, F.lit(" import x"))).otherwise(F.concat(F.lit("  import a.P"), p, F.lit(";")))
    g = X.steps(spark, sf).select(path.alias("path"), "step", line.alias("t")).groupBy("path").agg(F.array_sort(F.collect_list(F.struct("step", "t"))).alias("ts"))
    return g.select("path", F.concat(F.lit("# order\n"), F.array_join(F.transform("ts", lambda t: t["t"]), "\n")).alias("content"))


@query("SELECT url, url LIKE '%.html' AS page, url LIKE '%docs%' AS docs FROM pages WHERE NOT (url LIKE '%private%' OR url LIKE '%/7%')")
def a3_ignore_rules(spark, sf):
    rules = spark.createDataFrame([("private",), ("/7",)], "pattern string")
    kept = readers.ignored(X.table(spark, sf, "pages").select(c("url").alias("path")), rules)
    return kept.select(c("path").alias("url"), c("path").endswith(".html").alias("page"), c("path").contains("docs").alias("docs"))


#: A diff for each order: a file for each item, with a hunk whose counts come from the item.
_DIFFS = "d AS (SELECT l_orderkey AS diff, l_partkey AS p, step, l_suppkey % 4 AS n FROM steps)"


@query(X.sql("SELECT diff, 'src/P' || p || '.ts' AS filePath, greatest(p, 1) AS startLine, CASE WHEN n = 0 THEN greatest(p, 1) ELSE p + n - 1 END AS endLine FROM d WHERE step % 3 > 0", _DIFFS))
def a11_diff_hunks(spark, sf):
    p, n = c("l_partkey").cast("string"), c("l_suppkey") % 4
    new = F.when(c("step") % 3 == 0, F.lit("+++ /dev/null")).otherwise(F.concat(F.lit("+++ b/src/P"), p, F.lit(".ts")))
    at = F.concat(F.lit("@@ -5,2 +"), p, F.when(n == 1, F.lit("")).otherwise(F.concat(F.lit(","), n.cast("string"))), F.lit(" @@ context"))
    text = F.concat(F.lit("--- a/old\n"), new, F.lit("\n"), at, F.lit("\n ctx\n+new\n-old"))
    g = X.steps(spark, sf).select(c("l_orderkey").alias("diff"), "step", text.alias("t")).groupBy("diff").agg(F.array_sort(F.collect_list(F.struct("step", "t"))).alias("ts"))
    return E.hunks(g.select("diff", F.array_join(F.transform("ts", lambda t: t["t"]), "\n").alias("text")))


_KEYS = "k AS (SELECT l_orderkey AS o, 's' || l_suppkey AS s, 'p' || l_partkey AS p, l_partkey, step FROM steps)"


@query(
    X.sql(
        "SELECT 'a/application-' || o || '.properties' AS path, s || '.' || p AS name FROM k WHERE o % 2 = 0 AND l_partkey % 7 > 0 UNION ALL SELECT 'application-' || o || '.yml', s || '.' || p FROM k WHERE o % 2 = 1",
        _KEYS,
    )
)
def a15_config_keys(spark, sf):
    """Properties of even orders (each seventh line is a comment), nested keys of odd ones, and files of other names."""
    o, s, p = c("l_orderkey").cast("string"), F.concat(F.lit("s"), c("l_suppkey").cast("string")), F.concat(F.lit("p"), c("l_partkey").cast("string"))
    prop = F.concat(F.when(c("l_partkey") % 7 == 0, "# ").otherwise(" "), s, F.lit("."), p, F.when(c("l_partkey") % 2 == 0, " = 1").otherwise(": 2"))
    yml = F.concat(s, F.lit(":\n  # note: no\n  "), p, F.lit(": 1"))
    path = F.when(c("l_orderkey") % 2 == 0, F.concat(F.lit("a/application-"), o, F.lit(".properties"))).otherwise(F.concat(F.lit("application-"), o, F.lit(".yml")))
    g = X.steps(spark, sf).select(path.alias("path"), "step", F.when(c("l_orderkey") % 2 == 0, prop).otherwise(yml).alias("t")).groupBy("path").agg(F.array_sort(F.collect_list(F.struct("step", "t"))).alias("ts"))
    files = g.select("path", F.array_join(F.transform("ts", lambda t: t["t"]), "\n").alias("content"))
    return readers.config_keys(files.union(files.select(F.concat(F.lit("other/"), F.regexp_replace("path", "application", "settings")), "content")))


@query("SELECT * FROM (VALUES ('META-INF/spring.factories', 'com.a.One'), ('META-INF/spring.factories', 'com.a.Two'), ('META-INF/spring/org.springframework.boot.autoconfigure.AutoConfiguration.imports', 'com.b.Three')) AS t(path, class)")
def a16_auto_configuration(spark, sf):
    files = [("META-INF/spring.factories", "org.springframework.boot.autoconfigure.EnableAutoConfiguration=com.a.One,\\\n  com.a.Two\nother.Key=com.c.No"), ("META-INF/spring/org.springframework.boot.autoconfigure.AutoConfiguration.imports", "# c\ncom.b.Three\n")]
    return readers.auto_configurations(frame(spark, files, "path, content"))


_PARTS = "p AS (SELECT DISTINCT page_id, list_filter(string_split(regexp_replace(url, '^https?://', ''), '/'), lambda x: x <> '') AS parts FROM pages), x AS (SELECT parts, unnest(range(1, len(parts) + 1)) AS i FROM p)"


@query(f"WITH {_PARTS} SELECT DISTINCT CASE WHEN i > 1 THEN array_to_string(parts[1:i - 1], '/') END AS parent, array_to_string(parts[1:i], '/') AS child, CASE WHEN i = len(parts) THEN 'File' ELSE 'Folder' END AS label FROM x")
def e1_folders(spark, sf):
    return E.folders(X.table(spark, sf, "pages").select(F.regexp_replace("url", "^https?://", "").alias("path")))


#: Each order as a document: a heading and a line of text with a link for each item. Levels follow the line number.
_MD = "md AS MATERIALIZED (SELECT 'o' || l_orderkey || '.md' AS path, 2 * row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1 AS line, 1 + l_partkey % 4 AS level, 'P' || l_partkey AS title, l_partkey AS p, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem)"


def _markdown(spark, sf):
    p = c("l_partkey").cast("string")
    s = X.steps(spark, sf)
    text = F.concat(F.repeat(F.lit("#"), (1 + c("l_partkey") % 4).cast("int")), F.lit(" P"), p, F.lit("\nsee [it](./x/../o"), p, F.lit(".md#part) or [web](https://a.b/o1.md)"))
    g = s.groupBy(F.concat(F.lit("o"), c("l_orderkey").cast("string"), F.lit(".md")).alias("path")).agg(F.array_sort(F.collect_list(F.struct("step", text.alias("t")))).alias("ts"))
    return g.select("path", F.array_join(F.transform("ts", lambda t: t["t"]), "\n").alias("content"))


@query(f"WITH {_MD} SELECT path, line, level, title FROM md")
def e2_headings(spark, sf):
    return E.headings(_markdown(spark, sf))


@query(f"WITH {_MD} SELECT a.path, a.line, coalesce(min(b.line) - 1, max(2 * a.n)) AS end_line FROM md a LEFT JOIN md b ON b.path = a.path AND b.line > a.line AND b.level <= a.level GROUP BY a.path, a.line")
def e3_section_extent(spark, sf):
    return E.sections(_markdown(spark, sf)).select("path", "line", "end_line")


@query(f"WITH {_MD} SELECT a.path, a.line, max(b.line) AS parent_line FROM md a LEFT JOIN md b ON b.path = a.path AND b.line < a.line AND b.level < a.level GROUP BY a.path, a.line")
def e4_section_nesting(spark, sf):
    return E.sections(_markdown(spark, sf)).select("path", "line", "parent_line")


@query(f"WITH {_MD} SELECT DISTINCT path AS source, 'o' || p || '.md' AS target FROM md WHERE 'o' || p || '.md' IN (SELECT path FROM md) AND 'o' || p || '.md' <> path")
def e5_links(spark, sf):
    return E.links(_markdown(spark, sf))


@query("SELECT doc_id, left(array_to_string(string_split(text, chr(10))[2:3], chr(10)), 5000) || CASE WHEN length(array_to_string(string_split(text, chr(10))[2:3], chr(10))) > 5000 THEN chr(10) || '... [truncated]' ELSE '' END AS snippet FROM documents")
def e6_snippets(spark, sf):
    return X.table(spark, sf, "documents").select("doc_id", E.snippet(c("text"), F.lit(2), F.lit(3)).alias("snippet"))


@query(r"SELECT doc_id, coalesce(length(left(text, 1000)) - length(regexp_replace(left(text, 1000), '[\x00-\x08\x0E-\x1F\x7F]', '', 'g')) > length(left(text, 1000)) * 0.1, false) AS binary_text FROM documents")
def e7_binary_test(spark, sf):
    return X.table(spark, sf, "documents").select("doc_id", E.is_binary(c("text")).alias("binary_text"))


@query(r"SELECT doc_id, regexp_replace(text, '[\r\n\t]+', ' ', 'g') AS fts_text FROM documents")
def e8_search_text(spark, sf):
    return X.table(spark, sf, "documents").select("doc_id", E.search_text(c("text")).alias("fts_text"))


CODE = [("b.py", "x = run(1)\ndef run(a):\n  return a"), ("a.ts", "const run = 1;\nrun();"), ("c.java", "class Runner {\n public void run(int a) {}\n}")]


@query("SELECT 'b.py' AS path, 2 AS line, 95 AS score")
def e9_symbol_search(spark, sf):
    return E.find_symbol(frame(spark, CODE, "path, content"), "run")


@query(X.sql("SELECT id, CASE WHEN coalesce(name, '') = '' THEN 'Process' ELSE regexp_replace(name, '#[0-9]+$', '') END AS clean, list_last(string_split(id, ':')) AS last FROM nodes WHERE label IN ('Class', 'Method', 'Route')"))
def e10_names(spark, sf):
    return X.nodes(spark, sf, {"Class", "Method", "Route"}).select("id", E.clean_name(c("name")).alias("clean"), E.last_segment(c("id")).alias("last"))


@query("SELECT doc_id, sha256(text) AS hash FROM documents")
def i1_content_hash(spark, sf):
    return X.table(spark, sf, "documents").select("doc_id", I.content_hash(c("text")).alias("hash"))


def _hashes(spark, sf):
    d = X.table(spark, sf, "documents")
    now = d.select(c("doc_id").cast("string").alias("path"), I.content_hash(c("text")).alias("hash"))
    was = d.filter("doc_id % 11 <> 0").select(c("doc_id").cast("string").alias("path"), I.content_hash(F.when(c("doc_id") % 7 == 0, F.concat("text", F.lit("!"))).otherwise(c("text"))).alias("hash"))
    return now, was.union(spark.createDataFrame([("gone", "0")], "path string, hash string"))


@query("SELECT doc_id::VARCHAR AS path, CASE WHEN doc_id % 11 = 0 THEN 'added' WHEN doc_id % 7 = 0 THEN 'changed' ELSE 'same' END AS state FROM documents UNION ALL SELECT 'gone', 'deleted'")
def i2_hash_diff(spark, sf):
    return I.hash_diff(*_hashes(spark, sf))


@query("SELECT source, sha256(string_agg(doc_id || ':' || sha256(text), chr(10) ORDER BY doc_id || ':' || sha256(text))) AS chunk_key FROM documents GROUP BY source")
def i3_chunk_keys(spark, sf):
    d = X.table(spark, sf, "documents").select("source", c("doc_id").cast("string").alias("path"), I.content_hash(c("text")).alias("hash"))
    return I.chunk_key(d, "source")


@query("SELECT doc_id::VARCHAR AS path, sha256(text) AS hash FROM documents WHERE sha256(text) IN (SELECT sha256(text) FROM documents WHERE doc_id % 3 = 0)")
def i4_prune_cache(spark, sf):
    now, _ = _hashes(spark, sf)
    return I.prune_cache(now, now.filter("cast(path as int) % 3 = 0")).select("path", "hash")


@query(X.sql("SELECT path, min(round)::INT AS round FROM r GROUP BY path", "r AS (SELECT 7 AS path, 0 AS round UNION SELECT s.src, r.round + 1 FROM r JOIN calls s ON s.dst = r.path WHERE r.round < 10)", recursive=True))
def i5_importers(spark, sf):
    e = X.calls(spark, sf).select(c("src").alias("source"), c("dst").alias("target"))
    return I.importers(e, spark.createDataFrame([(7,)], "path long"))


_HUNKS = "h AS (SELECT user_id::VARCHAR AS filePath, (date_part('hour', ts) * 60 + date_part('minute', ts))::BIGINT + 1 AS startLine, (date_part('hour', ts) * 60 + date_part('minute', ts))::BIGINT + 1 + event_id % 30 AS endLine FROM events)"


def _hunks(spark, sf):
    at = F.hour("ts") * 60 + F.minute("ts")
    return X.table(spark, sf, "events").select(c("user_id").cast("string").alias("filePath"), (at + 1).cast("long").alias("startLine"), (at + 1 + c("event_id") % 30).alias("endLine"))


_ISLES = _HUNKS + ", m AS (SELECT *, CASE WHEN startLine > max(endLine) OVER w + 1 OR max(endLine) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM h WINDOW w AS (PARTITION BY filePath ORDER BY startLine, endLine ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), g AS (SELECT *, sum(new) OVER (PARTITION BY filePath ORDER BY startLine, endLine) AS isle FROM m), merged AS (SELECT filePath, min(startLine) - 1 AS startLine, max(endLine) - 1 AS endLine FROM g GROUP BY filePath, isle)"


@query(f"WITH {_ISLES} SELECT filePath, startLine, endLine FROM merged")
def i6_coalesce_hunks(spark, sf):
    return I.coalesce_hunks(_hunks(spark, sf))


@query(X.sql("SELECT DISTINCT n.id FROM nodes n JOIN h ON n.filePath = h.filePath AND n.endLine >= h.startLine AND n.startLine <= h.endLine WHERE n.label = 'Method'", "h AS (SELECT p_brand AS filePath, p_partkey * 13 AS startLine, p_partkey * 13 + p_size AS endLine FROM part WHERE p_partkey % 5 = 0)"))
def i7_touched_symbols(spark, sf):
    hunks = X.table(spark, sf, "part").filter("p_partkey % 5 = 0").select(c("p_brand").alias("filePath"), (c("p_partkey") * 13).alias("startLine"), (c("p_partkey") * 13 + c("p_size")).alias("endLine"))
    return I.touched_symbols(hunks, X.nodes(spark, sf, {"Method"})).select("id")


@query("SELECT doc_id AS id, CASE WHEN doc_id % 11 = 0 THEN 'missing' WHEN doc_id % 7 = 0 THEN 'stale' ELSE 'fresh' END AS state FROM documents")
def i8_stale_embeddings(spark, sf):
    now, was = _hashes(spark, sf)
    return I.stale_embeddings(now.select(c("path").cast("long").alias("id"), "hash"), was.filter("path <> 'gone'").select(c("path").cast("long").alias("id"), "hash"))


@query()
def i9_fingerprint(spark, sf):
    return spark.createDataFrame([(schema.fingerprint(schema.NODES, schema.EDGES),)], "fingerprint string")


_TOK = "w AS (SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^a-z0-9]+'), lambda x: x <> '') AS w FROM documents), tok AS (SELECT doc_id, len(w) AS len, unnest(w) AS term FROM w)"


@query(f"WITH {_TOK} SELECT doc_id, term, count(*) AS tf, any_value(len)::INT AS len FROM tok GROUP BY doc_id, term")
def j1_token_table(spark, sf):
    return S.tokens(X.table(spark, sf, "documents"))


def _bm25_sql(terms: str, extra: str = "", limit: str = "LIMIT 20") -> str:
    return (
        f"WITH {_TOK}, hits AS (SELECT doc_id, term, count(*) AS tf, any_value(len) AS len FROM tok WHERE term IN ({terms}) GROUP BY 1, 2), stats AS (SELECT count(*) AS n, avg(len(w)) AS a FROM w), "
        "df AS (SELECT term, count(*) AS df FROM hits GROUP BY 1), scored AS (SELECT doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / a))), 9) AS score, count(DISTINCT term) AS k FROM hits JOIN df USING (term), stats GROUP BY 1) "
        f"SELECT doc_id, score FROM scored {extra} ORDER BY score DESC, doc_id {limit}"
    )


@query(_bm25_sql("'the', 'license', 'token'"))
def j2_bm25(spark, sf):
    return S.bm25(X.table(spark, sf, "documents"), "the license, TOKEN")


@query(_bm25_sql("'the', 'mit'", "WHERE k = 2"))
def j2_bm25_conjunctive(spark, sf):
    return S.bm25(X.table(spark, sf, "documents"), "mit the", conjunctive=True)


@query(X.sql("SELECT id FROM nodes WHERE label = 'Method' AND (isExported IS NULL OR isExported = false)"))
def j3_detail_exclusion(spark, sf):
    return X.nodes(spark, sf, {"Method"}).filter(c("isExported").isNull() | ~c("isExported")).select("id")


@query(f"SELECT filePath, round(sum(score), 9) AS score, string_agg(id, ',' ORDER BY rn) AS ids FROM (SELECT *, row_number() OVER (PARTITION BY filePath ORDER BY score DESC, id) AS rn FROM (SELECT d.source AS filePath, s.doc_id AS id, s.score FROM ({_bm25_sql(chr(39) + 'the' + chr(39), '', '')}) s JOIN documents d USING (doc_id))) WHERE rn <= 3 GROUP BY filePath")
def j4_file_scores(spark, sf):
    d = X.table(spark, sf, "documents")
    scored = S.bm25(d, "the", limit=None).join(d.select("doc_id", c("source").alias("filePath")), "doc_id").withColumnRenamed("doc_id", "id")
    return S.file_scores(scored)


_KNN = "SELECT vec_id, round(1 - list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)), 9) AS distance FROM embeddings ORDER BY distance, vec_id LIMIT 10"


@query(_KNN)
def j6_nearest(spark, sf):
    v = X.table(spark, sf, "embeddings")
    return S.nearest(v, v.filter("vec_id = 0").select("embedding").first()[0])


@query(f"WITH b AS (SELECT doc_id AS k, row_number() OVER (ORDER BY score DESC, doc_id) AS r FROM ({_bm25_sql(chr(39) + 'the' + chr(39))})), v AS (SELECT vec_id AS k, row_number() OVER (ORDER BY distance, vec_id) AS r FROM ({_KNN})) SELECT k AS filePath, round(sum(1.0 / (60 + r)), 9) AS score, string_agg(DISTINCT s, ',' ORDER BY s) AS sources FROM (SELECT *, 'bm25' AS s FROM b UNION ALL SELECT *, 'semantic' FROM v) GROUP BY k ORDER BY score DESC, k LIMIT 10")
def j7_rank_fusion(spark, sf):
    v = X.table(spark, sf, "embeddings")
    b = S.ranked(S.bm25(X.table(spark, sf, "documents"), "the"), [F.desc("score"), c("doc_id")]).select(c("doc_id").alias("filePath"), "rank")
    s = S.ranked(S.nearest(v, v.filter("vec_id = 0").select("embedding").first()[0]), [c("distance"), c("vec_id")]).select(c("vec_id").alias("filePath"), "rank")
    return S.fuse({"bm25": b, "semantic": s})


@query("SELECT * FROM (VALUES ('漢字 字仮 test 日'), ('ab cd'), ('한글 글자')) AS t(segmented)")
def j9_cjk_bigrams(spark, sf):
    return frame(spark, [("漢字仮test日",), ("ab cd",), ("한글자",)], "t").select(S.cjk_bigrams(c("t")).alias("segmented"))


@query("SELECT '[' || vec_id || '] ' || label || ' (' || printf('%.4f', vec_id / 8.0) || ', x)' AS line FROM embeddings")
def j10_result_lines(spark, sf):
    return X.table(spark, sf, "embeddings").select(S.result_line(c("vec_id"), c("label").cast("string"), c("vec_id") / 8.0, F.lit("x")).alias("line"))
