"""The driver tables as a property graph, as DataFrames and as the SQL that oracles begin with."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.graph import Graph
from ..session import checkpoint_folder, released, tabled


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


STEP_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]


def stored(spark: SparkSession, sf: str, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """A part of the graph that is derived from large tables: written once for each session and input, as a graph is loaded into
    a store once, in the folder of spark.checkpoint.dir. Queries read its columns and push their filters into the scan."""
    folder = checkpoint_folder(spark)
    path = f"{folder}/graph-{hashlib.sha256(sf.encode()).hexdigest()[:16]}/{name}"
    if path not in _STORED.setdefault(spark.sparkContext.applicationId, set()):
        with released(spark):
            make().write.mode("overwrite").parquet(path)
        _STORED[spark.sparkContext.applicationId].add(path)
    return spark.read.parquet(path)


_STORED: dict[str, set[str]] = {}


def steps(spark: SparkSession, sf: str) -> DataFrame:
    """Each order's line items in a fixed order: step counts from 1."""
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_discount", "l_returnflag", "l_linenumber", "l_quantity", "l_extendedprice")
    return stored(spark, sf, "steps", lambda: li.withColumn("step", F.row_number().over(W.partitionBy("l_orderkey").orderBy(*STEP_ORDER))))


def calls(spark: SparkSession, sf: str) -> DataFrame:
    """src, dst, confidence, verified, emit_ord: from part to the next part of an order. One window, no self-join."""
    return stored(spark, sf, "calls", lambda: _calls(table(spark, sf, "lineitem")))


def _calls(li: DataFrame) -> DataFrame:
    """The window ends in a table, so that its shuffle is gone when pairs are grouped."""
    order = W.partitionBy("l_orderkey").orderBy(*STEP_ORDER)
    nxt = lambda c: F.lead(c).over(order)
    s = li.select("l_orderkey", F.col("l_partkey").alias("src"), nxt("l_partkey").alias("dst"), (1.0 - 5 * nxt("l_discount")).alias("c"), (nxt("l_returnflag") == "R").alias("r"), F.row_number().over(order).alias("step"))
    pairs = tabled(s.filter("dst is not null and src <> dst").select("src", "dst", "c", F.when(F.col("r"), 1).otherwise(0).alias("r"), (F.col("l_orderkey") * 100 + F.col("step")).alias("at")))
    return pairs.groupBy("src", "dst").agg(F.round(F.max("c"), 6).alias("confidence"), F.max("r").alias("verified"), F.min("at").alias("emit_ord"))


def _node(df: DataFrame, label: str, id_: Column, name: Column, **more: Column) -> DataFrame:
    null = {"filePath": "string", "startLine": "long", "endLine": "long", "isExported": "boolean", "method": "string", "entryPointId": "string", "terminalId": "string"}
    return df.select(id_.alias("id"), F.lit(label).alias("label"), name.alias("name"), *(more.get(c, F.lit(None)).cast(t).alias(c) for c, t in null.items()))


def nodes(spark: SparkSession, sf: str, labels: set[str] | None = None) -> DataFrame:
    t = lambda n: table(spark, sf, n)
    c, cat = F.col, lambda p, n: F.concat(F.lit(p), F.col(n).cast("string"))

    def process() -> DataFrame:
        ends = (
            steps(spark, sf)
            .groupBy("l_orderkey")
            .agg(F.min_by("l_partkey", "step").alias("first"), F.max_by("l_partkey", "step").alias("last"))
        )
        o = t("orders").join(ends, c("o_orderkey") == c("l_orderkey"), "left")
        return _node(o, "Process", cat("proc_", "o_orderkey"), c("o_orderpriority"), entryPointId=cat("Method:P", "first"), terminalId=cat("Method:P", "last"))

    made = {
        "Folder": lambda: _node(t("region"), "Folder", cat("Folder:", "r_name"), c("r_name")),
        "Interface": lambda: _node(t("nation"), "Interface", cat("Interface:", "n_name"), c("n_name")),
        "Class": lambda: _node(t("supplier"), "Class", cat("Class:S", "s_suppkey"), c("s_name")),
        "Method": lambda: _node(t("part"), "Method", cat("Method:P", "p_partkey"), c("p_name"), filePath=c("p_brand"), startLine=c("p_partkey") * 10, endLine=c("p_partkey") * 10 + c("p_size"), isExported=c("p_size") > 25),
        "Function": lambda: _node(t("customer"), "Function", cat("Function:C", "c_custkey"), c("c_name")),
        "Process": lambda: stored(spark, sf, "process", process),
        "Community": lambda: _node(t("customer").select("c_mktsegment").distinct(), "Community", cat("comm_", "c_mktsegment"), c("c_mktsegment")),
        "Route": lambda: _node(t("orders").select("o_orderstatus", "o_orderpriority").distinct(), "Route", F.concat(F.lit("Route:"), c("o_orderstatus"), F.lit(" /"), c("o_orderpriority")), cat("/", "o_orderpriority"), method=c("o_orderstatus")),
        "File": lambda: _node(t("documents"), "File", cat("File:", "doc_id"), c("source")),
    }
    out = None
    for label, make in made.items():
        if labels is None or label in labels:
            out = make() if out is None else out.union(make())
    return out


def edges(spark: SparkSession, sf: str, types: set[str] | None = None) -> DataFrame:
    t = lambda n: table(spark, sf, n)
    c, cat = F.col, lambda p, n: F.concat(F.lit(p), F.col(n).cast("string"))

    def edge(df: DataFrame, type_: str, src: Column, dst: Column, confidence: Column = F.lit(1.0), reason: Column = F.lit("fixture"), step: Column = F.lit(0), order: Column = F.lit(0)) -> DataFrame:
        return df.select(src.alias("sourceId"), dst.alias("targetId"), F.lit(type_).alias("type"), confidence.cast("double").alias("confidence"), reason.alias("reason"), step.cast("int").alias("step"), order.cast("long").alias("emit_ord"))

    made = {
        "CONTAINS": lambda: edge(t("nation").join(F.broadcast(t("region")), c("n_regionkey") == c("r_regionkey")), "CONTAINS", cat("Folder:", "r_name"), cat("Interface:", "n_name")),
        "IMPLEMENTS": lambda: edge(t("supplier").join(F.broadcast(t("nation")), c("s_nationkey") == c("n_nationkey")), "IMPLEMENTS", cat("Class:S", "s_suppkey"), cat("Interface:", "n_name")),
        "HAS_METHOD": lambda: edge(stored(spark, sf, "has_method", lambda: t("lineitem").select("l_suppkey", "l_partkey").distinct()), "HAS_METHOD", cat("Class:S", "l_suppkey"), cat("Method:P", "l_partkey")),
        "CALLS": lambda: edge(calls(spark, sf), "CALLS", cat("Method:P", "src"), cat("Method:P", "dst"), c("confidence"), F.when(c("verified") == 1, "LSP: fixture").otherwise("fixture"), order=c("emit_ord")),
        "STEP_IN_PROCESS": lambda: edge(steps(spark, sf), "STEP_IN_PROCESS", cat("Method:P", "l_partkey"), cat("proc_", "l_orderkey"), step=c("step")),
        "MEMBER_OF": lambda: edge(t("customer"), "MEMBER_OF", cat("Function:C", "c_custkey"), cat("comm_", "c_mktsegment")),
    }
    out = None
    for kind, make in made.items():
        if types is None or kind in types:
            out = make() if out is None else out.union(make())
    return out


def graph(spark: SparkSession, sf: str, labels: set[str] | None = None, types: set[str] | None = None) -> Graph:
    return Graph(nodes(spark, sf, labels), edges(spark, sf, types))


SQL = """
steps AS (SELECT l_orderkey, l_partkey, l_suppkey, l_discount, l_returnflag,
    row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS step FROM lineitem),
calls AS (SELECT a.l_partkey AS src, b.l_partkey AS dst, round(max(1.0 - 5 * b.l_discount), 6) AS confidence,
    max(CASE WHEN b.l_returnflag = 'R' THEN 1 ELSE 0 END) AS verified, min(a.l_orderkey * 100 + a.step) AS emit_ord
  FROM steps a JOIN steps b ON a.l_orderkey = b.l_orderkey AND b.step = a.step + 1 WHERE a.l_partkey <> b.l_partkey GROUP BY 1, 2),
ends AS (SELECT l_orderkey, arg_min(l_partkey, step) AS first, arg_max(l_partkey, step) AS last FROM steps GROUP BY 1),
nodes AS (
  SELECT 'Folder:' || r_name AS id, 'Folder' AS label, r_name AS name, NULL::VARCHAR AS filePath, NULL::BIGINT AS startLine, NULL::BIGINT AS endLine, NULL::BOOLEAN AS isExported, NULL::VARCHAR AS method, NULL::VARCHAR AS entryPointId, NULL::VARCHAR AS terminalId FROM region
  UNION ALL SELECT 'Interface:' || n_name, 'Interface', n_name, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM nation
  UNION ALL SELECT 'Class:S' || s_suppkey, 'Class', s_name, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM supplier
  UNION ALL SELECT 'Method:P' || p_partkey, 'Method', p_name, p_brand, p_partkey * 10, p_partkey * 10 + p_size, p_size > 25, NULL, NULL, NULL FROM part
  UNION ALL SELECT 'Function:C' || c_custkey, 'Function', c_name, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM customer
  UNION ALL SELECT 'proc_' || o_orderkey, 'Process', o_orderpriority, NULL, NULL, NULL, NULL, NULL, 'Method:P' || first, 'Method:P' || last FROM orders LEFT JOIN ends ON o_orderkey = l_orderkey
  UNION ALL SELECT DISTINCT 'comm_' || c_mktsegment, 'Community', c_mktsegment, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM customer
  UNION ALL SELECT DISTINCT 'Route:' || o_orderstatus || ' /' || o_orderpriority, 'Route', '/' || o_orderpriority, NULL, NULL, NULL, NULL, o_orderstatus, NULL, NULL FROM orders
  UNION ALL SELECT 'File:' || doc_id, 'File', source, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM documents),
edges AS (
  SELECT 'Folder:' || r_name AS sourceId, 'Interface:' || n_name AS targetId, 'CONTAINS' AS type, 1.0::DOUBLE AS confidence, 'fixture' AS reason, 0::BIGINT AS step, 0::BIGINT AS emit_ord FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT 'Class:S' || s_suppkey, 'Interface:' || n_name, 'IMPLEMENTS', 1.0, 'fixture', 0, 0 FROM supplier JOIN nation ON s_nationkey = n_nationkey
  UNION ALL SELECT DISTINCT 'Class:S' || l_suppkey, 'Method:P' || l_partkey, 'HAS_METHOD', 1.0, 'fixture', 0, 0 FROM lineitem
  UNION ALL SELECT 'Method:P' || src, 'Method:P' || dst, 'CALLS', confidence, CASE WHEN verified = 1 THEN 'LSP: fixture' ELSE 'fixture' END, 0, emit_ord FROM calls
  UNION ALL SELECT 'Method:P' || l_partkey, 'proc_' || l_orderkey, 'STEP_IN_PROCESS', 1.0, 'fixture', step, 0 FROM steps
  UNION ALL SELECT 'Function:C' || c_custkey, 'comm_' || c_mktsegment, 'MEMBER_OF', 1.0, 'fixture', 0, 0 FROM customer)
"""


def sql(body: str, ctes: str = "", recursive: bool = False) -> str:
    """An oracle over the fixture graph."""
    return f"WITH {'RECURSIVE ' if recursive else ''}{SQL.strip()}{',' + ctes if ctes else ''}\n{body}"
