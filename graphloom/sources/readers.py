"""Readers: repositories, graph documents, rule registries, configuration keys, workflow documents, call-hierarchy exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema
from ..operators.graph import Graph
from ..operators.structure import lines

#: Files above this size are not read as sources.
MAX_BYTES = 512 * 1024


def repository(spark: SparkSession, root: str, glob: str = "*", max_bytes: int = MAX_BYTES) -> DataFrame:
    """path (below root), size, content as text of each file, read by Spark wherever root is."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root).filter(F.col("length") <= max_bytes)
    base = "file:" + root.rstrip("/") + "/" if root.startswith("/") else root.rstrip("/") + "/"
    return raw.select(F.replace("path", F.lit(base), F.lit("")).alias("path"), F.col("length").alias("size"), F.decode("content", "UTF-8").alias("content"))


def ignored(files: DataFrame, rules: DataFrame) -> DataFrame:
    """files (path) that hold no rule's pattern. Rules are few; they become one predicate."""
    cond = F.lit(False)
    for r in rules.select("pattern").collect():
        cond |= F.col("path").contains(r["pattern"])
    return files.filter(~cond)


NODE_DOC = T.StructType([T.StructField("id", T.StringType()), T.StructField("label", T.StringType()), T.StructField("properties", T.StructType([f for f in schema.NODES.fields if f.name not in ("id", "label")]))])
EDGE_DOC = T.StructType([f for f in schema.EDGES.fields if f.name != "emit_ord"])
DOCUMENT = T.StructType(
    [
        T.StructField("repoPath", T.StringType()),
        T.StructField("indexedAt", T.StringType()),
        T.StructField("lspEnriched", T.BooleanType()),
        T.StructField("nodes", T.ArrayType(NODE_DOC)),
        T.StructField("relationships", T.ArrayType(EDGE_DOC)),
    ]
)


def graph_document(spark: SparkSession, path: str) -> Graph:
    """A graph from a JSON document with nodes and relationships."""
    doc = spark.read.schema(DOCUMENT).json(path, multiLine=True)
    return _graph(doc.select(F.explode("nodes").alias("n")).select("n.*"), doc.select(F.posexplode("relationships").alias("emit_ord", "r")).select("r.*", F.col("emit_ord").cast("long").alias("emit_ord")))


def _graph(nodes: DataFrame, edges: DataFrame) -> Graph:
    return Graph(nodes.select("id", "label", "properties.*"), edges)


def graph_document_rows(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges as JSON lines."""
    props = [c for c in nodes.columns if c not in ("id", "label")]
    return nodes.select(F.to_json(F.struct("id", "label", F.struct(*props).alias("properties"))).alias("json")), edges.select(F.to_json(F.struct(*edges.columns)).alias("json"))


def read_documents(nodes: DataFrame, edges: DataFrame) -> Graph:
    """A graph from JSON lines."""
    return _graph(nodes.select(F.from_json("json", NODE_DOC).alias("n")).select("n.*"), edges.select(F.from_json("json", schema.EDGES).alias("e")).select("e.*"))


def with_defaults(nodes: DataFrame) -> DataFrame:
    """What a typed client shows for nulls."""
    return nodes.withColumns({"startLine": F.coalesce("startLine", F.lit(1)), "endLine": F.coalesce("endLine", F.lit(1)), "method": F.coalesce("method", F.lit("GET"))})


def edge_scan(edges: DataFrame, types: list[str] | None = None) -> DataFrame:
    """Edges with a confidence: none, or 0, reads as 1; no step reads as 0."""
    e = edges.filter(F.col("type").isin(types)) if types else edges
    return e.withColumns({"confidence": F.when(F.col("confidence").isNull() | (F.col("confidence") == 0), 1.0).otherwise(F.col("confidence")), "step": F.coalesce("step", F.lit(0))})


RULE = T.StructType([T.StructField(n, T.StringType()) for n in ("id", "language", "category", "pattern", "description")])


def registry(spark: SparkSession, path: str) -> DataFrame:
    """boundary, rule_ord, id, language, category, pattern, description from a registry document."""
    doc = spark.read.schema(T.StructType([T.StructField("ingress", T.ArrayType(RULE)), T.StructField("egress", T.ArrayType(RULE))])).json(path, multiLine=True)
    part = lambda b: doc.select(F.lit(b).alias("boundary"), F.posexplode(b).alias("rule_ord", "r")).select("boundary", "rule_ord", "r.*")
    return part("ingress").union(part("egress"))


def config_keys(files: DataFrame) -> DataFrame:
    """path, name: keys, never values, of application*.properties and application*.yml files."""
    base = F.element_at(F.split("path", "/"), -1)
    props = lines(files.filter(base.rlike(r"^application.*\.properties$"))).filter(~F.trim("text").rlike(r"^[#!]") & F.col("text").rlike(r"[=:]"))
    out = props.select("path", F.trim(F.regexp_extract("text", r"^\s*([^=:\s]+)\s*[=:]", 1)).alias("name"))
    y = lines(files.filter(base.rlike(r"^application.*\.ya?ml$"))).filter(F.col("text").rlike(r"^\s*[\w.-]+\s*:") & ~F.trim("text").startswith("#"))
    y = y.select("path", "line", F.length(F.regexp_extract("text", r"^(\s*)", 1)).alias("indent"), F.regexp_extract("text", r"^\s*([\w.-]+)\s*:", 1).alias("key"), (F.trim(F.regexp_extract("text", r":(.*)$", 1)) != "").alias("leaf"))
    rows = y.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("line", "indent", "key", "leaf"))).alias("ks"))
    # the stack of open keys, folded over the file
    step = lambda acc, k: F.concat(F.filter(acc, lambda o: o["indent"] < k["indent"]), F.array(F.struct(k["indent"].alias("indent"), k["key"].alias("key"))))
    empty = F.array().cast("array<struct<indent:int,key:string>>")
    stacked = rows.select("path", F.explode(F.transform("ks", lambda k, i: F.struct(k["leaf"].alias("leaf"), F.aggregate(F.slice("ks", 1, i + 1), empty, step).alias("s")))).alias("x"))
    return out.union(stacked.filter("x.leaf").select("path", F.array_join(F.transform("x.s", lambda o: o["key"]), ".").alias("name")))


def auto_configurations(files: DataFrame) -> DataFrame:
    """path, class of auto-configuration metadata: imports files and factories files with continued lines."""
    imports = lines(files.filter(F.col("path").endswith(".AutoConfiguration.imports"))).select("path", F.trim("text").alias("class")).filter("class <> '' and not startswith(class, '#')")
    fact = files.filter(F.col("path").endswith("spring.factories")).select("path", F.regexp_replace("content", r"\\\r?\n\s*", "").alias("content"))
    key = "org.springframework.boot.autoconfigure.EnableAutoConfiguration"
    hit = lines(fact).filter(F.col("text").startswith(key)).select("path", F.explode(F.split(F.regexp_extract("text", r"=(.*)$", 1), ",")).alias("c"))
    return hit.select("path", F.trim("c").alias("class")).filter("class <> ''").union(imports)


WORKFLOW_STEP = "struct<id:string,name:string,role:string,filePath:string,type:string>"
WORKFLOWS = f"project string, totalWorkflows int, workflows array<struct<id:string,title:string,ingress:struct<id:string,name:string,role:string,filePath:string,handlerName:string>,controllers:array<{WORKFLOW_STEP}>,services:array<{WORKFLOW_STEP}>,egressSinks:array<{WORKFLOW_STEP}>,totalSteps:int>>"


def workflows(spark: SparkSession, path: str) -> DataFrame:
    """One row for each workflow of a workflow document."""
    return spark.read.schema(WORKFLOWS).json(path, multiLine=True).select("project", F.explode("workflows").alias("w")).select("project", "w.*")


def call_hierarchy(spark: SparkSession, path: str) -> DataFrame:
    """Rows that a language server exported: callerId, callerFile, calleeName, calleeFile, calleeLine."""
    return spark.read.schema("callerId string, callerFile string, calleeName string, calleeFile string, calleeLine long").json(path)


def store(spark: SparkSession, root: str) -> Graph:
    """A graph store: nodes by label, edges by type; a filter on those reads their folders only."""
    return Graph(spark.read.parquet(f"{root}/nodes"), spark.read.parquet(f"{root}/edges"))


def catalog(g: Graph) -> DataFrame:
    return g.nodes.groupBy(F.col("label").alias("name")).agg(F.count("*").alias("n"))


def latest(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    return rows.withColumn("__rn", F.row_number().over(W.partitionBy(*key).orderBy(F.desc(order)))).filter("__rn = 1").drop("__rn")
