"""Compiler-verified enrichment: exported call-hierarchy rows replace heuristic edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .graph import Graph

#: Extensions of languages that have a server.
LANGUAGES = {".java": "java", ".kt": "kotlin", ".py": "python", ".ts": "typescript", ".tsx": "typescript", ".cs": "csharp", ".go": "go", ".rs": "rust", ".cpp": "cpp"}


def language_of(path: Column) -> Column:
    out = F.when(F.lit(False), F.lit(""))
    for ext, name in LANGUAGES.items():
        out = out.when(path.endswith(ext), name)
    return out


def worth_asking(callables: DataFrame) -> DataFrame:
    """Without accessors: get and set callables of a line or two whose name no other has."""
    n = F.count("*").over(W.partitionBy("name"))
    x = callables.withColumn("n", n)
    skip = (F.coalesce("endLine", "startLine", F.lit(1)) - F.coalesce("startLine", F.lit(1)) <= 1) & (F.col("n") <= 1) & (F.col("name").startswith("get") | F.col("name").startswith("set"))
    return x.filter(~F.coalesce(skip, F.lit(False))).drop("n")


def implementation_edges(found: DataFrame, nodes: DataFrame) -> DataFrame:
    """IMPLEMENTS at 1.0 from every class in a located file (interfaceId, file)."""
    return found.join(nodes.filter(F.col("label").isin("Class", "Struct")).select("id", F.col("filePath").alias("file")), "file").select(F.col("id").alias("sourceId"), F.col("interfaceId").alias("targetId"), F.lit(1.0).alias("confidence")).distinct()


def locate(calls: DataFrame, nodes: DataFrame, order: str = "id") -> DataFrame:
    """caller, callee, file: the first symbol of the file with the called name; calls to oneself are left out."""
    simple = F.trim(F.split("calleeName", r"\(")[0])
    n = nodes.filter(F.col("label").isin("Method", "Function", "Class", "Struct")).select(F.col("id").alias("callee"), F.col("name").alias("__name"), F.col("filePath").alias("calleeFile"), F.col(order).alias("__ord"))
    # the first of a name is the same for all who call it: symbols are cut before calls meet them
    first = n.groupBy("calleeFile", "__name").agg(F.min(F.struct("__ord", "callee"))["callee"].alias("callee"))
    x = calls.select("callerId", simple.alias("__name"), "calleeFile").join(first, ["calleeFile", "__name"]).filter("callee <> callerId")
    return x.groupBy("calleeFile", "__name", "callerId", "callee").agg(F.lit(1)).select(F.col("callerId").alias("caller"), "callee", F.col("calleeFile").alias("file"))


def enrich(g: Graph, calls: DataFrame) -> tuple[Graph, DataFrame]:
    """The graph with verified CALLS, and (calls, conflicts): heuristic CALLS of a caller into the same file as a verified
    target, but to another one, are pruned; the verified edge stands beside one to the same target."""
    sure = locate(calls, g.nodes)
    files = g.nodes.select(F.col("id").alias("targetId"), F.col("filePath").alias("__file"))
    weak = g.edges.filter("type = 'CALLS' and confidence < 1.0").join(files, "targetId")
    # some callee of the file is another one if the least or the largest is
    ends = sure.groupBy(F.col("caller").alias("sourceId"), F.col("file").alias("__file")).agg(F.min("callee").alias("lo"), F.max("callee").alias("hi"))
    wrong = weak.select("sourceId", "targetId", "__file").join(ends, ["sourceId", "__file"]).filter("targetId <> lo or targetId <> hi").select("sourceId", "targetId").distinct().withColumn("type", F.lit("CALLS")).withColumn("__weak", F.lit(True))
    kept = g.edges.withColumn("__weak", (F.col("confidence") < 1.0) & (F.col("type") == "CALLS")).join(wrong, ["sourceId", "targetId", "type", "__weak"], "left_anti").drop("__weak")
    new = sure.select(F.col("caller").alias("sourceId"), F.col("callee").alias("targetId"), F.lit("CALLS").alias("type"), F.lit(1.0).alias("confidence"), F.lit("LSP: call hierarchy").alias("reason"), F.lit(0).alias("step"), F.lit(0).cast("long").alias("emit_ord"))
    stats = sure.agg(F.count("*").alias("calls")).crossJoin(wrong.agg(F.count("*").alias("conflicts")))
    return Graph(g.nodes, kept.unionByName(new, allowMissingColumns=True)), stats
