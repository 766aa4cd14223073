"""The relational query surface: scans, patterns, joins, aggregates, order and mutation over a property graph."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .graph import Graph


def prefixed(df: DataFrame, p: str, cols: list[str] | None = None) -> DataFrame:
    return df.select(*(F.col(c).alias(p + c) for c in cols or df.columns))


def match_edge(g: Graph, types: list[str] | None = None, src: Column | None = None, dst: Column | None = None, cols: tuple[str, ...] = ("id", "label", "name")) -> DataFrame:
    """(a)-[r]->(b): edge columns with a_ and b_ node columns. Conditions on nodes are applied before the joins."""
    e = g.edges if types is None else g.of_type(*types)
    a, b = (g.nodes if c is None else g.nodes.filter(c) for c in (src, dst))
    return e.join(prefixed(a, "a_", list(cols)), F.col("sourceId") == F.col("a_id")).join(prefixed(b, "b_", list(cols)), F.col("targetId") == F.col("b_id"))


def hop(left: DataFrame, on: str, edges: DataFrame, p: str, reverse: bool = False) -> DataFrame:
    """One more edge from column `on`: adds p + 'id' (the other end)."""
    a, b = ("targetId", "sourceId") if reverse else ("sourceId", "targetId")
    return left.join(edges.select(F.col(a).alias(f"__{p}"), F.col(b).alias(f"{p}id")), F.col(on) == F.col(f"__{p}")).drop(f"__{p}")


def endpoints_exist(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges both of whose ends are nodes: two semi joins."""
    ids = nodes.select(F.col("id").alias("__id"))
    return edges.join(ids, F.col("sourceId") == F.col("__id"), "left_semi").join(ids, F.col("targetId") == F.col("__id"), "left_semi")


def dangling(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    ids = nodes.select(F.col("id").alias("__id"))
    return edges.join(ids, F.col("targetId") == F.col("__id"), "left_anti")


def verified(confidence: str = "confidence", reason: str = "reason") -> Column:
    """A compiler told of the edge."""
    return (F.col(confidence) >= 1.0) | F.coalesce(F.col(reason).contains("LSP:"), F.lit(False))


def precision(edges: DataFrame) -> DataFrame:
    """type, total, verified, heuristic."""
    v = F.coalesce(verified(), F.lit(False))
    return edges.groupBy("type").agg(F.count("*").alias("total"), F.sum(F.when(v, 1).otherwise(0)).alias("verified"), F.sum(F.when(v, 0).otherwise(1)).alias("heuristic"))


def top_k(df: DataFrame, by: list[Column], k: int) -> DataFrame:
    return df.orderBy(*by).limit(k)


def first_k(df: DataFrame, per: list[str], order: list, k: int) -> DataFrame:
    """The first k rows of each group; the rank is added as rn."""
    return df.withColumn("rn", F.row_number().over(W.partitionBy(*per).orderBy(*order))).filter(F.col("rn") <= k)


def first_calls(entries: DataFrame, owners: DataFrame, calls: DataFrame, k: int) -> DataFrame:
    """process, class, callee: the first k calls of each process's entry point (process, entryPointId), for each owner of that
    method. owners, calls: edges. Calls are cut to k and owners gathered by method before processes meet them, so only rows of
    the result are as many as it; a process that is told n times has each call n times among its first k."""
    told = F.col("__n").cast("int")
    p = entries.filter("entryPointId is not null").repartition("entryPointId").groupBy("entryPointId", "process").agg(F.count("*").alias("__n"))
    ranked = first_k(calls.select("sourceId", "targetId", "emit_ord"), ["sourceId"], ["emit_ord", "targetId"], k)
    first = ranked.groupBy(F.col("sourceId").alias("entryPointId")).agg(F.transform(F.array_sort(F.collect_list(F.struct("rn", "targetId"))), lambda x: x["targetId"]).alias("__callees"))
    held = owners.groupBy(F.col("targetId").alias("entryPointId"), F.col("sourceId").alias("class")).agg(F.count("*").alias("m")).groupBy("entryPointId").agg(F.collect_list(F.struct("class", "m")).alias("__owners"))
    x = p.join(first.join(held, "entryPointId"), "entryPointId").select("process", "__callees", "__n", F.explode("__owners").alias("o"))
    callees = F.slice(F.flatten(F.transform("__callees", lambda t: F.array_repeat(t, told * F.col("o.m").cast("int")))), 1, k)
    return x.select("process", F.col("o.class").alias("class"), F.explode(callees).alias("callee"))


def delete_edges(edges: DataFrame, types: list[str] | None = None, reasons: list[str] | None = None) -> DataFrame:
    """Edges that stay; a null reason never matches."""
    gone = F.lit(True)
    if types is not None:
        gone &= F.col("type").isin(types)
    if reasons is not None:
        gone &= F.coalesce(F.col("reason").isin(reasons), F.lit(False))
    return edges.filter(~gone)


def upsert(base: DataFrame, changes: DataFrame, key: list[str]) -> DataFrame:
    """changes win over base."""
    return base.join(changes.select(*key).distinct(), key, "left_anti").unionByName(changes, allowMissingColumns=True)


def insert_edges(g: Graph, pairs: DataFrame, type_: str, confidence: float = 1.0, reason: str = "") -> Graph:
    """Adds edges between existing nodes (sourceId, targetId); others are left out."""
    new = endpoints_exist(pairs, g.nodes).select("sourceId", "targetId", F.lit(type_).alias("type"), F.lit(confidence).alias("confidence"), F.lit(reason).alias("reason"), F.lit(0).alias("step"), F.lit(0).cast("long").alias("emit_ord"))
    return Graph(g.nodes, g.edges.unionByName(new, allowMissingColumns=True))


def stream(rows: DataFrame, batch: int = 1000) -> Iterator[list[Row]]:
    """The rows in order, batch by batch: the driver holds one partition, and what is not asked for is not computed."""
    got: list[Row] = []
    for row in rows.toLocalIterator(prefetchPartitions=False):
        got.append(row)
        if len(got) == batch:
            yield got
            got = []
    if got:
        yield got
