"""The graph value and its kernel operations (first write wins, removal, adjacency, degree)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import settle


@dataclass(frozen=True)
class Graph:
    """Node rows (id, label, ...) and edge rows (sourceId, targetId, type, confidence, reason, step, emit_ord)."""

    nodes: DataFrame
    edges: DataFrame

    def of_type(self, *types: str) -> DataFrame:
        return self.edges.filter(F.col("type").isin(*types))

    def labelled(self, *labels: str) -> DataFrame:
        return self.nodes.filter(F.col("label").isin(*labels))


def first_write_wins(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in the order of writing."""
    return rows.withColumn("__rn", F.row_number().over(W.partitionBy(*key).orderBy(*order))).filter("__rn = 1").drop("__rn")


def remove_nodes(g: Graph, ids: DataFrame) -> Graph:
    """Without the nodes of ids (id) and every edge that touches one."""
    gone = ids.select(F.col("id").alias("__gone")).distinct()
    nodes = g.nodes.join(gone, F.col("id") == F.col("__gone"), "left_anti")
    edges = g.edges.join(gone, F.col("sourceId") == F.col("__gone"), "left_anti").join(gone, F.col("targetId") == F.col("__gone"), "left_anti")
    return Graph(nodes, edges)


def remove_files(g: Graph, files: DataFrame, keep_labels: tuple[str, ...] = ("Community", "Process")) -> Graph:
    """Without the nodes of these files (filePath) and their edges; overlays stay."""
    ids = g.nodes.filter(~F.col("label").isin(*keep_labels)).join(files.select("filePath").distinct(), "filePath", "left_semi").select("id")
    return remove_nodes(g, ids)


def adjacency(edges: DataFrame, least: float = 0.5, reverse: bool = False) -> DataFrame:
    """id, neighbours in the order of emission; edges below `least` are ignored."""
    a, b = ("targetId", "sourceId") if reverse else ("sourceId", "targetId")
    kept = edges.filter(F.col("confidence") >= least)
    return kept.groupBy(F.col(a).alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("emit_ord", F.col(b).alias("n")))), lambda x: x["n"]).alias("neighbours"))


def degrees(edges: DataFrame) -> DataFrame:
    """id, in_degree, out_degree, degree, in one shuffle."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("sourceId").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("targetId").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e"))
    return ends.groupBy("e.id").agg(F.sum("e.i").alias("in_degree"), F.sum("e.o").alias("out_degree"), F.count("*").alias("degree"))


def simple_undirected(edges: DataFrame) -> DataFrame:
    """a < b: no loops, no direction, no repeats."""
    return edges.select(F.least("sourceId", "targetId").alias("a"), F.greatest("sourceId", "targetId").alias("b")).filter("a <> b").distinct()


def csr(pairs: DataFrame) -> DataFrame:
    """id, neighbours (sorted), offset: compressed sparse rows of undirected pairs (a, b). The running sum is taken over ranges."""
    both = pairs.select(F.col("a").alias("id"), F.col("b").alias("n")).union(pairs.select(F.col("b").alias("id"), F.col("a").alias("n")))
    rows = both.groupBy("id").agg(F.sort_array(F.collect_set("n")).alias("neighbours"))
    return running_offset(rows, "id", F.size("neighbours"), "offset")


def running_offset(rows: DataFrame, key: str, size, name: str) -> DataFrame:
    """The sum of the sizes of all rows before this one in the order of key: rows are dealt out by ranges of keys, sums run inside
    each range, and the ranges' totals (one row each) run over all. The ranges are settled, so both see the same."""
    ranged = settle(rows.withColumn("__size", size.cast("long")).repartitionByRange(key).withColumn("__part", F.spark_partition_id()))
    sums = ranged.groupBy("__part").agg(F.sum("__size").alias("__sum"))
    before = sums.select("__part", F.coalesce(F.sum("__sum").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    inside = F.coalesce(F.sum("__size").over(W.partitionBy("__part").orderBy(key).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return ranged.join(before, "__part").withColumn(name, F.col("__before") + inside).drop("__size", "__part", "__before")
