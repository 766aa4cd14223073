"""Incremental maintenance and change impact: content hashes, hash diffs, importer expansion, hunks, stale embeddings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .closure import reach


def content_hash(content: Column) -> Column:
    return F.sha2(content.cast("binary"), 256)


def hash_diff(current: DataFrame, stored: DataFrame) -> DataFrame:
    """path, state (added, changed, deleted, same) of (path, hash) tables."""
    a, b = current.select("path", F.col("hash").alias("now")), stored.select("path", F.col("hash").alias("was"))
    state = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "deleted").when(F.col("was") != F.col("now"), "changed").otherwise("same")
    return a.join(b, "path", "full_outer").select("path", state.alias("state"))


def chunk_key(files: DataFrame, by: str) -> DataFrame:
    """A key for each chunk: the hash of its sorted path:hash lines."""
    return files.groupBy(by).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "path", "hash"))), "\n").cast("binary"), 256).alias("chunk_key"))


def prune_cache(cache: DataFrame, used: DataFrame) -> DataFrame:
    return cache.join(used.select("hash").distinct(), "hash", "left_semi")


def importers(imports: DataFrame, changed: DataFrame, max_rounds: int = 10) -> DataFrame:
    """path, round: the changed files (round 0) and all that import them, directly or not. imports: source, target."""
    back = imports.select(F.col("target").alias("src"), F.col("source").alias("dst"))
    start = changed.select(F.col("path").alias("start"))
    found = reach(back, start, max_rounds).groupBy(F.col("node").alias("path")).agg(F.min("depth").alias("round"))
    return start.select(F.col("start").alias("path"), F.lit(0).alias("round")).union(found).groupBy("path").agg(F.min("round").alias("round"))


def coalesce_hunks(hunks: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Hunks that overlap or touch become one; lines count from 0 afterwards. Gaps and islands by a running maximum."""
    by = by or ["filePath"]
    w = W.partitionBy(*by).orderBy("startLine", "endLine")
    last = F.max("endLine").over(w.rowsBetween(W.unboundedPreceding, -1))
    marked = hunks.withColumn("__new", F.when(last.isNull() | (F.col("startLine") > last + 1), 1).otherwise(0)).withColumn("__isle", F.sum("__new").over(w))
    return marked.groupBy(*by, "__isle").agg((F.min("startLine") - 1).alias("startLine"), (F.max("endLine") - 1).alias("endLine")).drop("__isle")


def touched_symbols(hunks: DataFrame, symbols: DataFrame, lines_per_bin: int = 64) -> DataFrame:
    """Symbols (id, filePath, startLine, endLine) that overlap a hunk of their file: a range join by bins of lines."""
    bins = lambda d: d.withColumn("__bin", F.explode(F.sequence(F.floor(F.col("startLine") / lines_per_bin), F.floor(F.col("endLine") / lines_per_bin))))
    h = bins(hunks.filter("endLine >= startLine").select("filePath", "startLine", "endLine")).select("filePath", "__bin", F.col("startLine").alias("hs"), F.col("endLine").alias("he"))
    s = bins(symbols.filter("endLine >= startLine").select("id", "filePath", "startLine", "endLine"))
    return s.join(h, ["filePath", "__bin"]).filter("endLine >= hs and startLine <= he").select("id", "filePath", "startLine", "endLine").distinct()


def stale_embeddings(nodes: DataFrame, stored: DataFrame) -> DataFrame:
    """id, state (missing, stale, fresh) of (id, hash) tables."""
    w = stored.select("id", F.col("hash").alias("__was"))
    return nodes.join(w, "id", "left").select("id", F.when(F.col("__was").isNull(), "missing").when(F.col("__was") != F.col("hash"), "stale").otherwise("fresh").alias("state"))
