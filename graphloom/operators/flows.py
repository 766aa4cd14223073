"""Execution flows: entry-point scores, path search, subsumption, selection, labels and statistics."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import settle
from .closure import SMALL_EDGES
from .conventions import definition_hint, language_of, name_multiplier, path_hint

MAX_DEPTH, MAX_BRANCHING, MIN_STEPS = 10, 4, 3
MAX_CANDIDATES = 200

#: Parts and ends of test and utility paths.
TEST_PARTS = ".test. .spec. __tests__/ __mocks__/ /test/ /tests/ /testing/ /test_ /src/test/ uitests/ .tests/ .test/ .integrationtests/ .unittests/ /testproject/ /tests/feature/ /tests/unit/ /spec/ /test/fixtures/".split()
TEST_ENDS = "_test.py _test.go tests.swift test.swift tests.cs test.cs test.php spec.php _spec.rb _test.rb".split()
UTILITY_PARTS = "/utils/ /util/ /helpers/ /helper/ /common/ /shared/ /lib/".split()
UTILITY_ENDS = "/utils.ts /utils.js /helpers.ts /helpers.js _utils.py _helpers.py".split()
def _path(c: Column) -> Column:
    return F.lower(F.replace(c, F.lit("\\"), F.lit("/")))


def _parts(c: Column, parts: list[str], ends: list[str]) -> Column:
    p, out = _path(c), F.lit(False)
    for x in parts:
        out |= p.contains(x)
    for x in ends:
        out |= p.endswith(x)
    return F.coalesce(out, F.lit(False))


def is_test_file(path: Column) -> Column:
    return _parts(path, TEST_PARTS, TEST_ENDS)


def is_utility_file(path: Column) -> Column:
    return _parts(path, UTILITY_PARTS, UTILITY_ENDS)


def entry_scores(nodes: DataFrame, calls: DataFrame, least: float = 0.5) -> DataFrame:
    """id, score of callables (id, name, filePath, isExported; language, else it follows from the path; definition, the text that
    shows decorators, if there is such a column): callees / (callers + 1), doubled if exported, by name, path and definition."""
    e = calls.filter(F.col("confidence") >= least)
    out = e.groupBy(F.col("sourceId").alias("id")).agg(F.count("*").alias("callees"))
    into = e.groupBy(F.col("targetId").alias("id")).agg(F.count("*").alias("callers"))
    x = nodes.filter(~is_test_file(F.col("filePath"))).join(out, "id").join(into, "id", "left")
    language = F.col("language") if "language" in nodes.columns else language_of(F.col("filePath"))
    score = F.col("callees") / (F.coalesce("callers", F.lit(0)) + 1) * F.when(F.col("isExported"), 2.0).otherwise(1.0) * name_multiplier(F.col("name"), language) * path_hint(F.col("filePath"))[0]
    if "definition" in nodes.columns:
        score = score * F.coalesce(definition_hint(language, F.col("definition"))["multiplier"], F.lit(1.0))
    return x.select("id", F.round(score, 9).alias("score"))


def candidates(scores: DataFrame, k: int = MAX_CANDIDATES) -> DataFrame:
    return scores.filter("score > 0").orderBy(F.desc("score"), "id").limit(k)


def enclosing(sites: DataFrame, callables: DataFrame, lines_per_bin: int = 64) -> DataFrame:
    """filePath, line, id: the smallest callable around each site. Bins of lines make the range join an equi join."""
    c = callables.withColumn("__bin", F.explode(F.sequence(F.floor(F.col("startLine") / lines_per_bin), F.floor(F.col("endLine") / lines_per_bin))))
    s = sites.select("filePath", "line").distinct().withColumn("__bin", F.floor(F.col("line") / lines_per_bin))
    hit = s.join(c.select("filePath", "__bin", "id", "startLine", "endLine"), ["filePath", "__bin"]).filter("startLine <= line and line <= endLine")
    return hit.groupBy("filePath", "line").agg(F.min_by("id", F.struct(F.col("endLine") - F.col("startLine"), F.col("id"))).alias("id"))


def walk(entry: str, callees: dict[str, list[str]], sinks: set[str], depth: int = MAX_DEPTH, branching: int = MAX_BRANCHING, least: int = MIN_STEPS) -> list[list[str]]:
    """Simple paths from an entry, depth first in the order of emission, at most 3 * branching of them. A path ends at a leaf,
    at the depth limit or where all callees are on it; a sink ends one as well, and the walk goes on."""
    found: list[list[str]] = []
    open_ = [[entry]]
    while open_ and len(found) < 3 * branching:
        path = open_.pop()
        ways = callees.get(path[-1], [])
        on = [w for w in ways[:branching] if w not in path] if ways and len(path) < depth else []
        ends = not on or (path[-1] in sinks)
        if ends and len(path) >= least:
            found.append(path)
        open_ += [[*path, w] for w in reversed(on)]
    return found


def trace(entries: DataFrame, adjacency: DataFrame, sinks: DataFrame, depth: int = MAX_DEPTH, branching: int = MAX_BRANCHING, least: int = MIN_STEPS, small_edges: int = SMALL_EDGES) -> DataFrame:
    """entry, trace_no, path: one walk for each entry. Only the first `branching` callees count; if those are small_edges at most,
    every worker holds them as a table, else each entry's neighbourhood is gathered by rounds of joins (branching ** depth
    bounds it only on paper: nodes are distinct)."""
    flagged = sinks.select("id").distinct().withColumn("sink", F.lit(True))
    near = adjacency.select("id", F.slice("neighbours", 1, branching).alias("neighbours"))
    kinds = "entry string, trace_no int, path array<string>"
    ways = settle(near.join(flagged, "id", "left"))
    if (ways.agg(F.sum(F.size("neighbours"))).first()[0] or 0) <= small_edges:
        rows = ways.collect()  # small_edges at most
        shared = ways.sparkSession.sparkContext.broadcast(({r.id: list(r.neighbours) for r in rows}, {r.id for r in rows if r.sink}))

        def go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            table, ends = shared.value
            for pdf in batches:
                found = [(e, k, p) for e in pdf["id"] for k, p in enumerate(walk(e, table, ends, depth, branching, least))]
                yield pd.DataFrame(found, columns=["entry", "trace_no", "path"])

        return entries.select("id").distinct().repartition("id").mapInPandas(go, kinds)
    near = ways.select("id", "neighbours")
    new = entries.select(F.col("id").alias("entry"), "id").distinct()
    rounds = [new]
    for _ in range(depth - 1):
        step = new.join(near, "id").select("entry", F.explode("neighbours").alias("id")).distinct()
        new = settle(step.join(reduce(DataFrame.union, rounds), ["entry", "id"], "left_anti"))
        if new.isEmpty():
            break
        rounds.append(new)
    told = reduce(DataFrame.union, rounds).join(near, "id", "left").join(flagged, "id", "left").select("entry", "id", "neighbours", F.coalesce("sink", F.lit(False)).alias("sink"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        entry = pdf["entry"].iloc[0]
        table = {r.id: list(r.neighbours) for r in pdf.itertuples() if r.neighbours is not None}
        paths = walk(entry, table, set(pdf.loc[pdf["sink"], "id"]), depth, branching, least)
        return pd.DataFrame({"entry": [entry] * len(paths), "trace_no": range(len(paths)), "path": paths})

    return told.groupBy("entry").applyInPandas(run, kinds)


def drop_contained(traces: DataFrame, sinks: DataFrame, key: str = "path") -> DataFrame:
    """Without the paths that are a contiguous part of a longer one; those that end in a sink stay. Paths meet on their first
    node, which the longer path must hold, so only such pairs are compared."""
    t = traces.select(key).distinct().withColumn("k", F.concat(F.lit("->"), F.array_join(key, "->"), F.lit("->")))
    s = sinks.select(F.col("id").alias("__s")).distinct()
    end = t.withColumn("last", F.element_at(key, -1)).join(s, F.col("last") == F.col("__s"), "left")
    bigger = t.select(F.col("k").alias("big"), F.size(key).alias("n"), F.explode(F.array_distinct(key)).alias("first"))
    gone = end.filter("__s is null").join(bigger, (F.element_at(key, 1) == F.col("first")) & (F.col("n") > F.size(key)) & F.col("big").contains(F.col("k"))).select("k").distinct()
    return end.join(gone, "k", "left_anti").select(key)


def longest_per_ends(traces: DataFrame, key: str = "path") -> DataFrame:
    w = W.partitionBy(F.element_at(key, 1), F.element_at(key, -1)).orderBy(F.desc(F.size(key)), F.array_join(key, "\0"))
    return traces.withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").drop("__rn")


def round_robin(traces: DataFrame, sinks: DataFrame, most: int, key: str = "path") -> DataFrame:
    """path, ord: in rounds over the terminals, best trace first (sink-ended, long, by key); at most `most`."""
    s = sinks.select(F.col("id").alias("__s")).distinct()
    x = traces.withColumn("terminal", F.element_at(key, -1)).join(s, F.col("terminal") == F.col("__s"), "left")
    rank = F.struct(F.when(F.col("__s").isNull(), 1).otherwise(0), -F.size(key), F.array_join(key, "\0"))
    x = x.withColumn("rank", rank).withColumn("round", F.row_number().over(W.partitionBy("terminal").orderBy("rank"))).withColumn("best", F.min("rank").over(W.partitionBy("terminal")))
    top = x.orderBy("round", "best").limit(most)
    return top.select(key, (F.row_number().over(W.orderBy("round", "best")) - 1).alias("ord"))


def process_cap(symbols: Column) -> Column:
    return F.greatest(F.lit(20), F.floor(symbols / 10 + 0.5)).cast("int")


def capitalised(c: Column) -> Column:
    return F.concat(F.upper(F.substring(c, 1, 1)), F.substring(c, 2, 10_000))


def sanitised(c: Column) -> Column:
    return F.lower(F.substring(F.regexp_replace(c, "[^a-zA-Z0-9]", "_"), 1, 20))


def processes(selected: DataFrame, names: DataFrame, membership: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Process rows (id, label, type, stepCount, communities, entryPointId, terminalId) and step rows (nodeId, processId, step)."""
    n = names.select(F.col("id").alias("__n"), "name")
    x = selected.select("path", "ord", F.element_at("path", 1).alias("entryPointId"), F.element_at("path", -1).alias("terminalId"))
    x = x.join(n, F.col("entryPointId") == F.col("__n"), "left").withColumnRenamed("name", "entryName").drop("__n")
    x = x.join(n, F.col("terminalId") == F.col("__n"), "left").withColumnRenamed("name", "endName").drop("__n")
    x = x.withColumn("id", F.concat(F.lit("proc_"), F.col("ord").cast("string"), F.lit("_"), sanitised(F.coalesce("entryName", F.lit("Unknown")))))
    steps = x.select("id", F.posexplode("path").alias("p", "nodeId")).select("nodeId", F.col("id").alias("processId"), (F.col("p") + 1).alias("step"))
    inside = steps.join(membership.select(F.col("id").alias("nodeId"), "community"), "nodeId", "left").groupBy(F.col("processId").alias("id")).agg(F.array_sort(F.collect_set("community")).alias("communities"))
    label = F.concat(capitalised(F.coalesce("entryName", F.lit("Unknown"))), F.lit(" → "), capitalised(F.coalesce("endName", F.lit("Unknown"))))
    rows = x.join(inside, "id").select("id", label.alias("label"), F.when(F.size("communities") > 1, "cross_community").otherwise("intra_community").alias("processType"), F.size("path").alias("stepCount"), "communities", "entryPointId", "terminalId")
    return rows, steps


def flow_stats(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count("*").alias("total"), F.count_if(F.col("processType") == "cross_community").alias("crossCommunity"), F.round(F.avg("stepCount"), 1).alias("avgSteps"))


def entry_links(sources: DataFrame, rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """sourceId, targetId, reason of ENTRY_POINT_OF: sources (id, handlerId, filePath) to processes that begin at the handler,
    else to those that begin in the source's file."""
    p = rows.select(F.col("id").alias("targetId"), "entryPointId").join(nodes.select(F.col("id").alias("entryPointId"), F.col("filePath").alias("entryFile")), "entryPointId", "left")
    exact = sources.join(p, F.col("handlerId") == F.col("entryPointId")).select(F.col("id").alias("sourceId"), "targetId", F.lit("handler").alias("reason"))
    rest = sources.join(exact.select(F.col("sourceId").alias("id")).distinct(), "id", "left_anti")
    near = rest.join(p, F.col("filePath") == F.col("entryFile")).select(F.col("id").alias("sourceId"), "targetId", F.lit("file").alias("reason"))
    return exact.union(near)

