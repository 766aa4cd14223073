"""Reachability: breadth-first closures with depth and first-seen order, bounded traversals, strongly connected components."""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import settle, tabled


#: Edges that every worker may hold as a table of its own (about 30 MB); larger graphs are searched by rounds of joins.
SMALL_EDGES = 100_000


def _searched(e: DataFrame, s: DataFrame, max_depth: int, until: str | None) -> DataFrame:
    """reach() over a graph that fits every worker: starts are dealt out, each is searched level by level."""
    kind = dict(e.dtypes)["src"]
    rows = e.collect()  # SMALL_EDGES at most, as counted
    table: dict = {}
    for r in rows:
        table.setdefault(r["src"], []).append((r["dst"], r["ord"]))
    shared = e.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ways = shared.value
        for pdf in batches:
            out: list = []
            for start in pdf["start"]:
                seen: set = set()
                level = {start: ((), None)}
                for depth in range(1, max_depth + 1):
                    new: dict = {}
                    for node, (path, via) in level.items():
                        for dst, ord_ in ways.get(node, ()):
                            if dst not in seen:
                                told = ((*path, ord_), dst if via is None else via)
                                if dst not in new or told < new[dst]:
                                    new[dst] = told
                    out += [(start, node, depth, via, list(path)) for node, (path, via) in new.items()]
                    seen |= new.keys()
                    level = new
                    if not new or (until is not None and start in new):
                        break
                if len(out) > 50_000:
                    yield pd.DataFrame(out, columns=["start", "node", "depth", "via", "path"])
                    out = []
            yield pd.DataFrame(out, columns=["start", "node", "depth", "via", "path"])

    return s.select("start").repartition("start").mapInPandas(run, f"start {kind}, node {kind}, depth int, via {kind}, path array<string>")


def reach(edges: DataFrame, starts: DataFrame | None = None, max_depth: int = 50, order: str | None = None, until: str | None = None, small_edges: int = SMALL_EDGES) -> DataFrame:
    """start, node, depth, via (the first hop), path (ordinals of the first-seen way): every node reachable from each start.

    edges: src, dst and, for the first-seen order, an ordinal column. Semi-naive: each round joins only the newest nodes, and
    drops what the start has seen already. The start itself counts only when a cycle leads back to it. Rounds are kept as they
    are and put together at the end. Graphs of up to small_edges edges are searched without rounds. until: starts that have reached this
    column's node go no further (only "start" can be asked for)."""
    e = edges.select("src", "dst", (F.lpad(F.col(order).cast("string"), 6, "0") if order else F.col("dst").cast("string")).alias("ord")).distinct()
    s = e.select(F.col("src").alias("start")).distinct() if starts is None else starts.select("start").distinct()
    s = s.filter("start is not null")
    if dict(s.dtypes)["start"] == dict(e.dtypes)["src"] and e.limit(small_edges + 1).count() <= small_edges:
        return _searched(e, s, max_depth, until)
    first = lambda d: d.groupBy("start", "node").agg(F.min(F.struct("path", "via")).alias("m")).select("start", "node", "m.via", "m.path")
    new = first(s.join(e, F.col("start") == F.col("src")).select("start", F.col("dst").alias("node"), F.col("dst").alias("via"), F.array("ord").alias("path"))).withColumn("depth", F.lit(1))
    new = settle(new)
    rounds = [new]
    for depth in range(2, max_depth + 1):
        if until is not None:
            new = new.join(new.filter(F.col("node") == F.col(until)).select("start"), "start", "left_anti")
        step = new.join(e, F.col("node") == F.col("src")).select("start", F.col("dst").alias("node"), "via", F.concat("path", F.array("ord")).alias("path"))
        seen = reduce(DataFrame.unionByName, [r.select("start", "node") for r in rounds])
        new = settle(first(step).join(seen, ["start", "node"], "left_anti").withColumn("depth", F.lit(depth)))
        if new.isEmpty():
            break
        rounds.append(new)
    return reduce(DataFrame.unionByName, rounds).select("start", "node", "depth", "via", "path")


def tree(edges: DataFrame, root: str, max_depth: int = 3) -> DataFrame:
    """node, depth of the calls below root; each node once, where it is met first."""
    starts = edges.sparkSession.createDataFrame([(root,)], "start string")
    return reach(edges, starts, max_depth).filter(F.col("node") != root).select("node", "depth")


def spread_least(edges: DataFrame, nodes: DataFrame, value: str, rounds: int = 1_000_000) -> DataFrame:
    """nodes with value: the smallest value of all nodes that lead to it along edges (src, dst), its own included. Only nodes whose
    value fell are heard in the next round."""
    known = settle(nodes.select("node", value))
    fresh = known
    for _ in range(rounds):
        told = edges.join(fresh.select(F.col("node").alias("src"), F.col(value).alias("new")), "src").groupBy(F.col("dst").alias("node")).agg(F.min("new").alias("new"))
        now = settle(known.join(told, "node", "left").select("node", F.least(value, "new").alias(value), (F.col("new") < F.col(value)).alias("fell")))
        known, fresh = now.select("node", value), now.filter("fell").select("node", value)
        if fresh.isEmpty():
            break
    return known


def strong_labels(src: np.ndarray, dst: np.ndarray, n: int) -> np.ndarray:
    """The number of each node's strong component, for nodes 0 to n - 1, by Gabow's path method over flat arrays."""
    by = np.argsort(src, kind="stable")
    to = array("i", dst[by].astype(np.int32).tobytes())
    ends = np.searchsorted(src[by], np.arange(n + 1))
    ways, last = ends[:-1].tolist(), ends[1:].tolist()
    number, label = [0] * n, [0] * n  # order of discovery from 1; -1 once the component is told
    told = count = 0
    path: list[int] = []
    bounds: list[int] = []
    for root in range(n):
        if number[root]:
            continue
        count += 1
        number[root] = count
        path.append(root)
        bounds.append(count)
        trail = [root]
        while trail:
            v = trail[-1]
            i = ways[v]
            if i < last[v]:
                ways[v] = i + 1
                u = to[i]
                k = number[u]
                if not k:
                    count += 1
                    number[u] = count
                    path.append(u)
                    bounds.append(count)
                    trail.append(u)
                elif k > 0:  # still on the path: all since u are one
                    while bounds[-1] > k:
                        bounds.pop()
                continue
            trail.pop()
            if bounds[-1] == number[v]:
                bounds.pop()
                while True:
                    u = path.pop()
                    number[u], label[u] = -1, told
                    if u == v:
                        break
                told += 1
    return np.array(label, dtype=np.int64)


def _flat(batches: Iterator[pa.RecordBatch]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Sorted node names, and the ends of edges (src, dst) as places among them."""
    src, dst = [], []
    for b in batches:
        src.append(b.column(0))
        dst.append(b.column(1))
    if not src:
        return pa.array([]), np.zeros(0, np.int64), np.zeros(0, np.int64)
    ends = pa.chunked_array(src + dst).combine_chunks().dictionary_encode()
    ends = ends.combine_chunks() if isinstance(ends, pa.ChunkedArray) else ends
    order = pc.sort_indices(ends.dictionary)
    place = np.empty(len(order), np.int64)
    place[order.to_numpy()] = np.arange(len(order))
    both = place[ends.indices.to_numpy()]
    return ends.dictionary.take(order), both[: len(both) // 2], both[len(both) // 2 :]


def thinned(edges: DataFrame, chunks: int) -> DataFrame:
    """Fewer edges (src, dst) between the same nodes that lead from and to the same nodes: in each chunk of the edges a strong
    component becomes one ring, and what leads from one to another leads from first member to first member, once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, src, dst = _flat(batches)
        if not len(src):
            return
        label = strong_labels(src, dst, len(names))
        by = np.argsort(label, kind="stable")
        starts = np.flatnonzero(np.r_[True, label[by][1:] != label[by][:-1]])
        first = np.empty(int(label.max()) + 1, np.int64)
        first[label[by][starts]] = by[starts]
        nxt = np.r_[by[1:], by[:1]]
        ends = np.r_[starts[1:], len(by)] - 1
        nxt[ends] = by[starts]
        a, b = first[label[src]], first[label[dst]]
        between = np.unique(a[a != b] * len(names) + b[a != b])
        a, b = np.r_[by[by != nxt], between // len(names)], np.r_[nxt[by != nxt], between % len(names)]
        for i in range(0, len(a), 500_000):
            yield pa.RecordBatch.from_arrays([names.take(pa.array(x[i : i + 500_000])) for x in (a, b)], names=["src", "dst"])

    return tabled(edges.select("src", "dst").coalesce(chunks).mapInArrow(run, edges.select("src", "dst").schema))


#: Edges that a kernel of strong components takes: flat arrays of 8 bytes an edge, and the names of the nodes.
FLAT_EDGES = 5_000_000


def strongly_connected(edges: DataFrame, kernel_edges: int = FLAT_EDGES, tabled_already: bool = False) -> DataFrame:
    """node, scc (its smallest member), size, cyclic: nodes that reach each other, for every node of an edge (src, dst).

    A graph of more than kernel_edges edges is made thinner first, in chunks of so many edges, for as long as that takes away a
    third. While what is left has more, each round colours every node with the smallest node that leads to it; the nodes that lead
    back to their colour's name inside the colour are its component, and leave. Nodes without edges in or out leave first, as
    components of their own. What is left goes through one kernel. No closure is formed. tabled_already: edges are a table."""
    e = edges.select("src", "dst").filter("src is not null and dst is not null")
    e = e if tabled_already else tabled(e)
    loops = settle(e.filter("src = dst").select(F.col("src").alias("node")).distinct().withColumn("loop", F.lit(True)))
    left, found = e.filter("src <> dst"), []
    n = left.count()
    while n > kernel_edges > 0:
        thin = thinned(left, -(-n // kernel_edges))
        before, n, left = n, thin.count(), thin
        if n > 0.67 * before:
            break
    if n > kernel_edges:
        left = settle(left.distinct())
    every = settle(left.select(F.explode(F.array("src", "dst")).alias("node")).union(loops.select("node")).distinct())
    while n > kernel_edges:
        into, out = left.select(F.col("dst").alias("node")).distinct(), left.select(F.col("src").alias("node")).distinct()
        inner = settle(into.join(out, "node", "left_semi"))
        left = settle(left.join(inner.select(F.col("node").alias("src")), "src", "left_semi").join(inner.select(F.col("node").alias("dst")), "dst", "left_semi"))
        colour = spread_least(left, inner.withColumn("colour", F.col("node")), "colour")
        side = lambda k: colour.select(F.col("node").alias(k), F.col("colour").alias(f"c_{k}"))  # noqa: E731, B023
        same = settle(left.join(side("src"), "src").join(side("dst"), "dst").filter("c_src = c_dst").select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        roots = colour.withColumn("far", F.when(F.col("node") == F.col("colour"), 0).otherwise(1))
        back = spread_least(same, roots, "far").filter("far = 0").join(colour, "node").select("node", F.col("colour").alias("scc"))
        found.append(settle(back))
        left = settle(left.join(back.select(F.col("node").alias("src")), "src", "left_anti").join(back.select(F.col("node").alias("dst")), "dst", "left_anti"))
        n = left.count()
    kind = dict(e.dtypes)["src"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, src, dst = _flat(batches)
        if not len(src):
            return
        label = strong_labels(src, dst, len(names))
        least = np.full(int(label.max()) + 1, len(names))
        np.minimum.at(least, label, np.arange(len(names)))
        for i in range(0, len(names), 500_000):
            yield pa.RecordBatch.from_arrays([names.slice(i, 500_000), names.take(pa.array(least[label[i : i + 500_000]]))], names=["node", "scc"])

    found.append(left.coalesce(1).mapInArrow(run, f"node {kind}, scc {kind}"))
    known = settle(reduce(DataFrame.unionByName, found))
    named = every.join(known, "node", "left").select("node", F.coalesce("scc", "node").alias("scc"))
    sizes = named.groupBy("scc").agg(F.count("*").alias("size"))
    return named.join(sizes, "scc").join(loops, "node", "left").select("node", "scc", "size", ((F.col("size") > 1) | F.coalesce("loop", F.lit(False))).alias("cyclic"))


def bounded_search(edges: DataFrame, starts: DataFrame, max_depth: int = 4) -> DataFrame:
    """start, node, depth with the start at depth 0; shortest depth, at most max_depth hops."""
    below = reach(edges, starts, max_depth).filter("node <> start").select("start", "node", "depth")
    return starts.select("start", F.col("start").alias("node"), F.lit(0).alias("depth")).distinct().union(below)


def nearest_levels(paths: DataFrame, by: list[str]) -> DataFrame:
    """The rows of the smallest depth of each group."""
    return paths.withColumn("__m", F.min("depth").over(W.partitionBy(*by))).filter("depth = __m").drop("__m")
