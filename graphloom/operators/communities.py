"""Communities: projection, deterministic modularity optimisation, labels, cohesion, modularity; import cycles."""

from __future__ import annotations

import pickle
import random
from collections import defaultdict, deque
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import settle, tabled
from .flows import capitalised
from .graph import Graph, degrees, simple_undirected

LABELS = ("Function", "Class", "Method", "Interface")
TYPES = ("CALLS", "EXTENDS", "IMPLEMENTS")
LARGE = 10_000
SEED = 0xC0DE
#: Edges that one kernel takes; larger components go through joins first.
KERNEL_EDGES = 1_000_000
#: Nodes that every worker may hold with their components (about 60 MB); of more, edges are joined.
HELD_NODES = 2_000_000
#: Folders that name nothing.
STOP_FOLDERS = ["src", "lib", "core", "utils", "common", "shared", "helpers"]


def projection(g: Graph, large: bool | None = None) -> DataFrame:
    """a < b: undirected simple edges between symbols. In large graphs weak edges and nodes of degree 1 are left out."""
    ids = g.labelled(*LABELS).select(F.col("id").alias("__id"))
    e = g.of_type(*TYPES)
    big = g.labelled(*LABELS).limit(LARGE + 1).count() > LARGE if large is None else large
    if big:
        e = e.filter("confidence >= 0.5")
    pairs = simple_undirected(_among(e, ids.filter("__id is not null")))
    if big:
        busy = degrees(pairs.select(F.col("a").alias("sourceId"), F.col("b").alias("targetId"))).filter("degree >= 2").select("id")
        pairs = pairs.join(busy, F.col("a") == F.col("id"), "left_semi").join(busy, F.col("b") == F.col("id"), "left_semi")
    return pairs


def _among(e: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges whose ends are both among the ids: looked up where every worker may hold these, else joined."""
    if ids.limit(HELD_NODES + 1).count() > HELD_NODES:
        return e.join(ids, F.col("sourceId") == F.col("__id"), "left_semi").join(ids, F.col("targetId") == F.col("__id"), "left_semi")
    names = pa.chunked_array(ids.toArrow()["__id"].chunks, pa.string()).combine_chunks()
    held = e.sparkSession.sparkContext.broadcast(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = list(batches)
        if rows:
            t = pa.Table.from_batches(rows)
            both = pc.and_(*(pc.is_in(t[k].cast(pa.string()), value_set=held.value) for k in ("sourceId", "targetId")))
            yield from t.filter(both).to_batches(max_chunksize=500_000)

    return e.select("sourceId", "targetId").mapInArrow(run, "sourceId string, targetId string")


def local_moves(edges: list[tuple[str, str, float]], resolution: float = 1.0, seed: int = SEED, total: float | None = None) -> dict[str, int]:
    """Seeded modularity optimisation of a weighted graph (a, b, weight; a = b is a node's inner weight): nodes move to the
    neighbouring community that gains most, then communities are merged into nodes, until nothing moves. The order is the
    sorted one, shuffled by the seed. total: twice the weight of the whole graph, of which these edges may be a part."""
    nodes = sorted({v for e in edges for v in e[:2]})
    at = {v: i for i, v in enumerate(nodes)}
    near: list[dict[int, float]] = [{} for _ in nodes]
    for a, b, w in edges:
        i, j = at[a], at[b]
        near[i][j] = near[i].get(j, 0) + w
        near[j][i] = near[j].get(i, 0) + w
    total = total or sum(sum(n.values()) for n in near)
    home = list(range(len(nodes)))
    rng = random.Random(seed)
    while total:
        weight = [sum(n.values()) for n in near]
        group = list(range(len(near)))
        load = weight[:]
        order = list(range(len(near)))
        rng.shuffle(order)
        # nodes wait in a queue; one that moves calls back its neighbours outside its new community
        queue, waits, any_move = deque(order), [True] * len(near), False
        while queue:
            v = queue.popleft()
            waits[v] = False
            here, own = group[v], weight[v]
            ties: dict[int, float] = {}
            for u, w in near[v].items():
                if u != v:
                    g = group[u]
                    ties[g] = ties.get(g, 0.0) + w
            load[here] -= own
            scale = resolution * own / total
            best, gain = here, ties.get(here, 0.0) - scale * load[here]
            for g, w in ties.items():
                new = w - scale * load[g]
                if new > gain + 1e-12 or (g < best and best != here and new > gain - 1e-12):
                    best, gain = g, new
            load[best] += own
            if best != here:
                group[v], any_move = best, True
                for u in near[v]:
                    if not waits[u] and group[u] != best:
                        waits[u] = True
                        queue.append(u)
        if not any_move:
            break
        names = {g: i for i, g in enumerate(sorted(set(group)))}
        home = [names[group[h]] for h in home]
        merged: list[dict[int, float]] = [{} for _ in names]
        for v, ns in enumerate(near):
            for u, w in ns.items():
                a, b = names[group[v]], names[group[u]]
                merged[a][b] = merged[a].get(b, 0) + w
        near = merged
    return {v: home[i] for v, i in at.items()}


def coarsened(edges: DataFrame, resolution: float, total: float) -> tuple[DataFrame, DataFrame]:
    """One level by joins: id, home; and the edges (a, b, weight) between homes. Each node prefers the neighbour whose community
    of one it would gain most by joining; nodes follow a preference only from a larger hash to a smaller one, so that
    preferences form stars and nobody moves away from what others move to."""
    both = edges.filter("a <> b").select("a", "b", "weight").union(edges.filter("a <> b").select("b", "a", "weight"))
    loops = edges.filter("a = b").select("a", (2 * F.col("weight")).alias("w"))
    load = settle(both.select("a", F.col("weight").alias("w")).union(loops).groupBy("a").agg(F.sum("w").alias("load")))
    gain = F.col("weight") - F.lit(resolution / total) * F.col("load") * F.col("other")
    ties = both.join(load, "a").join(load.select(F.col("a").alias("b"), F.col("load").alias("other")), "b")
    best = ties.filter(gain > 0).groupBy("a").agg(F.max_by("b", F.struct(gain, "b")).alias("to"))
    rank = lambda c: F.struct(F.xxhash64(c), F.col(c))
    moves = settle(best.filter(rank("to") < rank("a")))
    # who moves to a node that moves itself stays where it is
    moving = moves.select(F.col("a").alias("to")).withColumn("gone", F.lit(True))
    homes = settle(load.select("a").join(moves.join(moving, "to", "left").filter("gone is null").select("a", "to"), "a", "left").select(F.col("a").alias("id"), F.coalesce("to", "a").alias("home")))
    x = edges.join(homes.select(F.col("id").alias("a"), F.col("home").alias("x")), "a").join(homes.select(F.col("id").alias("b"), F.col("home").alias("y")), "b")
    return homes, settle(x.groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.sum("weight").alias("weight")))


#: Rows of both directions that the driver takes as one block, and those of a worker's block.
LOCAL_ROWS = 2_000_000
BLOCK_ROWS = 600_000


@dataclass(frozen=True)
class _Near:
    """The neighbours of nodes 0 to n - 1 in blocks: nodes, ends of their neighbours, neighbours, weights (None: all are 1). A
    block is here, or many are rows of a table."""

    n: int
    here: tuple | None = None
    table: DataFrame | None = None

    def each(self, f: Callable[..., tuple], *state) -> list[tuple]:
        """What f tells of each block, given state."""
        if self.here is not None:
            return [f(*self.here, *state)]
        shared = self.table.sparkSession.sparkContext.broadcast(state)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for block in _blocks(batches):
                yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(f(*block, *shared.value))], pa.binary())], names=["out"])

        told = [pickle.loads(x) for x in self.table.mapInArrow(run, "out binary").toArrow()["out"].to_pylist()]  # noqa: S301 - what run() wrote
        shared.destroy()
        return told


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        for row in b.to_pylist():
            weight = np.frombuffer(row["weight"], np.float64) if row["weight"] is not None else None
            yield np.frombuffer(row["nodes"], np.int32), np.frombuffer(row["ends"], np.int64), np.frombuffer(row["near"], np.int32), weight


def _block(a: np.ndarray, b: np.ndarray, weight: np.ndarray | None) -> tuple:
    by = np.argsort(a, kind="stable")
    nodes, ends = np.unique(a[by], return_index=True)
    return nodes.astype(np.int32), np.r_[ends, len(a)].astype(np.int64), b[by].astype(np.int32), None if weight is None else weight[by]


def _packed(rows: DataFrame, n: int, count: int) -> _Near:
    """rows: a, b (numbers, both directions) and, where they have one, weight."""
    weighted = "weight" in rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if sum(map(len, held)):
            t = pa.Table.from_batches(held)
            block = _block(*(t[k].to_numpy() for k in ("a", "b")), t["weight"].to_numpy() if weighted else None)
            yield pa.RecordBatch.from_arrays([pa.array([None if x is None else x.tobytes()], pa.binary()) for x in block], names=["nodes", "ends", "near", "weight"])

    return _Near(n, table=tabled(rows.repartition(-(-count // BLOCK_ROWS), "a").mapInArrow(run, "nodes binary, ends binary, near binary, weight binary")))


def _least_near(nodes: np.ndarray, ends: np.ndarray, near: np.ndarray, weight: np.ndarray | None, label: np.ndarray, group: np.ndarray | None) -> tuple:
    """The smallest label of each node's neighbours (in its group), where it is below its own."""
    told = label[near]
    if group is not None:
        told = np.where(group[near] == np.repeat(group[nodes], np.diff(ends)), told, len(label))
    least = np.minimum.reduceat(told, ends[:-1])
    less = least < label[nodes]
    return nodes[less], least[less]


def _parts(g: _Near, group: np.ndarray | None = None) -> np.ndarray:
    """The smallest member of each node's connected part (inside its group): names take over the smallest name next to any of
    their nodes, and chains of names are cut short."""
    label = np.arange(g.n, dtype=np.int32)
    while True:
        heard = g.each(_least_near, label, group)
        if not any(len(v) for v, _ in heard):
            return label
        new = label.copy()
        for nodes, least in heard:
            np.minimum.at(new, label[nodes], least)
            np.minimum.at(new, nodes, least)
        while (new[new] != new).any():
            new = new[new]
        label = new[label]


def _wishes(nodes: np.ndarray, ends: np.ndarray, near: np.ndarray, weight: np.ndarray | None, group: np.ndarray, load: np.ndarray, degree: np.ndarray, scale: np.ndarray) -> tuple:
    """Each node's best neighbouring group, where that gains, and the weight between nodes and their own groups over scale."""
    n = len(load)
    key = np.repeat(np.arange(len(nodes), dtype=np.int64), np.diff(ends)) * n + group[near]
    if weight is None:
        key.sort()
    else:
        by = np.argsort(key, kind="stable")
        key = key[by]
    cut = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    tie = np.diff(np.r_[cut, len(key)]).astype(float) if weight is None else np.add.reduceat(weight[by], cut)
    row, to = np.divmod(key[cut], n)
    here, own, by_load = group[nodes], degree[nodes], scale[nodes]
    mine = to == here[row]
    inner = np.zeros(len(nodes))
    inner[row[mine]] = tie[mine]
    gain = tie - by_load[row] * (load[to] - np.where(mine, own[row], 0.0))
    top = np.maximum.reduceat(gain, np.searchsorted(row, np.arange(len(nodes))))
    hit = np.flatnonzero(gain >= top[row] - 1e-12)
    best = to[hit[np.unique(row[hit], return_index=True)[1]]]
    moves = top > inner - by_load * (load[here] - own) + 1e-12
    return nodes[moves], best[moves].astype(np.int32), float((inner * by_load / own).sum())


def _settled(g: _Near, degree: np.ndarray, loops: np.ndarray, share: np.ndarray, seed: int, resolution: float) -> np.ndarray:
    """A group for each node, the best of the rounds. In each round a random half of the nodes that would gain by it move at once;
    of two single nodes only the larger moves. Rounds end when eight of them in turn have not raised the modularities (those of
    components, added up) by a millionth, and over a table, where rounds are dear, when three have not by a hundredth. share: 1
    over the weight of a node's component."""
    least, patience = (1e-6, 8) if g.table is None else (1e-2, 3)
    rng = np.random.default_rng(seed)
    group = best = np.arange(g.n, dtype=np.int32)
    scale, base = resolution * degree * share, float((loops * share).sum())
    most, mark, since = -np.inf, -np.inf, 0
    while True:
        load = np.bincount(group, weights=degree, minlength=g.n)
        single = np.bincount(group, minlength=g.n) == 1
        told = g.each(_wishes, group, load, degree, scale)
        by_group = np.zeros(g.n)
        by_group[group] = share
        q = base + sum(t[2] for t in told) / resolution - resolution * float((load * load * by_group * by_group).sum())
        since += 1
        if mark == -np.inf or q > mark + least * max(abs(mark), 1e-3):
            mark, since = q, 0
        if q > most:
            most, best = q, group
        wish = [np.concatenate([t[i] for t in told]) for i in (0, 1)]
        if since >= patience or not len(wish[0]):
            return best
        by = np.argsort(wish[0])
        nodes, to = wish[0][by], wish[1][by]
        go = (rng.random(len(nodes)) < 0.5) & ~(single[group[nodes]] & single[to] & (to > group[nodes]))
        group = group.copy()
        group[nodes[go]] = to[go]


def _between(nodes: np.ndarray, ends: np.ndarray, near: np.ndarray, weight: np.ndarray | None, home: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of groups (a * n + b) and the weights between them."""
    key, of = np.unique(np.repeat(home[nodes], np.diff(ends)).astype(np.int64) * n + home[near], return_inverse=True)
    return key, np.bincount(of, weights=weight, minlength=len(key)).astype(float)


def _merged(g: _Near, home: np.ndarray, n: int, local_rows: int) -> tuple[_Near, np.ndarray]:
    """The graph between n groups, and the weight inside each (both directions)."""
    inside = np.zeros(n)
    if g.here is not None:
        key, w = _between(*g.here, home, n)
    else:
        shared = g.table.sparkSession.sparkContext.broadcast(home)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for block in _blocks(batches):
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in _between(*block, shared.value, n)], names=["key", "weight"])

        rows = tabled(g.table.mapInArrow(run, "key long, weight double").groupBy("key").agg(F.sum("weight").alias("weight")))
        a, b = F.expr(f"cast(key div {n} as int)"), F.expr(f"cast(key % {n} as int)")
        rows = rows.select("key", a.alias("a"), b.alias("b"), "weight")
        count = rows.count()
        if count > local_rows:
            own = rows.filter("a = b").select("a", "weight").toArrow()  # one a group
            inside[own["a"].to_numpy()] = own["weight"].to_numpy()
            return _packed(rows.filter("a <> b").select("a", "b", "weight"), n, count), inside
        t = rows.select("key", "weight").toArrow()
        key, w = t["key"].to_numpy(), t["weight"].to_numpy()
    by = np.argsort(key)
    (a, b), w = np.divmod(key[by], n), w[by]
    inside[a[a == b]] = w[a == b]
    return _Near(n, here=_block(a[a != b], b[a != b], w[a != b])), inside


def _degree(nodes: np.ndarray, ends: np.ndarray, near: np.ndarray, weight: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    return nodes, np.diff(ends).astype(float) if weight is None else np.add.reduceat(weight, ends[:-1])


def _flat(pairs: DataFrame, names: pa.Array, resolution: float, seed: int, count: int, local_rows: int) -> DataFrame:
    """detect() of a graph whose nodes (names, sorted) the driver and every worker hold as numbers: groups, loads and labels are
    arrays of theirs, edges stay in blocks of neighbours, and rounds go over these without a shuffle."""
    sc, n = pairs.sparkSession.sparkContext, len(names)
    held = sc.broadcast(names)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = list(batches)
        if rows:
            t = pa.Table.from_batches(rows)
            a, b = (pc.index_in(t[k].cast(pa.string()), value_set=held.value).combine_chunks() for k in ("a", "b"))
            for x, y in ((a, b), (b, a)):
                for i in range(0, len(x), 500_000):
                    yield pa.RecordBatch.from_arrays([x.slice(i, 500_000), y.slice(i, 500_000)], names=["a", "b"])

    g = base = _packed(pairs.select("a", "b").mapInArrow(code, "a int, b int"), n, 2 * count)
    component = _parts(g)
    degree, loops, home, at = np.zeros(n), np.zeros(n), np.arange(n), component
    for nodes, d in g.each(_degree):
        degree[nodes] = d
    total = np.bincount(component, weights=degree, minlength=n)
    while True:
        group = _settled(g, degree, loops, 1 / total[at], seed, resolution)
        groups, dense = np.unique(group, return_inverse=True)
        if len(groups) == g.n:
            break
        home, degree, at = dense[home], np.bincount(dense, weights=degree), at[groups]
        g, inside = _merged(g, dense, len(groups), local_rows)
        loops = np.bincount(dense, weights=loops) + inside
        if not (g.table is not None or len(g.here[0])):
            break
    first = _parts(base, home)
    firsts = np.flatnonzero(first == np.arange(n))
    firsts = firsts[np.lexsort((firsts, component[firsts]))]
    owner = component[firsts]
    number = np.zeros(n, np.int32)
    number[firsts] = np.arange(len(firsts)) - np.searchsorted(owner, owner)
    told = sc.broadcast((component, number[first]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.column(0).to_numpy()
            parts, numbers = (x[at] for x in told.value)
            named = pc.binary_join_element_wise(held.value.take(pa.array(parts)), pa.array(numbers).cast(pa.string()), "#")
            yield pa.RecordBatch.from_arrays([held.value.take(pa.array(at)), named], names=["id", "community"])

    return pairs.sparkSession.range(0, n, 1, max(1, n // 100_000)).mapInArrow(run, "id string, community string")


def detect(pairs: DataFrame, resolution: float = 1.0, seed: int = SEED, kernel_edges: int = KERNEL_EDGES, held_nodes: int | None = None, local_rows: int = LOCAL_ROWS) -> DataFrame:
    """id, community (component#number, numbered by first member). Communities never span connected components. At the end
    communities are refined: one that is not connected inside falls into its connected parts. A graph of kernel_edges edges at
    most is one kernel's work altogether, one of held_nodes nodes at most goes through rounds over flat arrays. Of others a kernel
    takes one component at a time; components of more than kernel_edges edges are first made smaller, level by level, with joins."""
    pairs = tabled(pairs.select("a", "b"))
    count = pairs.count()
    if count <= kernel_edges:
        return _detected(pairs, resolution, seed)
    nodes = tabled(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct())
    if nodes.count() <= (HELD_NODES if held_nodes is None else held_nodes):
        names = pa.chunked_array(nodes.toArrow()["id"].chunks, pa.string()).combine_chunks()
        return _flat(pairs, names.take(pc.sort_indices(names)), resolution, seed, count, local_rows)
    comp = spread(pairs)
    x = settle(pairs.join(comp.select(F.col("id").alias("a"), "component"), "a").select("component", "a", "b", F.lit(1.0).alias("weight")))
    count = settle(x.groupBy("component").agg(F.count("*").alias("n")))
    home = settle(comp.select("id", F.col("id").alias("home")))
    big = x.join(count.filter(F.col("n") > kernel_edges), "component", "left_semi").drop("component")
    n = big.count()
    total = 2.0 * n
    small = x.join(count.filter(F.col("n") <= kernel_edges), "component", "left_semi")
    while n > kernel_edges:
        homes, big = coarsened(big, resolution, total)
        home = settle(home.join(homes.select(F.col("id").alias("home"), F.col("home").alias("to")), "home", "left").select("id", F.coalesce("to", "home").alias("home")))
        before, n = n, big.count()
        if n > 0.95 * before:
            break
    left = big.join(comp.select(F.col("id").alias("a"), "component"), "a").select("component", "a", "b", "weight")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        found = local_moves(sorted(zip(pdf["a"], pdf["b"], pdf["weight"], strict=True)), resolution, seed)
        return pd.DataFrame({"home": list(found), "group": list(found.values()), "component": pdf["component"].iloc[0]})

    found = small.union(left).groupBy("component").applyInPandas(run, "home string, group int, component string")
    named = settle(home.join(found, "home").select("id", "component", "group"))
    one, two = (named.select(F.col("id").alias(k), F.col("group").alias(f"g{k}")) for k in ("a", "b"))
    inside = pairs.join(one, "a").join(two, "b").filter("ga = gb").select("a", "b")
    parts = spread(inside).select("id", F.col("component").alias("first"))
    firsts = named.join(parts, "id", "left").select("id", "component", F.coalesce("first", "id").alias("first"))
    numbers = firsts.select("component", "first").distinct().withColumn("k", F.row_number().over(W.partitionBy("component").orderBy("first")) - 1)
    return firsts.join(numbers, ["component", "first"]).select("id", F.concat_ws("#", "component", F.col("k").cast("string")).alias("community"))


def connected_parts(near: dict[str, list[str]], among: Callable[[str, str], bool]) -> dict[str, str]:
    """Each node's connected part, named by its smallest node; edges count where among() says so."""
    out: dict[str, str] = {}
    for v in sorted(near):
        if v not in out:
            out[v], open_ = v, [v]
            while open_:
                x = open_.pop()
                for u in near[x]:
                    if u not in out and among(x, u):
                        out[u] = v
                        open_.append(u)
    return out


def _detected(pairs: DataFrame, resolution: float, seed: int) -> DataFrame:
    """detect() of a graph that one kernel takes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        edges = sorted(e for pdf in batches for e in zip(pdf["a"], pdf["b"], strict=True))
        near: dict[str, list[str]] = defaultdict(list)
        for a, b in edges:
            near[a].append(b)
            near[b].append(a)
        part = connected_parts(near, lambda a, b: True)
        inside: dict[str, list] = defaultdict(list)
        for a, b in edges:
            inside[part[a]].append((a, b, 1.0))
        group: dict[str, tuple] = {}
        for name, own in inside.items():
            group.update({v: (name, g) for v, g in local_moves(own, resolution, seed).items()})
        whole = connected_parts(near, lambda a, b: group[a] == group[b])
        numbers: dict[str, dict[str, int]] = defaultdict(dict)
        for v in sorted(near):
            numbers[part[v]].setdefault(whole[v], len(numbers[part[v]]))
        yield pd.DataFrame([(v, f"{part[v]}#{numbers[part[v]][whole[v]]}") for v in near], columns=["id", "community"])

    return pairs.select("a", "b").repartition(1).mapInPandas(run, "id string, community string")


def spread(pairs: DataFrame, rounds: int = 100) -> DataFrame:
    """id, component (its smallest member), by spreading the smallest known label, with pointer jumps in between."""
    both = settle(pairs.select(F.col("a").alias("id"), F.col("b").alias("n")).union(pairs.select(F.col("b"), F.col("a"))).distinct())
    label = settle(both.groupBy("id").agg(F.least(F.min("n"), F.col("id")).alias("component")))
    for _ in range(rounds):
        heard = both.join(label.select(F.col("id").alias("n"), F.col("component").alias("c")), "n").groupBy("id").agg(F.min("c").alias("c"))
        near = label.join(heard, "id").select("id", "component", F.least("component", "c").alias("new"))
        jump = near.join(label.select(F.col("id").alias("new"), F.col("component").alias("far")), "new").select("id", "component", F.least("new", "far").alias("new"))
        now = settle(jump)
        done = now.filter("new <> component").isEmpty()
        label = now.select("id", F.col("new").alias("component"))
        if done:
            return label
    raise RuntimeError("labels did not settle")


def rows(membership: DataFrame, least: int = 2) -> DataFrame:
    """community, symbolCount of communities with at least two members, the largest first."""
    return membership.groupBy("community").agg(F.count("*").alias("symbolCount")).filter(F.col("symbolCount") >= least).orderBy(F.desc("symbolCount"), "community")


def labels(membership: DataFrame, nodes: DataFrame) -> DataFrame:
    """community, label: the most frequent parent folder, else a common beginning of the names, else a number."""
    x = membership.join(nodes.select("id", "name", "filePath"), "id", "left")
    parts = F.filter(F.split(F.coalesce("filePath", F.lit("")), "/"), lambda p: p != "")
    folder = F.when(F.size(parts) >= 2, F.element_at(parts, -2))
    named = x.withColumn("folder", folder).filter(F.col("folder").isNotNull() & ~F.lower("folder").isin(STOP_FOLDERS))
    best = named.groupBy("community", "folder").agg(F.count("*").alias("n"), F.min("id").alias("first")).groupBy("community").agg(F.min_by("folder", F.struct(-F.col("n"), F.col("first"))).alias("folder"))
    ends = x.filter("name is not null").groupBy("community").agg(F.min("name").alias("lo"), F.max("name").alias("hi"), F.count("*").alias("n"))
    joined = membership.select("community").distinct().join(best, "community", "left").join(ends, "community", "left")
    prefix = common_prefix(F.col("lo"), F.col("hi"))
    number = F.regexp_extract("community", r"(\d+)$", 1)
    label = F.when(F.col("folder").isNotNull(), capitalised(F.col("folder"))).when((F.col("n") > 2) & (F.length(prefix) > 2), capitalised(prefix)).otherwise(F.concat(F.lit("Cluster_"), number))
    return joined.select("community", label.alias("label"))


def common_prefix(a: Column, b: Column) -> Column:
    """The longest common beginning of the smallest and the largest name is that of all names."""
    n = F.least(F.length(a), F.length(b))
    same = F.filter(F.sequence(F.lit(0), n), lambda i: F.substr(a, F.lit(1), i) == F.substr(b, F.lit(1), i))
    return F.substr(a, F.lit(1), F.array_max(same))


def cohesion(pairs: DataFrame, membership: DataFrame, sample: int = 50) -> DataFrame:
    """community, cohesion: the share of its first members' neighbours that are inside, at most 1."""
    first = membership.withColumn("rn", F.row_number().over(W.partitionBy("community").orderBy("id"))).filter(F.col("rn") <= sample)
    both = pairs.select(F.col("a").alias("id"), F.col("b").alias("n")).union(pairs.select("b", "a"))
    other = membership.select(F.col("id").alias("n"), F.col("community").alias("c2"))
    x = first.join(both, "id").join(other, "n", "left").groupBy("community").agg(F.least(F.lit(1.0), F.sum(F.when(F.col("c2") == F.col("community"), 1).otherwise(0)) / F.count("*")).alias("cohesion"))
    return membership.select("community").distinct().join(x, "community", "left").select("community", F.round(F.coalesce("cohesion", F.lit(1.0)), 9).alias("cohesion"))


def modularity(pairs: DataFrame, membership: DataFrame, resolution: float = 1.0) -> DataFrame:
    m = membership.select(F.col("id").alias("__i"), F.col("community").alias("__c"))
    x = pairs.join(m, F.col("a") == F.col("__i")).withColumnRenamed("__c", "ca").drop("__i").join(m, F.col("b") == F.col("__i")).withColumnRenamed("__c", "cb")
    inside = x.select("ca", "cb").withColumn("same", (F.col("ca") == F.col("cb")).cast("int"))
    deg = inside.select(F.explode(F.array("ca", "cb")).alias("c")).groupBy("c").agg(F.count("*").alias("d"))
    total = inside.agg(F.count("*").alias("m"), F.sum("same").alias("s"))
    sq = deg.agg(F.sum(F.col("d").cast("double") * F.col("d")).alias("q"))
    return total.crossJoin(sq).select(F.round(F.col("s") / F.col("m") - resolution * F.col("q") / (4.0 * F.col("m") * F.col("m")), 9).alias("modularity"))


# --- import cycles ------------------------------------------------------------------------------


def strong_components(edges: dict) -> list[list]:
    """Strong components by Gabow's path method, without recursion; members sorted. Nodes that only appear as targets count."""
    number: dict = {}  # order of discovery; -1 once the component is told
    path, bounds, out = [], [], []
    for root in sorted(set(edges) | {u for n in edges.values() for u in n}):
        todo = [(root, None)]
        while todo:
            v, ways = todo.pop()
            if ways is None:
                if v in number:
                    continue
                number[v] = len(number)
                path.append(v)
                bounds.append(number[v])
                ways = iter(edges.get(v, ()))
            for u in ways:
                if u not in number:
                    todo += [(v, ways), (u, None)]
                    break
                if number[u] >= 0:  # still on the path: all since u are one
                    while bounds[-1] > number[u]:
                        bounds.pop()
            else:
                if bounds[-1] == number[v]:
                    bounds.pop()
                    part = [path.pop()]
                    while part[-1] != v:
                        part.append(path.pop())
                    for u in part:
                        number[u] = -1
                    out.append(sorted(part))
    return out


def cycles_through(root: str, part: dict[str, list[str]], budget: list[int]) -> Iterator[list[str]]:
    """The elementary cycles through root inside one strong component (Johnson 1975): a node whose search found no cycle stays
    shut until a node that it leads to is opened again. budget[0] counts down with each edge looked at."""
    shut: set[str] = {root}
    wakes: dict[str, set[str]] = defaultdict(set)
    trail = [root]
    todo = [list(reversed(part[root]))]
    fruitful = [False]

    def open_again(v: str) -> None:
        ready = {v}
        while ready:
            w = ready.pop()
            shut.discard(w)
            ready |= wakes.pop(w, set()) & shut

    while trail:
        if todo[-1]:
            nxt = todo[-1].pop()
            budget[0] -= 1
            if budget[0] < 0:
                return
            if nxt == root:
                fruitful[-1] = True
                yield trail.copy()
            elif nxt not in shut:
                shut.add(nxt)
                trail.append(nxt)
                todo.append(list(reversed(part[nxt])))
                fruitful.append(False)
            continue
        v, good = trail.pop(), fruitful.pop()
        todo.pop()
        if good:
            open_again(v)
            if fruitful:
                fruitful[-1] = True
        else:
            for w in part[v]:
                wakes[w].add(v)


def elementary_cycles(edges: dict[str, list[str]], most: int = 10_000, work: int = 10_000_000) -> list[list[str]] | None:
    """All elementary cycles, each from its least node, sorted; None beyond the limits. When all cycles through the least node
    of a component are told, the rest of the component falls into smaller ones, and only those go on."""
    budget, out = [work], []
    parts = [set(p) for p in strong_components(edges)]
    while parts:
        members = parts.pop()
        inside = {v: sorted(u for u in edges.get(v, ()) if u in members) for v in members}
        budget[0] -= len(members)
        root = min(members)
        if len(members) > 1 or root in inside[root]:
            for c in cycles_through(root, inside, budget):
                out.append(c)
                if len(out) > most:
                    return None
        if budget[0] < 0:
            return None
        rest = {v: [u for u in n if u != root] for v, n in inside.items() if v != root}
        parts += [set(p) for p in strong_components(rest) if len(p) > 1 or p[0] in rest.get(p[0], ())]
    return sorted(out)


def shortest_cycle(edges: dict[str, list[str]], start: str) -> list[str]:
    """The shortest cycle through start, the first in the order of its nodes."""
    came: dict[str, str] = {}
    queue = [start]
    for v in queue:
        for u in sorted(edges.get(v, ())):
            if u == start:
                path = [v]
                while path[-1] != start:
                    path.append(came[path[-1]])
                return path[::-1]
            if u not in came:
                came[u] = v
                queue.append(u)
    return []


def import_cycles(edges: DataFrame, most: int = 10_000, work: int = 10_000_000, kernel_edges: int = KERNEL_EDGES, flat_edges: int | None = None) -> DataFrame:
    """component (least node), size, kind (complete, representatives), cycle: one kernel for each cyclic strong component. A
    component of n nodes and m edges has at least m - n + 1 elementary cycles (the dimension of its cycle space, which directed
    cycles span), so none are told one by one where that is beyond the limit. Representatives are searched by joins in components
    of more than kernel_edges edges, and in all that are beyond the limit if these have more edges together."""
    from .closure import FLAT_EDGES, strongly_connected

    e = tabled(edges.select(F.col("source").cast("string").alias("src"), F.col("target").cast("string").alias("dst")).filter("src is not null and dst is not null").distinct())
    flat = (FLAT_EDGES if kernel_edges else 0) if flat_edges is None else flat_edges
    member = tabled(strongly_connected(e, flat, tabled_already=True).filter("cyclic").select("node", "scc", "size"))
    x = e.join(member.select(F.col("node").alias("src"), "scc", "size"), "src").join(member.select(F.col("node").alias("dst"), F.col("scc").alias("to")), "dst").filter("scc = to").select("src", "dst", "scc", "size")
    n = inside_edges(e, member) if kernel_edges else x.groupBy("scc").agg(F.count("*").alias("n"))
    sizes = member.select("scc", F.col("size").alias("of")).distinct()
    count = tabled(n.join(sizes, "scc").withColumn("sure", F.col("n") - F.col("of") + 1 > most))
    sure = count.filter("sure").agg(F.sum("n")).first()[0] or 0
    apart = (F.col("n") > kernel_edges) | (F.col("sure") if sure > kernel_edges else F.lit(False))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        table: dict[str, list[str]] = {}
        for a, b in sorted(zip(pdf["src"], pdf["dst"], strict=True)):
            table.setdefault(a, []).append(b)
        least = pdf["scc"].iloc[0]
        cycles = None if pdf["sure"].iloc[0] else elementary_cycles(table, most, work)
        rows = cycles if cycles is not None else [shortest_cycle(table, least)]
        return pd.DataFrame({"component": least, "size": int(pdf["size"].iloc[0]), "kind": "complete" if cycles is not None else "representatives", "cycle": rows}, columns=["component", "size", "kind", "cycle"])

    kinds = "component string, size int, kind string, cycle array<string>"
    large, small = count.filter(apart).select("scc"), count.filter(~apart).select("scc", "sure")
    if large.isEmpty():
        return x.join(small, "scc").groupBy("scc").applyInPandas(run, kinds)
    inside = member.join(large, "scc", "left_semi")
    found = least_cycles(e, inside.select("node", "scc")).join(inside.select("scc", "size").distinct(), "scc")
    out = found.select(F.col("scc").alias("component"), F.col("size").cast("int").alias("size"), F.lit("representatives").alias("kind"), "cycle")
    return out if small.isEmpty() else out.union(x.join(small, "scc").groupBy("scc").applyInPandas(run, kinds))


def inside_edges(edges: DataFrame, member: DataFrame, held_nodes: int = HELD_NODES) -> DataFrame:
    """scc, n: the edges (src, dst) inside each component. member: node, scc."""
    if member.limit(held_nodes + 1).count() > held_nodes:
        ends = edges.join(member.select(F.col("node").alias("src"), "scc"), "src").join(member.select(F.col("node").alias("dst"), F.col("scc").alias("to")), "dst")
        return ends.filter("scc = to").groupBy("scc").agg(F.count("*").alias("n"))
    t = member.select("node", "scc").toArrow()  # HELD_NODES at most, as counted
    sccs = pa.chunked_array(t["scc"].chunks, pa.string()).combine_chunks().dictionary_encode()
    shared = edges.sparkSession.sparkContext.broadcast((pa.chunked_array(t["node"].chunks, pa.string()).combine_chunks(), sccs.indices.to_numpy(), sccs.dictionary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes, label, names = shared.value
        held = list(batches)
        if not held or not len(names):
            return
        rows = pa.Table.from_batches(held)
        at = [pc.fill_null(pc.index_in(rows[k].combine_chunks(), value_set=nodes), -1).to_numpy() for k in ("src", "dst")]
        a, b = (label[i] for i in np.stack(at)[:, (at[0] >= 0) & (at[1] >= 0)])
        n = np.bincount(a[a == b], minlength=len(names))
        yield pa.RecordBatch.from_arrays([names.filter(pa.array(n > 0)), pa.array(n[n > 0], pa.int64())], names=["scc", "n"])

    return edges.select("src", "dst").mapInArrow(run, "scc string, n long").groupBy("scc").agg(F.sum("n").alias("n"))


#: Rows of a level that a broadcast may hold.
HELD = 50_000


def least_cycles(edges: DataFrame, inside: DataFrame) -> DataFrame:
    """scc, cycle: the shortest cycle through the node that names the component, the first in the order of its nodes. inside: node,
    scc. Rounds go backwards from the names until these are met; then the way is walked, each step to the least node that is one
    nearer to the end."""
    near = lambda d: F.broadcast(d) if d.limit(HELD + 1).count() <= HELD else d
    level = tabled(inside.select("scc").distinct().select("scc", F.col("scc").alias("node")))
    levels, met, seen = [level], [], level
    while not level.isEmpty():
        # a component whose name is met goes no further; no node is in two components
        before = edges.join(near(level.select(F.col("node").alias("dst"), F.col("scc").alias("to"))), "dst").select(F.col("src").alias("node"), "to").distinct()
        before = tabled(before.join(inside, "node").filter("scc = to").select("scc", "node"))
        done = tabled(before.filter("node = scc").select("scc", F.lit(len(levels)).alias("k")))
        met.append(done)
        level = tabled(before.join(done, "scc", "left_anti").join(seen, "node", "left_anti"))
        levels.append(level)
        seen = seen.union(level)
    ends = tabled(reduce(DataFrame.unionByName, met))
    far = reduce(DataFrame.unionByName, (d.select("node", F.lit(k).alias("far")) for k, d in enumerate(levels)))
    way, out = ends.select("scc", "k", F.array("scc").alias("cycle")), []
    while True:
        out.append(way.filter("k = 1").select("scc", "cycle"))
        way = way.filter("k > 1")
        if way.isEmpty():
            return reduce(DataFrame.unionByName, out)
        step = edges.join(near(way.select(F.element_at("cycle", -1).alias("src"), "scc", "k", "cycle")), "src").join(far.select(F.col("node").alias("dst"), "far"), "dst").filter("far = k - 1")
        way = tabled(step.groupBy("scc").agg(F.min("dst").alias("dst"), F.first("k").alias("k"), F.first("cycle").alias("cycle")).select("scc", (F.col("k") - 1).alias("k"), F.concat("cycle", F.array("dst")).alias("cycle")))


def local_values(g: Graph) -> DataFrame:
    """Ids of block-scoped values whose only edge is their file's DEFINES."""
    v = g.labelled("Const", "Variable", "Static").select("id")
    out = g.edges.select(F.col("sourceId").alias("id"))
    into = g.edges.filter("type <> 'DEFINES'").select(F.col("targetId").alias("id"))
    return v.join(out, "id", "left_anti").join(into, "id", "left_anti")

