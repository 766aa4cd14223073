"""Program dependence and taint: one kernel for each function, and a fixpoint over summaries.

A control-flow graph is a row: fn, n (blocks), entry, exit, edges (array of (src, dst, kind)), and facts: array of
(block, line, defs, uses, may) with binding names. Kernels run in grouped maps, so functions are dealt out freely.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import settle

#: Facts and calls that every worker may hold (about 60 MB).
SMALL_FACTS = 200_000
MAX_BLOCKS, MAX_CDG, MAX_LINES, MAX_FINDINGS, MAX_PATHS, MAX_HOPS = 5000, 5000, 2000, 2000, 1000, 32


def blocks(cfgs: DataFrame, cap: int = MAX_BLOCKS) -> DataFrame:
    """fn, src, dst, kind: CFG edges, at most cap of each function."""
    return cfgs.select("fn", F.explode(F.slice("edges", 1, cap)).alias("e")).select("fn", "e.*")


def reachable(n: int, entry: int, edges: list[tuple[int, int, str]]) -> set[int]:
    out: dict[int, list[int]] = {}
    for a, b, _ in edges:
        out.setdefault(a, []).append(b)
    seen, open_ = {entry}, [entry]
    while open_:
        for b in out.get(open_.pop(), ()):
            if b not in seen:
                seen.add(b)
                open_.append(b)
    return seen


def with_escapes(n: int, exit_: int, edges: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Blocks that cannot reach the exit get a way out, from the smallest block of a cycle among them, a branching one first."""
    edges = list(edges)
    while True:
        back: dict[int, list[int]] = {}
        fan: dict[int, set[int]] = {}
        for a, b, _ in edges:
            back.setdefault(b, []).append(a)
            fan.setdefault(a, set()).add(b)
        seen, open_ = {exit_}, [exit_]
        while open_:
            for a in back.get(open_.pop(), ()):
                if a not in seen:
                    seen.add(a)
                    open_.append(a)
        lost = [b for b in range(n) if b not in seen and b in fan]
        if not lost:
            return edges
        out: dict[int, set[int]] = {b: fan[b] for b in lost}
        round_ = [b for b in lost if _comes_back(b, out)] or lost
        edges.append((min(round_, key=lambda b: (len(fan[b]) < 2, b)), exit_, "escape"))


def _comes_back(b: int, out: dict[int, set[int]]) -> bool:
    seen: set[int] = set()
    open_ = list(out.get(b, ()))
    while open_:
        v = open_.pop()
        if v == b:
            return True
        if v not in seen:
            seen.add(v)
            open_ += out.get(v, ())
    return False


def post_dominators(n: int, exit_: int, edges: list[tuple[int, int, str]]) -> list[int]:
    """The immediate post-dominator of each block; -1 for the exit and for blocks that cannot reach it."""
    succ: dict[int, list[int]] = {}
    pred: dict[int, list[int]] = {}
    for a, b, _ in edges:
        succ.setdefault(a, []).append(b)
        pred.setdefault(b, []).append(a)
    order, seen, stack = [], {exit_}, [(exit_, iter(sorted(pred.get(exit_, ()))))]
    while stack:
        v, it = stack[-1]
        for u in it:
            if u not in seen:
                seen.add(u)
                stack.append((u, iter(sorted(pred.get(u, ())))))
                break
        else:
            order.append(v)
            stack.pop()
    rank = {v: i for i, v in enumerate(order)}
    idom: dict[int, int] = {exit_: exit_}
    changed = True
    while changed:
        changed = False
        for v in reversed(order):
            if v == exit_:
                continue
            new = None
            for u in succ.get(v, ()):
                if u in idom:
                    if new is None:
                        new = u
                        continue
                    x, y = new, u
                    while x != y:
                        while rank[x] < rank[y]:
                            x = idom[x]
                        while rank[y] < rank[x]:
                            y = idom[y]
                    new = x
            if new is not None and idom.get(v) != new:
                idom[v], changed = new, True
    return [-1 if v == exit_ or v not in idom else idom[v] for v in range(n)]


def dominators(n: int, entry: int, edges: list[tuple[int, int, str]]) -> list[int]:
    """The immediate dominator of each block: post-dominators of the graph turned around. -1 for the entry and for blocks that it
    does not reach."""
    return post_dominators(n, entry, [(b, a, kind) for a, b, kind in edges])


def frontiers(n: int, entry: int, edges: list[tuple[int, int, str]]) -> dict[int, list[int]]:
    """Where each block's dominance ends: blocks that it does not strictly dominate, though it dominates a predecessor."""
    idom = dominators(n, entry, edges)
    out: dict[int, set[int]] = {}
    for a, b, _ in edges:
        v = a if a == entry or idom[a] >= 0 else -1
        while v not in (-1, idom[b]):
            out.setdefault(v, set()).add(b)
            v = idom[v]
    return {v: sorted(f) for v, f in sorted(out.items())}


def reverse_postorder(entry: int, edges: list[tuple[int, int, str]]) -> list[int]:
    """Blocks that the entry reaches, each before those that only it leads to; successors are visited in the order of their
    numbers."""
    out: dict[int, list[int]] = {}
    for a, b in sorted({(a, b) for a, b, _ in edges}):
        out.setdefault(a, []).append(b)
    order, seen, open_ = [], {entry}, [(entry, 0)]
    while open_:
        v, k = open_.pop()
        ways = out.get(v, [])
        while k < len(ways) and ways[k] in seen:
            k += 1
        if k < len(ways):
            seen.add(ways[k])
            open_ += [(v, k + 1), (ways[k], 0)]
        else:
            order.append(v)
    return order[::-1]


def condensed(n: int, edges: list[tuple[int, int, str]]) -> list[int]:
    """Each block's strong component, named by its smallest block."""
    from .communities import strong_components

    table: dict[int, list[int]] = {b: [] for b in range(n)}
    for a, b, _ in edges:
        table[a].append(b)
    out = list(range(n))
    for part in strong_components(table):
        for b in part:
            out[b] = part[0]
    return out


def control_dependence(n: int, exit_: int, edges: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """(controller, dependent, label): for each branch edge, all blocks from its target up to the branch's post-dominator."""
    ip = post_dominators(n, exit_, with_escapes(n, exit_, edges))
    arms: dict[int, set[str]] = {}
    sense = {"cond-true": "T", "switch-case": "T", "cond-false": "F"}
    for a, _, kind in edges:
        if kind in sense:
            arms.setdefault(a, set()).add(sense[kind])
    out = set()
    for a, b, kind in edges:
        label = sense.get(kind) or ("F" if arms.get(a) == {"T"} else "T")
        v = b
        seen = set()
        while v not in (-1, ip[a]) and v not in seen:
            seen.add(v)
            # a branch does not depend on itself by an edge of its own, only through others
            if v != a or b != a:
                out.add((a, v, label))
            v = ip[v]
    return sorted(out)


def reaching_definitions(n: int, entry: int, edges: list[tuple[int, int, str]], facts: list[tuple[int, int, list[str], list[str], list[str]]], max_visits: int | None = None) -> tuple[str, list[tuple[str, int, int, int, int]]]:
    """Status and (binding, def block, def line, use block, use line). Definitions kill, may-definitions add; a throw passes on
    what came in and every definition of the block."""
    if not facts:
        return "no-facts", []
    by: dict[int, list] = {}
    for f in sorted(facts, key=lambda f: (f[0], f[1])):
        by.setdefault(f[0], []).append(f)
    pred: dict[int, list[tuple[int, bool]]] = {}
    succ: dict[int, list[int]] = {}
    for a, b, kind in edges:
        pred.setdefault(b, []).append((a, kind == "throw"))
        succ.setdefault(a, []).append(b)

    def through(b: int, state: dict[str, frozenset]) -> tuple[dict[str, frozenset], dict[str, frozenset]]:
        state, every = dict(state), dict(state)
        for _, line, defs, _, may in by.get(b, ()):
            for d in defs:
                state[d] = frozenset({(b, line)})
                every[d] = every.get(d, frozenset()) | {(b, line)}
            for d in may:
                state[d] = state.get(d, frozenset()) | {(b, line)}
                every[d] = every.get(d, frozenset()) | {(b, line)}
        return state, every

    inn: dict[int, dict[str, frozenset]] = {b: {} for b in range(n)}
    out = {b: through(b, {}) for b in range(n)}
    rank = {b: k for k, b in enumerate(reverse_postorder(entry, edges))}
    open_, visits = sorted(rank, key=rank.__getitem__), 0
    while open_:
        b = open_.pop(0)
        visits += 1
        if max_visits is not None and visits > max_visits:
            return "truncated", []
        state: dict[str, frozenset] = {}
        for p, thrown in pred.get(b, ()):
            for k, v in out[p][1 if thrown else 0].items():
                state[k] = state.get(k, frozenset()) | v
        new = through(b, state)
        inn[b] = state
        if new != out[b]:
            out[b] = new
            open_ += [s for s in succ.get(b, ()) if s not in open_]
    found = set()
    for b in range(n):
        state = dict(inn[b])
        for _, line, defs, uses, may in by.get(b, ()):
            for u in uses:
                found |= {(u, db, dl, b, line) for db, dl in state.get(u, ())}
            for d in defs:
                state[d] = frozenset({(b, line)})
            for d in may:
                state[d] = state.get(d, frozenset()) | {(b, line)}
    return "computed", sorted(found, key=lambda f: (f[1], f[2], f[3], f[4], f[0]))


def _edges(r) -> list[tuple[int, int, str]]:
    return [(int(e["src"]), int(e["dst"]), e["kind"]) for e in r.edges]


def _each(cfgs: DataFrame, fn, schema: str) -> DataFrame:
    names = [p.split()[0] for p in schema.split(", ")]

    def run(it):
        for pdf in it:
            rows = [row for r in pdf.itertuples() for row in fn(r)]
            yield pd.DataFrame(rows, columns=names)

    return cfgs.mapInPandas(run, schema)


def post_dominator_edges(cfgs: DataFrame) -> DataFrame:
    """fn, block, ipdom (POST_DOMINATE, also for debugging)."""
    return _each(cfgs, lambda r: [(r.fn, b, p) for b, p in enumerate(post_dominators(r.n, r.exit, with_escapes(r.n, r.exit, _edges(r))))], "fn string, block int, ipdom int")


def dominator_edges(cfgs: DataFrame) -> DataFrame:
    """fn, block, idom."""
    return _each(cfgs, lambda r: [(r.fn, b, d) for b, d in enumerate(dominators(r.n, r.entry, _edges(r)))], "fn string, block int, idom int")


def frontier_rows(cfgs: DataFrame) -> DataFrame:
    """fn, block, frontier."""
    return _each(cfgs, lambda r: [(r.fn, b, f) for b, fs in frontiers(r.n, r.entry, _edges(r)).items() for f in fs], "fn string, block int, frontier int")


def block_order(cfgs: DataFrame) -> DataFrame:
    """fn, block, ord: reverse postorder."""
    return _each(cfgs, lambda r: [(r.fn, b, k) for k, b in enumerate(reverse_postorder(r.entry, _edges(r)))], "fn string, block int, ord int")


def block_components(cfgs: DataFrame) -> DataFrame:
    """fn, block, component."""
    return _each(cfgs, lambda r: [(r.fn, b, k) for b, k in enumerate(condensed(r.n, _edges(r)))], "fn string, block int, component int")


def control_edges(cfgs: DataFrame, cap: int = MAX_CDG) -> DataFrame:
    return _each(cfgs, lambda r: [(r.fn, a, b, k) for a, b, k in control_dependence(r.n, r.exit, _edges(r))[:cap]], "fn string, controller int, dependent int, label string")


def reachable_blocks(cfgs: DataFrame) -> DataFrame:
    return _each(cfgs, lambda r: [(r.fn, b) for b in sorted(reachable(r.n, r.entry, _edges(r)))], "fn string, block int")


def _facts(r) -> list:
    return [(int(f["block"]), int(f["line"]), list(f["defs"]), list(f["uses"]), list(f["may"])) for f in r.facts]


def definition_facts(cfgs: DataFrame) -> DataFrame:
    """fn, status, binding, def_block, def_line, use_block, use_line; a function without facts has one row of nulls."""

    def one(r):
        status, found = reaching_definitions(r.n, r.entry, _edges(r), _facts(r))
        return [(r.fn, status, *f) for f in found] or [(r.fn, status, None, None, None, None, None)]

    return _each(cfgs, one, "fn string, status string, binding string, def_block int, def_line int, use_block int, use_line int")


def definition_edges(facts: DataFrame, cap: int = 4000) -> DataFrame:
    """REACHING_DEF: fn, def_block, use_block, reason (binding and its line pairs, encoded)."""
    from pyspark.sql import Window as W

    lines = F.array_sort(F.collect_set(F.struct("def_line", "use_line")))
    g = facts.filter("binding is not null").groupBy("fn", "def_block", "use_block", "binding").agg(lines.alias("pairs"))
    rn = F.row_number().over(W.partitionBy("fn").orderBy("def_block", "use_block", "binding"))
    return g.withColumn("rn", rn).filter(F.col("rn") <= cap).select("fn", "def_block", "use_block", encode_reason(F.col("binding"), F.col("pairs")).alias("reason"))


def encode_reason(binding: Column, pairs: Column) -> Column:
    safe = F.replace(F.replace(binding, F.lit("%"), F.lit("%25")), F.lit("|"), F.lit("%7C"))
    return F.concat_ws("|", F.lit("v1"), safe, F.array_join(F.transform(pairs, lambda p: F.concat(p["def_line"].cast("string"), F.lit("-"), p["use_line"].cast("string"))), ","))


def decode_reason(reason: Column) -> Column:
    """(binding, array of (def_line, use_line)); null for another version."""
    parts = F.split(reason, r"\|")
    name = F.replace(F.replace(parts[1], F.lit("%7C"), F.lit("|")), F.lit("%25"), F.lit("%"))
    pairs = F.transform(F.split(parts[2], ","), lambda p: F.struct(F.split(p, "-")[0].cast("int").alias("def_line"), F.split(p, "-")[1].cast("int").alias("use_line")))
    return F.when(parts[0] == "v1", F.struct(name.alias("binding"), pairs.alias("pairs")))


#: Sink kinds.
KINDS = ["sql", "command", "path", "html", "code"]


def match_sites(sites: DataFrame, model: DataFrame) -> DataFrame:
    """Sites (fn, block, line, callee, receiver) of a model (role, kind, callee, receiver; a null receiver fits all)."""
    m = model.select("role", "kind", "callee", F.col("receiver").alias("__r"))
    return sites.join(m, "callee").filter(F.col("__r").isNull() | (F.col("__r") == F.col("receiver"))).drop("__r")


def propagate(facts: list[tuple[str, int, int, int, int]], stmts: list[tuple[int, int, list[str], list[str], list[str]]], sources: set[tuple[int, int]], sinks: dict[tuple[int, int], str], cleans: dict[tuple[int, int], set[str]], hops: int = MAX_HOPS, most: int = 200) -> tuple[list[tuple[int, int, int, int, str]], list[tuple[int, int, str]]]:
    """Findings (source block and line, sink block and line, kind) and kills (block, line, kind). State: a definition and the
    source it comes from; excluded kinds are intersected on every way, and a state is looked at again when they shrink."""
    uses: dict[tuple[int, int, str], list[tuple[int, int]]] = {}
    for b, db, dl, ub, ul in facts:
        uses.setdefault((db, dl, b), []).append((ub, ul))
    defs = {(s[0], s[1]): list(s[2]) + list(s[4]) for s in stmts}
    state: dict[tuple, tuple[frozenset, int]] = {}
    open_ = []
    for at in sorted(sources):
        for d in defs.get(at, ()):
            state[(at, d, at)] = (frozenset(), 0)
            open_.append((at, d, at))
    found, kills = set(), set()
    while open_:
        key = open_.pop(0)
        (at, d, src), (off, n) = key, state[key]
        for use in uses.get((*at, d), ()):
            gone = off | frozenset(cleans.get(use, ()))
            kills |= {(*use, k) for k in cleans.get(use, ())}
            if use in sinks and sinks[use] not in gone:
                found.add((*src, *use, sinks[use]))
            if n + 1 > hops:
                continue
            for nd in defs.get(use, ()):
                k2 = (use, nd, src)
                old = state.get(k2)
                new = gone if old is None else old[0] & gone
                if old is None or new != old[0]:
                    state[k2] = (new, n + 1)
                    open_.append(k2)
    return sorted(found)[:most], sorted(kills)


def taint(cfgs: DataFrame) -> DataFrame:
    """fn, kind_of (finding, kill, gap), src_block, src_line, block, line, kind. cfgs also have sources, sinks and cleans:
    arrays of (block, line, kind)."""

    def one(r):
        edges, stmts = _edges(r), _facts(r)
        status, facts = reaching_definitions(r.n, r.entry, edges, stmts)
        if status != "computed":
            return [(r.fn, "gap", None, None, None, None, status)]
        place = lambda x: (int(x["block"]), int(x["line"]))
        cleans: dict[tuple[int, int], set[str]] = {}
        for c in r.cleans:
            cleans.setdefault(place(c), set()).add(c["kind"])
        found, kills = propagate(facts, stmts, {place(s) for s in r.sources}, {place(s): s["kind"] for s in r.sinks}, cleans)
        return [(r.fn, "finding", *f) for f in found] + [(r.fn, "kill", None, None, *k) for k in kills]

    return _each(cfgs, one, "fn string, kind_of string, src_block int, src_line int, block int, line int, kind string")


def taint_edges(found: DataFrame) -> DataFrame:
    """TAINTED and SANITIZES edges with ids that follow from their content."""
    block = lambda c: F.concat_ws(":", F.lit("BasicBlock"), "fn", F.col(c).cast("string"))
    t = found.filter("kind_of = 'finding'").select(F.lit("TAINTED").alias("type"), block("src_block").alias("sourceId"), block("block").alias("targetId"), F.col("kind").alias("reason"))
    s = found.filter("kind_of = 'kill'").select(F.lit("SANITIZES").alias("type"), block("block").alias("sourceId"), block("block").alias("targetId"), F.col("kind").alias("reason"))
    return t.union(s).distinct().withColumn("id", F.substring(F.sha2(F.concat_ws("|", "type", "sourceId", "targetId", "reason"), 256), 1, 16))


def harvest(summaries: DataFrame) -> DataFrame:
    """fn, version: a digest of the sorted facts (fn, fact, param, callee, arg, kind)."""
    row = F.concat_ws(",", "fact", F.coalesce(F.col("param").cast("string"), F.lit("")), F.coalesce("callee", F.lit("")), F.coalesce(F.col("arg").cast("string"), F.lit("")), F.coalesce("kind", F.lit("")))
    return summaries.groupBy("fn").agg(F.substring(F.sha2(F.array_join(F.array_sort(F.collect_set(row)), ";"), 256), 1, 16).alias("version"))


class Summaries:
    """Facts and calls that one worker holds: where each source's taint begins, how it moves, and where it sinks."""

    def __init__(self, facts: list, calls: list, max_hops: int):
        into: dict[tuple, list] = defaultdict(list)
        for r in {(c["caller"], c["name"], c["callee"], c["params"]) for c in calls}:
            into[r[0], r[1]].append(r[2:])
        targets = lambda f, callee, arg: [t for t, n in into.get((f, callee), ()) if n is None or arg < n]
        by: dict[str, list] = defaultdict(list)
        for r in facts:
            by[r["fact"]].append(r)
        gives = {r["fn"] for r in by["source-return"]}
        back = {(r["fn"], t) for r in by["call-return"] for t, _ in into.get((r["fn"], r["callee"]), ())}
        for _ in range(max_hops):
            more = {f for f, t in back if t in gives} - gives
            if not more:
                break
            gives |= more
        self.seeds: dict[str, set] = defaultdict(set)
        for r in by["source-call"]:
            self.seeds[r["fn"]] |= {(t, r["arg"]) for t in targets(r["fn"], r["callee"], r["arg"])}
        for r in by["result-call"]:
            if any(t in gives for t, _ in into.get((r["fn"], r["kind"]), ())):
                self.seeds[r["fn"]] |= {(t, r["arg"]) for t, _ in into.get((r["fn"], r["callee"]), ())}
        cleans: dict[tuple, set] = defaultdict(set)
        for r in by["param-clean"]:
            cleans[r["fn"], r["param"], r["callee"], r["arg"]].add(r["kind"])
        self.moves: dict[tuple, list] = defaultdict(list)
        for r in by["param-call"]:
            clean = frozenset(cleans.get((r["fn"], r["param"], r["callee"], r["arg"]), ()))
            self.moves[r["fn"], r["param"]] += [(t, r["arg"], clean) for t in targets(r["fn"], r["callee"], r["arg"])]
        self.sinks: dict[tuple, set] = defaultdict(set)
        for r in by["param-sink"]:
            self.sinks[r["fn"], r["param"]].add(r["kind"])
        self.max_hops = max_hops

    def findings(self, source: str) -> list[tuple[str, str, str, int]]:
        state = dict.fromkeys(self.seeds[source], (frozenset(), 1))
        new = state
        for h in range(2, self.max_hops + 1):
            met: dict[tuple, frozenset] = {}
            for at, (off, _) in new.items():
                for target, arg, clean in self.moves.get(at, ()):
                    told = off | clean
                    met[target, arg] = met[target, arg] & told if (target, arg) in met else told
            fresh = {}
            for at, off in met.items():
                old = state.get(at)
                now = off if old is None else old[0] & off
                if old is None or len(now) < len(old[0]):
                    fresh[at] = (now, h if old is None else old[1])
            if not fresh:
                break
            state, new = state | fresh, fresh
        best: dict[tuple, int] = {}
        for (fn, param), (off, hops) in state.items():
            for kind in self.sinks.get((fn, param), set()) - off:
                best[fn, kind] = min(hops, best.get((fn, kind), hops))
        return [(source, fn, kind, hops) for (fn, kind), hops in best.items()]


def _solved(facts: DataFrame, calls: DataFrame, max_hops: int) -> DataFrame:
    """Findings of every source, each by itself, over facts that every worker holds."""
    spark = facts.sparkSession
    table = Summaries(facts.collect(), calls.collect(), max_hops)  # SMALL_FACTS at most, as counted
    shared = spark.sparkContext.broadcast(table)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([f for source in pdf["source"] for f in shared.value.findings(source)], columns=["source_fn", "sink_fn", "kind", "hops"])

    sources = spark.createDataFrame([(s,) for s in sorted(table.seeds)], "source string")
    return sources.repartition("source").mapInPandas(run, "source_fn string, sink_fn string, kind string, hops int")


def interprocedural(facts: DataFrame, calls: DataFrame, max_hops: int = MAX_HOPS, cap: int = MAX_FINDINGS, small_facts: int = SMALL_FACTS) -> DataFrame:
    """source_fn, sink_fn, kind, hops: taint across functions.

    facts (fn, fact, param, callee, arg, kind): source-call (a source reaches argument arg of callee), param-call (parameter
    param does), param-sink (it reaches a sink of a kind), param-clean (kind is neutralised on the way to callee's arg),
    source-return and call-return are closed first: a function that returns a source's or such a call's value is a source where
    it is called with fact result-call (its result reaches callee's arg; param holds nothing). calls: caller, callee, name,
    params. Semi-naive: a state (source, fn, param) goes on only with fewer neutralised kinds than before. Up to small_facts facts
    and calls, every worker holds them and sources are dealt out; beyond, each round is a join."""
    if facts.limit(small_facts + 1).count() + calls.limit(small_facts + 1).count() <= small_facts:
        return _solved(facts, calls, max_hops).orderBy("source_fn", "sink_fn", "kind").limit(cap)
    by_name = calls.select(F.col("caller").alias("fn"), F.col("name").alias("callee"), F.col("callee").alias("target"), "params").distinct()
    hop = lambda f: facts.filter(F.col("fact") == f).join(by_name, ["fn", "callee"]).filter(F.col("params").isNull() | (F.col("arg") < F.col("params")))
    # functions whose result is tainted
    gives = settle(facts.filter("fact = 'source-return'").select("fn").distinct())
    back = facts.filter("fact = 'call-return'").join(by_name, ["fn", "callee"]).select("fn", "target")
    for _ in range(max_hops):
        more = settle(back.join(gives.select(F.col("fn").alias("target")), "target").select("fn").distinct().join(gives, "fn", "left_anti"))
        if more.isEmpty():
            break
        gives = settle(gives.union(more))
    results = facts.filter("fact = 'result-call'").select("fn", F.col("kind").alias("callee"), F.col("callee").alias("into"), "arg")
    made = results.join(by_name, ["fn", "callee"]).join(gives.select(F.col("fn").alias("target")), "target").select("fn", F.col("into").alias("callee"), "arg").join(by_name, ["fn", "callee"])
    seeds = hop("source-call").select(F.col("fn").alias("source"), F.col("target").alias("fn"), F.col("arg").alias("param")).union(made.select(F.col("fn").alias("source"), F.col("target").alias("fn"), F.col("arg").alias("param")))
    none = F.array().cast("array<string>")
    state = new = settle(seeds.distinct().withColumn("off", none).withColumn("hops", F.lit(1)))
    cleans = facts.filter("fact = 'param-clean'").groupBy("fn", "param", "callee", "arg").agg(F.array_sort(F.collect_set("kind")).alias("clean"))
    moves = hop("param-call").join(cleans, ["fn", "param", "callee", "arg"], "left").select("fn", "param", "target", F.col("arg").alias("to"), F.coalesce("clean", none).alias("clean"))
    for h in range(2, max_hops + 1):
        step = new.join(moves, ["fn", "param"]).select("source", F.col("target").alias("fn"), F.col("to").alias("param"), F.array_sort(F.array_union("off", "clean")).alias("off"))
        # several ways to one state: what all of them neutralise
        met = step.groupBy("source", "fn", "param").agg(F.reduce(F.collect_list("off"), F.first("off"), lambda a, b: F.array_intersect(a, b)).alias("off"))
        old = state.select("source", "fn", "param", F.col("off").alias("was"), F.col("hops").alias("when"))
        joined = met.join(old, ["source", "fn", "param"], "left").withColumn("now", F.when(F.col("was").isNull(), F.col("off")).otherwise(F.array_intersect("was", "off")))
        fresh = joined.filter(F.col("was").isNull() | (F.size("now") < F.size("was")))
        new = settle(fresh.select("source", "fn", "param", F.col("now").alias("off"), F.coalesce("when", F.lit(h)).alias("hops")))
        if new.isEmpty():
            break
        state = settle(state.join(new.select("source", "fn", "param"), ["source", "fn", "param"], "left_anti").union(new))
    sinks = facts.filter("fact = 'param-sink'").select("fn", "param", "kind")
    hit = state.join(sinks, ["fn", "param"]).filter(~F.array_contains("off", F.col("kind")))
    return hit.groupBy(F.col("source").alias("source_fn"), F.col("fn").alias("sink_fn"), "kind").agg(F.min("hops").alias("hops")).orderBy("source_fn", "sink_fn", "kind").limit(cap)


def taint_paths(findings: DataFrame, nodes: DataFrame, cap: int = MAX_PATHS) -> DataFrame:
    """TAINT_PATH edges at 0.6 between functions that are nodes."""
    ids = nodes.select(F.col("id").alias("__i"))
    x = findings.join(ids, F.col("source_fn") == F.col("__i"), "left_semi").join(ids, F.col("sink_fn") == F.col("__i"), "left_semi")
    return x.orderBy("source_fn", "sink_fn", "kind").limit(cap).select(F.col("source_fn").alias("sourceId"), F.col("sink_fn").alias("targetId"), F.lit("TAINT_PATH").alias("type"), F.lit(0.6).alias("confidence"), F.col("kind").alias("reason"))


def encode_path(hops: Column, cap: int = 4096) -> Column:
    """Hop names joined by arrows, cut before the cap with a marker."""
    safe = F.transform(hops, lambda h: F.regexp_replace(h, r"[^\w.:#$-]", "_"))
    n = F.size(hops)
    upto = F.transform(F.sequence(F.lit(1), n), lambda i: F.octet_length(F.array_join(F.slice(safe, 1, i), "->")))
    fit = F.size(F.filter(upto, lambda x: x <= cap - 5))
    return F.when(n == 0, "").when(fit == n, F.array_join(safe, "->")).otherwise(F.concat(F.array_join(F.slice(safe, 1, fit), "->"), F.lit("->...")))


def encode_params(params: Column) -> Column:
    """A set of parameter numbers as hexadecimal digits, the lowest bits last; any width."""
    top = F.coalesce(F.array_max(params), F.lit(-1))
    # fifteen digits at a time, the first ones without the zeros before the highest bit
    bit = lambda p, w: F.when((p >= w * 60) & (p < w * 60 + 60), F.call_function("shiftleft", F.lit(1).cast("long"), (p % 60).cast("int"))).otherwise(F.lit(0).cast("long"))
    word = lambda w: F.lpad(F.hex(F.aggregate(params, F.lit(0).cast("long"), lambda s, p: s.bitwiseOR(bit(p, w)))), 15, "0")
    last = F.greatest(F.floor(top / 60).cast("int"), F.lit(0))
    code = F.lower(F.array_join(F.transform(F.sequence(last, F.lit(0)), word), ""))
    return F.when(top < 0, "0").otherwise(F.right(code, (F.floor(top / 4) + 1).cast("int")))


def decode_params(code: Column) -> Column:
    ones = F.array(*(F.array(*(F.lit(k) for k in range(4) if v >> k & 1)) if v else F.array().cast("array<int>") for v in range(16)))

    def bits(low: Column) -> Column:
        n = F.length(low)
        digit = lambda i: F.substr(low, i, F.lit(1))
        # only digits that hold a bit are looked up
        held = F.filter(F.sequence(F.lit(1), n), lambda i: ~digit(i).isin("0", ""))
        return F.sort_array(F.flatten(F.transform(held, lambda i: F.transform(F.get(ones, F.call_function("instr", F.lit("123456789abcdef"), digit(i))), lambda k: ((n - i) * 4 + k).cast("int")))))

    # as an argument the code is computed once, not for each digit
    return F.get(F.transform(F.array(F.lower(code)), bits), F.lit(0))


def collected(functions: DataFrame, cap: int = MAX_LINES) -> DataFrame:
    """Functions short enough for analysis, and how many are not: kept, skipped."""
    return functions.agg(F.count_if(F.col("endLine") - F.col("startLine") + 1 <= cap).alias("kept"), F.count_if(F.col("endLine") - F.col("startLine") + 1 > cap).alias("skipped"))
