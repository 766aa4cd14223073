"""Kernels against brute force on small random graphs."""

import contextlib
import itertools
import random

import pytest

from pyspark.sql import functions as F

from graphloom.operators import closure as C
from graphloom.operators import communities as M
from graphloom.operators import flows as L
from graphloom.operators import hierarchy as H
from graphloom.operators import pdg as P
from graphloom.plans.stages import Stage, ordered, run


def graphs(n, count, seed=1, p=0.3):
    rng = random.Random(seed)
    for _ in range(count):
        names = [chr(97 + i) for i in range(n)]
        yield {a: sorted(b for b in names if rng.random() < p) for a in names}


def brute_cycles(g):
    out = []
    for k in range(1, len(g) + 1):
        for path in itertools.permutations(g, k):
            if path[0] == min(path) and all(b in g[a] for a, b in zip(path, path[1:] + path[:1])):
                out.append(list(path))
    return sorted(out)


@pytest.mark.parametrize("g", list(graphs(5, 25)))
def test_elementary_cycles(g):
    assert M.elementary_cycles(g) == brute_cycles(g)


def test_cycle_limits():
    full = {a: [b for b in "abcdef" if b != a] for a in "abcdef"}
    assert M.elementary_cycles(full, most=3) is None
    assert len(M.shortest_cycle(full, "a")) == 2
    three = {a: [b for b in "abc" if b != a] for a in "abc"}
    assert len(M.elementary_cycles(three)) == 5


@pytest.mark.parametrize("g", list(graphs(6, 25, seed=2)))
def test_strong_components(g):
    reach = {a: {a} for a in g}
    for _ in g:
        for a in g:
            for b in list(reach[a]):
                reach[a] |= set(g[b])
    want = sorted({tuple(sorted(b for b in g if b in reach[a] and a in reach[b])) for a in g})
    assert sorted(map(tuple, M.strong_components(g))) == want


def test_communities_are_valid_and_stable():
    a = [(f"a{i}", f"a{j}") for i in range(6) for j in range(i)]
    b = [(f"b{i}", f"b{j}") for i in range(6) for j in range(i)]
    edges = [(x, y, 1.0) for x, y in [*a, *b, ("a0", "b0")]]
    found = M.local_moves(edges)
    assert len({found[f"a{i}"] for i in range(6)}) == len({found[f"b{i}"] for i in range(6)}) == 1
    assert found["a0"] != found["b0"]
    assert found == M.local_moves(edges)


def test_one_long_ring():
    """Its only cycle is told at once: what is left of a component is no component any more."""
    ring = {f"{k:05d}": [f"{(k + 1) % 6000:05d}"] for k in range(6000)}
    assert len(M.elementary_cycles(ring, work=50_000)) == 1


def labelled_graph(seed, n=60, m=90):
    rng = random.Random(seed)
    return sorted({(f"n{rng.randrange(n):02d}", f"n{rng.randrange(n):02d}") for _ in range(m)} | {("t1", "t2"), ("t2", "t3"), ("self", "self")})


@pytest.mark.parametrize(("seed", "kernel"), [(1, 10**6), (1, 0), (2, 0), (3, 40)])
def test_strongly_connected(spark, seed, kernel):
    """By the kernel and by rounds of joins, against reachability."""
    e = labelled_graph(seed)
    names = sorted({v for x in e for v in x})
    reach = {v: {b for a, b in e if a == v} for v in names}
    for _ in names:
        for v in names:
            reach[v] |= {w for u in reach[v] for w in reach[u]}
    same = {v: [u for u in names if u == v or (u in reach[v] and v in reach[u])] for v in names}
    want = sorted((v, same[v][0], len(same[v]), v in reach[v]) for v in names)
    got = C.strongly_connected(spark.createDataFrame([*e, e[0], (None, "n01")], "src string, dst string"), kernel).collect()
    assert sorted(map(tuple, got)) == want


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("depth", [2, 50])
def test_reach_both_ways(spark, seed, depth):
    """A search in workers' tables and rounds of joins give the same rows, first-seen paths too."""
    e = labelled_graph(seed, 25, 60)
    df = spark.createDataFrame([(a, b, k % 7) for k, (a, b) in enumerate(e)], "src string, dst string, ord int")
    starts = spark.createDataFrame([("n01",), ("n02",), ("t1",), ("none",), (None,)], "start string")
    for s in (starts, None):
        one, two = (sorted((r.start, r.node, r.depth, r.via, tuple(r.path)) for r in C.reach(df, s, depth, "ord", small_edges=small).collect()) for small in (10**6, 0))
        assert one == two and len(one) > 5


@pytest.mark.parametrize("kernel", [10**6, 0])
def test_import_cycles(spark, kernel):
    """Complete in the kernel; representatives where a component is too large for it."""
    e = labelled_graph(4, 20, 34)
    table = {}
    for a, b in e:
        table.setdefault(a, []).append(b)
    parts = [p for p in M.strong_components(table) if len(p) > 1 or p[0] in table.get(p[0], [])]
    got = M.import_cycles(spark.createDataFrame(e, "source string, target string"), kernel_edges=kernel).collect()
    if kernel:
        assert sorted(list(r.cycle) for r in got) == M.elementary_cycles(table) and {r.kind for r in got} == {"complete"}
    else:
        inside = {p[0]: {v: [u for u in table.get(v, []) if u in p] for v in p} for p in parts}
        assert {r.component: list(r.cycle) for r in got} == {k: M.shortest_cycle(t, k) for k, t in inside.items()}
        assert {r.kind for r in got} == {"representatives"}


@pytest.mark.parametrize("kernel", [10**6, 60, "all but one"])
def test_detect(spark, kernel):
    """Communities lie inside components, are connected, and are no worse than single nodes; dense groups stay together."""
    rng = random.Random(5)
    pairs = {tuple(sorted((f"{g}{a}", f"{g}{b}"))) for g in "abcdef" for a in range(8) for b in range(a) if rng.random() < 0.8}
    pairs |= {("a0", "b0"), ("b1", "c1"), ("c2", "d2"), ("x1", "x2")}
    limit = len(pairs) - 1 if kernel == "all but one" else kernel
    got = {r.id: r.community for r in M.detect(spark.createDataFrame(sorted(pairs), "a string, b string"), kernel_edges=limit).collect()}
    assert set(got) == {v for p in pairs for v in p} and got["x1"] == got["x2"] != got["a0"]
    for c in set(got.values()):
        members = {v for v in got if got[v] == c}
        seen, todo = set(), [min(members)]
        while todo:
            v = todo.pop()
            if v not in seen:
                seen.add(v)
                todo += [u for p in pairs if v in p for u in p if u in members]
        assert seen == members
    for g in "abcdef":
        assert len({got[f"{g}{k}"] for k in range(1, 8) if f"{g}{k}" in got}) <= 2
    m = len(pairs)
    degree = {v: sum(v in p for p in pairs) for v in got}
    q = sum(got[a] == got[b] for a, b in pairs) / m - sum(sum(degree[v] for v in got if got[v] == c) ** 2 for c in set(got.values())) / (4 * m * m)
    assert q > 0.6


@pytest.mark.parametrize("seed", range(6))
def test_block_analyses(seed):
    """Dominators, frontiers, order and condensation by their definitions."""
    rng = random.Random(seed)
    n = 7
    edges = sorted({(rng.randrange(n), rng.randrange(n), "seq") for _ in range(11)})
    live = P.reachable(n, 0, edges)
    without = lambda d: P.reachable(n, 0, [e for e in edges if d not in e[:2]]) if d else set()
    dom = {v: {d for d in live if d == v or v not in without(d)} for v in live}
    idom = P.dominators(n, 0, edges)
    for v in range(n):
        strict = dom.get(v, {v}) - {v}
        assert idom[v] == (max(strict, key=lambda d: len(dom[d])) if v in live and strict else -1)
    want = {}
    for a, b, _ in edges:
        for d in dom.get(a, ()):
            if d not in dom[b] - {b}:
                want.setdefault(d, set()).add(b)
    assert {k: set(v) for k, v in P.frontiers(n, 0, [e for e in edges if e[0] in live]).items()} == want
    order = P.reverse_postorder(0, edges)
    assert set(order) == live and order[0] == 0
    comp = P.condensed(n, edges)
    at = {v: k for k, v in enumerate(order)}
    assert all(at[a] < at[b] for a, b, _ in edges if a in live and comp[a] != comp[b])
    reach = {v: P.reachable(n, v, edges) for v in range(n)}
    assert comp == [min(u for u in range(n) if u in reach[v] and v in reach[u]) for v in range(n)]


def test_c3():
    d = {"D": ["B", "C"], "B": ["A"], "C": ["A"]}
    assert H.merge_c3(d)["D"] == ["B", "C", "A"]
    assert H.merge_c3({"Z": ["X", "Y"], "X": ["P", "Q"], "Y": ["Q", "P"]})["Z"] is None
    assert H.merge_c3({"U": ["V"], "V": ["U"]})["U"] is None
    class A: ...
    class B(A): ...
    class C(A): ...
    class E(B, C): ...
    table = {c.__name__: [b.__name__ for b in c.__bases__ if b is not object] for c in (A, B, C, E)}
    assert H.merge_c3(table)["E"] == [c.__name__ for c in E.__mro__[1:-1]]


def test_walk():
    g = {"a": ["b", "c"], "b": ["d"], "c": ["d"], "d": []}
    assert L.walk("a", g, set()) == [["a", "b", "d"], ["a", "c", "d"]]
    assert L.walk("a", {"a": ["b"], "b": ["c"], "c": ["a"]}, set()) == [["a", "b", "c"]]
    assert L.walk("a", {"a": ["b"], "b": ["c"], "c": ["d"], "d": []}, {"c"}) == [["a", "b", "c"], ["a", "b", "c", "d"]]
    wide = {"r": [f"x{i}" for i in range(9)], **{f"x{i}": [f"y{i}{j}" for j in range(9)] for i in range(9)}}
    assert len(L.walk("r", wide, set())) == 12


def cfgs(count, seed=3):
    rng = random.Random(seed)
    for _ in range(count):
        n = rng.randint(3, 7)
        edges = [(i, i + 1, "seq") for i in range(n - 1)]
        edges += [(rng.randrange(n - 1), rng.randrange(n), rng.choice(["cond-true", "cond-false", "seq"])) for _ in range(rng.randint(0, 5))]
        yield n, sorted(set(edges))


def paths_avoid(n, edges, start, exit_, without):
    """Whether the exit can be reached from start without a block."""
    if start == without:
        return False
    seen, open_ = {start}, [start]
    while open_:
        v = open_.pop()
        if v == exit_:
            return True
        for a, b, _ in edges:
            if a == v and b != without and b not in seen:
                seen.add(b)
                open_.append(b)
    return False


@pytest.mark.parametrize("cfg", list(cfgs(40)))
def test_post_dominators(cfg):
    n, edges = cfg
    ip = P.post_dominators(n, n - 1, edges)
    for v in range(n - 1):
        strict = {d for d in range(n) if d != v and not paths_avoid(n, edges, v, n - 1, d)}
        chain, x = set(), ip[v]
        while x != -1:
            chain.add(x)
            x = ip[x]
        assert chain == strict


@pytest.mark.parametrize("cfg", list(cfgs(40, seed=4)))
def test_control_dependence(cfg):
    n, edges = cfg
    dominated = lambda d, v: d == v or not paths_avoid(n, edges, v, n - 1, d)
    want = {(a, x) for a, b, _ in edges for x in range(n) if dominated(x, b) and not (x != a and dominated(x, a)) and not (x == a == b)}
    assert {(a, x) for a, x, _ in P.control_dependence(n, n - 1, edges)} == want


@pytest.mark.parametrize("cfg", list(cfgs(30, seed=5)))
def test_reaching_definitions(cfg):
    n, edges = cfg
    rng = random.Random(str(cfg))
    facts = [(b, 10 * b, [rng.choice("xy")] if rng.random() < 0.6 else [], [rng.choice("xy")] if rng.random() < 0.6 else [], []) for b in range(n)]
    status, found = P.reaching_definitions(n, 0, edges, facts)
    assert status == "computed"
    want = set()
    live = P.reachable(n, 0, edges)
    for b, line, defs, _, _ in facts:
        for d in defs:
            if b not in live:
                continue
            seen, open_ = set(), [t for a, t, _ in edges if a == b]
            while open_:
                v = open_.pop()
                if v in seen:
                    continue
                seen.add(v)
                if d in facts[v][3]:
                    want.add((d, b, line, v, facts[v][1]))
                if d not in facts[v][2]:
                    open_ += [t for a, t, _ in edges if a == v]
    assert {f for f in found if f[3] in live} == {w for w in want if w[3] in live}
    assert P.reaching_definitions(n, 0, edges, []) == ("no-facts", [])
    assert P.reaching_definitions(n, 0, edges, facts, max_visits=1)[0] == "truncated"


def test_stages():
    s = [Stage("b", lambda d: d["a"] + 1, ("a",)), Stage("a", lambda d: 1), Stage("c", lambda d: 9, ("b",), lambda o: o.get("c", False))]
    assert [x.name for x in ordered(s)] == ["a", "b", "c"]
    assert run(s) == {"a": 1, "b": 2, "c": None}
    with pytest.raises(ValueError, match="cycle"):
        ordered([Stage("x", id, ("y",)), Stage("y", id, ("x",))])
    with pytest.raises(ValueError, match="needs"):
        ordered([Stage("x", id, ("q",))])


FACTS = [
    ("a", "source-call", None, "b", 0, None), ("b", "param-call", 0, "c", 1, None), ("b", "param-call", 0, "d", 0, None), ("b", "param-clean", 0, "d", 0, "sql"), ("c", "param-sink", 1, None, None, "sql"),
    ("d", "param-sink", 0, None, None, "sql"), ("d", "param-sink", 0, None, None, "html"), ("c", "param-call", 1, "b", 0, None), ("s", "source-return", None, None, None, None), ("t", "call-return", None, "s", None, None),
    ("u", "result-call", None, "d", 0, "t"), ("e", "source-call", None, "c", 5, None),
]


def test_returned_sources(spark):
    """Sources that functions return, calls with too few parameters, cycles, and kinds that are cleaned on the only way."""
    facts = spark.createDataFrame(FACTS, "fn string, fact string, param int, callee string, arg int, kind string")
    rows = [("a", "b", "b", 1), ("b", "c", "c", 2), ("b", "d", "d", 1), ("c", "b", "b", 1), ("t", "s", "s", 0), ("u", "t", "t", 0), ("u", "d", "d", 1), ("e", "c", "c", 2)]
    calls = spark.createDataFrame(rows, "caller string, callee string, name string, params int")
    one, two = ({tuple(r) for r in P.interprocedural(facts, calls, small_facts=small).collect()} for small in (10**6, 0))
    assert one == two and {r[:3] for r in one} == {("a", "c", "sql"), ("a", "d", "html"), ("u", "d", "sql"), ("u", "d", "html")}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_interprocedural_both_ways(spark, seed):
    """In workers' tables and by rounds of joins, on random facts."""
    rng = random.Random(seed)
    fns = [f"f{k}" for k in range(12)]
    calls = [(a, b, b, rng.choice([1, 2, None])) for a in fns for b in rng.sample(fns, 3)]
    facts = [(rng.choice(fns), "source-call", None, rng.choice(fns), rng.randrange(2), None) for _ in range(8)]
    facts += [(a, "param-call", rng.randrange(2), b, rng.randrange(2), None) for a, b, *_ in calls]
    facts += [(f[0], "param-clean", f[2], f[3], f[4], rng.choice(["sql", "html"])) for f in facts[8:] if rng.random() < 0.4]
    facts += [(rng.choice(fns), "param-sink", rng.randrange(2), None, None, rng.choice(["sql", "html"])) for _ in range(10)]
    f, c = spark.createDataFrame(facts, "fn string, fact string, param int, callee string, arg int, kind string"), spark.createDataFrame(calls, "caller string, callee string, name string, params int")
    one, two = (sorted(map(tuple, P.interprocedural(f, c, small_facts=small).collect())) for small in (10**6, 0))
    assert one == two


def test_functions_by_hand(spark):
    """Control-flow graphs whose facts are known by hand."""
    from graphloom.plans import boundary_queries as Bq

    cfgs = Bq._cfgs(spark)
    ip = {(r.fn, r.block): r.ipdom for r in P.post_dominator_edges(cfgs).collect()}
    assert [ip["diamond", b] for b in range(5)] == [3, 3, 3, 4, -1] and [ip["loop", b] for b in range(4)] == [1, 3, 1, -1]
    assert [ip["forever", b] for b in range(4)] == [1, 3, 1, -1] and [ip["thrower", b] for b in range(4)] == [1, 3, 3, -1]
    live = {}
    for r in P.reachable_blocks(cfgs).collect():
        live.setdefault(r.fn, set()).add(r.block)
    assert live == {"diamond": {0, 1, 2, 3, 4}, "loop": {0, 1, 2, 3}, "forever": {0, 1, 2}, "thrower": {0, 1, 2, 3}}


def test_conflicts_skip_what_a_class_has(spark):
    """Names of more than one set of 64, own names, properties, repeated rows; no row for a name that the class has itself."""
    up = [("C", "B", 1, 0, "EXTENDS"), ("C", "I", 1, 1, "IMPLEMENTS"), ("C", "A", 2, 2, "EXTENDS"), ("B", "A", 1, 0, "EXTENDS")]
    members = [(k, f"{k}.m{i}", f"m{i}", k == "A" and i == 7) for k in "ABI" for i in range(150)] + [("C", f"C.m{i}", f"m{i}", i == 3) for i in range(0, 148)] + [("I", "I.only1", "only", False), ("I", "I.only2", "only", False), ("A", "A.one", "one", False)]
    d = spark.createDataFrame(up, "class string, ancestor string, depth int, mro_pos int, kind string")
    m = spark.createDataFrame(members + members[:50], "class string, method string, name string, is_property boolean")
    got = {(r["class"], r["name"]): (r.definitions, r.first, r.first_class) for r in H.conflicts(d, m).collect()}
    assert got == {("C", "m148"): (3, "B.m148", "B.m148"), ("C", "m149"): (3, "B.m149", "B.m149"), ("C", "only"): (2, "I.only1", None)}
    short = H.conflicts(d, m, resolved=False)
    assert {(r["class"], r["name"]): (r.definitions, r.by_class) for r in short.collect()} == {k: (n, x is not None) for k, (n, _, x) in got.items()}
    assert [tuple(r) for r in H.split_summary(short).collect()] == [(3, 1)]


def test_parameter_codes_of_any_width(spark):
    sets = [[], [0], [3, 4], [59], [60], [61, 2, 130], list(range(0, 200, 7)), [119, 120], [239], None]
    want = [("0" if not s else f"{sum(1 << p for p in s):x}", sorted(s or [])) for s in sets]
    d = spark.createDataFrame([(i, s) for i, s in enumerate(sets)], "id int, ps array<int>").withColumn("code", P.encode_params(F.col("ps")))
    got = sorted(tuple(r) for r in d.select("id", "code", P.decode_params(F.col("code")), P.decode_params(F.upper("code"))).collect())
    assert got == [(i, code, bits, bits) for i, (code, bits) in enumerate(want)]


def _most_rows(df) -> int:
    """The largest number of rows that a join of the executed plan made."""
    import re

    df.collect()
    plan, out = df._jdf.queryExecution().executedPlan(), []
    todo = [plan]
    while todo:
        p = todo.pop()
        if p.nodeName() == "AdaptiveSparkPlan":
            todo.append(p.executedPlan())
            continue
        if p.nodeName().endswith("QueryStage"):
            todo.append(p.plan())
        if re.search("Join", p.nodeName()):
            out.append(p.metrics().apply("numOutputRows").value())
        kids = p.children()
        todo += [kids.apply(i) for i in range(kids.size())]
    return max(out)


def test_joins_stay_small(spark):
    """Symbols of one name, owners and calls of one method, scopes around a site: no row for each pair of them."""
    from graphloom.operators import enrichment as N
    from graphloom.operators import relational as Q
    from graphloom.operators import resolution as R

    nodes = spark.range(200).selectExpr("concat('n', lpad(id, 3, '0')) id", "'Method' label", "'f' name", "'a.py' filePath")
    calls = spark.range(300).selectExpr("concat('c', id) callerId", "'f(x)' calleeName", "'a.py' calleeFile")
    found = N.locate(calls, nodes)
    assert {(r.callee, r.file) for r in found.collect()} == {("n000", "a.py")} and found.count() == 300
    assert _most_rows(found) <= 300

    owners = spark.range(50).selectExpr("concat('k', id) sourceId", "'m' targetId")
    out = spark.range(100).selectExpr("'m' sourceId", "concat('t', lpad(id, 3, '0')) targetId", "99 - id div 2 emit_ord")
    entries = spark.range(20).selectExpr("concat('p', id) process", "if(id = 19, null, 'm') entryPointId")
    links = Q.first_calls(entries.union(entries.filter("process = 'p3'")), owners, out, 4)
    rows = sorted(tuple(r) for r in links.filter("class = 'k7'").collect())
    assert [r for r in rows if r[0] == "p0"] == [("p0", "k7", f"t{n:03d}") for n in (96, 97, 98, 99)] and links.count() == 19 * 50 * 4
    assert [r[2] for r in rows if r[0] == "p3"] == ["t098", "t098", "t099", "t099"]
    assert _most_rows(links) <= 40

    chain = spark.range(40).selectExpr("0L scope", "id ancestor", "cast(id as int) depth")
    bind = spark.range(1, 40).selectExpr("id scope", "'x' name", "concat('b', id) id", "if(id = 1, 'var', 'fn') kind")
    sites = spark.range(500).selectExpr("concat('s', id) site", "0L scope", "'x' name", "array(if(id % 2 = 0, 'var', 'fn')) kinds")
    seen = R.lexical(sites, chain, bind)
    assert {(r.id, r.depth) for r in seen.collect()} == {("b1", 1)} and seen.count() == 250
    assert _most_rows(seen) <= 500


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_ancestors_both_ways(spark, seed):
    """In the workers and by rounds of joins: cycles, several ways to an ancestor, ordinals of more than one digit, repeated edges."""
    rng = random.Random(seed)
    e = {(f"c{rng.randrange(40)}", f"c{rng.randrange(40)}"): rng.choice(("EXTENDS", "IMPLEMENTS")) for _ in range(90)}
    rows = [(a, b, 7 + 3 * sum(x[0] == a for x in list(e)[:i]), t) for i, ((a, b), t) in enumerate(e.items())]
    d = spark.createDataFrame([*rows, rows[0], (None, "c1", 0, "EXTENDS")], "child string, parent string, ord int, type string")
    one, two = (sorted(map(tuple, H.ancestors(d, held_edges=n).collect())) for n in (1000, 0))
    assert one == two and len(one) > 200 and H.ancestors(d).count() == len(one)


def test_conflicts_read_members_once(spark):
    """Members of a large table cross the network once; names and sets are made from what has arrived."""
    read = spark.sparkContext.accumulator(0)

    def told(batches):
        for pdf in batches:
            read.add(len(pdf))
            yield pdf

    m = spark.createDataFrame([(k, f"{k}.m{i}", f"m{i % 5}", False) for k in "AB" for i in range(10)], "class string, method string, name string, is_property boolean")
    d = spark.createDataFrame([("C", "A", 1, 0, "EXTENDS"), ("C", "B", 1, 1, "IMPLEMENTS")], "class string, ancestor string, depth int, mro_pos int, kind string")
    found = H.conflicts(d, m.mapInPandas(told, m.schema))
    assert sorted((r["name"], r.definitions, r.first) for r in found.collect()) == [(f"m{i}", 4, f"A.m{i}") for i in range(5)]
    assert read.value == 20


def test_dense_components_are_not_told_one_by_one(spark, monkeypatch):
    """m - n + 1 cycles are sure, so nothing is enumerated; representatives by the kernel and by joins."""
    dense = [(f"a{i:02d}", f"a{j:02d}") for i in range(20) for j in range(20) if i != j]
    ring = [(f"r{i}", f"r{(i + 1) % 5}") for i in range(5)] + [("r2", "a00"), ("r4", "r3")]
    e = spark.createDataFrame(dense + ring, "source string, target string")
    want = {("a00", 20, ("a00", "a01")), ("r0", 5, tuple(f"r{i}" for i in range(5)))}
    monkeypatch.setattr(M, "elementary_cycles", None)
    for most, kernel, flat in ((1, 10**6, None), (1, 300, 100)):
        got = M.import_cycles(e, most=most, kernel_edges=kernel, flat_edges=flat).collect()
        assert {(r.component, r.size, tuple(r.cycle)) for r in got} == want and {r.kind for r in got} == {"representatives"}


@pytest.mark.parametrize("chunks", [1, 3])
def test_thinned(spark, chunks):
    """The same nodes lead to the same nodes; a dense graph keeps few edges."""
    for e in (labelled_graph(6), [(f"n{a}", f"n{b}") for a in range(40) for b in range(40) if a != b]):
        thin = [tuple(r) for r in C.thinned(spark.createDataFrame(e, "src string, dst string").repartition(3), chunks).collect()]
        parts = lambda x: sorted(M.strong_components({v: [b for a, b in x if a == v] for v in {u for p in x for u in p}}))
        assert parts(thin) == parts([x for x in e if x[0] != x[1]] + [x for x in e if x[0] == x[1] and any(x[0] in y and y[0] != y[1] for y in e)])
    assert len(thin) <= 40 * chunks


def test_single_overrides_stop_at_the_nearest_match(spark, monkeypatch):
    """A chain of 30 classes with one name: each method meets its parent's only; two matches at a level end the search."""
    chain = [(f"c{i:02d}", f"c{j:02d}", i - j, "EXTENDS") for i in range(30) for j in range(i)] + [("d", "e", 1, "EXTENDS"), ("d", "c00", 2, "EXTENDS"), ("d", "i", 1, "IMPLEMENTS")]
    rows = [(f"c{i:02d}", f"c{i:02d}.m", "m", False, ["T"], 1) for i in range(30)] + [("d", "d.m", "m", False, ["T"], 1), ("e", "e.m1", "m", False, ["T"], 1), ("e", "e.m2", "m", False, ["T"], None), ("i", "i.m", "m", False, ["T"], 1), ("c05", "c05.x", "x", False, [], 2), ("c02", "c02.x", "x", False, ["A", "B"], 2), ("c03", "c03.x", "x", False, [], 3), ("c04", "c04.x", "x", True, [], 2)]
    up = spark.createDataFrame(chain, "class string, ancestor string, depth int, kind string")
    m = spark.createDataFrame(rows, "class string, method string, name string, is_property boolean, types array<string>, count int")
    most, real = [], H.tabled

    def told(df):
        with contextlib.suppress(ValueError):  # no join
            most.append(_most_rows(df))
        return real(df)

    monkeypatch.setattr(H, "tabled", told)
    found = H.single_overrides(up, m)
    want = {(f"c{i:02d}", f"c{i:02d}.m", f"c{i - 1:02d}.m") for i in range(1, 30)} | {("c05", "c05.x", "c02.x")}
    assert {tuple(r)[:3] for r in found.collect()} == want
    assert max(most) <= 60


@pytest.mark.parametrize("limits", [{}, {"name_rows": 6}, {"name_rows": 0}, {"held_up": 20}])
def test_inherited_implementations(spark, limits):
    """As by definition, in kernels and joins, in parts of classes, where methods have several rows, names or none."""
    rng = random.Random(11)
    up = [(f"c{i:02d}", f"c{j:02d}", rng.randrange(1, 4), rng.choice(("EXTENDS", "EXTENDS", "IMPLEMENTS"))) for i in range(14) for j in range(i) if rng.random() < 0.6] + [("c09", None, 1, "EXTENDS"), ("c09", "c01", 1, "OTHER")]
    rows = [(f"c{k % 14:02d}", f"m{k}", rng.choice("abcdefghijklmn"), rng.random() < 0.1, rng.choice(([], None, ["T"], ["T", "U"], ["T", None])), rng.choice((None, 1, 2))) for k in range(90)]
    rows += [("c01", "m3", "a", False, ["T"], 1), ("c02", "m5", "f", False, [], None), ("c03", None, "b", False, [], 1), ("c03", "m99", None, False, [], 1), (None, "m98", "b", False, [], 1), ("z", "m97", "b", False, [], 1), rows[7]]
    live = [r for r in rows if not r[3]]
    name = {(r[0], r[2]) for r in live}

    def match(a, b):
        (s, n), (t, k) = ((r[4] or [], r[5]) for r in (a, b))
        return (n is None) != (k is None) or ((n is None or n == k) if not s or not t else s == t)

    meet = {}
    for c, i in {x[:2] for x in up if x[3] == "IMPLEMENTS"}:
        for w in live:
            if w[0] == i and w[2] is not None and (c, w[2]) not in name:
                for low, a, depth, kind in up:
                    for r in live:
                        if (low, kind, r[0], r[2]) == (c, "EXTENDS", a, w[2]) and a is not None and match(w, r):
                            meet.setdefault((c, w[1]), {}).setdefault(depth, []).append(r[1])
    want = [(*k, v[min(d for d in v if len(v[d]) == 1)][0]) for k, v in meet.items() if any(len(x) == 1 for x in v.values())]
    m = spark.createDataFrame(rows, "class string, method string, name string, is_property boolean, types array<string>, count int")
    got = H.inherited_implementations(spark.createDataFrame(up, "class string, ancestor string, depth int, kind string"), m, **limits)
    assert len(want) > 20 and sorted(map(str, want)) == sorted(str(tuple(r)) for r in got.collect())


def test_inherited_implementations_make_few_rows(spark):
    """A class below 40 ancestors with 40 methods each of one name and an interface of as many: no row for each two of them."""
    up = spark.createDataFrame([("c", f"a{k}", k, "EXTENDS") for k in range(1, 41)] + [("c", "i", 1, "IMPLEMENTS")], "class string, ancestor string, depth int, kind string")
    rows = [(x, f"{x}.{k}", "n", False, ["T"], k) for x in ["i", *(f"a{k}" for k in range(1, 40))] for k in range(40)] + [("a40", "only", "n", False, ["T"], 1)]
    m = spark.createDataFrame(rows, "class string, method string, name string, is_property boolean, types array<string>, count int")
    found = H.inherited_implementations(up, m)
    assert {tuple(r) for r in found.collect()} == {("c", f"i.{k}", "only") for k in range(40)}
    with contextlib.suppress(ValueError):  # no join
        assert _most_rows(found) <= 2000


@pytest.mark.parametrize("limits", [{}, {"local_rows": 0}, {"held_nodes": 0}])
def test_detect_of_a_large_graph(spark, limits, monkeypatch):
    """Beyond the kernel, rounds go over flat arrays: the same components, connected communities numbered by their first members,
    no worse than the kernel's. Only graphs of more nodes than workers hold make rounds of joins."""
    rng = random.Random(9)
    pairs = {tuple(sorted((f"{x}{a:02d}", f"{x}{b:02d}"))) for x in "abcdefghij" for a in range(12) for b in range(a) if rng.random() < 0.7}
    pairs |= {(f"{x}00", f"{y}01") for x, y in zip("abcdfg", "bcdegh", strict=True)} | {("x1", "x2")} | {(f"y{k:02d}", f"y{k + 1:02d}") for k in range(60)}
    df = spark.createDataFrame(sorted(pairs), "a string, b string").repartition(3)
    joins, real = [], M.spread
    monkeypatch.setattr(M, "spread", lambda *a: joins.append(1) or real(*a))
    got = {r.id: r.community for r in M.detect(df, kernel_edges=20, **limits).collect()}
    assert bool(joins) == ("held_nodes" in limits)
    kernel = {r.id: r.community for r in M.detect(df).collect()}
    near = {}
    for a, b in sorted(pairs):
        near.setdefault(a, []).append(b)
        near.setdefault(b, []).append(a)
    part = M.connected_parts(near, lambda a, b: True)
    assert set(got) == set(near) and all(got[v].split("#")[0] == part[v] for v in near)
    inside = M.connected_parts(near, lambda a, b: got[a] == got[b])
    firsts = {}
    for v in sorted(near):
        firsts.setdefault(part[v], {}).setdefault(inside[v], len(firsts[part[v]]))
    assert all(got[v] == f"{part[v]}#{firsts[part[v]][inside[v]]}" for v in near)

    def quality(of):
        load = {}
        for v in near:
            load[of[v]] = load.get(of[v], 0) + len(near[v])
        return sum(of[a] == of[b] for a, b in pairs) / len(pairs) - sum(x * x for x in load.values()) / (2 * len(pairs)) ** 2

    assert quality(got) > quality(kernel) - 0.05
