"""Registered traces against a plain tracer, over all candidates and to the full depth."""

from helpers import SF

from graphloom.operators import flows as L
from graphloom.operators.graph import adjacency
from graphloom.plans import fixture as X
from graphloom.plans import graph_queries as G


def plain(path, ways, sinks, found):
    """Paths in order of emission: the path itself if it ends here, then those of its callees."""
    if len(found) >= 3 * 4:
        return
    on = [w for w in ways.get(path[-1], [])[:4] if w not in path] if len(path) < 10 else []
    if len(path) >= 3 and (not on or path[-1] in sinks):
        found.append(path)
    for w in on:
        plain([*path, w], ways, sinks, found)


def test_traces(spark):
    ways = {r.id: list(r.neighbours) for r in adjacency(X.edges(spark, SF, {"CALLS"})).collect()}
    sinks = {r.id for r in X.nodes(spark, SF, {"Method"}).collect() if r.id.endswith("0")}
    scores = sorted((-r.score, r.id) for r in G._scores(spark, SF).filter("score > 0").collect())
    want = []
    for _, entry in scores[:200]:
        found = []
        plain([entry], ways, sinks, found)
        want += [(entry, k, tuple(p)) for k, p in enumerate(found)]
    got = [(r.entry, r.trace_no, tuple(r.path)) for r in G.g6_traces(spark, SF).collect()]
    assert sorted(got) == sorted(want)
    assert len({g[0] for g in got}) > 30 and max(len(g[2]) for g in got) > 4


def test_process_cap(spark):
    symbols = X.nodes(spark, SF).filter("label <> 'File'").count()
    rows = G.g12_processes(spark, SF).count()
    assert 40 < rows <= max(20, int(symbols / 10 + 0.5))


def test_traces_by_rounds(spark):
    """Neighbourhoods gathered by joins give the walks that workers' tables give."""
    edges = X.edges(spark, SF, {"CALLS"})
    entries = L.candidates(G._scores(spark, SF)).select("id").limit(20)
    sinks = X.nodes(spark, SF, {"Method"}).filter("id like '%0'").select("id")
    one, two = (sorted((r.entry, r.trace_no, tuple(r.path)) for r in L.trace(entries, adjacency(edges), sinks, depth=4, small_edges=small).collect()) for small in (10**6, 0))
    assert one == two and len(one) > 100
