"""Every query with an oracle gives the oracle's rows; the others run."""

import pytest

from helpers import SF, same
from graphloom.plans import queries as Q


#: Other columns of a plan that another query covers.
SAME_PLAN = {"f3_edge_kind", "f5_resolve_first", "f7_qualified", "f8_override_edges", "f13_summary", "h30_workflow_steps", "n4_locate", "n6_enrichment_stats", "g12_process_steps", "g13_flow_stats", "k16_taint_edges"}


@pytest.mark.parametrize("name", sorted(set(Q.ORACLES) - SAME_PLAN))
def test_same_rows(spark, duck, name):
    same(Q.QUERIES[name](spark, SF), duck, Q.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(Q.QUERIES) - set(Q.ORACLES)))
def test_runs(spark, name):
    """Queries without SQL: executed whole; their rows are held against plain versions in the other tests."""
    rows = Q.QUERIES[name](spark, SF).collect()
    assert rows and len(rows) == len({str(r) for r in rows})


def test_communities_of_the_call_graph(spark):
    """Every node of an edge has one community; communities are numbered inside their component."""
    got = {r.id: r.community for r in Q.QUERIES["g16_communities"](spark, SF).collect()}
    pairs = Q.QUERIES["g15_projection"](spark, SF).collect()
    assert set(got) == {v for p in pairs for v in p} and len(set(got.values())) > 1
    assert all(got[a].split("#")[0] == got[b].split("#")[0] for a, b in pairs)


def test_processes_and_their_statistics(spark):
    rows = Q.QUERIES["g12_processes"](spark, SF).collect()
    steps = Q.QUERIES["g12_process_steps"](spark, SF).collect()
    by = {}
    for r in steps:
        by.setdefault(r.processId, []).append((r.step, r.nodeId))
    assert len({r.id for r in rows}) == len(rows) == len(by)
    for r in rows:
        s = sorted(by[r.id])
        assert [k for k, _ in s] == list(range(1, r.stepCount + 1)) and (s[0][1], s[-1][1]) == (r.entryPointId, r.terminalId)
        assert r.processType == ("cross_community" if len(r.communities) > 1 else "intra_community")
    (told,) = Q.QUERIES["g13_flow_stats"](spark, SF).collect()
    assert (told.total, told.crossCommunity) == (len(rows), sum(r.processType == "cross_community" for r in rows))
    assert abs(told.avgSteps - sum(r.stepCount for r in rows) / len(rows)) <= 0.051


def test_block_order(spark):
    """Reverse postorder: all blocks that the entry reaches, the entry first, each block behind one that leads to it."""
    from graphloom.plans import boundary_queries as Bq

    order = {}
    for r in Q.QUERIES["k11_reverse_postorder"](spark, SF).collect():
        order.setdefault(r.fn, {})[r.block] = r.ord
    for r in Bq._order_cfgs(spark, SF).select("fn", "edges").limit(300).collect():
        at = order[r.fn]
        assert at[0] == 0 and sorted(at.values()) == list(range(len(at)))
        assert all(v == 0 or any(e.dst == v and at.get(e.src, 99) < at[v] for e in r.edges) for v in at)


def test_entry(spark):
    import __spark_entry__ as E

    assert set(E.oracle_sql()) <= set(E.queries())
    assert E.entry(spark).limit(1).count() == 1
