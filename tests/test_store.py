"""Sources, sinks, the pattern language and streams."""

import json

import pytest
from pyspark.sql import functions as F

from helpers import SF
from graphloom import schema
from graphloom.operators.graph import Graph
from graphloom.plans import cypher
from graphloom.plans import fixture as X
from graphloom.sources import readers, writers
from graphloom.streaming import ingest


def test_store_round_trip(spark, tmp_path):
    g = X.graph(spark, SF, {"Class", "Interface"}, {"IMPLEMENTS"})
    writers.write_store(g, str(tmp_path / "s"))
    back = readers.store(spark, str(tmp_path / "s"))
    assert back.nodes.count() == g.nodes.count() and back.edges.count() == g.edges.count()
    assert "PartitionFilters: [isnotnull(label" in back.labelled("Class")._jdf.queryExecution().toString()


def test_graph_document(spark, tmp_path):
    doc = {"repoPath": "r", "nodes": [{"id": "File:a", "label": "File", "properties": {"name": "a", "filePath": "a"}}], "relationships": [{"id": "e", "sourceId": "File:a", "targetId": "File:a", "type": "IMPORTS", "confidence": 1.0, "reason": "x"}]}
    (tmp_path / "g.json").write_text(json.dumps(doc))
    g = readers.graph_document(spark, str(tmp_path / "g.json"))
    assert g.nodes.first()["name"] == "a" and g.edges.first()["type"] == "IMPORTS"


def test_repository_and_registry(spark, tmp_path):
    (tmp_path / "r" / "d").mkdir(parents=True)
    (tmp_path / "r" / "d" / "a.py").write_text("import x\n")
    (tmp_path / "r" / "big.py").write_text("x" * 2000)
    assert [r["path"] for r in readers.repository(spark, str(tmp_path / "r"), "*.py", 1000).collect()] == ["d/a.py"]
    (tmp_path / "reg.json").write_text(json.dumps({"ingress": [{"id": "a", "language": "l", "category": "c", "pattern": "p", "description": "d"}], "egress": []}))
    assert [(r["boundary"], r["rule_ord"], r["id"]) for r in readers.registry(spark, str(tmp_path / "reg.json")).collect()] == [("ingress", 0, "a")]


def test_fingerprint_changes():
    assert schema.fingerprint(schema.NODES) != schema.fingerprint(schema.EDGES)
    assert len(schema.NODE_TABLES) == len(set(schema.NODE_TABLES)) == 32


def test_cypher(spark):
    n = spark.createDataFrame([("A:1", "A", "x", 1), ("A:2", "A", "y", 2), ("B:1", "B", "z", 3)], "id string, label string, name string, size int")
    e = spark.createDataFrame([("A:1", "B:1", "R", 0.5), ("A:2", "B:1", "R", 1.0), ("A:1", "A:2", "S", 1.0)], "sourceId string, targetId string, type string, confidence double")
    g = Graph(n, e)
    q = lambda t, **p: [tuple(r) for r in cypher.run(g, t, p).collect()]
    assert q("MATCH (a:A) RETURN a.name ORDER BY a.name DESC") == [("y",), ("x",)]
    assert q("MATCH (a:A)-[r:R]->(b:B) RETURN b.name AS b, count(*) AS n") == [("z", 2)]
    assert q("MATCH (b:B)<-[r:R]-(a)-[:S]->(c) RETURN a.name, c.name") == [("x", "y")]
    assert q("MATCH (a:A), (b:B) WHERE a.size = b.size RETURN a.id") == []
    assert q("MATCH (a {name: $n}) WHERE a.size IN [1, 5] OR NOT a.size > 0 RETURN DISTINCT a.id AS i LIMIT 3", n="x") == [("A:1",)]
    assert q("MATCH (a) WHERE a.name STARTS WITH 'z' AND a.size IS NOT NULL RETURN count(DISTINCT a.label) AS n") == [(1,)]
    assert q("MATCH (a:A) RETURN a.name AS n ORDER BY a.size SKIP 1 LIMIT 1") == [("y",)]
    assert q("MATCH (a) RETURN a.id AS i ORDER BY i LIMIT 5", x="'; DROP") != []
    for bad in ("RETURN 1", "MATCH (a", "MATCH (a) RETURN b.x", "MATCH (a), (b) RETURN a.id", "MATCH (a) WHERE a.x = $p RETURN a.id"):
        with pytest.raises(cypher.CypherError):
            cypher.run(g, bad)


def test_stream_of_edges(spark, tmp_path):
    rows = spark.createDataFrame([("a", "b", "CALLS", 1), ("a", "b", "CALLS", 2), ("b", "c", "CALLS", 3)], "sourceId string, targetId string, type string, emit_ord long")
    for k in range(2):
        rows.withColumn("emit_ord", F.col("emit_ord") + k).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
        ingest.merge_edges(stream, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_stream_windows(spark, tmp_path):
    spark.read.parquet(f"{SF}/events.parquet").select("ts", F.col("event_type").alias("path"), "user_id").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, path string, user_id long").parquet(str(tmp_path / "in"))
    for name, df in (("win", ingest.changes_per_window(stream)), ("ses", ingest.sessions(stream))):
        df.writeStream.format("memory").queryName(name).outputMode("complete" if name == "win" else "append").trigger(availableNow=True).start().awaitTermination()
    assert spark.sql("select sum(changes) from win").first()[0] == spark.read.parquet(str(tmp_path / "in")).count()


def test_diagrams(spark):
    w = spark.createDataFrame([("e", "n<x>", ["c"], [], ["s"])], "entry string, name string, controllers array<string>, services array<string>, egressSinks array<string>")
    assert "s0 --> s1" in writers.mermaid(w).first()["diagram"]
    assert "&lt;x>" in writers.svg(w).first()["svg"]
