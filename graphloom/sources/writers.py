"""Writers: graph stores, JSON documents, workflow documents, diagrams; value rules on write."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema
from ..operators.graph import Graph
from ..operators.relational import endpoints_exist


def write_store(g: Graph, root: str) -> None:
    """Nodes by label and edges by type, as Parquet; each write replaces the store. Rows of a folder are gathered before the
    write, in pieces that adaptive execution sizes, so folders hold few files and hot labels many tasks."""
    g.nodes.hint("rebalance", "label").write.mode("overwrite").partitionBy("label").parquet(f"{root}/nodes")
    g.edges.hint("rebalance", "type").write.mode("overwrite").partitionBy("type").parquet(f"{root}/edges")


def routed(edges: DataFrame) -> DataFrame:
    """edges with the label pair that each belongs to."""
    return edges.withColumn("fromLabel", schema.label_of("sourceId")).withColumn("toLabel", schema.label_of("targetId"))


def small_store(g: Graph) -> Graph:
    """The 13-table form: other labels become CodeElement, edges without both ends go."""
    nodes = g.nodes.withColumn("label", F.when(F.col("label").isin(schema.SMALL_TABLES), F.col("label")).otherwise("CodeElement"))
    return Graph(nodes, endpoints_exist(g.edges, nodes))


def metadata(g: Graph, repo: str, indexed_at: str) -> DataFrame:
    """One row with the store's statistics, as JSON."""
    n = g.nodes.agg(F.count("*").alias("nodes"), F.count_if(F.col("label") == "File").alias("files"), F.count_if(F.col("label") == "Community").alias("communities"), F.count_if(F.col("label") == "Process").alias("processes"))
    e = g.edges.agg(F.count("*").alias("edges"))
    stats = F.struct("files", "nodes", "edges", "communities", "processes")
    return n.crossJoin(e).select(F.to_json(F.struct(F.lit(repo).alias("repoPath"), F.lit(indexed_at).alias("indexedAt"), stats.alias("stats"))).alias("json"))


def json_lines(g: Graph) -> DataFrame:
    """kind and json of each node and edge; what a document of any size is written from."""
    props = [c for c in g.nodes.columns if c not in ("id", "label")]
    n = g.nodes.select(F.lit("node").alias("kind"), F.to_json(F.struct("id", "label", F.struct(*props).alias("properties"))).alias("json"))
    return n.union(g.edges.select(F.lit("relationship"), F.to_json(F.struct(*g.edges.columns))))


def workflow_json(workflows: DataFrame) -> DataFrame:
    """entry, json: each workflow (entry, name, controllers, services, egressSinks) as a document with its steps in order."""
    roles = [("controller", "controllers"), ("service", "services"), ("egress", "egressSinks")]
    told = lambda role: lambda s: F.struct(F.lit(role).alias("role"), s.alias("name"))
    steps = F.concat(*(F.transform(names, told(role)) for role, names in roles))
    numbered = F.transform(steps, lambda s, i: F.struct((i + 1).alias("step"), s["role"].alias("role"), s["name"].alias("name")))
    doc = F.struct(F.col("entry").alias("entryPoint"), "name", "controllers", "services", "egressSinks", numbered.alias("steps"), (F.size(steps) + 1).alias("totalSteps"))
    return workflows.select("entry", F.to_json(doc).alias("json"))


def write_workflows(workflows: DataFrame, path: str) -> None:
    """One document a line, wherever Spark can write."""
    workflow_json(workflows).select(F.col("json").alias("value")).write.mode("overwrite").text(path)


def mermaid(workflows: DataFrame) -> DataFrame:
    """entry, diagram: a flowchart of each workflow (entry, name, controllers, services, egressSinks)."""
    quote = lambda c: F.regexp_replace(c, r'["\[\]{}()<>]', " ")
    steps = F.concat("controllers", "services", "egressSinks")
    rows = F.transform(steps, lambda s, i: F.concat(F.lit("  s"), (i + 1).cast("string"), F.lit('["'), quote(s), F.lit('"]')))
    links = F.transform(steps, lambda s, i: F.concat(F.lit("  s"), i.cast("string"), F.lit(" --> s"), (i + 1).cast("string")))
    return workflows.select("entry", F.array_join(F.concat(F.array(F.lit("flowchart TD"), F.concat(F.lit('  s0(["'), quote(F.col("name")), F.lit('"])'))), rows, links), "\n").alias("diagram"))


def svg(workflows: DataFrame) -> DataFrame:
    """entry, svg: a card for each workflow."""
    esc = lambda c: F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    steps = F.concat(F.array("name"), "controllers", "services", "egressSinks")
    rows = F.transform(steps, lambda s, i: F.concat(F.lit('<text x="12" y="'), (i * 22 + 24).cast("string"), F.lit('">'), esc(s), F.lit("</text>")))
    return workflows.select("entry", F.concat(F.lit('<svg xmlns="http://www.w3.org/2000/svg" width="480" height="'), (F.size(steps) * 22 + 16).cast("string"), F.lit('">'), F.array_join(rows, ""), F.lit("</svg>")).alias("svg"))


def sanitised(c: Column) -> Column:
    """Text as it is stored: Unix line ends, no control characters."""
    return F.regexp_replace(F.replace(c, F.lit("\r\n"), F.lit("\n")), r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", "")


def csv_field(c: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(sanitised(F.coalesce(c, F.lit(""))), F.lit('"'), F.lit('""')), F.lit('"'))


def csv_list(c: Column) -> Column:
    """Items without what would end one."""
    return F.concat(F.lit("["), F.array_join(F.transform(c, lambda x: F.regexp_replace(x, r"[,\[\]'\"]", " ")), ","), F.lit("]"))


def with_number_defaults(nodes: DataFrame, edges: DataFrame) -> Graph:
    """Numbers as they are stored: lines -1, confidence 1, step 0 for nulls."""
    n = nodes.withColumns({c: F.coalesce(c, F.lit(-1)) for c in ("startLine", "endLine")})
    return Graph(n, edges.withColumns({"confidence": F.coalesce("confidence", F.lit(1.0)), "step": F.coalesce("step", F.lit(0))}))
