"""The property graph's data model: labels, edge types, columns, fingerprint and declared pairs."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Labels that have a node table.
NODE_TABLES = """
File Folder Function Class Interface Method CodeElement Community Process Struct Enum Macro Typedef Union Namespace Trait Impl
TypeAlias Const Static Variable Property Record Delegate Annotation Constructor Template Module Route Tool Section BasicBlock
""".split()

#: Relationship types.
EDGE_TYPES = """
CONTAINS DEFINES IMPORTS CALLS EXTENDS IMPLEMENTS HAS_METHOD HAS_PROPERTY ACCESSES METHOD_OVERRIDES METHOD_IMPLEMENTS MEMBER_OF
STEP_IN_PROCESS HANDLES_ROUTE FETCHES HANDLES_TOOL ENTRY_POINT_OF WRAPS QUERIES INJECTS CONDITIONAL_ON DECLARES ADVISED_BY USES
INHERITS DECORATES EMITS_EVENT BINDS_EVENT_HANDLER CFG REACHING_DEF CDG POST_DOMINATE TAINTED SANITIZES TAINT_PATH CALL_SUMMARY
""".split()

#: Edge types of the program-dependence layer, left out of structural counts.
PDG_TYPES = ["CFG", "REACHING_DEF", "CDG", "POST_DOMINATE", "TAINTED", "SANITIZES", "TAINT_PATH", "CALL_SUMMARY"]

#: The 13 tables of the small store.
SMALL_TABLES = "File Folder Class Interface Method Function Property Route Process Community Section Tool CodeElement".split()

#: Labels whose text can be embedded.
EMBEDDABLE = ["Function", "Class", "Method", "Interface", "File"]

NODES = T.StructType(
    [
        *(T.StructField(n, T.StringType()) for n in ("id", "label", "name", "filePath")),
        T.StructField("startLine", T.LongType()),
        T.StructField("endLine", T.LongType()),
        T.StructField("isExported", T.BooleanType()),
        *(T.StructField(n, T.StringType()) for n in ("language", "content", "description", "method", "entryPointId", "terminalId")),
    ]
)
EDGES = T.StructType(
    [
        *(T.StructField(n, T.StringType()) for n in ("id", "sourceId", "targetId", "type")),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("reason", T.StringType()),
        T.StructField("step", T.IntegerType()),
        T.StructField("emit_ord", T.LongType()),
    ]
)


def node_id(label: str | Column, name: str | Column) -> Column:
    return F.concat_ws(":", label if isinstance(label, Column) else F.lit(label), name if isinstance(name, Column) else F.col(name))


def label_of(node: str | Column) -> Column:
    """The label that an id tells: what stands before the first colon; communities and processes have prefixes of their own."""
    c = F.col(node) if isinstance(node, str) else node
    return F.when(c.startswith("comm_"), "Community").when(c.startswith("proc_"), "Process").otherwise(F.split(c, ":", 2)[0])


def fingerprint(*schemas: T.StructType) -> str:
    """Twelve hex digits that change with any column."""
    return hashlib.sha256("\n".join(s.json() for s in schemas).encode()).hexdigest()[:12]


def pair_report(edges: DataFrame, declared: DataFrame | None = None) -> DataFrame:
    """fromLabel, toLabel, edges, declared: nothing is dropped, what is undeclared is told."""
    pairs = edges.groupBy(label_of("sourceId").alias("fromLabel"), label_of("targetId").alias("toLabel")).agg(F.count("*").alias("edges"))
    if declared is None:
        return pairs.withColumn("declared", F.lit(True))
    known = declared.select("fromLabel", "toLabel").distinct().withColumn("declared", F.lit(True))
    return pairs.join(known, ["fromLabel", "toLabel"], "left").withColumn("declared", F.coalesce("declared", F.lit(False)))
