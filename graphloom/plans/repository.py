"""Sources to a resolved graph: the resolution passes in order, as stages of DataFrames.

symbols, members and inheritance come from lines; imports from statements and the files that they mean; each call site then gets
candidates from its receiver's class and that one's ancestors, its own file, the imported files and names that only one symbol
has; evidence gives each candidate a confidence, the best one becomes an edge.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import extract as X
from ..operators import hierarchy as H
from ..operators import modules
from ..operators import resolution as R
from ..operators.flows import enclosing
from ..operators.graph import Graph
from ..operators.structure import folders, lines
from ..session import settle
from .stages import Stage, run

#: languages' ways to name a class's parents: pattern of the line with the class and the list of names.
PARENTS = [r"^\s*class\s+(\w+)\s*\(([\w., ]+)\)\s*:", r"\bclass\s+(\w+)(?:<[^>]*>)?\s+extends\s+([\w.]+)", r"\bclass\s+(\w+)(?:<[^>]*>)?\s*:\s*([\w., <>]+)"]
#: Words by which a method names its own object.
SELF = r"\b(?:self|this)(?:\.|->)(\w+)\s*\("
CLASSES = ("Class", "Interface", "Enum", "Struct", "Trait")
CALLABLES = ("Function", "Method")


def symbols(needs: dict) -> DataFrame:
    """id, path, line, endLine, label, name, isExported and the owner of methods: the last class before them in the file."""
    s = X.symbols(needs["files"]).withColumn("id", X.symbol_id())
    before = F.last(F.when(F.col("label").isin(*CLASSES), F.col("id")), ignorenulls=True).over(W.partitionBy("path").orderBy("line").rowsBetween(W.unboundedPreceding, -1))
    return settle(s.withColumn("owner", F.when(F.col("label") == "Method", before)))


def parents(needs: dict) -> DataFrame:
    """child, parent (ids), ord, type: names after a class, found in its file, an imported one, or nowhere else."""
    s, targets = needs["symbols"], needs["targets"]
    text = lines(needs["files"]).select("path", "line", "text")
    named = F.coalesce(*(F.when(F.col("text").rlike(rx), F.struct(F.regexp_extract("text", rx, 1).alias("name"), F.regexp_extract("text", rx, 2).alias("list"))) for rx in PARENTS))
    x = s.filter(F.col("label").isin(*CLASSES)).select(F.col("id").alias("child"), "path", "line").join(text, ["path", "line"]).withColumn("n", named).filter("n is not null")
    x = x.select("child", "path", F.posexplode(F.split("n.list", ",")).alias("ord", "raw")).withColumn("name", F.regexp_extract(F.trim("raw"), r"([A-Za-z_]\w*)(?:<.*)?$", 1)).filter("name <> ''")
    c = s.filter(F.col("label").isin(*CLASSES)).select(F.col("id").alias("parent"), F.col("path").alias("at"), "name", F.col("label").alias("kind"))
    own = x.join(c, "name").filter("path = at").select("child", "ord", "parent", "kind", F.lit(0).alias("far"))
    imported = x.join(targets.select("path", F.col("target").alias("at")).distinct(), "path").join(c, ["at", "name"]).select("child", "ord", "parent", "kind", F.lit(1).alias("far"))
    one = c.groupBy("name").agg(F.count("*").alias("n"), F.first("parent").alias("parent"), F.first("kind").alias("kind")).filter("n = 1")
    alone = x.join(one, "name").select("child", "ord", "parent", "kind", F.lit(2).alias("far"))
    best = own.union(imported).union(alone).filter("child <> parent").groupBy("child", "ord").agg(F.min(F.struct("far", "parent", "kind")).alias("b"))
    return settle(best.select("child", "b.parent", "ord", F.when(F.col("b.kind") == "Interface", "IMPLEMENTS").otherwise("EXTENDS").alias("type")))


def sites(needs: dict) -> DataFrame:
    """site, path, name, source (the callable around it), owner (its class), own: whether it calls its own object."""
    s = needs["symbols"].filter(F.col("label").isin(*CALLABLES))
    text = lines(needs["files"])
    called = lambda rx, own: text.select("path", "line", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(rx), 1))).alias("name"), F.lit(own).alias("own"))
    used = called(r"(?<![\w.>:])(\w+)\s*\(", False).union(called(SELF, True)).filter(~F.col("name").isin(X.KEYWORDS))
    spans = s.select(F.col("path").alias("filePath"), F.col("line").alias("startLine"), "endLine", "id")
    at = enclosing(used.select(F.col("path").alias("filePath"), "line").distinct(), spans).select(F.col("filePath").alias("path"), "line", F.col("id").alias("source"))
    x = used.join(at, ["path", "line"]).join(s.select(F.col("id").alias("source"), "owner", F.col("line").alias("from"), F.col("name").alias("self")), "source")
    # the line of a definition names what it defines
    x = x.filter(~((F.col("line") == F.col("from")) & (F.col("name") == F.col("self")))).select("path", "name", "source", "owner", "own").distinct()
    return settle(x.withColumn("site", F.concat_ws("|", "source", "name", F.col("own").cast("string"))))


def candidates(needs: dict) -> DataFrame:
    """site, id, origin and what evidence there is."""
    s, x, targets = needs["symbols"], needs["sites"], needs["targets"]
    defs = s.filter(F.col("label").isin(*CALLABLES) | F.col("label").isin(*CLASSES))
    row = lambda origin, depth, mro, owner: [F.lit(origin).alias("origin"), depth.cast("int").alias("scope_depth"), mro.cast("int").alias("mro_depth"), owner.alias("owner_match")]
    none, no = F.lit(None), F.lit(False)
    members = s.filter("owner is not null").select(F.col("owner").alias("class"), "name", "id")
    mro = H.ancestors(needs["parents"]).select("class", "ancestor", "depth")
    own = R.members_of(x.filter("own and owner is not null").select("site", "name", F.col("owner").alias("type")), mro, members)
    found = own.select("site", "id", *row("local", F.lit(0), F.col("mro_depth"), F.lit(True)))
    free = x.filter("not own")
    near = free.join(defs.filter("owner is null").select("path", "name", "id"), ["path", "name"]).select("site", "id", *row("local", F.lit(1), none, no))
    imported = free.join(targets.select("path", "target").distinct(), "path").join(defs.filter("owner is null").select(F.col("path").alias("target"), "name", "id"), ["target", "name"]).select("site", "id", *row("import", F.lit(1), none, no))
    found = found.union(near).union(imported).distinct()
    rest = x.join(found.select("site").distinct(), "site", "left_anti")
    one = defs.groupBy("name").agg(F.count("*").alias("n"), F.first("id").alias("id")).filter("n = 1")
    alone = rest.join(one, "name").select("site", "id", *row("global-name", F.lit(1), none, no))
    every = found.union(alone).withColumn("unlinked", F.lit(False)).withColumn("arity", F.lit("unknown")).withColumn("dynamic", F.lit(False))
    return settle(every.withColumn("confidence", R.confidence()))


def references(needs: dict) -> DataFrame:
    """sourceId, targetId, confidence, reason: the best candidate of each site."""
    best = R.rank(needs["candidates"]).filter("rn = 1")
    x = best.join(needs["sites"].select("site", "source"), "site").filter("source <> id")
    return x.groupBy(F.col("source").alias("sourceId"), F.col("id").alias("targetId")).agg(F.max("confidence").alias("confidence"), F.min_by("origin", -F.col("confidence")).alias("reason"))


def graph(needs: dict) -> Graph:
    files, s = needs["files"], needs["symbols"]
    tree = folders(files)
    null = lambda t: F.lit(None).cast(t)
    places = tree.select(F.concat_ws(":", "label", "child").alias("id"), "label", F.element_at(F.split("child", "/"), -1).alias("name"), F.col("child").alias("filePath"), null("long").alias("startLine"), null("long").alias("endLine"), null("boolean").alias("isExported"))
    nodes = places.union(s.select("id", "label", "name", "path", F.col("line").cast("long"), F.col("endLine").cast("long"), "isExported"))
    edge = lambda d, a, b, t, conf=F.lit(1.0), why=F.lit(""): d.select(a.alias("sourceId"), b.alias("targetId"), (t if not isinstance(t, str) else F.lit(t)).alias("type"), conf.cast("double").alias("confidence"), why.alias("reason"), F.lit(0).alias("step"), F.lit(0).cast("long").alias("emit_ord"))
    c, file = F.col, lambda x: F.concat(F.lit("File:"), F.col(x))
    edges = edge(tree.filter("parent is not null"), F.concat(F.lit("Folder:"), c("parent")), F.concat_ws(":", "label", "child"), "CONTAINS").union(edge(s, file("path"), c("id"), "DEFINES"))
    edges = edges.union(edge(s.filter("owner is not null"), c("owner"), c("id"), "HAS_METHOD")).union(edge(needs["parents"], c("child"), c("parent"), c("type")))
    edges = edges.union(edge(needs["targets"].select("path", "target").distinct(), file("path"), file("target"), "IMPORTS")).union(edge(needs["references"], c("sourceId"), c("targetId"), "CALLS", c("confidence"), c("reason")))
    return Graph(nodes, edges)


def resolve(files: DataFrame, options: dict | None = None) -> dict:
    """All stages' results over a repository's files (path, content): symbols, targets, parents, sites, candidates, references, and
    the graph. options["calls"] = False leaves calls out."""
    text = settle(files.select("path", "content"))
    on = lambda o: o.get("calls", True)
    return run(
        [
            Stage("files", lambda _: text),
            Stage("symbols", symbols, ("files",)),
            Stage("targets", lambda n: settle(modules.import_targets(n["files"])), ("files",)),
            Stage("parents", parents, ("files", "symbols", "targets")),
            Stage("sites", sites, ("files", "symbols"), on),
            Stage("candidates", candidates, ("symbols", "sites", "targets", "parents"), on),
            Stage("references", references, ("sites", "candidates"), on),
            Stage("graph", graph, ("files", "symbols", "targets", "parents", "references"), on),
        ],
        options,
    )
