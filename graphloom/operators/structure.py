"""Structure of repositories and documents: folders, headings, sections, links, snippets, diffs, import lines, symbol search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Extensions that are scanned for imports, and path parts that are not.
SCANNED = (".java", ".py", ".ts", ".tsx", ".cs", ".cpp", ".go", ".cbl", ".cob")
SKIPPED = ("node_modules", "target")


def folders(paths: DataFrame) -> DataFrame:
    """parent, child, label of CONTAINS edges: each path's chain of folders down to the file, once each."""
    parts = F.filter(F.split("path", "/"), lambda p: p != "")
    chain = F.transform(F.sequence(F.lit(1), F.size("parts")), lambda i: F.array_join(F.slice("parts", 1, i), "/"))
    rows = paths.select(parts.alias("parts")).filter("size(parts) > 0").select(F.posexplode(chain).alias("i", "child"), F.size("parts").alias("n"), "parts")
    parent = F.when(F.col("i") > 0, F.array_join(F.slice("parts", 1, F.col("i")), "/"))
    return rows.select(parent.alias("parent"), "child", F.when(F.col("i") + 1 == F.col("n"), "File").otherwise("Folder").alias("label")).distinct()


def lines(files: DataFrame) -> DataFrame:
    """path, line (from 1), text of each line."""
    return files.select("path", F.posexplode(F.split("content", "\n")).alias("i", "text")).select("path", (F.col("i") + 1).alias("line"), "text")


def headings(files: DataFrame) -> DataFrame:
    """path, line, level, title."""
    rx = r"^(#{1,6})\s+(.+)$"
    return lines(files).filter(F.col("text").rlike(rx)).select("path", "line", F.length(F.regexp_extract("text", rx, 1)).alias("level"), F.trim(F.regexp_extract("text", rx, 2)).alias("title"))


def sections(files: DataFrame) -> DataFrame:
    """headings with end_line (the line before the next heading of the same or a higher level, else the last one) and
    parent_line (the nearest earlier heading of a higher level, else null). Arrays of one file's headings, no self-join."""
    h = headings(files).groupBy("path").agg(F.array_sort(F.collect_list(F.struct("line", "level", "title"))).alias("hs"))
    total = files.select("path", F.size(F.split("content", "\n")).alias("total"))
    x = h.join(total, "path").select("path", "total", "hs", F.explode("hs").alias("h"))
    after = F.filter("hs", lambda o: (o["line"] > F.col("h.line")) & (o["level"] <= F.col("h.level")))
    before = F.filter("hs", lambda o: (o["line"] < F.col("h.line")) & (o["level"] < F.col("h.level")))
    return x.select("path", "h.line", "h.level", "h.title", F.coalesce(F.try_element_at(after, F.lit(1))["line"] - 1, F.col("total")).alias("end_line"), F.try_element_at(before, F.lit(-1))["line"].alias("parent_line"))


def normalised(path: Column) -> Column:
    """Without . and resolved .. parts."""
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    return F.array_join(F.aggregate(parts, F.array().cast("array<string>"), lambda acc, p: F.when((p == "..") & (F.size(acc) > 0), F.slice(acc, 1, F.size(acc) - 1)).otherwise(F.when(p == "..", acc).otherwise(F.concat(acc, F.array(p))))), "/")


def links(files: DataFrame) -> DataFrame:
    """source, target: relative links between files that exist, once for each pair."""
    raw = files.select("path", F.explode(F.regexp_extract_all("content", F.lit(r"\[[^\]]*\]\(([^)]+)\)"), 1)).alias("href"))
    local = raw.filter(~F.col("href").rlike(r"^(https?://|#|mailto:)")).withColumn("href", F.split("href", "#")[0])
    folder = F.regexp_replace("path", r"[^/]*$", "")
    found = local.filter("href <> ''").select(F.col("path").alias("source"), normalised(F.concat(folder, F.col("href"))).alias("target"))
    return found.join(files.select(F.col("path").alias("target")), "target", "left_semi").filter("source <> target").select("source", "target").distinct()


def snippet(content: Column, start: Column, end: Column, around: int = 0, cap: int = 5000) -> Column:
    """Lines start to end (from 1), `around` more on both sides, cut with a marker beyond `cap` characters."""
    first = F.greatest(start - around, F.lit(1))
    text = F.array_join(F.slice(F.split(content, "\n"), first.cast("int"), F.greatest(end + around - first + 1, F.lit(0)).cast("int")), "\n")
    return F.when(F.length(text) > cap, F.concat(F.substring(text, 1, cap), F.lit("\n... [truncated]"))).otherwise(text)


def is_binary(content: Column) -> Column:
    """More than a tenth of the first 1000 characters cannot be printed."""
    head = F.substring(content, 1, 1000)
    odd = F.length(head) - F.length(F.regexp_replace(head, r"[\x00-\x08\x0E-\x1F\x7F]", ""))
    return F.coalesce(odd > F.length(head) * 0.1, F.lit(False))


def search_text(content: Column) -> Column:
    return F.regexp_replace(content, r"[\r\n\t]+", " ")


def clean_name(name: Column) -> Column:
    """Without a #n suffix; nothing gives Process."""
    return F.when(F.coalesce(name, F.lit("")) == "", "Process").otherwise(F.regexp_replace(name, r"#[0-9]+$", ""))


def last_segment(name: Column) -> Column:
    return F.element_at(F.split(name, ":"), -1)


def scannable(path: Column) -> Column:
    ok = F.lit(False)
    for ext in SCANNED:
        ok |= path.endswith(ext)
    for part in SKIPPED:
        ok &= ~path.contains(part)
    return ok & ~path.startswith(".")


def imports(files: DataFrame) -> DataFrame:
    """path, line, package: import lines; import and using lose their key word and a final semicolon, from lines stay whole."""
    t = lines(files.filter(scannable(F.col("path")))).withColumn("text", F.trim("text"))
    t = t.filter(F.col("text").rlike(r"^(import |using |from )"))
    package = F.when(F.col("text").startswith("from "), F.col("text")).otherwise(F.trim(F.regexp_replace(F.regexp_replace("text", r"^(import|using) ", ""), ";$", "")))
    return t.select("path", "line", package.alias("package"))


def hunks(diffs: DataFrame) -> DataFrame:
    """diff, filePath, startLine, endLine of unified diffs (diff, text); a hunk without lines stands at line 1 or later."""
    rows = diffs.select("diff", F.posexplode(F.split("text", "\n")).alias("i", "t"))
    named = rows.withColumn("f", F.when(F.col("t").startswith("+++ b/"), F.substring("t", 7, 10_000)).otherwise(F.when(F.col("t").startswith("+++ "), F.lit(""))))
    at = named.withColumn("filePath", F.last("f", ignorenulls=True).over(W.partitionBy("diff").orderBy("i").rowsBetween(W.unboundedPreceding, 0)))
    rx = r"^@@ -[0-9]+(,[0-9]+)? \+([0-9]+)(,([0-9]+))? @@"
    h = at.filter(F.col("t").rlike(rx) & (F.coalesce(F.col("filePath"), F.lit("")) != ""))
    start = F.regexp_extract("t", rx, 2).cast("long")
    count = F.regexp_extract("t", rx, 4)
    n = F.when(count == "", F.lit(1)).otherwise(count.try_cast("long"))
    first = F.greatest(start, F.lit(1))
    return h.select("diff", "filePath", first.alias("startLine"), F.when(n == 0, first).otherwise(start + n - 1).alias("endLine"))


#: Scores of the ways in which a line can define a symbol, tried in this order.
DEFINITIONS = [(r"\b(class|interface|struct|enum)\s+{0}\b", 100), (r"\b(def|function|func|fn)\s+{0}\b", 95), (r"\b(public|private|protected|static)\b.*\b{0}\s*\(", 90), (r"\b(const|let|var)\s+{0}\b", 80)]


def find_symbol(files: DataFrame, name: str) -> DataFrame:
    """path, line, score: the line that defines the name best, the first in order of path and line among equals."""
    quoted = "".join(ch if ch.isalnum() or ch == "_" else "\\" + ch for ch in name)
    score = F.when(F.lit(False), 0)
    for rx, points in DEFINITIONS:
        score = score.when(F.col("text").rlike(rx.format(quoted)), points)
    found = lines(files).filter(F.col("text").contains(name)).withColumn("score", score.otherwise(F.when(F.col("text").rlike(rf"\b{quoted}\b"), 1)))
    return found.filter("score is not null").orderBy(F.desc("score"), "path", "line").limit(1).select("path", "line", "score")
