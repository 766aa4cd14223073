"""Extraction from source text: symbols, calls, framework routes, COBOL structure, response shapes, middleware, pointcuts.

What lines can tell is a regular expression over exploded lines. What needs matching brackets is an Arrow-batched function.
Other extractors plug in as functions of (path, content) that give rows.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from py4j.protocol import Py4JError
from pyspark.accumulators import Accumulator
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import settle
from .graph import Graph
from .structure import folders, imports, lines

#: How lines of each language define symbols: extension, label, pattern with the name as its first group.
DEFINITIONS = [
    (".py", "Class", r"^\s*class\s+(\w+)"),
    (".py", "Function", r"^(?:async\s+)?def\s+(\w+)"),
    (".py", "Method", r"^\s+(?:async\s+)?def\s+(\w+)"),
    (".java", "Interface", r"\binterface\s+(\w+)"),
    (".java", "Class", r"^\s*(?:public\s+|final\s+|abstract\s+)*class\s+(\w+)"),
    (".java", "Enum", r"\benum\s+(\w+)"),
    (".java", "Method", r"^\s+(?:public|protected|private)\s+(?:static\s+|final\s+|abstract\s+)*[\w<>\[\], ?]+\s+(\w+)\s*\("),
    (".ts", "Class", r"^\s*(?:export\s+)?(?:abstract\s+)?class\s+(\w+)"),
    (".ts", "Interface", r"^\s*(?:export\s+)?interface\s+(\w+)"),
    (".ts", "Function", r"^\s*(?:export\s+)?(?:async\s+)?function\s+(\w+)"),
    (".ts", "Function", r"^\s*(?:export\s+)?const\s+(\w+)\s*=\s*(?:async\s*)?\("),
    (".go", "Function", r"^func\s+(?:\([^)]*\)\s*)?(\w+)\s*\("),
    (".cs", "Class", r"\bclass\s+(\w+)"),
    (".cs", "Interface", r"\binterface\s+(\w+)"),
    (".cs", "Method", r"^\s+(?:public|protected|private|internal)\s+(?:static\s+|async\s+|override\s+|virtual\s+)*[\w<>\[\], ?]+\s+(\w+)\s*\("),
    (".js", "Class", r"^\s*(?:export\s+)?(?:default\s+)?class\s+(\w+)"),
    (".js", "Function", r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s+(\w+)"),
    (".js", "Function", r"^\s*(?:export\s+)?const\s+(\w+)\s*=\s*(?:async\s*)?\("),
    (".tsx", "Function", r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s+(\w+)"),
    (".tsx", "Function", r"^\s*(?:export\s+)?const\s+(\w+)\s*(?::[^=]+)?=\s*(?:async\s*)?\("),
    (".jsx", "Function", r"^\s*(?:export\s+)?(?:default\s+)?function\s+(\w+)"),
    (".vue", "Function", r"^\s*(?:async\s+)?function\s+(\w+)"),
    (".kt", "Interface", r"\binterface\s+(\w+)"),
    (".kt", "Class", r"^\s*(?:(?:public|private|internal|open|abstract|data|sealed|enum)\s+)*(?:class|object)\s+(\w+)"),
    (".kt", "Method", r"^\s+(?:(?:public|private|internal|protected|open|override|suspend)\s+)*fun\s+(?:<[^>]*>\s*)?(?:\w+\.)?(\w+)\s*\("),
    (".kt", "Function", r"^(?:(?:public|private|internal|suspend|inline)\s+)*fun\s+(?:<[^>]*>\s*)?(?:\w+\.)?(\w+)\s*\("),
    (".rs", "Struct", r"^\s*(?:pub(?:\([a-z]+\))?\s+)?struct\s+(\w+)"),
    (".rs", "Enum", r"^\s*(?:pub(?:\([a-z]+\))?\s+)?enum\s+(\w+)"),
    (".rs", "Trait", r"^\s*(?:pub(?:\([a-z]+\))?\s+)?trait\s+(\w+)"),
    (".rs", "Method", r"^\s+(?:pub(?:\([a-z]+\))?\s+)?(?:async\s+|unsafe\s+|const\s+)*fn\s+(\w+)"),
    (".rs", "Function", r"^(?:pub(?:\([a-z]+\))?\s+)?(?:async\s+|unsafe\s+|const\s+)*fn\s+(\w+)"),
    (".go", "Struct", r"^type\s+(\w+)\s+struct\b"),
    (".go", "Interface", r"^type\s+(\w+)\s+interface\b"),
    (".php", "Class", r"^\s*(?:abstract\s+|final\s+)?class\s+(\w+)"),
    (".php", "Interface", r"^\s*interface\s+(\w+)"),
    (".php", "Trait", r"^\s*trait\s+(\w+)"),
    (".php", "Method", r"^\s+(?:(?:public|protected|private|static|abstract|final)\s+)*function\s+&?(\w+)"),
    (".php", "Function", r"^function\s+&?(\w+)"),
    (".rb", "Class", r"^\s*class\s+(\w+)"),
    (".rb", "Module", r"^\s*module\s+(\w+)"),
    (".rb", "Method", r"^\s+def\s+(?:self\.)?(\w+[?!]?)"),
    (".rb", "Function", r"^def\s+(\w+[?!]?)"),
    (".swift", "Class", r"^\s*(?:(?:public|open|final|private|internal)\s+)*class\s+(\w+)"),
    (".swift", "Struct", r"^\s*(?:(?:public|private|internal)\s+)*struct\s+(\w+)"),
    (".swift", "Interface", r"^\s*(?:public\s+)?protocol\s+(\w+)"),
    (".swift", "Method", r"^\s+(?:(?:public|private|internal|open|override|static|class|mutating)\s+)*func\s+(\w+)"),
    (".swift", "Function", r"^(?:public\s+)?func\s+(\w+)"),
    (".dart", "Class", r"^\s*(?:abstract\s+)?class\s+(\w+)"),
    (".dart", "Function", r"^(?:[\w<>?]+\s+)(\w+)\s*\([^;]*\)\s*(?:async\s*)?\{"),
    (".c", "Function", r"^(?:static\s+|inline\s+|const\s+|unsigned\s+|struct\s+)*\w+[\s*]+(\w+)\s*\([^;]*$"),
    (".c", "Struct", r"^\s*(?:typedef\s+)?struct\s+(\w+)"),
    (".cpp", "Class", r"^\s*class\s+(\w+)"),
    (".cpp", "Struct", r"^\s*struct\s+(\w+)"),
    (".cpp", "Method", r"^[\w:<>*&\s]+\s[\w<>]+::(~?\w+)\s*\("),
    (".cpp", "Function", r"^(?:static\s+|inline\s+|const\s+)*[\w:<>]+[\s*&]+(\w+)\s*\([^;]*$"),
]
KEYWORDS = ["if", "for", "while", "switch", "catch", "return", "new", "function", "def", "class", "super", "elif", "print", "throw", "else"]


def symbols(files: DataFrame) -> DataFrame:
    """path, line, endLine (before the next symbol of the file, else its last line), label, name, isExported."""
    found = []
    text = lines(files)
    for ext, label, rx in DEFINITIONS:
        cond = F.col("path").endswith(ext) & F.col("text").rlike(rx)
        found.append(F.when(cond, F.struct(F.lit(label).alias("label"), F.regexp_extract("text", rx, 1).alias("name"))))
    s = text.withColumn("d", F.coalesce(*found)).filter("d is not null and d.name <> ''").filter(~F.col("d.name").isin(KEYWORDS))
    total = files.select("path", F.size(F.split("content", "\n")).alias("total"))
    end = F.coalesce(F.lead("line").over(W.partitionBy("path").orderBy("line")) - 1, F.col("total"))
    exported = F.when(F.col("path").rlike(r"\.(py|rb|dart)$"), ~F.col("d.name").startswith("_")).when(F.col("path").endswith(".go"), F.col("d.name").rlike("^[A-Z]"))
    exported = exported.when(F.col("path").rlike(r"\.(c|cpp)$"), ~F.col("text").rlike(r"\bstatic\b")).when(F.col("path").rlike(r"\.(kt|php)$"), ~F.col("text").rlike(r"\b(private|protected|internal)\b")).otherwise(F.col("text").rlike(r"\b(public|export|pub|open)\b"))
    return s.join(total, "path").select("path", "line", end.alias("endLine"), "d.label", "d.name", exported.alias("isExported"))


def calls(files: DataFrame, found: DataFrame) -> DataFrame:
    """sourceId, targetId, confidence, reason: names that are called inside a symbol's lines. In the same file 0.9; elsewhere
    0.5 if just one symbol has the name; ambiguous names give nothing."""
    from .flows import enclosing

    used = lines(files).select("path", "line", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"\b(\w+)\s*\("), 1))).alias("name")).filter(~F.col("name").isin(KEYWORDS))
    ids = found.filter(F.col("label").isin("Function", "Method")).withColumn("id", symbol_id())
    spans = ids.select(F.col("path").alias("filePath"), F.col("line").alias("startLine"), "endLine", "id")
    at = enclosing(used.select(F.col("path").alias("filePath"), "line"), spans).select(F.col("filePath").alias("path"), "line", F.col("id").alias("sourceId"))
    sites = used.join(at, ["path", "line"]).select("path", "name", "sourceId").distinct()
    own = ids.groupBy("path", "name").agg(F.min("id").alias("near"))
    one = ids.groupBy("name").agg(F.count("*").alias("n"), F.min("id").alias("far")).filter("n = 1")
    x = sites.join(own, ["path", "name"], "left").join(one, "name", "left")
    target = F.coalesce("near", "far")
    return x.filter(target.isNotNull() & (target != F.col("sourceId"))).select("sourceId", target.alias("targetId"), F.when(F.col("near").isNotNull(), 0.9).otherwise(0.5).alias("confidence"), F.when(F.col("near").isNotNull(), "same-file").otherwise("unique-name").alias("reason")).distinct()


def symbol_id() -> Column:
    return F.concat_ws(":", "label", "path", "name", F.col("line").cast("string"))


def repository_graph(files: DataFrame) -> Graph:
    """A graph of a repository (path, content): folders, files, symbols, CONTAINS, DEFINES, CALLS, and IMPORTS by module name."""
    tree = folders(files)
    places = tree.select(F.concat_ws(":", "label", "child").alias("id"), "label", F.element_at(F.split("child", "/"), -1).alias("name"), F.col("child").alias("filePath"), F.lit(None).cast("long").alias("startLine"), F.lit(None).cast("long").alias("endLine"), F.lit(None).cast("boolean").alias("isExported"))
    s = symbols(files)
    defs = s.select(symbol_id().alias("id"), "label", "name", F.col("path").alias("filePath"), F.col("line").cast("long").alias("startLine"), F.col("endLine").cast("long").alias("endLine"), "isExported")
    edge = lambda d, t: d.select("sourceId", "targetId", F.lit(t).alias("type"), F.coalesce(F.col("confidence"), F.lit(1.0)).alias("confidence"), F.coalesce(F.col("reason"), F.lit("")).alias("reason"), F.lit(0).alias("step"), F.lit(0).cast("long").alias("emit_ord"))
    plain = lambda d: d.withColumn("confidence", F.lit(1.0)).withColumn("reason", F.lit(""))
    contains = plain(tree.filter("parent is not null").select(F.concat(F.lit("Folder:"), "parent").alias("sourceId"), F.concat_ws(":", "label", "child").alias("targetId")))
    defines = plain(s.select(F.concat(F.lit("File:"), "path").alias("sourceId"), symbol_id().alias("targetId")))
    stem = F.regexp_extract("path", r"([^/]+)\.\w+$", 1)
    word = F.regexp_replace(F.regexp_extract("package", r"(?:from\s+)?['\"]?([\w./]+)['\"]?", 1), r"^.*[./]", "")
    used = imports(files).select("path", word.alias("module")).filter("module <> ''").distinct()
    targets = files.select(stem.alias("module"), F.col("path").alias("target")).filter("module <> ''")
    imported = plain(used.join(targets, "module").filter("path <> target").select(F.concat(F.lit("File:"), "path").alias("sourceId"), F.concat(F.lit("File:"), "target").alias("targetId")).distinct())
    return Graph(places.unionByName(defs), edge(contains, "CONTAINS").union(edge(defines, "DEFINES")).union(edge(imported, "IMPORTS")).union(edge(calls(files, s), "CALLS")))


def plug_in(files: DataFrame, extractor: Callable[[str, str], list[tuple]], schema: str, failed: Accumulator | None = None) -> DataFrame:
    """Rows of any extractor of (path, content), in batches; a file that fails gives none and adds one to the counter."""
    names = [f.name for f in T.StructType.fromDDL(schema).fields]

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    rows += extractor(path, content or "")
                except Exception:  # one unreadable file must not stop a repository
                    if failed is not None:
                        failed.add(1)
            yield pd.DataFrame(rows, columns=names)

    return files.select("path", "content").mapInPandas(run, schema)


# --- framework routes -----------------------------------------------------------------------------

#: Framework, pattern of a line, and which groups hold the verb, the path and the handler.
ROUTES = [
    ("spring", r'@(Get|Post|Put|Patch|Delete)Mapping\(\s*(?:value\s*=\s*|path\s*=\s*)?"([^"]*)"', (1, 2, 0)),
    ("fastapi", r"""@\w+\.(get|post|put|patch|delete)\(\s*["']([^"']*)["']""", (1, 2, 0)),
    ("django", r"""\b(?:re_)?path\(\s*r?["']([^"']*)["']\s*,\s*([\w.]+)""", (0, 1, 2)),
    ("laravel", r"""Route::(get|post|put|patch|delete|any|resource)\(\s*["']([^"']*)["']\s*,\s*\[?([\w\\]+)""", (1, 2, 3)),
    ("express", r"""\b(?:app|router)\.(get|post|put|patch|delete|all)\(\s*["'`]([^"'`]*)["'`]\s*,\s*([\w.]+)?""", (1, 2, 3)),
    ("flask", r"""@\w+\.route\(\s*["']([^"']*)["'](?:.*methods\s*=\s*\[\s*["'](\w+)["'])?""", (2, 1, 0)),
    ("nestjs", r"""@(Get|Post|Put|Patch|Delete)\(\s*(?:["'`]([^"'`]*)["'`])?\s*\)""", (1, 2, 0)),
    ("aspnet", r"""\[Http(Get|Post|Put|Patch|Delete)(?:\(\s*"([^"]*)"\s*[^)]*\))?\]""", (1, 2, 0)),
    ("rails", r"""^\s*(get|post|put|patch|delete)\s+["']([^"']*)["']\s*(?:=>|,\s*to:)\s*["']([\w/#]+)["']""", (1, 2, 3)),
    ("gin", r"""\b\w+\.(GET|POST|PUT|PATCH|DELETE)\(\s*"([^"]*)"\s*,\s*([\w.]+)""", (1, 2, 3)),
    ("go-http", r"""\bhttp\.HandleFunc\(\s*"([^"]*)"\s*,\s*([\w.]+)""", (0, 1, 2)),
    ("actix", r"""^\s*#\[(get|post|put|patch|delete)\(\s*"([^"]*)"\s*\)\]""", (1, 2, 0)),
    ("ktor", r"""^\s*(get|post|put|patch|delete)\(\s*"([^"]*)"\s*\)\s*\{""", (1, 2, 0)),
    ("table", r"""\bmethod\s*:\s*["'](GET|POST|PUT|PATCH|DELETE)["'].*?\b(?:path|url)\s*:\s*["']([^"']*)["'](?:.*?\bhandler\s*:\s*([\w.]+))?""", (1, 2, 3)),
    ("guard", r"""\b(?:pathname|path|url)\s*===?\s*["'](/[^"']*)["'](?:.*\bmethod\s*===?\s*["'](\w+)["'])?""", (2, 1, 0)),
]


def with_constants(text: DataFrame) -> DataFrame:
    """Lines with the names that stand where a route's url is expected replaced by what the file says they are: NAME = "value"."""
    said = r"""^\s*(?:export\s+)?(?:public\s+|private\s+|static\s+|final\s+)*(?:const\s+|let\s+|String\s+)?([A-Z][A-Z0-9_]+)\s*(?::[^=]+)?=\s*["']([^"']*)["']"""
    asked = r"""(?:\(|,\s*|=\s*)([A-Z][A-Z0-9_]+)\s*[,)]"""
    known = text.filter(F.col("text").rlike(said)).groupBy("path", F.regexp_extract("text", said, 1).alias("name")).agg(F.min_by(F.regexp_extract("text", said, 2), "line").alias("value"))
    x = text.withColumn("name", F.when(~F.col("text").rlike(said), F.regexp_extract("text", asked, 1))).join(known, ["path", "name"], "left")
    at = F.instr("text", F.col("name"))
    put = F.concat(F.substr("text", F.lit(1), at - 1), F.lit('"'), F.col("value"), F.lit('"'), F.substr("text", at + F.length("name")))
    return x.select("path", "line", F.when(F.col("value").isNotNull(), put).otherwise(F.col("text")).alias("text"))


def framework_routes(files: DataFrame) -> DataFrame:
    """path, line, framework, method, url, handler; a class's own mapping is the prefix of its methods' paths. Urls may be names of
    string constants of the same file."""
    from .boundary import route_method, route_path

    text = with_constants(lines(files))
    prefix = text.filter(F.col("text").rlike(r"@RequestMapping\(")).groupBy("path").agg(F.min_by(F.regexp_extract("text", r'@RequestMapping\(\s*(?:value\s*=\s*|path\s*=\s*)?"([^"]*)"', 1), "line").alias("prefix"))
    out = None
    for name, rx, (m, p, h) in ROUTES:
        part = lambda g: F.regexp_extract("text", rx, g) if g else F.lit("")  # noqa: B023, E731
        hit = text.filter(F.col("text").rlike(rx)).select("path", "line", F.lit(name).alias("framework"), part(m).alias("verb"), part(p).alias("raw"), part(h).alias("handler"))
        out = hit if out is None else out.union(hit)
    out = out.join(prefix, "path", "left")
    own = F.when(F.col("framework") == "spring", F.col("prefix"))
    verb = F.when(F.col("verb").isin("all", "any", ""), "*").otherwise(F.col("verb"))
    return out.select("path", "line", "framework", route_method(verb).alias("method"), route_path(F.col("raw"), own).alias("url"), F.when(F.col("handler") != "", F.col("handler")).alias("handler"))


# --- COBOL ----------------------------------------------------------------------------------------

#: What lines of programs and job control tell: kind, and pattern with the name as its group.
COBOL = [
    ("program", r"(?i)PROGRAM-ID\.\s+([\w-]+)"), ("section", r"(?i)^\s*([\w-]+)\s+SECTION\s*\."), ("perform", r"(?i)\bPERFORM\s+([\w-]+)"), ("call", r"""(?i)\bCALL\s+["']([\w-]+)["']"""),
    ("copy", r"(?i)\bCOPY\s+([\w-]+)"), ("sql", r"(?i)EXEC\s+SQL.*?\b(?:FROM|INTO|UPDATE)\s+([\w.-]+)"), ("cics", r"(?i)EXEC\s+CICS\s+(\w+)"), ("dli", r"(?i)EXEC\s+DLI\s+(\w+)"), ("job", r"^//(\w+)\s+JOB\b"), ("exec", r"^//\w*\s+EXEC\s+(?:PGM=)?(\w+)"),
]


def cobol(files: DataFrame) -> DataFrame:
    """path, line, kind, name of programs and job control; comment lines (column 7) say nothing, key words are no names."""
    text = lines(files.filter(F.col("path").rlike(r"(?i)\.(cbl|cob|cpy|jcl)$"))).filter(~F.col("text").rlike(r"^.{6}[*/]") & ~F.col("text").startswith("//*"))
    each = F.array(*(F.struct(F.lit(k).alias("kind"), F.regexp_extract("text", rx, 1).alias("name")) for k, rx in COBOL))
    return text.select("path", "line", F.explode(each).alias("f")).select("path", "line", "f.kind", F.upper("f.name").alias("name")).filter("name <> '' and not (kind = 'perform' and name in ('UNTIL', 'VARYING', 'TIMES')) and not (kind = 'section' and name in ('INPUT-OUTPUT', 'FILE', 'WORKING-STORAGE', 'LINKAGE', 'CONFIGURATION'))")


# --- response shapes and middleware -----------------------------------------------------------------


def object_keys(text: str, at: int) -> tuple[list[str], int]:
    """Keys at the first level of the object that opens at `at`, and where it ends; strings and nested brackets are skipped."""
    keys, depth, i, expect = [], 0, at, False
    while i < len(text):
        ch = text[i]
        if ch in "\"'`":
            j = i + 1
            while j < len(text) and text[j] != ch:
                j += 2 if text[j] == "\\" else 1
            if depth == 1 and expect and re.match(r"\s*:", text[j + 1 :]):
                keys.append(text[i + 1 : j])
                expect = False
            i = j + 1
            continue
        if ch in "{[(":
            depth += 1
            expect = depth == 1 and ch == "{"
        elif ch in "}])":
            depth -= 1
            if depth == 0:
                return keys, i
        elif ch == "," and depth == 1:
            expect = True
        elif depth == 1 and expect and (m := re.compile(r"[A-Za-z_$][\w$]*").match(text, i)):
            if re.match(r"\s*[:,}]", text[m.end() :]):
                keys.append(m[0])
            expect = False
            i = m.end()
            continue
        elif depth == 1 and not ch.isspace():
            expect = False
        i += 1
    return keys, i


def shapes(text: str) -> tuple[list[str], list[str]]:
    """Keys of answers and of errors (status 400 and above) of .json({...}) calls."""
    good, bad = [], []
    for m in re.finditer(r"\.json\(\s*(?=\{)", text):
        keys, end = object_keys(text, m.end())
        before = re.search(r"status\(\s*(\d{3})\s*\)\s*$", text[: m.start()])
        after = re.match(r"\s*,\s*\{[^}]*\bstatus:\s*(\d{3})", text[end + 1 :])
        status = int((before or after)[1]) if before or after else 200
        (bad if status >= 400 else good).extend(keys)
    return list(dict.fromkeys(good)), list(dict.fromkeys(bad))


def response_shapes(files: DataFrame) -> DataFrame:
    """path, responseKeys, errorKeys of files that answer with JSON."""
    return plug_in(files, lambda p, t: [(p, *s)] if any(s := shapes(t)) else [], "path string, responseKeys array<string>, errorKeys array<string>")


def chain(text: str) -> tuple[str, list[str]] | None:
    """The wrapped handler's method and its wrappers, outermost first, if there are two or one that is called with..."""
    m = re.search(r"export\s+(?:const\s+(GET|POST|PUT|PATCH|DELETE)\s*=|default)\s*", text)
    if not m:
        return None
    found, rest = [], text[m.end() :]
    while w := re.match(r"\s*(\w+)\s*\(", rest):
        if w[1] in ("async", "function"):
            break
        found.append(w[1])
        rest = rest[w.end() :]
    return (m[1] or "default", found) if len(found) > 1 or (found and re.match("with[A-Z]", found[0])) else None


def middleware_chains(files: DataFrame) -> DataFrame:
    """path, method, chain."""
    return plug_in(files, lambda p, t: [(p, *c)] if (c := chain(t)) else [], "path string, method string, chain array<string>")


def matches(matcher: Column, url: Column) -> Column:
    """Whether a middleware matcher takes a route: /:path* is a prefix, brackets are a pattern, everything else is exact."""
    prefix = F.regexp_replace(matcher, r"/:\w+\*$", "")
    return F.when(matcher.rlike(r"/:\w+\*$"), (url == prefix) | url.startswith(F.concat(prefix, F.lit("/")))).when(matcher.contains("("), F.regexp_like(url, F.concat(F.lit("^"), matcher, F.lit("$")))).otherwise(url == matcher)


def applied_middleware(routes: DataFrame, matchers: list[str]) -> DataFrame:
    """Routes (url) that a middleware with these matchers takes; without matchers it takes all."""
    ok = F.lit(not matchers)
    for m in matchers:
        ok |= matches(F.lit(m), F.col("url"))
    return routes.filter(ok)


# --- aspects --------------------------------------------------------------------------------------


def pointcut_pattern(pointcut: Column) -> Column:
    """The pattern of class and method names (a.b.C.m) of an execution or within expression."""
    body = F.regexp_replace(F.regexp_extract(pointcut, r"(?:execution|within)\(\s*(?:public\s+|protected\s+)?(?:[\w*.<>]+\s+)?([\w.*]+)", 1), r"\.", "\\\\.")
    body = F.regexp_replace(body, r"\\\.\\\.", "@")  # two dots: any packages
    body = F.regexp_replace(F.regexp_replace(body, r"\*", "[^.]*"), "@", "(?:\\\\.|\\\\..*\\\\.)")
    return F.concat(F.lit("^"), body, F.when(pointcut.startswith("within"), "(\\.[^.]+)?").otherwise(""), F.lit("$"))


def advised(aspects: DataFrame, candidates: DataFrame) -> DataFrame:
    """ADVISED_BY: methods (method, qualified, annotations) that a pointcut (aspect, pointcut) takes; 1.0, for annotations
    0.95. A pointcut meets only methods that share a whole name with it: the method's own where the pointcut spells it out, else
    its class, else a package; pointcuts of wild cards alone meet all methods, once each pattern."""
    note = F.regexp_extract("pointcut", r"@annotation\(\s*(?:[\w.]*\.)?(\w+)\s*\)", 1)
    tagged = aspects.withColumn("note", note).filter("note <> ''").join(candidates.select("method", F.explode("annotations").alias("note")), "note").select("method", "aspect", F.lit(0.95).alias("confidence"))
    body = F.regexp_extract("pointcut", r"(?:execution|within)\(\s*(?:public\s+|protected\s+)?(?:[\w*.<>]+\s+)?([\w.*]+)", 1)
    whole = F.filter(F.split(body, r"\."), lambda p: (p != "") & ~p.contains("*"))
    x = aspects.filter(F.col("pointcut").rlike(r"^(execution|within)\(")).withColumn("rx", pointcut_pattern(F.col("pointcut"))).withColumn("word", F.coalesce(F.try_element_at(whole, F.lit(-1)), F.lit("*")))
    words = candidates.select("method", "qualified", F.explode(F.array_distinct(F.concat(F.split("qualified", r"\."), F.array(F.lit("*"))))).alias("word"))
    named = x.join(words, "word").filter(F.regexp_like("qualified", F.col("rx"))).select("method", "aspect", F.lit(1.0).alias("confidence"))
    return named.union(tagged).groupBy("method", "aspect").agg(F.max("confidence").alias("confidence"))


# --- registries, context, orchestration --------------------------------------------------------------


def current_entries(registry: DataFrame) -> DataFrame:
    """The newest entry of each repository and branch (repo, branch, indexedAt)."""
    return registry.withColumn("rn", F.row_number().over(W.partitionBy("repo", "branch").orderBy(F.desc("indexedAt")))).filter("rn = 1").drop("rn")


def context(g: Graph, node: str) -> DataFrame:
    """direction, type, other: all edges of a node."""
    out = g.edges.filter(F.col("sourceId") == node).select(F.lit("out").alias("direction"), "type", F.col("targetId").alias("other"))
    return out.union(g.edges.filter(F.col("targetId") == node).select(F.lit("in"), "type", "sourceId"))


def name_search(nodes: DataFrame, text: str, labels: list[str] | None = None) -> DataFrame:
    x = nodes.filter(F.col("label").isin(labels)) if labels else nodes
    return x.filter(F.lower("name").contains(text.lower()))


def first_traces(traces: DataFrame, scores: DataFrame, most: int) -> DataFrame:
    """Traces in the order of their entries' scores, up to the entry that brings them to twice the wanted number. Entries are
    at most the candidates, so their order is one small window."""
    n = traces.groupBy("entry").agg(F.count("*").alias("n")).join(scores.select(F.col("id").alias("entry"), "score"), "entry")
    before = F.coalesce(F.sum("n").over(W.orderBy(F.desc("score"), "entry").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return traces.join(n.withColumn("before", before).filter(F.col("before") < 2 * most).select("entry"), "entry", "left_semi")


def search_all(indexes: dict[str, Callable[[], DataFrame]]) -> tuple[DataFrame | None, dict[str, str]]:
    """Rows of all indexes (each a function that gives one table), with a column `index`, and why others failed. Each one is run
    by itself, so an index that is missing or broken when it is read costs its own rows only; None if all fail."""
    out, failed = None, {}
    for name, ask in indexes.items():
        try:
            got = settle(ask().withColumn("index", F.lit(name)))
        except (PySparkException, Py4JError) as e:
            failed[name] = str(e).splitlines()[0]
            continue
        out = got if out is None else out.unionByName(got)
    return out, failed


def hybrid(lexical: Callable[[], DataFrame], semantic: Callable[[], DataFrame], limit: int = 10) -> DataFrame:
    """Fusion of two searches that give (filePath, rank); one that fails, when it is planned or when it runs, is left out, both
    failing is an error."""
    from .search import fuse

    got, failed = search_all({"bm25": lexical, "semantic": semantic})
    if got is None:
        raise ValueError(f"no search succeeded: {failed}")
    return fuse({name: got.filter(F.col("index") == name).select("filePath", "rank") for name in ("bm25", "semantic") if name not in failed}, limit)


def label_spreading(pairs: DataFrame, rounds: int = 8) -> DataFrame:
    """id, community: another engine for communities: each node takes the most frequent label around it, the smallest among
    equals. Joins only, a fixed number of rounds."""
    both = settle(pairs.select(F.col("a").alias("id"), F.col("b").alias("n")).union(pairs.select("b", "a")).distinct())
    label = settle(both.select("id", F.col("id").alias("community")).distinct())
    for _ in range(rounds):
        votes = both.join(label.select(F.col("id").alias("n"), "community"), "n").groupBy("id", "community").agg(F.count("*").alias("v"))
        label = settle(votes.groupBy("id").agg(F.min_by("community", F.struct(-F.col("v"), F.col("community"))).alias("community")))
    return label


def enriched_clusters(clusters: DataFrame, members: DataFrame, describe: Callable[[str, list[str]], str] | None = None) -> DataFrame:
    """community, keywords, description: the names most frequent among members' words, and what `describe` makes of them (by
    default a sentence)."""
    words = members.select("community", F.explode(F.regexp_extract_all(F.regexp_replace("name", "([a-z])([A-Z])", "$1 $2"), F.lit(r"([A-Za-z]{3,})"), 1)).alias("w")).select("community", F.lower("w").alias("w"))
    top = words.groupBy("community", "w").agg(F.count("*").alias("n")).withColumn("rn", F.row_number().over(W.partitionBy("community").orderBy(F.desc("n"), "w"))).filter("rn <= 5")
    k = top.groupBy("community").agg(F.transform(F.array_sort(F.collect_list(F.struct("rn", "w"))), lambda x: x["w"]).alias("keywords"))
    x = clusters.join(k, "community", "left").withColumn("keywords", F.coalesce("keywords", F.array().cast("array<string>")))
    if describe is None:
        return x.select("community", "keywords", F.concat(F.lit("Symbols about "), F.array_join("keywords", ", ")).alias("description"))

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            yield pdf.assign(description=[describe(c, list(w)) for c, w in zip(pdf["community"], pdf["keywords"], strict=True)])

    return x.select("community", "keywords").mapInPandas(run, "community string, keywords array<string>, description string")
