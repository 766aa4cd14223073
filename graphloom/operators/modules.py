"""Import statements of sixteen languages and the files that they mean.

A statement becomes a few candidate keys in order of preference: a whole path, the end of a path, a folder, or the end of a
folder's path. Files are indexed by the same keys, one row for each key (the file or folder with the shortest path above it,
and whether another one is as near), so that a statement meets at most one row a candidate whatever its name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .conventions import language_of
from .structure import lines, normalised

#: Languages, pattern of a line that imports, whose first group is the module, and whose second one names members.
STATEMENTS = [
    ("python", r"^\s*from\s+(\.*[\w.]*)\s+import\s+\(?([\w, ]*)"),
    ("python", r"^\s*import\s+([\w.]+)()"),
    ("java", r"^\s*import\s+(?:static\s+)?([\w.]+(?:\.\*)?)\s*;()"),
    ("kotlin", r"^\s*import\s+([\w.]+(?:\.\*)?)()"),
    ("typescript javascript vue", r"""(?:\bfrom\s+|^\s*import\s+|\bimport\(\s*|\brequire\(\s*)["']([^"']+)["']()"""),
    ("csharp", r"^\s*(?:global\s+)?using\s+(?:static\s+)?([A-Z][\w.]*)\s*;()"),
    ("go", r"""^\s*(?:import\s+)?(?:[\w.]+\s+)?"([\w./-]+)"\s*$()"""),
    ("rust", r"^\s*(?:pub(?:\([a-z]+\))?\s+)?use\s+([\w:]+)()"),
    ("rust", r"^\s*(?:pub(?:\([a-z]+\))?\s+)?mod\s+(\w+)\s*;()"),
    ("c cpp", r"""^\s*#\s*include\s*["<]([^">]+)[">]()"""),
    ("php", r"^\s*use\s+(?:function\s+|const\s+)?\\?([\w\\]+)()"),
    ("ruby", r"""^\s*require(?:_relative)?\s+["']([^"']+)["']()"""),
    ("swift", r"^\s*import\s+(?:class\s+|struct\s+|func\s+)?(\w+)()"),
    ("dart", r"""^\s*(?:import|export|part)\s+["']([^"']+)["']()"""),
    ("cobol", r"(?i)\bCOPY\s+([\w-]+)()"),
]
#: Languages whose files see each other.
FAMILIES = {"typescript": "script", "javascript": "script", "vue": "script", "c": "c", "cpp": "c", "java": "jvm", "kotlin": "jvm"}


def family(language: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in FAMILIES.items() for x in kv)), language), language)


def statements(files: DataFrame) -> DataFrame:
    """path, line, language, module, members (array), text of the lines that import."""
    t = lines(files).withColumn("language", language_of(F.col("path"))).filter("language is not null")
    found = []
    for langs, rx in STATEMENTS:
        on = F.col("language").isin(*langs.split()) & F.col("text").rlike(rx)
        names = F.filter(F.transform(F.split(F.regexp_extract("text", rx, 2), ","), lambda m: F.trim(F.split(F.trim(m), " ")[0])), lambda m: m != "")
        found.append(F.when(on, F.struct(F.regexp_extract("text", rx, 1).alias("module"), names.alias("members"))))
    return t.withColumn("s", F.coalesce(*found)).filter("s is not null and s.module <> ''").select("path", "line", "language", "s.module", "s.members", "text")


def _candidates() -> Column:
    """Array of (kind, key) of a statement, the most wanted first."""
    m, folder = F.col("module"), F.regexp_replace("path", r"[^/]*$", "")
    c = lambda kind, key: F.struct(F.lit(kind).alias("kind"), key.alias("key"))
    here = lambda x: normalised(F.concat(folder, x))
    bare = lambda x: F.regexp_replace(x, r"\.[A-Za-z]+$", "")
    dots = F.length(F.regexp_extract(m, r"^(\.*)", 1))
    slashed = F.replace(F.regexp_replace(m, r"^\.+", ""), F.lit("."), F.lit("/"))
    # python: one dot is the file's own folder, each further one the folder above
    base = F.concat(F.repeat(F.lit("../"), F.greatest(dots - 1, F.lit(0)).cast("int")), slashed)
    inner = lambda x: F.when(x == "", F.lit("")).otherwise(F.concat(x, F.lit("/")))
    relative = F.concat(F.transform("members", lambda n: c("file", here(F.concat(inner(base), n)))), F.array(c("file", here(base)), c("file", here(F.concat(inner(base), F.lit("__init__"))))))
    absolute = F.concat(F.transform("members", lambda n: c("tail", F.concat(slashed, F.lit("/"), n))), F.array(c("tail", slashed), c("tail", F.concat(slashed, F.lit("/__init__")))))
    python = F.when(dots > 0, relative).otherwise(absolute)
    package = F.regexp_replace(slashed, r"/?\*$", "")
    jvm = F.when(m.endswith("*"), F.array(c("folder tail", package))).otherwise(F.array(c("tail", slashed), c("tail", F.regexp_replace(slashed, r"/[^/]+$", ""))))
    script = F.when(m.startswith("."), F.array(c("file", here(bare(m))), c("file", here(m)), c("file", here(F.concat(m, F.lit("/index")))))).when(
        m.rlike("^[@~]/"), F.array(c("tail", F.substring(bare(m), 3, 10_000)), c("tail", F.concat(F.substring(m, 3, 10_000), F.lit("/index"))))
    )
    # go: the module's own name stands before the folder, so shorter and shorter ends are tried
    parts = F.split(m, "/")
    go = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: c("folder", F.array_join(F.slice(parts, i, F.size(parts)), "/")))
    steps = F.filter(F.split(F.regexp_replace(m, r"^(crate|self|super)::", ""), "::"), lambda p: p != "")
    up = F.when(m.startswith("super::"), "../").otherwise("")
    rust_path = lambda n: F.array_join(F.slice(steps, 1, n), "/")
    rust_tail = F.flatten(F.transform(F.reverse(F.sequence(F.lit(1), F.size(steps))), lambda n: F.array(c("tail", F.concat(F.lit("src/"), rust_path(n))), c("tail", F.concat(F.lit("src/"), rust_path(n), F.lit("/mod"))))))
    rust_here = F.flatten(F.transform(F.reverse(F.sequence(F.lit(1), F.size(steps))), lambda n: F.array(c("file", here(F.concat(up, rust_path(n)))), c("file", here(F.concat(up, rust_path(n), F.lit("/mod")))))))
    rust = F.when(m.startswith("crate::"), rust_tail).when(m.rlike("^(self|super)::") | F.col("text").rlike(r"\bmod\s"), rust_here)
    include = F.array(c("whole", here(m)), c("whole tail", normalised(m)))
    php_path = F.replace(m, F.lit("\\"), F.lit("/"))
    php = F.array(c("tail", php_path), c("tail", F.regexp_replace(php_path, r"^[^/]+/", "")))
    ruby = F.when(F.col("text").contains("require_relative"), F.array(c("file", here(bare(m))))).otherwise(F.array(c("tail", bare(m))))
    dart = F.when(m.startswith("package:"), F.array(c("tail", bare(F.regexp_replace(m, r"^package:[^/]+/", "lib/"))))).when(~m.contains(":"), F.array(c("file", here(bare(m)))))
    lang = F.col("language")
    none = F.array().cast("array<struct<kind:string,key:string>>")
    out = F.when(lang == "python", python).when(lang.isin("java", "kotlin"), jvm).when(lang.isin("typescript", "javascript", "vue"), script).when(lang == "csharp", F.array(c("folder tail", slashed), c("tail", slashed)))
    out = out.when(lang == "go", go).when(lang == "rust", rust).when(lang.isin("c", "cpp"), include).when(lang == "php", php).when(lang == "ruby", ruby).when(lang == "dart", dart).when(lang == "swift", F.array(c("folder tail", m)))
    return F.coalesce(out.when(lang == "cobol", F.array(c("name", F.lower(m)))), none)


def path_index(files: DataFrame) -> DataFrame:
    """family, kind, key, target (a file, or a folder), of the keys that one file or folder has, or has nearest to the root."""
    f = files.select("path", family(language_of(F.col("path"))).alias("family")).filter("family is not null")
    parts = F.split("path", "/")
    tails = lambda p: F.transform(F.sequence(F.lit(1), F.size(F.split(p, "/"))), lambda i: F.struct((i - 1).alias("above"), F.array_join(F.slice(F.split(p, "/"), i, F.size(F.split(p, "/"))), "/").alias("key")))
    stem = F.regexp_replace("path", r"\.[^./]+$", "")
    folder = F.array_join(F.slice(parts, 1, F.size(parts) - 1), "/")
    one = lambda kind, key, target: f.select("family", F.lit(kind).alias("kind"), key.alias("key"), F.lit(0).alias("above"), target.alias("target"))
    many = lambda kind, key, target: f.filter(key != "").select("family", F.lit(kind).alias("kind"), F.explode(tails(key)).alias("t"), target.alias("target")).select("family", "kind", "t.key", "t.above", "target")
    path = F.col("path")
    rows = one("file", stem, path).union(one("whole", path, path)).union(many("tail", stem, path)).union(many("whole tail", path, path)).union(one("name", F.lower(F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1)), path))
    rows = rows.union(one("folder", folder, folder)).union(many("folder tail", folder, folder)).distinct()
    # the nearest to the root; where two are as near, the key says nothing
    best = rows.groupBy("family", "kind", "key", "above").agg(F.min("target").alias("target"), F.count("*").alias("n")).groupBy("family", "kind", "key").agg(F.min_by(F.struct("target", "n"), "above").alias("b"))
    return best.filter("b.n = 1").select("family", "kind", "key", F.col("b.target").alias("target"))


def import_targets(files: DataFrame) -> DataFrame:
    """path, line, module, target: the files that each import statement means; all files of a folder for packages. Statements that
    mean nothing in the repository, and those that two files answer equally well, give none."""
    s = statements(files)
    c = s.select("path", "line", "module", family(F.col("language")).alias("family"), F.posexplode(_candidates()).alias("ord", "c")).select("path", "line", "module", "family", "ord", "c.kind", "c.key")
    hit = c.join(path_index(files), ["family", "kind", "key"])
    python = F.col("family") == "python"
    # members of a python import may be several modules; otherwise the first candidate counts
    first = hit.withColumn("m", F.min("ord").over(W.partitionBy("path", "line", "module"))).filter((F.col("ord") == F.col("m")) | (python & F.col("key").isNotNull() & ~F.col("key").endswith("__init__")))
    to_file = first.filter(~F.col("kind").startswith("folder")).select("path", "line", "module", "target")
    inside = files.select(F.regexp_replace("path", r"/?[^/]*$", "").alias("target"), F.col("path").alias("file"), family(language_of(F.col("path"))).alias("family"))
    to_all = first.filter(F.col("kind").startswith("folder")).join(inside, ["target", "family"]).select("path", "line", "module", F.col("file").alias("target"))
    return to_file.union(to_all).filter("path <> target").distinct()
