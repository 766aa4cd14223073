"""Sources to graphs: import targets, symbols, resolution in stages, control flow, partial searches, documents."""

import ast
import json
import sys

import pytest
from pyspark.sql import functions as F

from graphloom.operators import control_flow, conventions, extract, modules, pdg, relational
from graphloom.plans import repository
from graphloom.sources import writers

FILES = [
    ("app/main.py", "from .util import helper, b\nfrom app.models import user\nimport app.core.engine\nimport os\nfrom . import tools\nfrom ..x import y\n\ndef main():\n    helper()\n    lonely()\n    unknown()\n"),
    ("app/util.py", "def helper():\n    return _inner()\n\ndef _inner():\n    return 1\n"),
    ("app/tools.py", "def helper():\n    return 2\n"),
    ("app/models/__init__.py", ""),
    ("app/models/user.py", "from app.core.engine import Base\n\nclass User(Base):\n    def name(self):\n        return self.load()\n\n    def load(self):\n        return 1\n\nclass Guest(User):\n    def hello(self):\n        self.name()\n        return self.start()\n"),
    ("app/core/engine.py", "class Base:\n    def start(self):\n        return 0\n\ndef lonely():\n    pass\n"),
    ("src/main/java/com/x/A.java", "import com.x.b.B;\nimport com.x.c.*;\nimport java.util.List;\npublic class A extends B {\n}\n"),
    ("src/main/java/com/x/b/B.java", "public class B {\n}\n"),
    ("src/main/java/com/x/c/C.java", ""),
    ("src/main/java/com/x/c/D.java", ""),
    ("web/a.ts", 'import {x} from "./b";\nimport y from "../lib";\nconst z = require("./c.js");\nimport q from "@/web/d";\nimport r from "react";'),
    ("web/b.tsx", ""), ("lib/index.ts", ""), ("web/c.js", ""), ("web/d.ts", ""),
    ("cmd/main.go", 'import (\n  "fmt"\n  "github.com/o/r/pkg/util"\n)'), ("pkg/util/u.go", ""), ("pkg/util/v.go", ""),
    ("r/src/main.rs", "mod cfg;\nuse crate::net::http::Client;\nuse std::io;"), ("r/src/cfg.rs", ""), ("r/src/net/http.rs", ""),
    ("c/m.c", '#include "u.h"\n#include <inc/v.h>\n#include <stdio.h>'), ("c/u.h", ""), ("x/inc/v.h", ""),
    ("p/app/Http/C.php", "use App\\Models\\User;"), ("p/app/Models/User.php", ""), ("rb/a.rb", "require_relative 'b'\nrequire 'lib/z'"), ("rb/b.rb", ""), ("q/lib/z.rb", ""), ("j.cbl", "       COPY BOOK1."), ("k/book1.cob", ""),
    ("d/lib/m.dart", "import 'n.dart';\nimport 'package:app/o.dart';\nimport 'dart:io';"), ("d/lib/n.dart", ""), ("d/lib/o.dart", ""), ("two/same.py", ""), ("one/same.py", ""), ("z.py", "import same"), ("empty.py", None),
]
TARGETS = {
    ("app/main.py", "app/util.py"), ("app/main.py", "app/models/user.py"), ("app/main.py", "app/core/engine.py"), ("app/main.py", "app/tools.py"), ("app/models/user.py", "app/core/engine.py"), ("src/main/java/com/x/A.java", "src/main/java/com/x/b/B.java"),
    ("src/main/java/com/x/A.java", "src/main/java/com/x/c/C.java"), ("src/main/java/com/x/A.java", "src/main/java/com/x/c/D.java"), ("web/a.ts", "web/b.tsx"), ("web/a.ts", "lib/index.ts"), ("web/a.ts", "web/c.js"), ("web/a.ts", "web/d.ts"),
    ("cmd/main.go", "pkg/util/u.go"), ("cmd/main.go", "pkg/util/v.go"), ("r/src/main.rs", "r/src/cfg.rs"), ("r/src/main.rs", "r/src/net/http.rs"), ("c/m.c", "c/u.h"), ("c/m.c", "x/inc/v.h"), ("p/app/Http/C.php", "p/app/Models/User.php"),
    ("rb/a.rb", "rb/b.rb"), ("rb/a.rb", "q/lib/z.rb"), ("j.cbl", "k/book1.cob"), ("d/lib/m.dart", "d/lib/n.dart"), ("d/lib/m.dart", "d/lib/o.dart"),
}


@pytest.fixture(scope="module")
def files(spark):
    return spark.createDataFrame(FILES, "path string, content string")


def test_import_targets(files):
    """Of each language; names that two files answer as well, and those from outside, give none."""
    assert {(r.path, r.target) for r in modules.import_targets(files).collect()} == TARGETS


def test_resolution(files):
    g = repository.resolve(files)["graph"]
    ids = {r.id: (r.filePath, r.name) for r in g.nodes.collect()}
    edges = [(r.type, ids.get(r.sourceId, (None, r.sourceId)), ids.get(r.targetId, (None, r.targetId)), r.confidence, r.reason) for r in g.edges.collect()]
    calls = {(a[1], b): why for t, a, b, _, why in edges if t == "CALLS"}
    assert calls == {
        ("main", ("app/tools.py", "helper")): "import",  # both imported files have one; the first id counts among equals
        ("main", ("app/core/engine.py", "lonely")): "import",
        ("helper", ("app/util.py", "_inner")): "local",
        ("name", ("app/models/user.py", "load")): "local",
        ("hello", ("app/models/user.py", "name")): "local",
        ("hello", ("app/core/engine.py", "start")): "local",
    }
    up = {(a[1], b[1]) for t, a, b, _, _ in edges if t == "EXTENDS"}
    assert up == {("User", "Base"), ("Guest", "User"), ("A", "B")}
    sure = {b[1]: conf for t, a, b, conf, _ in edges if t == "CALLS"}
    assert sure["start"] == 1.0 and 0 < sure["lonely"] < sure["_inner"] < 1.0
    assert {b[1] for t, a, b, _, _ in edges if t == "HAS_METHOD" and a[1] == "User"} == {"name", "load"}
    assert repository.resolve(files, {"calls": False})["graph"] is None


SOURCE = '''
def plain(a):
    x = a + 1
    return x

def loop(n):
    total = 0
    for i in range(n):
        if i == 2:
            continue
        if i == 5:
            break
        total += i
    else:
        total = -1
    return total

def caught(v):
    try:
        if v > 1:
            return 1
        y = 10 // v
    except ZeroDivisionError as e:
        y = 0
    finally:
        z = 1
    return y + z

def chosen(v):
    while True:
        match v:
            case 1:
                return "one"
            case [a, b]:
                v = a
            case _:
                break
    with open("/dev/null") as f:
        f.name
    return None

def rethrown(v):
    for k in (1, 2):
        try:
            try:
                if v == k:
                    raise ValueError
                if v == 9:
                    break
            finally:
                w = k
        except ValueError:
            return -k
    return v
'''
RUNS = {"plain": [1], "loop": [0, 2, 4, 8], "caught": [0, 1, 3], "chosen": [1, [1, 2], 3], "rethrown": [1, 2, 3, 9]}


@pytest.mark.parametrize("name", list(RUNS))
def test_control_flow_is_what_runs(name):
    """Lines that follow each other when a function runs lie in one block, or are joined by edges through blocks without lines."""
    found = {r[0].split(":")[1]: r for r in control_flow.functions("m.py", SOURCE)}
    _, n, entry, exit_, edges, facts, *_ = found[name]
    assert entry == 0 and exit_ == n - 1 and all(0 <= a < n and 0 <= b < n for a, b, _ in edges)
    space: dict = {}
    exec(compile(SOURCE, "m.py", "exec"), space)
    at = {}
    for b, line, *_ in facts:
        at.setdefault(line, set()).add(b)
    quiet = set(range(n)) - {b for b, *_ in facts}
    for value in RUNS[name]:
        seen = []

        def trace(frame, event, _):
            if frame.f_code.co_filename == "m.py" and frame.f_code.co_name == name:
                if event == "line":
                    seen.append(frame.f_lineno)
                return trace
            return None

        sys.settrace(trace)
        try:
            space[name](value)
        finally:
            sys.settrace(None)
        told = [x for x in seen if x in at]
        for x, y in zip(told, told[1:]):
            if y < x and SOURCE.split("\n")[y - 1].strip().startswith("with "):
                continue  # the end of a with shows its first line again
            ok = set(at[x])
            todo = list(ok)
            while todo:
                v = todo.pop()
                for a, b, _ in edges:
                    if a == v and b not in ok:
                        ok.add(b)
                        if b in quiet:
                            todo.append(b)
            assert ok & at[y], (name, value, x, y)


def test_control_flow_feeds_dependence(spark):
    """Definitions reach uses in the graphs of real sources, those of this package too."""
    own = open(control_flow.__file__).read()
    rows = spark.createDataFrame([("m.py", SOURCE), ("own.py", own), ("broken.py", "def f(:"), ("x.txt", "def g(): pass"), ("none.py", None)], "path string, content string")
    cfgs = control_flow.python_cfgs(rows)
    names = {r.fn.split(":")[1] for r in cfgs.select("fn").collect()}
    assert set(RUNS) < names and len(names) == len(RUNS) + len({x for x in ast.walk(ast.parse(own)) if isinstance(x, ast.FunctionDef)})
    got = {(r.binding, r.def_line, r.use_line) for r in pdg.definition_facts(cfgs).filter("fn like '%:loop:%' and binding is not null").collect()}
    first = SOURCE.split("\n").index("def loop(n):") + 1
    assert {("n", first, first + 2), ("total", first + 1, first + 7), ("total", first + 7, first + 7), ("total", first + 9, first + 10), ("total", first + 7, first + 10)} <= got
    assert pdg.control_edges(cfgs).count() > 10 and pdg.block_components(cfgs).count() == cfgs.agg(F.sum("n")).first()[0]


def test_failed_files_are_counted(spark):
    failed = spark.sparkContext.accumulator(0)
    df = spark.createDataFrame([("a.py", "x"), ("b.py", "y")], "path string, content string")
    got = extract.plug_in(df, lambda p, t: [(p,)] if t == "x" else 1 / 0, "path string", failed).collect()
    assert [r.path for r in got] == ["a.py"] and failed.value == 1


def test_partial_searches(spark):
    """An index that cannot be planned, and one that breaks when it is read, cost their own rows only."""
    good = spark.createDataFrame([("a", 1), ("b", 2)], "filePath string, rank int")
    broken = good.withColumn("rank", F.raise_error(F.lit("no index")).cast("int"))
    got, failed = extract.search_all({"one": lambda: good, "two": lambda: broken, "three": lambda: spark.table("no_such_index")})
    assert sorted(map(tuple, got.collect())) == [("a", 1, "one"), ("b", 2, "one")] and set(failed) == {"two", "three"}
    assert [r.filePath for r in extract.hybrid(lambda: broken, lambda: good).collect()] == ["a", "b"]
    with pytest.raises(ValueError, match="no search"):
        extract.hybrid(lambda: broken, lambda: broken)


def test_stream(spark):
    batches = list(relational.stream(spark.range(25).repartition(3).sortWithinPartitions("id"), 10))
    assert [len(b) for b in batches] == [10, 10, 5] and sorted(r.id for b in batches for r in b) == list(range(25))
    assert next(relational.stream(spark.range(0, 10**7, 1, 10_000), 5))[4].id == 4


def test_workflow_documents(spark, tmp_path):
    w = spark.createDataFrame([("e", "GET /x", ["c"], ["s", "t"], [])], "entry string, name string, controllers array<string>, services array<string>, egressSinks array<string>")
    writers.write_workflows(w, str(tmp_path / "w"))
    (doc,) = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "w")).collect()]
    assert doc["entryPoint"] == "e" and doc["totalSteps"] == 4
    assert [(s["step"], s["role"], s["name"]) for s in doc["steps"]] == [(1, "controller", "c"), (2, "service", "s"), (3, "service", "t")]


def test_conventions(spark):
    rows = [
        ("getUser", "a.py", 0.3), ("get_user", "a.py", 1.5), ("get_user", "a.go", 1.0), ("NewServer", "x/y.go", 1.5), ("NewServer", "x/y.java", 1.0), ("createUser", "a.kt", 1.5), ("useThing", "a.ts", 1.5), ("boot", "a.php", 1.5), ("new", "a.rs", 1.5),
        ("handleX", "a.unknown", 1.5), ("viewDidLoad", "a.swift", 1.5), ("OnEvent", "a.cpp", 1.5), ("cmd_run", "a.c", 1.5), ("cmd_run", "a.cpp", 1.0), ("initState", "a.dart", 1.5), ("call", "a.rb", 1.5), ("GetAsync", "a.cs", 1.5),
    ]
    df = spark.createDataFrame(rows, "name string, path string, want double")
    assert df.filter(conventions.name_multiplier(F.col("name"), conventions.language_of(F.col("path"))) != F.col("want")).collect() == []
    paths = [
        ("src/components/Card.tsx", 1.5, "react-component"), ("src/components/card.tsx", 1.0, None), ("pages/api/x.ts", 3.0, "nextjs-api-route"), ("app/api/y/route.ts", 3.0, "nextjs-api-route"), ("app/_layout.tsx", 2.0, "expo-layout"), ("app/+html.tsx", 1.5, "expo-special-route"),
        ("app/x+api.ts", 3.0, "expo-api-route"), ("x/Hubs/ChatHub.cs", 2.5, "signalr-hub"), ("a/main.go", 3.0, "go-main"), ("main.rs", 3.0, "rust-main"), ("src/bin/t.rs", 2.5, "rust-bin"), ("app/Http/Controllers/A.php", 3.0, "laravel-controller"), ("b/Rakefile", 1.5, "ruby-rake"),
        ("Sources/MyApp.swift", 3.0, "swiftui-app"), ("lib/screens/home.dart", 2.5, "flutter-screen"), ("lib/main.dart", 3.0, "flutter-main"), ("svc/api/index.js", 1.8, "api-index"), ("c\\\\main.c", 3.0, "c-main"), (None, 1.0, None), ("README.md", 1.0, None),
    ]
    df = spark.createDataFrame(paths, "path string, m double, r string")
    m, r = conventions.path_hint(F.col("path"))
    assert df.filter((m != F.col("m")) | ~r.eqNullSafe(F.col("r"))).withColumns({"gm": m, "gr": r}).collect() == []
    hints = spark.createDataFrame([("java", "@RestController class A", "spring-annotation"), ("go", "func (c *GIN.Context)", "gin-handler"), ("go", "@RestController", None), (None, "x", None)], "l string, t string, r string")
    assert hints.filter(~conventions.definition_hint(F.col("l"), F.col("t"))["reason"].eqNullSafe(F.col("r"))).collect() == []
    assert len(conventions.PATH_RULES) > 75


def test_framework_routes(spark):
    """Routes of each framework, of data tables and of guards, and urls by constants."""
    rows = [
        ("a.py", '@app.route("/f", methods=["POST"])\n@app.route("/g")\nUSERS = "/users"\n@router.get(USERS)\n'), ("n.ts", "@Get('x/:id')\n@Post()\nif (pathname === '/old' && req.method === 'PUT') {}\nconst t = [{ method: 'GET', path: '/t', handler: list }]\n"),
        ("c.cs", '[HttpGet("y")]\n[HttpDelete]\n'), ("r.rb", "  get '/r', to: 'users#index'\n"), ("m.go", 'r.POST("/p", h.create)\nhttp.HandleFunc("/q", serve)\n'), ("s.rs", '#[put("/s")]\n'), ("k.kt", '  get("/k") {\n'),
        ("J.java", 'static final String BASE = "/b";\n@RequestMapping("/api")\n@GetMapping(BASE)\n'),
    ]
    got = {(r.framework, r.method, r.url, r.handler) for r in extract.framework_routes(spark.createDataFrame(rows, "path string, content string")).collect()}
    assert got >= {
        ("flask", "POST", "/f", None), ("flask", "*", "/g", None), ("fastapi", "GET", "/users", None), ("nestjs", "GET", "/x/:id", None), ("nestjs", "POST", "/", None), ("guard", "PUT", "/old", None), ("table", "GET", "/t", "list"), ("aspnet", "GET", "/y", None),
        ("aspnet", "DELETE", "/", None), ("rails", "GET", "/r", "users#index"), ("gin", "POST", "/p", "h.create"), ("go-http", "*", "/q", "serve"), ("actix", "PUT", "/s", None), ("ktor", "GET", "/k", None), ("spring", "GET", "/api/b", None),
    }
