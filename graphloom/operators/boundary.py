"""Ingress and egress boundaries, routes, fetches, queries, tools, injection, configuration and workflows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .closure import bounded_search
from .structure import clean_name, last_segment

# --- registry -------------------------------------------------------------------------------------


def match_rules(imports: DataFrame, rules: DataFrame) -> DataFrame:
    """boundary, category, package, file, description: for each import line the first ingress and the first egress rule that
    matches. Rules are a short ordered table: they become one expression, evaluated in the scan."""
    told = {}
    for r in rules.orderBy("boundary", "rule_ord").collect():
        told.setdefault(r["boundary"], []).append(r)
    found = []
    for boundary, rs in told.items():
        pick = F.when(F.lit(False), F.struct(F.lit("").alias("category"), F.lit("").alias("description")))
        for r in rs:
            pick = pick.when(F.col("package").rlike(r["pattern"]), F.struct(F.lit(r["category"]).alias("category"), F.lit(r["description"]).alias("description")))
        found.append(F.struct(F.lit(boundary).alias("boundary"), pick.alias("r")))
    x = imports.withColumn("f", F.explode(F.array(*found))).filter("f.r is not null")
    return x.select("f.boundary", "f.r.category", "package", F.col("path").alias("file"), "f.r.description")


def route_findings(routes: DataFrame) -> DataFrame:
    return routes.select(F.lit("ingress").alias("boundary"), F.lit("HTTP / REST Route").alias("category"), F.concat_ws(" ", F.coalesce("method", F.lit("GET")), "name").alias("package"), F.col("filePath").alias("file"), F.lit("Exposed REST API Endpoint").alias("description"))


def dedupe_findings(findings: DataFrame, order: str | None = None) -> DataFrame:
    """One row for each boundary, category, package and file; the last description stays."""
    keys = ["boundary", "category", "package", "file"]
    return findings.groupBy(*keys).agg((F.max_by("description", order) if order else F.max("description")).alias("description"))


def registry_upsert(rules: DataFrame, new: DataFrame) -> DataFrame:
    return rules.join(new.select("boundary", "id"), ["boundary", "id"], "left_anti").unionByName(new, allowMissingColumns=True)


def registry_remove(rules: DataFrame, boundary: str, rule: str) -> DataFrame:
    return rules.filter(~((F.col("boundary") == boundary) & (F.col("id") == rule)))


def flow_summaries(processes: DataFrame) -> DataFrame:
    return processes.select("id", last_segment(F.col("entryPointId")).alias("entry"), last_segment(F.col("terminalId")).alias("exit"), F.col("stepCount").alias("hops"))


# --- routes ---------------------------------------------------------------------------------------

#: Verbs of routes.
METHODS = ["GET", "POST", "PUT", "PATCH", "DELETE", "HEAD", "OPTIONS", "TRACE", "CONNECT"]


def _bare(c: Column) -> Column:
    return F.regexp_replace(F.trim(c), "^/+|/+$", "")


def route_path(path: Column, prefix: Column) -> Column:
    p, q = _bare(path), _bare(F.coalesce(prefix, F.lit("")))
    joined = F.when(q != "", F.concat(F.lit("/"), q, F.when(p != "", F.concat(F.lit("/"), p)).otherwise(""))).otherwise(F.concat(F.lit("/"), p))
    return F.regexp_replace(joined, "/+", "/")


def route_method(raw: Column) -> Column:
    verb = F.upper(F.trim(raw))
    return F.when((verb == "*") | verb.isin(METHODS), verb)


def route_key(method: Column, url: Column) -> Column:
    return F.when(method.isNotNull() & (method != "*"), F.concat(method, F.lit(" "), url)).otherwise(url)


def filesystem_route(path: Column) -> Column:
    """The URL of an app or pages router file, or of a PHP page below api; null for others."""
    p = F.replace(path, F.lit("\\"), F.lit("/"))
    app = F.regexp_extract(p, r"app/(.+?)/route\.(?:ts|js|tsx|jsx)$", 1)
    stripped = F.regexp_replace(app, r"\([^)]+\)/?", "")
    pages = F.regexp_extract(p, r"pages/(api/.+?)\.(?:ts|js|tsx|jsx)$", 1)
    php = F.regexp_extract(p, r"(?:^|/)(api/.+?)\.php$", 1)
    return (
        F.when((app != "") & (stripped.startswith("api/") | (stripped == "api")), F.concat(F.lit("/"), stripped))
        .when(app != "", F.lit(None))
        .when(pages != "", F.concat(F.lit("/"), F.regexp_replace(pages, "/index$", "")))
        .when(php != "", F.concat(F.lit("/"), php))
    )


def register_routes(routes: DataFrame, order: list[str]) -> DataFrame:
    """The first route of each key in the given order, with the number of those after it."""
    x = routes.withColumn("key", route_key(F.col("method"), F.col("url")))
    w = W.partitionBy("key")
    return x.withColumn("rn", F.row_number().over(w.orderBy(*order))).withColumn("duplicates", F.count("*").over(w) - 1).filter("rn = 1").drop("rn")


def fetch_url(raw: Column) -> Column:
    """A fetched URL as a path with [param] for expressions; null if it cannot be known."""
    u = F.split(raw, r"\?")[0]
    u = F.regexp_replace(u, r"\$\{[^}]+\}", "[param]")
    u = F.regexp_replace(F.regexp_replace(u, "^`|`$", ""), r"\.(php|asp|aspx|jsp|cgi)$", "")
    return F.when(~u.contains("+") & ~u.contains("(") & u.startswith("/"), u)


def _segments(c: Column) -> Column:
    return F.filter(F.split(c, "/"), lambda p: p != "")


def match_fetches(fetches: DataFrame, routes: DataFrame) -> DataFrame:
    """source, fetch, route, ord: the first route (url, ord) that each fetch (source, url) matches. Routes meet their
    fetches by the number of segments and the first one, catch-all routes by the first one."""
    f = fetches.withColumn("fetch", fetch_url(F.col("url"))).filter("fetch is not null").select("source", "fetch", _segments(F.col("fetch")).alias("fs")).distinct()
    r = routes.select(F.col("url").alias("route"), "ord", _segments(F.col("url")).alias("rs"))
    wild = lambda p: p.startswith("[")
    last = F.try_element_at("rs", F.lit(-1))
    catch = F.coalesce(last.startswith("[...") | last.startswith("[[..."), F.lit(False))
    same = lambda a, b: F.forall(F.zip_with(a, b, lambda x, y: wild(x) | wild(y) | (x == y)), lambda ok: ok)
    # a plain first segment meets the same one or a wild one of the other side; "?" is where wild fetches look
    first = lambda c: F.coalesce(F.try_element_at(c, F.lit(1)), F.lit(""))
    keyed = f.withColumn("key", F.explode(F.when(wild(first("fs")), F.array(F.lit("?"))).otherwise(F.array(first("fs"), F.lit("*")))))
    keys = F.array(F.when(wild(first("rs")), "*").otherwise(first("rs")), F.lit("?"))
    plain = r.filter(~catch).withColumn("key", F.explode(keys)).withColumn("n", F.size("rs")).join(keyed.withColumn("n", F.size("fs")), ["n", "key"]).filter(same(F.col("fs"), F.col("rs")))
    head = F.slice("rs", 1, F.greatest(F.size("rs") - 1, F.lit(0)))
    taken = F.slice("fs", 1, F.greatest(F.size("rs") - 1, F.lit(0)))
    long = r.filter(catch).withColumn("key", F.explode(keys)).join(keyed, "key").filter((F.size("fs") >= F.size("rs") - 1) & same(taken, head))
    w = W.partitionBy("source", "fetch").orderBy("ord")
    both = plain.select("source", "fetch", "route", "ord").union(long.select("source", "fetch", "route", "ord"))
    return both.withColumn("rn", F.row_number().over(w)).filter("rn = 1").drop("rn")


def fetch_reasons(matches: DataFrame, keys: DataFrame) -> DataFrame:
    """source, route, reason: the keys that the file reads (source, key) and its number of fetches."""
    k = keys.groupBy("source").agg(F.array_join(F.array_sort(F.collect_set("key")), ",").alias("keys"))
    n = F.count("*").over(W.partitionBy("source"))
    x = matches.withColumn("n", n).join(k, "source", "left")
    reason = F.concat(F.lit("fetch"), F.when(F.col("keys").isNotNull(), F.concat(F.lit("|keys:"), "keys")).otherwise(""), F.when(F.col("n") > 1, F.concat(F.lit("|fetches:"), F.col("n").cast("string"))).otherwise(""))
    return x.select("source", "route", reason.alias("reason"))


def template_urls(content: Column) -> Column:
    """URLs of href, action and src attributes and of url: settings that begin with a slash."""
    return F.array_distinct(F.concat(F.regexp_extract_all(content, F.lit(r"""(?:href|action|src)=["'](/[^"'#?]*)"""), 1), F.regexp_extract_all(content, F.lit(r"""\burl:\s*["'](/[^"'#?]*)"""), 1)))


def wrapper_urls(lines: DataFrame, wrapper: str) -> DataFrame:
    """path, line, url of calls of a fetch wrapper."""
    return lines.select("path", "line", F.explode(F.regexp_extract_all("text", F.lit(rf"""\b{wrapper}\(\s*["'`](/[^"'`]*)"""), 1)).alias("url"))


def orm_calls(lines: DataFrame) -> DataFrame:
    """path, line (from 0), orm, model, method of two client idioms."""
    prisma = lines.select("path", "line", "text", F.lit("prisma").alias("orm"), F.lit(r"\bprisma\.(\w+)\.(findMany|findFirst|findUnique|create|createMany|update|updateMany|delete|deleteMany|upsert|count|aggregate|groupBy)\s*\(").alias("rx"))
    supabase = lines.select("path", "line", "text", F.lit("supabase").alias("orm"), F.lit(r"\bsupabase\.from\(\s*['\"`](\w+)['\"`]\s*\)\s*\.(select|insert|update|delete|upsert)\s*\(").alias("rx"))
    x = prisma.union(supabase).withColumn("models", F.regexp_extract_all("text", "rx", F.lit(1))).withColumn("methods", F.regexp_extract_all("text", "rx", F.lit(2)))
    return x.select("path", (F.col("line") - 1).alias("line"), "orm", F.explode(F.arrays_zip("models", "methods")).alias("m")).select("path", "line", "orm", F.col("m.models").alias("model"), F.col("m.methods").alias("method"))


def query_edges(calls: DataFrame, models: DataFrame) -> DataFrame:
    """sourceId, targetId, reason, created: one QUERIES edge for each file, model and method; unknown models are made up."""
    m = models.groupBy("name").agg(F.min("id").alias("modelId"))
    x = calls.select("path", "orm", "model", "method").distinct().join(m, F.col("model") == F.col("name"), "left")
    return x.select(F.concat(F.lit("File:"), "path").alias("sourceId"), F.coalesce("modelId", F.concat(F.lit("CodeElement:"), "orm", F.lit("."), "model")).alias("targetId"), F.concat_ws("-", "orm", "method").alias("reason"), F.col("modelId").isNull().alias("created"))


def tool_definitions(lines: DataFrame) -> DataFrame:
    """name, path, line of tool definitions; the first of each name."""
    rx = r"""\bname:\s*['"](\w+)['"]\s*,\s*description:"""
    hit = lines.select("path", "line", F.explode(F.regexp_extract_all("text", F.lit(rx), 1)).alias("name"))
    return hit.withColumn("rn", F.row_number().over(W.partitionBy("name").orderBy("path", "line"))).filter("rn = 1").drop("rn")


def handler_calls(routes: DataFrame, symbols: DataFrame) -> DataFrame:
    """File to handler CALLS of framework routes (file, controller, action): 1.0 where the class is unique and has the method,
    a guessed id at 0.8 where it has not; nothing for an ambiguous class. symbols: class, file, method, id."""
    cls = symbols.select("class", "file").distinct().groupBy("class").agg(F.count("*").alias("n"), F.first("file").alias("classFile")).filter("n = 1")
    x = routes.join(cls, F.col("controller") == F.col("class")).drop("class").join(symbols.select(F.col("class").alias("controller"), F.col("method").alias("action"), "id").distinct(), ["controller", "action"], "left")
    return x.select(F.concat(F.lit("File:"), "file").alias("sourceId"), F.coalesce("id", F.concat(F.lit("Method:"), "classFile", F.lit(":"), "action")).alias("targetId"), F.when(F.col("id").isNull(), 0.8).otherwise(1.0).alias("confidence"))


# --- dependency injection, configuration -----------------------------------------------------------


def inject(points: DataFrame, providers: DataFrame, subtypes: DataFrame) -> DataFrame:
    """INJECTS edges (sourceId, targetId, confidence): points (class, type, qualifier, collection) to providers (id, name,
    primary) whose type it is, through subtypes (type, id; a type is its own subtype).

    Named: 0.95. By type: one provider 0.9 (0.85 after a name that matched nothing), a primary one 0.95, several 0.5 each;
    collections take all at 0.8 (0.9 named). No self-injection; the best confidence of a pair stays."""
    cand = points.join(subtypes, "type").join(providers, "id").filter(F.col("id") != F.col("class"))
    w = W.partitionBy("class", "type", F.coalesce("qualifier", F.lit("")), "collection")
    c = cand.withColumn("named", F.coalesce(F.col("qualifier") == F.col("name"), F.lit(False)))
    c = c.withColumn("anyNamed", F.max("named").over(w)).withColumn("primaries", F.sum(F.col("primary").cast("int")).over(w)).withColumn("n", F.count("*").over(w))
    asked = F.col("qualifier").isNotNull()
    confidence = (
        F.when(F.col("collection") & F.col("anyNamed"), F.when(F.col("named"), 0.9))
        .when(F.col("collection"), 0.8)
        .when(F.col("anyNamed"), F.when(F.col("named"), 0.95))
        .when(F.col("n") == 1, F.when(asked, 0.85).otherwise(0.9))
        .when(F.col("primaries") == 1, F.when(F.col("primary"), 0.95))
        .otherwise(0.5)
    )
    return c.withColumn("confidence", confidence).filter("confidence is not null").groupBy(F.col("class").alias("sourceId"), F.col("id").alias("targetId")).agg(F.max("confidence").alias("confidence"))


def inherited_advice(advice: DataFrame, overrides: DataFrame) -> DataFrame:
    """Advice (method, aspect) also holds for what overrides or implements the method, transitively; 0.95. overrides: method, overridden."""
    from .closure import reach

    down = reach(overrides.select(F.col("overridden").alias("src"), F.col("method").alias("dst")), advice.select(F.col("method").alias("start")))
    return advice.join(down, F.col("method") == F.col("start")).select(F.col("node").alias("method"), "aspect").distinct().join(advice.select("method", "aspect"), ["method", "aspect"], "left_anti").withColumn("confidence", F.lit(0.95))


#: Annotations that make a definition conditional.
CONDITIONALS = "ConditionalOnBean ConditionalOnClass ConditionalOnCloudPlatform ConditionalOnExpression ConditionalOnJava ConditionalOnJndi ConditionalOnMissingBean ConditionalOnMissingClass ConditionalOnNotWebApplication ConditionalOnProperty ConditionalOnResource ConditionalOnSingleCandidate ConditionalOnWarDeployment ConditionalOnWebApplication Conditional Profile".split()


def conditional_annotations(lines: DataFrame) -> DataFrame:
    """path, line, annotation, keys (property names in order)."""
    names = "|".join(sorted(CONDITIONALS, key=len, reverse=True))
    rx = rf"@({names})\b(?:\(([^)]*)\))?"
    x = lines.filter(F.col("text").rlike(rx)).select("path", "line", F.regexp_extract("text", rx, 1).alias("annotation"), F.regexp_extract("text", rx, 2).alias("args"))
    prefix = F.regexp_extract("args", r'prefix\s*=\s*"([^"]*)"', 1)
    quoted = F.regexp_extract_all(F.regexp_replace("args", r'(prefix|havingValue|matchIfMissing)\s*=\s*("[^"]*"|\w+)', ""), F.lit(r'"([^"]*)"'), 1)
    keys = F.transform(quoted, lambda k: F.when(prefix != "", F.concat(prefix, F.lit("."), k)).otherwise(k))
    return x.select("path", "line", "annotation", F.when(F.col("annotation") == "ConditionalOnProperty", keys).otherwise(F.array().cast("array<string>")).alias("keys"))


def config_bindings(bindings: DataFrame, keys: DataFrame) -> DataFrame:
    """USES edges: symbols (symbol, key, prefix) to configuration keys (id, name) that are the key or lie below the prefix."""
    exact = bindings.filter("not prefix").join(keys, F.col("key") == F.col("name")).select(F.col("symbol").alias("sourceId"), F.col("id").alias("targetId"))
    ways = keys.withColumn("part", F.explode(F.transform(F.sequence(F.lit(1), F.size(F.split("name", r"\."))), lambda i: F.array_join(F.slice(F.split("name", r"\."), 1, i), "."))))
    below = bindings.filter("prefix").join(ways, F.col("key") == F.col("part")).select(F.col("symbol").alias("sourceId"), F.col("id").alias("targetId"))
    return exact.union(below).distinct()


def declared_configurations(found: DataFrame, classes: DataFrame) -> DataFrame:
    """DECLARES edges of auto-configuration files (path, class), to the class's node (id, qualified) or a synthetic one."""
    return found.join(classes.select(F.col("qualified").alias("class"), "id"), "class", "left").select(F.concat(F.lit("File:"), "path").alias("sourceId"), F.coalesce("id", F.concat(F.lit("Class:synthetic:"), "class")).alias("targetId"), F.col("id").isNull().alias("synthetic"))


def raise_multiplier(scores: DataFrame, handlers: DataFrame) -> DataFrame:
    """Scheduled, event, message and job handlers score as entry points with a multiplier of at least 3."""
    h = handlers.select("id").distinct().withColumn("handler", F.lit(True))
    return scores.join(h, "id", "left").select("id", F.when(F.col("handler"), F.greatest(F.col("multiplier"), F.lit(3.0))).otherwise(F.col("multiplier")).alias("multiplier"))


# --- workflows ------------------------------------------------------------------------------------


def _holds(p: Column, *words: str) -> Column:
    return reduce(lambda a, b: a | b, [p.contains(w) for w in words])


#: Roles, and categories of egress, by parts of the lower-cased path, in this order.
ROLE_WORDS = [("Ingress", ["ingress", "listener", "consumer"]), ("Egress", ["egress", "client", "producer", "repo", "store"]), ("Controller", ["workflow", "controller"])]
EGRESS_WORDS = [
    ("Outbound HTTP / REST Client", ["http", "client", "swift", "clearing"]), ("Database / JPA / ORM", ["repo", "db", "store", "ledger"]), ("Message Queue / Kafka Producer", ["producer", "kafka", "mq"]),
    ("Temporal Activity / RPC Sink", ["activity"]),
]


def _by_words(path: Column, table: list[tuple[str, list[str]]], default: str) -> Column:
    p = F.lower(F.coalesce(path, F.lit("")))
    out = F.when(F.lit(False), F.lit(""))
    for name, words in table:
        out = out.when(_holds(p, *words), name)
    return out.otherwise(default)


def role(path: Column, label: Column) -> Column:
    return F.when(label == "Route", "Ingress").otherwise(_by_words(path, ROLE_WORDS, "Service"))


def egress_category(path: Column) -> Column:
    return _by_words(path, EGRESS_WORDS, "Outbound Integration Sink")


def route_handlers(routes: DataFrame, handles: DataFrame, nodes: DataFrame) -> DataFrame:
    """route, handler: the property, then HANDLES edges (sourceId, targetId), where the handler is a node."""
    by_prop = routes.filter("handlerSymbolId is not null").select(F.col("id").alias("route"), F.col("handlerSymbolId").alias("handler"), F.lit(0).alias("p"))
    by_edge = handles.select(F.col("targetId").alias("route"), F.col("sourceId").alias("handler"), F.lit(1).alias("p"))
    ok = by_prop.union(by_edge).join(nodes.select(F.col("id").alias("handler")), "handler", "left_semi")
    return ok.groupBy("route").agg(F.min_by("handler", F.struct("p", "handler")).alias("handler"))


def entry_points(nodes: DataFrame, handlers: DataFrame) -> DataFrame:
    """id, kind: routes, and callables in listener, consumer, workflow or processor files that are no tests and no route handlers."""
    p = F.lower(F.coalesce("filePath", F.lit("")))
    events = nodes.filter(F.col("label").isin("Method", "Function") & _holds(p, "listener", "consumer", "workflow", "processor") & ~p.contains("test")).join(handlers.select(F.col("handler").alias("id")), "id", "left_anti")
    return nodes.filter("label = 'Route'").select("id", F.lit("route").alias("kind")).union(events.select("id", F.lit("event").alias("kind")))


def workflow_steps(entries: DataFrame, handlers: DataFrame, nodes: DataFrame, calls: DataFrame, hops: int = 4) -> DataFrame:
    """entry, role, id, name, depth: what each entry reaches in `hops` calls, once for each role and name. The handler of a
    route is its first controller; ingress-like callees count as services."""
    x = entries.select(F.col("id").alias("entry")).join(handlers, F.col("entry") == F.col("route"), "left").select("entry", F.coalesce("handler", "entry").alias("start"), F.col("handler").isNotNull().alias("handled"))
    e = calls.filter("sourceId <> targetId").select(F.col("sourceId").alias("src"), F.col("targetId").alias("dst"))
    below = bounded_search(e, x.select("start").distinct(), hops)
    n = nodes.filter(~F.col("label").isin("File", "Folder", "Community", "Process")).select(F.col("id").alias("node"), "label", "name", "filePath")
    r = role(F.col("filePath"), F.col("label"))
    kind = F.when(F.col("node") == F.col("start"), F.when(F.col("handled"), "Controller")).when(r.isin("Egress", "Controller"), r).otherwise("Service")
    found = x.join(below, "start").join(n, "node").withColumn("role", kind).filter("role is not null").withColumn("name", clean_name(F.col("name")))
    w = W.partitionBy("entry", "role", "name").orderBy("depth", "node")
    return found.withColumn("rn", F.row_number().over(w)).filter("rn = 1").select("entry", "role", F.col("node").alias("id"), "name", "depth")


def workflows(steps: DataFrame, entries: DataFrame) -> DataFrame:
    """entry, name, controllers, services, egressSinks (names in order), totalSteps; without empty ones, and one for each
    entry name with the same services and sinks. entries: id, name."""
    names = lambda r: F.transform(F.filter("ss", lambda s: s["role"] == r), lambda s: s["name"])
    g = steps.groupBy("entry").agg(F.array_sort(F.collect_list(F.struct("depth", "id", "name", "role"))).alias("ss"))
    x = g.join(entries.select(F.col("id").alias("entry"), "name"), "entry").select("entry", "name", names("Controller").alias("controllers"), names("Service").alias("services"), names("Egress").alias("egressSinks"))
    x = x.withColumn("totalSteps", 1 + F.size("controllers") + F.size("services") + F.size("egressSinks")).filter("totalSteps > 1")
    w = W.partitionBy("name", F.array_join("services", "\0"), F.array_join("egressSinks", "\0")).orderBy("entry")
    return x.withColumn("rn", F.row_number().over(w)).filter("rn = 1").drop("rn")


def egress_report(sinks: DataFrame, calls: DataFrame, flows: DataFrame) -> DataFrame:
    """id, category, callers, origins of sinks (id, filePath); calls: caller, sinkId; flows: ingress, sinkId."""
    listed = lambda d, c, name: d.groupBy(F.col("sinkId").alias("id")).agg(F.array_join(F.array_sort(F.collect_set(c)), ", ").alias(name))
    x = sinks.join(listed(calls, "caller", "callers"), "id", "left").join(listed(flows, "ingress", "origins"), "id", "left")
    return x.select("id", egress_category(F.col("filePath")).alias("category"), F.coalesce("callers", F.lit("(Direct Ingress)")).alias("callers"), F.coalesce("origins", F.lit("(Internal Domain)")).alias("origins"))


def rendered_steps(steps: DataFrame) -> DataFrame:
    """processId, step, line: the first and the last step are marked."""
    w = W.partitionBy("processId")
    mark = F.when(F.col("step") == F.min("step").over(w), "ENTRY").when(F.col("step") == F.max("step").over(w), "EXIT").otherwise("STEP")
    return steps.select("processId", "step", F.format_string("[%s] %s", mark, F.col("name")).alias("line"))


def text_handlers(routes: DataFrame, files: DataFrame, symbols: DataFrame) -> DataFrame:
    """route, id: symbols of other files whose name (over three letters) stands in the route's file. Words meet words, so no
    text is compared with every name."""
    words = files.select("path", F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(r"(\w{4,})"), 1))).alias("word"))
    hit = routes.select(F.col("id").alias("route"), F.col("filePath").alias("path")).join(words, "path").join(symbols.select("id", "name", "filePath"), F.col("word") == F.col("name"))
    return hit.filter("filePath <> path").select("route", "id").distinct()
