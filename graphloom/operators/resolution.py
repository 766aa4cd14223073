"""Name and type resolution: evidence, ranking, lexical lookup, receivers, arity, references to edges."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .closure import reach

#: Evidence weights.
ORIGIN = {"local": 0.55, "import": 0.45, "reexport": 0.4, "namespace": 0.4, "wildcard": 0.3, "global-qualified": 0.35, "global-name": 0.1}
PER_SCOPE = -0.02
BY_MRO_DEPTH = [0.5, 0.42, 0.36, 0.32, 0.3]
OWNER = 0.2
ARITY = {"compatible": 0.1, "unknown": 0.0, "incompatible": -0.15}
DYNAMIC = 0.02
UNLINKED = 0.5
#: The order of origins among equals.
PRIORITY = {"local": 0, "import": 1, "reexport": 2, "namespace": 3, "wildcard": 4, "global-qualified": 5, "global-name": 6}


def _pick(c: Column, table: dict, default) -> Column:
    out = F.when(F.lit(False), F.lit(default))
    for k, v in table.items():
        out = out.when(c == k, F.lit(v))
    return out.otherwise(F.lit(default))


def confidence() -> Column:
    """From origin, unlinked, scope_depth, mro_depth, owner_match, arity, dynamic: the clamped sum of what is known."""
    origin = _pick(F.col("origin"), ORIGIN, 0.0) * F.when(F.col("unlinked"), UNLINKED).otherwise(1.0)
    scope = F.greatest(F.coalesce("scope_depth", F.lit(0)), F.lit(0)) * PER_SCOPE
    steps = F.array(*(F.lit(w) for w in BY_MRO_DEPTH))
    mro = F.when(F.col("mro_depth").isNotNull(), F.element_at(steps, F.least(F.col("mro_depth"), F.lit(len(BY_MRO_DEPTH) - 1)) + 1)).otherwise(0.0)
    total = origin + scope + mro + F.when(F.col("owner_match"), OWNER).otherwise(0.0) + _pick(F.col("arity"), ARITY, 0.0) + F.when(F.col("dynamic"), DYNAMIC).otherwise(0.0)
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), total)), 9)


def rank(candidates: DataFrame, site: str = "site") -> DataFrame:
    """rn of each candidate of a site: confidence (in thousandths), scope depth, MRO depth, origin, id."""
    far = F.lit(2**31 - 1)
    order = [F.desc(F.round("confidence", 3)), F.coalesce("scope_depth", far), F.coalesce("mro_depth", far), _pick(F.col("origin"), PRIORITY, 7), F.col("id")]
    return candidates.withColumn("rn", F.row_number().over(W.partitionBy(site).orderBy(*order)))


def scope_chain(scopes: DataFrame) -> DataFrame:
    """scope, ancestor, depth: each scope itself (0) and those around it. scopes: scope, parent."""
    up = reach(scopes.filter("parent is not null").select(F.col("scope").alias("src"), F.col("parent").alias("dst")))
    return scopes.select("scope", F.col("scope").alias("ancestor"), F.lit(0).alias("depth")).union(up.select(F.col("start"), "node", "depth"))


def lexical(sites: DataFrame, chain: DataFrame, bindings: DataFrame) -> DataFrame:
    """site, id, depth: the definitions of the nearest scope that binds the name at all; only then is the kind looked at, so a
    nearer binding hides farther ones. sites: site, scope, name, kinds; bindings: scope, name, id, kind."""
    b = bindings.select(F.col("scope").alias("ancestor"), "name", "id", "kind")
    # scopes and names are settled before sites come in, so that a site never stands for each scope around it
    least = chain.join(b.select("ancestor", "name").distinct(), "ancestor").groupBy("scope", "name").agg(F.min("depth").alias("depth"))
    found = least.join(chain, ["scope", "depth"]).join(b, ["ancestor", "name"]).groupBy("scope", "name", "depth").agg(F.collect_list(F.struct("id", "kind")).alias("defs"))
    rows = sites.withColumn("__n", F.count("*").over(W.partitionBy("site")))
    one = rows.filter("__n = 1").join(found, ["scope", "name"])
    # a site that is told for several scopes or names has the nearest of all
    many = rows.filter("__n > 1").join(found, ["scope", "name"]).withColumn("m", F.min("depth").over(W.partitionBy("site"))).filter("depth = m").drop("m")
    x = one.unionByName(many).select("site", "kinds", "depth", F.explode("defs").alias("d"))
    return x.filter(F.array_contains("kinds", F.col("d.kind"))).select("site", "d.id", "depth")


def members_of(receivers: DataFrame, mro: DataFrame, members: DataFrame) -> DataFrame:
    """site, id, mro_depth: members of the receiver's type or the nearest ancestor that has the name. mro: class, ancestor,
    depth; members: class, name, id."""
    own = receivers.select("site", "name", F.col("type").alias("holder"), F.lit(0).alias("mro_depth"))
    up = receivers.join(mro, receivers["type"] == mro["class"]).select("site", "name", F.col("ancestor").alias("holder"), F.col("depth").alias("mro_depth"))
    x = own.union(up).join(members.select(F.col("class").alias("holder"), "name", "id"), ["holder", "name"])
    return x.withColumn("m", F.min("mro_depth").over(W.partitionBy("site"))).filter("mro_depth = m").select("site", "id", "mro_depth")


def arity_filter(candidates: DataFrame) -> DataFrame:
    """Without incompatible candidates of a site, if it has any other; sites with none but incompatible ones lose all."""
    return candidates.filter("arity <> 'incompatible'")


def arity_verdict(args: Column, least: Column, most: Column) -> Column:
    return F.when(args.isNull() | (least.isNull() & most.isNull()), "unknown").when((args >= F.coalesce(least, F.lit(0))) & (most.isNull() | (args <= most)), "compatible").otherwise("incompatible")


def with_fallback(found: DataFrame, sites: DataFrame, globals_: DataFrame) -> DataFrame:
    """found (site, id, origin) and, for sites without any, definitions by qualified name."""
    rest = sites.join(found.select("site").distinct(), "site", "left_anti").join(globals_.select(F.col("qualified").alias("name"), "id"), "name").select("site", "id", F.lit("global-qualified").alias("origin"))
    return found.select("site", "id", "origin").union(rest)


def reference_edges(references: DataFrame, scopes: DataFrame, chain: DataFrame) -> DataFrame:
    """sourceId, targetId, type, step: the nearest callable scope around each reference is its source. references: scope, id,
    kind (call, read, write, inherits, type); scopes: scope, owner (null: no callable)."""
    kinds = {"call": "CALLS", "read": "ACCESSES", "write": "ACCESSES", "inherits": "INHERITS", "type": "USES"}
    own = chain.join(scopes.filter("owner is not null").select(F.col("scope").alias("ancestor"), "owner"), "ancestor").groupBy("scope").agg(F.min_by("owner", "depth").alias("owner"))
    x = references.join(own, "scope")
    return x.select(F.col("owner").alias("sourceId"), F.col("id").alias("targetId"), _pick(F.col("kind"), kinds, "USES").alias("type"), F.when(F.col("kind") == "read", 1).when(F.col("kind") == "write", 2).otherwise(0).alias("step")).distinct()


def first_case(cases: list[DataFrame], site: str = "site") -> DataFrame:
    """Rows of the first case that gives any for a site."""
    all_ = reduce(DataFrame.unionByName, [c.withColumn("case", F.lit(i)) for i, c in enumerate(cases)])
    return all_.withColumn("m", F.min("case").over(W.partitionBy(site))).filter(F.col("case") == F.col("m")).drop("m")


def narrow_overloads(candidates: DataFrame) -> DataFrame:
    """Overloads of a site whose argument types agree best (args, types: arrays; unknown types agree with all)."""
    hits = F.aggregate(F.zip_with("args", "types", lambda a, t: F.when(a.isNull() | t.isNull(), 0).when(a == t, 1).otherwise(-100)), F.lit(0), lambda s, x: s + F.coalesce(x, F.lit(-100)))
    x = candidates.filter(F.size("args") == F.size("types")).withColumn("hits", hits).filter("hits >= 0")
    return x.withColumn("m", F.max("hits").over(W.partitionBy("site"))).filter("hits = m").drop("m", "hits")


def compound_types(fields: DataFrame, chains: DataFrame, depth: int = 6) -> DataFrame:
    """chain, type of dotted receivers: chains (chain, type, parts) are followed through fields (type, name, result)."""
    x = chains.withColumn("i", F.lit(0))
    done = x.filter(F.size("parts") == 0).select("chain", "type")
    for _ in range(depth):
        f = fields.select("type", F.col("name").alias("__name"), "result")
        x = x.filter(F.col("i") < F.size("parts")).withColumn("__name", F.get("parts", F.col("i"))).join(f, ["type", "__name"]).select("chain", F.col("result").alias("type"), "parts", (F.col("i") + 1).alias("i"))
        done = done.union(x.filter(F.col("i") == F.size("parts")).select("chain", "type"))
    return done.distinct()


def propagated_types(own: DataFrame, calls: DataFrame) -> DataFrame:
    """name, type: return types known of a function (name, type), and of those that return another one's call (name, callee)."""
    up = reach(calls.select(F.col("name").alias("src"), F.col("callee").alias("dst")))
    told = up.join(own.select(F.col("name").alias("node"), "type"), "node").withColumn("m", F.min("depth").over(W.partitionBy("start"))).filter("depth = m")
    return own.select("name", "type").union(told.groupBy(F.col("start").alias("name")).agg(F.min("type").alias("type")).join(own.select("name"), "name", "left_anti"))


def imported_values(references: DataFrame, imports: DataFrame, exports: DataFrame) -> DataFrame:
    """ACCESSES at 0.9 of values that another file exports. references: file, name, source; imports: file, name, target;
    exports: file, name, id."""
    x = references.join(imports, ["file", "name"]).filter("file <> target").join(exports.select(F.col("file").alias("target"), "name", "id"), ["target", "name"])
    return x.select(F.col("source").alias("sourceId"), F.col("id").alias("targetId"), F.lit(0.9).alias("confidence")).distinct()


def unique_names(accesses: DataFrame, properties: DataFrame, resolved: DataFrame) -> DataFrame:
    """ACCESSES at 0.5 of names that just one property has, where nothing better was found."""
    one = properties.groupBy("name").agg(F.count("*").alias("n"), F.first("id").alias("id")).filter("n = 1")
    return accesses.join(resolved.select("site").distinct(), "site", "left_anti").join(one, "name").select("site", F.col("source").alias("sourceId"), F.col("id").alias("targetId"), F.lit(0.5).alias("confidence"))


def dispatched(registrations: DataFrame, sites: DataFrame, fan_out: int = 16) -> DataFrame:
    """CALLS at 0.7 through tables: registrations (key, handler) meet sites (key, source); keys with more handlers than
    fan_out are left out, as they tell nothing."""
    r = registrations.distinct()
    few = r.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") <= fan_out).select("key")
    return sites.join(r.join(few, "key", "left_semi"), "key").select(F.col("source").alias("sourceId"), F.col("handler").alias("targetId"), F.lit(0.7).alias("confidence")).distinct()


def value_flow(assigned: DataFrame, flows: DataFrame, calls: DataFrame) -> DataFrame:
    """CALLS through variables: functions (variable, id) flow along (from, to) to called variables (source, variable); 0.8 for
    one target, 0.7 for several."""
    over = reach(flows.select(F.col("from").alias("src"), F.col("to").alias("dst")))
    points = assigned.select("variable", "id").union(over.join(assigned, over["start"] == assigned["variable"]).select(F.col("node"), "id")).distinct()
    x = calls.join(points, "variable").select(F.col("source").alias("sourceId"), "variable", F.col("id").alias("targetId")).distinct()
    n = F.count("*").over(W.partitionBy("sourceId", "variable"))
    return x.withColumn("confidence", F.when(n == 1, 0.8).otherwise(0.7)).groupBy("sourceId", "targetId").agg(F.max("confidence").alias("confidence"))


def import_edges(imports: DataFrame) -> DataFrame:
    """source, target, reason: the strongest presence of each pair (runtime, deferred, type-only)."""
    order = {"runtime": 0, "deferred": 1, "type-only": 2}
    x = imports.groupBy("source", "target").agg(F.min(_pick(F.col("presence"), order, 0)).alias("p"))
    return x.select("source", "target", F.concat(F.lit("import"), F.when(F.col("p") == 1, " (deferred)").when(F.col("p") == 2, " (type-only)").otherwise("")).alias("reason"))


def satisfied(required: DataFrame, members: DataFrame) -> DataFrame:
    """class, interface: classes that have all members (name) an interface requires (interface, name). Division by counting."""
    need = required.distinct()
    n = need.groupBy("interface").agg(F.count("*").alias("need"))
    have = members.select("class", "name").distinct().join(need, "name").groupBy("class", "interface").agg(F.count("*").alias("have"))
    return have.join(n, "interface").filter("have = need").select("class", "interface")
