"""Endpoints, routers, layers and traces of a code base, as joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathomkb.functions.scalars import join_path, slugify

from .search import suffix_repeats

#: The layers that calls lead down through.
LAYERS = ["route", "service", "repo", "model"]


def resolve_endpoints(raw: DataFrame, routers: DataFrame, includes: DataFrame, symbols: DataFrame) -> DataFrame:
    """raw (seq, module, var, verb, route, handler), routers (seq, module, var, prefix), includes (seq, router_var, token, prefix), symbols (id).

    path = prefix of the include, of the router and the route. The include is the first whose token is the module's
    last segment, else the first for the router's variable. A null route is "(dynamic)"; a handler that is no symbol
    is null; repeated ids get -n.
    """
    r = routers.groupBy("module", "var").agg(F.min_by("prefix", "seq").alias("r_prefix"))
    by_token = includes.filter("token is not null").groupBy("token").agg(F.min_by("prefix", "seq").alias("t_prefix"), F.lit(True).alias("t_hit"))
    by_var = includes.groupBy(F.col("router_var").alias("var")).agg(F.min_by("prefix", "seq").alias("v_prefix"))
    e = raw.withColumn("token", F.substring_index("module", ".", -1)).join(r, ["module", "var"], "left").join(by_token, "token", "left").join(by_var, "var", "left")
    mount = F.when(F.col("t_hit"), F.col("t_prefix")).otherwise(F.col("v_prefix"))
    e = e.withColumn("path", join_path(mount, F.col("r_prefix"), F.coalesce("route", F.lit("(dynamic)")))).withColumn("base", F.concat_ws("-", F.lit("endpoint"), F.lower("verb"), slugify(F.col("path"))))
    known = symbols.select(F.col("id").alias("handler"), F.lit(True).alias("known")).distinct()
    e = suffix_repeats(e, "base").join(known, "handler", "left")
    return e.select(F.col("unique_id").alias("id"), "module", "verb", "path", F.when(F.col("known"), F.col("handler")).alias("handler"))


def router_view(routers: DataFrame, includes: DataFrame, raw: DataFrame) -> DataFrame:
    """module, var, endpoint_count, mounted of each router, those with most endpoints first."""
    n = raw.groupBy("module", "var").agg(F.count("*").alias("n"))
    mounted = includes.select(F.col("router_var").alias("var"), F.lit(True).alias("m")).distinct()
    out = routers.select("module", "var").distinct().join(n, ["module", "var"], "left").join(mounted, "var", "left")
    return out.select("module", "var", F.coalesce("n", F.lit(0).cast("long")).alias("endpoint_count"), F.coalesce("m", F.lit(False)).alias("mounted")).orderBy(F.desc("endpoint_count"), "module", "var")


def layer(module: Column, is_model: Column | None = None) -> Column:
    """The layer of a symbol: model if it is one or by its module's segments, else route, service, repo, schema or other."""
    parts = F.split(module, r"\.")
    has = lambda *names: F.arrays_overlap(parts, F.array(*map(F.lit, names)))
    model = has("models") if is_model is None else F.coalesce(is_model, F.lit(False)) | has("models")
    repo = has("repositories") | F.exists(parts, lambda p: p.endswith("_repo"))
    return F.when(model, "model").when(has("routes", "routers"), "route").when(has("services"), "service").when(repo, "repo").when(has("schemas"), "schema").otherwise("other")


def layer_flow(symbols: DataFrame, relations: DataFrame) -> DataFrame:
    """Distinct calls from a lower to a higher of the four layers: from_layer, from_node, to_layer, to_node.

    A node is a module, or within models the symbol's class: symbols (id, module, title, is_model)."""
    kind = layer(F.col("module"), F.col("is_model"))
    s = symbols.select("id", kind.alias("layer"), F.when(kind == "model", F.col("title")).otherwise(F.col("module")).alias("node"))
    s = s.withColumn("rank", F.array_position(F.array(*map(F.lit, LAYERS)), F.col("layer"))).filter("rank > 0")
    side = lambda end, p: s.select(F.col("id").alias(end), *(F.col(c).alias(f"{p}_{c}") for c in ("node", "layer", "rank")))
    e = relations.filter("predicate = 'calls'").select("subject", "object").distinct().join(side("subject", "from"), "subject").join(side("object", "to"), "object")
    return e.filter("to_rank > from_rank").select("from_layer", "from_node", "to_layer", "to_node").distinct()


def heading_ancestry(sections: DataFrame) -> DataFrame:
    """Sections (doc_id, n, level, heading) with `ancestors`: the headings above, the top one first.

    The nearest earlier heading of each level below one's own counts, unless a higher one came after it.
    """
    from pyspark.sql.window import Window

    w = Window.partitionBy("doc_id").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    last = lambda k: F.last(F.when(F.col("level") == k, F.struct("n", "heading")), ignorenulls=True).over(w)
    out = sections.withColumns({f"_h{k}": last(k) for k in range(1, 6)})
    alive = []
    for k in range(1, 6):
        newer = F.greatest(F.lit(0), *(F.coalesce(F.col(f"_h{j}.n"), F.lit(0)) for j in range(1, k))) if k > 1 else F.lit(0)
        alive.append(F.when((F.col("level") > k) & (F.col(f"_h{k}.n") > newer), F.col(f"_h{k}.heading")))
    return out.withColumn("ancestors", F.array_compact(F.array(*alive))).drop(*(f"_h{k}" for k in range(1, 6)))


def trace_coverage(expected: DataFrame, entries: DataFrame) -> DataFrame:
    """Expected source ids without a trace entry, and targets without an inbound one: id, gap."""
    seen = entries.select(F.col("source_id").alias("id")).distinct()
    missing = expected.filter("side = 'source'").join(seen, "id", "left_anti").select("id", F.lit("untraced_source").alias("gap"))
    inbound = entries.filter("target_id is not null").select(F.col("target_id").alias("id")).distinct()
    return missing.unionByName(expected.filter("side = 'target'").join(inbound, "id", "left_anti").select("id", F.lit("target_without_source").alias("gap")))


def dependencies(imports: DataFrame, modules: DataFrame, standard: list[str]) -> DataFrame:
    """package, modules: first segments of imports (module, name) that are neither relative, nor standard, nor the repository's, and how many modules import each.

    The repository's are the first and the second segments of its own modules (module), as a scan may start above the packages.
    """
    parts = F.split("module", r"\.")
    own = modules.select(F.explode(F.slice(parts, 1, 2)).alias("package")).filter("package <> ''").distinct()
    used = imports.filter(~F.col("name").startswith(".")).select("module", F.substring_index("name", ".", 1).alias("package")).filter((F.col("package") != "") & ~F.col("package").isin(standard)).distinct()
    return used.join(own, "package", "left_anti").groupBy("package").agg(F.count("*").alias("modules"))


def architecture_state(endpoints: DataFrame, routers: DataFrame, apps: DataFrame, models: DataFrame, schemas: DataFrame, needed: DataFrame, frameworks: dict[str, str]) -> DataFrame:
    """section, name, n: the counts of an architecture, its dependencies (package, modules) and the frameworks among them.

    endpoints (kind): all, and of kind http (null counts as http), cli and task; routers, apps, data models, schemas and dependencies in
    all; a row for each dependency with its modules; a row for each framework (package -> name) that is needed.
    """
    http = F.coalesce("kind", F.lit("http"))
    kinds = {"endpoints": F.count("*"), "http_endpoints": F.count_if(http == "http"), "cli_commands": F.count_if(http == "cli"), "tasks": F.count_if(http == "task")}
    counts = endpoints.agg(*(c.alias(k) for k, c in kinds.items())).unpivot([], list(kinds), "name", "n")
    sizes = [t.agg(F.count("*").alias("n")).select(F.lit(k).alias("name"), "n") for k, t in {"routers": routers, "apps": apps, "data_models": models, "schemas": schemas, "dependencies": needed}.items()]
    summary = reduce(DataFrame.unionByName, [counts, *sizes]).select(F.lit("summary").alias("section"), "name", "n")
    label = F.create_map(*(F.lit(x) for kv in frameworks.items() for x in kv))
    found = needed.select(F.try_element_at(label, F.col("package")).alias("name"), "modules").filter("name is not null").groupBy("name").agg(F.sum("modules").alias("n"))
    return summary.unionByName(needed.select(F.lit("dependency").alias("section"), F.col("package").alias("name"), F.col("modules").alias("n"))).unionByName(found.select(F.lit("framework").alias("section"), "name", "n"))
