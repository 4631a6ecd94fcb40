"""Joins, aggregations and traversal over relations and symbols."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathomkb.functions.scalars import nonempty
from fathomkb.sources.shared import written
from fathomkb.sources.spread import first_k


def relation_view(relations: DataFrame) -> DataFrame:
    """Nested relation and code structs lifted to columns, with defaults for a missing type and evidence."""
    return relations.select("id", nonempty(F.col("type"), "relation").alias("type"), "subject", "predicate", "object", F.col("relation.resolution_status").alias("status"), F.col("relation.confidence").alias("confidence"), F.coalesce("evidence", F.array().cast("array<string>")).alias("evidence"), F.col("code.file").alias("file"))


def count_by(rows: DataFrame, key: Column | str, name: str = "value", default: str = "unknown") -> DataFrame:
    """Counts of a key; null and empty are `default`."""
    key = F.col(key) if isinstance(key, str) else key
    return rows.groupBy(nonempty(key.cast("string"), default).alias(name)).agg(F.count("*").alias("n"))


def summary(rows: DataFrame, *keys: str) -> DataFrame:
    """A histogram for each key in one scan: key, value, n."""
    return rows.select(F.explode(F.array(*(F.struct(F.lit(k).alias("key"), nonempty(F.col(k).cast("string"), "unknown").alias("value")) for k in keys))).alias("x")).groupBy("x.key", "x.value").agg(F.count("*").alias("n"))


def degrees(symbols: DataFrame, relations: DataFrame) -> DataFrame:
    """Edges out, in and in all of each symbol."""
    ends = relations.select(F.explode(F.array(F.struct(F.col("subject").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("object").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e"))
    n = ends.groupBy("e.id").agg(F.sum("e.o").alias("out_degree"), F.sum("e.i").alias("in_degree"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return symbols.select("id").join(n, "id", "left").select("id", zero("out_degree"), zero("in_degree")).withColumn("degree", F.col("out_degree") + F.col("in_degree"))


def coverage(relations: DataFrame) -> DataFrame:
    """symbol_id, test_id, distinct: objects of covers, and subjects of tested_by."""
    a = relations.filter("predicate = 'covers'").select(F.col("object").alias("symbol_id"), F.col("subject").alias("test_id"))
    b = relations.filter("predicate = 'tested_by'").select(F.col("subject").alias("symbol_id"), F.col("object").alias("test_id"))
    return a.unionByName(b).distinct()


def incident(relations: DataFrame, ids: DataFrame) -> DataFrame:
    """Relations whose subject or object is among ids; repeated rows stay."""
    one = ids.select("id").distinct()
    at = lambda c: one.select(F.col("id").alias(f"{c}_id"))
    both = relations.join(at("subject"), F.col("subject") == F.col("subject_id"), "left").join(at("object"), F.col("object") == F.col("object_id"), "left")
    return both.filter("subject_id is not null or object_id is not null").drop("subject_id", "object_id")


def merge_relations(relations: DataFrame) -> DataFrame:
    """One row a triple: evidence sorted and united; the first row, or the first exact one where there is any."""
    pick = F.struct(F.col("status") != "exact", "seq", "evidence")
    out = relations.groupBy("subject", "predicate", "object").agg(F.min_by("status", pick).alias("status"), F.min_by("confidence", pick).alias("confidence"), F.sort_array(F.collect_set("evidence")).alias("evidence"), F.min("seq").alias("seq"))
    return out


def neighbourhood(relations: DataFrame, node: str, depth: int) -> DataFrame:
    """Edges with an end in the frontier of each of max(1, depth) undirected rounds: those at nodes less than depth away.

    The frontier of a round is a DataFrame that joins the edges; nothing is collected.
    """
    frontier, rounds = relations.sparkSession.createDataFrame([(node,)], "id string"), []
    for _ in range(max(1, depth)):
        rounds.append(incident(relations, frontier))
        frontier = rounds[-1].select(F.explode(F.array("subject", "object")).alias("id")).distinct()  # nodes seen before add no edge of their own
    edges = reduce(DataFrame.unionByName, rounds)
    return edges.groupBy("id").agg(F.max_by(F.struct("subject", "predicate", "object", "status"), F.struct("seq", "status")).alias("r")).select("id", "r.*")


def change_impact(relations: DataFrame, symbol: str) -> DataFrame:
    """Two hops around a symbol: impacted subjects of any kind and objects that are symbols; how many relations each is in."""
    near = neighbourhood(relations, symbol, 2)
    ids = near.select(F.explode(F.array(F.col("subject"), F.when(F.col("object").startswith("symbol-"), F.col("object")))).alias("id")).filter(F.col("id").isNotNull() & (F.col("id") != symbol))
    return ids.groupBy("id").agg(F.count("*").alias("n_relations"))


def reachable(relations: DataFrame, start: str, predicates: list[str], levels: int = 8, most_seen: int | None = None) -> DataFrame:
    """id, level of what is reached over directed edges of the predicates within `levels` steps, start excluded.

    Rounds of a frontier of new nodes over the distinct edges, which are written once; a node keeps its first level, so
    work grows with the edges met and not with the paths. Rounds stop when none finds a new node or, where most_seen
    is given, when that many are known.
    """
    edges = written(relations.filter(F.col("predicate").isin(predicates)).select("subject", "object").distinct(), "edges")
    seen = frontier = relations.sparkSession.createDataFrame([(start, 0)], "id string, level int")
    for level in range(1, levels + 1):
        step = frontier.join(edges, F.col("id") == F.col("subject")).select(F.col("object").alias("id")).distinct()
        frontier = written(step.join(seen.select("id"), "id", "left_anti").withColumn("level", F.lit(level)), "frontier")
        seen = seen.unionByName(frontier)
        if frontier.isEmpty() or (most_seen and seen.count() >= most_seen):
            break
    return seen.filter("level > 0")


reachable_levels = reachable


def fixpoint_members(bases: DataFrame, seeds: list[str]) -> DataFrame:
    """Names whose bases (name, base) lead to a seed, through any number of classes.

    Rounds go on until one finds no new name; each round's names are a written table, so plans don't nest.
    """
    bases = written(bases.select("name", "base"))
    known = new = written(bases.filter(F.col("base").isin(seeds)).select("name").distinct())
    rounds = 1
    while not new.isEmpty():
        found = bases.join(new.select(F.col("name").alias("base")), "base", "left_semi").select("name").distinct()
        new = written(found.join(known.select(F.col("name").alias("k")), F.col("name").eqNullSafe(F.col("k")), "left_anti"))
        known, rounds = known.unionByName(new), rounds + 1
        if rounds % 16 == 0:
            known = written(known)
    return known


def call_clusters(symbols: DataFrame, relations: DataFrame, least: int = 2, predicates: tuple[str, ...] = ("calls",)) -> DataFrame:
    """Callers with at least `least` distinct exact callees in the same file, themselves apart."""
    s = symbols.select("id", "file")
    e = relations.filter(F.col("predicate").isin(*predicates) & (F.col("status") == "exact") & (F.col("subject") != F.col("object"))).select("subject", "object").distinct()
    same = e.join(s.select(F.col("id").alias("subject"), F.col("file").alias("f1")), "subject").join(s.select(F.col("id").alias("object"), F.col("file").alias("f2")), "object").filter("f1 = f2")
    return same.groupBy("subject").agg(F.count("*").alias("callees")).filter(F.col("callees") >= least)


def impact_ranking(relations: DataFrame, predicates: list[str], limit: int = 200, names: int = 25) -> DataFrame:
    """Symbols by their number of distinct dependents, ties by id, with the first names of these.

    The names of a symbol are its first ones in every task, merged: at most `names` a task are shuffled, none beyond are held.
    """
    d = relations.filter(F.col("predicate").isin(predicates) & F.col("object").startswith("symbol-")).select("object", "subject").distinct()
    out = d.groupBy("object").agg(F.count("*").alias("dependents")).orderBy(F.desc("dependents"), "object").limit(limit)
    few = first_k(d.join(F.broadcast(out.select("object")), "object", "left_semi"), ["object"], ["subject"], names)
    shown = few.groupBy("object").agg(F.array_join(F.array_sort(F.collect_list("subject")), ",").alias("first_names"))
    return out.join(shown, "object")


def resolve_suffix(names: DataFrame, modules: DataFrame) -> DataFrame:
    """ref -> module: the module of that exact name, else the only one that ends in ".ref"; null if several or none do.

    Every dotted suffix of a module's name is a row, so the suffix join is an equi-join.
    """
    parts = F.split("module", r"\.")
    tails = modules.select("module").distinct().withColumn("k", F.explode(F.sequence(F.lit(1), F.size(parts)))).select("module", F.array_join(F.slice(parts, F.col("k"), F.size(parts)), ".").alias("ref"), (F.col("k") == 1).alias("whole"))
    one = tails.groupBy("ref").agg(F.max(F.when(F.col("whole"), F.col("module"))).alias("exact"), F.count("*").alias("n"), F.min("module").alias("some"))
    return names.select("ref").distinct().join(one, "ref", "left").select("ref", F.coalesce("exact", F.when(F.col("n") == 1, F.col("some"))).alias("module"))


def package_tree(symbols: DataFrame) -> DataFrame:
    """Counts by first segment and, below it, by package key: a rollup."""
    from fathomkb.functions.scalars import package_key

    rows = symbols.select(F.substring_index("qualified_name", ".", 1).alias("top"), package_key(F.col("qualified_name")).alias("package"))
    return rows.rollup("top", "package").agg(F.count("*").alias("n")).filter("top is not null")
