"""Composite queries: the context of a task, in long format (part, rank, id)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fathomkb.functions.scalars import slugify
from fathomkb.sources.shared import written

from . import claims as C
from . import relations as R
from . import search as S
from .extract import decision_rules
from .rules import item_rules


def _ranked(rows: DataFrame, part: str, order: list, most: int) -> DataFrame:
    """The first `most` rows in order, as (part, rank, id). The limit makes one small partition before the window."""
    top = rows.orderBy(*order).limit(most)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order))).select(F.lit(part).alias("part"), "rank", "id")


def code_context(query: str, symbols: DataFrame, relations: DataFrame, claims: DataFrame, claim_symbols: DataFrame, decisions: DataFrame, most: int = 12, shown: int = 10) -> DataFrame:
    """The best symbols for a query, with the relations at them, usable claims about them, tests that cover them, and counts.

    Lists are cut to `shown` after the counts are taken.
    """
    top = written(S.symbols_search(symbols, query).limit(most), "top")  # read by every part
    edges = written(R.incident(relations, top).select("id", "status").distinct(), "edges")
    about = C.for_symbols(C.overlay(claims, decisions), claim_symbols, top).filter(S.usable())
    tests = R.coverage(relations).join(top.select(F.col("id").alias("symbol_id")), "symbol_id", "left_semi").select(F.col("test_id").alias("id")).distinct()
    count = lambda df, part: df.agg(F.count("*").cast("int").alias("rank")).select(F.lit("count").alias("part"), "rank", F.lit(part).alias("id"))
    return reduce(
        DataFrame.unionByName,
        [
            _ranked(top, "symbol", [F.desc("score"), "qualified_name"], most), _ranked(edges.select("id").distinct(), "relation", ["id"], shown), _ranked(about, "claim", ["id"], shown), _ranked(tests, "test", ["id"], shown),
            count(edges.select("id").distinct(), "relations"), count(about, "claims"), count(tests, "tests"), count(edges.filter("status <> 'exact'").select("id").distinct(), "not_exact"),
        ],
    )


def agent_context(items: DataFrame, terms: list[str], include_rejected: bool = False) -> DataFrame:
    """Items that match any term, or all where none does; without rejected ones; id, excluded (rejected, left out)."""
    hit = S.any_term(items, terms).select("id").withColumn("hit", F.lit(True))
    marked = items.join(hit, "id", "left")
    some = marked.agg(F.coalesce(F.max("hit"), F.lit(False)).alias("some_hit"))  # one row
    kept = marked.crossJoin(F.broadcast(some)).filter(~F.col("some_hit") | F.col("hit"))
    rejected = F.coalesce(F.col("status") == "rejected", F.lit(False))
    return kept.select("id", F.lit(False).alias("excluded") if include_rejected else rejected.alias("excluded"))


def scenario_context(items: DataFrame, scenario: str, terms: list[str] | None = None, limit: int = 16, concepts: int = 8) -> DataFrame:
    """The items of a scenario, in item order: part, rank, id.

    Matched are the items of the scenario's concepts, by concept (score, then label) and item order. With terms of a task that any
    item has, only those of them that have one; if none is left, all items that do. If nothing is matched at all, the 16 items
    that share most tokens with the scenario, ties by id; failing that all items. The first `limit` of these are kept (the first in
    every task, merged), and are put back into item order.
    """
    found = F.broadcast(S.detect_concepts(items, scenario, concepts).select("concept_id", "score", F.col("label").alias("l")))  # `concepts` rows
    by_concept = S.matched_items(items, scenario).drop("score", "label").join(found, "concept_id").select("id", F.struct((-F.col("score")).alias("a"), F.col("l").alias("b")).alias("c"))
    task = S.any_term(items, terms).select("id").distinct() if terms else items.select("id").limit(0)
    overlap = S.overlap_ranking(items, scenario, 16).select("id", F.struct((-F.col("overlap").cast("double")).alias("a"), F.col("id").alias("b")).alias("o"))
    marked = items.select("id", "seq").join(by_concept, "id", "left").join(task.withColumn("t", F.lit(True)), "id", "left").join(F.broadcast(overlap), "id", "left")
    stage = F.when(F.col("c").isNotNull() & F.col("t"), 1).when(F.col("t"), 2).when(F.col("c").isNotNull(), 3).when(F.col("o").isNotNull(), 4).otherwise(5)
    marked = marked.withColumn("stage", stage)
    best = marked.agg(F.min("stage").alias("best"))  # one row
    order = F.when(F.col("stage").isin(1, 3), F.col("c")).when(F.col("stage") == 4, F.col("o"))
    kept = marked.crossJoin(F.broadcast(best)).filter("stage = best").orderBy(order, "seq", "id").limit(limit)
    return _ranked(kept, "item", ["seq", "id"], limit)


def context_parts(matched: DataFrame, items: DataFrame, include_rejected: bool = False) -> DataFrame:
    """All that an agent's context holds of the matched items (id): part, at (item order), place, id, ref, text.

    items: seq, id, subject, predicate, object, source_id, source_text, status. knowledge (ref: source, text: object), relation, evidence (ref: item; texts:
    predicate, source text) and rule (text: title) of every usable item, which rejected ones aren't unless they are asked for; each
    of their concepts once, under the last item's label and linked to it; excluded: how many matched items are left out;
    conflicts: items of the whole table whose object differs from the one before of the same subject and predicate. An id that
    several items have stands for all of them. Nothing is cut: parts are rows, to be read by (part, at, place).
    """
    rows = items.join(matched.select("id").distinct(), "id", "left_semi")
    rejected = F.coalesce(F.col("status") == "rejected", F.lit(False))
    usable = rows if include_rejected else rows.filter(~rejected)
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    part = lambda name, id_, ref, body: F.struct(F.lit(name).alias("part"), F.lit(0).alias("place"), id_.alias("id"), ref.alias("ref"), body.alias("text"))
    own = F.array(part("knowledge", F.col("id"), text("source_id"), text("object")), part("relation", F.concat(F.lit("kr-"), "id"), F.col("id"), text("predicate")), part("evidence", F.concat(F.lit("evidence-"), "id"), F.col("id"), text("source_text")))
    out = [usable.select(F.col("seq").alias("at"), F.explode(own).alias("p")).select("p.part", "at", "p.place", "p.id", "p.ref", "p.text")]
    ruled = item_rules(usable.select("id", "subject", "predicate", "object").distinct()).join(usable.select(F.col("id").alias("item_id"), F.col("seq").alias("at")), "item_id")
    out.append(ruled.select(F.lit("rule").alias("part"), "at", F.col("position").alias("place"), F.col("rule_id").alias("id"), F.col("item_id").alias("ref"), F.col("title").alias("text")))
    last = usable.groupBy(F.concat(F.lit("concept-"), slugify(text("subject"))).alias("c")).agg(F.max_by(F.struct("id", text("subject").alias("label")), "seq").alias("l"))
    out.append(last.select(F.lit("concept").alias("part"), F.lit(None).cast("long").alias("at"), F.lit(0).alias("place"), F.col("c").alias("id"), F.col("l.id").alias("ref"), F.col("l.label").alias("text")))
    n = rows.agg(F.count_if(rejected & F.lit(not include_rejected)).alias("n"))
    out.append(n.select(F.lit("excluded").alias("part"), F.lit(None).cast("long").alias("at"), F.lit(0).alias("place"), F.lit("excluded").alias("id"), F.lit("").alias("ref"), F.col("n").cast("string").alias("text")))
    odd = S.conflicts(items.select("seq", "id", text("subject").alias("subject"), text("predicate").alias("predicate"), text("object").alias("object")), ["subject", "predicate"], "object")
    out.append(odd.select(F.lit("conflict").alias("part"), F.col("seq").alias("at"), F.lit(0).alias("place"), "id", F.col("subject").alias("ref"), F.col("predicate").alias("text")))
    return reduce(DataFrame.unionByName, out)


def context_details(chosen: DataFrame, items: DataFrame, sources: DataFrame) -> DataFrame:
    """chosen (id) with what an agent reads of each item: id, concept_id, rule (a row each), source_title, source_text.

    sources (source_id, title, seq): the last of equal ids counts, a missing one gives a null title.
    """
    rows = items.join(chosen.select("id").distinct(), "id", "left_semi")
    rules = decision_rules(rows)
    rows = C.enrich(rows, sources.withColumnRenamed("title", "source_title"), "source_id", ["source_title"], "seq")
    return rows.join(rules, "id").select("id", F.concat(F.lit("concept-"), slugify(F.col("subject"))).alias("concept_id"), "rule", "source_title", "source_text")


def harness_summary(context: DataFrame, relations: DataFrame, evidence_shown: int = 5) -> DataFrame:
    """Of a code context (part, rank, id): its counts, its first symbol, how many of the relations shown are exact, and the first evidence ids: name, value."""
    counts = context.filter("part = 'count'").select(F.col("id").alias("name"), F.col("rank").cast("string").alias("value"))
    first = context.filter("part = 'symbol' and rank = 1").select(F.lit("first_symbol").alias("name"), F.col("id").alias("value"))
    shown = relations.join(F.broadcast(context.filter("part = 'relation'").select("id")), "id", "left_semi")  # as many as a context shows
    exact = shown.filter("status = 'exact'").agg(F.count_distinct("id").cast("string").alias("value")).select(F.lit("exact_shown").alias("name"), "value")
    evidence = shown.agg(F.array_join(F.slice(F.array_sort(F.collect_set("evidence")), 1, evidence_shown), ",").alias("value")).select(F.lit("evidence").alias("name"), "value")
    return reduce(DataFrame.unionByName, [counts, first, exact, evidence])
