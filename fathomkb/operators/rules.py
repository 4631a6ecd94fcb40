"""Decision rules of knowledge items, with what they oblige to, and the graph around one concept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathomkb.functions.scalars import slugify

#: A rule's suffix, title, obliged fact, action and label, condition fact, whether the action is required otherwise, and
#: the texts that an item's object must hold (of a group all, of the groups any).
KEYWORD_RULES = [
    ("confirm-patient-identity", "Confirm patient identity", "patient_identity_confirmed", "confirm", "Patient identity confirmed", None, True, [["confirm patient identity"]]),
    ("record-contraindications", "Record contraindications", "contraindications_recorded", "record", "Contraindications recorded", None, True, [["record contraindication"], ["record contraindications"]]),
    ("route-uncertain-case", "Route uncertain cases for clinical review", "route_clinical_review", "route", "Route case for clinical review", "case_uncertainty", False, [["uncertain", "clinical review"]]),
]
ITEMS_SHOWN, RULES_SHOWN = 18, 4


def _text(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(""))


def item_rules(items: DataFrame, rules: list[tuple] = KEYWORD_RULES, authored: str | None = None) -> DataFrame:
    """items (id, subject, predicate, object) -> item_id, position, rule_id, title, fact, action, label, condition, required: a row for each rule, in order.

    The keyword rules that an item's object fits, case aside; failing those one rule made of the item itself. With `authored`, a
    column of arrays of structs (id, title, fact, action, label, condition, required), an item that has any keeps just these: a
    missing id is made from the title, failing that the predicate, a missing title is the subject, required is true unless it
    says otherwise, and a fact stays null. Null texts count as empty; repeated items have their rules again.
    """
    low = F.lower(_text("object"))
    kind = "struct<rule_id:string,title:string,fact:string,action:string,label:string,condition:string,required:boolean>"
    rule = lambda *parts: F.struct(*parts).cast(kind)
    named = lambda suffix: F.concat_ws("-", F.lit("rule"), "id", suffix)
    fits = lambda groups: F.greatest(F.lit(False), *(F.least(F.lit(True), *(F.contains(low, F.lit(w)) for w in g)) for g in groups))
    found = F.array_compact(F.array(*(F.when(fits(groups), rule(named(F.lit(suffix)), *map(F.lit, (title, fact, action, label, condition, required)))) for suffix, title, fact, action, label, condition, required, groups in rules)))
    fact = F.concat(F.lit("scenario_mentions_"), F.replace(slugify(_text("subject")), F.lit("-"), F.lit("_")))
    own = rule(named(slugify(_text("predicate"))), _text("subject"), fact, _text("predicate"), _text("object"), F.lit(None), F.lit(True))
    all_ = F.when(F.size(found) > 0, found).otherwise(F.array(own))
    if authored:
        title = lambda r: F.nullif(r["title"], F.lit(""))
        given = F.transform(authored, lambda r: rule(F.coalesce(r["id"], named(slugify(F.coalesce(title(r), _text("predicate"))))), F.coalesce(title(r), _text("subject")), r["fact"], r["action"], r["label"], r["condition"], F.coalesce(r["required"], F.lit(True))))
        all_ = F.when(F.coalesce(F.size(authored), F.lit(0)) > 0, given).otherwise(all_)
    return items.select(F.col("id").alias("item_id"), F.posexplode(all_).alias("position", "r")).select("item_id", "position", "r.*")


def concept_graph(items: DataFrame, concept: str | None = None, most: int = ITEMS_SHOWN, rules: int = RULES_SHOWN, authored: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) around a concept: its first `most` items by seq, each with its relation, its evidence and its first `rules` rules.

    items: seq, id, subject, predicate, object, source_text. Without a concept id it is that of the largest (items, rules, label). nodes: id, type,
    label, position; edges: source, target, type, position. An unknown concept, and an empty table, give no rows. The limits are
    what is shown; counts to choose by are taken over all.
    """
    of = F.concat(F.lit("concept-"), slugify(_text("subject")))
    if concept is None:
        n = items.groupBy(of.alias("c")).agg(F.count("*").alias("items"), F.min_by(_text("subject"), "seq").alias("label"))
        n = n.join(item_rules(items, authored=authored).join(items.select(F.col("id").alias("item_id"), of.alias("c")).distinct(), "item_id").groupBy("c").agg(F.count("*").alias("rules")), "c")
        chosen = n.agg(F.max_by("c", F.struct("items", "rules", "label")).alias("concept"))  # one row
    else:
        chosen = items.sparkSession.createDataFrame([(concept,)], "concept string")
    group = items.withColumn("c_", of).join(F.broadcast(chosen), F.col("c_") == F.col("concept"))
    first = group.agg(F.min_by(F.struct(F.col("c_").alias("id"), _text("subject").alias("label")), "seq").alias("g")).filter("g is not null")
    shown = group.orderBy("seq").limit(most)
    made = item_rules(shown, authored=authored).filter(F.col("position") < rules).select("item_id", F.struct("position", "rule_id", "title").alias("r"))
    r = made.groupBy("item_id").agg(F.array_sort(F.collect_list("r")).alias("rules"))
    rows = shown.join(r, F.col("id") == F.col("item_id"))
    relation, evidence = F.concat(F.lit("kr-"), "id"), F.concat(F.lit("evidence-"), "id")
    node = lambda id_, type_, label: F.struct(id_.alias("id"), F.lit(type_).alias("type"), label.alias("label"))
    edge = lambda a, b, type_: F.struct(a.alias("source"), b.alias("target"), F.lit(type_).alias("type"))
    nodes = F.concat(F.array(node(F.col("id"), "knowledge_item", _text("object")), node(relation, "relation", _text("predicate")), node(evidence, "evidence", _text("source_text"))), F.transform("rules", lambda x: node(x["rule_id"], "rule", x["title"])))
    edges = F.concat(F.array(edge(F.col("c_"), F.col("id"), "anchors"), edge(F.col("id"), relation, "has_relation"), edge(F.col("id"), evidence, "supported_by")), F.transform("rules", lambda x: edge(F.col("id"), x["rule_id"], "has_rule")))
    out = lambda list_, columns: rows.select("seq", F.posexplode(list_).alias("p", "x")).select(*(f"x.{c}" for c in columns), F.struct("seq", "p").alias("position"))
    top = first.select("g.id", F.lit("concept").alias("type"), "g.label", F.struct(F.lit(None).cast("long").alias("seq"), F.lit(0).alias("p")).alias("position"))
    return top.unionByName(out(nodes, ["id", "type", "label"])), out(edges, ["source", "target", "type"])
