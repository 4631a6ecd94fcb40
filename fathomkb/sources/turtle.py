"""Knowledge items as RDF Turtle: blocks in the order of the items, each concept and object once, under names that don't collide."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathomkb.functions.scalars import slugify
from fathomkb.operators.rules import item_rules

from .spread import hot_keys, join_spread

#: The head of a document, and the low halves of FNV-1a's start and prime (a product's low half needs no more).
PREFIXES = ["@prefix sopkb: <https://example.org/sopkb/> .", "@prefix dcterms: <http://purl.org/dc/terms/> .", "@prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> ."]
FNV_START, FNV_PRIME = 0x84222325, 0x1B3


def ttl_name(x: Column) -> Column:
    return F.replace(slugify(x), F.lit("-"), F.lit("_"))


def escape_ttl(x: Column) -> Column:
    for old, new in (("\\", "\\\\"), ('"', '\\"'), ("\n", " "), ("\r", "\\r"), ("\t", "\\t")):
        x = F.replace(x, F.lit(old), F.lit(new))
    return x


def fnv1a_low(x: Column) -> Column:
    """The low 32 bits of the 64-bit FNV-1a hash of a text's bytes, as eight hex digits."""
    bytes_ = F.hex(F.encode(x, "UTF-8"))
    at = F.sequence(F.lit(1), F.length(bytes_) - 1, F.lit(2))
    byte = lambda i: F.conv(F.substr(bytes_, i, F.lit(2)), 16, 10).cast("long")
    step = lambda h, i: (h.bitwiseXOR(byte(i)) * FNV_PRIME).bitwiseAND(0xFFFFFFFF)
    low = F.when(F.length(bytes_) > 0, F.aggregate(at, F.lit(FNV_START).cast("long"), step)).otherwise(F.lit(FNV_START).cast("long"))
    return F.lower(F.lpad(F.hex(low), 8, "0"))


def object_label(x: Column) -> Column:
    """A text of at most nine words as it is, else its first nine without what ends a clause."""
    t = F.regexp_replace(x, r"^\s+|\s+$", "")
    words = F.split(t, r"\s+")
    return F.when(F.size(words) <= 9, t).otherwise(F.regexp_replace(F.array_join(F.slice(words, 1, 9), " "), "[.,;:]+$", ""))


def _relations(items: DataFrame) -> DataFrame:
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    label = object_label(text("object"))
    return items.select(
        "seq", "id", text("subject").alias("subject"), text("object").alias("text"), label.alias("label"), text("source_id").alias("source"), text("status").alias("status"),
        ttl_name(F.concat(F.lit("kr-"), "id")).alias("relation"), ttl_name(F.concat(F.lit("concept-"), slugify(text("subject")))).alias("concept"),
        ttl_name(F.concat(F.lit("predicate-"), slugify(text("predicate")))).alias("predicate"), ttl_name(F.concat(F.lit("object-"), F.substring(slugify(label), 1, 64))).alias("base"),
        ttl_name(F.col("id")).alias("piece"), ttl_name(F.concat(F.lit("evidence-"), "id")).alias("evidence"),
    )


def registered(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with `name`, first rows of each name): rows (seq, base, label, text) under names that stand for one (label, text) each.

    The first (label, text) of a base, by seq, has the base as its name; others get a short hash of label and text behind it.
    Only each base's first row is joined to the rows, with much used bases dealt over parts; the rest each row tells by itself.
    """
    leaders = rows.groupBy("base").agg(F.min_by(F.struct("label", "text"), "seq").alias("first"), F.count("*").alias("n"))
    named = join_spread(rows, leaders.drop("n"), "base", "seq", hot_keys(leaders, "base", "n"))
    same = (F.col("label") == F.col("first.label")) & (F.col("text") == F.col("first.text"))
    named = named.withColumn("name", F.when(same, F.col("base")).otherwise(F.concat_ws("_", "base", fnv1a_low(F.concat("label", F.lit("\0"), "text"))))).drop("first")
    return named, named.groupBy("base", "label", "text").agg(F.min(F.struct("seq", "name")).alias("f")).select("f.seq", "f.name", "label", "text")


def turtle_blocks(items: DataFrame, authored: str | None = None) -> DataFrame:
    """items (seq, id, subject, predicate, object, source_id, status) -> seq, place, block: the document's blocks, to be read by (seq, place).

    seq is null for the head. A concept is described before the first item that has it as subject, an object before the first
    item with its (label, text); every item gives its relation, the plain triple, and a block for each decision rule that has an
    obliged fact. Null texts are empty; seq must be distinct; an empty table gives the head alone.
    """
    r, objects = registered(_relations(items))
    lines = lambda *parts: F.concat_ws("\n", *parts)
    say = lambda pattern, *columns: F.format_string(pattern, *columns)
    concepts = r.groupBy("concept").agg(F.min(F.struct("seq", "subject")).alias("f"))
    concepts = concepts.select("f.seq", F.lit(0).alias("place"), lines(say("sopkb:%s a sopkb:Concept ;", "concept"), say('  rdfs:label "%s" .', escape_ttl(F.col("f.subject"))), F.lit("")).alias("block"))
    objects = objects.select("seq", F.lit(1).alias("place"), lines(say("sopkb:%s a sopkb:RelationObject ;", "name"), say('  rdfs:label "%s" ;', escape_ttl(F.col("label"))), say('  sopkb:objectText "%s" .', escape_ttl(F.col("text"))), F.lit("")).alias("block"))
    own = lines(
        say("sopkb:%s a sopkb:KnowledgeRelation ;", "relation"), say("  sopkb:subject sopkb:%s ;", "concept"), say("  sopkb:predicate sopkb:%s ;", "predicate"), say("  sopkb:object sopkb:%s ;", "name"),
        say("  sopkb:knowledgePiece sopkb:%s ;", "piece"), say("  sopkb:evidence sopkb:%s ;", "evidence"), say('  dcterms:source "%s" ;', escape_ttl(F.col("source"))), say('  sopkb:reviewStatus "%s" .', escape_ttl(F.col("status"))),
        F.lit(""), say("sopkb:%s sopkb:%s sopkb:%s .", "concept", "predicate", "name"), F.lit(""),
    )
    relations = r.select("seq", F.lit(2).alias("place"), own.alias("block"))
    rules = item_rules(items, authored=authored).filter("fact is not null").join(_relations(items).select("seq", F.col("id").alias("item_id"), "relation", "piece", "evidence"), "item_id")
    rule = lines(
        say("sopkb:%s a sopkb:DecisionRule ;", ttl_name(F.col("rule_id"))), say('  rdfs:label "%s" ;', escape_ttl(F.col("title"))), say("  sopkb:knowledgePiece sopkb:%s ;", "piece"), say("  sopkb:knowledgeRelation sopkb:%s ;", "relation"),
        say("  sopkb:evidence sopkb:%s ;", "evidence"), say('  sopkb:conditionFact "%s" ;', escape_ttl(F.coalesce("condition", F.lit("always")))), say('  sopkb:obligationFact "%s" ;', escape_ttl(F.col("fact"))),
        say('  sopkb:otherwiseActionRequired "%s" .', F.col("required").cast("string")), F.lit(""),
    )
    rules = rules.select("seq", (F.col("position") + 3).alias("place"), rule.alias("block"))
    head = items.sparkSession.createDataFrame([(None, -1, "\n".join([*PREFIXES, ""]))], "seq long, place int, block string")
    return head.unionByName(concepts).unionByName(objects).unionByName(relations).unionByName(rules)
