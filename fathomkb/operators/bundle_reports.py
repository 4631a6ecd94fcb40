"""The standard reports of a bundle as lines of Markdown: freshness, conflicts, extraction, reviews, source updates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathomkb.sources.sinks import numbered_lines

from .search import conflicts

STATUSES = ["active", "superseded", "retired"]


def _fixed(report: str, counts: DataFrame, lines: list[tuple[int, Column | str]]) -> DataFrame:
    """Lines of one row of counts: (part, text) each."""
    rows = F.array(*(F.struct(F.lit(part).alias("part"), F.lit(i).cast("long").alias("at"), (F.lit(x) if isinstance(x, str) else x).alias("text")) for i, (part, x) in enumerate(lines)))
    return counts.select(F.explode(rows).alias("l")).select(F.lit(report).alias("document"), "l.part", F.lit("").alias("key"), "l.at", "l.text")


def _listed(report: str, part: int, rows: DataFrame, key: Column, at: Column, text: Column) -> DataFrame:
    return rows.select(F.lit(report).alias("document"), F.lit(part).alias("part"), key.alias("key"), at.cast("long").alias("at"), text.alias("text"))


def _n(label: str, column: str) -> Column:
    return F.concat(F.lit(f"{label}: "), F.col(column).cast("string"))


def _one(rows: DataFrame, **counts: Column) -> DataFrame:
    return rows.agg(*(c.alias(k) for k, c in counts.items()))


def _beside(*tables: DataFrame) -> DataFrame:
    """Tables of one row each, side by side."""
    return reduce(lambda a, b: a.crossJoin(F.broadcast(b)), tables)


def standard_reports(sources: DataFrame, versions: DataFrame, items: DataFrame, reviews: DataFrame, sections: DataFrame) -> DataFrame:
    """document, line, text of the five reports.

    sources (stale_after), versions (source_id, source_version_id, version_number, status, original_path), items (seq, id, subject, predicate, object, review_status,
    lifecycle_status, stale_after), reviews and sections (any). Empty and null stale_after don't count; a null review status is unknown, a null
    lifecycle status active; versions go by source and number, null first, then by their id. A conflict is an item whose object differs
    from a non-empty one in the item just before of that subject and predicate. Reports of many lines are numbered by ranges.
    """
    dated = lambda c: F.count_if(F.coalesce(F.col(c).cast("string"), F.lit("")) != "")
    text = lambda c, default="": F.coalesce(F.col(c).cast("string"), F.lit(default))
    out = []
    fresh = _beside(_one(sources, sources=dated("stale_after")), _one(items, items=dated("stale_after")))
    out.append(_fixed("freshness", fresh, [(0, "# Freshness Report"), (0, ""), (0, _n("Sources with freshness metadata", "sources")), (0, _n("Knowledge items with freshness metadata", "items"))]))

    named = items.select("seq", "id", text("subject").alias("subject"), text("predicate").alias("predicate"), text("object").alias("object"))
    found = conflicts(named, ["subject", "predicate"], "object")
    line = F.format_string("- Candidate conflict for `%s` / `%s` involving `%s`", "subject", "predicate", text("id"))
    out.append(_fixed("conflicts", _one(found, n=F.count("*")), [(0, "# Conflict Report"), (0, ""), (1, F.when(F.col("n") == 0, "- No candidate conflicts detected."))]))
    out.append(_listed("conflicts", 2, found, F.lit(""), F.col("seq"), line))

    sizes = _beside(_one(sections, sections=F.count("*")), _one(items, items=F.count("*")))
    out.append(_fixed("extraction_summary", sizes, [(0, "# Extraction Summary"), (0, ""), (0, _n("Sections", "sections")), (0, _n("Knowledge items", "items"))]))

    by = items.groupBy(text("review_status", "unknown").alias("status")).agg(F.count("*").alias("n"))
    sizes = _beside(_one(items, items=F.count("*")), _one(reviews, events=F.count("*")))
    nothing = F.when(F.col("items") == 0, "- No knowledge items found.")
    out.append(_fixed("review_summary", sizes, [(0, "# Review Summary"), (0, ""), (1, nothing), (3, ""), (3, _n("Review events", "events"))]))
    out.append(_listed("review_summary", 2, by, F.col("status"), F.lit(0), F.concat(F.lit("- "), _n_of("status"))))

    state = text("lifecycle_status", "active")
    counts = {f"v_{s}": F.count_if(F.col("status") == s) for s in STATUSES}
    live = {f"i_{s}": F.count_if(state == s) for s in [*STATUSES, "conflicted"]}
    sizes = _beside(_one(sources, sources=F.count("*")), _one(versions, versions=F.count("*"), **counts), _one(items, items=F.count("*"), **live))
    top = [(0, "# Source Update Impact"), (0, ""), (0, _n("Sources", "sources")), (0, _n("Source versions", "versions")), *((0, _n(f"{s.title()} source versions", f"v_{s}")) for s in STATUSES)]
    top += [(0, ""), (0, "## Knowledge Lifecycle"), *((0, _n(f"{s.title()} knowledge items", f"i_{s}")) for s in [*STATUSES, "conflicted"]), (0, ""), (1, nothing), (3, ""), (3, "## Source Versions"), (4, F.when(F.col("versions") == 0, "- No source versions found."))]
    out.append(_fixed("source_update_impact", sizes, top))
    by = items.groupBy(state.alias("status")).agg(F.count("*").alias("n"))
    out.append(_listed("source_update_impact", 2, by, F.col("status"), F.lit(0), F.concat(F.lit("- "), _n_of("status"))))
    version = F.format_string("- %s: %s `%s`", text("source_version_id", "None"), text("status", "unknown"), text("original_path"))
    out.append(_listed("source_update_impact", 5, versions, text("source_id"), F.coalesce("version_number", F.lit(0)), version))
    return numbered_lines(reduce(DataFrame.unionByName, out).filter("text is not null"), "document", ["part", "key", "at", "text"])


def _n_of(column: str) -> Column:
    return F.concat(F.col(column), F.lit(": "), F.col("n").cast("string"))
