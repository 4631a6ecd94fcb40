"""Search, filters and ranking over sources, symbols, relations, claims and items."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fathomkb.functions.scalars import meaningful_tokens, nonempty, normalize_separators, slugify
from fathomkb.sources.spread import running


def has(haystack: Column, needle: str) -> Column:
    """Case-insensitive substring; an empty needle is no constraint."""
    return F.contains(F.lower(F.coalesce(haystack, F.lit(""))), F.lit(needle.lower())) if needle else F.lit(True)


def files_search(sources: DataFrame, query: str = "", language: str = "") -> DataFrame:
    """Separator-normalised substring over id, path and language; an exact language, if given; ordered by path."""
    hay = normalize_separators(F.concat_ws(" ", "id", "path", "language"))
    out = sources.filter(F.contains(hay, normalize_separators(F.lit(query))))
    return (out.filter(F.col("language") == language) if language else out).select("id", "path", "language", "checksum").orderBy("path")


def symbols_search(symbols: DataFrame, query: str, language: str = "") -> DataFrame:
    """Rows with all terms [a-z0-9]+ of the query, and only if there are none, rows with any.

    score = 100 for each term in qualified name or id, and 1 for each term found anywhere; no terms: all rows, score 0.
    """
    terms = re.findall("[a-z0-9]+", query.lower())
    base = symbols.filter(F.col("language") == language) if language else symbols
    hay = F.lower(F.concat_ws(" ", F.regexp_replace("id", "^symbol-", ""), "title", "qualified_name", "file", "kind", "docstring"))
    strong = F.lower(F.concat_ws(" ", "qualified_name", "id"))
    count = lambda h: sum((F.contains(h, F.lit(t)).cast("int") for t in terms), F.lit(0))
    scored = base.withColumn("hits", count(hay)).withColumn("score", F.lit(100) * count(strong) + F.col("hits"))
    if terms:
        every = scored.agg(F.coalesce(F.max(F.col("hits") == len(terms)), F.lit(False)).alias("some_have_all"))  # one row
        scored = scored.filter("hits > 0").crossJoin(F.broadcast(every)).filter(~F.col("some_have_all") | (F.col("hits") == len(terms)))
    return scored.select("id", "qualified_name", "kind", "score").orderBy(F.desc("score"), "qualified_name")


def relations_search(relations: DataFrame, subject: str = "", predicate: str = "", obj: str = "", status: str = "") -> DataFrame:
    """Substring on subject and object (separators normalised), equality on predicate and status; empty is no filter."""
    out = relations
    for column, text in (("subject", subject), ("object", obj)):
        if text:
            out = out.filter(F.contains(normalize_separators(F.col(column)), normalize_separators(F.lit(text))))
    for column, text in (("predicate", predicate), ("status", status)):
        if text:
            out = out.filter(F.lower(column) == text.lower())
    return out.select("seq", "id", "subject", "predicate", "object", "status", "confidence").orderBy("predicate", "subject", "object", "seq")


def knowledge_search(items: DataFrame, query: str) -> DataFrame:
    """Items that contain every white-space term of the query; an empty query gives all."""
    hay = F.lower(F.concat_ws(" ", "subject", "predicate", "object", "source_text"))
    out = items
    for term in query.lower().split():
        out = out.filter(F.contains(hay, F.lit(term)))
    return out.select("id", "subject", "predicate", "object", F.col("source_text").alias("evidence")).orderBy("id")


def any_term(items: DataFrame, terms: list[str]) -> DataFrame:
    """Items that contain at least one term; no terms give no rows."""
    hay = F.lower(F.concat_ws(" ", "subject", "predicate", "object", "source_text"))
    return items.filter(F.exists(F.array(*map(F.lit, terms)).cast("array<string>"), lambda t: F.contains(hay, F.lower(t))))


def facet(rows: DataFrame, text_columns: list[str], text: str = "", **equal: str) -> DataFrame:
    """A browser's facet filter: substring in any of the columns, equality of the others."""
    out = rows.filter(F.greatest(*(has(F.col(c), text) for c in text_columns)) if len(text_columns) > 1 else has(F.col(text_columns[0]), text))
    for column, value in equal.items():
        out = out.filter(F.lower(column) == value.lower())
    return out


def overlap_ranking(items: DataFrame, scenario: str, limit: int) -> DataFrame:
    """Items by the number of distinct meaningful tokens that they share with a scenario, ties by id."""
    tokens = meaningful_tokens(F.concat_ws(" ", "subject", "predicate", "object", "source_text"))
    return items.withColumn("overlap", F.size(F.array_intersect(tokens, meaningful_tokens(F.lit(scenario))))).filter("overlap > 0").select("id", "overlap").orderBy(F.desc("overlap"), "id").limit(limit)


def matched_items(items: DataFrame, scenario: str) -> DataFrame:
    """Items with a score for a scenario, case aside: 8 if it contains their subject, 3 for each token of the subject that it has, up to
    6 for tokens of subject, predicate, object and source text together: seq, id, concept_id, label (the subject), score (over 0)."""
    want, text = meaningful_tokens(F.lit(scenario)), F.lit(scenario.lower())
    all_ = F.concat_ws(" ", *(F.coalesce(c, F.lit("")) for c in ("subject", "predicate", "object", "source_text")))
    label = F.coalesce("subject", F.lit(""))
    shared = lambda x: F.size(F.array_intersect(meaningful_tokens(x), want))
    score = F.when(F.contains(text, F.lower(label)), 8).otherwise(0) + 3 * shared(label) + F.least(F.lit(6), shared(all_))
    return items.select("seq", "id", F.concat(F.lit("concept-"), slugify(label)).alias("concept_id"), label.alias("label"), score.cast("double").alias("score")).filter("score > 0")


def detect_concepts(items: DataFrame, scenario: str, limit: int = 8) -> DataFrame:
    """Concepts (subjects of one slug, under the first one's label) by the scores of their items: concept_id, label, score, item_count; ties by label."""
    first = items.groupBy(F.concat(F.lit("concept-"), slugify(F.coalesce("subject", F.lit("")))).alias("concept_id")).agg(F.min_by(F.coalesce("subject", F.lit("")), "seq").alias("label"))
    found = matched_items(items, scenario).groupBy("concept_id").agg(F.sum("score").alias("score"), F.count("*").alias("item_count"))
    return found.join(first, "concept_id").select("concept_id", "label", "score", "item_count").orderBy(F.desc("score"), "label").limit(limit)


def usable(approved: str = "review_status") -> Column:
    """Not rejected, active (null and empty count as active), and approved where tier 4 or a required review asks for it."""
    status = F.coalesce(F.col(approved), F.lit(""))
    return (status != "rejected") & (nonempty(F.col("lifecycle_status"), "active") == "active") & (~((F.col("tier") >= 4) & F.col("review_required")) | (status == "approved"))


def without_rejected(items: DataFrame, include_rejected: bool = False) -> DataFrame:
    return items if include_rejected else items.filter(F.coalesce("status", F.lit("")) != "rejected")


CLAIM_POOLS = {
    "retired": "lifecycle_status in ('retired', 'superseded')",
    "review_required": "coalesce(nullif(lifecycle_status, ''), 'active') = 'active' and review_required",
    "proposed": "coalesce(review_status, 'proposed') = 'proposed'",
    "approved": "review_status = 'approved'",
    "active": "coalesce(nullif(lifecycle_status, ''), 'active') = 'active'",
}


def pool_sizes(claims: DataFrame) -> DataFrame:
    """One row a pool: its number of claims, in one pass."""
    one = claims.agg(*(F.count_if(F.coalesce(F.expr(p), F.lit(False))).alias(k) for k, p in CLAIM_POOLS.items()))
    return one.unpivot([], list(CLAIM_POOLS), "pool", "claims")


def claim_pool(claims: DataFrame, pool: str = "review_required", tier: int | None = None, text: str = "", sort: str = "confidence") -> DataFrame:
    out = claims.filter(CLAIM_POOLS[pool]).filter(has(F.col("claim"), text))
    if tier is not None:
        out = out.filter(F.col("tier") == tier)
    order = {"confidence": [F.desc("confidence")], "confidence_asc": [F.asc("confidence")], "tier": [F.asc("tier")], "title": [F.lower("claim")]}[sort]
    return out.orderBy(*order, "id")


def page(rows: DataFrame, order: list[str], number: str | int, size: int) -> DataFrame:
    """A page of rows in order; the number is moved into [1, pages], anything but a number is 1."""
    number = int(number) if str(number).lstrip("-").isdigit() else 1
    pages = max(1, -(-rows.count() // size))
    return rows.orderBy(*order).offset((min(max(number, 1), pages) - 1) * size).limit(size)


def last_entries(log: DataFrame, key: str, most: int) -> DataFrame:
    """The last `most` entries of each key in order of seq."""
    return log.withColumn("from_end", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("seq")))).filter(F.col("from_end") <= most)


def suffix_repeats(rows: DataFrame, base: str, order: str = "seq") -> DataFrame:
    """Unique ids: the n-th repeat of a base gets -n."""
    n = F.row_number().over(Window.partitionBy(base).orderBy(order)) - 1
    return rows.withColumn("unique_id", F.when(n == 0, F.col(base)).otherwise(F.concat_ws("-", F.col(base), n.cast("string"))))


def conflicts(items: DataFrame, keys: list[str], value: str, order: str = "seq") -> DataFrame:
    """Rows whose value differs from a non-empty one in the row just before, within the keys; A, B, A gives two."""
    before = F.lag(value).over(Window.partitionBy(*keys).orderBy(order))
    return items.withColumn("before", before).filter((F.coalesce(F.col("before").cast("string"), F.lit("")) != "") & ~F.col("before").eqNullSafe(F.col(value)))


def anchor_pools(claims: DataFrame) -> DataFrame:
    """pool, tier, claims: active claims by what they are anchored to; null and empty are unknown."""
    active = nonempty(F.col("lifecycle_status"), "active") == "active"
    return claims.filter(active).groupBy(nonempty(F.col("anchor_status"), "unknown").alias("pool"), "tier").agg(F.count("*").alias("claims"))


def symbol_record(symbol_id: str, symbols: DataFrame, evidence: DataFrame, relations: DataFrame, claims: DataFrame, claim_symbols: DataFrame) -> DataFrame:
    """All that is known of one symbol, as rows: part, id, text.

    The first symbol of that id (by seq; text: its name), its evidence (by evidence_id; text: the excerpt), the relations whose subject
    contains the id, case aside (text: the triple), and the claims about it. An unknown symbol has no rows at all.
    """
    one = symbols.filter(F.col("id") == symbol_id).orderBy("seq").limit(1).select("id", "qualified_name", "evidence_id")
    there = F.broadcast(one.select(F.col("id").alias("there_")))  # at most one row
    part = lambda df, name, text: df.select(F.lit(name).alias("part"), "id", text.alias("text"))
    proof = evidence.join(F.broadcast(one.select(F.col("evidence_id").alias("id"))), "id", "left_semi").groupBy("id").agg(F.min_by("excerpt", "seq").alias("excerpt"))
    edges = relations.filter(F.contains(F.lower("subject"), F.lit(symbol_id.lower()))).join(there)
    about = claims.join(claim_symbols.filter(F.col("symbol_id") == symbol_id).select(F.col("claim_id").alias("id")).distinct(), "id", "left_semi").join(there)
    triple = F.concat_ws(" ", "subject", "predicate", "object")
    out = part(one, "symbol", F.col("qualified_name")).unionByName(part(proof, "evidence", F.col("excerpt")))
    return out.unionByName(part(edges, "relation", triple)).unionByName(part(about, "claim", F.col("claim")))


def by_file(symbols: DataFrame) -> DataFrame:
    """file, position, id: the symbols of each file by line, then name, then id; null files count as ""."""
    w = Window.partitionBy("file").orderBy("line", "qualified_name", "id")  # what one file defines
    return symbols.withColumn("file", F.coalesce("file", F.lit(""))).select("file", F.row_number().over(w).alias("position"), "id")


def ordered(rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows with `position`, from 1 in the order of keys, as a collection is stored; dealt by ranges, so no task sorts it all."""
    out = running(rows, [], keys)
    return out.withColumn("position", F.col("before") + 1).drop("before", "total")


def global_search(term: str, symbols: DataFrame, claims: DataFrame, sources: DataFrame, items: DataFrame, endpoints: DataFrame | None = None) -> DataFrame:
    """Typed result groups by substring, case aside: kind, id, title. endpoints: id, method, path, handler."""
    hit = lambda df, kind, title, *cols: df.filter(has(F.concat_ws(" ", *cols), term)).select(F.lit(kind).alias("kind"), "id", F.col(title).alias("title"))
    groups = [hit(symbols, "symbol", "qualified_name", "id", "qualified_name"), hit(claims, "claim", "claim", "claim"), hit(sources, "file", "path", "path"), hit(items, "document", "subject", "subject", "source_text")]
    if endpoints is not None:
        groups.append(hit(endpoints, "endpoint", "path", "method", "path", "handler"))
    return reduce(DataFrame.unionByName, groups)
