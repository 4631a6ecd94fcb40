"""Integrity rules as one long table of findings: level, rule, id."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STATUSES = ["exact", "inferred", "unresolved"]


def findings(rows: DataFrame, rules: dict[tuple[str, str], Column]) -> DataFrame:
    """All row-level rules in one scan: a row breaks a rule where its condition holds."""
    broken = F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.struct(F.lit(level).alias("level"), F.lit(rule).alias("rule"))) for (level, rule), c in rules.items())))
    return rows.select("id", F.explode(broken).alias("f")).select("f.level", "f.rule", "id")


def missing(rows: DataFrame, key: str, known: DataFrame, known_key: str, rule: str, level: str = "error") -> DataFrame:
    """Rows whose key is not among the known ones."""
    return rows.filter(F.col(key).isNotNull()).join(known.select(F.col(known_key).alias("known")).distinct(), F.col(key) == F.col("known"), "left_anti").select(F.lit(level).alias("level"), F.lit(rule).alias("rule"), "id")


def relations(relations: DataFrame, known: DataFrame, evidence: DataFrame) -> DataFrame:
    """relations (id, subject, subject_kind, object, object_kind, predicate, status, evidence) -> level, rule, id, detail.

    Errors: a status that is none of STATUSES (null too); an end of kind module or symbol that is not among known (id); evidence
    ids that are not among evidence (id), listed in their order; an exact relation without evidence, but for imports and
    defines. A relation that is inferred or unresolved is a warning. Ends of other kinds, and relations without evidence that are
    not exact, need nothing. A finding is a row for each row of relations that has it.
    """
    r = relations.withColumn("row_", F.monotonically_increasing_id()).withColumn("evidence", F.coalesce("evidence", F.array().cast("array<string>")))
    exact = F.col("status") == "exact"
    found = findings(r, {
        ("error", "status"): ~F.coalesce(F.col("status").isin(STATUSES), F.lit(False)),
        ("error", "exact_without_evidence"): exact & (F.size("evidence") == 0) & ~F.coalesce(F.col("predicate").isin("imports", "defines"), F.lit(False)),
        ("warning", "not_exact"): F.col("status").isin("inferred", "unresolved"),
    }).withColumn("detail", F.lit(""))
    one = known.select(F.col("id").alias("known_")).distinct()
    ends = []
    for end in ("subject", "object"):
        of = r.filter(F.col(f"{end}_kind").isin("module", "symbol")).select("id", F.coalesce(end, F.lit("")).alias("end_"))
        lost = of.join(one, F.col("end_") == F.col("known_"), "left_anti")
        ends.append(lost.select(F.lit("error").alias("level"), F.lit(f"unknown_{end}").alias("rule"), "id", F.col("end_").alias("detail")))
    cited = r.select("row_", "id", F.posexplode("evidence").alias("pos", "cited")).filter("cited is not null")
    lost = cited.join(evidence.select(F.col("id").alias("known_")).distinct(), F.col("cited") == F.col("known_"), "left_anti")
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "cited"))), lambda x: x["cited"]), ", ")
    lost = lost.groupBy("row_", "id").agg(listed.alias("detail")).select(F.lit("error").alias("level"), F.lit("unknown_evidence").alias("rule"), "id", "detail")
    return reduce(DataFrame.unionByName, [found.select("level", "rule", "id", "detail"), *ends, lost])


def claims(claims: DataFrame, claim_symbols: DataFrame, symbols: DataFrame) -> DataFrame:
    active = F.coalesce(F.nullif("lifecycle_status", F.lit("")), F.lit("active")) == "active"
    found = findings(
        claims,
        {
            ("error", "tier_range"): ~F.col("tier").between(1, 4),
            ("error", "tier4_without_review"): (F.col("tier") == 4) & ~F.col("review_required"),
            ("error", "approved_unreviewed"): active & (F.col("tier") >= 3) & (F.col("review_status") == "approved") & ~F.col("review_required"),
            ("error", "confidence_range"): ~F.col("confidence").between(0, 1),
            ("warning", "low_confidence"): F.col("confidence") < 0.7,
            ("warning", "no_status"): F.col("review_status").isNull(),
        },
    )
    live = claim_symbols.join(claims.filter(active).select(F.col("id").alias("claim_id")), "claim_id", "left_semi").withColumnRenamed("claim_id", "id")
    unlinked = claims.filter(active).join(claim_symbols.select(F.col("claim_id").alias("id")).distinct(), "id", "left_anti").select(F.lit("warning").alias("level"), F.lit("no_symbol").alias("rule"), "id")
    return reduce(DataFrame.unionByName, [found, missing(live, "symbol_id", symbols, "id", "unknown_symbol"), unlinked])


def id_sets(a: DataFrame, b: DataFrame, key: str = "id") -> DataFrame:
    """What only one of two id sets has: the symmetric difference."""
    x, y = a.select(key).distinct().withColumn("a", F.lit(True)), b.select(key).distinct().withColumn("b", F.lit(True))
    both = x.join(y, key, "full")
    return both.filter("a is null or b is null").select(key, F.when(F.col("b").isNull(), "only_first").otherwise("only_second").alias("side"))


def trace(source: DataFrame, target: DataFrame) -> DataFrame:
    """source (id, name, kind) against target (name, kind): preserved where the target has the key, else missing; the last of equal keys wins."""
    t = target.groupBy("name", "kind").agg(F.max_by("id", "seq").alias("target_id"))
    return source.join(t, ["name", "kind"], "left").select("id", "target_id", F.when(F.col("target_id").isNotNull(), "preserved").otherwise("missing").alias("disposition"))


def candidate(candidates: DataFrame, kinds: list[str]) -> DataFrame:
    """Claim candidates (id, kind, cited, allowed, own, quote, source): rejection reason or null, and whether the quote is anchored in the source."""
    reason = (
        F.when(~F.col("kind").isin(kinds), "kind")
        .when(F.size(F.array_except("cited", "allowed")) > 0, "unknown_id")
        .when(~F.array_contains("cited", F.col("own")), "own_symbol_missing")
        .when(F.trim(F.coalesce("quote", F.lit(""))) == "", "quote_missing")
    )
    return candidates.select("id", reason.alias("rejected"), F.contains("source", "quote").alias("anchored"))


REVIEW_STATUSES = ["proposed", "approved", "rejected", "edited", "deferred"]
REVIEW_ACTIONS = ["approved", "rejected", "edited", "deferred", "commented"]
DISPOSITIONS = ["preserved", "mapped", "renamed", "split", "merged", "missing", "unresolved"]


def blank(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit("")) == ""


def items(items: DataFrame, reviews: DataFrame) -> DataFrame:
    """Integrity of knowledge items (id, status, source_id, section_id, source_text, span_status, confidence) and of reviews (id, item_id, action, reviewer, ts)."""
    rows = findings(
        items,
        {
            ("error", "invalid_status"): ~F.coalesce(F.col("status").isin(REVIEW_STATUSES), F.lit(False)),
            ("error", "missing_source"): blank("source_id"),
            ("error", "missing_section"): blank("section_id"),
            ("warning", "missing_text"): blank("source_text") & ~F.coalesce(F.col("span_status") == "unresolved", F.lit(False)),
            ("warning", "low_confidence"): F.coalesce("confidence", F.lit(1.0)) < 0.7,
        },
    )
    review = findings(reviews, {("error", "invalid_action"): ~F.coalesce(F.col("action").isin(REVIEW_ACTIONS), F.lit(False)), ("error", "missing_reviewer"): blank("reviewer"), ("error", "missing_timestamp"): F.col("ts").isNull()})
    return reduce(DataFrame.unionByName, [rows, review, missing(reviews, "item_id", items, "id", "unknown_item")])


def profile(bundles: DataFrame, directories: list[str]) -> DataFrame:
    """Bundles (id, profile, configured, directories): the profile's literal, its configuration, and each directory that it needs."""
    rows = findings(bundles, {("error", "profile"): ~F.col("profile").eqNullSafe("code-knowledge-bundle"), ("error", "configuration"): ~F.coalesce("configured", F.lit(False))})
    absent = bundles.select("id", F.explode(F.array_except(F.array(*map(F.lit, directories)), F.coalesce("directories", F.array().cast("array<string>")))).alias("d"))
    return rows.unionByName(absent.select(F.lit("error").alias("level"), F.concat(F.lit("directory:"), "d").alias("rule"), "id"))


def inventory(sources: DataFrame, documents: DataFrame, originals: DataFrame) -> DataFrame:
    """Sources (id, language, version_id) without a document (id), an original (id), a language or a version."""
    rows = findings(sources, {("error", "missing_version"): blank("version_id"), ("error", "missing_language"): blank("language")})
    gone = lambda known, rule: sources.join(known.select("id").distinct(), "id", "left_anti").select(F.lit("error").alias("level"), F.lit(rule).alias("rule"), "id")
    return reduce(DataFrame.unionByName, [rows, gone(documents, "missing_document"), gone(originals, "missing_original")])


def procedure(candidates: DataFrame) -> DataFrame:
    """Procedure candidates (id, required, cited, claim): the members that they don't cite, and why they are rejected or null."""
    left_out = F.array_sort(F.array_except("required", "cited"))
    reason = F.when(F.trim(F.coalesce("claim", F.lit(""))) == "", "claim_missing").when(F.size(left_out) > 0, "member_not_cited")
    return candidates.select("id", F.array_join(left_out, ",").alias("left_out"), reason.alias("rejected"))


def traces(entries: DataFrame, targets: DataFrame) -> DataFrame:
    """Trace entries (id, disposition, review_status, target_id, critical) against the known targets (id)."""
    rows = findings(
        entries,
        {
            ("error", "disposition"): ~F.coalesce(F.col("disposition").isin(DISPOSITIONS), F.lit(False)),
            ("error", "approved_unresolved"): (F.col("disposition") == "unresolved") & (F.col("review_status") == "approved"),
            ("error", "target_missing"): F.col("disposition").isin("preserved", "mapped", "renamed", "split", "merged") & blank("target_id"),
            ("warning", "critical_missing"): F.col("critical") & F.col("disposition").isin("missing", "unresolved"),
        },
    )
    return rows.unionByName(missing(entries, "target_id", targets, "id", "unknown_target"))


def rule_schema(rules: DataFrame) -> DataFrame:
    """Rules (id, condition struct<fact, operator, label>, obligation struct<fact, action, label>, otherwise string): what their schema misses.

    `otherwise` is the JSON of the else branch: its action_required must be a boolean."""
    empty = lambda c, *fields: reduce(Column.__or__, (blank(f"{c}.{f}") for f in fields))
    flag = F.get_json_object("otherwise", "$.action_required")
    return findings(
        rules.withColumn("id", F.coalesce(F.col("id").cast("string"), F.lit(""))),
        {
            ("error", "id_missing"): F.col("id") == "",
            ("error", "obligation"): F.col("obligation").isNull() | empty("obligation", "fact", "action", "label"),
            ("error", "condition"): F.col("condition").isNotNull() & empty("condition", "fact", "operator", "label"),
            ("error", "otherwise"): F.col("otherwise").isNotNull() & ~F.coalesce(flag.isin("true", "false"), F.lit(False)),
        },
    )
