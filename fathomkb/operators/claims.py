"""Review overlays, lifecycle, merges and reports over claims and items."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fathomkb.sources.shared import written
from fathomkb.functions.scalars import nonempty, slugify


def overlay(claims: DataFrame, decisions: DataFrame) -> DataFrame:
    """Claims with the decision of a review, where there is one, as their status."""
    d = decisions.groupBy(F.col("claim_id").alias("id")).agg(F.max("decision").alias("decision"))
    return claims.join(d, "id", "left").withColumn("review_status", F.coalesce("decision", "review_status")).drop("decision")


def for_symbols(claims: DataFrame, claim_symbols: DataFrame, ids: DataFrame) -> DataFrame:
    """Claims about any of the symbols."""
    hit = claim_symbols.join(ids.select(F.col("id").alias("symbol_id")), "symbol_id", "left_semi").select(F.col("claim_id").alias("id")).distinct()
    return claims.join(hit, "id", "left_semi")


def primary(claims: DataFrame, claim_symbols: DataFrame, symbols: DataFrame) -> DataFrame:
    """Each symbol's claim of the lowest tier, the first of several; its title where it has none."""
    c = claim_symbols.join(claims.select(F.col("id").alias("claim_id"), "claim", "tier", "seq"), "claim_id").groupBy(F.col("symbol_id").alias("id")).agg(F.min_by("claim", F.struct("tier", "seq")).alias("claim"))
    return symbols.select("id", "title").join(c, "id", "left").select("id", F.coalesce("claim", "title").alias("label"))


def lifecycle_counts(claims: DataFrame) -> DataFrame:
    return claims.groupBy(nonempty(F.col("lifecycle_status"), "active").alias("status")).agg(F.count("*").alias("n"))


def concept_index(items: DataFrame) -> DataFrame:
    """Concepts by slug of the subject: first label, items, and how many have each status."""
    s = F.coalesce("status", F.lit("unknown"))
    out = items.groupBy(F.concat(F.lit("concept-"), slugify(F.col("subject"))).alias("concept_id")).agg(
        F.min_by("subject", "seq").alias("label"), F.count("*").alias("item_count"), *(F.count_if(s == k).alias(k) for k in ("approved", "proposed", "rejected", "unknown"))
    )
    return out.orderBy(F.lower("label"))


def merge_code(old: DataFrame, new: DataFrame, current: DataFrame) -> DataFrame:
    """Old and new claims (id, symbol_id, version, lifecycle_status) against current symbols (symbol_id, version).

    A re-mined id is replaced and active; what was not active stays; without a live symbol: retired; of a version that
    is gone: superseded; of a current version but not mined again: retired.
    """
    live = current.select("symbol_id", F.col("version").alias("now")).dropDuplicates(["symbol_id"])
    both = old.select("id", "symbol_id", "version", nonempty(F.col("lifecycle_status"), "active").alias("was")).join(new.select("id", F.col("symbol_id").alias("s2"), F.col("version").alias("v2"), F.lit(True).alias("mined")), "id", "full").withColumns({"symbol_id": F.coalesce("s2", "symbol_id"), "version": F.coalesce("v2", "version")})
    state = F.when(F.col("mined"), "active").when(F.col("was") != "active", F.col("was")).when(F.col("now").isNull(), "retired").when(F.col("now") != F.col("version"), "superseded").otherwise("retired")
    return both.join(live, "symbol_id", "left").select("id", "symbol_id", "version", state.alias("lifecycle_status"))


def merge_items(old: DataFrame, new: DataFrame) -> DataFrame:
    """Items (id, source_id, version, lifecycle_status): those of a re-mined version go, active ones of a re-mined source are superseded by all its new ids, others stay; new ones are added."""
    by = new.groupBy("source_id").agg(F.array_join(F.sort_array(F.collect_set("id")), ",").alias("by"), F.max("version").alias("new_version"))
    kept = old.join(by, "source_id", "left").filter("new_version is null or version <> new_version")
    gone = F.col("new_version").isNotNull() & (nonempty(F.col("lifecycle_status"), "active") == "active")
    kept = kept.select("id", "source_id", "version", F.when(gone, "superseded").otherwise(nonempty(F.col("lifecycle_status"), "active")).alias("lifecycle_status"), F.when(gone, F.col("by")).alias("superseded_by"))
    return kept.unionByName(new.select("id", "source_id", "version", F.lit("active").alias("lifecycle_status"), F.lit(None).cast("string").alias("superseded_by")))


def retire_source(items: DataFrame, source_id: str) -> DataFrame:
    hit = (F.col("source_id") == source_id) & (nonempty(F.col("lifecycle_status"), "active") == "active")
    return items.withColumn("lifecycle_status", F.when(hit, "retired").otherwise(F.col("lifecycle_status")))


def retire_versions(versions: DataFrame, source_id: str) -> DataFrame:
    """Versions (source_id, version, status) with the source's active ones retired; others, and a source retired before, stay."""
    hit = (F.col("source_id") == source_id) & (nonempty(F.col("status"), "active") == "active")
    return versions.withColumn("status", F.when(hit, "retired").otherwise(F.col("status")))


def retirement_event(versions: DataFrame, items: DataFrame, source_id: str) -> DataFrame:
    """The event of a retirement: source_id, versions and items that it retires; no row where there is nothing left to retire."""
    of = lambda df, status: df.agg(F.count_if((F.col("source_id") == source_id) & (nonempty(F.col(status), "active") == "active")).alias("n"))
    both = of(versions, "status").withColumnRenamed("n", "versions").join(F.broadcast(of(items, "lifecycle_status").withColumnRenamed("n", "items")))  # one row each
    return both.filter("versions + items > 0").select(F.lit(source_id).alias("source_id"), "versions", "items")


TERMINAL = ("approved", "rejected")


def fold_reviews(events: DataFrame) -> DataFrame:
    """The state of each item after its review log: approved and rejected end it; edits set "edited"; comments and deferrals leave it.

    Returns item_id, status, n_applied (events up to the first terminal one), last_seq.
    """
    terminal = F.min(F.when(F.col("action").isin(*TERMINAL), F.col("seq"))).alias("ended")
    ends = events.groupBy("item_id").agg(terminal)
    live = events.join(ends, "item_id").filter("ended is null or seq <= ended")
    state = F.max_by(F.col("action"), F.when(F.col("action").isin("approved", "rejected", "edited"), F.col("seq")))
    return live.groupBy("item_id").agg(F.coalesce(F.when(F.count_if(F.col("action").isin("approved", "rejected", "edited")) > 0, state), F.lit("proposed")).alias("status"), F.count("*").alias("n_applied"), F.max("seq").alias("last_seq"))


def numbered(rows: DataFrame, by: str, order: list[str]) -> DataFrame:
    """rows with `number`, from 1 within each `by` in order, and `total`, the rows of that `by`.

    Rows are dealt by ranges of (by, order), numbered within each range and moved on by the sizes of the ranges before
    it, so that one value of `by` may hold most of the table. The ranges are a written table, as they must not change.
    """
    dealt = written(rows.repartitionByRange(F.col(by), *map(F.col, order)).withColumn("range_", F.spark_partition_id()), "ranges")
    before = Window.partitionBy(by).orderBy("range_")  # a row for each value and range
    sizes = dealt.groupBy(by, "range_").agg(F.count("*").alias("n_")).withColumns({"before_": F.sum("n_").over(before) - F.col("n_"), "total": F.sum("n_").over(Window.partitionBy(by))})
    own = F.row_number().over(Window.partitionBy(by, "range_").orderBy(*order))
    out = dealt.withColumn("own_", own).join(sizes.select(F.col(by).alias("by_"), F.col("range_").alias("r_"), "before_", "total"), F.col(by).eqNullSafe(F.col("by_")) & (F.col("range_") == F.col("r_")))
    return out.select(*rows.columns, (F.col("own_") + F.col("before_")).alias("number"), "total")


def version_chain(rows: DataFrame, source: str, order: list[str], checksum: str) -> DataFrame:
    """Versions of each source in order: number, whether the content was seen before (unchanged), whether it is the latest."""
    key = F.struct(*order)
    first = rows.groupBy(F.col(source).alias("s_"), F.col(checksum).alias("c_")).agg(F.min(key).alias("first_"))
    out = numbered(rows, source, order).join(first, F.col(source).eqNullSafe(F.col("s_")) & F.col(checksum).eqNullSafe(F.col("c_")))
    return out.select(*rows.columns, F.col("number").alias("version"), (key != F.col("first_")).alias("unchanged"), (F.col("number") == F.col("total")).alias("latest"))


def update_preview(files: DataFrame, known: DataFrame) -> DataFrame:
    """files (id, filename, checksum) against known sources (id, filename, checksum): by id, else by filename."""
    by_id = known.groupBy("id").agg(F.collect_set("checksum").alias("a"))
    by_name = known.groupBy("filename").agg(F.collect_set("checksum").alias("b"))
    joined = files.join(by_id, "id", "left").join(by_name, "filename", "left").withColumn("seen", F.coalesce("a", "b"))
    kind = F.when(~F.lower("filename").rlike(r"\.(md|txt|pdf|docx)$"), "unsupported").when(F.col("seen").isNull(), "new_source").when(F.array_contains("seen", F.col("checksum")), "unchanged_version").otherwise("new_version")
    return joined.select("id", "filename", kind.alias("update"))


def cache_prune(entries: DataFrame, live: DataFrame) -> DataFrame:
    """The newest entry of each live symbol (ties: the later one)."""
    return entries.join(live.select("symbol_id").distinct(), "symbol_id", "left_semi").groupBy("symbol_id").agg(F.max_by("entry_id", F.struct("stored_at", "seq")).alias("entry_id"))


def payload_dedupe(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Each key once: at its first position, with its last value."""
    return rows.groupBy(key).agg(F.min("seq").alias("position"), *(F.max_by(c, "seq").alias(c) for c in columns))


def review_detail(items: DataFrame) -> DataFrame:
    """Whether an item can still be reviewed, and the actions that are open to it: terminal items take no edit."""
    ended = F.coalesce(F.col("status").isin(*TERMINAL), F.lit(False))
    actions = F.array(*map(F.lit, ["approved", "commented", "deferred", "edited", "rejected"]))
    open_ = F.when(ended, F.array_except(actions, F.array(F.lit("edited")))).otherwise(actions)
    return items.select("id", F.coalesce("status", F.lit("proposed")).alias("status"), (~ended).alias("mutable"), F.array_join(open_, ",").alias("actions"))


def focused_graph(items: DataFrame, most: int = 18) -> DataFrame:
    """The first items of the concept with the most items (ties: the last label), with their position."""
    top = items.groupBy("subject").agg(F.count("*").alias("n")).agg(F.max_by("subject", F.struct("n", "subject")).alias("concept"))  # one row
    of = items.join(F.broadcast(top), F.col("subject") == F.col("concept")).orderBy("seq").limit(most)
    return of.select("id", "concept", F.row_number().over(Window.orderBy("seq")).cast("long").alias("position"))


def latest_versions(rows: DataFrame, key: str, number: str, checksum: str) -> DataFrame:
    """key, versions, checksums (distinct ones), latest number of each key."""
    return rows.groupBy(key).agg(F.count("*").alias("versions"), F.count_distinct(checksum).alias("checksums"), F.max(number).alias("latest"))


def enrich(rows: DataFrame, dimension: DataFrame, key: str, columns: list[str], order: str) -> DataFrame:
    """rows with columns of a dimension by key; the last of equal keys (by order) counts, a missing key gives nulls."""
    last = dimension.groupBy(key).agg(F.max_by(F.struct(*columns), order).alias("_d"))
    return rows.join(last, key, "left").select(*rows.columns, *(F.col(f"_d.{c}").alias(c) for c in columns))
