"""Reports and states of bundles, review decisions and migrations, as aggregations and row rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fathomkb.functions.scalars import nonempty
from fathomkb.sources.spread import running

#: Terms that mark an operational symbol, what a rule's predicates and kinds are, dispositions of traces.
OPERATIONAL = ["pipeline", "ingest", "preview", "workflow", "validate", "authorization", "eligibility"]
WORKFLOW = ["calls", "performs", "jumps_to", "branches_on"]
STATE_KINDS = ["record", "data_item", "data", "file"]
AUTO_APPROVED = ["preserved", "mapped", "renamed", "split", "merged"]


def describe(**tables: DataFrame) -> DataFrame:
    """name, n: the size of each table."""
    return reduce(DataFrame.unionByName, (t.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, t in tables.items()))


def active() -> Column:
    return nonempty(F.col("lifecycle_status"), "active") == "active"


def bundle_state(symbols: DataFrame, claims: DataFrame) -> DataFrame:
    """pending, state: how many active claims that need review are proposed; "not built" without symbols, "N awaiting review", "reviewed"."""
    waits = active() & (F.col("review_required") | (F.col("tier") == 4)) & (F.col("review_status") == "proposed")
    n = claims.agg(F.count_if(waits).alias("pending"))
    any_symbol = symbols.limit(1).agg(F.count("*").alias("built"))
    state = F.when(F.col("built") == 0, "not built").when(F.col("pending") > 0, F.concat(F.col("pending").cast("string"), F.lit(" awaiting review"))).otherwise("reviewed")
    return n.join(F.broadcast(any_symbol)).select("pending", state.alias("state"))  # one row each


def operational(symbols: DataFrame, relations: DataFrame, terms: list[str] = OPERATIONAL) -> DataFrame:
    """Ids of symbols with one of the terms in their qualified name, title, docstring or the predicates of their relations."""
    predicates = relations.groupBy(F.col("subject").alias("id")).agg(F.concat_ws(" ", F.collect_set("predicate")).alias("predicates"))
    text = F.lower(F.concat_ws(" ", *(F.coalesce(c, F.lit("")) for c in ("qualified_name", "title", "docstring", "predicates"))))
    found = reduce(Column.__or__, (F.contains(text, F.lit(t)) for t in terms))
    return symbols.join(predicates, "id", "left").filter(found).select("id")


def plain_data_classes(classes: DataFrame, decorators: list[str], bases: list[str]) -> DataFrame:
    """Classes (id, decorators, bases) with one of the decorators or bases."""
    hit = lambda c, names: F.coalesce(F.arrays_overlap(c, F.array(*map(F.lit, names)).cast("array<string>")), F.lit(False))
    return classes.filter(hit("decorators", decorators) | hit("bases", bases))


def external_roots(imports: DataFrame, own: DataFrame, standard: list[str]) -> DataFrame:
    """root, n: first segments of imports (name) that are neither relative nor of the repository (own: root) nor standard."""
    roots = imports.filter(~F.col("name").startswith(".")).select(F.substring_index("name", ".", 1).alias("root"))
    known = own.select("root").unionByName(own.sparkSession.createDataFrame([(x,) for x in standard], "root string")).distinct()
    return roots.join(known, "root", "left_anti").groupBy("root").agg(F.count("*").alias("n"))


def last_by_id(rows: DataFrame, order: str = "seq") -> DataFrame:
    """One row an id: the last of equal ids."""
    others = [c for c in rows.columns if c != "id"]
    return rows.groupBy("id").agg(F.max_by(F.struct(*others), order).alias("r")).select("id", "r.*")


def canonical_relations(relations: DataFrame) -> DataFrame:
    """Nested relations flattened, a claim's knowledge_tier named tier."""
    return relations.select("id", "subject", "predicate", "object", F.col("relation.resolution_status").alias("status"), F.col("relation.confidence").alias("confidence"), F.col("knowledge_tier").alias("tier"))


def citations(rows: DataFrame, evidence: str, items: DataFrame) -> DataFrame:
    """rows with the item that their evidence id stands for, one "evidence-" taken off its front: cited, id, source_text."""
    cited = rows.select(F.col(evidence).alias("cited"), F.regexp_replace(evidence, "^evidence-", "").alias("id"))
    return cited.join(items.select("id", "source_text"), "id").select("cited", "id", "source_text")


def item_relations_search(items: DataFrame, subject: str = "", predicate: str = "", obj: str = "") -> DataFrame:
    """Items whose subject, predicate and object contain the given texts, case aside; rejected ones too."""
    for column, text in (("subject", subject), ("predicate", predicate), ("object", obj)):
        if text:
            items = items.filter(F.contains(F.lower(column), F.lit(text.lower())))
    return items


def language_trace(artifacts: DataFrame, source_languages: list[str], target_languages: list[str]) -> DataFrame:
    """Artifacts (seq, id, language, name, kind) of the source languages against the last one of equal name and kind in the target languages: id, target_id, disposition."""
    target = artifacts.filter(F.col("language").isin(target_languages)).groupBy("name", "kind").agg(F.max_by("id", "seq").alias("target_id"))
    source = artifacts.filter(F.col("language").isin(source_languages))
    return source.join(target, ["name", "kind"], "left").select("id", "target_id", F.when(F.col("target_id").isNotNull(), "mapped").otherwise("unresolved").alias("disposition"))


def disposition_counts(entries: DataFrame) -> DataFrame:
    """disposition, n; entries of the older shape have it in `mapping` only."""
    return entries.groupBy(F.coalesce(F.nullif("disposition", F.lit("")), "mapping", F.lit("unknown")).alias("disposition")).agg(F.count("*").alias("n"))


def equivalence(entries: DataFrame, groups: dict[str, list[str]]) -> DataFrame:
    """label, artifacts, preserved for each group of kinds: entries (kind, disposition)."""
    rows = [entries.filter(F.col("kind").isin(kinds)).agg(F.count("*").alias("artifacts"), F.count_if(F.col("disposition") == "preserved").alias("preserved")).select(F.lit(label).alias("label"), "artifacts", "preserved") for label, kinds in groups.items()]
    return reduce(DataFrame.unionByName, rows)


def gaps_by_kind(entries: DataFrame) -> DataFrame:
    """kind, gaps, first_id of entries that are not preserved."""
    return entries.filter("disposition <> 'preserved'").groupBy(nonempty(F.col("kind"), "unknown").alias("kind")).agg(F.count("*").alias("gaps"), F.min("id").alias("first_id"))


def freshness(items: DataFrame, stale_after: Column) -> DataFrame:
    """dated, undated: how many rows say when they grow stale."""
    dated = F.coalesce(stale_after, F.lit("")) != ""
    return items.agg(F.count_if(dated).alias("dated"), F.count_if(~dated).alias("undated"))


def version_registry(sources: DataFrame) -> DataFrame:
    """Sources migrated to versions: source_id, version, version_id, status, checksum, active_version_id, synthesized, position.

    sources: id, version_number, version_id, status, checksum, versions (array of structs version_id, version_number, status, checksum). A number that isn't a
    positive integer is 1; a missing version id is that of source and number; an empty status is active. A source without versions
    gets one made of itself, which is active whatever the source is; versions that it has stay as they are. Position is from 1
    within a source, in the order of the array, dealt by ranges, as one source may have most versions. Sources without an id go.
    """
    number = F.coalesce(F.when(F.col("version_number").try_cast("int") > 0, F.col("version_number").try_cast("int")), F.lit(1))
    v = sources.filter(F.coalesce("id", F.lit("")) != "").withColumn("number_", number)
    v = v.withColumn("own_", F.coalesce(F.nullif("version_id", F.lit("")), F.concat_ws(":v", "id", F.col("number_").cast("string"))))
    made = F.array(F.struct(F.lit(0).alias("at_"), F.col("own_").alias("version_id"), F.col("number_").cast("string").alias("version_number"), F.lit("active").alias("status"), "checksum", F.lit(True).alias("made_")))
    given = F.transform("versions", lambda x, i: F.struct(i.alias("at_"), x["version_id"].alias("version_id"), x["version_number"].alias("version_number"), x["status"].alias("status"), x["checksum"].alias("checksum"), F.lit(False).alias("made_")))
    rows = v.select("id", "own_", F.explode(F.when(F.coalesce(F.size("versions"), F.lit(0)) > 0, given).otherwise(made)).alias("x")).select("id", "own_", "x.*")
    out = running(rows, ["id"], ["at_", "version_id", "own_", "checksum"])
    return out.select(F.col("id").alias("source_id"), F.col("version_number").alias("version"), "version_id", "status", "checksum", F.col("own_").alias("active_version_id"), F.col("made_").alias("synthesized"), (F.col("before") + 1).alias("position"))


def bulk_review(claims: DataFrame, chosen: DataFrame, action: str, rationale: str, statuses: dict[str, str]) -> DataFrame:
    """One decision over many claims: id, review_status, event. Only known ids count; without a rationale nothing is
    decided; an unknown action is a comment and leaves the status. Events are numbered crev-NNNN by id, dealt by ranges, and say the batch's size."""
    known = claims.join(chosen.select("id").distinct(), "id", "left_semi") if rationale.strip() else claims.limit(0)
    known = running(known.select("id", "review_status"), [], ["id"])
    status = F.lit(statuses[action]) if action in statuses else F.col("review_status")
    event = F.format_string("crev-%04d %s of %d", F.col("before") + 1, F.lit(action if action in statuses else "comment"), F.col("total"))
    return known.select("id", status.alias("review_status"), event.alias("event"))


def trace_review(entries: DataFrame, approved: list[str] = AUTO_APPROVED) -> DataFrame:
    """Entries (id, disposition, review_status): dispositions that need no judgement are approved, others stay as they are."""
    return entries.select("id", "disposition", F.when(F.col("disposition").isin(approved), "approved").otherwise(nonempty(F.col("review_status"), "proposed")).alias("review_status"))


def author_neighbourhood(relations: DataFrame, symbols: DataFrame, subject: str) -> DataFrame:
    """The distinct symbols that a subject's relations lead to, by qualified name."""
    ends = relations.filter(F.col("subject") == subject).select(F.col("object").alias("id")).distinct()
    return symbols.join(ends, "id", "left_semi").select("id", "qualified_name").orderBy("qualified_name", "id")


def architecture_summary(endpoints: DataFrame, routers: DataFrame, models: DataFrame) -> DataFrame:
    """section, kind, n: endpoints by kind, routers and models in all."""
    kinds = endpoints.groupBy(nonempty(F.col("kind"), "unknown").alias("kind")).agg(F.count("*").alias("n")).select(F.lit("endpoints").alias("section"), "kind", "n")
    rest = [t.agg(F.count("*").alias("n")).select(F.lit(name).alias("section"), F.lit("all").alias("kind"), "n") for name, t in (("routers", routers), ("models", models))]
    return reduce(DataFrame.unionByName, [kinds, *rest])


def cobol_references(refs: DataFrame, symbols: DataFrame) -> DataFrame:
    """refs (module, name) by title in upper case: the first symbol (by seq) of that title in the module, else the only one anywhere: module, name, target, external."""
    s = symbols.select("seq", "id", "module", F.upper("title").alias("key"))
    near = s.groupBy("module", "key").agg(F.min_by("id", "seq").alias("near"))
    only = s.groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("only")).filter("n = 1").drop("n")
    r = refs.select("module", "name").distinct().withColumn("key", F.upper("name"))
    target = F.coalesce("near", "only")
    return r.join(near, ["module", "key"], "left").join(only, "key", "left").select("module", "name", target.alias("target"), target.isNull().alias("external"))


def copybooks(defined: DataFrame, referenced: DataFrame) -> DataFrame:
    """name, defined, uses: copybooks that are defined, and those that are only referenced."""
    uses = referenced.groupBy(F.upper("name").alias("name")).agg(F.count("*").alias("uses"))
    own = defined.select(F.upper("name").alias("name"), F.lit(True).alias("d")).distinct()
    return own.join(uses, "name", "full").select("name", F.coalesce("d", F.lit(False)).alias("defined"), F.coalesce("uses", F.lit(0).cast("long")).alias("uses"))


def report_lines(counts: DataFrame, title: str) -> DataFrame:
    """A report of counts (name, n) as lines of Markdown: line, text; the title, a blank line, then a bullet each, largest first."""
    rows = running(counts.select("name", "n", (-F.col("n")).alias("less")), [], ["less", "name"])
    body = rows.select((F.col("before") + 3).cast("int").alias("line"), F.format_string("- %s: %d", "name", "n").alias("text"))
    top = counts.sparkSession.createDataFrame([(1, f"# {title}"), (2, "")], "line int, text string")
    return top.unionByName(body)
