"""Claims that follow from the structure of code alone: of single symbols, and of procedures that call helpers in their file."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fathomkb.functions.scalars import bounded_id

from .report import OPERATIONAL

#: A claim's kind, tier, derivation, whether it always needs review, title and text ({q}: the symbol's name,
#: {x}: what its relations name), and the predicates of the relations it rests on (none: all of the symbol's).
TEMPLATES = [
    ("cobol-workflow", 4, "fixture-cobol-workflow-relations", True, "{q} participates in COBOL workflow", "{q} has COBOL workflow relation(s): {x}.", ["performs", "calls"]),
    ("cobol-file-io", 3, "fixture-cobol-file-io-relations", False, "{q} performs COBOL file I/O", "{q} has COBOL file I/O relation(s): {x}.", ["reads", "writes"]),
    ("cobol-data-updates", 3, "fixture-cobol-update-relations", False, "{q} updates COBOL data", "{q} updates data item(s) according to line-structured COBOL analysis.", ["updates"]),
    ("cobol-branching", 3, "fixture-cobol-branch-relations", False, "{q} branches on a COBOL condition", "{q} contains conditional COBOL logic and should be reviewed as behavior.", ["branches_on"]),
    ("documents-behavior", 3, "fixture-docstring", False, "{q} documents behavior", "{q} documents this behavior: {x}", ["calls", "raises", "reads", "writes"]),
    ("raises-exception", 3, "fixture-static-relations", False, "{q} raises exceptions", "{q} raises {x} according to static analysis.", ["raises"]),
    ("reads-environment", 3, "fixture-static-relations", False, "{q} reads environment configuration", "{q} reads environment variable(s): {x}.", ["reads"]),
    ("test-behavior", 3, "fixture-test-heuristic", False, "{q} is a test behavior claim", "{q} is test code and should be used as evidence for related covered symbols when coverage relations exist.", ["covers"]),
    ("architecture-review-required", 4, "fixture-workflow-heuristic", True, "{q} may affect workflow behavior", "{q} has workflow-like naming, docstrings, or relations and needs human review before it is treated as architecture or workflow guidance.", None),
]
#: Confidence of a claim, of one of tier 4, and of a procedure.
CONFIDENCE, TIER4_CONFIDENCE, PROCEDURE_CONFIDENCE = 0.82, 0.72, 0.7
STEPS = "%s calls %d same-file helper(s), forming a %d-step sequence: %s. Step order reflects where each helper is defined in the file, not confirmed call-site or runtime order."


def _filled(template: str, name: Column, more: Column) -> Column:
    """A template with {q} and {x} replaced; null where a column that it names is."""
    parts = [F.lit(p) if i % 2 == 0 else {"q": name, "x": more}[p] for i, p in enumerate(template.replace("{", "\0").replace("}", "\0").split("\0"))]
    return F.concat(*parts)


def symbol_claims(symbols: DataFrame, relations: DataFrame) -> DataFrame:
    """symbols (id, kind, language, qualified_name, title, docstring), relations (id, subject, predicate, object) -> their static claims.

    id, symbol_id, kind, title, claim, tier, confidence, derivation, review_required. COBOL symbols get a claim for workflow, file
    access, updates and branches that their relations show; functions, methods and tests for a docstring, for what they raise
    and for environment variables that they read (object `env:NAME`), tests one more; classes, functions and methods that
    sound operational, or have such a predicate, one that asks for review. Names are listed in order, each once. Null texts
    count as empty; repeated relations change nothing. The relations of a claim are rows of claim_relations.
    """
    is_ = lambda *names: F.col("predicate").isin(*names)
    listed = lambda when, what: F.array_join(F.array_sort(F.collect_set(F.when(when, what))), ", ")
    env = is_("reads") & F.col("object").startswith("env:")
    sounds = lambda text: reduce(Column.__or__, (F.contains(F.lower(text), F.lit(t)) for t in OPERATIONAL))
    facts = relations.groupBy(F.col("subject").alias("id")).agg(
        listed(is_("performs", "calls"), F.col("predicate")).alias("workflow"), listed(is_("reads", "writes"), F.col("predicate")).alias("io"),
        F.bool_or(is_("updates")).alias("updates"), F.bool_or(is_("branches_on")).alias("branches"), F.bool_or(is_("raises")).alias("raises"), F.bool_or(env).alias("reads_env"),
        listed(is_("raises"), F.col("object")).alias("exceptions"), listed(env, F.substring("object", 5, 2**31 - 1)).alias("variables"), F.bool_or(sounds(F.col("predicate"))).alias("operational"),
    )
    text = lambda c: F.coalesce(c, F.lit(""))
    s = symbols.select("id", "kind", F.col("language") == "cobol", text("qualified_name").alias("q"), F.trim(F.regexp_replace(text("docstring"), r"^\s+|\s+$", "")).alias("doc"), F.concat_ws(" ", text("qualified_name"), text("title"), text("docstring")).alias("all")).toDF("id", "kind", "cobol", "q", "doc", "all")
    s = s.join(facts, "id", "left")
    yes = lambda c: F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(False))
    cobol, runs, code = yes("cobol"), F.col("kind").isin("function", "method", "test"), F.col("kind").isin("class", "function", "method")
    has = lambda c: text(F.col(c)) != ""
    when = {
        "cobol-workflow": (cobol & has("workflow"), F.col("workflow")), "cobol-file-io": (cobol & has("io"), F.col("io")), "cobol-data-updates": (cobol & yes("updates"), F.lit("")),
        "cobol-branching": (cobol & yes("branches"), F.lit("")), "documents-behavior": (runs & has("doc"), F.col("doc")), "raises-exception": (runs & yes("raises"), F.col("exceptions")),
        "reads-environment": (runs & yes("reads_env"), F.col("variables")), "test-behavior": (F.col("kind") == "test", F.lit("")),
        "architecture-review-required": (code & (sounds(F.col("all")) | yes("operational")), F.lit("")),
    }
    q, claims = F.col("q"), []
    for kind, tier, derivation, review, title, claim, _ in TEMPLATES:
        fits, more = when[kind]
        confidence = TIER4_CONFIDENCE if tier == 4 else CONFIDENCE
        fields = {"kind": F.lit(kind), "title": _filled(title, q, more), "claim": _filled(claim, q, more), "tier": F.lit(tier), "confidence": F.lit(confidence), "derivation": F.lit(derivation), "review_required": F.lit(review or tier == 4)}
        claims.append(F.when(yes(fits), F.struct(*(c.alias(k) for k, c in fields.items()))))
    rows = s.select(F.col("id").alias("symbol_id"), F.explode(F.array_compact(F.array(*claims))).alias("c"))
    return rows.select(bounded_id("ki", F.concat_ws("-", "symbol_id", "c.kind"), 120).alias("id"), "symbol_id", "c.*")


def claim_relations(claims: DataFrame, relations: DataFrame) -> DataFrame:
    """claim_id, relation_id: the relations that each of symbol_claims rests on, as rows, as a symbol may have any number."""
    kinds = F.array_compact(F.array(*(F.when(F.lit(True) if wanted is None else F.col("predicate").isin(wanted), F.lit(kind)) for kind, *_, wanted in TEMPLATES)))
    rows = relations.select(F.col("id").alias("relation_id"), F.col("subject").alias("symbol_id"), F.explode(kinds).alias("kind"))
    return rows.join(claims.select(F.col("id").alias("claim_id"), "symbol_id", "kind"), ["symbol_id", "kind"]).select("claim_id", "relation_id").distinct()


def procedure_claims(symbols: DataFrame, relations: DataFrame, least: int = 2) -> DataFrame:
    """Claims of callers (functions, methods) with at least `least` distinct exact callees of these kinds in their own file, themselves apart.

    symbols (id, kind, file, line, qualified_name), relations (subject, predicate, object, status) -> id, symbol_id, title, claim, tier, confidence,
    members (ids, sorted). Steps are the caller and its callees by line, then name; there are as many as a file defines. The
    first of equal ids (by line) counts.
    """
    s = symbols.filter(F.col("kind").isin("function", "method")).groupBy("id").agg(F.min(F.struct("line", "qualified_name", "file")).alias("s")).select("id", "s.*")
    e = relations.filter((F.col("predicate") == "calls") & (F.col("status") == "exact") & (F.col("subject") != F.col("object"))).select("subject", "object").distinct()
    caller = s.select(F.col("id").alias("subject"), F.col("qualified_name").alias("q"), F.col("file").alias("f"))
    callee = s.select(F.col("id").alias("object"), "line", "qualified_name", "file")
    same = e.join(caller, "subject").join(callee, "object").filter(F.coalesce("f", F.lit("")) == F.coalesce("file", F.lit("")))
    step = F.struct(F.coalesce("line", F.lit(0)).alias("line"), F.coalesce("qualified_name", F.lit("")).alias("name"), F.col("object").alias("id"))
    c = same.groupBy("subject", "q").agg(F.array_sort(F.collect_list(step)).alias("m")).filter(F.size("m") >= least)
    names = F.concat(F.array(F.coalesce("q", F.lit(""))), F.col("m.name"))
    steps = F.array_join(F.transform(names, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x)), "; ")
    n = F.size("m")
    claim = F.format_string(STEPS, F.coalesce("q", F.lit("")), n, n + 1, steps)
    of = bounded_id("proc", F.col("subject"), 96)
    title = F.concat(F.coalesce("q", F.lit("")), F.lit(" is part of a multi-step procedure"))
    return c.select(bounded_id("ki", F.concat(of, F.lit("-procedure")), 120).alias("id"), F.col("subject").alias("symbol_id"), title.alias("title"), claim.alias("claim"), F.lit(3).alias("tier"), F.lit(PROCEDURE_CONFIDENCE).alias("confidence"), F.array_sort(F.concat(F.array("subject"), F.col("m.id"))).alias("members"))


def claim_ordinals(claims: DataFrame) -> DataFrame:
    """Accepted claims (symbol_id, kind, seq) with their number within symbol and kind, from 0: id, ordinal."""
    n = F.row_number().over(Window.partitionBy("symbol_id", "kind").orderBy("seq")) - 1
    return claims.filter("accepted").select("id", "symbol_id", "kind", n.alias("ordinal"))
