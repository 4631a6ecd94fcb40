"""Registered queries over code facts, spans, side files, state and document readers, exports and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from fathomkb.functions.canonical import row_json
from fathomkb.operators import architecture as A
from fathomkb.operators import bundle_reports, context, rules, spans
from fathomkb.operators import report as P
from fathomkb.operators import search as S
from fathomkb.operators import static_claims as T
from fathomkb.operators import validate as V
from fathomkb.plans.registry import query
from fathomkb.sources import files as files_
from fathomkb.sources import frontmatter, sinks, turtle
from fathomkb.sources import views as v
from fathomkb.sources.shared import scratch

#: Code symbols and what they do, from parts and lines: COBOL and Python symbols, some without a docstring, some that sound operational.
FACTS = """fs AS (SELECT id, seq, kind, CASE WHEN seq % 4 = 0 THEN 'cobol' ELSE 'python' END AS language, qualified_name, CASE WHEN seq % 10 = 0 THEN 'Ingest_' || title ELSE title END AS title,
            CASE WHEN seq % 3 = 0 THEN CASE WHEN seq % 2 = 0 THEN '  ' END ELSE ' ' || docstring END AS docstring FROM v_symbols),
       ff AS (SELECT 'f' || l_orderkey || '-' || l_linenumber AS id, 'symbol-part-' || l_partkey AS subject,
            CASE l_linenumber WHEN 1 THEN 'calls' WHEN 2 THEN 'raises' WHEN 3 THEN 'reads' WHEN 4 THEN 'writes' WHEN 5 THEN 'covers' WHEN 6 THEN 'performs' ELSE CASE WHEN l_suppkey % 3 = 0 THEN 'updates' WHEN l_suppkey % 3 = 1 THEN 'branches_on' ELSE 'validates' END END AS predicate,
            CASE l_linenumber WHEN 2 THEN 'Error' || (l_suppkey % 7) WHEN 3 THEN CASE WHEN l_suppkey % 2 = 0 THEN 'env:VAR_' || (l_suppkey % 5) ELSE 'file-' || l_suppkey END ELSE 'symbol-part-' || l_suppkey END AS object FROM lineitem)"""


def _facts(spark, d):
    s = v.symbols(spark, d).selectExpr(
        "id", "seq", "kind", "if(seq % 4 = 0, 'cobol', 'python') language", "qualified_name", "if(seq % 10 = 0, concat('Ingest_', title), title) title", "if(seq % 3 = 0, if(seq % 2 = 0, '  ', null), concat(' ', docstring)) docstring"
    )
    last = "case l_suppkey % 3 when 0 then 'updates' when 1 then 'branches_on' else 'validates' end"
    f = v.read(spark, d, "lineitem").selectExpr(
        "concat('f', l_orderkey, '-', l_linenumber) id", "concat('symbol-part-', l_partkey) subject",
        f"coalesce(element_at(map(1, 'calls', 2, 'raises', 3, 'reads', 4, 'writes', 5, 'covers', 6, 'performs'), l_linenumber), {last}) predicate",
        "case when l_linenumber = 2 then concat('Error', l_suppkey % 7) when l_linenumber = 3 then if(l_suppkey % 2 = 0, concat('env:VAR_', l_suppkey % 5), concat('file-', l_suppkey)) else concat('symbol-part-', l_suppkey) end object",
    )
    return s, f


CLAIMS = f"""{FACTS}, g AS (SELECT subject, list_sort(list(DISTINCT predicate)) AS p, list_sort(list(DISTINCT object) FILTER (predicate = 'raises')) AS ex,
            list_sort(list(DISTINCT substr(object, 5)) FILTER (predicate = 'reads' AND starts_with(object, 'env:'))) AS env FROM ff GROUP BY 1),
       j AS (SELECT fs.*, coalesce(p, []) AS p, coalesce(ex, []) AS ex, coalesce(env, []) AS env, trim(coalesce(docstring, '')) AS doc, lower(concat_ws(' ', qualified_name, title, docstring, array_to_string(p, ' '))) AS hay FROM fs LEFT JOIN g ON g.subject = fs.id),
       k AS (SELECT *, kind IN ('function', 'method', 'test') AS runs FROM j),
       c AS (SELECT id, 'cobol-workflow' AS kind, 4 AS tier, 'fixture-cobol-workflow-relations' AS derivation, qualified_name || ' participates in COBOL workflow' AS title,
              qualified_name || ' has COBOL workflow relation(s): ' || array_to_string(list_filter(p, lambda x: x IN ('calls', 'performs')), ', ') || '.' AS claim FROM k WHERE language = 'cobol' AND list_has_any(p, ['calls', 'performs'])
             UNION ALL SELECT id, 'cobol-file-io', 3, 'fixture-cobol-file-io-relations', qualified_name || ' performs COBOL file I/O', qualified_name || ' has COBOL file I/O relation(s): ' || array_to_string(list_filter(p, lambda x: x IN ('reads', 'writes')), ', ') || '.'
              FROM k WHERE language = 'cobol' AND list_has_any(p, ['reads', 'writes'])
             UNION ALL SELECT id, 'cobol-data-updates', 3, 'fixture-cobol-update-relations', qualified_name || ' updates COBOL data', qualified_name || ' updates data item(s) according to line-structured COBOL analysis.' FROM k WHERE language = 'cobol' AND list_contains(p, 'updates')
             UNION ALL SELECT id, 'cobol-branching', 3, 'fixture-cobol-branch-relations', qualified_name || ' branches on a COBOL condition', qualified_name || ' contains conditional COBOL logic and should be reviewed as behavior.' FROM k WHERE language = 'cobol' AND list_contains(p, 'branches_on')
             UNION ALL SELECT id, 'documents-behavior', 3, 'fixture-docstring', qualified_name || ' documents behavior', qualified_name || ' documents this behavior: ' || doc FROM k WHERE runs AND doc <> ''
             UNION ALL SELECT id, 'raises-exception', 3, 'fixture-static-relations', qualified_name || ' raises exceptions', qualified_name || ' raises ' || array_to_string(ex, ', ') || ' according to static analysis.' FROM k WHERE runs AND len(ex) > 0
             UNION ALL SELECT id, 'reads-environment', 3, 'fixture-static-relations', qualified_name || ' reads environment configuration', qualified_name || ' reads environment variable(s): ' || array_to_string(env, ', ') || '.' FROM k WHERE runs AND len(env) > 0
             UNION ALL SELECT id, 'test-behavior', 3, 'fixture-test-heuristic', qualified_name || ' is a test behavior claim', qualified_name || ' is test code and should be used as evidence for related covered symbols when coverage relations exist.' FROM k WHERE kind = 'test'
             UNION ALL SELECT id, 'architecture-review-required', 4, 'fixture-workflow-heuristic', qualified_name || ' may affect workflow behavior',
              qualified_name || ' has workflow-like naming, docstrings, or relations and needs human review before it is treated as architecture or workflow guidance.'
              FROM k WHERE kind IN ('class', 'function', 'method') AND regexp_matches(hay, 'pipeline|ingest|preview|workflow|validate|authorization|eligibility'))"""


@query(
    f"""WITH {CLAIMS} SELECT 'ki-' || id || '-' || kind AS id, id AS symbol_id, kind, title, claim, tier, CASE WHEN tier = 4 THEN 0.72::DOUBLE ELSE 0.82::DOUBLE END AS confidence, derivation, tier = 4 AS review_required FROM c""",
    "symbols",
)
def x14_static_claims(spark, d):
    return T.symbol_claims(*_facts(spark, d))


@query(
    f"""WITH {CLAIMS} SELECT DISTINCT 'ki-' || c.id || '-' || kind AS claim_id, ff.id AS relation_id FROM c JOIN ff ON ff.subject = c.id AND CASE kind WHEN 'cobol-workflow' THEN predicate IN ('performs', 'calls')
       WHEN 'cobol-file-io' THEN predicate IN ('reads', 'writes') WHEN 'cobol-data-updates' THEN predicate = 'updates' WHEN 'cobol-branching' THEN predicate = 'branches_on' WHEN 'documents-behavior' THEN predicate IN ('calls', 'raises', 'reads', 'writes')
       WHEN 'raises-exception' THEN predicate = 'raises' WHEN 'reads-environment' THEN predicate = 'reads' WHEN 'test-behavior' THEN predicate = 'covers' ELSE true END""",
    "symbols",
)
def x14_claim_relations(spark, d):
    s, f = _facts(spark, d)
    return T.claim_relations(T.symbol_claims(s, f), f)


@query(
    """WITH s AS (SELECT id, seq, 'method' AS kind, module || '.py' AS file, qualified_name FROM v_code_symbols WHERE seq % 5 <> 0 OR seq % 3 = 0),
       e AS (SELECT DISTINCT 'sym-' || l_partkey AS subject, 'sym-' || (l_partkey - l_partkey % 5 + l_suppkey % 5) AS object FROM lineitem WHERE l_returnflag <> 'N'),
       m AS (SELECT a.id, a.qualified_name AS q, b.seq, b.id AS callee, b.qualified_name AS name FROM e JOIN s a ON a.id = e.subject JOIN s b ON b.id = e.object WHERE a.id <> b.id AND a.file = b.file),
       g AS (SELECT id, q, count(*) AS n, list(name ORDER BY seq, name) AS names, list_sort(list_append(list(callee), id)) AS members FROM m GROUP BY 1, 2 HAVING count(*) >= 2)
       SELECT 'ki-proc-' || id || '-procedure' AS id, id AS symbol_id, q || ' is part of a multi-step procedure' AS title, q || ' calls ' || n || ' same-file helper(s), forming a ' || (n + 1) || '-step sequence: '
         || array_to_string(list_transform(list_prepend(q, names), lambda x, i: i || '. ' || x), '; ') || '. Step order reflects where each helper is defined in the file, not confirmed call-site or runtime order.' AS claim,
         3 AS tier, 0.7::DOUBLE AS confidence, array_to_string(members, ',') AS members FROM g""",
    "code_symbols",
)
def x15_procedure_claims(spark, d):
    s = v.code_symbols(spark, d).selectExpr("id", "cast(seq as int) line", "if(seq % 5 <> 0 or seq % 3 = 0, if(seq % 2 = 0, 'method', 'function'), 'class') kind", "concat(module, '.py') file", "qualified_name")
    e = v.read(spark, d, "lineitem").selectExpr("concat('sym-', l_partkey) subject", "concat('sym-', l_partkey - l_partkey % 5 + l_suppkey % 5) object", "'calls' predicate", "if(l_returnflag <> 'N', 'exact', 'inferred') status")
    return T.procedure_claims(s, e).withColumn("members", F.array_join("members", ","))


@query(
    """SELECT id, source_id AS symbol_id, lifecycle_status AS kind, row_number() OVER (PARTITION BY source_id, lifecycle_status ORDER BY seq) - 1 AS ordinal FROM v_claims WHERE review_status = 'approved'""",
    "claims",
)
def w5_claim_ordinals(spark, d):
    return T.claim_ordinals(v.claims(spark, d).selectExpr("id", "seq", "source_id symbol_id", "lifecycle_status kind", "coalesce(review_status = 'approved', false) accepted"))


ENDS = """r AS (SELECT row_number() OVER () AS seq_, id, subject, predicate, object, CASE WHEN seq % 97 = 0 THEN 'odd' WHEN seq % 89 = 0 THEN NULL ELSE status END AS status,
            CASE WHEN starts_with(subject, 'symbol-') THEN 'symbol' WHEN starts_with(subject, 'nation-') THEN 'module' ELSE 'external' END AS sk, CASE WHEN starts_with(object, 'symbol-') THEN 'symbol' WHEN starts_with(object, 'region-') THEN 'module' ELSE 'external' END AS ok,
            CASE seq % 5 WHEN 0 THEN [] WHEN 1 THEN [evidence, 'ev-x' || seq % 3] ELSE [evidence] END AS evidence FROM v_relations),
       known AS (SELECT id FROM v_symbols WHERE kind <> 'constant' UNION SELECT 'symbol-supplier-' || s_suppkey FROM supplier WHERE s_suppkey % 10 > 0 UNION SELECT 'nation-' || n_nationkey FROM nation UNION SELECT 'region-' || r_regionkey FROM region WHERE r_regionkey > 0),
       ev AS (SELECT DISTINCT evidence AS id FROM v_relations WHERE NOT starts_with(evidence, 'ev-c'))"""


@query(
    f"""WITH {ENDS}, x AS (SELECT r.seq_, r.id, u.c AS cited, u.pos FROM r, unnest(r.evidence) WITH ORDINALITY AS u(c, pos))
       SELECT 'error' AS level, 'status' AS rule, id, '' AS detail FROM r WHERE status IS NULL OR status NOT IN ('exact', 'inferred', 'unresolved')
       UNION ALL SELECT 'error', 'unknown_subject', id, subject FROM r WHERE sk IN ('module', 'symbol') AND subject NOT IN (SELECT id FROM known)
       UNION ALL SELECT 'error', 'unknown_object', id, object FROM r WHERE ok IN ('module', 'symbol') AND object NOT IN (SELECT id FROM known)
       UNION ALL SELECT 'error', 'unknown_evidence', id, string_agg(cited, ', ' ORDER BY pos) FROM x WHERE cited NOT IN (SELECT id FROM ev) GROUP BY seq_, id
       UNION ALL SELECT 'error', 'exact_without_evidence', id, '' FROM r WHERE status = 'exact' AND len(evidence) = 0 AND predicate NOT IN ('imports', 'defines')
       UNION ALL SELECT 'warning', 'not_exact', id, '' FROM r WHERE status IN ('inferred', 'unresolved')""",
    "relations symbols",
)
def v3_validate_relations(spark, d):
    r = v.relations(spark, d)
    kind = lambda c, module: f"case when {c} like 'symbol-%' then 'symbol' when {c} like '{module}-%' then 'module' else 'external' end"
    rows = r.selectExpr(
        "id", "subject", "predicate", "object", "case when seq % 97 = 0 then 'odd' when seq % 89 = 0 then null else status end status", f"{kind('subject', 'nation')} subject_kind", f"{kind('object', 'region')} object_kind",
        "case seq % 5 when 0 then array() when 1 then array(evidence, concat('ev-x', seq % 3)) else array(evidence) end evidence",
    )
    t = lambda name: v.read(spark, d, name)
    known = [v.symbols(spark, d).filter("kind <> 'constant'").select("id"), t("supplier").filter("s_suppkey % 10 > 0").selectExpr("concat('symbol-supplier-', s_suppkey) id"), t("nation").selectExpr("concat('nation-', n_nationkey) id")]
    known = known[0].unionByName(known[1]).unionByName(known[2]).unionByName(t("region").filter("r_regionkey > 0").selectExpr("concat('region-', r_regionkey) id"))
    return V.relations(rows, known, r.filter("evidence not like 'ev-c%'").select(F.col("evidence").alias("id")))


# JSON, Turtle, reports and documents as they are written


CHAR = r"""CASE c WHEN '' THEN '' WHEN '"' THEN '\"' WHEN '\' THEN '\\' WHEN chr(8) THEN '\b' WHEN chr(9) THEN '\t' WHEN chr(10) THEN '\n' WHEN chr(12) THEN '\f' WHEN chr(13) THEN '\r'
       ELSE CASE WHEN unicode(c) BETWEEN 32 AND 126 THEN c WHEN unicode(c) < 65536 THEN format('\u{:04x}', unicode(c)) ELSE format('\u{:04x}', 55296 + ((unicode(c) - 65536) >> 10)) || format('\u{:04x}', 56320 + ((unicode(c) - 65536) & 1023)) END END"""


def _json(x: str) -> str:
    return f"""coalesce('"' || array_to_string(list_transform(string_split({x}, ''), lambda c: {CHAR}), '') || '"', 'null')"""


@query(
    f"""WITH d AS (SELECT doc_id, lang, n_chars, substr(text, 1, 300) || chr(233) || chr(128512) || chr(7) AS head, string_split(substr(text, 1, 60), ' ') AS words FROM documents)
       SELECT doc_id, '{{' || chr(10) || '  "a": {{' || chr(10) || '    "head": ' || {_json("head")} || ',' || chr(10) || '    "long": ' || CASE WHEN n_chars > 2000 THEN 'true' ELSE 'false' END || chr(10) || '  }},' || chr(10)
         || '  "doc_id": ' || doc_id || ',' || chr(10) || '  "lang": ' || {_json("lang")} || ',' || chr(10) || '  "ratio": ' || (n_chars // 8) || CASE n_chars % 8 WHEN 0 THEN '.0' WHEN 4 THEN '.5' ELSE CASE WHEN n_chars % 2 = 0 THEN rpad('.' || (n_chars % 8) * 125, 3, '') ELSE '.' || lpad(CAST((n_chars % 8) * 125 AS VARCHAR), 3, '0') END END || ',' || chr(10)
         || '  "words": [' || chr(10) || array_to_string(list_transform(words, lambda w: '    ' || {_json("w")}), ',' || chr(10)) || chr(10) || '  ],' || chr(10) || '  "z": []' || chr(10) || '}}' AS json FROM d"""
)
def c18_canonical_json(spark, d):
    doc = v.read(spark, d, "documents").selectExpr(
        "doc_id", "lang", "n_chars / 8.0D ratio", "array() z", "split(substr(text, 1, 60), ' ') words", "named_struct('long', n_chars > 2000, 'head', concat(substr(text, 1, 300), 'é😀', char(7))) a"
    )
    return doc.select("doc_id", row_json({f.name: f.dataType for f in doc.schema}).alias("json"))


def _hashed(rows, text="text"):
    return rows.select("document", "shard", F.sha2(text, 256).alias("sha256"), F.length(text).cast("long").alias("n"))


SLUG = "trim(regexp_replace(lower(trim({0})), '[^a-z0-9]+', '-', 'g'), '-')"
NAME = f"replace(coalesce(nullif({SLUG}, ''), 'item'), '-', '_')"


def _name(x: str) -> str:
    return NAME.format(x)


ITEMS = """it AS (SELECT seq, id, subject, predicate, CASE WHEN seq % 5 = 0 THEN substr(object, 1, 3) || '! ' || coalesce(status, 'x') WHEN seq % 5 = 1 THEN source_text || ' Record contraindications; uncertain clinical review "now".' WHEN seq % 5 = 2 THEN substr(object, 1, 3) || '?' ELSE object END AS object,
              source_id, status, source_text FROM v_items)"""


def _items(spark, d):
    odd = "concat(source_text, ' Record contraindications; uncertain clinical review \"now\".')"
    return v.items(spark, d).withColumn("object", F.expr(f"case seq % 5 when 0 then concat(substr(object, 1, 3), '! ', coalesce(status, 'x')) when 1 then {odd} when 2 then concat(substr(object, 1, 3), '?') else object end"))


FNV = "lower(lpad(format('{:x}', list_reduce(list_prepend(2216829733::BIGINT, list_transform(range(0, strlen(x) ), lambda i: ('0x' || substr(hex(encode(x)), CAST(2 * i + 1 AS BIGINT), 2))::BIGINT)), lambda h, b: (xor(h, b) * 435) & 4294967295)), 8, '0'))"
ESC = "replace(replace(replace(replace(replace({0}, '\\', '\\\\'), '\"', '\\\"'), chr(10), ' '), chr(13), '\\r'), chr(9), '\\t')"
N = "chr(10)"


def _esc(x: str) -> str:
    return ESC.replace("{0}", x)


RULES = f"""kw AS (SELECT it.*, list_filter([CASE WHEN contains(lower(object), 'confirm patient identity') THEN {{'s': 'confirm-patient-identity', 't': 'Confirm patient identity', 'f': 'patient_identity_confirmed', 'c': 'always', 'q': 'true'}} END,
                CASE WHEN contains(lower(object), 'record contraindication') THEN {{'s': 'record-contraindications', 't': 'Record contraindications', 'f': 'contraindications_recorded', 'c': 'always', 'q': 'true'}} END,
                CASE WHEN contains(lower(object), 'uncertain') AND contains(lower(object), 'clinical review') THEN {{'s': 'route-uncertain-case', 't': 'Route uncertain cases for clinical review', 'f': 'route_clinical_review', 'c': 'case_uncertainty', 'q': 'false'}} END], lambda x: x IS NOT NULL) AS k FROM it),
       rl AS (SELECT seq, id, unnest(range(0, len(r))) AS position, unnest(r) AS r FROM (SELECT seq, id, CASE WHEN len(k) > 0 THEN k ELSE [{{'s': {SLUG.format("predicate")}, 't': subject, 'f': 'scenario_mentions_' || replace({SLUG.format("subject")}, '-', '_'), 'c': 'always', 'q': 'true'}}] END AS r FROM kw))"""


@query(
    f"""WITH {ITEMS}, w AS (SELECT *, trim(object) AS o, string_split_regex(trim(object), '\\s+') AS ws FROM it),
       lb AS (SELECT *, CASE WHEN len(ws) <= 9 THEN o ELSE rtrim(array_to_string(ws[1:9], ' '), '.,;:') END AS label FROM w),
       rr AS (SELECT *, {_name("'kr-' || id")} AS rel, {_name("'concept-' || subject")} AS con, {_name("'predicate-' || predicate")} AS pre, {_name("'object-' || substr(coalesce(nullif(" + SLUG.format("label") + ", ''), 'item'), 1, 64)")} AS base, {_name("id")} AS pie, {_name("'evidence-' || id")} AS evi FROM lb),
       le AS (SELECT base, arg_min(label, seq) AS l, arg_min(object, seq) AS t FROM rr GROUP BY 1),
       nm AS (SELECT rr.*, CASE WHEN label = l AND object = t THEN base ELSE base || '_' || (SELECT {FNV} FROM (SELECT label || chr(0) || object AS x)) END AS name FROM rr JOIN le USING (base)),
       {RULES},
       b AS (SELECT -1 AS seq, -1 AS place, '@prefix sopkb: <https://example.org/sopkb/> .' || {N} || '@prefix dcterms: <http://purl.org/dc/terms/> .' || {N} || '@prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> .' || {N} AS block
         UNION ALL SELECT min(seq), 0, 'sopkb:' || con || ' a sopkb:Concept ;' || {N} || '  rdfs:label "' || {_esc("arg_min(subject, seq)")} || '" .' || {N} FROM nm GROUP BY con
         UNION ALL SELECT min(seq), 1, 'sopkb:' || name || ' a sopkb:RelationObject ;' || {N} || '  rdfs:label "' || {_esc("label")} || '" ;' || {N} || '  sopkb:objectText "' || {_esc("object")} || '" .' || {N} FROM nm GROUP BY name, label, object
         UNION ALL SELECT seq, 2, 'sopkb:' || rel || ' a sopkb:KnowledgeRelation ;' || {N} || '  sopkb:subject sopkb:' || con || ' ;' || {N} || '  sopkb:predicate sopkb:' || pre || ' ;' || {N} || '  sopkb:object sopkb:' || name || ' ;' || {N} || '  sopkb:knowledgePiece sopkb:' || pie || ' ;' || {N}
            || '  sopkb:evidence sopkb:' || evi || ' ;' || {N} || '  dcterms:source "' || {_esc("source_id")} || '" ;' || {N} || '  sopkb:reviewStatus "' || {_esc("coalesce(status, '')")} || '" .' || {N} || {N} || 'sopkb:' || con || ' sopkb:' || pre || ' sopkb:' || name || ' .' || {N} FROM nm
         UNION ALL SELECT rl.seq, CAST(3 + position AS INTEGER), 'sopkb:' || {_name("'rule-' || rl.id || '-' || r.s")} || ' a sopkb:DecisionRule ;' || {N} || '  rdfs:label "' || {_esc("r.t")} || '" ;' || {N} || '  sopkb:knowledgePiece sopkb:' || pie || ' ;' || {N} || '  sopkb:knowledgeRelation sopkb:' || rel || ' ;' || {N}
            || '  sopkb:evidence sopkb:' || evi || ' ;' || {N} || '  sopkb:conditionFact "' || r.c || '" ;' || {N} || '  sopkb:obligationFact "' || r.f || '" ;' || {N} || '  sopkb:otherwiseActionRequired "' || r.q || '" .' || {N} FROM rl JOIN nm ON nm.id = rl.id),
       ln AS (SELECT block, row_number() OVER (ORDER BY seq, place) - 1 AS n FROM b)
       SELECT 'triples' AS document, CAST(n // 1000 AS INTEGER) AS shard, sha256(string_agg(block || {N}, '' ORDER BY n)) AS sha256, CAST(length(string_agg(block || {N}, '' ORDER BY n)) AS BIGINT) AS n FROM ln GROUP BY n // 1000""",
    "items",
)
def s17_turtle_document(spark, d):
    blocks = turtle.turtle_blocks(_items(spark, d)).withColumn("document", F.lit("triples"))
    folder = scratch(spark, "turtle")
    sinks.write_documents(sinks.numbered_lines(blocks, "document", ["seq", "place"], "block"), folder, ".ttl", 1000)
    return _hashed(sinks.read_documents(spark, folder))


@query(
    f"""WITH {ITEMS}, {RULES}, g AS (SELECT 'concept-' || {SLUG.format("it.subject")} AS c, count(DISTINCT it.id) AS items, count(*) AS rules, arg_min(it.subject, it.seq) AS label FROM it JOIN rl ON rl.id = it.id GROUP BY 1),
       t AS (SELECT arg_max(c, (items, rules, label)) AS c FROM g), s AS (SELECT it.*, t.c FROM it JOIN t ON 'concept-' || {SLUG.format("it.subject")} = t.c ORDER BY seq LIMIT 18)
       SELECT c AS id, 'concept' AS type, arg_min(subject, seq) AS label FROM (SELECT it.*, t.c FROM it JOIN t ON 'concept-' || {SLUG.format("it.subject")} = t.c) GROUP BY 1
       UNION ALL SELECT id, 'knowledge_item', object FROM s UNION ALL SELECT 'kr-' || id, 'relation', predicate FROM s UNION ALL SELECT 'evidence-' || id, 'evidence', source_text FROM s
       UNION ALL SELECT 'rule-' || rl.id || '-' || r.s, 'rule', r.t FROM rl JOIN s ON s.id = rl.id WHERE position < 4""",
    "items",
)
def g6_concept_graph_nodes(spark, d):
    return rules.concept_graph(_items(spark, d))[0].drop("position")


@query(
    f"""WITH {ITEMS}, {RULES}, s AS (SELECT *, 'concept-user-7' AS c FROM it WHERE subject = 'user 7' ORDER BY seq LIMIT 18)
       SELECT c AS source, id AS target, 'anchors' AS type FROM s UNION ALL SELECT id, 'kr-' || id, 'has_relation' FROM s UNION ALL SELECT id, 'evidence-' || id, 'supported_by' FROM s
       UNION ALL SELECT rl.id, 'rule-' || rl.id || '-' || r.s, 'has_rule' FROM rl JOIN s ON s.id = rl.id WHERE position < 4""",
    "items",
)
def g6_concept_graph_edges(spark, d):
    return rules.concept_graph(_items(spark, d), "concept-user-7")[1].drop("position")


@query(
    f"""WITH {ITEMS}, i AS (SELECT *, CASE seq % 6 WHEN 0 THEN 'retired' WHEN 1 THEN 'superseded' WHEN 2 THEN 'conflicted' WHEN 3 THEN 'draft' WHEN 4 THEN 'active' END AS life FROM it),
       v AS (SELECT doc_id, source, CASE WHEN doc_id % 9 > 0 THEN source || ':v' || doc_id END AS vid, CASE doc_id % 4 WHEN 0 THEN 'active' WHEN 1 THEN 'superseded' WHEN 2 THEN 'retired' END AS status, lang || '/' || doc_id AS path FROM documents),
       k AS (SELECT seq, id, subject, predicate, lag(object) OVER (PARTITION BY subject, predicate ORDER BY seq) AS b, object FROM i),
       a AS (SELECT 'freshness' AS document, 0 AS part, '' AS key, 0 AS pos, '# Freshness Report' AS text UNION ALL SELECT 'freshness', 0, '', 1, '' UNION ALL SELECT 'freshness', 0, '', 2, 'Sources with freshness metadata: ' || count(*) FILTER (lang = 'en') FROM documents
         UNION ALL SELECT 'freshness', 0, '', 3, 'Knowledge items with freshness metadata: ' || count(*) FILTER (seq % 3 = 0) FROM i
         UNION ALL SELECT 'conflicts', 0, '', 0, '# Conflict Report' UNION ALL SELECT 'conflicts', 0, '', 1, ''
         UNION ALL SELECT 'conflicts', 2, '', seq, '- Candidate conflict for `' || subject || '` / `' || predicate || '` involving `' || id || '`' FROM k WHERE b <> '' AND b <> object
         UNION ALL SELECT 'extraction_summary', 0, '', 0, '# Extraction Summary' UNION ALL SELECT 'extraction_summary', 0, '', 1, '' UNION ALL SELECT 'extraction_summary', 0, '', 2, 'Sections: ' || count(*) FROM pages UNION ALL SELECT 'extraction_summary', 0, '', 3, 'Knowledge items: ' || count(*) FROM i
         UNION ALL SELECT 'review_summary', 0, '', 0, '# Review Summary' UNION ALL SELECT 'review_summary', 0, '', 1, '' UNION ALL SELECT 'review_summary', 2, coalesce(status, 'unknown'), 0, '- ' || coalesce(status, 'unknown') || ': ' || count(*) FROM i GROUP BY 3
         UNION ALL SELECT 'review_summary', 3, '', 0, '' UNION ALL SELECT 'review_summary', 3, '', 1, 'Review events: ' || count(*) FROM events
         UNION ALL SELECT 'source_update_impact', 0, '', pos, text FROM (SELECT unnest(range(0, 14)) AS pos, unnest(['# Source Update Impact', '', 'Sources: ' || (SELECT count(*) FROM documents), 'Source versions: ' || count(*), 'Active source versions: ' || count(*) FILTER (status = 'active'),
               'Superseded source versions: ' || count(*) FILTER (status = 'superseded'), 'Retired source versions: ' || count(*) FILTER (status = 'retired'), '', '## Knowledge Lifecycle', 'Active knowledge items: ' || (SELECT count(*) FROM i WHERE coalesce(life, 'active') = 'active'),
               'Superseded knowledge items: ' || (SELECT count(*) FROM i WHERE life = 'superseded'), 'Retired knowledge items: ' || (SELECT count(*) FROM i WHERE life = 'retired'), 'Conflicted knowledge items: ' || (SELECT count(*) FROM i WHERE life = 'conflicted'), '']) AS text FROM v)
         UNION ALL SELECT 'source_update_impact', 2, coalesce(life, 'active'), 0, '- ' || coalesce(life, 'active') || ': ' || count(*) FROM i GROUP BY 3
         UNION ALL SELECT 'source_update_impact', 3, '', 0, '' UNION ALL SELECT 'source_update_impact', 3, '', 1, '## Source Versions'
         UNION ALL SELECT 'source_update_impact', 5, source, doc_id, '- ' || coalesce(vid, 'None') || ': ' || coalesce(status, 'unknown') || ' `' || path || '`' FROM v),
       ln AS (SELECT document, text, row_number() OVER (PARTITION BY document ORDER BY part, key, pos) - 1 AS n FROM a)
       SELECT document, CAST(n // 400 AS INTEGER) AS shard, sha256(string_agg(text || chr(10), '' ORDER BY n)) AS sha256, CAST(length(string_agg(text || chr(10), '' ORDER BY n)) AS BIGINT) AS n FROM ln GROUP BY document, n // 400""",
    "items",
)
def s19_standard_reports(spark, d):
    docs, folder = v.read(spark, d, "documents"), scratch(spark, "reports")
    sources = docs.selectExpr("if(lang = 'en', '2030-01-01', if(lang = 'de', '', null)) stale_after")
    versions = docs.selectExpr("source source_id", "if(doc_id % 9 > 0, concat(source, ':v', doc_id), null) source_version_id", "doc_id version_number", "element_at(map(0, 'active', 1, 'superseded', 2, 'retired'), cast(doc_id % 4 as int)) status", "concat(lang, '/', doc_id) original_path")
    life = "element_at(map(0, 'retired', 1, 'superseded', 2, 'conflicted', 3, 'draft', 4, 'active'), cast(seq % 6 as int)) lifecycle_status"
    items = _items(spark, d).selectExpr("seq", "id", "subject", "predicate", "object", "status review_status", life, "if(seq % 3 = 0, 'x', null) stale_after")
    lines = bundle_reports.standard_reports(sources, versions, items, v.read(spark, d, "events"), v.read(spark, d, "pages"))
    sinks.write_documents(lines, folder, per_file=400)
    return _hashed(sinks.read_documents(spark, folder))


@query(
    """WITH s AS (SELECT *, 'supplier ' || s_suppkey || CASE WHEN s_suppkey % 3 = 0 THEN ': "a" #b' ELSE '' END AS title FROM supplier)
       SELECT 'sup' || s_suppkey AS document, CASE WHEN s_suppkey % 7 = 0 THEN NULL ELSE 'Supplier' END AS type, CASE WHEN s_suppkey % 7 = 0 THEN NULL ELSE title END AS title,
         CASE WHEN s_suppkey % 7 = 0 THEN NULL WHEN s_suppkey % 2 = 0 THEN 'nation/' || s_nationkey ELSE NULL END AS resource, CASE WHEN s_suppkey % 7 = 0 THEN 'missing required frontmatter key: type' END AS error,
         CASE WHEN s_suppkey % 7 = 0 THEN '' ELSE '# ' || s_name || chr(10) || 'balance ' || s_suppkey END AS body FROM s"""
)
def s15_documents_read_back(spark, d):
    title = F.expr("concat('supplier ', s_suppkey, if(s_suppkey % 3 = 0, ': \"a\" #b', ''))")
    s = v.read(spark, d, "supplier").select(
        F.concat(F.lit("sup"), "s_suppkey").alias("name"), F.expr("if(s_suppkey % 7 = 0, null, 'Supplier')").alias("type"), title.alias("title"),
        F.expr("if(s_suppkey % 2 = 0, array(named_struct('resource', concat('nation/', s_nationkey), 'page', s_suppkey)), array())").alias("sources"), F.concat(F.lit("# "), "s_name", F.lit("\nbalance "), "s_suppkey").alias("text"),
    )
    folder = scratch(spark, "documents")
    sinks.write_packed(frontmatter.document_lines(s, "name", ["type", "title"], {"sources": ["resource", "page"]}, F.col("text")), folder)
    back = frontmatter.read_documents(sinks.read_packed(spark, folder))
    get = lambda k: F.try_element_at("front", F.lit(k))
    return back.select("document", get("type").alias("type"), get("title").alias("title"), get("sources[0].resource").alias("resource"), "error", "body")


# sources in lines, side files, states


#: COBOL of several shapes by supplier, broken and empty ones too; | is a line end and @ the supplier's number.
SHAPES = [
    "000100 IDENTIFICATION DIVISION.|000200 PROGRAM-ID. SUP-@.|000300* COPY NOT-THIS.|DATA DIVISION.|FILE SECTION.|FD FILE-@.|01 REC-@.|   05 GROUP-A.|      10 ITEM-@ PIC X.|      10 ITEM-B PIC 9.|         88 IS-ON VALUE 1.|   05 LAST-ONE PIC X.|77 ALONE PIC 9.|COPY BOOK-@.|PROCEDURE DIVISION.|MAIN SECTION.|PARA-@.|    PERFORM STEP-@.|    CALL 'SUP-#'.|STEP-@.|    MOVE A TO B.|    STOP RUN.|",
    "       program-id. prog@.|       working-storage section.|       01 a-@.|          03 b.|             05 c pic x.|          03 d pic x.|       66 e renames b.|       procedure division.|       first-para.|           call \"SUP-@\".|           copy book-#.|       second-para.|           go to first-para.|       program-id. inner@.|       01 z.|       third-para.|           call 'PROG@'.",
    "||* only a comment|000100/ a page|   ||NO-DIVISION.|  CALL 'NOWHERE'.|12345.|END.|  09 X PIC 9.|  01 Y.|  05 W PIC 9.|",
    "",
    "PROGRAM-ID. SUP-@.|PROCEDURE DIVISION.|A SECTION.|B SECTION.|C1.|C2.|",
]
#: The rows of the lines that count, as the oracle sees them: path, line, text, total.
LINES = """src AS (SELECT s_suppkey AS k, 'src/sup' || s_suppkey || CASE WHEN s_suppkey % 5 = 1 THEN '.CPY' ELSE '.cbl' END AS path, replace(replace(replace(CASE s_suppkey % 5 WHEN 0 THEN {0} WHEN 1 THEN {1} WHEN 2 THEN {2} WHEN 3 THEN {3} ELSE {4} END, '@', CAST(s_suppkey AS VARCHAR)), '#', CAST(s_suppkey + 5 AS VARCHAR)), '|', chr(10)) AS text FROM supplier),
       sp AS (SELECT path, CASE WHEN text = '' THEN [] WHEN ends_with(text, chr(10)) THEN string_split(text, chr(10))[:-2] ELSE string_split(text, chr(10)) END AS ls FROM src),
       rw AS (SELECT path, len(ls) AS total, unnest(range(1, len(ls) + 1)) AS line, unnest(ls) AS raw FROM sp),
       ln AS (SELECT path, line, total, upper(CASE WHEN length(raw) > 6 AND regexp_full_match(trim(substr(raw, 1, 6)), '[0-9]+') THEN trim(substr(raw, 7)) ELSE trim(raw) END) AS text FROM rw WHERE trim(raw) <> '' AND NOT starts_with(trim(raw), '*') AND substr(raw, 7, 1) NOT IN ('*', '/'))""".format(*("'" + x.replace("'", "''") + "'" for x in SHAPES))
KEYWORDS = ", ".join(f"'{k}'" for k in spans.KEYWORDS)
SPANS = f"""ct AS (SELECT path, line, total, CASE WHEN ends_with(text, ' SECTION.') THEN 'section' ELSE 'paragraph' END AS kind, CASE WHEN ends_with(text, ' SECTION.') THEN regexp_replace(text, '\\s+SECTION\\.$', '') ELSE rtrim(text, '.') END AS name FROM ln
         WHERE ends_with(text, ' SECTION.') OR (ends_with(text, '.') AND NOT contains(rtrim(text, '.'), ' ') AND rtrim(text, '.') NOT IN ({KEYWORDS}) AND NOT regexp_full_match(rtrim(text, '.'), '[0-9]*'))),
       cs AS (SELECT path, kind, name, CAST(line AS INTEGER) AS line_start, CAST((SELECT greatest(a.line, coalesce(min(b.line) - 1, a.total)) FROM ct b WHERE b.path = a.path AND b.line > a.line) AS INTEGER) AS line_end FROM ct a)"""
LEVELS = """dx AS (SELECT path, line, total, CASE WHEN regexp_matches(text, '\\s(DIVISION|SECTION)\\b.*\\.$') THEN 0 ELSE TRY_CAST(regexp_extract(text, '^([0-9]{1,2})\\s+[A-Z0-9][A-Z0-9_-]*', 1) AS INTEGER) END AS level, regexp_extract(text, '^[0-9]{1,2}\\s+([A-Z0-9][A-Z0-9_-]*)', 1) AS name FROM ln),
       dl AS (SELECT *, CASE WHEN level = 77 THEN 1 WHEN level IN (66, 88) THEN 99 ELSE level END AS depth FROM dx WHERE level BETWEEN 0 AND 49 AND (level > 0 OR regexp_matches(name, '^$') OR name IS NULL) OR level IN (66, 77, 88)),
       di AS (SELECT path, CAST(line AS INTEGER) AS line, level, name, (SELECT max(b.line) FROM dl b WHERE b.path = a.path AND b.line < a.line AND b.depth < a.depth) AS up,
                CAST((SELECT coalesce(min(b.line) - 1, a.total) FROM dl b WHERE b.path = a.path AND b.line > a.line AND b.depth <= a.depth) AS INTEGER) AS "end" FROM dl a WHERE level > 0),
       dd AS (SELECT di.path, di.line, di.level, di.name, CASE WHEN h.level > 0 THEN CAST(di.up AS INTEGER) END AS parent, di."end" FROM di LEFT JOIN dl h ON h.path = di.path AND h.line = di.up)"""


def _cobol_sources(spark, d):
    quoted = ['"' + x.replace("\\", "\\\\").replace('"', '\\"') + '"' for x in SHAPES]
    text = "replace(replace(replace(case s_suppkey % 5 when 0 then {} when 1 then {} when 2 then {} when 3 then {} else {} end, '@', cast(s_suppkey as string)), '#', cast(s_suppkey + 5 as string)), '|', chr(10)) text".format(*quoted)
    return v.read(spark, d, "supplier").selectExpr("s_suppkey k", "concat('src/sup', s_suppkey, if(s_suppkey % 5 = 1, '.CPY', '.cbl')) path", text)


@query(f"WITH {LINES}, {SPANS} SELECT * FROM cs")
def w12_control_spans(spark, d):
    return spans.control_spans(spans.logical_lines(_cobol_sources(spark, d)))


@query(f"WITH {LINES}, {LEVELS} SELECT * FROM dd")
def w12_data_levels(spark, d):
    return spans.data_levels(spans.logical_lines(_cobol_sources(spark, d)))


@query(
    f"""WITH {LINES}, {SPANS}, {LEVELS}, p AS (SELECT path, line, total, regexp_extract(text, '^PROGRAM-ID\\.\\s+([A-Z0-9_-]+)\\.', 1) AS name FROM ln),
       ps AS (SELECT path, name, CAST(line AS INTEGER) AS line_start, CAST(coalesce((SELECT min(b.line) - 1 FROM p b WHERE b.path = a.path AND b.name <> '' AND b.line > a.line), total) AS INTEGER) AS line_end FROM p a WHERE name <> ''
         UNION ALL SELECT path, upper(regexp_extract(path, '([^/.]*)\\.', 1)), 1, CAST(len(string_split(text, chr(10))) AS INTEGER) FROM src WHERE path NOT IN (SELECT path FROM p WHERE name <> '')),
       fa AS (SELECT path, line_start AS at_, kind, name AS what FROM cs UNION ALL SELECT path, line, 'data', name FROM dd UNION ALL SELECT path, line, 'copy', regexp_extract(text, '^COPY\\s+([A-Z0-9_-]+)\\.', 1) FROM ln
         UNION ALL SELECT path, line, 'call', regexp_extract(text, '\\bCALL\\s+["'']([A-Z0-9_-]+)["'']', 1) FROM ln),
       j AS (SELECT ps.*, fa.kind, fa.what FROM ps LEFT JOIN fa ON fa.path = ps.path AND at_ BETWEEN line_start AND line_end AND what <> '')
       SELECT path, name, line_start, line_end, count(*) FILTER (kind = 'paragraph') AS paragraphs, count(*) FILTER (kind = 'section') AS sections, count(*) FILTER (kind = 'data') AS data_items,
         coalesce(array_to_string(list_sort(list(DISTINCT what) FILTER (kind = 'copy')), ','), '') AS copybooks, coalesce(array_to_string(list_sort(list(DISTINCT what) FILTER (kind = 'call')), ','), '') AS calls,
         coalesce(array_to_string(list_sort(list(DISTINCT what) FILTER (kind = 'call' AND what NOT IN (SELECT name FROM ps))), ','), '') AS external FROM j GROUP BY 1, 2, 3, 4"""
)
def j23_programs(spark, d):
    return spans.programs(_cobol_sources(spark, d)).withColumns({c: F.array_join(c, ",") for c in ("copybooks", "calls", "external")})


#: What an external parser leaves beside a source: whole, lacking fields, broken, or nothing.
SIDE = "program string, imports array<string>, symbols array<struct<name:string,kind:string,line_start:int,line_end:int,signature:string>>"


@query(
    f"""WITH {LINES}, r AS (SELECT path, k, CASE WHEN k % 4 = 2 THEN 'EXT-' || k ELSE upper('sup' || k) END AS module, greatest((SELECT max(total) FROM rw WHERE rw.path = src.path), 1) AS total FROM src WHERE k % 4 >= 2),
       own AS (SELECT path, line, CASE WHEN regexp_matches(text, '^PROGRAM-ID\\.\\s+[A-Z0-9-]+') THEN {{'k': 'program', 'n': regexp_extract(text, '^PROGRAM-ID\\.\\s+([A-Z0-9-]+)', 1)}} WHEN regexp_matches(text, '^COPY\\s+[A-Z0-9-]+') THEN {{'k': 'copy', 'n': regexp_extract(text, '^COPY\\s+([A-Z0-9-]+)', 1)}} END AS s FROM ln)
       SELECT path, module, CASE WHEN k % 5 = 1 THEN 'copybook' ELSE 'program' END AS kind, module AS name, 1 AS line_start, CAST(coalesce(total, 1) AS INTEGER) AS line_end, 'PROGRAM-ID. ' || module || '.' AS signature, 'external' AS backend FROM r
       UNION ALL SELECT path, module, 'paragraph', 'STEP-' || k, 3, 9, 'step-' || k, 'external' FROM r WHERE k % 4 = 2 UNION ALL SELECT path, module, 'data_item', 'UNKNOWN', 1, 1, 'UNKNOWN', 'external' FROM r WHERE k % 4 = 2
       UNION ALL SELECT path, module, 'record', 'R', CAST(k AS INTEGER), CAST(k AS INTEGER), '01 r.', 'external' FROM r WHERE k % 4 = 2
       UNION ALL SELECT path, upper(regexp_extract(path, '([^/.]*)\\.', 1)), s.k, s.n, CAST(line AS INTEGER), CAST(line AS INTEGER), s.n, 'lines' FROM own WHERE s IS NOT NULL AND path NOT IN (SELECT path FROM r)"""
)
def x11_adopted_symbols(spark, d):
    files = _cobol_sources(spark, d)
    full = """concat('{"program": "ext-', k, '", "imports": ["b", "a"], "more": 1, "symbols": [{"name": "step-', k, '", "kind": "paragraph", "line_start": 3, "line_end": 9}, {}, {"name": "r", "kind": "record", "line_start": ', k, ', "line_end": 0, "signature": "01 r."}]}')"""
    text = f"""case k % 4 when 1 then '{{"program": "cut off' when 2 then {full} when 3 then '{{"symbols": null}}' end"""
    folder = scratch(spark, "side")
    sinks.write_packed(sinks.text_lines(files.selectExpr("path", f"{text} as text"), "path", "text"), folder, ".json")
    side = files_.read_states(spark, folder, SIDE, missing="error", corrupt="drop")
    path = F.substring("file", len(folder) + 2, 1 << 30)
    lines = spans.logical_lines(files)
    get = lambda p: F.regexp_extract("text", p, 1)
    program, copy = get(r"^PROGRAM-ID\.\s+([A-Z0-9-]+)"), get(r"^COPY\s+([A-Z0-9-]+)")
    own = lines.select("path", "line", F.when(program != "", "program").when(copy != "", "copy").alias("kind"), F.concat(program, copy).alias("name")).filter("kind is not null")
    kinds = files.select("path", F.when(F.col("k") % 5 == 1, "copybook").otherwise("program").alias("kind"), "text")
    return spans.adopt(kinds, side.select(path.alias("path"), "state.program", "state.symbols"), own)


@query("""SELECT k AS name, CASE WHEN k % 4 = 1 THEN NULL ELSE k * 2 END AS n, CASE WHEN k % 4 = 2 THEN 'x,y' END AS tags, k % 4 = 1 AS corrupt FROM (SELECT s_suppkey AS k FROM supplier) WHERE k % 4 > 0""")
def s6_states(spark, d):
    folder = scratch(spark, "states")
    text = """case k % 4 when 1 then element_at(array('', '{"n": ', '[1]', 'text'), cast(k div 4 % 4 + 1 as int)) when 2 then concat('{"n": ', k * 2, ', "tags": ["x", "y"], "other": {}}') else concat('{\\n  "n": ', k * 2, '\\n}') end text"""
    states = v.read(spark, d, "supplier").selectExpr("s_suppkey k").filter("k % 4 > 0").selectExpr("cast(k as string) name", text)
    sinks.write_packed(sinks.text_lines(states, "name", "text"), folder, ".json")
    s = files_.read_states(spark, folder, "n long, tags array<string>")
    return s.select(F.regexp_extract("file", "/([0-9]+)$", 1).cast("long").alias("name"), "state.n", F.array_join("state.tags", ",").alias("tags"), "corrupt")


@query(
    """WITH p AS (SELECT page_id AS k, coalesce(url, '') AS url FROM pages)
       SELECT k AS id, CASE WHEN k % 8 IN (0, 1, 2) THEN 'Page' END AS type, CASE WHEN k % 8 IN (1, 2) THEN url END AS first_resource, CASE WHEN k % 8 = 2 THEN 'q ''' || k END AS second_title, CASE WHEN k % 8 = 1 THEN 'b' || k END AS second_tag,
         CASE k % 8 WHEN 3 THEN 'unterminated YAML frontmatter' WHEN 4 THEN 'frontmatter must be a mapping' WHEN 5 THEN 'missing required frontmatter key: type' WHEN 6 THEN 'each sources entry must include resource' END AS error,
         CASE WHEN k % 8 IN (0, 1, 2) THEN '# ' || k || chr(10) || 'text' WHEN k % 8 = 7 THEN 'no front ' || k ELSE '' END AS body FROM p"""
)
def s14_front_matter(spark, d):
    quoted = "concat('\"', replace(replace(coalesce(url, ''), '\\\\', '\\\\\\\\'), '\"', '\\\\\"'), '\"')"
    head = f"""case page_id % 8 when 0 then 'type: Page\\n' when 1 then concat('type: Page\\nsources:\\n- resource: ', {quoted}, '\\n  pages: [1, 2]\\ntags: [a, b', page_id, ']\\n')
        when 2 then concat('# note\\ntype: "Page"   # kind\\nsources:\\n  - title: first\\n    resource: ', {quoted}, '\\n  - resource: two\\n    title: ''q ''''', page_id, '''\\n') when 3 then 'type: Page\\n'
        when 4 then '- type\\n- Page\\n' when 5 then 'title: x\\ntype: ""\\n' when 6 then 'type: Page\\nsources:\\n- resource: a\\n- path: b\\n' end"""
    text = f"""case when page_id % 8 = 7 then concat('no front ', page_id) else concat('---\\n', {head}, if(page_id % 8 = 3, '', '---\\n'), '\\n\\n# ', page_id, '\\ntext\\n') end text"""
    r = frontmatter.read_documents(v.read(spark, d, "pages").selectExpr("page_id id", text))
    get = lambda k: F.try_element_at("front", F.lit(k))
    return r.select("id", get("type").alias("type"), F.when(F.col("id") % 8 == 2, get("sources[0].resource")).otherwise(get("sources[0].resource")).alias("first_resource"), get("sources[1].title").alias("second_title"), get("tags[1]").alias("second_tag"), "error", "body")


@query(
    """WITH s AS (SELECT source AS id, doc_id, CASE WHEN doc_id % 8 = 0 THEN 1 WHEN doc_id % 4 = 0 THEN 1 ELSE doc_id % 7 + 1 END AS n, lang, CASE WHEN doc_id % 6 = 1 THEN source || '@' || doc_id END AS own FROM documents),
       o AS (SELECT *, coalesce(own, id || ':v' || n) AS oid, CAST(doc_id AS VARCHAR) AS ck FROM s),
       x AS (SELECT id, oid, 0 AS at_, oid AS version_id, CAST(n AS VARCHAR) AS version, 'active' AS status, ck AS checksum, true AS synthesized FROM o WHERE doc_id % 3 > 0
             UNION ALL SELECT id, oid, i, 'v' || doc_id || '-' || i, CAST(i + 1 AS VARCHAR), CASE WHEN i = 0 THEN 'superseded' ELSE '' END, lang, false FROM (SELECT *, unnest(range(0, 2)) AS i FROM o WHERE doc_id % 3 = 0))
       SELECT id AS source_id, version, version_id, status, checksum, oid AS active_version_id, synthesized, row_number() OVER (PARTITION BY id ORDER BY at_, version_id, oid, checksum) AS position FROM x"""
)
def m8_version_registry(spark, d):
    number = F.expr("case when doc_id % 8 = 0 then '0' when doc_id % 4 = 0 then 'none' else cast(doc_id % 7 + 1 as string) end")
    versions = "if(doc_id % 3 > 0, if(doc_id % 2 = 0, null, array()), transform(sequence(0, 1), i -> struct(concat('v', doc_id, '-', i) as version_id, cast(i + 1 as string) as version_number, if(i = 0, 'superseded', '') as status, lang as checksum)))"
    s = v.read(spark, d, "documents").select(F.col("source").alias("id"), number.alias("version_number"), F.expr("if(doc_id % 6 = 1, concat(source, '@', doc_id), if(doc_id % 5 = 0, '', null))").alias("version_id"), F.lit("retired").alias("status"), F.col("doc_id").cast("string").alias("checksum"), F.expr(versions).alias("versions"))
    return P.version_registry(s)


@query(
    f"""WITH {ITEMS}, {RULES}, m AS (SELECT * FROM it WHERE seq % 3 < 2), u AS (SELECT * FROM m WHERE coalesce(status, '') <> 'rejected')
       SELECT 'knowledge' AS part, seq AS "at", 0 AS place, id, source_id AS ref, object AS text FROM u UNION ALL SELECT 'relation', seq, 0, 'kr-' || id, id, predicate FROM u UNION ALL SELECT 'evidence', seq, 0, 'evidence-' || id, id, source_text FROM u
       UNION ALL SELECT 'rule', u.seq, CAST(position AS INTEGER), 'rule-' || u.id || '-' || r.s, u.id, r.t FROM u JOIN rl ON rl.id = u.id
       UNION ALL SELECT 'concept', NULL, 0, 'concept-' || {SLUG.format("subject")}, arg_max(id, seq), arg_max(subject, seq) FROM u GROUP BY 4
       UNION ALL SELECT 'excluded', NULL, 0, 'excluded', '', CAST(count(*) AS VARCHAR) FROM m WHERE status = 'rejected'
       UNION ALL SELECT 'conflict', seq, 0, id, subject, predicate FROM (SELECT *, lag(object) OVER (PARTITION BY subject, predicate ORDER BY seq) AS b FROM it) WHERE b <> '' AND b <> object""",
    "items",
)
def q2_agent_context_parts(spark, d):
    items = _items(spark, d)
    return context.context_parts(items.filter("seq % 3 < 2"), items)


@query(
    """SELECT 'symbol' AS part, id, qualified_name AS text FROM v_symbols WHERE id = 'symbol-part-17' UNION ALL SELECT 'evidence', 'ev-l17', 'lines of 17'
       UNION ALL SELECT 'relation', id, subject || ' ' || predicate || ' ' || object FROM (SELECT object AS subject, predicate, subject AS object, id FROM v_relations) WHERE contains(lower(subject), 'symbol-part-17')
       UNION ALL SELECT 'claim', id, claim FROM v_claims WHERE id IN (SELECT claim_id FROM v_claim_symbols WHERE symbol_id = 'symbol-part-17')""",
    "symbols relations claims claim_symbols",
)
def f4_symbol_record(spark, d):
    s = v.symbols(spark, d).withColumn("evidence_id", F.concat(F.lit("ev-l"), "seq"))
    e = v.read(spark, d, "orders").selectExpr("concat('ev-l', o_orderkey) id", "concat('lines of ', o_orderkey) excerpt", "o_orderkey seq")
    r = v.relations(spark, d).select("id", F.col("object").alias("subject"), "predicate", F.col("subject").alias("object"))
    return S.symbol_record("symbol-part-17", s, e, r, v.claims(spark, d), v.claim_symbols(spark, d))


@query("""SELECT file, CAST(row_number() OVER (PARTITION BY file ORDER BY line, qualified_name, id) AS INTEGER) AS position, id FROM v_symbols""", "symbols")
def j25_symbols_by_file(spark, d):
    return S.by_file(v.symbols(spark, d))


@query("""SELECT id, row_number() OVER (ORDER BY file, line, qualified_name, id) AS position FROM v_symbols""", "symbols")
def w13_symbol_order(spark, d):
    return S.ordered(v.symbols(spark, d).select("file", "line", "qualified_name", "id"), ["file", "line", "qualified_name", "id"]).select("id", "position")


@query(
    """SELECT 'symbol' AS kind, id, qualified_name AS title FROM v_symbols WHERE contains(lower(id || ' ' || qualified_name), 'part-12') UNION ALL SELECT 'claim', id, claim FROM v_claims WHERE contains(lower(claim), 'part-12')
       UNION ALL SELECT 'file', id, path FROM v_sources WHERE contains(lower(path), 'part-12') UNION ALL SELECT 'document', id, subject FROM v_items WHERE contains(lower(subject || ' ' || source_text), 'part-12')
       UNION ALL SELECT 'endpoint', 'endpoint-' || s_suppkey, '/api/' || s_suppkey FROM supplier WHERE contains(lower('GET /api/' || s_suppkey || CASE WHEN s_suppkey % 2 = 0 THEN ' symbol-PART-' || s_suppkey ELSE '' END), 'part-12')""",
    "symbols claims sources items",
)
def u8_grouped_search(spark, d):
    e = v.read(spark, d, "supplier").selectExpr("concat('endpoint-', s_suppkey) id", "'GET' method", "concat('/api/', s_suppkey) path", "if(s_suppkey % 2 = 0, concat('symbol-PART-', s_suppkey), null) handler")
    return S.global_search("Part-12", v.symbols(spark, d), v.claims(spark, d), v.sources(spark, d), v.items(spark, d), e)


@query(
    """WITH i AS (SELECT DISTINCT module, string_split(replace(name, 'ext.', 'ext'), '.')[1] AS package FROM v_code_imports), own AS (SELECT DISTINCT unnest(string_split(module, '.')[1:2]) AS package FROM v_code_symbols),
       d AS (SELECT package, count(*) AS modules FROM i WHERE package <> 'ext1' AND package NOT IN (SELECT package FROM own) GROUP BY 1)
       SELECT 'summary' AS section, 'endpoints' AS name, count(*) AS n FROM events UNION ALL SELECT 'summary', 'http_endpoints', count(*) FROM events WHERE event_type IN ('view', 'click') UNION ALL SELECT 'summary', 'cli_commands', count(*) FROM events WHERE event_type = 'purchase'
       UNION ALL SELECT 'summary', 'tasks', count(*) FROM events WHERE event_type = 'signup' UNION ALL SELECT 'summary', 'routers', count(*) FROM supplier UNION ALL SELECT 'summary', 'apps', count(*) FROM supplier WHERE s_suppkey % 4 = 0
       UNION ALL SELECT 'summary', 'data_models', count(*) FROM part WHERE p_partkey % 5 = 0 OR p_partkey % 7 = 0 UNION ALL SELECT 'summary', 'schemas', count(*) FROM part WHERE p_partkey % 5 = 1 UNION ALL SELECT 'summary', 'dependencies', count(*) FROM d
       UNION ALL SELECT 'dependency', package, modules FROM d UNION ALL SELECT 'framework', CASE package WHEN 'ext2' THEN 'FastAPI' ELSE 'Flask' END, CAST(sum(modules) AS BIGINT) FROM d WHERE package IN ('ext2', 'ext3', 'ext4') GROUP BY 2""",
    "code_symbols code_imports",
)
def a21_architecture_state(spark, d):
    kinds = "element_at(map('view', 'http', 'purchase', 'cli', 'signup', 'task', 'error', 'other'), event_type) kind"
    routers = v.read(spark, d, "supplier")
    classes = v.read(spark, d, "part").selectExpr("p_partkey id", "if(p_partkey % 5 = 0, array('x', 'Base'), if(p_partkey % 5 = 1, array('BaseModel'), array())) bases", "if(p_partkey % 7 = 0, array('mapped'), null) decorators")
    models, schemas = P.plain_data_classes(classes, ["mapped"], ["Base"]), P.plain_data_classes(classes, [], ["BaseModel"])
    imports = v.code_imports(spark, d).withColumn("name", F.replace("name", F.lit("ext."), F.lit("ext")))
    needed = A.dependencies(imports, v.code_symbols(spark, d).select("module").distinct(), ["ext1"])
    return A.architecture_state(v.read(spark, d, "events").selectExpr(kinds), routers, routers.filter("s_suppkey % 4 = 0"), models, schemas, needed, {"ext2": "FastAPI", "ext3": "Flask", "ext4": "Flask"})
