"""Registered queries over items, claims, traces, rules and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from fathomkb.functions import scalars as fn
from fathomkb.operators import claims as C
from fathomkb.operators import context as X
from fathomkb.operators import report as P
from fathomkb.operators import search as S
from fathomkb.operators import validate as V
from fathomkb.plans.registry import query
from fathomkb.sources import views as v


@query("""SELECT id, status FROM v_items WHERE contains(lower(subject), 'user') AND contains(lower(predicate), 'should') AND contains(lower(object), 'e')""", "items")
def f5_item_relations_search(spark, d):
    return P.item_relations_search(v.items(spark, d), "USER", "should", "E").select("id", "status")


@query("""SELECT 'evidence-' || id AS cited, id, source_text FROM v_items WHERE seq % 2 = 0""", "items")
def f10_citations(spark, d):
    i = v.items(spark, d)
    rows = i.select(F.concat(F.when(F.col("seq") % 2 == 0, "evidence-").otherwise("evidence-evidence-"), "id").alias("e"))
    return P.citations(rows, "e", i)


@query("""SELECT id FROM v_symbols WHERE contains(lower(qualified_name || ' ' || title || ' ' || docstring), 'gear') OR contains(lower(qualified_name || ' ' || title || ' ' || docstring), 'promo ')""", "symbols")
def f13_operational_symbols(spark, d):
    return P.operational(v.symbols(spark, d), v.relations(spark, d), ["gear", "promo "])


@query("""SELECT p_partkey AS id FROM part WHERE p_brand IN ('Brand#3', 'Brand#7') OR p_type = 'SMALL'""")
def f15_plain_data_classes(spark, d):
    c = v.read(spark, d, "part").select(F.col("p_partkey").alias("id"), F.array("p_brand", F.lit("x")).alias("decorators"), F.when(F.col("p_size") > 3, F.array("p_type")).otherwise(F.array("p_type", F.lit("y"))).alias("bases"))
    return P.plain_data_classes(c, ["Brand#3", "Brand#7"], ["SMALL"]).select("id")


@query("""SELECT string_split(name, '.')[1] AS root, count(*) AS n FROM v_code_imports WHERE string_split(name, '.')[1] NOT IN (SELECT string_split(module, '.')[2] FROM v_code_symbols WHERE seq % 40 = 0 UNION SELECT 'ext') GROUP BY 1""", "code_symbols code_imports")
def f16_external_roots(spark, d):
    own = v.code_symbols(spark, d).filter("seq % 40 = 0").select(F.element_at(F.split("module", r"\."), 2).alias("root"))
    return P.external_roots(v.code_imports(spark, d), own, ["ext"])


@query("""SELECT seq, subject, predicate, object FROM v_relations WHERE predicate IN ('calls', 'performs', 'jumps_to', 'branches_on')""", "relations")
def f17_workflow_relations(spark, d):
    return v.relations(spark, d).filter(F.col("predicate").isin(P.WORKFLOW)).select("seq", "subject", "predicate", "object")


@query("""SELECT id, path, language, checksum, n_chars FROM v_sources""", "sources")
def f19_sources_list(spark, d):
    return v.sources(spark, d).drop("seq")


@query("""SELECT item_id AS id, max(seq) AS seq, max_by(action, seq) AS action FROM v_review_events GROUP BY 1""", "review_events")
def j1_last_by_id(spark, d):
    e = v.review_events(spark, d).select(F.col("item_id").alias("id"), "seq", "action", F.col("seq").alias("at"))
    return P.last_by_id(e, "at").select("id", "seq", "action")


LANGUAGES = """a AS (SELECT seq, id, CASE WHEN seq % 3 = 0 THEN 'cobol' WHEN seq % 3 = 1 THEN 'python' ELSE 'java' END AS language, lower(replace(title, '_', ' ')) AS name,
    CASE WHEN kind IN ('function', 'method', 'paragraph', 'section', 'test') THEN 'operation' WHEN kind IN ('class', 'record', 'data_item', 'data') THEN 'type' ELSE kind END AS kind FROM v_symbols)"""


def _artifacts(spark, d):
    language = F.when(F.col("seq") % 3 == 0, "cobol").when(F.col("seq") % 3 == 1, "python").otherwise("java")
    return v.symbols(spark, d).select("seq", "id", language.alias("language"), fn.canonical_name(F.col("title")).alias("name"), fn.canonical_kind(F.col("kind")).alias("kind"))


@query(f"""WITH {LANGUAGES}, t AS (SELECT name, kind, max_by(id, seq) AS target_id FROM a WHERE language IN ('python') GROUP BY 1, 2)
    SELECT a.id, target_id, CASE WHEN target_id IS NULL THEN 'unresolved' ELSE 'mapped' END AS disposition FROM a LEFT JOIN t USING (name, kind) WHERE language IN ('cobol', 'java')""", "symbols")
def j18_language_trace(spark, d):
    return P.language_trace(_artifacts(spark, d), ["cobol", "java"], ["python"])


@query("""SELECT coalesce(nullif(CASE WHEN event_id % 2 = 0 THEN event_type WHEN event_id % 5 = 1 THEN '' END, ''), CASE WHEN event_id % 3 > 0 THEN 'preserved' END, 'unknown') AS disposition, count(*) AS n FROM events GROUP BY 1""")
def a7_disposition_counts(spark, d):
    e = v.read(spark, d, "events").selectExpr("case when event_id % 2 = 0 then event_type when event_id % 5 = 1 then '' end disposition", "if(event_id % 3 > 0, 'preserved', null) mapping")
    return P.disposition_counts(e)


TRACES = "t AS (SELECT id, kind, ['preserved', 'missing', 'renamed'][line % 3 + 1] AS disposition FROM v_symbols)"


def _traces(spark, d):
    return v.symbols(spark, d).selectExpr("id", "kind", "element_at(array('preserved', 'missing', 'renamed'), cast(line % 3 + 1 as int)) disposition")


@query(f"""WITH {TRACES} SELECT 'operations' AS label, count(*) AS artifacts, count(*) FILTER (disposition = 'preserved') AS preserved FROM t WHERE kind IN ('function', 'method')
    UNION ALL SELECT 'data', count(*), count(*) FILTER (disposition = 'preserved') FROM t WHERE kind IN ('record', 'class')""", "symbols")
def a28_equivalence(spark, d):
    return P.equivalence(_traces(spark, d), {"operations": ["function", "method"], "data": ["record", "class"]})


@query(f"WITH {TRACES} SELECT kind, count(*) AS gaps, min(id) AS first_id FROM t WHERE disposition <> 'preserved' GROUP BY 1", "symbols")
def a28_gaps(spark, d):
    return P.gaps_by_kind(_traces(spark, d))


@query(
    """WITH i AS (SELECT id, status, CASE WHEN seq % 13 > 0 THEN source_id END AS source_id, CASE WHEN turn % 4 = 0 THEN '' ELSE 's' END AS section_id, CASE WHEN seq % 9 > 0 THEN source_text ELSE '' END AS source_text, CASE WHEN seq % 2 = 0 THEN 'unresolved' END AS span_status, CASE WHEN seq % 3 > 0 THEN (seq % 100) / 100.0 END AS confidence FROM v_items),
       r AS (SELECT 'r' || seq AS id, item_id || '-' || (seq % 3) AS item_id, action, CASE WHEN seq % 7 > 0 THEN reviewer ELSE '' END AS reviewer, CASE WHEN seq % 11 > 0 THEN ts END AS ts FROM v_review_events)
       SELECT 'error' AS level, 'invalid_status' AS rule, id FROM i WHERE coalesce(status, '') NOT IN ('proposed', 'approved', 'rejected', 'edited', 'deferred') UNION ALL SELECT 'error', 'missing_source', id FROM i WHERE coalesce(source_id, '') = ''
       UNION ALL SELECT 'error', 'missing_section', id FROM i WHERE section_id = '' UNION ALL SELECT 'warning', 'missing_text', id FROM i WHERE source_text = '' AND coalesce(span_status, '') <> 'unresolved'
       UNION ALL SELECT 'warning', 'low_confidence', id FROM i WHERE coalesce(confidence, 1) < 0.7 UNION ALL SELECT 'error', 'missing_reviewer', id FROM r WHERE reviewer = '' UNION ALL SELECT 'error', 'missing_timestamp', id FROM r WHERE ts IS NULL
       UNION ALL SELECT 'error', 'unknown_item', id FROM r WHERE item_id NOT IN (SELECT id FROM i)""",
    "items review_events",
)
def j20_item_integrity(spark, d):
    i = v.items(spark, d).selectExpr("id", "status", "if(seq % 13 > 0, source_id, null) source_id", "if(turn % 4 = 0, '', 's') section_id", "if(seq % 9 > 0, source_text, '') source_text", "if(seq % 2 = 0, 'unresolved', null) span_status", "if(seq % 3 > 0, (seq % 100) / 100.0D, null) confidence")
    r = v.review_events(spark, d).selectExpr("concat('r', seq) id", "concat(item_id, '-', seq % 3) item_id", "action", "if(seq % 7 > 0, reviewer, '') reviewer", "if(seq % 11 > 0, ts, null) ts")
    return V.items(i, r)


@query(
    """WITH b AS (SELECT s_suppkey AS id, CASE WHEN s_nationkey % 4 > 0 THEN 'code-knowledge-bundle' WHEN s_nationkey % 8 = 0 THEN 'other' END AS profile, s_acctbal > 0 AS configured, CASE WHEN s_suppkey % 3 > 0 THEN ['state', 'docs'] ELSE ['docs'] END AS dirs FROM supplier)
       SELECT 'error' AS level, 'profile' AS rule, id FROM b WHERE profile IS DISTINCT FROM 'code-knowledge-bundle' UNION ALL SELECT 'error', 'configuration', id FROM b WHERE NOT configured
       UNION ALL SELECT 'error', 'directory:' || n, id FROM b, (VALUES ('state'), ('docs'), ('reports')) t(n) WHERE NOT list_contains(dirs, n)"""
)
def v1_bundle_profile(spark, d):
    b = v.read(spark, d, "supplier").selectExpr("s_suppkey id", "case when s_nationkey % 4 > 0 then 'code-knowledge-bundle' when s_nationkey % 8 = 0 then 'other' end profile", "s_acctbal > 0 configured", "if(s_suppkey % 3 > 0, array('state', 'docs'), array('docs')) directories")
    return V.profile(b, ["state", "docs", "reports"])


@query(
    """WITH s AS (SELECT doc_id AS id, CASE WHEN doc_id % 17 > 0 THEN lang END AS language, CASE WHEN doc_id % 5 > 0 THEN 'v1' ELSE '' END AS version_id FROM documents)
       SELECT 'error' AS level, 'missing_version' AS rule, id FROM s WHERE version_id = '' UNION ALL SELECT 'error', 'missing_language', id FROM s WHERE coalesce(language, '') = ''
       UNION ALL SELECT 'error', 'missing_document', id FROM s WHERE id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT 'error', 'missing_original', id FROM s WHERE id NOT IN (SELECT page_id FROM pages)"""
)
def v2_inventory(spark, d):
    s = v.read(spark, d, "documents").selectExpr("doc_id id", "if(doc_id % 17 > 0, lang, null) language", "if(doc_id % 5 > 0, 'v1', '') version_id")
    return V.inventory(s, v.read(spark, d, "labels").selectExpr("doc_id id"), v.read(spark, d, "pages").selectExpr("page_id id"))


@query(
    """WITH l AS (SELECT l_orderkey AS id, list(DISTINCT 'p' || l_partkey) AS required, list(DISTINCT 'p' || l_partkey) FILTER (l_returnflag <> 'A') AS cited FROM lineitem GROUP BY 1),
       x AS (SELECT id, list_sort(list_filter(required, lambda r: NOT list_contains(coalesce(cited, []), r))) AS gone FROM l)
       SELECT id, array_to_string(gone, ',') AS left_out, CASE WHEN id % 6 = 0 THEN 'claim_missing' WHEN len(gone) > 0 THEN 'member_not_cited' END AS rejected FROM x"""
)
def v6_procedure_candidates(spark, d):
    name = F.concat(F.lit("p"), "l_partkey")
    c = v.read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_set(name).alias("required"), F.collect_set(F.when(F.col("l_returnflag") != "A", name)).alias("cited"))
    return V.procedure(c.withColumn("claim", F.when(F.col("id") % 6 > 0, "steps").otherwise(" ")))


@query(
    """WITH e AS (SELECT o_orderkey AS id, ['preserved', 'mapped', 'missing', 'unresolved', 'odd'][o_custkey % 5 + 1] AS disposition, CASE WHEN o_orderkey % 2 = 0 THEN 'approved' END AS review_status, CASE WHEN o_orderkey % 3 > 0 THEN o_custkey END AS target_id, o_orderkey % 7 = 0 AS critical FROM orders)
       SELECT 'error' AS level, 'disposition' AS rule, id FROM e WHERE disposition = 'odd' UNION ALL SELECT 'error', 'approved_unresolved', id FROM e WHERE disposition = 'unresolved' AND review_status = 'approved'
       UNION ALL SELECT 'error', 'target_missing', id FROM e WHERE disposition IN ('preserved', 'mapped') AND target_id IS NULL UNION ALL SELECT 'warning', 'critical_missing', id FROM e WHERE critical AND disposition IN ('missing', 'unresolved')
       UNION ALL SELECT 'error', 'unknown_target', id FROM e WHERE target_id IS NOT NULL AND target_id NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)"""
)
def v7_traces(spark, d):
    e = v.read(spark, d, "orders").selectExpr("o_orderkey id", "element_at(array('preserved', 'mapped', 'missing', 'unresolved', 'odd'), cast(o_custkey % 5 + 1 as int)) disposition", "if(o_orderkey % 2 = 0, 'approved', null) review_status", "if(o_orderkey % 3 > 0, o_custkey, null) target_id", "o_orderkey % 7 = 0 critical")
    return V.traces(e, v.read(spark, d, "customer").filter("c_acctbal > 0").selectExpr("c_custkey id"))


@query(
    """WITH r AS (SELECT CASE WHEN event_id % 19 > 0 THEN CAST(event_id AS VARCHAR) ELSE '' END AS id, event_id, user_id, value FROM events)
       SELECT 'error' AS level, 'id_missing' AS rule, id FROM r WHERE id = '' UNION ALL SELECT 'error', 'obligation', id FROM r WHERE user_id % 4 = 0 OR event_id % 9 = 0
       UNION ALL SELECT 'error', 'condition', id FROM r WHERE user_id % 3 > 0 AND event_id % 8 = 0 UNION ALL SELECT 'error', 'otherwise', id FROM r WHERE event_id % 5 IN (1, 2)"""
)
def v8_rule_schema(spark, d):
    r = v.read(spark, d, "events").selectExpr(
        "if(event_id % 19 > 0, cast(event_id as string), null) id", "if(user_id % 4 = 0, null, named_struct('fact', 'f', 'action', if(event_id % 9 = 0, '', 'a'), 'label', 'l')) obligation",
        "if(user_id % 3 = 0, null, named_struct('fact', if(event_id % 8 = 0, null, 'f'), 'operator', 'is', 'label', 'l')) condition",
        """case event_id % 5 when 0 then null when 1 then '{"action_required": "yes"}' when 2 then '{}' else '{"action_required": false}' end otherwise""",
    )
    return V.rule_schema(r)


@query(
    """SELECT 'k' || event_id AS id, CASE WHEN event_type NOT IN ('view', 'click', 'purchase') THEN 'kind' WHEN event_id % 7 = 0 THEN 'unknown_id' WHEN event_id % 5 = 0 THEN 'own_symbol_missing' WHEN event_id % 3 = 0 THEN 'quote_missing' END AS rejected,
       CASE WHEN event_id % 3 = 0 THEN true ELSE contains(props, CASE WHEN event_id % 2 = 0 THEN '"k"' ELSE 'none' END) END AS anchored FROM events"""
)
def v5_claim_candidates(spark, d):
    c = v.read(spark, d, "events").selectExpr("concat('k', event_id) id", "event_type kind", "case when event_id % 7 = 0 then array('own', 'odd') when event_id % 5 = 0 then array('a') else array('own', 'a') end cited", "array('own', 'a', 'b') allowed", "'own' own", "case when event_id % 3 = 0 then ' ' when event_id % 2 = 0 then '\"k\"' else 'none' end quote", "props source")
    return V.candidate(c, ["view", "click", "purchase"])


@query("""WITH k AS (SELECT id, row_number() OVER (ORDER BY id) AS n, count(*) OVER () AS size FROM v_claims WHERE tier = 2 AND seq % 11 = 0) SELECT id, 'approved' AS review_status, printf('crev-%04d %s of %d', n, 'approve', size) AS event FROM k""", "claims")
def m6_bulk_review(spark, d):
    c = v.claims(spark, d)
    return P.bulk_review(c, c.filter("tier = 2 and seq % 11 = 0").unionByName(c.limit(0)), "approve", "seen", {"approve": "approved", "reject": "rejected"})


@query(f"WITH {TRACES} SELECT id, disposition, CASE WHEN disposition IN ('preserved', 'renamed') THEN 'approved' ELSE 'proposed' END AS review_status FROM t", "symbols")
def m7_trace_review(spark, d):
    return P.trace_review(_traces(spark, d).withColumn("review_status", F.lit("")))


@query("""SELECT id, subject, predicate, object, status, confidence, CAST(1 + seq % 4 AS INTEGER) AS tier FROM v_relations""", "relations")
def p4_canonical_relations(spark, d):
    r = v.relations(spark, d).select("id", "subject", "predicate", "object", F.struct(F.col("status").alias("resolution_status"), "confidence").alias("relation"), F.expr("cast(1 + seq % 4 as int)").alias("knowledge_tier"))
    return P.canonical_relations(r)


@query("""SELECT id, 'relation' AS type, subject, predicate, object, status, confidence, evidence, 'f' || seq % 5 AS file FROM v_relations""", "relations")
def p2_relation_view(spark, d):
    from fathomkb.operators import relations as R

    r = v.relations(spark, d).select("id", F.lit("").alias("type"), "subject", "predicate", "object", F.struct(F.col("status").alias("resolution_status"), "confidence").alias("relation"), F.array("evidence").alias("evidence"), F.struct(F.concat(F.lit("f"), F.col("seq") % 5).alias("file")).alias("code"))
    return R.relation_view(r).withColumn("evidence", F.array_join("evidence", ","))


@query("""SELECT id, subject, predicate, object, source_text, source_id, status FROM v_items""", "items")
def p6_evidence_view(spark, d):
    return v.items(spark, d).select("id", "subject", "predicate", "object", "source_text", "source_id", "status")


@query(
    """SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'd' || doc_id || '.md' WHEN 1 THEN '../../sources/' || source || '/d' || doc_id || '.md' ELSE '../sub/d' || doc_id || '.md' END AS link FROM documents"""
)
def p9_relative_links(spark, d):
    docs = v.read(spark, d, "documents")
    target = F.expr("concat(case doc_id % 3 when 0 then 'knowledge/items' when 1 then concat('sources/', source) else 'knowledge/./x/../sub' end, '/d', doc_id, '.md')")
    return docs.select("doc_id", fn.relative_link(F.concat(F.lit("knowledge/items/a"), "doc_id", F.lit(".md")), target).alias("link"))


@query("""SELECT subject, count(*) AS n, list_aggregate(list(id ORDER BY id), 'string_agg', ',') AS ids FROM v_items GROUP BY 1""", "items")
def p11_slim_concepts(spark, d):
    full = v.items(spark, d).groupBy("subject").agg(F.array_sort(F.collect_list(F.struct("id", "source_text", "object", "status"))).alias("rows"))
    slim = full.select("subject", F.transform("rows", lambda r: r.dropFields("source_text", "object", "status")).alias("rows"))
    return slim.select("subject", F.size("rows").cast("long").alias("n"), F.array_join(F.transform("rows", lambda r: r["id"]), ",").alias("ids"))


@query(
    """WITH p AS (SELECT count(*) FILTER (coalesce(nullif(lifecycle_status, ''), 'active') = 'active' AND (review_required OR tier = 4) AND review_status = 'proposed') AS pending FROM v_claims)
       SELECT pending, CASE WHEN (SELECT count(*) FROM v_symbols) = 0 THEN 'not built' WHEN pending > 0 THEN pending || ' awaiting review' ELSE 'reviewed' END AS state FROM p""",
    "claims symbols",
)
def a2_bundle_state(spark, d):
    return P.bundle_state(v.symbols(spark, d), v.claims(spark, d))


@query("""SELECT 'sources' AS name, count(*) AS n FROM v_sources UNION ALL SELECT 'symbols', count(*) FROM v_symbols UNION ALL SELECT 'relations', count(*) FROM v_relations UNION ALL SELECT 'claims', count(*) FROM v_claims""", "sources symbols relations claims")
def a2_bundle_describe(spark, d):
    return P.describe(sources=v.sources(spark, d), symbols=v.symbols(spark, d), relations=v.relations(spark, d), claims=v.claims(spark, d))


@query("""SELECT count(*) FILTER (turn % 3 = 1) AS dated, count(*) FILTER (turn % 3 <> 1) AS undated FROM v_items""", "items")
def a12_freshness(spark, d):
    return P.freshness(v.items(spark, d), F.expr("case turn % 3 when 0 then '' when 1 then '2030-01-01' end"))


@query("""SELECT 'items' AS name, count(*) AS n FROM v_items UNION ALL SELECT 'reviews', count(*) FROM v_review_events""", "items review_events")
def a14_extraction_summary(spark, d):
    return P.describe(items=v.items(spark, d), reviews=v.review_events(spark, d))


@query(
    """WITH c AS (SELECT kind AS name, count(*) AS n FROM v_symbols GROUP BY 1) SELECT 1 AS line, '# Symbols' AS text UNION ALL SELECT 2, '' UNION ALL SELECT CAST(2 + row_number() OVER (ORDER BY n DESC, name) AS INTEGER), '- ' || name || ': ' || n FROM c""",
    "symbols",
)
def s19_report(spark, d):
    return P.report_lines(v.symbols(spark, d).groupBy(F.col("kind").alias("name")).agg(F.count("*").alias("n")), "Symbols")


@query("""SELECT 'endpoints' AS section, event_type AS kind, count(*) AS n FROM events GROUP BY 2 UNION ALL SELECT 'routers', 'all', count(*) FROM supplier UNION ALL SELECT 'models', 'all', count(*) FROM v_symbols WHERE kind = 'class'""", "symbols")
def a21_architecture_summary(spark, d):
    return P.architecture_summary(v.read(spark, d, "events").select(F.col("event_type").alias("kind")), v.read(spark, d, "supplier"), v.symbols(spark, d).filter("kind = 'class'"))


@query(
    """WITH n AS (SELECT upper(replace(p_name, ' ', '-')) AS name, p_size FROM part), d AS (SELECT DISTINCT name FROM n WHERE p_size < 12), u AS (SELECT name, count(*) AS uses FROM n WHERE p_size > 25 GROUP BY 1)
       SELECT coalesce(d.name, u.name) AS name, d.name IS NOT NULL AS defined, coalesce(uses, 0) AS uses FROM d FULL JOIN u ON d.name = u.name"""
)
def j23_copybooks(spark, d):
    p = v.read(spark, d, "part").select(F.replace("p_name", F.lit(" "), F.lit("-")).alias("name"), "p_size")
    return P.copybooks(p.filter("p_size < 12"), p.filter("p_size > 25"))


@query(
    """WITH s AS (SELECT *, upper(title) AS key FROM v_code_symbols WHERE seq % 2 = 0), a AS (SELECT module, key, min_by(id, seq) AS near FROM s GROUP BY 1, 2), o AS (SELECT key, min(id) AS single FROM s GROUP BY 1 HAVING count(*) = 1),
       r AS (SELECT DISTINCT module, title AS name FROM v_code_symbols)
       SELECT r.module, r.name, coalesce(near, single) AS target, coalesce(near, single) IS NULL AS external FROM r LEFT JOIN a ON a.module = r.module AND a.key = upper(r.name) LEFT JOIN o ON o.key = upper(r.name)""",
    "code_symbols",
)
def j24_cobol_references(spark, d):
    s = v.code_symbols(spark, d)
    return P.cobol_references(s.select("module", F.col("title").alias("name")), s.filter("seq % 2 = 0"))


@query("""SELECT DISTINCT s.id, s.qualified_name FROM v_relations r JOIN v_symbols s ON s.id = r.object WHERE r.subject = 'symbol-supplier-3'""", "relations symbols")
def j26_author_neighbourhood(spark, d):
    return P.author_neighbourhood(v.relations(spark, d), v.symbols(spark, d), "symbol-supplier-3")


@query("""SELECT p_partkey AS id, array_to_string(list_transform(string_split(p_name || '  ' || p_type, ' '), lambda w: upper(substr(w, 1, 1)) || lower(substr(w, 2))), ' ') AS title FROM part""")
def c7_title_case(spark, d):
    return v.read(spark, d, "part").select(F.col("p_partkey").alias("id"), fn.title_case(F.concat_ws("  ", "p_name", "p_type")).alias("title"))


@query("""SELECT event_id AS id, CASE WHEN event_id % 5 < 2 AND value BETWEEN 0 AND 100 THEN value / 100 END AS confidence FROM events""")
def c10_confidence_edits(spark, d):
    text = F.expr("case event_id % 5 when 0 then concat(' ', cast(value / 100 as string)) when 1 then cast(value / 100 as string) when 2 then 'high' when 3 then 'nan' end")
    return v.read(spark, d, "events").select(F.col("event_id").alias("id"), fn.parse_confidence(text).alias("confidence"))


@query(
    """SELECT doc_id, CASE WHEN length(trim(regexp_replace(text, '\\s+', ' ', 'g'))) > 200 THEN substr(trim(regexp_replace(text, '\\s+', ' ', 'g')), 1, 200) || ' …' ELSE trim(regexp_replace(text, '\\s+', ' ', 'g')) END AS signature FROM documents""".replace("\\\\", "\\")
)
def c11_short_signatures(spark, d):
    return v.read(spark, d, "documents").select("doc_id", fn.short_signature(F.col("text")).alias("signature"))


@query(
    """SELECT seq, CAST(len(list_filter(range(1, 9), lambda k: string_split(qualified_name, '.')[1:k] = string_split(file, '.')[1:k] AND len(string_split(qualified_name, '.')) >= k AND len(string_split(file, '.')) >= k)) AS BIGINT) AS shared
       FROM (SELECT seq, qualified_name, replace(replace(file, '/', '.'), 'small', 'other') AS file FROM v_symbols)""",
    "symbols",
)
def c14_shared_prefixes(spark, d):
    other = F.replace(F.replace("file", F.lit("/"), F.lit(".")), F.lit("small"), F.lit("other"))
    return v.symbols(spark, d).select("seq", fn.shared_prefix_len(F.col("qualified_name"), other).cast("long").alias("shared"))


@query(
    """SELECT id, CASE WHEN contains(p, '/') THEN CASE WHEN regexp_replace(p, '/[^/]*$', '') = '' THEN '/' ELSE regexp_replace(p, '/[^/]*$', '') END ELSE '' END AS dir, CASE id % 4 WHEN 0 THEN 'a' WHEN 1 THEN '/a' WHEN 2 THEN 'b/c' ELSE '../c' END || '/' || id AS norm
       FROM (SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN 'a/./b/..' WHEN 1 THEN '/../a' WHEN 2 THEN 'b//c' ELSE 'x/../../c' END || '/' || p_partkey AS p FROM part)"""
)
def c16_posix_paths(spark, d):
    p = F.expr("concat(case p_partkey % 4 when 0 then 'a/./b/..' when 1 then '/../a' when 2 then 'b//c' else 'x/../../c' end, '/', p_partkey)")
    return v.read(spark, d, "part").select(F.col("p_partkey").alias("id"), fn.dirname(p).alias("dir"), fn.normpath(p).alias("norm"))


@query("""SELECT event_id AS id, sha256('{"actor":"u' || user_id || '","prompt":"' || sha256(event_type) || '","request":"r' || event_id % 9 || '","version":"1"}') AS key FROM events""")
def c17_fingerprints(spark, d):
    e = v.read(spark, d, "events")
    return e.select(F.col("event_id").alias("id"), fn.fingerprint(F.lit("1"), F.concat(F.lit("r"), F.col("event_id") % 9), F.concat(F.lit("u"), "user_id"), F.col("event_type")).alias("key"))


@query(
    """SELECT id, CASE WHEN tier = 2 THEN 'k' || tier WHEN review_status IS NOT NULL THEN review_status ELSE 'unclassified' END AS kind, CASE WHEN seq % 2 = 0 THEN 'pkg.mod' ELSE CASE WHEN seq % 3 = 0 THEN 'unknown' ELSE 'f.py' END END AS module FROM v_claims""",
    "claims",
)
def c20_claim_kinds(spark, d):
    c = v.claims(spark, d)
    return c.select("id", fn.claim_kind(F.expr("if(tier = 2, concat('k', tier), '')"), F.col("review_status")).alias("kind"), fn.claim_module(F.expr("if(seq % 2 = 0, 'pkg.mod.f', 'plain')"), F.expr("if(seq % 3 = 0, '', 'f.py')")).alias("module"))


@query("""SELECT id, subject, predicate, object, status, confidence FROM (SELECT DISTINCT id, subject, predicate, object, status, confidence FROM v_relations WHERE status <> 'exact') ORDER BY predicate, subject, object, status LIMIT 100""", "relations")
def a16_open_relations(spark, d):
    r = v.relations(spark, d).filter("status <> 'exact'").select("id", "subject", "predicate", "object", "status", "confidence").distinct()
    return r.orderBy("predicate", "subject", "object", "status").limit(100)


@query("""SELECT coalesce(nullif(lifecycle_status, ''), 'active') AS lifecycle_status, count(*) AS n, count(DISTINCT source_id) AS sources FROM v_claims GROUP BY 1""", "claims")
def a11_lifecycle_counts(spark, d):
    return v.claims(spark, d).groupBy(fn.nonempty(F.col("lifecycle_status"), "active").alias("lifecycle_status")).agg(F.count("*").alias("n"), F.count_distinct("source_id").alias("sources"))


@query(
    """SELECT 'sources' AS name, count(*) AS n FROM v_sources UNION ALL SELECT 'modules', count(DISTINCT module) FROM v_symbols UNION ALL SELECT 'symbols', count(*) FROM v_symbols UNION ALL SELECT 'evidence', count(DISTINCT evidence) FROM v_relations
       UNION ALL SELECT 'relations', count(*) FROM v_relations UNION ALL SELECT 'claims', count(*) FROM v_claims UNION ALL SELECT 'reviews', count(*) FROM v_review_events UNION ALL SELECT 'language:' || language, count(*) FROM v_sources GROUP BY 1""",
    "sources symbols relations claims review_events",
)
def a1_repository_counts(spark, d):
    sources, symbols, relations = v.sources(spark, d), v.symbols(spark, d), v.relations(spark, d)
    counts = P.describe(sources=sources, modules=symbols.select("module").distinct(), symbols=symbols, evidence=relations.select("evidence").distinct(), relations=relations, claims=v.claims(spark, d), reviews=v.review_events(spark, d))
    return counts.unionByName(sources.groupBy(F.concat(F.lit("language:"), "language").alias("name")).agg(F.count("*").alias("n")))


@query(
    """WITH c AS (SELECT *, CASE seq % 3 WHEN 0 THEN 'anchored' WHEN 1 THEN 'unanchored' END AS anchor FROM v_claims WHERE coalesce(nullif(lifecycle_status, ''), 'active') = 'active')
       SELECT coalesce(anchor, 'unknown') AS pool, tier, count(*) AS claims FROM c GROUP BY 1, 2""",
    "claims",
)
def f11_anchor_pools(spark, d):
    c = v.claims(spark, d).withColumn("anchor_status", F.expr("case seq % 3 when 0 then 'anchored' when 1 then 'unanchored' end"))
    return S.anchor_pools(c)


@query("""SELECT id, path FROM v_sources WHERE contains(lower(path), 'src1') OR contains(lower(id), 'src1')""", "sources")
def f12_source_facets(spark, d):
    return S.facet(v.sources(spark, d), ["path", "id"], "SRC1").select("id", "path")


@query("""SELECT seq, subject, object FROM v_relations WHERE contains(lower(object), 'part-11') AND predicate = 'calls' AND status = 'inferred'""", "relations")
def f12_relation_facets(spark, d):
    return S.facet(v.relations(spark, d), ["object"], "Part-11", predicate="calls", status="inferred").select("seq", "subject", "object")


@query(
    """SELECT 'error' AS level, 'unknown_order' AS rule, 'l' || l_orderkey || '-' || l_linenumber AS id FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P')
       UNION ALL SELECT 'error', 'unknown_supplier', 'l' || l_orderkey || '-' || l_linenumber FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)
       UNION ALL SELECT 'warning', 'unknown_part', 'l' || l_orderkey || '-' || l_linenumber FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 2)"""
)
def j19_missing_references(spark, d):
    rows = v.read(spark, d, "lineitem").selectExpr("concat('l', l_orderkey, '-', l_linenumber) id", "l_orderkey", "l_suppkey", "l_partkey")
    keys = [("l_orderkey", v.read(spark, d, "orders").filter("o_orderstatus <> 'P'"), "o_orderkey", "unknown_order", "error"), ("l_suppkey", v.read(spark, d, "supplier").filter("s_acctbal > 0"), "s_suppkey", "unknown_supplier", "error"), ("l_partkey", v.read(spark, d, "part").filter("p_size > 2"), "p_partkey", "unknown_part", "warning")]
    found = [V.missing(rows, *k) for k in keys]
    return found[0].unionByName(found[1]).unionByName(found[2])


@query(
    """WITH i AS (SELECT * FROM v_items WHERE contains(lower(concat_ws(' ', subject, predicate, object, source_text)), 'that') AND coalesce(status, '') <> 'rejected'),
       t AS (SELECT source_id, 'Conversation ' || max(conv_id) AS title FROM v_items WHERE conv_id % 5 > 0 GROUP BY 1), x AS (SELECT *, lower(source_text) AS low FROM i),
       r AS (SELECT id, unnest(CASE WHEN len(found) > 0 THEN found ELSE ['follow_guidance'] END) AS rule FROM (SELECT id, list_filter([CASE WHEN contains(low, 'approv') OR contains(low, 'authori') THEN 'approval_required' END,
             CASE WHEN contains(low, 'escalat') OR contains(low, 'route') THEN 'escalation' END, CASE WHEN contains(low, 'document') OR contains(low, 'record') THEN 'documentation' END], lambda y: y IS NOT NULL) AS found FROM x))
       SELECT i.id, 'concept-' || trim(regexp_replace(lower(trim(subject)), '[^a-z0-9]+', '-', 'g'), '-') AS concept_id, rule, title AS source_title, source_text FROM i JOIN r USING (id) LEFT JOIN t USING (source_id)""",
    "items",
)
def q2_agent_context_details(spark, d):
    i = v.items(spark, d)
    chosen = X.agent_context(i, ["that"]).filter("not excluded")
    titles = i.filter("conv_id % 5 > 0").select("source_id", F.concat(F.lit("Conversation "), "conv_id").alias("title"), "seq")
    return X.context_details(chosen, i, titles)


@query("""SELECT source_id, version, CASE WHEN source_id = 's7' AND status IN ('', 'active') THEN 'retired' ELSE status END AS status FROM (SELECT 's' || o_custkey AS source_id, o_orderkey AS version, CASE o_orderstatus WHEN 'F' THEN '' WHEN 'O' THEN 'active' ELSE 'superseded' END AS status FROM orders)""")
def m3_retired_versions(spark, d):
    return C.retire_versions(_versions(spark, d), "s7")


def _versions(spark, d):
    return v.read(spark, d, "orders").selectExpr("concat('s', o_custkey) source_id", "o_orderkey version", "case o_orderstatus when 'F' then '' when 'O' then 'active' else 'superseded' end status")


@query(
    """WITH n AS (SELECT (SELECT count(*) FROM orders WHERE o_custkey = 7 AND o_orderstatus IN ('F', 'O')) AS versions, (SELECT count(*) FROM v_claims WHERE source_id = 'source-7' AND coalesce(nullif(lifecycle_status, ''), 'active') = 'active') AS items)
       SELECT 's7' AS source_id, versions, items FROM n WHERE versions + items > 0""",
    "claims",
)
def m3_retirement_event(spark, d):
    claims = v.claims(spark, d).withColumn("source_id", F.regexp_replace("source_id", "^source-", "s"))
    return C.retirement_event(_versions(spark, d), claims, "s7")


@query(
    """WITH t AS (SELECT id FROM v_symbols WHERE kind = 'class' ORDER BY id LIMIT 3), e AS (SELECT r.* FROM v_relations r WHERE object IN (SELECT id FROM t)), s AS (SELECT DISTINCT id FROM e ORDER BY id LIMIT 10)
       SELECT 'relations' AS name, CAST(count(DISTINCT id) AS VARCHAR) AS value FROM e UNION ALL SELECT 'first_symbol', min(id) FROM t UNION ALL SELECT 'exact_shown', CAST(count(DISTINCT id) AS VARCHAR) FROM e WHERE status = 'exact' AND id IN (SELECT id FROM s)
       UNION ALL SELECT 'evidence', coalesce(array_to_string(list_sort(list(DISTINCT evidence))[1:5], ','), '') FROM e WHERE id IN (SELECT id FROM s)""",
    "symbols relations",
)
def q8_harness_summary(spark, d):
    top = v.symbols(spark, d).filter("kind = 'class'").select("id").orderBy("id").limit(3)
    r = v.relations(spark, d)
    edges = r.join(F.broadcast(top.select(F.col("id").alias("object"))), "object", "left_semi").select("id").distinct()
    row = lambda part, rank, i: F.struct(F.lit(part).alias("part"), rank.cast("int").alias("rank"), i.alias("id"))
    context = top.agg(F.min("id").alias("id")).select(row("symbol", F.lit(1), F.col("id")).alias("r")).unionByName(edges.orderBy("id").limit(10).select(row("relation", F.lit(0), F.col("id")).alias("r"))).unionByName(edges.agg(F.count("*").alias("n")).select(row("count", F.col("n"), F.lit("relations")).alias("r")))
    return X.harness_summary(context.select("r.*"), r)
