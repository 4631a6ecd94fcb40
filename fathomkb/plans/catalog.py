"""The registered queries over the driver's tables, each beside its equivalent DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from fathomkb.functions import scalars as fn
from fathomkb.operators import claims as C
from fathomkb.operators import context as X
from fathomkb.operators import extract as E
from fathomkb.operators import relations as R
from fathomkb.operators import report as P
from fathomkb.operators import search as S
from fathomkb.operators import validate as V
from fathomkb.sources import files as files_
from fathomkb.plans.registry import ORACLES, QUERIES, query
from fathomkb.sources import views as v

#: Terms that the driver's texts contain, for the term-driven operators.
TERMS = ["that", "with", "para", "les"]
SCENARIO = "user 7 and assistant 12 that with the thand erer onre para los est"

SENTENCES = r"s AS (SELECT doc_id, generate_subscripts(m, 1) - 1 AS pos, trim(regexp_replace(unnest(m), '\s+', ' ', 'g')) AS sentence FROM (SELECT doc_id, regexp_extract_all(text, '[^.!?\n]+[.!?]') AS m FROM documents))"


# 2.1 sources


@query(
    r"""SELECT id, path, language, checksum, n_chars, CASE lower(regexp_extract(path || CASE language WHEN 'en' THEN '.MD' WHEN 'de' THEN '.txt' WHEN 'fr' THEN '.png' ELSE '.pdf' END, '\.([^./]+)$', 1))
        WHEN 'md' THEN 'markdown' WHEN 'txt' THEN 'text' WHEN 'pdf' THEN 'pdf' WHEN 'docx' THEN 'docx' END AS type FROM v_sources""",
    "sources",
)
def s4_source_inventory(spark, d):
    suffix = F.when(F.col("language") == "en", ".MD").when(F.col("language") == "de", ".txt").when(F.col("language") == "fr", ".png").otherwise(".pdf")
    return v.sources(spark, d).select("id", "path", "language", "checksum", "n_chars", files_.source_type(F.concat("path", suffix)).alias("type"))


@query(
    """WITH r AS (SELECT doc_id, lang, source, sha256(text) AS checksum FROM documents),
       n AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS version, row_number() OVER (PARTITION BY source, checksum ORDER BY doc_id) > 1 AS unchanged, lead(source) OVER (PARTITION BY source ORDER BY doc_id) IS NULL AS latest FROM r)
       SELECT doc_id, source, CAST(version AS BIGINT) AS version, unchanged, latest FROM n"""
)
def s2_source_versions(spark, d):
    rows = v.read(spark, d, "documents").select("doc_id", "source", F.sha2("text", 256).alias("checksum"))
    return C.version_chain(rows, "source", ["doc_id"], "checksum").select("doc_id", "source", F.col("version").cast("long").alias("version"), "unchanged", "latest")


@query(
    """WITH f AS (SELECT 'd' || (doc_id % 500) AS id, source || '-' || (doc_id % 300) || CASE lang WHEN 'fr' THEN '.png' ELSE '.md' END AS filename, sha256(text) AS checksum, doc_id % 2 = 0 AS old FROM documents),
       a AS (SELECT id, list(DISTINCT checksum) AS a FROM f WHERE old GROUP BY 1), b AS (SELECT filename, list(DISTINCT checksum) AS b FROM f WHERE old GROUP BY 1)
       SELECT f.id, f.filename, CASE WHEN NOT regexp_matches(lower(f.filename), '\\.(md|txt|pdf|docx)$') THEN 'unsupported' WHEN coalesce(a, b) IS NULL THEN 'new_source' WHEN list_contains(coalesce(a, b), f.checksum) THEN 'unchanged_version' ELSE 'new_version' END AS "update"
       FROM f LEFT JOIN a ON a.id = f.id LEFT JOIN b ON b.filename = f.filename WHERE NOT f.old""".replace("\\\\", "\\")
)
def s3_update_preview(spark, d):
    f = v.read(spark, d, "documents").select(
        F.concat(F.lit("d"), F.col("doc_id") % 500).alias("id"), F.concat("source", F.lit("-"), F.col("doc_id") % 300, F.when(F.col("lang") == "fr", ".png").otherwise(".md")).alias("filename"), F.sha2("text", 256).alias("checksum"), (F.col("doc_id") % 2 == 0).alias("old")
    )
    return C.update_preview(f.filter("not old").drop("old"), f.filter("old").drop("old"))


@query("SELECT doc_id, length(trim(replace(text, chr(13), ''), E' \\n\\t')) + 1 AS n FROM documents")
def s9_normalized_length(spark, d):
    return v.read(spark, d, "documents").select("doc_id", F.length(files_.normalize_markdown(F.col("text"))).cast("long").alias("n"))


@query(
    """WITH l AS (SELECT source, doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(trim(x), '[0-9]+', '#', 'g')), lambda x: x <> '') AS ls FROM documents),
       t AS (SELECT source, count(*) AS total FROM documents GROUP BY 1 HAVING count(*) >= 4),
       k AS (SELECT DISTINCT source, doc_id, unnest(list_concat(ls[1:5], ls[greatest(len(ls) - 4, 1):len(ls)])) AS key FROM l)
       SELECT source AS "group", key, count(*) AS pages FROM k JOIN t USING (source) GROUP BY source, key, total HAVING count(*) >= 0.03 * total"""
)
def s12_repeated_lines(spark, d):
    return E.repeated_lines(v.read(spark, d, "documents"), "source", share=0.03)


@query(
    """WITH n AS (SELECT seq, id, 'source' AS type, path AS label FROM v_sources UNION ALL SELECT seq, id, 'item', subject FROM v_items
         UNION ALL SELECT seq, 'concept-' || trim(regexp_replace(lower(trim(subject)), '[^a-z0-9]+', '-', 'g'), '-'), 'concept', subject FROM v_items)
       SELECT id, min(seq) AS position, max_by(type, seq) AS type, max_by(label, seq) AS label FROM n GROUP BY id""",
    "sources items",
)
def s16_graph_nodes(spark, d):
    return files_.graph(v.sources(spark, d), v.items(spark, d))[0]


@query(
    """WITH e AS (SELECT seq, source_id AS source, id AS target, 'contains' AS type FROM v_items UNION ALL SELECT seq, id, 'concept-' || trim(regexp_replace(lower(trim(subject)), '[^a-z0-9]+', '-', 'g'), '-'), 'about' FROM v_items)
       SELECT source, target, type, min(seq) AS position FROM e GROUP BY 1, 2, 3""",
    "items",
)
def s16_graph_edges(spark, d):
    return files_.graph(v.sources(spark, d), v.items(spark, d))[1]


@query("""SELECT DISTINCT '<urn:kb:' || subject || '> <urn:kb:' || predicate || '> <urn:kb:' || object || '> .' AS statement FROM v_relations""", "relations")
def s17_rdf_statements(spark, d):
    return files_.triples(v.relations(spark, d))


# 2.2, 2.3 projections and filters


@query("""SELECT id, path, language, checksum FROM v_sources WHERE contains(regexp_replace(lower(id || ' ' || path || ' ' || language), '[./_\\-]+', '-', 'g'), 'src1-1') AND language = 'en'""".replace("\\\\", "\\"), "sources")
def f1_files_search(spark, d):
    return S.files_search(v.sources(spark, d), "src1/1", "en")


@query("""SELECT seq, id, subject, predicate, object, status, confidence FROM v_relations WHERE contains(lower(subject), 'supplier-1') AND predicate = 'calls' AND contains(lower(object), 'part-12') AND status = 'inferred'""", "relations")
def f3_relations_search(spark, d):
    return S.relations_search(v.relations(spark, d), "supplier_1", "CALLS", "part.12", "inferred")


@query(
    """SELECT s.id, s.kind, s.qualified_name, (SELECT count(*) FROM v_relations r WHERE contains(r.subject, s.id) OR contains(r.object, s.id)) AS n_relations, (SELECT count(*) FROM v_claim_symbols c WHERE c.symbol_id = s.id) AS n_claims FROM v_symbols s WHERE s.id = 'symbol-part-17'""",
    "symbols relations claim_symbols",
)
def f4_symbol_get(spark, d):
    one = v.symbols(spark, d).filter("id = 'symbol-part-17'")
    hit = v.relations(spark, d).agg(F.count_if(F.contains("subject", F.lit("symbol-part-17")) | F.contains("object", F.lit("symbol-part-17"))).alias("n_relations"))
    about = v.claim_symbols(spark, d).agg(F.count_if(F.col("symbol_id") == "symbol-part-17").alias("n_claims"))
    return one.select("id", "kind", "qualified_name").crossJoin(F.broadcast(hit)).crossJoin(F.broadcast(about))  # one row each


@query(f"""WITH {SENTENCES} SELECT doc_id || '-' || pos AS id, sentence AS evidence FROM s WHERE contains(lower(sentence), 'that') AND contains(lower(sentence), 'with')""")
def f6_knowledge_search(spark, d):
    s = E.sentences(v.read(spark, d, "documents"))
    low = F.lower("sentence")
    return s.filter(F.contains(low, F.lit("that")) & F.contains(low, F.lit("with"))).select(F.concat_ws("-", F.col("doc_id").cast("string"), F.col("pos").cast("string")).alias("id"), F.col("sentence").alias("evidence"))


@query("""SELECT id, subject, predicate, object, source_text AS evidence FROM v_items WHERE contains(lower(concat_ws(' ', subject, predicate, object, source_text)), 'user') AND contains(lower(concat_ws(' ', subject, predicate, object, source_text)), 'should')""", "items")
def f6_item_search(spark, d):
    return S.knowledge_search(v.items(spark, d), "User should")


@query("""SELECT id, status FROM v_items WHERE contains(lower(concat_ws(' ', subject, predicate, object, source_text)), 'that') OR contains(lower(concat_ws(' ', subject, predicate, object, source_text)), 'para')""", "items")
def f7_any_term(spark, d):
    return S.any_term(v.items(spark, d), ["that", "para"]).select("id", "status")


@query(
    """SELECT id, tier FROM v_claims WHERE coalesce(review_status, '') <> 'rejected' AND coalesce(nullif(lifecycle_status, ''), 'active') = 'active' AND (NOT (tier >= 4 AND review_required) OR coalesce(review_status, '') = 'approved')""",
    "claims",
)
def f8_usable_claims(spark, d):
    return v.claims(spark, d).filter(S.usable()).select("id", "tier")


@query("""SELECT id, subject, status FROM v_items WHERE coalesce(status, '') <> 'rejected'""", "items")
def f9_without_rejected(spark, d):
    return S.without_rejected(v.items(spark, d)).select("id", "subject", "status")


@query(
    """SELECT 'retired' AS pool, count(*) FILTER (lifecycle_status IN ('retired', 'superseded')) AS claims FROM v_claims
       UNION ALL SELECT 'review_required', count(*) FILTER (coalesce(nullif(lifecycle_status, ''), 'active') = 'active' AND review_required) FROM v_claims
       UNION ALL SELECT 'proposed', count(*) FILTER (coalesce(review_status, 'proposed') = 'proposed') FROM v_claims
       UNION ALL SELECT 'approved', count(*) FILTER (review_status = 'approved') FROM v_claims UNION ALL SELECT 'active', count(*) FILTER (coalesce(nullif(lifecycle_status, ''), 'active') = 'active') FROM v_claims""",
    "claims",
)
def f11_claim_pools(spark, d):
    return S.pool_sizes(v.claims(spark, d))


@query("""SELECT id, claim, confidence FROM v_claims WHERE coalesce(nullif(lifecycle_status, ''), 'active') = 'active' AND review_required AND tier = 2 AND contains(lower(claim), 'urgent') ORDER BY confidence DESC, id""", "claims")
def f11_claim_review(spark, d):
    return S.claim_pool(v.claims(spark, d), tier=2, text="URGENT").select("id", "claim", "confidence")


@query("""SELECT id, qualified_name FROM v_symbols WHERE (contains(lower(qualified_name), 'ring') OR contains(lower(id), 'ring')) AND kind = 'class'""", "symbols")
def f12_symbol_facets(spark, d):
    return S.facet(v.symbols(spark, d), ["qualified_name", "id"], "ring", kind="class").select("id", "qualified_name")


@query(f"""WITH {SENTENCES} SELECT doc_id, count(*) AS n_sentences, min(pos) AS first_pos FROM s WHERE sentence <> '' AND ({' OR '.join(f"contains(lower(sentence), '{t}')" for t in TERMS)}) GROUP BY 1""")
def f14_term_sentences(spark, d):
    return E.sentences(v.read(spark, d, "documents"), TERMS).groupBy("doc_id").agg(F.count("*").alias("n_sentences"), F.min("pos").cast("long").alias("first_pos"))


@query("""SELECT seq, id, kind FROM v_symbols WHERE kind IN ('record', 'data_item', 'data', 'file')""", "symbols")
def f18_state_contracts(spark, d):
    return v.symbols(spark, d).filter(F.col("kind").isin(P.STATE_KINDS)).select("seq", "id", "kind").orderBy("id")


@query(
    """SELECT id, 'kr-' || id AS relation_id, trim(regexp_replace(lower(trim(subject)), '[^a-z0-9]+', '-', 'g'), '-') AS subject_id,
       CASE WHEN len(string_split(source_text, ' ')) <= 9 THEN source_text ELSE rtrim(array_to_string(string_split(source_text, ' ')[1:9], ' '), '.,;:') END AS label FROM v_items""",
    "items",
)
def p5_item_relations(spark, d):
    words = F.split("source_text", " ")
    label = F.when(F.size(words) <= 9, F.col("source_text")).otherwise(F.regexp_replace(F.array_join(F.slice(words, 1, 9), " "), "[.,;:]+$", ""))
    return v.items(spark, d).select("id", F.concat(F.lit("kr-"), "id").alias("relation_id"), fn.slugify(F.col("subject")).alias("subject_id"), label.alias("label"))


# 2.4 joins


@query(
    """WITH e AS (SELECT subject AS id, 1 AS o, 0 AS i FROM v_relations UNION ALL SELECT object, 0, 1 FROM v_relations), n AS (SELECT id, sum(o) AS o, sum(i) AS i FROM e GROUP BY 1)
       SELECT s.id, CAST(coalesce(o, 0) AS BIGINT) AS out_degree, CAST(coalesce(i, 0) AS BIGINT) AS in_degree, CAST(coalesce(o, 0) + coalesce(i, 0) AS BIGINT) AS degree FROM v_symbols s LEFT JOIN n USING (id)""",
    "symbols relations",
)
def j2_degrees(spark, d):
    return R.degrees(v.symbols(spark, d), v.relations(spark, d))


@query(
    """SELECT c.id, coalesce(o.decision, c.review_status) AS review_status FROM v_claims c LEFT JOIN (SELECT claim_id, max(decision) AS decision FROM v_decisions GROUP BY 1) o ON o.claim_id = c.id""",
    "claims decisions",
)
def j3_review_overlay(spark, d):
    return C.overlay(v.claims(spark, d), v.decisions(spark, d)).select("id", "review_status")


@query("""SELECT DISTINCT r.object AS symbol_id, r.subject AS test_id FROM v_relations r JOIN v_symbols s ON s.id = r.object WHERE predicate = 'covers'""", "relations symbols")
def j4_coverage_pairs(spark, d):
    return R.coverage(v.relations(spark, d)).join(v.symbols(spark, d).select(F.col("id").alias("symbol_id")), "symbol_id", "left_semi")


@query("""SELECT seq, subject, predicate, object, status FROM v_relations WHERE subject IN (SELECT id FROM v_symbols WHERE kind = 'test') OR object IN (SELECT id FROM v_symbols WHERE kind = 'test')""", "relations symbols")
def j5_incident_relations(spark, d):
    return R.incident(v.relations(spark, d), v.symbols(spark, d).filter("kind = 'test'")).select("seq", "subject", "predicate", "object", "status")


@query("""SELECT id, tier FROM v_claims WHERE id IN (SELECT claim_id FROM v_claim_symbols JOIN v_symbols s ON s.id = symbol_id WHERE s.kind = 'class' AND s.line < 10)""", "claims claim_symbols symbols")
def j6_claims_for_symbols(spark, d):
    return C.for_symbols(v.claims(spark, d), v.claim_symbols(spark, d), v.symbols(spark, d).filter("kind = 'class' and line < 10")).select("id", "tier")


@query(
    """WITH m AS (SELECT DISTINCT module FROM v_symbols), p AS (SELECT module, string_split(module, '.') AS s FROM m),
       t AS (SELECT module, array_to_string(s[k:len(s)], '.') AS ref, k = 1 AS whole FROM (SELECT module, s, unnest(range(1, len(s) + 1)) AS k FROM p)),
       o AS (SELECT ref, max(CASE WHEN whole THEN module END) AS exact, count(*) AS n, min(module) AS single FROM t GROUP BY 1),
       q AS (SELECT DISTINCT lower(replace(p_brand, '#', '_')) || '.' || lower(p_type) AS ref FROM part UNION SELECT DISTINCT lower(p_type) FROM part UNION SELECT 'shop.none')
       SELECT q.ref, coalesce(exact, CASE WHEN n = 1 THEN single END) AS module FROM q LEFT JOIN o USING (ref)""",
    "symbols",
)
def j9_import_resolution(spark, d):
    p = v.read(spark, d, "part")
    refs = p.select(F.concat(F.lower(F.replace("p_brand", F.lit("#"), F.lit("_"))), F.lit("."), F.lower("p_type")).alias("ref")).union(p.select(F.lower("p_type"))).union(spark.createDataFrame([("shop.none",)], "ref string"))
    return R.resolve_suffix(refs, v.symbols(spark, d))


@query("""SELECT i.id, i.source_id, (SELECT max(turn) FROM conversations c WHERE c.conv_id = i.conv_id) AS last_turn FROM v_items i""", "items")
def j12_item_enrichment(spark, d):
    turns = v.read(spark, d, "conversations").select("conv_id", "turn", F.col("turn").alias("last_turn"))
    return C.enrich(v.items(spark, d).drop("turn"), turns, "conv_id", ["last_turn"], "turn").select("id", "source_id", "last_turn")


@query(
    """WITH t AS (SELECT lower(replace(s_name, 'Supplier#', '')) AS name, CASE WHEN s_nationkey < 12 THEN 'type' ELSE 'operation' END AS kind, 's' || s_suppkey AS id, s_suppkey AS seq FROM supplier),
       k AS (SELECT name, kind, max_by(id, seq) AS target_id FROM t GROUP BY 1, 2)
       SELECT 'c' || c_custkey AS id, target_id, CASE WHEN target_id IS NULL THEN 'missing' ELSE 'preserved' END AS disposition FROM customer c LEFT JOIN k ON k.name = lower(replace(c_name, 'Customer#', '')) AND k.kind = CASE WHEN c_nationkey < 12 THEN 'type' ELSE 'operation' END"""
)
def j17_cross_trace(spark, d):
    kind = lambda n: F.when(F.col(n) < 12, "type").otherwise("operation").alias("kind")
    src = v.read(spark, d, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("id"), fn.normalize_name(F.replace("c_name", F.lit("Customer#"))).alias("name"), kind("c_nationkey"))
    tgt = v.read(spark, d, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("id"), F.col("s_suppkey").alias("seq"), fn.normalize_name(F.replace("s_name", F.lit("Supplier#"))).alias("name"), kind("s_nationkey"))
    return V.trace(src, tgt)


@query(
    """SELECT id, 'only_first' AS side FROM (SELECT DISTINCT object AS id FROM v_relations WHERE starts_with(object, 'symbol-part-') EXCEPT SELECT id FROM v_symbols WHERE kind <> 'test')
       UNION ALL SELECT id, 'only_second' FROM (SELECT id FROM v_symbols WHERE kind <> 'test' EXCEPT SELECT DISTINCT object FROM v_relations WHERE starts_with(object, 'symbol-part-'))""",
    "relations symbols",
)
def u6_id_sets(spark, d):
    used = v.relations(spark, d).filter(F.col("object").startswith("symbol-part-")).select(F.col("object").alias("id"))
    return V.id_sets(used, v.symbols(spark, d).filter("kind <> 'test'"))


@query(
    """WITH s AS (SELECT 'p' || o_orderkey AS id, 'shop/' || (o_custkey % 40) AS file FROM orders), e AS (SELECT DISTINCT 'p' || l_orderkey AS subject, 'p' || l_partkey AS object FROM lineitem WHERE l_returnflag = 'A' AND l_orderkey <> l_partkey)
       SELECT subject, count(*) AS callees FROM e JOIN s a ON a.id = e.subject JOIN s b ON b.id = e.object WHERE a.file = b.file GROUP BY 1 HAVING count(*) >= 1"""
)
def j22_call_clusters(spark, d):
    s = v.read(spark, d, "orders").select(F.concat(F.lit("p"), "o_orderkey").alias("id"), F.concat(F.lit("shop/"), F.col("o_custkey") % 40).alias("file"))
    e = v.read(spark, d, "lineitem").selectExpr("concat('p', l_orderkey) subject", "concat('p', l_partkey) object", "'calls' predicate", "if(l_returnflag = 'A', 'exact', 'inferred') status")
    return R.call_clusters(s, e, least=1)


@query(
    """SELECT s.id, coalesce(c.claim, s.title) AS label FROM v_symbols s LEFT JOIN (SELECT symbol_id, min_by(claim, tier * 1000000000000 + seq) AS claim FROM v_claim_symbols x JOIN v_claims y ON y.id = x.claim_id GROUP BY 1) c ON c.symbol_id = s.id""",
    "symbols claims claim_symbols",
)
def j27_primary_claim(spark, d):
    return C.primary(v.claims(spark, d), v.claim_symbols(spark, d), v.symbols(spark, d))


# 2.5 traversal

HOPS = """WITH e AS (SELECT DISTINCT id, subject, predicate, object FROM v_relations), n AS (SELECT subject AS a, object AS b FROM e UNION SELECT object, subject FROM e),
       h AS (SELECT '{node}' AS id, 0 AS l UNION SELECT n.b, h.l + 1 FROM h JOIN n ON n.a = h.id WHERE h.l < {rounds}), r AS (SELECT DISTINCT id FROM h)"""


@query(HOPS.format(node="nation-3", rounds=1) + " SELECT e.id, subject, predicate, object FROM e WHERE subject IN (SELECT id FROM r) OR object IN (SELECT id FROM r)", "relations")
def g1_neighbourhood(spark, d):
    return R.neighbourhood(v.relations(spark, d), "nation-3", 2).select("id", "subject", "predicate", "object")


@query(
    HOPS.format(node="symbol-part-5", rounds=1) + """, x AS (SELECT subject, object FROM e WHERE subject IN (SELECT id FROM r) OR object IN (SELECT id FROM r)),
       y AS (SELECT subject AS id FROM x UNION ALL SELECT object FROM x WHERE starts_with(object, 'symbol-')) SELECT id, count(*) AS n_relations FROM y WHERE id <> 'symbol-part-5' GROUP BY 1""",
    "relations",
)
def g2_change_impact(spark, d):
    return R.change_impact(v.relations(spark, d), "symbol-part-5")


@query(
    """WITH e AS (SELECT DISTINCT subject, object FROM v_relations WHERE predicate IN ('placed_by', 'located_in', 'part_of')), h AS (SELECT 'order-7' AS id, 0 AS level UNION SELECT e.object, h.level + 1 FROM h JOIN e ON e.subject = h.id WHERE h.level < 8)
       SELECT id, CAST(min(level) AS INTEGER) AS level FROM h WHERE id <> 'order-7' GROUP BY 1""",
    "relations",
)
def g4_reachable(spark, d):
    return R.reachable(v.relations(spark, d), "order-7", ["placed_by", "located_in", "part_of"])


@query(
    """WITH e AS (SELECT DISTINCT subject, object FROM v_relations WHERE predicate IN ('calls', 'located_in', 'part_of')), h AS (SELECT 'symbol-supplier-3' AS id, 0 AS level UNION SELECT e.object, h.level + 1 FROM h JOIN e ON e.subject = h.id WHERE h.level < 8)
       SELECT id, CAST(min(level) AS INTEGER) AS level FROM h WHERE id <> 'symbol-supplier-3' GROUP BY 1""",
    "relations",
)
def g4_reachable_levels(spark, d):
    return R.reachable_levels(v.relations(spark, d), "symbol-supplier-3", ["calls", "located_in", "part_of"])


@query(
    """WITH RECURSIVE b AS (SELECT 'c' || p_partkey AS name, CASE WHEN p_partkey % 10 = 0 THEN 'Base' ELSE 'c' || (p_partkey // 2) END AS base FROM part), g AS (SELECT name, 1 AS l FROM b WHERE base = 'Base' UNION SELECT b.name, g.l + 1 FROM g JOIN b ON b.base = g.name WHERE g.l < 12)
       SELECT DISTINCT name FROM g"""
)
def g5_class_membership(spark, d):
    b = v.read(spark, d, "part").selectExpr("concat('c', p_partkey) name", "if(p_partkey % 10 = 0, 'Base', concat('c', p_partkey div 2)) base")
    return R.fixpoint_members(b, ["Base"])


@query("""WITH k AS (SELECT string_split(qualified_name, '.') AS s FROM v_symbols), r AS (SELECT s[1] AS top, CASE WHEN len(s) >= 3 THEN s[1] || '.' || s[2] ELSE s[1] END AS package FROM k) SELECT top, package, count(*) AS n FROM r GROUP BY ROLLUP (top, package) HAVING top IS NOT NULL""", "symbols")
def g8_package_tree(spark, d):
    return R.package_tree(v.symbols(spark, d))


# 2.6 aggregations


@query(
    """SELECT 'sources' AS name, count(*) AS n FROM v_sources UNION ALL SELECT 'symbols', count(*) FROM v_symbols UNION ALL SELECT 'relations', count(*) FROM v_relations UNION ALL SELECT 'claims', count(*) FROM v_claims
       UNION ALL SELECT 'language:' || language, count(*) FROM v_sources GROUP BY language""",
    "sources symbols relations claims",
)
def a1_describe(spark, d):
    n = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
    src = v.sources(spark, d)
    out = n(src, "sources").union(n(v.symbols(spark, d), "symbols")).union(n(v.relations(spark, d), "relations")).union(n(v.claims(spark, d), "claims"))
    return out.union(src.groupBy(F.concat(F.lit("language:"), "language").alias("name")).agg(F.count("*").alias("n")))


@query("""SELECT 'predicate' AS key, predicate AS value, count(*) AS n FROM v_relations GROUP BY predicate UNION ALL SELECT 'status', status, count(*) FROM v_relations GROUP BY status""", "relations")
def a3_relation_summary(spark, d):
    return R.summary(v.relations(spark, d), "predicate", "status")


@query("""SELECT tier, count(*) AS claims, count(*) FILTER (review_required) AS review_required, count(*) FILTER (coalesce(nullif(lifecycle_status, ''), 'active') = 'active' AND (review_required OR tier = 4) AND review_status = 'proposed') AS pending FROM v_claims GROUP BY 1""", "claims")
def a4_claim_summary(spark, d):
    active = fn.nonempty(F.col("lifecycle_status"), "active") == "active"
    return v.claims(spark, d).groupBy("tier").agg(F.count("*").alias("claims"), F.count_if("review_required").alias("review_required"), F.count_if(active & (F.col("review_required") | (F.col("tier") == 4)) & (F.col("review_status") == "proposed")).alias("pending"))


@query("""SELECT coalesce(nullif(lifecycle_status, ''), 'active') AS status, count(*) AS n FROM v_claims GROUP BY 1""", "claims")
def a5_lifecycle_summary(spark, d):
    return C.lifecycle_counts(v.claims(spark, d))


@query("""SELECT coalesce(nullif(review_status, ''), 'unknown') AS value, count(*) AS n FROM v_claims GROUP BY 1""", "claims")
def a6_count_by(spark, d):
    return R.count_by(v.claims(spark, d), "review_status")


@query(
    """SELECT 'concept-' || trim(regexp_replace(lower(subject), '[^a-z0-9]+', '-', 'g'), '-') AS concept_id, min_by(subject, seq) AS label, count(*) AS item_count, count(*) FILTER (status = 'approved') AS approved, count(*) FILTER (status = 'proposed') AS proposed,
       count(*) FILTER (status = 'rejected') AS rejected, count(*) FILTER (status IS NULL) AS unknown FROM v_items GROUP BY 1""",
    "items",
)
def a8_concept_index(spark, d):
    return C.concept_index(v.items(spark, d))


TOKENS = "list_distinct(list_filter(regexp_extract_all(lower({x}), '[a-z][a-z0-9]+'), lambda w: length(w) > 2 AND NOT list_contains(" + str(fn.STOP_WORDS) + ", w)))"


#: Scores of items for SCENARIO and of their concepts, as the rules give them.
CONCEPTS = f"""w AS (SELECT {TOKENS.format(x=f"'{SCENARIO}'")} AS w), r AS (SELECT id, seq, 'concept-' || trim(regexp_replace(lower(trim(subject)), '[^a-z0-9]+', '-', 'g'), '-') AS concept_id, subject, CASE WHEN contains(lower('{SCENARIO}'), lower(subject)) THEN 8 ELSE 0 END
         + 3 * len(list_intersect({TOKENS.format(x="subject")}, w)) + least(6, len(list_intersect({TOKENS.format(x="concat_ws(' ', subject, predicate, object, source_text)")}, w))) AS score FROM v_items, w),
       f AS (SELECT concept_id, (SELECT arg_min(subject, seq) FROM r a WHERE a.concept_id = r.concept_id) AS label, sum(score)::DOUBLE AS score, count(*) AS item_count FROM r WHERE score > 0 GROUP BY 1 ORDER BY score DESC, label LIMIT 8)"""


@query(
    f"""WITH {CONCEPTS} SELECT * FROM f""",
    "items",
)
def a9_detect_concepts(spark, d):
    return S.detect_concepts(v.items(spark, d), SCENARIO)


@query("""SELECT source, count(*) FILTER (version = 1) AS first_versions, count(*) FILTER (unchanged) AS unchanged, CAST(max(version) AS BIGINT) AS versions FROM (SELECT source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS version, row_number() OVER (PARTITION BY source, text ORDER BY doc_id) > 1 AS unchanged FROM documents) GROUP BY 1""")
def a11_update_impact(spark, d):
    rows = v.read(spark, d, "documents").select("doc_id", "source", F.sha2("text", 256).alias("checksum"))
    return C.version_chain(rows, "source", ["doc_id"], "checksum").groupBy("source").agg(F.count_if(F.col("version") == 1).alias("first_versions"), F.count_if("unchanged").alias("unchanged"), F.max("version").cast("long").alias("versions"))


@query("""SELECT module, count(*) FILTER (kind = 'function') AS function, count(*) FILTER (kind = 'method') AS method, count(*) FILTER (kind = 'class') AS class, count(*) FILTER (kind = 'test') AS test, count(*) FILTER (kind = 'constant') AS constant, count(*) AS total FROM v_symbols GROUP BY 1""", "symbols")
def a15_symbol_inventory(spark, d):
    s = v.symbols(spark, d)
    kinds = ["function", "method", "class", "test", "constant"]
    return s.groupBy("module").pivot("kind", [*kinds, "record"]).count().na.fill(0).select("module", *kinds, sum((F.col(k) for k in [*kinds, "record"]), F.lit(0).cast("long")).alias("total"))


@query("""SELECT status, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM v_relations), 4)::DOUBLE AS percent FROM v_relations GROUP BY 1""", "relations")
def a16_resolution_report(spark, d):
    r = v.relations(spark, d).groupBy("status").agg(F.count("*").alias("n"))
    return r.crossJoin(F.broadcast(r.agg(F.sum("n").alias("all")))).select("status", "n", F.round(100.0 * F.col("n") / F.col("all"), 4).alias("percent"))  # one row


@query(
    """WITH c AS (SELECT DISTINCT object AS id FROM v_relations WHERE predicate = 'covers' AND status = 'exact'), s AS (SELECT module, c.id IS NOT NULL AS covered FROM v_symbols s LEFT JOIN c USING (id) WHERE kind IN ('function', 'method', 'class'))
       SELECT module, count(*) AS symbols, count(*) FILTER (covered) AS covered, round(100.0 * count(*) FILTER (covered) / count(*), 4)::DOUBLE AS percent FROM s GROUP BY 1""",
    "relations symbols",
)
def a17_test_coverage(spark, d):
    covered = R.coverage(v.relations(spark, d).filter("status = 'exact'")).select(F.col("symbol_id").alias("id"), F.lit(1).alias("c")).distinct()
    s = v.symbols(spark, d).filter(F.col("kind").isin("function", "method", "class")).join(covered, "id", "left")
    return s.groupBy("module").agg(F.count("*").alias("symbols"), F.count("c").alias("covered")).withColumn("percent", F.round(100.0 * F.col("covered") / F.col("symbols"), 4))


@query(
    """WITH x AS (SELECT DISTINCT object, subject FROM v_relations WHERE predicate IN ('calls', 'covers') AND starts_with(object, 'symbol-')), t AS (SELECT object, count(*) AS dependents FROM x GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 200)
       SELECT object, dependents, array_to_string(list_sort(list(subject))[1:25], ',') AS first_names FROM x JOIN t USING (object) GROUP BY 1, 2""",
    "relations",
)
def a18_impact_ranking(spark, d):
    return R.impact_ranking(v.relations(spark, d), ["calls", "covers"])


@query("""SELECT p_brand AS package, count(DISTINCT p_type) AS modules, array_to_string(list_sort(list(DISTINCT p_type)), ',') AS names FROM part GROUP BY 1""")
def a20_dependency_rollup(spark, d):
    return v.read(spark, d, "part").groupBy(F.col("p_brand").alias("package")).agg(F.count_distinct("p_type").alias("modules"), F.array_join(F.sort_array(F.collect_set("p_type")), ",").alias("names"))


@query(
    """WITH t AS (SELECT unnest(['that', 'para', 'les']) AS term) SELECT term, count(*) FILTER (contains(lower(concat_ws(' ', subject, predicate, object, source_text)), term)) AS n FROM v_items, t GROUP BY 1""",
    "items",
)
def a22_task_matches(spark, d):
    hay = F.lower(F.concat_ws(" ", "subject", "predicate", "object", "source_text"))
    return v.items(spark, d).agg(*(F.count_if(F.contains(hay, F.lit(t))).alias(t) for t in ("that", "para", "les"))).unpivot([], ["that", "para", "les"], "term", "n")


@query(
    """WITH p AS (SELECT *, row_number() OVER (PARTITION BY subject, predicate, object ORDER BY status <> 'exact', seq, evidence) AS rn FROM v_relations)
       SELECT subject, predicate, object, max(CASE WHEN rn = 1 THEN status END) AS status, max(CASE WHEN rn = 1 THEN confidence END) AS confidence, array_to_string(list_sort(list(DISTINCT evidence)), ',') AS evidence, min(seq) AS seq FROM p GROUP BY 1, 2, 3""",
    "relations",
)
def a24_merge_relations(spark, d):
    return R.merge_relations(v.relations(spark, d)).withColumn("evidence", F.array_join("evidence", ","))


@query("""SELECT user_id, min(event_id) AS position, max_by(event_type, event_id) AS event_type, max_by(value, event_id) AS value FROM events GROUP BY 1""")
def a26_payload_dedupe(spark, d):
    return C.payload_dedupe(v.read(spark, d, "events").withColumn("seq", F.col("event_id")), "user_id", ["event_type", "value"])


@query("""SELECT 'symbol-part-' || user_id AS symbol_id, max_by(event_id, epoch_us(ts)) AS entry_id FROM events WHERE 'symbol-part-' || user_id IN (SELECT id FROM v_symbols WHERE kind <> 'test') GROUP BY 1""", "symbols")
def a27_cache_prune(spark, d):
    e = v.read(spark, d, "events").select(F.concat(F.lit("symbol-part-"), "user_id").alias("symbol_id"), F.col("event_id").alias("entry_id"), F.col("ts").alias("stored_at"), F.col("event_id").alias("seq"))
    return C.cache_prune(e, v.symbols(spark, d).filter("kind <> 'test'").select(F.col("id").alias("symbol_id")))


# 2.7 ranking and windows


@query(
    """WITH s AS (SELECT id, qualified_name, kind, CAST(contains(h, 'red') AS INT) + CAST(contains(h, 'widget') AS INT) + CAST(contains(h, 'nowhere') AS INT) AS hits, 100 * (CAST(contains(q, 'red') AS INT) + CAST(contains(q, 'widget') AS INT) + CAST(contains(q, 'nowhere') AS INT)) AS strong
         FROM (SELECT *, lower(concat_ws(' ', replace(id, 'symbol-', ''), title, qualified_name, file, kind, docstring)) AS h, lower(qualified_name || ' ' || id) AS q FROM v_symbols))
       SELECT id, qualified_name, kind, strong + hits AS score FROM s WHERE hits > 0 AND (hits = 3 OR NOT EXISTS (SELECT 1 FROM s WHERE hits = 3))""",
    "symbols",
)
def w1_symbols_search(spark, d):
    return S.symbols_search(v.symbols(spark, d), "red widget nowhere")


@query(
    f"""SELECT id, len(list_intersect({TOKENS.format(x="concat_ws(' ', subject, predicate, object, source_text)")}, {TOKENS.format(x=f"'{SCENARIO}'")})) AS overlap FROM v_items WHERE overlap > 0 ORDER BY overlap DESC, id LIMIT 16""",
    "items",
)
def w2_overlap_ranking(spark, d):
    return S.overlap_ranking(v.items(spark, d), SCENARIO, 16)


@query("""SELECT user_id, event_type, event_id, before FROM (SELECT *, lag(round(value)) OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS before FROM events) WHERE before IS NOT NULL AND before IS DISTINCT FROM round(value)""")
def w3_conflicts(spark, d):
    e = v.read(spark, d, "events").withColumn("rounded", F.round("value"))
    return S.conflicts(e, ["user_id", "event_type"], "rounded", "event_id").select("user_id", "event_type", "event_id", "before")


@query("""SELECT seq, CASE WHEN n = 0 THEN title ELSE title || '-' || n END AS unique_id FROM (SELECT seq, title, row_number() OVER (PARTITION BY title ORDER BY seq) - 1 AS n FROM v_symbols)""", "symbols")
def w4_unique_ids(spark, d):
    return S.suffix_repeats(v.symbols(spark, d), "title").select("seq", "unique_id")


@query("""SELECT s.id, n AS relations FROM (SELECT subject AS id, count(*) AS n FROM v_relations GROUP BY 1 UNION ALL SELECT object, count(*) FROM v_relations WHERE object LIKE 'symbol-part-%' GROUP BY 1) s JOIN v_symbols y ON y.id = s.id WHERE y.kind IN ('function', 'method', 'class') AND n >= 2 ORDER BY n DESC, s.id LIMIT 250""", "symbols relations")
def w6_authoring_candidates(spark, d):
    return R.degrees(v.symbols(spark, d).filter(F.col("kind").isin("function", "method", "class")), v.relations(spark, d)).filter("degree >= 2").select("id", F.col("degree").alias("relations")).orderBy(F.desc("relations"), "id").limit(250)


@query("""SELECT id, qualified_name FROM v_symbols ORDER BY qualified_name, id LIMIT 50 OFFSET 100""", "symbols")
def w8_page(spark, d):
    return S.page(v.symbols(spark, d).select("id", "qualified_name"), ["qualified_name", "id"], 3, 50)


@query("""SELECT o_custkey, CAST(count(*) AS BIGINT) AS versions, count(DISTINCT o_orderstatus) AS states, max_by(o_orderkey, o_orderkey) AS latest FROM orders GROUP BY 1""")
def w10_latest_version(spark, d):
    return C.latest_versions(v.read(spark, d, "orders"), "o_custkey", "o_orderkey", "o_orderstatus").withColumnRenamed("checksums", "states")


@query("""SELECT event_id, user_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM events) WHERE k <= 25""")
def w11_transcript_cap(spark, d):
    return S.last_entries(v.read(spark, d, "events").withColumn("seq", F.col("event_id")), "user_id", 25).select("event_id", "user_id")


@query("""SELECT page_id, CAST(n AS INTEGER) AS n, CAST(h[2] AS INTEGER) AS level FROM (SELECT page_id, generate_subscripts(m, 1) AS n, unnest(m) AS h FROM (SELECT page_id, regexp_extract_all(html, '(?is)<h[1-6][^>]*>.*?</h[1-6]>') AS m FROM pages)) t""".replace("h[2]", "regexp_extract(h, '(?i)^<h([1-6])', 1)"))
def x12_page_headings(spark, d):
    return E.html_headings(v.read(spark, d, "pages")).select("page_id", "n", "level")


MARKDOWN = """p AS (SELECT page_id, title, page_id % 4 AS k FROM (SELECT page_id, trim(regexp_replace(regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1), '<[^>]*>|[#\\s]+', ' ', 'g')) AS title FROM pages)),
    m AS (SELECT page_id, CASE k WHEN 0 THEN 'plain ' || title WHEN 1 THEN 'before' || chr(10) || '# ' || title || chr(10) || 'text' || chr(10) || '### Scope of it' || chr(10) || 'more' WHEN 2 THEN '## Exceptions' || chr(10) || '#' || chr(10) || title ELSE '####### seven' || chr(10) || '#no space' || chr(10) || '# ' || title END AS text, title, k FROM p)"""


def _markdown(spark, d):
    title = F.trim(F.regexp_replace(F.regexp_extract("html", "(?is)<h1[^>]*>(.*?)</h1>", 1), r"<[^>]*>|[#\s]+", " "))
    p = v.read(spark, d, "pages").select("page_id", title.alias("title"))
    return p.selectExpr("page_id doc_id", """case page_id % 4 when 0 then concat('plain ', title) when 1 then concat('before\\n# ', title, '\\ntext\\n### Scope of it\\nmore') when 2 then concat('## Exceptions\\n#\\n', title) else concat('####### seven\\n#no space\\n# ', title) end text""")


@query(
    f"""WITH {MARKDOWN}, l AS (SELECT page_id, title, k, length(title) AS t, length(text) AS total FROM m)
       SELECT page_id AS doc_id, 1 AS n, 1 AS level, 'Document' AS heading, 0 AS start, total AS "end" FROM l WHERE k = 0
       UNION ALL SELECT page_id, 1, 1, title, 7, 7 + 2 + t + 1 + 5 FROM l WHERE k = 1 UNION ALL SELECT page_id, 2, 3, 'Scope of it', 7 + 2 + t + 1 + 5, total FROM l WHERE k = 1
       UNION ALL SELECT page_id, 1, 2, 'Exceptions', 0, 14 FROM l WHERE k = 2 UNION ALL SELECT page_id, 2, 1, title, 14, total FROM l WHERE k = 2
       UNION ALL SELECT page_id, 1, 1, title, 24, total FROM l WHERE k = 3"""
)
def x12_sections(spark, d):
    return E.sections(_markdown(spark, d)).select("doc_id", "n", "level", "heading", "start", "end")



@query(f"""WITH {SENTENCES}, q AS (SELECT * FROM s WHERE {' OR '.join(f"contains(lower(sentence), '{t}')" for t in TERMS)}) SELECT doc_id, 'ki-' || doc_id || '-' || lpad(CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS VARCHAR), 6, '0') AS id,
       CASE WHEN contains(lower(sentence), 'should') THEN 'should' WHEN contains(lower(sentence), 'route') THEN 'route' WHEN contains(lower(sentence), 'record') THEN 'record' ELSE 'requires' END AS predicate, sentence AS object, 0.82::DOUBLE AS confidence FROM q""")
def x13_mined_claims(spark, d):
    return E.mined_claims(v.read(spark, d, "documents"), TERMS)


@query("""WITH r AS (SELECT id, list_filter([CASE WHEN contains(lower(source_text), 'that') THEN 'a' END, CASE WHEN contains(lower(source_text), 'para') OR contains(lower(source_text), 'les') THEN 'b' END], lambda x: x IS NOT NULL) AS f FROM v_items)
       SELECT id, unnest(CASE WHEN len(f) > 0 THEN f ELSE ['follow_guidance'] END) AS rule FROM r""", "items")
def x16_decision_rules(spark, d):
    return E.decision_rules(v.items(spark, d), rules=[("a", ("that",)), ("b", ("para", "les"))])


# 2.8 set operations


@query(
    """SELECT 'symbol' AS kind, id, qualified_name AS title FROM v_symbols WHERE contains(lower(id || ' ' || qualified_name), 'user 1') UNION ALL SELECT 'claim', id, claim FROM v_claims WHERE contains(lower(claim), 'user 1')
       UNION ALL SELECT 'file', path, path FROM v_sources WHERE contains(lower(path), 'user 1') UNION ALL SELECT 'document', id, subject FROM v_items WHERE contains(lower(subject || ' ' || source_text), 'user 1')""",
    "symbols claims sources items",
)
def u8_global_search(spark, d):
    return S.global_search("user 1", v.symbols(spark, d), v.claims(spark, d), v.sources(spark, d), v.items(spark, d))


# 2.10 scalar functions

SCALARS_SQL = r"""WITH b AS (SELECT s.*, regexp_replace(regexp_replace(title, '[-_]', ' ', 'g'), '(\p{Lu})', ' \1', 'g') AS spaced FROM v_symbols s)
    SELECT id, trim(regexp_replace(lower(trim(docstring)), '[^a-z0-9]+', '-', 'g'), '-') AS slug, lower(trim(regexp_replace(spaced, '\s+', ' ', 'g'))) AS canonical, CASE WHEN kind IN ('function', 'method', 'test') THEN 'operation' WHEN kind IN ('class', 'record') THEN 'type' ELSE kind END AS canonical_kind,
    regexp_replace(lower(docstring), '[^\p{L}\p{N}]', '', 'g') AS name, array_to_string(string_split(qualified_name, '.')[1:2], '.') AS package, array_to_string(string_split(qualified_name, '.')[-2:], '.') AS short_q, '/' || file || '/' || title AS path,
    repeat('*', greatest(length(title) - 4, 0)) || CASE WHEN length(title) <= 4 THEN repeat('*', length(title)) ELSE right(title, 4) END AS masked, least(greatest(line / 10.0, 0), 1)::DOUBLE AS confidence FROM b"""


@query(SCALARS_SQL.replace("repeat('*', greatest(length(title) - 4, 0)) || CASE WHEN length(title) <= 4 THEN repeat('*', length(title)) ELSE right(title, 4) END", "CASE WHEN length(title) <= 4 THEN repeat('*', length(title)) ELSE repeat('*', length(title) - 4) || right(title, 4) END"), "symbols")
def c_scalar_functions(spark, d):
    return v.symbols(spark, d).select(
        "id", fn.slugify(F.col("docstring")).alias("slug"), fn.canonical_name(F.col("title")).alias("canonical"), fn.canonical_kind(F.col("kind")).alias("canonical_kind"), fn.normalize_name(F.col("docstring")).alias("name"), fn.package_key(F.col("qualified_name")).alias("package"),
        fn.short_q(F.col("qualified_name")).alias("short_q"), fn.join_path(F.col("file"), F.lit(""), F.col("title")).alias("path"), fn.mask(F.col("title")).alias("masked"), fn.clamp_confidence((F.col("line") / 10.0).cast("string")).alias("confidence"),
    )


@query("""SELECT id, CASE WHEN length('source-' || s) <= 24 THEN 'source-' || s ELSE rtrim(substr('source-' || s, 1, 11), '-') || '-' || substr(sha256(docstring), 1, 12) END AS bounded FROM (SELECT id, docstring, trim(regexp_replace(lower(trim(docstring)), '[^a-z0-9]+', '-', 'g'), '-') AS s FROM v_symbols)""", "symbols")
def c2_bounded_ids(spark, d):
    return v.symbols(spark, d).select("id", fn.bounded_id("source", F.col("docstring"), 24).alias("bounded"))


@query(f"""SELECT doc_id, CAST(len(t) AS BIGINT) AS n, array_to_string(list_sort(t)[1:5], ' ') AS first_tokens FROM (SELECT doc_id, {TOKENS.format(x="text")} AS t FROM documents)""")
def c8_tokens(spark, d):
    t = fn.meaningful_tokens(F.col("text"))
    return v.read(spark, d, "documents").select("doc_id", t.alias("t")).select("doc_id", F.size("t").cast("long").alias("n"), F.array_join(F.slice(F.sort_array("t"), 1, 5), " ").alias("first_tokens"))


# 2.11 lifecycle


@query(
    """WITH o AS (SELECT o_orderkey AS k, 'c' || o_orderkey AS id, 's' || (o_orderkey % 700) AS symbol_id, o_orderkey % 3 AS version, CASE WHEN o_orderkey % 11 = 0 THEN 'retired' ELSE '' END AS state FROM orders), cur AS (SELECT 's' || i AS symbol_id, i % 3 AS now FROM range(0, 600) t(i)),
       old AS (SELECT * FROM o WHERE k % 4 < 3), new AS (SELECT * FROM o WHERE k % 4 > 1)
       SELECT coalesce(n.id, p.id) AS id, coalesce(n.symbol_id, p.symbol_id) AS symbol_id, coalesce(n.version, p.version) AS version,
         CASE WHEN n.id IS NOT NULL THEN 'active' WHEN coalesce(nullif(p.state, ''), 'active') <> 'active' THEN p.state WHEN c.now IS NULL THEN 'retired' WHEN c.now <> coalesce(n.version, p.version) THEN 'superseded' ELSE 'retired' END AS lifecycle_status
       FROM old p FULL JOIN new n ON n.id = p.id LEFT JOIN cur c ON c.symbol_id = coalesce(n.symbol_id, p.symbol_id)"""
)
def m1_merge_code_claims(spark, d):
    o = v.read(spark, d, "orders").selectExpr("o_orderkey k", "concat('c', o_orderkey) id", "concat('s', o_orderkey % 700) symbol_id", "o_orderkey % 3 version", "if(o_orderkey % 11 = 0, 'retired', '') lifecycle_status")
    current = spark.range(600).selectExpr("concat('s', id) symbol_id", "id % 3 version")
    return C.merge_code(o.filter("k % 4 < 3"), o.filter("k % 4 > 1"), current)


@query(
    """WITH o AS (SELECT 'i' || o_orderkey AS id, 's' || o_custkey AS source_id, CASE o_orderstatus WHEN 'F' THEN 1 ELSE 2 END AS version, CASE WHEN o_orderkey % 9 = 0 THEN 'retired' END AS state, o_orderkey % 13 = 0 AS fresh FROM orders),
       n AS (SELECT id, source_id, 2 AS version FROM o WHERE fresh), b AS (SELECT source_id, array_to_string(list_sort(list(DISTINCT id)), ',') AS ids, max(version) AS nv FROM n GROUP BY 1)
       SELECT o.id, o.source_id, o.version, CASE WHEN nv IS NOT NULL AND coalesce(state, 'active') = 'active' THEN 'superseded' ELSE coalesce(state, 'active') END AS lifecycle_status, CASE WHEN nv IS NOT NULL AND coalesce(state, 'active') = 'active' THEN ids END AS superseded_by
       FROM o LEFT JOIN b USING (source_id) WHERE NOT fresh AND (nv IS NULL OR o.version <> nv) UNION ALL SELECT id, source_id, version, 'active', NULL FROM n"""
)
def m2_merge_items(spark, d):
    o = v.read(spark, d, "orders").selectExpr("concat('i', o_orderkey) id", "concat('s', o_custkey) source_id", "if(o_orderstatus = 'F', 1, 2) version", "if(o_orderkey % 9 = 0, 'retired', null) lifecycle_status", "o_orderkey % 13 = 0 fresh")
    return C.merge_items(o.filter("not fresh").drop("fresh"), o.filter("fresh").withColumn("version", F.lit(2)).drop("fresh"))


@query("""SELECT id, CASE WHEN source_id = 'source-7' AND coalesce(nullif(lifecycle_status, ''), 'active') = 'active' THEN 'retired' ELSE lifecycle_status END AS lifecycle_status FROM v_claims""", "claims")
def m3_retire_source(spark, d):
    return C.retire_source(v.claims(spark, d), "source-7").select("id", "lifecycle_status")


@query(
    """WITH e AS (SELECT item_id, min(seq) FILTER (action IN ('approved', 'rejected')) AS ended FROM v_review_events GROUP BY 1), l AS (SELECT r.* FROM v_review_events r JOIN e USING (item_id) WHERE ended IS NULL OR seq <= ended)
       SELECT item_id, coalesce(max_by(action, seq) FILTER (action IN ('approved', 'rejected', 'edited')), 'proposed') AS status, count(*) AS n_applied, max(seq) AS last_seq FROM l GROUP BY 1""",
    "review_events",
)
def m5_fold_reviews(spark, d):
    return C.fold_reviews(v.review_events(spark, d))


# 2.12 validation


@query(
    """WITH c AS (SELECT *, coalesce(nullif(lifecycle_status, ''), 'active') = 'active' AS act FROM v_claims), n AS (SELECT id FROM v_symbols WHERE kind <> 'constant')
       SELECT 'error' AS level, 'tier4_without_review' AS rule, id FROM c WHERE tier = 4 AND NOT review_required UNION ALL SELECT 'error', 'approved_unreviewed', id FROM c WHERE act AND tier >= 3 AND review_status = 'approved' AND NOT review_required
       UNION ALL SELECT 'warning', 'low_confidence', id FROM c WHERE confidence < 0.7 UNION ALL SELECT 'warning', 'no_status', id FROM c WHERE review_status IS NULL
       UNION ALL SELECT 'error', 'unknown_symbol', s.claim_id FROM v_claim_symbols s JOIN c ON c.id = s.claim_id AND c.act WHERE s.symbol_id NOT IN (SELECT id FROM n) UNION ALL SELECT 'warning', 'no_symbol', id FROM c WHERE act AND id NOT IN (SELECT claim_id FROM v_claim_symbols)""",
    "claims claim_symbols symbols",
)
def v4_validate_claims(spark, d):
    return V.claims(v.claims(spark, d), v.claim_symbols(spark, d), v.symbols(spark, d).filter("kind <> 'constant'"))


@query(
    """SELECT doc_id AS id, CASE WHEN strpos(text, claim) > 0 THEN 'exact' ELSE 'llm_claimed' END AS span_status, CASE WHEN strpos(text, claim) > 0 THEN 100 + strpos(text, claim) - 1 END AS start_pos, CASE WHEN strpos(text, claim) > 0 THEN 100 + strpos(text, claim) - 1 + length(claim) END AS end_pos
       FROM (SELECT doc_id, text, CASE WHEN doc_id % 3 = 0 THEN 'not in any text' ELSE substr(text, CAST(1 + n_chars // 2 AS BIGINT), 40) END AS claim FROM documents)"""
)
def v9_span_grounding(spark, d):
    c = v.read(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("section_text"), F.lit(100).alias("section_start"), F.when(F.col("doc_id") % 3 == 0, "not in any text").otherwise(F.expr("substring(text, cast(1 + n_chars div 2 as int), 40)")).alias("claim"))
    return E.grounded(c).select("id", "span_status", F.col("start_pos").cast("long").alias("start_pos"), F.col("end_pos").cast("long").alias("end_pos"))


# 2.13 composites


@query(
    """WITH s AS (SELECT id, qualified_name, CAST(contains(h, 'red') AS INT) + CAST(contains(h, 'widget') AS INT) AS hits, 100 * (CAST(contains(q, 'red') AS INT) + CAST(contains(q, 'widget') AS INT)) AS strong
         FROM (SELECT *, lower(concat_ws(' ', replace(id, 'symbol-', ''), title, qualified_name, file, kind, docstring)) AS h, lower(qualified_name || ' ' || id) AS q FROM v_symbols)),
       top AS (SELECT id, row_number() OVER (ORDER BY strong + hits DESC, qualified_name) AS rank FROM s WHERE hits > 0 AND (hits = 2 OR NOT EXISTS (SELECT 1 FROM s WHERE hits = 2)) ORDER BY 2 LIMIT 12),
       e AS (SELECT DISTINCT id, status FROM v_relations WHERE subject IN (SELECT id FROM top) OR object IN (SELECT id FROM top)), r AS (SELECT DISTINCT id FROM e),
       o AS (SELECT claim_id, max(decision) AS decision FROM v_decisions GROUP BY 1), k AS (SELECT c.id, tier, review_required, lifecycle_status, coalesce(decision, review_status, '') AS st FROM v_claims c LEFT JOIN o ON o.claim_id = c.id),
       c AS (SELECT id FROM k WHERE st <> 'rejected' AND coalesce(nullif(lifecycle_status, ''), 'active') = 'active' AND (NOT (tier >= 4 AND review_required) OR st = 'approved') AND id IN (SELECT claim_id FROM v_claim_symbols WHERE symbol_id IN (SELECT id FROM top))),
       t AS (SELECT DISTINCT subject AS id FROM v_relations WHERE predicate = 'covers' AND object IN (SELECT id FROM top)),
       x AS (SELECT 'symbol' AS part, rank, id FROM top UNION ALL SELECT 'relation', row_number() OVER (ORDER BY id), id FROM r UNION ALL SELECT 'claim', row_number() OVER (ORDER BY id), id FROM c UNION ALL SELECT 'test', row_number() OVER (ORDER BY id), id FROM t)
       SELECT part, CAST(rank AS INTEGER) AS rank, id FROM x WHERE part = 'symbol' OR rank <= 10 UNION ALL SELECT 'count', CAST(count(*) AS INTEGER), 'relations' FROM r UNION ALL SELECT 'count', CAST(count(*) AS INTEGER), 'claims' FROM c
       UNION ALL SELECT 'count', CAST(count(*) AS INTEGER), 'tests' FROM t UNION ALL SELECT 'count', CAST(count(DISTINCT id) AS INTEGER), 'not_exact' FROM e WHERE status <> 'exact'""",
    "symbols relations claims claim_symbols decisions",
)
def q1_code_context(spark, d):
    return X.code_context("red widget", v.symbols(spark, d), v.relations(spark, d), v.claims(spark, d), v.claim_symbols(spark, d), v.decisions(spark, d))


@query("""WITH h AS (SELECT *, contains(lower(concat_ws(' ', subject, predicate, object, source_text)), 'zzqx') AS hit FROM v_items) SELECT id, coalesce(status = 'rejected', false) AS excluded FROM h WHERE hit OR NOT EXISTS (SELECT 1 FROM h WHERE hit)""", "items")
def q2_agent_context(spark, d):
    return X.agent_context(v.items(spark, d), ["zzqx"])


@query(
    f"""WITH {CONCEPTS},
       o AS (SELECT id, len(list_intersect({TOKENS.format(x="concat_ws(' ', subject, predicate, object, source_text)")}, w)) AS overlap FROM v_items, w WHERE overlap > 0 ORDER BY overlap DESC, id LIMIT 16),
       m AS (SELECT i.id, i.seq, f.score, f.label, {' OR '.join(f"contains(lower(concat_ws(' ', i.subject, i.predicate, i.object, i.source_text)), '{t}')" for t in TERMS)} AS t, o.overlap
             FROM v_items i LEFT JOIN r ON r.id = i.id AND r.score > 0 LEFT JOIN f ON f.concept_id = r.concept_id LEFT JOIN o ON o.id = i.id),
       g AS (SELECT *, CASE WHEN score IS NOT NULL AND t THEN 1 WHEN t THEN 2 WHEN score IS NOT NULL THEN 3 WHEN overlap IS NOT NULL THEN 4 ELSE 5 END AS stage FROM m),
       k AS (SELECT id, seq FROM g WHERE stage = (SELECT min(stage) FROM g) ORDER BY CASE WHEN stage IN (1, 3) THEN -score WHEN stage = 4 THEN -overlap END, CASE WHEN stage IN (1, 3) THEN label WHEN stage = 4 THEN id END, seq LIMIT 16)
       SELECT 'item' AS part, CAST(row_number() OVER (ORDER BY seq) AS INTEGER) AS rank, id FROM k""",
    "items",
)
def q3_scenario_context(spark, d):
    return X.scenario_context(v.items(spark, d), SCENARIO, TERMS)


# further reads


@query("""SELECT id, title, kind, qualified_name, module, file, line, CASE WHEN docstring = '' THEN NULL ELSE docstring END AS docstring FROM v_symbols""", "symbols")
def p1_symbol_projection(spark, d):
    return v.symbols(spark, d).select("id", "title", "kind", "qualified_name", "module", "file", "line", F.nullif("docstring", F.lit("")).alias("docstring"))


@query("""SELECT c.id, tier, coalesce(review_status, 'proposed') AS review_status, array_to_string(list_sort(list(symbol_id) FILTER (symbol_id IS NOT NULL)), ',') AS symbols FROM v_claims c LEFT JOIN v_claim_symbols s ON s.claim_id = c.id GROUP BY 1, 2, 3""", "claims claim_symbols")
def p3_claim_projection(spark, d):
    s = v.claim_symbols(spark, d).groupBy(F.col("claim_id").alias("id")).agg(F.array_join(F.sort_array(F.collect_set("symbol_id")), ",").alias("symbols"))
    return v.claims(spark, d).join(s, "id", "left").select("id", "tier", F.coalesce("review_status", F.lit("proposed")).alias("review_status"), "symbols")


@query(
    """SELECT id, coalesce(status, 'proposed') AS status, coalesce(status IN ('approved', 'rejected'), false) = false AS mutable, CASE WHEN coalesce(status IN ('approved', 'rejected'), false) THEN 'approved,commented,deferred,rejected' ELSE 'approved,commented,deferred,edited,rejected' END AS actions FROM v_items""",
    "items",
)
def p8_review_detail(spark, d):
    return C.review_detail(v.items(spark, d))


@query("""SELECT id FROM v_relations WHERE contains(lower(subject), 'nation-1') OR contains(lower(object), 'nation-1') OR contains(lower(predicate), 'nation-1') OR contains(lower(id), 'nation-1') OR contains(lower(evidence), 'nation-1')""", "relations")
def g3_field_neighbourhood(spark, d):
    return S.facet(v.relations(spark, d), ["subject", "object", "predicate", "id", "evidence"], "Nation-1").select("id")


@query(
    """WITH g AS (SELECT subject, count(*) AS n FROM v_items GROUP BY 1), t AS (SELECT subject FROM g ORDER BY n DESC, subject DESC LIMIT 1), k AS (SELECT id, subject, row_number() OVER (ORDER BY seq) AS rn FROM v_items WHERE subject = (SELECT subject FROM t))
       SELECT id, subject AS concept, rn AS position FROM k WHERE rn <= 18""",
    "items",
)
def g6_focused_graph(spark, d):
    return C.focused_graph(v.items(spark, d))


@query("""SELECT lang AS value, 'language' AS key, count(*) AS n FROM documents GROUP BY 1 UNION ALL SELECT source, 'source', count(*) FROM documents GROUP BY 1""")
def a10_source_stats(spark, d):
    return R.summary(v.read(spark, d, "documents").select(F.col("lang").alias("language"), "source"), "language", "source")


@query("""SELECT coalesce(status, 'unknown') AS status, count(*) AS items, (SELECT count(*) FROM v_review_events) AS events FROM v_items GROUP BY 1""", "items review_events")
def a13_review_summary(spark, d):
    events = v.review_events(spark, d).agg(F.count("*").alias("events"))  # one row
    return v.items(spark, d).groupBy(F.coalesce("status", F.lit("unknown")).alias("status")).agg(F.count("*").alias("items")).crossJoin(F.broadcast(events))


@query("""SELECT tier, count(*) AS claims, min(id) AS first_id, round(avg(confidence), 6) AS confidence FROM v_claims WHERE review_required AND coalesce(nullif(lifecycle_status, ''), 'active') = 'active' GROUP BY 1""", "claims")
def a19_review_required(spark, d):
    return v.claims(spark, d).filter(S.CLAIM_POOLS["review_required"]).groupBy("tier").agg(F.count("*").alias("claims"), F.min("id").alias("first_id"), F.round(F.avg("confidence"), 6).alias("confidence"))


@query("""SELECT subject, count(*) AS n, array_to_string(list_sort(list(DISTINCT predicate)), ',') AS predicates FROM v_relations GROUP BY 1""", "relations")
def a23_relations_by_subject(spark, d):
    return v.relations(spark, d).groupBy("subject").agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_set("predicate")), ",").alias("predicates"))


@query("""SELECT 'order-' || l_orderkey AS id, min_by(l_returnflag, l_linenumber * 1000000 + l_partkey) AS first_flag, array_to_string(list_sort(list(DISTINCT 's' || l_suppkey)), ',') AS evidence FROM lineitem GROUP BY l_orderkey""")
def a25_merge_claims(spark, d):
    rows = v.read(spark, d, "lineitem").selectExpr("concat('order-', l_orderkey) id", "l_returnflag flag", "l_linenumber * 1000000L + l_partkey key", "_metadata.file_path", "_metadata.row_index", "concat('s', l_suppkey) ev")
    order = F.when(F.col("flag").isNotNull() & F.col("key").isNotNull(), F.struct("key", "file_path", "row_index"))  # of equal keys the row that is read first
    return rows.groupBy("id").agg(F.min_by("flag", order).alias("first_flag"), F.array_join(F.sort_array(F.collect_set("ev")), ",").alias("evidence"))


@query("""SELECT 'status' AS key, status AS value, count(*) AS n FROM v_relations GROUP BY 2 UNION ALL SELECT 'predicate', predicate, count(*) FROM v_relations GROUP BY 2 UNION ALL SELECT 'tier', CAST(tier AS VARCHAR), count(*) FROM v_claims WHERE coalesce(nullif(lifecycle_status, ''), 'active') = 'active' GROUP BY 2""", "relations claims")
def a29_overview(spark, d):
    return R.summary(v.relations(spark, d), "status", "predicate").unionByName(R.summary(v.claims(spark, d).filter(S.CLAIM_POOLS["active"]), "tier"))


@query("""SELECT id, confidence FROM v_claims WHERE coalesce(nullif(lifecycle_status, ''), 'active') = 'active' ORDER BY confidence, id LIMIT 100""", "claims")
def w9_review_sort(spark, d):
    return S.claim_pool(v.claims(spark, d), "active", sort="confidence_asc").select("id", "confidence").limit(100)


@query("""SELECT doc_id, md5(text) AS checksum, sha256(text) AS digest, length(text) AS code_points FROM documents""")
def c3_checksums(spark, d):
    return v.read(spark, d, "documents").select("doc_id", F.md5("text").alias("checksum"), F.sha2("text", 256).alias("digest"), F.length("text").alias("code_points"))


@query("""SELECT p.page_id, count(*) AS n, min(length(h)) AS shortest FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS h FROM pages) p GROUP BY 1""")
def page_links(spark, d):
    h = v.read(spark, d, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("h"))
    return h.groupBy("page_id").agg(F.count("*").alias("n"), F.min(F.length("h")).alias("shortest"))


from fathomkb.plans import bundle, code, review  # noqa: E402, F401  register their queries
