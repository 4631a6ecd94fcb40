"""Registered queries over code: names, imports, references, relations, classes, endpoints."""

from __future__ import annotations

from pyspark.sql import functions as F

from fathomkb.operators import architecture as A
from fathomkb.operators import extract as E
from fathomkb.operators import resolve as N
from fathomkb.plans.registry import query
from fathomkb.sources import views as v
from fathomkb.sources.shared import written

HEAD = "CASE WHEN contains({x}, '.') THEN regexp_replace({x}, '\\.[^.]*$', '') ELSE {x} END"
LAST = "string_split({x}, '.')[-1]"
SHARED = "len(list_filter(range(1, 9), lambda k: string_split({a}, '.')[1:k] = string_split({b}, '.')[1:k] AND len(string_split({a}, '.')) >= k AND len(string_split({b}, '.')) >= k))"


@query(
    """SELECT name, count(*) AS symbols, min(id) AS first_id FROM (SELECT title AS name, id FROM v_code_symbols UNION SELECT string_split(qualified_name, '.')[-1], id FROM v_code_symbols) GROUP BY 1""",
    "code_symbols",
)
def j8_short_names(spark, d):
    return N.short_names(v.code_symbols(spark, d)).groupBy("name").agg(F.count("*").alias("symbols"), F.min("id").alias("first_id"))


@query(
    """WITH s AS (SELECT o_orderkey AS seq, 'o' || o_orderkey AS id, o_custkey % 50 AS source_id, o_orderkey % 40 AS line_start, o_orderkey % 40 + o_custkey % 3 AS line_end FROM orders),
       f AS (SELECT source_id, line_start, line_end, min_by(id, seq) AS id FROM s GROUP BY 1, 2, 3)
       SELECT event_id AS node, id FROM events JOIN f ON source_id = user_id % 50 AND line_start = event_id % 40 AND line_end = event_id % 40 + user_id % 3"""
)
def j7_nodes_by_span(spark, d):
    s = v.read(spark, d, "orders").selectExpr("o_orderkey seq", "concat('o', o_orderkey) id", "o_custkey % 50 source_id", "o_orderkey % 40 line_start", "o_orderkey % 40 + o_custkey % 3 line_end")
    n = v.read(spark, d, "events").selectExpr("event_id node", "user_id % 50 source_id", "event_id % 40 line_start", "event_id % 40 + user_id % 3 line_end")
    return N.match_nodes(s, n)


@query("""SELECT qualified_name AS name, array_to_string(list(base ORDER BY pos), ',') AS bases FROM v_code_classes GROUP BY 1""", "code_symbols code_classes")
def j11_class_bases(spark, d):
    return N.class_bases(v.code_classes(spark, d)).select("name", F.array_join("bases", ",").alias("bases"))


IMPORTS = f"""i AS (SELECT module, name, CASE WHEN contains(name, '.') THEN {HEAD.format(x="name")} END AS trimmed FROM v_code_imports),
    m AS (SELECT DISTINCT module AS target FROM v_code_symbols),
    k AS (SELECT module, name, 1 AS phase, name AS ref FROM i UNION ALL SELECT module, name, 2, trimmed FROM i WHERE trimmed IS NOT NULL),
    x AS (SELECT k.*, target, target = ref AS exact, {SHARED.format(a="k.module", b="target")} AS shared FROM k JOIN m ON target = ref OR ends_with(target, '.' || ref)),
    y AS (SELECT *, max(CASE WHEN exact THEN 1 ELSE 0 END) OVER (PARTITION BY module, name, phase) AS any_exact FROM x),
    z AS (SELECT *, max(shared) OVER (PARTITION BY module, name, phase) AS best FROM y WHERE any_exact = 0 OR exact),
    p AS (SELECT module, name, phase, CASE WHEN count(*) = 1 THEN min(target) END AS target FROM z WHERE shared = best GROUP BY 1, 2, 3)"""


@query(f"""WITH {IMPORTS} SELECT i.module, i.name, coalesce(a.target, b.target) AS target FROM i LEFT JOIN p a ON a.module = i.module AND a.name = i.name AND a.phase = 1 LEFT JOIN p b ON b.module = i.module AND b.name = i.name AND b.phase = 2""", "code_symbols code_imports")
def j9_imports_with_ties(spark, d):
    return N.resolve_imports(v.code_imports(spark, d), v.code_symbols(spark, d))


ANCESTRY = f"""c AS (SELECT DISTINCT qualified_name AS q FROM v_code_classes), u AS (SELECT {LAST.format(x="q")} AS short, min(q) AS only, count(*) AS n FROM c GROUP BY 1),
    b AS (SELECT qualified_name AS class, pos, CASE WHEN l.q IS NOT NULL THEN l.q WHEN f.q IS NOT NULL THEN f.q WHEN u.n = 1 THEN u.only END AS ancestor FROM v_code_classes x
          LEFT JOIN c l ON l.q = {HEAD.format(x="qualified_name")} || '.' || base LEFT JOIN c f ON f.q = base LEFT JOIN u ON u.short = {LAST.format(x="base")}),
    e AS (SELECT * FROM b WHERE ancestor IS NOT NULL AND ancestor <> class),
    h AS (SELECT class, ancestor, [pos] AS path FROM e UNION ALL SELECT h.class, e.ancestor, list_append(h.path, e.pos) FROM h JOIN e ON e.class = h.ancestor WHERE len(h.path) < 16),
    a AS (SELECT class, ancestor, min(path) AS path FROM h WHERE ancestor <> class GROUP BY 1, 2)"""


@query(f"""WITH {ANCESTRY} SELECT class, ancestor, array_to_string(path, ',') AS path FROM a""", "code_symbols code_classes")
def j11_class_ancestry(spark, d):
    return N.ancestry(v.code_classes(spark, d)).select("class", "ancestor", F.array_join("path", ",").alias("path"))


REFS = f"""{ANCESTRY},
    r AS (SELECT r.subject, r.name, regexp_replace(r.name, '\\(\\)$', '') AS norm, s.module AS own, s.qualified_name AS own_name FROM v_code_refs r JOIN v_code_symbols s ON s.id = r.subject),
    n AS (SELECT *, {LAST.format(x="norm")} AS short, contains(norm, '.') AS dotted, CASE WHEN contains(norm, '.') THEN string_split(norm, '.')[1] END AS alias FROM r),
    q AS (SELECT qualified_name, max_by(id, seq) AS id FROM v_code_symbols GROUP BY 1),
    sh AS (SELECT title AS short, id, module, qualified_name FROM v_code_symbols UNION SELECT {LAST.format(x="qualified_name")}, id, module, qualified_name FROM v_code_symbols),
    im AS (SELECT n.subject, n.name, min_by(i.name, i.pos) AS imported FROM n JOIN v_code_imports i ON i.module = n.own AND (i.name = coalesce(alias, norm) OR {LAST.format(x="i.name")} = coalesce(alias, norm)) GROUP BY 1, 2),
    cand AS (SELECT n.*, im.imported, sh.id, sh.module, sh.qualified_name AS cq, {HEAD.format(x="sh.qualified_name")} AS owner, {HEAD.format(x="n.own_name")} AS mine, coalesce(alias IN ('self', 'cls'), false) AS own_class
             FROM n JOIN sh ON sh.short = n.short AND sh.id <> n.subject LEFT JOIN im ON im.subject = n.subject AND im.name = n.name),
    g AS (SELECT subject, name, count(*) AS n, min(id) AS one, count(*) FILTER (module = own) AS mn, min(id) FILTER (module = own) AS mone, count(*) FILTER (own_class AND owner = mine) AS cn, min(id) FILTER (own_class AND owner = mine) AS cone FROM cand GROUP BY 1, 2),
    ab AS (SELECT subject, name, a.path, count(*) AS n, min(id) AS one FROM cand JOIN a ON a.class = mine AND a.ancestor = owner WHERE own_class GROUP BY 1, 2, 3),
    up AS (SELECT subject, name, min_by(n, path) AS un, min_by(one, path) AS uone FROM ab GROUP BY 1, 2),
    w AS (SELECT subject, name, id, {SHARED.format(a="own", b="module")} AS shared FROM cand WHERE module = imported OR ends_with(module, '.' || imported) OR cq = imported OR ends_with(cq, '.' || imported)),
    wb AS (SELECT subject, name, CASE WHEN count(*) = 1 THEN min(id) END AS target FROM (SELECT *, max(shared) OVER (PARTITION BY subject, name) AS best FROM w) WHERE shared = best GROUP BY 1, 2),
    t AS (SELECT n.subject, n.name, coalesce(q1.id, q2.id, CASE WHEN NOT dotted THEN coalesce(CASE WHEN g.n = 1 THEN g.one END, CASE WHEN g.mn = 1 THEN g.mone END) END,
          CASE WHEN g.cn > 0 THEN CASE WHEN g.cn = 1 THEN g.cone END WHEN un IS NOT NULL THEN CASE WHEN un = 1 THEN uone END ELSE wb.target END) AS target
          FROM n LEFT JOIN q q1 ON q1.qualified_name = norm LEFT JOIN q q2 ON q2.qualified_name = own || '.' || norm LEFT JOIN g ON g.subject = n.subject AND g.name = n.name LEFT JOIN up ON up.subject = n.subject AND up.name = n.name LEFT JOIN wb ON wb.subject = n.subject AND wb.name = n.name)"""


#: Lines whose references are resolved at once.
AT_ONCE = 16_000_000


@query(f"WITH {REFS} SELECT subject, name, target FROM t", "code_symbols code_classes code_imports code_refs")
def j10_references(spark, d):
    s = written(v.code_symbols(spark, d), "symbols")
    parts = -(-v.read(spark, d, "lineitem").count() // AT_ONCE)
    return N.resolve_references(v.code_refs(spark, d, s), s, v.code_imports(spark, d, s), v.code_classes(spark, d, s), parts)


# Python sources that Spark writes from parts: a class of four methods and a test in each file

FILES = """f AS (SELECT seq, module || '.c' || seq AS pm, replace(module, '.', '/') || '/c' || seq || '.py' AS path, CASE WHEN seq = 0 THEN 'object' WHEN seq % 20 = 0 THEN 'Missing' ELSE 'C' || ((seq // 10) * 5) END AS base FROM v_code_symbols WHERE kind = 'class'),
    me AS (SELECT f.*, i, seq + i AS m, (seq + i) % 50 - (seq + i) % 5 AS t FROM f, range(1, 5) r(i))"""


def _files(spark, d):
    base = F.expr("case when seq = 0 then 'object' when seq % 20 = 0 then 'Missing' else concat('C', (seq div 10) * 5) end")
    body = F.expr("""array_join(transform(sequence(1, 4), i -> concat('    @cached\\n    def m', seq + i, '(self):\\n        return C', (seq + i) % 50 - (seq + i) % 5, '(os.getenv("K', (seq + i) % 7, '"), open("f", "w"))\\n')), '')""")
    test = F.expr("concat('def test_m', seq + 1, '():\\n    return C', seq, '()\\n')")
    c = v.code_symbols(spark, d).filter("kind = 'class'")
    return c.select(F.concat(F.replace("module", F.lit("."), F.lit("/")), F.lit("/c"), "seq", F.lit(".py")).alias("path"), F.concat(F.lit("import os\nclass C"), "seq", F.lit("("), base, F.lit("):\n"), body, test).alias("text"))


def _parsed(spark, d):
    """Parsed once and written, as name resolution reads it many times."""
    return written(E.python_symbols(_files(spark, d)).withColumn("id", F.concat(F.lit("symbol-"), "qualified_name")), "parsed")


def _named(parsed):
    """symbols, imports and classes of parsed files, as name resolution takes them."""
    symbols = parsed.filter("kind <> 'module'").select(F.col("line_start").alias("seq"), "id", "title", "qualified_name", "module", "kind")
    imports = parsed.filter("kind = 'module'").select("module", F.posexplode("imports").alias("pos", "name"))
    classes = parsed.filter("kind = 'class'").select("qualified_name", F.posexplode("bases").alias("pos", "base"))
    return symbols, imports, classes


@query(f"""WITH {FILES} SELECT path, pm AS qualified_name, 'module' AS kind, 1 AS line_start, 16 AS line_end FROM f UNION ALL SELECT path, pm || '.C' || seq, 'class', 2, 14 FROM f
    UNION ALL SELECT path, pm || '.C' || seq || '.m' || m, 'method', 3 * i + 1, 3 * i + 2 FROM me UNION ALL SELECT path, pm || '.test_m' || (seq + 1), 'test', 15, 16 FROM f""", "code_symbols")
def x2_python_symbols(spark, d):
    return E.python_symbols(_files(spark, d)).select("path", "qualified_name", "kind", "line_start", "line_end")


@query(f"""WITH {FILES} SELECT 'symbol-' || pm || '.C' || seq || '.m' || m AS id, '    def m' || m || '(self):' || chr(10) || '        return C' || t || '(os.getenv("K' || m % 7 || '"), open("f", "w"))' AS excerpt FROM me""", "code_symbols")
def x3_evidence_excerpts(spark, d):
    return E.excerpts(_parsed(spark, d).filter("kind = 'method'").select("id", "path", "line_start", "line_end"), _files(spark, d))


SEMANTIC = """q AS (SELECT seq, 'symbol-' || pm || '.C' || seq AS id FROM f),
    x AS (SELECT q.id AS subject, 'inherits_from' AS predicate, coalesce(b.id, base) AS object, b.id IS NOT NULL AS hit, 'external_symbol' AS other, 0.96 AS a, 0.5 AS z, 'python-ast' AS resolver FROM f JOIN q USING (seq) LEFT JOIN q b ON 'C' || b.seq = base AND b.seq <> f.seq
       UNION ALL SELECT q.id || '.m' || m, 'decorated_by', 'cached', false, 'decorator', 0.95, 0.55, 'python-ast' FROM me JOIN q USING (seq)
       UNION ALL SELECT q.id || '.m' || m, 'calls', b.id, true, 'callable', 0.94, 0.45, 'python-call-resolver' FROM me JOIN q USING (seq) JOIN q b ON b.seq = t
       UNION ALL SELECT q.id || '.m' || m, 'calls', n, false, 'callable', 0.94, 0.45, 'python-call-resolver' FROM me JOIN q USING (seq), (VALUES ('open'), ('os.getenv')) c(n)
       UNION ALL SELECT 'symbol-' || pm || '.test_m' || (seq + 1), 'calls', q.id, true, 'callable', 0.94, 0.45, 'python-call-resolver' FROM f JOIN q USING (seq)),
    s AS (SELECT subject, predicate, object, CASE WHEN hit THEN 'symbol' ELSE other END AS object_kind, CASE WHEN hit THEN 'exact' ELSE 'unresolved' END AS status, CAST(CASE WHEN hit THEN a ELSE z END AS DOUBLE) AS confidence, resolver FROM x
       UNION ALL SELECT q.id || '.m' || m, 'reads', 'env:K' || m % 7, 'environment_variable', 'exact', 0.98::DOUBLE, 'python-ast' FROM me JOIN q USING (seq)
       UNION ALL SELECT q.id || '.m' || m, 'writes', 'file-open:w', 'file_access', 'inferred', 0.72::DOUBLE, 'python-file-access-heuristic' FROM me JOIN q USING (seq)),
    cov AS (SELECT 'symbol-' || pm || '.test_m' || (seq + 1) AS test, q.id || '.m' || (seq + 1) AS target FROM f JOIN q USING (seq) UNION ALL SELECT 'symbol-' || pm || '.test_m' || (seq + 1), q.id FROM f JOIN q USING (seq)),
    c AS (SELECT test AS subject, 'covers' AS predicate, target AS object FROM cov UNION ALL SELECT target, 'tested_by', test FROM cov)"""


@query(f"WITH {FILES}, {SEMANTIC} SELECT * FROM s", "code_symbols")
def x4_semantic_relations(spark, d):
    parsed = _parsed(spark, d)
    return N.semantic_relations(parsed.filter("kind <> 'module'"), *_named(parsed))


@query(f"WITH {FILES}, {SEMANTIC} SELECT *, 'symbol' AS object_kind, 'inferred' AS status, 0.7::DOUBLE AS confidence, 'pytest-name-call-heuristic' AS resolver FROM c", "code_symbols")
def x5_inferred_coverage(spark, d):
    parsed = _parsed(spark, d)
    symbols, _, classes = _named(parsed)
    return N.inferred_coverage(parsed.filter("kind = 'test'").select("id", "title", "calls"), symbols, classes)


@query(
    f"""WITH {FILES}, {SEMANTIC}, y AS (SELECT predicate, status FROM s UNION ALL SELECT predicate, 'inferred' FROM c UNION ALL SELECT 'imports', 'unresolved' FROM f UNION ALL SELECT 'defines', 'exact' FROM f, range(6))
       SELECT predicate, status, count(*) AS n FROM y GROUP BY 1, 2""",
    "code_symbols",
)
def u2_united_relations(spark, d):
    parsed = _parsed(spark, d)
    symbols, imports, classes = _named(parsed)
    rows = N.united(N.module_relations(symbols, imports, parsed.filter("kind = 'module'")), N.semantic_relations(parsed.filter("kind <> 'module'"), symbols, imports, classes), N.inferred_coverage(parsed.filter("kind = 'test'").select("id", "title", "calls"), symbols, classes))
    return rows.groupBy("predicate", "status").agg(F.count("*").alias("n"))


@query(f"""WITH {FILES} SELECT pm AS id, 'module' AS type FROM f UNION ALL SELECT pm || '.C' || seq, 'class' FROM f UNION ALL SELECT pm || '.C' || seq || '.m' || m, 'method' FROM me UNION ALL SELECT pm || '.test_m' || (seq + 1), 'test' FROM f""", "code_symbols")
def u7_artifacts(spark, d):
    parsed = E.python_symbols(_files(spark, d))
    modules = parsed.filter("kind = 'module'").select(F.col("qualified_name").alias("id"), F.lit("module").alias("type"))
    return modules.unionByName(parsed.filter("kind <> 'module'").select(F.col("qualified_name").alias("id"), F.col("kind").alias("type")))


WEB = """from flask import Blueprint, Flask
bp = Blueprint('b§', __name__, url_prefix='/b§')
app = Flask(__name__)
@bp.route('/x/§', methods=['GET', 'POST'])
def view_§():
    pass
@app.route('/home')
def home():
    pass
app.add_url_rule('/rule§', view_func=home)
app.register_blueprint(bp, url_prefix='/api§')
@click.command()
def do_it():
    pass
@shared_task
def job_§():
    pass
@celery.task(name='named.§')
def other():
    pass
sub = parser.add_subparsers()
p = sub.add_parser('run§')
p.set_defaults(func=do_it)
urlpatterns = [path('d/§/', views.detail)]
@dataclass
class Item§(models.Base, Mixin):
    __tablename__ = 'items_§'
    id = Column(Integer, primary_key=True)
    owner = relationship('User')
    name: str = mapped_column(String)
    note: Optional[str] = None
    plain = 3
def main():
    pass
"""


def _web_files(spark, d):
    text = F.replace(F.lit(WEB), F.lit("§"), F.col("s_suppkey").cast("string"))
    return v.read(spark, d, "supplier").select(F.concat(F.lit("web/s"), "s_suppkey", F.lit(".py")).alias("path"), text.alias("text"))


@query(
    """SELECT 'web/s' || k || '.py' AS path, kind, verb, replace(name, '@', CAST(k AS VARCHAR)) AS name, replace(handler, '@', CAST(k AS VARCHAR)) AS handler FROM (SELECT s_suppkey AS k FROM supplier),
       (VALUES ('http', 'GET', '/api@/x/@', 'view_@'), ('http', 'POST', '/api@/x/@', 'view_@'), ('http', 'GET', '/home', 'home'), ('http', 'GET', '/rule@', 'home'), ('http', 'ANY', 'd/@/', 'views.detail'), ('cli', '', 'do-it', 'do_it'),
               ('cli', '', 'run@', 'do_it'), ('task', '', 'web.s@.job_@', 'job_@'), ('task', '', 'named.@', 'other'), ('script', '', 'web.s@', 'main')) e(kind, verb, name, handler)"""
)
def x7_entry_points(spark, d):
    return E.entry_points(_web_files(spark, d))


@query(
    """SELECT 'web/s' || s_suppkey || '.py' AS path, 'Item' || s_suppkey AS name, 'Base,Mixin' AS bases, 'dataclass' AS decorators, 'items_' || s_suppkey AS table_name,
       'id:Column:Integer,owner:relationship:User,name:mapped_column:String,note:annotated:Optional[str]' AS fields FROM supplier"""
)
def x8_data_models(spark, d):
    m = E.data_models(_web_files(spark, d))
    field = F.transform("fields", lambda f: F.concat_ws(":", f["name"], f["how"], f["type"]))
    return m.select("path", "name", F.array_join("bases", ",").alias("bases"), F.array_join("decorators", ",").alias("decorators"), "table_name", F.array_join(field, ",").alias("fields"))


# COBOL sources that Spark writes from suppliers

COBOL = """000100 IDENTIFICATION DIVISION.\\n000200 PROGRAM-ID. SUP-@.\\n000300* COPY NOT-THIS.\\nDATA DIVISION.\\nFD FILE-@.\\n01 REC-@.\\n   05 ITEM-@ PIC X.\\nCOPY BOOK-@.\\nPROCEDURE DIVISION.\\nMAIN SECTION.\\nPARA-@.\\n    PERFORM STEP-@.\\n    CALL 'SUP-#'.\\n    READ FILE-@.\\n    WRITE REC-@.\\n    GO TO PARA-@.\\n"""


def _cobol(spark, d):
    text = F.expr(f"replace(replace(\"{COBOL}\", '@', cast(s_suppkey as string)), '#', cast(s_suppkey + 1 as string))")
    return v.read(spark, d, "supplier").select(F.concat(F.lit("sup"), "s_suppkey", F.lit(".cbl")).alias("path"), text.alias("text"))


@query(
    """SELECT 'sup' || s_suppkey || '.cbl' AS path, line, kind, name || CASE WHEN name = 'MAIN' THEN '' ELSE CAST(s_suppkey AS VARCHAR) END AS name FROM supplier,
       (VALUES (2, 'program', 'SUP-'), (5, 'file', 'FILE-'), (6, 'record', 'REC-'), (7, 'data_item', 'ITEM-'), (8, 'copy', 'BOOK-'), (10, 'section', 'MAIN'), (11, 'paragraph', 'PARA-')) k(line, kind, name)"""
)
def x9_cobol_symbols(spark, d):
    return E.cobol_symbols(_cobol(spark, d))


@query(
    """SELECT 'sup' || s_suppkey || '.cbl' AS path, predicate, name || (s_suppkey + k) AS name FROM supplier,
       (VALUES ('performs', 'STEP-', 0), ('calls', 'SUP-', 1), ('reads', 'FILE-', 0), ('writes', 'REC-', 0), ('jumps_to', 'PARA-', 0)) f(predicate, name, k)"""
)
def x10_cobol_facts(spark, d):
    return E.cobol_facts(_cobol(spark, d))


@query(
    f"""WITH {FILES} SELECT 'python' AS language, kind, count(*) AS n FROM (SELECT 'class' AS kind FROM f UNION ALL SELECT 'method' FROM me UNION ALL SELECT 'test' FROM f UNION ALL SELECT 'module' FROM f) GROUP BY 2
       UNION ALL SELECT 'cobol', kind, (SELECT count(*) FROM supplier) FROM (VALUES ('program'), ('file'), ('record'), ('data_item'), ('copy'), ('section'), ('paragraph')) k(kind)""",
    "code_symbols",
)
def u1_parser_outputs(spark, d):
    rows = E.all_symbols(python=E.python_symbols(_files(spark, d)), cobol=E.cobol_symbols(_cobol(spark, d)))
    return rows.groupBy("language", "kind").agg(F.count("*").alias("n"))


# endpoints, layers, headings, coverage

ENDPOINTS = """raw AS (SELECT o_orderkey AS seq, 'app.m' || o_custkey % 20 AS module, 'r' || o_custkey % 3 AS var, CASE WHEN o_orderkey % 2 = 0 THEN 'GET' ELSE 'POST' END AS verb, CASE WHEN o_orderkey % 5 > 0 THEN '/x' || o_custkey % 7 END AS route, 'symbol-part-' || o_custkey * 3 AS handler FROM orders),
    ro AS (SELECT s_suppkey AS seq, 'app.m' || s_suppkey % 20 AS module, 'r' || s_nationkey % 3 AS var, '/p' || s_suppkey % 4 AS prefix FROM supplier),
    inc AS (SELECT n_nationkey AS seq, 'r' || n_nationkey % 4 AS router_var, CASE WHEN n_nationkey % 2 = 0 THEN 'm' || n_nationkey END AS token, CASE WHEN n_nationkey % 6 > 0 THEN 'n' || n_regionkey || '/' END AS prefix FROM nation)"""


def _web(spark, d):
    raw = v.read(spark, d, "orders").selectExpr("o_orderkey seq", "concat('app.m', o_custkey % 20) module", "concat('r', o_custkey % 3) var", "if(o_orderkey % 2 = 0, 'GET', 'POST') verb", "if(o_orderkey % 5 > 0, concat('/x', o_custkey % 7), null) route", "concat('symbol-part-', o_custkey * 3) handler")
    routers = v.read(spark, d, "supplier").selectExpr("s_suppkey seq", "concat('app.m', s_suppkey % 20) module", "concat('r', s_nationkey % 3) var", "concat('/p', s_suppkey % 4) prefix")
    includes = v.read(spark, d, "nation").selectExpr("n_nationkey seq", "concat('r', n_nationkey % 4) router_var", "if(n_nationkey % 2 = 0, concat('m', n_nationkey), null) token", "if(n_nationkey % 6 > 0, concat('n', n_regionkey, '/'), null) prefix")
    return raw, routers, includes


PART = "CASE WHEN coalesce({x}, '') = '' THEN '' ELSE '/' || regexp_replace({x}, '^/+|/+$', '', 'g') END"


@query(
    f"""WITH {ENDPOINTS}, r AS (SELECT module, var, min_by(prefix, seq) AS rp FROM ro GROUP BY 1, 2), t AS (SELECT token, arg_min_null(prefix, seq) AS tp FROM inc WHERE token IS NOT NULL GROUP BY 1), w AS (SELECT router_var, arg_min_null(prefix, seq) AS vp FROM inc GROUP BY 1),
       e AS (SELECT raw.*, {PART.format(x="CASE WHEN t.token IS NOT NULL THEN tp ELSE vp END")} || {PART.format(x="rp")} || {PART.format(x="coalesce(route, '(dynamic)')")} AS path FROM raw LEFT JOIN r ON r.module = raw.module AND r.var = raw.var LEFT JOIN t ON t.token = string_split(raw.module, '.')[-1] LEFT JOIN w ON w.router_var = raw.var),
       b AS (SELECT *, 'endpoint-' || lower(verb) || '-' || trim(regexp_replace(lower(path), '[^a-z0-9]+', '-', 'g'), '-') AS base FROM e), n AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY seq) - 1 AS k FROM b)
       SELECT base || CASE WHEN k > 0 THEN '-' || k ELSE '' END AS id, n.module, verb, path, CASE WHEN s.id IS NOT NULL THEN handler END AS handler FROM n LEFT JOIN v_symbols s ON s.id = handler""",
    "symbols",
)
def j14_endpoints(spark, d):
    return A.resolve_endpoints(*_web(spark, d), v.symbols(spark, d))


@query(f"""WITH {ENDPOINTS}, n AS (SELECT module, var, count(*) AS n FROM raw GROUP BY 1, 2) SELECT DISTINCT ro.module, ro.var, coalesce(n, 0) AS endpoint_count, ro.var IN (SELECT router_var FROM inc) AS mounted FROM ro LEFT JOIN n ON n.module = ro.module AND n.var = ro.var""")
def j15_router_wiring(spark, d):
    raw, routers, includes = _web(spark, d)
    return A.router_view(routers, includes, raw)


@query(f"""WITH {ENDPOINTS} SELECT raw.module, count(*) AS endpoints, count(s.id) AS handled FROM raw LEFT JOIN v_symbols s ON s.id = handler GROUP BY 1""", "symbols")
def j16_handlers(spark, d):
    e = A.resolve_endpoints(*_web(spark, d), v.symbols(spark, d))
    return e.groupBy("module").agg(F.count("*").alias("endpoints"), F.count("handler").alias("handled"))


@query(
    """WITH h AS (SELECT l_orderkey AS doc_id, l_linenumber AS n, max(1 + l_suppkey % 4) AS level, 'h' || max(l_partkey) AS heading FROM lineitem GROUP BY 1, 2)
       SELECT h.doc_id, h.n, h.level, h.heading, coalesce((SELECT string_agg(a.heading, '/' ORDER BY a.n) FROM h a WHERE a.doc_id = h.doc_id AND a.n < h.n AND a.level < h.level
              AND NOT EXISTS (SELECT 1 FROM h b WHERE b.doc_id = h.doc_id AND b.n > a.n AND b.n < h.n AND b.level <= a.level)), '') AS above FROM h"""
)
def j13_heading_ancestry(spark, d):
    h = v.read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("n")).agg(F.max(1 + F.col("l_suppkey") % 4).alias("level"), F.concat(F.lit("h"), F.max("l_partkey").cast("string")).alias("heading"))
    return A.heading_ancestry(h).select("doc_id", "n", "level", "heading", F.array_join("ancestors", "/").alias("above"))


@query(
    """SELECT id, 'untraced_source' AS gap FROM v_symbols WHERE seq % 2 = 0 AND id NOT IN (SELECT 'symbol-part-' || l_partkey FROM lineitem WHERE l_quantity > 30 OR l_returnflag = 'A')
       UNION ALL SELECT id, 'target_without_source' FROM v_symbols WHERE seq % 2 = 1 AND id NOT IN (SELECT 'symbol-part-' || l_suppkey FROM lineitem WHERE l_quantity > 30 OR l_returnflag = 'A')""",
    "symbols",
)
def j21_trace_coverage(spark, d):
    expected = v.symbols(spark, d).selectExpr("id", "if(seq % 2 = 0, 'source', 'target') side")
    entries = v.read(spark, d, "lineitem").selectExpr("if(l_quantity > 30 or l_returnflag = 'A', concat('symbol-part-', l_partkey), null) source_id", "if(l_quantity > 30 or l_returnflag = 'A', concat('symbol-part-', l_suppkey), null) target_id")
    return A.trace_coverage(expected, entries)


@query(
    """WITH s AS (SELECT p_partkey AS id, 'app.' || ['routes', 'services', 'user_repo', 'repositories', 'models', 'schemas', 'util'][p_size % 7 + 1] || '.' || lower(p_type) AS module, p_name AS title, p_size = 50 AS is_model FROM part),
       l AS (SELECT id, CASE WHEN is_model OR contains(module, '.models.') THEN 'model' WHEN contains(module, '.routes.') THEN 'route' WHEN contains(module, '.services.') THEN 'service' WHEN contains(module, 'repo') THEN 'repo' ELSE 'other' END AS layer, module, title FROM s),
       k AS (SELECT id, layer, CASE WHEN layer = 'model' THEN title ELSE module END AS node, list_position(['route', 'service', 'repo', 'model'], layer) AS rank FROM l WHERE layer <> 'other'),
       e AS (SELECT DISTINCT l_partkey AS s, l_suppkey AS o FROM lineitem)
       SELECT DISTINCT a.layer AS from_layer, a.node AS from_node, b.layer AS to_layer, b.node AS to_node FROM e JOIN k a ON a.id = s JOIN k b ON b.id = o WHERE b.rank > a.rank"""
)
def g7_layer_flow(spark, d):
    s = v.read(spark, d, "part").selectExpr("p_partkey id", "concat('app.', element_at(array('routes', 'services', 'user_repo', 'repositories', 'models', 'schemas', 'util'), p_size % 7 + 1), '.', lower(p_type)) module", "p_name title", "p_size = 50 is_model")
    e = v.read(spark, d, "lineitem").selectExpr("l_partkey subject", "'calls' predicate", "l_suppkey object")
    return A.layer_flow(s, e)
