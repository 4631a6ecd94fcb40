"""Bundle-shaped views of the star schema and text tables: Spark DataFrames, and the same as DuckDB CTEs for the oracles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomkb.functions.scalars import slugify


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq, id, path, language, checksum, n_chars: one source a document."""
    d = read(spark, sf_dir, "documents")
    name = F.concat_ws("-", "source", F.col("doc_id").cast("string"))
    return d.select(F.col("doc_id").alias("seq"), slugify(name).alias("id"), F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path"), F.col("lang").alias("language"), F.sha2("text", 256).alias("checksum"), "n_chars")


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq, id, title, kind, qualified_name, module, file, line, docstring: one symbol a part."""
    p = read(spark, sf_dir, "part")
    kind = F.element_at(F.array(*map(F.lit, ["function", "method", "class", "test", "constant", "record"])), (F.col("p_size") % 6 + 1).cast("int"))
    brand, title = F.lower(F.replace("p_brand", F.lit("#"), F.lit("_"))), F.replace("p_name", F.lit(" "), F.lit("_"))
    module = F.concat(F.lit("shop."), brand, F.lit("."), F.lower("p_type"))
    return p.select(
        F.col("p_partkey").alias("seq"), F.concat(F.lit("symbol-part-"), "p_partkey").alias("id"), title.alias("title"), kind.alias("kind"), F.concat_ws(".", module, F.concat(title, F.lit("_"), F.col("p_partkey"))).alias("qualified_name"),
        module.alias("module"), F.concat(F.replace(module, F.lit("."), F.lit("/")), F.lit(".py")).alias("file"), F.col("p_size").cast("int").alias("line"), F.concat_ws(" ", "p_type", "p_brand", "p_name").alias("docstring"), F.lit("python").alias("language"),
    )


def _edge(df: DataFrame, seq: str, subject: str, predicate: str, obj: str, status: str, evidence: str) -> DataFrame:
    return df.selectExpr(f"{seq} seq", f"{subject} subject", f"'{predicate}' predicate", f"{obj} object", f"{status} status", f"{evidence} evidence")


def relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq, id, subject, predicate, object, status, confidence, evidence: the star schema as triples, lines with repeats."""
    t = lambda name: read(spark, sf_dir, name)
    by = lambda c, a, b: f"case {c} when '{a}' then 'exact' when '{b}' then 'inferred' else 'unresolved' end"
    edges = [
        _edge(t("orders"), "o_orderkey * 100", "concat('order-', o_orderkey)", "placed_by", "concat('customer-', o_custkey)", by("o_orderstatus", "F", "O"), "concat('ev-o', o_orderkey)"),
        _edge(t("lineitem"), "l_orderkey * 100 + l_linenumber", "concat('order-', l_orderkey)", "covers", "concat('symbol-part-', l_partkey)", by("l_linestatus", "F", "O"), "concat('ev-l', l_orderkey)"),
        _edge(t("lineitem"), "l_orderkey * 100 + 50 + l_linenumber", "concat('symbol-supplier-', l_suppkey)", "calls", "concat('symbol-part-', l_partkey)", by("l_returnflag", "A", "N"), "concat('ev-s', l_orderkey)"),
        _edge(t("customer"), "c_custkey * 100 + 90", "concat('customer-', c_custkey)", "located_in", "concat('nation-', c_nationkey)", "'exact'", "concat('ev-c', c_custkey)"),
        _edge(t("supplier"), "s_suppkey * 100 + 91", "concat('symbol-supplier-', s_suppkey)", "located_in", "concat('nation-', s_nationkey)", "'exact'", "concat('ev-p', s_suppkey)"),
        _edge(t("nation"), "n_nationkey * 100 + 92", "concat('nation-', n_nationkey)", "part_of", "concat('region-', n_regionkey)", "'inferred'", "concat('ev-n', n_nationkey)"),
    ]
    all_ = reduce(DataFrame.unionByName, edges)
    confidence = F.when(F.col("status") == "exact", 0.96).when(F.col("status") == "inferred", 0.72).otherwise(0.45)
    return all_.withColumns({"id": F.concat_ws("|", "subject", "predicate", "object"), "confidence": confidence})


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq, id, claim, tier, review_status, lifecycle_status, confidence, review_required, source_id, version: one claim an order."""
    o = read(spark, sf_dir, "orders")
    return o.selectExpr(
        "o_orderkey seq", "concat('claim-', o_orderkey) id", "concat('Order ', o_orderkey, ' is ', lower(substring(o_orderpriority, 3))) claim", "cast(1 + o_orderkey % 4 as int) tier",
        "case substring(o_orderpriority, 1, 1) when '1' then 'approved' when '2' then 'rejected' when '3' then 'edited' when '4' then 'proposed' end review_status",
        "case o_orderstatus when 'F' then 'active' when 'O' then '' else if(o_orderkey % 5 = 0, 'retired', 'superseded') end lifecycle_status",
        "round((o_orderkey % 101) / 100.0D, 2) confidence", "o_orderkey % 3 = 0 review_required", "concat('source-', o_custkey) source_id", "o_orderdate version_at", "o_totalprice weight",
    )


def claim_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """claim_id, symbol_id: the symbols that a claim is about."""
    return read(spark, sf_dir, "lineitem").selectExpr("concat('claim-', l_orderkey) claim_id", "concat('symbol-part-', l_partkey) symbol_id").distinct()


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """claim_id, decision: the review overlay, from labels."""
    return read(spark, sf_dir, "labels").selectExpr("concat('claim-', doc_id) claim_id", "if(quality = 0, 'rejected', if(toxic = 1, 'proposed', 'approved')) decision")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq, id, subject, predicate, object, source_text, status: one item a conversation turn."""
    c = read(spark, sf_dir, "conversations")
    return c.selectExpr(
        "conv_id * 1000 + turn seq", "concat('ki-', conv_id, '-', turn) id", "concat(role, ' ', conv_id % 40) subject", "element_at(array('should', 'requires', 'records'), cast(1 + turn % 3 as int)) predicate",
        "substring_index(text, ' ', 6) object", "text source_text", "case when conv_id % 7 = 0 then 'rejected' when conv_id % 7 = 1 then null when conv_id % 7 < 4 then 'approved' else 'proposed' end status", "concat('conv-', conv_id) source_id", "cast(turn as int) turn", "conv_id",
    )


def review_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq, item_id, action, reviewer, ts, value: the review log, from events."""
    e = read(spark, sf_dir, "events")
    return e.selectExpr("event_id seq", "concat('ki-', user_id) item_id", "element_at(map('signup', 'commented', 'purchase', 'approved', 'error', 'rejected', 'view', 'deferred', 'click', 'edited'), event_type) action", "concat('user-', user_id % 17) reviewer", "ts", "value")


def code_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq, id, kind, title, qualified_name, module: parts as classes of five, each a class and four methods."""
    p = read(spark, sf_dir, "part").select("p_partkey", F.replace("p_name", F.lit(" "), F.lit("_")).alias("name"), F.concat(F.lit("shop."), F.lower(F.replace("p_brand", F.lit("#"), F.lit("_"))), F.lit("."), F.lower("p_type")).alias("module"))
    cls = F.col("p_partkey") - F.col("p_partkey") % 5
    own = p.select("p_partkey", "name", cls.alias("cls")).join(p.select(F.col("p_partkey").alias("cls"), "module"), "cls")
    return own.selectExpr("p_partkey seq", "concat('sym-', p_partkey) id", "if(p_partkey = cls, 'class', 'method') kind", "if(p_partkey = cls, concat('C', cls), name) title", "concat(module, '.C', cls, if(p_partkey = cls, '', concat('.', name))) qualified_name", "module", "cls")


def code_classes(spark: SparkSession, sf_dir: str, symbols: DataFrame | None = None) -> DataFrame:
    """qualified_name, pos, base: the base expressions of the classes of code_symbols."""
    c = (symbols or code_symbols(spark, sf_dir)).filter("kind = 'class' and seq > 0")
    return c.selectExpr("qualified_name", "explode(array(struct(0 as pos, if(seq % 20 = 0, 'Missing', concat('C', (seq div 10) * 5)) as base), struct(1 as pos, concat('pkg.C', (seq div 15) * 5) as base))) b").select("qualified_name", "b.pos", "b.base")


def code_imports(spark: SparkSession, sf_dir: str, symbols: DataFrame | None = None) -> DataFrame:
    """module, pos, name: what modules import, from parts: names of modules without their first segment, some with a symbol's, some unknown."""
    s = symbols or code_symbols(spark, sf_dir)
    other = s.select((F.col("seq") - 7).alias("seq"), F.expr("substr(module, 6)").alias("tail"))
    rows = s.filter("seq % 5 = 0").select("seq", "module").join(other, "seq")
    name = F.expr("case seq % 3 when 0 then tail when 1 then concat(tail, '.', 'thing') else concat('ext.', seq % 7) end")
    return rows.select("module", name.alias("name"), "seq").groupBy("module", "name").agg(F.min("seq").cast("int").alias("pos"))


def code_refs(spark: SparkSession, sf_dir: str, symbols: DataFrame | None = None) -> DataFrame:
    """subject, name: how symbols name others, from lines in seven forms.

    The symbols u and w of a line, in the class of its part and in one before, both follow from u's number, and each form needs one name,
    so lines stay narrow until they have it.
    """
    s = symbols or code_symbols(spark, sf_dir)
    u = s.selectExpr("seq u_seq", "concat('self.', title) u_name", "(cls div 10) * 5 + seq % 5 w_seq").join(s.selectExpr("seq w_seq", "concat('cls.', title) w_name"), "w_seq").drop("w_seq")
    t = s.selectExpr("seq t_seq", "title t_title", "qualified_name t_qualified_name", "module t_module", "cls t_cls")
    line = read(spark, sf_dir, "lineitem").selectExpr("l_partkey", "l_suppkey t_seq", "l_linenumber", "l_partkey - l_partkey % 5 + l_suppkey % 5 u_seq")
    line = line.join(u, "u_seq").selectExpr("l_partkey", "t_seq", "l_linenumber", "case l_linenumber when 3 then u_name when 4 then w_name end name").join(t, "t_seq")
    name = """case l_linenumber when 1 then t_qualified_name when 2 then t_title when 3 then name when 4 then name
        when 5 then concat(substring_index(t_module, '.', -1), '.', t_title) when 6 then concat(t_title, '()') else concat('C', t_cls) end"""
    return line.selectExpr("concat('sym-', l_partkey) subject", f"{name} name").repartition("subject").distinct()


#: The same views for DuckDB.
CTES = {
    "sources": r"""SELECT doc_id AS seq, trim(regexp_replace(lower(source || '-' || doc_id), '[^a-z0-9]+', '-', 'g'), '-') AS id, source || '/' || doc_id AS path, lang AS language, sha256(text) AS checksum, n_chars FROM documents""",
    "symbols": r"""SELECT *, replace(module, '.', '/') || '.py' AS file, module || '.' || title || '_' || seq AS qualified_name FROM (SELECT p_partkey AS seq, 'symbol-part-' || p_partkey AS id, replace(p_name, ' ', '_') AS title,
        ['function', 'method', 'class', 'test', 'constant', 'record'][p_size % 6 + 1] AS kind, 'shop.' || lower(replace(p_brand, '#', '_')) || '.' || lower(p_type) AS module, p_size AS line, p_type || ' ' || p_brand || ' ' || p_name AS docstring, 'python' AS language FROM part)""",
    "relations": r"""SELECT *, subject || '|' || predicate || '|' || object AS id, CAST(CASE status WHEN 'exact' THEN 0.96 WHEN 'inferred' THEN 0.72 ELSE 0.45 END AS DOUBLE) AS confidence FROM (
        SELECT o_orderkey * 100 AS seq, 'order-' || o_orderkey AS subject, 'placed_by' AS predicate, 'customer-' || o_custkey AS object, CASE o_orderstatus WHEN 'F' THEN 'exact' WHEN 'O' THEN 'inferred' ELSE 'unresolved' END AS status, 'ev-o' || o_orderkey AS evidence FROM orders
        UNION ALL SELECT l_orderkey * 100 + l_linenumber, 'order-' || l_orderkey, 'covers', 'symbol-part-' || l_partkey, CASE l_linestatus WHEN 'F' THEN 'exact' WHEN 'O' THEN 'inferred' ELSE 'unresolved' END, 'ev-l' || l_orderkey FROM lineitem
        UNION ALL SELECT l_orderkey * 100 + 50 + l_linenumber, 'symbol-supplier-' || l_suppkey, 'calls', 'symbol-part-' || l_partkey, CASE l_returnflag WHEN 'A' THEN 'exact' WHEN 'N' THEN 'inferred' ELSE 'unresolved' END, 'ev-s' || l_orderkey FROM lineitem
        UNION ALL SELECT c_custkey * 100 + 90, 'customer-' || c_custkey, 'located_in', 'nation-' || c_nationkey, 'exact', 'ev-c' || c_custkey FROM customer
        UNION ALL SELECT s_suppkey * 100 + 91, 'symbol-supplier-' || s_suppkey, 'located_in', 'nation-' || s_nationkey, 'exact', 'ev-p' || s_suppkey FROM supplier
        UNION ALL SELECT n_nationkey * 100 + 92, 'nation-' || n_nationkey, 'part_of', 'region-' || n_regionkey, 'inferred', 'ev-n' || n_nationkey FROM nation)""",
    "claims": r"""SELECT o_orderkey AS seq, 'claim-' || o_orderkey AS id, 'Order ' || o_orderkey || ' is ' || lower(substr(o_orderpriority, 3)) AS claim, CAST(1 + o_orderkey % 4 AS INTEGER) AS tier,
        CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'approved' WHEN '2' THEN 'rejected' WHEN '3' THEN 'edited' WHEN '4' THEN 'proposed' END AS review_status,
        CASE o_orderstatus WHEN 'F' THEN 'active' WHEN 'O' THEN '' ELSE CASE WHEN o_orderkey % 5 = 0 THEN 'retired' ELSE 'superseded' END END AS lifecycle_status,
        round((o_orderkey % 101) / 100.0, 2)::DOUBLE AS confidence, o_orderkey % 3 = 0 AS review_required, 'source-' || o_custkey AS source_id, o_orderdate AS version_at, o_totalprice AS weight FROM orders""",
    "claim_symbols": r"""SELECT DISTINCT 'claim-' || l_orderkey AS claim_id, 'symbol-part-' || l_partkey AS symbol_id FROM lineitem""",
    "decisions": r"""SELECT 'claim-' || doc_id AS claim_id, CASE WHEN quality = 0 THEN 'rejected' WHEN toxic = 1 THEN 'proposed' ELSE 'approved' END AS decision FROM labels""",
    "items": r"""SELECT conv_id * 1000 + turn AS seq, 'ki-' || conv_id || '-' || turn AS id, role || ' ' || (conv_id % 40) AS subject, ['should', 'requires', 'records'][1 + turn % 3] AS predicate, array_to_string(string_split(text, ' ')[1:6], ' ') AS object, text AS source_text,
        CASE WHEN conv_id % 7 = 0 THEN 'rejected' WHEN conv_id % 7 = 1 THEN NULL WHEN conv_id % 7 < 4 THEN 'approved' ELSE 'proposed' END AS status, 'conv-' || conv_id AS source_id, CAST(turn AS INTEGER) AS turn, conv_id FROM conversations""",
    "review_events": r"""SELECT event_id AS seq, 'ki-' || user_id AS item_id, CASE event_type WHEN 'signup' THEN 'commented' WHEN 'purchase' THEN 'approved' WHEN 'error' THEN 'rejected' WHEN 'view' THEN 'deferred' WHEN 'click' THEN 'edited' END AS action, 'user-' || (user_id % 17) AS reviewer, ts, value FROM events""",
    "code_symbols": r"""SELECT p.p_partkey AS seq, 'sym-' || p.p_partkey AS id, CASE WHEN p.p_partkey % 5 = 0 THEN 'class' ELSE 'method' END AS kind, CASE WHEN p.p_partkey % 5 = 0 THEN 'C' || c.p_partkey ELSE replace(p.p_name, ' ', '_') END AS title,
        'shop.' || lower(replace(c.p_brand, '#', '_')) || '.' || lower(c.p_type) || '.C' || c.p_partkey || CASE WHEN p.p_partkey % 5 = 0 THEN '' ELSE '.' || replace(p.p_name, ' ', '_') END AS qualified_name,
        'shop.' || lower(replace(c.p_brand, '#', '_')) || '.' || lower(c.p_type) AS module, c.p_partkey AS cls FROM part p JOIN part c ON c.p_partkey = p.p_partkey - p.p_partkey % 5""",
    "code_classes": r"""SELECT qualified_name, 0 AS pos, CASE WHEN seq % 20 = 0 THEN 'Missing' ELSE 'C' || ((seq // 10) * 5) END AS base FROM v_code_symbols WHERE kind = 'class' AND seq > 0
        UNION ALL SELECT qualified_name, 1, 'pkg.C' || ((seq // 15) * 5) FROM v_code_symbols WHERE kind = 'class' AND seq > 0""",
    "code_imports": r"""SELECT module, CAST(min(seq) AS INTEGER) AS pos, name FROM (SELECT a.module, a.seq, CASE a.seq % 3 WHEN 0 THEN substr(b.module, 6) WHEN 1 THEN substr(b.module, 6) || '.thing' ELSE 'ext.' || (a.seq % 7) END AS name
        FROM v_code_symbols a JOIN v_code_symbols b ON b.seq = a.seq + 7 WHERE a.seq % 5 = 0) GROUP BY module, name""",
    "code_refs": r"""SELECT DISTINCT 'sym-' || l_partkey AS subject, CASE l_linenumber WHEN 1 THEN t.qualified_name WHEN 2 THEN t.title WHEN 3 THEN 'self.' || u.title WHEN 4 THEN 'cls.' || w.title
        WHEN 5 THEN string_split(t.module, '.')[-1] || '.' || t.title WHEN 6 THEN t.title || '()' ELSE 'C' || t.cls END AS name
        FROM lineitem JOIN v_code_symbols t ON t.seq = l_suppkey JOIN v_code_symbols u ON u.seq = l_partkey - l_partkey % 5 + l_suppkey % 5 JOIN v_code_symbols w ON w.seq = ((l_partkey - l_partkey % 5) // 10) * 5 + l_suppkey % 5""",
}


def with_views(names: str, sql: str) -> str:
    """sql with the named views as CTEs before it; sql may go on with CTEs of its own after "WITH"."""
    head = ", ".join(f"v_{n} AS ({CTES[n]})" for n in names.split())
    body = sql.strip()
    return f"WITH RECURSIVE {head}, {body[5:]}" if body.startswith("WITH ") else f"WITH {head} {body}"
