"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomkb.sources.shared import scratch

from . import ann, decontaminate, divergence, licenses, manifest, mixing, near_dedup, pieces, quality, secrets, substring_dedup, url_filter, warc

#: Fixed rules of the URL query: verdict, host, path.
URL_RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeated_spans(_read(spark, sf_dir, "documents"))


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_read(spark, sf_dir, "documents"))


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(_read(spark, sf_dir, "pages"), URL_RULES)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return quality.score_quality(docs, quality.train(docs, _read(spark, sf_dir, "labels")))


def op5_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_read(spark, sf_dir, "documents"))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.token_rows(pieces.encode(_read(spark, sf_dir, "documents")))


def op7_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest_neighbours(_read(spark, sf_dir, "embeddings"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op9_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(_read(spark, sf_dir, "documents"))
    return found.selectExpr("doc_id", "pos", "sha2(candidate, 256) candidate_digest", "round(score, 6) score", "is_secret")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_read(spark, sf_dir, "pages"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = _read(spark, sf_dir, "documents"), scratch(spark, "manifest")
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    manifest.build(docs, folder, {"text": tampered})
    out = manifest.verify(spark, folder).withColumn("proof_sha256", F.sha2(manifest.siblings(F.col("path")), 256))
    return out.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def op12_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(_read(spark, sf_dir, "documents"), [1, 2, 3])


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(_read(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_substring_dedup, op2_minhash_near_dedup, op3_url_filters, op4_quality, op5_license_scans, op6_sentencepiece, op7_nearest_neighbours, op8_decontamination, op9_secret_scans, op10_warc, op11_merkle_manifest, op12_mixing, op13_source_divergence)}

ORACLES = {
    "op2_minhash_near_dedup": r"""
        WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
        s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
                ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(list_slice(ws, i, i + 4), ' ')) END) AS sh FROM w),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
        p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY 1, 2),
        e AS (SELECT u, v FROM p JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * c >= 75 * (x.n + y.n - c)),
        r AS (SELECT doc_id AS id, doc_id AS root FROM documents UNION SELECT e.v, r.root FROM r JOIN e ON e.u = r.id),
        c AS (SELECT id, min(root) AS component_id FROM r GROUP BY 1)
        SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
        FROM documents d JOIN c ON c.id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id""",
    "op3_url_filters": r"""
        WITH r AS (SELECT page_id, CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
        h AS (SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS raw, rest FROM r),
        p AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h),
        rules(verdict, rhost, rpath) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
        f AS (SELECT page_id, max_by(rhost || rpath, length(rhost || rpath)) AS rule, max_by(verdict, length(rhost || rpath)) AS verdict
              FROM p JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY 1)
        SELECT p.page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM p LEFT JOIN f USING (page_id)""",
    "op10_warc": r"""
        WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
        d AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, upper(sha1(html)) AS hex FROM p),
        b AS (SELECT *, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
              CAST(((('0x' || substr(hex, CAST(1 + 5 * (i // 4) AS BIGINT), 5))::BIGINT >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31) + 1 AS BIGINT), 1)), '') AS payload_digest FROM d),
        m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS top FROM b)
        SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id = top THEN NULL ELSE top END AS refers_to, true AS digest_ok FROM m""",
}

#: H of a row's columns, as the manifest's leaves.
_LEAF = "sha256(" + " || ".join(f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')" for c in ("doc_id", "source", "lang", "n_chars", "{text}")) + ")"
#: CRC-32 of the decimal doc_id, bit by bit.
_CRC = """list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
            lambda crc, b: list_reduce([xor(crc, b), 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END))"""
ORACLES["op11_merkle_manifest"] = f"""
        WITH RECURSIVE d AS (SELECT *, row_number() OVER () AS rid, {_LEAF.format(text="text")} AS leaf,
              {_LEAF.format(text="CASE WHEN xor(" + _CRC + ", 4294967295) % 2 = 0 THEN replace(text, chr(10), '') ELSE text END")} AS arrived, coalesce('=' || source, '-') AS tree FROM documents),
        f AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf, rid) - 1 AS i, count(*) OVER (PARTITION BY tree) AS n FROM d),
        t AS (SELECT tree, 0 AS lvl, i, n, leaf AS h FROM f UNION ALL SELECT tree, lvl + 1, i // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY i)) FROM t WHERE n > 1 GROUP BY tree, lvl, n, i // 3),
        subs AS (SELECT tree, h, row_number() OVER (ORDER BY tree) - 1 AS i, count(*) OVER () AS n FROM t WHERE n = 1),
        t2 AS (SELECT 0 AS lvl, i, n, h FROM subs UNION ALL SELECT lvl + 1, i // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY i)) FROM t2 WHERE n > 1 GROUP BY lvl, n, i // 3),
        p AS (SELECT a.tree, a.lvl, a.i, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i < a.i), '') AS l, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i > a.i), '') AS r
              FROM t a LEFT JOIN t b ON b.tree = a.tree AND b.lvl = a.lvl AND b.i // 3 = a.i // 3 AND b.i <> a.i WHERE a.n > 1 GROUP BY 1, 2, 3),
        p2 AS (SELECT a.lvl, a.i, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i < a.i), '') AS l, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i > a.i), '') AS r
              FROM t2 a LEFT JOIN t2 b ON b.lvl = a.lvl AND b.i // 3 = a.i // 3 AND b.i <> a.i WHERE a.n > 1 GROUP BY 1, 2),
        w AS (SELECT rid, tree, 0 AS lvl, i, arrived AS cur, '' AS proof FROM f UNION ALL SELECT rid, w.tree, w.lvl + 1, w.i // 3, sha256(l || cur || r), proof || l || r FROM w JOIN p ON p.tree = w.tree AND p.lvl = w.lvl AND p.i = w.i),
        e AS (SELECT rid, tree, arg_max(cur, lvl) AS cur, arg_max(proof, lvl) AS proof FROM w GROUP BY 1, 2),
        w2 AS (SELECT rid, 0 AS lvl, subs.i, cur, proof FROM e JOIN subs USING (tree) UNION ALL SELECT rid, w2.lvl + 1, w2.i // 3, sha256(l || cur || r), proof || l || r FROM w2 JOIN p2 ON p2.lvl = w2.lvl AND p2.i = w2.i),
        e2 AS (SELECT rid, arg_max(cur, lvl) AS folded_root, sha256(arg_max(proof, lvl)) AS proof_sha256 FROM w2 GROUP BY 1)
        SELECT doc_id, leaf, subs.h AS subroot, t2.h AS root, proof_sha256, folded_root, folded_root = t2.h AS verified
        FROM d JOIN subs USING (tree) JOIN e2 USING (rid) JOIN t2 ON t2.n = 1"""

_H60 = "('0x' || substr(md5({0}), 1, 15))::BIGINT"
_KEYS = "list_transform(range(0, 12), lambda i: ('0x' || substr(md5('0|' || {name} || '|' || i), 1, 15))::BIGINT % greatest({n}, 1))"
def _swap(at: str, n: str, keys: str, salt: str) -> str:
    """Swap-or-not rounds as a list_reduce."""
    other = f"(key + {n} - z) % {n}"
    mixed = f"(greatest(z, {other}) % 2147483647 * 1103515245 + (key + {salt}) % 2147483647 * 739671283) % 2147483647"
    return f"list_reduce(list_prepend({at}, {keys}), lambda z, key: CASE WHEN (({mixed}) >> 13) % 2 = 1 THEN {other} ELSE z END)"


ORACLES["op12_mixing"] = f"""
        WITH RECURSIVE r AS (SELECT row_number() OVER () AS rid, doc_id, coalesce('=' || source, '~') AS tree, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size,
              md5(concat_ws(':', doc_id, text)) AS digest FROM documents),
        f AS (SELECT *, CAST(sum(size) OVER (PARTITION BY tree ORDER BY digest, rid) AS BIGINT) - size AS first FROM r),
        s0 AS (SELECT tree, CAST(sum(size) AS BIGINT) AS source_size FROM r GROUP BY 1),
        s AS (SELECT *, [1, 2, 3][(row_number() OVER (ORDER BY tree) - 1) % 3 + 1] AS weight FROM s0),
        l AS (SELECT 0 AS step, CAST(sum(source_size) AS DOUBLE) / CAST(sum(weight) AS DOUBLE) AS share, CAST(-1 AS BIGINT) AS seen, CAST(sum(source_size) AS BIGINT) AS t FROM s
              UNION ALL SELECT step + 1, CAST(t - sum(CASE WHEN weight * share > 3 * source_size THEN 3 * source_size ELSE 0 END) AS DOUBLE) / CAST(sum(CASE WHEN weight * share > 3 * source_size THEN 0 ELSE weight END) AS DOUBLE),
                count(*) FILTER (weight * share > 3 * source_size), t FROM l, s GROUP BY step, share, seen, t
              HAVING count(*) FILTER (weight * share > 3 * source_size) NOT IN (0, seen) AND sum(CASE WHEN weight * share > 3 * source_size THEN 0 ELSE weight END) > 0),
        g AS (SELECT tree, source_size, CASE WHEN weight * x.share > 3 * source_size THEN CAST(3 * source_size AS DOUBLE) ELSE weight * x.share END AS target FROM s, (SELECT arg_max(share, step) AS share FROM l) x),
        n0 AS (SELECT *, CAST(ceil(source_size / 64) AS BIGINT) AS n FROM g WHERE source_size > 0),
        n AS (SELECT *, least(CAST(round(target / source_size * n) AS BIGINT), n * 3) AS due, {_KEYS.format(name="tree", n="n")} AS keys FROM n0),
        i AS (SELECT *, CAST(coalesce(sum(due) OVER (ORDER BY tree ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS lo, CAST(sum(due) OVER () AS BIGINT) AS slots FROM n),
        x AS (SELECT id // 8192 AS shard, {_H60.format("'0|slot|' || id")} % slots AS x FROM (SELECT slots, unnest(range(0, slots)) AS id FROM (SELECT max(slots) AS slots FROM i))),
        c AS (SELECT shard, tree, due, count(*) AS c FROM x JOIN i ON lo <= x AND x < lo + due GROUP BY 1, 2, 3),
        b AS (SELECT *, CAST(coalesce(sum(c) OVER (PARTITION BY tree ORDER BY shard ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS base FROM c),
        k1 AS (SELECT tree, unnest(range(base, least(base + c, due))) AS k FROM b),
        st AS (SELECT n.tree, n.due, coalesce(m.got, 0) AS got FROM n LEFT JOIN (SELECT tree, CAST(sum(c) AS BIGINT) AS got FROM b GROUP BY 1) m USING (tree)),
        ov AS (SELECT tree, CAST(coalesce(sum(got - due) OVER (ORDER BY tree ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM st WHERE got > due),
        sh AS (SELECT tree, got, due - got AS lack, CAST(coalesce(sum(due - got) OVER (ORDER BY tree ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS lo, CAST(sum(due - got) OVER () AS BIGINT) AS rest FROM st WHERE got < due),
        fr AS (SELECT start + k - due AS u FROM (SELECT start, due, unnest(range(greatest(base, due), base + c)) AS k FROM b JOIN ov USING (tree))),
        ag AS (SELECT {_swap("u", "rest", _KEYS.format(name="'again'", n="rest"), "0")} AS u FROM fr, (SELECT max(rest) AS rest FROM sh)),
        k2 AS (SELECT tree, got + u - lo AS k FROM ag JOIN sh ON lo <= u AND u < lo + lack),
        q AS (SELECT tree, {_swap("k % n", "n", "keys", "k // n")} AS block FROM (SELECT * FROM k1 UNION ALL SELECT * FROM k2) JOIN n USING (tree)),
        z AS (SELECT tree, block, count(*) AS uses FROM q GROUP BY 1, 2),
        y AS (SELECT rid, CAST(sum(uses * (least(first + size, (block + 1) * 64) - greatest(first, block * 64))) AS BIGINT) AS taken
              FROM (SELECT *, unnest(range(first // 64, (first + size - 1) // 64 + 1)) AS block FROM f WHERE size > 0) JOIN z USING (tree, block) GROUP BY 1)
        SELECT doc_id, size, source_size, target, coalesce(taken, 0) AS taken FROM f JOIN g USING (tree) LEFT JOIN y USING (rid)"""

ORACLES["op13_source_divergence"] = r"""
        WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
              regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
        t AS (SELECT rid, lang, source, unnest(ts) AS term FROM d),
        k AS (SELECT lang, term, count(*) AS all_n FROM t GROUP BY 1, 2 HAVING count(DISTINCT rid) >= 30),
        v AS (SELECT lang, count(*) AS v, sum(all_n) AS all_total FROM k GROUP BY 1),
        c AS (SELECT lang, source, term, count(*) AS n FROM t JOIN k USING (lang, term) GROUP BY 1, 2, 3),
        g AS (SELECT a.lang, a.source, coalesce(b.total, 0) AS total, coalesce(v.v, 0) AS v, v.all_total FROM (SELECT DISTINCT lang, source FROM d) a
              LEFT JOIN (SELECT lang, source, sum(n) AS total FROM c GROUP BY 1, 2) b USING (lang, source) LEFT JOIN v USING (lang)),
        p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 5) // (total::HUGEINT + 5 * v) AS p,
              1 + 1000000000::HUGEINT * (all_n + 5) // (all_total::HUGEINT + 5 * v) AS q FROM g JOIN k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
        s AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON b.lang = a.lang AND b.term = a.term AND b.source <> a.source GROUP BY 1, 2, 3),
        o AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(s.value, 0) AS BIGINT) AS value FROM g a JOIN g b ON b.lang = a.lang AND b.source <> a.source
              LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
              UNION ALL SELECT lang, source, 'term', term, CAST(p - q AS BIGINT) FROM p WHERE n > 0 AND p > q),
        x AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM o)
        SELECT * FROM x WHERE part = 'pair' OR rank <= 50"""
