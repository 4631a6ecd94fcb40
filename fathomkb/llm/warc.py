"""WARC writing, and reading by boundary chains: candidate offsets from byte ranges, then pointer jumping from each file's start."""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import BROADCAST_ROWS, Scratch, broadcast_if_small, cut, hot_keys, join_spread, scratch

MAGIC, GAP = "WARC/1.1\r\n", "\r\n\r\n"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
#: An upper-case base32 SHA-1 of 40 hex digits: each five of them are four base32 digits.
SHA1_BASE32 = """array_join(transform(sequence(0, 31), i -> substring('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + (shiftright(cast(conv(substring({sha}, 1 + 5 * (i div 4), 5), 16, 10) as int), 15 - 5 * (i % 4)) & 31), 1)), '')"""


def _join_groups(left: DataFrame, groups: DataFrame, key: str, by: str) -> DataFrame:
    """left join of groups (key, k rows of left, ...): broadcast while they are few, else with large groups dealt over tasks."""
    if groups.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return left.join(F.broadcast(groups.drop("k")), key, "left")
    return join_spread(left, groups.drop("k"), key, by, hot_keys(groups, key, "k"), "left")


def write_warc(pages: DataFrame, path: str, min_payload: int = 0) -> None:
    """Write a record per row of pages (page_id, url, html) as WARC files in a folder.

    Of equal payloads of at least min_payload bytes, the row with the largest page_id is the response and the
    others are revisits that refer to it; smaller payloads are all responses. Null html is an empty payload, null
    page_id counts as the smallest, null url is empty, white space and control characters of a url are %20. Rows that
    repeat the largest page_id are responses too. An empty table gives files without records.

    Records are joined by Spark's text sink with the WARC record end as separator, so any store that Spark writes to
    will do. Files are not compressed, so that readers can take byte ranges of them. Only digests are shuffled, not
    payloads, unless very many payloads repeat.
    """
    url = F.coalesce(F.regexp_replace(F.col("url").cast("string"), r"[\x00-\x20\x7f]", "%20"), F.lit(""))
    p = pages.select(F.col("page_id").cast("long"), url.alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    p = p.withColumn("sha", F.sha1("html")).withColumn("n", F.octet_length("html"))
    revisit = f"n >= {min_payload} and top is not null and not (page_id <=> top)"
    text = F.expr(f"""concat('WARC/1.1\r\nWARC-Type: ', if({revisit}, 'revisit', 'response'),
        '\r\nWARC-Record-ID: <urn:page:', coalesce(cast(page_id as string), ''), '>\r\nWARC-Date: 2000-01-01T00:00:00Z\r\nWARC-Target-URI: ', url,
        '\r\nWARC-Payload-Digest: sha1:', {SHA1_BASE32.format(sha="sha")}, '\r\nContent-Type: application/http;msgtype=response\r\n',
        if({revisit}, concat('WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: <urn:page:', top, '>\r\n'), ''),
        'Content-Length: ', {len(HTTP)} + if({revisit}, 0, n), '{GAP}{HTTP}', if({revisit}, '', html))""".replace("\r\n", "\\r\\n"))
    with Scratch(pages.sparkSession) as steps:
        repeated = steps.cut(p.groupBy("sha").agg(F.max("page_id").alias("top"), F.count("*").alias("k")).filter("k > 1"), "repeated")
        _join_groups(p, repeated, "sha", "page_id").select(text.alias("value")).write.option("lineSep", GAP).text(path)


FIELDS = {k: re.compile(rb"\r\n" + k.encode() + rb": *([^\r\n]*)") for k in ("WARC-Type", "WARC-Record-ID", "WARC-Target-URI", "WARC-Payload-Digest", "WARC-Refers-To", "Content-Length")}
START = re.compile(rb"(?:\A|(?<=\n))" + re.escape(MAGIC.encode()))
FRAGMENT = "file string, block long, at long, size long, open boolean, type string, record_id string, url string, said_digest string, refers_to string, length long, head long, n long, digest string, bytes binary"


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, bytes]]:
    """(file, block, bytes) of each byte range, from its lines (file, block, value) in order."""
    where, lines = None, []
    for batch in batches:
        for file, block, value in zip(*(c.to_pylist() for c in batch.columns)):
            if (file, block) != where:
                if lines:
                    yield *where, b"\n".join([*lines, b""])
                where, lines = (file, block), []
            lines.append(value)
    if lines:
        yield *where, b"\n".join([*lines, b""])


def _cuts(data: bytes) -> list[tuple[int, int]]:
    """A range cut at each line that is the magic; what comes before the first such line belongs to an earlier range."""
    starts = [m.start() for m in START.finditer(data)]
    edges = sorted({0, *starts, len(data)})
    return list(zip(edges, edges[1:]))


def _parse(piece: bytes) -> tuple:
    """A candidate's fields, content length, where the content starts; payload length and digest if the record is just this piece."""
    end = piece.find(GAP.encode()) if piece.startswith(MAGIC.encode()) else -1
    if end < 0:
        return (None,) * 9
    got = [x[1].decode("utf-8", "replace") if (x := f.search(piece, 0, end)) else None for f in FIELDS.values()]
    length = int(got[5]) if (got[5] or "").isdigit() and len(got[5]) < 16 else None
    n = digest = None
    if length is not None and end + 4 + length + 4 == len(piece):
        body = piece.find(GAP.encode(), end + 4, -4)
        payload = piece[body + 4 if body >= 0 else end + 4 : -4]
        n, digest = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()
    return *got[:5], length, end + 4, n, digest


def _fragments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each cut of a range. Those that are a whole record come without their bytes; others are parts of one at most."""
    names = [c.split()[0] for c in FRAGMENT.split(", ")]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), *[pa.string()] * 5, *[pa.int64()] * 3, pa.string(), pa.binary()]
    for file, block, data in _ranges(batches):
        rows = []
        for a, b in _cuts(data):
            got = _parse(data[a:b])
            rows.append((file, block, a, b - a, b == len(data) and data.startswith(MAGIC.encode(), a), *got, None if got[8] else data[a:b]))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names)


def _contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for file, block, data in _ranges(batches):
        cuts = _cuts(data)
        columns = [pa.array([file] * len(cuts)), pa.array([block] * len(cuts)), pa.array([a for a, _ in cuts]), pa.array([data[a:b] for a, b in cuts], pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["file", "block", "rel", "content"])


def _headers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["file", "at", "type", "record_id", "url", "said_digest", "refers_to", "length", "head"]
    for batch in batches:
        got = [_parse(x)[:7] for x in batch.column(2).to_pylist()]
        columns = [pa.array([g[i] for g in got], pa.string() if i < 5 else pa.int64()) for i in range(7)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names)


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """file, block (start of the byte range that a task reads), value: the lines of the archives, in order."""
    return spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("value"))


#: The bytes of a group's fragments in the order of their offsets.
JOINED = "unhex(array_join(transform(array_sort(collect_list(struct(at, hex(bytes) as bytes))), x -> x.bytes), ''))"


def reachable(jumps: DataFrame) -> DataFrame:
    """jumps (file, at, next) -> (file, at) of what is reached from offset 0 of each file, by pointer jumping.

    Every round doubles the length of the jumps, so a file of n records takes log2(n) rounds. The joins are merge
    joins, as both sides grow with the data.
    """
    with Scratch(jumps.sparkSession) as steps:
        jumps = jumps.select("file", "at", "next")
        reached, count = steps.cut(jumps.filter("at = 0").select("file", "at").distinct(), "reached"), 0
        while (now := reached.count()) != count:
            count = now
            step = reached.hint("merge").join(jumps.hint("merge"), ["file", "at"]).select("file", F.col("next").alias("at"))
            reached = steps.cut(reached.unionByName(step).distinct(), "reached")
            far = jumps.select("file", F.col("at").alias("next"), F.col("next").alias("far"))
            jumps = steps.cut(jumps.hint("merge").join(far.hint("merge"), ["file", "next"]).select("file", "at", F.col("far").alias("next")), "jumps")
        return cut(reached, "reached")


def _with_headers_across_ranges(found: DataFrame) -> DataFrame:
    """found, where a record whose header ends in a later range has its header's fields too."""
    order = Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)  # two rows a byte range
    edges = found.filter("open or type is null and bytes is not null")
    owner = F.last(F.when(F.col("open"), F.struct("at", F.col("head").isNull().alias("cut"))), ignorenulls=True).over(order)
    parts = edges.withColumn("owner", owner).filter("owner.cut")
    if not parts.limit(1).count():
        return found
    whole = parts.groupBy("file", F.col("owner.at").alias("o")).agg(F.expr(JOINED).alias("bytes"))
    names = ["type", "record_id", "url", "said_digest", "refers_to", "length", "head"]
    headers = whole.mapInArrow(_headers, "file string, at long, type string, record_id string, url string, said_digest string, refers_to string, length long, head long")
    headers = headers.select("file", "at", *(F.col(c).alias(f"h_{c}") for c in names))
    return found.join(headers, ["file", "at"], "left").withColumns({c: F.coalesce(c, f"h_{c}") for c in names}).drop(*(f"h_{c}" for c in names))


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The real records of the archives in a folder: file, at, type, record_id, url, refers_to, n, digest (of the payload), said_digest.

    Tasks read byte ranges of the files and cut them at every line that starts a record, be it real or inside a payload.
    Offsets within a range become offsets in the file by the sums of the ranges before it. A cut whose header says that
    a record starts there is a candidate, with the place where its successor should be; only candidates that a chain of
    such jumps from the file's start reaches are records. A task has whole the records inside its range, with their
    digests; of others (those across ranges' edges, and those whose payloads hold lines like a record's start) it
    emits the fragments, which are put together once the chain has told what is real. A folder without records gives
    no rows. Archives must be uncompressed, as byte ranges of a gzip file mean nothing.
    """
    found = cut(_lines(spark, path).mapInArrow(_fragments, FRAGMENT), "fragments")
    ranges = found.groupBy("file", "block").agg(F.sum("size").alias("total"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # a row for each byte range
    base = cut(ranges.select("file", "block", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base")), "ranges")
    found = found.join(broadcast_if_small(base), ["file", "block"]).withColumn("rel", F.col("at")).withColumn("at", F.col("base") + F.col("at"))
    found = cut(_with_headers_across_ranges(found).withColumn("next", F.col("at") + F.col("head") + F.col("length") + len(GAP)), "candidates")
    reached = reachable(found.filter("next is not null")).withColumn("real", F.lit(True))
    found = cut(found.hint("merge").join(reached.hint("merge"), ["file", "at"], "left"), "found")
    out = ["file", "at", "type", "record_id", "url", "refers_to", "n", "digest", "said_digest"]
    whole = found.filter("real and digest is not null").select(*out)
    parted = found.filter("real and length is not null and digest is null")

    # fragments of the others: each belongs to the last parted record before it, as far as that reaches
    order = Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    owner = F.max(F.when(F.col("real") & F.col("next").isNotNull(), F.struct("at", "next", "head", "length"))).over(order)
    some = found.filter("real is null or digest is null").withColumn("owner", owner).filter("at < owner.next")
    some = cut(some.select("file", "block", "rel", "at", "owner", "bytes"), "parts")
    if some.filter("bytes is null").limit(1).count():  # whole records inside payloads
        again = _lines(spark, path).mapInArrow(_contents, "file string, block long, rel long, content binary")
        missing = cut(some.filter("bytes is null").select("file", "block", "rel"), "missing")
        content = again.join(broadcast_if_small(missing), ["file", "block", "rel"])
        some = some.join(content, ["file", "block", "rel"], "left").withColumn("bytes", F.coalesce("bytes", "content")).drop("content")
    text = some.groupBy("file", "owner").agg(F.expr(JOINED).alias("bytes"))
    text = text.select("file", F.col("owner.at").alias("at"), F.expr("substring(bytes, owner.head + 1, owner.length)").alias("content"))
    gap = f"position(unhex('{GAP.encode().hex()}'), content)"
    text = text.withColumn("payload", F.expr(f"if({gap} > 0, substring(content, {gap} + {len(GAP)}), content)"))
    text = text.select("file", "at", F.octet_length("payload").cast("long").alias("n"), F.expr(SHA1_BASE32.format(sha="sha1(payload)")).alias("digest"))
    return whole.unionByName(parted.drop("n", "digest").join(text, ["file", "at"]).select(*out))


def round_trip(pages: DataFrame, min_payload: int = 0) -> DataFrame:
    """Write the pages' archives, read them back: page_id, payload_bytes, payload_digest, record_type, refers_to, digest_ok.

    Length and digest are those of the payload as read; for a revisit, of the response that it refers to. digest_ok
    tells whether the header says the same. See write_warc for nulls, empty payloads and repeated rows.
    """
    spark = pages.sparkSession
    write_warc(pages, path := scratch(spark, "warc"), min_payload)
    number = lambda c: F.nullif(F.regexp_extract(c, r"^<urn:page:(.*)>$", 1), F.lit("")).cast("long")
    said = F.substring_index("said_digest", ":", -1)
    records = read_warc(spark, path).select(number("record_id").alias("page_id"), number("refers_to").alias("refers_to"), "type", "n", "digest", said.alias("said"))
    records = cut(records.withColumn("key", F.concat_ws(":", F.when(F.col("type") == "revisit", F.col("refers_to")).otherwise(F.col("page_id")).cast("string"), "said")), "records")
    referred = records.filter("type = 'revisit'").groupBy("key").agg(F.count("*").alias("k"))
    responses = records.filter("type = 'response' and digest = said").groupBy("key").agg(F.max("n").alias("full"), F.max("digest").alias("full_digest"))
    back = _join_groups(records, cut(referred.join(responses, "key"), "referred"), "key", "page_id")
    revisit = "type = 'revisit'"
    return back.selectExpr("page_id", f"if({revisit}, full, n) payload_bytes", f"if({revisit}, full_digest, digest) payload_digest", "type record_type", "refers_to", f"if({revisit}, full is not null, digest = said) digest_ok")
