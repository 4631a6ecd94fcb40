"""Substring dedup: content-defined chunks from a gear rolling hash, deduplicated by digest."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, hot_keys, join_spread, mix64, slices

LEAST, MOST, MASK_BITS, MIN_WORDS = 16, 256, 5, 50
#: Bytes on each side of a run that are compared with those of another holder.
CONTEXT = 2 * MOST
#: The gear table: a random 32-bit number for each byte value.
GEAR = (mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32)


def gear(data: np.ndarray) -> np.ndarray:
    """h[i] = (h[i-1] << 1) + GEAR[data[i]] in 32 bits; each value depends on the last 32 bytes. By doubling: 5 vector steps."""
    h = GEAR[data]
    for k in (1, 2, 4, 8, 16):
        h[k:] += h[:-k] << np.uint32(k)
    return h


def boundaries(data: np.ndarray, least: int = LEAST, most: int = MOST, bits: int = MASK_BITS) -> list[int]:
    """Ends of the chunks of one text's UTF-8. A chunk ends where bits 11 and up of the hash are zero (a window of 16
    bytes), after `least` bytes; where there is no such place within `most` bytes, after the last of the largest hashes
    there, so that periodic text is cut at its period; never inside a character."""
    n = len(data)
    if not n:
        return []
    mask = np.uint32(((1 << bits) - 1) << (16 - bits))
    whole = np.empty(n, bool)  # the next byte starts a character
    whole[:-1] = (data[1:] & 0xC0) != 0x80
    whole[-1] = True
    h = gear(data)
    ends, last = [], 0
    for e in (np.flatnonzero(((h & mask) == 0) & whole) + 1).tolist() + [n]:
        while e - last > most:
            some = np.where(whole[last + least - 1 : last + most], h[last + least - 1 : last + most], 0)
            last += most - int(some[::-1].argmax())
            while not whole[last - 1]:  # no character ends there
                last += 1
            ends.append(last)
        if e - last >= least or e == n:
            if e > last:
                ends.append(e)
            last = e
    return ends


def word_starts(data: np.ndarray) -> np.ndarray:
    space = data <= 32
    return ~space & np.concatenate([[True], space[:-1]])


def _chunks(least: int, most: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1)
            for a, b in slices(pa.compute.binary_length(column).fill_null(0).to_pylist(), 1 << 20):
                where, starts, stops, words, before, after, digests = [], [], [], [], [], [], []
                for i in range(a, b):
                    raw = (column[i].as_py() or "").encode("utf-8", "surrogatepass")
                    data = np.frombuffer(raw, np.uint8)
                    ends = boundaries(data, least, most, bits)
                    if not ends:
                        continue
                    begin = [0, *ends[:-1]]
                    own = np.add.reduceat(word_starts(data), begin).astype(np.int32)
                    sums = np.concatenate([[0, 0, 0], np.cumsum(own), np.full(2, own.sum())])
                    k = np.arange(len(own)) + 2
                    where += [i] * len(ends)
                    starts += begin
                    stops += ends
                    words.append(own)
                    before.append(sums[k] - sums[k - 2])
                    after.append(sums[k + 3] - sums[k + 1])
                    digests += [xxhash.xxh3_128_digest(raw[x:y]) for x, y in zip(begin, ends)]
                flat = lambda x: pa.array(np.concatenate(x) if x else [], pa.int16())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(where, pa.int64())), pa.array(starts, pa.int32()), pa.array(stops, pa.int32()), flat(words), flat(before), flat(after), pa.array(digests, pa.binary())],
                    ["doc_id", "start", "stop", "words", "before", "after", "digest"],
                )

    return run


def chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, most: int = MOST, bits: int = MASK_BITS) -> DataFrame:
    """doc_id, start, stop (bytes), words (that begin in it), words of the two chunks before and after, digest of every chunk of every text."""
    schema = "doc_id long, start int, stop int, words short, before short, after short, digest binary"
    return docs.selectExpr(f"cast(`{id_col}` as long) doc_id", f"cast(`{text_col}` as string) text").mapInArrow(_chunks(least, most, bits), schema)


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, places) -> the bytes before (side -1) or after (side 1, from one byte before on) each place whose chunk the text holds there."""
    for batch in batches:
        for text, places in zip(batch.column(0), batch.column(1).to_pylist()):
            raw, rows = (text.as_py() or "").encode("utf-8", "surrogatepass"), []
            for p in places:
                if xxhash.xxh3_128_digest(raw[p["start"] : p["stop"]]) == p["digest"]:
                    at = p["start"] if p["side"] < 0 else p["stop"]
                    rows.append((p["holder"], p["side"], at, raw[max(at - CONTEXT, 0) : at] if p["side"] < 0 else raw[max(at - 1, 0) : at + CONTEXT], p["digest"]))
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], ["holder", "side", "at", "bytes", "digest"])


def common_edge(own: bytes, other: bytes, side: int) -> tuple[int, int]:
    """How many bytes two contexts share from the place on, in whole characters, and how many words begin in them."""
    a, b = np.frombuffer(own, np.uint8), np.frombuffer(other, np.uint8)
    if side < 0:
        n = min(len(a), len(b))
        same = a[len(a) - n :][::-1] == b[len(b) - n :][::-1]
        n = n if same.all() else int(same.argmin())
        while n and a[len(a) - n] & 0xC0 == 0x80:
            n -= 1
        return n, int(word_starts(a)[len(a) - n :].sum()) if n else 0
    n = min(len(a), len(b)) - 1
    same = a[1 : n + 1] == b[1 : n + 1]
    n = n if n <= 0 or same.all() else int(same.argmin())
    while 0 < n < len(a) - 1 and a[n + 1] & 0xC0 == 0x80:
        n -= 1
    return max(n, 0), int(word_starts(a)[1 : n + 1].sum()) if n > 0 else 0


EDGE = "doc_id long, side int, at int, more int, words int, part int, last boolean, digest binary, bytes binary"


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted contexts (digest, side, holder, at, bytes) of one partition -> what each shares with the one before and the one after it.

    Of all contexts of a chunk on one side those next to a context share most with it. The first and the last row of the
    partition also come with their bytes, for what lies beyond.
    """
    part, before, held = TaskContext.get().partitionId(), None, None

    def row(x: tuple, best: tuple[int, int], last: bool | None = None) -> tuple:
        return x[2], x[1], x[3], *best, part, last, None if last is None else x[0], None if last is None else x[4]

    def shared(a: tuple | None, b: tuple) -> tuple[int, int]:
        return common_edge(b[4], a[4], b[1]) if a is not None and a[:2] == b[:2] else (0, 0)

    def frame(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), *[pa.int32()] * 5, pa.bool_(), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], [c.split()[0] for c in EDGE.split(", ")])

    for batch in batches:
        rows = []
        for x in zip(*(batch.column(k).to_pylist() for k in range(5))):
            if held is None:
                rows.append(row(x, (0, 0), False))
            else:
                rows.append(row(held, max(shared(before, held), shared(x, held))))
            before, held = held, x
        yield frame(rows)
    if held is not None:
        yield frame([row(held, shared(before, held), True)])


def _extensions(runs: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, side, at, more (bytes), words: how far each edge of a run goes on, by comparison with all runs that end at that chunk and its first and last holder.

    Contexts are sorted by chunk, side and bytes (from the chunk outwards), dealt by ranges, so a chunk of very many
    holders is many tasks. Neighbours in different ranges are compared at the end: two rows a range.
    """
    edge = lambda side, x: F.struct(F.lit(side).alias("side"), F.col(f"{x}.start").alias("start"), F.col(f"{x}.stop").alias("stop"), F.col(f"{x}.digest").alias("digest"), F.col(f"{x}.keeper").alias("keeper"), F.col(f"{x}.last").alias("last"))
    edges = cut(runs.select("doc_id", F.explode(F.array(edge(-1, "first"), edge(1, "final"))).alias("e")).select("doc_id", "e.*"), "edges")
    places = edges.select(F.col("doc_id").alias("holder"), "side", "start", "stop", "digest")
    for other in ("keeper", "last"):
        begin = F.col(f"{other}.start")
        places = places.unionByName(edges.select(F.col(f"{other}.doc_id").alias("holder"), "side", begin.alias("start"), (begin + F.col("stop") - F.col("start")).alias("stop"), "digest"))
    places = places.distinct().groupBy("holder").agg(F.collect_list(F.struct("holder", "side", "start", "stop", "digest")).alias("places"))  # at most two for each chunk of the holder
    texts = docs.select(F.col(id_col).cast("long").alias("holder"), F.col(text_col).cast("string").alias("text"))
    contexts = texts.join(places, "holder").select("text", "places").mapInArrow(_contexts, "holder long, side int, at int, bytes binary, digest binary")
    contexts = contexts.groupBy("digest", "side", "holder", "at").agg(F.max("bytes").alias("bytes"))
    outwards = F.when(F.col("side") < 0, F.reverse(F.hex("bytes"))).otherwise(F.hex(F.substring("bytes", 2, CONTEXT)))
    order = ["digest", "side", "outwards", "holder", "at"]
    contexts = contexts.withColumn("outwards", outwards).repartitionByRange(*order).sortWithinPartitions(*order)
    found = cut(contexts.select("digest", "side", "holder", "at", "bytes").mapInArrow(_neighbours, EDGE), "shared")
    ends = sorted(found.filter("last is not null").select("part", "last", "digest", "side", "doc_id", "at", "bytes").collect(), key=lambda r: (r["part"], r["last"]))  # two rows a range
    across = []
    for a, b in zip(ends, ends[1:]):
        if a["last"] and not b["last"] and (a["digest"], a["side"]) == (b["digest"], b["side"]):
            across += [(x["doc_id"], x["side"], x["at"], *common_edge(x["bytes"], y["bytes"], x["side"])) for x, y in ((a, b), (b, a))]
    found = found.select("doc_id", "side", "at", "more", "words").unionByName(docs.sparkSession.createDataFrame(across, "doc_id long, side int, at int, more int, words int"))
    return found.groupBy("doc_id", "side", "at").agg(F.max(F.struct("more", "words")).alias("m")).select("doc_id", "side", "at", "m.more", "m.words")


def repeated_spans(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Spans that occur several times: doc_id, start, stop (bytes of the UTF-8), words (that begin in it), keeper_id, removable.

    Adjacent chunks each of which occurs elsewhere too make a run. Chunks are cut by content, so text before a passage
    moves no boundary inside it, but the partial chunks at its edges differ: each edge of a run is compared byte by byte
    with those of all runs that end at the same chunk, and with the chunk's first and last occurrence, and moved as far as
    any of them agrees (up to 512 bytes, more than a chunk). Runs of at least min_words words then count. A run is parted into spans
    wherever the keeper changes: the first occurrence of a chunk by doc_id and start keeps it, all others may drop it,
    also within one document; so every repeated chunk stays once, and a span can have fewer words than the run.

    Counting a digest's occurrences is an aggregation with partial results and the join back is on the digests that
    repeat, hot ones dealt over tasks. Runs that could not reach min_words even with the two chunks on each side are
    not compared. Null or empty texts and null ids give no rows; repeated rows, and equal texts under one id, are one
    occurrence; empty table: no rows; other columns are ignored.
    """
    rows = docs.filter(F.col(id_col).isNotNull())
    every = chunks(rows, id_col, text_col)
    place = F.struct("doc_id", "start")
    many = every.groupBy("digest").agg(F.min(place).alias("keeper"), F.max(place).alias("last"), F.count("*").alias("k")).filter("keeper < last")
    many = cut(many, "repeated")
    found = join_spread(every, many.drop("k"), "digest", "doc_id", cut(hot_keys(many, "digest", "k"), "hot"))
    keeps = (F.col("doc_id") == F.col("keeper.doc_id")) & (F.col("start") == F.col("keeper.start"))
    found = found.withColumn("keeps", keeps).distinct()
    order = Window.partitionBy("doc_id").orderBy("start", "stop", "digest")
    gap = F.col("start") > F.coalesce(F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1))
    turn = ~F.struct("keeper.doc_id", "keeps").eqNullSafe(F.lag(F.struct("keeper.doc_id", "keeps")).over(order))
    found = found.withColumn("new", gap.cast("int")).withColumn("turn", turn.cast("int"))
    found = found.withColumn("run", F.sum("new").over(order)).withColumn("part", F.sum(F.greatest("new", "turn")).over(order))
    edge = F.struct("start", "stop", "digest", "keeper", "last", "before", "after")
    parts = found.groupBy("doc_id", "run", "part").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.sum("words").alias("words"), F.first("keeper.doc_id").alias("keeper_id"), F.first("keeps").alias("keeps"), F.min(edge).alias("first"), F.max(edge).alias("final"))
    whole = Window.partitionBy("doc_id", "run")
    parts = parts.withColumns({"first": F.min("first").over(whole), "final": F.max("final").over(whole), "run_words": F.sum("words").over(whole)})
    parts = cut(parts.filter(F.col("run_words") + F.col("first.before") + F.col("final.after") >= min_words), "parts")

    runs = parts.select("doc_id", "run", "run_words", "first", "final").distinct()
    more = _extensions(runs, rows, id_col, text_col)
    side = lambda n, a, b: more.filter(f"side = {n}").select("doc_id", F.col("at").alias(a), F.col("more").alias(b), F.col("words").alias(b + "_words"))
    runs = runs.select("doc_id", "run", "run_words", F.col("first.start").alias("from"), F.col("final.stop").alias("to"))
    runs = runs.join(side(-1, "from", "left"), ["doc_id", "from"], "left").join(side(1, "to", "right"), ["doc_id", "to"], "left").fillna(0)
    # a gap that one run crosses belongs to it: runs that meet count together
    by_doc = Window.partitionBy("doc_id").orderBy("from")
    until, reach = F.lag("to").over(by_doc), F.lag(F.col("to") + F.col("right")).over(by_doc)
    meets = F.coalesce(reach >= F.col("from"), F.lit(False))
    runs = runs.withColumn("meets", meets).withColumn("room", F.col("from") - F.coalesce(until, F.lit(0)))
    runs = runs.withColumn("left_words", F.when(~F.col("meets"), F.col("left_words")).otherwise(0)).withColumn("left", F.when(~F.col("meets"), F.least("left", "room")).otherwise(0))
    runs = runs.withColumn("right", F.least(F.col("right"), F.coalesce(F.lead("from").over(by_doc) - F.col("to"), F.col("right"))))
    runs = runs.withColumn("group", F.sum((~F.col("meets")).cast("int")).over(by_doc))
    total = F.sum(F.col("run_words") + F.col("left_words") + F.col("right_words")).over(Window.partitionBy("doc_id", "group"))
    runs = runs.withColumn("total", total).filter(F.col("total") >= min_words).drop("run_words")
    spans = parts.select("doc_id", "run", "start", "stop", "words", "keeper_id", "keeps").join(runs, ["doc_id", "run"])
    is_first, is_last = F.col("start") == F.col("from"), F.col("stop") == F.col("to")
    return spans.select(
        "doc_id", (F.col("start") - F.when(is_first, F.col("left")).otherwise(0)).alias("start"), (F.col("stop") + F.when(is_last, F.col("right")).otherwise(0)).alias("stop"),
        (F.col("words") + F.when(is_first, F.col("left_words")).otherwise(0) + F.when(is_last, F.col("right_words")).otherwise(0)).alias("words"), "keeper_id", (~F.col("keeps")).alias("removable"),
    )
