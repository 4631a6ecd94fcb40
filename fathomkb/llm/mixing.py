"""Mixing sources to target weights: fixed-length blocks, multinomial draws a shard, pseudorandom permutations, joined by index."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fathomkb.sources.spread import running

from .common import Scratch, broadcast_if_small, cut

#: Words of a block, slots of an output shard, rounds of a permutation; how often a document's words may be taken at most.
BLOCK, SHARD, ROUNDS, MOST = 64, 8192, 12, 3
#: Each source's documents are dealt over so many parts by their digest.
PARTS = 3  # hexadecimal digits
#: Slots that one task makes, and tasks at most.
SLOTS, TASKS = 131_072, 20_000
#: Of the permutations' hash: a prime, 2**31 - 1, and multipliers below it, so that products fit a long.
PRIME, A, B = 2147483647, 1103515245, 739671283
WORD = r"[^\x20\x09-\x0D]+"


def size_of(text: Column) -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _hash60(text: Column) -> Column:
    """60 bits of the md5 of a text."""
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def permuted(x: Column, n: Column, keys: Column, salt: Column) -> Column:
    """The place of x in a pseudorandom permutation of 0 .. n - 1: swap-or-not rounds, each with a key below n.

    A round pairs x with key - x (mod n) and swaps the pair or leaves it by a bit of the larger of the two, so every
    round, and so the whole, is a permutation for any n. All is reckoned in longs, whatever integers are given.
    """
    x, n, keys, salt = x.cast("long"), n.cast("long"), keys.cast("array<long>"), salt.cast("long")

    def step(at: Column, key: Column) -> Column:
        other = (key + n - at) % n
        mixed = (F.greatest(at, other) % PRIME * A + (key + salt) % PRIME * B) % PRIME
        return F.when(F.shiftright(mixed, 13) % 2 == 1, other).otherwise(at)

    return F.aggregate(keys, x, step)


def _round_keys(name: Column, n: Column, rounds: int, seed: int) -> Column:
    text = lambda i: F.concat_ws("|", F.lit(str(seed)), name, i.cast("string"))
    return F.transform(F.array(*map(F.lit, range(rounds))), lambda i: _hash60(text(i)) % F.greatest(n, F.lit(1)))


def weighted(sources: DataFrame, weights: list[int], most: int = MOST, cut: Callable[[DataFrame, str], DataFrame] = cut) -> DataFrame:
    """sources (tree, source_size) with weight and target: by code point, null last, they weigh `weights`, repeating, and share
    all of the words; targets stop at `most` times a source's size, and what is over is shared again by weight."""
    named = running(sources, [], ["tree"], cut=cut)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("before") % len(weights) + 1).cast("int")).cast("long")
    named = named.select("tree", "source_size", weight.alias("weight"))
    full, ratio = F.col("source_size") * most, F.lit(0.0)
    total = named.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("t"), F.coalesce(F.sum("weight"), F.lit(1)).alias("w")).first()
    share, seen = total.t / total.w, -1
    while True:  # each round stops at least one more source
        over = F.col("weight") * F.lit(share) > full
        got = named.agg(F.count_if(over).alias("k"), F.sum(F.when(over, full).otherwise(0)).alias("t"), F.sum(F.when(over, 0).otherwise(F.col("weight"))).alias("w")).first()
        if not got.k or got.k == seen or not got.w:
            break
        seen, share = got.k, (total.t - got.t) / got.w
    target = F.when(over, full.cast("double")).otherwise(F.col("weight") * F.lit(share))
    return named.withColumn("target", target)


def _intervals(parts: DataFrame, length: str, total: int, count: int) -> DataFrame:
    """parts (tree, length, before) as intervals of 0 .. total - 1, each for every bin of width total / count that it reaches: bin, lo, hi, and parts' columns."""
    width = max(1, -(-total // max(1, count)))
    wide = parts.filter(F.col(length) > 0).withColumns({"lo": F.col("before"), "hi": F.col("before") + F.col(length)})
    bins = F.sequence(F.floor(F.col("lo") / F.lit(width)), F.floor((F.col("hi") - 1) / F.lit(width)))
    return wide.withColumn("bin", F.explode(bins)).drop("before")


def _owners(points: DataFrame, intervals: DataFrame, total: int, count: int) -> DataFrame:
    """points (x, ...) with the columns of the interval that holds x: joined by bins, of which there are as many as intervals."""
    width = max(1, -(-total // max(1, count)))
    binned = points.withColumn("bin", F.floor(F.col("x") / F.lit(width)))
    return binned.join(broadcast_if_small(intervals), "bin").filter("lo <= x and x < hi").drop("bin")


def layout(docs: DataFrame, steps: Scratch, carry: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(rows, sources): each row of docs with its place in its source's stream of words, and the sources' sizes.

    rows: tree, rid, doc_id, size, first (words of the source before it), columns of `carry`; sources: tree, source_size. The
    stream of a source runs by digest of id and text, cut in 4,096 parts, which are summed apart.
    """
    # "=" and the name, or "~" for null: never null, and null comes last
    tree = F.coalesce(F.concat(F.lit("="), F.col("`source`").cast("string")), F.lit("~"))
    text = F.col("`text`").cast("string")
    digest = F.md5(F.concat_ws(":", F.col("`doc_id`").cast("string"), text))
    rows = docs.select(tree.alias("tree"), F.monotonically_increasing_id().alias("rid"), F.col("`doc_id`").alias("doc_id"), size_of(text).alias("size"), digest.alias("digest"), *(F.col(f"`{c}`").alias(f"doc_{c}") for c in carry))
    rows = steps.cut(rows, "rows")
    part = F.substring("digest", 1, PARTS)
    sums = rows.groupBy("tree", part.alias("part")).agg(F.sum("size").alias("s"))
    earlier = Window.partitionBy("tree").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # at most 4,096 rows a source
    base = sums.select("tree", "part", F.coalesce(F.sum("s").over(earlier), F.lit(0)).alias("base"))
    own = Window.partitionBy("tree", "part").orderBy("digest", "rid").rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.withColumn("part", part).withColumn("upto", F.sum("size").over(own)).join(base, ["tree", "part"])
    placed = placed.select("tree", "rid", "doc_id", "size", (F.col("base") + F.col("upto") - F.col("size")).alias("first"), *(f"doc_{c}" for c in carry))
    return placed, steps.cut(sums.groupBy("tree").agg(F.sum("s").alias("source_size")), "sources")


def pieces(placed: DataFrame, block: int = BLOCK) -> DataFrame:
    """Rows of layout cut at the ends of blocks: tree, block, rid, doc_id, at (words of the document before it), words, and what is carried.
    A block is a run of `block` words of its source's stream, only the last of a source may be shorter; documents without words give none."""
    last = F.floor((F.col("first") + F.col("size") - 1) / F.lit(block))
    cut = placed.filter("size > 0").withColumn("block", F.explode(F.sequence(F.floor(F.col("first") / F.lit(block)), last)))
    start, end = F.greatest("first", F.col("block") * block), F.least(F.col("first") + F.col("size"), (F.col("block") + 1) * block)
    rest = [c for c in placed.columns if c.startswith("doc_")]
    return cut.select("tree", "block", "rid", (start - F.col("first")).alias("at"), (end - start).alias("words"), *rest)


def draw(sources: DataFrame, steps: Scratch, block: int = BLOCK, shard: int = SHARD, rounds: int = ROUNDS, most: int = MOST, seed: int = 0) -> DataFrame:
    """The mix as blocks: tree, shard, k (the how-manieth of its source), block.

    sources: tree, source_size, target. A source of n blocks is due target / source_size * n slots, rounded, at most most * n. Every
    slot of a shard draws its source by weight, independently of the others (so a shard's counts are multinomial). Draws of a
    source beyond its due are drawn again, along a permutation, among those that are short, which leaves each with exactly its
    due. A source's k-th slot takes the block at place k mod n of its permutation, another permutation each time round, so no
    block is taken more often than the rounded-up quotient.
    """
    spark = sources.sparkSession
    n = F.ceil(F.col("source_size") / F.lit(block))
    due = F.least(F.round(F.col("target") / F.col("source_size") * n).cast("long"), n * most)
    known = sources.filter("source_size > 0").withColumn("n", n).withColumn("due", due)
    known = steps.cut(known.withColumn("keys", _round_keys(F.col("tree"), n, rounds, seed)).select("tree", "n", "due", "keys"), "known")
    count, slots = known.agg(F.count("*"), F.coalesce(F.sum("due"), F.lit(0))).first()
    dealt = steps.cut(_intervals(running(known.select("tree", "due"), [], ["tree"], F.col("due"), steps.cut), "due", slots, count), "intervals")
    x = _hash60(F.concat_ws("|", F.lit(f"{seed}|slot"), F.col("id").cast("string"))) % F.lit(max(1, slots))
    points = spark.range(slots).select(F.floor(F.col("id") / shard).alias("shard"), x.alias("x"))
    drawn = _owners(points, dealt, slots, count).groupBy("shard", "tree", "due").agg(F.count("*").alias("c"))
    earlier = Window.partitionBy("tree").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row for each shard
    drawn = steps.cut(drawn.withColumn("base", F.coalesce(F.sum("c").over(earlier), F.lit(0))), "drawn")
    tasks = min(TASKS, 1 + slots // SLOTS)  # few rows stand for many slots
    upto = lambda a, b: F.explode(F.when(a < b, F.sequence(a, b - 1)))
    kept = drawn.repartition(tasks, "shard", "tree").select("tree", "shard", upto(F.col("base"), F.least(F.col("base") + F.col("c"), F.col("due"))).alias("k"))

    # draws beyond a source's due, numbered by source, fall to units that other sources lack
    totals = drawn.groupBy("tree").agg(F.sum("c").alias("got"))
    state = steps.cut(known.select("tree", "due").join(totals, "tree", "left").withColumn("got", F.coalesce("got", F.lit(0))), "state")
    over = running(state.filter("got > due"), [], ["tree"], F.col("got") - F.col("due"), steps.cut).select("tree", F.col("before").alias("start"))
    short = running(state.filter("got < due").withColumn("lack", F.col("due") - F.col("got")), [], ["tree"], F.col("lack"), steps.cut)
    lacks, rest = state.agg(F.count_if(F.col("got") < F.col("due")), F.coalesce(F.sum(F.greatest(F.col("due") - F.col("got"), F.lit(0))), F.lit(0))).first()
    freed = drawn.join(over, "tree").select("shard", "start", "due", upto(F.greatest("base", "due"), F.col("base") + F.col("c")).alias("k"))
    turn = permuted(F.col("start") + F.col("k") - F.col("due"), F.lit(max(1, rest)), _round_keys(F.lit("again"), F.lit(rest), rounds, seed), F.lit(0))
    turn = freed.select("shard", turn.alias("x"))
    again = _owners(turn, steps.cut(_intervals(short, "lack", rest, lacks), "short"), rest, lacks)
    again = again.select("tree", "shard", (F.col("got") + F.col("x") - F.col("lo")).alias("k"))

    all_ = kept.unionByName(again).join(broadcast_if_small(known), "tree")
    place = permuted(F.col("k") % F.col("n"), F.col("n"), F.col("keys"), F.expr("k div n"))
    return all_.select("tree", "shard", "k", place.alias("block"))


def mix(docs: DataFrame, weights: list[int] = (1, 2, 3), steps: Scratch | None = None, texts: bool = True, block: int = BLOCK, shard: int = SHARD, most: int = MOST, seed: int = 0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(pieces, rows, sources) of a mix of docs (doc_id, text, source): one piece for each part of a document in each slot.

    pieces: shard, k, tree, rid, doc_id, at, words and, with texts, doc_words (the words themselves); rows: every row of docs, with
    rid and size; sources: tree, source_size, weight, target. Slots have `block` words, but for those of a source's last block.
    Null text and text of white space only have no words: they are in no slot. Null sources are one source. An empty table,
    and one without words, gives no pieces. Equal rows stand side by side and may be taken unequally often. Columns of
    other names are not read. All is a function of the rows and the seed, so reruns agree.
    """
    steps = steps or Scratch(docs.sparkSession)
    placed, sizes = layout(docs, steps, ("text",) if texts else ())
    placed = steps.cut(placed, "placed")
    sources = steps.cut(weighted(sizes, list(weights), most, steps.cut), "weighted")
    parts = pieces(placed, block)
    if texts:
        words = F.slice(F.regexp_extract_all("doc_text", F.lit(f"({WORD})")), (F.col("at") + 1).cast("int"), F.col("words").cast("int"))
        parts = parts.withColumn("doc_words", words).drop("doc_text")
    slots = draw(sources, steps, block, shard, ROUNDS, most, seed)
    return slots.join(parts, ["tree", "block"]).drop("block"), placed, sources


def taken(docs: DataFrame, weights: list[int] = (1, 2, 3), block: int = BLOCK, shard: int = SHARD, seed: int = 0) -> DataFrame:
    """doc_id, size, source_size, target, taken: how many words of each document the mix takes, repeats counted. A written table."""
    with Scratch(docs.sparkSession) as steps:
        parts, rows, sources = mix(docs, weights, steps, False, block, shard, seed=seed)
        used = parts.groupBy("rid").agg(F.sum("words").alias("taken"))
        out = rows.select("tree", "rid", "doc_id", "size").join(used, "rid", "left").join(broadcast_if_small(sources), "tree")
        return cut(out.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken")), "taken")
