"""Benchmark decontamination on canonical templates: hash-joined windows with a check that slots agree."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, cut, mix64, packed, slices

WINDOW, SHARE, BLOOM_BITS = 5, 0.75, 1 << 24
#: A window is evidence only with this many words that are no placeholders.
PLAIN = 2
#: Words that stand for a unit where a number stands before them, and words that are numbers.
UNITS = frozenset(
    b"mm cm m km in inch inches ft foot feet yd yard yards mile miles mg g kg t lb lbs oz ml l litre litres liter liters gallon gallons "
    b"ms s sec second seconds min minute minutes h hour hours day days week weeks month months year years "
    b"eur euro euros usd dollar dollars gbp pound pounds cent cents percent % degrees w kw v a hz khz mhz kb mb gb tb".split()
)
NUMBERS = frozenset(
    b"two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen "
    b"twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million dozen".split()
)
EDGE = "".join(chr(c) for c in range(128) if not chr(c).isalnum() and chr(c) != "%")
DIGITS = frozenset("0123456789")
NUM, UNIT, NAME = (xxhash.xxh3_64_intdigest(x) for x in (b"<num>", b"<unit>", b"<name>"))
IS_NUM, IS_UNIT, IS_NAME, ENDS = 1, 2, 4, 8


def bare(word: bytes) -> str:
    """A word without ASCII marks at its edges."""
    return word.decode("utf-8", "surrogatepass").strip(EDGE)


class _Words(dict):
    """word -> its number; arrays give, by number, the hash of the lower-cased word and its marks."""

    def __init__(self, most: int = 300_000):
        self.most = most
        self.reset()

    def reset(self) -> None:
        self.clear()
        self.n, self.plain, self.mark = 0, np.empty(1024, np.uint64), np.empty(1024, np.uint8)

    def __missing__(self, word: bytes) -> int:
        core, n = bare(word), self.n
        low = core.lower().encode("utf-8", "surrogatepass")
        mark = ENDS if word[-1:] in b".!?" else 0
        if core[:1] in DIGITS or core[-1:] in DIGITS or low in NUMBERS:
            mark |= IS_NUM
        else:
            mark |= IS_UNIT if low in UNITS else 0
            mark |= IS_NAME if len(core) > 1 and core[:1].isupper() and core[1:].islower() else 0
        if n == len(self.plain):
            self.plain, self.mark = np.concatenate([self.plain, self.plain]), np.concatenate([self.mark, self.mark])
        self.plain[n], self.mark[n] = xxhash.xxh3_64_intdigest(low or word), mark
        self[word] = n
        self.n = n + 1
        return n


class Templates:
    """The template tokens of several texts at once: hash, whether it is a placeholder, its first word, its text.

    Numbers, units after a number, and names are placeholders; consecutive names are one. Three variants differ in what
    is a name: capitalised words inside a sentence, those at its start too, or none.
    """

    def __init__(self, known: _Words, texts: list[list[bytes]]):
        if known.n > known.most:
            known.reset()
        self.words = [w for words in texts for w in words]
        at = np.fromiter(map(known.__getitem__, self.words), np.int64, len(self.words))
        self.owner = np.repeat(np.arange(len(texts)), [len(words) for words in texts])
        new = np.ones(len(at), bool)
        new[1:] = self.owner[1:] != self.owner[:-1]
        self.plain, mark = known.plain[at], known.mark[at]
        self.number = (mark & IS_NUM) > 0
        before = np.zeros(len(at), bool)
        before[1:] = self.number[:-1] & ~new[1:]
        self.unit = ((mark & IS_UNIT) > 0) & before
        start = new.copy()
        start[1:] |= (mark[:-1] & ENDS) > 0
        capital = ((mark & IS_NAME) > 0) & ~self.unit
        self.names, self.new = (capital & ~start, capital, np.zeros(len(at), bool)), new

    def variant(self, v: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(hash, placeholder, owner, first word) of the tokens."""
        name = self.names[v]
        follows = np.zeros(len(name), bool)
        follows[1:] = name[1:] & name[:-1] & ~self.new[1:]
        first = np.flatnonzero(~follows)
        h = np.where(self.number, np.uint64(NUM), np.where(self.unit, np.uint64(UNIT), np.where(name, np.uint64(NAME), self.plain)))
        return h[first], (self.number | self.unit | name)[first], self.owner[first], first

    def slot(self, first: np.ndarray, token: int) -> str:
        """The words of a token, lower-cased and without marks at their edges."""
        stop = first[token + 1] if token + 1 < len(first) else len(self.words)
        return " ".join(bare(w).lower() for w in self.words[first[token] : stop])


def window_hashes(h: np.ndarray, k: int) -> np.ndarray:
    n = len(h) - k + 1
    if n < 1:
        return np.empty(0, np.uint64)
    acc = h[:n] + np.uint64(k)
    for i in range(1, k):
        acc = (acc ^ (acc >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n]
    return mix64(acc)


def _windows(sizes: list[int] | None, bloom, window: int, plain: int):
    """Rows of a text's template windows that are evidence; with a Bloom filter, only of those that it holds.

    sizes None: a text's windows, or the whole text if it is shorter than a window. `total` counts a text's windows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, bits = _Words(), None if bloom is None else bloom.value
        for batch in batches:
            column = batch.column(1)
            for a, b in slices(pa.compute.binary_length(column).fill_null(0).to_pylist(), 1 << 20):
                texts = [(x.as_py() or "").encode("utf-8", "surrogatepass").split() for x in column.slice(a, b - a)]
                made = Templates(known, texts)
                where, rows = [], []
                for v in range(3):
                    h, slot, owner, first = made.variant(v)
                    size = np.bincount(owner, minlength=len(texts))
                    solid = np.concatenate([[0], np.cumsum(~slot)])
                    for k in range(1, window + 1) if sizes is None else sizes:
                        keys = window_hashes(h, k)
                        n = len(keys)
                        real = owner[:n] == owner[k - 1 :]
                        real &= solid[k : n + k] - solid[:n] >= plain
                        if sizes is None and k < window:
                            real &= size[owner[:n]] == k
                        if bits is not None:
                            real &= ((bits[(keys >> np.uint64(3)) & np.uint64(len(bits) - 1)] >> (keys & np.uint64(7)).astype(np.uint8)) & 1) > 0
                        hits = np.flatnonzero(real)
                        total = np.bincount(owner[hits], minlength=len(texts))
                        begin = np.searchsorted(owner, np.arange(len(texts)))
                        for j in hits.tolist():
                            i = int(owner[j])
                            slots = [made.slot(first, j + y) if slot[j + y] else None for y in range(k)]
                            where.append(a + i)
                            rows.append((v, j - int(begin[i]), int(keys[j].view(np.int64)), slots, int(total[i])))
                kinds = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.string()), pa.int32()]
                out = [pa.array([r[c] for r in rows], t) for c, t in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(where, pa.int64())), *out], ["id", "variant", "at", "key", "slots", "total"])

    return run


SCHEMA = "variant int, at int, key long, slots array<string>, total int"


def contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: float = SHARE, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc_id, item_id, matched, windows, containment of each pair where a document holds at least `share` of an item's template windows.

    Words are taken at white space, lower-cased and freed of punctuation at their edges. Numbers (tokens that begin or
    end in a digit, and number words from two on), units of measure after a number, and names (runs of capitalised
    words, one slot each) become typed placeholders, so a question with other numbers or names has the same windows. A
    capitalised word at a sentence's start may be a name or not, and case may be lost, so windows are joined in three
    variants: with names inside sentences only, with sentence starts as names too, and without names; the variant
    that holds the largest share of the item's windows counts. In each, along one alignment (document position less
    item position) each slot value of the item must stand for one value in the document; if it doesn't, only the
    windows without slots count there. Windows of fewer than two plain words are no evidence and are not counted at
    all. An item of fewer words than a window is one window of that many words; an item without a window that is
    evidence (no words, one word, placeholders only) matches nothing.

    The benchmark's windows make a Bloom filter of a fixed size; what passes it in a document is hash-joined with the
    windows themselves (broadcast only while they are few), so a larger benchmark lets more through but changes no
    result. Null or empty texts match nothing; rows of one id (null is one of its own) count as one document, so give
    rows ids of their own where they aren't; texts under one item_id are items of their own, of which the best counts;
    empty tables give no rows; other columns are ignored. doc_id keeps its type.
    """
    spark = docs.sparkSession
    items = benchmark.selectExpr(f"cast(`{item_col}` as long) item_id", f"cast(`{item_text}` as string) text").distinct()
    items = cut(items.select(F.monotonically_increasing_id().alias("id"), "item_id", "text"), "items")
    wanted = cut(items.select("id", "text").mapInArrow(_windows(None, None, window, PLAIN), "id long, " + SCHEMA), "windows").withColumn("k", F.size("slots"))
    sizes = sorted(r["k"] for r in wanted.select("k").distinct().collect())  # at most `window` values
    # one bit a key, OR-ed by position on the executors: the driver gets a row a byte of the filter at most
    place = wanted.select(F.expr(f"cast(shiftrightunsigned(key, 3) & {BLOOM_BITS // 8 - 1} as int)").alias("p"), F.expr("cast(shiftleft(1, cast(key & 7 as int)) as int)").alias("b"))
    places = place.groupBy("p").agg(F.bit_or("b").alias("b")).toPandas()
    bits = np.zeros(BLOOM_BITS // 8, np.uint8)
    bits[places["p"].to_numpy(np.int64)] = places["b"].to_numpy(np.uint8)

    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    kind = texts.schema["id"].dataType.simpleString()
    found = cut(texts.mapInArrow(_windows(sizes, spark.sparkContext.broadcast(bits), window, PLAIN), f"id {kind}, " + SCHEMA), "hits").drop("total")
    sought = wanted.select("variant", "key", F.col("id").alias("item"), F.col("at").alias("item_at"), F.col("slots").alias("item_slots"), "total")
    both = found.join(broadcast_if_small(sought), ["variant", "key"])
    pairs = F.expr("filter(arrays_zip(item_slots, slots), x -> x.item_slots is not null)")
    along = both.withColumn("pairs", pairs).groupBy("id", "item", "total", "variant", (F.col("at") - F.col("item_at")).alias("shift")).agg(
        F.array_distinct(F.flatten(F.collect_set("pairs"))).alias("pairs"), F.collect_set("item_at").alias("all"), F.collect_set(F.when(F.size("pairs") == 0, F.col("item_at"))).alias("plain")
    )
    agree = F.size("pairs") == F.size(F.array_distinct(F.expr("transform(pairs, x -> x.item_slots)")))
    held = along.select("id", "item", "total", "variant", F.explode(F.when(agree, F.col("all")).otherwise(F.col("plain"))).alias("item_at")).distinct()
    out = held.groupBy("id", "item", "total", "variant").agg(F.count("*").alias("matched")).filter(F.col("matched") >= share * F.col("total"))
    best = F.max(F.struct((F.col("matched") / F.col("total")).alias("containment"), "matched", F.col("total").cast("long").alias("windows"))).alias("b")
    out = out.join(items.select(F.col("id").alias("item"), "item_id"), "item").groupBy("id", "item_id").agg(best)
    return out.select(F.col("id").alias("doc_id"), "item_id", "b.matched", "b.windows", "b.containment")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that hold a benchmark item; all columns as they were.

    Each row is judged by its own text, whatever its id: rows are known by 128 bits of id and text, so only equal rows
    are one. Null and empty texts stay; an empty benchmark or table of documents drops nothing.
    """
    text = F.col(text_col).cast("string")
    own = F.concat_ws(":", F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.xxhash64(text, F.lit(1)).cast("string"), F.xxhash64(text, F.lit(2)).cast("string"))
    rows = packed(docs, key=own, text=text)
    leaks = contaminated(rows, benchmark, id_col="key").select(F.col("doc_id").alias("key")).distinct()
    return rows.join(leaks, "key", "left_anti").select("row.*")
