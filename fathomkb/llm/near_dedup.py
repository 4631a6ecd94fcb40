"""MinHash near-dedup by SuperMinHash signatures, banding, verification on full sets and union-find."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomkb.sources.spread import running

from .common import MASK32, Scratch, broadcast_if_small, cut, join_spread, mix64, packed, slices, small_batches, some_hot
from .graph import components

WORDS, PERCENT = 5, 75
BANDS, ROWS, PARITIES = 32, 4, 1024
#: Classes whose bands one task sorts.
CLASSES = 5_000
NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted 64-bit hashes of a text's distinct word shingles; a text of fewer words is one shingle; no words: empty."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z fold, only 0x20 and 0x09-0x0D split
    n = len(found)
    if not n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, n)
    k = min(n, words)
    acc = h[: n - k + 1] + np.uint64(k)
    for i in range(1, k):
        acc = (acc ^ (acc >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + h[i : n - k + 1 + i]
    return np.unique(mix64(acc))


def superminhash(elements: np.ndarray, owner: np.ndarray, sets: int, m: int) -> np.ndarray:
    """SuperMinHash of `sets` sets at once: (sets, m) of uint64, rank in the high and fraction in the low 32 bits.

    Each element draws a permutation of the m components, one rank per step, and a fresh fraction; a component
    keeps the smallest rank + fraction of any element. Ranks grow with the steps, so a set whose components are
    all filled needs no further step. Sets without elements stay NONE.
    """
    h = np.full(sets * m, NONE)
    perm = None
    for j in range(m):
        z = mix64(elements + np.uint64((j * 0xD1B54A32D192ED03 + 0x2545F4914F6CDD1D) & 0xFFFFFFFFFFFFFFFF))
        k = (np.uint64(j) + (((z >> np.uint64(32)) * np.uint64(m - j)) >> np.uint64(32))).astype(np.int64)
        if j == 0:
            slot, first = k, k
        else:
            rows = np.arange(len(elements))
            slot = perm[rows, k].astype(np.int64)
            perm[rows, k] = perm[:, j]
            perm[:, j] = slot
        np.minimum.at(h, owner * m + slot, (np.uint64(j) << np.uint64(32)) | (z & MASK32))
        open_ = (h.reshape(sets, m) == NONE).any(axis=1)
        left = open_[owner]
        if not left.any():
            break
        elements, owner = elements[left], owner[left]
        if j == 0:
            perm = np.tile(np.arange(m, dtype=np.uint16), (len(elements), 1))
            rows, first = np.arange(len(elements)), first[left]
            perm[rows, first] = 0
            perm[:, 0] = first
        else:
            perm = perm[left]
    return h.reshape(sets, m)


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    part = signature.reshape(len(signature), bands, rows)
    acc = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), part.shape[:2]) * np.uint64(0x9E3779B97F4A7C15)
    for i in range(rows):
        acc = mix64(acc ^ part[:, :, i]) + np.uint64(i)
    return acc.view(np.int64)


def parities(shingles_: np.ndarray, bits: int = PARITIES) -> np.ndarray:
    """For each of `bits` bins the parity of the number of shingles that fall into it, packed into longs.

    A bin differs between two sets only if an odd number of the shingles that just one of them has fall there, so the
    number of bins that differ is never above the size of the symmetric difference.
    """
    odd = np.bincount((shingles_ >> np.uint64(20)).astype(np.int64) & (bits - 1), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _sign(bands: int, rows: int, words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(2)
            for a, b in slices(pa.compute.binary_length(column).fill_null(0).to_pylist(), 1 << 18):
                sets = [shingles(x.as_py(), words) for x in column.slice(a, b - a)]
                sizes = np.array([len(s) for s in sets])
                full = np.flatnonzero(sizes)
                keys: list = [None] * len(sets)
                bits: list = [None] * len(sets)
                if len(full):
                    owner = np.repeat(np.arange(len(full)), sizes[full])
                    signature = superminhash(np.concatenate([sets[i] for i in full]), owner, len(full), bands * rows)
                    for i, key in zip(full, band_keys(signature, bands, rows)):
                        keys[i], bits[i] = key, parities(sets[i])
                digests = [blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
                longs = pa.list_(pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(keys, longs), pa.array(bits, longs)],
                    ["doc_id", "text_hash", "n_shingles", "set_hash", "bands", "parities"],
                )

    return run


def _verify(words: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = lru_cache(64)(lambda key, text: shingles(text, words))
        for batch in batches:
            u, v, ut, vt = (batch.column(i) for i in (0, 1, 4, 5))
            keep = []
            for i in range(batch.num_rows):
                a, b = known(u[i].as_py(), ut[i].as_py()), known(v[i].as_py(), vt[i].as_py())
                both = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(both > 0 and 100 * both >= percent * (len(a) + len(b) - both))
            yield pa.RecordBatch.from_arrays([batch.column(2), batch.column(3)], ["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return run


def _shingle_rows(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                s = shingles(batch.column(2)[i].as_py(), words)
                yield pa.RecordBatch.from_arrays([pa.repeat(batch.column(0)[i], len(s)), pa.repeat(batch.column(1)[i], len(s)), pa.array(s.view(np.int64))], ["cls", "c", "shingle"])

    return run


def _signatures(docs: DataFrame, bands: int, rows: int, words: int) -> DataFrame:
    """doc_id, text_hash, n_shingles, set_hash, bands, parities of each row, written."""
    schema = "doc_id long, text_hash long, n_shingles long, set_hash binary, bands array<long>, parities array<long>"
    with small_batches(docs.sparkSession):
        return cut(docs.select("doc_id", "text_hash", "text").mapInArrow(_sign(bands, rows, words), schema), "signatures")


def _classes(sig: DataFrame) -> DataFrame:
    """One row a distinct set, written: cls (its number), rep (smallest doc_id), text_hash (of one text of rep), n, bands, parities."""
    some = F.min(F.struct("doc_id", "text_hash", "n_shingles", "bands", "parities")).alias("x")
    one = sig.filter("doc_id is not null and set_hash is not null").groupBy("set_hash").agg(some)
    return cut(
        one.select("set_hash", F.monotonically_increasing_id().alias("cls"), F.col("x.doc_id").alias("rep"), "x.text_hash", F.col("x.n_shingles").alias("n"), "x.bands", "x.parities"),
        "classes",
    )


def _shared_ids(sig: DataFrame, classes: DataFrame) -> DataFrame:
    """Links between the classes of ids that have texts with several sets."""
    own = sig.filter("doc_id is not null and set_hash is not null").select("doc_id", "set_hash")
    several = own.groupBy("doc_id").agg(F.min("set_hash").alias("lo"), F.max("set_hash").alias("hi")).filter("lo <> hi").select("doc_id")
    return own.distinct().join(several, "doc_id").join(classes, "set_hash").select(F.col("doc_id").alias("u"), F.col("rep").alias("v"))


def _links(docs: DataFrame, classes: DataFrame, already: DataFrame, steps: Scratch, words: int, percent: int) -> DataFrame:
    """Confirmed links (u, v) of representatives, `already` among them, that connect what is alike (see near_duplicates)."""
    dealt = classes.select("cls", "rep", "n", "bands").repartition(1 + classes.count() // CLASSES)  # a class is a row for each band
    member = dealt.select("cls", "rep", "n", F.explode("bands").alias("band"))
    heads = steps.cut(member.groupBy("band").agg(F.min(F.struct("rep", "cls", "n")).alias("h"), F.count("*").alias("k")).filter("k > 1"), "heads")
    hot = some_hot(heads, "band", "k", steps.cut)
    shared = join_spread(member, heads.select("band", F.col("h.rep").alias("h_rep"), F.col("h.cls").alias("h_cls"), F.col("h.n").alias("h_n")), "band", "cls", hot)
    shared = steps.cut(shared.select("band", "cls", "rep", "n", "h_cls", "h_rep", "h_n"), "buckets")
    near = f"100 * least({{a}}, {{b}}) >= {percent} * greatest({{a}}, {{b}})"  # sets of other sizes cannot reach it
    to_head = shared.filter("cls <> h_cls and " + near.format(a="n", b="h_n"))
    first = steps.cut(to_head.select(F.col("h_cls").alias("u"), F.col("cls").alias("v"), F.col("h_rep").alias("ur"), F.col("rep").alias("vr")).distinct(), "pairs")

    needed = shared.select("cls").distinct().join(classes.select("cls", F.col("rep").alias("doc_id"), "text_hash"), "cls")
    texts = steps.cut(docs.join(needed, ["doc_id", "text_hash"]).select("cls", "text").dropDuplicates(["cls"]), "texts")

    def confirmed(pairs: DataFrame) -> DataFrame:
        """Of pairs of classes those whose full sets are alike; a class in very many pairs is dealt over tasks."""
        rows = pairs
        for side, other, text in (("u", "v", "ut"), ("v", "u", "vt")):
            many = some_hot(pairs.groupBy(side).agg(F.count("*").alias("k")), side, "k", steps.cut)
            rows = join_spread(rows, texts.select(F.col("cls").alias(side), F.col("text").alias(text)), side, other, many)
        with small_batches(docs.sparkSession):
            return steps.cut(rows.select("u", "v", "ur", "vr", "ut", "vt").mapInArrow(_verify(words, percent), "u long, v long"), "links")

    found = already.unionByName(confirmed(first))
    so_far = components(found)
    labelled = steps.cut(shared.join(so_far, F.col("rep") == F.col("id"), "left").select("band", "cls", "rep", "n", F.coalesce("component", "rep").alias("c")), "labelled")
    several = labelled.groupBy("band").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo < hi").select("band")
    mixed = steps.cut(join_spread(labelled, several, "band", "cls", hot), "mixed")
    if not mixed.limit(1).count():
        return found

    # a link between two components rests on shingles that both have: count these for each class
    shingle_rows = mixed.select("cls", "c").distinct().join(texts, "cls").select("cls", "c", "text")
    with small_batches(docs.sparkSession):
        shingle_rows = steps.cut(shingle_rows.mapInArrow(_shingle_rows(words), "cls long, c long, shingle long"), "shingles")
    both = shingle_rows.groupBy("shingle").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count("*").alias("k")).filter("lo < hi").select("shingle", "k")
    both = steps.cut(both, "both")
    outside = join_spread(shingle_rows, both.select("shingle"), "shingle", "cls", some_hot(both, "shingle", "k", steps.cut)).groupBy("cls").agg(F.count("*").alias("s"))
    could = f"{100 + percent} * least({{s}}, {{t}}) >= {percent} * ({{a}} + {{b}})"
    able = mixed.join(outside.join(classes.select("cls", "parities"), "cls"), "cls")
    differ = " + ".join(f"bit_count(parities[{i}] ^ {{other}}[{i}])" for i in range(PARITIES // 64))
    alike = f"{100 + percent} * ({differ}) <= {100 - percent} * (n + {{b}})"
    least = able.groupBy("band").agg(F.min("n").alias("least_n"))
    able = steps.cut(join_spread(able, least, "band", "cls", hot).filter(could.format(s="s", t="s", a="n", b="least_n")).drop("least_n"), "able")

    # the member with the smallest share of shingles of its own is nearest to the others: try it first
    medoid = able.groupBy("band").agg(F.max_by(F.struct("cls", "rep", "n", "c", "s", "parities"), F.struct(F.col("s") / F.col("n"), -F.col("cls"))).alias("m"))
    fits = ["c <> m.c", near.format(a="n", b="m.n"), could.format(s="s", t="m.s", a="n", b="m.n"), alike.format(other="m.parities", b="m.n")]
    pair = join_spread(able, medoid, "band", "cls", hot).filter(" and ".join(fits))
    second = _ordered(pair, "cls", "rep", "m.cls", "m.rep").join(first.select("u", "v"), ["u", "v"], "left_anti")
    second = steps.cut(second, "second")
    found = found.unionByName(confirmed(second))
    so_far = components(found)
    able = steps.cut(able.drop("c").join(so_far, F.col("rep") == F.col("id"), "left").withColumn("c", F.coalesce("component", "rep")).drop("id", "component"), "able")
    size = able.groupBy("band", "c").agg(F.count("*").alias("k")).groupBy("band")
    largest = size.agg(F.max_by("c", F.struct("k", "c")).alias("top"), F.count("*").alias("groups")).filter("groups > 1").drop("groups")
    left = steps.cut(join_spread(able, largest, "band", "cls", hot), "left")
    other = left.filter("c <> top").select("band", *(F.col(x).alias(f"{x}2") for x in ("cls", "rep", "n", "c", "s", "parities")))
    fits = ["c <> c2", near.format(a="n", b="n2"), could.format(s="s", t="s2", a="n", b="n2"), alike.format(other="parities2", b="n2")]
    pair = join_spread(left, other, "band", "cls", hot).filter(" and ".join(fits))
    tried = first.select("u", "v").unionByName(second.select("u", "v"))
    return found.unionByName(confirmed(steps.cut(_ordered(pair, "cls", "rep", "cls2", "rep2").join(tried, ["u", "v"], "left_anti"), "more")))


def _ordered(pairs: DataFrame, a: str, ra: str, b: str, rb: str) -> DataFrame:
    """Distinct u, v (classes), ur, vr (representatives): the class with the smaller representative first, as heads are."""
    lo = F.struct(F.col(ra).alias("r"), F.col(a).alias("c"))
    hi = F.struct(F.col(rb).alias("r"), F.col(b).alias("c"))
    both = pairs.select(F.least(lo, hi).alias("x"), F.greatest(lo, hi).alias("y"))
    return both.select(F.col("x.c").alias("u"), F.col("y.c").alias("v"), F.col("x.r").alias("ur"), F.col("y.r").alias("vr")).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bands: int = BANDS, rows: int = ROWS, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id (smallest linked doc_id), kept.

    Documents link where 100 * intersection >= percent * union of their shingle sets. Candidates share a band of
    their SuperMinHash signatures: at the threshold a pair is missed with chance (1 - 0.75**4)**32 = 5e-6.

    Equal sets become one class first, whatever the number of copies. In each band bucket every class is checked
    against the first; then only buckets that still hold several components are compared further: first against
    the member that shares most, then members outside the largest component against those of others. Classes that
    are already connected need no further pair, so a huge group costs one check a member and band. A link between two
    components can only rest on shingles that both have: these are counted for each class, and a pair is formed only
    if the smaller count could still give the similarity. The count is an upper bound of the intersection, and the
    bins whose parities differ are a lower bound of the symmetric difference, so these filters lose no link. Buckets
    and classes with very many rows are dealt over several tasks.

    Null or empty text: n_shingles 0, a component of its own. Null doc_id: component_id null and kept false; the
    row links nothing. Repeated rows are returned as often as they occur, with one component. Texts under one doc_id
    share its component, and what is like any of them does too. Empty input: no rows. Other columns are ignored.
    """
    text = F.col(text_col).cast("string")
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    sig = _signatures(docs, bands, rows, words)
    classes = _classes(sig)
    with Scratch(docs.sparkSession) as steps:
        final = components(_links(docs, classes, _shared_ids(sig, classes), steps, words, percent))
    of_class = classes.select("set_hash", "rep").join(final, F.col("rep") == F.col("id"), "left").select("set_hash", F.coalesce("component", "rep").alias("component"))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    out = sig.select("doc_id", "n_shingles", "set_hash").join(of_class, "set_hash", "left")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(False)).alias("kept"))


def keep_representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one document of each group of near copies, that with the smallest id; all columns as they were.

    Different texts under one id are documents of their own: the one with the smallest hash counts under the id, the
    others behind all ids, so each stays unless it is a near copy of another. Of rows with equal id and text one stays,
    the first by its JSON. Rows without an id, and null or empty texts, stay. Empty input: no rows.
    """
    text = F.col(text_col).cast("string")
    rows = packed(docs, i=F.col(id_col).cast("long"), h=F.xxhash64(text), text=text)
    pairs = cut(rows.filter("i is not null").groupBy("i", "h").agg(F.count("*").alias("k")), "rows")
    several = pairs.groupBy("i").agg(F.min("h").alias("lo"), F.max("h").alias("hi")).filter("lo <> hi")
    others = cut(pairs.join(several, "i").filter("h > lo").select("i", "h"), "others")
    if others.isEmpty():
        keyed = rows.withColumn("key", F.col("i"))
    else:  # ids may be as large as a long can be, so ids and others are numbered together
        own = pairs.select("i", F.lit(None).cast("long").alias("h")).distinct().unionByName(others.select("i", "h"))
        numbers = running(own.withColumn("behind", F.col("h").isNotNull()), [], ["behind", "i", "h"]).select("i", "h", F.col("before").alias("key"))
        extra = cut(numbers.filter("h is not null"), "numbers")
        base = numbers.filter("h is null").select("i", F.col("key").alias("base"))
        keyed = rows.join(base, "i", "left").join(broadcast_if_small(extra), ["i", "h"], "left").withColumn("key", F.coalesce("key", "base")).drop("base")
    copies = near_duplicates(keyed, "key", "text").filter("doc_id is not null and not kept").select(F.col("doc_id").alias("key")).distinct()
    rest = keyed.join(copies, "key", "left_anti").select("row", "i", "h")
    repeats = cut(pairs.filter("k > 1").select("i", "h"), "repeats")
    if not repeats.limit(1).count():
        return rest.select("row.*")
    repeats = broadcast_if_small(repeats)
    one = rest.join(repeats, ["i", "h"], "left_semi").groupBy("i", "h").agg(F.min_by("row", F.to_json("row")).alias("row"))
    return rest.join(repeats, ["i", "h"], "left_anti").select("row.*").unionByName(one.select("row.*"))
