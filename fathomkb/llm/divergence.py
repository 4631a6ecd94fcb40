"""How far sources of a language differ from each other and from the language, by the shares of their terms."""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, broadcast_if_small, cut

#: Documents of a language that a kept term is in, added to each count, what shares are parts of, items in a list of terms.
LEAST, PRIOR, WHOLE, TOP = 30, 5, 1_000_000_000, 50
#: Counts that a task gathers before it hands them on; numbers in a block of terms; sources in a block; parts of a first merge.
HELD, CELLS, SOURCES, SALTS = 400_000, 65_536, 256, 32
#: The same runs of characters as [^\x00-\x40\x5B-\x60\x7B-\x7F]+, as UTF-8 in lower case: other than ASCII letters all bytes are of characters beyond ASCII.
TERM = re.compile(rb"[a-z\x80-\xff]+")


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, n, docs) of what a task has read; a null term stands for the group itself."""
    n: dict = defaultdict(Counter)
    docs: dict = defaultdict(Counter)

    def flush() -> pa.RecordBatch:
        rows = [(*g, t, c, docs[g][t]) for g, terms in n.items() for t, c in terms.items()]
        n.clear(), docs.clear()
        columns = list(zip(*rows)) or [()] * 5
        texts = [pa.array(c, pa.binary()).cast(pa.string()) for c in columns[:3]]
        return pa.RecordBatch.from_arrays([*texts, *(pa.array(c, pa.int64()) for c in columns[3:])], ["lang", "source", "term", "n", "docs"])

    for batch in batches:
        held = 0
        for lang, source, text in zip(*(c.to_pylist() for c in batch.columns)):
            found = TERM.findall(text.lower())
            n[lang, source].update(found)
            docs[lang, source].update(set(found))
            n[lang, source][None] += 0
        held = sum(map(len, n.values()))
        if held > HELD:
            yield flush()
    yield flush()


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), docs (documents with it); term null: the group. Null lang, source and text are ''."""
    columns = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).cast("binary").alias(c) for c in ("lang", "source", "text")]
    parts = docs.select(*columns).mapInArrow(_counted, "lang string, source string, term string, n long, docs long")
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: str, total: str, terms: str) -> Column:
    """1 + floor(WHOLE * (count + PRIOR) / (total + PRIOR * terms)) of columns, in decimals, so that no count is too large."""
    return F.expr(f"1 + (cast({count} + {PRIOR} as decimal(20, 0)) * {WHOLE} div cast({total} + {PRIOR} * {terms} as decimal(20, 0)))")


def skyband(rows: pd.DataFrame, k: int = TOP) -> pd.DataFrame:
    """The rows (n, all_n, term) of one group that fewer than k others dominate: by at least as many here, at most as many in all, and an earlier term.

    Whatever dominates a row stands before it in the order of (n descending, all_n, term), and of those only rows that
    are kept need counting: k that dominate it, where they aren't kept themselves, are dominated by k that are.
    """
    if len(rows) <= k:
        return rows
    place = np.empty(len(rows), dtype=np.int64)
    place[sorted(range(len(rows)), key=[t.encode() for t in rows["term"]].__getitem__)] = np.arange(len(rows))
    n, all_n = rows["n"].to_numpy(), rows["all_n"].to_numpy()
    order = np.lexsort((place, all_n, -n))
    kept_all, kept_place, kept, size = np.empty(len(rows), np.int64), np.empty(len(rows), np.int64), [], 0
    for i in order:
        if size < k or np.count_nonzero((kept_all[:size] <= all_n[i]) & (kept_place[:size] < place[i])) < k:
            kept_all[size], kept_place[size] = all_n[i], place[i]
            kept.append(i)
            size += 1
    return rows.iloc[kept]


def _local_skybands(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The skyband of each group within a partition, made anew whenever many rows have come."""
    held, size = [], 0

    def reduced() -> list[pd.DataFrame]:
        return [skyband(g) for _, g in pd.concat(held).groupby(["lang", "source"], sort=False)] if held else []

    for pdf in parts:
        held.append(pdf)
        size += len(pdf)
        if size > HELD:
            held = reduced()
            size = 0
    yield from reduced()


def _distances(pdf: pd.DataFrame, size: int) -> pd.DataFrame:
    """Sums of |p - q| over one block of terms for every two sources of two blocks of sources: idx, term (null: what a term without a row has), p."""
    lang, a, b = pdf["lang"].iloc[0], pdf["a"].iloc[0], pdf["b"].iloc[0]
    rest = pdf[pdf["term"].isna()].sort_values("idx")
    own = pdf[pdf["term"].notna()]
    ids, base = rest["idx"].to_numpy(), rest["p"].to_numpy()
    codes, terms = pd.factorize(own["term"])
    table = np.repeat(base[:, None], len(terms), axis=1)
    table[np.searchsorted(ids, own["idx"].to_numpy()), codes] = own["p"].to_numpy()
    out = []
    for x in np.flatnonzero(ids // size == a):
        others = np.flatnonzero((ids // size == b) & (ids > ids[x]))
        out.append(pd.DataFrame({"lang": lang, "x": ids[x], "y": ids[others], "value": np.abs(table[others] - table[x]).sum(axis=1)}))
    return pd.concat(out) if out else pd.DataFrame({"lang": [], "x": [], "y": [], "value": []})


def _ranked(rows: DataFrame, most: int | None = None) -> DataFrame:
    """rows with their rank within lang and source: by value, largest first, then by item."""
    out = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))
    return out.filter(F.col("rank") <= most) if most else out


def audit(docs: DataFrame, least: int = LEAST, top: int = TOP, size: int = SOURCES) -> DataFrame:
    """lang, source, part, item, value, rank: how far each group (lang, source) of docs is from others. A written table.

    Terms of a language are kept that are in at least `least` of its documents. Shares p are those of share(), of the group and
    of the language. Part "pair": every other source of the language, with the sum of |p - q| over all kept terms (0
    without kept terms). Part "term": the `top` terms that the group has and whose share is larger than in the language.
    Ranks go by value, largest first, ties by the bytes of the item. Null lang, source and text count as ''; groups without
    terms are compared like others; an empty table gives no rows; columns of other names are not read.

    Distances are summed over blocks of terms, each with all sources of the language (in blocks of `size`), so no task
    holds a whole language. For terms, p - q grows with the group's count and falls with the language's, so the first
    `top` are among the rows that fewer than `top` others dominate in both and in the order of bytes: partitions keep
    those, and so do parts of the groups and then the groups, whose remaining terms are ranked.
    """
    with Scratch(docs.sparkSession) as steps:
        counts = steps.cut(term_counts(docs), "counts")
        terms = counts.filter("term is not null").groupBy("lang", "term").agg(F.sum("n").alias("all_n"), F.sum("docs").alias("d"))
        kept = steps.cut(terms.filter(F.col("d") >= least).drop("d"), "kept")
        langs = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("all_n").alias("all_total"))
        rows = steps.cut(counts.filter("n > 0").drop("docs").join(kept, ["lang", "term"]), "rows")
        totals = rows.groupBy("lang", "source").agg(F.sum("n").alias("total"))
        groups = counts.filter("term is null").select("lang", "source").join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
        groups = groups.select("lang", "source", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("total", "v", "all_total")))
        by = Window.partitionBy("lang")  # a row for each source
        groups = groups.withColumn("idx", F.row_number().over(by.orderBy("source")) - 1).withColumn("m", F.count("*").over(by))
        groups = groups.withColumn("bins", F.ceil(F.greatest(F.lit(1), F.col("v") * F.least("m", F.lit(2 * size))) / F.lit(CELLS)).cast("int"))
        groups = steps.cut(groups.withColumn("p0", F.when(F.col("v") > 0, share("0", "total", "v")).otherwise(0)), "groups")
        known = rows.join(broadcast_if_small(groups), ["lang", "source"]).withColumn("p", share("n", "total", "v"))

        # pairs of sources
        cells = known.select("lang", "idx", "m", F.pmod(F.xxhash64("term"), F.col("bins")).cast("int").alias("bin"), "term", "p")
        zeros = groups.select("lang", "idx", "m", F.explode(F.sequence(F.lit(0), F.col("bins") - 1)).alias("bin"), F.lit(None).cast("string").alias("term"), F.col("p0").alias("p"))
        block, last = F.floor(F.col("idx") / F.lit(size)), F.floor((F.col("m") - 1) / F.lit(size))
        with_blocks = F.explode(F.transform(F.sequence(F.lit(0).cast("long"), last), lambda o: F.struct(F.least(block, o).alias("a"), F.greatest(block, o).alias("b"))))
        cells = cells.unionByName(zeros).withColumn("ab", with_blocks).select("lang", "bin", "ab.a", "ab.b", "idx", "term", "p")
        sums = cells.groupBy("lang", "bin", "a", "b").applyInPandas(lambda g: _distances(g, size), "lang string, x long, y long, value long")
        sums = steps.cut(sums.groupBy("lang", "x", "y").agg(F.sum("value").alias("value")), "sums")
        both = sums.unionByName(sums.select("lang", F.col("y").alias("x"), F.col("x").alias("y"), "value"))
        name = lambda c, by: broadcast_if_small(groups.select("lang", F.col("idx").cast("long").alias(by), F.col("source").alias(c)))
        pairs = _ranked(both.join(name("source", "x"), ["lang", "x"]).join(name("item", "y"), ["lang", "y"]))

        # terms that a group has more than its language
        more = known.withColumn("q", share("all_n", "all_total", "v")).filter("p > q")
        more = more.select("lang", "source", "n", "all_n", "term", (F.col("p") - F.col("q")).alias("value"))
        kind = "lang string, source string, n long, all_n long, term string, value long"
        bands = more.mapInPandas(_local_skybands, kind).withColumn("salt", F.spark_partition_id() % SALTS)
        bands = bands.groupBy("lang", "source", "salt").applyInPandas(lambda g: skyband(g.drop(columns="salt"), top), kind)
        bands = bands.groupBy("lang", "source").applyInPandas(lambda g: skyband(g, top), kind)
        terms = _ranked(bands.withColumnRenamed("term", "item"), top)
        out = [x.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank") for part, x in (("pair", pairs), ("term", terms))]
        return cut(out[0].unionByName(out[1]), "divergence")
