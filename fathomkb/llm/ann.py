"""Approximate nearest neighbours by an inverted multi-index over two halves of the vectors."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut

CODES, SAMPLE, SHARE, BLOCK = 64, 20_000, 0.5, 4_096


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centres = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        near = nearest(x, centres)
        for c in range(len(centres)):
            rows = x[near == c]
            centres[c] = rows.mean(axis=0) if len(rows) else x[rng.integers(len(x))]
    return centres


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres**2).sum(1) - 2 * x @ centres.T, axis=1)


def cells_in_order(a: np.ndarray, b: np.ndarray, counts: dict[int, int], wanted: int) -> list[int]:
    """Centroid pairs by growing a[i] + b[j], from a heap, until their cells hold `wanted` entries."""
    oa, ob = np.argsort(a), np.argsort(b)
    heap, seen, out, have = [(a[oa[0]] + b[ob[0]], 0, 0)], {(0, 0)}, [], 0
    while heap and have < wanted:
        _, i, j = heapq.heappop(heap)
        cell = int(oa[i]) * len(b) + int(ob[j])
        if n := counts.get(cell, 0):
            out.append(cell)
            have += n
        for x, y in ((i + 1, j), (i, j + 1)):
            if x < len(a) and y < len(b) and (x, y) not in seen:
                seen.add((x, y))
                heapq.heappush(heap, (a[oa[x]] + b[ob[y]], x, y))
    return out


def parts_of_cells(counts: dict[int, int], block: int) -> dict[int, tuple[int, int]]:
    """cell -> (part, slices): neighbouring cells share a part of about `block` entries; a larger cell is a part in several slices."""
    out, part, have = {}, 0, 0
    for cell, n in sorted(counts.items()):
        if have and have + n > block:
            part, have = part + 1, 0
        out[cell] = (part, max(1, -(-n // block)))
        have += n
    return out


def scaled(m: np.ndarray) -> np.ndarray:
    """Rows times the power of two that brings their largest component near 1: exact, and no square is too large or small."""
    return np.ldexp(m, -np.frexp(np.abs(m).max(axis=1))[1][:, None])


def nearest_neighbours(vectors: DataFrame, is_query: str = "vec_id % 50 = 0", k: int = 5, codes: int = CODES, sample: int = SAMPLE, share: float = SHARE, block: int = BLOCK) -> DataFrame:
    """vectors (vec_id, embedding) -> query_id, rank, vec_id, score: each query's k nearest others by cosine, in double precision.

    The two halves' codebooks are fitted on at most `sample` vectors (those with the smallest hash of vec_id); every
    vector is indexed. A query visits cells until they hold at least `share` of all distinct vectors, whatever the
    size of the table: isotropic vectors have no near cells, and a recall of 0.9 there takes a share of the table,
    while for clustered ones a far smaller share does. All entries there are reranked on the original vectors. Of equal
    vectors only the k + 1 with the smallest ids are entries: no other copy can be among the k nearest, as ties go to
    the smaller id.

    Neighbouring cells make parts of about `block` entries (a larger cell is sliced), and a query goes once to each part
    where it visits cells, with the list of these; queries at a part are dealt into blocks too. So a task gets a
    bounded part of the entries and of the queries, and vectors are copied by part, not by cell.

    No part take: null ids, null vectors, those of another length than most have, with a null, NaN or infinite
    component, or all zero. Repeated rows count once; rows with the query's id are never its neighbours. Fewer
    candidates than k: all found. Empty table: no rows. Other columns are ignored.
    """
    spark = vectors.sparkSession
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("x"))
    v = v.filter("vec_id is not null and size(x) > 0 and forall(x, c -> c is not null and not isnan(c) and abs(c) < double('infinity')) and exists(x, c -> c <> 0)")
    sizes = v.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    out = "query_id long, rank int, vec_id long, score double"
    if not sizes:
        return spark.createDataFrame([], out)
    dim = sizes[0]["d"]
    half = (dim + 1) // 2
    v = v.filter(f"size(x) = {dim}")
    unit = lambda m: (s := scaled(m)) / np.sqrt((s * s).sum(axis=1, keepdims=True))
    fit = unit(np.array([r["x"] for r in v.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).collect()]))
    books = spark.sparkContext.broadcast((kmeans(fit[:, :half], codes), kmeans(fit[:, half:], codes) if dim > 1 else np.zeros((1, 0))))

    def place(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        one, two = books.value
        for pdf in parts:
            if len(pdf):
                m = unit(np.stack(pdf["x"]))
                yield pdf.assign(cell=nearest(m[:, :half], one) * len(two) + nearest(m[:, half:], two))

    rank = F.row_number().over(Window.partitionBy("x").orderBy("vec_id"))
    entries = v.distinct().withColumn("copy", rank).filter(F.col("copy") <= k + 1)
    entries = cut(entries.mapInPandas(place, "vec_id long, x array<double>, copy int, cell int"), "entries")
    counts = {r["cell"]: (r["n"], r["all"]) for r in entries.groupBy("cell").agg(F.count_if(F.col("copy") == 1).alias("n"), F.count("*").alias("all")).collect()}  # codes ** 2 cells at most
    distinct = {c: n for c, (n, _) in counts.items() if n}
    parts_ = parts_of_cells({c: n for c, (_, n) in counts.items()}, block)
    wanted = int(share * sum(distinct.values()))
    plan = spark.sparkContext.broadcast((distinct, parts_))

    def visit(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """A row for each query and part: the cells that it visits there."""
        one, two = books.value
        distinct, parts_ = plan.value
        for pdf in parts:
            if not len(pdf):
                continue
            m = unit(np.stack(pdf["x"]))
            a = ((m[:, None, :half] - one) ** 2).sum(2)
            b = ((m[:, None, half:] - two) ** 2).sum(2)
            for i in range(len(pdf)):
                by_part: dict[tuple[int, int], list[int]] = {}
                for cell in cells_in_order(a[i], b[i], distinct, max(wanted, k + 1)):
                    by_part.setdefault(parts_[cell], []).append(cell)
                keys = list(by_part)
                yield pd.DataFrame({"query_id": pdf["vec_id"].iloc[i], "q": [pdf["x"].iloc[i]] * len(keys), "part": [p for p, _ in keys], "slices": [n for _, n in keys], "cells": [by_part[p] for p in keys]})

    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    queries = v.filter(is_query).distinct().repartition(tasks, "vec_id").mapInPandas(visit, "query_id long, q array<double>, part int, slices int, cells array<int>")
    queries = cut(queries, "visits")
    table = spark.createDataFrame([(c, p, n) for c, (p, n) in parts_.items()], "cell int, part int, slices int")  # codes ** 2 rows at most
    blocks = queries.groupBy("part").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))  # as many at most
    left = entries.join(F.broadcast(table), "cell").join(F.broadcast(blocks), "part")
    left = left.select("part", F.pmod(F.xxhash64("vec_id"), "slices").cast("int").alias("slice"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "cell", "vec_id", "x")
    right = queries.join(F.broadcast(blocks), "part")
    right = right.select("part", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"), F.pmod(F.xxhash64("query_id"), "blocks").cast("int").alias("block"), "cells", "query_id", "q")

    def rerank(e: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(e) and len(q):
            ids, m = e["vec_id"].to_numpy(), scaled(np.stack(e["x"]))
            size = np.sqrt((m * m).sum(axis=1))
            names, cell = np.unique(e["cell"].to_numpy(), return_inverse=True)
            asked = scaled(np.stack(q["q"]))
            rough = asked @ (m / size[:, None]).T
            for query, x, cells, s in zip(q["query_id"], asked, q["cells"], rough):
                s[~np.isin(names, cells)[cell] | (ids == query)] = -np.inf
                at = np.flatnonzero((s > -np.inf) & (s >= np.partition(s, -k)[-k] - 1e-9 * np.sqrt((x * x).sum()) if len(s) > k else s > -np.inf))
                exact = (m[at] * x).sum(axis=1) / (size[at] * np.sqrt((x * x).sum()))
                best = np.lexsort((ids[at], -exact))[:k]
                rows += zip([query] * len(best), ids[at][best], exact[best])
        return pd.DataFrame(rows, columns=["query_id", "vec_id", "score"])

    by = ["part", "slice", "block"]
    found = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInPandas(rerank, "query_id long, vec_id long, score double")
    place_ = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", place_).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
