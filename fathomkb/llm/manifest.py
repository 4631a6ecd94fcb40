"""Merkle manifest of a dataset: a tree for each source and one over their roots; only every few levels are stored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomkb.sources.spread import running

from .common import Scratch

COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
#: Children of a node; levels from one stored level to the next, so that a stored block has at most FANOUT ** EVERY nodes.
FANOUT, EVERY = 3, 4


def leaf_digest(*values: Column) -> Column:
    """Hex sha256 of the values one after another, each "-" if null, else its UTF-8 byte count, ":", and itself as text."""
    text = [v.cast("string") for v in values]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in text)), 256)


def _powers(fanout: int) -> list[int]:
    out = [1]
    while out[-1] * fanout < 2**63:
        out.append(out[-1] * fanout)
    return out


def _height(n: Column, fanout: int) -> Column:
    """Levels above n leaves, until one node remains."""
    return F.size(F.filter(F.array(*map(F.lit, _powers(fanout))), lambda p: p < n))


def _levels(nodes: Column, steps: Column, fanout: int, every: int) -> Column:
    """The nodes of an aligned subtree and the levels above them, `steps` of them: what isn't stored is made again from what is."""
    run = lambda level, j: F.sha2(F.array_join(F.slice(level, j * fanout + 1, F.lit(fanout)), ""), 256)
    up = lambda level: F.transform(F.sequence(F.lit(0), F.ceil(F.size(level) / F.lit(fanout)).cast("int") - 1), lambda j: run(level, j))
    todo = F.slice(F.array(*map(F.lit, range(every))), F.lit(1), steps)
    return F.aggregate(todo, F.array(nodes), lambda made, _: F.concat(made, F.array(up(F.element_at(made, -1)))))


def _path(levels: Column, place: Column, steps: Column, fanout: int, every: int) -> Column:
    """The siblings of the node at `place` (from 0) of a subtree's lowest level, a pair (left, right) of joined digests for each level."""

    def pair(k: Column) -> Column:
        at = F.floor(place / F.element_at(F.array(*(F.lit(fanout**i) for i in range(every))), k + 1)).cast("int")
        level, own = F.element_at(levels, k + 1), at % fanout
        left = F.slice(level, at - own + 1, own)
        right = F.slice(level, at + 2, F.lit(fanout - 1) - own)
        return F.struct(F.array_join(left, "").alias("left"), F.array_join(right, "").alias("right"))

    return F.transform(F.slice(F.array(*map(F.lit, range(every))), F.lit(1), steps), pair)


def _blocks(nodes: DataFrame, fanout: int, every: int) -> DataFrame:
    """nodes (tree, n, position, digest, row) by aligned subtrees of `every` levels: tree, n, block, nodes, rows."""
    block = F.floor(F.col("position") / F.lit(fanout**every)).cast("long")
    members = F.array_sort(F.collect_list(F.struct("position", "digest", "row")))
    out = nodes.groupBy("tree", "n", block.alias("block")).agg(members.alias("m"))
    return out.select("tree", "n", "block", F.col("m.digest").alias("nodes"), F.col("m.row").alias("rows"))


def _forest(nodes: DataFrame, folder: str, fanout: int, every: int) -> None:
    """Store nodes (tree, n, position, digest, row) under folder: level-0, level-1, ... of blocks, and roots (tree, n, stored, root).

    A level has one row for each aligned subtree of the level before it, so each is about a fanout ** every-th of that.
    `stored` is the number of the level that holds a tree's root.
    """
    spark, k, height = nodes.sparkSession, 0, _height(F.col("n"), fanout)
    while True:
        _blocks(nodes, fanout, every).write.parquet(f"{folder}/level-{k}")
        blocks = spark.read.parquet(f"{folder}/level-{k}")
        levels = _levels(F.col("nodes"), F.least(F.lit(every), height - k * every), fanout, every)
        tops = blocks.select("tree", "n", "block", F.element_at(F.element_at(levels, -1), 1).alias("digest"))
        done = height <= (k + 1) * every
        tops.filter(done).select("tree", "n", F.lit(k).alias("stored"), F.col("digest").alias("root")).write.mode("append").parquet(f"{folder}/roots")
        if not blocks.filter(~done).limit(1).count():
            return
        nodes = tops.filter(~done).select("tree", "n", F.col("block").alias("position"), "digest", F.lit(None).cast("string").alias("row"))
        k += 1


def _descend(spark: SparkSession, folder: str, top: DataFrame, last: int, fanout: int, every: int) -> DataFrame:
    """tree, n, position, digest, row, path, subroot, root of each leaf, from top (tree, stored, path, subroot, root).

    Starts at each tree's highest stored level. A block makes the missing levels of its subtree again, gives each of
    its nodes the siblings on them, followed by those of the block's own way up, and forgets them.
    """
    above = None
    for k in range(last, -1, -1):
        start = top.filter(F.col("stored") == k).select("tree", F.lit(0).cast("long").alias("block"), F.col("path").alias("above"), "subroot", "root")
        above = start if above is None else above.unionByName(start)
        steps = F.least(F.lit(every), _height(F.col("n"), fanout) - k * every)
        made = spark.read.parquet(f"{folder}/level-{k}").join(above, ["tree", "block"]).withColumn("steps", steps)
        made = made.withColumn("levels", _levels(F.col("nodes"), F.col("steps"), fanout, every))
        member = lambda d, i: F.struct(i.alias("i"), d.alias("digest"), F.element_at("rows", i + 1).alias("row"), F.concat(_path(F.col("levels"), i, F.col("steps"), fanout, every), F.col("above")).alias("path"))  # noqa: E731, B023
        made = made.select("tree", "n", "block", "subroot", "root", F.explode(F.transform("nodes", member)).alias("m"))
        made = made.select("tree", "n", (F.col("block") * fanout**every + F.col("m.i")).alias("position"), "m.digest", "m.row", "m.path", "subroot", "root")
        above = made.select("tree", F.col("position").alias("block"), F.col("path").alias("above"), "subroot", "root")
    return made


def _last(spark: SparkSession, folder: str) -> int:
    return spark.read.parquet(f"{folder}/roots").agg(F.max("stored")).first()[0] or 0


def build(docs: DataFrame, folder: str, received: dict[str, Column] | None = None, columns: tuple[str, ...] = COLUMNS, tree: str = "source", order: str = "doc_id", fanout: int = FANOUT, every: int = EVERY) -> None:
    """Write the manifest of docs to folder: the blocks of every `every`-th level of each source's tree, and of the tree over the sources.

    A leaf is leaf_digest of `columns`. Leaves ascend by `order` (null first; equal ones by digest, so that repeated rows
    stand side by side), every `fanout` consecutive nodes become one, until one remains: the source's subroot. Subroots
    ordered by source (null first, then by bytes) become the root in the same way. received gives columns as they arrived,
    for verify. Numbers are dealt by ranges, so one source may hold most rows. An empty table gives empty trees; null and
    empty values differ; columns of other names are not read.
    """
    spark = docs.sparkSession
    own = {c: F.col(f"`{c}`") for c in columns}
    arrived = leaf_digest(*(own | (received or {})).values()) if received else None
    # "-" for a null source, else "=" and its name: never null, and in the same order
    key = F.coalesce(F.concat(F.lit("="), F.col(f"`{tree}`").cast("string")), F.lit("-"))
    leaves = docs.select(key.alias("tree"), F.col(f"`{order}`").alias("id"), leaf_digest(*own.values()).alias("digest"), (arrived if received else F.lit(None).cast("string")).alias("arrived"), F.monotonically_increasing_id().alias("tie"))
    with Scratch(spark) as steps:
        leaves = running(steps.cut(leaves, "leaves"), ["tree"], ["id", "digest", "tie"], cut=steps.cut)
        nodes = leaves.select("tree", F.col("total").alias("n"), F.col("before").alias("position"), "digest", F.struct("id", F.coalesce("arrived", "digest").alias("arrived")).alias("row"))
        _forest(nodes, f"{folder}/sources", fanout, every)
        tops = running(spark.read.parquet(f"{folder}/sources/roots"), [], ["tree"], cut=steps.cut)
        nodes = tops.select(F.lit("").alias("tree"), F.col("total").alias("n"), F.col("before").alias("position"), F.col("root").alias("digest"), F.struct("tree", "stored").alias("row"))
        _forest(nodes, f"{folder}/top", fanout, every)


def proofs(spark: SparkSession, folder: str, fanout: int = FANOUT, every: int = EVERY) -> DataFrame:
    """tree, n, position, id, leaf, arrived, path, subroot, root of each leaf of the manifest in folder.

    path has a pair (left, right) for each level from the leaf to the root: the run's digests before and after the
    node's own, joined. A source of one row has no level of its own, one source no level above its subroot.
    """
    last = _last(spark, f"{folder}/top")
    empty = F.array().cast("array<struct<left:string,right:string>>")
    top = spark.read.parquet(f"{folder}/top/roots").select("tree", "stored", empty.alias("path"), F.col("root").alias("subroot"), "root")
    tops = _descend(spark, f"{folder}/top", top, last, fanout, every)
    tops = tops.select("row.tree", "row.stored", "path", F.col("digest").alias("subroot"), "root")
    rows = _descend(spark, f"{folder}/sources", tops, _last(spark, f"{folder}/sources"), fanout, every)
    return rows.select("tree", "n", "position", "row.id", F.col("digest").alias("leaf"), "row.arrived", "path", "subroot", "root")


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and the siblings on its way up give."""
    return F.aggregate(path, leaf, lambda at, x: F.sha2(F.concat(x["left"], at, x["right"]), 256))


def siblings(path: Column) -> Column:
    """All digests of a path as one text: level by level from the leaf, left to right."""
    return F.array_join(F.transform(path, lambda x: F.concat(x["left"], x["right"])), "")


def verify(spark: SparkSession, folder: str, fanout: int = FANOUT, every: int = EVERY) -> DataFrame:
    """proofs with folded_root, made from what arrived and the siblings, and verified: whether that is the root."""
    out = proofs(spark, folder, fanout, every).withColumn("folded_root", fold(F.col("arrived"), F.col("path")))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
