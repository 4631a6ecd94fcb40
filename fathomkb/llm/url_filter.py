"""URL filtering by a sorted array of 64-bit xxhash digests that tasks memory-map and probe by binary search."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession

from .common import scratch

Rule = tuple[str, str, str]  # verdict, host, path
#: Rules in one file of an index; more of them make more files.
SHARD = 4_000_000


class DigestIndex:
    """Rules host + path -> verdict as sorted uint64 keys, offsets, verdict bytes and the full strings, in flat files.

    Rules are taken from any iterable (a list, or rows of a DataFrame's toLocalIterator()), `shard` at a time, so the
    driver holds one file's rules at most. Files go to the shared folder and to the executors by SparkContext.addFile;
    tasks map them, so that their pages are shared and only those that a probe touches are read.
    """

    def __init__(self, spark: SparkSession, rules: Iterable[Rule], shard: int = SHARD):
        self.names, labels, lengths = [], set(), set()
        rules = iter(rules)
        while part := list(islice(rules, shard)):
            labels |= {h.count(".") + 1 for _, h, _ in part}
            lengths |= {len(p) for _, _, p in part}
            self.names.append(self._write(spark, part))
        self.labels, self.lengths = sorted(labels), sorted(lengths)

    @staticmethod
    def _write(spark: SparkSession, rules: list[Rule]) -> str:
        texts = [(h + p).encode() for _, h, p in rules]
        keys = np.fromiter(map(xxhash.xxh64_intdigest, texts), np.uint64, len(texts))
        order = np.argsort(keys, kind="stable")
        ends = np.cumsum([0, *(len(texts[i]) for i in order)]).astype(np.uint64)
        path = scratch(spark, "url-digests")
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target)
        strings = (b"".join(texts[i] for i in order[k : k + 100_000]) for k in range(0, len(order), 100_000))
        for data in (np.uint64(len(texts)).tobytes(), keys[order].tobytes(), ends.tobytes(), bytes(rules[i][0] == "block" for i in order), *strings):
            for i in range(0, len(data), 1 << 24):
                out.write(bytearray(data[i : i + (1 << 24)]))
        out.close()
        spark.sparkContext.addFile(path)
        return path.rsplit("/", 1)[1]

    def open(self) -> None:
        self.shards = []
        for name in self.names:
            path = SparkFiles.get(name)
            n = int(np.memmap(path, np.uint64, "r", shape=(1,))[0])
            at = 8 + 8 * n + 8 * (n + 1)
            self.shards.append((np.memmap(path, np.uint64, "r", 8, (n,)), np.memmap(path, np.uint64, "r", 8 + 8 * n, (n + 1,)), np.memmap(path, np.uint8, "r", at)))

    def find(self, texts: list[str]) -> list[str | None]:
        """The verdict of each text that is stored, None for others. Equal digests count only with equal strings."""
        raw = [t.encode("utf-8", "surrogatepass") for t in texts]
        probe = np.fromiter(map(xxhash.xxh64_intdigest, raw), np.uint64, len(raw))
        found: list[str | None] = [None] * len(texts)
        for keys, ends, rest in self.shards:
            n = len(keys)
            at = np.searchsorted(keys, probe)
            for i in np.flatnonzero((at < n) & (keys[np.minimum(at, n - 1)] == probe)):
                k = int(at[i])
                while k < n and keys[k] == probe[i] and found[i] is None:
                    if rest[n + int(ends[k]) : n + int(ends[k + 1])].tobytes() == raw[i]:
                        found[i] = "block" if rest[k] else "allow"
                    k += 1
        return found


A_Z = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def split_url(url: str | None) -> tuple[str, str]:
    """Host and path; both empty for null and for what has no "://"."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    rest = rest.partition("#")[0].partition("?")[0]
    host, slash, path = rest.partition("/")
    return host.translate(A_Z), slash + path


def filter_urls(pages: DataFrame, rules: Iterable[Rule], id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """One row per input row: page_id, host, path, rule, verdict.

    A rule fits its host and that host's subdomains where the url's path starts with the rule's; the longest rule
    (of as long ones, that with the longer host) decides. Urls that the array does not hold get the default.
    Null, empty and malformed urls have an empty host and path and so the default; null ids and repeated rows
    stay as they are; an empty table gives no rows; other columns are ignored; no rules: all get the default.
    """
    index = DigestIndex(pages.sparkSession, rules)

    def best_rules(both: list[tuple[str, str]]) -> list[tuple[int, int, str, str] | None]:
        best: list[tuple[int, int, str, str] | None] = [None] * len(both)
        for n in index.labels:
            tail = [h if h.count(".") + 1 == n else ".".join(h.split(".")[-n:]) if h.count(".") >= n else None for h, _ in both]
            for length in index.lengths:
                rows = [i for i, (_, p) in enumerate(both) if tail[i] is not None and len(p) >= length]
                texts = [tail[i] + both[i][1][:length] for i in rows]
                for i, text, verdict in zip(rows, texts, index.find(texts)):
                    if verdict and (best[i] is None or (len(text), len(tail[i])) > best[i][:2]):
                        best[i] = (len(text), len(tail[i]), text, verdict)
        return best

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index.open()
        for batch in batches:
            both = [split_url(u) for u in batch.column(1).to_pylist()]
            best = best_rules(both)
            columns = ([h for h, _ in both], [p for _, p in both], [b[2] if b else None for b in best], [b[3] if b else default for b in best])
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.string()) for c in columns)], ["page_id", "host", "path", "rule", "verdict"])

    narrow = pages.selectExpr(f"cast(`{id_col}` as long) page_id", f"cast(`{url_col}` as string) url")
    return narrow.mapInArrow(run, "page_id long, host string, path string, rule string, verdict string")
