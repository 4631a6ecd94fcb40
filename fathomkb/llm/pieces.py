"""SentencePiece encoding and decoding with exact N-best segmentation over the piece lattice."""

from __future__ import annotations

import heapq
import re
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from .common import slices

MODEL, NBEST = "/opt/tokenizers/piece_bpe_32k.model", 4
SENTINEL, CACHE, WINDOWS = -1e8, 12_000_000, 100_000
MARKS = ".,!*#%$&|?;:"

Path = tuple[int, tuple[int, ...]]  # score, ids


NEVER, FAR = -(1 << 62), 1 << 62


class _Part(dict):
    """unit -> where its ids, score and gap (see unit_best) stand in flat arrays; what is missing comes from an older part or is made."""

    def __init__(self, make, old=None):
        self.make, self.old, self.size = make, old, 0
        self.ids, self.ends, self.scores, self.gaps = array("i"), array("q", [0]), array("q"), array("q")

    def __missing__(self, s: str) -> int:
        ids, score, gap = self.old.row(s) if self.old and s in self.old else self.make(s)
        self.ids.extend(ids)
        self.ends.append(len(self.ids))
        self.scores.append(score)
        self.gaps.append(gap)
        self.size += len(s) + 20
        self[s] = at = len(self.gaps) - 1
        return at

    def row(self, s: str) -> tuple:
        at = self[s]
        return self.ids[self.ends[at] : self.ends[at + 1]], self.scores[at], self.gaps[at]


class _Known:
    """unit -> unit_best(unit), of bounded memory, counted in characters: when half is full, trim() lets the older half go."""

    def __init__(self, make):
        self.part = _Part(make)

    def trim(self) -> None:
        if self.part.size >= CACHE:
            self.part.old = None
            self.part = _Part(self.part.make, self.part)

    def __getitem__(self, s: str) -> tuple:
        ids, score, gap = self.part.row(s)
        return tuple(ids), score, gap


class Lattice:
    """The pieces of a model with integer scores, and segmentations of texts over them.

    White space is matched as itself, so that a text's own U+2581 stays apart and comes back from decode(). A
    character without a piece of its own is one edge of its UTF-8 byte pieces, ten below the least score of a piece.
    """

    def __init__(self, proto: bytes):
        sp = sentencepiece.SentencePieceProcessor(model_proto=proto)
        n = sp.get_piece_size()
        normal = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        pieces = {sp.id_to_piece(i).replace("▁", " "): (i, int(sp.get_score(i))) for i in normal}
        self.bytes_ = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.unknown = int(min(s for _, s in pieces.values() if s > SENTINEL)) - 10
        self.longest = max(map(len, pieces))
        self.prefix: dict[str, tuple[int, int] | None] = {}
        for p in pieces:
            for k in range(1, len(p)):
                self.prefix.setdefault(p[:k], None)
        self.prefix |= pieces
        self.raw = [b""] * n
        for p, (i, _) in pieces.items():
            self.raw[i] = p.encode()
        for b, i in enumerate(self.bytes_):
            self.raw[i] = bytes([b])
        alone = all(" " not in p.lstrip(" ") for p in pieces)
        breaks = "".join(c for c in "\n\t\r" if not any(c in p for p in pieces))
        # no piece reaches over the edge of a unit: a space, a break, or a mark after a character that no piece has before it
        before: dict[str, set[str]] = {}
        for p in pieces:
            for x, y in zip(p, p[1:]):
                before.setdefault(y, set()).add(x)
        go_on = "".join(rf"|(?<=[{re.escape(''.join(sorted(before[c] - {' '})))}]){re.escape(c)}" for c in MARKS if before.get(c, set()) - {" "})
        marks = re.escape(MARKS)
        self.unit = re.compile(f" *[^ {breaks}](?:[^ {breaks}{marks}]+{go_on})*| +|[{breaks or ' '}]" if alone else r"(?s).+")
        self.known = _Known(self.unit_best)
        self.windows: dict[str, tuple] = {}

    def edges_to(self, s: str, end: int) -> list[tuple[int, int, tuple[int, ...]]]:
        """The edges (start, score, ids) that end at a position, the shortest first."""
        get, out = self.prefix.get, []
        for i in range(end - 1, max(end - self.longest, 0) - 1, -1):
            if hit := get(s[i:end]):
                out.append((i, hit[1], (hit[0],)))
        if not out or out[0][0] != end - 1:
            out.append((end - 1, self.unknown, tuple(self.bytes_[b] for b in s[end - 1].encode("utf-8", "surrogatepass"))))
        return out

    def forward(self, s: str) -> list[int]:
        """Viterbi: the best score from the start to each position."""
        get, n, unknown = self.prefix.get, len(s), self.unknown
        best = [0] + [NEVER] * n
        for i in range(n):
            j, score = i + 1, best[i]
            hit = get(s[i:j], 0)
            if not hit and score + unknown > best[j]:
                best[j] = score + unknown
            while hit != 0:
                if hit is not None and score + hit[1] > best[j]:
                    best[j] = score + hit[1]
                j += 1
                if j > n:
                    break
                hit = get(s[i:j], 0)
        return best

    def nbest(self, s: str, n: int) -> list[Path]:
        """The n best segmentations, best first: A* from the end, on the exact forward scores.

        As the heuristic is exact, a node's loss is that of the best path through it. So a popped node is followed along
        its best edges to the start, which is the next path, and only the other edges on its way go on the heap, of
        which those beyond the n smallest losses can't be reached. Paths share their ends as linked lists.
        """
        best = self.forward(s)
        ways: dict[int, list[tuple[int, int, tuple[int, ...]]]] = {}  # position -> (loss, start, ids), the best first
        heap: list[tuple] = [(0, 0, len(s), None)]
        bound, count, out = [0], 1, []  # minus the n smallest losses so far
        while heap and len(out) < n:
            loss, _, at, tail = heapq.heappop(heap)
            while at:
                edges = ways.get(at)
                if edges is None:
                    edges = ways[at] = sorted((best[at] - best[i] - score, -i, ids) for i, score, ids in self.edges_to(s, at))
                for more, i, ids in edges[1:]:
                    if len(bound) < n:
                        heapq.heappush(bound, -(loss + more))
                    elif loss + more < -bound[0]:
                        heapq.heapreplace(bound, -(loss + more))
                    else:
                        break
                    heapq.heappush(heap, (loss + more, count, -i, (ids, tail)))
                    count += 1
                _, i, ids = edges[0]
                at, tail = -i, (ids, tail)
            ids = []
            while tail:
                ids += tail[0]
                tail = tail[1]
            out.append((best[-1] - loss, tuple(ids)))
        return out

    def window(self, w: str) -> tuple[tuple[tuple[int, int, int], ...], bool]:
        """The pieces that a window of at most three characters starts with, as (length, score, id), and whether longer ones may go on."""
        get, hits = self.prefix.get, []
        for k in range(1, len(w) + 1):
            hit = get(w[:k], 0)
            if hit == 0:
                return tuple(hits), False
            if hit is not None:
                hits.append((k, hit[1], hit[0]))
        return tuple(hits), len(w) == 3

    def unit_best(self, s: str) -> tuple[tuple[int, ...], int, int]:
        """Best ids, best score, and how far the second best is below it (FAR: there is none), by a two-best Viterbi pass."""
        get, windows, unknown, n = self.prefix.get, self.windows, self.unknown, len(s)
        best, second, back = [NEVER] * (n + 1), [NEVER] * (n + 1), [None] * (n + 1)
        best[0] = 0
        for i in range(n):
            one, two, w = best[i], second[i], s[i : i + 3]
            if w in windows:
                hits, longer = windows[w]
            else:
                if len(windows) >= WINDOWS:
                    windows.clear()
                hits, longer = windows[w] = self.window(w)
            if not hits or hits[0][0] > 1:
                j, c, d = i + 1, one + unknown, two + unknown
                if c > best[j]:
                    second[j] = best[j] if best[j] > d else d
                    best[j], back[j] = c, (i, None)
                elif c > second[j]:
                    second[j] = c
            for k, score, some in hits:
                j, c = i + k, one + score
                if c > best[j]:
                    d = two + score
                    second[j] = best[j] if best[j] > d else d
                    best[j], back[j] = c, (i, some)
                elif c > second[j]:
                    second[j] = c
            if longer:
                j = i + 4
                while j <= n and (hit := get(s[i:j], 0)) != 0:
                    if hit is not None:
                        c = one + hit[1]
                        if c > best[j]:
                            d = two + hit[1]
                            second[j] = best[j] if best[j] > d else d
                            best[j], back[j] = c, (i, hit[0])
                        elif c > second[j]:
                            second[j] = c
                    j += 1
        ids: list[int] = []
        at = n
        while at:
            i, some = back[at]
            if some is None:
                ids += [self.bytes_[b] for b in reversed(s[i].encode("utf-8", "surrogatepass"))]
            else:
                ids.append(some)
            at = i
        ids.reverse()
        return tuple(ids), best[n], best[n] - second[n] if second[n] > NEVER // 2 else FAR

    def encode_all(self, texts: list[str], n: int = NBEST) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[list[tuple[int, list[tuple[int, tuple[int, ...]]]]]]]:
        """For texts at once: ids of the best segmentations, one after the other, how many each text has, their scores, and for
        each text the n best as (score, [(unit, other ids)]), the best first. An empty text has no ids, score 0, and no n best.

        Only the n - 1 units with the smallest loss for their second best can differ from the best in any of the n.
        """
        self.known.trim()
        part, find = self.known.part, self.unit.findall
        units = [find(" " + t) if t else [] for t in texts]
        count = np.fromiter(map(len, units), np.int64, len(units))
        at = np.fromiter(map(part.__getitem__, chain.from_iterable(units)), np.int64, int(count.sum()))
        if not len(at):
            return np.empty(0, np.int32), count, count, [[] for _ in texts]
        ends = np.frombuffer(part.ends, np.int64)
        start, gaps = ends[at], np.frombuffer(part.gaps, np.int64)[at]
        size = ends[at + 1] - start
        upto = np.cumsum(size)
        ids = np.frombuffer(part.ids, np.int32)[np.repeat(start - upto + size, size) + np.arange(upto[-1])]
        edge = np.concatenate([[0], np.cumsum(count)])
        over = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[edge])
        totals, out = over(np.frombuffer(part.scores, np.int64)[at]), []
        for a, own, total in zip(edge.tolist(), units, totals.tolist()):
            out.append(self._ways(own, gaps[a : a + len(own)], total, n) if own else [])
        return ids, over(size), totals, out

    def _ways(self, units: list[str], gaps: np.ndarray, total: int, n: int) -> list[tuple[int, list[tuple[int, tuple[int, ...]]]]]:
        """The n best of a text from its units' n best: see encode_all."""
        close = np.flatnonzero(gaps <= np.partition(gaps, n - 2)[n - 2]) if 1 < n <= len(gaps) else np.arange(len(gaps))
        close = close[np.argsort(gaps[close], kind="stable")][: n - 1]
        ways: list[tuple[int, tuple]] = [(0, ())]
        for k in sorted(close[gaps[close] < FAR].tolist()):
            ids, best, _ = self.known[units[k]]
            own = [(best, ids)] + [p for p in self.nbest(units[k], n) if p[1] != ids][: n - 1]
            ways = heapq.nsmallest(n, ((loss + best - score, change + (((k, some),) if j else ())) for loss, change in ways for j, (score, some) in enumerate(own)), key=lambda w: (w[0], [c[0] for c in w[1]], w[1]))
        return [(total - loss, list(change)) for loss, change in ways]

    def encode(self, text: str, n: int = NBEST) -> tuple[list[int], int, list[tuple[int, list[tuple[int, tuple[int, ...]]]]]]:
        """ids and score of the best segmentation of one text, and its n best (see encode_all)."""
        ids, _, totals, ways = self.encode_all([text], n)
        return ids.tolist(), int(totals[0]), ways[0]

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "surrogatepass")[1:]


def encode(docs: DataFrame, model_path: str = MODEL, nbest: int = NBEST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, ids, score, nbest (score and the units that differ from the best), restored.

    Scores are sums of the model's piece scores; `restored` tells whether decoding the ids gives the text again.
    The pieces and scores are those that the model file stores, taken as a unigram lattice: with a BPE model (as the
    default one) the result is the best by score, not the one that merging by rank gives. Memory grows in proportion to
    a text, also where it has no place at which no piece reaches over.

    Null text: ids, score and restored null, nbest empty. Empty text: no ids, score 0, nbest empty. Null ids and
    repeated rows stay as they are; empty table: no rows; other columns are ignored. Of equally good best
    segmentations that is taken whose pieces, from the last one back, are longest.
    """
    with open(model_path, "rb") as f:  # half a megabyte, read once on the driver
        proto = docs.sparkSession.sparkContext.broadcast(f.read())

    change = pa.struct([("unit", pa.int32()), ("ids", pa.list_(pa.int32()))])
    best = pa.list_(pa.struct([("score", pa.int64()), ("changes", pa.list_(change))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = _lattice(proto.value)
        for batch in batches:
            ids, column = batch.column(0), batch.column(1)
            for a, b in slices(pa.compute.binary_length(column).fill_null(0).to_pylist(), 1 << 20):
                texts = column.slice(a, b - a).to_pylist()
                found, sizes, totals, some = lattice.encode_all([t or "" for t in texts], nbest)
                null, edge = np.array([t is None for t in texts]), np.concatenate([[0], np.cumsum(sizes)])
                tokens = pa.ListArray.from_arrays(pa.array(edge, pa.int32()), pa.array(found), mask=pa.array(null))
                ways = pa.array([[{"score": s, "changes": [{"unit": k, "ids": i} for k, i in c]} for s, c in w] for w in some], best)
                restored = [None if t is None else lattice.decode(found[x:y].tolist()) == t for t, x, y in zip(texts, edge, edge[1:])]
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), tokens, pa.array(totals, pa.int64(), mask=null), ways, pa.array(restored, pa.bool_())], ["doc_id", "ids", "score", "nbest", "restored"])

    return docs.selectExpr(f"cast(`{id_col}` as long) doc_id", f"cast(`{text_col}` as string) text").mapInArrow(run, "doc_id long, ids array<int>, score long, nbest array<struct<score: long, changes: array<struct<unit: int, ids: array<int>>>>>, restored boolean")


def token_rows(encoded: DataFrame) -> DataFrame:
    """One row of encode()'s result for a table of tokens: doc_id, ids, n_tokens, score, nbest, nbest_scores, restored.

    nbest_scores are the scores of nbest, best first, comma-separated. Null texts have null ids and no n-best; repeated
    rows and null ids stay; an empty table gives no rows.
    """
    return encoded.selectExpr("doc_id", "ids", "cast(size(ids) as long) n_tokens", "score", "nbest", "array_join(transform(nbest, x -> cast(x.score as string)), ',') nbest_scores", "restored")


def decode(encoded: DataFrame, model_path: str = MODEL, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id, text of each row of ids; null ids give null text, empty ids an empty text."""
    with open(model_path, "rb") as f:
        proto = encoded.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = _lattice(proto.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([None if x is None else lattice.decode(x) for x in batch.column(1).to_pylist()], pa.string())], ["doc_id", "text"])

    return encoded.selectExpr(f"cast(`{id_col}` as long) doc_id", f"`{ids_col}` ids").mapInArrow(run, "doc_id long, text string")


_known: dict[int, Lattice] = {}


def _lattice(proto: bytes) -> Lattice:
    """One lattice for each model and worker process."""
    key = hash(proto)
    if key not in _known:
        _known.clear()
        _known[key] = Lattice(proto)
    return _known[key]
