"""A quality classifier by attention-based multiple-instance learning over a document's passages."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, mix64, slices

PASSAGE, SAMPLE, TRAIN_PASSAGES = 64, 4_000, 20_000
BUCKETS = 256  # of words, and as many of word pairs
HIDDEN, GATE, ROUNDS, RATE = 16, 8, 150, 0.03
PAD = 2 * BUCKETS

CLASSES = np.zeros((256, 7), np.float32)  # lower, upper, digit, space, sentence mark, other mark, beyond ASCII
for _b in range(256):
    _c = chr(_b)
    CLASSES[_b, 6 if _b > 127 else 3 if _b <= 32 else 0 if _c.islower() else 1 if _c.isupper() else 2 if _c.isdigit() else 4 if _c in ".,;:'\"()-?" else 5] = 1
WIDTH = 7 + 7


def encode(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Passages of 64 words of a text (the last may be shorter; no words: one passage without any): (shapes, tokens).

    shapes (passages, WIDTH): shares of character classes, and of words that repeat the one before, repeat any in the
    passage, are its commonest, end in a mark, are short or long; mean word length. tokens (passages, 128): the bucket
    of each lower-cased word and of each pair of neighbours in a passage; PAD elsewhere.
    """
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.lower().split()
    n = len(words)
    if not n:
        return np.zeros((1, WIDTH), np.float32), np.full((1, 2 * PASSAGE), PAD, np.uint16)
    p = -(-n // PASSAGE)
    data = np.frombuffer(raw, np.uint8)
    space = (data == 32) | ((data >= 9) & (data <= 13))
    starts = np.flatnonzero(~space & np.concatenate([[True], space[:-1]]))
    at = starts[::PASSAGE]
    edges = np.concatenate([at, [len(data)]])
    counts = np.stack([np.add.reduceat(CLASSES[:, k][data], at) for k in range(7)], axis=1)
    x = np.zeros((p, WIDTH), np.float32)
    x[:, :7] = counts / (edges[1:] - at)[:, None]
    h = np.zeros(p * PASSAGE, np.uint64)
    h[:n] = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n) | np.uint64(1)
    size = np.fromiter(map(len, words), np.float32, n)
    full = np.full(p, PASSAGE, np.float32)
    full[-1] = n - PASSAGE * (p - 1)
    same = np.zeros(p * PASSAGE, np.float32)
    same[1:n] = h[1:n] == h[: n - 1]
    order = h.reshape(p, PASSAGE)
    grid = np.sort(order, axis=1)
    new = np.ones(grid.shape, bool)
    new[:, 1:] = grid[:, 1:] != grid[:, :-1]
    real = grid > 0
    run = np.arange(PASSAGE) - np.maximum.accumulate(np.where(new, np.arange(PASSAGE), 0), axis=1)
    last = data[starts + size.astype(np.int64) - 1]
    grid_of = lambda v: np.pad(v.astype(np.float32), (0, p * PASSAGE - n)).reshape(p, PASSAGE).sum(1)
    x[:, 7] = same.reshape(p, PASSAGE).sum(1) / full
    x[:, 8] = 1 - (new & real).sum(1) / full
    x[:, 9] = ((run + 1) * real).max(1) / full
    x[:, 10] = grid_of(CLASSES[last, 5]) / full
    x[:, 11] = grid_of(size <= 2) / full
    x[:, 12] = grid_of(size >= 14) / full
    x[:, 13] = np.minimum(grid_of(size) / full / 10, 3)
    tokens = np.full((p, 2 * PASSAGE), PAD, np.uint16)
    some = order > 0
    tokens[:, :PASSAGE][some] = (order[some] >> np.uint64(32)) % np.uint64(BUCKETS)
    pair = mix64(order[:, :-1] * np.uint64(3) + order[:, 1:])
    both = some[:, 1:]
    tokens[:, PASSAGE:-1][both] = np.uint64(BUCKETS) + pair[both] % np.uint64(BUCKETS)
    return x, tokens


class GatedAttention:
    """h = tanh(xW + mean of E over tokens + b); a = softmax over a bag of (tanh(hV) * sigmoid(hU)) w; score = sigmoid(sum(a h) c + d)."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        n = lambda *s: rng.normal(0, 1 / np.sqrt(s[0]), s)
        self.p = {"W": n(WIDTH, HIDDEN), "E": np.zeros((PAD, HIDDEN)), "b": np.zeros(HIDDEN), "V": n(HIDDEN, GATE), "U": n(HIDDEN, GATE), "w": n(GATE), "c": n(HIDDEN), "d": np.zeros(1)}
        self.mean, self.scale = np.zeros(WIDTH), np.ones(WIDTH)

    @staticmethod
    def embedded(tokens: np.ndarray, table: np.ndarray) -> np.ndarray:
        """The mean of the table's rows over each passage's tokens; PAD counts as nothing."""
        rows = np.concatenate([table, np.zeros((1, table.shape[1]))]).astype(np.float32)[tokens]
        return rows.sum(1) / np.maximum((tokens < PAD).sum(1), 1)[:, None]

    def forward(self, x: np.ndarray, e: np.ndarray, start: np.ndarray) -> dict:
        """e: what the tokens add to each passage, (passages, HIDDEN)."""
        p, size = self.p, np.diff(np.append(start, len(x)))
        z = (x - self.mean) / self.scale
        h = np.tanh(z @ p["W"] + e + p["b"])
        t, g = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-h @ p["U"]))
        e = (t * g) @ p["w"]
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, start), size))
        a = e / np.repeat(np.add.reduceat(e, start), size)
        bag = np.add.reduceat(a[:, None] * h, start)
        y = 1 / (1 + np.exp(-np.clip(bag @ p["c"] + p["d"], -30, 30)))
        return {"z": z, "h": h, "t": t, "g": g, "a": a, "bag": bag, "y": y, "size": size}

    def gradients(self, x: np.ndarray, counts: np.ndarray, start: np.ndarray, label: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean cross entropy, by back-propagation; counts (passages, PAD): each token's share of its passage."""
        f, p = self.forward(x, counts @ self.p["E"].astype(counts.dtype), start), self.p
        dy = (f["y"] - label) / len(label)
        dbag = np.repeat(dy[:, None] * p["c"], f["size"], axis=0)
        da = (dbag * f["h"]).sum(1)
        de = f["a"] * (da - np.repeat(np.add.reduceat(f["a"] * da, start), f["size"]))
        dt, dg = de[:, None] * p["w"] * f["g"] * (1 - f["t"] ** 2), de[:, None] * p["w"] * f["t"] * f["g"] * (1 - f["g"])
        dh = (f["a"][:, None] * dbag + dt @ p["V"].T + dg @ p["U"].T) * (1 - f["h"] ** 2)
        return {"W": f["z"].T @ dh, "E": counts.T @ dh.astype(counts.dtype), "b": dh.sum(0), "V": f["h"].T @ dt, "U": f["h"].T @ dg, "w": (f["t"] * f["g"]).T @ de, "c": f["bag"].T @ dy, "d": dy.sum(keepdims=True)}

    def fit(self, x: np.ndarray, tokens: np.ndarray, start: np.ndarray, label: np.ndarray) -> GatedAttention:
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-3
        counts = np.zeros((len(x), PAD), np.float32)
        for k in range(0, len(x), 1_000):  # a slice at a time, as the driver's memory is small
            part = tokens[k : k + 1_000]
            n = np.bincount((np.arange(len(part))[:, None] * (PAD + 1) + part).ravel(), minlength=len(part) * (PAD + 1)).reshape(len(part), PAD + 1)[:, :PAD]
            counts[k : k + 1_000] = n / np.maximum(n.sum(1, keepdims=True), 1)
        m, v = ({k: np.zeros_like(q) for k, q in self.p.items()} for _ in range(2))
        for step in range(1, ROUNDS + 1):
            for k, q in self.gradients(x, counts, start, label).items():
                q = q + 1e-4 * self.p[k]
                m[k] = 0.9 * m[k] + 0.1 * q
                v[k] = 0.99 * v[k] + 0.01 * q * q
                self.p[k] = self.p[k] - RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
        return self

    def score(self, texts: list[str | None]) -> np.ndarray:
        both = [encode(t) for t in texts]
        tokens = np.concatenate([t for _, t in both])
        start = np.cumsum([0, *(len(x) for x, _ in both[:-1])])
        return self.forward(np.concatenate([x for x, _ in both]), self.embedded(tokens, self.p["E"]), start)["y"]


HELD_OUT = "coalesce(crc32(cast(doc_id as string)) % 3 = 1, false)"


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, passages: int = TRAIN_PASSAGES) -> GatedAttention:
    """Fit on a bounded sample of labelled documents, each with all its passages; held-out rows take no part.

    Of the labelled ids those with the smallest hashes are taken, at most `sample`, as long as their texts have no more
    than `passages` passages together; a text with more than a tenth of that is not sampled. So the driver gets at most
    `passages` passages. An id with several labels has their mean, one with several texts the smallest of them. Null
    ids, null labels and labels without a document are left out; without any the model stays as it was made.
    """
    chosen = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("double").alias("quality")).dropna().filter(f"not ({HELD_OUT})").groupBy("doc_id").agg(F.avg("quality").alias("quality"))
    chosen = F.broadcast(chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample))

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, text in enumerate(batch.column(1)):
                x, tokens = encode(text.as_py())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), pa.array([len(x)]), pa.array([x.tobytes()], pa.binary()), pa.array([tokens.tobytes()], pa.binary())], ["doc_id", "n", "x", "tokens"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    one = texts.join(chosen, "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"))
    encoded = cut(one.mapInArrow(bags, "doc_id long, n long, x binary, tokens binary"), "bags")
    order = Window.orderBy(F.xxhash64("doc_id"), "doc_id")  # over `sample` rows
    fits = encoded.select("doc_id", "n").filter(F.col("n") <= passages / 10).withColumn("upto", F.sum("n").over(order)).filter(F.col("upto") <= passages).select("doc_id")
    rows = encoded.join(F.broadcast(fits), "doc_id").join(chosen, "doc_id").select("doc_id", "quality", "x", "tokens").collect()
    rows.sort(key=lambda r: r["doc_id"])  # one order, so that sums and the model are the same in every run
    model = GatedAttention()
    if rows:
        x = [np.frombuffer(r["x"], np.float32).reshape(-1, WIDTH) for r in rows]
        tokens = np.concatenate([np.frombuffer(r["tokens"], np.uint16).reshape(-1, 2 * PASSAGE) for r in rows])
        model.fit(np.concatenate(x).astype(np.float64), tokens, np.cumsum([0, *map(len, x[:-1])]), np.array([r["quality"] for r in rows]))
    return model


def score_quality(docs: DataFrame, model: GatedAttention) -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted.

    Null and empty texts are scored as one passage without words; null ids are never held out; repeated rows stay; an
    empty table gives no rows; without any labels the untrained scores are near 0.5; other columns are never read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1)
            for a, b in slices(pa.compute.binary_length(column).fill_null(0).to_pylist(), 1 << 20):
                y = shared.value.score(column.slice(a, b - a).to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(y, pa.float64())], ["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", F.expr(HELD_OUT).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep(docs: DataFrame, model: GatedAttention, text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, that the classifier accepts (score >= 0.5).

    Rows are judged one by one, so null ids and repeated rows have their own verdict; null and empty texts are scored
    as one passage without words; an empty table gives no rows; other columns are never looked at.
    """
    shared, at, schema = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col), docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(at)
            for a, b in slices(pa.compute.binary_length(column).fill_null(0).to_pylist(), 1 << 20):
                y = shared.value.score(column.slice(a, b - a).to_pylist())
                yield batch.slice(a, b - a).filter(pa.array(y >= 0.5))

    return docs.mapInArrow(run, schema)
