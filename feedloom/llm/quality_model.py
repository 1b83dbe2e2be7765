"""Operator 1: quality classifier on random-indexing word vectors.

Tokens are words, runs of other characters, and markers for what a reader sees at once (a token equal to the one before,
capitals, a line seen before). Each token falls by its hash into one of BUCKETS; each bucket has a fixed sparse ternary index
vector, and its word vector is that plus the normalised sum of the index vectors of its neighbours over the whole corpus
(integers, so sums don't depend on the order of tasks). The table has BUCKETS x DIM numbers whatever the input, and so may be
sent to all tasks. A document pools its tokens' vectors (mean and root mean square); a network with one hidden layer, written
in numpy, is fitted on a bounded labelled sample, and a temperature chosen on a part that it didn't see calibrates it.

Labels are learnt outside the held-out fold only; the word vectors, which know no labels, sum over all texts. Null and empty texts pool to zero and are scored by the network like any other; with
no labels of both kinds every score is the share of label 1 (0.5 without labels). Repeated rows are scored each; further columns
of the input are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.llm.common import LABEL_BOUND, held_out, label_sample, map_texts, rows_where, slices, table

TOKEN = re.compile(r"\w+|[^\w\s]+|\n")
BUCKETS, DIM, ONES, REACH = 1 << 14, 32, 2, 2
#: Buckets kept for the markers.
SAME, CAPITALS, OLD_LINE, MARKERS = 0, 1, 2, 8
HIDDEN, EPOCHS, BATCH, RATE, PENALTY = 32, 40, 256, 3e-3, 1e-4
THRESHOLD = 0.7
#: Tokens whose vectors are gathered at once, and tokens that a task remembers (about 100 bytes each).
GATHER, CACHE = 1 << 16, 300_000


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the ONES non-zero elements of each bucket's index vector."""
    rng = np.random.default_rng(20_011)
    return rng.integers(0, DIM, (BUCKETS, ONES)), rng.choice([-1, 1], (BUCKETS, ONES))


class Tokens:
    """Buckets of a text's tokens."""

    def __init__(self):
        self.known: dict[str, int] = {}

    def of(self, text: str) -> np.ndarray:
        found = TOKEN.findall(text)
        if fresh := set(found).difference(self.known):
            if len(self.known) > CACHE:
                self.known.clear()
                fresh = set(found)
            for t in fresh:
                # the sign carries whether the token is written in capitals
                b = MARKERS + zlib.crc32(t.lower().encode("utf-8", "replace")) % (BUCKETS - MARKERS)
                self.known[t] = -b if len(t) > 1 and t.isupper() else b
        ids = np.fromiter(map(self.known.__getitem__, found), np.int64, len(found))
        marks = [np.full(int((ids[1:] == ids[:-1]).sum()), SAME), np.full(int((ids < 0).sum()), CAPITALS)]
        lines = [x for x in text.split("\n") if x]
        marks.append(np.full(len(lines) - len(set(lines)), OLD_LINE))
        # a repeated line weighs as much as it has tokens
        marks[2] = np.repeat(marks[2], max(1, len(found) // max(1, len(lines))))
        return np.concatenate([np.abs(ids), *marks]).astype(np.int64)


def word_vectors(docs: DataFrame) -> np.ndarray:
    """BUCKETS x DIM vectors from the neighbours of every token of every text."""
    places, signs = index_vectors()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, sums, seen = Tokens(), np.zeros(BUCKETS * DIM), False
        for batch in batches:
            for part in slices(batch):
                own = [tokens.of(t or "") for t in part.column(0).to_pylist()]
                ids = np.concatenate(own) if own else np.zeros(0, np.int64)
                doc = np.repeat(np.arange(len(own)), [len(x) for x in own])
                seen |= len(ids) > 0
                for step in range(1, REACH + 1):
                    same = doc[step:] == doc[:-step]
                    a, b = ids[:-step][same], ids[step:][same]
                    for x, y in ((a, b), (b, a)):
                        for k in range(ONES):
                            sums += np.bincount(x * DIM + places[y, k], signs[y, k], BUCKETS * DIM)
        if seen:
            table_ = sums.astype(np.int64).reshape(BUCKETS, DIM)
            rows = np.flatnonzero(table_.any(axis=1))
            for start in range(0, len(rows), 4096):
                r = rows[start : start + 4096]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(r) + 1) * DIM, pa.int32()), pa.array(table_[r].ravel(), pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(r, pa.int64()), lists], names=["bucket", "v"])

    parts = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "bucket long, v array<long>")
    sums = parts.groupBy("bucket").agg(F.array(*[F.sum(F.col("v")[i]) for i in range(DIM)]).alias("v"))
    vectors = np.zeros((BUCKETS, DIM), np.float32)
    for row in sums.collect():  # BUCKETS rows at most
        vectors[row["bucket"]] = row["v"]
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
    np.add.at(vectors, (np.arange(BUCKETS)[:, None], places), signs.astype(np.float32) / ONES**0.5)
    return vectors


def pooled(texts: list[str], vectors: np.ndarray, tokens: Tokens) -> np.ndarray:
    """Mean and root mean square of the tokens' vectors, and the log of their number, of each text."""
    out = np.zeros((len(texts), 2 * DIM + 1), np.float32)
    for i, text in enumerate(texts):
        ids = tokens.of(text)
        if not len(ids):
            continue
        for start in range(0, len(ids), GATHER):
            v = vectors[ids[start : start + GATHER]]
            out[i, :DIM] += v.sum(0)
            out[i, DIM : 2 * DIM] += np.einsum("ij,ij->j", v, v)
        out[i, : 2 * DIM] /= len(ids)
        out[i, DIM : 2 * DIM] = np.sqrt(out[i, DIM : 2 * DIM])
        out[i, -1] = np.log1p(len(ids))
    return out


class Network:
    """Two layers: tanh, then one logit; Adam on the cross-entropy."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        rng = np.random.default_rng(7)
        self.shift, self.scale = x.mean(0), np.maximum(x.std(0), 1e-4)
        x = self._scaled(x)
        p = [rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
        m, v, t = [0 * a for a in p], [0 * a for a in p], 0
        for _ in range(EPOCHS):
            order = rng.permutation(len(x))
            for start in range(0, len(x), BATCH):
                rows = order[start : start + BATCH]
                h = np.tanh(x[rows] @ p[0] + p[1])
                d = (1 / (1 + np.exp(-(h @ p[2] + p[3]))) - y[rows]) / len(rows)
                back = np.outer(d, p[2]) * (1 - h * h)
                grads = [x[rows].T @ back + PENALTY * p[0], back.sum(0), h.T @ d + PENALTY * p[2], np.array([d.sum()])]
                t += 1
                for k, g in enumerate(grads):
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    p[k] = p[k] - RATE * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
        self.p, self.temperature = p, 1.0

    def _scaled(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.shift) / self.scale, -8, 8)

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(self._scaled(x) @ self.p[0] + self.p[1]) @ self.p[2] + self.p[3]

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> None:
        """The temperature with the least cross-entropy on rows that weren't learnt from."""
        z = self.logit(x)
        grid = np.exp(np.linspace(np.log(0.25), np.log(8), 60))
        losses = [np.mean(np.logaddexp(0, z / t) - y * z / t) for t in grid]
        self.temperature = float(grid[int(np.argmin(losses))])

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x) / self.temperature, -60, 60)))


def fit(docs: DataFrame, labels: DataFrame, bound: int = LABEL_BOUND) -> dict:
    """The model: word vectors from all texts, and a network (None if one label is missing) from at most `bound` labelled ids, and, where ids repeat, 2 * bound rows (smallest hashes first)."""
    vectors = word_vectors(docs)
    sent = docs.sparkSession.sparkContext.broadcast(vectors)
    chosen = docs.select("doc_id", "text").join(F.broadcast(label_sample(labels, "quality", bound)), "doc_id")

    def run() -> Callable[[list[str]], dict[str, pa.Array]]:
        tokens = Tokens()

        def of(texts: list[str]) -> dict[str, pa.Array]:
            x = pooled(texts, sent.value, tokens)
            return {"x": pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel(), pa.float32()))}

        return of

    rows = map_texts(chosen, run, [("x", "array<float>")], ("doc_id", "label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(2 * bound).collect()
    y = np.array([float(r["label"] > 0) for r in rows])
    if not 0 < y.sum() < len(y):
        return {"vectors": vectors, "network": None, "share": float(y.mean()) if len(y) else 0.5}
    x = np.array([r["x"] for r in rows], np.float64)
    aside = np.arange(len(x)) % 5 == 4
    network = Network(x[~aside], y[~aside])
    network.calibrate(x[aside], y[aside])
    return {"vectors": vectors, "network": network, "share": float(y.mean())}


def score(docs: DataFrame, model: dict, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """`keep` and score, the probability of label 1, of each text."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run() -> Callable[[list[str]], dict[str, pa.Array]]:
        m, tokens = sent.value, Tokens()

        def of(texts: list[str]) -> dict[str, pa.Array]:
            if m["network"] is None:
                return {"score": pa.array([m["share"]] * len(texts), pa.float64())}
            return {"score": pa.array(m["network"].probability(pooled(texts, m["vectors"], tokens)), pa.float64())}

        return of

    return map_texts(docs, run, [("score", "double")], keep, text)


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents (all columns) that score THRESHOLD or more."""
    model = fit(docs, labels)
    return rows_where(docs, lambda d, keep, text: score(d, model, keep, text), F.col("score") >= THRESHOLD)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
