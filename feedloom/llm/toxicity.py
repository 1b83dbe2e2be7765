"""Operator 4: toxic passages by maximum-scoring segment search.

Units are lower-cased words and their first 4, 5 and 6 letters (for inflected forms). A unit's log-odds between toxic and other
labelled documents has a Dirichlet prior in proportion to the unit's document frequency in the whole corpus; units whose
log-odds stands out (z of MIN_Z) form the lexicon. A word scores as its best unit (by a lower bound of the log-odds), any other word a small negative
value; a linear scan (stack of cumulative sums) yields all maximal segments of each text. Under the score distribution of
non-toxic documents the best segment of n words follows an extreme-value law, P(S > s) = 1 - exp(-K n exp(-lambda s)); the
segments' evidence above it, summed, is mapped to a probability by logistic calibration on the labelled sample.

Nothing is learnt from the held-out fold. Null and empty texts, and all texts if no unit stands out, have no passages and get
the calibrated score of no evidence; without labels of both kinds that is 0. Repeated rows are scored each; equal scores stay
equal; further columns of the input are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.llm.common import LABEL_BOUND, held_out, label_sample, map_texts, rows_where, slices, table

WORD = re.compile(r"[^\W\d_]+")
STEMS = (4, 5, 6)
#: Prior documents for each labelled one; z that a unit of the lexicon reaches; cost of a word without evidence; largest score.
PRIOR, MIN_Z, COST, TOP = 0.1, 3.3, 0.2, 6.0
#: Standard deviations that a unit's score lies below its log-odds, and the least score of the lexicon.
CAUTION, LEAST = 1.5, 0.5
THRESHOLD = 0.3
#: Units that a task counts before it passes the sums on (Spark adds them up before they move); words whose score a task remembers (about 100 bytes each).
FLUSH, CACHE = 200_000, 300_000


def units(words: set[str]) -> set[str]:
    return words.union(*({f"{w[:n]}*" for w in words if len(w) > n} for n in STEMS))


def unit_counts(docs: DataFrame, sample: DataFrame) -> DataFrame:
    """(unit, n, toxic, clean): documents that hold a unit; of all, of toxic and of other labelled ones."""
    marked = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id", "left").select(F.col("text").cast("string").alias("text"), "label")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = (Counter(), Counter(), Counter())

        def passed_on() -> pa.RecordBatch:
            names = list(sums[0])
            out = pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *(pa.array([c[k] for k in names], pa.int64()) for c in sums)], names=["unit", "n", "toxic", "clean"])
            for c in sums:
                c.clear()
            return out

        for batch in batches:
            for part in slices(batch):
                for text, label in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    own = units(set(WORD.findall((text or "").lower())))
                    sums[0].update(own)
                    if label is not None:
                        sums[1 if label else 2].update(own)
                if len(sums[0]) > FLUSH:
                    yield passed_on()
        yield passed_on()

    sums = marked.mapInArrow(run, "unit string, n long, toxic long, clean long")
    return sums.groupBy("unit").agg(*[F.sum(c).alias(c) for c in ("n", "toxic", "clean")])


def lexicon(docs: DataFrame, sample: DataFrame) -> dict[str, float]:
    """Unit: score of the units that stand out. They come from the bounded sample, and so their number is bounded."""
    toxic, clean = (sample.agg(F.count_if(F.col("label") > 0), F.count_if(F.col("label") <= 0)).first() or (0, 0))
    if not toxic or not clean:
        return {}
    prior = PRIOR * (toxic + clean)
    total = max(docs.count(), 1)
    a = F.col("n") / total * prior
    odds = lambda y, n: F.log((y + a) / F.greatest(n + prior - y - a, F.lit(1e-9)))
    scored = unit_counts(docs, sample).where("toxic >= 2").select(
        "unit", (odds(F.col("toxic"), toxic) - odds(F.col("clean"), clean)).alias("score"), F.sqrt(1 / (F.col("toxic") + a) + 1 / (F.col("clean") + a)).alias("sd"))
    found = scored.where(F.col("score") >= MIN_Z * F.col("sd")).select("unit", (F.col("score") - CAUTION * F.col("sd")).alias("score")).where(F.col("score") >= LEAST)
    return {r["unit"]: min(r["score"], TOP) for r in found.collect()}


class Scorer:
    """Scores of words, and the segments of texts."""

    def __init__(self, known: dict[str, float]):
        self.known, self.words = known, {}

    def of(self, word: str) -> float:
        found = self.words.get(word)
        if found is None:
            if len(self.words) > CACHE:
                self.words.clear()
            found = self.words[word] = max((self.known[u] for u in (word, *(f"{word[:n]}*" for n in STEMS if len(word) > n)) if u in self.known), default=0.0)
        return found

    def segments(self, text: str) -> tuple[int, list[tuple[int, int, float]]]:
        """(number of words, maximal scoring segments as (first word, last word, score))."""
        words = WORD.findall(text.lower())
        hits = {w: s for w in set(words) if (s := self.of(w))}
        if not hits:
            return len(words), []
        # maximal ones of what was read so far: (first, last, sum before it, sum after it, the last earlier one with a lower sum before it)
        stack: list[tuple[int, int, float, float, int]] = []
        total, last = 0.0, -1
        for i, w in enumerate(words):
            s = hits.get(w)
            if s is None:
                continue
            total -= COST * (i - last - 1)
            last = i
            first, before, total = i, total, total + s
            j = len(stack) - 1
            # what a link leaps over starts no lower, so each link is followed once
            while j >= 0 and stack[j][2] >= before:
                j = stack[j][4]
            # an earlier segment that starts lower joins, unless it also ends as high
            while j >= 0 and stack[j][3] < total:
                first, _, before, _, link = stack[j]
                del stack[j:]
                j = link
            stack.append((first, i, before, total, j))
        return len(words), [(a, b, r - l) for a, b, l, r, _ in stack]


def background(hits: int, words: int, score: float) -> tuple[float, float]:
    """(lambda, K) for words of which `hits` in `words` have `score` (half a hit at least) and the others cost COST."""
    p = min(0.5, (hits + 0.5) / (words + 1))
    low, high = 1e-6, 20.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if p * math.exp(mid * score) + (1 - p) * math.exp(-mid * COST) < 1 else (low, mid)
    return low, p


def evidence(n: int, segments: list[tuple[int, int, float]], law: tuple[float, float]) -> float:
    """Sum over the segments of how far they exceed what the best of n words would reach by chance."""
    scale, k = law
    e = sorted((scale * s - math.log(max(k * n, 1e-300)) for *_, s in segments), reverse=True)
    return math.log1p(sum(x for x in e if x > 0))


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Intercept and slope by Newton steps with a weak penalty, so that separable data keep finite values."""
    design, w = np.stack([np.ones_like(x), x], 1), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-design @ w))
        grad = design.T @ (p - y) + 0.1 * w
        w -= np.linalg.solve((design * (p * (1 - p))[:, None]).T @ design + 0.1 * np.eye(2), grad)
    return float(w[0]), float(w[1])


def fit(docs: DataFrame, labels: DataFrame, bound: int = LABEL_BOUND) -> dict:
    """The model: lexicon, extreme-value law and calibration, from at most `bound` labelled ids (and, where ids repeat, 2 * bound rows, smallest ids first)."""
    sample = label_sample(labels, "toxic", bound)
    known = lexicon(docs, sample)
    chosen = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")

    def run() -> Callable[[list[str]], dict[str, list]]:
        scorer = Scorer(known)

        def of(texts: list[str]) -> dict[str, list]:
            found = [scorer.segments(t) for t in texts]
            return {"n": [n for n, _ in found], "scores": [[s for *_, s in x] for _, x in found]}

        return of

    rows = map_texts(chosen, run, [("n", "long"), ("scores", "array<double>")], ("doc_id", "label")).orderBy("doc_id", "n").limit(2 * bound).collect()
    clean = [r for r in rows if not r["label"]]
    hits = sum(len(r["scores"]) for r in clean)
    mean = float(np.mean(list(known.values()))) if known else 1.0
    law = background(hits, sum(r["n"] for r in clean), mean)
    x = np.array([evidence(r["n"], [(0, 0, s) for s in r["scores"]], law) for r in rows])
    y = np.array([float(r["label"] > 0) for r in rows])
    line = logistic(x, y) if 0 < y.sum() < len(y) else (-40.0, 0.0)
    return {"lexicon": known, "law": law, "line": line}


def score(docs: DataFrame, model: dict, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """`keep`, score, and passages: the first and last word (from 0) and the score of each segment above chance."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run() -> Callable[[list[str]], dict[str, list]]:
        m = sent.value
        scorer = Scorer(m["lexicon"])
        (a, b), (scale, k) = m["line"], m["law"]

        def of(texts: list[str]) -> dict[str, list]:
            scores, passages = [], []
            for t in texts:
                n, found = scorer.segments(t)
                scores.append(1 / (1 + math.exp(-max(-60.0, min(60.0, a + b * evidence(n, found, m["law"]))))))
                passages.append([{"first": f, "last": l, "score": s} for f, l, s in found if scale * s > math.log(max(k * n, 1e-300))])
            return {"score": scores, "passages": passages}

        return of

    return map_texts(docs, run, [("score", "double"), ("passages", "array<struct<first:int,last:int,score:double>>")], keep, text)


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents (all columns) whose toxicity score stays below THRESHOLD."""
    model = fit(docs, labels)
    return rows_where(docs, lambda d, keep, text: score(d, model, keep, text), F.col("score") < THRESHOLD)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), F.size("passages").alias("n_passages"))
