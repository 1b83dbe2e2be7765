"""Operator 2: benchmark decontamination by SimHash windows.

Windows are sized to the items: an item of L words belongs to the largest class of CLASSES that leaves at least a quarter of it as
slack, and is fingerprinted at all L - c + 1 places. A document's windows of each class are fingerprinted at every word, with 64
bits and one vote a word. Four blocks of 16 bits are indexed with all values within 2 bits: two fingerprints within RADIUS = 11
bits differ by 2 bits or fewer in some block, so none within the radius is missed. Each candidate is verified exactly: the document
holds the item if it has, anywhere, at least 0.8 of the weighted share of the item's five-word shingles (short items: one
shingle of all words); a word weighs its inverse document frequency among all different items of the benchmark.

So much cannot be reached without one of the item's heaviest shingles that weigh more than 0.2 together. These shingles are pieces
of the item: each is fingerprinted by itself, at all its places, and the document's windows of that length are searched for them in
the same blocks. So where a copy is interrupted and no window of the item's size lies within the radius, a piece that stayed whole
has the same fingerprint and is met; by_window tells whether a window of the item's size was. Every row comes from a window
within the radius. Documents in which none of the heavy shingles occurs (equal shingles have equal hashes, so none is lost)
can't pass the check and get no fingerprints. Of the alignments that the windows give the one with most of the item's
weight in place counts.

Null and empty texts, and items without words, match nothing; repeated documents and items are reported each (same item_id: the
best); an item that occurs several times in a document is one row with its best place, the earliest of equal ones. An empty
benchmark gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.llm.common import slices, table, written

SHINGLE, SIMILARITY, RADIUS = 5, 0.8, 11
CLASSES = (1, 2, 3, 4, 6, 8, 12, 16, 24, 32, 48, 64, 96, 128, 192, 256)
#: Benchmark bytes up to which all items go to every task; a larger benchmark is taken in parts of this size.
PART_BYTES = 4 << 20
#: Words whose votes are summed at once.
SPAN = 1 << 14
#: Windows that are compared with the items' at once.
STARTS = 1 << 11
#: Words whose votes a worker remembers.
VOCABULARY = 100_000
_WORD = re.compile(r"\w+")
#: Of the hashes of shingles: the base of the polynomial, and the high bits that are looked up first.
_BASE, _BITS = np.uint64(0x9E3779B97F4A7C15), 20


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


class _Hashes(dict):
    """64-bit hashes of words, remembered."""

    def __missing__(self, word: str) -> int:
        if len(self) >= VOCABULARY:
            self.clear()
        found = self[word] = xxhash.xxh64_intdigest(word)
        return found

    def of(self, own: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, own), np.uint64, len(own))


def rolled(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k-word shingles."""
    n = max(0, len(hashes) - k + 1)
    out = hashes[:n].copy()
    for j in range(1, k):
        out *= _BASE
        out += hashes[j : j + n]
    return out


class Index:
    """The items' shingles, and their fingerprints at all places, by class."""

    def __init__(self, items: list[tuple], held: dict[str, int] | None = None, total: int | None = None):
        """items: (key, text); held and total: how many different items hold each word, and how many there are, if these are only part of them."""
        self.items = [(i, w) for i, t in items if (w := words(t or ""))]
        if held is None:
            each = {tuple(w) for _, w in self.items}
            held, total = Counter(x for w in each for x in set(w)), len(each)
        self.weights = {x: float(np.log((1 + total) / held[x]) + 0.1) for _, w in self.items for x in w}
        self.known: dict[str, int] = {}
        self.table = np.zeros((1 << 12, 64), np.int32)
        self.shingles = []
        for _, w in self.items:
            k = min(SHINGLE, len(w))
            self.shingles.append({s: sum(self.weights[x] for x in s) for s in (tuple(w[j : j + k]) for j in range(len(w) - k + 1))})
        self.hashes = _Hashes()
        self.heavy = [self._heaviest(x) for x in self.shingles]
        self.filters = self._filters()
        items_of: dict[int, list[tuple[int, list[int]]]] = {}
        pieces_of: dict[int, list[tuple[int, list[int]]]] = {}
        for k, (_, w) in enumerate(self.items):
            c = max(x for x in CLASSES if x == 1 or x <= 0.75 * len(w))
            items_of.setdefault(c, []).append((k, list(range(len(w) - c + 1))))
            n = min(SHINGLE, len(w))
            pieces_of.setdefault(n, []).append((k, [j for j in range(len(w) - n + 1) if tuple(w[j : j + n]) in self.heavy[k]]))
        #: Fingerprints of the items' own windows by class, and of their heavy shingles by length.
        self.classes = {c: self._blocks(c, own) for c, own in sorted(items_of.items())}
        self.pieces = {c: self._blocks(c, own) for c, own in sorted(pieces_of.items())}

    def _blocks(self, size: int, places: list[tuple[int, list[int]]]) -> dict:
        """The fingerprints of windows of some items, (item, places), and the blocks that they are found by."""
        prints = np.concatenate([self.fingerprints(self.sums(self.ids(self.items[k][1])), np.array(own), size) for k, own in places])
        blocks = []
        for b in range(4):
            value = ((prints >> np.uint64(16 * b)) & np.uint64(0xFFFF)).astype(np.int64)
            near = (value[:, None] ^ _masks()[None, :]).ravel()
            order = np.argsort(near, kind="stable")
            start = np.searchsorted(near[order], np.arange((1 << 16) + 1))
            blocks.append((start, (order // len(_masks())).astype(np.int32)))
        return {"prints": prints, "item": np.array([k for k, own in places for _ in own]), "place": np.array([j for _, own in places for j in own]), "blocks": blocks}

    def ids(self, own: list[str]) -> np.ndarray:
        """Rows of self.table for the words; unknown ones are added."""
        known = self.known
        if fresh := set(own).difference(known):
            if len(known) + len(fresh) > VOCABULARY:
                known.clear()
                fresh = set(own)
            fresh = list(fresh)
            bits = np.unpackbits(np.frombuffer(b"".join(map(xxhash.xxh64_digest, fresh)), np.uint8)).reshape(-1, 64).astype(np.int32)
            rows = 2 * bits - 1
            need = len(known) + len(fresh)
            if need > len(self.table):
                self.table = np.concatenate([self.table, np.zeros((2 * need - len(self.table), 64), np.int32)])
            self.table[len(known) : need] = rows
            known.update(zip(fresh, range(len(known), need)))
        return np.fromiter(map(known.__getitem__, own), np.int64, len(own))

    def sums(self, ids: np.ndarray) -> np.ndarray:
        """Votes of all words before each place."""
        out = np.zeros((len(ids) + 1, 64), np.int32)
        np.cumsum(self.table[ids], axis=0, dtype=np.int32, out=out[1:])
        return out

    @staticmethod
    def fingerprints(sums: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
        return np.packbits(sums[starts + size] > sums[starts], axis=1).view(">u8").ravel().astype(np.uint64)

    @staticmethod
    def found(own: dict, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, one of a group's fingerprints) within the radius."""
        windows, hits = [], []
        for b, (start, members) in enumerate(own["blocks"]):
            value = ((prints >> np.uint64(16 * b)) & np.uint64(0xFFFF)).astype(np.int64)
            n = start[value + 1] - start[value]
            window = np.repeat(np.arange(len(prints)), n)
            at = np.arange(len(window)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start[value], n)
            hit = members[at]
            near = np.bitwise_count(prints[window] ^ own["prints"][hit]) <= RADIUS
            windows.append(window[near])
            hits.append(hit[near])
        return np.concatenate(windows), np.concatenate(hits)

    @staticmethod
    def _heaviest(needed: dict[tuple, float]) -> set[tuple]:
        """An item's shingles, heaviest first, until those left can't reach SIMILARITY."""
        left, out = (1 - SIMILARITY) * sum(needed.values()) * (1 + 1e-9), set()
        for s in sorted(needed, key=lambda s: (-needed[s], s)):
            out.add(s)
            left -= needed[s]
            if left < 0:
                break
        return out

    def _filters(self) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """By shingle length: the high bits taken, and the sorted hashes, of all heavy shingles."""
        filters = {}
        for k in {len(s) for own in self.heavy for s in own}:
            keys = np.array(sorted({int(rolled(self.hashes.of(list(s)), k)[0]) for own in self.heavy for s in own if len(s) == k}), np.uint64)
            bits = np.zeros(1 << _BITS, bool)
            bits[keys >> np.uint64(64 - _BITS)] = True
            filters[k] = (bits, keys)
        return filters

    def possible(self, split: list[list[str]]) -> list[int]:
        """The texts that hold a heavy shingle of any item."""
        sizes = np.array([len(x) for x in split], np.int64)
        end = np.cumsum(sizes)
        hashes = self.hashes.of([x for own in split for x in own])
        met: set[int] = set()
        for k, (bits, keys) in self.filters.items():
            own = rolled(hashes, k)
            at = np.flatnonzero(bits[own >> np.uint64(64 - _BITS)])
            text = np.searchsorted(end, at, "right")
            inside = at + k <= end[text]
            at, text = at[inside], text[inside]
            key = np.minimum(np.searchsorted(keys, own[at]), len(keys) - 1)
            met.update(text[keys[key] == own[at]].tolist())
        return sorted(met)

    def windows(self, split: list[list[str]], some: list[int], groups: dict[int, dict]) -> dict[tuple[int, int], set[int]]:
        """For (text, item) the places at which the item would begin by the text's windows within the radius of a group; of some of the texts."""
        near: dict[tuple[int, int], set[int]] = {}
        sizes = np.array([len(split[x]) for x in some], np.int64)
        flat = [x for text in some for x in split[text]]
        first = np.repeat(np.cumsum(sizes) - sizes, sizes)
        last = np.repeat(np.cumsum(sizes), sizes)
        which = np.repeat(np.array(some, np.int64), sizes)
        for base in range(0, len(flat), SPAN):
            # neighbouring spans share enough words that no window is lost between them
            sums = self.sums(self.ids(flat[base : base + SPAN + CLASSES[-1]]))
            here = np.arange(base, min(base + SPAN, len(flat)))
            for c, group in groups.items():
                starts = here[here + c <= last[here]]
                for k in range(0, len(starts), STARTS):
                    own = starts[k : k + STARTS]
                    window, hit = self.found(group, self.fingerprints(sums, own - base, c))
                    texts_, places = which[own[window]], own[window] - first[own[window]] - group["place"][hit]
                    for text, item, at in set(zip(texts_.tolist(), group["item"][hit].tolist(), places.tolist())):
                        near.setdefault((text, item), set()).add(at)
        return near

    def leaks(self, texts: list[str]) -> list[tuple[int, int, float, int, bool]]:
        """(text's place, item's place in the list, similarity, first word, whether a window of the item's size met it) of each item that one of the texts holds."""
        split = [words(t) for t in texts]
        some = self.possible(split)
        whole, parts = (self.windows(split, some, groups) for groups in (self.classes, self.pieces))
        out = []
        shingles: dict[int, set[tuple]] = {}
        at_text = None
        for t, item in sorted(whole.keys() | parts.keys()):
            if t != at_text:
                at_text, shingles = t, {}
            own, w, needed = split[t], self.items[item][1], self.shingles[item]
            k = min(SHINGLE, len(w))
            if k not in shingles:
                shingles[k] = set(zip(*(own[j:] for j in range(k))))
            s = sum(x for shingle, x in needed.items() if shingle in shingles[k]) / sum(needed.values())
            if s >= SIMILARITY:
                ats = whole.get((t, item), set()) | parts.get((t, item), set())
                out.append((t, item, s, max(0, min(ats, key=lambda at: (-self.aligned(item, own, at), at))), (t, item) in whole))
        return out

    def aligned(self, item: int, own: list[str], at: int) -> float:
        """Weight of the item's shingles that stand in their places where the item begins at a word."""
        w, needed = self.items[item][1], self.shingles[item]
        k = min(SHINGLE, len(w))
        return sum(needed[tuple(w[j : j + k])] for j in range(max(0, -at), min(len(w), len(own) - at) - k + 1) if own[at + j : at + j + k] == w[j : j + k])


@lru_cache(maxsize=1)
def _masks() -> np.ndarray:
    return np.array([0, *(1 << i for i in range(16)), *((1 << i) | (1 << j) for i, j in combinations(range(16), 2))], np.int64)


def _word_counts(items: DataFrame) -> DataFrame:
    """(key, text, held) of different item texts: the words of each, with the number of texts that hold them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                rows = [(k, x) for k, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist()) for x in set(words(t))]
                yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], pa.string()) for j in (0, 1)], names=["key", "word"])

    each = items.mapInArrow(run, "key string, word string")
    counts = each.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    own = each.join(counts, "word").groupBy("key").agg(F.collect_list(F.struct("word", "n")).alias("held"))
    return items.join(own, "key")


def _found(docs: DataFrame, benchmark: DataFrame, part_bytes: int) -> DataFrame:
    """(doc_id, sid, item_id, similarity, first_word, by_window); sid is the digest of the document's text."""
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where(F.col("text").isNotNull()).withColumn("key", F.md5(F.col("text").cast("binary")))
    # equal texts are one item
    distinct = written(_word_counts(items.select("key", "text").distinct()), "items")
    total, size = distinct.agg(F.count(F.lit(1)), F.sum(F.octet_length("text"))).first()
    parts = -(-int(size or 0) // part_bytes) or 1
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.md5(F.col("text").cast("string").cast("binary")).alias("sid"), F.col("text").cast("string").alias("text"))
    found = None
    for k in range(parts):
        own = distinct.where(F.pmod(F.xxhash64("key"), F.lit(parts)) == k).orderBy("key").collect()
        sent = spark.sparkContext.broadcast(([(r["key"], r["text"]) for r in own], {w["word"]: w["n"] for r in own for w in r["held"]}))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            texts, held = sent.value
            index = Index(texts, held, total)
            kinds = {"doc_id": pa.int64(), "sid": pa.string(), "key": pa.string(), "similarity": pa.float64(), "first_word": pa.int64(), "by_window": pa.bool_()}
            for batch in batches:
                for part in slices(batch):
                    ids, sids = part.column(0).to_pylist(), part.column(1).to_pylist()
                    made = [(ids[k], sids[k], index.items[i][0], s, at, window) for k, i, s, at, window in index.leaks([t or "" for t in part.column(2).to_pylist()])]
                    yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in made], kind) for j, kind in enumerate(kinds.values())], names=list(kinds))

        one = rows.mapInArrow(run, "doc_id long, sid string, key string, similarity double, first_word long, by_window boolean")
        found = one if found is None else found.unionByName(one)
    return found.join(items.select("key", "item_id").distinct(), "key").drop("key")


def find_leaks(docs: DataFrame, benchmark: DataFrame, part_bytes: int = PART_BYTES) -> DataFrame:
    """(doc_id, item_id, similarity, first_word, by_window) of each benchmark item that a document holds.

    The benchmark's size is looked at first; beyond part_bytes its different texts are cut by hash into parts of about that size, and
    the documents are read once for each of them. A part has the words' weights in the whole benchmark, so results don't depend
    on the parts.
    """
    return _found(docs, benchmark, part_bytes).drop("sid")


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents (all columns) that hold no benchmark item.

    Rows are told apart by doc_id and text, nulls included: of two texts under one doc_id, or without one, only the contaminated
    goes.
    """
    leaked = written(_found(docs, benchmark, PART_BYTES).select(F.col("doc_id").alias("__leaked"), F.col("sid").alias("__text_of")).distinct(), "leaks")
    own = F.md5(docs["text"].cast("string").cast("binary"))
    return docs.join(leaked, docs["doc_id"].cast("long").eqNullSafe(F.col("__leaked")) & own.eqNullSafe(F.col("__text_of")), "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
