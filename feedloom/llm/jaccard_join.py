"""Operator 10: n-gram Jaccard join with Bayesian candidate pruning.

Texts are sets of five-word shingles (lower-cased words; fewer words: one shingle of all). Equal texts become one
representative first. Representatives that agree in one of BANDS bands of ROWS MinHash values are candidates; at a similarity of
0.8 a pair meets in none with a probability below 5e-8. A candidate's one-byte MinHash values are compared STEP by STEP; with m of n
equal, the pair goes when the posterior probability (uniform prior) that its similarity reaches the threshold is below
TOLERANCE. What remains is verified exactly on the shingle sets.

Buckets of more than HOT members are cut into blocks by salt, and two blocks meet in one task, which hands on only counts and a
spanning forest; smaller ones become pairs. A pair belongs to the first hot band in which it agrees, else to the pairs, so no
link is counted twice. Classes are the connected components, by alternating large-star and small-star rounds on tables in the
shared folder.

Null texts and texts without words have no shingles: they are linked to nothing, not even to each other. Equal texts with words
are linked. n_links counts the other rows whose similarity with the row is at least 0.8, repeated rows included.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from feedloom.llm.common import slices, table, written

SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS = 32, 4
#: Values compared before each look at the posterior, and the probability below which a pair goes.
STEP, TOLERANCE = 32, 1e-4
#: Members of a bucket that pairs are made of; members of a block of a larger one, about, and their shingles (of 8 bytes) together.
HOT, BLOCK, BLOCK_SHINGLES = 20, 768, 2_000_000
#: Pairs of a block that are compared at once.
AT_ONCE = 50_000
_WORD = re.compile(r"\w+")


def shingles(text: str) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles."""
    words = _WORD.findall(text.lower())
    if not words:
        return np.zeros(0, np.uint64)
    joined = [" ".join(words[i : i + SHINGLE]) for i in range(max(1, len(words) - SHINGLE + 1))]
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, joined), np.uint64, len(joined)))


@lru_cache(maxsize=1)
def _hashes() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(5)
    n = BANDS * ROWS
    return rng.integers(1, 1 << 32, n, dtype=np.uint64).astype(np.uint32) | np.uint32(1), rng.integers(1, 1 << 32, n, dtype=np.uint64).astype(np.uint32) | np.uint32(1)


def minhash(own: np.ndarray) -> np.ndarray:
    """BANDS x ROWS smallest 32-bit values of as many hash functions."""
    a, b = _hashes()
    low, high = own.astype(np.uint32), (own >> np.uint64(32)).astype(np.uint32)
    best = np.full(len(a), np.iinfo(np.uint32).max, np.uint32)
    for start in range(0, len(own), 512):
        # two odd multipliers and a shift mix both halves; only the order of the values matters
        v = low[start : start + 512, None] * a + high[start : start + 512, None] * b
        v ^= v >> np.uint32(15)
        v *= np.uint32(0x2C1B3C6D)
        best = np.minimum(best, v.min(0))
    return best


@lru_cache(maxsize=1)
def least_equal() -> dict[int, int]:
    """For n compared values the fewest equal ones with which a pair stays."""
    # one byte agrees by chance too, so the threshold is a little higher for bytes
    t = THRESHOLD + (1 - THRESHOLD) / 256
    out = {}
    for n in range(STEP, BANDS * ROWS + 1, STEP):
        # the posterior of m equal ones of n is Beta(m+1, n-m+1); its mass above t is P(Binomial(n+1, t) <= m)
        mass = np.cumsum([math.comb(n + 1, k) * t**k * (1 - t) ** (n + 1 - k) for k in range(n + 1)])
        out[n] = int(np.searchsorted(mass, TOLERANCE))
    return out


def survivors(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Which pairs of rows of two tables of bytes the comparison leaves."""
    alive, equal = np.arange(len(left)), np.zeros(len(left), np.int32)
    for n, least in least_equal().items():
        equal = equal + (left[alive, n - STEP : n] == right[alive, n - STEP : n]).sum(1)
        stay = equal >= least
        alive, equal = alive[stay], equal[stay]
    return alive


def _keyed(docs: DataFrame) -> DataFrame:
    """(sid, doc_id, text) of rows with a word; sid is the text's digest."""
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).where(F.col("text").rlike(r"[\p{L}\p{N}\p{M}_]"))
    return texts.select(F.unhex(F.md5(F.col("text").cast("binary"))).alias("sid"), "doc_id", "text")


def sketches(docs: DataFrame) -> DataFrame:
    """(sid, first, copies, bytes, bands, size) of each distinct text with a shingle; size is the number of shingles. Sketches are made where the texts are read; only they move."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, tuple] = {}
        for batch in batches:
            for part in slices(batch):
                out = ([], [], [], [], [])
                for sid, doc, text in zip(*(part.column(i).to_pylist() for i in range(3))):
                    if sid not in known:
                        if len(known) > 4096:
                            known.clear()
                        own = shingles(text)
                        m = minhash(own) if len(own) else None
                        known[sid] = (None, None, 0) if m is None else (
                            (m >> np.uint32(8)).astype(np.uint8).tobytes(), [xxhash.xxh64_intdigest(m[i * ROWS : (i + 1) * ROWS].tobytes(), i) - (1 << 63) for i in range(BANDS)], len(own))
                    values, bands, size = known[sid]
                    if values is not None:
                        for x, y in zip(out, (sid, doc, values, bands, size)):
                            x.append(y)
                yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(out, (pa.binary(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.int64()))], names=["sid", "doc_id", "bytes", "bands", "size"])

    rows = _keyed(docs).select("sid", F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "sid binary, doc_id long, bytes binary, bands array<long>, size long")
    return rows.groupBy("sid").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("copies"), F.first("bytes").alias("bytes"), F.first("bands").alias("bands"), F.first("size").alias("size"))


def _pairs(members: DataFrame, sketched: DataFrame) -> DataFrame:
    """(a, b, copies of both) of the pairs from small buckets that the comparison leaves.

    The members of a bucket stand together in a sorted partition, at most HOT of them, and are compared there; so what moves grows
    with the members and not with the pairs.
    """
    rows = members.join(sketched, "sid").select("band", "sid", "copies", "bytes", "hot").repartition("band").sortWithinPartitions("band", "sid")
    names = ["a", "b", "a_copies", "b_copies"]

    def of_bucket(bucket: list[tuple], out: list[list]) -> None:
        values = np.frombuffer(b"".join(r[3] for r in bucket), np.uint8).reshape(-1, BANDS * ROWS)
        a, b = np.triu_indices(len(bucket), 1)
        for i in survivors(values[a], values[b]).tolist():
            x, y = bucket[a[i]], bucket[b[i]]
            # a pair that agrees in a hot band is the blocks' business
            if x[1] != y[1] and not (x[4] and y[4] and set(x[4]) & set(y[4])):
                for column, v in zip(out, (x[1], y[1], x[2], y[2])):
                    column.append(v)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket: list[tuple] = []
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for row in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if bucket and bucket[0][0] != row[0]:
                    of_bucket(bucket, out)
                    bucket = []
                bucket.append(row)
            yield _pair_batch(out, names)
        out = [[], [], [], []]
        if bucket:
            of_bucket(bucket, out)
        yield _pair_batch(out, names)

    # a pair meets in several bands
    return rows.mapInArrow(run, "a binary, b binary, a_copies long, b_copies long").distinct()


def _pair_batch(out: list[list], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(out, (pa.binary(), pa.binary(), pa.int64(), pa.int64()))], names=names)


def _verified(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """(sid, other, links) both ways of the pairs that reach the threshold. A text `a` is read once for all its partners."""
    text = reps.select("sid", "text")
    partners = pairs.join(text.withColumnRenamed("sid", "b"), "b").select("a", "b", "a_copies", "b_copies", "text")
    heads = pairs.select(F.col("a").alias("sid")).distinct().join(text, "sid").select(F.col("sid").alias("a"), F.lit(None).cast("binary").alias("b"), F.lit(0).cast("long").alias("a_copies"), F.lit(0).cast("long").alias("b_copies"), "text")
    rows = heads.unionByName(partners).repartition("a").sortWithinPartitions("a", F.col("b").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own = None, frozenset()
        for batch in batches:
            out = ([], [], [])
            for part in slices(batch):
                for a, b, ca, cb, t in zip(*(part.column(i).to_pylist() for i in range(5))):
                    these = frozenset(shingles(t).tolist())
                    if b is None:
                        at, own = a, these
                        continue
                    assert a == at
                    common = len(own & these)
                    if common >= THRESHOLD * (len(own) + len(these) - common):
                        for s, o, n in ((a, b, cb), (b, a, ca)):
                            out[0].append(s)
                            out[1].append(o)
                            out[2].append(n)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.binary()), pa.array(out[1], pa.binary()), pa.array(out[2], pa.int64())], names=["sid", "other", "links"])

    return rows.mapInArrow(run, "sid binary, other binary, links long")


def _in_blocks(hot: DataFrame, sketched: DataFrame, reps: DataFrame) -> DataFrame:
    """(sid, other, links) from hot buckets (band, n, weight, sid): for each block pair the links of a member, and one member of its tree.

    weight is the number of shingles of all members: long texts make smaller blocks, so a task's memory is bounded.
    """
    parts = F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("weight") / BLOCK_SHINGLES)).cast("int")
    own = F.pmod(F.xxhash64("sid", "band"), parts).cast("int")
    salted = hot.select("band", "sid", parts.alias("parts"), own.alias("own"))
    meet = salted.select("band", "sid", "own", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("with"))
    keyed = meet.select("band", "sid", "own", F.least("own", "with").alias("i"), F.greatest("own", "with").alias("j"))
    full = keyed.join(sketched.select("sid", "copies", "bytes", "hot"), "sid").join(reps.select("sid", "text"), "sid")

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        band, i, j = key
        values = np.frombuffer(b"".join(rows["bytes"]), np.uint8).reshape(-1, BANDS * ROWS)
        block = rows["own"].to_numpy()
        a, b = np.triu_indices(len(rows), 1)
        if i != j:
            apart = block[a] != block[b]
            a, b = a[apart], b[apart]
        # bands come in one order in every row: this band owns the pair if no earlier hot one is common
        earlier = [h[: list(h).index(band)] for h in rows["hot"]]
        counts = Counter(x for own in earlier for x in own)
        place = {x: k for k, x in enumerate(x for x, n in counts.items() if n > 1)}
        common = np.zeros((len(rows), len(rows)), bool)
        for first in range(0, len(place), 1024):
            marks = np.zeros((len(rows), 1024), np.float32)
            for x, own in enumerate(earlier):
                marks[x, [k - first for y in own if first <= (k := place.get(y, -1)) < first + 1024]] = 1
            common |= marks @ marks.T > 0
        owned = ~common[a, b]
        a, b = a[owned], b[owned]
        stay = np.concatenate([np.zeros(0, np.int64), *(s + survivors(values[a[s : s + AT_ONCE]], values[b[s : s + AT_ONCE]]) for s in range(0, len(a), AT_ONCE))])
        a, b = a[stay], b[stay]
        texts, sids, copies = rows["text"].tolist(), rows["sid"].tolist(), rows["copies"].to_numpy()
        # shingles of all members as small numbers, one member after another
        asked = np.unique(np.concatenate([a, b]))
        own = [shingles(texts[x]) for x in asked.tolist()]
        size = np.zeros(len(rows), np.int64)
        size[asked] = [len(x) for x in own]
        _, flat = np.unique(np.concatenate([np.zeros(0, np.uint64), *own]), return_inverse=True)
        last = np.cumsum(size)
        links, root = np.zeros(len(rows), np.int64), list(range(len(rows)))

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        held = np.zeros(int(flat.max()) + 1 if len(flat) else 0, bool)
        order = np.argsort(a, kind="stable")
        a, b = a[order], b[order]
        heads, starts = np.unique(a, return_index=True)
        for x, partners in zip(heads.tolist(), np.split(b, starts[1:])):
            mine = flat[last[x] - size[x] : last[x]]
            held[mine] = True
            common = np.array([np.count_nonzero(held[flat[last[y] - size[y] : last[y]]]) for y in partners.tolist()])
            held[mine] = False
            near = partners[common >= THRESHOLD * (size[x] + size[partners] - common)]
            links[x] += copies[near].sum()
            links[near] += copies[x]
            for y in near.tolist():
                root[find(x)] = find(y)
        found = [x for x in range(len(rows)) if links[x]]
        return pd.DataFrame({"sid": [sids[x] for x in found], "other": [sids[find(x)] for x in found], "links": links[found]})

    return full.groupBy("band", "i", "j").applyInPandas(run, "sid binary, other binary, links long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of the nodes of edges (u, v); root is the smallest node of the component."""
    now = written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    state = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        now = written(small.where("u <> v").distinct(), "edges")
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v") % 1_000_003), F.sum(F.xxhash64("v", "u") % 998_244_353)).first()
        if seen == state:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        state = seen


def join(docs: DataFrame) -> DataFrame:
    """(doc_id, sid, class_id, n_links) of each row: the smallest doc_id of its class, and its number of similar other rows."""
    raw = written(sketches(docs), "sketches")
    each = raw.select("sid", "size", F.explode("bands").alias("band"))
    # counts in bands with one member are dropped before anything is joined
    sizes = each.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("weight")).where("n > 1")
    members = written(each.drop("size").join(sizes, "band"), "members")
    hot = members.where(F.col("n") > HOT)
    mine = hot.groupBy("sid").agg(F.collect_set("band").alias("hot"))  # BANDS at most
    reps = raw.select("sid", "first", "copies")
    sketched = written(raw.join(mine, "sid", "left").select("sid", "copies", "bytes", F.array_sort(F.coalesce("hot", F.array().cast("array<bigint>"))).alias("hot")), "marked")
    pairs = written(_pairs(members.where(F.col("n") <= HOT).select("band", "sid"), sketched), "pairs")
    # texts are needed of what is still in question only
    asked = pairs.select(F.col("a").alias("sid")).unionByName(pairs.select(F.col("b").alias("sid"))).unionByName(hot.select("sid")).distinct()
    firsts = written(asked.join(reps, "sid").select("sid", "first"), "asked")
    # always by shuffle: whether `firsts` could be sent to all tasks depends on the input
    texts = written(_keyed(docs).join(firsts.hint("merge"), "sid").where(F.col("doc_id").eqNullSafe(F.col("first"))).groupBy("sid").agg(F.first("text").alias("text")), "texts")
    links = written(_verified(pairs, texts).unionByName(_in_blocks(hot, sketched, texts)), "links")
    classes = components(links.select(F.col("sid").alias("u"), F.col("other").alias("v")))
    known = reps.join(classes.withColumnRenamed("node", "sid"), "sid", "left").select("sid", "first", "copies", F.coalesce("root", "sid").alias("root"))
    ids = known.groupBy("root").agg(F.min("first").alias("class_id"))
    total = links.groupBy("sid").agg(F.sum("links").alias("links"))
    result = written(known.join(ids, "root").join(total, "sid", "left").select("sid", F.col("root").alias("class_sid"), "class_id", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")), "classes")
    rows = docs.select("doc_id", F.unhex(F.md5(F.col("text").cast("string").cast("binary"))).alias("sid"))
    empty = F.coalesce(F.col("sid"), F.unhex(F.md5(F.col("doc_id").cast("string").cast("binary"))))  # spread: nulls would meet in one task
    return rows.withColumn("sid", empty).join(result, "sid", "left").select("doc_id", "sid", "class_sid", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The documents (all columns) of which one row of each class stays: the smallest doc_id (null only if the class has no other), of its texts the one with the smallest digest, of equal rows any one.

    Rows without words, and rows without a link, all stay. Classes are classes of texts, so a doc_id that stands on several texts
    loses only those that are copies.
    """
    linked = written(join(docs).where("n_links > 0").select(F.col("doc_id").cast("long").alias("doc_id"), "sid", "class_sid"), "linked")
    best = linked.groupBy("class_sid").agg(F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "sid")).alias("best"))
    # a key that is never null, so that one exchange serves join and window
    key = lambda c: F.coalesce(F.concat(F.lit("#"), c.cast("string")), F.lit(""))
    # found by id and text, not by class: a class may hold a large part of all rows
    winners = best.select(key(F.col("best.doc_id")).alias("__id"), F.col("best.sid").alias("__sid"), F.lit(True).alias("__best"))
    members = linked.select(key(F.col("doc_id")).alias("__id"), F.col("sid").alias("__sid")).distinct()
    marks = members.join(winners, ["__id", "__sid"], "left").select("__id", "__sid", F.col("__best").isNotNull().alias("__stays"))
    keyed = docs.withColumns({"__id": key(docs["doc_id"].cast("long")), "__sid": F.unhex(F.md5(F.col("text").cast("string").cast("binary")))})
    # texts move once: join and window deal out by the same keys
    met = keyed.join(written(marks, "marks").hint("merge"), ["__id", "__sid"], "left").where("__stays IS NULL OR __stays")
    place = F.row_number().over(Window.partitionBy("__id", "__sid").orderBy("__stays"))
    return met.withColumn("__n", place).where("__stays IS NULL OR __n = 1").select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links")
