"""Operator 7: token counts by rank-synchronous merging of ragged numpy arrays.

Every distinct pre-token of a slice of texts is one run of symbols in a flat array. In each round all runs look up the rank of
every adjacent pair at once, each run applies its lowest-ranked pair at all its places, and runs without a known pair leave
with their number of symbols. Merges of a trained vocabulary never make a pair that ranks below the one just applied, so
this equals the usual merge order.

Nulls and empty texts have 0 tokens and 0 bytes; repeated rows are counted each; further columns of the input are ignored.
"""

from __future__ import annotations

import json
from functools import lru_cache
from pathlib import Path

import numpy as np
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.llm.common import map_texts, table
from feedloom.llm.pretokens import chunks, finder

#: Pre-tokens whose counts a worker remembers at most, from one task to the next (about 160 bytes each, 64 MB); more are computed again.
CACHE = 400_000
#: Context length of the digest column over_limit.
LIMIT = 512


@lru_cache(maxsize=2)
def vocabulary(path: str):
    """(symbol of each byte, sorted pair keys, their ranks, merged symbols, base of the keys, special strings)."""
    spec = json.loads(Path(path).read_text(encoding="utf-8"))
    ids = spec["model"]["vocab"]
    # printable bytes stand for themselves, the others for code points from 256 on
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    letter = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(other)}
    first = np.array([ids[letter[b]] for b in range(256)], np.int64)
    base = max(ids.values()) + 1
    pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
    keys = np.array([ids[a] * base + ids[b] for a, b in pairs], np.int64)
    made = np.array([ids[a + b] for a, b in pairs], np.int64)
    order = np.argsort(keys, kind="stable")
    special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
    return first, keys[order], order.astype(np.int64), made[order], base, special


def count_symbols(words: list[bytes], path: str) -> np.ndarray:
    """How many symbols are left of each word (none empty) when no pair can merge."""
    first, keys, ranks, made, base, _ = vocabulary(path)
    none = np.int64(1 << 40)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    result = sizes.copy()
    sym = first[np.frombuffer(b"".join(words), np.uint8)]
    run = np.repeat(np.arange(len(words)), sizes)
    while len(sym):
        key = sym[:-1] * base + sym[1:]
        at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        known = (keys[at] == key) & (run[:-1] == run[1:])
        rank = np.append(np.where(known, ranks[at], none), none)
        starts = np.flatnonzero(np.append(True, run[1:] != run[:-1]))
        lengths = np.diff(np.append(starts, len(run)))
        lowest = np.minimum.reduceat(rank, starts)
        result[run[starts]] = lengths
        low = np.repeat(lowest, lengths)
        take = (rank == low) & (low < none)
        # of overlapping places ("aaa") every second one counts, from the left
        place = np.arange(len(take))
        head = np.maximum.accumulate(np.where(take & ~np.append(False, take[:-1]), place, 0))
        take &= (place - head) % 2 == 0
        where = np.flatnonzero(take)
        sym[where] = made[at[where]]
        left = low < none
        left[where + 1] = False
        sym, run = sym[left], run[left]
    return result


@lru_cache(maxsize=1)
def _counter(path: str, pattern: str):
    known: dict[str, int] = {}

    def count(texts: list[str]) -> dict[str, list]:
        special = vocabulary(path)[-1]
        split = regex.compile("|".join(map(regex.escape, special))) if special else None
        find = finder(pattern)
        totals, sizes = [], []
        for text in texts:
            total = 0
            spans, at = [], 0
            if split:
                for m in split.finditer(text):
                    spans.append(text[at : m.start()])
                    at, total = m.end(), total + 1
            spans.append(text[at:])
            for part in spans:
                for chunk in chunks(part):
                    words = find(chunk)
                    if fresh := set(words).difference(known):
                        if len(known) + len(fresh) > CACHE:
                            known.clear()
                            fresh = set(words)
                        fresh = list(fresh)
                        known.update(zip(fresh, count_symbols([w.encode() for w in fresh], path).tolist()))
                    total += sum(map(known.__getitem__, words))
            totals.append(total)
            sizes.append(len(text.encode()))
        return {"n_bytes": sizes, "n_tokens": totals}

    return count


def token_counts(docs: DataFrame, path: str, pattern: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep`, n_bytes (UTF-8) and n_tokens of each text, by the byte-level BPE vocabulary (.json) at `path`."""
    return map_texts(docs, lambda: _counter(path, pattern), [("n_bytes", "long"), ("n_tokens", "long")], keep)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    return token_counts(table(spark, sf_dir, "documents"), P.path("byte_bpe_50k.json"), P.PATTERN).withColumn("over_limit", F.col("n_tokens") > LIMIT)
