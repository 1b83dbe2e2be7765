"""Operator 9: byte-level BPE encoding and decoding.

The bytes of a pre-token, read as Latin-1, run once through an Aho-Corasick automaton of the vocabulary. From the left the
longest match is taken whose neighbour it may stand beside: two tokens fit if undoing their merges never meets a pair
that would have merged across their border first (memoised). A place that no token leads on from is closed and the last
token gives way to its next shorter match, so each place is left at most once for each match that begins there.

Nulls and empty texts give no ids and empty bytes; repeated rows are encoded each; further columns of the input are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Callable
from functools import lru_cache
from pathlib import Path

import ahocorasick
import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.llm.common import map_texts, table
from feedloom.llm.pretokens import chunks, finder

#: Pre-tokens (about 240 bytes each, 96 MB) and token pairs (about 90 bytes each, 36 MB) that a worker remembers at most, from one task to the next.
CACHE, PAIRS = 400_000, 400_000


class Codec:
    def __init__(self, path: str):
        self.bytes = token_bytes(path)
        self.ids = {token: i for i, token in enumerate(self.bytes) if token}
        #: Halves that the last merge of a token joins; a token that nothing merges into has itself twice.
        self.left = list(range(len(self.bytes)))
        self.right = list(range(len(self.bytes)))
        self.merged: dict[tuple[int, int], int] = {}
        self.fits: dict[int, bool] = {}
        self.known: dict[str, tuple[int, ...]] = {}
        self.automaton = ahocorasick.Automaton()
        for token, i in sorted(self.ids.items(), key=lambda x: x[1]):
            if len(token) == 1 or self._learn(token, i):
                self.automaton.add_word(token.decode("latin-1"), (len(token), i))
        self.automaton.make_automaton()

    def _learn(self, token: bytes, i: int) -> bool:
        """Finds the pair that makes the token; False if merging its bytes never arrives at it."""
        for cut in range(1, len(token)):
            a, b = self.ids.get(token[:cut], i), self.ids.get(token[cut:], i)
            if a < i and b < i and self._apart(a, b):
                self.left[i], self.right[i] = a, b
                self.merged[a, b] = i
                return True
        return False

    def _apart(self, a: int, b: int) -> bool:
        """Whether the tokens stay side by side: no merge across their border comes before those that made them."""
        before = len(self.bytes)
        while True:
            if self.merged.get((a, b), before) < before:
                return False
            # the one merged later is undone first; what stands at the border is then its inner half
            for own in ("a", "b") if a > b else ("b", "a"):
                token = a if own == "a" else b
                half = self.right[token] if own == "a" else self.left[token]
                if half != token:
                    before = token + (own == "b")
                    a, b = (half, b) if own == "a" else (a, half)
                    break
            else:
                return True

    def _beside(self, a: int, b: int) -> bool:
        key = a << 32 | b
        fit = self.fits.get(key)
        if fit is None:
            if len(self.fits) >= PAIRS:
                self.fits.clear()
            fit = self.fits[key] = self._apart(a, b)
        return fit

    def encode_word(self, word: str) -> tuple[int, ...]:
        raw = word.encode()
        whole = self.ids.get(raw)
        if whole is not None:
            return (whole,)
        size = len(raw)
        begin: list[list[tuple[int, int]]] = [[] for _ in range(size)]
        for end, match in self.automaton.iter(raw.decode("latin-1")):
            begin[end + 1 - match[0]].append(match)  # shorter ones come first
        is_open = bytearray(b"\1") * (size + 1)
        taken: list[tuple[int, int]] = []  # (token, which of the matches at its place)
        at, k = 0, len(begin[0]) - 1
        while at < size:
            while k >= 0:
                n, token = begin[at][k]
                if is_open[at + n] and (not taken or self._beside(taken[-1][0], token)):
                    break
                k -= 1
            if k >= 0:
                taken.append((token, k))
                at += n
                k = len(begin[at]) - 1 if at < size else -1
            else:
                is_open[at] = 0
                token, k = taken.pop()
                at -= len(self.bytes[token])
                k -= 1
        return tuple(t for t, _ in taken)

    def encode(self, text: str, find) -> np.ndarray:
        parts = []
        for chunk in chunks(text):
            words = find(chunk)
            known = self.known
            if fresh := set(words).difference(known):
                if len(known) + len(fresh) > CACHE:
                    known.clear()
                    fresh = set(words)
                for w in fresh:
                    known[w] = self.encode_word(w)
            flat: list[int] = []
            for w in words:
                flat += known[w]
            parts.append(np.array(flat, "<u4"))
        return np.concatenate(parts)


@lru_cache(maxsize=1)
def codec(path: str) -> Codec:
    return Codec(path)


@lru_cache(maxsize=1)
def token_bytes(path: str) -> list[bytes]:
    """The bytes of each id."""
    ranks = [line.split() for line in Path(path).read_bytes().split(b"\n") if line.strip()]
    out = [b""] * (1 + max(int(i) for _, i in ranks))
    for token, i in ranks:
        out[int(i)] = base64.b64decode(token)
    return out


def _encoder(path: str, pattern: str) -> Callable[[list[str]], dict[str, list]]:
    own, find = codec(path), finder(pattern)

    def of(texts: list[str]) -> dict[str, list]:
        ids = [own.encode(t, find) for t in texts]
        return {"n_tokens": [len(x) for x in ids], "ids": [x.tobytes() for x in ids]}

    return of


def encode(docs: DataFrame, path: str, pattern: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep`, n_tokens and ids (little-endian unsigned 32-bit integers, one after another) of each text."""
    return map_texts(docs, lambda: _encoder(path, pattern), [("n_tokens", "long"), ("ids", "binary")], keep)


def decoded(path: str, ids: bytes) -> bytes:
    return b"".join(map(token_bytes(path).__getitem__, np.frombuffer(ids, "<u4").tolist()))


def decode(encoded: DataFrame, path: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep` and bytes, those that the ids stand for (not always valid UTF-8 if the ids come from elsewhere)."""
    import pyarrow as pa
    from pyspark.sql import types as T

    chosen = encoded.select(*keep, F.coalesce("ids", F.lit(b"")).alias("ids"))

    def run(batches):
        for batch in batches:
            # few rows at a time: the bytes are some times as long as the ids
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                made = [decoded(path, x) for x in part.column(len(keep)).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(made, pa.binary())], names=[*keep, "bytes"])

    return chosen.mapInArrow(run, T.StructType([*[chosen.schema[c] for c in keep], T.StructField("bytes", T.BinaryType())]))


def round_trip(docs: DataFrame) -> DataFrame:
    """doc_id, n_tokens, and the digests of the ids and of the bytes they decode to; encoded and decoded in one pass over the texts."""
    import public_tokenizers as P

    path = P.path("byte_bpe_multi_50k.tiktoken")

    def run() -> Callable[[list[str]], dict[str, list]]:
        encoded = _encoder(path, P.PATTERN)

        def of(texts: list[str]) -> dict[str, list]:
            out = encoded(texts)
            return {**out, "decoded": [decoded(path, x) for x in out["ids"]]}

        return of

    coded = map_texts(docs, run, [("n_tokens", "long"), ("ids", "binary"), ("decoded", "binary")])
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"))
