"""Operator 13: SentencePiece encoding and decoding that keeps the source offsets.

The model file is read as it is: pieces, scores, kinds, and the normalisation rules with their compiled character map (a double
array of rule keys and a string of replacements). Normalisation takes at each place the longest rule that fits and records for
every code point it makes the source byte that it comes from. The normalised text falls into runs that no merge can cross,
those are merged by score (the leftmost of equal ones first) and remembered, and the pieces' lengths, read through the
alignment, give each piece its byte span in the source. Code points without a piece become byte pieces, of which the last
has the span.

Null texts count as empty: no piece but the end id where one is asked for. Repeated rows are encoded each; further columns
of the input are ignored. Models with user-defined or unused pieces, or of another kind than BPE, are refused.
"""

from __future__ import annotations

import hashlib
import heapq
import struct
from collections.abc import Callable, Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.llm.common import map_texts, table

#: The mark that stands for a space, and what the decoder writes for an unknown piece or byte.
SPACE, UNKNOWN = "▁", "�"
#: Runs that a worker remembers at most, from one task to the next (about 240 bytes each, 96 MB). Longer ones than RUN code points are not remembered, and merged one by one.
CACHE, RUN = 400_000, 48
#: Above any symbol; makes one key of two.
WIDE = 1 << 21
#: Code points of normalised text that are merged at once.
PART = 1 << 20
#: Kinds of pieces in a model file.
NORMAL, UNKNOWN_KIND, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = raw[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while at < len(raw):
        key = varint()
        if key & 7 == 0:
            value = varint()
        else:
            size = {1: 8, 5: 4}.get(key & 7) or varint()
            value, at = raw[at : at + size], at + size
        yield key >> 3, value


class Rules:
    """Normalisation: the compiled character map, and what is done to spaces."""

    def __init__(self, spec: dict[int, int | bytes]):
        self.prefix, self.squeeze, self.escape = (bool(spec.get(k, 1)) for k in (3, 4, 5))
        compiled = spec.get(2, b"")
        self.units, self.made = [], b""
        if compiled:
            size = struct.unpack_from("<I", compiled)[0]
            self.units = np.frombuffer(compiled, "<u4", size // 4, 4).tolist()
            self.made = compiled[4 + size :]
        self.values: dict[int, str] = {}

    def rule(self, source: bytes, at: int) -> tuple[int, str] | None:
        """Length and replacement of the longest rule whose key stands at a place of the source."""
        units, found = self.units, None
        node = self._step(units[0])
        for i in range(at, len(source)):
            byte = source[i]
            node ^= byte
            if node >= len(units) or units[node] & 0x800000FF != byte:
                break
            unit = units[node]
            node ^= self._step(unit)
            if unit >> 8 & 1:
                found = i + 1 - at, units[node] & 0x7FFFFFFF
        if not found:
            return None
        size, value = found
        if value not in self.values:
            self.values[value] = self.made[value : self.made.index(0, value)].decode()
        return size, self.values[value]

    @staticmethod
    def _step(unit: int) -> int:
        return unit >> 10 << ((unit & 0x200) >> 6)

    def __call__(self, text: str) -> tuple[str, np.ndarray]:
        """The normalised text, and for each of its code points, and for its end, the source byte where it begins."""
        if not text:
            return "", np.zeros(1, np.int64)
        mark = SPACE if self.escape else " "
        if not self.units and not self.squeeze:
            points = np.frombuffer(text.encode("utf-32-le"), "<u4")
            begin = np.zeros(len(points) + 1 + self.prefix, np.int64)
            sizes = 1 + (points >= 0x80).astype(np.int8) + (points >= 0x800) + (points >= 0x10000)
            np.cumsum(sizes, out=begin[1 + self.prefix :])
            return (mark if self.prefix else "") + text.replace(" ", mark), begin
        source = text.encode()
        out: list[str] = []
        begin: list[int] = []
        at, spaced = 0, self.squeeze
        leading = self.squeeze
        while at < len(source):
            hit = self.rule(source, at) if self.units else None
            if hit is None:
                lead = source[at]
                size = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
                hit = size, source[at : at + size].decode()
            size, new = hit
            if leading and new == " ":
                at += size
                continue
            if leading or at == 0:
                leading = False
                if self.prefix and not out:
                    out.append(mark)
                    begin.append(at)
            if spaced:
                new = new.lstrip(" ")
            if new:
                spaced = new.endswith(" ")
                out.append(new.replace(" ", mark))
                begin += [at] * len(new)
            at += size
            spaced = spaced and self.squeeze
        if not out:
            return "", np.zeros(1, np.int64)
        made, end = "".join(out), at
        if self.squeeze:
            kept = len(made.rstrip(mark))
            if kept < len(made):
                end = begin[kept]
                made, begin = made[:kept], begin[:kept]
        return made, np.array([*begin, end], np.int64)


class Model:
    def __init__(self, raw: bytes):
        pieces, kinds, self.scores = [], [], {}
        trainer: dict = {}
        spec: dict = {}
        for number, value in fields(raw):
            if number == 1:
                own = dict(fields(value))
                piece, kind = own[1].decode(), own.get(3, NORMAL)
                if kind == NORMAL:
                    self.scores[piece] = (struct.unpack("<f", own.get(2, bytes(4)))[0], len(pieces))
                pieces.append(piece)
                kinds.append(kind)
            elif number == 2:
                trainer = dict(fields(value))
            elif number == 3:
                spec = dict(fields(value))
        if trainer.get(3) != 2 or {USER, UNUSED} & set(kinds):
            raise ValueError("only BPE models without user-defined and unused pieces are supported")
        self.normalise = Rules(spec)
        self.dropped = self.normalise.prefix or self.normalise.squeeze
        self.fallback = bool(trainer.get(35, 0))
        self.unknown, self.end = trainer.get(40, 0), trainer.get(42, 2)
        self.of_byte = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(pieces, kinds)) if k == BYTE}
        #: What each id is decoded to, the code points of its piece, and the byte that it stands for (else -1).
        question = trainer.get(44, " ⁇ ".encode())
        self.bytes = [b"" if k == CONTROL else question if k == UNKNOWN_KIND else bytes([int(p[3:5], 16)]) if k == BYTE else p.replace(SPACE, " ").encode() for p, k in zip(pieces, kinds)]
        self.sizes = np.array([len(p) if k == NORMAL else 0 for p, k in zip(pieces, kinds)], np.int64)
        self.byte = np.array([int(p[3:5], 16) if k == BYTE else -1 for p, k in zip(pieces, kinds)], np.int64)
        self.control = [k == CONTROL for k in kinds]
        self.controls = {i for i, c in enumerate(self.control) if c}
        self.spaced = [k == NORMAL and p.startswith(SPACE) for p, k in zip(pieces, kinds)]
        # a run ends before a space mark that follows another code point, if no piece has such a place inside
        self.apart = apart = all(SPACE not in p.lstrip(SPACE) for p in self.scores)
        self.runs = regex.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+" if apart else "(?s).+")
        self.border = regex.compile(f"(?<=[^{SPACE}]){SPACE}" if apart else "(?!)")
        self.known: dict[str, tuple[int, ...]] = {}
        self._pairs(len(pieces))

    def _pairs(self, n: int) -> None:
        """All pairs of symbols that make a piece: their keys, the rank of the score, and the piece. A code point without a piece is a symbol too."""
        self.base = n
        self.symbol = np.arange(n, n + 0x110000, dtype=np.int64)
        for c, (_, i) in self.scores.items():
            if len(c) == 1:
                self.symbol[ord(c)] = i
        of = lambda x: self.scores[x][1] if x in self.scores else n + ord(x) if len(x) == 1 else None
        rank = {v: i for i, v in enumerate(sorted({v for v, _ in self.scores.values()}, reverse=True))}
        found = [(a * WIDE + b, rank[score], i) for piece, (score, i) in self.scores.items() for k in range(1, len(piece)) if (a := of(piece[:k])) is not None and (b := of(piece[k:])) is not None]
        self.keys, self.ranks, self.joined = np.array(sorted(found), np.int64).reshape(-1, 3).T.copy()

    def merge_all(self, runs: list[str]) -> list[tuple[int, ...]]:
        """Ids of each of many short runs: in every round each of them joins its best pair, the leftmost of equal ones."""
        none = np.int64(1 << 40)
        sizes = np.fromiter(map(len, runs), np.int64, len(runs))
        sym = self.symbol[np.frombuffer("".join(runs).encode("utf-32-le"), "<u4")]
        run = np.repeat(np.arange(len(runs)), sizes)
        last = np.append(run[1:] != run[:-1], True)

        def look(at: np.ndarray) -> None:
            """Looks up the pairs that begin at these places; none begins at the end of a run."""
            inner = at[~last[at]]
            key = sym[inner] * WIDE + sym[inner + 1]
            place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[place] == key
            rank[at], made[at] = none, 0
            rank[inner[hit]], made[inner[hit]] = self.ranks[place[hit]], self.joined[place[hit]]

        rank, made = np.full(len(sym), none), np.zeros(len(sym), np.int64)
        look(np.arange(len(sym)))
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(sym):
            starts = np.flatnonzero(np.append(True, last[:-1]))
            lengths = np.diff(np.append(starts, len(sym)))
            low = np.repeat(np.minimum.reduceat(rank, starts), lengths)
            over = low == none
            if over.any():
                done.append((run[over], sym[over]))
            best = np.flatnonzero((rank == low) & ~over)
            best = best[np.append(True, run[best[1:]] != run[best[:-1]])] if len(best) else best
            sym[best] = made[best]
            last[best] = last[best + 1]
            left = ~over
            left[best + 1] = False
            place = np.cumsum(left) - 1
            sym, run, last, rank, made = sym[left], run[left], last[left], rank[left], made[left]
            if len(best):
                changed = place[best]
                before = changed[changed > 0] - 1
                look(np.concatenate((changed, before)))
        order = np.argsort(runs_of := np.concatenate([r for r, _ in done]), kind="stable")
        ids = np.concatenate([s for _, s in done])[order]
        ends = np.cumsum(np.bincount(runs_of, minlength=len(runs))).tolist()
        strange = set(runs_of[order][ids >= self.base].tolist())
        listed = ids.tolist()
        out, at = [], 0
        for end in ends:
            out.append(tuple(listed[at:end]))
            at = end
        for i in strange:
            out[i] = self._known_ids(out[i])
        return out

    def _known_ids(self, symbols: tuple[int, ...]) -> tuple[int, ...]:
        """Byte pieces, or the unknown id, for the code points that have no piece."""
        out: list[int] = []
        for x in symbols:
            if x < self.base:
                out.append(x)
            elif self.fallback:
                out += [self.of_byte[b] for b in chr(x - self.base).encode()]
            else:
                out.append(self.unknown)
        return tuple(out)

    def split(self, text: str) -> list[str]:
        """The runs of a part of a normalised text."""
        if not self.apart or SPACE + SPACE in text:
            return self.runs.findall(text)
        first, *others = text.split(SPACE)
        made = [SPACE + x for x in others]
        return [first, *made] if first else made

    def merge(self, run: str) -> tuple[int, ...]:
        """Ids of a run: adjacent pieces with the best score are joined, until no two make a piece."""
        scores = self.scores
        parts: list[str | None] = list(run)
        n = len(parts)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        agenda = [(-s[0], i, 2) for i in range(n - 1) if (s := scores.get(run[i : i + 2]))]
        heapq.heapify(agenda)
        while agenda:
            _, i, size = heapq.heappop(agenda)
            j = after[i]
            if parts[i] is None or j >= n or len(parts[i]) + len(parts[j]) != size:
                continue
            parts[i] += parts[j]
            parts[j] = None
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if s := scores.get(parts[i] + parts[k]):
                    heapq.heappush(agenda, (-s[0], i, size + len(parts[k])))
            if (h := before[i]) >= 0 and (s := scores.get(parts[h] + parts[i])):
                heapq.heappush(agenda, (-s[0], h, len(parts[h]) + size))
        out: list[int] = []
        for part in parts:
            if part is not None:
                if s := scores.get(part):
                    out.append(s[1])
                elif self.fallback:
                    out += [self.of_byte[b] for b in part.encode()]
                else:
                    out.append(self.unknown)
        return tuple(out)

    def parts(self, text: str) -> Iterator[str]:
        """A normalised text in parts of about PART code points that no run crosses."""
        at = 0
        while at < len(text):
            cut = self.border.search(text, at + PART) if len(text) - at > PART else None
            stop = cut.start() if cut else len(text)
            yield text[at:stop]
            at = stop

    def ids(self, texts: list[str]) -> list[list[int]]:
        """Ids of normalised texts. Runs of many texts are merged together, as far as PART code points."""
        flats: list[list[int]] = [[] for _ in texts]
        waiting: list[tuple[int, list[str]]] = []

        def settle() -> None:
            known = self.known
            self.learn(set().union(*(runs for _, runs in waiting)))
            for i, runs in waiting:
                flat = flats[i]
                for r in runs:
                    flat += known[r] if len(r) <= RUN else self.merge(r)
            waiting.clear()

        size = 0
        for i, text in enumerate(texts):
            for part in self.parts(text):
                waiting.append((i, self.split(part)))
                size += len(part)
                if size >= PART:
                    settle()
                    size = 0
        settle()
        return flats

    def learn(self, runs: set[str]) -> None:
        """Sees to it that all short runs are known."""
        fresh = runs.difference(self.known)
        if len(self.known) + len(fresh) > CACHE:
            self.known.clear()
            fresh = runs
        if short := [r for r in fresh if len(r) <= RUN]:
            self.known.update(zip(short, self.merge_all(short)))

    def ends(self, ids: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """Source byte where the span of each piece ends; it begins where the one before it ends."""
        sizes, byte = self.sizes[ids], self.byte[ids]
        is_byte = byte >= 0
        follows = np.append(byte[1:], -1)
        sizes[is_byte & ~((follows >= 0x80) & (follows < 0xC0))] = 1
        sizes[ids == self.unknown] = 1
        return begin[np.cumsum(sizes)]

    def encode(self, texts: list[str], end: bool = False) -> Iterator[tuple[list[int], np.ndarray]]:
        """Of each text the ids, and where each one's span ends in the UTF-8 bytes of the text."""
        normal = [self.normalise(t) for t in texts]
        for ids, (_, begin) in zip(self.ids([t for t, _ in normal]), normal):
            if end:
                ids.append(self.end)
            yield ids, self.ends(np.array(ids, np.int64), begin)

    def decode(self, ids: list[int]) -> str:
        """The text of ids. The space before the first word goes if the model put it there; bytes that are no UTF-8 become U+FFFD each."""
        out = [self.bytes[i] for i in ids]
        if self.dropped:
            first = next((k for k, i in enumerate(ids) if not self.control[i]), None)
            if first is not None and self.spaced[ids[first]]:
                out[first] = out[first].lstrip(b" ") if self.normalise.squeeze else out[first][1:]
        whole = len(ids)
        while whole and self.control[ids[whole - 1]]:
            whole -= 1
        # a control piece parts the bytes beside it
        if self.controls.isdisjoint(ids[:whole]):
            try:
                return b"".join(out).decode()
            except UnicodeDecodeError:
                pass
        return self._mended(ids, out)

    def _mended(self, ids: list[int], out: list[bytes]) -> str:
        made, run = [], bytearray()

        def flush() -> None:
            at = 0
            while at < len(run):
                lead = run[at]
                size = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
                try:
                    made.append(bytes(run[at : at + size]).decode())
                    at += size
                except UnicodeDecodeError:
                    made.append(UNKNOWN)
                    at += 1
            run.clear()

        for i, piece in zip(ids, out):
            if self.byte[i] >= 0:
                run += piece
            else:
                flush()
                made.append(piece.decode())
        flush()
        return "".join(made)


@lru_cache(maxsize=1)
def model(path: str) -> Model:
    return Model(Path(path).read_bytes())


def encode(docs: DataFrame, path: str, keep: tuple[str, ...] = ("doc_id",), end: bool = False) -> DataFrame:
    """`keep`, n_tokens, ids, and ends: where each piece's span ends in the UTF-8 bytes of the text (it begins where the one before ends)."""
    def run() -> Callable[[list[str]], dict[str, list]]:
        own = model(path)

        def of(texts: list[str]) -> dict[str, list]:
            made = list(own.encode(texts, end))
            return {"n_tokens": [len(i) for i, _ in made], "ids": [i for i, _ in made], "ends": [e for _, e in made]}

        return of

    return map_texts(docs, run, [("n_tokens", "long"), ("ids", "array<long>"), ("ends", "array<long>")], keep)


def decode(encoded: DataFrame, path: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep`, and text, the one that the ids of a row stand for (null: none)."""
    import pyarrow as pa
    from pyspark.sql import types as T

    chosen = encoded.select(*keep, F.coalesce("ids", F.array().cast("array<bigint>")).alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model(path)
        for batch in batches:
            for start in range(0, batch.num_rows, 200):
                part = batch.slice(start, 200)
                texts = [own.decode(i) for i in part.column(len(keep)).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(texts, pa.string())], names=[*keep, "text"])

    return chosen.mapInArrow(run, T.StructType([*[chosen.schema[c] for c in keep], T.StructField("text", T.StringType())]))


def round_trip(docs: DataFrame, path: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep`, n_tokens with the end id, digests of the ids and of the text they decode to, and source_bytes, where the last piece's span ends."""
    def run() -> Callable[[list[str]], dict[str, list]]:
        own = model(path)
        decimal = [str(i) for i in range(len(own.bytes))]
        digest = lambda x: hashlib.sha256(x.encode()).hexdigest()

        def of(texts: list[str]) -> dict[str, list]:
            out: dict[str, list] = {"n_tokens": [], "ids_sha256": [], "decoded_sha256": [], "source_bytes": []}
            for ids, ends in own.encode(texts, end=True):
                for name, value in zip(out, (len(ids), digest(" ".join(map(decimal.__getitem__, ids))), digest(own.decode(ids)), int(ends[-1]))):
                    out[name].append(value)
            return out

        return of

    return map_texts(docs, run, [("n_tokens", "long"), ("ids_sha256", "string"), ("decoded_sha256", "string"), ("source_bytes", "long")], keep)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    return round_trip(table(spark, sf_dir, "documents"), P.path("piece_bpe_32k.model"))
