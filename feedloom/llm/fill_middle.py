"""Operator 12: fill-in-middle transformation of whole texts.

A text is a sequence of units (a run of ASCII letters, or any other code point). Its code points lie in blocks of a fixed
size; a Fenwick tree over the blocks holds how many units begin in each and how many code points it has. A cut after k units
is found by binary lifting down the tree, which ends at the block where unit k begins, and by the k-th beginning within
that block. Only one part of a long text is ever held as an array.

The two cuts, the form and the order of the pieces come from digits of the SHA-256 of a seed and doc_id, so a row's result
never depends on other rows. Null texts count as empty and, like texts that hold a mark, stay plain; a null doc_id counts as
the empty string in the digest; repeated rows give equal rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedloom.llm.common import slices, table

#: Marks before the prefix, the suffix and the middle.
MARKS = ("<P>", "<S>", "<M>")
#: Of 100 texts so many are transformed, and of 100 of those so many put the suffix first.
TRANSFORMED, SUFFIX_FIRST = 90, 20
#: Code points of a block, and of the part of a text that is an array at once (a multiple of it).
BLOCK, PART = 512, 1 << 20


def beginnings(text: str, start: int, end: int) -> np.ndarray:
    """For each code point of text[start:end] whether a unit begins there."""
    before = max(start - 1, 0)
    points = np.frombuffer(text[before:end].encode("utf-32-le", "surrogatepass"), "<u4")
    letter = ((points | 32) - np.uint32(97)) < 26
    begins = ~letter
    begins[1:] |= ~letter[:-1]
    if start == 0:
        begins[:1] = True
        return begins
    return begins[1:]


class Blocks:
    """A Fenwick tree over the blocks of a text."""

    def __init__(self, text: str, block: int = BLOCK, part: int = PART):
        self.text, self.block = text, block
        counts = []
        for start in range(0, len(text), part):
            begins = beginnings(text, start, min(start + part, len(text)))
            counts.append(np.add.reduceat(begins, np.arange(0, len(begins), block), dtype=np.int64))
        units = np.concatenate(counts) if counts else np.zeros(0, np.int64)
        self.size = len(units)
        sums = np.zeros((self.size + 1, 2), np.int64)
        sums[1:, 0] = units.cumsum()
        sums[1:, 1] = np.minimum(np.arange(1, self.size + 1) * block, len(text))
        #: Units in all.
        self.n = int(sums[-1, 0])
        place = np.arange(self.size + 1)
        self.tree = (sums - sums[place - (place & -place)]).tolist()

    def cut(self, k: int) -> int:
        """Code points before the end of the first k units."""
        at = units = points = 0
        step = 1 << self.size.bit_length()
        while step := step >> 1:
            if at + step <= self.size and units + self.tree[at + step][0] <= k:
                at += step
                units += self.tree[at][0]
                points += self.tree[at][1]
        if at == self.size:
            return points
        begins = beginnings(self.text, points, min(points + self.block, len(self.text)))
        return points + int(np.flatnonzero(begins)[k - units])


def choices(key: Column, seed: str = "1") -> list[Column]:
    """Four numbers of 32 bits: the first groups of eight digits of the SHA-256 of seed, colon and key."""
    digits = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digits, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def fill_in_middle(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), seed: str = "1", marks: tuple[str, str, str] = MARKS, transformed: int = TRANSFORMED, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """`keep`, n, form (plain, psm or spm), prefix_chars and middle_chars (null if plain), and output, the rearranged text."""
    p, s, m = marks
    first, second, third, fourth = choices(F.col("doc_id"), seed)
    whole = F.coalesce(F.col("text").cast("string"), F.lit(""))
    chosen = docs.select(*[F.col(c) for c in keep], whole.alias("__text"), first.alias("__a"), second.alias("__b"), (third % 100 < transformed).alias("__moved"), (fourth % 100 < suffix_first).alias("__spm"))
    schema = T.StructType([*[chosen.schema[c] for c in keep], *[T.StructField(n, T.DataType.fromDDL(t)) for n, t in (("n", "long"), ("form", "string"), ("prefix_chars", "long"), ("middle_chars", "long"), ("output", "string"))]])

    def of(text: str, a: int, b: int, moved: bool, spm: bool) -> tuple:
        blocks = Blocks(text)
        if not text or not moved or any(x in text for x in marks):
            return blocks.n, "plain", None, None, text
        a, b = sorted((a % (blocks.n + 1), b % (blocks.n + 1)))
        a, b = blocks.cut(a), blocks.cut(b)
        if spm:
            return blocks.n, "spm", a, b - a, s + text[b:] + p + text[:a] + m + text[a:b]
        return blocks.n, "psm", a, b - a, p + text[:a] + s + text[b:] + m + text[a:b]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "__text"):
                rows = [of(*r) for r in zip(*(part.column(i).to_pylist() for i in range(len(keep), part.num_columns)))]
                made = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()))]
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(keep))), *made], names=schema.names)

    return chosen.mapInArrow(run, schema)


def restored(output: str | Column, form: str | Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text that fill_in_middle() rearranged. No text that it moved holds a mark, so the marks that are found first are its own."""
    output, form = (F.col(c) if isinstance(c, str) else c for c in (output, form))
    p, s, m = marks
    end = F.length(output) + 1
    middle = F.instr(output, m)

    def between(start: Column, stop: Column, mark: str) -> Column:
        return F.substring(output, start + len(mark), stop - start - len(mark))

    def pieces(first: str, second: str) -> tuple[Column, Column]:
        turn = F.instr(output, second)
        return between(F.lit(1), turn, first), between(turn, middle, second)

    prefix, suffix = pieces(p, s)
    late_suffix, late_prefix = pieces(s, p)
    return (
        F.when(form == "psm", F.concat(prefix, between(middle, end, m), suffix))
        .when(form == "spm", F.concat(late_prefix, between(middle, end, m), late_suffix))
        .otherwise(output)
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle(table(spark, sf_dir, "documents"))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restored("output", "form")).alias("restored_sha256"))


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS units,
    sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS digits FROM documents),
h AS (SELECT doc_id, text, units, len(units)::BIGINT AS n, ('0x' || substr(digits, 1, 8))::BIGINT % (len(units) + 1) AS a,
    ('0x' || substr(digits, 9, 8))::BIGINT % (len(units) + 1) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>')
        OR ('0x' || substr(digits, 17, 8))::BIGINT % 100 >= 90 THEN 'plain'
      WHEN ('0x' || substr(digits, 25, 8))::BIGINT % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM d),
p AS (SELECT doc_id, text, n, form, array_to_string(units[1:least(a, b)], '') AS prefix,
    array_to_string(units[least(a, b) + 1:greatest(a, b)], '') AS middle, array_to_string(units[greatest(a, b) + 1:], '') AS suffix FROM h),
q AS (SELECT doc_id, text, n, form, coalesce(prefix, '') AS prefix, coalesce(middle, '') AS middle, coalesce(suffix, '') AS suffix FROM p)
SELECT doc_id, n, form,
    CASE WHEN form <> 'plain' THEN length(prefix) END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END::BIGINT AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
    sha256(text) AS restored_sha256 FROM q"""
