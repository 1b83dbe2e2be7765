"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedloom.functions.storage import new_path, removed, shared_dir, written, written_at  # noqa: F401

#: UTF-8 bytes of text that a task turns into Python objects at once.
SLICE_BYTES = 1 << 20
#: Labelled rows that a classifier is fitted on at most (the ones with the smallest hash of their id).
LABEL_BOUND = 20_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: str | Column = "doc_id") -> Column:
    """True for the fold that no operator learns from: crc32 of the id as text, modulo 4, is 2."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def label_sample(labels: DataFrame, column: str, bound: int = LABEL_BOUND) -> DataFrame:
    """(doc_id, label) of at most `bound` labelled rows outside the held-out fold, each id once; contradicting labels of an id: the larger."""
    return (
        labels.where(F.col("doc_id").isNotNull() & F.col(column).isNotNull() & ~held_out())
        .groupBy("doc_id").agg(F.max(F.col(column).cast("int")).alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
    )


def slices(batch: pa.RecordBatch, text: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of a batch, each of about `limit` bytes of text at most (or of one row)."""
    size = batch.column(batch.schema.get_field_index(text))
    size = pc.fill_null(pc.binary_length(size), 0).to_numpy(zero_copy_only=False)
    start, total = 0, 0
    for i, n in enumerate(size.tolist()):
        if total and total + n > limit:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < batch.num_rows:
        yield batch.slice(start)


def map_texts(df: DataFrame, f: Callable[[], Callable[[list[str]], dict[str, pa.Array | list]]], made: list[tuple[str, str]], keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """`keep` columns of df, and those made of each list of texts (null: empty); made: their (name, type).

    f() is called once a task and gives the function of the texts, so that whatever this remembers ends with the task. A text that
    is kept crosses to Python once.
    """
    kept = text in keep and df.schema[text].dataType == T.StringType()
    chosen = df.select(*[F.col(c) for c in keep], *([] if kept else [F.col(text).cast("string").alias("__text")]))
    at = keep.index(text) if kept else len(keep)
    schema = T.StructType([*[chosen.schema[c] for c in keep], *[T.StructField(n, T.DataType.fromDDL(t)) for n, t in made]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = f()
        for batch in batches:
            for part in slices(batch, batch.schema.names[at]):
                out = of([t or "" for t in part.column(at).to_pylist()])
                arrays = [part.column(i) for i in range(len(keep))] + [x if isinstance(x := out[n], (pa.Array, pa.ChunkedArray)) else pa.array(x, ARROW[t]) for n, t in made]
                yield pa.RecordBatch.from_arrays(arrays, names=[*keep, *(n for n, _ in made)])

    return chosen.mapInArrow(run, schema)


def rows_where(docs: DataFrame, score: Callable[[DataFrame, tuple[str, ...], str], DataFrame], condition: Column) -> DataFrame:
    """All columns of the rows of docs whose score meets the condition; columns may have any names, also the score's own."""
    own = [f"__c{i}" for i in range(len(docs.columns))]
    wide = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, own)])
    return score(wide, tuple(own), own[docs.columns.index("text")]).where(condition).select(*[F.col(n).alias(c) for c, n in zip(docs.columns, own)])


#: Arrow types of the columns that map_texts makes.
ARROW = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "binary": pa.binary(), "string": pa.string(), "boolean": pa.bool_(), "array<float>": pa.list_(pa.float32()), "array<long>": pa.list_(pa.int64()), "array<double>": pa.list_(pa.float64()), "array<struct<first:int,last:int,score:double>>": pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("score", pa.float64())]))}

#: DuckDB: a common table expression fold(doc_id, held_out) over the labelled ids, as held_out() has it; crc32 spelt out bit by bit.
FOLD_SQL = """fold AS (SELECT doc_id, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
  lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295) % 4 = 2 AS held_out
  FROM (SELECT DISTINCT doc_id FROM labels))"""
