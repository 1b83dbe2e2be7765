"""Keyed writes as joins: each takes the stored rows and a batch and returns the rows to store."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedloom.functions.storage import written


def best_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int = 1, rank: str = "row_number") -> DataFrame:
    """The first n rows of each key; rank="rank" keeps ties."""
    place = (F.row_number() if rank == "row_number" else F.rank()).over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__place", place).where(F.col("__place") <= n).drop("__place")


def upsert(old: DataFrame, batch: DataFrame, keys: Sequence[str], order: Sequence[Column], policy: Mapping[str, str] | None = None) -> DataFrame:
    """Stored rows with the batch put over them; of equal keys in the batch the first in `order` counts.

    Null keys are keys like others: equal to each other and to nothing else. policy says for a column: new (default), old (the stored value stays), fill (new unless null), or (either is true), max, sum.
    """
    policy = policy or {}
    new = best_per_key(batch, keys, order)
    a, b = old.alias("a"), new.withColumn("__in_batch", F.lit(True)).alias("b")
    met = a.join(b, [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys], "full_outer")
    in_batch = F.col("b.__in_batch").isNotNull()

    def value(c: str) -> Column:
        x, y = F.col(f"a.{c}"), F.col(f"b.{c}")
        kind = policy.get(c, "new")
        if c in keys or kind == "fill":
            return F.coalesce(y, x)
        if kind == "old":
            return F.coalesce(x, y)
        if kind == "or":
            return F.coalesce(x, F.lit(False)) | F.coalesce(y, F.lit(False))
        if kind == "max":
            return F.greatest(x, y)
        if kind == "sum":
            return F.coalesce(x + y, x, y)
        return F.when(in_batch, y).otherwise(x)

    return met.select(*[value(c).alias(c) for c in old.columns])


def upsert_counts(old: DataFrame, batch: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(saved, duplicates): new keys, and batch rows beyond them."""
    fresh = batch.select(*keys).distinct().join(old.select(*keys).distinct(), list(keys), "left_anti").agg(F.count(F.lit(1)).alias("saved"))
    return fresh.join(F.broadcast(batch.agg(F.count(F.lit(1)).alias("n")))).select("saved", (F.col("n") - F.col("saved")).alias("duplicates"))


def insert_absent(old: DataFrame, batch: DataFrame, unique: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Stored rows, and those of the batch that would be let in one after another: a row is if no stored row and no row let in before it has one of its unique values.

    Rows that wait for an earlier one are decided in rounds on written tables, so a row that clashes only with a refused one gets
    in. Rows are taken in `order`; of equal ones in the order of their unique values. Null values clash with nothing.
    """
    mine = batch.select(*old.columns)
    keyed = reduce(lambda a, b: a | b, [F.col(k).isNotNull() for k in unique])
    kept, mine = mine.where(~keyed), best_per_key(mine.where(keyed), unique, order)
    for k in unique:
        mine = mine.join(old.select(k).where(F.col(k).isNotNull()).distinct(), k, "left_anti")
    state = written(mine.select(*old.columns), "fresh")
    while True:
        ranked = state
        for i, k in enumerate(unique):
            # nulls are told apart, as they clash with nothing
            first = Window.partitionBy(k, F.when(F.col(k).isNull(), F.xxhash64(*unique))).orderBy(*order, *unique)
            ranked = ranked.withColumn(f"__{i}", F.row_number().over(first))
        now = written(ranked.withColumn("__in", reduce(lambda a, b: a & b, [F.col(f"__{i}") == 1 for i in range(len(unique))])), "round")
        chosen = now.where("__in").select(*old.columns)
        kept = kept.unionByName(chosen)
        rest = now.where("NOT __in").select(*old.columns)
        for k in unique:
            rest = rest.join(chosen.select(k).where(F.col(k).isNotNull()).distinct(), k, "left_anti")
        state = written(rest.select(*old.columns), "fresh")
        if state.isEmpty():
            return old.unionByName(kept)


def attached(df: DataFrame, key: str, results: Sequence[tuple[DataFrame, Mapping[str, object]]]) -> DataFrame:
    """df with the columns of each result (one row a key at most) and their defaults where a key has none."""
    for result, defaults in results:
        df = df.join(result.select(key, *defaults), key, "left")
        df = df.withColumns({c: F.coalesce(c, F.array().cast(result.schema[c].dataType) if v == [] else F.lit(v).cast(result.schema[c].dataType)) for c, v in defaults.items()})
    return df


def checked_records(df: DataFrame, filled: Sequence[str], url: str, text: str) -> DataFrame:
    """Adds valid: all of `filled` hold more than white space and the URL is http(s) with a host; a null text becomes empty."""
    address = F.coalesce(F.col(url).rlike(r"(?i)^https?://[^/?#\s]+"), F.lit(False))
    full = reduce(lambda a, b: a & b, [F.coalesce(F.trim(F.col(c)) != "", F.lit(False)) for c in filled], address)
    return df.withColumn("valid", full).withColumn(text, F.coalesce(text, F.lit("")))


def changes_only(df: DataFrame, keys: Sequence[str], order: Sequence[Column], value: Column) -> DataFrame:
    """Rows whose value differs from the one before of the same key; first ones stay."""
    before = F.lag(F.struct(value.alias("v"))).over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__before", before).where(F.col("__before").isNull() | ~F.col("__before.v").eqNullSafe(value)).drop("__before")


def replace_slice(old: DataFrame, rows: DataFrame, column: str, value) -> DataFrame:
    """Stored rows of other slices, and `rows` as the new slice."""
    return old.where(~F.col(column).eqNullSafe(F.lit(value))).unionByName(rows.where(F.col(column) == value))


def canonical(entries: Column) -> Column:
    """Text of a map that doesn't depend on the order of its keys."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(entries))))


def difference(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(side, key) of the keys that only one of the frames has."""
    one = lambda a, b, side: a.select(key).distinct().join(b.select(key), key, "left_anti").select(F.lit(side).alias("side"), key)
    return one(left, right, "missing").unionByName(one(right, left, "extra"))
