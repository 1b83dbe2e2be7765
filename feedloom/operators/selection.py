"""Rankings, quotas and diverse choices as windows."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedloom.functions.storage import written

#: Quotas of the daily choice.
TOTAL, PER_THEME, SOFTWARE, LEAST_SCORE = 10, 3, 2, 55


def numbered(df: DataFrame, name: str, order: list[Column], by: list[str] | None = None) -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*(by or [])).orderBy(*order)))


def numbered_apart(df: DataFrame, name: str, order: list[Column], by: list[str] | None = None) -> DataFrame:
    """numbered() for groups too large for one task: `order` must tell the rows of a group apart, or equal ones are numbered in any order.

    Rows are dealt into sorted ranges over group and order, also in the middle of a group; each piece numbers its own rows of a
    group, and the sizes of the pieces before it, summed up, are added. Only those sums pass a task a group, a row a piece.
    Nulls sort as `order` says, and null groups are groups.
    """
    by = by or []
    # rows that are alike in all of `order` would be one piece however many they are
    last = F.xxhash64(*[F.col(f"`{f.name}`") for f in df.schema if not isinstance(f.dataType, (T.MapType, T.VariantType))])
    dealt = df.repartitionByRange(*[F.col(b) for b in by], *order, last).withColumn("__piece", F.spark_partition_id())
    pieces = written(dealt, "pieces")
    local = pieces.withColumn(name, F.row_number().over(Window.partitionBy("__piece", *by).orderBy(*order)))
    sizes = pieces.groupBy("__piece", *by).agg(F.count(F.lit(1)).alias("__n"))
    earlier = F.sum("__n").over(Window.partitionBy(*(by or [F.lit(0)])).orderBy("__piece").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select(F.col("__piece").alias("__p"), *[F.col(b).alias(f"__by{i}") for i, b in enumerate(by)], F.coalesce(earlier, F.lit(0)).alias("__start"))
    same = [F.col("__piece") == F.col("__p"), *[F.col(b).eqNullSafe(F.col(f"__by{i}")) for i, b in enumerate(by)]]
    return local.join(starts, same).select(*df.columns, (F.col(name) + F.col("__start")).cast("int").alias(name))


def ranked(value: Column, values: list[str]) -> Column:
    """Place of a value in a list, for sorting; what isn't in it comes last."""
    places = F.create_map(*[x for i, v in enumerate(values) for x in (F.lit(v), F.lit(i))])
    return F.coalesce(places[value], F.lit(len(values)))


def quota_choice(df: DataFrame, run: str, order: list[Column], is_software: Column, score: Column) -> DataFrame:
    """Adds chosen_rank and exclusion for each run: at least LEAST_SCORE, three a theme, two software items, ten in all; others before software.

    A rejected item uses no quota and a full quota stays full, so one window after another equals taking items one by one.
    """
    kind = is_software.cast("int")
    rows = df.withColumn("__kind", kind).withColumn("__ok", score >= LEAST_SCORE)
    first = [F.col("__kind"), *order]
    by = lambda *names: Window.partitionBy(run, *names).orderBy(*first)
    rows = rows.withColumn("__theme", F.when(F.col("__ok"), F.row_number().over(by("__ok", "theme")))).withColumn("__a", F.coalesce(F.col("__theme") <= PER_THEME, F.lit(False)))
    rows = rows.withColumn("__soft", F.when(F.col("__a") & (F.col("__kind") == 1), F.row_number().over(by("__a", "__kind")))).withColumn("__b", F.col("__a") & (F.coalesce("__soft", F.lit(0)) <= SOFTWARE))
    rows = rows.withColumn("__n", F.when(F.col("__b"), F.row_number().over(by("__b")))).withColumn("__c", F.col("__b") & (F.col("__n") <= TOTAL))
    # what the loop would see when it comes to an item: how many were chosen before
    before = F.coalesce(F.sum(F.col("__c").cast("int")).over(Window.partitionBy(run).orderBy(*first).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    soft = F.col("__kind") == 1
    reason = (
        F.when(F.col("__c"), F.lit(None)).when(~F.col("__ok"), "quality_score").when(before >= TOTAL, F.when(soft, "software_quota").otherwise("lower_final_score")).when(~F.col("__a"), "theme_quota").otherwise("software_quota"))
    return rows.withColumn("exclusion", reason).withColumn("chosen_rank", F.when(F.col("__c"), F.col("__n"))).drop(*[c for c in rows.columns if c.startswith("__")])


def round_robin(df: DataFrame, kind: str, order: list[Column], limit: int) -> DataFrame:
    """First of each kind, then second of each, up to limit; kinds by name."""
    # no kind gives more than `limit` rows, so only those are sorted
    turn = numbered(df, "turn", order, [kind]).where(F.col("turn") <= limit)
    return turn.orderBy("turn", kind).limit(limit)


def quota_then_best(df: DataFrame, kind: str, quota: int, order: list[Column], limit: int) -> DataFrame:
    """`quota` of each kind first, then the best of the rest."""
    placed = numbered(df, "__in_kind", order, [kind]).where(F.col("__in_kind") <= max(quota, limit)).withColumn("in_quota", F.col("__in_kind") <= quota)
    return placed.orderBy(F.col("in_quota").desc(), *order).limit(limit).drop("__in_kind")


def seeded_sample(df: DataFrame, by: list[str], key: str, seed: str, n: int) -> DataFrame:
    """n rows of each group, the same ones for the same seed."""
    return numbered(df.withColumn("__h", F.md5(F.concat(F.lit(seed), F.col(key).cast("string")))), "__n", [F.col("__h"), F.col(key)], by).where(F.col("__n") <= n).drop("__h", "__n")


def pages(df: DataFrame, order: list[Column], size: int, by: list[str]) -> DataFrame:
    """Adds page (from 0) and place (from 1) within each group."""
    return numbered(df, "place", order, by).withColumn("page", F.floor((F.col("place") - 1) / size))


def greedy_distinct(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Of nodes (id, rank) those that a pass by rank keeps: one goes if it has an edge (a, b) to a kept better one.

    Rounds on written tables: undecided nodes without an undecided better neighbour are decided, until none is left.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    better = both.join(nodes.select(F.col("id").alias("a"), F.col("rank").alias("ra")), "a").join(nodes.select(F.col("id").alias("b"), F.col("rank").alias("rb")), "b").where("rb < ra").select("a", "b")
    better = written(better, "better")
    state = written(nodes.join(better.select(F.col("a").alias("id")).distinct(), "id", "left_anti").select("id", F.lit(True).alias("kept")), "state")
    open_ = nodes.select("id").join(state, "id", "left_anti")
    while open_.limit(1).count():
        seen = better.join(open_.withColumnRenamed("id", "a"), "a", "left_semi").join(state.select(F.col("id").alias("b"), "kept"), "b", "left")
        known = seen.groupBy("a").agg(F.max(F.coalesce("kept", F.lit(False))).alias("loses"), F.bool_or(F.col("kept").isNull()).alias("waits"))
        decided = known.where("loses OR NOT waits").select(F.col("a").alias("id"), (~F.col("loses")).alias("kept"))
        state = written(state.unionByName(decided), "state")
        open_ = nodes.select("id").join(state, "id", "left_anti")
    return nodes.join(state, "id").select("id", "rank", "kept")


def packed(df: DataFrame, by: str, order: str, size: str, limit: int) -> DataFrame:
    """Adds chunk (from 0): rows of a group in order, a new chunk where the next row would pass the limit.

    Groups are dealt out in sorted pieces, so a large one isn't one task's. A piece doesn't know how full the chunk is that it goes
    on with; it tells for every filling how full its last chunk will be and how many chunks it begins (at most `limit` steps). These
    are chained from piece to piece, and with the filling known each piece numbers its rows. Only ids and sizes move.
    """
    narrow = df.select(by, order, size)
    piece = narrow.schema.fields
    pieces = written(narrow.repartitionByRange(by, order).withColumn("__piece", F.spark_partition_id()), "pieces")
    steps = "array<struct<over:bigint,filled:bigint,chunks:bigint>>"
    told = T.StructType([piece[0], *(T.StructField(n, T.DataType.fromDDL(t)) for n, t in (("__piece", "int"), ("fresh", "struct<filled:bigint,chunks:bigint>"), ("steps", steps), ("total", "bigint")))])

    def tell(rows: pd.DataFrame) -> pd.DataFrame:
        sizes = rows.sort_values(order)[size].fillna(0).to_numpy(np.int64)
        sums = np.append(0, np.cumsum(sizes))
        n = len(sizes)
        # where the chunk that begins at each row ends: past the limit, but not before it holds anything
        ends = np.maximum(np.searchsorted(sums, sums[:-1] + limit, "right") - 1, np.searchsorted(sums, sums[:-1], "right"))
        filled, chunks = np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int64)
        for k in range(n - 1, -1, -1):
            filled[k], chunks[k] = (filled[ends[k]], chunks[ends[k]] + 1) if ends[k] < n else (sums[n] - sums[k], 1)
        found, lowest = [], limit + 1
        for k in range(n):
            # a chunk filled over this begins a new one at row k
            over = limit - int(sums[k + 1])
            if over < lowest:
                found.append({"over": over, "filled": int(filled[k]), "chunks": int(chunks[k])})
                lowest = over
            if over <= 0:
                break
        one = {by: rows[by].iloc[0], "__piece": int(rows["__piece"].iloc[0]), "fresh": {"filled": int(filled[0]), "chunks": int(chunks[0]) - 1}, "steps": found, "total": int(sums[n])}
        return pd.DataFrame([one])

    def chain(rows: pd.DataFrame) -> pd.DataFrame:
        out, full, number = [], 0, 0
        for r in rows.sort_values("__piece").itertuples(index=False):
            piece_, fresh, found, total = r[1], r[2], r[3], r[4]
            out.append((r[0], piece_, full, number))
            if full == 0:
                full, number = fresh["filled"], number + fresh["chunks"]
            else:
                step = next((s for s in found if full > s["over"]), None)
                full, number = (step["filled"], number + step["chunks"]) if step else (full + total, number)
        return pd.DataFrame(out, columns=[by, "__piece", "full", "number"])

    def number(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(order)
        full, chunk, out = int(rows["full"].iloc[0]), int(rows["number"].iloc[0]), []
        for s in rows[size].fillna(0):
            if full and full + s > limit:
                chunk, full = chunk + 1, 0
            full += s
            out.append(chunk)
        return rows[[by, order, size]].assign(chunk=out)

    entries = pieces.groupBy(by, "__piece").applyInPandas(tell, told).groupBy(by).applyInPandas(chain, T.StructType([piece[0], *(T.StructField(n, T.LongType()) for n in ("__piece", "full", "number"))]))
    known = pieces.join(written(entries, "entries"), [by, "__piece"])
    return known.groupBy(by, "__piece").applyInPandas(number, T.StructType([*piece, T.StructField("chunk", T.LongType())]))
