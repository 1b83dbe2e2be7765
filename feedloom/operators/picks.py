"""Basket selection: ordered baskets with targets, caps of a source over all baskets, one item of a duplicate key, then a fill."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def basket_picks(df: DataFrame, run: str, order: list[Column], baskets: dict[str, int], caps: dict[str, int], other_cap: int, target: int) -> DataFrame:
    """(run, id, pick_order) of rows (run, id, basket, source, dup).

    Windows first keep what can be picked at all. Of rows with one duplicate key in a basket and source only the first can be. A row
    is passed over if its source is full, and then so are all after it, or if its key was taken, which needs a pick for each key;
    so per run, basket and source no more rows are looked at than the cap and all picks together. That bounds the rows of a run,
    whatever its size and its number of keys; the fold over them runs in one task per run.
    """
    cap = F.coalesce(F.create_map(*[F.lit(x) for item in caps.items() for x in item])[F.col("source")], F.lit(other_cap)) if caps else F.lit(other_cap)
    keyed = df.withColumn("__keyed", F.col("dup").isNotNull())
    first = F.row_number().over(Window.partitionBy(run, "basket", "source", "__keyed", "dup").orderBy(*order))
    distinct = keyed.withColumn("__first", first).where(~F.col("__keyed") | (F.col("__first") == 1))
    own = F.row_number().over(Window.partitionBy(run, "basket", "source").orderBy(*order))
    reached = distinct.withColumn("__own", own).where(F.col("__own") <= cap + max(target, sum(baskets.values())))
    few = reached.withColumn("place", F.row_number().over(Window.partitionBy(run).orderBy(*order))).select(run, "id", "basket", "source", "dup", "place")

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("place")
        chosen, counts, seen, per = [], {}, set(), dict.fromkeys(baskets, 0)

        def add(r) -> None:
            if r.id in chosen or counts.get(r.source, 0) >= caps.get(r.source, other_cap) or (r.dup is not None and r.dup in seen):
                return
            chosen.append(r.id)
            counts[r.source] = counts.get(r.source, 0) + 1
            if r.basket in per:
                per[r.basket] += 1
            if r.dup is not None:
                seen.add(r.dup)

        items = [r for r in rows.astype(object).where(rows.notna(), None).itertuples(index=False)]
        for basket, most in baskets.items():
            for r in items:
                if r.basket == basket:
                    add(r)
                    if per[basket] >= most:
                        break
        for r in items:
            if len(chosen) >= target:
                break
            add(r)
        return pd.DataFrame({run: [rows[run].iloc[0]] * len(chosen), "id": chosen, "pick_order": range(1, len(chosen) + 1)})

    schema = T.StructType([few.schema[run], few.schema["id"], T.StructField("pick_order", T.LongType())])
    return few.groupBy(run).applyInPandas(fold, schema)
