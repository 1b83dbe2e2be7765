"""Streams that end in a keyed store: merged observations, and keys that are handed out once for ever."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.functions.storage import new_path
from feedloom.functions.text import noon_window
from feedloom.operators.merges import best_per_key
from feedloom.operators.store import KeyedStore


def _run(stream: DataFrame, batch: Callable[[DataFrame, int], None], checkpoint: str | None) -> None:
    place = checkpoint or new_path(stream.sparkSession, "offsets")
    stream.writeStream.foreachBatch(batch).option("checkpointLocation", place).trigger(availableNow=True).start().awaitTermination()


def merged(stream: DataFrame, store: KeyedStore, shape: Callable[[DataFrame], DataFrame], order: Sequence[Column], policy: Mapping[str, str], writer: str, checkpoint: str | None = None) -> None:
    """Merges all that has landed into a store, batch by batch; shape() makes rows of the store's schema from a batch. Each batch counts once, however often it is run."""
    _run(stream, lambda rows, number: store.merge(shape(rows), order, policy, writer, number) and None, checkpoint)


def once_ever(stream: DataFrame, key: str, order: Sequence[Column], ledger: KeyedStore, hand_out: Callable[[DataFrame, int], None], run: str, checkpoint: str | None = None) -> None:
    """Hands out the first row of each key that no run has handed out before, whatever time has passed.

    The ledger (columns key, run, batch) is asked only in the buckets of a batch's keys, and those only where their Bloom
    filters don't rule the keys out. Keys are entered before they are handed out; a batch that failed in between finds its own
    entries under its run and number and hands the same rows out again, so hand_out should write under that number.
    """

    def batch(rows: DataFrame, number: int) -> None:
        first = best_per_key(rows, [key], order)
        asked = first.select(F.col(key).alias("key"))
        others = ledger.rows_like(asked).where(~(F.col("run").eqNullSafe(run) & F.col("batch").eqNullSafe(number)))
        known = others.select(F.col("key").alias("__key"))
        fresh = first.join(known, F.col(key).eqNullSafe(F.col("__key")), "left_anti")
        entry = fresh.select(F.col(key).alias("key"), F.lit(run).alias("run"), F.lit(number).cast("bigint").alias("batch"))
        ledger.merge(entry, [F.col("batch")], {"run": "old", "batch": "old"})
        own = ledger.rows_like(asked).where((F.col("run") == run) & (F.col("batch") == number)).select(F.col("key").alias("__key"))
        hand_out(first.join(own, F.col(key).eqNullSafe(F.col("__key")), "left_semi"), number)

    _run(stream, batch, checkpoint)


def noon_sides(stream: DataFrame, published: str, observed: str, store: KeyedStore, writer: str, grace: str = "1 day", checkpoint: str | None = None) -> None:
    """Counts rows into a store (day, side, n) by the day from noon to noon of their effective time and by what they are to it.

    observation: the source doesn't say when it published. early: published after it was observed. late: observed when its day had
    been over for `grace`. on_time: all others. A row's side depends on the row alone, so late rows are counted whatever the
    order of arrival, and no state grows but the counts; a batch that is repeated counts once.
    """

    def sides(rows: DataFrame) -> DataFrame:
        day = noon_window(F.coalesce(published, observed))
        over = day + F.expr("INTERVAL 1 DAY") + F.expr(f"INTERVAL {grace}")
        side = (
            F.when(F.col(published).isNull(), "observation").when(F.col(published) > F.col(observed), "early")
            .when(F.col(observed) >= over, "late").otherwise("on_time"))
        return rows.groupBy(day.alias("day"), side.alias("side")).agg(F.count(F.lit(1)).alias("n"))

    merged(stream, store, sides, [F.col("n")], {"n": "sum"}, writer, checkpoint)
