"""Delivery in chunks that can be taken up again: what the ledger holds as delivered isn't handed out a second time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.functions.storage import new_path

def resumed(stream: DataFrame, key: str, ledger: str, hand_out: Callable[[DataFrame, int], None], run: str, checkpoint: str | None = None) -> None:
    """Runs a stream over all that has landed; each batch's keys that the ledger doesn't hold are handed out, then entered under run and batch.

    A batch that fails between the two is handed out again under the same number, so hand_out should write under that number.
    """
    spark = stream.sparkSession

    def batch(rows: DataFrame, number: int) -> None:
        others = entries(spark, ledger).where(~((F.col("run") == run) & (F.col("batch") == number)))
        fresh = rows.join(others.select(F.col("key").alias(key)).distinct(), key, "left_anti")
        hand_out(fresh, number)
        # a repeated batch replaces its own entries
        fresh.groupBy(F.col(key).cast("string").alias("key")).agg(F.count(F.lit(1)).alias("chunks")).write.mode("overwrite").parquet(f"{ledger}/run={run}/batch={number}")

    spark.createDataFrame([], "key string, chunks bigint").write.mode("ignore").parquet(f"{ledger}/run=none/batch=-1")
    stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint or new_path(spark, "offsets")).trigger(availableNow=True).start().awaitTermination()


def entries(spark: SparkSession, ledger: str) -> DataFrame:
    """(key, chunks, run, batch) of what was delivered."""
    return spark.read.schema("key string, chunks bigint, run string, batch bigint").parquet(ledger)
