"""A keyed store in files by key bucket: a batch reads and replaces only the buckets of its keys, and one manifest makes that atomic.

Below the store's folder:

    manifests/000000000012.json   bucket -> write that holds it, and the last batch of each writer that is in it
    writes/<id>/rows/__bucket=7   the rows of a bucket as one write left them
    writes/<id>/filter/__bucket=7 optional: a Bloom filter of the bucket's keys

A reader takes the newest manifest and sees one state whatever is being written. A writer leaves new files beside the old ones
and then adds the next manifest; if another writer was faster, its own is refused and the merge is done again on the new
state. A batch that is repeated after a failure is known by its writer and number and changes nothing.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedloom.functions.storage import names_in, put_new, removed, text_at
from feedloom.operators.merges import upsert

BUCKET = "__bucket"
#: Bits of one bitmap, and how many bits of a filter each key sets.
BITS, MARKS = 32_768, 3


@dataclass
class Manifest:
    number: int = -1
    writes: dict[int, str] = field(default_factory=dict)
    applied: dict[str, int] = field(default_factory=dict)


class KeyedStore:
    """Rows of one schema, each key once. `buckets` is fixed for the life of a store: choose it so that a bucket of rows fits in one task."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, keys: Sequence[str], buckets: int = 64, bitmaps: int = 0):
        self.spark, self.path, self.keys, self.buckets, self.bitmaps = spark, path.rstrip("/"), list(keys), buckets, bitmaps
        self.schema = T.StructType([T.StructField(f.name, f.dataType) for f in schema])

    def manifest(self) -> Manifest:
        names = [n for n in names_in(self.spark, f"{self.path}/manifests") if n.endswith(".json") and not n.startswith(".")]
        if not names:
            return Manifest()
        held = json.loads(text_at(self.spark, f"{self.path}/manifests/{names[-1]}"))
        return Manifest(held["number"], {int(b): w for b, w in held["writes"].items()}, held["applied"])

    def bucket(self) -> Column:
        """The bucket of a row, also where some or all keys are null."""
        return F.pmod(F.xxhash64(*[F.coalesce(F.col(k).cast("string"), F.lit("\0")) for k in self.keys]), F.lit(self.buckets)).cast("int")

    def _rows(self, manifest: Manifest, buckets: Sequence[int] | None = None) -> DataFrame:
        chosen = sorted(manifest.writes if buckets is None else set(buckets) & set(manifest.writes))
        paths = [f"{self.path}/writes/{manifest.writes[b]}/rows/{BUCKET}={b}" for b in chosen]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def read(self) -> DataFrame:
        return self._rows(self.manifest())

    def _touched(self, rows: DataFrame) -> list[int]:
        """The buckets of some rows; never more than the store has."""
        return sorted(r[0] for r in rows.select(self.bucket().alias(BUCKET)).distinct().collect())

    def rows_like(self, keys: DataFrame) -> DataFrame:
        """Stored rows whose key is among some keys; only their buckets are read, and of those only such as a filter doesn't rule out."""
        manifest = self.manifest()
        stored = self._rows(manifest, self._perhaps(manifest, keys))
        wanted = keys.select(*[F.col(k).alias(f"__{k}") for k in self.keys]).distinct()
        return stored.join(wanted, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in self.keys], "left_semi")

    def merge(self, batch: DataFrame, order: Sequence[Column], policy: Mapping[str, str] | None = None, writer: str | None = None, number: int = 0, only_changes: bool = False) -> list[int]:
        """Puts a batch over the stored rows as upsert() does and returns the buckets that were written.

        With `writer`, a batch number that is already in the store is passed over. With only_changes, buckets in which no row
        would differ are left alone.
        """
        while True:
            manifest = self.manifest()
            if writer is not None and manifest.applied.get(writer, -1) >= number:
                return []
            touched = self._touched(batch)
            stored = self._rows(manifest, touched)
            merged = upsert(stored, batch.select(*self.schema.names), self.keys, order, policy)
            if only_changes:
                touched = self._touched(merged.exceptAll(stored))
                merged = merged.where(self.bucket().isin(touched)) if touched else merged.limit(0)
            if touched:
                write = self._write(merged, len(touched))
                manifest.writes |= dict.fromkeys(touched, write)
            if writer is not None:
                manifest.applied[writer] = number
            if not touched and writer is None or self._commit(manifest):
                return touched

    def _write(self, rows: DataFrame, n: int) -> str:
        write = uuid.uuid4().hex
        folder = f"{self.path}/writes/{write}"
        rows.withColumn(BUCKET, self.bucket()).repartition(n, BUCKET).write.partitionBy(BUCKET).parquet(f"{folder}/rows")
        if self.bitmaps:
            kept = self.spark.read.schema(self.schema).parquet(f"{folder}/rows").select(self.bucket().alias(BUCKET), F.explode(self._marks()).alias("mark"))
            bits = kept.groupBy(BUCKET, F.expr(f"mark div {BITS}").alias("bitmap")).agg(F.bitmap_construct_agg(F.col("mark") % BITS).alias("bits"))
            bits.repartition(n, BUCKET).write.partitionBy(BUCKET).parquet(f"{folder}/filter")
        return write

    def _commit(self, manifest: Manifest) -> bool:
        new = {"number": manifest.number + 1, "writes": manifest.writes, "applied": manifest.applied}
        return put_new(self.spark, f"{self.path}/manifests/{new['number']:012}.json", json.dumps(new))

    def _marks(self) -> Column:
        """The bits that a key sets in its bucket's filter."""
        text = [F.coalesce(F.col(k).cast("string"), F.lit("\0")) for k in self.keys]
        return F.array(*[F.pmod(F.xxhash64(F.lit(i), *text), F.lit(BITS * self.bitmaps)) for i in range(MARKS)])

    def _perhaps(self, manifest: Manifest, keys: DataFrame) -> list[int]:
        """Buckets that may hold one of the keys."""
        touched = [b for b in self._touched(keys) if b in manifest.writes]
        if not self.bitmaps or not touched:
            return touched
        paths = [f"{self.path}/writes/{manifest.writes[b]}/filter/{BUCKET}={b}" for b in touched]
        # the folders are read one by one, so that a bucket's older filters aren't; the bucket comes from the file's name
        held = self.spark.read.schema("bitmap bigint, bits binary").parquet(*paths).withColumn(BUCKET, F.regexp_extract(F.input_file_name(), f"{BUCKET}=(\\d+)", 1).cast("int"))
        asked = keys.select(self.bucket().alias(BUCKET), F.struct(*self.keys).alias("key"), F.posexplode(self._marks()).alias("place", "mark")).withColumn("bitmap", F.expr(f"mark div {BITS}"))
        byte = F.conv(F.hex(F.substring("bits", (F.col("mark") % BITS / 8).cast("int") + 1, 1)), 16, 10).cast("int")
        is_set = F.expr(f"mark % {BITS} % 8").cast("int")
        met = asked.join(held, [BUCKET, "bitmap"]).where((byte / F.pow(F.lit(2), is_set)).cast("int") % 2 == 1)
        full = met.groupBy(BUCKET, "key").agg(F.count_distinct("place").alias("n")).where(F.col("n") == MARKS)
        return sorted(r[0] for r in full.select(BUCKET).distinct().collect())

    def vacuum(self) -> list[str]:
        """Deletes the writes that the newest manifest doesn't name; readers of older states and unfinished writers must be gone."""
        unused = sorted(set(names_in(self.spark, f"{self.path}/writes")) - set(self.manifest().writes.values()))
        for write in unused:
            removed(self.spark, f"{self.path}/writes/{write}")
        return unused
