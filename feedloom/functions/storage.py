"""The folder that driver and executors share, and tables written there."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where that is unset, a local session gets a new temporary folder, and a cluster an error: its executors share no local folder."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="feedloom-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/feedloom-{name}-{uuid.uuid4().hex}"


def written_at(df: DataFrame, name: str = "table") -> tuple[DataFrame, str]:
    """The rows of df, written once and read back, and their folder; lineage ends here, and a lost executor costs a read."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def written(df: DataFrame, name: str = "table") -> DataFrame:
    return written_at(df, name)[0]


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a folder that new_path() named, once nothing reads it any more."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def _folder(spark: SparkSession, path: str):
    """(file system, path) of a place that Spark can reach."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def names_in(spark: SparkSession, path: str) -> list[str]:
    """Names of what a folder holds, sorted; none if it isn't there."""
    fs, place = _folder(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(place)) if fs.exists(place) else []


def text_at(spark: SparkSession, path: str) -> str:
    """A small text file."""
    fs, place = _folder(spark, path)
    stream = fs.open(place)
    try:
        return bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def put_new(spark: SparkSession, path: str, text: str) -> bool:
    """Writes a small text file that appears whole or not at all; False, and nothing changed, if the name is taken."""
    fs, place = _folder(spark, path)
    hidden = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(place.getParent(), f".{uuid.uuid4().hex}")
    stream = fs.create(hidden, False)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    # renaming onto a file that is there fails on the shared file systems; the local one would replace it
    if fs.exists(place) or not fs.rename(hidden, place):
        fs.delete(hidden, False)
        return False
    return True
