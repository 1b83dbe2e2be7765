"""Operator 6: WARC archives, written and read back with boundary-chain verification.

Spark's text writer puts the records out, with the blank lines between records as its line separator, and Spark's text reader
takes the archives apart again at the magic, in byte ranges of any size. So a task sees pieces: what stands between two
magics, be they of records or inside a payload. A piece's place follows from the lengths of those before it in its file; each
piece that begins with a header names the place of the record after it. Candidates that follow one another without a gap form
a run, and a run leads to the place that its last record names. From the start of each file pointer jumping over the runs (every
round doubles the length of the jumps) marks what a chain of such successors reaches; magics inside payloads are never
reached, even where they fake a header. A payload cut by them is put together from its pieces, which a second reading
finds by their size and hash, so it needn't be split as the first one was.

Rows whose payload can't be a repeated one are written where they are read: a bitmap of SIEVE bits, whatever the input, tells
most of them. Of the others only narrow rows and one payload for each digest move.

Null payloads are empty; an empty table writes and reads nothing. Of equal payloads of REVISIT_BYTES or more, all rows with the
smallest page_id (also repeated ones) and those without a page_id are responses and the others revisits. Further columns of the
input are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from feedloom.llm.common import new_path, removed, table, written, written_at

MAGIC, CRLF = "WARC/1.0\r\n", "\r\n"
REVISIT_BYTES = 100
#: Most records of an archive.
RECORDS = 50_000
#: Bits of a sieve, half a megabyte.
SIEVE = 1 << 22


def sieve(keys: DataFrame, column: str) -> Column:
    """A condition on rows with the same column: false only where no key equals it. The bits go to every task, and their number is fixed."""
    bit = F.pmod(F.xxhash64(column), F.lit(SIEVE))
    words = keys.select(bit.alias("bit")).groupBy(F.floor(F.col("bit") / 64).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit % 64 AS int))")).alias("bits"))
    every = keys.sparkSession.range(SIEVE // 64).withColumnRenamed("id", "word").join(words, "word", "left")
    one = written(every.agg(F.transform(F.array_sort(F.collect_list(F.struct("word", F.coalesce("bits", F.lit(0).cast("long")).alias("bits")))), lambda x: x["bits"]).alias("words")), "sieve")
    return F.bit_get(F.get(one.scalar(), F.floor(bit / 64).cast("int")), (bit % 64).cast("int")) == 1


def write_archives(pages: DataFrame, path: str, records: int = RECORDS) -> None:
    """One record for each row (page_id, url, html): a response, or a revisit of the first page with the same payload."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.regexp_replace(F.col("url").cast("string"), r"[\r\n]+", " "), F.lit("")).alias("url"),
        payload.alias("payload"), F.sha2(payload, 256).alias("digest"), F.octet_length(payload).alias("bytes"))
    repeated = sieve(rows.where(F.col("bytes") >= REVISIT_BYTES).groupBy("digest").count().where("count > 1"), "digest")
    # always by shuffle: whether the payloads could be sent to all tasks depends on the input
    of_digest, own = written_at(rows.where(repeated).groupBy("digest").agg(F.min("page_id").alias("first"), F.first("payload").alias("payload")), "payloads")
    narrow = rows.where(repeated).select("page_id", "url", "digest", "bytes")
    again = narrow.join(of_digest.hint("merge"), "digest").withColumn("revisit", F.coalesce((F.col("bytes") >= REVISIT_BYTES) & (F.col("page_id") != F.col("first")), F.lit(False)))
    marked = rows.where(~repeated).withColumns({"first": F.lit(None).cast("long"), "revisit": F.lit(False)}).unionByName(again)

    def line(name: str, value: Column | str) -> Column:
        return F.concat(F.lit(f"{name}: "), value if isinstance(value, Column) else F.lit(value), F.lit(CRLF))

    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(">"))
    head = [
        F.lit(MAGIC), line("WARC-Type", F.when(F.col("revisit"), "revisit").otherwise("response")), line("WARC-Record-ID", urn("page_id")), line("WARC-Target-URI", F.col("url")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))), line("X-Payload-Bytes", F.col("bytes").cast("string")),
        F.when(F.col("revisit"), F.concat(line("WARC-Refers-To", urn("first")), line("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))).otherwise(""),
        line("Content-Type", "text/html; charset=utf-8"), line("Content-Length", F.when(F.col("revisit"), "0").otherwise(F.col("bytes").cast("string"))), F.lit(CRLF),
    ]
    record = F.concat(*head, F.when(F.col("revisit"), "").otherwise(F.col("payload")))
    marked.select(record.alias("value")).write.option("lineSep", CRLF * 2).option("maxRecordsPerFile", records).text(path)
    removed(pages.sparkSession, own)


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, seq, value, size, hash): what stands between magics; seq ascends within a block of the file."""
    return spark.read.option("lineSep", MAGIC).text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("seq"), "value",
        F.octet_length("value").alias("size"), F.xxhash64("value").alias("hash"))


def _header(name: str) -> Column:
    found = F.regexp_extract("head", rf"(?im)^{name}:[ \t]*(.*?)[ \t]*$", 1)
    return F.when(found != "", found)


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """A row for each piece, without its text: its place, its run, and if it begins with a header the place of the record after it.

    Files are told apart by the hash of their path.
    """
    split = F.instr("value", CRLF * 2)
    cut = _pieces(spark, path).select(
        "file", "block", "seq", "size", "hash", F.when(split > 0, F.left("value", split + 1)).alias("head"), F.substring(F.col("value"), split + 4, F.length("value")).alias("rest"))
    parsed = cut.select(
        "file", F.xxhash64("file").alias("f"), "block", "seq", "size", "hash", F.octet_length("head").cast("long").alias("head_bytes"), _header("Content-Length").try_cast("bigint").alias("length"),
        _header("WARC-Type").alias("record_type"), _header("WARC-Record-ID").alias("record_id"), _header("WARC-Target-URI").alias("url"), _header("WARC-Refers-To").alias("refers"),
        F.regexp_replace(_header("WARC-Payload-Digest"), "^sha256:", "").alias("digest"), _header("X-Payload-Bytes").try_cast("bigint").alias("payload_bytes"), F.octet_length("rest").alias("rest_bytes"),
        F.sha2(F.left("rest", F.length("rest") - 4), 256).alias("own_digest"))
    order = Window.partitionBy("f").orderBy("block", "seq")
    before = F.coalesce(F.sum(F.col("size") + len(MAGIC)).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = parsed.withColumn("at", before - len(MAGIC)).withColumn("next", F.when(F.col("length") >= 0, F.col("at") + len(MAGIC) + F.col("head_bytes") + 2 + F.col("length") + 4))
    breaks = F.coalesce((F.lag("next").over(order) != F.col("at")) | F.lag("next").over(order).isNull(), F.lit(True))
    return placed.withColumn("breaks", breaks.cast("long")).withColumn("run", F.sum("breaks").over(order)).where("at >= 0").drop("block", "seq", "breaks")


def reachable(found: DataFrame) -> DataFrame:
    """(f, run, entry) of the runs that the chain of successors reaches from the start of their file, and where it enters them; by pointer jumping."""
    spark = found.sparkSession
    tails = found.where("next IS NOT NULL").groupBy("f", "run").agg(F.min("at").alias("at"), F.max("next").alias("next"))
    enters = found.where("next IS NOT NULL").select("f", F.col("at").alias("next"), F.col("run").alias("to"))
    jumps, folder = written_at(tails.join(enters, ["f", "next"], "left").select("f", "run", "to", F.col("next").alias("entry"), (F.col("at") == 0).alias("reached")), "jumps")
    first = jumps.select("f", F.col("to").alias("run"), "entry", F.col("run").alias("source"))
    most = jumps.groupBy("f").count().agg(F.max("count")).first()[0] or 1
    now, own = jumps.select("f", "run", "to", "reached"), None
    for _ in range(math.ceil(math.log2(most)) + 1 if most > 1 else 0):
        targets = now.where("reached AND to IS NOT NULL").select("f", F.col("to").alias("run"), F.lit(True).alias("hit")).distinct()
        after = now.select("f", F.col("run").alias("to"), F.col("to").alias("far"))
        last = own
        now, own = written_at(
            now.join(targets, ["f", "run"], "left").join(after, ["f", "to"], "left").select("f", "run", F.col("far").alias("to"), (F.col("reached") | F.coalesce("hit", F.lit(False))).alias("reached")), "jumps")
        if last:
            removed(spark, last)
    reached = now.where("reached").select("f", "run")
    # a chain enters a run once: from the reached run that leads to it, or at the start of the file
    entered = first.join(reached.withColumnRenamed("run", "source"), ["f", "source"]).where("run IS NOT NULL").select("f", "run", "entry")
    out = written(jumps.where("reached").select("f", "run", F.lit(0).cast("long").alias("entry")).unionByName(entered), "reached")
    for x in filter(None, (folder, own)):
        removed(spark, x)
    return out


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """A row for each record: file, at (its offset), page_id, url, record_type, refers_to, payload_bytes, payload_digest, intact.

    For responses bytes and digest are those of the payload as read, and intact tells whether the header agrees; revisits have
    their header's.
    """
    found = written(candidates(spark, path), "candidates")
    kept = found.join(reachable(found), ["f", "run"], "left").withColumn("reached", F.coalesce((F.col("at") >= F.col("entry")) & F.col("next").isNotNull(), F.lit(False)))
    whole = F.col("rest_bytes") == F.col("length") + 4
    page = lambda c: F.regexp_extract(c, r"(-?\d+)>$", 1).try_cast("bigint")
    # payloads with magics inside: their pieces come together again, record by record
    owner = F.last(F.when(F.col("reached"), F.struct(F.col("at").alias("record"), whole.alias("whole"))), ignorenulls=True).over(Window.partitionBy("f").orderBy("at"))
    parts = written(kept.select("f", "at", "size", "hash", owner.alias("o")).where("NOT o.whole").select("f", "o.record", F.col("at").alias("place"), "size", "hash"), "parts")
    texts = _pieces(spark, path).where(sieve(parts, "hash")).join(parts.select("size", "hash").distinct(), ["size", "hash"], "left_semi").groupBy("size", "hash").agg(F.first("value").alias("value"))
    joined = parts.join(texts, ["size", "hash"]).groupBy("f", "record").agg(F.array_sort(F.collect_list(F.struct("place", "value"))).alias("p")).select(
        "f", F.col("record").alias("at"), F.array_join(F.transform("p", lambda x: x["value"]), MAGIC).alias("value"))
    body = F.substring(F.col("value"), F.instr("value", CRLF * 2) + 4, F.length("value"))
    mended = joined.select("f", "at", F.left(body, F.length(body) - 4).alias("body")).select("f", "at", F.octet_length("body").cast("long").alias("read_bytes"), F.sha2("body", 256).alias("read_digest"))
    records = kept.where("reached")
    again = records.where(~whole).join(mended, ["f", "at"], "left")
    revisit = F.col("record_type") == "revisit"
    return records.where(whole).withColumns({"read_bytes": F.col("length"), "read_digest": F.col("own_digest")}).unionByName(again).select(
        "file", "at", page(F.col("record_id")).alias("page_id"), "url", "record_type", page(F.col("refers")).alias("refers_to"),
        F.when(revisit, F.col("payload_bytes")).otherwise(F.col("read_bytes")).cast("long").alias("payload_bytes"),
        F.when(revisit, F.col("digest")).otherwise(F.col("read_digest")).alias("payload_digest"), (revisit | (F.col("digest") == F.col("read_digest"))).alias("intact"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    write_archives(table(spark, sf_dir, "pages"), path)
    return read_archives(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha256(html) AS payload_digest FROM p),
f AS (SELECT *, CASE WHEN payload_bytes >= {REVISIT_BYTES} THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to FROM f"""
