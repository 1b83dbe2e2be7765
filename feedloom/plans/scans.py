"""Landing files written from the tables, read by the scans; streams over them."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedloom.functions.storage import new_path
from feedloom.operators.merges import changes_only
from feedloom.operators.store import KeyedStore
from feedloom.plans.base import query
from feedloom.sources import landing as L
from feedloom.streaming import changes as ST
from feedloom.streaming import stored as STORED


@query("src1_csv", "SELECT p_partkey::VARCHAR AS id, p_name AS name, p_retailprice AS goal, p_size * 1000.0::DOUBLE AS pledged, p_size::DOUBLE AS backers FROM part")
def src1(t, spark):
    path = new_path(spark, "csv")
    rows = t("part").select(
        F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("name"), F.concat(F.lit('say "'), "p_type", F.lit('", then')).alias("blurb"), F.lit("https://c.example/").alias("project_url"), F.col("p_retailprice").cast("string").alias("goal"),
        F.concat(F.col("p_size").cast("string"), F.lit(",000")).alias("pledged"), F.concat(F.col("p_size").cast("string"), F.lit("%")).alias("backers"))
    rows.unionByName(rows.limit(0)).write.csv(path, header=True, quote='"', escape='"')
    return L.campaigns_csv(spark, path).select("id", "name", "goal", "pledged", "backers")


@query("src2_json_wrapper", "SELECT o_orderkey AS id, CASE WHEN o_custkey % 10 > 0 THEN round(o_totalprice / ((o_custkey % 10) * 1000.0::DOUBLE) * 100, 6) END AS funded FROM orders")
def src2(t, spark):
    path = new_path(spark, "json")
    p = F.struct(F.col("o_orderkey").alias("projectId"), F.col("o_orderpriority").alias("projectName"), ((F.col("o_custkey") % 10) * 1000.0).alias("campaignGoal"), F.col("o_totalprice").alias("fundsGathered"))
    t("orders").groupBy("o_custkey").agg(F.collect_list(p).alias("projects")).select("projects").write.json(path)
    return L.campaigns_json(spark, path).select(F.col("projectId").alias("id"), "funded")


@query("src3_posts", "SELECT conv_id || '-' || turn AS id, CASE WHEN turn % 2 = 0 THEN 'https://forum.example/r/' || conv_id ELSE 'https://else.example/' || turn END AS link FROM conversations")
def src3(t, spark):
    path = new_path(spark, "posts")
    p = F.struct(
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"), F.col("role").alias("title"), F.col("text").alias("selftext"),
        F.when(F.col("turn") % 2 == 0, F.concat(F.lit("/r/"), F.col("conv_id").cast("string"))).alias("permalink"), F.concat(F.lit("https://else.example/"), F.col("turn").cast("string")).alias("url"))
    t("conversations").groupBy("conv_id").agg(F.collect_list(p).alias("data")).select("data").write.json(path)
    return L.posts_json(spark, path).select("id", "link")


@query("src6_feed_xml", "SELECT doc_id::VARCHAR AS title, 'https://f.example/' || doc_id AS link, 'https://i.example/' || doc_id || '.png' AS image, lang || ',' || source AS categories FROM documents")
def src6(t, spark):
    path = new_path(spark, "xml")
    body = F.concat(F.lit('<p>hello <b>there</b></p><img src="https://i.example/'), F.col("doc_id").cast("string"), F.lit('.png">'))
    rows = t("documents").select(
        F.col("doc_id").cast("string").alias("title"), F.concat(F.lit("https://f.example/"), F.col("doc_id").cast("string")).alias("link"), body.alias("description"), F.lit(None).cast("string").alias("encoded"), F.array("lang", "source").alias("category"))
    rows.write.format("xml").option("rowTag", "item").option("rootTag", "channel").save(path)
    return L.feed_xml(spark, path).select("title", "link", "image", "categories")


@query("src7_cards", "SELECT page_id, count(*) AS cards FROM (SELECT page_id, unnest(string_split(html, '<li>')[2:]) AS c FROM pages) GROUP BY 1")
def src7(t, spark):
    return L.list_cards(t("pages"), "<li>").groupBy("page_id").agg(F.count(F.lit(1)).alias("cards"))


@query("src8_metadata", "SELECT page_id, nullif(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '') AS title, nullif(regexp_extract(html, '(?i)<meta[^>]+charset=[\"'']?([^\"''>\\s]+)', 1), '') AS charset, nullif(regexp_extract(html, '(?i)<html[^>]+lang=[\"'']([^\"'']+)', 1), '') AS page_lang FROM pages")
def src8(t, spark):
    return L.page_metadata(t("pages"))


@query("src9_json_keys", "SELECT event_id, props->>'$.k' AS v FROM events")
def src9(t, spark):
    each = t("events").select("event_id", F.explode(F.from_json("props", "map<string,string>")).alias("k", "v"))
    return each.where("k = 'k'").select("event_id", "v")


@query("src10_newest_partition", "SELECT event_id FROM events WHERE ts::DATE = (SELECT max(ts::DATE) FROM events)")
def src10(t, spark):
    path = new_path(spark, "days")
    t("events").withColumn("day", F.date_format("ts", "yyyy-MM-dd")).repartition("day").write.partitionBy("day").parquet(path)
    landed = spark.read.parquet(path)
    newest = landed.agg(F.max("day")).first()[0]
    return landed.where(F.col("day") == newest).select("event_id")


@query("src11_first_seen", "SELECT doc_id, feed FROM (SELECT doc_id, feed, row_number() OVER (PARTITION BY text ORDER BY feed, doc_id) AS n FROM (SELECT doc_id, text, CASE WHEN source < 'src5' THEN 0 ELSE 1 END AS feed FROM documents)) WHERE n = 1")
def src11(t, spark):
    rows = t("documents").select("doc_id", "source", F.md5("text").alias("key"), F.col("doc_id").alias("place"))
    return L.first_seen([rows.where("source < 'src5'"), rows.where("source >= 'src5'")], "key").select("doc_id", "feed")


@query("src12_quarantine", "SELECT count(*) FILTER (event_id % 7 > 0) AS good, count(*) FILTER (event_id % 7 = 0) AS bad FROM events")
def src12(t, spark):
    path = new_path(spark, "lines")
    line = F.when(F.col("event_id") % 7 == 0, F.lit("{broken")).otherwise(F.to_json(F.struct("event_id", "value")))
    t("events").select(line.alias("value")).write.text(path)
    good, bad = L.good_and_bad(spark, path, "event_id bigint, value double")
    n = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    return n(good, "good").join(F.broadcast(n(bad, "bad")))


@query("src13_overlay", "SELECT d.doc_id, CASE WHEN p.page_id IS NOT NULL AND length(html) > length(text) THEN 'page' ELSE 'feed' END AS kept FROM documents d LEFT JOIN pages p ON p.page_id = d.doc_id")
def src13(t, spark):
    both = t("documents").join(t("pages").select(F.col("page_id").alias("doc_id"), "html"), "doc_id", "left")
    return both.select("doc_id", F.when(F.length("html") > F.length("text"), "page").otherwise("feed").alias("kept"))


@query("src14_caps", "SELECT doc_id FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents) WHERE n <= CASE source WHEN 'src0' THEN 3 WHEN 'src1' THEN 5 ELSE 4 END")
def src14(t, spark):
    return L.capped(t("documents"), "source", "doc_id", {"src0": 3, "src1": 5}, 4).select("doc_id")


@query("src16_lookup", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = 17")
def src16(t, spark):
    return t("orders").where("o_custkey = 17").select("o_orderkey", "o_totalprice")


@query("src17_filtered_copy", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def src17(t, spark):
    path = new_path(spark, "copy")
    kept = t("lineitem").join(t("orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey", "left_semi")
    kept.write.parquet(path)
    return spark.read.parquet(path).select("l_orderkey", "l_linenumber")


@query("src18_snapshot", "WITH h AS (SELECT o_custkey, max(o_orderdate) AS d FROM orders GROUP BY 1) SELECT o_orderkey, row_number() OVER (PARTITION BY orders.o_custkey ORDER BY o_orderkey) AS position FROM orders JOIN h ON h.o_custkey = orders.o_custkey AND o_orderdate = d")
def src18(t, spark):
    from feedloom.operators.merges import best_per_key
    from feedloom.operators.selection import numbered

    return numbered(best_per_key(t("orders"), ["o_custkey"], [F.desc("o_orderdate")], rank="rank"), "position", [F.col("o_orderkey")], ["o_custkey"]).select("o_orderkey", "position")


@query("src19_known_keys", "SELECT doc_id, doc_id IN (SELECT page_id FROM pages) AS is_known FROM documents")
def src19(t, spark):
    known = t("pages").select(F.col("page_id").alias("doc_id")).distinct().withColumn("k", F.lit(True))
    return t("documents").join(known, "doc_id", "left").select("doc_id", F.coalesce("k", F.lit(False)).alias("is_known"))


def _landed(t, spark, files: int = 1000):
    """The events as one landing folder, in order of time, and a stream over it of so many files a batch."""
    path = new_path(spark, "landing")
    rows = t("events").withColumn("at", F.col("ts").cast("timestamp"))
    rows.repartitionByRange("at").sortWithinPartitions("at").write.parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(path)


@query("str2_noon_stream", "WITH d AS (SELECT time_bucket(INTERVAL 1 DAY, ts, TIMESTAMP '2000-01-01 04:00:00') AS day, count(*) AS n FROM events GROUP BY 1) SELECT day, n FROM d WHERE day + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 DAY")
def str2(t, spark):
    """Days whose window the watermark closed: those that ended a day or more before the newest event."""
    return ST.finished(ST.noon_counts(_landed(t, spark), "at")).select(F.col("day").cast("timestamp_ntz").alias("day"), "n")


_side_day = "time_bucket(INTERVAL 1 DAY, coalesce(published, ts), TIMESTAMP '2000-01-01 04:00:00')"


@query("str2_side_counts", f"""WITH e AS (SELECT ts, CASE event_id % 4 WHEN 0 THEN ts - INTERVAL 10 DAY WHEN 2 THEN ts WHEN 3 THEN ts + INTERVAL 1 HOUR END AS published FROM events)
SELECT {_side_day} AS day, CASE WHEN published IS NULL THEN 'observation' WHEN published > ts THEN 'early' WHEN ts >= {_side_day} + INTERVAL 2 DAY THEN 'late' ELSE 'on_time' END AS side, count(*) AS n FROM e GROUP BY ALL""")
def str2_sides(t, spark):
    """Observations in no order, of which parts were published ten days before, at no known time, and after they were observed; in several batches."""
    path, k = new_path(spark, "landing"), F.col("event_id") % 4
    published = F.when(k == 0, F.col("ts") - F.expr("INTERVAL 10 DAYS")).when(k == 2, F.col("ts")).when(k == 3, F.col("ts") + F.expr("INTERVAL 1 HOUR"))
    rows = t("events").select("ts", published.alias("published"))
    rows.repartition(4, F.xxhash64("ts")).write.parquet(path)
    store = KeyedStore(spark, new_path(spark, "sides"), T.StructType.fromDDL("day timestamp_ntz, side string, n bigint"), ["day", "side"], 4)
    STORED.noon_sides(spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(path), "published", "ts", store, "sides")
    return store.read()


@query("str4_change_stream", "SELECT user_id, event_id, event_type FROM (SELECT user_id, event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM events) WHERE b IS NULL OR b <> event_type")
def str4(t, spark):
    return ST.finished(ST.emit_changes(_landed(t, spark), "user_id", "event_id", "event_type"))


@query("str4_change_batch", "SELECT user_id, event_id, event_type FROM (SELECT user_id, event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM events) WHERE b IS NULL OR b <> event_type")
def str4_batch(t, spark):
    return changes_only(t("events"), ["user_id"], [F.col("event_id")], F.col("event_type")).select("user_id", "event_id", "event_type")


@query("str5_once_per_key", "SELECT DISTINCT user_id FROM events")
def str5(t, spark):
    return ST.finished(ST.once_per_key(_landed(t, spark), "user_id", "at").select("user_id"))


@query("str5_once_ever", "SELECT user_id, event_id, CASE WHEN user_id % 2 = 0 THEN 'early' ELSE 'all' END AS run FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events) WHERE n = 1")
def str5_ever(t, spark):
    """Two runs, the first over the even users only; a stored ledger keeps the second from handing anything out again."""
    ledger = KeyedStore(spark, new_path(spark, "seen"), T.StructType.fromDDL("key bigint, run string, batch bigint"), ["key"], 16, bitmaps=1)
    out = new_path(spark, "handed")
    for run, rows in (("early", t("events").where("user_id % 2 = 0")), ("all", t("events"))):
        path = new_path(spark, "landing")
        rows.select("user_id", "event_id").write.parquet(path)
        stream = spark.readStream.schema("user_id bigint, event_id bigint").parquet(path)
        STORED.once_ever(stream, "user_id", [F.col("event_id")], ledger, lambda found, n, run=run: found.write.mode("overwrite").parquet(f"{out}/run={run}/batch={n}"), run)
    return spark.read.schema("user_id bigint, event_id bigint, run string, batch bigint").parquet(out).select("user_id", "event_id", "run")


@query("str7_session_stream", """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w >= INTERVAL 6 HOUR THEN 1 ELSE 0 END AS gap FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT user_id, ts, sum(gap) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM g),
x AS (SELECT user_id, min(ts) AS started, max(ts) + INTERVAL 6 HOUR AS timed_out, count(*) AS events FROM s GROUP BY user_id, n) SELECT * FROM x WHERE timed_out <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR""")
def str7_stream(t, spark):
    """Sessions that timed out, by a stream over the landed events."""
    made = ST.finished(ST.idle_sessions(_landed(t, spark), "user_id", "at", "6 hours"))
    return made.select("user_id", *[F.col(c).cast("timestamp_ntz").alias(c) for c in ("started", "timed_out")], "events")
