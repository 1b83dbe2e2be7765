"""Composite jobs over the tables, streams that take up where they stopped, and the library's extension points."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedloom.functions import aggregates as AG
from feedloom.functions.sql import register
from feedloom.functions.storage import new_path, written
from feedloom.functions.text import key_of
from feedloom.operators import evidence as E
from feedloom.operators import external as EX
from feedloom.operators import identity as I
from feedloom.operators import jobs as J
from feedloom.operators import ladders as L
from feedloom.operators import merges as M
from feedloom.operators import selection as SEL
from feedloom.operators.packs import RulePack
from feedloom.operators.store import KeyedStore
from feedloom.plans import ladders as PL
from feedloom.plans import rules  # noqa: F401
from feedloom.plans import scans
from feedloom.plans.base import DOC_SQL, ORACLE, doc_records, query
from feedloom.sources import registry
from feedloom.streaming import changes as ST
from feedloom.streaming import delivery as DL

_o = f"o AS ({ORACLE['rul2_opportunity_documents']})"


@query("job1_ingest", f"""WITH {_o}, d AS (SELECT doc_id, source, doc_id IN (SELECT doc_id FROM labels) AS old FROM documents) SELECT source, count(*) AS fetched, count(*) FILTER (NOT old) AS new_count, count(*) FILTER (old) AS updated_count,
count(*) FILTER (filter_status = 'rejected') AS rejected, count(*) FILTER (filter_status = 'uncertain') AS uncertain FROM d JOIN o USING (doc_id) GROUP BY source""")
def job1(t, spark):
    """All documents as a batch against the labelled ones as stored: classified, stored with their candidates, the ledger by source."""
    return _ingested(t, spark)[2]


def _ingested(t, spark):
    """(store of records, pool of candidates, ledger) after the batch."""
    records = doc_records(t)
    schema = T.StructType.fromDDL("url string, doc_id bigint, title string, source string, opportunity_type string, filter_status string, filter_score int")
    held = KeyedStore(spark, new_path(spark, "records"), schema, ["url"], 16, bitmaps=1)
    pool = KeyedStore(spark, new_path(spark, "pool"), T.StructType.fromDDL("source_url string, candidate_type string, candidate_score int"), ["source_url"], 16)
    seen = records.join(t("labels").select("doc_id").distinct(), "doc_id", "left_semi")
    held.merge(seen.select("url", "doc_id", "title", "source", *[F.lit(None).cast(d).alias(n) for n, d in (("opportunity_type", "string"), ("filter_status", "string"), ("filter_score", "int"))]), [F.col("doc_id")])
    return held, pool, J.ingest_into(records, held, pool)


@query("job1_stored_records", f"WITH {_o} SELECT doc_id, opportunity_type, filter_status, filter_score FROM o")
def job1_records(t, spark):
    """What the store of records holds after the batch."""
    return _ingested(t, spark)[0].read().select("doc_id", "opportunity_type", "filter_status", "filter_score")


_co = f"co AS ({ORACLE['rul8_commodity']})"


def _job3_sql() -> str:
    from feedloom.plans import more  # noqa: F401

    return f"""WITH tr AS ({ORACLE['rul10_trend_items']}), {_co}, s AS (SELECT doc_id, 'https://news.example/' || doc_id AS url, CASE WHEN doc_id % 3 = 0 THEN 'consumer_trend' ELSE 'other' END AS candidate_type, (doc_id % 100)::INT AS score FROM documents)
SELECT url, candidate_type, score FROM s WHERE candidate_type <> 'consumer_trend' UNION ALL SELECT 'https://news.example/' || doc_id, 'consumer_trend', round_even((trend_score + commodity_score) / 2.0, 0)::INT FROM documents JOIN tr USING (doc_id) JOIN co USING (doc_id)
WHERE source = 'src3' AND trend_status = 'candidate' AND commodity_status <> 'COMMODITY'"""


@query("job3_rescored_slice", _job3_sql())
def job3(t, spark):
    stored = t("documents").select(F.concat(F.lit("https://news.example/"), F.col("doc_id").cast("string")).alias("url"), F.when(F.col("doc_id") % 3 == 0, "consumer_trend").otherwise("other").alias("candidate_type"), (F.col("doc_id") % 100).cast("int").alias("score"))
    return J.rescored_slice(doc_records(t), stored, "src3").select("url", "candidate_type", "score")


def _discovery_sql(where: str) -> str:
    return f"""WITH g AS (SELECT user_id, count(DISTINCT event_type) AS sources, max(ts) AS last_seen, round(sum(value), 2) AS points FROM events WHERE {where} GROUP BY 1), r AS (SELECT *, (CASE WHEN points >= 80 THEN 2 WHEN points >= 40 THEN 1 ELSE 0 END) + (sources >= 2)::INT AS k FROM g),
s AS (SELECT *, CASE WHEN k >= 2 THEN 'STRONG' WHEN k = 1 THEN 'MODERATE' ELSE 'WEAK' END AS strength FROM r) SELECT user_id, sources, last_seen, points, strength, CASE strength WHEN 'STRONG' THEN 0 WHEN 'MODERATE' THEN 1 ELSE 2 END AS strength_rank, row_number() OVER (PARTITION BY strength ORDER BY last_seen DESC, user_id) AS place FROM s"""


@query("job4_rolling", _discovery_sql("ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY"))
def job4_rolling(t, spark):
    newest = t("events").agg(F.max("ts")).first()[0]
    return J.discovery(t("events"), "user_id", "ts", "event_type", "value", F.lit(newest) - F.expr("INTERVAL 7 DAYS"))


@query("job4_strict_window", _discovery_sql("ts >= TIMESTAMP '2024-01-09 04:00:00' AND ts < TIMESTAMP '2024-01-10 04:00:00'"))
def job4_strict(t, spark):
    """The day from noon to noon, business time, that ends on 10 January."""
    at = lambda x: F.lit(x).cast("timestamp_ntz")
    return J.discovery(t("events"), "user_id", "ts", "event_type", "value", at("2024-01-09 04:00:00"), at("2024-01-10 04:00:00"))


#: What the baskets of a run are filled with, in their order, and how many picks a source may have.
QUOTAS = {E.BASKETS[b]: n for b, n in (("proven", 5), ("other", 4), ("needs", 4), ("software", 4), ("design", 3))}
CAPS = {"reddit": 4, "amazon": 4}


def pick_items(t):
    """Named records that can be picked, with their family; a run is the records of one language."""
    name = F.col("normalized_name")
    pick = F.when(name.isNotNull(), E.is_pick(name, F.col("description"), F.col("source"), F.col("content_type"), F.lit(True)))
    # written before the filter: pushed below the ladders, it would compute them all over again for itself
    good = written(PL.named(t).select("doc_id", "category", "source", "content_type", name, pick.alias("pick")), "named").where("pick")
    strength = F.when(F.col("doc_id") % 3 == 0, "STRONG").otherwise("WEAK")
    return I.family(good, "normalized_name", "content_type").select(
        F.col("category").alias("run"), F.col("doc_id").alias("id"), SEL.ranked(strength, J.STRENGTHS).alias("rank"), F.col("normalized_name").alias("name"), "family_key",
        E.basket(F.col("source"), F.col("content_type"), strength).alias("basket"), "source", F.coalesce(E.near_key(F.col("normalized_name")), F.col("normalized_name")).alias("dup"))


def voice_counts(t):
    return t("conversations").groupBy(F.col("conv_id").alias("id")).agg(F.count(F.lit(1)).alias("voices"))


@query("job5_compose")
def job5(t, spark):
    """Discovery to picks: families of named records, the name each agrees on, baskets within the sources' caps, how many voices each pick has, published by run."""
    return J.compose(written(pick_items(t), "items"), "run", "family_key", voice_counts(t), QUOTAS, CAPS, 3, 20, new_path(spark, "picks"))


@query("job6_daily_run", f"""WITH {_o}, d AS (SELECT doc_id, source, doc_id IN (SELECT doc_id FROM labels) AS old FROM documents), s AS (SELECT count(*) AS fetched, count(*) FILTER (NOT old) AS new_products, count(*) FILTER (filter_status = 'rejected') AS rejected FROM d JOIN o USING (doc_id)),
r AS (SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY filter_score DESC, doc_id) AS n FROM d JOIN o USING (doc_id) WHERE filter_status = 'candidate') SELECT fetched, new_products, rejected, (SELECT count(*) FROM r WHERE n <= 10) AS ranked, (SELECT count(*) FROM r) AS qualified FROM s""")
def job6(t, spark):
    """Ingest, rank, and the run's statistics as one document."""
    records = doc_records(t)
    rows, _, ledger = J.ingest(records, records.join(t("labels").select("doc_id").distinct(), "doc_id", "left_semi"))
    ready = rows.where("filter_status = 'candidate'").select("doc_id", "source", "filter_score")
    top = M.best_per_key(ready, ["source"], [F.desc("filter_score"), F.col("doc_id")], n=10)
    one = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    sums = ledger.agg(F.sum("fetched").alias("fetched"), F.sum("new_count").alias("new_products"), F.sum("rejected").alias("rejected"))
    return sums.join(F.broadcast(one(top, "ranked"))).join(F.broadcast(one(ready, "qualified")))


BUDGET = 60


@query("job6_daily_choice", f"""WITH {_o}, c AS (SELECT doc_id, source AS theme, (opportunity_type = 'software')::INT AS kind, filter_score AS score, doc_id IN (SELECT doc_id FROM labels) AS old FROM documents JOIN o USING (doc_id) WHERE filter_status = 'candidate' ORDER BY old, score DESC, doc_id LIMIT {BUDGET}),
w AS (SELECT *, score >= 55 AS ok FROM c), x AS (SELECT *, ok AND row_number() OVER (PARTITION BY ok, theme ORDER BY kind, score DESC, doc_id) <= 3 AS a FROM w), y AS (SELECT *, a AND (kind = 0 OR row_number() OVER (PARTITION BY a, kind ORDER BY score DESC, doc_id) <= 2) AS b FROM x),
z AS (SELECT *, row_number() OVER (PARTITION BY b ORDER BY kind, score DESC, doc_id) AS n FROM y), q AS (SELECT *, b AND n <= 10 AS c FROM z), p AS (SELECT *, coalesce(sum(c::INT) OVER (ORDER BY kind, score DESC, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM q)
SELECT doc_id, CASE WHEN c THEN n END AS chosen_rank, CASE WHEN c THEN NULL WHEN NOT ok THEN 'quality_score' WHEN before >= 10 THEN CASE WHEN kind = 1 THEN 'software_quota' ELSE 'lower_final_score' END WHEN NOT a THEN 'theme_quota' ELSE 'software_quota' END AS exclusion FROM p""")
def job6_choice(t, spark):
    """New documents before labelled ones within the budget, then themes and software within their quotas."""
    rows = J.classified(doc_records(t))
    return J.daily_choice(rows, t("labels"), "doc_id", BUDGET).select("doc_id", "chosen_rank", "exclusion")


def _collection_sql() -> str:
    from feedloom.plans import depth  # noqa: F401

    return f"""WITH v AS ({ORACLE['fn22_source_voices']}), b AS (SELECT CASE WHEN conv_id % 3 = 0 THEN 'reddit' ELSE 'shop' END || chr(124) || url || chr(124) || text AS k, conv_id FROM v), o AS (SELECT DISTINCT k FROM b WHERE conv_id % 2 = 0),
s AS (SELECT count(DISTINCT k) FILTER (k NOT IN (SELECT k FROM o)) AS saved, count(*) AS n FROM b) SELECT (SELECT count(*) FROM documents) AS fetched, saved, n - saved AS existing FROM s"""


@query("job7_collection", _collection_sql())
def job7(t, spark):
    """Records are classified and written, the texts that users wrote in them extracted and stored by their identity; nothing is composed."""
    from feedloom.plans.depth import voice_rows

    rows = J.classified(doc_records(t))
    voice = written(voice_rows(t).select("identity", "conv_id"), "voices")
    counts = J.collected_voice(voice, voice.where("conv_id % 2 = 0"), "identity")
    return rows.agg(F.count(F.lit(1)).alias("fetched")).join(F.broadcast(counts)).select("fetched", "saved", "existing")


_pub = "CASE event_id % 4 WHEN 0 THEN ts - INTERVAL 10 DAY WHEN 1 THEN NULL ELSE ts END"


@query("str1_event_or_observation", f"SELECT event_id, CASE WHEN event_id % 4 = 1 THEN 'observation' ELSE 'source' END AS method FROM events WHERE coalesce({_pub}, ts) >= TIMESTAMP '2024-01-09 04:00:00' AND coalesce({_pub}, ts) < TIMESTAMP '2024-01-10 04:00:00'")
def str1(t, spark):
    """A stream of observations of which a part was published ten days before, in the business day that ends on 10 January."""
    stream = scans._landed(t, spark)
    k = F.col("event_id") % 4
    published = F.when(k == 0, F.col("at") - F.expr("INTERVAL 10 DAYS")).when(k > 1, F.col("at"))
    rows = stream.withColumn("published", published).withColumnRenamed("at", "observed")
    return ST.finished(ST.within(rows, "published", "observed", "2024-01-09 04:00:00", "2024-01-10 04:00:00").select("event_id", "method"))


@query("str8_resumed_delivery", "SELECT user_id::VARCHAR AS key, count(*) AS chunks, 1::BIGINT AS times FROM events GROUP BY 1")
def str8(t, spark):
    """The same events are delivered by two runs; the second finds everything in the ledger."""
    ledger, out = new_path(spark, "ledger"), new_path(spark, "delivered")
    for run in ("first", "second"):
        DL.resumed(scans._landed(t, spark), "user_id", ledger, lambda rows, n, run=run: rows.select("user_id", "event_id").write.mode("overwrite").parquet(f"{out}/run={run}/batch={n}"), run)
    sent = spark.read.schema("user_id bigint, event_id bigint, run string, batch bigint").parquet(out)
    times = sent.groupBy(F.col("user_id").cast("string").alias("key")).agg(F.count_distinct("run").alias("times"))
    return DL.entries(spark, ledger).groupBy("key").agg(F.sum("chunks").alias("chunks")).join(times, "key")


@query("udx1_rule_pack", f"""WITH {DOC_SQL}, f AS (SELECT doc_id, regexp_matches(description, '(?i)(^|[^\\p{{L}}\\p{{N}}_])(the|of)s?($|[^\\p{{L}}\\p{{N}}_])') AS a, regexp_matches(description, '(?i)(^|[^\\p{{L}}\\p{{N}}_])(und|der)s?($|[^\\p{{L}}\\p{{N}}_])') AS b FROM rec)
SELECT doc_id, concat_ws(',', CASE WHEN a THEN 'english' END, CASE WHEN b THEN 'german' END) AS flags, (10 + CASE WHEN a THEN 50 ELSE 0 END + CASE WHEN b THEN 30 ELSE 0 END)::INT AS score, CASE WHEN b THEN 'HELD' WHEN a THEN 'PASS' ELSE 'NONE' END AS status FROM f""")
def udx1(t, spark):
    """A pack given as rows of a rule table."""
    pack = RulePack.of_rows([("english", "the", 50), ("english", "of", 50), ("german", "und", 30), ("german", "der", 30)], [(60, "PASS"), (40, "REVIEW")], "NONE", base=10, forced={"german": "HELD"})
    return pack.applied(doc_records(t), F.col("description"), "r").select("doc_id", F.array_join("r_flags", ",").alias("flags"), F.col("r_score").alias("score"), F.col("r_status").alias("status"))


@query("udx2_sources", "SELECT 'campaigns' AS source, 'https://c.example/' || p_partkey AS url, p_name AS title FROM part WHERE p_partkey % 5 > 0 UNION ALL SELECT 'posts', 'https://p.example/' || conv_id || '/' || turn, role FROM conversations")
def udx2(t, spark):
    csv, posts = new_path(spark, "campaigns"), new_path(spark, "posts")
    k = F.col("p_partkey")
    t("part").select(k.cast("string").alias("id"), F.when(k % 5 > 0, F.col("p_name")).alias("name"), F.lit('say "so"').alias("blurb"), F.concat(F.lit("https://c.example/"), k.cast("string")).alias("project_url"), F.col("p_type").alias("category_name")).write.csv(csv, header=True, escape='"')
    t("conversations").select(F.col("role").alias("title"), F.col("text").alias("selftext"), F.concat_ws("/", F.lit("https://p.example"), "conv_id", "turn").alias("url")).write.json(posts)
    return registry.records(spark, {"campaigns": csv, "posts": posts}).select("source", "url", "title")


@query("udx3_external_scores", """WITH c AS (SELECT doc_id, doc_id % 100 AS score FROM documents) SELECT c.doc_id, CASE WHEN l.doc_id IS NULL OR l.doc_id % 9 = 0 THEN NULL WHEN toxic = 1 THEN 'REJECT' ELSE 'PASS' END AS verdict, l.doc_id IS NULL OR l.doc_id % 2 = 1 AS asked FROM c LEFT JOIN labels l USING (doc_id)""")
def udx3(t, spark):
    """Labels play the responses of a model; half of them are of the version asked for now."""
    k = F.col("doc_id")
    candidates = t("documents").select(k.cast("string").alias("candidate_id"), (k % 100).alias("candidate_score"), F.col("text").alias("payload"), "doc_id")
    word = F.when(F.col("toxic") == 1, "REJECT").otherwise("PASS")
    responses = t("labels").select(
        k.cast("string").alias("candidate_id"), F.lit("p").alias("provider"), F.lit("m").alias("model"), F.when(k % 2 == 0, "2").otherwise("1").alias("version"), F.lit(0).alias("received"), F.when(k % 9 == 0, "{broken").otherwise(F.to_json(F.struct(word.alias("verdict")))).alias("response"))
    asked = EX.requests(candidates, responses, "p", "m", "2").select("candidate_id", F.lit(True).alias("asked"))
    out = EX.with_responses(candidates, responses, "verdict string").join(asked, "candidate_id", "left")
    return out.select("doc_id", F.col("answer.verdict").alias("verdict"), F.coalesce("asked", F.lit(False)).alias("asked"))


@query("udx4_aggregates", """WITH d AS (SELECT user_id, event_type, min(event_id) AS f FROM events GROUP BY ALL) SELECT user_id, string_agg(event_type, ',' ORDER BY f) AS kinds, CASE WHEN bool_or(event_type = 'purchase') THEN 'purchase' WHEN bool_or(event_type = 'signup') THEN 'signup' END AS strongest,
bool_and(true) AS same FROM d GROUP BY user_id""")
def udx4(t, spark):
    a, b = F.create_map(F.lit("x"), F.col("user_id"), F.lit("y"), F.lit(1).cast("long")), F.create_map(F.lit("y"), F.lit(1).cast("long"), F.lit("x"), F.col("user_id"))
    own = t("events").groupBy("user_id").agg(
        AG.ordered_distinct(F.col("event_type"), F.col("event_id")).alias("k"), AG.strongest(F.col("event_type"), ["purchase", "signup"]).alias("strongest"), F.bool_and(AG.map_digest(a) == AG.map_digest(b)).alias("same"))
    return own.select("user_id", F.array_join("k", ",").alias("kinds"), "strongest", "same")


@query("udx5_json_leaves", "SELECT event_id, '$.a.k' AS path, props->>'$.k' AS value FROM events UNION ALL SELECT event_id, '$.b[0]', event_type FROM events UNION ALL SELECT event_id, '$.b[1].c', '2' FROM events")
def udx5(t, spark):
    register(spark)
    t("events").select("event_id", F.concat(F.lit('{"a": '), "props", F.lit(', "b": ["'), "event_type", F.lit('", {"c": 2}]}')).alias("raw")).createOrReplaceTempView("feedloom_raw")
    return spark.sql("SELECT event_id, path, value FROM feedloom_raw, LATERAL json_leaves(raw)")


@query("udx6_sql_functions", """SELECT page_id, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)) AS host, length(trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'))) AS n_visible, least(50, page_id)::INT AS bounded, 'page:' || substr(sha256(url), 1, 16) AS key FROM pages""")
def udx6(t, spark):
    register(spark)
    t("pages").createOrReplaceTempView("feedloom_pages")
    return spark.sql("SELECT page_id, url_host(url) AS host, cast(length(visible_text(html)) AS bigint) AS n_visible, bounded(cast(page_id AS int), 0, 50) AS bounded, short_key('page:', url) AS key FROM feedloom_pages")


@query("agg7_fact_digest", """WITH h AS (SELECT l_returnflag, ('0x' || substr(md5(concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey)), 1, 15))::BIGINT AS h FROM lineitem) SELECT l_returnflag, sum(h)::VARCHAR AS digest_sum, bit_xor(h) AS digest_xor, count(*) AS n FROM h GROUP BY 1""")
def agg7(t, spark):
    return t("lineitem").groupBy("l_returnflag").agg(*AG.rows_digest(*[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")]))


@query("win1_best_per_key", "SELECT p_name, p_partkey, p_size FROM (SELECT *, row_number() OVER (PARTITION BY p_name ORDER BY p_size DESC, p_partkey) AS n FROM part) WHERE n = 1")
def win1(t, spark):
    return M.best_per_key(t("part"), ["p_name"], [F.desc("p_size"), F.col("p_partkey")]).select("p_name", "p_partkey", "p_size")
