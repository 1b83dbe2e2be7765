"""Decision tables, picks and composite jobs over the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedloom.functions import text as X
from feedloom.functions.storage import new_path, written
from feedloom.operators import identity as I
from feedloom.operators import jobs as J
from feedloom.operators import merges as M
from feedloom.operators import picks as P
from feedloom.operators import rule_packs as R
from feedloom.operators import scoring as S
from feedloom.operators import titles as TT
from feedloom.operators import verdicts as V
from feedloom.operators.store import KeyedStore
from feedloom.plans import scans
from feedloom.plans.base import DOC_SQL, PART_SQL, doc_records, joined, part_records, query, sql_any, sql_flags
from feedloom.streaming import stored as STORED

_t = "concat_ws(' ', title, description, category)"


@query("rul6_demand_fit", f"""WITH {DOC_SQL}, a AS (SELECT doc_id, {sql_flags(_t, V.DEMAND_FLAGS, 'regex')} AS f, len({sql_flags(_t, V.NOT_FIT, 'regex')}) AS hard, len({sql_flags(_t, V.TECHNICAL, 'regex')}) AS soft FROM rec),
b AS (SELECT *, list_contains(f, 'existing_simple_product') AND len(f) >= 3 AND soft = 0 AS good, least(100, 35 + 9 * len(f)) AS s FROM a)
SELECT doc_id, CASE WHEN hard > 0 THEN 'NOT_FIT' WHEN good THEN 'PRODUCTIZABLE' ELSE 'REVIEW' END AS demand_status, (CASE WHEN hard > 0 THEN greatest(0, 25 - 5 * hard) WHEN good THEN greatest(70, s) ELSE least(69, s) END)::INT AS demand_fit, array_to_string(f, ',') AS demand_flags FROM b""")
def rul6(t, spark):
    return V.demand_fit(doc_records(t), R.text_of("title", "description", "category")).select("doc_id", "demand_status", "demand_fit", joined("demand_flags"))


@query("rul14_disposition", """SELECT doc_id, CASE WHEN toxic = 1 THEN 'HUMAN_REVIEW' WHEN doc_id % 8 = 0 THEN 'DROP' WHEN doc_id % 11 <= 3 THEN 'DROP' WHEN doc_id % 11 <= 5 THEN 'REVIEW' WHEN quality = 0 THEN 'REVIEW' ELSE 'PASS' END AS status,
CASE WHEN toxic = 1 THEN 'unsupported_claim' WHEN doc_id % 8 = 0 THEN 'deep_drop' WHEN doc_id % 11 <= 3 THEN 'low_deep_score' WHEN doc_id % 11 <= 5 THEN 'deep_review' WHEN quality = 0 THEN 'high_regulatory_risk' ELSE 'deep_pass' END AS reason FROM labels""")
def rul14(t, spark):
    text = F.when(F.col("toxic") == 1, "a huge market").otherwise("fine")
    d = V.disposition(text, F.when(F.col("doc_id") % 8 == 0, "DROP").otherwise("WATCH"), F.col("doc_id") % 11, F.when(F.col("quality") == 0, "HIGH").otherwise("LOW"), F.lit("LOW"))
    return t("labels").select("doc_id", d.alias("d")).select("doc_id", "d.*")


@query("rul15_claims", f"SELECT conv_id, turn, array_to_string(list_filter([{', '.join(f'CASE WHEN regexp_matches(lower(text), {chr(39)}{p[0]}{chr(39)}) THEN {chr(39)}{n}{chr(39)} END' for n, p in V.CLAIMS.items())}], lambda x: x IS NOT NULL), ',') AS claims FROM conversations")
def rul15(t, spark):
    return t("conversations").select("conv_id", "turn", F.array_join(V.unsupported_claims(F.col("text")), ",").alias("claims"))


@query("rul18_baskets", "SELECT p_partkey, CASE WHEN p_type = 'SMALL' THEN 'software' WHEN p_size > 40 THEN 'proven' WHEN p_name LIKE '%ring%' THEN 'needs' WHEN p_name LIKE '%plate%' THEN 'design' ELSE 'other' END AS basket FROM part")
def rul18(t, spark):
    return t("part").select("p_partkey", basket().alias("basket"))


def basket():
    return F.when(F.col("p_type") == "SMALL", "software").when(F.col("p_size") > 40, "proven").when(F.col("p_name").contains("ring"), "needs").when(F.col("p_name").contains("plate"), "design").otherwise("other")


@query("rul19_reasons", "SELECT o_orderkey, CASE WHEN o_totalprice > 300000 OR o_orderpriority = '1-URGENT' THEN array_to_string(list_filter([CASE WHEN o_totalprice > 300000 THEN 'large' END, CASE WHEN o_orderpriority = '1-URGENT' THEN 'urgent' END], lambda x: x IS NOT NULL), ',') ELSE 'listed' END AS reasons FROM orders")
def rul19(t, spark):
    found = F.array_compact(F.array(F.when(F.col("o_totalprice") > 300000, F.lit("large")), F.when(F.col("o_orderpriority") == "1-URGENT", F.lit("urgent"))))
    return t("orders").select("o_orderkey", F.when(F.size(found) > 0, F.array_join(found, ",")).otherwise("listed").alias("reasons"))


@query("rul21_intents", "SELECT doc_id, array_to_string(list_filter(CASE source WHEN 'src0' THEN ['the ', 'and '] WHEN 'src1' THEN ['of the', 'que '] ELSE ['is '] END, lambda p: contains(lower(text), p)), ',') AS intents FROM documents")
def rul21(t, spark):
    phrases = F.when(F.col("source") == "src0", F.array(F.lit("the "), F.lit("and "))).when(F.col("source") == "src1", F.array(F.lit("of the"), F.lit("que "))).otherwise(F.array(F.lit("is ")))
    return t("documents").withColumn("low", F.lower("text")).select("doc_id", F.array_join(F.filter(phrases, lambda p: F.col("low").contains(p)), ",").alias("intents"))


@query("rul22_incomplete", "SELECT d.doc_id FROM documents d LEFT JOIN labels l USING (doc_id) WHERE l.quality IS NULL OR trim(d.text) = ''")
def rul22(t, spark):
    return t("documents").join(t("labels"), "doc_id", "left").where(F.col("quality").isNull() | (F.trim("text") == "")).select("doc_id")


@query("rul23_validation", "SELECT doc_id, CASE WHEN trim(text) = '' THEN 'empty' WHEN NOT regexp_matches(text, '[éèçêñöüäß]') THEN 'not_target_script' WHEN contains(lower(text), '$$$') THEN 'banned_term' WHEN length(text) > 2000 THEN 'too_long' END AS code FROM documents")
def rul23(t, spark):
    return t("documents").select("doc_id", V.validation_code(F.col("text"), "[éèçêñöüäß]", ["$$$"], 2000).alias("code"))


@query("rul26_budget", "WITH RECURSIVE s AS (SELECT doc_id, length(source) AS f, length(text) AS n, 0 AS i FROM documents UNION ALL SELECT doc_id, f, CASE WHEN f + n > 900 AND n > 300 THEN n - 100 ELSE n END, i + 1 FROM s WHERE i < 15) SELECT doc_id, n::BIGINT AS kept FROM s WHERE i = 15")
def rul26(t, spark):
    return t("documents").select("doc_id", V.within_budget(F.length("source"), F.col("text"), 900).cast("long").alias("kept"))


@query("rul30_audit_sweep", f"WITH {DOC_SQL} SELECT doc_id, CASE WHEN {sql_any('description', ['the', 'of'])} THEN 'suspicious' ELSE 'missed' END AS kind FROM rec WHERE {sql_any('description', ['the', 'of'])} <> (category = 'en')")
def rul30(t, spark):
    """English words in other languages' documents, and English documents without them."""
    from feedloom.operators.phrases import any_of

    rows = doc_records(t).withColumn("hit", any_of(F.col("description"), ["the", "of"]))
    return rows.where(F.col("hit") != (F.col("category") == "en")).select("doc_id", F.when(F.col("hit"), "suspicious").otherwise("missed").alias("kind"))


@query("rul32_report_rows", "SELECT p_partkey, coalesce(CASE WHEN p_partkey % 3 = 0 THEN p_type END, CASE WHEN p_partkey % 2 = 0 THEN p_brand END, 'unknown') AS field, left(p_name, 6) AS short_name FROM part")
def rul32(t, spark):
    k = F.col("p_partkey")
    return t("part").select("p_partkey", F.coalesce(F.when(k % 3 == 0, F.col("p_type")), F.when(k % 2 == 0, F.col("p_brand")), F.lit("unknown")).alias("field"), F.left("p_name", F.lit(6)).alias("short_name"))


@query("win11_basket_picks")
def win11(t, spark):
    rows = t("part").select("p_brand", F.col("p_partkey").alias("id"), basket().alias("basket"), F.col("p_type").alias("source"), F.when(F.col("p_partkey") % 4 == 0, F.col("p_name")).alias("dup"), "p_size")
    return P.basket_picks(rows, "p_brand", [F.desc("p_size"), F.col("id")], {"proven": 5, "other": 4, "needs": 4, "software": 4, "design": 3}, {"SMALL": 4, "LARGE": 3}, 2, 20)


@query("er9_groups", f"WITH {PART_SQL} SELECT p_partkey, CASE WHEN title LIKE '%ring%' OR title LIKE '%bolt%' THEN 'fastener' WHEN title LIKE '%plate%' THEN 'plate' END AS opportunity_group FROM rec")
def er9(t, spark):
    from feedloom.operators.phrases import first_label

    return part_records(t).select("p_partkey", first_label(F.col("title"), {"fastener": ["ring", "bolt"], "plate": ["plate"]}).alias("opportunity_group"))


@query("er6_projection", f"""WITH {PART_SQL} SELECT description AS kind, count(*) AS records, count(*) FILTER (p_size >= 20) AS eligible, count(DISTINCT CASE WHEN p_size >= 20 THEN title END) AS names FROM rec GROUP BY 1""")
def er6(t, spark):
    """Record to eligibility to identity to counts, one pass."""
    rows = I.family(part_records(t), "title", "description").withColumn("ok", F.col("p_size") >= 20)
    return rows.groupBy(F.col("description").alias("kind")).agg(F.count(F.lit(1)).alias("records"), F.count_if("ok").alias("eligible"), F.count_distinct(F.when(F.col("ok"), F.col("title"))).alias("names"))


@query("fn3_first_image", "SELECT page_id, nullif(regexp_extract(html, '(?i)<img[^>]+src=[\"'']([^\"'']+)', 1), '') AS image FROM pages")
def fn3(t, spark):
    return t("pages").select("page_id", X.first_image(F.col("html")).alias("image"))


@query("fn14_number_format", "SELECT p_partkey, rtrim(rtrim(printf('%.2f', p_retailprice), '0'), '.') AS shown FROM part")
def fn14(t, spark):
    return t("part").select("p_partkey", F.regexp_replace(F.format_string("%.2f", "p_retailprice"), r"\.?0+$", "").alias("shown"))


@query("fn15_first_sentence")
def fn15(t, spark):
    """First sentence, and an excerpt of at most four whole sentences and 720 characters."""
    parts = F.slice(F.split(X.collapse(F.col("text")), r"(?<=[.!?])\s+"), 1, 4)
    fits = F.aggregate(parts, F.lit(""), lambda a, s: F.when(F.length(a) + F.length(s) + 1 <= 720, F.trim(F.concat(a, F.lit(" "), s))).otherwise(a))
    return t("documents").select("doc_id", F.get(parts, F.lit(0)).alias("first_sentence"), fits.alias("excerpt"))


@query("fn22_feedback_texts", "SELECT conv_id, count(*) AS texts FROM (SELECT DISTINCT conv_id, trim(unnest(string_split(text, chr(10)))) AS x FROM conversations) WHERE x <> '' GROUP BY 1")
def fn22(t, spark):
    each = t("conversations").select("conv_id", F.explode(F.split("text", "\n")).alias("x")).select("conv_id", F.trim("x").alias("x")).where("x <> ''").distinct()
    return each.groupBy("conv_id").agg(F.count(F.lit(1)).alias("texts"))


@query("agg14_fact_strings", "SELECT l_partkey, string_agg(DISTINCT l_returnflag || ' x' || l_linestatus, '; ' ORDER BY l_returnflag || ' x' || l_linestatus) AS facts FROM lineitem GROUP BY 1")
def agg14(t, spark):
    fact = F.concat("l_returnflag", F.lit(" x"), "l_linestatus")
    return t("lineitem").groupBy("l_partkey").agg(F.array_join(F.array_sort(F.collect_set(fact)), "; ").alias("facts"))


@query("agg17_audit_rows", "SELECT p_partkey, p_name, p_size, p_size >= 30 AS passed FROM part WHERE p_type = 'PROMO'")
def agg17(t, spark):
    return t("part").where("p_type = 'PROMO'").select("p_partkey", "p_name", "p_size", (F.col("p_size") >= 30).alias("passed"))


@query("agg22_run_statistics", "SELECT strftime(ts, '%Y-%m-%d') AS run, count(*) AS fetched, round(sum(value), 2) AS total, count(DISTINCT user_id) AS users FROM events GROUP BY 1")
def agg22(t, spark):
    return t("events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("run")).agg(F.count(F.lit(1)).alias("fetched"), F.round(F.sum("value"), 2).alias("total"), F.count_distinct("user_id").alias("users"))


@query("src4_items", "SELECT page_id, starts_with(regexp_extract(html, '<h1>([^<]*)</h1>', 1), 'The') AS is_launch FROM pages")
def src4(t, spark):
    return t("pages").select("page_id", F.regexp_extract("html", "<h1>([^<]*)</h1>", 1).startswith("The").alias("is_launch"))


@query("src5_listings", "SELECT l_orderkey, l_linenumber, l_partkey, (l_extendedprice * 100)::BIGINT / 100.0::DOUBLE AS price, l_returnflag || ' > ' || l_linestatus AS taxonomy FROM lineitem")
def src5(t, spark):
    from feedloom.functions.storage import new_path

    path = new_path(spark, "listings")
    rows = t("lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", F.struct(F.rint(F.col("l_extendedprice") * 100).cast("long").alias("amount"), F.lit(100).alias("divisor")).alias("price"), F.array("l_returnflag", "l_linestatus").alias("taxonomy_path"))
    rows.write.json(path)
    schema = "l_orderkey bigint, l_linenumber int, l_partkey bigint, price struct<amount:bigint,divisor:bigint>, taxonomy_path array<string>"
    return spark.read.schema(schema).json(path).select("l_orderkey", "l_linenumber", "l_partkey", (F.col("price.amount") / F.col("price.divisor")).alias("price"), F.array_join("taxonomy_path", " > ").alias("taxonomy"))


@query("src15_valid_records", "SELECT p_partkey FROM part WHERE trim(p_name) <> '' AND p_retailprice IS NOT NULL")
def src15(t, spark):
    return valid(part_records(t)).where("p_retailprice IS NOT NULL").select("p_partkey")


def valid(df):
    """Rows with a title and an http(s) URL with a host."""
    return df.where((F.trim("title") != "") & F.col("url").rlike("^https?://[^/?#]+"))


@query("snk6_published_snapshot", "SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice DESC, o_orderkey) AS position, o_orderstatus AS run FROM orders")
def snk6(t, spark):
    """A partition per run, overwritten alone when a run is published again."""
    from feedloom.operators.selection import numbered_apart

    path = new_path(spark, "snapshots")
    rows = numbered_apart(t("orders"), "position", [F.desc("o_totalprice"), F.col("o_orderkey")], ["o_orderstatus"]).select("o_orderkey", "position", F.col("o_orderstatus").alias("run"))
    rows.write.partitionBy("run").parquet(path)
    rows.where("run = 'P'").write.partitionBy("run").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


@query("snk13_report_files", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def snk13(t, spark):
    from feedloom.functions.storage import new_path

    path = new_path(spark, "report")
    t("events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n")).write.json(path)
    return spark.read.schema("event_type string, n bigint").json(path)


@query("str6_membership", "SELECT user_id, bool_or(event_type = 'signup') AS was_new, bool_or(event_type = 'click') AS was_updated FROM events GROUP BY 1")
def str6(t, spark):
    """A stream of observations merged batch by batch into a stored table, flags or-ed."""
    flags = lambda df: df.groupBy("user_id").agg(F.bool_or(F.col("event_type") == "signup").alias("was_new"), F.bool_or(F.col("event_type") == "click").alias("was_updated"))
    stream = scans._landed(t, spark, 2)
    store = KeyedStore(spark, new_path(spark, "store"), flags(t("events")).schema, ["user_id"], 16)
    STORED.merged(stream, store, flags, [F.col("user_id")], {"was_new": "or", "was_updated": "or"}, "observations")
    return store.read()


@query("str9_rebuild_day", """WITH f AS (SELECT event_id, ts, event_type, 1 AS version FROM events UNION ALL SELECT event_id, ts, 'corrected', 2 FROM events WHERE event_id % 10 = 0),
v AS (SELECT event_id, ts, max_by(event_type, version) FILTER (version <= 1) AS first, max_by(event_type, version) AS second FROM f GROUP BY event_id, ts)
SELECT '2024-01-09' AS day, first AS event_type, count(*) AS n FROM v WHERE ts >= TIMESTAMP '2024-01-09 04:00:00' AND ts < TIMESTAMP '2024-01-10 04:00:00' GROUP BY 2
UNION ALL SELECT '2024-01-10', second, count(*) FROM v WHERE ts >= TIMESTAMP '2024-01-10 04:00:00' AND ts < TIMESTAMP '2024-01-11 04:00:00' GROUP BY 2""")
def str9(t, spark):
    """Yesterday's result is published, today's run corrects facts and publishes today; then yesterday is rebuilt from the facts of its own version."""
    e = t("events").select("event_id", "ts", "event_type")
    facts = written(e.withColumn("version", F.lit(1)).unionByName(e.where("event_id % 10 = 0").withColumn("event_type", F.lit("corrected")).withColumn("version", F.lit(2))), "facts")
    path = new_path(spark, "published")

    def run(day: str, version: int) -> None:
        own = J.as_of(facts, ["event_id"], "version", version).where(F.date_format(X.noon_window(F.col("ts")), "yyyy-MM-dd") == day)
        J.publish_day(own.groupBy("event_type").agg(F.count(F.lit(1)).alias("n")).withColumn("day", F.lit(day)), path, "day")

    for day, version in (("2024-01-09", 1), ("2024-01-10", 2), ("2024-01-09", 1)):
        run(day, version)
    return spark.read.schema("event_type string, n bigint, day string").parquet(path)


@query("qa8_immutability", "SELECT p_partkey, true AS unchanged FROM part")
def qa8(t, spark):
    stored = written(t("part").select("p_partkey", F.sha2(F.to_json(F.struct("p_name", "p_size")), 256).alias("h")), "snapshot")
    again = t("part").select("p_partkey", F.sha2(F.to_json(F.struct("p_name", "p_size")), 256).alias("now"))
    return stored.join(again, "p_partkey").select("p_partkey", (F.col("h") == F.col("now")).alias("unchanged"))


def _rebuild_sql() -> str:
    from feedloom.plans.base import ORACLE
    from feedloom.plans.rules import creative_sql, feasibility_sql

    def verdicts(rec: str, key: str) -> str:
        fit = ORACLE["rul6_demand_fit"].replace(DOC_SQL, rec).replace("doc_id", key)
        return f"""SELECT feasibility_status, content_type, demand_status, eligible FROM ({feasibility_sql(rec, key)}) JOIN (WITH {rec}, {creative_sql(key)} SELECT {key}, content_type, eligible FROM f) USING ({key}) JOIN ({fit}) USING ({key})"""

    return f"""WITH v AS ({verdicts(DOC_SQL, 'doc_id')} UNION ALL {verdicts(PART_SQL, 'p_partkey')}) SELECT feasibility_status, content_type, demand_status, count(*) AS records,
  (SELECT count(*) FROM v WHERE eligible OR demand_status = 'PRODUCTIZABLE' OR feasibility_status = 'PASS') AS candidates FROM v GROUP BY ALL"""


@query("job2_rebuild_pool", _rebuild_sql())
def job2(t, spark):
    """All rule packs over the stored records, all builders, one candidate per URL."""
    rows = part_records(t).unionByName(doc_records(t), allowMissingColumns=True)
    seen = R.without_index(R.demand_signal(V.demand_fit(R.feasibility(R.creative(R.with_index(rows, *V.OF_DEMAND))), R.text_of("title", "description", "category"))))
    ready = written(seen.withColumns({"clarity": F.lit(60), "backers": F.lit(None).cast("double"), "funded": F.lit(None).cast("double")}), "classified")
    pool = S.inspirations(ready).unionByName(S.demands(ready)).unionByName(S.validated(ready))
    best = M.best_per_key(pool, ["source_url"], [F.desc("candidate_score"), F.col("candidate_type")])
    counts = ready.groupBy("feasibility_status", "content_type", "demand_status").agg(F.count(F.lit(1)).alias("records"))
    return counts.join(F.broadcast(best.agg(F.count(F.lit(1)).alias("candidates"))))


_low = "lower(concat_ws(' ', title, category))"
_first = lambda table, other: "CASE " + " ".join(f"WHEN {sql_any('x', p, 'part')} THEN '{n}'" for n, p in table.items()) + f" ELSE {other} END"


@query("rul10_trend_items", f"""WITH {DOC_SQL}, a AS (SELECT doc_id, {_low} AS x FROM rec), b AS (SELECT *, {_first(TT.TREND_RISKS, 'NULL')} AS risk, {sql_any('x', TT.SIMPLE, 'part')} AS easy, {_first(TT.THEMES, "'other'")} AS theme FROM a)
SELECT doc_id, coalesce(risk, CASE WHEN easy THEN 'simple_physical' ELSE 'other' END) AS trend_class, CASE WHEN risk IS NOT NULL THEN 'rejected' WHEN easy THEN 'candidate' ELSE 'uncertain' END AS trend_status,
  CASE WHEN risk IS NOT NULL THEN 'other' ELSE theme END AS trend_theme, (CASE WHEN risk IS NOT NULL THEN 20 WHEN easy THEN 70 ELSE 45 END)::INT AS trend_score FROM b""")
def rul10(t, spark):
    return TT.trend_item(doc_records(t)).select("doc_id", "trend_class", "trend_status", "trend_theme", "trend_score")


@query("rul10_market_signal", "SELECT p_partkey, least(100, CASE WHEN p_type = 'PROMO' THEN 45 ELSE 50 END + CASE WHEN p_size <= 10 THEN 25 WHEN p_size <= 30 THEN 18 ELSE 10 END + CASE WHEN p_partkey % 3 = 0 THEN 10 ELSE 0 END + CASE WHEN p_partkey % 5 >= 4 THEN 5 ELSE 0 END + CASE WHEN p_partkey % 400 >= 200 THEN 10 WHEN p_partkey % 400 >= 20 THEN 5 ELSE 0 END)::INT AS points FROM part")
def rul10_points(t, spark):
    k = F.col("p_partkey")
    return t("part").select("p_partkey", TT.market_signal(F.col("p_type") == "PROMO", F.col("p_size"), F.when(k % 3 == 0, k), k % 5, k % 400).alias("points"))


@query("er2_catalogue_names", "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_type || ' Insulated Tumbler' ELSE p_name END AS name FROM part")
def er2(t, spark):
    title = F.when(F.col("p_partkey") % 2 == 0, F.concat("p_type", F.lit(" gaming tumblers, Pack of 2"))).otherwise(F.concat("p_name", F.lit(" | large | new")))
    return t("part").select("p_partkey", TT.catalogue_name(title).alias("name"))


@query("er3_launch_names", "SELECT p_partkey, p_name AS name FROM part")
def er3(t, spark):
    return t("part").select("p_partkey", TT.launch_name(F.concat(F.lit("Show HN: I built "), "p_name", F.lit(" – a thing"))).alias("name"))
