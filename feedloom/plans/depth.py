"""Evidence, picks, voices and their states over the tables; scans and ledgers in their full forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedloom.functions import text as X
from feedloom.functions.sql import register
from feedloom.functions.storage import new_path, written
from feedloom.operators import evidence as E
from feedloom.operators import identity as I
from feedloom.operators import ladders as L
from feedloom.operators import ledgers as LG
from feedloom.operators import merges as M
from feedloom.operators import rule_packs as R
from feedloom.plans.base import query, sql_any
from feedloom.plans.ladders import IDENTITY, REC, folded, hit, listed, quoted, records
from feedloom.sources import landing as LD


def _k():
    """Columns need a session, which isn't there yet when this is imported."""
    return F.col("doc_id")


_x = folded("lower(trim(regexp_replace(coalesce(text, ''), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')))")
_flags = lambda *pairs: "array_to_string(list_filter([" + ", ".join(f"CASE WHEN {c} THEN {quoted(n)} END" for n, c in pairs) + "], lambda x: x IS NOT NULL), ',')"

A, B = "doc_id * 7 % 611", "doc_id * 3 % 137"
_metrics = {"reddit": ("comments", "score"), "amazon": ("review_count", "rating"), "kickstarter": ("backers", "funding_percentage"), "indiegogo": ("backers", "funding_percentage"), "etsy": ("favorite_count", "views"), "hacker_news": ("points", "comments")}


def judged(t):
    """The records with two numbers each, named as their source names them, and strength and reasons by them."""
    rows = records(t)
    pair = F.lit(None).cast("map<string,double>")
    for name, (a, b) in _metrics.items():
        pair = F.when(F.col("source").contains(name), F.create_map(F.lit(a), (_k() * 7 % 611).cast("double"), F.lit(b), (_k() * 3 % 137).cast("double"))).otherwise(pair)
    return rows.withColumn("s", E.strength(F.col("source"), F.coalesce(pair, F.create_map().cast("map<string,double>")), _k() % 4)).select("*", "s.*").drop("s")


_rank = f"""CASE WHEN contains(source, 'reddit') THEN CASE WHEN {A} >= 25 AND {B} >= 25 THEN 2 WHEN {A} >= 5 OR {B} >= 10 THEN 1 ELSE 0 END WHEN source = 'amazon' THEN CASE WHEN {A} >= 500 AND {B} >= 4 THEN 2 WHEN {A} >= 50 THEN 1 ELSE 0 END
  WHEN source IN ('kickstarter', 'indiegogo') THEN CASE WHEN {A} >= 500 AND {B} >= 100 THEN 2 WHEN {A} >= 50 OR {B} >= 100 THEN 1 ELSE 0 END WHEN source = 'etsy' THEN CASE WHEN {A} >= 100 OR {B} >= 5000 THEN 2 WHEN {A} >= 10 OR {B} >= 500 THEN 1 ELSE 0 END
  WHEN source = 'hacker_news' THEN CASE WHEN {A} >= 100 AND {B} >= 30 THEN 2 WHEN {A} >= 20 OR {B} >= 10 THEN 1 ELSE 0 END ELSE 0 END"""
_reason = "CASE " + " ".join(f"WHEN contains(source, '{n}') THEN '{a} ' || ({A}) || '|{b} ' || ({B})" for n, (a, b) in _metrics.items()) + " END"
JUDGED = f"{REC}, j AS (SELECT *, ['WEAK', 'MODERATE', 'STRONG'][least(2, {_rank} + (doc_id % 4 >= 2)::INT) + 1] AS strength, concat_ws('|', {_reason}, CASE WHEN doc_id % 4 >= 2 THEN (doc_id % 4) || ' independent sources' END) AS reasons FROM rec)"


@query("scr4_source_strength", f"WITH {JUDGED} SELECT doc_id, strength, reasons FROM j")
def scr4(t, spark):
    return judged(t).select("doc_id", "strength", F.array_join("reasons", "|").alias("reasons"))


_kind = "CASE doc_id % 5 WHEN 0 THEN 'SOFTWARE_PRODUCT' WHEN 1 THEN 'PRODUCT_DESIGN' ELSE 'PHYSICAL_PRODUCT' END"


def _kind_of():
    return F.when(_k() % 5 == 0, "SOFTWARE_PRODUCT").when(_k() % 5 == 1, "PRODUCT_DESIGN").otherwise("PHYSICAL_PRODUCT")


@query("rul18_pick_baskets", f"""WITH {JUDGED} SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN '软件 / 数字产品' WHEN doc_id % 5 = 1 OR source = 'yanko_design' THEN '设计与探索' WHEN contains(source, 'reddit') THEN '用户需求与问题'
  WHEN strength = 'STRONG' AND source IN ('amazon', 'kickstarter', 'indiegogo') THEN '市场已验证' ELSE '其他产品发现' END AS basket FROM j""")
def rul18(t, spark):
    return judged(t).select("doc_id", E.basket(F.col("source"), _kind_of(), F.col("strength")).alias("basket"))


@query("rul19_pick_reasons", f"""WITH {JUDGED}, r AS (SELECT doc_id, {_flags(('市场信号较强', "strength = 'STRONG'"), ('用户讨论较多', "(contains(source, 'reddit') OR source = 'hacker_news') AND doc_id % 13 >= 5"), ('众筹支持较多', "source IN ('kickstarter', 'indiegogo') AND doc_id % 90 >= 50"), ('探索发现', 'doc_id % 8 = 0'))} AS r FROM j)
SELECT doc_id, coalesce(nullif(r, ''), '近期发现') AS reasons FROM r""")
def rul19(t, spark):
    return judged(t).select("doc_id", F.array_join(E.selection_reasons(F.col("source"), F.col("strength"), _k() % 13, _k() % 90, _k() % 8 == 0), ",").alias("reasons"))


_ti = "lower(title)"
_words = "len(regexp_extract_all(title, '[^ ]+'))"
_comma = "(length(title) - length(replace(title, ',', '')) >= 2 AND regexp_matches(lower(title), '\\band\\b'))"
_headline = f"(length(title) > 90 OR {hit(_ti, E.HEADLINES)} OR {_comma})"
_explained = hit("x", [L.hinted([*E.OBJECTS, *E.SPECIFIC])])
_bare = f"({_words} <= 2 AND NOT {_explained})"
PICKS = f"{REC}, p AS (SELECT *, {folded(chr(108) + 'ower(title || chr(32) || description)')} AS x FROM rec)"


@query("rul17_title_quality", f"WITH {PICKS} SELECT doc_id, {_flags(('article_headline', _headline), ('raw_title_like', _words + ' >= 10 OR regexp_matches(title, ' + quoted('[?!]$') + ')'), ('brand_only_unexplained', _bare))} AS flags FROM p")
def rul17(t, spark):
    return records(t).select("doc_id", F.array_join(E.title_flags(F.col("title"), F.col("description")), ",").alias("flags"))


@query("rul17_pick_worthiness", f"""WITH {PICKS} SELECT doc_id, doc_id % 9 > 0 AND NOT {hit('x', E.NO_PICK)} AND NOT {hit(_ti, E.HEADLINES)} AND NOT {_comma}
  AND CASE WHEN source IN ('kickstarter', 'indiegogo') THEN CASE WHEN doc_id % 5 = 0 THEN {hit('x', [L.hinted(E.PROGRAMS)])} ELSE {hit('x', [L.hinted(E.OBJECTS)])} END ELSE NOT {_bare} END AS is_pick FROM p""")
def rul17_picks(t, spark):
    return records(t).select("doc_id", E.is_pick(F.col("title"), F.col("description"), F.col("source"), _kind_of(), _k() % 9 > 0).alias("is_pick"))


@query("rul20_post_validity", """WITH p AS (SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN 'a picture' WHEN 1 THEN '[removed]' WHEN 2 THEN '[ Removed by  moderator ]' ELSE left(text, 40) END AS title, CASE WHEN conv_id % 3 = 0 THEN '' ELSE trim(text) END AS x FROM conversations)
SELECT conv_id, turn, turn % 4 <> 1 AND turn % 4 <> 2 AND NOT (lower(x) IN ('[removed]', '[deleted]', 'removed', 'deleted')) AND (trim(title) <> '' OR x <> '') AND NOT (x = '' AND length(trim(title)) < 20) AS is_valid FROM p""")
def rul20(t, spark):
    turn = F.col("turn") % 4
    title = F.when(turn == 0, "a picture").when(turn == 1, "[removed]").when(turn == 2, "[ Removed by  moderator ]").otherwise(F.left("text", F.lit(40)))
    return t("conversations").select("conv_id", "turn", E.is_valid_post(title, F.when(F.col("conv_id") % 3 > 0, F.col("text")), F.lit("https://i.example/a.PNG?x=1"), F.lit(None).cast("string")).alias("is_valid"))


_group = "['onebag', 'edc', 'none'][doc_id % 3 + 1]"
_own = "CASE doc_id % 3 WHEN 0 THEN ['lightweight', 'bulky', 'pack', 'carry', 'organize', 'space'] WHEN 1 THEN ['looking for', 'recommend', 'organizer', 'carry', 'keys', 'wallet'] ELSE []::VARCHAR[] END"


@query("rul21_group_intents", f"""WITH d AS (SELECT doc_id, {_group} AS g, {_own} AS own, lower(text || CASE WHEN doc_id % 4 = 0 THEN ' we need keys, any problem?' ELSE '' END) AS x FROM documents), e AS (SELECT *, list_concat([{', '.join(quoted(i) for i in E.INTENTS)}], own) AS every FROM d),
f AS (SELECT *, list_filter(every, lambda p, i: contains(x, p) AND list_position(every, p) = i) AS found, len(list_filter(own, lambda p: contains(x, p))) > 0 AS specific FROM e) SELECT doc_id, array_to_string(found, ',') AS intents, CASE WHEN specific THEN g ELSE 'general' END AS intent_source FROM f""")
def rul21(t, spark):
    text = F.concat("text", F.when(_k() % 4 == 0, " we need keys, any problem?").otherwise(""))
    return t("documents").select("doc_id", E.intents(text, listed(["onebag", "edc", "none"], _k() % 3)).alias("i")).select("doc_id", F.array_join("i.found", ",").alias("intents"), F.col("i.source").alias("intent_source"))


@query("rul24_offline_triage", """WITH s AS (SELECT p_partkey, greatest(1, least(10, round_even(p_size * 2 / 10.0, 0)))::INT AS n, p_type = 'LARGE' AS hard, p_type <> 'PROMO' AS hope FROM part), o AS (SELECT *, CASE WHEN hard THEN least(n, 3) ELSE n END AS own FROM s)
SELECT p_partkey, CASE WHEN own >= 8 AND hope AND NOT hard THEN 'PASS' WHEN own >= 5 AND NOT hard THEN 'REVIEW' ELSE 'REJECT' END AS status, CASE WHEN own >= 8 AND hope AND NOT hard THEN own WHEN own >= 5 AND NOT hard THEN least(own, 7) ELSE least(own, 4) END AS score,
  own >= 5 AND NOT hard AS needs_deep, CASE WHEN hard THEN 'bulky_shipping,wireless' ELSE '' END AS risks FROM o""")
def rul24(t, spark):
    signals = F.when(F.col("p_type") == "LARGE", F.array(F.lit("wireless"), F.lit("bulky_shipping"))).when(F.col("p_type") == "PROMO", F.array(F.lit("public_trend_list"))).otherwise(F.array(F.lit("clear_gap")))
    return t("part").select("p_partkey", E.baseline_triage(F.col("p_size") * 2, signals).alias("r")).select("p_partkey", "r.status", "r.score", "r.needs_deep", F.array_join("r.risks", ",").alias("risks"))


@query("rul28_reader_items", "SELECT p_partkey FROM part WHERE p_type = 'SMALL' AND p_size >= 20 AND p_brand <> 'Brand#1' AND p_partkey NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def rul28(t, spark):
    items = t("part").select("p_partkey", F.col("p_type").alias("product_type"), F.when(F.col("p_size") >= 20, "STRONG").otherwise("WEAK").alias("evidence_strength"), F.array_compact(F.array(F.when(F.col("p_brand") != "Brand#1", F.lit("shop")), F.lit("feed"))).alias("source_platforms"))
    feedback = t("labels").select(F.col("doc_id").alias("p_partkey"), F.when(F.col("toxic") == 1, "HIDDEN").otherwise("SAVED").alias("feedback_type"))
    return E.published(items, feedback, "p_partkey", "SMALL", "STRONG", "shop").select("p_partkey")


@query("rul31_voice_classes", f"WITH v AS (SELECT doc_id, {_x} AS x FROM (SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'We bought two of these. ' WHEN 1 THEN 'Looking for a bag ' WHEN 2 THEN 'this versus that ' ELSE '' END || text AS text FROM documents)) SELECT doc_id, CASE WHEN {hit('x', E.OWNED)} THEN 'AUTHOR_EXPERIENCE' WHEN {hit('x', E.WANTED)} THEN 'USER_NEED' WHEN {hit('x', E.COMPARED)} THEN 'PRODUCT_DISCUSSION' ELSE 'DISCUSSION_TEXT' END AS kind FROM v")
def rul31(t, spark):
    text = F.concat(F.when(_k() % 6 == 0, "We bought two of these. ").when(_k() % 6 == 1, "Looking for a bag ").when(_k() % 6 == 2, "this versus that ").otherwise(""), "text")
    return t("documents").select("doc_id", E.voice_kind(text).alias("kind"))


@query("er9_opportunity_groups", """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'fabric_travel_app' WHEN 1 THEN 'work_backpack' WHEN 2 THEN 'key_organizer' END AS opportunity_group, CASE p_partkey % 4 WHEN 3 THEN 'insulated-tumbler' WHEN 1 THEN 'watering-can' END AS near_key FROM part""")
def er9(t, spark):
    p = F.col("p_partkey") % 4
    title = F.concat(F.when(p == 0, "An app, ").when(p == 1, "Office backpack with a watering can, ").when(p == 2, "KEY organiser ").otherwise("Tumbler "), "p_name")
    return t("part").select("p_partkey", E.opportunity_group(title, F.when(p == 0, "for fabric")).alias("opportunity_group"), E.near_key(title).alias("near_key"))


@query("fn9_source_time", """SELECT event_id, CASE event_id % 4 WHEN 0 THEN TIMESTAMP '2024-03-01 10:00:00' WHEN 1 THEN make_timestamp((1700000000 + event_id) * 1000000) WHEN 2 THEN TIMESTAMP '2024-02-03 02:30:00' ELSE ts END AS at,
CASE event_id % 4 WHEN 0 THEN 'source:published_at' WHEN 1 THEN 'source:created_utc' WHEN 2 THEN 'source:date_published' ELSE 'observation' END AS method FROM events""")
def fn9(t, spark):
    k = F.col("event_id")
    raw = (
        F.when(k % 4 == 0, '{"published_at": "2024-03-01T10:00:00Z"}').when(k % 4 == 1, F.concat(F.lit('{"published": "soon", "created_utc": '), (k + 1700000000).cast("string"), F.lit("}")))
        .when(k % 4 == 2, '{"metadata": {"date_published": "2024-02-03T10:30:00+08:00"}}').otherwise('{"published_at": "?"}'))
    return t("events").select("event_id", X.event_time(raw, F.col("ts")).alias("e")).select("event_id", F.col("e.at").cast("timestamp_ntz").alias("at"), "e.method")


@query("fn20_text_fingerprint", "SELECT doc_id, sha256(trim(string_split(text, chr(10))[1]) || chr(10) || trim(text) || chr(10) || trim(lang)) AS fingerprint FROM (SELECT doc_id, lang, regexp_replace(text, '^ +| +$', '', 'g') AS text FROM documents)")
def fn20(t, spark):
    text = F.regexp_replace("text", "^ +| +$", "")
    return t("documents").select("doc_id", F.sha2(F.concat_ws("\n", F.trim(F.substring_index(text, "\n", 1)), F.trim(text), F.trim("lang")), 256).alias("fingerprint"))


@query("fn14_grouped_numbers", "SELECT o_orderkey, regexp_replace(format('{:,.2f}', o_totalprice), '[.]?0+$', '') AS grouped, regexp_replace(printf('%.2f', o_totalprice), '[.]?0+$', '') AS plain FROM orders")
def fn14(t, spark):
    return t("orders").select("o_orderkey", X.number_text(F.col("o_totalprice"), grouped=True).alias("grouped"), X.number_text(F.col("o_totalprice")).alias("plain"))


@query("agg14_source_facts", f"""WITH {REC} SELECT doc_id, 'score' AS metric, (doc_id % 13)::DOUBLE AS number, NULL AS txt FROM rec WHERE contains(source, 'reddit') UNION ALL SELECT doc_id, 'comments', (doc_id % 17)::DOUBLE, NULL FROM rec WHERE contains(source, 'reddit') AND doc_id % 2 = 0
UNION ALL SELECT doc_id, 'rank', (doc_id % 4)::DOUBLE, NULL FROM rec WHERE source = 'amazon' UNION ALL SELECT doc_id, 'pledged', doc_id * 12.5::DOUBLE, NULL FROM rec WHERE source = 'kickstarter' UNION ALL SELECT doc_id, 'funding_percentage', (doc_id % 200)::DOUBLE, NULL FROM rec WHERE source = 'kickstarter'
UNION ALL SELECT doc_id, 'tagline', NULL, tagline FROM rec WHERE source = 'product_hunt' AND tagline IS NOT NULL UNION ALL SELECT doc_id, 'topics', NULL, category || ', ' || source FROM rec WHERE source = 'product_hunt'""")
def agg14(t, spark):
    return records(t).select("doc_id", F.inline(E.facts(F.col("source"), F.col("raw")))).select("doc_id", "metric", "number", F.col("text").alias("txt"))


@query("src2_array_form", "SELECT o_orderkey AS id, CASE WHEN o_custkey % 10 > 0 THEN round(o_totalprice / ((o_custkey % 10) * 1000.0::DOUBLE) * 100, 6) END AS funded FROM orders")
def src2(t, spark):
    """One bare array a file over many lines, and wrapper objects, in one folder."""
    path = new_path(spark, "json")
    p = F.struct(F.col("o_orderkey").alias("projectId"), F.col("o_orderpriority").alias("projectName"), ((F.col("o_custkey") % 10) * 1000.0).alias("campaignGoal"), F.col("o_totalprice").alias("fundsGathered"))
    each = t("orders").groupBy("o_custkey").agg(F.collect_list(p).alias("projects"))
    pretty = {"pretty": "true"}
    bare = each.where("o_custkey % 2 = 0").select(F.to_json("projects", pretty).alias("value"))
    wrapped = each.where("o_custkey % 2 = 1").select(F.to_json(F.struct("projects"), pretty).alias("value"))
    for part, name in ((bare, "bare"), (wrapped, "wrapped")):
        part.write.option("lineSep", LD.RECORD).text(f"{path}/{name}")
    return LD.campaigns_any(spark, [f"{path}/bare", f"{path}/wrapped"]).select(F.col("projectId").alias("id"), "funded")


@query("src3_list_form", "SELECT conv_id || '-' || turn AS id, CASE WHEN turn % 2 = 0 THEN 'https://forum.example/r/' || conv_id ELSE 'https://else.example/' || turn END AS link FROM conversations")
def src3(t, spark):
    path = new_path(spark, "posts")
    p = F.struct(
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"), F.col("role").alias("title"), F.col("text").alias("selftext"),
        F.when(F.col("turn") % 2 == 0, F.concat(F.lit("/r/"), F.col("conv_id").cast("string"))).alias("permalink"), F.concat(F.lit("https://else.example/"), F.col("turn").cast("string")).alias("url"))
    each = t("conversations").groupBy("conv_id").agg(F.collect_list(p).alias("data"))
    each.select(F.when(F.col("conv_id") % 2 == 0, F.to_json("data")).otherwise(F.to_json(F.struct("data"))).alias("value")).write.text(path)
    return LD.posts_any(spark, path).select("id", "link")


@query("src4_item_documents", "SELECT doc_id AS id, CASE WHEN doc_id % 3 = 0 THEN 'Show HN: item ' || doc_id ELSE 'a & b' END AS text FROM documents WHERE doc_id % 2 = 0")
def src4(t, spark):
    path = new_path(spark, "items")
    own = F.struct(
        F.col("doc_id").alias("id"), F.concat(F.when(_k() % 2 == 0, "Show HN: item ").otherwise("Ask: item "), _k().cast("string")).alias("title"), F.when(_k() % 3 > 0, "<p>a &amp; <b>b</b></p>").alias("text"), F.lit("someone").alias("by"), (_k() % 50).alias("score"))
    t("documents").select(F.to_json(own).alias("value")).write.text(path)
    return LD.launch_items(spark, path).select("id", "text")


@query("src6_atom", "SELECT doc_id::VARCHAR AS title, 'https://f.example/' || doc_id AS link, 'https://i.example/' || doc_id || '.jpg' AS image, lang || ',' || source AS categories FROM documents")
def src6(t, spark):
    path = new_path(spark, "atom")
    rows = t("documents").select(
        _k().cast("string").alias("title"), F.array(F.struct(F.lit("self").alias("_rel"), F.lit("https://f.example/feed").alias("_href")), F.struct(F.lit("alternate").alias("_rel"), F.concat(F.lit("https://f.example/"), _k().cast("string")).alias("_href"))).alias("link"),
        F.lit("<p>hello</p>").alias("summary"), F.struct(F.concat(F.lit("https://i.example/"), _k().cast("string"), F.lit(".jpg")).alias("_url"), F.lit(None).cast("string").alias("v")).alias("thumbnail"),
        F.array(F.struct(F.col("lang").alias("_term"), F.lit(None).cast("string").alias("v")), F.struct(F.col("source").alias("_term"), F.lit(None).cast("string").alias("v"))).alias("category"))
    rows.write.format("xml").option("rowTag", "entry").option("rootTag", "feed").save(path)
    return LD.atom_xml(spark, path).select("title", "link", "image", "categories")


@query("src7_card_fields", """SELECT p_partkey::VARCHAR AS id, p_name AS title, p_retailprice AS price, CASE WHEN p_partkey % 3 > 0 THEN (p_size % 50) / 10.0::DOUBLE END AS rating, (p_size * 1000)::INT AS reviews, (p_partkey % 30 + 1)::INT AS rank, CASE WHEN p_partkey % 4 = 0 THEN 25 END AS rank_change
FROM part WHERE p_partkey % 7 > 0""")
def src7(t, spark):
    k = F.col("p_partkey")
    card = F.concat(
        F.lit('<div data-asin="'), F.when(k % 7 > 0, k.cast("string")).otherwise(""), F.lit('"><span class="zg-badge">#'), (k % 30 + 1).cast("string"), F.lit('</span><img alt="'), F.col("p_name"), F.lit('" src="https://i.example/x.png"><span class="price">$'), F.format_number("p_retailprice", 2),
        F.lit("</span>"), F.when(k % 3 > 0, F.concat(F.lit("<i>"), F.format_string("%.1f", F.col("p_size") % 50 / 10.0), F.lit(" out of 5 stars</i>"))).otherwise(""), F.lit("<a>"), F.col("p_size").cast("string"), F.lit(",000 ratings</a>"), F.when(k % 4 == 0, "<b>Rank: 5 (was 30)</b>").otherwise(""), F.lit("</div>"))
    pages = t("part").groupBy("p_brand").agg(F.array_join(F.collect_list(card), "\n").alias("html")).select(F.col("p_brand").alias("page_id"), F.concat(F.lit("<html><ol>"), "html", F.lit("</ol></html>")).alias("html"))
    return LD.card_fields(pages, "data-asin=").select("id", "title", "price", "rating", "reviews", "rank", "rank_change")


@query("src8_meta_multimap", """SELECT doc_id, 'T' || doc_id AS og_title, 'one,two' AS tags, 'https://c.example/' || doc_id AS canonical, 'N' || doc_id AS ld_name FROM documents""")
def src8(t, spark):
    html = F.concat(
        F.lit("<html><head><meta property='og:title' content=\"T"), _k().cast("string"), F.lit("\"><META name=\"article:tag\" content='one'><meta content=\"two\" name=\"article:tag\"><link rel='canonical' href='https://c.example/"), _k().cast("string"),
        F.lit("'><script type=\"application/ld+json\">{\"@type\": \"Product\", \"name\": \"N"), _k().cast("string"), F.lit("\"}</script></head><body>"), F.col("text"), F.lit("</body></html>"))
    made = LD.structured_metadata(t("documents").select(F.col("doc_id").alias("page_id"), html.alias("html")))
    return made.select(F.col("page_id").alias("doc_id"), F.get(F.col("meta")["og:title"], F.lit(0)).alias("og_title"), F.array_join(F.col("meta")["article:tag"], ",").alias("tags"), "canonical", F.get_json_object(F.get("json_ld", F.lit(0)), "$.name").alias("ld_name"))


@query("src9_deep_keys", "SELECT event_id, array_to_string(list_filter(['x' || (event_id % 5), 'Y', CASE WHEN event_id % 5 <> 1 THEN 'x1' END, event_type], lambda v: v IS NOT NULL), '|') AS found FROM events")
def src9(t, spark):
    e = F.col("event_id")
    raw = F.concat(F.lit('{"a": [{"Keywords": "x'), (e % 5).cast("string"), F.lit(', Y"}, {"b": {"keywords": ["y", "X1", {"deep": 1}], "n": 3}}], "tags": "'), F.col("event_type"), F.lit('", "other": "no"}'))
    register(spark)
    found = F.expr("json_values(raw, array('keywords', 'tags'))")
    return t("events").withColumn("raw", raw).select("event_id", F.array_join(F.transform(found, lambda v: F.when(F.lower(v) == "x1", F.lit("x1")).otherwise(v)), "|").alias("found"))


@query("src13_page_overlay", f"""WITH {REC}, p AS (SELECT page_id, 'about ' || html AS about, CASE WHEN page_id % 2 = 0 THEN 'topic' END AS topic, CASE WHEN page_id % 3 = 0 THEN 'https://i.example/p.png' END AS image FROM pages)
SELECT doc_id, CASE WHEN length(about) > length(description) THEN 'page' ELSE 'feed' END AS described_by, coalesce(topic, category) AS category, coalesce(p.image, 'https://i.example/f.png') AS image FROM rec LEFT JOIN p ON page_id = doc_id""")
def src13(t, spark):
    p = F.col("page_id")
    pages = t("pages").select(p.alias("doc_id"), F.concat(F.lit("about "), "html").alias("description"), F.when(p % 2 == 0, F.array(F.lit("topic"), F.lit("b"))).alias("topics"), F.when(p % 3 == 0, "https://i.example/p.png").alias("image"))
    out = LD.overlaid(records(t).withColumn("image", F.lit("https://i.example/f.png")), pages, "doc_id")
    return out.select("doc_id", F.when(F.col("description").startswith("about "), "page").otherwise("feed").alias("described_by"), "category", "image")


@query("src18_by_run", "SELECT 'by_id' AS kind, o_orderkey AS item, row_number() OVER (ORDER BY o_orderkey) AS position FROM orders WHERE o_custkey = 7 UNION ALL SELECT 'by_parent', o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) FROM orders WHERE o_custkey % 10 = 3")
def src18(t, spark):
    stored = t("orders").select(F.col("o_custkey").alias("run_id"), (F.col("o_custkey") % 10).alias("parent"), F.col("o_orderkey").alias("item"))
    return LG.snapshot(stored, "run_id", 7, "item").select(F.lit("by_id").alias("kind"), "item", "position").unionByName(LG.snapshot(stored, "parent", 3, "item", "run_id").select(F.lit("by_parent").alias("kind"), "item", "position"))


@query("snk4_stored_voice", "WITH b AS (SELECT sha256(role || chr(124) || text) AS k, conv_id FROM conversations), o AS (SELECT DISTINCT k FROM b WHERE conv_id % 3 = 0) SELECT count(DISTINCT k) FILTER (k NOT IN (SELECT k FROM o)) AS saved, count(*) - count(DISTINCT k) FILTER (k NOT IN (SELECT k FROM o)) AS existing FROM b")
def snk4(t, spark):
    keyed = t("conversations").select(X.key_of(F.col("role"), F.col("text")).alias("k"), "conv_id", "text")
    return M.upsert_counts(keyed.where("conv_id % 3 = 0"), keyed, ["k"]).select("saved", F.col("duplicates").alias("existing"))


@query("snk9_run_ledger", """WITH a AS (SELECT event_type AS source, ts::DATE AS d, count(*) AS n FROM events GROUP BY ALL) SELECT strftime(d, '%Y-%m-%d') AS run, source, CASE WHEN day(d) % 2 = 0 THEN n + 1 ELSE n END AS fetched, CASE WHEN day(d) % 2 = 0 THEN 'FINISHED' ELSE 'RUNNING' END AS status FROM a""")
def snk9(t, spark):
    """Runs start with counters of their own; half of them report again and finish."""
    first = t("events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("run"), F.col("event_type").alias("source")).agg(F.count(F.lit(1)).alias("fetched")).withColumn("status", F.lit("RUNNING"))
    again = first.where("cast(substr(run, 9) AS int) % 2 = 0").withColumn("fetched", F.col("fetched") + 1).withColumn("status", F.lit("FINISHED"))
    return M.upsert(first, again, ["run", "source"], [F.desc("fetched")])


@query("snk10_feedback_state", """WITH l AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events WHERE event_type IN ('click', 'view', 'purchase', 'error')) SELECT user_id, event_type AS feedback FROM l WHERE n = 1 AND event_type <> 'error'""")
def snk10(t, spark):
    return LG.feedback_state(t("events"), "user_id", "event_type", [F.desc("event_id")], ["click", "view", "purchase"], cleared="error").select("user_id", F.col("event_type").alias("feedback"))


@query("snk10_queue", """WITH l AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events WHERE event_type IN ('signup', 'purchase')) SELECT user_id, event_id AS since FROM l WHERE n = 1 AND event_type = 'signup'""")
def snk10_queue(t, spark):
    return LG.pending(t("events"), "user_id", "event_type", [F.desc("event_id")], asked="signup", done="purchase").select("user_id", F.col("event_id").alias("since"))


@query("snk15_delivery_ledger", """WITH a AS (SELECT user_id, count(*) AS total, count(*) FILTER (event_type <> 'error') AS sent FROM events GROUP BY 1) SELECT user_id, total, CASE WHEN user_id % 2 = 0 THEN total ELSE sent END AS delivered, CASE WHEN (user_id % 2 = 0 OR sent = total) AND total > 0 THEN 'DELIVERED' ELSE 'PARTIAL' END AS status FROM a""")
def snk15(t, spark):
    """A first round delivers what has no error, a second one everything to half of the users."""
    first = t("events").groupBy("user_id").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("event_type") != "error").alias("delivered"))
    return LG.delivered(LG.delivered(None, first, "user_id"), first.where("user_id % 2 = 0").withColumn("delivered", F.col("total")), "user_id")


@query("agg18_pick_diagnostics", f"""WITH {JUDGED}, d AS (SELECT *, {_kind} AS kind FROM j) SELECT source, count(*) AS picks, count(*) FILTER (kind = 'SOFTWARE_PRODUCT') AS software, count(*) FILTER (strength = 'STRONG') AS strong, count(*) FILTER (doc_id % 4 >= 2) AS multi_source,
count(*) FILTER (trim(description) = '') AS missing_description, CASE WHEN count(*) FILTER (title LIKE '%?') > 0 THEN 'FAIL' ELSE 'PASS' END AS quality FROM d GROUP BY source""")
def agg18(t, spark):
    rows = judged(t).withColumn("kind", _kind_of())
    n = lambda c, name: F.count_if(F.expr(c)).alias(name)
    return rows.groupBy("source").agg(
        F.count(F.lit(1)).alias("picks"), n("kind = 'SOFTWARE_PRODUCT'", "software"), n("strength = 'STRONG'", "strong"), n("doc_id % 4 >= 2", "multi_source"), n("trim(description) = ''", "missing_description"),
        F.when(F.count_if(F.col("title").rlike(r"\?$")) > 0, "FAIL").otherwise("PASS").alias("quality"))


@query("agg22_run_document", """WITH s AS (SELECT event_type, count(*) AS n, sum(event_id % 7) AS updated FROM events GROUP BY 1), o AS (SELECT event_type, event_id, value, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS r FROM events)
SELECT s.event_type, n, updated::BIGINT AS updated, (SELECT string_agg(event_id::VARCHAR, ',' ORDER BY r) FROM o WHERE o.event_type = s.event_type AND r <= 3) AS top FROM s""")
def agg22(t, spark):
    own = M.best_per_key(t("events"), ["event_type"], [F.desc("value"), F.col("event_id")], n=3)
    top = own.groupBy("event_type").agg(F.array_sort(F.collect_list(F.struct((-F.col("value")).alias("v"), "event_id"))).alias("t"))
    sums = t("events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("event_id") % 7).alias("updated"))
    doc = sums.join(top, "event_type").select("event_type", "n", "updated", F.to_json(F.struct(F.transform("t", lambda x: x["event_id"]).alias("top"))).alias("doc"))
    return doc.select("event_type", "n", "updated", F.array_join(F.from_json(F.get_json_object("doc", "$.top"), "array<bigint>"), ",").alias("top"))


@query("jn9_cut_runs", """SELECT e.event_id, d.day + INTERVAL 20 HOUR AS started FROM events e JOIN (SELECT DISTINCT ts::DATE AS day FROM events) d ON e.ts >= d.day + INTERVAL 20 HOUR AND e.ts <= d.day + INTERVAL 52 HOUR WHERE e.event_type = 'view' AND day(d.day) % 2 = 0""")
def jn9(t, spark):
    """Runs of 32 hours are cut at midnight, so that records and runs meet by day."""
    days = t("events").select(F.to_date("ts").alias("day")).distinct().where("day(day) % 2 = 0")
    runs = days.select(F.lit("view").alias("source"), (F.col("day").cast("timestamp_ntz") + F.expr("INTERVAL 20 HOURS")).alias("started"), (F.col("day").cast("timestamp_ntz") + F.expr("INTERVAL 52 HOURS")).alias("finished"))
    return LG.within_runs(t("events").withColumnRenamed("event_type", "source"), "ts", runs, "source").select("event_id", "started")


@query("jn3_satellites", """WITH o AS (SELECT o_custkey AS k, count(*) AS n, max(o_orderdate) AS last FROM orders GROUP BY 1), l AS (SELECT doc_id AS k, max(quality) AS q, max(toxic) AS x FROM labels GROUP BY 1), v AS (SELECT conv_id AS k, count(*) AS turns FROM conversations GROUP BY 1), e AS (SELECT user_id AS k, arg_max(event_type, event_id) AS latest FROM events GROUP BY 1), p AS (SELECT page_id AS k, max(length(html)) AS size FROM pages GROUP BY 1)
SELECT c_custkey, n_name, coalesce(n, 0) AS orders, last, q AS quality, x AS toxic, coalesce(turns, 0) AS turns, latest, size FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN o ON o.k = c_custkey LEFT JOIN l ON l.k = c_custkey LEFT JOIN v ON v.k = c_custkey LEFT JOIN e ON e.k = c_custkey LEFT JOIN p ON p.k = c_custkey""")
def jn3(t, spark):
    per = lambda name, key, *aggs: t(name).groupBy(F.col(key).alias("c_custkey")).agg(*aggs)
    out = t("customer").join(t("nation"), F.col("n_nationkey") == F.col("c_nationkey"), "left").select("c_custkey", "n_name")
    for one in (
        per("orders", "o_custkey", F.count(F.lit(1)).alias("orders"), F.max("o_orderdate").alias("last")), per("labels", "doc_id", F.max("quality").alias("quality"), F.max("toxic").alias("toxic")),
        per("conversations", "conv_id", F.count(F.lit(1)).alias("turns")), per("events", "user_id", F.max_by("event_type", "event_id").alias("latest")), per("pages", "page_id", F.max(F.length("html")).alias("size")),
    ):
        out = out.join(one, "c_custkey", "left")
    return out.fillna(0, ["orders", "turns"])


@query("qa1_rendered_parity", """WITH v AS (SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS place, o_totalprice, o_custkey FROM orders WHERE o_orderkey % 50 > 0)
SELECT 'missing' AS rule, count(*) AS violations FROM orders WHERE o_orderkey % 50 = 0 UNION ALL SELECT 'extra', 0 UNION ALL SELECT 'order', count(*) FROM (SELECT place, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS own FROM v) WHERE place <> own
UNION ALL SELECT 'text', count(*) FROM v WHERE o_orderkey % 77 = 0 UNION ALL SELECT 'number', count(*) FROM v WHERE o_orderkey % 91 = 0 UNION ALL SELECT 'blank', count(*) FROM v WHERE o_orderkey % 77 = 0 UNION ALL SELECT 'duplicate', 0""")
def qa1(t, spark):
    k = F.col("o_orderkey")
    full = t("orders").select(F.col("o_custkey").alias("page"), k.alias("id"), F.col("o_orderpriority").alias("text"), F.col("o_totalprice").alias("number"))
    shown = full.where("id % 50 > 0").withColumn("text", F.when(F.col("id") % 77 == 0, " ").otherwise(F.col("text"))).withColumn("number", F.when(F.col("id") % 91 == 0, F.col("number") + 1).otherwise(F.col("number")))
    return LG.parity(full, shown, "page", "id")


@query("qa3_pinned_rows", """SELECT 'bad_id' AS rule, count(*) FILTER (doc_id % 10 = 3) AS n FROM labels UNION ALL SELECT 'orphan', count(*) FROM labels WHERE doc_id % 10 <> 3 AND doc_id NOT IN (SELECT page_id FROM pages) UNION ALL SELECT 'duplicate', count(*) FROM labels WHERE doc_id % 10 <> 3 AND doc_id % 4 = 0
UNION ALL SELECT 'dependents_conversations', count(*) FROM conversations WHERE conv_id IN (SELECT doc_id FROM labels WHERE doc_id % 10 <> 3) UNION ALL SELECT 'dependents_orders', count(*) FROM orders WHERE o_custkey IN (SELECT doc_id FROM labels WHERE doc_id % 10 <> 3)""")
def qa3(t, spark):
    pinned = t("labels").select(F.when(_k() % 10 == 3, F.concat(F.lit("x"), _k().cast("string"))).otherwise(_k().cast("string")).alias("id"))
    twice = pinned.unionByName(pinned.where("try_cast(id AS bigint) % 4 = 0"))
    return LG.integrity(twice, "id", t("pages").select(F.col("page_id").alias("id")), {"conversations": t("conversations").select(F.col("conv_id").alias("id")), "orders": t("orders").select(F.col("o_custkey").alias("id"))})


@query("qa8_after_change", "SELECT count(*) AS stored, count(*) FILTER (p_brand = 'Brand#1') AS changed_dimension, 0::BIGINT AS changed_snapshot FROM part")
def qa8(t, spark):
    """Stored documents are hashed, the dimension is changed, and the documents are read again."""
    path = new_path(spark, "snapshots")
    brand = t("part").select("p_brand").distinct().withColumn("label", F.lower("p_brand"))
    t("part").join(brand, "p_brand").select("p_partkey", F.struct("p_name", "p_size", "label").alias("doc")).write.parquet(path)
    before = written(spark.read.parquet(path).select("p_partkey", F.sha2(F.to_json("doc"), 256).alias("before")), "hashes")
    changed = brand.withColumn("label", F.when(F.col("p_brand") == "Brand#1", "renamed").otherwise(F.col("label")))
    after = spark.read.parquet(path).select("p_partkey", F.col("doc.label").alias("held"), F.sha2(F.to_json("doc"), 256).alias("after"))
    both = before.join(after, "p_partkey").join(t("part").select("p_partkey", "p_brand").join(changed, "p_brand"), "p_partkey")
    return both.agg(F.count(F.lit(1)).alias("stored"), F.count_if(F.col("held") != F.col("label")).alias("changed_dimension"), F.count_if(F.col("before") != F.col("after")).alias("changed_snapshot"))


@query("qa9_published_text", """WITH a AS (SELECT lang, length(text) AS n, length(regexp_replace(text, '[^a-z]', '', 'g')) AS low, length(regexp_replace(text, '[^0-9]', '', 'g')) AS digits, text FROM documents)
SELECT lang, count(*) AS texts, count(*) FILTER (n > 0 AND low < 0.5 * n) AS few_letters, count(*) FILTER (digits > 0) AS with_digits, count(*) FILTER (trim(text) = '') AS missing, count(*) FILTER (regexp_matches(text, '(?i)https?://')) AS with_links FROM a GROUP BY lang""")
def qa9(t, spark):
    n = lambda c, name: F.count_if(c).alias(name)
    low, digits, size = F.length(F.regexp_replace("text", "[^a-z]", "")), F.length(F.regexp_replace("text", "[^0-9]", "")), F.length("text")
    return t("documents").groupBy("lang").agg(
        F.count(F.lit(1)).alias("texts"), n((size > 0) & (low < 0.5 * size), "few_letters"), n(digits > 0, "with_digits"), n(F.trim("text") == "", "missing"), n(F.col("text").rlike("(?i)https?://"), "with_links"))




@query("fn22_source_voices", """WITH c AS (SELECT conv_id, turn, trim(regexp_replace(text, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')) AS x, 'https://v.example/' || conv_id AS url FROM conversations)
SELECT conv_id, turn, 'feedback_texts' AS field, 'fine ' || turn AS text, url FROM c UNION ALL SELECT conv_id, turn, 'comments', 'so so', 'https://w.example/' FROM c WHERE turn % 2 = 0 UNION ALL SELECT conv_id, turn, 'description', left(x, 1000), url FROM c WHERE conv_id % 3 = 0 AND x <> '' AND left(x, 1000) <> 'fine ' || turn""")
def fn22(t, spark):
    return voice_rows(t).select("conv_id", "turn", "field", "text", "url")


def voice_rows(t):
    """The texts that users wrote in records made of the conversations, with their identity."""
    k = F.col("turn")
    raw = F.concat(F.lit('{"reviews": "fine '), k.cast("string"), F.lit('", "comments": '), F.when(k % 2 == 0, '[{"text": " so  so ", "url": "https://w.example/", "author": "x"}, ""]').otherwise("[]"), F.lit(', "feedback_texts": ["fine '), k.cast("string"), F.lit('"]}'))
    url = F.concat(F.lit("https://v.example/"), F.col("conv_id").cast("string"))
    made = E.voices(F.when(F.col("conv_id") % 3 == 0, "reddit").otherwise("shop"), raw, url, F.col("text"))
    return t("conversations").select("conv_id", "turn", F.inline(made))


_asked = sql_any("title || ' ' || description", [*[p for r in R.SIGNALS.values() for p, _ in r], "wish", "alternative"], "regex")
_named = sql_any("title || ' ' || description", E.NAMED, "regex")


@query("rul4_source_roles", f"""WITH {REC}, k AS (SELECT *, CASE doc_id % 4 WHEN 0 THEN 'physical' WHEN 1 THEN 'software' WHEN 2 THEN 'uncertain' ELSE 'inspiration' END AS kind FROM rec) SELECT doc_id, CASE WHEN source = 'kickstarter' THEN 'product' WHEN source IN ('reddit', 'reddit_arctic_shift') THEN CASE WHEN {_asked} THEN 'demand_signal'
  WHEN kind = 'physical' OR {_named} THEN 'product' ELSE 'uncertain' END WHEN kind = 'physical' THEN 'product' WHEN kind IN ('software', 'inspiration') THEN kind ELSE 'uncertain' END AS role FROM k""")
def rul4(t, spark):
    kind = listed(["physical", "software", "uncertain", "inspiration"], _k() % 4)
    return records(t).select("doc_id", E.record_role(F.col("source"), F.concat_ws(" ", "title", "description"), kind).alias("role"))


@query("rul32_full_report", """SELECT p_partkey, CASE WHEN p_partkey % 4 < 2 THEN 'DEEP_ANALYZED' WHEN p_partkey % 3 = 0 THEN 'DEEP_ANALYSIS_FAILED' ELSE 'TRIAGED' END AS state, CASE p_partkey % 4 WHEN 0 THEN p_name || ' physical' WHEN 1 THEN p_name || ' software' WHEN 2 THEN p_name || ' triage' ELSE 'passed the ranking gates' END AS why,
CASE p_partkey % 4 WHEN 0 THEN 'a,b,c' WHEN 1 THEN 'd' WHEN 2 THEN 'e,f' ELSE 'further validation is required' END AS risks, CASE p_partkey % 4 WHEN 0 THEN p_size WHEN 1 THEN p_size + 1 END AS score, CASE p_partkey % 4 WHEN 0 THEN 'BUILD' WHEN 1 THEN 'SHIP' ELSE 'DEEP_RESEARCH_OPTIONAL' END AS next FROM part""")
def rul32(t, spark):
    k = F.col("p_partkey") % 4

    def analysis(which: int, name: str, risks: list[str], score, step: str):
        own = F.struct(F.concat("p_name", F.lit(f" {name}")).alias("why"), F.lit("idea").alias("opportunity"), F.array(*map(F.lit, risks)).alias("risks"), score.cast("int").alias("score"), F.lit(step).alias("next"))
        return F.when(k == which, own)

    size = F.col("p_size")
    row = E.report_row(analysis(0, "physical", ["a", "b", "c", "d"], size, "BUILD"), analysis(1, "software", ["d"], size + 1, "SHIP"), analysis(2, "triage", ["e", "f"], size, "-"), F.col("p_partkey") % 3 == 0)
    return t("part").select("p_partkey", row.alias("r")).select("p_partkey", "r.state", "r.why", F.array_join("r.risks", ",").alias("risks"), "r.score", "r.next")


@query("er6_full_projection", f"""WITH {IDENTITY} SELECT source, count(*) AS records, count(*) FILTER (eligibility_status = 'ELIGIBLE') AS eligible, count(*) FILTER (concrete_status = 'CONCRETE') AS concrete, count(normalized_name) AS named FROM named GROUP BY source""")
def er6(t, spark):
    """Records to eligibility, concreteness, identity and family, then what each stage keeps, by source."""
    rows = L.named(records(t)).select("source", "eligibility_status", "concrete_status", "normalized_name", "content_type")
    families = I.family(written(rows, "projected"), "normalized_name", "content_type")
    n = lambda c, v: F.count_if(F.col(c) == v)
    return families.groupBy("source").agg(F.count(F.lit(1)).alias("records"), n("eligibility_status", "ELIGIBLE").alias("eligible"), n("concrete_status", "CONCRETE").alias("concrete"), F.count("normalized_name").alias("named"))


@query("snk8_foundation", """WITH b AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 3 > 0 THEN 'zh' || c_custkey END AS new_zh, (c_nationkey + 1) % 25 AS new_family, c_custkey % 4 = 0 AS pinned, c_custkey % 2 = 0 AS was_new, c_custkey % 5 AS points, c_custkey % 7 > 0 AS grouped, c_nationkey FROM customer)
SELECT id, 'ELIGIBLE' AS status, coalesce(new_zh, 'old' || id) AS name_zh, CASE WHEN pinned THEN c_nationkey WHEN grouped THEN new_family END AS family, points + 1 AS points, was_new OR id % 3 = 0 AS was_new FROM b""")
def snk8(t, spark):
    """Six upserts of one run's projection over what is stored: verdicts, names, families, memberships, evidence, observations."""
    c, i = t("customer"), F.col("id")
    own = c.select(F.col("c_custkey").alias("id"), "c_nationkey")
    stored = {
        "eligibility": own.select("id", F.lit("AMBIGUOUS").alias("status")), "identity": own.select("id", F.concat(F.lit("old"), i.cast("string")).alias("name_zh")), "families": own.select(F.col("c_nationkey").alias("family"), F.lit("ACTIVE").alias("state")).distinct(),
        "members": own.select("id", F.col("c_nationkey").alias("family"), (i % 4 == 0).alias("pinned")), "evidence": own.select("id", (i % 5).alias("points")), "observations": own.select("id", (i % 2 == 0).alias("was_new"))}
    batch = {
        "eligibility": own.select("id", F.lit("ELIGIBLE").alias("status")), "identity": own.select("id", F.when(i % 3 > 0, F.concat(F.lit("zh"), i.cast("string"))).alias("name_zh")), "families": own.select(((F.col("c_nationkey") + 1) % 25).alias("family"), F.lit("ACTIVE").alias("state")).distinct(),
        "members": own.select("id", F.when(i % 7 > 0, (F.col("c_nationkey") + 1) % 25).alias("family")), "evidence": own.select("id", (i % 5 + 1).alias("points")), "observations": own.select("id", (i % 3 == 0).alias("was_new"))}
    made = LG.foundation(stored, batch, "id")
    return made["eligibility"].join(made["identity"], "id").join(made["members"].select("id", "family"), "id", "left").join(made["evidence"], "id").join(made["observations"], "id")
