"""Landing files to record frames. Schemas are stated, never inferred; malformed rows become nulls or go to quarantine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from feedloom.functions.text import first_image, parse_number, strip_tags

CAMPAIGNS = "id string, name string, blurb string, project_url string, goal string, pledged string, backers string"


def campaigns_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header; numbers may have separators or a percent sign; rows without an id or name go."""
    raw = spark.read.schema(CAMPAIGNS).csv(path, header=True, quote='"', escape='"', multiLine=True)
    return raw.where(F.col("id").isNotNull() & (F.trim("name") != "")).withColumns({c: parse_number(F.col(c)) for c in ("goal", "pledged", "backers")})


def campaigns_json(spark: SparkSession, path: str) -> DataFrame:
    """One wrapper object {projects: [...]} a line; funding in percent, null for a goal of 0."""
    schema = "projects array<struct<projectId:bigint,projectName:string,campaignGoal:double,fundsGathered:double>>"
    each = spark.read.schema(schema).json(path).select(F.explode("projects").alias("p")).select("p.*")
    return each.withColumn("funded", F.when(F.col("campaignGoal") > 0, F.round(F.col("fundsGathered") / F.col("campaignGoal") * 100, 6)))


def posts_json(spark: SparkSession, path: str) -> DataFrame:
    """{data: [post]} lines; permalinks become absolute."""
    schema = "data array<struct<id:string,title:string,selftext:string,permalink:string,url:string>>"
    each = spark.read.schema(schema).json(path).select(F.explode("data").alias("p")).select("p.*")
    return each.withColumn("link", F.when(F.col("permalink").startswith("/"), F.concat(F.lit("https://forum.example"), F.col("permalink"))).otherwise(F.coalesce("permalink", "url")))


def good_and_bad(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Well-formed JSON lines, and the text of the others."""
    rows = spark.read.text(path).select("value", F.from_json("value", f"{schema}, _bad string", {"columnNameOfCorruptRecord": "_bad"}).alias("r"))
    return rows.where("r._bad IS NULL").select("r.*").drop("_bad"), rows.where("r._bad IS NOT NULL").select("value")


def feed_xml(spark: SparkSession, path: str, tag: str = "item") -> DataFrame:
    """RSS items or Atom entries: title, link, text, image, categories."""
    schema = "title string, link string, description string, encoded string, category array<string>"
    rows = spark.read.format("xml").option("rowTag", tag).option("ignoreNamespace", True).schema(schema).load(path)
    body = F.coalesce("encoded", "description")
    return rows.select(F.trim("title").alias("title"), "link", strip_tags(body).alias("text"), first_image(body).alias("image"), F.array_join("category", ",").alias("categories"))


def list_cards(pages: DataFrame, marker: str) -> DataFrame:
    """(page_id, place, card): what follows each marker of a list page."""
    cards = pages.select("page_id", F.posexplode(F.split("html", marker)).alias("place", "card"))
    return cards.where("place > 0")


def page_metadata(pages: DataFrame) -> DataFrame:
    """page_id, title, charset and language of a page's head."""
    value = lambda p: F.nullif(F.regexp_extract("html", p, 1), F.lit(""))
    return pages.select("page_id", value(r"(?is)<title[^>]*>(.*?)</title>").alias("title"), value(r"(?i)<meta[^>]+charset=[\"']?([^\"'>\s]+)").alias("charset"), value(r"(?i)<html[^>]+lang=[\"']([^\"']+)").alias("page_lang"))


def first_seen(feeds: list[DataFrame], key: str) -> DataFrame:
    """Union of feeds; of equal keys the row of the first feed, then the first place, stays. Feeds have a column place."""
    rows = None
    for i, f in enumerate(feeds):
        one = f.withColumn("feed", F.lit(i))
        rows = one if rows is None else rows.unionByName(one)
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy("feed", "place"))).where("__n = 1").drop("__n")


def capped(df: DataFrame, source: str, order: str, caps: dict[str, int], other: int) -> DataFrame:
    """At most so many rows of each source; an operator whose result is a limit."""
    table = F.create_map(*[F.lit(x) for item in caps.items() for x in item])
    cap = F.coalesce(table[F.col(source)], F.lit(other))
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(source).orderBy(order))).where(F.col("__n") <= cap).drop("__n")


#: Between the documents of a file in which a document may have many lines (a control sign that JSON can't hold).
RECORD = "\x1e\n"
CAMPAIGN = "projectId bigint, projectName string, campaignGoal double, fundsGathered double"
POST = "id string, title string, selftext string, permalink string, url string"


def _listed_or_wrapped(text: DataFrame, schema: str, field: str) -> DataFrame:
    """Rows of JSON documents (value) that are an array, or an object with the array as a field."""
    bare, wrapped = F.from_json("value", f"array<struct<{_struct(schema)}>>"), F.from_json("value", f"{field} array<struct<{_struct(schema)}>>")[field]
    return text.select(F.explode(F.when(F.ltrim(F.regexp_replace("value", r"^\s+", "")).startswith("["), bare).otherwise(wrapped)).alias("p")).select("p.*")


def _struct(schema: str) -> str:
    return ",".join(":".join(c.split()) for c in schema.split(","))


def campaigns_any(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Campaigns from documents over many lines, bare arrays or {projects: [...]}; funding in percent, null for a goal of 0."""
    each = _listed_or_wrapped(spark.read.option("lineSep", RECORD).text(paths), CAMPAIGN, "projects")
    return each.withColumn("funded", F.when(F.col("campaignGoal") > 0, F.round(F.col("fundsGathered") / F.col("campaignGoal") * 100, 6)))


def posts_any(spark: SparkSession, path: str) -> DataFrame:
    """Posts from lines that are lists or {data: [...]}; permalinks become absolute."""
    each = _listed_or_wrapped(spark.read.text(path), POST, "data")
    return each.withColumn("link", F.when(F.col("permalink").startswith("/"), F.concat(F.lit("https://forum.example"), F.col("permalink"))).otherwise(F.coalesce("permalink", "url")))


def launch_items(spark: SparkSession, path: str, prefix: str = "show hn:") -> DataFrame:
    """One item a JSON document; only titles with the prefix, the text without tags, or the title where there is none."""
    rows = spark.read.schema("id bigint, title string, text string, by string, url string, score bigint, descendants bigint, time bigint").json(path)
    kept = rows.where(F.lower("title").startswith(prefix))
    return kept.withColumn("text", F.coalesce(F.nullif(strip_tags(F.col("text")), F.lit("")), "title"))


def atom_xml(spark: SparkSession, path: str) -> DataFrame:
    """Atom entries: title, the alternate link, text, the media image or the first in the text, categories."""
    schema = (
        "title string, link array<struct<_rel:string,_href:string>>, summary string, content string, thumbnail struct<_url:string,_VALUE:string>, enclosure struct<_url:string,_type:string>, category array<struct<_term:string,_VALUE:string>>")
    rows = spark.read.format("xml").option("rowTag", "entry").option("ignoreNamespace", True).schema(schema).load(path)
    body = F.coalesce("content", "summary")
    link = F.coalesce(F.get(F.filter("link", lambda x: x["_rel"] == "alternate"), F.lit(0))["_href"], F.get("link", F.lit(0))["_href"])
    image = F.coalesce("thumbnail._url", F.when(F.col("enclosure._type").startswith("image/"), F.col("enclosure._url")), first_image(body))
    return rows.select(F.trim("title").alias("title"), link.alias("link"), strip_tags(body).alias("text"), image.alias("image"), F.array_join(F.transform("category", lambda c: F.coalesce(c["_term"], c["_VALUE"])), ",").alias("categories"))


def card_fields(pages: DataFrame, marker: str) -> DataFrame:
    """A row for each card of a list page: id, title, image, price, rating, reviews, rank, rank_change; cards without an id or a title go."""
    first = lambda p: F.nullif(F.regexp_extract("card", p, 1), F.lit(""))
    number = lambda p, kind="double": F.regexp_replace(first(p), ",", "").try_cast(kind)
    now, before = number(r"(?i)rank: ?#?([0-9,]+) \(was", "int"), number(r"(?i)\(was ([0-9,]+)\)", "int")
    rows = list_cards(pages, marker).select(
        "page_id", "place", first(r"^\"([^\"]+)\"").alias("id"), strip_tags(first(r"(?i)<img[^>]+alt=\"([^\"]*)\"")).alias("title"), first_image(F.col("card")).alias("image"), number(r"[$€£]([0-9][0-9,]*(?:\.[0-9]+)?)").alias("price"),
        number(r"(?i)([0-9.]+) out of 5").alias("rating"), number(r"(?i)>([0-9][0-9,]*) ratings?<", "int").alias("reviews"), number(r"#([0-9]+)", "int").alias("rank"), (before - now).alias("rank_change"))
    return rows.where(F.col("id").isNotNull() & (F.col("title") != ""))


def structured_metadata(pages: DataFrame) -> DataFrame:
    """page_id, meta (name to its values in order), canonical link and the JSON-LD texts that parse."""
    attribute = lambda tag, name: F.coalesce(F.nullif(F.regexp_extract(tag, rf"(?i)\b{name}\s*=\s*\"([^\"]*)\"", 1), F.lit("")), F.nullif(F.regexp_extract(tag, rf"(?i)\b{name}\s*=\s*'([^']*)'", 1), F.lit("")))
    tags = F.regexp_extract_all("html", F.lit(r"(?i)(<meta\b[^>]*>)"), 1)
    pairs = F.filter(F.transform(tags, lambda t: F.struct(F.lower(F.coalesce(attribute(t, "property"), attribute(t, "name"), attribute(t, "itemprop"))).alias("k"), attribute(t, "content").alias("v"))), lambda p: p["k"].isNotNull() & p["v"].isNotNull())
    # the pairs once, then for each key its values
    rows = pages.withColumn("__pairs", pairs)
    keys = F.array_distinct(F.transform("__pairs", lambda p: p["k"]))
    meta = F.map_from_entries(F.transform(keys, lambda k: F.struct(k, F.transform(F.filter("__pairs", lambda p: p["k"] == k), lambda p: p["v"]))))
    links = F.filter(F.regexp_extract_all("html", F.lit(r"(?i)(<link\b[^>]*>)"), 1), lambda t: attribute(t, "rel") == "canonical")
    scripts = F.regexp_extract_all("html", F.lit(r"(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script>"), 1)
    return rows.select("page_id", meta.alias("meta"), attribute(F.get(links, F.lit(0)), "href").alias("canonical"), F.filter(scripts, lambda s: F.try_parse_json(s).isNotNull()).alias("json_ld"))


def overlaid(rows: DataFrame, pages: DataFrame, key: str) -> DataFrame:
    """Feed rows with what their page says (key, description, topics, image): the longer description, the first topic as category, the page's image."""
    own = pages.select(key, F.col("description").alias("__text"), F.get("topics", F.lit(0)).alias("__topic"), F.col("image").alias("__image"))
    met = rows.join(own, key, "left")
    return met.withColumns({
        "description": F.when(F.length("__text") > F.length(F.coalesce("description", F.lit(""))), F.col("__text")).otherwise(F.col("description")), "category": F.coalesce("__topic", "category"), "image": F.coalesce("__image", "image"),
    }).drop("__text", "__topic", "__image")
