"""What a reader is shown of a record: titles, summaries, metadata by source, links, states."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from feedloom.functions.text import bind, clip, collapse, strip_tags

# Titles that say nothing, limits, fields by source with their labels, labels of states.
EMPTY_TITLES = ["my", "help", "question"]
NO_TITLE, NO_SUMMARY, NO_NAME = "Untitled opportunity", "Description not available.", "Unnamed product"
SUMMARY_LIMIT, FIELD_LIMIT, ITEM_LIMIT, TITLE_LIMIT = 420, 240, 300, 60
SUMMARY_FIELDS = ["tagline", "excerpt", "description", "short_description", "shortDescription", "content", "summary"]
_FORUM = [("Subreddit", ["subreddit"], ""), ("Score", ["score"], ""), ("Comments", ["num_comments", "comments"], ""), ("Excerpt", ["excerpt", "selftext"], "")]
FIELDS = {
    "reddit": _FORUM, "reddit_arctic_shift": _FORUM,
    "amazon": [("Price", ["price"], ""), ("Rating", ["rating"], ""), ("Reviews", ["review_count"], ""), ("Rank", ["rank"], ""), ("Rank Change", ["rank_change"], "")],
    "kickstarter": [("Funding", ["pledged"], ""), ("Goal", ["goal"], ""), ("Funded", ["percent_funded", "funding_percentage"], "%"), ("Backers", ["backers_count", "backers"], ""), ("Status", ["state", "campaign_status"], "")],
    "indiegogo": [("Funding", ["funds_gathered", "pledged"], ""), ("Goal", ["campaign_goal", "goal"], ""), ("Funded", ["funding_percentage", "percent_funded"], "%"), ("Backers", ["backer_count", "backers_count"], ""), ("Status", ["campaign_status", "state"], "")],
    "product_hunt": [("Tagline", ["tagline", "content"], ""), ("Topics", ["topics", "category"], ""), ("Votes", ["votes", "votes_count"], "")],
    "yanko_design": [("Category", ["categories", "category"], ""), ("Excerpt", ["excerpt", "description"], ""), ("Published", ["published_at", "published"], "")],
}
TRIAGE_TYPES = ["demand_opportunity", "validated_product", "inspiration_product", "consumer_trend"]
FORUM_HOST = "https://www.reddit.com"
# End of the fixed values.


def display_title(title: Column, summary: Column) -> Column:
    """The title; where it says nothing, the first sentence of the summary."""
    own, text = collapse(F.coalesce(title, F.lit(""))), strip_tags(F.coalesce(summary, F.lit("")))
    sentence = F.nullif(F.rtrim(F.left(F.coalesce(F.nullif(F.trim(F.get(F.split(text, r"(?<=[.!?])\s+", 2), F.lit(0))), F.lit("")), F.nullif(own, F.lit("")), F.lit(NO_TITLE)), F.lit(TITLE_LIMIT))), F.lit(""))
    return F.when((F.length(own) >= 4) & ~F.lower(own).isin(*EMPTY_TITLES), own).otherwise(sentence)


def summary(raw: Column, *first: Column, last: Column) -> Column:
    """The first of the texts, of the JSON's summary fields and of `last` that holds anything, without tags and cut at SUMMARY_LIMIT."""
    texts = [*first, *[F.get_json_object(raw, f"$.{f}") for f in SUMMARY_FIELDS], last]
    return F.coalesce(*[F.nullif(clip(strip_tags(t), SUMMARY_LIMIT), F.lit("")) for t in texts], F.lit(NO_SUMMARY))


def shown(value: Column) -> Column:
    """A JSON value as text: fractions with separators and two places at most, lists joined, anything else as it is."""

    def text(own: Column) -> Column:
        fraction = F.regexp_replace(F.format_number(own.try_cast("double"), 2), r"\.?0+$", "")
        items = F.array_join(F.from_json(own, "array<string>"), ", ")
        return F.when(own.rlike(r"^-?\d+\.\d+(?:[eE][+-]?\d+)?$"), fraction).when(own.rlike(r"^\[.*\]$"), items).otherwise(own)

    return bind(value, text)


def source_metadata(source: Column, raw: Column) -> Column:
    """(label, value) of the fields that a source may show, in its order; fields without a value are left out."""

    def entry(label: str, keys: Sequence[str], suffix: str) -> Column:
        full = [bind(F.get_json_object(raw, f"$.{k}"), lambda v: F.when(~v.isin("", "[]", "{}"), v)) for k in keys]
        return F.struct(F.lit(label).alias("label"), F.concat(shown(F.coalesce(*full)), F.lit(suffix)).alias("value"))

    out = F.array().cast("array<struct<label:string,value:string>>")
    for name, fields in FIELDS.items():
        out = F.when(source == name, F.array(*[entry(*f) for f in fields])).otherwise(out)
    # one expression cleans the values of all fields, each once
    clean = F.transform(out, lambda x: F.struct(x["label"].alias("label"), clip(strip_tags(x["value"]), FIELD_LIMIT).alias("value")))
    return F.filter(clean, lambda x: x["value"] != "")


def permalink(path: Column, url: Column) -> Column:
    """The discussion's own address: paths get the forum's host; without one the record's URL; null if neither is an address."""
    own = F.trim(path)
    return F.coalesce(F.when(own.startswith("/"), F.concat(F.lit(FORUM_HOST), own)).when(own.rlike("^https?://"), own), F.when(url.rlike("^https?://"), url))


def discussion_url(*candidates: Column, fallback: Column) -> Column:
    """The first candidate that leads to a discussion, absolute; else the fallback, unless that is a discussion's path itself."""

    def one(c: Column) -> Column:
        own = F.trim(c)
        leads = own.startswith("/r/") | own.contains("reddit.com/r/") | own.contains("reddit.com/comments/")
        return F.when(leads, F.when(own.startswith("http"), own).otherwise(F.concat(F.lit(FORUM_HOST), own)))

    return F.coalesce(*[one(c) for c in (*candidates, fallback)], fallback)


def display_type(role: Column, opportunity: Column, candidate: Column) -> Column:
    return F.when((role == "software") | (opportunity == "software"), "software").when((candidate == "inspiration_product") | (opportunity == "inspiration"), "inspiration").otherwise("physical")


def is_rejected(rule: Column, feasibility: Column, commodity: Column, specificity: Column, triage: Column) -> Column:
    """Whether any of the verdicts takes a record out of sight."""
    each = [rule == "rejected", feasibility == "REJECT", commodity == "COMMODITY", specificity == "TOO_BROAD", triage.isin("REVIEW", "REJECT")]
    out = F.lit(False)
    for condition in each:
        out = out | F.coalesce(condition, F.lit(False))
    return out


def analysis_state(candidate_id: Column, analysed: Column) -> Column:
    return F.when(analysed, "ANALYZED").when(F.coalesce(candidate_id, F.lit("")) != "", "AI_PENDING").otherwise("NOT_ANALYZED")


def triage_type(candidate_type: Column) -> Column:
    return F.when(candidate_type.isin(*TRIAGE_TYPES), candidate_type).otherwise(TRIAGE_TYPES[0])


def snapshot_item(name: Column, name_zh: Column, description: Column, feedback: Column) -> Column:
    """What a published item holds besides its records: names with fallbacks, the description cut, whether there is feedback."""
    return bind(F.coalesce(F.nullif(name, F.lit("")), F.lit(NO_NAME)), lambda own: F.struct(
        own.alias("canonical_name"), F.coalesce(F.nullif(name_zh, F.lit("")), own).alias("canonical_name_zh"),
        F.left(collapse(F.coalesce(description, F.lit(""))), F.lit(ITEM_LIMIT)).alias("factual_description"), (F.size(F.coalesce(feedback, F.array().cast("array<string>"))) > 0).alias("feedback_available")))
