"""Evidence by source: facts from a record's JSON, their strength with reasons, what a pick is and why it was taken, what a voice says.

Rules are row-local; facts of several records of a family are aggregated by the caller before they are judged.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.functions.text import clip, collapse
from feedloom.operators.ladders import either, found, hinted, n_hints
from feedloom.operators.phrases import any_of, gated
from feedloom.operators.rule_packs import SIGNALS

# Fields by source, thresholds, patterns and hints.
FACTS = {
    "reddit": {"score": ["score"], "comments": ["num_comments"], "subreddit": ["subreddit"], "post_date": ["created_utc", "published_at"]},
    "amazon": {"price": ["price"], "rating": ["rating"], "review_count": ["review_count"], "rank": ["rank"], "rank_change": ["rank_change"]},
    "kickstarter": {
        "backers": ["backers", "backers_count"], "pledged": ["pledged", "funding"], "goal": ["goal"], "funding_percentage": ["funding_percentage", "percent_funded"], "deadline": ["deadline"], "campaign_status": ["campaign_status", "state"]},
    "indiegogo": {
        "backers": ["backer_count", "backerCount", "backers"], "funds_raised": ["funds_gathered", "fundsGathered", "funding"], "goal": ["campaign_goal", "campaignGoal", "goal"], "funding_percentage": ["funding_percentage"],
        "comment_count": ["comment_count", "commentCount"], "campaign_status": ["campaign_status", "status"]},
    "product_hunt": {"tagline": ["tagline"], "launch_date": ["published_at"], "topics": ["topics", "categories"], "description": ["description"]},
    "yanko_design": {"article_date": ["published_at"], "categories": ["categories"], "tags": ["tags"], "designer": ["designer", "company"]},
    "etsy": {
        "price": ["price"], "currency": ["currency"], "views": ["views"], "favorite_count": ["favorite_count"], "shop_id": ["shop_id"], "taxonomy": ["taxonomy"], "listing_age": ["created_timestamp"], "availability": ["state"]},
    "hacker_news": {"points": ["points"], "comments": ["comment_count"], "submission_timestamp": ["submitted_at"], "author": ["author"], "external_product_url": ["external_product_url"]},
}
#: Of each source the two metrics that count: (name, threshold of STRONG, threshold of MODERATE), whether both must be strong, whether the second alone can be moderate.
STRENGTH = {
    "reddit": (("comments", 25, 5), ("score", 25, 10), True, True), "amazon": (("review_count", 500, 50), ("rating", 4, None), True, False), "kickstarter": (("backers", 500, 50), ("funding_percentage", 100, 100), True, True),
    "indiegogo": (("backers", 500, 50), ("funding_percentage", 100, 100), True, True), "etsy": (("favorite_count", 100, 10), ("views", 5000, 500), False, True), "hacker_news": (("points", 100, 20), ("comments", 30, 10), True, True),
}
NO_PICK = [r"\bshort film\b", r"\bfeature film\b", r"\bmovie\b", r"\bfilm festival\b", r"\balbum\b", r"\bdonation\b", r"\btrip report\b", r"\bitinerary\b", r"\bbag dump\b", r"\bpacking list\b"]
HEADLINES = [r"^(?:how|why)\b", r"^running\b.+\bon\b", r"\bhow .+ redefined\b", r"\b(?:best|top) \d+\b", r"[,;:].+\band\b.+[,;]", r"^most .+[,;]", r"\bworld.s first\b.+\b(?:hotel|festival|exhibition)\b"]
OBJECTS = [
    "bag", "backpack", "jacket", "camera", "chair", "keyboard", "tool", "blade", "tumbler", "bottle", "clip", "magnet", "watering can", "lamp", "holder", "case", "pillow", "wallet", "organizer", "shoe", "device", "battery", "tent", "watch",
    "card", "vacuum", "purifier", "computer", "mattress"]
PROGRAMS = ["software", "app", "platform", "dashboard", "browser", "extension", "api", "tool"]
SPECIFIC = [*PROGRAMS, "agent", "model", "editor", "recorder", "workspace", "developer", "automation"]
TITLE_LIMIT, TITLE_WORDS, BRAND_WORDS = 90, 10, 2
INVALID_POSTS = ["[removed]", "[deleted]", "removed", "deleted"]
INVALID_TITLES = ["removed by moderator", "removed by reddit", "deleted by user"]
IMAGES = r"\.(?:jpg|jpeg|png|gif|webp)$"
INTENTS = [
    "looking for", "recommend", "recommendation", "suggestions", "need", "wish", "can't find", "cannot find", "too expensive", "cheaper", "alternative", "replacement", "problem", "annoying", "better way", "what do you use", "what should i get",
    "how do you carry", "how do you store", "how do you organize"]
GROUP_INTENTS = {
    "onebag": ["lightweight", "bulky", "pack", "carry", "organize", "space"], "buyitforlife": ["durable", "last", "replacement", "broke", "quality", "recommend"], "organization": ["storage", "organize", "clutter", "drawer", "shelf", "space"],
    "campinggear": ["lightweight", "pack", "setup", "recommend", "carry", "storage"], "edc": ["looking for", "recommend", "organizer", "carry", "keys", "wallet"], "shutupandtakemymoney": ["want", "where can i buy", "need", "take my money"]}
OWNED = [r"\b(?:i|we|my|our)\b.{0,80}\b(?:own|owned|bought|use|used|using|have had|had|received|wore|tested)\b", r"\b(?:mine|my|our)\b.{0,80}\b(?:failed|broke|broken|worn|replacement|warranty)\b"]
WANTED = [r"\b(?:recommend|recommendation|looking for|in the market|what is the best|which .* should|need a new|want(?:ed)? to ask)\b"]
COMPARED = [r"\?", r"\b(?:vs\.?|versus|compare|comparison|which of these)\b"]
HARD = ["complex_electronics", "wireless", "high_regulation", "large_or_heavy", "bulky_shipping", "weapon_or_blade"]
WEAK_SIGNALS = ["public_trend_list", "new_release_signal"]
BASKETS = {"software": "软件 / 数字产品", "design": "设计与探索", "needs": "用户需求与问题", "proven": "市场已验证", "other": "其他产品发现"}
REASONS = {"strong": "市场信号较强", "discussed": "用户讨论较多", "backed": "众筹支持较多", "explored": "探索发现", "recent": "近期发现"}
GROUPS = {
    "backpacking_pillow": ["backpacking pillow", "camping pillow"], "work_backpack": ["work backpack", "office backpack"], "key_organizer": ["key organizer", "key organiser", "key holder"], "manual_can_opener": ["manual can opener"],
    "fanny_pack": ["fanny pack", "waist pack"], "desk_lamp": ["desk lamp"]}
NEAR = {r"\binsulated tumbler\b|\btumbler\b": "insulated-tumbler", r"\bmanual can opener\b": "manual-can-opener", r"\bwatering can\b": "watering-can"}
VOICE_FIELDS = ["review_texts", "comment_texts", "feedback_texts", "reviews", "comments"]
AUTHORED = ["reddit", "reddit_arctic_shift", "reddit_software", "hacker_news"]
VOICE_LIMIT, REPORT_LIMIT = 1000, 320
NAMED = ["backpack", "organizer", "organiser", "pouch", "bag", "stand", "holder", "accessory"]
# End of the fixed values.


def _of(source: Column, name: str) -> Column:
    """Whether a source is of a family of sources; forums and catalogues have several names."""
    low = F.lower(source)
    if name == "yanko_design":
        return low.isin("yanko_design", "design_milk")
    return low.contains(name) if name in ("reddit", "amazon", "kickstarter", "indiegogo") else low == name


def facts(source: Column, raw: Column) -> Column:
    """(metric, number, text) of what a source states natively; numbers that stand as numbers in the JSON, all else as text."""

    def fact(metric: str, keys: Sequence[str]) -> Column:
        value = F.coalesce(*[F.nullif(F.nullif(F.get_json_object(raw, f"$.{k}"), F.lit("")), F.lit("[]")) for k in keys])
        plain = F.coalesce(*[F.when(F.nullif(F.nullif(F.get_json_object(raw, f"$.{k}"), F.lit("")), F.lit("[]")).isNotNull(), ~raw.rlike(rf'"{k}"\s*:\s*"')) for k in keys])
        number = F.when(plain, value.try_cast("double"))
        words = F.coalesce(F.array_join(F.from_json(F.when(value.startswith("["), value), "array<string>"), ", "), value)
        return F.when(value.isNotNull(), F.struct(F.lit(metric).alias("metric"), number.alias("number"), F.when(number.isNull(), F.left(words, F.lit(1000))).alias("text")))

    out = F.array().cast("array<struct<metric:string,number:double,text:string>>")
    for name, table in reversed(FACTS.items()):
        out = F.when(_of(source, name), F.array_compact(F.array(*[fact(*f) for f in table.items()]))).otherwise(out)
    return out


def strength(source: Column, metrics: Column, sources: Column) -> Column:
    """(strength, reasons) by the source's two metrics (a map of numbers); two independent sources lift it by one step."""
    value = lambda m: F.coalesce(metrics[m], F.lit(0.0))
    rank, reasons = F.lit(0), F.array().cast("array<string>")
    shown = lambda m: F.concat(F.lit(f"{m} "), F.regexp_replace(F.format_string("%.2f", value(m)), r"\.?0+$", ""))
    for name, ((a, strong_a, some_a), (b, strong_b, some_b), both, second) in reversed(STRENGTH.items()):
        top = (value(a) >= strong_a) & (value(b) >= strong_b) if both else (value(a) >= strong_a) | (value(b) >= strong_b)
        some = (value(a) >= some_a) | (value(b) >= some_b) if second else value(a) >= some_a
        rank = F.when(_of(source, name), F.when(top, 2).when(some, 1).otherwise(0)).otherwise(rank)
        reasons = F.when(_of(source, name), F.array(shown(a), shown(b))).otherwise(reasons)
    lifted = F.least(F.lit(2), rank + F.when(sources >= 2, 1).otherwise(0))
    more = F.when(sources >= 2, F.array(F.concat(sources.cast("string"), F.lit(" independent sources")))).otherwise(F.array().cast("array<string>"))
    return F.struct(F.element_at(F.array(*map(F.lit, ("WEAK", "MODERATE", "STRONG"))), lifted + 1).alias("strength"), F.concat(reasons, more).alias("reasons"))


def title_flags(name: Column, description: Column) -> Column:
    """What speaks against a name as a title: a headline's shape, a sentence's length, or a bare brand that nothing explains."""
    own = F.trim(F.coalesce(name, F.lit("")))
    low, words = F.lower(own), F.size(F.array_remove(F.split(own, r"\s+"), ""))
    list_ = (F.length(own) - F.length(F.replace(own, F.lit(","), F.lit(""))) >= 2) & found(low, [r"\band\b"])
    explained = found(F.lower(F.concat_ws(" ", own, description)), [hinted([*OBJECTS, *SPECIFIC])])
    return F.array_compact(F.array(
        F.when((F.length(own) > TITLE_LIMIT) | found(low, HEADLINES) | list_, F.lit("article_headline")), F.when((words >= TITLE_WORDS) | own.rlike("[?!]$"), F.lit("raw_title_like")),
        F.when((words <= BRAND_WORDS) & ~explained, F.lit("brand_only_unexplained"))))


def is_pick(name: Column, description: Column, source: Column, kind: Column, valid: Column) -> Column:
    """Whether an item is one product that can stand for itself."""
    low = F.lower(F.concat_ws(" ", F.coalesce(name, F.lit("")), F.coalesce(description, F.lit(""))))
    own = F.lower(F.trim(F.coalesce(name, F.lit(""))))
    list_ = (F.length(own) - F.length(F.replace(own, F.lit(","), F.lit(""))) >= 2) & found(own, [r"\band\b"])
    campaign = F.when(kind == "SOFTWARE_PRODUCT", found(low, [hinted(PROGRAMS)])).otherwise(found(low, [hinted(OBJECTS)]))
    bare = F.array_contains(title_flags(name, description), "brand_only_unexplained")
    return F.coalesce(valid, F.lit(True)) & ~gated(low, None, NO_PICK) & ~found(own, HEADLINES) & ~list_ & F.when(F.lower(source).isin("kickstarter", "indiegogo"), campaign).otherwise(~bare)


def software_specificity(name: Column, description: Column, kind: Column) -> Column:
    return F.when(kind == "SOFTWARE_PRODUCT", n_hints(F.lower(F.concat_ws(" ", name, description)), SPECIFIC)).otherwise(0)


def basket(source: Column, kind: Column, strength_: Column) -> Column:
    s, k = F.lower(source), F.upper(kind)
    name = (
        F.when(k == "SOFTWARE_PRODUCT", "software").when((k == "PRODUCT_DESIGN") | (s == "yanko_design"), "design").when(s.contains("reddit"), "needs")
        .when((F.upper(strength_) == "STRONG") & s.isin("amazon", "kickstarter", "indiegogo"), "proven").otherwise("other"))
    return F.create_map(*[F.lit(x) for item in BASKETS.items() for x in item])[name]


def selection_reasons(source: Column, strength_: Column, comments: Column, backers: Column, explored: Column) -> Column:
    s = F.lower(source)
    given = F.array_compact(F.array(
        F.when(F.upper(strength_) == "STRONG", F.lit(REASONS["strong"])), F.when((s.contains("reddit") | (s == "hacker_news")) & (comments >= 5), F.lit(REASONS["discussed"])),
        F.when(s.isin("kickstarter", "indiegogo") & (backers >= 50), F.lit(REASONS["backed"])), F.when(explored, F.lit(REASONS["explored"]))))
    return F.when(F.size(given) > 0, given).otherwise(F.array(F.lit(REASONS["recent"])))


def is_valid_post(title: Column, text: Column, url: Column, hint: Column) -> Column:
    """Posts that weren't removed and are more than an image with a short title."""
    t, x = F.trim(F.coalesce(title, F.lit(""))), F.trim(F.coalesce(text, F.lit("")))
    bare = collapse(F.translate(F.lower(t), "[]", "  "))
    image = F.coalesce(hint == "image", F.lit(False)) | F.coalesce(F.lower(F.substring_index(url, "?", 1)).rlike(IMAGES), F.lit(False))
    return ~F.lower(t).isin(*INVALID_POSTS) & ~F.lower(x).isin(*INVALID_POSTS) & ~bare.isin(*INVALID_TITLES) & ((t != "") | (x != "")) & ~(image & (x == "") & (F.length(t) < 20))


def intents(text: Column, group: Column) -> Column:
    """(found, source): the intents that a text shows, general ones first, and whether the group's own are among them."""
    table = F.create_map(*[x for g, own in GROUP_INTENTS.items() for x in (F.lit(g), F.array(*map(F.lit, own)))])
    own = F.coalesce(table[F.lower(group)], F.array().cast("array<string>"))
    low = F.lower(text)
    every = F.filter(F.array_distinct(F.concat(F.array(*map(F.lit, INTENTS)), own)), lambda p: low.contains(p))
    return F.struct(every.alias("found"), F.when(F.exists(own, lambda p: low.contains(p)), group).otherwise("general").alias("source"))


def voice_kind(text: Column) -> Column:
    """AUTHOR_EXPERIENCE, USER_NEED, PRODUCT_DISCUSSION or DISCUSSION_TEXT."""
    low = F.lower(collapse(F.coalesce(text, F.lit(""))))
    return F.when(found(low, OWNED), "AUTHOR_EXPERIENCE").when(found(low, WANTED), "USER_NEED").when(found(low, COMPARED), "PRODUCT_DISCUSSION").otherwise("DISCUSSION_TEXT")


def baseline_triage(score: Column, signals: Column) -> Column:
    """(status, score, needs_deep, risks) without a model: a tenth of the candidate's score, held down by hard signals."""
    hard = F.array_sort(F.array_intersect(signals, F.array(*map(F.lit, HARD))))
    any_hard, hope = F.size(hard) > 0, F.size(F.array_except(signals, F.array(*map(F.lit, WEAK_SIGNALS)))) > 0
    tenth = F.greatest(F.lit(1), F.least(F.lit(10), F.rint(score / 10).cast("int")))
    own = F.when(any_hard, F.least(tenth, F.lit(3))).otherwise(tenth)
    passes, open_ = (own >= 8) & hope & ~any_hard, (own >= 5) & ~any_hard
    return F.struct(
        F.when(passes, "PASS").when(open_, "REVIEW").otherwise("REJECT").alias("status"), F.when(passes, own).when(open_, F.least(own, F.lit(7))).otherwise(F.least(own, F.lit(4))).alias("score"),
        (passes | open_).alias("needs_deep"), F.slice(hard, 1, 3).alias("risks"))


def opportunity_group(title: Column, summary: Column) -> Column:
    low = F.lower(F.concat_ws(" ", title, summary))
    chain = [F.when(F.lower(title).contains("app") & low.contains("fabric"), F.lit("fabric_travel_app"))]
    for name, phrases in GROUPS.items():
        chain.append(F.when(found(low, [either(phrases)]), F.lit(name)))
    return F.coalesce(*chain)


def near_key(name: Column) -> Column:
    return F.coalesce(*[F.when(F.lower(name).rlike(p), F.lit(k)) for p, k in NEAR.items()])


def published(items: DataFrame, feedback: DataFrame, key: str, kind: str | None = None, strength_: str | None = None, source: str | None = None, hidden: bool = False) -> DataFrame:
    """Items for readers: without those that were hidden or dismissed, of one kind, strength or source if that is asked."""
    out = items
    if not hidden:
        out = out.join(feedback.where(F.col("feedback_type").isin("HIDDEN", "DISMISSED")).select(key).distinct(), key, "left_anti")
    for column, value in (("product_type", kind), ("evidence_strength", strength_)):
        if value:
            out = out.where(F.col(column) == value)
    return out.where(F.array_contains("source_platforms", source)) if source else out


def voices(source: Column, raw: Column, url: Column, description: Column) -> Column:
    """(text, url, author, field, identity) of the texts that users wrote: explicit fields (text, list or objects), and on forums the record's own text; each identity once."""
    item = "struct<text:string,url:string,author:string>"

    def of(field: str) -> Column:
        value = F.get_json_object(raw, f"$.{field}")
        many = F.from_json(F.when(value.startswith("["), value), "array<string>")
        texts = F.coalesce(many, F.when(value.isNotNull(), F.array(value)), F.array().cast("array<string>"))

        def one(v: Column) -> Column:
            own = F.from_json(F.when(v.startswith("{"), v), item)
            return F.struct(F.when(own.isNotNull(), own["text"]).otherwise(v).alias("text"), F.coalesce(F.nullif(own["url"], F.lit("")), url).alias("url"), F.coalesce(own["author"], F.lit("")).alias("author"), F.lit(field).alias("field"))

        return F.transform(texts, one)

    own = F.when(F.lower(source).isin(*AUTHORED), F.array(F.struct(description.alias("text"), url.alias("url"), F.coalesce(F.get_json_object(raw, "$.author"), F.lit("")).alias("author"), F.lit("description").alias("field"))))
    every = F.concat(*[of(f) for f in VOICE_FIELDS], F.coalesce(own, F.array().cast("array<struct<text:string,url:string,author:string,field:string>>")))
    clean = F.transform(every, lambda v: F.struct(F.left(collapse(F.coalesce(v["text"], F.lit(""))), F.lit(VOICE_LIMIT)).alias("text"), v["url"].alias("url"), v["author"].alias("author"), v["field"].alias("field")))
    told = F.filter(clean, lambda v: (v["text"] != "") & F.coalesce(v["url"] != "", F.lit(False)))
    keyed = F.transform(told, lambda v: v.withField("identity", F.sha2(F.concat_ws("|", F.lower(source), v["url"], v["text"]), 256)))
    # the first of equal identities, as the keys come in order
    keys = F.transform(keyed, lambda v: v["identity"])
    return F.filter(keyed, lambda v, i: F.array_position(keys, v["identity"]) == i + 1)


def record_role(source: Column, text: Column, kind: Column) -> Column:
    """product, demand_signal, software, inspiration or uncertain: by source first, then by what the text asks for or names, then by kind."""
    s, asked = F.lower(source), [p for rules in SIGNALS.values() for p, _ in rules]
    by_kind = F.when(kind == "physical", "product").when(kind.isin("software", "inspiration"), kind).otherwise("uncertain")
    forum = F.when(any_of(text, [*asked, "wish", "alternative"], "regex"), "demand_signal").when((kind == "physical") | any_of(text, NAMED, "regex"), "product").otherwise("uncertain")
    return F.when(s == "kickstarter", "product").when(s.isin("reddit", "reddit_arctic_shift"), forum).otherwise(by_kind)


def report_row(physical: Column, software: Column, triage: Column, failed: Column) -> Column:
    """(state, why, opportunity, risks, score, next): of the physical analysis, else the software one, else the triage, else stock phrases; risks are three at most."""
    deep = physical.isNotNull() | software.isNotNull()
    first = lambda field, stock: F.coalesce(physical[field], software[field], triage[field], stock)
    return F.struct(
        F.when(deep, "DEEP_ANALYZED").when(F.coalesce(failed, F.lit(False)), "DEEP_ANALYSIS_FAILED").otherwise("TRIAGED").alias("state"), clip(first("why", F.lit("passed the ranking gates")), REPORT_LIMIT).alias("why"),
        clip(first("opportunity", F.lit("further validation is optional")), REPORT_LIMIT).alias("opportunity"), F.slice(first("risks", F.array(F.lit("further validation is required"))), 1, 3).alias("risks"),
        F.coalesce(physical["score"], software["score"]).alias("score"), F.coalesce(physical["next"], software["next"], F.lit("DEEP_RESEARCH_OPTIONAL")).alias("next"))
