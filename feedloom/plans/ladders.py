"""Ladders by source, lexicon names and what a reader is shown, over the documents as records of many sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedloom.functions import text as X
from feedloom.operators import display as D
from feedloom.operators import ladders as L
from feedloom.operators import lexicon as LX
from feedloom.operators import merges as M
from feedloom.operators import rule_packs as R
from feedloom.operators import titles as TT
from feedloom.plans import rules  # noqa: F401
from feedloom.plans.base import DOC_SQL, ORACLE, PART_SQL, doc_records, part_records, query

SOURCES = ["hacker_news", "etsy", "amazon", "product_hunt", "yanko_design", "design_milk", "reddit", "reddit_software", "kickstarter", "indiegogo", "reddit_arctic_shift", "designboom"]
#: Titles of the records, with the names that each source's rules give them (worked out by hand): catalogue, craft, launch, need, design.
TITLES = [
    ("Show HN: I built a CSV cleaning tool", None, None, "a CSV cleaning tool", None, None), ("Show HN: Thoughts about maps", None, None, "Thoughts about maps", None, None),
    ("Show HN: Apples, pears and plums", None, None, "Apples, pears and plums", None, None), ("Ask the forum: what now", None, None, "Ask the forum: what now", None, None),
    ("Leather travel wallet with passport slot | gift for him", "Leather travel wallet with passport slot", "Leather Passport Travel Wallet", "Leather travel wallet with passport slot | gift for him", "Travel Wallet", None),
    ("Printable planner, digital download", None, None, None, None, None), ("ACME electric portable power banks, Pack of 2", "ACME Power Bank", None, None, None, None),
    ("Desk lamp by a small studio", None, None, None, None, "Desk Lamp"), ("12 best gadgets of the year", None, None, None, None, None), ("Key organizer that holds six keys", None, None, None, "Key Organizer", None),
    ("My EDC", None, None, None, None, None), ("My", None, None, None, None, None), ("Trip report: two weeks in Peru", None, None, "Trip report: two weeks in Peru", None, None),
    ("Fanny pack without zipper", None, None, None, "Zipperless Fanny Pack / Waist Pack", None), ("Habit tracker app for teams", None, None, None, "Habit Tracking App", None), ("Short film about rivers", None, None, None, None, None),
    ("Keyboard case with holder", None, None, None, None, None), ("Support our festival", None, None, None, None, None), ("What apps do you use?", None, None, None, None, None), ("Coffee cups", None, None, None, None, "Coffee Cups"),
    ("Tent cot advice needed", None, None, None, "Camping Tent Cot", None), ("Backpack and bag and box", None, None, None, None, None), ("Roundup of the news", None, None, None, None, None),
]


def listed(values, index):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def records(t):
    """The documents as records: source and title by id, the whole text as description, and raw JSON."""
    k = F.col("doc_id")
    rows = t("documents").select(
        "doc_id", F.concat(F.lit("https://r.example/"), k.cast("string")).alias("url"), listed([x[0] for x in TITLES], k % len(TITLES)).alias("title"), F.col("text").alias("description"), F.col("lang").alias("category"),
        listed(SOURCES, k % len(SOURCES)).alias("source"), (k % 7 == 0).alias("is_digital"), F.when(k % 5 == 0, "https://p.example/").alias("external_url"), F.lit(None).cast("string").alias("known_name"),
        F.when(k % 3 == 0, "The codebase map | for all").when(k % 3 == 1, "A quiet line").alias("tagline"))
    return rows.withColumn("raw", F.to_json(F.struct(
        "tagline", F.array("category", "source").alias("topics"), F.struct(F.lit("deep words").alias("a"), F.array(F.lit("more"), F.lit("still more")).alias("b"), (k % 9).alias("n")).alias("metadata"),
        (k % 200).alias("percent_funded"), (k % 13).alias("score"), F.when(k % 2 == 0, k % 17).alias("num_comments"), (k * 12.5).alias("pledged"), (k % 4).alias("rank"), F.when(k % 6 == 0, F.lit("<b>short</b> excerpt")).alias("excerpt"))))


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _list(values) -> str:
    return "[" + ", ".join(map(quoted, values)) + "]"


REC = f"""rec AS (SELECT doc_id, 'https://r.example/' || doc_id AS url, {_list(x[0] for x in TITLES)}[doc_id % {len(TITLES)} + 1] AS title, text AS description, lang AS category, {_list(SOURCES)}[doc_id % {len(SOURCES)} + 1] AS source,
  doc_id % 7 = 0 AS is_digital, CASE WHEN doc_id % 5 = 0 THEN 'https://p.example/' END AS external_url, CASE doc_id % 3 WHEN 0 THEN 'The codebase map | for all' WHEN 1 THEN 'A quiet line' END AS tagline FROM documents)"""


def folded(text: str) -> str:
    """DuckDB: letters outside ASCII become q (which no pattern has) and other signs a full stop, as its word boundaries know ASCII only."""
    return f"regexp_replace(regexp_replace({text}, '[^\\x00-\\x7F\\p{{L}}\\p{{N}}_]', '.', 'g'), '[^\\x00-\\x7F]', 'q', 'g')"


def hit(text: str, patterns) -> str:
    return f"regexp_matches({text}, {quoted(L.either(patterns))})"


def name_of(text: str, names: dict[str, str]) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({text}, {quoted(p)}) THEN {quoted(n)}" for p, n in names.items()) + " END"


def hints(text: str, words) -> str:
    return f"len(list_distinct(regexp_extract_all({text}, {quoted(chr(92) + 'b(' + '|'.join(words) + ')s?' + chr(92) + 'b')}, 1)))"


N, Y, A = "NON_PRODUCT_CONTENT|INELIGIBLE|", "|ELIGIBLE|", "AMBIGUOUS|AMBIGUOUS|"
ELIGIBILITY = f"""{REC}, t1 AS (SELECT *, {folded("lower(concat_ws(' ', title, description, category))")} AS t, {folded("lower(title)")} AS ti FROM rec),
t2 AS (SELECT *, {hit('t', [L.hinted(L.PHYSICAL_HINTS)])} AS ph, {hit('t', [L.hinted(L.SOFTWARE_HINTS)])} AS sw FROM t1),
t3 AS (SELECT *, string_split(CASE WHEN {hit('t', L.NON_PRODUCT)} AND NOT (source = 'yanko_design' AND (ph OR sw)) THEN '{N}film, event, album or donation' WHEN source IN ('indiegogo', 'kickstarter') AND {hit('t', [chr(92) + 'bfilm' + chr(92) + 'b'])} AND NOT ph AND NOT sw THEN '{N}campaign for a film'
  WHEN {hit('ti', L.EDITORIAL)} AND NOT ph AND NOT sw THEN '{N}editorial or news' WHEN source = 'product_hunt' THEN 'SOFTWARE_PRODUCT{Y}software unless shown otherwise' WHEN source = 'etsy' AND (is_digital OR {hit('t', L.SERVICE)}) THEN '{N}download or service'
  WHEN source = 'etsy' THEN 'PHYSICAL_PRODUCT{Y}active listing' WHEN source = 'hacker_news' THEN CASE WHEN NOT starts_with(ti, 'show hn:') THEN '{N}not a launch' WHEN {hit('t', L.LAUNCH_TALK)} THEN '{N}discussion or essay' WHEN {hit('ti', [L.LAUNCH_SEVERAL])} THEN '{N}several products in the title'
    WHEN {hit('t', L.LAUNCH_HARDWARE)} THEN 'PHYSICAL_PRODUCT{Y}hardware launch' WHEN sw OR {hit('t', L.LAUNCH_SOFTWARE)} OR external_url IS NOT NULL THEN 'SOFTWARE_PRODUCT{Y}software launch' ELSE '{A}launch without a product that can be told' END
  WHEN source = 'amazon' THEN 'PHYSICAL_PRODUCT{Y}catalogue product' WHEN source IN ('yanko_design', 'design_milk') THEN CASE WHEN {hit('ti', L.ROUNDUP)} THEN '{N}roundup of several products' WHEN {hit('t', L.DESIGN_OTHER)} AND NOT ph THEN '{N}architecture, tour, exhibition or interview'
    WHEN ph THEN 'PRODUCT_DESIGN{Y}design object' ELSE '{A}design article without one object' END
  WHEN source = 'reddit_software' THEN 'SOFTWARE_PRODUCT{Y}software or a need of it' WHEN sw THEN 'SOFTWARE_PRODUCT{Y}software' WHEN ph THEN 'PHYSICAL_PRODUCT{Y}physical product' WHEN source = 'kickstarter' AND category = 'design' THEN 'PHYSICAL_PRODUCT{Y}campaign category'
  ELSE '{A}nothing tells what it is' END, '|') AS e FROM t2),
eligible AS (SELECT *, e[1] AS content_type, e[2] AS eligibility_status, e[3] AS eligibility_reason FROM t3)"""
CONCRETE = f"""{ELIGIBILITY}, u1 AS (SELECT *, {folded("lower(trim(regexp_replace(title, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')))")} AS lt, {folded("lower(trim(regexp_replace(description, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')))")} AS lb FROM eligible),
u2 AS (SELECT *, lt || ' ' || lb AS lx, {hints("lt || ' ' || lb", L.PHYSICAL_HINTS)} AS np, {hints("lt || ' ' || lb", L.SOFTWARE_HINTS)} AS ns, {hints('lt', L.PHYSICAL_HINTS)} AS nt, coalesce({name_of("lt || ' ' || lb", L.NEEDS_IN_CONTEXT)}, {name_of('lt', L.NEEDS)}) AS need FROM u1),
u3 AS (SELECT *, string_split(CASE WHEN eligibility_status = 'INELIGIBLE' THEN 'NON_CONCRETE|ineligible content' WHEN source IN ('amazon', 'product_hunt', 'etsy') THEN 'CONCRETE|catalogue record' WHEN contains(source, 'reddit') AND {hit('lt', L.ONE_NEED)} THEN 'CONCRETE|one object or need in the title'
  WHEN {hit('lt', L.NO_OBJECT)} THEN 'NON_CONCRETE|trip, advice or broad discussion' WHEN {hit('lt', L.LOADOUT)} THEN 'NON_CONCRETE|loadout of several items' WHEN {hit('lt', L.LISTICLE)} THEN 'NON_CONCRETE|list of products' WHEN eligibility_status = 'AMBIGUOUS' THEN 'AMBIGUOUS|eligibility is open'
  WHEN source IN ('yanko_design', 'design_milk') THEN CASE WHEN np > 0 THEN 'CONCRETE|one design object' ELSE 'AMBIGUOUS|no single design object' END WHEN source = 'hacker_news' THEN 'CONCRETE|one named launch'
  WHEN lt = 'my' AND contains(lb, 'leather journal') AND contains(lb, 'backpocket') THEN 'CONCRETE|journal cover in the text'
  WHEN contains(source, 'reddit') THEN CASE WHEN need IS NOT NULL THEN 'CONCRETE|one supported object in the title' WHEN np = 1 OR ns >= 1 THEN 'CONCRETE|one product noun' WHEN np > 1 AND nt = 1 THEN 'CONCRETE|one product noun in the title' WHEN np > 1 THEN 'AMBIGUOUS|several possible objects' ELSE 'AMBIGUOUS|no product noun' END
  WHEN source IN ('kickstarter', 'indiegogo') THEN CASE WHEN np > 0 OR ns > 0 THEN 'CONCRETE|object of a campaign' ELSE 'AMBIGUOUS|campaign without an object' END ELSE 'AMBIGUOUS|no rule for the source' END, '|') AS c FROM u2),
gated AS (SELECT *, c[1] AS concrete_status, c[2] AS concrete_reason FROM u3)"""
_hand = "VALUES " + ", ".join("(" + ", ".join("NULL" if v is None else quoted(v) for v in row) + ")" for row in TITLES)
_dash = "title || ' — ' || "
#: Records without a tagline take their whole text as their own line.
_line = "trim(regexp_replace(trim(regexp_replace(description, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')), '\\s*(?:Discussion\\s*\\|\\s*Link)\\s*$', '', 'i'))"
_zh = "CASE n_need " + " ".join(f"WHEN {quoted(n)} THEN {quoted(zh)}" for n, zh in L.NEEDS_ZH.items()) + " END"
_vague = ", ".join(map(quoted, L.VAGUE_TITLES))
IDENTITY = f"""{CONCRETE}, hand(title, n_catalogue, n_craft, n_launch, n_need, n_design) AS ({_hand}),
v0 AS (SELECT gated.*, coalesce(n_catalogue, CASE WHEN title = 'ACME electric portable power banks, Pack of 2' THEN 'ACME Power Bank' ELSE title END) AS n_catalogue, coalesce(n_craft, title) AS n_craft, coalesce(n_launch, title) AS n_launch, n_need, n_design,
  CASE doc_id % 3 WHEN 0 THEN 'Developer Tool' WHEN 2 THEN CASE WHEN source = 'product_hunt' THEN {name_of(f"lower({_line})", L.TAGLINES)} END END AS kind, CASE doc_id % 3 WHEN 1 THEN 'A quiet line' WHEN 2 THEN nullif({_line}, '') END AS own FROM gated JOIN hand USING (title)),
v1 AS (SELECT *, CASE WHEN kind IS NOT NULL THEN {_dash}kind ELSE left({_dash}own, 100) END AS n_tagline FROM v0),
v2 AS (SELECT *, CASE WHEN eligibility_status = 'INELIGIBLE' THEN 'ineligible' WHEN concrete_status = 'NON_CONCRETE' THEN 'non_concrete' WHEN concrete_status = 'AMBIGUOUS' THEN 'unresolved' WHEN lower(title) IN ({_vague}) THEN 'vague_source_title'
  WHEN source = 'product_hunt' AND kind IS NOT NULL THEN 'product_hunt_product_type' WHEN source = 'product_hunt' AND n_tagline IS NOT NULL THEN 'product_hunt_title_tagline' WHEN source = 'amazon' THEN 'amazon_catalog_parser' WHEN source = 'etsy' THEN 'etsy_listing_title_parser'
  WHEN source = 'hacker_news' THEN 'show_hn_title_parser' WHEN contains(source, 'reddit') THEN CASE WHEN n_need IS NOT NULL THEN 'reddit_product_noun' ELSE 'reddit_unresolved' END WHEN source IN ('yanko_design', 'design_milk') AND n_design IS NOT NULL THEN 'design_object_parser'
  WHEN length(title) >= 3 AND NOT regexp_matches(lower(title), '^(my|this|help)\\b') THEN 'source_title' ELSE 'unresolved' END AS identity_method FROM v1),
named AS (SELECT *, CASE WHEN identity_method LIKE 'product_hunt%' THEN n_tagline WHEN identity_method = 'amazon_catalog_parser' THEN n_catalogue WHEN identity_method = 'etsy_listing_title_parser' THEN n_craft WHEN identity_method = 'show_hn_title_parser' THEN n_launch
    WHEN identity_method = 'reddit_product_noun' THEN n_need WHEN identity_method = 'design_object_parser' THEN n_design WHEN identity_method = 'source_title' THEN title END AS normalized_name,
  CASE WHEN identity_method = 'reddit_product_noun' THEN {_zh} END AS name_zh,
  CASE WHEN identity_method LIKE 'product_hunt%' OR identity_method IN ('reddit_product_noun', 'design_object_parser', 'show_hn_title_parser') THEN 'HIGH' WHEN identity_method = 'amazon_catalog_parser' THEN CASE WHEN n_catalogue <> title THEN 'HIGH' ELSE 'MEDIUM' END
    WHEN identity_method = 'etsy_listing_title_parser' THEN CASE WHEN n_craft <> title THEN 'HIGH' ELSE 'MEDIUM' END WHEN identity_method = 'reddit_unresolved' THEN 'LOW' WHEN identity_method = 'source_title' THEN 'MEDIUM' ELSE 'UNRESOLVED' END AS identity_confidence FROM v2)"""


@query("rul12_eligibility", f"WITH {ELIGIBILITY} SELECT doc_id, content_type, eligibility_status, eligibility_reason FROM eligible")
def rul12(t, spark):
    return L.eligibility(records(t)).select("doc_id", "content_type", "eligibility_status", "eligibility_reason")


@query("rul13_concrete", f"WITH {CONCRETE} SELECT doc_id, concrete_status, concrete_reason FROM gated")
def rul13(t, spark):
    return L.concrete(L.eligibility(L.with_texts(records(t)))).select("doc_id", "concrete_status", "concrete_reason")


def named(t):
    return L.named(records(t))


@query("er1_identity", f"WITH {IDENTITY} SELECT doc_id, normalized_name, name_zh, identity_method, identity_confidence FROM named")
def er1(t, spark):
    return named(t).select("doc_id", "normalized_name", "name_zh", "identity_method", "identity_confidence")


@query("er3_discussion_names", f"WITH {CONCRETE} SELECT doc_id, need AS name FROM gated")
def er3_need(t, spark):
    return records(t).select("doc_id", L.need_name(F.lower("title"), F.lower(X.collapse(F.col("description")))).alias("name"))


@query("er3_listing_and_design_names", f"WITH {REC}, hand(title, a, craft, b, c, design) AS ({_hand}) SELECT doc_id, coalesce(craft, title) AS craft, design FROM rec JOIN hand USING (title)")
def er3_rest(t, spark):
    return records(t).select("doc_id", L.craft_name(F.col("title")).alias("craft"), TT.design_name(F.col("title")).alias("design"))


@query("rul3_context", f"""WITH {REC} SELECT doc_id, concat_ws(' ', tagline, category || ' ' || source, 'deep words more still more') AS context,
  CASE WHEN source = 'kickstarter' AND doc_id % 200 >= 100 THEN 'base; market validated: funded >= 100%' WHEN source = 'reddit_arctic_shift' THEN 'base; historical engagement: score=' || (doc_id % 13) || ', comments=' || CASE WHEN doc_id % 2 = 0 THEN (doc_id % 17)::VARCHAR ELSE 'unknown' END ELSE 'base' END AS reason FROM rec""")
def rul3(t, spark):
    return records(t).select("doc_id", L.context_text(F.col("raw")).alias("context"), L.source_reason(F.lit("base"), F.col("source"), F.col("raw")).alias("reason"))


_phrase = "CASE " + " ".join(f"WHEN regexp_matches(lower(name), '{chr(92)}b{p}{chr(92)}b') THEN '{zh}|' || regexp_extract(name, '(?i)^(.*?){chr(92)}b{p}{chr(92)}b', 1)" for p, zh in LX.PHRASES.items()) + " END"


@query("er8_lexicon", f"""WITH n AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_brand || ' ' || p_name WHEN 1 THEN 'Acme X' || p_size || ' Pro ' || p_name || ' Keyboard' WHEN 2 THEN p_name ELSE 'New ' || p_name || ' desk fan' END AS name FROM part),
m AS (SELECT *, string_split({_phrase}, '|') AS m FROM n), w AS (SELECT *, list_filter(string_split(regexp_replace(m[2], '[^A-Za-z0-9_+.-]+', ' ', 'g'), ' '), lambda x: x <> '') AS w FROM m)
SELECT p_partkey, CASE WHEN m IS NULL THEN name WHEN len(w) = 0 OR lower(w[1]) = 'new' THEN m[1] WHEN p_partkey % 4 = 1 THEN 'Acme ' || w[2] || ' ' || m[1] WHEN p_partkey % 4 = 0 THEN concat_ws(' ', w[1], w[2], m[1]) ELSE w[1] || ' ' || m[1] END AS name_zh FROM w""")
def er8(t, spark):
    k = F.col("p_partkey")
    name = (
        F.when(k % 4 == 0, F.concat_ws(" ", "p_brand", "p_name")).when(k % 4 == 1, F.concat(F.lit("Acme X"), F.col("p_size").cast("string"), F.lit(" Pro "), F.col("p_name"), F.lit(" Keyboard"))).when(k % 4 == 2, F.col("p_name"))
        .otherwise(F.concat(F.lit("New "), F.col("p_name"), F.lit(" desk fan"))))
    return t("part").select("p_partkey", LX.lexicon_name(name, F.lit("PHYSICAL_PRODUCT")).alias("name_zh"))


@query("fn5_discussion_url", f"""WITH {REC} SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'https://www.reddit.com/r/x/' || doc_id WHEN 1 THEN 'https://old.reddit.com/r/y' ELSE url END AS discussion,
  CASE doc_id % 4 WHEN 0 THEN 'https://www.reddit.com/r/x/' || doc_id WHEN 2 THEN 'https://q.example/' ELSE url END AS link FROM rec""")
def fn5(t, spark):
    k = F.col("doc_id")
    path = F.when(k % 4 == 0, F.concat(F.lit(" /r/x/"), k.cast("string"))).when(k % 4 == 2, "https://q.example/")
    return records(t).select("doc_id", D.discussion_url(path, F.when(k % 4 == 1, "https://old.reddit.com/r/y"), fallback=F.col("url")).alias("discussion"), D.permalink(path, F.col("url")).alias("link"))


_c = "trim(regexp_replace(regexp_replace(description, '<[^>]+>', ' ', 'g'), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'))"
_ents = _c
for _a, _b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "), ("&amp;", "&")):
    _ents = f"replace({_ents}, '{_a}', '{_b}')"
_visible = f"trim(regexp_replace({_ents}, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'))"


@query("fn16_display_title", f"""WITH {REC}, a AS (SELECT doc_id, title, {_visible} AS s FROM rec), b AS (SELECT *, coalesce(nullif(trim(CASE WHEN regexp_matches(s, '[.!?] ') THEN regexp_extract(s, '^(.*?[.!?]) ', 1) ELSE s END), ''), title) AS f FROM a)
SELECT doc_id, CASE WHEN title <> 'My' THEN title ELSE rtrim(left(f, 60)) END AS display_title FROM b""")
def fn16(t, spark):
    return records(t).select("doc_id", D.display_title(F.col("title"), F.col("description")).alias("display_title"))


def _cut(text: str, limit: int) -> str:
    return f"CASE WHEN length({text}) > {limit} THEN rtrim(left({text}, {limit - 1})) || '…' ELSE {text} END"


@query("fn19_summary", f"WITH {REC}, a AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN {_visible} END AS s, tagline, doc_id % 6 = 0 AS x FROM rec) SELECT doc_id, coalesce(nullif({_cut('s', 420)}, ''), tagline, CASE WHEN x THEN 'short excerpt' END, 'the title') AS summary FROM a")
def fn19(t, spark):
    return records(t).select("doc_id", D.summary(F.col("raw"), F.when(F.col("doc_id") % 2 == 0, F.col("description")), last=F.lit("the title")).alias("summary"))


_money = "regexp_replace(format('{:,.2f}', doc_id * 12.5::DOUBLE), '[.]?0+$', '')"


@query("fn18_metadata", f"""WITH {REC} SELECT doc_id, CASE source WHEN 'kickstarter' THEN 'Funding=' || {_money} || '; Funded=' || (doc_id % 200) || '%' WHEN 'indiegogo' THEN 'Funding=' || {_money} || '; Funded=' || (doc_id % 200) || '%' WHEN 'amazon' THEN 'Rank=' || (doc_id % 4)
  WHEN 'reddit' THEN concat_ws('; ', 'Score=' || (doc_id % 13), CASE WHEN doc_id % 2 = 0 THEN 'Comments=' || (doc_id % 17) END, CASE WHEN doc_id % 6 = 0 THEN 'Excerpt=short excerpt' END) WHEN 'reddit_arctic_shift' THEN concat_ws('; ', 'Score=' || (doc_id % 13), CASE WHEN doc_id % 2 = 0 THEN 'Comments=' || (doc_id % 17) END, CASE WHEN doc_id % 6 = 0 THEN 'Excerpt=short excerpt' END)
  WHEN 'product_hunt' THEN concat_ws('; ', 'Tagline=' || tagline, 'Topics=' || category || ', ' || source) WHEN 'yanko_design' THEN coalesce(CASE WHEN doc_id % 6 = 0 THEN 'Excerpt=short excerpt' END, '') ELSE '' END AS shown FROM rec""")
def fn18(t, spark):
    return records(t).select("doc_id", F.array_join(F.transform(D.source_metadata(F.col("source"), F.col("raw")), lambda x: F.concat_ws("=", x["label"], x["value"])), "; ").alias("shown"))


@query("fn23_snapshot_items", f"""WITH {REC}, a AS (SELECT *, trim(regexp_replace(description, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')) AS d FROM rec)
SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'Unnamed product' ELSE title END AS canonical_name, CASE WHEN doc_id % 4 = 0 THEN 'zh' WHEN doc_id % 5 = 0 THEN 'Unnamed product' ELSE title END AS canonical_name_zh, left(d, 300) AS factual_description, doc_id % 3 = 0 AS feedback_available FROM a""")
def fn23(t, spark):
    k = F.col("doc_id")
    item = D.snapshot_item(F.when(k % 5 != 0, F.col("title")), F.when(k % 4 == 0, "zh"), F.col("description"), F.when(k % 3 == 0, F.array(F.lit("good"))))
    return records(t).select("doc_id", item.alias("i")).select("doc_id", "i.*")


@query("rul29_display_state", """SELECT p_partkey, CASE WHEN p_type = 'SMALL' THEN 'software' WHEN p_type = 'PROMO' THEN 'inspiration' ELSE 'physical' END AS display_type, p_size < 5 OR p_size > 45 OR p_brand = 'Brand#1' AS rejected,
CASE WHEN p_size % 3 = 0 THEN 'ANALYZED' WHEN p_size % 3 = 1 THEN 'AI_PENDING' ELSE 'NOT_ANALYZED' END AS state FROM part""")
def rul29(t, spark):
    kind, size = F.col("p_type"), F.col("p_size")
    none = F.lit(None).cast("string")
    return t("part").select(
        "p_partkey", D.display_type(F.when(kind == "SMALL", "software"), none, F.when(kind == "PROMO", "inspiration_product")).alias("display_type"),
        D.is_rejected(F.when(size < 5, "rejected"), F.when(size > 45, "REJECT"), F.lit("REVIEW"), none, F.when(F.col("p_brand") == "Brand#1", "REVIEW")).alias("rejected"),
        D.analysis_state(F.when(size % 3 == 1, F.col("p_name")), size % 3 == 0).alias("state"))


@query("rul33_triage_shape", "SELECT p_partkey AS candidate_id, CASE WHEN p_type IN ('SMALL', 'LARGE') THEN 'validated_product' ELSE 'demand_opportunity' END AS candidate_type, p_name AS title, p_size AS candidate_score FROM part")
def rul33(t, spark):
    return t("part").select(F.col("p_partkey").alias("candidate_id"), D.triage_type(F.when(F.col("p_type").isin("SMALL", "LARGE"), "validated_product").otherwise(F.col("p_type"))).alias("candidate_type"), F.col("p_name").alias("title"), F.col("p_size").alias("candidate_score"))


@query("jn1_rule_results", f"""WITH o AS ({ORACLE['rul1_opportunity']}), b AS (SELECT p_partkey, p_size FROM part WHERE p_size % 2 = 0)
SELECT o.p_partkey, opportunity_type, filter_score, CASE WHEN b.p_partkey IS NOT NULL THEN 'PASS' ELSE '' END AS feasibility_status, coalesce(b.p_size, 0) AS feasibility_score, coalesce(CASE WHEN b.p_size > 10 THEN 'small' END, '') AS flags FROM o LEFT JOIN b USING (p_partkey)""")
def jn1(t, spark):
    rows = part_records(t)
    verdicts = R.opportunity(rows.withColumn("context", L.context_text(rules.part_raw())), "context").select("url", "opportunity_type", "filter_score")
    some = rows.where("p_size % 2 = 0").select("url", F.lit("PASS").alias("feasibility_status"), F.col("p_size").alias("feasibility_score"), F.array_compact(F.array(F.when(F.col("p_size") > 10, F.lit("small")))).alias("flags"))
    none = rows.where("p_size < 0").select("url", F.lit(1).alias("demand_score"))
    out = M.attached(rows.select("url", "p_partkey"), "url", [(verdicts, {"opportunity_type": "uncertain", "filter_score": 0}), (some, {"feasibility_status": "", "feasibility_score": 0, "flags": []}), (none, {"demand_score": 0})])
    return out.select("p_partkey", "opportunity_type", "filter_score", "feasibility_status", "feasibility_score", F.array_join("flags", ",").alias("flags"))


@query("prj1_valid_records", f"WITH {DOC_SQL} SELECT doc_id, trim(title) <> '' AND trim(category) <> '' AND (doc_id % 4 > 0) AS valid, coalesce(CASE WHEN doc_id % 3 > 0 THEN description END, '') AS description FROM rec")
def prj1(t, spark):
    rows = doc_records(t).withColumns({"url": F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("ftp://h/"), F.col("doc_id").cast("string"))).otherwise(F.col("url")), "description": F.when(F.col("doc_id") % 3 > 0, F.col("description"))})
    return M.checked_records(rows, ["title", "category"], "url", "description").select("doc_id", "valid", "description")


@query("prj4_substring_flags", f"WITH {PART_SQL} SELECT p_partkey, array_to_string(list_filter([CASE WHEN contains(lower(title), 'ring') OR contains(lower(title), 'rod') THEN 'round' END, CASE WHEN contains(lower(title), 'all') THEN 'all' END, CASE WHEN contains(lower(title), 'o') THEN 'o' END], lambda x: x IS NOT NULL), ',') AS flags FROM rec")
def prj4(t, spark):
    from feedloom.operators.phrases import flags

    return part_records(t).select("p_partkey", F.array_join(flags(F.col("title"), {"round": ["ring", "rod"], "all": ["all"], "o": ["o"]}, "part"), ",").alias("flags"))


@query("srt2_ranked_order", "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE o_orderpriority WHEN '2-HIGH' THEN 0 WHEN '1-URGENT' THEN 1 WHEN '3-MEDIUM' THEN 2 ELSE 3 END, o_orderdate DESC, o_orderkey) AS place FROM orders")
def srt2(t, spark):
    from feedloom.operators.selection import numbered, ranked

    return numbered(t("orders"), "place", [ranked(F.col("o_orderpriority"), ["2-HIGH", "1-URGENT", "3-MEDIUM"]), F.desc("o_orderdate"), F.col("o_orderkey")], ["o_custkey"]).select("o_orderkey", "place")


@query("qa5_fresh_run", f"""WITH {IDENTITY}, s AS (SELECT source, count(*) AS fetched, count(*) FILTER (eligibility_status = 'ELIGIBLE') AS eligible, count(*) FILTER (concrete_status = 'CONCRETE') AS concrete, count(*) FILTER (concrete_status = 'NON_CONCRETE') AS non_concrete,
  count(*) FILTER (concrete_status = 'AMBIGUOUS') AS ambiguous, min(doc_id) FILTER (concrete_status = 'NON_CONCRETE') AS first_excluded FROM named GROUP BY source) SELECT * FROM s""")
def qa5(t, spark):
    """The funnel of a run by source, with a sample of what was excluded."""
    rows, is_ = L.concrete(L.eligibility(L.with_texts(records(t)))), lambda c, v: F.count_if(F.col(c) == v)
    return rows.groupBy("source").agg(
        F.count(F.lit(1)).alias("fetched"), is_("eligibility_status", "ELIGIBLE").alias("eligible"), is_("concrete_status", "CONCRETE").alias("concrete"), is_("concrete_status", "NON_CONCRETE").alias("non_concrete"),
        is_("concrete_status", "AMBIGUOUS").alias("ambiguous"), F.min(F.when(F.col("concrete_status") == "NON_CONCRETE", F.col("doc_id"))).alias("first_excluded"))
