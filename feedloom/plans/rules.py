"""Rule packs and candidate builders over the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedloom.functions.storage import written
from feedloom.operators import ladders as L
from feedloom.operators import rule_packs as R
from feedloom.operators import scoring as S
from feedloom.operators.phrases import any_of, first_label, has, matched, padded
from feedloom.operators.merges import best_per_key
from feedloom.plans.base import DOC_SQL, PART_SQL, doc_records, joined, part_records, query, sql_any, sql_flags, sql_padded, sql_sum

JOIN = "array_to_string({}, ',')".format
PART_TEXT = "concat_ws(' ', title, description, category)"
#: Words of the driver's part names, so that the generic forms are exercised.
SIZES = {"little": ["small", "SMALL"], "big": ["large", "LARGE"], "heat": ["hot", "red"], "chill": ["cold", "blue"]}
_phrases = ["small", "ring", "rod", "plate", "red widget", "bolt"]


@query("prj2_phrases", f"WITH {PART_SQL} SELECT p_partkey, {JOIN(sql_flags(PART_TEXT, {p: [p] for p in _phrases}))} AS phrases FROM rec")
def prj2(t, spark):
    return part_records(t).select("p_partkey", F.array_join(matched(R.text_of("title", "description", "category"), _phrases), ",").alias("phrases"))


@query("prj3_regex_flags", f"WITH {DOC_SQL} SELECT doc_id, {JOIN(sql_flags('description', R.POSITIVE, 'regex'))} AS flags FROM rec")
def prj3(t, spark):
    from feedloom.operators.phrases import flags

    return doc_records(t).select("doc_id", F.array_join(flags(F.col("description"), R.POSITIVE, "regex"), ",").alias("flags"))


@query("prj5_padded_terms", f"WITH {PART_SQL} SELECT p_partkey, {sql_padded('lower(title)', ['ring', 'rod', 'hot plate'])} AS is_hit FROM rec")
def prj5(t, spark):
    return part_records(t).select("p_partkey", padded(F.lower("title"), ["ring", "rod", "hot plate"]).alias("is_hit"))


_case = " ".join(f"WHEN {sql_any('title || chr(32) || description', p, 'part')} THEN '{k}'" for k, p in SIZES.items())


@query("prj6_first_rule", f"WITH {PART_SQL} SELECT p_partkey, CASE {_case} ELSE 'other' END AS label FROM rec")
def prj6(t, spark):
    return part_records(t).select("p_partkey", first_label(R.text_of("title", "description"), SIZES, "other").alias("label"))


def _listed(n, label):
    return f"CASE WHEN len({n}) > 0 THEN '{label}' || array_to_string({n}, ', ') END"


_lists = {"physical": R.PHYSICAL, "software": R.SOFTWARE, "inspiration": R.INSPIRATION, "risk": R.PHYSICAL_RISK, "prio": R.PHYSICAL_PRIORITY, "mvp": R.SOFTWARE_MVP, "cplx": R.SOFTWARE_COMPLEX}


def opportunity_sql(rec: str, key: str, text: str = PART_TEXT) -> str:
    return f"""WITH {rec},
m AS (SELECT *, {', '.join(f"{sql_flags(text, {p: [p] for p in v})} AS {k}" for k, v in _lists.items())} FROM rec),
k AS (SELECT *, CASE WHEN len(inspiration) > 0 AND lower(source) IN ('yanko_design', 'designboom') THEN 'inspiration' WHEN len(software) > 0 AND len(physical) < 2 THEN 'software'
  WHEN len(physical) >= 2 OR (len(risk) > 0 AND len(software) = 0) THEN 'physical' WHEN len(inspiration) >= 2 THEN 'inspiration' WHEN len(software) > 0 THEN 'software' ELSE 'uncertain' END AS opportunity_type FROM m),
s AS (SELECT *, (CASE opportunity_type WHEN 'physical' THEN greatest(0, least(100, 50 + 8 * len(prio) - 30 * len(risk))) WHEN 'software' THEN greatest(0, least(100, 55 + 8 * len(mvp) - 30 * len(cplx)))
  WHEN 'inspiration' THEN 50 ELSE 40 END)::INT AS filter_score FROM k)
SELECT {key}, opportunity_type, filter_score, CASE WHEN opportunity_type = 'uncertain' THEN 'uncertain' WHEN opportunity_type = 'inspiration' THEN 'candidate'
  WHEN filter_score < 50 OR (opportunity_type = 'physical' AND len(risk) > 0) THEN 'rejected' ELSE 'candidate' END AS filter_status,
  CASE opportunity_type WHEN 'physical' THEN concat_ws('; ', 'type: physical', {_listed('physical', 'signals: ')}, {_listed('prio', 'priority: ')}, {_listed('risk', 'risk: ')})
  WHEN 'software' THEN concat_ws('; ', 'type: software', {_listed('software', 'signals: ')}, {_listed('mvp', 'priority: ')}, {_listed('cplx', 'risk: ')})
  WHEN 'inspiration' THEN 'inspiration signals: ' || array_to_string(inspiration, ', ') ELSE 'insufficient signals to classify as physical, software, or inspiration' END AS filter_reason FROM s"""


#: DuckDB: a part's texts, and what the structure of its record holds beside them.
PART_CONTEXT = """concat_ws(' ', title, description, category, concat_ws(' ', CASE WHEN p_partkey % 3 = 0 THEN 'A compact desk organizer' END, concat_ws(' ', category, CASE WHEN p_partkey % 5 = 0 THEN 'browser extension' END),
  CASE WHEN p_partkey % 7 = 0 THEN 'Bluetooth router' END))"""


def part_raw():
    """JSON of a part's record: a tagline, topics and nested metadata."""
    k = F.col("p_partkey")
    return F.to_json(F.struct(
        F.when(k % 3 == 0, "A compact desk organizer").alias("tagline"), F.array_compact(F.array("category", F.when(k % 5 == 0, "browser extension"))).alias("topics"),
        F.struct(F.col("p_size").alias("size"), F.array(F.struct(F.when(k % 7 == 0, "Bluetooth router").alias("note"))).alias("inner")).alias("metadata")))


@query("rul1_opportunity", opportunity_sql(PART_SQL, "p_partkey", PART_CONTEXT))
def rul1(t, spark):
    """What the record's structure holds is matched beside its texts."""
    rows = part_records(t).withColumn("context", L.context_text(part_raw()))
    return R.opportunity(rows, "context").select("p_partkey", "opportunity_type", "filter_score", "filter_status", "filter_reason")


@query("rul2_opportunity_documents", opportunity_sql(DOC_SQL, "doc_id"))
def rul2(t, spark):
    return R.opportunity(doc_records(t)).select("doc_id", "opportunity_type", "filter_score", "filter_status", "filter_reason")


def demand_sql() -> str:
    each = ", ".join(
        "least(100, " + " + ".join(f"CASE WHEN {sql_any('title || chr(32) || description', [p], 'regex')} THEN {w} ELSE 0 END" for p, w in R.SIGNALS[k]) + f") AS s{i}" for i, k in enumerate(R.SIGNAL_PRIORITY))
    n = len(R.SIGNAL_PRIORITY)
    best = f"greatest({', '.join(f's{i}' for i in range(n))})"
    found = " + ".join(f"(s{i} > 0)::INT" for i in range(n))
    first = " ".join(f"WHEN s{i} = best THEN '{k}'" for i, k in enumerate(R.SIGNAL_PRIORITY))
    return f"""WITH {DOC_SQL}, e AS (SELECT doc_id, {each} FROM rec), b AS (SELECT *, {best} AS best, {found} AS n FROM e),
t AS (SELECT *, CASE WHEN n = 0 THEN 0 ELSE least(100, best + 15 * (n - 1)) END AS total FROM b)
SELECT doc_id, total::INT AS signal_score, CASE WHEN n = 0 THEN 'general_discussion' {first} END AS signal_type,
  CASE WHEN n = 0 THEN 'NOT_DEMAND' WHEN total >= 60 THEN 'HIGH' WHEN total >= 35 THEN 'MEDIUM' ELSE 'LOW' END AS signal_status FROM t"""


@query("rul5_demand_signal", demand_sql())
def rul5(t, spark):
    return R.demand_signal(doc_records(t)).select("doc_id", "signal_score", "signal_type", "signal_status")


@query("rul4_record_role", f"""WITH {PART_SQL} SELECT p_partkey, CASE WHEN source = 'Brand#1' THEN 'product' WHEN source IN ('Brand#2', 'Brand#3') THEN
  CASE WHEN {sql_any('title', ['ring', 'rod'])} THEN 'demand_signal' WHEN {sql_any('title', ['plate', 'bolt'])} THEN 'product' ELSE 'uncertain' END ELSE 'uncertain' END AS role FROM rec""")
def rul4(t, spark):
    """Source-aware routing; the sources and words of the reference's feeds are parameters."""
    return part_records(t).select("p_partkey", record_role("source", F.col("title"), catalogue=["Brand#1"], discussion=["Brand#2", "Brand#3"], needs=["ring", "rod"], objects=["plate", "bolt"]).alias("role"))


def record_role(source, text, catalogue, discussion, needs, objects, kind=None):
    """product, demand_signal, software, inspiration or uncertain, first by source, then by what the text says or else by kind."""
    s = F.col(source)
    kind = F.lit(None).cast("string") if kind is None else kind
    named = F.when(kind == "physical", "product").when(kind.isin("software", "inspiration"), kind).otherwise("uncertain")
    return F.when(s.isin(*catalogue), "product").when(s.isin(*discussion), F.when(any_of(text, needs), "demand_signal").when((kind == "physical") | any_of(text, objects), "product").otherwise("uncertain")).otherwise(named)


_risk = f"(SELECT * FROM (SELECT *, {sql_flags(PART_TEXT, R.RISKS)} AS r0, {sql_flags(PART_TEXT, R.POSITIVE, 'regex')} AS pos, {sql_any(PART_TEXT, R.COMPLEXITY, 'regex')} AS special FROM rec))"


def feasibility_sql(rec: str, key: str) -> str:
    return f"""WITH {rec}, a AS (SELECT *, CASE WHEN list_contains(r0, 'wireless') THEN list_append(r0, 'high_certification_risk') ELSE r0 END AS risks FROM {_risk}),
b AS (SELECT *, len(risks) AS bad, len(pos) AS n, list_contains(pos, 'common_consumer_category') AND len(pos) >= 4 AND NOT special AS easy, least(100, 35 + 8 * len(pos)) AS score FROM a)
SELECT {key}, CASE WHEN bad > 0 THEN 'REJECT' WHEN easy THEN 'PASS' ELSE 'REVIEW' END AS feasibility_status,
  (CASE WHEN bad > 0 THEN greatest(0, 28 - 6 * bad) WHEN easy THEN greatest(70, score) WHEN special THEN least(69, greatest(45, score)) WHEN n > 0 THEN least(69, score) ELSE score END)::INT AS feasibility_score,
  {JOIN('risks')} AS risk_flags, {JOIN('pos')} AS positive_signals FROM b"""


@query("rul7_feasibility", feasibility_sql(DOC_SQL, "doc_id"))
def rul7(t, spark):
    return R.feasibility(doc_records(t)).select("doc_id", "feasibility_status", "feasibility_score", joined("risk_flags"), joined("positive_signals"))


_low = "lower(concat_ws(' ', title, description))"


@query("rul8_commodity", f"""WITH {DOC_SQL}, a AS (SELECT *, {sql_any(_low, R.BULKY, 'part')} AS bulky, {sql_flags(_low, R.MATURE, 'part')} AS m0, {sql_flags(_low, R.INNOVATION, 'part')} AS new FROM rec),
b AS (SELECT *, CASE WHEN len(m0) > 0 THEN list_append(m0, 'highly_mature_category') ELSE m0 END AS old, len(new) AS n, len(list_filter(new, lambda x: x IN ({', '.join(f"'{x}'" for x in R.STRONG)}))) AS strong FROM a),
c AS (SELECT *, least(100, 25 + 20 * strong + 8 * (n - strong)) AS score FROM b)
SELECT doc_id, CASE WHEN bulky THEN 'COMMODITY' WHEN strong >= 1 AND n >= 2 THEN 'PROMISING' WHEN n = 0 AND len(old) > 0 THEN 'COMMODITY' ELSE 'REVIEW' END AS commodity_status,
  (CASE WHEN bulky THEN 10 WHEN strong >= 1 AND n >= 2 THEN greatest(70, score) WHEN n > 0 THEN greatest(40, score) WHEN len(old) > 0 THEN 20 ELSE 35 END)::INT AS commodity_score,
  CASE WHEN bulky THEN 'bulky_shipping,highly_mature_category' ELSE {JOIN('list_concat(old, new)')} END AS commodity_flags FROM c""")
def rul8(t, spark):
    return R.commodity(doc_records(t)).select("doc_id", "commodity_status", "commodity_score", joined("commodity_flags"))


_text = "trim(regexp_replace(lower(concat_ws(' ', title, description)), '\\s+', ' ', 'g'))"


@query("rul11_specificity", f"""WITH {DOC_SQL}, a AS (SELECT doc_id, {_text} AS x, CASE WHEN doc_id % 2 = 0 THEN 'demand_opportunity' ELSE 'validated_product' END AS kind FROM rec),
b AS (SELECT *, {sql_flags('x', R.PRODUCTS, 'part')} AS p, {sql_flags('x', R.BROAD, 'part')} AS broad, {sql_any('x', R.FEATURE, 'part')} AS feature, {sql_any('x', R.REQUIREMENT, 'part')} AS req,
  {sql_any('x', R.IMPROVEMENT, 'part')} AS better0, {sql_any('x', ['made it myself', 'leathercraft', 'diy'], 'part')} AS diy, {sql_any('x', ['too expensive', 'price', 'budget'], 'part')} AS price FROM a),
c AS (SELECT *, len(p) > 0 AS product, feature OR price AS gap, better0 OR diy AS better, len(broad) > 0 AS vague, greatest(0, least(100, 30 * (len(p) > 0)::INT + 20 * (feature OR price)::INT + 20 * (better0 OR diy)::INT + 15 * req::INT
  - least(30, 15 * len(broad)) - 10 * (len(p) > 1 AND NOT (feature OR price))::INT)) AS score FROM b)
SELECT doc_id, CASE WHEN kind <> 'demand_opportunity' THEN CASE WHEN product THEN 'SPECIFIC' ELSE 'REVIEW' END WHEN vague AND NOT (product AND gap) THEN 'TOO_BROAD' WHEN product AND gap AND (better OR req) THEN 'SPECIFIC'
  WHEN (product AND (gap OR req OR better)) OR (NOT product AND req AND better) THEN 'REVIEW' ELSE 'TOO_BROAD' END AS specificity_status,
  (CASE WHEN kind <> 'demand_opportunity' THEN greatest(CASE WHEN product THEN 70 ELSE 45 END, score) WHEN vague AND NOT (product AND gap) THEN least(39, score) WHEN product AND gap AND (better OR req) THEN greatest(65, score)
  WHEN product AND (gap OR req OR better) THEN greatest(40, least(64, score)) WHEN NOT product AND req AND better THEN greatest(40, least(59, score)) ELSE least(39, score) END)::INT AS specificity_score FROM c""")
def rul11(t, spark):
    rows = doc_records(t).withColumn("candidate_type", F.when(F.col("doc_id") % 2 == 0, "demand_opportunity").otherwise("validated_product")).withColumn("signals", F.array().cast("array<string>"))
    return R.specificity(rows).select("doc_id", "specificity_status", "specificity_score")


def creative_sql(key: str) -> str:
    text, low = "lower(concat_ws(' ', title, description)) || ' ' || lower(category)", "lower(category)"
    return f"""b AS (SELECT *, {text} AS x FROM rec),
c AS (SELECT *, {sql_padded('x', R.PHYSICAL_TERMS)} AS phys, {sql_padded('x', R.COMPLEX_TECH)} AS tech, CASE WHEN {sql_padded(low, R.ARCHITECTURE)} OR {sql_padded('lower(title)', R.ARCHITECTURE)} THEN 'architecture'
  WHEN {sql_padded(low, R.VEHICLE)} OR {sql_padded('lower(title)', R.VEHICLE)} THEN 'vehicle' WHEN {sql_padded('x', R.COMPLEX_TECH)} OR {sql_any(low, R.TECH_CATEGORIES, 'part')} THEN 'technology_complex'
  WHEN {sql_padded('x', R.PHYSICAL_TERMS)} AND {sql_any('x', R.CONCEPT_WORDS, 'part')} THEN 'concept_product' WHEN {sql_padded('x', R.PHYSICAL_TERMS)} THEN 'physical_product' ELSE 'other' END AS content_type FROM b),
d AS (SELECT *, content_type IN ('physical_product', 'concept_product') AS product, list_concat(list_filter([CASE WHEN content_type IN ('physical_product', 'concept_product') THEN 'existing_simple_product' END,
  CASE WHEN NOT tech AND {sql_any('x', R.LOW_TECH, 'part')} THEN 'low_tech_modification' END], lambda f: f IS NOT NULL), {sql_flags('x', R.CREATIVE_SIGNALS, 'part')}) AS sig,
  list_filter([CASE content_type WHEN 'architecture' THEN 'architecture' WHEN 'vehicle' THEN 'vehicle' WHEN 'technology_complex' THEN 'complex_electronics' END, CASE WHEN {sql_padded('x', R.LARGE_TERMS)} THEN 'large_or_heavy' END], lambda f: f IS NOT NULL) AS risks FROM c),
e AS (SELECT *, greatest(0, least(100, 42 + {sql_sum('sig', R.CREATIVE_FEASIBILITY)} - 60 * len(risks)))::INT AS feas, least(100, 24 + {sql_sum('sig', R.CREATIVE_MICRO)})::INT AS micro FROM d),
f AS (SELECT *, product AND len(risks) = 0 AND len(sig) >= 2 AND feas >= 60 AND micro >= 45 AS eligible FROM e)"""


@query("rul9_creative", f"WITH {DOC_SQL}, {creative_sql('doc_id')} SELECT doc_id, content_type, {JOIN('sig')} AS creative_signals, {JOIN('risks')} AS creative_risks, feas AS creative_feasibility, micro AS creative_micro, eligible FROM f")
def rul9(t, spark):
    return R.creative(doc_records(t)).select("doc_id", "content_type", joined("creative_signals"), joined("creative_risks"), "creative_feasibility", "creative_micro", "eligible")


@query("scr1_inspirations", f"""WITH {DOC_SQL}, {creative_sql('doc_id')} SELECT substr(sha256('inspiration_product|' || url), 1, 24) AS candidate_id, url AS source_url,
  greatest(0, least(100, round_even(0.45::DOUBLE * feas + 0.40::DOUBLE * micro + 0.15::DOUBLE * 60, 0)))::INT AS candidate_score, feas AS feasibility_score, micro AS micro_innovation_score FROM f WHERE eligible""")
def scr1(t, spark):
    # written, as a filter on what the pack finds would be pushed below it and all of the pack computed twice
    rows = written(R.creative(doc_records(t)).drop("description"), "creative")
    return S.inspirations(rows.withColumn("clarity", F.lit(60))).select("candidate_id", "source_url", "candidate_score", "feasibility_score", "micro_innovation_score")


@query("scr1_trends", f"""WITH {PART_SQL} SELECT substr(sha256('consumer_trend|' || url), 1, 24) AS candidate_id, round_even(0.40::DOUBLE * (p_size * 2 % 101) + 0.35::DOUBLE * (p_partkey % 101) + 0.25::DOUBLE * (p_size % 50), 0)::INT AS candidate_score FROM rec WHERE {sql_any('title', ['ring', 'bolt'])}""")
def scr1_trends(t, spark):
    rows = part_records(t).withColumns({
        "commodity_status": F.when(any_of(F.col("title"), ["ring", "bolt"]), "PROMISING").otherwise("REVIEW"), "feasibility_score": F.col("p_size") * 2 % 101, "market_signal": F.col("p_partkey") % 101, "micro": F.col("p_size") % 50,
        "signals": F.array("title")})
    return S.trends(rows).select("candidate_id", "candidate_score")


_funded, _backers = "o_totalprice / 500", "CASE WHEN o_orderkey % 7 > 0 THEN o_orderkey % 3000 END"


@query("scr2_market_validation", f"""WITH a AS (SELECT o_orderkey, {_backers} AS b, CASE WHEN o_orderkey % 5 > 0 THEN {_funded} END AS f FROM orders),
s AS (SELECT *, CASE WHEN b < 100 THEN 30 WHEN b < 500 THEN 55 WHEN b < 2000 THEN 75 ELSE 90 END AS bs, CASE WHEN f < 100 THEN greatest(0, round_even(f * 0.3::DOUBLE, 0)) WHEN f < 300 THEN 45 + round_even((f - 100) * 0.075::DOUBLE, 0)
  WHEN f < 1000 THEN 60 + round_even((f - 300) * 0.02::DOUBLE, 0) ELSE least(85, 74 + round_even((f - 1000) / 1000, 0)) END AS fs FROM a)
SELECT o_orderkey, (CASE WHEN b IS NULL AND f IS NULL THEN 0 WHEN b IS NULL THEN fs WHEN f IS NULL THEN bs ELSE round_even(0.75::DOUBLE * bs + 0.25::DOUBLE * fs, 0) END)::INT AS market_score FROM s""")
def scr2(t, spark):
    return t("orders").select("o_orderkey", S.market_validation(F.expr(_backers), F.when(F.col("o_orderkey") % 5 > 0, F.expr(_funded))).alias("market_score"))


@query("scr3_rank_score", """WITH g AS (SELECT l_partkey, count(DISTINCT l_suppkey) AS n FROM lineitem GROUP BY l_partkey),
a AS (SELECT p_partkey, p_size, p_brand, p_retailprice, coalesce(n, 0) AS n, (p_partkey % 60) AS age FROM part LEFT JOIN g ON l_partkey = p_partkey)
SELECT p_partkey, (least(30, round_even(p_size * 2 * 0.3::DOUBLE, 0)) + CASE WHEN p_size * 2 >= 80 THEN 16 WHEN p_size * 2 >= 50 THEN 11 ELSE 6 END + least(20, round_even(p_retailprice / 100, 0))
  + CASE WHEN n >= 2 THEN 10 ELSE 0 END + CASE WHEN age <= 7 THEN 5 WHEN age <= 30 THEN 3 ELSE 1 END)::INT AS rank_score FROM a""")
def scr3(t, spark):
    groups = t("lineitem").groupBy("l_partkey").agg(F.count_distinct("l_suppkey").alias("n"))
    rows = t("part").join(groups, F.col("l_partkey") == F.col("p_partkey"), "left").withColumn("n", F.coalesce("n", F.lit(0)))
    demand = F.col("p_size") * 2
    total = (
        F.least(F.lit(30), S.whole(demand * F.lit(0.3))) + S.evidence(F.col("p_brand"), demand, F.lit(0)) + F.least(F.lit(20), S.whole(F.col("p_retailprice") / 100))
        + S.cross_source(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.lit(2), F.col("n")))), lambda i: i.cast("string"))) + S.freshness(F.col("p_partkey") % 60))
    return rows.select("p_partkey", total.cast("int").alias("rank_score"))


@query("scr4_evidence_strength", """WITH a AS (SELECT user_id, sum(value) AS points, count(DISTINCT event_type) AS n FROM events GROUP BY user_id),
r AS (SELECT *, (CASE WHEN points >= 80 THEN 2 WHEN points >= 40 THEN 1 ELSE 0 END) + (n >= 2)::INT AS rank FROM a) SELECT user_id, CASE WHEN rank >= 2 THEN 'STRONG' WHEN rank = 1 THEN 'MODERATE' ELSE 'WEAK' END AS strength FROM r""")
def scr4(t, spark):
    facts = t("events").groupBy("user_id").agg(F.sum("value").alias("points"), F.count_distinct("event_type").alias("n"))
    return facts.select("user_id", S.strength(F.col("points"), F.col("n")).alias("strength"))


@query("scr5_engagement", "SELECT o_orderkey, round(2.0::DOUBLE * ln(1 + greatest(0, o_totalprice)) + 0.5::DOUBLE * ln(1 + greatest(0, (o_custkey % 50)::DOUBLE)), 6) AS engagement FROM orders")
def scr5(t, spark):
    return t("orders").select("o_orderkey", F.round(S.engagement((2.0, F.col("o_totalprice")), (0.5, F.col("o_custkey") % 50)), 6).alias("engagement"))


@query("scr6_title_jaccard", """WITH n AS (SELECT p_brand, p_partkey, string_split(p_name, ' ') AS w FROM part), f AS (SELECT p_brand, arg_min(w, p_partkey) AS w0 FROM n GROUP BY p_brand)
SELECT p_partkey, round(len(list_intersect(w, w0)) / len(list_distinct(list_concat(w, w0)))::DOUBLE, 6) AS similarity FROM n JOIN f USING (p_brand)""")
def scr6(t, spark):
    from feedloom.functions.text import jaccard, tokens

    own = t("part").select("p_brand", "p_partkey", tokens(F.col("p_name"), S.TITLE_STOP).alias("w"))
    first = own.groupBy("p_brand").agg(F.min_by("w", "p_partkey").alias("w0"))
    return own.join(first, "p_brand").select("p_partkey", F.round(jaccard(F.col("w"), F.col("w0")), 6).alias("similarity"))


@query("rul16_quality_gate", """SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN 'not_interested' WHEN toxic IS NULL THEN 'missing_triage' WHEN toxic = 1 THEN 'triage_reject' WHEN quality = 0 THEN 'triage_review' WHEN source IN ('src1', 'src2') THEN 'hard_risk' END AS reason
FROM documents LEFT JOIN labels USING (doc_id)""")
def rul16(t, spark):
    rows = t("documents").join(t("labels"), "doc_id", "left")
    triage = F.when(F.col("toxic") == 1, "REJECT").when(F.col("quality") == 0, "REVIEW").when(F.col("toxic").isNotNull(), "PASS")
    flags = F.array(F.when(F.col("source").isin("src1", "src2"), F.lit("Wireless")).otherwise(F.lit("none")))
    return rows.select("doc_id", S.quality_gate(F.when(F.col("doc_id") % 11 == 0, "NOT_INTERESTED"), triage, flags).alias("reason"))


@query("rul17_title_flags", """WITH t AS (SELECT doc_id, string_split(text, chr(10))[1] AS t FROM documents) SELECT doc_id, array_to_string(list_filter([CASE WHEN length(t) - length(replace(t, ',', '')) >= 2 AND regexp_matches(t, '(?i) and ') THEN 'list' END,
  CASE WHEN len(regexp_extract_all(t, '[^ ]+')) > 12 THEN 'long' END, CASE WHEN regexp_matches(t, '[?!]$') THEN 'mark' END], lambda x: x IS NOT NULL), ',') AS flags FROM t""")
def rul17(t, spark):
    title = F.substring_index("text", "\n", 1)
    return t("documents").select("doc_id", F.array_join(F.array_compact(F.array(
        F.when((F.length(title) - F.length(F.replace(title, F.lit(","), F.lit(""))) >= 2) & title.rlike("(?i) and "), F.lit("list")),
        F.when(F.size(F.array_remove(F.split(title, " "), "")) > 12, F.lit("long")), F.when(title.rlike("[?!]$"), F.lit("mark")))), ",").alias("flags"))


@query("rul20_valid_posts", "SELECT conv_id, turn, length(trim(text)) >= 40 AND NOT regexp_matches(text, '(?i)^\\s*\\[(removed|deleted)\\]') AS is_valid FROM conversations")
def rul20(t, spark):
    return t("conversations").select("conv_id", "turn", ((F.length(F.trim("text")) >= 40) & ~F.col("text").rlike(r"(?i)^\s*\[(removed|deleted)\]")).alias("is_valid"))


@query("rul24_baseline_triage", """SELECT p_partkey, greatest(0, least(10, round_even(p_size / 5.0::DOUBLE, 0)))::INT AS triage_score, CASE WHEN p_type = 'LARGE' THEN 'REJECT' WHEN p_size >= 30 THEN 'PASS' ELSE 'REVIEW' END AS triage_status FROM part""")
def rul24(t, spark):
    return t("part").select("p_partkey", F.greatest(F.lit(0), F.least(F.lit(10), S.whole(F.col("p_size") / 5))).alias("triage_score"), F.when(F.col("p_type") == "LARGE", "REJECT").when(F.col("p_size") >= 30, "PASS").otherwise("REVIEW").alias("triage_status"))


@query("rul25_parse_response", """WITH j AS (SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN '{broken' ELSE '{"status":"' || CASE WHEN toxic = 1 THEN 'REJECT' WHEN quality = 1 THEN 'PASS' ELSE 'MAYBE' END || '","score":' || (doc_id % 14)::VARCHAR || '}' END AS response FROM labels),
p AS (SELECT doc_id, CASE WHEN json_valid(response) THEN response END AS r FROM j), q AS (SELECT doc_id, r->>'$.status' AS s, (r->>'$.score')::INT AS n FROM p)
SELECT doc_id, CASE WHEN s IN ('PASS', 'REVIEW', 'REJECT') THEN s ELSE 'INVALID' END AS status, CASE s WHEN 'PASS' THEN greatest(7, least(10, n)) WHEN 'REJECT' THEN greatest(0, least(3, n)) END AS score FROM q""")
def rul25(t, spark):
    word = F.when(F.col("toxic") == 1, "REJECT").when(F.col("quality") == 1, "PASS").otherwise("MAYBE")
    response = F.when(F.col("doc_id") % 9 == 0, "{broken").otherwise(F.to_json(F.struct(word.alias("status"), (F.col("doc_id") % 14).alias("score"))))
    read = t("labels").select("doc_id", F.from_json(response, "status string, score int").alias("r"))
    s, n = F.col("r.status"), F.col("r.score")
    return read.select("doc_id", F.when(s.isin("PASS", "REVIEW", "REJECT"), s).otherwise("INVALID").alias("status"), F.when(s == "PASS", F.greatest(F.lit(7), F.least(F.lit(10), n))).when(s == "REJECT", F.greatest(F.lit(0), F.least(F.lit(3), n))).alias("score"))


@query("rul27_filters", "SELECT o_orderkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderstatus <> 'F' AND o_orderdate >= TIMESTAMP '1998-01-01' AND o_totalprice > 1000")
def rul27(t, spark):
    return t("orders").where(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH") & (F.col("o_orderstatus") != "F") & (F.col("o_orderdate") >= F.lit("1998-01-01").cast("timestamp_ntz")) & (F.col("o_totalprice") > 1000)).select("o_orderkey")


@query("rul28_published", "SELECT p_partkey, p_name FROM part WHERE p_type IN ('SMALL', 'PROMO') AND p_partkey NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def rul28(t, spark):
    return t("part").where(F.col("p_type").isin("SMALL", "PROMO")).join(t("labels").where("toxic = 1").select(F.col("doc_id").alias("p_partkey")), "p_partkey", "left_anti").select("p_partkey", "p_name")


@query("rul31_voice_kind", """SELECT conv_id, turn, CASE WHEN regexp_matches(lower(text), '(^|[^a-z])(the|and)([^a-z]|$)') THEN 'discussion' WHEN regexp_matches(text, '[?]') THEN 'need' WHEN role = 'user' THEN 'experience' ELSE 'text' END AS kind FROM conversations""")
def rul31(t, spark):
    low = F.lower("text")
    return t("conversations").select("conv_id", "turn", F.when(low.rlike("(^|[^a-z])(the|and)([^a-z]|$)"), "discussion").when(F.col("text").rlike("[?]"), "need").when(F.col("role") == "user", "experience").otherwise("text").alias("kind"))


@query("set1_win1_pool", f"""WITH {PART_SQL}, u AS (SELECT 'a' AS kind, title, p_partkey, p_size AS score FROM rec UNION ALL SELECT 'b', title, p_partkey, (p_retailprice / 40)::INT FROM rec)
SELECT title, kind, p_partkey, score FROM (SELECT *, row_number() OVER (PARTITION BY title ORDER BY score DESC, kind, p_partkey) AS n FROM u) WHERE n = 1""")
def set1(t, spark):
    rec = part_records(t)
    a = rec.select(F.lit("a").alias("kind"), "title", "p_partkey", F.col("p_size").alias("score"))
    b = rec.select(F.lit("b").alias("kind"), "title", "p_partkey", F.rint(F.col("p_retailprice") / 40).cast("int").alias("score"))
    return best_per_key(a.unionByName(b), ["title"], [F.desc("score"), F.col("kind"), F.col("p_partkey")])


@query("set3_risk_overlap", f"WITH {PART_SQL} SELECT p_partkey, title LIKE '%small%' OR title LIKE '%ring%' AS overlaps FROM rec")
def set3(t, spark):
    return part_records(t).select("p_partkey", has(F.split("title", " "), "small", "ring").alias("overlaps"))
