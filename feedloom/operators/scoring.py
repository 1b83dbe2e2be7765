"""Candidate builders and scores. Rounding is half to even, on doubles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.functions.text import key_of
from feedloom.operators.phrases import clamp, weights

# Weights of the builders.
DEMAND_MICRO = {
    "existing_simple_product": 10, "clear_feature_gap": 12, "clear_size_requirement": 8, "clear_usage_scenario": 6, "clear_price_pain": 8, "appearance_positioning_gap": 10, "accessibility_problem": 10,
    "storage_or_organization": 5, "portability_problem": 5, "DIY_workaround": 12, "simple_material_change": 5, "low_tech_modification": 12}
VALIDATED_MICRO = {
    "simple_structure": 15, "non_electronic": 12, "small_or_compact": 8, "lightweight": 6, "common_material": 8, "simple_sewn_product": 10, "simple_plastic_product": 10, "simple_metal_product": 8, "simple_assembly": 12,
    "common_consumer_category": 12, "easy_shipping": 8, "low_breakage_risk": 6}
CLARITY = ("clear_feature_gap", "clear_size_requirement", "clear_usage_scenario", "clear_price_pain")
HARD_RISKS = ("weapon", "weapon_or_blade", "regulated", "high_regulation", "complex_electronics", "wireless", "large_or_heavy", "bulky_shipping")
TITLE_STOP = ("the", "a", "for", "and", "of", "to")
SIMILAR_TITLES = 0.65


def whole(x: Column) -> Column:
    return F.rint(x).cast("int")


def blend(**parts: tuple[float, Column]) -> Column:
    """Rounded weighted sum, in the order given."""
    total = None
    for w, c in parts.values():
        term = F.lit(float(w)) * c
        total = term if total is None else total + term
    return whole(total)


def market_validation(backers: Column, funded: Column) -> Column:
    """Steps by backers and a broken line by percent funded; one of them alone counts whole, none counts 0."""
    b = F.when(backers < 100, 30).when(backers < 500, 55).when(backers < 2000, 75).otherwise(90)
    f = (
        F.when(funded < 100, F.greatest(F.lit(0), whole(funded * 0.3))).when(funded < 300, 45 + whole((funded - 100) * 0.075)).when(funded < 1000, 60 + whole((funded - 300) * 0.02))
        .otherwise(F.least(F.lit(85), 74 + whole((funded - 1000) / 1000))))
    return F.when(backers.isNull() & funded.isNull(), 0).when(backers.isNull(), f).when(funded.isNull(), b).otherwise(whole(F.lit(0.75) * b + F.lit(0.25) * f))


def _candidates(df: DataFrame, kind: str, score: Column, feasible: Column, demand: Column, market: Column, micro: Column, signals: Column) -> DataFrame:
    return df.select(
        key_of(F.lit(kind), F.col("url"), length=24).alias("candidate_id"), F.lit(kind).alias("candidate_type"), F.col("url").alias("source_url"), F.col("title"), clamp(score).alias("candidate_score"),
        feasible.cast("int").alias("feasibility_score"), demand.cast("int").alias("demand_score"), market.cast("int").alias("market_validation_score"), micro.cast("int").alias("micro_innovation_score"), signals.alias("signals"))


def inspirations(df: DataFrame) -> DataFrame:
    """Candidates from eligible creative content (needs the creative pack's columns and clarity)."""
    ok = df.where("eligible")
    score = blend(a=(0.45, F.col("creative_feasibility")), b=(0.40, F.col("creative_micro")), c=(0.15, F.col("clarity")))
    return _candidates(ok, "inspiration_product", score, F.col("creative_feasibility"), F.lit(0), F.lit(0), F.col("creative_micro"), F.col("creative_signals"))


def demands(df: DataFrame) -> DataFrame:
    """Candidates from productizable demand (needs demand_status, demand_fit, signal_score, signal_type, demand_flags)."""
    ok = df.where("demand_status = 'PRODUCTIZABLE'")
    flags = F.array_distinct("demand_flags")
    clear = F.size(F.array_intersect(flags, F.array(*map(F.lit, CLARITY))))
    demand = F.least(F.lit(100), F.greatest(F.lit(0), F.col("signal_score")) + 4 * clear + F.when(F.col("signal_type") == "purchase_intent", 5).otherwise(0))
    micro, fit = F.least(F.lit(100), 26 + weights(flags, DEMAND_MICRO)), clamp(F.col("demand_fit"))
    return _candidates(ok, "demand_opportunity", blend(a=(0.35, demand), b=(0.35, fit), c=(0.30, micro)), fit, demand, F.lit(0), micro, flags)


def validated(df: DataFrame) -> DataFrame:
    """Candidates from products that passed the feasibility pack (needs backers and funded too)."""
    ok = df.where("feasibility_status = 'PASS'")
    signals, fit = F.array_distinct("positive_signals"), clamp(F.col("feasibility_score"))
    market, micro = market_validation(F.col("backers"), F.col("funded")), F.least(F.lit(100), 20 + weights(F.array_distinct("positive_signals"), VALIDATED_MICRO))
    return _candidates(ok, "validated_product", blend(a=(0.40, fit), b=(0.35, market), c=(0.25, micro)), fit, F.lit(0), market, micro, signals)


def trends(df: DataFrame) -> DataFrame:
    """Candidates from promising trend items (needs commodity_status, feasibility_score, market_signal, micro, signals)."""
    ok = df.where("commodity_status = 'PROMISING'")
    score = blend(a=(0.40, F.col("feasibility_score")), b=(0.35, F.col("market_signal")), c=(0.25, F.col("micro")))
    return _candidates(ok, "consumer_trend", score, clamp(F.col("feasibility_score")), F.lit(0), clamp(F.col("market_signal")), clamp(F.col("micro")), F.array_distinct("signals"))


def freshness(age: Column) -> Column:
    return F.when(age <= 7, 5).when(age <= 30, 3).otherwise(1)


def evidence(source: Column, demand: Column, market: Column) -> Column:
    s = F.lower(source)
    step = lambda x, hi, mid, a, b, c: F.when(x >= hi, a).when(x >= mid, b).otherwise(c)
    return (
        F.when(s.contains("reddit"), step(demand, 80, 60, 18, 13, 7)).when(s.contains("kickstarter"), step(market, 80, 50, 19, 14, 8)).when(s.contains("yanko"), 6).when(s.contains("product_hunt"), 7)
        .otherwise(step(F.greatest(demand, market), 80, 50, 16, 11, 6)))


def cross_source(sources: Column) -> Column:
    """Points for independent sources of one group; a design feed among them halves the bonus."""
    return F.when(F.size(sources) < 2, 0).when(F.exists(sources, lambda s: F.lower(s).contains("yanko")), 5).otherwise(10)


def engagement(*weighted: tuple[float, Column]) -> Column:
    total = F.lit(0.0)
    for w, c in weighted:
        total = total + F.lit(float(w)) * F.log1p(F.greatest(F.lit(0.0), F.coalesce(c.cast("double"), F.lit(0.0))))
    return total


def quality_gate(status: Column, triage: Column, flags: Column) -> Column:
    """First reason to hold a candidate back, null if there is none."""
    risky = F.exists(flags, lambda f: F.lower(f).isin(*HARD_RISKS))
    return F.when(status == "NOT_INTERESTED", "not_interested").when(triage.isNull(), "missing_triage").when(triage == "REJECT", "triage_reject").when(triage == "REVIEW", "triage_review").when(risky, "hard_risk")


def strength(points: Column, sources: Column) -> Column:
    """WEAK, MODERATE or STRONG; two independent sources lift it by one step."""
    rank = F.when(points >= 80, 2).when(points >= 40, 1).otherwise(0) + F.when(sources >= 2, 1).otherwise(0)
    return F.when(rank >= 2, "STRONG").when(rank == 1, "MODERATE").otherwise("WEAK")
