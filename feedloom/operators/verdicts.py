"""Decision tables on analysis records, generated texts and requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.operators.phrases import any_of, flags_in, has, indexed, phrases_of

# Patterns and phrases of the decision tables.
CLAIMS = {
    "confirmed supplier": ["confirmed supplier|supplier (?:is|has been) confirmed"], "low MOQ": ["(?:extremely |very )?low moq"], "exact cost": ["(?:unit|manufacturing|material|purchase) cost (?:is|of|at) [¥$€£]?[0-9]"],
    "guaranteed margin": ["guaranteed margin|margin is guaranteed"], "huge market": ["huge market|massive market|dominat(?:e|es|ed|ing).{0,80}market"], "low competition": ["low competition|competition is low|no competition"],
    "certification confirmed": ["certification (?:is|has been) confirmed"], "patent safe": ["patent safe|no patent risk"], "guaranteed demand": ["guaranteed demand|demand is guaranteed"],
}
NO_GAP = ["insufficiently specific", "no actionable product gap", "no clear product gap", "no specific product gap", "only general advice", "general travel advice", "packing setup rather than"]
NOT_FIT = {
    "large_or_heavy_product": ["refrigerator", "fridge", "large appliance", "large furniture", "washing machine", "freezer"],
    "complex_electronics": ["battery backup", "battery back up", "power station", "electronic cooler", "smart device", "camera", "computer hardware", "jump starter", "car fridge"],
    "high_regulation": ["medical", "medicine", "drug", "supplement", "food product", "cosmetic", "treatment"],
}
TECHNICAL = {
    "technical_footwear_or_apparel": ["technical running shoes?", "trail running shoes?", "performance footwear", "technical jacket", "winter jacket"],
    "complex_outdoor_equipment": ["tents?", "sleeping system", "technical stove", "camping stove"],
    "multi_product_problem": ["optimi[sz]e .{0,20}(?:onebag|one-bag) setup", "packing list", "gear list"],
}
DEMAND_FLAGS = {
    "existing_simple_product": ["bag", "fanny pack", "crossbody", "pouch", "organizer", "organiser", "holder", "stand", "wallet", "backpack", "clip", "storage accessory", "travel accessory", "pet accessory", "desk accessory", "leather journal", "key organi[sz]er"],
    "clear_feature_gap": ["without (?:a )?zipper", "zipper[- ]free", "specific requirements?", "flat and rounded keys", r"flat \+ rounded keys", "laptop organi[sz]ation", "(?:internal )?compartments?", "needs? to (?:fit|hold|carry|work)"],
    "clear_usage_scenario": ["at work", "work backpack", "office", "dog walking", "travel", "daily (?:work|use)", "laptop", "car camping"],
    "clear_size_requirement": [r"\d+(?:\.\d+)?[ -]?(?:l|liters?|inches?|inch|cm|mm)", r"up to \d+", r"\d+[- ]keys?", r"waist (?:strap|band).{0,20}\d+"],
    "clear_price_pain": ["too expensive", "cheaper", "can(?:not|'t) afford", r"under a budget", r"under [$£€]\d+"],
    "low_tech_modification": ["without (?:a )?zipper", "zipper[- ]free", "non[- ]tactical", "not tactical", "not hiking", "flat and rounded keys", "specific dimensions?", "compartments?", "sleeve"],
    "storage_or_organization": ["storage", "organi[sz](?:e|er|ation)", "pockets?", "compartments?", "drawer", "shelf"],
    "portability_problem": ["lightweight", "compact", "portable", "carry", "onebag", "one-bag"],
    "accessibility_problem": ["quick (?:access|reach)", "easy[- ]access", "reach for often", "without (?:a )?zipper", "zipper[- ]free"],
    "appearance_positioning_gap": ["professional", "non[- ]tactical", "not tactical", "doesn(?:'t| not) (?:look|feel) like .{0,20}(?:hiking|tactical)"],
    "DIY_workaround": ["made (?:one|it) (?:myself|personally)", "DIY"],
    "simple_material_change": ["leather", "nylon", "polyester", "fabric", "ABS", "silicone"],
}
# End of the fixed values.

#: Tables that demand_fit() looks up.
OF_DEMAND = tuple((phrases_of(t), "regex") for t in (DEMAND_FLAGS, NOT_FIT, TECHNICAL))


def demand_fit(df: DataFrame, text: Column) -> DataFrame:
    """Adds demand_status (PRODUCTIZABLE, REVIEW, NOT_FIT), demand_fit and demand_flags. If df has the word hits of OF_DEMAND in the text, they are used."""
    tables = (DEMAND_FLAGS, NOT_FIT, TECHNICAL)
    own = [c for c in ("__low", "__hits") if c not in df.columns]
    out = indexed(df, text, *OF_DEMAND)
    found, hard, soft = (flags_in(F.col("__low"), F.col("__hits"), t, "regex") for t in tables)
    out = out.withColumns({"demand_flags": found, "__hard": F.size(hard), "__soft": F.size(soft)})
    f, n = F.col("demand_flags"), F.size("demand_flags")
    score = F.least(F.lit(100), 35 + 9 * n)
    good = has(f, "existing_simple_product") & (n >= 3) & (F.col("__soft") == 0)
    return out.withColumns({
        "demand_status": F.when(F.col("__hard") > 0, "NOT_FIT").when(good, "PRODUCTIZABLE").otherwise("REVIEW"),
        "demand_fit": F.when(F.col("__hard") > 0, F.greatest(F.lit(0), 25 - 5 * F.col("__hard"))).when(good, F.greatest(F.lit(70), score)).otherwise(F.least(F.lit(69), score)),
    }).drop("__hard", "__soft", *own)


def unsupported_claims(text: Column) -> Column:
    """Labels of claims that nothing can back."""
    low = F.lower(text)
    return F.array_compact(F.array(*[F.when(low.rlike(p[0]), F.lit(name)) for name, p in CLAIMS.items()]))


def disposition(text: Column, step: Column, score: Column, regulatory: Column, technical: Column) -> Column:
    """(status, reason) of an analysis, by the first condition that holds."""
    verdict = lambda s, r: F.struct(F.lit(s).alias("status"), F.lit(r).alias("reason"))
    return (
        F.when(F.size(unsupported_claims(text)) > 0, verdict("HUMAN_REVIEW", "unsupported_claim")).when(step == "DROP", verdict("DROP", "deep_drop")).when(score <= 3, verdict("DROP", "low_deep_score")).when(score <= 5, verdict("REVIEW", "deep_review"))
        .when(any_of(text, NO_GAP, "part"), verdict("REVIEW", "insufficient_specificity")).when(regulatory == "HIGH", verdict("REVIEW", "high_regulatory_risk")).when(technical == "HIGH", verdict("REVIEW", "high_engineering_or_manufacturing_barrier"))
        .otherwise(verdict("PASS", "deep_pass")))


def validation_code(text: Column, script: str, banned: list[str], limit: int) -> Column:
    """Why a generated text isn't accepted, null if it is."""
    return F.when(F.coalesce(F.trim(text), F.lit("")) == "", "empty").when(~text.rlike(script), "not_target_script").when(any_of(text, banned, "part"), "banned_term").when(F.length(text) > limit, "too_long")


def within_budget(fields: Column, summary: Column, budget: int) -> Column:
    """Length to which the summary is cut so that all fits the budget: by hundreds, as long as more than 300 are left."""
    return F.aggregate(F.sequence(F.lit(0), F.lit(14)), F.length(summary), lambda n, i: F.when((fields + n > budget) & (n > 300), n - 100).otherwise(n))
