"""Rule packs over records (title, description, category, source): each adds a status, a score and flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.operators.phrases import alone, any_of, clamp, flags_in, has, indexed, padded, phrases_of, spaced, tested, weights

# Phrase lists, patterns, weights and thresholds of the packs.
PHYSICAL = [
    "organizer", "holder", "case", "clip", "mount", "stand", "bag", "pouch", "rack", "hook", "bottle", "container", "EDC", "tool", "camping gear", "travel accessory", "desk accessory", "storage accessory", "physical tool",
    "DIY accessory",
]
PHYSICAL_PRIORITY = ["small", "compact", "lightweight", "simple", "portable", "low cost", "easy to carry", "EDC", "travel", "camping", "desk", "organizer", "storage", "simple tool", "DIY accessory"]
PHYSICAL_RISK = ["food", "supplement", "medicine", "medical", "cosmetic", "cream", "serum", "drug", "bluetooth", "wireless", "router", "complex electronics", "certification required"]
SOFTWARE = ["browser", "dashboard", "AI agent", "Git", "API", "SaaS", "analytics", "extension", "automation", "editor", "workspace", "web app", "software", "app", "plugin", "UI", "design system", "productivity tool", "ElevenLabs"]
SOFTWARE_MVP = [
    "web tool", "app", "Chrome extension", "browser extension", "productivity tool", "marketing tool", "content tool", "AI wrapper", "automation", "analytics", "dashboard", "plugin", "no-code", "AI agent", "AI agents",
    "editor", "UI",
]
SOFTWARE_COMPLEX = [
    "enterprise SaaS", "enterprise platform", "AI infrastructure", "model training", "database infrastructure", "cybersecurity infrastructure", "financial infrastructure", "banking platform", "developer infrastructure",
    "distributed system", "large engineering team",
]
INSPIRATION = ["concept design", "design concept", "concept product", "industrial design", "experimental design"]
DESIGN_SOURCES = ("yanko_design", "designboom")

RISKS = {
    "weapon_or_blade": ["knife", "blade", "axe", "weapon", "sword", "firearm"],
    "complex_electronics": [
    "camera", "smartphone", "computer", "keyboard", "power bank", "battery system", "robot", "PCB", "drone", "smart electronic device", "complex circuit", "multi-sensor", "AI hardware", "AI tracking",
    "precision electronics", "dock", "docking station", "SSD", "storage drive", "charger", "charging hub", "battery hub", "computer hardware", "Thunderbolt", "USB high-speed controller", "20Gbps", "SSD storage",
    "battery management", "fast charging electronics", "battery health check",
],
    "wireless": ["Bluetooth", "Wi-Fi", "WiFi", "2.4G", "cellular", "radio transmission", "wireless"],
    "high_regulation": ["food", "supplement", "oral", "cosmetic", "cream", "serum", "medical", "medicine", "treatment", "therapeutic", "drug"],
    "large_or_heavy": ["large furniture", "full-size furniture", "treadmill", "large fitness equipment", "heavy machinery", "large appliance", "industrial machine"],
    "high_engineering_barrier": ["complex mechanical engineering", "precision optics", "high precision electronics", "custom complex mold", "complex proprietary tooling", "hardware-software co-design", "complex software and hardware", "robotics platform"],
}
POSITIVE = {
    "simple_structure": ["simple", "simple structure", "basic construction"],
    "non_electronic": ["non[- ]electronic", "non[- ]electric", "no electricity"],
    "small_or_compact": ["small", "compact", "mini", "portable", r"(?:[1-9]|1\d|20)[ -]?L"],
    "lightweight": ["lightweight", "ultra[- ]light"],
    "common_material": ["polyester", "nylon", "recycled nylon", "ABS", "PP", "silicone", "PU leather", "leather", "simple steel", "aluminum", "fabric", "paper", "wood"],
    "simple_sewn_product": ["pouch", "travel pouch", "bag", "backpack", "simple wallet"],
    "simple_plastic_product": ["ABS", "PP", "plastic", "silicone"],
    "simple_metal_product": ["aluminum", "simple steel", "sheet metal"],
    "simple_assembly": ["simple assembly", "easy to assemble"],
    "common_consumer_category": [
        "organizer", "organiser", "key organizer", "key organiser", "cable organizer", "pouch", "bag", "backpack", "simple wallet", "holder", "stand", "simple rack", "simple clip", "simple hook",
        "stationery accessory", "desk accessory", "simple storage product", "pet accessory", "simple home accessory", "simple cleaning accessory", "simple non[- ]electric kitchen accessory", "craft accessory", "hobby accessory"],
    "easy_shipping": ["easy shipping", "easy to ship", "flat pack"],
    "low_breakage_risk": ["shatterproof", "unbreakable", "low breakage risk"],
}
COMPLEXITY = [
    "titanium", "carbon fiber", "precision CNC", "aerospace grade", "high precision machining", "patented material", "special mechanism", "multifunction(?:al)?", r"\d+[- ](?:in[- ]1|features?)", "modular paintbox",
    "passive cool(?:er|ing)"]

MATURE = {
    "generic_bath_mat": ["bath mat", "bathroom rug"], "generic_drinkware": ["tumbler", "water bottle", "cup"], "generic_lunch_box": ["lunch box", "lunch bag"], "generic_kitchen_tool": ["can opener"],
    "generic_container": ["mason jar", "oats container", "food container"], "generic_storage": ["storage box", "storage bin", "organizer tray"], "generic_bag": ["basic bag", "tote bag"], "generic_home_accessory": ["home decor accessory"],
}
BULKY = ["10x10", "large shelter", "oversized item", "large furniture"]
INNOVATION = {
    "modular_design": ["modular", "interchangeable module"], "foldable": ["foldable", "collapsible"], "space_saving": ["space-saving", "space saving"],
    "opening_mechanism": ["flip lid", "built-in straw", "zipper-free", "one-touch opening"], "portable_design": ["portable", "packable"], "specific_user_segment": ["for seniors", "for children", "one-handed users"],
    "material_change": ["recycled nylon", "plant-based material"], "multi_function": ["multifunctional", "multi-functional", "2-in-1", "3-in-1"], "size_innovation": ["ultra compact", "extra slim", "adjustable size"],
    "storage_innovation": ["stackable system", "portion system", "modular storage"], "cleaning_improvement": ["self-cleaning", "removable washable liner"], "accessibility_improvement": ["one-handed", "easy grip"],
    "ergonomic_improvement": ["oversized knob", "ergonomic handle", "comfortable handle"], "structural_innovation": ["transformable", "patented structure"], "specific_use_case": ["cupholder compatible", "overnight oats"],
}
STRONG = ["modular_design", "foldable", "space_saving", "structural_innovation", "accessibility_improvement", "ergonomic_improvement", "storage_innovation"]

SIGNALS = {
    "purchase_intent": [("looking for", 45), ("looking to buy", 50), ("i (?:want|need) (?:a|an|something)", 35)],
    "product_gap": [("can(?:not|'t) find", 45), ("does anyone make", 45), ("is there (?:a|an)", 30), ("(?:works?|needs? to work) with", 25)],
    "price_pain": [("too expensive", 50), ("cheaper", 30), ("can(?:not|'t) afford", 50)],
    "feature_request": [("holds? up to", 25), ("(?:ideally|must|should|needs? to)", 20), ("i want something that", 40), ("problem with", 30)],
    "usage_problem": [("doesn(?:'t| not) work", 40), ("issue with", 35), ("struggle with", 35)],
    "recommendation_request": [("suggestions?", 40), ("recommend(?:ation|ations|ed)?", 40), ("what should i get", 45), ("anyone know", 35), ("considering adding", 35)],
    "DIY_workaround": [("made (?:one|it) (?:myself|personally)", 50), ("made it myself", 50), ("DIY", 25), ("my own solution", 40)],
}
SIGNAL_PRIORITY = ["price_pain", "DIY_workaround", "product_gap", "purchase_intent", "recommendation_request", "feature_request", "usage_problem"]

PRODUCTS = {
    "fanny_pack": ["fanny pack", "waist pack"], "key_organizer": ["key organiser", "key organizer", "key holder"], "journal": ["journal", "notebook"], "camping_pillow": ["backpacking pillow", "camping pillow", "travel pillow"],
    "manual_can_opener": ["manual can opener", "can opener"], "wallet": ["wallet"], "organizer": ["organizer", "organiser"], "backpack": ["backpack", "rucksack"], "duffle": ["duffle", "duffel"], "sleeping_bag": ["sleeping bag"],
    "water_bottle": ["water bottle", "waterbottle"], "pocket_clip": ["pocket clip"], "pouch": ["pouch"], "packing_cube": ["packing cube"], "lamp": ["desk lamp", "lamp"],
}
FEATURE = ["without zipper", "no zipper", "specific requirements", "too expensive", "must be stored compressed", "different key", "flat key", "rounded key", "side sleeper", "doesn't slide", "does not slide", "hard to", "difficult", "too heavy", "too bulky", "not enough", "problem", "pain point"]
REQUIREMENT = ["up to ", "at least ", "under ", "over ", " litre", " liter", "l or above", "compact", "lightweight", "specific", "size", "material", "capacity", "for airplane", "for work", "side sleeper", "compressed"]
IMPROVEMENT = ["without", "alternative", "improve", "better", "opening", "closure", "storage", "layout", "ergonomic", "portable", "attachment", "organize", "organise", "made it myself", "diy", "non-slip", "strap"]
BROAD = {
    "packing_advice": ["packing and bag advice", "packing advice"], "trip_planning": ["trip coming up", "trip planning", "what to pack"], "unspecified_edc_request": ["adding an edc item", "taking suggestions"],
    "setup_optimization": ["optimize my setup", "rate my setup"], "gear_list_review": ["gear list", "packing list review"], "general_recommendation": ["recommend me something", "what should i buy"],
}
DISPLAY_FLAG = {
    "clear_feature_gap": "explicit_feature_request", "clear_size_requirement": "explicit_size_requirement", "clear_usage_scenario": "explicit_usage_scenario", "storage_or_organization": "explicit_storage_requirement",
    "portability_problem": "explicit_portability_problem", "accessibility_problem": "explicit_feature_request", "appearance_positioning_gap": "explicit_appearance_gap", "simple_material_change": "explicit_material_requirement",
    "low_tech_modification": "clear_improvement_direction", "existing_simple_product": "clear_existing_product",
}

ARCHITECTURE = ["architecture", "architect", "building", "interior", "pavilion", "residence", "house", "cabin", "tower", "hotel", "museum", "gallery"]
VEHICLE = ["automotive", "vehicle", "car", "motorcycle", "scooter", "camper", "trailer", "aircraft", "yacht"]
COMPLEX_TECH = ["robot", "robotics", "smartphone", "laptop", "computer", "processor", "artificial intelligence", "3d printer", "vr", "virtual reality", "wireless earbuds", "bluetooth", "battery", "electric vehicle"]
PHYSICAL_TERMS = [
    "product design", "furniture", "lighting", "lamp", "backpack", "bag", "organizer", "organiser", "storage", "bottle", "wallet", "pouch", "accessory", "accessories", "tool", "stationery", "kitchen", "home", "fashion",
    "toy", "toys", "chair", "container", "holder", "case", "packaging",
]
LARGE_TERMS = ["armchair", "sofa", "couch", "dining table", "wardrobe", "cabinet", "large furniture", "appliance", "refrigerator", "trailer"]
TECH_CATEGORIES = ["technology", "wearable", "audio", "gaming", "gadgets", "robotics", "appliances"]
CONCEPT_WORDS = ["concept", "conceptual", "prototype", "imagines", "lego ideas"]
LOW_TECH = ["simple", "manual", "non-electronic", "low-tech", "mechanical"]
CREATIVE_SIGNALS = {
    "storage_or_organization": ["storage", "organizer", "organiser", "pocket", "compartment"], "portability_problem": ["portable", "carry", "travel", "packable", "backpack", "bag"],
    "simple_material_change": ["material", "fabric", "leather", "wood", "plastic", "metal", "recycled"], "compact_design": ["compact", "small", "mini", "foldable", "pocket-size"], "modular_design": ["modular", "module", "interchangeable"],
    "multi_use_design": ["multi-use", "multifunction", "multi-function", "2-in-1", "3-in-1"], "space_saving": ["space-saving", "space saving", "folds flat", "collapsible"],
    "accessibility_improvement": ["easy access", "accessible", "one-handed", "cord problem"], "everyday_use": ["everyday", "daily", "desk", "home", "work", "travel"], "simple_mechanical_design": ["hinge", "clip", "buckle", "mechanical", "manual"],
}
CREATIVE_FEASIBILITY = {
    "existing_simple_product": 10, "low_tech_modification": 10, "storage_or_organization": 7, "portability_problem": 7, "simple_material_change": 6, "compact_design": 8, "modular_design": 5, "multi_use_design": 5, "space_saving": 7,
    "accessibility_improvement": 6, "everyday_use": 7, "simple_mechanical_design": 7}
CREATIVE_MICRO = {
    "existing_simple_product": 5, "low_tech_modification": 13, "storage_or_organization": 10, "portability_problem": 8, "simple_material_change": 10, "compact_design": 10, "modular_design": 13, "multi_use_design": 12, "space_saving": 12,
    "accessibility_improvement": 12, "everyday_use": 6, "simple_mechanical_design": 12}
# End of the fixed values.

#: Lists that opportunity() counts, and terms that creative() looks for.
LISTS = {"physical": PHYSICAL, "software": SOFTWARE, "inspiration": INSPIRATION, "risk": PHYSICAL_RISK, "priority": PHYSICAL_PRIORITY, "mvp": SOFTWARE_MVP, "complex": SOFTWARE_COMPLEX}
CREATIVE_TERMS = (PHYSICAL_TERMS, COMPLEX_TECH, LARGE_TERMS, ARCHITECTURE, VEHICLE)
POINTS = {p: w for rules in SIGNALS.values() for p, w in rules}

#: Tables that the packs look up in title, description and category.
OF_WHOLE = (
    (phrases_of(RISKS), "word"), (phrases_of(POSITIVE), "regex"), (COMPLEXITY, "regex"), (phrases_of(LISTS), "word"), (tuple(POINTS), "regex"), (sorted({t for terms in CREATIVE_TERMS for t in alone(terms)}), "word"))


def with_index(df: DataFrame, *tables) -> DataFrame:
    """Records with the word hits of OF_WHOLE and further tables in title, description and category; several packs then share them."""
    return indexed(df, text_of("title", "description", "category"), *OF_WHOLE, *tables)


def without_index(df: DataFrame) -> DataFrame:
    return df.drop("__low", "__hits")


def _own(df: DataFrame) -> list[str]:
    """The index columns that a pack added itself and takes away again."""
    return [c for c in ("__low", "__hits") if c not in df.columns]


def text_of(*names: str) -> Column:
    """The columns, nulls as empty, with a space between them."""
    return F.concat_ws(" ", *[F.coalesce(F.col(n), F.lit("")) for n in names])


def _listed(label: str, found: Column) -> Column:
    return F.when(F.size(found) > 0, F.concat(F.lit(label), F.array_join(found, ", ")))


def opportunity(df: DataFrame, context: str | None = None) -> DataFrame:
    """Adds opportunity_type, filter_status, filter_score and filter_reason (rules by counts of matched phrases).

    `context` is a column of further text that a record's structure holds (tagline, topics, metadata); it is matched too.
    """
    text = text_of("title", "description", "category", *([context] if context else []))
    # columns of their own: fields of a struct would be put in place, and computed, wherever they are named
    phrases = list(dict.fromkeys(phrases_of(LISTS)))
    shared = context is None and "__hits" in df.columns
    m = df if shared else indexed(df, text, (phrases, "word"), prefix="__o")
    low, hits = ("__low", "__hits") if shared else ("__o_low", "__o_hits")
    m = m.withColumn("__found", flags_in(F.col(low), F.col(hits), {p: (p,) for p in phrases}))
    m = m.withColumns({f"__m_{k}": F.array_intersect(F.array(*map(F.lit, v)), "__found") for k, v in LISTS.items()})
    n = {k: F.size(f"__m_{k}") for k in LISTS}
    kind = (
        F.when((n["inspiration"] > 0) & F.lower("source").isin(*DESIGN_SOURCES), "inspiration").when((n["software"] > 0) & (n["physical"] < 2), "software")
        .when((n["physical"] >= 2) | ((n["risk"] > 0) & (n["software"] == 0)), "physical").when(n["inspiration"] >= 2, "inspiration").when(n["software"] > 0, "software").otherwise("uncertain"))
    hard, soft = clamp(50 + 8 * n["priority"] - 30 * n["risk"]), clamp(55 + 8 * n["mvp"] - 30 * n["complex"])
    k = F.col("opportunity_type")
    score = F.when(k == "physical", hard).when(k == "software", soft).when(k == "inspiration", 50).otherwise(40)
    parts = lambda own, good, bad: F.concat_ws("; ", F.concat(F.lit("type: "), k), _listed("signals: ", F.col(f"__m_{own}")), _listed("priority: ", F.col(f"__m_{good}")), _listed("risk: ", F.col(f"__m_{bad}")))
    reason = (
        F.when(k == "physical", parts("physical", "priority", "risk")).when(k == "software", parts("software", "mvp", "complex")).when(k == "inspiration", F.concat(F.lit("inspiration signals: "), F.array_join("__m_inspiration", ", ")))
        .otherwise("insufficient signals to classify as physical, software, or inspiration"))
    out = m.withColumn("opportunity_type", kind).withColumn("filter_score", score)
    status = F.when(k == "uncertain", "uncertain").when(k == "inspiration", "candidate").when((F.col("filter_score") < 50) | ((k == "physical") & (n["risk"] > 0)), "rejected").otherwise("candidate")
    return out.withColumn("filter_status", status).withColumn("filter_reason", reason).drop("__o_low", "__o_hits", "__found", *[f"__m_{k}" for k in LISTS])


def feasibility(df: DataFrame) -> DataFrame:
    """Adds feasibility_status (PASS, REVIEW, REJECT), feasibility_score, risk_flags and positive_signals."""
    risks = F.col("__risks")
    out = with_index(df)
    low, hits = F.col("__low"), F.col("__hits")
    out = out.withColumns({"__risks": flags_in(low, hits, RISKS), "positive_signals": flags_in(low, hits, POSITIVE, "regex"), "__special": tested(low, hits, COMPLEXITY, "regex")})
    out = out.withColumn("risk_flags", F.when(has(risks, "wireless"), F.array_append(risks, "high_certification_risk")).otherwise(risks))
    n, bad, special = F.size("positive_signals"), F.size("risk_flags"), F.col("__special")
    score = F.least(F.lit(100), 35 + 8 * n)
    easy = has(F.col("positive_signals"), "common_consumer_category") & (n >= 4) & ~special
    return out.withColumns({
        "feasibility_status": F.when(bad > 0, "REJECT").when(easy, "PASS").otherwise("REVIEW"),
        "feasibility_score": F.when(bad > 0, F.greatest(F.lit(0), 28 - 6 * bad)).when(easy, F.greatest(F.lit(70), score)).when(special, F.least(F.lit(69), F.greatest(F.lit(45), score))).when(n > 0, F.least(F.lit(69), score)).otherwise(score),
    }).drop("__risks", "__special", *_own(df))


def commodity(df: DataFrame) -> DataFrame:
    """Adds commodity_status (PROMISING, REVIEW, COMMODITY), commodity_score and commodity_flags."""
    bulky, mature = F.col("__bulky"), F.col("__mature")
    out = indexed(df, text_of("title", "description"), prefix="__c")
    low, hits = F.col("__c_low"), F.col("__c_hits")
    out = out.withColumns({"__bulky": tested(low, hits, BULKY, "part"), "__mature": flags_in(low, hits, MATURE, "part"), "__new": flags_in(low, hits, INNOVATION, "part")})
    out = out.withColumn("__old", F.when(F.size(mature) > 0, F.array_append(mature, "highly_mature_category")).otherwise(mature))
    n = F.size("__new")
    strong = F.size(F.array_intersect("__new", F.array(*map(F.lit, STRONG))))
    score = F.least(F.lit(100), 25 + 20 * strong + 8 * (n - strong))
    best = (strong >= 1) & (n >= 2)
    old = F.size("__old") > 0
    return out.withColumns({
        "commodity_status": F.when(bulky, "COMMODITY").when(best, "PROMISING").when((n == 0) & old, "COMMODITY").otherwise("REVIEW"),
        "commodity_score": F.when(bulky, 10).when(best, F.greatest(F.lit(70), score)).when(n > 0, F.greatest(F.lit(40), score)).when(old, 20).otherwise(35),
        "commodity_flags": F.when(bulky, F.array(F.lit("bulky_shipping"), F.lit("highly_mature_category"))).otherwise(F.array_union("__old", "__new")),
    }).drop("__new", "__old", "__bulky", "__mature", "__c_low", "__c_hits")


def demand_signal(df: DataFrame) -> DataFrame:
    """Adds signal_status (HIGH, MEDIUM, LOW, NOT_DEMAND), signal_score and signal_type."""
    if "__hits" in df.columns:
        # the shared text without the category; its word hits are a few more, and regular expressions are only tried behind them
        without = F.length("__low") - F.length(F.lower(F.coalesce("category", F.lit("")))) - 1
        seen = df.withColumn("__d_low", F.left("__low", without)).withColumn("__d_hits", F.col("__hits"))
    else:
        seen = indexed(df, text_of("title", "description"), (POINTS, "regex"), prefix="__d")
    seen = seen.withColumn("__found", flags_in(F.col("__d_low"), F.col("__d_hits"), {p: [p] for p in POINTS}, "regex"))
    each = {kind: F.least(F.lit(100), weights(F.array_intersect("__found", F.array(*[F.lit(p) for p, _ in rules])), dict(rules))) for kind, rules in SIGNALS.items()}
    scored = seen.withColumn("__s", F.array(*[F.struct(each[k].alias("score"), F.lit(-i).alias("rank"), F.lit(k).alias("kind")) for i, k in enumerate(SIGNAL_PRIORITY)])).drop("__found", "__d_hits", "__d_low")
    found = F.filter("__s", lambda s: s["score"] > 0)
    best = F.array_max("__s")
    total = F.least(F.lit(100), best["score"] + 15 * (F.size(found) - 1))
    none = F.size(found) == 0
    return scored.withColumns({
        "signal_score": F.when(none, 0).otherwise(total), "signal_type": F.when(none, "general_discussion").otherwise(best["kind"]),
        "signal_status": F.when(none, "NOT_DEMAND").when(total >= 60, "HIGH").when(total >= 35, "MEDIUM").otherwise("LOW"),
    }).drop("__s")


def specificity(df: DataFrame, signals: str = "signals") -> DataFrame:
    """Adds specificity_status (SPECIFIC, REVIEW, TOO_BROAD), specificity_score and specificity_flags; needs candidate_type and an array of signals."""
    out = indexed(df, F.trim(F.regexp_replace(text_of("title", "description"), r"\s+", " ")), prefix="__s")
    text, hits = F.col("__s_low"), F.col("__s_hits")
    one = lambda condition, name: F.when(condition, F.array(F.lit(name))).otherwise(F.array().cast("array<string>"))
    renamed = F.create_map(*[F.lit(x) for item in DISPLAY_FLAG.items() for x in item])
    products, broad = flags_in(text, hits, PRODUCTS, "part"), flags_in(text, hits, BROAD, "part")
    all_flags = F.array_distinct(F.concat(
        one(F.size(products) > 0, "explicit_product_type"), one(F.size(products) > 1, "multiple_product_families"),
        F.array_sort(F.array_distinct(F.array_compact(F.transform(F.coalesce(F.col(signals), F.array().cast("array<string>")), lambda s: renamed[s])))),
        one(tested(text, hits, FEATURE, "part"), "explicit_feature_request"), one(tested(text, hits, REQUIREMENT, "part"), "explicit_requirement"), one(tested(text, hits, IMPROVEMENT, "part"), "clear_improvement_direction"),
        one(tested(text, hits, ["made it myself", "leathercraft", "diy"], "part"), "DIY_workaround"), one(tested(text, hits, ["too expensive", "price", "budget"], "part"), "explicit_price_pain"), broad))
    out = out.withColumn("specificity_flags", all_flags).withColumn("__broad", F.size(broad))
    f = F.col("specificity_flags")
    product, gap = has(f, "explicit_product_type"), has(f, "explicit_feature_request", "explicit_price_pain")
    better = has(f, "clear_improvement_direction", "DIY_workaround")
    needs = F.exists(f, lambda x: x.startswith("explicit_") & ~x.isin("explicit_product_type", "explicit_feature_request", "explicit_price_pain"))
    i = lambda c: c.cast("int")
    score = clamp(30 * i(product) + 20 * i(gap) + 20 * i(better) + 15 * i(needs) + 10 * i(has(f, "explicit_usage_scenario")) + 5 * i(has(f, "clear_existing_product"))
                  - F.least(F.lit(30), 15 * F.col("__broad")) - 10 * i(has(f, "multiple_product_families") & ~gap))
    demand, vague = F.col("candidate_type") == "demand_opportunity", (F.col("__broad") > 0) & ~(product & gap)
    exact, some, other = product & gap & (better | needs), product & (gap | needs | better), ~product & needs & better
    low = F.least(F.lit(39), score)
    return out.withColumns({
        "specificity_status": F.when(~demand & product, "SPECIFIC").when(~demand, "REVIEW").when(vague, "TOO_BROAD").when(exact, "SPECIFIC").when(some | other, "REVIEW").otherwise("TOO_BROAD"),
        "specificity_score": F.when(~demand & product, F.greatest(F.lit(70), score)).when(~demand, F.greatest(F.lit(45), score)).when(vague, low).when(exact, F.greatest(F.lit(65), score))
        .when(some, clamp(score, 40, 64)).when(other, clamp(score, 40, 59)).otherwise(low),
    }).drop("__broad", "__s_low", "__s_hits")


def creative(df: DataFrame) -> DataFrame:
    """Adds content_type, creative_signals, creative_risks, creative_feasibility, creative_micro and eligible."""
    title, category = F.lower(F.coalesce("title", F.lit(""))), F.lower(F.coalesce("category", F.lit("")))
    out = with_index(df)
    text, hits = F.col("__low"), F.col("__hits")
    words = {"__words": text, "__title_words": title, "__category_words": category}
    out = out.withColumns({k: spaced(c, *CREATIVE_TERMS, hits=hits if k == "__words" else None) for k, c in words.items()})
    of = lambda column, terms: padded(words[column], terms, F.col(column))
    out = out.withColumns({"__physical": of("__words", PHYSICAL_TERMS), "__tech": of("__words", COMPLEX_TECH)})
    physical, tech = F.col("__physical"), F.col("__tech")
    kind = (
        F.when(of("__category_words", ARCHITECTURE) | of("__title_words", ARCHITECTURE), "architecture").when(of("__category_words", VEHICLE) | of("__title_words", VEHICLE), "vehicle")
        .when(tech | any_of(category, TECH_CATEGORIES, "part"), "technology_complex").when(physical & tested(text, hits, CONCEPT_WORDS, "part"), "concept_product").when(physical, "physical_product").otherwise("other"))
    out = out.withColumn("content_type", kind)
    k = F.col("content_type")
    product = k.isin("physical_product", "concept_product")
    head = F.array_compact(F.array(F.when(product, F.lit("existing_simple_product")), F.when(~tech & tested(text, hits, LOW_TECH, "part"), F.lit("low_tech_modification"))))
    risks = F.array_compact(F.array(
        F.when(k == "architecture", F.lit("architecture")), F.when(k == "vehicle", F.lit("vehicle")), F.when(k == "technology_complex", F.lit("complex_electronics")), F.when(of("__words", LARGE_TERMS), F.lit("large_or_heavy"))))
    out = out.withColumn("creative_signals", F.concat(head, flags_in(text, hits, CREATIVE_SIGNALS, "part"))).withColumn("creative_risks", risks)
    out = out.withColumn("creative_feasibility", clamp(42 + weights(F.col("creative_signals"), CREATIVE_FEASIBILITY) - 60 * F.size("creative_risks")))
    out = out.withColumn("creative_micro", F.least(F.lit(100), 24 + weights(F.col("creative_signals"), CREATIVE_MICRO)))
    return out.withColumn("eligible", product & (F.size("creative_risks") == 0) & (F.size("creative_signals") >= 2) & (F.col("creative_feasibility") >= 60) & (F.col("creative_micro") >= 45)).drop("__physical", "__tech", *words, *_own(df))
