"""Names to families: deterministic keys, so that grouping is a hash shuffle and nothing is compared in pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.functions.text import jaccard
from feedloom.operators.phrases import has

# Words that don't tell names apart, and nouns that families are named by.
STOP = ["a", "an", "and", "for", "the", "with", "without", "of", "to", "in", "on", "my", "new", "best", "review", "compact", "simple", "small", "lightweight", "portable", "everyday", "recycled"]
MATERIALS = ["nylon", "leather", "polyester", "abs", "titanium", "wooden", "wood", "steel", "aluminum", "silicone", "plastic"]
NOUNS = ["backpack", "pouch", "bag", "pillow", "bottle", "tumbler", "wallet", "lamp", "organizer", "opener", "board", "box", "holder", "sleeve", "software", "app", "extension", "dashboard", "agent", "editor"]
PROTECTED = ["camera", "hydration", "tactical", "hiking"]
# End of the fixed values.


def name_tokens(name: Column) -> Column:
    """Distinct singular tokens of a name, without stop words, materials and numbers, in order."""
    found = F.regexp_extract_all(F.lower(name), F.lit("([a-z0-9]+)"), 1)
    told = F.filter(found, lambda t: ~t.isin(*STOP, *MATERIALS) & ~t.rlike("^[0-9]+$"))
    single = F.transform(told, lambda t: F.when(t.endswith("ies") & (F.length(t) > 4), F.concat(F.left(t, F.length(t) - 3), F.lit("y"))).when(t.endswith("s") & (F.length(t) > 4), F.left(t, F.length(t) - 1)).otherwise(t))
    return F.array_distinct(single)


def family(df: DataFrame, name: str, kind: str) -> DataFrame:
    """Adds family_key, family_method and family_score; the key is null for names without a telling token."""
    rows = df.withColumn("__t", name_tokens(F.col(name)))
    t, k = F.col("__t"), F.lower(kind)
    both = lambda a, b: has(t, *a) & has(t, *b)
    size = F.regexp_extract(F.lower(name), r"([0-9]+)\s*[–-]\s*([0-9]+)l", 0)
    sized = F.regexp_replace(F.regexp_replace(size, r"\s", ""), "–", "-")
    use = F.when(has(t, "commuter"), "commuter").when(has(t, "travel"), "travel").otherwise("general")
    guarded = F.coalesce(*[F.when(has(t, q), F.lit(q)) for q in PROTECTED])
    pack = has(t, "backpack")
    noun = F.get(F.filter(t, lambda x: x.isin(*NOUNS)), F.lit(0))
    rest = F.slice(F.filter(t, lambda x: x != noun), 1, 3)
    # Keys, methods and scores of the rules, in their order.
    rules = [
        (pack & (F.lower(name).contains("non-tactical") | (has(t, "non") & has(t, "tactical"))), F.lit("work-backpack-non-tactical"), "protected_product_subtype", 0.95),
        (pack & (size != ""), F.concat(use, F.lit("-backpack-"), sized), "size_and_use_case", 0.96),
        (pack & guarded.isNotNull(), F.concat(F.lit("backpack-"), guarded), "protected_product_subtype", 0.95),
        (pack & has(t, "commuter", "work", "travel"), F.lit("commuter-travel-backpack"), "use_case_alias", 0.88),
        (both(["fanny", "waist"], ["pack", "pouch", "bag"]), F.lit("fanny-waist-pack"), "product_synonym", 0.9),
        (both(["pillow"], ["travel", "backpacking", "camping"]), F.lit("travel-backpacking-pillow"), "use_case_alias", 0.9),
        (both(["bottle"], ["insulated", "vacuum"]), F.lit("insulated-water-bottle"), "product_synonym", 0.92),
        (both(["opener"], ["manual"]), F.lit("manual-can-opener"), "product_synonym", 0.95),
        (noun.isNotNull(), F.concat_ws("-", noun, rest), "blocked_normalized_tokens", 0.9),
        (F.size(t) > 0, F.concat_ws("-", F.slice(t, 1, 4)), "normalized_identity_exact", 1.0),
    ]
    # End of the fixed values.
    key, method, score = (F.lit(None).cast(c) for c in ("string", "string", "double"))
    for condition, k_, m, s in reversed(rules):
        key, method, score = F.when(condition, k_).otherwise(key), F.when(condition, m).otherwise(method), F.when(condition, s).otherwise(score)
    return rows.withColumns({"family_key": F.when(key.isNotNull(), F.concat(k, F.lit(":"), key)), "family_method": method, "family_score": score}).drop("__t")


#: Classes that share a token and are compared in one task at most.
BLOCK = 2_000


def name_classes(names: DataFrame, block: str, name: str, tokens: str) -> DataFrame:
    """(block, class_name, name, w): the names of a block by their set of tokens; the class is called by the smallest of its names. Names without a token are no member of any."""
    sets = names.select(block, name, F.array_sort(F.array_distinct(tokens)).alias("w")).where(F.size("w") > 0)
    first = sets.groupBy(block, "w").agg(F.min(name).alias("class_name"))
    return sets.join(first, [block, "w"]).select(block, "class_name", name, "w")


def similar_classes(classes: DataFrame, block: str, threshold: float, most: int = BLOCK) -> DataFrame:
    """(block, left_class, right_class) of classes of name_classes() whose token sets have a Jaccard of `threshold` or more.

    Names of one class are alike by definition, and names of two classes if the classes are, so no pairs of members are made.
    Tokens are ordered rarest first within the block. Sets that are so similar share one of the first size - ceil(threshold *
    size) + 1 tokens, so only those meet, and only sets whose sizes allow it are compared. A token that more than `most` classes
    share is dealt to several tasks: the left side by salt, the right one to all salts.
    """
    sets = classes.select(block, "class_name", "w").distinct()
    each = sets.select(block, "class_name", F.explode("w").alias("token"))
    counts = each.groupBy(block, "token").agg(F.count(F.lit(1)).alias("n"))
    ordered = each.join(counts, [block, "token"]).groupBy(block, "class_name").agg(F.array_sort(F.collect_list(F.struct("n", "token"))).alias("w"))
    size = F.size("w")
    firsts = ordered.select(block, "class_name", F.transform("w", lambda x: x["token"]).alias("w"), F.explode(F.slice("w", F.lit(1), size - F.ceil(F.lit(threshold) * size - 1e-9).cast("int") + 1)).alias("t"))
    salts = F.ceil(F.col("t.n") / most).cast("int")
    side = lambda salt, s: firsts.select(block, F.col("t.token").alias("token"), salt.alias("salt"), F.col("class_name").alias(f"{s}_class"), F.col("w").alias(s))
    a, b = side(F.pmod(F.xxhash64("class_name"), salts).cast("int"), "left"), side(F.explode(F.sequence(F.lit(0), salts - 1)), "right")
    met = a.join(b, [block, "token", "salt"]).where("left_class < right_class").where(F.least(F.size("left"), F.size("right")) >= threshold * F.greatest(F.size("left"), F.size("right")))
    return met.where(jaccard(F.col("left"), F.col("right")) >= threshold).select(block, "left_class", "right_class").distinct()
