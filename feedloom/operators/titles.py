"""Titles of catalogues, launches and design feeds reduced to names, and trend-list items classed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.operators.phrases import any_of, first_label

# Patterns of catalogue nouns, words that are no brand, design objects, and terms of trend items.
CORE = {
    "manual can opener": "Manual Can Opener", "full length (?:floor )?mirror": "Full Length Mirror", "metal platform bed frame": "Metal Platform Bed Frame", "bathroom rugs?": "Bathroom Rug", "air purifiers?": "Air Purifier",
    "leaf blowers?": "Cordless Leaf Blower", "(?:handheld )?vacuum cleaners?": "Handheld Vacuum Cleaner", "milk frothers?": "Milk Frother", "travel pillows?": "Travel Pillow", "lunch box": "Insulated Lunch Box", "tumblers?": "Insulated Tumbler",
    "power ?banks?": "Power Bank", "tea lights? candles?": "Tea Light Candles", "fruit fly traps?": "Fruit Fly Trap", "canopy tents?": "Canopy Tent", "pillow inserts?": "Pillow Inserts", "overnight oats containers?": "Overnight Oats Containers",
}
NO_BRAND = ["electric", "portable", "flying", "fruit", "gaming", "pro", "refill", "upgraded", "cordless", "handheld"]
DESIGN = {
    "desk lamp": "Desk Lamp", "bedside lamp": "Bedside Lamp", "turntable": "Turntable", "coffee cups?": "Coffee Cups", "serving tray": "Modular Serving Tray", "tripod": "Camera Tripod", "scissors": "Design Scissors", "food recycler": "Food Recycler",
    "litter box": "Self-Cleaning Litter Box"}
TREND_RISKS = {
    "regulated": ["supplement", "medicine", "medical", "food", "pesticide", "repellent"], "complex_electronics": ["bluetooth", "wireless", "battery", "electric", "robot", "charger", "camera"],
    "large_or_heavy": ["bed frame", "mattress", "refrigerator", "gaming chair", "floor mirror"], "software_or_digital": ["software", "digital download", "app subscription"]}
SIMPLE = ["organizer", "storage", "basket", "container", "pouch", "bag", "rack", "holder", "brush", "towel", "mat", "cover", "hook", "tray", "bottle", "notebook", "toy", "leash", "collar", "tool", "shelf", "curtain"]
THEMES = {
    "storage_and_organization": ["organizer", "storage", "basket", "container", "rack", "holder", "shelf"], "bags_and_carry": ["bag", "pouch", "backpack", "tote"], "pet_accessories": ["pet", "dog", "cat", "leash", "collar"],
    "desk_and_office": ["desk", "office", "notebook", "pen"], "outdoor_accessories": ["outdoor", "camping", "garden"], "tools_and_edc": ["tool", "hook", "flashlight"], "home_and_living": ["home", "kitchen", "bath", "towel", "mat", "curtain"]}
# End of the fixed values.


def catalogue_name(title: Column) -> Column:
    """Brand words before the first known noun, and the noun; without one the first segment of the title."""
    out = F.left(F.get(F.split(title, r"(?i)\s*[|;]\s*|,\s*(?:Pack of|Black|White|Grey|Gray|Blue|Red)\b"), F.lit(0)), F.lit(100))
    for pattern, core in reversed(CORE.items()):
        before = F.regexp_replace(F.get(F.split(title, f"(?i){pattern}"), F.lit(0)), r"^[ \-|,:/]+|[ \-|,:/]+$", "")
        out = F.when(title.rlike(f"(?i){pattern}"), F.trim(F.concat_ws(" ", _brand(before), F.lit(core)))).otherwise(out)
    return out


def _brand(prefix: Column) -> Column:
    """Leading words (four at most) that look like a brand: the first, then capitals or inner capitals; null if there is none."""
    words = F.slice(F.array_remove(F.split(prefix, r"\s+"), ""), 1, 4)
    start = F.struct(F.lit("").alias("name"), F.lit(True).alias("open"))

    def step(acc: Column, word: Column) -> Column:
        clean = F.regexp_replace(word, "[^A-Za-z0-9]", "")
        bad = (clean == "") | F.lower(clean).isin(*NO_BRAND) | clean.rlike("[0-9]")
        fits = clean.rlike("^[A-Z]+$") | clean.rlike("[a-z][A-Z]") | (acc["name"] == "")
        go = acc["open"] & ~bad & fits
        return F.struct(F.when(go, F.trim(F.concat(acc["name"], F.lit(" "), word))).otherwise(acc["name"]).alias("name"), go.alias("open"))

    return F.nullif(F.aggregate(words, start, step, lambda a: a["name"]), F.lit(""))


def launch_name(title: Column, prefix: str = "show hn:") -> Column:
    """The launch title without its prefix, first-person phrase and tail after a dash; null if less than two characters are left."""
    bare = F.regexp_replace(F.trim(F.regexp_replace(title, f"(?i)^{prefix}\\s*", "")), r"(?i)^(?:i|we) (?:built|made|launched|created)\s+", "")
    name = F.trim(F.get(F.split(bare, r"\s+[—–-]\s+|:\s+(?=[A-Z])"), F.lit(0)))
    return F.when(F.length(name) >= 2, F.left(name, F.lit(100)))


def design_name(title: Column) -> Column:
    out = F.lit(None).cast("string")
    for pattern, name in reversed(DESIGN.items()):
        out = F.when(title.rlike(f"(?i){pattern}"), name).otherwise(out)
    return out


def market_signal(new: Column, rank: Column, change: Column, rating: Column, reviews: Column) -> Column:
    """Points of a trend-list item; 100 at most."""
    return F.least(F.lit(100), F.when(new, 45).otherwise(50) + F.when(rank <= 10, 25).when(rank <= 30, 18).when(rank.isNotNull(), 10).otherwise(0) + F.when(change.isNotNull(), 10).otherwise(0)
                   + F.when(rating >= 4, 5).otherwise(0) + F.when(reviews >= 200, 10).when(reviews >= 20, 5).otherwise(0))


def trend_item(df: DataFrame) -> DataFrame:
    """Adds trend_class, trend_status, trend_theme and trend_score to records (title, category)."""
    text = F.lower(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("category", F.lit(""))))
    risk = first_label(text, TREND_RISKS)
    simple = any_of(text, SIMPLE, "part")
    return df.withColumns({
        "trend_class": F.coalesce(risk, F.when(simple, "simple_physical").otherwise("other")), "trend_status": F.when(risk.isNotNull(), "rejected").when(simple, "candidate").otherwise("uncertain"),
        "trend_theme": F.when(risk.isNotNull(), "other").otherwise(first_label(text, THEMES, "other")), "trend_score": F.when(risk.isNotNull(), 20).when(simple, 70).otherwise(45)})
