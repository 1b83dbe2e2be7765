"""Ladders of ordered rules by source: whether a record is a product, whether it is one object, and what its name is.

Texts are lower-cased once; what several rules ask for is computed once a row. All of it is row-local: no rule needs a shuffle.
Records have title, description, category and source; nulls count as empty. Reasons are free text for a reader: nothing
compares them, and statuses and types alone decide.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.functions.text import collapse
from feedloom.operators.phrases import first_words, gated, word_hits
from feedloom.operators.titles import catalogue_name, design_name, launch_name

# Patterns, hints and name tables of the ladders (patterns match lower-cased text).
NON_PRODUCT = [
    r"\bshort film\b", r"\bfeature film\b", r"\bfilm festival\b", r"\bdance film\b", r"\bhorror film\b", r"\bmovie\b", r"\bmusic album\b", r"\blive album\b", r"\bart exhibition\b", r"\bdonation(?:s)? only\b",
    r"\bsupport (?:our|my|the) (?:film|festival|album|event)\b", r"\b(?:concert|music|band|fall|summer|winter|north american|european) tour 20\d{2}\b",
]
FILM = r"\bfilm\b"
EDITORIAL = [r"^\d+\s+(?:best|top)\b", r"\broundup\b", r"\bnews\b", r"\bfilm festival support\b"]
ROUNDUP = [r"^\d+\s+", r"\bbest of\b", r"\broundup\b", r"\bgift guide\b", r"\bthings we love\b", r"\bproducts? to (?:buy|know|love)\b"]
SERVICE = [r"\bdigital download\b", r"\bprintable\b", r"\btemplate\b", r"\bsvg (?:file|bundle)\b", r"\bservice\b", r"\bconsultation\b"]
PHYSICAL_HINTS = [
    "bag", "backpack", "pouch", "organizer", "holder", "bottle", "tumbler", "lamp", "pillow", "wallet", "opener", "board", "box", "tool", "chair", "table", "sleeve", "cover", "case", "rack", "container", "keychain", "charger",
    "adapter", "shoe", "hanger", "toothbrush", "headphone", "battery", "keyboard", "vacuum", "fan", "thermometer", "watch", "camera", "printer", "mower", "kettle", "scissors", "mirror", "rug", "tent", "cable",
]
SOFTWARE_HINTS = ["software", "app", "api", "dashboard", "browser", "extension", "saas", "automation", "editor", "workspace", "agent", "analytics", "macos"]
LAUNCH_TALK = [r"\b(?:thoughts?|discussion|essay|news)\s+(?:about|on)\b", r"^show hn:\s*(?:i asked\b|what\b|the load-bearing vocabulary\b)", r"^show hn:\s*app design\b"]
LAUNCH_SEVERAL = r",\s*[^,]+\s+and\s+[^,]+$"
LAUNCH_HARDWARE = [r"\b(?:pcb|mcu|microcontroller|hardware device)\b"]
LAUNCH_SOFTWARE = [r"\b(?:tool|platform|client|server|database|library|search engine|website|local-first|open-source|i built|we built|launch)\b"]
DESIGN_OTHER = [r"\b(?:architecture|interior tour|house|residence|exhibition|interview)\b"]
CAMPAIGN_CATEGORIES = ["product design", "design", "gadgets", "technology", "hardware"]
ONE_NEED = [r"seeking advice.*garbage bags?", r"advice.*cot.*tent", r"(?:duffle|duffel).*(?:backpack).*(?:40l|40 l)", r"bifl.*comfortable.*(?:tennis )?shoes?"]
NO_OBJECT = [
    r"\btrip report\b", r"\bitinerary\b", r"\b\d+\s*(?:day|week)s?\s+in\b", r"\bwhat do you (?:use|carry|recommend)\b", r"\bif you could redesign\b", r"\blong-time lurker\b", r"\bcustomer service\b", r"\bpacking list\b",
    r"\bgeneral (?:travel )?advice\b", r"\bweekend packing\b", r"\bseeking advi[cs]e\b", r"^remaining gear advice\b", r"\bpacking and bag advice\b", r"^help me optimize.*\b(?:setup|packing)\b",
    r"^(?:carry today|today'?s edc|on my own .*carry|night walk bag dump|monday)$", r"\b(?:adding|add) an edc item\b", r"^what backpack would you recommend(?: for me)?\??$", r"^save space by leaving headphones behind\??$",
    r"\b(?:comparison|compared?|tested).*\b\d+\b.*\b(?:products?|pillows?|bags?|items?)\b", r"\b(?:comparison|compared?|tested).*\b(?:two|three|four|five|six|seven|eight|nine|ten)\b.*\b(?:products?|pillows?|bags?|items?)\b",
    r"^what (?:apps?|tools?|software) do you (?:all )?use\??$", r"^(?:best|favorite) (?:productivity )?(?:apps?|tools?|software)\??$", r"^what was something .*productivity app.*(?:couldn.t|could not) find\??$",
    r"^what made you stop using .*app", r"^experimenting (?:with )?productivity tools?\??$", r"^which .*apps? (?:have|do|are)\b", r"^any .*apps? that .*\b(?:/| and )\b", r"^any .*?(?:app|apps|list|notes).*\s/\s.*",
    r"^would you use an app\b", r"^anyone else struggle\b", r"^my traveling app project$", r"^be careful when creating\b", r"^i built my first real app.*(?:what i learned|where it stands)",
    r"^i built (?:a )?simple tool.*(?:feedback|in a day)", r"^answering your problems$", r"wondering if anybody knew of a good (?:app|ai)", r"\b(?:throwing|returns?)\s+(?:http )?(?:4\d\d|5\d\d)\b|\bseems broken\b",
    r"\b(?:keeps?|keep) failing\b", r"\bversions?, installation options? and privacy/security\b", r"\bnew project megathread\b", r"^how do you juggle different aspects of planning\??$", r"^do you use an? habit app\b",
    r"^if you could open one screen .*what would you want\b",
]
LOADOUT = [r"\bmy edc\b|\bedc loadout\b"]
LISTICLE = [r"^\d+\s+(?:best|top)\b", r"best gadgets"]
VAGUE_TITLES = ["my", "my edc", "this", "help", "question"]
COVER = r"(?i)\b((?:pocket\s+)?(?:leather\s+)?(?:journal|notebook)\s+cover)\b"
TAGLINES = {
    r"sales agents?": "AI Sales Agent", r"file manager|finder should be": "macOS File Manager", r"usage limits?": "Usage Limit Monitor", r"meeting agents?": "Meeting Agent API", r"transcription": "Transcription App",
    r"observability": "Observability Platform", r"highlight and summarize": "Browser Research Extension", r"internal tools?": "Internal Tools Platform", r"ai models?": "On-Device AI Runtime", r"evals?|agent failures?": "AI Evaluation Tool",
    r"coding agent|codebase|dependencies": "Developer Tool", r"billing|processor": "Billing Platform", r"automations?": "Automation Tool", r"cms content": "CMS Tool", r"company data|signals api": "Company Data API",
    r"screen-sharing|onboarding": "User Onboarding Tool", r"photos?.*search|search photos": "Photo Search App", r"map": "Map App", r"agentic ide|designers and programmers": "Agentic IDE", r"agent team.*creation": "Creative AI Workspace",
    r"remote control.*agents?|agents?.*browser": "Agent Remote Control", r"shared workspace.*agents?|internal ai agents": "AI Agent Workspace", r"search and act.*work apps": "Workplace Search Tool",
    r"local project.*address": "Local Dev Routing Tool", r"dating|social.*network": "Social Networking App", r"composing.*sound": "Music Creation App", r"prototypes?.*feedback": "Prototype Feedback Tool", r"wardrobe": "Wardrobe App",
    r"whatsapp": "WhatsApp Assistant", r"family.*health|health.*one place": "Family Health App",
}
CRAFTS = {
    r"(?:leather\s+)?(?:travel\s+)?wallet.*passport|passport holder.*wallet": "Leather Passport Travel Wallet", r"desk organi[sz]er": "Desk Organizer", r"travel (?:cable )?organi[sz]er": "Travel Cable Organizer",
    r"pet treat pouch": "Pet Treat Pouch", r"kitchen utensil holder": "Kitchen Utensil Holder", r"storage basket": "Storage Basket", r"notebook cover": "Notebook Cover",
}
LAUNCHES = {
    r"^i missed the moving blocks, so i built a real linux disk defragmenter$": "Linux Disk Defragmenter", r"^drop a sql schema, get an interactive er diagram$": "Interactive SQL ER Diagram Tool",
    r"^my startup-idea scanner scored .*": "Startup Idea Scanner", r"^prove your code produced your claims.*": "Code Claim Verification Tool",
}
NEEDS_IN_CONTEXT = {
    r"winkbed luxury firm.*(?:mattress|bed)|(?:mattress|bed).*winkbed luxury firm": "WinkBed Luxury Firm Mattress", r"polywood.*(?:rocking chair|rocker)|(?:rocking chair|rocker).*polywood": "POLYWOOD Outdoor Rocking Chair",
    r"otterbox.*(?:defender).*(?:case|series|iphone)|otterbox.*(?:phone|pixel|iphone).*case|(?:phone|pixel|iphone).*case.*otterbox": "OtterBox Phone Case", r"kelty.*(?:tent|fiberglass pole)|(?:tent|fiberglass pole).*kelty": "Kelty Tent",
}
NEEDS = {
    r"key organi[sz]er": "Key Organizer", r"(?:fanny|waist) (?:pack|pouch).*(?:without|no) zipper|without zipper.*(?:fanny|waist)": "Zipperless Fanny Pack / Waist Pack", r"(?:fanny|waist) (?:pack|pouch)": "Fanny Pack / Waist Pack",
    r"20\s*[–-]\s*25l.*(?:commuter|everyday|work)|(?:commuter|everyday|work).*20\s*[–-]\s*25l": "20–25L Commuter Backpack", r"40\s*[–-]\s*45l.*travel backpack": "40–45L Travel Backpack", r"toiletry kit": "Toiletry Kit",
    r"insulated water bottle": "Insulated Water Bottle", r"(?:backpacking|travel) pillows?": "Travel / Backpacking Pillow", r"wooden cutting board": "Wooden Cutting Board", r"travel wallets?": "Travel Wallet", r"travel adapter": "Travel Adapter",
    r"matador 24l adventure pack": "Matador 24L Adventure Pack", r"laptop/travel bag|laptop.*travel bag": "Laptop / Travel Bag", r"hiking.*travel.*(?:bag|backpack)": "Hiking / Travel Backpack",
    r"messenger/travel bag|messenger.*travel bag": "Expandable Messenger / Travel Bag", r"sling recommendations?": "Sling Bag", r"essentials pouch": "EDC Essentials Pouch", r"oakley spark max.*backpack": "Oakley Spark Max Backpack",
    r"osprey nebula 32l": "Osprey Nebula 32L Backpack", r"all around shoe": "All-Around Shoe", r"headphones?": "Travel Headphones", r"work backpack.*(?:hiking|tactical)|backpack.*doesn.t feel.*(?:hiking|tactical)": "Non-Tactical Work Backpack",
    r"dragonfly ultra|36l dragonfly": "Dragonfly Ultra 36L Backpack", r"seeking advice.*garbage bags?|garbage bags?": "Garbage Bags", r"advice.*cot.*tent|tent.*cot": "Camping Tent Cot",
    r"(?:duffle|duffel).*(?:backpack).*(?:40l|40 l)|(?:40l|40 l).*(?:duffle|duffel|backpack)": "40L+ Convertible Duffel Backpack", r"bifl.*comfortable.*(?:tennis )?shoes?|comfortable.*(?:tennis )?shoes": "Durable Comfortable Men's Tennis Shoes",
    r"local[- ]first expense tracker": "Local-First Expense Tracker", r"browser extension.*block.*shorts|block.*shorts.*browser extension": "Shorts-Blocking Browser Extension", r"self[- ]hosted alternative to notion": "Self-Hosted Workspace / Knowledge App",
    r"app.*organi[sz]e screenshots?|organi[sz]e screenshots?.*app": "Screenshot Organizer App", r"(?:tiny )?tool.*cleaning csv|clean(?:ing)? csv.*tool": "CSV Cleaning Tool", r"app blocker|screen time app": "Screen-Time App Blocker",
    r"note\s*taking app": "Note-Taking App", r"to-do.*widget|widget.*to-do": "Widget-Editable To-Do App", r"habit track(?:ing|er).*(?:app)?": "Habit Tracking App",
    r"note taking app.*multiple systems|multiple systems.*note taking": "Cross-Platform Note-Taking App", r"digital stick(?:y)? notes?|digital notice board": "Digital Sticky Notes App", r"chores app": "Household Chores App",
    r"saving articles?.*highlight|highlight.*articles?": "Read-Later Highlighting App", r"trade journal.*stock app|stock app.*trade journal": "Stock Trade Journal App", r"whiteboard app.*shape.*another whiteboard": "Nested Whiteboard App",
    r"ai video choose-your-own-adventure": "AI Interactive Video App", r"wheel of the year widget": "Wheel of the Year Widget", r"ai app for couples": "Couples AI App", r"app that reminds me.*call my mom": "Relationship Reminder App",
    r"watch/read list order tracker": "Watch / Read List Tracker", r"local minecraft server manager": "Self-Hosted Minecraft Server Manager", r"taskodoro": "Taskodoro Task Management App", r"perfect to-do/task list": "Personal To-Do List App",
    r"blocking yt shorts": "Shorts-Blocking App", r"^mindspark:": "MindSpark Mind-Mapping App", r"^c-shop\b": "C-Shop Image Editor", r"^testing files generator\b": "Testing Files Generator", r"^puls:": "PULS Linux System Monitoring Tool",
    r"\bvectoria\b.*document exploration workspace": "Vectoria Document Exploration Workspace", r"^justforms\b": "JustForms PDF Form Editor",
}
NEEDS_ZH = {
    "WinkBed Luxury Firm Mattress": "WinkBed Luxury Firm 床垫", "POLYWOOD Outdoor Rocking Chair": "POLYWOOD 户外摇椅", "OtterBox Phone Case": "OtterBox 手机壳", "Kelty Tent": "Kelty 帐篷", "Key Organizer": "钥匙收纳器",
    "Zipperless Fanny Pack / Waist Pack": "无拉链腰包",
}
COVER_NAME, COVER_ZH = "Pocket Leather Journal Cover", "口袋皮革笔记本套"
CRAFT_TAIL = r"(?i)\s*[|/]\s*|,\s*(?:gift|personalized|custom|handmade)\b"
# End of the fixed values.

def either(patterns: Sequence[str]) -> str:
    return "|".join(patterns)


def hinted(hints: Sequence[str]) -> str:
    return rf"\b(?:{'|'.join(hints)})s?\b"


def found(text: Column, patterns: Sequence[str], hits: Column | None = None) -> Column:
    """Whether a lower-cased text holds one of the patterns; with its word hits, most texts are told by those."""
    return F.coalesce(text.rlike(either(patterns)), F.lit(False)) if hits is None else gated(text, hits, patterns)


def n_hints(text: Column, hints: Sequence[str], hits: Column | None = None) -> Column:
    """How many different hints occur. With the text's word hits, single words are counted there; the text is searched only where a hint of several words may begin."""
    one = rf"\b({'|'.join(hints)})s?\b"
    seen = F.size(F.array_distinct(F.regexp_extract_all(text, F.lit(one), 1)))
    if hits is None:
        return seen
    single = [h for h in hints if re.fullmatch(r"\w+", h)]
    forms = sorted(first_words(rf"\b(?:{'|'.join(single)})s?\b"))
    bare = F.transform(F.filter(hits, lambda w: w.isin(*forms)), lambda w: F.when(w.isin(*single), w).otherwise(F.substring(w, F.lit(1), F.length(w) - 1)))
    counted = F.size(F.array_distinct(bare))
    longer = {w for h in hints if h not in single for w in first_words(rf"\b(?:{h})s?\b")}
    return F.when(F.arrays_overlap(hits, F.array(*map(F.lit, sorted(longer)))), seen).otherwise(counted) if longer else counted


def table_name(text: Column, names: dict[str, str]) -> Column:
    """The name of the first pattern that the lower-cased text matches, else null."""
    each = [F.when(text.rlike(p), F.lit(n)) for p, n in names.items()]
    # one look tells most texts that nothing matches
    return F.when(gated(text, None, list(names)), F.coalesce(*each))


def decided(rules: Sequence[tuple[Column, Sequence]], otherwise: Sequence) -> list[Column]:
    """For each place of the outcomes a column: that of the first rule whose condition holds."""
    return [_chain(rules, i, o) for i, o in enumerate(otherwise)]


def _chain(rules: Sequence[tuple[Column, Sequence]], i: int, otherwise) -> Column:
    as_column = lambda v: v if isinstance(v, Column) else F.lit(v).cast("string")
    out = as_column(otherwise)
    for condition, outcome in reversed(rules):
        out = F.when(condition, as_column(outcome[i])).otherwise(out)
    return out


#: What the ladders look up in title, description and category.
OF_TEXTS = ([hinted(PHYSICAL_HINTS), hinted(SOFTWARE_HINTS), FILM, *NON_PRODUCT, *SERVICE, *LAUNCH_TALK, *LAUNCH_HARDWARE, *LAUNCH_SOFTWARE, *DESIGN_OTHER], "pattern")
#: Columns of with_texts().
TEXTS = ("__l_title", "__l_body", "__l_hits", "__l_line", "__l_need")


def with_texts(df: DataFrame) -> DataFrame:
    """Records with what several ladders ask of title and description, computed once for all of them: both in lower case, their word hits, and, of forum posts and vague titles, the description on one line; of forum posts the product they need.

    Columns that stand there already are taken as they are.
    """
    if TEXTS[0] in df.columns:
        return df
    low = lambda c: F.lower(F.coalesce(F.col(c), F.lit("")))
    title, body, line = F.col("__l_title"), F.col("__l_body"), F.col("__l_line")
    forum = low("source").contains("reddit")
    rows = df.withColumns({"__l_title": low("title"), "__l_body": low("description")})
    rows = rows.withColumns({"__l_hits": word_hits(F.concat_ws(" ", title, body), OF_TEXTS), "__l_line": F.when(forum | collapse(title).isin(*VAGUE_TITLES), collapse(body))})
    return rows.withColumn("__l_need", F.when(forum, need_name(collapse(title), line)))


def _own(df: DataFrame) -> list[str]:
    """The columns of with_texts() that a ladder added itself and takes away again."""
    return [c for c in TEXTS if c not in df.columns]


def named(df: DataFrame) -> DataFrame:
    """Records after all three ladders, which share their texts."""
    return identity(concrete(eligibility(with_texts(df)))).drop(*TEXTS)


def eligibility(df: DataFrame, is_digital: str = "is_digital", link: str = "external_url") -> DataFrame:
    """Adds content_type, eligibility_status (ELIGIBLE, INELIGIBLE, AMBIGUOUS) and eligibility_reason, by ordered rules of the source.

    `is_digital` (boolean) and `link` are columns of listings and launches; null counts as false and empty.
    """
    category = F.lower(F.coalesce("category", F.lit("")))
    rows = with_texts(df)
    rows = rows.withColumns({"__text": F.concat_ws(" ", "__l_title", "__l_body", category), "__title": F.col("__l_title"), "__source": F.lower(F.coalesce("source", F.lit("")))})
    text, title, source, hits = F.col("__text"), F.col("__title"), F.col("__source"), F.col("__hits")
    # columns of their own: fields of a struct would be put in place, and computed, wherever they are named
    rows = rows.withColumn("__hits", F.concat("__l_hits", word_hits(category, OF_TEXTS)))
    rows = rows.withColumns({"__physical": found(text, [hinted(PHYSICAL_HINTS)], hits), "__software": found(text, [hinted(SOFTWARE_HINTS)], hits)})
    physical, software = F.col("__physical"), F.col("__software")
    named, of = physical | software, source.isin
    launch, design = source == "hacker_news", of("yanko_design", "design_milk")
    no, yes, open_ = "INELIGIBLE", "ELIGIBLE", "AMBIGUOUS"
    other = "NON_PRODUCT_CONTENT"
    linked = F.coalesce(F.col(link).rlike("^https?://"), F.lit(False))
    rules = [
        (found(text, NON_PRODUCT, hits) & ~((source == "yanko_design") & named), (other, no, "film, event, album or donation")),
        (of("indiegogo", "kickstarter") & found(text, [FILM], hits) & ~named, (other, no, "campaign for a film")),
        (found(title, EDITORIAL) & ~named, (other, no, "editorial or news")),
        (source == "product_hunt", ("SOFTWARE_PRODUCT", yes, "software unless shown otherwise")),
        ((source == "etsy") & (F.coalesce(F.col(is_digital), F.lit(False)) | found(text, SERVICE, hits)), (other, no, "download or service")),
        (source == "etsy", ("PHYSICAL_PRODUCT", yes, "active listing")),
        (launch & ~title.startswith("show hn:"), (other, no, "not a launch")),
        (launch & found(text, LAUNCH_TALK, hits), (other, no, "discussion or essay")),
        (launch & found(title, [LAUNCH_SEVERAL]), (other, no, "several products in the title")),
        (launch & found(text, LAUNCH_HARDWARE, hits), ("PHYSICAL_PRODUCT", yes, "hardware launch")),
        (launch & (software | found(text, LAUNCH_SOFTWARE, hits) | linked), ("SOFTWARE_PRODUCT", yes, "software launch")),
        (launch, (open_, open_, "launch without a product that can be told")),
        (source == "amazon", ("PHYSICAL_PRODUCT", yes, "catalogue product")),
        (design & found(title, ROUNDUP), (other, no, "roundup of several products")),
        (design & found(text, DESIGN_OTHER, hits) & ~physical, (other, no, "architecture, tour, exhibition or interview")),
        (design & physical, ("PRODUCT_DESIGN", yes, "design object")),
        (design, (open_, open_, "design article without one object")),
        (source == "reddit_software", ("SOFTWARE_PRODUCT", yes, "software or a need of it")),
        (software, ("SOFTWARE_PRODUCT", yes, "software")),
        (physical | (source.contains("reddit") & (text.contains("leather journal") | text.contains("dragonfly ultra"))), ("PHYSICAL_PRODUCT", yes, "physical product")),
        ((source == "kickstarter") & F.lower("category").isin(*CAMPAIGN_CATEGORIES), ("PHYSICAL_PRODUCT", yes, "campaign category")),
    ]
    content, status, reason = decided(rules, (open_, open_, "nothing tells what it is"))
    return rows.withColumns({"content_type": content, "eligibility_status": status, "eligibility_reason": reason}).drop("__text", "__title", "__source", "__hits", "__physical", "__software", *_own(df))


def need_name(title: Column, description: Column) -> Column:
    """Name of the product that a discussion is about: by title and text, then by title alone; null if no rule matches."""
    context = F.concat_ws(" ", title, description)
    return F.coalesce(table_name(context, NEEDS_IN_CONTEXT), table_name(title, NEEDS))


def concrete(df: DataFrame) -> DataFrame:
    """Adds concrete_status (CONCRETE, NON_CONCRETE, AMBIGUOUS) and concrete_reason to records with eligibility_status."""
    rows = with_texts(df).withColumns({"__title": collapse(F.col("__l_title")), "__source": F.lower(F.coalesce("source", F.lit("")))})
    title, body, source, hits = (F.col(c) for c in ("__title", "__l_line", "__source", "__l_hits"))
    text = F.concat_ws(" ", title, collapse(F.col("__l_body")))
    rows = rows.withColumn("__title_hits", word_hits(title, ([hinted(PHYSICAL_HINTS)], "pattern")))
    rows = rows.withColumns({
        "__n_physical": n_hints(text, PHYSICAL_HINTS, hits), "__n_software": n_hints(text, SOFTWARE_HINTS, hits), "__n_title": n_hints(title, PHYSICAL_HINTS, F.col("__title_hits")), "__n_need": F.col("__l_need").isNotNull()})
    physical, software, in_title, need = (F.col(f"__n_{c}") for c in ("physical", "software", "title", "need"))
    forum, status = source.contains("reddit"), F.col("eligibility_status")
    design, yes, no, open_ = source.isin("yanko_design", "design_milk"), "CONCRETE", "NON_CONCRETE", "AMBIGUOUS"
    rules = [
        (status == "INELIGIBLE", (no, "ineligible content")),
        (source.isin("amazon", "product_hunt", "etsy"), (yes, "catalogue record")),
        (forum & found(title, ONE_NEED), (yes, "one object or need in the title")),
        (found(title, NO_OBJECT), (no, "trip, advice or broad discussion")),
        (found(title, LOADOUT), (no, "loadout of several items")),
        (found(title, LISTICLE), (no, "list of products")),
        (status == "AMBIGUOUS", (open_, "eligibility is open")),
        (design & (physical > 0), (yes, "one design object")),
        (design, (open_, "no single design object")),
        ((source == "hacker_news") & (status == "ELIGIBLE"), (yes, "one named launch")),
        (source == "hacker_news", (open_, "launch can't be told")),
        ((title == "my") & body.contains("leather journal") & body.contains("backpocket"), (yes, "journal cover in the text")),
        (forum & need, (yes, "one supported object in the title")),
        (forum & ((physical == 1) | (software >= 1)), (yes, "one product noun")),
        (forum & (physical > 1) & (in_title == 1), (yes, "one product noun in the title")),
        (forum & (physical > 1), (open_, "several possible objects")),
        (forum, (open_, "no product noun")),
        (source.isin("kickstarter", "indiegogo") & ((physical > 0) | (software > 0)), (yes, "object of a campaign")),
        (source.isin("kickstarter", "indiegogo"), (open_, "campaign without an object")),
    ]
    verdict, reason = decided(rules, (open_, "no rule for the source"))
    return rows.withColumns({"concrete_status": verdict, "concrete_reason": reason}).drop("__title", "__source", "__n_physical", "__n_software", "__n_title", "__n_need", "__title_hits", *_own(df))


def craft_name(title: Column) -> Column:
    """Listing titles: the name of the first known object, else the first segment."""
    return F.coalesce(table_name(F.lower(title), CRAFTS), F.left(collapse(F.get(F.split(title, CRAFT_TAIL), F.lit(0))), F.lit(100)))


def named_launch(title: Column) -> Column:
    """Launch titles: a few are known by their whole wording, the others lose prefix, first-person phrase and tail."""
    bare = F.regexp_replace(F.trim(F.regexp_replace(title, r"(?i)^show hn:\s*", "")), r"(?i)^(?:i|we) (?:built|made|launched|created)\s+", "")
    return F.coalesce(table_name(F.lower(bare), LAUNCHES), launch_name(title))


def _line(tagline: Column) -> Column:
    return F.regexp_replace(F.trim(tagline), r"(?i)\s*(?:Discussion\s*\|\s*Link)\s*$", "")


def tagline_kind(tagline: Column) -> Column:
    return table_name(F.lower(_line(tagline)), TAGLINES)


def tagline_name(title: Column, tagline: Column, kind: Column) -> Column:
    """Title and kind of product, else title and tagline, 100 characters at most; null without a tagline."""
    own = _line(tagline)
    dash = F.lit(" — ")
    return F.when(own != "", F.when(kind.isNotNull(), F.concat(title, dash, kind)).otherwise(F.left(F.concat(title, dash, own), F.lit(100))))


def identity(df: DataFrame, known: str = "known_name", tagline: str = "tagline") -> DataFrame:
    """Adds normalized_name, name_zh, identity_method and identity_confidence to records with eligibility and concreteness.

    `known` is a translated name that is there already; `tagline` a product's own line. No rule invents a name: where none
    applies, it stays null.
    """
    space = lambda c: collapse(F.coalesce(F.col(c), F.lit("")))
    rows = with_texts(df).withColumns({"__title": space("title"), "__source": F.lower(F.coalesce("source", F.lit("")))})
    title, source, zh, low_body = F.col("__title"), F.col("__source"), F.col(known), F.col("__l_line")
    vague, forum = F.lower(title).isin(*VAGUE_TITLES), source.contains("reddit")
    # most texts don't have the word that every match ends with
    cover = F.when(vague & low_body.contains("cover"), F.initcap(F.lower(F.nullif(F.regexp_extract(space("description"), COVER, 1), F.lit("")))))
    rows = rows.withColumn("__own_line", F.when(source == "product_hunt", F.coalesce(F.nullif(F.col(tagline), F.lit("")), space("description"))))
    own_line = F.col("__own_line")
    names = {
        "cover": cover, "tagline": F.when(source == "product_hunt", tagline_name(title, own_line, F.col("__name_kind"))), "catalogue": F.when(source == "amazon", catalogue_name(title)),
        "craft": F.when(source == "etsy", craft_name(title)), "launch": F.when(source == "hacker_news", named_launch(title)), "need": F.col("__l_need"),
        "design": F.when(source.isin("yanko_design", "design_milk"), design_name(title))}
    rows = rows.withColumn("__name_kind", F.when(source == "product_hunt", tagline_kind(own_line))).withColumns({f"__name_{c}": v for c, v in names.items()})
    n = {c: F.col(f"__name_{c}") for c in ("kind", *names)}
    none = F.lit(None).cast("string")
    zh_cover = F.coalesce(zh, F.when(F.lower(n["cover"]).contains("leather"), F.lit(COVER_ZH)))
    zh_need = F.coalesce(zh, F.create_map(*[F.lit(x) for item in NEEDS_ZH.items() for x in item])[n["need"]])
    sure = lambda name: F.when(name != title, "HIGH").otherwise("MEDIUM")
    none_of = F.col("concrete_status")
    rules = [
        (F.col("eligibility_status") == "INELIGIBLE", (none, none, "ineligible", "UNRESOLVED")),
        (none_of == "NON_CONCRETE", (none, zh, "non_concrete", "UNRESOLVED")),
        (none_of == "AMBIGUOUS", (none, zh, "unresolved", "UNRESOLVED")),
        (vague & n["cover"].isNotNull(), (n["cover"], zh_cover, "description_pattern", "HIGH")),
        (vague & low_body.contains("leather journal") & low_body.contains("backpocket"), (F.lit(COVER_NAME), F.coalesce(zh, F.lit(COVER_ZH)), "description_context_rule", "HIGH")),
        (vague, (none, zh, "vague_source_title", "UNRESOLVED")),
        (n["tagline"].isNotNull(), (n["tagline"], zh, F.when(n["kind"].isNotNull(), "product_hunt_product_type").otherwise("product_hunt_title_tagline"), "HIGH")),
        (source == "amazon", (n["catalogue"], zh, "amazon_catalog_parser", sure(n["catalogue"]))),
        (source == "etsy", (n["craft"], zh, "etsy_listing_title_parser", sure(n["craft"]))),
        (source == "hacker_news", (n["launch"], zh, "show_hn_title_parser", F.when(n["launch"].isNotNull(), "HIGH").otherwise("UNRESOLVED"))),
        (forum & n["need"].isNotNull(), (n["need"], zh_need, "reddit_product_noun", "HIGH")),
        (forum, (none, none, "reddit_unresolved", "LOW")),
        (n["design"].isNotNull(), (n["design"], zh, "design_object_parser", "HIGH")),
        ((F.length(title) >= 3) & ~title.rlike(r"(?i)^(?:my|this|help)\b"), (title, zh, "source_title", "MEDIUM")),
    ]
    name, name_zh, method, confidence = decided(rules, (none, zh, "unresolved", "UNRESOLVED"))
    return rows.withColumns({"normalized_name": name, "name_zh": name_zh, "identity_method": method, "identity_confidence": confidence}).drop("__title", "__source", "__own_line", *[f"__name_{c}" for c in n], *_own(df))


def context_text(raw: Column) -> Column:
    """Tagline, topics and all strings of `metadata`, at any depth, of a record's JSON, with a space between them."""
    tagline = F.get_json_object(raw, "$.tagline")
    topics = F.array_join(F.filter(F.from_json(F.get_json_object(raw, "$.topics"), "array<string>"), lambda x: x.isNotNull()), " ")
    # keys are matched too, so that they are passed over, but only values are taken; numbers and booleans have no quotes
    values = F.filter(F.regexp_extract_all(F.get_json_object(raw, "$.metadata"), F.lit(r'"(?:[^"\\]|\\.)*"\s*:|"((?:[^"\\]|\\.)*)"'), 1), lambda x: F.coalesce(x != "", F.lit(False)))
    alone = F.get_json_object(raw, "$.metadata")
    strings = F.when(alone.rlike(r"^\s*[\[{]"), F.array_join(values, " ")).otherwise(alone)
    return F.concat_ws(" ", tagline, F.nullif(topics, F.lit("")), F.nullif(strings, F.lit("")))


def source_reason(reason: Column, source: Column, raw: Column) -> Column:
    """The reason with what only this source knows: a campaign's funding, a discussion's engagement."""
    number = lambda key: F.get_json_object(raw, f"$.{key}").try_cast("double")
    shown = lambda x: F.when(x.isNull(), "unknown").when(x == F.floor(x), F.floor(x).cast("string")).otherwise(x.cast("string"))
    score, comments = number("score"), number("num_comments")
    more = (
        F.when((source == "kickstarter") & (number("percent_funded") >= 100), F.lit("market validated: funded >= 100%"))
        .when((source == "reddit_arctic_shift") & (score.isNotNull() | comments.isNotNull()), F.concat(F.lit("historical engagement: score="), shown(score), F.lit(", comments="), shown(comments))))
    return F.concat_ws("; ", reason, more)
