"""Column functions on texts, URLs, times and numbers. Null in gives null out unless said otherwise."""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Callable, Mapping
from functools import lru_cache, reduce
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

BAR = chr(124)
#: A character reference: by number, or by a name with or without semicolon.
REFERENCE = r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[A-Za-z][A-Za-z0-9]{1,31};?)"
#: Hour at which a business day begins, in a zone eight hours ahead of UTC without summer time.
ZONE, NOON_UTC_HOURS = "Asia/Shanghai", 4


#: Parts of the table of names; a look-up reads one of them.
NAME_PARTS = 16


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value computed once a row however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def collapse(text: Column) -> Column:
    """White space runs become one space, ends are trimmed."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def clip(text: Column, limit: int) -> Column:
    """Collapsed text of at most `limit` characters, the last an ellipsis if something is cut."""
    return bind(collapse(text), lambda own: F.when(F.length(own) > limit, F.concat(F.rtrim(F.left(own, F.lit(limit - 1))), F.lit("…"))).otherwise(own))


@lru_cache(maxsize=1)
def _numbers() -> dict[str, str]:
    """What numbers stand for that are no code points of their own: those of a one-byte table, the carriage return, and nothing for what no text may hold."""
    out = {0: "\ufffd", 13: "\r"}
    for n in range(0x80, 0xA0):
        out[n] = bytes([n]).decode("cp1252", "ignore") or chr(n)
    nothing = [*range(1, 9), 11, *range(14, 32), 127, *range(0xFDD0, 0xFDF0), *(0x10000 * k + 0xFFFE + i for k in range(17) for i in (0, 1))]
    return {str(n): c for n, c in ({n: "" for n in nothing} | out).items()}


def _table(entries: dict[str, str]) -> Column:
    """A map as one literal, of any size."""
    return F.from_json(F.lit(json.dumps(entries)), "map<string,string>")


@lru_cache(maxsize=1)
def _named_parts() -> list[dict[str, str]]:
    """The names of HTML and what they stand for, dealt by checksum: a map of Spark's is searched from end to end."""
    parts: list[dict[str, str]] = [{} for _ in range(NAME_PARTS)]
    for name, c in html5.items():
        parts[zlib.crc32(name.encode()) % NAME_PARTS][name] = c
    return parts


def _of_name(word: Column) -> Column:
    """What a name of HTML stands for, null if it is none."""
    return F.try_element_at(F.get(F.array(*map(_table, _named_parts())), F.crc32(word) % NAME_PARTS), word)


def unescape(text: Column) -> Column:
    """The text with all character references of HTML replaced, once, from left to right.

    A name without its semicolon counts where HTML knows it so; of a longer word the longest such beginning. What is no
    reference stays as it is.
    """
    bare = sorted((n for n in html5 if not n.endswith(";")), key=lambda n: (-len(n), n))

    def named(word: Column) -> Column:
        start = F.regexp_extract(word, "^(" + "|".join(map(re.escape, bare)) + ")", 1)
        return F.coalesce(_of_name(word), F.when(start != "", F.concat(_of_name(start), F.substring(word, F.length(start) + 1, F.length(word)))), F.concat(F.lit("&"), word))

    def numbered(word: Column) -> Column:
        digits = F.regexp_extract(word, "^#[xX]?([0-9a-fA-F]+)", 1)
        value = F.when(word.rlike("^#[xX]"), F.when(F.length(F.ltrim(digits, F.lit("0"))) <= 8, F.conv(digits, 16, 10))).otherwise(digits).try_cast("bigint")
        point = F.decode(F.unhex(F.lpad(F.hex(value), 8, "0")), "UTF-32")
        unknown = value.isNull() | (value > 0x10FFFF) | value.between(0xD800, 0xDFFF)
        return F.coalesce(F.try_element_at(_table(_numbers()), value.cast("string")), F.when(unknown, "\ufffd").otherwise(point))

    def decoded(found: Column) -> Column:
        return bind(F.substring(found, F.lit(2), F.length(found)), lambda word: F.when(word.startswith("#"), numbered(word)).otherwise(named(word)))

    def replaced(own: Column) -> Column:
        # one more text than references; most texts have none
        made = F.transform(F.regexp_extract_all(own, F.lit(f"({REFERENCE})"), 1), decoded)
        joined = F.array_join(F.zip_with(F.split(own, REFERENCE), made, lambda x, y: F.concat(x, F.coalesce(y, F.lit("")))), "")
        return F.when(own.contains("&"), joined).otherwise(own)

    return bind(text, replaced)


def strip_tags(html: Column, references: Mapping[str, str] | None = None) -> Column:
    """Visible text: tags become spaces, character references what they stand for, white space of any kind one space.

    With `references` (reference to text) only those count, as they are written, and only white space of ASCII; that of an
    ampersand must be their last.
    """
    bare = F.regexp_replace(html, "<[^>]+>", " ")
    if references is not None:
        return F.trim(F.regexp_replace(reduce(lambda x, r: F.replace(x, F.lit(r), F.lit(references[r])), references, bare), r"[\t\n\f\r ]+", " "))
    return F.trim(F.regexp_replace(unescape(bare), r"[\s\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+", " "))


def first_image(html: Column) -> Column:
    found = F.regexp_extract(html, r"(?i)<img[^>]+src=[\"']([^\"']+)", 1)
    return F.when(found != "", found)


def canonical_url(url: Column) -> Column:
    """Without fragment and without utm_* parameters."""
    bare = F.substring_index(url, "#", 1)
    base, query = F.substring_index(bare, "?", 1), F.regexp_extract(bare, r"\?(.*)$", 1)
    kept = F.array_join(F.filter(F.split(query, "&"), lambda p: ~F.lower(p).startswith("utm_") & (p != "")), "&")
    return F.when(kept != "", F.concat(base, F.lit("?"), kept)).otherwise(base)


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


def is_external(url: Column, own: str) -> Column:
    """Whether the host is neither `own` nor below it."""
    h = host(url)
    return (h != "") & (h != own) & ~h.endswith(f".{own}")


def parse_number(text: Column) -> Column:
    """Numbers with thousands separators or a percent sign; anything else is null."""
    return F.regexp_replace(text, "[,%\\s]", "").try_cast("double")


def parse_time(text: Column) -> Column:
    """Epoch seconds, or ISO 8601 with Z, an offset or neither (UTC); anything else is null."""
    return F.coalesce(F.timestamp_seconds(text.try_cast("double")), F.try_to_timestamp(text))


#: Keys under which sources state when something was published, in order.
TIME_KEYS = ("published_at", "published", "datePublished", "date_published", "created_at", "created_utc", "campaignStartDate", "campaign_start_date")


def event_time(raw: Column, observed: Column) -> Column:
    """(at, method): the first of TIME_KEYS in a record's JSON, or below its `metadata`, that parses; else when it was observed."""
    each = [(k, F.coalesce(F.get_json_object(raw, f"$.{k}"), F.get_json_object(raw, f"$.metadata.{k}"))) for k in TIME_KEYS]
    named = [F.when(parse_time(v).isNotNull(), F.struct(parse_time(v).alias("at"), F.lit(f"source:{k}").alias("method"))) for k, v in each]
    return F.coalesce(*named, F.struct(observed.cast("timestamp").alias("at"), F.lit("observation").alias("method")))


def number_text(value: Column, grouped: bool = False) -> Column:
    """Two places at most, without trailing zeros; with thousands separators if grouped."""
    return F.regexp_replace(F.format_number(value, 2) if grouped else F.format_string("%.2f", value), r"\.?0+$", "")


def visible_text(html: Column) -> Column:
    """(text, image) of an HTML fragment."""
    return F.struct(strip_tags(html).alias("text"), first_image(html).alias("image"))


def business_date(ts: Column) -> Column:
    return F.to_date(F.from_utc_timestamp(ts, ZONE))


def noon_window(ts: Column) -> Column:
    """Start (UTC) of the day from noon to noon, business time, that holds ts."""
    return F.window(ts, "1 day", "1 day", f"{NOON_UTC_HOURS} hours")["start"]


def age_days(ts: Column, now: Column) -> Column:
    return F.floor((F.unix_timestamp(now) - F.unix_timestamp(ts)) / 86400)


def key_of(*parts: Column, length: int = 64, prefix: str = "") -> Column:
    """Leading hex digits of the SHA-256 of the parts joined by a bar."""
    digest = F.substring(F.sha2(F.concat_ws(BAR, *parts), 256), 1, length)
    return F.concat(F.lit(prefix), digest) if prefix else digest


def tokens(text: Column, stop: tuple[str, ...] = ()) -> Column:
    """Distinct lower-cased alphanumeric tokens in order of appearance, without stop words."""
    found = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), 1))
    return F.array_except(found, F.array(*map(F.lit, stop))) if stop else found


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all tokens; null if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union)
