"""Rule tables compiled to column expressions.

A table maps a flag to its patterns; a flag is set if one of them occurs. Kinds: "word" are phrases that stand between word
boundaries, with an optional plural s; "regex" are regular expressions between word boundaries; "part" are plain substrings.
Letters of any script count as word characters. Null texts match nothing.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.functions.text import bind

EDGE = r"[^\p{L}\p{N}_]"
#: How a regular expression begins whose first word is a number.
NUMBER = r"\d"


def pattern(patterns: Sequence[str], kind: str = "word") -> str:
    """One regular expression that finds any of the patterns, whatever their case."""
    if kind == "word":
        patterns = [re.escape(p) + ("" if p.lower().endswith("s") else "s?") for p in patterns]
    elif kind == "part":
        patterns = [re.escape(p) for p in patterns]
    joined = "|".join(patterns)
    return f"(?i)(?:{joined})" if kind == "part" else f"(?i)(?:^|{EDGE})(?:{joined})(?:$|{EDGE})"


def first_words(regex: str, most: int = 400) -> set[str] | None:
    """All words, in lower case, with one of which every match begins; None if they can't be listed.

    Only a beginning at a word's edge (\\b or ^) and words that end within the pattern count. Read are letters, signs, escapes,
    classes, groups and the optional mark.
    """
    edge = "\0"

    def options(alternatives: list[list[tuple[set[str] | None, bool]]]) -> set[str] | None:
        made: set[str] = set()
        for parts in alternatives:
            own = {""}
            for texts, optional in parts:
                if all(re.search(r"\w\W", x) for x in own):
                    break
                if texts is None:
                    return None
                own = {x + t for x in own for t in (texts | {""} if optional else texts)}
                if len(own) > most:
                    return None
            made |= own
        return made

    def read(i: int) -> tuple[list[list[tuple[set[str] | None, bool]]], int]:
        alternatives: list[list[tuple[set[str] | None, bool]]] = [[]]
        while i < len(regex) and regex[i] != ")":
            c = regex[i]
            i += 1
            if c == "|":
                alternatives.append([])
                continue
            texts: set[str] | None = {c.lower()}
            if c == "(":
                inner, i = read(i + 2 if regex.startswith("?:", i) else i)
                texts, i = options(inner), i + 1
            elif c == "[":
                end = regex.index("]", i)
                own = re.sub(r"(\w)-(\w)", lambda m: "".join(map(chr, range(ord(m[1]), ord(m[2]) + 1))), regex[i:end])
                texts, i = None if own.startswith("^") or "\\" in own else set(own.lower()), end + 1
            elif c == "\\":
                texts = {"b": {edge}, "d": set("0123456789"), "s": {" "}}.get(regex[i], None if regex[i].isalnum() else {regex[i]})
                i += 1
            elif c in "^$":
                texts = {edge}
            elif c == ".":
                texts = None
            optional = i < len(regex) and regex[i] == "?"
            if i < len(regex) and regex[i] in "*+{":
                # signs that are no letters end a word, however many they are
                signs = texts is not None and regex[i] != "{" and all(re.fullmatch(r"[^\w\0]", x) for x in texts)
                optional, texts = regex[i] == "*", texts if signs else None
                i = regex.index("}", i) if regex[i] == "{" else i
                i += 1
            while i < len(regex) and regex[i] == "?":
                i += 1
            alternatives[-1].append((texts, optional))
        return alternatives, i

    starts = options(read(0)[0])
    words = {m[1] if (m := re.match(rf"{edge}\W*(\w+)\W", x)) else None for x in starts or [""]}
    return None if None in words else words


def key_words(phrase: str, kind: str = "word") -> set[str] | None:
    """Words of which a text with the phrase has one, whole and in lower case; None if that can't be told."""
    if kind in ("part", "pattern"):
        return first_words(phrase) if kind == "pattern" else None
    if kind == "regex":
        return first_words(rf"\b(?:{phrase})\b")
    low = phrase.lower()
    words = re.findall(r"\w+", low)
    if not words:
        return None
    best = max(words[:-1], key=len, default="")
    return {best} if len(best) >= len(words[-1]) else _plural(words[-1])


def _plural(word: str) -> set[str]:
    return {word} if word.endswith("s") else {word, word + "s"}


def word_hits(low: Column, *tables: tuple[Iterable[str], str]) -> Column:
    """The words of a lower-cased text that are key words of the phrases of some tables (phrases, kind); the text is cut once for all of them.

    Few texts have any, and only behind them a phrase of several words or a regular expression is looked for.
    """
    known = sorted({w for phrases, kind in tables for p in phrases for w in key_words(p, kind) or ()})
    numbers = any(p.startswith(NUMBER) for phrases, kind in tables if kind == "regex" for p in phrases)
    if not known and not numbers:
        return F.array().cast("array<string>")
    return F.filter(F.split(low, EDGE + "+"), lambda w: w.isin(*known) | _is_number(w) if numbers else w.isin(*known))


def _is_number(word: Column) -> Column:
    return (word >= "0") & (word < ":")


def indexed(df: DataFrame, text: Column, *tables: tuple[Iterable[str], str], prefix: str = "_") -> DataFrame:
    """Adds (prefix)_low, the text in lower case, and (prefix)_hits, its word hits, as columns that many flags can be read from.

    Columns that stand there already, made from the same text and at least these tables, are taken as they are.
    """
    low, hits = f"{prefix}_low", f"{prefix}_hits"
    if hits in df.columns:
        return df
    return df.withColumn(low, F.lower(text)).withColumn(hits, word_hits(F.col(low), *tables))


def phrases_of(table: Mapping[str, Sequence[str]]) -> list[str]:
    return [p for own in table.values() for p in own]


def _alternatives(regex: str) -> list[str]:
    """The parts between the bars that stand in no group."""
    cuts, depth = [-1], 0
    for i, c in enumerate(regex):
        depth += (c == "(") - (c == ")")
        if c == "|" and not depth:
            cuts.append(i)
    return [regex[a + 1 : b] for a, b in zip(cuts, [*cuts[1:], len(regex)])]


def leads(regex: str) -> list[str]:
    """Letters, in lower case, with one of which every match of the regular expression begins; none if that isn't plain to see."""
    if len(_alternatives(regex)) > 1:
        return []
    # an edge takes no letter, but what it is followed by must be there
    regex = regex.removeprefix(r"\b")
    group = re.match(r"\(\?:([^()]*)\)(?![?*{])", regex)
    found = []
    for start in group[1].split("|") if group else [regex]:
        own = re.match(r"[\w' \-]*", start, re.ASCII)[0]
        # what a quantifier makes optional isn't sure to be there
        found.append((own[:-1] if start[len(own) : len(own) + 1] in ("?", "*", "{") else own).lower())
    return found if all(found) else []


def _leads_of_each(regex: str) -> list[str]:
    """leads() of all alternatives; none if one of them has none."""
    found = [leads(part) for part in _alternatives(regex)]
    return [x for own in found for x in own] if all(found) else []


def gated(low: Column, hits: Column | None, patterns: Sequence[str]) -> Column:
    """Whether one of the regular expressions is found in a lower-cased text. They are tried only if the text holds a key word or leading letters of one."""
    keys = {p: first_words(p) if hits is not None else None for p in patterns}
    starts = {p: [] if keys[p] else _leads_of_each(p) for p in patterns}
    free = [p for p in patterns if not keys[p] and not starts[p]]
    behind = [p for p in patterns if p not in free]
    words, letters = {w for p in behind for w in keys[p] or ()}, list(dict.fromkeys(x for p in behind for x in starts[p]))
    out = [low.rlike("|".join(free))] if free else []
    if behind:
        gate = ([_overlap(hits, words)] if words else []) + [low.contains(x) for x in letters]
        out.append(F.when(_one_of(gate), low.rlike("|".join(behind))).otherwise(F.lit(False)))
    return F.coalesce(_one_of(out), F.lit(False))


def _one_of(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def _overlap(hits: Column, words: Iterable[str]) -> Column:
    return F.arrays_overlap(hits, F.array(*map(F.lit, sorted(words))))


def tested(low: Column, hits: Column, patterns: Sequence[str], kind: str) -> Column:
    """Whether one of the patterns occurs in a lower-cased text with these word hits."""
    if kind == "part":
        return F.coalesce(_one_of([low.contains(x) for x in dict.fromkeys(p.lower() for p in patterns)]), F.lit(False))
    keys = {p: key_words(p, kind) for p in patterns}
    single = [p for p in patterns if kind == "word" and re.fullmatch(r"\w+", p)]
    behind = [p for p in patterns if p not in single and keys[p]]
    number = [p for p in patterns if not keys[p] and kind == "regex" and p.startswith(NUMBER)]
    free = [p for p in patterns if not keys[p] and p not in number]
    out = []
    if single:
        out.append(_overlap(hits, {w for p in single for w in keys[p]}))
    if behind:
        out.append(F.when(_overlap(hits, {w for p in behind for w in keys[p]}), low.rlike(pattern(behind, kind))).otherwise(F.lit(False)))
    if number:
        out.append(F.when(F.exists(hits, _is_number), low.rlike(pattern(number, kind))).otherwise(F.lit(False)))
    if free:
        starts = [leads(p) if kind == "regex" else [p.lower()] for p in free]
        found = low.rlike(pattern(free, kind))
        out.append(F.when(_one_of([low.contains(x) for x in dict.fromkeys(x for own in starts for x in own)]), found).otherwise(F.lit(False)) if all(starts) else found)
    return F.coalesce(_one_of(out), F.lit(False))


def _with_hits(text: Column, patterns: Iterable[str], kind: str, body: Callable[[Column, Column], Column]) -> Column:
    return bind(F.lower(text), lambda low: bind(word_hits(low, (list(patterns), kind)), lambda hits: body(low, hits)))


def any_of(text: Column, patterns: Sequence[str], kind: str = "word") -> Column:
    return _with_hits(text, patterns, kind, lambda low, hits: tested(low, hits, patterns, kind))


def flags_in(low: Column, hits: Column, table: Mapping[str, Sequence[str]], kind: str = "word") -> Column:
    """The flags that are set, in the table's order, from a lower-cased text and its word hits."""
    return F.array_compact(F.array(*[F.when(tested(low, hits, p, kind), F.lit(name)) for name, p in table.items()]))


def flags(text: Column, table: Mapping[str, Sequence[str]], kind: str = "word") -> Column:
    """The flags that are set, in the table's order."""
    return _with_hits(text, phrases_of(table), kind, lambda low, hits: flags_in(low, hits, table, kind))


def matched(text: Column, phrases: Sequence[str]) -> Column:
    """The phrases that occur, in their order."""
    return flags(text, {p: (p,) for p in phrases})


def first_label(text: Column, table: Mapping[str, Sequence[str]], default: str | None = None, kind: str = "part") -> Column:
    """The label of the first rule that matches."""

    def chain(low: Column, hits: Column) -> Column:
        out = F.lit(default).cast("string")
        for label, p in reversed(list(table.items())):
            out = F.when(tested(low, hits, p, kind), F.lit(label)).otherwise(out)
        return out

    return _with_hits(text, phrases_of(table), kind, chain)


def alone(terms: Iterable[str]) -> list[str]:
    """The terms that are single words."""
    return [t for t in terms if " " not in t and "-" not in t]


def spaced(text: Column, *tables: Iterable[str], hits: Column | None = None) -> Column:
    """The single words of the tables that stand between spaces; the text is cut once for all of them. With its word hits for them, only if it has one."""
    known = sorted({t for terms in tables for t in alone(terms)})
    found = F.filter(F.split(text, " "), lambda w: w.isin(*known))
    return found if hits is None else F.when(_overlap(hits, known), found).otherwise(F.array().cast("array<string>"))


def padded(text: Column, terms: Sequence[str], words: Column | None = None) -> Column:
    """Single words must stand between spaces; phrases and hyphenated terms may stand anywhere. `words` is spaced() of the text."""
    single = alone(terms)
    found = [_overlap(spaced(text, single) if words is None else words, single)] if single else []
    return F.coalesce(_one_of([*found, *[text.contains(t) for t in terms if t not in single]]), F.lit(False))


def weights(found: Column, table: Mapping[str, int]) -> Column:
    """Sum of the weights of the flags found; unknown flags weigh nothing."""
    known = F.create_map(*[F.lit(x) for item in table.items() for x in item])
    return F.aggregate(found, F.lit(0), lambda a, f: a + F.coalesce(known[f], F.lit(0)))


def clamp(score: Column, low: int = 0, high: int = 100) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), score))


def has(found: Column, *names: str) -> Column:
    """Whether one of the flags is among those found."""
    return F.arrays_overlap(found, F.array(*map(F.lit, names)))
