"""Operator 5 (native): licence phrases, and an exact set-similarity join of text blocks with licence templates.

A block is as many words on end, across lines or within one, as a template takes up at the containment (a quarter more than it has),
from each place of one of the template's words; it meets templates of that length only. So a text's blocks are the same however
its lines are broken. Template and block are sets of words; they match if the block holds at least CONTAINMENT of the template's
words. One global order, rarest first by the number of documents that hold a word, fixes for each template a prefix such that
a block without any word of it cannot match. Blocks meet templates on prefix words only; of the first common word's places in
both ordered sets follows how many words they can still share (positional filter), as from the sets' sizes (length filter).
What is left is compared exactly. Words outside all templates stand before all others in the order and never matter.

Null and empty texts have no words and no labels; repeated rows are judged each; lines of any length are cut alike; a block that matches several templates gets
all their labels.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.llm.common import table
from feedloom.llm.quality_rules import bind

CONTAINMENT = 0.8
#: Phrases and labels of the base.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Sentences that public licences or their notices consist of, and labels.
TEMPLATES = {
    "This work is licensed under the GNU General Public License, version 3.": "notice:gpl-3.0",
    "either version 2 of the License, or (at your option) any later version": "notice:gpl-2.0-or-later",
    "under the terms of the GNU Lesser General Public License": "notice:lgpl",
    "under the terms of the GNU Affero General Public License": "notice:agpl",
    "Licensed under the Apache License, Version 2.0.": "notice:apache-2.0",
    "distributed under the License is distributed on an AS IS BASIS, without warranties or conditions of any kind": "notice:apache-2.0",
    "Released under the MIT License.": "notice:mit",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files": "notice:mit",
    "Licensed under CC BY-NC 4.0.": "notice:cc-by-nc-4.0",
    "Licensed under CC BY-SA 4.0.": "notice:cc-by-sa-4.0",
    "Licensed under CC BY 4.0.": "notice:cc-by-4.0",
    "This work is licensed under a Creative Commons Attribution 4.0 International License": "notice:cc-by-4.0",
    "Redistribution and use in source and binary forms, with or without modification, are permitted": "notice:bsd",
    "subject to the terms of the Mozilla Public License, v. 2.0": "notice:mpl-2.0",
    "This is free and unencumbered software released into the public domain": "notice:unlicense",
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation": "notice:gpl",
    "you may not use this file except in compliance with the License. You may obtain a copy of the License at": "notice:apache-2.0",
    "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software": "notice:mit",
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software": "notice:mit",
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer": "notice:bsd",
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation": "notice:bsd",
    "If a copy of the MPL was not distributed with this file, You can obtain one at": "notice:mpl-2.0",
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted": "notice:isc",
    "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages": "notice:zlib",
    "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license": "notice:bsl-1.0",
    "This program and the accompanying materials are made available under the terms of the Eclipse Public License": "notice:epl",
    "has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law": "notice:cc0-1.0",
    "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License": "notice:cc-by-sa-4.0",
}
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _all_words_of(text: str) -> list[str]:
    import re

    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate(str.maketrans(_UPPER, _LOWER)))


def _words_of(text: str) -> list[str]:
    return list(dict.fromkeys(_all_words_of(text)))


def needed(size: int) -> int:
    """Words of a template of so many that a block must hold."""
    return math.ceil(CONTAINMENT * size - 1e-9)


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(text, _UPPER, _LOWER), GAP), "")


def _array(values: list[str]) -> Column:
    return F.array(*map(F.lit, values))


def global_order(docs: DataFrame) -> list[str]:
    """The words of all templates by the number of documents that hold them; as many rows as the templates have words."""
    vocabulary = sorted({w for t in TEMPLATES for w in _words_of(t)})
    # lower() may take more for a word than A-Z allow, never less; for an order that every block shares this is exact enough
    held = F.array_intersect(F.split(F.lower("text"), GAP), _array(vocabulary))
    counts = {r[0]: r[1] for r in docs.select(F.explode(held).alias("word")).groupBy("word").count().collect()}
    return sorted(vocabulary, key=lambda w: (counts.get(w, 0), w))


def matches(blocks: DataFrame, order: list[str]) -> DataFrame:
    """(key, label, containment) of the templates that the blocks (key, words, span) match; span: length of the templates to compare with."""
    spark = blocks.sparkSession
    rows = []
    for t, (template, label) in enumerate(TEMPLATES.items()):
        own = sorted(_words_of(template), key=order.index)
        for place, word in enumerate(own[: len(own) - needed(len(own)) + 1]):
            rows.append((word, t, label, place, len(own), needed(len(own)), own, len(_all_words_of(template))))
    index = spark.createDataFrame(rows, "word string, template int, label string, place int, size int, needed int, own array<string>, length int")
    prefix = sorted({r[0] for r in rows})
    sets = blocks.select("key", "span", F.array_intersect(_array(order), F.col("words")).alias("held")).where(F.arrays_overlap("held", _array(prefix)))
    met = sets.distinct().select("key", "span", "held", F.posexplode("held").alias("at", "word")).join(F.broadcast(index), "word").where("span = length")
    possible = met.where(
        (F.size("held") >= F.col("needed")) & (1 + F.least(F.col("size") - F.col("place") - 1, F.size("held") - F.col("at") - 1) >= F.col("needed"))
    )
    shared = F.size(F.array_intersect("held", "own"))
    return possible.where(shared >= F.col("needed")).select("key", "label", (shared / F.col("size")).alias("containment"))


def reach(n: int) -> int:
    """Words of a block for templates of n words: so many that a template may be interrupted by words up to the containment."""
    return math.floor(n / CONTAINMENT + 1e-9)


def prefix_of(template: str, order: list[str]) -> list[str]:
    """The words of a template without any of which nothing can match it."""
    own = sorted(_words_of(template), key=order.index)
    return own[: len(own) - needed(len(own)) + 1]


def windows(w: Column, order: list[str]) -> Column:
    """(words, span) of the blocks for each length of a template that begin at one of the words of such a template; none of a length of whose templates no prefix word occurs."""
    starts: dict[int, set[str]] = {}
    prefix: dict[int, set[str]] = {}
    for template in TEMPLATES:
        n = len(_all_words_of(template))
        starts.setdefault(n, set()).update(_words_of(template))
        prefix.setdefault(n, set()).update(prefix_of(template, order))
    at = lambda own: F.filter(F.transform(w, lambda x, i: F.when(F.array_contains(_array(sorted(own)), x), i + 1)), lambda i: i.isNotNull())
    cut = lambda n: lambda i: F.struct(F.slice(w, i, reach(n)).alias("words"), F.lit(n).alias("span"))
    none = F.array().cast("array<struct<words:array<string>,span:int>>")
    return F.concat(*[F.when(F.arrays_overlap(w, _array(sorted(prefix[n]))), F.transform(at(own), cut(n))).otherwise(none) for n, own in sorted(starts.items())])


def _places(w: Column, phrase: str) -> Column:
    parts = phrase.split(" ")
    here = lambda x, i: F.when(
        (x == parts[0]) & F.coalesce(*[_all([F.get(w, i + k) == p for k, p in enumerate(parts) if k])], F.lit(False)), F.struct(i.alias("at"), F.lit(PHRASES[phrase]).alias("label"))
    )
    return F.array_compact(F.transform(w, here))


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out &= c
    return out


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, word count, the base phrases' places, base_labels, labels and score of each document."""
    order = global_order(docs)
    first = sorted({p.split(" ")[0] for p in PHRASES})
    prefix = set()
    for template in TEMPLATES:
        prefix.update(prefix_of(template, order))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    # words after lower() hold all that lower-casing A-Z alone would give of these ASCII words
    seen = docs.select(
        "doc_id", text.alias("text"), F.md5(text.cast("binary")).alias("key"),
        bind(F.array_remove(F.split(F.lower(text), GAP), ""), lambda w: F.struct(
            F.arrays_overlap(w, _array(first)).alias("phrases"), F.arrays_overlap(w, _array(sorted(prefix))).alias("blocks"))).alias("may"),
        F.size(F.array_remove(F.split(text, GAP), "")).cast("long").alias("n_words"),
    )
    places = bind(words(F.col("text")), lambda w: F.concat(*[_places(w, p) for p in PHRASES]))
    found = F.when(F.col("may.phrases"), places).otherwise(F.array().cast("array<struct<at:int,label:string>>"))
    base = seen.select("doc_id", "key", "n_words", bind(found, lambda x: F.struct(
        F.size(x).cast("long").alias("n_base"),
        F.array_min(F.transform(x, lambda s: s["at"])).cast("long").alias("first_word"),
        F.array_max(F.transform(x, lambda s: s["at"])).cast("long").alias("last_word"),
        F.array_sort(F.array_distinct(F.transform(x, lambda s: s["label"]))).alias("own"))).alias("b"), "may.blocks")
    # equal texts have equal blocks: labels belong to the text's digest
    may = seen.where("may.blocks")
    blocks = may.select("key", F.inline(bind(words(F.col("text")), lambda w: windows(w, order))))
    labelled = matches(blocks, order).groupBy("key").agg(F.collect_set("label").alias("more"), F.max("containment").alias("containment"))
    out = base.where("blocks").join(labelled, "key", "left").unionByName(
        base.where("NOT blocks").withColumns({"more": F.lit(None).cast("array<string>"), "containment": F.lit(None).cast("double")}))
    none = F.array().cast("array<string>")
    return out.select(
        "doc_id", "n_words", "b.n_base", "b.first_word", "b.last_word", F.array_join("b.own", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("b.own", F.coalesce("more", none))), ",").alias("labels"),
        F.when(F.col("b.n_base") > 0, 1.0).otherwise(F.coalesce("containment", F.lit(0.0))).alias("score"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def oracle() -> str:
    place = lambda p: " AND ".join(f"words[i + {k}] = '{w}'" for k, w in enumerate(p.split(" ")))
    quoted = lambda ws: "[" + ", ".join(f"'{w}'" for w in ws) + "]"
    templates = ", ".join(f"({quoted(ws := _words_of(t))}, '{label}', {len(ws)}, {needed(len(ws))}, {reach(len(_all_words_of(t)))})" for t, label in TEMPLATES.items())
    return rf"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}') AS text FROM documents),
w AS (SELECT row, doc_id, regexp_extract_all(text, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM d),
i AS (SELECT row, words, unnest(range(1, len(words) + 1)) AS i FROM w),
p AS ({" UNION ALL ".join(f"SELECT row, i - 1 AS pos, '{label}' AS label FROM i WHERE {place(p)}" for p, label in PHRASES.items())}),
b AS (SELECT row, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word, list(DISTINCT label) AS own FROM p GROUP BY row),
t(own, label, size, needed, reach) AS (VALUES {templates}),
v AS (SELECT DISTINCT unnest(own) AS word FROM t),
may AS (SELECT row, words FROM w WHERE len(list_intersect(words, (SELECT list(word) FROM v))) > 1),
s AS (SELECT row, words, i FROM (SELECT row, words, unnest(range(1, len(words) + 1)) AS i FROM may) WHERE words[i] IN (SELECT word FROM v)),
m AS (SELECT row, list(DISTINCT label) AS more, max(shared / size) AS containment
      FROM (SELECT row, label, size, needed, len(list_intersect(own, words[i:i + reach - 1])) AS shared FROM s, t WHERE list_contains(own, words[i])) WHERE shared >= needed GROUP BY row)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word, last_word,
  coalesce(array_to_string(list_sort(b.own), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(b.own, []), coalesce(more, [])))), ','), '') AS labels,
  CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(containment, 0)::DOUBLE END AS score
FROM w LEFT JOIN b USING (row) LEFT JOIN m USING (row)"""
