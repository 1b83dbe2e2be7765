"""Operator 11: what each of five filters removes, in every order of applying them and by Shapley value.

A document's failures are a set of filters. Per part the removals of all 32 coalitions of filters are tabulated: how many
documents fail at least one of them. A step of an order removes the difference between two coalitions, so no order is ever
run. The Shapley values are the solution of the constrained least-squares problem with Shapley kernel weights, whose normal
equations are solved in rationals; they are exact.

Null texts count as empty and a null source as the empty string. A null doc_id is neither smaller nor larger than another,
so such rows never fail E and let no other fail it; rows that repeat one doc_id and text don't fail E by each other. A
document is good (toxic) if any label of its id says so. An empty table gives no row; further columns are ignored.
"""

from __future__ import annotations

from fractions import Fraction
from functools import lru_cache
from itertools import permutations
from math import comb

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.llm.common import table, written

FILTERS = "ABCDE"
ALL = 2 ** len(FILTERS) - 1
SPACE = r"[\x20\x09-\x0D]+"


def _bit(name: str) -> int:
    return 1 << FILTERS.index(name)


def own_failures(text: Column) -> Column:
    """The filters A to D that a text fails, as bits; it is judged by itself."""
    words = F.array_remove(F.split(text, SPACE), "")
    sizes = F.get(F.transform(F.array(words), lambda w: F.struct(F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("own"))), F.lit(0))
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    made = F.struct(sizes.alias("w"), (capitals * 100 > F.length(text) * 5).alias("C"), text.rlike("[#$%&*|]").alias("D"))

    def bits(x: Column) -> Column:
        fails = {"A": x["w"]["n"] < 50, "B": x["w"]["own"] * 100 < x["w"]["n"] * 65, "C": x["C"], "D": x["D"]}
        return sum((F.when(c, F.lit(_bit(k))).otherwise(F.lit(0)) for k, c in fails.items()), F.lit(0))

    return F.get(F.transform(F.array(made), bits), F.lit(0))


def failures(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, fails, good, toxic, n): how many documents of a part fail exactly the filters whose bits are set."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    facts = written(docs.select(
        "doc_id", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"),
        own_failures(text).alias("fails"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest")), "failures")
    # the first of each text is found by id and text together: neither a hot text nor a hot id gathers in one task
    firsts = facts.where("doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    known = facts.groupBy("doc_id", "digest", "part", "fails").agg(F.count(F.lit(1)).alias("n"))
    marked = known.where("doc_id IS NOT NULL").join(firsts, ["digest", "doc_id"], "left").withColumn("fails", F.when(F.col("first"), F.col("fails")).otherwise(F.col("fails") + _bit("E")))
    said = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(*[F.coalesce(F.max(F.col(c) == 1), F.lit(False)).alias(n) for c, n in (("quality", "good"), ("toxic", "toxic"))])
    judged = marked.join(said, "doc_id", "left").select("part", "fails", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"), "n")
    nameless = known.where("doc_id IS NULL").select("part", "fails", F.lit(False).alias("good"), F.lit(False).alias("toxic"), "n")
    return judged.unionByName(nameless).groupBy("part", "fails", "good", "toxic").agg(F.sum("n").alias("n"))


def coalitions(failed: DataFrame) -> DataFrame:
    """part, total, and three arrays by coalition (its filters as bits): documents that it removes, good ones, toxic ones."""
    counts = failed.groupBy("part", "fails").agg(F.sum("n").alias("n"), *[F.sum(F.when(F.col(c), F.col("n")).otherwise(0)).alias(c) for c in ("good", "toxic")])
    # of a part there are as many rows as sets of failures, 32 at most
    each = counts.groupBy("part").agg(F.sum("n").alias("total"), F.collect_list(F.struct("fails", "n", "good", "toxic")).alias("sets"))

    def removed(n: str) -> Column:
        return F.expr(f"transform(sequence(0, {ALL}), s -> aggregate(sets, 0L, (sum, x) -> sum + if((x.fails & s) != 0, x.{n}, 0L)))")

    return each.select("part", "total", removed("n").alias("removed"), removed("good").alias("good"), removed("toxic").alias("toxic"))


def solved(matrix: list[list[Fraction]]) -> list[list[Fraction]]:
    """The inverse of a regular matrix, by elimination in rationals."""
    n = len(matrix)
    rows = [[*map(Fraction, r), *(Fraction(i == j) for j in range(n))] for i, r in enumerate(matrix)]
    for c in range(n):
        pivot = next(r for r in range(c, n) if rows[r][c])
        rows[c], rows[pivot] = rows[pivot], rows[c]
        rows[c] = [x / rows[c][c] for x in rows[c]]
        for r in range(n):
            if r != c and (f := rows[r][c]):
                rows[r] = [x - f * y for x, y in zip(rows[r], rows[c])]
    return [r[n:] for r in rows]


@lru_cache(maxsize=4)
def _normal_equations(n: int) -> tuple[list[tuple[int, Fraction]], list[list[Fraction]]]:
    """Weight of each coalition but the empty and the full one, and the inverse of the bordered normal matrix."""
    weights = [(s, Fraction(n - 1, comb(n, k) * k * (n - k))) for s in range(1, 2**n - 1) for k in (s.bit_count(),)]
    gram = [[sum((w for s, w in weights if s >> i & s >> j & 1), Fraction()) for j in range(n)] for i in range(n)]
    return weights, solved([*[[*row, Fraction(1)] for row in gram], [*[Fraction(1)] * n, Fraction(0)]])


def shapley(values: list[int]) -> list[Fraction]:
    """Shapley values of the game whose 2^n values are given by coalition: weighted least squares under efficiency."""
    n = len(values).bit_length() - 1
    if n == 1:
        return [Fraction(values[1] - values[0])]
    weights, inverse = _normal_equations(n)
    right = [sum((w * int(values[s] - values[0]) for s, w in weights if s >> i & 1), Fraction()) for i in range(n)] + [Fraction(int(values[-1] - values[0]))]
    return [sum((a * b for a, b in zip(row, right)), Fraction()) for row in inverse[:n]]


def audit(failed: DataFrame) -> DataFrame:
    """One row for each part, order and step; see the module."""
    orders = ["".join(p) for p in permutations(FILTERS)]

    @F.pandas_udf("array<long>")
    def all_orders(values: pd.Series) -> pd.Series:
        return values.map(lambda v: [int(x * len(orders)) for x in shapley([int(n) for n in v])])

    places = F.posexplode(F.split("filter_order", ""))
    each = coalitions(failed).withColumn("values", all_orders("removed")).withColumn("filter_order", F.explode(F.split(F.lit(",".join(orders)), ",")))
    each = each.select("*", places.alias("i", "letter")).withColumns({
        "own": F.expr(f"locate(letter, '{FILTERS}') - 1"),
        "before": F.expr(f"aggregate(split(substr(filter_order, 1, i), ''), 0, (s, f) -> s + if(f = '', 0, shiftleft(1, locate(f, '{FILTERS}') - 1)))"),
    }).withColumn("bit", F.expr("shiftleft(1, own)"))
    before, own, after = F.col("before"), F.col("bit"), F.expr("before | bit")
    change = lambda c: F.get(c, after) - F.get(c, before)
    return each.select(
        "part", "filter_order", (F.col("i") + 1).alias("step"),
        (F.col("total") - F.get("removed", after)).alias("kept"),
        change("removed").alias("removed"),
        (F.get("removed", own) - change("removed")).alias("redundant"),
        (F.get("removed", F.lit(ALL)) - F.get("removed", F.expr(f"{ALL} ^ bit"))).alias("unique_fails"),
        change("good").alias("good_lost"),
        change("toxic").alias("toxic_lost"),
        F.get("values", "own").alias("shapley"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(failures(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


#: Counts each step of each order by itself, without coalitions.
ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
m AS (SELECT part,
    CASE WHEN len(words) < 50 THEN 'A' ELSE '' END
    || CASE WHEN 100 * len(list_distinct(words)) < 65 * len(words) THEN 'B' ELSE '' END
    || CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text) THEN 'C' ELSE '' END
    || CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END
    || CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY text) THEN 'E' ELSE '' END AS fails,
    coalesce(doc_id IN (SELECT doc_id FROM labels WHERE quality = 1), false) AS good,
    coalesce(doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1), false) AS toxic FROM d),
c AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM m GROUP BY ALL),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
o AS (SELECT a.f || b.f || x.f || y.f || z.f AS filter_order FROM l a, l b, l x, l y, l z
    WHERE len(list_distinct([a.f, b.f, x.f, y.f, z.f])) = 5),
s AS (SELECT filter_order, step::INT AS step, substr(filter_order, step::INT, 1) AS f, substr(filter_order, 1, step::INT - 1) AS earlier
    FROM o, range(1, 6) t(step)),
j AS (SELECT part, filter_order, step, f, n, good, toxic, contains(fails, f) AS hit, fails = f AS alone,
    earlier <> '' AND regexp_matches(fails, '[' || CASE WHEN earlier = '' THEN '-' ELSE earlier END || ']') AS gone FROM c, s),
r AS (SELECT part, filter_order, step, f,
    coalesce(sum(n) FILTER (NOT gone AND NOT hit), 0)::BIGINT AS kept,
    coalesce(sum(n) FILTER (NOT gone AND hit), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (gone AND hit), 0)::BIGINT AS redundant,
    coalesce(sum(n) FILTER (alone), 0)::BIGINT AS unique_fails,
    coalesce(sum(good) FILTER (NOT gone AND hit), 0)::BIGINT AS good_lost,
    coalesce(sum(toxic) FILTER (NOT gone AND hit), 0)::BIGINT AS toxic_lost FROM j GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
    sum(removed) OVER (PARTITION BY part, f)::BIGINT AS shapley FROM r"""
