"""Operator 8 (native): document quality rules with risk-controlled cutoffs.

Counts of a text come from array functions inside its row. A cutoff of a rule is used in a stratum (by number of words) only
if the labelled rows outside the held-out fold prove that it falsely rejects few good documents: of n good ones k lie above
it, and the exact binomial probability of at most k, were the true share ALPHA, is at most DELTA divided by the number of
all tests (Bonferroni). Of the proven cutoffs the lowest is taken; with none proven the rule rejects nothing there. So all
chosen cutoffs together keep their promise with probability 1 - DELTA.

Null texts count as empty and fail the base rules; repeated rows are judged each; a labelled id that stands on several rows of
a stratum is one trial there, above a cutoff if any of its rows is; labels that contradict each other for an id count as good; ties with a cutoff are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.llm.common import FOLD_SQL, held_out, table, written

#: Share of good documents that a rule may reject in a stratum, and the probability that any cutoff breaks that.
ALPHA, DELTA = 0.01, 0.05
#: Lower bounds of the strata, in words.
STRATA = (0, 100, 400, 1600)
#: Rule: (feature as SQL, cutoffs); a feature above the cutoff is against the document.
RULES = {
    "symbols": ("n_symbols / greatest(word_chars, 1)", (0.02, 0.05, 0.1, 0.2, 0.3)),
    "dup_lines": ("n_dup_lines / greatest(n_lines, 1)", (0.1, 0.2, 0.3, 0.5)),
    "repeats": ("n_repeat_words / greatest(n_words, 1)", (0.1, 0.2, 0.3, 0.4)),
    "capitals": ("n_upper / greatest(word_chars, 1)", (0.1, 0.2, 0.3, 0.5)),
    "word_length": ("word_chars / greatest(n_words, 1)", (8.0, 10.0, 12.0, 15.0, 20.0)),
}
SPACE = r"[\x20\x09-\x0D]+"


def bind(value: Column, body) -> Column:
    """body(value), with the value computed once a row however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _repeat_words(words: Column) -> Column:
    """Words that lie in 3-word windows which the array has twice or more."""
    hashes = F.transform(words, lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)))

    def covered(h: Column) -> Column:
        pairs = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        again = lambda s: F.filter(s, lambda x, j: F.coalesce(F.get(s, j - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, j + 1)["h"] == x["h"], F.lit(False)))
        starts = bind(pairs, lambda s: F.array_sort(F.transform(again(s), lambda x: x["i"])))
        steps = bind(starts, lambda p: F.aggregate(F.transform(p, lambda x, j: F.least(F.lit(3), F.coalesce(x - F.get(p, j - 1), F.lit(3)))), F.lit(0), lambda a, b: a + b))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(steps)

    windows = bind(hashes, lambda h: F.slice(h, F.lit(1), F.size(h) - 2))
    return F.when(F.size(words) < 4, F.lit(0)).otherwise(bind(windows, covered))


def features(docs: DataFrame) -> DataFrame:
    """doc_id and the counts of each whole text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    words = F.array_remove(F.split(text, SPACE), "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))

    def counts(w: Column) -> Column:
        return F.struct(F.size(w).alias("n_words"), F.length(F.array_join(w, "")).alias("word_chars"), _repeat_words(w).alias("n_repeat_words"))

    made = docs.select(
        "doc_id",
        bind(words, counts).alias("w"),
        F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).alias("n_symbols"),
        F.length(F.regexp_replace(text, r"[^\p{Lu}]+", "")).alias("n_upper"),
        bind(lines, lambda x: F.struct(F.size(x).alias("all"), F.size(F.array_distinct(x)).alias("own"))).alias("l"),
    )
    long = lambda x, n: F.expr(x).cast("long").alias(n)
    return made.select(
        "doc_id", long("w.n_words", "n_words"), long("w.word_chars", "word_chars"), long("n_symbols", "n_symbols"),
        long("l.all - l.own", "n_dup_lines"), long("w.n_repeat_words", "n_repeat_words"), long("l.all", "n_lines"), long("n_upper", "n_upper"),
    ).withColumns({
        "base_failed": F.expr("n_words < 50 OR 100 * n_repeat_words > 50 * n_words"),
        "stratum": F.expr("CASE " + " ".join(f"WHEN n_words >= {s} THEN {s}" for s in reversed(STRATA)) + " END"),
    })


def at_most(k: Column, n: Column, p: float) -> Column:
    """Exact probability that a binomial (n, p) variable is at most k, for k < p * n; else 1, which proves nothing."""
    import math

    start = F.struct((n * math.log1p(-p)).alias("term"), (n * math.log1p(-p)).alias("total"))

    def step(acc: Column, i: Column) -> Column:
        term = acc["term"] + F.log((n - i + 1) / i * (p / (1 - p)))
        high, low = F.greatest(acc["total"], term), F.least(acc["total"], term)
        return F.struct(term.alias("term"), (high + F.log1p(F.exp(low - high))).alias("total"))

    steps = F.when(k > 0, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>"))
    return F.when(k < n * p, F.aggregate(steps, start, step, lambda acc: F.exp(acc["total"]))).otherwise(F.lit(1.0))


def cutoffs(feats: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """(stratum, rule, cutoff): the lowest proven cutoff of each rule in each stratum; a few rows."""
    good = (
        labels.where(~held_out() & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("quality")).where("quality = 1")
    )
    tests = [(r, c) for r, (_, cs) in RULES.items() for c in cs]
    above = [F.count_if(F.col(r) > float(c)).alias(f"k{i}") for i, (r, c) in enumerate(tests)]
    # copies aren't independent of each other
    trials = feats.where(~F.col("base_failed")).join(good, "doc_id", "left_semi").groupBy("stratum", "doc_id").agg(*[F.max(F.expr(f)).alias(r) for r, (f, _) in RULES.items()])
    counted = trials.groupBy("stratum").agg(F.count(F.lit(1)).alias("n"), *above)
    each = counted.select("stratum", "n", F.explode(F.array(*[
        F.struct(F.lit(r).alias("rule"), F.lit(float(c)).alias("cutoff"), F.col(f"k{i}").alias("k")) for i, (r, c) in enumerate(tests)
    ])).alias("t")).select("stratum", "n", "t.*")
    proven = each.where(at_most(F.col("k"), F.col("n"), alpha) <= delta / (len(tests) * len(STRATA)))
    return proven.groupBy("stratum", "rule").agg(F.min("cutoff").alias("cutoff"))


def judge(docs: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """The counts of each document, base_failed, failed_rules and kept."""
    feats = written(features(docs), "rules")
    chosen = cutoffs(feats, labels, alpha, delta).groupBy("stratum").pivot("rule", list(RULES)).agg(F.first("cutoff"))
    # one row a stratum, so its size is bound by the table of strata
    failed = F.array_compact(F.array(*[F.when(F.expr(f"{f} > `{r}`"), F.lit(r)) for r, (f, _) in RULES.items()]))
    out = feats.join(F.broadcast(chosen), "stratum", "left").withColumn("failed_rules", F.array_join(failed, ","))
    return out.drop(*RULES).withColumn("kept", ~F.col("base_failed") & (F.col("failed_rules") == ""))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed_rules")


def oracle() -> str:
    tests = [(r, f, c) for r, (f, cs) in RULES.items() for c in cs]
    rule_case = " || ".join(f"CASE WHEN {f} > (SELECT min(cutoff) FROM proven p WHERE p.stratum = s.stratum AND p.rule = '{r}') THEN '{r},' ELSE '' END" for r, (f, _) in RULES.items())
    return rf"""
WITH {FOLD_SQL},
d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT row, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
        list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
g AS (SELECT row, i, words[i] || ' ' || words[i+1] || ' ' || words[i+2] AS gram
      FROM (SELECT row, words, unnest(range(1, len(words) - 1)) AS i FROM w)),
r AS (SELECT row, i, count(*) OVER (PARTITION BY row, gram) AS c FROM g),
covered AS (SELECT row, count(DISTINCT i + o) AS n_repeat_words FROM (SELECT row, i, unnest([0, 1, 2]) AS o FROM r WHERE c > 1) GROUP BY row),
f AS (SELECT w.row, doc_id, len(words)::BIGINT AS n_words, coalesce(length(array_to_string(words, '')), 0)::BIGINT AS word_chars,
        length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
        (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
        len(lines)::BIGINT AS n_lines, length(regexp_replace(text, '[^\p{{Lu}}]+', '', 'g'))::BIGINT AS n_upper
      FROM w LEFT JOIN covered USING (row)),
s AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
        CASE {" ".join(f"WHEN n_words >= {x} THEN {x}" for x in reversed(STRATA))} END AS stratum FROM f),
good AS (SELECT stratum, doc_id, {", ".join(f"max({f}) AS {r}" for r, (f, _) in RULES.items())} FROM s WHERE NOT base_failed AND doc_id IN (
        SELECT doc_id FROM labels GROUP BY doc_id HAVING max(quality) = 1) AND doc_id IN (SELECT doc_id FROM fold WHERE NOT held_out) GROUP BY stratum, doc_id),
tests AS ({" UNION ALL ".join(f"SELECT stratum, '{r}' AS rule, {c} AS cutoff, count(*) AS n, count(*) FILTER ({r} > {c}) AS k FROM good GROUP BY stratum" for r, f, c in tests)}),
proven AS (SELECT * FROM tests WHERE k < n * {ALPHA} AND list_sum(list_transform(range(k + 1), lambda i:
        exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({ALPHA}) + (n - i) * ln(1 - {ALPHA})))) <= {DELTA} / {len(tests) * len(STRATA)})
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  rtrim({rule_case}, ',') AS failed_rules, NOT base_failed AND ({rule_case}) = '' AS kept FROM s"""
