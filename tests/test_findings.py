"""Queries on small tables of their own, against their SQL twins."""

import time

import pandas as pd
from helpers import oracle, same

from feedloom.plans import registry


def _twin(spark, folder, name, **tables):
    for table, rows in tables.items():
        rows.to_parquet(f"{folder}/{table}.parquet")
    made = registry.QUERIES[name](spark, str(folder)).toPandas()
    same(made, oracle(registry.ORACLE[name], str(folder)))
    return made


def test_visible_text_has_the_references_of_its_sql(spark, tmp_path):
    html = ["<title>cut &amp</title>", "&&amp;lt; &quo; &eacute; &#39;&#x27;", "a&nbsp;\u00a0b\x0b c", "&copy;&middot;&lt;p&gt;&quot;", "", None, "<a\n>x</a> \t y"]
    _twin(spark, tmp_path, "fn2_strip_tags", pages=pd.DataFrame({"page_id": range(len(html)), "html": html}))


def test_rows_of_a_batch_with_one_key_are_stored_together(spark, tmp_path):
    """1,000,020 is changed by its own row (a multiple of 3) and named by that of 20."""
    keys = [10, 20, 30, 33, 1_000_011, 1_000_020, 1_000_030]
    part = pd.DataFrame({"p_partkey": keys, "p_name": [f"n{k}" for k in keys], "p_size": pd.Series(range(7), dtype="int32")})
    made = _twin(spark, tmp_path, "snk1_upsert", part=part)
    assert made["p_partkey"].value_counts()[1_000_020] == 2


def test_many_references_in_one_text_take_linear_time(spark):
    """Before, all references were decoded anew for each of them."""
    from pyspark.sql import functions as F

    from feedloom.functions.text import unescape

    rows = spark.range(1).select(F.expr("repeat('&amp;&eacute x &#65;', 10000)").alias("t"))
    start = time.monotonic()
    assert rows.select(F.length(unescape(F.col("t"))).alias("n")).collect()[0]["n"] == 60_000
    assert time.monotonic() - start < 60


def test_packs_on_a_shared_text_find_what_they_find_alone(spark):
    """The job lowers and cuts the text once; before, three packs did that each for itself."""
    from pyspark.sql import functions as F

    from feedloom.operators import rule_packs as R
    from feedloom.operators import verdicts as V

    texts = ["a small bag, 20 L", "too expensive; I want a cheaper one", None, "ΟΔΟΣ Σ", "İ storage organizer for travel", "made it myself: DIY", "browser dashboard app"]
    rows = spark.createDataFrame([(i, a, b, c, "s") for i, (a, b, c) in enumerate((a, b, c) for a in texts for b in texts for c in ("", None, "DIY", "Σ bag", "can't find a"))], "id int, title string, description string, category string, source string")
    text = R.text_of("title", "description", "category")
    apart = R.demand_signal(V.demand_fit(R.feasibility(R.creative(R.opportunity(rows))), text))
    shared = R.without_index(R.demand_signal(V.demand_fit(R.feasibility(R.creative(R.opportunity(R.with_index(rows, *V.OF_DEMAND)))), text)))
    assert sorted(shared.columns) == sorted(apart.columns)
    a, b = (sorted(map(str, df.select(*apart.columns).collect())) for df in (apart, shared))
    assert a == b
    plan = shared.select(F.col("signal_score"), "filter_score")._jdf.queryExecution().analyzed().toString()
    assert plan.count("lower(concat_ws(") == 1


def test_compose_computes_the_ladders_once_a_row(spark, sf, monkeypatch):
    """Before, the filter on the name was pushed below the ladders and held all of them again; each ladder lowered and cut the text for itself."""
    from feedloom.plans import jobs

    made = []
    monkeypatch.setattr(jobs, "written", lambda df, name="table": made.append(df) or df)
    jobs.pick_items(lambda name: spark.read.parquet(f"{sf}/{name}.parquet"))
    plan = made[0]._jdf.queryExecution().optimizedPlan()
    assert "Filter" not in [plan.p(i).nodeName() for i in range(40) if plan.p(i) is not None]
    # the text, the title and the category
    assert plan.toString().count(r"[^\p{L}\p{N}_]+") == 3


def test_ladders_on_shared_texts_decide_what_they_decide_alone(spark):
    from feedloom.operators import ladders as L

    titles = ["My", " my\tEDC ", "Show HN: I built a tool", "Fanny pack without zipper", "Ask about a ΒΑΓΣ", None, "Bag"]
    texts = ["a Pocket  Leather\nJournal COVER, backpocket", "Kelty\t tent and a bag/bags box", None, "", " \n", "a short  film", "a short film", "ΟΔΟΣ Σ\nİ software", "leather journal\nbackpocket", "shared workspace for agents Discussion | Link"]
    rows = [(i, a, b, c, s, False, None, None, None) for i, (a, b, c, s) in enumerate((a, b, c, s) for a in titles for b in texts for c in (None, "Design bag") for s in ("reddit", "yanko_design", "product_hunt", "hacker_news", "kickstarter", None))]
    df = spark.createDataFrame(rows, "id int, title string, description string, category string, source string, is_digital boolean, external_url string, known_name string, tagline string")
    shared = {r["id"]: r for r in L.named(df).collect()}
    apart = {r["id"]: r for r in L.identity(L.concrete(L.eligibility(df))).collect()}
    assert shared == apart and len(shared) == len(rows)
    of = lambda **k: [shared[r[0]] for r in rows if all(dict(zip(df.columns, r))[c] == v for c, v in k.items())]
    # a noun of the category tells what it is, but is no object of the text
    assert {r["eligibility_status"] for r in of(title="My", description="", source="kickstarter", category="Design bag")} == {"ELIGIBLE"}
    assert {r["concrete_reason"] for r in of(title="My", description="", source="kickstarter", category="Design bag")} == {"campaign without an object"}
    assert {r["eligibility_reason"] for r in of(title="My", description="a short film", source="reddit")} == {"film, event, album or donation"} and "film" not in of(title="My", description="a short  film", source="reddit")[0]["eligibility_reason"]
    assert {r["normalized_name"] for r in of(title=" my\tEDC ", description="a Pocket  Leather\nJournal COVER, backpocket", source="product_hunt")} == {"Pocket Leather Journal Cover"}
    assert {r["normalized_name"] for r in of(title="Bag", description="Kelty\t tent and a bag/bags box", source="reddit")} == {"Kelty Tent"}


def test_picks_are_refused_by_the_same_texts(spark):
    from pyspark.sql import functions as F

    from feedloom.operators import evidence as E
    from feedloom.operators.ladders import found

    texts = ["a Movie", "movies", "²movie", "mémovie", "short film", "short  film", "ALBUM!", "x_album", "bag dump", None, ""]
    rows = spark.createDataFrame([(x,) for x in texts], "d string")
    low = F.lower(F.concat_ws(" ", F.lit("One two three"), F.coalesce("d", F.lit(""))))
    pick = E.is_pick(F.lit("One two three"), F.col("d"), F.lit("etsy"), F.lit("PHYSICAL_PRODUCT"), F.lit(True))
    got = rows.select(pick.alias("a"), (~found(low, E.NO_PICK)).alias("b")).collect()
    assert all(r["a"] == r["b"] for r in got) and {r["a"] for r in got} == {True, False}
