"""Operators on small frames: default rule packs, order-dependent choices against plain loops, edge rows."""

import random

from pyspark.sql import functions as F

from feedloom.operators import identity, merges, rule_packs, scoring, selection

RECORD = "title string, description string, category string, source string"


def test_default_packs(spark):
    rows = [
        ("Key organizer clip", "small, compact and lightweight holder for travel", "EDC", "shop"), ("Browser extension", "an AI agent dashboard", "software", "launches"), ("Bluetooth speaker", "wireless", "audio", "shop"),
        ("Industrial design", "concept design of a chair", "x", "yanko_design"), (None, None, None, None)]
    df = spark.createDataFrame(rows, RECORD)
    kinds = [(r["opportunity_type"], r["filter_status"]) for r in rule_packs.opportunity(df).collect()]
    assert kinds == [("physical", "candidate"), ("software", "candidate"), ("physical", "rejected"), ("inspiration", "candidate"), ("uncertain", "uncertain")]
    feas = rule_packs.feasibility(df).collect()
    assert feas[0]["feasibility_status"] == "REVIEW" and feas[2]["risk_flags"] == ["wireless", "high_certification_risk"] and feas[2]["feasibility_score"] == 16
    demand = rule_packs.demand_signal(spark.createDataFrame([("Looking for a bag", "too expensive, I can't find one cheaper", "", "")], RECORD)).first()
    assert (demand["signal_status"], demand["signal_type"]) == ("HIGH", "price_pain")
    spec = rule_packs.specificity(spark.createDataFrame([("Wallet", "problem: too bulky, need storage", "", "", "demand_opportunity", ["clear_feature_gap"])], RECORD + ", candidate_type string, signals array<string>")).first()
    assert spec["specificity_status"] == "SPECIFIC"


def test_families(spark):
    names = ["Travel backpack 20-30L", "Camera backpack", "Fanny pack", "Camping pillow", "Insulated bottles", "Leather wallets", "Gizmo thing", "the best", None]
    got = [r["family_key"] for r in identity.family(spark.createDataFrame([(n, "PHYSICAL") for n in names], "name string, kind string"), "name", "kind").collect()]
    assert got == ["physical:travel-backpack-20-30l", "physical:backpack-camera", "physical:fanny-waist-pack", "physical:travel-backpacking-pillow", "physical:insulated-water-bottle", "physical:wallet", "physical:gizmo-thing", None, None]


def test_quota_choice_is_the_loop(spark):
    random.seed(4)
    rows = [(run, i, random.choice("abc"), random.randrange(50, 70), random.random() < 0.4) for run in range(4) for i in range(40)]
    got = {(r["run"], r["id"]): (r["chosen_rank"], r["exclusion"]) for r in selection.quota_choice(
        spark.createDataFrame(rows, "run long, id long, theme string, score long, software boolean"), "run", [F.desc("score"), F.col("id")], F.col("software"), F.col("score")).collect()}
    for run in range(4):
        chosen, themes, soft = 0, {}, 0
        for _, i, theme, score, software in sorted((r for r in rows if r[0] == run), key=lambda r: (r[4], -r[3], r[1])):
            if score < 55:
                want = (None, "quality_score")
            elif chosen >= 10:
                want = (None, "software_quota" if software else "lower_final_score")
            elif themes.get(theme, 0) >= 3:
                want = (None, "theme_quota")
            elif software and soft >= 2:
                want = (None, "software_quota")
            else:
                chosen, soft = chosen + 1, soft + software
                themes[theme] = themes.get(theme, 0) + 1
                want = (chosen, None)
            assert got[run, i] == want


def test_greedy_distinct_is_the_loop(spark):
    random.seed(5)
    n = 60
    edges = {(random.randrange(n), random.randrange(n)) for _ in range(90)}
    edges = [(a, b) for a, b in edges if a != b]
    nodes = spark.createDataFrame([(i, (i * 37) % n) for i in range(n)], "id long, rank long")
    got = {r["id"]: r["kept"] for r in selection.greedy_distinct(nodes, spark.createDataFrame(edges, "a long, b long")).collect()}
    kept = set()
    for i in sorted(range(n), key=lambda i: (i * 37) % n):
        if not any((i, k) in edges or (k, i) in edges for k in kept):
            kept.add(i)
    assert got == {i: i in kept for i in range(n)}


def test_market_curve_and_gate(spark):
    df = spark.createDataFrame([(None, None), (50.0, None), (None, 150.0), (600.0, 2500.0)], "b double, f double")
    assert [r[0] for r in df.select(scoring.market_validation(F.col("b"), F.col("f"))).collect()] == [0, 30, 49, 75]


def test_upsert_policies(spark):
    old = spark.createDataFrame([(1, "a", 5, True), (2, "b", 7, False)], "k long, x string, n long, f boolean")
    batch = spark.createDataFrame([(2, None, 3, True), (3, "c", 1, False), (3, "d", 2, False)], "k long, x string, n long, f boolean")
    got = sorted(map(tuple, merges.upsert(old, batch, ["k"], [F.desc("n")], {"x": "fill", "n": "max", "f": "or"}).collect()))
    assert got == [(1, "a", 5, True), (2, "b", 7, True), (3, "d", 2, False)]
    assert tuple(merges.upsert_counts(old, batch, ["k"]).first()) == (1, 2)


def test_inserts_without_lost_rows(spark):
    random.seed(9)
    for trial in range(6):
        old = [(random.randrange(12), f"u{random.randrange(12)}") for _ in range(4)]
        old = list({k: (k, u) for k, u in old}.values())
        old = list({u: (k, u) for k, u in old}.values())
        batch = [(random.randrange(12), f"u{random.randrange(12)}", i) for i in range(14)] + [(None, "u1", 20), (3, None, 21), (None, None, 22), (None, None, 23)]
        got = merges.insert_absent(
            spark.createDataFrame([(k, u, -1) for k, u in old], "k long, u string, n long"), spark.createDataFrame(batch, "k long, u string, n long").repartition(3), ["k", "u"], [F.col("n")]).collect()
        keys, urls, want = {k for k, _ in old}, {u for _, u in old}, [(k, u, -1) for k, u in old]
        for k, u, n in batch:
            if (k is None or k not in keys) and (u is None or u not in urls):
                want.append((k, u, n))
                keys |= {k} - {None}
                urls |= {u} - {None}
        assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    first = merges.insert_absent(spark.createDataFrame([(1, "u1")], "k long, u string"), spark.createDataFrame([(2, "u1"), (2, "u3")], "k long, u string"), ["k", "u"], [F.col("u")])
    assert sorted(map(tuple, first.collect())) == [(1, "u1"), (2, "u3")]


def test_basket_picks_are_the_loop(spark):
    from feedloom.operators import picks

    random.seed(10)
    rows = [(run, i, random.choice("pqr"), random.choice("st"), random.choice([None, f"d{i}", f"d{random.randrange(8)}"]), random.random()) for run in range(4) for i in range(60)]
    baskets, caps = {"q": 3, "p": 2}, {"s": 4}
    got = {(r["run"], r["id"]): r["pick_order"] for r in picks.basket_picks(spark.createDataFrame(rows, "run long, id long, basket string, source string, dup string, x double"), "run", [F.desc("x")], baskets, caps, 3, 9).collect()}
    want = {}
    for run in range(4):
        items, chosen, counts, seen, per = sorted((r for r in rows if r[0] == run), key=lambda r: -r[5]), [], {}, set(), dict.fromkeys(baskets, 0)

        def add(r):
            if r[1] in chosen or counts.get(r[3], 0) >= caps.get(r[3], 3) or (r[4] is not None and r[4] in seen):
                return
            chosen.append(r[1])
            counts[r[3]] = counts.get(r[3], 0) + 1
            seen.add(r[4])
            if r[2] in per:
                per[r[2]] += 1

        for basket, most in baskets.items():
            for r in items:
                if r[2] == basket:
                    add(r)
                    if per[basket] >= most:
                        break
        for r in items:
            if len(chosen) >= 9:
                break
            add(r)
        want |= {(run, i): k + 1 for k, i in enumerate(chosen)}
    assert got == want
    # 5,000 different keys in one run
    many = spark.range(5000).selectExpr("1L AS run", "id", "'p' AS basket", "'s' AS source", "concat('d', id) AS dup")
    made = picks.basket_picks(many, "run", [F.col("id")], baskets, caps, 3, 9)
    assert [r["id"] for r in made.orderBy("pick_order").collect()] == [0, 1, 2, 3]


def test_changes_with_nulls(spark, tmp_path):
    from feedloom.streaming import changes

    rows = [(1, i, v) for i, v in enumerate([None, None, "a", "a", None, None, "b"])]
    spark.createDataFrame(rows, "k long, n long, v string").coalesce(1).write.parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema("k long, n long, v string").parquet(f"file://{tmp_path}/in")
    assert sorted(r["n"] for r in changes.finished(changes.emit_changes(stream, "k", "n", "v")).collect()) == [0, 2, 4, 6]


def test_leads_are_what_matches_begin_with():
    import re

    from feedloom.operators import phrases, rule_packs, verdicts

    assert phrases.leads("pockets?") == ["pocket"] and phrases.leads("a|b") == [] and phrases.leads("(?:must|should) go") == ["must", "should"] and phrases.leads(r"\d+ features") == []
    assert phrases.leads("organi[sz](?:e|er)") == ["organi"] and phrases.leads("(?:a|b)? c") == []
    samples = ["organiser", "pockets", "can't find", "made it personally", "needs to work with", "must", "doesn't work", "recommended", "i need an"]
    for p in [p for rules in rule_packs.SIGNALS.values() for p, _ in rules] + [p for own in verdicts.DEMAND_FLAGS.values() for p in own]:
        for text in samples:
            if (m := re.search(p, text, re.I)) and (starts := phrases.leads(p)):
                assert any(m[0].lower().startswith(s) for s in starts)


def test_ladders_on_known_records(spark):
    from feedloom.operators import ladders

    rows = [
        ("Show HN: I built a CSV cleaner", "tool for data", "", "hacker_news", "SOFTWARE_PRODUCT", "CONCRETE", "a CSV cleaner"), ("A movie about birds", "nothing else", "", "indiegogo", "NON_PRODUCT_CONTENT", "NON_CONCRETE", None),
        ("My", "A pocket leather journal cover I made", "", "reddit", "PHYSICAL_PRODUCT", "CONCRETE", "Pocket Leather Journal Cover"), ("Desk lamp of oak", "", "", "yanko_design", "PRODUCT_DESIGN", "CONCRETE", "Desk Lamp"),
        ("Packing list for Peru", "a bag", "", "reddit", "PHYSICAL_PRODUCT", "NON_CONCRETE", None), ("Backpack or pouch", "which bag", "", "reddit", "PHYSICAL_PRODUCT", "AMBIGUOUS", None), (None, None, None, None, "AMBIGUOUS", "AMBIGUOUS", None),
        ("Waxed thing", "hand made", "", "etsy", "PHYSICAL_PRODUCT", "CONCRETE", "Waxed thing")]
    df = spark.createDataFrame([r[:4] for r in rows], RECORD).withColumns({"is_digital": F.lit(None).cast("boolean"), "external_url": F.lit(None).cast("string"), "known_name": F.lit(None).cast("string"), "tagline": F.lit(None).cast("string"), "n": F.monotonically_increasing_id()}).coalesce(1)
    got = [(r["content_type"], r["concrete_status"], r["normalized_name"]) for r in ladders.identity(ladders.concrete(ladders.eligibility(df))).orderBy("n").collect()]
    assert got == [r[4:] for r in rows]


def test_lexicon_on_known_names(spark):
    from feedloom.operators import lexicon

    rows = [
        ("Pocket Hose Ballistic 100 FT garden hose", "", "Pocket Hose Ballistic 100 FT 伸缩花园水管"), ("The Acme X9 Pro Keyboard", "", "Acme X9 键盘"), ("Task tracker app", "SOFTWARE_PRODUCT", "Task 追踪工具 应用"), ("Plain words", "SOFTWARE_PRODUCT", "Plain words 软件"),
        ("Oral: brush toothbrush", "SOFTWARE_PRODUCT", "brush 牙刷"), ("Odd shape", "PRODUCT_DESIGN", "Odd shape 产品设计"), ("Odd shape", "", "Odd shape"), (None, "", "")]
    made = spark.createDataFrame([(i, *r[:2]) for i, r in enumerate(rows)], "i long, n string, k string").select("i", lexicon.lexicon_name(F.col("n"), F.col("k")).alias("x")).orderBy("i").collect()
    assert [r["x"] for r in made] == [r[2] for r in rows]


def test_whole_sentences_and_schemas(spark):
    from feedloom.plans import registry

    made = {r["doc_id"]: r for r in registry.QUERIES["fn15_first_sentence"](spark, "/root/testdata/sf0.001").collect()}
    for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect():
        import re

        parts = re.split(r"(?<=[.!?])\s+", re.sub(r"[ \t\n\x0b\f\r]+", " ", r["text"]).strip(" "))[:4]
        text = ""
        for s in parts:
            if len(text) + len(s) + 1 <= 720:
                text = f"{text} {s}".strip(" ")
        assert (made[r["doc_id"]]["first_sentence"], made[r["doc_id"]]["excerpt"]) == (parts[0], text)
    found = {(r["name"], r["column"]): r["ok"] for r in registry.QUERIES["qa7_schema"](spark, "/root/testdata/sf0.001").collect()}
    assert found == {("documents", "doc_id"): True, ("documents", "text"): True, ("part", "p_partkey"): True, ("part", "p_size"): True, ("part", "p_color"): False}


def test_noon_stream_is_its_batch(spark):
    """Days that the watermark has closed: those that end a day or more before the newest event."""
    from datetime import timedelta

    from feedloom.plans import registry

    sf = "/root/testdata/sf0.001"
    newest = spark.read.parquet(f"{sf}/events.parquet").agg(F.max("ts")).first()[0]
    batch = {r["day"]: r["n"] for r in registry.QUERIES["fn10_noon_window"](spark, sf).collect()}
    made = {r["day"]: r["n"] for r in registry.QUERIES["str2_noon_stream"](spark, sf).collect()}
    assert made == {d: n for d, n in batch.items() if d + timedelta(days=1) <= newest - timedelta(days=1)}


def test_packing_is_the_loop(spark):
    from feedloom.operators import selection

    random.seed(11)
    rows = [(random.choice("ab"), i, random.choice([0, 1, 5, 20, 90, 130])) for i in range(600)]
    got = {r["i"]: r["chunk"] for r in selection.packed(spark.createDataFrame(rows, "g string, i long, s long").repartition(5), "g", "i", "s", 100).collect()}
    for g in "ab":
        chunk = filled = 0
        for _, i, s in (r for r in rows if r[0] == g):
            if filled and filled + s > 100:
                chunk, filled = chunk + 1, 0
            filled += s
            assert got[i] == chunk


def test_character_references_are_the_standard_librarys(spark):
    import html
    from html.entities import html5

    from feedloom.functions.text import unescape

    texts = ["", None, "no reference", "a & b", "&", "&&amp;&", "&;", "&#;", "&#x;", "&#xZ;", "&notit; &notin; &ampx &amp=1 &copyright", "&lt;b&gt;&amp;lt;", "x&nbsp;y", "&Aacute&aacute;", "&#0039;&#x0027;&#X27", "&#99999999999999999999;", "&#xffffffffff;", "&#x000000000000041;"]
    texts += [f"<{n} &{n} &{n.lower()} &{n}x" for n in html5] + [f"&#{n};&#x{n:x} " for n in [*range(0, 400), *range(0xD7F0, 0xE010, 7), *range(0xFDC0, 0xFE00), 0xFFFE, 0xFFFF, 0x1FFFE, 0x1F600, 0x10FFFF, 0x110000]]
    made = {r["t"]: r["u"] for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", unescape(F.col("t")).alias("u")).collect()}
    wrong = [(t, made[t], html.unescape(t)) for t in texts if t is not None and made[t] != html.unescape(t)]
    assert not wrong, wrong[:5]
    assert made[None] is None
