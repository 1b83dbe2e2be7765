"""The keyed store, streams that end in it, and the phrase index, against plain versions."""

import re

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedloom.functions.storage import names_in, new_path
from feedloom.operators import merges, phrases, store
from feedloom.operators.store import KeyedStore
from feedloom.streaming import stored

SCHEMA = "a string, b string, v int, first int"


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def loop(held, batch, policy):
    """The same merge over a dictionary; of equal keys in the batch the smallest v counts."""
    best = {}
    for r in batch:
        k = r[:2]
        if k not in best or (r[2] is not None, r[2]) < (best[k][2] is not None, best[k][2]):
            best[k] = r
    for k, r in best.items():
        old = held.get(k)
        held[k] = r if old is None else (*k, *[o if policy.get(c) == "old" else n for c, o, n in zip(("v", "first"), old[2:], r[2:])])
    return held


DAY1 = [("x", "k1", 1, 1), ("y", None, 2, 1), (None, "k1", 3, 1), (None, None, 4, 1), ("z", "k2", 5, None)]
DAY2 = [(None, "k1", 30, 2), (None, "k9", 90, 2), ("x", "k1", None, 2), (None, None, 40, 2), (None, None, 41, 2), ("y", "k1", 7, 2)]


def test_upsert_with_null_and_composite_keys(spark):
    old, new = (spark.createDataFrame(d, SCHEMA) for d in (DAY1, DAY2))
    made = merges.upsert(old, new, ["a", "b"], [F.col("v")], {"first": "old"})
    want = loop(loop({}, DAY1, {}), DAY2, {"first": "old"})
    # an old value that is null is filled
    assert rows_of(made) == sorted(want.values(), key=repr)


@pytest.mark.parametrize("buckets", [1, 3, 50])
def test_store_merges_as_a_dictionary_does(spark, buckets):
    s = KeyedStore(spark, new_path(spark, "store"), T.StructType.fromDDL(SCHEMA), ["a", "b"], buckets)
    want = {}
    assert s.read().count() == 0
    for n, day in enumerate((DAY1, DAY2, DAY1[:2], [])):
        s.merge(spark.createDataFrame(day, SCHEMA), [F.col("v")], {"first": "old"}, "days", n)
        want = loop(want, day, {"first": "old"})
        assert rows_of(s.read()) == sorted(want.values(), key=repr)


def test_only_the_buckets_of_a_batch_are_written(spark):
    s = KeyedStore(spark, new_path(spark, "store"), T.StructType.fromDDL("k int, v int"), ["k"], 16)
    s.merge(spark.range(400).selectExpr("cast(id AS int) k", "0 v"), [F.col("v")])
    before = dict(s.manifest().writes)
    touched = s.merge(spark.createDataFrame([(7, 1), (1000, 1)], "k int, v int"), [F.col("v")])
    after = s.manifest().writes
    assert 1 <= len(touched) <= 2 and {b for b in after if after[b] != before.get(b)} == set(touched)
    assert s.read().count() == 401 and s.read().where("v = 1").count() == 2
    # the same rows again change no bucket at all, if asked so
    assert s.merge(spark.createDataFrame([(7, 1), (8, 0)], "k int, v int"), [F.col("v")], only_changes=True) == []
    assert s.manifest().writes == after
    assert s.vacuum() == [] and s.read().count() == 401


def test_a_batch_that_failed_is_repeated_and_counts_once(spark, monkeypatch):
    s = KeyedStore(spark, new_path(spark, "store"), T.StructType.fromDDL("k int, n int"), ["k"], 4)
    s.merge(spark.createDataFrame([(1, 1), (2, 1)], "k int, n int"), [F.col("n")], {}, "w", 0)
    batch = spark.createDataFrame([(2, 5), (3, 5)], "k int, n int")

    def dies(*_):
        raise RuntimeError("executor lost")

    with monkeypatch.context() as m:
        m.setattr(store, "put_new", dies)
        with pytest.raises(RuntimeError):
            s.merge(batch, [F.col("n")], {"n": "max"}, "w", 1)
    assert rows_of(s.read()) == [(1, 1), (2, 1)]
    s.merge(batch, [F.col("n")], {"n": "max"}, "w", 1)
    once = rows_of(s.read())
    assert once == [(1, 1), (2, 5), (3, 5)]
    assert s.merge(spark.createDataFrame([(2, 9)], "k int, n int"), [F.col("n")], {}, "w", 1) == []
    assert rows_of(s.read()) == once
    assert len(s.vacuum()) >= 1 and rows_of(s.read()) == once


def test_a_slower_writer_merges_again(spark, monkeypatch):
    s = KeyedStore(spark, new_path(spark, "store"), T.StructType.fromDDL("k int, n int"), ["k"], 2)
    own, other = store.put_new, [True]

    def raced(spark_, path, text):
        if other:
            other.clear()
            s.merge(spark.createDataFrame([(1, 7)], "k int, n int"), [F.col("n")])
        return own(spark_, path, text)

    monkeypatch.setattr(store, "put_new", raced)
    s.merge(spark.createDataFrame([(2, 8)], "k int, n int"), [F.col("n")])
    assert rows_of(s.read()) == [(1, 7), (2, 8)]


def test_filters_never_hide_a_key(spark):
    s = KeyedStore(spark, new_path(spark, "store"), T.StructType.fromDDL("k string, v int"), ["k"], 8, bitmaps=2)
    rows = spark.range(3000).selectExpr("if(id = 5, NULL, concat('key', id)) k", "1 v")
    s.merge(rows, [F.col("v")])
    asked = spark.range(2990, 3100).selectExpr("concat('key', id) k").unionByName(spark.createDataFrame([(None,), ("",)], "k string"))
    assert rows_of(s.rows_like(asked)) == sorted([(f"key{i}", 1) for i in range(2990, 3000)] + [(None, 1)], key=repr)
    # of keys that aren't there hardly any bucket is read
    assert len(s._perhaps(s.manifest(), spark.createDataFrame([(f"none{i}",) for i in range(5)], "k string"))) <= 2


def test_once_ever_survives_restarts_and_failures(spark):
    ledger = KeyedStore(spark, new_path(spark, "seen"), T.StructType.fromDDL("key bigint, run string, batch bigint"), ["key"], 4, bitmaps=1)
    out, landing, marks = (new_path(spark, n) for n in ("out", "landing", "offsets"))
    schema = "k bigint, at timestamp, n int"

    def land(rows, name):
        spark.createDataFrame(rows, "k bigint, at string, n int").withColumn("at", F.col("at").cast("timestamp")).coalesce(1).write.parquet(f"{landing}/{name}")

    def run(fail=False):
        def hand_out(found, number):
            found.write.mode("overwrite").parquet(f"{out}/batch={number}")
            if fail:
                raise RuntimeError("lost after handing out")

        stream = spark.readStream.schema(schema).parquet(f"{landing}/*")
        stored.once_ever(stream, "k", [F.col("n")], ledger, hand_out, "r", marks)

    land([(1, "2024-01-01", 1), (1, "2024-01-01", 2), (2, "2024-01-02", 3), (None, "2024-01-02", 4)], "a")
    with pytest.raises(Exception):
        run(fail=True)
    run()
    # years later, and with an older time: both are known
    land([(1, "2027-01-01", 5), (2, "2020-01-01", 6), (3, "2027-01-01", 7), (None, "2027-01-01", 8)], "b")
    run()
    run()
    assert rows_of(spark.read.schema(schema).parquet(out).select("k", "n")) == [(1, 1), (2, 3), (3, 7), (None, 4)]
    assert len(names_in(spark, out)) == 2


def test_merged_observations_count_once(spark):
    s = KeyedStore(spark, new_path(spark, "store"), T.StructType.fromDDL("k int, hit boolean"), ["k"], 4)
    landing, marks = new_path(spark, "landing"), new_path(spark, "offsets")
    shape = lambda rows: rows.groupBy("k").agg(F.bool_or("hit").alias("hit"))
    for n, rows in enumerate(([(1, True), (2, False)], [(1, False), (2, True), (3, False)])):
        spark.createDataFrame(rows, "k int, hit boolean").coalesce(1).write.parquet(f"{landing}/{n}")
        stored.merged(spark.readStream.schema("k int, hit boolean").parquet(f"{landing}/*"), s, shape, [F.col("k")], {"hit": "or"}, "o", marks)
    assert rows_of(s.read()) == [(1, True), (2, True), (3, False)]


TEXTS = [
    None, "", "bag", "Bags, and a POUCH.", "handbag", "bagss", "power bank", "power banks!", "Power  bank", "power-bank", "wi-fi", "WiFi", "2.4G radio", "élan bag", "ébag", "bag_", "_bag", "b ag", "holds up to", "hold up to", "5 L", "20l", "21 L", "10-in-1",
    "3 features", "cannot find", "can't find it", "can not find", "non-electric", "i need something", "I WANT A bag", "ultra light", "ultra-light tent", "say c++ now", "c++", "problem with",
]
TABLE = {"x": ["bag", "pouch"], "y": ["power bank"], "z": ["Wi-Fi", "2.4G"], "s": ["glass", "c++"], "w": ["power bank", "bag"]}
REGEX = {"n": ["non[- ]electric", "ultra[- ]light"], "l": [r"(?:[1-9]|1\d|20)[ -]?L"], "f": [r"\d+[- ](?:in[- ]1|features?)"], "h": ["holds? up to", "can(?:not|'t) find", "i (?:want|need) (?:a|an|something)"], "m": ["problem with", "bag"]}


@pytest.mark.parametrize("kind, table", [("word", TABLE), ("regex", REGEX), ("part", TABLE)])
def test_word_hits_change_no_flag(spark, kind, table):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, t string")
    whole = F.array_compact(F.array(*[F.when(F.coalesce(F.lower("t").rlike(phrases.pattern(p, kind)), F.lit(False)), F.lit(n)) for n, p in table.items()]))
    for r in df.select("t", phrases.flags(F.col("t"), table, kind).alias("a"), whole.alias("b")).collect():
        assert r["a"] == r["b"], r["t"]


def test_first_words_hold_for_every_match():
    lists = [r"\bfilm festival\b", r"\b(?:thoughts?|essay)\s+(?:about|on)\b", r"^show hn:\s*what\b", r"\b(?:a|b)c?d\b", r"\bx[12]y\b|\bz\b", r"\b(?:lamp|desk fan)s?\b"]
    texts = ["film festival", "thought about", "essay  on", "show hn:  what", "acd", "ad", "bcd", "x1y", "x2y", "z", "lamps", "desk fans"]
    for regex in lists:
        words = phrases.first_words(regex)
        for text in texts:
            if m := re.search(regex, text):
                assert re.match(r"\w+", m[0])[0] in words
    for regex in ("best", r"\d+ x", r"\bany.*x", r"\bopen", r".x\b", r"\b\w+ y\b"):
        assert phrases.first_words(regex) is None


def test_numbering_in_pieces_is_row_number(spark):
    import random

    from feedloom.operators.selection import numbered, numbered_apart

    random.seed(1)
    rows = [(random.choice(["hot", "hot", "hot", "b", None]), random.choice([None, 1, 2, 3]), i) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, v int, i int")
    for order, by in (([F.desc("v"), F.col("i")], ["g"]), ([F.col("v").asc_nulls_last(), F.desc("i")], []), ([F.col("v"), F.col("i")], ["g", "v"])):
        made = numbered_apart(df, "n", order, by)
        assert rows_of(made) == rows_of(numbered(df, "n", order, by))
    # rows that are alike get different numbers, and no task has them all
    alike = spark.range(400).selectExpr("'g' g", "1 v", "id")
    made = numbered_apart(alike, "n", [F.col("v")], ["g"])
    assert sorted(r["n"] for r in made.collect()) == list(range(1, 401))
    assert numbered_apart(alike.limit(0), "n", [F.col("v")], ["g"]).count() == 0


def test_similar_names_by_class(spark):
    import random
    from itertools import combinations

    from feedloom.operators.identity import name_classes, similar_classes

    random.seed(3)
    names = [("b1", f"n{i}", ["same", "three", "words"]) for i in range(600)]
    names += [("b2", f"m{i}", random.sample(["a", "b", "c", "d", "e", "hot"], random.randrange(1, 5)) + ["hot"]) for i in range(80)] + [("b2", "none", []), (None, "x", ["a"]), ("b2", None, ["a", "b"])]
    df = spark.createDataFrame(names, "g string, name string, w array<string>")
    classes = name_classes(df, "g", "name", "w")
    of = {(r["g"], r["name"]): r["class_name"] for r in classes.where("g = 'b1' OR name LIKE 'm%'").collect()}
    assert len({c for (g, _), c in of.items() if g == "b1"}) == 1
    for most in (2, 2000):
        pairs = {tuple(r) for r in similar_classes(classes, "g", 0.5, most).collect()}
        assert all(g != "b1" for g, _, _ in pairs)
        for (g, a, v), (h, b, w) in combinations([n for n in names if n[0] == "b2" and n[1] and n[2]], 2):
            near = len(set(v) & set(w)) / len(set(v) | set(w)) >= 0.5
            p, q = sorted((of[g, a], of[h, b]))
            assert near == (p == q or (g, p, q) in pairs)


def test_sides_do_not_depend_on_the_order_of_arrival(spark):
    import random
    from collections import Counter
    from datetime import datetime, timedelta

    random.seed(8)
    rows, want = [], Counter()
    for _ in range(300):
        observed = datetime(2024, 1, 10) + timedelta(hours=random.randrange(24 * 6))
        published = random.choice([None, observed, observed - timedelta(days=random.randrange(9), hours=5), observed + timedelta(hours=3)])
        at = published or observed
        day = (at - timedelta(hours=4)).replace(hour=4)
        side = "observation" if published is None else "early" if published > observed else "late" if observed >= day + timedelta(days=2) else "on_time"
        rows.append((published, observed))
        want[day, side] += 1
    for batches in (1, 5):
        random.shuffle(rows)
        s = KeyedStore(spark, new_path(spark, "sides"), T.StructType.fromDDL("day timestamp_ntz, side string, n bigint"), ["day", "side"], 3)
        landing, marks = new_path(spark, "landing"), new_path(spark, "offsets")
        for k in range(batches):
            spark.createDataFrame(rows[k::batches], "published timestamp_ntz, observed timestamp_ntz").coalesce(1).write.parquet(f"{landing}/{k}")
            stream = spark.readStream.schema("published timestamp_ntz, observed timestamp_ntz").parquet(f"{landing}/*")
            stored.noon_sides(stream, "published", "observed", s, "w", checkpoint=marks)
        assert {(r["day"], r["side"]): r["n"] for r in s.read().collect()} == want


def test_a_rebuilt_day_equals_the_day_as_it_was(spark):
    from feedloom.operators import jobs

    facts = spark.createDataFrame([(1, 1, "a", "d1"), (2, 1, "a", "d1"), (3, 1, "b", "d2"), (1, 2, "c", "d1"), (4, 3, "a", "d1")], "k int, version int, v string, day string")
    path = new_path(spark, "days")
    run = lambda day, version: jobs.publish_day(jobs.as_of(facts, ["k"], "version", version).where(F.col("day") == day).groupBy("day", "v").count(), path, "day")
    held = lambda day: rows_of(spark.read.schema("v string, count bigint, day string").parquet(path).where(F.col("day") == day).select("v", "count"))
    run("d1", 1)
    before = held("d1")
    run("d2", 3)
    run("d1", 3)
    assert held("d1") == [("a", 2), ("c", 1)] and held("d2") == [("b", 1)]
    run("d1", 1)
    assert held("d1") == before == [("a", 2)] and held("d2") == [("b", 1)]


def test_compose_is_the_loop(spark, sf):
    from collections import defaultdict

    from feedloom.plans import jobs as plan
    from feedloom.plans.registry import QUERIES

    t = lambda name: spark.read.parquet(f"{sf}/{name}.parquet")
    voices = {r["id"]: r["voices"] for r in plan.voice_counts(t).collect()}
    families = defaultdict(list)
    for r in plan.pick_items(t).collect():
        families[r["run"], r["family_key"]].append(r)
    runs = defaultdict(list)
    for (run, _), own in families.items():
        best = min(own, key=lambda r: (r["rank"], r["id"]))
        names = {r["name"] for r in own}
        runs[run].append((best, names.pop() if len(names) == 1 else best["name"], len(own)))
    want = []
    for run, choice in runs.items():
        choice.sort(key=lambda c: (c[0]["rank"], c[0]["id"]))
        chosen, full, seen = [], defaultdict(int), set()

        def add(c):
            r = c[0]
            if c in chosen or full[r["source"]] >= plan.CAPS.get(r["source"], 3) or r["dup"] in seen:
                return
            chosen.append(c)
            full[r["source"]] += 1
            seen.add(r["dup"])

        for basket, most in plan.QUOTAS.items():
            for c in choice:
                if c[0]["basket"] == basket:
                    if sum(x[0]["basket"] == basket for x in chosen) >= most:
                        break
                    add(c)
        for c in choice:
            if len(chosen) >= 20:
                break
            add(c)
        want += [(c[0]["id"], k, c[1], c[2], voices.get(c[0]["id"], 0), run) for k, c in enumerate(chosen, 1)]
    assert rows_of(QUERIES["job5_compose"](spark, sf)) == sorted(want, key=repr) and len(want) > 5
