"""States kept as ledgers and event logs: snapshots, feedback, queues, deliveries, runs; and audits that hold one frame against another."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedloom.operators.merges import best_per_key, upsert


def snapshot(stored: DataFrame, column: str, value, order: str, within: str | None = None) -> DataFrame:
    """The items of one persisted snapshot, or of all below one parent (then numbered within each), with their positions."""
    w = Window.partitionBy(within or column).orderBy(order)
    return stored.where(F.col(column) == F.lit(value)).withColumn("position", F.row_number().over(w))


def feedback_state(log: DataFrame, key: str, value: str, newest: Sequence[Column], allowed: Sequence[str], cleared: str) -> DataFrame:
    """The last allowed feedback of each key; a `cleared` entry takes back what came before; other values are ignored."""
    last = best_per_key(log.where(F.col(value).isin(*allowed, cleared)), [key], newest)
    return last.where(F.col(value) != cleared)


def pending(log: DataFrame, key: str, value: str, newest: Sequence[Column], asked: str, done: str) -> DataFrame:
    """Keys that were asked for and not done since."""
    return best_per_key(log.where(F.col(value).isin(asked, done)), [key], newest).where(F.col(value) == asked)


def delivered(ledger: DataFrame | None, batch: DataFrame, key: str) -> DataFrame:
    """The ledger (key, total, delivered, status) after a batch of counts: DELIVERED if all of one chunk or more went out, else PARTIAL. What was delivered once stays so."""
    rows = batch.select(key, "total", "delivered")
    both = rows if ledger is None else upsert(ledger.select(key, "total", "delivered"), rows, [key], [F.desc("delivered")], {"delivered": "max"})
    return both.withColumn("status", F.when((F.col("delivered") == F.col("total")) & (F.col("total") > 0), "DELIVERED").otherwise("PARTIAL"))


def within_runs(rows: DataFrame, ts: str, runs: DataFrame, key: str) -> DataFrame:
    """Rows with each run (key, started, finished) of their key whose time holds them, ends included. Runs are cut by day and meet rows on key and day, so no pair of other days is made."""
    days = F.sequence(F.to_date("started"), F.to_date("finished"))
    cut = runs.select(key, "started", "finished", F.explode(days).alias("__day"))
    met = rows.withColumn("__day", F.to_date(ts)).join(cut, [key, "__day"])
    return met.where((F.col(ts) >= F.col("started")) & (F.col(ts) <= F.col("finished"))).drop("__day")


def parity(full: DataFrame, shown: DataFrame, page: str, key: str, text: str = "text", number: str = "number") -> DataFrame:
    """(rule, violations): what a rendering lost, added, reordered, changed, left blank or repeated, held against its dataset."""
    place = lambda df, name: df.withColumn(name, F.row_number().over(Window.partitionBy(page).orderBy(key)))
    a, b = place(full, "__a"), place(shown, "__b").select(key, F.col(page).alias("__page"), F.col(text).alias("__text"), F.col(number).alias("__number"), "__b")
    both = a.join(b, key, "full_outer")
    inside = F.col("__a").isNotNull() & F.col("__b").isNotNull()
    # places are compared among what both have
    seen = both.withColumn("__own", F.sum(inside.cast("int")).over(Window.partitionBy(page).orderBy("__a")))
    rules = {
        "missing": F.col("__b").isNull(), "extra": F.col("__a").isNull(), "text": inside & (F.trim("__text") != F.trim(text)), "number": inside & (F.col("__number") != F.col(number)), "blank": inside & (F.trim("__text") == "")}
    counts = seen.agg(*[F.count_if(c).alias(r) for r, c in rules.items()], F.count_if(inside & (F.col("__page") == F.col(page)) & (F.col("__b") != F.col("__own"))).alias("order"))
    twice = shown.groupBy(key).count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("duplicate"))
    one = counts.join(F.broadcast(twice))
    names = [*rules, "order", "duplicate"]
    return one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n).cast("long").alias("violations")) for n in names])).alias("r")).select("r.*")


def integrity(pinned: DataFrame, key: str, known: DataFrame, dependents: Mapping[str, DataFrame]) -> DataFrame:
    """(rule, n): pinned ids that are no number, are unknown or stand there more than once, and the rows of each table that hang on them."""
    good = pinned.select(F.col(key).try_cast("bigint").alias(key))
    some = good.where(F.col(key).isNotNull())
    keys = some.distinct()
    count = lambda df, rule: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(rule).alias("rule"), "n")
    out = count(pinned.where(F.col(key).try_cast("bigint").isNull()), "bad_id").unionByName(count(keys.join(known.select(key).distinct(), key, "left_anti"), "orphan"))
    out = out.unionByName(count(some.groupBy(key).count().where("count > 1"), "duplicate"))
    for name, rows in dependents.items():
        out = out.unionByName(count(rows.join(keys, key, "left_semi"), f"dependents_{name}"))
    return out


def foundation(stored: Mapping[str, DataFrame], batch: Mapping[str, DataFrame], key: str) -> dict[str, DataFrame]:
    """What is stored of the six frames of a projection after a batch of them.

    eligibility and evidence: the new rows count. identity: a translated name stays where the new one has none. families (family,
    state): new ones are added. members (key, family, pinned): a pinned row stays, others move to their new family, or leave without
    one. observations: flags are or-ed.
    """
    newest = [F.lit(1)]
    held = stored["members"].where("pinned")
    moved = batch["members"].where(F.col("family").isNotNull()).join(held.select(key), key, "left_anti").withColumn("pinned", F.lit(False))
    rest = stored["members"].where("NOT pinned").join(batch["members"].select(key), key, "left_anti")
    return {
        "eligibility": upsert(stored["eligibility"], batch["eligibility"], [key], newest), "identity": upsert(stored["identity"], batch["identity"], [key], newest, {"name_zh": "fill"}),
        "families": upsert(stored["families"], batch["families"], ["family"], newest, {"state": "old"}), "members": held.unionByName(moved.select(*held.columns)).unionByName(rest), "evidence": upsert(stored["evidence"], batch["evidence"], [key], newest),
        "observations": upsert(stored["observations"], batch["observations"], [key], newest, {"was_new": "or"})}
