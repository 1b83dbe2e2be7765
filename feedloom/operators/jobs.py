"""Composite jobs: the library's operators put together, each stage written where several readers need it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.functions.storage import written
from feedloom.operators import merges as M
from feedloom.operators import picks as P
from feedloom.operators import rule_packs as R
from feedloom.operators import scoring as S
from feedloom.operators import selection as SEL
from feedloom.operators import titles as TT
from feedloom.operators import verdicts as V
from feedloom.operators.store import KeyedStore

#: Order of the strengths of evidence.
STRENGTHS = ["STRONG", "MODERATE", "WEAK"]


def classified(records: DataFrame, context: str | None = None) -> DataFrame:
    """Records with the verdicts of all packs, written once for all that follows; `context` as in opportunity()."""
    text = R.text_of("title", "description", "category")
    # the text is lowered and cut into words once for all packs
    rows = R.opportunity(R.with_index(records, *V.OF_DEMAND), context)
    rows = R.without_index(R.demand_signal(V.demand_fit(R.feasibility(R.creative(rows)), text)))
    return written(rows.withColumns({"clarity": F.lit(60), "backers": F.lit(None).cast("double"), "funded": F.lit(None).cast("double")}), "classified")


def candidates(rows: DataFrame) -> DataFrame:
    """The best candidate of each URL, from all builders."""
    pool = S.inspirations(rows).unionByName(S.demands(rows)).unionByName(S.validated(rows))
    return M.best_per_key(pool, ["source_url"], [F.desc("candidate_score"), F.col("candidate_type")])


def ledger(rows: DataFrame, known: DataFrame, url: str = "url") -> DataFrame:
    """(source, fetched, new_count, updated_count, rejected, uncertain) of classified records, against the URLs that are stored."""
    met = rows.join(known.select(url).distinct().withColumn("__known", F.lit(True)), url, "left")
    old = F.coalesce("__known", F.lit(False))
    return met.groupBy("source").agg(
        F.count(F.lit(1)).alias("fetched"), F.count_if(~old).alias("new_count"), F.count_if(old).alias("updated_count"), F.count_if(F.col("filter_status") == "rejected").alias("rejected"), F.count_if(F.col("filter_status") == "uncertain").alias("uncertain"))


def ingest(records: DataFrame, stored: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(records to store, candidates, ledger) of a batch of records against the stored ones (url)."""
    rows = classified(records)
    return rows, candidates(rows), ledger(rows, stored)


def ingest_into(records: DataFrame, held: KeyedStore, pool: KeyedStore, context: str | None = None, writer: str | None = None, number: int = 0) -> DataFrame:
    """The ledger of a batch of records whose verdicts go into the store of records (by url) and whose candidates go into the pool (by source_url).

    What the ledger calls known is what was stored before the batch. One classified table serves all three outputs.
    """
    rows = classified(records, context)
    made = written(ledger(rows, held.rows_like(rows.select("url"))), "ledger")
    held.merge(rows, [F.desc("filter_score"), F.col("title")], None, writer, number)
    pool.merge(candidates(rows), [F.desc("candidate_score"), F.col("candidate_type")], None, writer, number)
    return made


def budgeted(rows: DataFrame, known: DataFrame, key: str, order: list[Column], budget: int) -> DataFrame:
    """The rows that a run's budget covers: those that aren't known yet first, then the others, each in order. Only `budget` rows reach the driver's side of the sort."""
    met = rows.join(known.select(key).distinct().withColumn("__known", F.lit(True)), key, "left")
    return met.orderBy(F.col("__known").isNotNull(), *order).limit(budget).drop("__known")


def daily_choice(classified_rows: DataFrame, known: DataFrame, key: str, budget: int) -> DataFrame:
    """What a daily run shows: of the candidates those within the budget, with chosen_rank, or why one was left out, by the quotas of themes (sources) and of software."""
    ready = classified_rows.where("filter_status = 'candidate'").select(key, "source", "title", "opportunity_type", "filter_score")
    order = [F.desc("filter_score"), F.col(key)]
    within = budgeted(ready, known, key, order, budget).withColumns({"run": F.lit("day"), "theme": F.col("source")})
    return SEL.quota_choice(within, "run", order, F.col("opportunity_type") == "software", F.col("filter_score")).drop("run", "theme")


def as_of(facts: DataFrame, keys: list[str], version: str, at: int) -> DataFrame:
    """Of each key the fact that was valid at a version: the newest that isn't newer."""
    return M.best_per_key(facts.where(F.col(version) <= at), keys, [F.desc(version)])


def publish_day(results: DataFrame, path: str, day: str) -> None:
    """Puts the results of one day in the place of what was published for it; other days keep their files. `day` is the column of the day."""
    results.write.partitionBy(day).option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)


def rescored_slice(records: DataFrame, stored: DataFrame, source: str, kind: str = "consumer_trend") -> DataFrame:
    """Stored candidates (url, candidate_type, score) with those of one kind replaced by what the present rules make of one source."""
    own = R.commodity(TT.trend_item(records.where(F.col("source") == source))).where("trend_status = 'candidate' AND commodity_status != 'COMMODITY'")
    fresh = own.select("url", F.lit(kind).alias("candidate_type"), F.rint((F.col("trend_score") + F.col("commodity_score")) / 2).cast("int").alias("score"))
    return M.replace_slice(stored, fresh, "candidate_type", kind)


def discovery(facts: DataFrame, family: str, at: str, source: str, points: str, since: Column | None = None, until: Column | None = None) -> DataFrame:
    """Families of the facts in a window (both ends None: of a run) with sources, newest time, points and strength, in display order within each strength.

    Numbering runs within a strength; the order over all is (strength's rank, place).
    """
    rows = facts if since is None else facts.where(F.col(at) >= since)
    rows = rows if until is None else rows.where(F.col(at) < until)
    sums = rows.groupBy(family).agg(F.count_distinct(source).alias("sources"), F.max(at).alias("last_seen"), F.round(F.sum(points), 2).alias("points"))
    judged = sums.withColumn("strength", S.strength(F.col("points"), F.col("sources")))
    return SEL.numbered_apart(judged.withColumn("strength_rank", SEL.ranked(F.col("strength"), STRENGTHS)), "place", [F.desc("last_seen"), F.col(family)], ["strength"])


def collected_voice(rows: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """(saved, existing) of texts against the stored ones, by their identity key."""
    return M.upsert_counts(stored, rows, [key]).withColumnRenamed("duplicates", "existing")


def directions(items: DataFrame, run: str, family: str) -> DataFrame:
    """One row for each family of a run: its best item (smallest rank, then id) with all its columns, the name that all its items agree on, else the best item's, and how many items it has."""
    rest = [c for c in items.columns if c not in (run, family, "rank", "id")]
    agreed = F.when(F.min("name") == F.max("name"), F.min("name"))
    best = items.groupBy(run, family).agg(F.min(F.struct("rank", "id", *rest)).alias("best"), agreed.alias("agreed"), F.count(F.lit(1)).alias("members"))
    return best.select(run, family, "best.rank", "best.id", *[f"best.{c}" for c in rest if c != "name"], F.coalesce("agreed", "best.name").alias("name"), "members")


def compose(items: DataFrame, run: str, family: str, voices: DataFrame, quotas: dict[str, int], caps: dict[str, int], other_cap: int, target: int, path: str) -> DataFrame:
    """Picks of each run, (run, id, pick_order, name, members, voices), published as a snapshot with a partition for each run.

    items (run, id, rank, name, family, basket, source, dup) become directions, one a family; of those the baskets are filled. voices
    (id, voices) tells how many users' texts an item has. A run that is composed again replaces its own partition only.
    """
    choice = written(directions(items, run, family), "directions")
    picks = P.basket_picks(choice, run, [F.col("rank"), F.col("id")], quotas, caps, other_cap, target)
    out = picks.join(choice.select(run, "id", "name", "members"), [run, "id"]).join(voices, "id", "left").fillna(0, ["voices"])
    published = out.select("id", "pick_order", "name", "members", "voices", run)
    publish_day(published, path, run)
    return items.sparkSession.read.schema(published.schema).parquet(path)
