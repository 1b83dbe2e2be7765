"""Verdicts of models outside: a frame of requests goes out, a frame of responses comes in; nothing is called from here."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.operators.merges import best_per_key

KEY = ["candidate_id", "provider", "model", "version"]


def requests(candidates: DataFrame, answered: DataFrame, provider: str, model: str, version: str, limit: int | None = None) -> DataFrame:
    """The best candidates (candidate_id, candidate_score, payload) without an answer of this model and version; `limit` is the budget of calls, if there is one."""
    own = candidates.withColumns({"provider": F.lit(provider), "model": F.lit(model), "version": F.lit(version)})
    open_ = own.join(answered.select(*KEY).distinct(), KEY, "left_anti").select(*KEY, "candidate_score", "payload")
    return open_ if limit is None else open_.orderBy(F.desc("candidate_score"), "candidate_id").limit(limit)


def with_responses(candidates: DataFrame, responses: DataFrame, schema: str) -> DataFrame:
    """Candidates with the newest response (KEY, received, response as JSON) that parses, as a struct `answer`; null without one."""
    parsed = responses.withColumn("answer", F.from_json("response", schema)).where(F.col("answer").isNotNull())
    last = best_per_key(parsed, ["candidate_id"], [F.desc("received"), F.desc("version")]).select("candidate_id", "answer")
    return candidates.join(last, "candidate_id", "left")
