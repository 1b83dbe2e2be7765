"""Sources by name: a format, a stated schema, options, and the projection to the library's record."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RECORD = ("url", "title", "description", "category", "source")


@dataclass(frozen=True)
class SourceSpec:
    """How files of a source are read and which columns (or expressions) make its records; what has none is null."""

    format: str
    schema: str
    columns: Mapping[str, str | Column]
    options: Mapping[str, str] = field(default_factory=dict)
    keep: Callable[[DataFrame], DataFrame] = lambda df: df

    def read(self, spark: SparkSession, path: str, name: str) -> DataFrame:
        raw = self.keep(spark.read.format(self.format).options(**self.options).schema(self.schema).load(path))
        of = lambda c: F.expr(v) if isinstance(v := self.columns[c], str) else v
        return raw.select(*[(of(c) if c in self.columns else F.lit(name if c == "source" else None)).cast("string").alias(c) for c in RECORD])


SOURCES: dict[str, SourceSpec] = {}


def source(name: str, spec: SourceSpec) -> None:
    if name in SOURCES:
        raise ValueError(f"there is a source {name} already")
    SOURCES[name] = spec


def records(spark: SparkSession, paths: Mapping[str, str]) -> DataFrame:
    """The records of several sources, by name and path."""
    out = None
    for name, path in paths.items():
        one = SOURCES[name].read(spark, path, name)
        out = one if out is None else out.unionByName(one)
    return out


source("campaigns", SourceSpec("csv", "id string, name string, blurb string, project_url string, category_name string", {"url": "project_url", "title": "trim(name)", "description": "blurb", "category": "category_name"}, {"header": "true", "escape": '"'}, lambda df: df.where("trim(name) != ''")))
source("posts", SourceSpec("json", "id string, title string, selftext string, subreddit string, url string", {"url": "url", "title": "title", "description": "selftext", "category": "subreddit"}))
source("feed", SourceSpec("xml", "title string, link string, description string, category array<string>", {"url": "link", "title": "trim(title)", "description": "description", "category": "category[0]"}, {"rowTag": "item", "ignoreNamespace": "true"}))
