"""Registration of queries, and the tables in the roles that the operators expect."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.operators.phrases import pattern

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers f(table, spark), where table(name) reads one of the tables; sql is its DuckDB twin."""

    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet"), spark)

        QUERIES[name] = run
        if sql:
            ORACLE[name] = sql
        return f

    return add


def part_records(t) -> DataFrame:
    return t("part").select(
        "p_partkey", F.concat(F.lit("https://shop.example/"), F.col("p_partkey").cast("string")).alias("url"), F.col("p_name").alias("title"), F.col("p_type").alias("description"), F.col("p_brand").alias("category"),
        F.col("p_brand").alias("source"), "p_size", "p_retailprice")


PART_SQL = "rec AS (SELECT p_partkey, 'https://shop.example/' || p_partkey AS url, p_name AS title, p_type AS description, p_brand AS category, p_brand AS source, p_size, p_retailprice FROM part)"


def doc_records(t) -> DataFrame:
    return t("documents").select("doc_id", F.concat(F.lit("https://news.example/"), F.col("doc_id").cast("string")).alias("url"), F.substring_index("text", "\n", 1).alias("title"), F.col("text").alias("description"), F.col("lang").alias("category"), "source")


DOC_SQL = "rec AS (SELECT doc_id, 'https://news.example/' || doc_id AS url, string_split(text, chr(10))[1] AS title, text AS description, lang AS category, source FROM documents)"


def sql_any(text: str, patterns, kind: str = "word") -> str:
    return f"regexp_matches({text}, '{pattern(patterns, kind).replace(chr(39), chr(39) * 2)}')"


def sql_flags(text: str, table, kind: str = "word") -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN {sql_any(text, p, kind)} THEN '{n}' END" for n, p in table.items()) + "], lambda x: x IS NOT NULL)"


def sql_padded(text: str, terms) -> str:
    return "(" + " OR ".join(f"contains({text}, '{t}')" if " " in t or "-" in t else f"contains(' ' || {text} || ' ', ' {t} ')" for t in terms) + ")"


def sql_sum(found: str, table) -> str:
    return f"coalesce(list_sum(list_transform({found}, lambda f: CASE f {' '.join(f'WHEN {chr(39)}{k}{chr(39)} THEN {v}' for k, v in table.items())} ELSE 0 END)), 0)"


def joined(name: str):
    return F.array_join(name, ",").alias(name.split(".")[-1])
