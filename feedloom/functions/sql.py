"""The library's functions for SQL: row functions as SQL expressions, and a walker for JSON keys at any depth."""

from __future__ import annotations

import json
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf, udtf

#: Name, arguments, result and body of each row function. They stay inside Spark's code, as the optimizer puts the body in place.
FUNCTIONS = {
    "collapse": ("x STRING", "STRING", "trim(regexp_replace(x, '\\\\s+', ' '))"),
    "visible_text": ("html STRING", "STRING", "trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' '), '\\\\s+', ' '))"),
    "parse_number": ("x STRING", "DOUBLE", "try_cast(regexp_replace(x, '[,%\\\\s]', '') AS DOUBLE)"),
    "half_even": ("x DOUBLE", "INT", "cast(rint(x) AS INT)"),
    "bounded": ("x INT, low INT, high INT", "INT", "greatest(low, least(high, x))"),
    "short_key": ("prefix STRING, x STRING", "STRING", "concat(prefix, substring(sha2(x, 256), 1, 16))"),
    "url_host": ("url STRING", "STRING", "lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1))"),
}


def strings(value: object) -> Iterable[str]:
    """All strings in a JSON value, at any depth, in order."""
    todo = [value]
    while todo:
        v = todo.pop()
        if isinstance(v, str):
            yield v
        elif isinstance(v, (list, dict)):
            todo += reversed(list(v.values()) if isinstance(v, dict) else v)


def values_of(text: str | None, keys: Iterable[str]) -> list[str]:
    """Values of the keys at any depth of a JSON text, cut at commas, the first of those that differ in case only."""
    wanted, found = {k.lower() for k in keys}, {}
    try:
        todo = [(False, json.loads(text or "null"))]
    except ValueError:
        return []
    while todo:
        is_wanted, v = todo.pop()
        if is_wanted:
            for part in (x.strip() for s in strings(v) for x in s.split(",")):
                if part:
                    found.setdefault(part.casefold(), part)
        elif isinstance(v, (dict, list)):
            todo += reversed([(k.lower() in wanted, x) for k, x in v.items()] if isinstance(v, dict) else [(False, x) for x in v])
    return list(found.values())


@pandas_udf(T.ArrayType(T.StringType()))
def json_values(text: pd.Series, keys: pd.Series) -> pd.Series:
    return pd.Series([values_of(t, k) for t, k in zip(text, keys)])


@udtf(returnType=T.StructType([T.StructField("path", T.StringType()), T.StructField("value", T.StringType())]))
class JsonLeaves:
    """A row for each scalar of a JSON text: where it stands, and its value as text."""

    def eval(self, text: str):
        try:
            todo = [("$", json.loads(text or "null"))]
        except ValueError:
            return
        while todo:
            path, v = todo.pop()
            if isinstance(v, dict):
                todo += reversed([(f"{path}.{k}", x) for k, x in v.items()])
            elif isinstance(v, list):
                todo += reversed([(f"{path}[{i}]", x) for i, x in enumerate(v)])
            elif v is not None:
                yield path, v if isinstance(v, str) else json.dumps(v)


def register(spark: SparkSession) -> None:
    """Makes the functions known to SQL in this session."""
    for name, (arguments, result, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {result} RETURN {body}")
    spark.udf.register("json_values", json_values)
    spark.udtf.register("json_leaves", JsonLeaves)
