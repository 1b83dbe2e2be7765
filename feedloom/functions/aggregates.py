"""Named aggregates, composed of Spark's own."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def map_digest(entries: Column) -> Column:
    """Digest of a map that doesn't depend on the order of its keys (a row function)."""
    return F.sha2(F.to_json(F.map_from_entries(F.array_sort(F.map_entries(entries)))), 256)


def strongest(value: Column, order: Sequence[str]) -> Column:
    """Of a group the value that stands first in `order`; null if none does."""
    places = F.create_map(*[x for i, v in enumerate(order) for x in (F.lit(v), F.lit(i))])
    return F.min_by(value, places[value])


def ordered_distinct(value: Column, place: Column) -> Column:
    """The different values of a group, each where it first stands. Groups must fit a row."""
    return F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct(place.alias("p"), value.alias("v")))), lambda x: x["v"]))


def rows_digest(*columns: Column) -> list[Column]:
    """(digest_sum, digest_xor, n) of a group's rows in any order: sums of their hashes, so tables of any size need no sort and no array."""
    h = F.conv(F.substring(F.md5(F.concat_ws("|", *columns)), 1, 15), 16, 10).cast("bigint")
    return [F.sum(h.cast("decimal(38,0)")).cast("string").alias("digest_sum"), F.bit_xor(h).alias("digest_xor"), F.count(F.lit(1)).alias("n")]
