"""Rule packs as data: flags with patterns and weights, and a table of decisions, compiled to column expressions."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.operators.phrases import clamp, flags, weights


@dataclass(frozen=True)
class RulePack:
    """A record's flags are those with a matching pattern; its score is base plus their weights, within 0 and 100; its status that of the first decision (least score, status) reached."""

    table: Mapping[str, Sequence[str]]
    weight: Mapping[str, int]
    decisions: Sequence[tuple[int, str]]
    otherwise: str
    base: int = 0
    kind: str = "word"
    #: Flags that decide alone.
    forced: Mapping[str, str] = field(default_factory=dict)

    @classmethod
    def of_rows(cls, rows: Iterable[tuple[str, str, int]], decisions: Sequence[tuple[int, str]], otherwise: str, **more) -> RulePack:
        """From rows (flag, pattern, weight), such as the rows of a rule table; a flag's weight is that of its last row."""
        table: dict[str, list[str]] = {}
        weight: dict[str, int] = {}
        for flag, pattern, w in rows:
            table.setdefault(flag, []).append(pattern)
            weight[flag] = w
        return cls(table, weight, decisions, otherwise, **more)

    def verdict(self, text: Column) -> Column:
        """flags of the text; see applied() for score and status."""
        return flags(text, self.table, self.kind)

    def applied(self, df: DataFrame, text: Column, prefix: str) -> DataFrame:
        """Adds prefix_flags, prefix_score and prefix_status."""
        found, score, status = f"{prefix}_flags", f"{prefix}_score", f"{prefix}_status"
        out = df.withColumn(found, self.verdict(text)).withColumn(score, clamp(F.lit(self.base) + weights(F.col(found), self.weight)))
        result = F.lit(self.otherwise)
        for least, name in reversed(self.decisions):
            result = F.when(F.col(score) >= least, name).otherwise(result)
        for flag, name in self.forced.items():
            result = F.when(F.array_contains(found, flag), name).otherwise(result)
        return out.withColumn(status, result)
