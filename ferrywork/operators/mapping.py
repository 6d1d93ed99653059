"""Field mappings, null policies and schema fields as DataFrame transformations."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrywork.functions.values import CONVERSIONS


@dataclass(frozen=True)
class FieldRule:
    """action: rename, drop or convert (which writes `target`, else the source itself, and keeps the source)."""

    source: str
    target: str = ""
    action: str = ""
    kind: str = ""

    def resolved(self) -> str:
        return self.action or ("rename" if self.target and self.target != self.source else "")


def apply_rule(df: DataFrame, rule: FieldRule) -> DataFrame:
    """A rule whose source is missing changes nothing."""
    if rule.source not in df.columns:
        return df
    action = rule.resolved()
    if action == "drop":
        return df.drop(rule.source)
    if action == "rename":
        return (df.drop(rule.target) if rule.target in df.columns else df).withColumnRenamed(rule.source, rule.target)
    if action == "convert":
        return df.withColumn(rule.target or rule.source, CONVERSIONS[rule.kind](F.col(rule.source)))
    return df


def map_fields(df: DataFrame, rules: dict[str, list[FieldRule]], table: str) -> DataFrame:
    """The table's own rules in order, else those of '*'; each sees what the ones before it made."""
    return reduce(apply_rule, rules.get(table, rules.get("*", [])), df)


def null_policy(df: DataFrame, policy: str) -> tuple[DataFrame, DataFrame | None]:
    """Rows that go on, and rejected rows (policy `error`). `replace` puts '' for nulls of text columns and makes other
    columns text; `drop` keeps typed rows as they are, as a missing value and a null are the same in a column."""
    if policy in ("passthrough", "drop"):
        return df, None
    if policy == "replace":
        return df.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in df.columns)), None
    if policy == "error":
        bad = reduce(lambda a, b: a | b, (F.col(c).isNull() for c in df.columns))
        return df.where(~bad), df.where(bad)
    raise ValueError(f"unknown null policy {policy}")


def add_schema_field(df: DataFrame, schema: str = "public") -> DataFrame:
    return df.withColumn("schema", F.coalesce("schema", F.lit(schema)) if "schema" in df.columns else F.lit(schema))


def pipeline(df: DataFrame, stages: list[Callable[[DataFrame], DataFrame]]) -> DataFrame:
    return reduce(DataFrame.transform, stages, df)
