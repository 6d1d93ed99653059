"""Transformers between providers: one composition of shared stages for each ordered pair."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ferrywork.functions.values import convert_timestamp, same_family
from ferrywork.operators import mapping, models

Stage = Callable[[DataFrame], DataFrame]

# Providers, those with tables, and those whose tables stand in a schema.
SQL = ("postgres", "mysql", "mariadb", "cockroachdb", "mssql", "sqlite")
PROVIDERS = (*SQL, "mongodb", "redis")
IN_SCHEMA = {"postgres": "public", "cockroachdb": "public"}


@dataclass
class Context:
    """What a transformer is given beside the rows: the table, its keys and references, mappings and the null policy.
    `stamps` names text columns that hold timestamps."""

    table: str = ""
    keys: list[str] = field(default_factory=list)
    references: list[tuple[str, str, str]] = field(default_factory=list)
    rules: dict[str, list[mapping.FieldRule]] = field(default_factory=dict)
    nulls: str = "passthrough"
    stamps: list[str] = field(default_factory=list)
    columns: list[str] = field(default_factory=list)


def nulls_stage(c: Context) -> Stage:
    return lambda df: mapping.null_policy(df, c.nulls)[0]


def mapping_stage(c: Context) -> Stage:
    return lambda df: mapping.map_fields(df, c.rules, c.table)


def timestamp_stage(c: Context, source: str, target: str) -> Stage:
    """Typed columns need none; text columns named in `stamps` are written as the target writes them, table by table."""
    if same_family(source, target):
        return lambda df: df
    return lambda df: df.withColumns({n: convert_timestamp(F.col(n), target) for n in c.stamps if n in df.columns and isinstance(df.schema[n].dataType, T.StringType)})


def schema_stage(target: str) -> Stage:
    """Adds the schema that the target's tables stand in, where rows have none; takes it away for other targets."""
    if target in IN_SCHEMA:
        return lambda df: mapping.add_schema_field(df, IN_SCHEMA[target])
    return lambda df: df.drop("schema")


def _rows(c: Context, source: str, target: str) -> list[Stage]:
    """Tables to tables. Pairs with SQLite or SQL Server keep timestamps as they are."""
    stages = [nulls_stage(c), mapping_stage(c)]
    if not {source, target} & {"sqlite", "mssql"}:
        stages.append(timestamp_stage(c, source, target))
    return [*stages, schema_stage(target)] if source != "mssql" or target not in IN_SCHEMA else stages


def _build(c: Context, source: str, target: str) -> list[Stage]:
    if source == target:
        return [nulls_stage(c), mapping_stage(c)]
    both = [nulls_stage(c), mapping_stage(c)]
    if source in SQL and target in SQL:
        return _rows(c, source, target)
    if source in SQL and target == "redis":
        return [*both, lambda df: models.rows_to_hashes(df, c.table, c.keys)]
    if source in SQL:  # to documents, with references where the source tells them
        if source in ("postgres", "mysql"):
            return [*both, lambda df: models.documents_with_lookups(df, c.table, c.keys, c.references)]
        return [*both, lambda df: models.rows_to_documents(df, c.table, c.keys)]
    if target in SQL:
        read = models.hashes_to_rows if source == "redis" else models.documents_to_rows
        named = [schema_stage(target)] if target in IN_SCHEMA and source == "mongodb" else []
        return [lambda df: read(df, c.columns), *both, *named]
    if source == "mongodb":
        return [lambda df: models.documents_to_hashes(df, c.columns)]
    return [models.records_to_documents]


#: (source, target) -> stages for a context. Every ordered pair of providers, those of one provider included.
_REGISTRY: dict[tuple[str, str], Callable[[Context], list[Stage]]] = {}


def register(source: str, target: str, build: Callable[[Context], list[Stage]]) -> None:
    if (source, target) in _REGISTRY:
        raise ValueError(f"{source} to {target} is registered already")
    _REGISTRY[source, target] = build


for _a in PROVIDERS:
    for _b in PROVIDERS:
        register(_a, _b, lambda c, a=_a, b=_b: _build(c, a, b))


def has(source: str, target: str) -> bool:
    return (source, target) in _REGISTRY


def pairs() -> list[tuple[str, str]]:
    """Pairs of different providers."""
    return sorted(k for k in _REGISTRY if k[0] != k[1])


def transform(df: DataFrame, source: str, target: str, context: Context) -> DataFrame:
    """Rows, documents or records of the source as the target takes them."""
    if not has(source, target):
        raise ValueError(f"no transformer from {source} to {target}")
    return mapping.pipeline(df, _REGISTRY[source, target](context))


def rejected(df: DataFrame, context: Context) -> DataFrame:
    """Rows that the null policy `error` keeps out; none under the others."""
    bad = mapping.null_policy(df, context.nulls)[1]
    return df.where("false") if bad is None else bad
