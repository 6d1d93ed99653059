"""Schemas: inspection, CREATE TABLE and CREATE INDEX statements by dialect, defaults that a dialect takes."""

from __future__ import annotations

import sqlite3
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrywork.functions.types import mapped_type
from ferrywork.functions.values import quoted


@dataclass(frozen=True)
class ColumnOf:
    name: str
    kind: str
    nullable: bool = True
    default: str = ""
    auto: bool = False


@dataclass
class TableOf:
    """A table of a catalog: columns in order, key columns, indexes (name, columns, unique), references (column, table, its column)."""

    name: str
    columns: list[ColumnOf]
    key: list[str] = field(default_factory=list)
    indexes: list[tuple[str, tuple[str, ...], bool]] = field(default_factory=list)
    references: list[tuple[str, str, str]] = field(default_factory=list)


# Schemas and prefixes of the servers' own tables.
SYSTEM_SCHEMAS = ("pg_catalog", "information_schema", "crdb_internal", "pg_extension", "sys", "mysql", "performance_schema")
SYSTEM_PREFIXES = ("sqlite_", "system.", ".")


def user_table(name: Column, schema: Column | None = None) -> Column:
    """Whether a table is none of the server's own."""
    ok = ~F.coalesce(*(F.when(name.startswith(p), True) for p in SYSTEM_PREFIXES), F.lit(False))
    return ok if schema is None else ok & ~F.coalesce(schema, F.lit("")).isin(*SYSTEM_SCHEMAS)


def inspect_sqlite(path: str) -> list[TableOf]:
    """Tables by name, with keys, indexes and references. A table without a key is keyed by all its columns."""
    out = []
    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as db:
        names = [r[0] for r in db.execute("SELECT name FROM sqlite_master WHERE type = 'table' AND name NOT LIKE 'sqlite|_%' ESCAPE '|' ORDER BY name")]
        for name in names:
            info = db.execute("SELECT name, type, \"notnull\", dflt_value, pk FROM pragma_table_info(?) ORDER BY cid", (name,)).fetchall()
            key = [n for _, n in sorted((r[4], r[0]) for r in info if r[4])]
            auto = len(key) == 1 and next(r[1] for r in info if r[0] == key[0]).upper() == "INTEGER"
            columns = [ColumnOf(n, k or "TEXT", not null and not pk, default or "", auto and bool(pk)) for n, k, null, default, pk in info]
            indexes = []
            for index, unique in db.execute("SELECT name, \"unique\" FROM pragma_index_list(?) WHERE origin = 'c' ORDER BY name", (name,)).fetchall():
                own = tuple(r[0] for r in db.execute("SELECT name FROM pragma_index_info(?) ORDER BY seqno", (index,)))
                indexes.append((index, own, bool(unique)))
            references = [(a, t, b or key[0]) for t, a, b in db.execute("SELECT \"table\", \"from\", \"to\" FROM pragma_foreign_key_list(?) ORDER BY id, seq", (name,))]
            out.append(TableOf(name, columns, key or [c.name for c in columns], indexes, references))
    return out


def inspect_frames(tables: dict[str, DataFrame], keys: dict[str, list[str]] | None = None) -> list[TableOf]:
    """The schema of DataFrames, as a catalog."""
    return [TableOf(n, [ColumnOf(f.name, f.dataType.simpleString(), f.nullable) for f in df.schema], (keys or {}).get(n, df.columns)) for n, df in sorted(tables.items())]


def catalog(spark: SparkSession, tables: list[TableOf]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Columns, indexes and references as DataFrames."""
    columns = [(t.name, k, c.name, c.kind, c.nullable, c.default, c.name in t.key) for t in tables for k, c in enumerate(t.columns)]
    indexes = [(t.name, n, k, c, u) for t in tables for n, own, u in t.indexes for k, c in enumerate(own)]
    references = [(t.name, *r) for t in tables for r in t.references]
    return (
        spark.createDataFrame(columns, "table string, position int, column string, kind string, nullable boolean, default string, in_key boolean"),
        spark.createDataFrame(indexes, "table string, index string, position int, column string, unique boolean"),
        spark.createDataFrame(references, "table string, column string, referred string, referred_column string"),
    )


# Calls that PostgreSQL and CockroachDB know, and words of other dialects.
CALLS = ("NOW()", "CURRENT_TIMESTAMP", "CURRENT_DATE", "CURRENT_TIME", "GEN_RANDOM_UUID()", "UUID_GENERATE_V4()", "NEXTVAL(")
FOREIGN = ("DATETIME", "SQLITE_", "AUTOINCREMENT")
NO_MSSQL = ("NEXTVAL(", "UUID_GENERATE_V4()", "GEN_RANDOM_UUID()", "AUTOINCREMENT", "IDENTITY")
NO_SQLITE = ("NEXTVAL", "CURRVAL", "SETVAL", "::REGCLASS")


def safe_default(expression: Column, dialect: str) -> Column:
    """A default expression as the dialect takes it; null where it does not.

    PostgreSQL and CockroachDB: known calls, and what is no call; CockroachDB writes NOW() as CURRENT_TIMESTAMP. SQL
    Server and SQLite: no sequences and generated ids, the time as CURRENT_TIMESTAMP; SQLite sets other calls in brackets.
    MySQL and MariaDB: all but the words of other dialects. Quoted texts pass.
    """
    upper = F.upper(F.trim(expression) if dialect == "mssql" else expression)
    has = lambda words: _any(upper.contains(w) for w in words)
    call = upper.contains("()") & ~upper.startswith("'")
    now = F.lit("CURRENT_TIMESTAMP")
    if dialect in ("postgres", "cockroachdb"):
        out = F.when(has(FOREIGN), None)
        if dialect == "cockroachdb":
            out = out.when(upper.isin("CURRENT_TIMESTAMP()", "NOW()"), now).when(has((*CALLS, "UNIQUE_ROWID")), expression)
        else:
            out = out.when(has(CALLS), expression)
        out = out.when(call, None).otherwise(expression)
    elif dialect == "mssql":
        out = F.when(upper.isin("NOW()", "CURRENT_TIMESTAMP()", "CURRENT_TIMESTAMP"), now).when(has(NO_MSSQL), None).when(call, None).otherwise(expression)
    elif dialect == "sqlite":
        bracketed = F.concat(F.lit("("), expression, F.lit(")"))
        out = F.when(has(NO_SQLITE), None).when(call, F.when(upper == "NOW()", now)).when(expression.contains("(") & expression.contains(")"), bracketed).otherwise(expression)
    else:
        out = F.when(has(FOREIGN), None).otherwise(expression)
    return F.when(F.coalesce(expression, F.lit("")) != "", out)


def _any(conditions) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


# What makes a key column count up by itself.
AUTO = {"mysql": " AUTO_INCREMENT", "mariadb": " AUTO_INCREMENT", "mssql": " IDENTITY(1,1)"}
SERIAL = {"postgres": {"BIGINT": "BIGSERIAL"}, "cockroachdb": {"BIGINT": "BIGSERIAL"}}


def converted(spark: SparkSession, tables: list[TableOf], source: str, target: str) -> list[TableOf]:
    """The tables with the target's types and defaults; a type that no rule maps becomes text."""
    if source == target:
        return tables
    columns = catalog(spark, tables)[0]
    kind = mapped_type(F.col("kind"), f"{source}_to_{target}")
    rows = columns.select("table", "column", F.coalesce(kind, F.lit("TEXT")).alias("kind"), safe_default(F.col("default"), target).alias("default")).collect()  # one row a column
    found = {(r["table"], r["column"]): (r["kind"], r["default"] or "") for r in rows}
    return [TableOf(t.name, [ColumnOf(c.name, *_typed(*found[t.name, c.name], c)) for c in t.columns], t.key, t.indexes, t.references) for t in tables]


def _typed(kind: str, default: str, c: ColumnOf) -> tuple[str, bool, str, bool]:
    return kind, c.nullable, default, c.auto


def create_table(table: TableOf, dialect: str) -> str:
    """CREATE TABLE IF NOT EXISTS: types, NOT NULL, counting keys, defaults and the key."""
    lines = []
    for c in table.columns:
        kind = SERIAL.get(dialect, {}).get(c.kind.upper(), "SERIAL" if dialect in SERIAL else c.kind) if c.auto and dialect in SERIAL else c.kind
        auto = AUTO.get(dialect, "") if c.auto and "IDENTITY" not in c.kind.upper() and "AUTO_INCREMENT" not in c.kind.upper() else ""
        default = f" DEFAULT {c.default}" if c.default and not c.auto else ""
        lines.append(f"  {quoted(c.name, dialect)} {kind}{auto}{'' if c.nullable else ' NOT NULL'}{default}")
    if table.key:
        lines.append(f"  PRIMARY KEY ({', '.join(quoted(k, dialect) for k in table.key)})")
    body = ",\n".join(lines)
    name = quoted(table.name, dialect)
    if dialect == "mssql":
        return f"IF OBJECT_ID(N'{table.name}', N'U') IS NULL CREATE TABLE {name} (\n{body}\n)"
    return f"CREATE TABLE IF NOT EXISTS {name} (\n{body}\n)"


def create_indexes(table: TableOf, dialect: str) -> list[str]:
    """CREATE INDEX statements; those of a dialect without IF NOT EXISTS may fail on a second run, which is to be logged."""
    again = "" if dialect in ("mysql", "mariadb", "mssql") else "IF NOT EXISTS "
    return [f"CREATE {'UNIQUE ' if unique else ''}INDEX {again}{quoted(n, dialect)} ON {quoted(table.name, dialect)} ({', '.join(quoted(c, dialect) for c in own)})" for n, own, unique in table.indexes]


def drop_table(name: str, dialect: str) -> str:
    return f"DROP TABLE IF EXISTS {quoted(name, dialect)}"


def add_columns(table: TableOf, existing: list[str], dialect: str) -> list[str]:
    """ALTER TABLE statements that widen an existing table by the columns it lacks, all of which may be null."""
    word = "ADD" if dialect == "mssql" else "ADD COLUMN"
    return [f"ALTER TABLE {quoted(table.name, dialect)} {word} {quoted(c.name, dialect)} {c.kind}" for c in table.columns if c.name not in existing]
