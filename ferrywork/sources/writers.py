"""Writers: statements by dialect, SQLite files, JDBC tables through a staging table, JSON lines of records and documents."""

from __future__ import annotations

import sqlite3
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from ferrywork.functions.values import quoted
from ferrywork.operators.writing import keep_last, merge, rows_per_statement
from ferrywork.plans.ddl import TableOf, add_columns, create_table

# Rows of a statement at most, and parameters that a server takes.
MOST_ROWS, PARAMETERS = 10_000, {"mssql": 2100, "sqlite": 32_766, "postgres": 65_535, "cockroachdb": 65_535, "mysql": 65_535, "mariadb": 65_535}


def _list(names: list[str], dialect: str, prefix: str = "") -> str:
    return ", ".join(prefix + quoted(n, dialect) for n in names)


def key_predicate(keys: list[str], dialect: str, left: str = "", right: str = "?") -> str:
    """An equality for each key column, joined by AND; `right` is a mark for a parameter or the prefix of another table."""
    return " AND ".join(f"{left}{quoted(k, dialect)} = {right if right == '?' else right + quoted(k, dialect)}" for k in keys)


def merge_statement(table: str, staged: str, columns: list[str], keys: list[str], dialect: str, strategy: str = "overwrite") -> str:
    """Moves the rows of a staging table into a table, as one statement of the dialect.

    overwrite sets the columns that were written and leaves others; skip only adds keys that are missing; error lets the
    server refuse keys that exist.
    """
    t, s, names = quoted(table, dialect), quoted(staged, dialect), _list(columns, dialect)
    rest = [c for c in columns if c not in keys]
    insert = f"INSERT INTO {t} ({names}) SELECT {names} FROM {s}"
    if strategy == "error":
        return insert
    if dialect in ("postgres", "cockroachdb", "sqlite"):
        insert += " WHERE true" if dialect == "sqlite" else ""  # SQLite would read ON as a join's
        if strategy == "skip" or not rest:
            return f"{insert} ON CONFLICT ({_list(keys, dialect)}) DO NOTHING"
        return f"{insert} ON CONFLICT ({_list(keys, dialect)}) DO UPDATE SET " + ", ".join(f"{quoted(c, dialect)} = excluded.{quoted(c, dialect)}" for c in rest)
    if dialect in ("mysql", "mariadb"):
        if strategy == "skip" or not rest:
            return insert.replace("INSERT INTO", "INSERT IGNORE INTO", 1)
        return f"{insert} ON DUPLICATE KEY UPDATE " + ", ".join(f"{quoted(c, dialect)} = VALUES({quoted(c, dialect)})" for c in rest)
    update = "" if strategy == "skip" or not rest else " WHEN MATCHED THEN UPDATE SET " + ", ".join(f"a.{quoted(c, dialect)} = b.{quoted(c, dialect)}" for c in rest)
    on = key_predicate(keys, dialect, "a.", "b.")
    return f"MERGE INTO {t} AS a USING {s} AS b ON ({on}){update} WHEN NOT MATCHED THEN INSERT ({names}) VALUES ({_list(columns, dialect, 'b.')});"


def insert_statement(table: str, columns: list[str], rows: int, dialect: str) -> str:
    """INSERT of several rows, with a mark for each value."""
    row = f"({', '.join('?' * len(columns))})"
    return f"INSERT INTO {quoted(table, dialect)} ({_list(columns, dialect)}) VALUES {', '.join([row] * rows)}"


def batch_rows(df: DataFrame, widest: int, dialect: str) -> int:
    """Rows of a statement for this table."""
    return rows_per_statement(widest, len(df.columns), most=MOST_ROWS, parameters=PARAMETERS.get(dialect, 0))


class Rows(WriterCommitMessage):
    def __init__(self, path: str, n: int):
        self.path, self.n = path, n


class SqliteSink(DataSource):
    """Rows into a table of an SQLite file on a path that all executors see. Each task writes a file of its own beside it;
    the commit moves them into the table in one transaction, so a task that is run again or lost leaves no rows behind."""

    @classmethod
    def name(cls) -> str:
        return "ferrywork_sqlite_sink"

    def writer(self, schema, overwrite: bool) -> SqliteWriter:
        return SqliteWriter(dict(self.options), [f.name for f in schema.fields])


class SqliteWriter(DataSourceWriter):
    def __init__(self, options: dict, columns: list[str]):
        self.path, self.table, self.strategy = options["path"], options["table"], options.get("strategy", "overwrite")
        self.keys, self.columns = options["keys"].split("\x1f"), columns

    def write(self, iterator: Iterator) -> Rows:
        import decimal
        import uuid

        plain = lambda v: str(v) if isinstance(v, decimal.Decimal) or hasattr(v, "isoformat") else int(v) if isinstance(v, bool) else v
        path, n = f"{self.path}.part-{uuid.uuid4().hex}", 0
        with sqlite3.connect(path) as db:
            db.execute(f"CREATE TABLE part ({_list(self.columns, 'sqlite')})")
            rows: list[tuple] = []
            for row in iterator:
                rows.append(tuple(map(plain, row)))
                if len(rows) == MOST_ROWS:
                    db.executemany(f"INSERT INTO part VALUES ({', '.join('?' * len(self.columns))})", rows)
                    n, rows = n + len(rows), []
            db.executemany(f"INSERT INTO part VALUES ({', '.join('?' * len(self.columns))})", rows)
        return Rows(path, n + len(rows))

    def commit(self, messages: list) -> None:
        import os

        db = sqlite3.connect(self.path, isolation_level=None)
        try:
            parts = [m for m in messages if m is not None]
            statement = merge_statement(self.table, "part", self.columns, self.keys, "sqlite", self.strategy)
            db.execute("BEGIN IMMEDIATE")
            db.execute("COMMIT")
            for k, m in enumerate(parts):
                db.execute(f"ATTACH ? AS p{k % 8}", (m.path,))
                if k % 8 == 7 or k == len(parts) - 1:
                    db.execute("BEGIN IMMEDIATE")
                    for j in range(k % 8 + 1):
                        db.execute(statement.replace('FROM "part"', f'FROM p{j}."part"'))
                    db.execute("COMMIT")
                    for j in range(k % 8 + 1):
                        db.execute(f"DETACH p{j}")
        finally:
            db.close()
            for m in messages:
                if m is not None and os.path.exists(m.path):
                    os.remove(m.path)

    def abort(self, messages: list) -> None:
        import os

        for m in messages:
            if m is not None and os.path.exists(m.path):
                os.remove(m.path)


def ensure_sqlite(path: str, table: TableOf) -> None:
    """Creates the table, or widens it by the columns it lacks."""
    with sqlite3.connect(path) as db:
        existing = [r[0] for r in db.execute("SELECT name FROM pragma_table_info(?)", (table.name,))]
        for statement in add_columns(table, existing, "sqlite") if existing else [create_table(table, "sqlite")]:
            db.execute(statement)


def write_sqlite(df: DataFrame, path: str, table: str, keys: list[str], strategy: str = "overwrite") -> None:
    """Rows into an existing table by key; of rows that repeat a key one is written. Columns that a table has and rows
    lack keep their values."""
    df.sparkSession.dataSource.register(SqliteSink)
    once = keep_last(df, keys, [F.lit(0)]) if strategy != "error" else df
    once.write.format("ferrywork_sqlite_sink").mode("append").options(path=path, table=table, keys="\x1f".join(keys), strategy=strategy).save()


def write_jdbc(df: DataFrame, url: str, table: str, keys: list[str], dialect: str, execute: Callable[[str], None], strategy: str = "overwrite", **options) -> str:
    """Rows into a table through a staging table that executors fill side by side; `execute` runs the merge statement on
    the server. Returns the statement. A run that breaks off leaves the table as it was."""
    staged = f"{table}_ferrywork_stage"
    once = keep_last(df, keys, [F.lit(0)]) if strategy != "error" else df
    once.write.format("jdbc").options(url=url, dbtable=staged, batchsize=batch_rows(df, 1024, dialect), **options).mode("overwrite").save()
    statement = merge_statement(table, staged, df.columns, keys, dialect, strategy)
    execute(statement)
    execute(f"DROP TABLE {quoted(staged, dialect)}")
    return statement


def write_documents(documents: DataFrame, path: str, strategy: str = "overwrite") -> int:
    """Documents (_id, collection, document) into JSON lines by _id. overwrite sets the fields that a document has and
    keeps those that it lacks; skip only adds ids that are missing."""
    from ferrywork.sources.registry import exists, replace

    spark = documents.sparkSession
    once = keep_last(documents.select("_id", "collection", "document"), ["_id"], [F.lit(0)])
    out = once
    if exists(spark, path):
        old = spark.read.schema("_id string, collection string, document string").json(path)
        if strategy == "overwrite":
            fields = lambda c: F.coalesce(F.from_json(c, "map<string,variant>"), F.expr("cast(map() as map<string,variant>)"))
            both = old.alias("a").join(once.alias("b"), "_id", "full_outer")
            kept = F.map_filter(fields(F.col("a.document")), lambda k, v: ~F.map_contains_key(fields(F.col("b.document")), k))
            joined = F.to_json(F.map_from_entries(F.array_sort(F.map_entries(F.map_concat(kept, fields(F.col("b.document")))), lambda x, y: F.when(x["key"] < y["key"], -1).when(x["key"] > y["key"], 1).otherwise(0))))
            document = F.when(F.col("b.document").isNull(), F.col("a.document")).when(F.col("a.document").isNull(), F.col("b.document")).otherwise(joined)
            out = both.select("_id", F.coalesce("b.collection", "a.collection").alias("collection"), document.alias("document"))
        else:
            out = merge(old, once, ["_id"], strategy)
    return replace(out, path, "json")


def write_records(records: DataFrame, path: str, strategy: str = "overwrite") -> int:
    """Records (key, type, value, ttl_seconds) into JSON lines by key: overwrite replaces a key, skip keeps it."""
    from ferrywork.sources.registry import exists, replace

    spark = records.sparkSession
    once = keep_last(records, ["key"], [F.lit(0)])
    out = merge(spark.read.schema(records.schema).json(path), once, ["key"], strategy) if exists(spark, path) else once
    return replace(out, path, "json")


def dry_run(df: DataFrame) -> tuple[int, int]:
    """Rows and bytes (as JSON) that would be written; nothing is."""
    row = df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length(F.to_json(F.struct(*df.columns)))).alias("b")).first()
    return row["n"], row["b"] or 0
