"""Sources and sinks by name: files, JDBC databases, SQLite files and key-value envelopes."""

from __future__ import annotations

import sqlite3
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

from ferrywork.operators.writing import merge

Source = Callable[..., DataFrame]
_SOURCES: dict[str, Source] = {}


def register(name: str, source: Source) -> None:
    if name in _SOURCES:
        raise ValueError(f"{name} is registered already")
    _SOURCES[name] = source


def read(spark: SparkSession, name: str, **options) -> DataFrame:
    return _SOURCES[name](spark, **options)


def names() -> list[str]:
    return sorted(_SOURCES)


def files(kind: str) -> Source:
    return lambda spark, path, **options: spark.read.format(kind).options(**options).load(path)


# URL schemes of the databases that Spark reaches by JDBC.
JDBC = {"postgres": "postgresql", "cockroachdb": "postgresql", "mysql": "mysql", "mariadb": "mariadb", "mssql": "sqlserver"}


def jdbc(kind: str) -> Source:
    """A table split by ranges of a numeric key, so that executors read it side by side; filters and columns go down."""

    def source(spark, host: str, database: str, table: str, key: str = "", low: int = 0, high: int = 0, parts: int = 1, **options) -> DataFrame:
        url = f"jdbc:{JDBC[kind]}://{host}" + (f";databaseName={database}" if kind == "mssql" else f"/{database}")
        split = {"partitionColumn": key, "lowerBound": low, "upperBound": high, "numPartitions": parts} if key else {}
        return spark.read.format("jdbc").options(url=url, dbtable=table, fetchsize=10_000, **split, **options).load()

    return source


class SqliteSource(DataSource):
    """Tables of an SQLite file, split by ranges of rowid. The file must be on a path that executors see."""

    @classmethod
    def name(cls) -> str:
        return "ferrywork_sqlite"

    # SQLite's declared types and Spark's.
    KINDS = {"INT": "bigint", "REAL": "double", "FLOA": "double", "DOUB": "double", "BLOB": "binary"}

    def schema(self) -> str:
        with sqlite3.connect(f"file:{self.options['path']}?mode=ro", uri=True) as db:
            columns = db.execute("SELECT name, type FROM pragma_table_info(?)", (self.options["table"],)).fetchall()
        return ", ".join(f"`{n}` {next((k for p, k in self.KINDS.items() if p in t.upper()), 'string')}" for n, t in columns)

    def reader(self, schema) -> SqliteReader:
        return SqliteReader(dict(self.options))


class Range(InputPartition):
    def __init__(self, low: int, high: int):
        self.low, self.high = low, high


class SqliteReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.table, self.parts = options["path"], options["table"].replace('"', '""'), int(options.get("parts", 4))
        self.conditions: list[tuple[str, object]] = []

    def pushFilters(self, filters: list) -> Iterator:
        """Comparisons of a column with a value go to SQLite; what is not one stays with Spark."""
        signs = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}
        for f in filters:
            if type(f) in signs and len(f.attribute) == 1 and isinstance(f.value, (int, float, str)):
                self.conditions.append((f'"{f.attribute[0]}" {signs[type(f)]} ?', f.value))
            else:
                yield f

    def partitions(self) -> list[Range]:
        with sqlite3.connect(f"file:{self.path}?mode=ro", uri=True) as db:
            low, high = db.execute(f'SELECT min(rowid), max(rowid) FROM "{self.table}"').fetchone()
        if low is None:
            return [Range(0, 0)]
        step = -(-(high - low + 1) // self.parts)
        return [Range(k, min(k + step, high + 1)) for k in range(low, high + 1, step)]

    def read(self, part: Range) -> Iterator[tuple]:
        with sqlite3.connect(f"file:{self.path}?mode=ro", uri=True) as db:
            where = " AND ".join(["rowid >= ?", "rowid < ?", *(c for c, _ in self.conditions)])
            yield from db.execute(f'SELECT * FROM "{self.table}" WHERE {where} ORDER BY rowid', (part.low, part.high, *(v for _, v in self.conditions)))


def sqlite(spark: SparkSession, path: str, table: str, parts: int = 4) -> DataFrame:
    spark.dataSource.register(SqliteSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("ferrywork_sqlite").options(path=path, table=table, parts=str(parts)).load()


#: Key-value records and documents as JSON lines.
HASHES = "key string, type string, value map<string,string>, ttl_seconds bigint"
STREAMS = "key string, type string, value array<struct<id: string, fields: map<string,string>>>, ttl_seconds bigint"
STRINGS = "key string, type string, value string, ttl_seconds bigint"
LISTS = "key string, type string, value array<string>, ttl_seconds bigint"
SCORED = "key string, type string, value array<struct<member: string, score: double>>, ttl_seconds bigint"


def envelopes(spark: SparkSession, path: str, schema: str = HASHES) -> DataFrame:
    return spark.read.schema(schema).json(path)


for _kind in ("parquet", "json", "csv", "orc", "text"):
    register(_kind, files(_kind))
for _kind in JDBC:
    register(_kind, jdbc(_kind))
register("sqlite", sqlite)
register("redis", envelopes)
register("mongodb", lambda spark, path, schema=None: spark.read.schema(schema or "_id string, collection string, document string").json(path))


def _fs(spark: SparkSession, path: str):
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), lambda p: jvm.org.apache.hadoop.fs.Path(p)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a table lies at the path, after setting right what a run that broke off has left there: a new version that
    is whole takes its place, else the old one comes back."""
    fs, at = _fs(spark, path)
    if not fs.exists(at(path)):
        if fs.exists(at(f"{path}.new/_SUCCESS")):
            fs.rename(at(f"{path}.new"), at(path))
        elif fs.exists(at(f"{path}.old")):
            fs.rename(at(f"{path}.old"), at(path))
    return fs.exists(at(path))


def switch(spark: SparkSession, path: str) -> None:
    """Puts the version at path.new in place of the one at path. Stopped anywhere, exists() finishes or undoes it."""
    fs, at = _fs(spark, path)
    if fs.exists(at(path)):
        fs.delete(at(f"{path}.old"), True)
        fs.rename(at(path), at(f"{path}.old"))
    fs.rename(at(f"{path}.new"), at(path))
    fs.delete(at(f"{path}.old"), True)


def replace(out: DataFrame, path: str, kind: str = "parquet") -> int:
    """Writes a whole new version of a table, which may have been read for it, then switches to it; returns its rows."""
    spark = out.sparkSession
    out.write.mode("overwrite").format(kind).save(f"{path}.new")
    switch(spark, path)
    return spark.read.schema(out.schema).format(kind).load(path).count()


def write(incoming: DataFrame, path: str, keys: list[str], strategy: str = "overwrite", dry_run: bool = False) -> int:
    """Merges rows into a Parquet table by key; returns its rows. A run that breaks off leaves the old table or the whole
    new one. dry_run writes nothing."""
    spark = incoming.sparkSession
    out = merge(spark.read.parquet(path) if exists(spark, path) else incoming.limit(0), incoming, keys, strategy)
    return out.count() if dry_run else replace(out, path)


def tables(spark: SparkSession, folder: str) -> list[str]:
    """Names of the Parquet tables of a folder, in order; hidden and system ones are left out."""
    fs, at = _fs(spark, folder)
    found = [f.getPath().getName() for f in fs.listStatus(at(folder))] if fs.exists(at(folder)) else []
    return sorted(n.removesuffix(".parquet") for n in found if n.endswith(".parquet") and not n.startswith((".", "_", "sqlite_")))


def pending(names: list[str], completed: list[str], schema: str = "") -> list[str]:
    """Tables that a resumed run still reads; completed ones may be named with their schema."""
    done = {*completed}
    return [n for n in names if n not in done and f"{schema}.{n}" not in done]


def matching(df: DataFrame, key: str, pattern: str) -> DataFrame:
    """Rows whose key fits a glob: * any text, ? one character, [abc] one of them, [^a] any other, a backslash takes what follows as it is."""
    import re

    out, at = [], 0
    while at < len(pattern):
        c = pattern[at]
        end = pattern.find("]", at + 2) if c == "[" else -1
        if c == "\\" and at + 1 < len(pattern):
            at += 1
            out.append(re.escape(pattern[at]))
        elif end > 0:
            out.append("[" + pattern[at + 1 : end].replace("\\", "\\\\").replace("[", "\\[") + "]")
            at = end
        else:
            out.append({"*": "(?s:.*)", "?": "(?s:.)"}.get(c) or re.escape(c))
        at += 1
    return df.where(F.col(key).rlike(f"^{''.join(out)}$"))


def by_keys(df: DataFrame, keys: DataFrame, names: list[str]) -> DataFrame:
    """The rows of the given keys; keys that are not there are left out. Spark checks the size of `keys` itself and
    broadcasts it if it is small."""
    return df.join(keys.select(*names).distinct(), names, "left_semi")


def page(df: DataFrame, keys: list[str], size: int, number: int) -> DataFrame:
    """Rows of one page in the order of keys, from page 0 on: limit and offset as a top-n."""
    return df.orderBy(*keys).offset(number * size).limit(size)


# Entries that one call to a key-value server reads, by type.
PAGES = {"hash": 500, "list": 500, "set": 500, "zset": 500, "stream": 100}


def paged(members: list, kind: str) -> Iterator[list]:
    """A value's members in the pages that a server hands out. Pages of a stream begin with the last entry of the one
    before, as ranges include their start; others do not overlap."""
    size, at = PAGES[kind], 0
    while at < len(members):
        yield members[at : at + size]
        if at + size >= len(members):
            return
        at += size - 1 if kind == "stream" else size


def scan_stats(tables: dict[str, DataFrame], completed: list[str]) -> DataFrame:
    """Rows in all tables and how many tables are done: what a scan reports, and its token as JSON."""
    from functools import reduce

    each = reduce(DataFrame.unionByName, (df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(t).alias("table"), "n") for t, df in tables.items()))
    done = F.col("table").isin(*completed) if completed else F.lit(False)
    out = each.agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("tables"), F.count_if(done).alias("done"))
    return out.withColumn("token", F.to_json(F.struct(F.lit(sorted(completed)).alias("tables_completed"), "rows")))


def generated(spark: SparkSession, rows: int, parts: int = 8, seed: int = 42) -> dict[str, DataFrame]:
    """Test tables users, orders and products, the same for the same seed: a twentieth of the users has no mail address,
    orders fall on few users most of the time, one order in seven lacks a note. Every row follows from its number."""
    unit = lambda salt: F.pmod(F.xxhash64("id", F.lit(seed + salt)), F.lit(1_000_000)) / 1_000_000
    few = lambda n, salt: F.floor(F.pow(unit(salt), 3) * n).cast("bigint")
    users = spark.range(0, rows, 1, parts).select("id", F.concat(F.lit("user"), "id").alias("name"), F.when(unit(1) >= 0.05, F.concat(F.lit("user"), "id", F.lit("@example.org"))).alias("email"), (unit(2) < 0.8).alias("active"))
    orders = spark.range(0, rows, 1, parts).select("id", few(rows, 3).alias("user_id"), F.round(unit(4) * 1000, 2).alias("total"), F.when(unit(5) >= 0.15, F.concat(F.lit("note "), "id")).alias("note"))
    products = spark.range(0, max(1, rows // 10), 1, parts).select("id", F.concat(F.lit("product"), "id").alias("title"), few(500, 6).alias("stock"))
    return {"users": users, "orders": orders, "products": products}
