"""Queries over type mappings, held against expected types that were written by hand, apart from the rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from ferrywork.functions import types
from ferrywork.plans.registry import QUERIES, SQL, query, values_table

# Types of a source and, for each target, what becomes of them in the same order (- for none).
KINDS = {
    "mysql": "TINYINT(1) | SMALLINT | MEDIUMINT | INT(11) | BIGINT | FLOAT | DOUBLE | DECIMAL(10,2) | VARCHAR(100) | CHAR(3) | MEDIUMTEXT | LONGBLOB | VARBINARY(8) | DATETIME | TIMESTAMP | DATE | TIME | YEAR | BOOL | JSON | ENUM('a') | GEOMETRY",
    "postgres": "SMALLINT | INTEGER | INT8 | BIGINT | SERIAL | BIGSERIAL | REAL | DOUBLE PRECISION | NUMERIC(10,2) | DECIMAL | VARCHAR(20) | CHARACTER VARYING (20) | CHARACTER VARYING(20) | CHAR(3) | CHARACTER(3) | TEXT | BYTEA | DATE | TIME | TIMESTAMP | TIMESTAMPTZ | TIMESTAMP WITH TIME ZONE | BOOLEAN | JSONB | UUID | XML | INTERVAL",
    "cockroachdb": "SMALLINT | INT2 | INT | INT8 | BIGINT | SERIAL | SMALLSERIAL | REAL | FLOAT4 | FLOAT8 | DOUBLE PRECISION | DECIMAL(10,2) | NUMERIC | VARCHAR(20) | CHARACTER VARYING(20) | CHAR(3) | STRING | TEXT | BYTES | DATE | TIME | TIMESTAMP | TIMESTAMPTZ | BOOL | JSONB | UUID | INET",
    "mssql": "BIGINT | INT | SMALLINT | TINYINT | REAL | FLOAT | NUMERIC(10,2) | DECIMAL | VARCHAR(20) | NVARCHAR(MAX) | CHAR(3) | NCHAR(3) | TEXT | NTEXT | VARBINARY(8) | IMAGE | DATETIME | DATETIME2 | SMALLDATETIME | DATETIMEOFFSET | DATE | TIME | BIT | UNIQUEIDENTIFIER | XML | MONEY",
    "sqlite": "INTEGER | INT | BIGINT | SMALLINT | REAL | DOUBLE | FLOAT | NUMERIC | DECIMAL(10,2) | TEXT | VARCHAR(20) | CHAR(3) | CLOB | BLOB | DATETIME | TIMESTAMP | DATE | BOOLEAN | JSON",
}
KINDS["mariadb"] = KINDS["mysql"]
EXPECTED = {
    "mysql_to_postgres": "SMALLINT | SMALLINT | INTEGER | INTEGER | BIGINT | REAL | DOUBLE PRECISION | NUMERIC | VARCHAR | CHAR | TEXT | BYTEA | BYTEA | TIMESTAMP | TIMESTAMP | DATE | TIME | SMALLINT | BOOLEAN | JSONB | VARCHAR(255) | -",
    "mysql_to_sqlite": "INTEGER | INTEGER | INTEGER | INTEGER | BIGINT | REAL | REAL | NUMERIC | TEXT | TEXT | TEXT | BLOB | BLOB | TEXT | TEXT | TEXT | TEXT | INTEGER | INTEGER | TEXT | TEXT | TEXT",
    "mysql_to_mssql": "TINYINT | SMALLINT | INT | INT | BIGINT | FLOAT | FLOAT | DECIMAL | NVARCHAR(255) | NCHAR(255) | NVARCHAR(MAX) | VARBINARY(MAX) | - | DATETIME2 | DATETIME2 | DATE | TIME | - | BIT | NVARCHAR(MAX) | NVARCHAR(255) | -",
    "mariadb_to_mssql": "TINYINT | SMALLINT | INT | INT | BIGINT | FLOAT | FLOAT | DECIMAL | NVARCHAR(255) | NCHAR(255) | NVARCHAR(MAX) | VARBINARY(MAX) | - | DATETIME2 | DATETIME2 | DATE | TIME | - | BIT | NVARCHAR(MAX) | NVARCHAR(255) | -",
    "mariadb_to_postgres": "SMALLINT | SMALLINT | INTEGER | INTEGER | BIGINT | REAL | DOUBLE PRECISION | NUMERIC | TEXT | TEXT | TEXT | BYTEA | - | TIMESTAMP | TIMESTAMP | DATE | TIME | - | BOOLEAN | JSONB | - | -",
    "mariadb_to_cockroachdb": "SMALLINT | SMALLINT | INTEGER | INTEGER | BIGINT | REAL | DOUBLE PRECISION | NUMERIC | TEXT | TEXT | TEXT | BYTEA | - | TIMESTAMP | TIMESTAMP | DATE | TIME | - | BOOLEAN | JSONB | - | -",
    "mariadb_to_sqlite": "INTEGER | INTEGER | INTEGER | INTEGER | BIGINT | REAL | REAL | NUMERIC | TEXT | TEXT | TEXT | BLOB | TEXT | TEXT | TEXT | TEXT | TEXT | TEXT | INTEGER | TEXT | TEXT | TEXT",
    "postgres_to_mysql": "SMALLINT | INT | - | BIGINT | INT AUTO_INCREMENT | BIGINT AUTO_INCREMENT | FLOAT | DOUBLE | DECIMAL(10,2) | DECIMAL | VARCHAR(20) | VARCHAR(20) | VARCHAR(255) | CHAR(3) | CHAR(255) | TEXT | BLOB | DATE | TIME | DATETIME | DATETIME | DATETIME | TINYINT(1) | JSON | CHAR(36) | - | -",
    "postgres_to_sqlite": "SMALLINT | INTEGER | INTEGER | BIGINT | INTEGER | INTEGER | REAL | REAL | NUMERIC | NUMERIC | TEXT | TEXT | TEXT | TEXT | TEXT | TEXT | BLOB | TEXT | TEXT | TEXT | TEXT | TEXT | INTEGER | TEXT | TEXT | TEXT | INTEGER",
    "postgres_to_mariadb": "SMALLINT | INT | - | BIGINT | INT AUTO_INCREMENT | BIGINT AUTO_INCREMENT | FLOAT | DOUBLE | DECIMAL | DECIMAL | - | VARCHAR(255) | VARCHAR(255) | - | CHAR(255) | TEXT | BLOB | DATE | TIME | DATETIME | DATETIME | DATETIME | TINYINT(1) | JSON | CHAR(36) | - | -",
    "postgres_to_cockroachdb": "SMALLINT | INT | BIGINT | BIGINT | INT | BIGINT | FLOAT4 | FLOAT8 | DECIMAL | DECIMAL | STRING | STRING | STRING | - | STRING | STRING | - | DATE | TIME | TIMESTAMP | TIMESTAMP | TIMESTAMPTZ | BOOL | JSONB | UUID | - | INT",
    "postgres_to_mssql": "SMALLINT | INT | INT | BIGINT | BIGINT IDENTITY(1,1) | BIGINT IDENTITY(1,1) | FLOAT | FLOAT | NUMERIC(10,2) | DECIMAL | NVARCHAR(255) | NVARCHAR(255) | NVARCHAR(255) | NCHAR(255) | NCHAR(255) | NVARCHAR(MAX) | VARBINARY(MAX) | DATE | TIME | DATETIME2 | DATETIME2 | DATETIMEOFFSET | BIT | NVARCHAR(MAX) | UNIQUEIDENTIFIER | XML | INT",
    "cockroachdb_to_postgres": "SMALLINT | - | INTEGER | - | BIGINT | - | - | REAL | REAL | DOUBLE PRECISION | DOUBLE PRECISION | DECIMAL | NUMERIC | - | VARCHAR | - | TEXT | TEXT | BYTEA | DATE | TIME | TIMESTAMP | TIMESTAMP | BOOLEAN | JSONB | UUID | -",
    "cockroachdb_to_mysql": "SMALLINT | SMALLINT | INT | BIGINT | BIGINT | BIGINT | SMALLINT | DOUBLE | FLOAT | DOUBLE | DOUBLE | DECIMAL | DECIMAL | VARCHAR(255) | VARCHAR(255) | CHAR(255) | LONGTEXT | LONGTEXT | LONGBLOB | DATE | TIME | DATETIME | DATETIME | TINYINT(1) | JSON | CHAR(36) | -",
    "cockroachdb_to_mariadb": "SMALLINT | SMALLINT | INT | BIGINT | BIGINT | BIGINT | SMALLINT | DOUBLE | FLOAT | DOUBLE | DOUBLE | DECIMAL | DECIMAL | VARCHAR(255) | VARCHAR(255) | CHAR(255) | LONGTEXT | LONGTEXT | LONGBLOB | DATE | TIME | DATETIME | DATETIME | TINYINT(1) | JSON | CHAR(36) | -",
    "cockroachdb_to_sqlite": "SMALLINT | SMALLINT | INTEGER | BIGINT | BIGINT | INTEGER | SMALLINT | REAL | TEXT | TEXT | REAL | NUMERIC | NUMERIC | TEXT | TEXT | TEXT | TEXT | TEXT | BLOB | TEXT | TEXT | TEXT | TEXT | INTEGER | TEXT | TEXT | TEXT",
    "cockroachdb_to_mssql": "SMALLINT | INT | INT | INT | BIGINT | BIGINT IDENTITY(1,1) | SMALLINT IDENTITY(1,1) | FLOAT | - | - | FLOAT | DECIMAL(10,2) | NUMERIC | NVARCHAR(255) | NVARCHAR(255) | NCHAR(255) | - | NVARCHAR(MAX) | - | DATE | TIME | DATETIME2 | DATETIME2 | BIT | NVARCHAR(MAX) | UNIQUEIDENTIFIER | -",
    "mssql_to_postgres": "BIGINT | BIGINT | SMALLINT | SMALLINT | REAL | REAL | NUMERIC | NUMERIC | TEXT | TEXT | TEXT | TEXT | TEXT | TEXT | BYTEA | BYTEA | TIMESTAMP | TIMESTAMP | TIMESTAMP | TIMESTAMP WITH TIME ZONE | DATE | TIME | BOOLEAN | UUID | XML | -",
    "mssql_to_cockroachdb": "BIGINT | BIGINT | SMALLINT | SMALLINT | REAL | REAL | NUMERIC | NUMERIC | TEXT | TEXT | TEXT | TEXT | TEXT | TEXT | BYTEA | BYTEA | TIMESTAMP | TIMESTAMP | TIMESTAMP | TIMESTAMP WITH TIME ZONE | DATE | TIME | BOOLEAN | UUID | XML | -",
    "mssql_to_mysql": "BIGINT | INT | SMALLINT | TINYINT | DOUBLE | DOUBLE | DECIMAL | DECIMAL | VARCHAR(255) | VARCHAR(255) | CHAR(255) | CHAR(255) | LONGTEXT | LONGTEXT | LONGBLOB | LONGBLOB | DATETIME | DATETIME | DATETIME | DATETIME | DATE | TIME | TINYINT(1) | CHAR(36) | - | -",
    "mssql_to_mariadb": "BIGINT | INT | SMALLINT | TINYINT | DOUBLE | DOUBLE | DECIMAL | DECIMAL | VARCHAR(255) | VARCHAR(255) | CHAR(255) | CHAR(255) | LONGTEXT | LONGTEXT | LONGBLOB | LONGBLOB | DATETIME | DATETIME | DATETIME | DATETIME | DATE | TIME | TINYINT(1) | CHAR(36) | - | -",
    "mssql_to_sqlite": "INTEGER | INTEGER | INTEGER | INTEGER | REAL | REAL | NUMERIC | NUMERIC | TEXT | TEXT | TEXT | TEXT | TEXT | TEXT | BLOB | BLOB | TEXT | TEXT | TEXT | TEXT | TEXT | TEXT | INTEGER | TEXT | TEXT | TEXT",
    "sqlite_to_postgres": "INTEGER | INTEGER | BIGINT | SMALLINT | DOUBLE PRECISION | DOUBLE PRECISION | DOUBLE PRECISION | NUMERIC | NUMERIC | TEXT | TEXT | TEXT | TEXT | BYTEA | TIMESTAMP | TIMESTAMP | DATE | BOOLEAN | -",
    "sqlite_to_mysql": "INT | INT | BIGINT | SMALLINT | FLOAT | DOUBLE | FLOAT | DECIMAL | DECIMAL | LONGTEXT | VARCHAR(255) | CHAR(255) | LONGTEXT | LONGBLOB | DATETIME | DATETIME | DATE | TINYINT(1) | -",
    "sqlite_to_mssql": "INT | INT | BIGINT | SMALLINT | FLOAT | FLOAT | FLOAT | DECIMAL | DECIMAL | NVARCHAR(MAX) | NVARCHAR(MAX) | NVARCHAR(MAX) | NVARCHAR(MAX) | VARBINARY(MAX) | NVARCHAR(MAX) | NVARCHAR(MAX) | NVARCHAR(MAX) | NVARCHAR(MAX) | NVARCHAR(MAX)",
}


def _quote(text: str) -> str:
    return "NULL" if text == "-" else "'" + text.replace("'", "''") + "'"


def _type_map(pair: str) -> None:
    kinds, expected = (x.split(" | ") for x in (KINDS[pair.split("_to_")[0]], EXPECTED[pair]))

    def run(spark, d):
        return spark.createDataFrame([(k,) for k in kinds], "kind string").select("kind", types.mapped_type(F.col("kind"), pair).alias("target"))

    QUERIES[f"type_map_{pair}"] = run
    SQL[f"type_map_{pair}"] = f"SELECT * FROM (VALUES {', '.join(f'({_quote(k)}, {_quote(t)})' for k, t in zip(kinds, expected, strict=True))}) t(kind, target)"


for _pair in EXPECTED:
    _type_map(_pair)


# Types that writers create columns with, by dialect.
WRITTEN = {
    "postgres": "INT2=SMALLINT | INT8=BIGINT | MEDIUMINT=INTEGER | TINYINT(1)=SMALLINT | DOUBLE=DOUBLE PRECISION | DECIMAL(5,1)=NUMERIC | LONGTEXT=TEXT | JSON=JSONB | VARBINARY(8)=BYTEA | DATETIME=TIMESTAMP | BOOL=BOOLEAN | UUID=UUID",
    "cockroachdb": "INT4=INT | BIGINT=BIGINT | TINYINT=SMALLINT | FLOAT=FLOAT4 | DOUBLE=FLOAT8 | NUMERIC(5,1)=DECIMAL | VARCHAR(9)=STRING | CHAR(2)=STRING | TEXT=STRING | JSON=JSONB | BLOB=BYTES | DATETIME=TIMESTAMPTZ | TIMESTAMP=TIMESTAMP | BOOLEAN=BOOL | UUID=UUID",
    "mysql": "int(11)=INT(11) | VARCHAR(9)=VARCHAR(9) | TEXT=TEXT | BLOB=BLOB | DATETIME=DATETIME | DATE=DATE | BOOLEAN=TINYINT(1) | JSONB=JSON | BYTEA=LONGTEXT | UUID=LONGTEXT",
    "mariadb": "int(11)=INT(11) | VARCHAR(9)=VARCHAR(9) | TEXT=TEXT | BLOB=BLOB | TIMESTAMP=TIMESTAMP | TIME=TIME | BOOLEAN=TINYINT(1) | JSONB=JSON | BYTEA=LONGTEXT | UUID=LONGTEXT",
    "mssql": "TEXT=NVARCHAR(MAX) | CLOB=NVARCHAR(MAX) | BYTEA=VARBINARY(MAX) | IMAGE=VARBINARY(MAX) | int=INT | DATETIME2=DATETIME2 | VARCHAR(9)=VARCHAR(9)",
}


def _written(dialect: str) -> None:
    pairs = [x.split("=") for x in WRITTEN[dialect].split(" | ")]

    def run(spark, d):
        return spark.createDataFrame([(k,) for k, _ in pairs], "kind string").select("kind", types.normalised_type(F.col("kind"), dialect).alias("written"))

    QUERIES[f"written_type_{dialect}"] = run
    SQL[f"written_type_{dialect}"] = f"SELECT * FROM (VALUES {', '.join(f'({_quote(k)}, {_quote(t)})' for k, t in pairs)}) t(kind, written)"


for _dialect in WRITTEN:
    _written(_dialect)


@query("SELECT * FROM (VALUES ('timestamptz', 'timestamp', true), ('TEXT', 'VARCHAR(20)', true), ('INT', 'BIGINT', false), ('NUMERIC(10,2)', 'FLOAT', true)) t(a, b, lossy)")
def plan_lossy(spark, d):
    rows = values_table(spark, "a, b", "('timestamptz', 'timestamp'), ('TEXT', 'VARCHAR(20)'), ('INT', 'BIGINT'), ('NUMERIC(10,2)', 'FLOAT')")
    return rows.select("a", "b", types.lossy(F.col("a"), F.col("b")).alias("lossy"))
