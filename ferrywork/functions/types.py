"""Type mapping between dialects: ordered rules, applied as one CASE expression."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

Rule = tuple[tuple[str, ...], str]


def _tables(text: str) -> dict[str, list[Rule]]:
    """[pair], then a rule a line: names -> target."""
    out: dict[str, list[Rule]] = {}
    for line in text.strip().splitlines():
        if line.startswith("["):
            rules = out.setdefault(line[1:-1], [])
        elif line:
            names, _, target = line.partition(" -> ")
            rules.append((tuple(n.strip() for n in names.split(",")), target))
    return out


# Rules in order, the first that matches wins. X* is a prefix, =X the whole upper-cased type (= alone: no
# type), else everything. `self` keeps the type; `+ args` adds the type's own arguments and needs some to match. What no
# rule matches becomes null.
RULES = _tables("""
[mysql_to_postgres]
TINYINT* -> SMALLINT
SMALLINT* -> SMALLINT
MEDIUMINT* -> INTEGER
BIGINT* -> BIGINT
INT* -> INTEGER
FLOAT* -> REAL
DOUBLE* -> DOUBLE PRECISION
DECIMAL* -> NUMERIC
NUMERIC* -> NUMERIC
VARCHAR* -> VARCHAR
CHAR* -> CHAR
TINYTEXT* -> TEXT
MEDIUMTEXT* -> TEXT
LONGTEXT* -> TEXT
TEXT* -> TEXT
TINYBLOB*,MEDIUMBLOB*,LONGBLOB* -> BYTEA
BINARY* -> BYTEA
VARBINARY* -> BYTEA
BLOB* -> BYTEA
DATETIME* -> TIMESTAMP
TIMESTAMP* -> TIMESTAMP
ENUM* -> VARCHAR(255)
SET* -> VARCHAR(255)
JSON* -> JSONB
YEAR* -> SMALLINT
=DATE -> DATE
=TIME -> TIME
BOOL* -> BOOLEAN

[postgres_to_mysql]
TIMESTAMP WITH TIME ZONE* -> DATETIME
TIMESTAMP WITHOUT TIME ZONE* -> DATETIME
TIMESTAMP* -> DATETIME
VARCHAR(* -> self
CHARACTER VARYING (* -> VARCHAR + args
CHARACTER VARYING* -> VARCHAR(255)
CHAR(* -> self
CHARACTER* -> CHAR(255)
DOUBLE PRECISION* -> DOUBLE
NUMERIC* -> DECIMAL + args
NUMERIC* -> DECIMAL
DECIMAL* -> DECIMAL + args
DECIMAL* -> DECIMAL
=SMALLINT -> SMALLINT
=INTEGER -> INT
=BIGINT -> BIGINT
=REAL -> FLOAT
=NUMERIC -> DECIMAL
=DECIMAL -> DECIMAL
=CHAR -> CHAR
=VARCHAR -> VARCHAR
=TEXT -> TEXT
=BYTEA -> BLOB
=DATE -> DATE
=TIME -> TIME
=BOOLEAN -> TINYINT(1)
=BOOL -> TINYINT(1)
=JSON -> JSON
=JSONB -> JSON
=UUID -> CHAR(36)
=SERIAL -> INT AUTO_INCREMENT
=BIGSERIAL -> BIGINT AUTO_INCREMENT
=TIMESTAMPTZ -> DATETIME

[sqlite_to_postgres]
INTEGER*,INT* -> INTEGER
BIGINT* -> BIGINT
SMALLINT* -> SMALLINT
REAL*,DOUBLE*,FLOAT* -> DOUBLE PRECISION
NUMERIC*,DECIMAL* -> NUMERIC
TEXT*,VARCHAR*,CHAR*,CLOB* -> TEXT
BLOB* -> BYTEA
=DATETIME,TIMESTAMP* -> TIMESTAMP
=DATE -> DATE
=BOOLEAN -> BOOLEAN

[sqlite_to_mysql]
INTEGER*,INT* -> INT
BIGINT* -> BIGINT
SMALLINT* -> SMALLINT
REAL*,FLOAT* -> FLOAT
DOUBLE* -> DOUBLE
NUMERIC*,DECIMAL* -> DECIMAL
TEXT*,CLOB* -> LONGTEXT
VARCHAR* -> VARCHAR(255)
CHAR* -> CHAR(255)
BLOB* -> LONGBLOB
=DATETIME,TIMESTAMP* -> DATETIME
=DATE -> DATE
=BOOLEAN -> TINYINT(1)

[postgres_to_sqlite]
SERIAL* -> INTEGER
BIGSERIAL* -> INTEGER
SMALLINT* -> SMALLINT
INTEGER*,INT* -> INTEGER
BIGINT* -> BIGINT
REAL* -> REAL
DOUBLE PRECISION* -> REAL
NUMERIC*,DECIMAL* -> NUMERIC
CHARACTER VARYING*,VARCHAR* -> TEXT
CHARACTER*,CHAR* -> TEXT
TEXT* -> TEXT
BYTEA* -> BLOB
TIMESTAMP* -> TEXT
=DATE -> TEXT
=TIME -> TEXT
BOOL* -> INTEGER
=JSON,=JSONB -> TEXT
=UUID -> TEXT
else -> TEXT

[mysql_to_sqlite]
TINYINT*,SMALLINT*,MEDIUMINT*,INT* -> INTEGER
BIGINT* -> BIGINT
FLOAT* -> REAL
DOUBLE* -> REAL
DECIMAL*,NUMERIC* -> NUMERIC
VARCHAR*,CHAR*,TINYTEXT*,MEDIUMTEXT*,LONGTEXT*,TEXT*,ENUM*,SET* -> TEXT
TINYBLOB*,MEDIUMBLOB*,LONGBLOB*,BLOB*,BINARY*,VARBINARY* -> BLOB
DATETIME*,TIMESTAMP* -> TEXT
=DATE -> TEXT
=TIME -> TEXT
=YEAR -> INTEGER
JSON* -> TEXT
BOOL* -> INTEGER
else -> TEXT

[mariadb_to_postgres]
TINYINT* -> SMALLINT
SMALLINT* -> SMALLINT
MEDIUMINT* -> INTEGER
INT* -> INTEGER
BIGINT* -> BIGINT
FLOAT* -> REAL
DOUBLE* -> DOUBLE PRECISION
DECIMAL*,NUMERIC* -> NUMERIC
VARCHAR*,CHAR* -> TEXT
TINYTEXT*,MEDIUMTEXT*,LONGTEXT*,TEXT* -> TEXT
TINYBLOB*,MEDIUMBLOB*,LONGBLOB*,BLOB* -> BYTEA
DATETIME*,TIMESTAMP* -> TIMESTAMP
=DATE -> DATE
=TIME -> TIME
BOOL* -> BOOLEAN
JSON* -> JSONB

[mariadb_to_sqlite]
TINYINT*,SMALLINT*,MEDIUMINT*,INT* -> INTEGER
BIGINT* -> BIGINT
FLOAT*,DOUBLE* -> REAL
DECIMAL*,NUMERIC* -> NUMERIC
VARCHAR*,CHAR*,TINYTEXT*,MEDIUMTEXT*,LONGTEXT*,TEXT*,ENUM*,SET* -> TEXT
TINYBLOB*,MEDIUMBLOB*,LONGBLOB*,BLOB* -> BLOB
DATETIME*,TIMESTAMP* -> TEXT
=DATE,=TIME -> TEXT
BOOL* -> INTEGER
JSON* -> TEXT
else -> TEXT

[postgres_to_mariadb]
TIMESTAMP WITH TIME ZONE* -> DATETIME
TIMESTAMP WITHOUT TIME ZONE* -> DATETIME
TIMESTAMP* -> DATETIME
CHARACTER VARYING* -> VARCHAR(255)
CHARACTER* -> CHAR(255)
DOUBLE PRECISION* -> DOUBLE
NUMERIC* -> DECIMAL
=SMALLINT -> SMALLINT
=INTEGER -> INT
=BIGINT -> BIGINT
=REAL -> FLOAT
=NUMERIC -> DECIMAL
=DECIMAL -> DECIMAL
=CHAR -> CHAR
=VARCHAR -> VARCHAR
=TEXT -> TEXT
=BYTEA -> BLOB
=DATE -> DATE
=TIME -> TIME
=BOOLEAN -> TINYINT(1)
=BOOL -> TINYINT(1)
=JSON -> JSON
=JSONB -> JSON
=UUID -> CHAR(36)
=SERIAL -> INT AUTO_INCREMENT
=BIGSERIAL -> BIGINT AUTO_INCREMENT
=TIMESTAMPTZ -> DATETIME

[cockroachdb_to_postgres]
TIMESTAMP WITH TIME ZONE* -> TIMESTAMPTZ
TIMESTAMP WITHOUT TIME ZONE* -> TIMESTAMP
TIMESTAMP* -> TIMESTAMP
CHARACTER VARYING* -> VARCHAR
CHARACTER* -> CHAR
DECIMAL* -> DECIMAL
NUMERIC* -> NUMERIC
=SMALLINT -> SMALLINT
=INTEGER -> INTEGER
=INT -> INTEGER
=BIGINT -> BIGINT
=REAL -> REAL
=DOUBLE -> DOUBLE PRECISION
=DOUBLE PRECISION -> DOUBLE PRECISION
=FLOAT8 -> DOUBLE PRECISION
=FLOAT4 -> REAL
=BOOLEAN -> BOOLEAN
=BOOL -> BOOLEAN
=DATE -> DATE
=TIME -> TIME
=TEXT -> TEXT
=STRING -> TEXT
=BYTEA -> BYTEA
=BYTES -> BYTEA
=JSON -> JSONB
=JSONB -> JSONB
=UUID -> UUID
=TIMESTAMPTZ -> TIMESTAMPTZ

[postgres_to_cockroachdb]
BIGSERIAL* -> BIGINT
SMALLSERIAL* -> SMALLINT
SERIAL* -> INT
SMALLINT* -> SMALLINT
=INT2 -> SMALLINT
=INT8 -> BIGINT
BIGINT* -> BIGINT
INTEGER*,INT* -> INT
REAL* -> FLOAT4
DOUBLE PRECISION*,DOUBLE* -> FLOAT8
NUMERIC*,DECIMAL* -> DECIMAL
CHARACTER VARYING* -> STRING
CHARACTER* -> STRING
VARCHAR* -> STRING
TEXT* -> STRING
TIMESTAMP WITH TIME ZONE* -> TIMESTAMPTZ
TIMESTAMP WITHOUT TIME ZONE* -> TIMESTAMP
TIMESTAMP* -> TIMESTAMP
DATE* -> DATE
TIME* -> TIME
BOOLEAN*,BOOL* -> BOOL
JSONB* -> JSONB
JSON* -> JSONB
UUID* -> UUID

[cockroachdb_to_mysql]
SERIAL*,BIGSERIAL* -> BIGINT
SMALLSERIAL* -> SMALLINT
SMALLINT* -> SMALLINT
=INT2 -> SMALLINT
=INT8 -> BIGINT
BIGINT* -> BIGINT
INTEGER*,INT* -> INT
REAL*,DOUBLE PRECISION* -> DOUBLE
FLOAT4* -> FLOAT
FLOAT8* -> DOUBLE
NUMERIC*,DECIMAL* -> DECIMAL
CHARACTER VARYING*,VARCHAR* -> VARCHAR(255)
CHARACTER*,CHAR* -> CHAR(255)
STRING*,TEXT* -> LONGTEXT
BYTES*,BYTEA* -> LONGBLOB
TIMESTAMP* -> DATETIME
=DATE -> DATE
=TIME -> TIME
BOOL* -> TINYINT(1)
=JSON,=JSONB -> JSON
=UUID -> CHAR(36)

[cockroachdb_to_sqlite]
SERIAL*,BIGSERIAL* -> INTEGER
SMALLSERIAL* -> SMALLINT
SMALLINT* -> SMALLINT
=INT2 -> SMALLINT
=INT8 -> BIGINT
BIGINT* -> BIGINT
INTEGER*,INT* -> INTEGER
REAL*,DOUBLE PRECISION* -> REAL
NUMERIC*,DECIMAL* -> NUMERIC
CHARACTER VARYING*,VARCHAR*,CHARACTER*,CHAR*,TEXT* -> TEXT
BYTES*,BYTEA* -> BLOB
TIMESTAMP* -> TEXT
=DATE,=TIME -> TEXT
BOOL* -> INTEGER
=JSON,=JSONB -> TEXT
=UUID -> TEXT
else -> TEXT

[mssql_to_postgres]
BIGINT*,INT* -> BIGINT
SMALLINT* -> SMALLINT
TINYINT* -> SMALLINT
REAL*,FLOAT* -> REAL
NUMERIC*,DECIMAL* -> NUMERIC
VARCHAR*,NVARCHAR* -> TEXT
CHAR*,NCHAR* -> TEXT
TEXT*,NTEXT* -> TEXT
VARBINARY*,IMAGE* -> BYTEA
DATETIMEOFFSET* -> TIMESTAMP WITH TIME ZONE
DATETIME2*,DATETIME*,SMALLDATETIME* -> TIMESTAMP
=DATE -> DATE
=TIME -> TIME
=BIT -> BOOLEAN
=UNIQUEIDENTIFIER -> UUID
XML* -> XML

[mssql_to_mysql]
BIGINT* -> BIGINT
INT* -> INT
SMALLINT* -> SMALLINT
TINYINT* -> TINYINT
REAL*,FLOAT* -> DOUBLE
NUMERIC*,DECIMAL* -> DECIMAL
VARCHAR*,NVARCHAR* -> VARCHAR(255)
CHAR*,NCHAR* -> CHAR(255)
TEXT*,NTEXT* -> LONGTEXT
VARBINARY*,IMAGE* -> LONGBLOB
DATETIME2*,DATETIME*,SMALLDATETIME*,DATETIMEOFFSET* -> DATETIME
=DATE -> DATE
=TIME -> TIME
=BIT -> TINYINT(1)
=UNIQUEIDENTIFIER -> CHAR(36)

[mssql_to_sqlite]
BIGINT*,INT*,SMALLINT*,TINYINT* -> INTEGER
REAL*,FLOAT* -> REAL
NUMERIC*,DECIMAL* -> NUMERIC
VARCHAR*,NVARCHAR*,CHAR*,NCHAR*,TEXT*,NTEXT*,XML* -> TEXT
VARBINARY*,IMAGE* -> BLOB
DATETIME*,SMALLDATETIME* -> TEXT
=DATE,=TIME -> TEXT
=BIT -> INTEGER
=UNIQUEIDENTIFIER -> TEXT
else -> TEXT

[postgres_to_mssql]
SERIAL*,BIGSERIAL* -> BIGINT IDENTITY(1,1)
SMALLSERIAL* -> SMALLINT IDENTITY(1,1)
SMALLINT* -> SMALLINT
INTEGER*,INT* -> INT
BIGINT* -> BIGINT
REAL*,DOUBLE PRECISION* -> FLOAT
NUMERIC*,DECIMAL* -> self
CHARACTER VARYING*,VARCHAR* -> NVARCHAR(255)
CHARACTER*,CHAR* -> NCHAR(255)
TEXT* -> NVARCHAR(MAX)
BYTEA* -> VARBINARY(MAX)
TIMESTAMP WITH TIME ZONE* -> DATETIMEOFFSET
TIMESTAMP* -> DATETIME2
=DATE -> DATE
=TIME -> TIME
BOOL* -> BIT
=UUID -> UNIQUEIDENTIFIER
=JSON,=JSONB -> NVARCHAR(MAX)
=XML -> XML

[mysql_to_mssql]
TINYINT* -> TINYINT
SMALLINT* -> SMALLINT
MEDIUMINT* -> INT
INT* -> INT
BIGINT* -> BIGINT
FLOAT* -> FLOAT
DOUBLE* -> FLOAT
DECIMAL*,NUMERIC* -> DECIMAL
VARCHAR* -> NVARCHAR(255)
CHAR* -> NCHAR(255)
TINYTEXT*,MEDIUMTEXT*,LONGTEXT*,TEXT* -> NVARCHAR(MAX)
TINYBLOB*,MEDIUMBLOB*,LONGBLOB*,BLOB* -> VARBINARY(MAX)
DATETIME* -> DATETIME2
TIMESTAMP* -> DATETIME2
=DATE -> DATE
=TIME -> TIME
BOOL* -> BIT
JSON* -> NVARCHAR(MAX)
ENUM*,SET* -> NVARCHAR(255)

[sqlite_to_mssql]
INTEGER*,INT* -> INT
BIGINT* -> BIGINT
SMALLINT* -> SMALLINT
REAL*,FLOAT*,DOUBLE* -> FLOAT
NUMERIC*,DECIMAL* -> DECIMAL
TEXT*,CHAR*,VARCHAR* -> NVARCHAR(MAX)
BLOB* -> VARBINARY(MAX)
else -> NVARCHAR(MAX)

[writer_postgres]
= -> TEXT
=INT2 -> SMALLINT
=INT8 -> BIGINT
BIGINT* -> BIGINT
SMALLINT* -> SMALLINT
INTEGER*,INT* -> INTEGER
SMALLINT* -> SMALLINT
TINYINT* -> SMALLINT
MEDIUMINT* -> INTEGER
FLOAT* -> REAL
DOUBLE* -> DOUBLE PRECISION
REAL* -> REAL
DECIMAL*,NUMERIC* -> NUMERIC
VARCHAR* -> VARCHAR
CHAR* -> CHAR
LONGTEXT*,MEDIUMTEXT*,TINYTEXT*,TEXT* -> TEXT
JSON* -> JSONB
BLOB*,LONGBLOB*,MEDIUMBLOB*,TINYBLOB*,BINARY*,VARBINARY* -> BYTEA
DATETIME*,TIMESTAMP* -> TIMESTAMP
=DATE -> DATE
=TIME -> TIME
BOOL*,BOOLEAN* -> BOOLEAN
else -> self

[writer_cockroachdb]
= -> TEXT
INT* -> INT
BIGINT* -> BIGINT
SMALLINT* -> SMALLINT
TINYINT* -> SMALLINT
FLOAT* -> FLOAT4
DOUBLE* -> FLOAT8
REAL* -> FLOAT4
DECIMAL*,NUMERIC* -> DECIMAL
VARCHAR* -> STRING
CHAR* -> STRING
TEXT* -> STRING
JSON* -> JSONB
BLOB*,BYTEA*,BINARY* -> BYTES
DATETIME*,TIMESTAMPTZ* -> TIMESTAMPTZ
TIMESTAMP* -> TIMESTAMP
=DATE -> DATE
=TIME -> TIME
BOOL* -> BOOL
else -> self
""")
#: Pairs that use another pair's rules.
SHARED = {"mariadb_to_cockroachdb": "mariadb_to_postgres", "cockroachdb_to_mariadb": "cockroachdb_to_mysql", "mssql_to_cockroachdb": "mssql_to_postgres", "mssql_to_mariadb": "mssql_to_mysql", "cockroachdb_to_mssql": "postgres_to_mssql", "mariadb_to_mssql": "mysql_to_mssql"}


# Source > target types whose conversion may lose something.
LOSSY = "TIMESTAMPTZ>TIMESTAMP TIMESTAMP>DATE TEXT>VARCHAR BIGINT>INT BIGINT>SMALLINT INT>SMALLINT DOUBLE>FLOAT DOUBLE>REAL DECIMAL>FLOAT NUMERIC>FLOAT JSONB>JSON BYTEA>BLOB".split()


# What writers of the other dialects make of a type. Names keep their arguments; other types become `else`.
NORMALISED = {
    "mysql": ("INT TINYINT SMALLINT MEDIUMINT BIGINT FLOAT DOUBLE DECIMAL NUMERIC VARCHAR CHAR TEXT TINYTEXT MEDIUMTEXT LONGTEXT BLOB TINYBLOB MEDIUMBLOB LONGBLOB DATETIME TIMESTAMP =DATE =TIME", {"BOOL": "TINYINT(1)", "JSON": "JSON"}, "LONGTEXT"),
    "mssql": ("", {"=TEXT": "NVARCHAR(MAX)", "=TINYTEXT": "NVARCHAR(MAX)", "=MEDIUMTEXT": "NVARCHAR(MAX)", "=LONGTEXT": "NVARCHAR(MAX)", "=CLOB": "NVARCHAR(MAX)", "=BLOB": "VARBINARY(MAX)", "=TINYBLOB": "VARBINARY(MAX)", "=MEDIUMBLOB": "VARBINARY(MAX)", "=LONGBLOB": "VARBINARY(MAX)", "=BYTEA": "VARBINARY(MAX)", "=BINARY": "VARBINARY(MAX)", "=VARBINARY": "VARBINARY(MAX)", "=IMAGE": "VARBINARY(MAX)", "=": "NVARCHAR(MAX)"}, "self"),
}


def _matches(upper: Column, name: str) -> Column:
    return upper == name[1:] if name.startswith("=") else upper.startswith(name.removesuffix("*"))


def mapped_type(kind: Column, pair: str) -> Column:
    """The target type of a source type column; null where no rule fits."""
    upper = F.upper(F.trim(kind))
    args = F.regexp_extract(upper, r"(\(.*)$", 1)
    out = None
    for names, target in RULES[SHARED.get(pair, pair)]:
        if names == ("else",):
            return F.lit(target) if out is None else out.otherwise(upper if target == "self" else F.lit(target))
        hit = reduce(Column.__or__, (_matches(upper, n) for n in names))
        value = kind if target == "self" else F.lit(target)
        if target.endswith(" + args"):
            hit, value = hit & (args != ""), F.concat(F.lit(target.removesuffix(" + args")), args)
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return out


def normalised_type(kind: Column, dialect: str) -> Column:
    """The type that a writer of the dialect creates a column with: upper case, unknown types replaced or kept."""
    if dialect in ("postgres", "cockroachdb"):
        return mapped_type(kind, f"writer_{dialect}")
    names, others, rest = NORMALISED[{"mariadb": "mysql"}.get(dialect, dialect)]
    upper = F.upper(F.trim(F.coalesce(kind, F.lit(""))))
    out = F.when(reduce(Column.__or__, (_matches(upper, n) for n in names.split()), F.lit(False)), upper)
    for name, target in others.items():
        out = out.when(_matches(upper, name), F.lit(target))
    return out.otherwise(upper if rest == "self" else F.lit(rest))


def base_type(kind: Column) -> Column:
    return F.upper(F.trim(F.split(kind, r"\(")[0]))


def lossy(source: Column, target: Column) -> Column:
    return F.concat_ws(">", base_type(source), base_type(target)).isin(*LOSSY)
