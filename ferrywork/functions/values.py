"""Scalar functions of keys, values, checksums and timestamps, as Column expressions."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def row_key(table: str, keys: list[str]) -> Column:
    """table:value for one key column, table:{"a":..,"b":..} with sorted names for several."""
    if len(keys) == 1:
        return F.concat(F.lit(f"{table}:"), F.col(keys[0]).cast("string"))
    return F.concat(F.lit(f"{table}:"), F.to_json(F.struct(*sorted(keys)), {"ignoreNullFields": "false"}))


def key_hash(key: Column) -> Column:
    """The first 8 bytes of SHA-256, as hex."""
    return F.substring(F.sha2(key, 256), 1, 16)


def collection_of(key: Column) -> Column:
    """What stands before the first colon; the whole key if there is none."""
    return F.split(key, ":", 2)[0]


def document_id(value: Column) -> Column:
    return F.translate(value, " :./", "____")


def normalized_table(name: Column) -> Column:
    return F.regexp_replace(name, r"^public\.", "")


def truncated(text: Column, most: int) -> Column:
    """At most `most` characters, the last three of a longer text being dots."""
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.substring(text, 1, most - 3), F.lit("...")))


def to_int(value: Column) -> Column:
    """Whole numbers as they are, fractions cut off; null where neither is written."""
    text = F.trim(value.cast("string"))
    return F.coalesce(text.try_cast("bigint"), text.try_cast("double").try_cast("bigint"))


def to_float(value: Column) -> Column:
    return F.trim(value.cast("string")).try_cast("double")


# The spellings of truth values.
TRUE, FALSE = ("1", "t", "T", "TRUE", "true", "True"), ("0", "f", "F", "FALSE", "false", "False")


def to_bool(value: Column) -> Column:
    """The listed spellings; other numbers are true unless zero; null otherwise."""
    text = value.cast("string")
    number = text.try_cast("double")
    return F.when(text.isin(*TRUE), True).when(text.isin(*FALSE), False).when(number.isNotNull(), number != 0)


CONVERSIONS = {"int": to_int, "float": to_float, "bool": to_bool, "string": lambda v: v.cast("string"), "timestamp": lambda v: timestamp_of(v)}

#: A timestamp's text: date, separator, time, fraction, zone.
_STAMP = r"^(\d{4}-\d{2}-\d{2})(?:([ T])(\d{2}:\d{2}:\d{2})(\.\d{1,9})?(Z|[+-]\d{2}:\d{2})?)?$"

# How dialects write timestamps: as date, space and time, or with T, fraction and zone (digits of it at most).
PLAIN, FRACTION = ("mysql", "mariadb"), {"mssql": 7}


def _stamp(value: Column) -> list[Column]:
    """date, separator, time, fraction and zone of a text; empty texts where it is no timestamp."""
    return [F.regexp_extract(value, _STAMP, k) for k in range(1, 6)]


def _real(date: Column, time: Column) -> Column:
    """Whether a date and time (may be empty) exist."""
    return F.try_to_timestamp(F.concat_ws(" ", date, F.when(time != "", time).otherwise("00:00:00")), F.lit("yyyy-MM-dd HH:mm:ss")).isNotNull()


def timestamp_of(value: Column) -> Column:
    """A timestamp (UTC) from a date, a date and time, or one with T and a zone; null if none fits."""
    text = value.cast("string")
    date, sep, time, fraction, zone = _stamp(text)
    ok = (date != "") & F.when(sep == "T", True).when(sep == " ", zone == "").otherwise(True) & _real(date, time)
    return F.when(ok, F.try_to_timestamp(F.concat(date, F.lit("T"), F.when(time != "", time).otherwise("00:00:00"), fraction, F.when(zone != "", zone).otherwise("Z"))))


def convert_timestamp(value: Column, target: str) -> Column:
    """A timestamp text as the target dialect writes it, by its own clock; what cannot be read stays.

    Read are a date and time without zone, one with T and zone, and a date. Fractions keep their digits without zeros at
    the end (seven at most for mssql), none in dialects without them; a zone stays, one of no offset is Z.
    """
    date, sep, time, fraction, zone = _stamp(value)
    ok = (date != "") & F.when(sep == "T", zone != "").when(sep == " ", zone == "").otherwise(True) & _real(date, time)
    clock = F.when(time != "", time).otherwise("00:00:00")
    if target in PLAIN:
        out = F.concat(date, F.lit(" "), clock)
    else:
        kept = F.regexp_replace(F.substring(fraction, 1, FRACTION.get(target, 9) + 1), r"\.?0*$", "")
        out = F.concat(date, F.lit("T"), clock, kept, F.when(zone.isin("", "+00:00", "-00:00"), "Z").otherwise(zone))
    return F.when(ok, out).otherwise(value)


def compared_time(value: Column) -> Column:
    """The second (UTC) of a text that is a date with a time, for comparison. A date alone is none."""
    text = value.cast("string")
    date, sep, time, _, zone = _stamp(text)
    ok = (time != "") & ((sep == "T") | (zone == "")) & _real(date, time)
    return F.when(ok, F.try_to_timestamp(F.concat(date, F.lit("T"), time, F.when(zone != "", zone).otherwise("Z"))))


def same_family(source: str, target: str) -> bool:
    """Whether timestamps need no conversion between two dialects."""
    families = ({"mysql", "mariadb"}, {"postgres", "cockroachdb"})
    return source == target or any({source, target} <= f for f in families)


def is_timestamp_type(kind: Column) -> Column:
    """Types that hold a date with a time."""
    return F.upper(F.trim(kind)).rlike("^(DATETIME|TIMESTAMP|SMALLDATETIME)")


def remaining_ttl(ttl: Column) -> Column:
    """One second less, at least one; none for zero or less."""
    return F.when(ttl > 0, F.greatest(ttl - 1, F.lit(1)))


def plain_decimal(value: Column) -> Column:
    """A decimal's text without trailing zeros; zero has no sign."""
    text = value.cast("string")
    short = F.when(text.contains("."), F.regexp_replace(text, r"\.?0+$", "")).otherwise(text)
    return F.when(short.isin("-0", "", "-"), F.lit("0")).otherwise(short)


def values_equal(a: Column, b: Column, kind_a: str = "string", kind_b: str = "string") -> Column:
    """Both null, or equal as what both can be read as: times (to the second), else exact decimals, else numbers within
    1e-9, else texts. Columns of one type that is neither text nor floating are compared as they are."""
    if kind_a == kind_b and not kind_a.startswith(("string", "double", "float", "varchar", "char")):
        return a.eqNullSafe(b)
    x, y = a.cast("string"), b.cast("string")
    tx, ty = compared_time(x), compared_time(y)
    dx, dy = x.try_cast("decimal(38,18)"), y.try_cast("decimal(38,18)")
    fx, fy = x.try_cast("double"), y.try_cast("double")
    ladder = F.when(x == y, True)
    if not (_numeric(kind_a) or _numeric(kind_b)):
        ladder = ladder.when(tx.isNotNull() & ty.isNotNull(), tx == ty)
    ladder = ladder.when(dx.isNotNull() & dy.isNotNull(), dx == dy).when(fx.isNotNull() & fy.isNotNull(), F.abs(fx - fy) < 1e-9)
    return F.when(a.isNull() | b.isNull(), a.isNull() & b.isNull()).otherwise(ladder.otherwise(False))


def _numeric(kind: str) -> bool:
    return kind.startswith(("tinyint", "smallint", "int", "bigint", "float", "double", "decimal", "boolean"))


def row_checksum(columns: list[Column], joiner: str = "|") -> Column:
    """SHA-256 of the values in the order given; nulls count as <nil>."""
    return F.sha2(F.concat_ws(joiner, *(F.coalesce(c.cast("string"), F.lit("<nil>")) for c in columns)), 256)


def map_checksum(fields: Column) -> Column:
    """SHA-256 of a map's entries in the order of their keys."""
    return F.sha2(F.array_join(F.transform(F.array_sort(F.map_entries(fields)), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("<nil>")))), ","), 256)


def md5_row(columns: list[str]) -> Column:
    """MD5 of a row as JSON, nulls included, columns in the order given."""
    return F.md5(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}))


def row_checksum_of(dialect: str, columns: list[str]) -> Column:
    """A row's checksum as the dialect's side makes it: MD5 of its JSON, or SHA-256 of its values by name of column."""
    if dialect in ("postgres", "cockroachdb"):
        return md5_row(columns)
    return row_checksum([F.col(c) for c in sorted(columns)], "" if dialect == "sqlite" else "|")


def typed_checksum(kind: Column, members: Column) -> Column:
    """SHA-256 of a type and its members (texts); the order of a set's members does not count, that of others does."""
    ordered = F.when(kind.isin("set", "zset"), F.array_sort(members)).otherwise(members)
    return F.sha2(F.concat(kind, F.lit("|"), F.array_join(ordered, ",")), 256)


def canonical_json(document: Column) -> Column:
    """JSON text with the keys of every object in order, at any depth; null where it is no JSON."""

    @F.pandas_udf("string")
    def ordered(texts: pd.Series) -> pd.Series:
        def one(text: str | None) -> str | None:
            try:
                return None if text is None else json.dumps(json.loads(text), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
            except ValueError:
                return None

        return texts.map(one)

    return ordered(document)


def human_bytes(n: Column) -> Column:
    """A number of bytes in B, KB, MB, GB or TB, by 1024, one digit after the point from KB on."""
    size = n.cast("double")
    out = F.when(size < 1024, F.concat(n.cast("bigint").cast("string"), F.lit(" B")))
    for power, unit in enumerate(("KB", "MB", "GB"), 1):
        out = out.when(size < 1024.0 ** (power + 1), F.concat(F.format_string("%.1f", size / 1024.0**power), F.lit(f" {unit}")))
    return out.otherwise(F.concat(F.format_string("%.1f", size / 1024.0**4), F.lit(" TB")))


def human_seconds(seconds: Column) -> Column:
    """A duration as 45s, 3m5s or 2h3m4s."""
    s = F.floor(seconds).cast("bigint")
    h, m, r = F.floor(s / 3600), F.floor(s / 60) % 60, s % 60
    return F.when(s < 60, F.concat(s.cast("string"), F.lit("s"))).when(s < 3600, F.format_string("%dm%ds", m, r)).otherwise(F.format_string("%dh%dm%ds", h, m, r))


def quoted(name: str, dialect: str) -> str:
    """An identifier as the dialect quotes it."""
    if dialect in ("mysql", "mariadb"):
        return "`" + name.replace("`", "``") + "`"
    if dialect == "mssql":
        return "[" + name.replace("]", "]]") + "]"
    return '"' + name.replace('"', '""') + '"'
