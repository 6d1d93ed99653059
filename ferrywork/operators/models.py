"""Converters between tables, documents and key-value records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrywork.functions.values import collection_of, document_id, row_key


def texts(df: DataFrame, columns: list[str]):
    """A map of column names to texts, without nulls; nested values as JSON."""
    nested = ("struct", "array", "map", "variant")
    kinds = dict(df.dtypes)
    value = lambda c: F.to_json(c) if kinds[c].startswith(nested) else F.col(c).cast("string")
    pairs = [x for c in columns for x in (F.lit(c), value(c))]
    return F.map_filter(F.create_map(*pairs), lambda k, v: v.isNotNull())


def rows_to_hashes(df: DataFrame, table: str, keys: list[str]) -> DataFrame:
    """key, type, value (map of texts), ttl_seconds of a hash for each row."""
    return df.select(row_key(table, keys).alias("key"), F.lit("hash").alias("type"), texts(df, df.columns).alias("value"), F.lit(0).cast("bigint").alias("ttl_seconds"))


def rows_to_documents(df: DataFrame, table: str, keys: list[str]) -> DataFrame:
    """collection, _id (the row's key), document_id (key values, sorted and joined by _), document (JSON)."""
    ids = F.concat_ws("_", F.array_sort(F.array(*(F.col(k).cast("string") for k in keys))))
    return df.select(F.lit(table).alias("collection"), row_key(table, keys).alias("_id"), document_id(ids).alias("document_id"), F.to_json(F.struct(*df.columns)).alias("document"))


def hashes_to_rows(hashes: DataFrame, columns: list[str]) -> DataFrame:
    """_key and one text column for each name; a missing field is null."""
    return hashes.select(F.col("key").alias("_key"), *(F.try_element_at("value", F.lit(c)).alias(c) for c in columns))


def documents_to_rows(documents: DataFrame, columns: list[str]) -> DataFrame:
    """_id and one text column for each top-level field of the JSON document."""
    return documents.select("_id", *(F.get_json_object("document", f"$.{c}").alias(c) for c in columns))


def string_to_document(records: DataFrame, key: str, value: str) -> DataFrame:
    """A text that is a JSON object becomes the document, anything else its field `value`."""
    whole = F.try_parse_json(value)
    is_object = F.coalesce(F.schema_of_variant(whole).startswith("OBJECT"), F.lit(False))
    return records.select(F.col(key).alias("_id"), F.when(is_object, F.col(value)).otherwise(F.to_json(F.struct(F.col(value).alias("value")))).alias("document"))


def streams_to_documents(streams: DataFrame) -> DataFrame:
    """A document for each entry (id, fields) of a stream: _id key:entry, _stream the key. Repeated entries come once."""
    each = streams.select("key", F.explode("value").alias("e")).select("key", "e.id", "e.fields").dropDuplicates(["key", "id"])
    return each.select(F.concat_ws(":", "key", "id").alias("_id"), F.col("key").alias("_stream"), "fields")


def members_to_documents(records: DataFrame, field: str) -> DataFrame:
    """Lists (`items`), sets and sorted sets (`members`) as one document a key."""
    return records.select(F.col("key").alias("_id"), F.to_json(F.struct(F.col("value").alias(field))).alias("document"))


def with_lookups(df: DataFrame, target: DataFrame, local: str, foreign: str, name: str) -> DataFrame:
    """Rows with the referenced row of another table as a struct; rows without one keep null."""
    return df.join(target.select(F.col(foreign).alias("_f"), F.struct(*target.columns).alias(name)), F.col(local) == F.col("_f"), "left").drop("_f")


def documents_to_hashes(documents: DataFrame, columns: list[str]) -> DataFrame:
    """key, type, value, ttl_seconds of a hash for each document (JSON): every field as text, nested ones as JSON, without
    nulls; `_id` is the key and no field."""
    fields = [c for c in columns if c != "_id"]
    pairs = [x for c in fields for x in (F.lit(c), F.get_json_object("document", f"$.{c}"))]
    value = F.map_filter(F.create_map(*pairs), lambda k, v: v.isNotNull()) if pairs else F.expr("cast(map() as map<string,string>)")
    return documents.select(F.col("_id").alias("key"), F.lit("hash").alias("type"), value.alias("value"), F.lit(0).cast("bigint").alias("ttl_seconds"))


def hashes_to_documents(hashes: DataFrame) -> DataFrame:
    """_id, collection and document: the fields of a hash with `_id`, and `_ttl` where the key had one."""
    more = F.map_concat(F.col("value"), F.create_map(F.lit("_id"), F.col("key")), F.when(F.col("ttl_seconds") > 0, F.create_map(F.lit("_ttl"), F.col("ttl_seconds").cast("string"))).otherwise(F.expr("cast(map() as map<string,string>)")))
    return hashes.select(F.col("key").alias("_id"), collection_of(F.col("key")).alias("collection"), F.to_json(F.map_from_entries(F.array_sort(F.map_entries(more)))).alias("document"))


def records_to_documents(records: DataFrame) -> DataFrame:
    """_id, collection and document of records (key, type, value as JSON, ttl_seconds) of any type.

    hash: its fields; string: the object that it is, else its text as `value`; list: `items`; set and zset: `members`;
    stream: `entries`, one document an entry (_id key:entry, _stream the key, repeated entries once).
    """
    is_object = F.coalesce(F.schema_of_variant(F.try_parse_json(F.get_json_object("envelope", "$.value"))).startswith("OBJECT"), F.lit(False))
    rows = records.withColumn("envelope", F.concat(F.lit('{"value":'), F.coalesce("value", F.lit("null")), F.lit("}")))
    text = F.get_json_object("envelope", "$.value")
    named = lambda name: F.concat(F.lit(f'{{"{name}":'), F.col("value"), F.lit("}"))
    simple = rows.where("type <> 'stream'").select(
        F.col("key").alias("_id"), collection_of(F.col("key")).alias("collection"),
        F.when(F.col("type") == "hash", F.col("value")).when((F.col("type") == "string") & is_object, text).when(F.col("type") == "list", named("items")).when(F.col("type").isin("set", "zset"), named("members")).otherwise(named("value")).alias("document"),
        F.when(F.col("ttl_seconds") > 0, F.col("ttl_seconds")).alias("_ttl"),
    )
    entries = rows.where("type = 'stream'").withColumn("e", F.explode(F.from_json("value", "array<struct<id: string, fields: map<string,string>>>"))).withColumn("_entry", F.col("e.id")).dropDuplicates(["key", "_entry"])
    streams = entries.select(F.concat_ws(":", "key", "e.id").alias("_id"), collection_of(F.col("key")).alias("collection"), F.to_json(F.map_concat(F.col("e.fields"), F.create_map(F.lit("_stream"), F.col("key")))).alias("document"), F.when(F.col("ttl_seconds") > 0, F.col("ttl_seconds")).alias("_ttl"))
    return simple.unionByName(streams)


def flattened(records: DataFrame, fields: list[str]) -> DataFrame:
    """key and the fields of hash records, as columns, so that they compare with flat rows."""
    return records.select("key", *(F.when(F.col("type") == "hash", F.try_element_at("value", F.lit(c))).alias(c) for c in fields))


def wrapped(records: DataFrame) -> DataFrame:
    """_key and value of records that are no hashes: their value as JSON under the name `value`."""
    return records.select(F.col("key").alias("_key"), F.to_json(F.struct(F.col("value").alias("value"))).alias("value"))


def documents_with_lookups(df: DataFrame, table: str, keys: list[str], references: list[tuple[str, str, str]]) -> DataFrame:
    """rows_to_documents() with `lookups`: from, local, foreign and as of each reference (local column, table, its column)
    whose local column exists."""
    made = [F.struct(F.lit(t).alias("from"), F.lit(c).alias("local"), F.lit(f).alias("foreign"), F.lit(f"{t}_{f}").alias("as")) for c, t, f in references if c in df.columns]
    lookups = F.array(*made) if made else F.expr("cast(array() as array<struct<from: string, local: string, foreign: string, as: string>>)")
    return rows_to_documents(df, table, keys).withColumn("lookups", lookups)


def envelopes_of(df: DataFrame, table: str, keys: list[str], schema: str | None = None) -> DataFrame:
    """A row as the universal record: key, table, data_type, schema, primary_key and column_types (maps), data (JSON), size."""
    kinds = [x for n, k in df.dtypes for x in (F.lit(n), F.lit(k))]
    ids = [x for k in sorted(keys or df.columns) for x in (F.lit(k), F.col(k).cast("string"))]
    data = F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})
    return df.select(row_key(table, keys or df.columns).alias("key"), F.lit(table).alias("table"), F.lit("row").alias("data_type"), F.lit(schema).cast("string").alias("schema"), F.create_map(*ids).alias("primary_key"), F.create_map(*kinds).alias("column_types"), data.alias("data"), F.octet_length(data).cast("bigint").alias("size"))


def rows_of(records: DataFrame, table: str, schema: str) -> DataFrame:
    """The rows of a table back from universal records; records of another type or without data are left out."""
    return records.where((F.col("table") == table) & (F.col("data_type") == "row") & F.col("data").isNotNull()).select(F.from_json("data", schema).alias("_d")).select("_d.*")
