"""Queries of writers, verification, plans, models, sources and accounting, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ferrywork.functions import values
from ferrywork.operators import accounting, mapping, models, transformers, verify, writing
from ferrywork.operators.mapping import FieldRule
from ferrywork.operators.transformers import Context
from ferrywork.plans import ddl, planning
from ferrywork.plans.registry import QUERIES, SQL, query, table, values_table
from ferrywork.sources import registry, writers

# --- merging -------------------------------------------------------------------------------------------------------


@query("SELECT p_partkey, p_name, CASE WHEN p_partkey % 3 = 0 THEN p_size + 100 ELSE p_size END AS p_size, p_brand, CASE WHEN p_partkey % 3 = 0 THEN 'new' END AS note FROM part")
def write_partial_columns(spark, d):
    """Incoming rows lack a column and bring a new one: the old one stays, the new one is null elsewhere."""
    part = table(spark, d, "part").select("p_partkey", "p_name", "p_size", "p_brand")
    incoming = part.where("p_partkey % 3 = 0").select("p_partkey", "p_name", (F.col("p_size") + 100).alias("p_size"), F.lit("new").alias("note"))
    return writing.merge(part, incoming, ["p_partkey"])


_TWICE = "WITH inc AS (SELECT p_partkey % 50 AS p_partkey, p_size, p_partkey AS o FROM part), last AS (SELECT p_partkey, p_size FROM (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY o DESC) AS r FROM inc) WHERE r = 1) "


def _twice(spark, d, strategy):
    part = table(spark, d, "part")
    incoming = part.select((F.col("p_partkey") % 50).alias("p_partkey"), "p_size", F.col("p_partkey").alias("o"))
    return writing.merge(part.select("p_partkey", "p_size"), incoming, ["p_partkey"], strategy, [F.col("o")]).select("p_partkey", "p_size")


@query(_TWICE + "SELECT p_partkey, p_size FROM last UNION ALL SELECT p_partkey, p_size FROM part WHERE p_partkey NOT IN (SELECT p_partkey FROM last)")
def write_repeated_keys(spark, d):
    return _twice(spark, d, "overwrite")


@query(_TWICE + "SELECT p_partkey, p_size FROM part UNION ALL SELECT p_partkey, p_size FROM last WHERE p_partkey NOT IN (SELECT p_partkey FROM part)")
def write_skip_repeated_keys(spark, d):
    return _twice(spark, d, "skip")


@query("SELECT r_regionkey, r_name, CASE WHEN r_regionkey % 2 = 0 THEN 1 END AS mark FROM region UNION ALL SELECT NULL, 'none', 1")
def write_null_keys(spark, d):
    """Keys that are null equal each other."""
    region = table(spark, d, "region").select("r_regionkey", "r_name")
    target = region.unionByName(region.limit(1).select(F.lit(None).cast("int").alias("r_regionkey"), F.lit("none").alias("r_name")))
    incoming = region.where("r_regionkey % 2 = 0").select("r_regionkey").unionByName(region.limit(1).select(F.lit(None).cast("int").alias("r_regionkey"))).withColumn("mark", F.lit(1))
    return writing.merge(target, incoming, ["r_regionkey"])


@query("SELECT * FROM (VALUES ('postgres', 6553), ('mysql', 6553), ('mssql', 210), ('sqlite', 3276), ('other', 10000)) t(dialect, n)")
def statement_rows(spark, d):
    """Rows of a statement of ten columns of 100 characters."""
    rows = [(k, writing.rows_per_statement(100, 10, parameters=writers.PARAMETERS.get(k, 0))) for k in ("postgres", "mysql", "mssql", "sqlite", "other")]
    return spark.createDataFrame(rows, "dialect string, n int")


@query("SELECT max(length(concat('{\"n_nationkey\":', n_nationkey, ',\"n_name\":\"', n_name, '\"}'))) AS widest FROM nation")
def widest_row(spark, d):
    return spark.createDataFrame([(writing.widest_row(table(spark, d, "nation").select("n_nationkey", "n_name"), 1000),)], "widest int")


# The statement that moves rows into a table, by dialect and strategy.
_STATEMENTS = [
    ("postgres", "overwrite", 'INSERT INTO "t" ("k", "v") SELECT "k", "v" FROM "s" ON CONFLICT ("k") DO UPDATE SET "v" = excluded."v"'),
    ("cockroachdb", "skip", 'INSERT INTO "t" ("k", "v") SELECT "k", "v" FROM "s" ON CONFLICT ("k") DO NOTHING'),
    ("sqlite", "overwrite", 'INSERT INTO "t" ("k", "v") SELECT "k", "v" FROM "s" WHERE true ON CONFLICT ("k") DO UPDATE SET "v" = excluded."v"'),
    ("mysql", "overwrite", "INSERT INTO `t` (`k`, `v`) SELECT `k`, `v` FROM `s` ON DUPLICATE KEY UPDATE `v` = VALUES(`v`)"),
    ("mariadb", "skip", "INSERT IGNORE INTO `t` (`k`, `v`) SELECT `k`, `v` FROM `s`"),
    ("mssql", "overwrite", "MERGE INTO [t] AS a USING [s] AS b ON (a.[k] = b.[k]) WHEN MATCHED THEN UPDATE SET a.[v] = b.[v] WHEN NOT MATCHED THEN INSERT ([k], [v]) VALUES (b.[k], b.[v]);"),
    ("mssql", "skip", "MERGE INTO [t] AS a USING [s] AS b ON (a.[k] = b.[k]) WHEN NOT MATCHED THEN INSERT ([k], [v]) VALUES (b.[k], b.[v]);"),
    ("postgres", "error", 'INSERT INTO "t" ("k", "v") SELECT "k", "v" FROM "s"'),
]


@query("SELECT * FROM (VALUES " + ", ".join("('{}', '{}', '{}')".format(a, b, c.replace("'", "''")) for a, b, c in _STATEMENTS) + ") t(dialect, strategy, statement)")
def merge_statements(spark, d):
    return spark.createDataFrame([(a, b, writers.merge_statement("t", "s", ["k", "v"], ["k"], a, b)) for a, b, _ in _STATEMENTS], "dialect string, strategy string, statement string")


@query("SELECT count(*) AS n, CAST(sum(length(concat('{\"r_regionkey\":', r_regionkey, ',\"r_name\":\"', r_name, '\"}'))) AS BIGINT) AS bytes FROM region")
def dry_run(spark, d):
    return spark.createDataFrame([writers.dry_run(table(spark, d, "region").select("r_regionkey", "r_name"))], "n bigint, bytes bigint")


# --- verification --------------------------------------------------------------------------------------------------


def _lossy(spark, d):
    """A copy of customers that lost a column, gained one, and changed every tenth name."""
    source = table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")
    name = F.when(F.col("c_custkey") % 10 == 0, F.upper(F.concat("c_name", F.lit("x")))).otherwise(F.col("c_name"))
    return source, source.select("c_custkey", name.alias("c_name"), "c_acctbal", F.lit("v").alias("extra"))


@query("""SELECT c_custkey, 'c_mktsegment' AS field, c_mktsegment AS source_value, CAST(NULL AS VARCHAR) AS target_value FROM customer
UNION ALL SELECT c_custkey, 'extra', NULL, 'v' FROM customer
UNION ALL SELECT c_custkey, 'c_name', c_name, upper(concat(c_name, 'x')) FROM customer WHERE c_custkey % 10 = 0""")
def verify_dropped_column(spark, d):
    return verify.field_differences(*_lossy(spark, d), ["c_custkey"])


@query("SELECT c_custkey, 'value_diff' AS category FROM customer")
def verify_records_dropped_column(spark, d):
    return verify.compare_records(*_lossy(spark, d), ["c_custkey"])


@query("SELECT * FROM (VALUES ('customer', true), ('nation', true), ('orders', false)) t(tbl, ok)")
def verify_basic(spark, d):
    tables = {"customer": table(spark, d, "customer"), "nation": table(spark, d, "nation"), "orders": table(spark, d, "orders").where("o_orderkey < 0")}
    return verify.basic(tables).withColumnRenamed("table", "tbl")


@query("SELECT 'whole' AS tbl, true AS ok UNION ALL SELECT 'part', false")
def verify_basic_keys(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey")
    return verify.basic({"whole": orders, "part": orders.where("o_orderkey % 7 <> 0")}, orders, ["o_orderkey"]).withColumnRenamed("table", "tbl")


_COUNTED = "(SELECT 'customer' AS tbl, count(*) AS n FROM customer UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'supplier', count(*) FROM supplier)"


def _counted(spark, d):
    return verify.counts({t: table(spark, d, t) for t in ("customer", "orders", "supplier")})


def _total(spark, d, more=0):
    return _counted(spark, d).agg((F.sum("n") + more).alias("n")).select(F.lit("").alias("table"), "n")


@query(f"SELECT tbl, n AS source_n, n AS target_n, 'PASS' AS status FROM {_COUNTED}")
def verify_remap_dst(spark, d):
    """Tables to a store that counts all keys under one name: the total is taken apart."""
    return verify.compare_counts(*verify.remapped(_counted(spark, d), _total(spark, d), "postgres", "redis")).withColumnRenamed("table", "tbl")


@query(f"SELECT tbl, n AS source_n, CAST(0 AS BIGINT) AS target_n, 'FAIL' AS status FROM {_COUNTED} UNION ALL SELECT '', 0, CAST(sum(n) + 1 AS BIGINT), 'FAIL' FROM {_COUNTED}")
def verify_remap_unequal(spark, d):
    """A total that does not fit is left as it is."""
    return verify.compare_counts(*verify.remapped(_counted(spark, d), _total(spark, d, 1), "mysql", "redis")).withColumnRenamed("table", "tbl")


@query(f"SELECT tbl, n AS source_n, n AS target_n, 'PASS' AS status FROM {_COUNTED}")
def verify_remap_src(spark, d):
    return verify.compare_counts(*verify.remapped(_total(spark, d), _counted(spark, d), "redis", "mongodb")).withColumnRenamed("table", "tbl")


def _checked(spark, d):
    """orders whole but every row changed, customers equal, suppliers with rows missing."""
    source = {t: table(spark, d, t) for t in ("customer", "orders", "supplier")}
    target = source | {"orders": source["orders"].withColumn("o_totalprice", F.col("o_totalprice") + 1), "supplier": source["supplier"].where("s_suppkey % 2 = 0")}
    keys = {"customer": ["c_custkey"], "orders": ["o_orderkey"], "supplier": ["s_suppkey"]}
    return verify.verification(source, target, keys, verify.Options(sample_mode="count", sample_n=100), same_engine=False)


@query("""SELECT 'customer' AS tbl, (SELECT count(*) FROM customer) AS source_n, (SELECT count(*) FROM customer) AS target_n, least(100, (SELECT count(*) FROM customer)) AS sampled, CAST(0 AS BIGINT) AS mismatched, 'PASS' AS status
UNION ALL SELECT 'orders', (SELECT count(*) FROM orders), (SELECT count(*) FROM orders), least(100, (SELECT count(*) FROM orders)), least(100, (SELECT count(*) FROM orders)), 'WARN'
UNION ALL SELECT 'supplier', (SELECT count(*) FROM supplier), (SELECT count(*) FROM supplier WHERE s_suppkey % 2 = 0), 0, 0, 'FAIL'""")
def verify_sample(spark, d):
    return _checked(spark, d)[0].withColumnRenamed("table", "tbl")


@query("SELECT * FROM (VALUES ('WARN', 'value_diff', 100), ('FAIL', 'count_mismatch', 1)) t(status, category, n)")
def verify_report(spark, d):
    by_table, mismatches = _checked(spark, d)
    counted = mismatches.groupBy("table", "category").agg(F.count(F.lit(1)).cast("int").alias("n"))
    return counted.join(by_table, "table").select("status", "category", "n")


@query("SELECT CAST(least(50, count(*)) AS BIGINT) AS n, CAST(0 AS BIGINT) AS differing FROM orders")
def verify_sample_repeats(spark, d):
    """The same seed draws the same records."""
    a, b = (verify.sampled(table(spark, d, "orders").select("o_orderkey"), ["o_orderkey"], 50, 7) for _ in range(2))
    return a.agg(F.count(F.lit(1)).alias("n")).join(verify.absent(a, b, ["o_orderkey"]).agg(F.count(F.lit(1)).alias("differing")), F.lit(True))  # one row each


# --- plans ---------------------------------------------------------------------------------------------------------

_CATALOG = """(VALUES ('users', 'id', 'BIGINT'), ('users', 'name', 'VARCHAR(40)'), ('users', 'tag', 'GEOMETRY'), ('users', 'seen', 'TIMESTAMP'), ('orders', 'id', 'INT'), ('orders', 'total', 'DECIMAL(10,2)'), ('orders', 'doc', 'JSON'))"""
_CATALOG_ROWS = [("users", "id", "BIGINT"), ("users", "name", "VARCHAR(40)"), ("users", "tag", "GEOMETRY"), ("users", "seen", "TIMESTAMP"), ("orders", "id", "INT"), ("orders", "total", "DECIMAL(10,2)"), ("orders", "doc", "JSON")]
_RULES = {"users": [FieldRule("name", "label"), FieldRule("tag", action="drop"), FieldRule("seen", kind="string", action="convert")], "*": [FieldRule("doc", action="drop")]}


def _catalog(spark):
    return spark.createDataFrame(_CATALOG_ROWS, "table string, column string, kind string")


@query("""SELECT * FROM (VALUES ('users', 'id', 'BIGINT', 'BIGINT', false, false), ('users', 'name', 'VARCHAR(40)', 'VARCHAR', true, false), ('users', 'tag', 'GEOMETRY', NULL, NULL, false), ('users', 'seen', 'TIMESTAMP', 'TIMESTAMP', false, false),
('orders', 'id', 'INT', 'INTEGER', true, false), ('orders', 'total', 'DECIMAL(10,2)', 'NUMERIC', true, false), ('orders', 'doc', 'JSON', 'JSONB', true, false)) t(tbl, col, source_type, target_type, converted, lossy)""")
def plan_type_mappings(spark, d):
    return planning.type_report(_catalog(spark), "mysql", "postgres").withColumnsRenamed({"table": "tbl", "column": "col"})


@query("SELECT * FROM (VALUES ('users', 'tag', 'no type mapping for GEOMETRY'), ('users', 'tag', 'dropped by a field rule'), ('*', 'doc', 'dropped by a field rule')) t(tbl, field, reason)")
def plan_unsupported(spark, d):
    return planning.unsupported(planning.type_report(_catalog(spark), "mysql", "postgres"), _RULES).withColumnRenamed("table", "tbl")


@query("SELECT * FROM (VALUES ('*', 1, 'drop'), ('users', 3, 'rename,drop,convert')) t(tbl, rules, actions)")
def plan_field_mappings(spark, d):
    return planning.field_report(spark, _RULES).select(F.col("table").alias("tbl"), "rules", F.array_join("actions", ",").alias("actions"))


@query("""SELECT * FROM (VALUES ('postgres', 'mysql', ''), ('postgres', 'sqlite', 'target cannot defer constraints'), ('redis', 'mongodb', 'source has no schema'), ('sqlite', 'redis', 'target has no schema; target cannot defer constraints'), ('mysql', 'oracle', 'no transformer from mysql to oracle; target has no schema; target cannot defer constraints'), ('mssql', 'postgres', 'source has no tables')) t(source, target, blockers)""")
def plan_blockers(spark, d):
    pairs = [("postgres", "mysql", 3), ("postgres", "sqlite", 3), ("redis", "mongodb", None), ("sqlite", "redis", 3), ("mysql", "oracle", 1), ("mssql", "postgres", 0)]
    return spark.createDataFrame([(a, b, "; ".join(planning.blockers(a, b, n))) for a, b, n in pairs], "source string, target string, blockers string")


@query("""SELECT * FROM (VALUES ('redis', 'mysql', 'the source cannot list tables, so rows are not estimated'), ('mysql', 'sqlite', 'sqlite has no transactions, so constraints cannot be deferred'), ('mysql', 'postgres', '')) t(source, target, warnings)""")
def plan_warnings(spark, d):
    return spark.createDataFrame([(a, b, "; ".join(planning.warnings(a, b, n, n))) for a, b, n in (("redis", "mysql", 0), ("mysql", "sqlite", 2), ("mysql", "postgres", 2))], "source string, target string, warnings string")


@query("""SELECT count(*) AS tables, CAST(sum(n) AS BIGINT) AS total, CAST(sum(ceil(n / 1000.0)) AS BIGINT) AS batches FROM (SELECT count(*) AS n FROM customer UNION ALL SELECT count(*) FROM orders UNION ALL SELECT count(*) FROM supplier)""")
def plan_summary(spark, d):
    return planning.estimates(_counted(spark, d)).agg(F.count(F.lit(1)).alias("tables"), F.sum("n").alias("total"), F.sum("batches").alias("batches"))


@query("SELECT * FROM (VALUES ('postgresql://h/d', 'postgres'), ('crdb://h', 'cockroachdb'), ('mongodb+srv://h', 'mongodb'), ('sqlserver://h', 'mssql'), ('rediss://h', 'redis'), ('ftp://h', ''), ('plain', '')) t(url, provider)")
def url_scheme(spark, d):
    return spark.createDataFrame([(u, planning.provider_of(u)) for u in ("postgresql://h/d", "crdb://h", "mongodb+srv://h", "sqlserver://h", "rediss://h", "ftp://h", "plain")], "url string, provider string")


_PAIR_SQL = """WITH p AS (SELECT * FROM (VALUES ('postgres'), ('mysql'), ('mariadb'), ('cockroachdb'), ('mssql'), ('sqlite'), ('mongodb'), ('redis')) t(n)) SELECT a.n AS source, b.n AS target FROM p a JOIN p b ON a.n <> b.n"""


@query(_PAIR_SQL)
def transformer_pairs(spark, d):
    return spark.createDataFrame(transformers.pairs(), "source string, target string")


# --- transformers --------------------------------------------------------------------------------------------------

_TO_ROWS = "SELECT n_nationkey, n_name AS label, strftime(TIMESTAMP '2024-03-01 10:00:00' + INTERVAL 1 DAY * n_nationkey, '{form}') AS seen{schema} FROM nation"


def _transformed(name: str, source: str, target: str, sql: str) -> None:
    """Nations with a text column of timestamps and a renamed one, from one provider's tables to another's."""

    def run(spark, d):
        day = F.expr("timestamp'2024-03-01 10:00:00' + make_dt_interval(n_nationkey)")
        seen = F.date_format(day, "yyyy-MM-dd HH:mm:ss" if source in ("mysql", "mariadb") else "yyyy-MM-dd'T'HH:mm:ss'Z'")
        rows = table(spark, d, "nation").select("n_nationkey", "n_name", seen.alias("seen"))
        return transformers.transform(rows, source, target, Context("nation", ["n_nationkey"], rules={"*": [FieldRule("n_name", "label")]}, stamps=["seen"]))

    QUERIES[name], SQL[name] = run, sql


_RFC, _SQLSTYLE = "%Y-%m-%dT%H:%M:%SZ", "%Y-%m-%d %H:%M:%S"
for _a in transformers.SQL:
    for _b in transformers.SQL:
        if _a != _b:
            _own = _SQLSTYLE if _a in ("mysql", "mariadb") else _RFC
            _kept = {_a, _b} & {"sqlite", "mssql"}
            _form = _own if _kept else _SQLSTYLE if _b in ("mysql", "mariadb") else _RFC
            _schema = ", 'public' AS schema" if _b in ("postgres", "cockroachdb") and _a != "mssql" else ""
            _transformed(f"transform_{_a}_to_{_b}", _a, _b, _TO_ROWS.format(form=_form, schema=_schema))


def _to_hash(source: str) -> None:
    def run(spark, d):
        rows = table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey")
        out = transformers.transform(rows, source, "redis", Context("nation", ["n_nationkey"], rules={"nation": [FieldRule("n_name", "label")]}))
        return out.select("key", "type", F.to_json("value").alias("value"), "ttl_seconds")

    QUERIES[f"transform_{source}_to_redis"] = run
    SQL[f"transform_{source}_to_redis"] = """SELECT concat('nation:', n_nationkey) AS key, 'hash' AS type, concat('{"n_nationkey":"', n_nationkey, '","label":"', n_name, '","n_regionkey":"', n_regionkey, '"}') AS value, CAST(0 AS BIGINT) AS ttl_seconds FROM nation"""


def _to_document(source: str) -> None:
    referring = source in ("postgres", "mysql")

    def run(spark, d):
        rows = table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey")
        out = transformers.transform(rows, source, "mongodb", Context("nation", ["n_nationkey"], [("n_regionkey", "region", "r_regionkey"), ("gone", "x", "y")]))
        return out.withColumn("lookups", F.to_json("lookups")) if referring else out

    lookups = """, '[{"from":"region","local":"n_regionkey","foreign":"r_regionkey","as":"region_r_regionkey"}]' AS lookups""" if referring else ""
    QUERIES[f"transform_{source}_to_mongodb"] = run
    SQL[f"transform_{source}_to_mongodb"] = f"""SELECT 'nation' AS collection, concat('nation:', n_nationkey) AS _id, CAST(n_nationkey AS VARCHAR) AS document_id, concat('{{"n_nationkey":', n_nationkey, ',"n_name":"', n_name, '","n_regionkey":', n_regionkey, '}}') AS document{lookups} FROM nation"""


def _from_hash(target: str) -> None:
    schema = ", 'public' AS schema" if target == "never" else ""

    def run(spark, d):
        hashes = models.rows_to_hashes(table(spark, d, "nation").select("n_nationkey", "n_name"), "nation", ["n_nationkey"])
        return transformers.transform(hashes, "redis", target, Context("nation", columns=["n_name", "n_nationkey"], rules={"nation": [FieldRule("n_name", "label")]}))

    QUERIES[f"transform_redis_to_{target}"] = run
    SQL[f"transform_redis_to_{target}"] = f"SELECT concat('nation:', n_nationkey) AS _key, n_name AS label, CAST(n_nationkey AS VARCHAR) AS n_nationkey{schema} FROM nation"


def _from_document(target: str) -> None:
    schema = ", 'public' AS schema" if target in ("postgres", "cockroachdb") else ""

    def run(spark, d):
        documents = models.rows_to_documents(table(spark, d, "nation").select("n_nationkey", "n_name"), "nation", ["n_nationkey"])
        return transformers.transform(documents, "mongodb", target, Context("nation", columns=["n_name", "n_nationkey"]))

    QUERIES[f"transform_mongodb_to_{target}"] = run
    SQL[f"transform_mongodb_to_{target}"] = f"SELECT concat('nation:', n_nationkey) AS _id, n_name, CAST(n_nationkey AS VARCHAR) AS n_nationkey{schema} FROM nation"


for _p in transformers.SQL:
    _to_hash(_p)
    _to_document(_p)
    _from_hash(_p)
    _from_document(_p)


@query("""SELECT concat('nation:', n_nationkey) AS key, 'hash' AS type, concat('{"n_name":"', n_name, '","n_regionkey":"', n_regionkey, '"}') AS value, CAST(0 AS BIGINT) AS ttl_seconds FROM nation""")
def mongo_to_redis(spark, d):
    documents = models.rows_to_documents(table(spark, d, "nation").select("n_name", "n_regionkey", "n_nationkey"), "nation", ["n_nationkey"])
    out = transformers.transform(documents, "mongodb", "redis", Context("nation", columns=["_id", "n_name", "n_regionkey"]))
    return out.select("key", "type", F.to_json("value").alias("value"), "ttl_seconds")


@query("""SELECT concat('nation:', n_nationkey) AS _id, 'nation' AS collection, CASE n_nationkey % 6 WHEN 0 THEN concat('{"a":"', n_name, '"}') WHEN 1 THEN concat('{"value":"', n_name, '"}') WHEN 2 THEN concat('{"o":', n_nationkey, '}') WHEN 3 THEN concat('{"items":["', n_name, '"]}') ELSE concat('{"members":["', n_name, '"]}') END AS document,
CASE WHEN n_nationkey % 2 = 0 THEN CAST(60 AS BIGINT) END AS _ttl FROM nation WHERE n_nationkey % 6 < 5
UNION ALL SELECT concat('nation:', n_nationkey, ':', i, '-0'), 'nation', concat('{"f":"', n_name, '","_stream":"nation:', n_nationkey, '"}'), NULL FROM nation, (VALUES (1), (2)) t(i) WHERE n_nationkey % 6 = 5""")
def redis_to_mongo(spark, d):
    """A record of each type; streams hold an entry twice, as pages overlap."""
    name, key = F.to_json(F.array("n_name")), F.concat(F.lit("nation:"), "n_nationkey")
    one = F.regexp_replace(name, r"^\[|\]$", "")
    entry = lambda i: F.concat(F.lit(f'{{"id":"{i}-0","fields":{{"f":'), one, F.lit("}}"))
    k = F.col("n_nationkey") % 6
    value = F.when(k == 0, F.concat(F.lit('{"a":'), one, F.lit("}"))).when(k == 1, one).when(k == 2, F.concat(F.lit('"{\\"o\\":'), "n_nationkey", F.lit('}"'))).when(k.isin(3, 4), name)
    value = value.otherwise(F.concat(F.lit("["), F.concat_ws(",", entry(1), entry(2), entry(2)), F.lit("]")))
    kind = F.when(k == 0, "hash").when(k.isin(1, 2), "string").when(k == 3, "list").when(k == 4, "set").otherwise("stream")
    ttl = F.when((F.col("n_nationkey") % 2 == 0) & (k != 5), 60).otherwise(0).cast("bigint")
    records = table(spark, d, "nation").select(key.alias("key"), kind.alias("type"), value.alias("value"), ttl.alias("ttl_seconds"))
    return transformers.transform(records, "redis", "mongodb", Context())


@query("SELECT concat('nation:', n_nationkey) AS key, n_name, CAST(NULL AS VARCHAR) AS other FROM nation")
def flatten_hash(spark, d):
    return models.flattened(models.rows_to_hashes(table(spark, d, "nation").select("n_nationkey", "n_name"), "nation", ["n_nationkey"]), ["n_name", "other"])


@query("SELECT n_nationkey, n_name FROM nation")
def envelope_round_trip(spark, d):
    rows = table(spark, d, "nation").select("n_nationkey", "n_name")
    records = models.envelopes_of(rows, "nation", ["n_nationkey"], "public").unionByName(models.envelopes_of(table(spark, d, "region").select("r_regionkey"), "region", ["r_regionkey"]))
    return models.rows_of(records, "nation", "n_nationkey int, n_name string")


@query("""SELECT concat('nation:', n_nationkey) AS key, 'nation' AS tbl, 'row' AS data_type, 'public' AS schema, concat('{"n_nationkey":"', n_nationkey, '"}') AS pk, '{"n_nationkey":"int","n_name":"string"}' AS kinds,
CAST(length(concat('{"n_nationkey":', n_nationkey, ',"n_name":"', n_name, '"}')) AS BIGINT) AS size FROM nation""")
def envelope_fields(spark, d):
    records = models.envelopes_of(table(spark, d, "nation").select("n_nationkey", "n_name"), "nation", ["n_nationkey"], "public")
    return records.select("key", F.col("table").alias("tbl"), "data_type", "schema", F.to_json("primary_key").alias("pk"), F.to_json("column_types").alias("kinds"), "size")


# --- scalars -------------------------------------------------------------------------------------------------------


@query("""SELECT n_nationkey, md5(concat('{"n_nationkey":', n_nationkey, ',"n_name":', CASE WHEN n_nationkey % 5 = 0 THEN 'null' ELSE concat('"', n_name, '"') END, '}')) AS checksum FROM nation""")
def md5_row(spark, d):
    rows = table(spark, d, "nation").select("n_nationkey", F.expr("if(n_nationkey % 5 = 0, null, n_name)").alias("n_name"))
    return rows.select("n_nationkey", values.row_checksum_of("postgres", ["n_nationkey", "n_name"]).alias("checksum"))


@query("SELECT n_nationkey, sha256(concat(n_name, n_nationkey)) AS checksum FROM nation")
def sqlite_row_checksum(spark, d):
    return table(spark, d, "nation").select("n_nationkey", values.row_checksum_of("sqlite", ["n_nationkey", "n_name"]).alias("checksum"))


@query("""SELECT n_nationkey, concat('{"a":[{"x":1,"y":', n_nationkey, '}],"b":{"c":"', n_name, '","d":null}}') AS doc FROM nation""")
def canonical_json(spark, d):
    nested = F.concat(F.lit('{ "b": {"d": null, "c": "'), "n_name", F.lit('"}, "a": [{"y": '), F.col("n_nationkey").cast("string"), F.lit(', "x": 1}]}'))
    return table(spark, d, "nation").select("n_nationkey", values.canonical_json(nested).alias("doc"))


@query("SELECT * FROM (VALUES (CAST(512 AS BIGINT), '512 B', '8m32s'), (2048, '2.0 KB', '34m8s'), (5000000, '4.8 MB', '1388h53m20s'), (45, '45 B', '45s')) t(n, bytes, spent)")
def human_figures(spark, d):
    return values_table(spark, "n", "(512L), (2048L), (5000000L), (45L)").select("n", values.human_bytes(F.col("n")).alias("bytes"), values.human_seconds(F.col("n")).alias("spent"))


@query("SELECT * FROM (VALUES ('postgres', '\"a\"\"b\"'), ('mysql', '`a\"b`'), ('mssql', '[a\"b]'), ('sqlite', '\"a\"\"b\"')) t(dialect, name)")
def quoted_names(spark, d):
    return spark.createDataFrame([(k, values.quoted('a"b', k)) for k in ("postgres", "mysql", "mssql", "sqlite")], "dialect string, name string")


@query("SELECT * FROM (VALUES ('DATETIME', true), ('timestamp(6)', true), ('TIMESTAMPTZ', true), ('SMALLDATETIME', true), ('DATE', false), ('TIME', false), ('TEXT', false)) t(kind, stamp)")
def timestamp_columns(spark, d):
    return values_table(spark, "kind", "('DATETIME'), ('timestamp(6)'), ('TIMESTAMPTZ'), ('SMALLDATETIME'), ('DATE'), ('TIME'), ('TEXT')").select("kind", values.is_timestamp_type(F.col("kind")).alias("stamp"))


@query("SELECT * FROM (VALUES ('mysql', 'mariadb', false), ('postgres', 'cockroachdb', false), ('mysql', 'postgres', true), ('sqlite', 'mssql', true)) t(a, b, needed)")
def conversion_needed(spark, d):
    return spark.createDataFrame([(a, b, not values.same_family(a, b)) for a, b in (("mysql", "mariadb"), ("postgres", "cockroachdb"), ("mysql", "postgres"), ("sqlite", "mssql"))], "a string, b string, needed boolean")


# --- sources -------------------------------------------------------------------------------------------------------


@query("SELECT * FROM (VALUES ('benchmark'), ('conversations'), ('customer'), ('documents'), ('embeddings'), ('events'), ('labels'), ('lineitem'), ('nation'), ('orders'), ('pages'), ('part'), ('region'), ('supplier')) t(tbl)")
def list_tables(spark, d):
    return spark.createDataFrame([(n,) for n in registry.tables(spark, d)], "tbl string")


@query("SELECT * FROM (VALUES ('users', NULL, true), ('sqlite_master', NULL, false), ('system.views', NULL, false), ('pg_class', 'pg_catalog', false), ('t', 'information_schema', false), ('.hidden', NULL, false), ('t', 'public', true)) t(name, schema, own)")
def system_objects(spark, d):
    rows = values_table(spark, "name, schema", "('users', NULL), ('sqlite_master', NULL), ('system.views', NULL), ('pg_class', 'pg_catalog'), ('t', 'information_schema'), ('.hidden', NULL), ('t', 'public')")
    return rows.select("name", F.col("schema").cast("string").alias("schema"), ddl.user_table(F.col("name"), F.col("schema")).alias("own"))


@query("SELECT CAST((SELECT count(*) FROM region) + (SELECT count(*) FROM nation) AS BIGINT) AS total, CAST(2 AS BIGINT) AS tables, CAST(1 AS BIGINT) AS done, concat('{\"tables_completed\":[\"region\"],\"rows\":', (SELECT count(*) FROM region) + (SELECT count(*) FROM nation), '}') AS token")
def scan_stats(spark, d):
    return registry.scan_stats({t: table(spark, d, t) for t in ("region", "nation")}, ["region"]).withColumnRenamed("rows", "total")


@query("SELECT event_id % 40 AS k, count(*) AS n FROM events GROUP BY 1")
def paged_entries(spark, d):
    """Entries of streams come in pages that overlap by one; each is counted once."""
    pages = F.expr("flatten(transform(sequence(0, greatest(0, size(ids) - 2) div 99), p -> slice(ids, p * 99 + 1, 100)))")
    streams = table(spark, d, "events").groupBy((F.col("event_id") % 40).alias("k")).agg(F.collect_list("event_id").alias("ids"))
    return streams.select("k", F.explode(pages).alias("id")).dropDuplicates(["k", "id"]).groupBy("k").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT * FROM (VALUES ('users', CAST(2000 AS BIGINT)), ('orders', 2000), ('products', 200)) t(tbl, n)")
def generated_tables(spark, d):
    made = registry.generated(spark, 2000)
    return verify.counts(made).withColumnRenamed("table", "tbl")


# --- accounting ----------------------------------------------------------------------------------------------------


@query("SELECT event_type AS tbl, min(event_id) AS position FROM events GROUP BY 1")
def scanned_tables(spark, d):
    units = table(spark, d, "events").select(F.col("event_type").alias("table"), F.col("event_id").alias("position"))
    return accounting.scanned_tables(units).withColumnRenamed("table", "tbl")


@query("SELECT event_type AS category, event_id, n FROM (SELECT event_type, event_id, count(*) OVER (PARTITION BY event_type) AS n, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS i FROM events) WHERE i <= 20")
def capped_errors(spark, d):
    rows = table(spark, d, "events").select(F.col("event_type").alias("category"), "event_id")
    return accounting.capped(rows, "category", ["event_id"], 20)


@query("SELECT o_orderkey AS id, o_orderdate AS started FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 20")
def newest_runs(spark, d):
    return accounting.newest_first(table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("started")), 20)


@query("SELECT * FROM (VALUES ('t', 'by_ab', 'a,b'), ('t', 'by_c', 'c'), ('u', 'by_ab', 'b')) t(tbl, idx, columns)")
def index_columns(spark, d):
    rows = spark.createDataFrame([("t", "by_ab", 2, "b"), ("t", "by_ab", 1, "a"), ("t", "by_c", 1, "c"), ("u", "by_ab", 1, "b")], "table string, index string, position int, column string")
    return accounting.index_columns(rows).select(F.col("table").alias("tbl"), F.col("index").alias("idx"), F.array_join("columns", ",").alias("columns"))


@query("""WITH b AS (SELECT event_id // 100 AS position, count(*) AS scanned, count(*) FILTER (value >= 5) AS written FROM events GROUP BY 1),
r AS (SELECT sum(written) OVER (ORDER BY position) AS w, sum(0.5) OVER (ORDER BY position) AS s, * FROM b)
SELECT sum(written) / (count(*) * 0.5) AS average, max(CAST(w AS DOUBLE) / s) AS peak, CAST(floor((sum(scanned) - sum(written)) / (sum(written) / (count(*) * 0.5))) AS BIGINT) AS remaining FROM r""")
def throughput(spark, d):
    batches = table(spark, d, "events").groupBy(F.floor(F.col("event_id") / 100).alias("position")).agg(F.count(F.lit(1)).alias("scanned"), F.count_if(F.col("value") >= 5).alias("written")).withColumn("seconds", F.lit(0.5).cast("double"))
    return accounting.throughput(batches)


# --- schemas -------------------------------------------------------------------------------------------------------

_TABLE = ddl.TableOf("users", [ddl.ColumnOf("id", "BIGINT", False, auto=True), ddl.ColumnOf("name", "VARCHAR(40)", False, "'x'"), ddl.ColumnOf("seen", "TIMESTAMP", True, "now()")], ["id"], [("by_name", ("name",), True)])
# The statements of a table, by dialect.
_CREATED = {
    "postgres": 'CREATE TABLE IF NOT EXISTS "users" ( "id" BIGSERIAL NOT NULL, "name" VARCHAR(40) NOT NULL DEFAULT \'x\', "seen" TIMESTAMP DEFAULT now(), PRIMARY KEY ("id") )',
    "mysql": "CREATE TABLE IF NOT EXISTS `users` ( `id` BIGINT AUTO_INCREMENT NOT NULL, `name` VARCHAR(40) NOT NULL DEFAULT 'x', `seen` TIMESTAMP DEFAULT now(), PRIMARY KEY (`id`) )",
    "mssql": "IF OBJECT_ID(N'users', N'U') IS NULL CREATE TABLE [users] ( [id] BIGINT IDENTITY(1,1) NOT NULL, [name] VARCHAR(40) NOT NULL DEFAULT 'x', [seen] TIMESTAMP DEFAULT now(), PRIMARY KEY ([id]) )",
    "sqlite": 'CREATE TABLE IF NOT EXISTS "users" ( "id" BIGINT NOT NULL, "name" VARCHAR(40) NOT NULL DEFAULT \'x\', "seen" TIMESTAMP DEFAULT now(), PRIMARY KEY ("id") )',
}
_INDEXED = {
    "postgres": 'CREATE UNIQUE INDEX IF NOT EXISTS "by_name" ON "users" ("name")', "mysql": "CREATE UNIQUE INDEX `by_name` ON `users` (`name`)",
    "mssql": "CREATE UNIQUE INDEX [by_name] ON [users] ([name])", "sqlite": 'CREATE UNIQUE INDEX IF NOT EXISTS "by_name" ON "users" ("name")',
}
_literal = lambda text: "'" + text.replace("'", "''") + "'"


@query("SELECT * FROM (VALUES " + ", ".join(f"('{k}', {_literal(_CREATED[k])}, {_literal(_INDEXED[k])}, {_literal('DROP TABLE IF EXISTS ' + values.quoted('users', k))})" for k in _CREATED) + ") t(dialect, created, indexed, dropped)")
def ddl_statements(spark, d):
    rows = [(k, " ".join(ddl.create_table(_TABLE, k).split()), ddl.create_indexes(_TABLE, k)[0], ddl.drop_table("users", k)) for k in _CREATED]
    return spark.createDataFrame(rows, "dialect string, created string, indexed string, dropped string")


@query("SELECT * FROM (VALUES ('id', 'BIGINT', ''), ('name', 'VARCHAR', '''x'''), ('seen', 'TIMESTAMP', 'now()')) t(col, kind, dflt)")
def ddl_converted(spark, d):
    """A MySQL table's columns for PostgreSQL."""
    (made,) = ddl.converted(spark, [_TABLE], "mysql", "postgres")
    return spark.createDataFrame([(c.name, c.kind, c.default) for c in made.columns], "col string, kind string, dflt string")


@query("SELECT 'customer' AS tbl, * FROM (VALUES (0, 'c_custkey', 'bigint', true), (1, 'c_name', 'string', false), (2, 'c_nationkey', 'int', false), (3, 'c_acctbal', 'double', false), (4, 'c_mktsegment', 'string', false)) t(position, col, kind, in_key)")
def inspect_catalog(spark, d):
    found = ddl.catalog(spark, ddl.inspect_frames({"customer": table(spark, d, "customer")}, {"customer": ["c_custkey"]}))[0]
    return found.select(F.col("table").alias("tbl"), "position", F.col("column").alias("col"), "kind", "in_key")


@query("SELECT * FROM (VALUES ('config', 0, CAST(0.0 AS DOUBLE)), ('connection', 0, 1.0), ('connection', 5, 10.0), ('write', 0, 0.5), ('write', 3, 4.0), ('write', 9, 30.0), ('schema', 4, 5.0)) t(kind, attempt, seconds)")
def retry_pauses(spark, d):
    from ferrywork.plans.migration import pause

    rows = [(k, n, float(pause(k, n))) for k, n in (("config", 0), ("connection", 0), ("connection", 5), ("write", 0), ("write", 3), ("write", 9), ("schema", 4))]
    return spark.createDataFrame(rows, "kind string, attempt int, seconds double")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey % 4 <> 0")
def null_error_rest(spark, d):
    rows = table(spark, d, "customer").select("c_custkey", F.expr("if(c_custkey % 4 = 0, null, c_name)").alias("c_name"))
    return mapping.null_policy(rows, "error")[0]
