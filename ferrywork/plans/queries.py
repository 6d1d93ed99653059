"""Queries over the driver's tables, one for each operator, with the same rows as SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrywork.functions import values
from ferrywork.operators import accounting, mapping, models, verify, writing
from ferrywork.operators.mapping import FieldRule
from ferrywork.plans import ddl, planning
from ferrywork.plans.registry import QUERIES, SQL, Query, query, table, values_table
from ferrywork.sources import registry


# --- scans ---------------------------------------------------------------------------------------------------------


@query("SELECT concat('region:', r_regionkey) AS k, r_name FROM region")
def row_key_single(spark, d):
    return table(spark, d, "region").select(values.row_key("region", ["r_regionkey"]).alias("k"), "r_name")


@query("""SELECT concat('lineitem:{"l_linenumber":', l_linenumber, ',"l_orderkey":', l_orderkey, '}') AS k, count(*) AS n FROM lineitem GROUP BY 1""")
def row_key_composite(spark, d):
    return table(spark, d, "lineitem").groupBy(values.row_key("lineitem", ["l_orderkey", "l_linenumber"]).alias("k")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT concat('nation:', n_nationkey) AS k, 'nation' AS tbl, 'row' AS data_type, concat('{"n_nationkey":', n_nationkey, ',"n_name":"', n_name, '","n_regionkey":', n_regionkey, '}') AS data FROM nation""")
def sql_to_envelope(spark, d):
    df = table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey")
    return df.select(values.row_key("nation", ["n_nationkey"]).alias("k"), F.lit("nation").alias("tbl"), F.lit("row").alias("data_type"), F.to_json(F.struct(*df.columns)).alias("data"))


@query("SELECT 'customer' AS tbl, count(*) AS n FROM customer UNION ALL SELECT 'part', count(*) FROM part")
def scan_skip_completed(spark, d):
    left = planning.Manifest({}, completed=["orders", "supplier"]).remaining(["orders", "customer", "part", "supplier"])
    return verify.counts({t: table(spark, d, t) for t in left}).select(F.col("table").alias("tbl"), "n")


@query("SELECT c_custkey, c_name FROM customer WHERE c_name SIMILAR TO '.*#0000.*[13579]'")
def scan_key_pattern(spark, d):
    return registry.matching(table(spark, d, "customer").select("c_custkey", "c_name"), "c_name", "*#0000*[13579]")


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def read_records_by_key(spark, d):
    keys = table(spark, d, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return registry.by_keys(table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), keys, ["o_custkey"]).select("o_orderkey", "o_custkey", "o_totalprice")


TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


@query(" UNION ALL ".join(f"SELECT '{t}' AS tbl, count(*) AS n FROM {t}" for t in TABLES))
def enumerate_tables(spark, d):
    return verify.counts({t: table(spark, d, t) for t in TABLES}).select(F.col("table").alias("tbl"), "n")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 100 OFFSET 200")
def page_scan(spark, d):
    return registry.page(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), ["o_orderkey"], 100, 2)


# --- conflict strategies -------------------------------------------------------------------------------------------


def _incoming(spark, d):
    """Changed rows for every third part, and new ones."""
    part = table(spark, d, "part").select("p_partkey", "p_name", "p_size")
    changed = part.where("p_partkey % 3 = 0").withColumn("p_size", F.col("p_size") + 100)
    new = part.where("p_partkey % 7 = 0").withColumn("p_partkey", F.col("p_partkey") + 10_000_000)
    return part, changed.unionByName(new)


_INCOMING = """WITH inc AS (SELECT p_partkey, p_name, p_size + 100 AS p_size FROM part WHERE p_partkey % 3 = 0
UNION ALL SELECT p_partkey + 10000000, p_name, p_size FROM part WHERE p_partkey % 7 = 0) """


@query(_INCOMING + "SELECT * FROM inc UNION ALL SELECT p_partkey, p_name, p_size FROM part WHERE p_partkey NOT IN (SELECT p_partkey FROM inc)")
def write_overwrite(spark, d):
    part, incoming = _incoming(spark, d)
    return writing.merge(part, incoming, ["p_partkey"], "overwrite")


@query(_INCOMING + "SELECT p_partkey, p_name, p_size FROM part UNION ALL SELECT * FROM inc WHERE p_partkey NOT IN (SELECT p_partkey FROM part)")
def write_skip(spark, d):
    part, incoming = _incoming(spark, d)
    return writing.merge(part, incoming, ["p_partkey"], "skip")


@query(_INCOMING + "SELECT * FROM inc WHERE p_partkey IN (SELECT p_partkey FROM part)")
def write_error(spark, d):
    part, incoming = _incoming(spark, d)
    return writing.conflicts(part, incoming, ["p_partkey"])


@query("""SELECT c_custkey AS id, c_name AS name, c_acctbal AS balance, c_mktsegment AS segment, CAST(NULL AS INTEGER) AS nation FROM customer
UNION ALL SELECT s_suppkey + 1000000000, s_name, s_acctbal, NULL, s_nationkey FROM supplier""")
def schema_widen(spark, d):
    a = table(spark, d, "customer").selectExpr("c_custkey AS id", "c_name AS name", "c_acctbal AS balance", "c_mktsegment AS segment")
    b = table(spark, d, "supplier").selectExpr("s_suppkey + 1000000000 AS id", "s_name AS name", "s_acctbal AS balance", "s_nationkey AS nation")
    return writing.merge(a, b, ["id"], "skip")


@query("""SELECT c_nationkey AS nation, c_name AS name FROM customer UNION ALL SELECT s_nationkey, s_name FROM supplier""")
def multi_source(spark, d):
    a = table(spark, d, "customer").selectExpr("c_nationkey AS nation", "c_name AS name")
    return a.unionByName(table(spark, d, "supplier").selectExpr("s_nationkey AS nation", "s_name AS name"))


@query("SELECT p_partkey AS id, p_name AS name, CAST(NULL AS DOUBLE) AS price FROM part UNION ALL SELECT l_partkey, NULL, l_extendedprice FROM lineitem")
def union_by_name(spark, d):
    return table(spark, d, "part").selectExpr("p_partkey AS id", "p_name AS name").unionByName(table(spark, d, "lineitem").selectExpr("l_partkey AS id", "l_extendedprice AS price"), allowMissingColumns=True)


@query("""SELECT l_orderkey, l_linenumber, max(l_extendedprice) AS price FROM (SELECT *, rank() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC) AS r FROM lineitem) WHERE r = 1 GROUP BY 1, 2""")
def dedup_keep_last(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate", "l_extendedprice")
    return writing.keep_last(rows, ["l_orderkey", "l_linenumber"], [F.col("l_shipdate"), F.col("l_extendedprice")]).select("l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("price"))


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def dedup_written(spark, d):
    written = table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return writing.unwritten(table(spark, d, "orders").select("o_orderkey"), written, "o_orderkey")


@query("SELECT event_id, user_id FROM events WHERE user_id IN (SELECT user_id FROM events GROUP BY user_id HAVING count(*) % 3 = 0)")
def failed_subset(spark, d):
    events = table(spark, d, "events").select("event_id", "user_id")
    failed = events.groupBy("user_id").agg(F.count(F.lit(1)).alias("n")).where("n % 3 = 0").select("user_id")
    return accounting.units_by_keys(events, failed, "user_id").select("event_id", "user_id")


@query("SELECT o_orderkey, CAST((row_number() OVER (ORDER BY o_orderkey) - 1) // 1000 AS BIGINT) AS batch FROM orders")
def assign_batches(spark, d):
    return writing.numbered_batches(table(spark, d, "orders").select("o_orderkey"), ["o_orderkey"], 1000)


@query("""WITH RECURSIVE u AS (SELECT o_orderkey, CAST(o_orderkey // 1000 AS BIGINT) AS scan, 10 + o_orderkey % 97 AS size, row_number() OVER (PARTITION BY o_orderkey // 1000 ORDER BY o_orderkey) AS i FROM orders),
r AS (SELECT o_orderkey, scan, i, size AS held, 0 AS batch FROM u WHERE i = 1
UNION ALL SELECT u.o_orderkey, u.scan, u.i, CASE WHEN r.held > 0 AND r.held + u.size > 2000 THEN u.size ELSE r.held + u.size END, CASE WHEN r.held > 0 AND r.held + u.size > 2000 THEN r.batch + 1 ELSE r.batch END FROM r JOIN u ON u.scan = r.scan AND u.i = r.i + 1)
SELECT scan, o_orderkey, batch FROM r""")
def split_batches(spark, d):
    rows = table(spark, d, "orders").selectExpr("o_orderkey", "o_orderkey div 1000 AS scan", "10 + o_orderkey % 97 AS size")
    return writing.split_by_bytes(rows, "scan", "o_orderkey", "size", 2000)


@query("SELECT event_id, ts FROM events ORDER BY ts DESC, event_id DESC LIMIT 1000")
def recent_keys(spark, d):
    return table(spark, d, "events").orderBy(F.desc("ts"), F.desc("event_id")).limit(1000).select("event_id", "ts")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey % 4 <> 1")
def resume_remaining_rows(spark, d):
    """A run that broke off after a quarter of a table: the table is scanned again, written keys are left out."""
    orders = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    return writing.unwritten(orders, orders.where("o_orderkey % 4 = 1"), "o_orderkey")


@query("SELECT row_number() OVER (ORDER BY tbl) - 1 AS position, tbl FROM (VALUES ('customer'), ('events'), ('lineitem'), ('nation'), ('orders'), ('part'), ('supplier')) t(tbl)")
def resume_plan(spark, d):
    manifest = planning.Manifest({}, completed=["region"])
    return spark.createDataFrame([(k, t) for k, t in enumerate(manifest.remaining(list(TABLES)))], "position bigint, tbl string")


# --- mappings ------------------------------------------------------------------------------------------------------


@query("SELECT c_custkey AS id, c_name AS name, c_acctbal FROM customer")
def map_rename(spark, d):
    rules = {"customer": [FieldRule("c_custkey", "id"), FieldRule("c_name", "name"), FieldRule("absent", "x")]}
    return mapping.map_fields(table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal"), rules, "customer")


@query("SELECT c_custkey, c_mktsegment FROM customer")
def map_drop(spark, d):
    return mapping.map_fields(table(spark, d, "customer").select("c_custkey", "c_acctbal", "c_mktsegment"), {"*": [FieldRule("c_acctbal", action="drop")]}, "customer")


@query("SELECT c_custkey, c_acctbal, CAST(trunc(c_acctbal) AS BIGINT) AS whole FROM customer")
def map_convert_int(spark, d):
    return mapping.map_fields(table(spark, d, "customer").select("c_custkey", "c_acctbal"), {"*": [FieldRule("c_acctbal", "whole", "convert", "int")]}, "customer")


@query("SELECT p_partkey, p_size, CAST(p_size AS DOUBLE) AS size FROM part")
def map_convert_float(spark, d):
    return mapping.map_fields(table(spark, d, "part").select("p_partkey", "p_size"), {"*": [FieldRule("p_size", "size", "convert", "float")]}, "part")


@query("SELECT n_nationkey, n_regionkey, n_regionkey <> 0 AS flag FROM nation")
def map_convert_bool(spark, d):
    return mapping.map_fields(table(spark, d, "nation").select("n_nationkey", "n_regionkey"), {"*": [FieldRule("n_regionkey", "flag", "convert", "bool")]}, "nation")


@query("SELECT CAST(p_size AS VARCHAR) AS p_size, p_partkey FROM part")
def map_convert_string(spark, d):
    return mapping.map_fields(table(spark, d, "part").select("p_partkey", "p_size"), {"*": [FieldRule("p_size", action="convert", kind="string")]}, "part")


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS at_text, o_orderdate AS stamp FROM orders")
def map_convert_timestamp(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("at_text"))
    out = mapping.map_fields(rows, {"*": [FieldRule("at_text", "stamp", "convert", "timestamp")]}, "orders")
    return out.withColumn("stamp", F.col("stamp").cast("timestamp_ntz"))


@query("SELECT s_suppkey, s_name AS name FROM supplier")
def map_wildcard(spark, d):
    rules = {"supplier": [FieldRule("s_name", "name")], "*": [FieldRule("s_suppkey", action="drop")]}
    return mapping.map_fields(table(spark, d, "supplier").select("s_suppkey", "s_name"), rules, "supplier")


@query("SELECT CAST(p_size AS VARCHAR) AS label, p_partkey FROM part")
def map_chain(spark, d):
    rules = {"*": [FieldRule("p_size", "size"), FieldRule("size", "label", "convert", "string"), FieldRule("size", action="drop")]}
    return mapping.map_fields(table(spark, d, "part").select("p_partkey", "p_size"), rules, "part")


def _nulls(spark, d):
    return table(spark, d, "customer").selectExpr("c_custkey", "nullif(c_mktsegment, 'BUILDING') AS segment", "nullif(c_nationkey, 3) AS nation")


_NULLS = "WITH t AS (SELECT c_custkey, nullif(c_mktsegment, 'BUILDING') AS segment, nullif(c_nationkey, 3) AS nation FROM customer) "


@query(_NULLS + """SELECT c_custkey, concat('{"c_custkey":', c_custkey, CASE WHEN segment IS NULL THEN '' ELSE concat(',"segment":"', segment, '"') END, CASE WHEN nation IS NULL THEN '' ELSE concat(',"nation":', nation) END, '}') AS doc FROM t""")
def null_drop_json(spark, d):
    rows, _ = mapping.null_policy(_nulls(spark, d), "drop")
    return rows.select("c_custkey", F.to_json(F.struct(*rows.columns)).alias("doc"))


@query(_NULLS + "SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, coalesce(segment, '') AS segment, coalesce(CAST(nation AS VARCHAR), '') AS nation FROM t")
def null_replace(spark, d):
    return mapping.null_policy(_nulls(spark, d), "replace")[0]


@query(_NULLS + "SELECT * FROM t WHERE segment IS NULL OR nation IS NULL")
def null_error_rows(spark, d):
    return mapping.null_policy(_nulls(spark, d), "error")[1]


@query("SELECT r_regionkey, r_name, 'public' AS schema FROM region")
def schema_field_add(spark, d):
    return mapping.add_schema_field(table(spark, d, "region").select("r_regionkey", "r_name"))


@query("SELECT r_regionkey, r_name FROM region")
def schema_field_remove(spark, d):
    from ferrywork.operators import transformers

    return transformers.schema_stage("mysql")(table(spark, d, "region").select("r_regionkey", "r_name", F.lit("sales").alias("schema")))


# --- verification --------------------------------------------------------------------------------------------------


def _copy(spark, d):
    """A copy of orders with missing, extra and changed rows."""
    source = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    target = source.where("o_orderkey % 11 <> 0").withColumn("o_totalprice", F.when(F.col("o_orderkey") % 13 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")))
    return source, target.unionByName(source.where("o_orderkey % 17 = 0").withColumn("o_orderkey", F.col("o_orderkey") + 100_000_000))


_COPY = """WITH src AS (SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders),
dst AS (SELECT o_orderkey, o_custkey, o_orderstatus, CASE WHEN o_orderkey % 13 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice FROM src WHERE o_orderkey % 11 <> 0
UNION ALL SELECT o_orderkey + 100000000, o_custkey, o_orderstatus, o_totalprice FROM src WHERE o_orderkey % 17 = 0) """


@query(_COPY + "SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey, CASE WHEN b.o_orderkey IS NULL THEN 'missing' WHEN a.o_orderkey IS NULL THEN 'extra' ELSE 'value_diff' END AS category FROM src a FULL JOIN dst b ON a.o_orderkey = b.o_orderkey WHERE a.o_orderkey IS NULL OR b.o_orderkey IS NULL OR a.o_totalprice <> b.o_totalprice")
def verify_records(spark, d):
    return verify.compare_records(*_copy(spark, d), ["o_orderkey"])


@query(_COPY + "SELECT a.o_orderkey, 'o_totalprice' AS field FROM src a JOIN dst b ON a.o_orderkey = b.o_orderkey WHERE a.o_totalprice <> b.o_totalprice")
def verify_field_diffs(spark, d):
    return verify.field_differences(*_copy(spark, d), ["o_orderkey"]).select("o_orderkey", "field")


@query(_COPY + "SELECT status, count(*) AS n FROM (SELECT CASE WHEN b.o_orderkey IS NULL THEN 'missing' WHEN a.o_orderkey IS NULL THEN 'extra' WHEN a.o_totalprice <> b.o_totalprice THEN 'checksum_diff' ELSE 'same' END AS status FROM src a FULL JOIN dst b ON a.o_orderkey = b.o_orderkey) GROUP BY 1")
def verify_checksums(spark, d):
    source, target = _copy(spark, d)
    return verify.compare_checksums(source, target, ["o_orderkey"], [F.col(c) for c in ("o_custkey", "o_orderstatus", "o_totalprice")]).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query(_COPY + "SELECT o_orderkey FROM src WHERE o_orderkey NOT IN (SELECT o_orderkey FROM dst)")
def missing_keys(spark, d):
    return verify.absent(*_copy(spark, d), ["o_orderkey"])


@query(_COPY + "SELECT o_orderkey FROM dst WHERE o_orderkey NOT IN (SELECT o_orderkey FROM src)")
def extra_keys(spark, d):
    source, target = _copy(spark, d)
    return verify.absent(target, source, ["o_orderkey"])


@query(_COPY + "SELECT o_orderkey FROM dst WHERE o_orderkey IN (SELECT o_orderkey FROM src)")
def verify_exists(spark, d):
    source, target = _copy(spark, d)
    return registry.by_keys(target.select("o_orderkey"), source, ["o_orderkey"])


_COUNTS = _COPY + ", c AS (SELECT 'orders' AS tbl, (SELECT count(*) FROM src) AS source_n, (SELECT count(*) FROM dst) AS target_n UNION ALL SELECT 'region', count(*), count(*) FROM region) "


def _compared(spark, d):
    source, target = _copy(spark, d)
    region = table(spark, d, "region")
    return verify.compare_counts(verify.counts({"public.orders": source, "region": region}), verify.counts({"orders": target, "region": region}))


@query(_COUNTS + "SELECT *, CASE WHEN source_n = target_n THEN 'PASS' ELSE 'FAIL' END AS status FROM c")
def verify_counts(spark, d):
    return _compared(spark, d).withColumnRenamed("table", "tbl")


@query(_COUNTS + "SELECT count(*) AS tables, count(*) FILTER (source_n = target_n) AS passed, count(*) FILTER (source_n <> target_n) AS failed, CAST(0 AS BIGINT) AS warned, CASE WHEN count(*) FILTER (source_n <> target_n) > 0 THEN 'FAIL' ELSE 'PASS' END AS status FROM c")
def verify_rollup(spark, d):
    return verify.roll_up(_compared(spark, d))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 100")
def sample_first_n(spark, d):
    return verify.first_rows(table(spark, d, "orders"), ["o_orderkey"], 100).select("o_orderkey", "o_totalprice")


@query(f"SELECT tbl, least(n, 100) AS by_number, least(n, greatest(1, CAST(floor(n * 5.0 / 100) AS BIGINT))) AS by_share FROM ({SQL['enumerate_tables']})")
def sample_size(spark, d):
    return enumerate_tables(spark, d).select("tbl", verify.sample_size(F.col("n"), 100).alias("by_number"), verify.sample_size(F.col("n"), 0, 5.0).alias("by_share"))


# --- accounting ----------------------------------------------------------------------------------------------------


def _units(spark, d):
    """Events as units: failed below 5, skipped for every seventh user, in batches of 100."""
    status = F.when(F.col("value") < 5, "failed").when(F.col("user_id") % 7 == 0, "skipped").otherwise("written")
    return table(spark, d, "events").select(F.col("event_type").alias("table"), F.col("event_id").alias("key"), F.length("props").cast("bigint").alias("size"), status.alias("status"), F.floor(F.col("event_id") / 100).alias("batch"), F.col("event_id").alias("position"))


_UNITS = "WITH u AS (SELECT event_type AS tbl, event_id, length(props) AS size, CASE WHEN value < 5 THEN 'failed' WHEN user_id % 7 = 0 THEN 'skipped' ELSE 'written' END AS status, event_id // 100 AS batch FROM events) "


@query(_UNITS + "SELECT tbl, count(*) AS scanned, count(*) FILTER (status = 'written') AS written, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'skipped') AS skipped, CAST(coalesce(sum(size) FILTER (status = 'written'), 0) AS BIGINT) AS bytes, count(DISTINCT batch) AS batches FROM u GROUP BY 1")
def table_metrics(spark, d):
    return accounting.table_metrics(_units(spark, d)).withColumnRenamed("table", "tbl")


@query("""WITH t AS (SELECT event_type AS tbl, count(*) AS scanned, sum(count(*)) OVER () AS total FROM events GROUP BY 1)
SELECT tbl, scanned, CAST(floor(77 * (scanned / total)) AS BIGINT) AS failed, CAST(floor(33 * (scanned / total)) AS BIGINT) AS skipped, CAST(floor(5555 * (scanned / total)) AS BIGINT) AS bytes, CAST(scanned - floor(77 * (scanned / total)) - floor(33 * (scanned / total)) AS BIGINT) AS written FROM t""")
def metrics_proportional(spark, d):
    by = table(spark, d, "events").groupBy(F.col("event_type").alias("tbl")).agg(F.count(F.lit(1)).alias("scanned"))
    return accounting.proportional(by, F.lit(77), F.lit(33), F.lit(5555))


@query(_UNITS + "SELECT event_id AS key, CASE WHEN event_id % 5 = 0 THEN 'failed' WHEN event_id % 3 = 0 THEN 'skipped' ELSE 'written' END AS status FROM u")
def write_outcomes(spark, d):
    units = _units(spark, d).select("key")
    return accounting.outcomes(units, units.where("key % 5 = 0"), units.where("key % 3 = 0"))


@query(f"SELECT tbl, n, CAST(ceil(n / 1000.0) AS BIGINT) AS batches FROM ({SQL['enumerate_tables']})")
def plan_estimates(spark, d):
    return planning.estimates(enumerate_tables(spark, d).withColumnRenamed("tbl", "table")).withColumnRenamed("table", "tbl")


@query("SELECT event_type AS category, count(*) AS n, concat('row ', min(event_id)) AS example FROM events WHERE value < 10 GROUP BY 1")
def failure_summary(spark, d):
    errors = table(spark, d, "events").where("value < 10").select(F.col("event_type").alias("category"), F.col("event_id").alias("position"), F.concat(F.lit("row "), "event_id").alias("message"))
    return accounting.failure_summary(errors)


@query(f"SELECT tbl FROM ({SQL['enumerate_tables']}) ORDER BY n DESC, tbl LIMIT 1")
def current_table(spark, d):
    counted = enumerate_tables(spark, d).select(F.col("tbl").alias("table"), F.col("n").alias("scanned"))
    return accounting.busiest_table(counted).withColumnRenamed("table", "tbl")


# --- scalars -------------------------------------------------------------------------------------------------------


@query("SELECT o_orderkey, substr(sha256(concat('orders:', o_orderkey)), 1, 16) AS h FROM orders")
def key_hash(spark, d):
    return table(spark, d, "orders").select("o_orderkey", values.key_hash(values.row_key("orders", ["o_orderkey"])).alias("h"))


@query("SELECT n_nationkey, sha256(concat(n_nationkey, '|', coalesce(nullif(n_name, 'FRANCE'), '<nil>'), '|', n_regionkey)) AS checksum FROM nation")
def row_checksum(spark, d):
    return table(spark, d, "nation").select("n_nationkey", values.row_checksum([F.col("n_nationkey"), F.expr("nullif(n_name, 'FRANCE')"), F.col("n_regionkey")]).alias("checksum"))


@query("SELECT n_nationkey, sha256(concat('n_name=', n_name, ',n_nationkey=', n_nationkey, ',n_regionkey=', n_regionkey)) AS checksum FROM nation")
def doc_checksum(spark, d):
    rows = table(spark, d, "nation").select("n_regionkey", "n_name", "n_nationkey")
    return rows.select("n_nationkey", values.map_checksum(models.texts(rows, rows.columns)).alias("checksum"))


@query("SELECT c_custkey, sha256(CASE WHEN c_custkey % 2 = 0 THEN concat('set|', least(c_name, c_mktsegment), ',', greatest(c_name, c_mktsegment)) ELSE concat('list|', c_name, ',', c_mktsegment) END) AS checksum FROM customer")
def redis_checksum(spark, d):
    kind = F.when(F.col("c_custkey") % 2 == 0, "set").otherwise("list")
    return table(spark, d, "customer").select("c_custkey", values.typed_checksum(kind, F.array("c_name", "c_mktsegment")).alias("checksum"))


@query("SELECT p_partkey, split_part(concat(p_brand, ':', p_type, ':x'), ':', 1) AS collection FROM part")
def collection_from_key(spark, d):
    return table(spark, d, "part").select("p_partkey", values.collection_of(F.concat_ws(":", "p_brand", "p_type", F.lit("x"))).alias("collection"))


@query("SELECT p_partkey, translate(p_name, ' :./', '____') AS document_id FROM part")
def sanitize_doc_id(spark, d):
    return table(spark, d, "part").select("p_partkey", values.document_id(F.col("p_name")).alias("document_id"))


@query("SELECT n_nationkey, n_name AS tbl FROM nation")
def normalize_table(spark, d):
    named = F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("public."), "n_name")).otherwise(F.col("n_name"))
    return table(spark, d, "nation").select("n_nationkey", values.normalized_table(named).alias("tbl"))


@query("SELECT p_partkey, CASE WHEN length(p_name) <= 12 THEN p_name ELSE concat(substr(p_name, 1, 9), '...') END AS short FROM part")
def truncate_text(spark, d):
    return table(spark, d, "part").select("p_partkey", values.truncated(F.col("p_name"), 12).alias("short"))


def _stamps(spark, d):
    """Order dates as texts in different layouts: plain, with fractions, zones and dates alone; some that are none."""
    day, clock = F.date_format("o_orderdate", "yyyy-MM-dd"), F.format_string("%02d:%02d:%02d", F.col("o_orderkey") % 24, F.col("o_orderkey") % 60, F.col("o_custkey") % 60)
    key = F.col("o_orderkey") % 8
    text = (
        F.when(key == 0, F.concat(day, F.lit(" "), clock)).when(key == 1, F.concat(day, F.lit("T"), clock, F.lit("Z"))).when(key == 2, F.concat(day, F.lit("T"), clock, F.lit(".120000Z")))
        .when(key == 3, F.concat(day, F.lit("T"), clock, F.lit(".123456789+02:00"))).when(key == 4, day).when(key == 5, F.concat(day, F.lit(" "), clock, F.lit(".5")))
        .when(key == 6, F.concat(day, F.lit("T"), clock, F.lit("+00:00"))).otherwise(F.concat(F.lit("on "), day))
    )
    return table(spark, d, "orders").select("o_orderkey", text.alias("v"))


_STAMPS = """WITH p AS (SELECT o_orderkey, o_orderkey % 8 AS key, strftime(o_orderdate, '%Y-%m-%d') AS day, printf('%02d:%02d:%02d', o_orderkey % 24, o_orderkey % 60, o_custkey % 60) AS clock FROM orders) """


def _stamp_sql(plain: bool, fraction9: str) -> str:
    """What becomes of each layout: the plain form, or T with fraction and zone."""
    if plain:
        return _STAMPS + "SELECT o_orderkey, CASE key WHEN 4 THEN concat(day, ' 00:00:00') WHEN 7 THEN concat('on ', day) ELSE concat(day, ' ', clock) END AS out FROM p"
    return _STAMPS + f"SELECT o_orderkey, CASE key WHEN 4 THEN concat(day, 'T00:00:00Z') WHEN 7 THEN concat('on ', day) WHEN 2 THEN concat(day, 'T', clock, '.12Z') WHEN 3 THEN concat(day, 'T', clock, '{fraction9}+02:00') WHEN 5 THEN concat(day, 'T', clock, '.5Z') ELSE concat(day, 'T', clock, 'Z') END AS out FROM p"


def _ts(name: str, target: str, sql: str) -> None:
    QUERIES[name] = lambda spark, d: _stamps(spark, d).select("o_orderkey", values.convert_timestamp(F.col("v"), target).alias("out"))
    SQL[name] = sql


_ts("ts_mysql_to_pg", "postgres", _stamp_sql(False, ".123456789"))
_ts("ts_pg_to_mysql", "mysql", _stamp_sql(True, ""))
_ts("ts_pg_to_mssql", "mssql", _stamp_sql(False, ".1234567"))
_ts("ts_mysql_to_mongo", "mongodb", _stamp_sql(False, ".123456789"))


@query("SELECT c_custkey, concat(c_name, '!') AS v FROM customer")
def ts_invalid_passthrough(spark, d):
    return table(spark, d, "customer").select("c_custkey", values.convert_timestamp(F.concat("c_name", F.lit("!")), "mysql").alias("v"))


@query("SELECT event_id, CASE WHEN event_id % 5 > 0 THEN greatest(event_id % 5 - 1, 1) END AS ttl FROM events")
def ttl_compensate(spark, d):
    return table(spark, d, "events").select("event_id", values.remaining_ttl(F.col("event_id") % 5).alias("ttl"))


@query("SELECT * FROM (VALUES ('42', CAST(42 AS BIGINT)), ('42.9', 42), ('-3.7', -3), ('x', NULL), (NULL, NULL)) t(v, out)")
def coerce_int(spark, d):
    return values_table(spark, "v", "('42'), ('42.9'), ('-3.7'), ('x'), (NULL)").select("v", values.to_int(F.col("v")).alias("out"))


@query("SELECT * FROM (VALUES ('1', true), ('t', true), ('False', false), ('0', false), ('2', true), ('yes', NULL), (NULL, NULL)) t(v, out)")
def coerce_bool(spark, d):
    return values_table(spark, "v", "('1'), ('t'), ('False'), ('0'), ('2'), ('yes'), (NULL)").select("v", values.to_bool(F.col("v")).alias("out"))


@query("SELECT o_orderkey, CAST(trunc(o_totalprice) AS BIGINT) AS whole, CAST(o_orderkey AS DOUBLE) AS number FROM orders")
def coerce_for_dest(spark, d):
    return table(spark, d, "orders").select("o_orderkey", values.to_int(F.col("o_totalprice")).alias("whole"), values.to_float(F.col("o_orderkey")).alias("number"))


@query("SELECT * FROM (VALUES ('999.99', '999.990', true), ('1000', '1000', true), ('1', '2', false), ('2024-01-15 10:30:00', '2024-01-15T10:30:00Z', true), ('2024-01-15 10:30:00', '2024-01-15T12:30:00.4+02:00', true), ('2024-01-15', '2024-01-15 00:00:00', false), ('NaN', 'NaN', true), ('1e400', '2e400', false), ('0.1', '0.1000000000001', false), (NULL, NULL, true), ('a', NULL, false)) t(a, b, same)")
def values_equal(spark, d):
    rows = values_table(spark, "a, b", "('999.99', '999.990'), ('1000', '1000'), ('1', '2'), ('2024-01-15 10:30:00', '2024-01-15T10:30:00Z'), ('2024-01-15 10:30:00', '2024-01-15T12:30:00.4+02:00'), ('2024-01-15', '2024-01-15 00:00:00'), ('NaN', 'NaN'), ('1e400', '2e400'), ('0.1', '0.1000000000001'), (NULL, NULL), ('a', NULL)")
    return rows.select("a", "b", values.values_equal(F.col("a"), F.col("b")).alias("same"))


@query("SELECT * FROM (VALUES ('10.500', '10.5'), ('10.000', '10'), ('100', '100'), ('0.0', '0'), ('-0.00', '0'), ('-2.50', '-2.5')) t(v, out)")
def decimal_normalize(spark, d):
    return values_table(spark, "v", "('10.500'), ('10.000'), ('100'), ('0.0'), ('-0.00'), ('-2.50')").select("v", values.plain_decimal(F.col("v")).alias("out"))


# Default expressions, and what each dialect makes of them.
_DEFAULTS = ["0", "'x'", "'now()'", "NOW()", "now()", "CURRENT_TIMESTAMP", "nextval('s')", "gen_random_uuid()", "datetime('now')", "my_call()", "unique_rowid()", ""]
_DEFAULTS_OF = {
    "postgres": ["0", "'x'", "'now()'", "NOW()", "now()", "CURRENT_TIMESTAMP", "nextval('s')", "gen_random_uuid()", None, None, None, None],
    "cockroachdb": ["0", "'x'", "'now()'", "CURRENT_TIMESTAMP", "CURRENT_TIMESTAMP", "CURRENT_TIMESTAMP", "nextval('s')", "gen_random_uuid()", None, None, "unique_rowid()", None],
    "mssql": ["0", "'x'", "'now()'", "CURRENT_TIMESTAMP", "CURRENT_TIMESTAMP", "CURRENT_TIMESTAMP", None, None, "datetime('now')", None, None, None],
    "sqlite": ["0", "'x'", "('now()')", "CURRENT_TIMESTAMP", "CURRENT_TIMESTAMP", "CURRENT_TIMESTAMP", None, None, "(datetime('now'))", None, None, None],
    "mysql": ["0", "'x'", "'now()'", "NOW()", "now()", "CURRENT_TIMESTAMP", "nextval('s')", "gen_random_uuid()", None, "my_call()", "unique_rowid()", None],
}


def _safe_default(dialect: str) -> None:
    literal = lambda v: "NULL" if v is None else "'" + v.replace("'", "''") + "'"

    def run(spark, d):
        return spark.createDataFrame([(v,) for v in _DEFAULTS], "v string").select("v", ddl.safe_default(F.col("v"), dialect).alias("out"))

    QUERIES[f"safe_default_{dialect}"] = run
    SQL[f"safe_default_{dialect}"] = f"SELECT * FROM (VALUES {', '.join(f'({literal(a)}, {literal(b)})' for a, b in zip(_DEFAULTS, _DEFAULTS_OF[dialect], strict=True))}) t(v, out)"


for _dialect in _DEFAULTS_OF:
    _safe_default(_dialect)


# --- models --------------------------------------------------------------------------------------------------------


@query("SELECT concat('nation:', n_nationkey) AS k, 'hash' AS kind, n_name AS name, CAST(n_regionkey AS VARCHAR) AS region FROM nation")
def sql_to_redis(spark, d):
    hashes = models.rows_to_hashes(table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey"), "nation", ["n_nationkey"])
    return hashes.select(F.col("key").alias("k"), F.col("type").alias("kind"), F.col("value.n_name").alias("name"), F.col("value.n_regionkey").alias("region"))


@query("SELECT 'region' AS collection, concat('region:', r_regionkey) AS _id, CAST(r_regionkey AS VARCHAR) AS document_id, concat('{\"r_regionkey\":', r_regionkey, ',\"r_name\":\"', r_name, '\"}') AS document FROM region")
def sql_to_mongo(spark, d):
    return models.rows_to_documents(table(spark, d, "region").select("r_regionkey", "r_name"), "region", ["r_regionkey"])


@query("SELECT concat('customer:', c_custkey) AS _key, CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, CAST(NULL AS VARCHAR) AS other FROM customer")
def redis_to_sql(spark, d):
    hashes = models.rows_to_hashes(table(spark, d, "customer").select("c_custkey", "c_name"), "customer", ["c_custkey"])
    return models.hashes_to_rows(hashes, ["c_custkey", "c_name", "other"])


@query("SELECT CAST(event_id AS VARCHAR) AS _id, json_extract_string(props, '$.k') AS k FROM events")
def mongo_to_sql(spark, d):
    return models.documents_to_rows(table(spark, d, "events").select(F.col("event_id").cast("string").alias("_id"), F.col("props").alias("document")), ["k"])


@query("SELECT CAST(event_id AS VARCHAR) AS _id, CASE WHEN event_id % 2 = 0 THEN props ELSE concat('{\"value\":\"', event_type, '\"}') END AS document FROM events")
def string_json_or_value(spark, d):
    rows = table(spark, d, "events").select(F.col("event_id").cast("string").alias("key"), F.when(F.col("event_id") % 2 == 0, F.col("props")).otherwise(F.col("event_type")).alias("value"))
    return models.string_to_document(rows, "key", "value")


@query("SELECT CAST(event_id AS VARCHAR) AS k, json_extract_string(props, '$.k') AS v FROM events")
def doc_to_hash(spark, d):
    documents = table(spark, d, "events").select(F.col("event_id").cast("string").alias("_id"), F.col("props").alias("document"))
    return models.documents_to_hashes(documents, ["k"]).select(F.col("key").alias("k"), F.try_element_at("value", F.lit("k")).alias("v"))


@query("SELECT CAST(event_id AS VARCHAR) AS k, concat('{\"value\":\"', event_type, '\"}') AS value FROM events")
def redis_nonhash_to_row(spark, d):
    return models.wrapped(table(spark, d, "events").select(F.col("event_id").cast("string").alias("key"), F.col("event_type").alias("value"))).withColumnRenamed("_key", "k")


@query("SELECT concat('user:', user_id, ':', event_id) AS _id, concat('user:', user_id) AS _stream, event_type AS kind FROM events")
def stream_explode(spark, d):
    entry = F.struct(F.col("event_id").cast("string").alias("id"), F.create_map(F.lit("kind"), "event_type").alias("fields"))
    streams = table(spark, d, "events").groupBy("user_id").agg(F.collect_list(entry).alias("value")).select(F.concat(F.lit("user:"), "user_id").alias("key"), "value")
    return models.streams_to_documents(streams).select("_id", "_stream", F.col("fields.kind").alias("kind"))


@query("SELECT concat('s:', s_suppkey) AS _id, concat('{\"members\":[\"', s_name, '\"]}') AS document FROM supplier")
def redis_set_to_mongo(spark, d):
    sets = table(spark, d, "supplier").select(F.concat(F.lit("s:"), "s_suppkey").alias("key"), F.array("s_name").alias("value"))
    return models.members_to_documents(sets, "members")


@query("SELECT n_nationkey, n_name, concat('{\"k\":', n_nationkey, '}') AS nested FROM nation")
def json_encode_nested(spark, d):
    rows = table(spark, d, "nation").select("n_nationkey", "n_name", F.struct(F.col("n_nationkey").alias("k")).alias("nested"))
    hashed = rows.select("n_nationkey", models.texts(rows, rows.columns).alias("m"))
    return hashed.select("n_nationkey", F.col("m.n_name").alias("n_name"), F.col("m.nested").alias("nested"))


@query("SELECT o_orderkey, c_name AS customer FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def fk_lookup_join(spark, d):
    joined = models.with_lookups(table(spark, d, "orders").select("o_orderkey", "o_custkey"), table(spark, d, "customer").select("c_custkey", "c_name"), "o_custkey", "c_custkey", "customer")
    return joined.select("o_orderkey", F.col("customer.c_name").alias("customer"))


@query("SELECT * FROM (VALUES (0, 'nation'), (1, 'customer'), (2, 'orders')) t(position, tbl)")
def fk_table_order(spark, d):
    order = planning.table_order(["orders", "customer", "nation"], [("orders", "customer"), ("customer", "nation")])
    return spark.createDataFrame(list(enumerate(order)), "position int, tbl string")


# --- plans ---------------------------------------------------------------------------------------------------------

# What providers can do, as they were written down apart from the library's table.
_CAPABILITIES = """(VALUES ('postgres', true, true, 'cross', true), ('mysql', true, true, 'cross', true), ('mariadb', true, true, 'cross', true), ('cockroachdb', true, true, 'cross', true),
('mssql', true, true, 'cross', true), ('sqlite', true, false, 'cross', true), ('mongodb', true, true, 'cross', true), ('redis', false, false, 'cross', true)) t(provider, has_schema, transactions, verification, incremental)"""


@query(f"SELECT * FROM {_CAPABILITIES}")
def capability_matrix(spark, d):
    return planning.capabilities(spark)


@query("""WITH p AS (SELECT * FROM (VALUES ('postgres'), ('mysql'), ('mariadb'), ('cockroachdb'), ('mssql'), ('sqlite'), ('mongodb'), ('redis')) t(n))
SELECT a.n AS source, b.n AS target, concat_ws('; ', CASE WHEN a.n = 'redis' THEN 'source has no schema' WHEN b.n = 'redis' THEN 'target has no schema' END, CASE WHEN b.n IN ('redis', 'sqlite') THEN 'target cannot defer constraints' END) AS blockers FROM p a JOIN p b ON a.n <> b.n""")
def preflight_matrix(spark, d):
    return planning.preflight(planning.capabilities(spark))


@query("SELECT * FROM (VALUES (0, 'c_custkey', 'bigint'), (1, 'c_name', 'string'), (2, 'c_nationkey', 'int'), (3, 'c_acctbal', 'double'), (4, 'c_mktsegment', 'string')) t(position, name, kind)")
def inspect_columns(spark, d):
    return spark.createDataFrame([(k, n, t) for k, (n, t) in enumerate(table(spark, d, "customer").dtypes)], "position int, name string, kind string")


from ferrywork.plans import library_queries, type_queries  # noqa: E402, F401  (they register themselves)


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
