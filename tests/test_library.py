import json
import os
import sqlite3

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from ferrywork.operators import mapping, verify, writing
from ferrywork.operators.accounting import Progress
from ferrywork.operators.mapping import FieldRule
from ferrywork.plans import ddl, migration
from ferrywork.plans.planning import Manifest, table_order
from ferrywork.sources import registry, writers
from ferrywork.streaming import upsert
from ferrywork.streaming.upsert import upsert_stream


def test_error_strategy_raises(spark):
    a = spark.createDataFrame([(1, "x")], "id int, v string")
    assert writing.merge(a, spark.createDataFrame([(2, "y")], "id int, v string"), ["id"], "error").count() == 2
    with pytest.raises(PySparkException):
        writing.merge(a, a, ["id"], "error").collect()


def test_overwrite_widens(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "id int, v string")
    b = spark.createDataFrame([(2, 5)], "id int, n int")
    assert sorted(map(tuple, writing.merge(a, b, ["id"]).select("id", "v", "n").collect())) == [(1, "x", None), (2, "y", 5)]


def test_keep_last_ties(spark):
    rows = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, None)], "k int, o int, v string")
    assert sorted(map(tuple, writing.keep_last(rows, ["k"], [rows["o"]]).collect())) == [(1, 2, "b"), (2, 1, None)]


def test_convert_keeps_source(spark):
    df = spark.createDataFrame([("100",)], "val string")
    out = mapping.map_fields(df, {"*": [FieldRule("val", "score", "convert", "int")]}, "t")
    assert out.first().asDict() == {"val": "100", "score": 100}


def test_sqlite_source(spark, tmp_path):
    path = str(tmp_path / "a.db")
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE t (id INTEGER PRIMARY KEY, name TEXT, price REAL)")
        db.executemany("INSERT INTO t VALUES (?, ?, ?)", [(k, f"n{k}", k / 2) for k in range(1, 101)])
    df = registry.read(spark, "sqlite", path=path, table="t", parts=3)
    assert df.count() == 100 and df.agg({"price": "sum"}).first()[0] == 2525.0


def test_sources_are_named_once():
    assert {"postgres", "mysql", "mariadb", "cockroachdb", "mssql", "sqlite", "mongodb", "redis"} <= set(registry.names())
    with pytest.raises(ValueError):
        registry.register("sqlite", registry.sqlite)


def test_write_and_stream(spark, tmp_path):
    path, source = str(tmp_path / "t"), str(tmp_path / "in")
    assert registry.write(spark.createDataFrame([(1, 1, "a"), (2, 1, "b")], "id int, o int, v string"), path, ["id"]) == 2
    spark.createDataFrame([(2, 1, "c"), (2, 2, "d"), (3, 1, "e")], "id int, o int, v string").write.parquet(source)
    stream = spark.readStream.schema("id int, o int, v string").parquet(source)
    upsert_stream(stream, path, ["id"], [stream["o"]], str(tmp_path / "ck")).awaitTermination()
    assert sorted((r["id"], r["v"]) for r in spark.read.parquet(path).collect()) == [(1, "a"), (2, "d"), (3, "e")]


def test_manifest(tmp_path):
    path = str(tmp_path / "m.json")
    Manifest({"a": 1}, ["t"]).save(path)
    assert Manifest.load(path, {"a": 1}).remaining(["t", "u"]) == ["u"]
    with pytest.raises(ValueError):
        Manifest.load(path, {"a": 2})


def test_table_order():
    assert table_order(["a", "b", "c"], [("a", "b"), ("b", "c")]) == ["c", "b", "a"]
    assert table_order(["a", "b"], [("a", "b"), ("b", "a")]) == ["a", "b"]


def test_version_switch_survives_a_stop(spark, tmp_path):
    """A write that stops between its steps leaves the old table or the new one, never none."""
    path = str(tmp_path / "t")
    rows = spark.createDataFrame([(k, "old") for k in range(100)], "id int, v string")
    registry.write(rows, path, ["id"])
    rows.withColumn("v", rows["id"].cast("string")).write.parquet(f"{path}.new")  # whole, not yet in place
    os.rename(path, f"{path}.old")
    assert registry.write(spark.createDataFrame([(1000, "x")], "id int, v string"), path, ["id"]) == 101
    os.rename(path, f"{path}.old")  # nothing new was written
    assert registry.exists(spark, path) and spark.read.parquet(path).count() == 101


def test_upsert_rewrites_touched_parts_only(spark, tmp_path):
    path = str(tmp_path / "t")
    upsert.upsert(spark.createDataFrame([(k, k) for k in range(2000)], "id int, v int"), path, ["id"], [F.col("v")])
    before = {p: os.stat(f"{path}/{p}").st_mtime_ns for p in os.listdir(path) if "=" in p}
    upsert.upsert(spark.createDataFrame([(5, 50), (5, 51), (5000, 1)], "id int, v int"), path, ["id"], [F.col("v")])
    after = {p: os.stat(f"{path}/{p}").st_mtime_ns for p in os.listdir(path) if "=" in p}
    assert 0 < sum(before[p] != after[p] for p in before) <= 2
    found = dict(map(tuple, spark.read.parquet(path).select("id", "v").collect()))
    assert len(found) == 2001 and found[5] == 51 and found[5000] == 1 and found[6] == 6


def test_first_seen(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.createDataFrame([(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:01:00"), (2, "2024-01-01 00:02:00")], "id int, ts string").selectExpr("id", "cast(ts as timestamp) as ts").write.parquet(source)
    stream = upsert.first_seen(spark.readStream.schema("id int, ts timestamp").parquet(source), ["id"], "ts")
    stream.writeStream.format("memory").queryName("seen").trigger(availableNow=True).start().awaitTermination()
    assert sorted(r["id"] for r in spark.sql("select id from seen").collect()) == [1, 2]


@pytest.fixture
def database(tmp_path):
    path = str(tmp_path / "a.db")
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE users (id INTEGER PRIMARY KEY, name TEXT NOT NULL, born DATETIME DEFAULT CURRENT_TIMESTAMP, score REAL)")
        db.execute("CREATE TABLE orders (id INTEGER PRIMARY KEY, user_id BIGINT REFERENCES users(id), total DECIMAL(10,2))")
        db.execute("CREATE INDEX by_user ON orders (user_id)")
        db.executemany("INSERT INTO users VALUES (?, ?, ?, ?)", [(k, f"n{k}", "2024-01-02 03:04:05", k / 2) for k in range(50)])
        db.executemany("INSERT INTO orders VALUES (?, ?, ?)", [(k, k % 50, k * 1.5) for k in range(200)])
    return path


def rows_of(path, statement):
    with sqlite3.connect(path) as db:
        return db.execute(statement).fetchall()


def test_inspect_sqlite(database):
    orders, users = ddl.inspect_sqlite(database)
    assert (orders.name, orders.key, orders.references, orders.indexes) == ("orders", ["id"], [("user_id", "users", "id")], [("by_user", ("user_id",), False)])
    assert [c.kind for c in users.columns] == ["INTEGER", "TEXT", "DATETIME", "REAL"] and users.columns[2].default == "CURRENT_TIMESTAMP" and not users.columns[1].nullable


def test_sqlite_filters_go_down(spark, database):
    found = registry.read(spark, "sqlite", path=database, table="orders").where("id >= 190 and user_id = 45")
    assert [r["id"] for r in found.collect()] == [195]


@pytest.mark.parametrize("strategy", ["overwrite", "skip"])
def test_sqlite_writer(spark, database, strategy):
    rows = spark.createDataFrame([(1, "new"), (1, "new"), (900, "more")], "id long, name string")
    writers.write_sqlite(rows, database, "users", ["id"], strategy)
    assert rows_of(database, "SELECT name, score FROM users WHERE id = 1") == [("new" if strategy == "overwrite" else "n1", 0.5)]
    assert rows_of(database, "SELECT name FROM users WHERE id = 900") == [("more",)] and rows_of(database, "SELECT count(*) FROM users") == [(51,)]
    assert not [p for p in os.listdir(os.path.dirname(database)) if ".part-" in p]


def test_sqlite_writer_refuses_keys_that_exist(spark, database):
    with pytest.raises(Exception):
        writers.write_sqlite(spark.createDataFrame([(1, "new")], "id long, name string"), database, "users", ["id"], "error")
    assert rows_of(database, "SELECT name FROM users WHERE id = 1") == [("n1",)]


def test_documents_keep_fields_that_new_ones_lack(spark, tmp_path):
    path = str(tmp_path / "d")
    rows = lambda *x: spark.createDataFrame(list(x), "_id string, collection string, document string")
    writers.write_documents(rows(("a", "c", '{"x":1,"y":2}'), ("b", "c", '{"x":3}')), path)
    assert writers.write_documents(rows(("a", "c", '{"y":5,"z":[1]}'), ("d", "c", "{}")), path) == 3
    found = {r["_id"]: json.loads(r["document"]) for r in spark.read.schema("_id string, document string").json(path).collect()}
    assert found == {"a": {"x": 1, "y": 5, "z": [1]}, "b": {"x": 3}, "d": {}}


def test_migration_resumes_and_verifies(spark, database, tmp_path):
    target, state = str(tmp_path / "b.db"), str(tmp_path / "state.json")
    sqlite3.connect(target).close()
    options = migration.Options(fk_handling="ordered")
    copy = migration.Migration(migration.Side(spark, "sqlite", database), migration.Side(spark, "sqlite", target), options, state=state)
    assert [t.name for t in copy.ordered(copy.source.catalog())] == ["users", "orders"]
    seen = []
    copy.report = lambda event, details: (seen.append(details["table"]), copy.cancel())
    assert copy.run()["written"] == 50 and seen == ["users"]
    again = migration.Migration(copy.source, copy.target, migration.Options(fk_handling="ordered", resume=True), state=state)
    assert again.run()["written"] == 200 and again.verify().status == "PASS"
    assert rows_of(target, "SELECT * FROM orders ORDER BY id") == rows_of(database, "SELECT * FROM orders ORDER BY id")
    with sqlite3.connect(target) as db:
        db.execute("DELETE FROM users WHERE id = 7")
        db.execute("UPDATE orders SET total = -1")
    report = again.verify()
    assert report.status == "FAIL" and {t["table"]: t["status"] for t in report.tables} == {"orders": "WARN", "users": "FAIL"}
    assert "count_mismatch" in report.text() and json.loads(report.json())["status"] == "FAIL" and report.line().startswith("Verification: FAIL")


def test_migration_between_models(spark, database, tmp_path):
    """Tables to documents to records and back to tables, each copy verified."""
    rules = {"users": [FieldRule("name", "label")]}
    side = lambda kind: migration.Side(spark, kind, str(tmp_path / kind))
    no_keys = migration.Options(fk_handling="skip")
    first = migration.Migration(migration.Side(spark, "sqlite", database), side("mongodb"), no_keys, rules)
    assert first.run()["failures"] == {} and first.verify().status == "PASS"
    second = migration.Migration(side("mongodb"), side("redis"), no_keys)
    assert second.run()["failures"] == {} and second.verify().status == "PASS"
    back = str(tmp_path / "c.db")
    sqlite3.connect(back).close()
    third = migration.Migration(side("redis"), migration.Side(spark, "sqlite", back), no_keys)
    assert third.run()["failures"] == {} and third.verify().status == "PASS"
    assert rows_of(back, "SELECT _key, label FROM users WHERE id = '7'") == [("users:7", "n7")]


def test_blocked_and_failing_copies(spark, database, tmp_path):
    blocked = migration.Migration(migration.Side(spark, "sqlite", database), migration.Side(spark, "sqlite", str(tmp_path / "x.db")))
    with pytest.raises(migration.CopyError) as error:
        blocked.run()
    assert error.value.kind == "config" and "constraints" in blocked.plan().text()
    with pytest.raises(ValueError):
        migration.Options(conflict="maybe")
    with pytest.raises(ValueError):
        verify.Options(sample_mode="pct", sample_pct=0)


def test_retries():
    pauses, tries = [], []

    def run():
        tries.append(1)
        if len(tries) < 3:
            raise ConnectionError("gone")
        return "done"

    assert migration.with_retries(run, "connection", pauses.append) == "done" and pauses == [1.0, 2.0]
    tries.clear()
    with pytest.raises(ConnectionError):
        migration.with_retries(lambda: (tries.append(1), run())[1] if len(tries) > 99 else (_ for _ in ()).throw(ConnectionError()), "scan", pauses.append)


def test_runs_are_listed_newest_first(spark, database, tmp_path):
    path, state = str(tmp_path / "b.db"), str(tmp_path / "runs")
    sqlite3.connect(path).close()
    runs = migration.Runs(spark, state)
    for name in ("one", "two"):
        runs.run(name, migration.Migration(migration.Side(spark, "sqlite", database), migration.Side(spark, "sqlite", path), migration.Options(fk_handling="skip", dry_run=True)))
    assert [r["id"] for r in migration.Runs(spark, state).listed()] == ["two", "one"]


def test_pages_of_streams_overlap():
    members = list(range(250))
    pages = list(registry.paged(members, "stream"))
    assert pages[1][0] == pages[0][-1] and sorted({m for p in pages for m in p}) == members
    assert [len(p) for p in registry.paged(members * 4, "hash")] == [500, 500]


def test_progress():
    p = Progress()
    p.add(100, 80, 20, seconds=4)
    p.add(100, 20, seconds=6)
    assert p.throughput() == 10 and p.peak == 20 and p.remaining() == 10


def test_generated_tables_repeat(spark):
    a, b = (registry.generated(spark, 500, parts) for parts in (2, 5))
    assert all(sorted(map(str, a[t].collect())) == sorted(map(str, b[t].collect())) for t in a)


def test_globs(spark):
    rows = spark.createDataFrame([("user:1",), ("user:12",), ("order:1",), ("a*b",), ("axb",)], "key string")
    found = lambda p: sorted(r["key"] for r in registry.matching(rows, "key", p).collect())
    assert found("user:?") == ["user:1"] and found("*:1") == ["order:1", "user:1"] and found("a\\*b") == ["a*b"] and found("[^u]*1") == ["order:1"]


def test_pending_tables():
    assert registry.pending(["a", "b", "c"], ["a", "public.b"], "public") == ["c"]
