"""Every query of the reference's operators against its SQL, on the smallest tables."""

import duckdb
import pytest

from ferrywork.plans import queries as Q

D = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from read_parquet('{D}/{t}.parquet')")
    return c


def canonical(rows):
    one = lambda v: None if v is None or v != v else round(v, 6) if isinstance(v, float) else v if isinstance(v, (int, bool, str)) else str(v)
    return sorted((tuple(one(v) for v in r) for r in rows), key=lambda t: tuple((v is None, str(v)) for v in t))


@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_same_rows(spark, db, name):
    df = Q.QUERIES[name](spark, D)
    columns = sorted(df.columns)
    answer = db.sql(Q.SQL[name])
    at = [[d[0] for d in answer.description].index(c) for c in columns]
    assert canonical(df.select(*columns).collect()) == canonical([r[k] for k in at] for r in answer.fetchall())


def test_split_batches(spark):
    from ferrywork.operators.writing import byte_batches

    found = {(r["scan"], r["o_orderkey"]): r["batch"] for r in Q.QUERIES["split_batches"](spark, D).collect()}
    by_scan = {}
    for scan, key in sorted(found):
        by_scan.setdefault(scan, []).append(key)
    for scan, keys in by_scan.items():
        assert [found[scan, k] for k in keys] == byte_batches([10 + k % 97 for k in keys], 2000)
