"""Every registered query: it runs, and equals its SQL where it has one."""

import datetime as dt
import decimal
import os

import duckdb
import pytest

from pageloom import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the given tables")


def value(v):
    if v is None or v != v:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, (int, float, decimal.Decimal)):
        return round(float(v), 6)
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


def rows(names, found):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(([value(r[i]) for i in order] for r in found), key=str)


@pytest.fixture(scope="module")
def sql():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_equals_sql(spark, sql, name):
    df = catalog.QUERIES[name](spark, SF)
    d = sql.execute(catalog.SQL[name])
    want = rows([c[0] for c in d.description], d.fetchall())
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == want and want[1]


#: What names a row of the queries without SQL, and how few rows they may have (of 200 documents, 1,829 lines, 1,000 events).
KEYS = {"split_units": ("doc_id", "unit_id"), "sanitize_repeats": ("doc_id",), "translation_postprocess": ("doc_id", "ord"), "quota_lease_replay": ("client", "lease", "action")}
AT_LEAST = {"split_units": 1829, "sanitize_repeats": 200, "translation_postprocess": 1829, "quota_lease_replay": 2000}


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_runs(spark, name):
    df = catalog.QUERIES[name](spark, SF).persist()
    keys = [k for k in KEYS[name] if k in df.columns]
    n = df.count()
    assert n >= AT_LEAST[name] and df.select(*keys).distinct().count() == n
    df.unpersist()


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
