"""Every query with SQL gives the rows that DuckDB gives on the same tables."""

import math
from collections import Counter

import pytest

import __spark_entry__ as entry
from ledgermill.plans import catalog

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


def norm(v):
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(map(norm, v))
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    if type(v).__name__ == "Decimal":
        return round(float(v), 6)
    return v


def check(df, duck, sql):
    columns = sorted(df.columns)
    cursor = duck.execute(sql)
    found = [d[0] for d in cursor.description]
    assert sorted(found) == columns
    at = [found.index(c) for c in columns]
    want = Counter(repr(tuple(norm(r[i]) for i in at)) for r in cursor.fetchall())
    got = Counter(repr(tuple(norm(r[c]) for c in columns)) for r in df.collect())
    assert got == want


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_oracle(spark, duck, sf, name):
    check(QUERIES[name](spark, sf), duck, SQL[name])


def test_import_sources_without_broadcast(spark, duck, sf):
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        check(QUERIES["import_sources"](spark, sf), duck, SQL["import_sources"])
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)


def test_rows_of_queries_without_sql(spark, sf):
    for name in sorted(set(QUERIES) - set(SQL)):
        assert QUERIES[name](spark, sf).count() > 0, name


def test_entry_and_names(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(QUERIES) <= set(entry.queries())
