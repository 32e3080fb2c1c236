"""The pN_found queries give the rows of their plain SQL definitions; the others give rows."""

from collections import Counter

import pytest

from ledgermill.llm import catalog

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_oracle(spark, duck, sf, name):
    df = QUERIES[name](spark, sf)
    cursor = duck.execute(SQL[name])
    found = [d[0] for d in cursor.description]
    assert sorted(found) == sorted(df.columns)
    assert Counter(tuple(r[c] for c in found) for r in df.collect()) == Counter(cursor.fetchall())


def test_rows_of_queries_without_sql(spark, sf):
    for name in sorted(set(QUERIES) - set(SQL)):
        assert QUERIES[name](spark, sf).count() >= 0, name


def test_reports_fit_the_found_rows(spark, sf):
    share = {r.source: r for r in QUERIES["p7_report"](spark, sf).collect()}
    assert {s for s, r in share.items() if r.exhausted} == {r.source for r in QUERIES["p7_found"](spark, sf).collect()}
    assert abs(sum(r.actual_share for r in share.values()) - 1) < 1e-3
    shared = {r.doc_id for r in QUERIES["p8_coverage"](spark, sf).where("shared_chars > 0").collect()}
    assert shared == {d for r in QUERIES["p8_found"](spark, sf).collect() for d in r}
    assigned = QUERIES["p5_assign"](spark, sf).groupBy("bundle_key").agg({"split": "count"}).count()
    assert assigned == QUERIES["p5_assign"](spark, sf).select("bundle_key", "split").distinct().count()
