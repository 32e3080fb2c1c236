from ledgermill.llm import mixing
from ledgermill.llm.catalog import TOKENIZER
from ledgermill.llm.mixing import Mixture, token_counts

DOCS = "doc_id long, source string, text string, n_tokens long, finish double, part int"
TARGETS = "source string, target_share double, max_repeats int, tokens long"


def mixture(spark, docs, targets, **kw):
    return Mixture(spark.createDataFrame([(*d, 1, 2.0, 3) for d in docs], DOCS), spark.createDataFrame([(*t, 9) for t in targets], TARGETS), TOKENIZER, **kw)


def test_shares_budget_and_exhaustion(spark):
    docs = [(i, " A " if i % 2 else "a", f"the page number {i} of the book") for i in range(600)] + [(1000 + i, "B", f"a row {i}") for i in range(900)] + [(5000 + i, "c", f"note {i}") for i in range(20)]
    docs += [docs[0], (None, "a", "x y"), (7000, None, "x"), (7001, "z", "x"), (7002, "b", None), (7003, "b", "")]
    m = mixture(spark, docs, [("a", 0.4, 2), ("b ", 0.3, 3), ("C", 0.2, 2), ("d", 0.1, None)])
    rows = m.rows().collect()
    assert sum(r.n_tokens for r in rows) <= m.total and m.total - sum(r.n_tokens for r in rows) < 50
    assert max(r.running for r in rows) == sum(r.n_tokens for r in rows)
    order = sorted(rows, key=lambda r: (r.finish, r.source, r.copy, r.doc_id))
    run = 0
    for r in order:
        run += r.n_tokens
        assert r.running == run
    uses = {}
    for r in rows:
        uses[r.source, r.doc_id] = uses.get((r.source, r.doc_id), 0) + 1
    assert max(v for (s, _), v in uses.items() if s == "a") <= 2 and max(v for (s, _), v in uses.items() if s == "b") <= 3
    rep = {r.source: r for r in m.report().collect()}
    assert rep["c"].exhausted and rep["d"].exhausted and not rep["a"].exhausted
    assert abs(rep["a"].used_tokens / rep["b"].used_tokens - 4 / 3) < 0.1
    assert {r.source for r in m.exhausted().collect()} == {"c", "d"}


def test_same_result_twice_and_other_seed(spark):
    docs = [(i, "a", "word " * (i % 7 + 1)) for i in range(300)]
    key = lambda m: sorted((r.doc_id, r.copy) for r in m.rows().collect())
    one = key(mixture(spark, docs, [("a", 1.0, 1)], budget=300))
    assert one == key(mixture(spark, docs, [("a", 1.0, 1)], budget=300)) != key(mixture(spark, docs, [("a", 1.0, 1)], budget=300, seed=1))


def test_empty_and_zero(spark):
    m = mixture(spark, [], [("a", 0.5, 1), ("b", 0.0, 1)])
    assert m.rows().collect() == [] and m.exhausted().collect() == [] and len(m.report().collect()) == 2
    m = mixture(spark, [(1, "a", "x")], [])
    assert m.rows().collect() == [] and m.report().collect() == []
    m = mixture(spark, [(1, "a", "x y z"), (2, "b", "x")], [("a", 0.0, 1), ("b", None, 2), (None, 0.5, 1)])
    assert m.rows().collect() == []


def test_long_text(spark):
    df = spark.createDataFrame([(1, "a", "abc " * 100_000), (2, "a", "x" * 200_000)], "doc_id long, source string, text string")
    assert all(r.n_tokens > 1000 for r in token_counts(df, TOKENIZER).collect())


def test_ranges_hold_equally_many_rows_where_times_bunch(spark, monkeypatch):
    monkeypatch.setattr(mixing, "RANGE_ROWS", 500)
    docs = spark.createDataFrame([(i, "a" if i < 200 else "b", "x" * (5 if i < 200 else 1)) for i in range(8000)], "doc_id long, source string, text string")
    targets = spark.createDataFrame([("a", 0.99, 1), ("b", 0.01, 1)], "source string, target_share double, max_repeats int")
    m = Mixture(docs, targets, None)
    rows = m.rows()
    assert rows.count() == 8000 and rows.agg({"running": "max"}).first()[0] == 8800
    held = [r["count"] for r in m.queue().repartitionByRange(16, "finish", "source", "copy", "doc_id").selectExpr("spark_partition_id() as part").groupBy("part").count().collect()]
    assert max(held) < 2000
    ordered = rows.orderBy("finish", "source", "copy", "doc_id").collect()
    assert [r.running for r in ordered] == sorted(r.running for r in ordered)


def test_only_copies_before_the_cut_are_made(spark):
    docs = spark.createDataFrame([(i, "a", "x" * 10) for i in range(100)] + [(200, "b", "y" * 500)], "doc_id long, source string, text string")
    targets = spark.createDataFrame([("a", 0.5, 1000), ("b", 0.5, 1)], "source string, target_share double, max_repeats int")
    m = Mixture(docs, targets, None, budget=1200)
    assert m.queue().count() < 300 and m.queue().count() >= m.rows().count() and 1180 <= m.rows().agg({"n_tokens": "sum"}).first()[0] <= 1200
