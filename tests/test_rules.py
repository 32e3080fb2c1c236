import random

import pytest
from pyspark.sql import functions as F

from ledgermill.functions import grammar as G
from ledgermill.functions.readings import plain_reading
from ledgermill.operators import ranking

RULE = "value_format string, minimum double, maximum double, decimal_places int, allowed_values array<string>, expected_minimum double, expected_maximum double, allow_empty boolean, suggest_missing_decimal boolean, prefer_expected_range boolean, require_decimal boolean"


def rule(fmt="numeric", lo=None, hi=None, places=None, allowed=(), elo=None, ehi=None, empty=True, prefer=False, need=False):
    real = lambda v: None if v is None else float(v)
    return (fmt, real(lo), real(hi), places, list(allowed), real(elo), real(ehi), empty, False, prefer, need)


def frame(spark, rows):
    return spark.createDataFrame(rows, f"text string, cands array<string>, rule struct<{RULE.replace(', ', ',').replace(' ', ':')}>")


ERRORS = [
    ("", rule(), []),
    (None, rule(empty=False), ["required_cell_empty"]),
    (" \n", rule(empty=False), ["required_cell_empty"]),
    ("12\n", rule("integer"), []),
    ("1 2", rule("integer"), ["expected_integer"]),
    ("12.5", rule("integer"), ["expected_integer"]),
    ("−5", rule(lo=0), ["below_minimum"]),
    ("70", rule(lo=0, hi=70), []),
    ("70,1", rule(hi=70, places=1), ["above_maximum"]),
    ("70.10", rule(places=1), ["decimal_places_mismatch"]),
    ("70", rule(places=1, need=True), ["decimal_places_mismatch", "decimal_part_required"]),
    ("8.2 ± 0.4", rule("complex_numeric"), []),
    ("8.2 ± 0.4", rule("complex_numeric", lo=0), ["range_not_checkable"]),
    ("abc", rule("complex_numeric"), ["invalid_numeric_format"]),
    ("abc", rule("text", allowed=["abd"]), ["value_not_allowed"]),
    ("1.50", rule(allowed=["1,5"]), []),
    ("٣", rule("integer"), []),
    ("9" * 60, rule(), []),
]


def test_hard_errors(spark):
    df = frame(spark, [(t, [], r) for t, r, _ in ERRORS])
    got = [r.e for r in df.select(G.hard_errors(F.col("text"), F.col("rule")).alias("e")).collect()]
    assert got == [e for *_, e in ERRORS]


CONSTRAIN = [
    ("99.8", ["49.8"], rule(hi=70, places=1), "49.8", {"rule_selected_alternative", "value_rule_review_required"}),
    ("3417", [], rule(hi=70, places=1), "34.7", {"separator_reclassified_from_one", "value_rule_review_required"}),
    ("347", [], rule(hi=70, places=1), "34.7", {"separator_inferred_from_rule", "value_rule_review_required"}),
    ("abc", [], rule(), "abc", {"rule_conflict", "expected_decimal_number", "value_rule_review_required"}),
    ("60", ["20"], rule(elo=10, ehi=30, prefer=True), "20", {"expected_range_selected_alternative", "value_rule_review_required"}),
    ("60", [], rule(elo=10, ehi=30), "60", {"outside_expected_range", "value_rule_review_required"}),
    ("", [], rule(empty=False), "", {"required_cell_empty"}),
    (None, None, rule(), "", set()),
    ("12,5", [], rule(), "12.5", {"rule_selected_alternative", "value_rule_review_required"}),
]


def test_constrain(spark):
    df = frame(spark, [(t, c, r) for t, c, r, *_ in CONSTRAIN])
    none = F.array().cast("array<string>")
    c = G.constrain(F.col("text"), F.col("cands"), F.create_map().cast("map<string,double>"), F.lit(0.5), none, F.col("rule"))
    got = [(r.c.text, set(r.c.flags)) for r in df.select(c.alias("c")).collect()]
    assert got == [(t, f) for *_, t, f in CONSTRAIN]


def test_constrained_reading_is_valid_or_flagged(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("0123456789.,−x ") for _ in range(rng.randint(0, 6)))
    df = frame(spark, [(word(), [word() for _ in range(rng.randint(0, 3))], rule(lo=0, hi=70, places=1)) for _ in range(400)])
    none = F.array().cast("array<string>")
    c = G.constrain(F.col("text"), F.col("cands"), F.create_map().cast("map<string,double>"), F.lit(0.5), none, F.col("rule"))
    for r in df.select("text", "cands", c.alias("c"), G.hard_errors(c["text"], F.col("rule")).alias("e")).collect():
        assert set(r.e) <= set(r.c.flags) and r.c.flags == sorted(set(r.c.flags))


@pytest.mark.parametrize(("text", "shape", "identity"), [("47.2", "##.#", "47.2"), ("−4,70", "-#.##", "-4.7"), ("0.00", "#.##", "0"), ("100", "###", "100"), ("x", None, None)])
def test_shapes_and_identities(spark, text, shape, identity):
    r = spark.createDataFrame([(text,)], "t string").select(G.numeric_shape(F.col("t")).alias("s"), G.numeric_identity(F.col("t")).alias("i")).first()
    assert (r.s, r.i) == (shape, identity)


def test_plain_reading(spark):
    cases = {" ＋１２ , ５ ": "12.5", "– 3": "-3", "": None, "   ": None, None: None, "++7": "7"}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert [r[0] for r in df.select(plain_reading(F.col("t"))).collect()] == list(cases.values())


def test_column_names(spark):
    df = spark.createDataFrame([(i,) for i in (0, 25, 26, 701, 702, 18277)], "i long")
    assert [r[0] for r in df.select(G.column_name(F.col("i"))).collect()] == ["A", "Z", "AA", "ZZ", "AAA", "ZZZ"]


def test_review_flags(spark):
    df = spark.createDataFrame([([], "automatic"), (["high_accuracy_consensus"], "automatic"), (["new_flag"], "automatic"), (["new_flag"], "confirmed"), (None, "automatic")], "f array<string>, s string")
    assert [r[0] for r in df.select(G.needs_review(F.col("f"), F.col("s"))).collect()] == [False, False, True, False, False]


def test_cascade_counts_splits_and_checks(spark):
    said = [(1, "a", "base-0", "12", 0.8), (1, "a", "split-left", "1.2", 0.5), (1, "b", "split-left", "1.2", 0.4), (2, "a", "base-0", "7", 0.6), (2, "b", "base-0", "8", 0.5), (3, "a", "base-0", "x", 0.9)]
    obs = spark.createDataFrame(said, "cell_id long, model string, image_key string, value string, support double")
    held = spark.createDataFrame([(i, rule()) for i in (1, 2, 3)], f"cell_id long, rule struct<{RULE.replace(', ', ',').replace(' ', ':')}>")
    checks = spark.createDataFrame([(1, 2, "8", 0.9, 0.9), (1, 2, "8", 0.9, 0.9), (2, 2, "9", 1.0, 1.0)], "check_id long, cell_id long, text string, support double, confidence double")
    got = {r.cell_id: (r.value, r.score, r.flags.split(",")) for r in ranking.cascade_ranked(obs, held, F.lit(1.0), checks).collect()}
    assert got[1][:2] == ("1.2", 1.62) and got[2][:2] == ("8", 1.2255)
    assert "digit_verifier_agrees" in got[2][2] and got[3][0] == "x" and "high_accuracy_no_consensus" in got[3][2]


def test_cascade_with_what_is_seen(spark):
    said = [(1, "a", "base-0", "12", 0.8), (1, "a", "base-1", "1.2", 0.5), (2, "a", "base-0", "7", 0.9), (2, "b", "base-0", "77", 0.5)]
    obs = spark.createDataFrame(said, "cell_id long, model string, image_key string, value string, support double")
    kind = f"struct<{RULE.replace(', ', ',').replace(' ', ':')}>"
    held = spark.createDataFrame([(i, rule(places=p)) for i, p in ((1, 1), (2, None))], f"cell_id long, rule {kind}")
    checks = spark.createDataFrame([], "check_id long, cell_id long, text string, support double, confidence double")
    seen = spark.createDataFrame([(1, 0.8, None), (2, None, 2)], "cell_id long, separator double, digits int")
    got = {r.cell_id: (r.value, round(r.score, 6), r.flags.split(",")) for r in ranking.cascade_ranked(obs, held, F.lit(1.0), checks, seen).collect()}
    # 12 breaks the rule and speaks for 1.2 at 0.72 * 0.8; 1.2 itself has 0.78 and the separator adds 1.25 * 0.8.
    assert got[1][0] == "1.2" and got[1][1] == round(0.72 * 0.8 + 0.78 + 1.0, 6) and "decimal_separator_detected" in got[1][2]
    # 7 lacks a visible digit, so it counts a fifth.
    assert got[2][0] == "77" and "visible_digit_count_used" in got[2][2]
