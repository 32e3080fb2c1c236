"""Checks over a page's rows: outliers, rows of marks, review counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgermill.functions import grammar as G

OUTLIER, PLAUSIBLE = "table_outlier", "table_outlier_with_plausible_alternative"


def outliers(cells: DataFrame, group: Sequence[str], value: Column, minimum: int = 5) -> DataFrame:
    """Adds center, threshold and is_outlier per group; groups under ``minimum`` values have none.

    Two exact medians per group: the first is joined back by a window on the same keys, so
    both use one shuffle. Groups are rows of a page; null values take no part.
    """
    w = Window.partitionBy(*group)
    df = cells.withColumn("value", value).where("value is not null")
    df = df.withColumn("n", F.count("*").over(w)).where(F.col("n") >= minimum)
    df = df.withColumn("center", F.median("value").over(w)).withColumn("distance", F.abs(F.col("value") - F.col("center")))
    df = df.withColumn("spread", F.median("distance").over(w))
    df = df.withColumn("threshold", F.greatest(F.lit(10.0), F.abs("center") * 0.45, F.col("spread") * 1.4826 * 4.5))
    return df.withColumn("is_outlier", F.col("distance") > F.col("threshold"))


def flag_outliers(cells: DataFrame, comparable: Column | None = None) -> DataFrame:
    """Resolved readings with their outlier flags computed anew; other flags and texts stay.

    Values are compared within a row of one document's page, among cells under one named rule
    or, where given, with one value of ``comparable``.

    Only data cells under a named rule count, not excluded, not fixed, not in header rows or
    label columns. A flagged cell also says whether an alternative reading obeys the rule and
    lies within the threshold.
    """
    counted = (F.col("cell_row") >= F.col("header_rows")) & (F.col("cell_column") >= F.col("row_label_columns")) & ~F.col("excluded") & F.col("fixed").isNull() & (F.col("kind") == "rule")
    value = G.number(F.col("c.text")).cast("double")
    key = ["run_id", "template_id", "page_index", "cell_row", "comparable"]
    own = cells.where(counted & (F.col("status") != "excluded")).withColumn("comparable", F.col("rule_name") if comparable is None else comparable)
    found = outliers(own.where("comparable <> ''").select("cell_id", *key, "rule", "c"), key, value).where("is_outlier")
    near = lambda v: G.valid(v, F.col("rule")) & F.coalesce(F.abs(G.number(v).cast("double") - F.col("center")) <= F.col("threshold"), F.lit(False))
    plausible = F.exists(F.transform(F.split(F.col("c.alternative"), r" \| "), G.strip), near)
    marks = found.select("cell_id", F.when(plausible, F.array(F.lit(OUTLIER), F.lit(PLAUSIBLE))).otherwise(F.array(F.lit(OUTLIER))).alias("marks"))
    none = F.array().cast("array<string>")
    kept = F.filter("c.flags", lambda f: ~f.isin(OUTLIER, PLAUSIBLE))
    return cells.join(marks, "cell_id", "left").withColumn("flags_now", F.array_sort(F.array_distinct(F.concat(kept, F.coalesce("marks", none))))).drop("marks")


def looks_like_mark(text: Column) -> Column:
    """No number, and at least as many other characters as digits (at least one)."""
    t = G.strip(text)
    digits = F.length(F.regexp_replace(t, r"(?U)\D", ""))
    other = F.length(F.regexp_replace(t, r"(?U)[\d.,+\-−<>≤≥=%/ ]", ""))
    return (t != "") & ~G.is_complex(t) & (other >= F.greatest(F.lit(1), digits))


def mark_evidence(raw: Column, alternative: Column, confidence: Column, flags: Column) -> Column:
    """The signature of a scribble: unstable, non-numeric, with two non-numeric alternatives."""
    unsure = (F.coalesce(confidence, F.lit(0.0)) < 0.90) | F.arrays_overlap(flags, F.array(*map(F.lit, ("low_confidence", "unstable_consensus", "model_disagreement"))))
    others = F.size(F.filter(F.split(F.coalesce(alternative, F.lit("")), r" \| "), looks_like_mark))
    return looks_like_mark(raw) & (others >= 2) & F.coalesce(unsure, F.lit(False))


def mark_rows(cells: DataFrame, group: Sequence[str], evidence: Column) -> DataFrame:
    """Groups of at least two numeric cells of which at least 80 % (and two) carry evidence."""
    per = cells.groupBy(*group).agg(F.count("*").alias("n_cells"), F.sum(evidence.cast("int")).alias("n_marks"))
    return per.where((F.col("n_cells") >= 2) & (F.col("n_marks") >= F.greatest(F.lit(2), F.ceil(F.col("n_cells") * 0.8))))


def review_counts(flagged: DataFrame) -> DataFrame:
    """Per page: cells, cells with hard errors, outliers, and unresolved ones."""
    errors = F.size(G.hard_errors(F.col("c.text"), F.col("rule"))) > 0
    return flagged.groupBy("run_id", "template_id", "page_index").agg(
        F.count("*").alias("n_cells"),
        F.count_if((F.col("kind") == "rule") & errors).alias("n_errors"),
        F.count_if(F.array_contains("flags_now", OUTLIER)).alias("n_outliers"),
        F.count_if(G.needs_review(F.col("flags_now"), F.col("status"))).alias("n_unresolved"),
    )
