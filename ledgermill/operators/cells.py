"""Cells against their template: rule resolution, exclusions, labels and headers.

A template is one row with its rules as arrays, so cells meet all their rules in one
equi-join on the template id and are resolved inside the row; there is no range join and
no expansion by rules. Spark broadcasts templates while they are small and otherwise
sort-merges, where adaptive execution splits a hot template.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgermill.functions import grammar as G
from ledgermill.session import stage

NONE = "array<string>"


def with_template(cells: DataFrame, templates: DataFrame) -> DataFrame:
    """Cells with ``t``, the struct of what their template says; cells without a template are dropped."""
    t = templates.select(
        F.col("id").alias("template_id"),
        F.struct(
            "name", "template_version", "header_rows", "row_label_columns", "column_rules", "cell_rules", "fixed_cells", "excluded_rows", "excluded_columns", "excluded_cells",
            F.greatest(F.lit(0), F.size("row_guides") - 1).alias("rows"), F.greatest(F.lit(0), F.size("column_guides") - 1).alias("columns"),
        ).alias("t"),
    )
    return cells.join(t, "template_id")


def region_area(r: Column) -> Column:
    return (r["row_end"] - r["row_start"] + 1) * (r["column_end"] - r["column_start"] + 1)


def column_rule(t: Column, column: Column) -> Column:
    """The column's rule, or the default one of a column without."""
    role = F.when(column < t["row_label_columns"], "row_label").otherwise("data")
    rule = F.get(t["column_rules"], column)
    default = {"value_format": F.lit("complex_numeric"), "allow_empty": F.lit(True), "prefer_expected_range": F.lit(False), "require_decimal": F.lit(False), "suggest_missing_decimal": F.lit(False)}
    fields = [F.coalesce(rule[c], default[c]).alias(c) if c in default else rule[c].alias(c) for c in G.RULE_FIELDS]
    return F.struct(F.coalesce(rule["name"], F.concat(F.lit("Column "), (column + 1).cast("string"))).alias("name"), F.coalesce(rule["role"], role).alias("role"), F.struct(*fields).alias("rule"))


def resolve(df: DataFrame, row: str = "cell_row", column: str = "cell_column") -> DataFrame:
    """Adds own (column rule), region (most specific region or null), rule, rule_name, fixed and the cell's kind.

    The smallest region that holds the cell wins, among equal ones the last; without one
    the column rule holds. ``kind``: excluded, fixed, rule or none, in this precedence.
    """
    t, r, c = F.col("t"), F.col(row), F.col(column)
    holds = lambda x: (x["row_start"] <= r) & (r <= x["row_end"]) & (x["column_start"] <= c) & (c <= x["column_end"])
    numbered = F.transform(t["cell_rules"], lambda x, i: F.struct(region_area(x).alias("area"), (-i).alias("back"), x.alias("region")))
    df = df.withColumn("own", column_rule(t, c)).withColumn("region", F.array_min(F.filter(numbered, lambda x: holds(x["region"])))["region"])
    constraints = F.struct(*(F.col("region.constraints")[f].alias(f) for f in G.RULE_FIELDS))
    explicit = F.col("region").isNotNull()
    df = df.withColumn("rule", F.when(explicit, constraints).otherwise(F.col("own.rule")))
    df = df.withColumn("rule_name", F.when(explicit, F.concat(F.col("region.name"), F.lit(" · "), G.rect_address(F.col("region")))).otherwise(F.col("own.name")))
    at = lambda x: (x["cell_row"] == r) & (x["cell_column"] == c)
    df = df.withColumn("fixed", F.get(F.filter(t["fixed_cells"], at), F.lit(0))["fixed_text"])
    return df.withColumn("excluded", is_excluded(t, r, c, F.col("own"), F.col("fixed"))).withColumn("is_header", is_header(t, r, F.col("own"), F.col("region"))).withColumn("is_label", (c < t["row_label_columns"]) | (F.col("own.role") == "row_label")).withColumn(
        "kind",
        F.when(F.col("excluded"), "excluded").when(F.col("fixed").isNotNull(), "fixed").when(explicit, "rule").when(F.col("is_header") | F.col("is_label") | (F.col("own.role") == "ignored"), "none").otherwise("rule"),
    )


def is_excluded(t: Column, r: Column, c: Column, own: Column, fixed: Column) -> Column:
    """Excluded row, column or cell, or an ignored column without a fixed value here."""
    inside = lambda xs, v: F.coalesce(F.array_contains(xs, v), F.lit(False))
    single = F.coalesce(F.exists(t["excluded_cells"], lambda x: (x["cell_row"] == r) & (x["cell_column"] == c)), F.lit(False))
    return inside(t["excluded_rows"], r) | inside(t["excluded_columns"], c) | single | ((own["role"] == "ignored") & fixed.isNull())


def is_header(t: Column, r: Column, own: Column, region: Column) -> Column:
    """A header position, unless a region makes it a number."""
    numeric = F.coalesce(region["constraints"]["value_format"].isin(*G.NUMERIC_FORMATS), F.lit(False))
    return ((r < t["header_rows"]) | (own["role"] == "header")) & ~numeric


def readings(ocr_cells: DataFrame, templates: DataFrame) -> DataFrame:
    """Resolved cells with the constrained reading ``c`` of cells that a rule governs.

    Written once: checks, review and export each read it, some of them twice.
    """
    keep = ["cell_id", "run_id", "template_id", "page_index", "cell_row", "cell_column", "text", "raw_text", "confidence", "candidates", "candidate_confidences", "flags"]
    df = resolve(with_template(ocr_cells.select(*keep), templates))
    fixed = F.col("kind") == "fixed"
    df = df.withColumn(
        "c",
        F.when(F.col("kind") == "rule", G.constrain(F.col("text"), F.col("candidates"), F.col("candidate_confidences"), F.col("confidence"), F.col("flags"), F.col("rule"))).otherwise(
            F.struct(
                F.when(fixed, F.col("fixed")).when(F.col("kind") == "excluded", "").otherwise(F.coalesce("text", F.lit(""))).alias("text"),
                F.when(fixed | (F.col("kind") == "excluded"), F.lit(1.0)).otherwise(F.col("confidence")).alias("confidence"),
                F.when(fixed, F.array(F.lit("template_fixed_value"))).when(F.col("kind") == "excluded", F.array(F.lit("excluded_before_analysis"))).otherwise(F.array_sort(F.array_distinct(F.coalesce("flags", F.array().cast(NONE))))).alias("flags"),
                F.array_join(F.filter(F.coalesce("candidates", F.array().cast(NONE)), lambda v: v != F.col("text")), " | ").alias("alternative"),
            )
        ),
    ).withColumn("status", F.when(F.col("kind") == "excluded", "excluded").when(fixed, "confirmed").otherwise("automatic"))
    of_template = [F.col(f"t.{c}").alias(a) for c, a in (("name", "template_name"), ("template_version", "template_version"), ("header_rows", "header_rows"), ("row_label_columns", "row_label_columns"), ("rows", "n_rows"), ("columns", "n_columns"))]
    kept = ["cell_id", "run_id", "template_id", "page_index", "cell_row", "cell_column", "raw_text", "own", "rule", "rule_name", "fixed", "excluded", "is_header", "is_label", "kind", "c", "status"]
    return stage(df.select(*kept, *of_template), "cell-readings")


def grid(templates: DataFrame) -> DataFrame:
    """Every (template, row, column) of every grid, with ``t``."""
    ids = templates.select(F.col("id").alias("template_id"))
    df = with_template(ids, templates)
    df = df.where((F.col("t.rows") > 0) & (F.col("t.columns") > 0))
    df = df.withColumn("cell_row", F.explode(F.sequence(F.lit(0), F.col("t.rows") - 1)))
    return df.withColumn("cell_column", F.explode(F.sequence(F.lit(0), F.col("t.columns") - 1)))


def overlapping_rules(templates: DataFrame) -> DataFrame:
    """Pairs of regions of one template that overlap at equal area, in other places, with other constraints.

    Regions of one template are compared inside its row; there is no self-join.
    """
    rules = F.transform("cell_rules", lambda x, i: F.struct(i.alias("i"), x.alias("r")))
    apart = lambda a, b: (a["row_end"] < b["row_start"]) | (b["row_end"] < a["row_start"]) | (a["column_end"] < b["column_start"]) | (b["column_end"] < a["column_start"])
    same = lambda a, b: (a["row_start"] == b["row_start"]) & (a["row_end"] == b["row_end"]) & (a["column_start"] == b["column_start"]) & (a["column_end"] == b["column_end"])
    pairs = F.flatten(
        F.transform(
            F.col("rules"),
            lambda a: F.transform(
                F.filter(
                    F.col("rules"),
                    lambda b: (a["i"] < b["i"]) & ~apart(a["r"], b["r"]) & (region_area(a["r"]) == region_area(b["r"])) & ~same(a["r"], b["r"]) & ~a["r"]["constraints"].eqNullSafe(b["r"]["constraints"]),
                ),
                lambda b: F.struct(a["r"]["id"].alias("left_id"), b["r"]["id"].alias("right_id")),
            ),
        )
    )
    return templates.select(F.col("id").alias("template_id"), rules.alias("rules")).select("template_id", F.inline(pairs))


def template_problems(templates: DataFrame) -> DataFrame:
    """(template_id, problems): what keeps a template from being used, all of it, in a fixed order.

    Excluded axes and cells and fixed cells must lie inside the grid, each once, fixed cells
    with a text; rules must not contradict themselves; regions must lie inside the grid and no
    two overlapping ones of equal area may say different things.
    """
    rows, columns = F.greatest(F.lit(0), F.size("row_guides") - 1), F.greatest(F.lit(0), F.size("column_guides") - 1)
    twice = lambda xs: F.size(F.array_distinct(xs)) < F.size(xs)
    outside = lambda xs, n: F.exists(xs, lambda i: i.isNull() | (i < 0) | (i >= n)) | twice(xs)
    place = lambda xs: F.transform(xs, lambda x: F.struct(x["cell_row"], x["cell_column"]))
    off = lambda xs: F.exists(xs, lambda x: x["cell_row"].isNull() | x["cell_column"].isNull() | (x["cell_row"] < 0) | (x["cell_row"] >= rows) | (x["cell_column"] < 0) | (x["cell_column"] >= columns)) | twice(place(xs))
    whole = lambda r: (r["row_start"] >= 0) & (r["row_start"] <= r["row_end"]) & (r["row_end"] < rows) & (r["column_start"] >= 0) & (r["column_start"] <= r["column_end"]) & (r["column_end"] < columns)
    broken = lambda r: F.size(G.rule_errors(r)) > 0
    conflicts = overlapping_rules(templates).select("template_id").distinct().withColumn("conflict", F.lit(True))
    df = templates.withColumn("template_id", F.col("id")).join(conflicts, "template_id", "left")
    checks = (
        (outside(F.col("excluded_rows"), rows) | outside(F.col("excluded_columns"), columns), "exclusions_outside_grid"), (off(F.col("excluded_cells")), "excluded_cells_invalid"),
        (off(F.col("fixed_cells")) | F.exists("fixed_cells", lambda x: x["fixed_text"].isNull()), "fixed_cells_invalid"), (F.exists("column_rules", broken), "column_rule_invalid"),
        (F.exists("cell_rules", lambda r: ~F.coalesce(whole(r), F.lit(False))), "region_outside_grid"), (F.exists("cell_rules", lambda r: broken(r["constraints"])), "region_rule_invalid"), (F.col("conflict"), "regions_conflict"),
    )
    return df.select("template_id", F.array_compact(F.array(*(F.when(c, F.lit(n)) for c, n in checks))).alias("problems"))


def resize(templates: DataFrame, rows: Column, columns: Column) -> DataFrame:
    """Regions after the grid got ``rows`` x ``columns``: those at the old edge follow it, cut ones are clipped."""
    old_rows, old_columns = F.size("row_guides") - 1, F.size("column_guides") - 1
    follow = lambda start, end, old, new: F.when((start >= 0) & (start < new) & (((old != new) & (end == old - 1)) | (end >= new)), new - 1).otherwise(end)
    r = F.col("r")
    df = templates.select(F.col("id").alias("template_id"), old_rows.alias("old_rows"), old_columns.alias("old_columns"), rows.alias("new_rows"), columns.alias("new_columns"), F.explode("cell_rules").alias("r"))
    return df.select(
        "template_id",
        r["id"].alias("rule_id"),
        r["row_start"].alias("row_start"),
        follow(r["row_start"], r["row_end"], F.col("old_rows"), F.col("new_rows")).alias("row_end"),
        r["column_start"].alias("column_start"),
        follow(r["column_start"], r["column_end"], F.col("old_columns"), F.col("new_columns")).alias("column_end"),
    )
