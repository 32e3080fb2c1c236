"""Review: navigation, confirmation, reversible exclusion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgermill.functions import grammar as G
from ledgermill.operators.checks import flag_outliers


def next_uncertain(flagged: DataFrame) -> DataFrame:
    """Per cell the next cell of its run that needs review, cyclic in page, row, column order.

    The window covers one run (a document's cells). Null where nothing in the run needs review.
    """
    order = Window.partitionBy("run_id").orderBy("page_index", "cell_row", "cell_column", "cell_id")
    open_id = F.when(G.needs_review(F.col("flags_now"), F.col("status")), F.col("cell_id"))
    after = F.first(open_id, ignorenulls=True).over(order.rowsBetween(1, Window.unboundedFollowing))
    around = F.first(open_id, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return flagged.select("cell_id", F.coalesce(after, around).alias("next_cell_id"))


def confirmable(flagged: DataFrame) -> DataFrame:
    """Per run: cells that need review and obey their rule, and those that a hard limit blocks."""
    todo = flagged.where(G.needs_review(F.col("flags_now"), F.col("status")))
    blocked = (F.col("kind") == "rule") & ~G.valid(F.col("c.text"), F.col("rule"))
    return todo.groupBy("run_id").agg(F.count_if(~blocked).alias("n_confirmable"), F.count_if(blocked).alias("n_blocked"))


def uncertain_rows(flagged: DataFrame) -> DataFrame:
    """Rows of a page to show when only uncertain cells are wanted."""
    return flagged.where(G.needs_review(F.col("flags_now"), F.col("status"))).select("run_id", "template_id", "page_index", "cell_row").distinct()


def confirm(cells: DataFrame, edits: DataFrame) -> DataFrame:
    """Cells after the edits (cell_id, value): confirmed where the value is the raw text, else corrected.

    Excluded cells take no edit; the last edit of a cell in sort order counts.
    """
    one = edits.where("cell_id is not null and value is not null").groupBy("cell_id").agg(F.max("value").alias("value"))
    df = cells.join(one, "cell_id", "left")
    edited = F.col("value").isNotNull() & (F.col("status") != "excluded")
    text = F.when(edited, G.strip(F.col("value"))).otherwise(F.col("c.text"))
    status = F.when(edited, F.when(G.strip(F.col("value")) == F.coalesce("raw_text", F.lit("")), "confirmed").otherwise("corrected")).otherwise(F.col("status"))
    return df.select(*[c for c in cells.columns if c not in ("status",)], text.alias("final_text"), status.alias("status"))


def confirm_all(flagged: DataFrame) -> DataFrame:
    """Cells with every open value that obeys its rule confirmed as it is; blocked ones stay open."""
    todo = G.needs_review(F.col("flags_now"), F.col("status"))
    free = ~((F.col("kind") == "rule") & ~G.valid(F.col("c.text"), F.col("rule")))
    return flagged.withColumn("status", F.when(todo & free, "confirmed").otherwise(F.col("status")))


def rechecked(cells: DataFrame, edits: DataFrame, comparable: Column | None = None) -> DataFrame:
    """Flagged cells after edits (cell_id, value): texts and status as in ``confirm``, outliers of the touched pages anew.

    ``cells`` are flagged (``flags_now``); pages without an edit keep their flags and are not
    computed again.
    """
    edited = confirm(cells, edits)
    page = ["run_id", "template_id", "page_index"]
    touched = edits.select("cell_id").distinct().join(cells.select("cell_id", *page), "cell_id").select(*page).distinct()
    columns = [c for c in cells.columns if c not in ("flags_now",)]
    new = edited.withColumn("c", F.struct(F.col("final_text").alias("text"), *(F.col(f"c.{x}").alias(x) for x in ("confidence", "flags", "alternative"))))
    again = flag_outliers(new.join(touched, page, "left_semi").select(*columns), comparable)
    same = cells.join(touched, page, "left_anti")
    return again.unionByName(same.select(*again.columns))


def exclude(final: Column, status: Column, suggested: Column, out: Column) -> tuple[Column, Column, Column, Column]:
    """(final_text, status, suggested_text, backup) after an axis was excluded where ``out`` holds."""
    newly = out & (status != "excluded")
    backup = F.when(newly, F.struct(final.alias("final_text"), status.alias("status"), suggested.alias("suggested_text")))
    return F.when(newly, "").otherwise(final), F.when(newly, "excluded").otherwise(status), F.when(newly, final).otherwise(suggested), backup


def restore(final: Column, status: Column, suggested: Column, raw: Column, backup: Column, back: Column) -> tuple[Column, Column, Column]:
    """(final_text, status, suggested_text) after an exclusion was lifted; without a backup the suggestion or raw text."""
    mine = back & (status == "excluded")
    older = F.coalesce(F.nullif(suggested, F.lit("")), raw)
    pick = lambda name, without, as_is: F.when(mine & backup.isNotNull(), backup[name]).when(mine, without).otherwise(as_is)
    return pick("final_text", older, final), pick("status", F.lit("automatic"), status), pick("suggested_text", suggested, suggested)
