"""Two verification models against the baseline reading: routing and agreement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgermill.functions import grammar as G
from ledgermill.session import stage


def eligible(flagged: DataFrame) -> DataFrame:
    """Numeric data cells that need review for another reason than the adaptive pass alone."""
    flags = F.filter("flags_now", lambda f: f != "adaptive_review_required")
    return flagged.where(
        G.needs_review(flags, F.col("status")) & ~F.col("excluded") & F.col("fixed").isNull()
        & (F.col("cell_row") >= F.col("header_rows")) & (F.col("cell_column") >= F.col("row_label_columns"))
        & (F.col("own.role") != "ignored") & F.col("rule.value_format").isin("numeric", "integer")
    )


def answers(evidence: DataFrame, model: str, name: str) -> DataFrame:
    """(cell_id, name): the model's reading of greatest support."""
    rows = evidence.where((F.col("model") == model) & F.col("cell_id").isNotNull() & F.col("value_text").isNotNull())
    return rows.groupBy("cell_id").agg(F.max(F.struct("support", "value_text")).alias("top")).select("cell_id", F.col("top.value_text").alias(name))


def unwrapped(text: Column) -> Column:
    """A model's answer without code fences, math brackets and decoration."""
    t = G.strip(text)
    t = F.when(t.rlike(r"(?s)\A```.*```\z"), G.strip(F.regexp_replace(F.regexp_replace(t, r"\A```(?:text|json)?\s*", ""), r"```\z", ""))).otherwise(t)
    t = G.strip(F.regexp_replace(t, r"(?s)\A\\\((.*)\\\)\z", "$1"))
    t = G.strip(F.regexp_replace(t, r"(?s)\A\\\[(.*)\\\]\z", "$1"))
    return G.strip(F.regexp_replace(t, r"\A[|$`* ]+|[|$`* ]+\z", ""))


def reading(value: Column, rule: Column) -> Column:
    """The answer under the rule, or null where it is no number or breaks a hard limit.

    An answer that breaks the rule counts as the one proposal that obeys it, if there is just
    one; this is what constraining a reading without other candidates comes to.
    """

    def allowed(t: Column) -> Column:
        proposals = F.struct(G.separator_reclassification(t, rule).alias("moved"), G.decimal_proposal(t, rule).alias("put"))
        one = G.let(proposals, lambda p: F.when(p["moved"].isNull(), p["put"]).when(p["put"].isNull() | (p["put"] == p["moved"]), p["moved"]))
        return F.when((t != "") & G.valid(t, rule), t).when(t != "", one)

    plain = G.let(unwrapped(value), lambda t: F.when(rule["value_format"].isin(*G.NUMERIC_FORMATS), G.canonical_numeric(t)).otherwise(t))
    return G.let(F.when(value.isNotNull(), G.let(plain, allowed)), lambda t: F.when(G.numeric_identity(t).isNotNull(), t))


def agree(cells: DataFrame, first: DataFrame, second: DataFrame) -> DataFrame:
    """Outcome per eligible cell; the text changes only where both models agree against the baseline."""
    df = cells.select("cell_id", F.col("c.text").alias("baseline"), F.col("c.alternative").alias("alternative"), "rule").join(first, "cell_id", "left").join(second, "cell_id", "left")
    df = df.withColumn("a", reading(F.col("first"), F.col("rule"))).withColumn("b", reading(F.col("second"), F.col("rule")))
    # Written once: the answers under the rule are dear, and each is looked at several times.
    df = stage(df.select("cell_id", "baseline", "alternative", "a", "b"), "agreement")
    df = df.select("cell_id", "baseline", "alternative", "a", "b", G.numeric_identity(F.col("baseline")).alias("n0"), G.numeric_identity(F.col("a")).alias("na"), G.numeric_identity(F.col("b")).alias("nb"))
    same = lambda x, y: F.col(x).eqNullSafe(F.col(y))
    outcome = F.when(F.col("a").isNull(), "first_unavailable").when(F.col("b").isNull() & same("na", "n0"), "baseline_supported").when(F.col("b").isNull(), "second_unavailable")
    outcome = outcome.when(~same("na", "nb"), "disagreement").when(same("na", "n0"), "agreed_unchanged").otherwise("changed")
    df = df.withColumn("outcome", outcome)
    changed = F.col("outcome") == "changed"
    more = F.array_join(F.filter(F.array_distinct(F.concat(F.array("baseline"), F.split("alternative", r" \| "), F.array("a"))), lambda v: v != ""), " | ")
    return df.select("cell_id", "outcome", F.when(changed, F.col("a")).otherwise(F.col("baseline")).alias("final_text"), F.when(changed, more).otherwise(F.col("alternative")).alias("alternative"))


def answer_ids(requests: DataFrame, answers: DataFrame) -> DataFrame:
    """(cell_id, problem): answers must name exactly the requested cells, each once."""
    counted = answers.groupBy("cell_id").agg(F.count("*").alias("n"))
    df = requests.select("cell_id").distinct().withColumn("asked", F.lit(True)).join(counted, "cell_id", "full")
    problem = F.when(F.col("asked").isNull(), "not_asked").when(F.col("n").isNull(), "missing").when(F.col("n") > 1, "twice")
    return df.select("cell_id", problem.alias("problem")).where("problem is not null")
