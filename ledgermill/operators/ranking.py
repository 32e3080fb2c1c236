"""Candidate ranking from the evidence of several models and image views.

Evidence is pre-aggregated to one support per cell, model, image and value before any
shuffle on the cell; all later steps work on a handful of values per cell.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgermill.functions import grammar as G
from ledgermill.session import stage

FLOOR, MARGIN, WEAK, AGREES, SURE = 0.01, 1.10, 0.5, 0.05, 0.90


def observations(evidence: DataFrame) -> DataFrame:
    """(cell_id, model, image_key, value, support): greatest support of each value in each view."""
    value = G.plain(F.col("value_text"))
    e = evidence.where("cell_id is not null and value_text is not null and support is not null").select("cell_id", "model", "image_key", value.alias("value"), "support")
    return e.where(F.col("value") != "").groupBy("cell_id", "model", "image_key", "value").agg(F.max("support").alias("support"))


def eligible(ocr_cells: DataFrame) -> DataFrame:
    """(cell_id, value, current): distinct candidates that are simple numbers, where the text is one of at least two."""
    plain = F.array_distinct(F.transform(F.concat(F.array("text"), F.coalesce("candidates", F.array().cast("array<string>"))), G.plain))
    values = F.filter(plain, lambda v: G.full(v, G.SIMPLE))
    df = ocr_cells.select("cell_id", G.plain(F.col("text")).alias("current"), values.alias("values"))
    return df.where(F.array_contains("values", F.col("current")) & (F.size("values") >= 2)).select("cell_id", "current", F.explode("values").alias("value"))


def is_split(image_key: Column) -> Column:
    return image_key.startswith("split-")


def model_scores(obs: DataFrame, candidates: DataFrame) -> DataFrame:
    """(cell_id, model, value, current, m): mean support over the model's distinct images; a missing value counts 0.

    A model's views of a cell are one short list, so the evidence is read and shuffled once.
    """
    views = obs.where(~is_split(F.col("image_key")))
    per = views.groupBy("cell_id", "model").agg(F.size(F.collect_set("image_key")).alias("n_images"), F.collect_list(F.struct("value", "support")).alias("said"))
    mine = F.aggregate(F.filter("said", lambda x: x["value"] == F.col("value")), F.lit(0.0), lambda a, x: a + x["support"])
    return per.join(candidates, "cell_id").select("cell_id", "model", "value", "current", F.round(mine / F.col("n_images"), 12).alias("m"))


def geometric(scores: DataFrame) -> DataFrame:
    """(cell_id, value, current, score, n_models, agreeing): geometric mean over models, floor 0.01."""
    w = Window.partitionBy("cell_id", "model")
    top, n_top = F.max("m").over(w), F.max(F.struct("m", "value")).over(w)
    ranked = scores.withColumn("best", top).withColumn("best_value", n_top["value"])
    second = F.max(F.when(F.col("value") != F.col("best_value"), F.col("m"))).over(w)
    ranked = ranked.withColumn("rival", F.coalesce(F.when(F.col("value") == F.col("best_value"), second).otherwise(F.col("best")), F.lit(0.0)))
    backs = (F.col("m") >= AGREES) & (F.col("m") >= MARGIN * F.col("rival"))
    return ranked.groupBy("cell_id", "value", "current").agg(
        F.round(F.exp(F.avg(F.log(F.greatest(F.lit(FLOOR), F.col("m"))))), 9).alias("score"), F.count("*").alias("n_models"), F.count_if(backs).alias("agreeing")
    )


def digit_support(digit_checks: DataFrame) -> DataFrame:
    """(cell_id, value, digit_support): greatest support of each checked text."""
    return digit_checks.where("cell_id is not null and text is not null").groupBy("cell_id", G.plain(F.col("text")).alias("value")).agg(F.max("support").alias("digit_support"))


def visible(obs: DataFrame, digit_checks: DataFrame) -> DataFrame:
    """(cell_id, separator, digits): what readings and checks say of a cell's ink.

    The separator is as sure as the best reading of a split view; the digits seen are those of
    the best supported check that is sure of them by 0.60. Either is null where nothing says so.
    """
    split = obs.where(is_split(F.col("image_key"))).groupBy("cell_id").agg(F.max("support").alias("separator"))
    sure = digit_checks.where("cell_id is not null and predicted is not null and support is not null and confidence >= 0.60")
    digits = sure.groupBy("cell_id").agg(F.length(F.max(F.struct("support", "predicted"))["predicted"]).alias("digits"))
    return split.join(digits, "cell_id", "full")


def missing_digits(value: Column, digits: Column) -> Column:
    """How many of the visible digits a value lacks."""
    return F.greatest(F.lit(0), F.coalesce(digits, F.lit(0)) - F.length(F.regexp_replace(value, r"(?U)\D", "")))


def rank(evidence: DataFrame, ocr_cells: DataFrame, digit_checks: DataFrame, seen: DataFrame | None = None) -> DataFrame:
    """One row per cell with at least two models: selected reading, margin and ranking flags.

    Ties go to the current reading, then to the value that sorts first. A winner replaces the
    current reading only by a margin of 1.10, and if it is weak only when corroborated by two
    models or by the digit check; a unique split reading of two models comes before that. With
    ``seen`` (cell_id, digits) a value counts a fifth for each visible digit that it lacks.
    """
    obs = observations(evidence)
    return ranked(obs, eligible(ocr_cells), digit_checks, obs.where(is_split(F.col("image_key"))), seen)


def lowered(scored: DataFrame, seen: DataFrame | None) -> DataFrame:
    """Scores times 0.20 for each visible digit that a value lacks."""
    if seen is None:
        return scored
    return scored.join(seen.select("cell_id", "digits"), "cell_id", "left").withColumn("score", F.round(F.col("score") * F.pow(F.lit(0.2), missing_digits(F.col("value"), F.col("digits"))), 9)).drop("digits")


def ranked(obs: DataFrame, candidates: DataFrame, digit_checks: DataFrame, split_readings: DataFrame, seen: DataFrame | None = None) -> DataFrame:
    """``rank`` on given candidates (cell_id, value, current) and split readings."""
    scored = lowered(geometric(model_scores(obs, candidates)).where("n_models >= 2"), seen)
    splits = split_readings.where(F.col("support") >= SURE).groupBy("cell_id", "value").agg(F.countDistinct("model").alias("votes"))
    scored = scored.join(digit_support(digit_checks), ["cell_id", "value"], "left").join(splits, ["cell_id", "value"], "left").na.fill({"digit_support": 0.0, "votes": 0})
    order = Window.partitionBy("cell_id").orderBy(F.desc("score"), F.col("value") != F.col("current"), "value")
    whole = Window.partitionBy("cell_id")
    df = scored.withColumn("place", F.row_number().over(order)).withColumn("next", F.lead("score").over(order))
    df = df.withColumn("top", F.max(F.when(F.col("place") == 1, F.col("score"))).over(whole)).withColumn("winner", F.max(F.when(F.col("place") == 1, F.col("value"))).over(whole))
    split_ok = (F.col("votes") >= 2) & (F.col("score") >= 0.5 * F.col("top")) & ((F.col("value") == F.col("winner")) | (F.col("digit_support") >= SURE))
    df = df.withColumn("n_split", F.count_if(split_ok).over(whole)).withColumn("split_value", F.max(F.when(split_ok, F.col("value"))).over(whole)).where("place = 1")
    margin = F.round(F.col("score") / F.greatest(F.lit(1e-12), F.coalesce("next", F.lit(0.0))), 9)
    backed = (F.col("agreeing") >= 2) | (F.col("digit_support") >= SURE)
    kept = F.when((margin >= MARGIN) & ((F.col("score") >= WEAK) | backed), F.col("winner")).otherwise(F.col("current"))
    chosen = F.when(F.col("n_split") == 1, F.col("split_value")).otherwise(kept)
    names = ((margin < MARGIN, "candidate_ranking_disagreement"), ((F.col("score") < WEAK) & ((F.col("winner") != F.col("current")) | ~backed | (margin < MARGIN)), "weak_sequence_evidence"), (F.col("n_split") == 1, "split_consensus_used"), (chosen != F.col("current"), "candidate_reranked"))
    return df.select("cell_id", "current", "winner", chosen.alias("selected"), "score", margin.alias("margin"), "agreeing", F.concat_ws(",", *(F.when(c, F.lit(n)) for c, n in names)).alias("flags"))


def vote(obs: DataFrame, weight: Column) -> DataFrame:
    """Per cell and value: weighted score, greatest support, distinct models and crops."""
    crop = F.substring_index("image_key", "-", 1)
    return obs.groupBy("cell_id", "value").agg(F.round(F.sum(weight * F.greatest(F.lit(0.1), F.col("support"))), 9).alias("score"), F.max("support").alias("confidence"), F.countDistinct("model").alias("n_models"), F.countDistinct(crop).alias("n_crops"))


def fast_vote(obs: DataFrame, weight: Column) -> DataFrame:
    """The fast vote's winner per cell and its next four readings: non-numbers count a fifth, a split reading lifts decimals by 2."""
    w = Window.partitionBy("cell_id")
    votes = obs.withColumn("split", is_split(F.col("image_key"))).withColumn("seen", F.max(F.col("split").cast("int")).over(w))
    sums = votes.groupBy("cell_id", "value", "seen").agg(F.sum(weight * F.greatest(F.lit(0.1), F.col("support"))).alias("s"), F.max("support").alias("confidence"))
    s = F.when(G.is_complex(F.col("value")), F.col("s")).otherwise(F.col("s") * 0.2) + F.when((F.col("seen") == 1) & G.full(F.col("value"), r"[+\-−]?\d+\.\d+"), 2.0).otherwise(0.0)
    sums = sums.withColumn("score", F.round(s, 9))
    order = w.orderBy(F.desc("score"), "value")
    ranked = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "value")).over(w)), lambda x: x["value"])  # a handful of values
    top = sums.withColumn("others", F.slice(ranked, 2, 4)).withColumn("n_values", F.count("*").over(w)).withColumn("place", F.row_number().over(order)).where("place = 1")
    flags = ((F.col("n_values") > 1, "model_disagreement"), (F.col("confidence") < 0.92, "low_confidence"), (~G.is_complex(F.col("value")), "invalid_numeric_format"), ((F.col("seen") == 1) & ~F.col("value").contains("."), "possible_missing_decimal"))
    return top.select("cell_id", "value", "score", "confidence", F.array_join("others", " | ").alias("alternatives"), F.concat_ws(",", *(F.when(c, F.lit(n)) for c, n in flags)).alias("flags"))


def cascade(obs: DataFrame, rules: DataFrame, weight: Column) -> DataFrame:
    """High-accuracy scores: each view's readings weighed by rank and relative support, if the rule allows them.

    ``rules`` is (cell_id, rule). Gives per cell the best value, its margin over the next,
    supporting models and crops, and the cascade's flags.
    """
    view = Window.partitionBy("cell_id", "model", "image_key").orderBy(F.desc("support"), "value")
    rival = F.max("support").over(Window.partitionBy("cell_id", "model", "image_key"))
    ranked = obs.withColumn("rank", F.row_number().over(view) - 1).withColumn("best", rival).where("rank < 6")
    beam = weight * 0.78 * (F.col("support") / F.greatest(F.lit(1e-12), F.col("best"))) / (1 + F.col("rank") * 0.20)
    own = F.when(F.col("rank") == 0, weight * F.greatest(F.lit(0.1), F.col("support"))).otherwise(F.lit(0.0))
    ranked = ranked.withColumn("share", F.greatest(own, beam)).join(rules, "cell_id").where(G.valid(F.col("value"), F.col("rule")))
    per = ranked.groupBy("cell_id", "value").agg(F.round(F.sum("share"), 9).alias("score"), F.max("support").alias("confidence"), F.countDistinct("model").alias("n_models"), F.countDistinct(F.substring_index("image_key", "-", 1)).alias("n_crops"))
    order = Window.partitionBy("cell_id").orderBy(F.desc("score"), "value")
    top = per.withColumn("place", F.row_number().over(order)).withColumn("next", F.lead("score").over(order)).where("place = 1")
    margin = F.col("score") / F.greatest(F.lit(1e-9), F.coalesce("next", F.lit(0.0)))
    flags = ((F.col("next").isNotNull() & (margin < 1.8), "model_disagreement"), ((F.col("next").isNotNull() & (margin < 1.25)) | (F.col("n_models") < 2), "unstable_consensus"), (F.col("confidence") < 0.92, "low_confidence"))
    return top.select("cell_id", "value", "score", "n_models", "n_crops", F.concat_ws(",", F.lit("numeric_verification_required"), *(F.when(c, F.lit(n)) for c, n in flags)).alias("flags"))


def split_readings(obs: DataFrame) -> DataFrame:
    """Each model's reading of a split cell, where it is digits on both sides of the separator."""
    own = Window.partitionBy("cell_id", "model").orderBy(F.desc("support"), "value", "image_key")
    tops = obs.where(is_split(F.col("image_key"))).withColumn("place", F.row_number().over(own)).where("place = 1").drop("place")
    return tops.where(G.full(F.col("value"), r"\d+\.\d+"))


def cascade_ranked(obs: DataFrame, rules: DataFrame, weight: Column, digit_checks: DataFrame, seen: DataFrame | None = None) -> DataFrame:
    """The whole cascade, then ranked: per cell the selected value, its score and flags.

    Views other than split ones score as in ``cascade``. Where a separator is seen
    (``seen.separator``), a reading of two to four digits also speaks for the value that the
    rule's places make of it (0.72 * weight * support), and values with a separator gain 1.25 *
    its confidence. A model's split reading adds 1.8 * weight * support. A value counts a fifth
    for each visible digit (``seen.digits``) that it lacks. The best supported check of a scored
    value adds 0.55 * support * confidence. The best value is then the current one of
    ``ranked``. Cells where no reading obeys the rule keep the fast vote. Without ``seen``
    nothing is known of separators and digits.
    """
    if seen is None:
        seen = obs.limit(0).select("cell_id", F.lit(None).cast("double").alias("separator"), F.lit(None).cast("int").alias("digits"))
    rows = obs.join(rules, "cell_id").withColumn("fits", G.valid(F.col("value"), F.col("rule"))).withColumn("places", F.coalesce("rule.decimal_places", F.lit(0)))
    short = ~is_split(F.col("image_key")) & G.full(F.col("value"), r"[0-9]{2,4}")
    obs = stage(rows.withColumn("proposal", F.when(short, G.decimal_proposal(F.col("value"), F.col("rule")))).drop("rule"), "cascade-readings")
    crop = F.substring_index("image_key", "-", 1)
    view = Window.partitionBy("cell_id", "model", "image_key")
    places = obs.where(~is_split(F.col("image_key"))).withColumn("rank", F.row_number().over(view.orderBy(F.desc("support"), "value")) - 1).withColumn("best", F.max("support").over(view)).where("rank < 6")
    beam = weight * 0.78 * (F.col("support") / F.greatest(F.lit(1e-12), F.col("best"))) / (1 + F.col("rank") * 0.20)
    own = F.when(F.col("rank") == 0, weight * F.greatest(F.lit(0.1), F.col("support"))).otherwise(F.lit(0.0))
    split = split_readings(obs).where("fits")
    kept = ["cell_id", "value", "model", "image_key", "support", "places"]
    shares = places.withColumn("share", F.greatest(own, beam)).where("fits").select(*kept, "share")
    proposed = places.where("rank = 0 and proposal is not null").join(seen.where("separator is not null").select("cell_id"), "cell_id", "left_semi")
    shares = shares.unionByName(proposed.withColumn("value", F.col("proposal")).select(*kept, (weight * F.greatest(F.lit(0.1), F.col("support")) * 0.72).alias("share")))
    shares = shares.unionByName(split.select(*kept, (weight * F.col("support") * 1.8).alias("share")))
    checks = digit_checks.where("cell_id is not null and text is not null and support is not null").groupBy("cell_id", G.plain(F.col("text")).alias("value"))
    checks = checks.agg(F.max(F.struct("support", F.coalesce("confidence", F.lit(0.0)).alias("confidence"))).alias("check"))
    per = shares.groupBy("cell_id", "value").agg(F.sum("share").alias("s"), F.max("support").alias("confidence"), F.countDistinct("model").alias("n_models"), F.countDistinct(crop).alias("n_crops"), F.max(crop == "retry").alias("retry"), F.max("places").alias("places"))
    per = per.join(checks, ["cell_id", "value"], "left").join(seen, "cell_id", "left").withColumn("missing", missing_digits(F.col("value"), F.col("digits")))
    marked = F.col("s") + F.when(F.col("value").contains("."), F.coalesce(1.25 * F.col("separator"), F.lit(0.0))).otherwise(F.lit(0.0))
    per = per.withColumn("score", F.round(marked * F.pow(F.lit(0.2), F.col("missing")) + F.coalesce(0.55 * F.col("check.support") * F.col("check.confidence"), F.lit(0.0)), 9))
    cell = Window.partitionBy("cell_id")
    per = per.withColumn("current", F.first("value").over(cell.orderBy(F.desc("score"), "value")))
    verified = F.max(F.when(F.col("check").isNotNull(), F.struct("check.support", "check.confidence", "value"))).over(cell)
    per = stage(per.withColumn("verified", verified).withColumn("counted", F.max(F.col("missing") > 0).over(cell)), "cascade-scores")
    simple = per.where(G.full(F.col("value"), G.SIMPLE)).select("cell_id", "value", "current")
    many = simple.withColumn("n", F.count("*").over(cell)).withColumn("held", F.max(F.col("value") == F.col("current")).over(cell)).where("n >= 2 and held").drop("n", "held")
    final = ranked(obs, many, digit_checks, split, seen).select("cell_id", "selected", F.col("flags").alias("ranking"))
    per = per.join(final, "cell_id", "left").withColumn("selected", F.coalesce("selected", "current"))
    top = per.withColumn("next", F.max(F.when(F.col("value") != F.col("selected"), F.col("score"))).over(cell)).where("value = selected")
    margin, sure = F.col("score") / F.greatest(F.lit(1e-9), F.col("next")), F.col("verified.confidence") >= 0.70
    names = (
        (F.col("retry"), "crop_retry_contributed"), (F.col("separator").isNotNull(), "decimal_separator_detected"), (F.col("separator").isNull() & (F.col("places") > 0), "separator_not_visually_confirmed"), (F.col("counted"), "visible_digit_count_used"),
        (margin < 1.8, "model_disagreement"), ((F.col("n_models") < 2) | (margin < 1.25), "unstable_consensus"),
        (sure & (F.col("verified.value") == F.col("value")), "digit_verifier_agrees"), (sure & (F.col("verified.value") != F.col("value")), "digit_verifier_disagreement"), (F.col("confidence") < 0.92, "low_confidence"),
    )
    always = F.lit("numeric_verification_required,high_accuracy_consensus,multistage_cascade")
    flags = F.concat_ws(",", always, F.when(F.col("ranking") != "", F.col("ranking")), *(F.when(c, F.lit(n)) for c, n in names))
    found = top.select("cell_id", "value", "score", "n_models", "n_crops", flags.alias("flags"))
    rest = fast_vote(obs.join(per.select("cell_id"), "cell_id", "left_anti"), weight)
    none = F.lit(None).cast("long")
    return found.unionByName(rest.select("cell_id", "value", "score", none.alias("n_models"), none.alias("n_crops"), F.concat_ws(",", F.when(F.col("flags") != "", F.col("flags")), F.lit("high_accuracy_no_consensus")).alias("flags")))


def close_digits(scored: DataFrame) -> DataFrame:
    """Cells whose two best values have one length and differ in one digit, at a ratio under 1.10."""
    order = Window.partitionBy("cell_id").orderBy(F.desc("score"), "value")
    top = scored.withColumn("place", F.row_number().over(order)).withColumn("second", F.lead("value").over(order)).withColumn("next", F.lead("score").over(order)).where("place = 1 and second is not null")
    same = F.length("value") == F.length("second")
    at = F.filter(F.transform(F.sequence(F.lit(1), F.length("value")), lambda i: F.when(F.substring(F.col("value"), i, F.lit(1)) != F.substring(F.col("second"), i, F.lit(1)), i)), lambda i: i.isNotNull())
    df = top.where(same & (F.col("score") / F.greatest(F.lit(1e-12), F.col("next")) < MARGIN)).withColumn("at", at).where("size(at) = 1")
    place = F.get("at", F.lit(0))
    digit = lambda c: F.substring(F.col(c), place, F.lit(1)).rlike("[0-9]")
    return df.where(digit("value") & digit("second")).select("cell_id", F.col("value").alias("first"), "second", place.alias("position"), "current")


def settled_digits(ties: DataFrame, glyphs: DataFrame) -> DataFrame:
    """(cell_id, selected, flags): close ties decided by three readings of the one digit that differs.

    ``glyphs`` is (cell_id, text, confidence), one row per model. The readings must agree on
    one of the two digits, with confidences of at least 0.25, 0.50 and 0.90 in rising order;
    else the current value stays and the disagreement is flagged. Cells without three readings,
    or whose current value is neither of the two, are left alone and give no row.
    """
    per = glyphs.where("cell_id is not null").groupBy("cell_id").agg(F.array_sort(F.collect_list(F.coalesce("confidence", F.lit(0.0)))).alias("sure"), F.collect_set("text").alias("texts"), F.count("*").alias("n"))
    df = ties.where("current in (first, second)").join(per.where("n = 3"), "cell_id")
    digit = lambda c: F.substring(F.col(c), F.col("position"), F.lit(1))
    said = F.get("texts", F.lit(0))
    enough = (F.get("sure", F.lit(0)) >= 0.25) & (F.get("sure", F.lit(1)) >= 0.5) & (F.get("sure", F.lit(2)) >= SURE)
    agreed = (F.size("texts") == 1) & said.isin(digit("first"), digit("second")) & enough
    chosen = F.when(agreed, F.when(digit("first") == said, F.col("first")).otherwise(F.col("second"))).otherwise(F.col("current"))
    flags = F.when(agreed, F.concat(F.lit("isolated_digit_consensus"), F.when(chosen != F.col("current"), ",candidate_reranked").otherwise(""))).otherwise("isolated_digit_disagreement")
    return df.select("cell_id", chosen.alias("selected"), flags.alias("flags"))


def adaptive(obs: DataFrame, rules: DataFrame, seen: DataFrame | None = None, models: Sequence[str] = (), sure: float = 0.95, ratio: float = 10.0, least: int = 4) -> DataFrame:
    """(cell_id, pass): short where at least ``least`` readings of base views agree surely and obey the rule, else full.

    ``models`` are those of the short pass (all, where none are named). In none of the views another value may have more than a ``ratio``-th of the best one's support.
    With ``seen``, a value with decimals needs a separator seen at 0.70, and the digits seen
    must be as many as it has.
    """
    base = obs.where(F.col("image_key").startswith("base-"))
    base = base.where(F.col("model").isin(*models)) if models else base
    best = base.groupBy("cell_id", "model", "image_key").agg(F.max(F.struct("support", "value")).alias("top"), F.array_sort(F.collect_list("support")).alias("all"))
    rival = F.coalesce(F.try_element_at("all", F.lit(-2)), F.lit(0.0)) * ratio > F.col("top.support")
    per = best.groupBy("cell_id").agg(F.count("*").alias("n"), F.countDistinct("top.value").alias("n_values"), F.min("top.value").alias("value"), F.min("top.support").alias("least"), F.max(rival).alias("rivalled"))
    ok = (F.col("n") >= least) & (F.col("n_values") == 1) & (F.col("least") >= sure) & ~F.col("rivalled") & G.full(F.col("value"), r"\d+(?:\.\d+)?") & G.valid(F.col("value"), F.col("rule")) & (F.size(G.warnings(F.col("value"), F.col("rule"))) == 0)
    df = per.join(rules, "cell_id")
    if seen is not None:
        df = df.join(seen, "cell_id", "left")
        ok = ok & (~F.col("value").contains(".") | (F.coalesce("separator", F.lit(0.0)) >= 0.7)) & (F.col("digits").isNull() | (F.col("digits") == F.length(F.regexp_replace("value", r"(?U)\D", ""))))
    return df.select("cell_id", F.when(ok & F.col("rule.value_format").isin("numeric", "integer"), "short").otherwise("full").alias("pass"))


def joint_support(digit_checks: DataFrame) -> DataFrame:
    """Geometric mean of a cell's digit confidences, floor 1e-9; rows delivered twice count once."""
    d = digit_checks.select("check_id", "cell_id", "confidence").distinct().where("cell_id is not null and confidence is not null")
    return d.groupBy("cell_id").agg(F.round(F.exp(F.avg(F.log(F.greatest(F.lit(1e-9), F.col("confidence"))))), 9).alias("joint_support"))
