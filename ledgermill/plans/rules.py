"""Queries over value rules, resolved cells, exclusions, checks and review."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgermill.functions import grammar as G
from ledgermill.operators import cells as C
from ledgermill.operators import checks as K
from ledgermill.plans import sqltext as S
from ledgermill.plans.common import query, table

NON_BLOCKING = ", ".join(f"'{f}'" for f in G.NON_BLOCKING)


def _resolved(spark, sf):
    return C.resolve(C.with_template(table(spark, sf, "ocr_cells"), table(spark, sf, "templates")))


def _readings(spark, sf):
    return C.readings(table(spark, sf, "ocr_cells"), table(spark, sf, "templates"))


def _flagged(spark, sf):
    return K.flag_outliers(_readings(spark, sf))


@query(f"WITH {S.resolved()} SELECT cell_id, rule_name, region IS NOT NULL AS explicit FROM resolved")
def rule_most_specific(spark, sf):
    return _resolved(spark, sf).select("cell_id", "rule_name", F.col("region").isNotNull().alias("explicit"))


@query(f"WITH {S.resolved()} SELECT cell_id, kind, is_header, is_label, CASE kind WHEN 'excluded' THEN 'Excluded before analysis' WHEN 'fixed' THEN 'Value from template' ELSE rule_name END AS governed_by FROM resolved")
def rule_effective(spark, sf):
    named = F.when(F.col("kind") == "excluded", "Excluded before analysis").when(F.col("kind") == "fixed", "Value from template").otherwise(F.col("rule_name"))
    return _resolved(spark, sf).select("cell_id", "kind", "is_header", "is_label", named.alias("governed_by"))


@query(f"WITH {S.resolved()} SELECT cell_id, array_to_string({S.errors('text', 'rule')}, ',') AS errors, array_to_string({S.warnings('text', 'rule')}, ',') AS warnings FROM resolved")
def rule_hard_errors(spark, sf):
    return _resolved(spark, sf).select("cell_id", F.array_join(G.hard_errors(F.col("text"), F.col("rule")), ",").alias("errors"), F.array_join(G.warnings(F.col("text"), F.col("rule")), ",").alias("warnings"))


@query(f"""WITH {S.resolved()}, said AS (SELECT e.evidence_id, e.value_text, r.rule FROM (SELECT DISTINCT evidence_id, cell_id, value_text FROM evidence) e JOIN resolved r USING (cell_id))
SELECT evidence_id, {S.proposal('value_text', 'rule')} AS inserted, {S.reclassified('value_text', 'rule')} AS reclassified FROM said""")
def rule_proposals(spark, sf):
    said = table(spark, sf, "evidence").select("evidence_id", "cell_id", "value_text").distinct()
    rules = _resolved(spark, sf).select("cell_id", "rule")
    return said.join(rules, "cell_id").select("evidence_id", G.decimal_proposal(F.col("value_text"), F.col("rule")).alias("inserted"), G.separator_reclassification(F.col("value_text"), F.col("rule")).alias("reclassified"))


@query(f"WITH {S.constrained()} SELECT cell_id, c_text AS final_text, c_confidence AS confidence, array_to_string(c_flags, ',') AS flags, c_alternative AS alternative, status FROM readings")
def rule_constrain_reading(spark, sf):
    return _readings(spark, sf).select("cell_id", F.col("c.text").alias("final_text"), F.col("c.confidence").alias("confidence"), F.array_join("c.flags", ",").alias("flags"), F.col("c.alternative").alias("alternative"), "status")


_RULES = "rules AS (SELECT id AS template_id, 'column' AS scope, generate_subscripts(column_rules, 1) - 1 AS seq, unnest(column_rules) AS x FROM templates), regions AS (SELECT id AS template_id, 'cell' AS scope, generate_subscripts(cell_rules, 1) - 1 AS seq, unnest(cell_rules) AS y FROM templates), all_rules AS (SELECT template_id, scope, seq, {" + ", ".join(f"'{f}': x.{f}" for f in S.FIELDS) + "} AS r FROM rules UNION ALL SELECT template_id, scope, seq, {" + ", ".join(f"'{f}': y.constraints.{f}" for f in S.FIELDS) + "} AS r FROM regions)"
_VALID = S.flags(
    ("coalesce(r.value_format NOT IN ('complex_numeric', 'numeric', 'integer', 'text', 'date'), true)", "unknown_format"),
    ("NOT (isfinite(coalesce(r.minimum, 0)) AND isfinite(coalesce(r.maximum, 0)) AND isfinite(coalesce(r.expected_minimum, 0)) AND isfinite(coalesce(r.expected_maximum, 0)))", "bound_not_finite"),
    ("r.minimum > r.maximum OR r.expected_minimum > r.expected_maximum", "bounds_reversed"),
    ("r.decimal_places NOT BETWEEN 0 AND 8", "decimal_places_out_of_range"),
    ("r.value_format = 'integer' AND r.decimal_places <> 0", "integer_with_decimal_places"),
    ("r.require_decimal AND r.value_format <> 'numeric'", "decimal_part_needs_numeric"),
    ("r.require_decimal AND r.decimal_places = 0", "decimal_part_needs_places"),
    ("r.value_format NOT IN ('integer', 'numeric') AND (r.decimal_places IS NOT NULL OR coalesce(r.suggest_missing_decimal, false))", "places_need_simple_number"),
    ("r.suggest_missing_decimal AND coalesce(r.decimal_places, 0) = 0", "suggestion_needs_places"),
    ("r.prefer_expected_range AND r.expected_minimum IS NULL AND r.expected_maximum IS NULL", "preference_needs_expected_range"),
    ("r.value_format IN ('text', 'date') AND coalesce(r.minimum, r.maximum, r.expected_minimum, r.expected_maximum) IS NOT NULL", "range_on_text"),
    (f"len(r.allowed_values) > 0 AND len(list_filter(r.allowed_values, lambda v: len({S.errors('v', 'r', False)}) = 0)) = 0", "no_allowed_value_fits"),
)


def _all_rules(spark, sf):
    t = table(spark, sf, "templates")
    pick = lambda x: F.struct(*(x[f].alias(f) for f in G.RULE_FIELDS))
    own = t.select(F.col("id").alias("template_id"), F.lit("column").alias("scope"), F.posexplode("column_rules").alias("seq", "x")).select("template_id", "scope", "seq", pick(F.col("x")).alias("r"))
    region = t.select(F.col("id").alias("template_id"), F.lit("cell").alias("scope"), F.posexplode("cell_rules").alias("seq", "x")).select("template_id", "scope", "seq", pick(F.col("x.constraints")).alias("r"))
    return own.union(region)


@query(f"WITH {_RULES} SELECT template_id, scope, seq, array_to_string({_VALID}, ',') AS problems FROM all_rules")
def rule_validate(spark, sf):
    return _all_rules(spark, sf).select("template_id", "scope", "seq", F.array_join(G.rule_errors(F.col("r")), ",").alias("problems"))


@query(f"""WITH {_RULES} SELECT template_id, scope, seq, concat_ws('; ', r.value_format, 'decimal places: ' || r.decimal_places,
 CASE WHEN coalesce(r.minimum, r.maximum) IS NOT NULL THEN 'from ' || coalesce(cast(r.minimum AS VARCHAR), '−∞') || ' to ' || coalesce(cast(r.maximum AS VARCHAR), '+∞') END,
 CASE WHEN len(r.allowed_values) > 0 THEN 'one of: ' || array_to_string(r.allowed_values, '; ') END,
 CASE WHEN coalesce(r.expected_minimum, r.expected_maximum) IS NOT NULL THEN 'usually ' || coalesce(cast(r.expected_minimum AS VARCHAR), '') || '…' || coalesce(cast(r.expected_maximum AS VARCHAR), '') END,
 CASE WHEN r.require_decimal THEN 'decimal part required' END, CASE WHEN r.prefer_expected_range THEN 'prefer the expected range' END) AS summary FROM all_rules""")
def rule_summary(spark, sf):
    return _all_rules(spark, sf).select("template_id", "scope", "seq", G.rule_summary(F.col("r")).alias("summary"))


@query(f"""WITH rr AS (SELECT id AS template_id, generate_subscripts(cell_rules, 1) AS seq, unnest(cell_rules) AS r FROM templates)
SELECT a.template_id, a.r.id AS left_id, b.r.id AS right_id FROM rr a JOIN rr b ON a.template_id = b.template_id AND a.seq < b.seq
WHERE NOT (a.r.row_end < b.r.row_start OR b.r.row_end < a.r.row_start OR a.r.column_end < b.r.column_start OR b.r.column_end < a.r.column_start)
AND {S.AREA.replace('r.', 'a.r.')} = {S.AREA.replace('r.', 'b.r.')} AND (a.r.row_start, a.r.row_end, a.r.column_start, a.r.column_end) <> (b.r.row_start, b.r.row_end, b.r.column_start, b.r.column_end)
AND a.r.constraints IS DISTINCT FROM b.r.constraints""")
def rule_conflicts(spark, sf):
    return C.overlapping_rules(table(spark, sf, "templates"))


@query(f"SELECT evidence_id, regexp_replace({S.plain('value_text')}, '[0-9]', '#', 'g') AS shape, {S.canonical('value_text')} AS canonical FROM (SELECT DISTINCT evidence_id, value_text FROM evidence) WHERE {S.full('value_text', S.SIMPLE)}")
def numeric_shapes(spark, sf):
    e = table(spark, sf, "evidence").select("evidence_id", "value_text").distinct()
    return e.select("evidence_id", G.numeric_shape(F.col("value_text")).alias("shape"), G.canonical_numeric(F.col("value_text")).alias("canonical")).where("shape is not null")


@query(f"SELECT cell_id, count(DISTINCT {S.number('value_text')}) AS n_values, min({S.number('value_text')})::DOUBLE AS least FROM evidence WHERE {S.number('value_text')} IS NOT NULL GROUP BY cell_id")
def numeric_identities(spark, sf):
    e = table(spark, sf, "evidence").select("cell_id", G.numeric_identity(F.col("value_text")).alias("identity"), G.number(F.col("value_text")).alias("n")).where("n is not null")
    return e.groupBy("cell_id").agg(F.countDistinct("identity").alias("n_values"), F.min("n").cast("double").alias("least"))


@query("SELECT id AS template_id, r.id AS rule_id, r.row_start, CASE WHEN r.row_start < n AND ((n <> o AND r.row_end = o - 1) OR r.row_end >= n) THEN n - 1 ELSE r.row_end END AS row_end, r.column_start, CASE WHEN r.column_start < m AND ((m <> p AND r.column_end = p - 1) OR r.column_end >= m) THEN m - 1 ELSE r.column_end END AS column_end FROM (SELECT id, unnest(cell_rules) AS r, len(row_guides) - 1 AS o, len(row_guides) + 1 AS n, len(column_guides) - 1 AS p, len(column_guides) - 2 AS m FROM templates)")
def grid_resize(spark, sf):
    return C.resize(table(spark, sf, "templates"), F.size("row_guides") + 1, F.size("column_guides") - 2)


@query("""WITH t AS (SELECT id AS template_id, CASE WHEN template_version % 3 = 0 THEN column_rules[1:2] ELSE list_concat(column_rules, column_rules) END AS rules, row_label_columns, unnest(range(0, len(column_guides) - 1)) AS seq FROM templates)
SELECT template_id, seq::INTEGER AS seq, coalesce(rules[seq + 1].name, 'Column ' || (seq + 1)) AS name, coalesce(rules[seq + 1].role, CASE WHEN seq < row_label_columns THEN 'row_label' ELSE 'data' END) AS role, coalesce(rules[seq + 1].value_format, 'complex_numeric') AS value_format FROM t""")
def column_rules_padded(spark, sf):
    """Each grid column with its rule, where templates have two rules or twice too many: defaults fill up, extra rules are cut."""
    rules = F.when(F.col("template_version") % 3 == 0, F.slice("column_rules", 1, 2)).otherwise(F.concat("column_rules", "column_rules"))
    templates = table(spark, sf, "templates").withColumn("column_rules", rules)
    t = C.with_template(templates.select(F.col("id").alias("template_id")), templates)
    t = t.where("t.columns > 0").withColumn("seq", F.explode(F.sequence(F.lit(0), F.col("t.columns") - 1))).withColumn("own", C.column_rule(F.col("t"), F.col("seq")))
    return t.select("template_id", "seq", "own.name", "own.role", F.col("own.rule.value_format").alias("value_format"))


_GRID = "grid AS (SELECT t.id AS template_id, cell_row, unnest(range(0, len(t.column_guides) - 1)) AS cell_column FROM (SELECT id, unnest(range(0, len(row_guides) - 1)) AS cell_row FROM templates) g JOIN templates t ON t.id = g.id), numbered AS (SELECT row_number() OVER (ORDER BY template_id, cell_row, cell_column) AS k, template_id, cell_row::INTEGER AS cell_row, cell_column::INTEGER AS cell_column FROM grid)"


def _grid(spark, sf):
    return C.resolve(C.grid(table(spark, sf, "templates")))


@query(f"WITH {_GRID}, {S.resolved('numbered', 'k')} SELECT template_id, cell_row, cell_column, kind, {S.letters('cell_column')} || (cell_row + 1) AS address FROM resolved")
def cell_grid(spark, sf):
    return _grid(spark, sf).select("template_id", "cell_row", "cell_column", "kind", F.concat(G.column_name(F.col("cell_column")), (F.col("cell_row") + 1).cast("string")).alias("address"))


@query(f"WITH {_GRID}, {S.resolved('numbered', 'k')} SELECT template_id, cell_row, cell_column FROM resolved WHERE excluded")
def exclusion_mask(spark, sf):
    return _grid(spark, sf).where("excluded").select("template_id", "cell_row", "cell_column")


@query(f"WITH {S.resolved()} SELECT cell_id FROM resolved WHERE NOT (cell_row < n_rows AND cell_column < n_columns AND (excluded OR (cell_row IN (2, 5) AND cell_column >= row_label_columns) OR (cell_column = 3 AND cell_row >= header_rows)))")
def exclude_anti(spark, sf):
    """Cells outside template and page exclusions (page rows 2 and 5, page column 3): anti-join on the mask."""
    cells = _resolved(spark, sf)
    grid = _grid(spark, sf)
    page = (F.col("cell_row").isin(2, 5) & (F.col("cell_column") >= F.col("t.row_label_columns"))) | ((F.col("cell_column") == 3) & (F.col("cell_row") >= F.col("t.header_rows")))
    mask = grid.where(F.col("excluded") | page).select("template_id", "cell_row", "cell_column")
    return cells.join(mask, ["template_id", "cell_row", "cell_column"], "left_anti").select("cell_id")


@query("SELECT template_id, cell_row, cell_column, round(y1, 0)::INTEGER AS y, round(x1, 0)::INTEGER AS x, greatest(1, y2 - y1)::INTEGER AS height, greatest(1, x2 - x1)::INTEGER AS width FROM (SELECT g.*, greatest(0, round_even(t.row_guides[cell_row + 1] * 1754, 0) + 3) AS y1, round_even(t.row_guides[cell_row + 2] * 1754, 0) - 3 AS y2, greatest(0, round_even(t.column_guides[cell_column + 1] * 1240, 0) + 3) AS x1, round_even(t.column_guides[cell_column + 2] * 1240, 0) - 3 AS x2 FROM (SELECT t.id AS template_id, cell_row, unnest(range(0, len(t.column_guides) - 1)) AS cell_column FROM (SELECT id, unnest(range(0, len(row_guides) - 1)) AS cell_row FROM templates) g JOIN templates t ON t.id = g.id) g JOIN templates t ON t.id = g.template_id)")
def cell_rects(spark, sf):
    """Pixel rectangles on a page of 1240 x 1754, inset 3, half-even rounding, at least one pixel."""
    t = table(spark, sf, "templates").select(F.col("id").alias("template_id"), "row_guides", "column_guides")
    g = t.where("size(row_guides) > 1 and size(column_guides) > 1").withColumn("cell_row", F.explode(F.sequence(F.lit(0), F.size("row_guides") - 2))).withColumn("cell_column", F.explode(F.sequence(F.lit(0), F.size("column_guides") - 2)))
    edge = lambda guides, i, size: F.rint(F.get(guides, i) * size)
    g = g.withColumn("y", F.greatest(F.lit(0), edge("row_guides", F.col("cell_row"), 1754) + 3)).withColumn("x", F.greatest(F.lit(0), edge("column_guides", F.col("cell_column"), 1240) + 3))
    height, width = edge("row_guides", F.col("cell_row") + 1, 1754) - 3 - F.col("y"), edge("column_guides", F.col("cell_column") + 1, 1240) - 3 - F.col("x")
    i = lambda c: c.cast("int")
    return g.select("template_id", "cell_row", "cell_column", i(F.col("y")).alias("y"), i(F.col("x")).alias("x"), i(F.greatest(F.lit(1), height)).alias("height"), i(F.greatest(F.lit(1), width)).alias("width"))


def marks(comparable: str = "rule_name", also: str = "") -> str:
    """Common table expressions from ``readings`` to ``flagged``: outlier flags computed anew, within rows of a document's page."""
    return f"""
counted AS (SELECT *, {comparable} AS comparable, {S.number('c_text')}::DOUBLE AS value FROM readings WHERE kind = 'rule' AND cell_row >= header_rows AND cell_column >= row_label_columns AND status <> 'excluded' {also} AND {S.number('c_text')} IS NOT NULL),
g1 AS (SELECT *, count(*) OVER w AS n, median(value) OVER w AS center FROM counted WHERE comparable <> '' WINDOW w AS (PARTITION BY run_id, template_id, page_index, cell_row, comparable)),
g2 AS (SELECT *, median(abs(value - center)) OVER (PARTITION BY run_id, template_id, page_index, cell_row, comparable) AS spread FROM g1 WHERE n >= 5),
g3 AS (SELECT *, greatest(10.0, abs(center) * 0.45, spread * 1.4826 * 4.5) AS threshold FROM g2),
marks AS (SELECT cell_id, CASE WHEN len(list_filter(string_split(c_alternative, ' | '), lambda v: len({S.errors('v', 'rule')}) = 0 AND coalesce(abs({S.number('v')}::DOUBLE - center) <= threshold, false))) > 0
  THEN ['table_outlier', 'table_outlier_with_plausible_alternative'] ELSE ['table_outlier'] END AS marks FROM g3 WHERE abs(value - center) > threshold),
flagged AS (SELECT r.*, list_sort(list_distinct(list_concat(list_filter(c_flags, lambda f: f NOT IN ('table_outlier', 'table_outlier_with_plausible_alternative')), coalesce(marks, [])))) AS flags_now FROM readings r LEFT JOIN marks USING (cell_id))"""


_OUT = f"{S.constrained()},{marks()}"


@query(f"WITH {_OUT} SELECT cell_id, array_to_string(flags_now, ',') AS flags, len(list_filter(flags_now, lambda f: f NOT IN ({NON_BLOCKING}))) > 0 AND status = 'automatic' AS needs_review FROM flagged")
def outlier_flags(spark, sf):
    return _flagged(spark, sf).select("cell_id", F.array_join("flags_now", ",").alias("flags"), G.needs_review(F.col("flags_now"), F.col("status")).alias("needs_review"))


@query(f"WITH {_OUT} SELECT run_id, template_id, page_index, count(*) AS n_cells, count(*) FILTER (kind = 'rule' AND len({S.errors('c_text', 'rule')}) > 0) AS n_errors, count(*) FILTER (list_contains(flags_now, 'table_outlier')) AS n_outliers, count(*) FILTER (status = 'automatic' AND len(list_filter(flags_now, lambda f: f NOT IN ({NON_BLOCKING}))) > 0) AS n_unresolved FROM flagged GROUP BY ALL")
def flagship_review_counts(spark, sf):
    return K.review_counts(_flagged(spark, sf))


@query("""WITH g AS (SELECT l_orderkey, l_extendedprice / 100 AS value, count(*) OVER w AS n, median(l_extendedprice / 100) OVER w AS center FROM lineitem WINDOW w AS (PARTITION BY l_orderkey)),
h AS (SELECT *, median(abs(value - center)) OVER (PARTITION BY l_orderkey) AS spread FROM g WHERE n >= 5)
SELECT l_orderkey, n, count(*) FILTER (abs(value - center) > greatest(10.0, abs(center) * 0.45, spread * 1.4826 * 4.5)) AS n_outliers FROM h GROUP BY ALL""")
def outlier_mad(spark, sf):
    """The same check on a large fact table: orders are groups, prices are values."""
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_extendedprice")
    found = K.outliers(li, ["l_orderkey"], F.col("l_extendedprice") / 100)
    return found.groupBy("l_orderkey", "n").agg(F.count_if("is_outlier").alias("n_outliers"))


_MARK = lambda t: f"(trim({t}) <> '' AND NOT {S.full(f'trim({t})', S.COMPLEX)} AND length(regexp_replace(trim({t}), '[\\p{{Nd}}.,+\\-−<>≤≥=%/ ]', '', 'g')) >= greatest(1, length(regexp_replace(trim({t}), '\\P{{Nd}}', '', 'g'))))"


@query(f"""WITH d AS (SELECT dataset, document_id, lower(trim(coalesce(writing_type, ''))) AS w, {_MARK("coalesce(raw_text, '')")} AS mark FROM (SELECT DISTINCT record_id, dataset, document_id, writing_type, raw_text FROM provenance))
SELECT dataset, document_id, count(*) AS n_cells, sum(mark::INTEGER) AS n_marks FROM d GROUP BY ALL HAVING count(*) >= 2 AND sum(mark::INTEGER) >= greatest(2, ceil(count(*) * 0.8))""")
def row_mark_consensus(spark, sf):
    """Documents whose crops are almost all marks: the row consensus over annotated crops."""
    p = table(spark, sf, "provenance").select("record_id", "dataset", "document_id", "writing_type", "raw_text").distinct()
    return K.mark_rows(p, ["dataset", "document_id"], K.looks_like_mark(F.coalesce("raw_text", F.lit(""))))


@query(f"WITH {S.constrained()} SELECT cell_id FROM readings WHERE kind = 'rule' AND {_MARK("coalesce(raw_text, '')")} AND len(list_filter(string_split(c_alternative, ' | '), lambda v: {_MARK('v')})) >= 2 AND (coalesce(c_confidence, 0) < 0.9 OR list_has_any(c_flags, ['low_confidence', 'unstable_consensus', 'model_disagreement']))")
def mark_evidence(spark, sf):
    r = _readings(spark, sf).where("kind = 'rule'")
    return r.where(K.mark_evidence(F.col("raw_text"), F.col("c.alternative"), F.col("c.confidence"), F.col("c.flags"))).select("cell_id")
