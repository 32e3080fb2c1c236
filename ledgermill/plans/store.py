"""Queries over stored templates and jobs, edits and small lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgermill.functions import grammar as G
from ledgermill.operators import agreement as A
from ledgermill.operators import cells as C
from ledgermill.operators import islands as I
from ledgermill.operators import jobs as J
from ledgermill.operators import ranking as R
from ledgermill.operators import store as O
from ledgermill.plans import evidence as E
from ledgermill.plans import rules as P
from ledgermill.plans import sqltext as S
from ledgermill.plans.common import SQL, query, table


def _templates(spark, sf):
    return table(spark, sf, "templates")


_RISING = lambda g: f"(len({g}) >= 2 AND len(list_filter({g}, lambda x: isnan(x) OR x < 0 OR x > 1)) = 0 AND len(list_filter(range(1, len({g})), lambda i: {g}[i + 1] <= {g}[i])) = 0)"
_PROBLEM = f"CASE WHEN trim(coalesce(name, '')) = '' THEN 'no_name' WHEN NOT {_RISING('row_guides')} OR NOT {_RISING('column_guides')} THEN 'invalid_guides' WHEN len(row_guides) > 201 OR len(column_guides) > 101 THEN 'grid_too_large' WHEN header_rows NOT BETWEEN 0 AND len(row_guides) - 2 OR row_label_columns NOT BETWEEN 0 AND len(column_guides) - 2 THEN 'labels_outside_grid' END"
_ODD = "(SELECT * REPLACE (CASE WHEN template_version = 2 THEN list_reverse(row_guides) ELSE row_guides END AS row_guides, CASE WHEN template_version = 3 THEN ' ' ELSE name END AS name, CASE WHEN template_version = 4 THEN 99 ELSE header_rows END AS header_rows) FROM templates)"


def _odd(spark, sf):
    """Templates of versions 2 to 4 spoiled in three ways."""
    v = F.col("template_version")
    return _templates(spark, sf).withColumn("row_guides", F.when(v == 2, F.reverse("row_guides")).otherwise(F.col("row_guides"))).withColumn("name", F.when(v == 3, " ").otherwise(F.col("name"))).withColumn("header_rows", F.when(v == 4, 99).otherwise(F.col("header_rows")))


@query(f"SELECT id, {_PROBLEM} AS problem FROM {_ODD}")
def template_import(spark, sf):
    return _odd(spark, sf).select("id", O.import_problem(F.struct("name", "row_guides", "column_guides", "header_rows", "row_label_columns")).alias("problem"))


@query(f"SELECT 'imported-' || md5(id) AS id, 'imported-' || md5(id) AS family_id, name, 1 AS template_version, '' AS reference_source_path, len(fields) + len(cell_rules) AS n_regions FROM {_ODD} WHERE ({_PROBLEM}) IS NULL")
def template_imported(spark, sf):
    """What may be imported, under new identities."""
    t = O.imported_templates(_odd(spark, sf))
    fresh = F.size(F.array_distinct(F.concat(F.transform("fields", lambda f: f["id"]), F.transform("cell_rules", lambda r: r["id"]))))
    return t.select("id", "family_id", "name", "template_version", "reference_source_path", fresh.alias("n_regions"))


@query("SELECT id, family_id, name, template_version FROM templates UNION ALL SELECT id || '-copy', id || '-copy', name || ' (copy)', 1 FROM templates WHERE template_version = 1")
def template_duplicate(spark, sf):
    t = _templates(spark, sf)
    return O.duplicated(t, t.where("template_version = 1")).select("id", "family_id", "name", "template_version")


_OUTSIDE = lambda xs, n: f"(len(list_filter({xs}, lambda i: i IS NULL OR i < 0 OR i >= {n})) > 0 OR len(list_distinct({xs})) < len({xs}))"
_OFF = lambda xs: f"(len(list_filter({xs}, lambda x: x.cell_row IS NULL OR x.cell_column IS NULL OR x.cell_row < 0 OR x.cell_row >= nr OR x.cell_column < 0 OR x.cell_column >= nc)) > 0 OR len(list_distinct(list_transform({xs}, lambda x: (x.cell_row, x.cell_column)))) < len({xs}))"


@query(f"""WITH t AS (SELECT *, len(row_guides) - 1 AS nr, len(column_guides) - 1 AS nc FROM (SELECT * REPLACE (CASE WHEN template_version = 2 THEN list_append(excluded_rows, 300) ELSE excluded_rows END AS excluded_rows, CASE WHEN template_version = 3 THEN list_concat(excluded_cells, excluded_cells) ELSE excluded_cells END AS excluded_cells) FROM templates)),
{P._RULES}, bad AS (SELECT template_id, bool_or(scope = 'column') AS of_columns, bool_or(scope = 'cell') AS of_regions FROM all_rules WHERE len({P._VALID}) > 0 GROUP BY template_id), con AS (SELECT DISTINCT template_id FROM ({SQL['rule_conflicts']}))
SELECT id AS template_id, concat_ws(',', CASE WHEN {_OUTSIDE('excluded_rows', 'nr')} OR {_OUTSIDE('excluded_columns', 'nc')} THEN 'exclusions_outside_grid' END, CASE WHEN {_OFF('excluded_cells')} THEN 'excluded_cells_invalid' END, CASE WHEN {_OFF('fixed_cells')} OR len(list_filter(fixed_cells, lambda x: x.fixed_text IS NULL)) > 0 THEN 'fixed_cells_invalid' END,
 CASE WHEN bad.of_columns THEN 'column_rule_invalid' END, CASE WHEN len(list_filter(cell_rules, lambda r: NOT coalesce(r.row_start >= 0 AND r.row_start <= r.row_end AND r.row_end < nr AND r.column_start >= 0 AND r.column_start <= r.column_end AND r.column_end < nc, false))) > 0 THEN 'region_outside_grid' END, CASE WHEN bad.of_regions THEN 'region_rule_invalid' END, CASE WHEN con.template_id IS NOT NULL THEN 'regions_conflict' END) AS problems
FROM t LEFT JOIN bad ON bad.template_id = t.id LEFT JOIN con ON con.template_id = t.id""")
def template_validate(spark, sf):
    """Everything wrong with a template; versions 2 and 3 get a row outside the grid and cells excluded twice."""
    v = F.col("template_version")
    t = _templates(spark, sf).withColumn("excluded_rows", F.when(v == 2, F.concat("excluded_rows", F.array(F.lit(300)))).otherwise(F.col("excluded_rows"))).withColumn("excluded_cells", F.when(v == 3, F.concat("excluded_cells", "excluded_cells")).otherwise(F.col("excluded_cells")))
    return C.template_problems(t).select("template_id", F.array_join("problems", ",").alias("problems"))


@query("SELECT id, i - 1 AS seq, CASE WHEN r.role = 'ignored' THEN CASE WHEN i - 1 < row_label_columns THEN 'row_label' ELSE 'data' END ELSE r.role END AS role, 0 AS n_excluded FROM (SELECT id, row_label_columns, unnest(column_rules) AS r, generate_subscripts(column_rules, 1) AS i FROM templates)")
def clear_exclusions(spark, sf):
    """All exclusions lifted: no rows, columns or cells are out, and ignored columns are used again."""
    t = O.cleared(_templates(spark, sf))
    n = F.size("excluded_rows") + F.size("excluded_columns") + F.size("excluded_cells")
    return t.select("id", n.alias("n_excluded"), F.posexplode("column_rules").alias("seq", "r")).select("id", "seq", F.col("r.role").alias("role"), "n_excluded")


@query("SELECT id, array_to_string(list_transform(range(1, len(column_rules) + 1), lambda i: CASE WHEN column_rules[i].role = 'ignored' AND i IN (2, 3) THEN CASE WHEN i - 1 < row_label_columns THEN 'row_label' ELSE 'data' END ELSE column_rules[i].role END), ',') AS roles FROM templates")
def columns_used_again(spark, sf):
    """Columns 1 and 2 restored."""
    rules = O.used_again(F.col("column_rules"), F.col("row_label_columns"), F.array(F.lit(1), F.lit(2)))
    return _templates(spark, sf).select("id", F.array_join(F.transform(rules, lambda r: r["role"]), ",").alias("roles"))


@query("SELECT * FROM (VALUES ('0–100, one decimal', 'numeric; decimal places: 1; from 0.0 to 100.0', 0), ('0–1000, two decimals', 'numeric; decimal places: 2; from 0.0 to 1000.0', 0), ('whole number from 0', 'integer; from 0.0 to +∞', 0), ('text', 'text', 0)) v(name, summary, n_problems)")
def rule_presets(spark, sf):
    p = O.presets(spark)
    return p.select("name", G.rule_summary(F.col("rule")).alias("summary"), F.size(G.rule_errors(F.col("rule"))).alias("n_problems"))


@query("SELECT id, axis, CASE axis WHEN 'row' THEN 2 ELSE header_rows END AS row_start, CASE axis WHEN 'row' THEN 2 ELSE len(row_guides) - 2 END AS row_end, CASE axis WHEN 'row' THEN row_label_columns ELSE 2 END AS column_start, CASE axis WHEN 'row' THEN len(column_guides) - 2 ELSE 2 END AS column_end FROM (SELECT *, unnest(['row', 'column']) AS axis FROM templates)")
def axis_rules(spark, sf):
    """The rectangle of a rule on row 2 and on column 2."""
    t = _templates(spark, sf).withColumn("axis", F.explode(F.array(F.lit("row"), F.lit("column"))))
    r = O.axis_rectangle(F.col("axis"), F.lit(2), F.struct("row_guides", "column_guides", "header_rows", "row_label_columns"))
    return t.select("id", "axis", r.alias("r")).select("id", "axis", "r.*")


@query(f"WITH {P._GRID}, {S.resolved('numbered', 'k')} SELECT template_id, cell_row, cell_column FROM resolved WHERE excluded INTERSECT SELECT template_id, cell_row, cell_column FROM resolved WHERE cell_column IN (1, 2)")
def selection_excluded(spark, sf):
    """The excluded cells of a selection (columns 1 and 2)."""
    g, cell = P._grid(spark, sf), ["template_id", "cell_row", "cell_column"]
    return g.where("excluded").select(*cell).intersect(g.where("cell_column in (1, 2)").select(*cell))


@query("""WITH b AS (SELECT id || '/' || f.id AS key, upper(regexp_replace(CASE WHEN f.name = 'Side' THEN f.fixed_value || ' hind' WHEN f.name = 'Session' THEN 'Week' WHEN f.name = 'Operator' THEN 'plantar:' ELSE f.name END, '[^\\p{L}]', '', 'g')) AS word, (f.rect.x * 1240)::INTEGER AS x1, (f.rect.y * 1754)::INTEGER AS y1, ((f.rect.x + f.rect.width) * 1240)::INTEGER AS x2, ((f.rect.y + f.rect.height) * 1754)::INTEGER AS y2, len(column_guides) - 1 AS columns, row_label_columns FROM (SELECT id, column_guides, row_label_columns, unnest(fields) AS f FROM templates)),
c AS (SELECT key, word, greatest(0, x1 - 8) AS x1, greatest(0, y1 - 8) AS y1, least(1240, x2 + 8) AS x2, least(1754, y2 + 8) AS y2, columns, row_label_columns, word IN ('DATE', 'WEEK') AS beside, word IN ('LEFTHIND', 'RIGHTHIND') AS side, word = 'LEFTHIND' AS l, columns // 2 AS half FROM b WHERE word IN ('PLANTAR', 'DATE', 'WEEK', 'LEFTHIND', 'RIGHTHIND')),
d AS (SELECT *, CASE WHEN l THEN row_label_columns ELSE greatest(row_label_columns, half) END AS s FROM c)
SELECT key, CASE WHEN side THEN 'Side' WHEN word = 'DATE' THEN 'Date' WHEN word = 'WEEK' THEN 'Week' ELSE 'Test' END AS name, CASE WHEN beside THEN x2 + 5 ELSE x1 END AS x, CASE WHEN beside THEN y1 - 3 ELSE y1 END AS y, CASE WHEN beside THEN round_even(least(1240 * CASE word WHEN 'DATE' THEN 0.30 ELSE 0.18 END, 1240 - x2 - 5), 0)::INTEGER ELSE x2 - x1 END AS width, CASE WHEN beside THEN greatest(32, y2 - y1 + 6) ELSE y2 - y1 END AS height,
 CASE word WHEN 'DATE' THEN 'date' WHEN 'WEEK' THEN 'integer' ELSE 'text' END AS kind, word = 'PLANTAR' AS required, CASE WHEN l THEN 'Left Hind' WHEN side THEN 'Right Hind' ELSE '' END AS fixed_value, CASE WHEN side THEN s END AS column_start, CASE WHEN side THEN CASE WHEN l THEN greatest(s, half - 1) ELSE columns - 1 END END AS column_end FROM d""")
def suggested_fields(spark, sf):
    """Fields of the templates as printed words, and the standard fields that they suggest."""
    f = _templates(spark, sf).select("id", (F.size("column_guides") - 1).alias("columns"), "row_label_columns", F.explode("fields").alias("f"))
    name = F.col("f.name")
    text = F.when(name == "Side", F.concat("f.fixed_value", F.lit(" hind"))).when(name == "Session", "Week").when(name == "Operator", "plantar:").otherwise(name)
    px = lambda c, n: F.rint(c * n).cast("int")
    r = F.col("f.rect")
    boxes = f.select(F.concat("id", F.lit("/"), "f.id").alias("key"), text.alias("text"), px(r["x"], 1240).alias("x1"), px(r["y"], 1754).alias("y1"), px(r["x"] + r["width"], 1240).alias("x2"), px(r["y"] + r["height"], 1754).alias("y2"), "columns", "row_label_columns")
    return O.suggested_fields(boxes, 1240, 1754)


@query("SELECT '[' || string_agg('{\"status\":\"' || status || '\",\"n_jobs\":' || n || '}', ',' ORDER BY status) || ']' AS report FROM (SELECT status, count(*) AS n FROM (SELECT * FROM jobs WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY updated_at DESC NULLS LAST, received_at DESC NULLS LAST, status) = 1) GROUP BY status)")
def diagnostics_report(spark, sf):
    """The counts as one JSON text without paths or values."""
    per = J.current(table(spark, sf, "jobs")).groupBy("status").agg(F.count("*").alias("n_jobs"))
    return per.agg(F.to_json(F.array_sort(F.collect_list(F.struct("status", "n_jobs")))).alias("report"))


@query("SELECT template_id, sha256('[' || string_agg('\"' || model || '\"', ',' ORDER BY model) || ']') AS identity FROM (SELECT DISTINCT template_id, model FROM evidence) GROUP BY template_id")
def recognition_identity(spark, sf):
    """Digest of the sorted models that read a template's cells: readings of another set are not reused."""
    per = table(spark, sf, "evidence").select("template_id", "model").distinct().groupBy("template_id").agg(F.array_sort(F.collect_list("model")).alias("models"))
    return per.select("template_id", F.sha2(F.to_json("models"), 256).alias("identity"))


@query("SELECT id AS template_id, f.id AS field_id, list_position(ys, round(f.rect.y, 6)) - 1 AS first, list_position(ys, round(f.rect.y + f.rect.height, 6)) - 1 AS last FROM (SELECT id, list_sort(list_distinct(list_transform(list_concat(row_guides, list_transform(fields, lambda f: f.rect.y), list_transform(fields, lambda f: f.rect.y + f.rect.height)), lambda g: round(g, 6)))) AS ys, unnest(fields) AS f FROM templates)")
def lattice_boxes(spark, sf):
    """The lattice lines at which a field begins and ends on a printable form."""
    y = lambda f: f["rect"]["y"]
    end = lambda f: f["rect"]["y"] + f["rect"]["height"]
    t = _templates(spark, sf).select("id", O.edges(F.col("row_guides"), F.transform("fields", y), F.transform("fields", end)).alias("ys"), F.explode("fields").alias("f"))
    at = lambda v: F.array_position("ys", F.round(v, 6)) - 1
    return t.select(F.col("id").alias("template_id"), F.col("f.id").alias("field_id"), at(y(F.col("f"))).alias("first"), at(end(F.col("f"))).alias("last"))


@query("SELECT template_id, field_id, round(x / 1240.0, 9) AS x, round(y / 1754.0, 9) AS y, round(width / 1240.0, 9) AS width, round(height / 1754.0, 9) AS height FROM (SELECT id AS template_id, f.id AS field_id, x, y, greatest(1, least(round_even(f.rect.width * 1240, 0), 1240 - x)) AS width, greatest(1, least(round_even(f.rect.height * 1754, 0), 1754 - y)) AS height FROM (SELECT id, f, greatest(0, least(round_even(f.rect.x * 1240, 0), 1239)) AS x, greatest(0, least(round_even(f.rect.y * 1754, 0), 1753)) AS y FROM (SELECT id, unnest(fields) AS f FROM templates)))")
def field_parts(spark, sf):
    """Field rectangles from pixels back to parts of the page."""
    f = _templates(spark, sf).select(F.col("id").alias("template_id"), F.explode("fields").alias("f"))
    r = O.normal_rect(O.pixel_rect(F.col("f.rect"), F.lit(1240), F.lit(1754)), F.lit(1240), F.lit(1754))
    return f.select("template_id", F.col("f.id").alias("field_id"), r.alias("r")).select("template_id", "field_id", *(F.round(f"r.{c}", 9).alias(c) for c in ("x", "y", "width", "height")))


@query("SELECT id, family_id, template_version FROM templates UNION ALL SELECT id || '-v' || (v + 1), family_id, v + 1 FROM (SELECT id, family_id, max(template_version) OVER (PARTITION BY family_id) AS v, auto_fit_rows FROM templates) WHERE auto_fit_rows")
def template_save_version(spark, sf):
    """Templates that fit rows automatically, saved once more as new versions."""
    t = _templates(spark, sf).select("id", "family_id", "template_version", "auto_fit_rows")
    return O.saved_versions(t, t.where("auto_fit_rows")).select("id", "family_id", "template_version")


@query("SELECT cell_id FROM ocr_cells WHERE template_id NOT IN (SELECT id FROM templates WHERE template_version = 1)")
def template_delete(spark, sf):
    gone = _templates(spark, sf).where("template_version = 1").select(F.col("id").alias("template_id"))
    return O.without(table(spark, sf, "ocr_cells"), gone, "template_id").select("cell_id")


@query("SELECT DISTINCT id FROM jobs WHERE id NOT IN (SELECT id FROM jobs WHERE status = 'exported')")
def job_delete(spark, sf):
    j = table(spark, sf, "jobs").select("id", "status")
    return O.without(j, j.where("status = 'exported'"), "id").select("id").distinct()


@query("SELECT status, count(*) AS n_jobs, count(DISTINCT station_id) AS n_stations FROM (SELECT * FROM jobs WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY updated_at DESC NULLS LAST, received_at DESC NULLS LAST, status) = 1) GROUP BY status")
def diagnostics(spark, sf):
    return J.current(table(spark, sf, "jobs")).groupBy("status").agg(F.count("*").alias("n_jobs"), F.countDistinct("station_id").alias("n_stations"))


_CELLS = lambda xs: f"array_to_string(list_transform({xs}, lambda x: x.cell_row || ',' || x.cell_column || '=' || x.fixed_text), ' ')"
_OTHERS = "list_filter(fixed_cells, lambda f: NOT (f.cell_row = 1 AND f.cell_column = 1))"


@query(f"SELECT id, {_CELLS(_OTHERS + ' || [{cell_row: 1, cell_column: 1, fixed_text: upper(name)}]'.replace('{', '{{').replace('}', '}}').replace('{{', '{').replace('}}', '}'))} AS set, {_CELLS(_OTHERS)} AS cleared FROM templates")
def fixed_value_set(spark, sf):
    """The value of cell (1, 1) set to the template's name, and taken away."""
    shown = lambda v: F.array_join(F.transform(O.set_fixed(F.col("fixed_cells"), F.lit(1), F.lit(1), v), lambda x: F.concat(x["cell_row"].cast("string"), F.lit(","), x["cell_column"].cast("string"), F.lit("="), x["fixed_text"])), " ")
    return _templates(spark, sf).select("id", shown(F.upper("name")).alias("set"), shown(F.lit(None).cast("string")).alias("cleared"))


_SHOW_RULE = "r.id || ' ' || r.row_start || '-' || r.row_end || ' ' || r.column_start || '-' || r.column_end"


@query(f"""WITH t AS (SELECT id, cell_rules, template_version % 2 = 0 AS even, struct_pack(id := 'quick', row_start := CASE WHEN template_version % 2 = 0 THEN cell_rules[1].row_start ELSE 0 END, row_end := CASE WHEN template_version % 2 = 0 THEN cell_rules[1].row_end ELSE 4 END, column_start := CASE WHEN template_version % 2 = 0 THEN cell_rules[1].column_start ELSE 1 END, column_end := CASE WHEN template_version % 2 = 0 THEN cell_rules[1].column_end ELSE 2 END) AS q FROM templates WHERE len(cell_rules) > 0),
x AS (SELECT id, q, list_transform(cell_rules, lambda r: struct_pack(id := r.id, row_start := r.row_start, row_end := r.row_end, column_start := r.column_start, column_end := r.column_end)) AS rs FROM t),
y AS (SELECT id, CASE WHEN len(list_filter(rs, lambda r: (r.row_start, r.row_end, r.column_start, r.column_end) = (q.row_start, q.row_end, q.column_start, q.column_end))) > 0 THEN list_transform(rs, lambda r: CASE WHEN (r.row_start, r.row_end, r.column_start, r.column_end) = (q.row_start, q.row_end, q.column_start, q.column_end) THEN q ELSE r END) ELSE list_append(rs, q) END AS rs FROM x)
SELECT id, array_to_string(list_transform(rs, lambda r: {_SHOW_RULE}), ' | ') AS rules FROM y""")
def quick_rule(spark, sf):
    """A rule put on the first region's rectangle (even versions: replaces it) or on rows 0 to 4 and columns 1 to 2 (appended)."""
    t = _templates(spark, sf).where("size(cell_rules) > 0")
    first, even = F.get("cell_rules", F.lit(0)), F.col("template_version") % 2 == 0
    pick = {k: F.when(even, first[k]).otherwise(v).cast("int") for k, v in (("row_start", 0), ("row_end", 4), ("column_start", 1), ("column_end", 2))}
    rect = F.struct(*(v.alias(k) for k, v in pick.items()))
    rule = first.withField("id", F.lit("quick"))
    for k, v in pick.items():
        rule = rule.withField(k, v)
    show = lambda r: F.format_string("%s %d-%d %d-%d", r["id"], r["row_start"], r["row_end"], r["column_start"], r["column_end"])
    return t.select("id", F.array_join(F.transform(O.apply_rule(F.col("cell_rules"), rect, rule), show), " | ").alias("rules"))


@query("SELECT t.id AS template_id, r::INTEGER AS cell_row, c::INTEGER AS cell_column FROM (SELECT id, unnest(range(0, len(row_guides) - 1)) AS r FROM templates) g JOIN templates t ON t.id = g.id, LATERAL (SELECT unnest(range(0, len(t.column_guides) - 1)) AS c)")
def point_cells(spark, sf):
    """The middle of every cell, looked up again by its coordinates."""
    t = _templates(spark, sf).select(F.col("id").alias("template_id"), "row_guides", "column_guides").where("size(row_guides) > 1 and size(column_guides) > 1")
    mid = lambda g, i: (F.get(g, i) + F.get(g, i + 1)) / 2
    p = t.withColumn("r", F.explode(F.sequence(F.lit(0), F.size("row_guides") - 2))).withColumn("c", F.explode(F.sequence(F.lit(0), F.size("column_guides") - 2)))
    row, column = O.cell_at(F.col("row_guides"), F.col("column_guides"), mid("row_guides", F.col("r")), mid("column_guides", F.col("c")))
    return p.select("template_id", row.alias("cell_row"), column.alias("cell_column"))


@query("SELECT id AS template_id, r.id AS rule_id, (r.row_end - r.row_start + 1) * (r.column_end - r.column_start + 1) AS n_cells FROM (SELECT id, unnest(cell_rules) AS r FROM templates)")
def rule_cells(spark, sf):
    """Regions expanded to their cells, and counted."""
    r = _templates(spark, sf).select(F.col("id").alias("template_id"), F.explode("cell_rules").alias("r"))
    cells = r.withColumn("row", F.explode(F.sequence("r.row_start", "r.row_end"))).withColumn("column", F.explode(F.sequence("r.column_start", "r.column_end")))
    return cells.groupBy("template_id", F.col("r.id").alias("rule_id")).agg(F.count("*").alias("n_cells"))


@query("SELECT id, sum(greatest(0, d)) AS height, quantile_disc(d, 0.5) AS pitch, round(median(d), 9) AS middle FROM (SELECT id, unnest(list_transform(range(1, len(row_guides)), lambda i: round(row_guides[i + 1] - row_guides[i], 9))) AS d FROM templates) GROUP BY id")
def guide_pitch(spark, sf):
    """Row pitch of each template: summed, lower median of the steps and their median."""
    t = _templates(spark, sf).select("id", F.explode(F.zip_with(F.slice("row_guides", F.lit(2), F.size("row_guides") - 1), F.slice("row_guides", F.lit(1), F.size("row_guides") - 1), lambda a, b: F.round(a - b, 9))).alias("d"))
    return t.groupBy("id").agg(F.sum(F.greatest(F.lit(0.0), "d")).alias("height"), F.expr("percentile_disc(0.5) within group (order by d)").alias("pitch"), F.round(F.median("d"), 9).alias("middle"))


@query("SELECT template_id, list_sort(list(length(coalesce(text, ''))))[len(list(length(coalesce(text, '')))) // 2 + 1] AS upper_median FROM ocr_cells GROUP BY template_id")
def upper_median(spark, sf):
    """Column widths use the upper median of text lengths."""
    c = table(spark, sf, "ocr_cells").groupBy("template_id", F.length(F.coalesce("text", F.lit(""))).alias("n")).agg(F.count("*").alias("k"))
    return c.groupBy("template_id").agg(F.array_sort(F.collect_list(F.struct("n", "k"))).alias("h"), F.sum("k").alias("total")).select(
        "template_id",
        F.aggregate("h", F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("int").alias("at")), lambda a, x: F.struct((a["seen"] + x["k"]).alias("seen"), F.coalesce(a["at"], F.when(a["seen"] + x["k"] > F.floor(F.col("total") / 2), x["n"])).alias("at")))["at"].alias("upper_median"),
    )


@query("SELECT evidence_id FROM (SELECT DISTINCT evidence_id, image_key FROM evidence) WHERE image_key IN ('base-0', 'base-1', 'base-3') OR regexp_full_match(image_key, 'retry-.*-clean')")
def layout_views(spark, sf):
    """Evidence from views that keep the layout."""
    e = table(spark, sf, "evidence").select("evidence_id", "image_key").distinct()
    return e.where(F.col("image_key").isin("base-0", "base-1", "base-3") | F.col("image_key").rlike(r"\Aretry-.*-clean\z")).select("evidence_id")


@query(f"WITH {E._OBS} SELECT cell_id, model, max(support) AS confidence, max(support) < 0.92 AS low_confidence, count(DISTINCT image_key) AS n_views FROM obs WHERE image_key IN ('base-0', 'base-1') GROUP BY cell_id, model")
def text_cell_views(spark, sf):
    """The better of two views of a cell per model, and whether it is unsure."""
    o = R.observations(table(spark, sf, "evidence")).where(F.col("image_key").isin("base-0", "base-1"))
    return o.groupBy("cell_id", "model").agg(F.max("support").alias("confidence"), (F.max("support") < 0.92).alias("low_confidence"), F.countDistinct("image_key").alias("n_views"))


@query("SELECT id AS template_id, f.id AS field_id, f.name AS value FROM (SELECT id, unnest(fields) AS f FROM templates) WHERE f.printed_label IS NOT NULL AND trim(f.printed_label) <> ''")
def caption_strip(spark, sf):
    """A field's printed caption in front of its reading is taken off once."""
    f = _templates(spark, sf).select(F.col("id").alias("template_id"), F.explode("fields").alias("f")).where("trim(f.printed_label) <> ''")
    read = F.concat(F.col("f.printed_label"), F.lit(": "), F.col("f.name"))
    return f.select("template_id", F.col("f.id").alias("field_id"), O.strip_caption(read, F.col("f.printed_label")).alias("value"))


@query(f"WITH {P._OUT}, {E._ELIG}, {E._answer(E.FIRST, 'fa')} SELECT DISTINCT run_id, template_id, page_index, cell_row FROM eligible JOIN fa USING (cell_id) WHERE t IS NOT NULL AND {S.number('t')} IS DISTINCT FROM {S.number('c_text')}")
def disputed_rows(spark, sf):
    """Rows where the first model's valid reading differs from the baseline: only these go to the second model."""
    e = table(spark, sf, "evidence")
    cells = A.eligible(P._flagged(spark, sf)).join(A.answers(e, E.FIRST, "first"), "cell_id")
    read = cells.withColumn("a", A.reading(F.col("first"), F.col("rule"))).where("a is not null")
    return read.where(~G.numeric_identity(F.col("a")).eqNullSafe(G.numeric_identity(F.col("c.text")))).select("run_id", "template_id", "page_index", "cell_row").distinct()


@query("SELECT run_id, template_id, page_index, count(DISTINCT (cell_row, cell_column)) FILTER (cell_row < nr AND cell_column < nc) = nr * nc AND count(*) FILTER (cell_row >= nr OR cell_column >= nc) = 0 AS complete FROM (SELECT c.*, len(t.row_guides) - 1 AS nr, len(t.column_guides) - 1 AS nc FROM ocr_cells c JOIN templates t ON c.template_id = t.id) GROUP BY run_id, template_id, page_index, nr, nc")
def page_complete(spark, sf):
    """A page may be stored when its cells are exactly its grid."""
    t = _templates(spark, sf).select(F.col("id").alias("template_id"), (F.size("row_guides") - 1).alias("nr"), (F.size("column_guides") - 1).alias("nc"))
    c = table(spark, sf, "ocr_cells").select("run_id", "template_id", "page_index", "cell_row", "cell_column").join(t, "template_id")
    inside = (F.col("cell_row") < F.col("nr")) & (F.col("cell_column") < F.col("nc"))
    per = c.groupBy("run_id", "template_id", "page_index", "nr", "nc").agg(F.countDistinct(F.when(inside, F.struct("cell_row", "cell_column"))).alias("n"), F.count_if(~inside).alias("outside"))
    return per.select("run_id", "template_id", "page_index", ((F.col("n") == F.col("nr") * F.col("nc")) & (F.col("outside") == 0)).alias("complete"))


@query("SELECT id AS document, 0.0007 * template_version <= 0.002 AS fits, 2::BIGINT AS n_pages FROM templates WHERE len(row_guides) > 1")
def same_grid(spark, sf):
    """Two pages of each template, the second moved by 0.0007 for each version: up to 0.002 they share one grid."""
    t = _templates(spark, sf).where("size(row_guides) > 1")
    page = lambda n, d: t.select(F.col("id").alias("document"), F.lit(n).alias("page"), *(F.transform(c, lambda g: g + d * F.col("template_version")).alias(c) for c in ("row_guides", "column_guides")))
    return O.same_grid(page(0, 0.0).union(page(1, 0.0007)))


@query("SELECT id, CASE WHEN abs(h / w - 1.414286) < 0.004 THEN 'A4' ELSE 'custom' END AS page, printf('%02d:%02d:%02d', v // 3600, v // 60 % 60, v % 60) AS duration FROM (SELECT id, 210.0 AS w, 210.0 * coalesce(reference_page_aspect, 1) AS h, template_version * 997 AS v FROM templates)")
def page_sizes(spark, sf):
    t = _templates(spark, sf)
    return t.select("id", O.page_size(F.lit(210.0), 210.0 * F.coalesce("reference_page_aspect", F.lit(1.0))).alias("page"), O.duration(F.col("template_version") * 997, F.lit(False)).alias("duration"))


@query()
def reading_order(spark, sf):
    """A template's fields in reading order of their boxes."""
    f = _templates(spark, sf).select(F.col("id").alias("template_id"), F.explode("fields").alias("f"))
    r = F.col("f.rect")
    return O.reading_order(f.select("template_id", F.col("f.id").alias("box_id"), r["x"].alias("left"), r["y"].alias("top"), (r["x"] + r["width"]).alias("right"), (r["y"] + r["height"]).alias("bottom")), "template_id")


@query(f"SELECT outcome, count(*) AS n FROM ({E.SQL_AGREEMENT}) GROUP BY outcome")
def agreement_outcomes(spark, sf):
    return E.agreement_update(spark, sf).groupBy("outcome").agg(F.count("*").alias("n"))


@query("SELECT a.id AS old_id, b.id AS new_id FROM templates a JOIN templates b ON a.family_id = b.family_id AND a.template_version < b.template_version WHERE sha256(a.id) IN (SELECT sha256(id) FROM templates WHERE template_version <= 3)")
def template_upgrade(spark, sf):
    """Templates whose digest is a known earlier one, with the later versions of their family."""
    t = _templates(spark, sf).select("id", "family_id", "template_version", F.sha2("id", 256).alias("digest"))
    known = t.where("template_version <= 3").select("digest")
    old = t.join(known, "digest", "left_semi")
    return old.alias("a").join(t.alias("b"), "family_id").where("a.template_version < b.template_version").select(F.col("a.id").alias("old_id"), F.col("b.id").alias("new_id"))


_GATES = ((0.95, 4), (0.8, 4), (0.6, 3), (0.3, 2))


@query(" UNION ALL ".join("SELECT {}::DOUBLE AS sure, pass, count(*) AS n FROM ({}) GROUP BY pass".format(s, E.SQL_ADAPTIVE.replace("n >= 4", f"n >= {n}").replace("least >= 0.95", f"least >= {s}")) for s, n in _GATES))
def adaptive_counts(spark, sf):
    """Cells of the short and the full pass, at the gate's own thresholds and at lower ones."""
    obs, rules, seen = E._obs(spark, sf), E._rules(spark, sf), E._seen(spark, sf)
    out = None
    for sure, least in _GATES:
        per = R.adaptive(obs, rules, seen, (E.FIRST, E.SECOND), sure, least=least).groupBy("pass").agg(F.count("*").alias("n")).select(F.lit(sure).alias("sure"), "pass", "n")
        out = per if out is None else out.union(per)
    return out


@query(f"""SELECT run_id, template_id, page_index, count(*) AS n_cells, count(*) FILTER (outcome = 'changed') AS n_changed,
CASE WHEN count(*) FILTER (outcome = 'first_unavailable') = count(*) THEN 'failed' WHEN count(*) FILTER (outcome IN ('first_unavailable', 'second_unavailable')) > 0 THEN 'partial' ELSE 'complete' END AS state
FROM ({E.SQL_AGREEMENT}) a JOIN (SELECT cell_id, run_id, template_id, page_index FROM ocr_cells) c USING (cell_id) GROUP BY run_id, template_id, page_index""")
def verification_pages(spark, sf):
    """State of each page's verification: failed keeps the baseline, partial lacks answers for some cells."""
    c = table(spark, sf, "ocr_cells").select("cell_id", "run_id", "template_id", "page_index")
    lacks = F.col("outcome").isin("first_unavailable", "second_unavailable")
    per = E.agreement_update(spark, sf).join(c, "cell_id").groupBy("run_id", "template_id", "page_index").agg(F.count("*").alias("n_cells"), F.count_if(F.col("outcome") == "changed").alias("n_changed"), F.count_if(F.col("outcome") == "first_unavailable").alias("none"), F.count_if(lacks).alias("some"))
    state = F.when(F.col("none") == F.col("n_cells"), "failed").when(F.col("some") > 0, "partial").otherwise("complete")
    return per.select("run_id", "template_id", "page_index", "n_cells", "n_changed", state.alias("state"))


@query(f"""WITH {S.resolved()} SELECT cell_id, CASE WHEN kind IN ('excluded', 'fixed') THEN 'skip' WHEN trim(coalesce(raw_text, '')) = '' THEN 'blank' WHEN kind = 'rule' AND rule.value_format IN ('numeric', 'integer') THEN 'cascade'
 WHEN kind = 'rule' AND rule.value_format = 'complex_numeric' THEN 'vote' ELSE 'text' END AS reader FROM resolved""")
def cell_dispatch(spark, sf):
    """Which reader a cell goes to: none, the numeric cascade, the fast vote or text."""
    fmt = F.col("rule.value_format")
    rule = F.col("kind") == "rule"
    reader = F.when(F.col("kind").isin("excluded", "fixed"), "skip").when(G.strip(F.col("raw_text")) == "", "blank").when(rule & fmt.isin("numeric", "integer"), "cascade").when(rule & (fmt == "complex_numeric"), "vote").otherwise("text")
    return P._resolved(spark, sf).select("cell_id", reader.alias("reader"))


@query(f"""WITH {P._GRID}, {S.resolved('numbered', 'k')}, m AS (SELECT template_id, cell_row, cell_column FROM resolved WHERE excluded), sel AS (SELECT template_id, cell_row, cell_column FROM resolved WHERE cell_column = 2),
ax AS (SELECT id AS template_id, 'row' AS axis, unnest(excluded_rows) AS i FROM templates UNION ALL SELECT id, 'column', unnest(excluded_columns) FROM templates),
kept AS (SELECT * FROM ax WHERE NOT (axis = 'row' AND EXISTS (SELECT 1 FROM sel WHERE sel.template_id = ax.template_id AND sel.cell_row = ax.i)) AND NOT (axis = 'column' AND EXISTS (SELECT 1 FROM sel WHERE sel.template_id = ax.template_id AND sel.cell_column = ax.i)))
SELECT template_id, axis, i AS cell_row, -1 AS cell_column FROM kept WHERE axis = 'row' UNION ALL SELECT template_id, axis, -1, i FROM kept WHERE axis = 'column'
UNION ALL SELECT template_id, 'cell', cell_row, cell_column FROM m ANTI JOIN sel USING (template_id, cell_row, cell_column) WHERE NOT EXISTS (SELECT 1 FROM kept WHERE kept.template_id = m.template_id AND ((axis = 'row' AND i = m.cell_row) OR (axis = 'column' AND i = m.cell_column)))""")
def exclusion_restore(spark, sf):
    """Column 2 of every template restored: rows it crosses fall back to their single cells."""
    g = P._grid(spark, sf)
    cell = ["template_id", "cell_row", "cell_column"]
    t = _templates(spark, sf).select(F.col("id").alias("template_id"), "excluded_rows", "excluded_columns")
    axes = t.select("template_id", F.lit("row").alias("axis"), F.explode("excluded_rows").alias("index")).union(t.select("template_id", F.lit("column"), F.explode("excluded_columns")))
    kept, single = I.restore(g.where("excluded").select(*cell), axes, g.where("cell_column = 2").select(*cell))
    none = F.lit(-1)
    whole = kept.select("template_id", "axis", F.when(F.col("axis") == "row", F.col("index")).otherwise(none).alias("cell_row"), F.when(F.col("axis") == "column", F.col("index")).otherwise(none).alias("cell_column"))
    return whole.union(single.select("template_id", F.lit("cell"), "cell_row", "cell_column"))


@query("SELECT id AS template_id, list_sort(list_distinct(list_transform(list_concat(row_guides, list_transform(fields, lambda f: f.rect.y), list_transform(fields, lambda f: f.rect.y + f.rect.height)), lambda g: round(g, 6)))) AS ys FROM templates")
def lattice_edges(spark, sf):
    y = lambda f: f["rect"]["y"]
    return _templates(spark, sf).select(F.col("id").alias("template_id"), O.edges(F.col("row_guides"), F.transform("fields", y), F.transform("fields", lambda f: f["rect"]["y"] + f["rect"]["height"])).alias("ys"))


@query("SELECT stored_source_path, id FROM jobs WHERE stored_source_path IS NOT NULL AND status <> 'imported' QUALIFY row_number() OVER (PARTITION BY stored_source_path ORDER BY created_at, id) = 1")
def prepare_again(spark, sf):
    """Stored files to prepare again, each once, with the first job that used it."""
    j = table(spark, sf, "jobs").where("status <> 'imported'").select("stored_source_path", "id", "created_at")
    return O.first_of_each(j, "stored_source_path", "created_at", "id").select("stored_source_path", "id")


@query("SELECT DISTINCT a.id FROM jobs a WHERE a.result_json IS NOT NULL AND NOT EXISTS (SELECT 1 FROM jobs b WHERE b.id = a.id AND b.status = 'exported' AND sha256(b.result_json) = sha256(a.result_json))")
def drafts_kept(spark, sf):
    """Results that differ from what was exported of the same job: equal ones are dropped as drafts."""
    j = table(spark, sf, "jobs").where("id is not null and result_json is not null").select("id", "status", F.sha2("result_json", 256).alias("digest"))
    done = j.where("status = 'exported'").select("id", "digest").distinct()
    return j.join(done, ["id", "digest"], "left_anti").select("id").distinct()


@query("SELECT id AS template_id, f.id AS field_id, x, y, greatest(1, least(round_even(f.rect.width * 1240, 0), 1240 - x))::INTEGER AS width, greatest(1, least(round_even(f.rect.height * 1754, 0), 1754 - y))::INTEGER AS height FROM (SELECT id, f, greatest(0, least(round_even(f.rect.x * 1240, 0), 1239))::INTEGER AS x, greatest(0, least(round_even(f.rect.y * 1754, 0), 1753))::INTEGER AS y FROM (SELECT id, unnest(fields) AS f FROM templates))")
def field_pixels(spark, sf):
    """Field rectangles in pixels of a page of 1240 x 1754."""
    f = _templates(spark, sf).select(F.col("id").alias("template_id"), F.explode("fields").alias("f"))
    return f.select("template_id", F.col("f.id").alias("field_id"), O.pixel_rect(F.col("f.rect"), F.lit(1240), F.lit(1754)).alias("p")).select("template_id", "field_id", "p.*")
