"""Queries over review, export, templates, jobs, answers and geometry."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgermill.functions import grammar as G
from ledgermill.operators import answers as N
from ledgermill.operators import cells as C
from ledgermill.operators import ctc
from ledgermill.operators import export as X
from ledgermill.operators import islands as I
from ledgermill.operators import jobs as J
from ledgermill.operators import review as V
from ledgermill.operators import templates as T
from ledgermill.plans import rules as P
from ledgermill.plans import sqltext as S
from ledgermill.plans.common import query, table

_REVIEW = f"(status = 'automatic' AND len(list_filter(flags_now, lambda f: f NOT IN ({P.NON_BLOCKING}))) > 0)"
_ADDRESS = "'R' || (cell_row + 1) || 'C' || (cell_column + 1)"


# Review


@query(f"""WITH {P._OUT}, o AS (SELECT cell_id, run_id, row_number() OVER (PARTITION BY run_id ORDER BY page_index, cell_row, cell_column, cell_id) AS k, {_REVIEW} AS open FROM flagged)
SELECT cell_id, coalesce(min_by(nxt, nk), min_by(anyid, ak)) AS next_cell_id FROM (SELECT a.cell_id, CASE WHEN b.k > a.k THEN b.cell_id END AS nxt, CASE WHEN b.k > a.k THEN b.k END AS nk, b.cell_id AS anyid, b.k AS ak FROM o a LEFT JOIN (SELECT * FROM o WHERE open) b ON a.run_id = b.run_id) GROUP BY cell_id""")
def next_uncertain(spark, sf):
    return V.next_uncertain(P._flagged(spark, sf))


@query(f"WITH {P._OUT} SELECT run_id, count(*) FILTER (NOT blocked) AS n_confirmable, count(*) FILTER (blocked) AS n_blocked FROM (SELECT run_id, kind = 'rule' AND len({S.errors('c_text', 'rule')}) > 0 AS blocked FROM flagged WHERE {_REVIEW}) GROUP BY run_id")
def confirmable_items(spark, sf):
    return V.confirmable(P._flagged(spark, sf))


@query(f"WITH {P._OUT} SELECT DISTINCT run_id, template_id, page_index, cell_row FROM flagged WHERE {_REVIEW}")
def uncertain_rows(spark, sf):
    return V.uncertain_rows(P._flagged(spark, sf))


@query(f"""WITH {S.constrained()}, ed AS (SELECT cell_id, max(text) AS value FROM digit_checks WHERE text IS NOT NULL GROUP BY cell_id)
SELECT cell_id, CASE WHEN value IS NOT NULL AND status <> 'excluded' THEN trim(value) ELSE c_text END AS final_text,
CASE WHEN value IS NOT NULL AND status <> 'excluded' THEN CASE WHEN trim(value) = coalesce(raw_text, '') THEN 'confirmed' ELSE 'corrected' END ELSE status END AS status FROM readings LEFT JOIN ed USING (cell_id)""")
def confirm_edits(spark, sf):
    """The checked texts as a reviewer's edits."""
    edits = table(spark, sf, "digit_checks").select("cell_id", F.col("text").alias("value"))
    return V.confirm(P._readings(spark, sf), edits).select("cell_id", "final_text", "status")


@query(f"""WITH {S.constrained()} SELECT cell_id, CASE WHEN o THEN '' ELSE c_text END AS excluded_text, CASE WHEN o THEN 'excluded' ELSE status END AS excluded_status, c_text AS restored_text, status AS restored_status FROM (SELECT *, cell_row = 4 AND status <> 'excluded' AS o FROM readings)""")
def axis_exclusion_round_trip(spark, sf):
    """Row 4 of every page excluded and restored again."""
    r = P._readings(spark, sf).withColumn("final", F.col("c.text")).withColumn("suggested", F.lit(""))
    row = F.col("cell_row") == 4
    text, status, suggested, backup = V.exclude(F.col("final"), F.col("status"), F.col("suggested"), row)
    out = r.select("cell_id", "raw_text", "cell_row", text.alias("t"), status.alias("s"), suggested.alias("g"), backup.alias("b"))
    back_text, back_status, _ = V.restore(F.col("t"), F.col("s"), F.col("g"), F.col("raw_text"), F.col("b"), (F.col("cell_row") == 4) & F.col("b").isNotNull())
    return out.select("cell_id", F.col("t").alias("excluded_text"), F.col("s").alias("excluded_status"), back_text.alias("restored_text"), back_status.alias("restored_status"))


# Export


@query(f"""WITH {P._OUT} SELECT cell_id, run_id, template_id, page_index, {_ADDRESS} AS address, reason FROM (SELECT *, CASE WHEN {_REVIEW} THEN 'needs_review' WHEN kind = 'rule' AND status NOT IN ('excluded', 'confirmed', 'corrected') AND len({S.errors('c_text', 'rule')}) > 0 THEN 'breaks_rule' END AS reason FROM flagged) WHERE reason IS NOT NULL""")
def export_gate(spark, sf):
    return X.violations(P._flagged(spark, sf))


_FIRST = "fp AS (SELECT * FROM flagged QUALIFY row_number() OVER (PARTITION BY run_id, template_id, page_index, cell_row, cell_column ORDER BY cell_id) = 1)"
_GRIDH = f"{P._GRID}, " + S.resolved("numbered", "k").replace("base AS", "gbase AS").replace("FROM base b", "FROM gbase b").replace("regions AS", "gregions AS").replace("JOIN regions", "JOIN gregions").replace("best AS", "gbest AS").replace("LEFT JOIN best", "LEFT JOIN gbest").replace("joined AS", "gjoined AS").replace("FROM joined", "FROM gjoined").replace("joined.cell", "gjoined.cell").replace("marked AS", "gmarked AS").replace("FROM marked", "FROM gmarked").replace("resolved AS", "ggrid AS")
_SIMPLE_TEXT = S.full("trim(c_text)", S.SIMPLE)


_FIELDS = """tf AS (SELECT id AS template_id, list_filter(fields, lambda f: f.export_mode = 'repeat') AS rep, list_filter(fields, lambda f: f.export_mode = 'column_group' AND f.column_start IS NOT NULL AND f.column_end IS NOT NULL) AS grp, coalesce(excluded_rows, []) AS t_rows FROM templates)"""
_VALUES = lambda names: f"array_to_string(list_transform(list_filter(rep, lambda f, i: list_position(list_transform(rep, lambda g: g.name), f.name) = i), lambda f: f.name || '=' || {names}), '; ')"


def long_sql(pages: str, value: str) -> str:
    """The normalised export over ``fp`` (first cells of places) and ``pages`` (page keys, out_rows, and what ``value`` reads)."""
    return f"""{_GRIDH}, {_FIELDS},
gdata AS (SELECT template_id, cell_row, cell_column, is_header FROM ggrid WHERE cell_column >= row_label_columns AND own_role = 'data'),
ord AS (SELECT a.template_id, a.cell_row, a.cell_row + 1 - (SELECT count(*) FROM (SELECT DISTINCT p.cell_row FROM ggrid p WHERE p.template_id = a.template_id AND p.cell_row < a.cell_row) q WHERE NOT EXISTS (SELECT 1 FROM gdata x JOIN gdata y ON y.template_id = x.template_id AND y.cell_column = x.cell_column WHERE x.template_id = a.template_id AND x.cell_row = a.cell_row AND NOT x.is_header AND y.cell_row = q.cell_row AND NOT y.is_header)) AS ordinal
 FROM (SELECT DISTINCT template_id, cell_row FROM gdata WHERE NOT is_header) a),
pg AS ({pages}),
pf AS (SELECT pg.*, {_VALUES(value)} AS repeated, grp FROM pg JOIN tf USING (template_id)),
lab AS (SELECT run_id, template_id, page_index, cell_row, string_agg(c_text, ' ' ORDER BY cell_column) AS label FROM fp WHERE cell_column < row_label_columns AND c_text <> '' GROUP BY ALL),
hd AS (SELECT run_id, template_id, page_index, cell_column, string_agg(c_text, ' / ' ORDER BY cell_row) AS header FROM fp WHERE is_header AND cell_row < header_rows AND c_text <> '' GROUP BY ALL)
SELECT fp.cell_id, fp.run_id, fp.template_id, fp.page_index + 1 AS page, repeated, coalesce(list_transform(list_filter(grp, lambda f: fp.cell_column BETWEEN f.column_start AND f.column_end)[1:1], lambda f: {value})[1], '') AS side,
 coalesce(label, cast(coalesce(ordinal, fp.cell_row + 1) AS VARCHAR)) AS source_row, CASE WHEN NOT starts_with(own_name, 'Column ') THEN own_name ELSE coalesce(header, cast(fp.cell_column + 1 AS VARCHAR)) END AS measurement, c_text AS value,
 CASE WHEN num AND {_SIMPLE_TEXT} THEN try_cast({S.plain('trim(c_text)')} AS DOUBLE) END AS number,
 CASE WHEN num AND {_SIMPLE_TEXT} THEN CASE WHEN pl > 0 THEN '0.' || repeat('0', pl) ELSE '0' END ELSE 'General' END AS number_format, status AS review_status, round(c_confidence, 4) AS confidence
FROM (SELECT *, kind = 'rule' AND coalesce(rule.value_format IN ('numeric', 'integer', 'complex_numeric'), false) AND NOT is_label AS num,
  coalesce(CASE WHEN status NOT IN ('confirmed', 'corrected') THEN rule.decimal_places END, length(regexp_extract({S.plain('trim(c_text)')}, '\\.([0-9]+)$', 1)))::INTEGER AS pl FROM fp
  WHERE cell_column >= row_label_columns AND own_role = 'data' AND NOT is_header AND c_text <> '' AND status <> 'excluded' AND NOT excluded) fp
JOIN pf ON pf.run_id = fp.run_id AND pf.template_id = fp.template_id AND pf.page_index = fp.page_index AND NOT list_contains(out_rows, fp.cell_row)
LEFT JOIN lab ON lab.run_id = fp.run_id AND lab.template_id = fp.template_id AND lab.page_index = fp.page_index AND lab.cell_row = fp.cell_row LEFT JOIN ord ON ord.template_id = fp.template_id AND ord.cell_row = fp.cell_row
LEFT JOIN hd ON hd.run_id = fp.run_id AND hd.template_id = fp.template_id AND hd.page_index = fp.page_index AND hd.cell_column = fp.cell_column
UNION ALL SELECT NULL, run_id, template_id, page_index + 1, repeated, '', coalesce(label, cast(ordinal AS VARCHAR)), '', NULL, NULL, 'General', 'excluded', 1.0
FROM (SELECT *, unnest(list_distinct(out_rows)) AS cell_row FROM pf) x JOIN ord USING (template_id, cell_row) LEFT JOIN lab USING (run_id, template_id, page_index, cell_row)"""


_FIXED = "CASE WHEN f.source = 'fixed' THEN coalesce(f.fixed_value, '') ELSE '' END"


@query(f"WITH {P._OUT}, {_FIRST}, " + long_sql("SELECT DISTINCT run_id, template_id, page_index, t_rows AS out_rows FROM flagged JOIN tf USING (template_id)", _FIXED))
def export_long(spark, sf):
    flagged = P._flagged(spark, sf)
    pages = flagged.select(*X.PAGE).distinct().withColumn("excluded_rows", F.lit(None).cast("array<int>")).withColumn("results", F.lit(None).cast("map<string,string>"))
    return X.long_rows(flagged, P._grid(spark, sf), X.page_frame(pages, table(spark, sf, "templates")))


LAYOUT = """lt AS (SELECT id AS template_id, len(row_guides) - 1 AS nr, len(column_guides) - 1 AS nc FROM templates),
sh AS (SELECT run_id, template_id, page_index, cell_row, cell_column, c_text FROM fp WHERE NOT excluded AND status <> 'excluded'),
gr AS (SELECT run_id, template_id, page_index, r::INTEGER AS cell_row, unnest(range(0, nc))::INTEGER AS cell_column FROM (SELECT *, unnest(range(0, nr)) AS r FROM (SELECT DISTINCT run_id, template_id, page_index FROM fp) JOIN lt USING (template_id)))
SELECT run_id, template_id, page_index, cell_row, list(coalesce(c_text, '') ORDER BY cell_column) AS texts FROM gr LEFT JOIN sh USING (run_id, template_id, page_index, cell_row, cell_column) GROUP BY ALL"""


@query(f"WITH {P._OUT}, {_FIRST}, {LAYOUT}")
def export_layout(spark, sf):
    return X.layout(P._flagged(spark, sf), table(spark, sf, "templates"))


@query(f"""WITH {P._OUT} SELECT cell_id, page_index + 1 AS page, 'cell' AS kind, {_ADDRESS} AS address, coalesce(raw_text, '') AS raw_value, c_text AS final_value, round(c_confidence, 4) AS confidence, array_to_string(flags_now, ', ') AS flags, status, template_name AS template, tv.template_version,
 CASE WHEN contains(coalesce(raw_text, ''), ',') THEN 'comma → canonical dot' WHEN contains(coalesce(raw_text, ''), '.') THEN 'dot' WHEN list_contains(flags_now, 'separator_reclassified_from_one') THEN 'OCR 1 → proposed dot from template' WHEN list_contains(flags_now, 'separator_inferred_from_rule') THEN 'missing → proposed dot from template' WHEN contains(c_text, '.') THEN 'dot not present in primary OCR' ELSE '' END AS separator_evidence,
 CASE WHEN kind = 'rule' THEN rule_name ELSE '' END AS applied_rule, c_alternative AS alternatives FROM flagged JOIN (SELECT id, template_version FROM templates) tv ON tv.id = template_id""")
def export_audit(spark, sf):
    return X.audit(P._flagged(spark, sf))


@query("""WITH j AS (SELECT id, regexp_replace(source_name, '\\.[^.]*$', '') AS stem FROM jobs WHERE id IS NOT NULL AND status = 'ready' QUALIFY row_number() OVER (PARTITION BY id ORDER BY updated_at DESC NULLS LAST, received_at DESC NULLS LAST, status) = 1),
k AS (SELECT *, row_number() OVER (PARTITION BY stem ORDER BY md5(id), id) - 1 AS k FROM j),
free AS (SELECT stem, n, row_number() OVER (PARTITION BY stem ORDER BY n) AS k FROM (SELECT stem, unnest(range(2, c + 2 + (SELECT count(DISTINCT stem) FROM j))) AS n FROM (SELECT stem, count(*) AS c FROM j GROUP BY stem)) WHERE stem || '-' || n NOT IN (SELECT stem FROM j))
SELECT id, stem || CASE WHEN k > 0 THEN '-' || n ELSE '' END || '.xlsx' AS file_name FROM k LEFT JOIN free USING (stem, k)""")
def export_names(spark, sf):
    return X.export_names(J.current(table(spark, sf, "jobs").where("status = 'ready'")))


@query("SELECT t.id AS template_id, f.id AS field_id, f.name, CASE WHEN f.source = 'fixed' THEN f.fixed_value ELSE '' END AS value, CASE WHEN f.required AND (f.source <> 'fixed' OR trim(f.fixed_value) = '') THEN 'required_field_empty' ELSE '' END AS errors FROM (SELECT id, unnest(fields) AS f FROM templates) t")
def field_rules(spark, sf):
    """Fields before recognition: fixed values, and which required fields are still empty."""
    t = table(spark, sf, "templates").select(F.col("id").alias("template_id"), F.explode("fields").alias("f"))
    value = F.when(F.col("f.source") == "fixed", F.col("f.fixed_value")).otherwise("")
    rule = F.struct(F.col("f.kind").alias("value_format"), *(F.lit(None).cast("double").alias(c) for c in ("minimum", "maximum")), F.lit(None).cast("int").alias("decimal_places"), F.lit(None).cast("array<string>").alias("allowed_values"), (~F.col("f.required")).alias("allow_empty"), F.lit(False).alias("require_decimal"))
    df = t.select("template_id", F.col("f.id").alias("field_id"), F.col("f.name").alias("name"), value.alias("value"), rule.alias("rule"))
    errors = F.transform(G.hard_errors(F.col("value"), F.col("rule")), lambda e: F.when(e == "required_cell_empty", "required_field_empty").otherwise(e))
    return df.select("template_id", "field_id", "name", "value", F.array_join(errors, ",").alias("errors"))


@query("""SELECT template_id, cell_column, f.id AS field_id, f.fixed_value AS side FROM (SELECT id AS template_id, unnest(range(0, len(column_guides) - 1))::INTEGER AS cell_column, fields FROM templates) t, (SELECT id AS tid, generate_subscripts(fields, 1) AS seq, unnest(fields) AS f FROM templates) x
WHERE tid = template_id AND f.export_mode = 'column_group' AND cell_column BETWEEN f.column_start AND f.column_end QUALIFY row_number() OVER (PARTITION BY template_id, cell_column ORDER BY seq) = 1""")
def column_groups(spark, sf):
    """The first column-group field that covers each grid column."""
    t = table(spark, sf, "templates").where("size(column_guides) > 1").withColumn("cell_column", F.explode(F.sequence(F.lit(0), F.size("column_guides") - 2)))
    hit = F.get(F.filter("fields", lambda f: (f["export_mode"] == "column_group") & (f["column_start"] <= F.col("cell_column")) & (F.col("cell_column") <= f["column_end"])), F.lit(0))
    return t.withColumn("f", hit).where("f is not null").select(F.col("id").alias("template_id"), "cell_column", F.col("f.id").alias("field_id"), F.col("f.fixed_value").alias("side"))


# Templates

_LATEST = "latest AS (SELECT * FROM templates QUALIFY row_number() OVER (PARTITION BY coalesce(nullif(family_id, ''), id) ORDER BY template_version DESC NULLS LAST, id) = 1)"


@query(f"WITH {_LATEST} SELECT id, name, template_version FROM latest")
def template_latest(spark, sf):
    return T.latest(table(spark, sf, "templates")).select("id", "name", "template_version")


@query("SELECT coalesce(nullif(family_id, ''), id) AS family_id, coalesce(max(template_version), 0) + 1 AS next_version FROM templates GROUP BY 1")
def template_next_version(spark, sf):
    return T.next_versions(table(spark, sf, "templates"))


@query("SELECT id FROM templates t WHERE NOT EXISTS (SELECT 1 FROM templates s WHERE s.template_version >= 5 AND s.family_id = t.family_id)")
def template_install(spark, sf):
    """Templates from version 5 on stand for installed families: the others are still to install."""
    t = table(spark, sf, "templates")
    return t.join(t.where("template_version >= 5").select("family_id").distinct(), "family_id", "left_anti").select("id")


def _pages(spark, sf):
    """Detected grids: every template's own grid with the guides moved a little, as a page found it; even versions print their title."""
    t = table(spark, sf, "templates").where(F.col("id").isNotNull())
    moved = lambda c: F.transform(c, lambda g: g * 0.98 + 0.01)
    title = F.when(F.col("template_version") % 2 == 0, F.concat(F.lit("Form: "), "name", F.lit(", page 1"))).otherwise("")
    return t.select(F.col("id").alias("page_id"), title.alias("title"), F.struct(moved(F.col("row_guides")).alias("row_guides"), moved(F.col("column_guides")).alias("column_guides"), F.col("table_rect").alias("table_rect"), F.coalesce("reference_page_aspect", F.lit(1.0)).alias("aspect"), F.when(F.col("detect_crossed_rows"), 1).otherwise(0).alias("n_warnings")).alias("d"))


def _latest(spark, sf):
    return T.latest(table(spark, sf, "templates")).select(F.col("id").alias("template_id"), F.col("name"), F.struct("row_guides", "column_guides", "table_rect", "header_rows", "auto_fit_rows", "reference_page_aspect", "fields").alias("t"))


def _matches(spark, sf):
    """Each page against all latest templates (their number is checked)."""
    return T.against(_pages(spark, sf), _latest(spark, sf))


_NORM = lambda g: f"list_transform({g}, lambda v: (v - {g}[1]) / greatest(1e-9, {g}[-1] - {g}[1]))"
_APART = lambda a, b: f"list_transform(range(1, len({a}) + 1), lambda i: abs(({_NORM(a)})[i] - ({_NORM(b)})[i]))"
_GUIDE = lambda a, b: f"(CASE WHEN len({a}) <> len({b}) OR len({a}) < 2 THEN 0.0 ELSE greatest(0.0, 1.0 - list_sum({_APART(a, b)}) / len({a}) * 4.0) END)"
_DIFF = lambda g: f"list_transform(range(1, len({g})), lambda i: {g}[i + 1] - {g}[i])"
_BODY = lambda g: f"list_slice({_DIFF(g)}, header_rows + 1, 100000)"
_HEAD = lambda g: f"list_transform(list_slice({_DIFF(g)}, 1, header_rows), lambda h: h / list_median({_BODY(g)}))"
_UNEVEN = lambda g: f"(list_max(list_transform({_BODY(g)}, lambda h: abs(h / list_median({_BODY(g)}) - 1))) > 0.15)"
_PAGES = f"""{_LATEST}, pages AS (SELECT id AS page_id, CASE WHEN template_version % 2 = 0 THEN 'Form: ' || name || ', page 1' ELSE '' END AS title, list_transform(row_guides, lambda g: g * 0.98 + 0.01) AS dr, list_transform(column_guides, lambda g: g * 0.98 + 0.01) AS dc, table_rect AS drect, coalesce(reference_page_aspect, 1.0) AS aspect, CASE WHEN detect_crossed_rows THEN 1 ELSE 0 END AS n_warnings FROM templates WHERE id IS NOT NULL),
pairs AS (SELECT p.*, l.fields, l.id AS template_id, l.name, l.row_guides AS tr, l.column_guides AS tc, l.table_rect AS trect, l.header_rows, l.auto_fit_rows, l.reference_page_aspect FROM pages p, latest l),
fit AS (SELECT *, CASE WHEN n_warnings > 0 THEN 'grid_needs_checking' WHEN len(tc) <> len(dc) THEN 'other_column_count' WHEN NOT (header_rows < len(dr) - 1 AND len(dr) - 1 <= 200) THEN 'invalid_row_count'
 WHEN list_min({_DIFF('tc')}) <= 0 OR list_min({_DIFF('dc')}) <= 0 OR list_min({_DIFF('tr')}) <= 0 OR list_min({_DIFF('dr')}) <= 0 THEN 'invalid_coordinates'
 WHEN list_max({_APART('tc', 'dc')}) > 0.025 THEN 'other_column_proportions'
 WHEN len(tr) = len(dr) AND list_max({_APART('tr', 'dr')}) > 0.035 THEN 'other_row_structure'
 WHEN len(tr) <> len(dr) AND ({_UNEVEN('tr')} OR {_UNEVEN('dr')}) THEN 'uneven_rows'
 WHEN len(tr) <> len(dr) AND header_rows > 0 AND coalesce(list_max(list_transform(range(1, header_rows + 1), lambda i: abs(({_HEAD('tr')})[i] - ({_HEAD('dr')})[i]))), 0.0) > 0.15 THEN 'other_header_proportions' END AS problem FROM pairs)"""


@query(f"WITH {_PAGES} SELECT page_id, template_id, problem FROM fit WHERE len(tc) = len(dc)")
def template_fit_check(spark, sf):
    """Fit of every page and latest template of as many columns (others cannot fit): an equi-join on that number."""
    n = lambda c: F.size(F.col(c)["column_guides"])
    both = _pages(spark, sf).withColumn("n", n("d")).join(_latest(spark, sf).withColumn("n", n("t")), "n")
    return both.select("page_id", "template_id", T.fit_problem(F.col("t"), F.col("d")).alias("problem"))


_TOKENS = lambda t: f"trim(lower(regexp_replace({t}, '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g')))"
_SCORES = f"""{_PAGES}, named AS (SELECT *, length({_TOKENS('name')}) >= 4 AND contains(' ' || {_TOKENS('title')} || ' ', ' ' || {_TOKENS('name')} || ' ') AS hit FROM fit),
parts AS (SELECT *, bool_or(hit) OVER (PARTITION BY page_id) AS any_hit, coalesce(auto_fit_rows, false) AND problem IS NULL AS fitted,
 CASE WHEN coalesce(auto_fit_rows, false) AND problem IS NULL THEN 1.0 ELSE exp(-abs((len(dr) - 1) - (len(tr) - 1)) / greatest(1.0, (len(tr) - 1) * 0.18)) END AS s_row,
 exp(-abs((len(dc) - 1) - (len(tc) - 1)) / greatest(1.0, (len(tc) - 1) * 0.18)) AS s_col,
 CASE WHEN coalesce(auto_fit_rows, false) AND problem IS NULL THEN 1.0 ELSE {_GUIDE('tr', 'dr')} END AS s_shape, {_GUIDE('tc', 'dc')} AS s_cshape,
 greatest(0.0, 1.0 - (abs(trect.x - drect.x) + abs(trect.y - drect.y) + abs(trect.width - drect.width) + abs(trect.height - drect.height)) / 0.8) AS s_rect,
 CASE WHEN coalesce(reference_page_aspect, 0) = 0 THEN 0.5 ELSE greatest(0.0, 1.0 - abs(aspect - reference_page_aspect) / greatest(aspect, reference_page_aspect)) END AS s_aspect FROM named),
sc AS (SELECT *, (0.27 * s_row + 0.31 * s_col + 0.15 * s_rect + 0.10 * s_aspect + 0.17 * (s_shape + s_cshape) / 2) * CASE WHEN any_hit AND NOT hit THEN 0.70 ELSE 1.0 END AS s FROM parts),
ranked AS (SELECT *, coalesce(auto_fit_rows, false) AND problem IS NOT NULL AS fit_error, CASE WHEN auto_fit_rows AND problem IS NOT NULL THEN round(s * 0.49, 4) WHEN n_warnings > 0 THEN round(least(s, 0.49), 4) ELSE round(greatest(0.0, least(1.0, s)), 4) END AS score FROM sc)"""
SQL_RANK = f"WITH {_SCORES} SELECT page_id, template_id, score FROM ranked"


def _ranked(spark, sf):
    m = _matches(spark, sf).withColumn("hit", T.title_matches(F.col("title"), F.col("name"))).withColumn("any_hit", F.max("hit").over(Window.partitionBy("page_id")))
    error = F.coalesce(F.col("t.auto_fit_rows"), F.lit(False)) & T.fit_problem(F.col("t"), F.col("d")).isNotNull()
    return m.withColumn("score", T.match_score(F.col("t"), F.col("d"), F.col("hit"), F.col("any_hit"))).withColumn("fit_error", error)


@query(SQL_RANK)
def template_rank(spark, sf):
    """Score of every page and latest template; a page that prints another template's name lowers the rest."""
    return _ranked(spark, sf).select("page_id", "template_id", "score")


_CHOICE = f"""{_SCORES}, placed AS (SELECT *, lead(CASE WHEN NOT fit_error THEN score END) OVER w AS nxt, row_number() OVER w AS place FROM ranked WINDOW w AS (PARTITION BY page_id ORDER BY fit_error, score DESC, lower(name), template_id))"""


@query(f"WITH {_CHOICE} SELECT page_id, template_id, coalesce(abs(score - nxt) < 0.04, false) AS ambiguous FROM placed WHERE place = 1")
def template_choice(spark, sf):
    """The best template of each page and whether another one is as near."""
    return T.chosen(_ranked(spark, sf).select("page_id", "template_id", "name", "score", "fit_error"))


@query("SELECT id AS page_id, (SELECT min(id) FROM templates) AS template_id, false AS ambiguous FROM templates WHERE id IS NOT NULL")
def template_choice_common(spark, sf):
    """One protocol for all pages overrides their own choices."""
    common = table(spark, sf, "templates").agg(F.min("id").alias("template_id"))
    return T.chosen(_ranked(spark, sf).select("page_id", "template_id", "name", "score", "fit_error"), common)


_RECT = "(1.0 - (abs(trect.x - drect.x) + abs(trect.y - drect.y) + abs(trect.width - drect.width) + abs(trect.height - drect.height)) / 0.8)"


@query(f"""WITH {_SCORES} SELECT template_id, min(round(score * 100))::INTEGER AS score, count(*) AS n_pages, min(score) >= 0.55 AS offered, array_to_string(list_sort(list_distinct(flatten(list(list_filter([printf('grid %dx%d', len(tr) - 1, len(tc) - 1), CASE WHEN len(tr) = len(dr) THEN 'rows match' WHEN fitted THEN 'rows will be fitted' ELSE 'rows differ' END,
 CASE WHEN len(tc) = len(dc) THEN 'columns match' ELSE 'columns differ' END, CASE WHEN s_aspect > 0.9 THEN 'page aspect matches' END, CASE WHEN s_rect > 0.85 THEN 'table lies alike' END], lambda x: x IS NOT NULL))))), '; ') AS reasons FROM ranked GROUP BY template_id""")
def document_compatibility(spark, sf):
    """A document is as compatible with a template as its worst page; only scores from 0.55 on are offered; reasons of all pages."""
    per = _ranked(spark, sf).withColumn("why", T.reasons(F.col("t"), F.col("d"))).groupBy("template_id").agg(F.min("score").alias("s"), F.min(F.round(F.col("score") * 100)).cast("int").alias("score"), F.count("*").alias("n_pages"), F.array_distinct(F.flatten(F.collect_set("why"))).alias("why"))
    return per.select("template_id", "score", "n_pages", (F.col("s") >= 0.55).alias("offered"), F.array_join(F.array_sort("why"), "; ").alias("reasons"))


@query(f"""WITH {_PAGES}, k AS (SELECT *, (dc[-1] - dc[1]) / (tc[-1] - tc[1]) AS sx, CASE WHEN coalesce(reference_page_aspect, 0) <> 0 THEN (dc[-1] - dc[1]) / (tc[-1] - tc[1]) * aspect / reference_page_aspect ELSE list_median({_DIFF('dr')}) / list_median({_DIFF('tr')}) END AS sy FROM fit WHERE len(tc) = len(dc) AND problem IS NULL),
f AS (SELECT page_id, template_id, tr, sx, sy, dr, dc, tc, unnest(fields) AS f FROM k),
m AS (SELECT page_id, template_id, f.id AS field_id, dc[1] + (f.rect.x - tc[1]) * sx AS x, CASE WHEN f.rect.y >= tr[-1] THEN dr[-1] + (f.rect.y - tr[-1]) * sy ELSE dr[1] + (f.rect.y - tr[1]) * sy END AS y, f.rect.width * sx AS w, f.rect.height * sy AS h, f.rect.y < tr[-1] AND f.source <> 'fixed' AND f.rect.y + f.rect.height > tr[1] AS inside FROM f)
SELECT page_id, template_id, field_id, CASE WHEN inside THEN 'field_inside_table' WHEN x < -0.002 OR y < -0.002 OR x + w > 1.002 OR y + h > 1.002 THEN 'field_outside_page' END AS problem, round(greatest(0.0, x), 6) AS x, round(greatest(0.0, y), 6) AS y, round(w, 6) AS width, round(h, 6) AS height FROM m""")
def template_fitted_fields(spark, sf):
    """Where a fitting template's fields lie on each page."""
    n = lambda c: F.size(F.col(c)["column_guides"])
    both = _pages(spark, sf).withColumn("n", n("d")).join(_latest(spark, sf).withColumn("n", n("t")), "n").where(T.fit_problem(F.col("t"), F.col("d")).isNull())
    f = both.select("page_id", "template_id", F.explode(T.fitted_fields(F.col("t"), F.col("d"))["fields"]).alias("f"))
    return f.select("page_id", "template_id", F.col("f.id").alias("field_id"), "f.problem", *(F.round(f"f.{c}", 6).alias(c) for c in ("x", "y", "width", "height")))


@query("SELECT id || '-new' AS id, 0 AS template_version, len(row_guides) - 1 AS n_rows, len(column_guides) - 1 AS n_columns FROM templates WHERE id IS NOT NULL")
def template_new(spark, sf):
    t = T.new_template(_pages(spark, sf))
    return t.select("id", "template_version", (F.size("row_guides") - 1).alias("n_rows"), (F.size("column_guides") - 1).alias("n_columns"))


@query(f"WITH {_PAGES} SELECT page_id, template_id FROM (SELECT *, length({_TOKENS('name')}) >= 4 AND contains(' ' || {_TOKENS('title')} || ' ', ' ' || {_TOKENS('name')} || ' ') AS hit FROM fit) WHERE hit")
def title_named(spark, sf):
    """Pages that print a latest template's name as whole words."""
    return _matches(spark, sf).where(T.title_matches(F.col("title"), F.col("name"))).select("page_id", "template_id")


@query(f"""WITH names AS (SELECT list(name ORDER BY id) AS names FROM templates), d AS (SELECT doc_id, coalesce(title, '') || CASE WHEN doc_id % 2 = 0 THEN ' - ' || names[doc_id % len(names) + 1] ELSE '' END AS title FROM documents, names)
SELECT DISTINCT doc_id, t.id AS template_id FROM d, templates t WHERE length({_TOKENS('t.name')}) >= 4 AND contains(' ' || {_TOKENS('d.title')} || ' ', ' ' || {_TOKENS('t.name')} || ' ')""")
def title_match(spark, sf):
    """Documents whose title names a protocol as whole words; even documents get a protocol's name appended.

    Titles meet names on every run of as many words as some name has, so the join is an
    equi-join and not a cross join.
    """
    t = table(spark, sf, "templates")
    names = t.agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "name"))), lambda x: x["name"]).alias("names"))
    phrases = t.select(F.col("id").alias("template_id"), T.title_tokens(F.col("name")).alias("phrase")).where("length(phrase) >= 4")
    longest = phrases.agg(F.max(F.size(F.split("phrase", " ")))).first()[0] or 0
    appended = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit(" - "), F.get("names", (F.col("doc_id") % F.size("names")).cast("int")))).otherwise("")
    d = table(spark, sf, "documents").select("doc_id", "title").join(F.broadcast(names)).select("doc_id", F.split(T.title_tokens(F.concat(F.coalesce("title", F.lit("")), appended)), " ").alias("w"))  # one row of names
    runs = F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.lit(max(1, longest))), lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.size("w"), F.lit(1))), lambda i: F.array_join(F.slice("w", i, n), " ")))))
    return d.select("doc_id", F.explode(runs).alias("phrase")).join(phrases, "phrase").select("doc_id", "template_id").distinct()


@query("""WITH s AS (SELECT cell_id AS file, (evidence_id % 4) * 90 AS rotation, support AS score, support >= 0.2 AS ok FROM (SELECT DISTINCT evidence_id, cell_id, support FROM evidence)),
p AS (SELECT file, rotation, min(round(score * 100))::INTEGER AS score, min(ok::INTEGER) AS ok FROM s GROUP BY ALL),
r AS (SELECT *, row_number() OVER w AS place, lead(score) OVER w AS nxt, lead(ok) OVER w AS nok FROM p WINDOW w AS (PARTITION BY file ORDER BY ok DESC, score DESC, rotation))
SELECT file, rotation, score, ok = 1 AND coalesce(nok, 0) = 1 AND score - nxt < 4 AS uncertain FROM r WHERE place = 1""")
def orientation_choice(spark, sf):
    """Worst page per rotation and best rotation per file; evidence stands for page scores."""
    e = table(spark, sf, "evidence").select("evidence_id", "cell_id", "support").distinct()
    scores = e.select(F.col("cell_id").alias("file"), ((F.col("evidence_id") % 4) * 90).alias("rotation"), F.col("support").alias("score"), (F.col("support") >= 0.2).alias("ok"))
    return T.best_orientation(scores)


# Jobs, queue, uploads


@query("SELECT id, source_name, status, updated_at FROM jobs WHERE instr(lower(source_name), 'scan_') > 0 ORDER BY updated_at DESC, created_at DESC, id DESC LIMIT 20 OFFSET 20")
def history_search_page(spark, sf):
    return J.page(J.search(table(spark, sf, "jobs"), "scan_"), 20, 20).select("id", "source_name", "status", "updated_at")


@query("SELECT count(*) AS n FROM jobs WHERE instr(lower(source_name), 'scan_') > 0")
def history_count(spark, sf):
    return J.search(table(spark, sf, "jobs"), "SCAN_").agg(F.count("*").alias("n"))


@query("SELECT id, status, updated_at FROM jobs WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY updated_at DESC NULLS LAST, received_at DESC NULLS LAST, status) = 1")
def jobs_current(spark, sf):
    return J.current(table(spark, sf, "jobs")).select("id", "status", "updated_at")


@query("SELECT id, strftime(CAST(replace(replace(created_at, ' ', 'T'), 'Z', '+00:00') AS TIMESTAMPTZ), '%Y-%m-%dT%H:%M:%S') AS created_utc FROM (SELECT DISTINCT id, created_at FROM jobs WHERE regexp_full_match(created_at, '[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}:[0-9]{2}(Z|[+-][0-9]{2}:[0-9]{2})'))")
def jobs_created_utc(spark, sf):
    """The usual spellings of ``created_at`` as one UTC text."""
    j = table(spark, sf, "jobs").select("id", "created_at").distinct().where(F.col("created_at").rlike(r"\A\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(Z|[+-]\d{2}:\d{2})\z"))
    return j.select("id", F.date_format(F.col("created_at").try_cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss").alias("created_utc"))


#: Event types of the stream table as queue events; even event ids take the first, odd ones the second.
_EVENT = {"view": ("enqueue", "retry"), "click": ("start", "cancel"), "signup": ("complete", "review"), "purchase": ("export", "restart"), "error": ("fail", "enqueue")}


def queue_events(spark, sf):
    """The event stream as queue events of all kinds: a user is a job."""
    kind = F.create_map(*(F.lit(x) for k, (a, b) in _EVENT.items() for x in (f"{k}0", a, f"{k}1", b)))
    key = F.concat("event_type", (F.col("event_id") % 2).cast("string"))
    return table(spark, sf, "events").select(F.col("user_id").alias("job_id"), F.col("ts").alias("at"), F.col("event_id").alias("seq"), F.try_element_at(kind, key).alias("event")).where("event is not null")


_CASES = " ".join(f"WHEN event = '{e}' AND state IN ({', '.join(repr(s) for s in states)}) THEN '{to}'" for e, states, to in J.TRANSITIONS)


@query(f"""WITH RECURSIVE ev AS (SELECT user_id AS job_id, CASE event_type || event_id % 2 {' '.join(f"WHEN '{k}{i}' THEN '{e}'" for k, two in _EVENT.items() for i, e in enumerate(two))} END AS event, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
f AS (SELECT job_id, 0::BIGINT AS k, '' AS state, 0 AS illegal FROM (SELECT DISTINCT job_id FROM ev) UNION ALL
 SELECT job_id, k, to_state, illegal + CASE WHEN to_state = state AND NOT (event = 'export' AND state = 'exported') AND NOT (event = 'review' AND state = 'ready') THEN 1 ELSE 0 END FROM (SELECT f.job_id, ev.k, event, state, illegal, CASE {_CASES} ELSE state END AS to_state FROM f JOIN ev ON ev.job_id = f.job_id AND ev.k = f.k + 1))
SELECT job_id, state, k::INTEGER AS n_events, illegal AS n_illegal FROM f QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY k DESC) = 1""")
def queue_fold(spark, sf):
    return J.fold(queue_events(spark, sf))


_UP = "up AS (SELECT evidence_id AS upload_id, sha256(coalesce(value_text, '')) AS sha FROM evidence)"


@query(f"WITH {_UP} SELECT upload_id, min(sha) AS sha256, count(*) AS n_sent FROM up GROUP BY upload_id HAVING count(DISTINCT sha) = 1")
def upload_dedup(spark, sf):
    e = table(spark, sf, "evidence").select(F.col("evidence_id").alias("upload_id"), F.sha2(F.coalesce("value_text", F.lit("")), 256).alias("sha256"))
    return J.uploads(e)[0]


@query("SELECT cell_id AS upload_id, count(DISTINCT sha256(coalesce(value_text, ''))) AS n_contents FROM evidence GROUP BY cell_id HAVING count(DISTINCT sha256(coalesce(value_text, ''))) > 1")
def upload_conflicts(spark, sf):
    e = table(spark, sf, "evidence").select(F.col("cell_id").alias("upload_id"), F.sha2(F.coalesce("value_text", F.lit("")), 256).alias("sha256"))
    return J.uploads(e)[1]


@query("SELECT doc_id FROM documents WHERE sha256(coalesce(text, '')) IN (SELECT sha256(coalesce(text, '')) FROM documents WHERE lang = 'en') AND source IN (SELECT source FROM documents WHERE lang = 'en')")
def checkpoint_resume(spark, sf):
    """Documents as pages: those whose digest and source stand among the stored (English) ones need no work."""
    d = table(spark, sf, "documents").select("doc_id", "lang", F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"), "source")
    stored = d.where("lang = 'en'")
    return d.join(stored.select("digest").distinct(), "digest", "left_semi").join(stored.select("source").distinct(), "source", "left_semi").select("doc_id")


# Answers and geometry


_UNIT = "run_id, template_id, page_index"


@query(f"SELECT {_UNIT}, cell_row + 1 AS row, list(text ORDER BY cell_column, cell_id) AS vals FROM ocr_cells WHERE text IS NOT NULL GROUP BY {_UNIT}, cell_row")
def json_rows(spark, sf):
    """Round trip: the rows of every page, those of one width as one JSON answer, written and parsed again."""
    c = table(spark, sf, "ocr_cells").where("text is not null")
    unit = _UNIT.split(", ")
    rows = c.groupBy(*unit, "cell_row").agg(F.transform(F.array_sort(F.collect_list(F.struct("cell_column", "cell_id", "text"))), lambda x: x["text"]).alias("values"))
    said = rows.groupBy(*unit, F.size("values").alias("width")).agg(F.concat(F.lit("```json\n"), F.to_json(F.collect_list(F.struct((F.col("cell_row") + 1).alias("row"), "values"))), F.lit("```")).alias("answer"))
    return said.select(*unit, F.inline(N.table_rows(F.col("answer"), F.lit(200), F.col("width")))).select(*unit, "row", F.col("values").alias("vals"))


@query(f"""WITH s AS (SELECT cell_id, list(v ORDER BY v) AS vals FROM (SELECT DISTINCT cell_id, {S.plain('trim(value_text)')} AS v FROM evidence WHERE {S.full('trim(value_text)', S.SIMPLE)}) GROUP BY cell_id),
f AS (SELECT *, unnest(['bars', 'json', 'list', 'html', 'header', 'blanks']) AS form FROM s) SELECT cell_id, form, array_to_string(vals, ';') AS vals FROM f""")
def row_values(spark, sf):
    """The distinct readings of a cell as a model might answer with them, in six forms, each parsed again."""
    e = table(spark, sf, "evidence").where(G.is_simple(F.col("value_text"))).select("cell_id", G.plain(G.strip(F.col("value_text"))).alias("v")).distinct()
    per = e.groupBy("cell_id").agg(F.array_sort(F.collect_list("v")).alias("v"))
    joined = lambda start, between, end: F.concat(F.lit(start), F.array_join("v", between), F.lit(end))
    forms = {
        "bars": joined("| ", " | ", " |"), "json": F.concat(F.lit("```json\n"), F.to_json("v"), F.lit("\n```")), "list": joined("['", "', '", "']"), "html": joined("<table><tr><th>#</th></tr><tr><td>", "</td><td><b>", "</b></td></tr></table>"),
        "header": joined("<tr><th></th><th>", "</th><th>", "</th></tr>"), "blanks": joined("\\(", "  ", "\\)"),
    }
    said = per.select("cell_id", F.size("v").alias("n"), F.explode(F.array(*(F.struct(F.lit(k).alias("form"), a.alias("answer")) for k, a in forms.items()))).alias("x"))
    return said.select("cell_id", "x.form", F.array_join(N.row_values(F.col("x.answer"), F.col("n")), ";").alias("vals"))


@query("SELECT id, sha256(to_json({'a': name, 'b': template_version})) AS digest FROM templates")
def canonical_digest(spark, sf):
    return table(spark, sf, "templates").select("id", N.digest(F.struct(F.col("name").alias("a"), F.col("template_version").alias("b"))).alias("digest"))


@query("""WITH m AS (SELECT l_suppkey, l_extendedprice, CASE WHEN l_extendedprice - lag(l_extendedprice) OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice) > 500 THEN 1 ELSE 0 END AS new FROM lineitem),
i AS (SELECT *, sum(new) OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice) AS island FROM m)
SELECT l_suppkey, min(l_extendedprice) AS first, round_even(avg(l_extendedprice), 0)::BIGINT AS center, count(*) AS n FROM i GROUP BY l_suppkey, island""")
def islands_lines(spark, sf):
    return I.clusters(table(spark, sf, "lineitem").select("l_suppkey", "l_extendedprice"), "l_suppkey", "l_extendedprice", 500)


@query(f"""WITH {P._GRID}, {S.resolved('numbered', 'k')}, c AS (SELECT template_id, cell_row, cell_column, cell_column - row_number() OVER (PARTITION BY template_id, cell_row ORDER BY cell_column) AS g FROM resolved WHERE excluded),
r AS (SELECT template_id, cell_row, min(cell_column) AS column_start, max(cell_column) AS column_end FROM c GROUP BY template_id, cell_row, g),
s AS (SELECT *, cell_row - row_number() OVER (PARTITION BY template_id, column_start, column_end ORDER BY cell_row) AS st FROM r)
SELECT template_id, min(cell_row) AS row_start, max(cell_row) AS row_end, column_start, column_end FROM s GROUP BY template_id, column_start, column_end, st""")
def islands_rectangles(spark, sf):
    return I.rectangles(P._grid(spark, sf).where("excluded"), "template_id", "cell_row", "cell_column")


@query(f"""WITH {P._GRID}, {S.resolved('numbered', 'k')}, x AS (SELECT template_id, cell_row, cell_column, n_rows, n_columns FROM resolved WHERE excluded),
fr AS (SELECT template_id, cell_row FROM x GROUP BY template_id, cell_row, n_columns HAVING count(*) = n_columns), fc AS (SELECT template_id, cell_column FROM x GROUP BY template_id, cell_column, n_rows HAVING count(*) = n_rows)
SELECT template_id, 'row' AS axis, cell_row, -1 AS cell_column FROM fr UNION ALL SELECT template_id, 'column', -1, cell_column FROM fc UNION ALL SELECT template_id, 'cell', cell_row, cell_column FROM x WHERE NOT EXISTS (SELECT 1 FROM fr WHERE fr.template_id = x.template_id AND fr.cell_row = x.cell_row) AND NOT EXISTS (SELECT 1 FROM fc WHERE fc.template_id = x.template_id AND fc.cell_column = x.cell_column)""")
def exclusion_promote(spark, sf):
    """The exclusion mask written with whole rows and columns where it fills them."""
    x = P._grid(spark, sf).where("excluded").select("template_id", "cell_row", "cell_column", F.col("t.rows").alias("r"), F.col("t.columns").alias("c"))
    rows, columns, single = I.promote(x, F.col("r"), F.col("c"))
    none = F.lit(-1)
    return rows.select("template_id", F.lit("row").alias("axis"), "cell_row", none.alias("cell_column")).union(columns.select("template_id", F.lit("column"), none, "cell_column")).union(single.select("template_id", F.lit("cell"), "cell_row", "cell_column"))


@query("SELECT id AS template_id, i::INTEGER AS i, round(table_rect.y + table_rect.height * i / 10, 9) AS y FROM (SELECT id, table_rect, unnest(range(0, 11)) AS i FROM templates)")
def even_guides(spark, sf):
    t = table(spark, sf, "templates")
    return t.select(F.col("id").alias("template_id"), F.posexplode(T.even_guides(F.col("table_rect.y"), F.col("table_rect.height"), F.lit(10))).alias("i", "y")).select("template_id", "i", F.round("y", 9).alias("y"))


def _matrices(spark, sf):
    """A sharp CTC matrix for each reading that is a simple number: blanks between glyphs, 0.9 on the path."""
    alphabet = ["", *"0123456789.-"]
    c = table(spark, sf, "ocr_cells").where(G.full(G.plain(F.coalesce("text", F.lit(""))), r"-?\d+(?:\.\d+)?"))
    letters = F.array(*(F.lit(a) for a in alphabet))
    text = G.plain(F.col("text"))
    path = F.flatten(F.transform(F.filter(F.split(text, ""), lambda g: g != ""), lambda g: F.array(g, F.lit(""))))
    row = lambda g: F.transform(letters, lambda a: F.when(a == g, 0.9).otherwise(0.1 / (len(alphabet) - 1)))
    return c.select(F.col("cell_id").alias("key"), text.alias("text"), F.transform(path, row).alias("probabilities"), letters.alias("characters"), F.array_distinct(F.transform(F.concat(F.array("text"), F.coalesce("candidates", F.array().cast("array<string>"))), G.plain)).alias("candidates"))


@query()
def ctc_forward(spark, sf):
    return ctc.likelihoods(_matrices(spark, sf))


_ROOM = "CASE WHEN rule.minimum IS NULL AND rule.maximum IS NULL THEN 10 ELSE least(12, 2 + length(cast(floor(greatest(coalesce(abs(rule.minimum), 0), coalesce(abs(rule.maximum), 0))) AS BIGINT)::VARCHAR)) END"


@query(f"""WITH {S.resolved()} SELECT cell_id AS key, t AS text FROM (SELECT *, translate(text, ',−０１２３４５６７８９', '.-0123456789') AS t FROM resolved) WHERE kind = 'rule' AND rule.value_format IN ('numeric', 'integer') AND regexp_full_match(t, '-?[0-9]+(\\.[0-9]+)?') AND len({S.errors('t', 'rule')}) = 0 AND length(regexp_extract(t, '^-?([0-9]+)', 1)) <= {_ROOM}""")
def ctc_beam(spark, sf):
    """Numbers that obey their rule and its digit room are the best allowed strings of their matrices, found by the full beam."""
    rules = P._resolved(spark, sf).where((F.col("kind") == "rule") & F.col("rule.value_format").isin("numeric", "integer")).select(F.col("cell_id").alias("key"), "rule")
    m = _matrices(spark, sf).join(rules, "key").where(G.valid(F.col("text"), F.col("rule")) & (F.length(F.regexp_extract("text", r"\A-?(\d+)", 1)) <= ctc.digit_room(F.col("rule"))))
    return ctc.decoded(m).where("rank = 0").select("key", "text")


@query("""WITH l AS (SELECT id, list_transform(range(0, 24), lambda i: (100 + i * (12 + (hash_ % 40)))::INTEGER) AS g, hash_ % 20 + 2 AS gone FROM (SELECT id, len(name) * 7 + template_version AS hash_ FROM templates))
SELECT id, g AS lines, true AS rebuilt FROM l""")
def regular_lattice(spark, sf):
    """Even rows of 12 to 51 pixels with one line lost, found again from the rest."""
    t = table(spark, sf, "templates").select("id", (F.length("name") * 7 + F.col("template_version")).alias("h"))
    line = lambda i: (100 + i * (12 + F.col("h") % 40)).cast("int")
    seen = F.transform(F.filter(F.sequence(F.lit(0), F.lit(23)), lambda i: i != F.col("h") % 20 + 2), line)
    return t.select("id", I.regular_lattice(seen).alias("x")).select("id", "x.lines", "x.rebuilt")
