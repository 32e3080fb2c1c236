"""Queries over saved results: outliers on full pages, the whole export, the gate and the status on save."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgermill.functions import grammar as G
from ledgermill.operators import checks as K
from ledgermill.operators import export as X
from ledgermill.operators.results import Results
from ledgermill.plans import rules as P
from ledgermill.plans import sqltext as S
from ledgermill.plans import workflow as W
from ledgermill.plans.common import query, table

_PICK = lambda j, *names: "coalesce(" + ", ".join(f"json_extract_string({j}, '$.{n}')" for n in names) + ")"
_INTS = lambda t: f"list_filter(list_transform(string_split(regexp_replace(coalesce({t}, ''), '[\\[\\]\" ]', '', 'g'), ','), lambda x: try_cast(nullif(x, '') AS INTEGER)), lambda x: x IS NOT NULL)"
_PLACE = lambda j, m: f"coalesce(try_cast(json_extract_string({j}, '$.{m}') AS DOUBLE)::INTEGER, -1)"
_EACH = lambda source, list_, keep: f"(SELECT {keep}, unnest(list_) AS x, generate_subscripts(list_, 1) - 1 AS i FROM (SELECT {keep}, json_extract({list_}) AS list_ FROM {source}))"

_SAVED = f"""ok AS (SELECT id AS job_id, result_json::JSON AS j FROM jobs WHERE id IS NOT NULL AND json_valid(result_json) AND json_type(result_json) = 'OBJECT' QUALIFY row_number() OVER (PARTITION BY id ORDER BY updated_at DESC NULLS LAST, received_at DESC NULLS LAST) = 1),
jb AS (SELECT job_id, j, json_extract_string(j, '$.template.id') AS template_id, try_cast({_PICK('j', 'template.template_version', 'template.revision')} AS INTEGER) AS version, {_PICK('j', 'model_version', 'engine', 'recognizer_version')} AS model_version, regexp_extract({_PICK('j', 'source_path', 'input_path')}, '[^/]*$') AS source_name FROM ok),
rp AS (SELECT job_id, template_id, job_id || '/' || i AS run_id, {_PLACE('x', 'page_index')} AS page_index, {_INTS(_PICK('x', 'excluded_rows', 'skipped_rows'))} AS p_rows, {_INTS(_PICK('x', 'excluded_columns'))} AS p_columns, x AS p FROM {_EACH('jb', "j, '$.pages[*]'", 'job_id, template_id')} WHERE json_type(x) = 'OBJECT'),
rf AS (SELECT job_id, template_id, run_id, page_index, i AS seq, coalesce(json_extract_string(x, '$.region_id'), '') AS region_id, coalesce(json_extract_string(x, '$.name'), '') AS name, coalesce({_PICK('x', 'raw_text', 'rawText', 'reading_raw')}, '') AS raw_text, coalesce({_PICK('x', 'final_text', 'finalText', 'text', 'accepted_text')}, '') AS text, try_cast({_PICK('x', 'confidence', 'conf', 'score')} AS DOUBLE) AS confidence, coalesce({_PICK('x', 'status', 'review_state', 'state')}, 'automatic') AS status FROM {_EACH('rp', "p, '$.fields[*]'", 'job_id, template_id, run_id, page_index')} WHERE json_type(x) = 'OBJECT'),
res AS (SELECT run_id || '/c' || i AS cell_id, run_id, job_id, template_id, page_index, {_PLACE('x', 'row')} AS cell_row, {_PLACE('x', 'column')} AS cell_column, coalesce({_PICK('x', 'raw_text', 'rawText', 'reading_raw')}, '') AS raw_text, coalesce(json_extract_string(x, '$.applied_rule'), '') AS applied_rule, p_rows, p_columns,
 coalesce({_PICK('x', 'final_text', 'finalText', 'text', 'accepted_text')}, '') AS c_text, try_cast({_PICK('x', 'confidence', 'conf', 'score')} AS DOUBLE) AS c_confidence, coalesce({_PICK('x', 'status', 'review_state', 'state')}, 'automatic') AS status,
 list_sort(list_distinct(CASE WHEN json_type(x, '$.flags') = 'ARRAY' THEN json_extract_string(x, '$.flags[*]') ELSE list_filter(list_transform(string_split(coalesce(json_extract_string(x, '$.flags'), ''), ','), lambda f: trim(f)), lambda f: f <> '') END)) AS c_flags,
 CASE WHEN json_type(coalesce(nullif(json_extract(x, '$.alternatives'), 'null'::JSON), nullif(json_extract(x, '$.alts'), 'null'::JSON), nullif(json_extract(x, '$.other_readings'), 'null'::JSON))) = 'ARRAY' THEN array_to_string(json_extract_string(coalesce(nullif(json_extract(x, '$.alternatives'), 'null'::JSON), nullif(json_extract(x, '$.alts'), 'null'::JSON), nullif(json_extract(x, '$.other_readings'), 'null'::JSON)), '$[*]'), ' | ') ELSE coalesce({_PICK('x', 'alternatives', 'alts', 'other_readings')}, '') END AS c_alternative
 FROM {_EACH('rp', "p, '$.cells[*]'", 'job_id, template_id, run_id, page_index, p_rows, p_columns')} WHERE json_type(x) = 'OBJECT' AND {_PLACE('x', 'row')} >= 0 AND {_PLACE('x', 'column')} >= 0),
{S.resolved('res', 'cell_id').strip()},
readings AS (SELECT * EXCLUDE (excluded), excluded OR (list_contains(p_rows, cell_row) AND cell_column >= row_label_columns) OR (list_contains(p_columns, cell_column) AND cell_row >= header_rows) AS excluded FROM resolved)"""
_OUT = f"{_SAVED},{P.marks("'number'", 'AND NOT excluded AND fixed IS NULL')}"
_CHECKED = "CASE WHEN f.source = 'fixed' THEN coalesce(f.fixed_value, '') ELSE '' END"


def _results(spark, sf):
    return Results(table(spark, sf, "jobs"), table(spark, sf, "templates"))


def _flagged(r: Results):
    """All numbers of a row compare with each other: the columns' own rules have different names here, so no rule holds five."""
    return K.flag_outliers(r.cells(), F.lit("number"))


@query(f"WITH {_OUT} SELECT cell_id, run_id, array_to_string(flags_now, ',') AS flags, list_contains(flags_now, 'table_outlier') AS is_outlier FROM flagged")
def result_outliers(spark, sf):
    """Outliers within the rows of every page of every job, computed anew from the saved texts."""
    return _flagged(_results(spark, sf)).select("cell_id", "run_id", F.array_join("flags_now", ",").alias("flags"), F.array_contains("flags_now", K.OUTLIER).alias("is_outlier"))


@query(f"WITH {_OUT} SELECT run_id, page_index, cell_row FROM flagged GROUP BY ALL HAVING count(*) FILTER (status = 'automatic' AND len(list_filter(flags_now, lambda f: f NOT IN ({P.NON_BLOCKING}))) > 0) > 0")
def result_open_rows(spark, sf):
    return _flagged(_results(spark, sf)).where(G.needs_review(F.col("flags_now"), F.col("status"))).select("run_id", "page_index", "cell_row").distinct()


@query(f"WITH {_SAVED} SELECT run_id, page_index + 1 AS page, name AS field, text AS value FROM rf")
def export_fields(spark, sf):
    """The sheet of fields: page, field and accepted text."""
    return _results(spark, sf).fields.select("run_id", (F.col("page_index") + 1).alias("page"), F.col("name").alias("field"), F.col("text").alias("value"))


@query(f"""WITH {_OUT}, fp AS (SELECT * FROM flagged QUALIFY row_number() OVER (PARTITION BY run_id, template_id, page_index, cell_row, cell_column ORDER BY cell_id) = 1), res_texts AS (SELECT run_id, map_from_entries(list((region_id, text))) AS texts FROM (SELECT run_id, region_id, arg_min(text, seq) AS text FROM rf GROUP BY ALL) GROUP BY run_id),
{W.long_sql("SELECT run_id, template_id, page_index, list_distinct(list_concat(p_rows, t_rows)) AS out_rows, coalesce(texts, MAP {}) AS texts FROM rp JOIN tf USING (template_id) LEFT JOIN res_texts USING (run_id)", "coalesce(pg.texts[f.id], '')").replace("lambda f: coalesce(pg.texts", "lambda f: coalesce(pf.texts", 2)}""")
def export_results(spark, sf):
    """The normalised export of all saved results."""
    r = _results(spark, sf)
    return X.long_rows(_flagged(r), P._grid(spark, sf), X.page_frame(r.export_pages(), r.templates))


@query(f"WITH {_OUT}, fp AS (SELECT * FROM flagged QUALIFY row_number() OVER (PARTITION BY run_id, template_id, page_index, cell_row, cell_column ORDER BY cell_id) = 1), {W.LAYOUT}")
def export_results_layout(spark, sf):
    r = _results(spark, sf)
    return X.layout(_flagged(r), r.templates)


_EVIDENCE = """CASE WHEN contains(raw_text, ',') THEN 'comma → canonical dot' WHEN contains(raw_text, '.') THEN 'dot' WHEN list_contains(flags, 'separator_reclassified_from_one') THEN 'OCR 1 → proposed dot from template' WHEN list_contains(flags, 'separator_inferred_from_rule') THEN 'missing → proposed dot from template' WHEN contains(text, '.') THEN 'dot not present in primary OCR' ELSE '' END"""


@query(f"""WITH {_OUT}, bag AS (SELECT job_id, run_id, page_index, 'cell' AS kind, 'R' || (cell_row + 1) || 'C' || (cell_column + 1) AS address, raw_text, c_text AS text, c_confidence AS confidence, flags_now AS flags, status, template_name, applied_rule, c_alternative AS alternatives FROM flagged
UNION ALL SELECT job_id, run_id, page_index, 'field', rf.name, raw_text, text, confidence, []::VARCHAR[], status, t.name, '', '' FROM rf JOIN templates t ON t.id = rf.template_id)
SELECT run_id, source_name, page_index + 1 AS page, kind, address, raw_text AS raw_value, text AS final_value, round(confidence, 4) AS confidence, array_to_string(flags, ', ') AS flags, status, template_name AS template, version AS template_version, model_version, {_EVIDENCE} AS separator_evidence, applied_rule, alternatives FROM bag JOIN jb USING (job_id)""")
def export_results_audit(spark, sf):
    """The audit of all saved results: fields and cells in one bag."""
    r = _results(spark, sf)
    return r.audit(_flagged(r))


_FIELD_RULE = "{'value_format': f.kind, 'minimum': NULL::DOUBLE, 'maximum': NULL::DOUBLE, 'decimal_places': NULL::INTEGER, 'allowed_values': NULL::VARCHAR[], 'allow_empty': NOT f.required, 'require_decimal': false}"
_FIELD_AUDIT = f"""fa AS (SELECT run_id, job_id, template_id, page_index, f.id AS region_id, f.name AS name, coalesce(r.text, '') AS text, coalesce(r.status, '') AS status, list_transform({S.errors('text', 'frule')}, lambda e: CASE WHEN e = 'required_cell_empty' THEN 'required_field_empty' ELSE e END) AS errors
 FROM (SELECT rp.run_id, rp.job_id, rp.template_id, rp.page_index, f, {_FIELD_RULE} AS frule, r, r.text AS text FROM rp JOIN (SELECT id AS template_id, unnest(fields) AS f FROM templates) USING (template_id) LEFT JOIN (SELECT run_id, region_id, min({{'seq': seq, 'text': text, 'status': status}}) AS r FROM rf GROUP BY ALL) q ON q.run_id = rp.run_id AND q.region_id = f.id))"""


@query(f"WITH {_SAVED}, {_FIELD_AUDIT} SELECT run_id, page_index, region_id, name, text, status, array_to_string(errors, ',') AS errors FROM fa")
def result_fields(spark, sf):
    """Field regions of the template against the fields that the page holds."""
    return _results(spark, sf).field_audit().select("run_id", "page_index", "region_id", "name", "text", "status", F.array_join("errors", ",").alias("errors"))


_GATE = f"""{_OUT}, {_FIELD_AUDIT}, {P._RULES.replace('regions', 'all_regions')}, bad AS (SELECT template_id, count(*) FILTER (len({P._VALID}) > 0) AS n FROM all_rules GROUP BY template_id),
gc AS (SELECT job_id, count(*) FILTER (status = 'automatic' AND len(list_filter(flags_now, lambda f: f NOT IN ({P.NON_BLOCKING}))) > 0) AS u, count(*) FILTER (kind = 'rule' AND status NOT IN ('excluded', 'confirmed', 'corrected') AND NOT excluded AND len({S.errors('c_text', 'rule')}) > 0) AS b FROM flagged GROUP BY job_id),
gf AS (SELECT job_id, count(*) FILTER (len(errors) > 0 AND status NOT IN ('confirmed', 'corrected')) AS f FROM fa GROUP BY job_id), gp AS (SELECT job_id, count(*) AS p FROM rp GROUP BY job_id),
gate AS (SELECT job_id, coalesce(p, 0) AS n_pages, coalesce(n, 0)::INTEGER AS n_invalid_rules, coalesce(u, 0) AS n_unresolved, coalesce(b, 0) AS n_broken_cells, coalesce(f, 0) AS n_broken_fields FROM jb LEFT JOIN bad USING (template_id) LEFT JOIN gp USING (job_id) LEFT JOIN gc USING (job_id) LEFT JOIN gf USING (job_id))"""


@query(f"""WITH {_GATE} SELECT *, concat_ws(',', CASE WHEN n_pages = 0 THEN 'no_pages' END, CASE WHEN n_invalid_rules > 0 THEN 'invalid_rules' END, CASE WHEN n_unresolved > 0 THEN 'needs_review' END, CASE WHEN n_broken_fields > 0 THEN 'field_breaks_rule' END, CASE WHEN n_broken_cells > 0 THEN 'cell_breaks_rule' END) AS blocked_by, CASE WHEN n_unresolved = 0 THEN 'ready' ELSE 'review' END AS status FROM gate""")
def export_ready(spark, sf):
    """Per job all gates of the export, and the status with which it is saved."""
    r = _results(spark, sf)
    return r.gate(_flagged(r))
