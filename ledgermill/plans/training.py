"""Queries of schema drift (p2) and nested results (p3)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgermill.operators.drift import Drift
from ledgermill.operators.nested import FlatTables
from ledgermill.plans.common import query, table


_P2 = """WITH f AS (SELECT DISTINCT station_id, batch_seq FROM jobs WHERE station_id IS NOT NULL AND batch_seq IS NOT NULL),
ok AS (SELECT station_id, batch_seq, result_json::JSON AS j FROM jobs WHERE json_valid(result_json) AND json_type(result_json) = 'OBJECT'),
raw AS (SELECT DISTINCT station_id, batch_seq, regexp_replace(t.fullkey, '\\[[0-9]+\\]', '[]', 'g') AS k, t.type AS jt FROM ok, json_tree(ok.j) t WHERE t.fullkey <> '$' AND t.type <> 'NULL'),
p AS (SELECT DISTINCT station_id, batch_seq, replace(k[3:], '"', '') AS path, CASE jt WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'VARCHAR' THEN 'string' ELSE 'number' END AS ty FROM raw WHERE NOT regexp_matches(k, 'candidate_scores\\.') AND NOT ends_with(k, '[]')),
prev AS (SELECT *, lag(batch_seq) OVER (PARTITION BY station_id ORDER BY batch_seq) AS before FROM f),
new AS (SELECT prev.station_id, prev.batch_seq, path, ty FROM prev JOIN p USING (station_id, batch_seq) WHERE before IS NOT NULL),
old AS (SELECT prev.station_id, prev.batch_seq, path, ty FROM prev JOIN p ON p.station_id = prev.station_id AND p.batch_seq = prev.before),
d AS (SELECT station_id, batch_seq, path, old.ty AS oty, new.ty AS nty, CASE WHEN contains(path, '.') THEN regexp_replace(path, '\\.[^.]*$', '') ELSE '' END AS parent FROM old FULL JOIN new USING (station_id, batch_seq, path)),
g AS (SELECT station_id, batch_seq, parent, count(*) FILTER (nty IS NULL) AS gone, count(*) FILTER (oty IS NULL) AS come, max(path) FILTER (nty IS NULL) AS o, max(path) FILTER (oty IS NULL) AS n, max(oty) FILTER (nty IS NULL) AS t1, max(nty) FILTER (oty IS NULL) AS t2 FROM d WHERE oty IS NULL OR nty IS NULL GROUP BY ALL),
one AS (SELECT * FROM g WHERE gone = 1 AND come = 1 AND t1 = t2)
SELECT station_id, batch_seq, path AS old_path, path AS new_path, 'retyped' AS change_kind FROM d WHERE oty <> nty
UNION ALL SELECT station_id, batch_seq, o, n, 'renamed' FROM one
UNION ALL SELECT station_id, batch_seq, path, '', 'removed' FROM d ANTI JOIN one USING (station_id, batch_seq, parent) WHERE nty IS NULL
UNION ALL SELECT station_id, batch_seq, '', path, 'added' FROM d ANTI JOIN one USING (station_id, batch_seq, parent) WHERE oty IS NULL"""


@query(_P2)
def p2_found(spark, sf):
    return Drift(table(spark, sf, "jobs")).changes()


@query()
def p2_scripts(spark, sf):
    return Drift(table(spark, sf, "jobs")).scripts()


@query()
def p2_table(spark, sf):
    return Drift(table(spark, sf, "jobs")).every_row()


_INT = lambda j, m: f"coalesce(try_cast(json_extract_string({j}, '$.{m}') AS DOUBLE)::INTEGER, -1)"
_P3 = f"""WITH ok AS (SELECT id AS job_id, result_json::JSON AS j FROM jobs WHERE id IS NOT NULL AND json_valid(result_json) AND json_type(result_json) = 'OBJECT' QUALIFY row_number() OVER (PARTITION BY id ORDER BY updated_at DESC NULLS LAST, received_at DESC NULLS LAST) = 1),
pg AS (SELECT job_id, {_INT('p', 'page_index')} AS page_index, p FROM (SELECT job_id, unnest(json_extract(j, '$.pages[*]')) AS p FROM ok)),
ce AS (SELECT job_id, page_index, {_INT('c', 'row')} AS r, {_INT('c', 'column')} AS k, c FROM (SELECT job_id, page_index, unnest(json_extract(p, '$.cells[*]')) AS c FROM pg))
SELECT job_id, 'page' AS node_level, page_index, -1 AS cell_row, -1 AS cell_column, '' AS item FROM pg
UNION ALL SELECT job_id, 'cell', page_index, r, k, '' FROM ce
UNION ALL SELECT job_id, 'candidate', page_index, r, k, unnest(CASE WHEN json_type(c, '$.candidate_scores') = 'OBJECT' THEN json_keys(c, '$.candidate_scores') ELSE json_extract_string(c, '$.candidate_scores[*].reading') END) FROM ce WHERE json_type(c, '$.candidate_scores') IN ('OBJECT', 'ARRAY')
UNION ALL SELECT job_id, 'model_reading', page_index, r, k, m FROM ce, (VALUES ('model_a'), ('model_b')) AS v(m) WHERE json_type(c, '$.slow_mode_evidence.' || m) NOT IN ('NULL')
UNION ALL SELECT job_id, 'field', page_index, -1, -1, coalesce(json_extract_string(f, '$.region_id'), '') FROM (SELECT job_id, page_index, unnest(json_extract(p, '$.fields[*]')) AS f FROM pg)
UNION ALL SELECT job_id, 'column_rule', -1, -1, -1, coalesce(json_extract_string(f, '$.name'), '') FROM (SELECT job_id, unnest(json_extract(j, '$.template.column_rules[*]')) AS f FROM ok)
UNION ALL SELECT job_id, 'cell_rule', -1, -1, -1, coalesce(json_extract_string(f, '$.id'), '') FROM (SELECT job_id, unnest(json_extract(j, '$.template.cell_rules[*]')) AS f FROM ok)"""


@query(_P3)
def p3_found(spark, sf):
    found = FlatTables(table(spark, sf, "jobs")).nodes.where("node_level <> 'job'")
    return found.select("job_id", "node_level", "page_index", "cell_row", "cell_column", "item")


@query()
def p3_cells(spark, sf):
    return FlatTables(table(spark, sf, "jobs")).table("cell")


@query()
def p3_jobs(spark, sf):
    return FlatTables(table(spark, sf, "jobs")).table("job")


@query()
def p3_pages(spark, sf):
    return FlatTables(table(spark, sf, "jobs")).table("page")


@query()
def p3_candidates(spark, sf):
    return FlatTables(table(spark, sf, "jobs")).table("candidate")


@query()
def p3_model_readings(spark, sf):
    return FlatTables(table(spark, sf, "jobs")).table("model_reading")


@query()
def p3_fields(spark, sf):
    return FlatTables(table(spark, sf, "jobs")).table("field")


@query()
def p3_column_rules(spark, sf):
    return FlatTables(table(spark, sf, "jobs")).table("column_rule")


@query()
def p3_cell_rules(spark, sf):
    return FlatTables(table(spark, sf, "jobs")).table("cell_rule")


_KEYS = """WITH ok AS (SELECT id AS job_id, result_json::JSON AS j FROM jobs WHERE id IS NOT NULL AND json_valid(result_json) AND json_type(result_json) = 'OBJECT' QUALIFY row_number() OVER (PARTITION BY id ORDER BY updated_at DESC NULLS LAST, received_at DESC NULLS LAST) = 1),
pg AS (SELECT job_id, job_id || '/' || i AS k, i, x FROM (SELECT job_id, unnest(l) AS x, generate_subscripts(l, 1) - 1 AS i FROM (SELECT job_id, json_extract(j, '$.pages[*]') AS l FROM ok)) WHERE json_type(x) = 'OBJECT'),
ce AS (SELECT job_id, k AS p, k || '/c' || n AS k, n, y FROM (SELECT job_id, k, unnest(l) AS y, generate_subscripts(l, 1) - 1 AS n FROM (SELECT job_id, k, json_extract(x, '$.cells[*]') AS l FROM pg)) WHERE json_type(y) = 'OBJECT'),
fi AS (SELECT job_id, k AS p, k || '/f' || n AS k, n FROM (SELECT job_id, k, unnest(l) AS y, generate_subscripts(l, 1) - 1 AS n FROM (SELECT job_id, k, json_extract(x, '$.fields[*]') AS l FROM pg)) WHERE json_type(y) = 'OBJECT'),
sc AS (SELECT job_id, k AS p, k || '/s' || n AS k, n FROM (SELECT job_id, k, unnest(range(0, CASE WHEN json_type(y, '$.candidate_scores') = 'OBJECT' THEN len(json_keys(y, '$.candidate_scores')) ELSE coalesce(json_array_length(y, '$.candidate_scores'), 0) END::BIGINT)) AS n FROM ce WHERE json_type(y, '$.candidate_scores') IN ('OBJECT', 'ARRAY'))),
mo AS (SELECT job_id, k AS p, k || '/' || m AS k, n2 AS n FROM ce, (VALUES ('model_a', 0), ('model_b', 1)) AS v(m, n2) WHERE json_type(y, '$.slow_mode_evidence.' || m) NOT IN ('NULL')),
cr AS (SELECT job_id, job_id AS p, job_id || '/' || t || '/' || i AS k, i AS n, t FROM (SELECT job_id, t, unnest(l) AS x, generate_subscripts(l, 1) - 1 AS i FROM (SELECT job_id, 'column_rule' AS t, json_extract(j, '$.template.column_rules[*]') AS l FROM ok UNION ALL SELECT job_id, 'cell_rule', json_extract(j, '$.template.cell_rules[*]') FROM ok)) WHERE json_type(x) = 'OBJECT'),
keys AS (SELECT 'job' AS node_level, job_id AS node_key, NULL AS parent_key, 0 AS ordinal, job_id FROM ok UNION ALL SELECT 'page', k, job_id, i, job_id FROM pg UNION ALL SELECT 'cell', k, p, n, job_id FROM ce UNION ALL SELECT 'field', k, p, n, job_id FROM fi UNION ALL SELECT 'candidate', k, p, n, job_id FROM sc UNION ALL SELECT 'model_reading', k, p, n, job_id FROM mo UNION ALL SELECT t, k, p, n, job_id FROM cr)"""


@query(_KEYS + " SELECT node_level, node_key, parent_key, ordinal::INTEGER AS ordinal, job_id FROM keys")
def p3_keys(spark, sf):
    """Keys, parents and places of all nodes."""
    return FlatTables(table(spark, sf, "jobs")).nodes.select("node_level", "node_key", "parent_key", "ordinal", "job_id")


@query(_KEYS + " SELECT node_level, count(*) AS n_rows, count(DISTINCT parent_key) AS n_parents, count(DISTINCT job_id) AS n_jobs FROM keys GROUP BY node_level")
def p3_links(spark, sf):
    """Rows and parents of each flat table."""
    n = FlatTables(table(spark, sf, "jobs")).nodes
    return n.groupBy("node_level").agg(F.count("*").alias("n_rows"), F.countDistinct("parent_key").alias("n_parents"), F.countDistinct("job_id").alias("n_jobs"))
