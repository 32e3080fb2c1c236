"""Queries over the life of jobs: queue, uploads, drafts, edits after review, progress."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgermill.functions import grammar as G
from ledgermill.operators import agreement as A
from ledgermill.operators import checks as K
from ledgermill.operators import jobs as J
from ledgermill.operators import ranking as R
from ledgermill.operators import review as V
from ledgermill.plans import evidence as E
from ledgermill.plans import results as Q
from ledgermill.plans import rules as P
from ledgermill.plans import sqltext as S
from ledgermill.plans import workflow as W
from ledgermill.plans.common import SQL, query, table

_CURRENT = "cur AS (SELECT * FROM jobs WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY updated_at DESC NULLS LAST, received_at DESC NULLS LAST, status) = 1)"
_RECEIPTS = "rec AS (SELECT stored_source_path AS upload_id, sha256(coalesce(result_json, '')) AS held, id AS job_id FROM jobs WHERE stored_source_path IS NOT NULL AND id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY stored_source_path ORDER BY received_at, id) = 1)"


@query(f"""SELECT CASE WHEN state IN ('queued', 'running', 'cancelling') THEN 'busy' WHEN state IN ('cancelled', 'interrupted', 'failed') THEN 'resumable' WHEN state = 'ready' THEN 'ready' ELSE 'idle' END AS kind, count(*) AS n_jobs FROM ({SQL['queue_fold']}) GROUP BY 1""")
def queue_kinds(spark, sf):
    """Jobs that are busy, can be resumed, or are ready to export."""
    return J.fold(W.queue_events(spark, sf)).groupBy(J.group_of(F.col("state")).alias("kind")).agg(F.count("*").alias("n_jobs"))


@query(f"""WITH {_CURRENT}, {_RECEIPTS}, held AS (SELECT rec.*, cur.stored_source_path FROM rec JOIN cur ON cur.id = rec.job_id),
sent AS (SELECT DISTINCT stored_source_path AS upload_id, sha256(coalesce(result_json, '')) AS sha256 FROM jobs WHERE stored_source_path IS NOT NULL UNION SELECT 'new-' || id, sha256(name) FROM templates)
SELECT upload_id, sha256, CASE WHEN held IS NULL THEN 'new' WHEN held = sha256 THEN 'replay' ELSE 'conflict' END AS outcome, job_id, stored_source_path FROM sent LEFT JOIN held USING (upload_id)""")
def upload_replay(spark, sf):
    """Every stored file sent again, and new ones: which get their receipt, which are conflicts."""
    j = table(spark, sf, "jobs")
    sha = F.sha2(F.coalesce("result_json", F.lit("")), 256).alias("sha256")
    own = j.where("stored_source_path is not null").select(F.col("stored_source_path").alias("upload_id"), sha, F.col("id").alias("job_id"), "received_at")
    place = F.row_number().over(Window.partitionBy("upload_id").orderBy("received_at", "job_id"))
    receipts = own.where("job_id is not null").withColumn("place", place).where("place = 1").select("upload_id", "sha256", "job_id")
    new = table(spark, sf, "templates").select(F.concat(F.lit("new-"), "id").alias("upload_id"), F.sha2("name", 256).alias("sha256"))
    return J.replayed(own.select("upload_id", "sha256").union(new).distinct(), receipts, J.current(j))


@query(f"WITH {_CURRENT} SELECT id, source_name, source_path, status FROM cur UNION ALL SELECT 'src-' || id, name, coalesce(reference_source_path, ''), 'imported' FROM templates WHERE 'src-' || id NOT IN (SELECT id FROM cur)")
def import_sources(spark, sf):
    """The templates' reference pages imported as jobs, twice: the second time changes nothing."""
    sources = table(spark, sf, "templates").select(F.concat(F.lit("src-"), "id").alias("id"), F.col("name").alias("source_name"), F.coalesce("reference_source_path", F.lit("")).alias("source_path"))
    return J.imported(J.imported(J.current(table(spark, sf, "jobs")), sources), sources)


@query("SELECT id AS job_id, max({'a': updated_at, 'b': sha256(json_extract(result_json, '$.template')::VARCHAR)}).a AS saved_at FROM jobs WHERE id IS NOT NULL AND json_valid(result_json) AND json_type(result_json) = 'OBJECT' GROUP BY id")
def drafts_latest(spark, sf):
    """The last saved template of each job."""
    j = table(spark, sf, "jobs").where(F.json_object_keys("result_json").isNotNull())
    return J.drafts(j.select(F.col("id").alias("job_id"), F.col("updated_at").alias("saved_at"), F.get_json_object("result_json", "$.template").alias("template"))).select("job_id", "saved_at")


@query(f"WITH e AS (SELECT DISTINCT template_id, image_key, cell_id, sha256(coalesce(value_text, '')) AS digest, model FROM evidence) SELECT template_id AS fingerprint, image_key AS stage, cell_id AS page, digest FROM (SELECT * FROM e WHERE model = '{E.SECOND}') s WHERE EXISTS (SELECT 1 FROM e f WHERE f.model = '{E.FIRST}' AND f.template_id = s.template_id AND f.image_key = s.image_key AND f.cell_id = s.cell_id AND f.digest = s.digest)")
def checkpoint_reuse(spark, sf):
    """Readings as checkpoints: those of the second model that the first one stored with the same content."""
    e = table(spark, sf, "evidence").select(F.col("template_id").alias("fingerprint"), F.col("image_key").alias("stage"), F.col("cell_id").alias("page"), F.sha2(F.coalesce("value_text", F.lit("")), 256).alias("digest"), "model").distinct()
    return J.resumable(e.where(F.col("model") == E.FIRST), e.where(F.col("model") == E.SECOND).drop("model"))


@query(f"WITH {Q._SAVED} SELECT run_id, stage, floor(100 * ((stage * n + k) * 1000 + 500) / (n * 2 * 1000))::INTEGER AS percent FROM (SELECT run_id, row_number() OVER (PARTITION BY job_id ORDER BY run_id) - 1 AS k, count(*) OVER (PARTITION BY job_id) AS n FROM rp), (VALUES (0), (1)) v(stage)")
def page_progress(spark, sf):
    """Percent done at the middle of each page in each of two stages."""
    pages = Q._results(spark, sf).pages
    job = Window.partitionBy("job_id")
    df = pages.select("run_id", (F.row_number().over(job.orderBy("run_id")) - 1).alias("k"), F.count("*").over(job).alias("n")).withColumn("stage", F.explode(F.array(F.lit(0), F.lit(1))))
    return df.select("run_id", "stage", J.progress(F.col("k"), F.col("n"), F.col("stage"), F.lit(2), F.lit(0.5)).alias("percent"))


@query(f"WITH {Q._SAVED} SELECT cell_id, row_number() OVER (PARTITION BY run_id ORDER BY cell_row, cell_column, cell_id)::INTEGER AS place FROM readings")
def cells_in_order(spark, sf):
    """The order of a page's cells: by row, then column."""
    return Q._results(spark, sf).cells().select("cell_id", F.row_number().over(Window.partitionBy("run_id").orderBy("cell_row", "cell_column", "cell_id")).alias("place"))


@query(f"""WITH {Q._OUT} SELECT cell_id, CASE WHEN status = 'automatic' AND len(list_filter(flags_now, lambda f: f NOT IN ({P.NON_BLOCKING}))) > 0 AND NOT (kind = 'rule' AND len({S.errors('c_text', 'rule')}) > 0) THEN 'confirmed' ELSE status END AS status FROM flagged""")
def confirm_all(spark, sf):
    return V.confirm_all(Q._flagged(Q._results(spark, sf))).select("cell_id", "status")


@query(f"""WITH {Q._OUT}, ed AS (SELECT cell_id, run_id, trim(string_split(c_alternative, ' | ')[1]) AS value FROM flagged WHERE list_contains(flags_now, 'table_outlier') AND c_alternative <> ''),
after AS (WITH readings AS (SELECT f.* EXCLUDE (flags_now) REPLACE (CASE WHEN ed.value IS NOT NULL AND status <> 'excluded' THEN ed.value ELSE c_text END AS c_text, CASE WHEN ed.value IS NOT NULL AND status <> 'excluded' THEN CASE WHEN ed.value = raw_text THEN 'confirmed' ELSE 'corrected' END ELSE status END AS status) FROM flagged f LEFT JOIN (SELECT cell_id, value FROM ed) ed USING (cell_id)),{P.marks("'number'", 'AND NOT excluded AND fixed IS NULL')} SELECT * FROM flagged)
SELECT cell_id, c_text AS final_text, status, array_to_string(flags_now, ',') AS flags FROM after WHERE run_id IN (SELECT run_id FROM ed)""")
def edits_rechecked(spark, sf):
    """Outliers replaced by their first alternative, and the flags of their pages computed anew."""
    flagged = Q._flagged(Q._results(spark, sf))
    edits = flagged.where(F.array_contains("flags_now", K.OUTLIER) & (F.col("c.alternative") != "")).select("cell_id", "run_id", F.get(F.split("c.alternative", r" \| "), F.lit(0)).alias("value"))
    pages = edits.select("run_id").distinct()
    return V.rechecked(flagged, edits.select("cell_id", "value"), F.lit("number")).join(pages, "run_id", "left_semi").select("cell_id", F.col("c.text").alias("final_text"), "status", F.array_join("flags_now", ",").alias("flags"))


@query(f"WITH {Q._SAVED} SELECT run_id, count(*) AS n_fields, min(confidence) AS confidence, coalesce(min(confidence) < 0.88, false) AS low_confidence FROM rf GROUP BY run_id")
def field_confidence(spark, sf):
    """A page's fields are as sure as the least sure of them; under 0.88 they are flagged."""
    f = Q._results(spark, sf).fields.groupBy("run_id").agg(F.count("*").alias("n_fields"), F.min("confidence").alias("confidence"))
    return f.select("run_id", "n_fields", "confidence", F.coalesce(F.col("confidence") < 0.88, F.lit(False)).alias("low_confidence"))


@query(f"""WITH {P._OUT}, {E._ELIG}, {E._answer(E.FIRST, 'fa')}, {E._answer(E.SECOND, 'fb')} SELECT '{E.FIRST}' AS model, count(*) AS n_answers, count(*) FILTER (t IS NULL OR {S.number('t')} IS NULL) AS n_rejected FROM fa UNION ALL SELECT '{E.SECOND}', count(*), count(*) FILTER (t IS NULL OR {S.number('t')} IS NULL) FROM fb""")
def answers_rejected(spark, sf):
    """Answers of both models to eligible cells, and how many no rule lets through."""
    cells, e = A.eligible(P._flagged(spark, sf)), table(spark, sf, "evidence")
    out = None
    for model in (E.FIRST, E.SECOND):
        read = cells.join(A.answers(e, model, "said"), "cell_id").select(A.reading(F.col("said"), F.col("rule")).alias("a"))
        per = read.agg(F.count("*").alias("n_answers"), F.count_if(F.col("a").isNull()).alias("n_rejected")).select(F.lit(model).alias("model"), "n_answers", "n_rejected")
        out = per if out is None else out.union(per)
    return out


@query(f"""WITH {P._OUT}, {E._ELIG}, a AS (SELECT cell_id, count(*) AS n FROM evidence WHERE model = '{E.FIRST}' AND image_key = 'base-0' AND cell_id IS NOT NULL GROUP BY cell_id)
SELECT cell_id, CASE WHEN e.c IS NULL THEN 'not_asked' WHEN n IS NULL THEN 'missing' ELSE 'twice' END AS problem FROM (SELECT cell_id, 1 AS c FROM eligible) e FULL JOIN a USING (cell_id) WHERE e.c IS NULL OR n IS NULL OR n > 1""")
def answer_ids(spark, sf):
    """The first model's answers against the cells that were asked."""
    e = table(spark, sf, "evidence").where((F.col("model") == E.FIRST) & (F.col("image_key") == "base-0") & F.col("cell_id").isNotNull())
    return A.answer_ids(A.eligible(P._flagged(spark, sf)), e.select("cell_id"))


@query(SQL["vote_fast"].replace("SELECT cell_id, value, score, confidence, concat_ws", "SELECT cell_id, value, array_to_string(others[1:4], ' | ') AS alternatives, concat_ws").replace("FROM (SELECT *, count(*) OVER (PARTITION BY cell_id) AS n FROM z", "FROM (SELECT *, count(*) OVER (PARTITION BY cell_id) AS n, (SELECT list(o.value ORDER BY o.score DESC, o.value) FROM z o WHERE o.cell_id = z.cell_id)[2:] AS others FROM z"))
def vote_alternatives(spark, sf):
    """The fast vote with its next four readings."""
    return R.fast_vote(E._obs(spark, sf), E._weight()).select("cell_id", "value", "alternatives", "flags")


@query("""WITH p AS (SELECT DISTINCT record_id, coalesce(raw_text, '') AS t FROM provenance WHERE record_id IS NOT NULL) SELECT record_id FROM p WHERE """ + P._MARK("t") + " AND " + P._MARK("'~' || t"))
def mark_evidence_crops(spark, sf):
    """Annotated crops as unstable readings, with two spellings as alternatives: which look like marks."""
    p = table(spark, sf, "provenance").where("record_id is not null").select("record_id", F.coalesce("raw_text", F.lit("")).alias("t")).distinct()
    none = F.array().cast("array<string>")
    return p.where(K.mark_evidence(F.col("t"), F.concat("t", F.lit(" | ~"), "t"), F.lit(0.5), none)).select("record_id")
