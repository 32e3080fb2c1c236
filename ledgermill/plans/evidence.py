"""Queries over candidate evidence, votes and two-model agreement."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgermill.operators import agreement as A
from ledgermill.operators import ranking as R
from ledgermill.plans import rules as P
from ledgermill.plans import sqltext as S
from ledgermill.plans.common import SQL, query, table

#: The two models of the short pass and of the agreement update.
FIRST, SECOND = "alder-rec", "birch-rec"
_OBS = f"obs AS (SELECT cell_id, model, image_key, {S.plain('value_text')} AS value, max(support) AS support FROM evidence WHERE cell_id IS NOT NULL AND support IS NOT NULL AND value_text <> '' GROUP BY ALL)"
_ELIGIBLE = f"""cand0 AS (SELECT cell_id, {S.plain('text')} AS current, list_filter(list_transform(list_concat([text], coalesce(candidates, [])), lambda v: {S.plain('v')}), lambda v: {S.full('v', S.SIMPLE)}) AS many FROM ocr_cells),
cand1 AS (SELECT cell_id, current, list_filter(many, lambda v, i: list_position(many, v) = i) AS vals FROM cand0),
elig AS (SELECT cell_id, current, unnest(vals) AS value FROM cand1 WHERE list_contains(vals, current) AND len(vals) >= 2)"""
_SCORES = f"""{_OBS}, {_ELIGIBLE},
views AS (SELECT * FROM obs WHERE NOT starts_with(image_key, 'split-')),
images AS (SELECT cell_id, model, count(DISTINCT image_key) AS n_images FROM views GROUP BY ALL),
sums AS (SELECT cell_id, model, value, sum(support) AS s FROM views GROUP BY ALL),
ms AS (SELECT cell_id, model, value, current, round(coalesce(s, 0.0) / n_images, 12) AS m FROM images JOIN elig USING (cell_id) LEFT JOIN sums USING (cell_id, model, value)),
rv AS (SELECT a.*, coalesce((SELECT max(b.m) FROM ms b WHERE b.cell_id = a.cell_id AND b.model = a.model AND b.value <> a.value), 0.0) AS rival FROM ms a),
scored AS (SELECT cell_id, value, current, round(exp(avg(ln(greatest(0.01, m)))), 9) AS score, count(*) AS n_models, count(*) FILTER (m >= 0.05 AND m >= 1.10 * rival) AS agreeing FROM rv GROUP BY ALL)"""


_SEEN = """vis AS (SELECT cell_id, max(sep) AS sep, max(digits) AS digits FROM (SELECT cell_id, support AS sep, NULL::INTEGER AS digits FROM obs WHERE starts_with(image_key, 'split-') UNION ALL SELECT cell_id, NULL, length(arg_max(predicted, (support, predicted)))::INTEGER FROM digit_checks WHERE cell_id IS NOT NULL AND predicted IS NOT NULL AND support IS NOT NULL AND confidence >= 0.6 GROUP BY cell_id) GROUP BY cell_id)"""
_LACKS = "greatest(0, coalesce(digits, 0) - length(regexp_replace(value, '\\P{Nd}', '', 'g')))"


def _lowered(sql: str) -> str:
    """Ranking SQL whose scores count a fifth for each visible digit that a value lacks."""
    return sql.replace("scored AS (SELECT cell_id, value, current, round(exp", "scored0 AS (SELECT cell_id, value, current, round(exp").replace("AS agreeing FROM rv GROUP BY ALL)", f"AS agreeing FROM rv GROUP BY ALL), scored AS (SELECT scored0.* EXCLUDE (score), round(score * pow(0.2, {_LACKS}), 9) AS score FROM scored0 LEFT JOIN vis USING (cell_id))")


def _obs(spark, sf):
    return R.observations(table(spark, sf, "evidence"))


@query(f"WITH {_SCORES} SELECT cell_id, value, score, n_models, agreeing FROM scored")
def rank_geomean(spark, sf):
    return R.geometric(R.model_scores(_obs(spark, sf), R.eligible(table(spark, sf, "ocr_cells")))).select("cell_id", "value", "score", "n_models", "agreeing")


@query(f"""WITH {_SCORES},
ds AS (SELECT cell_id, {S.plain('text')} AS value, max(support) AS digit_support FROM digit_checks WHERE cell_id IS NOT NULL AND text IS NOT NULL GROUP BY ALL),
sp AS (SELECT cell_id, value, count(DISTINCT model) AS votes FROM obs WHERE starts_with(image_key, 'split-') AND support >= 0.9 GROUP BY ALL),
f AS (SELECT s.*, coalesce(digit_support, 0.0) AS digit_support, coalesce(votes, 0) AS votes, row_number() OVER w AS place, lead(score) OVER w AS nxt FROM scored s LEFT JOIN ds USING (cell_id, value) LEFT JOIN sp USING (cell_id, value) WHERE n_models >= 2 WINDOW w AS (PARTITION BY cell_id ORDER BY score DESC, value <> current, value)),
g AS (SELECT *, max(CASE WHEN place = 1 THEN score END) OVER p AS top, max(CASE WHEN place = 1 THEN value END) OVER p AS winner FROM f WINDOW p AS (PARTITION BY cell_id)),
h AS (SELECT *, votes >= 2 AND score >= 0.5 * top AND (value = winner OR digit_support >= 0.9) AS ok FROM g),
i AS (SELECT *, count(*) FILTER (ok) OVER p AS n_split, max(CASE WHEN ok THEN value END) OVER p AS split_value FROM h WINDOW p AS (PARTITION BY cell_id)),
j AS (SELECT *, round(score / greatest(1e-12, coalesce(nxt, 0.0)), 9) AS margin, agreeing >= 2 OR digit_support >= 0.9 AS backed FROM i WHERE place = 1),
k AS (SELECT *, CASE WHEN n_split = 1 THEN split_value WHEN margin >= 1.1 AND (score >= 0.5 OR backed) THEN winner ELSE current END AS selected FROM j)
SELECT cell_id, current, winner, selected, score, margin, agreeing, concat_ws(',', CASE WHEN margin < 1.1 THEN 'candidate_ranking_disagreement' END, CASE WHEN score < 0.5 AND (winner <> current OR NOT backed OR margin < 1.1) THEN 'weak_sequence_evidence' END, CASE WHEN n_split = 1 THEN 'split_consensus_used' END, CASE WHEN selected <> current THEN 'candidate_reranked' END) AS flags FROM k""")
def rank_winner_margin(spark, sf):
    return R.rank(table(spark, sf, "evidence"), table(spark, sf, "ocr_cells"), table(spark, sf, "digit_checks"))


def _seen(spark, sf):
    return R.visible(_obs(spark, sf), table(spark, sf, "digit_checks"))


SQL["rank_visible_digits"] = _lowered(SQL["rank_winner_margin"]).replace(_OBS, f"{_OBS}, {_SEEN}", 1)


@query(SQL["rank_visible_digits"])
def rank_visible_digits(spark, sf):
    """The ranking where the digit check says how many digits are there."""
    return R.rank(table(spark, sf, "evidence"), table(spark, sf, "ocr_cells"), table(spark, sf, "digit_checks"), _seen(spark, sf))


def _weight():
    return F.when(F.col("model").contains("legacy"), 0.7).otherwise(1.0)


_W = "(CASE WHEN contains(model, 'legacy') THEN 0.7 ELSE 1.0 END)"


@query(f"WITH {_OBS} SELECT cell_id, value, round(sum({_W} * greatest(0.1, support)), 9) AS score, max(support) AS confidence, count(DISTINCT model) AS n_models, count(DISTINCT string_split(image_key, '-')[1]) AS n_crops FROM obs GROUP BY ALL")
def vote_weighted(spark, sf):
    return R.vote(_obs(spark, sf), _weight())


@query(f"""WITH {_OBS}, v AS (SELECT *, max(starts_with(image_key, 'split-')::INTEGER) OVER (PARTITION BY cell_id) AS seen FROM obs),
s AS (SELECT cell_id, value, seen, sum({_W} * greatest(0.1, support)) AS s, max(support) AS confidence FROM v GROUP BY ALL),
z AS (SELECT *, round(CASE WHEN {S.full('trim(value)', S.COMPLEX)} THEN s ELSE s * 0.2 END + CASE WHEN seen = 1 AND {S.full('value', r'[+\-−]?\p{Nd}+\.\p{Nd}+')} THEN 2.0 ELSE 0.0 END, 9) AS score FROM s)
SELECT cell_id, value, score, confidence, concat_ws(',', CASE WHEN n > 1 THEN 'model_disagreement' END, CASE WHEN confidence < 0.92 THEN 'low_confidence' END, CASE WHEN NOT {S.full('trim(value)', S.COMPLEX)} THEN 'invalid_numeric_format' END, CASE WHEN seen = 1 AND NOT contains(value, '.') THEN 'possible_missing_decimal' END) AS flags
FROM (SELECT *, count(*) OVER (PARTITION BY cell_id) AS n FROM z QUALIFY row_number() OVER (PARTITION BY cell_id ORDER BY score DESC, value) = 1)""")
def vote_fast(spark, sf):
    return R.fast_vote(_obs(spark, sf), _weight()).drop("alternatives")


def _rules(spark, sf):
    return P._resolved(spark, sf).where("kind = 'rule'").select("cell_id", "rule")


@query(f"""WITH {S.resolved()}, {_OBS},
rk AS (SELECT *, row_number() OVER (PARTITION BY cell_id, model, image_key ORDER BY support DESC, value) - 1 AS rank, max(support) OVER (PARTITION BY cell_id, model, image_key) AS best FROM obs),
sh AS (SELECT rk.*, greatest(CASE WHEN rank = 0 THEN {_W} * greatest(0.1, support) ELSE 0.0 END, {_W} * 0.78 * (support / greatest(1e-12, best)) / (1 + rank * 0.20)) AS share FROM rk JOIN resolved r USING (cell_id) WHERE rank < 6 AND r.kind = 'rule' AND len({S.errors('value', 'rule')}) = 0),
p AS (SELECT cell_id, value, round(sum(share), 9) AS score, max(support) AS confidence, count(DISTINCT model) AS n_models, count(DISTINCT string_split(image_key, '-')[1]) AS n_crops FROM sh GROUP BY ALL),
t AS (SELECT *, lead(score) OVER w AS nxt, row_number() OVER w AS place FROM p WINDOW w AS (PARTITION BY cell_id ORDER BY score DESC, value))
SELECT cell_id, value, score, n_models, n_crops, concat_ws(',', 'numeric_verification_required', CASE WHEN nxt IS NOT NULL AND score / greatest(1e-9, nxt) < 1.8 THEN 'model_disagreement' END, CASE WHEN (nxt IS NOT NULL AND score / greatest(1e-9, nxt) < 1.25) OR n_models < 2 THEN 'unstable_consensus' END, CASE WHEN confidence < 0.92 THEN 'low_confidence' END) AS flags FROM t WHERE place = 1""")
def cascade_scores(spark, sf):
    return R.cascade(_obs(spark, sf), _rules(spark, sf), _weight())


def _ranked_sql() -> str:
    """The ranking's SQL over the cascade's candidates and split readings."""
    sql = _lowered(SQL["rank_winner_margin"]).replace(_ELIGIBLE, "elig AS (SELECT cell_id, value, current FROM many)")
    return sql.replace("FROM obs WHERE starts_with(image_key, 'split-') AND support >= 0.9", "FROM split_ok WHERE support >= 0.9")


@query(f"""WITH {S.resolved()}, {_OBS}, {_SEEN}, rl AS (SELECT cell_id, rule FROM resolved WHERE kind = 'rule'),
rk AS (SELECT *, row_number() OVER (PARTITION BY cell_id, model, image_key ORDER BY support DESC, value) - 1 AS rank, max(support) OVER (PARTITION BY cell_id, model, image_key) AS best FROM obs WHERE NOT starts_with(image_key, 'split-')),
split_top AS (SELECT * FROM obs WHERE starts_with(image_key, 'split-') QUALIFY row_number() OVER (PARTITION BY cell_id, model ORDER BY support DESC, value, image_key) = 1),
split_ok AS (SELECT o.* FROM split_top o JOIN rl USING (cell_id) WHERE {S.full('value', r'[0-9]+[.][0-9]+')} AND len({S.errors('value', 'rule')}) = 0),
sh AS (SELECT cell_id, value, model, string_split(image_key, '-')[1] AS crop, support, greatest(CASE WHEN rank = 0 THEN {_W} * greatest(0.1, support) ELSE 0.0 END, {_W} * 0.78 * (support / greatest(1e-12, best)) / (1 + rank * 0.20)) AS share FROM rk JOIN rl USING (cell_id) WHERE rank < 6 AND len({S.errors('value', 'rule')}) = 0
 UNION ALL SELECT cell_id, p, model, crop, support, {_W} * greatest(0.1, support) * 0.72 FROM (SELECT cell_id, {S.proposal('value', 'rule')} AS p, model, string_split(image_key, '-')[1] AS crop, support FROM rk JOIN rl USING (cell_id) JOIN vis USING (cell_id) WHERE rank = 0 AND sep IS NOT NULL AND {S.full('value', '[0-9]{2,4}')}) WHERE p IS NOT NULL
 UNION ALL SELECT cell_id, value, model, 'split', support, {_W} * support * 1.8 FROM split_ok),
ck AS (SELECT cell_id, {S.plain('text')} AS value, max({{'support': support, 'confidence': coalesce(confidence, 0.0)}}) AS c FROM digit_checks WHERE cell_id IS NOT NULL AND text IS NOT NULL AND support IS NOT NULL GROUP BY ALL),
pr AS (SELECT cell_id, value, sum(share) AS s, max(support) AS confidence, count(DISTINCT model) AS n_models, count(DISTINCT crop) AS n_crops, bool_or(crop = 'retry') AS retry FROM sh GROUP BY ALL),
sc AS (SELECT pr.*, c, sep, {_LACKS} AS lacks, round((s + CASE WHEN contains(value, '.') THEN coalesce(1.25 * sep, 0.0) ELSE 0.0 END) * pow(0.2, {_LACKS}) + coalesce(0.55 * c.support * c.confidence, 0.0), 9) AS score FROM pr LEFT JOIN ck USING (cell_id, value) LEFT JOIN vis USING (cell_id)),
cu AS (SELECT cell_id, value AS current FROM sc QUALIFY row_number() OVER (PARTITION BY cell_id ORDER BY score DESC, value) = 1),
many AS (SELECT cell_id, value, current FROM sc JOIN cu USING (cell_id) WHERE {S.full('value', S.SIMPLE)} QUALIFY count(*) OVER (PARTITION BY cell_id) >= 2 AND bool_or(value = current) OVER (PARTITION BY cell_id)),
fin AS ({_ranked_sql()}),
ver AS (SELECT cell_id, value AS v_value, c.confidence AS v_conf FROM sc WHERE c IS NOT NULL QUALIFY row_number() OVER (PARTITION BY cell_id ORDER BY c.support DESC, c.confidence DESC, value DESC) = 1),
pick AS (SELECT cell_id, coalesce(fin.selected, cu.current) AS selected, fin.flags AS ranking FROM cu LEFT JOIN fin USING (cell_id)),
tp AS (SELECT sc.*, ranking, (SELECT max(o.lacks) FROM sc o WHERE o.cell_id = sc.cell_id) > 0 AS counted, (SELECT coalesce(rule.decimal_places, 0) > 0 FROM rl WHERE rl.cell_id = sc.cell_id) AS decimals, v_value, v_conf, sc.score / greatest(1e-9, (SELECT max(o.score) FROM sc o WHERE o.cell_id = sc.cell_id AND o.value <> sc.value)) AS margin, (SELECT count(*) FROM sc o WHERE o.cell_id = sc.cell_id) AS n FROM sc JOIN pick ON pick.cell_id = sc.cell_id AND pick.selected = sc.value LEFT JOIN ver ON ver.cell_id = sc.cell_id),
fast AS ({SQL['vote_fast']})
SELECT cell_id, value, score, n_models, n_crops, concat_ws(',', 'numeric_verification_required,high_accuracy_consensus,multistage_cascade', nullif(ranking, ''), CASE WHEN retry THEN 'crop_retry_contributed' END, CASE WHEN sep IS NOT NULL THEN 'decimal_separator_detected' WHEN decimals THEN 'separator_not_visually_confirmed' END, CASE WHEN counted THEN 'visible_digit_count_used' END, CASE WHEN n > 1 AND margin < 1.8 THEN 'model_disagreement' END, CASE WHEN n_models < 2 OR (n > 1 AND margin < 1.25) THEN 'unstable_consensus' END,
 CASE WHEN v_conf >= 0.7 THEN CASE WHEN v_value = value THEN 'digit_verifier_agrees' ELSE 'digit_verifier_disagreement' END END, CASE WHEN confidence < 0.92 THEN 'low_confidence' END) AS flags FROM tp
UNION ALL SELECT cell_id, value, score, NULL, NULL, concat_ws(',', nullif(flags, ''), 'high_accuracy_no_consensus') FROM fast SEMI JOIN rl USING (cell_id) ANTI JOIN cu USING (cell_id)""")
def cascade_ranked(spark, sf):
    return R.cascade_ranked(_obs(spark, sf), _rules(spark, sf), _weight(), table(spark, sf, "digit_checks"), _seen(spark, sf))


_TIES = f"""{_SCORES}, t AS (SELECT *, lead(value) OVER w AS second, lead(score) OVER w AS nxt, row_number() OVER w AS place FROM scored WINDOW w AS (PARTITION BY cell_id ORDER BY score DESC, value)),
d AS (SELECT cell_id, current, value AS first, second, list_filter(range(1, length(value) + 1), lambda i: substr(value, i, 1) <> substr(second, i, 1)) AS spots FROM t WHERE place = 1 AND second IS NOT NULL AND length(value) = length(second) AND score / greatest(1e-12, nxt) < 1.1),
ties AS (SELECT cell_id, first, second, cast(spots[1] AS INTEGER) AS position, current FROM d WHERE len(spots) = 1 AND regexp_full_match(substr(first, cast(spots[1] AS INTEGER), 1), '[0-9]') AND regexp_full_match(substr(second, cast(spots[1] AS INTEGER), 1), '[0-9]'))"""


def _ties(spark, sf):
    return R.close_digits(R.geometric(R.model_scores(_obs(spark, sf), R.eligible(table(spark, sf, "ocr_cells")))))


@query(f"WITH {_TIES} SELECT * FROM ties")
def close_digit_ties(spark, sf):
    return _ties(spark, sf)


@query(f"""WITH {_TIES}, gl AS (SELECT cell_id, model, arg_max(value, (support, value)) AS value, max(support) AS support FROM obs WHERE NOT starts_with(image_key, 'split-') GROUP BY ALL),
g AS (SELECT ties.cell_id, substr(value, position, 1) AS text, support, row_number() OVER (PARTITION BY ties.cell_id ORDER BY support DESC, model) AS place FROM ties JOIN gl USING (cell_id) WHERE length(value) = length(first)),
p AS (SELECT cell_id, list(support ORDER BY support) AS sure, list(DISTINCT text) AS texts FROM g WHERE place <= 3 GROUP BY cell_id HAVING count(*) = 3),
r AS (SELECT ties.*, texts[1] AS said, len(texts) = 1 AND texts[1] IN (substr(first, position, 1), substr(second, position, 1)) AND sure[1] >= 0.25 AND sure[2] >= 0.5 AND sure[3] >= 0.9 AS agreed FROM ties JOIN p USING (cell_id) WHERE current IN (first, second)),
x AS (SELECT *, CASE WHEN NOT agreed THEN current WHEN substr(first, position, 1) = said THEN first ELSE second END AS selected FROM r)
SELECT cell_id, selected, CASE WHEN NOT agreed THEN 'isolated_digit_disagreement' WHEN selected <> current THEN 'isolated_digit_consensus,candidate_reranked' ELSE 'isolated_digit_consensus' END AS flags FROM x""")
def settled_digits(spark, sf):
    """Ties decided by the digit that the three surest models of equal length read at the place."""
    ties, obs = _ties(spark, sf), _obs(spark, sf)
    best = obs.where(~R.is_split(F.col("image_key"))).groupBy("cell_id", "model").agg(F.max(F.struct("support", "value")).alias("top"))
    read = ties.join(best, "cell_id").where(F.length("top.value") == F.length("first"))
    place = F.row_number().over(Window.partitionBy("cell_id").orderBy(F.desc("top.support"), "model"))
    glyphs = read.withColumn("place", place).where("place <= 3").select("cell_id", F.substring(F.col("top.value"), F.col("position"), F.lit(1)).alias("text"), F.col("top.support").alias("confidence"))
    return R.settled_digits(ties, glyphs)


SQL_ADAPTIVE = f"""WITH {S.resolved()}, {_OBS}, {_SEEN},
b AS (SELECT cell_id, model, image_key, max({{'support': support, 'value': value}}) AS top, list(support ORDER BY support DESC) AS sups FROM obs WHERE starts_with(image_key, 'base-') AND model IN ('{FIRST}', '{SECOND}') GROUP BY ALL),
p AS (SELECT cell_id, count(*) AS n, count(DISTINCT top.value) AS n_values, min(top.value) AS value, min(top.support) AS least, bool_or(coalesce(sups[2], 0.0) * 10 > top.support) AS rivalled FROM b GROUP BY ALL)
SELECT cell_id, CASE WHEN n >= 4 AND n_values = 1 AND least >= 0.95 AND NOT rivalled AND {S.full('value', r'\p{Nd}+(\.\p{Nd}+)?')} AND len({S.errors('value', 'rule')}) = 0 AND len({S.warnings('value', 'rule')}) = 0 AND rule.value_format IN ('numeric', 'integer')
 AND (NOT contains(value, '.') OR coalesce(sep, 0.0) >= 0.7) AND (digits IS NULL OR digits = length(regexp_replace(value, '\\P{{Nd}}', '', 'g'))) THEN 'short' ELSE 'full' END AS pass FROM p JOIN resolved USING (cell_id) LEFT JOIN vis USING (cell_id) WHERE kind = 'rule'"""


@query(SQL_ADAPTIVE)
def adaptive_gate(spark, sf):
    return R.adaptive(_obs(spark, sf), _rules(spark, sf), _seen(spark, sf), (FIRST, SECOND))


@query("SELECT cell_id, round(exp(avg(ln(greatest(1e-9, confidence)))), 9) AS joint_support FROM (SELECT DISTINCT check_id, cell_id, confidence FROM digit_checks) WHERE cell_id IS NOT NULL AND confidence IS NOT NULL GROUP BY cell_id")
def digit_joint_support(spark, sf):
    return R.joint_support(table(spark, sf, "digit_checks"))


_ELIG = f"""eligible AS (SELECT * FROM flagged WHERE status = 'automatic' AND len(list_filter(flags_now, lambda f: f NOT IN ({P.NON_BLOCKING}) AND f <> 'adaptive_review_required')) > 0
 AND NOT excluded AND fixed IS NULL AND cell_row >= header_rows AND cell_column >= row_label_columns AND own_role <> 'ignored' AND rule.value_format IN ('numeric', 'integer'))"""


@query(f"WITH {P._OUT}, {_ELIG} SELECT cell_id FROM eligible")
def verification_eligible(spark, sf):
    return A.eligible(P._flagged(spark, sf)).select("cell_id")


def _answer(model: str, name: str) -> str:
    return f"{name}0 AS (SELECT cell_id, max({{'support': support, 'v': value_text}}).v AS raw FROM evidence WHERE model = '{model}' AND value_text IS NOT NULL GROUP BY cell_id), {name}1 AS (SELECT e.cell_id, {S.canonical('trim(raw)')} AS v, rule FROM {name}0 JOIN eligible e USING (cell_id)), {name}2 AS (SELECT *, len({S.errors('v', 'rule')}) = 0 AND v <> '' AS fit, {S.reclassified('v', 'rule')} AS moved, {S.proposal('v', 'rule')} AS put FROM {name}1), {name} AS (SELECT cell_id, CASE WHEN fit THEN v WHEN moved IS NOT NULL AND (put IS NULL OR put = moved) THEN moved WHEN moved IS NULL AND put IS NOT NULL THEN put END AS t FROM {name}2)"


SQL_AGREEMENT = f"""WITH {P._OUT}, {_ELIG}, {_answer(FIRST, 'fa')}, {_answer(SECOND, 'fb')},
o AS (SELECT e.cell_id, c_text AS baseline, c_alternative, fa.t AS a, fb.t AS b, {S.number('c_text')} AS n0, {S.number('fa.t')} AS na, {S.number('fb.t')} AS nb FROM eligible e LEFT JOIN fa USING (cell_id) LEFT JOIN fb USING (cell_id)),
r AS (SELECT *, CASE WHEN a IS NULL THEN 'first_unavailable' WHEN b IS NULL AND na IS NOT DISTINCT FROM n0 THEN 'baseline_supported' WHEN b IS NULL THEN 'second_unavailable' WHEN na IS DISTINCT FROM nb THEN 'disagreement' WHEN na IS NOT DISTINCT FROM n0 THEN 'agreed_unchanged' ELSE 'changed' END AS outcome FROM o)
SELECT cell_id, outcome, CASE WHEN outcome = 'changed' THEN a ELSE baseline END AS final_text FROM r"""


@query(SQL_AGREEMENT)
def agreement_update(spark, sf):
    e = table(spark, sf, "evidence")
    return A.agree(A.eligible(P._flagged(spark, sf)), A.answers(e, FIRST, "first"), A.answers(e, SECOND, "second")).select("cell_id", "outcome", "final_text")
