"""Queries and oracle SQL of the llm operators, by name."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgermill.llm import leakage
from ledgermill.llm.bundles import Bundles
from ledgermill.llm.consensus import Consensus
from ledgermill.llm.mixing import Mixture
from ledgermill.llm.overlap import Overlap
from ledgermill.llm.spans import SharedSpans


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _consensus(spark, sf):
    return Consensus(_t(spark, sf, "evidence"), _t(spark, sf, "ocr_cells"), _t(spark, sf, "digit_checks"))


def p1_found(spark, sf):
    return _consensus(spark, sf).contested().select("cell_id", F.col("consensus").alias("value_text"))


def p1_cells(spark, sf):
    return _consensus(spark, sf).cells()


def p1_agreement(spark, sf):
    """The whole-number part of ``p1_cells``: consensus, statements, readings and votes of every cell."""
    return _consensus(spark, sf).cells().select("cell_id", "consensus", "n_readers", "n_readings", "consensus_votes", "rival_votes", F.round("agreement", 6).alias("agreement"))


def p1_reader_agreement(spark, sf):
    return _consensus(spark, sf).agreement()


def p1_readers(spark, sf):
    return _consensus(spark, sf).readers()


def _overlap(spark, sf):
    return Overlap(_t(spark, sf, "provenance"), _t(spark, sf, "split_roles"))


def p4_found(spark, sf):
    return _overlap(spark, sf).pairs()


def p4_report(spark, sf):
    return _overlap(spark, sf).report()


def p4_links(spark, sf):
    return _overlap(spark, sf).links()


def p4_contained(spark, sf):
    return _overlap(spark, sf).contained_records()


def _bundles(spark, sf):
    return Bundles(_t(spark, sf, "provenance"), _t(spark, sf, "split_roles"))


def p5_found(spark, sf):
    return _bundles(spark, sf).found()


def p5_assign(spark, sf):
    return _bundles(spark, sf).assign()


def p5_report(spark, sf):
    return _bundles(spark, sf).report()


def p5_forest(spark, sf):
    """The spanning forest that holds the bundles together: key pairs and the round in which each was taken."""
    return _bundles(spark, sf).forest


def p6_found(spark, sf):
    return leakage.leaks(_t(spark, sf, "documents"), _t(spark, sf, "eval_items")).select("doc_id", "item_id")


def p6_report(spark, sf):
    items = _t(spark, sf, "eval_items")
    return leakage.report(leakage.leaks(_t(spark, sf, "documents"), items, short=True), items)


#: Vocabulary file of a public byte-level tokenizer.
TOKENIZER = os.environ.get("TOKENIZER_FILE", "/opt/tokenizers/byte_bpe_multi_50k.tiktoken")


def _mixture(spark, sf):
    return Mixture(_t(spark, sf, "documents"), _t(spark, sf, "source_targets"), TOKENIZER)


def p7_found(spark, sf):
    return _mixture(spark, sf).exhausted()


def p7_mix(spark, sf):
    return _mixture(spark, sf).rows()


def p7_report(spark, sf):
    return _mixture(spark, sf).report()


def _mixture_of_characters(spark, sf):
    return Mixture(_t(spark, sf, "documents"), _t(spark, sf, "source_targets"), None, seed=7)


def p7_mix_characters(spark, sf):
    """The same mix with sizes in characters, which SQL can count too."""
    return _mixture_of_characters(spark, sf).rows()


def p7_report_characters(spark, sf):
    return _mixture_of_characters(spark, sf).report()


def p8_found(spark, sf):
    return SharedSpans(_t(spark, sf, "documents")).pairs()


def p8_coverage(spark, sf):
    return SharedSpans(_t(spark, sf, "documents")).coverage()


def queries() -> dict:
    return {k: v for k, v in globals().items() if k[:1] == "p" and k[1:2].isdigit()}


# Oracle SQL: the definitions, written plainly. They compare whole tables and are meant for small scales.


def _plain(v: str) -> str:
    return f"nullif(ltrim(translate(regexp_replace({v}, '[\\s]', '', 'g'), '０１２３４５６７８９,−–', '0123456789.--'), '+'), '')"


def _p1(rounds: int = 8) -> str:
    """Votes, then rounds of reliabilities and weighted readings; the lead is clear in every cell."""
    sql = f"""WITH m AS (SELECT cell_id, 'm:' || model AS reader, {_plain('arg_max(value_text, (support, value_text))')} AS v FROM evidence WHERE cell_id IS NOT NULL AND {_plain('value_text')} IS NOT NULL GROUP BY cell_id, model),
u AS (SELECT * FROM m UNION ALL SELECT cell_id, 'pipeline', {_plain('candidates[1]')} FROM ocr_cells WHERE {_plain('candidates[1]')} IS NOT NULL),
dc AS (SELECT cell_id, arg_max(predicted, (support, predicted)) AS pr FROM digit_checks WHERE predicted <> '' GROUP BY cell_id),
votes AS MATERIALIZED (SELECT * FROM u UNION ALL SELECT DISTINCT u.cell_id, 'digits', u.v FROM u JOIN dc ON u.cell_id = dc.cell_id AND regexp_replace(u.v, '[^0-9]', '', 'g') = dc.pr),
w0 AS (SELECT DISTINCT reader, 1.0::DOUBLE AS w FROM votes)"""
    for i in range(rounds):
        sql += f""",
s{i} AS MATERIALIZED (SELECT cell_id, v, sum(w) AS s, count(*) AS n FROM votes JOIN w{i} USING (reader) GROUP BY cell_id, v),
q{i} AS MATERIALIZED (SELECT cell_id, v, exp(s - max(s) OVER p) / sum(exp(s)) OVER p * exp(max(s) OVER p) AS q FROM s{i} WINDOW p AS (PARTITION BY cell_id)),
w{i + 1} AS MATERIALIZED (SELECT reader, ln(2 * (sum(q) + 1) / (sum(1 - q) + 1)) AS w FROM votes JOIN q{i} USING (cell_id, v) GROUP BY reader)"""
    last = f"s{rounds - 1}"
    return sql + f""",
r AS (SELECT *, row_number() OVER (PARTITION BY cell_id ORDER BY s DESC, v) AS place FROM {last})"""


_P1_CELLS = """,
cells AS (SELECT cell_id FROM evidence WHERE cell_id IS NOT NULL AND {plain} IS NOT NULL UNION SELECT cell_id FROM ocr_cells WHERE cell_id IS NOT NULL UNION SELECT cell_id FROM digit_checks WHERE cell_id IS NOT NULL AND predicted <> ''),
per AS (SELECT cell_id, max(v) FILTER (place = 1) AS consensus, sum(n)::INTEGER AS n_readers, count(*)::INTEGER AS n_readings, max(n) FILTER (place = 1)::INTEGER AS consensus_votes, coalesce(max(n) FILTER (place > 1), 0)::INTEGER AS rival_votes FROM r GROUP BY cell_id)
SELECT cell_id, consensus, coalesce(n_readers, 0) AS n_readers, coalesce(n_readings, 0) AS n_readings, coalesce(consensus_votes, 0) AS consensus_votes, coalesce(rival_votes, 0) AS rival_votes, coalesce(round(consensus_votes / n_readers, 6), 0.0) AS agreement FROM cells LEFT JOIN per USING (cell_id)""".format(plain=_plain("value_text"))
_P1_READERS = """, said AS (SELECT CASE WHEN reader = 'digits' THEN 'digit_check' WHEN reader = 'pipeline' THEN reader ELSE 'model:' || reader[3:] END AS reader, votes.v, r.v AS won FROM votes JOIN r ON r.cell_id = votes.cell_id AND place = 1)
SELECT reader, count(*)::BIGINT AS n_statements, count(*) FILTER (v = won)::BIGINT AS n_agreed FROM said GROUP BY reader"""
_P1_FOUND = """ SELECT a.cell_id, a.v AS value_text FROM r a WHERE place = 1 AND EXISTS (SELECT 1 FROM r b WHERE b.cell_id = a.cell_id AND b.place > 1 AND b.n >= a.n)"""


_RECORDS = "rec AS (SELECT record_id, dataset, document_id, source_group, crop_sha256, raw_text, coalesce(r.split_role, 'none') AS role FROM (SELECT * FROM provenance WHERE record_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY record_id ORDER BY loaded_at DESC) = 1) p LEFT JOIN split_roles r ON lower(trim(p.source_split)) = r.source_split)"

_P4_TEXTS = f"{_RECORDS}, x AS (SELECT record_id, role, coalesce(dataset, '') AS dataset, nullif(trim(regexp_replace(lower(trim(crop_sha256)), '^sha256:', '')), '') AS crop, trim(regexp_replace(strip_accents(lower(coalesce(raw_text, ''))), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) AS t FROM rec WHERE role <> 'none')"
_P4 = f"""WITH {_P4_TEXTS}
SELECT DISTINCT least(a.record_id, b.record_id) AS record_id_a, greatest(a.record_id, b.record_id) AS record_id_b FROM x a JOIN x b ON a.role = 'train' AND b.role <> 'train'
WHERE a.crop = b.crop OR (length(a.t) >= 40 AND length(b.t) >= 40 AND abs(length(a.t) - length(b.t)) * 10 <= greatest(length(a.t), length(b.t)) AND levenshtein(a.t, b.t) * 10 <= greatest(length(a.t), length(b.t)))"""
_P4_CLASSES = f"""WITH {_P4_TEXTS}, cl AS (SELECT t, min(record_id) AS id, bool_or(role <> 'train') AS ev, bool_or(role = 'train') AS tr, string_split(t, ' ') AS w FROM x WHERE length(t) >= 40 GROUP BY t),
eg AS (SELECT DISTINCT id, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT id, w, least(5, len(w)) AS n, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS i FROM cl WHERE ev)),
tg AS (SELECT DISTINCT id, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM cl, (SELECT DISTINCT n FROM eg) k WHERE tr AND len(w) >= n)),
held AS (SELECT eg.id AS eval, tg.id AS train, count(*) AS c FROM eg JOIN tg USING (n, g) GROUP BY ALL),
many AS (SELECT id AS eval, count(*) AS n_grams FROM eg GROUP BY id)"""
_P4_NEAR = "near AS (SELECT a.id AS eval, b.id AS train, levenshtein(a.t, b.t) AS edits FROM cl a JOIN cl b ON a.ev AND b.tr AND a.id <> b.id WHERE abs(length(a.t) - length(b.t)) * 10 <= greatest(length(a.t), length(b.t)) AND levenshtein(a.t, b.t) * 10 <= greatest(length(a.t), length(b.t)))"
_P4_LINKS = f"{_P4_CLASSES}, {_P4_NEAR} SELECT eval, train, edits::INTEGER AS edits, round(coalesce(c, 0) / n_grams, 6) AS containment FROM near JOIN many USING (eval) LEFT JOIN held USING (eval, train)"
_P4_CONTAINED = f"""{_P4_CLASSES}, p AS (SELECT eval, count(*) AS n_train_texts, round(max(c / n_grams), 6) AS containment FROM held JOIN many USING (eval) WHERE c / n_grams >= 0.8 - 1e-9 GROUP BY eval)
SELECT record_id, role, n_train_texts, containment FROM x JOIN cl USING (t) JOIN p ON p.eval = cl.id WHERE role <> 'train'"""
_P4_REPORT = f"""{_P4_CLASSES}, {_P4_NEAR}, h AS (SELECT role, dataset, coalesce(crop IN (SELECT crop FROM x WHERE role = 'train' AND crop IS NOT NULL), false)::BIGINT AS c, coalesce(cl.tr, false)::BIGINT AS e, (cl.id IS NOT NULL AND cl.id IN (SELECT eval FROM near))::BIGINT AS n FROM x LEFT JOIN cl USING (t) WHERE role <> 'train')
SELECT role AS split_role, dataset, count(*) AS n_records, sum(c)::BIGINT AS by_crop, sum(e)::BIGINT AS by_text, sum(n)::BIGINT AS by_near, sum(greatest(c, e, n))::BIGINT AS n_overlapping FROM h GROUP BY ALL"""

_KEY = lambda c: f"CASE WHEN lower(trim({c})) NOT IN ('', 'unknown', 'n/a', '-', 'none') THEN lower(trim({c})) END"
_P5 = f"""WITH RECURSIVE {_RECORDS}, k AS (SELECT record_id AS r, role, {_KEY('document_id')} AS d, {_KEY('source_group')} AS g FROM rec),
e AS (SELECT DISTINCT a.r AS x, b.r AS y FROM k a JOIN k b ON a.d = b.d UNION SELECT DISTINCT a.r, b.r FROM k a JOIN k b ON a.g = b.g),
c(x, y) AS (SELECT r, r FROM k UNION SELECT c.x, e.y FROM c JOIN e ON c.y = e.x),
b AS (SELECT k.r, k.role, min(c.y) AS bundle_key FROM k JOIN c ON c.x = k.r GROUP BY k.r, k.role)
SELECT DISTINCT bundle_key, role AS split_role FROM b WHERE role <> 'none' AND bundle_key IN (SELECT bundle_key FROM b WHERE role <> 'none' GROUP BY 1 HAVING count(DISTINCT role) > 1)"""


def _words(id_: str, text: str, source: str) -> str:
    clean = f"lower(regexp_replace(regexp_replace({text}, '[­​﻿⁠]', '', 'g'), '([\\p{{L}}\\p{{N}}])[-‐][ \\t]*\\r?\\n\\s*([\\p{{L}}\\p{{N}}])', '\\1\\2', 'g'))"
    return f"SELECT DISTINCT id, array_to_string(w[i:i + 11], ' ') AS run FROM (SELECT id, w, unnest(range(1, len(w) - 10)) AS i FROM (SELECT {id_} AS id, regexp_extract_all({clean}, '[\\p{{L}}\\p{{N}}]+') AS w FROM {source} WHERE {id_} IS NOT NULL AND {text} IS NOT NULL) WHERE len(w) >= 12)"


_P6 = f"SELECT DISTINCT d.id AS doc_id, i.id AS item_id FROM ({_words('doc_id', 'text', 'documents')}) d JOIN ({_words('item_id', 'item_text', 'eval_items')}) i USING (run)"

_CLEAN = lambda t: f"lower(regexp_replace(regexp_replace({t}, '[­​﻿⁠]', '', 'g'), '([\\p{{L}}\\p{{N}}])[-‐][ \\t]*\\r?\\n\\s*([\\p{{L}}\\p{{N}}])', '\\1\\2', 'g'))"
_P6_REPORT = f"""WITH it AS (SELECT item_id, suite, split_role, regexp_extract_all({_CLEAN('item_text')}, '[\\p{{L}}\\p{{N}}]+') AS w FROM eval_items WHERE item_id IS NOT NULL),
ip AS (SELECT item_id, w, len(w) AS n, CASE WHEN len(w) >= 12 THEN 12 ELSE len(w) END AS piece FROM it WHERE len(w) >= 5),
ig AS (SELECT item_id, piece, i, array_to_string(w[i:i + piece - 1], ' ') AS g FROM (SELECT item_id, w, piece, unnest(range(1, n - piece + 2)) AS i FROM ip)),
dw AS (SELECT doc_id, regexp_extract_all({_CLEAN('text')}, '[\\p{{L}}\\p{{N}}]+') AS w FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
dg AS (SELECT doc_id, piece, d, array_to_string(w[d:d + piece - 1], ' ') AS g FROM (SELECT doc_id, w, piece, unnest(range(1, len(w) - piece + 2)) AS d FROM dw, (SELECT DISTINCT piece FROM ip))),
m AS (SELECT doc_id, item_id, piece, i, d - i AS diag FROM ig JOIN dg USING (piece, g)),
r AS (SELECT doc_id, item_id, max(i) - min(i) + max(piece) AS len FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, item_id, diag ORDER BY i) AS k FROM m) GROUP BY doc_id, item_id, diag, k),
c AS (SELECT doc_id, item_id, count(*) AS words FROM (SELECT DISTINCT doc_id, item_id, unnest(range(i, i + piece)) AS pos FROM m) GROUP BY ALL),
f AS (SELECT doc_id, item_id, longest, words, n FROM (SELECT doc_id, item_id, max(len) AS longest FROM r GROUP BY ALL) JOIN c USING (doc_id, item_id) JOIN ip USING (item_id)),
p AS (SELECT item_id, count(*) AS n_docs, sum((longest = n)::BIGINT)::BIGINT AS n_whole, max(longest)::INTEGER AS longest_run, round(max(words / n), 6) AS containment FROM f GROUP BY item_id)
SELECT item_id, suite, split_role, coalesce(n_docs, 0) AS n_docs, coalesce(n_whole, 0) AS n_whole, coalesce(longest_run, 0) AS longest_run, coalesce(containment, 0.0) AS containment FROM it LEFT JOIN p USING (item_id)"""

# Any common tokenizer gives the same sources; here words, numbers and runs of signs are the tokens.
_P7 = """WITH n AS (SELECT lower(trim(source)) AS source, len(regexp_extract_all(coalesce(text, ''), '\\p{L}+|\\p{N}+|[^\\s\\p{L}\\p{N}]+')) AS n FROM documents),
s AS (SELECT t.source, t.target_share, t.max_repeats, coalesce(sum(n.n), 0) AS n FROM source_targets t LEFT JOIN n ON n.source = lower(trim(t.source)) GROUP BY ALL)
SELECT source FROM s WHERE n * max_repeats < target_share * (SELECT sum(n) FROM s)"""

_P7_MIX = """WITH d AS (SELECT doc_id, min(lower(trim(source))) AS source, max(length(coalesce(text, ''))) AS n FROM documents WHERE doc_id IS NOT NULL AND lower(trim(source)) IN (SELECT lower(trim(source)) FROM source_targets) GROUP BY doc_id),
q AS (SELECT *, sum(n) OVER (PARTITION BY source ORDER BY md5('7:' || doc_id), doc_id) AS upto, sum(n) OVER (PARTITION BY source) AS tokens FROM d),
c AS (SELECT q.source, doc_id, n, unnest(range(1, max_repeats + 1))::INTEGER AS copy, upto, tokens, target_share FROM q JOIN source_targets t ON lower(trim(t.source)) = q.source),
f AS (SELECT source, doc_id, copy, n, (tokens * (copy - 1) + upto)::DOUBLE / target_share AS finish FROM c),
mix AS (SELECT source, doc_id, copy, n::BIGINT AS n_tokens, finish, running::BIGINT AS running FROM (SELECT *, sum(n) OVER (ORDER BY finish, source, copy, doc_id) AS running FROM f) WHERE running <= (SELECT sum(n) FROM d))"""
_P7_REPORT = """, used AS (SELECT source, sum(n_tokens) AS u, count(*) AS r, max(copy) AS m FROM mix GROUP BY source), own AS (SELECT source, count(*) AS n_docs, sum(n) AS s FROM d GROUP BY source)
SELECT lower(trim(t.source)) AS source, target_share, max_repeats, coalesce(n_docs, 0) AS n_docs, coalesce(s, 0)::BIGINT AS source_tokens, coalesce(u, 0)::BIGINT AS used_tokens, coalesce(r, 0) AS used_rows, coalesce(m, 0) AS used_copies,
 coalesce(r, 0) = coalesce(n_docs, 0) * max_repeats AND coalesce(u, 0) < target_share * (SELECT sum(n) FROM d) AS exhausted, round(coalesce(u, 0) / (SELECT sum(n_tokens) FROM mix), 6) AS actual_share
FROM source_targets t LEFT JOIN used ON used.source = lower(trim(t.source)) LEFT JOIN own ON own.source = lower(trim(t.source))"""

_P8 = """WITH w AS (SELECT doc_id, md5(substr(text, i, 300)) AS h FROM (SELECT doc_id, text, unnest(range(1, length(text) - 298)) AS i FROM documents WHERE doc_id IS NOT NULL AND length(text) >= 300)),
d AS (SELECT DISTINCT doc_id, h FROM w WHERE h IN (SELECT h FROM w GROUP BY h HAVING count(DISTINCT doc_id) > 1))
SELECT DISTINCT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM d a JOIN d b ON a.h = b.h AND a.doc_id < b.doc_id"""

_P8_COVERAGE = """WITH d AS (SELECT DISTINCT doc_id, coalesce(text, '') AS text FROM documents WHERE doc_id IS NOT NULL),
c AS (SELECT text, min(doc_id) AS class_id, count(*) AS n_copies FROM d WHERE length(text) >= 300 GROUP BY text),
w AS (SELECT doc_id, i, md5(substr(text, i, 300)) AS h FROM (SELECT doc_id, text, unnest(range(1, length(text) - 298)) AS i FROM d WHERE length(text) >= 300)),
s AS (SELECT doc_id, i FROM w WHERE h IN (SELECT h FROM w GROUP BY h HAVING count(DISTINCT doc_id) > 1)),
m AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 300 THEN 0 ELSE 1 END AS new FROM s)),
p AS (SELECT doc_id, count(*) AS n_spans, sum(len) AS chars, max(len) AS longest FROM (SELECT doc_id, max(i) + 300 - min(i) AS len FROM m GROUP BY doc_id, k) GROUP BY doc_id)
SELECT doc_id, coalesce(class_id, doc_id) AS class_id, coalesce(n_copies, 1) AS n_copies, length(text)::INTEGER AS n_chars, coalesce(n_spans, 0) AS n_spans, coalesce(chars, 0)::BIGINT AS shared_chars, coalesce(longest, 0)::BIGINT AS longest_span, round(coalesce(chars, 0) / greatest(length(text), 1), 6) AS shared_share FROM d LEFT JOIN c USING (text) LEFT JOIN p USING (doc_id)"""


def oracle_sql() -> dict[str, str]:
    return {"p1_found": _p1() + _P1_FOUND, "p1_agreement": _p1() + _P1_CELLS, "p1_reader_agreement": _p1() + _P1_READERS, "p4_found": _P4, "p4_links": _P4_LINKS, "p4_contained": _P4_CONTAINED, "p4_report": _P4_REPORT, "p5_found": _P5, "p6_found": _P6, "p6_report": _P6_REPORT, "p7_found": _P7, "p7_mix_characters": _P7_MIX + " SELECT * FROM mix", "p7_report_characters": _P7_MIX + _P7_REPORT, "p8_found": _P8, "p8_coverage": _P8_COVERAGE}
