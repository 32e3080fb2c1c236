"""Schema drift and nested results: edge cases and the literal rule."""

import json
from datetime import datetime

from ledgermill.operators.drift import Drift, assign, compiled_schema, distance, script, tree
from ledgermill.operators.nested import FlatTables, position
from ledgermill.plans.catalog import QUERIES

JOBS = "id string, station_id string, batch_seq int, batch_file string, status string, updated_at string, received_at timestamp, result_json string, path string, type string, rank int"


def jobs(spark, rows):
    return spark.createDataFrame([(i, s, n, f"{s}/{n}", "ready", u, datetime(2030, 1, 1), j if j is None or isinstance(j, str) else json.dumps(j), "x", "y", 1) for i, s, n, u, j in rows], JOBS)


def changes(spark, *files):
    rows = [(f"j{n}{k}", "s", n, "2030", j) for n, js in files for k, j in enumerate(js)]
    return {(r.batch_seq, r.old_path, r.new_path, r.change_kind) for r in Drift(jobs(spark, rows)).changes().collect()}


def test_changes(spark):
    one = {"a": 1, "t": {"x": "1", "k": [{"m": True, "n": None}]}, "d": None}
    two = {"b": 2, "t": {"x": 1, "k": [{"m": True}, {"p": "", "q": 0}]}}
    got = changes(spark, (3, [one, None, "{cut", "[]"]), (5, [two, two]), (6, [two]))
    assert got == {(5, "a", "b", "renamed"), (5, "t.x", "t.x", "retyped"), (5, "", "t.k[].p", "added"), (5, "", "t.k[].q", "added")}


def test_renamed_parent_other_type_and_empty_file(spark):
    got = changes(spark, (1, [{"o": {"x": 1}, "l": 1}]), (2, [{"n": {"x": 1}, "l": 1}]), (3, [None]), (4, [{"l": "s"}]), (5, [{"m": 1}]))
    assert got == {
        (2, "o", "n", "renamed"), (2, "o.x", "", "removed"), (2, "", "n.x", "added"),
        (3, "n", "", "removed"), (3, "n.x", "", "removed"), (3, "l", "", "removed"), (4, "", "l", "added"), (5, "l", "", "removed"), (5, "", "m", "added"),
    }


def test_data_members_are_no_paths(spark):
    assert changes(spark, (1, [{"candidate_scores": {"1.5": 0.1}}]), (2, [{"candidate_scores": {"7": 0.2}}])) == set()


def test_script_moves_and_assignment():
    old = [("a", "object"), ("a.x", "object"), ("a.x.y", "string"), ("b", "object")]
    new = [("a", "object"), ("b", "object"), ("b.x", "object"), ("b.x.y", "string")]
    assert [r[0] for r in script(old, new)] == ["move", "follow"]
    cost, _ = distance(tree([("first_name", "string"), ("age", "number")]), tree([("name_first", "string"), ("years", "number")]))
    assert 2 < cost <= 3
    assert assign([[4.0, 1.0, 3.0], [2.0, 0.0, 5.0], [3.0, 2.0, 2.0]]) == [1, 0, 2]


def test_consistent_table(spark):
    rows = [("j1", "s", 1, "1", {"a": {"v": 1}, "w": True}), ("j2", "s", 2, "1", {"a": {"u": 2}, "w": "yes"}), ("j3", "s", 3, "1", {"a": {"u": 3, "z": [1, 2]}, "w": None}), ("j4", None, None, None, "{}"), (None, "s", 3, "1", None)]
    t = Drift(jobs(spark, rows)).table()
    got = {r.id: r.result.asDict(True) for r in t.collect()}
    assert [got[k]["a"]["u"] for k in ("j1", "j2", "j3")] == [1.0, 2.0, 3.0]
    assert [got[k]["w"] for k in ("j1", "j2", "j3")] == ["true", "yes", None] and got["j3"]["a"]["z"] == ["1", "2"] and "j4" in got


def test_consistent_table_keeps_every_row(spark, tmp_path):
    rows = [("j1", "s", 1, "1", {"a": 1}), ("j2", "s", 1, "1", None), ("j3", "s", 2, "1", '{"a": 1, "b"'), ("j4", "s", 2, "1", "[1]"), ("j5", None, None, "1", " "), ("j6", "s", 2, "1", "null"), ("j1", "s", 2, "2", None)]
    jobs(spark, rows).write.parquet(str(tmp_path / "jobs.parquet"))
    got = sorted((r.id, r.station_id or "", r.status, r.result.a if r.result else -1.0, r.no_result or "") for r in QUERIES["p2_table"](spark, str(tmp_path)).collect())
    assert got == sorted([("j1", "s", "ready", 1.0, ""), ("j2", "s", "ready", -1.0, "null"), ("j3", "s", "ready", -1.0, "cut"), ("j4", "s", "ready", -1.0, "no object"), ("j5", "", "ready", -1.0, "empty"), ("j6", "s", "ready", -1.0, "no object"), ("j1", "s", "ready", -1.0, "null")])


def test_members_of_a_renamed_object(spark):
    rows = [("j1", "s", 1, "1", {"old": {"x": 1, "y": "a"}, "x": "root"}), ("j2", "s", 2, "1", {"new": {"x": 2, "y": "b"}, "x": "root"}), ("j3", "t", 1, "1", {"new": {"x": 3}}), ("j4", "u", 1, "1", {"old": {"z": "c"}})]
    got = {r.id: (r.result.old.asDict(), r.result.x) for r in Drift(jobs(spark, rows)).table().collect()}
    assert got == {"j1": ({"x": 1.0, "y": "a", "z": None}, "root"), "j2": ({"x": 2.0, "y": "b", "z": None}, "root"), "j3": ({"x": 3.0, "y": None, "z": None}, None), "j4": ({"x": None, "y": None, "z": "c"}, None)}


def test_moves_and_several_renames_are_joined(spark):
    rows = [
        ("j1", "s", 1, "1", {"meta": {"note": {"by": "x", "n": 1}}, "first_name": "a", "last_name": "b", "keep": {"k": 1}}),
        ("j2", "s", 2, "1", {"meta": {"m": True}, "name_first": "c", "name_last": "d", "keep": {"k": 2, "note": {"by": "y", "n": 2}}}),
        ("j3", "s", 3, "1", {"meta": {"m": False}, "name_first": "e", "name_last": "f", "keep": {"k": 3, "note": {"by": "z", "n": 3}}}),
    ]
    d = Drift(jobs(spark, rows))
    assert {r.op for r in d.scripts().collect()} >= {"move", "rename"}
    got = {r.id: r.result for r in d.table().collect()}
    assert [(got[k].name_first, got[k].name_last, got[k].keep.note.by, got[k].keep.note.n, got[k].keep.k) for k in ("j1", "j2", "j3")] == [("a", "b", "x", 1.0, 1.0), ("c", "d", "y", 2.0, 2.0), ("e", "f", "z", 3.0, 3.0)]
    assert "first_name" not in got["j1"].asDict() and "note" not in got["j1"].meta.asDict()


def test_moves_inside_and_out_of_array_elements(spark):
    rows = [
        ("j1", "s", 1, "1", {"l": [{"a": {"x": {"y": 1}}, "b": {"z": 1}}, {"a": {}}], "o": {}}),
        ("j2", "s", 2, "1", {"l": [{"a": {"w": 1}, "b": {"z": 2, "x": {"y": 2}}}], "o": {}}),
        ("j3", "s", 3, "1", {"l": [{"a": {"w": 1}, "b": {"z": 3}}], "o": {"x": {"y": 3}}}),
    ]
    got = {r.id: r.result for r in Drift(jobs(spark, rows)).table().collect()}
    joined = [got[k].l[0].b.x or got[k].l[0].a.x if "x" in got[k].l[0].a.asDict() else got[k].l[0].b.x for k in ("j1", "j2")]
    assert [x.y for x in joined] == [1.0, 2.0] and got["j3"].o.x.y == 3.0 and ("x" in got["j1"].l[0].a.asDict()) != ("x" in got["j1"].l[0].b.asDict())


def test_keys_as_members_are_refused(spark, monkeypatch):
    import pytest

    from ledgermill.operators import drift

    monkeypatch.setattr(drift, "MAX_PATHS", 50)
    with pytest.raises(ValueError, match="data keys"):
        Drift(jobs(spark, [("j", "s", 1, "1", {f"k{i}": i for i in range(60)})])).projection()


def test_compiled_schema():
    assert compiled_schema({"a": ("a", "object"), "a.b": ("a.b", "number"), "l": ("l", "array"), "l[].c": ("l[].c", "string")}) == "`a` struct<`b`:double>, `l` array<struct<`c`:string>>"


def test_empty_jobs(spark):
    d = Drift(jobs(spark, []))
    assert d.changes().collect() == [] and d.table().collect() == []
    assert FlatTables(jobs(spark, [])).nodes.collect() == []


def test_nodes(spark):
    job = {
        "template": {"column_rules": [{"name": "A"}, {"role": "data"}, 7], "cell_rules": [{"id": "r1", "constraints": {"minimum": 1}}]},
        "pages": [{"page_index": "2", "cells": [{"row": 1, "column": "3", "candidate_scores": {"1.5": 0.9, "7": None}, "slow_mode_evidence": {"model_a": {"reading": "1.5"}, "model_b": None}}, {"candidate_scores": [{"reading": "8", "score": 1}]}], "fields": [{"region_id": "f"}, None]}],
    }
    rows = [("j", "s", 1, "2030-01-02", job), ("j", "s", 2, "2030-01-02", job), ("j", "s", 3, "2030-01-01", {"pages": [{}] * 9}), ("j", "s", 3, "2030-01-03", '{"cut'), (None, "s", 1, "x", job), ("k", "s", 1, None, {}), ("m", "s", 1, "1", "null")]
    got = sorted((r.job_id, r.node_level, r.page_index, r.cell_row, r.cell_column, r.item) for r in FlatTables(jobs(spark, rows)).nodes.collect())
    assert got == sorted([
        ("j", "job", -1, -1, -1, ""), ("j", "column_rule", -1, -1, -1, "A"), ("j", "column_rule", -1, -1, -1, ""), ("j", "cell_rule", -1, -1, -1, "r1"), ("j", "page", 2, -1, -1, ""),
        ("j", "field", 2, -1, -1, "f"), ("j", "cell", 2, 1, 3, ""), ("j", "candidate", 2, 1, 3, "1.5"), ("j", "candidate", 2, 1, 3, "7"), ("j", "model_reading", 2, 1, 3, "model_a"),
        ("j", "cell", 2, -1, -1, ""), ("j", "candidate", 2, -1, -1, "8"), ("k", "job", -1, -1, -1, ""),
    ])
    f = FlatTables(jobs(spark, rows))
    cells, scores = f.table("cell"), f.table("candidate")
    keys = cells.select(cells.node_key.alias("parent_key"))
    assert scores.join(keys, "parent_key").count() == scores.count() == 3
    assert [r.score for r in scores.orderBy("item").collect()] == [0.9, None, 1.0]


def test_rows_that_only_one_parser_takes(spark):
    good, later = json.dumps({"pages": [{"page_index": 3}]}), "2030-02-02"
    rows = [("a", "s", 1, "2030-01-01", good), ("a", "s", 1, later, good + " x"), ("b", "s", 1, "1", '{"pages": []} {'), ("c", "s", 1, "1", '{"v": NaN}'), ("d", "s", 1, "1", good), ("d", "s", 1, later, '{"v": Infinity, "pages": []}'), ("e", "s", 1, later, "{}"), ("e", "s", 1, "1", good)]
    got = sorted((r.job_id, r.node_level, r.page_index) for r in FlatTables(jobs(spark, rows)).nodes.collect())
    assert got == [("a", "job", -1), ("a", "page", 3), ("d", "job", -1), ("d", "page", 3), ("e", "job", -1)]


def test_every_cut_is_seen(spark):
    whole = json.dumps({"a": [1, {"b": "x\\\"é"}], "c": None})
    rows = [(f"j{i}", "s", 1, "1", whole[:i]) for i in range(len(whole) + 1)]
    assert [r.job_id for r in FlatTables(jobs(spark, rows)).nodes.collect()] == [f"j{len(whole)}"]


def test_flat_tables_keep_every_member(spark):
    cells = [
        {"row": 1, "column": 1, "raw_text": "1", "writer_suggestion": "w", "applied_rule": "a", "preview_crop_path": "p", "slow_mode_evidence": {"policy_name": "two", "model_a": "1", "left": 2}},
        {"row": 1, "column": "x", "rawText": "2", "text": "3", "conf": 0.5, "review_state": "ok", "alts": ["4"], "new": {"a": 1}},
        {"row": 1, "column": 3, "raw_text": None, "reading_raw": "5", "finalText": "6", "text": "7", "score": "0.25", "state": "ok", "other_readings": [], "candidate_scores": "none"},
    ]
    rule = {"id": "r", "row_start": 0, "column_start": "2", "column_end": "none", "color": "#fff", "constraints": {"suggestMissingDecimal": "yes", "lower_bound": 0.5, "odd": 1}}
    job = {
        "input_path": "/in", "engine": "e", "app_build": 5, "template": {"id": "t", "revision": 3, "column_rules": [{"name": "A", "purpose": "data", "propose_separator": True, "upper_bound": 7, "expected_maximum": 6, "hue": None}], "cell_rules": [rule]},
        "pages": [{"page_index": 0, "page_file": "f", "skipped_rows": [1], "cells": cells, "fields": [{"region_id": "d", "accepted_text": "x", "printed_label": "D"}]}],
    }
    f = FlatTables(jobs(spark, [("j", "s", 1, "1", job)]))
    one = lambda tag: f.table(tag).orderBy("ordinal").collect()
    got = [(c.raw_text, c.final_text, c.confidence, c.status, c.alternatives, c.writer_suggestion, c.applied_rule, c.preview_crop_path, c.evidence_policy) for c in one("cell")]
    assert got == [("1", None, None, None, None, "w", "a", "p", "two"), ("2", "3", "0.5", "ok", '["4"]', None, None, None, None), ("5", "6", "0.25", "ok", "[]", None, None, None, None)]
    rest = [{k: json.loads(v) if k == "new" else v for k, v in c.rest.items()} for c in one("cell")]
    assert rest == [{}, {"column": "x", "new": {"a": 1}}, {"text": "7", "candidate_scores": "none"}]
    assert one("cell")[0].evidence_rest == {"left": "2"}
    (j,), (p,), (d,), (k,), (c,) = map(one, ("job", "page", "field", "column_rule", "cell_rule"))
    assert (j.source_path, j.model_version, j.app_build, j.template_id, j.template_version, j.rest, j.template_rest) == ("/in", "e", "5", "t", "3", {}, {})
    assert (p.source_file, p.excluded_rows, p.rest) == ("f", "[1]", {}) and (d.final_text, d.printed_label, d.rest) == ("x", "D", {})
    assert (k.role, k.suggest_missing_decimal, k.maximum, k.expected_maximum, k.rest) == ("data", "true", "7", "6", {})
    assert (c.column_start, c.column_end, c.color, c.constraint_suggest_missing_decimal, c.constraint_minimum, c.constraint_rest, c.rest) == (2, None, "#fff", "yes", "0.5", {"odd": "1"}, {"column_end": "none"})


def test_position():
    assert [position(v) for v in (None, True, "3", 4.0, "x", float("inf"))] == [-1, -1, 3, 4, -1, -1]
