"""Problem 3: deeply nested results as flat tables that keep parent and child together.

Single-pass tagged emission. One depth-first visitor walks a job's JSON once and emits a
row per node with its table tag, primary key, parent key, place in the parent and
payload. The rows are written once, partitioned by tag; each flat table is a scan of its
own partition, where each member is one column whatever its spelling and members that
have no column stand in the map ``rest``.

Which row of a job is walked is settled before, in the JVM: Spark's JSON scanner tells
whole objects from cut ones, and of a job's whole rows the newest goes on. Should Python
refuse such a text all the same (letters after the object's end), the row is written under
the tag ``broken`` and its job is settled once more with Python's own check.

Cases. Null, cut or non-object JSON is no job; of several rows with one id the one of
greatest ``updated_at`` is taken (ties: latest received, then by content); members that
are missing or null give nulls in the tables and -1 as positions; positions written as
text are read as numbers; null ids are left out; other columns are ignored.
"""

from __future__ import annotations

import json
from math import isfinite

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgermill.session import stage, tune

NODES = "node_level string, node_key string, parent_key string, ordinal int, job_id string, page_index int, cell_row int, cell_column int, item string, payload string"
#: Columns of each flat table: name, type and the other spellings of the member, read side by side.
_READING = {"raw_text": "string rawText reading_raw", "final_text": "string finalText text accepted_text", "confidence": "string conf score", "status": "string review_state state"}
_RULE = {
    "value_format": "string format kind", "minimum": "string min lower_bound", "maximum": "string max upper_bound", "suggest_missing_decimal": "string suggestMissingDecimal propose_separator recover_decimal decimal_hint",
    "decimal_places": "string places fraction_digits", "allow_empty": "string allowEmpty blank_ok", "require_decimal": "string",
}
TABLES = {
    "job": {"source_path": "string input_path", "model_version": "string engine recognizer_version", "performance": "string", "review_note": "string", "app_build": "string", "template": "string"},
    "page": {"source_file": "string file page_file", "rotation": "double", "title": "string", "excluded_rows": "string skipped_rows", "excluded_columns": "string"},
    "cell": _READING | {"flags": "string", "alternatives": "string alts other_readings", "writer_suggestion": "string writer_hint", "applied_rule": "string", "preview_crop_path": "string", "slow_mode_evidence": "string"},
    "candidate": {"score": "double"},
    "model_reading": {"reading": "string", "rank": "string"},
    "field": {"name": "string"} | _READING | {"printed_label": "string"},
    "column_rule": {"name": "string", "role": "string purpose"} | _RULE | {"decimal_separator": "string separator", "expected_maximum": "string", "allowed_values": "string"},
    "cell_rule": {"name": "string", "row_start": "string", "row_end": "string", "column_start": "int", "column_end": "int", "constraints": "string", "color": "string"},
}
#: Members that are objects with columns of their own: tag -> (member, prefix of the columns, columns).
INNER = {
    "job": ("template", "template_", {"id": "string", "name": "string", "template_version": "string revision", "family_id": "string", "schema_version": "string", "header_rows": "string heading_rows", "row_label_columns": "string label_columns", "auto_fit_rows": "string", "excluded_cells": "string"}),
    "cell": ("slow_mode_evidence", "evidence_", {"policy": "string policy_name"}),
    "cell_rule": ("constraints", "constraint_", _RULE | {"prefer_expected_range": "string"}),
}
#: Members that the columns of every node hold already, each with its column.
PLACES = {"page": {"page_index": "page_index"}, "cell": {"row": "cell_row", "column": "cell_column"}, "field": {"region_id": "item"}, "cell_rule": {"id": "item"}, "candidate": {"reading": "item"}}


def _refuse(name: str):
    raise ValueError(name)


def parsed_object(text: str | None):
    """The JSON object in ``text``, or None where it is no whole JSON object."""
    if not text:
        return None
    try:
        value = json.loads(text, parse_constant=_refuse)  # NaN and Infinity are no JSON
    except (ValueError, RecursionError):
        return None
    return value if isinstance(value, dict) else None


def position(value) -> int:
    """A position as an integer; -1 where there is none."""
    try:
        return -1 if value is None or isinstance(value, bool) else int(float(value))
    except (TypeError, ValueError, OverflowError):
        return -1


def _text(value) -> str:
    return "" if value is None else value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)


def _list(value) -> list:
    return [(i, x) for i, x in enumerate(value) if isinstance(x, dict)] if isinstance(value, list) else []


def _spellings(kinds: dict[str, str]) -> dict[str, tuple[str, str, int]]:
    """Spelling -> (column, type, place among the column's spellings)."""
    return {spelling: (name, spec.split()[0], n) for name, spec in kinds.items() for n, spelling in enumerate((name, *spec.split()[1:]))}


_SPELLINGS = {tag: _spellings(kinds) for tag, kinds in TABLES.items()}
_INNER = {tag: (member, prefix, _spellings(kinds)) for tag, (member, prefix, kinds) in INNER.items()}


def _typed(value, kind: str):
    """The value in its column's type, None where it does not fit."""
    if kind == "string":
        return value
    try:
        number = None if isinstance(value, bool) else float(value)
        return None if number is None or not isfinite(number) else int(number) if kind == "int" else number
    except (TypeError, ValueError, OverflowError):
        return None


def _columns(node: dict, spellings: dict[str, tuple[str, str, int]], prefix: str = "") -> dict:
    """One value per column, of the first spelling that holds one, and all other members under ``rest``."""
    out, rest, from_place = {}, {}, {}
    for member, value in node.items():
        if value is None:
            continue
        name, kind, place = spellings.get(member, ("", "string", 0))
        found = _typed(value, kind) if name else None
        if found is None:
            rest[member] = value
            continue
        if name in out and from_place[name][0] < place:
            rest[member] = value
            continue
        if name in out:
            _, other, held = from_place[name]
            rest[other] = held
        out[name], from_place[name] = found, (place, member, value)
    return {name if name.startswith(prefix) else prefix + name: v for name, v in out.items()} | {prefix + "rest": rest}


def _flat(tag: str, node: dict, **inner) -> str:
    """A node's columns as JSON; of members that have tables of their own only what ``inner`` gives stays."""
    own = {k: inner.get(k, v) for k, v in node.items()}
    for member, column in PLACES.get(tag, {}).items():
        if column == "item" or position(own.get(member)) >= 0:
            own.pop(member, None)
    out = _columns(own, _SPELLINGS[tag])
    if tag in _INNER:
        member, prefix, spellings = _INNER[tag]
        if isinstance(own.get(member), dict):
            out |= _columns(own[member], spellings, prefix)
    return json.dumps(out, ensure_ascii=False)


def _others(value, kinds, *walked: str):
    """An object without its walked members of these kinds; a value of another kind stays as it is."""
    return {k: v for k, v in value.items() if not (k in walked and isinstance(v, kinds))} or None if isinstance(value, dict) else value


def _unwalked(value, *kinds: type):
    """A member whose nodes are walked is left out, and stays where it is of another kind."""
    return None if isinstance(value, kinds) else value


def visit(job_id: str, job: dict):
    """Depth first: (tag, key, parent, ordinal, page, row, column, item, payload) of every node."""
    yield "job", job_id, None, 0, -1, -1, -1, "", _flat("job", job, template=_others(job.get("template"), list, "column_rules", "cell_rules"), pages=_unwalked(job.get("pages"), list))
    template = job.get("template") if isinstance(job.get("template"), dict) else {}
    for tag, member, name in (("column_rule", "column_rules", "name"), ("cell_rule", "cell_rules", "id")):
        for i, rule in _list(template.get(member)):
            yield tag, f"{job_id}/{tag}/{i}", job_id, i, -1, -1, -1, _text(rule.get(name)), _flat(tag, rule)
    for i, page in _list(job.get("pages")):
        at, page_key = position(page.get("page_index")), f"{job_id}/{i}"
        yield "page", page_key, job_id, i, at, -1, -1, "", _flat("page", page, cells=_unwalked(page.get("cells"), list), fields=_unwalked(page.get("fields"), list))
        for j, region in _list(page.get("fields")):
            yield "field", f"{page_key}/f{j}", page_key, j, at, -1, -1, _text(region.get("region_id")), _flat("field", region)
        for j, cell in _list(page.get("cells")):
            row, column, cell_key = position(cell.get("row")), position(cell.get("column")), f"{page_key}/c{j}"
            scores, seen = cell.get("candidate_scores"), cell.get("slow_mode_evidence")
            yield "cell", cell_key, page_key, j, at, row, column, "", _flat("cell", cell, candidate_scores=_unwalked(scores, dict, list), slow_mode_evidence=_others(seen, object, "model_a", "model_b"))
            if isinstance(scores, dict):
                found = [(k, _flat("candidate", {"score": v})) for k, v in scores.items()]
            elif isinstance(scores, list):
                found = [(_text(x.get("reading")), _flat("candidate", x)) for _, x in _list(scores)]
            else:
                found = []
            for n, (reading, payload) in enumerate(found):
                yield "candidate", f"{cell_key}/s{n}", cell_key, n, at, row, column, reading, payload
            for n, model in enumerate(("model_a", "model_b")):
                answer = seen.get(model) if isinstance(seen, dict) else None
                if answer is not None:
                    yield "model_reading", f"{cell_key}/{model}", cell_key, n, at, row, column, model, _flat("model_reading", answer if isinstance(answer, dict) else {"reading": answer})


def _whole(batches):
    for batch in batches:
        column = batch.schema.get_field_index("result_json")
        keep = [parsed_object(t) is not None for t in batch.column(column).to_pylist()]
        yield batch.filter(pa.array(keep, pa.bool_()))


def _emit(batches):
    kinds = [pa.string()] * 3 + [pa.int32(), pa.string()] + [pa.int32()] * 3 + [pa.string()] * 2
    names = [c.split()[0] for c in NODES.split(", ")]
    for batch in batches:
        out = [[] for _ in kinds]
        for job_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            job = parsed_object(text)
            for tag, key, parent, ordinal, page, row, column, item, payload in [("broken", job_id, None, 0, -1, -1, -1, "", None)] if job is None else visit(job_id, job):
                for held, value in zip(out, (tag, key, parent, ordinal, job_id, page, row, column, item, payload)):
                    held.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds)], names)


def _rows(jobs: DataFrame) -> DataFrame:
    """id, result_json, updated_at, received_at of the rows whose JSON Spark's scanner takes for a whole object."""
    rows = jobs.select(F.col("id").cast("string").alias("id"), F.col("result_json").cast("string").alias("result_json"), F.col("updated_at").cast("string").alias("updated_at"), "received_at")
    return rows.where(F.col("id").isNotNull() & F.json_object_keys("result_json").isNotNull())


def _newest(rows: DataFrame) -> DataFrame:
    order = Window.partitionBy("id").orderBy(F.col("updated_at").desc_nulls_last(), F.col("received_at").desc_nulls_last(), F.xxhash64("result_json"))
    return rows.withColumn("rank", F.row_number().over(order)).where("rank = 1").select("id", "result_json")


def schema(tag: str) -> str:
    """The DDL of a flat table's own columns."""
    member, prefix, inner = INNER.get(tag, ("", "", {}))
    kinds = [(name, spec.split()[0]) for name, spec in TABLES[tag].items()] + [("rest", "map<string,string>")]
    if member:
        kinds += [(name if name.startswith(prefix) else prefix + name, spec.split()[0]) for name, spec in inner.items()] + [(prefix + "rest", "map<string,string>")]
    return ", ".join(f"{name} {kind}" for name, kind in kinds)


class FlatTables:
    """The emitted nodes, written once by tag, and one flat table per tag."""

    def __init__(self, jobs: DataFrame):
        tune(jobs.sparkSession)
        rows = _rows(jobs)
        emitted = stage(_newest(rows).mapInArrow(_emit, NODES), "nested-nodes", partition_by="node_level")
        broken = emitted.where("node_level = 'broken'").select(F.col("job_id").alias("id"))
        #: Every node of every job.
        self.nodes = emitted.where("node_level <> 'broken'")
        if broken.limit(1).count():
            again = rows.join(broken.hint("merge"), "id", "left_semi")
            more = stage(_newest(again.mapInArrow(_whole, again.schema)).mapInArrow(_emit, NODES), "nested-again", partition_by="node_level")
            self.nodes = self.nodes.unionByName(more)

    def table(self, tag: str) -> DataFrame:
        """The nodes of a tag: every member in one column whatever its spelling, other members in ``rest``."""
        own = self.nodes.where(F.col("node_level") == tag)  # prunes to one partition
        base = ["node_key", "parent_key", "ordinal", "job_id", "page_index", "cell_row", "cell_column", "item"]
        return own.select(*base, F.from_json("payload", schema(tag)).alias("p")).select(*base, "p.*")
