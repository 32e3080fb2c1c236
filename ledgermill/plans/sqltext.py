"""DuckDB text for the oracle queries: value rules and resolved cells."""

from __future__ import annotations

SIMPLE = r"[+\-−]?\p{Nd}+([.,]\p{Nd}+)?"
WHOLE = r"[+\-−]?\p{Nd}+"
COMPLEX = r"([<>≤≥]=?\s*)?[+\-−]?\p{Nd}+([.,]\p{Nd}+)?(\s*(±|\+/-|[-–])\s*[+\-−]?\p{Nd}+([.,]\p{Nd}+)?)?([eE][+\-−]?\p{Nd}+)?%?"
DIGITS = "０１２３４５６７８９"


def full(t: str, pattern: str) -> str:
    return f"regexp_full_match({t}, '{pattern}')"


def strip(t: str) -> str:
    return f"trim(coalesce({t}, ''))"


def plain(t: str) -> str:
    return f"translate({t}, ',−{DIGITS}', '.-0123456789')"


def number(t: str) -> str:
    s = strip(t)
    return f"(CASE WHEN {full(s, SIMPLE)} THEN try_cast({plain(s)} AS DECIMAL(38,10)) END)"


def bound(v: str) -> str:
    return f"try_cast(cast({v} AS VARCHAR) AS DECIMAL(38,10))"


def canonical(t: str) -> str:
    c = f"replace(replace(trim(regexp_replace(coalesce({t}, ''), '\\s+', ' ', 'g')), ' ', ''), '—', '−')"
    return f"(CASE WHEN {full(c, COMPLEX)} THEN replace({c}, ',', '.') ELSE {c} END)"


def flags(*pairs: tuple[str, str]) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for c, n in pairs) + "], lambda z: z IS NOT NULL)"


def errors(text: str, r: str, check_allowed: bool = True) -> str:
    t = strip(text)
    simple = full(t, SIMPLE)
    value, fmt = number(text), f"{r}.value_format"
    places = f"(CASE WHEN {simple} THEN length(regexp_extract({plain(t)}, '\\.([0-9]+)$', 1)) ELSE -1 END)"
    pairs = [
        (f"{fmt} = 'integer' AND NOT {full(t, WHOLE)}", "expected_integer"),
        (f"{fmt} = 'numeric' AND NOT {simple}", "expected_decimal_number"),
        (f"{fmt} = 'complex_numeric' AND NOT {full(t, COMPLEX)}", "invalid_numeric_format"),
        (f"{r}.decimal_places IS NOT NULL AND {places} <> {r}.decimal_places", "decimal_places_mismatch"),
        (f"{r}.require_decimal AND (NOT {simple} OR NOT regexp_matches({t}, '[.,]'))", "decimal_part_required"),
        (f"{fmt} NOT IN ('text', 'date') AND {value} < {bound(r + '.minimum')}", "below_minimum"),
        (f"{fmt} NOT IN ('text', 'date') AND {value} > {bound(r + '.maximum')}", "above_maximum"),
        (f"{fmt} = 'complex_numeric' AND NOT {simple} AND ({r}.minimum IS NOT NULL OR {r}.maximum IS NOT NULL)", "range_not_checkable"),
    ]
    if check_allowed:
        numeric = f"{fmt} IN ('numeric', 'integer', 'complex_numeric')"
        same = f"CASE WHEN {numeric} AND {full('trim(a)', SIMPLE)} AND {simple} THEN coalesce({number('a')} = {value}, false) ELSE trim(a) = {t} END"
        pairs.append((f"len({r}.allowed_values) > 0 AND len(list_filter({r}.allowed_values, lambda a: {same})) = 0", "value_not_allowed"))
    empty = f"CASE WHEN coalesce({r}.allow_empty, true) THEN []::VARCHAR[] ELSE ['required_cell_empty'] END"
    return f"(CASE WHEN {t} = '' THEN {empty} ELSE {flags(*pairs)} END)"


def warnings(text: str, r: str) -> str:
    v = number(text)
    return flags((f"{r}.value_format NOT IN ('text', 'date') AND coalesce({v} < {bound(r + '.expected_minimum')}, false) OR {r}.value_format NOT IN ('text', 'date') AND coalesce({v} > {bound(r + '.expected_maximum')}, false)", "outside_expected_range"))


def recovers(r: str) -> str:
    return f"({r}.value_format = 'numeric' AND coalesce({r}.decimal_places, 0) > 0)"


def proposal(t: str, r: str) -> str:
    n, p = f"length({t})", f"{r}.decimal_places"
    out = f"(substr({t}, 1, {n} - {p}) || '.' || substr({t}, {n} - {p} + 1, {p}))"
    return f"(CASE WHEN {recovers(r)} AND {full(t, WHOLE)} AND length(regexp_replace({t}, '^[+\\-−]', '')) > {p} AND len({errors(out, r)}) = 0 THEN {out} END)"


def reclassified(text: str, r: str) -> str:
    t = plain(strip(text))
    at, p = f"(length({t}) - {r}.decimal_places)", f"{r}.decimal_places"
    out = f"(substr({t}, 1, {at} - 1) || '.' || substr({t}, {at} + 1, {p}))"
    sign = f"(CASE WHEN regexp_matches({t}, '^[+-]') THEN 1 ELSE 0 END)"
    return f"(CASE WHEN {recovers(r)} AND regexp_full_match({t}, '[+-]?[0-9]+') AND {at} - 1 - {sign} > 0 AND substr({t}, {at}, 1) = '1' AND len({errors(out, r)}) = 0 THEN {out} END)"


AREA = "(r.row_end - r.row_start + 1) * (r.column_end - r.column_start + 1)"
FIELDS = ("value_format", "minimum", "maximum", "decimal_places", "allowed_values", "expected_minimum", "expected_maximum", "allow_empty", "suggest_missing_decimal", "prefer_expected_range", "require_decimal")
_DEFAULT = {"value_format": "'complex_numeric'", "allow_empty": "true", "prefer_expected_range": "false", "require_decimal": "false", "suggest_missing_decimal": "false"}


def letters(i: str) -> str:
    return f"(CASE WHEN {i} >= 26 THEN chr(cast({i} // 26 - 1 + 65 AS INTEGER)) ELSE '' END || chr(cast({i} % 26 + 65 AS INTEGER)))"


def address(r: str) -> str:
    start, end = f"({letters(r + '.column_start')} || ({r}.row_start + 1))", f"({letters(r + '.column_end')} || ({r}.row_end + 1))"
    return f"(CASE WHEN {start} = {end} THEN {start} ELSE {start} || ':' || {end} END)"


def resolved(cells: str = "ocr_cells", key: str = "cell_id") -> str:
    """Common table expressions ending in ``resolved``: cells with rule, rule_name, fixed, excluded and kind."""
    own = ", ".join(f"'{f}': " + (f"coalesce(own.{f}, {_DEFAULT[f]})" if f in _DEFAULT else f"own.{f}") for f in FIELDS)
    region = ", ".join(f"'{f}': region.constraints.{f}" for f in FIELDS)
    return f"""
base AS (
  SELECT c.*, t.name AS template_name, t.header_rows, t.row_label_columns, t.column_rules, t.fixed_cells, t.excluded_rows, t.excluded_columns, t.excluded_cells,
         greatest(0, len(t.row_guides) - 1) AS n_rows, greatest(0, len(t.column_guides) - 1) AS n_columns, t.column_rules[c.cell_column + 1] AS own
  FROM {cells} c JOIN templates t ON c.template_id = t.id),
regions AS (SELECT id AS template_id, unnest(cell_rules) AS r, generate_subscripts(cell_rules, 1) AS seq FROM templates),
best AS (
  SELECT b.{key}, r AS region FROM base b JOIN regions USING (template_id)
  WHERE b.cell_row BETWEEN r.row_start AND r.row_end AND b.cell_column BETWEEN r.column_start AND r.column_end
  QUALIFY row_number() OVER (PARTITION BY b.{key} ORDER BY {AREA}, seq DESC) = 1),
joined AS (
  SELECT b.*, region, coalesce(own.name, 'Column ' || (cell_column + 1)) AS own_name,
         coalesce(own.role, CASE WHEN cell_column < row_label_columns THEN 'row_label' ELSE 'data' END) AS own_role,
         list_filter(fixed_cells, lambda f: f.cell_row = b.cell_row AND f.cell_column = b.cell_column)[1].fixed_text AS fixed
  FROM base b LEFT JOIN best USING ({key})),
marked AS (
  SELECT *, CASE WHEN region IS NOT NULL THEN {{{region}}} ELSE {{{own}}} END AS rule,
         CASE WHEN region IS NOT NULL THEN region.name || ' · ' || {address('region')} ELSE own_name END AS rule_name,
         coalesce(list_contains(excluded_rows, cell_row), false) OR coalesce(list_contains(excluded_columns, cell_column), false)
           OR coalesce(len(list_filter(excluded_cells, lambda x: x.cell_row = joined.cell_row AND x.cell_column = joined.cell_column)) > 0, false)
           OR (own_role = 'ignored' AND fixed IS NULL) AS excluded,
         (cell_row < header_rows OR own_role = 'header') AND NOT coalesce(region.constraints.value_format IN ('numeric', 'integer', 'complex_numeric'), false) AS is_header,
         cell_column < row_label_columns OR own_role = 'row_label' AS is_label
  FROM joined),
resolved AS (
  SELECT *, CASE WHEN excluded THEN 'excluded' WHEN fixed IS NOT NULL THEN 'fixed' WHEN region IS NOT NULL THEN 'rule'
                 WHEN is_header OR is_label OR own_role = 'ignored' THEN 'none' ELSE 'rule' END AS kind
  FROM marked)"""


def constrained() -> str:
    """``resolved`` and then ``readings``: c_text, c_confidence, c_flags, c_alternative, status."""
    spelled = f"CASE WHEN rule.value_format IN ('numeric', 'integer', 'complex_numeric') THEN {canonical('v')} ELSE v END"
    return (
        resolved()
        + f""",
c1 AS (
  SELECT *, coalesce(text, '') AS t0, list_filter(list_transform(list_filter(list_concat([coalesce(text, '')], coalesce(candidates, [])), lambda v: v IS NOT NULL), lambda v: {spelled}), lambda v: v <> '') AS many
  FROM resolved),
c2 AS (SELECT *, list_filter(many, lambda v, i: list_position(many, v) = i) AS cands FROM c1),
c3 AS (
  SELECT *, list_filter(cands, lambda v: len({errors('v', 'rule')}) = 0) AS fit,
         list_filter(list_transform(cands, lambda v: {reclassified('v', 'rule')}), lambda v: v IS NOT NULL) AS moved,
         list_filter(list_transform(cands, lambda v: {proposal('v', 'rule')}), lambda v: v IS NOT NULL) AS put
  FROM c2),
c4 AS (
  SELECT *, CASE WHEN coalesce(rule.prefer_expected_range, false) THEN list_filter(fit, lambda v: len({warnings('v', 'rule')}) = 0) ELSE [] END AS expected,
         list_filter(list_concat(moved, put), lambda v, i: list_position(list_concat(moved, put), v) = i) AS props
  FROM c3),
c5 AS (
  SELECT *, CASE WHEN len(fit) > 0 THEN coalesce(expected[1], fit[1]) WHEN len(cands) > 0 AND len(props) = 1 THEN props[1] ELSE t0 END AS chosen,
         CASE WHEN len(fit) > 0 OR len(cands) = 0 THEN cands ELSE list_concat(cands, props) END AS shown
  FROM c4),
c6 AS (
  SELECT *, CASE WHEN chosen <> '' AND chosen <> t0 THEN list_filter(coalesce(flags, []), lambda f: f NOT IN ('invalid_numeric_format', 'possible_missing_decimal', 'empty_prediction')) ELSE coalesce(flags, []) END AS kept,
         {flags(("len(fit) > 0 AND chosen <> t0 AND len(expected) > 0", "expected_range_selected_alternative"), ("len(fit) > 0 AND chosen <> t0 AND len(expected) = 0", "rule_selected_alternative"), ("len(fit) = 0 AND len(cands) > 0 AND len(props) = 1 AND len(moved) > 0", "separator_reclassified_from_one"), ("len(fit) = 0 AND len(cands) > 0 AND len(props) = 1 AND len(moved) = 0", "separator_inferred_from_rule"), ("len(fit) = 0 AND len(cands) > 0 AND len(props) <> 1", "rule_conflict"), ("len(fit) = 0 AND len(cands) > 0 AND len(props) > 1", "ambiguous_rule_proposals"), ("chosen <> ''", "value_rule_review_required"))} AS added
  FROM c5),
readings AS (
  SELECT *, CASE WHEN kind = 'rule' THEN chosen WHEN kind = 'fixed' THEN fixed WHEN kind = 'excluded' THEN '' ELSE t0 END AS c_text,
         CASE WHEN kind = 'rule' THEN coalesce(map_extract_value(candidate_confidences, chosen), CASE WHEN chosen <> t0 THEN 0.0 ELSE confidence END)
              WHEN kind IN ('fixed', 'excluded') THEN 1.0 ELSE confidence END AS c_confidence,
         CASE WHEN kind = 'rule' THEN list_sort(list_distinct(list_concat(kept, added, {errors('chosen', 'rule')}, {warnings('chosen', 'rule')})))
              WHEN kind = 'fixed' THEN ['template_fixed_value'] WHEN kind = 'excluded' THEN ['excluded_before_analysis']
              ELSE list_sort(list_distinct(coalesce(flags, []))) END AS c_flags,
         CASE WHEN kind = 'rule' THEN array_to_string(list_filter(shown, lambda v: v <> chosen), ' | ')
              ELSE array_to_string(list_filter(coalesce(candidates, []), lambda v: v <> text), ' | ') END AS c_alternative,
         CASE kind WHEN 'excluded' THEN 'excluded' WHEN 'fixed' THEN 'confirmed' ELSE 'automatic' END AS status
  FROM c6)"""
    )
