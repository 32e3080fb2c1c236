"""Number grammar, canonical spellings and value rules as Column functions.

A rule is a struct column with the fields value_format, minimum, maximum,
decimal_places, allowed_values, expected_minimum, expected_maximum, allow_empty,
prefer_expected_range and require_decimal. All functions work on lambda variables, so
they can be used inside ``transform`` and ``filter``. Null text counts as empty.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The number grammar (full match; \A and \z because $ would accept a line end).
SIMPLE = r"[+\-−]?\d+(?:[.,]\d+)?"
WHOLE = r"[+\-−]?\d+"
COMPLEX = r"(?:[<>≤≥]=?\s*)?[+\-−]?\d+(?:[.,]\d+)?(?:\s*(?:±|\+/-|[-–])\s*[+\-−]?\d+(?:[.,]\d+)?)?(?:[eE][+\-−]?\d+)?%?"
NUMERIC_FORMATS = ("numeric", "integer", "complex_numeric")
RULE_FIELDS = ("value_format", "minimum", "maximum", "decimal_places", "allowed_values", "expected_minimum", "expected_maximum", "allow_empty", "suggest_missing_decimal", "prefer_expected_range", "require_decimal")


def full(text: Column, pattern: str) -> Column:
    """Whole-text match with Unicode digits and blanks."""
    return text.rlike(rf"(?U)\A(?:{pattern})\z")


def strip(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\A\s+|\s+\z", "")


def is_simple(text: Column) -> Column:
    return full(strip(text), SIMPLE)


def is_complex(text: Column) -> Column:
    return full(strip(text), COMPLEX)


def clean_text(text: Column) -> Column:
    """Blanks collapsed and trimmed."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "))


def clean_numeric(text: Column) -> Column:
    return F.replace(F.replace(clean_text(text), F.lit(" "), F.lit("")), F.lit("—"), F.lit("−"))


def canonical_numeric(text: Column) -> Column:
    """Decimal comma to point, for text that is a number."""
    cleaned = clean_numeric(text)
    return F.when(is_complex(cleaned), F.replace(cleaned, F.lit(","), F.lit("."))).otherwise(cleaned)


def plain(text: Column) -> Column:
    """Decimal point, plain minus and ordinary digits."""
    return F.translate(text, ",−０１２３４５６７８９", ".-0123456789")


def number(text: Column) -> Column:
    """The value of a simple number as decimal(38,10); null otherwise or beyond 38 digits."""
    return F.when(is_simple(text), plain(strip(text)).try_cast("decimal(38,10)"))


def bound(value: Column) -> Column:
    return value.cast("string").try_cast("decimal(38,10)")


def numeric_shape(text: Column) -> Column:
    """47.2 -> ##.#; null where the text is no simple number."""
    return F.when(full(text, SIMPLE), F.regexp_replace(plain(text), r"(?U)\d", "#"))


def numeric_identity(text: Column) -> Column:
    """One spelling per value, for model agreement: no trailing zeros, '0' for zero; null if not simple."""
    t = plain(strip(text))
    value = F.when(full(t, r"[+-]?\d+(?:\.\d+)?"), t.try_cast("decimal(38,10)").cast("string"))
    return F.when(value == "0E-10", "0").otherwise(F.regexp_replace(F.regexp_replace(value, r"(\.\d*?)0+\z", "$1"), r"\.\z", ""))


def _flags(*pairs: tuple[Column, str]) -> Column:
    return F.filter(F.array(*(F.when(c, F.lit(name)) for c, name in pairs)), lambda x: x.isNotNull())


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once: a bound variable instead of a repeated expression."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _is(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def hard_errors(text: Column, rule: Column, check_allowed: bool = True) -> Column:
    """Ordered list of broken hard limits; blank text is judged by allow_empty alone."""
    def checks(t: Column) -> Column:
        return let(F.struct(full(t, SIMPLE).alias("simple"), number(t).alias("value")), lambda n: _errors(t, n["simple"], n["value"], rule, check_allowed))

    empty = F.when(F.coalesce(rule["allow_empty"], F.lit(True)), F.array().cast("array<string>")).otherwise(F.array(F.lit("required_cell_empty")))
    return let(strip(text), lambda t: F.when(t == "", empty).otherwise(checks(t)))


def _errors(t: Column, simple: Column, value: Column, rule: Column, check_allowed: bool) -> Column:
    fmt = rule["value_format"]
    numeric = fmt.isin(*NUMERIC_FORMATS)
    places = F.when(simple, F.length(F.regexp_extract(plain(t), r"(?U)\.(\d+)\z", 1))).otherwise(F.lit(-1))
    checked = simple & ~fmt.isin("text", "date")
    bounded = rule["minimum"].isNotNull() | rule["maximum"].isNotNull()
    pairs = [
        (_is((fmt == "integer") & ~full(t, WHOLE)), "expected_integer"),
        (_is((fmt == "numeric") & ~simple), "expected_decimal_number"),
        (_is((fmt == "complex_numeric") & ~full(t, COMPLEX)), "invalid_numeric_format"),
        (_is(rule["decimal_places"].isNotNull() & (places != rule["decimal_places"])), "decimal_places_mismatch"),
        (_is(rule["require_decimal"] & (~simple | ~t.rlike("[.,]"))), "decimal_part_required"),
        (_is(checked & (value < bound(rule["minimum"]))), "below_minimum"),
        (_is(checked & (value > bound(rule["maximum"]))), "above_maximum"),
        (_is(~checked & (fmt == "complex_numeric") & bounded), "range_not_checkable"),
    ]
    if check_allowed:
        listed = _is(F.size(rule["allowed_values"]) > 0)
        equal = lambda a: F.when(numeric & simple & is_simple(a), F.coalesce(number(a) == value, F.lit(False))).otherwise(strip(a) == t)
        pairs.append((listed & ~_is(F.exists(rule["allowed_values"], equal)), "value_not_allowed"))
    return _flags(*pairs)


def valid(text: Column, rule: Column) -> Column:
    return F.size(hard_errors(text, rule)) == 0


def warnings(text: Column, rule: Column) -> Column:
    """outside_expected_range, for simple numbers only."""
    value = F.when(~rule["value_format"].isin("text", "date"), number(text))
    return _flags((_is((value < bound(rule["expected_minimum"])) | (value > bound(rule["expected_maximum"]))), "outside_expected_range"))


def _recovers(rule: Column) -> Column:
    return _is((rule["value_format"] == "numeric") & (rule["decimal_places"] > 0))


def decimal_proposal(text: Column, rule: Column) -> Column:
    """Separator put before the last digits, if more digits than places and the result is valid; else null."""
    places, n = rule["decimal_places"], F.length(text)
    digits = F.length(F.regexp_replace(text, r"\A[+\-−]", ""))
    proposal = F.when(_recovers(rule) & full(text, WHOLE) & (digits > places), F.concat(F.substring(text, F.lit(1), n - places), F.lit("."), F.substring(text, n - places + 1, places)))
    return let(proposal, lambda p: F.when(p.isNotNull() & valid(p, rule), p))


def separator_reclassification(text: Column, rule: Column) -> Column:
    """A digit 1 exactly where the separator belongs, read as the separator; else null."""
    places = rule["decimal_places"]

    def proposal(t: Column) -> Column:
        at = F.length(t) - places  # one-based position of the digit
        before = at - 1 - F.when(t.rlike(r"\A[+-]"), 1).otherwise(0)
        put = F.concat(F.substring(t, F.lit(1), at - 1), F.lit("."), F.substring(t, at + 1, places))
        return F.when(_recovers(rule) & full(t, r"[+\-]?\d+") & (before > 0) & (F.substring(t, at, F.lit(1)) == "1"), put)

    return let(let(plain(strip(text)), proposal), lambda p: F.when(p.isNotNull() & valid(p, rule), p))


def constrain(text: Column, candidates: Column, confidences: Column, confidence: Column, flags: Column, rule: Column) -> Column:
    """Struct (text, confidence, flags, alternative): the reading kept within the rule's hard limits.

    The first valid candidate wins (the first inside the expected range where the rule
    prefers it); without one, a single proposal is taken; otherwise the text stays and
    ``rule_conflict`` is raised. Nulls: text as '', candidates and flags as empty lists.
    """
    none = F.array().cast("array<string>")
    numeric = rule["value_format"].isin(*NUMERIC_FORMATS)
    given = F.concat(F.array(F.coalesce(text, F.lit(""))), F.coalesce(candidates, none))
    spelled = F.transform(F.filter(given, lambda v: v.isNotNull()), lambda v: F.when(numeric, canonical_numeric(v)).otherwise(v))
    cands = F.filter(F.array_distinct(spelled), lambda v: v != "")

    def sorted_out(c: Column) -> Column:
        return F.struct(c.alias("cands"), F.filter(c, lambda v: valid(v, rule)).alias("fit"))

    def proposed(x: Column) -> Column:
        wanted = F.coalesce(rule["prefer_expected_range"], F.lit(False))
        stuck = F.size(x["fit"]) == 0
        moved = F.when(stuck, F.filter(F.transform(x["cands"], lambda v: separator_reclassification(v, rule)), lambda v: v.isNotNull())).otherwise(none)
        put = F.when(stuck, F.filter(F.transform(x["cands"], lambda v: decimal_proposal(v, rule)), lambda v: v.isNotNull())).otherwise(none)
        return F.struct(
            x["cands"].alias("cands"),
            x["fit"].alias("fit"),
            F.when(wanted, F.filter(x["fit"], lambda v: F.size(warnings(v, rule)) == 0)).otherwise(none).alias("expected"),
            moved.alias("moved"),
            put.alias("put"),
        )

    def chosen(x: Column) -> Column:
        proposals = F.array_distinct(F.concat(x["moved"], x["put"]))
        has_fit, has_cands = F.size(x["fit"]) > 0, F.size(x["cands"]) > 0
        pick = F.when(has_fit, F.coalesce(F.get(x["expected"], F.lit(0)), F.get(x["fit"], F.lit(0)))).when(has_cands & (F.size(proposals) == 1), F.get(proposals, F.lit(0))).otherwise(F.coalesce(text, F.lit("")))
        return F.struct(
            pick.alias("pick"),
            F.when(has_fit | ~has_cands, x["cands"]).otherwise(F.concat(x["cands"], proposals)).alias("shown"),
            has_fit.alias("has_fit"),
            has_cands.alias("has_cands"),
            F.size(x["expected"]).alias("n_expected"),
            F.size(x["moved"]).alias("n_moved"),
            F.size(proposals).alias("n_proposals"),
        )

    def result(x: Column) -> Column:
        pick, lost = x["pick"], ~x["has_fit"] & x["has_cands"]
        changed, one = pick != F.coalesce(text, F.lit("")), x["n_proposals"] == 1
        base = F.coalesce(flags, none)
        kept = F.when((pick != "") & changed, F.filter(base, lambda f: ~f.isin("invalid_numeric_format", "possible_missing_decimal", "empty_prediction"))).otherwise(base)
        added = _flags(
            (x["has_fit"] & changed & (x["n_expected"] > 0), "expected_range_selected_alternative"),
            (x["has_fit"] & changed & (x["n_expected"] == 0), "rule_selected_alternative"),
            (lost & one & (x["n_moved"] > 0), "separator_reclassified_from_one"),
            (lost & one & (x["n_moved"] == 0), "separator_inferred_from_rule"),
            (lost & ~one, "rule_conflict"),
            (lost & (x["n_proposals"] > 1), "ambiguous_rule_proposals"),
            (pick != "", "value_rule_review_required"),
        )
        return F.struct(
            pick.alias("text"),
            F.coalesce(F.try_element_at(confidences, pick), F.when(changed, F.lit(0.0)).otherwise(confidence)).alias("confidence"),
            F.array_sort(F.array_distinct(F.concat(kept, added, hard_errors(pick, rule), warnings(pick, rule)))).alias("flags"),
            F.array_join(F.filter(x["shown"], lambda v: v != pick), " | ").alias("alternative"),
        )

    return let(let(let(let(cands, sorted_out), proposed), chosen), result)


#: Flags that inform and do not call for review.
NON_BLOCKING = (
    "adaptive_full_pass", "adaptive_short_pass", "alternative_selected", "auto_excluded_crossed_row", "constrained_decoder_used",
    "crop_retry_contributed", "crossed_out_row", "decimal_boundary_inferred_from_glyphs", "decimal_separator_detected",
    "digit_verifier_agrees", "digit_verifier_disagreement", "high_accuracy_consensus", "isolated_digit_consensus",
    "multistage_cascade", "non_numeric_mark_row", "numeric_verification_required", "rule_selected_alternative",
    "separator_not_visually_confirmed", "split_consensus_used", "template_fixed_value", "value_rule_review_required",
    "visible_digit_count_used", "writer_style_agrees", "writer_style_conflict_rejected", "writer_style_profile_used",
)


def needs_review(flags: Column, status: Column | None = None) -> Column:
    """Some flag is not on the informing list (unknown flags count) while the status is automatic."""
    blocking = F.exists(F.coalesce(flags, F.array().cast("array<string>")), lambda f: ~f.isin(*NON_BLOCKING))
    return blocking if status is None else (status == "automatic") & blocking


def rule_errors(rule: Column) -> Column:
    """Names of the ways in which a rule contradicts itself."""
    fmt, places = rule["value_format"], rule["decimal_places"]
    low, high, elow, ehigh = (rule[c] for c in ("minimum", "maximum", "expected_minimum", "expected_maximum"))
    finite = lambda c: c.isNull() | (~F.isnan(c) & (F.abs(c) != float("inf")))
    flag = lambda c: F.coalesce(rule[c], F.lit(False))
    nothing_fits = (F.size(rule["allowed_values"]) > 0) & ~F.exists(rule["allowed_values"], lambda v: F.size(hard_errors(v, rule, check_allowed=False)) == 0)
    return _flags(
        (_is(~fmt.isin("complex_numeric", "numeric", "integer", "text", "date")) | fmt.isNull(), "unknown_format"),
        (~reduce(lambda a, b: a & b, map(finite, (low, high, elow, ehigh))), "bound_not_finite"),
        (_is(low > high) | _is(elow > ehigh), "bounds_reversed"),
        (_is((places < 0) | (places > 8)), "decimal_places_out_of_range"),
        (_is((fmt == "integer") & (places != 0)), "integer_with_decimal_places"),
        (_is(flag("require_decimal") & (fmt != "numeric")), "decimal_part_needs_numeric"),
        (_is(flag("require_decimal") & (places == 0)), "decimal_part_needs_places"),
        (_is(~fmt.isin("integer", "numeric") & (places.isNotNull() | flag("suggest_missing_decimal"))), "places_need_simple_number"),
        (_is(flag("suggest_missing_decimal") & (F.coalesce(places, F.lit(0)) == 0)), "suggestion_needs_places"),
        (flag("prefer_expected_range") & elow.isNull() & ehigh.isNull(), "preference_needs_expected_range"),
        (_is(fmt.isin("text", "date") & (low.isNotNull() | high.isNotNull() | elow.isNotNull() | ehigh.isNotNull())), "range_on_text"),
        (_is(nothing_fits), "no_allowed_value_fits"),
    )


def rule_summary(rule: Column) -> Column:
    """One line that tells a rule."""
    show = lambda c: c.cast("string")
    low, high, elow, ehigh = (rule[c] for c in ("minimum", "maximum", "expected_minimum", "expected_maximum"))
    either = lambda a, b: a.isNotNull() | b.isNotNull()
    flag = lambda c: F.coalesce(rule[c], F.lit(False))
    return F.concat_ws(
        "; ",
        rule["value_format"],
        F.when(rule["decimal_places"].isNotNull(), F.concat(F.lit("decimal places: "), show(rule["decimal_places"]))),
        F.when(either(low, high), F.concat(F.lit("from "), F.coalesce(show(low), F.lit("−∞")), F.lit(" to "), F.coalesce(show(high), F.lit("+∞")))),
        F.when(F.size(rule["allowed_values"]) > 0, F.concat(F.lit("one of: "), F.array_join(rule["allowed_values"], "; "))),
        F.when(either(elow, ehigh), F.concat(F.lit("usually "), F.coalesce(show(elow), F.lit("")), F.lit("…"), F.coalesce(show(ehigh), F.lit("")))),
        F.when(flag("require_decimal"), "decimal part required"),
        F.when(flag("prefer_expected_range"), "prefer the expected range"),
    )


def column_name(index: Column) -> Column:
    """Spreadsheet column letters of a zero-based index, up to three letters."""
    letter = lambda n: F.chr(F.pmod(n, F.lit(26)) + 65)
    two, three = F.floor(index / 26) - 1, F.floor((F.floor(index / 26) - 1) / 26) - 1
    return F.concat(F.when(two >= 26, letter(three)).otherwise(""), F.when(index >= 26, letter(two)).otherwise(""), letter(index))


def rect_address(r: Column) -> Column:
    start = F.concat(column_name(r["column_start"]), (r["row_start"] + 1).cast("string"))
    end = F.concat(column_name(r["column_end"]), (r["row_end"] + 1).cast("string"))
    return F.when(start == end, start).otherwise(F.concat(start, F.lit(":"), end))
