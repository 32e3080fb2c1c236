"""Export of reviewed cells: gate, long rows, layout matrix, audit rows, workbook."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Iterable
from xml.sax.saxutils import escape

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgermill.functions import grammar as G

#: What tells one page of one document from all others.
PAGE = ["run_id", "template_id", "page_index"]


def violations(flagged: DataFrame) -> DataFrame:
    """What blocks the export, one row per cell: unresolved ones, and unreviewed ones that break a hard limit."""
    unresolved = G.needs_review(F.col("flags_now"), F.col("status"))
    broken = (F.col("kind") == "rule") & ~F.col("status").isin("excluded", "confirmed", "corrected") & ~G.valid(F.col("c.text"), F.col("rule"))
    why = F.when(unresolved, "needs_review").when(broken, "breaks_rule")
    return flagged.select("cell_id", *PAGE, F.concat(F.lit("R"), (F.col("cell_row") + 1).cast("string"), F.lit("C"), (F.col("cell_column") + 1).cast("string")).alias("address"), why.alias("reason")).where("reason is not null")


def first_per_place(cells: DataFrame) -> DataFrame:
    """One cell per place of a page: the one of least id."""
    place = Window.partitionBy(*PAGE, "cell_row", "cell_column").orderBy("cell_id")
    return cells.withColumn("seq", F.row_number().over(place)).where("seq = 1").drop("seq")


def typed_value(text: Column, numeric: Column) -> Column:
    """The number of a simple number in a numeric cell, as a double; null otherwise."""
    return F.when(numeric & G.is_simple(text), G.plain(G.strip(text)).try_cast("double"))


def number_format(text: Column, numeric: Column, status: Column, rule: Column) -> Column:
    """0.0… with the rule's places, or with the places written where a person reviewed the value."""
    written = F.length(F.regexp_extract(G.plain(G.strip(text)), r"\.(\d+)\z", 1))
    places = F.coalesce(F.when(~status.isin("confirmed", "corrected"), rule["decimal_places"]), written)
    shown = F.when(places > 0, F.concat(F.lit("0."), F.repeat(F.lit("0"), places))).otherwise("0")
    return F.when(numeric & G.is_simple(text), shown).otherwise("General")


def separator_evidence(raw: Column, final: Column, flags: Column) -> Column:
    raw, final = F.coalesce(raw, F.lit("")), F.coalesce(final, F.lit(""))
    return (
        F.when(raw.contains(","), "comma → canonical dot")
        .when(raw.contains("."), "dot")
        .when(F.array_contains(flags, "separator_reclassified_from_one"), "OCR 1 → proposed dot from template")
        .when(F.array_contains(flags, "separator_inferred_from_rule"), "missing → proposed dot from template")
        .when(final.contains("."), "dot not present in primary OCR")
        .otherwise("")
    )


def row_labels(cells: DataFrame) -> DataFrame:
    """(page, row, label): texts of the label columns in column order, joined by blanks."""
    own = cells.where((F.col("cell_column") < F.col("row_label_columns")) & (F.col("c.text") != ""))
    return own.groupBy(*PAGE, "cell_row").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("cell_column", F.col("c.text").alias("t")))), lambda x: x["t"]), " ").alias("label"))


def ordinals(grid: DataFrame) -> DataFrame:
    """(template_id, cell_row, ordinal) of rows with data columns: the row's number without earlier rows that are all header.

    A row looks only at its own data columns. One row per template is made (grids are at most 200 x 100).
    """
    data = grid.where((F.col("cell_column") >= F.col("t.row_label_columns")) & (F.col("own.role") == "data") & ~F.col("is_header"))
    rows = data.groupBy("template_id", "cell_row").agg(F.collect_set("cell_column").alias("columns"))
    sizes = grid.groupBy("template_id").agg(F.max("t.rows").alias("n_rows"))
    per = sizes.join(rows.groupBy("template_id").agg(F.map_from_entries(F.collect_list(F.struct("cell_row", "columns"))).alias("held")), "template_id")
    none = F.array().cast("array<int>")
    own = F.col("own")
    heads = F.size(F.filter(F.sequence(F.lit(0), F.col("cell_row")), lambda r: (r < F.col("cell_row")) & ~F.coalesce(F.arrays_overlap(F.coalesce(F.try_element_at("held", r), none), own), F.lit(False))))
    return per.select("template_id", "held", F.explode("held").alias("cell_row", "own")).select("template_id", "cell_row", (F.col("cell_row") + 1 - heads).alias("ordinal"))


def headers(cells: DataFrame) -> DataFrame:
    """(page, column, header): header texts from top to bottom, joined by slashes."""
    own = cells.where(F.col("is_header") & (F.col("cell_row") < F.col("header_rows")) & (F.col("c.text") != ""))
    return own.groupBy(*PAGE, "cell_column").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("cell_row", F.col("c.text").alias("t")))), lambda x: x["t"]), " / ").alias("header"))


def field_texts(results: Column, fields: Column) -> tuple[Column, Column]:
    """(repeated, groups): the repeated fields' texts as ``name=text; …``, and (start, end, text) of the column groups.

    ``results`` maps a field's id to its text. Of fields of one name the first counts; a field
    without a result has an empty text.
    """
    text = lambda f: F.coalesce(F.try_element_at(results, f["id"]), F.lit(""))
    repeat = F.filter(fields, lambda f: f["export_mode"] == "repeat")
    names = F.transform(repeat, lambda f: f["name"])
    once = F.filter(F.transform(repeat, lambda f, i: F.when(F.array_position(names, f["name"]) == i + 1, F.concat(f["name"], F.lit("="), text(f)))), lambda x: x.isNotNull())
    groups = F.transform(F.filter(fields, lambda f: (f["export_mode"] == "column_group") & f["column_start"].isNotNull() & f["column_end"].isNotNull()), lambda f: F.struct(f["column_start"].alias("start"), f["column_end"].alias("end"), text(f).alias("text")))
    return F.array_join(once, "; "), groups


def page_frame(pages: DataFrame, templates: DataFrame) -> DataFrame:
    """Pages (``PAGE``, excluded_rows, results) with their template's exclusions and the texts of their fields.

    Pages without results (null) have the template's fixed fields only.
    """
    t = templates.select(F.col("id").alias("template_id"), "fields", F.col("excluded_rows").alias("template_rows"))
    fixed = F.map_from_entries(F.transform(F.filter("fields", lambda f: f["source"] == "fixed"), lambda f: F.struct(f["id"], F.coalesce(f["fixed_value"], F.lit("")))))
    df = pages.join(t, "template_id").withColumn("results", F.coalesce("results", fixed))
    repeated, groups = field_texts(F.col("results"), F.col("fields"))
    none = F.array().cast("array<int>")
    rows = F.array_distinct(F.concat(F.coalesce("excluded_rows", none), F.coalesce("template_rows", none)))
    return df.select(*PAGE, rows.alias("out_rows"), repeated.alias("repeated"), groups.alias("groups"))


def long_rows(cells: DataFrame, grid: DataFrame, pages: DataFrame) -> DataFrame:
    """The normalised export: one row per value, with page, fields, source row, measurement, value, status, confidence.

    ``pages`` comes from ``page_frame``. Empty cells and excluded columns or cells give no row;
    an excluded row that has data columns gives one, without a value. The measurement is the
    column rule's name, unless that is generic; then the header texts, then the column number.
    """
    cells = first_per_place(cells)
    data = cells.where((F.col("cell_column") >= F.col("row_label_columns")) & (F.col("own.role") == "data") & ~F.col("is_header") & (F.col("c.text") != "") & (F.col("status") != "excluded") & ~F.col("excluded"))
    labels, numbers = row_labels(cells), ordinals(grid)
    df = data.join(pages, PAGE).where(~F.coalesce(F.array_contains("out_rows", F.col("cell_row")), F.lit(False)))
    df = df.join(labels, [*PAGE, "cell_row"], "left").join(numbers, ["template_id", "cell_row"], "left").join(headers(cells), [*PAGE, "cell_column"], "left")
    numeric = (F.col("kind") == "rule") & F.col("rule.value_format").isin(*G.NUMERIC_FORMATS) & ~F.col("is_label")
    label = F.coalesce("label", F.coalesce("ordinal", F.col("cell_row") + 1).cast("string")).alias("source_row")
    measurement = F.when(~F.col("own.name").startswith("Column "), F.col("own.name")).otherwise(F.coalesce("header", (F.col("cell_column") + 1).cast("string")))
    text = F.col("c.text")
    side = F.coalesce(F.get(F.filter("groups", lambda g: (g["start"] <= F.col("cell_column")) & (F.col("cell_column") <= g["end"])), F.lit(0))["text"], F.lit(""))
    page = (F.col("page_index") + 1).alias("page")
    values = df.select(
        "cell_id", "run_id", "template_id", page, "repeated", side.alias("side"), label, measurement.alias("measurement"), text.alias("value"), typed_value(text, numeric).alias("number"),
        number_format(text, numeric, F.col("status"), F.col("rule")).alias("number_format"), F.col("status").alias("review_status"), F.round("c.confidence", 4).alias("confidence"),
    )
    out = pages.withColumn("cell_row", F.explode("out_rows")).join(numbers, ["template_id", "cell_row"]).join(labels, [*PAGE, "cell_row"], "left")
    none = lambda kind: F.lit(None).cast(kind)
    rows = out.select(
        none(cells.schema["cell_id"].dataType).alias("cell_id"), "run_id", "template_id", page, "repeated", F.lit("").alias("side"), label, F.lit("").alias("measurement"), none("string").alias("value"), none("double").alias("number"),
        F.lit("General").alias("number_format"), F.lit("excluded").alias("review_status"), F.lit(1.0).alias("confidence"),
    )
    return values.unionByName(rows)


def layout(cells: DataFrame, templates: DataFrame) -> DataFrame:
    """The page's matrix: a row per page and grid row with the texts of all its columns; missing and excluded cells blank.

    A page's cells are one map (at most 200 x 100 places), so the whole grid is laid out without a join per cell.
    """
    shown = first_per_place(cells).where(~F.col("excluded") & (F.col("status") != "excluded"))
    held = shown.groupBy(*PAGE).agg(F.map_from_entries(F.collect_list(F.struct(F.struct("cell_row", "cell_column").alias("at"), F.col("c.text").alias("v")))).alias("held"))
    t = templates.where("size(row_guides) > 1 and size(column_guides) > 1").select(F.col("id").alias("template_id"), (F.size("row_guides") - 1).alias("rows"), (F.size("column_guides") - 1).alias("columns"))
    df = cells.select(*PAGE).distinct().join(held, PAGE, "left").join(t, "template_id").withColumn("cell_row", F.explode(F.sequence(F.lit(0), F.col("rows") - 1)))
    at = lambda c: F.struct(F.col("cell_row").alias("cell_row"), c.alias("cell_column"))
    return df.select(*PAGE, "cell_row", F.transform(F.sequence(F.lit(0), F.col("columns") - 1), lambda c: F.coalesce(F.try_element_at("held", at(c)), F.lit(""))).alias("texts"))


def audit(flagged: DataFrame) -> DataFrame:
    address = F.concat(F.lit("R"), (F.col("cell_row") + 1).cast("string"), F.lit("C"), (F.col("cell_column") + 1).cast("string"))
    return flagged.select(
        "cell_id", (F.col("page_index") + 1).alias("page"), F.lit("cell").alias("kind"), address.alias("address"), F.coalesce("raw_text", F.lit("")).alias("raw_value"), F.col("c.text").alias("final_value"),
        F.round("c.confidence", 4).alias("confidence"), F.array_join("flags_now", ", ").alias("flags"), "status", F.col("template_name").alias("template"), "template_version",
        separator_evidence(F.col("raw_text"), F.col("c.text"), F.col("flags_now")).alias("separator_evidence"), F.when(F.col("kind") == "rule", F.col("rule_name")).otherwise("").alias("applied_rule"), F.col("c.alternative").alias("alternatives"),
    )


def export_names(jobs: DataFrame) -> DataFrame:
    """(id, file_name): a free name for every job.

    The first job of a stem takes the stem itself; the k-th further one takes the k-th number
    from 2 on whose name is not another job's stem, so no name is given twice. Jobs of a stem
    follow each other by digest of their id. Ranks are in two levels (256 ranges of digests),
    so a stem that most jobs have is not one task.
    """
    df = jobs.select("id", F.regexp_replace("source_name", r"\.[^.]*\z", "").alias("stem")).withColumn("key", F.md5("id")).withColumn("part", F.substring("key", 1, 2))
    parts = df.groupBy("stem", "part").agg(F.count("*").alias("n"))
    before = parts.select("stem", "part", (F.sum("n").over(Window.partitionBy("stem").orderBy("part")) - F.col("n")).alias("before"))  # 256 rows a stem
    rank = F.row_number().over(Window.partitionBy("stem", "part").orderBy("key", "id"))
    ranked = df.withColumn("rank", rank).join(before, ["stem", "part"]).select("id", "stem", (F.col("before") + F.col("rank") - 1).alias("k"))
    number = F.regexp_extract("stem", r"-([1-9]\d{0,8})\z", 1)
    taken = parts.select("stem").distinct().withColumn("n", F.nullif(number, F.lit("")).cast("long")).where("n >= 2")
    taken = taken.groupBy(F.regexp_replace("stem", r"-\d+\z", "").alias("stem")).agg(F.array_sort(F.collect_list("n")).alias("taken"))  # distinct stems that end so
    skipped = F.size(F.filter(F.transform("taken", lambda n, i: n - (i + 1)), lambda free: free <= F.col("k")))
    n = F.col("k") + 1 + F.when(F.col("taken").isNull(), 0).otherwise(skipped)
    return ranked.join(taken, "stem", "left").select("id", F.concat("stem", F.when(F.col("k") > 0, F.concat(F.lit("-"), n.cast("string"))).otherwise(""), F.lit(".xlsx")).alias("file_name"))


def write_workbook(path: str, sheets: dict[str, tuple[list[str], Iterable[tuple]]]) -> None:
    """A spreadsheet file from bounded sheets, put in place only when it is whole.

    It is written beside its target, read back, forced to disk and renamed, so a failure leaves
    an earlier file as it was. Every text is stored as text, never as a formula.
    """
    target = os.path.abspath(path)
    handle, pending = tempfile.mkstemp(prefix="." + os.path.basename(target) + "-", dir=os.path.dirname(target))
    try:
        os.close(handle)
        _write_sheets(pending, sheets)
        with zipfile.ZipFile(pending) as z:
            if broken := z.testzip():
                raise OSError(f"broken part {broken}")
        with open(pending, "r+b") as f:
            os.fsync(f.fileno())
        os.replace(pending, target)
    finally:
        if os.path.exists(pending):
            os.unlink(pending)


def _write_sheets(path: str, sheets: dict[str, tuple[list[str], Iterable[tuple]]]) -> None:
    names = list(sheets)

    def cell(value) -> str:
        if value is None:
            return "<c/>"
        if isinstance(value, (int, float)) and not isinstance(value, bool):
            return f"<c><v>{value!r}</v></c>"
        return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(str(value))}</t></is></c>'

    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    pack = "http://schemas.openxmlformats.org/package/2006"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        parts = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in range(1, len(names) + 1))
        z.writestr("[Content_Types].xml", f'<Types xmlns="{pack}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{parts}</Types>')
        z.writestr("_rels/.rels", f'<Relationships xmlns="{pack}/relationships"><Relationship Id="r1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets>' + "".join(f'<sheet name="{escape(n)}" sheetId="{i}" r:id="r{i}"/>' for i, n in enumerate(names, 1)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{pack}/relationships">' + "".join(f'<Relationship Id="r{i}" Type="{rel}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(names) + 1)) + "</Relationships>")
        for i, n in enumerate(names, 1):
            header, rows = sheets[n]
            with z.open(f"xl/worksheets/sheet{i}.xml", "w") as f:
                f.write(f'<worksheet xmlns="{main}"><sheetData>'.encode())
                for row in (header, *rows):
                    f.write(("<row>" + "".join(map(cell, row)) + "</row>").encode())
                f.write(b"</sheetData></worksheet>")
