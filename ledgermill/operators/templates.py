"""Templates: versions, matching a detected grid, fitting, titles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgermill.functions.grammar import let

EPS = 1e-9


def latest(templates: DataFrame) -> DataFrame:
    """The highest version of each family; ties go to the lowest id. A null family is the template's own."""
    family = F.coalesce(F.nullif(F.col("family_id"), F.lit("")), F.col("id"))
    w = Window.partitionBy(family).orderBy(F.desc_nulls_last("template_version"), "id")
    return templates.withColumn("place", F.row_number().over(w)).where("place = 1").drop("place")


def next_versions(templates: DataFrame) -> DataFrame:
    """(family_id, next_version)."""
    family = F.coalesce(F.nullif(F.col("family_id"), F.lit("")), F.col("id"))
    return templates.groupBy(family.alias("family_id")).agg((F.coalesce(F.max("template_version"), F.lit(0)) + 1).alias("next_version"))


def count_similarity(actual: Column, expected: Column) -> Column:
    return F.exp(-F.abs(actual - expected) / F.greatest(F.lit(1.0), expected * 0.18))


def rect_similarity(a: Column, b: Column) -> Column:
    apart = sum((F.abs(a[k] - b[k]) for k in ("y", "width", "height")), F.abs(a["x"] - b["x"]))
    return F.greatest(F.lit(0.0), 1.0 - apart / 0.8)


def normalised(guides: Column) -> Column:
    low, high = F.get(guides, F.lit(0)), F.try_element_at(guides, F.lit(-1))
    return F.transform(guides, lambda g: (g - low) / F.greatest(F.lit(EPS), high - low))


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def guide_similarity(a: Column, b: Column) -> Column:
    """1 minus four times the mean distance of the normalised guides; 0 for other counts."""
    apart = total(F.zip_with(normalised(a), normalised(b), lambda x, y: F.abs(x - y)))
    return F.when((F.size(a) != F.size(b)) | (F.size(a) < 2), 0.0).otherwise(F.greatest(F.lit(0.0), 1.0 - apart / F.size(a) * 4.0))


def differences(guides: Column) -> Column:
    return F.zip_with(F.slice(guides, F.lit(2), F.greatest(F.size(guides) - 1, F.lit(0))), F.slice(guides, F.lit(1), F.greatest(F.size(guides) - 1, F.lit(0))), lambda x, y: x - y)


def median_of(values: Column) -> Column:
    """Exact median of an array (mean of the middle two)."""
    s, n = F.array_sort(values), F.size(values)
    return F.when(n > 0, (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2)


def fit_problem(t: Column, d: Column) -> Column:
    """Why the template ``t`` does not fit the detected grid ``d``; null where it does.

    Both are structs with row_guides, column_guides; t also header_rows, d also n_warnings.
    """
    rows = F.size(d["row_guides"]) - 1
    increasing = lambda g: ~F.exists(differences(g), lambda x: x <= 0)
    worst = lambda a, b: F.array_max(F.zip_with(normalised(a), normalised(b), lambda x, y: F.abs(x - y)))
    body = lambda g: F.slice(differences(g), t["header_rows"] + 1, F.greatest(F.size(g), F.lit(1)))
    uneven = lambda g: F.array_max(F.transform(body(g), lambda h: F.abs(h / F.nullif(median_of(body(g)), F.lit(0.0)) - 1))) > 0.15
    head = lambda g: F.transform(F.slice(differences(g), F.lit(1), t["header_rows"]), lambda h: h / F.nullif(median_of(body(g)), F.lit(0.0)))
    other_head = F.coalesce(F.array_max(F.zip_with(head(t["row_guides"]), head(d["row_guides"]), lambda x, y: F.abs(x - y))), F.lit(0.0)) > 0.15
    same_rows = F.size(t["row_guides"]) == F.size(d["row_guides"])
    return (
        F.when(d["n_warnings"] > 0, "grid_needs_checking")
        .when(F.size(t["column_guides"]) != F.size(d["column_guides"]), "other_column_count")
        .when(~((t["header_rows"] < rows) & (rows <= 200)), "invalid_row_count")
        .when(~(increasing(t["column_guides"]) & increasing(d["column_guides"]) & increasing(t["row_guides"]) & increasing(d["row_guides"])), "invalid_coordinates")
        .when(worst(t["column_guides"], d["column_guides"]) > 0.025, "other_column_proportions")
        .when(same_rows & (worst(t["row_guides"], d["row_guides"]) > 0.035), "other_row_structure")
        .when(~same_rows & (uneven(t["row_guides"]) | uneven(d["row_guides"])), "uneven_rows")
        .when(~same_rows & (t["header_rows"] > 0) & other_head, "other_header_proportions")
    )


def match_score(t: Column, d: Column, title_hit: Column, any_title: Column) -> Column:
    """Weighted likeness of a template and a detected grid in [0, 1], four places."""
    problem = fit_problem(t, d)
    auto = F.coalesce(t["auto_fit_rows"], F.lit(False))
    fitted = auto & problem.isNull()
    rows, columns = F.size(t["row_guides"]) - 1, F.size(t["column_guides"]) - 1
    row = F.when(fitted, 1.0).otherwise(count_similarity(F.size(d["row_guides"]) - 1, rows))
    column = count_similarity(F.size(d["column_guides"]) - 1, columns)
    shape = F.when(fitted, 1.0).otherwise(guide_similarity(t["row_guides"], d["row_guides"]))
    own = t["reference_page_aspect"]
    aspect = F.when(own.isNull() | (own == 0), 0.5).otherwise(F.greatest(F.lit(0.0), 1.0 - F.abs(d["aspect"] - own) / F.greatest(d["aspect"], own)))
    score = 0.27 * row + 0.31 * column + 0.15 * rect_similarity(t["table_rect"], d["table_rect"]) + 0.10 * aspect + 0.17 * (shape + guide_similarity(t["column_guides"], d["column_guides"])) / 2
    score = F.when(any_title & ~title_hit, score * 0.70).otherwise(score)
    score = F.when(auto & problem.isNotNull(), score * 0.49).when(d["n_warnings"] > 0, F.least(score, F.lit(0.49))).otherwise(score)
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 4)


#: Templates that pages are matched with at once: forms that people draw, sent to executors whole (some 5 KB each).
MAX_TEMPLATES = 5_000


def against(pages: DataFrame, templates: DataFrame) -> DataFrame:
    """Every page with every template, since each page is ranked against all; more than ``MAX_TEMPLATES`` are refused."""
    if templates.limit(MAX_TEMPLATES + 1).count() > MAX_TEMPLATES:
        raise ValueError(f"more than {MAX_TEMPLATES} templates")
    return pages.crossJoin(F.broadcast(templates))


def reasons(t: Column, d: Column) -> Column:
    """What speaks for or against a template, as words."""
    rows, fitted = F.size(t["row_guides"]) == F.size(d["row_guides"]), F.coalesce(t["auto_fit_rows"], F.lit(False)) & fit_problem(t, d).isNull()
    own = t["reference_page_aspect"]
    aspect = F.when(own.isNull() | (own == 0), 0.5).otherwise(F.greatest(F.lit(0.0), 1.0 - F.abs(d["aspect"] - own) / F.greatest(d["aspect"], own)))
    return F.array_compact(F.array(
        F.format_string("grid %dx%d", F.size(t["row_guides"]) - 1, F.size(t["column_guides"]) - 1), F.when(rows, "rows match").when(fitted, "rows will be fitted").otherwise("rows differ"),
        F.when(F.size(t["column_guides"]) == F.size(d["column_guides"]), "columns match").otherwise("columns differ"), F.when(aspect > 0.9, "page aspect matches"), F.when(rect_similarity(t["table_rect"], d["table_rect"]) > 0.85, "table lies alike"),
    ))


def chosen(matches: DataFrame, override: DataFrame | None = None) -> DataFrame:
    """(page_id, template_id, ambiguous) from (page_id, template_id, name, score, fit_error): the best template of each page.

    Templates that cannot be fitted come last, then the score decides, then the name. A second
    one that fits as well and is less than 0.04 away makes the choice ambiguous. ``override``
    (template_id, one row) is the choice for all pages.
    """
    order = Window.partitionBy("page_id").orderBy(F.col("fit_error"), F.desc("score"), F.lower("name"), "template_id")
    df = matches.withColumn("place", F.row_number().over(order)).withColumn("next", F.lead(F.when(~F.col("fit_error"), F.col("score"))).over(order)).where("place = 1")
    out = df.select("page_id", "template_id", F.coalesce(F.abs(F.col("score") - F.col("next")) < 0.04, F.lit(False)).alias("ambiguous"))
    if override is None:
        return out
    common = override.select(F.col("template_id").alias("common"))
    return out.join(F.broadcast(common.limit(1)), F.lit(True), "left").select("page_id", F.coalesce("common", "template_id").alias("template_id"), (F.col("ambiguous") & F.col("common").isNull()).alias("ambiguous"))


def fitted_fields(t: Column, d: Column) -> Column:
    """Struct (problem, fields): a template's fields moved to a detected grid.

    Fields above and left of the table move with its corner, fields below with its lower edge,
    stretched as the columns are and, across the page, as the rows (or the page's aspect where
    the template knows one). A read field inside the table, or one that leaves the page, is a problem.
    """
    end = lambda g: F.try_element_at(g, F.lit(-1))
    first = lambda g: F.get(g, F.lit(0))
    ox, nx, oy, ny = t["column_guides"], d["column_guides"], t["row_guides"], d["row_guides"]
    sx = (end(nx) - first(nx)) / F.nullif(end(ox) - first(ox), F.lit(0.0))
    own = F.nullif(t["reference_page_aspect"], F.lit(0.0))
    sy = F.coalesce(sx * F.coalesce(d["aspect"], own) / own, median_of(differences(ny)) / F.nullif(median_of(differences(oy)), F.lit(0.0)))

    def moved(m: Column) -> Column:
        def one(f: Column) -> Column:
            r = f["rect"]
            below = r["y"] >= end(oy)
            y = F.when(below, end(ny) + (r["y"] - end(oy)) * m["sy"]).otherwise(first(ny) + (r["y"] - first(oy)) * m["sy"])
            x = first(nx) + (r["x"] - first(ox)) * m["sx"]
            w, h = r["width"] * m["sx"], r["height"] * m["sy"]
            inside = ~below & (f["source"] != "fixed") & (r["y"] + r["height"] > first(oy))
            out = (x < -0.002) | (y < -0.002) | (x + w > 1.002) | (y + h > 1.002)
            return F.struct(F.when(inside, "field_inside_table").when(out, "field_outside_page").alias("problem"), f["id"].alias("id"), F.greatest(F.lit(0.0), x).alias("x"), F.greatest(F.lit(0.0), y).alias("y"), w.alias("width"), h.alias("height"))

        return F.transform(t["fields"], one)

    bad = lambda fs: F.get(F.filter(F.transform(fs, lambda f: f["problem"]), lambda p: p.isNotNull()), F.lit(0))
    return let(let(F.struct(sx.alias("sx"), sy.alias("sy")), moved), lambda fs: F.struct(bad(fs).alias("problem"), fs.alias("fields")))


def new_template(pages: DataFrame) -> DataFrame:
    """Templates made from detected pages (page_id, d): a family of their own at version 0, even where nothing is known."""
    d = F.col("d")
    return pages.select(F.concat("page_id", F.lit("-new")).alias("id"), F.concat("page_id", F.lit("-new")).alias("family_id"), F.lit("").alias("name"), F.lit(0).alias("template_version"), d["row_guides"].alias("row_guides"), d["column_guides"].alias("column_guides"), d["aspect"].alias("reference_page_aspect"))


def title_tokens(text: Column) -> Column:
    """Lower-case words of a title, joined by blanks."""
    return F.array_join(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"(?U)(\w+)"), F.lit(1)), " ")


def title_matches(title: Column, name: Column) -> Column:
    """The protocol's name (four characters at least) stands in the title as whole words."""
    n = title_tokens(name)
    return (F.length(n) >= 4) & F.concat(F.lit(" "), title_tokens(title), F.lit(" ")).contains(F.concat(F.lit(" "), n, F.lit(" ")))


def even_guides(start: Column, size: Column, parts: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), parts), lambda i: start + size * i / parts)


def best_orientation(scores: DataFrame) -> DataFrame:
    """(file, rotation, score, uncertain) from (file, rotation, page, score, ok): worst page per rotation, best rotation.

    A lead of less than four points over the next valid rotation is uncertain.
    """
    per = scores.groupBy("file", "rotation").agg(F.min(F.round(F.col("score") * 100)).cast("int").alias("score"), F.min(F.col("ok").cast("int")).alias("ok"))
    w = Window.partitionBy("file").orderBy(F.desc("ok"), F.desc("score"), "rotation")
    df = per.withColumn("place", F.row_number().over(w)).withColumn("next", F.lead("score").over(w)).withColumn("next_ok", F.lead("ok").over(w)).where("place = 1")
    return df.select("file", "rotation", "score", ((F.col("ok") == 1) & (F.coalesce("next_ok", F.lit(0)) == 1) & (F.col("score") - F.col("next") < 4)).alias("uncertain"))
