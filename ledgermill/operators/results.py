"""Saved results as typed tables: the cells, fields and pages of jobs, in the shape that checks and export read.

A page of a job is one document page; its key is the page's node key, since a job may hold
two pages of one index. The template is the stored one that the job names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgermill.functions import grammar as G
from ledgermill.operators import cells as C
from ledgermill.operators.nested import FlatTables
from ledgermill.session import stage


def listed(text: Column) -> Column:
    """The texts of a member that is written as a JSON list or as texts between commas; null gives an empty list."""
    parts = F.when(text.startswith("["), F.from_json(text, "array<string>")).otherwise(F.split(text, ","))
    return F.filter(F.transform(F.coalesce(parts, F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != ""))


def numbers(text: Column) -> Column:
    return F.filter(F.transform(listed(text), lambda x: x.try_cast("int")), lambda x: x.isNotNull())


def alternatives(text: Column) -> Column:
    """Alternative readings joined by bars, whatever their spelling."""
    return F.coalesce(F.when(text.startswith("["), F.array_join(F.from_json(text, "array<string>"), " | ")).otherwise(text), F.lit(""))


class Results:
    """The newest valid result of every job; each table is written once and read by the checks."""

    def __init__(self, jobs: DataFrame, templates: DataFrame):
        self.flat, self.templates = FlatTables(jobs), templates
        job = self.flat.table("job")
        self.jobs = job.select("job_id", "template_id", F.col("template_version").try_cast("int").alias("template_version"), "model_version", F.substring_index("source_path", "/", -1).alias("source_name"))
        page = self.flat.table("page").join(self.jobs.select("job_id", "template_id"), "job_id")
        #: run_id (the page's key), job_id, template_id, page_index, excluded_rows, excluded_columns.
        self.pages = page.select(F.col("node_key").alias("run_id"), "job_id", "template_id", "page_index", numbers(F.col("excluded_rows")).alias("excluded_rows"), numbers(F.col("excluded_columns")).alias("excluded_columns"))
        #: run_id, job_id, page_index, seq, region_id, name, raw_text, text, confidence, status.
        self.fields = self.flat.table("field").select(
            F.col("parent_key").alias("run_id"), "job_id", "page_index", F.col("ordinal").alias("seq"), F.col("item").alias("region_id"), F.coalesce("name", F.lit("")).alias("name"), F.coalesce("raw_text", F.lit("")).alias("raw_text"),
            F.coalesce("final_text", F.lit("")).alias("text"), F.col("confidence").try_cast("double").alias("confidence"), F.coalesce("status", F.lit("automatic")).alias("status"),
        )
        self._cells = None

    def cells(self) -> DataFrame:
        """Cells as ``cells.readings`` gives them, with the saved text, flags and status."""
        if self._cells is None:
            cell = self.flat.table("cell").where("cell_row >= 0 and cell_column >= 0").select(
                F.col("node_key").alias("cell_id"), F.col("parent_key").alias("run_id"), "job_id", "page_index", "cell_row", "cell_column", F.coalesce("raw_text", F.lit("")).alias("raw_text"), F.coalesce("applied_rule", F.lit("")).alias("applied_rule"),
                F.struct(F.coalesce("final_text", F.lit("")).alias("text"), F.col("confidence").try_cast("double").alias("confidence"), F.array_sort(F.array_distinct(listed(F.col("flags")))).alias("flags"), alternatives(F.col("alternatives")).alias("alternative")).alias("c"),
                F.coalesce("status", F.lit("automatic")).alias("status"),
            )
            df = cell.join(self.pages.drop("job_id", "page_index"), "run_id")
            df = C.resolve(C.with_template(df, self.templates))
            out = (F.array_contains("excluded_rows", F.col("cell_row")) & (F.col("cell_column") >= F.col("t.row_label_columns"))) | (F.array_contains("excluded_columns", F.col("cell_column")) & (F.col("cell_row") >= F.col("t.header_rows")))
            of_template = [F.col(f"t.{c}").alias(a) for c, a in (("name", "template_name"), ("template_version", "template_version"), ("header_rows", "header_rows"), ("row_label_columns", "row_label_columns"))]
            kept = ["cell_id", "run_id", "job_id", "template_id", "page_index", "cell_row", "cell_column", "raw_text", "applied_rule", "own", "rule", "rule_name", "fixed", (F.col("excluded") | out).alias("excluded"), "is_header", "is_label", "kind", "c", "status"]
            self._cells = stage(df.select(*kept, *of_template), "result-cells")
        return self._cells

    def export_pages(self) -> DataFrame:
        """Pages with their exclusions and the texts of their fields (the first result of a region counts)."""
        first = self.fields.groupBy("run_id", "region_id").agg(F.min_by("text", "seq").alias("text"))
        texts = first.groupBy("run_id").agg(F.map_from_entries(F.collect_list(F.struct("region_id", "text"))).alias("results"))
        return self.pages.join(texts, "run_id", "left").select("run_id", "template_id", "page_index", "excluded_rows", F.coalesce("results", F.create_map().cast("map<string,string>")).alias("results"))

    def field_audit(self) -> DataFrame:
        """Every field region of the template with its result, or empty where the page has none: text, errors, status."""
        t = self.templates.select(F.col("id").alias("template_id"), F.explode("fields").alias("f"))
        own = self.fields.groupBy("run_id", "region_id").agg(F.min(F.struct("seq", "text", "status")).alias("r"))
        df = self.pages.join(t, "template_id").withColumn("region_id", F.col("f.id")).join(own, ["run_id", "region_id"], "left")
        f = F.col("f")
        rule = F.struct(f["kind"].alias("value_format"), *(F.lit(None).cast("double").alias(c) for c in ("minimum", "maximum")), F.lit(None).cast("int").alias("decimal_places"), F.lit(None).cast("array<string>").alias("allowed_values"), (~f["required"]).alias("allow_empty"), F.lit(False).alias("require_decimal"))
        text = F.coalesce("r.text", F.lit(""))
        errors = F.transform(G.hard_errors(text, rule), lambda e: F.when(e == "required_cell_empty", "required_field_empty").otherwise(e))
        return df.select("run_id", "job_id", "template_id", "page_index", "region_id", f["name"].alias("name"), text.alias("text"), F.coalesce("r.status", F.lit("")).alias("status"), errors.alias("errors"))

    def audit(self, flagged: DataFrame) -> DataFrame:
        """The audit rows of cells and fields: one bag of sixteen columns (the time of export is the sink's)."""
        from ledgermill.operators.export import separator_evidence

        none = F.array().cast("array<string>")
        job = self.jobs.select("job_id", "source_name", "model_version", F.col("template_version").alias("version"))
        address = F.concat(F.lit("R"), (F.col("cell_row") + 1).cast("string"), F.lit("C"), (F.col("cell_column") + 1).cast("string"))
        of_cells = flagged.select("job_id", "run_id", "page_index", F.lit("cell").alias("kind"), address.alias("address"), "raw_text", F.col("c.text").alias("text"), F.col("c.confidence").alias("confidence"), F.col("flags_now").alias("flags"), "status", "template_name", "applied_rule", F.col("c.alternative").alias("alternatives"))
        names = self.templates.select(F.col("id").alias("template_id"), F.col("name").alias("template_name"))
        fields = self.fields.join(self.jobs.select("job_id", "template_id"), "job_id").join(names, "template_id")
        of_fields = fields.select("job_id", "run_id", "page_index", F.lit("field").alias("kind"), F.col("name").alias("address"), "raw_text", "text", "confidence", none.alias("flags"), "status", "template_name", F.lit("").alias("applied_rule"), F.lit("").alias("alternatives"))
        df = of_fields.unionByName(of_cells).join(job, "job_id")
        return df.select(
            "run_id", "source_name", (F.col("page_index") + 1).alias("page"), "kind", "address", F.col("raw_text").alias("raw_value"), F.col("text").alias("final_value"), F.round("confidence", 4).alias("confidence"), F.array_join("flags", ", ").alias("flags"), "status",
            F.col("template_name").alias("template"), F.col("version").alias("template_version"), "model_version", separator_evidence(F.col("raw_text"), F.col("text"), F.col("flags")).alias("separator_evidence"), "applied_rule", "alternatives",
        )

    def gate(self, flagged: DataFrame) -> DataFrame:
        """Per job what stands against its export, and the status it is saved with: ready without open values, else review."""
        broken_rules = self.templates.select(F.col("id").alias("template_id"), F.size(F.filter(F.concat(F.transform("column_rules", rule_problems), F.transform("cell_rules", lambda r: rule_problems(r["constraints"]))), lambda n: n > 0)).alias("n_invalid_rules"))
        unresolved, settled = G.needs_review(F.col("flags_now"), F.col("status")), F.col("status").isin("excluded", "confirmed", "corrected")
        of_cells = flagged.groupBy("job_id").agg(F.count_if(unresolved).alias("n_unresolved"), F.count_if((F.col("kind") == "rule") & ~settled & ~F.col("excluded") & ~G.valid(F.col("c.text"), F.col("rule"))).alias("n_broken_cells"))
        of_fields = self.field_audit().groupBy("job_id").agg(F.count_if((F.size("errors") > 0) & ~F.col("status").isin("confirmed", "corrected")).alias("n_broken_fields"))
        pages = self.pages.groupBy("job_id").agg(F.count("*").alias("n_pages"))
        df = self.jobs.select("job_id", "template_id").join(broken_rules, "template_id", "left").join(pages, "job_id", "left").join(of_cells, "job_id", "left").join(of_fields, "job_id", "left")
        counts = ["n_pages", "n_invalid_rules", "n_unresolved", "n_broken_cells", "n_broken_fields"]
        df = df.na.fill(0, counts)
        reasons = F.concat_ws(",", *(F.when(c, F.lit(n)) for c, n in ((F.col("n_pages") == 0, "no_pages"), (F.col("n_invalid_rules") > 0, "invalid_rules"), (F.col("n_unresolved") > 0, "needs_review"), (F.col("n_broken_fields") > 0, "field_breaks_rule"), (F.col("n_broken_cells") > 0, "cell_breaks_rule"))))
        return df.select("job_id", *counts, reasons.alias("blocked_by"), F.when(F.col("n_unresolved") == 0, "ready").otherwise("review").alias("status"))


def rule_problems(rule: Column) -> Column:
    return F.size(G.rule_errors(rule))
