"""Sources: template files, stored jobs, page images."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Extensions of documents that can be opened.
EXTENSIONS = ("pdf", "png", "jpg", "jpeg", "tif", "tiff", "bmp", "heic", "heif")
RECT = "struct<x:double,y:double,width:double,height:double>"
RULE = "value_format:string,minimum:double,maximum:double,decimal_places:int,allowed_values:array<string>,expected_minimum:double,expected_maximum:double,allow_empty:boolean,suggest_missing_decimal:boolean,prefer_expected_range:boolean,require_decimal:boolean"
TEMPLATE = f"""id string, name string, family_id string, template_version int, schema_version int, rotation_degrees int, table_rect {RECT},
row_guides array<double>, column_guides array<double>, header_rows int, row_label_columns int, detect_crossed_rows boolean, auto_fit_rows boolean,
reference_page_aspect double, reference_source_path string,
fields array<struct<id:string,name:string,rect:{RECT},kind:string,recognition:string,source:string,fixed_value:string,export_mode:string,required:boolean,column_start:int,column_end:int,color:string,printed_label:string>>,
column_rules array<struct<name:string,role:string,decimal_separator:string,preserve_complex_notation:boolean,{RULE}>>,
cell_rules array<struct<id:string,name:string,row_start:int,row_end:int,column_start:int,column_end:int,color:string,constraints:struct<{RULE}>>>,
fixed_cells array<struct<row:int,column:int,value:string>>, excluded_rows array<int>, excluded_columns array<int>, excluded_cells array<struct<row:int,column:int>>, page_transforms map<string,string>"""


def templates(spark: SparkSession, path: str) -> DataFrame:
    """Templates from JSON files of any version: malformed files are skipped, missing members get their defaults."""
    df = spark.read.schema(TEMPLATE + ", _corrupt_record string").option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
    df = df.where("_corrupt_record is null and id is not null and row_guides is not null and column_guides is not null").drop("_corrupt_record")
    defaults = {"template_version": 1, "schema_version": 1, "rotation_degrees": 0, "header_rows": 1, "row_label_columns": 1, "detect_crossed_rows": True, "auto_fit_rows": False, "reference_source_path": ""}
    for name, value in defaults.items():
        df = df.withColumn(name, F.coalesce(name, F.lit(value)))
    df = df.withColumn("family_id", F.coalesce(F.nullif("family_id", F.lit("")), F.col("id")))
    df = df.withColumn("page_transforms", F.transform_keys("page_transforms", lambda k, _: k.try_cast("int")))  # JSON keys are text
    for name in ("fields", "column_rules", "cell_rules", "fixed_cells", "excluded_rows", "excluded_columns", "excluded_cells"):
        df = df.withColumn(name, F.coalesce(name, F.array().cast(df.schema[name].dataType)))
    return df


def openable(paths: DataFrame, column: str = "path") -> DataFrame:
    """Rows whose path has an extension that can be opened."""
    return paths.where(F.lower(F.regexp_extract(F.col(column), r"\.([^.]+)\z", 1)).isin(*EXTENSIONS))


def pages(spark: SparkSession, path: str) -> DataFrame:
    """Raster pages with size and content digest; the image bytes are read only if selected."""
    df = spark.read.format("image").option("dropInvalid", True).load(path)
    i = F.col("image")
    return df.select(i["origin"].alias("path"), i["height"].alias("height"), i["width"].alias("width"), i["nChannels"].alias("channels"), F.sha2(i["data"], 256).alias("digest"), i["data"].alias("data"))


def files(spark: SparkSession, path: str) -> DataFrame:
    """Any files with size, time and content digest: what tells whether a source changed."""
    df = spark.read.format("binaryFile").load(path)
    kind = (
        F.when(F.substring("content", 1, 8) == F.unhex(F.lit("89504E470D0A1A0A")), "png")
        .when(F.substring("content", 1, 3) == F.unhex(F.lit("FFD8FF")), "jpeg")
        .when(F.substring("content", 1, 4).isin(F.unhex(F.lit("49492A00")), F.unhex(F.lit("4D4D002A"))), "tiff")
        .when(F.substring("content", 1, 5) == F.encode(F.lit("%PDF-"), "utf-8"), "pdf")
        .when(F.substring("content", 5, 4) == F.encode(F.lit("ftyp"), "utf-8"), "heif")
        .otherwise("unknown")
    )
    return df.select("path", "length", "modificationTime", F.sha2("content", 256).alias("digest"), kind.alias("kind"))


#: The extensions that a file of each kind may have.
NAMES = {"png": ("png",), "jpeg": ("jpg", "jpeg"), "tiff": ("tif", "tiff"), "pdf": ("pdf",), "heif": ("heic", "heif")}


def misnamed(found: DataFrame) -> DataFrame:
    """Files whose bytes are of another kind than their name says, or of none that can be opened."""
    extension = F.lower(F.regexp_extract("path", r"\.([^.]+)\z", 1))
    fits = F.lit(False)
    for kind, names in NAMES.items():
        fits = fits | ((F.col("kind") == kind) & extension.isin(*names))
    return found.where(~fits)


def changed(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, change) of files between two scans: changed by size or digest, gone, or new."""
    old, new = before.select("path", F.col("length").alias("n0"), F.col("digest").alias("d0")), after.select("path", F.col("length").alias("n1"), F.col("digest").alias("d1"))
    change = F.when(F.col("d0").isNull(), "new").when(F.col("d1").isNull(), "gone").when((F.col("n0") != F.col("n1")) | (F.col("d0") != F.col("d1")), "changed")
    return old.join(new, "path", "full").select("path", change.alias("change")).where("change is not null")
