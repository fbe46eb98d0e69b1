"""Scans: Parquet tables of a data folder, wrapped JSON, delimited and line files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def wrapped_json(spark: SparkSession, path: str, rows: T.StructType, field: str = "results") -> DataFrame:
    """The rows of documents of the form {"count": .., field: [..]}, or of bare lists.

    The schema is given, so one pass reads the files; unparsable ones give no rows.
    """
    schema = T.StructType([T.StructField(field, T.ArrayType(rows)), T.StructField("_corrupt_record", T.StringType())])
    raw = spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").json(path)
    return raw.where(F.col("_corrupt_record").isNull()).select(F.explode(field).alias("r")).select("r.*")


def json_folder(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """One row a file of a folder of JSON documents, unparsable files skipped."""
    wide = T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])
    raw = spark.read.schema(wide).option("multiLine", True).option("mode", "PERMISSIVE").json(path)
    return raw.where(F.col("_corrupt_record").isNull()).drop("_corrupt_record")


def identifier_lines(spark: SparkSession, path: str) -> DataFrame:
    """(id) of each line that is neither blank nor a comment."""
    line = F.trim("value")
    return spark.read.text(path).select(line.alias("id")).where((F.col("id") != "") & ~F.col("id").startswith("#"))


def tab_separated(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.csv(path, schema=schema, sep="\t", header=True)


def data_lines_by_file(spark: SparkSession, path: str) -> DataFrame:
    """(file, n) with the number of data lines of each delimited file, the header not counted."""
    lines = spark.read.text(path).select(F.regexp_extract(F.input_file_name(), "([^/]+)$", 1).alias("file"))
    return lines.groupBy("file").agg((F.count("*") - 1).alias("n"))


def overrides(spark: SparkSession, path: str) -> DataFrame:
    """(dataset_id, replace, remove) of a map file, keys with a leading underscore being notes."""
    entry = "map<string, struct<replace: array<string>, remove: array<string>>>"
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", entry).alias("m"))
    return raw.select(F.explode("m").alias("dataset_id", "e")).where(~F.col("dataset_id").startswith("_")).select("dataset_id", "e.replace", "e.remove")


def listed_pages(pages: DataFrame, size: int, order: str) -> DataFrame:
    """Rows with the number of the page they are on, in pages of a fixed size.

    Positions come from counts by range, so no task sees more than its range.
    """
    from quillmark.operators.ordering import global_position

    return global_position(pages, [order], "position").withColumn("page", F.floor((F.col("position") - 1) / size).cast("long") + 1)
