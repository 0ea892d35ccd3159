"""Template files: JSON documents, read by Spark (S12) and written through it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelloom.operators.template import Template, from_json, to_json

#: S12 as a schema, for many templates at once; the defaults are those of missing keys.
SCHEMA = (
    "name string, description string, fieldMappings array<struct<fieldIndex int, metadataKey string, exampleText string, enabled boolean, normalizedX double, normalizedY double, normalizedWidth double, normalizedHeight double, hasBoundingBox boolean, regionType string>>, "
    "labelExtraction struct<sourceImageName string, cropX int, cropY int, cropWidth int, cropHeight int, rotation int, flipHorizontal boolean, flipVertical boolean>, createdTimestamp bigint, useFixedPositions boolean, dilationFactor double"
)


def read_template(spark: SparkSession, path: str, infer_boxes: bool = False) -> Template:
    return from_json(spark.read.text(path, wholetext=True).first()[0], infer_boxes)


def read_template_fields(spark: SparkSession, path: str) -> DataFrame:
    """A row for each field of each template below path: template, dilation, and the columns of a template's fields."""
    parsed = spark.read.text(path, wholetext=True).select(F.from_json("value", SCHEMA).alias("t"))
    m = F.col("m")
    return parsed.select(F.col("t.name").alias("template"), F.coalesce("t.dilationFactor", F.lit(1.2)).alias("dilation"), F.explode("t.fieldMappings").alias("m")).select(
        "template", "dilation",
        F.coalesce(m["fieldIndex"], F.lit(0)).alias("field_index"), m["metadataKey"].alias("metadata_key"), m["exampleText"].alias("example_text"), F.coalesce(m["enabled"], F.lit(True)).alias("enabled"),
        *(F.coalesce(m[j], F.lit(0.0)).alias(c) for c, j in (("nx", "normalizedX"), ("ny", "normalizedY"), ("nw", "normalizedWidth"), ("nh", "normalizedHeight"))),
        F.coalesce(m["hasBoundingBox"], F.lit(False)).alias("has_bounding_box"), F.coalesce(m["regionType"], F.lit("TEXT")).alias("region_type"),
    )


def write_template(spark: SparkSession, template: Template, path: str) -> None:
    """A folder with one text file: what read_template() reads."""
    spark.createDataFrame([(to_json(template),)], "value string").coalesce(1).write.mode("overwrite").text(path)
