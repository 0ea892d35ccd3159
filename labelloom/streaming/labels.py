"""An extension: label images and recognised text as streams, through the same stateless steps as batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelloom.functions.text import TextFilter, apply_all
from labelloom.operators.template import positional_fields
from labelloom.operators.vocabulary import Matcher, correct


def watch_images(spark: SparkSession, path: str, schema: str, most_files: int = 1000) -> DataFrame:
    """New parquet files of images below path."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", most_files).parquet(path)


def filter_stream(fields: DataFrame, *filters: TextFilter) -> DataFrame:
    return fields.withColumn("original_text", F.col("text")).withColumn("text", apply_all(F.col("text"), *filters))


def map_stream(detected: DataFrame, template_fields: DataFrame) -> DataFrame:
    return positional_fields(detected, template_fields)


def correct_each_batch(vocabulary: DataFrame, write: Callable[[DataFrame, int], None], matcher: Matcher = Matcher()) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: a micro-batch's texts are corrected as a batch, then written by write(rows, batch_id), which
    should replace what it wrote for the same batch_id before."""
    return lambda rows, batch_id: write(correct(rows, vocabulary, matcher), batch_id)
