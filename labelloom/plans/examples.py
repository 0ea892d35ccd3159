"""Worked examples, as functions; source() gives their text."""

from __future__ import annotations

import inspect
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelloom.operators import fields as R
from labelloom.operators import metadata as M
from labelloom.operators.decode import Decoder
from labelloom.operators.template import map_by_index, positional_fields
from labelloom.plans.config import OcrBuilder


def basic(images: DataFrame, make: Callable[[], Decoder]) -> DataFrame:
    """Read whole labels with the usual settings."""
    return images.transform(OcrBuilder().sparse_text().enhance().min_confidence(0.5).reader(make))


def batch_template(detected: DataFrame, template_fields: DataFrame, entries: DataFrame) -> DataFrame:
    """Detected texts (image_id, texts) to the template's keys, and those to the entries' metadata."""
    return M.apply_fields(entries, positional_fields(detected, template_fields))


def conditional(entries: DataFrame) -> DataFrame:
    """A configuration for each image, by its name."""
    return entries.withColumn("config", R.conditional_config(F.col("image_name")))


def custom_mapping(detected: DataFrame, entries: DataFrame) -> DataFrame:
    """The first three detected texts under keys of one's own."""
    chosen = map_by_index(detected, {0: "OCR_field_0", 1: "OCR_field_1", 2: "OCR_field_2"}).withColumnRenamed("metadata", "new")
    return entries.join(chosen, "image_id", "left").withColumn("metadata", M.upsert(F.col("metadata"), F.col("new"))).drop("new")


EXAMPLES = {f.__name__: f for f in (basic, batch_template, conditional, custom_mapping)}


def source(name: str) -> str:
    return inspect.getsource(EXAMPLES[name])
