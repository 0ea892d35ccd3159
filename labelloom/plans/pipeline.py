"""From label images to metadata: the batch over a project, and single steps as functions over DataFrames (C3, C4, 3.1-3.3)."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelloom.functions.text import TextFilter, filter_text_fields
from labelloom.operators import blocks as B
from labelloom.operators import fields as R
from labelloom.operators import images as I
from labelloom.operators import metadata as M
from labelloom.operators.decode import REGION, Decoder, decode_in_place, detect_texts
from labelloom.operators.template import Extraction, Template, few, positional_fields, region_array
from labelloom.operators.vocabulary import Matcher, correct
from labelloom.plans.config import OcrConfig, batch_config, config_of


def extraction_step(extraction: Extraction) -> Callable[[np.ndarray], np.ndarray]:
    """S5."""

    def step(x: np.ndarray) -> np.ndarray:
        return I.extract_label(x, 8 * x.itemsize, extraction.crop, extraction.rotation, extraction.flip_horizontal, extraction.flip_vertical)

    return step


def read_fields(images: DataFrame, template: Template, make: Callable[[], Decoder], config: OcrConfig = OcrConfig()) -> DataFrame:
    """Decoded regions of a template with positions, with their keys: image_id, field_index, metadata_key, text, ..."""
    fields = few(template.fields(images.sparkSession).select("field_index", "metadata_key", "region_type"))
    found = decode_in_place(images, region_array(template, F.col("width"), F.col("height")), make, config)
    return found.join(fields, "field_index")


def extracted_labels(images: DataFrame, template: Template) -> DataFrame:
    """The extraction's step over its own images; a label that was found by keyword (label_name, if images tell it)
    is taken as it is."""
    if not template.extraction:
        return images
    step = extraction_step(template.extraction)
    if "label_name" not in images.columns or not template.extraction.source_image:
        return I.map_images(images, step)
    own = F.coalesce(F.lower("label_name") == template.extraction.source_image.lower(), F.lit(False))
    plain = images.where(~own)
    return I.map_images(images.where(own), step).unionByName(plain.select("image_id", "width", "height", "n_channels", "bits_per_sample", "data"))


def read_positions(images: DataFrame, template: Template, make: Callable[[], Decoder], config: OcrConfig = OcrConfig()) -> DataFrame:
    """The generic branch, for a template without boxes: the texts of whole labels by their places; a place that wasn't
    detected gives the empty text. Columns as of read_fields, without boxes."""
    found = detect_texts(images, make, config)
    placed = positional_fields(found, template.fields(images.sparkSession)).join(found.select("image_id", "success", "error"), "image_id")
    return placed.select("image_id", "field_index", "metadata_key", "text", F.lit("TEXT").alias("source_type"), "success", "error")


def run_batch(entries: DataFrame, images: DataFrame, template: Template, make: Callable[[], Decoder], filters: tuple[TextFilter, ...] = (), vocabulary: DataFrame | None = None, matcher: Matcher = Matcher(), config: OcrConfig | None = None) -> DataFrame:
    """The batch: entries (image_id, metadata) with status, preview, applied and the new metadata. images: label images
    (IMAGE, and label_name where the label's source matters); entries without one end as "No label". A template with boxes
    reads its regions, one without reads whole labels by place. Without a config the template's own holds, else that of
    the session. Filters leave barcodes alone; the vocabulary corrects text fields."""
    config = config or batch_config(entries.sparkSession, config_of(template.configuration))
    images = extracted_labels(images, template)
    found = (read_fields if template.has_boxes() else read_positions)(images.where("data is not null"), template, make, config)
    if filters:
        found = found.withColumn("text", filter_text_fields(F.col("text"), F.col("source_type"), *filters))
    if vocabulary is not None:
        fixed = correct(found.where("source_type = 'TEXT'"), vocabulary, matcher).drop("matched", "distance", "similarity")
        found = fixed.select(*found.columns).unionByName(found.where("source_type <> 'TEXT'"))
    results = R.batch_results(found)
    failed = found.groupBy("image_id").agg(F.bool_and(~F.col("success")).alias("failed"))
    labelled = images.where("data is not null").select("image_id", F.lit(True).alias("labelled"))
    rows = entries.join(labelled, "image_id", "left").join(failed, "image_id", "left").join(results, "image_id", "left")
    rows = rows.withColumn("status", R.batch_status(F.col("labelled"), F.col("failed"))).withColumn("preview", F.coalesce("preview", F.lit("")))
    return M.apply_batch(rows).select(*entries.columns, "status", "preview", "applied") if "metadata" in entries.columns else M.apply_batch(rows.withColumn("metadata", F.create_map().cast("map<string,string>")))


def detected_texts(blocks: DataFrame) -> DataFrame:
    """image_id, texts: an image's lines, or all its distinct texts (P5), in order."""
    return B.lines_else_distinct(blocks).groupBy("image_id").agg(B.ordered(F.col("text")).alias("texts"))


def whole_regions(*kinds: str) -> Column:
    """An array of regions, one for each kind of reading, of the whole image."""
    return F.array(*(F.struct(F.lit(i).alias("field_index"), F.lit(kind).alias("region_type"), F.lit(None).cast("struct<x int, y int, width int, height int>").alias("box")) for i, kind in enumerate(kinds))).cast(f"array<{REGION}>")


def read_labels(images: DataFrame, make: Callable[[], Decoder], config: OcrConfig = OcrConfig(), kind: str = "TEXT", box: Column | None = None) -> DataFrame:
    """Each image read at once, whole or within a box of its own columns, as TEXT, BARCODE or AUTO; lazy, so there is
    no asynchronous twin."""
    regions = whole_regions(kind) if box is None else F.array(F.struct(F.lit(0).alias("field_index"), F.lit(kind).alias("region_type"), box.alias("box"))).cast(f"array<{REGION}>")
    return decode_in_place(images, regions, make, config)


def scan_full_image(images: DataFrame, make: Callable[[], Decoder], config: OcrConfig = OcrConfig()) -> DataFrame:
    """Barcodes of the whole image and then its text, both from one pass; source_rank 0 and 1."""
    found = decode_in_place(images, whole_regions("BARCODE", "TEXT"), make, config)
    return found.where("field_index = 1 or text <> ''").withColumn("source_rank", F.col("field_index"))


def label_metadata(entries: DataFrame, images: DataFrame, make: Callable[[], Decoder], key: str = "OCR_field_0", kind: str = "TEXT", config: OcrConfig = OcrConfig()) -> DataFrame:
    """Reads each entry's label image and stores its text under key, in one call: entries (image_id, metadata) with the
    new metadata and applied (1 where something was stored). Entries without a label, or with an empty text, stay as they are."""
    found = read_labels(images, make, config, kind).where("success and text <> ''").select("image_id", F.col("text").alias("label_text"))
    rows = entries.join(found, "image_id", "left")
    new = F.when(F.col("label_text").isNotNull(), M.set_one(F.col("metadata"), F.lit(key), F.col("label_text"))).otherwise(F.col("metadata"))
    applied = F.when(F.col("label_text").isNotNull(), M.upsert_count(F.create_map(F.lit(key), F.col("label_text")))).otherwise(0)
    return rows.select(*(c for c in entries.columns if c != "metadata"), new.alias("metadata"), applied.alias("applied"))
