"""Decoders as plug-ins (E1-E16). Recognition itself is not here: a Decoder finds text blocks and barcodes in an array.

Decoding never fails a task: what goes wrong in a row is in that row (success, error).
"""

from __future__ import annotations

import re
import time
import warnings
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from functools import lru_cache
from typing import Any, Protocol

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labelloom.operators import images as I
from labelloom.operators.blocks import dedupe_order
from labelloom.plans.config import OcrConfig

Box = tuple[int, int, int, int]
DECODED = "image_id long, field_index int, text string, confidence float, box struct<x int, y int, width int, height int>, source_type string, format string, processing_ms long, success boolean, error string"


@dataclass(frozen=True)
class Block:
    text: str
    box: Box
    confidence: float
    type: str = "WORD"


@dataclass(frozen=True)
class Barcode:
    text: str
    format: str
    box: Box | None = None


class Decoder(Protocol):
    """What a plug-in offers; either may return nothing."""

    def read_text(self, image: np.ndarray, config: OcrConfig) -> list[Block]: ...

    def read_barcodes(self, image: np.ndarray) -> list[Barcode]: ...

    # A decoder may also offer read_orientation(image) -> str, of the form that orientation_degrees() reads.


class FixtureDecoder:
    """Blocks and barcodes by an image's bytes: for tests, and to replay recorded results."""

    def __init__(self, texts: dict[bytes, list[Block]] | None = None, codes: dict[bytes, list[Barcode]] | None = None):
        self.texts, self.codes = texts or {}, codes or {}

    def read_text(self, image: np.ndarray, config: OcrConfig) -> list[Block]:
        return self.texts.get(np.ascontiguousarray(image).tobytes(), [])

    def read_barcodes(self, image: np.ndarray) -> list[Barcode]:
        return self.codes.get(np.ascontiguousarray(image).tobytes(), [])


def extracted(blocks: list[Block], config: OcrConfig) -> list[Block]:
    """Words, then lines without those on each other; blank ones and those below the confidence go."""
    kept = [Block(b.text.strip("".join(map(chr, range(33)))), b.box, b.confidence, b.type) for b in blocks]
    kept = [b for b in kept if b.text and np.float32(b.confidence) >= config.min_confidence]
    lines = [b for b in kept if b.type == "LINE"]
    return [b for b in kept if b.type == "WORD"] + [lines[i] for i in dedupe_order([b.box for b in lines], [b.confidence for b in lines])]


def orientation_degrees(text: str) -> int:
    """E5."""
    found = re.search(r"Orientation in degrees:\s*(\d+)", text)
    return int(found[1]) if found else 0


def orientation_column(text: Column) -> Column:
    """E5 over a column."""
    return F.coalesce(F.regexp_extract(text, r"Orientation in degrees:\s*(\d+)", 1).try_cast("int"), F.lit(0))


def moved(code: Barcode, dx: int, dy: int, scale: int = 1) -> Barcode:
    """Into the image that the part was cut from."""
    b = code.box
    return Barcode(code.text, code.format, b and (b[0] // scale + dx, b[1] // scale + dy, b[2] // scale, b[3] // scale))


def attempts(image: np.ndarray) -> Iterator[tuple[Callable[[], np.ndarray], int, int, int]]:
    """Images to try, cheapest first, each made when its turn comes; with offset and scale."""
    h, w = image.shape[:2]
    yield lambda: image, 0, 0, 1
    yield lambda: I.invert(image), 0, 0, 1
    better = lru_cache(maxsize=1)(lambda: I.barcode_contrast(image))
    yield better, 0, 0, 1
    yield lambda: I.invert(better()), 0, 0, 1
    if min(w, h) < 500:
        for scale in (2, 3):
            yield lambda scale=scale: I.upscale(image, scale), 0, 0, scale
    if w > 300 and h > 300:
        for y0, y1 in ((0, h // 2 + h // 4), (h // 2 - h // 4, h)):
            for x0, x1 in ((0, w // 2 + w // 4), (w // 2 - w // 4, w)):
                if x1 - x0 >= 50 and y1 - y0 >= 50:
                    yield lambda x0=x0, x1=x1, y0=y0, y1=y1: image[y0:y1, x0:x1], x0, y0, 1


def decode_with_retry(decoder: Decoder, image: np.ndarray) -> list[Barcode]:
    """The first attempt that finds a barcode."""
    for make, dx, dy, scale in attempts(image):
        if codes := decoder.read_barcodes(make()):
            return [moved(c, dx, dy, scale) for c in codes]
    return []


def joined_codes(codes: list[Barcode]) -> tuple[str, str | None, Box | None]:
    """A5: text, format, the first code's box."""
    return ";".join(c.text for c in codes), (None if not codes else codes[0].format if len(codes) == 1 else "MULTIPLE"), codes[0].box if codes else None


def around(boxes: list[Box]) -> Box | None:
    """A6."""
    if not boxes:
        return None
    x, y = min(b[0] for b in boxes), min(b[1] for b in boxes)
    return x, y, max(b[0] + b[2] for b in boxes) - x, max(b[1] + b[3] for b in boxes) - y


def result(text: str = "", confidence: float = 0.0, box: Box | None = None, source: str = "TEXT", form: str | None = None, success: bool = True, error: str | None = None) -> dict[str, Any]:
    """E15, E16."""
    return {"text": text, "confidence": confidence, "box": box and dict(zip(("x", "y", "width", "height"), box)), "source_type": source, "format": form, "success": success, "error": error}


def read_blocks(decoder: Decoder, image: np.ndarray, config: OcrConfig, auto_crop: bool = True) -> list[Block]:
    """Crop or auto-crop, invert, threshold, turn upright, read; boxes found in an auto-cropped part are
    moved back to the image."""
    part, (dx, dy) = I.preprocess(image, config.crop_region, auto_crop and config.enable_preprocessing, enhance=False)
    if config.invert:
        part = I.invert(part)
    if config.enhance_contrast and config.enable_preprocessing:
        part = I.adaptive_threshold(I.luma_gray(part))
    turned = getattr(decoder, "read_orientation", None)
    if config.detect_orientation and turned and (degrees := orientation_degrees(turned(part))) and config.auto_rotate:
        part = I.rotate(part, degrees)
    return [Block(b.text, (b.box[0] + dx, b.box[1] + dy, b.box[2], b.box[3]), b.confidence, b.type) for b in extracted(decoder.read_text(part, config), config)]


def shown_texts(blocks: list[Block]) -> list[str]:
    """The texts of lines, or else of words."""
    return [b.text for b in blocks if b.type == "LINE"] or [b.text for b in blocks if b.type == "WORD"]


def extract_text(decoder: Decoder, image: np.ndarray, config: OcrConfig) -> str:
    """The text alone, a line each, without auto-crop."""
    return "\n".join(shown_texts(read_blocks(decoder, image, config, auto_crop=False)))


def decode_text(decoder: Decoder, part: np.ndarray, config: OcrConfig, dx: int, dy: int) -> dict[str, Any]:
    """Confidence is the sum over blocks with text by the number of all."""
    blocks = read_blocks(decoder, part, config)
    box = around([b.box for b in blocks])
    return result(" ".join(b.text for b in blocks), sum(b.confidence for b in blocks) / len(blocks) if blocks else 0.0, box and (box[0] + dx, box[1] + dy, box[2], box[3]))


def decode_codes(codes: list[Barcode], dx: int, dy: int) -> dict[str, Any]:
    text, form, box = joined_codes([moved(c, dx, dy) for c in codes])
    return result(text, 1.0 if codes else 0.0, box, "BARCODE", form)


def decode_region(decoder: Decoder, image: np.ndarray | None, region: Box | None, kind: str | None, config: OcrConfig = OcrConfig()) -> dict[str, Any]:
    """TEXT (also for no type), BARCODE with retries, or AUTO: barcodes at the first try, else text. A region
    outside the image is the whole image, for BARCODE an error."""
    if image is None:
        return result(success=False, error="Image cannot be null", source=kind or "TEXT")
    try:
        h, w = image.shape[:2]
        dx = dy = 0
        if region is not None:
            x, y = max(0, region[0]), max(0, region[1])
            inside = min(region[2], w - x) > 0 and min(region[3], h - y) > 0
            if not inside and kind == "BARCODE":
                return result(success=False, error="Invalid region", source="BARCODE")
            dx, dy = (x, y) if inside else (0, 0)
        part = I.crop(image, region)
        if kind == "BARCODE":
            return decode_codes(decode_with_retry(decoder, part), dx, dy)
        if kind == "AUTO" and (codes := decoder.read_barcodes(part)):
            return decode_codes(codes, dx, dy)
        return decode_text(decoder, part, config, dx, dy)
    except Exception as e:  # noqa: BLE001  a plug-in may raise anything; the row says so
        return result(success=False, error=f"{type(e).__name__}: {e}", source=kind or "TEXT")


def pixels(row: dict[str, Any]) -> tuple[np.ndarray | None, str | None]:
    """An IMAGE row's pixels in eight bits (None without data), and what is wrong with them."""
    if row["data"] is None:
        return None, None
    try:
        bits = int(row["bits_per_sample"])
        return I.to_eight_bit(I.raster(row["data"], int(row["width"]), int(row["height"]), int(row["n_channels"]), bits), bits), None
    except Exception as e:  # noqa: BLE001  bytes that aren't the image they should be are that row's error
        return None, f"{type(e).__name__}: {e}"


def checked_config(spark: SparkSession, folder: str, config: OcrConfig = OcrConfig()) -> OcrConfig:
    """E1, once before a run: config, if folder has a model for each of its languages (joined by +), else a ValueError that
    names what is missing. Without the orientation's model a warning is given, and orientation isn't asked for. The folder
    is listed by Spark, so any that Spark reads will do."""
    try:
        paths = [r[0] for r in spark.read.format("binaryFile").option("pathGlobFilter", "*.traineddata").load(folder).select("path").collect()]
    except AnalysisException as e:
        raise ValueError(f"no folder of models: {folder}") from e
    found = {p.rpartition("/")[2].removesuffix(".traineddata") for p in paths}
    if missing := [x for x in config.language.split("+") if x not in found]:
        raise ValueError(f"{folder} has no model for: {', '.join(missing)}")
    if config.detect_orientation and "osd" not in found:
        warnings.warn(f"{folder} has no osd.traineddata: orientation isn't detected", stacklevel=2)
        return replace(config, detect_orientation=False)
    return config


def detect_texts(images: DataFrame, make: Callable[[], Decoder], config: OcrConfig = OcrConfig()) -> DataFrame:
    """image_id, texts (P4, in order), success, error of whole label images."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        decoder = make()
        for batch in batches:
            out = []
            for r in batch.to_dict("records"):
                image, broken = pixels(r)
                texts: list[str] = []
                if image is not None:
                    try:
                        texts = shown_texts(read_blocks(decoder, image, config))
                    except Exception as e:  # noqa: BLE001  a plug-in may raise anything; the row says so
                        broken = f"{type(e).__name__}: {e}"
                out.append((r["image_id"], texts, broken is None, broken))
            yield pd.DataFrame(out, columns=["image_id", "texts", "success", "error"])

    return images.select("image_id", "width", "height", "n_channels", "bits_per_sample", "data").mapInPandas(run, "image_id long, texts array<string>, success boolean, error string")


REGION = "struct<field_index int, region_type string, box struct<x int, y int, width int, height int>>"


def decode_rows(rows: DataFrame, make: Callable[[], Decoder], config: OcrConfig = OcrConfig()) -> DataFrame:
    """decoded_regions (DECODED) of images with their regions (array of REGION; a null box: the whole image): all regions of
    an image are read from one copy of its pixels. make() runs once in a worker (E1)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        decoder = make()
        for batch in batches:
            out = []
            for r in batch.to_dict("records"):
                image, broken = pixels(r)
                for g in r["regions"]:
                    box = g["box"] and tuple(g["box"][k] for k in ("x", "y", "width", "height"))
                    began = time.monotonic()
                    found = result(success=False, error=broken, source=g["region_type"] or "TEXT") if broken else decode_region(decoder, image, box, g["region_type"], config)
                    out.append({"image_id": r["image_id"], "field_index": g["field_index"], "processing_ms": int(1000 * (time.monotonic() - began)), **found})
            yield pd.DataFrame(out, columns=["image_id", "field_index", "text", "confidence", "box", "source_type", "format", "processing_ms", "success", "error"])

    return rows.select("image_id", "width", "height", "n_channels", "bits_per_sample", "data", "regions").mapInPandas(run, DECODED)


def decode_in_place(images: DataFrame, regions: Column, make: Callable[[], Decoder], config: OcrConfig = OcrConfig()) -> DataFrame:
    """DECODED of regions that follow from an image's own columns (array of REGION): a projection, so pixels stay where they
    were read. Images without regions give no row."""
    return decode_rows(images.withColumn("regions", regions).where(F.size("regions") > 0), make, config)


def decode_regions(images: DataFrame, regions: DataFrame, make: Callable[[], Decoder], config: OcrConfig = OcrConfig()) -> DataFrame:
    """DECODED of a table of regions (image_id, field_index, region_type, box). An image's regions go to it as an array, so
    that its pixels move once, by image_id; where regions follow from a template, decode_in_place moves none."""
    wanted = regions.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("field_index", "region_type", "box"))).alias("regions"))
    return decode_rows(wanted.join(images.select("image_id", "width", "height", "n_channels", "bits_per_sample", "data"), "image_id", "left"), make, config)


def extract_texts(images: DataFrame, make: Callable[[], Decoder], config: OcrConfig = OcrConfig()) -> DataFrame:
    """image_id, text (a line each, without auto-crop), success, error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        decoder = make()
        for batch in batches:
            out = []
            for r in batch.to_dict("records"):
                image, broken = pixels(r)
                text = ""
                if image is not None:
                    try:
                        text = extract_text(decoder, image, config)
                    except Exception as e:  # noqa: BLE001  a plug-in may raise anything; the row says so
                        broken = f"{type(e).__name__}: {e}"
                out.append((r["image_id"], text, broken is None, broken))
            yield pd.DataFrame(out, columns=["image_id", "text", "success", "error"])

    return images.select("image_id", "width", "height", "n_channels", "bits_per_sample", "data").mapInPandas(run, "image_id long, text string, success boolean, error string")
