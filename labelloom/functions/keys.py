"""Metadata keys: validation, sanitising, suggestions (V1-V6)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from labelloom.functions.text import control_trim

MOST = 128
PREFIX = "OCR_"
VALID = r"^[a-zA-Z_][a-zA-Z0-9_-]*$"

#: Keys that the host keeps for itself.
RESERVED = (
    "name", "imageName", "imageId", "id", "path", "uri", "description",
    "project", "projectName", "projectPath",
    "server", "serverPath", "serverType",
    "pixelWidth", "pixelHeight", "pixelWidthMicrons", "pixelHeightMicrons", "pixelSizeMicrons", "timepoint", "zPosition",
    "width", "height", "nChannels", "nZSlices", "nTimepoints", "bitDepth", "imageType",
    "dateCreated", "dateModified", "owner", "version",
)


#: What is wrong with a key.
EMPTY = "Metadata key cannot be null or empty"
TOO_LONG = f"Metadata key exceeds maximum length of {MOST} characters"
KEPT = "'%s' is a reserved key and cannot be used for OCR metadata"
NOT_VALID = "'%s' is not a valid metadata key. Keys must start with a letter or underscore and contain only letters, numbers, underscores, and hyphens"


def bound(value: Column, *steps: Callable[[Column], Column]) -> Column:
    """steps one after the other, each result worked out once however often the next step reads it."""
    x = F.array(value)
    for step in steps:
        x = F.transform(x, step)
    return F.get(x, F.lit(0))


def is_reserved(key: Column) -> Column:
    """V2."""
    return F.coalesce(F.lower(key).isin([k.lower() for k in RESERVED]), F.lit(False))


def key_error(key: Column) -> Column:
    """V1: null for a valid key, else what is wrong with it; of the key without blanks at its ends."""
    return bound(
        control_trim(key),
        lambda trimmed: F.when(F.coalesce(trimmed, F.lit("")) == "", F.lit(EMPTY))
        .when(F.char_length(trimmed) > MOST, F.lit(TOO_LONG))
        .when(is_reserved(trimmed), F.format_string(KEPT, trimmed))
        .when(~trimmed.rlike(VALID), F.format_string(NOT_VALID, trimmed)),
    )


def validate_key(key: Column) -> Column:
    """struct<valid, error>."""
    error = key_error(key)
    return F.struct(error.isNull().alias("valid"), F.coalesce(error, F.lit("")).alias("error"))


def is_valid_key(key: Column) -> Column:
    return key_error(key).isNull()


def sanitize_key(key: Column) -> Column:
    """V3: a valid key near the given one, or null."""
    return bound(
        F.regexp_replace(F.translate(control_trim(key), " ./\\:", "_____"), "[^a-zA-Z0-9_-]", ""),
        lambda kept: F.when(kept == "", F.lit(None).cast("string")).when(kept.rlike("^[a-zA-Z_]"), F.left(kept, F.lit(MOST))).otherwise(F.left(F.concat(F.lit("ocr_"), kept), F.lit(MOST))),
        lambda cut: F.when(is_reserved(cut), F.concat(F.lit("ocr_"), cut)).otherwise(cut),
        lambda free: F.when(free.rlike(VALID) & (F.char_length(free) <= MOST) & ~is_reserved(free), free),
    )


def suggest_key(key: Column) -> Column:
    """V4."""
    candidates = [F.concat(F.lit(p), key) for p in ("ocr_", "label_")]
    return F.when(key.isNull(), F.lit("ocr_field")).otherwise(F.coalesce(*(F.when(is_valid_key(c), c) for c in candidates), F.concat(F.lit("custom_"), key)))


def ocr_key(key: Column, prefix: str = PREFIX, faithful: bool = False) -> Column:
    """V5: prefix and the sanitised key. Where nothing valid is left: null, or with faithful the prefix and "null"."""
    clean = sanitize_key(key)
    if faithful:
        clean = F.coalesce(clean, F.lit("null"))
    return F.when(F.coalesce(control_trim(key), F.lit("")) != "", F.concat(F.lit(prefix), clean))
