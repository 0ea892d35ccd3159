"""Finding the label image of each project entry.

Entries are image_id, image_name, uris array<string>, metadata map<string,string>, assoc array<struct<ord int, name
string>>: their associated images, in order. Pixels stay in a table of their own (image_id, name, and the columns of
operators.images.IMAGE), which is read only when something is decoded.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

KEYWORDS = "label,barcode"


@F.pandas_udf(BinaryType())
def red_first(data: pd.Series, channels: pd.Series) -> pd.Series:
    """Samples of three or four channels, from blue, green, red (, alpha) to red, green, blue (, alpha)."""

    def one(x: bytes | None, n: int | None) -> bytes | None:
        if x is None or n not in (3, 4):
            return x
        return np.ascontiguousarray(np.frombuffer(x, np.uint8).reshape(-1, int(n))[:, [2, 1, 0, 3][: int(n)]]).tobytes()

    return pd.Series([one(x, n) for x, n in zip(data, channels)], dtype=object)


def read_image_files(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """Image files as IMAGE rows by Spark's own reader (8-bit, whose blue-first samples are turned into red first)."""
    raw = spark.read.format("image").option("dropInvalid", "true").option("recursiveFileLookup", str(recursive).lower()).load(path)
    i = F.col("image")
    return raw.select(F.xxhash64(i["origin"]).alias("image_id"), i["origin"].alias("uri"), i["width"].alias("width"), i["height"].alias("height"), i["nChannels"].alias("n_channels"), F.lit(8).alias("bits_per_sample"), red_first(i["data"], i["nChannels"]).alias("data"))


def keywords(preference: str | None) -> list[str]:
    """Null or empty gives the default; blanks and commas alone give none at all."""
    given = preference if preference else KEYWORDS
    return [k.strip() for k in given.split(",") if k.strip()]


def associated_names(assoc: Column) -> Column:
    """In order; null is none."""
    ordered = F.array_sort(F.coalesce(assoc, F.array().cast("array<struct<ord:int,name:string>>")))
    return F.transform(ordered, lambda a: a["name"])


def names_label(name: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(F.lower(name), F.lit(w.lower()))
    return out


def has_label(assoc: Column, preference: str | None = None) -> Column:
    """S3."""
    return F.exists(associated_names(assoc), lambda n: names_label(n, keywords(preference)))


def label_name(assoc: Column, preference: str | None = None) -> Column:
    """S3: the first associated image, in order, whose name contains a keyword; null without any."""
    return F.get(F.filter(associated_names(assoc), lambda n: names_label(n, keywords(preference))), F.lit(0))


def extraction_name(assoc: Column, source: str | None) -> Column:
    """The associated image of that name, whatever the case."""
    return F.get(F.filter(associated_names(assoc), lambda n: F.lower(n) == F.lit((source or "").lower())), F.lit(0))


def label_source(entries: DataFrame, preference: str | None = None, source: str | None = None) -> DataFrame:
    """Entries with label_name: that of the extraction if the entry has it, else by keyword; null: no label."""
    by_word = label_name(F.col("assoc"), preference)
    return entries.withColumn("label_name", F.coalesce(extraction_name(F.col("assoc"), source), by_word) if source else by_word)


def label_images(entries: DataFrame, pixels: DataFrame, preference: str | None = None, source: str | None = None) -> DataFrame:
    """S5's input: each entry's label image; entries without any stay, with null data."""
    named = label_source(entries, preference, source)
    return named.join(pixels.withColumnRenamed("name", "label_name"), ["image_id", "label_name"], "left")


def count_with_labels(entries: DataFrame, preference: str | None = None) -> DataFrame:
    """A11."""
    return entries.agg(F.count_if(has_label(F.col("assoc"), preference)).alias("with_label"), F.count("*").alias("total"))
