"""Metadata maps: reads, upserts and prefix operations on a map<string,string> column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelloom.functions.keys import is_valid_key

MAP = "map<string,string>"


def or_empty(metadata: Column) -> Column:
    return F.coalesce(metadata, F.create_map().cast(MAP))


def get(metadata: Column, key: Column | str) -> Column:
    """K3; null for a key that isn't there."""
    return F.try_element_at(or_empty(metadata), F.lit(key) if isinstance(key, str) else key)


def has(metadata: Column, key: Column | str) -> Column:
    """K3."""
    return F.map_contains_key(or_empty(metadata), key)


def merged(metadata: Column, new: Column) -> Column:
    """new over metadata."""
    old = F.map_filter(or_empty(metadata), lambda k, v: ~F.map_contains_key(or_empty(new), k))
    return F.map_concat(old, or_empty(new))


def valid_entries(new: Column) -> Column:
    """K2: keys are checked without the blanks at their ends, and stored as given."""
    return F.map_filter(or_empty(new), lambda k, v: is_valid_key(k))


def upsert(metadata: Column, new: Column) -> Column:
    """K2: the valid entries of new over metadata."""
    return merged(metadata, valid_entries(new))


def upsert_count(new: Column) -> Column:
    """K2: how many entries are set."""
    return F.size(valid_entries(new))


def set_one(metadata: Column, key: Column, value: Column) -> Column:
    """K1: metadata as it was where the key isn't valid."""
    return F.when(is_valid_key(key), merged(metadata, F.create_map(key, value))).otherwise(or_empty(metadata))


def set_unchecked(metadata: Column, key: Column, value: Column) -> Column:
    """K7: any key but the empty one; a null value is the empty text."""
    return F.when(F.coalesce(key, F.lit("")) != "", merged(metadata, F.create_map(key, F.coalesce(value, F.lit(""))))).otherwise(or_empty(metadata))


def remove(metadata: Column, key: Column | str) -> Column:
    """K4."""
    key = F.lit(key) if isinstance(key, str) else key
    return F.map_filter(or_empty(metadata), lambda k, v: k != key)


def removed(metadata: Column, key: Column | str) -> Column:
    """K4: was there a value? A key with a null value says no."""
    return get(metadata, key).isNotNull()


def by_prefix(metadata: Column, prefix: str) -> Column:
    """K5, case-sensitive."""
    return F.map_filter(or_empty(metadata), lambda k, v: F.startswith(k, F.lit(prefix)))


def clear_prefix(metadata: Column, prefix: str) -> Column:
    """K6."""
    return F.map_filter(or_empty(metadata), lambda k, v: ~F.startswith(k, F.lit(prefix)))


def cleared_count(metadata: Column, prefix: str) -> Column:
    """K6."""
    return F.size(by_prefix(metadata, prefix))


def field_value(metadata: Column, key: Column | str) -> Column:
    """R2: the empty text for a key that isn't there."""
    return F.coalesce(get(metadata, key), F.lit(""))


def apply_batch(rows: DataFrame) -> DataFrame:
    """K9: rows (image_id, status, metadata, fields: map). Of status Done and with fields: valid ones are set, empty
    values too, and the status is Applied, or Failed if none is valid. Other rows stay as they are."""
    ready = (F.col("status") == "Done") & (F.size(or_empty(F.col("fields"))) > 0)
    count = upsert_count(F.col("fields"))
    return rows.withColumn("applied", F.when(ready, count).otherwise(0)).withColumn("metadata", F.when(ready, upsert(F.col("metadata"), F.col("fields"))).otherwise(or_empty(F.col("metadata")))).withColumn("status", F.when(ready & (count > 0), "Applied").when(ready, "Failed").otherwise(F.col("status")))


def apply_fields(images: DataFrame, fields: DataFrame) -> DataFrame:
    """Fields (image_id, field_index, metadata_key, text) to the images' metadata: blank keys or texts and invalid
    keys are left out, of one key the last field wins. Adds applied."""
    kept = fields.where((F.coalesce(F.trim("metadata_key"), F.lit("")) != "") & (F.coalesce(F.trim("text"), F.lit("")) != "") & is_valid_key(F.col("metadata_key")))
    last = kept.groupBy("image_id", "metadata_key").agg(F.max_by("text", "field_index").alias("text"))
    maps = last.groupBy("image_id").agg(F.map_from_entries(F.collect_list(F.struct("metadata_key", "text"))).alias("fields"))
    joined = images.join(maps, "image_id", "left")
    return joined.withColumn("applied", F.size(or_empty(F.col("fields")))).withColumn("metadata", merged(F.col("metadata"), F.col("fields"))).drop("fields")


def long_form(images: DataFrame) -> DataFrame:
    """image_id, key, value."""
    return images.select("image_id", F.explode("metadata").alias("key", "value"))


def write_back(images: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One write for the whole batch."""
    images.write.mode(mode).parquet(path)
