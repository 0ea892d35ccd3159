"""Field rows and batch results.

Fields are image_id, field_index, original_text, text, metadata_key, region_type, confidence, box, barcode_format.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelloom.functions import geometry as G
from labelloom.functions.keys import is_valid_key
from labelloom.functions.text import REGION_LABELS, TextFilter, apply_all


def previous_images(images: DataFrame, order: str = "image_id", group: str | None = None, buckets: int | None = None) -> DataFrame:
    """Images (image_id, width, height, n_fields) with prev_image_id, prev_width, prev_height: of the last image
    before it, by a numeric order, that had a field. group: a column that splits the order (a slide box, a project).

    Without a group all images are one order. It is cut into buckets at quantiles: each bucket looks back within itself,
    and for its first images to the last one of the buckets before, of which there is one row each.
    """
    had = F.when(F.col("n_fields") > 0, F.struct(F.col("image_id").alias("id"), F.col("width").alias("w"), F.col("height").alias("h")))
    if group:
        window = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        found = images.withColumn("p", F.last(had, ignorenulls=True).over(window))
    else:
        n = buckets or int(images.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        edges = sorted(set(images.stat.approxQuantile(order, [i / n for i in range(1, n)], 0.1 / n))) if n > 1 else []
        bucket = F.size(F.filter(F.array(*map(F.lit, edges)).cast("array<double>"), lambda e: e <= F.col(order).cast("double")))
        rows = images.withColumn("bucket", bucket)
        lasts = rows.groupBy("bucket").agg(F.max_by(had, F.when(had.isNotNull(), F.col(order))).alias("l"))
        before = F.last("l", ignorenulls=True).over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
        starts = lasts.select("bucket", before.alias("start"))
        inside = Window.partitionBy("bucket").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        found = rows.withColumn("p", F.last(had, ignorenulls=True).over(inside)).join(F.broadcast(starts), "bucket").withColumn("p", F.coalesce("p", "start")).drop("bucket", "start")
    return found.select("*", F.col("p.id").alias("prev_image_id"), F.col("p.w").alias("prev_width"), F.col("p.h").alias("prev_height")).drop("p")


def carry_over_keys(fields: DataFrame, images: DataFrame) -> DataFrame:
    """Fields with metadata_key taken from the first field of the previous image whose centre, in shares of its own
    image, lies in the field's box (edges included) and whose key isn't empty; else as it is. images: with
    previous_images(). The join is on the previous image, the place is its condition."""
    new = fields.join(images.select("image_id", "width", "height", "prev_image_id", "prev_width", "prev_height"), "image_id")
    old = fields.where("box is not null and metadata_key is not null and metadata_key <> ''").select(F.col("image_id").alias("prev_image_id"), F.col("field_index").alias("prev_index"), F.col("metadata_key").alias("prev_key"), F.col("box").alias("prev_box"))
    b, p = F.col("box"), F.col("prev_box")
    cx, cy = (p["x"] + p["width"] / F.lit(2.0)) / F.col("prev_width"), (p["y"] + p["height"] / F.lit(2.0)) / F.col("prev_height")
    x, y = b["x"] / F.col("width").cast("double"), b["y"] / F.col("height").cast("double")
    w, h = b["width"] / F.col("width").cast("double"), b["height"] / F.col("height").cast("double")
    inside = (cx >= x) & (cx <= x + w) & (cy >= y) & (cy <= y + h)
    hits = new.join(old, (new["prev_image_id"] == old["prev_image_id"]) & inside).groupBy("image_id", "field_index").agg(F.min_by("prev_key", "prev_index").alias("carried_key"))
    return fields.join(hits, ["image_id", "field_index"], "left").withColumn("metadata_key", F.coalesce("carried_key", "metadata_key")).drop("carried_key")


def filter_statistics(fields: DataFrame, *filters: TextFilter, text: str = "text") -> DataFrame:
    """modified_fields, modified_images."""
    changed = ~F.col(text).eqNullSafe(apply_all(F.col(text), *filters))
    return fields.agg(F.count_if(changed).alias("modified_fields"), F.count_distinct(F.when(changed, F.col("image_id"))).alias("modified_images"))


def batch_preview(n_text: Column, n_barcode: Column) -> Column:
    """A10."""
    n = n_text + n_barcode
    both = F.format_string("%d fields (%d text, %d barcode)", n, n_text, n_barcode)
    return F.when(n == 0, "(no matching fields)").when((n_text > 0) & (n_barcode > 0), both).otherwise(F.format_string("%d fields", n))


def batch_results(regions: DataFrame) -> DataFrame:
    """A10, 3.1: image_id, n_text, n_barcode, preview, fields: regions (image_id, field_index, metadata_key, text,
    source_type) decoded; a region without text gives the empty value; of one key the last region wins."""
    found = F.coalesce("text", F.lit("")) != ""
    last = regions.groupBy("image_id", "metadata_key").agg(F.max_by(F.coalesce("text", F.lit("")), "field_index").alias("text"), F.count_if(found & (F.col("source_type") == "BARCODE")).alias("b"), F.count_if(found & (F.coalesce("source_type", F.lit("TEXT")) != "BARCODE")).alias("t"))
    per_image = last.groupBy("image_id").agg(F.sum("t").alias("n_text"), F.sum("b").alias("n_barcode"), F.map_from_entries(F.filter(F.collect_list(F.struct("metadata_key", "text")), lambda e: e["metadata_key"].isNotNull())).alias("fields"))
    return per_image.select("image_id", "n_text", "n_barcode", batch_preview(F.col("n_text"), F.col("n_barcode")).alias("preview"), "fields")


def batch_status(has_label: Column, failed: Column, n_fields: Column | None = None) -> Column:
    """Where an image ends after decoding."""
    return F.when(F.coalesce(failed, F.lit(False)), "Error").when(~F.coalesce(has_label, F.lit(False)), "No label").otherwise("Done")


def batch_summary(rows: DataFrame) -> DataFrame:
    """Total, successful, applied, failed."""
    s = F.col("status")
    return rows.agg(F.count("*").alias("total"), F.count_if(s.isin("Done", "Applied")).alias("successful"), F.count_if(s == "Applied").alias("applied"), F.count_if(s == "Failed").alias("failed"))


def reset(rows: DataFrame) -> DataFrame:
    """Back to Pending, without fields."""
    return rows.withColumn("status", F.lit("Pending")).withColumn("fields", F.create_map().cast("map<string,string>"))


def field_state(fields: DataFrame) -> DataFrame:
    """image_id, state, state_hash: what tells whether an image's fields have changed."""
    b = F.col("box")
    at = F.when(b.isNull(), "").otherwise(F.concat_ws(",", b["x"], b["y"], b["width"], b["height"]))
    one = F.concat(F.concat_ws("|", F.coalesce("text", F.lit("")), F.coalesce("metadata_key", F.lit("")), F.coalesce("region_type", F.lit("")), at), F.lit(";"))
    state = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("field_index", one.alias("v")))), lambda x: x["v"]), "")
    return fields.groupBy("image_id").agg(state.alias("state")).withColumn("state_hash", F.xxhash64("state"))


def metadata_preview(fields: DataFrame) -> DataFrame:
    """P10: image_id, preview: key: value lines of fields with both."""
    kept = fields.where((F.coalesce(F.trim("metadata_key"), F.lit("")) != "") & (F.coalesce(F.trim("text"), F.lit("")) != ""))
    line = F.concat_ws(": ", "metadata_key", "text")
    return kept.groupBy("image_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("field_index", line.alias("v")))), lambda x: x["v"]), "\n").alias("preview"))


def conditional_config(name: Column) -> Column:
    """A configuration by what an image's name says."""
    says = lambda *parts: F.greatest(*(F.contains(name, F.lit(p)) for p in parts))
    return F.struct(
        (F.contains(name, F.lit("DARK")) | F.startswith(name, F.lit("VendorX_"))).alias("invert"),
        says("ROTATED", "_90_").alias("detect_orientation"),
        F.when(says("OLD", "_faded"), 0.3).otherwise(0.5).alias("min_confidence"),
        F.when(F.contains(name, F.lit("_simple_")), "SINGLE_LINE").when(F.contains(name, F.lit("_block_")), "SINGLE_BLOCK").otherwise("SPARSE_TEXT").alias("page_seg_mode"),
        F.lit(True).alias("enhance"),
    )


def route_text(text: Column, routes: dict[str, str]) -> Column:
    """The key of the first pattern that is found in text, else null."""
    out = F.lit(None).cast("string")
    for key, pattern in reversed(routes.items()):
        out = F.when(text.rlike(pattern), F.lit(key)).otherwise(out)
    return out


#: P12's own routes.
ROUTES = {"CaseID": r"CASE-\d+", "Date": r"\d{4}-\d{2}-\d{2}|\d{1,2}/\d{1,2}/\d{2,4}"}


def same_entry(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows whose first URIs are equal."""
    return left.alias("l").join(right.alias("r"), F.get("l.uris", F.lit(0)) == F.get("r.uris", F.lit(0)))


def entry_classes(rows: DataFrame, key: str = "image_id") -> DataFrame:
    """P13 for a whole project: key, entry: the smallest key among the rows with the same first URI, so that n equal entries
    are n rows. A row without a URI is an entry of its own."""
    first = rows.select(key, F.get("uris", F.lit(0)).alias("uri"))
    known = first.where("uri is not null")
    least = known.groupBy("uri").agg(F.min(key).alias("entry"))
    return known.join(least, "uri").select(key, "entry").unionByName(first.where("uri is null").select(key, F.col(key).alias("entry")))


def add_field(fields: DataFrame, image_ids: DataFrame, region_type: str = "TEXT", box: Column | None = None, prefix: str = "", kind: str | None = None) -> DataFrame:
    """One empty field more for each of image_ids; its number is the image's number of fields."""
    kind = kind or ("barcode" if region_type == "BARCODE" else "field")
    counted = image_ids.join(fields.groupBy("image_id").agg(F.count("*").alias("n")), "image_id", "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("int"))
    b = box if box is not None else F.lit(None)
    new = counted.select("image_id", F.col("n").alias("field_index"), F.lit("").alias("original_text"), F.lit("").alias("text"), F.concat(F.lit(f"{prefix}{kind}_"), "n").alias("metadata_key"), F.lit(region_type).alias("region_type"), F.lit(1.0).cast("float").alias("confidence"), b.cast(G.BOX).alias("box"))
    if box is not None:
        new = new.where((F.col("box.width") >= 5) & (F.col("box.height") >= 5))
    return fields.unionByName(new, allowMissingColumns=True)


def remove_fields(fields: DataFrame, gone: DataFrame) -> DataFrame:
    """Without the (image_id, field_index) of gone."""
    return fields.join(gone.select("image_id", "field_index").distinct(), ["image_id", "field_index"], "left_anti")


def edit_fields(fields: DataFrame, edits: DataFrame) -> DataFrame:
    """Edits (image_id, field_index, new_text, new_key; null: as it is); an invalid key changes nothing."""
    joined = fields.join(edits.select("image_id", "field_index", "new_text", "new_key"), ["image_id", "field_index"], "left")
    key = F.when(F.col("new_key").isNotNull() & is_valid_key(F.col("new_key")), F.col("new_key")).otherwise(F.col("metadata_key"))
    return joined.withColumn("text", F.coalesce("new_text", "text")).withColumn("metadata_key", key).drop("new_text", "new_key")


def numbered(fields: DataFrame) -> DataFrame:
    """row_no from 1 within an image."""
    return fields.withColumn("row_no", F.row_number().over(Window.partitionBy("image_id").orderBy("field_index")))


def overlay_labels(fields: DataFrame) -> DataFrame:
    """Fields with a box, and label: their number among those, and the short label of their type."""
    number = F.row_number().over(Window.partitionBy("image_id").orderBy("field_index"))
    short = F.create_map(*(F.lit(x) for pair in REGION_LABELS.items() for x in pair))
    tag = F.coalesce(F.try_element_at(short, F.coalesce("region_type", F.lit("TEXT"))), F.lit("TXT"))
    return fields.where("box is not null").withColumn("label", F.concat(number, F.lit("["), tag, F.lit("]")))
