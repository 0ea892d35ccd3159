"""Templates: regions, positional mapping, building and writing.

A template's fields are rows of field_index, metadata_key, example_text, enabled, nx, ny, nw, nh, has_bounding_box,
region_type. A template has few fields, whatever the number of images: it is broadcast where it has MOST_FIELDS at most,
and as an array literal its regions are worked out in the image's own row, without any exchange.
"""

from __future__ import annotations

import json
import warnings
from dataclasses import asdict, dataclass, field, replace
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labelloom.functions import geometry as G
from labelloom.functions.text import numeric_key

FIELDS = "field_index int, metadata_key string, example_text string, enabled boolean, nx double, ny double, nw double, nh double, has_bounding_box boolean, region_type string"
DILATION = 1.2
LEAST_SIDE = 5
#: Fields that are broadcast at most; the rows of a larger template are joined as Spark sees fit.
MOST_FIELDS = 10_000

#: Names in the JSON form, by column.
JSON_NAMES = {
    "field_index": "fieldIndex", "metadata_key": "metadataKey", "example_text": "exampleText", "enabled": "enabled", "nx": "normalizedX", "ny": "normalizedY", "nw": "normalizedWidth", "nh": "normalizedHeight", "has_bounding_box": "hasBoundingBox", "region_type": "regionType",
}


@dataclass(frozen=True)
class Extraction:
    """Which associated image holds the label, and how to cut and turn it."""

    source_image: str | None = None
    crop: tuple[int, int, int, int] | None = None
    rotation: int = 0
    flip_horizontal: bool = False
    flip_vertical: bool = False


@dataclass(frozen=True)
class FieldMapping:
    field_index: int = 0
    metadata_key: str | None = None
    example_text: str | None = None
    enabled: bool = True
    nx: float = 0.0
    ny: float = 0.0
    nw: float = 0.0
    nh: float = 0.0
    has_bounding_box: bool = False
    region_type: str = "TEXT"


@dataclass(frozen=True)
class Template:
    name: str | None = None
    description: str | None = None
    mappings: tuple[FieldMapping, ...] = ()
    configuration: dict[str, Any] = field(default_factory=dict)
    extraction: Extraction | None = None
    created: int = 0
    use_fixed_positions: bool = False
    dilation: float = DILATION

    def __post_init__(self) -> None:
        if self.dilation < 1:
            warnings.warn(f"a dilation of {self.dilation} shrinks the boxes", stacklevel=2)

    def has_boxes(self) -> bool:
        """P8."""
        return any(m.has_bounding_box for m in self.mappings)

    def enabled_count(self) -> int:
        return sum(m.enabled for m in self.mappings)

    def fields(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([tuple(asdict(m).values()) for m in self.mappings], FIELDS)

    def keys(self) -> list[str]:
        """Enabled keys in the template's order, each once."""
        return list(dict.fromkeys(m.metadata_key for m in self.mappings if m.enabled and m.metadata_key))


def region_type_name(value: str | None) -> str:
    names = {"text": "TEXT", "barcode": "BARCODE", "auto": "AUTO", "try both": "AUTO"}
    return names.get((value or "").strip().lower(), "TEXT")


def from_json(text: str, infer_boxes: bool = False) -> Template:
    """Missing keys take their defaults, unknown ones are left out. infer_boxes: a field with sides but without
    hasBoundingBox has a box (by default it has none)."""
    given = json.loads(text)
    mappings = []
    for m in given.get("fieldMappings") or []:
        values = {c: m[j] for c, j in JSON_NAMES.items() if m.get(j) is not None}
        values["region_type"] = region_type_name(values.get("region_type"))
        one = FieldMapping(**values)
        if infer_boxes and "hasBoundingBox" not in m and one.nw > 0 and one.nh > 0:
            one = replace(one, has_bounding_box=True)
        mappings.append(one)
    cut = given.get("labelExtraction")
    extraction = cut and Extraction(
        cut.get("sourceImageName"),
        tuple(cut[k] for k in ("cropX", "cropY", "cropWidth", "cropHeight")) if all(cut.get(k) is not None for k in ("cropX", "cropY", "cropWidth", "cropHeight")) else None,
        int(cut.get("rotation") or 0) % 360,
        bool(cut.get("flipHorizontal")),
        bool(cut.get("flipVertical")),
    )
    return Template(given.get("name"), given.get("description"), tuple(mappings), given.get("configuration") or {}, extraction or None, given.get("createdTimestamp") or 0, bool(given.get("useFixedPositions")), given.get("dilationFactor", DILATION))


def to_json(template: Template) -> str:
    """Nulls are left out."""
    some = lambda d: {k: v for k, v in d.items() if v is not None}
    cut = template.extraction
    out = {
        "name": template.name,
        "description": template.description,
        "fieldMappings": [some({j: getattr(m, c) for c, j in JSON_NAMES.items()}) for m in template.mappings],
        "configuration": template.configuration or None,
        "labelExtraction": cut and some({"sourceImageName": cut.source_image, **dict(zip(("cropX", "cropY", "cropWidth", "cropHeight"), cut.crop or (None,) * 4)), "rotation": cut.rotation, "flipHorizontal": cut.flip_horizontal, "flipVertical": cut.flip_vertical}),
        "createdTimestamp": template.created,
        "useFixedPositions": template.use_fixed_positions,
        "dilationFactor": template.dilation,
    }
    return json.dumps(some(out), indent=2, ensure_ascii=False)


def few(fields: DataFrame, most: int = MOST_FIELDS) -> DataFrame:
    """fields, marked for a broadcast if there are no more than that."""
    return F.broadcast(fields) if fields.limit(most + 1).count() <= most else fields


def region_array(template: Template, width: Column, height: Column, least_side: int = LEAST_SIDE) -> Column:
    """J6, G7, G8, P7 within an image's row: array of struct<field_index, region_type, box>, in the order of the fields. The
    template is one literal."""
    some = [{"i": m.field_index, "t": m.region_type, "x": m.nx, "y": m.ny, "w": m.nw, "h": m.nh} for m in template.mappings if m.enabled and m.has_bounding_box]
    literal = F.from_json(F.lit(json.dumps(some)), "array<struct<i int, t string, x double, y double, w double, h double>>")

    def region(f: Column) -> Column:
        kind = F.coalesce(f["t"], F.lit("TEXT"))
        b = G.scaled_box(f["x"], f["y"], f["w"], f["h"], width, height, G.effective_dilation(kind, F.lit(float(template.dilation))))
        return F.struct(f["i"].alias("field_index"), kind.alias("region_type"), b.alias("box"))

    return F.array_sort(F.filter(F.transform(literal, region), lambda r: (r["box"]["width"] >= least_side) & (r["box"]["height"] >= least_side)))


def template_regions(images: DataFrame, fields: DataFrame, dilation: float = DILATION, least_side: int = LEAST_SIDE) -> DataFrame:
    """image_id, field_index, metadata_key, region_type, box for each enabled field with a box of each
    image (image_id, width, height); boxes of less than least_side pixels are left out. The template is the small side."""
    some = fields.where("enabled and has_bounding_box")
    kind = F.coalesce("region_type", F.lit("TEXT"))
    b = G.scaled_box(F.col("nx"), F.col("ny"), F.col("nw"), F.col("nh"), F.col("width"), F.col("height"), G.effective_dilation(kind, F.lit(float(dilation))))
    pairs = images.select("image_id", "width", "height").join(few(some), how="cross")
    return pairs.select("image_id", "field_index", "metadata_key", kind.alias("region_type"), b.alias("box")).where((F.col("box.width") >= least_side) & (F.col("box.height") >= least_side))


def positional_fields(detected: DataFrame, fields: DataFrame) -> DataFrame:
    """image_id, field_index, metadata_key, text: detected (image_id, texts: array, by place) against the enabled
    fields; a place that wasn't detected gives the empty text. No shuffle: the template is broadcast, texts are an array."""
    pairs = detected.select("image_id", "texts").join(few(fields.where("enabled").select("field_index", "metadata_key")), how="cross")
    return pairs.select("image_id", "field_index", "metadata_key", F.coalesce(F.get("texts", F.col("field_index")), F.lit("")).alias("text"))


def map_by_index(detected: DataFrame, mapping: dict[int, str]) -> DataFrame:
    """K8: image_id, metadata: keys for places of the detected texts; places that aren't there are left out."""
    entries = F.array(*(F.struct(F.lit(k).alias("key"), F.get("texts", F.lit(i)).alias("value"), F.lit(i).alias("i")) for i, k in sorted(mapping.items())))
    there = F.filter(entries, lambda e: (e["i"] < F.size("texts")) & (e["i"] >= 0))
    return detected.select("image_id", F.map_from_entries(F.transform(there, lambda e: F.struct(e["key"], e["value"]))).alias("metadata"))


def fields_to_rows(entries: DataFrame) -> DataFrame:
    """Template rows of field entries (field_index, text, metadata_key); the index counts entries without key, which
    are then dropped; no boxes."""
    return entries.where(F.coalesce(F.trim("metadata_key"), F.lit("")) != "").select("field_index", "metadata_key", F.col("text").alias("example_text"), F.lit(True).alias("enabled"), *(F.lit(0.0).alias(c) for c in ("nx", "ny", "nw", "nh")), F.lit(False).alias("has_bounding_box"), F.lit("TEXT").alias("region_type"))


def grid_to_rows(entries: DataFrame, image_width: Column, image_height: Column) -> DataFrame:
    """Template rows of a grid with boxes, in shares of the image; entries without key stay."""
    n = G.normalized(F.col("box"), image_width, image_height)
    there = F.col("box").isNotNull()
    return entries.select("field_index", "metadata_key", F.col("text").alias("example_text"), F.lit(True).alias("enabled"), *(F.when(there, n[c]).otherwise(0.0).alias(c) for c in ("nx", "ny", "nw", "nh")), there.alias("has_bounding_box"), F.coalesce("region_type", F.lit("TEXT")).alias("region_type"))


def preview_rows(fields: DataFrame, prefix: str = "OCR_") -> DataFrame:
    """field_index, metadata_key (default prefix field_index), example_text (default empty)."""
    return fields.select("field_index", F.coalesce("metadata_key", F.concat(F.lit(f"{prefix}field_"), "field_index")).alias("metadata_key"), F.coalesce("example_text", F.lit("")).alias("example_text"))


def pivot_results(results: DataFrame, keys: list[str]) -> DataFrame:
    """One row per image, one column per key; keys come from the template, so the columns don't depend on the data."""
    return results.groupBy("image_id").pivot("metadata_key", keys).agg(F.min_by("text", "field_index"))


def order_by_number(rows: DataFrame, key: str = "metadata_key", then: str = "field_index") -> DataFrame:
    """O4."""
    return rows.orderBy(numeric_key(F.col(key)), then)
