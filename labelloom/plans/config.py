"""Configuration: immutable, clamped on the way in, set through a fluent builder."""

from __future__ import annotations

import re
from dataclasses import dataclass, fields, replace
from enum import IntEnum
from typing import Any

from pyspark.sql import SparkSession

#: Page segmentation and engine modes, by the numbers that recognisers know them by (2 is not one).
PageSegMode = IntEnum(
    "PageSegMode",
    {"OSD_ONLY": 0, "AUTO_OSD": 1, "AUTO": 3, "SINGLE_COLUMN": 4, "SINGLE_BLOCK_VERT": 5, "SINGLE_BLOCK": 6, "SINGLE_LINE": 7, "SINGLE_WORD": 8, "CIRCLE_WORD": 9, "SINGLE_CHAR": 10, "SPARSE_TEXT": 11, "SPARSE_TEXT_OSD": 12, "RAW_LINE": 13},
)
EngineMode = IntEnum("EngineMode", {"LEGACY": 0, "LSTM_ONLY": 1, "COMBINED": 2, "DEFAULT": 3})

#: The modes that a settings form offers, in its order.
OFFERED_MODES = (PageSegMode.SPARSE_TEXT, PageSegMode.AUTO, PageSegMode.SINGLE_BLOCK, PageSegMode.SINGLE_LINE, PageSegMode.SINGLE_WORD)

PREFIX = "spark.labelloom."
#: S14. Preferences and their defaults.
DEFAULTS: dict[str, Any] = {
    "language": "eng",
    "dataPath": "",
    "minConfidence": 0.5,
    "autoRotate": True,
    "enhanceContrast": True,
    "detectOrientation": True,
    "pageSegMode": 11,
    "metadataPrefix": "OCR_",
    "labelImageKeywords": "label,barcode",
    "autoRunOnEntrySwitch": True,
    "dialogWidth": 900.0,
    "dialogHeight": 700.0,
}
#: What resetting leaves alone.
KEPT_ON_RESET = ("autoRunOnEntrySwitch", "dialogWidth", "dialogHeight")


@dataclass(frozen=True)
class OcrConfig:
    """C1. replace() of dataclasses is its builder; equality is by value."""

    page_seg_mode: PageSegMode = PageSegMode.AUTO
    engine_mode: EngineMode = EngineMode.LSTM_ONLY
    language: str = "eng"
    min_confidence: float = 0.5
    auto_rotate: bool = True
    detect_orientation: bool = True
    enhance_contrast: bool = True
    enable_preprocessing: bool = True
    invert: bool = False
    crop_region: tuple[int, int, int, int] | None = None
    whitelist: str = ""

    def __post_init__(self) -> None:
        put = object.__setattr__
        put(self, "page_seg_mode", PageSegMode(self.page_seg_mode if self.page_seg_mode is not None else PageSegMode.AUTO))
        put(self, "engine_mode", EngineMode(self.engine_mode if self.engine_mode is not None else EngineMode.LSTM_ONLY))
        put(self, "language", (self.language or "").strip() or "eng")
        put(self, "min_confidence", min(1.0, max(0.0, float(self.min_confidence))))
        put(self, "whitelist", self.whitelist or "")


def preference(spark: SparkSession, name: str) -> Any:
    """A preference of the session, of the type of its default."""
    default = DEFAULTS[name]
    given = spark.conf.get(PREFIX + name, None)
    if given is None:
        return default
    return given.lower() == "true" if isinstance(default, bool) else type(default)(given)


def set_preference(spark: SparkSession, name: str, value: Any) -> None:
    if name not in DEFAULTS:
        raise KeyError(name)
    spark.conf.set(PREFIX + name, str(value).lower() if isinstance(value, bool) else str(value))


def reset_preferences(spark: SparkSession) -> None:
    for name in DEFAULTS:
        if name not in KEPT_ON_RESET:
            spark.conf.unset(PREFIX + name)


def session_config(spark: SparkSession) -> OcrConfig:
    """From the session's preferences; modes go by their numbers."""
    p = {k: preference(spark, k) for k in DEFAULTS}
    return OcrConfig(PageSegMode(p["pageSegMode"]), language=p["language"], min_confidence=p["minConfidence"], auto_rotate=p["autoRotate"], detect_orientation=p["detectOrientation"], enhance_contrast=p["enhanceContrast"])


def batch_config(spark: SparkSession, template_config: OcrConfig | None = None) -> OcrConfig:
    """A batch's, where the template has none of its own."""
    if template_config is not None:
        return template_config
    p = session_config(spark)
    return OcrConfig(PageSegMode.SPARSE_TEXT, language=p.language, min_confidence=p.min_confidence, enhance_contrast=p.enhance_contrast)


def config_of(given: dict[str, Any] | None) -> OcrConfig | None:
    """The configuration that a template's JSON holds, by its names; modes by name or number. None without any."""
    if not given:
        return None
    names = {re.sub("_(.)", lambda m: m[1].upper(), f.name): f.name for f in fields(OcrConfig)}
    modes = {"page_seg_mode": PageSegMode, "engine_mode": EngineMode}
    said = {names[k]: v for k, v in given.items() if k in names and v is not None}
    return OcrConfig(**{k: modes[k][v] if k in modes and isinstance(v, str) else tuple(v) if k == "crop_region" else v for k, v in said.items()})


#: Q11: what a single image with fixed positions is read with.
FIXED_POSITIONS = OcrConfig(PageSegMode.SINGLE_BLOCK, min_confidence=0.1)


class OcrBuilder:
    """Each call gives a new builder; build() the configuration, reader() a transformation for DataFrame.transform."""

    def __init__(self, config: OcrConfig | None = None):
        self.config = config or OcrConfig(PageSegMode.SPARSE_TEXT)

    def but(self, **changes: Any) -> OcrBuilder:
        return OcrBuilder(replace(self.config, **changes))

    def page_seg_mode(self, mode: PageSegMode | int) -> OcrBuilder:
        return self.but(page_seg_mode=PageSegMode(mode))

    def sparse_text(self) -> OcrBuilder:
        return self.page_seg_mode(PageSegMode.SPARSE_TEXT)

    def auto_detect(self) -> OcrBuilder:
        return self.page_seg_mode(PageSegMode.AUTO)

    def single_block(self) -> OcrBuilder:
        return self.page_seg_mode(PageSegMode.SINGLE_BLOCK)

    def single_line(self) -> OcrBuilder:
        return self.page_seg_mode(PageSegMode.SINGLE_LINE)

    def single_word(self) -> OcrBuilder:
        return self.page_seg_mode(PageSegMode.SINGLE_WORD)

    def single_column(self) -> OcrBuilder:
        return self.page_seg_mode(PageSegMode.SINGLE_COLUMN)

    def enhance(self) -> OcrBuilder:
        return self.but(enhance_contrast=True, enable_preprocessing=True)

    def no_enhance(self) -> OcrBuilder:
        return self.but(enhance_contrast=False, enable_preprocessing=False)

    def invert(self) -> OcrBuilder:
        return self.but(invert=True)

    def no_invert(self) -> OcrBuilder:
        return self.but(invert=False)

    def min_confidence(self, least: float) -> OcrBuilder:
        return self.but(min_confidence=least)

    def language(self, code: str) -> OcrBuilder:
        return self.but(language=code)

    def detect_orientation(self) -> OcrBuilder:
        return self.but(detect_orientation=True)

    def no_detect_orientation(self) -> OcrBuilder:
        return self.but(detect_orientation=False)

    def auto_rotate(self) -> OcrBuilder:
        return self.but(auto_rotate=True)

    def no_auto_rotate(self) -> OcrBuilder:
        return self.but(auto_rotate=False)

    def region(self, x: int, y: int, width: int, height: int) -> OcrBuilder:
        return self.but(crop_region=(x, y, width, height))

    def full_image(self) -> OcrBuilder:
        return self.but(crop_region=None)

    def allowed_chars(self, chars: str) -> OcrBuilder:
        return self.but(whitelist=chars)

    def all_chars(self) -> OcrBuilder:
        return self.but(whitelist="")

    def build(self) -> OcrConfig:
        return self.config

    def to_script(self) -> str:
        """Python that makes this configuration again."""
        c, base = self.config, OcrConfig(PageSegMode.SPARSE_TEXT)
        calls = []
        if c.page_seg_mode != base.page_seg_mode:
            calls.append(f"page_seg_mode({int(c.page_seg_mode)})")
        if c.enhance_contrast != base.enhance_contrast or c.enable_preprocessing != base.enable_preprocessing:
            calls.append("enhance()" if c.enhance_contrast else "no_enhance()")
        if c.invert:
            calls.append("invert()")
        if c.min_confidence != base.min_confidence:
            calls.append(f"min_confidence({c.min_confidence})")
        if c.language != base.language:
            calls.append(f"language({c.language!r})")
        if c.detect_orientation != base.detect_orientation:
            calls.append("no_detect_orientation()")
        if c.auto_rotate != base.auto_rotate:
            calls.append("no_auto_rotate()")
        if c.crop_region:
            calls.append("region({}, {}, {}, {})".format(*c.crop_region))
        if c.whitelist:
            calls.append(f"allowed_chars({c.whitelist!r})")
        return "config = (\n    OcrBuilder()\n" + "".join(f"    .{x}\n" for x in calls) + "    .build()\n)"

    def reader(self, make: Any, regions: Any = None) -> Any:
        """A transformation of images: decoded regions (by default each image whole, as TEXT)."""
        from pyspark.sql import functions as F

        from labelloom.functions.geometry import BOX
        from labelloom.operators.decode import REGION, decode_in_place, decode_regions

        config = self.config

        def read(images):
            cut = F.lit(None).cast(BOX) if config.crop_region is None else F.struct(*(F.lit(v).alias(k) for k, v in zip(("x", "y", "width", "height"), config.crop_region)))
            if regions is not None:
                return decode_regions(images, regions, make, config)
            whole = F.array(F.struct(F.lit(0).alias("field_index"), F.lit("TEXT").alias("region_type"), cut.alias("box"))).cast(f"array<{REGION}>")
            return decode_in_place(images, whole, make, config)

        return read
