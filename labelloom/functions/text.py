"""

All functions pass nulls through. Lengths count code points.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class TextFilter:
    """A regular expression and its replacement (F10); any further filter can be built."""

    name: str
    label: str
    tooltip: str
    pattern: str
    replacement: str = ""

    def __call__(self, text: Column) -> Column:
        return F.regexp_replace(text, self.pattern, self.replacement)

    @property
    def description(self) -> str:
        return f"{self.tooltip}\n\nRegex: {self.pattern} " + (f"-> {self.replacement}" if self.replacement else "(remove)")

    @property
    def keeps(self) -> bool:
        """Does it keep a class of characters, or transform?"""
        return "Only" in self.name or self.name in ("Alphanumeric", "Filename Safe")


#: F1-F6. Names, labels, tooltips and patterns of the filters, in their order.
LETTERS_ONLY = TextFilter("Letters Only", "abcABC", "Keep only letters (a-z, A-Z). Removes numbers, symbols, and whitespace.", "[^a-zA-Z]")
NUMBERS_ONLY = TextFilter("Numbers Only", "123", "Keep only numbers (0-9). Removes letters, symbols, and whitespace.", "[^0-9]")
ALPHANUMERIC = TextFilter("Alphanumeric", "aA1", "Keep letters and numbers only. Removes symbols and whitespace.", "[^a-zA-Z0-9]")
FILENAME_SAFE = TextFilter("Filename Safe", "-_.", "Keep characters safe for filenames: letters, numbers, dash, underscore, period.", "[^a-zA-Z0-9._-]")
STANDARD_CHARS = TextFilter("Standard Chars", "&*!", "Remove unusual characters. Keep letters, numbers, common punctuation, and spaces.", r"[^a-zA-Z0-9\s.,;:!?'\"()-]")
NO_WHITESPACE = TextFilter("No Whitespace", "A B->A_B", "Replace all whitespace (spaces, tabs, newlines) with underscores.", r"\s+", "_")
ALL_FILTERS = (LETTERS_ONLY, NUMBERS_ONLY, ALPHANUMERIC, FILENAME_SAFE, STANDARD_CHARS, NO_WHITESPACE)


def apply_all(text: Column, *filters: TextFilter) -> Column:
    """filters one after the other."""
    return reduce(lambda c, f: f(c), filters, text)


def active_filters(original: Column, active: set[TextFilter] | frozenset[TextFilter]) -> Column:
    """F8: the active ones of ALL_FILTERS, in that order, always from the original text."""
    return apply_all(original, *(f for f in ALL_FILTERS if f in active))


def filter_text_fields(text: Column, region_type: Column, *filters: TextFilter) -> Column:
    """barcode text is left alone."""
    return F.when(region_type == "TEXT", apply_all(text, *filters)).otherwise(text)


def control_trim(text: Column) -> Column:
    """without the characters up to U+0020 at both ends."""
    return F.regexp_replace(text, r"^[\x00-\x20]+|[\x00-\x20]+$", "")


def is_blank(text: Column) -> Column:
    """Null or nothing but characters up to U+0020."""
    return F.coalesce(control_trim(text) == "", F.lit(True))


def confidence_percent(confidence: Column) -> Column:
    """rounded half up, computed in float."""
    return F.floor((confidence.cast("float") * F.lit(100).cast("float")).cast("float") + F.lit(0.5).cast("float")).cast("int")


def match_display(original: Column, matched: Column, distance: Column, similarity: Column) -> Column:
    """F13."""
    return F.when(distance == 0, F.format_string("'%s' (exact match)", matched)).otherwise(F.format_string("'%s' -> '%s' (distance=%.2f, %.0f%% similar)", original, matched, distance, similarity * 100))


def type_display(region_type: Column, barcode_format: Column) -> Column:
    """[FORMAT] of a barcode, else the type's display name, else nothing."""
    names = F.create_map(*(F.lit(x) for pair in REGION_NAMES.items() for x in pair))
    return F.when((region_type == "BARCODE") & (F.coalesce(barcode_format, F.lit("")) != ""), F.concat(F.lit("["), barcode_format, F.lit("]"))).otherwise(F.coalesce(F.try_element_at(names, F.coalesce(region_type, F.lit(""))), F.lit("")))


def shortened(text: Column, most: int = 20) -> Column:
    """F15."""
    return F.when(F.char_length(text) > most, F.concat(F.left(text, F.lit(most)), F.lit("..."))).otherwise(text)


#: Region types, their display names and short labels.
REGION_NAMES = {"TEXT": "Text", "BARCODE": "Barcode", "AUTO": "Try Both"}
REGION_LABELS = {"TEXT": "TXT", "BARCODE": "BAR", "AUTO": "?"}


def region_type(value: Column) -> Column:
    """A region type by its name or display name, whatever the case; all else is TEXT."""
    lower = F.lower(control_trim(value))
    out = F.lit("TEXT")
    for name, display in REGION_NAMES.items():
        out = F.when(lower.isin(name.lower(), display.lower()), F.lit(name)).otherwise(out)
    return out


def numeric_key(key: Column) -> Column:
    """The number that a key's digits make; 0 without digits or beyond 32 bits (compared by place there)."""
    return F.coalesce(F.regexp_replace(key, r"\D+", "").try_cast("int"), F.lit(0))


def traineddata_name(language: Column) -> Column:
    """F16."""
    return F.concat(language, F.lit(".traineddata"))


def percent_text(confidence: Column) -> Column:
    """0.876 -> 88%."""
    return F.format_string("%.0f%%", confidence * 100)
