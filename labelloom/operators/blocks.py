"""Text blocks: filters, selection, aggregates and greedy de-duplication.

Blocks are image_id, block_idx, type (WORD, LINE, PARAGRAPH, BLOCK), text, confidence float, box. Order within an image
is block_idx, which must be there: DataFrames have none of their own.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from labelloom.functions import geometry as G
from labelloom.functions.text import control_trim, is_blank


def text_block(text: Column, confidence: Column, kind: Column) -> tuple[Column, Column, Column]:
    """Text trimmed and never null, confidence in [0, 1], type WORD by default."""
    clamped = F.least(F.greatest(confidence.cast("float"), F.lit(0.0).cast("float")), F.lit(1.0).cast("float"))
    return F.coalesce(control_trim(text), F.lit("")), clamped, F.coalesce(kind, F.lit("WORD"))


def above_confidence(blocks: DataFrame, least: float) -> DataFrame:
    """A float against a double, so 0.7 as a float is below 0.7."""
    return blocks.where(F.col("confidence").cast("double") >= F.lit(float(least)))


def of_type(blocks: DataFrame, kind: str) -> DataFrame:
    return blocks.where(F.col("type") == kind)


def not_blank(blocks: DataFrame) -> DataFrame:
    return blocks.where(~is_blank(F.col("text")))


def lines_else_words(blocks: DataFrame) -> DataFrame:
    """An image's LINE blocks that aren't empty, or where it has none its WORD blocks that aren't."""
    full = blocks.where("text <> ''")
    has_line = F.max(F.col("type") == "LINE").over(Window.partitionBy("image_id"))
    return full.withColumn("has_line", has_line).where("(has_line and type = 'LINE') or (not has_line and type = 'WORD')").drop("has_line")


def lines_else_distinct(blocks: DataFrame) -> DataFrame:
    """P5: image_id, block_idx, text: an image's LINE texts, repeats and all, or where it has none the distinct texts of
    all its blocks, each at its first place (O5). Empty texts are left out after that is asked: an image whose LINE texts
    are all empty has none."""
    marked = blocks.withColumn("has_line", F.max(F.col("type") == "LINE").over(Window.partitionBy("image_id"))).where("text <> ''")
    lines = marked.where("has_line and type = 'LINE'").select("image_id", "block_idx", "text")
    rest = marked.where("not has_line").groupBy("image_id", "text").agg(F.min("block_idx").alias("block_idx"))
    return lines.unionByName(rest)


def distinct_texts(blocks: DataFrame) -> DataFrame:
    """image_id, texts: distinct, in the order of their first places."""
    return blocks.groupBy("image_id").agg(F.array_distinct(ordered(F.col("text"))).alias("texts"))


def ordered(value: Column, by: Sequence[str] = ("block_idx",)) -> Column:
    """An array of a group's values in order."""
    return F.transform(F.array_sort(F.collect_list(F.struct(*by, value.alias("v")))), lambda x: x["v"])


def confidence_statistics(blocks: DataFrame) -> DataFrame:
    """Per image. Images without blocks aren't here; their values are 0."""
    kinds = {k: F.count_if((F.col("type") == k) & (F.col("text") != "")) for k in ("LINE", "WORD")}
    return blocks.groupBy("image_id").agg(
        F.coalesce(F.avg("confidence"), F.lit(0.0)).alias("avg_confidence"),
        F.coalesce(F.min("confidence"), F.lit(0.0)).cast("double").alias("min_confidence"),
        F.coalesce(F.max("confidence"), F.lit(0.0)).cast("double").alias("max_confidence"),
        F.count("*").alias("n_blocks"),
        kinds["LINE"].alias("n_lines"),
        kinds["WORD"].alias("n_words"),
        F.when(kinds["LINE"] > 0, kinds["LINE"]).otherwise(kinds["WORD"]).alias("n_display"),
    )


def full_text(blocks: DataFrame) -> DataFrame:
    """A3: image_id, full_text: texts that aren't empty, joined by a blank."""
    return blocks.groupBy("image_id").agg(F.array_join(F.filter(ordered(F.col("text")), lambda t: t != ""), " ").alias("full_text"))


def formatted_text(blocks: DataFrame) -> DataFrame:
    """A4: image_id, formatted_text: a line feed before each LINE or PARAGRAPH, a blank before others; empty texts too."""
    led = F.concat(F.when(F.col("type").isin("LINE", "PARAGRAPH"), F.lit("\n")).otherwise(F.lit(" ")), F.col("text"))
    return blocks.groupBy("image_id").agg(F.substring(F.array_join(ordered(led), ""), 2, 2**31 - 1).alias("formatted_text"))


def union_box(blocks: DataFrame, keys: Sequence[str] = ("image_id",)) -> DataFrame:
    """Keys, box around all boxes."""
    b = F.col("box")
    edges = blocks.groupBy(*keys).agg(F.min(b["x"]).alias("l"), F.min(b["y"]).alias("t"), F.max(G.right(b)).alias("r"), F.max(G.bottom(b)).alias("b"))
    return edges.select(*keys, F.when(F.col("l").isNotNull(), G.box(F.col("l"), F.col("t"), F.col("r") - F.col("l"), F.col("b") - F.col("t"))).alias("box"))


def combine_region(blocks: DataFrame, keys: Sequence[str], dx: Column | int = 0, dy: Column | int = 0, dedupe_levels: bool = False) -> DataFrame:
    """Keys, text, confidence, box. Words come before lines, so that text stands twice unless dedupe_levels takes
    lines else words. The confidence is the sum over blocks with text by the number of all."""
    kept = blocks
    if dedupe_levels:
        has_line = F.max(F.col("type") == "LINE").over(Window.partitionBy(*keys))
        kept = kept.withColumn("l", has_line).where("(l and type = 'LINE') or (not l and type = 'WORD')").drop("l")
    kept = kept.withColumn("level", (F.col("type") == "LINE").cast("int"))
    b = F.col("box")
    grouped = kept.groupBy(*keys).agg(
        F.array_join(F.filter(ordered(F.col("text"), ("level", "block_idx")), lambda t: t != ""), " ").alias("text"),
        (F.sum(F.when(F.col("text") != "", F.col("confidence").cast("double")).otherwise(0.0)) / F.count("*")).cast("float").alias("confidence"),
        F.min(b["x"]).alias("l"), F.min(b["y"]).alias("t"), F.max(G.right(b)).alias("r"), F.max(G.bottom(b)).alias("bt"),
    )
    whole = G.box(F.col("l") + dx, F.col("t") + dy, F.col("r") - F.col("l"), F.col("bt") - F.col("t"))
    return grouped.select(*keys, "text", "confidence", F.when(F.col("l").isNotNull(), whole).alias("box"))


def combine_barcodes(barcodes: DataFrame, keys: Sequence[str] = ("image_id",)) -> DataFrame:
    """A5: keys, text (joined by ;), format (MULTIPLE for more than one), first_text, first_format, n. By ord."""
    return barcodes.groupBy(*keys).agg(
        F.array_join(ordered(F.coalesce("text", F.lit("")), ("ord",)), ";").alias("text"),
        F.when(F.count("*") > 1, F.lit("MULTIPLE")).otherwise(F.min_by("format", "ord")).alias("format"),
        F.coalesce(F.min_by("text", "ord"), F.lit("")).alias("first_text"),
        F.min_by("format", "ord").alias("first_format"),
        F.count("*").alias("n"),
    )


def level_of(b: Column) -> Column:
    """The power of two, as its exponent, that a box's longer side doesn't exceed."""
    return F.ceil(F.log2(F.greatest(b["width"], b["height"], F.lit(1)).cast("double"))).cast("int")


def cells(b: Column, level: Column) -> Column:
    """Array of struct<cx, cy>: the cells of a level, with sides of 2 ** level, that a box reaches; its edges count."""
    side = F.pow(F.lit(2), level)
    span = lambda at, size: F.sequence(F.floor(at / side), F.floor((at + F.greatest(size, F.lit(0))) / side))
    return F.flatten(F.transform(span(b["x"], b["width"]), lambda cx: F.transform(span(b["y"], b["height"]), lambda cy: F.struct(cx.alias("cx"), cy.alias("cy")))))


def overlapping_pairs(blocks: DataFrame) -> DataFrame:
    """image_id, i, j, overlap, same_place: pairs i < j of one image whose boxes intersect.

    Boxes stand in a grid as coarse as their own longer side, in four cells at most, and look into those of every coarser
    grid that their image uses. Those that meet in a cell are compared, and a pair is kept in one cell alone: that of the
    corner where its overlap begins. So the work follows the boxes that are near each other, not all pairs of an image.
    """
    known = blocks.where("box is not null").select("image_id", "block_idx", "box", level_of(F.col("box")).alias("level"))
    levels = known.groupBy("image_id").agg(F.collect_set("level").alias("levels"))
    own = known.select("image_id", "block_idx", "box", "level", F.inline(cells(F.col("box"), F.col("level"))))
    probes = known.join(levels, "image_id").select("image_id", "block_idx", "box", F.col("level").alias("own"), F.explode(F.filter("levels", lambda x: x >= F.col("level"))).alias("level"))
    probes = probes.select("image_id", "block_idx", "box", "own", "level", F.inline(cells(F.col("box"), F.col("level"))))
    a, b = probes.alias("a"), own.alias("b")
    x, y, side = F.col("a.box"), F.col("b.box"), F.pow(F.lit(2), F.col("a.level"))
    where = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("image_id", "level", "cx", "cy")]
    once = (F.col("a.own") < F.col("a.level")) | (F.col("a.block_idx") < F.col("b.block_idx"))
    owner = (F.floor(F.greatest(x["x"], y["x"]) / side) == F.col("a.cx")) & (F.floor(F.greatest(x["y"], y["y"]) / side) == F.col("a.cy"))
    pairs = a.join(b, where[0] & where[1] & where[2] & where[3] & once & owner & G.intersects(x, y))
    i, j = F.col("a.block_idx"), F.col("b.block_idx")
    return pairs.where(i != j).select(F.col("a.image_id").alias("image_id"), F.least(i, j).alias("i"), F.greatest(i, j).alias("j"), G.overlap_area(x, y).alias("overlap"), G.same_place(x, y).alias("same_place"))


def on_each_other(boxes: list[tuple[int, int, int, int]]) -> np.ndarray:
    """G6 for all pairs of a few boxes: do they share over half of the smaller one?"""
    x, y, w, h = np.array(boxes, np.float64).reshape(-1, 4).T[:, :, None]
    shared = lambda at, size: np.minimum(at + size, (at + size).T) - np.maximum(at, at.T)
    across, down, smaller = shared(x, w), shared(y, h), np.minimum(w * h, (w * h).T)
    return (across > 0) & (down > 0) & (smaller > 0) & (across * down > 0.5 * smaller)


#: Boxes of an image whose pairs are all compared; of more, those that share a cell of a grid.
FEW = 256


def later_ones(boxes: list[tuple[int, int, int, int]], few: int = FEW) -> list[np.ndarray]:
    """For each box, the places of the later ones that lie on it (G6), ascending."""
    n = len(boxes)
    if n <= few:
        same = on_each_other(boxes)
        return [np.flatnonzero(same[i, i + 1 :]) + i + 1 for i in range(n)]
    x, y, w, h = np.array(boxes, np.float64).reshape(-1, 4).T
    level = np.ceil(np.log2(np.maximum(np.maximum(w, h), 1))).astype(int)
    used = sorted(set(level.tolist()))

    def reached(i: int, k: int) -> list[tuple[int, int, int]]:
        side = 2.0**k
        return [(k, cx, cy) for cx in range(int(x[i] // side), int((x[i] + max(w[i], 0)) // side) + 1) for cy in range(int(y[i] // side), int((y[i] + max(h[i], 0)) // side) + 1)]

    grid: dict[tuple[int, int, int], list[int]] = {}
    for i in range(n):
        for cell in reached(i, level[i]):
            grid.setdefault(cell, []).append(i)
    out: list[set[int]] = [set() for _ in range(n)]
    for i in range(n):
        met = {j for k in used if k >= level[i] for cell in reached(i, k) for j in grid.get(cell, ()) if j != i and (k > level[i] or j > i)}
        if not met:
            continue
        js = np.fromiter(met, np.int64, len(met))
        across = np.minimum(x[i] + w[i], x[js] + w[js]) - np.maximum(x[i], x[js])
        down = np.minimum(y[i] + h[i], y[js] + h[js]) - np.maximum(y[i], y[js])
        smaller = np.minimum(w[i] * h[i], w[js] * h[js])
        for j in js[(across > 0) & (down > 0) & (smaller > 0) & (across * down > 0.5 * smaller)].tolist():
            out[min(i, j)].add(max(i, j))
    return [np.array(sorted(s), np.int64) for s in out]


def dedupe_order(boxes: list[tuple[int, int, int, int]], confidences: list[float]) -> list[int]:
    """For each kept place, in order, the index of the block that is kept there. A place takes in the free blocks after
    its holder that lie on it, up to the first more confident one, which holds the place from there on."""
    after, sure, free = later_ones(boxes), np.asarray(confidences, np.float64), np.ones(len(boxes), bool)
    kept = []
    for first in range(len(boxes)):
        if not free[first]:
            continue
        holder = first
        free[holder] = False
        while True:
            later = after[holder][free[after[holder]]]
            surer = later[sure[later] > sure[holder]]
            free[later[later <= surer[0]] if len(surer) else later] = False
            if not len(surer):
                break
            holder = int(surer[0])
        kept.append(holder)
    return kept


@F.pandas_udf(ArrayType(IntegerType()))
def kept_places(x: pd.Series, y: pd.Series, width: pd.Series, height: pd.Series, confidence: pd.Series) -> pd.Series:
    return pd.Series([dedupe_order(list(zip(*sides)), list(c)) for *sides, c in zip(x, y, width, height, confidence)], dtype=object)


def dedupe_blocks(blocks: DataFrame) -> DataFrame:
    """Blocks of an image that lie on each other are one: the most confident of those that meet it in turn. The order
    of blocks decides, so an image's blocks (a label's few lines) are handled together, as arrays; columns as they come.
    Blocks without a box are never on another."""
    others = [c for c in blocks.columns if c not in ("image_id", "block_idx")]
    packed = blocks.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("block_idx", *others))).alias("rows"))
    side = lambda c: F.transform("rows", lambda r: F.coalesce(r["box"][c], F.lit(0)))
    kept = kept_places(side("x"), side("y"), side("width"), side("height"), F.transform("rows", lambda r: r["confidence"]))
    chosen = packed.select("image_id", "rows", kept.alias("kept")).select("image_id", F.inline(F.transform("kept", lambda i: F.get("rows", i))))
    return chosen.select(*blocks.columns)


def dedupe_lines(blocks: DataFrame) -> DataFrame:
    """Words as they are, then lines without those that lie on each other."""
    return of_type(blocks, "WORD").unionByName(dedupe_blocks(of_type(blocks, "LINE")))


def field_keys(kept: DataFrame, prefix: str = "", kind: str = "field", start: int = 0) -> DataFrame:
    """Default keys prefix + kind_ + number, from start, over the kept rows of an image."""
    number = F.row_number().over(Window.partitionBy("image_id").orderBy("block_idx")) - 1 + start
    return kept.withColumn("field_index", number).withColumn("metadata_key", F.concat(F.lit(f"{prefix}{kind}_"), number))


def append_after(first: DataFrame, second: DataFrame) -> DataFrame:
    """Both bags, with source_rank 0 and 1 to order by."""
    return first.withColumn("source_rank", F.lit(0)).unionByName(second.withColumn("source_rank", F.lit(1)), allowMissingColumns=True)
