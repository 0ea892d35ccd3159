"""Pixel operators over a long table (A12, A13, I1, I2, I4, I6, I11): image_id, width, height, y, x, value, a row for each pixel.

What images.py does with one array at a time is said here as aggregates and windows, so that an image needs no task of its own:
sums over windows of pixels come from running sums along rows and then along columns, thresholds from running sums over the
bins of a histogram. Groups are lines of an image, or its bins; no task holds more than one of them. Values are whole
numbers, all pixels of an image are there, and width and height stand beside each, so that nothing is joined to learn them.
Null values are left out of histograms; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelloom.operators.images import luma_gray, mean_gray, raster

PIXELS = "image_id long, width int, height int, y int, x int, value int"
NO_CLASSES = 128


def pixel_rows(images: DataFrame, luma: bool = True) -> DataFrame:
    """PIXELS of images (IMAGE's columns), by brightness or, with luma off, by the channels' mean. Null data gives no row."""
    gray = luma_gray if luma else mean_gray

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                x = gray(raster(r["data"], r["width"], r["height"], r["n_channels"], r["bits_per_sample"]))
                h, w = x.shape
                rows = (np.full(x.size, r["image_id"]), np.full(x.size, w, np.int32), np.full(x.size, h, np.int32), np.repeat(np.arange(h, dtype=np.int32), w), np.tile(np.arange(w, dtype=np.int32), h), x.reshape(-1).astype(np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in rows], names=["image_id", "width", "height", "y", "x", "value"])

    known = images.where("data is not null")
    return known.select("image_id", "width", "height", "n_channels", "bits_per_sample", "data").mapInArrow(spread, PIXELS)


# ---------------------------------------------------------------- windows


def along(pixels: DataFrame, line: str, at: str, value: str, out: str, half: Column) -> DataFrame:
    """pixels with out_sum and out_n: sum and number of the values up to `half` places before and after, along a line. half
    reads width and height. A running sum, kept as the line's array, is looked up at both ends of the window."""
    run = pixels.withColumn("run", F.sum(F.col(value).cast("long")).over(Window.partitionBy("image_id", line).orderBy(at)))
    carried = [c for c in pixels.columns if c not in ("image_id", line, "width", "height", at)]
    lines = run.groupBy("image_id", line, "width", "height").agg(F.array_sort(F.collect_list(F.struct(at, "run", *carried))).alias("cells")).withColumn("half", half)

    def cell(c: Column, i: Column) -> Column:
        last, before = F.least(i + F.col("half"), F.size("cells") - 1), i - F.col("half") - 1
        total = F.get("cells", last)["run"] - F.when(before >= 0, F.get("cells", before)["run"]).otherwise(0)
        return F.struct(c[at].alias(at), *(c[k].alias(k) for k in carried), total.alias(f"{out}_sum"), (last - F.greatest(before, F.lit(-1))).alias(f"{out}_n"))

    return lines.select("image_id", line, "width", "height", F.inline(F.transform("cells", cell)))


def box_means(pixels: DataFrame, half: Column) -> DataFrame:
    """pixels with mean: the whole part of the mean of the window that reaches `half` pixels to each side, inside the image."""
    rows = along(pixels, "y", "x", "value", "row", half)
    both = along(rows, "x", "y", "row_sum", "box", half)
    # A column's rows have as many pixels each as the row's own window.
    return both.select("image_id", "width", "height", "y", "x", "value", F.floor(F.col("box_sum") / (F.col("box_n") * F.col("row_n"))).cast("int").alias("mean"))


def own_half(least: int = 15, share: int = 20) -> Column:
    """I4: half of the window, which is odd, `least` pixels wide or a share of the shorter side."""
    block = F.greatest(F.lit(least), F.floor(F.least("width", "height") / share).cast("int"))
    return F.shiftright(block.bitwiseOR(F.lit(1)), 1)


def adaptive_threshold(pixels: DataFrame, offset: int = 10, half: Column | None = None) -> DataFrame:
    """I4: pixels whose value is 0 where it was darker than the mean about it less offset, else 255."""
    means = box_means(pixels, own_half() if half is None else half)
    return means.select("image_id", "width", "height", "y", "x", F.when(F.col("value") < F.col("mean") - offset, 0).otherwise(255).alias("value"))


def label_regions(pixels: DataFrame, bright: int = 80, share: float = 0.4) -> DataFrame:
    """image_id, x, y, width, height: the bright part, a little inwards; nulls where it is nearly all of the image. values:
    means of channels."""

    def ends(lines: DataFrame, at: str, size: str) -> DataFrame:
        """Of each image, the first and the last line that is bright enough; all lines if none is."""
        enough = F.when(F.col("light") / F.col("of") >= share, F.col(at))
        return lines.groupBy("image_id", "width", "height").agg(F.coalesce(F.min(enough), F.lit(0)).alias(f"{at}_from"), F.coalesce(F.max(enough), F.first(size) - 1).alias(f"{at}_to"))

    light = F.count_if(F.col("value") > bright).alias("light")
    rows = pixels.groupBy("image_id", "width", "height", "y").agg(light).withColumn("of", F.col("width"))
    tall = ends(rows, "y", "height")
    inside = pixels.join(tall.select("image_id", "y_from", "y_to"), "image_id").where("y between y_from and y_to")
    columns = inside.groupBy("image_id", "width", "height", "x", "y_from", "y_to").agg(light).withColumn("of", F.col("y_to") - F.col("y_from") + 1)
    both = ends(columns, "x", "width").join(tall, ["image_id", "width", "height"])
    wide, high = F.col("x_to") - F.col("x_from") + 1, F.col("y_to") - F.col("y_from") + 1
    margin = F.greatest(F.lit(2), F.floor(F.least(wide, high) / 100).cast("int"))
    whole = 1.0 - wide * high / (F.col("width") * F.col("height")) < 0.02
    low = {a: F.least(F.col(f"{a}_from") + margin, F.col(f"{a}_to")) for a in "xy"}
    # The far side keeps at least the near one's new place.
    top = {a: F.greatest(F.col(f"{a}_to") - margin, low[a]) for a in "xy"}
    part = lambda c: F.when(~whole, c)
    return both.select("image_id", part(low["x"]).alias("x"), part(low["y"]).alias("y"), part(top["x"] - low["x"] + 1).alias("width"), part(top["y"] - low["y"] + 1).alias("height"))


# ---------------------------------------------------------------- histograms


def histogram(pixels: DataFrame) -> DataFrame:
    """image_id, bin, n of the bins that hold a pixel."""
    return pixels.where("value is not null").groupBy("image_id", F.col("value").alias("bin")).agg(F.count("*").alias("n"))


def thresholds(bins: DataFrame) -> DataFrame:
    """image_id, threshold: the first bin with the largest variance between the classes up to it and above it, in single
    precision; NO_CLASSES for an image of one value. Bins without a pixel change no class, so they are never first."""
    up_to, whole = Window.partitionBy("image_id").orderBy("bin"), Window.partitionBy("image_id")
    weight = F.col("bin") * F.col("n")
    sums = bins.select("image_id", "bin", F.sum("n").over(up_to).alias("below"), F.sum("n").over(whole).alias("all"), F.sum(weight).over(up_to).alias("s"), F.sum(weight).over(whole).alias("total"))
    n, m = F.col("below").cast("float"), (F.col("all") - F.col("below")).cast("float")
    s, total = F.col("s").cast("float"), F.col("total").cast("float")
    # Spark divides floats as doubles: each quotient is rounded on its own.
    gap = (s / n).cast("float") - ((total - s) / m).cast("float")
    variance = F.when(F.col("below") < F.col("all"), n * m * gap * gap)
    best = sums.withColumn("variance", variance).groupBy("image_id").agg(F.max_by("bin", F.struct("variance", -F.col("bin"))).alias("bin"), F.max("variance").alias("variance"))
    return best.select("image_id", F.when(F.col("variance") > 0, F.col("bin")).otherwise(NO_CLASSES).cast("int").alias("threshold"))


def barcode_contrast(pixels: DataFrame) -> DataFrame:
    """Pixels whose value is 0 below the image's threshold, else 255."""
    known = pixels.join(thresholds(histogram(pixels)), "image_id")
    return known.select("image_id", "width", "height", "y", "x", F.when(F.col("value") < F.col("threshold"), 0).otherwise(255).alias("value"))


def bins_at(bins: DataFrame, shares: dict[str, float]) -> DataFrame:
    """image_id, and for each name the first bin up to which that share of the pixels lies: bin 0 where the share is no
    whole pixel."""
    up_to, whole = Window.partitionBy("image_id").orderBy("bin"), Window.partitionBy("image_id")
    sums = bins.select("image_id", "bin", F.sum("n").over(up_to).alias("below"), F.sum("n").over(whole).alias("all"))
    goal = lambda share: F.floor(F.col("all") * share)
    at = [F.min(F.when(goal(share) == 0, 0).when(F.col("below") >= goal(share), F.col("bin"))).alias(name) for name, share in shares.items()]
    return sums.groupBy("image_id").agg(*at)


def spread(value: Column, low: Column, factor: Column) -> Column:
    """Values from low on by a factor, cut to whole numbers and to 0 to 255."""
    return F.least(F.greatest(((value - low) * factor).cast("int"), F.lit(0)), F.lit(255))


def for_display(pixels: DataFrame) -> DataFrame:
    """Pixels with the values between their 2 and 98 percentiles spread over 0 to 255; a range under 10 is widened by 5
    on both sides. An image whose range is all of 0 to 255 stays. The look-up table has a row for each value of an image."""
    bins = histogram(pixels)
    at = bins_at(bins, {"p_low": 0.02, "p_high": 0.98})
    narrow = F.col("p_high") - F.col("p_low") < 10
    at = at.select("image_id", F.when(narrow, F.greatest(F.lit(0), F.col("p_low") - 5)).otherwise(F.col("p_low")).alias("low"), F.when(narrow, F.least(F.lit(255), F.col("p_high") + 5)).otherwise(F.col("p_high")).alias("high"))
    high = F.when(F.col("high") > F.col("low"), F.col("high")).otherwise(F.col("low") + 1)
    new = F.when((F.col("low") == 0) & (F.col("high") >= 255), F.col("bin")).otherwise(spread(F.col("bin"), F.col("low"), F.lit(255.0) / (high - F.col("low"))))
    table = bins.join(at, "image_id").select("image_id", F.col("bin").alias("value"), new.alias("shown"))
    return pixels.join(table, ["image_id", "value"]).select("image_id", "width", "height", "y", "x", F.col("shown").cast("int").alias("value"))


def eight_bit(pixels: DataFrame, bits: int = 8) -> DataFrame:
    """I1 for one band: images of 8 bits whose pixels (of many, every so many-th) range over 50 or more stay; others are scaled
    from their 0.5 to 99.5 percentiles, or from the least to the largest value where those are less than 10 apart."""
    size = min(1 << bits, 65536)
    scale = size / (1 << bits)
    scaled = F.least((F.col("value") * scale).cast("int"), F.lit(size - 1))
    at = bins_at(histogram(pixels.select("image_id", scaled.alias("value"))), {"p_low": 0.005, "p_high": 0.995}).select("image_id", "p_low", "p_high")
    step = F.greatest(F.lit(1), F.floor(F.col("width") * F.col("height") / 10_000).cast("int"))
    some = F.when((F.col("y") * F.col("width") + F.col("x")) % step == 0, F.col("value"))
    ranges = pixels.groupBy("image_id").agg((F.max(some) - F.min(some)).alias("range"), F.min("value").alias("least"), F.max("value").alias("largest"))
    both = at.join(ranges, "image_id")
    low, high = ((F.col(c) / scale).cast("int") for c in ("p_low", "p_high"))
    near = high - low < 10
    both = both.select("image_id", "range", F.when(near, F.col("least")).otherwise(low).alias("low"), F.when(near, F.col("largest")).otherwise(high).alias("high"))
    factor = F.when(F.col("high") > F.col("low"), F.lit(255.0) / (F.col("high") - F.col("low"))).otherwise(1.0)
    new = spread(F.col("value"), F.col("low"), factor)
    kept = F.when(F.col("range") >= 50, F.col("value")).otherwise(new) if bits <= 8 else new
    return pixels.join(both, "image_id").select("image_id", "width", "height", "y", "x", kept.cast("int").alias("value"))
