"""Bounding boxes as struct<x int, y int, width int, height int> columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BOX = "struct<x int, y int, width int, height int>"


def box(x: Column, y: Column, width: Column, height: Column) -> Column:
    return F.struct(x.cast("int").alias("x"), y.cast("int").alias("y"), width.cast("int").alias("width"), height.cast("int").alias("height"))


def checked_box(x: Column, y: Column, width: Column, height: Column) -> Column:
    """Fails on a negative side."""
    return F.when((width < 0) | (height < 0), F.raise_error(F.lit("a box's sides can't be negative")).cast(BOX)).otherwise(box(x, y, width, height))


def right(b: Column) -> Column:
    return b["x"] + b["width"]


def bottom(b: Column) -> Column:
    return b["y"] + b["height"]


def center_x(b: Column) -> Column:
    return b["x"] + b["width"] / F.lit(2.0)


def center_y(b: Column) -> Column:
    return b["y"] + b["height"] / F.lit(2.0)


def area(b: Column) -> Column:
    """G1, in 64 bits: large boxes don't overflow."""
    return b["width"].cast("long") * b["height"].cast("long")


def contains(b: Column, px: Column, py: Column) -> Column:
    """Left and top edges belong to the box, right and bottom ones don't."""
    return (px >= b["x"]) & (px < right(b)) & (py >= b["y"]) & (py < bottom(b))


def intersects(a: Column, b: Column) -> Column:
    """Touching edges don't intersect."""
    return (a["x"] < right(b)) & (b["x"] < right(a)) & (a["y"] < bottom(b)) & (b["y"] < bottom(a))


def offset(b: Column, dx: Column | int, dy: Column | int) -> Column:
    return box(b["x"] + dx, b["y"] + dy, b["width"], b["height"])


def expand(b: Column, margin: Column | int) -> Column:
    """On all sides; fails if a side gets negative."""
    return checked_box(b["x"] - margin, b["y"] - margin, b["width"] + 2 * margin, b["height"] + 2 * margin)


def union(a: Column, b: Column) -> Column:
    """G5; a null box leaves the other."""
    x, y = F.least(a["x"], b["x"]), F.least(a["y"], b["y"])
    both = box(x, y, F.greatest(right(a), right(b)) - x, F.greatest(bottom(a), bottom(b)) - y)
    return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(both)


def overlap_area(a: Column, b: Column) -> Column:
    """0 where they don't intersect."""
    w = F.least(right(a), right(b)) - F.greatest(a["x"], b["x"])
    h = F.least(bottom(a), bottom(b)) - F.greatest(a["y"], b["y"])
    return F.greatest(w, F.lit(0)).cast("long") * F.greatest(h, F.lit(0)).cast("long")


def same_place(a: Column, b: Column) -> Column:
    """The overlap is more than half of the smaller box."""
    smaller = F.least(area(a), area(b))
    return intersects(a, b) & (smaller > 0) & (overlap_area(a, b) > smaller * F.lit(0.5))


def scaled_box(nx: Column, ny: Column, nw: Column, nh: Column, image_width: Column, image_height: Column, dilation: Column) -> Column:
    """A box in shares of the image, dilated about its centre, in pixels. Moving x or y to 0 leaves the sides."""
    w, h = nw * dilation, nh * dilation
    x = F.greatest(F.lit(0.0), (nx + nw / 2 - w / 2) * image_width)
    y = F.greatest(F.lit(0.0), (ny + nh / 2 - h / 2) * image_height)
    return box(x, y, F.least(w * image_width, image_width - x), F.least(h * image_height, image_height - y))


def effective_dilation(region_type: Column, dilation: Column, least: float = 2.5) -> Column:
    """Barcodes need their quiet zones."""
    return F.when(region_type.isin("BARCODE", "AUTO"), F.greatest(dilation, F.lit(least))).otherwise(dilation)


def clamped(b: Column, image_width: Column, image_height: Column) -> Column:
    """Inside the image; null where nothing is left (the caller takes the whole image, or an error)."""
    x, y = F.greatest(b["x"], F.lit(0)), F.greatest(b["y"], F.lit(0))
    w, h = F.least(b["width"], image_width - x), F.least(b["height"], image_height - y)
    return F.when((w > 0) & (h > 0), box(x, y, w, h))


def clamped_or_whole(b: Column, image_width: Column, image_height: Column) -> Column:
    return F.coalesce(clamped(b, image_width, image_height), box(F.lit(0), F.lit(0), image_width, image_height))


def normalized(b: Column, image_width: Column, image_height: Column) -> Column:
    """struct<nx, ny, nw, nh> in shares of the image."""
    w, h = image_width.cast("double"), image_height.cast("double")
    return F.struct((b["x"] / w).alias("nx"), (b["y"] / h).alias("ny"), (b["width"] / w).alias("nw"), (b["height"] / h).alias("nh"))


def box_of_points(points: Column) -> Column:
    """Of an array of struct<x, y>; null points are left out, no points give null."""
    known = F.filter(points, lambda p: p.isNotNull())
    at = lambda f, c: f(F.transform(known, lambda p: p[c]))
    x, y = at(F.array_min, "x").cast("int"), at(F.array_min, "y").cast("int")
    return F.when(F.size(known) > 0, box(x, y, at(F.array_max, "x").cast("int") - x, at(F.array_max, "y").cast("int") - y))


def unscaled(b: Column, scale: int, dx: Column | int = 0, dy: Column | int = 0) -> Column:
    """A box found in an image scaled up and cut out at (dx, dy), in the whole image."""
    part = lambda c: F.floor(c / scale)
    return box(part(b["x"]) + dx, part(b["y"]) + dy, part(b["width"]), part(b["height"]))


def quadrants(image_width: Column, image_height: Column, least_side: int = 300, least_tile: int = 50) -> Column:
    """Array of four tiles, each half of the image and a quarter more; empty for images that aren't larger than
    least_side on both sides."""
    w, h = F.floor(image_width / 2), F.floor(image_height / 2)
    over_w, over_h = F.floor(image_width / 4), F.floor(image_height / 4)
    tiles = []
    for lower in (False, True):
        for second in (False, True):
            x, y = (w - over_w if second else F.lit(0)), (h - over_h if lower else F.lit(0))
            side = (image_width - w if second else w) + over_w, (image_height - h if lower else h) + over_h
            tiles.append(box(x, y, F.least(side[0], image_width - x), F.least(side[1], image_height - y)))
    large = (image_width > least_side) & (image_height > least_side)
    none = F.array().cast(f"array<{BOX}>")
    return F.when(large, F.filter(F.array(*tiles), lambda t: (t["width"] >= least_tile) & (t["height"] >= least_tile))).otherwise(none)


def selected_box(x0: Column, y0: Column, x1: Column, y1: Column, shown_width: Column, shown_height: Column, image_width: Column, image_height: Column, least_side: int = 5) -> Column:
    """Two corners on a shown image, in the image's own pixels; null for a side under least_side."""
    scale = F.least(shown_width / image_width.cast("double"), shown_height / image_height.cast("double"))
    x, y = (F.greatest(F.lit(0.0), F.least(a, b) / scale).cast("int") for a, b in ((x0, x1), (y0, y1)))
    w = F.least((image_width - x).cast("double"), F.abs(x1 - x0) / scale).cast("int")
    h = F.least((image_height - y).cast("double"), F.abs(y1 - y0) / scale).cast("int")
    return F.when((w >= least_side) & (h >= least_side), box(x, y, w, h))
