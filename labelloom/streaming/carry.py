"""An extension: keys carried over from the previous image of a group (W3, J5), over a stream of images.

Images are rows of group, at (long: their place in the group's order), image_id, width, height and fields, an array of
field_index, metadata_key and box. A group's state is its last image that had a field: its place, its size, and those of
its fields that have a box and a key. Any split of the rows into micro-batches gives the rows of the batch operators
(fields.previous_images with a group, fields.carry_over_keys), as long as no image comes after a later one of its group. One
that does is late: its keys stay as they are, and it isn't remembered. Where idle_minutes is
given, a group without images for as long is forgotten, and its next image begins anew; Spark then runs empty micro-batches
to look at the clock, so a query that should end (availableNow) must go without. A micro-batch's rows of one group are sorted in one task: watch_images bounds
what a micro-batch reads.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

FIELDS = "array<struct<field_index int, metadata_key string, box struct<x int, y int, width int, height int>>>"
OUT = "group string, image_id long, field_index int, metadata_key string, late boolean"
#: previous: JSON of width, height and rows of x, y, width, height, key; null before the first image with a field.
STATE = "at long, previous string"
SIDES = ("x", "y", "width", "height")


def remembered(width: int, height: int, fields: Iterable[dict[str, Any]]) -> str:
    kept = [[*(f["box"][s] for s in SIDES), f["metadata_key"]] for f in sorted(fields, key=lambda f: f["field_index"]) if f["box"] is not None and f["metadata_key"]]
    return json.dumps([width, height, kept])


def carried_keys(width: int, height: int, fields: list[dict[str, Any]], previous: str | None) -> list[str | None]:
    """J5 for one image: of each field, the key of the first earlier field whose centre lies in its box, else its own."""
    own = [f["metadata_key"] for f in fields]
    old_width, old_height, old = json.loads(previous) if previous else (1, 1, [])
    if not old:
        return own
    x, y, w, h = np.array([o[:4] for o in old], float).T
    cx, cy = (x + w / 2.0) / old_width, (y + h / 2.0) / old_height
    for i, f in enumerate(fields):
        if f["box"] is not None:
            left, top, wide, high = (float(f["box"][s]) / n for s, n in zip(SIDES, (width, height, width, height)))
            inside = np.flatnonzero((cx >= left) & (cx <= left + wide) & (cy >= top) & (cy <= top + high))
            if len(inside):
                own[i] = old[inside[0]][4]
    return own


def carry_group(key: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: GroupState, idle: int | None) -> Iterator[pd.DataFrame]:
    if state.hasTimedOut:
        state.remove()
        return
    at, previous = state.get if state.exists else (None, None)
    rows = sorted((r for batch in batches for r in batch.to_dict("records")), key=lambda r: (r["at"], r["image_id"]))
    newest = at
    out: list[tuple[Any, ...]] = []
    for r in rows:
        fields = list(r["fields"]) if r["fields"] is not None else []
        late = at is not None and r["at"] <= at
        keys = [f["metadata_key"] for f in fields] if late else carried_keys(r["width"], r["height"], fields, previous)
        out += [(key[0], r["image_id"], f["field_index"], k, late) for f, k in zip(fields, keys)]
        if not late:
            newest = r["at"]
            previous = remembered(r["width"], r["height"], fields) if fields else previous
    state.update((newest, previous))
    if idle:
        state.setTimeoutDuration(idle)
    yield pd.DataFrame(out, columns=["group", "image_id", "field_index", "metadata_key", "late"])


def carry_stream(images: DataFrame, idle_minutes: int | None = None) -> DataFrame:
    """group, image_id, field_index, metadata_key (carried), late: a row for each field of the stream's images. A null group
    is a group; images without a place (null at) are left out, having no previous image."""
    rows = images.where("at is not null").select(F.col("group").cast("string").alias("group"), F.col("at").cast("long").alias("at"), F.col("image_id").cast("long").alias("image_id"), F.col("width").cast("int").alias("width"), F.col("height").cast("int").alias("height"), F.col("fields").cast(FIELDS).alias("fields"))
    idle = idle_minutes and 60_000 * idle_minutes
    return rows.groupBy("group").applyInPandasWithState(lambda key, batches, state: carry_group(key, batches, state, idle), OUT, STATE, "append", GroupStateTimeout.ProcessingTimeTimeout if idle else GroupStateTimeout.NoTimeout)
