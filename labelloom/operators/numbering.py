"""Numbering rows in a global order without gathering them in one task.

The order is cut into ranges at bounds taken from a sample of its keys. A row's range follows from its keys alone, so it is
the same whenever a lost task is run again; rows are ranked inside their range, and ranges begin after the rows of those before,
whose counts are one small table. The result doesn't depend on the sample, only the evenness of the ranges does. Rows that are
equal in all keys stand in any order, within one range: give a key that tells them apart where that matters.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Sampled keys for each range, and rows for which another range is worth its while.
SAMPLED = 20
RANGE_ROWS = 100_000


def range_of(keys: Sequence[str], bounds: list[tuple], df: DataFrame) -> Column:
    """How many of the bounds are not after the row's keys; nulls come first."""
    kinds = dict(df.dtypes)
    if not bounds:
        return F.lit(0)
    table = df.sparkSession.createDataFrame(bounds, ", ".join(f"k{i} {kinds[k]}" for i, k in enumerate(keys)))
    literal = F.from_json(F.lit("[" + ",".join(table.toJSON().collect()) + "]"), "array<struct<" + ", ".join(f"k{i}: {kinds[k]}" for i, k in enumerate(keys)) + ">>")
    own = F.struct(*(F.col(k).alias(f"k{i}") for i, k in enumerate(keys)))
    return F.size(F.filter(literal, lambda b: b <= own))


def numbered(rows: DataFrame, keys: Sequence[str], name: str, start: int = 1, ranges: int | None = None) -> DataFrame:
    """rows with a column `name`: their place in the ascending order of keys (columns of numbers, strings or dates), from start
    on. An empty table gives an empty one."""
    only = rows.select(*keys)
    count = only.count()
    n = ranges or min(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-count // RANGE_ROWS))
    share = min(1.0, SAMPLED * n / max(1, count))
    some = [tuple(r) for r in (only if share == 1.0 else only.sample(False, share, 7)).orderBy(*keys).limit(4 * SAMPLED * n).collect()] if n > 1 and count else []
    bounds = list(dict.fromkeys(some[i * len(some) // n] for i in range(1, n))) if some else []
    part, rank, before = (f"_{name}_{x}" for x in ("range", "rank", "before"))
    placed = rows.withColumn(part, range_of(keys, bounds, rows))
    held = {r[part]: r["count"] for r in placed.groupBy(part).count().collect()} if bounds else {0: count}  # a row for each range
    starts = [(k, start - 1 + sum(v for j, v in held.items() if j < k)) for k in sorted(held)]
    offsets = rows.sparkSession.createDataFrame(starts, f"{part} int, {before} long")
    ranked = placed.withColumn(rank, F.row_number().over(Window.partitionBy(part).orderBy(*keys)))
    return ranked.join(F.broadcast(offsets), part).withColumn(name, F.col(before) + F.col(rank)).drop(part, rank, before)
