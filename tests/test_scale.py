"""Numbering in a global order, vocabularies of many files, the grid of boxes: against plain Python; plans."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from labelloom.operators import blocks as B
from labelloom.operators.numbering import numbered
from labelloom.sources.vocabulary import read_vocabularies, read_vocabulary

BLOCK = "image_id long, block_idx long, type string, text string, confidence float, box struct<x int, y int, width int, height int>"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("ranges", [1, 3, 50])
def test_numbers_follow_the_order(spark, ranges):
    r = random.Random(2)
    rows = [(r.choice([None, "a", "b", "é", "zz" * r.randint(1, 5)]), r.choice([None, *range(30)]), i) for i in range(700)] + [("hot", 5, 1000 + i) for i in range(400)]
    df = spark.createDataFrame(rows, "s string, n int, i long").repartition(5)
    out = numbered(df, ["s", "n", "i"], "place", 0, ranges)
    key = lambda x: tuple((v is not None, v if v is not None else 0) for v in x)
    assert [tuple(x)[:3] for x in out.orderBy("place").collect()] == sorted(rows, key=key)
    assert sorted(x["place"] for x in out.collect()) == list(range(len(rows)))
    assert (ranges == 1 or "SinglePartition" not in plan(out)) and out.columns == ["s", "n", "i", "place"]
    assert numbered(df.limit(0), ["s"], "place").collect() == []


def test_ties_and_one_value(spark):
    df = spark.range(100).select(F.lit("x").alias("v"))
    assert sorted(r["k"] for r in numbered(df, ["v"], "k").collect()) == list(range(1, 101))


def test_vocabularies_of_many_files(spark, tmp_path):
    (tmp_path / "more").mkdir()
    texts = {"a.csv": 'Sample,Note\n"PBS, 1",x\n PBS_002 ,y\n\n,z\n', "b.txt": "\n\nPBS_001\tfoo\r\nPBS_002", "more/c.tsv": "code\tx\nA\tb\rB\tc\n", "d": "one, two\nthree"}
    for name, text in texts.items():
        (tmp_path / name).write_text(text, newline="")
    found = {}
    for row in read_vocabularies(spark, str(tmp_path)).orderBy("file", "vocab_idx").collect():
        found.setdefault(row["file"].rpartition("/")[2], []).append((row["vocab_idx"], row["value"]))
    assert found == {"a.csv": [(0, "PBS, 1"), (1, "PBS_002"), (2, ",z")], "b.txt": [(0, "PBS_001"), (1, "PBS_002")], "c.tsv": [(0, "A"), (1, "B")], "d": [(0, "one, two"), (1, "three")]}
    assert [tuple(r) for r in read_vocabulary(spark, str(tmp_path / "a.csv")).orderBy("vocab_idx").collect()] == found["a.csv"]


def brute_pairs(boxes):
    out = set()
    for i, a in enumerate(boxes):
        for j in range(i + 1, len(boxes)):
            b = boxes[j]
            if a[0] < b[0] + b[2] and b[0] < a[0] + a[2] and a[1] < b[1] + b[3] and b[1] < a[1] + a[3]:
                out.add((i, j))
    return out


def some_boxes(n, seed, spread=300):
    r = random.Random(seed)
    side = lambda: r.choice([0, 1, 2, 3, 7, 8, 16, 33, 64, 200])
    return [(r.randint(-40, spread), r.randint(-40, spread), side(), side()) for _ in range(n)]


def test_grid_finds_all_pairs(spark):
    images = {k: some_boxes(n, k) for k, n in ((1, 120), (2, 1), (3, 60))}
    images[4] = [(5, 5, 10, 10)] * 20 + [(15, 5, 10, 10), (-3, -3, -2, 4)]
    rows = [(k, i, "LINE", "t", 0.5, b) for k, boxes in images.items() for i, b in enumerate(boxes)] + [(1, 999, "LINE", "t", 0.5, None)]
    found = B.overlapping_pairs(spark.createDataFrame(rows, BLOCK).repartition(3))
    got = [(r["image_id"], r["i"], r["j"]) for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == {(k, i, j) for k, boxes in images.items() for i, j in brute_pairs(boxes)}


def test_one_image_of_many_boxes(spark):
    """Compared rows follow the overlaps: 20,000 boxes of one image, beside one that holds all of them."""
    rows = spark.range(20_000).select(F.lit(1).cast("long").alias("image_id"), F.col("id").alias("block_idx"), F.struct((F.col("id") % 200 * 50).cast("int").alias("x"), (F.floor(F.col("id") / 200) * 50).cast("int").alias("y"), F.lit(60).alias("width"), F.lit(30).alias("height")).alias("box"))
    whole = spark.range(1).select(F.lit(1).cast("long"), F.lit(20_000).cast("long"), F.struct(F.lit(0), F.lit(0), F.lit(20_000), F.lit(20_000)))
    began = time.time()
    assert B.overlapping_pairs(rows.union(whole)).count() == 100 * 199 + 20_000
    assert time.time() - began < 60


def test_walk_over_a_grid_is_the_walk_over_all_pairs():
    r = random.Random(6)
    boxes = some_boxes(400, 8, spread=150)
    sure = [r.choice([0.1, 0.5, 0.5, 0.9]) for _ in boxes]
    every, near = B.later_ones(boxes, few=1000), B.later_ones(boxes, few=0)
    assert all(a.tolist() == b.tolist() for a, b in zip(every, near))
    assert B.dedupe_order(boxes, sure) and B.dedupe_order([], []) == []


def test_a_hundred_thousand_boxes():
    n = 100_000
    boxes = [(i % 500 * 40, i // 500 * 25, 44, 20) for i in range(n)]
    began = time.time()
    kept = B.dedupe_order(boxes + boxes[:1000], list(np.r_[np.full(n, 0.5), np.full(1000, 0.9)]))
    assert len(kept) == n and kept[0] == n and time.time() - began < 60
