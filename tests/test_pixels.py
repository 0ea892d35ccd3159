"""The long table of pixels against the numpy steps: windows, label regions, thresholds, look-up tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from labelloom.operators import images as I
from labelloom.operators import pixels as P

r = np.random.default_rng(7)
IMAGES = {
    1: r.integers(0, 256, (9, 13)),
    2: np.full((5, 4), 77),
    3: np.tile([10, 200], (6, 5)),
    4: r.integers(120, 140, (31, 17)),
    5: np.pad(np.full((20, 30), 220), 12, constant_values=15),
    6: np.array([[3]]),
    7: r.integers(0, 256, (1, 40)),
    8: np.repeat(np.arange(16) * 16, 8).reshape(16, 8),
    9: np.full((3, 3), 255),
    10: np.r_[np.zeros(50), np.full(50, 255)].reshape(10, 10).astype(int),
}


@pytest.fixture(scope="module")
def pixels(spark):
    rows = [(i, x.shape[1], x.shape[0], y, c, int(v)) for i, x in IMAGES.items() for y, line in enumerate(x) for c, v in enumerate(line)]
    return spark.createDataFrame(rows, P.PIXELS).repartition(3)


def arrays(df, name="value"):
    out = {i: np.full(x.shape, -1) for i, x in IMAGES.items()}
    for row in df.collect():
        assert out[row["image_id"]][row["y"], row["x"]] == -1
        out[row["image_id"]][row["y"], row["x"]] = row[name]
    return out


def same(found, step):
    for i, x in IMAGES.items():
        assert found[i].tolist() == np.asarray(step(x.astype(np.uint8))).astype(int).tolist(), i


@pytest.mark.parametrize("half", [0, 1, 4, 100])
def test_box_means(pixels, half):
    def step(x):
        h, w = x.shape
        return [[int(x[max(0, y - half) : y + half + 1, max(0, c - half) : c + half + 1].astype(int).mean() + 1e-9) for c in range(w)] for y in range(h)]

    same(arrays(P.box_means(pixels, F.lit(half)), "mean"), step)


def test_adaptive_threshold(spark, pixels):
    same(arrays(P.adaptive_threshold(pixels)), lambda x: I.adaptive_threshold(x.astype(int)))
    large = r.integers(0, 256, (340, 401))  # a window of more than the least
    rows = spark.createDataFrame([(1, 401, 340, 1, 8, bytearray(large.astype(np.uint8).tobytes()))], I.IMAGE)
    found = np.zeros(large.shape, int)
    table = P.adaptive_threshold(P.pixel_rows(rows)).toPandas()
    found[table["y"], table["x"]] = table["value"]
    assert (found == I.adaptive_threshold(large)).all()


def test_label_regions(pixels):
    got = {x["image_id"]: tuple(x)[1:] for x in P.label_regions(pixels).collect()}
    assert got == {i: I.label_region(x.astype(np.uint8)) or (None,) * 4 for i, x in IMAGES.items()}
    assert got[5] == (14, 14, 26, 16)


def test_thresholds(pixels):
    bins = P.histogram(pixels)
    got = {x["image_id"]: x["threshold"] for x in P.thresholds(bins).collect()}
    assert got == {i: I.otsu_threshold(np.bincount(x.reshape(-1), minlength=256)) for i, x in IMAGES.items()}
    assert got[2] == got[6] == P.NO_CLASSES and got[3] == 10
    same(arrays(P.barcode_contrast(pixels)), I.barcode_contrast)


def test_look_up_tables(pixels):
    same(arrays(P.for_display(pixels)), I.for_display)
    same(arrays(P.eight_bit(pixels)), lambda x: (lambda y: y if y.ndim == 2 else y[:, :, 0])(I.to_eight_bit(x)))


def test_sixteen_bits(spark):
    x = r.integers(300, 5000, (20, 21)).astype("<u2")
    rows = spark.createDataFrame([(1, 21, 20, 1, 16, bytearray(x.tobytes())), (2, None, None, None, None, None)], I.IMAGE)
    found = np.zeros(x.shape, int)
    for p in P.eight_bit(P.pixel_rows(rows), 16).collect():
        found[p["y"], p["x"]] = p["value"]
    assert (found == I.to_eight_bit(x, 16)[:, :, 0]).all()


def test_empty_tables(spark):
    none = spark.createDataFrame([], P.PIXELS)
    for f in (P.adaptive_threshold, P.label_regions, P.barcode_contrast, P.for_display, P.eight_bit):
        assert f(none).collect() == []
    nulls = spark.createDataFrame([(1, 1, 1, 0, 0, None)], P.PIXELS)
    assert P.histogram(nulls).count() == 0 == P.thresholds(P.histogram(nulls)).count()


def test_thresholds_of_nearly_equal_variances(spark):
    """Quotients rounded to single precision one by one decide between bins whose variances differ in the last bits."""
    some = np.random.default_rng(5).integers(100, 160, (8000, 64))
    bins = [(i, int(b), int(n)) for i, x in enumerate(some) for b, n in zip(*np.unique(x, return_counts=True))]
    got = {x["image_id"]: x["threshold"] for x in P.thresholds(spark.createDataFrame(bins, "image_id long, bin int, n long")).collect()}
    assert got == {i: I.otsu_threshold(np.bincount(x, minlength=256)) for i, x in enumerate(some)}
