"""Linear barcodes: what is drawn is read; spoilt ones aren't; hints, directions, retries and plans."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from labelloom.functions import barcodes as C
from labelloom.operators import linear
from labelloom.operators import template as P
from labelloom.operators.decode import decode_regions, decode_with_retry
from labelloom.operators.images import IMAGE
from labelloom.operators.images import otsu_threshold, upscale
from labelloom.operators.linear import LinearDecoder, drawn, raster_of
from labelloom.plans.pipeline import label_metadata, read_fields, read_labels, scan_full_image


def texts_of(form, n, seed=0):
    r = random.Random(seed)
    for _ in range(n):
        if form == "EAN_13":
            d = "".join(r.choice("0123456789") for _ in range(12))
            yield d + str(C.ean_check(d))
        elif form == "CODE_39":
            yield "".join(r.choice([c for c in C.code_39() if c != "*"]) for _ in range(r.randint(1, 20)))
        else:
            yield "".join(r.choice(["0123", "42", "A", "b", "~", " ", "#", "\t", "\x1f", "Z", "9", "`"]) for _ in range(r.randint(1, 12)))


def test_tables():
    assert len(C.CODE_128) == 106 and len(set(C.CODE_128)) == 106
    assert all(sum(map(int, x)) == 11 and sum(map(int, x[::2])) % 2 == 0 for x in C.CODE_128)
    assert len(C.code_39()) == 44 == len(set(C.code_39().values())) and all(sum(x) == 3 for x in C.code_39().values())
    digits = C.ean_digits()
    assert all(len(t) == 10 and all(sum(w) == 7 and len(w) == 4 for w in t) for t in digits.values()) and not set(digits["L"]) & set(digits["G"])
    assert C.ean_check("400638133393") == 1 and C.ean_check("978030640615") == 7
    assert "".join("nw"[x] for x in C.code_39()["*"]) == "nwnnwnwnn" and "".join("nw"[x] for x in C.code_39()["%"]) == "nnnwnwnwn"
    assert C.code_128_check([C.START_A, *(ord(c) - 32 for c in "PJJ123C")]) == 54


@pytest.mark.parametrize("form", C.FORMATS)
def test_drawn_is_read(form):
    decoder = LinearDecoder()
    for k, text in enumerate(texts_of(form, 60)):
        image = raster_of(C.DRAW[form](text), module=1 + k % 4)
        found = decoder.read_barcodes(image)
        assert [(x.text, x.format) for x in found] == [(text, form)]
        x, y, w, h = found[0].box
        assert x == 10 * (1 + k % 4) and x + w == image.shape[1] - x and 0 < h <= 20
        assert [x.text for x in decoder.read_barcodes(image[:, ::-1])] == [text] == [x.text for x in decoder.read_barcodes(image.T)]
        assert [x.text for x in decode_with_retry(decoder, 255 - image)] == [text]  # light on dark: the second attempt


@pytest.mark.parametrize("form", C.FORMATS)
def test_noise_and_blur(form):
    r = np.random.default_rng(3)
    for text in texts_of(form, 15, seed=4):
        image = raster_of(C.DRAW[form](text), module=4).astype(float)
        blurred = (np.roll(image, 1, axis=1) + image + np.roll(image, -1, axis=1)) / 3
        noisy = np.clip(blurred * 0.6 + 40 + r.normal(0, 8, image.shape), 0, 255).astype(np.uint8)
        assert [x.text for x in LinearDecoder().read_barcodes(noisy)] == [text]


def test_spoilt_ones_are_not_read():
    decoder = LinearDecoder()
    for form in ("EAN_13", "CODE_128"):
        for text in texts_of(form, 20, seed=9):
            widths = C.DRAW[form](text)
            at = len(widths) // 2 // 2 * 2 + 5
            widths[at], widths[at + 1] = widths[at + 1] + 1, max(1, widths[at] - 1)
            assert text not in [x.text for x in decoder.read_barcodes(raster_of(widths))] or widths == C.DRAW[form](text)
    cut = raster_of(C.draw_code_128("hello world"))
    assert decoder.read_barcodes(cut[:, :120]) == [] == decoder.read_barcodes(cut[:, 24:])  # no stop; no light before the start
    for empty in (np.zeros((0, 5), np.uint8), np.full((9, 9), 7, np.uint8), np.zeros((1, 1), np.uint8)):
        assert decoder.read_barcodes(empty) == []


def test_hints():
    image = raster_of(C.draw_ean_13("400638133393"))
    assert LinearDecoder(["CODE_39", "CODE_128"]).read_barcodes(image) == [] and LinearDecoder(["EAN_13"]).read_barcodes(image)[0].text == "4006381333931"
    assert LinearDecoder(try_harder=False).read_barcodes(image.T) == []
    with pytest.raises(ValueError, match="QR"):
        LinearDecoder(["QR"])


def two_codes():
    one, two = raster_of(C.draw_code_39("CASE-1")), raster_of(C.draw_code_128("Block 7"))
    return np.concatenate([one, np.full((20, 30), 255, np.uint8), two], axis=1)


def test_several_on_a_line():
    assert [(x.text, x.format) for x in LinearDecoder().read_barcodes(two_codes())] == [("CASE-1", "CODE_39"), ("Block 7", "CODE_128")]


@pytest.fixture(scope="module")
def images(spark):
    a, b = two_codes(), raster_of(C.draw_ean_13("978030640615"))
    rows = [(i, x.shape[1], x.shape[0], 1, 8, bytearray(x.tobytes())) for i, x in ((1, a), (2, b))]
    return spark.createDataFrame([*rows, (3, 4, 4, 1, 8, bytearray(b"ab"))], IMAGE).repartition(2)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_regions_in_place(spark, images, tmp_path):
    w = two_codes().shape[1]
    cut = raster_of(C.draw_code_39("CASE-1")).shape[1] / w
    template = P.Template(mappings=(P.FieldMapping(0, "Case", None, True, 0.0, 0.0, cut, 1.0, True, "BARCODE"), P.FieldMapping(1, "Block", None, True, cut, 0.0, 1 - cut, 1.0, True, "BARCODE"), P.FieldMapping(2, "Off", None, False, 0.0, 0.0, 1.0, 1.0, True, "BARCODE"), P.FieldMapping(3, "Tiny", None, True, 0.0, 0.0, 0.001, 0.001, True, "BARCODE")), dilation=1.0)
    images.write.parquet(f"{tmp_path}/images")
    stored = spark.read.parquet(f"{tmp_path}/images")
    found = read_fields(stored, template, LinearDecoder)
    assert "Exchange" not in plan(found).replace("BroadcastExchange", "") and "Exchange" not in plan(read_labels(stored, LinearDecoder))
    rows = {(r["image_id"], r["metadata_key"]): r["text"] for r in found.where("success").collect()}
    assert "CASE-1" in rows[1, "Case"] and "Block 7" in rows[1, "Block"] and not any(k in ("Off", "Tiny") for _, k in rows)
    # The same as the table of regions gives.
    regions = P.template_regions(images, template.fields(spark), template.dilation)
    columns = ["image_id", "field_index", "text", "box", "source_type", "format", "success", "error"]
    table = decode_regions(images, regions.select("image_id", "field_index", "region_type", "box"), LinearDecoder).select(*columns)
    assert sorted(map(str, table.collect())) == sorted(map(str, found.select(*columns).collect()))


def test_large_templates(spark, images):
    many = P.Template(mappings=tuple(P.FieldMapping(i, f"k{i}", None, True, 0.0, 0.0, 1.0, 1.0, True, "TEXT") for i in range(P.MOST_FIELDS + 5)))
    assert many.enabled_count() == P.MOST_FIELDS + 5
    one = images.where("image_id = 2")
    assert one.select(F.size(P.region_array(many, F.col("width"), F.col("height")))).first()[0] == P.MOST_FIELDS + 5
    assert P.template_regions(one, many.fields(spark)).count() == P.MOST_FIELDS + 5


def test_entries(images):
    codes = {r["image_id"]: r for r in read_labels(images, LinearDecoder, kind="BARCODE").collect()}
    assert codes[1]["text"] == "CASE-1;Block 7" and codes[1]["format"] == "MULTIPLE" and codes[2]["text"] == "9780306406157" and codes[2]["format"] == "EAN_13" and not codes[3]["success"]
    right = F.struct((F.col("width") / 2).cast("int").alias("x"), F.lit(0).alias("y"), F.col("width").alias("width"), F.col("height").alias("height"))
    part = {r["image_id"]: r["text"] for r in read_labels(images, LinearDecoder, kind="BARCODE", box=right).collect()}
    assert part[1] == "Block 7" and part[2] == ""
    scanned = scan_full_image(images, LinearDecoder)
    assert plan(scanned).count("MapInPandas") == 1
    assert sorted((r["image_id"], r["source_rank"], r["source_type"], r["success"]) for r in scanned.collect()) == [(1, 0, "BARCODE", True), (1, 1, "TEXT", True), (2, 0, "BARCODE", True), (2, 1, "TEXT", True), (3, 1, "TEXT", False)]


def test_read_and_write_in_one_call(spark, images):
    entries = spark.createDataFrame([(1, {"a": "b"}), (2, {}), (3, {}), (4, {"c": "d"})], "image_id long, metadata map<string,string>")
    rows = {r["image_id"]: (r["metadata"], r["applied"]) for r in label_metadata(entries, images, LinearDecoder, "OCR_code", "BARCODE").collect()}
    assert rows == {1: ({"a": "b", "OCR_code": "CASE-1;Block 7"}, 1), 2: ({"OCR_code": "9780306406157"}, 1), 3: ({}, 0), 4: ({"c": "d"}, 0)}
    assert {r["applied"] for r in label_metadata(entries, images, LinearDecoder, "9 bad", "BARCODE").collect()} == {0}


def test_symbols_looked_up():
    """A symbol found by its rounded widths is the one that a comparison with all of them finds."""
    r = np.random.default_rng(2)
    rows = np.array([[int(w) for w in x] for x in C.CODE_128])
    table = linear.Table(rows.tolist(), 11)
    found = 0
    for _ in range(4000):
        widths = np.maximum(1, np.rint(rows[r.integers(len(rows))] * r.uniform(1, 6) + r.normal(0, r.choice([0.1, 1, 2]), 6))).astype(int)
        off = np.abs(widths * (11 / widths.sum()) - rows)
        best = int(off.sum(axis=1).argmin())
        expected = best if off[best].mean() <= linear.MEAN_OFF and off[best].max() <= linear.MOST_OFF else None
        assert table.nearest(widths.tolist()) == expected
        found += expected is not None
    assert 1000 < found < 4000


def test_drawn_in_many_tasks(spark):
    """Rows of one file, or of one task, are drawn and read by as many tasks as the shuffle has."""
    rows = spark.createDataFrame([(i, f"CASE-{i}", "CODE_39", 2, False, False) for i in range(200)], "image_id long, text string, format string, module int, turned boolean, inverted boolean").coalesce(1)
    assert rows.rdd.getNumPartitions() == 1
    found = read_labels(drawn(rows), LinearDecoder, kind="BARCODE").select("image_id", "text", F.spark_partition_id().alias("task")).collect()
    assert sorted((r["image_id"], r["text"]) for r in found) == [(i, f"CASE-{i}") for i in range(200)]
    tasks = [r["task"] for r in found]
    assert len(set(tasks)) == 4 and max(map(tasks.count, set(tasks))) < 100


def test_threshold_of_occupied_bins():
    """The same as with all bins looked at, for few values as for many, large counts included."""
    r = np.random.default_rng(5)
    for k in range(3000):
        counts = np.zeros(256, np.int64)
        at = r.choice(256, [0, 1, 2, 2, 3, 20, 256][k % 7], replace=False)
        counts[at] = r.integers(1, [2, 50, 10**6, 10**8][k % 4], len(at))
        below = np.cumsum(counts)
        above = below[-1] - below
        sums = np.cumsum((np.arange(256) * counts).astype(np.float32), dtype=np.float32)
        inside = (below > 0) & (above > 0)
        n, m, s = below[inside].astype(np.float32), above[inside].astype(np.float32), sums[inside]
        gap = s / n - (sums[-1] - s) / m
        variance = n * m * gap * gap
        assert otsu_threshold(counts) == (int(np.flatnonzero(inside)[variance.argmax()]) if len(variance) and variance.max() > 0 else 128)


def test_equal_rows_scaled_once():
    """An image of equal rows is scaled as it is beside other rows."""
    r = np.random.default_rng(6)
    for k in range(40):
        row = r.integers(0, 2, (1, 60)) * 255 if k % 2 else r.integers(0, 256, (1, 60))
        x = np.repeat(row, 12, axis=0).astype(np.uint8)
        for factor in (2, 3):
            other = np.concatenate([x, 255 - x[:1]])  # its last row reaches the two above it alone
            assert (upscale(x, factor)[: 9 * factor] == upscale(other, factor)[: 9 * factor]).all()
            assert upscale(x, factor).shape == (12 * factor, 60 * factor)


def test_decoder_keeps_no_mistakes():
    """One decoder over many images, turned, light on dark and cut, reads what a new one reads."""
    one = LinearDecoder()
    for form in C.FORMATS:
        for k, text in enumerate(texts_of(form, 12, seed=len(form))):
            image = raster_of(C.DRAW[form](text), module=1 + k % 3)
            for x in (image, image[:, ::-1], image.T, 255 - image, image[:, : image.shape[1] // 2], np.concatenate([image, 255 - image])):
                assert decode_with_retry(one, np.ascontiguousarray(x)) == decode_with_retry(LinearDecoder(), np.ascontiguousarray(x))
