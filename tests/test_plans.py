"""Examples, history, cancelling (S13, W4, W5, R11), and selections."""

from pyspark.sql import functions as F

from labelloom.functions import geometry as G
from labelloom.operators.images import IMAGE, rescaled
from labelloom.operators.template import FIELDS
from labelloom.plans import examples, session


def decoder():
    from labelloom.operators.decode import FixtureDecoder

    return FixtureDecoder()


def test_examples(spark):
    entries = spark.createDataFrame([(1, "VendorX_1", {"a": "b"}), (2, "x_simple_OLD", {})], "image_id long, image_name string, metadata map<string,string>")
    detected = spark.createDataFrame([(1, ["one", "two"])], "image_id long, texts array<string>")
    fields = spark.createDataFrame([(0, "Case", None, True, 0.0, 0.0, 0.0, 0.0, False, "TEXT"), (5, "None", None, True, 0.0, 0.0, 0.0, 0.0, False, "TEXT")], FIELDS)
    by = lambda df: {r["image_id"]: r for r in df.collect()}
    got = by(examples.batch_template(detected, fields, entries))
    assert got[1]["metadata"] == {"a": "b", "Case": "one"} and got[1]["applied"] == 1 and got[2]["metadata"] == {}
    assert by(examples.custom_mapping(detected, entries))[1]["metadata"] == {"a": "b", "OCR_field_0": "one", "OCR_field_1": "two"}
    config = by(examples.conditional(entries))
    assert config[1]["config"]["invert"] and config[2]["config"]["min_confidence"] == 0.3 and config[2]["config"]["page_seg_mode"] == "SINGLE_LINE"
    images = spark.createDataFrame([(1, 2, 2, 1, 8, bytearray(b"abcd"))], IMAGE)
    assert examples.basic(images, decoder).first()["text"] == ""
    assert "def basic" in examples.source("basic") and len(examples.EXAMPLES) == 4


def test_history(spark):
    versions = [spark.range(n) for n in range(5)]
    h = session.History(versions[0], depth=3)
    for v in versions[1:]:
        h.edit(v)
    assert [h.undo() is v for v in (versions[3], versions[2], versions[1], versions[1])] == [True] * 4  # no more than the depth
    assert h.redo() is versions[2]
    h.edit(versions[0])
    assert h.redo() is versions[0] and h.undo() is versions[2]


def test_cancellable(spark):
    with session.cancellable(spark, "some-jobs"):
        assert spark.range(100).count() == 100
    done, total = session.progress(spark, "some-jobs")
    assert 0 < done == total
    assert spark.sparkContext.getLocalProperty("spark.jobGroup.id") is None
    session.cancel(spark, "some-jobs")


def test_selection(spark):
    row = spark.range(1).select(G.selected_box(*(F.lit(float(v)) for v in (60, 50, 10, 20)), F.lit(100.0), F.lit(300.0), F.lit(200), F.lit(100)).alias("b"), G.selected_box(*(F.lit(float(v)) for v in (0, 0, 2, 2)), F.lit(100.0), F.lit(100.0), F.lit(100), F.lit(100)).alias("small")).first()
    assert tuple(row["b"]) == (20, 40, 100, 60) and row["small"] is None
    import numpy as np

    assert rescaled(np.array([[100, 250]], np.uint8)).tolist() == [[120, 255]]
