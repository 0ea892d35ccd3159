"""Goldens of FIXTURES.md for scalar operators: F1-F15, V1-V5, G1-G13, D1-D4, S8-S11."""

import pytest
from pyspark.sql import functions as F

from labelloom.functions import geometry as G
from labelloom.functions import keys as V
from labelloom.functions import text as T
from labelloom.functions.distance import confusion_weights, distances, substitution_cost
from labelloom.sources.vocabulary import read_vocabulary


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values()) or (0,)], ", ".join(f"{k} {('string' if isinstance(v, str) or v is None else 'double' if isinstance(v, float) else 'int')}" for k, v in values.items()) or "z int")
    return row.select(column.alias("x")).first()["x"]


def test_filters(spark):
    text = "PBS_0O1 / B-2.5 #é\t(x)"
    expected = ["PBSOBx", "0125", "PBS0O1B25x", "PBS_0O1B-2.5x", "PBS0O1  B-2.5 \t(x)", "PBS_0O1_/_B-2.5_#é_(x)"]
    df = spark.createDataFrame([(text,), (None,), ("",)], "t string").select(*(f(F.col("t")).alias(f"f{i}") for i, f in enumerate(T.ALL_FILTERS)))
    rows = df.collect()
    assert list(rows[0]) == expected and list(rows[1]) == [None] * 6 and list(rows[2]) == [""] * 6
    assert [f.keeps for f in T.ALL_FILTERS] == [True, True, True, True, False, False]
    again = spark.createDataFrame([(text,)], "t string").select(T.apply_all(F.col("t"), T.LETTERS_ONLY, T.LETTERS_ONLY), T.active_filters(F.col("t"), {T.NO_WHITESPACE, T.FILENAME_SAFE})).first()
    assert list(again) == ["PBSOBx", "PBS_0O1B-2.5x"]


def test_strings(spark):
    assert one(spark, T.control_trim(F.col("t")), t="\t a b\x01 \n") == "a b"
    assert one(spark, T.shortened(F.col("t")), t="x" * 21) == "x" * 20 + "..."
    assert one(spark, T.type_display(F.lit("BARCODE"), F.lit("QR"))) == "[QR]"
    assert one(spark, T.type_display(F.lit("AUTO"), F.lit(None).cast("string"))) == "Try Both"
    assert one(spark, T.region_type(F.col("t")), t="try both") == "AUTO" and one(spark, T.region_type(F.col("t")), t="?") == "TEXT"
    assert one(spark, T.match_display(F.lit("a"), F.lit("b"), F.lit(1.0), F.lit(0.75))) == "'a' -> 'b' (distance=1.00, 75% similar)"
    assert one(spark, T.confidence_percent(F.lit(0.875))) == 88
    assert [one(spark, T.numeric_key(F.col("t")), t=t) for t in ("field_12", "none", "9" * 20)] == [12, 0, 0]


KEYS = [
    ("CaseID", True, "CaseID", "ocr_CaseID"), (" CaseID ", True, "CaseID", "custom_ CaseID "), ("", False, None, "ocr_"), (None, False, None, "ocr_field"), ("1abc", False, "ocr_1abc", "ocr_1abc"), ("-x", False, "ocr_-x", "ocr_-x"), ("Name", False, "ocr_Name", "ocr_Name"), ("OWNER", False, "ocr_OWNER", "ocr_OWNER"),
    ("sample id", False, "sample_id", "custom_sample id"), ("a.b/c:d", False, "a_b_c_d", "custom_a.b/c:d"), ("###", False, None, "custom_###"), ("bad key!", False, "bad_key", "custom_bad key!"), ("é1", False, "ocr_1", "custom_é1"), ("x" * 129, False, "x" * 128, "custom_" + "x" * 129),
]


def test_keys(spark):
    df = spark.createDataFrame([(k,) for k, *_ in KEYS], "k string")
    rows = df.select("k", V.is_valid_key(F.col("k")), V.sanitize_key(F.col("k")), V.suggest_key(F.col("k"))).collect()
    assert [tuple(r) for r in rows] == KEYS
    assert one(spark, V.ocr_key(F.col("k")), k="###") is None and one(spark, V.ocr_key(F.col("k"), faithful=True), k="###") == "OCR_null"
    assert len(V.RESERVED) == 31


@pytest.mark.parametrize(
    "box,size,dilation,expected",
    [((0.05, 0.10, 0.40, 0.12), (1000, 500), 1.2, (10, 44, 480, 72)), ((0.75, 0.30, 0.20, 0.35), (1000, 500), 2.5, (600, 18, 400, 437)), ((0.05, 0.10, 0.40, 0.12), (1000, 500), 0.2, (210, 74, 80, 12)), ((0.0, 0.0, 0.40, 0.20), (1000, 500), 1.2, (0, 0, 480, 120)), ((0.05, 0.10, 0.40, 0.12), (1000, 500), 1.0, (49, 50, 400, 60))],
)
def test_scaled_boxes(spark, box, size, dilation, expected):
    got = one(spark, G.scaled_box(*map(F.lit, box), *map(F.lit, size), F.lit(dilation)))
    assert tuple(got) == expected


def test_boxes(spark):
    box = lambda *v: G.box(*map(F.lit, v))
    a, touching, inner = box(0, 0, 10, 10), box(10, 0, 5, 5), box(2, 2, 4, 4)
    assert one(spark, G.intersects(a, touching)) is False and one(spark, G.intersects(a, inner)) is True
    assert one(spark, G.same_place(a, box(5, 0, 10, 10))) is False and one(spark, G.same_place(a, inner)) is True
    assert tuple(one(spark, G.union(a, touching))) == (0, 0, 15, 10) and tuple(one(spark, G.union(F.lit(None).cast(G.BOX), inner))) == (2, 2, 4, 4)
    assert tuple(one(spark, G.expand(inner, 1))) == (1, 1, 6, 6)
    with pytest.raises(Exception, match="negative"):
        one(spark, G.expand(inner, -3))
    assert one(spark, G.clamped(box(20, 0, 5, 5), F.lit(10), F.lit(10))) is None
    points = F.array(F.struct(F.lit(3.7).alias("x"), F.lit(1.0).alias("y")), F.lit(None).cast("struct<x double, y double>"), F.struct(F.lit(9.2).alias("x"), F.lit(5.9).alias("y")))
    assert tuple(one(spark, G.box_of_points(points))) == (3, 1, 6, 4)
    assert [tuple(t) for t in one(spark, G.quadrants(F.lit(401), F.lit(400)))] == [(0, 0, 300, 300), (100, 0, 301, 300), (0, 100, 300, 300), (100, 100, 301, 300)]
    assert one(spark, G.quadrants(F.lit(300), F.lit(400))) == []


def test_weighted_distance():
    w = confusion_weights()
    assert len(w) == 82
    got = distances(["pbs_0o1", "samp1e_0o1", "pbs-001", "pb5_oo1", "", "ab"], ["pbs_001", "sample_001", "pbs_001", "pbs_001", "abc", ""], w)
    assert got == pytest.approx([0.3, 0.6, 0.5, 1.1, 3, 2])
    assert substitution_cost("1", "I", w) == 0.3 and substitution_cost("1", "i", w) == 1.0 and substitution_cost("A", "a", w) == 0.3
    assert substitution_cost("a", "b", confusion_weights([("a", "b", 0.1)])) == 0.1 and ("a", "b") not in confusion_weights()


@pytest.mark.parametrize("name,text,expected", [("v.csv", 'Sample,Note\n"PBS, 1",x\n PBS_002 ,y\n\n,z\n"",q\n', ["PBS, 1", "PBS_002", ",z", '""']), ("v.txt", "PBS_001\tfoo\nPBS_002\n", ["PBS_001", "PBS_002"]), ("w.txt", "Sample_A1\nSample_B2", ["Sample_B2"]), ("v.dat", "a\tb,c\n", ["a\tb,c"])])
def test_vocabulary_files(spark, tmp_path, name, text, expected):
    (tmp_path / name).write_text(text, encoding="utf-8")
    assert [r["value"] for r in read_vocabulary(spark, str(tmp_path / name)).orderBy("vocab_idx").collect()] == expected
