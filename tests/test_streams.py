"""Keys carried over a stream equal those of the batch; templates as a data source; models checked before a run."""

import os
import random

import pytest
from pyspark.sql import functions as F

from labelloom.operators import decode, fields
from labelloom.operators.template import FIELDS, FieldMapping, Template, from_json
from labelloom.plans.config import OcrConfig
from labelloom.sources import template_format
from labelloom.streaming import carry

IMAGES = f"group string, at long, image_id long, width int, height int, fields {carry.FIELDS}"


def image_rows(n=60):
    r = random.Random(9)
    rows = []
    for i in range(n):
        some = [] if r.random() < 0.25 else [(k, r.choice([None, "", "A", "B", "C"]), r.choice([None, (r.randint(0, 60), r.randint(0, 60), r.randint(1, 50), r.randint(1, 50))])) for k in range(r.randint(1, 6))]
        rows.append((r.choice(["hot", "hot", "b", None]), i, 1000 + i, r.choice([100, 130]), r.choice([100, 90]), some))
    return rows


def batch_result(spark, rows):
    df = spark.createDataFrame(rows, IMAGES)
    one = df.select("image_id", F.explode("fields").alias("f")).select("image_id", "f.*")
    images = fields.previous_images(df.withColumn("n_fields", F.size("fields")), "at", "group")
    return sorted((r["image_id"], r["field_index"], r["metadata_key"]) for r in fields.carry_over_keys(one, images).collect())


def streamed(spark, folder, parts, name):
    for i, part in enumerate(parts):
        at = str(folder / f"{name}-{i}")
        spark.createDataFrame(part, IMAGES).coalesce(1).write.parquet(at)
        os.makedirs(folder / name, exist_ok=True)
        file = next(x for x in os.listdir(at) if x.endswith(".parquet"))
        os.rename(f"{at}/{file}", folder / name / f"{i:03}.parquet")
        os.utime(folder / name / f"{i:03}.parquet", (1e9 + i, 1e9 + i))
    images = spark.readStream.schema(IMAGES).option("maxFilesPerTrigger", 1).parquet(str(folder / name))
    q = carry.carry_stream(images).writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    return spark.table(name).collect()


@pytest.mark.parametrize("size", [13, 60])
def test_carry_over_any_split(spark, tmp_path, size):
    rows = image_rows()
    got = streamed(spark, tmp_path, [rows[i : i + size] for i in range(0, len(rows), size)], f"carry_{size}")
    expected = batch_result(spark, rows)
    assert sorted((r["image_id"], r["field_index"], r["metadata_key"]) for r in got) == expected
    assert not any(r["late"] for r in got) and sum(x[2] is not None for x in expected) > 50


def test_carry_over_late_images(spark, tmp_path):
    whole = [(0, "K", (0, 0, 100, 100))]
    rows = [("g", 5, 1, 100, 100, whole), ("g", 3, 2, 100, 100, [(0, None, (0, 0, 100, 100))]), ("g", 9, 3, 100, 100, [(0, None, (0, 0, 100, 100)), (1, None, None)]), ("g", None, 4, 100, 100, whole)]
    got = {(r["image_id"], r["field_index"]): (r["metadata_key"], r["late"]) for r in streamed(spark, tmp_path, [[r] for r in rows], "carry_late")}
    assert got == {(1, 0): ("K", False), (2, 0): (None, True), (3, 0): ("K", False), (3, 1): (None, False)}


def test_carry_over_forgets(monkeypatch):
    class State:
        exists, hasTimedOut, removed = True, True, False

        def remove(self):
            self.removed = True

    state = State()
    assert list(carry.carry_group(("g",), iter(()), state, 1)) == [] and state.removed


def test_template_format(spark, tmp_path):
    template_format.register(spark)
    n = 300
    rows = [(f"T/{i} é", 1.5, k, f"key{k}", None, k % 2 == 0, 0.1, 0.2, 0.3, 0.4, True, "BARCODE") for i in range(n) for k in (1, 0)]
    df = spark.createDataFrame(rows, f"template string, dilation double, {FIELDS}").repartition(5)
    out = str(tmp_path / "templates")
    template_format.template_bodies(df).write.format("templates").mode("append").save(out)
    assert len(os.listdir(out)) == n
    read = spark.read.format("templates").option("filesperpartition", 50).load(out)
    assert read.rdd.getNumPartitions() == 6
    assert sorted(tuple(r)[1:] for r in read.collect()) == sorted(rows)
    first = from_json((tmp_path / "templates" / "T%2F0 %C3%A9.json").read_text())
    assert first == Template("T/0 é", None, tuple(FieldMapping(k, f"key{k}", None, k == 0, 0.1, 0.2, 0.3, 0.4, True, "BARCODE") for k in (0, 1)), dilation=1.5)
    # What fails leaves no file in place; overwriting leaves the new ones alone.
    bad = spark.createDataFrame([("x", "{}"), ("y", None)], "name string, body string").coalesce(1)
    with pytest.raises(Exception):
        bad.write.format("templates").mode("append").save(out)
    twice = spark.createDataFrame([("x", "{}"), ("x", "{}")], "name string, body string").repartition(2)
    with pytest.raises(Exception):
        twice.write.format("templates").mode("append").save(out)
    assert len([x for x in os.listdir(out) if x.endswith(".json")]) == n and spark.read.format("templates").load(out).count() == 2 * n
    template_format.template_bodies(df.where("template < 'T/1 '")).write.format("templates").mode("overwrite").save("file://" + out)
    assert {x for x in os.listdir(out) if x.endswith(".json")} == {"T%2F0 %C3%A9.json"}
    template_format.template_bodies(df.limit(0)).write.format("templates").mode("overwrite").save(out)
    assert spark.read.format("templates").load(out).count() == 0


def test_models_before_a_run(spark, tmp_path):
    with pytest.raises(ValueError, match="no folder"):
        decode.checked_config(spark, str(tmp_path / "none"))
    (tmp_path / "eng.traineddata").write_bytes(b"x")
    with pytest.raises(ValueError, match="deu"):
        decode.checked_config(spark, str(tmp_path), OcrConfig(language="eng+deu"))
    with pytest.warns(UserWarning, match="osd"):
        assert not decode.checked_config(spark, str(tmp_path), OcrConfig(detect_orientation=True)).detect_orientation
    (tmp_path / "osd.traineddata").write_bytes(b"x")
    config = OcrConfig(language="eng", detect_orientation=True)
    assert decode.checked_config(spark, str(tmp_path), config) == config
