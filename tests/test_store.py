"""The metadata table: merged once, whole or not at all."""

import pytest
from pyspark.sql import functions as F

from labelloom.operators.store import BatchConflict, MetadataTable

ROWS = "image_id long, metadata map<string,string>"


def rows(table):
    return {r["image_id"]: r["metadata"] for r in table.read().collect()}


@pytest.fixture
def table(spark, tmp_path):
    entries = spark.createDataFrame([(i, {"host": str(i)}) for i in range(40)] + [(None, {"a": "b"}), (40, None)], ROWS)
    return MetadataTable.create(spark, f"file://{tmp_path}/table", entries, 8)


def changes(spark, **values):
    return spark.createDataFrame([(int(k[1:]), v) for k, v in values.items()], ROWS)


def test_a_batch_is_merged_once(spark, table):
    batch = changes(spark, i3={"CaseID": "x", "name": "reserved", "9 bad": "no", "empty": ""}, i99={"new_one": "y"})
    assert table.merge(batch, "a") and not table.merge(batch, "a")
    expected = {i: {"host": str(i)} for i in range(40)} | {40: {}, 3: {"host": "3", "CaseID": "x", "empty": ""}, 99: {"new_one": "y"}}
    assert rows(table) == expected
    assert table.merge(changes(spark, i3={"CaseID": "z"}), "b") and rows(table)[3]["CaseID"] == "z"
    assert not table.merge(batch, "a") and rows(table)[3]["CaseID"] == "z"
    assert rows(MetadataTable(spark, table.path)) == expected | {3: {"host": "3", "CaseID": "z", "empty": ""}}


def test_only_touched_buckets_are_written(spark, table):
    before = table._known()
    table.merge(changes(spark, i3={"CaseID": "x"}), "a")
    after = table._known()
    assert sum(before.folders[b] != after.folders[b] for b in before.folders) == 1 and after.version == 1


def test_a_batch_that_fails_halfway_leaves_the_table(spark, table, monkeypatch):
    before = rows(table)
    batch = changes(spark, **{f"i{i}": {"CaseID": "x"} for i in range(40)})
    with monkeypatch.context() as m:
        m.setattr(table, "_commit", lambda manifest: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            table.merge(batch, "a")
    assert rows(table) == before and len(table.unnamed()) == 1
    broken = batch.withColumn("metadata", F.when(F.col("image_id") < 30, F.col("metadata")).otherwise(F.create_map(F.lit("k"), F.raise_error(F.lit("broken")).cast("string"))))
    with pytest.raises(Exception, match="broken"):
        table.merge(broken, "a")
    assert rows(table) == before
    assert table.merge(batch, "a") and all(rows(table)[i] == {"host": str(i), "CaseID": "x"} for i in range(40))


def test_the_second_of_two_writers_is_refused(spark, table, monkeypatch):
    stale = table._known()
    other = MetadataTable(spark, table.path)
    assert other.merge(changes(spark, i1={"CaseID": "first"}), "a")
    with monkeypatch.context() as m:
        m.setattr(table, "_known", lambda: stale)
        with pytest.raises(BatchConflict):
            table.merge(changes(spark, i1={"CaseID": "second"}), "b")
    assert rows(table)[1]["CaseID"] == "first"
    assert table.merge(changes(spark, i1={"CaseID": "second"}), "b") and rows(table)[1]["CaseID"] == "second"


def test_edges(spark, table, tmp_path):
    with pytest.raises(ValueError, match="more than one row"):
        table.merge(changes(spark, i1={"a": "b"}).union(changes(spark, i1={"a": "c"})), "a")
    before = rows(table)
    assert table.merge(changes(spark, i1={"a": "b"}).limit(0), "none") and rows(table) == before
    with pytest.raises(BatchConflict):
        MetadataTable.create(spark, table.path, changes(spark, i1={"a": "b"}))
    with pytest.raises(FileNotFoundError):
        MetadataTable(spark, f"file://{tmp_path}/none").read()
    empty = MetadataTable.create(spark, f"file://{tmp_path}/empty", changes(spark, i1={"a": "b"}).limit(0))
    assert rows(empty) == {} and empty.merge(changes(spark, i1={"a_b": "c"}), "a") and rows(empty) == {1: {"a_b": "c"}}
