"""Helpers that the training-data operators share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows of a batch that are Python objects at once, and bytes of an Arrow batch.
ROWS = 1024
BATCH_BYTES = 8 << 20

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; where that is unset, a temporary one, on a local master only."""
    sc = spark.sparkContext
    given = sc.getConf().get("spark.checkpoint.dir")
    if given is None:
        given = getattr(sc, "_labelloom_checkpoint_dir", None)
        if given is None:
            if not re.match(r"local($|\[)", sc.master):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors reach")
            given = "file://" + tempfile.mkdtemp(prefix="labelloom-")
            sc._labelloom_checkpoint_dir = given
            sc.setCheckpointDir(given)
    elif sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(given)
    return given.rstrip("/")


def checkpoint(df: DataFrame) -> DataFrame:
    """Cuts the lineage through the shared folder, so the rows outlive a lost executor."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def new_folder(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def row_hash(df: DataFrame) -> Column:
    """A hash of the whole row: with doc_id, it tells rows apart that differ in any column. Columns that hold a map or a
    variant at any depth have no hash of their own; their JSON has."""
    column = lambda c: df["`" + c.replace("`", "``") + "`"]
    return F.xxhash64(*(F.to_json(F.struct(column(c))) if re.search(r"\b(map<|variant\b)", kind) else column(c) for c, kind in df.dtypes))


def one_of_equals(df: DataFrame) -> DataFrame:
    """One row of those that are equal in all columns: numbered, since columns of some kinds can't be compared."""
    number = f"number_{uuid.uuid4().hex}"
    order = Window.partitionBy(df["doc_id"].cast("long"), row_hash(df)).orderBy(F.lit(0))
    return df.withColumn(number, F.row_number().over(order)).where(F.col(number) == 1).drop(number)


def is_row(docs: DataFrame, rows: DataFrame) -> Column:
    """Does a row of docs stand in rows (doc_id, row)?"""
    return docs["doc_id"].cast("long").eqNullSafe(rows["doc_id"]) & (row_hash(docs) == rows["row"])


def firsts_of(docs: DataFrame, classed: DataFrame) -> DataFrame:
    """docs without the rows that aren't the first of their class by doc_id (null last) and row; columns as they are.
    classed: doc_id, row, class, for each row of docs. Of rows that are equal in all columns one stays."""
    order = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row")
    # Written out, so that the join isn't one stage with the aggregation and a large class's rows can be split over tasks.
    first = checkpoint(classed.groupBy("class").agg(F.min(order).alias("first"), F.count("*").alias("n")).where("n > 1").select("class", "first"))
    placed = checkpoint(classed.join(first.hint("merge"), "class").select("doc_id", "row", (order == F.col("first")).alias("is_first")))
    gone = placed.where("not is_first").select("doc_id", "row").distinct()
    kept = docs.join(gone, is_row(docs, gone), "left_anti")
    repeated = placed.where("is_first").groupBy("doc_id", "row").agg(F.count("*").alias("n")).where("n > 1")
    if repeated.isEmpty():
        return kept
    once = one_of_equals(kept.join(repeated, is_row(kept, repeated), "left_semi"))
    return kept.join(repeated, is_row(kept, repeated), "left_anti").unionByName(once)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z alone; texts of ASCII alone take the faster built-in."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def utf8(column: pa.Array) -> list[bytes]:
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of ROWS rows and BATCH_BYTES (or one row) at most: an executor holds several of them beside its
    heap. A session that asks for less keeps that."""
    for name, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        if not 0 < int(re.match(r"-?\d+", spark.conf.get(name))[0]) <= most:
            spark.conf.set(name, str(most))


def map_batches(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], schema: str) -> DataFrame:
    """Runs make() once in a task and its result on each Arrow batch."""
    bounded_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = make()
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                yield one(batch.slice(at, ROWS))
            pa.default_memory_pool().release_unused()

    return df.mapInArrow(run, schema)
