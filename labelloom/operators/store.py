"""Metadata as a table that batches are merged into.

Entries are hashed into buckets. A batch rewrites the buckets that it touches, beside the old ones, and then puts a new manifest
in place, which names the folder of each bucket and the batches that are in. Readers take the last manifest: they see a batch
whole or not at all. A batch that failed leaves files that no manifest names; run again, under its id, it is merged once, and a
third time it changes nothing. Two writers that begin from one manifest can't both end: the second one's is refused.

Files and manifests are written through Spark's file systems, so the folder may be wherever Spark reads.
"""

from __future__ import annotations

import json
import re
import tempfile
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labelloom.operators.metadata import or_empty, upsert

ROWS = "image_id long, metadata map<string,string>"
BUCKETS = 64


class BatchConflict(RuntimeError):
    """Another batch was merged meanwhile: read again, and merge this one anew."""


def shared_folder(spark: SparkSession) -> str:
    """A new folder in the one that spark.checkpoint.dir names; where that is unset, a temporary one, on a local master only."""
    given = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if given is None:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors reach")
        given = "file://" + tempfile.mkdtemp(prefix="labelloom-")
    return f"{given.rstrip('/')}/{uuid.uuid4().hex}"


@dataclass(frozen=True)
class Manifest:
    version: int
    buckets: int
    folders: dict[int, str]
    batches: tuple[str, ...]


class MetadataTable:
    """image_id, metadata of a project; a null image_id is no entry."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark._jvm.org.apache.hadoop.fs
        self._path = jvm.Path
        self._files = jvm.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    @classmethod
    def create(cls, spark: SparkSession, path: str, entries: DataFrame, buckets: int = BUCKETS) -> MetadataTable:
        """A table of entries (image_id, metadata), one row each. The folder must not hold one."""
        table = cls(spark, path)
        if table._last() is not None:
            raise BatchConflict(f"there is a table in {path}")
        table._commit(Manifest(0, buckets, table._write(entries.where("image_id is not null").select("image_id", or_empty(F.col("metadata")).alias("metadata")), buckets), ()))
        return table

    # ---- manifests

    def _last(self) -> Manifest | None:
        folder = self._path(f"{self.path}/manifests")
        names = [x.getPath().getName() for x in self._files.listStatus(folder)] if self._files.exists(folder) else []
        versions = [int(m[1]) for m in (re.fullmatch(r"v(\d+)\.json", n) for n in names) if m]
        if not versions:
            return None
        text = self.spark.read.text(f"{self.path}/manifests/v{max(versions):08d}.json", wholetext=True).first()[0]
        given = json.loads(text)
        return Manifest(given["version"], given["buckets"], {int(k): v for k, v in given["folders"].items()}, tuple(given["batches"]))

    def _commit(self, m: Manifest) -> None:
        """Written beside its place, then moved to it: whoever finds a manifest finds the whole of it."""
        text = json.dumps({"version": m.version, "buckets": m.buckets, "folders": m.folders, "batches": m.batches})
        final, beside = self._path(f"{self.path}/manifests/v{m.version:08d}.json"), self._path(f"{self.path}/manifests/_{uuid.uuid4().hex}")
        out = self._files.create(beside, False)
        out.write(bytearray(text.encode()))
        out.close()
        if self._files.exists(final) or not self._files.rename(beside, final):
            self._files.delete(beside, False)
            raise BatchConflict(f"version {m.version} of {self.path} is another batch's")

    # ---- rows

    @staticmethod
    def _bucket(buckets: int) -> Column:
        return F.pmod(F.xxhash64("image_id"), F.lit(buckets)).cast("int")

    def _write(self, rows: DataFrame, buckets: int) -> dict[int, str]:
        """The folder, below the table's, of each bucket that rows have."""
        name = f"data/{uuid.uuid4().hex}"
        rows.withColumn("bucket", self._bucket(buckets)).write.partitionBy("bucket").parquet(f"{self.path}/{name}")
        found = [x.getPath().getName() for x in self._files.listStatus(self._path(f"{self.path}/{name}"))]
        return {int(x.partition("=")[2]): f"{name}/{x}" for x in found if x.startswith("bucket=")}

    def _read(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], ROWS)
        return self.spark.read.schema(ROWS).parquet(*(f"{self.path}/{x}" for x in folders))

    def read(self) -> DataFrame:
        """The table as of the last batch. Its files are never changed, so a query that has begun goes on reading them."""
        return self._read(list(self._known().folders.values()))

    def _known(self) -> Manifest:
        last = self._last()
        if last is None:
            raise FileNotFoundError(f"no table in {self.path}")
        return last

    def merge(self, changes: DataFrame, batch: str) -> bool:
        """Merges changes (image_id, metadata: a row for an image at most) as K2 does: valid keys are set, others left out;
        an image that isn't there yet is added. False, and nothing done, if the batch is in already."""
        last = self._known()
        if batch in last.batches:
            return False
        some = changes.where("image_id is not null").select("image_id", F.col("metadata").alias("new"))
        held = some.groupBy(self._bucket(last.buckets).alias("bucket")).agg(F.count("*").alias("n"), F.count_distinct("image_id").alias("images")).collect()  # a row for each bucket
        if any(r["n"] != r["images"] for r in held):
            raise ValueError("an image has more than one row in a batch")
        touched = [r["bucket"] for r in held]
        old = self._read([last.folders[b] for b in touched if b in last.folders])
        rows = old.join(some, "image_id", "full").select("image_id", upsert(or_empty(F.col("metadata")), F.col("new")).alias("metadata"))
        self._commit(Manifest(last.version + 1, last.buckets, last.folders | self._write(rows, last.buckets), (*last.batches, batch)))
        return True

    def unnamed(self) -> list[str]:
        """Folders that the last manifest doesn't name whole: of earlier versions, and of batches that failed. The owner may
        delete those when no reader is left."""
        data = self._path(f"{self.path}/data")
        named = {x.split("/")[1] for x in self._known().folders.values()}
        return sorted(f"data/{n}" for n in (x.getPath().getName() for x in self._files.listStatus(data)) if n not in named)
