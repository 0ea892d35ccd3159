"""An extension: templates as a data source of their own.

After register(spark), spark.read.format("templates").load(folder) gives a row for each field of each .json file below a
folder, its files shared out to partitions; a template without fields gives none. df.write.format("templates") writes
rows of name and body (template_bodies) as a file each: tasks write aside, the commit moves the files into place, and an
abort or a lost attempt leaves only what stands aside, which readers pass over. Folders are paths or URIs that pyarrow
opens, the same on all executors.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from dataclasses import asdict, dataclass
from urllib.parse import quote

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import Row, StructType

from labelloom.operators.template import FIELDS, JSON_NAMES, from_json

#: Files that one partition reads, unless option filesperpartition says otherwise.
SHARE = 64
ASIDE = "_aside-"


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


@dataclass
class Files(InputPartition):
    paths: Sequence[str]


@dataclass
class Written(WriterCommitMessage):
    names: Sequence[str]


class TemplateReader(DataSourceReader):
    def __init__(self, path: str, share: int, infer_boxes: bool):
        self.path, self.share, self.infer_boxes = path, share, infer_boxes

    def partitions(self) -> Sequence[InputPartition]:
        system, root = opened(self.path)
        files = system.get_file_info(fs.FileSelector(root, recursive=True))
        paths = sorted(f.path for f in files if f.is_file and f.extension == "json" and not any(x.startswith(("_", ".")) for x in f.path[len(root) :].split("/")))
        return [Files(paths[i : i + self.share]) for i in range(0, max(1, len(paths)), self.share)]

    def read(self, partition: Files) -> Iterator[tuple]:
        system, _ = opened(self.path)
        for path in partition.paths:
            with system.open_input_stream(path) as f:
                t = from_json(f.read().decode("utf-8"), self.infer_boxes)
            for m in t.mappings:
                yield (path, t.name, float(t.dilation), *asdict(m).values())


class TemplateWriter(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path, overwrite
        self.aside = f"{ASIDE}{uuid.uuid4().hex}"

    def write(self, rows: Iterator[Row]) -> WriterCommitMessage:
        system, root = opened(self.path)
        folder, names = f"{self.aside}/{uuid.uuid4().hex}", []  # of this attempt alone
        for row in rows:
            if not names:
                system.create_dir(f"{root}/{folder}", recursive=True)
            names.append(f"{folder}/{quote(row['name'], safe=' ')}.json")
            with system.open_output_stream(f"{root}/{names[-1]}") as f:
                f.write(row["body"].encode("utf-8"))
        return Written(names)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        system, root = opened(self.path)
        names = [n for m in messages if m for n in m.names]
        last = [n.rpartition("/")[2] for n in names]
        if len(set(last)) < len(last):
            self.abort(messages)
            raise ValueError("two templates have one name")
        system.create_dir(root, recursive=True)
        for n, to in zip(names, last):
            system.move(f"{root}/{n}", f"{root}/{to}")
        if self.overwrite:
            for f in system.get_file_info(fs.FileSelector(root)):
                if f.is_file and f.extension == "json" and f.base_name not in set(last):
                    system.delete_file(f.path)
        self.abort(messages)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        system, root = opened(self.path)
        if system.get_file_info(f"{root}/{self.aside}").type == fs.FileType.Directory:
            system.delete_dir(f"{root}/{self.aside}")


class TemplateSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "templates"

    def schema(self) -> str:
        return f"file string, template string, dilation double, {FIELDS}"

    def reader(self, schema: StructType) -> DataSourceReader:
        return TemplateReader(self.options["path"], int(self.options.get("filesperpartition", SHARE)), self.options.get("inferboxes", "false").lower() == "true")

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        if [f.name for f in schema] != ["name", "body"]:
            raise ValueError("templates are written from columns name and body")
        return TemplateWriter(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(TemplateSource)


def template_bodies(fields: DataFrame) -> DataFrame:
    """name, body (K11's JSON) from rows of template, dilation and the columns of a template's fields; one row for each
    template, its fields by field_index. Templates without a name are called template."""
    name = F.coalesce("template", F.lit("template"))
    mappings = F.array_sort(F.collect_list(F.struct("field_index", *(c for c in JSON_NAMES if c != "field_index"))))
    each = fields.groupBy(name.alias("name")).agg(F.max("dilation").alias("dilation"), mappings.alias("m"))
    renamed = F.transform("m", lambda m: F.struct(*(m[c].alias(j) for c, j in JSON_NAMES.items())))
    return each.select("name", F.to_json(F.struct("name", renamed.alias("fieldMappings"), F.col("dilation").alias("dilationFactor"))).alias("body"))
