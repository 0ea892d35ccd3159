"""Vocabulary files (S8-S11): vocab_idx, value; the order of a file's lines is that of the vocabulary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from labelloom.functions.text import control_trim
from labelloom.operators.numbering import numbered

#: Words that tell a header line.
HEADER_WORDS = ("sample", "name", "id", "code", "label", "value", "specimen", "patient", "slide", "case", "date")


def looks_like_header(line: Column) -> Column:
    """S9. A first value that contains such a word is taken for a header, too."""
    return F.lower(line).rlike("|".join(HEADER_WORDS))


def csv_first(line: Column) -> Column:
    """A quoted first column without its quotes, else what stands before the first comma, else the line."""
    quote, comma = F.locate('"', line, 2), F.instr(line, ",")
    return F.when(F.startswith(line, F.lit('"')) & (quote > 2), F.substring(line, F.lit(2), quote - 2)).when(~(F.startswith(line, F.lit('"')) & (quote > 2)) & (comma > 1), control_trim(F.substring(line, F.lit(1), comma - 1))).otherwise(line)


def tab_first(line: Column) -> Column:
    """S11."""
    tab = F.instr(line, "\t")
    return F.when(tab > 1, control_trim(F.substring(line, F.lit(1), tab - 1))).otherwise(line)


def first_column(line: Column, extension: str) -> Column:
    return {"csv": csv_first, "tsv": tab_first, "txt": tab_first}.get(extension.lower().lstrip("."), lambda x: x)(line)


def values_of_lines(lines: DataFrame, value: Column, keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, line_no, value: the values of each file's lines that are neither blank nor a header. A header is a file's first
    line that isn't blank. lines: keys, line_no, line."""
    kept = lines.withColumn("line", control_trim(F.col("line"))).where("line <> ''")
    head = kept.groupBy(*keys).agg(F.min_by(F.struct("line_no", "line"), "line_no").alias("head"))
    head = head.where(looks_like_header(F.col("head.line"))).select(*keys, F.col("head.line_no").alias("line_no"))
    return kept.join(head, [*keys, "line_no"], "left_anti").withColumn("value", value).where("value <> ''").select(*keys, "line_no", "value")


def vocabulary_of_lines(lines: DataFrame, extension: str) -> DataFrame:
    """vocab_idx, value. lines: line_no, line, of one file, numbered in their order over all tasks."""
    return numbered(values_of_lines(lines, first_column(F.col("line"), extension)), ["line_no"], "vocab_idx", 0).select("vocab_idx", "value")


def lines_of(spark: SparkSession, path: str) -> DataFrame:
    """file, line_no, line of a file or of all files below a folder; a line ends at a line feed, a carriage return or both."""
    whole = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    return whole.select("file", F.posexplode(F.split("value", "\r\n|\n|\r")).alias("line_no", "line"))


def read_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """A .csv, .tsv, .txt or other file in UTF-8, by Spark's reader, so wherever Spark reads."""
    return vocabulary_of_lines(lines_of(spark, path).drop("file"), path.rpartition(".")[2] if "." in path.rpartition("/")[2] else "")


def read_vocabularies(spark: SparkSession, path: str) -> DataFrame:
    """S8 over many files: file, vocab_idx, value: each file below path is a vocabulary of its own, read by its extension."""
    ending = F.lower(F.regexp_extract("file", r"\.([^./]*)$", 1))
    line = F.col("line")
    value = F.when(ending == "csv", csv_first(line)).when(ending.isin("tsv", "txt"), tab_first(line)).otherwise(line)
    values = values_of_lines(lines_of(spark, path), value, ("file",))
    return values.select("file", (F.row_number().over(Window.partitionBy("file").orderBy("line_no")) - 1).cast("long").alias("vocab_idx"), "value")
