"""From documents to token files: the stages, in order, and run() over all of them.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame. All but the last return the columns of docs as they
came, extra ones too. Nulls, empty tables and repeated rows are met as the operators' docstrings say: a null text
scores, links and mixes as an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelloom.llm import decontaminate, mixing, near_copies, quality, token_output
from labelloom.llm.common import new_folder, table


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the labelled documents that are not held out; drops what scores below the threshold."""
    labels = table(spark, sf_dir, "labels").where(~quality.held_out(F.col("doc_id")))
    model = quality.fit(quality.text_statistics(docs), labels.select("doc_id", F.col("quality").alias("label")))
    return quality.keep_good(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of texts whose five-word shingles have a Jaccard similarity of 0.8 or more, the first stays. Those are
    found by ball hashing of fingerprints, as in op6, and by minima of what differs in more bits than its balls reach."""
    return near_copies.keep_first_similar(docs)


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark window go."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents stand as often as the mix takes them; where it takes the first words alone, the text is cut."""
    return mixing.mixed_rows(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, file: as read back from the token files."""
    return token_output.token_output(docs)


STAGES = [
    ("quality", good_quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", benchmark_free),
    ("mixing", mixed),
    ("token_output", tokens),
]

#: A trained classifier, XXH64 and a tokenizer: not SQL. tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage returns is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            folder = new_folder(spark, f"pipeline-{i}-{name}")
            docs.write.parquet(folder)
            docs = spark.read.parquet(folder)
    return docs
