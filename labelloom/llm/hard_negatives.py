"""Hard-negative mining: anchors against all vectors by blocked dense products.

Components become floor(SCALE * x); a score is the integer inner product of two rows, taken as a float64 matrix product,
which is exact while every partial sum stays below 2^53, and in whole numbers of any size where it might not. Anchors
are cut into blocks of at most BLOCK rows; each block in turn is broadcast and multiplied with every batch of candidates.
A first pass keeps the best positives of each anchor in each task and merges them; a second one keeps the best
negatives within each positive's window of scores. What a task emits for an anchor is bounded by the ranks asked for, so no
group grows with a label or a vector that many rows share. Each block's result is written to the shared folder.

Rows with a null label, a null vector or a null or non-finite component take no part. Higher scores come first, ties go to
the smaller vec_id (a null one counts as the largest long, is no anchor, and comes out as null). A row is not its own
positive; other rows with its vec_id or its very values may be, each as often as it stands in the table. Vectors of another
length than the anchor's are not scored against it. Components beyond a long are cut to its range, and scores as well.
An empty table gives an empty result; columns other than vec_id, label and embedding are not read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from labelloom.llm.common import bounded_batches, new_folder, table

SCALE = 256
#: Anchors whose vectors are broadcast at once, and columns of scores that are compared at once.
BLOCK = 2048
COLUMNS = 1024
POSITIVES = 5
NEGATIVES = 3
#: A negative's score, as per cent of its positive's.
LEAST, MOST = 50, 95
NO_ID = 2**63 - 1
EXACT = 2**53

KEPT = "place int, rank_of int, row long, vec_id long, score long"
RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def prepared(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """row (a number of its own), vec_id (NO_ID if null), label, q (the scaled components) of the rows that take part."""
    finite = F.col("embedding").isNotNull() & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    some = vectors.where(F.col("label").isNotNull()).where(F.coalesce(finite, F.lit(False)))
    q = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale))
    return some.select(F.monotonically_increasing_id().alias("row"), F.coalesce(F.col("vec_id").cast("long"), F.lit(NO_ID)).alias("vec_id"), F.col("label").cast("long").alias("label"), q.alias("q"))


def matrices(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, ...]]:
    """row, vec_id, label, q as arrays, for each length of vector in the batch, in ascending order of vec_id."""
    row, vec_id, label = (np.asarray(batch.column(i)) for i in range(3))
    q = batch.column(3)
    sizes, flat = np.diff(np.asarray(q.offsets)), np.asarray(q.flatten())
    starts = np.cumsum(sizes) - sizes
    for width in np.unique(sizes):
        some = np.nonzero(sizes == width)[0]
        some = some[np.argsort(vec_id[some], kind="stable")]
        yield row[some], vec_id[some], label[some], flat[starts[some][:, None] + np.arange(width)]


def products(q: np.ndarray, anchors: np.ndarray) -> np.ndarray:
    """The inner products of rows, exact; cut to the range of a long."""
    most = [int(np.abs(x.astype(np.float64)).max(initial=0)) for x in (q, anchors)]
    if q.shape[1] * most[0] * most[1] < EXACT:
        return (q.astype(np.float64) @ anchors.astype(np.float64).T).astype(np.int64)
    whole = q.astype(object) @ anchors.astype(object).T
    return np.clip(whole, -(2**63), NO_ID).astype(np.int64)


class Best:
    """The first `most` (score, vec_id) of each group, over what is added batch by batch."""

    def __init__(self, most: int):
        self.most = most
        self.kept = [np.zeros(0, np.int64)] * 4  # group, row, vec_id, score

    def add(self, scores: np.ndarray, may: np.ndarray, groups: np.ndarray, rows: np.ndarray, ids: np.ndarray) -> None:
        """scores: a row for each candidate, a column for each group; may: those that count."""
        if len(rows) > self.most:  # what is below a column's `most`-th can't be kept
            of = np.where(may, scores, np.iinfo(np.int64).min)
            may = may & (of >= np.partition(of, len(rows) - self.most, axis=0)[len(rows) - self.most])
        i, j = np.nonzero(may)
        found = [np.concatenate(x) for x in zip(self.kept, (groups[j], rows[i], ids[i], scores[i, j]))]
        # Complemented, not negated: the least long has no negative.
        order = np.lexsort((found[1], found[2], ~found[3], found[0]))
        group = found[0][order]
        first = np.r_[True, group[1:] != group[:-1]] if len(group) else np.zeros(0, bool)
        starts = np.nonzero(first)[0]
        rank = np.arange(len(group)) - np.repeat(starts, np.diff(np.r_[starts, len(group)]))
        self.kept = [x[order[rank < self.most]] for x in found]


def scored(candidates: DataFrame, anchors: list[tuple], windows: list[tuple] | None, most: int) -> DataFrame:
    """KEPT, merged over all tasks: of each anchor (place in anchors: row, label, q) the first rows of its label or, with
    windows (place, number, least, most score), of each window the first rows of other labels."""
    spark = candidates.sparkSession
    bounded_batches(spark)
    by_width: dict[int, list[int]] = defaultdict(list)
    for place, (_, _, q) in enumerate(anchors):
        by_width[len(q)].append(place)
    blocks = {}
    for width, places in by_width.items():
        q = np.array([anchors[p][2] for p in places], np.int64).reshape(len(places), width)
        at = {p: i for i, p in enumerate(places)}
        some = [w for w in windows or () if w[0] in at]
        of = np.array([at[w[0]] for w in some], np.int64)
        blocks[width] = (np.array(places, np.int64), np.array([anchors[p][0] for p in places], np.int64), np.array([anchors[p][1] for p in places], np.int64), q, of, *(np.array([w[k] for w in some], np.int64) for k in (1, 2, 3)))
    sent = spark.sparkContext.broadcast((blocks, windows is None))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks, first_pass = sent.value
        best: dict[tuple[int, int], Best] = defaultdict(lambda: Best(most))
        for batch in batches:
            for rows, ids, labels, q in matrices(batch):
                if (width := q.shape[1]) not in blocks:
                    continue
                _, own, own_labels, anchors, of, _, low, high = blocks[width]
                scores, same = products(q, anchors), labels[:, None] == own_labels
                for at in range(0, len(own) if first_pass else len(of), COLUMNS):
                    some = slice(at, at + COLUMNS)
                    if first_pass:
                        best[width, at].add(scores[:, some], same[:, some] & (rows[:, None] != own[some]), np.arange(len(own))[some], rows, ids)
                    else:
                        part = scores[:, of[some]]
                        best[width, at].add(part, ~same[:, of[some]] & (part >= low[some]) & (part <= high[some]), np.arange(len(of))[some], rows, ids)
        for (width, _), x in best.items():
            places, _, _, _, of, numbers, *_ = blocks[width]
            group, *rest = x.kept
            place = places[group] if first_pass else places[of[group]]
            number = np.zeros(len(group), np.int64) if first_pass else numbers[group]
            yield pa.RecordBatch.from_arrays([pa.array(place.astype(np.int32)), pa.array(number.astype(np.int32)), *map(pa.array, rest)], names=["place", "rank_of", "row", "vec_id", "score"])

    order = Window.partitionBy("place", "rank_of").orderBy(F.desc("score"), "vec_id", "row")
    return candidates.mapInArrow(score, KEPT).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def blocks_of(anchors: DataFrame, block: int) -> Iterator[list]:
    """The rows of anchors, at most `block` at once: they are written as files of so many rows, and read file by file."""
    spark = anchors.sparkSession
    folder = new_folder(spark, "anchors")
    anchors.write.option("maxRecordsPerFile", block).parquet(folder)
    sizes = spark.read.parquet(folder).groupBy(F.input_file_name().alias("file")).agg(F.count("*").alias("n")).orderBy("file")
    some: list[str] = []
    held = 0
    for file, n in sizes.toLocalIterator():
        if some and held + n > block:
            yield spark.read.schema(anchors.schema).parquet(*some).orderBy("row").collect()
            some, held = [], 0
        some.append(file)
        held += n
    if some:
        yield spark.read.schema(anchors.schema).parquet(*some).orderBy("row").collect()


def hard_negatives(vectors: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, least: int = LEAST, most: int = MOST, scale: int = SCALE, block: int = BLOCK) -> DataFrame:
    """RESULT: for each anchor and each of its first positives, the first negatives whose score is least to most per cent of
    the positive's. vectors: vec_id, label, embedding. is_anchor reads vec_id and label."""
    spark = vectors.sparkSession
    folder = new_folder(spark, "vectors")
    prepared(vectors, scale).write.parquet(folder)
    rows = spark.read.parquet(folder)
    results = []
    for held in blocks_of(rows.where((F.col("vec_id") != NO_ID) & is_anchor), block):
        anchors = [(x["row"], x["label"], x["q"]) for x in held]
        found = scored(rows, anchors, None, positives).collect()  # at most block * positives rows
        # Whole numbers: 100 * score lies between least * positive and most * positive.
        limits = [(x["place"], x["rank"], -(-least * x["score"] // 100), most * x["score"] // 100) for x in found]
        windows = [(p, k, max(low, -(2**63)), min(high, NO_ID)) for p, k, low, high in limits if low <= min(high, NO_ID) and high >= -(2**63)]
        if not windows:
            continue
        named = spark.createDataFrame([(x["place"], x["rank"], held[x["place"]]["vec_id"], x["vec_id"], x["score"]) for x in found], "place int, rank_of int, anchor_id long, positive_id long, positive_score long")
        mined = scored(rows, anchors, windows, negatives).join(F.broadcast(named), ["place", "rank_of"])  # block * positives rows
        known = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
        out = new_folder(spark, "negatives")
        mined.select("anchor_id", known("positive_id").alias("positive_id"), "rank", known("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")).write.parquet(out)
        results.append(out)
    return spark.read.schema(RESULT).parquet(*results) if results else spark.createDataFrame([], RESULT)


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(vectors.select("vec_id", shifted.alias("label"), "embedding"), F.col("vec_id") % 50 == 0)


OP12_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS q
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, CAST(list_dot_product(a.q, c.q) AS BIGINT) AS score
  FROM v a JOIN v c ON a.vec_id % 50 = 0 AND a.vec_id <> c.vec_id),
p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, s.vec_id AS negative_id,
  p.positive_score, s.score AS negative_score
FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same
  AND 50 * p.positive_score <= 100 * s.score AND 100 * s.score <= 95 * p.positive_score
WINDOW w AS (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id)
QUALIFY row_number() OVER w <= 3
"""
