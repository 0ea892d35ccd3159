"""Quality classifier: ridge regression on random Fourier features of document statistics, calibrated.

A document's statistics (shares of kinds of characters, repeats, lengths) are standardised; cosines of random
projections of them approximate a Gaussian kernel. Labelled rows add their outer products within each partition, in
whole numbers (so that the sums don't depend on their order), the sums are solved for ridge weights, and isotonic
regression over a fixed grid of raw scores turns these into shares of label 1. No other column than the text enters.

All labelled rows of the training folds are used. Null texts are empty texts and get a score like any other. A label
other than 0 or 1, or of a doc_id without document, is not used; of repeated rows each counts. Without any label all
scores are 0.5. An empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labelloom.llm.common import bounded_batches, checkpoint, map_batches, table, text_or_empty

FEATURES = 192
RIDGE = 1e-3
SEED = 20
GRID = 1024
WHOLE = 4096
REJECT = 0.3

#: Bytes that are counted one by one, besides the kinds below.
MARKS = b".,!?#$%&*|@/:;\"'()-_<>=+"


def kinds() -> np.ndarray:
    """(256, k): for each byte, the kinds it belongs to."""
    x = np.arange(256)
    rows = [(x >= 97) & (x <= 122), (x >= 65) & (x <= 90), (x >= 48) & (x <= 57), x == 32, x == 10, (x < 32) & (x != 10), x >= 128, *(x == m for m in MARKS)]
    return np.stack(rows, axis=1).astype(np.float64)


KINDS = kinds()
N_STATS = KINDS.shape[1] + 8


def statistics(texts: list[str]) -> np.ndarray:
    """(n, N_STATS) of whole texts."""
    out = np.zeros((len(texts), N_STATS))
    for i, text in enumerate(texts):
        data = np.frombuffer(text.encode(), np.uint8)
        n = len(data)
        if not n:
            continue
        shares = np.bincount(data, minlength=256) @ KINDS / n
        words, lines = text.split(), text.split("\n")
        w = max(1, len(words))
        out[i, : len(shares)] = np.sqrt(shares)
        out[i, len(shares) :] = (
            np.log1p(n),
            np.log1p(len(words)),
            np.sqrt(np.count_nonzero(data[1:] == data[:-1]) / n),
            len(set(words)) / w,
            np.log1p(n / w),
            1 - len(set(lines)) / len(lines),
            np.log1p(n / len(lines)),
            shares[1] / max(1e-9, shares[0] + shares[1]),
        )
    return out


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    scale: np.ndarray
    project: np.ndarray
    phase: np.ndarray
    weights: np.ndarray | None
    knots: np.ndarray
    values: np.ndarray

    def cosines(self, stats: np.ndarray) -> np.ndarray:
        """Random Fourier features in whole numbers, and a constant."""
        z = np.cos(np.clip((stats - self.mean) / self.scale, -8, 8) @ self.project + self.phase)
        return np.hstack([np.rint(z * WHOLE), np.full((len(z), 1), WHOLE)])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.cosines(stats) / WHOLE @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        """Calibrated; a thousandth comes from the raw score itself, which orders what calibration holds equal."""
        if self.weights is None:
            return np.full(len(stats), 0.5)
        raw = self.raw(stats)
        return np.round(0.999 * np.interp(raw, self.knots, self.values) + 0.001 * np.clip((raw + 1) / 3, 0, 1), 9)


def grid(raw: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(raw * GRID), -GRID, 2 * GRID).astype(np.int64)


def isotonic(x: np.ndarray, n: np.ndarray, ones: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pooled adjacent violators; the blocks' mean places and their shares of ones."""
    blocks: list[list[float]] = []
    for a, b, c in zip(x, n, ones):
        blocks.append([a * b, b, c])
        while len(blocks) > 1 and blocks[-2][2] * blocks[-1][1] >= blocks[-1][2] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], last)]
    s = np.array(blocks)
    return s[:, 0] / s[:, 1], s[:, 2] / s[:, 1]


def text_statistics(docs: DataFrame) -> DataFrame:
    """doc_id, stats."""

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            stats = statistics([x or "" for x in batch.column(1).to_pylist()]).astype(np.float32)
            column = pa.ListArray.from_arrays(pa.array(np.arange(0, stats.size + 1, N_STATS, dtype=np.int32)), pa.array(stats.reshape(-1)))
            return pa.RecordBatch.from_arrays([batch.column(0), column], names=["doc_id", "stats"])

        return one

    few = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return map_batches(few, make, "doc_id long, stats array<float>")


def matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=np.float64).reshape(-1, N_STATS)


def fit(stats: DataFrame, labels: DataFrame, features: int = FEATURES, ridge: float = RIDGE, seed: int = SEED) -> Model:
    """stats: doc_id, stats; labels: doc_id, label (0 or 1), of the training folds alone. What comes to the driver is
    sums: (features + 1) squared, and the grid of raw scores."""
    known = labels.where(F.col("label").isin(0, 1)).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("label").cast("double").alias("label"))
    rows = checkpoint(stats.join(known, "doc_id").select("stats", "label"))
    moments = rows.select(*(f(F.get("stats", F.lit(i)).cast("double")).alias(f"{k}{i}") for i in range(N_STATS) for k, f in (("m", F.avg), ("s", F.stddev_pop)))).first()
    rng = np.random.default_rng(seed)
    project, phase = rng.normal(size=(N_STATS, features)) / np.sqrt(N_STATS), rng.uniform(0, 2 * np.pi, features)
    if moments is None or moments["m0"] is None:
        return Model(np.zeros(N_STATS), np.ones(N_STATS), project, phase, None, np.zeros(1), np.full(1, 0.5))
    mean = np.array([float(f"{moments[f'm{i}']:.5g}") for i in range(N_STATS)])
    scale = np.array([float(f"{max(moments[f's{i}'], 0.01):.3g}") for i in range(N_STATS)])
    bare = Model(mean, scale, project, phase, None, np.zeros(1), np.full(1, 0.5))

    def sums(batches):
        total = np.zeros((features + 1, features + 2))
        for batch in batches:
            if batch.num_rows:
                z = bare.cosines(matrix(batch.column(0)))
                total += z.T @ np.hstack([z, np.asarray(batch.column(1))[:, None]])
        width = features + 2
        cells = pa.ListArray.from_arrays(pa.array(np.arange(0, total.size + 1, width, dtype=np.int32)), pa.array(total.reshape(-1).astype(np.int64)))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(features + 1, dtype=np.int32)), cells], names=["i", "cells"])

    added = rows.mapInArrow(sums, "i int, cells array<long>").select("i", F.posexplode("cells").alias("j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v")).toPandas()
    total = np.zeros((features + 1, features + 2))
    total[added.i, added.j] = added.v
    gram, right = total[:, :-1] / WHOLE**2, total[:, -1] / WHOLE
    weights = np.linalg.solve(gram + ridge * max(1.0, gram[-1, -1]) * np.eye(features + 1), right)
    ready = Model(mean, scale, project, phase, weights, bare.knots, bare.values)

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        return lambda batch: pa.RecordBatch.from_arrays([pa.array(grid(ready.raw(matrix(batch.column(0))))), batch.column(1)], names=["bin", "label"])

    bins = map_batches(rows, make, "bin long, label double").groupBy("bin").agg(F.count("*").alias("n"), F.sum("label").alias("ones")).orderBy("bin").toPandas()
    knots, values = isotonic(bins.bin.to_numpy() / GRID, bins.n.to_numpy(), bins.ones.to_numpy())
    return Model(mean, scale, project, phase, weights, knots, values)


def held_out(doc_id: Column) -> Column:
    """The fifth of all documents whose labels are never learned."""
    return F.crc32(doc_id.cast("string")) % 5 == 0


def score(stats: DataFrame, model: Model) -> DataFrame:
    """doc_id, score."""

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        return lambda batch: pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(matrix(batch.column(1))))], names=["doc_id", "score"])

    return map_batches(stats.select("doc_id", "stats"), make, "doc_id long, score double")


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted. labels: doc_id, quality. A null doc_id is not held out."""
    stats = checkpoint(text_statistics(docs))
    learned = labels.where(~held_out(F.col("doc_id"))).select("doc_id", F.col("quality").alias("label"))
    scored = score(stats, fit(stats, learned))
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= REJECT).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: Model, least: float = REJECT) -> DataFrame:
    """The rows of docs whose texts score at least `least`; all columns as they are, no shuffle."""
    bounded_batches(docs.sparkSession)

    @F.pandas_udf("double")
    def scored(texts):
        import pandas as pd

        return pd.Series(model.score(statistics(list(texts)).astype(np.float32).astype(np.float64)) if len(texts) else [], dtype=float)

    return docs.where(scored(text_or_empty()) >= least)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
