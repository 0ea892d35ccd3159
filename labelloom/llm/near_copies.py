"""Near copies by the Jaccard similarity of word shingles: linked from SIMILAR on, the first row of each component stays.

Words are those of simhash; a text's set holds the XXH64 hashes of its shingles of WIDTH words (fewer words: the whole
sequence; none: an empty set, equal to other empty ones alone). Equal sets are one node from the start.

Candidates meet in two ways. By simhash.py's method: the shingles' hashes make a fingerprint, and ball hashing links those
within 3 bits. At 0.8 fingerprints differ in 10 of 64 bits on average, so of pairs near the limit that finds few. Those
meet on one of BANDS bands of ROWS minima each: a pair of similarity s meets on none with probability (1 - s**4)**32, 5e-8
at 0.8. Of a candidate, however found, first the minima's low bytes must agree in enough places (at 0.8, less than one in
a billion fails), then the exact similarity of the shingles decides.

Crowds on one band are compared as crowds.py tells. The node with the largest share of shingles that others of the
crowds have too is the most central; nodes whose own shingles rule a similarity with any other out go no further.

Rows are told apart by doc_id and all their columns. A null text is an empty one. The first row of a component is that
of the smallest doc_id (null last) and row hash; of rows that are equal in all columns one stays. An empty table gives
an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelloom.llm.common import checkpoint, firsts_of, map_batches, row_hash, text_or_empty, utf8
from labelloom.llm.crowds import Compare, meeting_roots
from labelloom.llm.simhash import SEED, fingerprint_of, links_of

WIDTH = 5
SIMILAR = 0.8
BANDS = 32
ROWS = 4
#: Places in which the low bytes of two texts' minima agree at least, as a share of the similarity asked for.
AGREE = 0.7
#: Shingles whose minima are taken at once.
AT_ONCE = 4096

_mixers = np.random.default_rng(SEED)
MASKS = _mixers.integers(0, 2**64, (BANDS * ROWS, 1), np.uint64)
FACTORS = _mixers.integers(0, 2**64, (BANDS * ROWS, 1), np.uint64) | np.uint64(1)
FOLD = np.uint64(0x9E3779B97F4A7C15)


def shingle_hashes(text: bytes, width: int = WIDTH) -> np.ndarray:
    """Hashes of the shingles, repeats included, in their order."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    return np.array([xxh64_intdigest(b" ".join(words[i : i + width]), SEED) for i in range(max(1, len(words) - width + 1))], np.uint64)


def shingle_set(text: bytes, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct hashes of the shingles."""
    return np.unique(shingle_hashes(text, width))


def minima(hashes: np.ndarray) -> np.ndarray:
    """BANDS * ROWS minima of differently mixed hashes."""
    out = np.full(BANDS * ROWS, 2**64 - 1, np.uint64)
    for at in range(0, len(hashes), AT_ONCE):
        out = np.minimum(out, ((hashes[at : at + AT_ONCE] ^ MASKS) * FACTORS).min(axis=1))
    return out


def band_keys(least: np.ndarray) -> np.ndarray:
    """A long for each band and its ROWS minima."""
    keys = np.arange(1, BANDS + 1, dtype=np.uint64)
    for column in least.reshape(BANDS, ROWS).T:
        keys = (keys ^ column) * FOLD
        keys ^= keys >> np.uint64(29)
    return keys.view(np.int64)


def similar(a: np.ndarray, b: np.ndarray, least: float) -> bool:
    """Is the Jaccard similarity of two sets of sorted hashes `least` or more? Two empty sets are equal."""
    if not len(a) or not len(b):
        return len(a) == len(b)
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= least * (len(a) + len(b) - both) - 1e-9


def shingled(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, row (the row's hash), node (the set's hash), sketch (low bytes of the minima), bands, fp (the fingerprint)."""

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            nodes: list[int] = []
            prints: list[int] = []
            sketches: list[bytes] = []
            bands: list[np.ndarray] = [np.zeros(0, np.int64)]
            for text in utf8(batch.column(2)):
                every = shingle_hashes(text, width)
                hashes = np.unique(every)
                least = minima(hashes)
                prints.append(fingerprint_of(every))
                nodes.append(xxh64_intdigest(hashes.tobytes(), SEED))
                sketches.append(least.astype(np.uint8).tobytes())
                bands.append(band_keys(least))
            offsets = pa.array(np.arange(0, BANDS * (len(nodes) + 1), BANDS, dtype=np.int32))
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.array(nodes, np.uint64).view(np.int64)), pa.array(sketches, pa.binary()), pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(bands))), pa.array(np.array(prints, np.uint64).view(np.int64))], names=["doc_id", "row", "node", "sketch", "bands", "fp"])

        return one

    few = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_hash(docs).alias("row"), text_or_empty().alias("text"))
    return map_batches(few, make, "doc_id long, row long, node long, sketch binary, bands array<long>, fp long")


def shingles_of(docs: DataFrame, sets: DataFrame, nodes: DataFrame, width: int) -> DataFrame:
    """node, shingles (the sorted hashes, as bytes) of some nodes. sets: as of shingled(docs)."""
    rows = checkpoint(sets.join(nodes, "node", "left_semi").groupBy("node").agg(F.min(F.struct("doc_id", "row")).alias("x")).select(F.col("x.doc_id").alias("of_id"), F.col("x.row").alias("of_row")))
    holds = docs["doc_id"].cast("long").eqNullSafe(rows["of_id"]) & (row_hash(docs) == rows["of_row"])

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [shingle_set(x, width).tobytes() for x in utf8(batch.column(0))]
            return pa.RecordBatch.from_arrays([pa.array(np.array([xxh64_intdigest(x, SEED) for x in found], np.uint64).view(np.int64)), pa.array(found, pa.binary())], names=["node", "shingles"])

        return one

    texts = docs.join(rows, holds, "left_semi").select(text_or_empty().alias("text"))
    return map_batches(texts, make, "node long, shingles binary").dropDuplicates(["node"])


def beside(pairs: DataFrame, of_node: DataFrame, name: str) -> DataFrame:
    """pairs (a, b) with a column of both nodes."""
    for side in ("a", "b"):
        pairs = pairs.join(of_node.select(F.col("node").alias(side), F.col(name).alias(f"{name}_{side}")), side)
    return pairs.select("a", "b", f"{name}_a", f"{name}_b")


def verified(pairs: DataFrame, sketches: DataFrame, shingles: DataFrame, least: float) -> DataFrame:
    """Those of pairs (a, b) of nodes whose shingles are similar."""

    def agree() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(-1, BANDS * ROWS) for i in (2, 3))
            some = pa.array((x == y).sum(axis=1) >= AGREE * least * BANDS * ROWS)
            return pa.RecordBatch.from_arrays([batch.column(0).filter(some), batch.column(1).filter(some)], names=["a", "b"])

        return one

    def decide() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            sides = [[np.frombuffer(x, np.uint64) for x in batch.column(i).to_pylist()] for i in (2, 3)]
            some = pa.array([similar(x, y, least) for x, y in zip(*sides)], pa.bool_())
            return pa.RecordBatch.from_arrays([batch.column(0).filter(some), batch.column(1).filter(some)], names=["a", "b"])

        return one

    close = checkpoint(map_batches(beside(pairs, sketches, "sketch"), agree, "a long, b long"))
    return map_batches(beside(close, shingles, "shingles"), decide, "a long, b long")


def central(members: DataFrame, shingles: DataFrame, least: float) -> DataFrame:
    """members of crowds with a column centre: the share of a node's shingles that another node of a crowd has too.
    Where that share is below `least`, no node of a crowd is similar, and the member is left out."""

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            each = [np.frombuffer(x, np.int64) for x in batch.column(1).to_pylist()]
            nodes = np.repeat(np.asarray(batch.column(0)), [len(x) for x in each])
            return pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(np.concatenate([np.zeros(0, np.int64), *each]))], names=["node", "shingle"])

        return one

    nodes = members.select("node").distinct()
    each = checkpoint(map_batches(shingles.join(nodes, "node", "left_semi").select("node", "shingles"), make, "node long, shingle long"))
    alone = each.groupBy("shingle").agg(F.min("node").alias("node"), F.count("*").alias("n")).where("n = 1").groupBy("node").agg(F.count("*").alias("alone"))
    shares = each.groupBy("node").agg(F.count("*").alias("size")).join(alone, "node", "left").select("node", (1 - F.coalesce("alone", F.lit(0)) / F.col("size")).alias("centre"))
    return members.join(shares, "node").where(F.col("centre") >= least - 1e-9)


def comparing(least: float) -> Callable[[], Compare]:
    """Compares sketches first, then shingles; data is the one and the other."""

    def make() -> Compare:
        def compare(xs: list[bytes], ys: list[bytes]):
            width = BANDS * ROWS
            heads = [np.frombuffer(b"".join(x[:width] for x in side), np.uint8).reshape(-1, width) for side in (xs, ys)]
            agree = np.stack([(heads[1] == x).sum(axis=1) for x in heads[0]]) if len(xs) and len(ys) else np.zeros((0, 0), int)
            sets = [[np.frombuffer(x, np.uint64, offset=width) for x in side] for side in (xs, ys)]
            return zip(*map(list, np.nonzero(agree >= AGREE * least * width))), lambda i, j: similar(sets[0][i], sets[1][j], least)

        return compare

    return make


def ball_pairs(sets: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes, a < b, whose fingerprints are equal or linked by their balls; of each fingerprint, one node stands
    for the others. sets: as of shingled."""
    prints = checkpoint(sets.select("fp", "node").distinct())
    of = checkpoint(prints.groupBy("fp").agg(F.min("node").alias("first")))
    equal = prints.join(of.hint("merge"), "fp").select(F.col("first").alias("x"), F.col("node").alias("y"))
    near = links_of(of.select("fp"))
    for side, name in (("a", "x"), ("b", "y")):
        near = near.join(of.select(F.col("fp").alias(side), F.col("first").alias(name)).hint("merge"), side)
    return equal.unionByName(near.select("x", "y")).where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def similar_nodes(docs: DataFrame, sets: DataFrame, width: int = WIDTH, least: float = SIMILAR) -> DataFrame:
    """node, root: components of the nodes that another one is similar to."""
    emitted = sets.select("node", F.explode("bands").alias("key")).distinct()
    keys = emitted.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("low")).where("n > 1")
    met = checkpoint(emitted.join(keys, "key"))
    balls = checkpoint(ball_pairs(sets))
    nodes = met.select("node").unionByName(balls.select(F.explode(F.array("a", "b")).alias("node"))).distinct()
    sketches = checkpoint(sets.join(nodes, "node", "left_semi").groupBy("node").agg(F.first("sketch").alias("sketch")))
    shingles = checkpoint(shingles_of(docs, sets, nodes, width))
    data = sketches.join(shingles, "node").select("node", F.concat("sketch", "shingles").alias("data"))
    return meeting_roots(met, lambda pairs: verified(pairs, sketches, shingles, least), F.lit(True), lambda x: central(x, shingles, least), data, comparing(least), balls)


def keep_first_similar(docs: DataFrame, width: int = WIDTH, least: float = SIMILAR) -> DataFrame:
    """docs without the rows that aren't the first of their component; columns as they are."""
    sets = checkpoint(shingled(docs, width))
    roots = similar_nodes(docs, sets, width, least)
    classed = sets.select("doc_id", "row", "node").join(roots, "node", "left").select("doc_id", "row", F.coalesce("root", "node").alias("class"))
    return firsts_of(docs, classed)
