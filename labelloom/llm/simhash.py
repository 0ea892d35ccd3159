"""SimHash near-duplicates: fingerprints of word shingles, linked within a Hamming radius of 3.

Words are runs of no ASCII white space, A-Z lower-cased; shingles are three words joined by a space (fewer words: the
whole sequence), each hashed by XXH64 with seed 42. A bit of the fingerprint is set if it is set in over half of the
hashes.

Linking meets in the middle, twice. Two fingerprints within 3 bits agree within 1 bit on one of their 32-bit halves:
each emits its halves' variants within half the radius (1 bit), and only fingerprints that meet on such a variant go on.
Where few meet, they are compared there. Where many do, they emit whole variants: if two differ in 3 bits, one of them has two of these bits clear, so flipping
two clear bits of it (one or none, if they differ in fewer) and one bit of the other meets at one variant. All that
meet at a variant which some fingerprint reaches by one flip or none are within 3 bits of that fingerprint: they are
verified by that, and linked to it as a star, never as pairs.

A null text has no words, and no words give fingerprint zero, linked like any other. Equal fingerprints are one node
from the start. Rows of an equal doc_id each count; a null doc_id never is a component's id unless it is alone. An
empty table gives an empty result; columns other than doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labelloom.llm.common import checkpoint, firsts_of, map_batches, row_hash, table, text_or_empty, utf8
from labelloom.llm.crowds import components

SHINGLE = 3
SEED = 42
RADIUS = 3
#: Hashes that are unpacked to bits at once.
AT_ONCE = 16384
#: Meetings on one variant up to which pairs are compared.
FEW = 64


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """Unsigned 64 bits."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    counts = np.zeros(64, np.int64)
    for at in range(0, n, AT_ONCE):
        counts += bits_set(np.array([xxh64_intdigest(b" ".join(words[i : i + shingle]), SEED) for i in range(at, min(n, at + AT_ONCE))], np.uint64))
    return majority(counts, n)


def bits_set(hashes: np.ndarray) -> np.ndarray:
    """In how many hashes each of 64 bits is set, the highest first."""
    return np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)


def majority(counts: np.ndarray, n: int) -> int:
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big")


def fingerprint_of(hashes: np.ndarray) -> int:
    """Of shingles' hashes, repeats included; none: 0."""
    return majority(sum((bits_set(hashes[at : at + AT_ONCE]) for at in range(0, len(hashes), AT_ONCE)), np.zeros(64, np.int64)), len(hashes))


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, row (the row's hash), fp: the fingerprint's 64 bits as a long."""

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = np.array([fingerprint(x, shingle) for x in utf8(batch.column(2))], np.uint64).view(np.int64)
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found)], names=["doc_id", "row", "fp"])

        return one

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_hash(docs).alias("row"), text_or_empty().alias("text")), make, "doc_id long, row long, fp long")


def flips(value: Column, bits: range, clear_only: bool = False) -> Column:
    """The array of value with each one of bits flipped (clear ones alone, or all)."""
    masks = F.array(*(F.lit(1 << b if b < 63 else -(1 << 63)) for b in bits))
    chosen = F.filter(masks, lambda m: value.bitwiseAND(m) == 0) if clear_only else masks
    return F.transform(chosen, lambda m: value.bitwiseXOR(m))


def meetings(nodes: DataFrame) -> DataFrame:
    """fp, high, half, n: the variants of nodes' halves on which n > 1 emissions of different nodes meet."""

    def variants(high: bool) -> Column:
        half = F.shiftrightunsigned("fp", 32 if high else 0).bitwiseAND(F.lit(0xFFFFFFFF))
        # If two halves differ in one bit, it is clear in one of them.
        return F.transform(F.concat(F.array(half), flips(half, range(32), clear_only=True)), lambda x: F.struct(F.lit(high).alias("high"), x.alias("half")))

    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = nodes.repartition(parts, F.xxhash64("fp"))  # few bytes come in, many rows go out: as many tasks as the shuffle has
    emitted = spread.select("fp", F.explode(F.concat(variants(True), variants(False))).alias("v")).select("fp", "v.high", "v.half")
    met = emitted.groupBy("high", "half").agg(F.min("fp").alias("a"), F.max("fp").alias("b"), F.count("*").alias("n")).where("a <> b").select("high", "half", "n")
    return emitted.join(met.hint("merge"), ["high", "half"])


def near_pairs(met: DataFrame) -> DataFrame:
    """Links (a, b) within RADIUS bits among those that meet on one variant; for variants of few meetings."""
    bits = lambda x, y: F.bit_count(x.bitwiseXOR(y)) <= RADIUS
    pairs = F.flatten(F.transform("fps", lambda x: F.transform(F.filter("fps", lambda y: (x < y) & bits(x, y)), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    return met.groupBy("high", "half").agg(F.collect_set("fp").alias("fps")).select(F.explode(pairs).alias("x")).select("x.a", "x.b")


def links_of(nodes: DataFrame) -> DataFrame:
    """Links whose components are those of all pairs within RADIUS bits. Where at most FEW meet on a variant, pairs are
    compared; the nodes of all other variants go on as stars, so that no large group is paired or held."""
    met = checkpoint(meetings(nodes))
    many = met.where(F.col("n") > FEW).select("fp").distinct()
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return near_pairs(met.where(F.col("n") <= FEW)).unionByName(stars(many.repartition(parts, F.xxhash64("fp")))).distinct()


def stars(nodes: DataFrame) -> DataFrame:
    """Links (a, b), a < b, whose components are those of all pairs within 3 bits; linear in what is emitted."""
    fp = F.col("fp")
    one = F.concat(F.array(fp), flips(fp, range(64)))
    two = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(62)), lambda i: F.transform(F.filter(F.sequence(i + 1, F.lit(63)), lambda j: fp.bitwiseAND(bit(i).bitwiseOR(bit(j))) == 0), lambda j: fp.bitwiseXOR(bit(i)).bitwiseXOR(bit(j)))))
    emitted = nodes.select("fp", one.alias("near"), two.alias("far")).select("fp", F.explode(F.concat(F.transform("near", lambda v: F.struct(v.alias("v"), F.lit(True).alias("near"))), F.transform("far", lambda v: F.struct(v.alias("v"), F.lit(False).alias("near"))))).alias("x")).select("fp", "x.v", "x.near")
    met = emitted.groupBy("v").agg(F.min("fp").alias("a"), F.max("fp").alias("b"), F.max("near").alias("near")).where("near and a <> b").select("v", "a")
    return emitted.join(met.hint("merge"), "v").where("a < fp").select("a", F.col("fp").alias("b")).distinct()


def bit(i: Column) -> Column:
    """1 << i for a column i, as a look-up."""
    return F.get(F.array(*(F.lit(1 << b if b < 63 else -(1 << 63)) for b in range(64))), i)


def simhash_components(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, row, fp, component_id, root (the component's smallest fingerprint); a row for each row of docs."""
    prints = checkpoint(fingerprints(docs, shingle))
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(links_of(nodes.select("fp")))
    # Merged: these sides grow with the documents.
    of = checkpoint(nodes.join(roots.withColumnRenamed("node", "fp").hint("merge"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "least"))
    known = of.join(of.groupBy("root").agg(F.min("least").alias("component_id")).hint("merge"), "root").select("fp", "root", "component_id")
    return prints.join(known.hint("merge"), "fp").select("doc_id", "row", "fp", "component_id", "root")


def keep_first(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """The first row of each component, as of firsts_of."""
    return firsts_of(docs, checkpoint(simhash_components(docs, shingle)).select("doc_id", "row", F.col("root").alias("class")))


def hex_digits(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents")).select("doc_id", hex_digits(F.col("fp")).alias("fingerprint"), "component_id")
