"""Matching text against a vocabulary.

A vocabulary is vocab_idx long, value string. Distinct texts are matched once: those that equal an entry (in lower case,
unless case matters) by a hash join, the others by one of two indexes that lose nothing:

- Standard distances: a deletion neighbourhood. Two strings within k edits have a string in common that either becomes
  by leaving out at most k letters, so entries and texts are joined on the hashes of these, and what meets is measured.
  Of longer strings the first and the last END letters stand for the whole. How many entries a text meets depends on
  how many are like it, not on the vocabulary.
- Distances with recognition's confusions: there a deletion list loses matches. A trie of the entries (trie.py) holds a
  row of the distance table for each node, shared by all entries below it and given up where its least cost is over the limit.

Null and empty texts, and all texts where the vocabulary is empty, match nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelloom.functions.distance import confusion_weights, similarity
from labelloom.operators.trie import Trie

#: Entries, and their bytes, that are broadcast at once: in a hash join, and as a trie.
MOST_BROADCAST = 200_000
MOST_BYTES = 20_000_000
#: Letters at both ends of a long string whose deletions stand for it.
END = 12
#: Letters left out at most: beyond, texts and entries meet on their lengths.
MOST_DELETIONS = 3


@dataclass(frozen=True)
class Matcher:
    """What counts as a match. custom: further confusions (c1, c2, weight), with ocr_weights alone."""

    max_distance: int = 2
    min_similarity: float = 0.6
    case_insensitive: bool = True
    ocr_weights: bool = False
    custom: tuple[tuple[str, str, float], ...] = ()

    def norm(self, text: Column) -> Column:
        return F.lower(text) if self.case_insensitive else text


def small(vocabulary: DataFrame, most: int = MOST_BROADCAST, most_bytes: int = MOST_BYTES) -> bool:
    """Is it fit for a broadcast, by rows and by bytes? Counts no further than it must."""
    n, size = vocabulary.limit(most + 1).agg(F.count("*"), F.coalesce(F.sum(F.octet_length("value")), F.lit(0))).first()
    return n <= most and size <= most_bytes


def one_fewer(text: Column) -> Column:
    """Array of the strings that leave out one letter of text; empty for the empty one."""
    places = F.when(F.char_length(text) > 0, F.sequence(F.lit(1), F.char_length(text))).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.concat(text.substr(F.lit(1), i - 1), text.substr(i + 1, F.char_length(text))))


def deletions(text: Column, most: Column, deepest: int) -> Column:
    """Array of the distinct strings that leave out at most `most` letters of text, and no more than deepest."""
    layers = [F.array(text)]
    for depth in range(1, deepest + 1):
        fewer = F.array_distinct(F.flatten(F.transform(layers[-1], one_fewer)))
        layers.append(F.when(most >= depth, fewer).otherwise(F.array().cast("array<string>")))
    return F.concat(*layers)


def neighbourhood(norm: Column, matcher: Matcher) -> Column:
    """Array of the keys under which a string is found: hashes of its deletions. Strings of fewer letters than `whole`
    are meant as wholes, others by their ends; those that a shorter partner may be near to have both kinds of key.

    Leaving letters out of both strings' ends suffices where whole ends are compared: what an alignment of at most k edits
    doesn't pair within the first END letters of both is a letter left out for each edit there, and the same holds for
    the last END letters; in strings of `whole` letters no edit is near both ends.
    """
    k = matcher.max_distance
    whole, n = 2 * (END + k), F.char_length(norm)
    # A distance that the least similarity rules out for these lengths needs no deletions.
    reach = F.least(F.lit(k), F.floor((1 - matcher.min_similarity) * (n + k) + 1e-9).cast("int"))
    ends = F.concat(norm.substr(1, END), norm.substr(n - END + 1, F.lit(END)))
    keys = lambda text, kind: F.transform(deletions(text, reach, k), lambda x: F.xxhash64(F.lit(kind), x))
    none = F.array().cast("array<long>")
    return F.concat(F.when(n < whole + k, keys(norm, "whole")).otherwise(none), F.when(n >= whole, keys(ends, "ends")).otherwise(none))


def met(texts: DataFrame, words: DataFrame, matcher: Matcher) -> DataFrame:
    """Pairs text, norm, vocab_idx, matched, entry that share a key, some more than once. texts: text, norm. words:
    vocab_idx, matched, entry."""
    if matcher.max_distance > MOST_DELETIONS:
        reach = F.sequence(F.char_length("norm") - matcher.max_distance, F.char_length("norm") + matcher.max_distance)
        return texts.select("*", F.explode(reach).alias("key")).join(words.withColumn("key", F.char_length("entry")), "key").drop("key")
    index = words.select("*", F.explode(neighbourhood(F.col("entry"), matcher)).alias("key"))
    return texts.select("*", F.explode(neighbourhood(F.col("norm"), matcher)).alias("key")).join(index, "key").drop("key")


def near_entries(texts: DataFrame, words: DataFrame, matcher: Matcher) -> DataFrame:
    """Standard distances: text, vocab_idx, matched, entry, norm, distance of the pairs within the matcher's distance."""
    pairs = met(texts, words, matcher)
    distance = F.levenshtein("norm", "entry", matcher.max_distance)
    return pairs.withColumn("distance", distance.cast("double")).where("distance >= 0").dropDuplicates(["text", "vocab_idx"])


def shards(words: DataFrame) -> Iterator[list]:
    """The entries in lists of at most about MOST_BROADCAST rows and MOST_BYTES, one at a time."""
    n, size = words.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("entry") + F.octet_length("matched")), F.lit(0))).first()
    parts = max(1, -(-n // MOST_BROADCAST), -(-size // MOST_BYTES))
    for part in range(parts):
        yield words.where(F.pmod(F.xxhash64("vocab_idx"), F.lit(parts)) == part).select("vocab_idx", "matched", "entry").collect()


def near_in_trie(texts: DataFrame, words: DataFrame, matcher: Matcher) -> DataFrame:
    """Distances with confusions: as near_entries. Each shard of the vocabulary goes to all tasks as a trie; a vocabulary
    that fits a broadcast is one shard."""
    spark = texts.sparkSession
    found = spark.createDataFrame([], "text string, norm string, vocab_idx long, matched string, entry string, distance double")
    for rows in shards(words):
        sent = spark.sparkContext.broadcast((Trie([r["entry"] for r in rows], confusion_weights(matcher.custom)), [(r["vocab_idx"], r["matched"], r["entry"]) for r in rows]))

        def search(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            trie, entries = sent.value
            for batch in batches:
                out = [(text, norm, *entries[i], d) for text, norm in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for i, d in trie.near(norm, matcher.max_distance)]
                each = list(zip(*out)) or [()] * 6
                kinds = (pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(each, kinds)], names=["text", "norm", "vocab_idx", "matched", "entry", "distance"])

        found = found.unionByName(texts.select("text", "norm").mapInArrow(search, found.schema))
    return found


def candidates(texts: DataFrame, vocabulary: DataFrame, matcher: Matcher = Matcher()) -> DataFrame:
    """text, vocab_idx, matched, distance, similarity: all entries within the matcher's limits of distinct texts."""
    words = vocabulary.where("value is not null").select("vocab_idx", F.col("value").alias("matched"), matcher.norm(F.col("value")).alias("entry"))
    normed = texts.select("text", matcher.norm(F.col("text")).alias("norm"))
    pairs = near_in_trie(normed, words, matcher) if matcher.ocr_weights else near_entries(normed, words, matcher)
    pairs = pairs.withColumn("similarity", similarity(F.col("distance"), F.col("norm"), F.col("entry")))
    return pairs.where(F.col("similarity") >= matcher.min_similarity).select("text", "vocab_idx", "matched", "distance", "similarity")


def distinct_texts(df: DataFrame, column: str) -> DataFrame:
    return df.select(F.col(column).alias("text")).where("text is not null and text <> ''").distinct()


def best_matches(df: DataFrame, vocabulary: DataFrame, matcher: Matcher = Matcher(), column: str = "text") -> DataFrame:
    """Text, matched, distance, similarity for the distinct texts that match. An entry that equals the text comes
    before all others; then the smallest distance, then the first in the vocabulary (O3)."""
    texts = distinct_texts(df, column)
    words = vocabulary.select("vocab_idx", F.col("value").alias("matched"), matcher.norm(F.col("value")).alias("norm"))
    firsts = words.groupBy("norm").agg(F.min_by("matched", "vocab_idx").alias("matched"))
    firsts = F.broadcast(firsts) if small(vocabulary) else firsts
    known = texts.withColumn("norm", matcher.norm(F.col("text"))).join(firsts, "norm", "left")
    exact = known.where("matched is not null").select("text", "matched", F.lit(0.0).alias("distance"), F.lit(1.0).alias("similarity"))
    rest = known.where("matched is null").select("text")
    near = candidates(rest, vocabulary, matcher).groupBy("text").agg(F.min_by(F.struct("matched", "distance", "similarity"), F.struct("distance", "vocab_idx")).alias("m"))
    return exact.unionByName(near.select("text", "m.*"))


def match(df: DataFrame, vocabulary: DataFrame, matcher: Matcher = Matcher(), column: str = "text") -> DataFrame:
    """df with matched, distance, similarity; null where nothing matches."""
    return df.join(best_matches(df, vocabulary, matcher, column).withColumnRenamed("text", column), column, "left")


def top_matches(df: DataFrame, vocabulary: DataFrame, matcher: Matcher = Matcher(), most: int = 5, column: str = "text") -> DataFrame:
    """Text, rank, matched, distance, similarity: the `most` nearest entries of each distinct text."""
    order = Window.partitionBy("text").orderBy("distance", "vocab_idx")
    return candidates(distinct_texts(df, column), vocabulary, matcher).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most).select("text", "rank", "matched", "distance", "similarity")


def correct(df: DataFrame, vocabulary: DataFrame, matcher: Matcher = Matcher(), column: str = "text") -> DataFrame:
    """Df with column corrected; a text at distance 0 keeps its own spelling. Adds matched, distance, similarity."""
    found = match(df, vocabulary, matcher, column)
    return found.withColumn(column, F.when(F.col("distance") > 0, F.col("matched")).otherwise(F.col(column)))


def match_class(text: Column, distance: Column) -> Column:
    """Corrected, exact or none; blank texts are none."""
    return F.when((F.coalesce(F.trim(text), F.lit("")) == "") | distance.isNull(), F.lit("none")).when(distance > 0, F.lit("corrected")).otherwise(F.lit("exact"))


def match_statistics(matched: DataFrame, image: str = "image_id", text: str = "text") -> DataFrame:
    """One row: corrected, exact, no_match, images_modified. matched: the result of match()."""
    kind = match_class(F.col(text), F.col("distance"))
    return matched.agg(F.count_if(kind == "corrected").alias("corrected"), F.count_if(kind == "exact").alias("exact"), F.count_if(kind == "none").alias("no_match"), F.count_distinct(F.when(kind == "corrected", F.col(image))).alias("images_modified"))
