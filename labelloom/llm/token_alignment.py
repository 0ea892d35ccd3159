"""Cross-tokenizer alignment through a dictionary of groups.

A text's tokens of two vocabularies, A (byte-level BPE) and B (a sentence-piece model with byte fallback), are laid over
the same bytes: a space and the text. Offsets where tokens of both end cut them into groups; tokens of one group alone
overlap, so a group's links (pairs of an A and a B token that share a byte) follow from its ids. Groups are interned:

1. Each task interns the groups of its documents, expands the links of a group when it is first met, and counts, for each pair
   of ids, the documents that hold it linked. A document is one task's, so the sums over tasks are the corpus-wide counts.
2. Links are expanded once for each distinct group of the corpus and joined with the counts: a group's sum of counts and
   its number of best links (those with the highest count of their A id).
3. Those come back by group key to the chunks of documents that hold the group, where they are multiplied by its frequencies.

What is shuffled is distinct groups for each chunk of documents, not occurrences. Texts are encoded whole, and all steps from
tokens to group numbers go over many texts at once: a group is told by two 64-bit hashes of its ids. A text whose tokens
don't give its bytes back, as one with U+2581, has no tokens; neither has a null or an empty one. Rows are told apart
by nothing: each row has its result, and a repeated row counts as a document of its own. An empty table gives an empty
result. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
import json
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelloom.llm.common import bounded_batches, new_folder, table

TOKENIZER_A = "byte_bpe_50k.json"
TOKENIZER_B = "piece_bpe_32k.model"
#: Bytes of text whose documents are one chunk, besides the last document's.
CHUNK_BYTES = 8 << 20
#: Characters of the texts that are grouped at once.
AT_ONCE = 2 << 20
#: Groups that a task keeps before it begins anew.
KEPT_GROUPS = 300_000
#: Fixed value: how byte-level BPE splits a text into pre-tokens.
SPLIT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
BLANK = "▁"
#: Of the marks that stand for ids in hashes; and their odd multipliers, one for each of the two hashes.
SEED = 42
STEPS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)

ENCODED = "chunk long, doc_id long, n_a int, n_b int, groups_sha256 string, groups array<int>, names array<string>, pairs array<struct<a: int, b: int, docs: int>>"
ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


class Tokenizers:
    """Ids of both vocabularies and the bytes that an id stands for."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True  # their strings in a text are plain text
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        # The byte-level alphabet: visible Latin-1 characters stand for themselves, other bytes for those from 256 on.
        seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
        other = [x for x in range(256) if x not in set(seen)]
        byte_of = {chr(x): x for x in seen} | {chr(256 + i): x for i, x in enumerate(other)}
        self.bytes_a = [b""] * self.a.get_vocab_size(with_added_tokens=True)
        for token, i in self.a.get_vocab(with_added_tokens=True).items():
            self.bytes_a[i] = bytes(map(byte_of.__getitem__, token)) if all(x in byte_of for x in token) else token.encode()
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(BLANK, " ").encode() for i, p in ((i, self.b.id_to_piece(i)) for i in range(self.b.get_piece_size()))]
        self.sizes = [np.array([len(x) for x in each], np.int64) for each in (self.bytes_a, self.bytes_b)]
        self.marks = [np.random.default_rng(SEED).integers(0, 2**64, (2, len(x)), np.uint64) for x in self.sizes]
        self.ids_a = self.ranked() or (lambda text: self.a.encode(text, add_special_tokens=False).ids)

    def ranked(self) -> Callable[[str], list[int]] | None:
        """Where ids are the order of the merges, after those of the bytes, a ranked encoder gives the same ids in less time."""
        import tiktoken

        made = json.loads(self.a.to_str())
        level, vocab = made.get("pre_tokenizer") or {}, made["model"]["vocab"]
        merges = [tuple(x.split(" ")) if isinstance(x, str) else tuple(x) for x in made["model"].get("merges", ())]
        plain = level.get("type") == "ByteLevel" and level.get("use_regex", True) and not level.get("add_prefix_space") and not made.get("normalizer")
        if not plain or not all(vocab.get(x + y) == 256 + i for i, (x, y) in enumerate(merges)) or len(vocab) < 256 + len(merges):
            return None
        return tiktoken.Encoding("ranked", pat_str=SPLIT, mergeable_ranks={x: i for i, x in enumerate(self.bytes_a[: 256 + len(merges)])}, special_tokens={}).encode_ordinary

    def encode(self, text: str) -> tuple[list[int], list[int]]:
        return self.ids_a(" " + text), self.b.encode(text)

    def links(self, group: str) -> list[tuple[int, int]]:
        """The pairs of ids whose bytes overlap, one for each pair of tokens."""
        ids_a, ids_b = ([int(x) for x in side.split(",")] for side in group.split("|"))
        i = j = 0
        end_a, end_b = len(self.bytes_a[ids_a[0]]), len(self.bytes_b[ids_b[0]])
        found = [(ids_a[0], ids_b[0])]
        while i + 1 < len(ids_a) or j + 1 < len(ids_b):
            if end_a < end_b:
                i += 1
                end_a += len(self.bytes_a[ids_a[i]])
            else:
                j += 1
                end_b += len(self.bytes_b[ids_b[j]])
            found.append((ids_a[i], ids_b[j]))
        return found


@lru_cache(maxsize=2)
def tokenizers(path_a: str, path_b: str) -> Tokenizers:
    return Tokenizers(path_a, path_b)


def default_tokenizers() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER_A), public_tokenizers.path(TOKENIZER_B)


class Groups:
    """Interned groups: a number for each, its name, its sizes and its distinct pairs of ids, which have numbers too."""

    def __init__(self, of: Tokenizers):
        self.of = of
        self.clear()

    def clear(self) -> None:
        self.number: dict[int, int] = {}
        self.second = array("Q")
        self.names: list[str] = []
        self.n_a, self.n_b = array("i"), array("i")
        self.pair_number: dict[tuple[int, int], int] = {}
        #: The distinct pairs of a group stand from its start to the next one's.
        self.pairs, self.pair_starts = array("i"), array("q", [0])

    def add(self, key: int, second: int, name: str) -> int:
        k = self.number[key] = len(self.names)
        self.second.append(second)
        self.names.append(name)
        a, _, b = name.partition("|")
        self.n_a.append(a.count(",") + 1)
        self.n_b.append(b.count(",") + 1)
        numbers = self.pair_number
        self.pairs.extend([numbers.setdefault(x, len(numbers)) for x in dict.fromkeys(self.of.links(name))])
        self.pair_starts.append(len(self.pairs))
        return k

    def texts(self, texts: list[str]) -> list[np.ndarray]:
        """The numbers of each text's groups; none for a text that has no tokens."""
        of = self.of
        each = [[of.ids_a(" " + x) if x else [] for x in texts], of.b.encode(texts) if texts else []]
        for k, x in enumerate(texts):
            whole = b" " + x.encode() if x else b""
            if any(b"".join(map(made.__getitem__, ids[k])) != whole for made, ids in zip((of.bytes_a, of.bytes_b), each)):
                each[0][k] = each[1][k] = []
        ids = [np.fromiter((i for x in side for i in x), np.int64, sum(map(len, side))) for side in each]
        if not len(ids[0]):
            return [np.zeros(0, np.int32) for _ in texts]
        ends = [np.cumsum(sizes[x]) for sizes, x in zip(of.sizes, ids)]
        ended = [np.zeros(ends[0][-1] + 1, bool) for _ in ends]
        for at, x in zip(ended, ends):
            at[x] = True
        last = [np.nonzero(ended[1 - side][ends[side]])[0] for side in (0, 1)]  # the last token of each group
        first = [np.r_[0, x[:-1] + 1] for x in last]
        n = [z - a + 1 for a, z in zip(first, last)]
        hashes = []
        for kind, step in enumerate(STEPS):
            powers = np.cumprod(np.full(max(int(x.max()) for x in n), step, np.uint64))
            sums = [np.add.reduceat(of.marks[side][kind][ids[side]] * powers[np.arange(len(ids[side])) - np.repeat(first[side], n[side])], first[side]) for side in (0, 1)]
            mixed = (sums[0] ^ (sums[0] >> np.uint64(31))) * np.uint64(STEPS[1 - kind]) + sums[1]
            hashes.append(mixed ^ (mixed >> np.uint64(29)))
        keys, at, inverse = np.unique(hashes[0], return_index=True, return_inverse=True)
        seconds, numbers, named = hashes[1][at].tolist(), np.empty(len(keys), np.int32), self.number
        for j, (key, place) in enumerate(zip(keys.tolist(), at.tolist())):
            k = named.get(key)
            if k is None:
                parts = (",".join(map(str, ids[side][first[side][place] : last[side][place] + 1].tolist())) for side in (0, 1))
                k = self.add(key, seconds[j], "|".join(parts))
            numbers[j] = k
        if (np.array(self.second, np.uint64)[numbers][inverse] != hashes[1]).any():
            raise ValueError("two groups of tokens have one hash")
        bounds = np.searchsorted(last[0], np.cumsum([len(x) for x in each[0]]))
        return np.split(numbers[inverse], bounds[:-1])

    def linked(self, docs: np.ndarray, groups: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """a, b and the number of documents that hold them linked. docs, groups: the distinct groups of each document."""
        starts = np.array(self.pair_starts, np.int64)
        n = (starts[1:] - starts[:-1])[groups]
        places = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(starts[groups], n)
        key = np.repeat(docs, n) * max(1, len(self.pair_number)) + np.array(self.pairs, np.int64)[places]
        which, count = np.unique(np.unique(key) % max(1, len(self.pair_number)), return_counts=True)
        pairs = list(self.pair_number)
        ids = np.array([pairs[p] for p in which.tolist()], np.int32).reshape(-1, 2)
        return ids[:, 0], ids[:, 1], count.astype(np.int32)


def encoded(docs: DataFrame, tokenizer_a: str | None = None, tokenizer_b: str | None = None, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """ENCODED: a row for each document, whose groups are numbers within its chunk; and one for each chunk (names not
    null) with the names of these numbers, and the pairs of ids with the number of its documents that hold them linked."""
    bounded_batches(docs.sparkSession)
    given = default_tokenizers()
    paths = (tokenizer_a or given[0], tokenizer_b or given[1])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        groups = Groups(tokenizers(*paths))
        schema = pa.schema([("chunk", pa.int64()), ("doc_id", pa.int64()), ("n_a", pa.int32()), ("n_b", pa.int32()), ("groups_sha256", pa.string()), ("groups", pa.list_(pa.int32())), ("names", pa.list_(pa.string())), ("pairs", pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32()), ("docs", pa.int32())])))])
        chunk, size = TaskContext.get().partitionId() << 32, 0
        ids: list[int | None] = []
        each: list[np.ndarray] = []
        digests: list[str] = []

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal chunk, size, ids, each, digests
            sizes = np.array([len(x) for x in each])
            flat = np.concatenate(each)
            distinct, local = np.unique(flat, return_inverse=True)
            of = np.repeat(np.arange(len(each)), sizes)
            held = np.unique(of * max(1, len(distinct)) + local)
            linked = groups.linked(held // max(1, len(distinct)), distinct[held % max(1, len(distinct))])
            sums = [np.bincount(of, np.array(x, np.int64)[flat], len(each)).astype(np.int32) if len(flat) else np.zeros(len(each), np.int32) for x in (groups.n_a, groups.n_b)]
            offsets = np.r_[0, np.cumsum(sizes)].astype(np.int32)
            n = len(each)
            each_pair = pa.StructArray.from_arrays([pa.array(x) for x in linked], names=["a", "b", "docs"])
            whole = [pa.array([chunk]), *(pa.nulls(1, schema.field(k).type) for k in range(1, 6)), pa.array([[groups.names[k] for k in distinct.tolist()]], schema.field("names").type), pa.ListArray.from_arrays(pa.array([0, len(each_pair)], pa.int32()), each_pair)]
            rows = [pa.array(np.full(n, chunk)), pa.array(ids, pa.int64()), *map(pa.array, sums), pa.array(digests), pa.ListArray.from_arrays(pa.array(offsets), pa.array(local.astype(np.int32))), pa.nulls(n, schema.field("names").type), pa.nulls(n, schema.field("pairs").type)]
            yield pa.RecordBatch.from_arrays(rows, schema=schema)
            yield pa.RecordBatch.from_arrays(whole, schema=schema)
            if len(groups.names) > KEPT_GROUPS:
                groups.clear()
            chunk, size, ids, each, digests = chunk + 1, 0, [], [], []

        def group(texts: list[str]) -> None:
            name = groups.names.__getitem__
            for found in groups.texts(texts):
                digests.append(hashlib.sha256(";".join(map(name, found.tolist())).encode()).hexdigest() if len(found) else "")
                each.append(found)

        for batch in batches:
            some: list[str] = []
            held = 0
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                some.append(text.as_py() or "")
                ids.append(doc_id)
                held += len(some[-1])
                if held >= AT_ONCE or size + held >= chunk_bytes:
                    group(some)
                    some, size, held = [], size + held, 0
                    if size >= chunk_bytes:
                        yield from flush()
            group(some)
            size += held
        if each:
            yield from flush()

    few = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return few.mapInArrow(encode, ENCODED)


def link_counts(rows: DataFrame) -> DataFrame:
    """a, b, docs: the documents of the corpus that hold the two ids linked. rows: as of encoded()."""
    return rows.where("names is not null").select(F.explode("pairs").alias("x")).groupBy("x.a", "x.b").agg(F.sum("x.docs").alias("docs"))


def group_weights(rows: DataFrame, counts: DataFrame, tokenizer_a: str | None = None, tokenizer_b: str | None = None) -> DataFrame:
    """name, links, best (links whose count is the highest of their A id), total (the sum of counts): for each distinct group."""
    given = default_tokenizers()
    paths = (tokenizer_a or given[0], tokenizer_b or given[1])

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = tokenizers(*paths)
        for batch in batches:
            names = batch.column(0).to_pylist()
            each = [of.links(x) for x in names]
            n = np.array([len(x) for x in each])
            pairs = np.array([p for x in each for p in x], np.int32).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(names, object), n), pa.string()), pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["name", "a", "b"])

    highest = counts.groupBy("a").agg(F.max("docs").alias("most"))
    weighed = counts.join(highest, "a").select("a", "b", "docs", (F.col("docs") == F.col("most")).cast("int").alias("best"))
    distinct = rows.where("names is not null").select(F.explode("names").alias("name")).distinct()
    links = distinct.mapInArrow(expand, "name string, a int, b int")
    return links.join(weighed, ["a", "b"]).groupBy("name").agg(F.count("*").cast("int").alias("links"), F.sum("best").cast("int").alias("best"), F.sum("docs").alias("total"))


def aligned(docs: DataFrame, tokenizer_a: str | None = None, tokenizer_b: str | None = None, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """ALIGNED, a row for each of docs (doc_id, text)."""
    spark = docs.sparkSession
    folder, counted = new_folder(spark, "encoded"), new_folder(spark, "links")
    encoded(docs, tokenizer_a, tokenizer_b, chunk_bytes).write.parquet(folder)
    rows = spark.read.schema(ENCODED).parquet(folder)
    link_counts(rows).write.parquet(counted)
    weights = group_weights(rows, spark.read.schema("a int, b int, docs long").parquet(counted), tokenizer_a, tokenizer_b)
    held = rows.where("names is not null").select("chunk", F.posexplode("names").alias("k", "name"))
    back = held.join(weights, "name").select("chunk", "k", "links", "best", "total")

    def multiply(docs: pa.Table, weights: pa.Table) -> pa.Table:
        k = np.asarray(weights["k"])
        each = np.zeros((3, len(k)), np.int64)
        for i, name in enumerate(("links", "best", "total")):
            each[i, k] = np.asarray(weights[name])
        groups = docs["groups"].combine_chunks()
        offsets = np.asarray(groups.offsets).astype(np.int64)
        flat = np.asarray(groups.flatten())
        sums = [np.diff(np.r_[0, np.cumsum(x[flat])][offsets - offsets[0]]) for x in each]
        return pa.table({"doc_id": docs["doc_id"], "n_a": docs["n_a"].cast(pa.int64()), "n_b": docs["n_b"].cast(pa.int64()), "n_groups": np.diff(offsets), "n_links": sums[0], "n_best": sums[1], "count_sum": sums[2], "groups_sha256": docs["groups_sha256"]})

    texts = spark.read.schema(ENCODED).parquet(folder).where("names is null").select("chunk", "doc_id", "n_a", "n_b", "groups_sha256", "groups")
    return texts.groupBy("chunk").cogroup(back.groupBy("chunk")).applyInArrow(multiply, ALIGNED)


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aligned(table(spark, sf_dir, "documents"))
