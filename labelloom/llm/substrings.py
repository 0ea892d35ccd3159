"""Substring dedup: a De Bruijn graph of token k-mers, compacted by shuffles, whose repeated paths are cut out.

A window of WIDTH consecutive words is an edge of the graph, from the node of its first WIDTH - 1 words to that of its last.
Each edge belongs to the smallest hash of the SEED-word runs in it, its minimizer, so equal edges meet wherever they stand.
Consecutive edges of a text with one minimizer are a nonbranching path by themselves; such paths, not edges, are shuffled:

1. Documents are dealt to chunks. A chunk's equal paths become one, with the smallest document that holds it, so a passage that
   is in many documents is one path of each chunk. Paths go to buckets by minimizer, packed.
2. A bucket joins the paths of all chunks on (minimizer, place of the minimizer in the edge, hash of the edge): the source of
   an edge is the smallest document that holds it. Edges whose source isn't the path's own document go back to the chunk.
3. Joined with their chunk again, paths are glued along each document: a maximal run of edges with smaller sources is a
   repeated span, with its place and the source of each stretch. The words of these spans are cut.

An edge is told by 64 bits of its minimizer, its place and 32 bits of an independent hash of all its words, which verify
each other. What comes back names edges by bucket and place, which the chunk finds again in its own paths, made anew from
its texts. Nothing is dropped: an edge that stands once costs a share of its path's row and goes no further than its bucket.
The number of chunks and buckets grows with the text.

Words are what stands between ASCII white space. Sources are compared by doc_id, a null one counting as the largest long. Rows
of one doc_id aren't copies of each other; rows with an equal doc_id and text have equal results, one for each row. Null
texts have no words; texts of fewer than WIDTH words lose none. An empty table gives an empty result. Columns other than
doc_id and text are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelloom.llm.common import bounded_batches, table, text_or_empty

WIDTH = 13
SEED = 5
#: Bytes of text in a chunk, and in what a bucket's paths come from, on average.
CHUNK_BYTES = 4 << 20
BUCKET_BYTES = 16 << 20
#: Chunks, and buckets, of a small table for each shuffle partition: what goes between them has up to a row for each pair.
LEAST_EACH = 2
NO_ID = 2**63 - 1
#: Odd multipliers of rolling hashes, and of a last mix.
STEP = np.uint64(0x9E3779B97F4A7C15)
SEED_STEP = np.uint64(0xC2B2AE3D27D4EB4F)
MIX = np.uint64(0xD6E8FEB86659FD93)

RESULT = "doc_id long, n_words long, n_removed long, kept string, spans array<struct<start: int, end: int, source: long>>"


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * MIX
    return x ^ (x >> np.uint64(29))


def rolled(hashes: np.ndarray, width: int, step: np.uint64) -> np.ndarray:
    """A hash of each `width` consecutive hashes."""
    out = np.zeros(max(0, len(hashes) - width + 1), np.uint64)
    for k in range(width):
        out = out * step + hashes[k : k + len(out)]
    return mixed(out)


class Paths:
    """The paths of one document: their first edge, number of edges, minimizer, its place in the first edge; and its edges."""

    def __init__(self, words: list[bytes], width: int = WIDTH, seed: int = SEED):
        from xxhash import xxh3_64_intdigest

        hashes = np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))
        self.edges = rolled(hashes, width, STEP)
        n = len(self.edges)
        seeds = rolled(hashes, seed, SEED_STEP)
        # The first of the smallest seeds of each edge.
        least, at = seeds[:n].copy(), np.arange(n)
        for k in range(1, width - seed + 1):
            smaller = seeds[k : k + n] < least
            least[smaller] = seeds[k : k + n][smaller]
            at[smaller] = np.nonzero(smaller)[0] + k
        self.first = np.nonzero(np.r_[True, at[1:] != at[:-1]])[0] if n else np.zeros(0, np.int64)
        self.sizes = np.diff(np.r_[self.first, n])
        self.seeds = mixed(least[self.first])  # spread anew: minima are small
        self.places = at[self.first] - self.first
        #: A path has fewer edges than an edge has words, so its first and its last edge hold all its words.
        self.names = mixed((self.edges[self.first] * STEP + self.edges[self.first + self.sizes - 1]) * STEP + self.sizes.astype(np.uint64)) if n else np.zeros(0, np.uint64)


class Chunk:
    """The distinct paths of a chunk's documents, ordered by minimizer and name. docs: their ids, NO_ID for null."""

    def __init__(self, docs: list[int], texts: list[bytes], buckets: int, width: int = WIDTH, seed: int = SEED):
        self.words = [x.split() for x in texts]
        self.of = [Paths(x, width, seed) for x in self.words]
        n = np.array([len(x.first) for x in self.of], np.int64)
        every = lambda name, kind: np.concatenate([np.zeros(0, kind), *(getattr(x, name) for x in self.of)])
        seeds, names = every("seeds", np.uint64), every("names", np.uint64)
        ids = np.repeat(np.array(docs, np.int64), n)
        order = np.lexsort((ids, names, seeds))
        new = np.r_[True, (seeds[order][1:] != seeds[order][:-1]) | (names[order][1:] != names[order][:-1])] if len(order) else np.zeros(0, bool)
        head = order[new]
        self.seeds, self.ids = seeds[head], ids[head]
        self.sizes, self.places = every("sizes", np.int64)[head], every("places", np.int64)[head]
        #: Of each path of each document, in their order, its place among the distinct ones.
        self.path = np.empty(len(order), np.int64)
        self.path[order] = np.cumsum(new) - 1
        self.starts = np.r_[0, np.cumsum(n)]
        #: The edges of the distinct paths, one after another.
        edges, base = every("edges", np.uint64), np.repeat(np.r_[0, np.cumsum([len(x.edges) for x in self.of])][:-1].astype(np.int64), n)
        self.edge_starts = np.r_[0, np.cumsum(self.sizes)]
        from_ = (every("first", np.int64) + base)[head]
        self.tags = (edges[np.repeat(from_ - self.edge_starts[:-1], self.sizes) + np.arange(self.edge_starts[-1])] >> np.uint64(32)).astype(np.uint32)
        #: The bucket of a path is its minimizer's place among equal ranges.
        bucket = (self.seeds >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
        self.bucket_starts = np.searchsorted(bucket, np.arange(buckets + 1, dtype=np.uint64))

    def packed(self) -> list[tuple[int, bytes, bytes, bytes, bytes]]:
        """For each bucket that has paths: bucket, minimizers, documents, (edges, place) and tags, packed."""
        out = []
        shapes = np.stack([self.sizes, self.places], axis=1).astype(np.uint8)
        for b in np.nonzero(np.diff(self.bucket_starts))[0].tolist():
            some = slice(self.bucket_starts[b], self.bucket_starts[b + 1])
            tags = self.tags[self.edge_starts[some.start] : self.edge_starts[some.stop]]
            out.append((b, self.seeds[some].tobytes(), self.ids[some].tobytes(), shapes[some].tobytes(), tags.tobytes()))
        return out

    def sources(self, found: list[tuple[int, bytes, bytes]]) -> np.ndarray:
        """The source of each edge of the distinct paths. found: bucket, places of edges in it, their sources."""
        out = np.repeat(self.ids, self.sizes)
        for b, places, sources in found:
            out[self.edge_starts[self.bucket_starts[b]] + np.frombuffer(places, np.uint32)] = np.frombuffer(sources, np.int64)
        return out


def joined(seeds: np.ndarray, ids: np.ndarray, shapes: np.ndarray, tags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The edges, by their place among tags, whose source isn't their path's document, and the source."""
    sizes = shapes[:, 0].astype(np.int64)
    order = np.argsort(seeds, kind="stable")
    same = seeds[order][1:] == seeds[order][:-1]
    shared = np.zeros(len(seeds), bool)
    shared[order] = np.r_[False, same] | np.r_[same, False]
    path = np.repeat(np.arange(len(seeds)), sizes)
    at = np.nonzero(shared[path])[0]
    path = path[at]
    starts = np.cumsum(sizes) - sizes
    place = (shapes[path, 1].astype(np.int64) - (at - starts[path])).astype(np.uint64)
    key = place << np.uint64(32) | tags[at].astype(np.uint64)
    by = np.lexsort((ids[path], key, seeds[path]))
    new = np.r_[True, (key[by][1:] != key[by][:-1]) | (seeds[path][by][1:] != seeds[path][by][:-1])] if len(by) else np.zeros(0, bool)
    source = ids[path][by][new][np.cumsum(new) - 1]
    other = source != ids[path][by]
    return at[by][other], source[other]


def cut(words: list[bytes], sources: np.ndarray, doc: int, width: int) -> tuple[list[bytes], list[dict]]:
    """The words that stay, and the spans that go. sources: of each edge of the document."""
    starts = np.nonzero(sources < doc)[0]
    if not len(starts):
        return words, []
    gone = np.zeros(len(words) + 1, np.int64)
    np.add.at(gone, starts, 1)
    np.add.at(gone, starts + width, -1)
    gone = np.cumsum(gone)[:-1] > 0
    # A stretch of edges, each after the other, with one source is one span.
    head = np.r_[True, (starts[1:] != starts[:-1] + 1) | (sources[starts[1:]] != sources[starts[:-1]])]
    first = starts[head]
    last = starts[np.r_[np.nonzero(head)[0][1:], len(starts)] - 1]
    spans = [{"start": s, "end": e + width, "source": x} for s, e, x in zip(first.tolist(), last.tolist(), sources[first].tolist())]
    return [words[i] for i in np.nonzero(~gone)[0].tolist()], spans


def repeated_spans(docs: DataFrame, width: int = WIDTH, seed: int = SEED, chunk_bytes: int = CHUNK_BYTES, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """RESULT, a row for each of docs: the words that stay, joined by one space, and the spans (from word start to before
    word end) of consecutive windows with one source, the smallest doc_id that holds them."""
    spark = docs.sparkSession
    bounded_batches(spark)
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    few = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), text_or_empty().alias("text"))
    size = few.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks, buckets = max(LEAST_EACH * partitions, -(-size // chunk_bytes)), max(LEAST_EACH * partitions, -(-size // bucket_bytes))
    dealt = few.withColumn("chunk", F.pmod(F.xxhash64("doc", "text"), F.lit(chunks)).cast("int"))

    def chunk_of(rows: pa.Table) -> Chunk:
        return Chunk(rows["doc"].to_pylist(), rows["text"].cast(pa.binary()).to_pylist(), buckets, width, seed)

    def paths(rows: pa.Table) -> pa.Table:
        found = chunk_of(rows).packed()
        each = list(zip(*found)) or [()] * 5
        return pa.table({"bucket": pa.array(each[0], pa.int32()), "chunk": pa.array([rows["chunk"][0].as_py()] * len(found), pa.int32()), **{name: pa.array(x, pa.binary()) for name, x in zip(("seeds", "ids", "shapes", "tags"), each[1:])}})

    def meet(rows: pa.Table) -> pa.Table:
        every = lambda name, kind: np.frombuffer(b"".join(rows[name].to_pylist()), kind)
        sizes = np.array([len(x) // 4 for x in rows["tags"].to_pylist()])
        starts = np.r_[0, np.cumsum(sizes)]
        at, source = joined(every("seeds", np.uint64), every("ids", np.int64), every("shapes", np.uint8).reshape(-1, 2), every("tags", np.uint32))
        row = np.searchsorted(starts, at, side="right") - 1
        order = np.argsort(row, kind="stable")
        at, source, row = at[order], source[order], row[order]
        cuts = np.searchsorted(row, np.arange(len(sizes) + 1))
        some = [k for k in range(len(sizes)) if cuts[k] < cuts[k + 1]]
        chunk, bucket = rows["chunk"].to_pylist(), rows["bucket"].to_pylist()
        parts = [slice(cuts[k], cuts[k + 1]) for k in some]
        return pa.table({"chunk": pa.array([chunk[k] for k in some], pa.int32()), "bucket": pa.array([bucket[k] for k in some], pa.int32()), "places": pa.array([(at[p] - starts[k]).astype(np.uint32).tobytes() for k, p in zip(some, parts)], pa.binary()), "sources": pa.array([source[p].tobytes() for p in parts], pa.binary())})

    def glue(rows: pa.Table, found: pa.Table) -> pa.Table:
        chunk = chunk_of(rows)
        sources = chunk.sources(list(zip(found["bucket"].to_pylist(), found["places"].to_pylist(), found["sources"].to_pylist())))
        out = []
        for k, (doc, words, own) in enumerate(zip(rows["doc"].to_pylist(), chunk.words, chunk.of)):
            path = chunk.path[chunk.starts[k] : chunk.starts[k + 1]]
            edges = np.repeat(chunk.edge_starts[path] - own.first, own.sizes) + np.arange(len(own.edges))
            kept, spans = cut(words, sources[edges], doc, width)
            out.append((None if doc == NO_ID else doc, len(words), len(words) - len(kept), b" ".join(kept).decode(), spans))
        each = list(zip(*out)) or [()] * 5
        span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("source", pa.int64())]))
        return pa.table({"doc_id": pa.array(each[0], pa.int64()), "n_words": pa.array(each[1], pa.int64()), "n_removed": pa.array(each[2], pa.int64()), "kept": pa.array(each[3], pa.string()), "spans": pa.array(each[4], span)})

    packed = dealt.groupBy("chunk").applyInArrow(paths, "bucket int, chunk int, seeds binary, ids binary, shapes binary, tags binary")
    met = packed.groupBy("bucket").applyInArrow(meet, "chunk int, bucket int, places binary, sources binary")
    # One query: both uses of the dealt texts read the same exchange.
    return dealt.groupBy("chunk").cogroup(met.groupBy("chunk")).applyInArrow(glue, RESULT)


def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, n_spans."""
    rows = repeated_spans(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"), F.size("spans").alias("n_spans"))
