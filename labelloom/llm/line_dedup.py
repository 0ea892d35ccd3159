"""Line deduplication within an edit distance, by a segment-partition join.

Distinct lines are split into THRESHOLD + 1 segments: of two lines within THRESHOLD edits, one holds a segment of the
other unchanged, near its place. Each line puts its segments into an index keyed by (length, segment number, segment)
and probes it, for every length up to THRESHOLD below its own, with those of its substrings that a segment could have
become (the places are bounded from the left and from the right). Where few meet, pairs of an entry and a probe whose
letter parities differ in few enough bits are verified by an edit distance of bit-parallel steps over a band of
2 * THRESHOLD + 1 diagonals. Where many do, crowds.py compares all of them in tiles and counts their links there. Links
make classes; of each class the first line, by doc_id (null last), row and place, stays.

Lines are cut at line feeds and stripped of ASCII white space; blank ones are not counted and always stay. Lines of
fewer characters than segments have empty segments, which every line near their length holds: lines of all lengths are
compared. Null texts have no lines. Rows are told apart by doc_id and all their columns; of rows that are equal in all
columns one is first, and the others lose all their lines. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelloom.llm.common import checkpoint, is_row, map_batches, one_of_equals, row_hash, table, text_or_empty
from labelloom.llm.crowds import Compare, linked_nodes

THRESHOLD = 2
#: Lines that meet, whose texts are fetched by a broadcast of their ids at most; beyond, by a shuffle of all lines.
MOST_BROADCAST = 1_000_000
INDEX, PROBE = 1, 2
#: Characters of a line whose places are held at once.
PART = 256
SPACE = " \t\n\v\f\r"


def segments(length: int, threshold: int) -> list[tuple[int, int]]:
    """(start, size) of threshold + 1 segments; the last ones take what is left over."""
    parts = threshold + 1
    size, more = divmod(length, parts)
    out, at = [], 0
    for i in range(parts):
        n = size + (i >= parts - more)
        out.append((at, n))
        at += n
    return out


def probes(length: int, threshold: int) -> list[tuple[int, int, int, int]]:
    """(length of the indexed line, segment number, start, size) of the substrings to look up."""
    out = []
    for other in range(max(0, length - threshold), length + 1):
        shift = length - other
        for i, (at, size) in enumerate(segments(other, threshold)):
            low = max(0, at - i, at + shift - (threshold - i))
            high = min(length - size, at + i, at + shift + (threshold - i))
            out += [(other, i, start, size) for start in (range(low, high + 1) if size else (0,))]
    return out


def parity(line: str) -> int:
    """64 bits: whether the number of characters in each of 64 classes is odd. An edit changes two at most."""
    bits = 0
    for c in line:
        bits ^= 1 << (ord(c) & 63)
    return bits


def parities(lines: list[str]) -> np.ndarray:
    """parity() of lines that aren't empty, as longs."""
    if not lines:
        return np.zeros(0, np.int64)
    codes = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32) & np.uint32(63)
    ends = np.cumsum([len(x) for x in lines])
    return np.bitwise_xor.reduceat(np.uint64(1) << codes.astype(np.uint64), np.concatenate([[0], ends[:-1]])).view(np.int64)


def within(a: str, b: str, threshold: int) -> int:
    """The edit distance, or threshold + 1 if it is more. Bit d of row e: prefixes of a and b whose lengths differ by
    d - threshold are within e edits. One step reads one character of a. Places of characters are kept for the part of b that
    the next PART steps compare with, so a long line takes time in proportion to its length."""
    if abs(len(a) - len(b)) > threshold:
        return threshold + 1
    places: dict[str, int] = {}
    band = (1 << 2 * threshold + 1) - 1
    rows = []
    for e in range(threshold + 1):  # before any character of a, e of b may be left out
        rows.append(sum(1 << threshold + k for k in range(min(e, len(b)) + 1)))
    for i, c in enumerate(a):
        if i % PART == 0:
            places.clear()
            low = max(0, i - threshold)
            for j, x in enumerate(b[low : i + PART + threshold], low - i + threshold):
                places[x] = places.get(x, 0) | 1 << j
        # Diagonal d of step i compares with b[i + d - threshold].
        same = places.get(c, 0) >> i % PART & band
        valid = band
        end = len(b) - (i + 1) + threshold  # the diagonal on which b is read whole
        if end < 2 * threshold:
            valid &= (1 << end + 1) - 1 if end >= 0 else 0
        start = threshold - (i + 1)  # diagonals before b's start
        if start > 0:
            valid &= ~((1 << start) - 1)
        new: list[int] = []
        for e in range(threshold + 1):
            row = rows[e] & same
            if e:
                row |= rows[e - 1]  # c replaced
                row |= rows[e - 1] >> 1  # c left out: b lags one more behind
                row |= new[e - 1] << 1  # a character of b put in
            new.append(row & valid)
        rows = new
        if not rows[threshold]:
            return threshold + 1
    goal = 1 << len(b) - len(a) + threshold
    return next((e for e in range(threshold + 1) if rows[e] & goal), threshold + 1)


def document_lines(docs: DataFrame) -> DataFrame:
    """doc_id, row, at, line: the lines that aren't blank."""
    few = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_hash(docs).alias("row"), text_or_empty().alias("text"))
    each = few.select("doc_id", "row", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    return each.withColumn("line", F.btrim("line", F.lit(SPACE))).where("line <> ''")


def keyed_lines(lines: DataFrame, threshold: int) -> DataFrame:
    """key, node, parity, role for distinct lines (node, line): index entries and probes; equal ones merged."""

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        plans: dict[int, tuple[list[tuple[bytes, int, int]], np.ndarray]] = {}

        def plan(n: int) -> tuple[list[tuple[bytes, int, int]], np.ndarray]:
            roles: dict[tuple[int, int, int, int], int] = {}
            for x in probes(n, threshold):
                roles[x] = roles.get(x, 0) | PROBE
            for i, (at, size) in enumerate(segments(n, threshold)):
                roles[n, i, at, size] = roles.get((n, i, at, size), 0) | INDEX
            return [(b"%d:%d:" % (other, i), start, start + size) for other, i, start, size in roles], np.array(list(roles.values()), np.int8)

        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            keys: list[int] = []
            roles: list[np.ndarray] = [np.zeros(0, np.int8)]
            lines = batch.column(1).to_pylist()
            for line in lines:
                n = len(line)
                if n not in plans:
                    plans[n] = plan(n)
                steps, own = plans[n]
                if line.isascii():
                    data = line.encode()
                    keys += [xxh64_intdigest(head + data[a:b]) for head, a, b in steps]
                else:
                    keys += [xxh64_intdigest(head + line[a:b].encode()) for head, a, b in steps]
                roles.append(own)
            at = pa.array(np.repeat(np.arange(len(lines)), [len(x) for x in roles[1:]]))
            return pa.RecordBatch.from_arrays([pa.array(np.array(keys, np.uint64).view(np.int64)), batch.column(0).take(at), pa.array(parities(lines)).take(at), pa.array(np.concatenate(roles))], names=["key", "node", "parity", "role"])

        return one

    return map_batches(lines.select("node", "line"), make, "key long, node long, parity long, role byte")


def shared_ends(x: np.ndarray, y: np.ndarray) -> tuple[int, int]:
    """Lengths of the common prefix, and of the common suffix of what follows it."""
    n = min(len(x), len(y))
    differ = np.flatnonzero(x[:n] != y[:n])
    start = int(differ[0]) if len(differ) else n
    n -= start
    differ = np.flatnonzero(x[len(x) - n :] != y[len(y) - n :]) if n else differ
    return start, n - 1 - int(differ[-1]) if n and len(differ) else n


def two_edits_may_do(a: str, b: str) -> bool:
    """For texts that share neither first nor last characters: what lies between an edit at the start and one at the
    end must be equal."""
    return not a or not b or any(a[i : len(a) - k] == b[j : len(b) - m] for i, j in ((1, 1), (1, 0), (0, 1)) for k, m in ((1, 1), (1, 0), (0, 1)))


def comparing(threshold: int) -> Callable[[], Compare]:
    """Compares lengths and parities first, then what the lines don't share at both ends."""

    def make() -> Compare:
        def compare(xs: list[bytes], ys: list[bytes]):
            lines = [[x.decode() for x in side] for side in (xs, ys)]
            codes = [[np.frombuffer(x.encode("utf-32-le"), np.uint32) for x in side] for side in lines]
            bits = [parities(side).view(np.uint64) for side in lines]
            sizes = [np.array([len(x) for x in side], np.int64) for side in lines]
            near = (np.bitwise_count(bits[0][:, None] ^ bits[1]) <= 2 * threshold) & (np.abs(sizes[0][:, None] - sizes[1]) <= threshold)

            def linked(i: int, j: int) -> bool:
                start, end = shared_ends(codes[0][i], codes[1][j])
                a, b = lines[0][i], lines[1][j]
                a, b = a[start : len(a) - end], b[start : len(b) - end]
                return (threshold > 2 or two_edits_may_do(a, b)) and within(a, b, threshold) <= threshold

            return zip(*map(list, np.nonzero(near))), linked

        return compare

    return make


def line_roots(lines: DataFrame, distinct: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """node, root, n_links for distinct lines that are within threshold edits of another: the class, and how many other lines
    are within threshold edits. lines: node, line, repeats and all."""
    # One shuffle for both uses: the parities are asked for so that both read the same columns, from the same exchange.
    keys = keyed_lines(distinct, threshold).repartition("key")
    has = lambda role: F.max(F.col("role").bitwiseAND(F.lit(role).cast("byte")))
    ends = keys.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("low"), F.max("node").alias("high"), has(INDEX).alias("index"), has(PROBE).alias("probe"), F.bit_or("parity").alias("parities"))
    met = checkpoint(keys.join(ends.where("low <> high and index > 0 and probe > 0 and parities is not null").drop("high", "index", "probe", "parities").hint("shuffle_hash"), "key"))
    ids = met.select("node").distinct()
    some = F.broadcast(ids) if ids.count() <= MOST_BROADCAST else ids
    texts = checkpoint(lines.join(some, "node", "left_semi").select("node", "line").distinct())
    entry, probe = (F.col(f"{x}.role").bitwiseAND(F.lit(role).cast("byte")) > 0 for x, role in (("l", INDEX), ("r", PROBE)))
    probed, entered = (F.col(f"{x}.role").bitwiseAND(F.lit(role).cast("byte")) > 0 for x, role in (("l", PROBE), ("r", INDEX)))
    may = ((entry & probe) | (probed & entered)) & (F.bit_count(F.col("l.parity").bitwiseXOR(F.col("r.parity"))) <= 2 * threshold)

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            some = pa.array([within(x, y, threshold) <= threshold for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())], pa.bool_())
            return pa.RecordBatch.from_arrays([batch.column(0).filter(some), batch.column(1).filter(some)], names=["a", "b"])

        return one

    def verify(pairs: DataFrame) -> DataFrame:
        for side in ("a", "b"):
            pairs = pairs.join(texts.select(F.col("node").alias(side), F.col("line").alias(f"line_{side}")), side)
        return map_batches(pairs.select("a", "b", "line_a", "line_b"), make, "a long, b long")

    return checkpoint(linked_nodes(met, verify, may, texts.select("node", F.col("line").cast("binary").alias("data")), comparing(threshold)))


def line_classes(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """doc_id, row, at, line_id, class_id, n_links, first, first_doc_id: a row for each line that isn't blank. n_links:
    the other texts within threshold edits of the line's; first: no line of the class stands before it, by doc_id (null last), row and
    place; first_doc_id: the document of the one that is first."""
    lines = document_lines(docs).withColumn("node", F.xxhash64("line"))
    lines_alone = lines.select("node", "line")
    # Written out, so that the joins below shuffle them plainly and a frequent line's rows can be split over tasks.
    known, placed = line_roots(lines_alone, lines_alone.distinct(), threshold), checkpoint(lines.drop("line"))
    classed = placed.join(known, "node", "left").select("doc_id", "row", "at", F.col("node").alias("line_id"), F.coalesce("root", "node").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "row", "at")
    repeated = checkpoint(classed.groupBy("class_id").agg(F.min(order).alias("earliest"), F.count("*").alias("n")).where("n > 1").drop("n"))
    first = F.col("earliest").isNull() | (order == F.col("earliest"))
    return classed.join(repeated, "class_id", "left").select("doc_id", "row", "at", "line_id", "class_id", "n_links", first.alias("first"), F.coalesce("earliest.doc_id", "doc_id").alias("first_doc_id"))


def dedup_lines(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """docs, their texts without the lines that aren't the first of their class; other columns as they are."""
    found = line_classes(docs, threshold).where("not first").groupBy("doc_id", "row").agg(F.collect_set("at").alias("dropped_at"))
    joined = docs.join(found, is_row(docs, found), "left")
    kept = F.filter(F.split(docs["text"], "\n"), lambda x, i: ~F.array_contains(found["dropped_at"], i))
    text = F.when(found["dropped_at"].isNull(), docs["text"]).otherwise(F.array_join(kept, "\n"))
    out = joined.select(*(text.alias(c) if c == "text" else docs[c] for c in docs.columns))
    each = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_hash(docs).alias("row"))
    again = checkpoint(each.groupBy("doc_id", "row").agg(F.count("*").alias("n")).where("n > 1"))
    if again.isEmpty():
        return out
    # Of rows that are equal in all columns one is as above; the others keep their blank lines.
    equal = one_of_equals(docs.join(again, is_row(docs, again), "left_semi"))
    firsts = dedup_lines(docs.join(again, is_row(docs, again), "left_anti").unionByName(equal), threshold)
    blank = F.array_join(F.filter(F.split(equal["text"], "\n"), lambda x: F.btrim(x, F.lit(SPACE)) == ""), "\n")
    packed = equal.select(F.struct(*(blank.alias(c) if c == "text" else equal[c] for c in docs.columns)).alias("x"), equal["doc_id"].cast("long").alias("id"), row_hash(equal).alias("hash"))
    others = packed.join(again, F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("hash") == F.col("row"))).select("x", F.explode(F.sequence(F.lit(2), "n")))
    return firsts.unionByName(others.select("x.*"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: n_lines, n_dropped, n_links (of its lines, to the other texts within THRESHOLD edits), the places of
    dropped lines, and the documents that hold the first lines of their classes."""
    docs = table(spark, sf_dir, "documents")
    none = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_hash(docs).alias("row"), F.lit(None).cast("int").alias("at"), F.lit(0).cast("long").alias("n_links"), F.lit(True).alias("first"), F.lit(None).cast("long").alias("first_doc_id"))
    each = line_classes(docs).select("doc_id", "row", "at", "n_links", "first", "first_doc_id").unionByName(none)
    lines = F.array_sort(F.collect_set(F.when(F.col("at").isNotNull(), F.struct("at", "first", "first_doc_id", "n_links"))))
    rows = each.groupBy("doc_id", "row").agg(F.count_if(F.col("at").isNull()).alias("rows"), lines.alias("lines"))
    # Equal rows are one group: the first copy loses what stands elsewhere, the others all their lines.
    rows = rows.select("doc_id", "lines", F.explode(F.sequence(F.lit(1), F.col("rows"))).alias("copy"))
    gone = rows.withColumn("gone", F.filter("lines", lambda x: ~x["first"] | (F.col("copy") > 1)))
    links = F.aggregate("lines", F.lit(0).cast("long"), lambda s, x: s + x["n_links"])
    holders = F.array_sort(F.array_distinct(F.filter(F.transform("gone", lambda x: x["first_doc_id"]), lambda x: x.isNotNull())))
    return gone.select("doc_id", F.size("lines").cast("long").alias("n_lines"), F.size("gone").cast("long").alias("n_dropped"), links.alias("n_links"), F.array_join(F.transform("gone", lambda x: x["at"]), ",").alias("dropped"), holders.alias("first_docs"))
