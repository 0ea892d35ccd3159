"""Mixing sources to target weights by a low-discrepancy schedule.

Each source's documents, shuffled by a hash anew for each epoch, form a line of words, cut into blocks of equal size.
The points k * golden ratio modulo 1 fall into the sources' shares of the mix: slot k goes to a source, and the r-th
slot of a source takes the r-th block of its line. The last block is cut where the source's target is met, so that
what is taken differs from the target by less than a word.

Places in a line are sums over buckets of the hash's range plus sums inside a bucket; ranks of slots are sums over
chunks of slots plus ranks inside a chunk: no source is held or sorted in one task. The hash is that of the epoch, the
doc_id, the text and the number of the copy, so that rows without a doc_id spread like all others.

A mix of SOURCES sources or fewer is worked out on the driver and broadcast. One of more stays in tables, with the same
targets and slots: sources are numbered by sums over ranges of their names, targets take a few aggregations, and slots
find their sources by standing in one order with the sources' edges.

How much is taken of a document follows from its place in line and the target; when it is, from the schedule: `slot` is
the first slot that takes a part of it. mixed_rows() returns the amounts as rows; rows have no order, so who wants to
read in the mix's order sorts by the slots of mix_documents().

A null text has size 0, and is never taken. A null source is a source of its own, the last. Rows are told apart by all
their columns; equal rows stand in the line as often as they are there. An empty table, or one without words, gives
targets 0 and nothing taken. Other columns are kept as they are, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from labelloom.llm.common import checkpoint, one_of_equals, row_hash, table

WORD = r"[^\x20\x09-\x0D]+"
BLOCK = 2048
CHUNK = 65536
BUCKET = 500
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
#: Sources that are held on the driver and broadcast; more stay in tables.
SOURCES = 100_000
#: 2**64 over the golden ratio.
GOLDEN = np.uint64(11400714819323198485)


@dataclass(frozen=True)
class Source:
    name: str | None
    rows: int
    size: int
    weight: float
    target: float


#: Sources on the driver, or a table as of many_sources().
Mix = Sequence[Source] | DataFrame


def targets(sizes: Sequence[int], weights: Sequence[float], total: float, most: float = MOST) -> list[float]:
    """Shares of total by weight, none above most times its size; what is above is shared among the others."""
    capped: set[int] = set()
    while True:
        rest = [i for i in range(len(sizes)) if i not in capped]
        left, weight = total - sum(most * sizes[i] for i in capped), sum(weights[i] for i in rest)
        above = {i for i in rest if weights[i] * left / weight > most * sizes[i]}
        if not above:
            return [most * sizes[i] if i in capped else weights[i] * left / weight for i in range(len(sizes))]
        capped |= above


def row_sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, row (the row's hash), digest (the text's), size, copies: for all that are equal in all columns."""
    few = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["source"].cast("string").alias("source"), row_hash(docs).alias("row"), F.md5(docs["text"].cast("string")).alias("digest"), F.regexp_count(F.coalesce(docs["text"].cast("string"), F.lit("")), F.lit(WORD)).cast("long").alias("size"))
    return few.groupBy("doc_id", "source", "row", "digest", "size").agg(F.count("*").alias("copies"))


def sources(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST) -> Mix:
    """In the order of their names' code points, null last; weights repeat."""
    per = sizes.groupBy("source").agg(F.sum("copies").alias("rows"), F.sum(F.col("size") * F.col("copies")).alias("size"))
    rows = per.limit(SOURCES + 1).collect()
    if len(rows) > SOURCES:
        return many_sources(per, weights, share, most)
    rows.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    given = [weights[i % len(weights)] for i in range(len(rows))]
    goals = targets([r["size"] for r in rows], given, share * sum(r["size"] for r in rows), most)
    return [Source(r["source"], r["rows"], r["size"], w, t) for r, w, t in zip(rows, given, goals)]


def ranged(df: DataFrame, *order: str) -> DataFrame:
    """df, written out in ranges of order, with part (the range) and place (growing within it)."""
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order)
    return checkpoint(placed.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("place")))


def preceding(df: DataFrame, value: Column, name: str) -> DataFrame:
    """df, as of ranged(), with the sum of value over all rows that stand before one. What is broadcast is a row a range."""
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("part").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    parts = df.groupBy("part").agg(F.sum(value).alias("n")).select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("first"))
    return df.select("*", F.coalesce(F.sum(value).over(inside), F.lit(0)).alias(name)).join(F.broadcast(parts), "part").withColumn(name, F.col(name) + F.col("first")).drop("part", "place", "first")


def many_sources(per: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """What source_table() says of sources(), from a table of source, rows and size."""
    numbered = preceding(ranged(per.withColumn("unnamed", F.col("source").isNull()), "unnamed", "source"), F.lit(1), "source_no")
    given = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("source_no") % len(weights) + 1).cast("int"))
    mix = checkpoint(numbered.withColumn("weight", given))
    limit, capped, known = F.lit(most) * F.col("size"), F.lit(False), -1
    total = share * mix.agg(F.sum("size")).first()[0]
    while True:
        now = mix.agg(F.count_if(capped).alias("n"), F.coalesce(F.sum(F.when(capped, limit)), F.lit(0)).alias("taken"), F.sum(F.when(~capped, F.col("weight"))).alias("weight")).first()
        if now["n"] == known or now["weight"] is None:
            break
        known, even = now["n"], F.col("weight") * F.lit(float(total - now["taken"])) / F.lit(now["weight"])
        capped = even > limit
    target = F.when(capped, limit.cast("double")).otherwise(even)
    buckets = F.ceil(F.col("rows") / F.greatest(F.lit(BUCKET), F.ceil(F.sqrt("rows"))))
    return checkpoint(mix.select("source_no", "source", F.col("size").alias("source_size"), target.alias("target"), F.floor(target).alias("goal"), buckets.alias("buckets")))


def in_table(spark: SparkSession, mix: Mix) -> DataFrame:
    """The sources with a hint how to join them: a broadcast of SOURCES rows at most, else merged, so that a large
    source's rows can be split over tasks."""
    return mix.hint("merge") if isinstance(mix, DataFrame) else F.broadcast(source_table(spark, mix))


def source_table(spark: SparkSession, mix: Sequence[Source]) -> DataFrame:
    rows = [(i, s.name, s.size, float(s.target), int(s.target), max(1, ceil(s.rows / max(BUCKET, ceil(s.rows**0.5))))) for i, s in enumerate(mix)]
    return spark.createDataFrame(rows, "source_no int, source string, source_size long, target double, goal long, buckets int")


def lines(sizes: DataFrame, known: DataFrame, epochs: int = MOST) -> DataFrame:
    """Rows of sizes in the lines: epoch, copy, at (words of the line before it, over all epochs), source_no, goal."""
    each = sizes.where("size > 0").join(known, sizes["source"].eqNullSafe(known["source"])).drop(known["source"])
    each = each.select("*", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).select("*", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))).alias("epoch"))
    each = each.where(F.col("epoch") * F.col("source_size") < F.col("goal"))
    each = each.withColumn("mark", F.md5(F.concat_ws(":", "epoch", "doc_id", "digest", "copy")))
    each = each.withColumn("bucket", F.floor(F.conv(F.substring("mark", 1, 7), 16, 10).cast("long") * F.col("buckets") / F.lit(float(16**7))))
    key = ["source_no", "epoch", "bucket"]
    before = Window.partitionBy("source_no", "epoch").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = each.groupBy(*key).agg(F.sum("size").alias("n")).select(*key, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy(*key).orderBy("mark", "doc_id", "row", "copy").rowsBetween(Window.unboundedPreceding, -1)
    placed = each.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    return placed.join(starts, key).withColumn("at", F.col("epoch") * F.col("source_size") + F.col("start") + F.col("inside"))


def schedule(spark: SparkSession, mix: Sequence[Source], block: int = BLOCK) -> DataFrame:
    """slot, source_no, block_no: each source's blocks, spread over the slots by its share."""
    need = np.array([ceil(int(s.target) / block) for s in mix], np.int64)
    if not need.sum():
        return spark.createDataFrame([], "slot long, source_no int, block_no long")
    edges = np.cumsum(need) / need.sum()
    slots = int(need.sum()) + 8 * len(mix)
    chunks = -(-slots // CHUNK)

    def drawn(chunk: int) -> tuple[np.ndarray, np.ndarray]:
        k = np.arange(chunk * CHUNK, min(slots, (chunk + 1) * CHUNK), dtype=np.uint64)
        points = ((k * GOLDEN) >> np.uint64(11)).astype(np.float64) * 2.0**-53
        return k.astype(np.int64), np.minimum(np.searchsorted(edges, points, side="right"), len(edges) - 1)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in batch.column(0).to_pylist():
                n = np.bincount(drawn(chunk)[1], minlength=len(edges))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), chunk)), pa.array(np.arange(len(n), dtype=np.int32)), pa.array(n.astype(np.int64))], names=["chunk", "source_no", "n"])

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, before in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                start = np.zeros(len(edges), np.int64)
                for x in before:
                    start[x["source_no"]] = x["start"]
                k, source = drawn(chunk)
                order = np.argsort(source, kind="stable")
                n = np.bincount(source, minlength=len(edges))
                ranks = np.empty(len(k), np.int64)
                ranks[order] = np.arange(len(k)) - np.repeat(np.cumsum(n) - n, n)
                ranks += start[source]
                used = ranks < need[source]
                yield pa.RecordBatch.from_arrays([pa.array(k[used]), pa.array(source[used].astype(np.int32)), pa.array(ranks[used])], names=["slot", "source_no", "block_no"])

    counts = checkpoint(spark.range(0, chunks, 1, min(chunks, 10_000)).mapInArrow(count, "chunk long, source_no int, n long"))
    before = Window.partitionBy("source_no").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("chunk", F.struct("source_no", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start")).alias("x")).groupBy("chunk").agg(F.collect_list("x").alias("starts"))
    taken = {r["source_no"]: r["n"] for r in counts.groupBy("source_no").agg(F.sum("n").alias("n")).collect()}
    # Where the points give a source less than its blocks (by a few), slots at the end make up for it.
    late = [(i, r) for i in range(len(need)) for r in range(taken.get(i, 0), int(need[i]))]
    tail = spark.createDataFrame([(slots + n, i, r) for n, (i, r) in enumerate(late)], "slot long, source_no int, block_no long")
    return starts.mapInArrow(rank, "slot long, source_no int, block_no long").unionByName(tail)


def many_slots(known: DataFrame, block: int = BLOCK) -> DataFrame:
    """What schedule() gives, for a table of sources: points and the sources' lower edges stand in one order, where the
    last edge before a point is that of its source."""
    spark = known.sparkSession
    wanted = known.select("source_no", F.ceil(F.col("goal") / block).alias("need"))
    blocks, rows = wanted.agg(F.sum("need"), F.count("*")).first()
    if not blocks:
        return spark.createDataFrame([], "slot long, source_no long, block_no long")
    slots = blocks + 8 * rows

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in batch.column(0).to_pylist():
                k = np.arange(chunk * CHUNK, min(slots, (chunk + 1) * CHUNK), dtype=np.uint64)
                points = ((k * GOLDEN) >> np.uint64(11)).astype(np.float64) * 2.0**-53
                yield pa.RecordBatch.from_arrays([pa.array(points), pa.array(k.astype(np.int64))], names=["x", "slot"])

    chunks = -(-slots // CHUNK)
    edges = checkpoint(preceding(ranged(wanted.where("need > 0"), "source_no"), F.col("need"), "low"))
    points = spark.range(0, chunks, 1, min(chunks, 10_000)).mapInArrow(draw, "x double, slot long")
    of = F.struct("source_no", "need").alias("of")
    both = edges.select((F.col("low").cast("double") / float(blocks)).alias("x"), F.lit(-1).cast("long").alias("slot"), of)
    line = ranged(both.unionByName(points, allowMissingColumns=True), "x", "slot")
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    so_far = Window.partitionBy("part").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    parts = line.groupBy("part").agg(F.max("of").alias("of")).select("part", F.max("of").over(earlier).alias("first"))
    drawn = line.select("part", "slot", F.max("of").over(so_far).alias("of")).where("slot >= 0").join(F.broadcast(parts), "part")
    drawn = checkpoint(drawn.select("slot", F.coalesce("of", "first").alias("of"), F.floor(F.col("slot") / CHUNK).alias("chunk")).select("slot", "of.*", "chunk"))
    before = Window.partitionBy("source_no").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    counts = drawn.groupBy("source_no", "chunk").agg(F.count("*").alias("n"))
    starts = counts.select("source_no", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("source_no", "chunk").orderBy("slot")
    ranks = drawn.withColumn("rank", F.row_number().over(inside) - 1).join(starts, ["source_no", "chunk"])
    used = ranks.select("slot", "source_no", (F.col("rank") + F.col("start")).alias("block_no"), "need").where("block_no < need").drop("need")
    late = edges.join(counts.groupBy("source_no").agg(F.sum("n").alias("got")), "source_no", "left").withColumn("got", F.coalesce("got", F.lit(0))).where("got < need")
    late = late.select("source_no", F.explode(F.sequence(F.col("got"), F.col("need") - 1)).alias("block_no"))
    tail = preceding(ranged(late, "source_no", "block_no"), F.lit(1), "slot").withColumn("slot", F.col("slot") + slots)
    return used.unionByName(tail)


def mix_documents(sizes: DataFrame, mix: Mix, block: int = BLOCK, most: int = MOST) -> DataFrame:
    """The mix: slot, source_no, doc_id, source, row, copy, epoch, size, first_word (in the document), n_words."""
    spark = sizes.sparkSession
    placed = lines(sizes, in_table(spark, mix), most).where("at < goal").withColumn("end", F.least(F.col("at") + F.col("size"), F.col("goal")))
    numbers = F.sequence(F.floor(F.col("at") / block), F.floor((F.col("end") - 1) / block))
    pieces = placed.select("source_no", "source", "doc_id", "row", "copy", "epoch", "size", "at", "end", F.explode(numbers).alias("block_no"))
    low, high = F.greatest("at", F.col("block_no") * block), F.least("end", (F.col("block_no") + 1) * block)
    pieces = pieces.select("source_no", "block_no", "source", "doc_id", "row", "copy", "epoch", "size", (low - F.col("at")).alias("first_word"), (high - low).alias("n_words"))
    slots = many_slots(mix, block) if isinstance(mix, DataFrame) else schedule(spark, mix, block)
    return slots.join(pieces, ["source_no", "block_no"])


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns, source, and slot: the first slot of the schedule that takes a part of the document."""
    sizes = checkpoint(row_sizes(table(spark, sf_dir, "documents")))
    mix = sources(sizes)
    key = ["doc_id", "source", "row", "copy"]
    taken = mix_documents(sizes, mix).groupBy(*key).agg(F.sum("n_words").alias("taken"), F.min("slot").alias("slot"))
    known = in_table(spark, mix).select("source", "source_size", "target")
    rows = sizes.select("*", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
    rows = rows.join(known, rows["source"].eqNullSafe(known["source"])).drop(known["source"])
    same = rows["doc_id"].eqNullSafe(taken["doc_id"]) & rows["source"].eqNullSafe(taken["source"]) & (rows["row"] == taken["row"]) & (rows["copy"] == taken["copy"])
    return rows.join(taken, same, "left").select(rows["doc_id"], "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"), rows["source"], "slot")


def mixed_rows(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """The mix as rows with the columns of docs: a document stands as often as it is taken; where only its first words
    are, its text is cut after them (and n_chars, if there is such a column, counted anew)."""
    sizes = checkpoint(row_sizes(docs))
    taken = mix_documents(sizes, sources(sizes, weights, share, most), most=most).groupBy("doc_id", "source", "row", "copy", "epoch", "size").agg(F.sum("n_words").alias("n"))
    taken = taken.select("doc_id", "source", "row", "size", F.col("n").alias("taken"))
    if not sizes.where("copies > 1").isEmpty():  # what is taken names each copy: one row stands for those that are equal
        docs = one_of_equals(docs)
    same = docs["doc_id"].cast("long").eqNullSafe(taken["doc_id"]) & docs["source"].cast("string").eqNullSafe(taken["source"]) & (row_hash(docs) == taken["row"])
    cut = F.array_join(F.slice(F.regexp_extract_all(docs["text"], F.lit(r"[\x20\x09-\x0D]*" + WORD), F.lit(0)), F.lit(1), taken["taken"].cast("int")), "")
    part = taken["taken"] < taken["size"]
    text = F.when(part, cut).otherwise(docs["text"])
    new: dict[str, Callable] = {"text": lambda c: text, "n_chars": lambda c: F.when(part, F.char_length(cut).cast(dict(docs.dtypes)[c])).otherwise(docs[c])}
    return docs.join(taken, same).select(*(new[c](c).alias(c) if c in new else docs[c] for c in docs.columns))


OP7_SQL = r"""
with d as (
    select doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as bigint) size from documents
), s as (
    select source, cast(sum(size) as bigint) source_size, (list_value(3, 1, 2))[(row_number() over (order by source nulls last) - 1) % 3 + 1] w from d group by source
), o as (
    select *, coalesce(sum(2 * source_size) over (order by source_size / w, source nulls last rows between unbounded preceding and 1 preceding), 0) before,
        sum(w) over (order by source_size / w, source nulls last rows between current row and unbounded following) rest, 1.5 * sum(source_size) over () total
    from s
), c as (
    select *, cast(w * (total - before) as double) / cast(rest as double) > 2 * source_size above from o
), l as (
    select cast(arg_min(total - before, before) as double) num, cast(arg_min(rest, before) as double) den from c where not above
), t as (
    select c.source, source_size, case when above then cast(2 * source_size as double) else w * num / den end target from c, l
), n as (
    select *, row_number() over (partition by doc_id, source, text) copy from documents
), m as (
    select doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as bigint) size,
        concat_ws(':', '0', cast(doc_id as varchar), md5(text), cast(copy as varchar)) k0, concat_ws(':', '1', cast(doc_id as varchar), md5(text), cast(copy as varchar)) k1 from n
), p as (
    select m.doc_id, m.source, size, source_size, target, cast(floor(target) as bigint) goal,
        coalesce(sum(size) over (partition by m.source order by md5(k0), m.doc_id rows between unbounded preceding and 1 preceding), 0) a,
        coalesce(sum(size) over (partition by m.source order by md5(k1), m.doc_id rows between unbounded preceding and 1 preceding), 0) b
    from m join t on m.source is not distinct from t.source
), z as (
    select source, row_number() over (order by source nulls last) - 1 no, cast(ceil(floor(target) / 2048) as bigint) need from t
), e as (
    select *, cast(sum(need) over (order by no) as double) / sum(need) over () upper_edge, cast(sum(need) over (order by no) - need as double) / sum(need) over () lower_edge, cast(sum(need) over () + 8 * count(*) over () as bigint) slots from z
), k as (
    select k, cast(((cast(k as hugeint) * 11400714819323198485) % 18446744073709551616) // 2048 as double) * power(2.0, -53) x from (select unnest(range(0, (select max(slots) from e))) k)
), drawn as (
    select source, no, need, slots, k, row_number() over (partition by no order by k) - 1 block_no from k join e on x >= lower_edge and x < upper_edge
), late as (
    select e.source, e.no, e.slots, unnest(range(coalesce(got, 0), need)) block_no from e left join (select no, count(*) got from drawn where block_no < need group by no) g on e.no = g.no
), sched as (
    select source, block_no, k slot from drawn where block_no < need
    union all select source, block_no, slots + row_number() over (order by no, block_no) - 1 from late
)
select doc_id, p.source, size, source_size, target, cast(greatest(0, least(size, goal - a)) + greatest(0, least(size, goal - source_size - b)) as bigint) taken, cast(slot as bigint) slot
from p left join sched on p.source is not distinct from sched.source and size > 0 and a < goal and sched.block_no = a // 2048
"""
