"""Benchmark decontamination: word windows of benchmark items, found in training texts.

Words are runs of [0-9a-z] and of characters beyond ASCII, after A-Z are lower-cased. A benchmark item's windows are
its runs of `width` words; an item of fewer words, but not none, is one window. The windows' hashes are a broadcast
hash set; each place of a text looks its own window's hash up, and the words themselves are compared on a hit. All of
it is built-in expressions.

Beyond MOST_BROADCAST windows a shuffle finds the texts' windows: hashes alone are joined first, and only the places
whose hash is one of the benchmark's carry their words to the comparison.

A null text has no words; a text or item without words has no window. Items count by their distinct item_ids; windows of
items with a null item_id hit words like any other, but no id stands for them in the list or the number of items. There is
a result for each row of the documents, equal rows included. An empty benchmark hits nothing; empty documents give an
empty result. Other columns are kept as they are, whatever their names, by drop and cut, and not read otherwise.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labelloom.llm.common import ascii_lower, row_hash, table, text_or_empty

WIDTH = 10
#: Windows that are broadcast at most; beyond, the windows are joined by a shuffle on their hashes.
MOST_BROADCAST = 500_000
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    return F.filter(F.split(ascii_lower(text), SEPARATORS), lambda w: w != "")


def hash_at(words: str, at: str, width: int) -> Column:
    return F.xxhash64(*(F.get(words, F.col(at) + k) for k in range(width)))


def benchmark_windows(benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """size, hash, window (its words), items (sorted, as strings): a row for each distinct window."""
    words = benchmark.select(F.col("item_id").cast("string").alias("item"), words_of(text_or_empty()).alias("words")).where(F.size("words") > 0)
    size = F.least(F.size("words"), F.lit(width))
    each = words.select("item", size.alias("size"), F.explode(F.transform(F.sequence(F.lit(1), F.size("words") - size + 1), lambda i: F.slice("words", i, size))).alias("window"))
    hashes = F.expr("case size " + " ".join(f"when {n} then xxhash64({', '.join(f'window[{k}]' for k in range(n))})" for n in range(1, width + 1)) + " end")
    return each.groupBy("size", "window").agg(F.array_sort(F.collect_set("item")).alias("items")).select("size", hashes.alias("hash"), "window", "items")


def covered(spans: Column) -> Column:
    """Words inside the sorted spans (at, size)."""
    state = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("int").alias("end"))
    step = lambda s, x: F.struct((s.n + F.greatest(F.lit(0), x.at + x.size - F.greatest(s.end, x.at))).cast("long").alias("n"), F.greatest(s.end, x.at + x.size).alias("end"))
    return F.aggregate(spans, state, step, lambda s: s.n)


def broadcast_hits(rows: DataFrame, windows: DataFrame, sizes: list[int]) -> DataFrame:
    """rows (key, n_words, words) -> key, n_words, found (at, size, items) for the first word and each place with a hit."""
    key = [c for c in rows.columns if c not in ("words", "n_words")]
    # What stays in one generated loop from here to the filter is never copied: no higher-order function stands between.
    rows = rows.select(*key, "n_words", "words", F.posexplode_outer("words").alias("at", "word"))
    own = {size: F.when(F.col("at") + size <= F.col("n_words"), hash_at("words", "at", size)) for size in sizes}
    for size in sizes:
        some = windows.where(F.col("size") == size).select(F.col("hash").alias(f"hash{size}"), F.col("window").alias(f"window{size}"), F.col("items").alias(f"items{size}"))
        rows, some = rows.withColumn(f"own{size}", own[size]), F.broadcast(some)
        # Compared after the hash; coalesce keeps the comparison from becoming a key of the join.
        same = F.coalesce(reduce(and_, (F.get(rows["words"], rows["at"] + k) == F.get(some[f"window{size}"], F.lit(k)) for k in range(size))), F.lit(False))
        rows = rows.join(some, (rows[f"own{size}"] == some[f"hash{size}"]) & same, "left").drop(f"own{size}", f"hash{size}", f"window{size}")
    rows = rows.where(" or ".join(["at is null", "at = 0", *(f"items{size} is not null" for size in sizes)]))
    hits = [F.when(F.col(f"items{size}").isNotNull(), F.struct("at", F.lit(size).alias("size"), F.col(f"items{size}").alias("items"))) for size in sizes]
    return rows.select(*key, "n_words", F.coalesce(F.col("at") > 0, F.lit(False)).alias("later"), F.filter(F.array(*hits), lambda x: x.isNotNull()).alias("found"))


def shuffled_hits(rows: DataFrame, windows: DataFrame, sizes: list[int]) -> DataFrame:
    """The same by shuffles. Places without a whole window take no part."""
    key = ["id", "row"]
    each = [F.when(F.col("at") + size <= F.col("n_words"), F.struct(F.lit(size).alias("size"), hash_at("words", "at", size).alias("hash"))) for size in sizes]
    places = rows.select(*key, "words", "n_words", F.posexplode("words").alias("at", "word")).select(*key, "at", F.explode(F.array(*each)).alias("x")).where("x is not null").select(*key, "at", "x.size", "x.hash")
    met = places.distinct().join(windows.select("size", "hash").distinct(), ["size", "hash"], "left_semi")
    texts = rows.select(F.struct(*key).alias("text_key"), "words").distinct()
    words = met.withColumn("text_key", F.struct(*key)).join(texts, "text_key").select("text_key", "at", "size", "hash", F.slice("words", F.col("at") + 1, F.col("size")).alias("window"))
    found = words.join(windows, ["size", "hash", "window"]).groupBy("text_key").agg(F.collect_set(F.struct("at", "size", "items")).alias("found"))
    plain = rows.select(*key, "n_words", F.lit(False).alias("later"), F.array().cast(found.schema["found"].dataType).alias("found"))
    return plain.unionByName(found.select("text_key.id", "text_key.row", F.lit(0).cast("long").alias("n_words"), F.lit(True).alias("later"), "found"))


def window_hits(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """id, row, copies, n_words, spans (sorted: at, size), items (sorted): a row for all equal rows of docs; copies: how
    many they are. id: the doc_id.

    Lengths of windows other than `width` come from short items; there are at most width - 1 of them.
    """
    windows = benchmark_windows(benchmark, width)
    counts = {r["size"]: r["n"] for r in windows.groupBy("size").agg(F.count("*").alias("n")).collect()}
    split = docs.select(docs["doc_id"].cast("long").alias("id"), row_hash(docs).alias("row"), words_of(F.coalesce(docs["text"].cast("string"), F.lit(""))).alias("words"))
    rows = split.select("id", "row", "words", F.size("words").cast("long").alias("n_words"))
    sizes = sorted(counts) or [width]
    few = (broadcast_hits if sum(counts.values()) <= most_broadcast else shuffled_hits)(rows, windows, sizes)
    spans = F.array_sort(F.array_distinct(F.flatten(F.collect_list("found"))))
    return (
        few.groupBy("id", "row")
        .agg(F.count_if(~F.col("later")).alias("copies"), F.max("n_words").alias("n_words"), spans.alias("found"))
        .select("id", "row", "copies", "n_words", F.transform("found", lambda x: F.struct(x["at"].alias("at"), x["size"].alias("size"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.transform("found", lambda x: x["items"])))).alias("items"))
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans; a row for each row of docs."""
    found = window_hits(docs, benchmark, width, most_broadcast)
    n_hit = covered(F.col("spans"))
    out = found.select(F.col("id").alias("doc_id"), "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"), F.array_join(F.transform("spans", lambda x: F.concat_ws("+", x["at"], x["size"])), ",").alias("spans"), F.explode(F.sequence(F.lit(1), "copies")).alias("copy"))
    return out.drop("copy")


def hit_rows(docs: DataFrame, benchmark: DataFrame, width: int) -> DataFrame:
    return window_hits(docs, benchmark, width).where(F.size("spans") > 0).select("id", "row", "spans")


def holds(docs: DataFrame, hit: DataFrame) -> Column:
    return docs["doc_id"].cast("long").eqNullSafe(hit["id"]) & (row_hash(docs) == hit["row"])


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """The rows of docs that hold no window; columns as they are."""
    hit = hit_rows(docs, benchmark, width)
    return docs.join(hit, holds(docs, hit), "left_anti")


def cut_contaminated(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """docs with the words inside windows, and the separators right after each, taken out of their texts."""
    hit = hit_rows(docs, benchmark, width)
    joined = docs.join(hit, holds(docs, hit), "left")
    word = "[0-9A-Za-z\\x{80}-\\x{10FFFF}]+[^0-9A-Za-z\\x{80}-\\x{10FFFF}]*"
    lead = F.regexp_extract(docs["text"], "^[^0-9A-Za-z\\x{80}-\\x{10FFFF}]*", 0)
    pieces = F.filter(F.regexp_extract_all(docs["text"], F.lit(word), F.lit(0)), lambda w, i: ~F.exists(hit["spans"], lambda s: (i >= s["at"]) & (i < s["at"] + s["size"])))
    text = F.when(hit["spans"].isNull(), docs["text"]).otherwise(F.concat(lead, F.array_join(pieces, "")))
    return joined.select(*(text.alias(c) if c == "text" else docs[c] for c in docs.columns))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP4_SQL = r"""
with b as (
    select cast(item_id as varchar) item, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') words
    from benchmark
), bw as (
    select item, least(len(words), 10) size, list_slice(words, i, i + least(len(words), 10) - 1) win
    from (select item, words, unnest(range(1, len(words) - least(len(words), 10) + 2)) i from b where len(words) > 0)
), d as (
    select row_number() over () r, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') words
    from documents
), dw as (
    select r, i, size, list_slice(words, i, i + size - 1) win
    from (select r, words, size, unnest(range(1, len(words) - size + 2)) i from d, (select distinct size from bw) where len(words) >= size)
), hit as (
    select distinct r, i, size, item from dw join bw using (size, win)
), word as (
    select r, count(distinct p) n_hit from (select r, unnest(range(i, i + size)) p from (select distinct r, i, size from hit)) group by r
), item as (
    select r, count(*) n_items, string_agg(item, ',' order by item) items from (select distinct r, item from hit where item is not null) group by r
), span as (
    select r, string_agg(cast(i - 1 as varchar) || '+' || cast(size as varchar), ',' order by i, size) spans from (select distinct r, i, size from hit) group by r
)
select d.doc_id, cast(len(words) as bigint) n_words, coalesce(n_hit, 0) n_hit, coalesce(n_items, 0) n_items, sha256(coalesce(items, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated, coalesce(spans, '') spans
from d left join word using (r) left join item using (r) left join span using (r)
"""
