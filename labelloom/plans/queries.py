"""The registered queries: each applies operators to whole tables of the test schema, beside SQL that says the same.

lineitem joined with part stands for the text blocks of an image (an order); FIXTURES.md lists the operators' own tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from labelloom.functions import geometry as G
from labelloom.functions import keys as V
from labelloom.functions import text as T
from labelloom.functions.distance import CONFUSIONS, confusion_table
from labelloom.operators import blocks as B
from labelloom.operators import fields as R
from labelloom.operators import images as I
from labelloom.operators import metadata as M
from labelloom.operators import pixels as X
from labelloom.operators import template as P
from labelloom.operators import vocabulary as J
from labelloom.operators.linear import LinearDecoder, drawn
from labelloom.operators.numbering import numbered
from labelloom.operators.store import MetadataTable, shared_folder
from labelloom.plans.pipeline import read_fields, read_labels
from labelloom.sources import images as S
from labelloom.sources import vocabulary as VS

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---------------------------------------------------------------- views


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")
    return rows.select(
        F.col("l_orderkey").alias("image_id"),
        F.row_number().over(order).cast("long").alias("block_idx"),
        F.when(F.col("l_returnflag") == "N", "LINE").otherwise("WORD").alias("type"),
        F.col("p_name").alias("text"),
        (F.col("l_discount") * 10).cast("float").alias("confidence"),
        G.box(F.col("l_partkey") % 400, (F.col("l_suppkey") * 7) % 300, F.lit(20) + F.col("l_quantity").cast("int"), F.lit(10) + 2 * F.col("l_linenumber")).alias("box"),
    )


BLOCKS = """
blocks as (
    select l_orderkey image_id, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) block_idx,
        case when l_returnflag = 'N' then 'LINE' else 'WORD' end type, p_name as text, cast(l_discount * 10 as float) confidence,
        cast(l_partkey % 400 as int) x, cast((l_suppkey * 7) % 300 as int) y, 20 + cast(trunc(l_quantity) as int) w, 10 + 2 * l_linenumber h
    from lineitem join part on l_partkey = p_partkey
)
"""


def flat(df: DataFrame) -> DataFrame:
    b = F.col("box")
    return df.select(*(c for c in df.columns if c != "box"), b["x"].alias("x"), b["y"].alias("y"), b["width"].alias("w"), b["height"].alias("h"))


def vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "part").select(F.col("p_name").alias("value")).distinct()
    return numbered(names, ["value"], "vocab_idx", 0).select("vocab_idx", "value")


def misread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p_partkey, text: names as recognition might have read them."""
    n, k = F.col("p_name"), F.col("p_partkey") % 5
    text = F.when(k == 0, F.translate(n, "ol", "01")).when(k == 1, F.upper(n)).when(k == 2, F.concat(n, F.lit("x"))).when(k == 3, F.concat(F.lit("q"), F.substring(n, 3, 100))).otherwise(n)
    return table(spark, sf_dir, "part").select("p_partkey", text.alias("text"))


VOCABULARY = """
vocab as (select row_number() over (order by value) - 1 vocab_idx, value from (select distinct p_name as value from part)),
misread as (
    select p_partkey, case p_partkey % 5 when 0 then translate(p_name, 'ol', '01') when 1 then upper(p_name) when 2 then p_name || 'x' when 3 then 'q' || substr(p_name, 3, 100) else p_name end as text
    from part
),
near as (
    select text, vocab_idx, value, cast(d as double) distance, case when m = 0 then 1.0 else 1.0 - d / cast(m as double) end similarity, lower(text) = lower(value) exact
    from (select *, levenshtein(lower(text), lower(value)) d, greatest(length(text), length(value)) m from (select distinct text from misread), vocab where abs(length(text) - length(value)) <= 2)
    where d <= 2 and (case when m = 0 then 1.0 else 1.0 - d / cast(m as double) end) >= 0.6
),
best as (
    select text, arg_min(value, rank) matched, arg_min(distance, rank) distance, arg_min(similarity, rank) similarity
    from (select *, row_number() over (partition by text order by (not exact), distance, vocab_idx) rank from near) group by text
)
"""

TEMPLATE = P.Template(
    name="slide label",
    mappings=(
        P.FieldMapping(0, "CaseID", "CASE-1", True, 0.05, 0.10, 0.40, 0.12, True, "TEXT"),
        P.FieldMapping(1, "Barcode", None, True, 0.75, 0.30, 0.20, 0.35, True, "BARCODE"),
        P.FieldMapping(2, "Stain", None, True, 0.0, 0.0, 0.40, 0.20, True, "AUTO"),
        P.FieldMapping(3, "Off", None, False, 0.1, 0.1, 0.1, 0.1, True, "TEXT"),
        P.FieldMapping(4, "Tiny", None, True, 0.5, 0.5, 0.001, 0.001, True, "TEXT"),
        P.FieldMapping(5, "Note", None, True),
    ),
)
TEMPLATE_SQL = """
template(field_index, metadata_key, enabled, nx, ny, nw, nh, has_box, region_type) as (values
    (0, 'CaseID', true, 0.05::double, 0.10::double, 0.40::double, 0.12::double, true, 'TEXT'), (1, 'Barcode', true, 0.75, 0.30, 0.20, 0.35, true, 'BARCODE'), (2, 'Stain', true, 0.0, 0.0, 0.40, 0.20, true, 'AUTO'),
    (3, 'Off', false, 0.1, 0.1, 0.1, 0.1, true, 'TEXT'), (4, 'Tiny', true, 0.5, 0.5, 0.001, 0.001, true, 'TEXT'), (5, 'Note', true, 0.0, 0.0, 0.0, 0.0, false, 'TEXT'))
"""

# ---------------------------------------------------------------- text filters: F1-F9, F12, F15, A9, R10

PLAIN = {"filter_letters_only": (T.LETTERS_ONLY, "[^a-zA-Z]", ""), "filter_numbers_only": (T.NUMBERS_ONLY, "[^0-9]", ""), "filter_alphanumeric": (T.ALPHANUMERIC, "[^a-zA-Z0-9]", ""), "filter_filename_safe": (T.FILENAME_SAFE, "[^a-zA-Z0-9._-]", ""), "filter_standard_chars": (T.STANDARD_CHARS, "[^a-zA-Z0-9\\s.,;:!?''\"()-]", ""), "filter_no_whitespace": (T.NO_WHITESPACE, "\\s+", "_")}


def plain_filter(f: T.TextFilter) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        part = table(spark, sf_dir, "part").select(F.concat_ws(" / ", "p_name", "p_brand", "p_type").alias("original_text"))
        urls = table(spark, sf_dir, "pages").select(F.col("url").alias("original_text"))
        return part.unionByName(urls).select("original_text", f(F.col("original_text")).alias("text"))

    return run


for name, (one, pattern, new) in PLAIN.items():
    QUERIES[name] = plain_filter(one)
    ORACLE_SQL[name] = f"select original_text, regexp_replace(original_text, '{pattern}', '{new}', 'g') as text from (select concat_ws(' / ', p_name, p_brand, p_type) original_text from part union all select url from pages)"


@query("""
select p_partkey, case when p_size % 2 = 0 then p_brand else regexp_replace(regexp_replace(p_brand, '[^a-zA-Z0-9._-]', '', 'g'), '[^0-9]', '', 'g') end as text,
    case when p_size % 2 = 0 then 'BARCODE' else 'TEXT' end region_type
from part
""")
def filter_chain(spark, sf_dir):
    kind = F.when(F.col("p_size") % 2 == 0, "BARCODE").otherwise("TEXT")
    return table(spark, sf_dir, "part").select("p_partkey", T.filter_text_fields(F.col("p_brand"), kind, T.FILENAME_SAFE, T.NUMBERS_ONLY).alias("text"), kind.alias("region_type"))


@query("select count(*) filter (p_name <> regexp_replace(p_name, '\\s+', '_', 'g')) modified_fields, count(distinct case when p_name <> regexp_replace(p_name, '\\s+', '_', 'g') then p_brand end) modified_images from part")
def filter_statistics(spark, sf_dir):
    return R.filter_statistics(table(spark, sf_dir, "part").select(F.col("p_brand").alias("image_id"), F.col("p_name").alias("text")), T.NO_WHITESPACE)


@query("select l_orderkey, l_linenumber, l_discount, cast(floor(cast(cast(l_discount as float) * cast(100 as float) as float) + cast(0.5 as float)) as int) percent, round(l_discount * 100) || '%' shown from lineitem")
def confidence_percent(spark, sf_dir):
    c = F.col("l_discount")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_discount", T.confidence_percent(c).alias("percent"), F.concat(F.round(c * 100), F.lit("%")).alias("shown"))


@query("select event_id, case when length(props) > 5 then substr(props, 1, 5) || '...' else props end short from events")
def text_shortened(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", T.shortened(F.col("props"), 5).alias("short"))


# ---------------------------------------------------------------- keys: V1-V5

KEYS = "select distinct k as metadata_key from (select p_name as k from part union all select p_brand from part union all select url from pages union all select substr(props, 1, 3) from events union all select 'name' union all select 'OWNER' union all select ' CaseID ' union all select '1abc' union all select '' union all select 'ok_key')"
ERROR = """case when trim(metadata_key) = '' then 'empty' when length(trim(metadata_key)) > 128 then 'length'
    when lower(trim(metadata_key)) in ({reserved}) then 'reserved' when not regexp_matches(trim(metadata_key), '^[a-zA-Z_][a-zA-Z0-9_-]*$') then 'pattern' end""".format(reserved=", ".join(f"'{k.lower()}'" for k in V.RESERVED))


def some_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    fixed = spark.createDataFrame([(k,) for k in ("name", "OWNER", " CaseID ", "1abc", "", "ok_key")], "k string")
    parts = [part.select(F.col("p_name").alias("k")), part.select(F.col("p_brand").alias("k")), table(spark, sf_dir, "pages").select(F.col("url").alias("k")), table(spark, sf_dir, "events").select(F.substring("props", 1, 3).alias("k")), fixed]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct().withColumnRenamed("k", "metadata_key")


@query(f"select metadata_key, {ERROR} is null valid, lower(trim(metadata_key)) in ({', '.join(repr(k.lower()) for k in V.RESERVED)}) reserved from ({KEYS})")
def validate_keys(spark, sf_dir):
    key = F.col("metadata_key")
    return some_keys(spark, sf_dir).select("metadata_key", V.validate_key(key)["valid"].alias("valid"), V.is_reserved(T.control_trim(key)).alias("reserved"))


SANITIZED = """
keys as ({keys}),
kept as (select metadata_key, regexp_replace(translate(trim(metadata_key), ' ./\\:', '_____'), '[^a-zA-Z0-9_-]', '', 'g') k from keys),
led as (select metadata_key, case when k = '' then null when regexp_matches(k, '^[a-zA-Z_]') then substr(k, 1, 128) else substr('ocr_' || k, 1, 128) end k from kept),
clean as (select metadata_key, case when lower(k) in ({reserved}) then 'ocr_' || k else k end k from led)
""".format(keys=KEYS, reserved=", ".join(f"'{k.lower()}'" for k in V.RESERVED))


@query(f"with {SANITIZED} select metadata_key, k sanitized, case when trim(metadata_key) <> '' then 'OCR_' || k end ocr_key from clean")
def sanitize_keys(spark, sf_dir):
    key = F.col("metadata_key")
    return some_keys(spark, sf_dir).select("metadata_key", V.sanitize_key(key).alias("sanitized"), V.ocr_key(key).alias("ocr_key"))


@query(f"""
with keys as ({KEYS}), tried as (select metadata_key orig, 'ocr_' || metadata_key metadata_key from keys)
select orig metadata_key, case when {ERROR} is null then 'ocr_' || orig else (case when {ERROR.replace("metadata_key", "('label_' || orig)")} is null then 'label_' || orig else 'custom_' || orig end) end suggested from tried
""")
def suggest_keys(spark, sf_dir):
    return some_keys(spark, sf_dir).select("metadata_key", V.suggest_key(F.col("metadata_key")).alias("suggested"))


# ---------------------------------------------------------------- blocks: P1-P6, A1-A7, W1-W2, G1-G6, J7, O5, O7


@query(f"with {BLOCKS} select image_id, block_idx, type, text, confidence, x, y, w, h from blocks where cast(confidence as double) >= 0.7")
def confidence_filter(spark, sf_dir):
    return flat(B.above_confidence(blocks(spark, sf_dir), 0.7))


@query(f"with {BLOCKS} select image_id, block_idx, type, text from (select *, bool_or(type = 'LINE') over (partition by image_id) l from blocks where text <> '') where (l and type = 'LINE') or (not l and type = 'WORD')")
def line_else_word(spark, sf_dir):
    return B.lines_else_words(B.not_blank(blocks(spark, sf_dir))).select("image_id", "block_idx", "type", "text")


@query(f"""
with {BLOCKS}, b as (select * replace (case when x % 5 = 0 then '' else text end as text) from blocks), m as (select *, bool_or(type = 'LINE') over (partition by image_id) l from b)
select image_id, block_idx, text from m where l and type = 'LINE' and text <> '' union all select image_id, min(block_idx), text from m where not l and text <> '' group by image_id, text
""")
def line_else_distinct(spark, sf_dir):
    return B.lines_else_distinct(blocks(spark, sf_dir).withColumn("text", F.when(F.col("box.x") % 5 == 0, "").otherwise(F.col("text"))))


@query(f"""
with {BLOCKS}, f as (select image_id, text, min(block_idx) b from blocks group by image_id, text)
select image_id, string_agg(text, '|' order by b) texts from f group by image_id
""")
def distinct_texts(spark, sf_dir):
    return B.distinct_texts(blocks(spark, sf_dir)).select("image_id", F.array_join("texts", "|").alias("texts"))


@query(f"""
with {BLOCKS} select image_id, round(avg(confidence), 6) avg_confidence, cast(min(confidence) as double) min_confidence, cast(max(confidence) as double) max_confidence, count(*) n_blocks,
    count(*) filter (type = 'LINE' and text <> '') n_lines, count(*) filter (type = 'WORD' and text <> '') n_words,
    case when count(*) filter (type = 'LINE' and text <> '') > 0 then count(*) filter (type = 'LINE' and text <> '') else count(*) filter (type = 'WORD' and text <> '') end n_display
from blocks group by image_id
""")
def confidence_stats(spark, sf_dir):
    return B.confidence_statistics(blocks(spark, sf_dir)).withColumn("avg_confidence", F.round("avg_confidence", 6))


@query(f"with {BLOCKS} select image_id, string_agg(text, ' ' order by block_idx) full_text from blocks where text <> '' group by image_id")
def full_text(spark, sf_dir):
    return B.full_text(blocks(spark, sf_dir))


@query(f"with {BLOCKS} select image_id, substr(string_agg((case when type = 'LINE' then chr(10) else ' ' end) || text, '' order by block_idx), 2) formatted_text from blocks group by image_id")
def formatted_text(spark, sf_dir):
    return B.formatted_text(blocks(spark, sf_dir))


@query(f"with {BLOCKS} select image_id, min(x) x, min(y) y, max(x + w) - min(x) w, max(y + h) - min(y) h from blocks group by image_id")
def union_bbox(spark, sf_dir):
    return flat(B.union_box(blocks(spark, sf_dir)))


@query(f"""
with {BLOCKS} select image_id, string_agg(text, ' ' order by type = 'LINE', block_idx) as text, round(cast(sum(cast(confidence as double)) / count(*) as float), 4) confidence, min(x) + 5 x, min(y) + 6 y, max(x + w) - min(x) w, max(y + h) - min(y) h
from blocks group by image_id
""")
def region_text(spark, sf_dir):
    return flat(B.combine_region(blocks(spark, sf_dir), ["image_id"], 5, 6)).withColumn("confidence", F.round("confidence", 4))


@query(f"""
with {BLOCKS} select image_id, string_agg(text, ';' order by block_idx) as text, case when count(*) > 1 then 'MULTIPLE' else min(type) end format, arg_min(text, block_idx) first_text, arg_min(type, block_idx) first_format, count(*) n from blocks group by image_id
""")
def barcode_combine(spark, sf_dir):
    return B.combine_barcodes(blocks(spark, sf_dir).select("image_id", F.col("block_idx").alias("ord"), "text", F.col("type").alias("format")))


@query(f"""
with {BLOCKS} select image_id, block_idx, x + w max_x, y + h max_y, x + w / 2.0::double center_x, y + h / 2.0::double center_y, cast(w as bigint) * h area, 100 >= x and 100 < x + w and 100 >= y and 100 < y + h has_point from blocks
""")
def bbox_props(spark, sf_dir):
    b = F.col("box")
    return blocks(spark, sf_dir).select("image_id", "block_idx", G.right(b).alias("max_x"), G.bottom(b).alias("max_y"), G.center_x(b).alias("center_x"), G.center_y(b).alias("center_y"), G.area(b).alias("area"), G.contains(b, F.lit(100), F.lit(100)).alias("has_point"))


@query(f"""
with {BLOCKS}, p as (
    select a.image_id, a.block_idx i, b.block_idx j, cast(least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x) as bigint) * (least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y)) overlap, least(cast(a.w as bigint) * a.h, cast(b.w as bigint) * b.h) s
    from blocks a join blocks b on a.image_id = b.image_id and a.block_idx < b.block_idx and a.x < b.x + b.w and b.x < a.x + a.w and a.y < b.y + b.h and b.y < a.y + a.h
) select image_id, i, j, overlap, s > 0 and overlap > 0.5 * s same_place from p
""")
def bbox_intersections(spark, sf_dir):
    return B.overlapping_pairs(blocks(spark, sf_dir))


@query(f"""
with recursive {BLOCKS}, lines as (select image_id, row_number() over (partition by image_id order by block_idx) r, block_idx, x, y, w, h, confidence from blocks where type = 'LINE'),
listed as (select image_id, list({{'b': block_idx, 'x': x, 'y': y, 'w': w, 'h': h, 'c': confidence}} order by r) ls, list(r order by r) todo from lines group by image_id),
walk as (
    select image_id, ls, todo[2:] todo, todo[1] best, todo[2:] ahead, cast([] as bigint[]) kept, false finished from listed
    union all
    select image_id, ls,
        case when len(ahead) = 0 then todo[2:] when hit then list_filter(todo, lambda t: t <> ahead[1]) else todo end,
        case when len(ahead) = 0 then todo[1] when hit and ls[ahead[1]].c > ls[best].c then ahead[1] else best end,
        case when len(ahead) = 0 then todo[2:] else ahead[2:] end,
        case when len(ahead) = 0 then list_append(kept, best) else kept end,
        len(ahead) = 0 and len(todo) = 0
    from (
        select *, len(ahead) > 0 and ls[best].x < ls[ahead[1]].x + ls[ahead[1]].w and ls[ahead[1]].x < ls[best].x + ls[best].w and ls[best].y < ls[ahead[1]].y + ls[ahead[1]].h and ls[ahead[1]].y < ls[best].y + ls[best].h
            and (least(ls[best].x + ls[best].w, ls[ahead[1]].x + ls[ahead[1]].w) - greatest(ls[best].x, ls[ahead[1]].x)) * (least(ls[best].y + ls[best].h, ls[ahead[1]].y + ls[ahead[1]].h) - greatest(ls[best].y, ls[ahead[1]].y)) > 0.5 * least(ls[best].w * ls[best].h, ls[ahead[1]].w * ls[ahead[1]].h) hit
        from walk where not finished
    )
) select image_id, ls[k].b block_idx from (select image_id, ls, unnest(kept) k from walk where finished)
""")
def dedup_blocks(spark, sf_dir):
    return B.dedupe_blocks(B.of_type(blocks(spark, sf_dir), "LINE")).select("image_id", "block_idx")


@query(f"""
with {BLOCKS}, k as (select * from (select *, bool_or(type = 'LINE') over (partition by image_id) l from blocks where text <> '') where (l and type = 'LINE') or (not l and type = 'WORD'))
select image_id, block_idx, 'OCR_field_' || (row_number() over (partition by image_id order by block_idx) + 1) metadata_key, row_number() over (partition by image_id order by block_idx) + 1 field_index from k
""")
def field_keys(spark, sf_dir):
    return B.field_keys(B.lines_else_words(blocks(spark, sf_dir)), "OCR_", "field", 2).select("image_id", "block_idx", "metadata_key", F.col("field_index").cast("long").alias("field_index"))


# ---------------------------------------------------------------- templates: J4-J6, G7-G10, P7, K8, K13, R1, R8, O4, W3

IMAGES_SQL = "images as (select o_orderkey image_id, cast(200 + o_custkey % 900 as int) width, cast(100 + o_orderkey % 500 as int) height from orders)"


def image_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("image_id"), (200 + F.col("o_custkey") % 900).cast("int").alias("width"), (100 + F.col("o_orderkey") % 500).cast("int").alias("height"))


@query(f"""
with {IMAGES_SQL}, {TEMPLATE_SQL}, d as (select *, case when region_type in ('BARCODE', 'AUTO') then greatest(1.2::double, 2.5) else 1.2::double end f from images, template where enabled and has_box),
p as (select *, greatest(0.0, (nx + nw / 2 - nw * f / 2) * width) x, greatest(0.0, (ny + nh / 2 - nh * f / 2) * height) y from d),
q as (select image_id, field_index, metadata_key, region_type, cast(trunc(x) as int) x, cast(trunc(y) as int) y, cast(trunc(least(nw * f * width, width - x)) as int) w, cast(trunc(least(nh * f * height, height - y)) as int) h from p)
select * from q where w >= 5 and h >= 5
""")
def template_regions(spark, sf_dir):
    return flat(P.template_regions(image_sizes(spark, sf_dir), TEMPLATE.fields(spark), TEMPLATE.dilation))


@query(f"""
with {BLOCKS}, {TEMPLATE_SQL}, t as (select image_id, list(text order by block_idx) texts from blocks group by image_id)
select image_id, field_index, metadata_key, coalesce(texts[field_index + 1], '') as text from t, template where enabled
""")
def positional_mapping(spark, sf_dir):
    texts = blocks(spark, sf_dir).groupBy("image_id").agg(B.ordered(F.col("text")).alias("texts"))
    return P.positional_fields(texts, TEMPLATE.fields(spark))


@query(f"""
with {BLOCKS}, t as (select image_id, list(text order by block_idx) texts from blocks group by image_id), m(i, k) as (values (0, 'first'), (2, 'third'), (99, 'none'))
select image_id, k as key, texts[i + 1] as value from t, m where i < len(texts)
""")
def map_by_index(spark, sf_dir):
    texts = blocks(spark, sf_dir).groupBy("image_id").agg(B.ordered(F.col("text")).alias("texts"))
    return M.long_form(P.map_by_index(texts, {0: "first", 2: "third", 99: "none"}))


@query(f"""
with {BLOCKS}, {TEMPLATE_SQL}, t as (select image_id, list(text order by block_idx) texts from blocks group by image_id)
select image_id, max(case when metadata_key = 'CaseID' then v end) "CaseID", max(case when metadata_key = 'Barcode' then v end) "Barcode", max(case when metadata_key = 'Stain' then v end) "Stain", max(case when metadata_key = 'Tiny' then v end) "Tiny", max(case when metadata_key = 'Note' then v end) "Note"
from (select image_id, metadata_key, coalesce(texts[field_index + 1], '') v from t, template where enabled) group by image_id
""")
def pivot_results(spark, sf_dir):
    return P.pivot_results(positional_mapping(spark, sf_dir), TEMPLATE.keys())


@query("select p_partkey field_index, case when p_size % 3 = 0 then 'OCR_field_' || p_partkey else p_brand end metadata_key, case when p_size % 2 = 0 then '' else p_type end example_text from part")
def template_preview(spark, sf_dir):
    key, example = F.when(F.col("p_size") % 3 != 0, F.col("p_brand")), F.when(F.col("p_size") % 2 != 0, F.col("p_type"))
    return P.preview_rows(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("field_index"), key.alias("metadata_key"), example.alias("example_text")))


@query(f"""
with {BLOCKS}, {IMAGES_SQL} select b.image_id, block_idx, round(x / cast(width as double), 9) nx, round(y / cast(height as double), 9) ny, round(w / cast(width as double), 9) nw, round(h / cast(height as double), 9) nh from blocks b join images i on b.image_id = i.image_id
""")
def normalized_boxes(spark, sf_dir):
    rows = blocks(spark, sf_dir).join(image_sizes(spark, sf_dir), "image_id")
    n = G.normalized(F.col("box"), F.col("width"), F.col("height"))
    return rows.select("image_id", "block_idx", *(F.round(n[c], 9).alias(c) for c in ("nx", "ny", "nw", "nh")))


@query(f"""
with {BLOCKS}, {IMAGES_SQL}, m as (select b.image_id, block_idx, greatest(x - 50, 0) cx, greatest(y - 20, 0) cy, w, h, width, height from blocks b join images i on b.image_id = i.image_id),
c as (select *, least(w, width - cx) cw, least(h, height - cy) ch from m)
select image_id, block_idx, case when cw > 0 and ch > 0 then cx else 0 end x, case when cw > 0 and ch > 0 then cy else 0 end y, case when cw > 0 and ch > 0 then cw else width end w, case when cw > 0 and ch > 0 then ch else height end h from c
""")
def clamped_boxes(spark, sf_dir):
    rows = blocks(spark, sf_dir).join(image_sizes(spark, sf_dir), "image_id")
    return flat(rows.select("image_id", "block_idx", G.clamped_or_whole(G.offset(F.col("box"), -50, -20), F.col("width"), F.col("height")).alias("box")))


@query(f"""
with {IMAGES_SQL}, t as (select image_id, width, height, unnest([0, 1, 2, 3]) q from images where width > 300 and height > 300),
s as (select image_id, q, case when q % 2 = 1 then width // 2 - width // 4 else 0 end x, case when q >= 2 then height // 2 - height // 4 else 0 end y, case when q % 2 = 1 then width - width // 2 + width // 4 else width // 2 + width // 4 end w, case when q >= 2 then height - height // 2 + height // 4 else height // 2 + height // 4 end h, width, height from t)
select image_id, q, cast(x as int) x, cast(y as int) y, cast(least(w, width - x) as int) w, cast(least(h, height - y) as int) h from s
""")
def quadrant_tiles(spark, sf_dir):
    tiles = image_sizes(spark, sf_dir).select("image_id", F.posexplode(G.quadrants(F.col("width"), F.col("height"))).alias("q", "box"))
    return flat(tiles)


CARRY_SQL = f"""
with {BLOCKS}, {IMAGES_SQL}, f as (select image_id, block_idx field_index, case when block_idx % 3 = 0 then '' else 'K' || (x % 7) end metadata_key, x, y, w, h from blocks),
i as (select m.*, lag(m.image_id) over (order by m.image_id) p, lag(width) over (order by m.image_id) pw, lag(height) over (order by m.image_id) ph from images m where m.image_id in (select image_id from blocks)),
hit as (
    select n.image_id, n.field_index, arg_min(o.metadata_key, o.field_index) k
    from f n join i on n.image_id = i.image_id join f o on o.image_id = i.p and o.metadata_key <> ''
    where (o.x + o.w / 2.0::double) / i.pw between n.x / cast(i.width as double) and n.x / cast(i.width as double) + n.w / cast(i.width as double)
      and (o.y + o.h / 2.0::double) / i.ph between n.y / cast(i.height as double) and n.y / cast(i.height as double) + n.h / cast(i.height as double)
    group by n.image_id, n.field_index
) select f.image_id, f.field_index, coalesce(k, metadata_key) metadata_key from f left join hit using (image_id, field_index)
"""


@query(CARRY_SQL)
def centroid_carryover(spark, sf_dir):
    rows = blocks(spark, sf_dir)
    key = F.when(F.col("block_idx") % 3 == 0, "").otherwise(F.concat(F.lit("K"), F.col("box.x") % 7))
    fields = rows.select("image_id", F.col("block_idx").alias("field_index"), key.alias("metadata_key"), "box")
    counts = rows.groupBy("image_id").agg(F.count("*").alias("n_fields"))
    images = R.previous_images(image_sizes(spark, sf_dir).join(counts, "image_id", "left"))
    return R.carry_over_keys(fields, images).select("image_id", "field_index", "metadata_key")


@query("select p_partkey, p_brand, row_number() over (order by cast(regexp_replace(p_brand, '\\D+', '', 'g') as int), p_partkey) rank from part")
def key_numeric_sort(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_brand", T.numeric_key(F.col("p_brand")).alias("number"))
    return numbered(rows, ["number", "p_partkey"], "rank").drop("number")


# ---------------------------------------------------------------- vocabulary: J1-J3, D1-D8, O1-O3, A8, S8-S11


@query(f"with {VOCABULARY} select text, matched, distance, round(similarity, 9) similarity from best")
def vocab_best_match(spark, sf_dir):
    return J.best_matches(misread(spark, sf_dir), vocabulary(spark, sf_dir)).withColumn("similarity", F.round("similarity", 9))


@query(f"with {VOCABULARY} select text, cast(rank as int) rank, value matched, distance, round(similarity, 9) similarity from (select *, row_number() over (partition by text order by distance, vocab_idx) rank from near) where rank <= 3")
def vocab_top_k(spark, sf_dir):
    return J.top_matches(misread(spark, sf_dir), vocabulary(spark, sf_dir), most=3).withColumn("similarity", F.round("similarity", 9))


@query(f"with {VOCABULARY} select p_partkey, case when distance > 0 then matched else m.text end as text, distance from misread m left join best b on m.text = b.text")
def vocab_correct(spark, sf_dir):
    return J.correct(misread(spark, sf_dir), vocabulary(spark, sf_dir)).select("p_partkey", "text", "distance")


@query(f"""
with {VOCABULARY} select count(*) filter (distance > 0) corrected, count(*) filter (distance = 0) exact, count(*) filter (distance is null) no_match, count(distinct case when distance > 0 then p_partkey % 100 end) images_modified
from misread m left join best b on m.text = b.text
""")
def vocab_statistics(spark, sf_dir):
    rows = misread(spark, sf_dir).withColumn("image_id", F.col("p_partkey") % 100)
    return J.match_statistics(J.match(rows, vocabulary(spark, sf_dir)))


WEIGHTS_SQL = ", ".join(f"'{a}{b}': {w}" for w, group in CONFUSIONS.items() for p in group for a, b in ((p[0], p[1]), (p[1], p[0])))


@query(f"""
with recursive {VOCABULARY}, costs as (select map {{{WEIGHTS_SQL}}} m),
pairs as (select text, vocab_idx, value, lower(text) a, lower(value) b from (select distinct text from misread), vocab where abs(length(text) - length(value)) <= 2),
walk as (
    select text, vocab_idx, value, a, b, 0 i, list_transform(range(0, length(b) + 1), lambda x: cast(x as double)) r from pairs
    union all
    select text, vocab_idx, value, a, b, i + 1, list_reduce(list_transform(range(1, length(b) + 1), lambda x: [cast(x as double)]),
        lambda acc, j: list_append(acc, case when a[i + 1] = b[cast(j[1] as int)] then r[cast(j[1] as int)]
            else least(r[cast(j[1] as int) + 1] + 1, acc[cast(j[1] as int)] + 1, r[cast(j[1] as int)] + coalesce(m[a[i + 1] || b[cast(j[1] as int)]], 1.0)) end), [r[1] + 1])
    from walk, costs where i < length(a)
),
close as (select text, vocab_idx, value, a = b exact, r[length(b) + 1] d, 1 - r[length(b) + 1] / greatest(length(a), length(b)) s from walk where i = length(a)),
ranked as (select *, row_number() over (partition by text order by (not exact), d, vocab_idx) n from close where exact or (d <= 2 and s >= 0.6))
select text, value matched, round(d, 6) distance, round(s, 6) similarity from ranked where n = 1
""")
def vocab_best_match_weighted(spark, sf_dir):
    return J.best_matches(misread(spark, sf_dir), vocabulary(spark, sf_dir), J.Matcher(ocr_weights=True)).select("text", "matched", F.round("distance", 6).alias("distance"), F.round("similarity", 6).alias("similarity"))


CONFUSED = ", ".join(f"('{a}', '{b}', {w}::double)" for w, g in CONFUSIONS.items() for p in g for a, b in ((p[0], p[1]), (p[1], p[0])))


@query(f"""
with c(c1, c2, weight) as (values {CONFUSED}), n as (select distinct p_name || ' ' || p_brand || ' 0O1l' as t from part), g as (select t, substr(t, i, 1) c1, substr(t, i + 1, 1) c2 from (select t, unnest(range(1, length(t))) i from n))
select c.c1, c.c2, weight, count(*) places, count(distinct t) names from g join c on g.c1 = c.c1 and g.c2 = c.c2 group by all
""")
def confusions(spark, sf_dir):
    """Which confusable letters stand beside each other in the names of parts."""
    names = table(spark, sf_dir, "part").select(F.concat_ws(" ", "p_name", "p_brand", F.lit("0O1l")).alias("t")).distinct()
    places = names.select("t", F.explode(F.sequence(F.lit(1), F.char_length("t") - 1)).alias("i"))
    pairs = places.select("t", F.col("t").substr(F.col("i"), F.lit(1)).alias("c1"), F.col("t").substr(F.col("i") + 1, F.lit(1)).alias("c2"))
    return pairs.join(F.broadcast(confusion_table(spark)), ["c1", "c2"]).groupBy("c1", "c2", "weight").agg(F.count("*").alias("places"), F.count_distinct("t").alias("names"))


def quoted() -> Column:
    """Every third document's lines begin with a quote, as a quoted first column does."""
    return F.when(F.col("doc_id") % 3 == 0, F.regexp_replace("text", r"(?m)^(\w+) (\w+)", '"$1 $2",')).otherwise(F.col("text"))


LINES_SQL = "select doc_id, i line_no, regexp_replace(l, '^[\\x00-\\x20]+|[\\x00-\\x20]+$', '', 'g') line from (select doc_id, unnest(string_split(text, chr(10))) l, generate_subscripts(string_split(text, chr(10)), 1) - 1 i from (select doc_id, case when doc_id % 3 = 0 then regexp_replace(text, '(?m)^(\\w+) (\\w+)', '\"\\1 \\2\",', 'g') else text end as text from documents))"


@query(f"""
with l as ({LINES_SQL}), h as (select *, instr(line, ',') c, instr(line, chr(9)) t, instr(substr(line, 2), '"') - 1 q from l where line <> '')
select doc_id, line_no, regexp_matches(lower(line), 'sample|name|id|code|label|value|specimen|patient|slide|case|date') header,
    case when starts_with(line, '"') and q > 0 then substr(line, 2, q) when c > 1 then regexp_replace(substr(line, 1, c - 1), '^[\\x00-\\x20]+|[\\x00-\\x20]+$', '', 'g') else line end csv_value, case when t > 1 then regexp_replace(substr(line, 1, t - 1), '^[\\x00-\\x20]+|[\\x00-\\x20]+$', '', 'g') else line end tab_value
from h
""")
def vocabulary_lines(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split(quoted(), "\n")).alias("line_no", "line")).withColumn("line", T.control_trim(F.col("line")))
    line = F.col("line")
    return lines.where("line <> ''").select("doc_id", F.col("line_no").cast("long").alias("line_no"), VS.looks_like_header(line).alias("header"), VS.csv_first(line).alias("csv_value"), VS.tab_first(line).alias("tab_value"))


# ---------------------------------------------------------------- metadata: K1-K10, R2, R3, A10, A11, A14

ENTRIES_SQL = "entries as (select user_id image_id, 'OCR_' || event_type k, cast(max(event_id) as varchar) v from events group by user_id, event_type union all select distinct user_id, 'host', 'kept' from events)"


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image_id, metadata: of each user, the last event of each type, and a key of the host's."""
    events = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.max("event_id").cast("string").alias("v"))
    pairs = F.collect_list(F.struct(F.concat(F.lit("OCR_"), "event_type"), "v"))
    return events.groupBy(F.col("user_id").alias("image_id")).agg(F.map_concat(F.map_from_entries(pairs), F.create_map(F.lit("host"), F.lit("kept"))).alias("metadata"))


NEW = {"OCR_click": "new", "name": "no", "bad key!": "no", "CaseID": ""}


def new_map() -> Column:
    return F.create_map(*(F.lit(x) for pair in NEW.items() for x in pair))


@query(f"""
with {ENTRIES_SQL} select image_id, k as key, v as value from entries where k not in ('OCR_click', 'CaseID')
union all select image_id, k, v from (select distinct image_id from entries), (values ('OCR_click', 'new'), ('CaseID', '')) n(k, v)
""")
def metadata_upsert(spark, sf_dir):
    return M.long_form(entries(spark, sf_dir).select("image_id", M.upsert(F.col("metadata"), new_map()).alias("metadata")))


@query(f"with {ENTRIES_SQL} select image_id, k as key, v as value from entries where starts_with(k, 'OCR_')")
def metadata_by_prefix(spark, sf_dir):
    return M.long_form(entries(spark, sf_dir).select("image_id", M.by_prefix(F.col("metadata"), "OCR_").alias("metadata")))


@query(f"with {ENTRIES_SQL} select image_id, cast(count(*) filter (starts_with(k, 'OCR_')) as int) cleared, max(case when not starts_with(k, 'OCR_') then k || '=' || v end) left_over from entries group by image_id")
def metadata_clear_prefix(spark, sf_dir):
    m = F.col("metadata")
    left = F.array_join(F.transform(F.map_entries(M.clear_prefix(m, "OCR_")), lambda e: F.concat_ws("=", e["key"], e["value"])), ",")
    return entries(spark, sf_dir).select("image_id", M.cleared_count(m, "OCR_").alias("cleared"), left.alias("left_over"))


@query(f"""
with {ENTRIES_SQL} select image_id, coalesce(max(case when k = 'OCR_purchase' then v end), '') purchase, bool_or(k = 'OCR_purchase') has_purchase, cast(count(*) filter (k <> 'host') as int) n_after, bool_or(k = 'host') removed from entries group by image_id
""")
def metadata_reads(spark, sf_dir):
    m = F.col("metadata")
    return entries(spark, sf_dir).select("image_id", M.field_value(m, "OCR_purchase").alias("purchase"), M.has(m, "OCR_purchase").alias("has_purchase"), F.size(M.remove(m, "host")).alias("n_after"), M.removed(m, "host").alias("removed"))


@query("""
with s as (select o_orderkey image_id, o_orderpriority k, case o_orderstatus when 'F' then 'Done' when 'O' then 'Pending' else 'No label' end status from orders)
select image_id, case when status <> 'Done' then status when regexp_matches(k, '^[a-zA-Z_][a-zA-Z0-9_-]*$') then 'Applied' else 'Failed' end status, case when status = 'Done' and regexp_matches(k, '^[a-zA-Z_][a-zA-Z0-9_-]*$') then 1 else 0 end applied from s
""")
def batch_apply(spark, sf_dir):
    status = F.when(F.col("o_orderstatus") == "F", "Done").when(F.col("o_orderstatus") == "O", "Pending").otherwise("No label")
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("image_id"), status.alias("status"), F.create_map().cast("map<string,string>").alias("metadata"), F.create_map(F.col("o_orderpriority"), F.lit("x")).alias("fields"))
    return M.apply_batch(rows).select("image_id", "status", "applied")


@query("""
with s as (select case o_orderstatus when 'F' then 'Done' when 'O' then 'Applied' else 'Failed' end status from orders)
select count(*) total, count(*) filter (status in ('Done', 'Applied')) successful, count(*) filter (status = 'Applied') applied, count(*) filter (status = 'Failed') failed from s
""")
def batch_status_summary(spark, sf_dir):
    status = F.when(F.col("o_orderstatus") == "F", "Done").when(F.col("o_orderstatus") == "O", "Applied").otherwise("Failed")
    return R.batch_summary(table(spark, sf_dir, "orders").select(status.alias("status")))


@query(f"""
with {BLOCKS}, t as (select image_id, count(*) filter (type = 'LINE') t, count(*) filter (type = 'WORD') b from blocks group by image_id)
select image_id, t n_text, b n_barcode, case when t + b = 0 then '(no matching fields)' when t > 0 and b > 0 then (t + b) || ' fields (' || t || ' text, ' || b || ' barcode)' else (t + b) || ' fields' end preview from t
""")
def batch_preview(spark, sf_dir):
    regions = blocks(spark, sf_dir).select("image_id", F.col("block_idx").alias("field_index"), F.concat(F.lit("f"), "block_idx").alias("metadata_key"), "text", F.when(F.col("type") == "LINE", "TEXT").otherwise("BARCODE").alias("source_type"))
    return R.batch_results(regions).select("image_id", "n_text", "n_barcode", "preview")


@query(f"""
with {BLOCKS} select image_id, string_agg(text || '|' || type || '|TEXT|' || case when block_idx % 2 = 0 then '' else concat_ws(',', x, y, w, h) end || ';', '' order by block_idx) state from blocks group by image_id
""")
def field_state(spark, sf_dir):
    box = F.when(F.col("block_idx") % 2 == 1, F.col("box"))
    rows = blocks(spark, sf_dir).select("image_id", F.col("block_idx").alias("field_index"), "text", F.col("type").alias("metadata_key"), F.lit("TEXT").alias("region_type"), box.alias("box"))
    return R.field_state(rows).select("image_id", "state")


@query(f"""
with {BLOCKS} select image_id, block_idx field_index, (row_number() over (partition by image_id order by block_idx)) || case when type = 'LINE' then '[TXT]' else '[BAR]' end label from blocks where block_idx % 3 <> 0
""")
def overlay_labels(spark, sf_dir):
    rows = blocks(spark, sf_dir).select("image_id", F.col("block_idx").alias("field_index"), F.when(F.col("type") == "LINE", "TEXT").otherwise("BARCODE").alias("region_type"), F.when(F.col("block_idx") % 3 != 0, F.col("box")).alias("box"))
    return R.overlay_labels(rows).select("image_id", "field_index", "label")


# ---------------------------------------------------------------- sources: S2-S7; configuration by name: P11, P12


def url_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = F.filter(F.split("url", "/"), lambda p: p != "")
    assoc = F.transform(parts, lambda p, i: F.struct(i.alias("ord"), p.alias("name")))
    return table(spark, sf_dir, "pages").select(F.col("page_id").alias("image_id"), assoc.alias("assoc"))


@query("""
with p as (select page_id image_id, list_filter(string_split(url, '/'), lambda x: x <> '') parts from pages),
h as (select *, list_filter(parts, lambda x: contains(lower(x), 'th') or contains(lower(x), '.org')) hits, list_filter(parts, lambda x: lower(x) = 'en') src from p)
select image_id, len(hits) > 0 has_label, hits[1] by_keyword, coalesce(src[1], hits[1]) label_name from h
""")
def label_lookup(spark, sf_dir):
    words = " TH , ,.org"
    rows = S.label_source(url_entries(spark, sf_dir), words, "EN")
    return rows.select("image_id", S.has_label(F.col("assoc"), words).alias("has_label"), S.label_name(F.col("assoc"), words).alias("by_keyword"), "label_name")


@query("""
select c_custkey, contains(c_mktsegment, 'AUTO') or starts_with(c_mktsegment, 'VendorX_') invert, contains(n, '_90_') or contains(n, 'ROTATED') detect_orientation, case when contains(n, 'OLD') or contains(n, '_faded') then 0.3::double else 0.5::double end min_confidence,
    case when contains(n, '_simple_') then 'SINGLE_LINE' when contains(n, '_block_') then 'SINGLE_BLOCK' else 'SPARSE_TEXT' end page_seg_mode
from (select *, replace(replace(c_mktsegment, 'HOUSEHOLD', '_simple_OLD'), 'MACHINERY', '_block_90_') n from customer)
""")
def conditional_config(spark, sf_dir):
    name = F.regexp_replace(F.regexp_replace(F.regexp_replace("c_mktsegment", "HOUSEHOLD", "_simple_OLD"), "MACHINERY", "_block_90_"), "AUTO", "DARK")
    c = R.conditional_config(name)
    return table(spark, sf_dir, "customer").select("c_custkey", *(c[k].alias(k) for k in ("invert", "detect_orientation", "min_confidence", "page_seg_mode")))


@query("select event_id, case when regexp_matches(props, '\"k\": *[0-4]') then 'low' when regexp_matches(props, '\\d+') then 'number' end route from events")
def route_text(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", R.route_text(F.col("props"), {"low": '"k": *[0-4]', "number": r"\d+"}).alias("route"))


# ---------------------------------------------------------------- pixels as a table: A12, I11


@query("""
with v as (select vec_id, greatest(0, least(255, cast(floor((cast(e as double) + 1) * 127.5) as int))) bin from (select vec_id, unnest(embedding) e from embeddings)),
c as (select vec_id, bin, count(*) n from v group by vec_id, bin),
s as (select vec_id, bin, sum(n) over (partition by vec_id order by bin) s, sum(n) over (partition by vec_id) total from c)
select vec_id, min(case when s >= floor(total * 0.02) then bin end) low_bin, min(case when s >= floor(total * 0.98) then bin end) high_bin, cast(max(total) as bigint) total from s group by vec_id
""")
def pixel_histogram_percentile(spark, sf_dir):
    values = table(spark, sf_dir, "embeddings").select("vec_id", F.explode("embedding").alias("e"))
    bins = values.select("vec_id", F.greatest(F.lit(0), F.least(F.lit(255), F.floor((F.col("e").cast("double") + 1) * 127.5).cast("int"))).alias("bin"))
    return I.bin_percentiles(bins, ["vec_id"])


# ---------------------------------------------------------------- strings: F8, F11, F13, F14, F16, R9, R10

TRIM_SQL = r"regexp_replace({}, '^[\x00-\x20]+|[\x00-\x20]+$', '', 'g')"


@query(f"select doc_id, {TRIM_SQL.format('text')} trimmed, coalesce({TRIM_SQL.format('text')} = '', true) blank from documents")
def control_trimmed(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.control_trim(F.col("text")).alias("trimmed"), T.is_blank(F.col("text")).alias("blank"))


@query(r"select p_partkey, regexp_replace(regexp_replace(p_name || ' 1-2', '[^0-9]', '', 'g'), '\s+', '_', 'g') digits, regexp_replace(regexp_replace(p_name || ' é', '[^a-zA-Z0-9\s.,;:!?''\"()-]', '', 'g'), '\s+', '_', 'g') plain from part")
def filter_active(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", T.active_filters(F.concat("p_name", F.lit(" 1-2")), {T.NO_WHITESPACE, T.NUMBERS_ONLY}).alias("digits"), T.active_filters(F.concat("p_name", F.lit(" é")), {T.NO_WHITESPACE, T.STANDARD_CHARS}).alias("plain"))


@query("select p_partkey, case when p_size % 4 = 0 then '''' || p_brand || ''' (exact match)' else '''' || p_name || ''' -> ''' || p_brand || ''' (distance=' || cast(p_size % 4 as varchar) || '.00, ' || cast(p_size as varchar) || '% similar)' end display from part")
def match_displays(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", T.match_display(F.col("p_name"), F.col("p_brand"), (F.col("p_size") % 4).cast("double"), F.col("p_size") / 100.0).alias("display"))


@query("select o_orderkey, case o_orderstatus when 'F' then 'Text' when 'O' then '[' || o_orderpriority || ']' else 'Try Both' end display from orders")
def type_displays(spark, sf_dir):
    kind = F.when(F.col("o_orderstatus") == "F", "TEXT").when(F.col("o_orderstatus") == "O", "BARCODE").otherwise("AUTO")
    return table(spark, sf_dir, "orders").select("o_orderkey", T.type_display(kind, F.col("o_orderpriority")).alias("display"))


@query("select n_nationkey, n_name || '.traineddata' file from nation")
def model_files(spark, sf_dir):
    return table(spark, sf_dir, "nation").select("n_nationkey", T.traineddata_name(F.col("n_name")).alias("file"))


FILTERED = [(f, PLAIN[f"filter_{f.name.lower().replace(' ', '_')}"]) for f in T.ALL_FILTERS]


@query(" union all ".join(f"select '{f.name}' as name, '{f.label}' as label, {f.keeps} as keeps, count(*) filter (regexp_replace(p_name || ' ' || p_brand, '{pattern}', '{new}', 'g') <> p_name || ' ' || p_brand) as changed, sum(length(regexp_replace(p_name || ' ' || p_brand, '{pattern}', '{new}', 'g')))::bigint as letters from part" for f, (_, pattern, new) in FILTERED))
def filter_kinds(spark, sf_dir):
    """What each filter, by name and kind, does to the names of parts."""
    text = F.concat_ws(" ", "p_name", "p_brand")
    rows = table(spark, sf_dir, "part").select(text.alias("text"))
    each = F.array(*(F.struct(F.lit(f.name).alias("name"), F.lit(f.label).alias("label"), F.lit(f.keeps).alias("keeps"), f(F.col("text")).alias("new")) for f in T.ALL_FILTERS))
    applied = rows.select("text", F.explode(each).alias("x")).select("text", "x.*")
    return applied.groupBy("name", "label", "keeps").agg(F.count_if(F.col("new") != F.col("text")).alias("changed"), F.sum(F.char_length("new")).alias("letters"))


@query(f"with {BLOCKS} select image_id, block_idx, row_number() over (partition by image_id order by block_idx) row_no, cast(cast(round(confidence * 10) as int) * 10 as varchar) || '%' shown from blocks")
def numbered_rows(spark, sf_dir):
    rows = R.numbered(blocks(spark, sf_dir).withColumn("field_index", F.col("block_idx")))
    return rows.select("image_id", "block_idx", F.col("row_no").cast("long").alias("row_no"), T.percent_text(F.round(F.col("confidence").cast("double"), 1)).alias("shown"))


# ---------------------------------------------------------------- single writes and edits: K1, K7, K10, K12, K13, R4, R6, R7

@query("select o_orderkey, case when k ~ '^[a-zA-Z_][a-zA-Z0-9_-]*$' and length(k) <= 128 and k <> 'name' then o_orderstatus end one, case when k <> '' then coalesce(v, '') end unchecked, 'kept' host from (select o_orderkey, o_orderstatus, case o_orderkey % 4 when 0 then 'OCR_case' when 1 then o_orderpriority when 2 then '' else 'name' end k, case when o_orderkey % 8 < 4 then o_orderstatus end v from orders)")
def metadata_set_one(spark, sf_dir):
    n = F.col("o_orderkey") % 4
    rows = table(spark, sf_dir, "orders").withColumn("k", F.when(n == 0, "OCR_case").when(n == 1, F.col("o_orderpriority")).when(n == 2, "").otherwise("name"))
    rows = rows.withColumn("metadata", F.create_map(F.lit("host"), F.lit("kept"))).withColumn("v", F.when(F.col("o_orderkey") % 8 < 4, F.col("o_orderstatus")))
    one, free = M.set_one(F.col("metadata"), F.col("k"), F.col("o_orderstatus")), M.set_unchecked(F.col("metadata"), F.col("k"), F.col("v"))
    return rows.select("o_orderkey", M.get(one, F.col("k")).alias("one"), M.get(free, F.col("k")).alias("unchecked"), M.get(free, "host").alias("host"))


FIELDS_SQL = f"""{BLOCKS}, fields as (
    select image_id, cast(block_idx as int) field_index, case block_idx % 4 when 0 then '' when 1 then 'OCR_' || type when 2 then '9 bad' else 'OCR_last' end metadata_key, case when block_idx % 5 = 0 then ' ' else text end as text, case when type = 'LINE' then 'TEXT' else 'BARCODE' end region_type, x, y, w, h from blocks
)"""


def own_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("block_idx")
    key = F.when(n % 4 == 0, "").when(n % 4 == 1, F.concat(F.lit("OCR_"), "type")).when(n % 4 == 2, "9 bad").otherwise("OCR_last")
    return blocks(spark, sf_dir).select("image_id", n.cast("int").alias("field_index"), key.alias("metadata_key"), F.when(n % 5 == 0, " ").otherwise(F.col("text")).alias("text"), F.when(F.col("type") == "LINE", "TEXT").otherwise("BARCODE").alias("region_type"), "box")


@query(f"with {FIELDS_SQL}, kept as (select * from fields where trim(metadata_key) <> '' and trim(text) <> '' and metadata_key <> '9 bad'), last as (select image_id, metadata_key, arg_max(text, field_index) v from kept group by all) select image_id, metadata_key, v from last")
def metadata_apply_fields(spark, sf_dir):
    images = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("image_id")).distinct().withColumn("metadata", F.create_map().cast("map<string,string>"))
    return M.apply_fields(images, own_fields(spark, sf_dir)).select("image_id", F.explode("metadata").alias("metadata_key", "v"))


@query(f"with {FIELDS_SQL} select image_id, string_agg(metadata_key || ': ' || text, chr(10) order by field_index) preview from fields where trim(metadata_key) <> '' and trim(text) <> '' group by image_id")
def metadata_previews(spark, sf_dir):
    return R.metadata_preview(own_fields(spark, sf_dir))


@query(f"with {FIELDS_SQL} select field_index, metadata_key, text example_text, true enabled, false has_bounding_box from fields where trim(metadata_key) <> ''")
def template_from_fields(spark, sf_dir):
    return P.fields_to_rows(own_fields(spark, sf_dir)).select("field_index", "metadata_key", "example_text", "enabled", "has_bounding_box")


@query(f"with {FIELDS_SQL} select field_index, metadata_key, x / 500.0::double nx, y / 400.0::double ny, w / 500.0::double nw, h / 400.0::double nh, true has_bounding_box, region_type from fields")
def template_from_grid(spark, sf_dir):
    return P.grid_to_rows(own_fields(spark, sf_dir), F.lit(500), F.lit(400)).select("field_index", "metadata_key", "nx", "ny", "nw", "nh", "has_bounding_box", "region_type")


@query(f"with {FIELDS_SQL} select image_id, field_index, metadata_key, text from fields union all select image_id, cast(count(*) as int), 'field_' || cast(count(*) as varchar), '' from fields group by image_id")
def field_insert(spark, sf_dir):
    rows = own_fields(spark, sf_dir)
    return R.add_field(rows, rows.select("image_id").distinct()).select("image_id", "field_index", "metadata_key", "text")


@query(f"with {FIELDS_SQL} select image_id, field_index, case when field_index % 3 = 1 and field_index % 2 = 0 then 'OCR_new' else metadata_key end metadata_key, case when field_index % 3 = 1 then 'new text' else text end as text from fields where field_index % 7 <> 2")
def field_edits(spark, sf_dir):
    rows = own_fields(spark, sf_dir)
    edits = rows.where("field_index % 3 = 1").select("image_id", "field_index", F.lit("new text").alias("new_text"), F.when(F.col("field_index") % 2 == 0, "OCR_new").otherwise("not valid").alias("new_key"))
    return R.edit_fields(R.remove_fields(rows, rows.where("field_index % 7 = 2")), edits).select("image_id", "field_index", "metadata_key", "text")


# ---------------------------------------------------------------- bags and sources: O6, P13, A11, G14


@query(f"with {BLOCKS} select image_id, block_idx, case when type = 'WORD' then 0 else 1 end source_rank from blocks")
def appended_blocks(spark, sf_dir):
    rows = blocks(spark, sf_dir)
    return B.append_after(B.of_type(rows, "WORD"), B.of_type(rows, "LINE")).select("image_id", "block_idx", "source_rank")


@query("select page_id, min(page_id) over (partition by string_split(url, '?')[1]) entry from pages")
def same_entries(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").select("page_id", F.array(F.get(F.split("url", r"\?"), F.lit(0)), F.lit("second")).alias("uris"))
    return R.entry_classes(rows, "page_id")


@query("with p as (select list_filter(string_split(url, '/'), lambda x: x <> '') parts from pages) select count(*) filter (len(list_filter(parts, lambda x: contains(lower(x), 'th') or contains(lower(x), '.org'))) > 0) with_label, count(*) total from p")
def images_with_labels(spark, sf_dir):
    return S.count_with_labels(url_entries(spark, sf_dir), " TH , ,.org")


@query(f"with {BLOCKS} select image_id, block_idx, x - 5 x, y - 5 y, w + 10 w, h + 10 h from blocks")
def expanded_boxes(spark, sf_dir):
    return flat(blocks(spark, sf_dir).select("image_id", "block_idx", G.expand(F.col("box"), 5).alias("box")))


# ---------------------------------------------------------------- barcodes from pixels: E7-E11, E14, J6, C4

EAN_SQL = "lpad(cast(p_partkey * 7919 as varchar), 12, '0')"
CODES_SQL = f"""
codes as (
    select p_partkey, case p_partkey % 3 when 0 then 'EAN_13' when 1 then 'CODE_39' else 'CODE_128' end format,
        case p_partkey % 3 when 0 then {EAN_SQL} || cast((10 - list_sum([cast({EAN_SQL}[i] as int) * (case when i % 2 = 0 then 3 else 1 end) for i in range(1, 13)]) % 10) % 10 as varchar) when 1 then upper(p_type) else p_name || '/' || p_brand end as text
    from part
)
"""


def coded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image_id, format, text: what stands on a part's label, as a barcode of one of three formats."""
    n = F.col("p_partkey")
    twelve = F.lpad((n * 7919).cast("string"), 12, "0")
    weighed = F.aggregate(F.transform(F.split(twelve, ""), lambda d, i: d.cast("int") * F.when(i % 2 == 1, 3).otherwise(1)), F.lit(0), lambda a, b: a + b)
    ean = F.concat(twelve, ((10 - weighed % 10) % 10).cast("string"))
    form = F.when(n % 3 == 0, "EAN_13").when(n % 3 == 1, "CODE_39").otherwise("CODE_128")
    text = F.when(n % 3 == 0, ean).when(n % 3 == 1, F.upper("p_type")).otherwise(F.concat_ws("/", "p_name", "p_brand"))
    return table(spark, sf_dir, "part").select(n.alias("image_id"), form.alias("format"), text.alias("text"))


@query(f"with {CODES_SQL} select p_partkey image_id, text, format, 'BARCODE' source_type, true success from codes")
def barcode_texts(spark, sf_dir):
    """Draws each part's barcode, some turned or light on dark, and reads it again from the pixels."""
    n = F.col("image_id")
    images = drawn(coded(spark, sf_dir).select("*", (1 + n % 3).cast("int").alias("module"), (n % 5 == 1).alias("turned"), (n % 7 == 2).alias("inverted")))
    return read_labels(images, LinearDecoder, kind="BARCODE").select("image_id", "text", "format", "source_type", "success")


LABEL = P.Template(
    name="part label",
    mappings=(P.FieldMapping(0, "Code", None, True, 0.0, 0.0, 1.0, 1.0, True, "BARCODE"), P.FieldMapping(1, "Either", None, True, 0.0, 0.25, 1.0, 0.5, True, "AUTO"), P.FieldMapping(2, "Corner", None, True, 0.0, 0.0, 0.1, 0.2, True, "BARCODE"), P.FieldMapping(3, "Tiny", None, True, 0.0, 0.0, 0.001, 0.001, True, "BARCODE")),
    dilation=1.0,
)


@query(f"""
with {CODES_SQL}, f(field_index, metadata_key, whole) as (values (0, 'Code', true), (1, 'Either', true), (2, 'Corner', false))
select p_partkey image_id, field_index, metadata_key, case when whole then text else '' end as text, case when whole then format end format from codes, f
""")
def barcode_regions(spark, sf_dir):
    """The same through a template of positions: a whole label, a stripe of it read as what it is, a corner without a code."""
    images = drawn(coded(spark, sf_dir).select("*", F.lit(2).alias("module"), F.lit(False).alias("turned"), F.lit(False).alias("inverted")))
    return read_fields(images, LABEL, LinearDecoder).select("image_id", "field_index", "metadata_key", "text", "format")


# ---------------------------------------------------------------- pixels as a table: I1, I2, I4, I6, I11, A13

SIDE = 8
VECTORS_SQL = """
vectors as (select vec_id image_id, unnest(embedding) e, generate_subscripts(embedding, 1) - 1 i from embeddings),
pixels as (select image_id, cast(i // 8 as int) y, cast(i % 8 as int) x, greatest(0, least(255, cast(floor((cast(e as double) + 1) * 127.5) as int))) as value from vectors),
bins as (select image_id, value bin, count(*) n from pixels group by all),
sums as (select *, sum(n) over (partition by image_id order by bin) below, sum(n) over (partition by image_id) total, sum(bin * n) over (partition by image_id order by bin) s, sum(bin * n) over (partition by image_id) st from bins)
"""


def rasters(spark: SparkSession, sf_dir: str, contrast: float = 127.5) -> DataFrame:
    """PIXELS: a vector's 64 components as an image of 8 by 8."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image_id"), F.posexplode("embedding").alias("i", "e"))
    value = F.greatest(F.lit(0), F.least(F.lit(255), F.floor((F.col("e").cast("double") + 1) * contrast).cast("int")))
    return rows.select("image_id", F.lit(SIDE).alias("width"), F.lit(SIDE).alias("height"), F.floor(F.col("i") / SIDE).cast("int").alias("y"), (F.col("i") % SIDE).cast("int").alias("x"), value.alias("value"))


@query(f"""
with {VECTORS_SQL}, r as (select *, sum(value) over c s, count(*) over c n from pixels window c as (partition by image_id, y order by x range between 2 preceding and 2 following)),
m as (select *, cast(floor(sum(s) over c / (n * count(*) over c)) as int) mean from r window c as (partition by image_id, x order by y range between 2 preceding and 2 following))
select image_id, y, x, value, mean from m
""")
def pixel_window_means(spark, sf_dir):
    return X.box_means(rasters(spark, sf_dir), F.lit(2)).select("image_id", "y", "x", "value", "mean")


@query(f"""
with {VECTORS_SQL}, r as (select *, sum(value) over c s, count(*) over c n from pixels window c as (partition by image_id, y order by x range between 7 preceding and 7 following)),
m as (select *, cast(floor(sum(s) over c / (n * count(*) over c)) as int) mean from r window c as (partition by image_id, x order by y range between 7 preceding and 7 following))
select image_id, y, x, case when value < mean - 10 then 0 else 255 end as value from m
""")
def pixel_adaptive_threshold(spark, sf_dir):
    return X.adaptive_threshold(rasters(spark, sf_dir)).select("image_id", "y", "x", "value")


@query(f"""
with {VECTORS_SQL}, t as (select image_id, y, count(*) filter (value > 130) / 8.0::double >= 0.4 lit from pixels group by all),
v as (select image_id, coalesce(min(y) filter (lit), 0) y0, coalesce(max(y) filter (lit), 7) y1 from t group by all),
l as (select p.image_id, x, y0, y1, count(*) filter (value > 130) / cast(y1 - y0 + 1 as double) >= 0.4 lit from pixels p join v on p.image_id = v.image_id where y between y0 and y1 group by p.image_id, x, y0, y1),
h as (select image_id, y0, y1, coalesce(min(x) filter (lit), 0) x0, coalesce(max(x) filter (lit), 7) x1 from l group by image_id, y0, y1),
b as (select *, 1.0 - ((x1 - x0 + 1) * (y1 - y0 + 1)) / 64.0::double < 0.02 whole, least(x0 + 2, x1) a, least(y0 + 2, y1) b from h)
select image_id, case when not whole then a end x, case when not whole then b end y, case when not whole then greatest(x1 - 2, a) - a + 1 end width, case when not whole then greatest(y1 - 2, b) - b + 1 end height from b
""")
def pixel_label_regions(spark, sf_dir):
    return X.label_regions(rasters(spark, sf_dir), bright=130)


OTSU_SQL = f"""{VECTORS_SQL}, parted as (
    select *, cast(below as real) n1, cast(total - below as real) n2, cast(cast(s as real) / cast(below as real) - (cast(st as real) - cast(s as real)) / cast(total - below as real) as real) gap from sums where below < total
), varied as (select image_id, bin, n1 * n2 * gap * gap v from parted),
best as (select image_id, arg_max(bin, v order by v desc, bin) bin, max(v) v from varied group by all),
limits as (select i.image_id, case when v > 0 then bin else 128 end threshold from (select distinct image_id from pixels) i left join best b on i.image_id = b.image_id)
"""


@query(f"with {OTSU_SQL} select p.image_id, threshold, count(*) filter (value < threshold) dark, count(*) pixels from pixels p join limits l on p.image_id = l.image_id group by all")
def pixel_otsu(spark, sf_dir):
    """Each image's threshold, and the pixels that it turns dark."""
    pixels = rasters(spark, sf_dir)
    dark = X.barcode_contrast(pixels).groupBy("image_id").agg(F.count_if(F.col("value") == 0).alias("dark"), F.count("*").alias("pixels"))
    return X.thresholds(X.histogram(pixels)).join(dark, "image_id").select("image_id", "threshold", "dark", "pixels")


@query(f"""
with {VECTORS_SQL}, found as (select image_id, min(case when floor(total * 0.02) = 0 then 0 when below >= floor(total * 0.02) then bin end) lo, min(case when floor(total * 0.98) = 0 then 0 when below >= floor(total * 0.98) then bin end) hi from sums group by all),
w as (select image_id, case when hi - lo < 10 then greatest(0, lo - 5) else lo end lo, case when hi - lo < 10 then least(255, hi + 5) else hi end hi from found)
select p.image_id, y, x, case when lo = 0 and hi >= 255 then value else least(255, greatest(0, cast(trunc((value - lo) * (255.0::double / (case when hi > lo then hi - lo else 1 end))) as int))) end as value from pixels p join w on p.image_id = w.image_id
""")
def pixel_display(spark, sf_dir):
    return X.for_display(rasters(spark, sf_dir)).select("image_id", "y", "x", "value")


@query(f"""
with {VECTORS_SQL}, narrow as (select image_id, y, x, 100 + value // 8 as value from pixels), nb as (select image_id, value bin, count(*) n from narrow group by all),
ns as (select *, sum(n) over (partition by image_id order by bin) below, sum(n) over (partition by image_id) total from nb),
found as (select image_id, min(case when floor(total * 0.005) = 0 then 0 when below >= floor(total * 0.005) then bin end) lo, min(case when floor(total * 0.995) = 0 then 0 when below >= floor(total * 0.995) then bin end) hi, min(bin) least_bin, max(bin) largest from ns group by all),
w as (select image_id, largest - least_bin spread, case when hi - lo < 10 then least_bin else lo end lo, case when hi - lo < 10 then largest else hi end hi from found)
select p.image_id, y, x, case when spread >= 50 then value else least(255, greatest(0, cast(trunc((value - lo) * (case when hi > lo then 255.0::double / (hi - lo) else 1.0 end)) as int))) end as value from narrow p join w on p.image_id = w.image_id
""")
def pixel_eight_bit(spark, sf_dir):
    narrow = rasters(spark, sf_dir).withColumn("value", (100 + F.floor(F.col("value") / 8)).cast("int"))
    return X.eight_bit(narrow).select("image_id", "y", "x", "value")


# ---------------------------------------------------------------- metadata as a table: K2, K9, K15


@query(f"""
with {ENTRIES_SQL}, one as (select * from entries where not (k in ('OCR_click', 'CaseID') and image_id % 2 = 0) union all select image_id, n.k, n.v from (select distinct image_id from entries where image_id % 2 = 0), (values ('OCR_click', 'new'), ('CaseID', '')) n(k, v)),
two as (select * from one where not (k = 'CaseID' and image_id % 3 = 0) union all select distinct image_id, 'CaseID', 'C-' || image_id from entries where image_id % 3 = 0)
select image_id, k as key, v as value from two union all select -1 - image_id, 'OCR_added', 'yes' from (select distinct image_id from entries where image_id % 5 = 0)
""")
def metadata_table(spark, sf_dir):
    """A table of all entries, three batches merged into it, one of them twice."""
    rows = entries(spark, sf_dir)
    store = MetadataTable.create(spark, shared_folder(spark), rows)
    first = rows.where("image_id % 2 = 0").select("image_id", new_map().alias("metadata"))
    store.merge(first, "first")
    store.merge(rows.where("image_id % 3 = 0").select("image_id", F.create_map(F.lit("CaseID"), F.concat(F.lit("C-"), "image_id")).alias("metadata")), "second")
    store.merge(first, "first")
    store.merge(rows.where("image_id % 5 = 0").select((-1 - F.col("image_id")).alias("image_id"), F.create_map(F.lit("OCR_added"), F.lit("yes")).alias("metadata")), "third")
    return M.long_form(store.read())
