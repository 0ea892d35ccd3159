"""Main text of web pages, by the substrings that the pages of a host share.

A page is read once, tolerantly, into blocks (runs of text between block-level tags). Blocks inside an article or main
element, and in none of its menus, forms, notices, adverts or comments, are its main text. The tokens of all other blocks
make the page's token stream, and the streams of a host's pages are taken together: substrings of at least LONG tokens that occur on distinct pages of the host are the intervals of its suffix
array whose longest common prefix is LONG or more. What they cover is what windows of LONG tokens that occur on
distinct pages cover, so suffixes are grouped on their first LONG tokens, which needs no host in one place: counts merge
before the shuffle. A block that such substrings cover is boilerplate and goes; this decides

- on a page that marks no article, for all blocks, of which those whose element or whole class name says what they are
  (menu, advert, footer ...) go too;
- inside an article, for blocks in an element whose class only begins or ends like one of a frame (share-price,
  related-work): they stay unless covered;
- on a page that marks an article, for plain text outside it: where what isn't covered is longer than the marked text, the
  marks are a teaser's, and both are kept. Otherwise the marks decide, and plain text outside them goes.

Copies of an article are articles: pages whose most telling blocks (many tokens, on few pages of the host) are equal
count as one page, and a repeat inside a marked article is never dropped. An article is never dropped for its own class
names, nor for those of the page's layout or for a form around it. Null html is an empty page, with empty text; a null
url is a host of its own. Repeated rows are one page, and each gives its row. An empty table gives an empty result;
columns other than page_id, url and html are not read.
"""

from __future__ import annotations

import json
import re
import zlib
from collections import Counter
from collections.abc import Callable
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelloom.llm.common import checkpoint, map_batches, table

LONG = 4
COVERED = 0.8

BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody tfoot thead title tr ul".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SPACE_TAGS = frozenset("br td th wbr img".split())
RAW_TAGS = frozenset("script style noscript template textarea iframe svg annotation annotation-xml object canvas title".split())
MAIN_TAGS = frozenset(("article", "main"))
FRAME_TAGS = frozenset("head nav header footer aside form button select label fieldset dialog menu option audio video".split())
FRAME_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
FRAME_NAMES = frozenset(
    "ad ads adbox advert adverts advertisement advertising alert alerts banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notices pager pagination paywall popup promo promoted reply replies respond related search share sharing sidebar signup skip social sponsor sponsored subscribe toolbar widget widgets".split()
)
#: Parts that say nothing of their own beside a frame's name: share-buttons, related-posts.
NEUTRAL_NAMES = frozenset("area bar block box button buttons container content form icons inner item items link links list main page post posts section site the top bottom left right text title wrap wrapper".split())
#: Names of frames that an article may have for its own title.
OWN_NAMES = frozenset(("header", "banner", "masthead"))
NOT_NAMES = frozenset("has no with without is".split())
#: Names of frames whose articles aren't the page's: comments, teasers, adverts.
OTHERS_NAMES = frozenset("ad ads adbox advert adverts advertisement advertising comment comments disqus promo promoted reply replies respond related sponsor sponsored widget widgets".split())
#: Whole class names of articles that are a reader's.
OTHERS_ARTICLES = frozenset(("comment", "reply"))

#: Open elements that the start of another ends, though nothing closes them; a block of another kind keeps them open.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "option": ("option",)}
ENDED = frozenset(("p", "li", "dt", "dd", "tr", "option"))

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")


def names_in(value: str) -> tuple[set[str], bool]:
    """Frames that a class or id names as a whole: all its parts are names of frames, or neutral beside one at its start or
    end. And whether one only begins or ends with such a name."""
    whole: set[str] = set()
    partly = False
    for name in value.lower().split():
        parts = [x for x in re.split(r"[^a-z]+", name) if x]
        if not parts or parts[0] in NOT_NAMES:
            continue
        said = FRAME_NAMES.intersection((parts[0], parts[-1]))
        if said and all(x in FRAME_NAMES or x in NEUTRAL_NAMES for x in parts):
            whole |= said
        elif said:
            partly = True
    return whole, partly


#: Places inside an article.
MARKED = ("main", "doubt")


class Block:
    __slots__ = ("place", "text")

    def __init__(self, place: str, text: str):
        self.place, self.text = place, text


def blocks_of(html: str) -> list[Block]:
    """Blocks in page order; place: main, doubt (in main, under a class that begins or ends like a frame's), frame (an
    element or class says so), layout (a frame that an article inside isn't part of: a form, or a class name of the page's
    layout) or open. Linear in the page: tags are looked for among open elements only where one is open."""
    out: list[Block] = []
    pieces: list[str] = []
    stack: list[tuple[str, str, bool]] = []  # tag, place, inside a main element
    levels: list[int] = []  # places in the stack of block elements
    held: Counter[str] = Counter()  # open elements by tag
    place, inside = "open", False

    def close() -> None:
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                out.append(Block("frame" if place == "layout" else place, text))
            pieces.clear()

    def leave(i: int) -> tuple[str, bool]:
        """Ends the open elements from the i-th on; gives place and inside as before it."""
        before = stack[i][1:]
        held.subtract(x[0] for x in stack[i:])
        del stack[i:]
        while levels and levels[-1] >= i:
            levels.pop()
        return before

    def put(text: str) -> None:
        if text:
            pieces.append(unescape(text) if "&" in text else text)

    at, end = 0, len(html)
    while at < end:
        found = TOKEN.search(html, at)
        if not found:
            put(html[at:])
            break
        put(html[at : found.start()])
        at = found.end()
        tag = (found[2] or "").lower()
        if not tag:
            continue
        if tag in SPACE_TAGS:
            pieces.append(" ")
        if tag in BLOCK_TAGS:
            close()
        if found[1]:
            if held[tag]:
                i = next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag)
                if stack[i][1:] != (place, inside):
                    close()
                place, inside = leave(i)
            continue
        said = found[3]
        if tag in RAW_TAGS:
            if not said.endswith("/") or tag in ("script", "style", "title", "textarea"):
                ended = re.compile(rf"</{tag}[\s/>]", re.I).search(html, at)
                at = html.find(">", ended.start()) + 1 or end if ended else end
            continue
        if tag in VOID_TAGS or said.endswith("/") and tag not in BLOCK_TAGS:
            continue
        if tag in BLOCK_TAGS:
            ends = ENDS.get(tag, ("p",))
            for i in reversed(levels):
                if stack[i][0] in ends:
                    place, inside = leave(i)
                    break
                if stack[i][0] not in ENDED:
                    break
            levels.append(len(stack))
        stack.append((tag, place, inside))
        held[tag] += 1
        new_place, new_inside = place, inside
        given = {k.lower(): a or b or c for k, a, b, c in (ATTRIBUTE.findall(said) if said else ())}
        said_names, partly = names_in(f"{given.get('class', '')} {given.get('id', '')}") if given and tag not in ("body", "html") else (set(), False)
        role = given.get("role", "").lower()
        if tag in MAIN_TAGS or role == "main" or given.get("itemprop") == "articleBody":
            new_inside = True
            if inside and said_names & OTHERS_NAMES:
                new_place = "frame"
            elif place in ("open", "layout") and not (tag == "article" and OTHERS_ARTICLES & {*given.get("class", "").lower().split()}):
                new_place = "main"
            elif place not in ("main", "doubt"):
                new_place = "frame"
        elif tag in FRAME_TAGS and tag != "form" and not (inside and tag == "header") or role in FRAME_ROLES and role != "form":
            new_place = "frame"
        elif said_names & OTHERS_NAMES:
            new_place = "frame"
        elif tag == "form" or role == "form" or said_names & FRAME_NAMES - (OWN_NAMES if inside else frozenset()):
            new_place = "layout" if place in ("open", "layout") else "frame"
        elif partly and place == "main":
            new_place = "doubt"
        if "hidden" in given or given.get("aria-hidden") == "true":
            new_place = "frame"
        if (new_place, new_inside) != (place, inside):
            close()
        place, inside = new_place, new_inside
    close()
    return out


def tokens(text: str) -> list[str]:
    return text.split()


def stream_of(blocks: list[Block]) -> list[str]:
    """The tokens of all blocks that aren't main text."""
    return [t for b in blocks if b.place != "main" for t in tokens(b.text)]


def is_marked(blocks: list[Block]) -> bool:
    return any(b.place in MARKED for b in blocks)


def is_led(blocks: list[Block]) -> bool:
    """Is the marked text of the page at least as long as its plain text outside?"""
    size = lambda *places: sum(len(tokens(b.text)) for b in blocks if b.place in places)
    return is_marked(blocks) and size(*MARKED) >= size("open")


def candidates(blocks: list[Block]) -> list[tuple[str, int, str | None]]:
    """What is left to decide of each block: place, tokens, and its text, if it may be kept at all."""
    led = is_led(blocks)
    return [(b.place, len(tokens(b.text)), b.text if b.place in MARKED or not led and b.place == "open" else None) for b in blocks]


def kept_text(rows: list[tuple[str, int, str | None]], repeated: list[int], long: int = LONG) -> str:
    """repeated: places in the page's stream where a substring of `long` tokens begins that another page has."""
    covered: set[int] = {p + k for p in repeated for k in range(long)}
    kept, at = [], 0
    for place, n, text in rows:
        shared = 0
        if place != "main":
            shared = sum(i in covered for i in range(at, at + n)) if covered else 0
            at += n
        if text is not None and (place == "main" or shared < COVERED * n):
            kept.append((place, n, text))
    inside = sum(n for place, n, _ in kept if place in MARKED)
    outside = sum(n for place, n, _ in kept if place == "open")
    return "\n\n".join(text for place, _, text in kept if place in MARKED or outside > inside)


def main_text(blocks: list[Block], repeated: list[int], long: int = LONG) -> str:
    return kept_text(candidates(blocks), repeated, long)


def keyed(pages: DataFrame) -> DataFrame:
    """page, host, page_id, url, html; page: a hash of the whole row, so that rows with one page_id stay apart."""
    few = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    host = F.regexp_extract(F.lower(F.coalesce("url", F.lit(""))), r"^(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?(?:www\.|m\.)?([^/?#:]*)", 1)
    return few.select(F.xxhash64("page_id", "url", "html").alias("page"), host.alias("host"), "page_id", "url", "html")


PARSED = "page long, host string, page_id long, url string, led boolean, settled boolean, article long, rows binary, blocks array<struct<block:long,n:int>>, heads array<long>"


def parsed_pages(pages: DataFrame, long: int = LONG) -> DataFrame:
    """A row for each page: led (by an article, of the hash `article`), settled (no other page decides anything), rows (what
    may be kept, compressed: Spark's own codec finds little to save in prose), blocks (of what may be kept of pages that
    aren't led) and heads (of the host's name and the first `long` tokens of each suffix of the page's stream)."""
    kinds = pa.list_(pa.struct([("block", pa.int64()), ("n", pa.int32())]))

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        signed = lambda x: (h := xxh64_intdigest(x.encode("utf-8", "surrogatepass"))) - (h >> 63 << 64)

        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            out: list[list] = [[], [], [], [], [], []]
            for host, html in zip(batch.column(1).to_pylist(), batch.column(4).to_pylist()):
                blocks = blocks_of(html)
                led, rows, stream = is_led(blocks), candidates(blocks), stream_of(blocks)
                out[0].append(led)
                out[1].append(led and all(place == "main" or text is None for place, _, text in rows))
                out[2].append(signed("\n".join(b.text for b in blocks if b.place in MARKED)))
                out[3].append(zlib.compress(json.dumps(rows, ensure_ascii=False).encode("utf-8", "surrogatepass"), 4))
                out[4].append([] if led else [{"block": signed(text), "n": n} for _, n, text in rows if text is not None])
                out[5].append([signed("\n".join([host, *stream[i : i + long]])) for i in range(len(stream) - long + 1)])
            columns = [pa.array(x, kind) for x, kind in zip(out, (pa.bool_(), pa.bool_(), pa.int64(), pa.binary(), kinds, pa.list_(pa.int64())))]
            return pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(4)), *columns], names=["page", "host", "page_id", "url", "led", "settled", "article", "rows", "blocks", "heads"])

        return one

    return map_batches(keyed(pages), make, PARSED)


def repeated_places(parsed: DataFrame) -> DataFrame:
    """page, repeated: for pages that aren't settled, the sorted places of their streams where a substring begins that a
    distinct page of the host has. Pages with one article, or one most telling block, aren't distinct."""
    streams = parsed.join(parsed.where("not settled").select("host").distinct(), "host", "left_semi")
    open_pages = parsed.where("not led")
    blocks = open_pages.select("page", "host", F.explode("blocks").alias("x")).select("page", "host", "x.block", "x.n").distinct()
    of_host = open_pages.select("host", "page").distinct().groupBy("host").agg(F.count("*").alias("of"))
    on_pages = checkpoint(blocks.groupBy("host", "block").agg(F.count("*").alias("pages")).join(of_host, "host"))
    weight = F.round(F.col("n") * F.log(F.col("of") / F.col("pages")), 6).alias("weight")
    telling = blocks.join(on_pages, ["host", "block"]).groupBy("page").agg(F.max(F.struct(weight, "block")).alias("x")).select("page", F.col("x.block").alias("telling"))
    found = streams.join(telling, "page", "left").select("page", "settled", F.coalesce("telling", "article").alias("kind"), F.posexplode("heads").alias("at", "head"))
    # Written out, so that the join shuffles it plainly and a frequent head's rows can be split over tasks.
    shared = checkpoint(found.groupBy("head").agg(F.min("kind").alias("a"), F.max("kind").alias("b")).where("a <> b").select("head"))
    return found.where("not settled").select("page", "at", "head").join(shared, "head").groupBy("page").agg(F.array_sort(F.collect_set("at")).alias("repeated"))


def extract_text(pages: DataFrame, long: int = LONG) -> DataFrame:
    """page_id, url, text, n_chars. Pages are parsed once; those that are settled need no other page."""

    def keep() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = [json.loads(zlib.decompress(x).decode("utf-8", "surrogatepass")) for x in batch.column(2).to_pylist()]
            texts = [kept_text(x, at or [], long) for x, at in zip(rows, batch.column(3).to_pylist())]
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

        return one

    parsed = checkpoint(parsed_pages(pages, long))
    settled = parsed.where("settled").select("page_id", "url", "rows", F.lit(None).cast("array<int>").alias("repeated"))
    others = parsed.where("not settled").join(repeated_places(parsed), "page", "left").select("page_id", "url", "rows", "repeated")
    return map_batches(settled.unionByName(others), keep, "page_id long, url string, text string, n_chars long")


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))
