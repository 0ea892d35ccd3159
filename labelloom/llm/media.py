"""Media columns: what bytes are, by their magic bytes and their structure.

One Aho-Corasick automaton finds the magic bytes of all formats at once. A format's validator then walks the structure
from each hit and returns the object's length, or None where structure or lengths are broken. A valid object at the
start of a value gives its type (correcting the declared one); valid objects further in are carved.

Null bytes are empty bytes: type "empty", nothing carved. Bytes without a valid object at their start keep the type
"text" if they are UTF-8, else "unknown". An empty table gives an empty result; columns other than those named are
not read. Values are handled one by one, so repeated rows give equal results.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelloom.llm.common import map_batches, table, text_or_empty, utf8

#: Magic bytes of the formats.
MAGIC = {
    b"RIFF": "wav",
    b"\x89PNG\r\n\x1a\n": "png",
    b"GIF87a": "gif",
    b"GIF89a": "gif",
    b"BM": "bmp",
    b"\xff\xd8\xff": "jpeg",
    b"%PDF-": "pdf",
    b"PK\x03\x04": "zip",
    b"\x1f\x8b\x08": "gzip",
}

UNIT = 192
RATE = 8000


# ---------------------------------------------------------------- validators: (bytes, offset) -> length or None


def wav_length(data: bytes, at: int) -> int | None:
    if data[at + 8 : at + 12] != b"WAVE" or len(data) < at + 12:
        return None
    end = at + 8 + struct.unpack_from("<I", data, at + 4)[0]
    if end > len(data):
        return None
    place, seen = at + 12, set()
    while place + 8 <= end:
        name, size = struct.unpack_from("<4sI", data, place)
        if name == b"data" and b"fmt " not in seen or name == b"fmt " and size < 16:
            return None
        seen.add(name)
        place += 8 + size + (size & 1)
    return end - at if {b"fmt ", b"data"} <= seen and place in (end, end + 1) else None


def png_length(data: bytes, at: int) -> int | None:
    place, first = at + 8, True
    while place + 12 <= len(data):
        size, name = struct.unpack_from(">I4s", data, place)
        if first and (name != b"IHDR" or size != 13) or place + 12 + size > len(data):
            return None
        if zlib.crc32(data[place + 4 : place + 8 + size]) != struct.unpack_from(">I", data, place + 8 + size)[0]:
            return None
        first, place = False, place + 12 + size
        if name == b"IEND":
            return place - at
    return None


def gif_length(data: bytes, at: int, dead: set[int] | None = None) -> int | None:
    """dead: places of blocks and images from which earlier walks over the same data found no end."""
    dead = set() if dead is None else dead
    if len(data) < at + 13:
        return None
    flags = data[at + 10]
    place, seen, inside = at + 13 + (3 << (flags & 7) + 1 if flags & 128 else 0), [], False
    while place < len(data) and (key := 2 * place + inside) not in dead:
        seen.append(key)
        kind = data[place]
        if inside:
            inside, place = kind > 0, place + 1 + kind
        elif kind == 0x3B:
            return place + 1 - at
        elif kind == 0x21:
            inside, place = True, place + 2
        elif kind == 0x2C and place + 10 < len(data):
            local = data[place + 9]
            inside, place = True, place + 11 + (3 << (local & 7) + 1 if local & 128 else 0)
        else:
            break
    dead.update(seen)
    return None


def bmp_length(data: bytes, at: int) -> int | None:
    if len(data) < at + 30:
        return None
    size, reserved, pixels, header = struct.unpack_from("<IIII", data, at + 2)
    if reserved or header not in (40, 52, 56, 108, 124) or not 14 + header <= pixels <= size or at + size > len(data):
        return None
    width, height, planes, bits, how = struct.unpack_from("<iiHHI", data, at + 18)
    if planes != 1 or width <= 0 or not height or bits not in (1, 4, 8, 16, 24, 32):
        return None
    return size if how or pixels + (width * bits + 31) // 32 * 4 * abs(height) <= size else None


def jpeg_length(data: bytes, at: int, last_end: int | None = None) -> int | None:
    """last_end: the place of the last end mark in the data, beyond which no image ends."""
    if at > (data.rfind(b"\xff\xd9") if last_end is None else last_end):
        return None
    place = at + 2
    while place + 4 <= len(data) and data[place] == 0xFF:
        kind = data[place + 1]
        size = struct.unpack_from(">H", data, place + 2)[0]
        if size < 2 or kind in (0x00, 0xFF):
            return None
        place += 2 + size
        if kind == 0xDA:
            while (place := data.find(b"\xff", place)) >= 0 and place + 1 < len(data):
                if data[place + 1] == 0xD9:
                    return place + 2 - at
                if data[place + 1] and not 0xD0 <= data[place + 1] <= 0xD7:
                    break
                place += 2
            else:
                return None
    return None


def pdf_length(data: bytes, at: int) -> int | None:
    later = data.find(b"%PDF-", at + 5)
    end = data.rfind(b"%%EOF", at, later if later > 0 else len(data))
    start = data.rfind(b"startxref", at, max(end, at))
    if end < 0 or start < 0 or not data[start + 9 : end].strip().isdigit():
        return None
    return end + 5 - at if int(data[start + 9 : end]) < start - at else None


def zip_ends(data: bytes) -> dict[int, int]:
    """Start of an archive -> its length, by the first end record that fits; one pass over the end records."""
    found: dict[int, int] = {}
    place = -1
    while (place := data.find(b"PK\x05\x06", place + 1)) >= 0 and place + 22 <= len(data):
        size, offset, note = struct.unpack_from("<IIH", data, place + 12)
        start = place - size - offset
        if start >= 0 and data[start + offset : start + offset + 4] == b"PK\x01\x02" and place + 22 + note <= len(data):
            found.setdefault(start, place + 22 + note - start)
    return found


def zip_length(data: bytes, at: int, ends: dict[int, int] | None = None) -> int | None:
    return (zip_ends(data) if ends is None else ends).get(at)


def gzip_length(data: bytes, at: int) -> int | None:
    unpack = zlib.decompressobj(31)
    try:
        place = at
        while place < len(data) and not unpack.eof:  # in parts, so that what it holds stays small
            part = data[place : place + 65536]
            place += len(part)
            while part and not unpack.eof:
                unpack.decompress(part, 1 << 20)
                part = unpack.unconsumed_tail
    except zlib.error:
        return None
    return place - len(unpack.unused_data) - at if unpack.eof else None


VALIDATORS: dict[str, Callable[..., int | None]] = {
    "wav": wav_length, "png": png_length, "gif": gif_length, "bmp": bmp_length, "jpeg": jpeg_length, "pdf": pdf_length, "zip": zip_length, "gzip": gzip_length,
}

#: What the walks from all hits of a format share, found once for a value, so that many hits don't cost its square.
SHARED: dict[str, Callable[[bytes], object]] = {"zip": zip_ends, "gif": lambda data: set(), "jpeg": lambda data: data.rfind(b"\xff\xd9")}


@lru_cache(maxsize=1)
def automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for magic, kind in MAGIC.items():
        found.add_word(magic.decode("latin-1"), (len(magic), kind))
    found.make_automaton()
    return found


def sniff(data: bytes | None) -> tuple[str, int, list[tuple[str, int, int]]]:
    """Type, length of the object at the start (0: none), and the objects carved from the rest: (type, offset, length).
    Objects inside a carved one are not carved again; inside the one at the start they are."""
    if not data:
        return "empty", 0, []
    kind, length, carved, free = "", 0, [], 0
    known: dict[str, tuple] = {}
    for last, (size, what) in automaton().iter(data.decode("latin-1")):
        at = last - size + 1
        if at < free:
            continue
        if what in SHARED and what not in known:
            known[what] = (SHARED[what](data),)
        if (found := VALIDATORS[what](data, at, *known.get(what, ()))) is None:
            continue
        if at == 0:
            kind, length = what, found
        else:
            carved.append((what, at, found))
            free = at + found
    if not kind:
        try:
            data.decode()
            kind = "text"
        except UnicodeDecodeError:
            kind = "unknown"
    return kind, length, carved


# ---------------------------------------------------------------- operators


SNIFFED = pa.struct([("type", pa.string()), ("valid", pa.bool_()), ("corrected", pa.bool_()), ("length", pa.int64()), ("carved", pa.list_(pa.struct([("type", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])))])


def sniff_media(df: DataFrame, key: str, data: str, declared: str | None = None) -> DataFrame:
    """key, and sniffed: type, valid (an object of a known format, whole), corrected (a declared type that differs),
    length, carved (type, offset, length)."""

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = []
            for value, said in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                kind, length, carved = sniff(value)
                rows.append({"type": kind, "valid": length > 0, "corrected": said is not None and said != kind, "length": length, "carved": [dict(zip(("type", "offset", "length"), x)) for x in carved]})
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, SNIFFED)], names=["key", "sniffed"])

        return one

    kind = dict(df.dtypes)[key]
    few = df.select(F.col(key).alias("key"), F.col(data).cast("binary").alias("data"), (F.col(declared).cast("string") if declared else F.lit(None).cast("string")).alias("declared"))
    return map_batches(few, make, f"key {kind}, sniffed struct<type string, valid boolean, corrected boolean, length long, carved array<struct<type string, offset long, length long>>>").withColumnRenamed("key", key)


def carve_media(df: DataFrame, key: str, data: str) -> DataFrame:
    """A row for each carved object: key, type, offset, length, bytes."""
    found = df.select(F.col(key), F.col(data).cast("binary").alias("data"))

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            at, rows = [], []
            for i, value in enumerate(batch.column(1).to_pylist()):
                for kind, offset, length in sniff(value)[2]:
                    at.append(i)
                    rows.append((kind, offset, length, value[offset : offset + length]))
            columns = [list(x) for x in zip(*rows)] or [[], [], [], []]
            return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *(pa.array(x, t) for x, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.binary())))], names=["key", "type", "offset", "length", "bytes"])

        return one

    return map_batches(found, make, f"key {dict(df.dtypes)[key]}, type string, offset long, length long, bytes binary").withColumnRenamed("key", key)


def to_wav(payload: bytes, rate: int = RATE) -> bytes:
    """One channel of unsigned 8-bit samples; the samples are the payload's bytes."""
    pad = len(payload) & 1
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload) + pad, b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(payload)) + payload + b"\0" * pad


def wav_samples(media: bytes) -> bytes:
    """The samples as they are stored."""
    if wav_length(media, 0) is None:
        raise ValueError("not a whole WAV object")
    place = 12
    while media[place : place + 4] != b"data":
        size = struct.unpack_from("<I", media, place + 4)[0]
        place += 8 + size + (size & 1)
    return media[place + 8 : place + 8 + struct.unpack_from("<I", media, place + 4)[0]]


def sound_features(samples: bytes) -> str:
    """Level, energy and turns of the samples about their middle, 128."""
    x = np.frombuffer(samples, np.uint8)
    n, counts = len(x), np.bincount(x, minlength=256)
    values = np.arange(256) - 128
    level, energy = int(counts @ values), int(counts @ (values * values))
    turns = int(np.count_nonzero(np.diff(x >= 128)))
    return f"n={n};mean={level / n:.4f};rms={(energy / n) ** 0.5:.4f};peak={int(np.abs(values[counts > 0]).max())};crossings={turns}"


def media_columns(docs: DataFrame, unit: int = UNIT) -> DataFrame:
    """Stores each text as a WAV value, sniffs the stored bytes, and reads payload and features back from them.
    doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, media_type,
    n_carved, declared, corrected. The declared type is text; the sniffed one corrects it. A null text is the empty
    text."""

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = []
            for text in utf8(batch.column(1)):
                media = to_wav(text + b" " * (max(unit, -(-len(text) // unit) * unit) - len(text)))
                kind, length, carved = sniff(media)
                if (kind, length) != ("wav", len(media)):
                    raise ValueError(f"stored as wav, read back as {kind} of {length} bytes")
                back = wav_samples(media)
                rows.append((len(text), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(media), hashlib.sha256(media).hexdigest(), f"{kind};{sound_features(back)};carved={len(carved)}", kind, len(carved), "text", kind != "text"))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.bool_())
            return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, t) for x, t in zip(zip(*rows), kinds))], names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "media_type", "n_carved", "declared", "corrected"])

        return one

    few = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return map_batches(few, make, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, media_type string, n_carved int, declared string, corrected boolean")


def op1_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_columns(table(spark, sf_dir, "documents"))
