"""Token-ID output: files of patched frame-of-reference blocks.

A file holds the token ids of consecutive documents as one stream, cut into blocks of BLOCK ids. Of each block the
minimum is subtracted; the rest is packed at the width that holds the PERCENTILE-th of its values, and larger values
stand in an exception list (positions and values). An index of block starts and a table of documents (id, length)
close the file, so one block or one document can be read without the rest.

The content of an added token, as '<|endoftext|>', is that token's id, as the library has it; with added=False it is plain
characters. Null texts are empty texts; an empty document is its end id alone; documents with a null doc_id come first; equal
doc_ids follow each other in the order of their texts. An empty table gives no file and no row. Columns other than
doc_id and text are not read.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from labelloom.llm.common import bounded_batches, checkpoint, new_folder, table, text_or_empty

MAGIC = b"PFORTOK1"
BLOCK = 1024
PERCENTILE = 0.95
END_ID = 2
FILE_TOKENS = 4_000_000
CACHE = 500_000
#: Blocks that are packed at once.
AT_ONCE = 512
TOKENIZER = "byte_bpe_50k.json"
#: Marks that stand after words; each is its own letter of the byte-level alphabet, as SPACE is the blank's.
MARKS = "!\"#$%&()*,-./:;<=>?@[]^_`{|}~"
SPACE = "Ġ"
#: ASCII white space that isn't one blank or line feed between words.
ODD = ("  ", "\n\n", " \n", "\n ", "\t", "\r", "\v", "\f", "\x1c", "\x1d", "\x1e", "\x1f")
#: The same for any text: white space of other kinds, or two of it in a row.
ODD_ANYWHERE = re.compile(r"[^\S \n]| {2}|\n{2}| \n|\n ")


# ---------------------------------------------------------------- blocks


def pack(values: np.ndarray, width: int) -> np.ndarray:
    """(n, BLOCK) values below 2**width -> (n, BLOCK * width / 64) words; 64 values share `width` words."""
    n = len(values)
    lanes = np.ascontiguousarray(values.reshape(-1, 64).T).astype(np.uint64)
    words = np.zeros((width, lanes.shape[1]), np.uint64)
    for k in range(64 if width else 0):
        word, bit = divmod(k * width, 64)
        words[word] |= lanes[k] << np.uint64(bit)
        if bit + width > 64:
            words[word + 1] |= lanes[k] >> np.uint64(64 - bit)
    return np.ascontiguousarray(words.T).reshape(n, -1)


def unpack(words: np.ndarray, width: int) -> np.ndarray:
    n = len(words)
    if not width:
        return np.zeros((n, BLOCK), np.uint32)
    rows = np.ascontiguousarray(words.reshape(-1, width).T)
    lanes = np.empty((64, rows.shape[1]), np.uint64)
    mask = np.uint64((1 << width) - 1)
    for k in range(64):
        word, bit = divmod(k * width, 64)
        x = rows[word] >> np.uint64(bit)
        if bit + width > 64:
            x = x | rows[word + 1] << np.uint64(64 - bit)
        lanes[k] = x & mask
    return np.ascontiguousarray(lanes.T).astype(np.uint32).reshape(n, BLOCK)


def encode_blocks(blocks: np.ndarray, percentile: float) -> list[bytes]:
    low = blocks.min(axis=1)
    rest = blocks - low[:, None]
    at = min(BLOCK - 1, max(0, int(np.ceil(percentile * BLOCK)) - 1))
    widths = np.array([int(x).bit_length() for x in np.partition(rest, at, axis=1)[:, at]], np.uint8)
    # Shifting in 64 bits: a width of 32 leaves nothing over.
    late = rest.astype(np.uint64) >> widths[:, None].astype(np.uint64) > 0
    packed: list[bytes] = [b""] * len(blocks)
    for width in np.unique(widths):
        rows = np.nonzero(widths == width)[0]
        for i, words in zip(rows, pack(np.where(late[rows], 0, rest[rows]), int(width))):
            packed[i] = words.tobytes()
    out = []
    for i, n in enumerate(late.sum(axis=1)):
        one = struct.pack("<IBxH", low[i], widths[i], n) + packed[i]
        if n:
            where = np.nonzero(late[i])[0]
            one += where.astype("<u2").tobytes() + rest[i, where].astype("<u4").tobytes()
        out.append(one)
    return out


def encode_file(ids: np.ndarray, doc_ids: list[int | None], lengths: list[int], percentile: float = PERCENTILE) -> bytes:
    n = len(ids)
    parts: list[bytes] = []
    for at in range(0, n, AT_ONCE * BLOCK):
        some = ids[at : at + AT_ONCE * BLOCK]
        blocks = np.full(-(-len(some) // BLOCK) * BLOCK, some[-1], np.uint32)
        blocks[: len(some)] = some
        parts += encode_blocks(blocks.reshape(-1, BLOCK), percentile)
    starts = np.cumsum([0, *map(len, parts)]).astype("<u8")
    header = MAGIC + struct.pack("<IIQQQ", BLOCK, len(parts), n, len(lengths), int(starts[-1]))
    known = np.array([x is not None for x in doc_ids], np.uint8)
    docs = np.array([x or 0 for x in doc_ids], "<i8").tobytes() + np.array(lengths, "<u8").tobytes() + known.tobytes()
    body = b"".join([header, *parts, starts.tobytes(), docs])
    return body + struct.pack("<I", zlib.crc32(body))


def decode_file(data: bytes) -> tuple[np.ndarray, list[int | None], np.ndarray]:
    """ids, doc_ids, lengths."""
    if data[:8] != MAGIC or zlib.crc32(memoryview(data)[:-4]) != struct.unpack("<I", data[-4:])[0]:
        raise ValueError("not a whole token file")
    size, count, n, docs, payload = struct.unpack_from("<IIQQQ", data, 8)
    if size != BLOCK:
        raise ValueError(f"blocks of {size} ids")
    base = 8 + struct.calcsize("<IIQQQ")
    starts = np.frombuffer(data, "<u8", count + 1, base + payload).astype(np.int64) + base
    head = np.frombuffer(data, np.uint8)[starts[:-1, None] + np.arange(8)] if count else np.zeros((0, 8), np.uint8)
    low = np.ascontiguousarray(head[:, :4]).view("<u4")[:, 0]
    widths, exceptions = head[:, 4], np.ascontiguousarray(head[:, 6:8]).view("<u2")[:, 0]
    rest = np.empty((count, BLOCK), np.uint32)
    for width in np.unique(widths):
        all_rows = np.nonzero(widths == width)[0]
        k = int(width) * BLOCK // 64
        for rows in np.array_split(all_rows, -(-len(all_rows) // AT_ONCE)):
            words = np.stack([np.frombuffer(data, "<u8", k, starts[i] + 8) for i in rows]) if k else np.zeros((len(rows), 0), np.uint64)
            rest[rows] = unpack(words, int(width))
    for i in np.nonzero(exceptions)[0]:
        e, at = int(exceptions[i]), int(starts[i]) + 8 + int(widths[i]) * BLOCK // 8
        rest[i, np.frombuffer(data, "<u2", e, at)] = np.frombuffer(data, "<u4", e, at + 2 * e)
    rest += low[:, None]
    ids = rest.reshape(-1)[:n]
    at = base + payload + 8 * (count + 1)
    doc_ids, lengths = np.frombuffer(data, "<i8", docs, at), np.frombuffer(data, "<u8", docs, at + 8 * docs)
    known = np.frombuffer(data, np.uint8, docs, at + 16 * docs)
    return ids, [int(x) if k else None for x, k in zip(doc_ids, known)], lengths.astype(np.int64)


# ---------------------------------------------------------------- encoding


class Pieces(dict):
    """ids (little-endian bytes) of the pieces between spaces; keeps the last two generations of at most CACHE."""

    def __init__(self, path: str, added: bool = True):
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = not added
        self.added = [x.content for x in self.whole.get_added_tokens_decoder().values()] if added else []
        self.split = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True).pre_tokenize_str
        self.model = self.whole.model
        self.tokenize = self.model.tokenize
        self.bytes_of = [i.to_bytes(4, "little") for i in range(self.whole.get_vocab_size(with_added_tokens=True))]
        # The byte-level alphabet: visible Latin-1 characters stand for themselves, other bytes for those from 256 on.
        seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
        other = (x for x in range(256) if x not in set(seen))
        self.letters = {x: chr(x) for x in seen} | {x: chr(256 + i) for i, x in enumerate(other)}
        self.old: dict[str, bytes] = {}
        self.tails: dict[str, bytes] = {}
        self.line = self.ids("Ċ")

    def ids(self, pretoken: str) -> bytes:
        of = self.bytes_of
        return b"".join([of[x.id] for x in self.tokenize(pretoken)])

    def word(self, text: str, lead: str) -> bytes:
        """ids of a run of no white space. Letters, and what marks follow them, are two pre-tokens: the letters go
        straight to the model. Runs of other kinds go through the library's own split."""
        letters = text.rstrip(MARKS)
        if not letters.isalpha():
            return b"".join([self.ids(part) for part, _ in self.split(" " * len(lead) + text)])
        tail = text[len(letters) :]
        if tail and lead:
            return self[letters] + self.marks(tail)
        if not letters.isascii():
            letters = letters.encode().decode("latin-1").translate(self.letters)
        ids = self.ids(lead + letters)
        return ids + self.marks(tail) if tail else ids

    def marks(self, tail: str) -> bytes:
        out = self.tails.get(tail)
        if out is None:
            out = self.tails[tail] = self.ids(tail)
            if len(self.tails) > 10_000:
                self.tails.clear()
        return out

    def __missing__(self, piece: str) -> bytes:
        out = self.old.get(piece)
        if out is None:
            if piece.isascii() and piece.isalpha():  # most are: straight to the model
                of = self.bytes_of
                out = b"".join([of[x.id] for x in self.tokenize(SPACE + piece)])
            elif piece[:1] == "\n":
                out = self.line + self.word(piece[1:], "")
            else:
                out = self.word(piece, SPACE)
        self[piece] = out
        return out

    def encode(self, text: str) -> bytes:
        """A space before a non-space begins a pre-token, and so does a line feed between non-spaces: where all white
        space is of these two kinds, pieces can be encoded alone. Other texts go through the library whole, and so do those
        that hold an added token's content, if that is to be one id wherever it stands."""
        if not text:
            return b""
        if len(self) > CACHE:
            self.old = dict(self)
            self.clear()
        odd = any(x in text for x in ODD) if text.isascii() else ODD_ANYWHERE.search(text)
        if odd or text[0] in " \n" or text[-1] in " \n" or any(x in text for x in self.added):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        first, *rest = text.replace("\n", " \n").split(" ")
        return self.word(first, "") + b"".join(map(self.__getitem__, rest))


@lru_cache(maxsize=2)
def pieces(path: str, added: bool = True) -> Pieces:
    return Pieces(path, added)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


# ---------------------------------------------------------------- files


def qualified(spark: SparkSession, folder: str) -> str:
    """The folder as a URI that means the same to Spark and to pyarrow: a bare path is in Spark's default file system."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    uri = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return re.sub("^file:/+", "file:///", uri)


def put(folder: str, name: str, data: bytes) -> None:
    """Writes beside the place and moves: a second attempt of a task replaces the file by an equal one."""
    from pyarrow import fs

    files, path = fs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", folder))
    files.create_dir(path, recursive=True)
    temporary = f"{path}/_{name}.{uuid.uuid4().hex}"
    with files.open_output_stream(temporary) as out:
        out.write(data)
    try:
        files.move(temporary, f"{path}/{name}")
    except OSError:  # some stores don't move onto a file
        files.delete_file(f"{path}/{name}")
        files.move(temporary, f"{path}/{name}")


def write_token_files(docs: DataFrame, folder: str, tokenizer: str | None = None, end_id: int = END_ID, file_tokens: int = FILE_TOKENS, added: bool = True) -> DataFrame:
    """Writes part-<partition>-<sequence>.pfor files under folder, in ascending order of doc_id over all files. Returns
    the manifest: part, seq, file, n_docs, n_tokens. folder: a URI that pyarrow opens on executors (file on a shared
    mount, hdfs, s3). The texts are shuffled once by ranges of doc_id; a range holds no more than file_tokens ids
    (and its last document) in memory. added: see token_output."""
    spark = docs.sparkSession
    bounded_batches(spark)
    folder = qualified(spark, folder)
    path = tokenizer or default_tokenizer()
    end = np.array([end_id], "<u4").tobytes()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, encoder, out = TaskContext.get().partitionId(), pieces(path, added), []
        ids: list[bytes] = []
        doc_ids: list[int | None] = []
        size = 0

        def flush() -> None:
            nonlocal ids, doc_ids, size
            if doc_ids:
                name = f"part-{part:06d}-{len(out):05d}.pfor"
                put(folder, name, encode_file(np.frombuffer(b"".join(ids), "<u4"), doc_ids, [len(x) // 4 for x in ids]))
                out.append((part, len(out), name, len(doc_ids), size))
                ids, doc_ids, size = [], [], 0

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids.append(encoder.encode(text.as_py()) + end)
                doc_ids.append(doc_id)
                size += len(ids[-1]) // 4
                if size >= file_tokens:
                    flush()
        flush()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64()))], names=["part", "seq", "file", "n_docs", "n_tokens"])

    few = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    ordered = few.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "doc_id").sortWithinPartitions("doc_id", "text")
    return checkpoint(ordered.mapInArrow(write, "part int, seq int, file string, n_docs long, n_tokens long"))


def read_token_files(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """file, doc_id, start (over all files), n_tokens, ids_crc32, from the files' bytes."""
    schema = "file string, doc_id long, at long, n_tokens long, ids_crc32 long"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids, doc_ids, lengths = decode_file(batch.column(1)[i].as_py())
                ends = np.cumsum(lengths)
                view = memoryview(ids.astype("<u4")).cast("B")
                crc = [zlib.crc32(view[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), lengths.tolist())]
                name = batch.column(0)[i].as_py().rpartition("/")[2]
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(crc)), pa.array(doc_ids, pa.int64()), pa.array(ends - lengths), pa.array(lengths), pa.array(crc, pa.int64())], names=["file", "doc_id", "at", "n_tokens", "ids_crc32"])

    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    starts = manifest.select(F.col("file"), F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("file_start"))
    if manifest.isEmpty():
        return spark.createDataFrame([], "file string, doc_id long, start long, n_tokens long, ids_crc32 long")
    rows = spark.read.format("binaryFile").option("pathGlobFilter", "part-*.pfor").load(qualified(spark, folder)).select("path", "content").mapInArrow(read, schema)
    return rows.join(starts, "file").select("file", "doc_id", (F.col("file_start") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def token_output(docs: DataFrame, tokenizer: str | None = None, folder: str | None = None, added: bool = True) -> DataFrame:
    """Writes docs as token files and returns doc_id, start, n_tokens, ids_crc32 as read back from them, and the file.
    added: the content of an added token is that token's id, as in the library's own encode; else plain characters."""
    spark = docs.sparkSession
    folder = folder or new_folder(spark, "tokens")
    manifest = write_token_files(docs, folder, tokenizer, added=added)
    return read_token_files(spark, folder, manifest).select("doc_id", "start", "n_tokens", "ids_crc32", "file")


def op10_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output(table(spark, sf_dir, "documents"))
