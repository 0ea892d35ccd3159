"""Token counts of a unigram model, by a trie of pre-tokens.

Distinct pre-tokens (runs of no white space, each led by the word mark) are inserted into a trie that a worker keeps over
its batches. A node holds the forward score (the best score of any segmentation of its prefix) and that segmentation's
number of tokens; both are found once, when the node is made, from those of its ancestors. The count at a pre-token's
end is kept beside. Prefixes of more than SHARED characters get no node: a longer pre-token's scores go on from the node of
its first SHARED characters, of which only the last ones that a piece can reach back to are kept. A piece's score is -log(rank + 1) over the vocabulary's ranks: a stand-in for a unigram table, which
the vocabulary, a BPE one, doesn't have. A character outside the vocabulary falls back to its UTF-8 bytes. Of equal
scores the one with the longer last piece counts.

Null and blank texts have no tokens. Repeated rows give equal results, an empty table an empty one; only doc_id and
text are read.
"""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Callable, Iterable, Sequence
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelloom.llm.common import map_batches, table, text_or_empty

MARK = "▁"
VOCABULARY = "piece_bpe_32k.model"
CACHE = 400_000
#: Nodes beyond which a trie is begun anew; what it has counted stays.
NODES = 500_000
#: Characters of a pre-token that the trie holds.
SHARED = 1_000


def vocabulary(path: str) -> dict[str, float]:
    """Pieces and scores; control, unknown and byte pieces stay out."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    return {p: -math.log(rank + 1) for rank, p in enumerate(pieces, 1)}


class Trie:
    """Prefixes of pre-tokens, with their forward scores and numbers of tokens. Node 0 is the empty prefix."""

    def __init__(self, pieces: dict[str, float]):
        self.pieces = pieces
        self.longest = max(map(len, pieces), default=1)
        self.unknown = min(pieces.values(), default=0.0) - 10
        self.clear()

    def clear(self) -> None:
        self.child: dict[tuple[int, str], int] = {}
        self.states = [(0.0, 0)]  # of each node: best score, number of tokens

    def insert(self, text: str) -> int:
        """The number of tokens at the end of text."""
        child, states, node = self.child, self.states, 0
        path = [states[0]]
        for end, c in enumerate(text[:SHARED], 1):
            key = node, c
            found = child.get(key)
            if found is None:
                found = child[key] = len(states)
                states.append(self.score(text, end, path))
            node = found
            path.append(states[node])
        if len(text) > SHARED:
            recent = deque(path, maxlen=self.longest)
            for end in range(SHARED + 1, len(text) + 1):
                recent.append(self.score(text, end, recent))
            path = recent
        return path[-1][1]

    def score(self, text: str, end: int, before: Sequence[tuple[float, int]]) -> tuple[float, int]:
        """The state of text[:end]; before: those of the prefixes up to end - 1, of the last ones at least."""
        pieces, top, n, first = self.pieces, -math.inf, 0, end - len(before)
        for start in range(max(0, end - self.longest), end):
            score = pieces.get(text[start:end])
            if score is not None and before[start - first][0] + score > top:
                top, n = before[start - first][0] + score, before[start - first][1] + 1
        if text[end - 1] not in pieces:
            size = len(text[end - 1].encode())
            if before[-1][0] + self.unknown * size > top:
                top, n = before[-1][0] + self.unknown * size, before[-1][1] + size
        return top, n


class Counter:
    """n_tokens of pre-tokens; the counts found so far stay, but for those of very long ones, in two generations of at most
    CACHE."""

    def __init__(self, pieces: dict[str, float]):
        self.trie = Trie(pieces)
        self.counts: dict[str, int] = {}
        self.old: dict[str, int] = {}

    def walk(self, tokens: Iterable[str]) -> dict[str, int]:
        out = {}
        for x in tokens:
            if len(self.trie.states) > NODES:
                self.trie.clear()
            out[x] = self.trie.insert(MARK + x)
        return out

    def count(self, texts: list[str]) -> list[tuple[int, int]]:
        """n_pretokens and n_tokens of each text."""
        out, at, split, room = [], 0, [], 0
        while at < len(texts):
            split, room = [], 0
            while at + len(split) < len(texts) and room < 2_000_000:
                split.append(texts[at + len(split)].split())
                room += len(split[-1])
            if len(self.counts) > CACHE:
                self.old, self.counts = self.counts, {}
            new = set().union(*split).difference(self.counts)
            known = {x: self.old[x] for x in new if x in self.old}
            self.counts |= known
            self.counts |= self.walk(new.difference(known))
            out += [(len(words), sum(map(self.counts.__getitem__, words))) for words in split]
            for x in new:
                if len(x) > SHARED:
                    del self.counts[x]
            at += len(split)
        return out


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(vocabulary(path))


def token_counts(docs: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id, n_pretokens, n_tokens. model: the path of a sentencepiece vocabulary, the same on all executors."""
    if model is None:
        import public_tokenizers

        model = public_tokenizers.path(VOCABULARY)

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        counts = counter(model)

        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            pairs = counts.count([x or "" for x in batch.column(1).to_pylist()])
            return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in zip(*pairs))], names=["doc_id", "n_pretokens", "n_tokens"])

        return one

    few = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return map_batches(few, make, "doc_id long, n_pretokens long, n_tokens long")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))
