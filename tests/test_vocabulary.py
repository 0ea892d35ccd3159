"""The indexes of vocabulary matching against all pairs: deletion neighbourhoods and the trie."""

import random

import pytest
from pyspark.sql import functions as F

from labelloom.functions.distance import confusion_weights, distances
from labelloom.operators import vocabulary as J
from labelloom.operators.trie import Trie


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def edited(r, word, most, letters):
    w = list(word)
    for _ in range(r.randint(0, most)):
        at = r.randint(0, len(w))
        kind = r.random()
        if kind < 0.35:
            w.insert(at, r.choice(letters))
        elif w and kind < 0.7:
            del w[min(at, len(w) - 1)]
        elif w:
            w[min(at, len(w) - 1)] = r.choice(letters)
    return "".join(w)


def brute(texts, words, matcher, distance):
    norm = str.lower if matcher.case_insensitive else str
    out = set()
    for t in {t for t in texts if t}:
        for i, w in words:
            if w is None:
                continue
            a, b = norm(t), norm(w)
            if abs(len(a) - len(b)) <= matcher.max_distance and (d := distance(a, b)) <= matcher.max_distance:
                s = 1.0 if not max(len(a), len(b)) else 1 - d / max(len(a), len(b))
                if s >= matcher.min_similarity:
                    out.add((t, i, w, round(float(d), 9), round(s, 9)))
    return out


def found(texts, words, matcher):
    rows = J.candidates(J.distinct_texts(texts, "text"), words, matcher).collect()
    assert len(rows) == len({(r["text"], r["vocab_idx"]) for r in rows})
    return {(r["text"], r["vocab_idx"], r["matched"], round(r["distance"], 9), round(r["similarity"], 9)) for r in rows}


def some_words(seed, n, letters, lengths):
    r = random.Random(seed)
    words = ["".join(r.choice(letters) for _ in range(r.choice(lengths))) for _ in range(n)]
    texts = [edited(r, r.choice(words), 4, letters) for _ in range(n)] + [None, "", "é", "😀x", words[0], words[0].upper()]
    return texts, [*enumerate(words), (n, words[0]), (n + 1, ""), (n + 2, None), (n + 3, "É"), (n + 4, "x😀")]


#: Short strings; lengths about those where ends stand for the whole; long ones of few letters, with repeats.
SHAPES = {"short": ("abA", [1, 2, 3, 4, 5]), "about": ("abc", list(range(22, 36))), "long": ("ab", [40, 41, 42, 60]), "plain": ("abcdefgh 0O1l", list(range(3, 20)))}


@pytest.mark.parametrize("shape", sorted(SHAPES))
@pytest.mark.parametrize("matcher", [J.Matcher(), J.Matcher(max_distance=1, min_similarity=0.0), J.Matcher(max_distance=3, min_similarity=0.5, case_insensitive=False), J.Matcher(max_distance=4, min_similarity=0.3)], ids=lambda m: f"d{m.max_distance}")
def test_deletion_neighbourhoods_lose_nothing(spark, shape, matcher):
    letters, lengths = SHAPES[shape]
    texts, words = some_words(sorted(SHAPES).index(shape) + 10 * matcher.max_distance, 60 if matcher.max_distance == 3 else 120, letters, lengths)
    got = found(spark.createDataFrame([(t,) for t in texts], "text string"), spark.createDataFrame(words, "vocab_idx long, value string"), matcher)
    expected = brute(texts, words, matcher, levenshtein)
    assert got == expected and expected


@pytest.mark.parametrize("shape", sorted(SHAPES))
def test_trie_is_the_whole_table(shape):
    letters, lengths = SHAPES[shape]
    texts, words = some_words(5, 150, letters + "|I", lengths)
    weights = confusion_weights([("a", "b", 0.2)])
    entries = [w.lower() for _, w in words if w is not None]
    trie = Trie(entries, weights)
    for text in [t for t in texts if t]:
        expected = [(i, d) for i, d in enumerate(distances([text] * len(entries), entries, weights).tolist()) if d <= 2]
        assert sorted(trie.near(text, 2)) == expected
    assert Trie([], weights).near("abc", 2) == [] and Trie(["", "a"], weights).near("", 2) == [(0, 0.0), (1, 1.0)]


def test_trie_leaves_most_nodes_unvisited():
    r = random.Random(1)
    entries = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(12)) for _ in range(20_000)]
    trie = Trie(entries, confusion_weights())
    trie.near(entries[7], 2)
    assert trie.visited < 0.2 * sum(map(len, trie.letter))


@pytest.mark.parametrize("most", [7, 200_000])
def test_weighted_candidates(spark, monkeypatch, most):
    monkeypatch.setattr(J, "MOST_BROADCAST", most)  # one trie, and several
    letters, lengths = SHAPES["plain"]
    texts, words = some_words(9, 60, letters, lengths)
    matcher = J.Matcher(ocr_weights=True, custom=(("q", "g", 0.1),))
    weights = confusion_weights(matcher.custom)
    got = found(spark.createDataFrame([(t,) for t in texts], "text string"), spark.createDataFrame(words, "vocab_idx long, value string"), matcher)
    assert got == brute(texts, words, matcher, lambda a, b: distances([a], [b], weights)[0])


def test_compared_pairs_do_not_grow_with_the_vocabulary(spark):
    """Ten times the entries of unlike words: a text still meets those that are like it."""
    word = F.concat(F.translate(F.substring(F.md5(F.col("id").cast("string")), 1, 14), "0123456789", "ghijklmnop"))
    texts = spark.range(100).select(word.alias("text"), word.alias("norm"))
    met = []
    for n in (2_000, 20_000):
        words = spark.range(n).select(F.col("id").alias("vocab_idx"), word.alias("matched"), word.alias("entry"))
        pairs = J.met(texts, words, J.Matcher())
        plan = pairs._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan
        met.append(pairs.select("text", "vocab_idx").distinct().count())
    assert met[0] == met[1] == 100


def test_a_broadcast_is_checked_by_bytes(spark):
    words = spark.createDataFrame([(0, "x" * 1000), (1, None)], "vocab_idx long, value string")
    assert J.small(words) and not J.small(words, most_bytes=999) and not J.small(words, most=1) and J.small(words.limit(0))
