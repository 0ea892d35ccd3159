"""Substring dedup, hard negatives and cross-tokenizer alignment: against brute force; edge cases."""

import hashlib
import random
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from labelloom.llm import hard_negatives, substrings, token_alignment
from labelloom.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


def texts_of(spark, sf_dir=SF):
    return [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]


# ---------------------------------------------------------------- substring dedup


def brute_cut(rows, width=13):
    first = {}
    last = 2**63 - 1
    split = [(last if i is None else i, (t or "").encode().split()) for i, t in rows]
    for i, w in split:
        for k in range(len(w) - width + 1):
            x = tuple(w[k : k + width])
            first[x] = min(i, first.get(x, i))
    out = []
    for i, w in split:
        gone = set()
        for k in range(len(w) - width + 1):
            if first[tuple(w[k : k + width])] < i:
                gone |= set(range(k, k + width))
        out.append((None if i == last else i, len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode()))
    return sorted(out, key=str)


def some_texts(n, seed=3):
    r = random.Random(seed)
    made = lambda k: [r.choice("abcdefgh") * r.randint(1, 4) for _ in range(k)]
    passages = [made(r.randint(5, 60)) for _ in range(6)]
    rows = []
    for i in range(n):
        w = made(r.randint(0, 40))
        for _ in range(r.randint(0, 3)):
            p = r.choice(passages)
            a, b = sorted((r.randint(0, len(p)), r.randint(0, len(p))))
            w[(at := r.randint(0, len(w))) : at] = p[a:b] if r.random() < 0.5 else p
        rows.append((i, r.choice([" ", "\t", "  \n", "\x0b"]).join(w)))
    return rows


def cut_rows(df, **more):
    return sorted((tuple(r) for r in substrings.repeated_spans(df, **more).select("doc_id", "n_words", "n_removed", "kept").collect()), key=str)


def test_texts_are_dealt_once(spark, tmp_path):
    """The chunks' texts go through one exchange, which both of their readers read."""
    spark.createDataFrame([(i, f"text {i} " + "of words that are here again and again and never change at all " * 2) for i in range(20)], "doc_id long, text string").write.parquet(str(tmp_path / "docs"))
    rows = substrings.repeated_spans(spark.read.parquet(str(tmp_path / "docs")))
    assert len(rows.collect()) == 20
    plan = rows._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "FlatMapCoGroupsInArrow" in plan and "FlatMapGroupsInArrow" in plan and plan.count("ReusedExchange") == 1


@pytest.mark.parametrize("more", [{}, {"chunk_bytes": 200, "bucket_bytes": 300}, {"width": 6, "seed": 2}])
def test_repeated_spans(spark, more):
    rows = some_texts(150)
    rows += [(10_000 + i, rows[3][1]) for i in range(40)] + [(20_000, "a " * 300), (20_001, "a " * 40), (20_001, "b " + "a " * 13)]
    rows += [(None, rows[5][1]), (None, "own " * 3), (7, rows[7][1]), (7, rows[8][1]), (-4, rows[9][1]), (30_000, None), (30_001, ""), (30_002, " \n"), (2**63 - 2, "é　ü " * 14)]
    df = spark.createDataFrame([(i, t, "x", {1: 2}) for i, t in rows], "doc_id long, text string, chunk string, doc map<int,int>").repartition(5)
    assert cut_rows(df, **more) == brute_cut(rows, more.get("width", 13))
    assert cut_rows(df.limit(0)) == []


def test_spans_have_sources(spark):
    p = [f"w{i}" for i in range(40)]
    q = [f"q{i}" for i in range(20)]
    rows = [(1, " ".join(["x", *p])), (2, " ".join(q)), (3, " ".join(["y", "z", *p[5:30], *q, "end"]))]
    spans = {r["doc_id"]: [tuple(s) for s in r["spans"]] for r in substrings.repeated_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert spans == {1: [], 2: [], 3: [(2, 27, 1), (27, 47, 2)]}


def test_whole_table_is_cut(spark):
    rows = texts_of(spark)
    got = {r["doc_id"]: tuple(r)[1:4] for r in substrings.op11_substring_dedup(spark, SF).collect()}
    assert got == {i: (n, gone, hashlib.sha256(kept.encode()).hexdigest()) for i, n, gone, kept in brute_cut(rows)}
    assert sum(x[1] for x in got.values()) > 0


def test_paths_hold_all_edges():
    r = random.Random(1)
    for n in (0, 1, 12, 13, 14, 500):
        words = [r.choice([b"a", b"b", b"c"]) for _ in range(n)]
        paths = substrings.Paths(words)
        assert len(paths.edges) == max(0, n - 12) == paths.sizes.sum() and (paths.sizes <= 9).all()
        assert ((paths.places >= 0) & (paths.places <= 8)).all()


# ---------------------------------------------------------------- hard negatives


def brute_negatives(rows, positives=5, negatives=3):
    """rows: vec_id, label, vector."""
    inf = float("inf")
    v = []
    for i, label, x in rows:
        if label is None or x is None or any(c is None or c != c or abs(c) == inf for c in x):
            continue
        v.append((2**63 - 1 if i is None else i, (label + 1) % 10 if i is not None and i % 7 == 0 else label, [int(np.floor(256 * float(c))) for c in x]))
    out = []
    for k, (i, label, q) in enumerate(v):
        if i == 2**63 - 1 or i % 50:
            continue
        scored = sorted((-sum(a * b for a, b in zip(q, c)), j, m) for m, (j, _, c) in enumerate(v) if m != k and len(c) == len(q))
        for minus, j, _ in [x for x in scored if v[x[2]][1] == label][:positives]:
            p = -minus
            left = [x for x in scored if v[x[2]][1] != label and 50 * p <= -100 * x[0] <= 95 * p]
            out += [(i, j, rank, n, p, -s) for rank, (s, n, _) in enumerate(left[:negatives], 1)]
    return sorted((tuple(None if x == 2**63 - 1 else x for x in row) for row in out), key=str)


def mined(spark, monkeypatch, rows, **sizes):
    for name, x in sizes.items():
        monkeypatch.setattr(hard_negatives, name, x)
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, label int, embedding array<double>, score string").repartition(3)
    monkeypatch.setattr(hard_negatives, "table", lambda *a: df)
    columns = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted((tuple(r) for r in hard_negatives.op12_hard_negatives(spark, "").select(*columns).collect()), key=str)


def vectors(n, seed=0, width=6):
    r = np.random.default_rng(seed)
    return [(i, int(r.integers(0, 4)), np.round(r.normal(size=width), 1 if i % 2 else 3).tolist()) for i in range(n)]


@pytest.mark.parametrize("columns", [7, 1024])
def test_hard_negatives(spark, monkeypatch, columns):
    rows = vectors(400)
    rows += [(1000 + i, 1, rows[3][2]) for i in range(30)]  # equal vectors: ties
    rows += [(50, 2, rows[50][2]), (50, 2, rows[50][2])]  # equal ids
    rows += [(2000, None, [1.0] * 6), (2050, 1, None), (2100, 1, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (2150, 1, [float("nan")] * 6), (2200, 1, [float("-inf")] * 6), (None, 1, [0.5] * 6), (2250, 1, []), (2300, 1, []), (2301, 1, [1.0, 2.0]), (2350, 0, [1.0, 2.0]), (2351, 0, [3.0, 2.0]), (2352, 2, [2.0, 2.0])]
    assert mined(spark, monkeypatch, rows, COLUMNS=columns) == brute_negatives(rows)


def test_large_components_are_exact(spark, monkeypatch):
    r = np.random.default_rng(2)
    rows = [(i, int(r.integers(0, 2)), (r.integers(-(2**22), 2**22, 3) / 4).tolist()) for i in range(120)]
    assert mined(spark, monkeypatch, rows) == brute_negatives(rows)
    assert mined(spark, monkeypatch, [(0, 1, [1e300, 1.0]), (1, 1, [1e300, 1.0]), (2, 3, [1e300, -5.0])]) is not None
    assert mined(spark, monkeypatch, rows[:1]) == [] == mined(spark, monkeypatch, [(1, None, None)])


def test_blocks_of_anchors(spark):
    rows = vectors(300)
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").repartition(4)
    each = [hard_negatives.hard_negatives(df, F.col("vec_id") % 5 == 0, block=n).collect() for n in (7, 2048)]
    assert sorted(map(tuple, each[0])) == sorted(map(tuple, each[1])) and each[0]
    sizes = [len(x) for x in hard_negatives.blocks_of(hard_negatives.prepared(df), 7)]
    assert max(sizes) <= 7 and sum(sizes) == 300


def test_hard_negatives_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    expected = con.execute(ORACLE_SQL["op12_hard_negatives"])
    names = [x[0] for x in expected.description]
    assert sorted(map(tuple, QUERIES["op12_hard_negatives"](spark, SF).select(*names).collect())) == sorted(expected.fetchall())


# ---------------------------------------------------------------- cross-tokenizer alignment


def brute_alignment(texts):
    of = token_alignment.tokenizers(*token_alignment.default_tokenizers())
    docs, held, found = [], defaultdict(set), []
    for d, text in enumerate(texts):
        a, b = of.encode(text) if text else ([], [])
        whole = b" " + (text or "").encode()
        if b"".join(of.bytes_a[i] for i in a) != whole or b"".join(of.bytes_b[i] for i in b) != whole:
            a, b = [], []
        spans = []
        for ids, of_bytes in ((a, of.bytes_a), (b, of.bytes_b)):
            ends = np.cumsum([len(of_bytes[i]) for i in ids]).astype(int).tolist()
            spans.append(list(zip(ids, [0, *ends][: len(ids)], ends)))
        links = [(x, y) for x, s, e in spans[0] for y, t, f in spans[1] if s < f and t < e]
        both = sorted({x[2] for x in spans[0]} & {x[2] for x in spans[1]})
        groups = ["|".join(",".join(str(i) for i, s, _ in side if lo <= s < hi) for side in spans) for lo, hi in zip([0, *both], both)]
        for x in links:
            held[x].add(d)
        docs.append((len(a), len(b), groups, links))
    best = defaultdict(int)
    for (x, _), d in held.items():
        best[x] = max(best[x], len(d))
    for n_a, n_b, groups, links in docs:
        found.append((n_a, n_b, len(groups), len(links), sum(len(held[x]) == best[x[0]] for x in links), sum(len(held[x]) for x in links), hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""))
    return found


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.mark.parametrize("more", [{}, {"chunk_bytes": 100}])
def test_alignment(spark, monkeypatch, more):
    r = random.Random(4)
    letters = ["a", "b", "th", "ing", "é", "中", "文", " ", " ", " ", "\n", "\t", "  ", "　", "\x00", "'s", "1", "23", ".", "😀", "x" * 30, "<s>", "</s>", "<|endoftext|>", "<0x0A>", "the"]
    texts = ["".join(r.choice(letters) for _ in range(r.randint(0, 60))) for _ in range(120)] + [None, "", " ", "  a", "a ", "▁", "a ▁b c", "same text", "same text", "same text", "internationalisation antidisestablishmentarianism"]
    df = spark.createDataFrame([(i if i else None, t, ["x"]) for i, t in enumerate(texts)], "doc_id long, text string, chunk array<string>").repartition(3)
    monkeypatch.setattr(token_alignment, "KEPT_GROUPS", 50 if more else 400_000)
    monkeypatch.setattr(token_alignment, "AT_ONCE", 30 if more else 2 << 20)
    got = {r["doc_id"] or 0: tuple(r)[1:] for r in token_alignment.aligned(df, **more).select(*COLUMNS).collect()}
    assert got == dict(enumerate(brute_alignment(texts)))
    assert token_alignment.aligned(df.limit(0)).collect() == []


def test_whole_table_is_aligned(spark):
    rows = sorted(texts_of(spark))[:60]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    got = {r["doc_id"]: tuple(r)[1:] for r in token_alignment.aligned(df).select(*COLUMNS).collect()}
    assert got == {i: x for (i, _), x in zip(rows, brute_alignment([t for _, t in rows]))}
    whole = QUERIES["op13_token_alignment"](spark, SF)
    assert whole.columns == COLUMNS and whole.count() == len(texts_of(spark))


def test_texts_are_grouped_together():
    """Whatever texts stand beside each other, a text's groups are its own."""
    r = random.Random(5)
    letters = list("ab'stre1,.!é中　 \t\n\r  \x1c\x85​᠎😀́<>|ſ \x00\x0b▁") + ["'s", "'ll", " the", " and", "\n\n", "  ", "<s>", "<|endoftext|>", "x" * 50]
    texts = ["".join(r.choice(letters) for _ in range(r.randint(0, 14))) for _ in range(2000)]
    groups = token_alignment.Groups(token_alignment.tokenizers(*token_alignment.default_tokenizers()))
    names = [[groups.names[k] for k in x] for at in range(0, 2000, 37) for x in groups.texts(texts[at : at + 37])]
    digests = [hashlib.sha256(";".join(x).encode()).hexdigest() if x else "" for x in names]
    assert digests == [x[-1] for x in brute_alignment(texts)] and [len(x) for x in names] == [x[2] for x in brute_alignment(texts)]
    assert groups.texts([]) == []


def test_ranked_ids_are_the_library_s():
    r = random.Random(8)
    of = token_alignment.tokenizers(*token_alignment.default_tokenizers())
    assert of.ranked() is not None
    letters = list("ab'stre1,.!é中　 \t\n\r  \x1c\x85​᠎😀́<>|ſ \x00\x0b▁½٣") + ["'s", "'ll", " the", " and", "\n\n", "  ", "<s>", "<|endoftext|>", "Русский", "كتاب"]
    texts = ["".join(r.choice(letters) for _ in range(r.randint(1, 14))) for _ in range(30_000)]
    whole = of.a.encode_batch([" " + x for x in texts], add_special_tokens=False)
    assert [of.ids_a(" " + x) for x in texts] == [x.ids for x in whole]
