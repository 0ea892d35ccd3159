"""Decontamination, line and SimHash duplicates, mixing, HTML text and the pipeline: against brute force; edge cases."""

import hashlib
import os
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from labelloom.llm import crowds, decontaminate, html_text, line_dedup, mixing, near_copies, quality, simhash

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def classes(n, links):
    p = list(range(n))

    def root(x):
        while p[x] != x:
            p[x] = p[p[x]]
            x = p[x]
        return x

    for a, b in links:
        p[root(a)] = root(b)
    return [root(i) for i in range(n)]


# ---------------------------------------------------------------- decontamination


def brute_hits(docs, items, width=10):
    """A result for each of docs (key, text), in their order."""
    windows = defaultdict(set)
    for item, text in items:
        w = words(text)
        if w:
            n = min(width, len(w))
            for i in range(len(w) - n + 1):
                windows[tuple(w[i : i + n])] |= {str(item)} if item is not None else set()
    out = []
    for key, text in docs:
        w, hit, found, spans = words(text), set(), set(), []
        for n in sorted({len(x) for x in windows}):
            for i in range(len(w) - n + 1):
                got = windows.get(tuple(w[i : i + n]))
                if got is not None:
                    hit |= set(range(i, i + n))
                    found |= got
                    spans.append((i, n))
        out.append((key, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit), ",".join(f"{i}+{n}" for i, n in sorted(spans))))
    return out


def contamination_case():
    r = random.Random(4)
    vocab = ["".join(r.choice("abcé1") for _ in range(3)) for _ in range(60)]
    text = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    items = [(i, text(r.randint(8, 30))) for i in range(12)] + [(20, "Two words"), (21, ""), (22, None), (None, "an item without an id"), (23, "single"), (12, None)]
    items.append((24, items[0][1]))
    docs = [(i, text(r.randint(0, 60))) for i in range(60)]
    for i in range(0, 60, 4):
        w = items[r.randint(0, 11)][1].split()
        at = r.randint(0, max(0, len(w) - 11))
        docs[i] = (i, docs[i][1] + " -- " + ", ".join(w[at : at + r.randint(9, 14)]).upper().replace("É", "é") + "; " + docs[i][1])
    docs += [(100, None), (101, ""), (102, "see TWO: words!"), (103, "a " * 30_000 + "single"), (None, "nothing here"), (None, "single"), (104, items[1][1]), (105, "Is it an item, without an ID?")]
    docs += [docs[4], docs[4], docs[1], (4, "clean text of the same id"), (100, None)]
    return docs, items


def test_decontaminate(spark):
    docs, items = contamination_case()
    df = spark.createDataFrame([(i, t, "clash", 0, "spans", 7) for i, t in docs], "doc_id long, text string, items string, at int, spans string, row int")
    bench = spark.createDataFrame([(i, t, "clash") for i, t in items], "item_id long, text string, window string")
    expected = brute_hits(docs, items)
    for most in (10**6, 0):
        rows = decontaminate.decontaminate(df, bench, most_broadcast=most).collect()
        assert sorted(map(str, map(tuple, rows))) == sorted(map(str, expected)) and sum(r["contaminated"] for r in rows) > 10
        plan = decontaminate.decontaminate(df, bench, most_broadcast=most)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and ("BroadcastHashJoin" in plan or not most)
        assert {tuple(r)[2] for r in decontaminate.decontaminate(df, bench.limit(0), most_broadcast=most).collect()} == {0}
    kept = decontaminate.drop_contaminated(df, bench)
    assert kept.columns == df.columns and sorted(str((r["doc_id"], r["text"])) for r in kept.collect()) == sorted(str(d) for d, v in zip(docs, expected) if not v[5])
    cut = decontaminate.cut_contaminated(df, bench)
    assert cut.columns == df.columns
    assert sorted((str(r["doc_id"]), len(words(r["text"]))) for r in cut.collect()) == sorted((str(d[0]), v[1] - v[2]) for d, v in zip(docs, expected))
    assert decontaminate.decontaminate(df.limit(0), bench).count() == 0


# ---------------------------------------------------------------- near copies


def brute_sets(texts, width=5):
    w = [(t or "").encode().lower().split() for t in texts]
    return [{tuple(x[i : i + width]) for i in range(max(1, len(x) - width + 1))} if x else set() for x in w]


def brute_firsts(rows):
    """Places of the rows that stay: brute-force Jaccard over all pairs."""
    sets = brute_sets([t for _, t in rows])
    links = [(i, j) for i in range(len(rows)) for j in range(i) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    group = classes(len(rows), links)
    best = {}
    for i, g in enumerate(group):
        key = (rows[i][0] is None, rows[i][0] or 0)
        best[g] = min(best.get(g, (key, i)), (key, i))
    return {i for _, i in best.values()}, len(links)


def test_near_copies(spark, monkeypatch):
    r = random.Random(11)
    vocab = ["".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(400)]
    rows = []
    for _ in range(40):
        base = [r.choice(vocab) for _ in range(r.choice((3, 5, 9, 40, 200)))]
        for _ in range(6):
            w = list(base)
            for _ in range(r.randint(0, max(1, len(w) // 25))):
                w[r.randrange(len(w))] = r.choice(vocab)
            rows.append(" ".join(w))
    base = [r.choice(vocab) for _ in range(120)]
    for _ in range(90):  # a crowd on which two centres don't decide
        w = list(base)
        for _ in range(r.randint(1, 5)):
            w[r.randrange(len(w))] = r.choice(vocab)
        rows.append(" ".join(w))
    rows += ["", None, "one", "One", "a b c"]
    rows = [(i * 7 % 1009, t) for i, t in enumerate(rows)]
    rows += [(rows[0][0], "another text of the same id that nothing else has"), (None, rows[5][1]), (None, "two rows without an id, the first of them"), (None, "and quite another one, with other words in it")]
    stay, n_links = brute_firsts(rows)
    df = spark.createDataFrame([(i, t, n) for n, (i, t) in enumerate(rows)], "doc_id long, text string, place int")
    for tile in (crowds.TILE, 5):
        monkeypatch.setattr(crowds, "TILE", tile)
        kept = near_copies.keep_first_similar(df.unionByName(df.where("place = 2")))
        assert kept.columns == df.columns and n_links > 300
        assert sorted(x["place"] for x in kept.collect()) == sorted(stay)
    assert near_copies.keep_first_similar(df.limit(0)).count() == 0


def test_near_copies_by_balls(spark, monkeypatch):
    """Ball hashing of fingerprints links near copies by itself where no minima meet; the exact similarity still decides."""
    r = random.Random(3)
    vocab = ["".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(400)]
    rows = []
    for _ in range(30):
        base = [r.choice(vocab) for _ in range(r.choice((40, 300)))]
        rows += [" ".join(base), " ".join([*base, r.choice(vocab)]), " ".join([*base[:-1], r.choice(vocab), r.choice(vocab)])]
    prints = [simhash.fingerprint(t.encode(), near_copies.WIDTH) for t in rows]
    near = [(i, j) for i in range(len(rows)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 3]
    sets = brute_sets(rows)
    links = [(i, j) for i, j in near if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    found = near_copies.shingled(df).select("doc_id", "node", "fp").collect()
    assert {x["doc_id"]: x["fp"] % 2**64 for x in found} == dict(enumerate(prints)) and len(links) > 30
    # Bands of no use: each text has keys of its own.
    monkeypatch.setattr(near_copies, "band_keys", lambda least: np.frombuffer(least.tobytes()[: 8 * near_copies.BANDS], np.int64) ^ hash(least.tobytes()))
    kept = {x["doc_id"] for x in near_copies.keep_first_similar(df).collect()}
    group = classes(len(rows), links)
    assert kept == {min(i for i, g in enumerate(group) if g == x) for x in set(group)}


def test_pipeline_drops_near_copies(spark):
    import corpus_pipeline

    words = [f"w{i}" for i in range(100)]
    edited = [*words[:30], "x", *words[31:70], "y", *words[71:]]  # 10 of 96 shingles differ: similarity 86 / 106
    df = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(edited)), (3, "other " * 9)], "doc_id long, text string")
    assert bin(simhash.fingerprint(" ".join(words).encode()) ^ simhash.fingerprint(" ".join(edited).encode())).count("1") > 3
    assert sorted(x["doc_id"] for x in corpus_pipeline.near_duplicates(spark, df, "").collect()) == [1, 3]


# ---------------------------------------------------------------- SimHash


def brute_fingerprint(text):
    from xxhash import xxh64_intdigest

    w = (text or "").encode().lower().split()
    s = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    counts = [sum(xxh64_intdigest(x, 42) >> b & 1 for x in s) for b in range(64)]
    return sum(1 << b for b in range(64) if counts[b] * 2 > len(s)) if s else 0


def test_fingerprints_and_components(spark):
    r = random.Random(3)
    base = [" ".join("".join(r.choice("abcdefgh") for _ in range(4)) for _ in range(r.randint(100, 300))) for _ in range(12)]
    texts = []
    for t in base:
        texts.append(t)
        for _ in range(8):
            w = t.split()
            for _ in range(r.randint(1, 3)):
                w[r.randrange(len(w))] = "changed"
            texts.append(" ".join(w))
    texts += ["", None, " \t", "One", "one", "a b", "x " * 40_000, base[0], base[0].upper()]
    df = spark.createDataFrame([(i * 7 % 1000, t, -1) for i, t in enumerate(texts)], "doc_id long, text string, fp int")
    fps = [brute_fingerprint(t) for t in texts]
    group = classes(len(texts), [(i, j) for i in range(len(texts)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3])
    least = {}
    for i, g in enumerate(group):
        least[g] = min(least.get(g, 10**9), i * 7 % 1000)
    expected = {i * 7 % 1000: (format(fps[i], "016x"), least[group[i]]) for i in range(len(texts))}
    rows = simhash.simhash_components(df).select("doc_id", simhash.hex_digits(F.col("fp")).alias("f"), "component_id").collect()
    assert {r["doc_id"]: (r["f"], r["component_id"]) for r in rows} == expected and len(rows) == len(texts)
    kept = simhash.keep_first(df.unionByName(df.where("doc_id = 0")))
    assert kept.columns == df.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(set(least.values()))
    assert simhash.simhash_components(df.limit(0)).count() == 0 and simhash.keep_first(df.limit(0)).count() == 0


@pytest.mark.parametrize("few", [64, 1])
def test_links_of_crowds(spark, monkeypatch, few):
    monkeypatch.setattr(simhash, "FEW", few)
    r = np.random.default_rng(1)
    fps = set()
    for b in (int(x) for x in r.integers(0, 2**63, 12)):
        bits = r.choice(64, 8, replace=False)
        for _ in range(25):
            x = b
            for k in r.choice(bits if b % 2 else np.arange(64), r.integers(0, 5), replace=False):
                x ^= 1 << int(k)
            fps.add(x)
    u = np.array(sorted(fps), np.uint64)
    group = classes(len(u), [(i, i + 1 + int(j)) for i in range(len(u)) for j in np.nonzero(np.bitwise_count(u[i + 1 :] ^ u[i]) <= 3)[0]])
    s = [int(x) for x in u.view(np.int64)]
    least = {}
    for i, g in enumerate(group):
        least[g] = min(least.get(g, 2**63), s[i])
    found = crowds.components(simhash.links_of(spark.createDataFrame([(x,) for x in s], "fp long"))).collect()
    roots = {r["node"]: r["root"] for r in found}
    assert all(roots.get(x, x) == least[group[i]] for i, x in enumerate(s))


def test_components_of_a_chain(spark):
    n = 60
    links = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(100, 100), (201, 200), (200, 201)], "a long, b long")
    assert {r["node"]: r["root"] for r in crowds.components(links).collect()} == {**{i: 0 for i in range(1, n + 1)}, 201: 200}
    assert crowds.components(links.limit(0)).count() == 0


# ---------------------------------------------------------------- lines


def distance(a, b):
    last = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        last = row
    return last[-1]


def edited(r, line, n):
    out = list(line)
    for _ in range(n):
        at, how = r.randrange(len(out)), r.randrange(3)
        if how == 0:
            out.insert(at, r.choice("abcé "))
        elif how == 1 and len(out) > 1:
            out.pop(at)
        else:
            out[at] = r.choice("abcé ")
    return "".join(out)


def test_within():
    r = random.Random(0)
    for _ in range(4000):
        a = "".join(r.choice("ab") for _ in range(r.randint(0, 8)))
        b = edited(r, a, r.randint(0, 4)) if a and r.random() < 0.6 else "".join(r.choice("ab") for _ in range(r.randint(0, 8)))
        for t in (0, 1, 2, 3):
            assert line_dedup.within(a, b, t) == min(distance(a, b), t + 1), (a, b, t)
            if a and b:
                places, linked = line_dedup.comparing(t)()([a.encode()], [b.encode()])
                assert [linked(i, j) for i, j in places] in ([distance(a, b) <= t], [] if distance(a, b) > t else None)


def test_within_long_lines(monkeypatch):
    r = random.Random(5)
    monkeypatch.setattr(line_dedup, "PART", 4)
    for _ in range(1000):
        a = "".join(r.choice("abc") for _ in range(r.randint(1, 30)))
        b = edited(r, a, r.randint(0, 4))
        for t in (1, 2, 3):
            assert line_dedup.within(a, b, t) == min(distance(a, b), t + 1), (a, b, t)
    monkeypatch.undo()
    a = "".join(r.choice("abcdefgh ") for _ in range(1_000_000))
    began = time.process_time()
    assert line_dedup.within(a, edited(r, a, 2), 2) <= 2 and line_dedup.within(a, "x" + a[:-1] + "yz", 2) == 3
    assert time.process_time() - began < 30


def test_line_texts_by_shuffle(spark, monkeypatch):
    """Above the size of a broadcast, texts that meet are fetched by a shuffle: the classes are equal."""
    r = random.Random(6)
    lines = ["".join(r.choice("abcdef") for _ in range(20)) for _ in range(30)]
    docs = spark.createDataFrame([(i, "\n".join(edited(r, r.choice(lines), r.randint(0, 2)) for _ in range(4))) for i in range(40)], "doc_id long, text string")
    few = lambda: sorted(map(tuple, line_dedup.line_classes(docs).collect()), key=str)
    broadcast = few()
    monkeypatch.setattr(line_dedup, "MOST_BROADCAST", 0)
    assert few() == broadcast and any(x[5] for x in broadcast)


def test_segments_meet():
    r = random.Random(1)
    for _ in range(2000):
        a = "".join(r.choice("abcdef") for _ in range(r.randint(12, 40)))
        b = edited(r, a, 2)
        keys = lambda s: ({(len(s), i, s[p : p + n]) for i, (p, n) in enumerate(line_dedup.segments(len(s), 2))}, {(o, i, s[p : p + n]) for o, i, p, n in line_dedup.probes(len(s), 2)})
        (ia, pa), (ib, pb) = keys(a), keys(b)
        assert ia & pb or ib & pa
    lines = ["abc", "héllo 🙂", "x" * 70]
    assert [int(x) & (2**64 - 1) for x in line_dedup.parities(lines)] == [line_dedup.parity(x) for x in lines]


def line_groups(spark, lines):
    """Brute force and found classes of the lines, as the least place in each."""
    links = [(i, j) for j in range(len(lines)) for i in range(j) if abs(len(lines[i]) - len(lines[j])) <= 2 and distance(lines[i], lines[j]) <= 2]
    df = spark.createDataFrame(list(enumerate(lines)), "node long, line string")
    roots = {x["node"]: x["root"] for x in line_dedup.line_roots(df, df).collect()}
    group, least = classes(len(lines), links), {}
    for i, g in enumerate(group):
        least.setdefault(g, i)
    return [least[g] for g in group], [roots.get(i, i) for i in range(len(lines))], len(links)


@pytest.mark.parametrize("few", [32, 2])
def test_classes_of_short_lines(spark, monkeypatch, few):
    monkeypatch.setattr(crowds.meeting_roots, "__defaults__", (few,))
    monkeypatch.setattr(crowds, "TILE", 7)
    r = random.Random(9)
    lines = sorted({"".join(r.choice("abcdefghijklmé") for _ in range(r.randint(1, 12))) for _ in range(150)} | {"Atonor a it.", "Anor a it.", "a", "b", "ab", "xy", "é"})
    expected, found, n = line_groups(spark, lines)
    assert found == expected and n > 50


def test_classes_of_crowds(spark, monkeypatch):
    """Lines that share two thirds: some are edits of one another, many are not; and a crowd of edits of one line."""
    monkeypatch.setattr(crowds, "TILE", 16)
    r = random.Random(5)
    lines = {"the same beginning of it " + "".join(r.choice("abcdefgh") for _ in range(7)) for _ in range(150)}
    base = "a line that stands nearly everywhere, edited a little"
    lines |= {edited(r, base, 1).strip() for _ in range(150)} | {edited(r, edited(r, base, 2), 2).strip() for _ in range(60)}
    expected, found, n = line_groups(spark, sorted(lines))
    assert found == expected and n > 1000 and 100 < len(set(expected)) < len(lines) - 100


@pytest.mark.parametrize("few", [32, 2])
def test_links_within_classes(spark, monkeypatch, few):
    """Each line's own links, in crowds and beside them, where most of a class's lines aren't linked to each other."""
    monkeypatch.setattr(crowds, "FEW", few)
    monkeypatch.setattr(crowds, "TILE", 16)
    r = random.Random(15)
    base = "a line that stands nearly everywhere, edited a little"
    lines = {edited(r, base, 1).strip() for _ in range(60)} | {edited(r, edited(r, base, 2), 2).strip() for _ in range(60)}
    lines |= {"the same beginning of it " + "".join(r.choice("abcd") for _ in range(5)) for _ in range(80)} | {f"Page {i}" for i in range(0, 300, 4)}
    lines = sorted(lines)
    links = [(i, j) for j in range(len(lines)) for i in range(j) if abs(len(lines[i]) - len(lines[j])) <= 2 and distance(lines[i], lines[j]) <= 2]
    df = spark.createDataFrame(list(enumerate(lines)), "node long, line string")
    found = {x["node"]: (x["root"], x["n_links"]) for x in line_dedup.line_roots(df, df).collect()}
    degree, group = Counter(x for pair in links for x in pair), classes(len(lines), links)
    size, least = Counter(group), {}
    for i, g in enumerate(group):
        least.setdefault(g, i)
    assert found == {i: (least[group[i]], n) for i, n in degree.items()}
    assert sum(n < size[group[i]] - 1 for i, n in degree.items()) > 100


def test_line_dedup(spark):
    r = random.Random(6)
    base = ["".join(r.choice("abcdefé ") for _ in range(r.randint(5, 60))).strip() or "x" for _ in range(40)]
    pool = base + [edited(r, b, r.randint(1, 3)) for b in base for _ in range(3)]
    docs = [(i, "\n".join(r.choice(pool) + r.choice(["", " ", "\t"]) for _ in range(r.randint(0, 8)))) for i in range(50)]
    docs += [(50, None), (51, ""), (52, "\n \n"), (53, "z" * 100_000), (54, "z" * 100_001), (None, base[0])]
    docs += [docs[3], docs[3], (60, "a row that is there twice\n\nand its second line"), (60, "a row that is there twice\n\nand its second line"), (60, "another text of that document")]
    strip = lambda s: s.strip(" \t\n\v\f\r")
    lines = sorted({strip(x) for _, t in docs for x in (t or "").split("\n")} - {""})
    long = [x for x in lines if len(x) < 1000]
    links = [(i, j) for i, a in enumerate(long) for j, b in enumerate(long[:i]) if abs(len(a) - len(b)) <= 2 and distance(a, b) <= 2]
    group = dict(zip(long, classes(len(long), links)))
    group |= {x: "z" for x in lines if len(x) >= 1000}
    degree = Counter(long[x] for pair in links for x in pair) | Counter({x: 1 for x in lines if len(x) >= 1000})
    df = spark.createDataFrame([(i, t, "clash", n) for n, (i, t) in enumerate(docs)], "doc_id long, text string, dropped_at string, row int")
    df = df.withColumn("row", F.lit(0))
    order = {(x["doc_id"], x["text"]): x["h"] for x in df.select("doc_id", "text", line_dedup.row_hash(df).alias("h")).collect()}
    seen, expected, cut = {}, [], []
    for i, t in sorted(docs, key=lambda d: (d[0] is None, d[0] or 0, order[d])):
        places = [(at, strip(x)) for at, x in enumerate((t or "").split("\n")) if strip(x)]
        dropped, holders = [], set()
        for at, x in places:
            if group[x] in seen:
                dropped.append(at)
                holders |= {seen[group[x]]} - {None}
            seen.setdefault(group[x], i)
        expected.append((i, len(places), len(dropped), sum(degree[x] for _, x in places), ",".join(map(str, dropped)), sorted(holders)))
        cut.append((i, None if t is None else "\n".join(x for at, x in enumerate(t.split("\n")) if at not in dropped)))
    line_dedup_table = line_dedup.table
    try:
        line_dedup.table = lambda *a: df
        got = [tuple(x) for x in line_dedup.op5_line_dedup(spark, "").collect()]
        line_dedup.table = lambda *a: df.limit(0)
        assert line_dedup.op5_line_dedup(spark, "").count() == 0
    finally:
        line_dedup.table = line_dedup_table
    assert sorted(map(str, got)) == sorted(map(str, expected)) and len(links) > 30
    out = line_dedup.dedup_lines(df)
    assert out.columns == df.columns and out.where("dropped_at = 'clash'").count() == len(docs)
    assert sorted(map(str, cut)) == sorted(str((x["doc_id"], x["text"])) for x in out.collect())


# ---------------------------------------------------------------- mixing


def test_targets():
    assert mixing.targets([100, 100, 100], [3, 1, 2], 450) == [200, pytest.approx(250 / 3), pytest.approx(500 / 3)]
    assert mixing.targets([], [], 0) == [] and mixing.targets([0, 10], [3, 1], 15) == [0, 15]
    sizes = [5, 1000, 30, 700, 1]
    got = mixing.targets(sizes, [3, 1, 2, 3, 1], 1.5 * sum(sizes))
    assert sum(got) == pytest.approx(1.5 * sum(sizes)) and all(t <= 2 * s for t, s in zip(got, sizes))


def test_many_sources_in_tables(spark, monkeypatch):
    r = random.Random(5)
    names = [f"s{i}" for i in range(40)] + ["é", "\U0001f600", "", "\uffff", None]
    docs = [(i, " ".join("w" for _ in range(r.choice([0, 1, 30, 400, 9000]))), "big" if r.random() < 0.3 else r.choice(names)) for i in range(400)]
    docs += [docs[3], (None, "a b", None), (None, None, "s1"), (7, "c", "only me")]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    monkeypatch.setattr(mixing, "CHUNK", 50)
    found = []
    for most in (100_000, 0):
        monkeypatch.setattr(mixing, "SOURCES", most)
        sizes = mixing.row_sizes(df)
        mix = mixing.sources(sizes)
        assert isinstance(mix, list) == (most > 0)
        queries = []
        for one in (df, df.where("text is null")):
            monkeypatch.setattr(mixing, "table", lambda *a, one=one: one)
            queries.append(sorted(map(str, mixing.op7_mixing(spark, "").collect())))
        pieces = mixing.mix_documents(sizes, mix, 64).drop("source_no").collect()
        found.append((queries, sorted(map(str, pieces)), sorted(map(str, mixing.mixed_rows(df).collect()))))
    assert len(found[0][0][0]) == len(docs) and found[0][1] and found[0] == found[1]


def test_mixing(spark):
    r = random.Random(8)
    docs = [(i, " ".join("w" for _ in range(r.choice([0, 1, 5, 40, 900]))), f"s{r.choice('aaaab')}") for i in range(300)]
    docs += [(300, None, "sa"), (301, " a\tb\x0bc　d ", None), (302, "tiny", "é"), (5, docs[5][1], docs[5][2]), (5, docs[5][1], docs[5][2]), (5, "other text", "sa"), (None, "no id here", None), (None, "no id here either", "sa"), (None, "no id here either", "sa")]
    df = spark.createDataFrame([(i, t, s, 7, "clash", n % 2, n if n < 300 else 0) for n, (i, t, s) in enumerate(docs)], "doc_id long, text string, source string, n_chars long, size string, taken_words int, row int")
    sizes = mixing.row_sizes(df)
    mix = mixing.sources(sizes)
    assert [s.name for s in mix] == ["sa", "sb", "é", None] and [s.weight for s in mix] == [3, 1, 2, 3]
    for block in (7, 2048):
        pieces = mixing.mix_documents(sizes, mix, block).collect()
        taken = Counter()
        for p in pieces:
            taken[p["source"]] += p["n_words"]
        assert {s.name: int(s.target) for s in mix} == dict(taken)
        slots = defaultdict(set)
        for p in pieces:
            slots[p["slot"]].add(p["source_no"])
        assert all(len(s) == 1 for s in slots.values())
    first = {}
    for p in pieces:
        first[p["doc_id"]] = min(first.get(p["doc_id"], 10**9), p["slot"])
    old = mixing.table
    try:
        mixing.table = lambda *a: df
        rows = mixing.op7_mixing(spark, "").collect()
        again = mixing.op7_mixing(spark, "").collect()
        mixing.table = lambda *a: df.limit(0)
        assert mixing.op7_mixing(spark, "").count() == 0
        mixing.table = lambda *a: df.where("text is null")
        assert [tuple(x)[:5] for x in mixing.op7_mixing(spark, "").collect()] == [(300, 0, 0, 0.0, 0)]
    finally:
        mixing.table = old
    assert len(rows) == len(docs) and sorted(map(str, rows)) == sorted(map(str, again))
    assert all(x["slot"] == first[x["doc_id"]] for x in rows if x["taken"] and x["doc_id"] not in (5, None)) and all((x["slot"] is None) == (x["taken"] == 0) for x in rows)
    assert sorted(x["size"] for x in rows) == sorted(len(re.findall("[^ \t-\r]+", t or "")) for _, t, _ in docs)
    assert all(x["taken"] <= 2 * x["size"] for x in rows)
    out = mixing.mixed_rows(df)
    assert out.columns == df.columns
    got, stands = Counter(), Counter()
    for x in out.collect():
        n = len(re.findall("[^ \t-\r]+", x["text"]))
        got[x["source"]] += n
        stands[x["doc_id"], x["size"], x["taken_words"], x["row"]] += n
        assert x["n_chars"] == 7 or x["n_chars"] == len(x["text"])
    taken = Counter()
    for x in rows:
        taken[x["doc_id"]] += x["taken"]
    for (i, *_), n in stands.items():
        taken[i] -= n
    assert not any(taken.values())
    assert dict(got) == {s.name: int(s.target) for s in mix}


def test_schedule_is_even(spark):
    mix = [mixing.Source(str(i), 1, 10**9, w, 10.0**5 * w) for i, w in enumerate((3, 1, 2))]
    rows = mixing.schedule(spark, mix, 50).orderBy("slot").collect()
    assert Counter(r["source_no"] for r in rows) == {0: 6000, 1: 2000, 2: 4000}
    first = Counter(r["source_no"] for r in rows[:600])
    assert all(abs(first[i] - n) <= 3 for i, n in enumerate((300, 100, 200)))
    ranks = defaultdict(list)
    for r in rows:
        ranks[r["source_no"]].append(r["block_no"])
    assert all(v == list(range(len(v))) for v in ranks.values())


def test_schedule_over_chunks(spark, monkeypatch):
    mix = [mixing.Source(str(i), 1, 10**9, w, 1000.0 * w) for i, w in enumerate((3, 1, 2))]
    whole = sorted(map(tuple, mixing.schedule(spark, mix, 10).collect()))
    monkeypatch.setattr(mixing, "CHUNK", 64)
    assert sorted(map(tuple, mixing.schedule(spark, mix, 10).collect())) == whole


# ---------------------------------------------------------------- HTML


def page(body, head="<title>t &amp; x</title>"):
    return f"<!DOCTYPE html><html><head>{head}<style>p{{}}</style><script>var a='</p><b>';</script></head><body>{body}</body></html>"


def test_main_text():
    frame = "<nav><ul><li><a href='/'>Home</a></li></ul></nav><div class='ad'>Buy <b>now</b></div><div class=\"cookie-notice\">We use cookies</div>"
    article = "<article><header><h1>Title &amp; more</h1></header><p>One <i>two</i>\n three&nbsp;&lt;b&gt;<br>four<p><b>Five.<div class='share'>Share</div><form>mail <input></form><ul><li>a<li>b</ul><aside>side</aside><section id=comments><p>a reader</p></section><!-- <p>no</p> --></article>"
    blocks = html_text.blocks_of(page(frame + article + "<footer>&copy; me</footer>"))
    assert html_text.main_text(blocks, []) == "Title & more\n\nOne two three <b> four\n\nFive.\n\na\n\nb"
    assert html_text.main_text(html_text.blocks_of(""), []) == "" and html_text.blocks_of("<p") == []
    assert html_text.main_text(html_text.blocks_of("<article><p>cut off &am"), []) == "cut off &am"
    assert html_text.main_text(html_text.blocks_of("<p title='is hidden here' class=x>Shown &#x41;&eacute;<script>no</script> <br/>text</p><p hidden>not<p><b>shown"), []) == "Shown Aé text\n\nshown"
    assert html_text.main_text(html_text.blocks_of("<div class='page with-sidebar'><p>Plain text of a page.</p><div class=sidebar>side</div></div>"), []) == "Plain text of a page."


def test_shared_substrings(spark):
    texts = [f"Unique story number {i} about thing {i * i} and more of it" for i in range(6)]
    body = lambda t, i: f"<div>Welcome to our lovely site today</div><div>{t}</div><p>All rights reserved by somebody or other, forever</p>"
    pages = [(i, f"https://{'www.' if i % 2 else ''}h{i // 3}.example.com/p/{i}?q=//x", body(t, i)) for i, t in enumerate(texts)]
    pages += [(10, None, None), (11, "", "<p>alone here in this place</p>"), (12, "https://other.org", body("One page of its host with the same frame", 0)), (0, pages[0][1], pages[0][2])]
    df = spark.createDataFrame([(i, u, h, "clash") for i, u, h in pages], "page_id long, url string, html string, text string")
    rows = html_text.extract_text(df).collect()
    got = defaultdict(list)
    for r in rows:
        got[r["page_id"]].append(r["text"])
        assert r["n_chars"] == len(r["text"])
    assert [got[i] for i in range(1, 6)] == [[t] for t in texts[1:]] and got[0] == [texts[0]] * 2
    assert got[10] == [""] and got[11] == ["alone here in this place"] and "Welcome" in got[12][0]
    assert html_text.extract_text(df.limit(0)).count() == 0
    copies = spark.createDataFrame([(i, "http://a.b/x", page(f"<nav>menu of the site here</nav><article><p>{'same words again ' * 20}</p></article>" + f"<i>{i}</i>")) for i in range(3)], "page_id long, url string, html string")
    assert {r["text"] for r in html_text.extract_text(copies).collect()} == {("same words again " * 20).strip()}


def test_unmarked_copies(spark):
    """Copies of an unmarked article keep its short paragraphs; what other pages of the host have as well goes."""
    frame = lambda t: f"<div>Welcome to our lovely site today</div>{t}<p>All rights reserved by somebody or other, forever and {'ever ' * 60}</p>"
    own = lambda i: f"Tale{i} of{i} other{i} things{i} entirely{i}"
    short = ["A heading of five words", "One short paragraph of the article here.", "Another short paragraph, a little longer than that one."]
    pages = [(i, "https://a.example.com/1", frame("".join(f"<p>{x}</p>" for x in short) + f"<i>{i}</i>")) for i in range(3)]
    pages += [(10 + i, "https://a.example.com/2", frame(f"<p>{own(i)}</p>")) for i in range(4)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_text.extract_text(df).collect()}
    assert all(all(x in got[i] for x in short) and "Welcome" not in got[i] and "reserved" not in got[i] for i in range(3))
    assert [got[10 + i] for i in range(4)] == [own(i) for i in range(4)]


def test_main_elements_and_names():
    text = lambda body: html_text.main_text(html_text.blocks_of(page(body)), [])
    for name in ("post tag-menu", "comments-open", "ad-free", "share-story", "article-related", "widget"):
        assert text(f"<article class='{name}'><p>The text.</p></article>") == "The text.", name
    for wrapper in ("<form action=x>", "<div class='one-sidebar'>", "<div id=header-2 class=menu>"):
        assert text(f"{wrapper}<p>frame</p><article><p>The text.</p><form><p>mail</p></form></article>") == "The text.", wrapper
    assert text("<article><p>The text.</p></article><section class=comments><article><p>a reader</p></article></section><aside><article>teaser</article></aside>") == "The text."
    assert text("<article><p>The text.</p><article class=comment>a reader</article><div class='related'><article>teaser</article></div></article>") == "The text."


def test_class_names_only_cast_doubt(spark):
    text = lambda body: html_text.main_text(html_text.blocks_of(page(body)), [])
    for name in ("share-price", "social-history", "widget-description"):
        assert text(f"<article><p>The text.</p><p class={name}>More.</p></article>") == "The text.\n\nMore.", name
    for name in ("search-algorithms", "related-work"):
        assert text(f"<article><p>The text.</p><section id={name}><p>More.</p><div class=share-buttons>Share</div></section></article>") == "The text.\n\nMore.", name
    for name in ("share", "share-buttons", "related-posts", "cookie-notice", "comments"):
        assert text(f"<article><p>The text.</p><div class={name}>No.</div></article>") == "The text.", name
    assert text("<article><p>Let <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>x=2</annotation></math> be.</article>") == "Let x=2 be."
    body = "A plain body of many words that no element marks, as old pages have it."
    assert text(f"<article>A teaser.</article><div>{body}</div><nav>menu</nav>") == f"A teaser.\n\n{body}"
    assert text("<article><p>The longer text is the article here.</p></article><div>Short.</div>") == "The longer text is the article here."
    # What pages of the host share decides: in doubt inside an article, and of plain text beside a teaser.
    ask = "Tell all of your friends about this site"
    rows = [(i, "http://a.b/", page(f"<article><p>Text {i} of {i} page {i}.</p><p class=share-story>{ask}</p><p class=share-price>It rose by {i} points on day {i}.</p></article>")) for i in range(3)]
    rows += [(10 + i, "http://c.d/", page(f"<article>Our best story</article><div>Welcome to the site that has all the stories</div><div>Body {i} has {i} words {i} or {i} more than {i} it {i}</div>")) for i in range(3)]
    got = {r["page_id"]: r["text"] for r in html_text.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [got[i] for i in range(3)] == [f"Text {i} of {i} page {i}.\n\nIt rose by {i} points on day {i}." for i in range(3)]
    assert [got[10 + i] for i in range(3)] == [f"Our best story\n\nBody {i} has {i} words {i} or {i} more than {i} it {i}" for i in range(3)]


def test_long_pages_take_linear_time():
    for body in ("<b>" * 100_000 + "x" + "</i>" * 100_000, "<p><div>" + "<b>" * 50_000 + "<div>y</div>" * 50_000, "<b>" * 50_000 + "<dt>a<li>b" * 50_000):
        began = time.process_time()
        assert html_text.blocks_of(f"<article>{body}</article>")
        assert time.process_time() - began < 5


def test_repeats_are_suffix_intervals(spark):
    """The places that are found are those of a suffix array with common prefixes, per host."""
    r = random.Random(12)
    runs = [" ".join(r.choice("abc") for _ in range(r.randint(2, 9))) for _ in range(8)]
    pages = [(i, f"http://h{i % 2}/", "".join(f"<p>{r.choice(runs)} {r.choice('xyzuvw')}{i} {r.choice(runs)}</p>" for _ in range(3))) for i in range(16)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    parsed = html_text.parsed_pages(df).cache()
    ids = {x["page"]: x["page_id"] for x in parsed.collect()}
    got = {ids[x["page"]]: x["repeated"] for x in html_text.repeated_places(parsed).collect()}
    expected = defaultdict(set)
    for host in range(2):
        streams = {i: html_text.stream_of(html_text.blocks_of(h)) for i, _, h in pages if i % 2 == host}
        order = sorted((s[at:], i, at) for i, s in streams.items() for at in range(len(s)))
        common = [next((k for k, (x, y) in enumerate(zip(a[0], b[0])) if x != y), min(len(a[0]), len(b[0]))) for a, b in zip(order, order[1:])]
        start = 0
        for n, shared in enumerate([*common, 0]):
            if shared < html_text.LONG:
                interval = order[start : n + 1]
                if len({i for _, i, _ in interval}) > 1:
                    for _, i, at in interval:
                        expected[i].add(at)
                start = n + 1
    assert got == {i: sorted(x) for i, x in expected.items()} and sum(map(len, got.values())) > 50


# ---------------------------------------------------------------- pipeline


def test_pipeline(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("no test tables")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "mixing", "token_output"]
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("extra", F.lit(1))
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    stages = dict(corpus_pipeline.STAGES)
    good = stages["quality"](spark, docs, sf)
    assert good.columns == docs.columns
    ids = {r["doc_id"] for r in good.select("doc_id").collect()}
    right = sum((i in ids) == bool(q) for i, q in labels.items())
    assert right / len(labels) > 0.9
    once = stages["near_duplicates"](spark, docs, sf).collect()
    fps = [brute_fingerprint(r["text"]) for r in once]
    assert not [1 for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3]
    bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    hit = brute_hits([(r["doc_id"], r["text"]) for r in docs.collect()], bench)
    clean = stages["decontamination"](spark, docs, sf)
    assert {r["doc_id"] for r in clean.collect()} == {v[0] for v in hit if not v[5]} and any(v[5] for v in hit)
    rows = corpus_pipeline.run(spark, sf).orderBy("start").collect()
    assert [r["start"] for r in rows] == np.cumsum([0, *(r["n_tokens"] for r in rows)])[:-1].tolist()
    assert {r["doc_id"] for r in rows} <= ids
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf).count() == 0
    odd = spark.createDataFrame([(1, None, None, None, None), (1, None, None, None, None), (None, "a b c", "en", "s", 5), (2, "", "en", "s", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    counts = {name: Counter(r["doc_id"] for r in stage(spark, odd, sf).collect()) for name, stage in corpus_pipeline.STAGES}
    assert counts["quality"][1] in (0, 2) and (counts["quality"][1] > 0) == (counts["quality"][2] > 0)  # a null text scores as an empty one
    assert counts["near_duplicates"] == {1: 1, None: 1} and counts["decontamination"] == counts["token_output"] == {1: 2, None: 1, 2: 1}
    assert counts["mixing"] == {None: 2}  # three words, of which four are taken
    clash = docs.limit(40).selectExpr("*", "1 spans", "2 dropped_at", "3 taken_words", "4 taken_part", "5 row", "6 size", "7 node", "8 class", "9 key", "10 fp", "11 found")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, clash, sf).columns == clash.columns, name
