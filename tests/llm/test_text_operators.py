"""Media, token counts, quality, licenses, token files: against plain Python; edge cases of each."""

import hashlib
import io
import math
import random
import re
import struct
import zipfile
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from labelloom.llm import licenses, media, quality, token_counts, token_output
from labelloom.llm.queries import QUERIES

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, key int"
LONG = "word " * 60_000 + "Release, Été 12!\t\tx  y\n\n z"
TEXTS = [(1, "Hello, wörld\nIt's 12 o'clock"), (2, None), (3, ""), (4, LONG), (5, "same"), (5, "same"), (6, "same"), (None, "no id"), (7, " \t\n"), (8, "<|endoftext|> a b　c")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en", "s", 1, "x", 0) for i, t in TEXTS], DOCS)


# ---------------------------------------------------------------- media


def samples():
    wav = media.to_wav(b"abc")
    chunk = lambda n, d: struct.pack(">I", len(d)) + n + d + struct.pack(">I", zlib.crc32(n + d))
    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0\0")) + chunk(b"IEND", b"")
    gif = b"GIF89a" + struct.pack("<HHBBB", 1, 1, 0, 0, 0) + b"\x2c" + bytes(8) + b"\0" + b"\x02\x02\x44\x01\x00" + b"\x3b"
    bmp = b"BM" + struct.pack("<IIIIiiHHIIiiII", 58, 0, 54, 40, 1, 1, 1, 24, 0, 4, 0, 0, 0, 0) + b"\1\2\3\0"
    jpeg = b"\xff\xd8\xff\xe0\0\x04ab\xff\xda\0\x04ab\x11\xff\0\x22\xff\xd9"
    pdf = b"%PDF-1.4\n1 0 obj\nendobj\nxref\nstartxref\n9\n%%EOF"
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("a.txt", "hello")
    made = zlib.compressobj(wbits=31)
    return {"wav": wav, "png": png, "gif": gif, "bmp": bmp, "jpeg": jpeg, "pdf": pdf, "zip": buffer.getvalue(), "gzip": made.compress(b"x" * 100) + made.flush()}


def test_sniff():
    for kind, data in samples().items():
        assert media.sniff(data) == (kind, len(data), []), kind
        assert media.sniff(b"junk" + data + b"tail")[2] == [(kind, 4, len(data))], kind
        cut = data[: len(data) * 2 // 3]
        assert media.sniff(cut)[1] == 0 and media.sniff(b"junk" + cut)[2] == [], kind
    assert media.sniff(b"") == media.sniff(None) == ("empty", 0, []) and media.sniff(b"RIFF and BM and PK\x03\x04")[0] == "text" and media.sniff(b"\xff\xfe\xfd")[0] == "unknown"
    assert [k for k, *_ in media.sniff(b"".join(samples().values()))[2]] == list(samples())[1:]


def test_many_headers_are_linear():
    """Hits and end records by the ten thousand: what they share is found once."""
    import time

    local, end = b"PK\x03\x04", b"PK\x05\x06" + bytes(18)
    values = [(local + b"x" * 16 + end) * 20_000, (b"GIF89a" + bytes(7) + b"!!\x01x") * 40_000, b"\xff\xd8\xff\xe0\0\x04ab" * 40_000]
    began = time.process_time()
    assert [media.sniff(x)[1:] for x in values] == [(0, [])] * 3
    assert time.process_time() - began < 20
    data = samples()
    assert [k for k, *_ in media.sniff(b"junk" + end + data["zip"] + b"GIF89a" + bytes(7) + b"!\x01\x01" + data["gif"] + b"\xff\xd8\xff\xe0\0\0" + data["jpeg"])[2]] == ["zip", "gif", "jpeg"]


def test_sniff_and_carve(spark):
    data = samples()
    df = spark.createDataFrame([(1, data["png"], "jpeg"), (2, b"ab" + data["gif"] + data["wav"], None), (3, None, "png"), (4, data["png"], "png")], "k int, data binary, said string")
    rows = {r["k"]: r["sniffed"] for r in media.sniff_media(df, "k", "data", "said").collect()}
    assert rows[1]["type"] == "png" and rows[1]["corrected"] and rows[1]["valid"] and not rows[4]["corrected"]
    assert [c["type"] for c in rows[2]["carved"]] == ["gif", "wav"] and not rows[2]["corrected"] and rows[3]["type"] == "empty"
    carved = media.carve_media(df, "k", "data").collect()
    assert [(r["k"], r["type"], bytes(r["bytes"])) for r in carved] == [(2, "gif", data["gif"]), (2, "wav", data["wav"])]
    assert media.sniff_media(df.limit(0), "k", "data").count() == 0


def test_media_columns(docs):
    rows = media.media_columns(docs).collect()
    assert len(rows) == len(TEXTS)
    given = sorted(TEXTS, key=lambda x: (x[0] or 0, x[1] or ""))
    for r, (i, text) in zip(sorted(rows, key=lambda r: (r["doc_id"] or 0, r["n_bytes"])), sorted(given, key=lambda x: (x[0] or 0, len((x[1] or "").encode())))):
        raw = (text or "").encode()
        payload = raw + b" " * (max(192, math.ceil(len(raw) / 192) * 192) - len(raw))
        stored = media.to_wav(payload)
        assert (r["doc_id"], r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (i, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert (r["media_bytes"], r["media_sha256"]) == (len(stored), hashlib.sha256(stored).hexdigest()) and media.wav_samples(stored) == payload
        x = np.frombuffer(payload, np.uint8).astype(int) - 128
        crossings = sum((a >= 0) != (b >= 0) for a, b in zip(x, x[1:]))
        assert r["feature"] == f"wav;n={len(x)};mean={x.mean():.4f};rms={math.sqrt((x * x).mean()):.4f};peak={abs(x).max()};crossings={crossings};carved=0"
        assert (r["declared"], r["media_type"], r["corrected"]) == ("text", "wav", True)
    assert len({r["feature"] for r in rows if r["n_bytes"] == 4}) == 1 and media.media_columns(docs.limit(0)).count() == 0


# ---------------------------------------------------------------- token counts


def brute_count(pieces, unknown, token):
    text, best = token_counts.MARK + token, [(0.0, 0)]
    longest = max(map(len, pieces))
    for end in range(1, len(text) + 1):
        options = [(best[s][0] + pieces[text[s:end]], -s, best[s][1] + 1) for s in range(max(0, end - longest), end) if text[s:end] in pieces]
        if text[end - 1] not in pieces:
            n = len(text[end - 1].encode())
            options.append((best[end - 1][0] + unknown * n, -(end - 1), best[end - 1][1] + n))
        top = max(x[0] for x in options)
        best.append(next((x[0], x[2]) for x in sorted(options, key=lambda x: -x[1]) if x[0] == top))
    return best[-1][1]


def test_token_counts(docs):
    import public_tokenizers

    pieces = token_counts.vocabulary(public_tokenizers.path(token_counts.VOCABULARY))
    counter = token_counts.Counter(pieces)
    r = random.Random(2)
    words = ["".join(r.choice("aethinorsé中▁Z9") for _ in range(r.randint(1, 9))) for _ in range(400)] + ["the", "there", "therefore", "a" * 50]
    assert counter.walk(set(words)) == {w: brute_count(pieces, counter.trie.unknown, w) for w in set(words)}
    long = ["".join(r.choice("aethinorsé中") for _ in range(n)) for n in (token_counts.SHARED - 1, token_counts.SHARED, 5_000)] + ["the" * 2_000]
    assert counter.walk(set(long)) == {w: brute_count(pieces, counter.trie.unknown, w) for w in long}
    nodes = len(counter.trie.states)
    assert counter.count(["ae" * 200_000 + " a", "the"])[0][0] == 2 and len(counter.trie.states) <= nodes + token_counts.SHARED + 5
    assert max(map(len, counter.counts)) <= token_counts.SHARED
    rows = token_counts.token_counts(docs).collect()
    assert len(rows) == len(TEXTS)
    by = {r["doc_id"]: r for r in rows}
    assert by[2]["n_tokens"] == by[3]["n_tokens"] == by[7]["n_tokens"] == 0 and by[5]["n_tokens"] == by[6]["n_tokens"] > 0
    assert by[4]["n_pretokens"] == len(LONG.split()) and by[4]["n_tokens"] == sum(brute_count(pieces, counter.trie.unknown, w) * n for w, n in [("word", 60_000), *((w, 1) for w in LONG.split() if w != "word")])
    assert token_counts.token_counts(docs.limit(0)).count() == 0


# ---------------------------------------------------------------- quality


def test_isotonic():
    x, y = quality.isotonic(np.array([0.0, 1, 2, 3]), np.array([1, 1, 2, 1]), np.array([0, 1, 0, 1]))
    assert x.tolist() == [0, 5 / 3, 3] and y.tolist() == pytest.approx([0, 1 / 3, 1])


def brute_isotonic(y, n):
    """The least-squares increasing fit, by the largest mean of any run up to a place and the smallest from it on."""
    mean = lambda i, j: sum(a * b for a, b in zip(y[i : j + 1], n[i : j + 1])) / sum(n[i : j + 1])
    return [max(min(mean(i, j) for j in range(k, len(y))) for i in range(k + 1)) for k in range(len(y))]


def test_quality(spark, docs):
    r = random.Random(1)
    good = lambda: " ".join("".join(r.choice("aeinrst") for _ in range(5)) for _ in range(60)) + "."
    bad = lambda: " ".join("".join(r.choice("AEINRST!") for _ in range(5)) for _ in range(60)) + "!!!"
    data = [(i, good() if i % 4 else bad(), i % 4 > 0) for i in range(600)]
    df = spark.createDataFrame([(i, t) for i, t, _ in data], "doc_id long, text string").unionByName(docs.select("doc_id", "text").where("doc_id is null or doc_id > 0").withColumn("doc_id", F.col("doc_id") + 1000))
    labels = spark.createDataFrame([(i, int(q)) for i, _, q in data] + [(None, 1), (3, None), (3, 7)], "doc_id long, quality int")
    rows = quality.quality_scores(df, labels).collect()
    assert len(rows) == 610
    stats, known = quality.text_statistics(df), labels.select("doc_id", F.col("quality").alias("label"))
    model = quality.fit(stats, known)
    each = stats.join(known.where("label in (0, 1)"), "doc_id").collect()  # the same by a plain solve of all rows
    z = model.cosines(np.array([x["stats"] for x in each])) / quality.WHOLE
    y = np.array([x["label"] for x in each])
    weights = np.linalg.solve(z.T @ z + quality.RIDGE * len(y) * np.eye(z.shape[1]), z.T @ y)
    assert np.allclose(weights, model.weights, atol=1e-6)
    bins = quality.grid(z @ weights)
    means = {b: y[bins == b].mean() for b in np.unique(bins)}
    fitted = dict(zip(sorted(means), brute_isotonic([means[b] for b in sorted(means)], [(bins == b).sum() for b in sorted(means)])))
    at = np.interp(np.array(sorted(fitted)) / quality.GRID, model.knots, model.values)
    assert np.allclose([at[list(sorted(fitted)).index(b)] for b in (min(fitted), max(fitted))], [fitted[min(fitted)], fitted[max(fitted)]], atol=1e-6)
    for x in rows:
        assert 0 <= x["score"] <= 1 and x["predicted"] == int(x["score"] >= 0.3)
        assert x["held_out"] == (x["doc_id"] is not None and zlib.crc32(str(x["doc_id"]).encode()) % 5 == 0)
    truth = {i: q for i, _, q in data}
    held = [x for x in rows if x["held_out"] and x["doc_id"] is not None and x["doc_id"] < 600]
    assert len(held) > 80 and sum((x["score"] > 0.5) == truth[x["doc_id"]] for x in held) / len(held) > 0.97
    again = {x["doc_id"]: x["score"] for x in quality.quality_scores(df.repartition(7), labels).collect()}
    assert all(again[x["doc_id"]] == x["score"] for x in rows if x["doc_id"] not in (1005,))
    kept = quality.keep_good(df.withColumn("score", F.lit("mine")), quality.fit(quality.text_statistics(df), labels.withColumnRenamed("quality", "label")))
    assert kept.columns == ["doc_id", "text", "score"] and {x["doc_id"] for x in kept.where("doc_id < 600").collect()} == {i for i, q in truth.items() if q}
    assert {x["score"] for x in quality.quality_scores(docs, labels.limit(0)).collect()} == {0.5}
    assert quality.quality_scores(docs.limit(0), labels).count() == 0
    ones = quality.quality_scores(df, labels.where("quality = 1")).collect()
    assert len(ones) == 610 and all(0 <= x["score"] <= 1 for x in ones)


# ---------------------------------------------------------------- licenses


def test_templates():
    a = licenses.Automaton({"x": "permission [[is [[hereby]] granted]] to {{2}} use", "p": "cc by"})
    for text, ok in (("permission to use", 1), ("permission is granted to use", 1), ("permission is hereby granted to any one use", 1), ("permission is hereby to use", 0), ("permission to a b c use", 0), ("permission to", 0), ("we give permission to all use now", 1)):
        assert len(a.places(text.encode().split())) == ok, text
    assert a.places(b"cc by cc by".split()) == [("p", 0, 2), ("p", 2, 4)]
    text = licenses.TEXTS["mit-text"].replace("[[including the next paragraph]] ", "").replace("{{8}}", "the authors or copyright holders")
    whole = licenses.Automaton(licenses.default_templates())
    assert [x[0] for x in whole.places(f"copyright me {text}".encode().split())] == ["mit-text"]
    assert whole.places(text.replace("express or implied", "express").encode().split()) == []
    with pytest.raises(ValueError):
        licenses.Automaton({"x": "{{1}} a"})


def test_whole_licenses():
    found = lambda text: sorted({x for x, *_ in licenses.Automaton(licenses.default_templates()).places(licenses.words_of(text.encode()))})
    plain = lambda name: re.sub(r"\[\[.*?\]\]", "", re.sub(r"\{\{\d+\}\}", "some holders", licenses.TEXTS[name]))
    for name in licenses.TEXTS:
        assert name in found(plain(name)) and name not in found(plain(name)[: -len("damage") - 40]), name
    assert found(plain("bsd-3-clause-text")) == ["bsd-3-clause-text"] and found(plain("bsd-2-clause-text")) == ["bsd-2-clause-text"]
    header = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    assert found(header) == ["gpl", "gpl-3.0-header"]


def test_license_scan(spark, monkeypatch):
    texts = {1: "Released under the MIT License.", 2: None, 3: "", 4: "Apache  LICENSE, apache-license; CC BY-NC 4.0", 5: "x " * 50_000 + "GNU General Public License", 6: "mit lizenz", 7: "licensed under the terms of the GNU general public license, either version 3 or later"}
    df = spark.createDataFrame([(i, t, "clash") for i, t in texts.items()] + [(1, texts[1], "clash")], "doc_id long, text string, places string")
    import labelloom.llm.licenses as module

    monkeypatch.setattr(module, "table", lambda *a: df)
    rows = module.op8_license_scan(spark, "")
    got = {r["doc_id"]: (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"], r["labels"]) for r in rows.collect()}
    assert rows.count() == 8
    assert got[1] == (5, 1, 3, 3, "mit", "mit,mit-notice") and got[2] == got[3] == (0, 0, None, None, "", "")
    assert got[4] == (9, 3, 0, 4, "apache,cc-by", "apache,cc-by") and got[5] == (50_004, 1, 50_000, 50_000, "gpl", "gpl") and got[6][1] == 0
    assert got[7][4:] == ("gpl", "gpl,gpl-3.0-notice")
    assert all(0 <= r["score"] <= 1 for r in rows.collect()) and licenses.scan_licenses(df.limit(0)).count() == 0


# ---------------------------------------------------------------- token files


def test_blocks():
    r = np.random.default_rng(0)
    for n in (0, 1, 1023, 1024, 5000, 600_000):
        ids = r.integers(0, 50257, n).astype("<u4")
        ids[: n // 3] = 7
        if n:
            ids[-1] = 2**32 - 1
        back, doc_ids, lengths = token_output.decode_file(data := token_output.encode_file(ids, [None, -5], [n, 0]))
        assert (back == ids).all() and doc_ids == [None, -5] and lengths.tolist() == [n, 0]
        with pytest.raises(ValueError):
            token_output.decode_file(data[:-5] + b"12345")
    for width in (0, 1, 7, 16, 31, 32):
        x = r.integers(0, 2**width, (3, token_output.BLOCK), dtype=np.uint64).astype(np.uint32)
        assert (token_output.unpack(token_output.pack(x, width), width) == x).all()
    narrow = token_output.encode_file(np.array([10] * 1000 + [40_000] * 24, np.uint32), [1], [1024])
    assert len(narrow) < 400  # the outliers are exceptions


def test_token_files(docs):
    from tokenizers import Tokenizer

    encoder = Tokenizer.from_file(token_output.default_tokenizer())
    expected, start = [], 0
    for i, text in sorted(TEXTS, key=lambda x: (x[0] is not None, x[0] or 0, x[1] or "")):
        ids = encoder.encode(text or "", add_special_tokens=False).ids + [2]
        expected.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    rows = token_output.token_output(docs).collect()
    assert sorted((tuple(r)[:4] for r in rows), key=lambda r: r[1]) == expected
    assert token_output.token_output(docs.limit(0)).count() == 0


def test_ids_over_all_white_space():
    """100,000 texts of all kinds of white space, marks and scripts, against the library."""
    r = random.Random(11)
    pieces = token_output.Pieces(token_output.default_tokenizer(), added=True)
    spaces = [" ", " ", " ", "\n", "\n\n", "\t", "\r\n", "\v", "\f", "\x1c", "\x1f", "\x85", "\xa0", "\u1680", "\u180e", "\u2003", "\u200b", "\u2028", "\u202f", "\u3000", "  ", "\ufeff"]
    others = ["one", "é", "一段", "二", "ü'll", "'s", "don't", "12", "½", "٣", "x1", "!", "...", "«", "—", "_", "😀", "e\u0301", "ſ", "<|endoftext|>", "Русский", "كتاب", "a-b", "_x", "\x00"]
    texts = ["一段\n\n　二　三", "é one\n\n\ttwo\tthree", *("".join(r.choice(spaces if r.random() < 0.45 else others) for _ in range(r.randint(1, 9))) for _ in range(100_000))]
    expected = pieces.whole.encode_batch(texts, add_special_tokens=False)
    wrong = [x for x, e in zip(texts, expected) if np.frombuffer(pieces.encode(x), "<u4").tolist() != e.ids]
    assert not wrong, wrong[:3]


def test_added_tokens(spark, monkeypatch):
    from tokenizers import Tokenizer

    encoder = Tokenizer.from_file(token_output.default_tokenizer())  # as it comes
    texts = ["a<|endoftext|>b", "<|endoftext|>", "two words <|endoftext|> and\nmore<|endoftext|>", "é <|endoftext|>\n\n x", "<|endoftext| >", "plain"]
    ids = [encoder.encode(x, add_special_tokens=False).ids for x in texts]
    assert ids[0] == [64, 50256, 65]
    pieces = token_output.Pieces(token_output.default_tokenizer(), added=True)
    assert [np.frombuffer(pieces.encode(x), "<u4").tolist() for x in texts] == ids
    monkeypatch.setattr(token_output, "table", lambda *a: spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    rows = token_output.op10_token_output(spark, "").orderBy("doc_id").collect()
    assert [(r["start"], r["n_tokens"], r["ids_crc32"]) for r in rows] == [(sum(len(y) + 1 for y in ids[:i]), len(x) + 1, zlib.crc32(np.array([*x, 2], "<u4").tobytes())) for i, x in enumerate(ids)]


@pytest.mark.parametrize("scheme", ["file://", "file:", ""])
def test_small_files(spark, docs, tmp_path, scheme):
    folder = f"{scheme}{tmp_path}/files"
    manifest = token_output.write_token_files(docs, folder, file_tokens=10)
    assert manifest.count() > 3 and manifest.agg(F.sum("n_docs")).first()[0] == len(TEXTS)
    rows = token_output.read_token_files(spark, folder, manifest).orderBy("start").collect()
    assert [r["start"] for r in rows] == np.cumsum([0, *(r["n_tokens"] for r in rows[:-1])]).tolist()


def test_registered():
    assert sorted(QUERIES, key=lambda n: int(n[2:].split("_")[0])) == [next(q for q in QUERIES if q.startswith(f"op{n}_")) for n in range(1, 14)]
