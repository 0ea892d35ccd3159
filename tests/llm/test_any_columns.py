"""Stages and row-wise operators over columns of any kind: maps, maps in structs and arrays, variants; equal rows."""

import pytest

from labelloom.llm import decontaminate, line_dedup, mixing, near_copies, simhash

TEXTS = [(1, "one two three four five six seven eight nine ten eleven twelve"), (2, "one two three four five six seven eight nine ten eleven twelve"), (3, "a line of its own\nand one more line"), (3, "a line of its own\nand one more line"), (4, "and one more line\nsomething else is here now"), (None, None), (None, None), (5, "")]
KINDS = {
    "map": "map('k', n)",
    "struct_of_map": "named_struct('m', map('k', n), 'a.b', 1)",
    "array_of_map": "array(map('k', n), map('j', 0))",
    "variant": "parse_json(concat('{\"k\": ', n, '}'))",
}


@pytest.fixture(scope="module", params=sorted(KINDS))
def docs(request, spark):
    rows = spark.createDataFrame([(i, t, "s", 7 if i == 3 else k) for k, (i, t) in enumerate(TEXTS)], "doc_id long, text string, source string, n int")
    return rows.selectExpr("doc_id", "text", "source", f"{KINDS[request.param]} as extra", "n as odd_name")


def texts(df):
    return sorted((r["doc_id"] or 0, r["text"] or "") for r in df.collect())


def test_stages_keep_any_columns(spark, docs):
    bench = spark.createDataFrame([(1, "one two three four five six seven eight nine ten")], "item_id long, text string")
    kept = decontaminate.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns and [i for i, _ in texts(kept)] == [0, 0, 3, 3, 4, 5]
    for stage in (near_copies.keep_first_similar, simhash.keep_first):
        found = stage(docs)
        ids = [i for i, _ in texts(found)]
        assert found.columns == docs.columns and [i for i in ids if i in (1, 2, 3, 4)] == [1, 3, 4] and len(ids) == len(set(ids))
    cut = line_dedup.dedup_lines(docs)
    assert cut.columns == docs.columns and [t for i, t in texts(cut) if i in (3, 4)] == ["", "a line of its own\nand one more line", "something else is here now"]
    mixed = mixing.mixed_rows(docs)
    assert mixed.columns == docs.columns and mixed.count() > 0
