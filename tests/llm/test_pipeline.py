"""The stages on planted cases, and the whole run."""

import numpy as np
import pytest

import corpus_pipeline as p

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def test_stages_keep_columns_and_clean_documents(spark, docs, sf):
    bench = spark.read.parquet(f"{sf}/benchmark.parquet").first()["text"]
    plant = [(70_000, bench, "en", "s", 1), (70_001, "unlike any other " + " ".join(f"w{i}" for i in range(80)), "en", "s", 1)]
    plant += [(70_010 + i, "copied text " + " ".join(f"c{k}" for k in range(60)), "en", "s", 1) for i in range(3)]
    rows = docs.union(spark.createDataFrame(plant, docs.schema))
    near = p.drop_near_duplicates(spark, rows, sf)
    assert near.columns == COLUMNS
    left = {r["doc_id"] for r in near.collect()}
    assert {70_010} == left & {70_010, 70_011, 70_012} and {70_000, 70_001} <= left
    clean = p.drop_contaminated(spark, rows, sf)
    left = {r["doc_id"] for r in clean.collect()}
    assert clean.columns == COLUMNS and 70_000 not in left and {70_001, 70_010, 70_011} <= left
    cut = {r["doc_id"]: r for r in p.cut_repeats(spark, rows, sf).collect()}
    assert len(cut) == rows.count() and cut[70_010]["text"] and cut[70_011]["text"] == "" and cut[70_001]["n_chars"] == len(plant[1][1])


EXTRA = "doc_id long, text string, lang string, source string, n_chars int, n_hit int, spans string, score double, n_runs int, n_removed_words int, items string, key string, count int"


def test_stages_pass_clashing_columns_nulls_and_repeats(spark, sf):
    other = (5, "s", 0.25, 3, 4, "i", "k", 9)
    texts = [(1, None), (2, ""), (3, "one text of its own here"), (3, "one text of its own here"), (None, "a text without an id"), (4, "w " * 30_000)]
    rows = spark.createDataFrame([(i, t, "en", "s", len(t or ""), *other) for i, t in texts], EXTRA)
    for name, stage in p.STAGES[:-1]:
        for d in (rows, rows.limit(0)):
            done = stage(spark, d, sf)
            assert done.columns == rows.columns, name
            got = done.collect()
            assert all(tuple(r)[5:] == other for r in got), name
            assert len(got) == (0 if d is not rows else 4 if name == "near_dedup" else 6), name
    assert p.pack(spark, rows, sf).count() >= 6 and p.pack(spark, rows.limit(0), sf).count() == 0


def test_run(spark, sf, docs):
    pieces = p.run(spark, sf).toPandas()
    assert len(p.STAGES) == 5 and set(pieces.doc_id) <= {r["doc_id"] for r in docs.select("doc_id").collect()}
    ends = pieces.groupby("doc_id").agg(n=("length", "sum"), t=("doc_tokens", "first"))
    assert np.array_equal(ends.n, ends.t)
    assert pieces.groupby("sequence_id").length.sum().max() <= 1024
