"""The stages' decisions take effect, each on its own input."""

from __future__ import annotations

import random

import corpus_pipeline
from ledgerlark.llm import queries

from .cases import prose


def test_queries_are_registered():
    import __spark_entry__

    names = set(__spark_entry__.queries())
    assert set(queries.QUERIES) <= names and "pipeline" in names and [n for k in range(1, 11) for n in names if n.startswith(f"op{k}_")].__len__() == 10


def test_run(spark, tmp_path):
    rng = random.Random(1)
    item = prose(rng, 30, 9000)
    passage = prose(rng, 60, 9000)
    clean = {i: prose(rng, 120, 9000) for i in range(12)}
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in clean.items()]
    rows += [(50, clean[3].upper(), "en", "s0", 1), (51, "too short", "en", "s0", 1), (52, "spam " * 200, "en", "s1", 1), (53, None, None, None, None)]
    rows += [(60 + k, f"{prose(rng, 80, 9000)} {passage} {prose(rng, 20, 9000)}", "de", "s1", 1) for k in range(3)]
    rows += [(70, f"{prose(rng, 70, 9000)} {item} {prose(rng, 10, 9000)}", "en", "s2", 1), (5, clean[5], "en", "s2", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, ids = docs.columns, lambda df: sorted(r["doc_id"] for r in df.collect())
    left = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == columns
        left.append(ids(docs))
    good = [*range(12), 60, 61, 62]
    assert left[0] == sorted([*good, 5, 50, 70]) and left[1] == [*good, 70] == left[2] and left[3] == good
    texts = {r["doc_id"]: r for r in docs.collect()}
    assert passage in texts[60]["text"] and not any(passage in texts[k]["text"] or texts[k]["n_chars"] != len(texts[k]["text"]) for k in (61, 62))
    assert all(texts[i]["text"] == t for i, t in clean.items())
    mixed = corpus_pipeline.run(spark, str(tmp_path))
    assert ids(mixed) == good and sum(r["taken"] for r in mixed.collect()) > 0
