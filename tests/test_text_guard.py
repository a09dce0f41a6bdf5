"""The text guard scores the whole table."""

import math

from pyspark.sql import functions as F

from ledgerlark.operators import models
from ledgerlark.plans import catalog

SMALL = "/root/testdata/sf0.001"


def test_every_document_is_scored_and_the_fitted_ones_are_marked(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    docs.union(docs.limit(1).withColumn("doc_id", F.lit(None).cast(docs.schema["doc_id"].dataType))).write.parquet(f"{tmp_path}/documents.parquet")
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    got = catalog.QUERIES["model_text_guard_scores"](spark, str(tmp_path)).collect()
    ids = [r["doc_id"] for r in docs.select("doc_id").collect()]
    assert sorted(r["doc_id"] for r in got if r["doc_id"] is not None) == sorted(ids) and len(got) == len(ids) + 1
    known, fitted = {r["doc_id"] for r in labels.collect()}, {r["doc_id"] for r in got if r["fitted"]}
    assert fitted and fitted < known and max(fitted) < max(ids) and all(r["score"] is not None for r in got)


def test_grams_have_slots_enough(spark):
    row = models.text_features(spark.createDataFrame([("some words of a text",)], "text string"), "text").first()
    assert row["_tf"].size >= 1 << 18


def test_grams_are_damped_without_python(spark, capsys):
    df = spark.createDataFrame([("ab ab ab c",), ("",), ("𠀀𠀁 x_é",)], "text string")
    rows = models.dampened(models.text_features(df, "text", keep_terms=True), "_tf")
    rows.explain()
    assert "EvalPython" not in capsys.readouterr().out
    terms = {r["text"]: sorted(r["_terms"]) for r in rows.collect()}
    assert terms[""] == []
    assert terms["ab ab ab c"] == sorted(["ab"] * 3 + ["c", "ab ab", "ab ab", "ab c", "# c "] + ["# ab"] * 3 + ["#ab "] * 3 + ["# ab "] * 3)
    assert terms["𠀀𠀁 x_é"] == sorted(["𠀀𠀁", "x_é", "𠀀𠀁 x_é", "# 𠀀𠀁", "#𠀀𠀁 ", "# 𠀀𠀁 ", "# x_", "#x_é", "#_é ", "# x_é", "#x_é ", "# x_é "])
    values = {r["text"]: sorted(set(r["_tf"].values.round(9))) for r in rows.collect()}
    assert values == {"": [], "ab ab ab c": [1.0, round(1 + math.log(2), 9), round(1 + math.log(3), 9)], "𠀀𠀁 x_é": [1.0]}


def test_a_phrasing_cuts_its_words_once(spark, capsys):
    words = [f"w{i % 700}" for i in range(20_000)]
    df = spark.createDataFrame([(" ".join(words),), (" ".join(words) + " end",), ("Two  words",), ("two words",)], "text string").select(models.phrasing(F.col("text")).alias("p"))
    df.explain()
    assert capsys.readouterr().out.count("split(") == 1
    long, same, short, folded = [r["p"] for r in df.collect()]
    assert long == same and short == folded != long


def test_no_table_holds_the_grams_of_texts(spark, monkeypatch):
    """the table of counts held every gram of every text as a string, and readers take 4,096 texts at a time."""
    seen = []
    monkeypatch.setattr(models, "dampened", lambda df, column, f=models.dampened: seen.append(df.columns) or f(df, column))
    rows = [(f"the {'bad' if i % 3 == 0 else 'good'} news of day {i % 5}", int(i % 3 == 0)) for i in range(60)]
    found = models.indicative_terms(spark.createDataFrame(rows, "text string, toxic int"), "text", "toxic", top=3).collect()
    assert seen == [["toxic", "_tf"]]
    assert {("pair", "bad news", True), ("word", "good", False)} <= {(r["kind"], r["term"], r["weight"] > 0) for r in found}


def test_a_holdout_counts_grams_once_for_all_groups(spark, monkeypatch):
    """every group's fit and score cut the same texts into grams again."""
    calls = []
    monkeypatch.setattr(models, "text_features", lambda *a, f=models.text_features: calls.append(1) or f(*a))
    rows = [(f"{'pay me now' if i % 2 else 'see you soon'} number {i}", i % 2, "ab"[i // 2 % 2]) for i in range(60)]
    found = models.group_holdout(spark.createDataFrame(rows, "text string, toxic int, lang string"), "text", "toxic", "lang", ["a", "b"]).collect()
    assert len(calls) == 1 and [(r["held_out"], r["positives"]) for r in found] == [("a", 15), ("b", 15)]
    assert all(r["recall"] == 1.0 for r in found)
