import random

import pytest

from ledgerlark.operators import models, relate


def test_pages_follow_each_other(spark):
    rows = spark.createDataFrame([(f"k{i:02d}", i) for i in range(25)], "id string, v long")
    seen, after = [], None
    while True:
        got = relate.page(rows, "id", 10, after).orderBy("id").collect()
        seen += [r["id"] for r in got]
        assert {r["total"] for r in got} == {25}
        after = got[-1]["next_cursor"]
        if after is None:
            break
        assert after == got[-1]["id"]
    assert seen == [f"k{i:02d}" for i in range(25)]
    assert relate.page(rows.where("false"), "id", 10).collect() == []
    with pytest.raises(KeyError):
        relate.decision_class("anything", 0.5)


def test_mined_rule_needs_both_conditions(spark):
    rng = random.Random(3)
    rows = [(1, 0.1, 10.0 + rng.random(), 10.0 + rng.random()) for _ in range(40)]
    # each condition alone also fires on legitimate payments, both together never do
    rows += [(0, 0.1, 11.0 if i % 2 else 0.0, 0.0 if i % 2 else 11.0) for i in range(400)]
    df = spark.createDataFrame(rows, "is_fraud long, score double, a double, b double")
    found = models.mine_rule(df, ["a", "b"], 0.5).orderBy("place").collect()
    assert [r["column"] for r in found] == ["a", "b"] or [r["column"] for r in found] == ["b", "a"]
    assert found[0]["accepted"] == 0 and found[1]["accepted"] == 1 and found[1]["noise"] == 0
    few = spark.createDataFrame(rows[:7] + rows[40:], df.schema)
    assert models.mine_rule(few, ["a", "b"], 0.5).count() == 0
    assert models.mine_rule(df.where("is_fraud = 0"), ["a", "b"], 0.5).count() == 0
