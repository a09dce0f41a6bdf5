import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlark.operators import causal

W = 100


def _rows(n, keys, seconds, hot=0.0, seed=1):
    r = random.Random(seed)
    out = []
    for i in range(n):
        key = "hot" if r.random() < hot else f"k{r.randrange(keys)}"
        out.append((i, key, f"p{r.randrange(5)}", 1_777_000_000 + r.randrange(seconds), r.randrange(1, 500)))
    return out


def _brute(rows):
    found = {}
    for i, k, p, t, v in rows:
        prior = [x for x in rows if x[1] == k and (x[3], x[0]) < (t, i)]
        win = [x for x in prior if x[3] >= t - W]
        prev = max(prior, key=lambda x: (x[3], x[0]))[4] if prior else None
        first = min([x[3] for x in prior] + [t])
        found[i] = (len(prior), sum(x[4] for x in prior), len(win), sum(x[4] for x in win), len({x[2] for x in win}), prev, first)
    return found


@pytest.mark.parametrize("keys,seconds,hot,block", [(7, 1000, 0.0, None), (3, 40, 0.5, None), (3, 40, 0.5, 3), (2, 250_000, 0.3, None)])
def test_history_equals_brute_force(spark, keys, seconds, hot, block):
    rows = _rows(250, keys, seconds, hot)
    df = spark.createDataFrame(rows, "seq long, k string, p string, ts_s long, v long").repartition(5)
    h = causal.entity_history(
        df, "k", sums=["v"], windows=[W], distinct={"p": [W]}, last=["v"], first_seen=True,
        block=F.shiftright("seq", block) if block else None)
    got = {r["seq"]: (r["n_before"], r["v_before"], r[f"n_{W}"], r[f"v_{W}"], r[f"uniq_p_{W}"], r["prev_v"], r["first_ts"]) for r in h.collect()}
    assert got == _brute(rows)


def test_same_second_rows_see_earlier_arrivals_only(spark):
    df = spark.createDataFrame([(i, "a", "x", 500, 10) for i in range(3)], "seq long, k string, p string, ts_s long, v long")
    h = causal.entity_history(df, "k", sums=["v"], windows=[W], distinct={"p": [W]})
    assert sorted((r["seq"], r[f"n_{W}"], r[f"uniq_p_{W}"]) for r in h.collect()) == [(0, 0, 0), (1, 1, 1), (2, 2, 1)]


def test_later_rows_change_nothing(spark):
    rows = sorted(_rows(200, 4, 800, seed=3), key=lambda x: (x[3], x[0]))
    make = lambda r: causal.entity_history(
        spark.createDataFrame(r, "seq long, k string, p string, ts_s long, v long"), "k", sums=["v"], windows=[W], distinct={"p": [W]})
    cut = rows[:120]
    part = {r["seq"]: r for r in make(cut).collect()}
    full = {r["seq"]: r for r in make(rows).collect()}
    assert all(part[s] == full[s] for s in part)


def test_empty_input(spark):
    df = spark.createDataFrame([], "seq long, k string, p string, ts_s long, v long")
    assert causal.entity_history(df, "k", sums=["v"], windows=[W], distinct={"p": [W]}).count() == 0


def test_cross_entity_window_is_strictly_earlier(spark):
    src = spark.createDataFrame([("a", 100, 5), ("a", 150, 7), ("a", 200, 9)], "k string, ts_s long, v long")
    q = spark.createDataFrame([("a", 200), ("a", 201), ("b", 200)], "q string, ts_s long")
    out = causal.cross_window_sum(src, "k", q, "q", value="v", window=W).collect()
    assert {(r["q"], r["ts_s"]): r["cross_sum"] for r in out} == {("a", 200): 12, ("a", 201): 16, ("b", 200): 0}


def test_windows_reach_across_stretches_and_partners_may_be_null(spark):
    r, w = random.Random(8), 6 * 86_400
    rows = [(i, r.choice(["hot", "hot", "k1", "k2", None]), r.choice(["p0", "p1", "p2", None]), 1_777_000_000 + 3_600 * r.randrange(24 * 70), r.random()) for i in range(500)]
    df = spark.createDataFrame(rows, "seq long, k string, p string, ts_s long, v double").repartition(7)
    h = causal.entity_history(df, "k", sums=["v"], windows=[3_600, w], distinct={"p": [w]}, last=["p", "v"], totals=["n"])
    assert "v_before" not in h.columns and h.count() == len(rows)
    for g in h.collect():
        if g["k"] is None:
            assert g["n_before"] is g[f"n_{w}"] is g[f"uniq_p_{w}"] is g["prev_v"] is None
            continue
        prior = sorted((x for x in rows if x[1] == g["k"] and (x[3], x[0]) < (g["ts_s"], g["seq"])), key=lambda x: (x[3], x[0]))
        inside = [x for x in prior if x[3] >= g["ts_s"] - w]
        assert (g["n_before"], g[f"n_{w}"], g["n_3600"]) == (len(prior), len(inside), sum(x[3] >= g["ts_s"] - 3_600 for x in prior))
        assert g[f"uniq_p_{w}"] == len({x[2] for x in inside} - {None}) and abs(g[f"v_{w}"] - sum(x[4] for x in inside)) < 1e-9
        assert (g["prev_p"], g["prev_v"]) == ((prior[-1][2], prior[-1][4]) if prior else (None, None))


def test_entities_cut_anywhere_by_batches_stay_whole(spark):
    rows = [(i, f"k{i // 900}", f"p{i % 7}", 1_777_000_000 + i % 900, 1) for i in range(2_700)]
    df = spark.createDataFrame(rows, "seq long, k string, p string, ts_s long, v long").coalesce(1)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")
    try:
        h = causal.entity_history(df, "k", sums=["v"], windows=[W], distinct={"p": [W]}).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert all((g["n_before"], g[f"v_{W}"], g[f"uniq_p_{W}"]) == (g["seq"] % 900, min(W, g["seq"] % 900), min(7, g["seq"] % 900)) for g in h)


def test_a_number_that_is_none_stays_with_its_key(spark):
    rows = [(1, "a", 100, float("nan")), (2, "a", 101, 1.0), (3, "b", 100, 2.0), (4, "b", 101, 1.0)]
    h = causal.entity_history(spark.createDataFrame(rows, "seq long, k string, ts_s long, v double"), "k", sums=["v"], windows=[W]).coalesce(1)
    got = {r["seq"]: r["v_before"] for r in h.collect()}
    assert got[2] != got[2] and (got[1], got[3], got[4]) == (0.0, 0.0, 2.0)


def test_windows_without_totals_shuffle_rows_once(spark):
    df = spark.range(100).selectExpr("id AS seq", "concat('k', id % 3) AS k", "concat('p', id % 5) AS p", "id AS ts_s", "id AS v")
    h = causal.entity_history(df, "k", sums=["v"], windows=[W], distinct={"p": [W]}, totals=[])
    assert h._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1


def test_whole_keys_and_keys_cut_into_stretches_answer_alike(spark, monkeypatch):
    """rows of small keys shuffled up to three times, as rows, as rows of the next stretch and as totals of their stretch."""
    rng = np.random.default_rng(8)
    n = 600
    rows = [(i, None if i % 50 == 3 else int(t) - 2_000_000, None if i % 40 == 1 else f"k{k}", f"p{p}", int(c), float(c) / 4)
            for i, (t, k, p, c) in enumerate(zip(rng.integers(0, 6_000_000, n), np.minimum(rng.geometric(0.2, n), 30), rng.integers(0, 6, n), rng.integers(0, 99, n)))]
    df = spark.createDataFrame(rows, "seq long, ts_s long, k string, p string, cents long, half double")

    def told(most, **more):
        monkeypatch.setattr(causal, "WHOLE_KEY", most)
        return sorted(map(tuple, causal.entity_history(df, more.pop("key", "k"), **more).collect()), key=lambda r: r[0])

    full = dict(sums=["cents", "half"], windows=[3600, 86400, 604800], distinct={"p": [86400, 604800]}, last=["ts_s", "p"], first_seen=True)
    for more in (full, dict(first_seen=True, key=["k", "p"]), dict(last=["cents"]), dict(sums=["cents"], windows=[86400], totals=[])):
        whole = told(1 << 16, **more)
        assert len(whole) == n and whole == told(40, **more) == told(-1, **more)


def test_small_keys_shuffle_once(spark):
    df = spark.range(100).selectExpr("id AS seq", "id * 86400 AS ts_s", "CAST(id % 5 AS STRING) AS k", "id AS cents")
    plan = causal.entity_history(df, "k", sums=["cents"], windows=[604800], first_seen=True)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Repartition") == 1 and "Aggregate" not in plan and "Window" not in plan and "Generate" not in plan
