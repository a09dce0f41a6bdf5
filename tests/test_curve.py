import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlark.operators import audit, curve, evaluate
from ledgerlark.operators.ordered import exact_quantiles, value_levels


def _scored(spark, pairs):
    return spark.createDataFrame([(float(s), int(y), 100) for s, y in pairs], "score double, is_fraud int, cents int")


def test_levels_rise_with_the_value(spark):
    r = random.Random(2)
    xs = [0.0, -0.0, 1.0, 2.0, np.nextafter(2.0, 0), np.nextafter(1.0, 0), 1e-300, -1e300] + [r.uniform(-1, 1) * 10 ** r.randrange(-8, 9) for _ in range(2000)]
    high, low = value_levels(F.col("x"))
    rows = sorted(spark.createDataFrame([(float(x),) for x in xs], "x double").select("x", high.alias("a"), low.alias("b")).collect(), key=lambda q: q["x"])
    keys = [(q["a"], q["b"]) for q in rows]
    assert keys == sorted(keys)


def test_threshold_keeps_the_budget_under_heavy_ties(spark):
    pairs = [(0.0, 0)] * 900 + [(i / 100, 0) for i in range(1, 101)] + [(0.95, 1)] * 10
    p = curve.operating_points(curve.score_curve(_scored(spark, pairs)), [0.01]).first()
    assert p["fp"] <= 10 and p["cut"] == 0.9


def test_single_class_reads_chance_and_default_cut(spark):
    c = curve.score_curve(_scored(spark, [(0.1, 1), (0.2, 1)]))
    assert curve.roc_auc(c).first()["auc"] == 0.5
    assert curve.operating_points(c, [0.01]).first()["cut"] == 0.5


def test_constant_score_has_auc_half(spark):
    assert curve.roc_auc(curve.score_curve(_scored(spark, [(0.3, i % 2) for i in range(50)]))).first()["auc"] == 0.5


def test_quantiles_match_numpy(spark):
    r = random.Random(4)
    xs = [round(r.gauss(0, 50), 1) for _ in range(999)]
    probs = [0.0, 0.05, 0.5, 0.777, 0.99, 1.0]
    got = {q["p"]: q["q"] for q in exact_quantiles(spark.createDataFrame([(x,) for x in xs], "v double"), [], "v", probs).collect()}
    assert np.allclose([got[p] for p in probs], np.quantile(xs, probs))


def test_bootstrap_interval_covers_the_point(spark):
    r = random.Random(5)
    pairs = [(round(r.betavariate(4, 2), 3), 1) for _ in range(300)] + [(round(r.betavariate(2, 4), 3), 0) for _ in range(3000)]
    df = _scored(spark, pairs)
    point = curve.operating_points(curve.score_curve(df), [0.02]).first()
    found = {i["metric"]: i for i in curve.intervals(curve.bootstrap(df, ["score"], 0.02, 60)).collect()}
    assert set(found) == set(curve.METRICS) and all(i["lo95"] <= i["hi95"] and i["resamples"] == 60 for i in found.values())
    assert abs(found["recall"]["point"] - point["tp"] / point["p"]) < 1e-12 and found["recall"]["lo95"] <= found["recall"]["point"] <= found["recall"]["hi95"]


def test_the_same_ranking_differs_by_nothing(spark):
    r = random.Random(6)
    pairs = [(round(r.betavariate(4, 2), 3), 1) for _ in range(200)] + [(round(r.betavariate(2, 4), 3), 0) for _ in range(1500)]
    df = _scored(spark, pairs).withColumn("half", F.col("score") / 2)
    for d in curve.paired_difference(curve.bootstrap(df, ["score", "half"], 0.02, 25), "score", "half").collect():
        assert (d["difference"], d["lo95"], d["hi95"], d["p_two_sided"]) == (0.0, 0.0, 0.0, 1.0)


def test_poisson_draws_have_their_mean_and_spread():
    for n in (1, 2, 7, 30, 400, 100_000):
        d = curve.draws(12345 + n, n, 20_000, 7)
        assert d[0] == n and len(d) == 20_001 and (d == curve.draws(12345 + n, n, 20_000, 7)).all()
        assert abs(d[1:].mean() - n) < 5 * (n / 20000) ** 0.5 and abs(d[1:].var() / n - 1) < 0.06


def test_every_replica_is_what_its_counts_give(spark, monkeypatch):
    r = random.Random(9)
    rows = [(round(r.random(), 2), round(r.random(), 1), int(r.random() < 0.2), r.randrange(1, 5) * 100) for _ in range(700)]
    df = spark.createDataFrame(rows, "score double, other double, is_fraud int, cents long").repartition(3)
    monkeypatch.setattr(curve, "CELLS", 5)
    got = {(x["model"], x["rep"]): x for x in curve.bootstrap(df, ["score", "other"], 0.05, 6).collect()}
    cells = df.groupBy("score", "other", F.col("is_fraud").alias("label"), F.col("cents").alias("each")).count().withColumn("cell", F.xxhash64("score", "other", "label", "each")).collect()
    for rep in range(7):
        drawn = [(c["score"], c["other"], c["label"], c["each"], int(curve.draws(c["cell"], c["count"], 6, 7)[rep])) for c in cells]
        for k, model in enumerate(("score", "other")):
            many = spark.createDataFrame([(d[k], d[2], d[3]) for d in drawn for _ in range(d[4])], "score double, is_fraud int, cents long")
            c = curve.score_curve(many).cache()
            at, x = curve.operating_points(c, [0.05]).first(), got[model, rep]
            assert x["recall"] == pytest.approx(at["tp"] / at["p"]) and x["value_recall"] == pytest.approx(at["tp_cents"] / at["p_cents"])
            assert x["average_precision"] == pytest.approx(curve.average_precision(c).first()[0]) and x["roc_auc"] == pytest.approx(curve.roc_auc(c).first()[0])


def test_windows_of_one_class_or_none(spark):
    for pairs in ([(0.1, 1), (0.9, 1)], [(0.1, 0), (0.9, 0)], []):
        df = _scored(spark, pairs)
        c = curve.score_curve(df)
        assert curve.partial_auc(c).first()["partial_auc"] is None
        assert (curve.average_precision(c).first()["average_precision"] is None) == (not any(y for _, y in pairs))
        head = evaluate.headline(df, 0.5).first()
        assert head["rows"] == len(pairs) and (head["false_positive_rate"] is None) == (not any(y == 0 for _, y in pairs))
        assert len(curve.operating_curve(curve.operating_points(c)).collect()) in (0, len(curve.BUDGETS))


def test_a_null_group_is_a_group(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), (None, 5.0), (None, 9.0)], "g string, v double")
    assert {(r["g"], r["q"], r["n"]) for r in exact_quantiles(df, ["g"], "v", [0.5]).collect()} == {("a", 2.0, 2), (None, 7.0, 2)}
    sums = spark.createDataFrame([("a", 0.5, 1, 1), (None, 0.5, 1, 1), (None, 0.7, 0, 1)], "g string, score double, is_fraud int, cents int")
    assert {r["g"]: r["p"] + r["n"] for r in curve.operating_points(curve.score_curve(sums, ["g"]), [0.1], ["g"]).collect()} == {"a": 1, None: 2}


def test_deciles_of_one_tied_score(spark):
    df = spark.range(1003).select(F.col("id").cast("string").alias("txn_id"), (F.col("id") < 10).cast("double").alias("score"), (F.col("id") % 2).cast("int").alias("is_fraud"), F.lit(100).alias("cents"))
    got = curve.decile_lift(df, "score", "txn_id").orderBy("decile").collect()
    assert [d["rows"] for d in got] == [101] * 3 + [100] * 7 and sum(d["fraud"] for d in got) == 501


def test_planted_leaks_are_found(spark):
    r = random.Random(6)
    rows = [(int(i < 400), "RING1" if i < 60 else f"A{i}", "normal", 5.0 + i / 1e4 if i < 400 else r.uniform(0, 1)) for i in range(4000)]
    df = spark.createDataFrame(rows, "is_fraud int, payer string, kind string, leak double")
    found = {(a["column"], a["kind"]) for a in audit.find_artefacts(df, ["kind"], ["payer"], ["leak"]).collect()}
    assert ("leak", "band") in found and ("payer", "id prefix") in found and ("kind", "level") not in found
    assert evaluate.column_auc(df, ["leak"]).first()["auc"] == 1.0


def test_draws_of_many_cells_are_those_of_each():
    cells, k = np.arange(-40, 160, dtype=np.int64) * 0x1234567, np.arange(200) % 12 + 1
    many = curve.draw_all(cells, k, 501, 7)
    assert all((many[i] == curve.draws(int(cells[i]), int(k[i]), 501, 7)).all() for i in range(200))
    ones = curve.draw_all(np.arange(4000, dtype=np.int64), np.ones(4000, np.int64), 500, 3)[:, 1:]
    share = np.bincount(ones.astype(int).ravel(), minlength=6)[:6] / ones.size
    assert np.abs(share - np.array([1, 1, 1 / 2, 1 / 6, 1 / 24, 1 / 120]) / np.e).max() < 1e-3
    assert abs(np.corrcoef(ones[:, 0], ones[:, 1])[0, 1]) < 0.06 and abs(np.corrcoef(ones[0], ones[1])[0, 1]) < 0.2


def test_kept_sums_tell_the_same_as_drawing_twice(spark, monkeypatch):
    r = random.Random(12)
    df = spark.createDataFrame([(round(r.random(), 1), int(r.random() < 0.2), r.randrange(1, 999)) for _ in range(900)], "score double, is_fraud int, cents long").repartition(3)
    found = []
    for few in (10**9, 1):
        monkeypatch.setattr(curve, "KEPT_CELLS", few)
        found.append(sorted(curve.bootstrap(df, ["score"], 0.05, 20).collect(), key=lambda x: x["rep"]))
    assert len(found[0]) == 21 and all(a[i] == pytest.approx(b[i]) for a, b in zip(*found, strict=True) for i in range(2, 7))


def test_ranges_change_no_bit_of_a_replica(spark):
    r = random.Random(13)
    pairs = [(round(r.betavariate(4, 2), 3), 1) for _ in range(200)] + [(round(r.betavariate(2, 4), 3), 0) for _ in range(1500)]
    df, found, parts = _scored(spark, pairs), [], spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in ("1", "7"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            found.append(sorted(tuple(x) for x in curve.bootstrap(df, ["score"], 0.02, 40).collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
    assert found[0] == found[1]


def test_quantiles_read_the_order_once_and_meet_few_ranks(spark):
    rng = np.random.default_rng(4)
    values = {"a": np.round(rng.gamma(2, 3, 4000), 2), "b": np.where(rng.random(3000) < 0.9, 1.0, rng.normal(size=3000)), None: np.array([5.0])}
    rows = [(g, float(v)) for g, vs in values.items() for v in vs]
    probs = [0.0, *(i / 150 for i in range(1, 150)), 1.0, 0.5]
    for column in ("g", "column"):  # groups of data, and those that the code names
        found = exact_quantiles(spark.createDataFrame(rows, f"{column} string, v double"), [column], "v", probs)
        assert found._jdf.queryExecution().optimizedPlan().toString().count("explode(filter(") == 1
        told = [(r[column], r["p"], r["q"], r["n"]) for r in found.collect()]
        assert len(told) == len(probs) * len(values)
        for g, p, q, n in told:
            assert n == len(values[g]) and q == pytest.approx(np.quantile(values[g], p), abs=1e-9)


def test_quantiles_of_columns_are_those_of_long_rows(spark, monkeypatch):
    """Quantiles of every column made a row of every value first."""
    from ledgerlark.operators import ordered

    df = spark.range(500).selectExpr("id % 7 AS a", "IF(id % 3 = 0, NULL, id * 37 % 101 / 8.0D) AS b", "CASE WHEN id % 5 = 0 THEN CAST('NaN' AS DOUBLE) WHEN id % 2 = 0 THEN -0.0D ELSE 0.0D END AS c", "CAST(NULL AS DOUBLE) AS d")
    names, probs = ["a", "b", "c", "d"], [0.0, 0.1, 0.5, 0.77, 1.0]
    monkeypatch.setattr(ordered, "COUNTED_ROWS", 64)
    told = lambda rows: {(r["column"], r["p"]): (r["q"], r["n"]) for r in rows.collect()}
    got = told(ordered.column_quantiles(df, names, probs))
    assert got == told(ordered.exact_quantiles(evaluate.long_numeric(df, names, []), ["column"], "value", probs)) and len(got) == 15
