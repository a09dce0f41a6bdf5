import random

import pytest
from pyspark.sql import functions as F

from ledgerlark.operators import causal, catalogue, incremental
from ledgerlark.sources import io
from ledgerlark.streaming import stateful


def test_alert_upsert_is_idempotent_and_cases_keep_the_last_event(spark, tmp_path):
    path, cases = str(tmp_path / "alerts"), str(tmp_path / "cases")
    df = spark.createDataFrame([("1", 0.5, ["a", "b"])], "txn_id string, score double, reasons array<string>")
    for _ in range(2):
        io.record_alerts(df, path, "r1", ["txn_id", "score", "reasons", "rail"])
    io.record_alerts(df, path, "r2", ["txn_id", "score", "reasons", "rail"])
    rows = spark.read.parquet(path).collect()
    assert sorted((r["run_id"], r["reasons"], r["rail"]) for r in rows) == [("r1", "a, b", None), ("r2", "a, b", None)]
    io.record_case(spark, cases, "r1", "1", "open", "", "", 1)
    io.record_case(spark, cases, "r1", "1", "closed", "fraud", "", 2)
    assert [r["status"] for r in io.read_cases(spark, cases).collect()] == ["closed"]


def test_missing_planes(spark, tmp_path):
    schema = spark.createDataFrame([], "a int").schema
    assert io.read_plane(spark, str(tmp_path / "none"), schema).count() == 0
    with pytest.raises(Exception):
        io.read_plane(spark, str(tmp_path / "none"), schema, required=True).count()
    assert io.read_result(spark, str(tmp_path / "none")) == (False, None)


def test_json_rows_hide_non_finite(spark):
    df = spark.createDataFrame([(float("nan"), float("inf"), 1.5)], "a double, b double, c double")
    assert io.json_rows(df).first()["json"] == '{"a":null,"b":null,"c":1.5}'


def test_derived_column_rejects_strangers(spark):
    df = spark.createDataFrame([(1.0, "x"), (2.0, "y")], "a double, s string")
    for bad in ("s + 1", "system(1)", "a; drop", "a - a"):
        with pytest.raises(ValueError):
            catalogue.derived_column(df, bad, "n")
    assert [r["n"] for r in catalogue.derived_column(df, "maximum(a, 1.5)", "n").collect()] == [1.5, 2.0]


def test_rate_limit_ignores_rejected_requests(spark, tmp_path):
    r = random.Random(3)
    rows = sorted((r.randrange(400), i) for i in range(120))
    src = str(tmp_path / "in")
    spark.createDataFrame([(i, 1, t) for t, i in rows], "seq long, client long, ts_s long").coalesce(1).write.parquet(src)
    stream = spark.readStream.schema("seq long, client long, ts_s long").parquet(src)
    stateful.rate_limit(stream, str(tmp_path / "s"), "client", "ts_s", "seq", 5, 60)
    got = {x["seq"]: x["admitted"] for x in spark.read.parquet(str(tmp_path / "s/out")).collect()}
    held, want = [], {}
    for t, i in rows:
        held = [h for h in held if h > t - 60]
        want[i] = int(len(held) < 5)
        held += [t] * want[i]
    assert got == want and 0 in got.values()


def test_replay_guard_answers_late_rows_and_remembers_spent_nonces(spark, tmp_path):
    day = 86_400
    batches = [[(1, "n", 0, True, 30 * day), (2, "m", 5, True, 10)], [(3, "n", 60, False, 70), (4, "k", 20 * day, True, 21 * day)], [(5, "n", 3 * day, True, 30 * day), (6, "m", 1, True, 10), (7, "z", 2, True, 9)]]
    ddl, src = "seq long, nonce string, ts_s long, valid boolean, expires_at long", str(tmp_path / "in")
    for b in batches:
        spark.createDataFrame(b, ddl).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).parquet(src)
    stateful.replay_guard(stream, str(tmp_path / "s"), ["nonce"], ["ts_s", "seq"], "valid", "expires_at")
    got = {r["seq"]: r["reason"] for r in spark.read.parquet(str(tmp_path / "s/out")).collect()}
    assert got == {1: "", 2: "", 3: "INTENT_SIGNATURE_INVALID", 4: "", 5: "INTENT_REPLAYED", 6: "INTENT_REPLAYED", 7: ""}


def test_upserts_keep_the_newest_row_of_a_key(spark, tmp_path):
    src = str(tmp_path / "in")
    for b in ([("a", 1.0), ("b", 2.0)], [("a", 3.0)], [("c", 4.0), ("b", 0.5)]):
        spark.createDataFrame(b, "k string, score double").coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema("k string, score double").option("maxFilesPerTrigger", 1).parquet(src)
    stateful.score_batches(stream, str(tmp_path / "q"), lambda b: b)
    assert {r["k"]: r["score"] for r in stateful.upserted(spark, str(tmp_path / "q"), ["k"], "score").collect()} == {"a": 3.0, "b": 0.5, "c": 4.0}


def test_an_alert_that_nothing_flips_keeps_a_row(spark):
    from ledgerlark.operators import models

    alerts = spark.createDataFrame([("1", 9.0), ("2", 9.0)], "txn string, amount double")
    legit = spark.createDataFrame([(0, float(i)) for i in range(20)], "is_fraud int, amount double")
    fields = {"amount": models.FIELDS["amount"]}
    trials = models.counterfactual_trials(alerts, legit, "txn", fields)
    scored = trials.withColumn("score", F.when(F.col("txn") == "1", F.col("amount") / 10).otherwise(F.lit(1.0)))
    got = {r["txn"]: (r["column"], r["text"]) for r in models.counterfactuals(alerts, scored, 0.5, "txn", fields=fields).collect()}
    assert got == {"1": ("amount", "Approved if a smaller payment, of at most 5."), "2": (None, None)}


def test_result_tables_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", 0), (2, "b", 1)], "k int, v string, day int")
    io.write_plane(df, str(tmp_path / "plane"))
    assert sorted(io.read_plane(spark, str(tmp_path / "plane"), df.schema, required=True).select(*df.columns).collect()) == sorted(df.collect())
    io.write_features(df.withColumn("_scratch", F.lit(1)), df.where("k = 2"), "k", str(tmp_path / "features"))
    assert spark.read.parquet(str(tmp_path / "features")).collect() == df.where("k = 2").collect()
    io.write_result(df, str(tmp_path / "csv"))
    there, back = io.read_result(spark, str(tmp_path / "csv"), "csv", df.schema)
    assert there and sorted(back.collect()) == sorted(df.collect())


def test_stream_velocity_over_several_batches_equals_batch(spark, tmp_path):
    r = random.Random(8)
    rows = sorted([(1_700_000_000 + r.randrange(300_000), i, f"k{r.randrange(3)}", r.randrange(100)) for i in range(150)])
    ddl, src = "ts_s long, seq long, k string, cents long", str(tmp_path / "in")
    for b in range(3):
        spark.createDataFrame(rows[b * 50:(b + 1) * 50], ddl).withColumn("day", F.floor(F.col("ts_s") / 86400)).coalesce(1).write.mode("append").parquet(src)
    schema = ddl + ", day long"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(src)
    stateful.online_velocity(stream, "k", str(tmp_path / "v"), windows=(3600, 86400))
    pick = lambda d: sorted(tuple(x) for x in d.select("seq", "n_3600", "cents_86400", "n_86400").collect())
    batch = causal.entity_history(spark.createDataFrame(rows, ddl), "k", sums=["cents"], windows=[3600, 86400])
    assert pick(spark.read.parquet(str(tmp_path / "v/out"))) == pick(batch)


def test_rebuild_equals_full(spark):
    r = random.Random(9)
    rows = [(i, 1_700_000_000 + r.randrange(200_000), f"p{r.randrange(6)}", r.randrange(100)) for i in range(120)]
    before = spark.createDataFrame(rows, "seq long, ts_s long, p string, v long")
    after = before.where("seq <> 5").withColumn("v", F.when(F.col("seq") == 7, 999).otherwise(F.col("v")).cast("long"))
    build = lambda d: causal.entity_history(d, "p", sums=["v"], windows=[3600]).select("seq", "n_3600", "v_3600", "v_before")
    got = incremental.rebuild(before, after, build(before), "seq", ["p"], build)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, build(after).collect()))


def test_near_entities_reach_only_as_far_as_the_horizon(spark):
    rows = spark.createDataFrame([(1, "p", "m", 0), (2, "q", "m", 50), (3, "r", "m", 500), (4, "p", "n", 900)], "k long, p string, m string, ts_s long")
    dirty = spark.createDataFrame([("p", "p"), ("m", "m")], "kind string, entity string")
    span = spark.createDataFrame([(0, 10)], "lo long, hi long")
    near = incremental.neighbourhood(rows, dirty, "k", ["p"], ["m"], span, horizon=100)
    assert sorted(r["k"] for r in near.collect()) == [1, 2, 4]
    assert sorted(r["k"] for r in incremental.neighbourhood(rows, dirty, "k", ["p", "m"]).collect()) == [1, 2, 3, 4]


def test_saved_scorer_scores_alike_and_stale_versions_are_refused(spark, tmp_path):
    from ledgerlark.operators import models
    r = random.Random(4)
    rows = [(str(i), int(i % 5 == 0), r.gauss(2.0 * (i % 5 == 0), 1), r.choice("ab")) for i in range(400)]
    df = spark.createDataFrame(rows, "txn_id string, is_fraud int, x double, c string")
    m = models.StackedScorer(["x"], ["c"], trees=2, depth=2).fit(df, df)
    path = str(tmp_path / "bundle")
    io.save_scorer(m, spark, path)
    pick = lambda s: sorted((q["txn_id"], q["score"]) for q in s.transform(df).collect())
    back = io.load_scorer(spark, path)
    assert pick(back) == pick(m) and back.cut == m.cut
    head = spark.read.parquet(f"{path}/head").withColumn("version", F.lit(99)).collect()
    spark.createDataFrame(head, "version int, cut double, numeric array<string>, categories array<string>").write.mode("overwrite").parquet(f"{path}/head")
    with pytest.raises(ValueError):
        io.load_scorer(spark, path)
