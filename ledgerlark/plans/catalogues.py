"""Catalogue, comparison and maintenance queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import catalogue, features, incremental, relate
from ..session import durable
from ..sources.tables import ledger, payments, table
from .registry import query


def _parts(spark, sf_dir):
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_type").alias("family"), F.split("p_name", " ").alias("signals"),
        (F.col("p_size") % 5).alias("severity"), (F.col("p_size") % 4).alias("prevalence"), (F.col("p_size") % 3).alias("difficulty"),
        (F.col("p_size") > 25).cast("long").alias("simulated"))


@query("catalogue_signal_usage", "SELECT signal, count(*) AS uses FROM (SELECT unnest(string_split(p_name, ' ')) AS signal FROM part) GROUP BY signal")
def catalogue_signal_usage(spark, sf_dir):
    return catalogue.signal_usage(_parts(spark, sf_dir), "signals")


@query("catalogue_conformance", """SELECT id, problem, value FROM (SELECT p_partkey::VARCHAR AS id, 'unknown value' AS problem, unnest(string_split(p_name, ' ')) AS value FROM part)
WHERE value >= 'r'""")
def catalogue_conformance(spark, sf_dir):
    known = table(spark, sf_dir, "part").select(F.explode(F.split("p_name", " ")).alias("value")).where("value < 'r'").distinct()
    return catalogue.conformance(_parts(spark, sf_dir), "id", "signals", known)


@query("catalogue_family_summary", """WITH b AS (SELECT p_type AS family, count(*) AS vectors, sum(CASE WHEN p_size > 25 THEN 1 ELSE 0 END) AS simulated,
 round(avg((0.4::DOUBLE * (p_size % 5) + 0.25::DOUBLE * (p_size % 4) + 0.35::DOUBLE * (p_size % 3)) / 5), 6) AS mean_risk FROM part GROUP BY 1),
u AS (SELECT family, count(DISTINCT v) AS controls FROM (SELECT p_type AS family, unnest(string_split(p_name, ' ')) AS v FROM part) GROUP BY 1) SELECT * FROM b JOIN u USING (family)""")
def catalogue_family_summary(spark, sf_dir):
    return catalogue.family_summary(_parts(spark, sf_dir), "family", "signals")


@query("compare_paired", """WITH j AS (SELECT day, avg(score) AS x, avg(score_b) AS y FROM ledger GROUP BY day)
SELECT count(*) AS pairs, round(avg(x), 8) AS before, round(avg(y), 8) AS after, round(avg(y - x), 8) AS difference, round(stddev_samp(y - x), 8) AS sd, round(avg(y - x) / (stddev_samp(y - x) / sqrt(count(*))), 5) AS t FROM j""", ("ledger",))
def compare_paired(spark, sf_dir):
    rows = ledger(spark, sf_dir, ["day", "score", "score_b"])
    one = lambda c: rows.groupBy("day").agg(F.avg(c).alias("m"))
    s = catalogue.paired_comparison(one("score"), one("score_b"), "day", "m")
    return s.select("pairs", *[F.round(c, 8).alias(c) for c in ("before", "after", "difference", "sd")], F.round("t", 5).alias("t"))


@query("compare_transfer_matrix", 'SELECT rail, round(avg(CASE WHEN channel = \'app\' THEN score END), 8) AS app, round(avg(CASE WHEN channel = \'web\' THEN score END), 8) AS web, round(avg(CASE WHEN channel = \'pos\' THEN score END), 8) AS pos FROM ledger GROUP BY rail', ("ledger",))
def compare_transfer_matrix(spark, sf_dir):
    return catalogue.transfer_matrix(ledger(spark, sf_dir, ["rail", "channel", "score"]), "rail", "channel", "score", ["app", "web", "pos"])


@query("compare_trend", """WITH r AS (SELECT day // 365 AS y, avg(score) AS v FROM ledger GROUP BY 1), d AS (SELECT *, sign(v - lag(v) OVER (ORDER BY y)) AS d FROM r), m AS (SELECT y, d, lag(d) OVER (ORDER BY y) AS before FROM d WHERE d <> 0),
s AS (SELECT regr_slope(v, y) AS slope, (SELECT coalesce(sum(CASE WHEN d * before < 0 THEN 1 ELSE 0 END), 0)::BIGINT FROM m) AS sc, count(*) AS n FROM r), x AS (SELECT *, sc / greatest(n - 2, 1) AS osc FROM s)
SELECT round(slope, 10) AS slope, sc AS sign_changes, osc AS oscillation,
 CASE WHEN n < 5 THEN 'too short' WHEN abs(slope) < 0.005 AND osc < 0.5 THEN 'flat' WHEN slope < -0.005 THEN 'falling' WHEN osc >= 0.5 THEN 'oscillating' ELSE 'rising' END AS verdict FROM x""", ("ledger",))
def compare_trend(spark, sf_dir):
    rows = ledger(spark, sf_dir, ["day", "score"]).withColumn("y", F.floor(F.col("day") / 365))
    return catalogue.trend(rows, "y", "score")


@query("select_trim_to_budget", """WITH g AS (SELECT campaign_id, min(ts_s) AS o, sum(cents) AS a FROM ledger WHERE campaign_id <> '' GROUP BY 1), r AS (SELECT *, sum(a) OVER (ORDER BY o, campaign_id) AS run, row_number() OVER (ORDER BY o, campaign_id) AS k FROM g)
SELECT txn_id, campaign_id FROM ledger WHERE campaign_id IN (SELECT campaign_id FROM r WHERE k = 1 OR run <= 2000000000)""", ("ledger",))
def select_trim_to_budget(spark, sf_dir):
    rows = ledger(spark, sf_dir, ["txn_id", "campaign_id", "ts_s", "cents"]).where("campaign_id <> ''")
    return catalogue.trim_to_budget(rows, "campaign_id", "ts_s", "cents", 2_000_000_000).select("txn_id", "campaign_id")


@query("select_derived_column", "SELECT txn_id, round((CASE WHEN amount > 50000 THEN ln(1 + amount) ELSE greatest(auth_attempts, 2) END)::DOUBLE, 9) AS proposed FROM ledger", ("ledger",))
def select_derived_column(spark, sf_dir):
    rows = ledger(spark, sf_dir, ["txn_id", "amount", "auth_attempts"])
    return catalogue.derived_column(rows, "where(amount > 50000, log1p(amount), maximum(auth_attempts, 2))", "proposed").select("txn_id", F.round("proposed", 9).alias("proposed"))


@query("set_aligned_union", """SELECT event_id AS id, value AS amount, 'app' AS channel, NULL AS lang FROM events UNION ALL SELECT doc_id, 0.0::DOUBLE, 'app', lang FROM documents""")
def set_aligned_union(spark, sf_dir):
    a = table(spark, sf_dir, "events").selectExpr("event_id AS id", "value AS amount", "'app' AS channel")
    b = table(spark, sf_dir, "documents").selectExpr("doc_id AS id", "lang")
    return relate.aligned_union(a, b, {"amount": 0.0, "channel": "app"})


@query("set_restore_slice", "SELECT txn_id, CASE WHEN campaign_id = 'C7' THEN cents ELSE cents + 1 END AS cents FROM ledger WHERE campaign_id <> 'C8'", ("ledger",))
def set_restore_slice(spark, sf_dir):
    pristine = ledger(spark, sf_dir, ["txn_id", "cents", "campaign_id"])
    current = pristine.withColumn("cents", F.col("cents") + 1)
    out = incremental.restore_slice(current, pristine, "txn_id", F.col("campaign_id") == "C8", F.col("campaign_id") == "C7")
    return out.select("txn_id", "cents")


@query("incremental_rebuild", """WITH v AS (SELECT * REPLACE (CASE WHEN day = 19747 THEN cents + 100 ELSE cents END AS cents) FROM payments)
SELECT txn_id, count(*) OVER w + count(*) OVER peer AS f_payee_txn_count_24h, (coalesce(sum(cents) OVER w, 0) + coalesce(sum(cents) OVER peer, 0)) / 100.0::DOUBLE AS f_payee_amount_sum_24h FROM v
WINDOW w AS (PARTITION BY payee ORDER BY ts_s RANGE BETWEEN 86400 PRECEDING AND 1 PRECEDING), peer AS (PARTITION BY payee, ts_s ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""", ("payments",))
def incremental_rebuild(spark, sf_dir):
    before = durable(payments(spark, sf_dir, ["txn_id", "seq", "ts_s", "day", "payer", "payee", "cents"]))
    after = before.withColumn("cents", F.when(F.col("day") == 19747, F.col("cents") + 100).otherwise(F.col("cents")))
    made = ["txn_id", "f_payee_txn_count_24h", "f_payee_amount_sum_24h"]
    build = lambda d: features.payee_features(d).select(*made)
    return incremental.rebuild(before, after, durable(build(before)), "txn_id", ["payee"], build)
