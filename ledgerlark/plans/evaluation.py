"""Evaluation queries over scored, labelled payments."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar as fx
from ..operators import curve, evaluate
from ..operators.ordered import exact_quantiles
from ..sources.schema import CATEGORICAL, OBSERVED
from ..sources.tables import LEDGER_COLUMNS, ledger
from .registry import query

CUT = 0.88
CORE = ["txn_id", "score", "is_fraud", "cents"]
CURVE_SQL = """
WITH c AS (SELECT score, sum(is_fraud) AS pos, sum(1 - is_fraud) AS neg, sum(is_fraud * cents) AS pc FROM ledger GROUP BY score),
d AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pc) OVER w AS tc, sum(pos) OVER () AS p, sum(neg) OVER () AS n,
  sum(pc) OVER () AS pt FROM c WINDOW w AS (ORDER BY score DESC))"""


def W(rate, n, name):  # noqa: N802 - reads as a SQL macro
    k = f"round_even(coalesce({rate}, 0) * {n}, 0)"
    z, z2 = "1.959963984540054::DOUBLE", "(1.959963984540054::DOUBLE * 1.959963984540054::DOUBLE)"
    c = f"({k} + 0.5 * {z2}) / ({n} + {z2})"
    s = f"({z} / ({n} + {z2})) * sqrt({k} * ({n} - {k}) / {n} + 0.25 * {z2})"
    return (f"CASE WHEN {n} > 0 THEN R(greatest(0.0::DOUBLE, {c} - {s}), 4) END AS {name}_lo95, "
            f"CASE WHEN {n} > 0 THEN R(least(1.0::DOUBLE, {c} + {s}), 4) END AS {name}_hi95")


@query("metric_headline", f"""
SELECT count(*) AS rows, sum(is_fraud) AS fraud, sum(is_fraud) / count(*) AS fraud_rate, sum(is_fraud * a) / sum(a) AS precision,
  sum(is_fraud * a) / sum(is_fraud) AS recall, 2 * sum(is_fraud * a) / (sum(a) + sum(is_fraud)) AS f1,
  (sum(a) - sum(is_fraud * a)) / (count(*) - sum(is_fraud)) AS false_positive_rate, sum(a) * 10000.0::DOUBLE / count(*) AS alerts_per_10k,
  (sum(is_fraud * a * cents) / 100.0::DOUBLE) / (sum(is_fraud * cents) / 100.0::DOUBLE) AS value_recall,
  sum(is_fraud * cents) / 100.0::DOUBLE AS value_at_risk, sum(is_fraud * a * cents) / 100.0::DOUBLE AS value_saved,
  round(avg(power(score - is_fraud, 2)), 9) AS brier
FROM (SELECT *, CASE WHEN score >= {CUT} THEN 1 ELSE 0 END AS a FROM ledger)
""", ("ledger",))
def metric_headline(spark, sf_dir):
    return evaluate.headline(ledger(spark, sf_dir, CORE), CUT)


@query("metric_roc_auc", CURVE_SQL + """
SELECT sum(neg * (tp - pos + pos / 2.0::DOUBLE)) / (max(p)::DOUBLE * max(n)) AS auc FROM d
""", ("ledger",))
def metric_roc_auc(spark, sf_dir):
    return curve.roc_auc(curve.score_curve(ledger(spark, sf_dir, CORE)))


@query("metric_average_precision", CURVE_SQL + """
SELECT round(sum(pos * (tp / (tp + fp))) / max(p), 10) AS average_precision FROM d
""", ("ledger",))
def metric_average_precision(spark, sf_dir):
    return curve.average_precision(curve.score_curve(ledger(spark, sf_dir, CORE))).select(
        F.round("average_precision", 10).alias("average_precision"))


@query("metric_partial_auc", CURVE_SQL + """,
e AS (SELECT (fp - neg) / n AS f0, fp / n AS f1, (tp - pos) / p AS t0, tp / p AS t1 FROM d),
a AS (SELECT sum(CASE WHEN f1 <= 0.02::DOUBLE THEN (f1 - f0) * (t0 + t1) / 2 WHEN f0 < 0.02::DOUBLE THEN
  (0.02::DOUBLE - f0) * (t0 + t0 + (t1 - t0) * (0.02::DOUBLE - f0) / (f1 - f0)) / 2 ELSE 0 END) AS area FROM e)
SELECT round(0.5 * (1 + (area - 0.0002::DOUBLE) / (0.02::DOUBLE - 0.0002::DOUBLE)), 9) AS partial_auc FROM a
""", ("ledger",))
def metric_partial_auc(spark, sf_dir):
    return curve.partial_auc(curve.score_curve(ledger(spark, sf_dir, CORE))).select(F.round("partial_auc", 9).alias("partial_auc"))


@query("metric_operating_curve", CURVE_SQL + f""",
b AS (SELECT unnest([{", ".join(f"{b}::DOUBLE" for b in curve.BUDGETS)}]) AS target_fpr),
k AS (SELECT target_fpr, max(score) AS cut FROM b, d WHERE fp > floor(target_fpr * n) GROUP BY target_fpr)
SELECT target_fpr, cut, sum(CASE WHEN score > cut THEN is_fraud ELSE 0 END) / sum(is_fraud) AS recall,
  coalesce(sum(CASE WHEN score > cut THEN is_fraud ELSE 0 END) / nullif(sum(CASE WHEN score > cut THEN 1 ELSE 0 END), 0), 0) AS precision,
  sum(CASE WHEN score > cut THEN is_fraud * cents ELSE 0 END) / sum(is_fraud * cents) AS value_recall,
  sum(CASE WHEN score > cut THEN 1 ELSE 0 END) * 10000.0::DOUBLE / count(*) AS alerts_per_10k
FROM k, ledger GROUP BY target_fpr, cut
""", ("ledger",))
def metric_operating_curve(spark, sf_dir):
    return curve.operating_curve(curve.operating_points(curve.score_curve(ledger(spark, sf_dir, CORE))))


@query("metric_budget_threshold", """
SELECT is_hard_negative, score AS cut FROM (SELECT is_hard_negative, score, row_number() OVER (PARTITION BY is_hard_negative ORDER BY score DESC) AS r,
  count(*) OVER (PARTITION BY is_hard_negative) AS n FROM ledger WHERE is_fraud = 0) WHERE r = floor(0.005::DOUBLE * n) + 1
""", ("ledger",))
def metric_budget_threshold(spark, sf_dir):
    rows = ledger(spark, sf_dir, [*CORE, "is_hard_negative"]).where("is_fraud = 0")
    c = curve.score_curve(rows, ["is_hard_negative"])
    return curve.operating_points(c, [0.005], ["is_hard_negative"]).select("is_hard_negative", "cut")


@query("metric_exact_quantiles", """
SELECT rail, unnest([0.05, 0.25, 0.5, 0.75, 0.99]::DOUBLE[]) AS p, round(unnest(quantile_cont(amount, [0.05, 0.25, 0.5, 0.75, 0.99])), 6) AS q,
  count(*) AS n FROM ledger GROUP BY rail
""", ("ledger",))
def metric_exact_quantiles(spark, sf_dir):
    rows = ledger(spark, sf_dir, ["rail", "amount"])
    return exact_quantiles(rows, ["rail"], "amount", [0.05, 0.25, 0.5, 0.75, 0.99]).select("rail", "p", F.round("q", 6).alias("q"), "n")


@query("recall_per_vector", f"""
SELECT *, CASE WHEN rows >= 20 THEN 1 ELSE 0 END AS n_sufficient, {W("recall", "rows", "recall")} FROM (
SELECT attack_vector_id, min(fraud_type) AS family, count(*) AS rows, avg(a) AS recall, quantile_cont(score, 0.5) AS median_score,
  sum(cents) / 100.0::DOUBLE AS value, sum(a * cents) / 100.0::DOUBLE AS value_caught,
  (sum(a * cents) / 100.0::DOUBLE) / greatest(sum(cents) / 100.0::DOUBLE, 1) AS value_recall
FROM (SELECT *, CASE WHEN score >= {CUT} THEN 1 ELSE 0 END AS a FROM ledger WHERE is_fraud = 1) GROUP BY attack_vector_id)
""", ("ledger",))
def recall_per_vector(spark, sf_dir):
    return evaluate.per_vector_recall(ledger(spark, sf_dir, [*CORE, "attack_vector_id", "fraud_type"]), CUT)


@query("recall_per_family", f"""
SELECT *, CASE WHEN rows >= 20 THEN 1 ELSE 0 END AS n_sufficient, {W("recall", "rows", "recall")} FROM (
SELECT fraud_type, count(*) AS rows, avg(CASE WHEN score >= {CUT} THEN 1 ELSE 0 END) AS recall, sum(cents) / 100.0::DOUBLE AS value
FROM ledger WHERE is_fraud = 1 GROUP BY fraud_type)
""", ("ledger",))
def recall_per_family(spark, sf_dir):
    return evaluate.per_family_recall(ledger(spark, sf_dir, [*CORE, "fraud_type"]), CUT)


@query("false_positive_breakdown", f"""
WITH l AS (SELECT *, CASE WHEN score >= {CUT} THEN 1 ELSE 0 END AS a FROM ledger WHERE is_fraud = 0)
SELECT CASE WHEN is_hard_negative = 1 THEN 'hard_negative' ELSE 'ordinary_legitimate' END AS segment, count(*) AS rows,
  sum(a) AS false_positives, avg(a) AS fp_rate FROM l GROUP BY 1
UNION ALL SELECT 'rail:' || rail, count(*), sum(a), avg(a) FROM l GROUP BY 1
""", ("ledger",))
def false_positive_breakdown(spark, sf_dir):
    return evaluate.false_positive_breakdown(ledger(spark, sf_dir, [*CORE, "is_hard_negative", "rail"]), CUT)


_FAIR = """count(*) AS rows, sum(1 - is_fraud) AS legitimate_rows, sum((1 - is_fraud) * a) AS false_positives,
  avg(CASE WHEN is_fraud = 0 THEN a END) AS fp_rate, sum(is_fraud) AS fraud_rows, avg(is_fraud) AS victimisation_rate,
  avg(CASE WHEN is_fraud = 1 THEN a END) AS recall, sum(is_fraud * cents) / 100.0::DOUBLE AS value_at_risk"""


@query("fairness_cohorts", f"""
WITH l AS (SELECT *, CASE WHEN score >= {CUT} THEN 1 ELSE 0 END AS a FROM ledger),
t AS (SELECT 'age_band' AS dimension, coalesce(['18-24','25-34','35-49','50-64','65+'][customer_age_band_ord + 1], 'unknown') AS segment, {_FAIR}
FROM l GROUP BY 2 UNION ALL SELECT 'digital_literacy', CASE WHEN customer_digital_literacy <= 0.2 THEN '0.0-0.2'
  WHEN customer_digital_literacy <= 0.4 THEN '0.2-0.4' WHEN customer_digital_literacy <= 0.6 THEN '0.4-0.6'
  WHEN customer_digital_literacy <= 0.8 THEN '0.6-0.8' ELSE '0.8-1.0' END, {_FAIR} FROM l GROUP BY 2)
SELECT *, {W("fp_rate", "legitimate_rows", "fp_rate")}, CASE WHEN legitimate_rows >= 20 THEN 1 ELSE 0 END AS n_sufficient,
  {W("recall", "fraud_rows", "recall")}, CASE WHEN fraud_rows >= 20 THEN 1 ELSE 0 END AS recall_n_sufficient FROM t
""", ("ledger",))
def fairness_cohorts(spark, sf_dir):
    return evaluate.fairness(ledger(spark, sf_dir, [*CORE, "customer_age_band_ord", "customer_digital_literacy"]), CUT)


@query("evasion_delta", f"""
SELECT *, recall_evasion_0 - recall_evasion_1 AS recall_drop FROM (SELECT attack_vector_id,
  avg(CASE WHEN evasion_applied = 0 THEN a END) AS recall_evasion_0, avg(CASE WHEN evasion_applied = 1 THEN a END) AS recall_evasion_1,
  count(CASE WHEN evasion_applied = 0 THEN 1 END) AS rows_evasion_0, count(CASE WHEN evasion_applied = 1 THEN 1 END) AS rows_evasion_1
FROM (SELECT *, CASE WHEN score >= {CUT} THEN 1 ELSE 0 END AS a FROM ledger WHERE is_fraud = 1) GROUP BY 1) WHERE rows_evasion_1 > 0
""", ("ledger",))
def evasion_delta(spark, sf_dir):
    return evaluate.evasion_delta(ledger(spark, sf_dir, [*CORE, "attack_vector_id", "evasion_applied"]), CUT)


_D = ["rail", "channel", "amount_band", "payee_age_band"]
_SETS = [(a,) for a in _D] + [(a, b) for i, a in enumerate(_D) for b in _D[i + 1:]]


@query("worst_slices", f"""
WITH f AS (SELECT rail, channel, CASE WHEN amount <= 500 THEN '<500' WHEN amount <= 5000 THEN '500-5k' WHEN amount <= 50000 THEN '5k-50k'
  WHEN amount <= 200000 THEN '50k-2L' ELSE '>2L' END AS amount_band, CASE WHEN payee_account_age_days <= 7 THEN '<1w'
  WHEN payee_account_age_days <= 90 THEN '1w-3m' WHEN payee_account_age_days <= 730 THEN '3m-2y' ELSE '>2y' END AS payee_age_band,
  cents, CASE WHEN score >= {CUT} THEN 1 ELSE 0 END AS a FROM ledger WHERE is_fraud = 1),
t AS ({" UNION ALL ".join("SELECT " + " || ' & ' || ".join(f"'{d}=' || {d}" for d in s) + f''' AS slice, {len(s)} AS dimensions, count(*) AS fraud_rows,
  avg(a) AS recall, sum(cents) / 100.0::DOUBLE AS value_at_risk, sum((1 - a) * cents) / 100.0::DOUBLE AS value_missed FROM f GROUP BY 1''' for s in _SETS)})
SELECT *, {W("recall", "fraud_rows", "recall")}, CASE WHEN fraud_rows >= 20 THEN 1 ELSE 0 END AS n_sufficient
FROM t WHERE fraud_rows >= 25 ORDER BY recall, slice LIMIT 8
""", ("ledger",))
def worst_slices(spark, sf_dir):
    return evaluate.worst_slices(ledger(spark, sf_dir, [*CORE, "rail", "channel", "amount", "payee_account_age_days"]), CUT)


@query("decile_lift", """
SELECT decile, count(*) AS rows, sum(is_fraud) AS fraud, avg(is_fraud) AS fraud_rate, avg(is_fraud) / max(base) AS lift,
  sum(is_fraud * cents) / 100.0::DOUBLE AS fraud_value
FROM (SELECT *, ntile(10) OVER (ORDER BY score DESC, md5(txn_id), txn_id) AS decile, avg(is_fraud) OVER () AS base FROM ledger) GROUP BY decile
""", ("ledger",))
def decile_lift(spark, sf_dir):
    return curve.decile_lift(ledger(spark, sf_dir, CORE), "score", "txn_id")


RULE_COLUMNS = ["is_fraud", "amount", "payee_is_first_time", "payee_added_minutes_ago", "screen_share_active", "remote_access_app_detected", "call_in_progress",
                "payee_name_match_score", "sim_swap_recency_days", "device_is_new", "is_night", "payee_inbound_unique_payers_24h", "is_irrevocable_rail"]
RULES_SQL = """CASE WHEN payee_is_first_time = 1 AND amount > 25000 THEN 1 ELSE 0 END AS new_payee_large_amount,
CASE WHEN payee_added_minutes_ago < 30 THEN 1 ELSE 0 END AS payee_added_minutes_ago, screen_share_active AS screen_share_during_payment,
remote_access_app_detected AS remote_access_tool_present, CASE WHEN call_in_progress = 1 AND amount > 10000 THEN 1 ELSE 0 END AS live_call_while_paying,
CASE WHEN payee_name_match_score < 0.6 THEN 1 ELSE 0 END AS payee_name_mismatch, CASE WHEN sim_swap_recency_days < 7 THEN 1 ELSE 0 END AS recent_sim_swap,
device_is_new * is_night AS new_device_at_night, CASE WHEN payee_inbound_unique_payers_24h >= 8 THEN 1 ELSE 0 END AS mule_shaped_beneficiary,
CASE WHEN is_irrevocable_rail = 1 AND payee_is_first_time = 1 AND amount > 50000 THEN 1 ELSE 0 END AS irrevocable_rail_new_payee_high_value"""


@query("rule_firing", f"""
WITH r AS (SELECT is_fraud, {RULES_SQL} FROM ledger), u AS (UNPIVOT r ON COLUMNS(* EXCLUDE is_fraud) INTO NAME rule VALUE hit),
t AS (SELECT rule, sum(hit * is_fraud) AS fires_on_fraud, avg(CASE WHEN is_fraud = 1 THEN hit END) AS fraud_hit_rate,
  sum(hit * (1 - is_fraud)) AS fires_on_legitimate, avg(CASE WHEN is_fraud = 0 THEN hit END) AS legitimate_hit_rate FROM u GROUP BY rule)
SELECT *, fraud_hit_rate / nullif(legitimate_hit_rate, 0) AS lift FROM t
""", ("ledger",))
def rule_firing(spark, sf_dir):
    return evaluate.rule_firing(ledger(spark, sf_dir, RULE_COLUMNS))


@query("baseline_comparison", """
WITH m AS (SELECT 'score' AS model, score AS s, is_fraud, cents FROM ledger UNION ALL SELECT 'second_score', score_b, is_fraud, cents FROM ledger
  UNION ALL SELECT 'one_rule', payee_is_first_time::DOUBLE, is_fraud, cents FROM ledger),
c AS (SELECT model, s, sum(is_fraud) AS pos, sum(1 - is_fraud) AS neg, sum(is_fraud * cents) AS pc FROM m GROUP BY ALL),
d AS (SELECT model, s, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pc) OVER w AS tc, sum(pos) OVER (PARTITION BY model) AS p,
  sum(neg) OVER (PARTITION BY model) AS n, sum(pc) OVER (PARTITION BY model) AS pt FROM c WINDOW w AS (PARTITION BY model ORDER BY s DESC)),
k AS (SELECT model, coalesce(min(CASE WHEN fp / n <= 0.005::DOUBLE THEN s END), max(s)) AS threshold FROM d GROUP BY model)
SELECT model, threshold, tp / p AS recall, tp / (tp + fp) AS precision, tc / pt AS value_recall, fp / n AS realised_fpr,
  CASE WHEN fp / n BETWEEN 0.0017::DOUBLE AND 0.008::DOUBLE THEN 1 ELSE 0 END AS comparable_budget FROM d JOIN k USING (model) WHERE s = threshold
""", ("ledger",))
def baseline_comparison(spark, sf_dir):
    rows = ledger(spark, sf_dir, ["score", "score_b", "payee_is_first_time", "is_fraud", "cents"])
    models = {"score": "score", "second_score": "score_b", "one_rule": "payee_is_first_time"}
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("model"), F.col(c).cast("double").alias("score")) for k, c in models.items()]))
    long = rows.select("is_fraud", "cents", each.alias("e")).select("e.model", "e.score", "is_fraud", "cents")
    return curve.baseline_points(long, 0.005)


#: The cuts that are priced: 240 even quantiles of the score.
GRID = [0.90 + i * (0.99995 - 0.90) / 239 for i in range(240)]

COST_SQL = CURVE_SQL + f""",
g AS (SELECT DISTINCT round(unnest(quantile_cont(score, [{", ".join(f"{q!r}::DOUBLE" for q in GRID)}])), 9) AS cut FROM ledger UNION SELECT {CUT}::DOUBLE),
q AS (SELECT cut, sum(CASE WHEN score >= cut THEN is_fraud ELSE 0 END) AS tp, sum(CASE WHEN score >= cut THEN 1 - is_fraud ELSE 0 END) AS fp,
  sum(is_fraud) AS p, sum(1 - is_fraud) AS n, sum(CASE WHEN score < cut THEN is_fraud * cents ELSE 0 END) / 100.0::DOUBLE AS missed,
  sum(is_fraud * cents) / 100.0::DOUBLE * 0.5 AS do_nothing_cost FROM g, ledger GROUP BY cut),
costs AS (SELECT cut AS threshold, tp / p AS recall, fp / n AS false_positive_rate, tp + fp AS alerts, missed AS fraud_value_missed,
  missed * 0.5 AS fraud_losses, (tp + fp) * 250.0::DOUBLE AS alert_review, fp * 900.0::DOUBLE AS false_declines, do_nothing_cost,
  missed * 0.5 + (tp + fp) * 250.0::DOUBLE + fp * 900.0::DOUBLE AS total_cost FROM q),
marked AS (SELECT *, do_nothing_cost - total_cost AS net_benefit, CASE WHEN row_number() OVER (ORDER BY total_cost, threshold) = 1 THEN 1 ELSE 0 END AS is_optimal,
  CASE WHEN threshold = {CUT}::DOUBLE THEN 1 ELSE 0 END AS is_deployed FROM costs)"""


def _costs(spark, sf_dir):
    rows = ledger(spark, sf_dir, CORE)
    q = exact_quantiles(rows, [], "score", GRID).select(F.round("q", 9).alias("cut"))
    cuts = q.unionByName(spark.range(1).select(F.lit(CUT).alias("cut")))
    return curve.cost_curve(curve.collapse(rows), cuts, CUT)


@query("cost_curve", COST_SQL + " SELECT * FROM marked", ("ledger",))
def cost_curve(spark, sf_dir):
    return _costs(spark, sf_dir)


@query("cost_summary", COST_SQL + """, s AS (SELECT max(do_nothing_cost) AS a, max(CASE WHEN is_deployed = 1 THEN total_cost END) AS b,
  max(CASE WHEN is_deployed = 1 THEN net_benefit END) AS c, max(CASE WHEN is_optimal = 1 THEN total_cost END) AS d,
  max(CASE WHEN is_optimal = 1 THEN net_benefit END) AS e FROM marked)
SELECT 'do_nothing_cost' AS metric, a AS value FROM s UNION ALL SELECT 'cost_at_deployed_threshold', b FROM s UNION ALL
SELECT 'net_benefit_at_deployed', c FROM s UNION ALL SELECT 'cost_at_loss_minimising_threshold', d FROM s UNION ALL
SELECT 'net_benefit_at_loss_minimising', e FROM s UNION ALL SELECT 'cost_of_budget_constraint', b - d FROM s UNION ALL
SELECT 'reimbursement_share', 0.5 UNION ALL SELECT 'analyst_review', 250 UNION ALL SELECT 'false_decline', 900""", ("ledger",))
def cost_summary(spark, sf_dir):
    return curve.cost_summary(_costs(spark, sf_dir))


GUARDS = {"agent_injection_score": "initiated_by_agent", "agent_injection_flag": "initiated_by_agent",
          "vishing_score": "vishing_covered", "vishing_flag": "vishing_covered", "spt_reuse_count": None}


def _auc_long(columns, where=""):
    parts = " UNION ALL ".join(f"SELECT '{c}' AS col, {c}::DOUBLE AS v, is_fraud FROM ledger {where}" for c in columns)
    return f"""long AS ({parts}), cv AS (SELECT col, v, sum(is_fraud) AS pos, sum(1 - is_fraud) AS neg FROM long GROUP BY ALL),
  ranks AS (SELECT *, sum(neg) OVER (PARTITION BY col ORDER BY v) - neg AS below FROM cv),
  aucs AS (SELECT col, sum(pos * (below + neg / 2.0::DOUBLE)) / (sum(pos)::DOUBLE * sum(neg)) AS auc, count(*) AS lv FROM ranks GROUP BY col)"""


@query("guard_leakage", f"""
WITH {_auc_long(GUARDS)}, pr AS ({" UNION ALL ".join(f"SELECT '{c}' AS col, CASE WHEN {p or c} <> 0 THEN 1 ELSE 0 END AS pres, is_fraud FROM ledger" for c, p in GUARDS.items())}),
s AS (SELECT col, avg(pres) AS coverage, avg(CASE WHEN pres = 1 THEN is_fraud END) AS pf, avg(is_fraud) AS base FROM pr GROUP BY col)
SELECT col AS guard_column, round(auc, 10) AS single_feature_auc, coverage, pf AS p_fraud_given_present, base AS base_fraud_rate, pf / base AS presence_lift
FROM aucs JOIN s USING (col)
""", ("ledger",))
def guard_leakage(spark, sf_dir):
    rows = ledger(spark, sf_dir, [*GUARDS, "initiated_by_agent", "vishing_covered", "is_fraud"])
    return evaluate.guard_leakage(rows, GUARDS).withColumn("single_feature_auc", F.round("single_feature_auc", 10))


#: Every numeric column of a payment message that the ledger has.
NUMERIC = [c for c in LEDGER_COLUMNS if c in OBSERVED and c not in CATEGORICAL]


@query("benign_baselines", f"""
WITH long AS ({" UNION ALL ".join(f"SELECT '{c}' AS col, {c}::DOUBLE AS v FROM ledger WHERE is_fraud = 0" for c in NUMERIC)})
SELECT col AS "column", count(*) AS n, round(avg(v), 4) AS mean, round(quantile_cont(v, 0.05), 5) AS p05, round(quantile_cont(v, 0.25), 5) AS p25,
  round(quantile_cont(v, 0.5), 5) AS median, round(quantile_cont(v, 0.75), 5) AS p75, round(quantile_cont(v, 0.95), 5) AS p95, avg(CASE WHEN v = 0 THEN 1 ELSE 0 END) AS share_zero
FROM long GROUP BY col
""", ("ledger",))
def benign_baselines(spark, sf_dir):
    found = evaluate.benign_baselines(ledger(spark, sf_dir, ["is_fraud", *NUMERIC]), NUMERIC)
    return found.select(*[F.round(c, 5).alias(c) if c in ("p05", "p25", "median", "p75", "p95") else c for c in found.columns])


@query("bootstrap_intervals")
def bootstrap_intervals(spark, sf_dir):
    return curve.intervals(_replicas(spark, sf_dir))


@query("bootstrap_paired_difference")
def bootstrap_paired_difference(spark, sf_dir):
    return curve.paired_difference(_replicas(spark, sf_dir), "score", "score_b")


@query("bootstrap_points", CURVE_SQL + """,
k AS (SELECT min(tp - pos) AS tp, min(fp - neg) AS fp, min(tc - pc) AS tc, max(p) AS p, max(pt) AS pt FROM d WHERE fp > floor(0.005::DOUBLE * n)),
m AS (SELECT tp / p AS recall, tp / (tp + fp) AS precision, tc / pt AS value_recall, (SELECT sum(pos * (tp / (tp + fp))) / max(p) FROM d) AS average_precision,
 (SELECT sum(neg * (tp - pos + pos / 2.0::DOUBLE)) / (max(p)::DOUBLE * max(n)) FROM d) AS roc_auc FROM k)
SELECT metric, round(point, 9) AS point, 1000 AS resamples, 1 AS ordered FROM m UNPIVOT (point FOR metric IN (recall, precision, value_recall, average_precision, roc_auc))""", ("ledger",))
def bootstrap_points(spark, sf_dir):
    """What does not depend on the draws: the observed values, how many resamples there are, and that each interval is in order."""
    rows = curve.bootstrap(ledger(spark, sf_dir, CORE), ["score"], 0.005)
    return curve.intervals(rows).select("metric", F.round("point", 9).alias("point"), "resamples", fx.flag(F.col("lo95") <= F.col("hi95")).alias("ordered"))


def _replicas(spark, sf_dir):
    return curve.bootstrap(ledger(spark, sf_dir, ["score", "score_b", "is_fraud", "cents"]), ["score", "score_b"], 0.005)
