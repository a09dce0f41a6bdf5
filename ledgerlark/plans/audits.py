"""Audit queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import audit, evaluate
from ..session import durable
from ..sources.tables import ledger, payments
from .evaluation import NUMERIC, _auc_long
from .registry import query
from .scoring import audit_derived_separability, audit_joint_separability

LEGIT = "(SELECT * FROM ledger WHERE is_fraud = 0)"
_CLIP = "least(greatest({}, 0.0::DOUBLE), 1.0::DOUBLE)"


def _rows(check, pairs, source):
    return " UNION ALL ".join(f"SELECT '{check}' AS \"check\", '{m}' AS measure, round(({e})::DOUBLE, 8) AS value FROM {source}" for m, e in pairs.items())


def _rounded(df):
    return df.withColumn("value", F.round("value", 8))


_TVD = "0.5 * (" + " + ".join(f"abs(avg(CASE WHEN d = {d} THEN 1.0::DOUBLE ELSE 0 END) - log10(1 + 1.0::DOUBLE / {d}))" for d in range(1, 10)) + ")"


@query("audit_benford", f"""WITH a AS (SELECT {_TVD} AS t FROM (SELECT floor(amount / power(10.0::DOUBLE, floor(log10(amount)))) AS d FROM {LEGIT} WHERE amount >= 1))
{_rows("benford", {"total_variation": "t", "score": _CLIP.format("1 - t / 0.35"), "flag": "CASE WHEN t > 0.12 THEN 1 ELSE 0 END"}, "a")}""", ("ledger",))
def audit_benford(spark, sf_dir):
    return _rounded(audit.benford(ledger(spark, sf_dir, ["amount", "is_fraud"]).where("is_fraud = 0")))


@query("audit_round_numbers", f"""WITH a AS (SELECT avg(CASE WHEN abs(amount % 100) <= 1e-8 THEN 1 ELSE 0 END) AS a, avg(CASE WHEN abs(amount % 500) <= 1e-8 THEN 1 ELSE 0 END) AS b FROM {LEGIT})
{_rows("round_numbers", {"multiple_of_100": "a", "multiple_of_500": "b", "score": _CLIP.format("1 - abs(a - 0.26) / 0.26"), "flag": "CASE WHEN a < 0.08 THEN 1 ELSE 0 END"}, "a")}""", ("ledger",))
def audit_round_numbers(spark, sf_dir):
    return _rounded(audit.round_numbers(ledger(spark, sf_dir, ["amount", "is_fraud"]).where("is_fraud = 0")))


_HOUR = "avg(CASE WHEN (ts_s % 86400) // 3600 BETWEEN {} AND {} THEN 1 ELSE 0 END)"


@query("audit_diurnal", f"""WITH a AS (SELECT {_HOUR.format(0, 5)} AS n, {_HOUR.format(18, 21)} AS e, {_HOUR.format(10, 13)} AS m FROM {LEGIT})
{_rows("diurnal", {"night": "n", "evening": "e", "morning": "m", "score": "((n < 0.10)::INT + (e > m)::INT + (e > 0.22)::INT) / 3.0::DOUBLE"}, "a")}""", ("ledger",))
def audit_diurnal(spark, sf_dir):
    return _rounded(audit.diurnal(ledger(spark, sf_dir, ["ts_s", "is_fraud"]).where("is_fraud = 0")))


@query("audit_weekly", f"""WITH a AS (SELECT max(s) - min(s) AS sp FROM (SELECT coalesce(c, 0) / sum(c) OVER () AS s FROM range(7) LEFT JOIN
  (SELECT (day + 3) % 7 AS d, count(*) AS c FROM {LEGIT} GROUP BY 1) ON d = range))
{_rows("weekly", {"spread": "sp", "score": _CLIP.format("1 - abs(sp - 0.055) / 0.08")}, "a")}""", ("ledger",))
def audit_weekly(spark, sf_dir):
    return _rounded(audit.weekly(ledger(spark, sf_dir, ["ts_s", "is_fraud"]).where("is_fraud = 0")))


@query("audit_amount_tail", f"""WITH l AS (SELECT amount, log10(greatest(amount, 1.0::DOUBLE)) AS g FROM {LEGIT}), z AS (SELECT avg(g) AS mu FROM l),
a AS (SELECT quantile_cont(amount, 0.99) / greatest(quantile_cont(amount, 0.5), 1) AS r, avg(power(g - mu, 3)) / power(avg(power(g - mu, 2)), 1.5) AS s,
  avg(power(g - mu, 4)) / power(avg(power(g - mu, 2)), 2) - 3 AS k FROM l, z)
{_rows("amount_tail", {"p99_over_p50": "r", "log_skew": "s", "log_excess_kurtosis": "k", "score": "((r BETWEEN 8 AND 400)::INT + (s BETWEEN -0.5 AND 1.5)::INT) / 2.0::DOUBLE"}, "a")}""", ("ledger",))
def audit_amount_tail(spark, sf_dir):
    return _rounded(audit.amount_tail(ledger(spark, sf_dir, ["amount", "is_fraud"]).where("is_fraud = 0")))


@query("audit_entity_consistency", f"""WITH p AS (SELECT payer, avg(log10(greatest(amount, 1.0::DOUBLE))) AS m, var_samp(log10(greatest(amount, 1.0::DOUBLE))) AS v FROM {LEGIT} GROUP BY payer),
a AS (SELECT var_samp(m) / greatest(var_samp(m) + avg(v), 1e-9) AS i FROM p)
{_rows("entity_consistency", {"icc": "i", "score": _CLIP.format("1 - abs(i - 0.30) / 0.30"), "flag": "CASE WHEN i < 0.05 THEN 1 ELSE 0 END"}, "a")}""", ("ledger",))
def audit_entity_consistency(spark, sf_dir):
    return _rounded(audit.entity_consistency(ledger(spark, sf_dir, ["payer", "amount", "is_fraud"]).where("is_fraud = 0")))


@query("audit_payee_concentration", f"""WITH c AS (SELECT count(*) AS c FROM {LEGIT} GROUP BY payee), r AS (SELECT c, row_number() OVER (ORDER BY c DESC) AS r, count(*) OVER () AS n FROM c),
a AS (SELECT (SELECT sum(CASE WHEN r <= greatest(1, n // 100) THEN c ELSE 0 END) / sum(c) FROM r) AS t, (SELECT avg(payee_is_first_time) FROM {LEGIT}) AS f)
{_rows("payee_concentration", {"top_1pct_share": "t", "first_time_rate": "f", "score": "((t BETWEEN 0.05 AND 0.75)::INT + (f BETWEEN 0.05 AND 0.60)::INT) / 2.0::DOUBLE"}, "a")}""", ("ledger",))
def audit_payee_concentration(spark, sf_dir):
    return _rounded(audit.payee_concentration(ledger(spark, sf_dir, ["payee", "payee_is_first_time", "is_fraud"]).where("is_fraud = 0")))


@query("audit_single_feature_auc", f"""WITH {_auc_long(NUMERIC)} SELECT col AS "column", round(greatest(auc, 1 - auc), 10) AS auc FROM aucs WHERE lv > 1 ORDER BY 2 DESC, 1 LIMIT 10""", ("ledger",))
def audit_single_feature_auc(spark, sf_dir):
    found = evaluate.column_auc(ledger(spark, sf_dir, ["is_fraud", *NUMERIC]), NUMERIC)
    top = F.greatest(F.col("auc"), 1 - F.col("auc"))
    return found.select("column", F.round(top, 10).alias("auc")).orderBy(F.desc("auc"), "column").limit(10)


_KS = """counts AS (SELECT col, v, count(*) FILTER (side = 0) AS a, count(*) FILTER (side = 1) AS b FROM long GROUP BY ALL),
gaps AS (SELECT col, abs(sum(a) OVER w / sum(a) OVER p - sum(b) OVER w / sum(b) OVER p) AS g FROM counts WINDOW w AS (PARTITION BY col ORDER BY v), p AS (PARTITION BY col))"""


@query("audit_fraud_overlap", f"""WITH long AS (SELECT 'amount' AS col, log10(greatest(amount, 1.0::DOUBLE)) AS v, is_fraud AS side FROM ledger), {_KS},
a AS (SELECT (SELECT max(g) FROM gaps) AS ks, avg(CASE WHEN is_fraud = 1 THEN CASE WHEN screen_share_active + remote_access_app_detected + call_in_progress + device_is_emulator = 0 THEN 1 ELSE 0 END END) AS q,
 count(DISTINCT CASE WHEN is_fraud = 1 THEN rail END) AS rails, avg(CASE WHEN is_fraud = 0 THEN screen_share_active END) AS ss, avg(CASE WHEN is_fraud = 0 THEN payee_is_first_time END) AS ft,
 quantile_cont(CASE WHEN is_fraud = 1 THEN amount END, 0.25) < quantile_cont(CASE WHEN is_fraud = 0 THEN amount END, 0.75)
 AND quantile_cont(CASE WHEN is_fraud = 0 THEN amount END, 0.25) < quantile_cont(CASE WHEN is_fraud = 1 THEN amount END, 0.75) AS iqr FROM ledger)
{_rows("fraud_overlap", {"amount_iqr_overlaps": "iqr::INT", "multi_rail": "(rails >= 5)::INT", "has_quiet_fraud": "(q > 0.35)::INT", "benign_shares_signals": "(ss > 0.0005 AND ft > 0.02)::INT",
 "amount_ks_below_0.6": "(ks < 0.6)::INT", "quiet_share": "q", "amount_ks": "ks", "score": "(iqr::INT + (rails >= 5)::INT + (q > 0.35)::INT + (ss > 0.0005 AND ft > 0.02)::INT + (ks < 0.6)::INT) / 5.0::DOUBLE"}, "a")}""", ("ledger",))
def audit_fraud_overlap(spark, sf_dir):
    return _rounded(audit.fraud_overlap(ledger(spark, sf_dir, [
        "amount", "is_fraud", "rail", "screen_share_active", "remote_access_app_detected", "call_in_progress", "device_is_emulator", "payee_is_first_time"])))


_SIDES = f"""long AS ({" UNION ALL ".join(f"SELECT '{c}' AS col, {c}::DOUBLE AS v, CASE WHEN day < 10500 THEN 0 ELSE 1 END AS side FROM ledger" for c in NUMERIC)}), {_KS},
ks AS (SELECT col, max(g) AS ks FROM gaps GROUP BY col)"""


def _ks(spark, sf_dir):
    rows = ledger(spark, sf_dir, ["day", *NUMERIC]).withColumn("side", (F.col("day") >= 10500).cast("int"))
    return audit.two_sample_ks(evaluate.long_numeric(rows, NUMERIC, ["side"]))


@query("audit_two_sample_ks", f"""WITH {_SIDES} SELECT col AS "column", round(ks, 10) AS ks, row_number() OVER (ORDER BY round(ks, 10) DESC, col) AS place FROM ks""", ("ledger",))
def audit_two_sample_ks(spark, sf_dir):
    """Every column's distance between two halves, the worst first by ``place``."""
    found = _ks(spark, sf_dir).select("column", F.round("ks", 10).alias("ks"))
    return found.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("ks"), "column")))  # one row a column


@query("audit_reference_agreement", f"""WITH {_SIDES}, a AS (SELECT avg(ks) AS m, max(ks) AS w, count(*) AS n FROM ks)
{_rows("reference_agreement", {"mean_ks": "m", "worst_ks": "w", "columns": "n", "score": _CLIP.format(f"1 - m / {audit.KS_SPAN}::DOUBLE")}, "a")}""", ("ledger",))
def audit_reference_agreement(spark, sf_dir):
    return _rounded(audit.reference_check(_ks(spark, sf_dir)))


@query("audit_single_feature_check", f"""WITH {_auc_long(NUMERIC)}, t AS (SELECT greatest(auc, 1 - auc) AS auc FROM aucs WHERE lv > 1),
a AS (SELECT max(auc) AS a, count(*) FILTER (auc > {audit.AUC_CEILING}) AS n FROM t)
{_rows("single_feature", {"worst_auc": "a", "above_ceiling": "n", "score": _CLIP.format(f"({audit.AUC_CEILING}::DOUBLE - a) / {audit.AUC_CEILING - 0.5}::DOUBLE"), "flag": "CASE WHEN n > 0 THEN 1 ELSE 0 END"}, "a")}""", ("ledger",))
def audit_single_feature_check(spark, sf_dir):
    """The ceiling on what one column may separate alone."""
    return _rounded(audit.single_feature_check(evaluate.column_auc(ledger(spark, sf_dir, ["is_fraud", *NUMERIC]), NUMERIC)))


_PAIRS = [(x, y) for i, x in enumerate(NUMERIC) for y in NUMERIC[i:]]


@query("audit_correlation_drift", "WITH c AS (SELECT " + ", ".join(f"corr({x}, {y}) FILTER (day < 10500) AS a{i}, corr({x}, {y}) FILTER (day >= 10500) AS b{i}" for i, (x, y) in enumerate(_PAIRS))
       + " FROM ledger), p AS (" + " UNION ALL ".join(f"SELECT {1 if x == y else 2} AS w, a{i} AS a, b{i} AS b FROM c" for i, (x, y) in enumerate(_PAIRS))
       + ") SELECT round(sum(w * abs(a - b)) / sum(w), 8) AS drift FROM p WHERE NOT isnan(a) AND NOT isnan(b)", ("ledger",))
def audit_correlation_drift(spark, sf_dir):
    return _drift(spark, sf_dir).select(F.round("drift", 8).alias("drift"))


def _drift(spark, sf_dir):
    rows = ledger(spark, sf_dir, ["day", *NUMERIC])
    return audit.correlation_drift(rows.where("day < 10500"), rows.where("day >= 10500"), NUMERIC)


_TEXTS, _IDS = ["rail", "channel", "fraud_type", "auth_method"], ["payer", "payee", "merchant_id", "campaign_id"]


@query("audit_label_only_levels", "WITH u AS (" + " UNION ALL ".join(
    [f"SELECT '{c}' AS col, 'level' AS kind, {c} AS value, is_fraud FROM ledger" for c in _TEXTS]
    + [f"SELECT '{c}' AS col, 'id prefix' AS kind, regexp_extract({c}, '^([A-Za-z]+)', 1) AS value, is_fraud FROM ledger" for c in _IDS]) + """),
t AS (SELECT sum(is_fraud) AS p, sum(1 - is_fraud) AS n FROM ledger), c AS (SELECT col, kind, value, sum(is_fraud) AS f, sum(1 - is_fraud) AS l FROM u GROUP BY ALL)
SELECT col AS "column", kind, value, f AS fraud_rows, l AS legit_rows, f / (f + l) AS fraud_share FROM c, t WHERE f >= 25 AND l / n <= 0.02 * (f / p)""", ("ledger",))
def audit_label_only_levels(spark, sf_dir):
    return audit.label_only_levels(ledger(spark, sf_dir, ["is_fraud", *_TEXTS, *_IDS]), _TEXTS, _IDS)


@query("audit_label_only_bands", """WITH x AS (SELECT is_fraud, CASE WHEN is_fraud = 1 THEN score * 10 + 20 ELSE score * 30 END AS planted, amount FROM ledger),
long AS (SELECT 'planted' AS col, planted AS v, is_fraud FROM x UNION ALL SELECT 'amount', amount, is_fraud FROM x),
e AS (SELECT col, list_sort(list_distinct(quantile_cont(v, [0,0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9,1]))) AS e FROM long WHERE is_fraud = 1 GROUP BY col),
b AS (SELECT col, len(list_filter(e[2:len(e) - 1], lambda q: q <= v)) AS bin, e[2:len(e) - 1] AS i, is_fraud FROM long JOIN e USING (col)),
c AS (SELECT col, bin, i, sum(is_fraud) AS f, sum(1 - is_fraud) AS l FROM b GROUP BY ALL),
s AS (SELECT *, f / sum(f) OVER (PARTITION BY col) AS rf, l / sum(l) OVER (PARTITION BY col) AS rl FROM c)
SELECT col AS "column", 'band' AS kind, round(CASE WHEN bin > 0 THEN i[bin] END, 8) AS low, round(CASE WHEN bin < len(i) THEN i[bin + 1] END, 8) AS high,
  f AS fraud_rows, l AS legit_rows, rf / (rf + rl) AS fraud_share FROM s WHERE f >= 25 AND rf / (rf + rl) >= 0.9""", ("ledger",))
def audit_label_only_bands(spark, sf_dir):
    rows = ledger(spark, sf_dir, ["is_fraud", "score", "amount"])
    planted = F.when(F.col("is_fraud") == 1, F.col("score") * 10 + 20).otherwise(F.col("score") * 30)
    found = audit.label_only_bands(rows.withColumn("planted", planted), ["planted", "amount"])
    return found.withColumn("low", F.round("low", 8)).withColumn("high", F.round("high", 8))


@query("audit_find_artefacts")
def audit_find_artefacts(spark, sf_dir):
    return audit.find_artefacts(ledger(spark, sf_dir, ["is_fraud", *_TEXTS, *_IDS, *NUMERIC]), _TEXTS, _IDS, NUMERIC)


def _all_checks(spark, sf_dir):
    """Rows of the fourteen checks, stored once."""
    rows = durable(ledger(spark, sf_dir, ["txn_id", "ts_s", "day", "amount", "is_fraud", "payer", *_TEXTS, *_IDS[1:], *[c for c in NUMERIC if c != "amount"]]))
    legit = rows.where("is_fraud = 0")
    checks = [f(legit) for f in (audit.benford, audit.round_numbers, audit.diurnal, audit.weekly, audit.amount_tail, audit.entity_consistency, audit.payee_concentration)]
    checks += [audit.fraud_overlap(rows), audit.single_feature_check(evaluate.column_auc(rows, NUMERIC)), audit.separability_check("joint_separability", audit_joint_separability(spark, sf_dir)),
               audit.separability_check("derived_separability", audit_derived_separability(spark, sf_dir)), audit.reference_check(_ks(spark, sf_dir)),
               audit.drift_check(_drift(spark, sf_dir)), audit.artefact_check(audit.find_artefacts(rows, _TEXTS, _IDS, NUMERIC))]
    return durable(reduce(lambda a, b: a.unionByName(b), checks))


@query("audit_report")
def audit_report(spark, sf_dir):
    """Fourteen checks: mean score, flags, warnings, and the checks that score zero."""
    return audit.report(_all_checks(spark, sf_dir))
