"""Causal window queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar as fx
from ..operators import causal, features
from ..session import stored
from ..sources.tables import LINE_COLUMNS, ledger, payments
from .registry import query

HOUR, DAY, WEEK = 3600, 86400, 604800


def _over(key, w):
    """Rows of the window at or after t - W and before t's second, plus earlier rows of t's second."""
    return f"""(PARTITION BY {key} ORDER BY ts_s RANGE BETWEEN {w} PRECEDING AND 1 PRECEDING)"""


def _velocity_sql(key, spans, extra=""):
    cols = []
    for label, w in spans.items():
        cols.append(f"count(*) OVER {_over(key, w)} + count(*) OVER peer AS n_{label}")
        cols.append(f"(coalesce(sum(cents) OVER {_over(key, w)}, 0) + coalesce(sum(cents) OVER peer, 0))::BIGINT AS cents_{label}")
    return ", ".join(cols)


PEER = "WINDOW peer AS (PARTITION BY {key}, ts_s ORDER BY {seq} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), " \
       "prior AS (PARTITION BY {key} ORDER BY ts_s, {seq} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"

SPANS = {"15m": 900, "1h": HOUR, "24h": DAY, "7d": WEEK}


def _labelled(df, id_cols, spans, extra=()):
    cols = [*id_cols]
    for label, w in spans.items():
        cols += [F.col(f"n_{w}").alias(f"n_{label}"), F.col(f"cents_{w}").cast("long").alias(f"cents_{label}")]
    return df.select(*cols, *extra)


@query("causal_payer_velocity", f"""
SELECT txn_id, {_velocity_sql("payer", SPANS)} FROM payments {PEER.format(key="payer", seq="seq")}
""", ("payments",))
def causal_payer_velocity(spark, sf_dir):
    rows = payments(spark, sf_dir, ["txn_id", "seq", "ts_s", "payer", "cents"])
    found = causal.entity_history(rows, "payer", sums=["cents"], windows=list(SPANS.values()))
    return _labelled(found, ["txn_id"], SPANS)


def _self_join(key, other, w, view="payments", seq="seq"):
    """Distinct partners among earlier rows of the trailing window, by brute force."""
    return (f"SELECT a.txn_id, count(DISTINCT b.{other}) AS u FROM {view} a LEFT JOIN {view} b ON a.{key} = b.{key} "
            f"AND b.ts_s >= a.ts_s - {w} AND (b.ts_s < a.ts_s OR (b.ts_s = a.ts_s AND b.ord < a.ord)) GROUP BY a.txn_id")


ORD = ["seq", "line", "item", "supp", "cents"]
#: The ledger with one number for the order of rows inside a second.
RANKED = "led AS (SELECT *, row_number() OVER (ORDER BY seq, line, item, supp, cents) AS ord FROM ledger)"
PAY_RANKED = "pay AS (SELECT *, seq AS ord FROM payments)"


@query("causal_expanding_mean_std", f"""
SELECT txn_id, count(*) OVER prior AS n_before, R(avg(cents) OVER prior, 4) AS mean_before,
  CASE WHEN count(*) OVER prior > 1 THEN R(stddev_pop(cents) OVER prior, 4) END AS std_before
FROM payments {PEER.format(key="payer", seq="seq")}
""", ("payments",))
def causal_expanding_mean_std(spark, sf_dir):
    rows = payments(spark, sf_dir, ["txn_id", "seq", "ts_s", "payer", "cents"]).withColumn(
        "sq", F.col("cents") * F.col("cents"))
    h = causal.entity_history(rows, "payer", sums=["cents", "sq"])
    return h.select(
        "txn_id", "n_before", fx.rounded(causal.prior_mean("cents_before", "n_before"), 4).alias("mean_before"),
        fx.rounded(causal.prior_std("cents_before", "sq_before", "n_before"), 4).alias("std_before"))


@query("causal_previous_value", """
SELECT txn_id, lag(amount) OVER w AS prev_amount, ts_s - lag(ts_s) OVER w AS gap_s, lag(rail) OVER w AS prev_rail
FROM payments WINDOW w AS (PARTITION BY payer ORDER BY ts_s, seq)
""", ("payments",))
def causal_previous_value(spark, sf_dir):
    rows = payments(spark, sf_dir, ["txn_id", "seq", "ts_s", "payer", "amount", "rail"])
    h = causal.entity_history(rows, "payer", last=["amount", "ts_s", "rail"])
    return h.select("txn_id", "prev_amount", (F.col("ts_s") - F.col("prev_ts_s")).alias("gap_s"), "prev_rail")


@query("causal_first_seen_and_rank", """
SELECT txn_id, min(ts_s) OVER (PARTITION BY payee) AS first_ts,
  row_number() OVER (PARTITION BY payee ORDER BY ts_s, seq) - 1 AS prior_rows FROM payments
""", ("payments",))
def causal_first_seen_and_rank(spark, sf_dir):
    rows = payments(spark, sf_dir, ["txn_id", "seq", "ts_s", "payee"])
    h = causal.entity_history(rows, "payee", first_seen=True)
    return h.select("txn_id", "first_ts", F.col("n_before").alias("prior_rows"))


@query("causal_cross_entity_sum", """
SELECT a.txn_id, coalesce(sum(b.cents), 0)::BIGINT AS cross_cents FROM payments a LEFT JOIN payments b
ON b.payer = a.payee AND b.ts_s >= a.ts_s - 86400 AND b.ts_s < a.ts_s GROUP BY a.txn_id
""", ("payments",))
def causal_cross_entity_sum(spark, sf_dir):
    rows = payments(spark, sf_dir, ["txn_id", "ts_s", "payer", "payee", "cents"])
    sums = causal.cross_window_sum(rows, "payer", rows, "payee", value="cents", window=DAY, name="cross_cents")
    return rows.join(sums, ["payee", "ts_s"], "left").select(
        "txn_id", F.coalesce("cross_cents", F.lit(0)).cast("long").alias("cross_cents"))


@query("causal_distinct_partners", f"""
WITH {PAY_RANKED}, a AS ({_self_join("payee", "payer", DAY, "pay")}), b AS ({_self_join("payee", "payer", WEEK, "pay")})
SELECT a.txn_id, a.u AS uniq_24h, b.u AS uniq_7d FROM a JOIN b USING (txn_id)
""", ("payments",))
def causal_distinct_partners(spark, sf_dir):
    rows = payments(spark, sf_dir, ["txn_id", "seq", "ts_s", "payer", "payee"])
    h = causal.entity_history(rows, "payee", distinct={"payer": [DAY, WEEK]})
    return h.select("txn_id", F.col(f"uniq_payer_{DAY}").alias("uniq_24h"), F.col(f"uniq_payer_{WEEK}").alias("uniq_7d"))


@query("counterparty_enrichment", f"""
WITH {PAY_RANKED}, u AS ({_self_join("payee", "payer", DAY, "pay")}),
o AS (SELECT a.txn_id, coalesce(sum(b.cents), 0) AS out_c FROM pay a LEFT JOIN pay b
      ON b.payer = a.payee AND b.ts_s >= a.ts_s - 86400 AND b.ts_s < a.ts_s GROUP BY a.txn_id),
w AS (SELECT txn_id, ts_s, reg_lag_s,
  row_number() OVER (PARTITION BY payee ORDER BY ts_s, seq) - 1 AS prior_n,
  min(ts_s) OVER (PARTITION BY payee) AS first_ts,
  row_number() OVER (PARTITION BY payer, payee ORDER BY ts_s, seq) - 1 AS pair_n,
  min(ts_s) OVER (PARTITION BY payer, payee) AS pair_ts,
  coalesce(sum(cents) OVER {_over("payee", DAY)}, 0) + coalesce(sum(cents) OVER peer, 0) AS in_c
  FROM pay {PEER.format(key="payee", seq="seq")})
SELECT txn_id, prior_n AS payee_prior_txn_count, R((ts_s - first_ts) / 86400.0::DOUBLE, 4) AS payee_age_days,
  CASE WHEN pair_n = 0 THEN 1 ELSE 0 END AS payee_is_first_time,
  R(least(CASE WHEN pair_n = 0 THEN reg_lag_s ELSE ts_s - pair_ts + reg_lag_s END / 60.0::DOUBLE, 525600.0::DOUBLE), 3)
    AS payee_added_minutes_ago,
  in_c / 100.0::DOUBLE AS payee_inbound_amount_24h, u.u AS payee_inbound_unique_payers_24h,
  R((out_c / 100.0::DOUBLE) / greatest(in_c / 100.0::DOUBLE, 1.0::DOUBLE), 4) AS payee_outbound_ratio_24h
FROM w JOIN u USING (txn_id) JOIN o USING (txn_id)
""", ("payments",))
def counterparty_enrichment(spark, sf_dir):
    rows = payments(spark, sf_dir, ["txn_id", "seq", "ts_s", "payer", "payee", "cents", "reg_lag_s"])
    return features.enrich(rows).drop("seq", "ts_s", "payer", "payee", "cents", "reg_lag_s")


LPEER = PEER.format(key="{key}", seq="ord")


def _trail(key, expr, w):
    return f"(coalesce(sum({expr}) OVER {_over(key, w)}, 0) + coalesce(sum({expr}) OVER peer, 0))"


def _count(key, w):
    return f"(count(*) OVER {_over(key, w)} + count(*) OVER peer)"


STRENGTH = "coalesce(CASE auth_method WHEN 'passkey' THEN 5 WHEN 'biometric' THEN 4 WHEN '3ds2' THEN 4 WHEN 'upi_pin' " \
           "THEN 3 WHEN 'voice_print' THEN 2 WHEN 'otp_sms' THEN 2 WHEN 'cvv_only' THEN 1 WHEN 'none' THEN 0 END, 2)::DOUBLE"

PAYER_SQL = f"""
{RANKED},
u1 AS ({_self_join("payer", "payee", DAY, "led")}), u7 AS ({_self_join("payer", "payee", WEEK, "led")}),
base AS (SELECT *, log10(greatest(amount, 1.0::DOUBLE)) AS la, {STRENGTH} AS st FROM led),
pw AS (SELECT txn_id, la, st, ts_s, account_balance_ratio,
  {", ".join(f'{_count("payer", w)} AS n_{k}, {_trail("payer", "cents", w)} AS c_{k}' for k, w in SPANS.items())},
  {_trail("payer", "payee_is_first_time", WEEK)} AS novel,
  count(*) OVER prior AS n, avg(la) OVER prior AS mean, stddev_pop(la) OVER prior AS sd, avg(st) OVER prior AS st_mean,
  lag(ts_s) OVER seqd AS prev_ts, lag(device_id) OVER seqd AS prev_dev, device_id, lag(st) OVER seqd AS prev_st
  FROM base {LPEER.format(key="payer")}, seqd AS (PARTITION BY payer ORDER BY ts_s, ord)),
payer_f AS (SELECT pw.txn_id,
  {", ".join(f'n_{k} AS f_payer_txn_count_{k}, c_{k} / 100.0::DOUBLE AS f_payer_amount_sum_{k}' for k in SPANS)},
  n AS f_payer_prior_txn_count, R(mean, 4) AS f_payer_log_amount_mean,
  CASE WHEN n >= 3 THEN R((la - mean) / greatest(sd, 0.12::DOUBLE), 4) END AS f_payer_amount_zscore,
  CASE WHEN n >= 3 THEN R(la - mean, 4) END AS f_payer_amount_ratio_to_mean,
  (ts_s - prev_ts)::DOUBLE AS f_payer_seconds_since_prev,
  R(log10(CASE WHEN ts_s - prev_ts < 1 THEN 1.0 ELSE (ts_s - prev_ts)::DOUBLE END), 4) AS f_payer_log_seconds_since_prev,
  u1.u AS f_payer_unique_payees_24h, u7.u AS f_payer_unique_payees_7d, novel::DOUBLE AS f_payer_new_payees_7d,
  R(account_balance_ratio, 5) AS f_balance_drain_ratio,
  CASE WHEN prev_dev <> device_id THEN 1 ELSE 0 END AS f_payer_device_changed,
  st AS f_auth_strength, coalesce(st - prev_st, 0) AS f_auth_strength_delta,
  CASE WHEN st < prev_st THEN 1 ELSE 0 END AS f_auth_method_downgraded,
  CASE WHEN n >= 3 THEN R(st - st_mean, 4) ELSE 0 END AS f_auth_strength_vs_baseline
  FROM pw JOIN u1 USING (txn_id) JOIN u7 USING (txn_id))"""

PAYEE_SQL = f"""
v1 AS ({_self_join("payee", "payer", HOUR, "led")}), v7 AS ({_self_join("payee", "payer", WEEK, "led")}),
ew AS (SELECT txn_id, {", ".join(f'{_count("payee", w)} AS n_{k}, {_trail("payee", "cents", w)} AS c_{k}'
                               for k, w in SPANS.items() if k != "15m")} FROM led {LPEER.format(key="payee")}),
payee_f AS (SELECT ew.txn_id,
  {", ".join(f'n_{k} AS f_payee_txn_count_{k}, c_{k} / 100.0::DOUBLE AS f_payee_amount_sum_{k}' for k in SPANS if k != "15m")},
  v1.u AS f_payee_unique_payers_1h, v7.u AS f_payee_unique_payers_7d,
  R(n_1h / greatest(n_7d / 168.0::DOUBLE, 0.02::DOUBLE), 3) AS f_payee_fanin_acceleration
  FROM ew JOIN v1 USING (txn_id) JOIN v7 USING (txn_id))"""

MSPAN = {"10m": 600, "1h": HOUR, "24h": DAY}
MERCHANT_SQL = f"""
mled AS (SELECT *, log10(greatest(amount, 1.0::DOUBLE)) AS la, CASE WHEN amount < 100 THEN 1 ELSE 0 END AS micro
         FROM led WHERE merchant_id <> ''),
m1 AS ({_self_join("merchant_id", "payer", HOUR, "mled")}),
mw AS (SELECT txn_id, la, {", ".join(f'{_count("merchant_id", w)} AS n_{k}, {_trail("merchant_id", "cents", w)} AS c_{k}'
                                     for k, w in MSPAN.items())},
  {_trail("merchant_id", "micro", HOUR)} AS micro_1h, count(*) OVER prior AS n, avg(la) OVER prior AS mean,
  stddev_pop(la) OVER prior AS sd FROM mled {LPEER.format(key="merchant_id")}),
merchant_f AS (SELECT led.txn_id,
  {", ".join(f'n_{k} AS f_merchant_txn_count_{k}, c_{k} / 100.0::DOUBLE AS f_merchant_amount_sum_{k}' for k in MSPAN)},
  m1.u AS f_merchant_unique_payers_1h,
  CASE WHEN n_1h > 0 THEN R(micro_1h / n_1h, 4) END AS f_merchant_micro_txn_share_1h,
  CASE WHEN n >= 5 THEN R((la - mean) / greatest(sd, 0.15::DOUBLE), 4) END AS f_merchant_amount_zscore
  FROM led LEFT JOIN mw USING (txn_id) LEFT JOIN m1 USING (txn_id))"""

DEVICE_SQL = f"""
dled AS (SELECT * FROM led WHERE device_id <> ''),
d7 AS ({_self_join("device_id", "payer", WEEK, "dled")}),
dw AS (SELECT txn_id, {_count("device_id", DAY)} AS n_24h FROM dled {LPEER.format(key="device_id")}),
df AS (SELECT txn_id, R((ts_s - min(ts_s) OVER (PARTITION BY device_id)) / 86400.0::DOUBLE, 3) AS age FROM led),
device_f AS (SELECT df.txn_id, d7.u AS f_device_unique_payers_7d, n_24h AS f_device_txn_count_24h,
  age AS f_device_first_seen_days FROM df LEFT JOIN d7 USING (txn_id) LEFT JOIN dw USING (txn_id))"""

AG = "CASE WHEN initiated_by_agent = 1 THEN {} ELSE 0 END"
ROW_SQL = f"""
row_f AS (SELECT txn_id, R(log10(greatest(amount, 1.0::DOUBLE)), 4) AS f_log_amount,
  CASE WHEN abs(amount % 100) <= 1e-8 THEN 1 ELSE 0 END AS f_amount_is_round_100,
  CASE WHEN abs(amount % 1000) <= 1e-8 THEN 1 ELSE 0 END AS f_amount_is_round_1000,
  CASE WHEN (amount > 42500 AND amount < 50000) OR (amount > 85000 AND amount < 100000)
         OR (amount > 170000 AND amount < 200000) THEN 1 ELSE 0 END AS f_amount_near_threshold,
  CASE WHEN payee_added_minutes_ago < 60 THEN 1 ELSE 0 END AS f_payee_added_recently,
  R(log10(greatest(payee_added_minutes_ago, 0.1::DOUBLE)), 4) AS f_log_payee_added_minutes,
  R(1 - payee_name_match_score, 4) AS f_cop_shortfall,
  screen_share_active + remote_access_app_detected + accessibility_service_active + call_in_progress AS f_coercion_signal_count,
  CASE WHEN keystroke_flight_cv > 0 THEN abs(keystroke_flight_cv - 0.42::DOUBLE) END AS f_keystroke_cv_deviation,
  CASE WHEN NOT keystroke_flight_cv > 0 AND channel <> 'pos' THEN 1 ELSE 0 END AS f_no_human_telemetry,
  CASE WHEN auth_method IN ('cvv_only', 'none', 'otp_sms') AND amount > 25000 THEN 1 ELSE 0 END AS f_auth_weak_for_amount,
  is_irrevocable_rail * payee_is_first_time AS f_irrevocable_and_new_payee,
  {AG.format("CASE WHEN intent_token_present = 0 OR intent_signature_valid = 0 OR intent_payee_match = 0 THEN 1 ELSE 0 END")}
    AS f_intent_unverified,
  {AG.format("intent_amount_delta_ratio")} AS f_intent_amount_drift,
  {AG.format("agent_untrusted_content_tokens / greatest(agent_tool_calls, 1)")} AS f_agent_untrusted_per_tool_call,
  {AG.format("1 - agent_is_registered")} AS f_agent_unregistered,
  {AG.format("CASE WHEN intent_age_s > 1800 THEN 1 ELSE 0 END")} AS f_agent_stale_intent,
  {AG.format("spt_reuse_count")} AS f_agent_token_reused,
  {AG.format("CASE WHEN merchant_domain_age_days < 90 THEN 1 ELSE 0 END")} AS f_agent_new_merchant FROM ledger)"""


def _features(df, prefix="f_"):
    return df.select("txn_id", *[c for c in df.columns if c.startswith(prefix)])


@query("features_payer", f"WITH {PAYER_SQL} SELECT * FROM payer_f", ("ledger",))
def features_payer(spark, sf_dir):
    rows = ledger(spark, sf_dir, ["txn_id", *ORD, "ts_s", "payer", "payee", "amount", "payee_is_first_time",
                                  "account_balance_ratio", "device_id", "auth_method"])
    return _features(features.payer_features(rows, ORD))


@query("features_payer_travel", """
SELECT txn_id, R(2 * 6371 * asin(sqrt(least(greatest(
    power(sin((radians(lat) - radians(plat)) / 2), 2)
    + cos(radians(plat)) * cos(radians(lat)) * power(sin((radians(lon) - radians(plon)) / 2), 2), 0), 1)))
  / (greatest(ts_s - pts, 60) / 3600.0::DOUBLE), 2) AS implied_speed_kmh
FROM (SELECT txn_id, ts_s, lat, lon, lag(lat) OVER w AS plat, lag(lon) OVER w AS plon, lag(ts_s) OVER w AS pts
      FROM payments WINDOW w AS (PARTITION BY payer ORDER BY ts_s, seq))
""", ("payments",))
def features_payer_travel(spark, sf_dir):
    rows = payments(spark, sf_dir, ["txn_id", "seq", "ts_s", "payer", "lat", "lon"])
    h = causal.entity_history(rows, "payer", last=["ts_s", "lat", "lon"])
    hours = F.greatest(F.col("ts_s") - F.col("prev_ts_s"), F.lit(60)) / F.lit(3600.0)
    km = fx.haversine_km(F.col("prev_lat"), F.col("prev_lon"), F.col("lat"), F.col("lon"))
    return h.select("txn_id", fx.rounded(km / hours, 2).alias("implied_speed_kmh"))


@query("features_payee", f"WITH {RANKED}, {PAYEE_SQL} SELECT * FROM payee_f", ("ledger",))
def features_payee(spark, sf_dir):
    rows = ledger(spark, sf_dir, ["txn_id", *ORD, "ts_s", "payer", "payee"])
    return _features(features.payee_features(rows, ORD))


@query("features_merchant", f"WITH {RANKED}, {MERCHANT_SQL} SELECT * FROM merchant_f", ("ledger",))
def features_merchant(spark, sf_dir):
    rows = ledger(spark, sf_dir, ["txn_id", *ORD, "ts_s", "payer", "merchant_id", "amount"])
    return _features(features.merchant_features(rows, ORD))


@query("features_device", f"WITH {RANKED}, {DEVICE_SQL} SELECT * FROM device_f", ("ledger",))
def features_device(spark, sf_dir):
    rows = ledger(spark, sf_dir, ["txn_id", *ORD, "ts_s", "payer", "device_id"])
    return _features(features.device_features(rows, ORD))


@query("features_instruction_and_agent", f"WITH {ROW_SQL} SELECT * FROM row_f", ("ledger",))
def features_instruction_and_agent(spark, sf_dir):
    return _features(features.row_features(ledger(spark, sf_dir, LINE_COLUMNS)))


@query("features_all", f"""WITH {PAYER_SQL}, {PAYEE_SQL}, {MERCHANT_SQL}, {DEVICE_SQL}, {ROW_SQL}
SELECT * FROM payer_f JOIN payee_f USING (txn_id) JOIN merchant_f USING (txn_id) JOIN device_f USING (txn_id)
JOIN row_f USING (txn_id)""", ("ledger",))
def features_all(spark, sf_dir):
    return _features(features.build_features(stored(ledger(spark, sf_dir)), ORD))
