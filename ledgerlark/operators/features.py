"""Behavioural features: a payment relative to the history of its payer, payee, merchant and device.

Each builder takes and returns the payments table. Column names of the input are fixed by the
payment schema (see ``sources.schema``); ``seq`` lists the columns that order rows of one second.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalar as fx
from . import causal

HOUR, DAY, WEEK = 3_600, 86_400, 604_800
MONEY = "cents"


def _money(name: str):
    return (F.col(name) / 100.0).cast("double")


def _drop(df: DataFrame, keep: Sequence[str], made: dict) -> DataFrame:
    return df.select(*keep, *[c.alias(n) for n, c in made.items()])


def enrich(df: DataFrame, seq: Sequence[str] = ("seq",), reg_lag: str | None = "reg_lag_s") -> DataFrame:
    """What is known about the payee when the payment arrives."""
    keep = df.columns
    paid = causal.entity_history(
        df, "payee", seq=seq, sums=[MONEY], windows=[DAY], distinct={"payer": [DAY]}, first_seen=True, totals=["n"]
    )
    paid = _drop(paid, keep, {
        "payee_prior_txn_count": F.col("n_before"),
        "payee_age_days": fx.rounded((F.col("ts_s") - F.col("first_ts")) / F.lit(86400.0), 4),
        "payee_inbound_amount_24h": _money(f"{MONEY}_{DAY}"),
        "payee_inbound_unique_payers_24h": F.col(f"uniq_payer_{DAY}"),
    })
    pairs = causal.entity_history(paid, ["payer", "payee"], seq=seq, first_seen=True)
    lag = F.col(reg_lag) if reg_lag else F.lit(3600.0)
    known = F.when(F.col("n_before") == 0, lag).otherwise(F.col("ts_s") - F.least("first_ts", "ts_s") + lag)
    pairs = pairs.select(
        *paid.columns, fx.flag(F.col("n_before") == 0).alias("payee_is_first_time"),
        fx.rounded(F.least(known / 60.0, F.lit(525600.0)), 3).alias("payee_added_minutes_ago"),
    )
    out = causal.cross_window_sum(df, "payer", df, "payee", value=MONEY, window=DAY, name="_out")
    joined = pairs.join(out, ["payee", "ts_s"], "left")
    ratio = (F.coalesce("_out", F.lit(0)) / 100.0) / F.greatest(F.col("payee_inbound_amount_24h"), F.lit(1.0))
    return joined.select(*pairs.columns, fx.rounded(ratio, 4).alias("payee_outbound_ratio_24h"))


def payer_features(df: DataFrame, seq: Sequence[str] = ("seq",), geo: tuple[str, str] | None = None) -> DataFrame:
    """Payer velocity, spending baseline, counterparties, device change and login strength."""
    keep = df.columns
    work = df.select(
        "*", fx.log_amount(F.col("amount")).alias("_la"),
        fx.lookup(F.col("auth_method"), fx.AUTH_STRENGTH, 2).cast("double").alias("_st"),
    ).withColumn("_la2", F.col("_la") * F.col("_la"))
    last = ["ts_s", "device_id", "_st", *(geo or ())]
    h = causal.entity_history(
        work, "payer", seq=seq, sums=[MONEY, "_la", "_la2", "_st", "payee_is_first_time"],
        windows=[900, HOUR, DAY, WEEK], distinct={"payee": [DAY, WEEK]}, last=last,
        totals=["n", "_la", "_la2", "_st"], trailing=[MONEY, "payee_is_first_time"],
    )
    mean = causal.prior_mean("_la_before", "n_before")
    std = causal.prior_std("_la_before", "_la2_before", "n_before")
    enough = F.col("n_before") >= 3
    gap = F.col("ts_s") - F.col("prev_ts_s")
    strength = F.col("_st")
    made = {}
    for label, w in {"1h": HOUR, "24h": DAY, "7d": WEEK, "15m": 900}.items():
        made[f"f_payer_txn_count_{label}"] = F.col(f"n_{w}")
        made[f"f_payer_amount_sum_{label}"] = _money(f"{MONEY}_{w}")
    made |= {
        "f_payer_prior_txn_count": F.col("n_before"),
        "f_payer_log_amount_mean": fx.rounded(mean, 4),
        "f_payer_amount_zscore": F.when(enough, fx.rounded((F.col("_la") - mean) / F.greatest(std, F.lit(0.12)), 4)),
        "f_payer_amount_ratio_to_mean": F.when(enough, fx.rounded(F.col("_la") - mean, 4)),
        "f_payer_seconds_since_prev": gap.cast("double"),
        "f_payer_log_seconds_since_prev": F.when(
            gap.isNotNull(), fx.rounded(F.log10(F.greatest(gap.cast("double"), F.lit(1.0))), 4)),
        "f_payer_unique_payees_24h": F.col(f"uniq_payee_{DAY}"),
        "f_payer_unique_payees_7d": F.col(f"uniq_payee_{WEEK}"),
        "f_payer_new_payees_7d": F.col(f"payee_is_first_time_{WEEK}").cast("double"),
        "f_balance_drain_ratio": fx.rounded("account_balance_ratio", 5),
        "f_payer_device_changed": fx.flag(F.col("prev_device_id") != F.col("device_id")),
        "f_auth_strength": strength,
        "f_auth_strength_delta": F.coalesce(strength - F.col("prev__st"), F.lit(0.0)),
        "f_auth_method_downgraded": fx.flag(strength < F.col("prev__st")),
        "f_auth_strength_vs_baseline": F.when(
            enough, fx.rounded(strength - causal.prior_mean("_st_before", "n_before"), 4)).otherwise(0.0),
    }
    if geo:
        lat, lon = geo
        hours = F.greatest(gap, F.lit(60)) / F.lit(3600.0)
        made["f_implied_speed_kmh"] = fx.rounded(
            fx.haversine_km(F.col(f"prev_{lat}"), F.col(f"prev_{lon}"), F.col(lat), F.col(lon)) / hours, 2)
    return _drop(h, keep, made)


def payee_features(df: DataFrame, seq: Sequence[str] = ("seq",)) -> DataFrame:
    """Inbound velocity and fan-in of the payee."""
    h = causal.entity_history(
        df, "payee", seq=seq, sums=[MONEY], windows=[HOUR, DAY, WEEK], distinct={"payer": [HOUR, WEEK]}, totals=[]
    )
    made = {}
    for label, w in {"1h": HOUR, "24h": DAY, "7d": WEEK}.items():
        made[f"f_payee_txn_count_{label}"] = F.col(f"n_{w}")
        made[f"f_payee_amount_sum_{label}"] = _money(f"{MONEY}_{w}")
    made |= {
        "f_payee_unique_payers_1h": F.col(f"uniq_payer_{HOUR}"),
        "f_payee_unique_payers_7d": F.col(f"uniq_payer_{WEEK}"),
        "f_payee_fanin_acceleration": fx.rounded(
            F.col(f"n_{HOUR}") / F.greatest(F.col(f"n_{WEEK}") / F.lit(168.0), F.lit(0.02)), 3),
    }
    return _drop(h, df.columns, made)


def merchant_features(df: DataFrame, seq: Sequence[str] = ("seq",)) -> DataFrame:
    """Merchant velocity, tiny-ticket share and price deviation; NULL without a merchant.

    Rows without a merchant never enter the scan: together they would be its largest key.
    """
    named, unnamed = df.where("merchant_id <> ''"), df.where("merchant_id = '' OR merchant_id IS NULL")
    work = named.select(
        "*", fx.log_amount(F.col("amount")).alias("_la"), fx.flag(F.col("amount") < 100).alias("_micro")
    ).withColumn("_la2", F.col("_la") * F.col("_la"))
    h = causal.entity_history(
        work, "merchant_id", seq=seq, sums=[MONEY, "_la", "_la2", "_micro"], windows=[600, HOUR, DAY],
        distinct={"payer": [HOUR]}, totals=["n", "_la", "_la2"], trailing=[MONEY, "_micro"],
    )
    mean = causal.prior_mean("_la_before", "n_before")
    std = causal.prior_std("_la_before", "_la2_before", "n_before")
    made = {}
    for label, w in {"10m": 600, "1h": HOUR, "24h": DAY}.items():
        made[f"f_merchant_txn_count_{label}"] = F.col(f"n_{w}")
        made[f"f_merchant_amount_sum_{label}"] = _money(f"{MONEY}_{w}")
    made |= {
        "f_merchant_unique_payers_1h": F.col(f"uniq_payer_{HOUR}"),
        "f_merchant_micro_txn_share_1h": F.when(
            F.col(f"n_{HOUR}") > 0, fx.rounded(F.col(f"_micro_{HOUR}") / F.col(f"n_{HOUR}"), 4)),
        "f_merchant_amount_zscore": F.when(
            F.col("n_before") >= 5, fx.rounded((F.col("_la") - mean) / F.greatest(std, F.lit(0.15)), 4)),
    }
    return _drop(h, df.columns, made).unionByName(unnamed, allowMissingColumns=True)


def device_features(df: DataFrame, seq: Sequence[str] = ("seq",)) -> DataFrame:
    """Payers per device, device velocity and age of the device.

    Rows without a device skip the scan; only the first-seen age is kept for them.
    """
    named, unnamed = df.where("device_id <> ''"), df.where("device_id = '' OR device_id IS NULL")
    h = causal.entity_history(
        named, "device_id", seq=seq, windows=[DAY], distinct={"payer": [WEEK]}, first_seen=True, totals=[]
    )
    age = lambda first: fx.rounded((F.col("ts_s") - first) / F.lit(86400.0), 3)
    made = {
        "f_device_unique_payers_7d": F.col(f"uniq_payer_{WEEK}"),
        "f_device_txn_count_24h": F.col(f"n_{DAY}"),
        "f_device_first_seen_days": age(F.col("first_ts")),
    }
    start = unnamed.groupBy(F.col("device_id").alias("_id")).agg(F.min("ts_s").alias("_first"))  # blank and NULL: two rows
    bare = unnamed.join(F.broadcast(start), F.col("device_id").eqNullSafe(F.col("_id"))).select(
        *df.columns, age(F.col("_first")).alias("f_device_first_seen_days"))
    return _drop(h, df.columns, made).unionByName(bare, allowMissingColumns=True)


def instruction_columns() -> dict:
    """Features of the instruction alone."""
    amount, cv = F.col("amount"), F.col("keystroke_flight_cv")
    return {
        "f_log_amount": fx.rounded(fx.log_amount(amount), 4),
        "f_amount_is_round_100": fx.is_multiple(amount, 100),
        "f_amount_is_round_1000": fx.is_multiple(amount, 1000),
        "f_amount_near_threshold": fx.near_limit(amount),
        "f_payee_added_recently": fx.flag(F.col("payee_added_minutes_ago") < 60),
        "f_log_payee_added_minutes": fx.rounded(F.log10(F.greatest(F.col("payee_added_minutes_ago"), F.lit(0.1))), 4),
        "f_cop_shortfall": fx.rounded(1.0 - F.col("payee_name_match_score"), 4),
        "f_coercion_signal_count": F.col("screen_share_active") + F.col("remote_access_app_detected")
        + F.col("accessibility_service_active") + F.col("call_in_progress"),
        "f_keystroke_cv_deviation": F.when(cv > 0, F.abs(cv - 0.42)),
        "f_no_human_telemetry": fx.flag(~F.coalesce(cv > 0, F.lit(False)) & (F.col("channel") != "pos")),
        "f_auth_weak_for_amount": fx.flag(F.col("auth_method").isin(fx.WEAK_AUTH) & (amount > 25_000)),
        "f_irrevocable_and_new_payee": fx.flag(
            (F.col("is_irrevocable_rail") == 1) & (F.col("payee_is_first_time") == 1)),
    }


def agent_columns() -> dict:
    """Delegation features; 0 for payments no agent made."""
    agent = F.col("initiated_by_agent") == 1
    only = lambda c, zero: F.when(agent, c).otherwise(F.lit(zero))
    unverified = (
        (F.col("intent_token_present") == 0) | (F.col("intent_signature_valid") == 0)
        | (F.col("intent_payee_match") == 0)
    )
    return {
        "f_intent_unverified": only(fx.flag(unverified), 0),
        "f_intent_amount_drift": only(F.col("intent_amount_delta_ratio"), 0.0),
        "f_agent_untrusted_per_tool_call": only(
            F.col("agent_untrusted_content_tokens") / F.greatest(F.col("agent_tool_calls"), F.lit(1)), 0.0),
        "f_agent_unregistered": only(fx.flag(F.col("agent_is_registered") == 0), 0),
        "f_agent_stale_intent": only(fx.flag(F.col("intent_age_s") > 1800), 0),
        "f_agent_token_reused": only(F.col("spt_reuse_count"), 0),
        "f_agent_new_merchant": only(fx.flag(F.col("merchant_domain_age_days") < 90), 0),
    }


def row_features(df: DataFrame) -> DataFrame:
    made = instruction_columns() | agent_columns()
    return df.select("*", *[c.alias(n) for n, c in made.items()])


def build_features(
    df: DataFrame, seq: Sequence[str] = ("seq",), geo: tuple[str, str] | None = None, key: str = "txn_id"
) -> DataFrame:
    """All ``f_`` columns; non-finite values become NULL.

    Each entity works on the same input and the results meet on the payment id, so no entity's scan
    is repeated inside another's. Cut the lineage of ``df`` first when it is costly to compute.
    """
    out = row_features(df)
    read = lambda *names: df.select(*dict.fromkeys([key, "ts_s", *seq, MONEY, *names]))
    made = [
        payer_features(read("payer", "payee", "amount", "auth_method", "payee_is_first_time", "account_balance_ratio", "device_id", *(geo or ())), seq, geo),
        payee_features(read("payee", "payer"), seq), merchant_features(read("merchant_id", "payer", "amount"), seq), device_features(read("device_id", "payer"), seq),
    ]
    for part in made:
        out = out.join(part.select(key, *feature_columns(part)), key)
    doubles = {n for n, t in out.dtypes if t == "double" and n.startswith("f_")}
    return out.select(*[fx.finite(F.col(c)).alias(c) if c in doubles else F.col(c) for c in out.columns])


def feature_columns(df: DataFrame, prefix: str = "f_") -> list[str]:
    return [c for c in df.columns if c.startswith(prefix)]
