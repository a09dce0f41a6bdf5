"""Given tables, and the payment views the operators run on.

The view columns are SQL expressions that Spark and any ANSI engine read alike, so a checking
engine can rebuild the same input without going through Spark.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from ..session import configure


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    configure(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: A number per ledger line, spread by integer arithmetic only.
MIX = "(l_orderkey*31 + l_partkey*17 + l_linenumber*7 + l_suppkey*101)"
FRAUD = "(l_returnflag = 'R' AND l_quantity <= 10)"


def _pct(salt: int, modulus: int) -> str:
    return f"(({MIX}*{salt}) % {modulus})"


def _flag(condition: str) -> str:
    return f"CAST(CASE WHEN {condition} THEN 1 ELSE 0 END AS BIGINT)"


#: One payment per order line. Seconds come from the ship date plus a minute of the day, so a busy
#: account has both ties and gaps. ``{epoch}`` is the engine's spelling of "seconds of l_shipdate".
LEDGER_COLUMNS: dict[str, str] = {
    "txn_id": "concat(CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING), '-', CAST(l_partkey AS STRING),"
              " '-', CAST(l_suppkey AS STRING), '-', CAST(CAST(round(l_extendedprice*100) AS BIGINT) AS STRING))",
    "seq": "l_orderkey",
    "line": "CAST(l_linenumber AS BIGINT)",
    "item": "l_partkey",
    "supp": "l_suppkey",
    "ts_s": f"{{epoch}} + 60*({_pct(37, 1440)})",
    "day": "CAST(floor({epoch} / 86400) AS BIGINT)",
    "payer": "concat('A', CAST(o_custkey AS STRING))",
    "payee": "concat('A', CAST(l_suppkey AS STRING))",
    "merchant_id": "CASE WHEN l_partkey % 5 = 0 THEN '' ELSE concat('M', CAST(l_partkey % 400 AS STRING)) END",
    "device_id": "CASE WHEN l_linenumber = 7 THEN '' ELSE concat('D', CAST((o_custkey*3 + l_linenumber % 2) % 701 AS STRING)) END",
    "rail": "CASE l_linenumber % 5 WHEN 0 THEN 'card' WHEN 1 THEN 'upi' WHEN 2 THEN 'imps' WHEN 3 THEN 'neft' ELSE 'swift' END",
    "channel": "CASE WHEN l_linestatus = 'O' THEN 'app' WHEN l_partkey % 3 = 0 THEN 'pos' ELSE 'web' END",
    "currency": "CASE WHEN l_linenumber % 5 = 4 THEN 'USD' WHEN l_suppkey % 9 = 0 THEN 'EUR' ELSE 'INR' END",
    "amount": "l_extendedprice",
    "cents": "CAST(round(l_extendedprice*100) AS BIGINT)",
    "auth_method": "CASE " + " ".join(
        f"WHEN {_pct(11, 9)} = {i} THEN '{m}'" for i, m in enumerate(
            ["passkey", "biometric", "3ds2", "upi_pin", "voice_print", "otp_sms", "cvv_only", "none"])
    ) + " ELSE 'hardware_key' END",
    "is_fraud": _flag(FRAUD),
    "fraud_type": f"CASE WHEN {FRAUD} THEN concat('F', CAST(l_suppkey % 4 AS STRING)) ELSE '' END",
    "attack_vector_id": f"CASE WHEN {FRAUD} THEN concat('V', CAST(l_suppkey % 12 AS STRING)) ELSE '' END",
    "campaign_id": f"CASE WHEN {FRAUD} AND l_partkey % 4 <> 0 THEN concat('C', CAST(o_custkey % 50 AS STRING)) ELSE '' END",
    "mule_ring_id": f"CASE WHEN {FRAUD} AND l_suppkey % 3 = 0 THEN concat('R', CAST(l_suppkey AS STRING)) ELSE '' END",
    "is_hard_negative": _flag(f"NOT {FRAUD} AND l_quantity > 45"),
    "evasion_applied": _flag(f"{FRAUD} AND l_discount > 0.055 AND l_suppkey % 12 < 8"),
    "customer_age_band_ord": "o_custkey % 6",
    "customer_digital_literacy": "(o_custkey % 101) / CAST(100 AS DOUBLE)",
    "payee_account_age_days": "CAST((l_suppkey*13) % 1000 AS DOUBLE)",
    "payee_added_minutes_ago": f"CAST({_pct(29, 5000)} AS DOUBLE)",
    "payee_is_first_time": _flag(f"{_pct(53, 10)} < 3 OR ({FRAUD} AND {_pct(53, 10)} < 6)"),
    "payee_name_match_score": f"{_pct(61, 101)} / CAST(100 AS DOUBLE)",
    "payee_inbound_unique_payers_24h": f"{_pct(67, 12)}",
    "screen_share_active": _flag(f"{_pct(71, 100)} < 4"),
    "remote_access_app_detected": _flag(f"{_pct(73, 100)} < 3"),
    "accessibility_service_active": _flag(f"{_pct(79, 100)} < 5"),
    "call_in_progress": _flag(f"{_pct(83, 100)} < 8 OR ({FRAUD} AND {_pct(83, 100)} < 30)"),
    "device_is_emulator": _flag(f"{_pct(89, 100)} < 2"),
    "device_is_new": _flag(f"{_pct(97, 100)} < 12"),
    "sim_swap_recency_days": f"CAST({_pct(103, 400)} AS DOUBLE)",
    "auth_attempts": f"1 + {_pct(107, 4)}",
    "keystroke_flight_cv": f"CASE WHEN {_pct(109, 7)} = 0 THEN CAST(0 AS DOUBLE) ELSE {_pct(113, 90)} / CAST(100 AS DOUBLE) END",
    "account_balance_ratio": f"{_pct(127, 1000)} / CAST(1000 AS DOUBLE)",
    "is_irrevocable_rail": _flag("l_linenumber % 5 IN (1, 2)"),
    "is_night": _flag(f"({_pct(37, 1440)}) < 360 OR ({_pct(37, 1440)}) >= 1380"),
    "initiated_by_agent": _flag("l_linenumber <= 2"),
    "agent_is_registered": _flag(f"{_pct(131, 10)} < 8"),
    "agent_identity_asserted": _flag(f"{_pct(137, 10)} < 7"),
    "agent_request_signature_valid": _flag(f"{_pct(139, 10)} < 9"),
    "intent_token_present": _flag(f"{_pct(149, 10)} < 8"),
    "intent_signature_valid": _flag(f"{_pct(151, 20)} < 19"),
    "intent_payee_match": _flag(f"{_pct(157, 20)} < 18"),
    "intent_amount_delta_ratio": f"{_pct(163, 300)} / CAST(1000 AS DOUBLE)",
    "intent_age_s": f"CAST({_pct(167, 4000)} AS DOUBLE)",
    "agent_tool_calls": f"{_pct(173, 6)}",
    "agent_untrusted_content_tokens": f"{_pct(179, 3000)}",
    "spt_scope_violation": _flag(f"{_pct(181, 25)} = 0"),
    "spt_reuse_count": f"{_pct(191, 30)} / 10" ,
    "merchant_domain_age_days": f"CAST({_pct(193, 900)} AS DOUBLE)",
    "agent_injection_score": f"CASE WHEN l_linenumber <= 2 THEN {_pct(197, 1000)} / CAST(1000 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END",
    "agent_injection_flag": _flag(f"l_linenumber <= 2 AND {_pct(197, 1000)} >= 900"),
    "vishing_score": f"CASE WHEN {_pct(83, 100)} < 30 THEN {_pct(199, 1000)} / CAST(1000 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END",
    "vishing_flag": _flag(f"{_pct(83, 100)} < 30 AND {_pct(199, 1000)} >= 930"),
    "vishing_covered": _flag(f"{_pct(83, 100)} < 30"),
    "score": f"(CASE WHEN {FRAUD} THEN 250 + {_pct(7919, 750)} ELSE {_pct(7919, 900)} END) / CAST(1000 AS DOUBLE)",
    "score_b": f"(CASE WHEN {FRAUD} THEN 150 + {_pct(6007, 850)} ELSE {_pct(6007, 950)} END) / CAST(1000 AS DOUBLE)",
}
LEDGER_COLUMNS["spt_reuse_count"] = f"CAST(floor({_pct(191, 30)} / 10) AS BIGINT)"

def _capture(salt: int, often: int, low: int, high: int) -> str:
    """A score of one modality, captured on ``often`` in ten payments: fraud lies lower, a quarter of it as high as genuine payments."""
    fraud = f"{FRAUD} AND {_pct(salt + 2, 4)} > 0"
    return (f"CASE WHEN {_pct(salt, 10)} < {often} THEN (CASE WHEN {fraud} THEN {low} + {_pct(salt + 6, 500)} ELSE {high} + {_pct(salt + 6, 1000 - high)} END) / CAST(1000 AS DOUBLE)"
            " ELSE CAST(0 AS DOUBLE) END")


#: Telemetry of biometric captures; 0 where nothing was captured.
CAPTURE_COLUMNS: dict[str, str] = {
    **{c: LEDGER_COLUMNS[c] for c in ("txn_id", "ts_s", "is_fraud", "attack_vector_id")},
    "voice_match_score": _capture(211, 3, 150, 600),
    "liveness_score": _capture(227, 4, 100, 550),
    "biometric_match_score": _capture(239, 4, 250, 700),
    "doc_ocr_confidence": _capture(251, 2, 350, 500),
}

#: The columns that need no order.
LINE_COLUMNS = [c for c, text in LEDGER_COLUMNS.items() if not re.search(r"\bo_", text)]

#: One payment per event; accounts that pay and accounts that are paid share one id space.
EVENT_COLUMNS: dict[str, str] = {
    "txn_id": "CAST(event_id AS STRING)",
    "seq": "event_id",
    "ts_s": "{epoch}",
    "day": "CAST(floor({epoch} / 86400) AS BIGINT)",
    "payer": "concat('A', CAST(user_id AS STRING))",
    "payee": "concat('A', {props_k})",
    "rail": "event_type",
    "amount": "value",
    "cents": "CAST(round(value*100) AS BIGINT)",
    "is_fraud": "CAST(CASE WHEN event_type = 'error' AND event_id % 7 = 0 THEN 1 ELSE 0 END AS BIGINT)",
    "reg_lag_s": "CAST((event_id * 37) % 7200 AS DOUBLE)",
    "lat": "CAST((user_id * 7 + event_id) % 90 AS DOUBLE)",
    "lon": "CAST((user_id * 11 + event_id * 3) % 180 AS DOUBLE)",
}

SPARK_WORDS = {
    "ledger": {"epoch": "unix_seconds(CAST(l_shipdate AS TIMESTAMP))"},
    "events": {"epoch": "unix_seconds(CAST(ts AS TIMESTAMP))", "props_k": "get_json_object(props, '$.k')"},
}


def _select(columns: dict[str, str], words: dict[str, str]) -> list[str]:
    out = []
    for name, text in columns.items():
        for word, spelled in words.items():
            text = text.replace("{" + word + "}", spelled)
        out.append(f"{text} AS {name}")
    return out


def ledger(spark: SparkSession, sf_dir: str, columns: list[str] | None = None) -> DataFrame:
    """Labelled, scored payments from order lines. Name the columns needed; the scan prunes the rest.

    Every line has its order, so the orders are joined only if a chosen column reads one. Scores of captures go by their names.
    """
    chosen = {c: LEDGER_COLUMNS.get(c) or CAPTURE_COLUMNS[c] for c in (columns or LEDGER_COLUMNS)}
    rows = table(spark, sf_dir, "lineitem")
    if any(re.search(r"\bo_", text) for text in chosen.values()):
        orders = table(spark, sf_dir, "orders")
        rows = rows.join(orders, rows.l_orderkey == orders.o_orderkey)
    return rows.selectExpr(*_select(chosen, SPARK_WORDS["ledger"]))


def captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payments with the scores of their biometric captures."""
    return table(spark, sf_dir, "lineitem").selectExpr(*_select(CAPTURE_COLUMNS, SPARK_WORDS["ledger"]))


def payments(spark: SparkSession, sf_dir: str, columns: list[str] | None = None) -> DataFrame:
    """Payments from the event stream, with microsecond clocks floored to seconds."""
    chosen = {c: EVENT_COLUMNS[c] for c in (columns or EVENT_COLUMNS)}
    return table(spark, sf_dir, "events").selectExpr(*_select(chosen, SPARK_WORDS["events"]))
