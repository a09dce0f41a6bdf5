"""Deterministic controls: delegated-authority checks, decisions and their coverage tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalar as fx
from . import causal
from .ordered import attach_totals, exact_quantiles, wide_quantiles

# Tolerances, ages and the codes that decline or raise friction.
TOLERANCE, GROSS_MULTIPLE, INTENT_TTL_S, SIGNATURE_WINDOW_S = 0.05, 4.0, 1800, 60
INTENT_STEP_UP = ["INTENT_ABSENT", "AMOUNT_OVER_TOLERANCE"]
CONTROL_BLOCK = ["TOKEN_REPLAY_BLOCKED", "TOKEN_SCOPE_BLOCKED"]
CONTROL_STEP_UP = ["AGENT_IDENTITY_UNPROVEN"]
CEILING_QUANTILE, CEILING_MIN_ROWS = 0.99, 50


def intent_control(df: DataFrame, ttl_s: int = INTENT_TTL_S) -> DataFrame:
    """Check each agent payment against the instruction it presented.

    Every code but ABSENT needs a presented token, so a row without one is never declined here.
    """
    agent, c = F.col("initiated_by_agent") == 1, F.col
    seen = agent & (c("intent_token_present") == 1)
    delta = c("intent_amount_delta_ratio")
    gross = delta > TOLERANCE * GROSS_MULTIPLE
    codes = {
        "INTENT_ABSENT": agent & (c("intent_token_present") == 0),
        "INTENT_SIGNATURE_INVALID": seen & (c("intent_signature_valid") == 0),
        "INTENT_EXPIRED": seen & (c("intent_age_s") > ttl_s),
        "INTENT_REPLAYED": seen & (c("spt_reuse_count") >= 2),
        "PAYEE_MISMATCH": seen & (c("intent_payee_match") == 0),
        "AMOUNT_OVER_TOLERANCE": seen & (delta > TOLERANCE) & ~gross,
        "AMOUNT_EXCEEDS_INTENT": seen & gross,
        "SCOPE_VIOLATION": seen & (c("spt_scope_violation") == 1),
    }
    reasons = df.withColumn("_r", fx.reason_list(codes))
    hard = F.size(F.array_except("_r", F.array(*[F.lit(x) for x in INTENT_STEP_UP]))) > 0
    return reasons.select(
        *df.columns, fx.flag(hard).alias("intent_guard_blocked"),
        fx.flag(F.arrays_overlap("_r", F.array(*[F.lit(x) for x in INTENT_STEP_UP]))).alias("intent_guard_stepup"),
        fx.join_reasons(F.col("_r")).alias("intent_guard_reasons"), F.size("_r").cast("long").alias("intent_guard_violation_count"))


def agent_ceiling(df: DataFrame) -> DataFrame:
    """99th percentile of legitimate agent amounts; NULL with 50 rows or fewer."""
    legit = df.where("initiated_by_agent = 1 AND is_fraud = 0")
    q = wide_quantiles(exact_quantiles(legit, [], "amount", [CEILING_QUANTILE]), [], {CEILING_QUANTILE: "q"})
    return q.select(F.when(F.col("n") > CEILING_MIN_ROWS, F.col("q")).alias("ceiling"))


def agent_controls(df: DataFrame, paid: DataFrame | None = None) -> DataFrame:
    """Identity, token binding, scope and ceiling of agent payments. ``paid`` holds the same payments where ``df`` is costly to read twice."""
    agent, c = F.col("initiated_by_agent") == 1, F.col
    asserted = agent & (c("agent_identity_asserted") == 1)
    codes = {
        "AGENT_IDENTITY_UNPROVEN": asserted & (c("agent_request_signature_valid") != 1),
        "AGENT_UNTRUSTED_LANE": agent & (c("agent_identity_asserted") != 1),
        "TOKEN_REPLAY_BLOCKED": agent & (c("spt_reuse_count") >= 2),
        "TOKEN_SCOPE_BLOCKED": agent & (c("spt_scope_violation") == 1),
        "TOKEN_OVER_CEILING": agent & (c("amount") > c("ceiling")),
    }
    rows = attach_totals(df, agent_ceiling(df if paid is None else paid), []).withColumn("_r", fx.reason_list(codes))
    has = lambda names: fx.flag(F.arrays_overlap("_r", F.array(*[F.lit(x) for x in names])))
    return rows.select(
        *df.columns, has(CONTROL_BLOCK).alias("agent_control_blocked"), has(CONTROL_STEP_UP).alias("agent_control_stepup"),
        fx.join_reasons(F.col("_r")).alias("agent_control_reasons"), F.round("ceiling", 2).alias("agent_control_ceiling"))


def _vector() -> Column:
    return F.when(F.col("attack_vector_id") == "", "(legitimate)").otherwise(F.col("attack_vector_id")).alias("attack_vector_id")


def intent_coverage(df: DataFrame) -> DataFrame:
    """Per vector: block and step-up rates, and the commonest reason among blocked rows."""
    agent = df.where("initiated_by_agent = 1").withColumn("attack_vector_id", _vector())
    base = agent.groupBy("attack_vector_id").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("is_fraud").alias("is_fraud"), F.sum("intent_guard_blocked").alias("guard_blocked"),
        F.avg("intent_guard_blocked").alias("block_rate"), F.avg("intent_guard_stepup").alias("step_up_rate"))
    reasons = agent.where("intent_guard_blocked = 1").select(
        "attack_vector_id", F.explode(fx.split_reasons(F.col("intent_guard_reasons"))).alias("reason"))
    counted = reasons.groupBy("attack_vector_id", "reason").agg(F.count(F.lit(1)).alias("k"))
    top = counted.groupBy("attack_vector_id").agg(F.min(F.struct((-F.col("k")).alias("k"), "reason"))["reason"].alias("top_reason"))
    return base.join(top, "attack_vector_id", "left").fillna({"top_reason": ""})


def control_coverage(df: DataFrame) -> DataFrame:
    names = {"identity_unproven_rate": "AGENT_IDENTITY_UNPROVEN", "untrusted_lane_rate": "AGENT_UNTRUSTED_LANE",
             "token_binding_rate": "TOKEN_REPLAY_BLOCKED", "scope_rate": "TOKEN_SCOPE_BLOCKED", "over_ceiling_rate": "TOKEN_OVER_CEILING"}
    agent = df.where("initiated_by_agent = 1").withColumn("attack_vector_id", _vector())
    any_control = F.greatest("agent_control_blocked", "agent_control_stepup")
    return agent.groupBy("attack_vector_id").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("is_fraud").alias("is_fraud"),
        *[F.avg(F.col("agent_control_reasons").contains(code).cast("double")).alias(n) for n, code in names.items()],
        F.avg(any_control).alias("any_control_rate"), F.avg("agent_control_blocked").alias("blocked_rate"))


def ceiling_loss_bound(df: DataFrame) -> DataFrame:
    """What fraud would have taken had each payment stopped at the ceiling."""
    agent = attach_totals(df.where("initiated_by_agent = 1"), agent_ceiling(df), []).where("ceiling IS NOT NULL")
    fraud = F.col("is_fraud") == 1
    s = agent.agg(
        F.max("ceiling").alias("ceiling"), F.sum("is_fraud").alias("agentic_fraud_attempts"),
        F.sum(F.when(fraud, F.col("amount")).otherwise(0.0)).alias("a"),
        F.sum(F.when(fraud, F.least("amount", "ceiling")).otherwise(0.0)).alias("b"),
        F.avg(F.when(~fraud, (F.col("amount") > F.col("ceiling")).cast("double"))).alias("capped"))
    return s.where("agentic_fraud_attempts > 0").select(
        F.round("ceiling", 2).alias("ceiling"), "agentic_fraud_attempts", F.round("a", 2).alias("loss_standing_delegation"),
        F.round("b", 2).alias("loss_scoped_token"), F.round(F.col("a") - F.col("b"), 2).alias("loss_reduction"),
        F.when(F.col("a") > 0, F.round(100.0 * (F.col("a") - F.col("b")) / F.col("a"), 2)).alias("loss_reduction_pct"),
        F.round(100.0 * F.col("capped"), 3).alias("legit_payments_capped_pct"))


def decide(df: DataFrame, cut: float) -> DataFrame:
    """Alert if the model or either control says so; the outcome names blocks before alerts."""
    alert = fx.flag(F.col("score") >= cut)
    outcome = F.when(F.col("intent_guard_blocked") == 1, "intent_block").when(
        F.col("agent_control_blocked") == 1, "control_block").when(alert == 1, "alert").otherwise("approve")
    return df.select("*", alert.alias("model_alert"), F.greatest(alert, "intent_guard_blocked", "agent_control_blocked").alias("decision"),
                     outcome.alias("outcome"))


def verify_settlements(settlements: DataFrame, instructions: DataFrame, key: str, order: list[str], now: str = "now_s") -> DataFrame:
    """Settlement against signed instruction: absent and unsigned end the check, all else adds up.

    Only an accepted settlement spends its instruction. The first without any other reason is accepted, and all that come
    after it, by ``now`` and then ``order``, are replays.
    """
    j = settlements.join(instructions, key, "left")
    c = F.col
    rest = {
        "INTENT_EXPIRED": c(now) > c("expires_at"), "INTENT_REPLAYED": c("_clean_before") > 0,
        "PAYEE_MISMATCH": c("settle_payee") != c("payee_id"), "CURRENCY_MISMATCH": c("settle_currency") != c("currency"),
        "AMOUNT_EXCEEDS_INTENT": c("settle_amount") > c("max_amount") * (1 + TOLERANCE),
        "SCOPE_VIOLATION": F.size(F.array_except("requested_scope", "scope")) > 0,
    }
    only = lambda code: F.array(F.lit(code))
    others = [test for code, test in rest.items() if code != "INTENT_REPLAYED"]
    wrong = reduce(lambda a, b: a | b, [F.coalesce(t, F.lit(False)) for t in others]) | c("max_amount").isNull() | (c("signature_valid") == 0)
    j = causal.entity_history(j.withColumn("_clean", fx.flag(~wrong)), key, ts=now, seq=order, sums=["_clean"])
    reasons = F.when(c("max_amount").isNull(), only("INTENT_ABSENT")).when(
        c("signature_valid") == 0, only("INTENT_SIGNATURE_INVALID")).otherwise(fx.reason_list(rest))
    return j.select(*settlements.columns, fx.join_reasons(reasons).alias("reasons"), fx.flag(F.size(reasons) == 0).alias("allowed"))


def spent_before(df: DataFrame, key: Sequence[str], clean: Column, order: Sequence[str], name: str) -> DataFrame:
    """Adds ``name``: whether an earlier clean row has spent the row's ``key``, by ``order``.

    The first clean row is the one that is accepted; the clean ones behind it are not, so none of them matters. It is found by a
    partial minimum per key, which one key of any share of the rows does not slow, and a row is compared with that alone. A key
    with a null in it is a key of its own.
    """
    place, group = F.struct(*order), F.struct(*key)
    rows = df.withColumns({"_clean": clean, "_place": place, "_group": group})
    first = rows.where("_clean").groupBy("_group").agg(F.min("_place").alias("_first"))
    return rows.join(first, "_group", "left").withColumn(name, F.coalesce(F.col("_place") > F.col("_first"), F.lit(False))).drop("_clean", "_place", "_group", "_first")


def verify_agents(requests: DataFrame, registry: DataFrame, key: str, signature: str = "signature", order: Sequence[str] = ("now_s",)) -> DataFrame:
    """First failing check of an agent's identity; NULL when proved. ``registry`` has one row per agent.

    An accepted request spends its (agent, signature) pair: a later one, by ``order``, that fails nothing else is a replay.
    """
    j = requests.join(registry.select(key, F.lit(1).alias("_known")), key, "left")
    code = F.when(F.col("_known").isNull(), "AGENT_NOT_ENROLLED").when(
        F.abs(F.col("now_s") - F.col("created_s")) > SIGNATURE_WINDOW_S, "AGENT_SIGNATURE_STALE").when(
        F.coalesce("signature_valid", F.lit(0)) == 0, "AGENT_SIGNATURE_INVALID")
    seen = spent_before(j.withColumn("_code", code), [key, signature], F.col("_code").isNull(), order, "_seen")
    return seen.select(*requests.columns, F.coalesce("_code", F.when(F.col("_seen"), "AGENT_REQUEST_REPLAYED")).alias("reason"))


def redeem_tokens(redemptions: DataFrame, tokens: DataFrame, key: str, order: Sequence[str] = ("now_s",)) -> DataFrame:
    """All reasons a token redemption fails; a token that was never issued is ``TOKEN_UNKNOWN``.

    An authorised redemption spends a single-use token for all later ones, by ``order``.
    """
    c = F.col
    codes = {
        "TOKEN_NOT_BOUND_TO_PRESENTER": c("presenter") != c("holder"), "TOKEN_EXPIRED": c("now_s") > c("expires_at"),
        "TOKEN_ALREADY_SPENT": (c("single_use") == 1) & c("_spent"),
        "TOKEN_CEILING_EXCEEDED": c("redeem_amount") > c("max_amount"), "TOKEN_CURRENCY_MISMATCH": c("redeem_currency") != c("currency"),
        "TOKEN_SCOPE_VIOLATION": F.size(F.array_except("requested_scope", "scope")) > 0,
    }
    j = redemptions.join(tokens.withColumn("_issued", F.lit(True)), key, "left")
    clean = reduce(lambda a, b: a & b, [~F.coalesce(test, F.lit(False)) for code, test in codes.items() if code != "TOKEN_ALREADY_SPENT"], c("_issued").isNotNull())
    j = spent_before(j, [key], clean, order, "_spent")
    reasons = F.when(c("_issued").isNull(), F.array(F.lit("TOKEN_UNKNOWN"))).otherwise(fx.reason_list(codes))
    return j.select(*redemptions.columns, fx.join_reasons(reasons).alias("reasons"))
