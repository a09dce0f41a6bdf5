"""Group tables of an evaluation: one aggregate each, slices by grouping sets."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalar as fx
from .ordered import exact_quantiles

# Cohort labels and band edges.
AGE_BANDS = ["18-24", "25-34", "35-49", "50-64", "65+"]
LITERACY = [(0.2, "0.0-0.2"), (0.4, "0.2-0.4"), (0.6, "0.4-0.6"), (0.8, "0.6-0.8"), (1.01, "0.8-1.0")]
AMOUNT_BANDS = [(500.0, "<500"), (5_000.0, "500-5k"), (50_000.0, "5k-50k"), (200_000.0, "50k-2L"), (None, ">2L")]
PAYEE_AGE_BANDS = [(7.0, "<1w"), (90.0, "1w-3m"), (730.0, "3m-2y"), (None, ">2y")]
#: How a NULL dimension reads in a slice's name.
MISSING = "(missing)"


def band(value: Column, edges) -> Column:
    """Label of the first right-closed band the value fits."""
    out = None
    for top, label in edges:
        test = value.isNotNull() if top is None else value <= top
        out = F.when(test, label) if out is None else out.when(test, label)
    return out


def money(condition: Column) -> Column:
    return F.sum(F.when(condition, F.col("cents")).otherwise(0)) / F.lit(100.0)


def headline(df: DataFrame, cut: float) -> DataFrame:
    """Confusion metrics for ``score >= cut``."""
    fraud, alert = F.col("is_fraud") == 1, F.col("score") >= cut
    one = lambda c: F.sum(c.cast("long"))
    s = df.agg(
        F.count(F.lit(1)).alias("rows"), one(fraud).alias("fraud"), one(alert).alias("alerts"),
        one(fraud & alert).alias("tp"), money(fraud).alias("value_at_risk"), money(fraud & alert).alias("value_saved"),
        F.avg(F.pow(F.col("score") - F.col("is_fraud"), F.lit(2.0))).alias("brier"))
    safe = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    p, r = safe(F.col("tp"), F.col("alerts")), safe(F.col("tp"), F.col("fraud"))
    return s.select(
        "rows", F.coalesce("fraud", F.lit(0)).alias("fraud"), F.try_divide("fraud", "rows").alias("fraud_rate"), p.alias("precision"), r.alias("recall"),
        safe(2 * F.col("tp"), F.col("alerts") + F.col("fraud")).alias("f1"),
        F.try_divide(F.col("alerts") - F.col("tp"), F.col("rows") - F.col("fraud")).alias("false_positive_rate"),
        F.try_divide(F.col("alerts") * F.lit(10000.0), F.col("rows")).alias("alerts_per_10k"),
        F.when(F.col("value_at_risk") > 0, F.col("value_saved") / F.col("value_at_risk")).alias("value_recall"),
        "value_at_risk", "value_saved", F.round("brier", 9).alias("brier"))


def per_vector_recall(df: DataFrame, cut: float) -> DataFrame:
    fraud = df.where("is_fraud = 1")
    alert = F.col("score") >= cut
    base = fraud.groupBy("attack_vector_id").agg(
        F.min("fraud_type").alias("family"), F.count(F.lit(1)).alias("rows"), F.avg(alert.cast("double")).alias("recall"),
        money(F.lit(True)).alias("value"), money(alert).alias("value_caught"))
    median = exact_quantiles(fraud, ["attack_vector_id"], "score", [0.5]).select("attack_vector_id", F.col("q").alias("median_score"))
    out = base.join(median, "attack_vector_id").withColumn(
        "value_recall", F.col("value_caught") / F.greatest(F.col("value"), F.lit(1.0)))
    return fx.with_wilson(out, "recall", "rows")


def per_family_recall(df: DataFrame, cut: float) -> DataFrame:
    out = df.where("is_fraud = 1").groupBy("fraud_type").agg(
        F.count(F.lit(1)).alias("rows"), F.avg((F.col("score") >= cut).cast("double")).alias("recall"),
        money(F.lit(True)).alias("value"))
    return fx.with_wilson(out, "recall", "rows")


def false_positive_breakdown(df: DataFrame, cut: float) -> DataFrame:
    kind = F.when(F.col("is_hard_negative") == 1, "hard_negative").otherwise("ordinary_legitimate")
    legit = df.where("is_fraud = 0").select(
        kind.alias("kind"), F.concat(F.lit("rail:"), "rail").alias("rail"), (F.col("score") >= cut).cast("long").alias("alert"))
    sets = legit.groupingSets([["kind"], ["rail"]], "kind", "rail")
    found = sets.agg(F.count(F.lit(1)).alias("rows"), F.sum("alert").alias("false_positives"), F.avg("alert").alias("fp_rate"), F.grouping("rail").alias("_out"))
    segment = F.when(F.col("_out") == 1, F.col("kind")).otherwise(F.coalesce("rail", F.lit(f"rail:{MISSING}")))
    return found.select(segment.alias("segment"), "rows", "false_positives", "fp_rate")


def fairness(df: DataFrame, cut: float) -> DataFrame:
    ordinal = F.col("customer_age_band_ord")
    age = F.coalesce(F.get(F.array(*[F.lit(b) for b in AGE_BANDS]), ordinal.cast("int")), F.lit("unknown"))
    lit_band = F.coalesce(F.when(F.col("customer_digital_literacy") > -0.01, band(F.col("customer_digital_literacy"), LITERACY)), F.lit("nan"))
    rows = df.select(age.alias("age_band"), lit_band.alias("digital_literacy"), "is_fraud", "cents",
                     (F.col("score") >= cut).cast("long").alias("alert"))
    fraud = F.col("is_fraud") == 1
    agg = rows.groupingSets([["age_band"], ["digital_literacy"]], "age_band", "digital_literacy").agg(
        F.count(F.lit(1)).alias("rows"), F.sum((~fraud).cast("long")).alias("legitimate_rows"),
        F.sum(F.when(~fraud, F.col("alert")).otherwise(0)).alias("false_positives"),
        F.avg(F.when(~fraud, F.col("alert"))).alias("fp_rate"), F.sum(fraud.cast("long")).alias("fraud_rows"),
        F.avg(fraud.cast("double")).alias("victimisation_rate"), F.avg(F.when(fraud, F.col("alert"))).alias("recall"),
        money(fraud).alias("value_at_risk"), F.grouping("age_band").alias("_out"))
    by_age = F.col("_out") == 0
    out = agg.select(
        F.when(by_age, "age_band").otherwise("digital_literacy").alias("dimension"),
        F.when(by_age, F.col("age_band")).otherwise(F.col("digital_literacy")).alias("segment"), *agg.columns[2:-1])
    out = fx.with_wilson(out, "fp_rate", "legitimate_rows")
    return fx.with_wilson(out, "recall", "fraud_rows", flag_name="recall_n_sufficient")


def evasion_delta(df: DataFrame, cut: float) -> DataFrame:
    fraud = df.where("is_fraud = 1").select("attack_vector_id", "evasion_applied", (F.col("score") >= cut).cast("long").alias("alert"))
    agg = fraud.groupBy("attack_vector_id").agg(
        *[F.avg(F.when(F.col("evasion_applied") == e, F.col("alert"))).alias(f"recall_evasion_{e}") for e in (0, 1)],
        *[F.count(F.when(F.col("evasion_applied") == e, 1)).alias(f"rows_evasion_{e}") for e in (0, 1)],
    ).where("rows_evasion_1 > 0")
    return agg.withColumn("recall_drop", F.col("recall_evasion_0") - F.col("recall_evasion_1"))


def worst_slices(df: DataFrame, cut: float, min_rows: int = 25, top: int = 8) -> DataFrame:
    dims = ["rail", "channel", "amount_band", "payee_age_band"]
    alert = F.col("score") >= cut
    fraud = df.where("is_fraud = 1").select(
        "rail", "channel", band(F.col("amount"), AMOUNT_BANDS).alias("amount_band"),
        band(F.col("payee_account_age_days"), PAYEE_AGE_BANDS).alias("payee_age_band"), "cents", "score")
    combos = [[d] for d in dims] + [list(c) for c in combinations(dims, 2)]
    agg = fraud.groupingSets(combos, *dims).agg(
        F.count(F.lit(1)).alias("fraud_rows"), F.avg(alert.cast("double")).alias("recall"),
        money(F.lit(True)).alias("value_at_risk"), money(~alert).alias("value_missed"), *[F.grouping(d).alias(f"_out_{d}") for d in dims])
    parts = F.array_compact(F.array(*[F.when(F.col(f"_out_{d}") == 0, F.concat(F.lit(f"{d}="), F.coalesce(d, F.lit(MISSING)))) for d in dims]))
    out = agg.where(F.col("fraud_rows") >= min_rows).select(
        F.array_join(parts, " & ").alias("slice"), F.size(parts).cast("long").alias("dimensions"), *agg.columns[4:-len(dims)])
    return fx.with_wilson(out, "recall", "fraud_rows").orderBy("recall", "slice").limit(top)


def guard_contribution(df: DataFrame, cut: float) -> DataFrame:
    intent, injection = F.col("intent_guard_blocked") == 1, F.col("agent_injection_flag") == 1
    model = F.col("score") >= cut
    share = lambda c: F.avg(c.cast("double"))
    return df.where("is_fraud = 1 AND initiated_by_agent = 1").groupBy("attack_vector_id").agg(
        F.count(F.lit(1)).alias("rows"), share(intent).alias("intent_guard"), share(injection).alias("injection_guard"),
        share(model).alias("tabular_model"), share(intent | injection | model).alias("any_layer"),
        share(model & ~intent & ~injection).alias("model_only"))


def expert_rules() -> dict[str, Column]:
    """Ten written-down rules; a missing value never fires one. Their names and thresholds."""
    c = F.col
    return {
        "new_payee_large_amount": (c("payee_is_first_time") == 1) & (c("amount") > 25_000),
        "payee_added_minutes_ago": c("payee_added_minutes_ago") < 30,
        "screen_share_during_payment": c("screen_share_active") == 1,
        "remote_access_tool_present": c("remote_access_app_detected") == 1,
        "live_call_while_paying": (c("call_in_progress") == 1) & (c("amount") > 10_000),
        "payee_name_mismatch": c("payee_name_match_score") < 0.6,
        "recent_sim_swap": c("sim_swap_recency_days") < 7,
        "new_device_at_night": (c("device_is_new") == 1) & (c("is_night") == 1),
        "mule_shaped_beneficiary": c("payee_inbound_unique_payers_24h") >= 8,
        "irrevocable_rail_new_payee_high_value":
            (c("is_irrevocable_rail") == 1) & (c("payee_is_first_time") == 1) & (c("amount") > 50_000),
    }


def rule_count() -> Column:
    return reduce(lambda a, b: a + b, [fx.flag(r) for r in expert_rules().values()])


def rule_firing(df: DataFrame) -> DataFrame:
    rules = expert_rules()
    hits = F.explode(F.array(*[F.struct(F.lit(k).alias("rule"), fx.flag(r).alias("hit")) for k, r in rules.items()]))
    long = df.select("is_fraud", hits.alias("h")).select("is_fraud", "h.rule", "h.hit")
    fraud = F.col("is_fraud") == 1
    out = long.groupBy("rule").agg(
        F.sum(F.when(fraud, F.col("hit")).otherwise(0)).alias("fires_on_fraud"),
        F.avg(F.when(fraud, F.col("hit"))).alias("fraud_hit_rate"),
        F.sum(F.when(~fraud, F.col("hit")).otherwise(0)).alias("fires_on_legitimate"),
        F.avg(F.when(~fraud, F.col("hit"))).alias("legitimate_hit_rate"))
    return out.withColumn("lift", F.when(F.col("legitimate_hit_rate") > 0, F.col("fraud_hit_rate") / F.col("legitimate_hit_rate")))


def long_numeric(df: DataFrame, columns: list[str], keep: list[str]) -> DataFrame:
    """One row per (row, numeric column)."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns]))
    return df.select(*keep, pairs.alias("_p")).select(*keep, "_p.column", "_p.value")


def column_auc(df: DataFrame, columns: list[str], label: str = "is_fraud") -> DataFrame:
    """AUC of every column on its own, all in one scan over (column, value)."""
    from . import curve
    long = long_numeric(df, columns, [label])
    c = curve.score_curve(long.where("value IS NOT NULL"), ["column"], score="value", label=label, money=None)
    varied = c.groupBy("column").agg(F.count(F.lit(1)).alias("_levels"))
    return curve.roc_auc(c, ["column"]).join(F.broadcast(varied), "column").where("_levels > 1").drop("_levels")


def guard_leakage(df: DataFrame, presence: dict[str, str | None]) -> DataFrame:
    """Each guard column as a classifier of the label, by value and by mere presence."""
    found = column_auc(df, list(presence)).withColumnRenamed("column", "guard_column").withColumnRenamed("auc", "single_feature_auc")
    seen = F.explode(F.array(*[
        F.struct(F.lit(c).alias("guard_column"), fx.flag(F.col(p or c) != 0).alias("present")) for c, p in presence.items()]))
    long = df.select("is_fraud", seen.alias("s")).select("is_fraud", "s.guard_column", "s.present")
    agg = long.groupBy("guard_column").agg(
        F.avg("present").alias("coverage"), F.avg(F.when(F.col("present") == 1, F.col("is_fraud"))).alias("p_fraud_given_present"),
        F.avg("is_fraud").alias("base_fraud_rate"))
    return found.join(agg, "guard_column").withColumn("presence_lift", F.try_divide("p_fraud_given_present", "base_fraud_rate"))


def benign_baselines(df: DataFrame, columns: list[str]) -> DataFrame:
    """Distribution of each numeric column over legitimate rows."""
    from .ordered import wide_quantiles
    long = long_numeric(df.where("is_fraud = 0"), columns, []).where("value IS NOT NULL")
    names = {0.05: "p05", 0.25: "p25", 0.5: "median", 0.75: "p75", 0.95: "p95"}
    q = wide_quantiles(exact_quantiles(long, ["column"], "value", list(names)), ["column"], names)
    base = long.groupBy("column").agg(
        F.round(F.avg("value"), 4).alias("mean"), F.avg((F.col("value") == 0).cast("double")).alias("share_zero"))
    return q.join(base, "column")
