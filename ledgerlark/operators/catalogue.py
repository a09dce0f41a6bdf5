"""Catalogue tables with array columns, run comparisons, derived columns and response pricing."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ordered import ordered_history

# Risk weights, and the functions a derived column may use.
RISK = {"severity": 0.4, "prevalence": 0.25, "difficulty": 0.35}
ALLOWED = {"abs": "abs", "minimum": "least", "maximum": "greatest", "log1p": "log1p", "where": "if"}


def signal_usage(df: DataFrame, array: str) -> DataFrame:
    return df.select(F.explode(array).alias("signal")).groupBy("signal").agg(F.count(F.lit(1)).alias("uses")).orderBy(F.desc("uses"), "signal")


def conformance(df: DataFrame, key: str, array: str, known: DataFrame) -> DataFrame:
    """Exploded values outside the known list, and repeated ids."""
    stray = df.select(key, F.explode(array).alias("value")).join(known.select("value"), "value", "left_anti").select(
        F.col(key).cast("string").alias("id"), F.lit("unknown value").alias("problem"), "value")
    twice = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(
        F.col(key).cast("string").alias("id"), F.lit("duplicate id").alias("problem"), F.col("_n").cast("string").alias("value"))
    return stray.unionByName(twice)


def family_summary(df: DataFrame, family: str, array: str) -> DataFrame:
    risk = sum((F.col(c) * w for c, w in RISK.items()), F.lit(0.0)) / 5.0
    base = df.groupBy(family).agg(F.count(F.lit(1)).alias("vectors"), F.sum("simulated").alias("simulated"), F.round(F.avg(risk), 6).alias("mean_risk"))
    uses = df.select(family, F.explode(array).alias("v")).groupBy(family).agg(F.count_distinct("v").alias("controls"))
    return base.join(uses, family, "left")


def paired_comparison(a: DataFrame, b: DataFrame, key: str, metric: str) -> DataFrame:
    """Before and after on the same seeds: mean difference and its size in standard errors."""
    j = a.select(key, F.col(metric).alias("x")).join(b.select(key, F.col(metric).alias("y")), key).withColumn("d", F.col("y") - F.col("x"))
    s = j.agg(F.count("d").alias("pairs"), F.avg("x").alias("before"), F.avg("y").alias("after"), F.avg("d").alias("difference"), F.stddev_samp("d").alias("sd"))
    return s.withColumn("t", F.when(F.col("sd") > 0, F.col("difference") / (F.col("sd") / F.sqrt("pairs"))))


def transfer_matrix(df: DataFrame, row: str, column: str, value: str, columns: Sequence) -> DataFrame:
    return df.groupBy(row).pivot(column, list(columns)).agg(F.round(F.avg(value), 8))


def trend(df: DataFrame, order: str, value: str) -> DataFrame:
    """Least-squares slope and how often the series turns, steps of zero left out; one row per round, so a small table.

    Fixed values: five rounds at least, a slope of 0.005 and half the possible turns. Flat is asked first, then falling.
    """
    w = Window.orderBy(order)
    steps = df.groupBy(order).agg(F.avg(value).alias(value)).withColumn("d", F.signum(F.col(value) - F.lag(value).over(w)))
    moved = F.last(F.when(F.col("d") != 0, F.col("d")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    steps = steps.withColumn("turn", (F.col("d") * moved < 0).cast("long"))
    s = steps.agg(F.regr_slope(value, order).alias("slope"), F.coalesce(F.sum("turn"), F.lit(0)).alias("sign_changes"), F.count(F.lit(1)).alias("rounds"))
    index = F.col("sign_changes") / F.greatest(F.col("rounds") - 2, F.lit(1))
    verdict = F.when(F.col("rounds") < 5, "too short").when((F.abs("slope") < 0.005) & (index < 0.5), "flat").when(F.col("slope") < -0.005, "falling").when(
        index >= 0.5, "oscillating").otherwise("rising")
    return s.select(F.round("slope", 10).alias("slope"), "sign_changes", index.alias("oscillation"), verdict.alias("verdict"))


def trim_to_budget(df: DataFrame, group: str, order: str, amount: str, budget: float) -> DataFrame:
    """Leading whole groups while their running total stays within budget; always the first."""
    per = df.groupBy(group).agg(F.min(order).alias("_o"), F.sum(amount).alias("_a"))
    ranked = ordered_history(per.withColumn("_l", F.floor(F.col("_o") / 86400)), [], ["_l"], ["_o", group], sums=["_a"])
    kept = ranked.where((F.col("before__a") == 0) | (F.col("before__a") + F.col("_a") <= budget))
    return df.join(kept.select(group), group, "left_semi")


def derived_column(df: DataFrame, text: str, name: str) -> DataFrame:
    """A user-written numeric column: short, allow-listed characters, functions and known columns only."""
    if len(text) > 400 or not re.fullmatch(r"[A-Za-z0-9_+\-*/().,<>=!& |\s]+", text):
        raise ValueError("expression too long or with characters that are not allowed")
    words = set(re.findall(r"[A-Za-z_][A-Za-z0-9_]*", text))
    numeric = {c for c, t in df.dtypes if t in ("int", "bigint", "double", "float")}
    if words - set(ALLOWED) - numeric:
        raise ValueError(f"unknown names: {sorted(words - set(ALLOWED) - numeric)}")
    for mine, spark_name in ALLOWED.items():
        text = re.sub(rf"\b{mine}\s*\(", f"{spark_name}(", text)
    value = F.expr(text).cast("double")
    usable = value.isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf"))
    out = df.withColumn(name, F.when(usable, value).otherwise(0.0))
    spread = df.agg(F.sum(F.coalesce(usable, F.lit(False)).cast("long")).alias("n"), F.stddev_pop(F.when(usable, value)).alias("s")).first()
    if not spread["n"] or not spread["s"]:
        raise ValueError("the column has no finite values or never changes")
    return out


def top_risk(df: DataFrame, key: str, limit: int) -> DataFrame:
    """The entries with the greatest risk, ties by key, and their place."""
    risk = sum((F.col(c) * w for c, w in RISK.items()), F.lit(0.0)) / 5.0
    first = df.select(key, F.round(risk, 9).alias("risk")).orderBy(F.desc("risk"), key).limit(limit)
    return first.withColumn("place", F.row_number().over(Window.orderBy(F.desc("risk"), key)).cast("long"))  # over ``limit`` rows


def campaign_profit(df: DataFrame, cut: float, costs: dict[str, int], converts: int) -> DataFrame:
    """Per campaign, in hundredths: value at risk, the converted share of it, what of that is extracted below the cut, cost items, profit, return."""
    share = lambda c: F.floor(F.col(c) * converts / F.lit(100.0)).cast("long")
    c = df.groupBy("campaign_id").agg(
        F.sum("cents").alias("at_risk"), F.sum(F.when(F.col("score") < cut, F.col("cents")).otherwise(0)).alias("_passed"), (F.count(F.lit(1)) * costs["payment"]).alias("payment_cost"),
        (F.count_distinct("payee") * costs["account"]).alias("account_cost"), (F.count_distinct("device_id") * costs["device"]).alias("device_cost"))
    t = c.select("*", share("at_risk").alias("converted"), share("_passed").alias("extracted"), (F.col("payment_cost") + F.col("account_cost") + F.col("device_cost")).alias("cost"))
    profit = F.col("extracted") - F.col("cost")
    return t.select("campaign_id", "at_risk", "converted", "extracted", "payment_cost", "account_cost", "device_cost", "cost", profit.alias("profit"),
                    F.round(F.try_divide(profit, F.col("cost")), 6).alias("roi"))
