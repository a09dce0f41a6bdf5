"""Data-quality and realism checks over a labelled payments table.

Each check returns rows of ``check, measure, value``; ``report`` turns them into scores and flags.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalar as fx
from ..session import durable
from .evaluate import long_numeric
from .ordered import attach_totals, exact_quantiles, value_scan, wide_quantiles

# Support and separation limits of the leak search.
MIN_SUPPORT, MAX_LEGIT_SHARE, BAND_FRAUD_SHARE = 25, 0.02, 0.90
BENFORD = [math.log10(1 + 1 / d) for d in range(1, 10)]


def _measures(check: str, row: DataFrame, columns: dict[str, Column]) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(k).alias("measure"), c.cast("double").alias("value")) for k, c in columns.items()])
    return row.select(F.explode(pairs).alias("_m")).select(F.lit(check).alias("check"), "_m.measure", "_m.value")


def _clip(value: Column) -> Column:
    return F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0))


def benford(df: DataFrame) -> DataFrame:
    digit = fx.leading_digit(F.col("amount"))
    counts = df.where("amount >= 1").agg(
        F.count(F.lit(1)).alias("n"), *[F.sum((digit == d).cast("long")).alias(f"d{d}") for d in range(1, 10)])
    gap = sum((F.abs(F.col(f"d{d}") / F.col("n") - BENFORD[d - 1]) for d in range(1, 10)), F.lit(0.0)) * 0.5
    return _measures("benford", counts, {"total_variation": gap, "score": _clip(1 - gap / 0.35), "flag": (gap > 0.12).cast("int")})


def round_numbers(df: DataFrame) -> DataFrame:
    s = df.agg(*[F.avg(fx.is_multiple(F.col("amount"), k)).alias(f"m{k}") for k in (100, 500)])
    return _measures("round_numbers", s, {
        "multiple_of_100": F.col("m100"), "multiple_of_500": F.col("m500"),
        "score": _clip(1 - F.abs(F.col("m100") - 0.26) / 0.26), "flag": (F.col("m100") < 0.08).cast("int")})


def diurnal(df: DataFrame) -> DataFrame:
    hour = F.floor(F.pmod(F.col("ts_s"), F.lit(86400)) / 3600)
    s = df.agg(*[F.avg(hour.between(a, b).cast("double")).alias(n) for n, a, b in
                 (("night", 0, 5), ("evening", 18, 21), ("morning", 10, 13))])
    ok = [F.col("night") < 0.10, F.col("evening") > F.col("morning"), F.col("evening") > 0.22]
    return _measures("diurnal", s, {"night": F.col("night"), "evening": F.col("evening"), "morning": F.col("morning"),
                                    "score": sum((c.cast("double") for c in ok), F.lit(0.0)) / 3.0})


def weekly(df: DataFrame) -> DataFrame:
    dow = F.pmod(F.floor(F.col("ts_s") / 86400) + 3, F.lit(7))
    s = df.agg(*[F.avg((dow == d).cast("double")).alias(f"w{d}") for d in range(7)])
    days = [f"w{d}" for d in range(7)]
    spread = F.greatest(*days) - F.least(*days)
    return _measures("weekly", s, {"spread": spread, "score": _clip(1 - F.abs(spread - 0.055) / 0.08)})


def amount_tail(df: DataFrame) -> DataFrame:
    q = wide_quantiles(exact_quantiles(df, [], "amount", [0.5, 0.99]), [], {0.5: "p50", 0.99: "p99"})
    log = fx.log_amount(F.col("amount"))
    s = attach_totals(q, df.agg(F.skewness(log).alias("skew"), F.kurtosis(log).alias("kurt")), [])
    ratio = F.col("p99") / F.greatest(F.col("p50"), F.lit(1.0))
    ok = [ratio.between(8, 400), F.col("skew").between(-0.5, 1.5)]
    return _measures("amount_tail", s, {"p99_over_p50": ratio, "log_skew": F.col("skew"), "log_excess_kurtosis": F.col("kurt"),
                                        "score": sum((c.cast("double") for c in ok), F.lit(0.0)) / 2.0})


def entity_consistency(df: DataFrame, key: str = "payer") -> DataFrame:
    """Share of log-amount variance that lies between entities."""
    per = df.groupBy(key).agg(F.avg(fx.log_amount(F.col("amount"))).alias("m"), F.var_samp(fx.log_amount(F.col("amount"))).alias("v"))
    s = per.agg(F.var_samp("m").alias("between"), F.avg("v").alias("within"))
    icc = F.col("between") / F.greatest(F.col("between") + F.col("within"), F.lit(1e-9))
    return _measures("entity_consistency", s, {"icc": icc, "score": _clip(1 - F.abs(icc - 0.30) / 0.30), "flag": (icc < 0.05).cast("int")})


def payee_concentration(df: DataFrame) -> DataFrame:
    """Volume share of the busiest 1% of payees, from counts of equally busy payees."""
    per = df.groupBy("payee").agg(F.count(F.lit(1)).alias("c"))
    levels = per.groupBy("c").agg(F.count(F.lit(1)).alias("k"))
    scan = value_scan(levels, [], "c", ["k"], descending=True)
    t = attach_totals(scan, levels.agg(F.sum("k").alias("payees"), F.sum(F.col("k") * F.col("c")).alias("rows")), [])
    top = F.greatest(F.lit(1), F.floor(F.col("payees") / 100))
    taken = F.greatest(F.lit(0), F.least(F.col("k"), top - F.col("before_k")))
    share = t.agg((F.sum(taken * F.col("c")) / F.max("rows")).alias("top1"))
    s = attach_totals(share, df.agg(F.avg("payee_is_first_time").alias("novel")), [])
    ok = [F.col("top1").between(0.05, 0.75), F.col("novel").between(0.05, 0.60)]
    return _measures("payee_concentration", s, {"top_1pct_share": F.col("top1"), "first_time_rate": F.col("novel"),
                                                "score": sum((c.cast("double") for c in ok), F.lit(0.0)) / 2.0})


def two_sample_ks(long: DataFrame, side: str = "side", part: Sequence[str] = ("column",)) -> DataFrame:
    """Largest gap between two empirical distributions, per column of a long (column, value, side) table."""
    part = list(part)
    counts = durable(long.where(F.col("value").isNotNull()).groupBy(*part, "value").agg(
        F.sum((F.col(side) == 0).cast("long")).alias("a"), F.sum((F.col(side) == 1).cast("long")).alias("b")))
    scan = value_scan(counts, part, "value", ["a", "b"])
    t = attach_totals(scan, counts.groupBy(*part).agg(F.sum("a").alias("na"), F.sum("b").alias("nb")), part)
    gap = F.abs(F.try_divide(F.col("before_a") + F.col("a"), F.col("na")) - F.try_divide(F.col("before_b") + F.col("b"), F.col("nb")))
    return t.groupBy(*part).agg(F.max(gap).alias("ks"))


def fraud_overlap(df: DataFrame) -> DataFrame:
    """Fraud must overlap legitimate traffic rather than sit in a corner of its own."""
    names = {0.25: "q1", 0.75: "q3"}
    q = wide_quantiles(exact_quantiles(df, ["is_fraud"], "amount", list(names)), ["is_fraud"], names)
    iqr = q.agg(*[F.max(F.when(F.col("is_fraud") == k, F.col(c))).alias(f"{c}{k}") for k in (0, 1) for c in ("q1", "q3")])
    fraud = F.col("is_fraud") == 1
    quiet = sum((F.col(c) for c in ("screen_share_active", "remote_access_app_detected", "call_in_progress", "device_is_emulator"))) == 0
    s = df.agg(
        F.count_distinct(F.when(fraud, F.col("rail"))).alias("rails"), F.avg(F.when(fraud, quiet.cast("double"))).alias("quiet"),
        F.avg(F.when(~fraud, F.col("screen_share_active"))).alias("ss"), F.avg(F.when(~fraud, F.col("payee_is_first_time"))).alias("ft"))
    ks = two_sample_ks(df.select(F.lit("amount").alias("column"), fx.log_amount(F.col("amount")).alias("value"),
                                 F.col("is_fraud").alias("side"))).select("ks")
    t = attach_totals(attach_totals(s, iqr, []), ks, [])
    ok = {"amount_iqr_overlaps": (F.col("q11") < F.col("q30")) & (F.col("q10") < F.col("q31")), "multi_rail": F.col("rails") >= 5,
          "has_quiet_fraud": F.col("quiet") > 0.35, "benign_shares_signals": (F.col("ss") > 0.0005) & (F.col("ft") > 0.02),
          "amount_ks_below_0.6": F.col("ks") < 0.6}
    out = {k: c.cast("int") for k, c in ok.items()}
    return _measures("fraud_overlap", t, out | {"quiet_share": F.col("quiet"), "amount_ks": F.col("ks"),
                                                "score": sum((c.cast("double") for c in ok.values()), F.lit(0.0)) / 5.0})


def pair_sums(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``i, j, n, x, y, xx, yy, xy`` of every pair of columns over the rows where both are known: products of matrices, one partial row a pair and task."""
    size = len(columns)
    upper = np.triu_indices(size)
    shift = [r if r is not None else 0.0 for r in df.agg(*[F.avg(F.col(c).cast("double")) for c in columns]).first()]  # sums around the means lose no digits

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((6, size, size))
        for batch in batches:
            v = np.asarray(batch.column("v").flatten().to_numpy(zero_copy_only=False), np.float64).reshape(batch.num_rows, size) - np.array(shift)
            m = (~np.isnan(v)).astype(np.float64)
            x = np.where(m > 0, v, 0.0)
            held += np.stack([m.T @ m, x.T @ m, m.T @ x, (x * x).T @ m, m.T @ (x * x), x.T @ x])
        yield pa.RecordBatch.from_arrays([pa.array(upper[0]), pa.array(upper[1]), *[pa.array(h[upper]) for h in held]], ["i", "j", "n", "x", "y", "xx", "yy", "xy"])

    values = df.select(F.array(*[F.col(c).cast("double") for c in columns]).alias("v"))
    sums = values.mapInArrow(summed, "i long, j long, n double, x double, y double, xx double, yy double, xy double")
    return sums.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("n", "x", "y", "xx", "yy", "xy")])


def correlations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``i, j, r`` of every pair of columns; NULL where one of them does not vary."""
    c = F.col
    vx, vy, cov = c("xx") - c("x") * c("x") / c("n"), c("yy") - c("y") * c("y") / c("n"), c("xy") - c("x") * c("y") / c("n")
    varies = (c("n") > 0) & (vx > 1e-12 * (1 + c("xx"))) & (vy > 1e-12 * (1 + c("yy")))
    return pair_sums(df, columns).select("i", "j", F.when(varies, cov / F.sqrt(vx * vy)).alias("r"))


def correlation_drift(a: DataFrame, b: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Mean absolute difference of two correlation matrices, each pair over rows where both are known."""
    both = correlations(a, columns).withColumnRenamed("r", "ra").join(correlations(b, columns).withColumnRenamed("r", "rb"), ["i", "j"]).where("ra IS NOT NULL AND rb IS NOT NULL")
    weight = F.when(F.col("i") == F.col("j"), 1).otherwise(2)
    return both.agg((F.sum(F.abs(F.col("ra") - F.col("rb")) * weight) / F.sum(weight)).alias("drift"))


#: AUC that no single column, and recall at the review budget that no combination, may pass (fixed values); a reference's mean KS that scores zero.
AUC_CEILING, RECALL_CEILING, KS_SPAN = 0.93, 0.92, 0.2


def single_feature_check(aucs: DataFrame) -> DataFrame:
    """Check rows of ``column, auc``: the clearest single column, how many pass the ceiling, and a flag if any does."""
    top = F.greatest(F.col("auc"), 1 - F.col("auc"))
    row = aucs.agg(F.coalesce(F.max(top), F.lit(0.5)).alias("a"), F.count_if(top > AUC_CEILING).alias("n"))
    return _measures("single_feature", row, {"worst_auc": F.col("a"), "above_ceiling": F.col("n"), "score": _clip((AUC_CEILING - F.col("a")) / (AUC_CEILING - 0.5)),
                                             "flag": fx.flag(F.col("n") > 0)})


def separability_check(name: str, found: DataFrame) -> DataFrame:
    """Check rows of what ``stack.separability`` found: a flag on the lower bound, else a warning on the point."""
    c = F.col
    return _measures(name, found, {"recall": c("recall"), "lo95": c("lo95"), "hi95": c("hi95"), "refit_spread": c("spread"),
                                   "score": _clip((RECALL_CEILING - c("recall")) / (RECALL_CEILING - 0.5)), "flag": c("flag"),
                                   "warning": fx.flag((c("flag") == 0) & (c("warning") == 1))})


def reference_check(ks: DataFrame) -> DataFrame:
    """Check rows of ``column, ks``: how far a table is from a reference on the mean of its columns."""
    row = ks.agg(F.avg("ks").alias("m"), F.max("ks").alias("w"), F.count("*").alias("n")).where("n > 0")
    return _measures("reference_agreement", row, {"mean_ks": F.col("m"), "worst_ks": F.col("w"), "columns": F.col("n"), "score": _clip(1 - F.col("m") / KS_SPAN)})


def drift_check(drift: DataFrame) -> DataFrame:
    """Check rows of the correlation drift; it has no score of its own."""
    return _measures("correlation_drift", drift, {"drift": F.col("drift")})


def artefact_check(found: DataFrame) -> DataFrame:
    """Check rows of what ``find_artefacts`` found: values that only fraud has, and a flag if there are any."""
    return _measures("label_only_values", found.agg(F.count("*").alias("n")), {"found": F.col("n"), "score": (F.col("n") == 0).cast("double"), "flag": fx.flag(F.col("n") > 0)})


def label_only_levels(df: DataFrame, columns: Sequence[str], prefixes: Sequence[str] = ()) -> DataFrame:
    """String values, or id prefixes, that fraud has and legitimate traffic hardly does."""
    texts = [F.struct(F.lit(c).alias("column"), F.lit("level").alias("kind"), F.col(c).cast("string").alias("value")) for c in columns]
    texts += [F.struct(F.lit(c).alias("column"), F.lit("id prefix").alias("kind"), fx.id_prefix(F.col(c)).alias("value")) for c in prefixes]
    long = df.select("is_fraud", F.explode(F.array(*texts)).alias("t")).select("is_fraud", "t.*")
    counts = long.groupBy("column", "kind", "value").agg(
        F.sum("is_fraud").alias("fraud_rows"), F.sum(1 - F.col("is_fraud")).alias("legit_rows"))
    t = attach_totals(counts, df.agg(F.sum("is_fraud").alias("_p"), F.sum(1 - F.col("is_fraud")).alias("_n")), [])
    tell = F.col("legit_rows") / F.greatest(F.col("_n"), F.lit(1)) <= MAX_LEGIT_SHARE * (F.col("fraud_rows") / F.greatest(F.col("_p"), F.lit(1)))
    return t.where((F.col("fraud_rows") >= MIN_SUPPORT) & tell).select(
        "column", "kind", "value", "fraud_rows", "legit_rows",
        (F.col("fraud_rows") / (F.col("fraud_rows") + F.col("legit_rows"))).alias("fraud_share"))


def label_only_bands(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Bands between fraud deciles that, at equal class sizes, would be nine tenths fraud."""
    long = long_numeric(df, list(columns), ["is_fraud"]).where("value IS NOT NULL")
    fraud = long.where("is_fraud = 1")
    q = exact_quantiles(fraud, ["column"], "value", [i / 10 for i in range(11)])
    edges = q.groupBy("column").agg(F.array_sort(F.collect_set("q")).alias("e"))
    inner = F.slice("e", F.lit(2), F.size("e") - 2)
    edges = edges.where(F.size("e") >= 3).select("column", inner.alias("inner"))
    levels = fraud.groupBy("column").agg(F.count(F.lit(1)).alias("_p"), F.count_distinct("value").alias("_levels"))
    usable = edges.join(levels, "column").where((F.col("_p") >= MIN_SUPPORT * 4) & (F.col("_levels") >= 4)).drop("_p", "_levels")
    at = F.size(F.filter("inner", lambda x: x <= F.col("value")))
    binned = long.join(F.broadcast(usable), "column").select("column", "is_fraud", "inner", at.alias("bin"))
    counts = binned.groupBy("column", "inner", "bin").agg(
        F.sum("is_fraud").alias("fraud_rows"), F.sum(1 - F.col("is_fraud")).alias("legit_rows"))
    sizes = counts.groupBy("column").agg(F.sum("fraud_rows").alias("_p"), F.sum("legit_rows").alias("_n"))
    rate = lambda a, b: F.col(a) / F.col(b)
    share = rate("fraud_rows", "_p") / (rate("fraud_rows", "_p") + rate("legit_rows", "_n"))
    return counts.join(sizes, "column").where(F.col("_n") >= MIN_SUPPORT).withColumn("fraud_share", share).where(
        (F.col("fraud_rows") >= MIN_SUPPORT) & (F.col("fraud_share") >= BAND_FRAUD_SHARE)).select(
        "column", F.lit("band").alias("kind"), F.get("inner", F.col("bin") - 1).alias("low"), F.get("inner", F.col("bin")).alias("high"),
        "fraud_rows", "legit_rows", "fraud_share")


def find_artefacts(df: DataFrame, texts: Sequence[str], ids: Sequence[str], numbers: Sequence[str]) -> DataFrame:
    bands = label_only_bands(df, numbers)
    end = lambda c, word: F.coalesce(F.format_string("%.4g", F.col(c)), F.lit(word))
    text = F.concat(F.lit("["), end("low", "-inf"), F.lit(", "), end("high", "inf"), F.lit(")"))
    shaped = bands.select("column", "kind", text.alias("value"), "fraud_rows", "legit_rows", "fraud_share")
    return label_only_levels(df, texts, ids).unionByName(shaped).orderBy(F.desc("fraud_rows"), "column")


def report(checks: DataFrame) -> DataFrame:
    """Mean score, checks with a score, flags, warnings, and the checks that score zero, by name."""
    score = F.col("measure") == "score"
    told = lambda m: F.sum(F.when(F.col("measure") == m, F.col("value")).otherwise(0.0))
    return checks.agg(
        F.avg(F.when(score, F.col("value"))).alias("overall"), F.count(F.when(score, 1)).alias("checks"), told("flag").alias("flags"), told("warning").alias("warnings"),
        F.count(F.when(score & (F.col("value") <= 0), 1)).alias("zeroed"),
        F.array_join(F.array_sort(F.collect_set(F.when(score & (F.col("value") <= 0), F.col("check")))), "|").alias("zeroed_checks"))
