"""Joins, selections and tables an analyst works from."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar as fx
from .ordered import attach_totals, ordered_history


def latest(df: DataFrame, key: Sequence[str], order: Column) -> DataFrame:
    """One row per key: the one with the greatest order."""
    rest = [c for c in df.columns if c not in key]
    return df.groupBy(*key).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(*key, "_r.*")


def document_scores(payments: DataFrame, docs: DataFrame, key: str, threshold: float, order: Column) -> DataFrame:
    """Attach linked document scores; the last duplicate wins, no document scores 0."""
    one = latest(docs.where("linked = 1").select(key, "doc_score", order.alias("_o")), [key], F.col("_o")).drop("_o")
    score = F.coalesce("doc_score", F.lit(0.0))
    return payments.join(one, key, "left").select(
        *payments.columns, score.alias("agent_injection_score"), fx.flag(score >= threshold).alias("agent_injection_flag"))


def spread_over_episode(payments: DataFrame, direct: DataFrame, key: str, episode: str) -> DataFrame:
    """Direct score, else the episode's best; blank episodes never spread."""
    rows = payments.join(direct.select(key, "direct"), key, "left")
    named = F.coalesce(F.trim(F.col(episode)) != "", F.lit(False))
    best = rows.where(named & F.col("direct").isNotNull()).groupBy(episode).agg(F.max("direct").alias("_best"))
    # nearly all rows have no episode: they pass the join by
    out = rows.where(named).join(best, episode, "left").unionByName(rows.where(~named), allowMissingColumns=True)
    found = F.coalesce("direct", "_best")
    return out.select(*payments.columns, F.coalesce(found, F.lit(0.0)).alias("vishing_score"), fx.flag(found.isNotNull()).alias("vishing_covered"))


def replace_columns(df: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """Left join where the other side's columns replace same-named ones."""
    return df.drop(*[c for c in other.columns if c in df.columns and c != key]).join(other, key, "left")


def siblings(alerts: DataFrame, payments: DataFrame, group: str, key: str, order: Sequence[str], limit: int = 40) -> DataFrame:
    """Up to ``limit`` other payments of each alert's group, in ``order``.

    Only a group's first ``limit + 1`` payments can appear, so those are picked first (Spark keeps
    that many per task before the shuffle) and no group is ever joined with itself.
    """
    w = Window.partitionBy(group).orderBy(*order)
    first = payments.where(F.trim(F.col(group)) != "").withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= limit + 1)
    other = first.select(group, F.col(key).alias("sibling"), "_r")
    pairs = alerts.where(F.trim(F.col(group)) != "").select(group, key).join(other, group).where(F.col(key) != F.col("sibling"))
    mine = first.select(key, F.col("_r").alias("_mine"))
    ranked = pairs.join(mine, key, "left")
    place = F.col("_r") - fx.flag(F.col("_mine") < F.col("_r"))
    return ranked.where(place <= limit).select(key, "sibling", place.cast("long").alias("place"))


def queue(alerts: DataFrame, cases: DataFrame, key: Sequence[str], min_score: float, limit: int, offset: int = 0) -> DataFrame:
    """A page of open alerts with their case, highest score first."""
    rows = alerts.where((F.col("decision") == 1) & (F.col("score") >= min_score)).join(cases, list(key), "left")
    return rows.orderBy(F.desc("score"), key[-1]).offset(offset).limit(limit)


def dense_ids(df: DataFrame, ts: str, order: Sequence[str], name: str = "dense_id") -> DataFrame:
    """``T%09d`` from 0 in time order, ranked without a global window."""
    keyed = df.select("*", F.floor(F.col(ts) / 86400).alias("_d"), F.lit(1).cast("long").alias("_c"))
    ranked = ordered_history(keyed, [], ["_d", ts], list(order), sums=["_c"])
    return ranked.select(*df.columns, F.format_string("T%09d", F.col("before__c").cast("long")).alias(name))


def aligned_union(a: DataFrame, b: DataFrame, defaults: dict) -> DataFrame:
    """Union where a column one side lacks takes its declared default there; real NULLs stay."""
    fill = lambda d, o: d.select("*", *[F.lit(defaults.get(c)).cast(t).alias(c) for c, t in o.dtypes if c not in d.columns])
    return fill(a, b).unionByName(fill(b, a))


def temporal_split(df: DataFrame, ts: str = "ts_s", test_days: int = 10, calibration_days: int = 5) -> DataFrame:
    """Label rows train, calibration or test by the clock, half open."""
    end = df.agg(F.max(ts).alias("_end"))
    rows = attach_totals(df, end, [])
    test = F.col("_end") - test_days * 86400
    name = F.when(F.col(ts) >= test, "test").when(F.col(ts) >= test - calibration_days * 86400, "calibration").otherwise("train")
    return rows.select(*df.columns, name.alias("split"))


def describe_split(df: DataFrame, ts: str = "ts_s") -> DataFrame:
    return df.groupBy("split").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("is_fraud").alias("fraud"), fx.rounded(F.avg("is_fraud"), 5).alias("fraud_rate"),
        F.count_distinct(F.when(F.col("is_fraud") == 1, F.col("attack_vector_id"))).alias("vectors"),
        F.min(ts).alias("start"), F.max(ts).alias("end"))


def stratified_sample(df: DataFrame, n: int, key: str, seed: int = 7, floor: int = 500) -> DataFrame:
    """All fraud plus a seeded legitimate sample of ``max(n - fraud, 500)`` rows."""
    mixed = df.select("*", F.xxhash64(key, F.lit(seed)).alias("_h"), (1 - F.col("is_fraud")).cast("long").alias("_legit"))
    ranked = ordered_history(
        mixed.withColumn("_l1", F.shiftright("_h", 44)), [], ["_l1"], ["_h", key], sums=["_legit"])
    size = df.agg(F.greatest(F.lit(n) - F.sum("is_fraud"), F.lit(floor)).alias("_k"))
    picked = attach_totals(ranked, size, []).where((F.col("is_fraud") == 1) | (F.col("before__legit") < F.col("_k")))
    return picked.select(*df.columns)


def proportional_sample(df: DataFrame, group: str, key: str, total: int = 400, seed: int = 7) -> DataFrame:
    """Seeded sample of about ``total`` rows in proportion to group size, at least one per group."""
    size = df.groupBy(group).agg(F.count(F.lit(1)).alias("_n"))
    share = attach_totals(size, size.agg(F.sum("_n").alias("_all")), []).select(
        group, F.greatest(F.lit(1), F.rint(F.col("_n") * total / F.col("_all"))).alias("_k"))
    w = Window.partitionBy(group).orderBy(F.xxhash64(key, F.lit(seed)), key)
    top = df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= total)
    return top.join(share, group).where(F.col("_r") <= F.col("_k")).select(*df.columns)


def rule(df: DataFrame, parts: Sequence[tuple[str, str, float]], name: str = "fires") -> DataFrame:
    """AND of ``column >= v`` or ``column <= v``; unknown values and missing columns never fire."""
    if any(c not in df.columns for c, _, _ in parts):
        return df.withColumn(name, F.lit(0).cast("long"))
    hit = F.lit(True)
    for column, op, v in parts:
        hit = hit & F.coalesce((F.col(column) >= v) if op == ">=" else (F.col(column) <= v), F.lit(False))
    return df.withColumn(name, fx.flag(hit))


def reason_codes(df: DataFrame, stats: dict[str, tuple[float, float, float]], k: int = 4) -> DataFrame:
    """Per row the ``k`` columns with the largest ``|z| * importance``, as ``col=value``."""
    items = F.array(*[
        F.struct((-F.abs((F.col(c) - mean) / std) * max(weight, 0.0)).alias("w"), F.lit(c).alias("c"), F.col(c).cast("double").alias("v"))
        for c, (mean, std, weight) in stats.items()])
    top = F.slice(F.array_sort(F.filter(items, lambda s: s["w"] < 0)), 1, k)
    return df.withColumn("reason_codes", F.transform(top, lambda s: F.concat(s["c"], F.lit("="), F.format_string("%.4f", s["v"]))))


def inspect(df: DataFrame, columns: Sequence[str], baselines: DataFrame, key: str) -> DataFrame:
    """A payment's numeric fields, one per row, beside the legitimate distribution."""
    from .evaluate import long_numeric
    return long_numeric(df, list(columns), [key]).join(F.broadcast(baselines), "column", "left")


def clean_texts(df: DataFrame, text: str, order: str, low: int, high: int, refusals: str, prefix: int | None = None) -> DataFrame:
    """Strip list marks and quotes, collapse spaces, keep a length range, drop refusals and repeats."""
    t = F.regexp_replace(F.col(text), r"^\s*(?:[-*]|\d+[.)])\s+", "")
    t = F.trim(F.regexp_replace(F.regexp_replace(t, r"^[\"']+|[\"']+$", ""), r"\s+", " "))
    kept = df.select("*", t.alias("clean")).where(F.length("clean").between(low, high) & ~F.lower("clean").rlike(refusals))
    same = F.lower("clean") if prefix is None else F.substring(F.lower("clean"), 1, prefix)
    return latest(kept.withColumn("_same", F.sha2(same, 256)), ["_same"], -F.col(order)).drop("_same")


def export_slice(scored: DataFrame, n: int, key: str, ts: str, alert: Column) -> DataFrame:
    """At most a third fraud, a sixth false alerts, the rest legitimate approvals, in time order."""
    kind = F.when(F.col("is_fraud") == 1, "fraud").when(alert, "false_alert").otherwise("approved")
    w = Window.partitionBy("_kind").orderBy(ts, key)
    ranked = scored.select("*", kind.alias("_kind")).withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n)
    some = ranked.where(((F.col("_kind") == "fraud") & (F.col("_r") <= n // 3)) | ((F.col("_kind") == "false_alert") & (F.col("_r") <= n // 6)))
    taken = some.agg(F.count(F.lit(1)).alias("_taken"))
    rest = attach_totals(ranked.where("_kind = 'approved'"), taken, []).where(F.col("_r") <= n - F.col("_taken"))
    return some.select(*scored.columns).unionByName(rest.select(*scored.columns)).orderBy(ts, key)


def sensitivity(runs: DataFrame, knob: str, metrics: Sequence[str]) -> DataFrame:
    """Mean and deviation of each metric over the runs of one knob value."""
    return runs.unpivot(knob, list(metrics), "metric", "v").groupBy(knob, "metric").agg(
        F.round(F.avg("v"), 9).alias("mean"), F.round(F.stddev_samp("v"), 9).alias("sd"), F.count("v").alias("runs"))


def verdict_accuracy(verdicts: DataFrame, group: str, guess: str, truth: str) -> DataFrame:
    """Share of right guesses, and of positive ones, per group."""
    right = (F.col(guess) == F.col(truth)).cast("double")
    return verdicts.groupBy(group).agg(F.count(F.lit(1)).alias("judged"), F.avg(right).alias("accuracy"), F.avg(guess).alias("guessed_share"))


#: Classes of a scored, labelled payment that a page may be narrowed to.
DECISIONS = {"alert": "score >= {cut}", "approve": "score < {cut}", "fraud": "is_fraud = 1", "missed": "is_fraud = 1 AND score < {cut}", "false_positive": "is_fraud = 0 AND score >= {cut}"}


def decision_class(name: str, cut: float):
    """The condition of one class of ``DECISIONS``; an unknown name is an error."""
    return F.expr(DECISIONS[name].format(cut=cut))


def page(rows: DataFrame, key: str, limit: int, after=None) -> DataFrame:
    """The ``limit`` rows behind the key ``after``, with ``total`` of all rows and the ``next_cursor``, NULL on the last page.

    The page starts at a key and not at a count, so that no page before it is sorted again; Spark keeps ``limit`` rows per task.
    """
    behind = rows if after is None else rows.where(F.col(key) > F.lit(after))
    first = behind.orderBy(key).limit(limit)
    ends = first.agg(F.max(key).alias("_end"), F.count(F.lit(1)).alias("_n"))
    left = behind.agg(F.count(F.lit(1)).alias("_left"))
    known = attach_totals(attach_totals(ends, left, []), rows.agg(F.count(F.lit(1)).alias("total")), [])
    cursor = F.when(F.col("_left") > F.col("_n"), F.col("_end"))
    return attach_totals(first, known.select("total", cursor.alias("next_cursor")), []).select(*rows.columns, "total", "next_cursor")
