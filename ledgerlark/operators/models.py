"""Scoring models as MLlib jobs over the payments table."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import IDF, HashingTF, Imputer, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar as fx
from ..session import durable, shared_folder
from . import curve
from .evaluate import long_numeric
from .ordered import attach_totals, column_quantiles, exact_quantiles, ordered_history, wide_quantiles

# Learning floors of the stages, and the gain at which a candidate column is taken.
MIN_POSITIVES, TARGET_FPR, ACCEPT_GAIN = 5, 0.005, 0.005

#: The fields a counterfactual may change: unit, the direction that lowers risk, and how the change reads in a sentence.
FIELDS = {
    "payee_account_age_days": ("days", "increase", "an older payee account, aged"),
    "payee_added_minutes_ago": ("minutes", "increase", "a payee saved earlier, by"),
    "payee_is_first_time": ("flag", "decrease", "a payee paid before"),
    "amount": ("currency", "decrease", "a smaller payment, of at most"),
    "call_in_progress": ("flag", "decrease", "nobody on the phone"),
    "screen_share_active": ("flag", "decrease", "a screen that was not shared"),
    "remote_access_app_detected": ("flag", "decrease", "no remote control of the device"),
    "payee_name_match_score": ("score", "increase", "a closer payee name, scoring at least"),
    "device_is_new": ("flag", "decrease", "a known device"),
    "auth_attempts": ("count", "decrease", "a login at the first try"),
}
#: Values tried for a field: quantiles of legitimate payments (fixed values).
TRIED = [0.05, 0.15, 0.25, 0.4, 0.5, 0.65, 0.8, 0.9, 0.95]


class Encoder:
    """Numeric columns with a missing mark each, and categories learned on train."""

    def __init__(self, numeric: Sequence[str], categories: Sequence[str] = ()):
        self.numeric, self.categories = list(numeric), list(categories)

    def fit(self, train: DataFrame) -> "Encoder":
        self._imputer = Imputer(strategy="median", inputCols=self.numeric, outputCols=[f"_i_{c}" for c in self.numeric]).fit(self._doubles(train))
        self._indexers = [StringIndexer(inputCol=c, outputCol=f"_x_{c}", handleInvalid="keep").fit(train) for c in self.categories]
        return self

    def _doubles(self, df):
        return df.select(*[c for c in df.columns if c not in self.numeric], *[F.col(c).cast("double").alias(c) for c in self.numeric])

    def transform(self, df: DataFrame) -> DataFrame:
        out = self._doubles(df).select("*", *[F.col(c).isNull().cast("double").alias(f"_m_{c}") for c in self.numeric])
        out = self._imputer.transform(out)
        for indexer in self._indexers:
            out = indexer.transform(out)
        inputs = [f"_i_{c}" for c in self.numeric] + [f"_m_{c}" for c in self.numeric] + [f"_x_{c}" for c in self.categories]
        out = VectorAssembler(inputCols=inputs, outputCol="features").transform(out)
        return out.drop(*inputs)


def balance(df: DataFrame, label: str = "is_fraud") -> DataFrame:
    """Weights that give both classes the same total."""
    size = df.agg(F.sum(label).alias("_p"), F.count(F.lit(1)).alias("_n"))
    w = F.when(F.col(label) == 1, F.col("_n") / (2.0 * F.col("_p"))).otherwise(F.col("_n") / (2.0 * (F.col("_n") - F.col("_p"))))
    rows = attach_totals(df, size, [])
    return rows.select(*df.columns, w.alias("_w"))


def _logit(p):
    p = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(p / (1 - p))


class Novelty:
    """How far into the tails of legitimate traffic a row's values lie; higher is stranger."""

    PROBS = [0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99]

    def __init__(self, columns: Sequence[str]):
        self.columns = list(columns)

    def fit(self, df: DataFrame) -> "Novelty":
        rows = column_quantiles(df.where("is_fraud = 0"), self.columns, self.PROBS).collect()  # columns x 7 numbers
        self.grid = {c: sorted((r["p"], r["q"]) for r in rows if r["column"] == c) for c in self.columns}
        return self

    def score(self):
        def tail(c):
            lows = [F.when(F.col(c) < q, F.lit(p)) for p, q in self.grid[c] if p <= 0.5]
            highs = [F.when(F.col(c) > q, F.lit(1 - p)) for p, q in self.grid[c] if p >= 0.5]
            return F.coalesce(F.least(*lows, *highs), F.lit(0.5))
        return reduce(lambda a, b: a + b, [-F.log(tail(c)) for c in self.columns])


class StackedScorer:
    """Boosting, forest and novelty, stacked by a logistic model on the calibration slice.

    The alert cut is the exact order statistic of calibration scores at the false-positive budget.
    """

    def __init__(self, numeric: Sequence[str], categories: Sequence[str] = (), trees: int = 10, depth: int = 4, seed: int = 7):
        self.encoder, self.novelty = Encoder(numeric, categories), Novelty(numeric)
        self.trees, self.depth, self.seed = trees, depth, seed

    def _base(self, df):
        out = self.encoder.transform(df.withColumn("_nov", self.novelty.score()))
        for name, model in (("gbt", self.gbt), ("rf", self.rf)):
            out = model.transform(out).withColumn(f"logit_{name}", _logit(vector_to_array("probability")[1])).drop("rawPrediction", "probability", "prediction")
        return VectorAssembler(inputCols=["logit_gbt", "logit_rf", "_nov"], outputCol="_stack").transform(out)

    def fit(self, train: DataFrame, calibration: DataFrame) -> "StackedScorer":
        self.encoder.fit(train)
        self.novelty.fit(train)
        ready = balance(self.encoder.transform(train)).persist()
        bins = 64
        self.gbt = GBTClassifier(labelCol="is_fraud", maxIter=self.trees, maxDepth=self.depth, stepSize=0.1, maxBins=bins, seed=self.seed).fit(ready)
        self.rf = RandomForestClassifier(labelCol="is_fraud", weightCol="_w", numTrees=self.trees, maxDepth=self.depth, maxBins=bins, seed=self.seed).fit(ready)
        ready.unpersist()
        self.meta = LogisticRegression(labelCol="is_fraud", featuresCol="_stack", weightCol="_w", regParam=0.01).fit(balance(self._base(calibration)))
        held = self.transform(calibration)
        self.cut = curve.operating_points(curve.score_curve(held, money=None), [TARGET_FPR]).first()["cut"]
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        out = self.meta.transform(self._base(df.drop("score")))
        score = F.round(vector_to_array("probability")[1], 6)
        return out.withColumn("score", score).drop("rawPrediction", "probability", "prediction", "_stack", "features")


def recall_at_budget(scored: DataFrame, budget: float = TARGET_FPR):
    p = curve.operating_points(curve.score_curve(scored, money=None), [budget]).first()
    return float(p["tp"] or 0) / max(p["p"], 1)


def logistic_baseline(train: DataFrame, test: DataFrame, numeric: Sequence[str]) -> DataFrame:
    """Median imputation, spread around the median, balanced logistic model."""
    spread = train.agg(*[F.stddev_pop(F.col(c).cast("double")).alias(c) for c in numeric]).first()
    med = {r["column"]: r["q"] for r in column_quantiles(train, list(numeric), [0.5]).collect()}
    scale = lambda d: VectorAssembler(inputCols=[f"_z_{c}" for c in numeric], outputCol="features").transform(d.select(
        "*", *[((F.coalesce(F.col(c).cast("double"), F.lit(med[c])) - med[c]) / (spread[c] or 1.0)).alias(f"_z_{c}") for c in numeric]))
    model = LogisticRegression(labelCol="is_fraud", weightCol="_w", regParam=0.5).fit(balance(scale(train)))
    return model.transform(scale(test.drop("score"))).withColumn("score", F.round(vector_to_array("probability")[1], 6)).select(*test.columns)


def shuffled(df: DataFrame, column: str, key: str, seed: int) -> DataFrame:
    """``column`` re-paired across rows at random: values ranked by one hash meet rows ranked by another."""
    def rank(d, salt, name):
        h = d.withColumn("_h", F.xxhash64(key, F.lit(salt), F.lit(seed))).withColumn("_l1", F.shiftright("_h", 44)).withColumn("_c", F.lit(1).cast("long"))
        return ordered_history(h, [], ["_l1"], ["_h", key], sums=["_c"]).withColumnRenamed("before__c", name).drop("_h", "_l1", "_c")
    values = rank(df.select(key, column), 1, "_rank").drop(key)
    return rank(df.drop(column), 2, "_rank").join(values, "_rank").drop("_rank")


def permutation_importance(model: StackedScorer, sample: DataFrame, columns: Sequence[str], key: str, repeats: int = 1) -> DataFrame:
    """Drop in AUC when one column is shuffled."""
    auc = lambda d: curve.roc_auc(curve.score_curve(model.transform(d), money=None)).first()["auc"]
    base = auc(sample)
    rows = [(c, base - sum(auc(shuffled(sample, c, key, r)) for r in range(repeats)) / repeats) for c in columns]
    return sample.sparkSession.createDataFrame(rows, "column string, importance double")


def rule_candidates(scored: DataFrame, columns: Sequence[str], cut: float) -> DataFrame:
    """Best single condition on missed fraud: cuts at its quartiles, value ``hit - 25 * noise``."""
    missed = (F.col("is_fraud") == 1) & (F.col("score") < cut)
    long = long_numeric(scored.withColumn("_missed", fx.flag(missed)), list(columns), ["_missed", "is_fraud"]).where("value IS NOT NULL")
    q = wide_quantiles(exact_quantiles(long.where("_missed = 1"), ["column"], "value", [0.25, 0.75]), ["column"], {0.25: "q25", 0.75: "q75"})
    t = long.join(F.broadcast(q), "column")
    tests = {">=": (F.col("value") >= F.col("q75"), "q75"), "<=": (F.col("value") <= F.col("q25"), "q25")}
    parts = []
    for op, (hit, at) in tests.items():
        parts.append(t.groupBy("column").agg(
            F.lit(op).alias("op"), F.max(at).alias("value"), F.max("n").alias("missed"), F.avg(F.when(F.col("_missed") == 1, hit.cast("double"))).alias("hit"),
            F.avg(F.when(F.col("is_fraud") == 0, hit.cast("double"))).alias("noise")))
    out = parts[0].unionByName(parts[1]).where("missed >= 8")
    return out.withColumn("worth", F.col("hit") - 25 * F.col("noise")).withColumn("accepted", fx.flag((F.col("noise") <= 0.005) & (F.col("worth") > 0)))


def mine_rule(scored: DataFrame, columns: Sequence[str], cut: float, conditions: int = 2, min_missed: int = 8) -> DataFrame:
    """``place, column, op, value, missed, hit, noise, worth, accepted``: a rule on missed fraud of at most ``conditions`` conditions.

    Candidates cut each column at the quartiles of missed fraud. One aggregate tries all of them behind the conditions chosen so
    far; the one with the most ``hit - 25 * noise`` is added if the rule gains by it, ties by column, then operator. Only that
    aggregate's row and two numbers per column reach the driver. Fewer than ``min_missed`` missed frauds give no rule.
    """
    missed = fx.flag((F.col("is_fraud") == 1) & (F.col("score") < cut))
    rows = durable(scored.select(missed.alias("_missed"), (1 - F.col("is_fraud")).alias("_legit"), *[F.col(c).cast("double").alias(c) for c in columns]))
    long = long_numeric(rows.where("_missed = 1"), list(columns), []).where("value IS NOT NULL")
    cuts = exact_quantiles(long, ["column"], "value", [0.25, 0.75]).collect()
    tried = sorted((r["column"], "<=" if r["p"] == 0.25 else ">=", r["q"]) for r in cuts)
    fires = lambda c, op, at: F.coalesce(F.col(c) <= at if op == "<=" else F.col(c) >= at, F.lit(False))
    so_far, found = F.lit(True), []
    for place in range(1, conditions + 1 if tried else 1):
        both = [so_far & fires(*t) for t in tried]
        sums = rows.agg(F.sum("_missed"), F.sum("_legit"), *[F.sum(F.when(b, F.col(side))) for b in both for side in ("_missed", "_legit")]).first()
        n, legit, counts = sums[0], sums[1], [k or 0 for k in sums[2:]]
        if n < min_missed:
            break
        rates = [(counts[2 * i] / n, counts[2 * i + 1] / max(legit, 1)) for i in range(len(tried))]
        best = max(range(len(tried)), key=lambda i: (rates[i][0] - 25 * rates[i][1], -i))
        hit, noise = rates[best]
        worth = hit - 25 * noise
        if found and worth <= found[-1][7]:
            break
        found.append((place, *tried[best], n, hit, noise, worth, int(noise <= 0.005 and worth > 0)))
        so_far = so_far & fires(*tried[best])
    return scored.sparkSession.createDataFrame(found, "place long, column string, op string, value double, missed long, hit double, noise double, worth double, accepted long")


def counterfactual_trials(alerts: DataFrame, legitimate: DataFrame, key: str, fields: dict = FIELDS) -> DataFrame:
    """One row per (alert, field, benign value) in the direction that lowers risk.

    Values come from the quantiles ``TRIED`` of legitimate payments; a flag is tried unset. The changed column holds the value.
    """
    q = column_quantiles(legitimate.where("is_fraud = 0"), list(fields), TRIED)
    points = q.groupBy("column").agg(F.array_distinct(F.collect_list(F.round("q", 4))).alias("pts"), (F.max("q") - F.min("q")).alias("spread"))
    long = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.lit(u).alias("unit"), F.lit(d).alias("dir"), F.col(c).cast("double").alias("from")) for c, (u, d, _) in fields.items()]))
    each = alerts.select("*", long.alias("_f")).select(*alerts.columns, "_f.*").join(F.broadcast(points), "column")  # one row per field
    tries = F.when(F.col("unit") == "flag", F.when(F.col("from") != 0, F.array(F.lit(0.0))).otherwise(F.array().cast("array<double>"))).otherwise(
        F.filter("pts", lambda p: F.when(F.col("dir") == "increase", p > F.col("from")).otherwise(p < F.col("from"))))
    out = each.where("`from` IS NOT NULL").withColumn("to", F.explode(tries))
    moved = {c: F.when(F.col("column") == c, F.col("to")).otherwise(F.col(c).cast("double")).alias(c) for c in fields}
    return out.select(*[moved.get(c, F.col(c)) for c in alerts.columns], "column", "unit", "from", "to",
                      F.when(F.col("spread") == 0, 1.0).otherwise(F.abs("spread")).alias("spread"))


def counterfactuals(alerts: DataFrame, scored_trials: DataFrame, cut: float, key: str, top: int = 3, fields: dict = FIELDS) -> DataFrame:
    """Smallest sufficient change per field, three fields per alert; an alert that no single field flips keeps one row of NULLs."""
    move = F.abs(F.col("to") - F.col("from")) / F.col("spread")
    best = scored_trials.where(F.col("score") <= cut).groupBy(key, "column").agg(
        F.min(F.struct(move.alias("normalised_move"), "to", "from", "unit", F.col("score").alias("score_after"))).alias("b")).select(key, "column", "b.*")
    w = Window.partitionBy(key).orderBy("normalised_move", "column")
    words = {c: text for c, (_, _, text) in fields.items()}
    found = best.withColumn("place", F.row_number().over(w)).where(F.col("place") <= top).withColumn("text", phrase(fx.lookup(F.col("column"), words, "it"), F.col("unit"), F.col("to")))
    return alerts.select(key).join(found, key, "left")


def phrase(label, unit, to):
    """One counterfactual as a sentence."""
    amount = F.when(unit == "currency", F.format_number(to, 0)).when(unit == "score", F.format_number(to, 2)).when(
        unit.isin("flag", "count"), F.lit("")).otherwise(F.concat_ws(" ", F.format_number(F.rint(to), 0), unit))
    return F.concat(F.lit("Approved if "), F.trim(F.concat_ws(" ", label, amount)), F.lit("."))


def normalise_text(text):
    """Fold spacing and case, drop zero-width characters, unwrap HTML comments. NFKC is a separate Arrow step."""
    t = F.regexp_replace(text, "[​‌‍⁠﻿]", "")
    t = F.regexp_replace(t, r"(?s)<!--(.*?)-->", " $1 ")
    return F.lower(F.trim(F.regexp_replace(t, r"\s+", " ")))


def nfkc(df: DataFrame, text: str) -> DataFrame:
    """Compatibility normalisation, the one text step Spark SQL has no function for."""
    @F.pandas_udf("string")
    def fold(s: pd.Series) -> pd.Series:
        return s.str.normalize("NFKC")

    return df.withColumn(text, fold(F.col(text)))


def text_terms(df: DataFrame, text: str) -> DataFrame:
    """``df`` with ``_terms``: word 1-2 grams and character 3-5 grams of the folded text."""
    words = F.filter(F.split(F.col("_t"), r"[^\p{L}\p{N}_]+"), lambda w: w != "")
    pairs = F.when(F.size("_w") > 1, F.transform(F.sequence(F.lit(1), F.size("_w") - 1), lambda i: F.concat(F.get("_w", i - 1), F.lit(" "), F.get("_w", i)))).otherwise(F.array().cast("array<string>"))

    # a word and a blank on either side of it; a gram has no blank but at its ends, so it lies in one word
    padded = F.concat(F.lit(" "), F.array_join("_w", "  "), F.lit(" "))

    def grams(n):
        return F.transform(F.regexp_extract_all(padded, F.lit(f"(?=(.[^ ]{{{n - 2}}}.))."), F.lit(1)), lambda g: F.concat(F.lit("#"), g))

    # texts lie in few row groups, each of which is one task's work
    spread = df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism)
    prepared = nfkc(spread.withColumn("_t", F.col(text)), "_t").withColumn("_t", normalise_text(F.col("_t"))).withColumn("_w", words)
    return prepared.withColumn("_terms", F.concat("_w", pairs, grams(3), grams(4), grams(5))).drop("_t", "_w")


def text_features(df: DataFrame, text: str, size: int = 1 << 18, keep_terms: bool = False) -> DataFrame:
    """Grams of :func:`text_terms`, hashed; a term's weight comes from the IDF behind it."""
    return HashingTF(inputCol="_terms", outputCol="_tf", numFeatures=size).transform(text_terms(df, text)).drop(*([] if keep_terms else ["_terms"]))


#: Folds of a calibrated guard, and its false-positive budget (fixed values).
FOLDS, TEXT_FPR = 3, 0.01


def dampened(df: DataFrame, column: str) -> DataFrame:
    """Sparse counts of ``column`` as ``1 + ln(count)``, by way of a table in the shared folder.

    No function makes a sparse vector of places and values, but a table of those reads as one if the schema says so. A Python function
    would have every vector's places checked one by one.
    """
    spark, folder = df.sparkSession, f"{shared_folder(df.sparkSession)}/counts-{uuid.uuid4().hex}"
    v = F.unwrap_udt(column)
    logs = F.struct(v["type"].alias("type"), v["size"].alias("size"), v["indices"].alias("indices"), F.transform(v["values"], lambda x: 1.0 + F.log(x)).alias("values"))
    df.withColumn(column, logs).write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


class TextGuard:
    """Hashed grams with sublinear weights under a balanced linear model, calibrated by isotonic regression on held-out folds.

    Each fold's model is fitted on the other folds, and its scores of the fold are pooled into a rising step curve; a score is
    the mean of the folds' calibrated ones. Folds go by the hash of the text, so equal texts never stand on both sides.
    """

    def __init__(self, text: str, label: str, folds: int = FOLDS) -> None:
        self.text, self.label, self.folds = text, label, folds

    def counted(self, df: DataFrame) -> DataFrame:
        """``df`` without its text, with the damped counts of its grams and its fold: what fits and scores of any part of ``df`` read."""
        given = df.withColumn("_text", F.coalesce(self.text, F.lit(""))).withColumn("_fold", F.pmod(F.xxhash64("_text"), F.lit(self.folds)))
        return dampened(text_features(given.drop(*({self.text} - {"_text"})), "_text").drop("_text"), "_tf")

    def fit(self, train: DataFrame) -> TextGuard:
        """Too few positives is an error."""
        self._enough(train)
        return self.fit_counts(self.counted(train.select(self.text, self.label)))

    def _enough(self, train: DataFrame) -> None:
        if train.where(F.col(self.label) == 1).limit(MIN_POSITIVES).count() < MIN_POSITIVES:
            raise ValueError(f"a text guard needs at least {MIN_POSITIVES} positive documents")

    def fit_counts(self, counts: DataFrame) -> TextGuard:
        """:meth:`fit` on rows of :meth:`counted`."""
        self._enough(counts)
        self.idf = IDF(inputCol="_tf", outputCol="features").fit(counts)
        ready = durable(self.idf.transform(counts).select(self.label, "features", "_fold"))
        self.parts, cores = [], counts.sparkSession.sparkContext.defaultParallelism
        for k in range(self.folds):
            rest, held = ready.where(F.col("_fold") != k), ready.where(F.col("_fold") == k)
            if rest.agg(F.count_distinct(self.label)).first()[0] < 2 or held.limit(1).count() == 0:
                continue
            # every partition of every step sends a gradient of all slots, 2 MB: no more of them than cores
            model = LogisticRegression(labelCol=self.label, weightCol="_w", maxIter=30, regParam=0.02).fit(balance(rest, self.label).coalesce(cores))
            told = model.transform(held).select(F.col(self.label).cast("double").alias("y"), vector_to_array("probability")[1].alias("p"))
            curve_ = IsotonicRegression(featuresCol="p", labelCol="y", predictionCol="c").fit(told)
            steps = (list(curve_.boundaries), list(curve_.predictions))
            self.parts.append((model, steps))
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        """``df`` with ``score``, a calibrated chance."""
        out = df.withColumn("_text", F.coalesce(self.text, F.lit("")))
        return self.score_counts(dampened(text_features(out, "_text"), "_tf")).select(*df.columns, "score")

    def score_counts(self, counts: DataFrame) -> DataFrame:
        """Rows of :meth:`counted` with ``score``, without their counts."""
        out, kept = self.idf.transform(counts), [c for c in counts.columns if c not in ("_tf", "_fold", "_text")]
        means = []
        for i, (model, steps) in enumerate(self.parts):
            out = model.transform(out).withColumn(f"_p{i}", vector_to_array("probability")[1]).drop("rawPrediction", "probability", "prediction")
            means.append(stepped(F.col(f"_p{i}"), *steps))
        score = reduce(lambda a, b: a + b, means) / len(means)
        return out.withColumn("score", F.round(score, 6)).select(*kept, "score")


def stepped(value: Column, boundaries: Sequence[float], predictions: Sequence[float]) -> Column:
    """A rising curve through ``boundaries`` and ``predictions``, straight between them and level beyond."""
    if len(boundaries) == 1:
        return F.lit(float(predictions[0]))
    b, p = F.array(*[F.lit(float(x)) for x in boundaries]), F.array(*[F.lit(float(x)) for x in predictions])
    k = F.least(F.greatest(F.size(F.filter(b, lambda x: x <= value)), F.lit(1)), F.lit(len(boundaries) - 1))
    x0, x1, y0, y1 = F.get(b, k - 1), F.get(b, k), F.get(p, k - 1), F.get(p, k)
    inside = F.when(x1 > x0, y0 + (y1 - y0) * (value - x0) / (x1 - x0)).otherwise(y1)
    return F.when(value <= boundaries[0], float(predictions[0])).when(value >= boundaries[-1], float(predictions[-1])).otherwise(inside)


def fit_text_guard(train: DataFrame, text: str, label: str):
    """A fitted :class:`TextGuard` as a function that adds ``score``."""
    return TextGuard(text, label).fit(train).transform


def recall_by_group(scored: DataFrame, group: str, cut: float, label: str = "is_fraud") -> DataFrame:
    """``group, positives, caught, recall`` with bounds of each group's positives, and those of all as ``*``."""
    hit = fx.flag(F.col("score") > cut)
    each = scored.where(F.col(label) == 1).select(F.explode(F.array(F.coalesce(F.col(group).cast("string"), F.lit("")), F.lit("*"))).alias("group"), hit.alias("_hit"))
    out = each.groupBy("group").agg(F.count("*").alias("positives"), F.sum("_hit").alias("caught"))
    return fx.with_wilson(out.withColumn("recall", F.col("caught") / F.col("positives")), "recall", "positives")


def _at_budget(scored: DataFrame):
    return curve.operating_points(curve.score_curve(scored, money=None), [TEXT_FPR]).first()


def group_holdout(df: DataFrame, text: str, label: str, group: str, groups: Sequence[str]) -> DataFrame:
    """Leave one group's rows out, refit, and measure recall on its positives at 1% of its negatives. Grams are counted once for all fits."""
    rows = []
    counts = TextGuard(text, label).counted(df.select(text, label, group))
    for g in groups:
        out = (F.col(group) == g)
        fitted = TextGuard(text, label).fit_counts(counts.where(~out))
        p = _at_budget(fitted.score_counts(counts.where(out)).withColumnRenamed(label, "is_fraud"))
        rows.append((str(g), int(p["p"]), float(p["tp"] or 0) / max(p["p"], 1)))
    return fx.with_wilson(df.sparkSession.createDataFrame(rows, "held_out string, positives long, recall double"), "recall", "positives")


def phrasing(text: Column) -> Column:
    """Which phrasing a text is of: its least hash of five consecutive words, so that copies with other ends share it as a rule."""
    def least(words):
        grams = F.when(F.size(words) >= 5, F.transform(F.sequence(F.lit(0), F.size(words) - 5), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(5)])))
        return F.coalesce(F.array_min(grams), F.xxhash64(F.array_join(words, " ")))

    # a list of one, so that the words are cut once a text and not once a gram
    return F.transform(F.array(F.filter(F.split(normalise_text(text), r"[^\p{L}\p{N}_]+"), lambda w: w != "")), least)[0]


def phrasing_holdout(df: DataFrame, text: str, label: str, group: str) -> DataFrame:
    """Recall by ``group`` on the half of the phrasings that the guard has not seen, at 1% of their negatives."""
    side = F.pmod(F.xxhash64(phrasing(F.coalesce(text, F.lit("")))), F.lit(2))
    split = durable(df.withColumn("_side", side))
    score = fit_text_guard(split.where("_side = 0"), text, label)
    seen = durable(score(split.where("_side = 1")).withColumnRenamed(label, "is_fraud"))
    return recall_by_group(seen, group, _at_budget(seen)["cut"])


def unseen_wording(guard, table: DataFrame, label: str, group: str) -> DataFrame:
    """Recall by ``group`` on a supplied table of other wording, with the cut taken anew on its own negatives."""
    told = durable(guard(table).withColumnRenamed(label, "is_fraud"))
    return recall_by_group(told, group, _at_budget(told)["cut"])


def legit_stats(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``column, mean, std`` of each numeric column over legitimate payments: population deviation plus 1e-9."""
    long = long_numeric(df.where("is_fraud = 0"), list(columns), []).where("value IS NOT NULL")
    return long.groupBy("column").agg(F.avg("value").alias("mean"), (F.stddev_pop("value") + 1e-9).alias("std"))


def candidate_gain(train: DataFrame, calibration: DataFrame, test: DataFrame, numeric: Sequence[str], candidate: str, categories: Sequence[str] = (), **fit) -> DataFrame:
    """Recall at the budget with and without one more column; accepted at a gain of ``ACCEPT_GAIN``."""
    base, more = (recall_at_budget(StackedScorer(cols, categories, **fit).fit(train, calibration).transform(test)) for cols in (list(numeric), [*numeric, candidate]))
    return test.sparkSession.createDataFrame([(candidate, base, more, more - base, int(more - base >= ACCEPT_GAIN))], "candidate string, recall_before double, recall_after double, gain double, accepted long")


def separability(df: DataFrame, numeric: Sequence[str], ts: str, repeats: int = 3, rounds: int = 10, seed: int = 7) -> DataFrame:
    """Recall at the review budget of boosted trees fitted on the first 70% of time, over bootstrap refits.

    A refit draws Poisson weights from seeded hashes. The Wilson bounds are widened by half the
    spread of the refits; a table is flagged on the lower bound and warned about on the point.
    """
    edge = df.agg(F.min(ts).alias("a"), F.max(ts).alias("b")).first()
    at = edge["a"] + 0.7 * (edge["b"] - edge["a"])
    train, test = df.where(F.col(ts) < at), df.where(F.col(ts) >= at)
    encoder = Encoder(numeric).fit(train)
    ready, held = encoder.transform(train).persist(), encoder.transform(test)
    recalls = []
    for r in range(repeats):
        u = F.pmod(F.xxhash64("txn_id", F.lit(r), F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
        draw = F.when(u < 0.36788, 0.0).when(u < 0.73576, 1.0).when(u < 0.91970, 2.0).when(u < 0.98101, 3.0).otherwise(4.0)
        model = GBTClassifier(labelCol="is_fraud", weightCol="_draw", maxDepth=4, stepSize=0.05, maxIter=rounds, seed=seed).fit(
            ready.withColumn("_draw", draw).where("_draw > 0"))
        scored = model.transform(held.drop("score")).withColumn("score", F.round(vector_to_array("probability")[1], 6))
        recalls.append(recall_at_budget(scored))
    ready.unpersist()
    positives = test.where("is_fraud = 1").count()
    middle, spread = sorted(recalls)[len(recalls) // 2], max(recalls) - min(recalls)
    one = df.sparkSession.createDataFrame([(middle, spread, positives)], "recall double, spread double, positives long")
    lo, hi = fx.wilson(F.col("recall"), F.col("positives"))
    out = one.select("*", F.greatest(F.lit(0.0), lo - F.col("spread") / 2).alias("lo95"), F.least(F.lit(1.0), hi + F.col("spread") / 2).alias("hi95"))
    return out.select("*", fx.flag(F.col("lo95") > 0.92).alias("flag"), fx.flag(F.col("recall") > 0.92).alias("warning"))


def indicative_terms(df: DataFrame, text: str, label: str, top: int = 20, size: int = 1 << 18) -> DataFrame:
    """``kind, term, weight`` of the words, word pairs and character grams with the largest weights either way.

    Grams are hashed, so no vocabulary limits them. The slots with the largest weights, a few times ``top``, are joined back to
    the grams of the texts, cut once more, for grams as strings are many times their texts and no table holds them; of the grams that
    share a slot the one in most documents names it. A gram of one document names none.
    """
    given = df.select(F.coalesce(text, F.lit("")).alias(text), label)
    counts = dampened(text_features(given, text, size).drop(text), "_tf")
    ready = IDF(inputCol="_tf", outputCol="features", minDocFreq=2).fit(counts).transform(counts)
    model = LogisticRegression(labelCol=label, weightCol="_w", maxIter=30, regParam=0.05).fit(balance(ready, label).coalesce(df.sparkSession.sparkContext.defaultParallelism))
    weights = model.coefficients.toArray()
    chosen = np.argsort(-np.abs(weights), kind="stable")[:40 * top]  # model-sized
    slots = df.sparkSession.createDataFrame([(int(i), float(weights[i])) for i in chosen if weights[i]], "slot long, weight double")
    # the hash of the feature step: Murmur3 of the term's bytes, seed 42, into ``size`` slots
    terms = text_terms(given.select(text), text).select(F.explode(F.array_distinct("_terms")).alias("term")).withColumn("slot", F.pmod(F.hash("term"), F.lit(size)).cast("long"))
    named = terms.join(F.broadcast(slots), "slot").groupBy("slot", "term").agg(F.count("*").alias("docs"), F.max("weight").alias("weight")).where("docs > 1")
    best = named.groupBy("slot").agg(F.max(F.struct("docs", "term")).alias("b"), F.max("weight").alias("weight")).select(F.col("b.term").alias("t"), "weight")
    kind = F.when(F.col("t").startswith("#"), "characters").when(F.col("t").contains(" "), "pair").otherwise("word")
    rows = best.select(kind.alias("kind"), F.regexp_replace("t", "^#", "").alias("term"), "weight")
    high, low = (Window.partitionBy("kind").orderBy(o, "term") for o in (F.desc("weight"), F.asc("weight")))
    placed = rows.withColumns({"_h": F.row_number().over(high), "_l": F.row_number().over(low)})
    return placed.where((F.col("_h") <= top) & (F.col("weight") > 0) | (F.col("_l") <= top) & (F.col("weight") < 0)).drop("_h", "_l")
