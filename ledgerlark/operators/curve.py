"""Score curves: metrics from counts per distinct score, never from score x threshold grids."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import durable
from .ordered import attach_totals, ordered_history, value_levels, value_scan

BUDGETS = [0.001, 0.002, 0.005, 0.01, 0.02, 0.05]
SUMS = ["pos", "neg", "pos_cents"]

# Prices per event and the reimbursed share.
PRICES = {"reimbursement_share": 0.5, "analyst_review": 250.0, "false_decline": 900.0, "step_up_friction": 40.0}


def collapse(df: DataFrame, score: str = "score", label: str = "is_fraud", part: Sequence[str] = (),
             money: str | None = "cents") -> DataFrame:
    """One row per distinct score: fraud rows, legitimate rows, fraud money."""
    fraud = F.col(label) == 1
    return df.groupBy(*part, F.col(score).cast("double").alias("score")).agg(
        F.sum(F.when(fraud, 1).otherwise(0)).alias("pos"),
        F.sum(F.when(fraud, 0).otherwise(1)).alias("neg"),
        F.sum(F.when(fraud, F.col(money) if money else F.lit(0)).otherwise(0)).alias("pos_cents"),
    )


def score_curve(df: DataFrame, part: Sequence[str] = (), **names) -> DataFrame:
    """Distinct scores with what lies strictly above each, ``before_pos``, ``before_neg``, and the totals ``p``, ``n``, ``p_cents``.

    The counts per score are cut off from their source, and totals are sums of them: the payments are read once.
    """
    counts = durable(collapse(df, part=part, **names))
    return _with_totals(value_scan(counts, part, "score", SUMS, descending=True), counts, part)


def _with_totals(scan, counts, part):
    return attach_totals(scan, totals(counts, part), part)


def _grouped(df, part):
    return df.groupBy(*part) if part else df.groupBy()


def roc_auc(curve: DataFrame, part: Sequence[str] = ()) -> DataFrame:
    area = F.sum(F.col("neg") * (F.col("before_pos") + F.col("pos") / F.lit(2.0)))
    p, n = F.sum("pos"), F.sum("neg")
    return _grouped(curve, part).agg(F.when((p > 0) & (n > 0), area / (p.cast("double") * n)).otherwise(0.5).alias("auc"))


def average_precision(curve: DataFrame, part: Sequence[str] = ()) -> DataFrame:
    tp = F.col("before_pos") + F.col("pos")
    step = F.col("pos") * (tp / (tp + F.col("before_neg") + F.col("neg")))
    return _grouped(curve, part).agg(F.try_divide(F.sum(step), F.sum("pos")).alias("average_precision"))


def totals(curve: DataFrame, part: Sequence[str] = ()) -> DataFrame:
    return _grouped(curve, part).agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"), F.sum("pos_cents").alias("p_cents"))


def partial_auc(curve: DataFrame, max_fpr: float = 0.02, part: Sequence[str] = ()) -> DataFrame:
    """Area up to ``max_fpr``, one point per distinct score, rescaled so that chance reads 0.5; NULL when a class is empty."""
    f0, f1 = F.try_divide("before_neg", "n"), F.try_divide(F.col("before_neg") + F.col("neg"), F.col("n"))
    t0, t1 = F.try_divide("before_pos", "p"), F.try_divide(F.col("before_pos") + F.col("pos"), F.col("p"))
    cut = F.lit(float(max_fpr))
    t_cut = t0 + (t1 - t0) * (cut - f0) / (f1 - f0)
    piece = (
        F.when(f1 <= cut, (f1 - f0) * (t0 + t1) / 2).when(f0 < cut, (cut - f0) * (t0 + t_cut) / 2).otherwise(0.0)
    )
    low, high = 0.5 * max_fpr * max_fpr, max_fpr
    area = F.sum(F.round(piece, 15).cast("decimal(30,15)")).cast("double")
    scaled = 0.5 * (1.0 + (area - low) / (high - low))
    return _grouped(curve, part).agg(F.when((F.max("p") > 0) & (F.max("n") > 0), scaled).alias("partial_auc"))


def operating_points(curve: DataFrame, budgets: Sequence[float] = BUDGETS, part: Sequence[str] = ()) -> DataFrame:
    """Per budget the score that alerts must exceed, and what they then hold.

    With ``floor(budget * n)`` false alerts allowed, the cut is the highest score whose inclusion
    would exceed them; alerts are the rows strictly above it. Without negatives the cut is 0.5.
    """
    c = curve
    over = [(F.col("before_neg") + F.col("neg")) > F.floor(F.lit(b) * F.col("n")) for b in budgets]
    pick = F.struct("score", F.col("before_pos").alias("tp"), F.col("before_neg").alias("fp"), F.col("before_pos_cents").alias("tp_cents"))
    best = _grouped(c, part).agg(
        F.max("p").alias("p"), F.max("n").alias("n"), F.max("p_cents").alias("p_cents"),
        *[F.max(F.when(o, pick)).alias(f"_b{i}") for i, o in enumerate(over)],
    )
    rows = F.explode(F.array(*[
        F.struct(F.lit(float(b)).alias("target_fpr"), F.col(f"_b{i}").alias("at")) for i, b in enumerate(budgets)
    ]))
    out = best.select(*part, "p", "n", "p_cents", rows.alias("_r"))
    return out.select(
        *part, "p", "n", "p_cents", F.col("_r.target_fpr").alias("target_fpr"),
        F.coalesce(F.col("_r.at.score"), F.lit(0.5)).alias("cut"),
        *[F.col(f"_r.at.{c}").alias(c) for c in ("tp", "fp", "tp_cents")],
    )


def operating_curve(points: DataFrame) -> DataFrame:
    alerts = F.col("tp") + F.col("fp")
    return points.select(
        "target_fpr", "cut", F.try_divide("tp", "p").alias("recall"),
        F.when(alerts > 0, F.col("tp") / alerts).otherwise(0.0).alias("precision"),
        F.when(F.col("p_cents") > 0, F.col("tp_cents") / F.col("p_cents")).alias("value_recall"),
        F.try_divide(alerts * F.lit(10000.0), F.col("p") + F.col("n")).alias("alerts_per_10k"),
    )


def curve_lookup(curve_counts: DataFrame, cuts: DataFrame) -> DataFrame:
    """Totals with ``score >= cut`` for each row of ``cuts(cut, ...)``, by one ordered scan."""
    union = curve_counts.select("score", *SUMS, F.lit(0).alias("_kind")).unionByName(
        cuts.select("*", F.col("cut").alias("score"), F.lit(1).alias("_kind")), allowMissingColumns=True)
    high, low = value_levels(-F.col("score"))
    keyed = union.select("*", (-F.col("score")).alias("_x"), high.alias("_l1"), low.alias("_l2"))
    seen = ordered_history(keyed, [], ["_l1", "_l2"], ["_x", "_kind"], sums=SUMS).where("_kind = 1")
    return seen.select(*cuts.columns, *[F.col(f"before_{s}").alias(s) for s in SUMS])


def cost_curve(curve_counts: DataFrame, cuts: DataFrame, deployed: float, prices: dict = PRICES) -> DataFrame:
    """Itemised cost per candidate cut, with the cheapest and the deployed one marked."""
    found = curve_lookup(curve_counts, cuts.select("cut").distinct())
    t = attach_totals(found, totals(curve_counts), [])
    alerts, missed = F.col("pos") + F.col("neg"), (F.col("p_cents") - F.col("pos_cents")) / F.lit(100.0)
    out = t.select(
        F.col("cut").alias("threshold"), F.try_divide("pos", "p").alias("recall"),
        F.try_divide("neg", "n").alias("false_positive_rate"), alerts.alias("alerts"),
        missed.alias("fraud_value_missed"), (missed * prices["reimbursement_share"]).alias("fraud_losses"),
        (alerts * prices["analyst_review"]).alias("alert_review"),
        (F.col("neg") * prices["false_decline"]).alias("false_declines"),
        (F.col("p_cents") / F.lit(100.0) * prices["reimbursement_share"]).alias("do_nothing_cost"),
    ).withColumn("total_cost", F.col("fraud_losses") + F.col("alert_review") + F.col("false_declines"))
    out = out.withColumn("net_benefit", F.col("do_nothing_cost") - F.col("total_cost"))
    best = out.groupBy().agg(
        F.min(F.struct("total_cost", "threshold")).alias("_opt"),
        F.min(F.struct(F.abs(F.col("threshold") - deployed).alias("d"), F.col("threshold").alias("t"))).alias("_dep"),
    )
    marked = attach_totals(out, best, [])
    return marked.select(
        *out.columns, (F.col("threshold") == F.col("_opt.threshold")).cast("long").alias("is_optimal"),
        (F.col("threshold") == F.col("_dep.t")).cast("long").alias("is_deployed"))


def cost_summary(costs: DataFrame, prices: dict = PRICES) -> DataFrame:
    at = lambda mark, c: F.max(F.when(F.col(mark) == 1, F.col(c)))
    row = costs.groupBy().agg(
        F.max("do_nothing_cost").alias("a"), at("is_deployed", "total_cost").alias("b"),
        at("is_deployed", "net_benefit").alias("c"), at("is_optimal", "total_cost").alias("d"),
        at("is_optimal", "net_benefit").alias("e"))
    names = {"do_nothing_cost": F.col("a"), "cost_at_deployed_threshold": F.col("b"), "net_benefit_at_deployed": F.col("c"),
             "cost_at_loss_minimising_threshold": F.col("d"), "net_benefit_at_loss_minimising": F.col("e"),
             "cost_of_budget_constraint": F.col("b") - F.col("d")}
    names |= {k: F.lit(prices[k]) for k in ("reimbursement_share", "analyst_review", "false_decline")}
    pairs = F.array(*[F.struct(F.lit(k).alias("metric"), v.cast("double").alias("value")) for k, v in names.items()])
    return row.select(F.explode(pairs).alias("r")).select("r.metric", "r.value")


def baseline_points(long: DataFrame, target_fpr: float) -> DataFrame:
    """One operating point per model of a long (model, score, is_fraud, cents) table.

    The lowest distinct cut whose false-positive rate fits, else the strictest cut there is.
    """
    c = score_curve(long, ["model"])
    tp, fp = F.col("before_pos") + F.col("pos"), F.col("before_neg") + F.col("neg")
    row = F.struct("score", tp.alias("tp"), fp.alias("fp"), (F.col("before_pos_cents") + F.col("pos_cents")).alias("tc"))
    best = c.groupBy("model").agg(
        F.coalesce(F.min(F.when(F.try_divide(fp, F.col("n")) <= target_fpr, row)), F.max(row)).alias("at"),
        F.max("p").alias("p"), F.max("n").alias("n"), F.max("p_cents").alias("p_cents"))
    fpr = F.try_divide("at.fp", "n")
    return best.select(
        "model", F.col("at.score").alias("threshold"), F.try_divide("at.tp", "p").alias("recall"),
        F.try_divide(F.col("at.tp"), F.col("at.tp") + F.col("at.fp")).alias("precision"),
        F.try_divide("at.tc", "p_cents").alias("value_recall"), fpr.alias("realised_fpr"),
        ((fpr >= target_fpr * 0.34) & (fpr <= target_fpr * 1.6)).cast("long").alias("comparable_budget"))


def decile_lift(df: DataFrame, score: str, key: str, bins: int = 10) -> DataFrame:
    """Near-equal chunks by descending score; the first ``rows % bins`` chunks hold one row more.

    Scores that lie within one chunk go there as counts. Only the rows of scores that straddle an edge are put in order, by the
    MD5 of ``key``: at most ``bins - 1`` scores, whose rows are cut by the digest's leading digits, so that no tie is one task.
    """
    fraud = F.col("is_fraud") == 1
    value = F.col(score).cast("double")
    counts = durable(df.groupBy(value.alias("score")).agg(
        F.count(F.lit(1)).alias("k"), F.sum("is_fraud").alias("fraud"), F.sum(F.when(fraud, F.col("cents")).otherwise(0)).alias("cents")))
    size = counts.agg(F.sum("k").alias("_rows"), F.sum("fraud").alias("_fraud"))
    scan = attach_totals(value_scan(counts, [], "score", ["k"], descending=True), size, [])
    step, extra = F.floor(F.col("_rows") / bins), F.col("_rows") % bins
    edge = extra * (step + 1)

    def chunk(at):
        return (F.when(at < edge, F.floor(at / (step + 1))).otherwise(extra + F.floor(F.try_divide(at - edge, step))) + 1).cast("long")

    placed = durable(scan.select("*", chunk(F.col("before_k")).alias("first"), chunk(F.col("before_k") + F.col("k") - 1).alias("last")))
    inside = placed.where("first = last").select(F.col("first").alias("decile"), "k", "fraud", "cents", "_rows", "_fraud")
    torn = placed.where("first < last").select(F.col("score").alias("_s"), "before_k", "_rows", "_fraud")  # one row per edge at most
    rows = df.join(F.broadcast(torn.withColumnRenamed("before_k", "_start")), value == F.col("_s")).select(
        "_s", "_start", "_rows", "_fraud", F.md5(F.col(key).cast("string")).alias("_h"), key, "is_fraud", "cents", F.lit(1).cast("long").alias("k"))
    ranked = ordered_history(rows.withColumn("_l1", F.substring("_h", 1, 4)), ["_s"], ["_l1"], ["_h", key], sums=["k"])
    each = ranked.select(chunk(F.col("_start") + F.col("before_k")).alias("decile"), "k",
                         F.col("is_fraud").alias("fraud"), F.when(fraud, F.col("cents")).otherwise(0).alias("cents"), "_rows", "_fraud")
    total = inside.unionByName(each).groupBy("decile").agg(F.sum("k").alias("rows"), F.sum("fraud").alias("fraud"), F.sum("cents").alias("c"), F.max("_rows").alias("n"), F.max("_fraud").alias("p"))
    rate = F.col("fraud") / F.col("rows")
    return total.select("decile", "rows", "fraud", rate.alias("fraud_rate"), F.try_divide(rate, F.col("p") / F.col("n")).alias("lift"), (F.col("c") / F.lit(100.0)).alias("fraud_value"))


#: Replicas of a resampled metric, most ranges of scores that are summed apart, and cells whose replicas are laid out at once.
REPLICAS, RANGES, CELLS = 1000, 256, 256
#: Cells a distinct score from which its sums of all replicas are kept (a score takes 24 KB at 1,000 replicas).
KEPT_CELLS = 200


#: Cumulative chances of 0, 1, 2 ... rows under Poisson(k), for counts up to ``SMALL``; beyond, a cell's draws come from numpy's generator.
SMALL = 8
_CHANCES = [np.cumsum([math.exp(-k) * k**i / math.factorial(i) for i in range(k + 40)]) for k in range(SMALL + 1)]


def draws(cell: int, k: int, replicas: int, seed: int) -> np.ndarray:
    """Of a cell of ``k`` rows: ``k`` itself, then a Poisson draw around it for every replica, the same wherever it is drawn."""
    return draw_all(np.array([cell], np.int64), np.array([k], np.int64), replicas, seed)[0]


def draw_all(cells: np.ndarray, k: np.ndarray, replicas: int, seed: int) -> np.ndarray:
    """The draws of many cells, a row each. A small count is read off a uniform number hashed from cell and replica, with 16 bits each;
    where those lie on the edge of two counts, 64 more decide."""
    out = np.empty((len(cells), replicas + 1))
    out[:, 0] = k
    for n in np.unique(k):
        at = np.flatnonzero(k == n)
        if n > SMALL:
            for i in at:
                rng = np.random.Generator(np.random.Philox(key=(int(cells[i]) ^ seed * 0x9E3779B97F4A7C15) & (1 << 64) - 1))
                out[i, 1:] = rng.poisson(n, replicas)
            continue
        edges = _CHANCES[n] * 65536.0
        word = _hashed(cells[at], (replicas + 3) // 4, 2 * seed).view(np.uint16)[:, :replicas]
        drawn, undecided = np.zeros(word.shape, np.uint8), np.zeros(word.shape, bool)
        for low, times in zip(*np.unique(np.floor(edges[edges < 65536]).astype(np.uint16), return_counts=True), strict=True):
            drawn += (word > low).view(np.uint8) * np.uint8(times)
            undecided |= word == low
        out[at, 1:] = drawn
        rows, reps = np.nonzero(undecided)
        if len(rows):
            fine = word[rows, reps] + _hashed(cells[at[rows]] + reps, 1, 2 * seed + 1)[:, 0] / float(1 << 64)
            out[at[rows], reps + 1] = np.searchsorted(edges, fine, side="right")
    return out


def _hashed(cells: np.ndarray, wide: int, salt: int) -> np.ndarray:
    """``wide`` hashed 64-bit words a cell."""
    with np.errstate(over="ignore"):
        x = cells.astype(np.int64).view(np.uint64)[:, None] ^ np.uint64(salt * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019 & (1 << 64) - 1)
        x = x * np.uint64(0xD1342543DE82EF95) + np.arange(1, wide + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for shift, odd in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x ^= x >> np.uint64(shift)
            x *= np.uint64(odd)
        x ^= x >> np.uint64(31)
        return x


def _steps(batches: Iterator[pa.RecordBatch], replicas: int, seed: int) -> Iterator[tuple[str, int, np.ndarray, np.ndarray]]:
    """``model, chunk, scores, sums[3, score, replica]`` of frauds, genuine rows and cents of fraud, in falling order of score.

    Scores come whole: one whose cells go on in the next piece is held back until it ends.
    """
    at, scores, sums = None, np.empty(0), np.zeros((3, 0, replicas + 1))
    for batch in batches:
        names, chunks = np.asarray(batch.column("model").to_pylist(), object), np.asarray(batch.column("chunk"))
        scored, k, cell = (np.asarray(batch.column(c)) for c in ("score", "k", "cell"))
        labels, each = np.asarray(batch.column("label"), np.float64), np.asarray(batch.column("each").fill_null(0), np.float64)
        turns = np.append(np.flatnonzero(np.append(True, (names[1:] != names[:-1]) | (chunks[1:] != chunks[:-1]))), batch.num_rows) if batch.num_rows else np.zeros(1, int)
        for start, stop in ((i, min(i + CELLS, e)) for b, e in zip(turns[:-1], turns[1:], strict=True) for i in range(b, e, CELLS)):
            part, key = slice(start, stop), (names[start], int(chunks[start]))
            drawn = draw_all(cell[part], k[part], replicas, seed)
            label, cents, value = labels[part, None], each[part, None], scored[part]
            first = np.flatnonzero(np.append(True, value[1:] != value[:-1]))
            # frauds are few: only their rows are weighed by money
            new = np.zeros((3, len(first), replicas + 1))
            new[1] = np.add.reduceat(drawn, first, axis=0)
            fraud = np.flatnonzero(label[:, 0])
            if len(fraud):
                of, begins = np.unique(np.searchsorted(first, fraud, side="right") - 1, return_index=True)
                new[0][of] = np.add.reduceat(drawn[fraud], begins, axis=0)
                new[2][of] = np.add.reduceat(drawn[fraud] * cents[fraud], begins, axis=0)
                new[1] -= new[0]
            value = value[first]
            if at == key and len(scores) and scores[-1] == value[0]:
                new[:, 0] += sums[:, -1]
                scores, sums = scores[:-1], sums[:, :-1]
            if at is not None and len(scores):
                yield (*at, scores, sums)
            at = key
            if len(value) > 1:
                yield (*key, value[:-1], new[:, :-1])
            scores, sums = value[-1:], new[:, -1:]
    if at is not None and len(scores):
        yield (*at, scores, sums)


def bootstrap(df: DataFrame, scores: Sequence[str], target_fpr: float, replicas: int = REPLICAS, seed: int = 7, money: str = "cents") -> DataFrame:
    """Per replica and score column: ``model, rep, recall, precision, value_recall, average_precision, roc_auc``; replica 0 is what was observed.

    Class-stratified resampling by cells: a cell is one combination of all scores, label and money per row, and its resampled
    count is a Poisson draw around its own count, the same for every score, so that scores are compared on the same resamples.
    The cut is found anew in each replica.

    Cells are sorted by score into ranges, which is the only shuffle: a cell is one row in it, however many replicas there are.
    A first pass sums each range to one vector of all replicas; a second walks each range from the totals above it. A range
    sends a few vectors of ``replicas`` numbers a model, ``RANGES`` of them at most. With ``KEPT_CELLS`` cells a score or more, sums
    are kept by score and the second pass draws nothing. Rows without a score or a label are left out.
    """
    spark = df.sparkSession
    known = df.where(reduce(lambda x, y: x & y, [F.col(c).isNotNull() for c in (*scores, "is_fraud")]))
    cells = known.groupBy(*[F.col(s).cast("double").alias(s) for s in scores], F.col("is_fraud").cast("int").alias("label"), F.col(money).alias("each")).agg(F.count(F.lit(1)).alias("k"))
    models = F.explode(F.array(*[F.struct(F.lit(s).alias("model"), F.col(s).alias("score")) for s in scores]))
    long = cells.withColumn("cell", F.xxhash64(*scores, "label", "each")).select(models.alias("m"), "label", "each", "k", "cell").select("m.*", "label", "each", "k", "cell")
    parts = min(int(spark.conf.get("spark.sql.shuffle.partitions")), RANGES)
    order = [F.asc("model"), F.desc("score")]
    placed = durable(long.repartitionByRange(parts, *order).sortWithinPartitions(*order, "label", "each", "cell").withColumn("chunk", F.spark_partition_id()))

    # Where scores are few for the cells, the sums of each score are kept, and nothing is drawn twice.
    n, steps = placed.agg(F.count("*"), F.count_distinct("model", "score")).first()
    kept = steps * KEPT_CELLS <= n

    def laid(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for model, chunk, value, sums in _steps(batches, replicas, seed):
            yield pa.RecordBatch.from_arrays([pa.array([model] * len(value), pa.string()), pa.array([chunk] * len(value), pa.int32()), pa.array(value, pa.float64()),
                                              pa.array([np.ascontiguousarray(sums[:, i]).tobytes() for i in range(len(value))], pa.binary())], ["model", "chunk", "score", "v"])

    def stepped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, np.ndarray, np.ndarray]]:
        if not kept:
            yield from _steps(batches, replicas, seed)
            return
        for batch in batches:
            for model, chunk, score, v in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                yield model, chunk, np.array([score]), np.frombuffer(v).reshape(3, 1, -1)

    if kept:
        placed = durable(placed.mapInArrow(laid, "model string, chunk int, score double, v binary"))

    def totals_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, int], np.ndarray] = {}
        for model, chunk, _, sums in stepped(batches):
            held[model, chunk] = held.get((model, chunk), 0) + sums.sum(1)
        yield _vectors(held)

    found = {(r["model"], r["chunk"]): np.frombuffer(r["v"]).reshape(3, -1) for r in placed.mapInArrow(totals_of, _VECTORS).collect()}
    whole = {m: sum(v for (name, _), v in found.items() if name == m) for m in {m for m, _ in found}}
    above, so_far = {}, {m: np.zeros_like(v) for m, v in whole.items()}
    for model, chunk in sorted(found):
        above[model, chunk] = so_far[model].copy()
        so_far[model] += found[model, chunk]
    sent = spark.sparkContext.broadcast((above, whole))

    # Terms are rounded to a unit in which all sums are whole numbers below 2^52, so that ranges may be cut and added in any way.
    unit = lambda most: 2.0 ** (np.ceil(np.log2(max(float(most), 1.0))) - 51)
    units = {m: (unit((v[0] * v[1]).max()), unit(v[0].max())) for m, v in whole.items()}

    def walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        above, whole = sent.value
        held: dict[tuple[str, int], np.ndarray] = {}
        now: dict[tuple[str, int], np.ndarray] = {}
        for model, chunk, value, sums in stepped(batches):
            key = (model, chunk)
            if key not in held:
                # area, average precision, and at the cut: score, frauds, genuine rows and cents above it
                held[key], now[key] = np.concatenate([np.zeros((2, replicas + 1)), np.full((1, replicas + 1), -np.inf), np.zeros((3, replicas + 1))]), above[key].copy()
            upto = now[key][:, None] + np.cumsum(sums, axis=1)
            before = upto - sums
            out = held[key]
            step = np.divide(sums[0] * upto[0], upto[0] + upto[1], out=np.zeros_like(sums[0]), where=upto[0] + upto[1] > 0)
            for row, term, part in zip((0, 1), (sums[1] * (before[0] + sums[0] / 2), step), units[model], strict=True):
                out[row] += np.rint(term / part).sum(0) * part
            over = upto[1] > np.floor(target_fpr * whole[model][1])
            first, rep = over.argmax(0), np.arange(replicas + 1)
            new = over.any(0) & np.isinf(out[2])
            out[2][new] = value[first[new]]
            for row, source in ((3, 0), (4, 1), (5, 2)):
                out[row][new] = before[source][first[new], rep[new]]
            now[key] = upto[:, -1].copy()
        yield _vectors(held)

    rows: dict[str, np.ndarray] = {}
    for r in sorted(placed.mapInArrow(walked, _VECTORS).collect(), key=lambda r: (r["model"], r["chunk"])):
        v = np.frombuffer(r["v"]).reshape(6, -1)
        if r["model"] not in rows:
            rows[r["model"]] = v.copy()
        else:
            mine = rows[r["model"]]
            mine[:2] += v[:2]
            new = np.isinf(mine[2]) & ~np.isinf(v[2])
            mine[2:, new] = v[2:, new]
    out = []
    for model, v in sorted(rows.items()):
        p, n, cents = whole[model]
        none = np.isinf(v[2])  # a replica without genuine rows has no cut, and no alert
        tp, fp, tc = np.where(none, 0, v[3]), np.where(none, 0, v[4]), np.where(none, 0, v[5])
        ratio = lambda a, b, other: [float(x / y) if y > 0 else other for x, y in zip(a, b, strict=True)]
        out += zip([model] * (replicas + 1), range(replicas + 1), ratio(tp, p, None), ratio(tp, tp + fp, 0.0), ratio(tc, cents, None), ratio(v[1], p, None),
                   ratio(v[0], p * n, 0.5), strict=True)
    return spark.createDataFrame(out, "model string, rep int, recall double, precision double, value_recall double, average_precision double, roc_auc double")


_VECTORS = "model string, chunk int, v binary"


def _vectors(held: dict[tuple[str, int], np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([m for m, _ in held], pa.string()), pa.array([c for _, c in held], pa.int32()),
                                       pa.array([np.ascontiguousarray(v, np.float64).tobytes() for v in held.values()], pa.binary())], ["model", "chunk", "v"])


METRICS = ["recall", "precision", "value_recall", "average_precision", "roc_auc"]


def _long_metrics(replicas):
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in METRICS]))
    return replicas.select("model", "rep", each.alias("e")).select("model", "rep", "e.metric", "e.value")


def intervals(replicas: DataFrame) -> DataFrame:
    """``model, metric, point, lo95, hi95, resamples``."""
    q = F.percentile(F.when(F.col("rep") > 0, F.col("value")), F.array(F.lit(0.025), F.lit(0.975)))
    return _long_metrics(replicas).groupBy("model", "metric").agg(
        F.max(F.when(F.col("rep") == 0, F.col("value"))).alias("point"), q[0].alias("lo95"), q[1].alias("hi95"), F.count(F.when(F.col("rep") > 0, 1)).alias("resamples"))


def paired_difference(replicas: DataFrame, a: str, b: str) -> DataFrame:
    """``metric, difference, lo95, hi95, p_two_sided`` of b less a on the same resamples; ``difference`` is the observed one."""
    both = _long_metrics(replicas).groupBy("rep", "metric").pivot("model", [a, b]).agg(F.max("value")).select("rep", "metric", (F.col(b) - F.col(a)).alias("d"))
    drawn = F.when(F.col("rep") > 0, F.col("d"))
    q = F.percentile(drawn, F.array(F.lit(0.025), F.lit(0.975)))
    share = F.least(F.avg((drawn <= 0).cast("double")), F.avg((drawn >= 0).cast("double")))
    return both.groupBy("metric").agg(F.max(F.when(F.col("rep") == 0, F.col("d"))).alias("difference"), q[0].alias("lo95"), q[1].alias("hi95"),
                                      F.least(F.lit(1.0), 2 * share).alias("p_two_sided"))


def response_prices(scored: DataFrame, cut: float, cuts: list[float], rule_hit, prices: dict = PRICES) -> DataFrame:
    """What each response would cost: hold, the cheapest other cut, an extra rule, or friction.

    Fixed values: friction stops 28% of the fraud it meets, loses 4% of honest payments, and a rule
    costs 25,000 a round.
    """
    held = cost_curve(collapse(scored), scored.sparkSession.createDataFrame([(float(c),) for c in {*cuts, cut}], "cut double"), cut, prices)
    hold = held.where("is_deployed = 1").select(F.lit("hold").alias("move"), "total_cost")
    shift = held.where("is_optimal = 1").select(F.lit("rethreshold").alias("move"), "total_cost")
    fraud, alert = F.col("is_fraud") == 1, (F.col("score") >= cut) | rule_hit
    money = lambda c: F.sum(F.when(c, F.col("cents")).otherwise(0)) / F.lit(100.0)
    one = lambda c: F.sum(c.cast("long"))
    ruled = scored.agg((money(fraud & ~alert) * prices["reimbursement_share"] + one(alert) * prices["analyst_review"]
                        + one(alert & ~fraud) * prices["false_decline"] + 25_000.0).alias("total_cost")).select(F.lit("add_rule").alias("move"), "total_cost")
    asked, model = rule_hit & (F.col("score") < cut), F.col("score") >= cut
    eased = scored.agg(((money(fraud & ~model) - 0.28 * money(fraud & asked)) * prices["reimbursement_share"] + one(model) * prices["analyst_review"]
                        + (one(model & ~fraud) + 0.04 * one(asked & ~fraud)) * prices["false_decline"] + one(asked) * prices["step_up_friction"])
                       .alias("total_cost")).select(F.lit("add_friction").alias("move"), "total_cost")
    return hold.unionByName(shift).unionByName(ruled).unionByName(eased).orderBy("total_cost", "move")
