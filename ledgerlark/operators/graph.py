"""Account graphs: one trailing snapshot per day, all days in one job.

A snapshot of day ``d`` holds the edges of ``[d - 7, d)``. Every table is keyed by (day, node), so
adding days adds rows, not jobs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import durable, settled
from .boost import runs
from .ordered import attach_totals, value_scan

WINDOW_DAYS, MIN_HISTORY = 7, 10
#: Most edges of a snapshot that one task works out whole; larger days go by joins.
DAY_EDGES = 1 << 22
PAYEE_METRICS = ["in_degree", "out_degree", "unique_in", "unique_out", "passthrough_ratio", "pagerank", "component_size", "neighbour_mean_in_degree"]
PAYER_METRICS = ["out_degree", "unique_out", "passthrough_ratio"]


def _merged(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that is never broadcast. Adaptive execution goes by compressed bytes, and labels and days compress so well
    that a table of a few MB there is more than a driver holds."""
    return df.hint("merge")


def snapshot_edges(payments: DataFrame, window_days: int = WINDOW_DAYS) -> DataFrame:
    """``day, src, dst, cents, cnt`` over the trailing days, for days that have payments of their own."""
    daily = payments.groupBy("day", "payer", "payee").agg(F.sum("cents").alias("cents"), F.count(F.lit(1)).alias("cnt"))
    days = payments.select("day").distinct()
    ahead = F.explode(F.sequence(F.col("day") + 1, F.col("day") + window_days))
    future = daily.select(ahead.alias("day"), F.col("payer").alias("src"), F.col("payee").alias("dst"), "cents", "cnt")
    edges = future.join(F.broadcast(days), "day").groupBy("day", "src", "dst").agg(F.sum("cents").alias("cents"), F.sum("cnt").alias("cnt"))
    full = edges.groupBy("day").agg(F.sum("cnt").alias("_h")).where(F.col("_h") >= MIN_HISTORY).select("day")
    return edges.join(F.broadcast(full), "day")


def degrees(edges: DataFrame) -> DataFrame:
    """Payments and neighbours in and out, and money out over money in, per (day, node)."""
    ends = F.explode(F.array(
        F.struct(F.col("src").alias("node"), F.col("cnt").alias("o"), F.lit(1).alias("uo"), F.col("cents").alias("ao"),
                 F.lit(0).cast("long").alias("i"), F.lit(0).alias("ui"), F.lit(0).cast("long").alias("ai")),
        F.struct(F.col("dst").alias("node"), F.lit(0).cast("long").alias("o"), F.lit(0).alias("uo"), F.lit(0).cast("long").alias("ao"),
                 F.col("cnt").alias("i"), F.lit(1).alias("ui"), F.col("cents").alias("ai"))))
    sums = edges.select("day", ends.alias("e")).groupBy("day", F.col("e.node").alias("node")).agg(
        *[F.sum(f"e.{c}").alias(c) for c in ("i", "o", "ui", "uo", "ai", "ao")])
    ratio = (F.col("ao") / F.lit(100.0)) / F.greatest(F.col("ai") / F.lit(100.0), F.lit(1.0))
    return sums.select("day", "node", F.col("i").cast("double").alias("in_degree"), F.col("o").cast("double").alias("out_degree"),
                       F.col("ui").cast("double").alias("unique_in"), F.col("uo").cast("double").alias("unique_out"), ratio.alias("passthrough_ratio"))


def neighbour_in_degree(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Mean in-degree of a node's payers, 0 without any."""
    seen = edges.join(_merged(nodes.select("day", F.col("node").alias("src"), "in_degree")), ["day", "src"])
    means = seen.groupBy("day", F.col("dst").alias("node")).agg(F.avg("in_degree").alias("m"))
    return nodes.select("day", "node").join(_merged(means), ["day", "node"], "left").select("day", "node", F.coalesce("m", F.lit(0.0)).alias("neighbour_mean_in_degree"))


def pagerank(edges: DataFrame, alpha: float = 0.85, rounds: int = 60, tol: float = 1e-5) -> DataFrame:
    """Weighted PageRank per day; a day that settles keeps its ranks, one that never does reads 0."""
    out = edges.groupBy("day", "src").agg(F.sum("cents").alias("_o")).where("_o > 0")
    shares = durable(edges.join(_merged(out), ["day", "src"]).select("day", "src", "dst", (F.col("cents") / F.col("_o")).alias("w")))
    nodes = edges.select("day", F.explode(F.array("src", "dst")).alias("node")).distinct()
    size = nodes.groupBy("day").agg(F.count(F.lit(1)).alias("n"))
    dangling = nodes.join(_merged(out.select("day", F.col("src").alias("node"), F.lit(0).alias("_d"))), ["day", "node"], "left")
    state = durable(dangling.join(F.broadcast(size), "day").select(
        "day", "node", "n", F.coalesce("_d", F.lit(1)).alias("dang"), (1.0 / F.col("n")).alias("r"), F.lit(0).alias("done")))
    for _ in range(rounds):
        # A round reads the ranks four times, so each one is cut before the next.
        sent = shares.join(_merged(state.where("done = 0").select("day", F.col("node").alias("src"), "r")), ["day", "src"]).groupBy(
            "day", F.col("dst").alias("node")).agg(F.sum(F.col("w") * F.col("r")).alias("_in"))
        lost = state.where("done = 0").groupBy("day").agg(F.sum(F.col("r") * F.col("dang")).alias("_lost"))
        moved = state.join(_merged(sent), ["day", "node"], "left").join(F.broadcast(lost), "day", "left")
        new = alpha * (F.coalesce("_in", F.lit(0.0)) + F.coalesce("_lost", F.lit(0.0)) / F.col("n")) + (1 - alpha) / F.col("n")
        moved = durable(moved.select("day", "node", "n", "dang", "done", F.when(F.col("done") == 1, F.col("r")).otherwise(new).alias("r"), F.col("r").alias("_old")))
        gap = moved.groupBy("day").agg((F.sum(F.abs(F.col("r") - F.col("_old"))) < F.max("n") * tol).alias("_ok"))
        state = settled(moved.join(F.broadcast(gap), "day").select(
            "day", "node", "n", "dang", "r", F.when(F.col("_ok"), 1).otherwise(F.col("done")).alias("done")))
        if not state.where("done = 0").head(1):
            break
    return state.select("day", "node", F.when(F.col("done") == 1, F.col("r")).otherwise(0.0).alias("pagerank"))


def components(edges: DataFrame) -> DataFrame:
    """Size of each node's weakly connected component, by smallest label with pointer jumping, until no label changes."""
    both = durable(edges.select("day", F.explode(F.array(
        F.struct(F.col("src").alias("a"), F.col("dst").alias("b")), F.struct(F.col("dst").alias("a"), F.col("src").alias("b")))).alias("e"))
        .select("day", "e.a", "e.b").distinct())
    state = both.groupBy("day", F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label"))
    state = durable(state)
    while True:
        near = both.join(_merged(state.select("day", F.col("node").alias("b"), "label")), ["day", "b"]).groupBy(
            "day", F.col("a").alias("node")).agg(F.min("label").alias("_l"))
        step = state.join(_merged(near), ["day", "node"]).select("day", "node", F.col("label").alias("_old"), F.least("label", "_l").alias("_m"))
        jump = step.join(_merged(state.select("day", F.col("node").alias("_m"), F.col("label").alias("_j"))), ["day", "_m"])
        new = settled(durable(jump.select("day", "node", "_old", F.least("_m", "_j").alias("label"))))
        state = new.select("day", "node", "label")
        if not new.where("_old <> label").head(1):
            break
    size = state.groupBy("day", "label").agg(F.count(F.lit(1)).cast("double").alias("component_size"))
    return state.join(_merged(size), ["day", "label"]).select("day", "node", "component_size")


def node_metrics(edges: DataFrame) -> DataFrame:
    """All metrics per (day, node). A day of at most ``DAY_EDGES`` edges is worked out by one task; larger days go by joins, all of them together."""
    large = [r["day"] for r in edges.groupBy("day").count().where(F.col("count") > DAY_EDGES).collect()]  # of one row per day
    if not large:
        return _metrics_by_day(edges)
    big = F.col("day").isin(large)
    return _metrics_by_day(edges.where(~big)).unionByName(_metrics_by_joins(edges.where(big)))


def _metrics_by_joins(edges: DataFrame) -> DataFrame:
    edges = durable(edges)
    nodes = durable(degrees(edges))
    parts = (neighbour_in_degree(edges, nodes), pagerank(edges), components(edges))
    return reduce(lambda a, b: a.join(_merged(b), ["day", "node"]), parts, nodes)


def _metrics_by_day(edges: DataFrame) -> DataFrame:
    names = ["in_degree", "out_degree", "unique_in", "unique_out", "passthrough_ratio", "neighbour_mean_in_degree", "pagerank", "component_size"]

    def worked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for day, t in runs(batches, "day"):
            ends = pa.concat_arrays([t.column(c).combine_chunks() for c in ("src", "dst")]).dictionary_encode(null_encoding="encode")
            code, n = np.asarray(ends.indices).astype(np.int64), len(ends.dictionary)
            cents, cnt = (np.asarray(t.column(c).combine_chunks()).astype(np.float64) for c in ("cents", "cnt"))
            told = _snapshot_metrics(code[:t.num_rows], code[t.num_rows:], cents, cnt, np.asarray(ends.dictionary.is_valid()))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, day, np.int64)), ends.dictionary, *[pa.array(told[c]) for c in names]], ["day", "node", *names])

    days = edges.select(F.col("day").cast("long").alias("day"), "src", "dst", "cents", "cnt").repartition("day").sortWithinPartitions("day")
    return days.mapInArrow(worked, f"day long, node {edges.schema['src'].dataType.simpleString()}, " + ", ".join(f"{c} double" for c in names))


def _snapshot_metrics(src: np.ndarray, dst: np.ndarray, cents: np.ndarray, cnt: np.ndarray, named: np.ndarray) -> dict[str, np.ndarray]:
    """What :func:`degrees`, :func:`neighbour_in_degree`, :func:`pagerank` and :func:`components` say of one snapshot whose nodes are numbered.

    ``named`` is false for the account without a name, which joins nobody.
    """
    n = len(named)
    into, out_of = np.bincount(dst, cents, n), np.bincount(src, cents, n)
    indeg = np.bincount(dst, cnt, n)
    told = {"in_degree": indeg, "out_degree": np.bincount(src, cnt, n), "unique_in": np.bincount(dst, minlength=n).astype(np.float64),
            "unique_out": np.bincount(src, minlength=n).astype(np.float64), "passthrough_ratio": (out_of / 100.0) / np.maximum(into / 100.0, 1.0)}
    both = named[src] & named[dst]
    src, dst, cents = src[both], dst[both], cents[both]
    told["neighbour_mean_in_degree"] = np.bincount(dst, indeg[src], n) / np.maximum(np.bincount(dst, minlength=n), 1)
    return told | {"pagerank": _ranks(src, dst, cents, np.where(named, out_of, 0.0), n), "component_size": _component_sizes(src, dst, n)}


def _ranks(src, dst, cents, out_of, n, alpha: float = 0.85, rounds: int = 60, tol: float = 1e-5) -> np.ndarray:
    """As :func:`pagerank`; zeros if the ranks do not settle."""
    paying = out_of[src] > 0
    src, dst = src[paying], dst[paying]
    share, dangling, rank = cents[paying] / out_of[src], out_of <= 0, np.full(n, 1.0 / n)
    for _ in range(rounds):
        old = rank
        rank = alpha * (np.bincount(dst, share * old[src], n) + old[dangling].sum() / n) + (1 - alpha) / n
        if np.abs(rank - old).sum() < n * tol:
            return rank
    return np.zeros(n)


def _component_sizes(src, dst, n) -> np.ndarray:
    """Smallest labels by hooks and pointer jumps."""
    label = np.arange(n)
    while True:
        a, b = label[src], label[dst]
        low, new = np.minimum(a, b), label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        while not np.array_equal(jumped := new[new], new):
            new = jumped
        if np.array_equal(new, label):
            return np.bincount(label, minlength=n)[label].astype(np.float64)
        label = new


def attach(payments: DataFrame, nodes: DataFrame) -> DataFrame:
    """``g_`` columns for both parties: 0 for an account outside the snapshot, NULL without a snapshot."""
    days = nodes.select("day", F.lit(1).alias("_snap")).distinct()
    out = payments.join(F.broadcast(days), "day", "left")
    for side, metrics in (("payee", PAYEE_METRICS), ("payer", PAYER_METRICS)):
        wanted = [m for m in metrics if m in nodes.columns]
        out = out.join(_merged(nodes.select("day", F.col("node").alias(side), *[F.col(m).alias(f"_{side}_{m}") for m in wanted])), ["day", side], "left")
        out = out.select("*", *[F.when(F.col("_snap") == 1, F.coalesce(F.round(f"_{side}_{m}", 5), F.lit(0.0))).alias(f"g_{side}_{m}") for m in wanted])
    return out.drop(*[c for c in out.columns if c.startswith("_")])


def average_rank(df: DataFrame, value: str, name: str) -> DataFrame:
    """Rank share with ties averaged: ``(rows below + (peers + 1) / 2) / rows``."""
    counts = durable(df.groupBy(value).agg(F.count(F.lit(1)).alias("_k")))  # the scan reads it many times, so ranks of ranks would multiply
    t = attach_totals(value_scan(counts, [], value, ["_k"]), counts.agg(F.sum("_k").alias("_n")), [])
    return df.join(_merged(t.select(value, ((F.col("before__k") + (F.col("_k") + 1) / 2) / F.col("_n")).alias(name))), value)


def communities(payments: DataFrame, rounds: int = 200) -> DataFrame:
    """Community per account by weighted label spreading, until no account would change; an error after ``rounds``.

    An account wants the label with the most weight among its neighbours, of equal ones the smallest, and keeps its own
    unless the other weighs more. Payment graphs are near bipartite: if all moved at once, labels would swap sides for ever, so a
    seeded half of those that want to move does, another half each round.
    """
    pairs = payments.where("payer <> payee").groupBy("payer", "payee").agg(F.sum("cents").alias("w"))
    both = durable(pairs.select(F.explode(F.array(
        F.struct(F.col("payer").alias("a"), F.col("payee").alias("b")), F.struct(F.col("payee").alias("a"), F.col("payer").alias("b")))).alias("e"), "w")
        .groupBy("e.a", "e.b").agg(F.sum("w").alias("w")))
    state = durable(both.select(F.col("a").alias("node"), F.col("a").alias("label")).distinct())
    for step in range(rounds):
        votes = both.join(_merged(state.select(F.col("node").alias("b"), "label")), "b").groupBy(F.col("a").alias("node"), "label").agg(F.sum("w").alias("w"))
        own = votes.join(_merged(state.select("node", F.col("label").alias("now"))), "node")
        best = own.groupBy("node", "now").agg(
            F.min(F.struct((-F.col("w")).alias("w"), "label")).alias("b"), F.coalesce(F.sum(F.when(F.col("label") == F.col("now"), F.col("w"))), F.lit(0)).alias("kept"))
        better = (-F.col("b.w") > F.col("kept")) | ((-F.col("b.w") == F.col("kept")) & (F.col("b.label") < F.col("now")))
        moves = F.pmod(F.xxhash64("node", F.lit(step)), F.lit(2)) == 0
        asked = settled(durable(best.select("node", better.alias("wants"), F.when(better & moves, F.col("b.label")).otherwise(F.col("now")).alias("label"))))
        state = asked.select("node", "label")
        if not asked.where("wants").head(1):
            return state
    raise RuntimeError(f"labels still change after {rounds} rounds")


def rings(payments: DataFrame, member: DataFrame, min_size: int = 4, sample: int = 8) -> DataFrame:
    """Candidate rings ranked by density, pass-through and internal value."""
    from pyspark.sql import Window
    size = member.groupBy("label").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") >= min_size)
    pairs = payments.groupBy("payer", "payee").agg(F.sum("cents").alias("cents"))
    inside = pairs.join(_merged(member.select(F.col("node").alias("payer"), "label")), "payer").join(
        _merged(member.select(F.col("node").alias("payee"), F.col("label").alias("_l"))), "payee").where("label = _l")
    flows = inside.groupBy("label").agg(F.count(F.lit(1)).alias("internal_edges"), F.sum("cents").alias("c"))
    first = member.withColumn("_r", F.row_number().over(Window.partitionBy("label").orderBy("node"))).where(F.col("_r") <= sample)
    names = first.groupBy("label").agg(F.array_sort(F.collect_list("node")).alias("members_sample"))
    t = size.join(_merged(flows), "label", "left").join(_merged(names), "label").select(
        F.col("label").alias("community_id"), "size", F.coalesce("internal_edges", F.lit(0)).alias("internal_edges"),
        (F.coalesce("c", F.lit(0)) / F.lit(100.0)).alias("internal_value"), "members_sample")
    # Inside one community money out equals money in, so pass-through is 1 wherever value moved.
    t = t.select("*", F.round(F.col("internal_edges") / (F.col("size") * (F.col("size") - 1)), 4).alias("density"),
                 F.round(F.col("internal_value") / F.greatest(F.col("internal_value"), F.lit(1.0)), 4).alias("passthrough_ratio"))
    t = durable(t)
    for c in ("density", "passthrough_ratio", "internal_value"):
        t = average_rank(t, c, f"_rank_{c}")
    score = 0.35 * F.col("_rank_density") + 0.35 * F.col("_rank_passthrough_ratio") + 0.30 * F.col("_rank_internal_value")
    return t.select("community_id", "size", "internal_edges", "density", "internal_value", "passthrough_ratio",
                    F.array_join("members_sample", ",").alias("members_sample"), F.round(score, 4).alias("ring_score")).orderBy(F.desc("ring_score"), "community_id")
