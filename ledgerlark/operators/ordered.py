"""Ordered scans that stay distributed when one key holds most of the rows.

A plain ``Window.partitionBy(key)`` puts a whole key into one task, and a sliding range frame
re-adds its rows for every output row. Here a key's order is cut into nested levels (day, second,
block of sequence numbers; or radix levels of a number). Totals are pre-aggregated per level, the
running totals of each level are small windows, and a row's history is the sum of what precedes it
at every level. No task ever holds more than one finest-level group.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import durable

UP = Window.unboundedPreceding
#: Group columns whose values are column or model names that the code lists itself.
NAMED_GROUPS = {"column", "model"}
#: Rows whose values a task counts together.
COUNTED_ROWS = 1 << 16
#: Slices of a group's order in which the ranks of quantiles are looked up.
SLICES = 1024


def ordered_history(
    df: DataFrame,
    part: Sequence[str],
    levels: Sequence[str],
    order: Sequence[str],
    sums: Sequence[str] = (),
    mins: Sequence[str] = (),
    last: Sequence[str] = (),
    last_where: Column | None = None,
    attach: dict[int, DataFrame] | None = None,
) -> DataFrame:
    """Append what precedes each row inside ``part``, in ``levels`` then ``order`` order.

    ``before_<c>`` is the sum of ``c`` over earlier rows (0 if none), ``low_<c>`` the minimum
    (NULL if none) and ``prev_<c>`` the value on the row just before, looking only at rows that meet
    ``last_where`` if given. ``attach[d]`` is a table
    keyed by ``part + levels[:d]`` whose other columns ride along to the rows, so that a lookup
    per coarse group does not shuffle the rows again.
    """
    part, levels, order = list(part), list(levels), list(order)
    attach = attach or {}
    carried, final = None, df.columns
    if last:
        held = F.struct(*order, *[c for c in last if c not in order])
        df = df.withColumn("_held", held if last_where is None else F.when(last_where, held))
    for depth, totals in _level_totals(df, part, levels, sums, mins, last):
        carried = _level_offsets(totals, carried, part, levels, depth, sums, mins, last)
        if depth in attach:
            carried = carried.join(attach[depth], part + levels[:depth], "left")

    keys = part + levels
    prior = Window.partitionBy(*keys).orderBy(*order).rowsBetween(UP, -1)
    rows = df.select(
        "*",
        *[F.sum(c).over(prior).alias(f"_r_{c}") for c in sums],
        *[F.min(c).over(prior).alias(f"_m_{c}") for c in mins],
        *([F.last("_held", ignorenulls=True).over(prior).alias("_rl")] if last else []),
    )
    own = [F.col(c) for c in final]
    if carried is None:
        return rows.select(
            *own,
            *[F.coalesce(f"_r_{c}", F.lit(0)).alias(f"before_{c}") for c in sums],
            *[F.col(f"_m_{c}").alias(f"low_{c}") for c in mins],
            *[F.col("_rl")[c].alias(f"prev_{c}") for c in last],
        )
    riders = [c for c in carried.columns if c not in keys and not c.startswith("_o_")]
    return rows.join(carried, keys, "left").select(
        *own,
        *[(F.coalesce(f"_r_{c}", F.lit(0)) + F.col(f"_o_{c}")).alias(f"before_{c}") for c in sums],
        *[F.least(f"_m_{c}", f"_o_low_{c}").alias(f"low_{c}") for c in mins],
        *[F.coalesce("_rl", "_o_last")[c].alias(f"prev_{c}") for c in last],
        *riders,
    )


def _level_totals(df, part, levels, sums, mins, last):
    """Totals per group, coarse to fine; each finer table feeds the coarser one."""
    found, table = [], None
    for depth in range(len(levels), 0, -1):
        keys = part + levels[:depth]
        source = df if table is None else table
        aggs = [F.sum(c).alias(c) for c in sums]
        aggs += [F.min(c if table is None else f"low_{c}").alias(f"low_{c}") for c in mins]
        if last:
            aggs.append(
                F.max("_held").alias("_last") if table is None
                else F.max_by("_last", F.when(F.col("_last").isNotNull(), F.col(levels[depth]))).alias("_last")
            )
        # A scan that only needs the order still needs one aggregate per group.
        table = source.groupBy(*keys).agg(*(aggs or [F.count(F.lit(1)).alias("_n")]))
        found.append((depth, table))
    return list(reversed(found))


def _level_offsets(totals, carried, part, levels, depth, sums, mins, last):
    outer, mine = part + levels[: depth - 1], levels[depth - 1]
    prior = Window.partitionBy(*outer).orderBy(mine).rowsBetween(UP, -1)
    own = totals.select(
        *outer, mine,
        *[F.coalesce(F.sum(c).over(prior), F.lit(0)).alias(f"_h_{c}") for c in sums],
        *[F.min(f"low_{c}").over(prior).alias(f"_h_low_{c}") for c in mins],
        *([F.last("_last", ignorenulls=True).over(prior).alias("_h_last")] if last else []),
    )
    if carried is None:
        return own.select(
            *outer, mine,
            *[F.col(f"_h_{c}").alias(f"_o_{c}") for c in sums],
            *[F.col(f"_h_low_{c}").alias(f"_o_low_{c}") for c in mins],
            *([F.col("_h_last").alias("_o_last")] if last else []),
        )
    riders = [c for c in carried.columns if c not in outer and not c.startswith("_o_")]
    joined = own.join(carried, outer, "left")
    return joined.select(
        *outer, mine,
        *[(F.col(f"_h_{c}") + F.coalesce(f"_o_{c}", F.lit(0))).alias(f"_o_{c}") for c in sums],
        *[F.least(f"_h_low_{c}", f"_o_low_{c}").alias(f"_o_low_{c}") for c in mins],
        *([F.coalesce("_h_last", "_o_last").alias("_o_last")] if last else []),
        *riders,
    )


def value_levels(value: Column) -> tuple[Column, Column]:
    """Two radix levels of a double that rise with the value.

    The first is the power of two and ten leading bits, the second 21 more bits, so a level never
    has more than about two million distinct members below one parent, whatever the data.
    """
    size = F.abs(value.cast("double"))
    sign = F.signum(value.cast("double")).cast("long")
    power = F.floor(F.log2(size))
    top = (power + 1100) * 1024 + F.floor((size / F.pow(F.lit(2.0), power) - 1) * 1024)
    base = F.floor(top / F.lit(1024)) - 1100
    rest = F.floor(size / F.pow(F.lit(2.0), base) * F.lit(float(1 << 31)))
    return (
        F.coalesce(sign * (top + 1), F.lit(0)).cast("long"),
        F.coalesce(sign * rest, F.lit(0)).cast("long"),
    )


def value_scan(
    collapsed: DataFrame, part: Sequence[str], value: str, sums: Sequence[str],
    descending: bool = False, tie: Sequence[str] = (),
) -> DataFrame:
    """Totals over smaller (or larger) values, for a table with one row per distinct value."""
    rank = -F.col(value).cast("double") if descending else F.col(value).cast("double")
    high, low = value_levels(F.col("_x"))
    keyed = collapsed.withColumn("_x", rank).select("*", high.alias("_l1"), low.alias("_l2"), *group_key(part))
    return ordered_history(keyed, ["_g"] if part else [], ["_l1", "_l2"], ["_x", *tie], sums=sums).drop("_x", "_l1", "_l2", "_g")


def group_key(part: Sequence[str]) -> list[Column]:
    """The group as one struct column ``_g``: structs with null fields are equal, so a NULL group joins like any other."""
    return [F.struct(*part).alias("_g")] if part else []


def exact_quantiles(df: DataFrame, part: Sequence[str], value: str, probs: Sequence[float]) -> DataFrame:
    """Linear-interpolation quantiles of ``value`` per group: ``part..., p, q, n``.

    Built from counts per distinct value, so no task holds a group's values; only the two values
    around each requested rank leave the scan.
    """
    part = list(part)
    counts = (
        df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
        .groupBy(*part, F.col(value).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    )
    return _quantiles(counts, part, probs)


def column_quantiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """:func:`exact_quantiles` of each of ``columns``: ``column, p, q, n``. Tasks count the values of their rows column by column, before anything is a row a value."""
    columns = list(columns)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            held.append(np.asarray(batch.column(0).flatten().to_numpy(zero_copy_only=False), np.float64).reshape(batch.num_rows, len(columns)))
            rows += batch.num_rows
            if rows >= COUNTED_ROWS:
                yield from told(held)
                held, rows = [], 0
        if rows:
            yield from told(held)

    def told(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        values = np.concatenate(held)
        for i in range(len(columns)):
            v = values[:, i]
            v, n = np.unique(v[~np.isnan(v)] + 0.0, return_counts=True)  # -0.0 is 0.0
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), i, np.int32)), pa.array(v), pa.array(n.astype(np.int64))], ["i", "_v", "_n"])

    found = df.select(F.array(*[F.col(c).cast("double") for c in columns]).alias("v")).mapInArrow(counted, "i int, _v double, _n long")
    counts = found.groupBy("i", "_v").agg(F.sum("_n").alias("_n"))
    return _quantiles(counts.select(F.array(*[F.lit(c) for c in columns])[F.col("i")].alias("column"), "_v", "_n"), ["column"], probs)


def _quantiles(counts: DataFrame, part: list[str], probs: Sequence[float]) -> DataFrame:
    on = ["_g"] if part else []
    counts = durable(counts)
    scan = value_scan(counts, part, "_v", ["_n"])
    total = counts.groupBy(*part).agg(F.sum("_n").alias("n"))
    asked = F.array(*[F.lit(float(p)) for p in probs])
    wanted = total.select(*part, "n", F.posexplode(asked).alias("_i", "p")).select(
        *part, "n", "_i", "p",
        F.floor(F.col("p") * (F.col("n") - 1)).alias("lo"),
        (F.col("p") * (F.col("n") - 1) - F.floor(F.col("p") * (F.col("n") - 1))).alias("frac"),
    )
    # ranks meet values in slices of a group's order, so that a value is compared with the few ranks of its slice and not with all
    wide = (F.floor(F.col("n") / SLICES) + 1).alias("_wide")
    ranks = wanted.select(*group_key(part), wide, F.explode(F.array("lo", F.col("lo") + 1)).alias("_rank"))
    spots = ranks.groupBy(*on, F.floor(F.col("_rank") / F.col("_wide")).alias("_slice")).agg(F.collect_set("_rank").alias("_spots"))
    sized = _attach_small(scan, total.select(*part, wide), part)
    covered = F.sequence(F.floor(F.col("before__n") / F.col("_wide")), F.floor((F.col("before__n") + F.col("_n") - 1) / F.col("_wide")))
    pieces = sized.select(*part, *group_key(part), "_v", "_n", "before__n", F.explode(covered).alias("_slice"))
    met = pieces.join(F.broadcast(spots) if set(part) <= NAMED_GROUPS else spots, [*on, "_slice"])
    hits = met.select(
        *part, "_v",
        F.explode(F.filter("_spots", lambda r: (r >= F.col("before__n")) & (r < F.col("before__n") + F.col("_n"))))
        .alias("_rank"),
    )
    # both values of a quantile come with one join, for the scan behind ``hits`` is the whole work
    ends = wanted.select("*", *group_key(part), F.explode(F.array("lo", F.col("lo") + 1)).alias("_rank"))
    both = ends.join(hits.select(*group_key(part), "_rank", "_v"), [*on, "_rank"], "left").groupBy(*part, "_i", "p").agg(
        F.max("n").alias("n"), F.max("frac").alias("frac"), F.max(F.when(F.col("_rank") == F.col("lo"), F.col("_v"))).alias("_a"),
        F.max(F.when(F.col("_rank") > F.col("lo"), F.col("_v"))).alias("_b"))
    step = F.coalesce("_b", "_a") - F.col("_a")
    return both.select(*part, "p", (F.col("_a") + step * F.col("frac")).alias("q"), "n")


def _attach_small(df: DataFrame, small: DataFrame, part: Sequence[str]) -> DataFrame:
    """Attach a table with one row per group; without groups it is a single row. Groups named in code are few and broadcast."""
    if part:
        keyed = small.select(*group_key(part), *[c for c in small.columns if c not in part])
        few = F.broadcast(keyed) if set(part) <= NAMED_GROUPS else keyed
        return df.select("*", *group_key(part)).join(few, "_g").drop("_g")
    return df.withColumn("_one", F.lit(1)).join(
        F.broadcast(small.withColumn("_one", F.lit(1))), "_one"
    ).drop("_one")


attach_totals = _attach_small


def wide_quantiles(quantiles: DataFrame, part: Sequence[str], names: dict[float, str]) -> DataFrame:
    """One column per probability."""
    picks = [
        F.max(F.when(F.abs(F.col("p") - p) < 1e-12, F.col("q"))).alias(name) for p, name in names.items()
    ]
    grouped = quantiles.groupBy(*part) if part else quantiles.groupBy()
    return grouped.agg(F.max("n").alias("n"), *picks)
