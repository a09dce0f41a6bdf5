"""Causal history of an entity: everything known strictly before a payment.

Order inside an entity is whole seconds, then sequence columns. A trailing window holds earlier
rows with ``ts >= t - W``, self excluded. Sums come from running totals at the row minus running
totals at ``t - W``; distinct counts come from open/close marks of each partner's stay in the
window, so neither needs a sliding frame or a list of the window's rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType, DoubleType, FractionalType, IntegralType, LongType, StructField, StructType

from .ordered import ordered_history

DAY = 86_400
#: What a row of a stretch is: what came before the stretch, a row of the stretch before, a row of its own.
HEAD, EARLIER, OWN = 0, 1, 2
#: Rows worked on together; entities in them are whole.
TOGETHER = 1 << 16
#: Rows of a key up to which its time is one stretch.
WHOLE_KEY = 1 << 16


def entity_history(
    rows: DataFrame,
    key: str | Sequence[str],
    *,
    ts: str = "ts_s",
    seq: Sequence[str] = ("seq",),
    block: Column | None = None,
    sums: Sequence[str] = (),
    windows: Sequence[int] = (),
    distinct: dict[str, Sequence[int]] | None = None,
    last: Sequence[str] = (),
    first_seen: bool = False,
    totals: Sequence[str] | None = None,
    trailing: Sequence[str] | None = None,
) -> DataFrame:
    """Append history columns for ``key``.

    ``n_before`` and ``<s>_before`` over all earlier rows; ``n_<W>`` and ``<s>_<W>`` over the
    trailing ``W`` seconds; ``uniq_<c>_<W>`` for each partner column in ``distinct``;
    ``prev_<c>`` for ``last``; ``first_ts`` (own second included) when asked. ``totals`` names those of
    ``n`` and ``sums`` whose totals over all earlier rows are wanted, ``trailing`` those of ``sums``
    whose windows are; all by default. Rows without a key or a time get NULL.

    Rows shuffle once, on their key. The time of a key of more than ``WHOLE_KEY`` rows is cut into stretches of twice the longest window,
    a week at least: its rows shuffle on (key, stretch), and those near the end of a stretch once more, without their other columns, to
    the next; a stretch then answers all windows of its rows by running totals. What lies further back comes as one
    row per (key, stretch), from totals that one window per key adds up.
    ``block`` cuts the rows of one second further, for clocks so coarse that a second (or a
    date-only midnight) may hold millions of one key's rows; it must not fall as ``seq`` rises,
    e.g. ``shiftright(seq, 16)``.
    """
    keys = [key] if isinstance(key, str) else list(key)
    distinct = {c: list(w) for c, w in (distinct or {}).items()}
    seq, sums, windows, last = list(seq), list(sums), list(windows), list(last)
    totals = ["n", *sums] if totals is None else list(totals)
    trailing = sums if trailing is None else list(trailing)
    made = [f"{c}_before" for c in ["n", *sums] if c in totals]
    for w in windows:
        made += [f"n_{w}", *[f"{s}_{w}" for s in sums if s in trailing]]
    made += [f"uniq_{c}_{w}" for c, spans in distinct.items() for w in spans] + [f"prev_{c}" for c in last] + (["first_ts"] if first_seen else [])
    types = {f.name: f.dataType for f in rows.schema.fields}
    if block is not None or not isinstance(types[ts], IntegralType) or not all(isinstance(types[s], (IntegralType, FractionalType)) and not isinstance(types[s], DecimalType) for s in sums):
        if len(keys) > 1:
            rows, keys = rows.withColumn("_keys", F.when(~F.greatest(*[F.col(k).isNull() for k in keys]), F.struct(*keys))), ["_keys"]
        found = _by_second(rows, keys[0], ts, seq, block, sums, windows, distinct, last, first_seen)
        return found.select(*[c for c in rows.columns if c != "_keys"], *made)
    return _by_stretch(rows, keys, ts, seq, sums, windows, distinct, last, first_seen, totals, trailing, made)


def _by_stretch(rows, keys, ts, seq, sums, windows, distinct, last, first_seen, totals, trailing, made):
    reach = max([0, *windows, *[w for spans in distinct.values() for w in spans]])
    span = max(2 * reach, 7 * DAY)
    into = F.pmod(F.col(ts).cast("long"), F.lit(span).cast("long"))
    start = F.col(ts).cast("long") - into
    known_rows = rows.where(" AND ".join(f"`{c}` IS NOT NULL" for c in [*keys, ts]))
    # few: a key that is cut has more than WHOLE_KEY rows
    large = known_rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > WHOLE_KEY).select(*keys).collect()
    heads = [c for c in ["n", *sums] if c in totals]
    if not large:
        placed = rows.select("*", F.when(F.col(ts).isNotNull(), F.lit(0)).cast("long").alias("_stretch"), F.lit(OWN).alias("_kind"))
    else:
        kept = StructType([StructField(f"_k{i}", rows.schema[k].dataType) for i, k in enumerate(keys)])
        cut_keys = rows.sparkSession.createDataFrame([tuple(r) for r in large], kept).withColumn("_cut", F.lit(True))
        marked = lambda df: df.join(F.broadcast(cut_keys), [F.col(k) == F.col(f"_k{i}") for i, k in enumerate(keys)], "left").drop(*kept.names)
        place = lambda c, kind: F.struct(c.alias("s"), F.lit(kind).alias("kind"))
        spots = F.array(place(start, OWN))
        if reach:
            spots = F.when(into >= span - reach, F.array(place(start, OWN), place(start + span, EARLIER))).otherwise(spots)
        spots = F.when(F.col("_cut"), spots).otherwise(F.array(place(F.when(F.col(ts).isNotNull(), F.lit(0)).cast("long"), OWN)))
        needed = {*keys, ts, *([s for s in sums if s in trailing] if windows else []), *distinct}
        placed = marked(rows).select("*", F.explode(spots).alias("_at")).select(
            *[F.col(c) if c in needed else F.when(F.col("_at.kind") == OWN, F.col(c)).alias(c) for c in rows.columns],
            F.col("_at.s").alias("_stretch"), F.col("_at.kind").alias("_kind"))
    if large and (heads or last or first_seen):
        total = {c: F.count(F.lit(1)) if c == "n" else F.sum(c) for c in heads}
        held = F.max(F.struct(F.col(ts).alias("_ts"), *[F.col(c).alias(f"_q{i}") for i, c in enumerate(seq)], *[F.col(c).alias(f"_v{i}") for i, c in enumerate(last)]))
        each = marked(known_rows).where("_cut").groupBy(*keys, start.alias("_stretch")).agg(
            *[a.alias(f"_t_{c}") for c, a in total.items()], *([held.alias("_held")] if last else []), F.min(ts).alias("_first"))
        order = Window.partitionBy(*keys).orderBy("_stretch")
        prior = order.rowsBetween(Window.unboundedPreceding, -1)
        each = each.select(
            *keys, "_stretch", F.lit(HEAD).alias("_kind"), *[F.sum(f"_t_{c}").over(prior).alias(f"_t_{c}") for c in heads],
            *([F.last("_held").over(prior).alias("_held")] if last else []),
            *([F.min("_first").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("_first")] if first_seen else []))
        placed = placed.unionByName(each, allowMissingColumns=True)
    none = F.greatest(*[F.col(c).isNull() for c in [keys[0], *keys, "_stretch"]])  # rows without an entity go anywhere
    by = [*keys, *(["_stretch"] if large else [])]
    sorted_rows = placed.repartition(*by, F.when(none, F.xxhash64(ts, *seq))).sortWithinPartitions(*keys, "_stretch", "_kind", ts, *seq)

    large = bool(large)
    columns, types = rows.columns, {f.name: f.dataType for f in rows.schema.fields}
    real = {c: types[c].typeName() in ("double", "float") for c in sums}
    kinds = {f"prev_{c}": types[c] for c in last} | {"first_ts": types[ts]}
    kinds |= {f"{c}_{w}": DoubleType() for c in sums if real[c] for w in ["before", *windows]}
    fields = [StructField(n, kinds.get(n, LongType())) for n in made]

    def worked(table: pa.Table, new: np.ndarray) -> pa.Table:
        first = np.flatnonzero(new)
        of = np.cumsum(new) - 1
        kind = np.asarray(table.column("_kind"))
        own = np.flatnonzero(kind == OWN)
        numbers = lambda c, real=False: np.asarray(pc.fill_null(pc.cast(table.column(c), pa.float64() if real else pa.int64()), 0))
        clock = numbers(ts) - numbers("_stretch")
        timed = (kind != HEAD) & np.asarray(pc.and_(pc.is_valid(table.column(ts)), pc.is_valid(table.column("_stretch"))))
        clock = np.where(timed, clock - clock.min(where=timed, initial=np.iinfo(np.int64).max), 0)
        wide = int(clock.max(initial=0)) + 2 * reach + 2
        when = of * wide + clock + reach
        mine, at = of[own], when[own]
        head = first[mine]
        known = pc.is_valid(table.column("_stretch"))
        for k in keys:
            known = pc.and_(known, pc.is_valid(table.column(k)))
        missing = ~np.asarray(known)[own]
        out = {}
        count = np.cumsum(kind != HEAD) - (kind != HEAD)
        since = {w: np.searchsorted(when, at - w) for w in windows}
        for c in ["n", *sums]:
            if c in totals:
                values = (kind == OWN).astype(np.int64) if c == "n" else np.where(kind == OWN, numbers(c, real[c]), 0)
                before = _running(values, first)[own]
                out[f"{c}_before"] = before + numbers(f"_t_{c}", c != "n" and real[c])[head] if large else before
        for w in windows:
            out[f"n_{w}"] = count[own] - count[since[w]]
        if windows:
            for c in trailing:
                run = _running(numbers(c, real[c]), first)
                for w in windows:
                    out[f"{c}_{w}"] = run[own] - run[since[w]]
        for c, spans in distinct.items():
            for w, found in zip(spans, _partners(table.column(c), kind, of, when, first, own, spans, wide), strict=True):
                out[f"uniq_{c}_{w}"] = found
        arrays = {n: pa.array(v, mask=missing) for n, v in out.items()}
        if last:
            has = (own > 0) & (kind[own - 1] == OWN) & (of[own - 1] == mine)
            held = table.column("_held").take(pa.array(head)).combine_chunks() if large else None
            for i, c in enumerate(last):
                before = table.column(c).take(pa.array(own - 1, mask=~has))
                found = pc.if_else(pa.array(has), before, pc.struct_field(held, f"_v{i}")) if large else before
                arrays[f"prev_{c}"] = pc.if_else(pa.array(missing), pa.scalar(None, found.type), found)
        if first_seen:
            here = table.column(ts).take(pa.array(head, mask=missing))
            arrays["first_ts"] = pc.coalesce(table.column("_first").take(pa.array(head)), here) if large else here
        kept = table.select(columns).take(pa.array(own))
        return pa.Table.from_arrays([*kept.columns, *[arrays[n] for n in made]], [*columns, *made])

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, wanted = [], 0, TOGETHER
        for batch in batches:
            if batch.num_rows:
                held, n = [*held, batch], n + batch.num_rows
            if n >= wanted:
                table = pa.Table.from_batches(held).combine_chunks()
                new = _starts(table, [*keys, "_stretch"])
                cut = int(np.flatnonzero(new)[-1])
                if cut:
                    yield from worked(table.slice(0, cut).combine_chunks(), new[:cut]).to_batches(max_chunksize=TOGETHER)
                held, n = table.slice(cut).to_batches(), n - cut
                wanted = max(TOGETHER, 2 * n)
        if n:
            table = pa.Table.from_batches(held).combine_chunks()
            yield from worked(table, _starts(table, [*keys, "_stretch"])).to_batches(max_chunksize=TOGETHER)

    return sorted_rows.mapInArrow(scanned, StructType([*[StructField(f.name, f.dataType) for f in rows.schema.fields], *fields]))


def _starts(table: pa.Table, columns: Sequence[str]) -> np.ndarray:
    """Where another entity begins; rows without one are alone."""
    new = np.zeros(table.num_rows, bool)
    new[:1] = True
    for c in columns:
        v = table.column(c)
        new[1:] |= np.asarray(pc.fill_null(pc.not_equal(v.slice(1), v.slice(0, len(v) - 1)), True))
    return new


def _running(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """What precedes each value inside its group. Floats are added group by group, so that none sees another's rounding or NaN."""
    if values.dtype.kind != "f":
        run = np.cumsum(values) - values
        return run - np.repeat(run[first], np.diff([*first, len(values)]))
    sizes, run = np.diff([*first, len(values)]), np.zeros(len(values))
    short = first[sizes <= 64]
    lengths = sizes[sizes <= 64]
    for step in range(1, int(lengths.max(initial=0))):
        short, lengths = short[lengths > step], lengths[lengths > step]
        run[short + step] = run[short + step - 1] + values[short + step - 1]
    for a, n in zip(first[sizes > 64], sizes[sizes > 64], strict=True):
        run[a + 1:a + n] = np.cumsum(values[a:a + n - 1])
    return run


def _partners(column, kind, of, when, first, own, spans, wide) -> list[np.ndarray]:
    """Distinct partners in each window: stays that opened at an earlier row, less stays that ended before the row's second."""
    code = column.combine_chunks().dictionary_encode() if isinstance(column, pa.ChunkedArray) else column.dictionary_encode()
    code = code.combine_chunks() if isinstance(code, pa.ChunkedArray) else code
    code = np.asarray(pc.fill_null(code.indices, -1)).astype(np.int64)
    at = np.flatnonzero((code >= 0) & (kind != HEAD))
    order = at[np.lexsort((code[at], of[at]))]  # stable: rows of a pair stay in their order
    same = (of[order[1:]] == of[order[:-1]]) & (code[order[1:]] == code[order[:-1]])
    gap = when[order[1:]] - when[order[:-1]]
    found = []
    for w in spans:
        near = same & (gap <= w)
        opens, closes = np.zeros(len(kind), np.int64), np.zeros(len(kind), bool)
        opens[order] = ~np.concatenate([[False], near])[:len(order)]
        closes[order] = ~np.concatenate([near, [False]])[:len(order)]
        opened = np.cumsum(opens) - opens
        ended = when[closes] + w  # those of a later group are larger: a group is wider than its rows and a window
        mine = first[of[own]]
        gone = np.searchsorted(ended, when[own]) - np.searchsorted(ended, of[own] * wide)
        found.append(opened[own] - opened[mine] - gone)
    return found


def _by_second(rows, key, ts, seq, block, sums, windows, distinct, last, first_seen):
    """The same for clocks that need ``block``, or that run in parts of a second.

    Rows are first collapsed to one total per (key, second); everything that reaches across
    seconds works on those totals, cut by day. The rows themselves shuffle once, on (key, second).
    """
    # Measures get names of their own: a sequence column may double as a measure.
    base = rows.select(
        "*", F.lit(1).cast("long").alias("_n"), *[F.col(s).alias(f"_s_{s}") for s in sums],
        *([block.alias("_blk")] if block is not None else []),
    )
    measures = ["_n", *[f"_s_{s}" for s in sums]]
    opens = [f"_open_{c}_{w}" for c, spans in distinct.items() for w in spans]
    closes = [f"_close_{c}_{w}" for c, spans in distinct.items() for w in spans]
    stays = [_stays(base, key, c, ts, seq, spans, block is not None) for c, spans in distinct.items()]

    seconds = _second_totals(base, stays, key, ts, seq, measures, opens, windows, closes, last, first_seen)
    scan = base.withColumn("_kind", F.lit(0))
    for mark, _ in stays:
        scan = scan.unionByName(mark.withColumn("_kind", F.lit(1)), allowMissingColumns=True)
    inside = ordered_history(
        scan, [key, ts], ["_blk"] if block is not None else [], [*seq, "_kind"],
        sums=measures + opens, last=last, last_where=F.col("_kind") == 0,
    ).where("_kind = 0")
    out = inside.join(seconds, [key, ts], "left")

    before = lambda m: F.col(f"before_{m}") + F.col(f"_up_{m}")
    made = [before("_n").alias("n_before")]
    made += [before(f"_s_{s}").alias(f"{s}_before") for s in sums]
    for w in windows:
        made.append((before("_n") - F.col(f"_at__n_{w}")).alias(f"n_{w}"))
        made += [(before(f"_s_{s}") - F.col(f"_at__s_{s}_{w}")).alias(f"{s}_{w}") for s in sums]
    made += [
        (before(f"_open_{c}_{w}") - F.col(f"_at__close_{c}_{w}")).cast("long").alias(f"uniq_{c}_{w}")
        for c, spans in distinct.items() for w in spans
    ]
    made += [
        F.when(F.col("before__n") > 0, F.col(f"prev_{c}")).otherwise(F.col("_prior")[c]).alias(f"prev_{c}") for c in last
    ]
    if first_seen:
        made.append("first_ts")
    return out.select(*[F.col(c) for c in rows.columns], *made)


def _day(ts: Column) -> Column:
    return F.floor(ts / F.lit(DAY)).cast("long")


def _stays(base, key, partner, ts, seq, spans, blocked):
    """Marks where a partner enters and leaves the trailing window of ``key``.

    Rows are first collapsed to one per (key, partner, second). A second opens a stay when the
    pair was not seen in the W seconds before it, and ends one when the pair is not seen in the W
    seconds after it; the partner then drops out once ``ts + W`` has passed.
    """
    first = F.min(F.struct(*seq, *(["_blk"] if blocked else [])))
    ticks = base.groupBy(key, partner, ts).agg(first.alias("_first")).withColumn("_day", _day(F.col(ts)))
    days = ticks.groupBy(key, partner, "_day").agg(F.min(ts).alias("_lo"), F.max(ts).alias("_hi"))
    pair = Window.partitionBy(key, partner).orderBy("_day")
    days = days.select(key, partner, "_day", F.lag("_hi").over(pair).alias("_hi"), F.lead("_lo").over(pair).alias("_lo"))
    inday = Window.partitionBy(key, partner, "_day").orderBy(ts)
    both = ticks.select("*", F.lag(ts).over(inday).alias("_p"), F.lead(ts).over(inday).alias("_q")).join(
        days, [key, partner, "_day"]
    ).select(key, ts, "_first", F.coalesce("_p", "_hi").alias("_prev"), F.coalesce("_q", "_lo").alias("_next"))
    opened = {w: (F.col("_prev").isNull() | (F.col("_prev") < F.col(ts) - w)).cast("long") for w in spans}
    mark = both.select(
        key, ts, *[F.col("_first")[s].alias(s) for s in [*seq, *(["_blk"] if blocked else [])]],
        *[c.alias(f"_open_{partner}_{w}") for w, c in opened.items()],
    ).where(" + ".join(f"_open_{partner}_{w}" for w in spans) + " > 0")
    ended = F.array(*[
        F.when(F.col("_next").isNull() | (F.col("_next") > F.col(ts) + w), F.lit(int(w))) for w in spans
    ])
    end = both.select(key, ts, F.explode(F.array_compact(ended)).alias("_w")).groupBy(
        key, (F.col(ts) + F.col("_w")).alias(ts)
    ).agg(*[F.count(F.when(F.col("_w") == w, 1)).alias(f"_close_{partner}_{w}") for w in spans])
    return mark, end


def _second_totals(base, stays, key, ts, seq, measures, opens, windows, closes, last, first_seen):
    """Per (key, second): totals before it, totals before ``t - W``, and stays ended by it.

    One scan over the key's seconds. A second's own row (kind 1) sees all that precedes it; it also
    asks at ``t - W`` (kind 0, before the rows of that second). Stays count from the second that
    opens them and end after their last second (kind 2).
    """
    held = [F.max(F.struct(*seq, *[c for c in last if c not in seq and c != ts], ts)).alias("_held_row")] if last else []
    seconds = base.groupBy(key, ts).agg(*[F.sum(m).alias(m) for m in measures], *held)
    union = seconds.select("*", F.col(ts).alias("_t"), F.lit(0).alias("_w"), F.lit(1).alias("_kind"))
    if windows:
        asks = F.explode(F.array(*[F.lit(int(w)) for w in windows]))
        asked = seconds.select(key, F.col(ts).alias("_t"), asks.alias("_w")).select(
            key, "_t", "_w", F.lit(0).alias("_kind"), (F.col("_t") - F.col("_w")).alias(ts))
        union = union.unionByName(asked, allowMissingColumns=True)
    for mark, end in stays:
        made = [c for c in mark.columns if c.startswith("_open_")]
        per_second = mark.groupBy(key, ts).agg(*[F.sum(c).alias(c) for c in made])
        union = union.unionByName(per_second.withColumn("_kind", F.lit(2)), allowMissingColumns=True)
        union = union.unionByName(end.withColumn("_kind", F.lit(2)), allowMissingColumns=True)
    union = union.select("*", _day(F.col(ts)).alias("_day"), F.when(F.col("_kind") == 1, F.col(ts)).alias("_seen"))
    seen = ordered_history(
        union, [key], ["_day"], [ts, "_kind"], sums=[*measures, *opens, *closes],
        mins=["_seen"] if first_seen else [], last=["_held_row"] if last else [],
        last_where=F.col("_held_row").isNotNull() if last else None,
    ).where("_t IS NOT NULL")

    def at(w, column, name):
        return F.max(F.when(F.col("_w") == w, F.col(column))).alias(name)

    picks = [at(0, f"before_{m}", f"_up_{m}") for m in [*measures, *opens]]
    picks += [at(w, f"before_{m}", f"_at_{m}_{w}") for w in windows for m in measures]
    picks += [at(0, f"before_{c}", f"_at_{c}") for c in closes]
    if last:
        picks.append(at(0, "prev__held_row", "_prior"))
    if first_seen:
        picks.append(at(0, "low__seen", "_first"))
    out = seen.groupBy(key, F.col("_t").alias(ts)).agg(*picks)
    return out.withColumn("first_ts", F.least("_first", ts)) if first_seen else out


def cross_window_sum(
    sources: DataFrame, source_key: str, queries: DataFrame, query_key: str,
    *, ts: str = "ts_s", value: str, window: int, name: str = "cross_sum",
) -> DataFrame:
    """Per (query key, second): sum of the same account's source values in ``[t - W, t)``."""
    ticks = sources.groupBy(F.col(source_key).alias("_k"), F.col(ts).alias("_s")).agg(F.sum(value).alias("_v"))
    asked = queries.select(F.col(query_key).alias("_k"), F.col(ts).alias("_s")).distinct()
    # a question stands before the rows of its second
    union = asked.withColumn("_row", F.lit(0)).unionByName(ticks.withColumn("_row", F.lit(1)), allowMissingColumns=True)
    seen = entity_history(union, "_k", ts="_s", seq=["_row"], sums=["_v"], windows=[window], totals=[])
    return seen.where("_row = 0").select(F.col("_k").alias(query_key), F.col("_s").alias(ts), F.col(f"_v_{window}").alias(name))


def prior_mean(total: str, count: str) -> Column:
    """Mean of strictly earlier rows, NULL without any."""
    return F.when(F.col(count) > 0, F.col(total) / F.col(count))


def prior_std(total: str, squares: str, count: str) -> Column:
    """Population deviation of strictly earlier rows, NULL below two rows."""
    mean = F.col(total) / F.col(count)
    return F.when(
        F.col(count) > 1, F.sqrt(F.greatest(F.col(squares) / F.col(count) - mean * mean, F.lit(0.0)))
    )
