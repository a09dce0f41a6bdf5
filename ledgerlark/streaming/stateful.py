"""Stateful checks on Structured Streaming. Late rows are answered from the state as it stands."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import causal
from ..operators.relate import latest
from ..session import durable, shared_folder

WEEK = 604_800
#: Seconds that state is kept beyond its own end, for rows that come late.
LATE_S = 3_600


def fresh_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


_IDLE = "spark.sql.streaming.noDataMicroBatches.enabled"


def drain(stream: DataFrame, folder: str, batch=None, mode: str = "append") -> None:
    """Run a stream over what is available now, into ``folder/out`` or a batch function.

    State that ends by the clock would ask for batches without data for ever; here it ends with the next batch that has some.
    """
    conf = stream.sparkSession.conf
    before = conf.get(_IDLE, "true")
    conf.set(_IDLE, "false")
    try:
        w = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True)
        w = w.foreachBatch(batch) if batch else w.format("parquet").option("path", f"{folder}/out")
        w.start().awaitTermination()
    finally:
        conf.set(_IDLE, before)


class Held:
    """State of a stream as a table of changes by batch, folded into a new base every ``every`` batches.

    A batch reads what earlier ones have left and writes a folder of its own, so a batch that is run again overwrites what it
    wrote. Bases are written whole before anything older goes, and the base that the last batch read stays for its retry.
    """

    def __init__(self, spark: SparkSession, folder: str, ddl: str, every: int = 10) -> None:
        self.spark, self.folder, self.ddl, self.every = spark, folder, ddl, every

    def _there(self, name: str, mark: str = "_SUCCESS") -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}/{mark}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def _gone(self, name: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def _base(self, batch: int) -> int:
        """The newest base before ``batch``; a base of ``k`` holds all batches below ``k``."""
        k = batch - batch % self.every
        while k > 0 and not self._there(f"base={k}"):
            k -= self.every
        return max(k, 0)

    def before(self, batch: int) -> DataFrame:
        """All changes that batches below ``batch`` have left, with the ``batch`` of each."""
        base = self._base(batch)
        names = ([f"base={base}"] if base else []) + [f"batch={i}" for i in range(base, batch) if self._there(f"batch={i}")]
        schema = f"{self.ddl}, batch int"
        if not names:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.folder}/{n}" for n in names])

    def write(self, batch: int, rows: DataFrame, fold=None) -> None:
        """Keep what ``batch`` changes; at the end of a base's span, ``fold`` what there is into the next base."""
        rows.withColumn("batch", F.lit(batch)).write.mode("overwrite").parquet(f"{self.folder}/batch={batch}")
        if fold is not None and (batch + 1) % self.every == 0:
            fold(self.before(batch + 1)).write.mode("overwrite").parquet(f"{self.folder}/base={batch + 1}")
            last = batch + 1 - self.every
            for i in range(max(last - self.every, 0), last):
                self._gone(f"batch={i}")
            self._gone(f"base={last - self.every}")


def spent_guard(stream: DataFrame, folder: str, keys: list[str], order: list[str], until: str, answer, late_s: int = 30 * 86_400,
                side_s: int | None = None, spends: Column | None = None) -> None:
    """Answer rows by whether an earlier accepted row has spent their key; ``folder/out`` gets the batches' rows.

    ``answer(spent)`` gives the reason of a row, NULL or empty if it is accepted. Of accepted rows those of ``spends``, all by
    default, spend their key, and those must not be accepted where it is spent. A key's first row that would be accepted unspent, by ``order`` (clock first), spends it; it comes from a partial minimum, so a
    key may hold any share of a batch. Spent keys are kept until ``until`` is ``late_s`` behind the newest clock; no row is dropped.

    With ``side_s``, a row that many seconds behind the newest clock of earlier batches is late: it is answered, spends nothing,
    and ``folder/late`` counts such rows by batch.
    """
    held = Held(stream.sparkSession, f"{folder}/spent", "_key string, until long, clock long")
    ts = order[0]

    def step(batch: DataFrame, i: int) -> None:
        old = durable(held.before(i))
        seen = old.agg(F.max("clock")).first()[0]
        name = F.to_json(F.struct(*keys), {"ignoreNullFields": "false"})
        late = F.lit(False) if side_s is None or seen is None else F.coalesce(F.col(ts) < seen - side_s, F.lit(False))
        rows = durable(batch.withColumns({"_key": name, "_place": F.struct(*order), "_late": late}))
        known = old.where("_key IS NOT NULL").select("_key", F.lit(True).alias("_old")).distinct()
        rows = rows.join(known, "_key", "left").withColumn("_old", F.coalesce("_old", F.lit(False)))
        clean = (F.coalesce(answer(F.lit(False)), F.lit("")) == "") & ~F.col("_old") & ~F.col("_late") & (F.lit(True) if spends is None else spends)
        first = durable(rows.where(clean).groupBy("_key").agg(F.min("_place").alias("_first"), F.max(until).alias("until")))
        told = rows.join(first.select("_key", "_first"), "_key", "left")
        spent = F.col("_old") | F.coalesce(F.col("_place") > F.col("_first"), F.lit(False))
        out = told.withColumn("_spent", spent).withColumn("reason", F.coalesce(answer(F.col("_spent")), F.lit("")))
        out.select(*batch.columns, "reason", F.col("_late").cast("int").alias("late")).write.mode("overwrite").parquet(f"{folder}/out/batch={i}")
        rows.agg(F.count_if("_late").alias("late"), F.count("*").alias("rows")).write.mode("overwrite").parquet(f"{folder}/late/batch={i}")
        now = rows.agg(F.max(ts).alias("clock"))
        change = first.select("_key", "until", F.lit(None).cast("long").alias("clock")).union(now.select(F.lit(None).cast("string"), F.lit(None).cast("long"), "clock"))

        def fold(all_rows: DataFrame) -> DataFrame:
            newest = all_rows.agg(F.max("clock").alias("_c"))
            keys_ = all_rows.where("_key IS NOT NULL").groupBy("_key").agg(F.max("until").alias("until"), F.lit(None).cast("long").alias("clock"), F.max("batch").alias("batch"))
            kept = keys_.crossJoin(F.broadcast(newest)).where(F.col("_c").isNull() | (F.col("until") >= F.col("_c") - late_s)).drop("_c")  # one row
            return kept.unionByName(all_rows.agg(F.max("clock").alias("clock"), F.max("batch").alias("batch")), allowMissingColumns=True)

        held.write(i, change, fold)

    drain(stream, folder, step)


def replay_guard(stream: DataFrame, folder: str, nonce: list[str], order: list[str], valid: str, expires: str, **late) -> None:
    """Only an accepted instruction spends its nonce; later ones of that nonce are replays."""
    def answer(spent):
        return F.when(~F.col(valid), "INTENT_SIGNATURE_INVALID").when(F.col(order[0]) > F.col(expires), "INTENT_EXPIRED").when(spent, "INTENT_REPLAYED")

    spent_guard(stream, folder, nonce, order, expires, answer, **late)


def _units(rows: DataFrame, key: str, ts: str, window: int) -> DataFrame:
    """``rows`` with ``_unit``: runs of a key between which the clock stands still for more than ``window``, found on a table of time slots.

    Two rows with an empty slot of ``window`` seconds between theirs are further apart than that, so no window reaches from one
    unit into another.
    """
    slot = F.floor(F.col(ts) / window)
    slots = rows.groupBy(key, slot.alias("_slot")).agg(F.count("*").alias("_n"))
    inside = Window.partitionBy(key).orderBy("_slot")
    apart = F.coalesce((F.col("_slot") - F.lag("_slot").over(inside) > 1).cast("int"), F.lit(0))
    named = slots.withColumn("_apart", apart).withColumn("_unit", F.sum("_apart").over(inside)).select(F.col(key).alias("_k"), "_slot", "_unit")
    placed = rows.withColumn("_slot", slot)
    return placed.join(named, placed[key].eqNullSafe(named["_k"]) & (placed["_slot"] == named["_slot"])).select(*rows.columns, "_unit")


def rate_limit(stream: DataFrame, folder: str, client: str, ts: str, key: str, limit: int = 120, window_s: int = 60, late_s: int = LATE_S) -> None:
    """Admit at most ``limit`` requests per trailing window; rejected requests do not count. ``folder/out`` gets the verdicts.

    A client's rows are cut where the clock stands still for longer than the window, Spark sorts each part, and a part is folded
    row by row with at most ``limit`` seconds carried, over any number of rows. Between batches a client's admitted seconds still
    in reach are kept, until it has been silent for the window and ``late_s`` on top.
    """
    held = Held(stream.sparkSession, f"{folder}/held", f"{client} {dict(stream.dtypes)[client]}, seconds array<long>")
    names = (client, ts, key)

    def fold_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, at = [], None

        def closed():
            return (at[0], at[1], None, None, now[-limit:]) if at is not None else None

        def arrow(rows):
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
            types = (kind, pa.int64(), key_kind, pa.int64(), pa.list_(pa.int64()))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["client", "unit", "key", "admitted", "seconds"])

        kind = key_kind = pa.int64()
        for batch in batches:
            kind, key_kind, out = batch.column("client").type, batch.column("key").type, []
            for c, unit, t, k, carried in zip(*(batch.column(n).to_pylist() for n in ("client", "unit", "t", "key", "carried")), strict=True):
                if at != (c, unit):
                    if (last := closed()) is not None:
                        out.append(last)
                    at, now = (c, unit), []
                if carried is not None:
                    now = list(carried)
                    continue
                now = [s for s in now if s > t - window_s]
                ok = len(now) < limit
                if ok:
                    now.append(t)
                out.append((c, unit, k, int(ok), None))
            yield arrow(out)
        if (last := closed()) is not None:
            yield arrow([last])

    def step(batch: DataFrame, i: int) -> None:
        rows = _units(batch.select(*names), client, ts, window_s)
        old = latest(held.before(i), [client], F.col("batch")).select(client, "seconds")
        touched = old.join(rows.select(client).distinct(), client, "left_semi")
        empty = rows.select(F.col(client).alias("client"), F.col("_unit").cast("long").alias("unit"), F.lit(1).alias("kind"), F.col(ts).cast("long").alias("t"), F.col(key).alias("key"),
                            F.lit(None).cast("array<long>").alias("carried"))
        carry = touched.select(F.col(client).alias("client"), F.lit(0).cast("long").alias("unit"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("t"),
                               F.lit(None).cast(dict(batch.dtypes)[key]).alias("key"), F.col("seconds").alias("carried"))
        sorted_rows = empty.union(carry).repartition("client", "unit").sortWithinPartitions("client", "unit", "kind", "t", "key")
        shape = f"client {dict(batch.dtypes)[client]}, unit long, key {dict(batch.dtypes)[key]}, admitted long, seconds array<long>"
        done = durable(sorted_rows.mapInArrow(fold_rows, shape))
        verdicts = done.where("admitted IS NOT NULL").select(F.col("key").alias(key), F.col("client").alias(client), "admitted")
        verdicts.write.mode("overwrite").parquet(f"{folder}/out/batch={i}")
        ends = done.where("admitted IS NULL")
        last = ends.groupBy("client").agg(F.max_by("seconds", "unit").alias("seconds")).select(F.col("client").alias(client), "seconds")

        def fold(all_rows: DataFrame) -> DataFrame:
            now = latest(all_rows, [client], F.col("batch"))
            newest = now.agg(F.max(F.array_max("seconds")).alias("_c"))
            silent = F.coalesce(F.array_max("seconds"), F.lit(0)) < F.col("_c") - window_s - late_s
            return now.crossJoin(F.broadcast(newest)).where(~F.coalesce(silent, F.lit(False))).drop("_c")  # one row

        held.write(i, last, fold)

    drain(stream, folder, step)


#: Legitimate rows below which a realised false-positive rate says nothing (fixed value).
FPR_FLOOR = 200


def counters(stream: DataFrame, cut: float, blocked: str | None = None) -> DataFrame:
    """Running console counters; the realised false-positive rate is NULL below ``FPR_FLOOR`` legitimate rows."""
    alert, fraud = F.col("score") >= cut, F.col("is_fraud") == 1
    one = lambda c: F.sum(c.cast("long"))
    blocks = F.coalesce(one(F.col(blocked)), F.lit(0)) if blocked else F.lit(0).cast("long")
    return stream.groupBy().agg(
        F.count(F.lit(1)).alias("scored"), one(alert).alias("alerts"), F.sum(F.when(alert & fraud, F.col("cents")).otherwise(0)).alias("cents_stopped"),
        one(fraud).alias("fraud_seen"), one(alert & fraud).alias("fraud_stopped"), one(~fraud).alias("legit"), one(alert & ~fraud).alias("false_positives"), blocks.alias("blocks"),
        F.when(one(~fraud) >= FPR_FLOOR, F.avg(F.when(~fraud, alert.cast("double")))).alias("realised_fpr"))


def online_velocity(stream: DataFrame, key: str, folder: str, windows=(3_600, 86_400), horizon: int = WEEK, partner: str | None = None, every: int = 10) -> None:
    """Answer each micro-batch from the rows already seen, then add it to them: counts, cents and, with ``partner``, distinct partners.

    State is one total per key, partner and second of the last ``horizon``: older ones go when a base is written, so it stops
    growing. Batch and state meet in the batch operator, whose handling of hot keys serves the stream unchanged. Rows of a key
    and second that came in earlier batches count as earlier. ``n_before`` counts rows within the horizon.
    """
    types = dict(stream.dtypes)
    extra = [partner] if partner else []
    ddl = ", ".join(f"{c} {types[c]}" for c in [key, *extra]) + ", ts_s long, _rows long, cents long"
    held = Held(stream.sparkSession, f"{folder}/ticks", ddl, every)

    def collapsed(rows: DataFrame) -> DataFrame:
        return rows.groupBy(key, *extra, "ts_s").agg(F.sum("_rows").alias("_rows"), F.sum("cents").cast("long").alias("cents"))

    def step(batch: DataFrame, i: int) -> None:
        span = batch.agg(F.min("ts_s"), F.max("ts_s")).first()
        now = batch.select("*", F.lit(1).cast("long").alias("_rows"), F.lit(1).alias("_new"))
        if span[0] is not None:
            old = collapsed(held.before(i).where((F.col("ts_s") >= span[0] - horizon) & (F.col("ts_s") <= span[1])))
            first = F.lit(-(1 << 62)).cast("long").alias("seq")
            rows = durable(now.unionByName(old.select(key, *extra, "ts_s", "_rows", "cents", first, F.lit(0).alias("_new")), allowMissingColumns=True))
            found = causal.entity_history(rows, key, sums=["cents", "_rows"], windows=list(windows), distinct={partner: list(windows)} if partner else None)
            counts = {"n_before": F.col("_rows_before"), **{f"n_{w}": F.col(f"_rows_{w}") for w in windows}}
            gone = ["_rows", "_new", "_rows_before", *[f"_rows_{w}" for w in windows]]
            found.where("_new = 1").withColumns(counts).drop(*gone).write.mode("overwrite").parquet(f"{folder}/out/batch={i}")

        def fold(all_rows: DataFrame) -> DataFrame:
            newest = all_rows.agg(F.max("ts_s").alias("_c"))
            reach = all_rows.crossJoin(F.broadcast(newest)).where(F.col("ts_s") >= F.col("_c") - horizon).drop("_c")  # one row
            return collapsed(reach).withColumn("batch", F.lit(i))

        held.write(i, collapsed(now), fold)

    drain(stream, folder, step)


def score_batches(stream: DataFrame, folder: str, score) -> None:
    """Score micro-batches and upsert them: a batch owns its partition, so a retry rewrites it, and readers take a key's newest row."""
    drain(stream, folder, lambda batch, i: score(batch).write.mode("overwrite").parquet(f"{folder}/out/batch={i}"))


def upserted(spark: SparkSession, folder: str, key: list[str], order: str) -> DataFrame:
    """What :func:`score_batches` holds: per key the row of the newest batch, and in a batch the one of the greatest ``order``."""
    rows = spark.read.parquet(f"{folder}/out")
    return latest(rows, key, F.struct("batch", order)).drop("batch")
