"""Helpers the operators share: reading tables, byte words, packed hashes and connected components."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import durable
from ..sources.tables import table

#: A word for Spark's and DuckDB's regular expressions: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

__all__ = ["WORD", "as_bytes", "components", "durable", "map_rows", "ngram_hashes", "pieces", "table", "unused", "word_hashes"]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def document_key():
    """The document id as a column that sorts null last and joins."""
    return F.coalesce("doc_id", F.lit((1 << 63) - 1)).cast("long")


def text_hash():
    """Tells rows apart that share an id."""
    return F.xxhash64(F.coalesce("text", F.lit("")))


def unused(df: DataFrame, *names: str) -> list[str]:
    """Each name, with as many underscores behind it as it takes to be no column of ``df``."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def map_rows(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], keep: int) -> DataFrame:
    """``df.mapInArrow(fn)`` for an ``fn`` that gives the first ``keep`` columns back.

    Inside, all columns but ``text`` go by their place, as Spark takes names with a dot apart here.
    """
    placed = df.toDF(*["text" if c == "text" else f"c{i}" for i, c in enumerate(df.columns)])
    return placed.mapInArrow(fn, StructType(placed.schema.fields[:keep])).toDF(*df.columns[:keep])


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null reads as empty. ``bytes.split()`` then cuts at ASCII white space only."""
    return [b or b"" for b in column.cast(pa.large_binary()).to_pylist()]


def pieces(batch: pa.RecordBatch, most_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """A batch in slices of about ``most_bytes`` of text (one row at least), so that memory follows the slice."""
    size = np.concatenate([[0], np.cumsum(np.asarray(pc.binary_length(batch.column("text")).fill_null(0)))])
    start = 0
    while start < batch.num_rows:
        stop = max(start + 1, int(np.searchsorted(size, size[start] + most_bytes, side="right")) - 1)
        yield batch.slice(start, stop - start)
        start = stop


_ODD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values (the finaliser of splitmix64)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(words: list[bytes]) -> np.ndarray:
    """xxHash64 of each word, the same on every machine."""
    import xxhash

    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def ngram_hashes(h: np.ndarray, n: int, lane: int = 0) -> np.ndarray:
    """Rolling polynomial hash of every ``n`` consecutive values, joined from power-of-two lengths; ``lane`` picks one of two multipliers."""
    if len(h) < n:
        return np.empty(0, np.uint64)
    m = int(_ODD[lane])
    with np.errstate(over="ignore"):
        done, out, power, width = 0, None, h, 1
        while True:
            if n & width:
                last = len(h) - done - width + 1
                part = power[done:][:last]
                out = part.copy() if out is None else out[:last] * np.uint64(pow(m, width, 1 << 64)) + part
                done += width
            if width * 2 > n:
                return out[: len(h) - n + 1]
            power = power[:-width] * np.uint64(pow(m, width, 1 << 64)) + power[width:]
            width *= 2


def components(edges: DataFrame, keep: Callable[[DataFrame], DataFrame] = durable) -> DataFrame:
    """``(node, root)`` for every node of the undirected ``edges(a, b)``; root is the smallest node it reaches.

    Large-star and small-star rounds until no edge changes. A centre with many neighbours is reduced by a partial
    minimum before the shuffle, and its edges meet that minimum in a join whose skewed side Spark splits.
    Each round is cut by ``keep``, a reliable checkpoint or a stored table.
    """

    def digest(df: DataFrame) -> tuple:
        row = df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        return tuple(row)

    now = keep(edges.where("a <> b").selectExpr("greatest(a, b) AS a", "least(a, b) AS b").distinct())
    before = digest(now)
    while before[0]:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = keep(large.distinct())
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").selectExpr("CASE WHEN b = m THEN a ELSE b END AS a", "m AS b")
        now = keep(small.where("a <> b").distinct())
        after = digest(now)
        if after == before:
            break
        before = after
    roots = now.select(F.col("b").alias("node")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots.select("node", F.col("node").alias("root")))


def ranked(df: DataFrame, *order) -> DataFrame:
    """``df`` with ``rank`` from 0 in the given order, without one global window: sorted ranges, and one count per range."""
    from pyspark.sql import Window as W

    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = durable(df.repartitionByRange(parts, *order).withColumn("_range", F.spark_partition_id()))
    sizes = {r["_range"]: r["count"] for r in placed.groupBy("_range").count().collect()}  # one row per partition
    before, start = [], 0
    for i in range(max(sizes, default=-1) + 1):
        before.append(start)
        start += sizes.get(i, 0)
    starts = F.array(*map(F.lit, before or [0]))
    inside = F.row_number().over(W.partitionBy("_range").orderBy(*order)) - 1
    return placed.withColumn("rank", (inside + starts[F.col("_range")]).cast("long")).drop("_range")


def running_before(df: DataFrame, group: str, chunk: str, order: list[str], value: str, out: str) -> DataFrame:
    """``df`` with ``out``: the sum of ``value`` over the rows of the same ``group`` that come before, by chunk and then by order.

    A group of any size is summed chunk by chunk; only one total per chunk is ordered within the group.
    """
    from pyspark.sql import Window as W

    past = (W.unboundedPreceding, -1)
    totals = df.groupBy(group, chunk).agg(F.sum(value).alias("_t"))
    starts = totals.select(group, chunk, F.coalesce(F.sum("_t").over(W.partitionBy(group).orderBy(chunk).rowsBetween(*past)), F.lit(0)).alias("_b"))
    inside = F.coalesce(F.sum(value).over(W.partitionBy(group, chunk).orderBy(*order).rowsBetween(*past)), F.lit(0))
    return df.withColumn("_i", inside).join(starts, [group, chunk]).withColumn(out, F.col("_i") + F.col("_b")).drop("_i", "_b")


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_let_go(spark: SparkSession) -> Iterator[None]:
    """Within, the shuffles of a query are deleted as soon as it has ended, instead of when the driver's garbage is collected."""
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def stored(df: DataFrame) -> DataFrame:
    """Cut lineage with a Parquet table in the shared folder; the shuffles that made it are let go as soon as it is written."""
    import uuid

    from ..session import shared_folder

    spark, folder = df.sparkSession, f"{shared_folder(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    with shuffles_let_go(spark):
        df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)
