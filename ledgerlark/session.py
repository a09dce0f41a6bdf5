"""Session settings and durable lineage cuts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def configure(spark: SparkSession) -> SparkSession:
    """Settings every query relies on: UTC clocks and runtime re-planning."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    return spark


def local_session(cpus: int | str = "*", partitions: int = 8, name: str = "ledgerlark") -> SparkSession:
    """A local session for tests and the bench."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName(name)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; only a session in one process (a local test) may go without and gets its own."""
    context = spark.sparkContext
    found = context._jsc.sc().getCheckpointDir()
    if found.isDefined():
        return found.get()
    named = context.getConf().get("spark.checkpoint.dir")
    if not named and context.master != "local" and not context.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    context.setCheckpointDir(named or tempfile.mkdtemp(prefix="ledgerlark-"))
    return context._jsc.sc().getCheckpointDir().get()


def durable(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """:func:`durable` for a wide table: a checkpoint holds whole rows as they lie in memory, Parquet a fraction of that, and readers take only the columns that they need.

    The shuffles that made the table are let go as soon as it is written; it stays until the folder is cleared.
    """
    spark, folder = df.sparkSession, f"{shared_folder(df.sparkSession)}/wide-{uuid.uuid4().hex}"
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        df.write.parquet(folder)
    finally:
        spark.conf.set(name, before) if before is not None else spark.conf.unset(name)
    return spark.read.schema(df.schema).parquet(folder)


def settled(df: DataFrame) -> DataFrame:
    """:func:`durable` for the state of a loop, so that it starts each round at its true size.

    A checkpoint keeps what its plan was estimated to hold, and a join is estimated at the product of both sides. In a loop the
    digits of that number double with every round, until the driver has neither time nor memory for anything else.
    """
    kept = df.persist()
    kept.count()
    out = durable(kept)
    kept.unpersist()
    return out
