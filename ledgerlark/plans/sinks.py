"""Writers as queries: each writes into a fresh folder under the shared path and returns what it reads back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import io
from ..sources.tables import ledger
from ..streaming.stateful import fresh_folder
from .evaluation import CUT
from .registry import query


@query("sink_plane", "SELECT txn_id, cents, rail FROM ledger", ("ledger",))
def sink_plane(spark, sf_dir):
    rows, path = ledger(spark, sf_dir, ["txn_id", "cents", "rail"]), fresh_folder(spark, "plane")
    io.write_plane(rows, path, by="rail")
    return io.read_plane(spark, path, rows.schema, required=True)


@query("sink_features", f"SELECT txn_id, amount, rail FROM ledger WHERE score >= {CUT}", ("ledger",))
def sink_features(spark, sf_dir):
    rows, path = ledger(spark, sf_dir, ["txn_id", "amount", "rail", "score"]), fresh_folder(spark, "features")
    window = rows.where(F.col("score") >= CUT)
    io.write_features(rows.withColumnRenamed("score", "_score"), window, "txn_id", path)
    return spark.read.parquet(path)


@query("sink_result", "SELECT rail, count(*) AS payments, sum(is_fraud)::BIGINT AS fraud FROM ledger GROUP BY rail", ("ledger",))
def sink_result(spark, sf_dir):
    table = ledger(spark, sf_dir, ["rail", "is_fraud"]).groupBy("rail").agg(F.count(F.lit(1)).alias("payments"), F.sum("is_fraud").alias("fraud"))
    path = fresh_folder(spark, "result")
    io.write_result(table, path)
    there, back = io.read_result(spark, path, "csv", table.schema)
    if not there:
        raise FileNotFoundError(path)
    return back


@query("sink_alert_upsert", f"SELECT txn_id, score, rail AS reasons, NULL::VARCHAR AS note, run_id FROM ledger, (VALUES ('r1'), ('r2')) t(run_id) WHERE score >= {CUT}", ("ledger",))
def sink_alert_upsert(spark, sf_dir):
    """One run recorded twice and another once: each run's alerts are there once."""
    alerts = ledger(spark, sf_dir, ["txn_id", "score", "rail"]).where(F.col("score") >= CUT).select("txn_id", "score", F.array("rail").alias("reasons"))
    path = fresh_folder(spark, "alerts")
    for run in ("r1", "r2", "r1"):
        io.record_alerts(alerts, path, run, ["txn_id", "score", "reasons", "note"])
    return spark.read.parquet(path)


@query("sink_json_rows", """SELECT '{"txn_id":"' || txn_id || '","cents":' || cents || ',"share":' || CASE WHEN line = 3 THEN 'null' ELSE '0.5' END || '}' AS json FROM ledger""", ("ledger",))
def sink_json_rows(spark, sf_dir):
    rows = ledger(spark, sf_dir, ["txn_id", "cents", "line"])
    return io.json_rows(rows.select("txn_id", "cents", F.when(F.col("line") == 3, F.lit(float("nan"))).otherwise(0.5).alias("share")))
