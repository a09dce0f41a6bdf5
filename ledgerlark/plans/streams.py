"""Streaming queries: each drains the given tables as a stream and returns what it wrote."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph
from ..session import durable
from ..sources.tables import EVENT_COLUMNS, SPARK_WORDS, _select, configure, payments, table
from ..streaming import stateful
from .graphs import ATTACHED, COLS
from .registry import query
from .windows import PEER, _velocity_sql


#: Micro-batches that a stream query runs in; the events are dealt to them by the clock.
PARTS = 4


def event_stream(spark, sf_dir, columns, delayed: str = "false"):
    """The events as a stream of ``PARTS`` micro-batches, oldest first. Rows of ``delayed`` come one batch after their own.

    The table is one file, so it is first written as parts in a folder of the run; each part has the same number of files.
    """
    configure(spark)
    folder, events = stateful.fresh_folder(spark, "events"), table(spark, sf_dir, "events")
    clock = F.expr(SPARK_WORDS["events"]["epoch"])
    lo, hi, n = events.agg(F.min(clock), F.max(clock), F.count("*")).first()
    own = F.least(F.lit(PARTS - 1), F.floor((clock - (lo or 0)) * PARTS / ((hi or 0) - (lo or 0) + 1)))
    part = F.least(F.lit(PARTS - 1), own + F.expr(delayed).cast("int"))
    files = 1 + n // (PARTS * 250_000)
    for k in range(PARTS):
        events.where(part == k).repartition(files).write.parquet(f"{folder}/p{k}")
    source = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", files).parquet(f"{folder}/p*")
    return source.selectExpr("ts AS _ntz", *_select({c: EVENT_COLUMNS[c] for c in columns}, SPARK_WORDS["events"])).drop("_ntz")


@query("stream_online_velocity", f"""
SELECT txn_id, {_velocity_sql("payer", {"1h": 3600, "24h": 86400})} FROM payments {PEER.format(key="payer", seq="seq")}
""", ("payments",))
def stream_online_velocity(spark, sf_dir):
    folder = stateful.fresh_folder(spark, "velocity")
    stateful.online_velocity(event_stream(spark, sf_dir, ["txn_id", "seq", "ts_s", "day", "payer", "cents"]), "payer", folder, every=2)
    out = spark.read.parquet(f"{folder}/out")
    return out.select("txn_id", F.col("n_3600").alias("n_1h"), F.col("cents_3600").alias("cents_1h"), F.col("n_86400").alias("n_24h"), F.col("cents_86400").alias("cents_24h"))


@query("stream_online_partners", """
SELECT a.txn_id, count(b.txn_id) AS n_24h, count(DISTINCT b.payer) AS payers_24h, count(DISTINCT CASE WHEN b.ts_s >= a.ts_s - 3600 THEN b.payer END) AS payers_1h
FROM payments a LEFT JOIN payments b ON b.payee = a.payee AND b.ts_s >= a.ts_s - 86400 AND (b.ts_s < a.ts_s OR (b.ts_s = a.ts_s AND b.seq < a.seq)) GROUP BY a.txn_id
""", ("payments",))
def stream_online_partners(spark, sf_dir):
    """Distinct payers of a payee in the hour and the day before, as the stream sees them."""
    folder = stateful.fresh_folder(spark, "partners")
    stateful.online_velocity(event_stream(spark, sf_dir, ["txn_id", "seq", "ts_s", "payee", "payer", "cents"]), "payee", folder, partner="payer", every=2)
    return spark.read.parquet(f"{folder}/out").select("txn_id", F.col("n_86400").alias("n_24h"), F.col("uniq_payer_86400").alias("payers_24h"), F.col("uniq_payer_3600").alias("payers_1h"))


@query("stream_rate_limit", """
WITH RECURSIVE r AS (SELECT event_id AS seq, user_id AS client, CAST(floor(epoch(ts)) AS BIGINT) AS ts_s, row_number() OVER (PARTITION BY user_id ORDER BY floor(epoch(ts)), event_id) AS k FROM events),
f AS (SELECT seq, client, k, [ts_s] AS held, 1 AS admitted FROM r WHERE k = 1
 UNION ALL SELECT seq, client, k, CASE WHEN len(h) < 3 THEN list_append(h, ts_s) ELSE h END, CASE WHEN len(h) < 3 THEN 1 ELSE 0 END
 FROM (SELECT r.*, list_filter(f.held, lambda t: t > r.ts_s - 43200) AS h FROM f JOIN r ON r.client = f.client AND r.k = f.k + 1))
SELECT seq, client, admitted FROM f""")
def stream_rate_limit(spark, sf_dir):
    folder = stateful.fresh_folder(spark, "rate")
    rows = event_stream(spark, sf_dir, ["seq", "ts_s", "payer"]).selectExpr("seq", "ts_s", "CAST(substring(payer, 2) AS BIGINT) AS client")
    stateful.rate_limit(rows, folder, "client", "ts_s", "seq", limit=3, window_s=43_200)
    return spark.read.parquet(f"{folder}/out").select("seq", "client", "admitted")


@query("stream_replay_guard", """
WITH r AS (SELECT seq, rail <> 'error' AS ok, row_number() OVER (PARTITION BY payer, payee, rail <> 'error' ORDER BY ts_s, seq) AS k FROM payments)
SELECT seq, CASE WHEN NOT ok THEN 'INTENT_SIGNATURE_INVALID' WHEN k > 1 THEN 'INTENT_REPLAYED' ELSE '' END AS reason FROM r
""", ("payments",))
def stream_replay_guard(spark, sf_dir):
    folder = stateful.fresh_folder(spark, "replay")
    rows = event_stream(spark, sf_dir, ["seq", "ts_s", "payer", "payee", "rail"]).selectExpr(
        "seq", "ts_s", "concat(payer, '/', payee) AS nonce", "rail <> 'error' AS valid", "ts_s + 86400 AS expires_at")
    stateful.replay_guard(rows, folder, ["nonce"], ["ts_s", "seq"], "valid", "expires_at")
    return spark.read.parquet(f"{folder}/out").select("seq", "reason")


_SIGNED = "SELECT seq, ts_s, payer AS agent, payee AS signature, cents % 120 AS age, rail <> 'error' AS valid FROM payments"


@query("stream_agent_replay", f"""
WITH r AS (SELECT *, CASE WHEN age > 60 THEN 'AGENT_SIGNATURE_STALE' WHEN NOT valid THEN 'AGENT_SIGNATURE_INVALID' ELSE '' END AS code FROM ({_SIGNED}))
SELECT seq, CASE WHEN code = '' AND row_number() OVER (PARTITION BY agent, signature, code ORDER BY ts_s, seq) > 1 THEN 'AGENT_REQUEST_REPLAYED' ELSE code END AS reason FROM r
""", ("payments",))
def stream_agent_replay(spark, sf_dir):
    """An accepted request spends its pair of agent and signature."""
    folder = stateful.fresh_folder(spark, "agents")
    rows = event_stream(spark, sf_dir, ["seq", "ts_s", "payer", "payee", "rail", "cents"]).selectExpr(
        "seq", "ts_s", "payer AS agent", "payee AS signature", "cents % 120 AS age", "rail <> 'error' AS valid", "ts_s + 60 AS until")

    def answer(spent):
        return F.when(F.col("age") > 60, "AGENT_SIGNATURE_STALE").when(~F.col("valid"), "AGENT_SIGNATURE_INVALID").when(spent, "AGENT_REQUEST_REPLAYED")

    stateful.spent_guard(rows, folder, ["agent", "signature"], ["ts_s", "seq"], "until", answer)
    return spark.read.parquet(f"{folder}/out").select("seq", "reason")


@query("stream_token_spend", """
WITH r AS (SELECT seq, ts_s, payer AS token, cents > 40000 AS over, rail = 'click' AS single FROM payments)
SELECT seq, CASE WHEN over THEN 'TOKEN_CEILING_EXCEEDED' WHEN single AND coalesce(sum((NOT over AND single)::INT) OVER (PARTITION BY token ORDER BY ts_s, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) > 0
 THEN 'TOKEN_ALREADY_SPENT' ELSE '' END AS reason FROM r
""", ("payments",))
def stream_token_spend(spark, sf_dir):
    """Single-use tokens are spent by the first redemption that is authorised; others are never spent."""
    folder = stateful.fresh_folder(spark, "tokens")
    rows = event_stream(spark, sf_dir, ["seq", "ts_s", "payer", "rail", "cents"]).selectExpr(
        "seq", "ts_s", "payer AS token", "cents > 40000 AS over", "rail = 'click' AS single", "ts_s + 86400 AS until")

    def answer(spent):
        return F.when(F.col("over"), "TOKEN_CEILING_EXCEEDED").when(spent & F.col("single"), "TOKEN_ALREADY_SPENT")

    stateful.spent_guard(rows, folder, ["token"], ["ts_s", "seq"], "until", answer, spends=F.col("single"))
    return spark.read.parquet(f"{folder}/out").select("seq", "reason")


_DELAYED = """WITH e AS (SELECT *, min(ts_s) OVER () AS lo, max(ts_s) OVER () AS hi FROM payments),
p AS (SELECT *, least(3, floor((ts_s - lo) * 4 / (hi - lo + 1)))::INT AS own FROM e),
b AS (SELECT *, least(3, own + CASE WHEN seq % 10 = 0 THEN 1 ELSE 0 END) AS part FROM p),
c AS (SELECT part, max(ts_s) AS newest FROM b GROUP BY part),
r AS (SELECT b.*, coalesce(ts_s < (SELECT max(newest) FROM c WHERE c.part < b.part) - 3600, false) AS late, rail <> 'error' AS ok FROM b)"""


@query("stream_late_answers", _DELAYED + """,
k AS (SELECT *, min(CASE WHEN ok AND NOT late THEN part END) OVER (PARTITION BY payer, payee) AS fp FROM r),
f AS (SELECT *, min(CASE WHEN ok AND NOT late AND part = fp THEN struct_pack(t := ts_s, s := seq) END) OVER (PARTITION BY payer, payee) AS first FROM k)
SELECT seq, CASE WHEN NOT ok THEN 'INTENT_SIGNATURE_INVALID' WHEN fp < part OR (fp = part AND struct_pack(t := ts_s, s := seq) > first) THEN 'INTENT_REPLAYED' ELSE '' END AS reason, late::INT AS late FROM f
""", ("payments",))
def stream_late_answers(spark, sf_dir):
    """A tenth of the rows comes one batch late: such a row is answered from the state as it stands and spends nothing."""
    return spark.read.parquet(f"{_late_run(spark, sf_dir)}/out").select("seq", "reason", "late")


@query("stream_late_counts", _DELAYED + " SELECT part::INT AS batch, sum(late::INT)::BIGINT AS late, count(*) AS rows FROM r GROUP BY part", ("payments",))
def stream_late_counts(spark, sf_dir):
    """The table beside the answers: late rows by batch."""
    return spark.read.parquet(f"{_late_run(spark, sf_dir)}/late").select("batch", "late", "rows")


def _late_run(spark, sf_dir):
    folder = stateful.fresh_folder(spark, "late")
    rows = event_stream(spark, sf_dir, ["seq", "ts_s", "payer", "payee", "rail"], "event_id % 10 = 0").selectExpr(
        "seq", "ts_s", "payer", "payee", "rail <> 'error' AS valid", "ts_s + 86400 AS expires_at")
    stateful.replay_guard(rows, folder, ["payer", "payee"], ["ts_s", "seq"], "valid", "expires_at", side_s=3600)
    return folder


@query("stream_counters", """
SELECT count(*) AS scored, sum(a) AS alerts, sum(a * is_fraud * cents)::BIGINT AS cents_stopped, sum(is_fraud) AS fraud_seen, sum(a * is_fraud) AS fraud_stopped,
 sum(1 - is_fraud) AS legit, sum(a * (1 - is_fraud)) AS false_positives, sum(blocked)::BIGINT AS blocks,
 CASE WHEN sum(1 - is_fraud) >= 200 THEN avg(CASE WHEN is_fraud = 0 THEN a END) END AS realised_fpr FROM (SELECT *, CASE WHEN rail = 'error' THEN 1 ELSE 0 END AS blocked, CASE WHEN amount / 500 >= 0.5 THEN 1 ELSE 0 END AS a FROM payments)
""", ("payments",))
def stream_counters(spark, sf_dir):
    folder = stateful.fresh_folder(spark, "counters")
    rows = event_stream(spark, sf_dir, ["amount", "cents", "is_fraud", "rail"]).withColumns({"score": F.col("amount") / 500, "blocked": F.col("rail") == "error"})
    stateful.drain(stateful.counters(rows, 0.5, "blocked"), folder, lambda b, i: b.write.mode("overwrite").parquet(f"{folder}/out"), "complete")
    return spark.read.parquet(f"{folder}/out")


@query("stream_scored_queue", "SELECT txn_id, amount / 500 AS score FROM payments", ("payments",))
def stream_scored_queue(spark, sf_dir):
    folder = stateful.fresh_folder(spark, "queue")
    stateful.score_batches(event_stream(spark, sf_dir, ["txn_id", "amount"]), folder, lambda b: b.select("txn_id", (F.col("amount") / 500).alias("score")))
    return stateful.upserted(spark, folder, ["txn_id"], "score").select("txn_id", "score")


@query("stream_nightly_snapshot", ATTACHED, ("payments",))
def stream_nightly_snapshot(spark, sf_dir):
    """A day's payments meet the snapshot of the night before: the account graph is a static table beside the stream."""
    folder = stateful.fresh_folder(spark, "snapshot")
    nightly = durable(graph.degrees(graph.snapshot_edges(payments(spark, sf_dir, COLS))))
    served = graph.attach(event_stream(spark, sf_dir, COLS), nightly)
    stateful.drain(served.select("txn_id", "g_payee_in_degree", "g_payee_unique_in", "g_payer_out_degree"), folder)
    return spark.read.parquet(f"{folder}/out")
