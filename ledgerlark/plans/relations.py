"""Controls, joins, selections and case-queue queries."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..functions import scalar as fx
from ..operators import causal, controls, evaluate, relate
from ..session import durable
from ..sources.tables import LINE_COLUMNS, ledger, payments, table
from .evaluation import CUT, RULE_COLUMNS, RULES_SQL
from .registry import query

CODES = """list_filter([CASE WHEN ag = 1 AND intent_token_present = 0 THEN 'INTENT_ABSENT' END, CASE WHEN seen AND intent_signature_valid = 0 THEN 'INTENT_SIGNATURE_INVALID' END,
 CASE WHEN seen AND intent_age_s > 1800 THEN 'INTENT_EXPIRED' END, CASE WHEN seen AND spt_reuse_count >= 2 THEN 'INTENT_REPLAYED' END, CASE WHEN seen AND intent_payee_match = 0 THEN 'PAYEE_MISMATCH' END,
 CASE WHEN seen AND intent_amount_delta_ratio > 0.05 AND intent_amount_delta_ratio <= 0.2 THEN 'AMOUNT_OVER_TOLERANCE' END, CASE WHEN seen AND intent_amount_delta_ratio > 0.2 THEN 'AMOUNT_EXCEEDS_INTENT' END,
 CASE WHEN seen AND spt_scope_violation = 1 THEN 'SCOPE_VIOLATION' END], lambda x: x IS NOT NULL)"""
GUARD = f"""g0 AS (SELECT *, initiated_by_agent AS ag, initiated_by_agent = 1 AND intent_token_present = 1 AS seen FROM ledger), g1 AS (SELECT *, {CODES} AS r FROM g0),
g AS (SELECT *, CASE WHEN len(list_filter(r, lambda x: x NOT IN ('INTENT_ABSENT', 'AMOUNT_OVER_TOLERANCE'))) > 0 THEN 1 ELSE 0 END AS intent_guard_blocked,
 CASE WHEN len(list_filter(r, lambda x: x IN ('INTENT_ABSENT', 'AMOUNT_OVER_TOLERANCE'))) > 0 THEN 1 ELSE 0 END AS intent_guard_stepup,
 array_to_string(r, '|') AS intent_guard_reasons, len(r) AS intent_guard_violation_count FROM g1)"""
CONTROL = """ce AS (SELECT quantile_cont(amount, 0.99) AS ceiling FROM ledger WHERE initiated_by_agent = 1 AND is_fraud = 0),
c1 AS (SELECT g.*, ceiling, list_filter([CASE WHEN ag = 1 AND agent_identity_asserted = 1 AND agent_request_signature_valid <> 1 THEN 'AGENT_IDENTITY_UNPROVEN' END,
 CASE WHEN ag = 1 AND agent_identity_asserted <> 1 THEN 'AGENT_UNTRUSTED_LANE' END, CASE WHEN ag = 1 AND spt_reuse_count >= 2 THEN 'TOKEN_REPLAY_BLOCKED' END,
 CASE WHEN ag = 1 AND spt_scope_violation = 1 THEN 'TOKEN_SCOPE_BLOCKED' END, CASE WHEN ag = 1 AND amount > ceiling THEN 'TOKEN_OVER_CEILING' END], lambda x: x IS NOT NULL) AS cr FROM g, ce),
c AS (SELECT *, CASE WHEN list_contains(cr, 'TOKEN_REPLAY_BLOCKED') OR list_contains(cr, 'TOKEN_SCOPE_BLOCKED') THEN 1 ELSE 0 END AS agent_control_blocked,
 CASE WHEN list_contains(cr, 'AGENT_IDENTITY_UNPROVEN') THEN 1 ELSE 0 END AS agent_control_stepup, array_to_string(cr, '|') AS agent_control_reasons, round(ceiling, 2) AS agent_control_ceiling FROM c1)"""


@query("control_intent_rows", f"WITH {GUARD} SELECT txn_id, intent_guard_blocked, intent_guard_stepup, intent_guard_reasons, intent_guard_violation_count FROM g", ("ledger",))
def control_intent_rows(spark, sf_dir):
    out = controls.intent_control(ledger(spark, sf_dir, LINE_COLUMNS))
    return out.select("txn_id", *[c for c in out.columns if c.startswith("intent_guard")])


@query("control_agent_rows", f"WITH {GUARD}, {CONTROL} SELECT txn_id, agent_control_blocked, agent_control_stepup, agent_control_reasons, agent_control_ceiling FROM c", ("ledger",))
def control_agent_rows(spark, sf_dir):
    out = controls.agent_controls(ledger(spark, sf_dir, LINE_COLUMNS))
    return out.select("txn_id", *[c for c in out.columns if c.startswith("agent_control")])


@query("control_intent_coverage", f"""WITH {GUARD}, v AS (SELECT *, CASE WHEN attack_vector_id = '' THEN '(legitimate)' ELSE attack_vector_id END AS vec FROM g WHERE ag = 1),
t AS (SELECT vec, reason, count(*) AS k FROM (SELECT vec, unnest(r) AS reason FROM v WHERE intent_guard_blocked = 1) GROUP BY ALL),
m AS (SELECT vec, reason FROM (SELECT *, row_number() OVER (PARTITION BY vec ORDER BY k DESC, reason) AS rn FROM t) WHERE rn = 1)
SELECT vec AS attack_vector_id, count(*) AS rows, sum(is_fraud) AS is_fraud, sum(intent_guard_blocked) AS guard_blocked, avg(intent_guard_blocked) AS block_rate,
 avg(intent_guard_stepup) AS step_up_rate, coalesce(max(reason), '') AS top_reason FROM v LEFT JOIN m USING (vec) GROUP BY vec""", ("ledger",))
def control_intent_coverage(spark, sf_dir):
    return controls.intent_coverage(controls.intent_control(ledger(spark, sf_dir, LINE_COLUMNS)))


@query("control_agent_coverage", f"""WITH {GUARD}, {CONTROL} SELECT CASE WHEN attack_vector_id = '' THEN '(legitimate)' ELSE attack_vector_id END AS attack_vector_id, count(*) AS rows, sum(is_fraud) AS is_fraud,
 avg(list_contains(cr, 'AGENT_IDENTITY_UNPROVEN')::INT) AS identity_unproven_rate, avg(list_contains(cr, 'AGENT_UNTRUSTED_LANE')::INT) AS untrusted_lane_rate,
 avg(list_contains(cr, 'TOKEN_REPLAY_BLOCKED')::INT) AS token_binding_rate, avg(list_contains(cr, 'TOKEN_SCOPE_BLOCKED')::INT) AS scope_rate, avg(list_contains(cr, 'TOKEN_OVER_CEILING')::INT) AS over_ceiling_rate,
 avg(greatest(agent_control_blocked, agent_control_stepup)) AS any_control_rate, avg(agent_control_blocked) AS blocked_rate FROM c WHERE ag = 1 GROUP BY 1""", ("ledger",))
def control_agent_coverage(spark, sf_dir):
    return controls.control_coverage(controls.agent_controls(ledger(spark, sf_dir, LINE_COLUMNS)))


@query("control_ceiling_loss", f"""WITH {GUARD}, {CONTROL}, s AS (SELECT max(ceiling) AS ceiling, sum(is_fraud) AS k, sum(is_fraud * amount) AS a, sum(is_fraud * least(amount, ceiling)) AS b,
 avg(CASE WHEN is_fraud = 0 THEN (amount > ceiling)::INT END) AS capped FROM c WHERE ag = 1)
SELECT round(ceiling, 2) AS ceiling, k AS agentic_fraud_attempts, round(a, 2) AS loss_standing_delegation, round(b, 2) AS loss_scoped_token, round(a - b, 2) AS loss_reduction,
 round(100 * (a - b) / a, 2) AS loss_reduction_pct, round(100 * capped, 3) AS legit_payments_capped_pct FROM s""", ("ledger",))
def control_ceiling_loss(spark, sf_dir):
    return controls.ceiling_loss_bound(ledger(spark, sf_dir, ["amount", "initiated_by_agent", "is_fraud"]))


@query("guard_contribution", f"""WITH {GUARD}, x AS (SELECT attack_vector_id, intent_guard_blocked = 1 AS i, agent_injection_flag = 1 AS j, score >= {CUT} AS m FROM g WHERE is_fraud = 1 AND ag = 1)
SELECT attack_vector_id, count(*) AS rows, avg(i::INT) AS intent_guard, avg(j::INT) AS injection_guard, avg(m::INT) AS tabular_model, avg((i OR j OR m)::INT) AS any_layer,
 avg((m AND NOT i AND NOT j)::INT) AS model_only FROM x GROUP BY 1""", ("ledger",))
def guard_contribution(spark, sf_dir):
    return evaluate.guard_contribution(controls.intent_control(ledger(spark, sf_dir, LINE_COLUMNS)), CUT)


@query("decision_outcomes", f"""WITH {GUARD}, {CONTROL}, d AS (SELECT *, CASE WHEN score >= {CUT} THEN 1 ELSE 0 END AS model_alert FROM c)
SELECT CASE WHEN intent_guard_blocked = 1 THEN 'intent_block' WHEN agent_control_blocked = 1 THEN 'control_block' WHEN model_alert = 1 THEN 'alert' ELSE 'approve' END AS outcome,
 count(*) AS rows, sum(greatest(model_alert, intent_guard_blocked, agent_control_blocked)) AS decisions, sum(is_fraud) AS fraud FROM d GROUP BY 1""", ("ledger",))
def decision_outcomes(spark, sf_dir):
    rows = controls.decide(controls.agent_controls(controls.intent_control(ledger(spark, sf_dir, LINE_COLUMNS))), CUT)
    return rows.groupBy("outcome").agg(F.count(F.lit(1)).alias("rows"), F.sum("decision").alias("decisions"), F.sum("is_fraud").alias("fraud"))


def _instructions(spark, sf_dir):
    return table(spark, sf_dir, "orders").where("o_orderstatus <> 'P'").selectExpr(
        "o_orderkey AS seq", "o_totalprice / 4 AS max_amount", "'INR' AS currency", "concat('A', CAST(o_orderkey % 100 AS STRING)) AS payee_id",
        "array('purchase', 'ship') AS scope", "unix_seconds(CAST(o_orderdate AS TIMESTAMP)) + 86400 * 200 AS expires_at",
        "CASE WHEN o_orderpriority = '5-LOW' THEN 0 ELSE 1 END AS signature_valid")


@query("join_settlement_instruction", """WITH s AS (SELECT * FROM ledger),
j0 AS (SELECT s.*, o_totalprice / 4 AS max_amount, concat('A', (o_orderkey % 100)::VARCHAR) AS payee_id, epoch(o_orderdate)::BIGINT + 86400 * 200 AS expires_at, o_orderpriority FROM s LEFT JOIN orders ON o_orderkey = seq AND o_orderstatus <> 'P'),
j1 AS (SELECT *, CASE WHEN max_amount IS NULL OR o_orderpriority = '5-LOW' OR ts_s > expires_at OR payee <> payee_id OR currency <> 'INR' OR amount > max_amount * (1 + 0.05::DOUBLE) OR rail = 'card' THEN 0 ELSE 1 END AS accepted FROM j0),
j AS (SELECT *, CASE WHEN coalesce(sum(accepted) OVER (PARTITION BY seq ORDER BY ts_s, line, item, supp, cents ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) > 0 THEN 1 ELSE 0 END AS spent FROM j1),
r AS (SELECT txn_id, CASE WHEN max_amount IS NULL THEN ['INTENT_ABSENT'] WHEN o_orderpriority = '5-LOW' THEN ['INTENT_SIGNATURE_INVALID'] ELSE list_filter([CASE WHEN ts_s > expires_at THEN 'INTENT_EXPIRED' END,
 CASE WHEN spent = 1 THEN 'INTENT_REPLAYED' END, CASE WHEN payee <> payee_id THEN 'PAYEE_MISMATCH' END, CASE WHEN currency <> 'INR' THEN 'CURRENCY_MISMATCH' END,
 CASE WHEN amount > max_amount * (1 + 0.05::DOUBLE) THEN 'AMOUNT_EXCEEDS_INTENT' END, CASE WHEN rail = 'card' THEN 'SCOPE_VIOLATION' END], lambda x: x IS NOT NULL) END AS r FROM j)
SELECT txn_id, array_to_string(r, '|') AS reasons, CASE WHEN len(r) = 0 THEN 1 ELSE 0 END AS allowed FROM r""", ("ledger",))
def join_settlement_instruction(spark, sf_dir):
    order = ["line", "item", "supp", "cents"]
    rows = ledger(spark, sf_dir, ["txn_id", "seq", "ts_s", *order, "payee", "currency", "amount", "rail"])
    s = rows.select("txn_id", "seq", *order, F.col("ts_s").alias("now_s"), F.col("payee").alias("settle_payee"), F.col("currency").alias("settle_currency"),
                    F.col("amount").alias("settle_amount"),
                    F.when(F.col("rail") == "card", F.array(F.lit("purchase"), F.lit("refund"))).otherwise(F.array(F.lit("purchase"))).alias("requested_scope"))
    return controls.verify_settlements(s, _instructions(spark, sf_dir), "seq", order).select("txn_id", "reasons", "allowed")


@query("join_agent_registry", """WITH j AS (SELECT txn_id, supp, payer, ts_s, seq, line, item, cents, CASE WHEN s_acctbal < 0 OR s_suppkey IS NULL THEN 'AGENT_NOT_ENROLLED' WHEN line * 12 > 60 THEN 'AGENT_SIGNATURE_STALE'
 WHEN agent_request_signature_valid = 0 THEN 'AGENT_SIGNATURE_INVALID' END AS code, concat(payer, '/', (item % 3)::VARCHAR) AS signature FROM ledger LEFT JOIN supplier ON s_suppkey = supp)
SELECT txn_id, CASE WHEN code IS NULL AND row_number() OVER (PARTITION BY supp, signature, code ORDER BY ts_s, seq, line, item, cents) > 1 THEN 'AGENT_REQUEST_REPLAYED' ELSE code END AS reason FROM j""", ("ledger",))
def join_agent_registry(spark, sf_dir):
    reg = table(spark, sf_dir, "supplier").where("s_acctbal >= 0").selectExpr("s_suppkey AS supp")
    rows = ledger(spark, sf_dir, ["txn_id", "supp", "payer", "line", "item", "seq", "cents", "ts_s", "agent_request_signature_valid"]).selectExpr(
        "txn_id", "supp", "seq", "line", "item", "cents", "ts_s AS now_s", "ts_s - line * 12 AS created_s", "agent_request_signature_valid AS signature_valid",
        "concat(payer, '/', CAST(item % 3 AS STRING)) AS signature")
    return controls.verify_agents(rows, reg, "supp", order=["now_s", "seq", "line", "item", "cents"]).select("txn_id", "reason")


@query("join_token_redemption", """WITH j AS (SELECT l.*, p_partkey IS NOT NULL AS issued, p_retailprice * 40 AS mx, p_size FROM ledger l LEFT JOIN part ON p_partkey = item AND p_partkey % 9 <> 0),
k AS (SELECT *, issued AND supp % 10 <> 3 AND NOT intent_age_s > p_size * 80 AND NOT amount > mx AND currency = 'INR' AND rail <> 'upi' AS clean FROM j),
f AS (SELECT *, coalesce(sum(clean::INT) OVER (PARTITION BY item ORDER BY intent_age_s, seq, line, supp, cents ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) > 0 AS spent FROM k)
SELECT txn_id, CASE WHEN NOT issued THEN 'TOKEN_UNKNOWN' ELSE array_to_string(list_filter([CASE WHEN supp % 10 = 3 THEN 'TOKEN_NOT_BOUND_TO_PRESENTER' END, CASE WHEN intent_age_s > p_size * 80 THEN 'TOKEN_EXPIRED' END,
 CASE WHEN p_size > 25 AND spent THEN 'TOKEN_ALREADY_SPENT' END, CASE WHEN amount > mx THEN 'TOKEN_CEILING_EXCEEDED' END, CASE WHEN currency <> 'INR' THEN 'TOKEN_CURRENCY_MISMATCH' END,
 CASE WHEN rail = 'upi' THEN 'TOKEN_SCOPE_VIOLATION' END], lambda x: x IS NOT NULL), '|') END AS reasons FROM f""", ("ledger",))
def join_token_redemption(spark, sf_dir):
    """Redemptions by the age of their intent; every ninth token was never issued."""
    tokens = table(spark, sf_dir, "part").where("p_partkey % 9 <> 0").selectExpr(
        "p_partkey AS item", "p_retailprice * 40 AS max_amount", "p_size * 80 AS expires_at", "int(p_size > 25) AS single_use", "'INR' AS currency",
        "array('purchase') AS scope", "'holder' AS holder")
    rows = ledger(spark, sf_dir, ["txn_id", "item", "supp", "seq", "line", "cents", "intent_age_s", "amount", "currency", "rail"]).selectExpr(
        "txn_id", "item", "supp", "seq", "line", "cents", "IF(supp % 10 = 3, 'other', 'holder') AS presenter", "intent_age_s AS now_s", "amount AS redeem_amount",
        "currency AS redeem_currency", "IF(rail = 'upi', array('purchase', 'transfer'), array('purchase')) AS requested_scope")
    return controls.redeem_tokens(rows, tokens, "item", ["now_s", "seq", "line", "supp", "cents"]).select("txn_id", "reasons")


@query("join_document_score", """WITH d AS (SELECT doc_id AS k, CASE WHEN n_chars > 2000 THEN 0.9 ELSE n_chars / 4000.0::DOUBLE END AS s FROM documents WHERE lang <> 'de')
SELECT event_id AS k, coalesce(s, 0)::DOUBLE AS agent_injection_score, CASE WHEN s >= 0.5 THEN 1 ELSE 0 END AS agent_injection_flag FROM events LEFT JOIN d ON k = event_id""")
def join_document_score(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").selectExpr(
        "doc_id AS k", "int(lang <> 'de') AS linked", "IF(n_chars > 2000, 0.9D, n_chars / 4000.0D) AS doc_score", "n_chars")
    twice = docs.unionByName(docs.selectExpr("k", "linked", "0.0D AS doc_score", "-1L AS n_chars"))
    return relate.document_scores(table(spark, sf_dir, "events").selectExpr("event_id AS k"), twice, "k", 0.5, F.col("n_chars"))


@query("join_episode_spread", """WITH d AS (SELECT *, CASE WHEN call_in_progress = 1 AND seq % 2 = 0 THEN score END AS direct FROM ledger),
e AS (SELECT campaign_id, max(direct) AS best FROM d WHERE trim(campaign_id) <> '' GROUP BY 1)
SELECT txn_id, coalesce(direct, best, 0) AS vishing_score, CASE WHEN coalesce(direct, best) IS NULL THEN 0 ELSE 1 END AS vishing_covered FROM d LEFT JOIN e USING (campaign_id)""", ("ledger",))
def join_episode_spread(spark, sf_dir):
    rows = ledger(spark, sf_dir, ["txn_id", "campaign_id"])
    direct = ledger(spark, sf_dir, ["txn_id", "seq", "score", "call_in_progress"]).where("call_in_progress = 1 AND seq % 2 = 0").selectExpr("txn_id", "score AS direct")
    return relate.spread_over_episode(rows, direct, "txn_id", "campaign_id").drop("campaign_id")


@query("join_siblings", f"""WITH r AS (SELECT txn_id, campaign_id, row_number() OVER (PARTITION BY campaign_id ORDER BY ts_s, txn_id) AS rn FROM ledger WHERE campaign_id <> ''),
a AS (SELECT l.txn_id, l.campaign_id, r.rn FROM ledger l JOIN r USING (txn_id) WHERE score >= {CUT})
SELECT a.txn_id, b.txn_id AS sibling, CASE WHEN a.rn < b.rn THEN b.rn - 1 ELSE b.rn END AS place FROM a JOIN r b ON a.campaign_id = b.campaign_id AND a.txn_id <> b.txn_id
WHERE CASE WHEN a.rn < b.rn THEN b.rn - 1 ELSE b.rn END <= 40""", ("ledger",))
def join_siblings(spark, sf_dir):
    rows = ledger(spark, sf_dir, ["txn_id", "campaign_id", "ts_s", "score"])
    return relate.siblings(rows.where(F.col("score") >= CUT), rows, "campaign_id", "txn_id", ["ts_s", "txn_id"])


@query("join_residual_risk", """WITH m AS (SELECT attack_vector_id AS v, avg(CASE WHEN score >= 0.88 THEN 1 ELSE 0 END) AS r FROM ledger WHERE is_fraud = 1 AND supp % 12 < 9 GROUP BY 1),
k AS (SELECT concat('V', (s_suppkey % 12)::VARCHAR) AS v, avg(s_acctbal) / 10000 AS risk FROM supplier GROUP BY 1)
SELECT v AS vector, round(risk, 5) AS risk, r AS recall, round(CASE WHEN r IS NULL THEN risk ELSE risk * (1 - r) END, 5) AS residual_risk, CASE WHEN r IS NULL THEN 'unmeasured' ELSE 'measured recall' END AS basis FROM k LEFT JOIN m USING (v)""", ("ledger",))
def join_residual_risk(spark, sf_dir):
    measured = ledger(spark, sf_dir, ["attack_vector_id", "score", "is_fraud", "supp"]).where("is_fraud = 1 AND supp % 12 < 9").groupBy(
        F.col("attack_vector_id").alias("vector")).agg(F.avg((F.col("score") >= CUT).cast("double")).alias("recall"))
    catalogue = table(spark, sf_dir, "supplier").groupBy(F.expr("concat('V', CAST(s_suppkey % 12 AS STRING))").alias("vector")).agg((F.avg("s_acctbal") / 10000).alias("risk"))
    left = F.when(F.col("recall").isNull(), F.col("risk")).otherwise(F.col("risk") * (1 - F.col("recall")))
    return catalogue.join(measured, "vector", "left").select("vector", F.round("risk", 5).alias("risk"), "recall", F.round(left, 5).alias("residual_risk"),
                                                           F.when(F.col("recall").isNull(), "unmeasured").otherwise("measured recall").alias("basis"))


@query("join_clean_counterparties", "SELECT payee, count(*) AS inbound FROM ledger GROUP BY payee HAVING sum(CASE WHEN is_fraud = 1 AND score > 0.97 THEN 1 ELSE 0 END) = 0 AND sum(1 - is_fraud) >= 10", ("ledger",))
def join_clean_counterparties(spark, sf_dir):
    rows = ledger(spark, sf_dir, ["payee", "is_fraud", "score"])
    busy = rows.groupBy("payee").agg(F.count(F.lit(1)).alias("inbound"), F.sum(1 - F.col("is_fraud")).alias("_l")).where("_l >= 10").drop("_l")
    return busy.join(rows.where("is_fraud = 1 AND score > 0.97"), "payee", "left_anti")


@query("join_control_gap", """WITH u AS (SELECT o_orderpriority AS tactic, unnest(string_split(o_orderpriority || '-' || o_orderstatus, '-')) AS ctl, o_orderkey FROM orders)
SELECT tactic, trim(ctl) AS control, CASE WHEN n_name IS NULL THEN 'intact' ELSE 'defeated' END AS status, count(*) AS rows FROM u LEFT JOIN (SELECT DISTINCT upper(substr(c_mktsegment, 1, 1)) AS c, c_mktsegment AS n_name FROM customer) x ON substr(trim(ctl), 1, 1) = x.c GROUP BY ALL""")
def join_control_gap(spark, sf_dir):
    used = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("tactic"), F.explode(F.split(F.concat_ws("-", "o_orderpriority", "o_orderstatus"), "-")).alias("c")).select("tactic", F.trim("c").alias("control"))
    levers = table(spark, sf_dir, "customer").select(F.upper(F.substring("c_mktsegment", 1, 1)).alias("k"), F.lit(1).alias("_hit"), "c_mktsegment").distinct()
    j = used.groupBy("tactic", "control").agg(F.count(F.lit(1)).alias("rows")).withColumn("k", F.substring("control", 1, 1)).join(levers, "k", "left")
    return j.groupBy("tactic", "control", F.when(F.col("_hit").isNull(), "intact").otherwise("defeated").alias("status")).agg(F.sum("rows").alias("rows"))


@query("case_queue_page", f"""WITH ca AS (SELECT txn_id, ['open','held','closed'][1 + line % 3] AS status, ts_s + line AS updated FROM ledger WHERE line <= 4)
SELECT l.txn_id, score, amount, status FROM ledger l LEFT JOIN ca USING (txn_id) WHERE score >= {CUT} AND score >= 0.9 ORDER BY score DESC, l.txn_id LIMIT 50 OFFSET 20""", ("ledger",))
def case_queue_page(spark, sf_dir):
    rows = ledger(spark, sf_dir, ["txn_id", "score", "amount", "line", "ts_s"])
    events = rows.where("line <= 4").selectExpr("txn_id", "element_at(array('open','held','closed'), int(1 + line % 3)) AS status", "ts_s + line AS updated_at")
    events = events.unionByName(rows.where("line <= 4").selectExpr("txn_id", "'new' AS status", "ts_s AS updated_at"))
    cases = relate.latest(events, ["txn_id"], F.col("updated_at")).drop("updated_at")
    alerts = rows.select("txn_id", "score", "amount", fx.flag(F.col("score") >= CUT).alias("decision"))
    return relate.queue(alerts, cases, ["txn_id"], 0.9, 50, 20).select("txn_id", "score", "amount", "status")


@query("case_queue_counters", f"SELECT rail AS run_id, count(*) AS scored, sum(CASE WHEN score >= {CUT} THEN 1 ELSE 0 END) AS alerts, sum(is_fraud) AS fraud, sum(CASE WHEN score >= {CUT} THEN is_fraud ELSE 0 END) AS caught FROM ledger GROUP BY rail", ("ledger",))
def case_queue_counters(spark, sf_dir):
    alert = fx.flag(F.col("score") >= CUT)
    return ledger(spark, sf_dir, ["rail", "score", "is_fraud"]).groupBy(F.col("rail").alias("run_id")).agg(
        F.count(F.lit(1)).alias("scored"), F.sum(alert).alias("alerts"), F.sum("is_fraud").alias("fraud"), F.sum(alert * F.col("is_fraud")).alias("caught"))


@query("select_dense_ids", "SELECT txn_id, printf('T%09d', row_number() OVER (ORDER BY ts_s, txn_id) - 1) AS dense_id FROM ledger", ("ledger",))
def select_dense_ids(spark, sf_dir):
    return relate.dense_ids(ledger(spark, sf_dir, ["txn_id", "ts_s"]), "ts_s", ["txn_id"]).select("txn_id", "dense_id")


@query("select_temporal_split", """WITH s AS (SELECT *, CASE WHEN ts_s >= (SELECT max(ts_s) FROM ledger) - 864000 THEN 'test' WHEN ts_s >= (SELECT max(ts_s) FROM ledger) - 1296000 THEN 'calibration' ELSE 'train' END AS split FROM ledger)
SELECT split, count(*) AS rows, sum(is_fraud) AS fraud, R(avg(is_fraud), 5) AS fraud_rate, count(DISTINCT CASE WHEN is_fraud = 1 THEN attack_vector_id END) AS vectors, min(ts_s) AS start, max(ts_s) AS "end" FROM s GROUP BY split""", ("ledger",))
def select_temporal_split(spark, sf_dir):
    return relate.describe_split(relate.temporal_split(ledger(spark, sf_dir, ["ts_s", "is_fraud", "attack_vector_id"])))


@query("select_rule_rows", "SELECT txn_id, CASE WHEN amount >= 50000 AND payee_added_minutes_ago <= 600 THEN 1 ELSE 0 END AS fires FROM ledger", ("ledger",))
def select_rule_rows(spark, sf_dir):
    rows = ledger(spark, sf_dir, ["txn_id", "amount", "payee_added_minutes_ago"])
    return relate.rule(rows, [("amount", ">=", 50000.0), ("payee_added_minutes_ago", "<=", 600.0)]).select("txn_id", "fires")


@query("select_filtered_page", f"SELECT txn_id, rail, score, amount, count(*) OVER () AS total FROM ledger WHERE rail = 'upi' AND score >= {CUT} AND is_fraud = 0 AND amount >= 1000 ORDER BY txn_id LIMIT 25", ("ledger",))
def select_filtered_page(spark, sf_dir):
    rows = ledger(spark, sf_dir, ["txn_id", "rail", "score", "amount", "is_fraud"]).where(f"rail = 'upi' AND score >= {CUT} AND is_fraud = 0 AND amount >= 1000")
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    from ..operators.ordered import attach_totals
    return attach_totals(rows.orderBy("txn_id").limit(25), total, []).select("txn_id", "rail", "score", "amount", "total")


@query("select_top_alerts", f"SELECT txn_id, score, amount, rail FROM ledger WHERE score >= {CUT} ORDER BY score DESC, txn_id LIMIT 12", ("ledger",))
def select_top_alerts(spark, sf_dir):
    return ledger(spark, sf_dir, ["txn_id", "score", "amount", "rail"]).where(F.col("score") >= CUT).orderBy(F.desc("score"), "txn_id").limit(12)


@query("select_stratified_sample")
def select_stratified_sample(spark, sf_dir):
    return relate.stratified_sample(ledger(spark, sf_dir, ["txn_id", "is_fraud", "amount"]), 10000, "txn_id")


@query("select_proportional_sample")
def select_proportional_sample(spark, sf_dir):
    return relate.proportional_sample(ledger(spark, sf_dir, ["txn_id", "attack_vector_id", "is_fraud"]).where("is_fraud = 1"), "attack_vector_id", "txn_id", 300)


@query("select_stratified_counts", """WITH t AS (SELECT sum(is_fraud)::BIGINT AS f, sum(1 - is_fraud)::BIGINT AS l FROM ledger)
SELECT 1 AS is_fraud, f AS rows FROM t UNION ALL SELECT 0, least(l, greatest(10000 - f, 500)) FROM t""", ("ledger",))
def select_stratified_counts(spark, sf_dir):
    """The draws differ between engines, the sizes do not."""
    return select_stratified_sample(spark, sf_dir).groupBy("is_fraud").agg(F.count(F.lit(1)).alias("rows"))


@query("select_proportional_counts", """WITH g AS (SELECT attack_vector_id, count(*) AS n FROM ledger WHERE is_fraud = 1 GROUP BY 1)
SELECT attack_vector_id, CAST(greatest(1, round_even(n * 300 / (SELECT sum(n) FROM g), 0)) AS BIGINT) AS rows FROM g""", ("ledger",))
def select_proportional_counts(spark, sf_dir):
    return select_proportional_sample(spark, sf_dir).groupBy("attack_vector_id").agg(F.count(F.lit(1)).alias("rows"))


@query("select_reason_codes", """WITH i AS (SELECT txn_id, list_sort(list_filter([{'w': -abs((amount - 50000) / 20000::DOUBLE) * 0.5, 'c': 'amount', 'v': amount}, {'w': -abs((auth_attempts - 2) / 1::DOUBLE) * 0.3, 'c': 'auth_attempts', 'v': auth_attempts::DOUBLE},
 {'w': -abs((payee_account_age_days - 500) / 300::DOUBLE) * 0.2, 'c': 'payee_account_age_days', 'v': payee_account_age_days}], lambda s: s.w < 0))[1:2] AS t FROM ledger)
SELECT txn_id, array_to_string(list_transform(t, lambda s: s.c || '=' || printf('%.4f', s.v)), '|') AS reason_codes FROM i""", ("ledger",))
def select_reason_codes(spark, sf_dir):
    rows = ledger(spark, sf_dir, ["txn_id", "amount", "auth_attempts", "payee_account_age_days"])
    stats = {"amount": (50000.0, 20000.0, 0.5), "auth_attempts": (2.0, 1.0, 0.3), "payee_account_age_days": (500.0, 300.0, 0.2)}
    return relate.reason_codes(rows, stats, 2).select("txn_id", F.array_join("reason_codes", "|").alias("reason_codes"))


@query("text_clean_and_dedupe", r"""WITH t AS (SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(text, '^\s*(?:[-*]|\d+[.)])\s+', ''), '^["'']+|["'']+$', '', 'g'), '\s+', ' ', 'g')) AS c FROM documents),
k AS (SELECT *, row_number() OVER (PARTITION BY lower(c) ORDER BY doc_id) AS r FROM t WHERE length(c) BETWEEN 20 AND 600 AND NOT regexp_matches(lower(c), 'as an ai|i cannot'))
SELECT doc_id, length(c) AS chars FROM k WHERE r = 1""")
def text_clean_and_dedupe(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return relate.clean_texts(docs, "text", "doc_id", 20, 600, "as an ai|i cannot").select("doc_id", F.length("clean").cast("long").alias("chars"))


@query("text_dialogue_turns", """WITH d AS (SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS t, count(*) AS n FROM conversations GROUP BY 1)
SELECT conv_id, len(regexp_extract_all(t, '(?im)^\\s*(?:user|assistant|system)\\s*:')) AS markers FROM d WHERE len(regexp_extract_all(t, '(?im)^\\s*(?:user|assistant|system)\\s*:')) >= 4 AND length(t) BETWEEN 200 AND 12000""")
def text_dialogue_turns(spark, sf_dir):
    line = F.concat("role", F.lit(": "), "text")
    turns = table(spark, sf_dir, "conversations").select("conv_id", line.alias("t"))
    marks = F.size(F.expr(r"regexp_extract_all(t, '(?im)^\\s*(?:user|assistant|system)\\s*:', 0)"))
    d = turns.groupBy("conv_id").agg(F.sum(marks).alias("markers"), (F.sum(F.length("t")) + F.count(F.lit(1)) - 1).alias("chars"))
    return d.where(F.col("chars").between(200, 12000) & (F.col("markers") >= 4)).select("conv_id", "markers")


@query("summary_documents", """SELECT lang, source, count(*) AS docs, avg(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic_rate, GROUPING(lang) AS g_lang, GROUPING(source) AS g_source FROM documents LEFT JOIN labels USING (doc_id)
GROUP BY GROUPING SETS ((), (lang), (source))""")
def summary_documents(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source").join(table(spark, sf_dir, "labels").select("doc_id", "toxic"), "doc_id", "left")
    return d.groupingSets([[], ["lang"], ["source"]], "lang", "source").agg(
        F.count(F.lit(1)).alias("docs"), F.avg(F.coalesce((F.col("toxic") == 1).cast("double"), F.lit(0.0))).alias("toxic_rate"),
        F.grouping("lang").cast("long").alias("g_lang"), F.grouping("source").cast("long").alias("g_source"))


@query("summary_across_runs", """WITH r AS (SELECT rail, avg(CASE WHEN is_fraud = 1 THEN (score >= 0.88)::INT END) AS recall, avg(CASE WHEN is_fraud = 0 THEN (score >= 0.88)::INT END) AS fpr FROM ledger GROUP BY rail),
u AS (UNPIVOT r ON recall, fpr INTO NAME metric VALUE v) SELECT metric, round(avg(v), 9) AS mean, round(stddev_samp(v), 9) AS sd, min(v) AS low, max(v) AS high, count(*) AS runs FROM u GROUP BY metric""", ("ledger",))
def summary_across_runs(spark, sf_dir):
    alert = (F.col("score") >= CUT).cast("double")
    r = ledger(spark, sf_dir, ["rail", "score", "is_fraud"]).groupBy("rail").agg(F.avg(F.when(F.col("is_fraud") == 1, alert)).alias("recall"), F.avg(F.when(F.col("is_fraud") == 0, alert)).alias("fpr"))
    return r.unpivot("rail", ["recall", "fpr"], "metric", "v").groupBy("metric").agg(
        F.round(F.avg("v"), 9).alias("mean"), F.round(F.stddev_samp("v"), 9).alias("sd"), F.min("v").alias("low"), F.max("v").alias("high"), F.count("v").alias("runs"))


@query("summary_campaign_loss", """SELECT campaign_id, count(*) AS payments, count(DISTINCT payee) AS payees, sum(cents) / 100.0::DOUBLE AS value_at_risk, sum(CASE WHEN score < 0.88 THEN cents ELSE 0 END) / 100.0::DOUBLE AS value_lost,
 sum(CASE WHEN score >= 0.88 THEN 1 ELSE 0 END) * 250.0::DOUBLE AS review_cost FROM ledger WHERE campaign_id <> '' GROUP BY 1""", ("ledger",))
def summary_campaign_loss(spark, sf_dir):
    hit = F.col("score") >= CUT
    return ledger(spark, sf_dir, ["campaign_id", "payee", "cents", "score"]).where("campaign_id <> ''").groupBy("campaign_id").agg(
        F.count(F.lit(1)).alias("payments"), F.count_distinct("payee").alias("payees"), evaluate.money(F.lit(True)).alias("value_at_risk"), evaluate.money(~hit).alias("value_lost"),
        (F.sum(hit.cast("long")) * F.lit(250.0)).alias("review_cost"))


_RANKS = {"p50": 0.5, "p95": 0.95, "p99": 0.99}


@query("summary_nearest_rank", "SELECT rail, min(amount) AS low, " + ", ".join(f"quantile_disc(amount, {q}) AS {n}" for n, q in _RANKS.items()) + ", max(amount) AS high FROM ledger GROUP BY rail", ("ledger",))
def summary_nearest_rank(spark, sf_dir):
    from ..operators.ordered import attach_totals, value_scan
    c = durable(ledger(spark, sf_dir, ["rail", "amount"]).groupBy("rail", "amount").agg(F.count(F.lit(1)).alias("k")))
    s = attach_totals(value_scan(c, ["rail"], "amount", ["k"]), c.groupBy("rail").agg(F.sum("k").alias("n")), ["rail"])
    reached = lambda q: F.col("before_k") + F.col("k") >= F.ceil(F.col("n") * q)
    return s.groupBy("rail").agg(F.min("amount").alias("low"), *[F.min(F.when(reached(q), F.col("amount"))).alias(n) for n, q in _RANKS.items()], F.max("amount").alias("high"))


@query("summary_sensitivity", """WITH r AS (SELECT channel AS knob, day // 365 AS seed, avg(CASE WHEN is_fraud = 1 THEN (score >= 0.88)::INT END) AS recall, avg(CASE WHEN is_fraud = 0 THEN (score >= 0.88)::INT END) AS fpr FROM ledger GROUP BY 1, 2),
u AS (UNPIVOT r ON recall, fpr INTO NAME metric VALUE v) SELECT knob, metric, round(avg(v), 9) AS mean, round(stddev_samp(v), 9) AS sd, count(v) AS runs FROM u GROUP BY 1, 2""", ("ledger",))
def summary_sensitivity(spark, sf_dir):
    """Each value of a knob over its repeated runs."""
    alert = (F.col("score") >= CUT).cast("double")
    rows = ledger(spark, sf_dir, ["channel", "day", "score", "is_fraud"]).groupBy(F.col("channel").alias("knob"), F.expr("day div 365").alias("seed"))
    runs = rows.agg(F.avg(F.when(F.col("is_fraud") == 1, alert)).alias("recall"), F.avg(F.when(F.col("is_fraud") == 0, alert)).alias("fpr"))
    return relate.sensitivity(runs.drop("seed"), "knob", ["recall", "fpr"])


@query("summary_verdicts", """SELECT lang, count(*) AS judged, avg((g = t)::INT) AS accuracy, avg(g) AS guessed_share FROM (SELECT lang, toxic AS t, CASE WHEN n_chars % 3 = 0 THEN 1 ELSE 0 END AS g
FROM documents JOIN labels USING (doc_id)) GROUP BY lang""")
def summary_verdicts(spark, sf_dir):
    """How often a judge's guess met the truth, and how often it guessed yes."""
    docs = table(spark, sf_dir, "documents").selectExpr("doc_id", "lang", "int(n_chars % 3 = 0) AS guess")
    return relate.verdict_accuracy(docs.join(table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("truth")), "doc_id"), "lang", "guess", "truth")


@query("scalar_currency", """SELECT txn_id, CASE currency WHEN 'USD' THEN 1 ELSE 0 END AS foreign_, round_even(amount / coalesce(d, 1) * 100, 0) / 100 AS amount_inr FROM ledger LEFT JOIN (VALUES """
       + ", ".join(f"('{c}', {v}::DOUBLE)" for c, v in fx.CURRENCY_DIVISOR.items()) + """) AS t(c, d) ON c = currency""", ("ledger",))
def scalar_currency(spark, sf_dir):
    rows = ledger(spark, sf_dir, ["txn_id", "amount", "currency"])
    return rows.select("txn_id", (F.col("currency") == "USD").cast("int").alias("foreign_"), fx.convert_currency(F.col("amount"), F.col("currency")).alias("amount_inr"))


@query("scalar_calendar", """SELECT event_id, hour(ts) AS hour, isodow(ts) - 1 AS day_of_week, CASE WHEN hour(ts) < 6 OR hour(ts) >= 23 THEN 1 ELSE 0 END AS is_night,
 CASE WHEN day(ts) <= 3 OR day(ts) >= 29 THEN 1 ELSE 0 END AS is_salary_window FROM events""")
def scalar_calendar(spark, sf_dir):
    made = fx.calendar(F.col("ts"))
    return table(spark, sf_dir, "events").select("event_id", *[c.alias(n) for n, c in made.items()])


@query("scalar_payload_span", """SELECT doc_id, CASE WHEN a >= 0 AND b >= 0 THEN substr(text, a + 1, b - a) END AS payload FROM (SELECT doc_id, text, doc_id % 50 - 5 AS a, doc_id % 50 + 20 AS b FROM documents)""")
def scalar_payload_span(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").selectExpr("doc_id", "text", "int(doc_id % 50 - 5) AS a", "int(doc_id % 50 + 20) AS b")
    return docs.select("doc_id", fx.payload_span(F.col("text"), F.col("a"), F.col("b")).alias("payload"))


@query("join_guard_merge", """SELECT txn_id, rail, CASE WHEN line <= 3 THEN amount * 2 END AS amount, CASE WHEN line <= 3 THEN 1 END AS checked FROM ledger""", ("ledger",))
def join_guard_merge(spark, sf_dir):
    rows = ledger(spark, sf_dir, ["txn_id", "rail", "amount", "line"])
    guard = rows.where("line <= 3").selectExpr("txn_id", "amount * 2 AS amount", "1 AS checked")
    return relate.replace_columns(rows.drop("line"), guard, "txn_id")


@query("score_rule_count", f"""WITH r AS (SELECT txn_id, {RULES_SQL} FROM ledger) SELECT txn_id, {" + ".join(re.findall("AS ([a-z_]+)", RULES_SQL))} AS fired FROM r""", ("ledger",))
def score_rule_count(spark, sf_dir):
    return ledger(spark, sf_dir, ["txn_id", *RULE_COLUMNS]).select("txn_id", evaluate.rule_count().alias("fired"))


@query("set_changed_entities", """WITH a AS (SELECT * FROM payments WHERE day <> 19745), b AS (SELECT txn_id, payer, payee, CASE WHEN day = 19747 THEN amount + 1 ELSE amount END AS amount FROM payments),
ch AS (SELECT a.payer AS p1, a.payee AS p2, b.payer AS p3, b.payee AS p4 FROM a FULL JOIN b USING (txn_id) WHERE a.amount IS DISTINCT FROM b.amount)
SELECT DISTINCT kind, entity FROM (SELECT 'payer' AS kind, p1 AS entity FROM ch UNION ALL SELECT 'payer', p3 FROM ch UNION ALL SELECT 'payee', p2 FROM ch UNION ALL SELECT 'payee', p4 FROM ch) WHERE entity IS NOT NULL AND entity <> ''""", ("payments",))
def set_changed_entities(spark, sf_dir):
    from ..operators import incremental
    rows = payments(spark, sf_dir, ["txn_id", "payer", "payee", "amount", "day"])
    before = rows.where("day <> 19745").drop("day")
    after = rows.withColumn("amount", F.when(F.col("day") == 19747, F.col("amount") + 1).otherwise(F.col("amount"))).drop("day")
    return incremental.changed_entities(before, after, "txn_id", ["payer", "payee"])
