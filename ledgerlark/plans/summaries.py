"""Pages by key, siblings of a ring, corpus and catalogue totals, campaign profit."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import catalogue, relate
from ..operators.ordered import attach_totals, exact_quantiles
from ..sources.tables import ledger, table
from .catalogues import _parts
from .evaluation import CUT
from .registry import query


@query("select_page_after_cursor", f"""WITH f AS (SELECT txn_id, rail, score, amount FROM ledger WHERE is_fraud = 1 AND score < {CUT} AND attack_vector_id = 'V3' AND amount BETWEEN 1000 AND 60000),
p AS (SELECT *, row_number() OVER (ORDER BY txn_id) AS k, count(*) OVER () AS total FROM f)
SELECT txn_id, rail, score, amount, total, CASE WHEN total > 20 THEN (SELECT txn_id FROM p WHERE k = 20) END AS next_cursor FROM p WHERE k > 10 AND k <= 20""", ("ledger",))
def select_page_after_cursor(spark, sf_dir):
    """The second page of ten missed frauds of one vector; the first page gives the key behind which it starts."""
    rows = ledger(spark, sf_dir, ["txn_id", "rail", "score", "amount", "is_fraud", "attack_vector_id"])
    missed = rows.where(relate.decision_class("missed", CUT)).where("attack_vector_id = 'V3' AND amount BETWEEN 1000 AND 60000")
    first = relate.page(missed, "txn_id", 10).first()
    return relate.page(missed, "txn_id", 10, first["next_cursor"] if first else None).select("txn_id", "rail", "score", "amount", "total", "next_cursor")


@query("select_decision_classes", " UNION ALL ".join(
    f"SELECT '{name}' AS decision, count(*) AS rows, coalesce(sum(cents), 0)::BIGINT AS cents FROM ledger WHERE {text.format(cut=CUT)}" for name, text in relate.DECISIONS.items()), ("ledger",))
def select_decision_classes(spark, sf_dir):
    rows = ledger(spark, sf_dir, ["score", "is_fraud", "cents"])
    kinds = F.explode(F.array(*[F.when(relate.decision_class(k, CUT), F.lit(k)) for k in relate.DECISIONS]))
    return rows.select(kinds.alias("decision"), "cents").where("decision IS NOT NULL").groupBy("decision").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("cents").alias("cents"))


@query("join_ring_siblings", f"""WITH r AS (SELECT txn_id, mule_ring_id, ts_s, score, row_number() OVER (PARTITION BY mule_ring_id ORDER BY ts_s, txn_id) AS rn FROM ledger WHERE mule_ring_id <> ''),
j AS (SELECT a.txn_id, b.txn_id AS sibling, b.score, b.ts_s, CASE WHEN a.rn < b.rn THEN b.rn - 1 ELSE b.rn END AS place FROM r a JOIN r b ON a.mule_ring_id = b.mule_ring_id AND a.txn_id <> b.txn_id WHERE a.score >= {CUT})
SELECT txn_id, sibling, place, score, CASE WHEN ts_s >= (SELECT max(ts_s) FROM ledger) - 600 * 86400 THEN 1 ELSE 0 END AS in_test_window FROM j WHERE place <= 40""", ("ledger",))
def join_ring_siblings(spark, sf_dir):
    """Other payments of an alert's ring, each with its score and whether it falls into the test window."""
    rows = ledger(spark, sf_dir, ["txn_id", "mule_ring_id", "ts_s", "score"])
    found = relate.siblings(rows.where(F.col("score") >= CUT), rows, "mule_ring_id", "txn_id", ["ts_s", "txn_id"])
    last = rows.agg((F.max("ts_s") - 600 * 86400).alias("edge"))
    theirs = attach_totals(rows.where("mule_ring_id <> ''"), last, []).select(
        F.col("txn_id").alias("sibling"), "score", (F.col("ts_s") >= F.col("edge")).cast("long").alias("in_test_window"))
    return found.join(theirs, "sibling", "left").select("txn_id", "sibling", "place", "score", "in_test_window")


@query("summary_corpus", """SELECT count(*) AS documents, count(quality) AS linked, avg(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS flagged_rate, count(DISTINCT source) AS sources,
 quantile_cont(length(text)::DOUBLE, 0.5) AS median_chars FROM documents LEFT JOIN labels USING (doc_id)""")
def summary_corpus(spark, sf_dir):
    """One row over all documents; the median is exact."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.length("text").cast("double").alias("chars"))
    joined = docs.join(table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic"), "doc_id", "left")
    totals = joined.agg(F.count(F.lit(1)).alias("documents"), F.count("quality").alias("linked"), F.avg(F.coalesce((F.col("toxic") == 1).cast("double"), F.lit(0.0))).alias("flagged_rate"),
                        F.count_distinct("source").alias("sources"))
    middle = exact_quantiles(joined.where("chars IS NOT NULL").select(F.lit("chars").alias("column"), "chars"), ["column"], "chars", [0.5])
    return attach_totals(totals, middle.agg(F.max("q").alias("median_chars")), [])


@query("catalogue_top_risk", """SELECT id, risk, place FROM (SELECT *, row_number() OVER (ORDER BY risk DESC, id) AS place FROM (SELECT p_partkey AS id,
 round((0.4::DOUBLE * (p_size % 5) + 0.25::DOUBLE * (p_size % 4) + 0.35::DOUBLE * (p_size % 3)) / 5, 9) AS risk FROM part)) WHERE place <= 10""")
def catalogue_top_risk(spark, sf_dir):
    return catalogue.top_risk(_parts(spark, sf_dir), "id", 10)


@query("catalogue_totals", """SELECT count(*) AS vectors, sum(CASE WHEN p_size > 25 THEN 1 ELSE 0 END)::BIGINT AS simulated,
 (SELECT count(DISTINCT v) FROM (SELECT unnest(string_split(p_name, ' ')) AS v FROM part)) AS signals FROM part""")
def catalogue_totals(spark, sf_dir):
    parts = _parts(spark, sf_dir)
    used = parts.select(F.explode("signals").alias("v")).agg(F.count_distinct("v").alias("signals"))
    return attach_totals(parts.agg(F.count(F.lit(1)).alias("vectors"), F.sum("simulated").alias("simulated")), used, [])


#: What one payment, one paid account and one message of a campaign cost its author, in hundredths, and how many of a hundred attempts convert.
_COSTS, _CONVERTS = {"payment": 150, "account": 40_000, "device": 12_000}, 35


@query("summary_campaign_profit", f"""WITH c AS (SELECT campaign_id, sum(cents) AS risk, sum(CASE WHEN score < {CUT} THEN cents ELSE 0 END) AS passed,
 count(*) * {_COSTS["payment"]} AS payment_cost, count(DISTINCT payee) * {_COSTS["account"]} AS account_cost, count(DISTINCT device_id) * {_COSTS["device"]} AS device_cost
 FROM ledger WHERE campaign_id <> '' GROUP BY 1),
t AS (SELECT *, floor(passed * {_CONVERTS} / 100.0::DOUBLE)::BIGINT AS extracted, payment_cost + account_cost + device_cost AS cost FROM c)
SELECT campaign_id, risk::BIGINT AS at_risk, floor(risk * {_CONVERTS} / 100.0::DOUBLE)::BIGINT AS converted, extracted, payment_cost, account_cost, device_cost, cost, extracted - cost AS profit,
 round((extracted - cost) / cost::DOUBLE, 6) AS roi FROM t""", ("ledger",))
def summary_campaign_profit(spark, sf_dir):
    """A campaign's books, in hundredths: value at risk, what converts, what gets past the cut, itemised cost, profit, return."""
    rows = ledger(spark, sf_dir, ["campaign_id", "payee", "device_id", "cents", "score"]).where("campaign_id <> ''")
    return catalogue.campaign_profit(rows, CUT, _COSTS, _CONVERTS)
