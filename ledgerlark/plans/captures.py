"""Queries over biometric captures."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..operators import media, relate
from ..sources.tables import captures
from .registry import query

_COLUMNS = [*media.SCORES, *media.DIFFERENCES]
_TAILS = " ".join(f"- ln(2.0::DOUBLE * greatest(least(p_{c}, 1.0::DOUBLE - p_{c}), {media.EDGE}::DOUBLE))" for c in _COLUMNS)


def _place(c: str) -> str:
    """Where a value lies in its grid ``g_c`` of ``m + 1`` numbers: the mean of the place behind its last equal and before its first."""
    at, below = f"len(list_filter(g_{c}, lambda x: x <= {c}))", f"len(list_filter(g_{c}, lambda x: x < {c}))"
    upper = f"CASE WHEN {at} = 0 THEN 0.0::DOUBLE WHEN {at} > m THEN 1.0::DOUBLE ELSE ({at} - 1) / m + ({c} - g_{c}[{at}]) / (g_{c}[{at} + 1] - g_{c}[{at}]) / m END"
    lower = f"CASE WHEN {below} = 0 THEN 0.0::DOUBLE WHEN {below} > m THEN 1.0::DOUBLE ELSE {below} / m - (g_{c}[{below} + 1] - {c}) / (g_{c}[{below} + 1] - g_{c}[{below}]) / m END"
    return f"0.5::DOUBLE * (({upper}) + ({lower})) AS p_{c}"


_MEDIA = f"""WITH edge AS (SELECT max(ts_s) - 600 * 86400 AS late_from FROM captures),
x AS (SELECT captures.*, ts_s >= late_from AS late, greatest({", ".join(media.SCORES)}) > 0 AS any_capture, {", ".join(f"{a} - {b} AS {n}" for n, (a, b) in media.DIFFERENCES.items())} FROM captures, edge),
genuine AS (SELECT * FROM x WHERE is_fraud = 0 AND any_capture AND NOT late),
size AS (SELECT count(*) AS k, (least({media.QUANTILES}, count(*)) - 1)::DOUBLE AS m FROM genuine),
probs AS (SELECT m, list_transform(range(0, m::BIGINT + 1), lambda i: i / m) AS ps FROM size),
grid AS (SELECT max(m) AS m, {", ".join(f"list(q_{c} ORDER BY i) AS g_{c}" for c in _COLUMNS)} FROM (SELECT m, i, {", ".join(f"v_{c}[lo + 1] + (v_{c}[least(lo + 2, k)] - v_{c}[lo + 1]) * (pos - lo) AS q_{c}" for c in _COLUMNS)} FROM
 (SELECT m, i, (i / m) * (k - 1) AS pos, floor((i / m) * (k - 1))::BIGINT AS lo, k FROM size, unnest(range(0, 1000)) u(i) WHERE i <= m), (SELECT {", ".join(f"list({c} ORDER BY {c}) AS v_{c}" for c in _COLUMNS)} FROM genuine)) GROUP BY ()),
placed AS (SELECT x.*, {", ".join(_place(c) for c in _COLUMNS)} FROM x, grid),
far AS (SELECT *, 0.0::DOUBLE {_TAILS} AS tail FROM placed),
scored AS (SELECT *, CASE WHEN any_capture THEN round(tail / (tail + {media.HALF}::DOUBLE), 5) ELSE 0.0::DOUBLE END AS s FROM far),
cut AS (SELECT s AS cut FROM (SELECT s, row_number() OVER (ORDER BY s DESC) AS r FROM scored WHERE is_fraud = 0 AND any_capture AND NOT late), size WHERE r = floor({media.FLAGGED}::DOUBLE * k) + 1),
flagged AS (SELECT scored.*, cut, CASE WHEN any_capture AND s > cut THEN 1 ELSE 0 END AS flag FROM scored, cut)"""


def _windows(spark, sf_dir):
    rows = relate.temporal_split(captures(spark, sf_dir), test_days=600, calibration_days=0)
    return rows.where("split <> 'test'").drop("split"), rows.where("split = 'test'").drop("split")


@query("media_artefact_scores", _MEDIA + " SELECT txn_id, s AS media_artefact_score, flag AS media_artefact_flag FROM flagged", ("captures",))
def media_artefact_scores(spark, sf_dir):
    """Every payment's score; fitted on genuine captures before the test window."""
    guard = media.MediaGuard().fit(_windows(spark, sf_dir)[0])
    return guard.transform(captures(spark, sf_dir)).select("txn_id", "media_artefact_score", "media_artefact_flag")


@query("media_guard_report", _MEDIA + """,
w AS (SELECT count(*) AS rows, count(*) FILTER (any_capture) AS captured FROM flagged WHERE late),
f AS (SELECT attack_vector_id AS vector, flag, cut FROM flagged WHERE late AND is_fraud = 1 AND any_capture UNION ALL SELECT '*', flag, cut FROM flagged WHERE late AND is_fraud = 1 AND any_capture)
SELECT vector, count(*) AS frauds, sum(flag) AS flagged, sum(flag) / count(*) AS recall, max(rows) AS rows, max(captured) AS captured, max(captured) / max(rows) AS coverage, max(cut) AS cut, (SELECT k FROM size) AS fitted_on FROM f, w GROUP BY vector""", ("captures",))
def media_guard_report(spark, sf_dir):
    """Coverage of the test window, and recall over all fraud captures and by vector."""
    early, late = _windows(spark, sf_dir)
    return media.MediaGuard().fit(early).report(late)


_PROBIT = re.sub(r"(\d)D\b", r"\1::DOUBLE", media.probit_text("p"))


@query("media_probit_map", _MEDIA + f""",
long AS ({" UNION ALL ".join(f"SELECT txn_id, any_capture, '{c}' AS col, greatest(least(p_{c}, 1.0::DOUBLE - {media.EDGE}::DOUBLE), {media.EDGE}::DOUBLE) AS p FROM placed" for c in _COLUMNS)})
SELECT txn_id, col AS "column", round({_PROBIT}, 6) AS z FROM long WHERE any_capture""", ("captures",))
def media_probit_map(spark, sf_dir):
    """The mapped columns of every capture, one row a column."""
    guard = media.MediaGuard().fit(_windows(spark, sf_dir)[0])
    mapped = guard.mapped(captures(spark, sf_dir).where(media.captured()))
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.round(f"z_{c}", 6).alias("z")) for c in guard.columns]))
    return mapped.select("txn_id", pairs.alias("_p")).select("txn_id", "_p.column", "_p.z")
