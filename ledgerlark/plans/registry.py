"""Where queries are declared, each next to the ANSI SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import CAPTURE_COLUMNS, EVENT_COLUMNS, LEDGER_COLUMNS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

_CHECKER_WORDS = {
    "ledger": {"epoch": "CAST(epoch(l_shipdate) AS BIGINT)"},
    "events": {"epoch": "CAST(floor(epoch(ts)) AS BIGINT)", "props_k": "json_extract_string(props, '$.k')"},
}


def _cte(columns: dict[str, str], words: dict[str, str], source: str) -> str:
    lines = []
    for name, text in columns.items():
        for word, spelled in words.items():
            text = text.replace("{" + word + "}", spelled)
        lines.append(f"  {text} AS {name}")
    return "SELECT\n" + ",\n".join(lines) + f"\nFROM {source}"


#: The payment views, rebuilt from the given tables.
VIEWS = {
    "ledger": _cte(LEDGER_COLUMNS, _CHECKER_WORDS["ledger"], "lineitem JOIN orders ON l_orderkey = o_orderkey"),
    "captures": _cte(CAPTURE_COLUMNS, _CHECKER_WORDS["ledger"], "lineitem"),
    "payments": _cte(EVENT_COLUMNS, _CHECKER_WORDS["events"], "events"),
}


def _expand_rounding(sql: str) -> str:
    """Spell ``R(x, n)`` as half-even rounding of the scaled double."""
    while (at := sql.find("R(")) >= 0 and not sql[at - 1].isalnum():
        depth, end, comma = 0, at + 1, at
        while True:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            if sql[end] == "," and depth == 1:
                comma = end
            if depth == 0:
                break
            end += 1
        scale = f"1e{int(sql[comma + 1:end])}::DOUBLE"
        sql = f"{sql[:at]}(round_even(({sql[at + 2:comma]})::DOUBLE * {scale}, 0) / {scale}){sql[end + 1:]}"
    return sql


def query(name: str, sql: str | None = None, views: tuple[str, ...] = ()):
    """Register ``fn(spark, sf_dir)``; ``sql`` may start from the named views."""

    def keep(fn):
        QUERIES[name] = fn
        if sql is not None:
            head = ",\n".join(f"{v} AS (\n{VIEWS[v]}\n)" for v in views)
            body = _expand_rounding(sql.strip())
            if not head:
                ORACLES[name] = body
            elif body.lower().startswith("with "):
                ORACLES[name] = f"WITH {head},\n{body[5:]}"
            else:
                ORACLES[name] = f"WITH {head}\n{body}"
        return fn

    return keep
