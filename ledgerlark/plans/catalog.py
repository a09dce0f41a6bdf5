"""All registered queries."""

from . import audits, captures, catalogues, evaluation, graphs, jobs, relations, scoring, sinks, streams, summaries, windows  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
