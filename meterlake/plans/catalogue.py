"""Every registered query of the library and the SQL that says what it must return."""

from . import activity, alerting, analysis, batches, costs, details, extras, history, joined, records, searching, sessions, threads, windows  # noqa: F401
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
