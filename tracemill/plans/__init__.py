"""All queries by name, with their SQL."""

from . import audits, cases, choices, comparisons, documents, evidence, ledgers, monitors, packets, reviewing, selections, texts, traces, training, trails
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
