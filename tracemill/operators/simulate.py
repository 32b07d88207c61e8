"""Seeded faults and outcomes as columns, the same however rows are partitioned."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Probabilities of faults, in the order in which they are drawn.
FAULTS = {"timeout": 0.10, "rate_limit": 0.08, "network_error": 0.05, "malformed_schema": 0.06, "schema_drift": 0.04}


def fault(pick: Column, probabilities: dict[str, float] = FAULTS) -> Column:
    """The first fault whose cumulative probability reaches the pick; null: none. Sums of 1 or more are scaled to 1."""
    total = sum(probabilities.values())
    scale, upto, out = (1 / total if total >= 1 else 1.0), 0.0, F.lit(None).cast("string")
    steps = []
    for name, p in probabilities.items():
        upto += max(0.0, p) * scale
        steps.append((name, upto))
    for name, edge in reversed(steps):
        out = F.when(pick <= edge, name).otherwise(out)
    return out


def latency(base: Column, kind: Column) -> Column:
    """Rate limits answer after a third of the time (5 ms at least), lost connections after half of it (8 at least)."""
    third, half = (base / 3).cast("long"), (base / 2).cast("long")
    return F.when(kind == "rate_limit", F.greatest(F.lit(5), third)).when(kind == "network_error", F.greatest(F.lit(8), half)).otherwise(F.greatest(F.lit(1), base))


def backoff(attempt: Column, base_ms: int, jitter_ms: Column) -> Column:
    """base * 2^(attempt - 1) + jitter; nothing before the first attempt."""
    return F.when(attempt <= 1, F.lit(0)).otherwise(F.lit(base_ms) * F.pow(F.lit(2.0), attempt - 2).cast("long") + jitter_ms)
