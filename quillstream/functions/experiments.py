"""Deterministic assignment of users to experiments, and the decision to roll out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _hash(seed: Column) -> Column:
    return F.conv(F.substring(F.sha2(seed, 256), 1, 8), 16, 10).cast("long")


def bucket(experiment: str, user: Column, groups: list[str]) -> Column:
    """One of ``groups`` (two at least) by the hash of ``experiment:user``."""
    if len(groups) < 2:
        raise ValueError("an experiment needs two groups")
    n = (_hash(F.concat(F.lit(f"{experiment}:"), user)) % len(groups) + 1).cast("int")
    return F.element_at(F.array(*map(F.lit, groups)), n)


def canary_percentile(experiment: str, user: Column) -> Column:
    """0 to 99.99: users below the canary's share of traffic belong to it."""
    return (_hash(F.concat(F.lit(f"{experiment}:canary:"), user)) % 10000) / 100.0


def decide(control, canary, n_control, n_canary, violated, percent, least: int = 200, better: float = 0.05) -> Column:
    """rollback, hold, expand or complete; the first rule that applies decides."""
    change = F.try_divide(canary - control, control)
    return (
        F.when(violated, "rollback").when((n_control < least) | (n_canary < least), "hold").when(control == 0, "hold")
        .when(change >= better, F.when(percent >= 50, "complete").otherwise("expand")).when(change < -0.05, "rollback").otherwise("hold")
    )


def next_percent(action: Column, percent: Column) -> Column:
    return F.when(action == "rollback", 0.0).when(action == "expand", F.least(percent * 2, F.lit(50.0))).when(action == "complete", 100.0).otherwise(percent)
