"""Rules on records: a registry of named checks that trap their own errors.

A rule is a Column that says whether a record passes, and one that says what is wrong.  It is
written with ``try_*`` functions, so that what can't be evaluated is null; that is a violation
of this rule alone, and the others go on.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PHASES = ("precondition", "postcondition", "result")


@dataclass(frozen=True)
class Rule:
    """``passed`` and ``message`` may use the record's columns, and those of ``context`` as
    fields of the map column ``context``; ``tools`` empty: all tools."""

    name: str
    passed: Column
    message: Column
    phase: str = "result"
    tools: tuple[str, ...] = ()
    context: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        if self.phase not in PHASES:
            raise ValueError(f"phase of rule {self.name} must be one of {PHASES}, not {self.phase}")


@dataclass
class RuleSet:
    """Rules in the order in which they were added."""

    rules: list[Rule] = field(default_factory=list)

    def add_rule(self, rule: Rule) -> RuleSet:
        if any(r.name == rule.name for r in self.rules):
            raise ValueError(f"rule {rule.name} exists already")
        self.rules.append(rule)
        return self

    def of(self, phase: str) -> list[Rule]:
        return [r for r in self.rules if r.phase == phase]

    def violations(self, phase: str, tool: Column) -> Column:
        """array<struct<rule, message>> of the record's violations, in the rules' order."""
        found = []
        for r in self.of(phase):
            failed = F.struct(F.lit(r.name).alias("rule"), F.concat(F.lit(f"Rule {r.name} failed: "), F.lit("not evaluated")).alias("message"))
            wrong = F.struct(F.lit(r.name).alias("rule"), F.coalesce(r.message, F.lit(r.name)).alias("message"))
            verdict = F.when(r.passed.isNull(), failed).when(~r.passed, wrong)
            found.append(F.when(tool.isin(*r.tools), verdict) if r.tools else verdict)
        if not found:
            return F.array().cast("array<struct<rule:string,message:string>>")
        return F.filter(F.array(*found), lambda v: v.isNotNull())

    def check(self, records: DataFrame, keep: Sequence[str], phase: str = "result", tool: str = "tool") -> DataFrame:
        """``keep`` columns, rule and message, a row for each violation, with its position."""
        found = records.select(*keep, F.posexplode(self.violations(phase, F.col(tool))).alias("position", "v"))
        return found.select(*keep, "position", "v.rule", "v.message")


def only_context(context: Column, keys: Iterable[str]) -> Column:
    """The entries of a context that a rule asks for; others are not seen by it."""
    wanted = F.array(*[F.lit(k) for k in keys]) if keys else F.array().cast("array<string>")
    return F.map_filter(context, lambda k, _: F.array_contains(wanted, k))
