"""Rules as a registry: identifier, definition, predicate and switch; a rule that fails on a row costs that row this rule's evidence alone.

A predicate is a function of a case's columns and of ``attempt``, whose operations give null where Spark's own would raise
(a division by zero, a cast of a word to a number, a place outside an array) and note it. A row on which an
operation of a rule failed has no evidence of the rule but the warning ``RULE_ERROR:<id>``; all other rules go on. Everything
is one projection of the cases, whatever the number of rules.

Defined results: an operation on a null is null and no failure; a predicate that is null does not hold; rules come out
in the order of registration; without rules, evidence and warnings are empty.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspan.operators.scoring import EVIDENCE
from larkspan.plans.profile import RULES, validated


class Attempt:
    """Operations that give null instead of an error, and whether one of them did."""

    def __init__(self):
        self._failures: list[Column] = []

    def of(self, result: Column, *given: Column) -> Column:
        """Note a failure where ``result`` is null though nothing that is ``given`` is."""
        bad = result.isNull()
        for g in given:
            bad = bad & g.isNotNull()
        self._failures.append(bad)
        return result

    def divide(self, a: Column, b: Column) -> Column:
        return self.of(F.try_divide(a, b), a, b)

    def add(self, a: Column, b: Column) -> Column:
        return self.of(F.try_add(a, b), a, b)

    def multiply(self, a: Column, b: Column) -> Column:
        return self.of(F.try_multiply(a, b), a, b)

    def cast(self, a: Column, kind: str) -> Column:
        return self.of(a.try_cast(kind), a)

    def element(self, items: Column, at: Column | int) -> Column:
        """The element at a place from 0. A null in that place is no failure."""
        place = F.lit(at) if isinstance(at, int) else at
        self._failures.append(items.isNotNull() & ((place < 0) | (place >= F.size(items))))
        return F.get(items, place)

    def parse_json(self, text: Column, schema: str) -> Column:
        """The text as JSON; one that is no JSON of this kind fails."""
        self._failures.append(text.isNotNull() & F.try_parse_json(text).isNull())
        return F.from_json(text, schema)

    def url_decode(self, text: Column) -> Column:
        return self.of(F.try_url_decode(text), text)

    @property
    def failed(self) -> Column:
        out = F.lit(False)
        for f in self._failures:
            out = out | F.coalesce(f, F.lit(False))
        return out


Predicate = Callable[[Mapping[str, Column], Attempt], Column]


@dataclass(frozen=True)
class Rule:
    rule_id: str
    predicate: Predicate
    group: str
    severity: str
    base: int
    confidence: float
    subject: str = "case:0"
    enabled: bool = True


_DEFINED = {r[0]: r[1:] for r in RULES}


@dataclass
class Registry:
    """Rules in the order of their registration."""

    rules: dict[str, Rule] = field(default_factory=dict)

    def register(self, rule_id: str, definition: tuple[str, str, int, float] | None = None, subject: str = "case:0", enabled: bool = True) -> Callable[[Predicate], Predicate]:
        """Decorate a predicate. ``definition``: group, severity, base score and confidence; without it the rule must be one of the catalogue."""
        if not re.fullmatch("[A-Z][A-Z0-9_]*", rule_id):
            raise ValueError(f"{rule_id!r} is no identifier of a rule")
        if rule_id in self.rules:
            raise ValueError(f"{rule_id} is registered already")
        if definition is None and rule_id not in _DEFINED:
            raise ValueError(f"{rule_id} has no definition")
        own = definition or _DEFINED[rule_id]
        validated([(rule_id, *own)])

        def add(predicate: Predicate) -> Predicate:
            self.rules[rule_id] = Rule(rule_id, predicate, *own, subject=subject, enabled=enabled)
            return predicate

        return add

    def switched(self, enabled: Mapping[str, bool]) -> Registry:
        """The same rules, some switched on or off; unknown ones are an error."""
        if unknown := set(enabled) - set(self.rules):
            raise ValueError(f"unknown rules: {sorted(unknown)}")
        return Registry({k: replace(r, enabled=enabled.get(k, r.enabled)) for k, r in self.rules.items()})

    def run(self, cases: DataFrame, key: str = "case_id") -> DataFrame:
        """key, evidence (as the scores take it), warnings."""
        columns = {c: F.col(c) for c in cases.columns}
        evidence, warnings = [], []
        for k, rule in enumerate(r for r in self.rules.values() if r.enabled):
            attempt = Attempt()
            holds = rule.predicate(columns, attempt)
            bad = attempt.failed
            row = F.struct(
                F.lit(k).alias("ord"), F.lit(rule.rule_id).alias("rule_id"), F.lit(rule.group).alias("grp"), F.lit(rule.severity).alias("severity"), F.lit(rule.base).alias("base"),
                F.lit(float(rule.confidence)).alias("confidence"), F.lit(1.0).alias("context"), F.lit(rule.subject).alias("subject"),
            )
            evidence.append(F.when(~bad & F.coalesce(holds, F.lit(False)), row))
            warnings.append(F.when(bad, F.lit(f"RULE_ERROR:{rule.rule_id}")))
        gathered = lambda items, kind: (F.array_compact(F.array(*items)) if items else F.array()).cast(kind)
        return cases.select(key, gathered(evidence, EVIDENCE).alias("evidence"), gathered(warnings, "array<string>").alias("warnings"))
