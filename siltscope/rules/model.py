"""The rule record and its compilation to Spark conditions."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltscope.functions import text as tx

#: Rules compiled into one expression; a longer table is matched in batches of so many.
BATCH = 200


@dataclass(frozen=True)
class Rule:
    """One line rule.

    ``pattern``       must be found in the line
    ``also``          patterns that must be found as well
    ``unless``        patterns that must not be found
    ``unless_text``   literals that must not occur in the line
    ``last_tail``     what follows the last occurrence of ``pattern`` must not match this
    ``needles``       literals of which one must occur (cheap pre-test before any regex)
    ``folded``        lower-case literals of which one must occur in the lower-cased text (the same for patterns without case)
    ``at_least``      bytes that every text with a match has
    ``start``         Java pattern of the places where a match can start, to be put before ``pattern``; leaves out none
    ``search``        Java pattern that finds the same matches faster than ``start`` and ``pattern``
    ``path_unless``   literals in the path that exempt the file
    """

    name: str
    severity: str
    pattern: str
    category: str = ""
    confidence: float = 1.0
    also: tuple[str, ...] = ()
    unless: tuple[str, ...] = ()
    unless_text: tuple[str, ...] = ()
    last_tail: str | None = None
    needles: tuple[str, ...] = ()
    folded: tuple[str, ...] = ()
    at_least: int = 0
    start: str = ""
    search: str = ""
    path_unless: tuple[str, ...] = ()
    trimmed: bool = False
    message: str = ""
    params: dict = field(default_factory=dict, compare=False, hash=False)

    @property
    def in_files(self) -> str:
        """The pattern by which whole files are searched."""
        return self.search or self.start + self.pattern

    def condition(self, text: Column, path: Column | None = None) -> Column:
        t = tx.strip(text) if self.trimmed else text
        cond = None
        if self.needles:
            cond = tx.has(text, *self.needles)
        cond = tx.rx(t, self.pattern) if cond is None else cond & tx.rx(t, self.pattern)
        for p in self.also:
            cond = cond & tx.rx(t, p)
        for p in self.unless:
            cond = cond & ~tx.rx(t, p)
        if self.unless_text:
            cond = cond & ~tx.has(text, *self.unless_text)
        if self.last_tail:
            tail = F.regexp_extract(t, tx.java("^.*" + self.pattern + "(.*)$"), 1)
            cond = cond & ~tx.rx(tail, self.last_tail)
        if self.path_unless and path is not None:
            cond = cond & ~tx.has(path, *self.path_unless)
        return cond


def rules_from_df(df: DataFrame) -> list[Rule]:
    """User rule table -> rules.

    Needs columns name, severity, pattern; optional category, confidence, path_exclude.
    A rule is code, so the table is read by the driver; it may have any length.
    """
    rows = df.collect()
    out = []
    for r in rows:
        d = r.asDict()
        if not d.get("name") or not d.get("pattern"):
            raise ValueError("every rule needs a name and a pattern")
        try:
            re.compile(tx.re2(d["pattern"]))
        except re.error as e:
            raise ValueError(f"rule {d['name']}: bad pattern: {e}") from e
        out.append(
            Rule(
                name=d["name"],
                severity=d.get("severity") or "medium",
                pattern=d["pattern"],
                category=d.get("category") or "",
                confidence=float(d["confidence"]) if d.get("confidence") is not None else 1.0,
                path_unless=(d["path_exclude"],) if d.get("path_exclude") else (),
            )
        )
    return out
