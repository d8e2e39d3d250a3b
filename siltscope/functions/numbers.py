"""Rounding, clamping, severity weights, grade ladders and date helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def js_round(col: Column | str, digits: int = 0) -> Column:
    """Half-up towards +infinity, as ``floor(x + 0.5)``; Spark's round() goes away from zero."""
    c = _c(col).cast("double")
    if digits == 0:
        return F.floor(c + F.lit(0.5))
    scale = float(10**digits)
    return F.floor(c * F.lit(scale) + F.lit(0.5)) / F.lit(scale)


def clamp(col: Column | str, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), _c(col)))


# fixed values: points per finding, by use
SEVERITY_WEIGHTS = {
    "file_risk": {"critical": 30.0, "high": 15.0, "medium": 5.0, "low": 1.0},
    "static": {"critical": 8.0, "high": 4.0, "medium": 2.0, "low": 0.5},
    "verify": {"critical": 10.0, "high": 5.0, "medium": 2.0, "low": 1.0},
    "impact": {"critical": 4.0, "high": 2.5, "medium": 1.0, "low": 0.25},
    "quality_profile": {"BLOCKER": 0.95, "CRITICAL": 0.85, "MAJOR": 0.7, "MINOR": 0.5, "INFO": 0.25},
    "fix_hours": {"critical": 4.0, "high": 2.0, "medium": 0.5, "low": 0.1},
}

SEVERITY_RANK = {"critical": 0, "high": 1, "medium": 2, "low": 3, "info": 4}


def severity_weight(col: Column | str, table: str, default: float = 0.0) -> Column:
    out = None
    for name, value in SEVERITY_WEIGHTS[table].items():
        out = F.when(_c(col) == name, value) if out is None else out.when(_c(col) == name, value)
    return out.otherwise(F.lit(default))


# fixed values: lower bounds of the grades
GRADE_LADDERS = {
    "trust": ((95, "A+"), (85, "A"), (70, "B"), (55, "C"), (40, "D"), (None, "F")),
    "submission": ((90, "A"), (80, "B"), (70, "C"), (60, "D"), (None, "F")),
    "private": ((80, "B+"), (60, "C"), (40, "D"), (None, "F")),
    "band": ((80, "bright-green"), (60, "green"), (40, "yellow"), (20, "orange"), (None, "red")),
}


def grade(col: Column | str, ladder: str) -> Column:
    steps = GRADE_LADDERS[ladder]
    out = None
    for bound, name in steps[:-1]:
        cond = _c(col) >= bound
        out = F.when(cond, name) if out is None else out.when(cond, name)
    return out.otherwise(F.lit(steps[-1][1]))


def utc_day(ts: Column | str) -> Column:
    return F.to_date(_c(ts))


def months_since(ts: Column | str, as_of: Column) -> Column:
    """Whole 30-day months between ``ts`` and ``as_of``."""
    return F.floor((F.unix_timestamp(as_of) - F.unix_timestamp(_c(ts))) / (30 * 24 * 3600)).cast("int")


def month_start(as_of: Column) -> Column:
    return F.date_trunc("month", as_of)
