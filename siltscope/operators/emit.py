"""Turning per-row conditions into finding rows."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def spec(cond: Column, rule: str, severity: str | Column, detail: str | Column = "", *, category: str | None = None,
         line: Column | int = 0, confidence: float = 1.0, points: float | Column = 0.0) -> tuple:
    """One conditional finding; see emit()."""
    return cond, rule, severity, detail, category or rule, line, confidence, points


def emit(df: DataFrame, specs: Iterable[tuple], keys: tuple[str, ...] = ("repo_id", "path")) -> DataFrame:
    """One row per satisfied spec and input row; all specs are evaluated in one pass over the row."""
    items = []
    for i, (cond, rule, severity, detail, category, line, confidence, points) in enumerate(specs):
        items.append(
            F.when(
                cond,
                F.struct(
                    _col(line).cast("int").alias("line"),
                    F.lit(rule).alias("rule"),
                    F.lit(category).alias("category"),
                    _col(severity).alias("severity"),
                    F.lit(float(confidence)).alias("confidence"),
                    _col(detail).cast("string").alias("detail"),
                    F.lit(i).alias("ordinal"),
                    _col(points).cast("double").alias("points"),
                ),
            )
        )
    return df.select(*keys, F.explode(F.array_compact(F.array(*items))).alias("f")).select(*keys, "f.*")


def _col(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def first_index(ls: Column, predicate) -> Column:
    """1-based index of the first element for which ``predicate`` holds, 0 when none does."""
    flags = F.transform(ls, lambda x: predicate(x))
    return F.coalesce(F.array_position(flags, F.lit(True)), F.lit(0)).cast("int")


def flag_any(cond: Column, name: str) -> Column:
    """Repository-level "some file satisfies"; partial aggregation keeps the shuffle to one row per task."""
    return F.coalesce(F.max(cond), F.lit(False)).alias(name)
