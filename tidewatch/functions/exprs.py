"""Helpers for operators written as SQL text.

Long formulas are passed to Spark as text: one call to the JVM per step instead of one
per operator of the formula.
"""

from __future__ import annotations

from pyspark.sql import DataFrame


def add(df: DataFrame, **formulas: str) -> DataFrame:
    """Append computed columns; formulas of one call do not see each other."""
    return df.selectExpr("*", *[f"({text}) AS {name}" for name, text in formulas.items()])


def pick(df: DataFrame, *plain: str, **formulas: str) -> DataFrame:
    """Plain columns followed by computed ones."""
    return df.selectExpr(*plain, *[f"({text}) AS {name}" for name, text in formulas.items()])


def sql(text: str, **frames: DataFrame) -> DataFrame:
    """A query over frames named in braces."""
    return next(iter(frames.values())).sparkSession.sql(text, **frames)


def ratio(a: str, b: str) -> str:
    """a / b, NULL for b = 0."""
    return f"(({a}) / nullif({b}, 0.0D))"


def quoted(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def array_of(texts) -> str:
    return "array(" + ", ".join(quoted(t) for t in texts) + ")"
