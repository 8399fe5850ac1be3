"""Decimal rounding and number formatting that agree with IEEE-exact tools.

Spark's `round` and `bround` look at the shortest decimal text of a double, so 2.675
counts as a tie although the stored number is below it. The formulas here round the
stored binary value, exact ties to even, with plain double arithmetic that stays in
whole-stage codegen. Inputs and results are SQL text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame


def round_exact(x: str, digits: int) -> str:
    """Round a double to `digits` decimals by its exact binary value, ties to even."""
    scale = f"{10**digits}.0D"
    scaled = f"({x} * {scale})"
    # Exact error of the product: split x into two halves whose products with the
    # (short) scale are exact.
    spread = f"({x} * 134217729.0D)"
    high = f"({spread} - ({spread} - {x}))"
    error = f"(({high} * {scale} - {scaled}) + ({x} - {high}) * {scale})"
    base = f"floor({scaled})"
    side = f"(({scaled} - {base} - 0.5D) + {error})"
    return (f"((CASE WHEN {side} > 0 THEN {base} + 1 WHEN {side} < 0 THEN {base} "
            f"WHEN {base} % 2 = 0 THEN {base} ELSE {base} + 1 END) / {scale})")


def round_columns(df: DataFrame, digits: dict[str, int]) -> DataFrame:
    """Round several columns of a frame, each to its own number of decimals."""
    return df.selectExpr(*[
        f"{round_exact(c, digits[c])} AS {c}" if c in digits else c for c in df.columns])


def fixed(x: str, digits: int) -> str:
    """Text of a non-negative number with a fixed number of decimals; NULL stays NULL."""
    return (f"CASE WHEN {x} IS NOT NULL THEN "
            f"format_string('%.{digits}f', {round_exact(x, digits)}) END")


def _is_negative(x: str) -> str:
    return f"startswith(CAST({x} AS STRING), '-')"


def signed(x: str, digits: int) -> str:
    """Text with a leading + or -; the sign of a negative zero is kept."""
    return (f"concat(CASE WHEN {_is_negative(x)} THEN '-' ELSE '+' END, "
            f"{fixed(f'abs({x})', digits)})")


def percent(x: str, digits: int) -> str:
    return f"concat({fixed(f'({x} * 100)', digits)}, '%')"


def signed_percent(x: str, digits: int) -> str:
    return f"concat({signed(f'({x} * 100)', digits)}, '%')"


def format_percent(x: str, digits: int = 1) -> str:
    """Display form of a ratio; NULL shows as a dash."""
    return (f"coalesce(concat(CASE WHEN {_is_negative(x)} THEN '-' ELSE '' END, "
            f"{fixed(f'abs({x} * 100)', digits)}, '%'), '—')")


def format_stars(x: str, digits: int = 2) -> str:
    """Display form of a rating change; NULL shows as a dash."""
    return f"coalesce(concat({signed(x, digits)}, '★'), '—')"
