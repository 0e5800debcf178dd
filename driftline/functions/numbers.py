"""Small numeric expressions."""

from pyspark.sql import Column, functions as F


def percent(part: Column, whole: Column) -> Column:
    """100 * part / whole, 0 where the whole is 0."""
    return F.coalesce(F.try_divide(part * F.lit(100.0), whole), F.lit(0.0))


def round_half_away(x: Column, digits: int) -> Column:
    """Scale, round ties away from zero, scale back; all in double arithmetic.

    ``F.round`` goes through a decimal for every value; this stays in generated code.
    """
    scale = F.lit(float(10**digits))
    return F.signum(x) * F.floor(F.abs(x) * scale + F.lit(0.5)).cast("double") / scale


def is_finite(x: Column) -> Column:
    """Neither null, NaN nor infinite. The expression is short, as it is copied into filters and projections:
    generated methods beyond 8,000 bytes of code are never compiled."""
    return F.coalesce(x - x == 0, F.lit(False))


def text_bar(pct: Column, cells: int = 20) -> Column:
    """Bar of ``cells`` characters, one filled cell per full share of the percentage."""
    full = F.floor(pct / F.lit(100.0 / cells)).cast("int")
    return F.concat(F.repeat(F.lit("█"), full), F.repeat(F.lit("░"), F.lit(cells) - full))
