"""Number rules shared by all operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def half_even(value: Column, digits: int = 0) -> Column:
    """Round half to even."""
    return F.bround(value, digits)


def clamp(value: Column, low: float | Column, high: float | Column) -> Column:
    low = low if isinstance(low, Column) else F.lit(float(low))
    high = high if isinstance(high, Column) else F.lit(float(high))
    return F.least(F.greatest(value, low), high)


def truncate_u8(value: Column) -> Column:
    """Clip to [0, 255] and drop the fraction."""
    return F.floor(clamp(value, 0.0, 255.0)).cast("int")


def rint_u8(value: Column) -> Column:
    """Clip to [0, 255] after rounding half to even."""
    return clamp(F.rint(value), 0.0, 255.0).cast("int")


def safe_ratio(part: Column, whole: Column) -> Column:
    """``part / whole`` where ``whole`` is positive, else 0."""
    return F.when(whole > 0, part / F.when(whole > 0, whole)).otherwise(F.lit(0.0))


def parse_rate(rate: Column) -> Column:
    """Frame rate text ``"n/d"`` as a double; 0.0 for bad text or a zero denominator."""
    parts = F.split(rate, "/", 2)
    number = lambda i: F.get(parts, F.lit(i)).try_cast("double")
    return F.coalesce(F.try_divide(number(0), number(1)), F.lit(0.0))


def required(broken: Column) -> Column:
    """A rule on facts that must be known: it counts as broken where they are null."""
    return F.coalesce(broken, F.lit(True))


def violations(**rules: Column) -> Column:
    """Names of the rules whose condition is true, in the order given."""
    return F.array_compact(
        F.array(*[F.when(broken, F.lit(name)) for name, broken in rules.items()])
    )


def first_reason(**rules: Column) -> Column:
    """Name of the first rule whose condition is true, else null."""
    return F.coalesce(*[F.when(broken, F.lit(name)) for name, broken in rules.items()])


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are worked out once per row, however often they are used.

    A plain projection may be merged with what reads it, which repeats costly expressions;
    a generator of one row is not.
    """
    made = F.struct(*[c.alias(name) for name, c in columns.items()])
    return df.select("*", F.inline(F.array(made)))
