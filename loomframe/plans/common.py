"""Helpers of the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def six(df: DataFrame, *names: str) -> DataFrame:
    """Round to six places by scaling, the rule the cross-check engine uses too."""
    return df.withColumns({n: F.round(F.col(n) * 1e6) / 1e6 + F.lit(0.0) for n in names})


def micros(df: DataFrame, *names: str) -> DataFrame:
    """Timestamps as epoch microseconds."""
    return df.withColumns({n: F.unix_micros(F.col(n).cast("timestamp")) for n in names})
