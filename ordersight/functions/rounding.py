"""Rounding of report columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TIE_OFFSET = 1e-9


def tidy(value: Column, places: int = 6) -> Column:
    """Round half up after a tiny offset, so that an exact tie does not depend on summation order."""
    return F.round(value + F.lit(TIE_OFFSET), places)


def round_doubles(df: DataFrame, places: int = 6, **by_column: int) -> DataFrame:
    """Round every double column to ``places`` (or to its own entry in ``by_column``)."""
    return df.select(
        *[
            tidy(F.col(f"`{name}`"), by_column.get(name, places)).alias(name)
            if kind in ("double", "float")
            else F.col(f"`{name}`")
            for name, kind in df.dtypes
        ]
    )
