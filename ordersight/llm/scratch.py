"""Removal of written intermediates that are no longer read, and names for private columns."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ordersight.session import release

__all__ = ["release", "unused"]


def unused(df: DataFrame, name: str) -> str:
    """A column name made of ``name`` that ``df`` does not have."""
    taken = {column.lower() for column in df.columns}
    while name.lower() in taken or f"{name}_".lower() in taken:
        name = f"_{name}"
    return name
