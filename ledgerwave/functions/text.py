"""Number rendering shared by labels and findings."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def fixed(x: Column, digits: int) -> Column:
    """`x` with a fixed number of decimals, never in scientific notation."""
    return F.coalesce(
        F.round(x, digits).try_cast(f"decimal(38,{digits})").cast("string"),
        F.when(x > 0, F.lit("inf")).when(x < 0, F.lit("-inf")),
    )


def percent(x: Column, digits: int = 1) -> Column:
    return F.concat(fixed(x * 100, digits), F.lit("%"))
