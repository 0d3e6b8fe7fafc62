"""One-row reports put together."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def side_by_side(left: DataFrame, *others: DataFrame) -> DataFrame:
    """Columns of one-row tables attached to every row of ``left``.

    Each is a scalar subquery: no join is planned, an absent row gives nulls and a second
    row is an error.
    """
    joined = left
    for number, other in enumerate(others):
        held = f"_row{number}"
        row = other.select(F.struct(*other.columns).alias(held)).scalar()
        joined = joined.withColumn(held, row)
    return joined.select(*left.columns, *(F.col(f"_row{i}.*") for i in range(len(others))))
