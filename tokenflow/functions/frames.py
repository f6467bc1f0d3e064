"""Small frame helpers."""

from __future__ import annotations

from pyspark.sql import DataFrame


def attach_scalars(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Add the columns of a one-row aggregate to every row of ``df`` as
    scalar subqueries (no join of any kind: Spark evaluates the aggregate
    once -- ``MergeScalarSubqueries`` folds the columns into one subquery --
    and uses the values as constants)."""
    return df.select("*", *[one_row.select(c).scalar().alias(c) for c in one_row.columns])
