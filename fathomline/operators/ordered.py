"""Running sums over an order too long for one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running_sum(df: DataFrame, keys: list[str], order: str, value: Column, width: int, name: str) -> DataFrame:
    """Adds the sum of ``value`` over all rows of a group up to and with each row, in order of an integer column.

    The order is cut into bins of ``width``. Rows are sorted only within a bin;
    the sums of bins, one row each, are added up per group.
    """
    binned = df.withColumn("_bin", F.floor(F.col(order) / F.lit(width))).withColumn("_value", value)
    before = Window.partitionBy(*keys).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    sums = (
        binned.groupBy(*keys, "_bin")
        .agg(F.sum("_value").alias("_sum"))
        .withColumn("_before", F.coalesce(F.sum("_sum").over(before), F.lit(0)))
        .drop("_sum")
    )
    inside = Window.partitionBy(*keys, "_bin").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return (
        binned.join(sums, [*keys, "_bin"])
        .withColumn(name, F.col("_before") + F.sum("_value").over(inside))
        .drop("_bin", "_value", "_before")
    )
