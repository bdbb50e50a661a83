"""Running sums over groups of any size: no group is ever in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running_sum(df: DataFrame, group: list[str], bucket: str, order: list[Column], value: str, out: str) -> DataFrame:
    """Running sum of ``value`` in the order of ``bucket`` (rising with the order), then ``order``, within ``group``."""
    return running_sums(df, group, bucket, order, {out: value})


def running_sums(df: DataFrame, group: list[str], bucket: str, order: list[Column], values: dict[str, str]) -> DataFrame:
    """Running sums (new column: summed column) in one order, with one shuffle for all of them.

    Sums of the buckets are added up first, so a task holds one bucket only; the caller chooses buckets of
    bounded size. Null values add nothing.
    """
    sums = df.groupBy(*group, bucket).agg(*(F.sum(v).alias(f"__n_{out}") for out, v in values.items()))
    before = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*group, bucket, *(F.coalesce(F.sum(f"__n_{out}").over(before), F.lit(0)).alias(f"__start_{out}") for out in values))
    inside = Window.partitionBy(*group, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    run = df.join(starts, [*group, bucket])
    return run.withColumns({out: F.col(f"__start_{out}") + F.sum(v).over(inside) for out, v in values.items()}).drop(*(f"__start_{out}" for out in values))
