"""Dense numbering, running totals and carried values over data too large for one window task.

The operators range-partition on the order, keep the partition number in a stored table,
work inside each range, and correct the ranges with a table that has one row
per range (and group that crosses it).  No task sees more than one range.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cloakframe.session import materialise

PART = "range_part"


def _ranged(df: DataFrame, order: list[str]) -> DataFrame:
    return materialise(df.repartitionByRange(*order).withColumn(PART, F.spark_partition_id()))


def running(df: DataFrame, keys: list[str], order: list[str], sums: dict[str, str], maxima: dict[str, str]) -> DataFrame:
    """Add running sums and maxima within ``keys`` by ``order``, the current row included.

    ``sums`` and ``maxima`` map a new column to the column it accumulates.
    """
    ranged = _ranged(df, keys + order)
    totals = ranged.groupBy(PART, *keys).agg(
        *[F.sum(col).alias(name) for name, col in sums.items()],
        *[F.max(col).alias(name) for name, col in maxima.items()],
    )
    earlier = Window.partitionBy(*keys).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    # Only a group that began in an earlier range has something to add: one row per range at most.
    offsets = (
        totals.select(
            PART,
            *keys,
            F.lag(PART).over(Window.partitionBy(*keys).orderBy(PART)).alias("prior"),
            *[F.sum(name).over(earlier).alias(f"before_{name}") for name in sums],
            *[F.max(name).over(earlier).alias(f"before_{name}") for name in maxima],
        )
        .where("prior IS NOT NULL")
        .drop("prior")
    )
    here = Window.partitionBy(PART, *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = ranged.select(
        "*",
        *[F.sum(col).over(here).alias(name) for name, col in sums.items()],
        *[F.max(col).over(here).alias(name) for name, col in maxima.items()],
    )
    joined = local.join(F.broadcast(offsets), [PART, *keys], "left")
    for name in sums:
        joined = joined.withColumn(name, F.col(name) + F.coalesce(f"before_{name}", F.lit(0)))
    for name in maxima:
        joined = joined.withColumn(name, F.greatest(name, f"before_{name}"))
    return joined.drop(PART, *[f"before_{name}" for name in [*sums, *maxima]])


def number_rows(df: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """Add ``name``: 1, 2, ... within ``keys`` by ``order``, as one window would number them."""
    return running(df.withColumn("one", F.lit(1)), keys, order, {name: "one"}, {}).drop("one")


def carry_last(df: DataFrame, order: list[str], value: str, name: str) -> DataFrame:
    """Add ``name``: the latest non-null ``value`` among strictly earlier rows."""
    ranged = _ranged(df, order)
    place = F.struct(*[F.col(c) for c in order])
    ends = ranged.groupBy(PART).agg(F.max_by(value, F.when(F.col(value).isNotNull(), place)).alias("range_end"))
    before = Window.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    carried = ends.select(PART, F.last("range_end", ignorenulls=True).over(before).alias("carried"))
    here = Window.partitionBy(PART).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = ranged.withColumn(name, F.last(value, ignorenulls=True).over(here))
    return (
        local.join(F.broadcast(carried), PART, "left")
        .withColumn(name, F.coalesce(name, "carried"))
        .drop(PART, "carried")
    )
