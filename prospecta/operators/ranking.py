"""Global positions and running totals that never pass through one task.

A window without ``PARTITION BY`` moves every row to a single task. Here the rows are range
partitioned, each partition is numbered on its own, and the partition offsets (one row per
partition) are added. The range-partitioned rows are written out first: the offsets and the rows
must come from the same partitioning, also when an executor is lost in between.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from prospecta.session import materialise

_SLOT_BITS = 33  # monotonically_increasing_id keeps the row number of a partition in its low 33 bits


def with_positions(df: DataFrame, order_by: Sequence[Column], name: str = "position") -> DataFrame:
    """Exact 1-based global row numbers. ``order_by`` must be a total order."""
    ordered = (
        df.repartitionByRange(*order_by)
        .sortWithinPartitions(*order_by)
        .select(
            "*",
            F.spark_partition_id().alias("_part"),
            F.monotonically_increasing_id().bitwiseAND(F.lit((1 << _SLOT_BITS) - 1)).alias("_slot"),
        )
    )
    saved = materialise(ordered)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        saved.groupBy("_part").agg(F.count("*").alias("_rows"))
        .select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"))
    )
    # One row per partition, so the broadcast is bounded by the number of tasks.
    return (
        saved.join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_offset") + F.col("_slot") + 1)
        .drop("_part", "_slot", "_offset")
    )


def running_totals(
    df: DataFrame,
    order_by: Sequence[Column],
    values: dict[str, str],
    by: Sequence[str] = (),
    bounded: bool = False,
) -> DataFrame:
    """Inclusive running sums of ``values`` (output name -> input column) per ``by`` group.

    ``order_by`` must be unique within a group. ``bounded`` says that every group is known to be
    small, so that a plain window does.
    """
    if bounded:
        window = Window.partitionBy(*by).orderBy(*order_by).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumns({out: F.sum(col).over(window) for out, col in values.items()})

    keys = [*by, "_part"]
    ranged = df.repartitionByRange(*[F.col(name) for name in by], *order_by)
    saved = materialise(ranged.withColumn("_part", F.spark_partition_id()))
    sizes = saved.groupBy(*keys).agg(*[F.sum(col).alias(f"_sum_{out}") for out, col in values.items()])
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        *keys,
        *[F.coalesce(F.sum(f"_sum_{out}").over(before), F.lit(0)).alias(f"_before_{out}") for out in values],
    )
    local = Window.partitionBy(*keys).orderBy(*order_by).rowsBetween(Window.unboundedPreceding, 0)
    totals = saved.withColumns({out: F.sum(col).over(local) for out, col in values.items()})
    # Without groups there is one offset row per partition; with groups Spark picks the join.
    joined = totals.join(offsets if by else F.broadcast(offsets), keys)
    return joined.withColumns(
        {out: F.col(out) + F.col(f"_before_{out}") for out in values}
    ).drop("_part", *[f"_before_{out}" for out in values])
