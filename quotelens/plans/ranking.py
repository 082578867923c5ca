"""Dense running numbers over a whole table without a one-task window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quotelens.plans.checkpoints import written

_PART, _POS, _OFFSET = "__part", "__pos", "__offset"


def with_running_number(df: DataFrame, order: list[Column], name: str, start: int | Column = 1) -> DataFrame:
    """Add `name` = start, start+1, ... in the total order of `order` (which must be unique).

    Rows are range-partitioned and sorted once and written to the shared folder; every
    partition then only needs the number of rows before it, so no task sees more than its
    range. The written copy fixes the partition boundaries: a lost executor cannot shift
    numbers between attempts.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    position = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    ordered = (
        df.repartitionByRange(parts, *order)
        .sortWithinPartitions(*order)
        .withColumn(_PART, F.spark_partition_id())
        .withColumn(_POS, position)
    )
    fixed = written(ordered, "running-number")
    # One row per partition, so this window is bounded by the partition count.
    before = Window.orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    offsets = fixed.groupBy(_PART).count().select(
        _PART, F.coalesce(F.sum("count").over(before), F.lit(0)).alias(_OFFSET)
    )
    first = start if isinstance(start, Column) else F.lit(start)
    return (
        fixed.join(F.broadcast(offsets), _PART)
        .withColumn(name, (first + F.col(_OFFSET) + F.col(_POS)).cast("bigint"))
        .drop(_PART, _POS, _OFFSET)
    )


def first_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Keep the first row of every key in `order`.

    An aggregate instead of row_number(): map tasks reduce a hot key to one row each
    before the shuffle.
    """
    rest = [c for c in df.columns if c not in keys and c not in order]
    head = F.struct(*[F.col(c) for c in order], *[F.col(c) for c in rest])
    return (
        df.groupBy(*keys)
        .agg(F.min_by(head, F.struct(*order)).alias("__head"))
        .select(*keys, "__head.*")
        .select(*df.columns)
    )
