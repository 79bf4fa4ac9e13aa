"""Places of rows in a sorted order, in two passes over range partitions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Bits of ``monotonically_increasing_id`` below the number of the partition.
LOCAL = 33


def numbered(rows: DataFrame, by: Sequence[str], order: Sequence[str | Column], name: str = "place") -> DataFrame:
    """``rows`` with their place from 0 inside each group ``by``, in the order of ``order``.

    Rows are dealt to range partitions by group and order and sorted there. A row's place
    is its place in its partition, less that of its group's first row there, plus the
    group's rows in the partitions before: one count a partition and group, added up over
    partitions. No window runs over rows, so a hot group (or none at all) is no hot task.
    The sorted rows are checkpointed, since two samplings may cut the ranges differently:
    pass ids, not payloads. Null keys are a group; rows that tie get any order.
    """
    keys = [F.col(c) for c in by]
    order = [F.col(c) if isinstance(c, str) else c for c in order]
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    held = rows.repartitionByRange(n, *keys, *order).sortWithinPartitions(*keys, *order)
    held = held.withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_at", LOCAL)).checkpoint()
    counts = held.groupBy(*by, "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_rows"))
    earlier = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition, not a row a row
    starts = counts.select(*(F.col(c).alias(f"_key_{i}") for i, c in enumerate(by)), F.col("_part").alias("_of"), (F.coalesce(F.sum("_rows").over(earlier), F.lit(0)) - F.col("_first")).alias("_shift"))
    same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_key_{i}")) for i, c in enumerate(by)], F.col("_part") == F.col("_of"))
    return held.join(starts, same).select(*rows.columns, (F.col("_at") + F.col("_shift")).alias(name))
