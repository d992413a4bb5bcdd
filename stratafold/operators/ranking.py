"""Exact ranks within groups of any size: range partitions, places within each, and the counts of the ones before.

A window partitioned by a few groups would sort each in one task. Here the rows are range-partitioned by (group, order), so a
group that holds a third of all rows spreads over as many partitions as it needs; a row's rank is its place in its
partition's part of the group plus the sizes of the group's parts before. Those sizes are one row for each partition and group
that meet.

Defined cases. Null groups are a group. Rows that tie in the order get ranks in any order among themselves; nulls come first.
An empty table gives an empty table. Column names that begin with two underscores must be free.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratafold.session import materialize, shuffle_partitions


def ranked(df: DataFrame, group: Sequence[str], order: Sequence[str]) -> DataFrame:
    """``df`` with ``__k``, the rank within the group from 0, and ``__n``, the group's size."""
    sort = [*group, *order]
    spread = df.repartitionByRange(shuffle_partitions(df.sparkSession), *sort).sortWithinPartitions(*sort)
    # The number of a row within its partition is in the low 33 bits.
    placed = materialize(spread.withColumns({"__part": F.spark_partition_id(), "__place": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}))
    parts = placed.groupBy(*group, "__part").agg(F.min("__place").alias("__first"), F.count(F.lit(1)).alias("__size"))
    w = Window.partitionBy(*group)
    before = F.coalesce(F.sum("__size").over(w.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = parts.select(*(F.col(g).alias(f"__g{i}") for i, g in enumerate(group)), F.col("__part").alias("__p"), (before - F.col("__first")).alias("__add"), F.sum("__size").over(w).alias("__n"))
    same: Column = F.col("__part") == F.col("__p")
    for i, g in enumerate(group):
        same = same & F.col(g).eqNullSafe(F.col(f"__g{i}"))
    return placed.join(offsets, same).withColumn("__k", F.col("__place") + F.col("__add")).select(*df.columns, "__k", "__n")
