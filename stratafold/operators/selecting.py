"""Top-k, budgeted and ordered selections."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def newest(df: DataFrame, by: Sequence[str], order: Sequence[Column], keep: int) -> DataFrame:
    """The first ``keep`` rows of each group in an order (the planner cuts groups before the shuffle)."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("__k", F.row_number().over(w)).where(F.col("__k") <= keep).drop("__k")


def richest(df: DataFrame, by: Sequence[str], order: Sequence[Column], never: Column) -> DataFrame:
    """One row of each group, the first in an order; rows for which ``never`` holds are all kept."""
    single = newest(df.where(~never), by, order, 1)
    return single.unionByName(df.where(never))


def greedy_budget(df: DataFrame, key: str, area: str, major: str, budget: float) -> DataFrame:
    """All major rows, then minor ones by area (largest first, ties by key) as long as each still fits; one that does not is
    skipped and the next is tried.

    First fit is sequential, so the sorted minor rows stream through one task in batches. What cannot fit in what the majors
    leave is filtered out before the sort.
    """
    used = df.where(F.col(major)).agg(F.coalesce(F.sum(area), F.lit(0))).first()[0]
    room = budget - float(used)
    minors = df.where(~F.col(major) & (F.col(area) <= room)).orderBy(F.col(area).desc(), F.col(key)).coalesce(1)

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left = room
        for batch in batches:
            mask = []
            for value in batch.column(area).to_pylist():
                mask.append(value <= left)
                left -= value if mask[-1] else 0
            yield batch.filter(pa.array(mask, pa.bool_()))

    return df.where(F.col(major)).unionByName(minors.mapInArrow(fit, T.StructType(df.schema.fields)))


def stride(df: DataFrame, by: Sequence[str], order: Sequence[Column], cap: int) -> DataFrame:
    """At most ``cap`` rows a group, evenly spaced from the first to the last (indices rounded half up)."""
    w = Window.partitionBy(*by)
    placed = df.withColumns({"__k": F.row_number().over(w.orderBy(*order)) - 1, "__n": F.count(F.lit(1)).over(w)})
    last = F.col("__n") - 1
    # Row k is taken if some i in 0..cap-1 has floor(i * last / (cap - 1) + 1/2) = k.
    i = F.ceil((F.col("__k") - 0.5) * (cap - 1) / last)
    taken = (F.col("__n") <= cap) | ((i <= cap - 1) & (F.floor(i * last / (cap - 1) + 0.5) == F.col("__k")))
    return placed.where(taken).drop("__k", "__n")


def apportion(df: DataFrame, weight: str, order: str, total: int) -> DataFrame:
    """Adds ``share``: each row gets one, the spare ones follow the weights by largest remainder (ties by ``order``).

    The rows are groups of a palette: a handful, whatever the data.
    """
    every = Window.partitionBy()
    n = F.count(F.lit(1)).over(every)
    ideal = F.when(F.sum(weight).over(every) > 0, F.col(weight) / F.sum(weight).over(every)).otherwise(1 / n) * (total - n)
    parts = df.withColumns({"__n": n, "__ideal": ideal})
    floors = parts.withColumns({"__base": 1 + F.floor("__ideal"), "__rest": F.col("__ideal") - F.floor("__ideal")})
    ranked = floors.withColumns({"__left": total - F.sum("__base").over(every), "__rank": F.row_number().over(Window.orderBy(F.col("__rest").desc(), order))})
    share = F.when(F.col("__n") >= total, 1).otherwise(F.col("__base") + (F.col("__rank") <= F.col("__left")).cast("int"))
    return ranked.withColumn("share", share.cast("long")).select(*df.columns, "share")
