"""Bookkeeping tables: upsert, archive with retention, restore, cascade and age deletes, recovery, state folds.

Plain Parquet has no MERGE, so each change is a plan that gives the table's next version.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratafold.operators.selecting import newest


def upsert(table: DataFrame, incoming: DataFrame, unique: str, keep: tuple[str, ...]) -> DataFrame:
    """Incoming rows replace those of the same unique value, but for the ``keep`` columns; adds ``is_new`` (null where the row
    was not touched). ``incoming`` holds each value once."""
    old, new = table.alias("o"), incoming.alias("n")
    joined = old.join(new, F.col(f"o.{unique}").eqNullSafe(F.col(f"n.{unique}")), "full_outer")
    has_old, has_new = F.col(f"o.{keep[0]}").isNotNull(), F.col(f"n.{keep[0]}").isNotNull()
    columns = [F.when(has_old & (F.lit(c in keep) | ~has_new), F.col(f"o.{c}")).otherwise(F.col(f"n.{c}")).alias(c) for c in table.columns]
    return joined.select(*columns, F.when(has_new, ~has_old).alias("is_new"))


def archive(versions: DataFrame, added: DataFrame, group: str, order: list[Column], keep: int = 5) -> DataFrame:
    """The version table with ``added`` rows and only the newest ``keep`` of each group."""
    return newest(versions.unionByName(added), [group], order, keep)


def restore(current: DataFrame, versions: DataFrame, asked: DataFrame, key: str, payload: str) -> tuple[DataFrame, DataFrame]:
    """Swap each asked version (``key, version``) with the current payload: the next current and version tables."""
    wanted = asked.join(versions.select(F.col(key), "version", F.col(payload).alias("__old")), [key, "version"])
    held = current.join(wanted.select(key, F.col("__old"), "version"), key, "left")
    now = held.select(*(F.coalesce("__old", payload).alias(payload) if c == payload else F.col(c) for c in current.columns))
    back = held.where("version IS NOT NULL").select(key, "version", F.col(payload).alias("__now"))
    swapped = versions.join(back, [key, "version"], "left")
    return now, swapped.select(*(F.coalesce("__now", payload).alias(payload) if c == payload else F.col(c) for c in versions.columns))


def cascade_delete(parents: DataFrame, children: DataFrame, gone: DataFrame, key: str, foreign: str) -> tuple[DataFrame, DataFrame]:
    ids = gone.select(F.col(key).alias("__gone")).distinct()
    return parents.join(ids, F.col(key) == F.col("__gone"), "left_anti"), children.join(ids, F.col(foreign) == F.col("__gone"), "left_anti")


def recover(jobs: DataFrame, status: str) -> DataFrame:
    """Jobs that were queued or running when the service stopped have failed; all else stays."""
    return jobs.withColumn(status, F.when(F.col(status).isin("queued", "running"), "failed").otherwise(F.col(status)))


def running_max(events: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """Adds ``shown``: the greatest value so far of each key."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return events.withColumn("shown", F.max(value).over(w))


def final_state(events: DataFrame, key: str, order: list[str], state: str, absorbing: str) -> DataFrame:
    """The last state of each key, or ``absorbing`` once it has occurred; combined before the shuffle, with no list per key."""
    return events.groupBy(key).agg(F.when(F.bool_or(F.col(state) == absorbing), absorbing).otherwise(F.max(F.struct(*order, state))[state]).alias("state"))
