"""Streaming twins of the stateful operators: monotonic progress, latest per key, retention, exactly-once deliveries."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.query import StreamingQuery


def monotonic(events: DataFrame, key: str, value: str) -> DataFrame:
    """The greatest value of each key so far (update mode): progress never falls."""
    return events.groupBy(key).agg(F.max(value).alias("shown"))


def latest(events: DataFrame, key: str, order: list[str], payload: list[str]) -> DataFrame:
    """The last row of each key so far (update mode); ties of the order go to the greater payload."""
    return events.groupBy(key).agg(F.max(F.struct(*order, *payload)).alias("last")).select(key, *(F.col(f"last.{c}").alias(c) for c in (*order, *payload)))


def newest(events: DataFrame, key: str, order: str, item: str, keep: int = 5) -> DataFrame:
    """The ``keep`` newest items of each key so far (update mode), as a list held in the key's state: at most ``keep`` long."""

    def step(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(zip(*state.get)) if state.exists else []
        for frame in frames:
            held = sorted({*held, *zip(frame[order].tolist(), frame[item].tolist())}, reverse=True)[:keep]
        state.update(tuple(map(list, zip(*held))))
        yield pd.DataFrame({key: [group[0]], "items": [[i for _, i in held]]})

    fields = {f.name: f.dataType.simpleString() for f in events.schema.fields}
    return events.select(key, order, item).groupBy(key).applyInPandasWithState(
        step, f"{key} {fields[key]}, items array<{fields[item]}>", f"orders array<{fields[order]}>, items array<{fields[item]}>", "update", GroupStateTimeout.NoTimeout
    )


def until_terminal(events: DataFrame, key: str, order: list[str], terminal: Column) -> DataFrame:
    """Rows of each key up to and with its first terminal one, with ``terminal``; what comes later is left out."""
    first = events.where(terminal).groupBy(F.col(key).alias("__key")).agg(F.min(F.struct(*order)).alias("__end"))
    joined = events.join(first, F.col(key) == F.col("__key"), "left")
    return joined.where(F.col("__end").isNull() | (F.struct(*order) <= F.col("__end"))).withColumn("terminal", F.coalesce(terminal, F.lit(False))).drop("__key", "__end")


def feed(events: DataFrame, key: str, order: str, kind: str, final: list[str]) -> DataFrame:
    """The streaming twin (append mode): events of a key are passed on until one of a final kind, which is the last.

    A key's state is one flag. Within a micro-batch the events of a key go by their order column.
    """

    def step(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        over = state.exists and state.get[0]
        held = pd.concat(list(frames)).sort_values(order, kind="stable")
        ends = held[kind].isin(final).to_numpy()
        if not over:
            last = int(ends.argmax()) + 1 if ends.any() else len(held)
            yield held.iloc[:last]
            state.update((bool(ends.any()),))

    return events.groupBy(key).applyInPandasWithState(step, events.schema, "over boolean", "append", GroupStateTimeout.NoTimeout)


@contextmanager
def cancellable(spark: SparkSession, tag: str) -> Iterator[Callable[[], list[str]]]:
    """Jobs started inside carry a tag; the yielded function, called from any thread, stops those that run."""
    spark.sparkContext.addJobTag(tag)
    try:
        yield lambda: spark.sparkContext.cancelJobsWithTag(tag)
    finally:
        spark.sparkContext.removeJobTag(tag)


def once(deliveries: DataFrame, identifier: list[str], time: str, late: str) -> DataFrame:
    """Each identifier's first arrival; identifiers are remembered as long as the watermark ``late`` says."""
    return deliveries.withWatermark(time, late).dropDuplicatesWithinWatermark(identifier)


def events_to_json(events: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends events as JSON lines, in order within each micro-batch's partitions; ends when the available input is read."""
    return events.select(F.to_json(F.struct(*events.columns)).alias("value")).writeStream.format("text").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
