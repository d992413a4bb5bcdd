"""Collapsing records that differ only in formatting, by range partitioning, external sort and a scan of adjacent runs.

Records are brought to a canonical form, range-partitioned and sorted by (canonical form, id), and scanned in order comparing
whole forms. The id is part of the range key, so a form that holds a third of all rows is cut into as many partitions as it
needs. Each scan says of its rows to which run they belong; the run a partition begins with may be the end of its
predecessor's, so a scan also writes one edge row with the forms at its ends. Edge rows (one a partition) are chained in
partition order, which gives such runs their true first record, and are broadcast back to the partitions' leading rows.

Defined cases. The fields of a text are its parts between commas, semicolons and vertical bars. Within a field only letters
and digits (categories L and N) count, in either case (so a sharp s equals ss); the text is composed first, so accents count
whether composed or not, while marks that no letter takes up do not. The order of words counts. Fields without any letter or
digit are ignored and the order of fields has no meaning; a field that occurs twice counts twice. Null texts, texts without a
letter or digit and rows without an id are no cases. Rows that repeat an id with the same form are copies like any other:
the representative is the smallest id and exactly one of the rows that tie for it, and the others are surplus. Other columns
are never read. An empty table gives an empty result.

Scale. Forms are made and written once; two reads of them (one samples the range bounds) and one shuffle; the partitions grow with the records, ``PART_ROWS`` each.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratafold.session import materialize, shuffle_partitions


@F.pandas_udf(T.StringType())
def _composed(text: pd.Series) -> pd.Series:
    return text.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")


def canonical_form(text: Column) -> Column:
    """The canonical form of a text, null where it has none.

    Only texts with combining marks visit Python, to be composed.
    """
    marked = text.rlike(r"\p{M}")
    composed = F.coalesce(_composed(F.when(marked, text)), text)
    fields = F.transform(F.split(composed, r"[,;|]"), lambda f: F.regexp_replace(F.regexp_replace(F.lower(F.upper(f)), "[ß\u1e9e]", "ss"), r"[^\p{L}\p{N}]", ""))
    form = F.array_join(F.array_sort(F.filter(fields, lambda f: f != "")), ",")
    return F.when(form != "", form)


#: Records that a partition is planned for.
PART_ROWS = 1_000_000
_SCAN = pa.schema([("part", pa.int32()), ("edge", pa.bool_()), ("leading", pa.bool_()), ("first", pa.bool_()), ("id", pa.int64()), ("keep_id", pa.int64()), ("whole", pa.bool_()), ("first_form", pa.string()), ("last_form", pa.string())])


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of equal forms in one sorted partition (columns form, id).

    Rows: ``id`` and the first id of its run in this partition, whether it is the run's first row, ``leading`` in the
    partition's first run. One edge row: the forms at both ends, the first id of the last run (keep_id), and whether one run
    fills the partition.
    """
    part = TaskContext.get().partitionId()
    first_form = last_form = None
    start_id, leading, seen = 0, True, False
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        form, ids = batch.column(0), batch.column(1).to_numpy()
        head = form[0].as_py()
        if not seen:
            first_form = head
        fresh = np.ones(n, np.bool_)
        fresh[1:] = pc.not_equal(form.slice(1), form.slice(0, n - 1)).to_numpy(zero_copy_only=False)
        fresh[0] = not seen or head != last_form
        # Position of each row's run start in this batch; -1 where the run began in an earlier one.
        start = np.maximum.accumulate(np.where(fresh, np.arange(n), -1))
        keep = np.where(start >= 0, ids[start], start_id)
        begun = np.cumsum(fresh) - (not seen)
        lead = (begun == 0) & leading
        start_id, leading, seen, last_form = int(keep[-1]), bool(lead[-1]), True, form[n - 1].as_py()
        none, no = pa.nulls(n, pa.string()), pa.array(np.zeros(n, np.bool_))
        yield pa.RecordBatch.from_arrays([pa.array(np.full(n, part, np.int32)), no, pa.array(lead), pa.array(fresh), pa.array(ids), pa.array(keep), no, none, none], schema=_SCAN)
    if seen:
        edge = [[part], [True], [False], [False], [None], [start_id], [leading], [first_form], [last_form]]
        yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(edge, _SCAN)], schema=_SCAN)


def runs(df: DataFrame, key: str, text: str) -> DataFrame:
    """``id, keep_id, first`` of every record that is a case: the representative of its group, and whether it is that record."""
    spark = df.sparkSession
    # Written once: the range bounds are sampled from the forms before they are shuffled.
    forms = materialize(df.select(canonical_form(F.col(text)).alias("form"), F.col(key).cast("long").alias("id")).dropna())
    parts = max(shuffle_partitions(spark), -(-forms.count() // PART_ROWS))
    ordered = forms.repartitionByRange(parts, "form", "id").sortWithinPartitions("form", "id")
    scanned = materialize(ordered.mapInArrow(_scan, "part int, edge boolean, leading boolean, first boolean, id long, keep_id long, whole boolean, first_form string, last_form string"))
    # One row a partition: a window over them all is bounded by the number of partitions, whatever the input.
    order = Window.orderBy("part")
    edges = scanned.where("edge").select("part", "whole", "first_form", "keep_id", F.lag("last_form").over(order).alias("before"))
    fresh = edges.withColumn("joined", F.coalesce(F.col("first_form") == F.col("before"), F.lit(False)))
    # The first record of a run that goes on is that of the last partition in which a run began.
    begun = F.when(~F.col("whole") | ~F.col("joined"), F.col("keep_id"))
    chained = fresh.withColumn("carried", F.last(begun, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))).where("joined").select("part", "carried")
    rows = scanned.where("NOT edge").select("part", "leading", "first", "id", "keep_id")
    return rows.join(F.broadcast(chained), (rows.part == chained.part) & rows.leading, "left").select("id", F.coalesce("carried", "keep_id").alias("keep_id"), (F.col("first") & F.col("carried").isNull()).alias("first"))


def surplus_copies(df: DataFrame, key: str, text: str) -> DataFrame:
    """``keep_id, copy_id`` of every surplus copy: one row fewer for each group than it has records."""
    return runs(df, key, text).where("NOT first").select("keep_id", F.col("id").alias("copy_id"))


def collapse(df: DataFrame, key: str, text: str) -> DataFrame:
    """One row per distinct record: ``keep_id``, its smallest id, and ``copies``, the exact number of records it stands for."""
    return runs(df, key, text).groupBy("keep_id").agg(F.count(F.lit(1)).alias("copies"))
