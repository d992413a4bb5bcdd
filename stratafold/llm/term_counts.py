"""Frequency of every distinct term: global integer dictionary, blockwise count arrays, sums by identifier range.

Each input block counts its own terms in arrays over block-local codes (occurrences, and records that hold the term), so a
term that holds a third of all occurrences leaves a block as one row. The distinct terms are range-partitioned and numbered
densely in sorted order: that is the global dictionary. Block rows are encoded by it, go to the task of their identifier
range, and are added into its dense count arrays as they stream in, one range after the other, so a task
holds one range's. The dictionary's rows travel with them and give the sums their terms.

Defined cases. A map's key and each item of its value, split at semicolons and trimmed of spaces, make a term; case counts.
Null maps, null values and empty items give no term; repeats within a record count as occurrences each, and once for the
record. Rows without terms count as records of the collection. Rows that repeat are records of their own. Other columns are
never read. An empty table has no terms.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratafold.session import materialize, shuffle_partitions

#: Identifiers of one count array.
RANGE_SIZE = 1 << 16
#: Distinct terms a block may hold before it is closed.
BLOCK_TERMS = 200_000


def count_batch(maps: pa.MapArray) -> pa.Table:
    """Terms of one batch of maps with their counts: key, item, occurrences, records."""
    pairs = maps.cast(pa.list_(pa.struct([("key", pa.string()), ("value", pa.string())])))
    row = pc.list_parent_indices(pairs)
    flat = pc.list_flatten(pairs)
    keys, values = flat.field("key"), flat.field("value")
    parts = pc.split_pattern(values, ";")
    owner = pc.list_parent_indices(parts)
    item = pc.utf8_trim(pc.list_flatten(parts), " ")
    full = pc.not_equal(item, "")
    item, owner = item.filter(full), owner.filter(full)
    if not len(item):
        return pa.table({"key": pa.array([], pa.string()), "item": pa.array([], pa.string()), "occurrences": pa.array([], pa.int64()), "records": pa.array([], pa.int64())})
    key = keys.take(owner).dictionary_encode()
    item = item.dictionary_encode()
    row = row.take(owner).to_numpy(zero_copy_only=False).astype(np.int64)
    code = key.indices.to_numpy(zero_copy_only=False).astype(np.int64) * len(item.dictionary) + item.indices.to_numpy(zero_copy_only=False)
    terms, local = np.unique(code, return_inverse=True)
    occurrences = np.bincount(local, minlength=len(terms))
    pairs = np.unique(row * len(terms) + local)
    records = np.bincount(pairs % len(terms), minlength=len(terms))
    return pa.table({"key": key.dictionary.take(pa.array(terms // len(item.dictionary))), "item": item.dictionary.take(pa.array(terms % len(item.dictionary))), "occurrences": pa.array(occurrences, pa.int64()), "records": pa.array(records, pa.int64())})


def _block_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.Table] = []

    def close() -> pa.Table:
        total = pa.concat_tables(held).group_by(["key", "item"]).aggregate([("occurrences", "sum"), ("records", "sum")])
        return total.select(["key", "item", "occurrences_sum", "records_sum"]).rename_columns(["key", "item", "occurrences", "records"])

    for batch in batches:
        held.append(count_batch(batch.column(0)))
        if sum(t.num_rows for t in held) > BLOCK_TERMS:
            held = [close()]
            if held[0].num_rows > BLOCK_TERMS // 2:
                yield from held.pop().to_batches()
    if held:
        yield from close().to_batches()


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, at = TaskContext.get().partitionId(), 0
    for batch in batches:
        n = batch.num_rows
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(n, part, np.int32)), pa.array(np.arange(at, at + n))], names=["key", "item", "part", "place"])
        at += n


def dictionary(terms: DataFrame) -> DataFrame:
    """``key, item, term_id``: dense ids in sorted order of the distinct ``terms`` (key, item)."""
    spark = terms.sparkSession
    placed = materialize(terms.distinct().repartitionByRange(shuffle_partitions(spark), "key", "item").sortWithinPartitions("key", "item").mapInArrow(_number, "key string, item string, part int, place long"))
    sizes = placed.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    # One row a partition: bounded by the number of partitions.
    starts = sizes.selectExpr("part", "CAST(coalesce(sum(n) OVER (ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start")
    return placed.join(F.broadcast(starts), "part").select("key", "item", (F.col("start") + F.col("place")).alias("term_id"))


def _sum_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds encoded block rows (range, offset, occurrences, records, and null terms), sorted by range, into one pair of dense arrays,
    and takes up the range's part of the dictionary (rows with their term); gives both out when the next range begins."""
    current = None
    occurrences = records = np.zeros(0, np.int64)
    places: list[np.ndarray] = []
    terms: list[pa.RecordBatch] = []

    def emit() -> pa.RecordBatch:
        at = np.concatenate(places).astype(np.int64)
        order = pa.array(np.argsort(at))
        named = pa.Table.from_batches(terms).take(order).combine_chunks()
        at = np.sort(at)
        columns = [pa.array(current * RANGE_SIZE + at), *(named.column(i).combine_chunks() for i in (0, 1)), pa.array(occurrences[at]), pa.array(records[at])]
        return pa.RecordBatch.from_arrays(columns, names=["term_id", "key", "item", "occurrences", "records"])

    for batch in batches:
        ranges, offsets, more_occurrences, more_records = (c.to_numpy(zero_copy_only=False) for c in batch.columns[:4])
        named = batch.column(4).is_valid()
        cuts = [0, *(np.flatnonzero(np.diff(ranges)) + 1).tolist(), len(ranges)]
        for lo, hi in zip(cuts, cuts[1:]):
            if lo == hi:
                continue
            if ranges[lo] != current:
                if current is not None:
                    yield emit()
                current, occurrences, records, places, terms = int(ranges[lo]), np.zeros(RANGE_SIZE, np.int64), np.zeros(RANGE_SIZE, np.int64), [], []
            np.add.at(occurrences, offsets[lo:hi], more_occurrences[lo:hi])
            np.add.at(records, offsets[lo:hi], more_records[lo:hi])
            held = named.slice(lo, hi - lo)
            places.append(offsets[lo:hi][held.to_numpy(zero_copy_only=False)])
            terms.append(batch.slice(lo, hi - lo).select([4, 5]).filter(held))
    if current is not None:
        yield emit()


def count_terms(df: DataFrame, tags: str) -> DataFrame:
    """``term_id, key, item, occurrences, records`` of every distinct term of the map column ``tags``."""
    blocks = materialize(df.select(tags).mapInArrow(_block_counts, "key string, item string, occurrences long, records long"))
    words = materialize(dictionary(blocks.select("key", "item")))
    place = [f"CAST(term_id DIV {RANGE_SIZE}L AS INT) AS id_range", f"CAST(term_id % {RANGE_SIZE}L AS INT) AS offset"]
    encoded = blocks.join(words, ["key", "item"]).selectExpr(*place, "occurrences", "records", "CAST(NULL AS STRING) AS key", "CAST(NULL AS STRING) AS item")
    # The dictionary goes to its ranges with the counts, which spares a join of the sums with it.
    both = encoded.unionByName(words.selectExpr(*place, "0L AS occurrences", "0L AS records", "key", "item"))
    return both.repartition("id_range").sortWithinPartitions("id_range").mapInArrow(_sum_ranges, "term_id long, key string, item string, occurrences long, records long")


def mark_terms(df: DataFrame, tags: str, rare_below: int = 3, common_above: float = 0.1) -> DataFrame:
    """``tag_key, tag_value, mark``: ``rare`` in fewer than ``rare_below`` records, ``common`` in more than that share of all.

    In a table so small that a term is both, it gets a row for each mark.
    """
    total = df.count()
    counted = count_terms(df, tags)
    # The share is compared in whole numbers where it is one in n, so that ties are exact.
    common = F.col("records") * round(1 / common_above) > total if (1 / common_above).is_integer() else F.col("records") > common_above * total
    marks = F.array_compact(F.array(F.when(F.col("records") < rare_below, F.lit("rare")), F.when(common, F.lit("common"))))
    return counted.select(F.col("key").alias("tag_key"), F.col("item").alias("tag_value"), F.explode(marks).alias("mark"))
