"""Exactly-once view of messages that were delivered at least once.

Deliveries fall into time buckets by an order column that rises with time; the buckets' bounds are quantiles of that column, so
outlying values do not empty them. Each input block first reduces an identifier to its earliest delivery: all its others are
certain repeats and leave at once. The candidates meet by identifier hash, sorted by bucket, and each bucket's Bloom filter
is asked about the candidates of later buckets. A candidate that no earlier filter knows is definitely new. All candidates
go to storage that is partitioned by time bucket and clustered by identifier; possible repeats are verified exactly against
the stored identifiers of just those buckets whose filters answered, task by task where they lie, so verification moves
nothing and a false positive costs a lookup but never a row.

``DeliveryStore`` keeps the storage and the filters from batch to batch: a new batch meets the filters of the earlier ones
and reads only the buckets that they name.

Scale. One shuffle of the candidates, by identifier; an identifier that holds a third of all rows arrives as one row for
each input block. The number of shards grows with the rows to at most ``MOST_SHARDS``.

Defined cases. The payload plays no part. Rows whose identifier or order value is null are no cases: they are neither kept
nor reported. Rows that repeat an order value for the same identifier are one delivery and are reported once; on a tie
between identifiers each keeps its own. Other columns are never read, whatever their names. An empty table gives an empty
result.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratafold.session import materialize, scratch_path, shuffle_partitions

#: Time buckets of one batch; a row's answers fit one 64-bit mask.
TIME_BUCKETS = 8
#: Candidates that one shard is planned for, and the most shards of a store.
SHARD_ROWS, MOST_SHARDS = 2_000_000, 20_000
#: Rows that an input block reduces at once.
BLOCK_ROWS = 400_000
BITS_PER_KEY, PROBES = 12, 4


class BloomFilter:
    """A plain Bloom filter over 64-bit hashes with double hashing."""

    def __init__(self, hashes: np.ndarray) -> None:
        self.mask = np.uint64((1 << max(6, (BITS_PER_KEY * len(hashes) - 1).bit_length())) - 1)
        bits = np.zeros(int(self.mask) + 1, np.bool_)
        for at in self._slots(hashes):
            bits[at] = True
        self.bits = np.packbits(bits)

    @classmethod
    def of_bytes(cls, bits: bytes) -> BloomFilter:
        made = cls.__new__(cls)
        made.bits = np.frombuffer(bits, np.uint8)
        made.mask = np.uint64(8 * len(bits) - 1)
        return made

    def _slots(self, hashes: np.ndarray) -> Iterator[np.ndarray]:
        step = (hashes >> np.uint64(32)) | np.uint64(1)
        for i in range(PROBES):
            yield (hashes + np.uint64(i) * step) & self.mask

    def __contains__(self, hashes: np.ndarray) -> bool:
        return bool(self.known(hashes).all())

    def known(self, hashes: np.ndarray) -> np.ndarray:
        left = np.arange(len(hashes))
        for i in range(PROBES):
            h = hashes[left]
            at = (h + np.uint64(i) * ((h >> np.uint64(32)) | np.uint64(1))) & self.mask
            left = left[(self.bits[at >> np.uint64(3)] >> (7 - (at & np.uint64(7))).astype(np.uint8)) & 1 == 1]
        out = np.zeros(len(hashes), np.bool_)
        out[left] = True
        return out


def _codes(columns: Sequence[pa.ChunkedArray]) -> np.ndarray:
    """One integer for each distinct combination of the columns' values."""
    code = np.zeros(len(columns[0]), np.int64)
    for column in columns:
        encoded = column.combine_chunks().dictionary_encode()
        if isinstance(encoded, pa.ChunkedArray):
            encoded = encoded.combine_chunks()
        code = code * len(encoded.dictionary) + encoded.indices.to_numpy(zero_copy_only=False)
        code = np.unique(code, return_inverse=True)[1]
    return code


def _reduce(batches: Iterator[pa.RecordBatch], bounds: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Adds the time bucket and whether a row (ord, keys) is a certain repeat: a later one of its identifier in its block."""

    def block(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held)
        order, code = table.column(0).to_numpy(), _codes(table.columns[1:])
        place = np.lexsort((order, code))
        same = np.zeros(len(place), np.bool_)
        same[1:] = code[place[1:]] == code[place[:-1]]
        again = same.copy()
        again[1:] &= order[place[1:]] == order[place[:-1]]
        # Rows with the identifier and order value of the row before are that delivery again.
        keep = place[~again]
        bucket = np.searchsorted(bounds, order[keep], "right").astype(np.int32)
        out = table.take(pa.array(keep)).append_column("time_bucket", pa.array(bucket)).append_column("certain", pa.array(same[~again]))
        yield from out.combine_chunks().to_batches()

    held, rows = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            rows += batch.num_rows
        if rows >= BLOCK_ROWS:
            yield from block(held)
            held, rows = [], 0
    if held:
        yield from block(held)


def _seen(hits: list[tuple[np.ndarray, int]], rows: int) -> pa.ListArray:
    """For each row the buckets that a filter named for it, from the (rows, bucket) answers."""
    at = np.concatenate([np.zeros(0, np.int64), *(found for found, _ in hits)])
    named = np.concatenate([np.zeros(0, np.int32), *(np.full(len(found), bucket, np.int32) for found, bucket in hits)])
    order = np.argsort(at, kind="stable")
    offsets = np.concatenate([[0], np.cumsum(np.bincount(at, minlength=rows))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(named[order]))


def _screen(batches: Iterator[pa.RecordBatch], key_count: int) -> Iterator[pa.RecordBatch]:
    """Reads a shard sorted by (bucket, keys, ord): the filters of stored buckets, then candidates.

    Gives each candidate ``seen``, the earlier buckets whose filter knows its identifier, and ``repeat``, whether its own bucket holds
    its identifier already; and after each new bucket one row with its filter.
    """
    filters: dict[int, BloomFilter] = {}
    held: list[pa.RecordBatch] = []
    current = shard = None

    def flush() -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held).combine_chunks()
        n = table.num_rows
        hashes = table.column("key_hash").to_numpy().view(np.uint64)
        repeat = np.zeros(n, np.bool_)
        if n > 1:
            repeat[1:] = True
            for i in range(key_count):
                column = table.column(f"key_{i}")
                repeat[1:] &= pc.equal(column.slice(1), column.slice(0, n - 1)).to_numpy()
            order = table.column("ord").to_numpy()
            once = ~(repeat & np.concatenate([[False], order[1:] == order[:-1]]))
            if not once.all():
                table, hashes, repeat, n = table.filter(pa.array(once)).combine_chunks(), hashes[once], repeat[once], int(once.sum())
        hits = [(np.flatnonzero(known.known(hashes)), bucket) for bucket, known in filters.items()]
        filters[current] = BloomFilter(hashes[~repeat])
        full = table.append_column("seen", _seen(hits, n)).append_column("repeat", pa.array(repeat))
        yield from full.to_batches()
        row = {"shard": shard, "time_bucket": current, "bits": filters[current].bits.tobytes(), "repeat": False}
        yield pa.RecordBatch.from_arrays([pa.array([row.get(f.name)], f.type) for f in full.schema], schema=full.schema)

    for batch in batches:
        if not batch.num_rows:
            continue
        buckets = batch.column("time_bucket").to_numpy()
        shard = batch.column("shard")[0].as_py()
        stored = batch.column("bits").is_valid().to_numpy(zero_copy_only=False)
        for i in np.flatnonzero(stored).tolist():
            filters[int(buckets[i])] = BloomFilter.of_bytes(batch.column("bits")[i].as_py())
        first = int(stored.sum())
        cuts = [first, *(np.flatnonzero(np.diff(buckets[first:])) + 1 + first).tolist(), len(buckets)]
        for lo, hi in zip(cuts, cuts[1:]):
            if lo >= hi:
                continue
            if held and buckets[lo] != current:
                yield from flush()
                held = []
            current = int(buckets[lo])
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield from flush()


def _rows(df: DataFrame, order: str, identifier: Sequence[Column]) -> DataFrame:
    return df.select(F.col(order).cast("long").alias("ord"), *(c.alias(f"key_{i}") for i, c in enumerate(identifier))).dropna()


class DeliveryStore:
    """Stored identifiers and filters of all batches so far, in a folder that all executors share.

    The storage is a table with a folder for each time bucket, clustered by identifier into the store's shards. A store made on a
    folder that holds one takes it up; its shards stay those it was made with. Batches are taken one after the other: an
    identifier of an earlier batch is never new again, whatever its order value.
    """

    def __init__(self, spark: SparkSession, path: str | None = None) -> None:
        self.spark = spark
        self.path, self.kept = path or scratch_path(spark), path is not None
        self.name = f"deliveries_{uuid.uuid4().hex}"
        self.shards = 0
        made = _layout(spark, self.path) if path else None
        if made:
            self.shards, columns = made
            keys = ", ".join(c.split()[0] for c in columns.split(", ") if c.startswith("key_"))
            spark.sql(f"CREATE TABLE {self.name} ({columns}) USING parquet PARTITIONED BY (time_bucket) CLUSTERED BY ({keys}) INTO {self.shards} BUCKETS LOCATION '{self.path}/rows'")
            spark.sql(f"ALTER TABLE {self.name} RECOVER PARTITIONS")

    def add(self, df: DataFrame, order: str, identifier: Sequence[Column]) -> tuple[DataFrame, DataFrame]:
        """Takes a batch in. Returns its kept rows (``ord`` and the identifier's ``key_i``) and its surplus ones, each delivery once."""
        rows = _rows(df, order, identifier)
        total, bounds = rows.agg(F.count(F.lit(1)), F.percentile_approx("ord", [i / TIME_BUCKETS for i in range(1, TIME_BUCKETS)], 1000)).first()
        keys = [f"key_{i}" for i in range(len(identifier))]
        if not total:
            return rows, rows
        fresh = not self.shards
        if fresh:
            self.shards = min(MOST_SHARDS, max(shuffle_partitions(self.spark), -(-total // SHARD_ROWS)))
        cuts = np.array(sorted(set(bounds)), np.int64)
        schema = T.StructType([*rows.schema.fields, T.StructField("time_bucket", T.IntegerType()), T.StructField("certain", T.BooleanType())])
        reduced = materialize(rows.mapInArrow(lambda batches: _reduce(batches, cuts), schema), "certain")
        stored = self.rows()
        base = (stored.agg(F.max("time_bucket")).first()[0] + 1) if stored is not None else 0
        shard = F.expr(f"pmod(hash({', '.join(keys)}), {self.shards})")
        asked = reduced.where("NOT certain").select("ord", *keys, (F.col("time_bucket") + base).alias("time_bucket"), shard.alias("shard"), F.xxhash64(*keys).alias("key_hash"), F.lit(None).cast("binary").alias("bits"))
        if stored is not None:
            asked = asked.unionByName(stored.where("bits IS NOT NULL").select("time_bucket", "shard", "bits"), allowMissingColumns=True)
        schema = T.StructType([*(T.StructField(f.name, f.dataType) for f in asked.schema), T.StructField("seen", T.ArrayType(T.IntegerType())), T.StructField("repeat", T.BooleanType())])
        count = len(keys)
        screened = asked.repartitionById(self.shards, F.col("shard")).sortWithinPartitions("time_bucket", *keys, "ord").mapInArrow(lambda batches: _screen(batches, count), schema)
        screened.drop("key_hash").write.mode("append").format("parquet").partitionBy("time_bucket").bucketBy(self.shards, *keys).option("path", f"{self.path}/rows").saveAsTable(self.name)
        if fresh and self.kept:
            columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in self.rows().schema)
            self.spark.createDataFrame([(self.shards, columns)], "shards int, columns string").coalesce(1).write.parquet(f"{self.path}/layout")
        batch = self.rows().where(F.col("bits").isNull() & (F.col("time_bucket") >= base))
        possible = batch.where("repeat OR size(seen) > 0").select("ord", *keys, "seen", "repeat", "time_bucket")
        # At most as many numbers as the store has buckets; only their folders are read.
        asked_of = F.when(F.col("repeat"), F.array("time_bucket")).otherwise(F.col("seen"))
        named = [r[0] for r in possible.select(F.explode(asked_of).alias("b")).distinct().collect()]
        held = self.rows().where(F.col("time_bucket").isin(named) & F.expr("bits IS NULL AND NOT repeat")).select(*(F.col(k).alias(f"held_{i}") for i, k in enumerate(keys)), F.col("time_bucket").alias("held_bucket")).hint("merge")
        # A repeat within its own bucket is found there, others in the buckets that the filters named.
        same = F.when(F.col("repeat"), F.col("held_bucket") == F.col("time_bucket")).otherwise(F.array_contains("seen", F.col("held_bucket")))
        for i, k in enumerate(keys):
            same = same & (F.col(k) == F.col(f"held_{i}"))
        new = batch.where("NOT repeat AND size(seen) = 0").select("ord", *keys).unionByName(possible.join(held, same, "left_anti").select("ord", *keys))
        surplus = reduced.where("certain").select("ord", *keys).unionByName(possible.join(held, same, "left_semi").select("ord", *keys))
        return new, surplus

    def rows(self) -> DataFrame | None:
        return self.spark.table(self.name) if self.shards and self.spark.catalog.tableExists(self.name) else None


def _layout(spark: SparkSession, path: str) -> tuple[int, str] | None:
    """Shards and columns of the store in a folder, None where there is none."""
    try:
        return tuple(spark.read.schema("shards int, columns string").parquet(f"{path}/layout").first())
    except AnalysisException:
        return None


def first_deliveries(df: DataFrame, order: str, identifier: Sequence[Column]) -> DataFrame:
    """The order value (``ord``) and identifier (``key_i``) of the one delivery to keep of each identifier."""
    return DeliveryStore(df.sparkSession).add(df, order, identifier)[0]


def surplus_deliveries(df: DataFrame, order: str, identifier: Sequence[Column]) -> DataFrame:
    """The order values of all deliveries but those that ``first_deliveries`` keeps."""
    surplus = DeliveryStore(df.sparkSession).add(df, order, identifier)[1]
    return surplus.select(F.col("ord").alias(order)).distinct()


def deduplicate(df: DataFrame, order: str, identifier: Sequence[Column]) -> DataFrame:
    """The rows of ``df`` to keep, whole, one for each identifier; where rows repeat a delivery, any one of them."""
    kept = first_deliveries(df, order, identifier)
    keys = [f"__key_{i}" for i in range(len(identifier))]
    named = df.withColumns(dict(zip(keys, identifier)))
    same = F.col(order).cast("long") == F.col("__ord")
    for i, k in enumerate(keys):
        same = same & (F.col(k) == F.col(f"__kept_{i}"))
    return named.join(kept.select(F.col("ord").alias("__ord"), *(F.col(f"key_{i}").alias(f"__kept_{i}") for i in range(len(keys)))), same, "left_semi").dropDuplicates([order, *keys]).drop(*keys)
