"""Columnar shredding of nested JSON records into leaf columns with repetition and definition levels.

``shred`` turns each record into one level sequence per leaf path; ``assemble`` rebuilds the flat table of any repeated
ancestor from those sequences alone. A path names the keys from the top, with ``[]`` after a repeated one, as in
``elements[].members[].geometry[].lat``.

Levels. Going down a path, a key that is present and not null adds 1 to the definition level; each entry of a list adds 1
more, and an entry that is not null yet another. The repetition level of an item is the number of the repeated key, counted
from the top, at which it continues a list (0 starts a record). So an empty list, a null entry and an absent key differ, and
null entries keep their place in the count.

Defined cases. A null text, a text that is not one complete JSON object (cut off, trailing characters, a list, NaN literals)
gives a record without items and so no rows. A value that is not a list where a list is expected counts as absent; a list
entry that is neither null nor an object is an entry whose fields are absent; of repeated keys the last holds. Records are
shredded whatever their depth and length, one by one: repeated rows give repeated output, an empty table gives an empty table, and no record moves between
partitions, so a key that holds many rows needs no treatment.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratafold.functions.jsontext import by_bytes, clean, dump, load_object
from stratafold.session import dealt

#: Text that a task holds parsed at once; a path's levels fit a byte.
BATCH_BYTES, MOST_KEYS = 4 << 20, 80


def parse_path(path: str) -> list[tuple[str, bool]]:
    return [(part.removesuffix("[]"), part.endswith("[]")) for part in path.split(".")]


def entry_level(path: str, depth: int) -> int:
    """Definition level from which the entry of the ``depth``-th repeated key exists (null or not)."""
    level = seen = 0
    for _, repeated in parse_path(path):
        level += 1
        if repeated:
            seen += 1
            if seen == depth:
                return level + 1
            level += 2
    raise ValueError(f"{path} has fewer than {depth} repeated keys")


class Branch:
    """A key of the paths' common tree: the paths that end here and those that go on below."""

    def __init__(self, name: str, repeated: bool, depth: int) -> None:
        self.name, self.repeated, self.depth = name, repeated, depth
        self.own: list[int] = []
        self.leaves: list[int] = []
        self.below: list[Branch] = []


def tree_of(paths: Sequence[Sequence[tuple[str, bool]]]) -> list[Branch]:
    """The tree of all paths, so that one walk of a record serves every leaf."""
    top = Branch("", False, 0)
    for leaf, steps in enumerate(paths):
        if len(steps) > MOST_KEYS:
            raise ValueError(f"a path may have {MOST_KEYS} keys at most")
        at = top
        for name, repeated in steps:
            found = next((b for b in at.below if (b.name, b.repeated) == (name, repeated)), None)
            if found is None:
                found = Branch(name, repeated, at.depth + repeated)
                at.below.append(found)
            found.leaves.append(leaf)
            at = found
        at.own.append(leaf)
    return top.below


def shred_record(record: dict, tree: Sequence[Branch], leaves: int) -> list[tuple[bytearray, bytearray, list]]:
    """Repetition levels, definition levels and values of every leaf of one record, in one walk no deeper than the paths."""
    out: list[tuple[bytearray, bytearray, list]] = [(bytearray(), bytearray(), []) for _ in range(leaves)]

    def emit(of: list[int], rep: int, level: int, value: object) -> None:
        for leaf in of:
            reps, defs, values = out[leaf]
            reps.append(rep)
            defs.append(level)
            values.append(value)

    def down(node: object, branches: Sequence[Branch], rep: int, level: int) -> None:
        for branch in branches:
            child = node.get(branch.name) if isinstance(node, dict) else None
            if child is None or (branch.repeated and not isinstance(child, list)):
                emit(branch.leaves, rep, level, None)
            elif not branch.repeated:
                emit(branch.own, rep, level + 1, child)
                if branch.below:
                    down(child, branch.below, rep, level + 1)
            elif not child:
                emit(branch.leaves, rep, level + 1, None)
            else:
                at = rep
                for entry in child:
                    if entry is None:
                        emit(branch.leaves, at, level + 2, None)
                    else:
                        emit(branch.own, at, level + 3, entry)
                        if branch.below:
                            down(entry, branch.below, at, level + 3)
                    at = branch.depth

    down(record, tree, 0, 0)
    return out


def levels(record: dict, steps: Sequence[tuple[str, bool]]) -> tuple[bytearray, bytearray, list]:
    """Repetition levels, definition levels and values of one leaf of one record."""
    return shred_record(record, tree_of([steps]), 1)[0]


def _text(value: object) -> str | None:
    if value is None:
        return None
    return clean(value if isinstance(value, str) else dump(value))


LEAF = T.StructType([T.StructField("rep", T.BinaryType()), T.StructField("def", T.BinaryType()), T.StructField("val", T.ArrayType(T.StringType()))])
_ARROW_LEAF = pa.struct([("rep", pa.binary()), ("def", pa.binary()), ("val", pa.list_(pa.string()))])


def shred(df: DataFrame, key: str, body: str, paths: Sequence[str], values: bool = True, partitions: int | None = None) -> DataFrame:
    """One row per record: ``key`` and, for the i-th path, ``leaf_i`` with its level sequences and (as text) its values.

    ``values=False`` leaves the values out where only the structure is wanted. ``partitions`` deals the records out first.
    """
    tree, count = tree_of([parse_path(p) for p in paths]), len(paths)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_bytes(batch, 1, BATCH_BYTES):
                leaves: list[list] = [[] for _ in range(count)]
                for text in part.column(1):
                    record = load_object(text.as_py())
                    found = [None] * count if record is None else shred_record(record, tree, count)
                    for leaf, levels_of in zip(leaves, found):
                        if levels_of is None:
                            leaf.append(None)
                        else:
                            rep, level, val = levels_of
                            leaf.append({"rep": bytes(rep), "def": bytes(level), "val": [_text(v) for v in val] if values else None})
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(x, _ARROW_LEAF) for x in leaves)], names=["record_key", *(f"leaf_{i}" for i in range(count))])

    schema = T.StructType([T.StructField("record_key", df.schema[key].dataType), *(T.StructField(f"leaf_{i}", LEAF) for i in range(count))])
    return dealt(df.select(F.col(key), F.col(body)), partitions).mapInArrow(run, schema)


def _positions(rep: np.ndarray, depth: int) -> np.ndarray:
    """Position of each item's entry within its list of the ``depth``-th repeated key."""
    count = np.cumsum(rep <= depth)
    restart = np.maximum.accumulate(np.where(rep < depth, np.arange(len(rep)), 0))
    return (count - count[restart]).astype(np.int32)


def _binary(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all values in one array, and each value's length (0 where null)."""
    column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    flat = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return flat, np.diff(offsets)


def assemble(shredded: DataFrame, key: str, paths: Sequence[str], wanted: Sequence[str], depth: int, positions: Sequence[str], fields: Sequence[str] = (), levels_only: bool = False) -> DataFrame:
    """The table of the ``depth``-th repeated ancestor of ``wanted``, from level sequences only.

    ``paths`` are those given to ``shred``; all of ``wanted`` have exactly the same repeated ancestors, at least ``depth`` of
    them. The result has ``key``, one position column for each name of ``positions`` (from the top; the parent's row is the
    one with the same leading positions) and, for each wanted leaf, its value as text under the name in ``fields``. With
    ``levels_only`` the values are left out. Null entries give no row.
    """
    repeated = [i for i, (_, r) in enumerate(parse_path(wanted[0])) if r]
    if any([s for s in parse_path(p)[: repeated[-1] + 1]] != parse_path(wanted[0])[: repeated[-1] + 1] for p in wanted):
        raise ValueError("the wanted leaves need the same repeated ancestors")
    if not 1 <= depth <= len(repeated) or len(positions) != depth:
        raise ValueError("depth and positions do not fit the paths")
    exists = entry_level(wanted[0], depth)
    names = [] if levels_only else list(fields)
    columns = [paths.index(p) for p in wanted[: 1 if levels_only else None]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first = batch.column(1)
            rep, count = _binary(first.field("rep"))
            level, _ = _binary(first.field("def"))
            if not len(rep):
                continue
            keep = np.flatnonzero((rep <= depth) & (level > exists))
            owner = np.repeat(np.arange(batch.num_rows), count)[keep]
            out = [batch.column(0).take(pa.array(owner)), *(pa.array(_positions(rep, d)[keep]) for d in range(1, depth + 1))]
            for i in range(len(names)):
                out.append(batch.column(1 + i).field("val").flatten().take(pa.array(keep)))
            yield pa.RecordBatch.from_arrays(out, names=["record_key", *positions, *names])

    schema = T.StructType([
        T.StructField("record_key", shredded.schema["record_key"].dataType),
        *(T.StructField(p, T.IntegerType()) for p in positions),
        *(T.StructField(n, T.StringType()) for n in names),
    ])
    parts = [F.col("record_key")] + [F.struct(F.col(f"leaf_{c}.rep"), F.col(f"leaf_{c}.def"), *([] if levels_only else [F.col(f"leaf_{c}.val")])).alias(f"leaf_{c}") for c in columns]
    return shredded.select(*parts).mapInArrow(run, schema).withColumnRenamed("record_key", key)


def structure(df: DataFrame, key: str, body: str, path: str, positions: Sequence[str], partitions: int | None = None) -> DataFrame:
    """Every entry of every repeated ancestor of ``path`` in one table: ``key`` and the positions, -1 below the entry's own depth.

    The levels of this single leaf hold the whole structure, so each record is parsed once and all tables come from one
    level sequence.
    """
    depth = len(positions)
    levels_of = [entry_level(path, d) for d in range(1, depth + 1)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rep, count = _binary(batch.column(1))
            level, _ = _binary(batch.column(2))
            if not len(rep):
                continue
            owner = np.repeat(np.arange(batch.num_rows), count)
            pos = [_positions(rep, d) for d in range(1, depth + 1)]
            for d in range(1, depth + 1):
                keep = np.flatnonzero((rep <= d) & (level > levels_of[d - 1]))
                at = [pos[i][keep] if i < d else np.full(len(keep), -1, np.int32) for i in range(depth)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner[keep])), *map(pa.array, at)], names=["record_key", *positions])

    shredded = shred(df, key, body, [path], False, partitions)
    schema = T.StructType([T.StructField("record_key", shredded.schema["record_key"].dataType), *(T.StructField(p, T.IntegerType()) for p in positions)])
    return shredded.select("record_key", F.col("leaf_0.rep").alias("rep"), F.col("leaf_0.def").alias("def")).mapInArrow(run, schema).withColumnRenamed("record_key", key)


def assemble_record(rep: bytes, level: bytes, path: str, depth: int) -> list[tuple[int, ...]]:
    """The positions of one record's entries of the ``depth``-th repeated key; the scalar twin of ``assemble``."""
    reps, defs = np.frombuffer(rep, np.uint8), np.frombuffer(level, np.uint8)
    keep = np.flatnonzero((reps <= depth) & (defs > entry_level(path, depth)))
    return list(zip(*(_positions(reps, d)[keep].tolist() for d in range(1, depth + 1))))
