"""64-bit wrapping hashes as Arrow functions, bit for bit (Spark's ANSI arithmetic would overflow)."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Saved puzzles depend on these multipliers and shifts.
SEED_MULTIPLIER = 0xD6E8FEB86659FD93
ORIENTATION_MULTIPLIER = 0xA24BAED4963EE407
LINE_MULTIPLIER = 0x9FB21C651E98DF25
SEGMENT_MULTIPLIER = 0xC13FA9A902A6328F
MIX_1, MIX_2 = 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
FNV_OFFSET, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3


def mix64(seed: np.ndarray, lane: int) -> np.ndarray:
    """The finaliser over 64-bit seeds for one lane."""
    with np.errstate(over="ignore"):
        v = seed ^ np.uint64(lane * SEED_MULTIPLIER & 0xFFFFFFFFFFFFFFFF)
        v = (v ^ (v >> np.uint64(30))) * np.uint64(MIX_1)
        v = (v ^ (v >> np.uint64(27))) * np.uint64(MIX_2)
        return v ^ (v >> np.uint64(31))


def noise(seed: np.ndarray, lane: int) -> np.ndarray:
    """The top 24 bits as a share of their range."""
    return (mix64(seed, lane) >> np.uint64(40)).astype(np.float64) / 16_777_215.0


@F.pandas_udf(T.DoubleType())
def _edge_sign(seed: pd.Series, orientation: pd.Series, segment: pd.Series, line: pd.Series) -> pd.Series:
    with np.errstate(over="ignore"):
        parts = [(s.to_numpy(np.int64).view(np.uint64), m) for s, m in ((seed, SEED_MULTIPLIER), (orientation, ORIENTATION_MULTIPLIER), (line, LINE_MULTIPLIER), (segment, SEGMENT_MULTIPLIER))]
        mixed = np.bitwise_xor.reduce([p * np.uint64(m) for p, m in parts])
    return pd.Series(np.where(noise(mixed, 7) < 0.5, -1.0, 1.0))


def edge_sign(seed: Column, orientation: Column, segment: Column, line: Column) -> Column:
    """-1 or 1, the side to which a shared puzzle edge bulges; the same from both of its pieces."""
    return _edge_sign(*(c.cast("long") for c in (seed, orientation, segment, line)))


def fnv1a64_of(flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """FNV-1a of byte strings that lie one after the other: a step takes the next byte of every string that has one."""
    order = np.argsort(-sizes, kind="stable")
    start = (np.cumsum(sizes) - sizes)[order]
    active = np.searchsorted(-sizes[order], -np.arange(1, (sizes.max() if len(sizes) else 0) + 1), "right")
    state = np.full(len(sizes), FNV_OFFSET, np.uint64)
    with np.errstate(over="ignore"):
        for t, n in enumerate(active):
            state[:n] = (state[:n] ^ flat[start[:n] + t]) * np.uint64(FNV_PRIME)
    out = np.empty_like(state)
    out[order] = state
    return out


@F.pandas_udf(T.LongType())
def fnv1a64(text: pd.Series) -> pd.Series:
    """FNV-1a of the text's UTF-8 bytes as a signed bit pattern, null for null."""
    held = [t.encode() if t is not None else b"" for t in text]
    state = fnv1a64_of(np.frombuffer(b"".join(held), np.uint8), np.array([len(b) for b in held], np.int64))
    return pd.Series(state.view(np.int64), dtype="Int64").mask(text.isna().to_numpy())


@F.arrow_udf(T.LongType())
def geometry_fingerprint(points: pa.Array) -> pa.Array:
    """FNV-1a over a line or ring, in order: the number of points as 8 bytes, then the two coordinates of each as 4-byte floats,
    all little-endian; a signed bit pattern. Null for null; null points and coordinates count as NaN."""
    counts = pc.fill_null(pc.list_value_length(points), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = points.flatten()
    pairs = np.stack([pc.cast(flat.field(i), pa.float32(), safe=False).to_numpy(zero_copy_only=False) for i in (0, 1)], axis=1) if len(flat) else np.zeros((0, 2), np.float32)
    sizes = 8 + 8 * counts
    data = np.zeros(int(sizes.sum()), np.uint8)
    start = np.cumsum(sizes) - sizes
    head = (start[:, None] + np.arange(8)).ravel()
    data[head] = counts.astype("<u8").view(np.uint8)
    body = np.ones(len(data), np.bool_)
    body[head] = False
    data[body] = np.ascontiguousarray(pairs.astype("<f4")).view(np.uint8).ravel()
    return pa.array(fnv1a64_of(data, sizes).view(np.int64), mask=points.is_null().to_numpy(zero_copy_only=False))


@F.pandas_udf(T.DoubleType())
def _grid_noise(row: pd.Series, column: pd.Series, seed: pd.Series, lane: pd.Series) -> pd.Series:
    with np.errstate(over="ignore"):
        key = (row.to_numpy(np.int64).view(np.uint64) & np.uint64(0xFFFFFFFF)) << np.uint64(32) | (column.to_numpy(np.int64).view(np.uint64) & np.uint64(0xFFFFFFFF))
        mixed = key ^ seed.to_numpy(np.int64).view(np.uint64) * np.uint64(SEED_MULTIPLIER)
    lanes = lane.to_numpy()
    out = np.zeros(len(mixed))
    for k in np.unique(lanes):
        out[lanes == k] = noise(mixed[lanes == k], int(k))
    return pd.Series(out)


def grid_noise(row: Column, column: Column, seed: Column, lane: Column) -> Column:
    """0..1, the same for a grid point from all pieces that share it."""
    return _grid_noise(*(c.cast("long") for c in (row, column, seed, lane)))
