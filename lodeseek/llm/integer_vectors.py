"""Vectors as exact integers: scaling by floor, sums over whole tables, codebook entries from sums.

Tasks add up what they hold and hand on one row for each number that is not 0, so that a shuffle is as
wide as the codebook times the tasks, however many vectors a task or a cluster has.  Numbers travel in
pieces of 40 bits, which Spark adds; no vector is too long or too large for an exact sum.
"""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PIECE = 40
MOST = (1 << 63) - 1
PARTIALS = "slot long, piece int, value long"


def usable(rows: DataFrame, column: str) -> DataFrame:
    """Rows whose vector is there and has neither null nor non-finite components."""
    bad = f"exists({column}, x -> x IS NULL OR isnan(x) OR abs(x) = double('Infinity'))"
    return rows.where(f"{column} IS NOT NULL AND NOT {bad}")


def scaled(values: np.ndarray, factor: int) -> np.ndarray:
    """floor(factor * x) of finite numbers: 64-bit integers, or Python's where those are too short."""
    x = values.astype(np.float64)
    if np.abs(x).max(initial=0) < (1 << 52) / factor:
        return np.floor(factor * x).astype(np.int64)
    return np.array([math.floor(Fraction(float(v)) * factor) for v in x.ravel()], object).reshape(x.shape)


def matrix(vectors: pa.Array, width: int, factor: int) -> np.ndarray:
    """An Arrow list column of ``width`` components a row as scaled integers."""
    return scaled(vectors.flatten().to_numpy(zero_copy_only=False).reshape(-1, width), factor)


def alike(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both with a kind of integer in which squared distances of their rows are exact."""
    top = max(int(np.abs(a).max(initial=0)), int(np.abs(b).max(initial=0)))
    kind = np.int64 if 4 * top * top * max(1, a.shape[-1]) <= MOST else object
    return a.astype(kind), b.astype(kind)


def whole(numbers: list[int], shape: tuple[int, ...]) -> np.ndarray:
    """Integers as an array of a kind that holds them."""
    kind = np.int64 if all(abs(x) <= MOST for x in numbers) else object
    return np.array(numbers, kind).reshape(shape)


def partial_rows(totals: np.ndarray) -> pa.RecordBatch:
    """A task's sums, flattened: a row for each piece that is not 0."""
    slots, pieces, values = [], [], []
    for slot, total in enumerate(totals.ravel().tolist()):
        sign, rest, piece = (1 if total > 0 else -1), abs(total), 0
        while rest:
            if low := rest & ((1 << PIECE) - 1):
                slots.append(slot)
                pieces.append(piece)
                values.append(sign * low)
            rest, piece = rest >> PIECE, piece + 1
    return pa.RecordBatch.from_arrays([pa.array(slots, pa.int64()), pa.array(pieces, pa.int32()), pa.array(values, pa.int64())], names=["slot", "piece", "value"])


def summed(partials: DataFrame, shape: tuple[int, ...]) -> np.ndarray:
    """The sums of all tasks.  The driver gets no more than ``shape`` has numbers, in their pieces."""
    totals = [0] * math.prod(shape)
    for r in partials.groupBy("slot", "piece").agg(F.sum(F.col("value").cast("decimal(20,0)")).alias("value")).collect():
        totals[r.slot] += int(r.value) << (PIECE * r.piece)
    out = np.empty(len(totals), object)
    out[:] = totals
    return out.reshape(shape)


def moved(entries: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """Each entry's new place: the floors of its sums by its count, which stands last in ``sums``; an
    entry without rows stays."""
    new = [[s // row[-1] for s in row[:-1]] if row[-1] else old for old, row in zip(entries.tolist(), sums.tolist())]
    return whole([x for row in new for x in row], entries.shape)
