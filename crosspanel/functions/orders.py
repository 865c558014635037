"""Ranks and medians in windows of any length, at a cost that doesn't depend on the length.

Rows stream through a task by symbol and t; of the batch before, as many rows are kept as the longest window looks back. A batch's values become dense integers, and these
a wavelet matrix: for every bit, from the highest, how many zeros stand before each place, and the values parted stably by that bit. A range of places
is then followed down the bits: to a value, which gives how many in the range are below it and how many equal to it, or to the k-th smallest in the range. All windows of a
batch go down together, two look-ups a bit, so a window of 250 rows costs what one of 5 does.

Windows count rows of a dense grid; gaps take a place but are no values. NaN is above every number and equals itself, as in Spark's order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..shipping import ship
from .timeseries import by_time

ORDERS = ("ts_rank", "ts_median")


class Wavelet:
    """The order of an array's values within ranges of its places."""

    def __init__(self, values: np.ndarray):
        self.keys, place = np.unique(values, return_inverse=True)
        self.of = place.astype(np.int32)
        self.levels: list[tuple[int, np.ndarray, int]] = []  # bit, zeros before each place, zeros in all
        left = self.of
        for bit in reversed(range(max(1, int(len(self.keys) - 1).bit_length()))):
            zero = (left >> bit & 1) == 0
            before = np.concatenate([np.zeros(1, np.int32), np.cumsum(zero, dtype=np.int32)])
            self.levels.append((bit, before, int(before[-1])))
            left = np.concatenate([left[zero], left[~zero]])

    def below_and_equal(self, lo: np.ndarray, hi: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many in places lo to hi - 1 are below the value (its dense integer), and how many equal to it."""
        below = np.zeros(len(lo), np.int32)
        for bit, before, zeros in self.levels:
            a, b = before[lo], before[hi]
            one = (value >> bit & 1) == 1
            below += np.where(one, b - a, 0)
            lo, hi = np.where(one, lo - a + zeros, a), np.where(one, hi - b + zeros, b)
        return below, hi - lo

    def smallest(self, lo: np.ndarray, hi: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The k-th smallest value, from 0, in places lo to hi - 1; there have to be more than k."""
        found = np.zeros(len(lo), np.int32)
        for bit, before, zeros in self.levels:
            a, b = before[lo], before[hi]
            one = k >= b - a
            k = np.where(one, k - (b - a), k)
            found |= one.astype(np.int32) << bit
            lo, hi = np.where(one, lo - a + zeros, a), np.where(one, hi - b + zeros, b)
        return self.keys[found]


def rolled(values: np.ndarray, present: np.ndarray, row: np.ndarray, asks: list[tuple[str, int]]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Result and whether there is one, for each (function, w), at every place. row: the place in the symbol, from 1; no window begins before the symbol's first row."""
    n = len(values)
    wavelet = Wavelet(values[present])
    before = np.concatenate([np.zeros(1, np.int64), np.cumsum(present)])
    at, out = np.arange(n), []
    for base, w in asks:
        first = np.maximum(at + 1 - np.minimum(w, row), 0)
        lo, hi = before[first], before[1:]
        result, good = np.zeros(n), present if base == "ts_rank" else hi > lo
        lo, hi, count = lo[good], hi[good], (hi - lo)[good]
        if base == "ts_rank":
            below, equal = wavelet.below_and_equal(lo, hi, wavelet.of)
            result[good] = (2 * below + equal + 1) / (2 * count)
        else:
            low = wavelet.smallest(lo, hi, (count - 1) // 2)
            high = wavelet.smallest(lo, hi, count // 2)
            with np.errstate(invalid="ignore"):
                result[good] = np.where(low == high, low, 0.5 * low + 0.5 * high)
        out.append((result, good))
    return out


def with_orders(panel: DataFrame, asks: list[tuple[str, str, int, str]]) -> DataFrame:
    """panel with a double column for every (name, function of ORDERS, w, column): the same rows and values as the functions of `timeseries`."""
    asks, kept = list(asks), panel.columns
    ship(panel.sparkSession)
    look_back = max(w for _, _, w, _ in asks) - 1
    of: dict[str, list[int]] = {}
    for i, a in enumerate(asks):
        of.setdefault(a[3], []).append(i)
    place = {c: kept.index(c) for c in of}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        past = {c: (np.zeros(0), np.zeros(0, bool)) for c in of}
        rows = np.zeros(0, np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            seen = len(rows)
            rows = np.concatenate([rows, batch.column(batch.num_columns - 1).to_numpy()])
            made: list[pa.Array] = [None] * len(asks)
            for c, which in of.items():
                column = batch.column(place[c]).cast(pa.float64())
                values = np.concatenate([past[c][0], column.to_numpy(zero_copy_only=False)])
                present = np.concatenate([past[c][1], column.is_valid().to_numpy(zero_copy_only=False)])
                for i, (result, good) in zip(which, rolled(values, present, rows, [asks[i][1:3] for i in which]), strict=True):
                    made[i] = pa.array(result[seen:], pa.float64(), mask=~good[seen:])
                past[c] = values[len(values) - min(look_back, len(values)) :], present[len(values) - min(look_back, len(values)) :]
            rows = rows[len(rows) - min(look_back, len(rows)) :]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *made], names)

    names = [*kept, *[a[0] for a in asks]]
    schema = StructType([*panel.schema.fields, *[StructField(a[0], DoubleType()) for a in asks]])
    lined = panel.withColumn("_row", F.row_number().over(by_time()).cast("bigint")).sortWithinPartitions("symbol", "t")
    return lined.mapInArrow(run, schema)
