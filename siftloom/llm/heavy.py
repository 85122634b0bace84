"""Problem 1: the most frequent values of a column in bounded memory.

Method: the values are hashed and counted in chunks before the shuffle, so that a value which holds a third of all rows
arrives as one row a chunk. Each hash partition feeds a count-min sketch with conservative update and keeps the values
with the largest estimates in a bounded heap. A value lives in one partition only, so the heaps are disjoint and merge by
union. An estimate is never below the true count, hence no value of the wanted support is missed. The few candidates are
then counted exactly in a second pass.

Defined cases: null values are no rows; an empty table gives no rows; the empty string is a value like any other; ties all
come out, as the threshold decides and not a rank; other columns of the input are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftloom.session import shuffle_partitions

CHUNK = 1 << 17


class ConservativeSketch:
    """Count-min sketch with conservative update over 64-bit hashes, fed with chunks of distinct hashes."""

    def __init__(self, width: int, depth: int, seed: int = 7):
        self.bits = max(4, math.ceil(math.log2(width)))
        self.table = np.zeros((depth, 1 << self.bits), dtype=np.int64)
        rng = np.random.default_rng(seed)
        self.multipliers = rng.integers(1, 1 << 63, size=depth, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def _cells(self, hashes: np.ndarray) -> list[np.ndarray]:
        x = hashes.astype(np.uint64)
        x = x ^ (x >> np.uint64(31))
        return [((x * m) >> np.uint64(64 - self.bits)).astype(np.int64) for m in self.multipliers]

    def estimate(self, hashes: np.ndarray) -> np.ndarray:
        return np.min([row[c] for row, c in zip(self.table, self._cells(hashes))], axis=0)

    def add(self, hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Raises each value's cells to its old estimate plus its count, and no cell further; returns the new estimates.

        Values of one chunk see the state before the chunk, so no estimate falls below the true count."""
        cells = self._cells(hashes)
        target = np.min([row[c] for row, c in zip(self.table, cells)], axis=0) + counts
        for row, c in zip(self.table, cells):
            np.maximum.at(row, c, target)
        return target


class BoundedHeap:
    """The values with the largest estimates, at most `capacity` of them."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.hashes = np.empty(0, np.int64)
        self.estimates = np.empty(0, np.int64)

    def offer(self, hashes: np.ndarray, estimates: np.ndarray) -> None:
        if len(self.hashes) >= self.capacity:
            keep = (estimates > self.estimates.min()) | np.isin(hashes, self.hashes)
            hashes, estimates = hashes[keep], estimates[keep]
        if not len(hashes):
            return
        old = ~np.isin(self.hashes, hashes)
        h, e = np.concatenate([self.hashes[old], hashes]), np.concatenate([self.estimates[old], estimates])
        if len(h) > self.capacity:
            top = np.argpartition(e, len(e) - self.capacity)[len(e) - self.capacity :]
            h, e = h[top], e[top]
        self.hashes, self.estimates = h, e


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def flush(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(held).group_by("h", use_threads=False).aggregate([("h", "count")])
        yield from t.select(["h", "h_count"]).rename_columns(["h", "n"]).to_batches()

    held, rows = [], 0
    for b in batches:
        held.append(b)
        rows += b.num_rows
        if rows >= CHUNK:
            yield from flush(held)
            held, rows = [], 0
    if rows:
        yield from flush(held)


def _sketched(width: int, depth: int, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch, heap, total = ConservativeSketch(width, depth), BoundedHeap(capacity), 0
        for b in batches:
            if not b.num_rows:
                continue
            h, where = np.unique(b.column(0).to_numpy(), return_inverse=True)
            n = np.bincount(where, weights=b.column(1).to_numpy()).astype(np.int64)
            total += int(n.sum())
            heap.offer(h, sketch.add(h, n))
        # One row with no hash carries the partition's row count.
        yield pa.record_batch(
            [pa.array([None, *heap.hashes.tolist()], pa.int64()), pa.array([0, *heap.estimates.tolist()], pa.int64()), pa.array([total] + [0] * len(heap.hashes), pa.int64())], names=["h", "estimate", "total"]
        )

    return run


def heavy_candidates(values: DataFrame, value: str, support: float, width: int | None = None, depth: int = 4) -> DataFrame:
    """(h, estimate, total): hashes whose estimated count reaches `support` of all `total` rows with a value.

    The heap holds 4 / support values a partition: with an error of support / 2 at most, no more than 2 / support values of a
    partition can reach the threshold, so none is pushed out. The result is bounded by partitions x 4 / support rows."""
    width = width or math.ceil(math.e * 100 / support)
    spark = values.sparkSession
    hashed = values.where(F.col(value).isNotNull()).select(F.xxhash64(F.col(value)).alias("h"))
    heaps = hashed.mapInArrow(_counted, "h long, n long").repartition(shuffle_partitions(spark), "h").mapInArrow(_sketched(width, depth, math.ceil(4 / support)), "h long, estimate long, total long")
    all_rows = heaps.withColumn("total", F.sum("total").over(Window.partitionBy(F.lit(0))))
    return all_rows.where(F.col("h").isNotNull() & (F.col("estimate") >= F.col("total") * F.lit(support)))


def heavy_hitters(values: DataFrame, value: str, support: float = 0.005, width: int | None = None, depth: int = 4) -> DataFrame:
    """(value, estimate, count, total): every value that makes up at least `support` of the non-null rows.

    `estimate` comes from the sketch and is never below `count`, the exact count of the second pass."""
    found = heavy_candidates(values, value, support, width, depth)
    again = values.where(F.col(value).isNotNull()).select(F.col(value).alias("__v"), F.xxhash64(F.col(value)).alias("h"))
    # Broadcast: heavy_candidates is bounded by its heaps, whatever the number of rows.
    counted = again.join(F.broadcast(found), "h").groupBy("__v").agg(F.count(F.lit(1)).alias("count"), F.max("estimate").alias("estimate"), F.max("total").alias("total"))
    return counted.where(F.col("count") >= F.col("total") * F.lit(support)).select(F.col("__v").alias("value"), "estimate", "count", "total")
