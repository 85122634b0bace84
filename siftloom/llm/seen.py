"""Problem 2: has this key been seen before?

Method: scalable Bloom chains. A chain starts with a small layer; when a layer reaches the number of keys it was sized for, a
layer for twice as many keys at a tighter error rate follows. The error rates sum to a bound that holds however long the history
gets: target x (1 - r) x (1 + r + r^2 + ...) <= target. A given number of hashes is that of every layer, and the layer's bits
follow from it and the layer's rate; without one each layer takes the best number for its rate. Few hashes at a tight rate cost
many bits a key, which the answers state. Records are hash-partitioned by (group, key) and run through the chain of their group
in load order, so only one chain is in memory at a time.

Copies of a key beyond the second within one chunk of a map task are settled there: they are answered at once and skip
the chain, so that a key with a third of all rows does not flood one task. Every repeated key is still put to the chain.

A chain has no false negatives. An exact pass over the records it answered "seen" removes its wrong answers and so also
measures their rate. Keys are compared by two 64-bit hashes with different seeds.

Defined cases: null and empty keys are no records; a null group is a group of its own; a null time counts as the latest;
ties in time are ordered by id; a record delivered again (same id, same key) is one record; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftloom.session import shuffle_partitions

CHUNK = 1 << 16
#: Records of a key that a chunk leaves to the chain: one that is new there, and one that repeats it.
LEADERS = 2
DEFAULT_ERROR = 0.001
#: Keys of a chain's first layer, and how the error rate falls from layer to layer.
FIRST, TIGHTEN = 8, 0.8
#: Keys that are asked together at most.
SLICE = 4096
LATEST = (1 << 63) - 1


class Layer:
    def __init__(self, capacity: int, error: float, hashes: int | None):
        self.capacity, self.error = capacity, error
        self.k = hashes or max(1, round(-math.log2(error)))
        self.m = max(64, math.ceil(-self.k * capacity / math.log1p(-(error ** (1 / self.k)))))
        self.bits = np.zeros((self.m + 7) // 8, np.uint8)
        self.keys = 0

    def _positions(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        i = np.arange(self.k, dtype=np.uint64)[:, None]
        return (a[None, :] + i * (b | np.uint64(1))[None, :] + i * i * i) % np.uint64(self.m)

    def has(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        p = self._positions(a, b)
        return ((self.bits[p >> np.uint64(3)] >> (p & np.uint64(7)).astype(np.uint8)) & 1).all(axis=0)

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        p = self._positions(a, b).ravel()
        np.bitwise_or.at(self.bits, p >> np.uint64(3), (np.uint8(1) << (p & np.uint64(7)).astype(np.uint8)))
        self.keys += len(a)


class BloomChain:
    """Layers that grow geometrically while their error rates tighten."""

    def __init__(self, error: float = DEFAULT_ERROR, hashes: int | None = None, first: int = FIRST, growth: int = 2, tighten: float = TIGHTEN):
        self.error, self.hashes, self.growth, self.tighten = error, hashes, growth, tighten
        self.layers = [Layer(first, error * (1 - tighten), hashes)]

    @property
    def bound(self) -> float:
        """Probability at most that a new key is answered "seen", over all layers so far."""
        return 1 - math.prod(1 - x.error for x in self.layers)

    @property
    def bits(self) -> int:
        return sum(x.m for x in self.layers)

    def has(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        seen = np.zeros(len(a), bool)
        for x in reversed(self.layers):
            rest = np.flatnonzero(~seen)
            if not len(rest):
                break
            seen[rest] = x.has(a[rest], b[rest])
        return seen

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        """New keys, each once."""
        at = 0
        while at < len(a):
            top = self.layers[-1]
            if top.keys >= top.capacity:
                self.layers.append(Layer(top.capacity * self.growth, top.error * self.tighten, self.hashes))
                continue
            n = min(len(a) - at, top.capacity - top.keys)
            top.add(a[at : at + n], b[at : at + n])
            at += n

    def offer(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Answers for keys in order, and adds the new ones, a slice at a time: a slice is asked together, and is small beside the keys
        held, so that nearly every key meets all earlier ones in the bits."""
        seen, at = np.empty(len(a), bool), 0
        while at < len(a):
            to = at + min(SLICE, max(FIRST, sum(x.keys for x in self.layers) // 2))
            seen[at:to] = self._offered(a[at:to], b[at:to])
            at = to
        return seen

    def _offered(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Copies within the slice are asked once the first is added."""
        pairs = np.empty(len(a), dtype=[("a", np.uint64), ("b", np.uint64)])
        pairs["a"], pairs["b"] = a, b
        _, first = np.unique(pairs, return_index=True)
        seen, copy = np.ones(len(a), bool), np.ones(len(a), bool)
        first.sort()
        copy[first] = False
        seen[first] = self.has(a[first], b[first])
        new = first[~seen[first]]
        self.add(a[new], b[new])
        seen[copy] = self.has(a[copy], b[copy])
        return seen


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Within a chunk, keeps the first LEADERS records of each key and answers the others; drops copies of a record."""

    def flush(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(held).sort_by([(c, "ascending") for c in ("grp", "a", "b", "at", "id")])
        code = t["grp"].combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
        a, b, i = (t[c].to_numpy() for c in ("a", "b", "id"))
        same = np.zeros(len(a), bool)
        same[1:] = (code[1:] == code[:-1]) & (a[1:] == a[:-1]) & (b[1:] == b[:-1])
        again = same.copy()
        again[1:] &= i[1:] == i[:-1]
        same = same[~again]
        at = np.arange(len(same))
        place = at - np.maximum.accumulate(np.where(same, 0, at))
        t = t.filter(pa.array(~again)).append_column("settled", pa.array(place >= LEADERS))
        yield from t.to_batches()

    held, rows = [], 0
    for x in batches:
        held.append(x)
        rows += x.num_rows
        if rows >= CHUNK:
            yield from flush(held)
            held, rows = [], 0
    if rows:
        yield from flush(held)


OUT = ["grp", "id", "at", "a", "b", "seen", "bound", "layers", "least_k", "most_k", "bits"]


class _Stream:
    """Runs leaders, which come sorted by group and load order, through one chain at a time."""

    def __init__(self):
        self.chain, self.group, self.last = None, None, None

    def run(self, x: pa.RecordBatch) -> pa.RecordBatch:
        n = x.num_rows
        names = x.column("grp").dictionary_encode(null_encoding="encode")
        code = names.indices.to_numpy()
        a, b, i = (x.column(c).to_numpy() for c in ("a", "b", "id"))
        seen, keep = np.zeros(n, bool), np.ones(n, bool)
        keep[1:] = (code[1:] != code[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (i[1:] != i[:-1])  # not the same record again
        state = np.zeros((5, n))
        starts = [0, *(np.flatnonzero(np.diff(code)) + 1).tolist(), n] if n else []
        for lo, hi in zip(starts, starts[1:]):
            group = names.dictionary[int(code[lo])].as_py()
            if self.chain is None or group != self.group:
                self.group, self.chain = group, BloomChain(x.column("error")[lo].as_py(), x.column("hashes")[lo].as_py())
            elif lo == 0:
                keep[0] = (i[0], a[0], b[0]) != self.last
            at = lo + np.flatnonzero(keep[lo:hi])
            seen[at] = self.chain.offer(a[at].astype(np.uint64), b[at].astype(np.uint64))
            k = [y.k for y in self.chain.layers]
            state[:, lo:hi] = np.array([self.chain.bound, len(k), min(k), max(k), self.chain.bits])[:, None]
        if n:
            self.last = (i[-1], a[-1], b[-1])
        return _rows(x, seen, state).filter(pa.array(keep))


def _rows(x: pa.RecordBatch, seen: np.ndarray, state: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch([*(x.column(c) for c in OUT[:5]), pa.array(seen), pa.array(state[0]), *(pa.array(c.astype(np.int64)) for c in state[1:])], names=OUT)


def _answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    stream = _Stream()
    for x in batches:
        settled = x.column("settled").to_numpy(zero_copy_only=False).astype(bool)
        yield stream.run(x.filter(pa.array(~settled)))
        if settled.any():
            y = x.filter(pa.array(settled))
            yield _rows(y, np.ones(y.num_rows, bool), np.zeros((5, y.num_rows)))


def answers(records: DataFrame, key: Column, group: str, at: str, record_id: str, headers: DataFrame | None = None) -> DataFrame:
    """(grp, id, at, a, b, seen, bound, layers, least_k, most_k, bits): the chain's answer for every record, the bound on wrong ones at that
    time, and the chain's layers, the fewest and most hashes of one, and its bits; zeros where a record skipped the chain.

    headers: (group, error, hashes) of each group; a missing or unusable error rate (not within 0 and 0.5) becomes
    DEFAULT_ERROR, a missing or zero number of hashes the best for the error rate. One row a group; Catalyst picks the join."""
    spark = records.sparkSession
    base = records.select(F.col(group).alias("grp"), F.col(record_id).alias("id"), F.coalesce(F.unix_micros(F.col(at).cast("timestamp")), F.lit(LATEST)).alias("at"), key.alias("key"))
    base = base.where(F.col("key") != "").select("grp", "id", "at", F.xxhash64("key").alias("a"), F.xxhash64(F.lit("second"), "key").alias("b"))
    if headers is None:
        base = base.withColumns({"error": F.lit(DEFAULT_ERROR), "hashes": F.lit(None).cast("int")})
    else:
        usable = headers.groupBy(F.col("group").alias("g")).agg(F.max(F.when((F.col("error") > 0) & (F.col("error") < 0.5), F.col("error"))).alias("error"), F.max(F.when(F.col("hashes") > 0, F.col("hashes"))).alias("hashes"))
        base = base.join(usable, F.col("grp").eqNullSafe(F.col("g")), "left").drop("g").withColumn("error", F.coalesce("error", F.lit(DEFAULT_ERROR)))
    kinds = "grp string, id long, at long, a long, b long, error double, hashes int"
    settled = base.select(F.col("grp").cast("string").alias("grp"), "id", "at", "a", "b", "error", "hashes").mapInArrow(_settle, kinds + ", settled boolean")
    # One pass over the settled rows: those answered already go their own way by id and skip the chain.
    routed = settled.withColumn("way", F.when(F.col("settled"), F.xxhash64("id")).otherwise(F.xxhash64("grp", "a")))
    ordered = routed.repartition(shuffle_partitions(spark), "way").sortWithinPartitions("settled", "grp", "at", "id").drop("way")
    return ordered.mapInArrow(_answer, "grp string, id long, at long, a long, b long, seen boolean, bound double, layers long, least_k long, most_k long, bits long")


def verified(answered: DataFrame) -> DataFrame:
    """Exact check of the answers "seen": (grp, id, a, b) of the records that truly have an earlier one with the same key.

    Only keys that the chain answered "seen" are looked at again."""
    said = answered.where("seen").select("grp", "a", "b", "at", "id")
    wanted = said.select(F.col("grp").alias("g"), F.col("a").alias("x"), F.col("b").alias("y")).distinct()
    same = F.col("grp").eqNullSafe(F.col("g")) & (F.col("a") == F.col("x")) & (F.col("b") == F.col("y"))
    order = F.struct("at", "id")
    firsts = answered.join(wanted, same, "left_semi").groupBy(F.col("grp").alias("g"), F.col("a").alias("x"), F.col("b").alias("y")).agg(F.min(order).alias("first"))
    return said.join(firsts, same).where(order > F.col("first")).select("grp", "id", "a", "b").distinct()
