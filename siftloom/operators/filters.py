"""Filters with what they were built with: size, number of hashes, k-mer length, hash family and spaced seeds stay with the bits,
and filters that were built otherwise do not merge."""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftloom.functions import hashing
from siftloom.operators import bloom, counting
from siftloom.sources import filterfile


def padded(v: float) -> int:
    """Up to a multiple of 64; an exact multiple still gains 64."""
    v = math.floor(v)
    return v + 64 - v % 64


@dataclass(frozen=True)
class Shape:
    m: int
    h: int
    k: int = 0
    family: str = hashing.DEFAULT
    seeds: tuple[str, ...] = ()

    def __post_init__(self):
        if self.m <= 0 or self.m % 8:
            raise ValueError("the size of a filter is a positive multiple of 8")
        if self.h < 1:
            raise ValueError("a filter needs a hash")
        if self.family not in hashing.FAMILIES:
            raise ValueError(f"no hash family {self.family}")
        if self.seeds and (len(self.seeds) != self.h or any(len(s) != self.k for s in self.seeds)):
            raise ValueError("spaced seeds are one a hash, each of k letters")

    @classmethod
    def sized(cls, n: int, fpr: float, h: int = 0, k: int = 0, family: str = hashing.DEFAULT) -> Shape:
        """For n elements at an error rate; h 0 takes the best number of hashes, one at least."""
        if not 0 < fpr < 1:
            raise ValueError("an error rate lies between 0 and 1")
        h = h or max(1, math.floor(-math.log(fpr) / math.log(2.0)))
        return cls(padded(-n * h / math.log(1 - fpr ** (1 / h))), h, k, family)


def _alike(a: Shape, b: Shape) -> None:
    if a != b:
        raise ValueError(f"filters of {a} and {b} do not merge")


@dataclass(frozen=True)
class BitFilter:
    """bits: (pos)."""

    shape: Shape
    bits: DataFrame
    entries: int = 0

    @classmethod
    def of(cls, elements: DataFrame, element: str, shape: Shape) -> BitFilter:
        return cls(shape, bloom.build(elements, element, shape.m, shape.h, family=shape.family))

    @classmethod
    def sized(cls, elements: DataFrame, element: str, fpr: float, h: int = 0, k: int = 0, family: str = hashing.DEFAULT) -> BitFilter:
        """As large as the number of distinct elements needs for the error rate."""
        n = elements.agg(F.countDistinct(element)).first()[0]
        return replace(cls.of(elements, element, Shape.sized(n, fpr, h, k, family)), entries=n)

    def contains(self, probes: DataFrame, element: str) -> DataFrame:
        """(element, hit) of the distinct probes."""
        return bloom.contains(probes, element, self.bits, self.shape.m, self.shape.h, family=self.shape.family)

    def semi_join(self, left: DataFrame, key: str, anti: bool = False) -> DataFrame:
        return bloom.semi_join(left, key, self.bits, self.shape.m, self.shape.h, anti, self.shape.family)

    def union(self, other: BitFilter) -> BitFilter:
        _alike(self.shape, other.shape)
        merged = bloom.union(bloom.packed(self.bits).unionByName(bloom.packed(other.bits)))
        return BitFilter(self.shape, bloom.unpacked(merged))

    def intersection(self, other: BitFilter) -> BitFilter:
        _alike(self.shape, other.shape)
        return BitFilter(self.shape, bloom.intersection([self.bits, other.bits]))

    def popcount(self) -> DataFrame:
        return bloom.popcount(bloom.packed(self.bits))

    def fpr(self) -> DataFrame:
        """(fpr): the rate of wrong answers that the set bits give."""
        return self.popcount().select(bloom.measured_fpr(F.col("pop"), self.shape.m, self.shape.h).alias("fpr"))

    def store(self, path: str, fpr: float = 0.0, inserted: int = 0) -> None:
        filterfile.write_bit_filter(path, bloom.packed(self.bits), self.shape.m, self.shape.h, self.shape.k, fpr, self.entries, inserted)

    @classmethod
    def load(cls, spark: SparkSession, path: str, family: str = hashing.DEFAULT) -> BitFilter:
        """The file names size, hashes and k, but not the family."""
        head, packed = filterfile.read_bit_filter(spark, path)
        return cls(Shape(head["BloomFilterSize"], head["HashNum"], head["KmerSize"], family), bloom.unpacked(packed), head["nEntry"])


@dataclass(frozen=True)
class _Counters(Shape):
    """A number of counters need not be a multiple of 8."""

    def __post_init__(self):
        if self.m <= 0 or self.h < 1:
            raise ValueError("a counting filter needs counters and a hash")


@dataclass(frozen=True)
class CountingFilter:
    """counters: (pos, cnt). shape.m is the number of counters."""

    shape: Shape
    bits: int
    threshold: int
    counters: DataFrame

    @classmethod
    def of_bytes(cls, rows: DataFrame, element: str, size: int, h: int, k: int = 0, threshold: int = 1, bits: int = 8, family: str = hashing.DEFAULT) -> CountingFilter:
        """A filter of so many bytes, taken up to a multiple of 8, each counter taking bits / 8 of them."""
        if bits not in (8, 16, 32, 64):
            raise ValueError("counters have 8, 16, 32 or 64 bits")
        shape = _Counters((size + 7) // 8 * 8 // (bits // 8), h, k, family)
        tallied = counting.tally(rows, element, [])
        counters = counting.increment_all(tallied, element, [], F.lit(shape.m), F.lit(h), F.lit(bits), family)
        return cls(shape, bits, threshold, counters)

    def min_count(self, probes: DataFrame, element: str) -> DataFrame:
        return counting.min_count(probes, element, [], self.counters, F.lit(self.shape.m), F.lit(self.shape.h), family=self.shape.family)

    def contains(self, probes: DataFrame, element: str) -> DataFrame:
        return self.min_count(probes, element).select(element, (F.col("min_count") >= self.threshold).alias("hit"))

    def store(self, path: str) -> None:
        filterfile.write_counting_filter(path, self.counters, self.shape.m, self.shape.h, self.shape.k, self.bits)

    @classmethod
    def load(cls, spark: SparkSession, path: str, threshold: int, family: str = hashing.DEFAULT) -> CountingFilter:
        head, counters = filterfile.read_counting_filter(spark, path)
        return cls(_Counters(head["BloomFilterSize"], head["HashNum"], head["KmerSize"], family), head["BitsPerCounter"], threshold, counters)
