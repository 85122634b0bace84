"""Counting filters as (keep, pos, cnt) rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftloom.functions import hashing
from siftloom.operators import blocks


def top(bits: Column) -> Column:
    """The largest count of so many bits, 63 at most."""
    return F.when(bits >= 63, F.lit((1 << 63) - 1)).otherwise(F.pow(F.lit(2.0), bits.cast("double")).cast("bigint") - 1)


def tally(rows: DataFrame, element: str, keep: list[str]) -> DataFrame:
    """(keep, element, n): equal elements are one row from here on, so a hot one is no hot group later."""
    return rows.where(F.col(element).isNotNull()).groupBy(*keep, element).agg(F.count(F.lit(1)).alias("n"))


def increment_all(tallied: DataFrame, element: str, keep: list[str], m: Column, h: Column, bits: Column, family: str = hashing.DEFAULT) -> DataFrame:
    """(keep, pos, cnt): each insertion adds one at each of its h positions, twice where two of them are equal; counters stop
    at the largest count of their bits. Sums merge; the limit is applied after them."""
    rows = tallied.select(*keep, "n", bits.alias("__bits"), F.explode(hashing.positions(F.col(element).cast("string"), m, h, family)).alias("pos"))
    return rows.groupBy(*keep, "pos").agg(F.least(F.sum("n"), top(F.max("__bits"))).alias("cnt"))


def min_count(probes: DataFrame, element: str, keep: list[str], counters: DataFrame, m: Column, h: Column, carry: list[str] | None = None, family: str = hashing.DEFAULT) -> DataFrame:
    """(keep, element, carry, min_count) of every distinct probe. carry: columns fixed by keep, such as a threshold."""
    carry = carry or []
    rows = probes.where(F.col(element).isNotNull()).select(*keep, element, *carry, m.alias("__m"), h.alias("__h")).distinct()
    at = rows.select(*keep, element, *carry, F.explode(hashing.positions(F.col(element).cast("string"), F.col("__m"), F.col("__h"), family)).alias("pos"))
    return at.join(counters, [*keep, "pos"], "left").groupBy(*keep, element, *carry).agg(F.min(F.coalesce("cnt", F.lit(0))).alias("min_count"))


def contains(threshold: str) -> Column:
    """A threshold of 0 holds everything."""
    return F.col("min_count") >= F.col(threshold)


def stats(counters: DataFrame, headers: DataFrame, keep: list[str]) -> DataFrame:
    """headers: (keep, m, h, threshold). (keep, pop, filtered_pop, fpr, filtered_fpr): counters that are not zero, and those
    at the threshold, where a threshold of 0 counts all m."""
    joined = headers.join(counters, keep, "left").groupBy(*keep, "m", "h", "threshold").agg(
        F.count_if(F.col("cnt") > 0).alias("pop"), F.count_if(F.col("cnt") >= F.col("threshold")).alias("reached")
    )
    filtered = F.when(F.col("threshold") <= 0, F.col("m")).otherwise(F.col("reached"))
    rate = lambda x: F.pow(x / F.col("m").cast("double"), F.col("h").cast("double"))
    return joined.select(*keep, "pop", filtered.alias("filtered_pop"), rate(F.col("pop")).alias("fpr"), rate(filtered).alias("filtered_fpr"))


class Conservative:
    """Raises only the counters that equal the minimum. n insertions of one element in a row set each of its counters to
    max(counter, min(minimum + n, limit)), so each distinct element is one step."""

    def __init__(self):
        self.counters: dict[int, int] = {}

    def raise_to(self, slots: list[int], n: int, limit: int) -> tuple[int, int]:
        least = min(self.counters.get(s, 0) for s in slots)
        target = min(least + n, limit)
        for s in slots:
            if self.counters.get(s, 0) < target:
                self.counters[s] = target
        return least, target

    def step(self, slots: list[int], n: int, limit: int) -> None:
        self.raise_to(slots, n, limit)

    def rows(self):
        return sorted(self.counters.items())


class ConservativeCheck(Conservative):
    """The same, answering for each element how many of its insertions found it at the threshold already."""

    def __init__(self):
        super().__init__()
        self.answers: list[tuple[str, int, int]] = []

    def step(self, element: str, slots: list[int], n: int, limit: int, threshold: int) -> None:
        least, _ = self.raise_to(slots, n, limit)
        # Insertion j (from 0) sees min(least + j, limit).
        missing = max(0, threshold - least) if threshold <= limit else n
        self.answers.append((element, n, max(0, n - missing)))

    def rows(self):
        return self.answers


def _blocked(rows: DataFrame, element: str, m: Column, h: Column, n_blocks: Column | int | None, family: str) -> DataFrame:
    rows = rows.withColumns({"__m": m, "__h": h})
    return blocks.placed(rows, element, F.col("__m"), F.col("__h"), blocks.number(F.col("__m")) if n_blocks is None else n_blocks, family)


def conservative(tallied: DataFrame, element: str, keep: list[str], m: Column, h: Column, bits: Column, n_blocks: Column | int | None = None, family: str = hashing.DEFAULT) -> DataFrame:
    """(keep, pos, cnt) of a filter with conservative update; elements are inserted in their own order, all insertions of an
    element at once. The blocks of a filter, as many as its size gives, are folded side by side."""
    rows = _blocked(tallied.withColumn("__limit", top(bits)), element, m, h, n_blocks, family)
    return blocks.folded(rows, [*keep, "block"], [element], ["slots", "n", "__limit"], Conservative, ", ".join(f"{k} string" for k in keep) + ", block bigint, pos bigint, cnt bigint").drop("block")


def insert_and_check(tallied: DataFrame, element: str, keep: list[str], m: Column, h: Column, bits: Column, threshold: Column, n_blocks: Column | int | None = None, family: str = hashing.DEFAULT) -> DataFrame:
    """(keep, element, n, n_present): how many of the n insertions of each element found it contained."""
    rows = _blocked(tallied.withColumns({"__limit": top(bits), "__t": threshold}), element, m, h, n_blocks, family)
    return blocks.folded(rows, [*keep, "block"], [element], [element, "slots", "n", "__limit", "__t"], ConservativeCheck, ", ".join(f"{k} string" for k in keep) + f", block bigint, {element} string, n bigint, n_present bigint").drop("block")


def conservative_min_count(probes: DataFrame, element: str, keep: list[str], counters: DataFrame, m: Column, h: Column, n_blocks: Column | int | None = None, family: str = hashing.DEFAULT) -> DataFrame:
    """(keep, element, min_count) against a filter of conservative()."""
    rows = probes.where(F.col(element).isNotNull()).select(*keep, element, m.alias("__m"), h.alias("__h")).distinct()
    at = _blocked(rows, element, F.col("__m"), F.col("__h"), n_blocks, family).select(*keep, element, F.explode("slots").alias("pos"))
    return at.join(counters, [*keep, "pos"], "left").groupBy(*keep, element).agg(F.min(F.coalesce("cnt", F.lit(0))).alias("min_count"))
