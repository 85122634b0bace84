"""Bit filters as relations: sparse (filter, pos) rows or packed (filter, bucket, bitmap) rows.

Building is a distinct or a grouped bitmap, probing a join on position, so neither side is ever broadcast or collected;
both merge by union. Elements are taken distinct before they are hashed: membership is a function of the element."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftloom.functions import hashing

#: Bits of one packed bucket, as bitmap_construct_agg makes them.
BUCKET = 32768


def exploded(elements: DataFrame, element: str, m: int | Column, h: int | Column, keep: list[str] | None = None, family: str = hashing.DEFAULT) -> DataFrame:
    """(keep, element, i, pos): the positions of every row."""
    cols = [*(keep or []), element]
    return elements.select(*cols, F.posexplode(hashing.positions(F.col(element).cast("string"), m, h, family)).alias("i", "pos"))


def build(elements: DataFrame, element: str, m: int | Column, h: int | Column, keep: list[str] | None = None, family: str = hashing.DEFAULT) -> DataFrame:
    """(keep, pos): the set bits."""
    base = elements.where(F.col(element).isNotNull())
    return exploded(base, element, m, h, keep, family).select(*(keep or []), "pos").distinct()


def packed(bits: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """(keep, bucket, bitmap): bit p is byte p / 8, mask 1 << p % 8 of the buckets one after another."""
    keep = keep or []
    at = F.col("pos") + 1  # the functions count buckets from one
    rows = bits.select(*keep, (F.bitmap_bucket_number(at) - 1).alias("bucket"), F.bitmap_bit_position(at).alias("bit"))
    return rows.groupBy(*keep, "bucket").agg(F.bitmap_construct_agg("bit").alias("bitmap"))


def unpacked(buckets: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """(keep, pos) back from packed buckets."""
    keep = keep or []
    byte = F.conv(F.hex(F.substring(F.col("bitmap"), F.col("at") + 1, 1)), 16, 10).cast("int")
    bytes_ = buckets.select(*keep, "bucket", "bitmap", F.explode(F.sequence(F.lit(0), F.length("bitmap") - 1)).alias("at")).select(*keep, "bucket", "at", byte.alias("byte")).where("byte > 0")
    bits = bytes_.select(*keep, "bucket", "at", "byte", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("bit")).where(F.expr("shiftright(byte, bit) & 1") == 1)
    return bits.select(*keep, (F.col("bucket") * BUCKET + F.col("at") * 8 + F.col("bit")).alias("pos"))


def union(packed_filters: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Bitwise or over all rows of a group and bucket: filters of one size and hash family."""
    return packed_filters.groupBy(*(keep or []), "bucket").agg(F.bitmap_or_agg("bitmap").alias("bitmap"))


def intersection(bits: list[DataFrame]) -> DataFrame:
    """Common set bits; holds more than the filter of the common elements."""
    out = bits[0]
    for other in bits[1:]:
        out = out.join(other, out.columns, "left_semi")
    return out


def popcount(packed_filters: DataFrame, keep: list[str] | None = None) -> DataFrame:
    return packed_filters.groupBy(*(keep or [])).agg(F.sum(F.bitmap_count("bitmap")).cast("bigint").alias("pop"))


def measured_fpr(pop: Column, m: Column | int, h: Column | int) -> Column:
    lit = lambda x: F.lit(x) if isinstance(x, int) else x
    return F.pow(pop / lit(m).cast("double"), lit(h).cast("double"))


def contains(probes: DataFrame, element: str, bits: DataFrame, m: int | Column, h: int | Column, keep: list[str] | None = None, family: str = hashing.DEFAULT) -> DataFrame:
    """(keep, element, hit) for every distinct element of the probes. keep: columns that bits has too, such as the filter.

    The bits are distinct, so the left join multiplies nothing; hot elements were made one row before."""
    keep = keep or []
    distinct = probes.select(*keep, element).distinct()
    rows = exploded(distinct, element, m, h, keep, family)
    marked = rows.join(bits.withColumn("set", F.lit(True)), [*keep, "pos"], "left")
    return marked.groupBy(*keep, element).agg(F.bool_and(F.coalesce("set", F.lit(False))).alias("hit"))


def semi_join(left: DataFrame, key: str, bits: DataFrame, m: int, h: int, anti: bool = False, family: str = hashing.DEFAULT) -> DataFrame:
    """Rows of left whose key the filter holds (or, anti, surely lacks). Semi: a superset of the exact join; anti: a subset."""
    answers = contains(left.select(F.col(key).alias("__key")).where(F.col("__key").isNotNull()), "__key", bits, m, h, family=family)
    return left.join(answers.where(~F.col("hit") if anti else F.col("hit")), F.col(key) == F.col("__key"), "left_semi")


def insert_and_check(rows: DataFrame, element: str, order: list[str], m: int, h: int, family: str = hashing.DEFAULT, preset: DataFrame | None = None) -> DataFrame:
    """(order, element, present): whether the filter held the element just before it was inserted, in the given order.

    An element is present if each of its bits was set by an earlier row, or before all rows (preset, a table of pos): the
    first row of a bit is a minimum, so there is no pass in sequence. order must be unique; rows repeated in full count
    once. Only the first row of each element can set a bit first, which keeps a hot element from the second join."""
    at = F.struct(*order)
    rows = rows.where(F.col(element).isNotNull()).select(*order, element).distinct()
    first = rows.groupBy(element).agg(F.min(at).alias("at"))
    bits = first.select("at", F.col(element).alias("e"), F.explode(F.array_distinct(hashing.positions(F.col(element).cast("string"), m, h, family))).alias("pos"))
    setters = bits.groupBy("pos").agg(F.min("at").alias("set_at"))
    if preset is None:
        timed = bits.join(setters, "pos")
    else:
        old = preset.select("pos").distinct().withColumn("old", F.lit(True))
        timed = bits.join(setters, "pos").join(old, "pos", "left").withColumn("set_at", F.when(F.col("old").isNull(), F.col("set_at")))
    was = timed.groupBy("e").agg(F.max("set_at").alias("full_at"))
    present = F.col("full_at").isNull() | (F.col("full_at") < at)
    return rows.join(was, F.col(element) == F.col("e")).select(*order, element, present.alias("present"))
