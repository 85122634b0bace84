"""Problem 6: distinct counts over huge identifier sets.

Method: linear counting. Each identifier sets one hashed bit of a bitmap of m bits; bitmaps merge by bitwise union, and the
distinct count is -m ln(share of empty bits). m is the smallest power of two whose standard error at the largest possible union
stays below a target; a bitmap may be far fuller than half, and takes less than a bit an identifier when there are millions. A
bitmap is kept as its 64-bit words that are not zero, one row each, so that the union is a grouped bit_or, small groups
cost few rows, and groups of many more identifiers than words are reduced before the shuffle.

Bitmaps of one m merge, so groups that are to be united are sized together, by the rows of their union. sized() counts those rows
in a fixed number of hashed cells, which the driver gets; two groups in one cell are only sized too large.

Defined cases: null identifiers count nothing; an empty group has no words and an estimate of 0; a full bitmap has no
estimate (null) and no upper bound; repeated rows change nothing; extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


CELLS = 4096
CELL_STEP = 1637
#: Identifiers a bit at most: beyond, hardly an empty bit is left to count by.
MOST_FULL = 8.0


def relative_error(n: float, m: int) -> float:
    """Standard error of the estimate, relative to n."""
    t = n / m
    return math.sqrt(m * (math.expm1(t) - t)) / n if n else 0.0


def bits_for(n: int, error: float) -> int:
    """The smallest power of two, 64 at least, whose bitmap holds up to n identifiers at the target error. The error falls with n."""
    m = 64
    while n / m > MOST_FULL or relative_error(max(n, 1), m) > error or relative_error(1, m) > error:
        m *= 2
    return m


def _hex(digits: Column, start: int, n: int) -> Column:
    return F.conv(F.substring(digits, start, n), 16, 10).cast("bigint")


def hashed(key: Column) -> Column:
    """60 bits of md5; the same in any SQL engine with md5."""
    return _hex(F.md5(key), 1, 15)


def cell(group: Column, part: Column | None = None) -> Column:
    """One of CELLS cells of a group, or of a numbered part of it."""
    at = _hex(F.md5(group), 1, 3)
    return at if part is None else F.pmod(at + part * CELL_STEP, F.lit(CELLS))


def sized(rows: DataFrame, group: str, part: str, error: float) -> tuple[Column, Column]:
    """Bits of the bitmap of a group, and of a part of it: columns of group and part, over literals of CELLS sizes each. Rows are
    counted whether they carry an identifier or not, so that only these two columns are read."""
    each = rows.where(F.col(group).isNotNull()).groupBy(group, part).agg(F.count(F.lit(1)).alias("n"))
    cells = F.array(F.struct(F.lit(0).alias("level"), cell(F.col(group)).alias("cell")), F.struct(F.lit(1).alias("level"), cell(F.col(group), F.col(part)).alias("cell")))
    found = each.select("n", F.explode(cells).alias("c")).where("c.cell is not null").groupBy("c.level", "c.cell").agg(F.sum("n").alias("n")).collect()  # 2 x CELLS rows at most
    least = bits_for(1, error)
    tables = [[least] * CELLS, [least] * CELLS]
    for r in found:
        tables[r.level][r.cell] = bits_for(r.n, error)
    whole, parts = map(numbers, tables)
    return F.get(whole, cell(F.col(group)).cast("int")), F.get(parts, cell(F.col(group), F.col(part)).cast("int"))


def numbers(values: list[int]) -> Column:
    """A literal array."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def words(rows: DataFrame, groups: list[str], key: str, m: str, carry: bool = True) -> DataFrame:
    """(groups, m, word, bits): the bitmap of each group. m: the column with its number of bits, a power of two; not carried, where the
    groups tell it."""
    kept = [*groups, m] if carry else groups
    at = rows.where(F.col(key).isNotNull()).select(*kept, hashed(F.col(key)).bitwiseAND(F.col(m) - 1).alias("__at"))
    placed = at.select(*kept, F.expr("shiftright(__at, 6)").alias("word"), F.expr("shiftleft(1L, cast(__at & 63 as int))").alias("__bit"))
    return placed.groupBy(*kept, "word").agg(F.bit_or("__bit").alias("bits"))


def union(bitmaps: DataFrame, groups: list[str], m: str) -> DataFrame:
    """The same for coarser groups, or for groups of groups."""
    return bitmaps.groupBy(*groups, m, "word").agg(F.bit_or("bits").alias("bits"))


def estimates(bitmaps: DataFrame, groups: list[str], m: str, sigmas: float = 6.0) -> DataFrame:
    """(groups, m, ones, estimate, low, high): the estimate with bounds of so many standard errors."""
    counted = bitmaps.groupBy(*groups, m).agg(F.sum(F.bit_count("bits")).cast("bigint").alias("ones"))
    return bounded(counted, m, sigmas)


def bounded(counted: DataFrame, m: str, sigmas: float = 6.0) -> DataFrame:
    size = F.col(m).cast("double")
    n = F.when(F.col("ones") < F.col(m), -size * F.log(1 - F.col("ones") / size))
    t = F.col("estimate") / size
    spread = F.sqrt(size * (F.expm1(t) - t)) * sigmas + F.when(F.col("ones") > 1, 1.0).otherwise(0.0)
    out = counted.withColumn("estimate", n).withColumn("__s", spread)
    return out.withColumns({"low": F.greatest(F.col("ones").cast("double"), F.col("estimate") - F.col("__s")), "high": F.col("estimate") + F.col("__s")}).withColumn("low", F.coalesce("low", F.col("ones").cast("double"))).drop("__s")
