"""Queries of counting filters over the rows put into them, with the headers' own sizes and thresholds."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftloom.functions import hashing
from siftloom.operators import blocks, counting
from siftloom.operators.filters import CountingFilter
from siftloom.plans.common import SQL_INSERTED, inserted, sql_block, sql_hash
from siftloom.plans.membership import _path
from siftloom.session import durable, table
from siftloom.sources import filterfile

#: Where a header names no number of hashes.
DEFAULT_H = 4
#: Bytes an element of the filter that is built from its bytes, which has one byte more.
BYTES = 24


def _headers(spark: SparkSession, d: str) -> DataFrame:
    """(filter_id, m, h, bits, threshold); the size counts counters."""
    return table(spark, d, "counting_filter").select("filter_id", F.col("BloomFilterSize").alias("m"), F.coalesce("HashNum", F.lit(DEFAULT_H)).alias("h"), F.col("BitsPerCounter").alias("bits"), "threshold")


def _tallied(spark: SparkSession, d: str) -> DataFrame:
    # The headers are joined after the tally: a few rows a filter, whatever Catalyst makes of the join.
    return counting.tally(inserted(spark, d), "element", ["filter_id"]).join(_headers(spark, d), "filter_id")


def _counters(spark: SparkSession, d: str) -> DataFrame:
    return counting.increment_all(_tallied(spark, d), "element", ["filter_id"], F.col("m"), F.col("h"), F.col("bits"))


def cbf_increment_all(spark: SparkSession, d: str) -> DataFrame:
    return _counters(spark, d)


def cbf_counters(spark: SparkSession, d: str) -> DataFrame:
    """The counter at every position of each element, by the number of the hash."""
    at = _tallied(spark, d).select("filter_id", "element", F.posexplode(hashing.positions(F.col("element"), F.col("m"), F.col("h"))).alias("i", "pos"))
    return at.join(_counters(spark, d), ["filter_id", "pos"], "left").select("filter_id", "element", F.col("i").cast("bigint").alias("i"), "pos", F.coalesce("cnt", F.lit(0)).alias("cnt"))


def _min_counts(spark: SparkSession, d: str) -> DataFrame:
    return counting.min_count(_tallied(spark, d), "element", ["filter_id"], _counters(spark, d), F.col("m"), F.col("h"), ["threshold"])


def cbf_min_count(spark: SparkSession, d: str) -> DataFrame:
    return _min_counts(spark, d).select("filter_id", "element", "min_count")


def cbf_contains(spark: SparkSession, d: str) -> DataFrame:
    return _min_counts(spark, d).select("filter_id", "element", counting.contains("threshold").alias("hit"))


def cbf_semi_join(spark: SparkSession, d: str) -> DataFrame:
    """Rows whose element the filter holds at its threshold."""
    held = _min_counts(spark, d).where(counting.contains("threshold")).select("filter_id", "element")
    return inserted(spark, d).join(held, ["filter_id", "element"], "left_semi").select("seq_id", "pos", "filter_id", "element")


def cbf_stats(spark: SparkSession, d: str) -> DataFrame:
    out = counting.stats(_counters(spark, d), _headers(spark, d), ["filter_id"])
    return out.select("filter_id", "pop", "filtered_pop", F.round("fpr", 9).alias("fpr"), F.round("filtered_fpr", 9).alias("filtered_fpr"))


def cbf_conservative(spark: SparkSession, d: str) -> DataFrame:
    return counting.conservative(_tallied(spark, d), "element", ["filter_id"], F.col("m"), F.col("h"), F.col("bits"))


def cbf_insert_and_check(spark: SparkSession, d: str) -> DataFrame:
    return counting.insert_and_check(_tallied(spark, d), "element", ["filter_id"], F.col("m"), F.col("h"), F.col("bits"), F.col("threshold"))


def cbf_of_bytes(spark: SparkSession, d: str) -> DataFrame:
    """Elements asked of a filter of so many bytes, no multiple of 8, and 16-bit counters over all rows, whatever their filter."""
    rows = inserted(spark, d)
    size = rows.agg(F.countDistinct("element")).first()[0] * BYTES + 1
    f = CountingFilter.of_bytes(rows, "element", size, DEFAULT_H, 31, threshold=2, bits=16)
    return f.min_count(rows, "element").select("element", "min_count", (F.col("min_count") >= f.threshold).alias("hit"), F.lit(f.shape.m).cast("bigint").alias("m"))


def cbf_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Counters of every filter after they were stored, each in its file, and loaded. Headers are few: one file each."""
    counters, out = durable(_counters(spark, d), "counters"), None
    for f in _headers(spark, d).orderBy("filter_id").toLocalIterator():
        path = _path(spark, f"counters-{uuid.uuid4().hex}")
        filterfile.write_counting_filter(path, counters.where(F.col("filter_id") == f.filter_id), f.m, f.h, 31, f.bits)
        loaded = filterfile.read_counting_filter(spark, path, f.bits)[1].select(F.lit(f.filter_id).alias("filter_id"), "pos", "cnt")
        out = loaded if out is None else out.unionByName(loaded)
    return out


QUERIES = (cbf_increment_all, cbf_counters, cbf_min_count, cbf_contains, cbf_semi_join, cbf_stats, cbf_conservative, cbf_insert_and_check, cbf_of_bytes, cbf_roundtrip)

_BASE = f"""WITH {SQL_INSERTED},
headers AS (SELECT filter_id, BloomFilterSize AS m, coalesce(HashNum, {DEFAULT_H}) AS h, BitsPerCounter AS bits, threshold FROM counting_filter),
tallied AS (SELECT filter_id, element, count(*) AS n FROM inserted GROUP BY ALL),
placed AS (SELECT filter_id, element, n, i, bits, threshold, {sql_hash("element", "i")} % m AS pos FROM (SELECT *, unnest(range(0, h)) AS i FROM tallied JOIN headers USING (filter_id))),
counters AS (SELECT filter_id, pos, least(sum(n), pow(2, max(bits)) - 1)::BIGINT AS cnt FROM placed GROUP BY filter_id, pos),
mins AS (SELECT filter_id, element, threshold, min(cnt) AS min_count FROM placed JOIN counters USING (filter_id, pos) GROUP BY ALL)"""

#: Conservative update: step by step, the n-th element of every block at once. `state` keeps one row a counter, the last
#: one wins; the row at -1 counts the steps, those
#: below it keep the minimum that each element found.
_FOLDED = f"""{_BASE.replace("WITH ", "WITH RECURSIVE ", 1)},
own AS (SELECT filter_id, element, n, h, m, pow(2, bits)::BIGINT - 1 AS top, threshold, greatest(m // {blocks.SLOTS}, 1) AS b FROM tallied JOIN headers USING (filter_id)),
located AS (SELECT *, {sql_block("element", "b")} AS block, m // b AS per FROM own),
ordered AS (SELECT *, row_number() OVER (PARTITION BY filter_id, block ORDER BY element) AS turn, row_number() OVER () AS eid, dense_rank() OVER (ORDER BY filter_id) * 1000000000000 AS base FROM located),
steps AS MATERIALIZED (SELECT turn, list(struct_pack(eid := eid, n := n, top := top,
  slots := list_transform(range(0, h), lambda i: base + block * per + {sql_hash("element", "i")} % per))) AS xs FROM ordered GROUP BY turn),
state(slot, cnt) USING KEY (slot) AS (
  SELECT -1::BIGINT, 0::BIGINT
  UNION ALL
  (WITH now AS (SELECT cnt + 1 AS turn FROM state WHERE slot = -1),
   x AS (SELECT unnest(xs) AS x FROM steps JOIN now USING (turn)),
   s AS (SELECT x.eid AS eid, x.n AS n, x.top AS top, unnest(x.slots) AS slot FROM x),
   v AS (SELECT s.*, coalesce(r.cnt, 0) AS cnt FROM s LEFT JOIN recurring.state r USING (slot)),
   t AS (SELECT eid, slot, cnt, min(cnt) OVER (PARTITION BY eid) AS found, least(min(cnt) OVER (PARTITION BY eid) + n, top) AS target FROM v)
   SELECT slot, target FROM t WHERE cnt < target
   UNION ALL SELECT DISTINCT -1 - eid, found FROM t
   UNION ALL SELECT -1, turn FROM now WHERE turn <= (SELECT max(turn) FROM steps)))"""

ORACLES = {
    "cbf_conservative": _FOLDED + """, names AS (SELECT DISTINCT filter_id, base FROM ordered)
SELECT filter_id, slot - base AS pos, cnt FROM state JOIN names ON slot // 1000000000000 = base // 1000000000000 WHERE slot >= 0""",
    "cbf_insert_and_check": _FOLDED + """ SELECT filter_id, element, n, greatest(0, n - CASE WHEN threshold <= top THEN greatest(0, threshold - cnt) ELSE n END)::BIGINT AS n_present
FROM ordered JOIN state ON slot = -1 - eid""",
    "cbf_of_bytes": f"""WITH {SQL_INSERTED}, tallied AS (SELECT element, count(*) AS n FROM inserted GROUP BY element),
size AS (SELECT ((count(*) * {BYTES} + 1 + 7) // 8 * 8) // 2 AS m FROM tallied),
placed AS (SELECT element, n, m, {sql_hash("element", "i")} % m AS pos FROM tallied, (SELECT unnest(range(0, {DEFAULT_H})) AS i), size),
counters AS (SELECT pos, least(sum(n), 65535)::BIGINT AS cnt FROM placed GROUP BY pos)
SELECT element, min(cnt) AS min_count, min(cnt) >= 2 AS hit, any_value(m)::BIGINT AS m FROM placed JOIN counters USING (pos) GROUP BY element""",
    "cbf_increment_all": _BASE + " SELECT * FROM counters",
    "cbf_counters": _BASE + " SELECT filter_id, element, i, pos, cnt FROM placed JOIN counters USING (filter_id, pos)",
    "cbf_min_count": _BASE + " SELECT filter_id, element, min_count FROM mins",
    "cbf_contains": _BASE + " SELECT filter_id, element, min_count >= threshold AS hit FROM mins",
    "cbf_semi_join": _BASE + " SELECT seq_id, pos, filter_id, element FROM inserted SEMI JOIN (SELECT filter_id, element FROM mins WHERE min_count >= threshold) USING (filter_id, element)",
    "cbf_stats": _BASE
    + """, s AS (SELECT filter_id, m, h, threshold, count(*) FILTER (cnt > 0) AS pop, count(*) FILTER (cnt >= threshold) AS reached FROM headers LEFT JOIN counters USING (filter_id) GROUP BY ALL),
t AS (SELECT *, CASE WHEN threshold <= 0 THEN m ELSE reached END AS filtered_pop FROM s)
SELECT filter_id, pop, filtered_pop, round(pow(pop / m::DOUBLE, h), 9) AS fpr, round(pow(filtered_pop / m::DOUBLE, h), 9) AS filtered_fpr FROM t""",
    "cbf_roundtrip": _BASE + " SELECT * FROM counters",
}
