"""Queries of bit filters over the business tables and the event stream."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftloom.functions import sizing
from siftloom.operators import bloom
from siftloom.operators.filters import BitFilter, Shape
from siftloom.plans.common import sql_hash, sql_optimal_size
from siftloom.session import durable, mounted_dir, shared_dir, table
from siftloom.sources import filterfile
from siftloom.streaming.first_seen import SeenFilter, deduplicated

#: Error rate and number of hashes of the filters, which are sized by their members; high enough for some answers to be wrong,
#: so that errors are compared too.
FPR, H = 0.03, 4
#: Hashes of the filter over users.
USER_H = 3


def _members(spark: SparkSession, d: str, small: bool = True) -> DataFrame:
    """Keys of the parts of a size class: the members of the filter."""
    size = F.col("p_size") <= 10 if small else F.col("p_size") >= 40
    return table(spark, d, "part").where(size).select(F.col("p_partkey").cast("string").alias("key"))


def _filter(spark: SparkSession, d: str) -> BitFilter:
    return BitFilter.sized(_members(spark, d), "key", FPR, H)


def _pair(spark: SparkSession, d: str) -> tuple[BitFilter, BitFilter]:
    """The filters of both size classes, of one shape, sized for all members of either."""
    sides = [_members(spark, d, small) for small in (True, False)]
    n = sides[0].unionByName(sides[1]).agg(F.countDistinct("key")).first()[0]
    shape = Shape.sized(n, FPR, H)
    return BitFilter.of(sides[0], "key", shape), BitFilter.of(sides[1], "key", shape)


def bf_build(spark: SparkSession, d: str) -> DataFrame:
    return _filter(spark, d).bits


def bf_from_fpr(spark: SparkSession, d: str) -> DataFrame:
    """What a filter of a wanted error rate is built with, and the rate that its bits give."""
    f = _filter(spark, d)
    head = (F.lit(x).cast("bigint").alias(c) for c, x in (("n", f.entries), ("m", f.shape.m), ("h", f.shape.h)))
    return f.popcount().select(*head, "pop", F.round(bloom.measured_fpr(F.col("pop"), f.shape.m, f.shape.h), 9).alias("fpr"))


def bf_bytes(spark: SparkSession, d: str) -> DataFrame:
    """(byte, value) of the packed form, bytes of no bit left out."""
    packed = bloom.packed(_filter(spark, d).bits)
    value = F.conv(F.hex(F.substring("bitmap", F.col("at") + 1, 1)), 16, 10).cast("int")
    return packed.select("bucket", "bitmap", F.explode(F.sequence(F.lit(0), F.length("bitmap") - 1)).alias("at")).select((F.col("bucket") * 4096 + F.col("at")).alias("byte"), value.alias("value")).where("value > 0")


def bf_popcount(spark: SparkSession, d: str) -> DataFrame:
    return _filter(spark, d).popcount()


def bf_fpr(spark: SparkSession, d: str) -> DataFrame:
    return _filter(spark, d).fpr().select(F.round("fpr", 9).alias("fpr"))


def bf_contains(spark: SparkSession, d: str) -> DataFrame:
    probes = table(spark, d, "lineitem").select(F.col("l_partkey").cast("string").alias("key"))
    return _filter(spark, d).contains(probes, "key").select(F.col("key").cast("bigint").alias("l_partkey"), "hit")


def bf_measured_fpr(spark: SparkSession, d: str) -> DataFrame:
    """Rate of wrong answers over all order keys that are no members, beside the modelled one."""
    f = _filter(spark, d)
    probes = table(spark, d, "orders").select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("key"))
    wrong = f.contains(probes, "key").agg(F.count(F.lit(1)).alias("probes"), F.count_if("hit").alias("wrong"))
    modelled = sizing.modelled_fpr(F.lit(f.shape.m), F.lit(f.entries), F.lit(f.shape.h))
    return wrong.select("probes", "wrong", F.round(F.col("wrong") / F.col("probes"), 9).alias("measured"), F.round(modelled, 9).alias("modelled"))


def bf_contains_xx64(spark: SparkSession, d: str) -> DataFrame:
    """Members asked of a filter of the engine's own hash: all are found."""
    members = _members(spark, d)
    f = BitFilter.sized(members, "key", FPR, H, family="xx64")
    return f.contains(members, "key").select(F.col("key").cast("bigint").alias("p_partkey"), "hit")


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")


def bf_semi_join(spark: SparkSession, d: str) -> DataFrame:
    return _filter(spark, d).semi_join(_lines(spark, d), "l_partkey")


def bf_anti_join(spark: SparkSession, d: str) -> DataFrame:
    return _filter(spark, d).semi_join(_lines(spark, d), "l_partkey", anti=True)


def bf_prefilter_join(spark: SparkSession, d: str) -> DataFrame:
    """An exact join behind the filter: rows that the filter rules out do not reach it. Answers equal the plain join."""
    lines = table(spark, d, "lineitem").select("l_partkey", "l_quantity")
    kept = _filter(spark, d).semi_join(lines, "l_partkey")
    parts = table(spark, d, "part").where(F.col("p_size") <= 10).select("p_partkey", "p_brand")
    return kept.join(parts, F.col("l_partkey") == F.col("p_partkey")).groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


def bf_union(spark: SparkSession, d: str) -> DataFrame:
    small, large = _pair(spark, d)
    return small.union(large).bits


def bf_intersect(spark: SparkSession, d: str) -> DataFrame:
    small, large = _pair(spark, d)
    return small.intersection(large).bits


def _user_size(spark: SparkSession, d: str) -> int:
    n = table(spark, d, "events").agg(F.countDistinct("user_id")).first()[0]
    return Shape.sized(n, FPR, USER_H).m


def bf_insert_and_check(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events").select("ts", "event_id", F.col("user_id").cast("string").alias("user_id"))
    out = bloom.insert_and_check(events, "user_id", ["ts", "event_id"], _user_size(spark, d), USER_H)
    return out.select("event_id", F.col("user_id").cast("bigint").alias("user_id"), "present")


def _path(spark: SparkSession, kind: str) -> str:
    return f"{mounted_dir(spark)}/{kind}-{uuid.uuid4().hex}.filter"


def bf_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Set bits of the filter after it was stored and loaded."""
    path = _path(spark, "bits")
    _filter(spark, d).store(path, FPR)
    return BitFilter.load(spark, path).bits


def bf_raw_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    path = _path(spark, "raw")
    f = _filter(spark, d)
    filterfile.write_raw_filter(path, bloom.packed(f.bits), f.shape.m)
    return bloom.unpacked(filterfile.read_raw_filter(spark, path, f.shape.m))


def _stream(spark: SparkSession, d: str, base: str) -> DataFrame:
    """The events as a stream in micro-batches of one file each, in the order of time."""
    source = table(spark, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_id", F.col("user_id").cast("string").alias("user_id"))
    # A file source takes files by age, so the parts are written one after another.
    cuts = source.agg(F.percentile_approx(F.unix_micros("ts"), [0.25, 0.5, 0.75])).first()[0] or [0, 0, 0]
    part = sum((F.unix_micros("ts") > c).cast("int") for c in cuts)
    for i in range(4):
        source.where(part == i).coalesce(1).write.mode("append").parquet(f"{base}/in")
    return spark.readStream.schema(source.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")


def stream_first_seen(spark: SparkSession, d: str) -> DataFrame:
    """The event stream answered against a filter that grows, its bits compacted every second batch."""
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    seen = SeenFilter(f"{base}/bits", _user_size(spark, d), USER_H, every=2)
    sink = seen.sink("user_id", ["ts", "event_id"], lambda out, n: out.write.mode("overwrite").parquet(f"{base}/out/batch={n}"))
    query = _stream(spark, d, base).writeStream.foreachBatch(sink).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return durable(spark.read.parquet(f"{base}/out").select("event_id", F.col("user_id").cast("bigint").alias("user_id"), "present"), "seen")


def stream_deduplicated(spark: SparkSession, d: str) -> DataFrame:
    """Each user of the event stream once, exactly, under a watermark that spans the events."""
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    once = deduplicated(_stream(spark, d, base), "user_id", "ts", "10000 days")
    query = once.select("user_id").writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema("user_id string").parquet(f"{base}/out").select(F.col("user_id").cast("bigint").alias("user_id"))


QUERIES = (bf_contains, bf_contains_xx64, bf_measured_fpr, bf_build, bf_from_fpr, bf_bytes, bf_popcount, bf_fpr, bf_semi_join, bf_anti_join, bf_prefilter_join, bf_union, bf_intersect, bf_insert_and_check, bf_roundtrip, bf_raw_roundtrip, stream_first_seen, stream_deduplicated)

_H = sql_hash("key", "i")
_SIZE = f"m AS (SELECT {sql_optimal_size('SELECT count(DISTINCT key) FROM members', FPR, H)} AS m)"
_BOTH = f"m AS (SELECT {sql_optimal_size('SELECT count(DISTINCT key) FROM (FROM members UNION ALL FROM others)', FPR, H)} AS m)"
_FILTER = """members AS (SELECT p_partkey::VARCHAR AS key FROM part WHERE p_size <= 10),
others AS (SELECT p_partkey::VARCHAR AS key FROM part WHERE p_size >= 40),
n AS (SELECT unnest(range(0, {h})) AS i), {size},
bits AS (SELECT DISTINCT {hash} % m AS pos FROM members, n, m), other_bits AS (SELECT DISTINCT {hash} % m AS pos FROM others, n, m),
probes AS (SELECT DISTINCT {probe} AS key FROM {of}),
answers AS (SELECT key, bool_and(b.pos IS NOT NULL) AS hit FROM (SELECT key, {hash} % m AS pos FROM probes, n, m) p LEFT JOIN bits b USING (pos) GROUP BY key)"""
_LINES = _FILTER.format(h=H, size=_SIZE, hash=_H, probe="l_partkey::VARCHAR", of="lineitem")
_ORDERS = _FILTER.format(h=H, size=_SIZE, hash=_H, probe="'o' || o_orderkey::VARCHAR", of="orders")
_PAIRED = _FILTER.format(h=H, size=_BOTH, hash=_H, probe="l_partkey::VARCHAR", of="lineitem")
_JOINED = "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem JOIN answers ON key = l_partkey::VARCHAR WHERE "

ORACLES = {
    "bf_build": f"WITH {_LINES} SELECT pos FROM bits",
    "bf_from_fpr": f"WITH {_LINES} SELECT (SELECT count(DISTINCT key) FROM members) AS n, m, {H}::BIGINT AS h, pop, round(pow(pop / m::DOUBLE, {H}), 9) AS fpr FROM (SELECT count(*) AS pop FROM bits), m",
    "bf_bytes": f"WITH {_LINES} SELECT pos // 8 AS byte, sum(1 << (pos % 8)::INTEGER)::INTEGER AS value FROM bits GROUP BY pos // 8",
    "bf_popcount": f"WITH {_LINES} SELECT count(*) AS pop FROM bits",
    "bf_fpr": f"WITH {_LINES} SELECT round(pow(pop / m::DOUBLE, {H}), 9) AS fpr FROM (SELECT count(*) AS pop FROM bits), m",
    "bf_contains": f"WITH {_LINES} SELECT key::BIGINT AS l_partkey, hit FROM answers",
    "bf_contains_xx64": "SELECT DISTINCT p_partkey, true AS hit FROM part WHERE p_size <= 10",
    "bf_measured_fpr": f"""WITH {_ORDERS} SELECT probes, wrong, round(wrong / probes, 9) AS measured,
  round(pow(1 - pow(1 - 1.0::DOUBLE / m, (SELECT count(DISTINCT key) FROM members)::DOUBLE * {H}), {H}), 9) AS modelled FROM (SELECT count(*) AS probes, count(*) FILTER (hit) AS wrong FROM answers), m""",
    "bf_semi_join": f"WITH {_LINES} {_JOINED} hit",
    "bf_anti_join": f"WITH {_LINES} {_JOINED} NOT hit",
    "bf_prefilter_join": "SELECT p_brand, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size <= 10 GROUP BY p_brand",
    "bf_union": f"WITH {_PAIRED} SELECT pos FROM bits UNION SELECT pos FROM other_bits",
    "bf_intersect": f"WITH {_PAIRED} SELECT pos FROM bits INTERSECT SELECT pos FROM other_bits",
    "bf_insert_and_check": f"""WITH m AS (SELECT {sql_optimal_size('SELECT count(DISTINCT user_id) FROM events', FPR, USER_H)} AS m),
e AS (SELECT ts, event_id, user_id, row_number() OVER (ORDER BY ts, event_id) AS ord FROM events WHERE user_id IS NOT NULL),
p AS (SELECT event_id, user_id, ord, {sql_hash("user_id::VARCHAR", "i")} % m AS pos FROM e, (SELECT unnest(range(0, {USER_H})) AS i), m),
f AS (SELECT pos, min(ord) AS first FROM p GROUP BY pos)
SELECT event_id, user_id, bool_and(first < ord) AS present FROM p JOIN f USING (pos) GROUP BY event_id, user_id""",
    "bf_roundtrip": f"WITH {_LINES} SELECT pos FROM bits",
    "bf_raw_roundtrip": f"WITH {_LINES} SELECT pos FROM bits",
}
ORACLES["stream_first_seen"] = ORACLES["bf_insert_and_check"]
ORACLES["stream_deduplicated"] = "SELECT DISTINCT user_id FROM events"
