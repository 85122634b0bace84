"""Problem 8: mixing sources to target weights.

Method: the tokens of each source are packed into blocks of a fixed length, in a pseudorandom order of its records. Every
output shard draws multinomial counts of slots for the sources; the slots of a source are numbered across the shards and
mapped to its blocks through a pseudorandom permutation of the indices, one for each pass over the source, and joined to
the blocks by index. A pass repeats no block, so a record comes at most as often as there are passes.

The size of the whole follows from the targets unless it is given: the largest at which no capped source is expected to
run out, with four standard deviations of its draws to spare. Shares are scaled to add up to 1 over the sources that have
documents and may give any. A slot beyond a source's cap stays unfilled, and the report shows it.

Running sums are taken in two steps, first over buckets of a source and then within each, so that a source with a third of
all rows is not sorted in one task.

Defined cases: sources compare without case and outer blanks; null and unlisted sources, null and empty texts give
nothing; a null share or one that is not positive is no target; of several targets of a source the largest share holds; a
null cap is none, and a cap below 1 lets nothing through and leaves its source out of the shares and of the total; empty
tables give an empty selection; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftloom.llm import tokens
from siftloom.session import durable

BUCKETS = 1024
SPREAD = 4.0


@dataclass
class Plan:
    """One row a source that has a share and documents; as many as the target table has sources at most."""

    source: list[str]
    share: list[float]
    size: list[int]
    blocks: list[int]
    cap: list[int | None]
    slots: int
    per_shard: int

    @property
    def shards(self) -> int:
        return math.ceil(self.slots / self.per_shard)


def source_name(column):
    return F.lower(F.trim(column))


def placed(documents: DataFrame, targets: DataFrame, vocabulary: str = tokens.VOCABULARY) -> DataFrame:
    """(source, doc_id, n_tokens, start): each record's place in the stream of tokens of its source."""
    wanted = targets.where(F.col("target_share") > 0).select(source_name(F.col("source")).alias("s")).distinct()
    named = documents.withColumn("__source", source_name(F.col("source"))).select(F.col("doc_id").cast("long").alias("doc_id"), "text", "__source")
    rows = named.join(wanted, F.col("__source") == F.col("s"), "left_semi")
    kept = durable(_sized(rows, vocabulary).where(F.col("n_tokens") > 0).withColumn("bucket", F.pmod(F.xxhash64("doc_id", F.lit("order")), F.lit(BUCKETS)).cast("int")), "sizes")
    sums = kept.groupBy("source", "bucket").agg(F.sum("n_tokens").alias("n"))
    before = F.sum("n").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sums.select(F.col("source").alias("s"), F.col("bucket").alias("b"), F.coalesce(before, F.lit(0)).alias("offset"))
    inside = Window.partitionBy("source", "bucket").orderBy(F.xxhash64("doc_id"), "doc_id", "row").rowsBetween(Window.unboundedPreceding, -1)
    joined = kept.withColumn("inside", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).join(offsets, (F.col("source") == F.col("s")) & (F.col("bucket") == F.col("b")))
    return joined.select("source", "doc_id", "row", "n_tokens", (F.col("offset") + F.col("inside")).alias("start"))


def _sized(rows: DataFrame, vocabulary: str) -> DataFrame:
    """(source, doc_id, row, n_tokens); row tells repeated ids apart."""
    shipped = tokens.shipped(rows.sparkSession, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, extra, _, count in tokens.encoded_slices(shipped, batches):
            yield pa.record_batch([key, extra, pa.array(count, pa.int64())], names=["doc_id", "source", "n_tokens"])

    counted = rows.select("doc_id", "text", F.col("__source").alias("source")).mapInArrow(run, "doc_id long, source string, n_tokens long")
    return counted.withColumn("row", F.monotonically_increasing_id())


def plan(sources: DataFrame, targets: DataFrame, block: int, total: int | None = None, per_shard: int = 256) -> Plan:
    """sources: (source, size in tokens), one row each. The driver gets one row a target source."""
    limits = targets.where(F.col("target_share") > 0).groupBy(source_name(F.col("source")).alias("s")).agg(F.max_by(F.struct("target_share", "max_repeats"), "target_share").alias("t"))
    rows = sorted(sources.join(limits, F.col("source") == F.col("s")).select("source", "size", "t.target_share", "t.max_repeats").collect())
    rows = [r for r in rows if r.size and (r.max_repeats is None or r.max_repeats > 0)]
    sum_share = sum(r.target_share for r in rows) or 1.0
    share = [r.target_share / sum_share for r in rows]
    blocks = [math.ceil(r.size / block) for r in rows]
    cap = [None if r.max_repeats is None else r.max_repeats * b for r, b in zip(rows, blocks)]
    if total is not None:
        slots = total // block
    else:
        # s p + SPREAD sqrt(s p (1 - p)) <= cap, solved for s.
        def most(p: float, c: int) -> int:
            spread = SPREAD * math.sqrt(max(0.0, 1 - p))
            return math.floor(((-spread + math.sqrt(spread * spread + 4 * c)) / 2) ** 2 / p)

        slots = min([most(p, c) for p, c in zip(share, cap) if c is not None] or [sum(blocks)])
        if rows and not slots:
            slots = 1
    return Plan([r.source for r in rows], share, [r.size for r in rows], blocks, cap, slots, per_shard)


def draws(spark, p: Plan, seed: int = 11) -> DataFrame:
    """(shard, source, n): the multinomial counts of every shard."""
    shape = "shard long, source string, n long"
    if not p.slots:
        return spark.createDataFrame([], shape)
    names, share, per_shard, whole = p.source, np.array(p.share), p.per_shard, p.slots

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_numpy()
            n = np.concatenate([np.random.default_rng([seed, int(i)]).multinomial(min(per_shard, whole - int(i) * per_shard), share) for i in ids]) if len(ids) else np.empty(0, np.int64)
            yield pa.record_batch([pa.array(np.repeat(ids, len(names))), pa.array(names * len(ids), pa.string()), pa.array(n, pa.int64())], names=["shard", "source", "n"])

    return spark.range(p.shards).mapInArrow(draw, shape)


def slots(spark, p: Plan, seed: int = 11) -> DataFrame:
    """(shard, source, pass, block): the draws of all shards, mapped to blocks; slots beyond a cap are left out."""
    if not p.slots:
        return spark.createDataFrame([], "shard long, source string, pass long, block long")
    drawn = draws(spark, p, seed)
    drawn = drawn.withColumn("bucket", F.expr("shard div 4096"))
    sums = drawn.groupBy("source", "bucket").agg(F.sum("n").alias("all"))
    earlier = F.sum("all").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sums.select(F.col("source").alias("s"), F.col("bucket").alias("b"), F.coalesce(earlier, F.lit(0)).alias("offset"))
    inside = F.sum("n").over(Window.partitionBy("source", "bucket").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    first = drawn.withColumn("inside", F.coalesce(inside, F.lit(0))).join(offsets, (F.col("source") == F.col("s")) & (F.col("bucket") == F.col("b")))
    # A local table of one row a source, and so bounded by the target table.
    rng = np.random.default_rng(seed)
    per = spark.createDataFrame([(s, n, c, *_coprime(n, rng)) for s, n, c in zip(p.source, p.blocks, p.cap)], "s string, blocks long, cap long, mul long, add long")
    numbered = first.where(F.col("n") > 0).select("shard", "source", F.explode(F.sequence(F.col("offset") + F.col("inside"), F.col("offset") + F.col("inside") + F.col("n") - 1)).alias("slot"))
    joined = numbered.join(F.broadcast(per), F.col("source") == F.col("s")).where(F.col("cap").isNull() | (F.col("slot") < F.col("cap")))
    # slot -> mul x slot + add + pass, modulo the blocks: a permutation of each pass, as mul has no factor in common with them.
    at = F.expr("slot div blocks").alias("pass")
    block = F.expr("pmod(mul * pmod(slot, blocks) + pmod(add + (slot div blocks) * 7919, blocks), blocks)")
    return joined.select("shard", "source", at, block.alias("block"))


def _coprime(n: int, rng: np.random.Generator) -> tuple[int, int]:
    """A multiplier without a common factor with n whose product with an index stays below 2^62, and an addend."""
    top = max(1, min(n, (1 << 62) // max(n, 1)))
    mul = max(1, int(rng.integers(max(1, top // 3), top + 1)))
    while math.gcd(mul, n) != 1:
        mul = mul - 1 if mul > 1 else 1
    return mul, int(rng.integers(0, n)) if n else 0


def planned(documents: DataFrame, targets: DataFrame, block: int = 256, total: int | None = None, per_shard: int = 256, vocabulary: str = tokens.VOCABULARY) -> tuple[DataFrame, Plan]:
    """The records placed in the streams of their sources, and the plan."""
    records = durable(placed(documents, targets, vocabulary), "places")
    return records, plan(records.groupBy("source").agg(F.sum("n_tokens").alias("size")), targets, block, total, per_shard)


def chosen(records: DataFrame, p: Plan, block: int = 256, seed: int = 11) -> DataFrame:
    """(shard, source, pass, block, doc_id, first_token, n_tokens): the pieces of records that fill the slots of each shard.

    first_token counts from 0 within the record."""
    pieces = records.select("source", "doc_id", "n_tokens", "start", F.explode(F.sequence(F.expr(f"start div {block}"), F.expr(f"(start + n_tokens - 1) div {block}"))).alias("block"))
    low, high = F.greatest("start", F.col("block") * block), F.least(F.col("start") + F.col("n_tokens"), (F.col("block") + 1) * block)
    cut = pieces.select(F.col("source").alias("s"), F.col("block").alias("b"), "doc_id", (low - F.col("start")).alias("first_token"), (high - low).alias("n_tokens"))
    drawn = slots(records.sparkSession, p, seed)
    return drawn.join(cut, (F.col("source") == F.col("s")) & (F.col("block") == F.col("b"))).select("shard", "source", "pass", "block", "doc_id", "first_token", "n_tokens")


def selection(documents: DataFrame, targets: DataFrame, block: int = 256, total: int | None = None, per_shard: int = 256, seed: int = 11, vocabulary: str = tokens.VOCABULARY) -> DataFrame:
    """chosen() of the planned records."""
    records, p = planned(documents, targets, block, total, per_shard, vocabulary)
    return chosen(records, p, block, seed)


def report(documents: DataFrame, targets: DataFrame, block: int = 256, total: int | None = None, per_shard: int = 256, seed: int = 11, vocabulary: str = tokens.VOCABULARY) -> DataFrame:
    """shares() with what the plan expects: the target scaled to the sources that take part, the standard deviation of the share that
    the draws give, the slots drawn, and those left unfilled beyond the cap; all of them 0 for a source that takes no part."""
    records, p = planned(documents, targets, block, total, per_shard, vocabulary)
    spark = records.sparkSession
    shape = "p_source string, scaled_share double, deviation double, cap long"
    wanted = spark.createDataFrame([(s, x, math.sqrt(x * (1 - x) / p.slots) if p.slots else 0.0, c) for s, x, c in zip(p.source, p.share, p.cap)], shape)
    drawn = draws(spark, p, seed).groupBy(F.col("source").alias("d_source")).agg(F.sum("n").alias("drawn"))
    base = shares(chosen(records, p, block, seed), targets)
    zero = lambda c: F.coalesce(c, F.lit(0))
    out = base.join(wanted, F.col("source") == F.col("p_source"), "left").join(drawn, F.col("source") == F.col("d_source"), "left")
    unfilled = F.greatest(zero("drawn") - F.coalesce("cap", "drawn", F.lit(0)), F.lit(0))
    return out.select(*base.columns, zero("scaled_share").alias("scaled_share"), zero("deviation").alias("deviation"), zero("drawn").alias("drawn"), unfilled.alias("unfilled"))


def shares(selected: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, max_repeats, tokens, share, repeats) of every target source; repeats: the most passes."""
    per = selected.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), (F.max("pass") + 1).alias("repeats"))
    limits = targets.groupBy(source_name(F.col("source")).alias("s")).agg(F.max_by(F.struct("target_share", "max_repeats"), "target_share").alias("t"))
    out = limits.join(per, F.col("source") == F.col("s"), "left").select(F.col("s").alias("source"), "t.target_share", "t.max_repeats", F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("repeats", F.lit(0)).alias("repeats"))
    whole = F.sum("tokens").over(Window.partitionBy(F.lit(0)))
    return out.withColumn("share", F.when(whole > 0, F.round(F.col("tokens") / whole, 6)).otherwise(0.0))
