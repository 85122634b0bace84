"""Classification of reads against a multi-index filter.

frames: (read, pos, elem). Elements are looked up once each and joined back, those that a large part of all frames have spread
over salts; counts without early stop are group-bys. The stopping classifier is one fold a read over that read's frames, whose
number its length bounds, in the order of a column ord: ordered() and interleaved() number all frames, the missed ones too."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftloom.functions import hashing
from siftloom.operators import hot, multiindex
from siftloom.session import shuffle_partitions

COUNTERS = ("count", "nonSatCount", "totalCount", "totalNonSatCount", "nonSatFrameCount", "solidCount")
#: Candidates are ranked by these, the largest first; the id settles full ties.
ORDER = ("nonSatFrameCount", "count", "solidCount", "nonSatCount", "totalNonSatCount", "totalCount", "frameProb")
RESULT = ("read", "id", *COUNTERS, "frameProb")
FOLDED = "read bigint, id bigint, " + ", ".join(f"{c} int" for c in COUNTERS) + ", sat_frames bigint, slots bigint, stopped bigint"


def ordered(frames: DataFrame) -> DataFrame:
    """frames with ord: their number within the read, from 0."""
    return frames.withColumn("ord", (F.row_number().over(Window.partitionBy("read").orderBy("pos")) - 1).cast("bigint"))


def interleaved(frames: DataFrame, mates: DataFrame) -> DataFrame:
    """The frames of pairs with ord: those of the two mates in turn, whether they match or not, the longer one's rest after."""
    both = frames.withColumn("mate", F.lit(0)).unionByName(mates.withColumn("mate", F.lit(1)))
    turn = F.row_number().over(Window.partitionBy("read", "mate").orderBy("pos"))
    w = Window.partitionBy("read").orderBy("turn", "mate")
    return both.withColumn("turn", turn).withColumn("ord", (F.row_number().over(w) - 1).cast("bigint")).drop("turn")


def gathered(frames: DataFrame, slots: DataFrame, m: int, h: int, max_miss: int = 0, family: str = hashing.DEFAULT, blocks_: int = 1) -> DataFrame:
    """The frames with max_miss misses at most, with (misses, hits) instead of elem; hits are (i, id, saturated) in hash order."""
    each = frames.groupBy("elem").agg(F.count(F.lit(1)).alias("n"))
    found = multiindex.lookup(each, "elem", slots, m, h, family, blocks_)
    hit = F.when(F.col("rank").isNotNull(), F.struct("i", "id", "saturated"))
    per = found.groupBy("elem").agg(F.count_if(F.col("rank").isNull()).cast("int").alias("misses"), F.sort_array(F.collect_list(hit)).alias("hits")).where(F.col("misses") <= max_miss)
    return hot.joined(frames, per, "elem", ["read", "pos"], hot.hot_keys(each, "elem", "n")).drop("elem")


def signature(got: DataFrame) -> DataFrame:
    """(read, pos, i, id, saturated): what every matched position of a read holds."""
    return got.select("read", "pos", F.explode("hits").alias("x")).select("read", "pos", "x.i", "x.id", "x.saturated")


def all_counts(got: DataFrame) -> DataFrame:
    """(read, id, six counters) over all frames of each read, without early stop.

    Within a frame an id counts once as seen unsaturated, and once as seen saturated unless its unsaturated form came
    before. Frames without any saturated hit count for all their ids."""
    slot = got.select("read", "pos", "misses", F.exists("hits", lambda x: x["saturated"]).alias("any_sat"), F.explode("hits").alias("x")).select("read", "pos", "misses", "any_sat", "x.i", "x.id", "x.saturated")
    first = lambda sat: F.min(F.when(F.col("saturated") == sat, F.col("i")))
    frame = slot.groupBy("read", "pos", "id").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(~F.col("saturated")).alias("unsat"), first(False).alias("f_unsat"), first(True).alias("f_sat"), F.bool_or("any_sat").alias("any_sat"), F.max("misses").alias("misses")
    )
    one = lambda c: F.when(c, 1).otherwise(0)
    has = F.col("f_unsat").isNotNull()
    late = F.col("f_sat").isNotNull() & (~has | (F.col("f_sat") < F.col("f_unsat")))
    clean = ~F.col("any_sat")
    sums = {
        "count": one(has) + one(late),
        "nonSatCount": one(has),
        "totalCount": F.col("total"),
        "totalNonSatCount": F.col("unsat"),
        "nonSatFrameCount": one(clean),
        "solidCount": one(clean & (F.col("misses") == 0)),
    }
    return frame.groupBy("read", "id").agg(*[F.sum(v).cast("int").alias(k) for k, v in sums.items()])


def ranked(results: DataFrame, read: str, id_: str) -> DataFrame:
    """Adds place: 1 for the best candidate of a read. Missing counters and NaN probabilities rank last."""
    desc = [F.when(F.isnan(c) if c == "frameProb" else F.lit(False), F.lit(None)).otherwise(F.col(c)).desc_nulls_last() for c in ORDER]
    return results.withColumn("place", F.row_number().over(Window.partitionBy(read).orderBy(*desc, F.col(id_).asc_nulls_last())))


# Predicates on pairs of counters, as columns.


def roughly_equal(a: Column, b: Column, extra: float) -> Column:
    """Equal up to so many."""
    return F.abs(a - b) <= extra


def within_error(a: Column, b: Column) -> Column:
    """Equal up to one standard error of each."""
    high, low = F.greatest(a, b).cast("double"), F.least(a, b).cast("double")
    return high - F.sqrt(high) <= low + F.sqrt(low)


def within_error_or_larger(a: Column, b: Column, extra: float) -> Column:
    """The same with scaled errors, or b larger."""
    return a - F.sqrt(a.cast("double")) * extra <= b + F.sqrt(b.cast("double")) * extra


@dataclass
class Options:
    #: Standard errors within which a candidate ties with the best.
    extra: float = 1.0
    extra_frames: int = 20
    min_frames: int = 1
    best_agrees: bool = False
    #: A candidate needs this count, or that of its id where min_counts names one: a row an id of the index at most.
    min_count: int = 1
    min_counts: dict[int, int] = field(default_factory=dict)

    def least(self, id_: int) -> int:
        return self.min_counts.get(id_, self.min_count)


def _equal(a: int, b: int) -> bool:
    high, low = max(a, b), min(a, b)
    return high - math.sqrt(high) <= low + math.sqrt(low)


@dataclass
class Frame:
    """What a frame adds to the counters of its ids, and the ids that may become candidates, in the order in which it has them."""

    adds: list[tuple[int, list[int]]]
    asked: list[int]
    saturated: bool
    slots: int

    @classmethod
    def of(cls, misses: int, hits: list[tuple[int, bool]]) -> Frame:
        adds: dict[int, list[int]] = {}
        seen: dict[tuple[int, bool], None] = {}
        for id_, sat in hits:
            c = adds.setdefault(id_, [0] * 6)
            c[2] += 1
            c[3] += not sat
            if (id_, sat) not in seen:
                c[1] += not sat
                c[0] += not sat or (id_, False) not in seen
                seen[id_, sat] = None
        saturated = any(sat for _, sat in seen)
        if not saturated:
            for c in adds.values():
                c[4] += 1
                c[5] += misses == 0
        return cls([*adds.items()], [i for i, sat in seen if not (sat and (i, False) in seen)], saturated, len(hits))


class _Read:
    """The running counts of one read. Counters of an id: see COUNTERS."""

    def __init__(self, options: Options):
        self.o = options
        self.counts: dict[int, list[int]] = {}
        self.candidates: dict[int, None] = {}
        self.best = [0] * 6
        self.second = self.extra = self.sat_frames = self.slots = 0

    def frame(self, misses: int, hits: list[tuple[int, bool]]) -> bool:
        """Takes a frame; true when the read is settled and its other frames need not be looked at."""
        return self.take(Frame.of(misses, hits))

    def take(self, frame: Frame) -> bool:
        self.slots += frame.slots
        self.sat_frames += frame.saturated
        for id_, add in frame.adds:
            c = self.counts.get(id_)
            if c is None:
                self.counts[id_] = [*add]
            else:
                for j, x in enumerate(add):
                    if x:
                        c[j] += x
        best = self.best
        for id_ in frame.asked:
            c = self.counts[id_]
            if c[0] >= self.o.least(id_) or (self.candidates and c[0] >= best[0]):
                self.candidates[id_] = None
                if c[4] <= best[4]:
                    # The frame count of a best that is overtaken does not become the second.
                    self.second = max(self.second, c[4])
                for j, x in enumerate(c):
                    if x > best[j]:
                        best[j] = x
        if _equal(best[3], self.second):
            self.extra = 0
        if best[4] > self.second:
            self.extra += 1
            return self.extra > self.o.extra_frames + 1
        return False

    def results(self) -> list[tuple]:
        if not self.candidates or self.best[4] < self.o.min_frames:
            return []
        valid = [(id_, *self.counts[id_]) for id_ in self.candidates if any(_equal(x, y) for x, y in zip(self.counts[id_], self.best))]
        if len(valid) < 2:
            return valid
        # Full ties may stand in any order: neither the tied set nor the agreement depends on it.
        valid.sort(key=lambda r: (-r[5], -r[1], -r[6], -r[2], -r[4], -r[3], r[0]))
        top = valid[0][1:7]
        x = self.o.extra
        tied = [r for r in valid if all(a - math.sqrt(a) * x <= b + math.sqrt(b) * x for a, b in zip(top, r[1:7]))]
        if self.o.best_agrees and len(tied) > 1 and any(a < b for a, b in zip(tied[0][1:7], tied[1][1:7])):
            return []
        return tied


def _fold(options: Options):
    """Rows come sorted by read and ord."""
    names = ["read", "id", *COUNTERS, "sat_frames", "slots", "stopped"]
    kinds = [pa.int64(), pa.int64(), *[pa.int32()] * 6, *[pa.int64()] * 3]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, read, stopped, out = None, None, None, []

        def close() -> None:
            for r in read.results() or [(None, *[0] * 6)]:
                out.append((now, *r, read.sat_frames, read.slots, stopped))

        for b in batches:
            reads, order, misses = (b.column(c).to_numpy() for c in ("read", "ord", "misses"))
            hits = b.column("hits")
            at, flat = hits.offsets.to_numpy(), hits.values
            ids, sat = flat.field("id").to_numpy(), flat.field("saturated").to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(np.diff(reads)) + 1).tolist(), len(reads)] if len(reads) else []
            for lo, hi in zip(cuts, cuts[1:]):
                if read is None or reads[lo] != now:
                    if read is not None:
                        close()
                    now, read, stopped = int(reads[lo]), _Read(options), None
                for j in range(lo, hi):
                    if stopped is not None:  # a settled read leaves its other frames unread
                        break
                    if read.frame(int(misses[j]), [*zip(ids[at[j] : at[j + 1]].tolist(), sat[at[j] : at[j + 1]].tolist())]):
                        stopped = int(order[j]) + 1
            if len(out) > 20_000:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)
                out.clear()
        if read is not None:
            close()
        if out:
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)

    return run


def folded(got: DataFrame, options: Options | None = None) -> DataFrame:
    """(read, id, six counters, sat_frames, slots, stopped): the best id of each read with those statistically tied to it, an id of null
    for a read without any; and, of the frames that were looked at until the read was settled, those with a saturated hit, the
    hit slots, and the number of frames up to then, missed ones counted (null: never settled)."""
    rows = got.select("read", "ord", "misses", "hits").repartition(shuffle_partitions(got.sparkSession), "read").sortWithinPartitions("read", "ord")
    return rows.mapInArrow(_fold(options or Options()), FOLDED)


def classify(got: DataFrame, probabilities: DataFrame, options: Options | None = None) -> DataFrame:
    """RESULT rows: the best id of each read with those statistically tied to it; none for a read without candidates."""
    return with_probabilities(folded(got, options), probabilities)


def with_probabilities(found: DataFrame, probabilities: DataFrame) -> DataFrame:
    """RESULT rows of those of folded()."""
    found = found.where(F.col("id").isNotNull())
    probs = probabilities.select(F.col("id").alias("__id"), F.col("prob").alias("frameProb"))
    return found.join(probs, F.col("id") == F.col("__id"), "left").withColumn("frameProb", F.coalesce("frameProb", F.lit(0.0))).select(*RESULT)


def evaluation(frames: DataFrame, got: DataFrame, options: Options | None = None, spaced: bool = False) -> DataFrame:
    """(read, sat_frames, evaluated) of every read: the frames with a saturated hit, and the slots looked at, until the read was
    settled. Without spaced seeds each frame, missed or not, counts one more."""
    per = folded(got, options).groupBy(F.col("read").alias("r")).agg(F.max("sat_frames").alias("sat_frames"), F.max("slots").alias("slots"), F.max("stopped").alias("stopped"))
    totals = frames.groupBy("read").agg(F.count(F.lit(1)).alias("frames"))
    more = F.lit(0) if spaced else F.coalesce("stopped", "frames")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("bigint"))
    return totals.join(per, F.col("read") == F.col("r"), "left").select("read", zero("sat_frames").alias("sat_frames"), (zero("slots") + more).alias("evaluated"))
