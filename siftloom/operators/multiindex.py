"""Multi-index filters: a bit vector, the rank of each set bit, and one source id per rank, as relations.

frames: (seq, pos, elem, id): windows of sequences with the id of their source, ids above 0. slots: (pos, rank, id, obs,
saturated). Everything that does not depend on order is a group-by, a window over a rank or a join on position. What does, is
folded block by block: m positions are cut into blocks, and all positions of an element lie in one of them. blocks = 1, the
default, is the flat layout. The family hashing.seeded() makes an index of spaced seeds, which has the flat layout only, as the
hash of a seed must not depend on the letters that the seed leaves out."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftloom.functions import hashing
from siftloom.operators import blocks

BUCKET = 32768
#: Sequences of one step when a rank's observations are numbered.
STRIDE = 4096


def parse_seed(seed: Column) -> Column:
    """Positions of the don't-care columns of a spaced seed."""
    return F.filter(F.sequence(F.lit(0), F.length(seed) - 1), lambda j: seed.substr(j + 1, F.lit(1)) == "0")


def hashed(frames: DataFrame, m: int, h: int, family: str = hashing.DEFAULT, blocks_: int = 1) -> DataFrame:
    """(seq, pos0, id, elem, i, hash, pos): one row a hash value."""
    values = frames.select("seq", F.col("pos").alias("pos0"), "id", "elem", hashing.hashes(F.col("elem"), h, family).alias("hashes"))
    both = values.select("seq", "pos0", "id", "elem", F.posexplode(F.arrays_zip(F.col("hashes").alias("hash"), hashing.placed(F.col("hashes"), m, blocks_).alias("pos"))).alias("i", "x"))
    return both.select("seq", "pos0", "id", "elem", "i", "x.hash", "x.pos")


def bit_vector(frames: DataFrame, m: int, h: int, family: str = hashing.DEFAULT, blocks_: int = 1) -> DataFrame:
    """(pos): set bits; elements are taken distinct before they are hashed."""
    return frames.select("elem").distinct().select(F.explode(hashing.positions(F.col("elem"), m, h, family, blocks_)).alias("pos")).distinct()


def collisions(frames: DataFrame, m: int, h: int, family: str = hashing.DEFAULT, blocks_: int = 1) -> DataFrame:
    """(seq, frames, full, bits_set): per sequence its frames, those whose bits were all set when they came, and the number of
    their bits that were set. Frames come in the order (seq, pos); a bit counts as set within its own frame only by an
    earlier hash. After the first frame of an element all others find its bits set, so only first frames are looked up."""
    first = frames.groupBy("elem").agg(F.min(F.struct("seq", "pos")).alias("f")).select("elem", "f.seq", "f.pos", F.lit(0).alias("id"))
    at = F.struct("seq", "pos0", "i")
    rows = hashed(first, m, h, family, blocks_).select(at.alias("at"), "seq", "pos0", "pos")
    setters = rows.groupBy("pos").agg(F.min("at").alias("setter"))
    per = rows.join(setters, "pos").groupBy("seq", "pos0").agg(
        F.max(F.struct("setter.seq", "setter.pos0")).alias("latest"), F.count_if(F.col("setter") < F.col("at")).alias("bits_set")
    )
    found = per.groupBy("seq").agg(F.count(F.lit(1)).alias("new"), F.count_if(F.col("latest") < F.struct("seq", "pos0")).alias("full"), F.sum("bits_set").alias("bits"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    again = F.col("frames") - zero("new")
    out = frames.groupBy("seq").agg(F.count(F.lit(1)).alias("frames")).join(found, "seq", "left")
    return out.select("seq", "frames", (zero("full") + again).alias("full"), (zero("bits") + again * h).alias("bits_set"))


def ranks(bits: DataFrame) -> DataFrame:
    """bits, one row a position, with its rank: the number of set bits before it. Buckets of positions are numbered side by
    side; only the table of their sizes, m / 32768 rows, is summed in one place."""
    b = bits.withColumn("__bucket", F.expr(f"pos div {BUCKET}")).repartition("__bucket")
    sizes = b.groupBy("__bucket").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select(F.col("__bucket").alias("__b"), before.alias("__before"))
    inside = F.row_number().over(Window.partitionBy("__bucket").orderBy("pos")) - 1
    ranked = b.withColumn("__inside", inside).join(offsets, F.col("__bucket") == F.col("__b"))
    return ranked.select(*bits.columns, (F.col("__before") + F.col("__inside")).cast("bigint").alias("rank"))


def reservoir(frames: DataFrame, m: int, h: int, family: str = hashing.DEFAULT, blocks_: int = 1) -> DataFrame:
    """(pos, rank, id, obs): each rank's id by reservoir sampling over its observations.

    A sequence observes each of its distinct hash values once; observations of a rank are numbered in the order of
    sequence, id and hash. Number c takes the rank if (hash xor id) mod c is c - 1, so the first always does; the last taker
    stays. Observations are shuffled once, by rank and stride of sequences, so that no task gets all of a hot rank; the
    strides' sizes are summed first."""
    obs = hashed(frames, m, h, family, blocks_).select("seq", "id", "hash", "pos").withColumn("stride", F.expr(f"seq div {STRIDE}"))
    obs = obs.repartition("pos", "stride").distinct()
    sizes = obs.groupBy("pos", "stride").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("pos").orderBy("stride").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.withColumn("before", before).where(F.col("before") > 0).drop("n")
    inside = F.row_number().over(Window.partitionBy("pos", "stride").orderBy("seq", "id", "hash"))
    numbered = obs.withColumn("inside", inside).join(offsets, ["pos", "stride"], "left").select("pos", "id", "hash", (F.coalesce("before", F.lit(0)) + F.col("inside")).alias("c"))
    won = hashing.unsigned_mod(F.col("hash").bitwiseXOR(F.col("id")), F.col("c")) == F.col("c") - 1
    taken = numbered.groupBy("pos").agg(F.max_by("id", F.when(won, F.col("c"))).alias("id"), F.max("c").alias("obs"))
    return ranks(taken).select("pos", "rank", "id", "obs")


def first_writer(frames: DataFrame, m: int, h: int, family: str = hashing.DEFAULT, blocks_: int = 1) -> DataFrame:
    """(pos, id): the id of the first frame, by (seq, pos), that touches an empty slot."""
    return hashed(frames, m, h, family, blocks_).groupBy("pos").agg(F.min_by("id", F.struct("seq", "pos0", "id")).alias("id"))


def saturated(slots: DataFrame, frames: DataFrame, m: int, h: int, family: str = hashing.DEFAULT) -> DataFrame:
    """slots with a saturated flag: all slots of a frame in which its own id did not survive, judged by the given slots.

    The one-pass form of saturation: it replaces no ids and so needs no order, for indexes whose elements do not keep to blocks,
    as those of spaced seeds. built() replaces and needs one."""
    rows = hashed(frames.select(F.lit(0).alias("seq"), F.lit(0).alias("pos"), "elem", "id").distinct(), m, h, family).select("elem", F.col("id").alias("own"), "pos")
    lost = rows.join(slots.select("pos", "id"), "pos").groupBy("elem", "own").agg(F.bool_or(F.col("id") == F.col("own")).alias("kept"), F.collect_set("pos").alias("at")).where(~F.col("kept"))
    marks = lost.select(F.explode("at").alias("pos")).distinct().withColumn("hit", F.lit(True))
    return slots.join(marks, "pos", "left").withColumn("saturated", F.coalesce("hit", F.lit(False))).drop("hit")


def lookup(probes: DataFrame, elem: str, slots: DataFrame, m: int, h: int, family: str = hashing.DEFAULT, blocks_: int = 1) -> DataFrame:
    """(elem, i, pos, rank, id, saturated) for every hash of every distinct probe; rank and id are null where the bit is not set."""
    rows = probes.select(F.col(elem).alias("elem")).where(F.col("elem").isNotNull()).distinct()
    at = rows.select("elem", F.posexplode(hashing.positions(F.col("elem"), m, h, family, blocks_)).alias("i", "pos"))
    return at.join(slots.select("pos", "rank", "id", "saturated"), "pos", "left").select("elem", "i", "pos", "rank", "id", "saturated")


def at(found: DataFrame, max_miss: int = 0) -> DataFrame:
    """(elem, misses, all_saturated, i, id): ids by hash, 0 for a miss; elements with more misses than allowed are left out."""
    hits = found.groupBy("elem").agg(
        F.count_if(F.col("rank").isNull()).alias("misses"), F.bool_and(F.coalesce("saturated", F.lit(True))).alias("all_saturated"), F.sort_array(F.collect_list(F.struct("i", F.coalesce("id", F.lit(0)).alias("id")))).alias("ids")
    )
    return hits.where(F.col("misses") <= max_miss).select("elem", "misses", "all_saturated", F.explode("ids").alias("x")).select("elem", "misses", "all_saturated", "x.i", "x.id")


def at_rank(found: DataFrame, max_miss: int = 0) -> DataFrame:
    """(elem, misses, i, rank) of the hits of elements with so many misses at most; 0 is the strict form."""
    misses = found.groupBy("elem").agg(F.count_if(F.col("rank").isNull()).alias("misses")).where(F.col("misses") <= max_miss).withColumnRenamed("elem", "e")
    return found.where(F.col("rank").isNotNull()).join(misses, F.col("elem") == F.col("e")).select("elem", "misses", "i", "rank")


def id_counts(slots: DataFrame) -> DataFrame:
    """(id, n, n_saturated)."""
    return slots.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.count_if("saturated").alias("n_saturated"))


def id_counts_strand(slots: DataFrame) -> DataFrame:
    """(id, n, n_strand, n_saturated) of an index with strands: slots by id whatever their strand, and those with the strand bit."""
    return slots.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.count_if("strand").alias("n_strand"), F.count_if("saturated").alias("n_saturated"))


def stats(slots: DataFrame, h: int) -> DataFrame:
    """(pop, pop_nonzero, pop_saturated, prob_saturated): all set bits, those with an id, the saturated ones; 0 when empty."""
    out = slots.agg(F.count(F.lit(1)).alias("pop"), F.count_if(F.col("id") != 0).alias("pop_nonzero"), F.count_if("saturated").alias("pop_saturated"))
    return out.withColumn("prob_saturated", F.when(F.col("pop") > 0, F.pow(F.col("pop_saturated") / F.col("pop").cast("double"), F.lit(float(h)))).otherwise(0.0))


def check_values(slots: DataFrame, highest: int, bits: int = 32) -> DataFrame:
    """(value): the raw value of the first slot whose id is above the highest, else the highest."""
    first = F.min_by(pack(F.col("id"), F.lit(False), F.col("saturated"), bits), F.when(F.col("id") > highest, F.col("rank")))
    return slots.where(F.col("id") > highest).agg(F.coalesce(first, F.lit(highest).cast("bigint")).alias("value"))


def pack(id_: Column, strand: Column, saturated_: Column, bits: int = 32) -> Column:
    """The stored value: saturation in the top bit, strand in the next, then the id."""
    bit = lambda flag, at_: F.when(flag, F.lit(hashing.signed(1 << at_)).cast("bigint")).otherwise(F.lit(0).cast("bigint"))
    return id_.cast("bigint").bitwiseOR(bit(strand, bits - 2)).bitwiseOR(bit(saturated_, bits - 1))


def unpack(raw: Column, bits: int = 32) -> tuple[Column, Column, Column]:
    """(id, strand, saturated) of a stored value."""
    one = F.lit(1).cast("bigint")
    return raw.bitwiseAND(F.lit((1 << (bits - 2)) - 1).cast("bigint")), F.shiftrightunsigned(raw, bits - 2).bitwiseAND(one) == 1, F.shiftrightunsigned(raw, bits - 1).bitwiseAND(one) == 1


def frame_probabilities(slots: DataFrame, m: int, h: int, misses: int = 0, with_zero: bool = False) -> DataFrame:
    """(id, freq, prob): per id the probability of a random match, from its share of the slots and the occupancy. Shares are
    of all ids from 1, or from 0 too (with_zero, the form with strands). Slots may be counted already: (id, n), an id any number of times."""
    from siftloom.functions import sizing

    counts = slots.groupBy("id").agg((F.sum("n") if "n" in slots.columns else F.count(F.lit(1))).alias("n"))
    counted = F.sum(F.when((F.col("id") >= 1) | F.lit(with_zero), F.col("n"))).over(Window.partitionBy(F.lit(0)))  # one row an id
    pop = F.sum("n").over(Window.partitionBy(F.lit(0)))
    shares = counts.withColumns({"freq": F.col("n") / counted.cast("double"), "occ": pop / F.lit(float(m))}).where(F.col("id") >= (0 if with_zero else 1))
    return shares.select("id", "freq", sizing.frame_probability(F.col("occ"), h, F.col("freq"), misses).alias("prob"))


# Order-dependent mutations, folded block by block.


class Insert:
    """Fills empty slots with ids until an element has `most` slots of its own; with none, all its slots are saturated."""

    def __init__(self):
        self.ids: dict[int, int] = {}
        self.full: set[int] = set()

    def put(self, slots: list[int], values: list[int], most: int) -> bool:
        mine = [self.ids.get(s, 0) == v for s, v in zip(slots, values)]
        if sum(mine) >= most:
            return True
        count, open_ = sum(mine), any(s not in self.full for s in slots)
        for s, v, own in zip(slots, values, mine):
            if not own and s not in self.ids:
                self.ids[s] = v
                count += 1
                if count >= most:
                    return True
        if not count and open_:
            self.full.update(slots)
        return count > 0

    def step(self, slots: list[int], id_: int, most: int) -> None:
        self.put(slots, [id_] * len(slots), most)

    def rows(self):
        return [(s, self.ids.get(s, 0), False, s in self.full) for s in sorted(self.ids.keys() | self.full)]


STRAND = 1 << 40


class InsertStrand(Insert):
    """The same with a strand bit a slot."""

    def step(self, slots: list[int], id_: int, most: int, strands: list[bool]) -> None:
        self.put(slots, [id_ | STRAND if bool(most % 2) != bool(x) else id_ for x in strands], most)

    def rows(self):
        return [(s, self.ids.get(s, 0) & (STRAND - 1), bool(self.ids.get(s, 0) & STRAND), s in self.full) for s in sorted(self.ids.keys() | self.full)]


SLOTS = "block bigint, pos bigint, id bigint, strand boolean, saturated boolean"


def _firsts(frames: DataFrame, extra: list[str]) -> DataFrame:
    """The first frame of each element and id (and of what else tells frames apart). A later one changes nothing that the first left
    as it is, and a repeated element would make its block long."""
    key = ["elem", "id", *extra]
    return frames.groupBy(*key).agg(F.min(F.struct("seq", "pos")).alias("f")).select(*key, "f.seq", "f.pos")


def _tried(rows: DataFrame, *carried: str) -> DataFrame:
    """The slots of a frame, and what is carried beside them, in the order in which they are tried: by hash xor id, then by hash number."""
    parts = F.arrays_zip(F.col("slots").alias("s"), F.transform("hashes", lambda v, i: F.struct(v.bitwiseXOR(F.col("id")).alias("k"), i.alias("i"))).alias("k"), *[F.col(c).alias(c) for c in carried])
    ordered = F.array_sort(F.transform(parts, lambda x: F.struct(x["k"].alias("k"), x["s"].alias("s"), *[x[c].alias(c) for c in carried])))
    return rows.withColumn("__p", ordered).withColumns({"slots": F.transform("__p", lambda x: x["s"]), **{c: F.col(f"__p.{c}") for c in carried}})


def insert(frames: DataFrame, m: int, h: int, most: int, n_blocks: int | None = None, family: str = hashing.DEFAULT) -> DataFrame:
    """(pos, id, strand, saturated) after all frames, in the order (seq, pos)."""
    rows = blocks.placed(_firsts(frames, []).withColumn("most", F.lit(most)), "elem", m, h, n_blocks or blocks.number(m), family)
    return blocks.folded(_tried(rows), ["block"], ["seq", "pos", "id"], ["slots", "id", "most"], Insert, SLOTS).drop("block")


def insert_strand(frames: DataFrame, m: int, h: int, most: int, n_blocks: int | None = None, family: str = hashing.DEFAULT) -> DataFrame:
    """The same for frames with a column strands (array of h booleans)."""
    rows = blocks.placed(_firsts(frames, ["strands"]).withColumn("most", F.lit(most)), "elem", m, h, n_blocks or blocks.number(m), family)
    return blocks.folded(_tried(rows, "strands"), ["block"], ["seq", "pos", "id", "strands"], ["slots", "id", "most", "strands"], InsertStrand, SLOTS).drop("block")


class Saturate:
    """The last phase over a block whose slots a reservoir pass has filled: a frame whose id is in none of its slots takes over one
    whose id it has twice (or that is empty), the one with the most observations; without such a slot all its slots are
    saturated. A frame sees what the frames before it changed."""

    def __init__(self):
        self.ids: dict[int, int] = {}
        self.obs: dict[int, int] = {}
        self.rank: dict[int, int] = {}
        self.full: set[int] = set()

    def step(self, rank: int | None, slots: list[int], id_: int, obs: int) -> None:
        if rank is not None:
            s = slots[0]
            self.ids[s], self.obs[s], self.rank[s] = id_, obs, rank
            return
        held = [self.ids.get(s, 0) for s in slots]
        if id_ in held:
            return
        spare = [s for s, x in zip(slots, held) if (x == 0 or held.count(x) > 1) and self.obs.get(s, 0) > 0]
        if spare:
            s = max(spare, key=lambda x: self.obs[x])
            self.ids[s] = id_
            self.obs[s] += 1
        else:
            self.full.update(slots)

    def rows(self):
        return [(s, self.rank[s], x, self.obs[s], s in self.full) for s, x in self.ids.items()]


def built(frames: DataFrame, m: int, h: int, n_blocks: int | None = None, family: str = hashing.DEFAULT) -> DataFrame:
    """(pos, rank, id, obs, saturated): the whole index, of a reservoir pass over all frames and then of the saturation of those
    whose id did not survive, in the order of the first frame of each element and id."""
    n_blocks = n_blocks or blocks.number(m)
    taken = reservoir(frames, m, h, family, n_blocks)
    per = max(1, m // n_blocks)
    slots = taken.select(F.expr(f"pos div {per}").alias("block"), F.lit(0).alias("phase"), F.lit(0).cast("bigint").alias("seq"), F.col("pos").alias("at"), "id", "rank", F.array("pos").alias("slots"), "obs")
    rows = blocks.placed(_firsts(frames, []), "elem", m, h, n_blocks, family)
    none = F.lit(None).cast("bigint")
    marks = rows.select("block", F.lit(1).alias("phase"), F.col("seq").cast("bigint").alias("seq"), F.col("pos").cast("bigint").alias("at"), "id", none.alias("rank"), "slots", none.alias("obs"))
    return blocks.folded(slots.unionByName(marks), ["block"], ["phase", "seq", "at", "id"], ["rank", "slots", "id", "obs"], Saturate, "block bigint, pos bigint, rank bigint, id bigint, obs bigint, saturated boolean").drop("block")


class IndexBuilder:
    """The phases of an index in their order: bits, then ids, then saturation; a phase that is out of turn is refused."""

    def __init__(self, expected: int, h: int, occupancy: float, family: str = hashing.DEFAULT):
        from siftloom.operators.filters import padded

        if not 0 < occupancy < 1:
            raise ValueError("the occupancy lies between 0 and 1")
        self.h, self.family = h, family
        self.m = padded(-expected * h / math.log(1 - occupancy))
        self._bits: DataFrame | None = None
        self._frames: DataFrame | None = None
        self._closed = self._done = False

    def _need(self, good: bool, what: str) -> None:
        if not good:
            raise RuntimeError(what)

    def insert_bits(self, frames: DataFrame) -> None:
        self._need(not self._closed, "the bit vector is closed")
        bits = bit_vector(frames, self.m, self.h, self.family, self.blocks)
        self._bits = bits if self._bits is None else self._bits.unionByName(bits).distinct()

    @property
    def blocks(self) -> int:
        return 1 if self.family.startswith("seeds:") else blocks.number(self.m)

    def empty(self) -> DataFrame:
        """(pos, rank) of the index without ids; closes the bit vector."""
        self._need(self._bits is not None and not self._closed, "an index is made once, of a bit vector")
        self._closed = True
        return ranks(self._bits)

    def insert(self, frames: DataFrame) -> None:
        """Frames of the bits inserted before."""
        self._need(self._closed and not self._done, "ids follow the bit vector and come before the saturation")
        self._frames = frames if self._frames is None else self._frames.unionByName(frames)

    def saturate(self) -> DataFrame:
        """The slots of the index."""
        self._need(self._frames is not None and not self._done, "saturation follows the ids, once")
        self._done = True
        if self.family.startswith("seeds:"):
            return saturated(reservoir(self._frames, self.m, self.h, self.family), self._frames, self.m, self.h, self.family)
        return built(self._frames, self.m, self.h, self.blocks, self.family)
