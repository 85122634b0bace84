"""Queries of multi-index filters: slots over the elements put under sources, classification over all contigs."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftloom.functions import dna, hashing, sizing
from siftloom.operators import blocks, classify, multiindex, reads
from siftloom.plans.common import CLEAN, K, SQL_INDEXED, SQL_INSERTED, SQL_KMERS, contigs, indexed, inserted, rev, sql_block, sql_hash, sql_size_from_occupancy
from siftloom.plans.membership import _path
from siftloom.session import durable, table
from siftloom.sources import filterfile

H = 3
#: Part of the bits that is set at most; every index is sized by its elements.
OCCUPANCY = 0.3
HIGHEST = 40
#: Spaced seeds, the same read from either side, one a hash.
SPACED = ("1110111011101110111011101110111", "1110111110110011100110111110111", "1101101111101110111011111011011")


def _size(frames: DataFrame) -> int:
    return frames.agg(sizing.size_from_occupancy(F.countDistinct("elem"), F.lit(H), OCCUPANCY)).first()[0]


@dataclass
class _Index:
    """The frames of an index, written once, and its size."""

    frames: DataFrame
    m: int

    @classmethod
    def of(cls, frames: DataFrame) -> _Index:
        frames = durable(frames, "frames")
        return cls(frames, _size(frames))

    @property
    def blocks(self) -> int:
        return blocks.number(self.m)

    def shape(self) -> tuple:
        return self.m, H, hashing.DEFAULT, self.blocks

    def slots(self) -> DataFrame:
        return multiindex.built(self.frames, self.m, H, self.blocks)


def _indexed(spark: SparkSession, d: str) -> _Index:
    return _Index.of(indexed(spark, d))


def mibf_bv(spark: SparkSession, d: str) -> DataFrame:
    x = _indexed(spark, d)
    return multiindex.bit_vector(x.frames, *x.shape())


def mibf_bv_collisions(spark: SparkSession, d: str) -> DataFrame:
    """Per source: frames, those whose bits were all set before, and bits that were."""
    x = _indexed(spark, d)
    per = multiindex.collisions(x.frames, *x.shape()).join(x.frames.select("seq", "id"), "seq")
    return per.groupBy("id").agg(F.sum("frames").alias("frames"), F.sum("full").alias("full"), F.sum("bits_set").alias("bits_set"))


def mibf_rank(spark: SparkSession, d: str) -> DataFrame:
    return multiindex.ranks(mibf_bv(spark, d))


def mibf_first_writer(spark: SparkSession, d: str) -> DataFrame:
    x = _indexed(spark, d)
    return multiindex.first_writer(x.frames, *x.shape())


def mibf_reservoir(spark: SparkSession, d: str) -> DataFrame:
    x = _indexed(spark, d)
    return multiindex.reservoir(x.frames, *x.shape())


def mibf_saturation(spark: SparkSession, d: str) -> DataFrame:
    """The slots of the whole index: after the reservoir pass and the saturation."""
    return _indexed(spark, d).slots()


def _slots(spark: SparkSession, d: str) -> DataFrame:
    return _indexed(spark, d).slots()


def _lookup(spark: SparkSession, d: str) -> DataFrame:
    """Elements of the index, and those of the counting filters, which mostly miss."""
    x = _indexed(spark, d)
    probes = x.frames.select("elem").unionByName(inserted(spark, d).select(F.col("element").alias("elem")))
    return multiindex.lookup(probes, "elem", x.slots(), *x.shape())


def mibf_lookup(spark: SparkSession, d: str) -> DataFrame:
    return _lookup(spark, d)


def mibf_at(spark: SparkSession, d: str) -> DataFrame:
    return multiindex.at(_lookup(spark, d), 1)


def mibf_at_rank(spark: SparkSession, d: str) -> DataFrame:
    return multiindex.at_rank(_lookup(spark, d), 1)


def mibf_at_rank_strict(spark: SparkSession, d: str) -> DataFrame:
    return multiindex.at_rank(_lookup(spark, d), 0)


def mibf_seeded(spark: SparkSession, d: str) -> DataFrame:
    """An index of spaced seeds over the elements put under sources, asked for all of them and for those of the counting filters
    with one base changed, which a seed that leaves that base out still finds; one miss allowed."""
    x = _indexed(spark, d)
    family = hashing.seeded(SPACED)
    changed = F.concat(F.substring("element", 1, 3), F.translate(F.substring("element", 4, 1), "ACGT", "CATG"), F.substring("element", 5, K - 4))
    probes = x.frames.select("elem").unionByName(inserted(spark, d).select(changed.alias("elem")))
    slots = multiindex.saturated(multiindex.reservoir(x.frames, x.m, H, family), x.frames, x.m, H, family)
    return multiindex.at(multiindex.lookup(probes, "elem", slots, x.m, H, family), 1)


def mibf_id_counts(spark: SparkSession, d: str) -> DataFrame:
    return multiindex.id_counts(_slots(spark, d))


def mibf_stats(spark: SparkSession, d: str) -> DataFrame:
    return multiindex.stats(_slots(spark, d), H).withColumn("prob_saturated", F.round("prob_saturated", 9))


def mibf_check_values(spark: SparkSession, d: str) -> DataFrame:
    return multiindex.check_values(_slots(spark, d), HIGHEST)


def mibf_masks(spark: SparkSession, d: str) -> DataFrame:
    """Stored values of all slots, and their parts read back; the strand is taken from the rank here."""
    s = _slots(spark, d)
    raw = s.select("rank", multiindex.pack(F.col("id"), F.col("rank") % 2 == 1, F.col("saturated")).alias("raw"))
    id_, strand, sat = multiindex.unpack(F.col("raw"))
    return raw.select("rank", "raw", id_.alias("id"), strand.alias("strand"), sat.alias("saturated"))


def _rounded(probs: DataFrame) -> DataFrame:
    return probs.select("id", F.round("freq", 9).alias("freq"), F.round("prob", 9).alias("prob"))


def frame_probs(spark: SparkSession, d: str) -> DataFrame:
    x = _indexed(spark, d)
    return _rounded(multiindex.frame_probabilities(x.slots(), x.m, H, 1))


def frame_probs_strand(spark: SparkSession, d: str) -> DataFrame:
    """Over the index with strands, where id 0 counts in the whole."""
    x = _stranded(spark, d)
    return _rounded(multiindex.frame_probabilities(multiindex.insert_strand(x.frames, x.m, H, 1), x.m, H, 1, with_zero=True))


def slot_probs(spark: SparkSession, d: str) -> DataFrame:
    """Per id the probability that one random slot matches it."""
    x = _indexed(spark, d)
    counts = multiindex.id_counts(x.slots()).withColumn("pop", F.sum("n").over(Window.partitionBy(F.lit(0))))  # one row an id
    return counts.select("id", F.round(sizing.slot_probability(F.col("pop") / F.lit(float(x.m)), F.col("n") / F.col("pop")), 9).alias("prob"))


def sat_binomial(spark: SparkSession, d: str) -> DataFrame:
    """How likely fewer saturated slots than those of each id are, at the share of all slots."""
    counts = multiindex.id_counts(_slots(spark, d))
    total = counts.agg((F.sum("n_saturated") / F.sum("n")).alias("p")).withColumn("one", F.lit(1))
    rows = counts.withColumn("one", F.lit(1)).join(total, "one")
    return rows.select("id", F.round(sizing.saturation_cdf(F.col("n"), F.col("p"), F.col("n_saturated")), 6).alias("cdf"))


def mibf_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Slots after the index was stored and loaded: bit vector and values, each in its file, and nothing else."""
    x = _indexed(spark, d)
    slots = durable(x.slots(), "slots")
    path = _path(spark, "index")
    raw = slots.select("rank", "pos", multiindex.pack(F.col("id"), F.lit(False), F.col("saturated")).alias("raw"))
    filterfile.write_index(path, raw, x.m, H, K)
    id_, _, sat = multiindex.unpack(F.col("raw"))
    return filterfile.read_index(spark, path)[1].select("rank", "pos", id_.alias("id"), sat.alias("saturated"))


def mibf_insert(spark: SparkSession, d: str) -> DataFrame:
    x = _indexed(spark, d)
    return multiindex.insert(x.frames, x.m, H, 1)


def _stranded(spark: SparkSession, d: str) -> _Index:
    rows = table(spark, d, "mi_element").select("elem_id", "id", dna.clean(F.col("seq")).alias("c")).where((F.col("id") != 0) & dna.is_plain(F.col("c"))).dropDuplicates(["elem_id"])
    element = dna.strand_free(F.col("c"))
    return _Index.of(rows.select(F.col("elem_id").alias("seq"), F.lit(0).alias("pos"), element.alias("elem"), "id", F.array_repeat(element == F.col("c"), H).alias("strands")))


def mibf_insert_strand(spark: SparkSession, d: str) -> DataFrame:
    x = _stranded(spark, d)
    return multiindex.insert_strand(x.frames, x.m, H, 1)


def mibf_id_counts_strand(spark: SparkSession, d: str) -> DataFrame:
    return multiindex.id_counts_strand(mibf_insert_strand(spark, d))


# Classification: contigs with a source make the index, all contigs are reads.


def _packed(spark: SparkSession, d: str, family: str = hashing.DEFAULT) -> reads.Index:
    """The index of the contigs with a source, asked for the k-mers of all, none of which becomes a row."""
    size = lambda counts: counts.agg(sizing.size_from_occupancy(F.coalesce(F.sum("n"), F.lit(0)), F.lit(H), OCCUPANCY)).first()[0]
    return reads.Index(contigs(spark, d), K, H, size, family)


def _classified(index: reads.Index, found: DataFrame, max_miss: int = 0) -> DataFrame:
    return _rounded_results(classify.with_probabilities(found, multiindex.frame_probabilities(index.slots(), index.shape.m, H, max_miss)))


def mibf_all_counts(spark: SparkSession, d: str) -> DataFrame:
    return reads.all_counts(_packed(spark, d)).where("totalCount > 0")


def mibf_count_dump(spark: SparkSession, d: str) -> DataFrame:
    """The same with the names of the sources."""
    names = table(spark, d, "mi_source").groupBy(F.col("id").alias("s")).agg(F.max("name").alias("name"))
    counts = mibf_all_counts(spark, d)
    return counts.join(names, F.col("id") == F.col("s"), "left").select("read", "id", "name", "nonSatFrameCount", "count", "solidCount", "nonSatCount", "totalNonSatCount", "totalCount")


def mibf_match_signature(spark: SparkSession, d: str) -> DataFrame:
    return reads.signature(_packed(spark, d))


def mibf_rank_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Candidates of every read in their order; rows delivered again are one."""
    rows = table(spark, d, "query_result").drop("queried_at").distinct()
    return classify.ranked(rows, "read_id", "id").groupBy("read_id", "place").agg(F.max("id").alias("id"), F.max("nonSatFrameCount").alias("nonSatFrameCount"), F.max("count").alias("count"))


def mibf_count_predicates(spark: SparkSession, d: str) -> DataFrame:
    """The predicates on pairs of counters, over all rows and two of their counters."""
    a, b = F.col("count"), F.col("nonSatCount")
    rows = table(spark, d, "query_result").where(a.isNotNull() & b.isNotNull()).select("count", "nonSatCount").distinct()
    return rows.select("count", "nonSatCount", classify.roughly_equal(a, b, 1).alias("rough"), classify.within_error(a, b).alias("within"), classify.within_error_or_larger(a, b, 1.5).alias("larger"))


AGREED = classify.Options(extra=2.0, extra_frames=1 << 40, best_agrees=True, min_count=3, min_counts={1: 10})


def _rounded_results(found: DataFrame) -> DataFrame:
    return found.withColumn("frameProb", F.round("frameProb", 9))


def mibf_classify(spark: SparkSession, d: str) -> DataFrame:
    x = _packed(spark, d)
    return _classified(x, reads.folded(x))


def mibf_classify_agreed(spark: SparkSession, d: str) -> DataFrame:
    """With the check that the best two agree, a least count of an id of its own, and no early stop."""
    x = _packed(spark, d)
    return _classified(x, reads.folded(x, AGREED))


def mibf_classify_pair(spark: SparkSession, d: str) -> DataFrame:
    """Each contig as a pair of mates: its frames from the front, and those from the back, which are half as many."""
    x = _packed(spark, d)
    return _classified(x, reads.folded(x, paired=True))


def mibf_classify_seeded(spark: SparkSession, d: str) -> DataFrame:
    """Against an index of spaced seeds, frames with one miss taken too."""
    x = _packed(spark, d, hashing.seeded(SPACED))
    return _classified(x, reads.folded(x, max_miss=1), 1)


def mibf_evaluation(spark: SparkSession, d: str) -> DataFrame:
    return reads.evaluation(_packed(spark, d))


QUERIES = (
    mibf_bv, mibf_bv_collisions, mibf_rank, mibf_first_writer, mibf_reservoir, mibf_saturation, mibf_lookup, mibf_at, mibf_at_rank, mibf_at_rank_strict, mibf_seeded, mibf_id_counts, mibf_id_counts_strand, mibf_stats,
    mibf_check_values, mibf_masks, frame_probs, frame_probs_strand, slot_probs, sat_binomial, mibf_roundtrip, mibf_insert, mibf_insert_strand, mibf_all_counts, mibf_count_dump, mibf_match_signature,
    mibf_rank_candidates, mibf_count_predicates, mibf_classify, mibf_classify_agreed, mibf_classify_pair, mibf_classify_seeded, mibf_evaluation,
)


def _sql_shape() -> str:
    return f"""n AS (SELECT unnest(range(0, {H})) AS i),
shape AS (SELECT m, greatest(m // {blocks.SLOTS}, 1) AS b, m // greatest(m // {blocks.SLOTS}, 1) AS per FROM (SELECT {sql_size_from_occupancy('SELECT count(DISTINCT elem) FROM frames', OCCUPANCY, H)} AS m))"""


def _sql_at(elem: str) -> str:
    return f"{sql_block(elem, 'b')} * per + {sql_hash(elem, 'i')} % per"


#: Frames by turn: the first one of each element and id, numbered within its block.
_STEPS = """firsts AS (SELECT elem, id, {extra} min(struct_pack(seq := seq, pos := pos)) AS f FROM frames GROUP BY ALL),
turns AS (SELECT row_number() OVER () AS fid, id, {extra} elem, row_number() OVER (PARTITION BY """ + sql_block("elem", "b") + """ ORDER BY f, id) AS turn, b, per FROM firsts, shape),
steps AS MATERIALIZED (SELECT turn, list(struct_pack(fid := fid, id := id, {extra_field} slots := list_transform({order}, lambda i: """ + _sql_at("elem") + """))) AS xs FROM turns GROUP BY turn)"""


def _sql_slots() -> str:
    h = sql_hash("elem", "i")
    steps = _STEPS.format(extra="", extra_field="", order=f"range(0, {H})")
    return f"""{_sql_shape()},
hashed AS MATERIALIZED (SELECT seq, pos AS pos0, id, elem, i, {h} AS hash, {_sql_at("elem")} AS pos FROM frames, n, shape),
obs AS (SELECT DISTINCT seq, id, hash, pos FROM hashed),
numbered AS (SELECT *, row_number() OVER (PARTITION BY pos ORDER BY seq, id, hash) AS c FROM obs),
taken AS (SELECT pos, arg_max(id, c) FILTER (xor(hash, id) % c = c - 1) AS id, max(c) AS obs FROM numbered GROUP BY pos),
placed AS MATERIALIZED (SELECT pos, row_number() OVER (ORDER BY pos) - 1 AS rank, id, obs FROM taken),
{steps},
state(pos, id, obs, sat) USING KEY (pos) AS (
  SELECT pos, id::BIGINT, obs::BIGINT, false FROM placed UNION ALL SELECT -1, 0, 0, false
  UNION ALL
  (WITH now AS (SELECT id + 1 AS turn FROM state WHERE pos = -1),
   x AS (SELECT unnest(xs) AS x FROM steps JOIN now USING (turn)),
   s AS (SELECT x.fid AS fid, x.id AS own, unnest(x.slots) AS pos, unnest(range(0, {H})) AS i FROM x),
   v AS (SELECT s.*, r.id, r.obs, r.sat FROM s JOIN recurring.state r USING (pos)),
   w AS (SELECT *, count(*) OVER (PARTITION BY fid, id) > 1 OR id = 0 AS spare, bool_or(id = own) OVER (PARTITION BY fid) AS held FROM v),
   u AS (SELECT *, bool_or(spare) OVER (PARTITION BY fid) AS can, row_number() OVER (PARTITION BY fid ORDER BY spare DESC, obs DESC, i) AS place FROM w WHERE NOT held)
   SELECT pos, CASE WHEN can THEN own ELSE id END, CASE WHEN can THEN obs + 1 ELSE obs END, sat OR NOT can FROM u WHERE NOT can OR place = 1
   UNION ALL SELECT -1, turn, 0, false FROM now WHERE turn <= (SELECT max(turn) FROM steps))),
slots AS MATERIALIZED (SELECT s.pos, p.rank, s.id, s.obs, s.sat AS saturated FROM state s JOIN placed p USING (pos))"""


_INDEX = f"WITH RECURSIVE {SQL_INDEXED}, {SQL_INSERTED}, {_sql_slots()}"
_LOOKUP = f"""{_INDEX},
probes AS (SELECT elem FROM frames UNION SELECT element FROM inserted),
found AS (SELECT elem, i, p.pos, rank, id, saturated FROM (SELECT elem, i, {_sql_at("elem")} AS pos FROM probes, n, shape) p LEFT JOIN slots USING (pos)),
missed AS (SELECT elem, count(*) FILTER (rank IS NULL) AS misses, bool_and(coalesce(saturated, true)) AS all_saturated FROM found GROUP BY elem)"""
#: Elements as they are written, with whether they stand on the strand of their canonical form.
_STRANDED = f"frames AS (SELECT DISTINCT elem_id AS seq, 0 AS pos, least(c, {rev('c')}) AS elem, id, c = least(c, {rev('c')}) AS strand FROM (SELECT *, {CLEAN} AS c FROM mi_element WHERE id <> 0) WHERE regexp_full_match(c, '[ACGT]+'))"


def _sql_insert(stranded: bool) -> str:
    """Slots are tried by hash xor id; the value of a slot is its id, twice it and one more with the strand bit."""
    keyed = ", ".join(f"struct_pack(k := xor({sql_hash('elem', str(i))}, id), i := {i})" for i in range(H))
    steps = _STEPS.format(extra="strand," if stranded else "", extra_field="strand := strand," if stranded else "", order=f"list_transform(list_sort([{keyed}]), lambda y: y.i)")
    steps = steps.replace("ORDER BY f, id)", "ORDER BY f, id, strand)") if stranded else steps
    value = "x.id * 2 + CASE WHEN x.strand THEN 0 ELSE 1 END" if stranded else "x.id * 2"
    return f"""WITH RECURSIVE {_STRANDED if stranded else SQL_INDEXED}, {_sql_shape()}, {steps},
state(pos, id, sat) USING KEY (pos) AS (
  SELECT -1::BIGINT, 0::BIGINT, false
  UNION ALL
  (WITH now AS (SELECT id + 1 AS turn FROM state WHERE pos = -1),
   x AS (SELECT unnest(xs) AS x FROM steps JOIN now USING (turn)),
   s AS (SELECT x.fid AS fid, {value} AS own, unnest(x.slots) AS pos, unnest(range(0, {H})) AS i FROM x),
   v AS (SELECT s.*, coalesce(r.id, 0) AS id, coalesce(r.sat, false) AS sat FROM s LEFT JOIN recurring.state r USING (pos)),
   w AS (SELECT *, bool_or(id = own) OVER (PARTITION BY fid) AS held, bool_or(id = 0) OVER (PARTITION BY fid) AS can, row_number() OVER (PARTITION BY fid ORDER BY id = 0 DESC, i) AS place FROM v)
   SELECT pos, CASE WHEN can THEN own ELSE id END, sat OR NOT can FROM w WHERE NOT held AND (NOT can OR place = 1)
   UNION ALL SELECT -1, turn, false FROM now WHERE turn <= (SELECT max(turn) FROM steps))),
slots AS (SELECT pos, id // 2 AS id, id % 2 = 1 AS strand, sat AS saturated FROM state WHERE pos >= 0)"""


def _sql_prob(misses: int) -> str:
    return " + ".join(f"{math.comb(H, i)} * pow(occ, {i}) * pow(1 - occ, {H - i}) * (1 - pow(1 - freq, {i}))" for i in range(H - misses, H + 1))


def _sql_probs(index: str, least: int) -> str:
    return f"""{index}, c AS (SELECT id, count(*) AS n FROM slots GROUP BY id),
f AS (SELECT id, n / (sum(n) FILTER (id >= {least}) OVER ())::DOUBLE AS freq, sum(n) OVER () / m::DOUBLE AS occ FROM c, shape)
SELECT id, round(freq, 9) AS freq, round({_sql_prob(1)}, 9) AS prob FROM f WHERE id >= {least}"""


def _sql_seed_at(of: str) -> str:
    """Rows of a table with elem, one a seed: (its columns, i, hash, pos)."""
    under = lambda x, seed: " || ".join(f"substr({x}, {j + 1}, 1)" if c == "1" else "'-'" for j, c in enumerate(seed))
    words = "[" + ", ".join(f"least({under('elem', s)}, {under(rev('elem'), s)})" for s in SPACED) + "]"
    hashed_ = "('0x' || substr(md5(i || ':' || w), 1, 15))::BIGINT"
    return f"SELECT * EXCLUDE (w), {hashed_} AS hash, {hashed_} % m AS pos FROM (SELECT *, unnest({words}) AS w, unnest(range(0, {H})) AS i FROM {of}), shape"


def _sql_seed_slots() -> str:
    return f"""{_sql_shape()},
hashed AS MATERIALIZED (SELECT seq, id, elem, hash, pos FROM ({_sql_seed_at("(SELECT seq, id, elem FROM frames)")})),
obs AS (SELECT DISTINCT seq, id, hash, pos FROM hashed),
numbered AS (SELECT *, row_number() OVER (PARTITION BY pos ORDER BY seq, id, hash) AS c FROM obs),
taken AS (SELECT pos, arg_max(id, c) FILTER (xor(hash, id) % c = c - 1) AS id FROM numbered GROUP BY pos),
lost AS (SELECT h.elem, h.id AS own, bool_or(t.id = h.id) AS kept FROM hashed h JOIN taken t USING (pos) GROUP BY h.elem, h.id),
marks AS (SELECT DISTINCT h.pos FROM hashed h JOIN lost l ON l.elem = h.elem AND l.own = h.id WHERE NOT l.kept),
slots AS MATERIALIZED (SELECT t.*, k.pos IS NOT NULL AS saturated FROM taken t LEFT JOIN marks k USING (pos))"""


def _sql_seeded() -> str:
    return f"""WITH {SQL_INDEXED}, {SQL_INSERTED}, {_sql_seed_slots()},
probes AS (SELECT elem FROM frames UNION SELECT substr(element, 1, 3) || translate(substr(element, 4, 1), 'ACGT', 'CATG') || substr(element, 5) FROM inserted),
found AS (SELECT elem, i, p.pos, id, saturated FROM ({_sql_seed_at("probes")}) p LEFT JOIN slots USING (pos)),
missed AS (SELECT elem, count(*) FILTER (id IS NULL) AS misses, bool_and(coalesce(saturated, true)) AS all_saturated FROM found GROUP BY elem)
SELECT elem, misses, all_saturated, i, coalesce(id, 0) AS id FROM found JOIN missed USING (elem) WHERE misses <= 1"""


_READS = f"""WITH RECURSIVE {SQL_KMERS}, frames AS MATERIALIZED (SELECT seq_id AS seq, pos, element AS elem, id FROM kmers WHERE id <> 0), {_sql_slots()},
looked AS (SELECT elem, i, s.id, saturated FROM (SELECT elem, i, {_sql_at("elem")} AS pos FROM (SELECT DISTINCT element AS elem FROM kmers), n, shape) JOIN slots s USING (pos)),
whole AS (SELECT elem FROM looked GROUP BY elem HAVING count(*) = {H}),
matched AS (SELECT seq_id AS read, k.pos, i, l.id, saturated FROM kmers k JOIN looked l ON l.elem = k.element SEMI JOIN whole w ON w.elem = k.element)"""

#: The reads against an index of spaced seeds, one miss allowed.
_SEEDED_READS = f"""WITH RECURSIVE {SQL_KMERS}, frames AS MATERIALIZED (SELECT seq_id AS seq, pos, element AS elem, id FROM kmers WHERE id <> 0), {_sql_seed_slots()},
looked AS (SELECT p.elem, p.i, s.id, saturated FROM ({_sql_seed_at("(SELECT DISTINCT element AS elem FROM kmers)")}) p JOIN slots s USING (pos)),
whole AS (SELECT elem FROM looked GROUP BY elem HAVING count(*) >= {H - 1})"""
_SINGLE = "ord_frames AS (SELECT seq_id AS read, element AS elem, row_number() OVER (PARTITION BY seq_id ORDER BY pos) - 1 AS ord FROM kmers)"
_PAIRED = """mates AS (SELECT seq_id AS read, element AS elem, 0 AS mate, pos FROM kmers
  UNION ALL SELECT seq_id, element, 1, -pos FROM (SELECT *, count(*) OVER (PARTITION BY seq_id) AS n FROM kmers) WHERE pos * 2 >= n),
turned AS (SELECT *, row_number() OVER (PARTITION BY read, mate ORDER BY pos) AS turn FROM mates),
ord_frames AS (SELECT read, elem, row_number() OVER (PARTITION BY read ORDER BY turn, mate) - 1 AS ord FROM turned)"""
_EQUAL = "(greatest({0}, {1}) - sqrt(greatest({0}, {1})) <= least({0}, {1}) + sqrt(least({0}, {1})))"


def _sql_classified(frames: str, o: classify.Options, reads: str | None = None, misses: int = 0) -> str:
    """The classifier step by step: a turn takes the next frame of every read that is not settled yet. tally keeps a row of counters
    a read and id; at id -1 the best counters of the read, and at read -1 the number of the turn. Counters are c1 count, c2 nonSatCount,
    c3 totalCount, c4 totalNonSatCount, c5 nonSatFrameCount, c6 solidCount."""
    six = [f"c{j}" for j in range(1, 7)]
    least = "CASE " + " ".join(f"WHEN id = {k} THEN {v}" for k, v in o.min_counts.items()) + f" ELSE {o.min_count} END" if o.min_counts else str(o.min_count)
    raised = ", ".join(f"{c} := greatest(a.{c}, e.{c})" for c in six)
    start = ", ".join(f"{c} := coalesce(any_value(b{c}), 0)" for c in six)
    order = "c5 DESC, c1 DESC, c6 DESC, c2 DESC, c4 DESC, c3 DESC, id"
    tied = " AND ".join(f"top.{c} - sqrt(top.{c}) * {o.extra} <= {c} + sqrt({c}) * {o.extra}" for c in six)
    worse = " OR ".join(f"best[1].{c} < best[2].{c}" for c in six)
    return f"""{reads or _READS}, {frames},
per_elem AS (SELECT elem, list(struct_pack(i := i, id := id, sat := saturated) ORDER BY i) AS hits FROM looked SEMI JOIN whole USING (elem) GROUP BY elem),
got AS (SELECT read, ord, hits, row_number() OVER (PARTITION BY read ORDER BY ord) AS turn FROM ord_frames JOIN per_elem USING (elem)),
rounds AS MATERIALIZED (SELECT turn, list(struct_pack(read := read, ord := ord, hits := hits)) AS xs FROM got GROUP BY turn),
tally(read, id, c1, c2, c3, c4, c5, c6, cand, second, extra, stopped, satf, slots_seen) USING KEY (read, id) AS (
  SELECT -1::BIGINT, -1::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, false, 0::BIGINT, 0::BIGINT, NULL::BIGINT, 0::BIGINT, 0::BIGINT
  UNION ALL
  (WITH now AS (SELECT c1 + 1 AS turn FROM tally WHERE read = -1),
   x AS (SELECT unnest(xs) AS x FROM rounds JOIN now USING (turn)),
   f AS (SELECT x.read AS read, x.ord AS ord, x.hits AS hits FROM x),
   live AS (SELECT f.*, {", ".join(f"r.{c} AS b{c}" for c in six)}, r.second, r.extra, r.satf, r.slots_seen, coalesce(r.cand, false) AS any_yet
     FROM f LEFT JOIN recurring.tally r ON r.read = f.read AND r.id = -1 WHERE r.stopped IS NULL),
   h AS (SELECT read, unnest(hits) AS y FROM live),
   g AS (SELECT read, y.id AS id, count(*) AS total, count(*) FILTER (NOT y.sat) AS unsat, min(y.i) FILTER (NOT y.sat) AS fu, min(y.i) FILTER (y.sat) AS fs, bool_or(bool_or(y.sat)) OVER (PARTITION BY read) AS dirty, (sum(count(*)) OVER (PARTITION BY read)) AS hit FROM h GROUP BY read, y.id),
   n AS (SELECT g.read, g.id, coalesce(c1, 0) + (fu IS NOT NULL)::INT + (fs IS NOT NULL AND (fu IS NULL OR fs < fu))::INT AS c1, coalesce(c2, 0) + (fu IS NOT NULL)::INT AS c2, coalesce(c3, 0) + total AS c3,
     coalesce(c4, 0) + unsat AS c4, coalesce(c5, 0) + (NOT dirty)::INT AS c5, coalesce(c6, 0) + (NOT dirty AND hit = {H})::INT AS c6, coalesce(r.cand, false) AS cand, coalesce(fu, fs) AS place, dirty
     FROM g LEFT JOIN recurring.tally r ON r.read = g.read AND r.id = g.id),
   e AS (SELECT live.read, any_value(ord) AS ord, bool_or(dirty) AS dirty, any_value(len(hits)) AS seen, coalesce(any_value(extra), 0) AS extra, coalesce(any_value(satf), 0) AS satf, coalesce(any_value(slots_seen), 0) AS slots_seen,
     list_reduce(list(struct_pack(id := n.id, least := ({least.replace('id', 'n.id') if o.min_counts else least})::BIGINT, {", ".join(f"{c} := n.{c}" for c in six)}) ORDER BY place),
       lambda a, e: CASE WHEN e.c1 >= e.least OR (a.any_yet AND e.c1 >= a.c1) THEN struct_pack({raised}, second := CASE WHEN e.c5 > a.c5 THEN a.second ELSE greatest(a.second, e.c5) END, any_yet := true, ids := list_append(a.ids, e.id)) ELSE a END,
       struct_pack({start}, second := coalesce(any_value(second), 0), any_yet := any_value(any_yet), ids := []::BIGINT[])) AS a
     FROM live JOIN n USING (read) GROUP BY live.read),
   z AS (SELECT *, CASE WHEN {_EQUAL.format("a.c4", "a.second")} THEN 0 ELSE extra END + (a.c5 > a.second)::INT AS more FROM e)
   SELECT read, id, c1, c2, c3, c4, c5, c6, cand OR list_contains(a.ids, id), 0, 0, NULL, 0, 0 FROM n JOIN (SELECT read, a FROM z) USING (read)
   UNION ALL SELECT read, -1, {", ".join(f"a.{c}" for c in six)}, a.any_yet, a.second, more, CASE WHEN a.c5 > a.second AND more > {o.extra_frames + 1} THEN ord + 1 END, satf + dirty::INT, slots_seen + seen FROM z
   UNION ALL SELECT -1, -1, turn, 0, 0, 0, 0, 0, false, 0, 0, NULL, 0, 0 FROM now WHERE turn <= (SELECT max(turn) FROM rounds))),
valid AS (SELECT t.read, t.id, {", ".join(f"t.{c}" for c in six)} FROM tally t JOIN tally b ON b.read = t.read AND b.id = -1
  WHERE t.id <> -1 AND t.cand AND b.c5 >= {o.min_frames} AND ({" OR ".join(_EQUAL.format(f"t.{c}", f"b.{c}") for c in six)})),
topped AS (SELECT *, first(struct_pack({", ".join(f"{c} := {c}" for c in six)})) OVER (PARTITION BY read ORDER BY {order}) AS top FROM valid),
kept AS (SELECT * FROM topped WHERE {tied}),
agreed AS (SELECT read, list(struct_pack({", ".join(f"{c} := {c}" for c in six)}) ORDER BY {order}) AS best FROM kept GROUP BY read),
c AS (SELECT id, count(*) AS n FROM slots GROUP BY id),
probs AS (SELECT id, {_sql_prob(misses)} AS prob FROM (SELECT id, sum(n) OVER () / m::DOUBLE AS occ, n / (sum(n) OVER ())::DOUBLE AS freq FROM c, shape)),
results AS (SELECT read, id, c1::INT AS "count", c2::INT AS nonSatCount, c3::INT AS totalCount, c4::INT AS totalNonSatCount, c5::INT AS nonSatFrameCount, c6::INT AS solidCount, round(coalesce(prob, 0), 9) AS frameProb
  FROM kept JOIN agreed USING (read) LEFT JOIN probs USING (id) WHERE {f"NOT (len(best) > 1 AND ({worse}))" if o.best_agrees else "true"})"""


_ALL_COUNTS = f"""{_READS},
f AS (SELECT read, pos, id, count(*) AS total, count(*) FILTER (NOT saturated) AS unsat, min(i) FILTER (NOT saturated) AS fu, min(i) FILTER (saturated) AS fs FROM matched GROUP BY read, pos, id),
s AS (SELECT read, pos, bool_or(saturated) AS any_sat FROM matched GROUP BY read, pos)
SELECT read, id, sum((fu IS NOT NULL)::INTEGER + (fs IS NOT NULL AND (fu IS NULL OR fs < fu))::INTEGER)::INTEGER AS count, count(fu)::INTEGER AS nonSatCount, sum(total)::INTEGER AS totalCount,
sum(unsat)::INTEGER AS totalNonSatCount, count(*) FILTER (NOT any_sat)::INTEGER AS nonSatFrameCount, count(*) FILTER (NOT any_sat)::INTEGER AS solidCount FROM f JOIN s USING (read, pos) GROUP BY read, id"""

ORACLES = {
    "mibf_bv": f"{_INDEX} SELECT pos FROM slots",
    "mibf_bv_collisions": f"""WITH {SQL_INDEXED}, {_sql_shape()}, o AS (SELECT seq, id, i, {_sql_at("elem")} AS pos, seq * {H} + i AS ord FROM frames, n, shape),
f AS (SELECT pos, min(ord) AS first FROM o GROUP BY pos),
s AS (SELECT seq, id, count(*) FILTER (first < ord) AS bits_set, max(first // {H}) < seq AS is_full FROM o JOIN f USING (pos) GROUP BY seq, id)
SELECT id, count(*) AS frames, count(*) FILTER (is_full) AS "full", sum(bits_set)::BIGINT AS bits_set FROM s GROUP BY id""",
    "mibf_rank": f"{_INDEX} SELECT pos, rank FROM slots",
    "mibf_first_writer": f"{_INDEX} SELECT pos, arg_min(id, seq) AS id FROM hashed GROUP BY pos",
    "mibf_reservoir": f"{_INDEX} SELECT pos, rank, id, obs FROM placed",
    "mibf_saturation": f"{_INDEX} SELECT pos, rank, id, obs, saturated FROM slots",
    "mibf_insert": f"{_sql_insert(False)} SELECT pos, id, strand, saturated FROM slots",
    "mibf_insert_strand": f"{_sql_insert(True)} SELECT pos, id, strand, saturated FROM slots",
    "mibf_id_counts_strand": f"{_sql_insert(True)} SELECT id, count(*) AS n, count(*) FILTER (strand) AS n_strand, count(*) FILTER (saturated) AS n_saturated FROM slots GROUP BY id",
    "mibf_seeded": _sql_seeded(),
    "mibf_lookup": f"{_LOOKUP} SELECT elem, i, pos, rank, id, saturated FROM found",
    "mibf_at": f"{_LOOKUP} SELECT elem, misses, all_saturated, i, coalesce(id, 0) AS id FROM found JOIN missed USING (elem) WHERE misses <= 1",
    "mibf_at_rank": f"{_LOOKUP} SELECT elem, misses, i, rank FROM found JOIN missed USING (elem) WHERE misses <= 1 AND rank IS NOT NULL",
    "mibf_at_rank_strict": f"{_LOOKUP} SELECT elem, misses, i, rank FROM found JOIN missed USING (elem) WHERE misses = 0",
    "mibf_id_counts": f"{_INDEX} SELECT id, count(*) AS n, count(*) FILTER (saturated) AS n_saturated FROM slots GROUP BY id",
    "mibf_stats": f"{_INDEX} SELECT count(*) AS pop, count(*) FILTER (id <> 0) AS pop_nonzero, count(*) FILTER (saturated) AS pop_saturated, round(pow(count(*) FILTER (saturated) / count(*)::DOUBLE, {H}), 9) AS prob_saturated FROM slots",
    "mibf_check_values": f"{_INDEX} SELECT coalesce(arg_min(id | CASE WHEN saturated THEN 2147483648 ELSE 0 END, rank) FILTER (id > {HIGHEST}), {HIGHEST})::BIGINT AS value FROM slots",
    "mibf_masks": f"{_INDEX} SELECT rank, id | CASE WHEN rank % 2 = 1 THEN 1073741824 ELSE 0 END | CASE WHEN saturated THEN 2147483648 ELSE 0 END AS raw, id, rank % 2 = 1 AS strand, saturated FROM slots",
    "frame_probs": _sql_probs(_INDEX, 1),
    "frame_probs_strand": _sql_probs(_sql_insert(True), 0),
    "slot_probs": f"{_INDEX}, c AS (SELECT id, count(*) AS n FROM slots GROUP BY id), p AS (SELECT *, sum(n) OVER () AS pop FROM c) SELECT id, round(pop / m::DOUBLE * (n / pop::DOUBLE), 9) AS prob FROM p, shape",
    "sat_binomial": f"""{_INDEX}, c AS (SELECT id, count(*) AS n, count(*) FILTER (saturated) AS s FROM slots GROUP BY id),
p AS (SELECT *, sum(s) OVER () / (sum(n) OVER ())::DOUBLE AS p FROM c)
SELECT id, round(CASE WHEN s = 0 THEN 0.0 ELSE list_sum(list_transform(range(0, s), lambda k: exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + k * ln(p) + (n - k) * ln(1 - p)))) END, 6) AS cdf FROM p""",
    "mibf_roundtrip": f"{_INDEX} SELECT rank, pos, id, saturated FROM slots",
    "mibf_match_signature": f"{_READS} SELECT read, pos, i, id, saturated FROM matched",
    "mibf_all_counts": _ALL_COUNTS,
    "mibf_classify": _sql_classified(_SINGLE, classify.Options()) + " SELECT * FROM results",
    "mibf_classify_agreed": _sql_classified(_SINGLE, AGREED) + " SELECT * FROM results",
    "mibf_classify_pair": _sql_classified(_PAIRED, classify.Options()) + " SELECT * FROM results",
    "mibf_classify_seeded": _sql_classified(_SINGLE, classify.Options(), _SEEDED_READS, 1) + " SELECT * FROM results",
    "mibf_evaluation": _sql_classified(_SINGLE, classify.Options())
    + """ SELECT f.read, coalesce(satf, 0) AS sat_frames, coalesce(slots_seen, 0) + coalesce(stopped, n) AS evaluated
FROM (SELECT read, count(*) AS n FROM ord_frames GROUP BY read) f LEFT JOIN tally t ON t.read = f.read AND t.id = -1""",
    "mibf_count_dump": f"""SELECT read, id, name, nonSatFrameCount, "count", solidCount, nonSatCount, totalNonSatCount, totalCount
FROM ({_ALL_COUNTS}) LEFT JOIN (SELECT id, max(name) AS name FROM mi_source GROUP BY id) USING (id)""",
    "mibf_count_predicates": """SELECT DISTINCT "count", nonSatCount, abs("count" - nonSatCount) <= 1 AS rough,
greatest("count", nonSatCount) - sqrt(greatest("count", nonSatCount)) <= least("count", nonSatCount) + sqrt(least("count", nonSatCount)) AS within,
"count" - sqrt("count") * 1.5::DOUBLE <= nonSatCount + sqrt(nonSatCount) * 1.5::DOUBLE AS larger FROM query_result WHERE "count" IS NOT NULL AND nonSatCount IS NOT NULL""",
    "mibf_rank_candidates": """WITH r AS (SELECT DISTINCT * EXCLUDE (queried_at) FROM query_result),
p AS (SELECT *, row_number() OVER (PARTITION BY read_id ORDER BY nonSatFrameCount DESC NULLS LAST, "count" DESC NULLS LAST, solidCount DESC NULLS LAST, nonSatCount DESC NULLS LAST, totalNonSatCount DESC NULLS LAST,
  totalCount DESC NULLS LAST, CASE WHEN isnan(frameProb) THEN NULL ELSE frameProb END DESC NULLS LAST, id ASC NULLS LAST)::INTEGER AS place FROM r)
SELECT read_id, place, id, nonSatFrameCount, "count" FROM p""",
}
