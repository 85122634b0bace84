"""Queries of k-mers, hashes and sizing formulas."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftloom.functions import dna, hashing, sizing
from siftloom.operators import bloom, hot, kmers, multiindex
from siftloom.operators.filters import BitFilter, Shape
from siftloom.plans.common import K, SQL_CONTIGS, SQL_INSERTED, SQL_KMERS, contig_kmers, contigs, inserted, rev, sql_hash, sql_optimal_size
from siftloom.session import durable, shared_dir, table
from siftloom.sources import fasta

#: The filter over all k-mers of contigs with a source, which is sized by them.
FPR, H = 0.01, 3


def fasta_scan(spark: SparkSession, d: str) -> DataFrame:
    """Contigs after they were written as FASTA text and read again, records counted by name and length."""
    path = f"{shared_dir(spark)}/fasta-{uuid.uuid4().hex}"
    fasta.write_fasta(contigs(spark, d), path, "seq_id", "seq")
    return fasta.read_fasta(spark, path).select(F.col("name").cast("bigint").alias("seq_id"), "seq")


def kmer_shred(spark: SparkSession, d: str) -> DataFrame:
    return kmers.shred(contigs(spark, d), "seq", K, ["seq_id"])


def revcomp(spark: SparkSession, d: str) -> DataFrame:
    return contigs(spark, d).where(F.col("seq").isNotNull()).select("seq_id", dna.reverse_complement(F.col("seq")).alias("revcomp"))


def canonical_kmer(spark: SparkSession, d: str) -> DataFrame:
    """Letters other than A, C, G and T as N, the smaller strand of each k-mer, and how often it stands in the contigs."""
    plain = contigs(spark, d).select("seq_id", F.regexp_replace("seq", "[^ACGT]", "N").alias("seq"))
    rows = kmers.shred(plain, "seq", K, ["seq_id"]).select(dna.strand_free(F.col("kmer")).alias("kmer"))
    return rows.groupBy("kmer").agg(F.count(F.lit(1)).alias("n"))


def _words(spark: SparkSession, d: str) -> DataFrame:
    return inserted(spark, d).select("element").distinct()


def _strands(spark: SparkSession, d: str) -> DataFrame:
    """(kmer, f, r, c): forward, reverse and canonical hash of every element."""
    forward, reverse, canonical = hashing.strand_hashes(F.col("kmer"), K)
    return _words(spark, d).select(F.col("element").alias("kmer")).withColumns({"f": forward, "r": reverse}).withColumn("c", hashing.unsigned_least(F.col("f"), F.col("r")))


def kmer_hash(spark: SparkSession, d: str) -> DataFrame:
    """Forward, reverse and canonical hash of every element, as hex."""
    return _strands(spark, d).select("kmer", F.hex("f").alias("fwd"), F.hex("r").alias("rev"), F.hex("c").alias("hash"))


def multi_hash(spark: SparkSession, d: str) -> DataFrame:
    return _strands(spark, d).select("kmer", F.posexplode(hashing.xor_hashes(F.col("c"), 4)).alias("i", "h")).select("kmer", "i", F.hex("h").alias("hash"))


def kmer_hash_ext(spark: SparkSession, d: str) -> DataFrame:
    """Hashes of the multiplicative family, as hex."""
    return _strands(spark, d).select("kmer", F.posexplode(hashing.extended_hashes(F.col("c"), K, 4)).alias("i", "h")).select("kmer", "i", F.hex("h").alias("hash"))


def bit_positions(spark: SparkSession, d: str) -> DataFrame:
    """Positions of the full 64-bit canonical hash, read as unsigned, in a size that is no power of two."""
    pos = hashing.unsigned_mod(F.col("c"), 1_000_003)
    return _strands(spark, d).select("kmer", pos.alias("pos")).select("kmer", "pos", F.expr("pos div 8").alias("byte"), F.expr("cast(shiftleft(1, cast(pos % 8 as int)) as int)").alias("mask"))


SEEDS = ("1011001101", "1101111011", "1110110111", "1111111111")


def seed_parse(spark: SparkSession, d: str) -> DataFrame:
    """Don't-care positions of spaced seeds; -1 for a seed without any."""
    seeds = spark.createDataFrame([(s,) for s in SEEDS], "seed string")
    return seeds.select("seed", F.explode_outer(multiindex.parse_seed(F.col("seed"))).alias("skip")).select("seed", F.coalesce("skip", F.lit(-1)).alias("skip"))


def _distinct(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """((seq_id, element, at), (element, n, sourced)): the k-mers of each contig with their places, written once; and every
    element with its rows of the first table and whether a contig with a source has it."""
    rows = contig_kmers(spark, d).groupBy("seq_id", "id", "element").agg(F.collect_list("pos").alias("at"))
    placed = durable(rows, "kmers")
    each = placed.groupBy("element").agg(F.count(F.lit(1)).alias("n"), F.bool_or(F.col("id") != 0).alias("sourced"))
    return placed, durable(each, "elements")


def _filter(each: DataFrame) -> BitFilter:
    members = each.where("sourced").select("element")
    # The elements are distinct already, so a count will do.
    return BitFilter.of(members, "element", Shape.sized(members.count(), FPR, H, K))


def _elements(spark: SparkSession, d: str) -> DataFrame:
    """(element, sourced) without the places, for what needs none."""
    return durable(contig_kmers(spark, d).groupBy("element").agg(F.bool_or(F.col("id") != 0).alias("sourced")), "elements")


def kmer_bf_build(spark: SparkSession, d: str) -> DataFrame:
    """Set bits by bucket of the packed filter."""
    return bloom.packed(_filter(_elements(spark, d)).bits).select("bucket", F.bitmap_count("bitmap").alias("ones"))


def kmer_contains(spark: SparkSession, d: str) -> DataFrame:
    each = _elements(spark, d)
    return _filter(each).contains(each, "element")


def _answered(spark: SparkSession, d: str, hits_only: bool | None = None) -> DataFrame:
    """(seq_id, element, at, hit). An element that most contigs have is a hot key, whose rows are spread."""
    placed, each = _distinct(spark, d)
    hits = _filter(each).contains(each, "element")
    hits = hits if hits_only is None else hits.where(F.col("hit") == hits_only)
    return hot.joined(placed.drop("id"), hits, "element", ["seq_id"], hot.hot_keys(each, "element", "n"))


def kmer_hit_summary(spark: SparkSession, d: str) -> DataFrame:
    """Per contig: k-mers found in the filter, and all of them."""
    n = F.size("at").cast("bigint")
    return _answered(spark, d).groupBy("seq_id").agg(F.sum(F.when(F.col("hit"), n).otherwise(0)).alias("hits"), F.sum(n).alias("total"))


def missing_kmers(spark: SparkSession, d: str) -> DataFrame:
    return _answered(spark, d, False).select("seq_id", F.explode("at").alias("pos"), "element")


def _filters(spark: SparkSession, d: str) -> DataFrame:
    """(snapshot_id, n, m, h, fpr): claims of the filters with their headers; unusable hash numbers by the error rate."""
    s = table(spark, d, "filter_snapshot").where("Entry > 0").select("snapshot_id", "filter_id", F.col("Entry").alias("n")).distinct()
    f = table(spark, d, "bit_filter").where("dFPR > 0").select("filter_id", F.col("BloomFilterSize").alias("m"), F.col("HashNum").alias("header_h"), F.col("dFPR").alias("fpr"))
    return s.join(f, "filter_id").withColumn("h", F.when(F.col("header_h") > 0, F.col("header_h")).otherwise(sizing.optimal_hashes(F.col("fpr")))).drop("header_h", "filter_id")


def sizing_(spark: SparkSession, d: str) -> DataFrame:
    return _filters(spark, d).select("snapshot_id", "n", "h", "fpr", sizing.optimal_size(F.col("n"), F.col("fpr"), F.col("h")).alias("best_m"), sizing.optimal_hashes(F.col("fpr")).alias("best_h"))


def fpr_model(spark: SparkSession, d: str) -> DataFrame:
    return _filters(spark, d).select("snapshot_id", F.round(sizing.modelled_fpr(F.col("m"), F.col("n"), F.col("h")), 6).alias("fpr_now"), F.round(sizing.optimal_fpr(F.col("h")), 9).alias("fpr_best"))


def redundancy_fpr(spark: SparkSession, d: str) -> DataFrame:
    return _filters(spark, d).select("snapshot_id", F.round(sizing.redundancy_fpr(F.col("m"), F.col("n"), F.col("h")), 6).alias("fpr_mean"))


def mibf_sizing(spark: SparkSession, d: str) -> DataFrame:
    return _filters(spark, d).select("snapshot_id", sizing.size_from_occupancy(F.col("n"), F.col("h"), 0.5).alias("m"))


def cli_sizing(spark: SparkSession, d: str) -> DataFrame:
    """Sizes as the command-line writer takes them, from the bytes of each filter's text."""
    per = table(spark, d, "contig").groupBy("filter_id").agg(F.sum(F.octet_length("seq")).alias("n")).join(table(spark, d, "bit_filter").where("dFPR > 0").select("filter_id", "dFPR"), "filter_id").where("n > 0")
    return per.withColumn("m", sizing.tool_size(F.col("n"), F.col("dFPR"))).select("filter_id", "n", "m", sizing.tool_hashes(F.col("n"), F.col("m")).alias("h"))


QUERIES = (fasta_scan, kmer_shred, revcomp, canonical_kmer, kmer_hash, multi_hash, kmer_hash_ext, bit_positions, seed_parse, kmer_bf_build, kmer_contains, kmer_hit_summary, missing_kmers, sizing_, fpr_model, redundancy_fpr, mibf_sizing, cli_sizing)

_WORDS = f"WITH {SQL_INSERTED}, words AS (SELECT DISTINCT element AS kmer FROM inserted)"
_PER = f"{sql_hash('element', 'i')} % m"
_FILTER = f"""WITH {SQL_KMERS},
n AS (SELECT unnest(range(0, {H})) AS i),
m AS (SELECT {sql_optimal_size('SELECT count(DISTINCT element) FROM kmers WHERE id <> 0', FPR, H)} AS m),
bits AS (SELECT DISTINCT {_PER} AS pos FROM (SELECT DISTINCT element FROM kmers WHERE id <> 0), n, m),
answers AS (SELECT element, bool_and(b.pos IS NOT NULL) AS hit FROM (SELECT element, {_PER} AS pos FROM (SELECT DISTINCT element FROM kmers), n, m) p LEFT JOIN bits b USING (pos) GROUP BY element)"""
_HEADERS = """WITH f AS (SELECT DISTINCT snapshot_id, filter_snapshot.Entry AS n, BloomFilterSize AS m, dFPR AS fpr,
  CASE WHEN HashNum > 0 THEN HashNum ELSE floor(-ln(dFPR) / ln(2))::INTEGER END AS h
  FROM filter_snapshot JOIN bit_filter USING (filter_id) WHERE filter_snapshot.Entry > 0 AND dFPR > 0)"""


def _sql_rotated(base: str, turn: int, complement: bool) -> str:
    seeds = hashing.SEEDS[::-1] if complement else hashing.SEEDS
    r = turn % 64
    values = [((s << r | s >> (64 - r)) & hashing.MASK if r else s) for s in seeds]
    whens = " ".join(f"WHEN '{c}' THEN {v}::UBIGINT" for c, v in zip("ACGT", values))
    return f"CASE {base} {whens} END"


def _sql_strands(k: int) -> str:
    def folded(terms: list[str]) -> str:
        out = terms[0]
        for t in terms[1:]:
            out = f"xor({out}, {t})"
        return out

    letters = [f"substr(kmer, {j + 1}, 1)" for j in range(k)]
    fwd = folded([_sql_rotated(x, k - 1 - j, False) for j, x in enumerate(letters)])
    back = folded([_sql_rotated(x, j, True) for j, x in enumerate(letters)])
    return f"SELECT kmer, {fwd} AS f, {back} AS r FROM words"


_STRANDS = f"{_WORDS}, strands AS (SELECT kmer, f, r, least(f, r) AS c FROM ({_sql_strands(K)}))"


def _sql_seed(i: int) -> int:
    v = hashing.VAR_SEED
    return (v << i | v >> (64 - i)) & hashing.MASK if i else v


ORACLES = {
    "fasta_scan": f"WITH {SQL_CONTIGS} SELECT seq_id, coalesce(seq, '') AS seq FROM contigs",
    "kmer_shred": f"WITH {SQL_KMERS} SELECT seq_id, pos, kmer FROM windows",
    "revcomp": f"WITH {SQL_CONTIGS} SELECT seq_id, reverse(translate(seq, '{dna.IUPAC}', '{dna.IUPAC_COMPLEMENT}')) AS revcomp FROM contigs WHERE seq IS NOT NULL",
    "canonical_kmer": f"""WITH {SQL_CONTIGS}, p AS (SELECT seq_id, regexp_replace(seq, '[^ACGT]', 'N', 'g') AS seq FROM contigs WHERE length(seq) >= {K}),
w AS (SELECT substr(seq, pos + 1, {K}) AS k FROM (SELECT seq, unnest(range(0, length(seq) - {K - 1})) AS pos FROM p))
SELECT least(k, {rev("k")}) AS kmer, count(*) AS n FROM w GROUP BY 1""",
    "kmer_hash": f"{_STRANDS} SELECT kmer, printf('%X', f) AS fwd, printf('%X', r) AS rev, printf('%X', c) AS hash FROM strands",
    "multi_hash": f"{_STRANDS} SELECT kmer, i, printf('%X', xor(c, v)) AS hash FROM strands, (VALUES {', '.join(f'({i}, {_sql_seed(i)}::UBIGINT)' for i in range(4))}) s(i, v)",
    "kmer_hash_ext": f"""{_STRANDS}, s(i, f) AS (VALUES {', '.join(f'({i}, {(i ^ K * hashing.MULTIPLIER) & hashing.MASK}::UHUGEINT)' for i in range(1, 4))}),
e AS (SELECT kmer, i, (c::UHUGEINT * s.f % 18446744073709551616::UHUGEINT)::UBIGINT AS v FROM strands, s)
SELECT kmer, 0 AS i, printf('%X', c) AS hash FROM strands UNION ALL SELECT kmer, i, printf('%X', xor(v, v >> {hashing.SHIFT})) FROM e""",
    "bit_positions": f"{_STRANDS}, p AS (SELECT kmer, (c % 1000003)::BIGINT AS pos FROM strands) SELECT kmer, pos, pos // 8 AS byte, (1 << (pos % 8)::INTEGER)::INTEGER AS mask FROM p",
    "seed_parse": f"""WITH s AS (SELECT unnest([{', '.join(repr(s) for s in SEEDS)}]) AS seed),
p AS (SELECT seed, list_filter(range(0, length(seed)), lambda j: substr(seed, j + 1, 1) = '0') AS skips FROM s)
SELECT seed, unnest(CASE WHEN len(skips) = 0 THEN [-1] ELSE skips END)::INTEGER AS skip FROM p""",
    "kmer_bf_build": f"{_FILTER} SELECT pos // 32768 AS bucket, count(*) AS ones FROM bits GROUP BY 1",
    "kmer_contains": f"{_FILTER} SELECT element, hit FROM answers",
    "kmer_hit_summary": f"{_FILTER} SELECT seq_id, count(*) FILTER (hit) AS hits, count(*) AS total FROM kmers JOIN answers USING (element) GROUP BY seq_id",
    "missing_kmers": f"{_FILTER} SELECT seq_id, pos, element FROM kmers JOIN answers USING (element) WHERE NOT hit",
    "sizing": f"{_HEADERS}, v AS (SELECT *, floor(-n * h / ln(1 - pow(fpr, 1.0 / h)))::BIGINT AS v FROM f) SELECT snapshot_id, n, h, fpr, v + (64 - v % 64) AS best_m, floor(-ln(fpr) / ln(2))::INTEGER AS best_h FROM v",
    "fpr_model": f"{_HEADERS} SELECT snapshot_id, round(pow(1 - pow(1 - 1.0::DOUBLE / m, n::DOUBLE * h), h), 6) AS fpr_now, round(pow(2.0, -h), 9) AS fpr_best FROM f",
    "redundancy_fpr": f"""{_HEADERS} SELECT snapshot_id, round(CASE WHEN n = 1 THEN pow(1 - pow(1 - 1.0::DOUBLE / m, h), h)
  ELSE list_sum(list_transform(range(1, n), lambda i: pow(1 - pow(1 - 1.0::DOUBLE / m, i::DOUBLE * h), h))) / n END, 6) AS fpr_mean FROM f""",
    "mibf_sizing": f"{_HEADERS}, v AS (SELECT *, floor(-n * h / ln(1 - 0.5::DOUBLE))::BIGINT AS v FROM f) SELECT snapshot_id, v + (64 - v % 64) AS m FROM v",
    "cli_sizing": f"""WITH c AS (SELECT filter_id, sum(strlen(seq))::BIGINT AS n FROM contig GROUP BY filter_id),
v AS (SELECT filter_id, n, ceil(-n * ln(dFPR) / {math.log(2.0) ** 2!r}::DOUBLE)::BIGINT AS v FROM c JOIN bit_filter USING (filter_id) WHERE dFPR > 0 AND n > 0)
SELECT filter_id, n, v + (64 - v % 64) AS m, floor((v + (64 - v % 64)) / n::DOUBLE * {math.log(2.0)!r}::DOUBLE)::INTEGER AS h FROM v""",
}
