"""Pieces that several query modules share: source relations and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftloom.functions import dna
from siftloom.operators import kmers
from siftloom.session import shuffle_partitions, table

K = 31


def contigs(spark: SparkSession, d: str) -> DataFrame:
    """(seq_id, id, filter_id, seq): cleaned records, each once; a missing source is 0. Spread by a number of partitions that the engine does
    not join up again, as k-mers are many times their text."""
    rows = table(spark, d, "contig").select("seq_id", F.coalesce("id", F.lit(0)).alias("id"), "filter_id", dna.clean(F.col("seq")).alias("seq"))
    return rows.repartition(shuffle_partitions(spark), "seq_id").dropDuplicates(["seq_id"])


def contig_kmers(spark: SparkSession, d: str) -> DataFrame:
    """(seq_id, id, pos, element)."""
    return kmers.canonical_kmers(contigs(spark, d), "seq", K, ["seq_id", "id"])


def inserted(spark: SparkSession, d: str) -> DataFrame:
    """(seq_id, pos, filter_id, element) of the counting filters' rows that carry an element."""
    return dna.elements(table(spark, d, "cbf_insert").select("seq_id", "pos", "seq", "filter_id")).drop("seq")


def indexed(spark: SparkSession, d: str) -> DataFrame:
    """(seq, pos, elem, id): elements put under a source, as frames of one k-mer."""
    rows = dna.elements(table(spark, d, "mi_element").select("elem_id", "id", "seq").where(F.col("id") != 0))
    frames = rows.select(F.col("elem_id").alias("seq"), F.lit(0).alias("pos"), F.col("element").alias("elem"), "id")
    return frames.dropDuplicates(["seq"])


CLEAN = "upper(translate(seq, ' ' || chr(9) || chr(10) || chr(13), ''))"


def rev(x: str) -> str:
    return f"reverse(translate({x}, 'ATCG', 'TAGC'))"


def sql_hash(x: str, i: str) -> str:
    """hashing.md5_pair in SQL."""
    return f"(('0x' || substr(md5({x}), 1, 15))::BIGINT + {i} * (('0x' || substr(md5({x}), 16, 13))::BIGINT | 1))"


def sql_block(x: str, blocks: str) -> str:
    """hashing.block_of in SQL."""
    return f"((('0x' || substr(md5({x}), 1, 15))::BIGINT >> 30) % ({blocks}))"


def _sql_padded(v: str) -> str:
    return f"(SELECT v + (64 - v % 64) FROM (SELECT floor({v})::BIGINT AS v))"


def sql_optimal_size(n: str, fpr: float, h: int) -> str:
    """sizing.optimal_size in SQL; n is a scalar."""
    return _sql_padded(f"-({n})::DOUBLE * {h} / ln(1 - pow({fpr}::DOUBLE, 1.0::DOUBLE / {h}))")


def sql_size_from_occupancy(n: str, occupancy: float, h: int) -> str:
    return _sql_padded(f"-({n})::DOUBLE * {h} / ln(1 - {occupancy}::DOUBLE)")


SQL_CONTIGS = f"contigs AS (SELECT DISTINCT seq_id, coalesce(id, 0) AS id, filter_id, {CLEAN} AS seq FROM contig)"
SQL_KMERS = f"""{SQL_CONTIGS},
windows AS (SELECT seq_id, id, pos, substr(seq, pos + 1, {K}) AS kmer FROM (SELECT seq_id, id, seq, unnest(range(0, length(seq) - {K - 1}))::INTEGER AS pos FROM contigs WHERE length(seq) >= {K})),
kmers AS (SELECT seq_id, id, pos, least(kmer, {rev("kmer")}) AS element FROM windows WHERE regexp_full_match(kmer, '[ACGT]+'))"""
SQL_INSERTED = f"inserted AS (SELECT seq_id, pos, filter_id, least(c, {rev('c')}) AS element FROM (SELECT *, {CLEAN} AS c FROM cbf_insert) WHERE regexp_full_match(c, '[ACGT]+'))"
SQL_INDEXED = f"frames AS (SELECT DISTINCT elem_id AS seq, 0 AS pos, least(c, {rev('c')}) AS elem, id FROM (SELECT *, {CLEAN} AS c FROM mi_element WHERE id <> 0) WHERE regexp_full_match(c, '[ACGT]+'))"
