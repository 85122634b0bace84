"""k-mers of sequences as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftloom.functions import dna

#: Positions cut in one step; a substring counts from the start of its text, so long sequences are first cut into chunks.
CHUNK = 4096


def shred(rows: DataFrame, seq: str, k: int, keep: list[str]) -> DataFrame:
    """(keep, pos, kmer): every window of k letters, pos from 0; nothing for null or shorter sequences."""
    if k < 1:
        raise ValueError("k must be positive")
    cut = F.transform(F.sequence(F.lit(0), F.length(F.col(seq)) - k, F.lit(CHUNK)), lambda i: F.struct(i.alias("at"), F.col(seq).substr(i + 1, F.lit(CHUNK + k - 1)).alias("part")))
    parts = rows.where(F.length(F.col(seq)) >= k).select(*keep, F.explode(cut).alias("c")).select(*keep, "c.at", "c.part")
    return parts.select(*keep, "at", F.posexplode(dna.shred(F.col("part"), k)).alias("i", "kmer")).select(*keep, (F.col("at") + F.col("i")).alias("pos"), "kmer")


def canonical_kmers(rows: DataFrame, seq: str, k: int, keep: list[str]) -> DataFrame:
    """(keep, pos, element) of the windows of A, C, G and T only, the same for both strands."""
    plain = shred(rows, seq, k, keep).where(dna.is_plain(F.col("kmer")))
    return plain.select(*keep, "pos", dna.element(F.col("kmer")).alias("element"))


def masked(kmer: str, seed: str):
    """The letters of a k-mer under the care positions of a spaced seed; the others become '-'."""
    if not seed or set(seed) - {"0", "1"}:
        raise ValueError("a spaced seed is a string of 0 and 1")
    return F.concat(*[F.substring(F.col(kmer), j + 1, 1) if c == "1" else F.lit("-") for j, c in enumerate(seed)])


class KmerTable:
    """User-defined table function: SELECT * FROM kmers(seq, k)."""

    def eval(self, seq: str, k: int):
        for i in range(len(seq or "") - k + 1):
            yield i, seq[i : i + k]


def register(spark) -> None:
    schema = T.StructType([T.StructField("pos", T.IntegerType()), T.StructField("kmer", T.StringType())])
    spark.udtf.register("kmers", F.udtf(KmerTable, returnType=schema))
