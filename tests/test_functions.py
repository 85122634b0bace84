import math
import random

import pytest
from pyspark.sql import functions as F

from siftloom.functions import dna, hashing, sizing
from siftloom.operators import kmers


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


@pytest.mark.parametrize("h", [0, 1, 2**63 - 1, 2**63, 2**64 - 1, 2**64 - 59])
@pytest.mark.parametrize("m", [1, 2, 1000, 2**32 - 5, 2**61])
def test_unsigned_mod(spark, h, m):
    assert one(spark, hashing.unsigned_mod(F.lit(hashing.signed(h)).cast("bigint"), m))[0] == h % m


@pytest.mark.parametrize("r", [0, 1, 31, 63, 64, 65])
def test_rotate(spark, r):
    x = 0x8000000000000001
    want = (x << (r % 64) | x >> (64 - r % 64)) & hashing.MASK if r % 64 else x
    assert one(spark, hashing.rotate_left(F.lit(hashing.signed(x)).cast("bigint"), r))[0] == hashing.signed(want)


def test_md5_golden(spark):
    assert one(spark, F.conv(F.substring(F.md5(F.lit("abc")), 1, 15), 16, 10).cast("bigint"))[0] == 648541476951500027


def rol(x, r):
    r %= 64
    return (x << r | x >> (64 - r)) & hashing.MASK if r else x


@pytest.mark.parametrize("k", [1, 4, 15, 31, 64, 70])
def test_strand_hash_rolls(spark, k):
    rng = random.Random(k)
    s = "".join(rng.choice("ACGT") for _ in range(k + 5))
    seed = dict(zip("ACGT", hashing.SEEDS))
    comp = dict(zip("ACGT", "TGCA"))
    df = spark.createDataFrame([(i, s[i : i + k]) for i in range(6)], "i int, kmer string")
    f, r, c = hashing.strand_hashes(F.col("kmer"), k)
    got = {x.i: (x.f & hashing.MASK, x.r & hashing.MASK, x.c & hashing.MASK) for x in df.select("i", f.alias("f"), r.alias("r"), c.alias("c")).collect()}
    fwd = rev = 0
    for j in range(k):
        fwd, rev = rol(fwd, 1) ^ seed[s[j]], rev ^ rol(seed[comp[s[j]]], j)
    for i in range(6):
        if i:
            out, into = s[i - 1], s[i - 1 + k]
            fwd = rol(fwd, 1) ^ rol(seed[out], k) ^ seed[into]
            rev = rol(rev ^ seed[comp[out]] ^ rol(seed[comp[into]], k), 63)
        assert got[i] == (fwd, rev, min(fwd, rev))


def test_hash_is_the_same_for_both_strands(spark):
    df = spark.createDataFrame([("ACGTTGCAAGG",), ("CCTTGCAACGT",)], "kmer string")
    assert df.select(hashing.strand_hashes(F.col("kmer"), 11)[2]).distinct().count() == 1


def test_extended_hashes_keep_nulls(spark):
    df = spark.createDataFrame([(5,), (None,)], "x bigint").select(hashing.extended_hashes(F.col("x"), 4, 3).alias("h"))
    got = [r.h for r in df.collect()]
    assert len(got[0]) == 3 and got[0][0] == 5 and got[1] is None


@pytest.mark.parametrize("family", sorted(hashing.FAMILIES))
def test_families_take_numbers_and_columns(spark, family):
    df = spark.createDataFrame([("abc", 3), ("x", 3)], "x string, h int")
    got = df.select(hashing.hashes(F.col("x"), 3, family).alias("a"), hashing.hashes(F.col("x"), F.col("h"), family).alias("b")).collect()
    assert all(r.a == r.b and len(set(r.a)) == 3 for r in got)


def test_pairs_of_hashes(spark):
    d = "900150983cd24fb0d6963f7d28e17f72"  # md5 of abc
    assert one(spark, hashing.hashes(F.lit("abc"), 3))[0] == [int(d[:15], 16) + i * (int(d[15:28], 16) | 1) for i in range(3)]
    with pytest.raises(ValueError):
        hashing.positions(F.lit("abc"), 0, 3)


def golden(spark, col):
    return one(spark, col)[0]


@pytest.mark.parametrize("n,h,p,want", [(1000, 3, 0.01, 12416), (10**6, 3, 0.01, 12364224), (10**6, 13, 1e-4, 19172992)])
def test_optimal_size(spark, n, h, p, want):
    assert golden(spark, sizing.optimal_size(F.lit(n), F.lit(p), F.lit(h))) == want


@pytest.mark.parametrize("p,want", [(0.5, 1), (0.1, 3), (0.01, 6), (0.001, 9), (1e-4, 13), (0.6, 0)])
def test_optimal_hashes(spark, p, want):
    assert golden(spark, sizing.optimal_hashes(F.lit(p))) == want


@pytest.mark.parametrize("n,want", [(1000, 5824), (10**6, 5770816)])
def test_size_from_occupancy(spark, n, want):
    assert golden(spark, sizing.size_from_occupancy(F.lit(n), F.lit(4), 0.5)) == want


def test_models(spark):
    assert golden(spark, sizing.modelled_fpr(F.lit(1000), F.lit(100), F.lit(4))) == pytest.approx(0.0118325089570)
    assert golden(spark, sizing.modelled_fpr(F.lit(64000), F.lit(10000), F.lit(4))) == pytest.approx(0.0466492477006)
    for n, want in ((1, 2.5447e-10), (2, 1.2723e-10), (100, 0.00264100153586)):
        assert golden(spark, sizing.redundancy_fpr(F.lit(1000), F.lit(n), F.lit(4))) == pytest.approx(want, rel=1e-4)
    for m, n, h in ((1000, 65, 4), (1000, 66, 4), (1000, 5000, 4), (10**6, 40_000, 1), (10**6, 40_000, 13), (64, 100_000, 2)):
        exact = math.fsum((1 - (1 - 1 / m) ** (i * h)) ** h for i in range(1, n)) / n
        assert golden(spark, sizing.redundancy_fpr(F.lit(m), F.lit(n), F.lit(h))) == pytest.approx(exact, rel=1e-6)
    assert golden(spark, sizing.redundancy_fpr(F.lit(10**10), F.lit(10**9), F.lit(4))) < 0.05
    assert golden(spark, sizing.frame_probability(F.lit(0.5), 4, F.lit(0.1), 0)) == pytest.approx(0.02149375)
    assert golden(spark, sizing.frame_probability(F.lit(0.5), 4, F.lit(0.1), 1)) == pytest.approx(0.08924375)
    for n, want in ((1000, (19200, 13)), (10**6, (19170176, 13))):
        m = golden(spark, sizing.tool_size(F.lit(n), F.lit(1e-4)))
        assert (m, golden(spark, sizing.tool_hashes(F.lit(n), F.lit(m)))) == want


@pytest.mark.parametrize("n,p,sat", [(10, 0.3, 0), (10, 0.3, 1), (10, 0.3, 4), (3000, 0.4, 1200), (200_000, 0.001, 190), (200_000, 0.7, 140_300), (50, 0.9, 50), (50, 0.9, 51), (5, 0.0, 2), (5, 1.0, 3), (5, 1.0, 6)])
def test_saturation_cdf(spark, n, p, sat):
    exact = sum(math.exp(math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + (k * math.log(p) if k else 0) + ((n - k) * math.log(1 - p) if n - k else 0)) for k in range(min(sat, n + 1))) if 0 < p < 1 else float(sat > 0 and (p == 0 or sat > n))
    assert golden(spark, sizing.saturation_cdf(F.lit(n), F.lit(p), F.lit(sat))) == pytest.approx(exact, abs=1e-8)


def test_sequences(spark):
    rows = [("ac gt\t\r\nN",), ("",), (None,), ("ACGT\x85",), ("acg",)]
    df = dna.with_element(spark.createDataFrame(rows, "seq string"), into="e")
    assert [r.e for r in df.collect()] == [None, None, None, None, "ACG"]
    assert df.select(dna.clean(F.col("seq"))).first()[0] == "ACGTN"
    more = [("t g\ta\r",), (" \n",), ("ACGT",), ("a\x0bc",), ("tt",), ("aſc",), ("A\n",)]
    both = spark.createDataFrame(rows + more, "seq string").select("seq", F.lit(1).alias("__x"))
    kept = dna.elements(both)
    assert sorted((r.seq, r.element) for r in kept.collect()) == sorted((r.seq, r.element) for r in dna.with_element(both).where("element is not null").collect())
    assert {r.element for r in kept.collect()} == {"ACG", "TCA", "ACGT", "AA", "A"}
    assert one(spark, dna.reverse_complement(F.lit("ATGCYRKMBDHV")))[0] == "BDHVKMYRGCAT"


def test_ends_tell_the_smaller_strand(spark):
    rng = random.Random(8)
    words = ["".join(rng.choice("ACGT") for _ in range(rng.randrange(1, 9))) for _ in range(3000)] + ["A", "C", "G", "T"]
    df = spark.createDataFrame([(w,) for w in words], "w string").select("w", dna.element(F.col("w")).alias("e"))
    assert all(r.e == min(r.w, r.w.translate(str.maketrans("ACGT", "TGCA"))[::-1]) for r in df.collect())


def test_shred_whole_sequences(spark):
    rng = random.Random(5)
    long = "".join(rng.choice("ACGTN") for _ in range(3 * kmers.CHUNK + 17))
    df = spark.createDataFrame([(1, long), (2, "ACG"), (3, None), (4, ""), (5, "ACGT")], "id int, seq string")
    got = sorted((r.id, r.pos, r.kmer) for r in kmers.shred(df, "seq", 4, ["id"]).collect())
    assert got == [(1, i, long[i : i + 4]) for i in range(len(long) - 3)] + [(5, 0, "ACGT")]
    with pytest.raises(ValueError):
        kmers.shred(df, "seq", 0, ["id"])


def test_table_function_and_masks(spark):
    kmers.register(spark)
    assert spark.sql("SELECT * FROM kmers('ACGTA', 4)").collect() == [(0, "ACGT"), (1, "CGTA")]
    df = spark.createDataFrame([("ACGT",)], "k string")
    assert df.select(kmers.masked("k", "1011")).first()[0] == "A-GT"
    with pytest.raises(ValueError):
        kmers.masked("k", "10x1")
