import random

import pandas as pd

from siftloom.functions import hashing
from siftloom.plans import sequences

OPPOSITE = str.maketrans("ACGT", "TGCA")


def words(n, seed=4):
    rng = random.Random(seed)
    return ["".join(rng.choice("ACGT") for _ in range(31)) for _ in range(n)]


def canonical(x):
    return min(x, x.translate(OPPOSITE)[::-1])


def rol(x, r):
    r %= 64
    return (x << r | x >> (64 - r)) & hashing.MASK if r else x


def test_kmer_hash_ext_hashes_whole_elements(spark, tmp_path):
    start = "A" * 15
    seqs = [start + x[15:] for x in words(30)] + words(30)
    pd.DataFrame({"seq_id": range(60), "pos": 0, "seq": seqs, "filter_id": "f"}).to_parquet(tmp_path / "cbf_insert.parquet")
    seed = dict(zip("ACGT", hashing.SEEDS))
    want = set()
    for e in map(canonical, seqs):
        f = r = 0
        for j, c in enumerate(e):
            f, r = f ^ rol(seed[c], 30 - j), r ^ rol(seed[c.translate(OPPOSITE)], j)
        base = min(f, r)
        want.add((e, 0, base))
        for i in range(1, 4):
            v = base * (i ^ 31 * hashing.MULTIPLIER & hashing.MASK) & hashing.MASK
            want.add((e, i, v ^ v >> hashing.SHIFT))
    assert {(x.kmer, x.i, int(x.hash, 16)) for x in sequences.kmer_hash_ext(spark, str(tmp_path)).collect()} == want
