import hashlib
import random

import pandas as pd
import pytest

from siftloom.operators import multiindex
from siftloom.plans import multi

OPPOSITE = str.maketrans("ACGT", "TGCA")


def words(n, seed=4):
    rng = random.Random(seed)
    return ["".join(rng.choice("ACGT") for _ in range(31)) for _ in range(n)]


def canonical(x):
    return min(x, x.translate(OPPOSITE)[::-1])


@pytest.mark.parametrize("n", [200, 2000])
@pytest.mark.parametrize("name", ["insert", "insert_strand", "built"])
def test_index_grows_with_its_elements(spark, tmp_path, monkeypatch, name, n):
    seqs = words(n)
    pd.DataFrame({"elem_id": range(n), "id": [1 + i % 5 for i in range(n)], "seq": seqs}).to_parquet(tmp_path / "mi_element.parquet")
    sizes = []
    real = getattr(multiindex, name)
    monkeypatch.setattr(multiindex, name, lambda frames, m, *a: sizes.append(m) or real(frames, m, *a))
    query = {"insert": multi.mibf_insert, "insert_strand": multi.mibf_insert_strand, "built": multi.mibf_saturation}[name]
    used = query(spark, str(tmp_path)).select("pos").distinct().count()
    assert 0.05 < used / sizes[0] <= 0.32


@pytest.mark.parametrize("letters", [500, 5000])
@pytest.mark.parametrize("query", [multi.mibf_classify, multi.mibf_classify_pair])
def test_read_index_grows_with_its_kmers(spark, tmp_path, monkeypatch, query, letters):
    seqs = ["".join(words(letters // 31, seed)) for seed in (1, 2)]
    pd.DataFrame({"seq_id": [1, 2], "id": [1, 2], "filter_id": "f", "seq": seqs}).to_parquet(tmp_path / "contig.parquet")
    sizes = []
    real = multiindex.frame_probabilities
    monkeypatch.setattr(multiindex, "frame_probabilities", lambda slots, m, *a: sizes.append(m) or real(slots, m, *a))
    assert {(x.read, x.id) for x in query(spark, str(tmp_path)).select("read", "id").collect()} == {(1, 1), (2, 2)}
    kmers = {canonical(s[i : i + 31]) for s in seqs for i in range(len(s) - 30)}
    bits = set()
    for x in kmers:
        d = hashlib.md5(x.encode()).hexdigest()
        bits |= {(int(d[:15], 16) + i * (int(d[15:28], 16) | 1)) % sizes[0] for i in range(multi.H)}
    assert 0.2 < len(bits) / sizes[0] <= 0.32
