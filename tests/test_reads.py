"""Reads against the index of their own k-mers: what they write, and their answers on odd texts in many chunks and groups."""

import hashlib
import os
import random

import pandas as pd
import pytest

import oracle
from siftloom.functions import hashing, packed
from siftloom.operators import reads
from siftloom.plans import multi
from siftloom.session import mounted_dir

QUERIES = ["mibf_classify", "mibf_all_counts", "mibf_count_dump", "mibf_match_signature", "mibf_classify_agreed", "mibf_classify_pair", "mibf_classify_seeded", "mibf_evaluation"]
OPPOSITE = str.maketrans("ACGT", "TGCA")


def letters(rng, n):
    return "".join(rng.choice("ACGT") for _ in range(n))


def written(spark):
    """Bytes by path of all shuffle files and intermediate tables."""
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    paths = [files.apply(i).getPath() for i in range(files.size())]
    paths += [os.path.join(at, f) for at, _, names in os.walk(mounted_dir(spark)) for f in names]
    return {p: os.path.getsize(p) for p in paths if os.path.exists(p)}


@pytest.mark.parametrize("query", QUERIES)
def test_kmers_are_not_written_as_rows(spark, tmp_path, query):
    rng = random.Random(1)
    seqs = [letters(rng, 2000) for _ in range(40)]
    pd.DataFrame({"seq_id": range(40), "id": [i % 5 for i in range(40)], "filter_id": "f", "seq": seqs}).to_parquet(tmp_path / "contig.parquet")
    pd.DataFrame({"id": range(5), "name": ["s"] * 5}).to_parquet(tmp_path / "mi_source.parquet")
    before = written(spark)
    getattr(multi, query)(spark, str(tmp_path)).write.format("noop").mode("overwrite").save()
    new = sum(n for p, n in written(spark).items() if p not in before)
    assert 0 < new / (40 * 1970) < (80 if query == "mibf_classify_seeded" else 40)


def test_count_dump_keeps_little_on_disk(spark, tmp_path, monkeypatch):
    """What it leaves when it ends, when the words of all its turns are gone: the chunks, and the answers as a table and shuffled."""
    monkeypatch.setattr(reads, "GROUP", 1 << 15)
    monkeypatch.setattr(reads, "TURN", 4, raising=False)
    rng = random.Random(2)
    seqs = [letters(rng, 20000) for _ in range(40)]
    pd.DataFrame({"seq_id": range(40), "id": [i % 5 for i in range(40)], "filter_id": "f", "seq": seqs}).to_parquet(tmp_path / "contig.parquet")
    pd.DataFrame({"id": range(5), "name": ["s"] * 5}).to_parquet(tmp_path / "mi_source.parquet")
    before = written(spark)
    multi.mibf_count_dump(spark, str(tmp_path)).write.format("noop").mode("overwrite").save()
    left = sum(n for p, n in written(spark).items() if p not in before)
    assert 0 < left / (40 * 19970) < 6


@pytest.fixture(scope="module")
def odd(tmp_path_factory):
    """Texts that share stretches across sources and within themselves, from either strand, with runs of N, blanks, small and other letters."""
    rng, d = random.Random(7), tmp_path_factory.mktemp("odd")
    shared = [letters(rng, 120) for _ in range(4)]
    rows = []
    for i in range(90):
        x = [letters(rng, rng.randrange(0, 150)), rng.choice(shared), letters(rng, rng.randrange(0, 40)), rng.choice(shared).translate(OPPOSITE)[::-1], "N" * rng.randrange(3), rng.choice(shared)[:60]]
        rng.shuffle(x)
        text = "".join(x)
        text = [text, text.lower(), text[:70] + "\n" + text[70:], text[:90] + "\u00e9\U0001f600" + text[90:], "A" * 80 + text][i % 5]
        rows.append((1000 - 7 * i, rng.choice([None, 0, 1, 2, 3, 4]), "f", text))
    rows += [(2000, 1, "f", None), (2001, 2, "f", ""), (2002, 3, "f", "ACGT"), (2003, 0, "f", "N" * 50), rows[0], rows[3]]
    pd.DataFrame(rows, columns=["seq_id", "id", "filter_id", "seq"]).astype({"id": "Int64"}).to_parquet(d / "contig.parquet")
    pd.DataFrame({"id": [1, 2, 2, 3], "name": ["a", "b", "c", None]}).to_parquet(d / "mi_source.parquet")
    return str(d)


@pytest.mark.parametrize("query", QUERIES)
@pytest.mark.parametrize("sizes", [(1, 500), (3000, 2000), (1 << 18, 1 << 19)])
def test_chunks_and_groups_change_nothing(spark, odd, monkeypatch, query, sizes):
    monkeypatch.setattr(reads, "LETTERS", sizes[0])
    monkeypatch.setattr(reads, "GROUP", sizes[1])
    oracle.compare(spark, odd, getattr(multi, query), multi.ORACLES[query])


@pytest.mark.parametrize("query", ["mibf_count_dump", "mibf_classify"])
def test_turns_change_nothing(spark, odd, monkeypatch, query):
    for name, x in (("LETTERS", 3000), ("GROUP", 2000), ("TURN", 3), ("FILE", 2)):
        monkeypatch.setattr(reads, name, x)
    oracle.compare(spark, odd, getattr(multi, query), multi.ORACLES[query])


@pytest.mark.parametrize("text", ["", "N", "ACGTN", "NNACGGT", "ACGT" * 9 + "N" * 5 + "TTT"])
def test_squeezed_texts(text):
    assert packed.spread(packed.squeezed(text.encode())).decode() == text
    assert packed.expanded(packed.compressed(text.encode(), b"", b"x"), 3) == [text.encode(), b"", b"x"]


@pytest.mark.parametrize("k", [1, 5, 11, 12, 31])
def test_least_is_the_same_from_either_strand(k):
    text = letters(random.Random(k), 300) + "N" + letters(random.Random(-k), 80)
    both = [packed.windows(x.encode(), k)[0] for x in (text, text.translate(OPPOSITE)[::-1])]
    one, other = (packed.least(x.encode(), at, k) for x, at in zip((text, text.translate(OPPOSITE)[::-1]), both))
    assert one.tolist() == other.tolist()[::-1]


@pytest.mark.parametrize("k", [1, 2, 8, 21, 31])
def test_windows_and_hashes(spark, k):
    rng = random.Random(k)
    text = "".join(rng.choice("ACGTACGTACGTN") for _ in range(900)) + letters(rng, 50)
    want = [(i, *sorted((text[i : i + k], text[i : i + k].translate(OPPOSITE)[::-1]))) for i in range(len(text) - k + 1) if "N" not in text[i : i + k]]
    start, word, back = packed.windows(text.encode(), k)
    spelled = lambda v: "".join("ACGT"[int(v) >> 2 * (k - 1 - j) & 3] for j in range(k))
    assert [(int(s), spelled(w), spelled(b)) for s, w, b in zip(start, word, back)] == want
    a, b = packed.md5_pair(word, k)
    digests = [hashlib.md5(x.encode()).hexdigest() for _, x, _ in want]
    assert [(int(x), int(y)) for x, y in zip(a, b)] == [(int(x[:15], 16), int(x[15:28], 16) | 1) for x in digests]
    seeds = ["1" * k, "10" * (k // 2) + "1" * (k % 2)]
    words = spark.createDataFrame([(x,) for _, x, _ in want], "elem string")
    rows = [r[0] for r in words.select(hashing.hashes(words.elem, 2, hashing.seeded(tuple(seeds)))).collect()]
    assert packed.seed_hashes(word, back, k, seeds).tolist() == rows
