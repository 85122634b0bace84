import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftloom.functions import hashing
from siftloom.operators import bloom, counting, hot, multiindex
from siftloom.operators.filters import BitFilter, CountingFilter, Shape
from siftloom.sources import fasta, filterfile
from siftloom.streaming.first_seen import SeenFilter, deduplicated


def md5_pair(x, i):
    d = hashlib.md5(x.encode()).hexdigest()
    return int(d[:15], 16) + i * (int(d[15:28], 16) | 1)


def keys(spark, values):
    return spark.createDataFrame([(v,) for v in values], "k string")


def test_no_false_negatives_and_positions(spark):
    members = [f"m{i}" for i in range(300)]
    bits = bloom.build(keys(spark, [*members, None, "m0"]), "k", 4001, 3)
    assert {r.pos for r in bits.collect()} == {md5_pair(x, i) % 4001 for x in members for i in range(3)}
    got = {r.k: r.hit for r in bloom.contains(keys(spark, members + ["x1", "x2"]), "k", bits, 4001, 3).collect()}
    assert all(got[m] for m in members)


def test_empty_filter_holds_nothing(spark):
    bits = bloom.build(keys(spark, []), "k", 64, 2)
    assert [r.hit for r in bloom.contains(keys(spark, ["a"]), "k", bits, 64, 2).collect()] == [False]
    assert bloom.packed(bits).count() == 0
    with pytest.raises(ValueError):
        bloom.build(keys(spark, ["a"]), "k", 0, 2)


def test_packing_and_merging(spark):
    a, b = keys(spark, [f"a{i}" for i in range(200)]), keys(spark, [f"b{i}" for i in range(200)])
    m = 100_000
    whole = bloom.build(a.union(b), "k", m, 3)
    parts = bloom.packed(bloom.build(a, "k", m, 3)).union(bloom.packed(bloom.build(b, "k", m, 3)))
    merged = bloom.union(parts)
    assert {r.pos for r in bloom.unpacked(merged).collect()} == {r.pos for r in whole.collect()}
    assert bloom.popcount(merged).first().pop == whole.count()
    byte = {r.bucket: r.bitmap for r in bloom.packed(spark.createDataFrame([(0,), (9,), (32767,), (32768,)], "pos bigint")).collect()}
    assert (byte[0][0], byte[0][1], byte[0][4095], byte[1][0]) == (1, 2, 128, 1)


def test_joins_bracket_the_exact_ones(spark):
    left = spark.createDataFrame([(i, str(i % 50)) for i in range(200)] + [(999, None)], "id int, k string")
    bits = bloom.build(keys(spark, [str(i) for i in range(10)]), "k", 64, 2)
    semi = {r.id for r in bloom.semi_join(left, "k", bits, 64, 2).collect()}
    anti = {r.id for r in bloom.semi_join(left, "k", bits, 64, 2, anti=True).collect()}
    exact = {i for i in range(200) if i % 50 < 10}
    assert exact <= semi and not anti & exact and semi | anti == set(range(200))


@pytest.mark.parametrize("preset", [False, True])
def test_insert_and_check_is_sequential(spark, preset):
    rng = random.Random(3)
    rows = [(i, str(rng.randrange(60))) for i in range(300)]
    rng.shuffle(rows)
    full = {md5_pair("old", i) % 97 for i in range(2)} | {1, 2, 3, 4, 5} if preset else set()
    old = spark.createDataFrame([(p,) for p in full], "pos bigint") if preset else None
    got = {r.o: r.present for r in bloom.insert_and_check(spark.createDataFrame(rows + rows[:9] + [(5000, None)], "o int, k string"), "k", ["o"], 97, 2, preset=old).collect()}
    want, bits = {}, set(full)
    for o, k in sorted(rows):
        at = {md5_pair(k, i) % 97 for i in range(2)}
        want[o] = at <= bits
        bits |= at
    assert got == want


def tallied(spark, rows, bits=4, m=40, h=3, threshold=3):
    df = spark.createDataFrame([("f", x) for x in rows], "filter_id string, e string")
    return counting.tally(df, "e", ["filter_id"]).withColumns({"m": F.lit(m), "h": F.lit(h), "bits": F.lit(bits), "threshold": F.lit(threshold)})


def test_counters(spark):
    rng = random.Random(4)
    rows = [f"e{min(rng.randrange(20), rng.randrange(20))}" for _ in range(300)]
    t = tallied(spark, rows + [None])
    args = ("e", ["filter_id"])
    counters = counting.increment_all(t, *args, F.col("m"), F.col("h"), F.col("bits"))
    want = np.zeros(40, int)
    for x in rows:
        for i in range(3):
            want[md5_pair(x, i) % 40] += 1
    assert {r.pos: r.cnt for r in counters.collect()} == {i: min(c, 15) for i, c in enumerate(want) if c}
    least = {r.e: r.min_count for r in counting.min_count(t, *args, counters, F.col("m"), F.col("h")).collect()}
    slow = counting.conservative(t, *args, F.col("m"), F.col("h"), F.col("bits"))
    tight = {r.e: r.min_count for r in counting.conservative_min_count(t, *args, slow, F.col("m"), F.col("h")).collect()}
    for x in set(rows):
        assert min(rows.count(x), 15) <= tight[x] <= least[x]


@pytest.mark.parametrize("n_blocks", [1, 4])
def test_conservative_is_sequential(spark, n_blocks):
    rng = random.Random(9)
    rows = [f"e{rng.randrange(25)}" for _ in range(200)]
    t = tallied(spark, rows)
    from siftloom.operators import blocks

    placed = {r.e: (r.block, r.slots) for r in blocks.placed(t, "e", F.col("m"), F.col("h"), n_blocks).collect()}
    assert all(s // (40 // n_blocks) == b for b, slots in placed.values() for s in slots) and {b for b, _ in placed.values()} == set(range(n_blocks))
    counters, present = {}, {}
    for x in sorted(rows):
        slots = placed[x][1]
        least = min(counters.get(s, 0) for s in slots)
        present[x] = present.get(x, 0) + (least >= 3)
        for s in set(slots):
            if counters.get(s, 0) == least and least < 15:
                counters[s] = least + 1
    args = ("e", ["filter_id"], F.col("m"), F.col("h"), F.col("bits"))
    got = {r.pos: r.cnt for r in counting.conservative(t, *args, n_blocks).collect()}
    assert got == counters
    checked = {r.e: r.n_present for r in counting.insert_and_check(t, *args, F.col("threshold"), n_blocks).collect()}
    assert checked == present


def test_order_matters_for_conservative_counters():
    def run(*elements):
        c = counting.Conservative()
        for slots in elements:
            c.step(slots, 1, 255)
        return dict(c.rows())

    assert run([0, 1], [1, 2], [2, 3]) == {0: 1, 1: 1, 2: 1, 3: 1}
    assert run([0, 1], [2, 3], [1, 2]) == {0: 1, 1: 2, 2: 2, 3: 1}


def test_threshold_zero_counts_all_slots(spark):
    t = tallied(spark, ["a"])
    counters = counting.increment_all(t, "e", ["filter_id"], F.col("m"), F.col("h"), F.col("bits"))
    heads = spark.createDataFrame([("f", 40, 3, 0), ("g", 8, 2, 1)], "filter_id string, m int, h int, threshold int")
    got = {r.filter_id: r for r in counting.stats(counters, heads, ["filter_id"]).collect()}
    assert got["f"].filtered_pop == 40 and got["f"].filtered_fpr == 1.0
    assert got["g"].pop == 0 and got["g"].fpr == 0.0


def frames(spark, n=400, seed=1):
    rng = random.Random(seed)
    return sorted((rng.randrange(40), i, f"w{rng.randrange(60)}", rng.randrange(1, 6)) for i in range(n))


def test_reservoir_is_sequential(spark):
    rows = [(s, p, w, s % 5 + 1) for s, p, w, _ in frames(spark)]
    df = spark.createDataFrame(rows, "seq bigint, pos int, elem string, id bigint")
    m, h = 101, 3
    got = {r.pos: (r.rank, r.id, r.obs) for r in multiindex.reservoir(df, m, h).collect()}
    ids, obs = {}, {}
    for seq in sorted({r[0] for r in rows}):
        values = sorted({(r[3], md5_pair(r[2], i)) for r in rows if r[0] == seq for i in range(h)})
        for id_, v in values:
            p = v % m
            obs[p] = obs.get(p, 0) + 1
            if (v ^ id_) % obs[p] == obs[p] - 1:
                ids[p] = id_
    order = sorted(ids)
    assert got == {p: (i, ids[p], obs[p]) for i, p in enumerate(order)}


def test_ranks_across_buckets(spark):
    pos = sorted(random.Random(2).sample(range(200_000), 3000))
    got = {r.pos: r.rank for r in multiindex.ranks(spark.createDataFrame([(p,) for p in pos], "pos bigint")).collect()}
    assert got == {p: i for i, p in enumerate(pos)}


def test_collisions_are_sequential(spark):
    rows = frames(spark)
    df = spark.createDataFrame(rows, "seq bigint, pos int, elem string, id bigint")
    got = {r.seq: (r.frames, r.full, r.bits_set) for r in multiindex.collisions(df, 61, 3).collect()}
    bits, want = set(), {}
    for s, _, w, _ in sorted(rows):
        n, full, hit = want.get(s, (0, 0, 0))
        before = set(bits)
        at = [md5_pair(w, i) % 61 for i in range(3)]
        for p in at:
            hit += p in bits
            bits.add(p)
        want[s] = (n + 1, full + (set(at) <= before), hit)
    assert got == want


def test_insert_fills_then_saturates():
    f = multiindex.Insert()
    assert f.put([1, 2], [7, 7], 1) and f.put([1, 2], [7, 7], 1)
    assert f.put([1, 2], [8, 8], 1)
    assert not f.put([1, 2], [9, 9], 1)
    assert f.rows() == [(1, 7, False, True), (2, 8, False, True)]
    assert not f.put([1, 2], [9, 9], 1)


def test_saturation_in_order():
    s = multiindex.Saturate()
    for rank, (pos, id_, obs) in enumerate([(1, 5, 2), (2, 5, 9), (3, 6, 1), (4, 7, 1)]):
        s.step(rank, [pos], id_, obs)
    s.step(None, [1, 2, 3], 8, None)
    s.step(None, [3, 4], 9, None)
    s.step(None, [2, 3], 5, None)  # its slot was taken over by the first
    assert s.rows() == [(1, 0, 5, 2, False), (2, 1, 8, 10, True), (3, 2, 6, 1, True), (4, 3, 7, 1, True)]


@pytest.mark.parametrize("n_blocks", [1, 3])
def test_the_index_is_sequential(spark, n_blocks):
    """Reservoir, then saturation, against a model that takes one frame after another."""
    rows = [(s, p, w, s % 5 + 1) for s, p, w, _ in frames(spark)]
    df = spark.createDataFrame(rows, "seq bigint, pos int, elem string, id bigint")
    m, h = 99, 3
    per = m // n_blocks
    hashes = {w: [md5_pair(w, i) for i in range(h)] for _, _, w, _ in rows}
    at = {w: [(v[0] >> 30) % n_blocks * per + x % per for x in v] for w, v in hashes.items()}
    ids, obs, full = {}, {}, set()
    for seq in sorted({r[0] for r in rows}):
        seen = {(r[3], v, p) for r in rows if r[0] == seq for v, p in zip(hashes[r[2]], at[r[2]])}
        for id_, v, p in sorted(seen):
            obs[p] = obs.get(p, 0) + 1
            if (v ^ id_) % obs[p] == obs[p] - 1:
                ids[p] = id_
    done = set()
    for _, _, w, id_ in sorted(rows):
        if (w, id_) in done:
            continue
        done.add((w, id_))
        held = [ids[p] for p in at[w]]
        if id_ in held:
            continue
        doubled = [p for p, x in zip(at[w], held) if held.count(x) > 1]
        if doubled:
            p = max(doubled, key=lambda x: obs[x])
            ids[p], obs[p] = id_, obs[p] + 1
        else:
            full |= set(at[w])
    got = {r.pos: (r.rank, r.id, r.obs, r.saturated) for r in multiindex.built(df, m, h, n_blocks).collect()}
    assert got == {p: (i, ids[p], obs[p], p in full) for i, p in enumerate(sorted(ids))}
    assert full and multiindex.built(df.limit(0), m, h, n_blocks).count() == 0


def test_builder_keeps_its_phases(spark):
    df = spark.createDataFrame(frames(spark), "seq bigint, pos int, elem string, id bigint")
    b = multiindex.IndexBuilder(60, 3, 0.3)
    for early in (b.empty, lambda: b.insert(df), b.saturate):
        with pytest.raises(RuntimeError):
            early()
    b.insert_bits(df.where("pos < 200"))
    b.insert_bits(df.where("pos >= 200"))
    empty = b.empty()
    for late in (b.empty, lambda: b.insert_bits(df), b.saturate):
        with pytest.raises(RuntimeError):
            late()
    b.insert(df.where("pos < 200"))
    b.insert(df.where("pos >= 200"))
    slots = b.saturate()
    assert sorted((r.pos, r.rank) for r in slots.collect()) == sorted((r.pos, r.rank) for r in empty.collect())
    assert sorted(slots.collect()) == sorted(multiindex.built(df, b.m, 3).collect())
    with pytest.raises(RuntimeError):
        b.saturate()


def test_spaced_seeds_see_past_their_gaps(spark):
    seeds = ("1101011", "1011101", "1110111")
    family = hashing.seeded(seeds)
    df = spark.createDataFrame([(1, 0, "ACGGTCA", 4), (2, 0, "TTTTGGC", 5)], "seq bigint, pos int, elem string, id bigint")
    slots = multiindex.saturated(multiindex.reservoir(df, 10_007, 3, family), df, 10_007, 3, family)
    asked = ["ACGGTCA", "TGACCGT", "ACTGTCA", "ACGTTCA", "CCCCCCC"]  # itself, its other strand, two changes, another
    found = {(r.elem, r.i): r.id for r in multiindex.lookup(spark.createDataFrame([(x,) for x in asked], "e string"), "e", slots, 10_007, 3, family).collect()}
    hits = {x: [found[x, i] for i in range(3)] for x in asked}
    assert hits["ACGGTCA"] == hits["TGACCGT"] == [4, 4, 4] and hits["CCCCCCC"] == [None] * 3
    assert hits["ACTGTCA"] == [4, None, None] and hits["ACGTTCA"] == [None, None, 4]
    b = multiindex.IndexBuilder(2, 3, 0.1, family)
    b.insert_bits(df)
    b.empty()
    b.insert(df)
    assert {r.id for r in b.saturate().collect()} == {4, 5}
    for bad in ((), ("101", "1"), ("10x",)):
        with pytest.raises(ValueError):
            hashing.seeded(bad)


def test_filters_keep_their_shape(spark, tmp_path):
    a, b = keys(spark, [f"a{i}" for i in range(300)]), keys(spark, [f"b{i}" for i in range(300)])
    shape = Shape.sized(600, 0.01)
    assert shape.h == 6 and shape.m % 64 == 0
    f, g = BitFilter.of(a, "k", shape), BitFilter.of(b, "k", shape)
    both = f.union(g)
    assert {r.hit for r in both.contains(a.union(b), "k").collect()} == {True}
    assert f.intersection(g).bits.count() < f.bits.count()
    for other in (Shape(shape.m + 64, shape.h), Shape(shape.m, shape.h, 31), Shape(shape.m, shape.h, family="xx64"), Shape(shape.m, 5)):
        with pytest.raises(ValueError):
            f.union(BitFilter.of(b, "k", other))
        with pytest.raises(ValueError):
            f.intersection(BitFilter.of(b, "k", other))
    f.store(str(tmp_path / "f"), 0.01)
    back = BitFilter.load(spark, str(tmp_path / "f"))
    assert back.shape == shape and {r.pos for r in back.bits.collect()} == {r.pos for r in f.bits.collect()}
    sized = BitFilter.sized(a, "k", 0.01)
    assert sized.entries == 300 and abs(sized.fpr().first().fpr - 0.01) < 0.01
    for bad in ((7, 1), (0, 1), (64, 0), (64, 1, 0, "none"), (64, 2, 3, "xx64", ("101",))):
        with pytest.raises(ValueError):
            Shape(*bad)
    with pytest.raises(ValueError):
        Shape.sized(10, 1.5)


def test_counting_filter_of_bytes(spark, tmp_path):
    rows = keys(spark, ["a"] * 3 + ["b", None])
    f = CountingFilter.of_bytes(rows, "k", 100_001, 5, 8, threshold=2)
    assert f.shape.m == 100_008
    assert {r.k: r.hit for r in f.contains(keys(spark, ["a", "b", "c"]), "k").collect()} == {"a": True, "b": False, "c": False}
    wide = CountingFilter.of_bytes(rows, "k", 100_001, 5, 8, bits=64)
    assert wide.shape.m == 100_008 // 8
    f.store(str(tmp_path / "c"))
    back = CountingFilter.load(spark, str(tmp_path / "c"), 2)
    assert back.shape == f.shape and sorted(back.counters.collect()) == sorted(f.counters.collect())
    with pytest.raises(ValueError):
        CountingFilter.of_bytes(rows, "k", 8, 1, bits=12)


def test_hot_keys_are_spread(spark):
    left = spark.createDataFrame([("hot", i) for i in range(300)] + [(f"k{i}", i) for i in range(50)], "k string, o int")
    right = spark.createDataFrame([("hot", 1), ("k3", 2), ("none", 3)], "k string, v int")
    heavy = hot.hot_keys(left.groupBy("k").agg(F.count(F.lit(1)).alias("n")), "k", "n")
    assert {r.hot for r in heavy.collect()} == {"hot"} and heavy.first().salts > 1
    got = sorted((r.k, r.o, r.v) for r in hot.joined(left, right, "k", ["o"], heavy).collect())
    assert got == sorted([("hot", i, 1) for i in range(300)] + [("k3", 3, 2)])
    kept = hot.joined(left, right, "k", ["o"], heavy, "left").collect()
    assert len(kept) == 350 and sum(r.v is None for r in kept) == 49


def test_pack(spark):
    rows = spark.createDataFrame([(5, True, False), (0, False, True), ((1 << 30) - 1, True, True)], "id bigint, strand boolean, sat boolean")
    raw = rows.withColumn("raw", multiindex.pack(F.col("id"), F.col("strand"), F.col("sat")))
    i, st, sa = multiindex.unpack(F.col("raw"))
    assert raw.where((i != F.col("id")) | (st != F.col("strand")) | (sa != F.col("sat"))).count() == 0


def test_bit_filter_file(spark, tmp_path):
    bits = bloom.build(keys(spark, [f"a{i}" for i in range(50)]), "k", 70_000, 3)
    path = str(tmp_path / "f")
    filterfile.write_bit_filter(path, bloom.packed(bits), 70_000, 3, 31, 0.01, 50, 50)
    head, packed = filterfile.read_bit_filter(spark, path)
    assert head == {"KmerSize": 31, "HashNum": 3, "BloomFilterSize": 70_000, "BloomFilterSizeInBytes": 8750, "dFPR": 0.01, "nEntry": 50, "Entry": 50}
    assert {r.pos for r in bloom.unpacked(packed).collect()} == {r.pos for r in bits.collect()}
    raw = str(tmp_path / "raw")
    filterfile.write_raw_filter(raw, bloom.packed(bits), 70_000)
    assert open(raw, "rb").read() == open(path, "rb").read()[-8750:]
    with pytest.raises(ValueError):
        filterfile.read_raw_filter(spark, raw, 64)
    with pytest.raises(ValueError):
        filterfile.write_bit_filter(path, bloom.packed(bits), 7, 3, 31)
    open(path, "ab").write(b"x")
    with pytest.raises(ValueError):
        filterfile.read_header(path)


@pytest.mark.parametrize("bits", [8, 64])
def test_counting_filter_file(spark, tmp_path, bits):
    counters = spark.createDataFrame([(0, 1), (511, 255), (512, 3), (9999, 7)], "pos bigint, cnt bigint")
    path = str(tmp_path / "c")
    filterfile.write_counting_filter(path, counters, 10_000, 5, 8, bits)
    head, back = filterfile.read_counting_filter(spark, path, bits)
    assert head["BloomFilterSizeInBytes"] == 10_000 * bits // 8
    assert sorted(back.collect()) == sorted(counters.collect())
    with pytest.raises(ValueError):
        filterfile.read_counting_filter(spark, path, 16)


def test_index_file(spark, tmp_path):
    values = spark.createDataFrame([(0, 7), (1, (1 << 31) + 3), (1500, 9)], "rank bigint, raw bigint")
    path = str(tmp_path / "i")
    filterfile.write_index_file(path, values, 1501, 2, 4, ["1101", "1011"])
    assert filterfile.read_index_header(path)["seeds"] == ["1101", "1011"]
    assert sorted(filterfile.read_index_values(spark, path).where("raw <> 0").collect()) == sorted(values.collect())


def test_index_from_its_files_alone(spark, tmp_path):
    slots = spark.createDataFrame([(5, 0, 7), (64, 1, (1 << 31) + 3), (99_999, 2, 9)], "pos bigint, rank bigint, raw bigint")
    path = str(tmp_path / "i")
    filterfile.write_index(path, slots, 100_000, 3, 31)
    head, back = filterfile.read_index(spark, path)
    assert head["m"] == 100_000 and sorted((r.pos, r.rank, r.raw) for r in back.collect()) == sorted(map(tuple, slots.collect()))


def test_fasta(spark, tmp_path):
    path = tmp_path / "x.fa"
    path.write_text(">a one\nacg\nTTn\r\n>a one\nGG\n>empty\n>b\n\nC C\n")
    got = sorted((r.name, r.header, r.seq) for r in fasta.read_fasta(spark, str(path)).collect())
    assert got == [("a", "a one", "ACGTTN"), ("a", "a one", "GG"), ("b", "b", "CC"), ("empty", "empty", "")]


def test_stream_restart_gives_the_same_answers(spark, tmp_path):
    seen = SeenFilter(str(tmp_path), 1 << 16, 3)
    one = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, None)], "o int, k string")
    two = spark.createDataFrame([(5, "b"), (6, "c")], "o int, k string")
    for _ in range(2):
        assert {r.o: r.present for r in seen.take(one, 0, "k", ["o"]).collect()} == {1: False, 2: False, 3: True}
        assert {r.o: r.present for r in seen.take(two, 1, "k", ["o"]).collect()} == {5: True, 6: False}


def test_stream_bits_are_compacted(spark, tmp_path):
    seen = SeenFilter(str(tmp_path / "bits"), 1 << 16, 3, every=2)
    answers = {}
    sink = seen.sink("k", ["o"], lambda out, n: answers.update({r.o: r.present for r in out.collect()}))
    batch = lambda n: spark.createDataFrame([(10 * n, f"k{n}"), (10 * n + 1, f"k{n // 2}")], "o int, k string")
    for n in (0, 1, 2, 4, 5, 6):  # batch 3 never comes
        sink(batch(n), n)
    left = {p.name for p in (tmp_path / "bits").iterdir()}
    assert "base=6" in left and "batch=0" not in left and len(left) <= 6
    before = dict(answers)
    sink(batch(6), 6)  # and again
    assert answers == before
    first = lambda n: n // 2 not in (0, 1, 2, 4, 5, 6)[: (0, 1, 2, 4, 5, 6).index(n) + 1]
    assert answers == {10 * n: False for n in (0, 1, 2, 4, 5, 6)} | {10 * n + 1: not first(n) for n in (0, 1, 2, 4, 5, 6)}


def test_exact_stream_form(spark, data):
    events = spark.readStream.schema(spark.read.parquet(f"{data}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")).schema).parquet(f"{data}/none*")
    assert deduplicated(events, "user_id", "ts", "1 hour").isStreaming
