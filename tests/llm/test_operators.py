import base64
import collections
import math
import os
import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siftloom.llm import distinct, heavy, mixing, queries, repetition, seen, sets, spans, terms, tokens

# 1


def zipf(n, seed=1):
    rng = random.Random(seed)
    return [f"v{int(1 / (rng.random() + 1e-4))}" for _ in range(n)]


def test_sketch_never_underestimates():
    s, true = heavy.ConservativeSketch(64, 4), collections.Counter()
    rng = np.random.default_rng(0)
    for _ in range(30):
        h, n = np.unique(rng.integers(0, 500, 200), return_counts=True)
        true.update(dict(zip(h.tolist(), n.tolist())))
        est = s.add(h, n)
        assert (est >= [true[x] for x in h.tolist()]).all()
    keys = np.array(sorted(true))
    assert (s.estimate(keys) >= [true[x] for x in keys.tolist()]).all()


def test_heap_is_bounded_and_keeps_the_largest():
    heap = heavy.BoundedHeap(5)
    for i in range(0, 100, 10):
        heap.offer(np.arange(i, i + 10), np.arange(i, i + 10))
    heap.offer(np.array([99]), np.array([200]))
    assert len(heap.hashes) == 5 and sorted(zip(heap.estimates.tolist(), heap.hashes.tolist()))[-1] == (200, 99)


def test_heavy_hitters(spark):
    values = zipf(5000) + ["", ""] * 100 + [None] * 50
    df = spark.createDataFrame([(v, 1, "x") for v in values], "value string, h int, n string")
    true = collections.Counter(v for v in values if v is not None)
    n = sum(true.values())
    got = {r.value: r for r in heavy.heavy_hitters(df, "value", 0.02).collect()}
    assert {k: r["count"] for k, r in got.items()} == {k: c for k, c in true.items() if c >= 0.02 * n}
    assert all(r.estimate >= r["count"] and r.total == n for r in got.values())


def test_heavy_hitters_on_ties_and_nothing(spark):
    ties = spark.createDataFrame([(str(i % 4),) for i in range(400)], "value string")
    assert heavy.heavy_hitters(ties, "value", 0.25).count() == 4
    none = spark.createDataFrame([], "value string")
    assert heavy.heavy_hitters(none, "value", 0.1).count() == 0
    assert heavy.heavy_hitters(spark.createDataFrame([(None,)], "value string"), "value", 0.1).count() == 0


# 2


def test_chain_bound_and_rate():
    chain = seen.BloomChain(0.01, None, first=64)
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 2**63, 20_000, dtype=np.uint64), rng.integers(0, 2**63, 20_000, dtype=np.uint64)
    wrong = sum(int(chain.offer(a[i : i + 500], b[i : i + 500]).sum()) for i in range(0, 20_000, 500))
    assert chain.has(a, b).all()
    assert len(chain.layers) > 5 and [x.error for x in chain.layers] == sorted((x.error for x in chain.layers), reverse=True)
    assert chain.bound <= 0.01 and wrong / 20_000 <= 0.01 + 3 * math.sqrt(0.01 / 20_000)


@pytest.mark.parametrize("error,hashes", [(1e-4, 4), (0.01, 2), (0.05, 1), (0.001, 13)])
def test_chain_keeps_the_headers_hashes(error, hashes):
    chain = seen.BloomChain(error, hashes)
    rng = np.random.default_rng(3)
    wrong = 0
    for _ in range(10):
        a, b = rng.integers(0, 2**63, 400, dtype=np.uint64), rng.integers(0, 2**63, 400, dtype=np.uint64)
        wrong += int(chain.offer(a, b).sum())
    assert len(chain.layers) >= 8 and {x.k for x in chain.layers} == {hashes}
    assert chain.bound <= error and wrong / 4000 <= error + 4 * math.sqrt(error / 4000)


def brute_seen(rows):
    first, cases = {}, set()
    for rid, grp, at, key in sorted({r for r in rows if r[3]}, key=lambda r: (r[2] is None, r[2] or 0, r[0])):
        if first.setdefault((grp, key), rid) != rid:
            cases.add(rid)
    return cases


def test_seen(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice(["f", "g", None]), rng.choice([None, *range(50)]), rng.choice(["hot", None, "", *[f"k{j}" for j in range(300)], *["hot"] * 100])) for i in range(1500)]
    rows += rows[:200]
    df = spark.createDataFrame(rows, "rid bigint, grp string, sec bigint, key string").withColumn("at", F.timestamp_seconds("sec")).withColumns({"a": F.lit("clash"), "settled": F.lit(1)})
    heads = spark.createDataFrame([("f", None, 0), ("g", 7.0, 2), ("g", 0.05, None)], "group string, error double, hashes int")
    answered = seen.answers(df, F.col("key"), "grp", "at", "rid", heads)
    assert {r.id for r in answered.collect()} == {r[0] for r in rows if r[3]}
    assert {r.id for r in seen.verified(answered).collect()} == brute_seen(rows)
    said = {r.id for r in answered.where("seen").collect()}
    assert brute_seen(rows) <= said
    nothing = seen.answers(df.limit(0), F.col("key"), "grp", "at", "rid")
    assert nothing.count() == 0 and seen.verified(nothing).count() == 0


class Forgetful(seen.BloomChain):
    def has(self, a, b):
        return np.zeros(len(a), bool)


def test_copies_are_put_to_the_chain():
    keys = np.array([1, 2, 1, 1], dtype=np.uint64)
    assert not Forgetful().offer(keys, keys).any()
    assert seen.BloomChain().offer(keys, keys).tolist() == [False, False, True, True]


def test_every_repeated_key_is_answered_by_the_chain(spark):
    rows = [(i, i, f"k{i % 500}") for i in range(1000)] + [(1000 + i, 1000 + i, "hot") for i in range(1000)]
    df = spark.createDataFrame(rows, "rid bigint, sec bigint, key string").withColumns({"at": F.timestamp_seconds("sec"), "g": F.lit("f")}).coalesce(1)
    got = seen.answers(df, F.col("key"), "g", "at", "rid").collect()
    # Only the chain states a bound.
    assert {r.id for r in got if r.seen and r.bound > 0} == {*range(500, 1000), 1001}
    assert {r.id for r in got if r.seen} == {*range(500, 1000), *range(1001, 2000)}


def test_very_long_keys(spark):
    df = spark.createDataFrame([(1, "f", "A" * 2_000_000), (2, "f", "A" * 2_000_000), (3, "f", "A" * 1_999_999)], "rid bigint, g string, key string").withColumn("at", F.timestamp_seconds(F.col("rid")))
    assert [r.id for r in seen.verified(seen.answers(df, F.col("key"), "g", "at", "rid")).collect()] == [2]


# 3


def trie_counts(trie):
    return {t[:-1]: (o, r) for c in trie.leaves() for t, o, r in zip(c.terms.tolist(), c.occ.tolist(), c.recs.tolist())}


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.binary(max_size=5), max_size=30), max_size=12), st.integers(1, 6))
def test_trie_counts_and_merges(records, limit):
    whole, parts = terms.BurstTrie(limit), [terms.BurstTrie(limit), terms.BurstTrie(limit)]
    occ, rec = collections.Counter(), collections.Counter()
    for i, words in enumerate(records):
        if words:
            keys = terms._keys(words, {})
            whole.add(keys, np.full(len(words), i))
            parts[i % 2].add(keys, np.full(len(words), i))
        occ.update(words)
        rec.update(set(words))
    want = {w: (occ[w], rec[w]) for w in occ}
    assert trie_counts(whole) == want
    parts[0].merge(parts[1])
    assert trie_counts(parts[0]) == want


def test_trie_bursts():
    trie = terms.BurstTrie(8)
    words = [f"{i:05d}".encode() for i in range(2000)]
    trie.add(terms._keys(words, {}), np.arange(2000))
    trie.add(terms._keys(words, {}), np.arange(2000))
    assert isinstance(trie.root, dict) and len(trie_counts(trie)) == 2000
    assert all(len(c.terms) <= 64 for c in trie.leaves())


def test_tries_of_entries_merge():
    rng = random.Random(5)
    want, tries = collections.Counter(), []
    for _ in range(5):
        part = {f"{rng.randrange(900)}x".encode(): rng.randrange(1, 9) for _ in range(400)}
        want.update(part)
        keys = np.sort(terms._keys([*part], {}))
        n = np.array([part[k[:-1]] for k in keys.tolist()])
        tries.append(terms.BurstTrie.of(keys, n, n, 16))
    for t in tries[1:]:
        tries[0].merge(t)
    assert trie_counts(tries[0]) == {k: (n, n) for k, n in want.items()}


def test_columns_are_packed():
    words = [b"", b"\x00a", "日本".encode(), b"x" * 500]
    numbers, back = terms._opened(terms._packed([np.array([5, -1, 2**62, 0])], pa.array(words, pa.binary())))
    assert back.to_pylist() == words and numbers[0].tolist() == [5, -1, 2**62, 0]
    numbers, back = terms._opened(terms._packed([np.empty(0, np.int64)], pa.array([], pa.binary())))
    assert len(back) == 0 and len(numbers[0]) == 0


@pytest.mark.parametrize("chunk,full,short", [(1 << 18, 1 << 21, 4), (97, 50, 1)])
def test_term_counts(spark, chunk, full, short):
    rng = random.Random(4)
    long = "z" * 500_000
    pool = ["hot"] * 60 + [f"hot{i}" for i in range(40)] + ["", "a", "é", "日本", long, None]
    rows = [(rng.choice(["g", "h", None]), rng.randrange(200), i, rng.choice(pool)) for i in range(4000)] + [("g", None, 1, "a"), ("g", 1, None, "a"), ("g", 1, None, "a")]
    rows += rows[:500]
    df = spark.createDataFrame(rows, "grp string, record bigint, pos int, term string").withColumns({"route": F.lit(1), "hot": F.lit("x")})
    occ, rec = collections.Counter(), collections.defaultdict(set)
    once = set()
    for g, r, p, t in rows:
        if t is None or r is None or p is not None and (g, r, p, t) in once:
            continue
        once.add((g, r, p, t))
        occ[g, t] += 1
        rec[g, t].add(r)
    counts, totals = terms.counted(df, "term", "record", "grp", "pos", chunk, full, short)
    found = counts.collect()
    assert len(found) == len(occ) and {(x.grp, x.term): (x.occurrences, x.records) for x in found} == {k: (occ[k], len(rec[k])) for k in occ}
    assert {x.grp: x.records for x in totals.collect()} == {g: len(set().union(*(v for (h, _), v in rec.items() if h == g))) for g in ("g", "h", None)}
    assert terms.term_counts(df.limit(0), "term", "record", "grp", "pos").count() == 0


# 4


def brute_spans(rows, length):
    plain = lambda w: set(w) <= set("ACGT")
    owners = collections.defaultdict(set)
    rows = {r for r in rows if r[1] and r[2]}
    for _, src, t in rows:
        for i in range(len(t) - length + 1):
            if plain(t[i : i + length]):
                owners[t[i : i + length]].add(src)
    out = set()
    for rid, _, t in rows:
        hit = [False] * len(t)
        for i in range(len(t) - length + 1):
            if len(owners.get(t[i : i + length], ())) > 1:
                hit[i : i + length] = [True] * length
        i = 0
        while i < len(t):
            j = i
            while j < len(t) and hit[j]:
                j += 1
            if j > i:
                out.add((rid, i + 1, j))
            i = j + 1
    return out


def mixed_records(seed, n=40, length=20):
    rng = random.Random(seed)
    text = lambda k: "".join(rng.choice("ACGT") for _ in range(k))
    parts = [text(rng.randrange(length - 3, 4 * length)) for _ in range(6)] + ["A" * 90, "N" * 5, "ACACAC" * 9]
    rows = [(i, rng.choice([0, None, 1, 2, 3]), "".join(rng.choice([text(7), rng.choice(parts)]) for _ in range(rng.randrange(1, 6)))) for i in range(n)]
    return rows + rows[:5] + [(100, 1, None), (101, 2, ""), (102, 3, "ACGT")]


@pytest.mark.parametrize("seed,most", [(1, 200_000), (2, 200_000), (3, 60), (4, 0), (5, 30)])
def test_spans(spark, seed, most):
    rows = mixed_records(seed)
    df = spark.createDataFrame(rows, "rid bigint, src bigint, t string").withColumns({"anchor": F.lit(1), "lo": F.lit("x")})
    got = spans.shared_spans(df, "rid", "src", F.col("t"), 20, most)
    assert {tuple(r) for r in got.collect()} == brute_spans(rows, 20)
    part = {r.record: r for r in spans.shared_part(df, "rid", "src", F.col("t"), got).collect()}
    assert part[100].size == 0 and part[100].part == 0.0 and part[102].shared == 0
    for r in part.values():
        assert r.shared == sum(e - s + 1 for i, s, e in brute_spans(rows, 20) if i == r.record)


def test_spans_of_nothing_and_of_long_texts(spark):
    schema = "rid bigint, src bigint, t string"
    assert spans.shared_spans(spark.createDataFrame([], schema), "rid", "src", F.col("t")).count() == 0
    rng = random.Random(6)
    long = "".join(rng.choice("ACGT") for _ in range(60_000))
    df = spark.createDataFrame([(1, 1, long), (2, 2, "C" + long + "C")], schema)
    assert sorted(tuple(r) for r in spans.shared_spans(df, "rid", "src", F.col("t")).collect()) == [(1, 1, 60_000), (2, 2, 60_001)]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.tuples(st.text("AC", min_size=1, max_size=14), st.integers(1, 3)), min_size=1, max_size=6), min_size=1, max_size=3))
def test_automaton_statistics(shards):
    sam = spans.SuffixAutomaton()
    want = []
    for texts in shards:
        sam.shard()
        for t, s in texts:
            sam.add([ord(c) for c in t], s, s)
            want += [max([k for k in range(e + 1) if len({s for u, s in texts if t[e - k : e] in u}) > 1], default=0) for e in range(1, len(t) + 1)]
    assert sam.statistics().tolist() == want


def test_stretches_and_their_hashes():
    rng = random.Random(11)
    part = "".join(rng.choice("ACGT") for _ in range(300))
    texts = [part.encode(), ("NN" + part + "N").encode(), b"", (part[:100] + "T" + part[101:]).encode(), ("A" * 120).encode()]
    for word in (16, 24, 36, 50):
        c = spans._Cut(texts, 50, word)
        letters = [texts[t][a : a + n] for t, a, n in zip(c.text, c.at, c.size)]
        assert len({(a, h) for a, h in zip(c.anchor.tolist(), c.hash.tolist())}) == len({(a, x) for a, x in zip(c.anchor.tolist(), letters)})
        by = collections.defaultdict(set)
        for h, x in zip(c.hash.tolist(), letters):
            by[h].add(x)
        assert all(len(x) == 1 for x in by.values())
        packed = c.letters(np.arange(len(c.start))).to_pylist()
        assert [bytes(b"ACGT"[y] for y in spans._unpacked(d, n)) for d, n in zip(packed, c.size)] == letters
        # Every plain window lies in one stretch of its text.
        windows = collections.Counter((t, a + i) for t, a, n in zip(c.text, c.at, c.size) for i in range(n - 49))
        assert windows == {(t, i): 1 for t, x in enumerate(texts) for i in range(len(x) - 49) if b"N" not in x[i : i + 50]}


# 5


def brute_pairs(members):
    own = collections.defaultdict(set)
    for item, s in members:
        own[s].add(item)
    return {(a, b): (len(own[a] & own[b]), len(own[a]), len(own[b]), len(own[a] | own[b])) for a in own for b in own if a < b and own[a] & own[b]}


def test_overlaps_follow_joins_and_leaves(spark):
    rng = random.Random(7)
    state, moved, members = sets.empty_state(spark), None, set()
    for load in range(3):
        rows = [(rng.choice(["x", None, *[f"i{j}" for j in range(40)]]), rng.choice([None, 1, 2, 3, 4, 5]), rng.choice([1, 1, 1, -1]), i) for i in range(250)]
        rows += rows[:20]
        batch = spark.createDataFrame(rows, "item string, s bigint, sign int, n int").withColumns({"sets": F.lit(1), "old": F.lit(2)})
        applied = sets.apply(state, sets.changes(batch, "item", "s", "sign", "n"))
        d = sets.deltas(applied)
        moved = d if moved is None else moved.unionByName(d)
        state = sets.new_state(applied)
        last = {}
        for item, s, sign, n in rows:
            if item is not None and s is not None and n >= last.get((item, s), (-1, 0))[0]:
                last[item, s] = (n, sign)
        members |= {k for k, v in last.items() if v[1] == 1}
        members -= {k for k, v in last.items() if v[1] == -1}
        got = {(r.id_a, r.id_b): (r.shared, r.size_a, r.size_b, r.either) for r in sets.overlaps(moved).collect()}
        assert got == brute_pairs(members)
    many = spark.createDataFrame([("x", i) for i in range(300)] + [("y", 7), ("y", 8)], "item string, s bigint")
    big = {(r.a, r.b): r.delta for r in sets.deltas(sets.apply(sets.empty_state(spark), sets.changes(many, "item", "s"))).collect()}
    assert big == {(a, b): 2 if {a, b} <= {7, 8} else 1 for a in range(300) for b in range(a, 300)}
    idle = sets.apply(state, sets.changes(batch.limit(0), "item", "s"))
    assert sets.deltas(idle).count() == 0


# 6


@pytest.mark.parametrize("error", [0.005, 0.02])
def test_sizes_meet_the_target(error):
    for bound in (0, 1, 50, 1000, 40_000, 1_000_000, 10**9):
        m = distinct.bits_for(bound, error)
        assert m & (m - 1) == 0
        assert all(distinct.relative_error(n, m) <= error for n in {1, max(1, bound // 100), max(1, bound // 2), max(1, bound)})
        assert m == distinct.bits_for(0, error) or bound / (m / 2) > distinct.MOST_FULL or distinct.relative_error(bound, m // 2) > error
    assert distinct.bits_for(10**7, error) < 10**7


def test_cells_bound_their_groups(spark):
    rows = [(f"f{i % 7}", i % 3) for i in range(60_000)] + [("f0", None), (None, 1)]
    df = spark.createDataFrame(rows, "f string, id bigint")
    whole, part = distinct.sized(df, "f", "id", 0.02)
    got = df.select("f", "id", whole.alias("w"), part.alias("p")).distinct().collect()
    for r in got:
        if r.f is not None:
            assert r.w >= distinct.bits_for(sum(x[0] == r.f for x in rows), 0.02)
            assert r.p is None if r.id is None else r.p >= distinct.bits_for(rows.count((r.f, r.id)), 0.02)
    whole, part = distinct.sized(df.limit(0), "f", "id", 0.02)
    assert df.select(whole.alias("w")).where("f is not null").agg(F.max("w")).first()[0] == distinct.bits_for(1, 0.02)


def test_partial_results_are_small(spark):
    """A tenth of the rows of a group of a million identifiers, in each task, before anything is shuffled."""
    m = distinct.bits_for(1_000_000, 0.005)
    rows = spark.range(0, 1_000_000, 1, 4).select(F.lit(1).alias("g"), F.col("id").cast("string").alias("k"), F.lit(m).cast("bigint").alias("m"))
    task = rows.withColumn("task", F.spark_partition_id())
    assert distinct.words(task, ["g", "task"], "k", "m").count() <= 100_000
    r = distinct.estimates(distinct.words(rows, ["g"], "k", "m"), ["g"], "m").first()
    assert abs(r.estimate - 1_000_000) < 20_000 and r.low <= 1_000_000 <= r.high


def test_snapshots_of_any_period(spark, tmp_path):
    """Days, part days, unknown filters, sources and nulls against exact counts."""
    import datetime as dt

    import pandas as pd

    rng = random.Random(5)
    t0 = dt.datetime(2024, 3, 1)
    letters = lambda: "".join(rng.choice("ACGT") for _ in range(31))
    pool = [letters() for _ in range(400)]
    rows = [(i, rng.choice([None, 0, 1, 2]), rng.choice(["f", "g", None]), rng.choice([*pool, None, "acgn", ""]), t0 + dt.timedelta(minutes=rng.randrange(0, 14 * 1440)) if rng.random() < 0.95 else None) for i in range(6000)]
    pd.DataFrame(rows, columns=["elem_id", "id", "filter_id", "seq", "inserted_at"]).astype({"id": "Int64"}).to_parquet(tmp_path / "mi_element.parquet", coerce_timestamps="us")
    base = {}
    snaps = []
    for n, (f, s, day, hours, days) in enumerate([("f", None, 0, 0, 14), ("f", 1, 0, 0, 14), ("g", 2, 3, 0, 7), ("g", None, 5, 7, 1), ("f", 2, 2, 13, 2), ("x", None, 0, 0, 7), ("x", 5, 0, 0, 1), (None, None, 0, 0, 1), ("f", 9, 0, 0, 14), ("g", None, 20, 0, 1)]):
        start = t0 + dt.timedelta(days=day, hours=hours)
        canon = lambda x: min(x, x.translate(str.maketrans("ACGT", "TGCA"))[::-1])
        base[n] = len({canon(q) for _, i, g, q, at in rows if q and set(q) <= set("ACGT") and g == f and f and at and start <= at < start + dt.timedelta(days=days) and s in (None, i)})
        for claim in (0, base[n], int(base[n] * 1.1), int(base[n] * 1.1) + 1, None):
            snaps.append((len(snaps), f, s, start, days, claim, 10**6, n))
    frame = pd.DataFrame(snaps + snaps[:3], columns=["snapshot_id", "filter_id", "id", "period_start", "period_days", "nEntry", "Entry", "n"]).astype({"id": "Int64", "nEntry": "Int64"})
    frame.drop(columns="n").to_parquet(tmp_path / "filter_snapshot.parquet", coerce_timestamps="us")
    found = {r.snapshot_id for r in queries.p6_found(spark, str(tmp_path)).collect()}
    assert found == {i for i, _, _, _, _, claim, _, n in snaps if claim is not None and abs(claim - base[n]) * 10 > base[n]}
    for r in queries.p6_estimates(spark, str(tmp_path)).collect():
        n = snaps[r.snapshot_id][7]
        if r.whole_days:
            assert r.low - 0.001 <= base[n] <= r.high + 0.001
        assert r.whole_days == (n not in (3, 4))


def test_estimates_and_unions(spark):
    rows = [(g, f"k{i}") for g, lo, hi in (("a", 0, 3000), ("b", 2000, 6000), ("c", 0, 3)) for i in range(lo, hi)] * 2 + [("a", None), ("d", None)]
    df = spark.createDataFrame(rows, "g string, k string").withColumns({"m": F.lit(distinct.bits_for(8000, 0.01)).cast("bigint"), "word": F.lit(1), "at": F.lit(2)})
    per = distinct.words(df, ["g"], "k", "m")
    got = {r.g: r for r in distinct.estimates(per, ["g"], "m").collect()}
    for g, n in (("a", 3000), ("b", 4000), ("c", 3)):
        assert got[g].low <= n <= got[g].high and abs(got[g].estimate - n) <= max(2, 0.05 * n)
    assert "d" not in got
    both = distinct.estimates(distinct.union(per.where("g in ('a', 'b')").withColumn("all", F.lit(1)), ["all"], "m"), ["all"], "m").first()
    assert both.low <= 6000 <= both.high
    assert distinct.estimates(distinct.words(df.limit(0), ["g"], "k", "m"), ["g"], "m").count() == 0


def test_full_bitmaps_have_no_estimate(spark):
    df = spark.range(5000).select(F.lit(1).alias("g"), F.col("id").cast("string").alias("k"), F.lit(64).cast("bigint").alias("m"))
    r = distinct.estimates(distinct.words(df, ["g"], "k", "m"), ["g"], "m").first()
    assert r.ones == 64 and r.estimate is None and r.high is None and r.low == 64


# 7

vocabulary = pytest.mark.skipif(not os.path.exists(tokens.VOCABULARY), reason="no vocabulary here")


@pytest.fixture(scope="module")
def reference():
    import tiktoken

    with open(tokens.VOCABULARY, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), ranks


@pytest.fixture(scope="module")
def encoder():
    return tokens.Encoder(tokens.Vocabulary())


HARD = [
    "", " ", "  ", "\n", "'s", "don't we'll'll 'x ''s 'S", "a\n\n  b \t c\n", "=\x1c\x1d x\x00", "日本語のテキスト、です。", "x" * 3000, "=" * 5000 + "ab" * 2000, "'", "x'", "'re'v've", "'l l", " 's", "\n's",
    "\xa0's ٣٤ ½ é é", "<|endoftext|>", "\x1b[31mred\x1b[0m", "🙂🙂 ok", "　　a", "a \r\n\r\n b", "  x", "0123456789" * 50, "'s's't", "tail '", "end 'l",
]


@vocabulary
def test_encoding_is_the_published_one(reference, encoder):
    ids, count = tokens.encode_texts(encoder, [x.encode() for x in HARD])
    at = np.append(0, np.cumsum(count))
    tokens_back = {v: k for k, v in reference[1].items()}
    for i, x in enumerate(HARD):
        got = ids[at[i] : at[i + 1]].tolist()
        assert got == reference[0].encode_ordinary(x), x
        assert tokens.decode(got, tokens_back) == x


@vocabulary
@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.one_of(st.sampled_from(" '\nsrevl\ta9é=.-日"), st.characters(codec="utf-8", max_codepoint=0x2FFF)), max_size=40), min_size=1, max_size=5))
def test_encoding_of_any_texts(texts):
    global _held
    if "_held" not in globals():
        import tiktoken

        with open(tokens.VOCABULARY, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
        _held = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), tokens.Encoder(tokens.Vocabulary())
    import unicodedata

    texts = [x for x in texts if all(unicodedata.category(c) != "Cn" for c in x)]
    ids, count = tokens.encode_texts(_held[1], [x.encode() for x in texts])
    at = np.append(0, np.cumsum(count))
    for i, x in enumerate(texts):
        assert ids[at[i] : at[i + 1]].tolist() == _held[0].encode_ordinary(x)


@vocabulary
def test_pieces_change_nothing(monkeypatch, reference, encoder):
    text = "\n".join(f"line {i}'s  end \n\n  next" for i in range(400)) + "x" * 900
    monkeypatch.setattr(tokens, "PIECE", 300)
    ids, count = tokens.encode_texts(encoder, [b"", text.encode(), b"tail"])
    want = reference[0].encode_ordinary(text)
    assert count.tolist() == [0, len(want), len(reference[0].encode_ordinary("tail"))]
    assert ids[: len(want)].tolist() == want


@vocabulary
def test_words_are_forgotten_beyond_the_bound(monkeypatch, reference, encoder):
    monkeypatch.setattr(tokens, "KNOWN", 20)
    for i in range(5):
        text = " ".join(f"qz{i}x{j}" for j in range(15))
        assert tokens.encode_texts(encoder, [text.encode()])[0].tolist() == reference[0].encode_ordinary(text)
    assert len(encoder.known) <= 20 + len(encoder.tokens) + 100


@vocabulary
def test_ids_of_documents(spark, reference):
    rows = [(1, "hello  world"), (2, None), (3, ""), (1, "hello  world"), (None, "x"), (5, "long words " * 100_000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({"ids": F.lit("clash"), "n_tokens": F.lit(0)})
    got = sorted(((r.doc_id, r.ids) for r in tokens.token_ids(df).collect()), key=repr)
    assert got == sorted(((d, reference[0].encode_ordinary(t) if t else []) for d, t in rows), key=repr)
    assert tokens.token_ids(df.limit(0)).count() == 0
    back = sorted(((r.doc_id, r.text) for r in tokens.decoded(tokens.token_ids(df)).collect()), key=repr)
    assert back == sorted(((d, t or "") for d, t in rows), key=repr)


@vocabulary
def test_decoding_hard_texts(spark):
    df = spark.createDataFrame([*enumerate(HARD)], "doc_id bigint, text string")
    assert {r.doc_id: r.text for r in tokens.decoded(tokens.token_ids(df)).collect()} == dict(enumerate(HARD))
    assert tokens.decoded(spark.createDataFrame([(1, None), (2, [])], "doc_id bigint, ids array<int>")).collect() == [(1, ""), (2, "")]


# 8


def test_permutations_are_whole():
    rng = np.random.default_rng(3)
    for n in (1, 2, 3, 12, 97, 1000):
        mul, add = mixing._coprime(n, rng)
        assert sorted((mul * i + add) % n for i in range(n)) == list(range(n))


@vocabulary
def test_mixing(spark):
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choice(["alpha", "beta", "gamma"]) for _ in range(rng.randrange(1, 200))), rng.choice(["Big", "big ", "BIG", "big", "mid", "small", None, "other"])) for i in range(900)]
    rows += [(9001, None, "big"), (9002, "", "small"), (1, "alpha", "mid"), (1, "alpha", "mid")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").withColumns({"size": F.lit(1), "row": F.lit(2), "block": F.lit("x")})
    goal = spark.createDataFrame([("big", 0.4, 1), ("mid", 0.3, 2), (" SMALL", 0.2, 3), ("absent", 0.1, 1), (None, 0.5, 1), ("none", None, 1)], "source string, target_share double, max_repeats int")
    chosen = mixing.selection(docs, goal, block=16).cache()
    report = {r.source: r for r in mixing.shares(chosen, goal).collect()}
    for s, want in (("big", 4 / 9), ("mid", 3 / 9), ("small", 2 / 9)):
        assert abs(report[s].share - want) < 0.05 and 1 <= report[s].repeats <= report[s].max_repeats
    assert report["absent"].tokens == 0
    # No token of a record more often than its source may repeat.
    caps = {"big": 1, "mid": 2, "small": 3}
    used = collections.Counter((r.source, r.block, r.doc_id, r.first_token) for r in chosen.select("shard", "source", "pass", "block", "doc_id", "first_token").distinct().collect())
    assert all(n <= caps[k[0]] for k, n in used.items())
    assert sorted(chosen.collect()) == sorted(mixing.selection(docs, goal, block=16).collect())
    assert mixing.selection(docs.limit(0), goal).count() == 0
    assert mixing.selection(docs, goal.limit(0)).count() == 0


@vocabulary
def test_mixing_stops_at_the_caps(spark):
    docs = spark.createDataFrame([(1, "one two three four " * 20, "a"), (2, "five six " * 20, "b")], "doc_id bigint, text string, source string")
    goal = spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, None)], "source string, target_share double, max_repeats int")
    report = {r.source: r for r in mixing.report(docs, goal, block=8, total=8000).collect()}
    assert report["a"].repeats == 1 and report["b"].repeats > 5 and report["a"].share < 0.1
    assert report["a"].unfilled > 300 and report["b"].unfilled == 0 and report["a"].drawn + report["b"].drawn == 1000
    assert report["a"].scaled_share == 0.5 and abs(report["a"].deviation - 0.5 / math.sqrt(1000)) < 1e-9


@vocabulary
@pytest.mark.parametrize("none", [0, -1])
def test_a_cap_of_nothing_leaves_the_others(spark, none):
    docs = spark.createDataFrame([(i, "one two three four " * 20, s) for i, s in enumerate("abc" * 20)], "doc_id bigint, text string, source string")
    goal = spark.createDataFrame([("a", 0.4, none), ("b", 0.4, None), ("c", 0.2, 2)], "source string, target_share double, max_repeats int")
    report = {r.source: r for r in mixing.shares(mixing.selection(docs, goal, block=8), goal).collect()}
    assert report["a"].tokens == 0 and report["a"].target_share == 0.4
    assert abs(report["b"].share - 2 / 3) < 0.15 and abs(report["c"].share - 1 / 3) < 0.15
    only = goal.where("source = 'a'")
    assert mixing.selection(docs, only, block=8).count() == 0


# 9


def brute_repeated(text, size=8):
    words = (text or "").encode().split()
    grams = collections.Counter(tuple(words[i : i + size]) for i in range(len(words) - size + 1))
    hit = [False] * len(words)
    for i in range(len(words) - size + 1):
        if grams[tuple(words[i : i + size])] > 1:
            hit[i : i + size] = [True] * size
    return len(words), sum(hit)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=60), st.integers(1, 9))
def test_repeated_words(words, size):
    ids = np.array([ord(c) for c in words], np.int64)
    assert repetition.repeated_words(ids, size) == brute_repeated(" ".join(words), size)[1]


def test_repeated_share(spark):
    rng = random.Random(9)
    texts = [None, "", " \n", "one", "a b c d e f g h", "a b c d e f g h " * 2, "x " * 100_000, "\xa0\x1c \x85   word " * 9, *[" ".join(rng.choice("abcd") for _ in range(300)) for _ in range(20)]]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(5, texts[5])], "doc_id bigint, text string").withColumns({"words": F.lit(1), "share": F.lit("x")})
    got = {r.doc_id: (r.words, r.repeated) for r in repetition.repeated_share(df).collect()}
    assert got == {i: brute_repeated(t) for i, t in enumerate(texts)}
    assert repetition.repeated_share(df.limit(0)).count() == 0


def test_line_frequency(spark):
    rows = [(i, "h", f"Copyright {i}\nown line {'abc'[i % 3]}x{'y' * i}\n") for i in range(30)] + [(100, None, None), (101, "h", ""), (102, "g", "Copyright 1")]
    df = spark.createDataFrame(rows, "doc_id bigint, host string, text string").withColumn("line", F.lit("clash"))
    got = {r.doc_id: r for r in repetition.line_frequency(df, F.col("host"), limit=20, keep=0.6).collect()}
    assert got[3].lines == 2 and got[3].removed == 1 and got[3].rejected
    assert got[100].lines == 0 and not got[100].rejected and got[102].removed == 0
