import random

import pytest
from pyspark.sql import functions as F

from siftloom.operators import classify
from siftloom.operators.classify import COUNTERS, Options, _Read

HITS = "read bigint, ord bigint, misses int, hits array<struct<i:int,id:bigint,saturated:boolean>>"


def reads(seed=1, n=6, frames=40, sat=0.2):
    rng = random.Random(seed)
    out = []
    for read in range(n):
        for pos in range(frames):
            hits = [(i, rng.randrange(1, 4), rng.random() < sat) for i in range(3) if rng.random() < 0.9]
            out.append((read, pos, 3 - len(hits), hits))
    return out


def counted(rows):
    """Counters of every (read, id), frame by frame."""
    out = {}
    for read, _, misses, hits in sorted(rows):
        seen = []
        for _, id_, sat in hits:
            c = out.setdefault((read, id_), [0] * 6)
            c[2] += 1
            c[3] += not sat
            if (id_, sat) not in seen:
                if not sat:
                    c[1] += 1
                    c[0] += 1
                elif (id_, False) not in seen:
                    c[0] += 1
                seen.append((id_, sat))
        if not any(s for _, s in seen):
            for id_, _ in seen:
                out[read, id_][4] += 1
                out[read, id_][5] += misses == 0
    return out


def test_all_counts(spark):
    rows = reads()
    got = {(r.read, r.id): [r[c] for c in COUNTERS] for r in classify.all_counts(spark.createDataFrame(rows, HITS).withColumn("pos", F.col("ord"))).collect()}
    assert got == counted(rows)


def test_classify_without_early_stop_reports_the_counts(spark):
    rows = reads()
    probs = spark.createDataFrame([(i, 0.1 * i) for i in range(1, 4)], "id bigint, prob double")
    got = classify.classify(spark.createDataFrame(rows, HITS), probs, Options(extra_frames=10**9)).collect()
    want = counted(rows)
    assert {r.read for r in got} == set(range(6))
    for r in got:
        assert [r[c] for c in COUNTERS] == want[r.read, r.id] and abs(r.frameProb - 0.1 * r.id) < 1e-9


def test_clear_reads_stop_early():
    read = _Read(Options(extra_frames=5))
    stopped = next(i for i in range(1000) if read.frame(0, [(1, False), (1, False)]))
    assert 0 < stopped < 100
    assert [r[0] for r in read.results()] == [1]


def test_reads_without_hits_have_no_result(spark):
    assert _Read(Options()).results() == []
    empty = spark.createDataFrame([(1, 0, 3, [])], HITS)
    probs = spark.createDataFrame([], "id bigint, prob double")
    assert classify.classify(empty, probs).count() == 0


def test_pairs_interleave(spark):
    mates = {0: [0, 2, 3, 5, 6, 9], 1: [1, 4, 7, 8, 20, 21, 22, 23]}
    df = {m: spark.createDataFrame([(1, p, f"m{m}p{p}") for p in at], "read bigint, pos int, elem string") for m, at in mates.items()}
    got = [r.elem for r in classify.interleaved(df[0], df[1]).orderBy("ord").collect()]
    want, left = [], {m: [f"m{m}p{p}" for p in at] for m, at in mates.items()}
    turn = 0
    while left[0] or left[1]:
        m = 0 if turn % 2 == 0 and left[0] else 1 if left[1] else 0
        want.append(left[m].pop(0))
        turn += 1
    assert got == want


class Sequential:
    """One read after another, frame by frame, in the words of the surveyed behaviour; kept apart from the operator."""

    def __init__(self, o):
        self.o = o

    def run(self, frames):
        count, cands, best, second, extra, sat_frames, evaluated = {}, [], dict.fromkeys(COUNTERS, 0), 0, 0, 0, 0
        near = lambda a, b: max(a, b) - max(a, b) ** 0.5 <= min(a, b) + min(a, b) ** 0.5
        for misses, hits in frames:
            evaluated += 1
            if hits is None:
                continue
            seen, sats = [], 0
            for id_, sat in hits:
                evaluated += 1
                c = count.setdefault(id_, dict.fromkeys(COUNTERS, 0))
                sats += sat
                c["totalCount"] += 1
                c["totalNonSatCount"] += not sat
                if (id_, sat) not in seen:
                    if not sat:
                        c["nonSatCount"] += 1
                    if not sat or (id_, False) not in seen:
                        c["count"] += 1
                    seen.append((id_, sat))
            if sats:
                sat_frames += 1
            else:
                for id_, _ in seen:
                    count[id_]["nonSatFrameCount"] += 1
                    count[id_]["solidCount"] += misses == 0
            for id_, sat in seen:
                if sat and (id_, False) in seen:
                    continue
                c = count[id_]
                if c["count"] >= self.o.min_counts.get(id_, self.o.min_count) or cands and c["count"] >= best["count"]:
                    if id_ not in cands:
                        cands.append(id_)
                    if c["nonSatFrameCount"] > best["nonSatFrameCount"]:
                        best["nonSatFrameCount"] = c["nonSatFrameCount"]
                    elif c["nonSatFrameCount"] > second:
                        second = c["nonSatFrameCount"]
                    for k in COUNTERS:
                        best[k] = max(best[k], c[k])
            if near(best["totalNonSatCount"], second):
                extra = 0
            if best["nonSatFrameCount"] > second:
                if self.o.extra_frames < extra:
                    break
                extra += 1
        found = {}
        if cands and self.o.min_frames <= best["nonSatFrameCount"]:
            valid = [i for i in cands if any(near(count[i][k], best[k]) for k in COUNTERS)]
            if len(valid) == 1:
                found = {valid[0]: count[valid[0]]}
            elif valid:
                order = ("nonSatFrameCount", "count", "solidCount", "nonSatCount", "totalNonSatCount", "totalCount")
                valid.sort(key=lambda i: ([-count[i][k] for k in order], i))
                top, x = count[valid[0]], self.o.extra
                tied = [i for i in valid if all(top[k] - x * top[k] ** 0.5 <= count[i][k] + x * count[i][k] ** 0.5 for k in COUNTERS)]
                if not (self.o.best_agrees and len(tied) > 1 and any(count[tied[0]][k] < count[tied[1]][k] for k in COUNTERS)):
                    found = {i: count[i] for i in tied}
        return {i: [c[k] for k in COUNTERS] for i, c in found.items()}, sat_frames, evaluated


@pytest.mark.parametrize("options", [Options(extra_frames=3), Options(extra_frames=8, extra=0.3, min_count=4, min_counts={2: 9, 3: 1}), Options(extra_frames=2, best_agrees=True, extra=2.5, min_frames=3)])
@pytest.mark.parametrize("sat", [0.05, 0.4])
def test_classifier_is_sequential_with_early_stop(spark, options, sat):
    rng = random.Random(sat)
    frames, model = [], {}
    for read in range(40):
        own, seq = rng.randrange(1, 5), []
        for ord_ in range(rng.randrange(1, 60)):
            if rng.random() < 0.3:
                seq.append((0, None))  # missed
                continue
            hits = [(own if rng.random() < 0.7 else rng.randrange(1, 5), rng.random() < sat) for _ in range(3)]
            keep = [i for i in range(3) if rng.random() < 0.9] or [0]
            seq.append((3 - len(keep), [hits[i] for i in keep]))
            frames.append((read, ord_, 3 - len(keep), [(i, *hits[i]) for i in keep]))
        model[read] = seq
    got = spark.createDataFrame(frames, HITS)
    probs = spark.createDataFrame([(i, 0.1 * i) for i in range(1, 4)], "id bigint, prob double")
    want = {r: Sequential(options).run(seq) for r, seq in model.items()}
    found = classify.classify(got, probs, options).collect()
    assert {(r.read, r.id): [r[c] for c in COUNTERS] for r in found} == {(r, i): c for r, w in want.items() for i, c in w[0].items()}
    assert all(abs(r.frameProb - (0.1 * r.id if r.id < 4 else 0)) < 1e-9 for r in found)
    all_frames = spark.createDataFrame([(r, i) for r, seq in model.items() for i in range(len(seq))], "read bigint, pos int")
    assert {r.read: (r.sat_frames, r.evaluated) for r in classify.evaluation(all_frames, got, options).collect()} == {r: w[1:] for r, w in want.items()}
    stopped = {r.read for r in classify.folded(got, options).where("stopped is not null").collect()}
    assert stopped and stopped != set(model)


def test_ranking(spark):
    rows = [(1, 5, 1, 0, 0, 0, 3, 0, 0.5), (1, 6, 1, 0, 0, 0, 3, 0, float("nan")), (1, 7, 1, 0, 0, 0, 4, 0, None), (2, None, 1, 0, 0, 0, 4, 0, 0.1)]
    df = spark.createDataFrame(rows, "read_id bigint, id bigint, count int, nonSatCount int, totalCount int, totalNonSatCount int, nonSatFrameCount int, solidCount int, frameProb double")
    got = {(r.read_id, r.place): r.id for r in classify.ranked(df, "read_id", "id").collect()}
    assert got == {(1, 1): 7, (1, 2): 5, (1, 3): 6, (2, 1): None}


def test_predicates(spark):
    df = spark.createDataFrame([(10, 16), (10, 40), (40, 10), (5, 6)], "a int, b int")
    a, b = F.col("a"), F.col("b")
    got = df.select(classify.roughly_equal(a, b, 1), classify.within_error(a, b), classify.within_error_or_larger(a, b, 1.0)).collect()
    assert [tuple(r) for r in got] == [(False, True, True), (False, False, True), (False, False, False), (True, True, True)]
