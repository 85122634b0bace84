"""Problem 4: long exact spans shared between records of different sources.

Method: suffix automata of reference shards. Every record is a document and a reference at once, so broadcasting the
automaton of each shard to all documents would cost shards x documents. A shard here is instead the set of stretches that
share an anchor (the smallest hashed word within a window, the same in every copy of the window): two equal windows
always have the same anchor, so an automaton travels only to the stretches that can match it, and the work stays in
proportion to the text. The automaton of a shard covers its distinct stretches; each state knows the smallest and largest
source that reaches it, so the matching statistic of a position, the longest suffix that stands in two sources at least,
is found by streaming the stretch through the automaton. Positions under a match of `length` or more are the shared ones.

Exact copies of a stretch are merged before the shards are built, letters travel in two bits each, and records find the matches of
their stretches by anchor and a 64-bit hash of the stretch. A shard of one stretch that stands in two sources is shared
whole, as every state of its automaton has both. A shard of more than `most` letters (a repeat anchor may hold a third of all
rows) is cut into finer ones by anchors of longer words, up to words as long as the window, whose shards hold one window or a run of equal
ones; then its automata are built.

Defined cases: records without a source (null or 0), with null or empty text or text shorter than `length` have no
windows; windows with letters outside the alphabet are none; a record delivered again is one record; extra columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftloom.session import durable, shuffle_partitions

WORD = 16
#: Words of the anchors of finer shards; the window itself comes last.
FINER = (24, 36)
#: Letters that are cut together; arrays of them fit a core's cache.
CHUNK = 1 << 17


class SuffixAutomaton:
    """Over the texts of several shards, each from a root of its own; lo and hi hold the smallest and largest source whose text contains
    a state's strings. Texts are letters 0 to 3."""

    def __init__(self):
        self.next: list[dict] = []
        self.link: list[int] = []
        self.len: list[int] = []
        self.states: list[int] = []
        self.sizes: list[int] = []
        self.low: list[int] = []
        self.high: list[int] = []
        self.root = 0

    def shard(self) -> None:
        """The texts from here on meet each other only."""
        self.root = len(self.next)
        self.next.append({})
        self.len.append(0)
        self.link.append(-1)

    def add(self, text, lo: int, hi: int) -> None:
        """A text that stands in sources of which lo is the smallest and hi the largest."""
        nxt, link, length, passed = self.next, self.link, self.len, self.states
        root = last = self.root
        new = len(nxt)
        for c in text:
            p = last
            q = nxt[p].get(c)
            if q is None:
                last = new
                new += 1
                nxt.append({})
                length.append(length[p] + 1)
                link.append(root)
                while p >= 0 and c not in nxt[p]:
                    nxt[p][c] = last
                    p = link[p]
                if p >= 0:
                    q = nxt[p][c]
                    link[last] = q
            else:
                last = q
            if q is not None:
                n = length[p] + 1
                if length[q] != n:  # the shorter strings of q part from it
                    if last == q:
                        last = new
                    else:
                        link[last] = new
                    nxt.append(nxt[q].copy())
                    length.append(n)
                    link.append(link[q])
                    link[q] = new
                    while p >= 0 and nxt[p].get(c) == q:
                        nxt[p][c] = new
                        p = link[p]
                    new += 1
            passed.append(last)
        self.sizes.append(len(text))
        self.low.append(lo)
        self.high.append(hi)

    def statistics(self) -> np.ndarray:
        """For every position of all texts, one after another: the length of the longest match ending there that stands in two sources."""
        link, length, sizes = np.array(self.link), np.array(self.len), np.array(self.sizes)
        at = np.array(self.states)
        n = np.arange(len(at)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + 1
        # A prefix of n letters moved with the clones that took the shorter strings of its state.
        while True:
            up = link[at]
            moved = (up >= 0) & (length[up] >= n)
            if not moved.any():
                break
            at = np.where(moved, up, at)
        # Every prefix stands in its text's sources, and so do its suffixes: from the longest states to the shortest.
        lo, hi = np.full(len(link), 1 << 62), np.full(len(link), -1)
        np.minimum.at(lo, at, np.repeat(self.low, sizes))
        np.maximum.at(hi, at, np.repeat(self.high, sizes))
        order = np.argsort(length, kind="stable")
        cuts = np.flatnonzero(np.diff(length[order])) + 1
        levels = np.split(order, cuts)
        for states in reversed(levels[1:]):
            np.minimum.at(lo, link[states], lo[states])
            np.maximum.at(hi, link[states], hi[states])
        shared = np.where(lo != hi, length, 0)
        for states in levels[1:]:
            shared[states] = np.maximum(shared[states], shared[link[states]])
        return np.minimum(shared[at], n)


def _codes(text: bytes) -> np.ndarray:
    table = np.full(256, 4, np.uint8)
    for i, c in enumerate(b"ACGT"):
        table[c] = i
    return table[np.frombuffer(text, np.uint8)]


def _mixed(x: np.ndarray) -> np.ndarray:
    """A published finaliser of 64 bits: shifts and multiplications that spread every bit over all others."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def _words(codes: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit number for the word of each position, equal for equal words."""
    by: dict[int, np.ndarray] = {1: codes.astype(np.uint64)}

    def packed(k: int) -> np.ndarray:
        if k not in by:
            half = 1 << ((k - 1).bit_length() - 1)
            left, right = packed(half), packed(k - half)
            n = len(codes) - k + 1
            by[k] = (left[:n] << np.uint64(2 * (k - half))) + right[half : half + n]
        return by[k]

    if size <= 32:
        return _mixed(packed(size))
    n = len(codes) - size + 1
    return _mixed(_mixed(packed(32)[:n]) + packed(32)[size - 32 : size - 32 + n] * np.uint64(0x9E3779B97F4A7C15))  # the golden ratio again


def _anchors(codes: np.ndarray, length: int, word: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts of all plain windows, anchor of each window, the number of each word)."""
    n = len(codes)
    if n < length:
        return np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.uint64)
    bad = np.concatenate([[0], np.cumsum(codes > 3)])
    starts = np.flatnonzero(bad[length:] == bad[:-length])
    if not len(starts):
        return starts, np.empty(0, np.uint64), np.empty(0, np.uint64)
    low = words = _words(codes, word)
    # Running minimum over length - word + 1 words, by doubling.
    span, width = length - word + 1, 1
    while width * 2 <= span:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if width < span:
        low = np.minimum(low[: len(low) - (span - width)], low[span - width :])
    return starts, low[starts], words


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, list[bytes]]]:
    """(records, sources, texts) of CHUNK letters or little more; a letter is a byte."""
    for b in batches:
        rid, src = b.column(0).to_numpy(), b.column(1).to_numpy()
        texts: list[bytes] = []
        at, size = 0, 0
        for i, x in enumerate(b.column(2).to_pylist()):
            texts.append(x.encode("latin-1", "replace"))
            size += len(texts[-1])
            if size >= CHUNK:
                yield rid[at : i + 1], src[at : i + 1], texts
                texts, at, size = [], i + 1, 0
        if texts:
            yield rid[at:], src[at:], texts


_POWERS = np.ones((2, 1), np.uint64)


def _powers(n: int) -> np.ndarray:
    """The first n powers, modulo 2^64, of an odd number and of its inverse."""
    global _POWERS
    if _POWERS.shape[1] < n:
        base = 0x9E3779B97F4A7C15  # the golden ratio in 64 bits, a usual odd number; any other would do
        steps = np.array([[base], [pow(base, -1, 1 << 64)]], np.uint64)
        _POWERS = np.cumprod(np.hstack([np.ones((2, 1), np.uint64), np.repeat(steps, 2 * n, axis=1)]), axis=1)
    return _POWERS


class _Cut:
    """The stretches of texts, longest runs of neighbouring windows with one anchor: number of the text, start in it, size, anchor and hash.

    All texts are one array, apart by a letter that no window may hold."""

    def __init__(self, texts: list[bytes], length: int, word: int):
        self.codes = _codes(b"\n".join(texts))
        starts, anchor, words = _anchors(self.codes, length, word)
        cut = np.flatnonzero((np.diff(starts) != 1) | (anchor[1:] != anchor[:-1])) + 1 if len(starts) else np.empty(0, np.int64)
        firsts = np.append(0, cut)[: len(starts)]
        self.start, end = starts[firsts], starts[np.append(cut - 1, len(starts) - 1)[: len(firsts)]] + length
        self.size = end - self.start
        self.anchor = anchor[firsts]
        sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        first = np.cumsum(sizes) - sizes
        self.text = np.searchsorted(first, self.start, "right") - 1
        self.at = self.start - first[self.text]
        # The words of a stretch in their order, by prefix sums over powers; the words themselves are mixed.
        up, down = _powers(len(words) + 1)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * up[: len(words)])])
        self.hash = _mixed((sums[end - word + 1] - sums[self.start]) * down[self.start] + self.size.astype(np.uint64)) if len(firsts) else anchor

    def letters(self, which: np.ndarray) -> pa.Array:
        """Two bits a letter, each stretch from a byte of its own."""
        start, size = self.start[which], self.size[which]
        n = (size + 3) // 4
        ends = np.cumsum(n)
        at = np.repeat(start - (ends - n) * 4, n) + 4 * np.arange(ends[-1] if len(ends) else 0)
        x = np.append(self.codes & 3, np.zeros(3, np.uint8))
        fours = (x[:-3] << 6) | (x[1:-2] << 4) | (x[2:-1] << 2) | x[3:]
        data = fours[at]
        data[ends - 1] &= np.array([0xFF, 0xC0, 0xF0, 0xFC], np.uint8)[size % 4]  # nothing of what follows
        return pa.BinaryArray.from_buffers(pa.binary(), len(which), [None, pa.py_buffer(np.append(0, ends).astype(np.int32)), pa.py_buffer(data)])

    def distinct(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """One of each distinct stretch, with the smallest of low and the largest of high over its copies."""
        order = np.lexsort((self.hash, self.anchor))
        a, h = self.anchor[order], self.hash[order]
        firsts = np.append(0, np.flatnonzero((a[1:] != a[:-1]) | (h[1:] != h[:-1])) + 1)
        return order[firsts], np.minimum.reduceat(low[order], firsts), np.maximum.reduceat(high[order], firsts)


#: The four letters of each byte.
FOURS = [bytes([x >> 6, x >> 4 & 3, x >> 2 & 3, x & 3]) for x in range(256)]


def _unpacked(data: bytes, size: int) -> bytes:
    return b"".join(map(FOURS.__getitem__, data))[:size]


SHARD = "anchor long, h long, size int, stretch binary, low long, high long"
NAMES = ["anchor", "h", "size", "stretch", "low", "high"]


def _shard_columns(c: _Cut, which: np.ndarray, low: np.ndarray, high: np.ndarray, anchor: np.ndarray) -> list[pa.Array]:
    return [pa.array(anchor[which].view(np.int64)), pa.array(c.hash[which].view(np.int64)), pa.array(c.size[which].astype(np.int32)), c.letters(which), pa.array(low, pa.int64()), pa.array(high, pa.int64())]


def _distinct_stretches(length: int, word: int):
    """SHARD rows: each chunk's distinct stretches with their smallest and largest source. Copies meet here, before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, src, texts in _chunks(batches):
            c = _Cut(texts, length, word)
            if len(c.start):
                which, low, high = c.distinct(src[c.text], src[c.text])
                yield pa.record_batch(_shard_columns(c, which, low, high, c.anchor), names=NAMES)

    return run


def _placed_stretches(length: int, word: int):
    """(rid, anchor, h, at): where the stretches of each record start."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rid, _, texts in _chunks(batches):
            c = _Cut(texts, length, word)
            yield pa.record_batch([pa.array(rid[c.text], pa.int64()), pa.array(c.anchor.view(np.int64)), pa.array(c.hash.view(np.int64)), pa.array(c.at, pa.int64())], names=["rid", "anchor", "h", "at"])

    return run


def _finer(length: int, word: int):
    """Of the stretches of large shards, those by longer words: SHARD rows with the stretch they lie in (up, up_h) and where (at)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            up, up_h, sizes, data, low, high = (b.column(i) for i in range(6))
            texts = [bytes(b"ACGT"[x] for x in _unpacked(d, n)) for d, n in zip(data.to_pylist(), sizes.to_pylist())]
            c = _Cut(texts, length, word)
            which = np.arange(len(c.start))
            anchor = _mixed(up.to_numpy().view(np.uint64)[c.text] ^ c.anchor)  # windows of two shards never meet
            columns = _shard_columns(c, which, low.to_numpy()[c.text], high.to_numpy()[c.text], anchor)
            yield pa.record_batch([*columns, up.take(pa.array(c.text)), up_h.take(pa.array(c.text)), pa.array(c.at, pa.int64())], names=[*NAMES, "up", "up_h", "at"])

    return run


def _runs(stats: np.ndarray, length: int) -> tuple[list[int], list[int]]:
    """Runs of positions (from 0, ends excluded) that lie under matches of `length` or more."""
    lo, hi = [], []
    ends = np.flatnonzero(stats >= length)
    for e, m in zip((ends + 1).tolist(), stats[ends].tolist()):
        if hi and e - m <= hi[-1]:
            hi[-1] = e
            while len(hi) > 1 and e - m <= hi[-2]:
                lo.pop()
                hi.pop()
                hi[-1] = e
            lo[-1] = min(lo[-1], e - m)
        else:
            lo.append(e - m)
            hi.append(e)
    return lo, hi


#: Letters that automata are built for before their matches are read off.
TOGETHER = 1 << 17


def _automata(length: int):
    """Rows come sorted by anchor: a shard is a run of rows with one anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(found: list[tuple]) -> pa.RecordBatch:
            a, h, lo, hi = zip(*found)
            return pa.record_batch([pa.array(a, pa.int64()), pa.array(h, pa.int64()), pa.array(lo, pa.list_(pa.int64())), pa.array(hi, pa.list_(pa.int64()))], names=["anchor", "h", "lo", "hi"])

        held: list[tuple[int, int]] = []
        sam = SuffixAutomaton()
        rows: list[tuple] = []

        def close() -> Iterator[tuple]:
            if len(rows) == 1:
                anchor, h, size, _, low, high = rows[0]
                if low != high:
                    yield anchor, h, [0], [size]
                return
            sam.shard()
            for anchor, h, size, data, low, high in rows:
                sam.add(_unpacked(data, size), low, high)
                held.append((anchor, h))

        def read() -> Iterator[tuple]:
            nonlocal sam
            if held:
                stats, at = sam.statistics(), 0
                for (anchor, h), size in zip(held, sam.sizes):
                    lo, hi = _runs(stats[at : at + size], length)
                    at += size
                    if lo:
                        yield anchor, h, lo, hi
                held.clear()
                sam = SuffixAutomaton()

        found: list[tuple] = []
        for b in batches:
            for x in zip(*(c.to_pylist() for c in b.columns)):
                if rows and rows[0][0] != x[0]:
                    found += close()
                    rows.clear()
                    if len(sam.states) > TOGETHER:
                        found += read()
                rows.append(x)
            if len(found) > 5000:
                yield out(found)
                found = []
        if rows:
            found += close()
        found += read()
        if found:
            yield out(found)

    return run


def _shards(stretches: DataFrame) -> DataFrame:
    """Distinct stretches with the letters of their shard, of the shards that two sources have."""
    distinct = stretches.groupBy("anchor", "h", "size", "stretch").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    shard = Window.partitionBy("anchor")
    sized = distinct.withColumns({"l": F.min("low").over(shard), "u": F.max("high").over(shard), "letters": F.sum("size").over(shard)})
    return durable(sized.where(F.col("l") != F.col("u")).drop("l", "u"), "shards")


def _matches(shards: DataFrame, length: int, most: int, finer: tuple[int, ...], parts: int) -> DataFrame:
    """(anchor, h, lo, hi): the shared runs of every stretch of the shards, from 0, ends excluded."""
    fit = F.col("letters") <= most if finer else F.lit(True)
    small = shards.where(fit).select(NAMES).repartition(parts, "anchor").sortWithinPartitions("anchor")
    matched = small.mapInArrow(_automata(length), "anchor long, h long, lo array<long>, hi array<long>").select("anchor", "h", F.explode(F.arrays_zip("lo", "hi")).alias("x")).select("anchor", "h", "x.lo", "x.hi")
    large = shards.where(~fit)
    if not finer or large.isEmpty():
        return matched
    parts_of = durable(large.select(NAMES).mapInArrow(_finer(length, finer[0]), SHARD + ", up long, up_h long, at long"), "finer")
    below = _matches(_shards(parts_of.select(NAMES)), length, most, finer[1:], parts)
    back = parts_of.select("up", "up_h", "at", "anchor", "h").join(below, ["anchor", "h"]).select(F.col("up").alias("anchor"), F.col("up_h").alias("h"), (F.col("at") + F.col("lo")).alias("lo"), (F.col("at") + F.col("hi")).alias("hi"))
    return matched.unionByName(back)


def shared_spans(records: DataFrame, record_id: str, source: str, text: Column, length: int = 50, most: int = 200_000) -> DataFrame:
    """(record, span_start, span_end): maximal runs of shared positions, from 1, both ends included."""
    parts = shuffle_partitions(records.sparkSession)
    base = records.select(F.col(record_id).cast("long").alias("rid"), F.col(source).cast("long").alias("src"), text.alias("text"))
    base = base.where(F.col("src").isNotNull() & (F.col("src") != 0) & F.col("rid").isNotNull() & (F.length("text") >= length))
    word = min(WORD, length)

    # Letters are shuffled once, by anchor; each task's copies are merged before. Of the anchors those stay that two sources have.
    sent = base.select("rid", "src", "text").mapInArrow(_distinct_stretches(length, word), SHARD).repartition(parts, "anchor")
    matched = _matches(_shards(sent), length, most, (*(w for w in FINER if word < w < length), length), parts)

    # Records meet the matches of their stretches by anchor and hash, without their texts.
    pieces = base.select("rid", "src", "text").mapInArrow(_placed_stretches(length, word), "rid long, anchor long, h long, at long")
    placed = pieces.join(matched, ["anchor", "h"]).select("rid", (F.col("at") + F.col("lo")).alias("lo"), (F.col("at") + F.col("hi")).alias("hi")).distinct()
    w = Window.partitionBy("rid").orderBy("lo", "hi")
    reach = F.max("hi").over(w.rowsBetween(Window.unboundedPreceding, -1))
    starts = placed.withColumn("new", F.when(F.col("lo") <= reach, 0).otherwise(1))
    runs = starts.withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    spans = runs.groupBy("rid", "run").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    return spans.select(F.col("rid").alias("record"), (F.col("lo") + 1).alias("span_start"), F.col("hi").alias("span_end"))


def shared_part(records: DataFrame, record_id: str, source: str, text: Column, spans: DataFrame) -> DataFrame:
    """(record, size, shared, part) for every record, those without a source too: the share of its positions that is shared."""
    sizes = records.groupBy(F.col(record_id).alias("record")).agg(F.max(F.coalesce(F.length(text), F.lit(0))).cast("long").alias("size"))
    covered = spans.groupBy(F.col("record").alias("r")).agg(F.sum(F.col("span_end") - F.col("span_start") + 1).alias("shared"))
    joined = sizes.join(covered, F.col("record") == F.col("r"), "left").withColumn("shared", F.coalesce("shared", F.lit(0)))
    return joined.select("record", "size", "shared", F.when(F.col("size") > 0, F.round(F.col("shared") / F.col("size"), 6)).otherwise(0.0).alias("part"))
