"""Problem 3: how often every distinct term occurs, and in how many records.

Method: burst-trie counting. Rows are gathered by record, all rows of a record in one place, where rows delivered again are found and
the others are counted in a trie whose leaves are compact sorted containers; a container that outgrows its limit bursts into
children by the next byte. A term's entry remembers the last record it was seen in, so record counts need no list of records.
A term with a third of all rows is one entry of each trie from then on.

The tries are cut into subtrees by prefixes that adapt to the data: short ones, and longer ones where the entries under a
prefix are more than a worker's share. Matching subtrees of all workers travel to one of them, which merges them subtree by
subtree; a record was counted by one worker only, so its counts add up. Rows and subtrees travel as compressed columns.

Defined cases: null terms and null records are no rows; a null group is a group of its own; a row delivered again (same
group, record, position and term) counts once; rows without a position count each; a term of any length is one term; an
empty table gives no rows; extra columns are ignored. Terms above WIDE bytes are told apart by their first 24 bytes and 152
bits of a digest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftloom.session import durable, shuffle_partitions

#: Bytes of the shortest prefixes; each longer one has twice as many.
SHORT = 4
CHUNK = 1 << 18
#: Entries of a trie that is sent away and begun anew, at the border of two buckets of records.
FULL = 1 << 21
#: Buckets of records a task.
FINE = 4
#: Terms above this many bytes are held as their beginning and a digest; the term itself is kept beside the trie.
WIDE = 64


class Container:
    """Leaf of the trie: sorted distinct terms with their counters, and rows that wait to be merged in."""

    __slots__ = ("terms", "occ", "recs", "last", "waiting", "n_waiting")

    def __init__(self):
        self.terms = np.empty(0, "S1")
        self.occ = self.recs = self.last = np.empty(0, np.int64)
        self.waiting: list[tuple[np.ndarray, np.ndarray]] = []
        self.n_waiting = 0

    def compact(self) -> None:
        """Merges the waiting rows, which are in record order, into the counters."""
        if not self.waiting:
            return
        t = np.concatenate([x for x, _ in self.waiting]) if len(self.waiting) > 1 else self.waiting[0][0]
        r = np.concatenate([x for _, x in self.waiting]) if len(self.waiting) > 1 else self.waiting[0][1]
        self.waiting, self.n_waiting = [], 0
        order = np.argsort(t, kind="stable")
        t, r = t[order], r[order]
        new_term = np.ones(len(t), bool)
        new_term[1:] = t[1:] != t[:-1]
        new_rec = new_term.copy()
        new_rec[1:] |= r[1:] != r[:-1]
        at = np.flatnonzero(new_term)
        terms, firsts = t[at], r[at]
        occ = np.diff([*at, len(t)])
        recs = np.add.reduceat(new_rec.astype(np.int64), at)
        last = r[np.append(at[1:], len(t)) - 1]
        if len(self.terms):
            where = np.searchsorted(self.terms, terms)
            inside = np.minimum(where, len(self.terms) - 1)
            known = self.terms[inside] == terms
            k = inside[known]
            self.occ[k] += occ[known]
            self.recs[k] += recs[known] - (self.last[k] == firsts[known])
            self.last[k] = last[known]
            terms, occ, recs, last, where = terms[~known], occ[~known], recs[~known], last[~known], where[~known]
            if len(terms):
                wide = max(self.terms.dtype.itemsize, terms.dtype.itemsize)
                self.terms = np.insert(self.terms.astype(f"S{wide}"), where, terms)
                self.occ, self.recs, self.last = np.insert(self.occ, where, occ), np.insert(self.recs, where, recs), np.insert(self.last, where, last)
        else:
            self.terms, self.occ, self.recs, self.last = terms, occ.astype(np.int64), recs, last

    def split(self, depth: int) -> dict[int, Container]:
        byte = _byte_at(self.terms, depth)
        children: dict[int, Container] = {}
        cuts = np.flatnonzero(np.diff(byte)) + 1
        for lo, hi in zip([0, *cuts], [*cuts, len(byte)]):
            c = children[int(byte[lo])] = Container()
            c.terms, c.occ, c.recs, c.last = self.terms[lo:hi], self.occ[lo:hi].copy(), self.recs[lo:hi].copy(), self.last[lo:hi].copy()
        return children


def _byte_at(terms: np.ndarray, depth: int) -> np.ndarray:
    """The byte of each term at a depth; 0 beyond its end."""
    if depth >= terms.dtype.itemsize:
        return np.zeros(len(terms), np.uint8)
    return np.ascontiguousarray(terms).view(np.uint8).reshape(len(terms), -1)[:, depth]


class BurstTrie:
    """Access trie over bytes with containers as leaves. Terms end in a mark byte, so that none is cut by a trailing zero."""

    def __init__(self, limit: int = 8192):
        self.limit = limit
        self.root: Container | dict = Container()

    def add(self, terms: np.ndarray, records: np.ndarray) -> None:
        """Rows in record order."""
        self.root = self._add(self.root, terms, records, 0)

    def _add(self, node, terms: np.ndarray, records: np.ndarray, depth: int):
        if isinstance(node, dict):
            byte = _byte_at(terms, depth)
            order = np.argsort(byte, kind="stable")
            byte, terms, records = byte[order], terms[order], records[order]
            cuts = np.flatnonzero(np.diff(byte)) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(byte)]):
                b = int(byte[lo])
                node[b] = self._add(node.get(b) or Container(), terms[lo:hi], records[lo:hi], depth + 1)
            return node
        node.waiting.append((terms, records))
        node.n_waiting += len(terms)
        if node.n_waiting >= 2 * self.limit:
            node.compact()
            if len(node.terms) > self.limit and depth < node.terms.dtype.itemsize:
                return self._burst(node, depth)
        return node

    def _burst(self, node: Container, depth: int):
        children: dict = node.split(depth)
        for b, c in children.items():
            if len(c.terms) > self.limit and depth + 1 < c.terms.dtype.itemsize:
                children[b] = self._burst(c, depth + 1)
        return children

    @classmethod
    def of(cls, terms: np.ndarray, occ: np.ndarray, recs: np.ndarray, limit: int = 8192) -> BurstTrie:
        """From distinct terms in order, with their counters."""
        trie = cls(limit)
        c = trie.root
        c.terms, c.occ, c.recs, c.last = terms, occ, recs, np.full(len(terms), -1, np.int64)
        if len(terms) > limit:
            trie.root = trie._burst(c, 0)
        return trie

    def merge(self, other: BurstTrie) -> None:
        """Adds a trie over other records, subtree by subtree."""
        self.root = self._merge(self.root, other.root, 0)

    def _merge(self, x, y, depth: int):
        for node in (x, y):
            if isinstance(node, Container):
                node.compact()
        if isinstance(x, Container) and isinstance(y, Container):
            out = Container()
            wide = max(x.terms.dtype.itemsize, y.terms.dtype.itemsize)
            terms, where = np.unique(np.concatenate([x.terms.astype(f"S{wide}"), y.terms.astype(f"S{wide}")]), return_inverse=True)
            out.terms = terms
            out.occ, out.recs = (np.bincount(where, np.concatenate([getattr(x, f), getattr(y, f)]), len(terms)).astype(np.int64) for f in ("occ", "recs"))
            out.last = np.full(len(terms), -1, np.int64)
            return self._burst(out, depth) if len(terms) > self.limit and depth < wide else out
        x = x if isinstance(x, dict) else x.split(depth) if len(x.terms) else {}
        y = y if isinstance(y, dict) else y.split(depth) if len(y.terms) else {}
        for b, child in y.items():
            x[b] = self._merge(x[b], child, depth + 1) if b in x else child
        return x

    def leaves(self) -> Iterator[Container]:
        """Containers in the order of their terms."""

        def walk(node):
            if isinstance(node, dict):
                for b in sorted(node):
                    yield from walk(node[b])
            else:
                node.compact()
                yield node

        yield from walk(self.root)


def _keys(terms: list[bytes] | pa.Array, long: dict[bytes, bytes]) -> np.ndarray:
    out = []
    for t in terms:
        if len(t) > WIDE:
            short = t[:24] + b"\xff" + hashlib.blake2b(t, digest_size=19).hexdigest().encode()
            long[short] = t
            t = short
        out.append(t + b"\x01")
    return np.array(out, dtype="S")


def _fast_keys(column: pa.Array, long: dict[bytes, bytes]) -> np.ndarray:
    """Terms of equal length without null bytes come from the buffer in one piece; others one by one."""
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + n + 1]
    sizes = np.diff(offsets)
    if n and sizes[0] and (sizes == sizes[0]).all() and sizes[0] <= WIDE:
        data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].reshape(n, -1)
        return np.ascontiguousarray(np.hstack([data, np.ones((n, 1), np.uint8)])).view(f"S{sizes[0] + 1}").ravel()
    return _keys(column.to_pylist(), long)


_CODEC = pa.Codec("zstd", 1)


def _packed(numbers: list[np.ndarray], terms: pa.Array) -> bytes:
    """Columns of numbers and one of binary terms, compressed; the size of what is compressed comes first."""
    offsets = np.frombuffer(terms.buffers()[1], np.int32)[terms.offset : terms.offset + len(terms) + 1]
    letters = terms.buffers()[2]
    raw = b"".join([np.array([len(terms), len(numbers)], np.int64).tobytes(), *(x.astype(np.int64).tobytes() for x in numbers), np.diff(offsets).tobytes(), memoryview(letters)[offsets[0] : offsets[-1]] if letters else b""])
    return len(raw).to_bytes(8, "little") + _CODEC.compress(raw, asbytes=True)


def _opened(body: bytes) -> tuple[list[np.ndarray], pa.Array]:
    raw = _CODEC.decompress(body[8:], int.from_bytes(body[:8], "little"))
    n, k = np.frombuffer(raw, np.int64, 2).tolist()
    numbers = [np.frombuffer(raw, np.int64, n, 16 + 8 * n * i) for i in range(k)]
    at = 16 + 8 * n * k
    ends = np.cumsum(np.frombuffer(raw, np.int32, n, at))
    return numbers, pa.BinaryArray.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.append(0, ends).astype(np.int32)), raw.slice(at + 4 * n)])


def _mixed(x: np.ndarray) -> np.ndarray:
    """A published finaliser of 64 bits: shifts and multiplications that spread every bit over all others."""
    x = x.view(np.uint64)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def _gathered_in(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    held, n = [], 0
    for b in batches:
        if b.num_rows:
            held.append(b)
            n += b.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held).combine_chunks()
            held, n = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _column(t: pa.Table, name: str) -> pa.Array:
    c = t.column(name)
    return c.chunk(0) if c.num_chunks == 1 else c.combine_chunks()


def _bundled(buckets: int, chunk: int):
    """(grp, bucket, body): the rows (record, position, term) of each bucket of records, a chunk at a time, in the order of records."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _gathered_in(batches, chunk):
            grp = _column(t, "grp").dictionary_encode(null_encoding="encode")
            code, rec, pos = grp.indices.to_numpy().astype(np.int64), _column(t, "record").to_numpy(), _column(t, "pos").to_numpy()
            bucket = (_mixed(rec) % np.uint64(buckets)).astype(np.int64)
            cell = code * buckets + bucket
            order = np.lexsort((pos, rec, cell))
            cell, rec, pos = cell[order], rec[order], pos[order]
            terms = _column(t, "term").cast(pa.binary()).take(pa.array(order))
            cuts = [0, *(np.flatnonzero(np.diff(cell)) + 1).tolist(), len(cell)]
            out = []
            for lo, hi in zip(cuts, cuts[1:]):
                steps = np.diff(rec[lo:hi], prepend=0)  # small but for the first, and so short when compressed
                out.append((grp.dictionary[int(cell[lo] // buckets)].as_py(), int(cell[lo] % buckets), _packed([steps, pos[lo:hi]], terms[lo:hi])))
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out), (pa.string(), pa.int32(), pa.binary()))], names=["grp", "bucket", "body"])

    return run


SUBTREES = "grp string, prefix binary, n long, body binary, records long"


def _once(rec: np.ndarray, pos: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(records, keys) in the order of records, rows delivered again left out."""
    order = np.lexsort((pos, rec))
    rec, pos, keys = rec[order], pos[order], keys[order]
    beside = (rec[1:] == rec[:-1]) & (pos[1:] == pos[:-1]) & (pos[1:] >= 0)
    if not beside.any():
        return rec, keys
    # Only rows of one position need their terms compared.
    some = np.flatnonzero(np.append(beside, False) | np.append(False, beside))
    keys[some] = keys[some][np.lexsort((keys[some], pos[some], rec[some]))]
    keep = np.append(True, ~(beside & (keys[1:] == keys[:-1])))
    return rec[keep], keys[keep]


def _subtrees(group: str | None, trie: BurstTrie, long: dict[bytes, bytes], short: int) -> Iterator[tuple]:
    """Rows of SUBTREES, one a short prefix."""
    leaves = [c for c in trie.leaves() if len(c.terms)]
    if not leaves:
        return
    wide = max(c.terms.dtype.itemsize for c in leaves)
    terms = np.concatenate([c.terms.astype(f"S{wide}") for c in leaves])
    occ, recs = (np.concatenate([getattr(c, f) for c in leaves]) for f in ("occ", "recs"))
    yield from _by_prefix(group, terms, occ, recs, long, short)


def _by_prefix(group: str | None, keys: np.ndarray, occ: np.ndarray, recs: np.ndarray, long: dict[bytes, bytes], size: int) -> Iterator[tuple]:
    """keys in order."""
    head = keys.astype(f"S{size}")
    cuts = [0, *(np.flatnonzero(head[1:] != head[:-1]) + 1).tolist(), len(keys)]
    for lo, hi in zip(cuts, cuts[1:]):
        terms = pa.array([long.get(k[:-1], k[:-1]) for k in keys[lo:hi].tolist()], pa.binary())
        yield group, bytes(head[lo]), hi - lo, _packed([occ[lo:hi], recs[lo:hi]], terms), 0


def _sent(found: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*found), (pa.string(), pa.binary(), pa.int64(), pa.binary(), pa.int64()))], names=["grp", "prefix", "n", "body", "records"])


def _counted(full: int, short: int):
    """Bundles come sorted by group and bucket; a bucket has all rows of its records. Beside the subtrees, a row without a prefix gives
    the number of a group's records."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, bucket, held, long, trie, size, records = None, None, [], {}, None, 0, 0

        def add() -> None:
            nonlocal size, records
            if held:
                opened = [_opened(x) for x in held]
                rec = np.concatenate([np.cumsum(x[0][0]) for x in opened])
                pos = np.concatenate([x[0][1] for x in opened])
                rec, keys = _once(rec, pos, _fast_keys(pa.concat_arrays([x[1] for x in opened]), long))
                trie.add(keys, rec)
                size += len(keys)
                records += 1 + int((rec[1:] != rec[:-1]).sum())
                held.clear()

        def away() -> Iterator[pa.RecordBatch]:
            nonlocal trie, size
            found = [*_subtrees(now[0], trie, long, short)]
            for i in range(0, len(found), 500):
                yield _sent(found[i : i + 500])
            trie, size = BurstTrie(), 0
            long.clear()

        for b in batches:
            for g, k, body in zip(*(b.column(c).to_pylist() for c in ("grp", "bucket", "body"))):
                if now is None or (g,) != now or k != bucket:
                    add()
                    if now is not None and ((g,) != now or size > full):
                        yield from away()
                    if now is not None and (g,) != now:
                        yield _sent([(now[0], None, 0, None, records)])
                    if now is None or (g,) != now:
                        trie, size, records = BurstTrie(), 0, 0
                    now, bucket = (g,), k
                held.append(body)
        add()
        if now is not None:
            yield from away()
            yield _sent([(now[0], None, 0, None, records)])

    return run


def _burst(size: int):
    """Subtrees again by longer prefixes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for g, body in zip(b.column("grp").to_pylist(), b.column("body").to_pylist()):
                (occ, recs), terms = _opened(body)
                long: dict[bytes, bytes] = {}
                keys = _fast_keys(terms, long)
                order = np.argsort(keys, kind="stable")
                found = [*_by_prefix(g, keys[order], occ[order], recs[order], long, size)]
                for i in range(0, len(found), 500):
                    yield _sent(found[i : i + 500])

    return run


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Subtrees come sorted by group and prefix. Tries of like size merge first, so that no entry is merged more than some times."""
    now, waiting, long = None, [], {}

    def take(body: bytes) -> None:
        (occ, recs), terms = _opened(body)
        keys = _fast_keys(terms, long)
        order = np.argsort(keys, kind="stable")
        n, trie = len(keys), BurstTrie.of(keys[order], occ[order], recs[order])
        while waiting and waiting[-1][0] <= n:
            m, other = waiting.pop()
            trie.merge(other)
            n += m
        waiting.append((n, trie))

    def close() -> Iterator[pa.RecordBatch]:
        while len(waiting) > 1:
            n, x = waiting.pop()
            waiting[-1][1].merge(x)
        if waiting:
            yield from _emit(now[0], waiting.pop()[1], long)
        long.clear()

    for b in batches:
        for g, prefix, body in zip(*(b.column(c).to_pylist() for c in ("grp", "prefix", "body"))):
            if now is not None and (g, prefix) != now:
                yield from close()
            now = (g, prefix)
            take(body)
    if now is not None:
        yield from close()


def _emit(group: str | None, trie: BurstTrie, long: dict[bytes, bytes]) -> Iterator[pa.RecordBatch]:
    for c in trie.leaves():
        if len(c.terms):
            terms = [long.get(t[:-1], t[:-1]) for t in c.terms.tolist()]
            yield pa.record_batch([pa.array([group] * len(terms), pa.string()), pa.array(terms, pa.binary()).cast(pa.string()), pa.array(c.occ, pa.int64()), pa.array(c.recs, pa.int64())], names=["grp", "term", "occurrences", "records"])


def _adapted(subtrees: DataFrame, parts: int, size: int) -> DataFrame:
    """Subtrees whose prefix has more than a quarter of a worker's share of all entries are cut by prefixes twice as long, and so on.

    There are 4 x parts such prefixes at most, which is what is sent to all."""
    sums = subtrees.groupBy("grp", "prefix").agg(F.sum("n").alias("n"))
    share = max(1, (sums.agg(F.sum("n")).first()[0] or 0) // (4 * parts))
    while True:
        hot = sums.where((F.col("n") > share) & (F.length("prefix") == size)).select(F.col("grp").alias("g"), F.col("prefix").alias("p"))
        if hot.isEmpty():
            return subtrees
        same = F.col("grp").eqNullSafe(F.col("g")) & (F.col("prefix") == F.col("p"))
        size *= 2
        longer = subtrees.join(F.broadcast(hot), same, "left_semi").mapInArrow(_burst(size), SUBTREES)
        subtrees = durable(subtrees.join(F.broadcast(hot), same, "left_anti").unionByName(longer), "subtrees")
        sums = subtrees.groupBy("grp", "prefix").agg(F.sum("n").alias("n"))


def counted(rows: DataFrame, term: str, record: str, group: str, position: str | None = None, chunk: int = CHUNK, full: int = FULL, short: int = SHORT) -> tuple[DataFrame, DataFrame]:
    """((grp, term, occurrences, records) for every distinct term of every group, (grp, records) of every group). record must be a bigint."""
    parts = shuffle_partitions(rows.sparkSession)
    pos: Column = F.coalesce(F.col(position).cast("long"), F.lit(-1)) if position else F.lit(-1)
    base = rows.where(F.col(term).isNotNull() & F.col(record).isNotNull()).select(F.col(group).cast("string").alias("grp"), F.col(record).cast("long").alias("record"), pos.cast("long").alias("pos"), F.col(term).alias("term"))
    bundles = base.mapInArrow(_bundled(FINE * parts, chunk), "grp string, bucket int, body binary").repartition(parts, "bucket").sortWithinPartitions("grp", "bucket")
    found = durable(bundles.mapInArrow(_counted(full, short), SUBTREES), "subtrees")
    totals = found.where(F.col("prefix").isNull()).groupBy("grp").agg(F.sum("records").alias("records"))
    subtrees = _adapted(found.where(F.col("prefix").isNotNull()), parts, short)
    routed = subtrees.select("grp", "prefix", "body").repartition(parts, "grp", "prefix").sortWithinPartitions("grp", "prefix")
    return routed.mapInArrow(_merged, "grp string, term string, occurrences long, records long"), totals


def term_counts(rows: DataFrame, term: str, record: str, group: str, position: str | None = None) -> DataFrame:
    """The first of counted()."""
    return counted(rows, term, record, group, position)[0]
