"""Problem 9: repetition inside a single document.

Two operators. `repeated_share` gives the wanted result: the share of a document's words that lie in a run of `size`
neighbouring words which occurs at least twice in that document. It needs no shuffle: each document is numbered word by
word, and runs of words are numbered by doubling (the number of a run of 2w words is the pair of the numbers of its
halves), so that runs compare exactly, whole texts at a time and in n log n.

`line_frequency` is the named method: normalised lines are hashed, distinct documents are counted per line and host, lines
above the limit are removed, and documents of which too little is left are rejected. It looks across documents and says
nothing about repetition within one, so the found cases cannot come from it; it is offered beside the other.

Defined cases: null, empty and blank texts have no words, a share of 0 and no repetition; texts with fewer words than
`size` have none either; repeated rows give repeated answers; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftloom.operators import hot
from siftloom.session import durable


def _numbered(pairs: np.ndarray) -> np.ndarray:
    return np.unique(pairs, return_inverse=True)[1].astype(np.int64)


def repeated_words(ids: np.ndarray, size: int) -> int:
    """How many words lie in a run of `size` words that occurs twice at least, overlaps included."""
    n = len(ids)
    if n <= size:
        return 0
    # Runs of w words as numbers; a run of any size is two overlapping runs of the largest power of two below it.
    w, run = 1, ids.astype(np.int64)
    while w * 2 <= size:
        run = _numbered(run[:-w] * (int(run.max()) + 1) + run[w:])
        w *= 2
        if w < size and int(run.max()) + 1 == len(run):
            return 0  # all runs differ, and longer ones all the more
    if w < size:
        m = n - size + 1
        run = _numbered(run[:m] * (int(run.max()) + 1) + run[size - w : size - w + m])
    twice = np.bincount(run)[run] > 1
    if not twice.any():
        return 0
    edge = np.zeros(n + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + size, -1)
    return int((np.cumsum(edge[:n]) > 0).sum())


def _measured(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            total, repeated = [], []
            for text in b.column(1).cast(pa.binary()).to_pylist():
                # bytes.split() parts at exactly space, tab, LF, CR, FF and VT.
                found = text.split() if text else []
                numbers: dict[bytes, int] = {}
                ids = np.fromiter((numbers.setdefault(x, len(numbers)) for x in found), np.int64, len(found))
                total.append(len(found))
                repeated.append(repeated_words(ids, size))
            yield pa.record_batch([b.column(0), pa.array(total, pa.int64()), pa.array(repeated, pa.int64())], names=["doc_id", "words", "repeated"])

    return run


def repeated_share(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 8) -> DataFrame:
    """(doc_id, words, repeated, share) for every row."""
    measured = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(_measured(size), "doc_id long, words long, repeated long")
    return measured.withColumn("share", F.when(F.col("words") > 0, F.round(F.col("repeated") / F.col("words"), 6)).otherwise(0.0))


def normalised_line(line: Column) -> Column:
    """Lower case, digits as 0, blanks joined and trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(line), "[0-9]+", "0"), "[ \\t\\f\\x0B\\r]+", " "))


def line_frequency(documents: DataFrame, host: Column, doc_id: str = "doc_id", text: str = "text", limit: int = 20, keep: float = 0.5) -> DataFrame:
    """(doc_id, lines, removed, share_left, rejected) for every row: lines that stand in more than `limit` documents of the
    same host are removed, and a document with less than the part `keep` of its lines left is rejected.

    A null host is a host of its own. A host with a third of all rows is no hot group, as lines are counted by (host, line),
    in two steps, the first of them before the shuffle. A line that a third of all documents have is one, when documents ask
    whether their lines are common; it is spread over salts by document."""
    base = documents.select(F.col(doc_id).cast("long").alias("doc_id"), host.alias("host"), F.col(text).alias("text"))
    lines = base.select("doc_id", "host", F.explode(F.split(F.coalesce("text", F.lit("")), "\\r\\n|\\r|\\n")).alias("line")).select("doc_id", "host", normalised_line(F.col("line")).alias("line")).where(F.col("line") != "")
    hashed = lines.select("doc_id", F.xxhash64(F.coalesce("host", F.lit("\x00")), "line").alias("h"))
    each = hashed.groupBy("doc_id", "h").agg(F.count(F.lit(1)).alias("n"))
    common = durable(each.groupBy("h").agg(F.count(F.lit(1)).alias("docs")).where(F.col("docs") > limit), "lines")
    gone = common.select("h", F.lit(True).alias("gone"))
    marked = hot.joined(each, gone, "h", ["doc_id"], hot.hot_keys(common, "h", "docs"), "left").groupBy("doc_id").agg(F.sum("n").alias("lines"), F.sum(F.when(F.col("gone"), F.col("n")).otherwise(0)).alias("removed"))
    out = base.select("doc_id").join(marked, "doc_id", "left").select("doc_id", F.coalesce("lines", F.lit(0)).alias("lines"), F.coalesce("removed", F.lit(0)).alias("removed"))
    left = F.when(F.col("lines") > 0, F.round(1 - F.col("removed") / F.col("lines"), 6)).otherwise(0.0)
    return out.withColumn("share_left", left).withColumn("rejected", (F.col("lines") > 0) & (F.col("share_left") < keep))
