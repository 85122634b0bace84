"""Order-dependent folds over filters, in parallel.

Conservative counters and slot mutations depend on the order of insertions, and through shared slots each element depends
on nearly all before it, so a flat filter can only be folded in one task. A blocked filter splits its slots into blocks
and keeps all slots of an element in one of them, chosen by hash: blocks share nothing and are folded side by side, each
in the given order. One block is the flat layout."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftloom.functions import hashing
from siftloom.session import shuffle_partitions


#: Slots of a block: what one fold holds, whatever the size of the filter.
SLOTS = 1 << 13


def number(m: int | Column) -> int | Column:
    """How many blocks a filter of m slots has."""
    if isinstance(m, int):
        return max(1, m // SLOTS)
    return F.greatest(F.floor(m / SLOTS).cast("bigint"), F.lit(1).cast("bigint"))


def placed(rows: DataFrame, element: str, m: int | Column, h: int | Column, blocks: int | Column, family: str = hashing.DEFAULT) -> DataFrame:
    """Adds hashes, block and slots: the h positions of the element, all in its block."""
    hashed = rows.withColumn("hashes", hashing.hashes(F.col(element).cast("string"), h, family))
    return hashed.withColumns({"block": hashing.block_of(F.col("hashes")[0], blocks), "slots": hashing.placed(F.col("hashes"), m, blocks)})


def folded(rows: DataFrame, key: list[str], order: list[str], columns: list[str], fold: Callable[[], object], schema: str) -> DataFrame:
    """Runs one fold a key over its rows in order. A fold has step(values of columns) and rows(), the output for the key,
    each row with the values of the key first."""
    fields = rows.sparkSession.createDataFrame([], schema).schema
    names, arrow = fields.names, [_arrow(f.dataType.simpleString()) for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(found: list[tuple]) -> pa.RecordBatch:
            return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*found), arrow)], names=names)

        now, state, found = None, None, []
        for b in batches:
            keys = [*zip(*(b.column(c).to_pylist() for c in key))]
            for k, values in zip(keys, zip(*(b.column(c).to_pylist() for c in columns))):
                if state is None or k != now:
                    if state is not None:
                        found += [(*now, *r) for r in state.rows()]
                    now, state = k, fold()
                    if len(found) > 20_000:
                        yield out(found)
                        found = []
                state.step(*values)
        if state is not None:
            found += [(*now, *r) for r in state.rows()]
        for i in range(0, len(found), 20_000):
            yield out(found[i : i + 20_000])

    kept = rows.select(*dict.fromkeys([*key, *order, *columns]))
    return kept.repartition(shuffle_partitions(rows.sparkSession), *key).sortWithinPartitions(*key, *order).mapInArrow(run, schema)


def _arrow(kind: str) -> pa.DataType:
    if kind.startswith("array<"):
        return pa.list_(_arrow(kind[6:-1]))
    return {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "double": pa.float64()}[kind]
