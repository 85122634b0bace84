"""Filter files: a line with the magic, a TOML table, a closing line, then the raw payload.

The payload of a bit filter is its bytes, lowest bit first; that of a counting filter its counters, little-endian. Payloads
travel as rows of CHUNK bytes at most, and each task writes or reads its own chunks at their places, so that nothing passes the
driver and nothing holds a whole filter."""

from __future__ import annotations

import os
import struct
import tomllib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftloom.functions import hashing
from siftloom.operators import bloom

#: Fixed values of the format: keys and closing line. The magic names a table, and any is read.
HEADER_END = "[HeaderEnd]"
BIT_KEYS = ("KmerSize", "HashNum", "BloomFilterSize", "BloomFilterSizeInBytes", "dFPR", "nEntry", "Entry")
COUNTING_KEYS = ("BitsPerCounter", "KmerSize", "HashNum", "BloomFilterSize", "BloomFilterSizeInBytes")
BIT_MAGIC, COUNTING_MAGIC = "BitFilter_v1", "CountingFilter_v1"

CHUNK = 4096


@dataclass
class Header:
    magic: str
    values: dict
    offset: int


def read_header(path: str) -> Header:
    """Raises ValueError where the file has no header, lacks a key or has a payload of another size."""
    with open(path, "rb") as f:
        head = f.read(1 << 16)
    end = head.find(HEADER_END.encode() + b"\n")
    if end < 0 or not head.startswith(b"["):
        raise ValueError(f"{path}: no filter header")
    tables = tomllib.loads(head[:end].decode("utf-8"))
    magic, values = next(iter(tables.items()))
    offset = end + len(HEADER_END) + 1
    keys = COUNTING_KEYS if "BitsPerCounter" in values else BIT_KEYS
    if missing := [k for k in keys if k not in values]:
        raise ValueError(f"{path}: header lacks {', '.join(missing)}")
    if os.path.getsize(path) - offset != values["BloomFilterSizeInBytes"]:
        raise ValueError(f"{path}: payload of {os.path.getsize(path) - offset} bytes, header says {values['BloomFilterSizeInBytes']}")
    return Header(magic, values, offset)


def _write(path: str, head: bytes, chunks: DataFrame, size: int) -> None:
    """Header, then the payload of so many bytes, of which chunks (chunk, data) holds those that are not all zero. The file is made
    at its whole length beside its path; tasks write their own chunks into it, again if they are run again, and it takes its name
    at the end. The path must be one that all executors see."""
    draft = f"{path}.{uuid.uuid4().hex}"
    with open(draft, "wb") as f:
        f.write(head)
        f.truncate(len(head) + size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0
        with open(draft, "r+b") as f:
            for b in batches:
                for i, data in zip(b.column(0).to_pylist(), b.column(1)):
                    at = i * CHUNK
                    f.seek(len(head) + at)
                    n += f.write(data.as_buffer()[: max(0, min(CHUNK, size - at))])
        yield pa.record_batch([pa.array([n], pa.int64())], names=["n"])

    chunks.select("chunk", "data").mapInArrow(run, "n long").agg(F.sum("n")).collect()
    os.replace(draft, path)


def _head(magic: str, values: dict) -> bytes:
    return "\n".join([f"[{magic}]", *(f"{k} = {float(v) if k == 'dFPR' else int(v)}" for k, v in values.items()), HEADER_END, ""]).encode()


def _buckets(packed: DataFrame) -> DataFrame:
    return packed.select(F.col("bucket").alias("chunk"), F.col("bitmap").alias("data"))


def _numbers(rows: DataFrame, at: str, value: str, width: int) -> DataFrame:
    """(chunk, data) of numbers of so many bytes by their place; those that are not named are zero."""
    per = CHUNK // width

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(1)
            flat, sizes = lists.flatten(), np.asarray(lists.value_lengths())
            data = np.zeros((b.num_rows, per), f"<u{width}")
            data[np.repeat(np.arange(b.num_rows), sizes), flat.field("at").to_numpy()] = flat.field("v").to_numpy().astype(f"<u{width}")
            yield pa.record_batch([b.column(0), pa.array([x.tobytes() for x in data], pa.binary())], names=["chunk", "data"])

    chunks = rows.groupBy(F.expr(f"{at} div {per}").alias("chunk")).agg(F.collect_list(F.struct((F.col(at) % per).alias("at"), F.col(value).alias("v"))).alias("x"))
    return chunks.mapInArrow(run, "chunk long, data binary")


def write_bit_filter(path: str, packed: DataFrame, m: int, h: int, k: int, fpr: float = 0.0, distinct: int = 0, inserted: int = 0, magic: str = BIT_MAGIC) -> None:
    """packed: (bucket, bitmap) of one filter. m must be a multiple of 8."""
    if m <= 0 or m % 8:
        raise ValueError("the size of a bit filter is a positive multiple of 8")
    values = dict(zip(BIT_KEYS, (k, h, m, m // 8, fpr, distinct, inserted)))
    _write(path, _head(magic, values), _buckets(packed), m // 8)


def write_counting_filter(path: str, counters: DataFrame, m: int, h: int, k: int, bits: int = 8, magic: str = COUNTING_MAGIC) -> None:
    """counters: (pos, cnt) of one filter. The true width is written."""
    if bits not in (8, 16, 32, 64):
        raise ValueError("counters have 8, 16, 32 or 64 bits")
    width = bits // 8
    values = dict(zip(COUNTING_KEYS, (bits, k, h, m, m * width)))
    _write(path, _head(magic, values), _numbers(counters, "pos", "cnt", width), m * width)


def _chunks(spark: SparkSession, path: str, offset: int, size: int) -> DataFrame:
    """(chunk, data): the payload by chunks, each read by the task that wants it. The path must be one that all executors see."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with open(path, "rb") as f:
            for b in batches:
                ids = b.column(0).to_pylist()
                data = []
                for i in ids:
                    f.seek(offset + i * CHUNK)
                    data.append(f.read(min(CHUNK, size - i * CHUNK)))
                yield pa.record_batch([b.column(0), pa.array(data, pa.binary())], names=["chunk", "data"])

    return spark.range((size + CHUNK - 1) // CHUNK).mapInArrow(run, "chunk long, data binary")


def read_bit_filter(spark: SparkSession, path: str) -> tuple[dict, DataFrame]:
    """The header's values and (bucket, bitmap), with full last buckets; buckets without a bit are left out."""
    head = read_header(path)
    raw = _chunks(spark, path, head.offset, head.values["BloomFilterSizeInBytes"])
    buckets = raw.select(F.col("chunk").alias("bucket"), F.rpad("data", F.lit(CHUNK), F.lit(b"\x00")).alias("bitmap"))
    return head.values, buckets.where(F.bitmap_count("bitmap") > 0)


def read_raw_filter(spark: SparkSession, path: str, m: int) -> DataFrame:
    """(bucket, bitmap) of a payload without header; its size must be m / 8 bytes."""
    if os.path.getsize(path) != m // 8:
        raise ValueError(f"{path}: {os.path.getsize(path)} bytes, wanted {m // 8}")
    raw = _chunks(spark, path, 0, m // 8)
    return raw.select(F.col("chunk").alias("bucket"), F.rpad("data", F.lit(CHUNK), F.lit(b"\x00")).alias("bitmap")).where(F.bitmap_count("bitmap") > 0)


def write_raw_filter(path: str, packed: DataFrame, m: int) -> None:
    _write(path, b"", _buckets(packed), m // 8)


def read_counting_filter(spark: SparkSession, path: str, bits: int | None = None) -> tuple[dict, DataFrame]:
    """The header's values and (pos, cnt) of the counters that are not zero. bits: the wanted width, checked."""
    head = read_header(path)
    width = head.values["BitsPerCounter"] // 8
    if bits and bits != head.values["BitsPerCounter"]:
        raise ValueError(f"{path}: counters of {head.values['BitsPerCounter']} bits, wanted {bits}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for chunk, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                values = np.frombuffer(data, f"<u{width}")
                at = np.flatnonzero(values)
                yield pa.record_batch([pa.array(chunk * (CHUNK // width) + at, pa.int64()), pa.array(values[at].astype(np.int64))], names=["pos", "cnt"])

    return head.values, _chunks(spark, path, head.offset, head.values["BloomFilterSizeInBytes"]).mapInArrow(run, "pos long, cnt long")


#: The packed header of a multi-index data file.
INDEX_HEADER = struct.Struct("<8sIQIII")
INDEX_MAGIC, INDEX_VERSION = b"MIBLOOMF", 1


def read_index_header(path: str) -> dict:
    """Header and spaced seeds of a multi-index data file; its rank side file is a foreign format and is not read."""
    with open(path, "rb") as f:
        magic, length, size, hashes, kmer, version = INDEX_HEADER.unpack(f.read(INDEX_HEADER.size))
        if magic != INDEX_MAGIC or version != INDEX_VERSION:
            raise ValueError(f"{path}: no multi-index file of version {INDEX_VERSION}")
        n = (length - INDEX_HEADER.size) // kmer if kmer else 0
        seeds = [f.read(kmer).decode("ascii") for _ in range(n)]
    return {"size": size, "HashNum": hashes, "KmerSize": kmer, "seeds": seeds, "offset": length}


def write_index_file(path: str, values: DataFrame, size: int, h: int, k: int, seeds: list[str] | None = None, bits: int = 32) -> None:
    """values: (rank, raw). Header, seeds, then `size` values of so many bits."""
    width = bits // 8
    head = INDEX_HEADER.pack(INDEX_MAGIC, INDEX_HEADER.size + sum(map(len, seeds or [])), size, h, k, INDEX_VERSION) + "".join(seeds or []).encode()
    low = values.select("rank", F.col("raw").bitwiseAND(F.lit(hashing.signed((1 << bits) - 1)).cast("bigint")).alias("raw"))
    _write(path, head, _numbers(low, "rank", "raw", width), size * width)


def write_index(path: str, slots: DataFrame, m: int, h: int, k: int, seeds: list[str] | None = None, bits: int = 32) -> None:
    """slots: (pos, rank, raw). The values in one file, the bit vector beside it in another, without a header."""
    write_raw_filter(f"{path}.bits", bloom.packed(slots), (m + 7) // 8 * 8)
    write_index_file(path, slots.select("rank", "raw"), slots.count(), h, k, seeds, bits)


def read_index(spark: SparkSession, path: str, bits: int = 32) -> tuple[dict, DataFrame]:
    """The header, with m, and (pos, rank, raw): positions and ranks from the bit vector's file, values from the other."""
    from siftloom.operators import multiindex

    head = read_index_header(path)
    m = os.path.getsize(f"{path}.bits") * 8
    ranked = multiindex.ranks(bloom.unpacked(read_raw_filter(spark, f"{path}.bits", m)))
    return head | {"m": m}, ranked.join(read_index_values(spark, path, bits), "rank")


def read_index_values(spark: SparkSession, path: str, bits: int = 32) -> DataFrame:
    """(rank, raw) of a multi-index data file."""
    head, width = read_index_header(path), bits // 8

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for chunk, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                values = np.frombuffer(data, f"<u{width}")
                yield pa.record_batch([pa.array(chunk * (CHUNK // width) + np.arange(len(values)), pa.int64()), pa.array(values.astype(np.int64))], names=["rank", "raw"])

    return _chunks(spark, path, head["offset"], head["size"] * width).mapInArrow(run, "rank long, raw long")
