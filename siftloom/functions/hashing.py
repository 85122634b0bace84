"""Hash families and unsigned 64-bit arithmetic on BIGINT columns."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

MASK = (1 << 64) - 1



def _drawn(name: str) -> int:
    """64 bits of our own: the beginning of the SHA-256 of a name."""
    return int.from_bytes(hashlib.sha256(f"siftloom {name}".encode()).digest()[:8], "big")


#: Base seeds of the rotating families, for A, C, G and T. These and the next ones are drawn from names, and equal nobody's
#: published ones; files of other programs need theirs, which are parameters everywhere.
SEEDS = tuple(_drawn(f"base {c}") for c in "ACGT")
#: Seed that derives the further hashes of the XOR family.
VAR_SEED = _drawn("further")
#: Multiplier (odd, so that no bit is lost) and shift that derive the further hashes of the multiplicative family.
MULTIPLIER, SHIFT = _drawn("multiplier") | 1, 29


def signed(x: int) -> int:
    """The BIGINT with the bits of an unsigned value."""
    x &= MASK
    return x - (1 << 64) if x >> 63 else x


def unsigned_mod(h: Column, m: Column | int) -> Column:
    """h modulo m with h read as unsigned; m below 2^62."""
    m = F.lit(m).cast("bigint") if isinstance(m, int) else m.cast("bigint")
    return F.pmod(F.pmod(F.shiftrightunsigned(h, 1), m) * 2 + h.bitwiseAND(F.lit(1).cast("bigint")), m)


def rotate_left(x: Column, r: int) -> Column:
    r %= 64
    return F.shiftleft(x, r).bitwiseOR(F.shiftrightunsigned(x, 64 - r)) if r else x


def unsigned_least(a: Column, b: Column) -> Column:
    flip = F.lit(signed(1 << 63)).cast("bigint")
    return F.when(a.bitwiseXOR(flip) <= b.bitwiseXOR(flip), a).otherwise(b)


def _hex(digits: Column, start: int, n: int) -> Column:
    return F.conv(F.substring(digits, start, n), 16, 10).cast("bigint")


def _each(h: int | Column, value: Callable[[Column], Column]) -> Column:
    """Array of value(i) for i below h. A number unrolls; a column (h differs by row) takes a transform."""
    if isinstance(h, int):
        return F.array(*[value(F.lit(i).cast("bigint")) for i in range(h)])
    return F.transform(F.sequence(F.lit(0).cast("bigint"), h.cast("bigint") - 1), value)


def _md5_parts(x: Column) -> Column:
    """Array of one struct: a, 60 bits of md5 of x, and b, the next 52, made odd. An array, so that both are bound once and the
    digest is not taken again for each hash."""
    return F.transform(F.array(F.md5(x)), lambda d: F.struct(_hex(d, 1, 15).alias("a"), _hex(d, 16, 13).bitwiseOR(F.lit(1).cast("bigint")).alias("b")))


def md5_pair(x: Column, h: int | Column) -> Column:
    """a + i b, double hashing over one md5; the same in any SQL engine with md5. h up to 1,000, so that no sum wraps."""
    return F.transform(_md5_parts(x), lambda p: _each(h, lambda i: p["a"] + i * p["b"]))[0]


def md5_60(x: Column, h: int | Column) -> Column:
    """60 bits of md5 over 'i:x', one digest a hash."""
    return _each(h, lambda i: _hex(F.md5(F.concat(i.cast("string"), F.lit(":"), x)), 1, 15))


def xx64(x: Column, h: int | Column) -> Column:
    """The engine's own 64-bit hash, with i as a second column."""
    return _each(h, lambda i: F.xxhash64(x, i.cast("int")))


FAMILIES: dict[str, Callable[[Column, int | Column], Column]] = {"md5_pair": md5_pair, "md5_60": md5_60, "xx64": xx64}
DEFAULT = "md5_pair"


def seeded(seeds: tuple[str, ...]) -> str:
    """The family of spaced seeds, one hash a seed: k-mers that agree under a seed's care letters agree in its hash."""
    if not seeds or any(not x or set(x) - {"0", "1"} for x in seeds) or len({len(x) for x in seeds}) > 1:
        raise ValueError("spaced seeds are strings of 0 and 1, all of one length")
    return "seeds:" + ",".join(seeds)


def _under(kmer: Column, seed: str) -> Column:
    return F.concat(*[kmer.substr(j + 1, 1) if c == "1" else F.lit("-") for j, c in enumerate(seed)])


def _seed_hashes(seeds: list[str]) -> Callable[[Column, int | Column], Column]:
    def family(x: Column, h: int | Column) -> Column:
        if h != len(seeds):
            raise ValueError(f"{len(seeds)} spaced seeds give as many hashes")
        back = F.reverse(F.translate(x, "ATCG", "TAGC"))
        word = lambda s: F.least(_under(x, s), _under(back, s))
        return F.array(*[_hex(F.md5(F.concat(F.lit(f"{i}:"), word(s))), 1, 15) for i, s in enumerate(seeds)])

    return family


def hashes(x: Column, h: int | Column, family: str = DEFAULT) -> Column:
    """Array of h hash values."""
    if family.startswith("seeds:"):
        return _seed_hashes(family[6:].split(","))(x, h)
    return FAMILIES[family](x, h)


def _bigint(x: Column | int) -> Column:
    return F.lit(x).cast("bigint") if isinstance(x, int) else x.cast("bigint")


def block_of(first: Column, blocks: int | Column) -> Column:
    """The block of an element by the upper bits of its first hash; 2^30 blocks at most."""
    return F.pmod(F.shiftrightunsigned(first, 30), _bigint(blocks))


def placed(values: Column, m: int | Column, blocks: int | Column = 1) -> Column:
    """Array of positions of an array of hashes: all of them lie in one block of m / blocks positions. One block is the flat layout."""
    if isinstance(m, int) and m <= 0:
        raise ValueError("a filter needs a positive size")
    if isinstance(blocks, int) and blocks == 1:
        return F.transform(values, lambda v: unsigned_mod(v, m))
    per = F.greatest(F.floor(_bigint(m) / _bigint(blocks)).cast("bigint"), F.lit(1).cast("bigint"))
    return F.transform(values, lambda v: block_of(values[0], blocks) * per + unsigned_mod(v, per))


def positions(x: Column, m: int | Column, h: int | Column, family: str = DEFAULT, blocks: int | Column = 1) -> Column:
    """Array of h positions below m, in hash order; the same position may come twice."""
    if isinstance(blocks, int) and blocks == 1:
        return placed(hashes(x, h, family), m)
    return F.transform(F.array(hashes(x, h, family)), lambda v: placed(v, m, blocks))[0]


def strand_hashes(kmer: Column, k: int, seeds: tuple[int, ...] = SEEDS) -> tuple[Column, Column, Column]:
    """(forward, reverse, canonical) of a k-mer over A, C, G and T: XOR of its bases' seeds, each rotated by its place.

    The closed form of the rolling recurrence, so that every k-mer stands alone; unrolled, and so within generated code.
    Other letters count as no seed; callers skip such k-mers."""

    def term(base: Column, table: tuple[int, ...], turn: int) -> Column:
        def rotated(s: int) -> Column:
            r = turn % 64
            return F.lit(signed((s << r | s >> (64 - r)) & MASK if r else s)).cast("bigint")

        a, c, g, t = map(rotated, table)
        return F.when(base == "A", a).when(base == "C", c).when(base == "G", g).when(base == "T", t).otherwise(F.lit(0).cast("bigint"))

    complement = (seeds[3], seeds[2], seeds[1], seeds[0])
    forward = reverse = None
    for j in range(k):
        base = F.substring(kmer, j + 1, 1)
        f, r = term(base, seeds, k - 1 - j), term(base, complement, j)
        forward = f if forward is None else forward.bitwiseXOR(f)
        reverse = r if reverse is None else reverse.bitwiseXOR(r)
    return forward, reverse, unsigned_least(forward, reverse)


def xor_hashes(canonical: Column, h: int, var_seed: int = VAR_SEED) -> Column:
    """h values of the XOR family: the rotated seed over the canonical hash."""
    return F.array(*[rotate_left(F.lit(signed(var_seed)).cast("bigint"), i).bitwiseXOR(canonical) for i in range(h)])


@F.pandas_udf(T.ArrayType(T.LongType()))
def _extended(h0: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for base, k, h in h0:
        x = base.to_numpy(np.int64, na_value=0).view(np.uint64)
        n = int(h.max()) if len(h) else 0
        rows = [x.view(np.int64)]
        for i in range(1, n):
            with np.errstate(over="ignore"):
                v = x * (np.uint64(i) ^ k.to_numpy().astype(np.uint64) * np.uint64(MULTIPLIER))
                rows.append((v ^ (v >> np.uint64(SHIFT))).view(np.int64))
        table = np.stack(rows, axis=1)
        yield pd.Series([None if b is None or b != b else t for b, t in zip(base, table)])


def extended_hashes(canonical: Column, k: int, h: int) -> Column:
    """h values of the multiplicative family. Wrapping multiplication is no JVM operation here, hence Arrow batches."""
    return _extended(canonical, F.lit(k), F.lit(h))
