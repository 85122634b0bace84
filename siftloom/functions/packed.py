"""k-mers as words of two bits a letter, their md5, and arrays as bytes; numpy over whole batches.

A word holds 31 letters at most, the first one highest, so words stand in the order of their texts."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa

from siftloom.functions import hashing

LETTERS = np.frombuffer(b"ACGT", np.uint8)
_CODE = np.full(256, 4, np.uint8)
_CODE[LETTERS] = np.arange(4)
#: Letters of the words by whose hashes windows are kept together.
SHORT = 11
#: Words hashed in one step, so that their columns stay in a core's cache.
STEP = 1 << 14


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of integers as bytes: the lowest bytes of all, then the next ones, as many as the largest needs. Shuffles compress what is alike."""
    out = [np.array([len(arrays)], "<u8").tobytes()]
    for a in arrays:
        a = np.ascontiguousarray(a).astype("<u8", copy=False)
        planes = -(-int(a.max()).bit_length() // 8) if len(a) else 0
        out += [np.array([len(a), planes], "<u8").tobytes(), np.ascontiguousarray(a.view(np.uint8).reshape(-1, 8)[:, :planes].T).tobytes()]
    return b"".join(out)


def unpack(data: bytes) -> list[np.ndarray]:
    """The arrays, unsigned."""
    raw, at, out = np.frombuffer(data, np.uint8), 8, []
    for _ in range(int(raw[:8].view("<u8")[0])):
        n, planes = (int(x) for x in raw[at : at + 16].copy().view("<u8"))
        wide = np.zeros((n, 8), np.uint8)
        wide[:, :planes] = raw[at + 16 : at + 16 + n * planes].reshape(planes, n).T
        out.append(wide.view("<u8").reshape(-1))
        at += 16 + n * planes
    return out


def compressed(*parts: bytes) -> bytes:
    """Each with a code of its own for its bytes, by how often they come; shuffles do not."""
    small = [pa.Codec("zstd").compress(x, asbytes=True) for x in parts]
    return b"".join(len(n).to_bytes(4, "little") for x in zip(parts, small) for n in x) + b"".join(small)


def expanded(data: bytes, parts: int = 1) -> list[bytes]:
    sizes, out, at = np.frombuffer(data, "<u4", 2 * parts).tolist(), [], 8 * parts
    for n, size in zip(sizes[::2], sizes[1::2]):
        out.append(pa.Codec("zstd").decompress(data[at : at + size], n, asbytes=True))
        at += size
    return out


def differences(a: np.ndarray) -> np.ndarray:
    """The first value and the steps between the others, for ascending ones."""
    a = a.astype(np.int64, copy=False).view(np.uint64)
    return np.diff(a, prepend=np.uint64(0))


def summed(a: np.ndarray) -> np.ndarray:
    """What differences() was taken of."""
    return np.cumsum(a, dtype=np.uint64)


def squeezed(text: bytes) -> bytes:
    """A, C, G, T as two bits each, and the places of other letters."""
    code = _CODE[np.frombuffer(text, np.uint8)]
    four = np.zeros((-(-len(code) // 4), 4), np.uint8)
    four.reshape(-1)[: len(code)] = code & 3
    return pack(np.array([len(code)]), differences(np.flatnonzero(code > 3)), four[:, 0] << 6 | four[:, 1] << 4 | four[:, 2] << 2 | four[:, 3])


def spread(data: bytes) -> bytes:
    """The text of squeezed(), other letters as N."""
    n, other, four = unpack(data)
    text = LETTERS[(four.astype(np.uint8)[:, None] >> np.array([6, 4, 2, 0], np.uint8)) & 3].reshape(-1)[: int(n[0])]
    text[summed(other).astype(np.int64)] = ord("N")
    return text.tobytes()


def windows(text: bytes, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, word, back) of every window of A, C, G and T only: the smaller of the word and its reverse complement, and the larger."""
    if not 0 < k <= 31:
        raise ValueError("a word holds 1 to 31 letters")
    code = _CODE[np.frombuffer(text, np.uint8)]
    if len(code) < k:
        none = np.zeros(0, np.uint64)
        return none.astype(np.int64), none, none
    bad = np.concatenate([[0], np.cumsum(code > 3)])
    start = np.flatnonzero(bad[k:] == bad[:-k])
    one, other = code.astype(np.uint64) & np.uint64(3), np.uint64(3) - (code.astype(np.uint64) & np.uint64(3))
    f, b, done = None, None, 0
    for bit in range(k.bit_length()):  # windows of 1, 2, 4 ... letters, put together to k
        size = 1 << bit
        if k & size:
            if f is None:
                f, b = one, other
            else:
                n = len(one) - done if len(one) - done < len(f) else len(f)
                f, b = f[:n] << np.uint64(2 * size) | one[done : done + n], other[done : done + n] << np.uint64(2 * done) | b[:n]
            done += size
        n = len(one) - size
        if n > 0 and size < k:
            one, other = one[:n] << np.uint64(2 * size) | one[size:], other[size:] << np.uint64(2 * size) | other[:n]
    f, b = f[start], b[start]
    return start, np.minimum(f, b), np.maximum(f, b)


def least(text: bytes, start: np.ndarray, k: int) -> np.ndarray:
    """A number for each window of k letters at start: the smallest hash of its words of SHORT letters, alike for most neighbours
    and for the same window from either strand."""
    short = min(k, SHORT)
    at, word, _ = windows(text, short)
    low, n, width = np.full(max(0, len(text) - short + 1), 0xFFFFFFFF, np.uint32), 1, k - short + 1
    low[at] = (word * np.uint64(hashing.MULTIPLIER) >> np.uint64(32)).astype(np.uint32)
    while 2 * n <= width:
        low, n = np.minimum(low[:-n], low[n:]), 2 * n
    if n < width:
        low = np.minimum(low[: n - width], low[width - n :])
    return low[start]


_TURNS = [7, 12, 17, 22] * 4 + [5, 9, 14, 20] * 4 + [4, 11, 16, 23] * 4 + [6, 10, 15, 21] * 4
_SINES = [np.uint32(int(abs(math.sin(i + 1)) * 2**32) & 0xFFFFFFFF) for i in range(64)]
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)


def _md5(m: np.ndarray) -> list[np.ndarray]:
    """The four words of the digests of messages of one block: m has a row for each of its 16 words."""
    a, b, c, d = (np.full(m.shape[1], x, np.uint32) for x in _START)
    x, y = np.empty_like(a), np.empty_like(a)
    used = [bool(w.any()) for w in m]
    for i in range(64):
        if i < 16:
            np.bitwise_xor(c, d, out=x)
            np.bitwise_and(x, b, out=x)
            np.bitwise_xor(x, d, out=x)
            g = i
        elif i < 32:
            np.bitwise_xor(b, c, out=x)
            np.bitwise_and(x, d, out=x)
            np.bitwise_xor(x, c, out=x)
            g = (5 * i + 1) % 16
        elif i < 48:
            np.bitwise_xor(b, c, out=x)
            np.bitwise_xor(x, d, out=x)
            g = (3 * i + 5) % 16
        else:
            np.invert(d, out=x)
            np.bitwise_or(x, b, out=x)
            np.bitwise_xor(x, c, out=x)
            g = 7 * i % 16
        np.add(x, a, out=x)
        np.add(x, _SINES[i], out=x)
        if used[g]:
            np.add(x, m[g], out=x)
        np.left_shift(x, np.uint32(_TURNS[i]), out=y)
        np.right_shift(x, np.uint32(32 - _TURNS[i]), out=x)
        np.bitwise_or(x, y, out=x)
        np.add(x, b, out=x)
        a, d, c, b, x = d, c, b, x, a  # the old a is free
    return [v + np.uint32(s) for v, s in zip((a, b, c, d), _START)]


def _digests(word: np.ndarray, k: int, prefix: bytes = b"", seed: str | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The 16 bytes of md5 over prefix and text, as two unsigned numbers; letters that a seed leaves out are '-'."""
    if len(prefix) + k > 55:
        raise ValueError("the text is longer than one block")
    high, low = np.empty(len(word), np.uint64), np.empty(len(word), np.uint64)
    for lo in range(0, len(word), STEP):
        w = word[lo : lo + STEP]
        text = np.zeros((64, len(w)), np.uint8)
        text[: len(prefix)] = np.frombuffer(prefix, np.uint8)[:, None]
        for j in range(k):
            text[len(prefix) + j] = LETTERS[(w >> np.uint64(2 * (k - 1 - j))).astype(np.uint8) & np.uint8(3)] if not seed or seed[j] == "1" else ord("-")
        text[len(prefix) + k] = 0x80
        bits = 8 * (len(prefix) + k)
        text[56], text[57] = bits & 255, bits >> 8
        t = text.reshape(16, 4, len(w)).astype(np.uint32)
        a, b, c, d = (x.byteswap().astype(np.uint64) for x in _md5(t[:, 0] | t[:, 1] << np.uint32(8) | t[:, 2] << np.uint32(16) | t[:, 3] << np.uint32(24)))
        high[lo : lo + STEP], low[lo : lo + STEP] = a << np.uint64(32) | b, c << np.uint64(32) | d
    return high, low


def md5_pair(word: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(a, b) of hashing.md5_pair: hash i is a + i b."""
    high, low = _digests(word, k)
    return high >> np.uint64(4), (high & np.uint64(15)) << np.uint64(48) | low >> np.uint64(16) | np.uint64(1)


def seed_hashes(word: np.ndarray, back: np.ndarray, k: int, seeds: list[str]) -> np.ndarray:
    """The hashes of hashing.seeded(): a column a seed."""
    out = np.empty((len(word), len(seeds)), np.uint64)
    for i, s in enumerate(seeds):
        care = np.uint64(sum(3 << 2 * (k - 1 - j) for j, c in enumerate(s) if c == "1"))
        out[:, i] = _digests(np.minimum(word & care, back & care), k, f"{i}:".encode(), s)[0] >> np.uint64(4)
    return out
