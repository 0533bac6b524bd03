"""Digests: of arrays of 32-bit floats, from the bytes that they have in memory, and of many numbers at once."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import sin

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def float32_bits(value: Column) -> Column:
    """The IEEE 754 single precision bits of a float as a number from 0 to 2^32 - 1 (every NaN as the quiet one)."""
    x = value.cast("float")
    a = F.abs(x.cast("double"))
    near = F.floor(F.log2(a))
    power = F.pow(F.lit(2.0), near)
    exponent = F.greatest(F.when(a < power, near - 1).when(a >= 2 * power, near + 1).otherwise(near), F.lit(-126))
    fraction = (a * F.pow(F.lit(2.0), 23 - exponent)).cast("bigint")
    size = F.when(F.isnan(x), 0x7FC00000).when(a == float("inf"), 0x7F800000).when(a == 0, 0).otherwise((exponent + 126) * (1 << 23) + fraction)
    negative = ~F.isnan(x) & x.cast("string").startswith("-")
    return size + F.when(negative, 1 << 31).otherwise(0)


def float32_hex(value: Column) -> Column:
    """The four bytes of a float in little-endian order, as eight hexadecimal digits."""
    bits = float32_bits(value)
    return F.concat(*[F.lpad(F.hex(F.shiftright(bits, 8 * k).bitwiseAND(255)), 2, "0") for k in range(4)])


def array_digest(values: Column, shape: Column) -> Column:
    """SHA-1 of the shape's text and the little-endian bytes of an array of floats (a missing one counts as NaN)."""
    data = F.unhex(F.array_join(F.transform(values, lambda v: float32_hex(F.coalesce(v.cast("float"), F.lit(float("nan")).cast("float")))), ""))
    return F.sha1(F.concat(F.encode(shape, "UTF-8"), data))


def matrix_shape(rows: Column, columns: Column) -> Column:
    """How a shape of two sides is written: `(rows, columns)`."""
    return F.concat(F.lit("("), rows.cast("string"), F.lit(", "), columns.cast("string"), F.lit(")"))


# The rounds of MD5 (RFC 1321).
MD5_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
MD5_TURNS = [t for turns in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for t in turns * 4]
MD5_WORDS = [*range(16), *((5 * i + 1) % 16 for i in range(16)), *((3 * i + 5) % 16 for i in range(16)), *(7 * i % 16 for i in range(16))]
MD5_ADDED = [int(abs(sin(i + 1)) * 2**32) for i in range(64)]
DIGITS, PIECE = 5, 25_000  # last digits that are worked out side by side, numbers at once
_LEFT, _RIGHT = ([np.array(t if left else 32 - t, dtype=np.uint32) for t in MD5_TURNS] for left in (True, False))
_WRITTEN: dict[int, np.ndarray] = {}  # numbers with that many digits as text, a byte each


def _written(digits: int) -> np.ndarray:
    if digits not in _WRITTEN:
        at = np.arange(10**digits, dtype=np.uint64)
        _WRITTEN[digits] = sum(((at // np.uint64(10 ** (digits - 1 - j)) % np.uint64(10) + np.uint64(48)) << np.uint64(8 * j) for j in range(digits)), np.uint64(0))
    return _WRITTEN[digits]


def _md5_first_words(words: list[int | np.ndarray], n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first two words of the digests of n messages of one block; a word is a number where all have the same."""
    a, b, c, d = (np.full(n, v, dtype=np.uint32) for v in MD5_START)
    f = np.empty(n, dtype=np.uint32)
    for i in range(64):
        if i < 16:
            np.bitwise_xor(c, d, out=f), np.bitwise_and(f, b, out=f), np.bitwise_xor(f, d, out=f)
        elif i < 32:
            np.bitwise_xor(b, c, out=f), np.bitwise_and(f, d, out=f), np.bitwise_xor(f, c, out=f)
        elif i < 48:
            np.bitwise_xor(b, c, out=f), np.bitwise_xor(f, d, out=f)
        else:
            np.invert(d, out=f), np.bitwise_or(f, b, out=f), np.bitwise_xor(f, c, out=f)
        word, same = words[MD5_WORDS[i]], MD5_ADDED[i]
        if isinstance(word, int):
            same = (same + word) & 0xFFFFFFFF
        else:
            np.add(a, word, out=a)
        np.add(a, f, out=a), np.add(a, np.uint32(same), out=a)
        np.left_shift(a, _LEFT[i], out=f), np.right_shift(a, _RIGHT[i], out=a)
        np.bitwise_or(a, f, out=a), np.add(a, b, out=a)
        a, b, c, d = d, a, b, c
    return a + np.uint32(MD5_START[0]), b + np.uint32(MD5_START[1])


def md5_heads(prefix: str, start: int, stop: int) -> Iterator[np.ndarray]:
    """The first 48 bits of the MD5 of `prefix` + number, for the numbers from start to stop - 1 in order, in pieces."""
    while start < stop:
        size = len(str(start))
        digits = min(size, DIGITS)
        scale = 10**digits
        first = start % scale
        last = min(first + PIECE, scale, first + stop - start)
        text = prefix.encode() + (str(start // scale).encode() if size > digits else b"")
        if len(text) + digits > 55:  # of more than one block
            at = (hashlib.md5(prefix.encode() + str(i).encode()).digest()[:6] for i in range(start, start + last - first))
            yield np.array([int.from_bytes(d, "big") for d in at], dtype=float)
        else:
            end = len(text) + digits
            block = text.ljust(end, b"\0") + b"\x80" + bytes(55 - end) + (8 * end).to_bytes(8, "little")
            words = [int.from_bytes(block[i:i + 4], "little") for i in range(0, 64, 4)]
            at, shift = divmod(len(text), 4)
            long = (_written(digits)[first:last] << np.uint64(8 * shift)) + np.uint64(words[at] + (words[at + 1] << 32))
            words[at:at + 2] = long.astype(np.uint32), (long >> np.uint64(32)).astype(np.uint32)
            a, b = _md5_first_words(words, last - first)
            yield a.byteswap().astype(float) * 65536.0 + b.astype(np.uint16).byteswap()
        start += last - first
