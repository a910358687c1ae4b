"""Configuration codes, profiles, bins and hash ranks."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Base-3 codes of four levels: 0 to 80, the first level least significant.
CODES = 81


def level(code: Column, place: int) -> Column:
    """The level (0 to 2) at ``place`` 0 to 3 of a code; null for codes outside 0 to 80."""
    digit = F.pmod(F.floor(code / 3**place), F.lit(3)).cast("int")
    return F.when(code.between(0, CODES - 1), digit)


def levels(code: Column) -> Column:
    """All four levels of a code as an array (i, j, k, l): X has (i, j), Y has (k, l)."""
    return F.when(code.between(0, CODES - 1), F.array(*(F.pmod(F.floor(code / 3**p), F.lit(3)).cast("int") for p in range(4))))


def profile(first: Column, second: Column) -> Column:
    """Index 0 to 8 of two levels."""
    return (first * 3 + second).cast("int")


def profile_difference(endowed: Column, offered: Column) -> Column:
    """Eight numbers, one for each profile but the first: 1 for the endowed one, -1 for the offered one."""
    return F.transform(F.sequence(F.lit(1), F.lit(8)), lambda p: (endowed == p).cast("int") - (offered == p).cast("int"))


def bin_of(value: Column, edges: Sequence[float], closed: str = "left") -> Column:
    """Number of the bin that holds ``value``: [a, b) with closed 'left', (a, b] with 'right'; null outside.

    The last edge may be infinite. Edges ascend.
    """
    if closed not in ("left", "right"):
        raise ValueError("closed is 'left' or 'right'")
    out = None
    for i, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
        inside = (value >= a) & (value < b) if closed == "left" else (value > a) & (value <= b)
        out = F.when(inside, i) if out is None else out.when(inside, i)
    return out


def magnitude_label(delta: Column, edges: Sequence[float] = (0.5, 1.0, 2.0)) -> Column:
    """Label of |delta| in bins closed on the left: '<0.5', '0.5-1', ... '>=2'."""
    size, text = F.abs(delta), [f"{e:g}" for e in edges]
    out = F.when(size < edges[0], f"<{text[0]}")
    for a, b, x, y in zip(edges[:-1], edges[1:], text[:-1], text[1:], strict=True):
        out = out.when((size >= a) & (size < b), f"{x}-{y}")
    return out.when(size >= edges[-1], f">={text[-1]}")


def stratum(delta: Column, edges: Sequence[float] = (0.5, 1.0, 2.0)) -> Column:
    """'sign|bin' of a delta; the sign is '+' above 0, else '-'."""
    return F.concat_ws("|", F.when(delta > 0, "+").otherwise("-"), magnitude_label(delta, edges))


def hash_rank_key(*parts: Column | str | int) -> Column:
    """SHA-256 in hex of the parts joined by colons; its order is that of the digests."""
    return F.sha2(F.concat_ws(":", *(p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts)), 256)


def hash_uniform(*parts: Column | str | int) -> Column:
    """A whole number 0 to 2**32 - 1 from the parts: the counter-based generator of the resampling operators."""
    text = F.concat_ws(":", *(p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def hash_draw(n: Column | int, *parts: Column | str | int) -> Column:
    """A draw 0 to n - 1 by the counter-based generator."""
    n = n if isinstance(n, Column) else F.lit(n)
    return F.floor(hash_uniform(*parts) * n / F.lit(2**32)).cast("long")


_SINES = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
_TURNS = [r[i % 4] for r in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for i in range(16)]
_WORDS = [(i, (5 * i + 1) % 16, (3 * i + 5) % 16, 7 * i % 16)[i // 16] for i in range(64)]
_AT_ONCE = 65_536


def _md5_heads(words: list) -> np.ndarray:
    """The first eight hex digits, as numbers, of the MD5 of messages of one block; a word is a number or an array."""
    many = next(len(w) for w in words if isinstance(w, np.ndarray))
    a, b, c, d = (np.full(many, x, np.uint32) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476))
    f, turned = np.empty(many, np.uint32), np.empty(many, np.uint32)
    for i in range(61):  # the last three steps do not reach the first word
        if i < 16:
            np.bitwise_xor(c, d, out=f)
            f &= b
            f ^= d
        elif i < 32:
            np.bitwise_xor(b, c, out=f)
            f &= d
            f ^= c
        elif i < 48:
            np.bitwise_xor(b, c, out=f)
            f ^= d
        else:
            np.invert(d, out=f)
            f |= b
            f ^= c
        f += a
        word = words[_WORDS[i]]
        if isinstance(word, np.ndarray):
            f += word
            f += np.uint32(_SINES[i])
        elif (_SINES[i] + word) & 0xFFFFFFFF:
            f += np.uint32((_SINES[i] + word) & 0xFFFFFFFF)
        np.left_shift(f, np.uint32(_TURNS[i]), out=turned)
        f >>= np.uint32(32 - _TURNS[i])
        f |= turned
        f += b
        a, b, c, d, f = d, f, b, c, a
    return (b + np.uint32(0x67452301)).byteswap()


def hash_uniforms(prefix: str, begin: int, end: int) -> Iterator[np.ndarray]:
    """``hash_uniform`` of the text ``prefix`` with each whole number of [begin, end) at its end, _AT_ONCE at a time."""
    head = prefix.encode()
    while begin < end:
        digits = len(str(begin))
        size, stop = len(head) + digits, min(end, 10**digits, begin + _AT_ONCE)
        if size > 55:
            raise ValueError("the text is longer than one block")
        block = bytearray(64)
        block[: len(head)], block[size], block[56:60] = head, 0x80, (8 * size).to_bytes(4, "little")
        words: list = [int.from_bytes(block[4 * k : 4 * k + 4], "little") for k in range(16)]
        rest = np.arange(begin, stop, dtype=np.uint32 if stop <= 2**32 else np.uint64)
        for at in range(size - 1, len(head) - 1, -1):
            tens = rest // 10
            digit, rest = (rest - tens * 10).astype(np.uint32) + np.uint32(48), tens
            words[at // 4] = words[at // 4] + (digit << np.uint32(8 * (at % 4)))
        yield _md5_heads([w if isinstance(w, np.ndarray) else int(w) for w in words])
        begin = stop
