"""Words, shingles and hashes of whole Arrow batches of texts, as flat numpy arrays.

Words are the runs ``[^\\x20\\x09-\\x0D]+``. All sums are modulo 2**64. Texts are UTF-8; a null text is empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: A-Z to a-z, all other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Bytes that are no letter: those below 0x80 but A-Z and a-z.
NOT_LETTER = np.arange(256) < 0x80
NOT_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = False

#: Bytes of text that one step handles; its arrays take some thirty times as much.
CHUNK_BYTES = 500_000
_STEPS = [0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3]
#: Added to a block of eight bytes for each place that it stands further on.
_PLACE = 0x9E3779B97F4A7C15
#: The bytes of a block that belong to a run of 0 to 8 more bytes.
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose every output bit depends on every input bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def chunks(batch: pa.RecordBatch, column: str = "text", most: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Parts of a batch with their bytes and offsets [n + 1]; each of ``most`` bytes at most, or of a single text."""
    texts = batch.column(batch.schema.get_field_index(column)).cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64, count=len(texts) + 1 + texts.offset)[texts.offset :] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2], dtype=np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1)
        to = min(to, len(texts))
        yield batch.slice(at, to - at), data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def words(data: np.ndarray, offsets: np.ndarray, between: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte, end and text number of each word: the longest runs of bytes that are not ``between``."""
    inside = np.zeros(len(data) + 2, dtype=bool)
    inside[1:-1] = ~between[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    starts = np.flatnonzero(inside[1:-1] & (~inside[:-2] | edge[:-1]))
    ends = np.flatnonzero(inside[1:-1] & (~inside[2:] | edge[1:])) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run of bytes: a sum over its blocks of eight bytes, each mixed with its place before it is added.

    Mixing comes before the sum, so no structure of the bytes carries over to it. Two different runs are equal by chance
    alone, once in 2**64 pairs.
    """
    size = ends - starts
    padded = np.zeros(len(data) + 8, dtype=np.uint8)
    padded[: len(data)] = data
    eight = np.ndarray(len(data) + 1, dtype="<u8", buffer=padded, strides=(1,))
    total = np.zeros(len(size), dtype=np.uint64)
    at, left, which, place = starts, size, np.arange(len(size)), np.uint64(0)
    wide = size > 64
    if wide.any():  # long runs all at once; short ones block by block
        blocks = (size[wide] + 7) // 8
        first = np.cumsum(blocks) - blocks
        inner = np.arange(int(blocks.sum())) - np.repeat(first, blocks)
        x = eight[np.repeat(starts[wide], blocks) + 8 * inner] & _FIRST[np.minimum(np.repeat(size[wide], blocks) - 8 * inner, 8)]
        total[wide] = np.add.reduceat(mix(x + (inner.astype(np.uint64) + np.uint64(1)) * np.uint64(_PLACE)), first)
        at, left, which = starts[~wide], size[~wide], which[~wide]
    while len(which):
        place += np.uint64(1)
        with np.errstate(over="ignore"):
            total[which] += mix((eight[at] & _FIRST[np.minimum(left, 8)]) + place * np.uint64(_PLACE))
        more = left > 8
        at, left, which = at[more] + 8, left[more] - 8, which[more]
    return mix(total + size.astype(np.uint64) * np.uint64(_STEPS[0]))


def shingles(word_hash: np.ndarray, word_text: np.ndarray, k: int = 5, short: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, text number and first word of each run of k words; with ``short``, fewer words make one run of all."""
    n = len(word_hash)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    full = max(0, n - k + 1)
    at = np.flatnonzero(word_text[:full] == word_text[k - 1 :]) if full else np.zeros(0, np.int64)
    value = np.zeros(len(at), dtype=np.uint64)
    for j in range(k):
        value += word_hash[at + j] * np.uint64(_STEPS[j % len(_STEPS)] + 2 * (j // len(_STEPS)))
    value, owner = mix(value), word_text[at]
    if short:
        firsts = np.flatnonzero(np.r_[True, word_text[1:] != word_text[:-1]])
        counts = np.diff(np.r_[firsts, n])
        few = counts < k
        if few.any():
            firsts, counts = firsts[few], counts[few]
            rest = np.zeros(len(firsts), dtype=np.uint64)
            for j in range(k - 1):
                has = counts > j
                rest[has] += word_hash[firsts[has] + j] * np.uint64(_STEPS[j % len(_STEPS)])
            rest = mix(rest + counts.astype(np.uint64))
            value, owner, at = np.r_[value, rest], np.r_[owner, word_text[firsts]], np.r_[at, firsts]
            order = np.argsort(owner, kind="stable")
            value, owner, at = value[order], owner[order], at[order]
    return value, owner, at


def by_hash(value: np.ndarray) -> np.ndarray:
    """Places of the hashes so that equal ones are adjacent, each run in its first order."""
    at = np.arange(len(value), dtype=np.uint64)
    low = np.uint64((1 << max(1, int(len(value)).bit_length())) - 1)
    order = (np.sort((value & ~low) | at) & low).astype(np.int64)  # far faster than a stable sort
    found = value[order]
    if (((found[1:] & ~low) == (found[:-1] & ~low)) & (found[1:] != found[:-1])).any():
        return np.argsort(value, kind="stable")
    return order


def runs_of(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The runs of bytes as a string array."""
    size = ends - starts
    to = np.r_[0, np.cumsum(size)]
    at = np.arange(int(to[-1])) + np.repeat(starts - to[:-1], size)
    return pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(to.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data[at])))


def bounds(owner: np.ndarray, texts: int) -> np.ndarray:
    """Offsets [texts + 1] of each text's part in an array ordered by text number."""
    return np.searchsorted(owner, np.arange(texts + 1))


def distinct(value: np.ndarray, owner: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct values in ascending order, and their offsets [texts + 1]."""
    at = bounds(owner, texts)
    parts, ends = [], np.zeros(texts + 1, dtype=np.int64)
    for i in range(texts):
        part = np.unique(value[at[i] : at[i + 1]]) if at[i + 1] > at[i] else value[:0]
        parts.append(part)
        ends[i + 1] = ends[i] + len(part)
    return (np.concatenate(parts) if parts else value[:0]), ends


def lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte, end and text number of each piece of the texts split at ``\\n``; an empty text has one piece."""
    cuts = np.flatnonzero(data == 10)
    owner = np.searchsorted(offsets, cuts, side="right") - 1
    starts = np.r_[offsets[:-1], cuts + 1]
    ends = np.r_[offsets[1:], cuts]
    text = np.r_[np.arange(len(offsets) - 1), owner]
    starts_order = np.lexsort((starts, text))
    ends_order = np.lexsort((ends, text))
    return starts[starts_order], ends[ends_order], text[starts_order]
