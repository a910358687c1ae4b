"""BPE encoding and decoding with a SentencePiece model, by vectorised merge rounds.

The symbols of all distinct words of a chunk lie in one flat array. Each round looks up the rank of every adjacent
pair, finds each word's least rank, merges the leftmost pairs of that rank, and drops the right halves; words whose
pairs have no rank leave. A word's later pairs of the same rank wait for the next round when a merge left of them
brings a pair of the same or a better rank, so the order is that of merging one pair at a time.

Words are cut before each ``▁`` that follows another character: no piece of such a model has a ``▁`` after another
character (checked when the model is read), so no merge crosses the cut.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .text_arrays import chunks, hashes

#: Text bytes a step; the symbols of its distinct words are held at once.
STEP_BYTES = 750_000
_NONE = np.int64(1) << 40


def _fields(data: bytes) -> Iterator[tuple[int, int, bytes | int]]:
    """(number, wire type, value) of each field of a protocol-buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, kind, varint()
        else:
            n = {1: 8, 5: 4}.get(kind) or varint()
            yield tag >> 3, kind, data[at : at + n]
            at += n


class Model:
    """The pieces of a BPE model file, its pair ranks, and what its ids decode to."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            raw = f.read()
        pieces, scores, kinds, prefix, extra, charsmap, fallback = [], [], [], True, True, b"", False
        for number, _, value in _fields(raw):
            if number == 1:
                part = {n: v for n, _, v in _fields(value)}
                pieces.append(part.get(1, b"").decode())
                scores.append(float(np.frombuffer(part.get(2, b"\0\0\0\0"), "<f4")[0]))
                kinds.append(part.get(3, 1))
            elif number == 2:
                spec = {n: v for n, _, v in _fields(value)}
                fallback = bool(spec.get(35, 0))
                if spec.get(3, 1) != 2 or spec.get(24, 0):
                    raise ValueError("only BPE models that mark white space before words are read")
            elif number == 3:
                spec = {n: v for n, _, v in _fields(value)}
                charsmap, prefix, extra = spec.get(2, b""), bool(spec.get(3, 1)), bool(spec.get(4, 1))
        if charsmap or extra or not prefix or not fallback:
            raise ValueError("only models without text normalisation, with a dummy prefix and byte fallback are read")
        if any("▁" in p.lstrip("▁") for p, k in zip(pieces, kinds, strict=True) if k == 1) or 4 in kinds:
            raise ValueError("a piece crosses a word's start, or is user-defined")
        normal = {p: i for i, (p, k) in enumerate(zip(pieces, kinds, strict=True)) if k == 1}
        self.byte = np.zeros(256, dtype=np.int64)
        for i, (p, k) in enumerate(zip(pieces, kinds, strict=True)):
            if k == 6:
                self.byte[int(p[3:-1], 16)] = i
        # symbols: the pieces' ids, then one for each other character that is part of a piece
        parts = dict(normal)
        order = {s: r for r, s in enumerate(sorted({scores[i] for i in normal.values()}, reverse=True))}
        self.pieces = len(pieces)
        for p in normal:
            for c in p:
                parts.setdefault(c, self.pieces + len(parts))
        pairs = {}
        for p, i in normal.items():
            for cut in range(1, len(p)):
                if (a := parts.get(p[:cut])) is not None and (b := parts.get(p[cut:])) is not None:
                    pairs[(a << 20) | b] = (order[scores[i]] << 20) | i
        self.pair = np.array(sorted(pairs), dtype=np.int64)
        self.merged = np.array([pairs[k] for k in self.pair.tolist()], dtype=np.int64)
        # a table by multiplicative hash answers most lookups at once; pairs that lost their slot are searched for
        self.bits = 21
        slot = self._slot(self.pair)
        self.table = np.full(1 << self.bits, -1, dtype=np.int32)
        self.table[slot] = np.arange(len(self.pair))
        self.rest_at = np.flatnonzero(self.table[slot] != np.arange(len(self.pair)))
        self.rest = self.pair[self.rest_at]
        code = np.full(0x110000, -1, dtype=np.int64)
        for c, i in parts.items():
            if len(c) == 1:
                code[ord(c)] = i
        self.code = code
        self.decimal = [str(i) for i in range(self.pieces)]
        self.bytes = [bytes([int(p[3:-1], 16)]) if k == 6 else b"" if k == 3 else " ⁇ ".encode() if k == 2 else p.replace("▁", " ").encode() for p, k in zip(pieces, kinds, strict=True)]

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """rank << 20 | merged id of each pair, or a greater number than any."""
        key = (left << 20) | right
        at = self.table[self._slot(key)]
        hit = (at >= 0) & (self.pair[at] == key)
        out = np.where(hit, self.merged[at], _NONE)
        miss = np.flatnonzero((at >= 0) & ~hit)  # a pair that lost its slot finds it taken
        if len(self.rest) and len(miss):
            where = np.minimum(np.searchsorted(self.rest, key[miss]), len(self.rest) - 1)
            more = self.rest[where] == key[miss]
            out[miss[more]] = self.merged[self.rest_at[where[more]]]
        out[(left < 0) | (right < 0)] = _NONE
        return out

    def merge(self, symbol: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All merges of all words; ``symbol`` < 0 for characters that no piece holds. Both arrays by word."""
        done_symbol, done_word, done_at = [], [], []
        place = np.arange(len(symbol))
        while len(symbol):
            same = word[1:] == word[:-1]
            both = np.full(len(symbol), _NONE)
            at = np.flatnonzero(same)
            both[at] = self.ranks(symbol[at], symbol[at + 1])
            rank = both >> 20
            firsts = np.flatnonzero(np.r_[True, ~same])
            sizes = np.diff(np.r_[firsts, len(symbol)])
            least = np.repeat(np.minimum.reduceat(rank, firsts), sizes)
            over = least >= (_NONE >> 20)
            if over.any():
                done_symbol.append(symbol[over])
                done_word.append(word[over])
                done_at.append(place[over])
                keep = ~over
                symbol, word, place, both, rank, least = symbol[keep], word[keep], place[keep], both[keep], rank[keep], least[keep]
                if not len(symbol):
                    break
            hit = np.flatnonzero(rank == least)
            hit = self._apart(hit)
            hit = self._in_order(hit, symbol, word, both, rank)
            symbol[hit] = both[hit] & 0xFFFFF
            keep = np.ones(len(symbol), dtype=bool)
            keep[hit + 1] = False
            symbol, word, place = symbol[keep], word[keep], place[keep]
        if not done_symbol:
            return symbol, word
        order = np.argsort(np.concatenate(done_at), kind="stable")
        return np.concatenate(done_symbol)[order], np.concatenate(done_word)[order]

    @staticmethod
    def _apart(hit: np.ndarray) -> np.ndarray:
        """Of runs of consecutive pairs (a a a), every other one from the left."""
        start = np.r_[True, hit[1:] != hit[:-1] + 1]
        firsts = np.flatnonzero(start)
        within = np.arange(len(hit)) - np.repeat(firsts, np.diff(np.r_[firsts, len(hit)]))
        return hit[within % 2 == 0]

    def _in_order(self, hit: np.ndarray, symbol: np.ndarray, word: np.ndarray, both: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """The merges of each word up to the first one that brings a pair of the same or a better rank."""
        owner = word[hit]
        again = np.r_[False, owner[1:] == owner[:-1]]
        if not again.any():
            return hit
        new = both[hit] & 0xFFFFF
        last = len(symbol) - 1
        before, after = np.maximum(hit - 1, 0), np.minimum(hit + 2, last)
        left = np.where((hit > 0) & (word[before] == owner), symbol[before], -1)
        touch = np.flatnonzero(np.r_[False, hit[1:] == hit[:-1] + 2] & again)
        left[touch] = new[touch - 1]
        right = np.where((hit + 2 <= last) & (word[after] == owner), symbol[after], -1)
        better = np.minimum(self.ranks(left, new), self.ranks(new, right)) >> 20 <= rank[hit]
        firsts = np.flatnonzero(~again)
        sizes = np.diff(np.r_[firsts, len(hit)])
        seen = np.cumsum(better) - better
        return hit[seen - np.repeat(seen[firsts], sizes) == 0]

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (UTF-8 bytes, offsets [n + 1]) and their offsets [n + 1]."""
        texts = len(offsets) - 1
        lead = np.flatnonzero((data & 0xC0) != 0x80)  # a character's first byte
        if not len(lead):
            return np.zeros(0, np.int64), np.zeros(texts + 1, np.int64)
        points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), dtype="<u4")
        owner = np.searchsorted(offsets, lead, side="right") - 1
        is_space = (points == 32) | (points == 0x2581)
        first = np.r_[True, owner[1:] != owner[:-1]]
        starts = first | (is_space & ~np.r_[False, is_space[:-1]])
        at = np.flatnonzero(starts)  # characters at which a word starts; a text's first word gets a prefix
        word_from, word_to = lead[at], np.r_[lead[at[1:]], len(data)]
        opens = first[at]
        code = hashes(data, word_from, word_to) ^ (opens.astype(np.uint64) * np.uint64(0x5851F42D4C957F2D))
        _, which, back = np.unique(code, return_index=True, return_inverse=True)
        # the distinct words' characters, spaces as ▁, with the prefix of those that open a text
        char_from, char_to = at[which], np.r_[at[1:], len(points)][which]
        sizes = char_to - char_from
        pre = opens[which].astype(np.int64)
        total = sizes + pre
        word = np.repeat(np.arange(len(which)), total)
        begins = np.cumsum(total) - total
        inner = np.arange(len(word)) - np.repeat(begins, total) - np.repeat(pre, total)
        char = np.where(inner < 0, 0x2581, points[np.maximum(np.repeat(char_from, total) + inner, 0)])
        char = np.where(char == 32, 0x2581, char)
        symbol = self.code[char]
        unknown = symbol < 0
        symbol[unknown] = -1 - char[unknown].astype(np.int64)
        symbol, word = self.merge(symbol, word)
        ids, word = self._spell(symbol, word)
        counts = np.bincount(word, minlength=len(which))
        first_id = np.cumsum(counts) - counts
        # back to every word in order
        each = counts[back]
        out = np.repeat(first_id[back] - (np.cumsum(each) - each), each) + np.arange(int(each.sum()))
        ends = np.r_[0, np.cumsum(each)][np.searchsorted(word_from, offsets)]
        return ids[out], ends

    def _spell(self, symbol: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids; a character that is no piece of its own becomes the pieces of its UTF-8 bytes."""
        odd = np.flatnonzero((symbol < 0) | (symbol >= self.pieces))
        if not len(odd):
            return symbol, word
        inner = {i: c for c, i in ((chr(c), self.code[c]) for c in np.flatnonzero(self.code >= self.pieces))} if (symbol[odd] >= 0).any() else {}
        spelt = [self.byte[list((chr(-1 - s) if s < 0 else inner[s]).encode())] for s in symbol[odd].tolist()]
        times = np.ones(len(symbol), dtype=np.int64)
        times[odd] = [len(x) for x in spelt]
        out = np.repeat(symbol, times)
        begins = np.cumsum(times) - times
        for i, x in zip(begins[odd].tolist(), spelt, strict=True):
            out[i : i + len(x)] = x
        return out, np.repeat(word, times)

    def decode(self, ids: list[int]) -> bytes:
        """The text of ids: the first piece's mark is dropped, malformed bytes become U+FFFD."""
        table = self.bytes
        out = b"".join([table[i] for i in ids])
        return out[1:] if ids and table[ids[0]].startswith(b" ") else out

    def digests(self, ids: list[int]) -> tuple[str, str]:
        """SHA-256 of the comma-joined ids, and of the decoded text in UTF-8."""
        text = self.decode(ids).decode("utf-8", errors="replace").encode()
        table = self.decimal
        return hashlib.sha256(",".join([table[i] for i in ids]).encode()).hexdigest(), hashlib.sha256(text).hexdigest()


@lru_cache(maxsize=2)
def model(path: str) -> Model:
    return Model(path)


def encode_documents(docs: DataFrame, path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for each row of ``docs``; with ``with_ids`` also the ids.

    A null or empty text has no tokens. Each row is encoded alone: repeated rows give
    equal results, other columns (null or not) have no effect, an empty table gives no rows.
    ``path`` is the model file; each worker reads it once.
    """
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for batch in batches:
            for part, data, offsets in chunks(batch, most=STEP_BYTES):
                ids, ends = m.encode(data, offsets)
                listed = [ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:], strict=True)]
                pairs = [m.digests(x) for x in listed]
                columns = [part.column(0), pa.array(np.diff(ends), pa.int64()), pa.array([p[0] for p in pairs], pa.string()), pa.array([p[1] for p in pairs], pa.string())]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in schema.split(", ")])

    return docs.selectExpr("cast(doc_id AS long) AS doc_id", "text").mapInArrow(run, schema)


def op7_sentencepiece(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("piece_bpe_32k.model"))
