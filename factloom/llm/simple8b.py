"""Token-id files: Simple-8b word-aligned coding with escapes and per-block offsets.

File layout, little-endian throughout:

    magic  b"S8BIDS01"
    u64    number of documents, number of ids, number of blocks, number of code words
    u32    number of ids of each document          (documents in ascending order)
    u64    first code word of each block           (a block holds BLOCK ids, the last may hold fewer)
    u64    code words
    u64    number of escaped values, then (u64 position, u64 value) pairs
    u64    code words again and magic backwards    (a file cut short is noticed)

A code word's top 4 bits are a selector, its low 60 bits hold `count` values of `width` bits, the first value lowest.
Code words never cross a block. A value of 2**60 or more is escaped: 0 stands in the code words and the value is listed
with its position. Decoding is vectorised: all words of one selector are unpacked together.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np

MAGIC = b"S8BIDS01"
BLOCK = 1024
#: (values in a word, bits of each) by selector; widths 0 are runs of zeros.
SELECTORS = ((240, 0), (120, 0), (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60))


#: Values packed at once; blocks are independent, so this bounds memory only.
_SLICE = 512 * BLOCK


def pack(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code words, first code word of each block, escapes as rows of position and value) of unsigned 64-bit values."""
    parts, before = [], 0
    for k in range(0, max(1, len(values)), _SLICE):
        words, offsets, escapes = _pack(values[k : k + _SLICE])
        escapes[:, 0] += np.uint64(k)
        parts.append((words, offsets + np.uint64(before), escapes))
        before += len(words)
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _pack(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    v = np.ascontiguousarray(values, np.uint64)
    big = np.flatnonzero(v >> np.uint64(60))
    escapes = np.stack([big.astype(np.uint64), v[big]], 1) if len(big) else np.zeros((0, 2), np.uint64)
    if len(big):
        v = v.copy()
        v[big] = 0
    n = len(v)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), escapes
    best = np.full(n, len(SELECTORS) - 1, np.uint8)
    at = np.arange(n)
    left = np.minimum(BLOCK - at % BLOCK, n - at)  # values up to the end of the block
    narrow, last, most = at, 64, int(v.max())  # places of values of at most `last` bits
    for k in range(len(SELECTORS) - 2, -1, -1):  # the first selector that fits is the last to be set
        count, width = SELECTORS[k]
        if most < 1 << width:
            best[left >= count] = k
            continue
        if width < last:
            last, narrow = width, narrow[v[narrow] < np.uint64(1 << width)]
        if len(narrow) >= count:
            start = narrow[: len(narrow) - count + 1][narrow[count - 1 :] - narrow[: len(narrow) - count + 1] == count - 1]
            best[start[left[start] >= count]] = k
    counts = np.array([c for c, _ in SELECTORS])
    step = counts[best]
    blocks = -(-n // BLOCK)
    cursor = np.arange(blocks) * BLOCK
    ends = np.minimum(cursor + BLOCK, n)
    steps = []
    live = np.arange(blocks)
    while len(live):  # one code word of every block at a time
        here = cursor[live]
        steps.append(here)
        cursor[live] = here + step[here]
        live = live[cursor[live] < ends[live]]
    first = np.sort(np.concatenate(steps))
    chosen = best[first]
    words = chosen.astype(np.uint64) << np.uint64(60)
    for k, (count, width) in enumerate(SELECTORS):
        if width and len(mine := np.flatnonzero(chosen == k)):
            for j in range(count):
                words[mine] |= v[first[mine] + j] << np.uint64(j * width)
    offsets = np.searchsorted(first, np.arange(blocks) * BLOCK).astype(np.uint64)
    return words, offsets, escapes


def unpack(words: np.ndarray, n: int, escapes: np.ndarray) -> np.ndarray:
    """The n values of code words, as unsigned 64-bit."""
    chosen = (words >> np.uint64(60)).astype(np.uint8)
    counts = np.array([c for c, _ in SELECTORS])[chosen]
    start = np.cumsum(counts) - counts
    out = np.zeros(n, np.uint64)
    for k, (count, width) in enumerate(SELECTORS):
        if width and len(mine := np.flatnonzero(chosen == k)):
            mask = np.uint64((1 << width) - 1)
            for j in range(count):
                out[start[mine] + j] = (words[mine] >> np.uint64(j * width)) & mask
    if len(escapes):
        out[escapes[:, 0].astype(np.int64)] = escapes[:, 1]
    return out


def dump(lengths: np.ndarray, values: np.ndarray) -> bytes:
    """A file of documents of the given lengths, whose ids follow one another in values."""
    words, offsets, escapes = pack(values)
    return b"".join(
        [
            MAGIC,
            struct.pack("<4Q", len(lengths), len(values), len(offsets), len(words)),
            np.asarray(lengths, "<u4").tobytes(),
            offsets.astype("<u8").tobytes(),
            words.astype("<u8").tobytes(),
            struct.pack("<Q", len(escapes)),
            escapes.astype("<u8").tobytes(),
            struct.pack("<Q", len(words)),
            MAGIC[::-1],
        ]
    )


class TokenFile:
    """Reads a file's documents, block by block where only some are wanted."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC or data[-8:] != MAGIC[::-1]:
            raise ValueError("not a whole token-id file")
        self.documents, self.ids, blocks, n_words = struct.unpack_from("<4Q", data, 8)
        at = 40
        self.lengths = np.frombuffer(data, "<u4", self.documents, at)
        at += 4 * self.documents
        self.offsets = np.frombuffer(data, "<u8", blocks, at)
        at += 8 * blocks
        self.words = np.frombuffer(data, "<u8", n_words, at)
        at += 8 * n_words
        (n_escapes,) = struct.unpack_from("<Q", data, at)
        self.escapes = np.frombuffer(data, "<u8", 2 * n_escapes, at + 8).reshape(-1, 2)
        if struct.unpack_from("<Q", data, at + 8 + 16 * n_escapes)[0] != n_words:
            raise ValueError("not a whole token-id file")
        self.starts = np.concatenate([[0], np.cumsum(self.lengths, dtype=np.int64)])

    def read(self, start: int, end: int) -> np.ndarray:
        """Ids [start, end) of the file; unpacks only the blocks that hold them."""
        if end <= start:
            return np.zeros(0, np.uint64)
        a, b = start // BLOCK, -(-end // BLOCK)
        low, high = int(self.offsets[a]), int(self.offsets[b]) if b < len(self.offsets) else len(self.words)
        lo, hi = np.searchsorted(self.escapes[:, 0], [a * BLOCK, b * BLOCK]) if len(self.escapes) else (0, 0)
        escapes = self.escapes[lo:hi].copy()
        escapes[:, 0] -= np.uint64(a * BLOCK)
        block = unpack(self.words[low:high], min(b * BLOCK, self.ids) - a * BLOCK, escapes)
        return block[start - a * BLOCK : end - a * BLOCK]

    def document(self, k: int) -> np.ndarray:
        return self.read(int(self.starts[k]), int(self.starts[k + 1]))

    def each(self, at_once: int = 1 << 20) -> Iterator[np.ndarray]:
        """All documents in order, unpacked about at_once ids at a time."""
        k = 0
        while k < self.documents:
            j = max(k + 1, int(np.searchsorted(self.starts, self.starts[k] + at_once, "right")) - 1)
            ids = self.read(int(self.starts[k]), int(self.starts[j]))
            for i in range(k, j):
                yield ids[self.starts[i] - self.starts[k] : self.starts[i + 1] - self.starts[k]]
            k = j


def crc32(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())
