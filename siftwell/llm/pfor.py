"""Patched frame-of-reference files of token ids.

A shard holds the ids of consecutive documents in blocks of 128.  A block keeps
its minimum; differences from it are packed at the width that a given share of
them fits (a percentile); the others are exceptions, kept whole in a list after
the packed bits.  An index has the place where each block starts, so that any
range of ids can be read without the rest.

    magic "SWPF1\\0", version u16 | n_docs u64 | n_ids u64 | block size u32 | n_blocks u32
    doc_id i64[n_docs] (0 where null), null flags u8[n_docs], n_tokens u32[n_docs]
    start u64[n_blocks + 1]           (index of blocks, in bytes of the payload)
    base u32[n_blocks], width u8[n_blocks], n_exceptions u8[n_blocks]
    payload: for each block ceil(128 * width / 8) bytes of low bits, lowest first,
             then the exceptions' positions u8[] and differences u32[]

The last block is filled up with its first id.  All numbers are little-endian.
"""

from __future__ import annotations

import struct

import numpy as np

MAGIC, BLOCK, PERCENTILE = b"SWPF1\0", 128, 90
#: Ids packed or unpacked at a time, whole blocks of them: unpacking takes 50 to 100 bytes for each.
RANGE = 1 << 18
HEAD = struct.Struct("<6sHQQII")


def widths_of(top: np.ndarray) -> np.ndarray:
    """Bits that hold each number."""
    return np.where(top > 0, np.floor(np.log2(np.maximum(top, 1).astype(np.float64))).astype(np.int64) + 1, 0)


def blocks(ids: np.ndarray, percentile: int = PERCENTILE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes of each block, base, width, number of exceptions, payload) of ids that fill whole blocks."""
    rows = ids.reshape(-1, BLOCK)
    base = rows.min(1)
    diff = rows - base[:, None]
    rank = min(BLOCK - 1, BLOCK * percentile // 100)
    width = widths_of(np.partition(diff, rank, 1)[:, rank])
    over = diff.astype(np.int64) >> width[:, None] > 0
    n_over = over.sum(1)
    sizes = BLOCK * width // 8 + 5 * n_over
    payload = np.empty(int(sizes.sum()), np.uint8)
    begin = np.cumsum(sizes) - sizes
    for w in np.unique(width):
        of = np.flatnonzero(width == w)
        if w:
            size = 2 if w <= 16 else 4
            bits = np.unpackbits(diff[of].astype(f"<u{size}").view(np.uint8).reshape(len(of), BLOCK, size), axis=2, bitorder="little")
            packed = np.packbits(bits[:, :, :w].reshape(len(of), -1), axis=1, bitorder="little")
            payload[begin[of][:, None] + np.arange(packed.shape[1])] = packed
    block, at = np.nonzero(over)
    nth = np.arange(len(block)) - np.repeat(np.cumsum(n_over) - n_over, n_over)
    tail = begin + BLOCK * width // 8
    payload[tail[block] + nth] = at
    values = np.ascontiguousarray(diff[block, at], "<u4").view(np.uint8).reshape(-1, 4)
    payload[(tail + n_over)[block][:, None] + 4 * nth[:, None] + np.arange(4)] = values
    return sizes, base, width, n_over, payload


def encode(doc_ids: list[int | None], counts: np.ndarray, ids: np.ndarray, percentile: int = PERCENTILE) -> bytes:
    """A shard's bytes; ``RANGE`` ids are packed at a time."""
    ids = np.ascontiguousarray(ids, np.uint32)
    nb = -(-len(ids) // BLOCK)
    parts = []
    for at in range(0, len(ids), RANGE):
        some = ids[at : at + RANGE]
        if fill := -len(some) % BLOCK:
            some = np.concatenate([some, np.full(fill, some[len(some) - len(some) % BLOCK], np.uint32)])
        parts.append(blocks(some, percentile))
    sizes, base, width, n_over = (np.concatenate([p[k] for p in parts]) if parts else np.empty(0, np.int64) for k in range(4))
    start = np.zeros(nb + 1, np.uint64)
    np.cumsum(sizes, out=start[1:], dtype=np.uint64)
    return b"".join([
        HEAD.pack(MAGIC, 1, len(doc_ids), len(ids), BLOCK, nb),
        np.array([x or 0 for x in doc_ids], "<i8").tobytes(), np.array([x is None for x in doc_ids], np.uint8).tobytes(), np.asarray(counts, "<u4").tobytes(),
        start.astype("<u8").tobytes(), base.astype("<u4").tobytes(), width.astype(np.uint8).tobytes(), n_over.astype(np.uint8).tobytes(), *(p[4].tobytes() for p in parts),
    ])


class Shard:
    """Reads a shard's bytes; ``ids(a, b)`` unpacks the blocks of that range only."""

    def __init__(self, data: bytes):
        magic, version, docs, self.n, self.block, nb = HEAD.unpack_from(data)
        if magic != MAGIC or version != 1:
            raise ValueError("not a shard of token ids")
        at = HEAD.size

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            got = np.frombuffer(data, kind, n, at)
            at += got.nbytes
            return got

        ids, nulls = take("<i8", docs), take("u1", docs)
        self.doc_ids = [None if z else int(x) for x, z in zip(ids, nulls, strict=True)]
        self.counts = take("<u4", docs)
        self.start, self.base, self.width, self.n_over = take("<u8", nb + 1).astype(np.int64), take("<u4", nb), take("u1", nb).astype(np.int64), take("u1", nb).astype(np.int64)
        self.payload = np.frombuffer(data, np.uint8, offset=at)
        if len(self.payload) != (self.start[-1] if nb else 0):
            raise ValueError("the shard is cut short")

    def ranges(self, a: int = 0, b: int | None = None):
        """The ids from a to b, ``RANGE`` at a time."""
        b = self.n if b is None else min(b, self.n)
        while a < b:
            to = min(b, (a // RANGE + 1) * RANGE)
            yield self.ids(a, to)
            a = to

    def ids(self, a: int = 0, b: int | None = None) -> np.ndarray:
        b = self.n if b is None else min(b, self.n)
        if a >= b:
            return np.empty(0, np.uint32)
        first, last = a // self.block, -(-b // self.block)
        width, begin, n_over = self.width[first:last], self.start[first:last], self.n_over[first:last]
        out = np.zeros((last - first, self.block), np.uint32)
        for w in np.unique(width):
            of = np.flatnonzero(width == w)
            if w:
                packed = self.payload[begin[of][:, None] + np.arange(self.block * w // 8)]
                bits = np.unpackbits(packed, axis=1, bitorder="little").reshape(len(of), self.block, w)
                size = 2 if w <= 16 else 4
                wide = np.zeros((len(of), self.block, 8 * size), np.uint8)
                wide[:, :, :w] = bits
                out[of] = np.packbits(wide, axis=2, bitorder="little").view(f"<u{size}")[:, :, 0]
        block = np.repeat(np.arange(last - first), n_over)
        nth = np.arange(len(block)) - np.repeat(np.cumsum(n_over) - n_over, n_over)
        tail = begin + self.block * width // 8
        at = self.payload[tail[block] + nth]
        raw = self.payload[(tail + n_over)[block][:, None] + 4 * nth[:, None] + np.arange(4)]
        out[block, at] = np.ascontiguousarray(raw).view("<u4").ravel()
        out += self.base[first:last, None]
        return out.ravel()[a - first * self.block : b - first * self.block]
