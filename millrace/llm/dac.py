"""Directly addressable codes: a file format for token ids with random access.

An id is cut into chunks of 8 bits.  Level 0 has the lowest chunk of every id;
a bitmap says which ids continue, and level k + 1 has the next chunk of those
alone.  The continuation bitmap carries a rank directory, the number of set bits
before each 512-bit block, so token i is found by one rank a level, and no block
is decoded.

File: magic, lengths, document ids and token offsets, then each level's chunks,
bitmap words and rank directory, all little-endian.
"""

from __future__ import annotations

import struct

import numpy as np

MAGIC = b"MDAC1\0\0\0"
CHUNK = 8
BLOCK = 512


def pack(doc_ids: np.ndarray, offsets: np.ndarray, ids: np.ndarray) -> bytes:
    """A file of the ids of documents; ``offsets`` has each document's first token and the end."""
    parts, rest = [], ids.astype(np.uint32)
    while True:
        more = rest >> np.uint32(CHUNK)
        going = more > 0
        last = not going.any()
        bits = np.zeros(-(-len(rest) // BLOCK) * BLOCK if not last else 0, bool)
        if not last:
            bits[: len(rest)] = going
        words = np.packbits(bits, bitorder="little").view(np.uint64)
        ranks = np.zeros(len(bits) // BLOCK + 1, np.uint32)
        np.cumsum(bits.reshape(-1, BLOCK).sum(1), out=ranks[1:])
        chunks = (rest & np.uint32(0xFF)).astype(np.uint8)
        parts.append((chunks, words, ranks))
        if last:
            break
        rest = more[going]
    head = struct.pack("<8sQQQ", MAGIC, len(doc_ids), len(ids), len(parts)) + b"".join(struct.pack("<QQQ", *(len(x) for x in p)) for p in parts)
    return head + doc_ids.astype("<i8").tobytes() + offsets.astype("<i8").tobytes() + b"".join(x.tobytes() for p in parts for x in p)


class Reader:
    """Reads a file made by :func:`pack`."""

    def __init__(self, data: bytes):
        magic, docs, self.tokens, levels = struct.unpack_from("<8sQQQ", data)
        if magic != MAGIC:
            raise ValueError("not a file of directly addressable codes")
        sizes = [struct.unpack_from("<QQQ", data, 32 + 24 * k) for k in range(levels)]
        at = 32 + 24 * levels

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, kind, count, at)
            at += out.nbytes
            return out

        self.doc_ids, self.offsets = take("<i8", docs), take("<i8", docs + 1)
        self.levels = [(take("u1", c), take("<u8", w), take("<u4", r)) for c, w, r in sizes]

    def __getitem__(self, i: int) -> int:
        """Token i, by one rank a level."""
        value = 0
        for k, (chunks, words, ranks) in enumerate(self.levels):
            value |= int(chunks[i]) << (CHUNK * k)
            if not len(words):
                break
            word, bit = divmod(i, 64)
            if not int(words[word]) >> bit & 1:
                break
            block = i // BLOCK
            before = words[block * (BLOCK // 64) : word]
            i = int(ranks[block]) + int(np.bitwise_count(before).sum()) + (int(words[word]) & ((1 << bit) - 1)).bit_count()
        return value

    def slice(self, lo: int, hi: int) -> np.ndarray:
        """Tokens lo to hi - 1; each level is read from the rank of the first to that of the last."""
        out = np.zeros(hi - lo, np.uint32)
        where = np.arange(hi - lo)
        for k, (chunks, words, ranks) in enumerate(self.levels):
            out[where] |= chunks[lo:hi].astype(np.uint32) << np.uint32(CHUNK * k)
            if not len(words) or lo >= hi:
                break
            first, end = lo // 64, -(-hi // 64)
            bits = np.unpackbits(words[first:end].view(np.uint8), bitorder="little")[lo - first * 64 : hi - first * 64].astype(bool)
            block = lo // BLOCK
            before = int(ranks[block]) + int(np.bitwise_count(words[block * (BLOCK // 64) : first]).sum())
            word, bit = divmod(lo, 64)
            before += (int(words[word]) & ((1 << bit) - 1)).bit_count() if bit else 0
            lo, hi, where = before, before + int(bits.sum()), where[bits]
        return out

    def document(self, k: int) -> np.ndarray:
        """The tokens of the k-th document."""
        return self.slice(int(self.offsets[k]), int(self.offsets[k + 1]))
