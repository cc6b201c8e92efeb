"""Hashes of word shingles and the bits that most of them set."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import xxhash

#: byte -> its eight bits, each in a byte lane of a 64-bit word, lowest bit in the lowest lane
LANES = np.array([sum(((b >> i) & 1) << (8 * i) for i in range(8)) for b in range(256)], dtype=np.uint64)


def shingle_hashes(text: str | None, words: int, seed: int) -> list[int]:
    """XXH64 of every word shingle, repeats included; A-Z is lower-cased and words end at ASCII white space."""
    parts = text.encode().lower().split() if text else []
    if not parts:
        return []
    line = b" ".join(parts)
    if len(parts) <= words:
        return [xxhash.xxh64_intdigest(line, seed)]
    ends = np.cumsum([len(p) + 1 for p in parts]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest = xxhash.xxh64_intdigest
    return [digest(line[a:b], seed) for a, b in zip(starts[: len(parts) - words + 1].tolist(), ends[words - 1 :].tolist(), strict=True)]


def majority(hashes: Sequence[Sequence[int]]) -> np.ndarray:
    """For each row the 64 bits that over half of its hashes set, as int64; 0 for a row without hashes."""
    counts = np.array([len(h) for h in hashes], dtype=np.int64)
    out = np.zeros(len(counts), dtype=np.uint64)
    filled = np.flatnonzero(counts)
    if not len(filled):
        return out.view(np.int64)
    flat = np.array([x for h in hashes for x in h], dtype=np.uint64)
    n = counts[filled]
    first = np.concatenate([[0], np.cumsum(n)[:-1]])
    blocks = -(-n // 255)  # a byte lane holds counts up to 255
    row = np.repeat(np.arange(len(n)), blocks)
    block_first = np.concatenate([[0], np.cumsum(blocks)[:-1]])
    starts = first[row] + 255 * (np.arange(len(row)) - block_first[row])
    set_bits = np.empty((len(n), 64), dtype=np.int64)
    octets = flat.view(np.uint8).reshape(-1, 8)
    for k in range(8):
        sums = np.add.reduceat(LANES[octets[:, k]], starts)
        set_bits[:, 8 * k : 8 * k + 8] = np.add.reduceat(sums.view(np.uint8).reshape(-1, 8), block_first, axis=0, dtype=np.int64)
    bits = (2 * set_bits > n[:, None]).astype(np.uint8)
    out[filled] = np.packbits(bits, axis=1, bitorder="little").view(np.uint64).ravel()
    return out.view(np.int64)
