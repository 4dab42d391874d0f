"""Reads as bit planes: the low bits of all bases, their high bits and, where there is an N, a third plane that marks it.

Differing bases of two reads that lie over each other are then counted by a few operations on words of 64 bases.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def packed(codes: np.ndarray) -> np.ndarray:
    """(reads, planes x words) of base codes 0 to 4 of one length."""
    n, length = codes.shape
    width, small = -(-length // 64), codes.astype(np.uint8)
    bits = [small & 1, (small >> 1) & 1, *([small >> 2] if (small > 3).any() else [])]
    out = np.zeros((n, len(bits), width * 8), np.uint8)
    for k, b in enumerate(bits):
        rows = np.packbits(b, axis=1, bitorder="little")
        out[:, k, : rows.shape[1]] = rows
    return out.view(np.uint64).reshape(n, -1)


def binary(words: np.ndarray) -> pa.Array:
    """Rows of words as binary values."""
    n, width = words.shape
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(n + 1, dtype=np.int32) * (8 * width)), pa.py_buffer(np.ascontiguousarray(words))])


def unpacked(values: pa.Array, lengths: np.ndarray) -> np.ndarray:
    """(reads, 3, words) from binary values and the reads' lengths; what a read lacks is 0."""
    n = len(values)
    ends = np.frombuffer(values.buffers()[1], np.int32)[values.offset : values.offset + n + 1].astype(np.int64)
    data = np.frombuffer(values.buffers()[2] or b"", np.uint8)
    sizes, words = np.diff(ends) // 8, -(-lengths.astype(np.int64) // 64)
    out = np.zeros((n, 3, int(words.max(initial=1))), np.uint64)
    for size, width in {*zip(sizes.tolist(), words.tolist(), strict=True)}:
        rows = np.flatnonzero((sizes == size) & (words == width))
        if len(rows) == n:
            got = data[ends[0] : ends[-1]]
        else:
            got = data[(ends[rows][:, None] + np.arange(8 * size)).ravel()]
        out[rows, : size // width, :width] = np.frombuffer(got.tobytes(), np.uint64).reshape(len(rows), -1, width)
    return out


def framed(planes: np.ndarray, lengths: np.ndarray, pos: np.ndarray) -> list[np.ndarray]:
    """Planes and mask moved so that base `pos` of each read lies at one place: arrays (words, reads), the mask last."""
    n, kinds, width = planes.shape
    before = int(pos.max(initial=0))
    wide = -(-(before + int((lengths - pos).max(initial=1))) // 64)
    left = np.clip(lengths.astype(np.int64)[:, None] - 64 * np.arange(width), 0, 64)
    full = ~np.uint64(0)
    mask = np.where(left == 0, np.uint64(0), full >> (64 - left).astype(np.uint64))
    move = before - pos.astype(np.int64)
    q, r = move // 64, (move % 64).astype(np.uint64)
    out = []
    for k in range(kinds + 1):
        own = mask if k == kinds else planes[:, k]
        if k == kinds - 1 and not own.any():
            continue
        rows = np.zeros((n, width + 2), np.uint64)
        rows[:, 1:-1] = own
        moved = np.empty((wide, n), np.uint64)
        for w in range(wide):
            at = np.clip(w - q, -1, width) + 1
            here, behind = np.take_along_axis(rows, at[:, None], 1)[:, 0], np.take_along_axis(rows, np.maximum(at - 1, 0)[:, None], 1)[:, 0]
            behind = np.where(w - q > width, np.uint64(0), behind)
            moved[w] = (here << r) | np.where(r > 0, behind >> (np.uint64(64) - r) % np.uint64(64), np.uint64(0))
        out.append(moved)
    return out


def differing(frames: list[np.ndarray], a: np.ndarray | slice, b: np.ndarray | slice, square: bool = False) -> np.ndarray:
    """Differing bases where reads a and b overlap, pair by pair, or (`square`) of each of a with each of b."""
    total = None
    for w in range(frames[0].shape[0]):
        parts = [(f[w][a][:, None], f[w][b][None, :]) if square else (f[w][a], f[w][b]) for f in frames]
        t = parts[0][0] ^ parts[0][1]
        for x, y in parts[1:-1]:
            t |= x ^ y
        t &= parts[-1][0]
        t &= parts[-1][1]
        c = np.bitwise_count(t)
        total = c.astype(np.uint16) if total is None else np.add(total, c, out=total)
    return total
