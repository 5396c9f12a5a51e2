"""CRC-32 of many byte spans at once by a position table.

Up to a constant that only depends on its length, the checksum of a span is the exclusive or of what each byte adds,
and what a byte adds depends on the byte and its distance from the span's end alone.  So the bytes of all spans are
looked up in one table and folded with ``bitwise_xor.reduceat``; a span longer than the table is cut into blocks
counted from its end, whose sums are folded in pairs: the earlier one is moved on by the length of the later one.
"""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np

#: Distances in the table, and bytes that are looked up at a time.
WIDTH = 64
AT_ONCE = 1 << 20


@lru_cache(maxsize=1)
def _table() -> np.ndarray:
    """What a byte adds, at ``distance * 256 + byte``."""
    zero = zlib.crc32(b"\0")
    step = np.array([zlib.crc32(bytes([byte])) ^ zero for byte in range(256)], np.uint32)
    rows = [step]
    for _ in range(WIDTH - 1):
        rows.append(_one_on(rows[-1], step))
    return np.concatenate(rows)


def _one_on(sums: np.ndarray, step: np.ndarray) -> np.ndarray:
    return (sums >> np.uint32(8)) ^ step[sums & np.uint32(255)]


@lru_cache(maxsize=64)
def _moves(level: int) -> np.ndarray:
    """How each byte of a sum moves on by ``WIDTH * 2**level`` bytes: four tables of 256."""
    basis = np.concatenate([np.arange(256, dtype=np.uint32) << np.uint32(8 * place) for place in range(4)])
    if level:
        return _moved(_moved(basis, level - 1), level - 1)
    step = _table()[:256]
    for _ in range(WIDTH):
        basis = _one_on(basis, step)
    return basis


def _moved(sums: np.ndarray, level: int) -> np.ndarray:
    moves, byte = _moves(level), np.uint32(255)
    out = moves[sums & byte]
    for place in (1, 2, 3):
        out = out ^ moves[256 * place + ((sums >> np.uint32(8 * place)) & byte)]
    return out


def _length_constants(lengths: np.ndarray) -> np.ndarray:
    different, place = np.unique(lengths, return_inverse=True)
    return np.array([zlib.crc32(bytes(int(n))) for n in different], np.uint32)[place]


def _block_sums(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of blocks of 1 to ``WIDTH`` bytes."""
    table, lengths = _table(), ends - starts
    until = np.cumsum(lengths)
    before = until - lengths
    places = np.arange(until[-1]) + np.repeat(starts - before, lengths)
    distance = np.repeat(ends - 1, lengths) - places
    return np.bitwise_xor.reduceat(table[(distance << 8) + data[places]], before)


def crc32_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-32 of ``data[start:end]`` for each pair of places; spans may overlap and may be empty.

    Memory grows with the number of spans and blocks, not with the bytes that overlapping spans share.
    """
    starts, ends = np.asarray(starts, np.int64), np.asarray(ends, np.int64)
    lengths = ends - starts
    out = np.zeros(len(starts), np.uint32)
    if not len(starts):
        return out
    blocks = -(-lengths // WIDTH)
    owner = np.repeat(np.arange(len(starts)), blocks)
    if len(owner):
        place = np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        block_end = ends[owner] - place * WIDTH
        block_start = np.maximum(starts[owner], block_end - WIDTH)
        until = np.cumsum(block_end - block_start)
        edges = [0, *np.searchsorted(until, np.arange(AT_ONCE, until[-1], AT_ONCE)).tolist(), len(owner)]
        sums = np.concatenate([
            _block_sums(data, block_start[a:b], block_end[a:b]) for a, b in zip(edges, edges[1:], strict=False) if b > a
        ])
        level = 0
        while place.any():
            later = (place & 1) == 1
            sums[later] = _moved(sums[later], level)
            pairs = np.flatnonzero(~later)
            sums, owner, place, level = np.bitwise_xor.reduceat(sums, pairs), owner[pairs], place[pairs] >> 1, level + 1
        out[owner] = sums
    return out ^ _length_constants(lengths)
