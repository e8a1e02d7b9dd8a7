"""A static range asymmetric numeral system over token ids, in numpy.

A block is ``LANES`` interleaved states over one frequency table. States are 63 bits with renormalisation by 32-bit words,
so frequencies can sum to 2**20. Blocks are independent: with its place, its number of tokens and its first states a block
can be decoded alone, and many blocks are decoded side by side.
"""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np

SCALE = 20
LANES = 128
_LOW = np.uint64(1 << 31)
_32, _SCALE = np.uint64(32), np.uint64(SCALE)


def quantised(counts: np.ndarray) -> np.ndarray:
    """Frequencies that sum to 2**SCALE; every symbol that occurs has one."""
    total, one = int(counts.sum()), 1 << SCALE
    if not total:
        return np.zeros(len(counts), np.uint32)
    f = np.maximum((counts * (one / total)).astype(np.int64), counts > 0)
    order = np.argsort(-f, kind="stable")
    rest = one - int(f.sum())
    if rest > 0:
        f[order[0]] += rest
    for i in order:
        if rest >= 0:
            break
        take = min(-rest, int(f[i]) - 1)
        f[i] -= take
        rest += take
    return f.astype(np.uint32)


@lru_cache(maxsize=2)
def tables(frequencies: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Frequencies, their sums before each symbol, the symbol of each slot."""
    f = np.frombuffer(frequencies, "<u4").astype(np.uint64)
    return f, np.cumsum(f) - f, np.repeat(np.arange(len(f), dtype=np.uint32), f.astype(np.int64))


def _steps(n: int) -> int:
    return -(-n // LANES)


def _encode(ids: np.ndarray, f: np.ndarray, c: np.ndarray) -> list[bytes]:
    """ids: blocks of equal length as rows."""
    blocks, n = ids.shape
    steps = _steps(n)
    padded = np.zeros((blocks, steps * LANES), ids.dtype)
    padded[:, :n] = ids
    by_step = padded.reshape(blocks, steps, LANES)
    x = np.full((blocks, LANES), _LOW)
    words, used = np.zeros((steps, blocks, LANES), np.uint32), np.zeros((steps, blocks, LANES), bool)
    for t in range(steps - 1, -1, -1):
        lanes = min(LANES, n - t * LANES)
        s = by_step[:, t, :lanes]
        own, before, state = f[s], c[s], x[:, :lanes]
        full = state >= own << np.uint64(63 - SCALE)
        words[t, :, :lanes], used[t, :, :lanes] = state.astype(np.uint32), full
        state = np.where(full, state >> _32, state)
        times = state // own
        x[:, :lanes] = (times << _SCALE) + (state - times * own) + before
    return [x[b].astype("<u8").tobytes() + words[:, b, :][used[:, b, :]].astype("<u4").tobytes() for b in range(blocks)]


def _decode(parts: list[bytes], n: int, f: np.ndarray, c: np.ndarray, symbol: np.ndarray) -> np.ndarray:
    blocks, steps, head = len(parts), _steps(n), 8 * LANES
    x = np.stack([np.frombuffer(p, "<u8", LANES) for p in parts]).astype(np.uint64)
    streams = [np.frombuffer(p, "<u4", offset=head) for p in parts]
    stream = np.concatenate([*streams, np.zeros(1, np.uint32)]).astype(np.uint64)
    place = np.cumsum([0, *map(len, streams)])[:-1]
    out = np.zeros((blocks, steps * LANES), np.uint32)
    mask = np.uint64((1 << SCALE) - 1)
    for t in range(steps):
        lanes = min(LANES, n - t * LANES)
        state = x[:, :lanes]
        slot = state & mask
        s = symbol[slot.astype(np.int64)]
        out[:, t * LANES : t * LANES + lanes] = s
        state = f[s] * (state >> _SCALE) + slot - c[s]
        low = state < _LOW
        order = np.cumsum(low, axis=1)
        at = place[:, None] + order - 1
        x[:, :lanes] = np.where(low, (state << _32) | stream[np.maximum(at, 0)], state)
        place = place + order[:, -1]
    return out[:, :n]


def encode_blocks(ids: np.ndarray, frequencies: bytes, block: int) -> list[tuple[bytes, int, int]]:
    """(bytes, number of ids, checksum of the ids) of each block of a sequence."""
    f, c, _ = tables(frequencies)
    full = len(ids) // block * block
    out = _encode(ids[:full].reshape(-1, block), f, c) if full else []
    if full < len(ids):
        out += _encode(ids[full:][None, :], f, c)
    ends = [min(len(ids), (i + 1) * block) for i in range(len(out))]
    return [(data, e - i * block, zlib.crc32(ids[i * block : e].astype("<u4"))) for i, (data, e) in enumerate(zip(out, ends, strict=True))]


def decode_blocks(parts: list[tuple[bytes, int, int]], frequencies: bytes) -> np.ndarray:
    """The ids of blocks, end to end; a wrong checksum is an error."""
    tables_ = tables(frequencies)
    out: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(parts)
    for n in {p[1] for p in parts}:
        some = [i for i, p in enumerate(parts) if p[1] == n]
        for i, ids in zip(some, _decode([parts[i][0] for i in some], n, *tables_), strict=True):
            out[i] = ids
    for ids, (_, _, crc) in zip(out, parts, strict=True):
        if zlib.crc32(ids.astype("<u4")) != crc:
            raise ValueError("a block of token ids does not have its checksum")
    return np.concatenate(out) if out else np.zeros(0, np.uint32)
