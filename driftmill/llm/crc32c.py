"""Masked CRC-32C of many byte strings at once, in numpy.

All messages are cut into 64-byte blocks (padded in front with zeros, which leave a zero register
unchanged); the blocks advance in lockstep, four bytes a step, and are joined pairwise by the
linear map that a run of zero bytes has on the register.
"""

from __future__ import annotations

from functools import cache

import numpy as np

BLOCK = 64
#: The reflected Castagnoli polynomial and the constant of the record format's mask.
POLYNOMIAL, MASK_DELTA = 0x82F63B78, 0xA282EAD8


def _images(columns: np.ndarray) -> np.ndarray:
    """Tables (4, 256) that apply a linear map, given by the images of the 32 bits."""
    out = np.zeros((4, 256), np.uint32)
    for byte in range(4):
        for bit in range(8):
            out[byte, (np.arange(256) >> bit & 1).astype(bool)] ^= columns[8 * byte + bit]
    return out


def _apply(tables: np.ndarray, v: np.ndarray) -> np.ndarray:
    return tables[0, v & 255] ^ tables[1, v >> 8 & 255] ^ tables[2, v >> 16 & 255] ^ tables[3, v >> 24]


@cache
def _zeros(power: int) -> np.ndarray:
    """Tables of the map of 2**power zero bytes."""
    bits = np.uint32(1) << np.arange(32, dtype=np.uint32)
    if power:
        return _images(_apply(_zeros(power - 1), _apply(_zeros(power - 1), bits)))
    for _ in range(8):
        bits = (bits >> np.uint32(1)) ^ np.where(bits & np.uint32(1), np.uint32(POLYNOMIAL), np.uint32(0))
    return _images(bits)


@cache
def _halves() -> tuple[np.ndarray, np.ndarray]:
    """The map of four zero bytes, as tables by the register's lower and upper 16 bits."""
    four, x = _zeros(2), np.arange(65536, dtype=np.uint32)
    return _apply(four, x), _apply(four, x << np.uint32(16))


def crc32c(messages: list[bytes]) -> np.ndarray:
    """The CRC-32C of each message."""
    if not messages:
        return np.zeros(0, np.uint32)
    length = np.array([len(m) for m in messages], np.int64)
    blocks = -(-length // BLOCK)
    data = b"".join(x for m in messages for x in (bytes(-len(m) % BLOCK), m))
    words = np.ascontiguousarray(np.frombuffer(data, "<u4").reshape(-1, BLOCK // 4).T)
    low, high = _halves()
    state = np.zeros(words.shape[1], np.uint32)
    for w in words:
        state ^= w
        state = low[state & 0xFFFF] ^ high[state >> 16]
    first = np.cumsum(blocks) - blocks
    out = np.zeros(len(messages), np.uint32)
    level = np.where(blocks > 1, np.ceil(np.log2(np.maximum(blocks, 1))).astype(int), 0)
    base = BLOCK.bit_length() - 1
    for e in np.unique(level[blocks > 0]):
        rows = np.flatnonzero((level == e) & (blocks > 0))
        pad = (1 << e) - blocks[rows][:, None]
        at = first[rows][:, None] + np.arange(1 << e) - pad
        v = np.where(np.arange(1 << e) >= pad, state[np.maximum(at, 0)], np.uint32(0))
        for k in range(e):
            v = _apply(_zeros(base + k), v[:, 0::2]) ^ v[:, 1::2]
        out[rows] = v[:, 0]
    start = np.full(len(messages), 0xFFFFFFFF, np.uint32)
    for k in range(int(length.max()).bit_length()):
        rows = np.flatnonzero(length >> k & 1)
        start[rows] = _apply(_zeros(k), start[rows])
    return out ^ start ^ np.uint32(0xFFFFFFFF)


def masked(messages: list[bytes]) -> np.ndarray:
    """The rotated and shifted checksum, so that checksums of data that hold checksums stay sound."""
    v = crc32c(messages)
    return (v >> np.uint32(15) | v << np.uint32(17)) + np.uint32(MASK_DELTA)
