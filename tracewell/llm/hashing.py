"""Vectorised 64-bit hashes of words and word windows."""

from __future__ import annotations

import hashlib

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[32, 9, 10, 11, 12, 13]] = True


#: Bytes of the words that are hashed block by block.
LONG = 64
#: Masks of the first 0 to 8 bytes of a little-endian number.
_KEEP = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser with good avalanche, wrapping at 64 bits."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, one after another, and each text's number of words.

    Words are the runs of bytes other than space, tab and the line controls. A word's bytes
    enter in blocks of eight, each mixed into what the blocks before it left, from a start
    that depends on the length; words of more than LONG bytes are hashed by BLAKE2.
    """
    data = np.frombuffer(b" ".join(texts) + b" " * 8, np.uint8)
    sep = _SEPARATOR[data]
    edge = np.flatnonzero(np.diff(np.r_[True, sep].view(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return np.empty(0, np.uint64), np.zeros(len(texts), np.int64)
    size = ends - starts
    # the eight bytes from every place, as one number
    block = np.lib.stride_tricks.sliding_window_view(data, 8)
    h = mix(size.astype(np.uint64) + _M2)
    live = np.flatnonzero(size <= LONG)
    at, left = starts[live], size[live]
    while len(live):
        x = block[at].copy().view(np.uint64)[:, 0]
        x &= _KEEP[np.minimum(left, 8)]
        h[live] = mix((h[live] ^ x) * _BASE + _M1)
        more = left > 8
        live, at, left = live[more], at[more] + 8, left[more] - 8
    for k in np.flatnonzero(size > LONG).tolist():
        h[k] = int.from_bytes(hashlib.blake2b(data[starts[k] : ends[k]], digest_size=8).digest(), "little")
    stops = np.cumsum([len(t) + 1 for t in texts])
    return h, np.diff(np.r_[0, np.searchsorted(starts, stops)])


def windows(h: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` words from each place (the last places have none), by doubling."""
    with np.errstate(over="ignore"):
        return _windows(h, size)


def _windows(h: np.ndarray, size: int) -> np.ndarray:
    if len(h) < size:
        return np.empty(0, np.uint64)
    out, done = None, 0
    power, step = h, 1
    factor = _BASE
    left = size
    while left:
        if left & 1:
            if out is None:
                out, shift = power, step
                grown = factor
            else:
                n = len(h) - (done + step) + 1
                out = out[:n] * factor + power[done : done + n]
                grown = grown * factor
            done += step
        left >>= 1
        if left:
            n = len(h) - 2 * step + 1
            power = power[:n] * factor + power[step : step + n]
            factor = factor * factor
            step *= 2
    return mix(out[: len(h) - size + 1] + np.uint64(size) * _M1)
