"""Vectorised hashes of the words of many texts, and of runs of consecutive words.

A word's bytes are read eight at a time; each lane goes through a non-linear mix before the next one joins, so that no
two words collide by their structure. Two seeds give two independent 64-bit hashes. They find candidates only: what is
removed or linked is compared by the words themselves or by a cryptographic digest of them."""

from __future__ import annotations

import numpy as np

from rasterloom.llm.common import CHUNK_BYTES

_U = np.uint64
_WS = np.zeros(256, bool)
_WS[[9, 10, 11, 12, 13, 32]] = True
#: Masks that keep the first 0 to 8 bytes of a little-endian lane.
_MASK = np.array([(1 << 8 * n) - 1 for n in range(9)], _U)
_SEEDS = (0x243F6A8885A308D3, 0x13198A2E03707344)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def word_bounds(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Byte starts and lengths of the words, which are runs without white space."""
    ws = _WS[np.frombuffer(data, np.uint8)]
    edge = np.diff(ws, prepend=True, append=True).nonzero()[0]
    return edge[::2], edge[1::2] - edge[::2]


def _hash_bytes(data: bytes, seed: int) -> np.ndarray:
    starts, lens = word_bounds(data)
    if not len(starts):
        return np.zeros(0, _U)
    raw = np.frombuffer(data + bytes(8), np.uint8)
    lanes = np.ndarray(len(data) + 1, "<u8", raw, strides=(1,))  # the eight bytes from each place on
    h = mix(lens.astype(_U) + _U(_SEEDS[seed]))
    h = mix(h ^ (lanes[starts] & _MASK[np.minimum(lens, 8)])) + h
    at, more = 8, np.flatnonzero(lens > 8)
    while len(more):
        left = np.minimum(lens[more] - at, 8)
        h[more] = mix(h[more] ^ (lanes[starts[more] + at] & _MASK[left])) + h[more] * _U(3)
        at += 8
        more = more[lens[more] > at]
    return mix(h)


def word_hashes(data: bytes, seed: int = 0) -> np.ndarray:
    """One hash per word of the UTF-8 text, in order; long texts go through in slices cut at white space."""
    if len(data) <= CHUNK_BYTES:
        return _hash_bytes(data, seed)
    out, at = [], 0
    while at < len(data):
        end = min(len(data), at + CHUNK_BYTES)
        while end < len(data) and not _WS[data[end]]:
            end += 1
        out.append(_hash_bytes(data[at:end], seed))
        at = end
    return np.concatenate(out)


def encoded(texts: list[str | None], lower: bool = False) -> list[bytes]:
    """The UTF-8 bytes of each text (null: none), with A-Z lower-cased on demand."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    return [r.lower() for r in raw] if lower else raw


def texts_hashes(raw: list[bytes], seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of many texts, and the bounds of each text (len(raw) + 1 of them)."""
    if sum(map(len, raw)) <= 2 * CHUNK_BYTES:
        data = b" ".join(raw)
        hashes = _hash_bytes(data, seed) if raw else np.zeros(0, _U)
        ends = np.cumsum([len(r) + 1 for r in raw])
        return hashes, np.concatenate([[0], np.searchsorted(word_bounds(data)[0], ends)]) if raw else np.zeros(1, np.int64)
    each = [word_hashes(r, seed) for r in raw]
    return np.concatenate(each), np.concatenate([[0], np.cumsum([len(e) for e in each])])


def _odd(n: int, salt: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=_U) * _U(0xA0761D6478BD642F) + _U(salt)) | _U(1)


def run_hashes(words: np.ndarray, n: int, salt: int = 0) -> np.ndarray:
    """Hash of each run of n consecutive words (len(words) - n + 1 of them)."""
    m = len(words) - n + 1
    if m <= 0:
        return np.zeros(0, _U)
    c = _odd(n, salt)
    total = np.zeros(m, _U)
    for j in range(n):
        total += words[j : j + m] * c[j]
    return mix(total + _U(salt))
