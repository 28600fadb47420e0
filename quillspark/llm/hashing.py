"""Words of many texts at once: places and 64-bit hashes, by numpy, in chunks of bounded bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

CHUNK = 2_000_000

_U = np.uint64
_rng = np.random.Generator(np.random.PCG64(20250911))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
BASE = 0xD1342543DE82EF95
_powers: dict[int, np.ndarray] = {}

#: True for the bytes that separate words: white space of ASCII; ASCII but letters and digits.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
NO_TERM = np.ones(256, bool)
NO_TERM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
AS_IS = np.arange(256, dtype=np.uint8)
LOWER = AS_IS.copy()
LOWER[65:91] += 32


def powers(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, 65536), base % 2**64, np.uint64)
        have[0] = 1
        _powers[base] = have = np.cumprod(have)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> _U(29))) * _U(0x9FB21C651E98DF25)
    return x ^ (x >> _U(32))


def sums(values: np.ndarray, base: int) -> np.ndarray:
    """Sums of the values times powers of the base, before each place and after the last."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(base, len(values)), out=out[1:])
    return out


def stretch(total: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """Hashes of the stretches from starts to ends, wherever they stand."""
    return mix((total[ends] - total[starts]) * powers(pow(base, -1, 2**64), len(total))[starts] + (ends - starts).astype(np.uint64))


def word_chunks(texts: list[bytes], outside: np.ndarray, as_byte: np.ndarray = AS_IS) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes of the chunk, text number, start, end, hash) of all words, chunk by chunk; no word is cut."""
    if not texts:
        return
    buf = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    last = np.cumsum([len(t) + 1 for t in texts])
    at = 0
    while at < len(buf):
        end = min(at + CHUNK, len(buf))
        while end < len(buf) and not outside[buf[end - 1]]:
            more = np.flatnonzero(outside[buf[end : end + 65536]])
            end = end + int(more[0]) + 1 if len(more) else min(end + 65536, len(buf))
        here = as_byte[buf[at:end]]
        edge = np.flatnonzero(np.diff(outside[here].astype(np.int8), prepend=np.int8(1)))
        starts, ends = edge[0::2], edge[1::2]
        yield here, np.searchsorted(last, starts + at, side="right"), starts, ends, stretch(sums(_BYTE[here], BASE), starts, ends, BASE)
        at = end


def slices(lengths: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts have ``most`` bytes together, or of one row that has more."""
    at, total = 0, 0
    for k, n in enumerate(lengths):
        if k > at and total + n > most:
            yield at, k
            at, total = k, 0
        total += int(n)
    if at < len(lengths):
        yield at, len(lengths)
