"""64-bit hashes of the words of many texts at once, by numpy.

A word's hash is the sum of its characters times powers of an odd number by their place,
mixed at the end, so all words of a batch of texts take a few array operations.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
#: Places with a power of their own; a longer word uses them again.
PLACES = 1 << 12
_MIX = np.uint64(0xD6E8FEB86659FD93)
#: Characters that end a word, as str.split sees them; none lies beyond.
_SPACE = np.array([chr(c).isspace() for c in range(0x3002)])
_ASCII_SPACE = np.array([c in b" \t\n\r\x0b\x0c" for c in range(256)])
#: Characters that are hashed together.
AT_ONCE = 1 << 21


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


_POWERS = [powers(b, PLACES) for b in _BASES]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _MIX
    h = (h ^ (h >> np.uint64(32))) * _MIX
    return h ^ (h >> np.uint64(32))


def characters(text: str | bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The characters, which are white space, and where words begin."""
    if isinstance(text, bytes):
        codes = np.frombuffer(text, np.uint8)
        space = _ASCII_SPACE[codes]
    else:
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        space = _SPACE[np.minimum(codes, len(_SPACE) - 1)]
    return codes, space, np.flatnonzero(np.append(True, space[:-1]) & ~space) if len(codes) else np.zeros(0, np.int64)


def word_hashes(codes: np.ndarray, space: np.ndarray, start: np.ndarray, kinds: int = 1) -> list[np.ndarray]:
    """A hash of each word, of one or two kinds that are independent of each other."""
    if not len(start):
        return [np.zeros(0, np.uint64)] * kinds
    place = np.arange(start[0], len(codes)) - np.repeat(start, np.diff(np.append(start, len(codes))))
    place &= PLACES - 1
    held = np.where(space[start[0] :], 0, codes[start[0] :]).astype(np.uint64) + np.uint64(1)
    held[space[start[0] :]] = 0
    return [mix(np.add.reduceat(held * _POWERS[k][place], start - start[0])) for k in range(kinds)]


def slices(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """(from, to) of runs of texts of about AT_ONCE characters; a longer text is one of its own."""
    lo = size = 0
    for i, t in enumerate(texts):
        size += len(t or "") + 1
        if size >= AT_ONCE:
            yield lo, i + 1
            lo, size = i + 1, 0
    if lo < len(texts):
        yield lo, len(texts)


def hashed(texts: list[str | None], ascii_only: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of the words of all texts, and where each text's begin (one entry more than texts). Words are lower-cased:
    A-Z only, and cut at ASCII white space, if ascii_only, else as str.lower and str.split do."""
    out, ends, total = [], [np.zeros(1, np.int64)], 0
    for lo, hi in slices(texts):
        own = [(t or "").encode().lower() if ascii_only else (t or "").lower() for t in texts[lo:hi]]
        codes, space, start = characters((b"\n" if ascii_only else "\n").join(own))
        out += word_hashes(codes, space, start)
        ends.append(total + np.searchsorted(start, np.cumsum([len(t) + 1 for t in own])))
        total += len(start)
    return np.concatenate([*out, np.zeros(0, np.uint64)]), np.concatenate(ends)
