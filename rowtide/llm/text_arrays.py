"""Words of many texts at once, as numpy arrays of 64-bit hashes.

Words are runs of bytes other than space and the five ASCII control spaces, in UTF-8;
A to Z are lower-cased if asked for. The hash of a word is a polynomial in its bytes
modulo 2^64, taken from running sums over the whole piece, and then mixed; two different
words share one with a chance of about 2^-64.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

#: Bytes of text in one piece; the arrays take about 40 times as much.
PIECE = 1 << 18
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[ord("A") : ord("Z") + 1] += 32
_SAME = np.arange(256, dtype=np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all (splitmix64's last steps)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """1, base, base^2 and so on modulo 2^64; a view of the longest row made so far."""
    known = _POWERS.get(base)
    if known is None or len(known) < n:
        known = np.full(max(n, 2 * PIECE), base, dtype=np.uint64)
        known[0] = 1
        known = _POWERS[base] = np.multiply.accumulate(known)
    return known[:n]


def word_hashes(data: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and first places of the words in a piece of bytes."""
    inside = np.empty(len(data) + 2, dtype=bool)
    inside[0] = inside[-1] = False
    np.logical_not(_SPACE[data], out=inside[1:-1])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    table = _LOWER if lower else _SAME
    np.cumsum((table[data] + np.uint64(1)) * powers(_BASE, len(data)), out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * powers(_INVERSE, len(data))[starts]), starts


def pieces(texts: Iterable[str | None], size: int = PIECE) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Texts as pieces of about ``size`` bytes: the bytes, the texts' places in the list, their starts.

    Long texts go on in the next piece, cut where a word ends; only a word longer than a
    piece makes a piece longer.
    """
    parts: list[bytes] = []
    owners: list[int] = []
    held = 0
    for i, text in enumerate(texts):
        raw = (text or "").encode("utf-8", "surrogatepass")
        at = 0
        while len(raw) - at > size:
            if held:
                yield _piece(parts, owners)
                parts, owners, held = [], [], 0
            cut = _cut(raw, at + size)
            yield _piece([raw[at:cut]], [i])
            at = cut
        raw = raw[at:] if at else raw
        parts.append(raw)
        owners.append(i)
        held += len(raw) + 1
        if held >= size:
            yield _piece(parts, owners)
            parts, owners, held = [], [], 0
    if parts:
        yield _piece(parts, owners)


def _cut(raw: bytes, at: int) -> int:
    while at < len(raw) and raw[at] not in b" \t\n\x0b\x0c\r":
        at += 1
    return at


def _piece(parts: list[bytes], owners: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    data = np.frombuffer(b" ".join(parts), dtype=np.uint8)
    lengths = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))
    starts = np.concatenate([[0], np.cumsum(lengths[:-1] + 1)]).astype(np.int64)
    return data, np.asarray(owners, dtype=np.int64), starts


def text_words(texts: Iterable[str | None], size: int = PIECE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each piece: the words' hashes in order, and the place of each one's text in the list."""
    for data, owners, starts in pieces(texts, size):
        if len(data):
            hashes, at = word_hashes(data)
            yield hashes, owners[np.searchsorted(starts, at, side="right") - 1]
