"""NumPy kernels over whole Arrow batches of text: words, hashes, shingles.

A word is a maximal run of letters and digits of the lower-cased text. A batch is
held as one array of 64-bit word hashes plus the offsets of its rows, so that no
kernel loops over rows or words in Python.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
#: Odd multipliers of the polynomial and mixing hashes.
_RADIX = 0x9E3779B97F4A7C15
_GOLD = U(0x9E3779B97F4A7C15)
_M1 = U(0xBF58476D1CE4E5B9)
_M2 = U(0x94D049BB133111EB)

_alnum: np.ndarray | None = None
_powers: tuple[np.ndarray, np.ndarray] = (np.ones(0, U), np.ones(0, U))


def alnum_table() -> np.ndarray:
    """Whether each code point is a letter or digit; built once per worker."""
    global _alnum
    if _alnum is None:
        _alnum = np.fromiter((chr(c).isalnum() for c in range(0x110000)), bool, 0x110000)
    return _alnum


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the radix and of its inverse modulo 2^64, at least n of each."""
    global _powers
    if len(_powers[0]) < n:
        size = max(n, 1 << 19)
        made = []
        for base in (_RADIX, pow(_RADIX, -1, 1 << 64)):
            x = np.full(size, base, U)
            x[0] = 1
            made.append(np.cumprod(x, dtype=U))
        _powers = (made[0], made[1])
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finisher of 64-bit values."""
    x = x ^ (x >> U(30))
    x = x * _M1
    x = x ^ (x >> U(27))
    x = x * _M2
    return x ^ (x >> U(31))


def _block(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    low = [t.lower() if t else "" for t in texts]
    lens = np.fromiter(map(len, low), np.int64, len(low))
    cp = np.frombuffer(" ".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum(lens + 1)
    inside = alnum_table()[cp]
    flips = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).view(np.int8)))
    start, stop = flips[0::2], flips[1::2]
    up, down = _power_tables(len(cp) + 1)
    total = np.concatenate((np.zeros(1, U), np.cumsum(cp * up[: len(cp)], dtype=U)))
    h = mix((total[stop] - total[start]) * down[start] + (stop - start).astype(U) * _GOLD)
    count = np.bincount(np.searchsorted(ends, start, side="right"), minlength=len(low))
    return h, count


def words(texts: list[str | None], chars: int = 1 << 19) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all rows, and the offsets of the rows. Null counts as empty.

    Rows are worked through in blocks of about `chars` characters, which keeps the
    temporary arrays in cache; a longer text is a block of its own, never cut.
    """
    hs, counts, block, size = [np.zeros(0, U)], [np.zeros(0, np.int64)], [], 0
    for t in texts:
        block.append(t)
        size += len(t) if t else 0
        if size >= chars:
            h, c = _block(block)
            hs.append(h)
            counts.append(c)
            block, size = [], 0
    if block:
        h, c = _block(block)
        hs.append(h)
        counts.append(c)
    return np.concatenate(hs), np.concatenate(([0], np.cumsum(np.concatenate(counts)))).astype(np.int64)


def starts(off: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions at which a window of `width` words begins inside its row, and the rows."""
    m = np.maximum(np.diff(off) - width + 1, 0)
    row = np.repeat(np.arange(len(m)), m)
    pos = np.arange(len(row)) - np.repeat(np.cumsum(m) - m, m) + np.repeat(off[:-1], m)
    return pos, row


def shingles(h: np.ndarray, off: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of `width` consecutive words, with their rows and positions."""
    pos, row = starts(off, width)
    x = h[pos]
    for i in range(1, width):
        x = mix(x * _GOLD + h[pos + i])
    return x, row, pos


def distinct(x: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of each row, in order of row and value."""
    if not len(x):
        return x, row
    o = np.lexsort((x, row))
    x, row = x[o], row[o]
    keep = np.concatenate(([True], (x[1:] != x[:-1]) | (row[1:] != row[:-1])))
    return x[keep], row[keep]


def sequence_hash(h: np.ndarray, off: np.ndarray) -> np.ndarray:
    """One hash of the whole word sequence of each row."""
    up, down = _power_tables(len(h) + 1)
    total = np.concatenate((np.zeros(1, U), np.cumsum(h * up[: len(h)], dtype=U)))
    n = np.diff(off)
    return mix((total[off[1:]] - total[off[:-1]]) * down[off[:-1]] + n.astype(U) * _GOLD)


def jaccard(a: list[str | None], b: list[str | None], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row by row, the overlap of the shingle sets of a and b, and both word counts.

    Two texts without any shingle have the overlap 0.
    """
    sides, counts = [], []
    for texts in (a, b):
        h, off = words(texts)
        x, row, _ = shingles(h, off, width)
        sides.append(distinct(x, row))
        counts.append(np.diff(off))
    (xa, ra), (xb, rb) = sides
    na, nb = np.bincount(ra, minlength=len(a)), np.bincount(rb, minlength=len(b))
    x, r = np.concatenate((xa, xb)), np.concatenate((ra, rb))
    if len(x):
        o = np.lexsort((x, r))
        x, r = x[o], r[o]
        both = r[1:][(x[1:] == x[:-1]) & (r[1:] == r[:-1])]
    else:
        both = np.zeros(0, np.int64)
    common = np.bincount(both, minlength=len(a))
    union = na + nb - common
    return np.divide(common, union, out=np.zeros(len(a)), where=union > 0), counts[0], counts[1]
