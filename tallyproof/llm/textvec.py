"""Words and their hashes for whole Arrow batches of text, in numpy.

A word is a maximal run of bytes other than space and \\t \\n \\v \\f \\r. Its
hash is the sum of random numbers, one for each byte and its place in the word (a
table of SPAN places, times a random odd number for each further SPAN), mixed at the
end. So equal words have equal hashes in every process, and no pattern of bytes makes
two words collide whatever the numbers are, as patterns do for a polynomial modulo
2**64.
"""

from __future__ import annotations

import numpy as np

SEPARATOR = np.zeros(256, bool)
SEPARATOR[[32, 9, 10, 11, 12, 13]] = True
BLOCK = 1 << 20

SPAN, _STEP = 64, 1 << 15
_rng = np.random.default_rng(20240517)
_BYTE = _rng.integers(0, 2**64, (SPAN, 256), dtype=np.uint64)
_BYTE[:, SEPARATOR] = 0
_LOWER = _BYTE.copy()
_LOWER[:, 65:91] = _BYTE[:, 97:123]
_BYTE, _LOWER = _BYTE.ravel(), _LOWER.ravel()
_powers: dict = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n - 1), kept for the usual lengths."""
    had = _powers.get(int(base))
    if had is None or len(had) < n:
        had = np.full(max(n, 1 << 16), base, np.uint64)
        had[0] = 1
        had = np.multiply.accumulate(had)
        if n <= 2 * BLOCK:
            _powers[int(base)] = had
    return had[:n]


def buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string column; null is as empty."""
    import pyarrow as pa

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
    data = column.buffers()[2] if n else None
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first): byte bounds of each word, and for each text the
    index of its first word, with the total at the end."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~SEPARATOR[data]
    before = np.empty_like(inside)
    before[0], before[1:] = False, inside[:-1]
    edges = offsets[offsets < len(data)]
    before[edges] = False
    after = np.empty_like(inside)
    after[-1], after[:-1] = False, inside[1:]
    after[edges[edges > 0] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def slices(text, size: int, row: int = 64):
    """Row ranges of about so many bytes of text, at least a row each. row: what a row
    counts beside its text, so that empty texts don't gather in one range."""
    import pyarrow.compute as pc

    own = pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False) if len(text) else np.zeros(0, np.int64)
    total = np.cumsum(own.astype(np.int64) + row)
    low = 0
    while low < len(text):
        base = total[low - 1] if low else 0
        high = max(low + 1, int(np.searchsorted(total, base + size)))
        yield low, min(high, len(text))
        low = high


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each of the ranges."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


def odd(n: np.ndarray) -> np.ndarray:
    """A random odd number for each number."""
    return mix(n.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x632BE59BD9B4E019)) | np.uint64(1)


def word_hashes(data: np.ndarray, starts: np.ndarray, lower: bool = False) -> np.ndarray:
    """64-bit hashes of the words that start there; lower: A-Z as a-z."""
    values, out, i, n = (_LOWER if lower else _BYTE), np.empty(len(starts), np.uint64), 0, len(starts)
    while i < n:
        j = max(i + 1, int(np.searchsorted(starts, starts[i] + _STEP)))
        low, high = starts[i], starts[j] if j < n else len(data)
        at = starts[i:j] - low
        size = np.diff(np.append(at, high - low))
        place = np.arange(high - low) - np.repeat(at, size)
        block = values[((place & (SPAN - 1)) << 8) | data[low:high]]
        far = np.flatnonzero(place >= SPAN)
        if len(far):
            block[far] *= odd(place[far] // SPAN)
        out[i:j] = np.add.reduceat(block, at)
        i = j
    return mix(out)


def wide(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hashes of every run of width words, by doubling: each step mixes, so that no
    pattern of equal words cancels out."""
    if len(hashes) < width:
        return np.zeros(0, np.uint64)
    h, span = hashes, 1
    join = lambda x, y, k: mix(x * np.uint64(0xD1342543DE82EF95) + y * np.uint64(0xAF251AF3B0F025B5) + np.uint64(k))
    while 2 * span <= width:
        h = join(h[:-span], h[span:], span)
        span *= 2
    return h if span == width else join(h[: len(h) - (width - span)], h[width - span :], width)


def windows(hashes: np.ndarray, width: int, seed: int) -> np.ndarray:
    """Hashes of every run of width words (len - width + 1 of them)."""
    rng = np.random.default_rng(seed)
    total = np.zeros(max(0, len(hashes) - width + 1), np.uint64)
    for k in range(width):
        total += hashes[k : k + len(total)] * (rng.integers(1, 2**63, dtype=np.uint64) * np.uint64(2) + np.uint64(1))
    return mix(total)


def covered(flags: np.ndarray, width: int, n: int) -> np.ndarray:
    """Which of n places lie in a window of that width that starts at a flag."""
    steps = np.zeros(n + width + 1, np.int32)
    at = np.flatnonzero(flags)
    steps[at] += 1
    steps[at + width] -= 1
    return np.cumsum(steps)[:n] > 0
