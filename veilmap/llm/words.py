"""Words of Arrow text columns and their hashes, computed on bytes with numpy."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64."""
    held = _powers.get(base)
    if held is None or len(held) < n:
        steps = np.full(max(n, PIECE + 4096), base, np.uint64)
        steps[0] = 1
        held = np.multiply.accumulate(steps)
        if n <= PIECE + 4096:
            _powers[base] = held
    return held[:n]


def mixed(h: np.ndarray) -> np.ndarray:
    """A permutation of 64-bit numbers that spreads every bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of texts data[offsets[i]:offsets[i + 1]]."""
    word = ~_SPACE[data]
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = word[:-1], word[1:]
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    before[inner], after[inner - 1] = False, False
    return np.flatnonzero(word & ~before), np.flatnonzero(word & ~after) + 1


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[starts[i]:ends[i]]."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(_BASE, len(data)), out=sums[1:])
    h = (sums[ends] - sums[starts]) * powers(_INVERSE, len(data) + 1)[starts]
    return mixed(h ^ ((ends - starts).astype(np.uint64) << np.uint64(40)))


def rolling(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n successive items (none if there are fewer)."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    sums = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * powers(_BASE, len(h)), out=sums[1:])
    return mixed((sums[n:] - sums[:-n]) * powers(_INVERSE, len(h) + 1)[:len(h) - n + 1])


def pieces(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of neighbouring rows of a text column, about `PIECE`
    bytes at a time; nulls are empty."""
    column = column.cast(pa.large_string()).fill_null("")
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(at, at[row] + PIECE, "right")) - 1)
        yield row, end, data[at[row]:at[end]], at[row:end + 1] - at[row]
        row = end


def hashed_words(column: pa.Array, lower: bool) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, word hashes, offsets into them by row).  A text beyond a piece is
    hashed in parts cut between words."""
    for row, end, data, offsets in pieces(column):
        if lower:
            data = _LOWER[data]
        if len(data) <= 2 * PIECE:
            starts, ends = spans(data, offsets)
            yield row, end, hashes(data, starts, ends), np.searchsorted(starts, offsets)
            continue
        parts, at = [], 0
        while at < len(data):
            stop = min(at + PIECE, len(data))
            while stop < len(data) and not (gap := _SPACE[data[stop:stop + PIECE]]).any():
                stop = min(stop + PIECE, len(data))
            stop = stop + int(gap.argmax()) if stop < len(data) else stop
            part = data[at:stop]
            parts.append(hashes(part, *spans(part, np.array([0, len(part)]))))
            at = stop
        h = np.concatenate(parts)
        yield row, end, h, np.array([0, len(h)])
