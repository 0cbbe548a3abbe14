"""Words of whole Arrow batches as 64-bit hashes, computed with numpy.

A word is a maximal run without blank or ``\\x09``-``\\x0D``. All of them are
single UTF-8 bytes, so texts are worked on as bytes. A word's hash is a
polynomial over random values of its bytes, modulo 2**64, then mixed; two
different words share one with a probability of about 2**-59.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text worked on at once; a longer document is cut between words.
PIECE = 1 << 20
NONE = np.uint64(0xFFFFFFFFFFFFFFFF)

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
_NO_LETTER = np.array([b < 0x80 and not chr(b).isalpha() for b in range(256)])


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (splitmix64's last step)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
_LOWERED = _VALUES.copy()
_LOWERED[65:91] = _VALUES[97:123]
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or next(iter(_powers)) < n:
        size = max(n, PIECE)
        tables = []
        for base in (_BASE, _INVERSE):
            steps = np.full(size, np.uint64(base))
            steps[0] = 1
            tables.append(np.cumprod(steps, dtype=np.uint64))
        _powers.clear()
        _powers[size] = (tables[0], tables[1])
    return next(iter(_powers.values()))


@dataclass
class Words:
    """The words of some documents: ``hashes[bounds[i]:bounds[i+1]]`` are document i's."""

    hashes: np.ndarray
    starts: np.ndarray  # first byte in the buffer
    ends: np.ndarray
    bounds: np.ndarray
    buffer: np.ndarray

    def of(self, i: int) -> np.ndarray:
        return self.hashes[self.bounds[i] : self.bounds[i + 1]]


def _piece_ends(separator: np.ndarray) -> Iterator[int]:
    at, n = 0, len(separator)
    while n - at > PIECE:
        step = at + PIECE
        while step < n:
            found = np.flatnonzero(separator[step : step + PIECE])
            if len(found):
                step += int(found[0])
                break
            step += PIECE
        at = min(step, n)
        yield at
    if at < n:
        yield n


def find_words(buffer: np.ndarray, offsets: np.ndarray, lower: bool, letters: bool = False) -> Words:
    """The words of the documents ``buffer[offsets[i]:offsets[i+1]]``.

    With ``letters`` ASCII digits and punctuation separate words as well.
    """
    separator = (_NO_LETTER if letters else _SEPARATOR)[buffer]
    values = _LOWERED if lower else _VALUES
    first = np.zeros(len(buffer) + 1, bool)
    first[offsets] = True
    inside = ~separator
    opens, closes = inside.copy(), inside.copy()
    opens[1:] &= separator[:-1] | first[1:-1]
    closes[:-1] &= separator[1:] | first[1:-1]
    starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    hashes = np.empty(len(starts), np.uint64)
    at = done = 0
    for stop in _piece_ends(separator):
        last = int(np.searchsorted(starts, stop))
        up, down = _power_tables(stop - at)
        running = np.zeros(stop - at + 1, np.uint64)
        np.cumsum(values[buffer[at:stop]] * up[: stop - at], out=running[1:])
        s, e = starts[done:last] - at, ends[done:last] - at
        hashes[done:last] = mix((running[e] - running[s]) * down[s])
        at, done = stop, last
    return Words(hashes, starts, ends, np.searchsorted(starts, offsets), buffer)


def text_slices(batch: pa.RecordBatch, column: str = "text", limit: int = 2 * PIECE):
    """Cuts a batch into slices of about ``limit`` bytes of text, whole rows each.

    Yields (slice, bytes of its texts, offsets); a null text is an empty one.
    """
    texts = pc.fill_null(batch.column(column).cast(pa.large_string()), "")
    at = 0
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    while at < len(texts):
        stop = int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1
        stop = min(max(stop, at + 1), len(texts))
        yield (
            batch.slice(at, stop - at),
            data[offsets[at] : offsets[stop]],
            offsets[at : stop + 1] - offsets[at],
        )
        at = stop
    release_memory()


def release_memory() -> None:
    """Gives freed memory back to the system; Python workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)


def sequence_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """A hash of every ``width`` consecutive words, in order."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    up, down = _power_tables(len(hashes))
    running = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * up[: len(hashes)], out=running[1:])
    return mix((running[width:] - running[:-width]) * down[:n])


def sliding(values: np.ndarray, width: int, best=np.minimum) -> np.ndarray:
    """The smallest (or other best) of every ``width`` consecutive values."""
    size = 1
    while 2 * size <= width:
        values = best(values[:-size], values[size:])
        size *= 2
    rest = width - size
    return best(values[:-rest], values[rest:]) if rest else values


def long_column(values: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(values).view(np.int64))
