"""Words and word sequences of whole texts, as numpy arrays over Arrow's text buffers.

No Python string is made for a word. A record batch is cut into runs of rows of
about ``CHUNK`` bytes (a longer text makes a run of its own), so memory depends
on the longest text and not on the number of rows in a batch.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 1 << 18
#: Powers of a hash's base are kept between runs up to this number.
POWERS = 1 << 21
_U = np.uint64

#: Words of characters other than ASCII white space.
SPACED = np.ones(256, bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False
#: Words of ASCII letters and digits and of everything outside ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

#: Words as in ``ALNUM`` (1) and runs of ASCII punctuation (2).
WORDPUNCT = ALNUM.astype(np.uint8)
WORDPUNCT[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = 2

_SAME = np.arange(256, dtype=np.uint8)
_LOWER = _SAME.copy()
_LOWER[0x41:0x5B] += 0x20

_rng = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _rng.integers(1, 2**64, 256, dtype=np.uint64) | _U(1)
_P = _U(0x9E3779B97F4A7C15 | 1)
_Q = _U(0xD1342543DE82EF95 | 1)
_pows: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    h = h ^ (h >> _U(30))
    h = h * _U(0xBF58476D1CE4E5B9)
    h = h ^ (h >> _U(27))
    h = h * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def _powers(base: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and its inverse modulo 2**64, for i below n."""
    have = _pows.get(int(base))
    if have is None or len(have[0]) < n:
        m = max(n, 1 << 16)
        inv = _U(pow(int(base), -1, 1 << 64))
        up, down = (np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(m - 1, b, np.uint64)])) for b in (base, inv))
        have = (up, down)
        if m <= POWERS:
            _pows[int(base)] = have
    return have[0][:n], have[1][:n]


@dataclass
class Run:
    """Rows ``lo`` to ``hi`` of a batch: bytes, the words' places, and each word's row (from 0 in the run)."""

    lo: int
    hi: int
    data: np.ndarray
    row_start: np.ndarray
    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    #: First word of each row, and the end of the last.
    first: np.ndarray

    def prefix_sums(self) -> np.ndarray:
        n = len(self.data)
        up, _ = _powers(_P, n + 1)
        s = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[self.data] * up[:n], out=s[1:])
        return s

    def hashes(self, sums: np.ndarray | None = None, length: int | None = None) -> np.ndarray:
        """A 64-bit hash of each word, or of its first ``length`` bytes."""
        s = self.prefix_sums() if sums is None else sums
        end = self.end if length is None else np.minimum(self.start + length, self.end)
        _, down = _powers(_P, len(self.data) + 1)
        return mix((s[end] - s[self.start]) * down[self.start] + (end - self.start).astype(np.uint64))

    def text(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()


def sequence_hashes(h: np.ndarray, at: np.ndarray, k: int | np.ndarray) -> np.ndarray:
    """A 64-bit hash of the k values of ``h`` from each place in ``at``."""
    n = len(h)
    up, down = _powers(_Q, n + 1)
    s = np.zeros(n + 1, np.uint64)
    np.cumsum(h * up[:n], out=s[1:])
    k = np.asarray(k)
    return mix((s[at + k] - s[at]) * down[at] + k.astype(np.uint64))


def window_starts(first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places where k consecutive words of one row begin, and each place's row."""
    n = np.maximum(np.diff(first) - (k - 1), 0)
    row = np.repeat(np.arange(len(n)), n)
    return np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + first[:-1][row], row


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and 64-bit offsets of a text column; null is empty."""
    column = pc.fill_null(column, "") if column.null_count else column
    wide = column.type in (pa.large_string(), pa.large_binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), at


def spans(at: np.ndarray, limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Runs of rows of at most ``limit`` bytes, one row at least."""
    lo, n = 0, len(at) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + limit, "right")) - 1)
        yield lo, min(hi, n)
        lo = hi


def runs(column: pa.Array, word: np.ndarray, lower: bool, limit: int = CHUNK) -> Iterator[Run]:
    """The words of a text column, run by run: longest strings of bytes of one class other than 0."""
    data, at = buffers(column)
    fold = _LOWER if lower else _SAME
    for lo, hi in spans(at, limit):
        b = fold[data[at[lo] : at[hi]]]
        row_start = at[lo : hi + 1] - at[lo]
        n = len(b)
        kind = np.zeros(n + 2, np.uint8)
        kind[1 : n + 1] = word[b]
        cut = np.zeros(n + 1, bool)
        cut[row_start] = True
        turn = (kind[1:] != kind[:-1]) | cut
        start = np.flatnonzero((kind[1:] > 0) & turn)
        end = np.flatnonzero((kind[:-1] > 0) & turn)
        first = np.searchsorted(start, row_start)
        yield Run(lo, hi, b, row_start, start, end, np.repeat(np.arange(hi - lo), np.diff(first)), first)


def ragged(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """A list column from its values in row order and each row's count."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(values, kind))


#: What a worker keeps from task to task, by the work that it is for.
kept: dict[str, object] = {}


def _trim() -> None:
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # not glibc: the allocator keeps it
        pass


def _begin(work: str | None) -> None:
    """Lets go of what was kept for other work."""
    others = [k for k in kept if k != work]
    for k in others:
        del kept[k]
    if others:
        _trim()


def freed(of: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], work: str | None = None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``of``, after which a worker gives the memory of its arrays back: workers outlive their tasks beside the executor's heap. What is ``kept`` for ``work`` stays, the rest goes first."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _begin(work)
        yield from of(batches)
        _trim()

    return wrapped
