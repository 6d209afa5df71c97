"""Shared tools of the subpackage: staged tables and vectorised text tokenisation.

Text is handled as the UTF-8 bytes of an Arrow batch, cut into slices of a few MB, so that memory is
bounded whatever the partition holds; one text is never cut.
"""

from __future__ import annotations

import contextlib
import ctypes
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession

from ..lineage import cleanup, drop, fresh_dir, shared_dir, stage  # noqa: F401

SLICE_BYTES = 1 << 20
_U = np.uint64


def batch_rows(spark: SparkSession, rows: int = 2000) -> None:
    """Arrow batches of at most so many rows (texts may be long); a session setting."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def release() -> None:
    """What this worker has freed goes back to the system. Allocators keep it, and workers live on: else each operator's peak stays while the next one runs."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries than GNU's have no such call
        ctypes.CDLL(None).malloc_trim(0)


def released(run: Callable) -> Callable:
    """A function of mapInArrow that ends with release()."""

    @functools.wraps(run)
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return each


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column (null: empty) and the n + 1 offsets of its texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    n = len(column)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    held = column.buffers()
    if not n or held[1] is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offsets = np.frombuffer(held[1], np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(held[2], np.uint8)[offsets[0] : offsets[-1]] if held[2] is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str = "text", size: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Runs of whole rows whose texts have about `size` bytes together (one text at least)."""
    at = batch.schema.get_field_index(column)
    data, offsets = utf8(batch.column(at))
    begin = 0
    while begin < batch.num_rows:
        end = max(begin + 1, int(np.searchsorted(offsets, offsets[begin] + size, "right")) - 1)
        end = min(end, batch.num_rows)
        yield batch.slice(begin, end - begin), data[offsets[begin] : offsets[end]], offsets[begin : end + 1] - offsets[begin]
        begin = end


def byte_class(breaks: bytes) -> np.ndarray:
    """256 flags: the bytes that belong to words, all but those given."""
    table = np.ones(256, bool)
    table[np.frombuffer(breaks, np.uint8)] = False
    return table


#: `[^\x20\x09-\x0D]+`: everything but ASCII white space.
NON_SPACE = byte_class(b" \t\n\x0b\x0c\r")
#: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after lower-casing: digits, a-z and all that is not ASCII. Capitals count as their small letters.
ALNUM = byte_class(bytes([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply); every bit of the input reaches every bit of the output."""
    h = h ^ (h >> _U(33))
    h = h * _U(0xFF51AFD7ED558CCD)
    h = h ^ (h >> _U(33))
    h = h * _U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> _U(33))


def _letters() -> np.ndarray:
    table = mix(np.arange(1, 257, dtype=_U) * _U(0x9E3779B97F4A7C15))
    table[65:91] = table[97:123]
    return table


_LETTERS = _letters()
_M = 0xD1342543DE82EF95
_M_INVERSE = pow(_M, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {"up": np.ones(1, _U), "down": np.ones(1, _U)}


def _power(kind: str, base: int, n: int) -> np.ndarray:
    if len(_powers[kind]) < n:
        p = np.full(max(n, SLICE_BYTES + (1 << 16)), base, _U)
        p[0] = 1
        _powers[kind] = np.cumprod(p, dtype=_U)
    return _powers[kind][:n]


class Words:
    """Words of some texts: where each starts and ends, the text it is of, and 64-bit hashes (A-Z as a-z)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, table: np.ndarray):
        n = len(data)
        inside = table[data]
        full = offsets[:-1][offsets[1:] > offsets[:-1]]
        before = np.empty(n, bool)
        before[1:] = inside[:-1]
        before[full] = False
        self.starts = np.flatnonzero(inside & ~before)
        after = before  # reused
        after[: max(n - 1, 0)] = inside[1:]
        after[offsets[1:][offsets[1:] > offsets[:-1]] - 1] = False
        self.ends = np.flatnonzero(inside & ~after) + 1
        self.bounds = np.searchsorted(self.starts, offsets)  # words of text i: bounds[i] up to bounds[i + 1]
        self.counts = np.diff(self.bounds)
        self._of: np.ndarray | None = None
        if len(self.starts):
            x = _LETTERS[data]
            x *= _power("up", _M, n)
            x[~inside] = 0
            # zero between words, so that a sum up to the next start is the word's
            h = np.add.reduceat(x, self.starts)
            h *= _power("down", _M_INVERSE, n)[self.starts]
            self.hashes = mix(h)
        else:
            self.hashes = np.zeros(0, _U)

    @property
    def of(self) -> np.ndarray:
        if self._of is None:
            self._of = np.repeat(np.arange(len(self.counts)), self.counts)
        return self._of

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Where each run of k words within one text starts, and its hash."""
        n = len(self.hashes)
        if n < k:
            return np.zeros(0, np.int64), np.zeros(0, _U)
        sums = run_hash(self.hashes, k)
        left = np.repeat(self.bounds[1:], self.counts)  # the end of the text of each word
        at = np.flatnonzero(np.arange(n - k + 1) + k <= left[: n - k + 1])
        return at, sums[at]


def run_hash(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k neighbours; run_hash(h, len(h))[0] is that of a whole sequence."""
    m, factor = len(hashes) - k + 1, _U(1)
    sums = np.full(m, k, _U)
    for j in range(k):
        factor = _U((int(factor) * 0x9FB21C651E98DF25 + 0x2545F4914F6CDD1D) & 0xFFFFFFFFFFFFFFFF | 1)
        sums += hashes[j : j + m] * factor
    return mix(sums)


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... (counts[0] of them), starts[1], ..."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(counts)
    return np.arange(total) - np.repeat(ends - counts - starts, counts)


def list_array(counts: np.ndarray, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), values)
