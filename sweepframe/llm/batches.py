"""Words of Arrow text batches as numpy arrays.

A word is a maximal run of bytes other than space and 0x09-0x0D, inside one text.
NULL texts count as empty. All functions look at whole texts; batches are cut
between texts so that what Python holds at a time stays bounded.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text worked on at a time; a longer text is worked on alone.
SLICE_BYTES = 4 << 20

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def as_text(column) -> pa.Array:
    """The column as one plain string array without NULLs."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column.cast(pa.large_string()), "")


def slices(batch: pa.RecordBatch, text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of ``batch`` with at most ``limit`` bytes of text each."""
    if batch.num_rows == 0:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0)
    total = np.cumsum(sizes.to_numpy(zero_copy_only=False))
    start = 0
    while start < batch.num_rows:
        before = total[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(total, before + limit, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts one after the other, and the n + 1 places they begin at."""
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    if data is None:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def tokens(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of ``inside`` that do not cross texts."""
    if len(inside) == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.empty(len(inside), bool)
    first[0] = True
    np.logical_not(inside[:-1], out=first[1:])
    first[offsets[:-1][offsets[:-1] < len(inside)]] = True
    last = np.empty(len(inside), bool)
    last[-1] = True
    np.logical_not(inside[1:], out=last[:-1])
    last[offsets[1:][offsets[1:] > 0] - 1] = True
    return np.flatnonzero(first & inside), np.flatnonzero(last & inside) + 1


def pieces(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The byte ranges as a binary array; ranges are in order and do not overlap."""
    change = np.bincount(starts, minlength=len(data) + 1) - np.bincount(ends, minlength=len(data) + 1)
    inside = np.cumsum(change[:-1]) > 0
    offsets = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=offsets[1:])
    return pa.Array.from_buffers(
        pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data[inside])]
    )


@dataclass
class Words:
    """Words of a slice: ``data[starts[k]:ends[k]]``; those of text i are
    ``first[i] .. first[i + 1]``."""

    data: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    def __len__(self) -> int:
        return len(self.starts)

    @property
    def texts(self) -> int:
        return len(self.first) - 1

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def owner(self) -> np.ndarray:
        """The text each word belongs to."""
        return np.repeat(np.arange(self.texts), self.counts)

    def named(self) -> tuple[np.ndarray, list[bytes]]:
        """A number per word, equal for equal words, and the distinct words."""
        coded = pieces(self.data, self.starts, self.ends).dictionary_encode()
        return (
            coded.indices.to_numpy(zero_copy_only=False).astype(np.int64),
            coded.dictionary.to_pylist(),
        )


def words(texts: pa.Array, data: np.ndarray | None = None) -> Words:
    """``data``: the same texts with some bytes replaced (e.g. lower case)."""
    found, offsets = raw(texts)
    data = found if data is None else data
    starts, ends = tokens(~SPACE[data], offsets)
    return Words(data, offsets, starts, ends, np.searchsorted(starts, offsets))


def sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of ``values[bounds[i]:bounds[i + 1]]`` for each i, also for empty ranges."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]
