"""Texts of Arrow batches as arrays of bytes, and their words as codes."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on at once; a longer text is a chunk of its own.
CHUNK = 8_000_000


class Chunk(NamedTuple):
    """Rows first to last (exclusive) of a batch; the text of row first + k is data[starts[k] : starts[k + 1]]."""

    first: int
    last: int
    data: np.ndarray
    starts: np.ndarray


def chunks(column: pa.Array, most: int = CHUNK) -> Iterator[Chunk]:
    """The texts of a column without nulls, in parts of about so many bytes, without copying."""
    if not len(column):
        return
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    starts = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(starts, starts[first] + most, "right")) - 1)
        yield Chunk(first, last, data[starts[first] : starts[last]], starts[first : last + 1] - starts[first])
        first = last


def members(letters: bytes) -> np.ndarray:
    """For each byte, whether it is among these."""
    out = np.zeros(256, bool)
    out[np.frombuffer(letters, np.uint8)] = True
    return out


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case, all other bytes as they are."""
    return np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)


class Words(NamedTuple):
    """The words of a chunk in order, the document of each, and where in the data it starts."""

    values: pa.Array
    doc: np.ndarray
    at: np.ndarray


def words(chunk: Chunk, data: np.ndarray, between: np.ndarray) -> Words:
    """Maximal runs of bytes that are not `between` (256 flags); none crosses two documents. data: the chunk's, perhaps in lower case."""
    inside = ~between[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    docs = chunk.starts[:-1][chunk.starts[:-1] < chunk.starts[1:]]
    begins[docs] = inside[docs]
    at = np.flatnonzero(begins)
    offsets = np.append(np.cumsum(inside)[at] - 1, np.count_nonzero(inside)) if len(at) else np.zeros(1, np.int64)
    values = pa.Array.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data[inside].tobytes())])
    return Words(values, np.searchsorted(chunk.starts, at, "right") - 1, at)


def ranges(firsts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers from each first on, so many of each, one after another."""
    after = np.cumsum(sizes)
    return np.repeat(firsts - (after - sizes), sizes) + np.arange(after[-1] if len(after) else 0)
