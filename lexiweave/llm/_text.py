"""Words of Arrow text batches, as codes into the batch's distinct words."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_UP, _LOW = bytes(range(65, 91)), bytes(range(97, 123))
#: A-Z to a-z; all else stays.
LOWER = bytes.maketrans(_UP, _LOW)
_APART = bytes([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
#: A-Z to a-z; ASCII that is neither letter nor digit to a space.
LOWER_ALNUM = bytes.maketrans(_UP + _APART, _LOW + b" " * len(_APART))


def _trim() -> None:
    """Gives free memory back: workers outlive their tasks, and an executor has several."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def trimmed(run):
    """An Arrow function that gives its free memory back when it ends: a worker that then stands idle keeps what it holds."""

    @wraps(run)
    def whole(batches):
        try:
            yield from run(batches)
        finally:
            _trim()

    return whole


def pieces_of(batches, column: int = 0, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts batches into runs of rows with about `limit` bytes of text, one row at least."""
    _trim()
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends, at = np.cumsum(size), 0
        while at < n:
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + limit, side="right")))
            yield batch.slice(at, to - at)
            at = to
    _trim()


def bytes_of(text: pa.Array) -> tuple[bytes, np.ndarray]:
    """All the text in one piece, and n+1 offsets; null counts as empty."""
    text = pc.fill_null(text.cast(pa.string()), "")
    _, offsets, data = text.buffers()
    if not len(text):
        return b"", np.zeros(1, np.int32)
    ends = np.frombuffer(offsets, np.int32)[text.offset : text.offset + len(text) + 1]
    return (data[int(ends[0]) : int(ends[-1])].to_pybytes() if data is not None else b""), ends - ends[0]


def split_words(text: pa.Array, table: bytes | None = None) -> tuple[pa.Array, np.ndarray]:
    """The words between ASCII white space, flat, and n+1 offsets by row. table: bytes to translate first."""
    data, ends = bytes_of(text)
    if table:
        data = data.translate(table)
    whole = pa.Array.from_buffers(pa.string(), len(text), [None, pa.py_buffer(np.ascontiguousarray(ends, np.int32)), pa.py_buffer(data)])
    lists = pc.ascii_split_whitespace(whole)
    flat = lists.flatten()
    at = lists.offsets.to_numpy()
    at = at - at[0]
    full = pc.binary_length(flat).to_numpy(zero_copy_only=False) > 0
    return flat.filter(pa.array(full)), np.concatenate([[0], np.cumsum(full)])[at].astype(np.int64)


def coded(words: pa.Array) -> tuple[np.ndarray, list[bytes]]:
    """Codes of the words, and the distinct words."""
    if not len(words):
        return np.empty(0, np.int64), []
    found = words.dictionary_encode()
    return found.indices.to_numpy().astype(np.int64), found.dictionary.cast(pa.binary()).to_pylist()

