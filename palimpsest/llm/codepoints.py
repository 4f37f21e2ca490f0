"""Arrow text as numpy code points: whole columns at a time, no call per row."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa

LIMIT = sys.maxunicode + 1


def to_codes(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code points of all rows, offset of each row, validity). A null row is empty."""
    valid = np.asarray(column.is_valid())
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros(0, np.uint32), np.zeros(1, np.int64), valid
    wide = pa.types.is_large_string(column.type)
    _, where, data = column.buffers()
    ends = np.frombuffer(where, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None else np.zeros(0, np.uint8)
    ends = ends - ends[0]
    try:
        text = raw.tobytes().decode("utf-8")
    except UnicodeDecodeError:  # not UTF-8 somewhere: mend the rows one by one
        mended = [raw[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(ends[:-1], ends[1:])]
        return to_codes(pa.array([t if v else None for t, v in zip(mended, valid)], pa.large_string()))
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    if len(codes) == len(raw):
        return codes, ends, valid
    heads = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))
    return codes, heads[ends], valid


def to_text(codes: np.ndarray, offsets: np.ndarray, valid: np.ndarray) -> pa.Array:
    data = codes.astype("<u4").tobytes().decode("utf-32-le").encode("utf-8")
    sizes = 1 + (codes > 0x7F).astype(np.int64) + (codes > 0x7FF) + (codes > 0xFFFF)
    ends = np.concatenate(([0], np.cumsum(sizes)))[offsets].astype(np.int32)
    nulls = None if valid.all() else pa.py_buffer(np.packbits(valid, bitorder="little").tobytes())
    return pa.StringArray.from_buffers(len(valid), pa.py_buffer(ends.tobytes()), pa.py_buffer(data), nulls)


class CharTable:
    """For every code point the code points that replace it, none or several."""

    def __init__(self, replaced: dict[int, Sequence[int]]):
        self.length = np.ones(LIMIT, np.uint8)
        self.start = np.arange(LIMIT, dtype=np.int32)
        tail: list[int] = []
        for code, parts in replaced.items():
            self.length[code], self.start[code] = len(parts), LIMIT + len(tail)
            tail += parts
        self.pool = np.concatenate((np.arange(LIMIT, dtype=np.uint32), np.array(tail, np.uint32)))

    def apply(self, codes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lengths, starts = self.length[codes], self.start[codes]
        if lengths.size == 0 or lengths.min() == lengths.max() == 1:
            return self.pool[starts], offsets
        ends = np.cumsum(lengths, dtype=np.int64)
        total = int(ends[-1])
        out = np.repeat(starts - (ends - lengths), lengths) + np.arange(total)
        return self.pool[out], np.concatenate(([0], ends))[offsets]


def keep(mask: np.ndarray, codes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return codes[mask], np.concatenate(([0], np.cumsum(mask, dtype=np.int64)))[offsets]


def row_heads(count: int, offsets: np.ndarray) -> np.ndarray:
    """True where a row begins."""
    heads = np.zeros(count + 1, bool)
    heads[offsets] = True
    return heads[:count]


def replacements(rule: Callable[[int], Sequence[int]], below: int = 0x323B0) -> dict[int, Sequence[int]]:
    """`rule` for all code points that Unicode assigns letters or marks in, where it changes them."""
    found = {}
    for code in range(below):
        if 0xD800 <= code <= 0xDFFF:
            continue
        parts = rule(code)
        if len(parts) != 1 or parts[0] != code:
            found[code] = parts
    return found


def slices(column: pa.Array, most_bytes: int = 2_000_000) -> Iterator[tuple[int, pa.Array]]:
    """(first row, rows) in stretches of at most about `most_bytes` of text, or of one row.

    The arrays that a stretch takes stay small, and in the cache.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return
    wide = pa.types.is_large_string(column.type)
    ends = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    first = 0
    while first < len(column):
        last = int(np.searchsorted(ends, int(ends[first]) + most_bytes, side="right")) - 1
        last = min(max(last, first + 1), len(column))
        yield first, column.slice(first, last - first)
        first = last
