"""Parts of similarity joins over sets of numbers, by whole Arrow batches.

Near-same: two sets whose common part is at least ``permille`` thousandths of
the larger one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BITS = 256


def need(n: np.ndarray, permille: int) -> np.ndarray:
    """Least common part with a set of n elements or fewer."""
    return (n * permille + 999) // 1000


def sketches(owner: np.ndarray, values: np.ndarray, count: int) -> np.ndarray:
    """A bitmap for each set. Bitmaps differ in at most as many places as the
    sets do in elements."""
    out = np.zeros((count, BITS), np.uint8)
    out[owner, (values % BITS).astype(np.int64)] = 1
    return np.packbits(out, axis=1)


def fixed_binary(rows: np.ndarray) -> pa.Array:
    width = rows.shape[1]
    offsets = pa.py_buffer(np.arange(len(rows) + 1, dtype=np.int32) * width)
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, offsets, pa.py_buffer(np.ascontiguousarray(rows))])


def as_words(column: pa.Array) -> np.ndarray:
    """Bitmaps of a binary column as rows of 64-bit words."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]]
    return data.reshape(len(column), BITS // 8).copy().view(np.uint64)


def may_match(i: np.ndarray, j: np.ndarray, n: np.ndarray, bits: np.ndarray, permille: int) -> np.ndarray:
    """False only for pairs that can't be near-same, by sizes and bitmaps."""
    a, b = n[i], n[j]
    larger = np.maximum(a, b)
    ok = np.minimum(a, b) * 1000 >= larger * permille
    at = np.flatnonzero(ok)
    room = (a + b - 2 * need(larger, permille))[at]
    apart = np.zeros(len(at), np.int64)
    i, j = i[at], j[at]
    for w in range(bits.shape[1]):
        apart += np.bitwise_count(bits[i, w] ^ bits[j, w])
    ok[at[apart > room]] = False
    return ok


def ranges(start: np.ndarray, stop: np.ndarray, most: int = 500_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(k, every number of start[k]..stop[k]), in pieces of about ``most``."""
    count = np.maximum(stop - start, 0)
    total = np.concatenate([[0], np.cumsum(count)])
    k = 0
    while k < len(start):
        to = max(k + 1, int(np.searchsorted(total, total[k] + most, "right")) - 1)
        own = np.repeat(np.arange(k, to), count[k:to])
        if len(own):
            yield own, np.arange(len(own)) - (total[own] - total[k]) + start[own]
        k = to


def pairs_within(group: np.ndarray, n: np.ndarray, permille: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of rows of one group whose sizes allow a match.
    Rows are sorted by group, then n."""
    span = np.int64(1 << 32)
    place = group * span + n
    stop = np.searchsorted(place, group * span + n * 1000 // permille, "right")
    return ranges(np.arange(len(n)) + 1, stop)


def pairs_across(group: np.ndarray, n: np.ndarray, side: np.ndarray, permille: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """As pairs_within, between rows of side 0 and rows of side 1."""
    span = np.int64(1 << 32)
    left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    place = group[right] * span + n[right]
    start = np.searchsorted(place, group[left] * span + need(n[left], permille), "left")
    stop = np.searchsorted(place, group[left] * span + n[left] * 1000 // permille, "right")
    for k, at in ranges(start, stop):
        yield left[k], right[at]


def blocks_by_key(batches: Iterator[pa.RecordBatch], least: int = 100_000) -> Iterator[pa.Table]:
    """Sorted batches as tables of at least so many rows that end where a key
    (the first column) ends."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows < least:
            continue
        table = pa.Table.from_batches(held)
        key = table.column(0).to_numpy()
        cut = int(np.searchsorted(key, key[-1], "left"))
        if cut:
            yield table.slice(0, cut).combine_chunks()
        held, rows = table.slice(cut).combine_chunks().to_batches(), table.num_rows - cut
        least = max(least, 2 * rows)
    if rows:
        yield pa.Table.from_batches(held).combine_chunks()


def group_numbers(key: np.ndarray) -> np.ndarray:
    """0, 1, 2... for the runs of equal keys."""
    new = np.zeros(len(key), np.int64)
    new[1:] = key[1:] != key[:-1]
    return np.cumsum(new)
