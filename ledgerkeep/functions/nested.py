"""Nested Arrow arrays as flat numbers: sizes, starts, owners, and slices of bounded work."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def starts(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


def spread(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For groups of these sizes: the group of each member, and its place in the group."""
    owner = np.repeat(np.arange(len(sizes)), sizes)
    return owner, np.arange(len(owner)) - starts(sizes)[owner]


def list_sizes(lists: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def pieces(work: np.ndarray, cells: int) -> Iterator[tuple[int, int]]:
    """Runs [begin, end) of rows whose work comes to about ``cells``, one row at least."""
    begin = 0
    while begin < len(work):
        end = begin + max(1, int(np.searchsorted(np.cumsum(work[begin:]), cells, side="right")))
        yield begin, end
        begin = end
