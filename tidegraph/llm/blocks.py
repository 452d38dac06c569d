"""Groups compared block by block in Python workers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def groups(batches, keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """(key, rows) of consecutive rows with equal first ``keys`` columns, in sorted batches.  A group must be small enough to hold."""
    key, rows = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[:keys] != key:
                if rows:
                    yield key, rows
                key, rows = row[:keys], []
            rows.append(row[keys:])
    if rows:
        yield key, rows


def least_labels(linked: np.ndarray) -> np.ndarray:
    """Of a symmetric boolean matrix: for each node the smallest index that it reaches."""
    n = len(linked)
    label = np.arange(n)
    while True:
        near = np.where(linked, label, n).min(1, initial=n)
        new = np.minimum(label, near)
        new = np.minimum(new, new[new])
        if (new == label).all():
            return label
        label = new


def batch_of(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)


def links_of(ids: list[int], weights: np.ndarray, linked: np.ndarray) -> list[tuple[int, int, int]]:
    """(id, links, smallest linked id so far) of the nodes with links.  linked: symmetric, diagonal false."""
    has = linked.any(1)
    if not has.any():
        return []
    order = np.argsort(ids, kind="stable")
    label = least_labels(linked[np.ix_(order, order)])
    root = np.empty(len(ids), np.int64)
    root[order] = np.asarray(ids)[order][label]
    count = linked @ weights
    return [(ids[i], int(count[i]), int(root[i])) for i in np.flatnonzero(has)]
