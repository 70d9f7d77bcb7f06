"""Matrix helpers that run inside tasks on one Arrow batch or one bounded block."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

SCORE_DIGITS = 12  # scores closer than this are ties, so that equal vectors rank by id
BLOCKS = 12  # blocks that a table of vectors is cut into, as long as a task can hold one
LEAST_ROWS = 1024
BLOCK_BYTES = 1 << 25  # of a block's matrix


def block_rows(rows: int, dims: int) -> int:
    """Rows of a block. Every row meets every block at worst, so blocks grow with the table up to what a task can hold."""
    return min(max(LEAST_ROWS, -(-rows // BLOCKS)), max(1, BLOCK_BYTES // (8 * max(1, dims))))


def matrix(column) -> np.ndarray:
    """Rows of equal length as a float64 matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if len(column) == 0:
        return np.zeros((0, 0))
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def unit_rows(rows: np.ndarray) -> np.ndarray:
    norms = np.sqrt((rows * rows).sum(axis=1, keepdims=True))
    return rows / np.where(norms > 0, norms, 1.0)


def distances(rows: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Euclidean distance of each row to each point."""
    squared = (rows * rows).sum(axis=1)[:, None] + (points * points).sum(axis=1)[None, :] - 2 * rows @ points.T
    return np.sqrt(np.maximum(squared, 0.0))


def normalize_lists(column: pa.Array) -> pa.Array:
    """Each list scaled to length one; zero lists as they are, null stays null."""
    lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    owner = np.repeat(np.arange(len(column)), lengths)
    norms = np.sqrt(np.bincount(owner, weights=flat * flat, minlength=len(column)))
    scaled = flat / np.where(norms > 0, norms, 1.0)[owner]
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    nulls = column.is_null() if column.null_count else None
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(scaled), mask=nulls)


def best_rows(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, score) of the k best rows of each column; ties go to the upper row."""
    scores = np.round(scores, SCORE_DIGITS)
    n = scores.shape[0]
    if n > 4 * k:
        bar = np.partition(scores, n - k, axis=0)[n - k]
        col, row = np.nonzero((scores >= bar).T)
    else:
        col, row = np.divmod(np.arange(scores.size), n)
    value = scores[row, col]
    order = np.lexsort((row, -value, col))
    row, col, value = row[order], col[order], value[order]
    place = np.arange(len(col)) - np.searchsorted(col, col)
    kept = place < k
    return row[kept], col[kept], value[kept]


def spanning_links(near: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the bipartite graph ``near`` (rows x columns): few links, same parts."""
    links: list[tuple[int, int]] = []
    fresh_rows = near.any(axis=1)
    fresh_cols = near.any(axis=0)
    for start in np.flatnonzero(fresh_rows):
        if not fresh_rows[start]:
            continue
        fresh_rows[start] = False
        rows, cols = [start], []
        while rows or cols:
            if rows:
                r = rows.pop()
                found = np.flatnonzero(near[r] & fresh_cols)
                fresh_cols[found] = False
                links.extend((int(r), int(c)) for c in found)
                cols.extend(found)
            else:
                c = cols.pop()
                found = np.flatnonzero(near[:, c] & fresh_rows)
                fresh_rows[found] = False
                links.extend((int(r), int(c)) for r in found)
                rows.extend(found)
    return links


class Forest:
    """A spanning forest of a bipartite graph whose rows arrive in strips; its links join the parts of the whole graph."""

    def __init__(self, columns: int):
        self.part = np.arange(columns)

    def add(self, near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row of the strip, column) of the links: one from each new row to each part it touches."""
        rows, cols = [], []
        for r in np.flatnonzero(near.any(axis=1)):
            touched = np.flatnonzero(near[r])
            parts = self.part[touched]
            if (parts == parts[0]).all():
                first = [0]
            else:
                parts, first = np.unique(parts, return_index=True)
                merged = np.arange(len(self.part))
                merged[parts] = parts[0]
                self.part = merged[self.part]
            rows.append(np.full(len(first), r))
            cols.append(touched[first])
        empty = np.zeros(0, np.int64)
        return np.concatenate([empty, *rows]), np.concatenate([empty, *cols])
