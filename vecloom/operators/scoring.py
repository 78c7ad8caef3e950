"""Exact block scoring: which points are the best k for each query.

A task sees a block of queries and a stream of point batches.  It scores a batch against the block with one
matrix product (dense) or one pass over the terms both sides share (sparse) and keeps the best k per query,
so the number of rows that leave a task is queries x k, whatever the number of points.  No (query, point)
pair is ever a row.

These classes only hold the arithmetic; Spark decides which task gets which block (see ``search``).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Scores carry six decimals, the precision of the term weights; ties are broken by id.
SCALE = 1_000_000.0
# Cells of one score matrix, and matches of query terms, held at a time in a task (some ten arrays of 8 bytes each).
CELLS = 500_000
# Squared distances below this share of the squared lengths are taken from the differences.
NEAR = 1e-3


def round6(x: np.ndarray) -> np.ndarray:
    return np.trunc(x * SCALE + np.copysign(0.5, x)) / SCALE


def as_array(column) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def millionths(weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weights as whole millionths, and which of them are exactly that."""
    whole = np.rint(weight * SCALE)
    return whole, whole / SCALE == weight


class DenseBlock:
    """Query vectors of one length, and the score of point vectors against them."""

    def __init__(self, queries: pa.Table, metric: str):
        self.ids = queries.column("query_id").to_pylist()
        self.metric = metric
        flat = as_array(queries.column("vector")).flatten().to_numpy(zero_copy_only=False)
        self.matrix = flat.astype(np.float64).reshape(len(self.ids), -1)
        self.norms = np.linalg.norm(self.matrix, axis=1)

    def rows_at_once(self) -> int:
        width = self.matrix.shape[1] if self.metric == "manhattan" else 1
        return max(1, CELLS // max(1, len(self.ids) * width))

    def scores(self, batch) -> np.ndarray:
        """(queries x points); NaN where a point is not a hit."""
        points = as_array(batch.column("vector")).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        points = points.reshape(batch.num_rows, -1)
        if self.metric == "manhattan":
            return round6(np.abs(self.matrix[:, None, :] - points[None, :, :]).sum(axis=2))
        product = self.matrix @ points.T
        if self.metric == "dot":
            return round6(product)
        if self.metric == "cosine":
            scale = self.norms[:, None] * np.linalg.norm(points, axis=1)[None, :]
            with np.errstate(invalid="ignore", divide="ignore"):
                return round6(np.where(scale > 0, product / scale, np.nan))
        sizes = (self.norms**2)[:, None] + (points**2).sum(axis=1)[None, :]
        squares = np.maximum(sizes - 2 * product, 0.0)
        # What is left of two large numbers that nearly cancel out is worked out from the differences.
        q, p = np.nonzero(squares <= NEAR * sizes)
        step = max(1, CELLS // max(1, self.matrix.shape[1]))
        for start in range(0, len(q), step):
            a, b = q[start : start + step], p[start : start + step]
            squares[a, b] = ((self.matrix[a] - points[b]) ** 2).sum(axis=1)
        return round6(np.sqrt(squares))


class SparseBlock:
    """Query terms as posting lists by index.

    Where both weights of a product are whole millionths, as those of term vectors are, it is a whole number, and a sum of such
    products is exact.  Other products are added up beside them in the order of the indices, and only the sum is rounded.
    """

    def __init__(self, queries: pa.Table):
        self.ids = queries.column("query_id").to_pylist()
        lists = as_array(queries.column("indices"))
        index = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        weight = as_array(queries.column("values")).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        owner = np.repeat(np.arange(len(self.ids)), pc.fill_null(pc.list_value_length(lists), 0).to_numpy())
        order = np.argsort(index, kind="stable")
        self.terms, self.starts = np.unique(index[order], return_index=True)
        self.counts = np.diff(np.append(self.starts, len(index)))
        self.owner = owner[order]
        self.weight = weight[order]
        self.millionths, self.whole = millionths(self.weight)

    def rows_at_once(self) -> int:
        return max(1, CELLS // max(1, len(self.ids)))

    def scores(self, batch) -> np.ndarray:
        shape = (batch.num_rows, len(self.ids))
        if not len(self.terms):
            return np.full(shape, np.nan).T
        lists = as_array(batch.column("indices"))
        row = np.repeat(np.arange(batch.num_rows), pc.fill_null(pc.list_value_length(lists), 0).to_numpy())
        index = lists.flatten().to_numpy(zero_copy_only=False)
        value = as_array(batch.column("values")).flatten().to_numpy(zero_copy_only=False)
        whole_value, is_whole = millionths(value.astype(np.float64))
        all_whole = bool(is_whole.all() and self.whole.all())
        total = np.zeros(shape[0] * shape[1])
        rest = np.zeros(1 if all_whole else len(total))
        shared = np.zeros(len(total), dtype=bool)
        at = np.searchsorted(self.terms, index)
        at[at == len(self.terms)] = 0
        known = np.flatnonzero(self.terms[at] == index)
        # A term in every query meets every row; go through the matches in slices of bounded size.
        reach = np.cumsum(self.counts[at[known]])
        slices = np.searchsorted(reach, np.arange(CELLS, (reach[-1] if len(reach) else 0) + CELLS, CELLS))
        for matched in np.split(known, slices):
            if not len(matched):
                continue
            term = at[matched]
            n = self.counts[term]
            posting = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - self.starts[term], n)
            # Matches come row by row, so a slice touches the cells of a few rows.
            low, high = row[matched[0]] * shape[1], (row[matched[-1]] + 1) * shape[1]
            cell = np.repeat(row[matched] * shape[1] - low, n) + self.owner[posting]
            product = np.repeat(whole_value[matched], n) * self.millionths[posting]
            if not all_whole:
                exact = np.repeat(is_whole[matched], n) & self.whole[posting]
                other = np.repeat(value[matched], n) * self.weight[posting]
                rest[low:high] += np.bincount(cell, weights=np.where(exact, 0.0, other), minlength=high - low)
                product = np.where(exact, product, 0.0)
            total[low:high] += np.bincount(cell, weights=product, minlength=high - low)
            shared[low:high][cell] = True
        score = np.where(rest == 0, np.floor((total + SCALE / 2) / SCALE) / SCALE, round6(total / SCALE**2 + rest))
        return np.where(shared, score, np.nan).reshape(shape).T


class BestK:
    """The best k (score, id) per query of everything offered so far."""

    def __init__(self, n_queries: int, k: int, larger_is_better: bool):
        self.k = k
        self.sign = 1.0 if larger_is_better else -1.0
        self.score = [np.empty(0)] * n_queries
        self.id = [np.empty(0, dtype=object)] * n_queries
        self.floor = np.full(n_queries, -np.inf)

    def offer(self, ids: np.ndarray, scores: np.ndarray) -> None:
        key = scores * self.sign
        with np.errstate(invalid="ignore"):
            candidate = key >= self.floor[:, None]
        candidate &= ~np.isnan(key)
        for q in np.flatnonzero(candidate.any(axis=1)):
            at = np.flatnonzero(candidate[q])
            if len(at) > self.k:
                kth = np.partition(key[q, at], len(at) - self.k)[len(at) - self.k]
                at = at[key[q, at] >= kth]
            score = np.concatenate([self.score[q], key[q, at]])
            name = np.concatenate([self.id[q], ids[at]])
            if len(score) > self.k:
                best = np.lexsort((name, -score))[: self.k]
                score, name = score[best], name[best]
                self.floor[q] = score[-1]
            elif len(score) == self.k:
                self.floor[q] = score.min()
            self.score[q], self.id[q] = score, name

    def rows(self, query_ids: list, query_type: pa.DataType):
        sizes = [len(s) for s in self.score]
        owner = np.repeat(np.arange(len(sizes)), sizes)
        score = np.concatenate(self.score) * self.sign + 0.0 if sizes else np.empty(0)
        name = np.concatenate(self.id) if sizes else np.empty(0, dtype=object)
        return pa.table(
            {
                "query_id": pa.array(query_ids, type=query_type).take(pa.array(owner, type=pa.int64())),
                "id": pa.array(name, type=pa.string()),
                "score": pa.array(score, type=pa.float64()),
            }
        )


def best_of(block, batches, k: int, larger_is_better: bool, query_type: pa.DataType) -> pa.Table:
    """Run all batches of a task through a block."""
    best = BestK(len(block.ids), k, larger_is_better)
    step = block.rows_at_once()
    for batch in batches:
        for start in range(0, batch.num_rows if block.ids else 0, step):
            part = batch.slice(start, step)
            ids = np.asarray(as_array(part.column("id")).to_pylist(), dtype=object)
            best.offer(ids, block.scores(part))
    return best.rows(block.ids, query_type)
