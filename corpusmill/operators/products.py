"""Scores of many queries with many rows as products of blocks: what a task holds is one page of rows and one block of queries.

Rows are packed where they lie into pages, queries into blocks; a page meets every block in one task, and what
may still be among a query's best goes on, a few rows more than are asked. All pairs are scored, so the work grows
with rows times queries; memory does not.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Rows in a page, queries in a block, pairs scored anew at a time.
PAGE, BLOCK, SLICE = 4096, 512, 1 << 16
#: Scores are rounded to six digits: what is less than the last of the best by more than this is none of them.
STEP = 2e-6


def matrix(column: pa.Array, dim: int, kind=np.float64) -> np.ndarray:
    """A column of lists of ``dim`` numbers as rows."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(-1, dim)


def packed(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """The rows of all batches as tables of ``rows`` rows, the last one of fewer."""
    kept: list[pa.RecordBatch] = []
    for batch in batches:
        kept.append(batch)
        while (n := sum(b.num_rows for b in kept)) >= rows:
            whole = pa.Table.from_batches(kept).combine_chunks()
            yield whole.slice(0, rows)
            kept = whole.slice(rows, n - rows).to_batches() if n > rows else []
    if any(b.num_rows for b in kept):
        yield pa.Table.from_batches(kept)


def listed(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """A list of one row: all of ``column``."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return pa.ListArray.from_arrays(pa.array([0, len(column)], pa.int32()), column)


def places(ids: pa.Array) -> np.ndarray:
    """The place of each id in the order of ids, null first."""
    out = np.empty(len(ids), np.int64)
    out[pc.array_sort_indices(ids, null_placement="at_start").to_numpy()] = np.arange(len(ids))
    return out


def squares(x: np.ndarray) -> np.ndarray:
    return dots(x, x)


def dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The products of rows, summed from the first number to the last as a fold does."""
    out = np.zeros(len(a))
    for d in range(a.shape[1]):
        out += a[:, d] * b[:, d]
    return out


def cosines(a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.where(size > 0, dots(a, b) / np.where(size > 0, size, 1), 0.0)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1 in single precision; zero rows as they are."""
    size = np.sqrt(squares(x))[:, None]
    return (x / np.where(size > 0, size, 1)).astype(np.float32)


def off(dim: int) -> float:
    """How far a cosine in single precision may lie from the true one, and a step of the rounding."""
    return STEP + 5e-7 * (dim + 8)


class Best:
    """The ``top_k`` best scores of each query of a block, page after page of a task."""

    def __init__(self, top_k: int) -> None:
        self.top_k, self.held = top_k, {}

    def among(self, block, scores: np.ndarray, slack: float, floors: np.ndarray | None = None, asked: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Query and row of ``scores`` (queries x rows) that may be among the best so far.

        ``floors``: what the last of each query's best reaches at least; ``asked``: the queries that ``scores`` is of.
        """
        k, n = self.top_k, scores.shape[1]
        if block not in self.held and floors is None:
            held, m = np.full((len(scores), k), -np.inf), min(k, n)
            held[:, k - m :] = np.sort(np.partition(scores, n - m, axis=1)[:, n - m :], axis=1)
            self.held[block] = held
            return np.nonzero(scores >= held[:, :1] - slack)
        held = self.held.setdefault(block, None if floors is None else np.repeat(floors[:, None], k, axis=1))
        asked = np.arange(len(held)) if asked is None else asked
        q, r = np.nonzero(scores >= held[asked, :1] - slack)
        told, starts = np.unique(q, return_index=True)
        for i, a, z in zip(told, starts, [*starts[1:], len(q)] if len(q) else [], strict=True):
            held[asked[i]] = np.sort(np.concatenate([held[asked[i]], scores[i, r[a:z]]]))[-k:]
        return asked[q], r


def first_of_equals(q: np.ndarray, score: np.ndarray, place: np.ndarray, top_k: int) -> np.ndarray:
    """Indices without what stands behind ``top_k`` others of the same query with the same score: copies of one row."""
    order = np.lexsort((place, -score, q))
    fresh = np.r_[True, (np.diff(q[order]) != 0) | (np.diff(score[order]) != 0)]
    at = np.arange(len(order))
    return order[at - np.maximum.accumulate(np.where(fresh, at, 0)) < top_k]


def vector_pages(batches: Iterator[pa.RecordBatch], dim: int, top_k: int) -> Iterator[pa.RecordBatch]:
    """Pages (ids, x) of rows (id, vector). Of equal vectors in a page those with the least ids stay, as many as may be found."""
    for t in packed(batches, PAGE):
        ids, x = t.column(0).combine_chunks(), matrix(t.column(1).combine_chunks(), dim)
        same = np.unique(x, axis=0, return_inverse=True)[1].ravel()
        keep = np.sort(first_of_equals(same, np.zeros(len(x)), places(ids), top_k))
        yield pa.RecordBatch.from_arrays([listed(ids.take(pa.array(keep))), pa.array([x[keep].tobytes()])], names=["ids", "x"])


def vector_blocks(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[pa.RecordBatch]:
    """Blocks (query_ids, q) of queries (query_id, vector), and of a number more of each where there is one (floors)."""
    for t in packed(batches, BLOCK):
        columns = [listed(t.column(0)), pa.array([matrix(t.column(1).combine_chunks(), dim).tobytes()]), *(pa.array([c.to_numpy().astype(np.float64).tobytes()]) for c in t.columns[2:])]
        yield pa.RecordBatch.from_arrays(columns, names=["query_ids", "q", "floors"][: len(columns)])


def nearest(batches: Iterator[pa.RecordBatch], dim: int, top_k: int, kind=np.float64, centres: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    """query_id, chunk_id, score (not rounded) from pages met by blocks (ids, x, query_ids, q): all that may be among the best of the page.

    Products in single precision say which pairs these are, with room for what they are off by; their scores
    are sums in doubles, in the order of a fold. Where ``centres`` are given a page is of a cell (cell) and a
    query has a score that its best reach (floors): queries that no vector so near to the centre can please pass by.
    """
    best, seen, blocks = Best(top_k), None, {}
    for b in batches:
        for i, (x_bytes, q_bytes) in enumerate(zip(b.column("x").to_pylist(), b.column("q").to_pylist(), strict=True)):
            if x_bytes != seen:
                x, ids = np.frombuffer(x_bytes, kind).reshape(-1, dim).astype(np.float64), b.column("ids")[i].values
                seen, x_unit, x_size, place = x_bytes, unit(x), np.sqrt(squares(x)), places(ids)
                if centres is not None:
                    centre = centres[b.column("cell")[i].as_py()]
                    radius = np.linalg.norm(x_unit - centre, axis=1).max()
            query_ids = b.column("query_ids")[i].values
            key = hash(q_bytes), query_ids[0].as_py()
            if key not in blocks:
                q = np.frombuffer(q_bytes).reshape(-1, dim)
                blocks[key] = q, unit(q), np.sqrt(squares(q))
            q, q_unit, q_size = blocks[key]
            floors = asked = None
            if centres is not None:
                floors = np.frombuffer(b.column("floors")[i].as_py())
                asked = np.nonzero(q_unit @ centre + radius * np.linalg.norm(q_unit, axis=1) >= floors - off(dim))[0]
            at_q, at_x = best.among(key, (q_unit if asked is None else q_unit[asked]) @ x_unit.T, off(dim), floors, asked)
            for s in range(0, len(at_q), SLICE):
                qs, xs = at_q[s : s + SLICE], at_x[s : s + SLICE]
                score = cosines(x[xs], q[qs], x_size[xs] * q_size[qs])
                keep = first_of_equals(qs, score, place[xs], top_k)
                yield pa.RecordBatch.from_arrays([query_ids.take(pa.array(qs[keep])), ids.take(pa.array(xs[keep])), pa.array(score[keep])], names=["query_id", "chunk_id", "score"])


def _sparse(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Which row, and which term, of all terms of all rows (lists in the second column)."""
    lists = t.column(1).combine_chunks()
    return np.repeat(np.arange(len(lists), dtype=np.int32), np.diff(lists.offsets.to_numpy())), lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)


def weight_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pages (ids, terms, rows, parts) of rows (id, terms, parts), in order of terms."""
    for t in packed(batches, PAGE):
        row, term = _sparse(t)
        part = t.column(2).combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        order = np.argsort(term, kind="stable")
        yield pa.RecordBatch.from_arrays([listed(t.column(0)), *(pa.array([v[order].tobytes()]) for v in (term, row, part))], names=["ids", "terms", "rows", "parts"])


def term_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks (query_ids, asked, queries) of queries (query_id, terms), in order of terms."""
    for t in packed(batches, BLOCK):
        row, term = _sparse(t)
        order = np.argsort(term, kind="stable")
        yield pa.RecordBatch.from_arrays([listed(t.column(0)), *(pa.array([v[order].tobytes()]) for v in (term, row))], names=["query_ids", "asked", "queries"])


def _runs(terms: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct values of sorted ``terms``, where each begins and ends."""
    distinct, starts = np.unique(terms, return_index=True)
    return distinct, starts, np.append(starts[1:], len(terms))[: len(starts)]


def heaviest(batches: Iterator[pa.RecordBatch], top_k: int) -> Iterator[pa.RecordBatch]:
    """query_id, chunk_id, score (not rounded): sums of the parts of the terms asked, from pages of ``weight_pages`` met by blocks of ``term_blocks``; all above 0 that may be among the best of the page."""
    best, seen = Best(top_k), None
    for b in batches:
        names = ("terms", "rows", "parts", "asked", "queries")
        for i, (terms, rows, parts, asked, queries) in enumerate(zip(*(b.column(c).to_pylist() for c in names), strict=True)):
            ids, query_ids = b.column("ids")[i].values, b.column("query_ids")[i].values
            if (terms, rows) != seen:
                seen, of_page, row, part, place = (terms, rows), _runs(np.frombuffer(terms, np.int64)), np.frombuffer(rows, np.int32), np.frombuffer(parts), places(ids)
            of_block, query = _runs(np.frombuffer(asked, np.int64)), np.frombuffer(queries, np.int32)
            scores = np.zeros((len(query_ids), len(ids)))
            _, p, q = np.intersect1d(of_page[0], of_block[0], assume_unique=True, return_indices=True)
            for a, z, c, d in zip(of_page[1][p].tolist(), of_page[2][p].tolist(), of_block[1][q].tolist(), of_block[2][q].tolist(), strict=True):
                if d - c == 1:
                    scores[query[c], row[a:z]] += part[a:z]
                else:
                    scores[query[c:d, None], row[a:z]] += part[a:z]
            key = hash(asked), query_ids[0].as_py()
            at_q, at_row = best.among(key, np.where(scores > 0, scores, -np.inf), STEP)
            score = scores[at_q, at_row]
            told = np.nonzero(score > 0)[0]
            keep = told[first_of_equals(at_q[told], score[told], place[at_row[told]], top_k)] if len(told) else told
            yield pa.RecordBatch.from_arrays([query_ids.take(pa.array(at_q[keep])), ids.take(pa.array(at_row[keep])), pa.array(score[keep])], names=["query_id", "chunk_id", "score"])
