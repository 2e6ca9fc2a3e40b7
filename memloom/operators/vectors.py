"""Exact nearest neighbours of a stated set of query vectors, in blocks, against all vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from memloom.session import spread

QUERY_BLOCK = 1024
LEAST_FLUSH = 1 << 18  # results that a task holds before it passes them on


def flat_vectors(column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All numbers of an array<double> column, each row's n + 1 offsets, and whether a row has neither null nor non-finite ones."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.asarray(pc.fill_null(pc.list_value_length(column), 0), np.int64)
    off = np.concatenate([[0], np.cumsum(sizes)])
    values = column.flatten()
    flat = np.asarray(pc.fill_null(values, float("nan")), np.float64)
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])
    return flat, off, (bad[off[1:]] == bad[off[:-1]]) & (sizes > 0)


def unit_rows(column, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows of one width that can be compared, with length 1, and their numbers."""
    flat, off, fine = flat_vectors(column)
    own = np.flatnonzero(fine & (np.diff(off) == width))
    x = flat[off[own][:, None] + np.arange(width)] if len(own) else np.zeros((0, width))
    most = np.abs(x).max(axis=1, initial=0)
    own, x = own[most > 0], x[most > 0] / most[most > 0, None]
    return x / np.linalg.norm(x, axis=1, keepdims=True), own


def nearest(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """query_id, id, score (cosine): at least each query's k best; `top_per_query` makes the cut in the total order.

    Queries are packed into blocks of bounded size, and batches of vectors meet every block once, in one pass over both
    tables; where the blocks are too many to be sent to every task, Spark pairs partitions instead.  Each task keeps the
    best of its rows with all ties at the k-th place, so what is shuffled doesn't grow with the vectors a task reads.
    Null, zero and differently long vectors match nothing.
    """
    kind = queries.schema["query_id"].dataType.simpleString()
    ident = pa.string() if kind == "string" else pa.int64()

    def pack(names: pa.DataType, label: str, size: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for i in range(0, b.num_rows, size):
                    part = b.slice(i, size)
                    for width in np.unique(np.asarray(pc.fill_null(pc.list_value_length(part.column(1)), 0))):
                        x, own = unit_rows(part.column(1), int(width))
                        if len(own):
                            ids = part.column(0).take(pa.array(own)).cast(names)
                            yield pa.record_batch([pa.array([int(width)], pa.int32()), pa.array([ids.to_pylist()], pa.list_(names)), pa.array([x.tobytes()], pa.binary())], names=[f"{label}_width", f"{label}_ids", f"{label}_data"])

        return run

    asked = queries.where(F.col("vector").isNotNull()).select("query_id", F.col("vector").cast("array<double>"))
    name = "string" if ident == pa.string() else "long"
    q = asked.mapInArrow(pack(ident, "q", QUERY_BLOCK), f"q_width int, q_ids array<{name}>, q_data binary")
    rows = spread(vectors.select(F.col("id").cast("string"), F.col("embedding").cast("array<double>")))
    v = rows.mapInArrow(pack(pa.string(), "v", 4 * QUERY_BLOCK), "v_width int, v_ids array<string>, v_data binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict = {}
        held = 0

        def flush() -> pa.RecordBatch:
            cols = [[], [], []]
            for query, (scores, ids) in best.items():
                cols[0] += [query] * len(scores)
                cols[1] += ids.tolist()
                cols[2] += scores.tolist()
            best.clear()
            return pa.record_batch([pa.array(cols[0], ident), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.float64())], names=["query_id", "id", "score"])

        for b in batches:
            for q_ids, q_data, v_ids, v_data, width in zip(*(b.column(i).to_pylist() for i in (1, 2, 4, 5, 0)), strict=True):
                names = np.array(v_ids, object)
                scores = np.frombuffer(q_data, np.float64).reshape(-1, width) @ np.frombuffer(v_data, np.float64).reshape(-1, width).T
                for query, row in zip(q_ids, scores, strict=True):
                    have, ids = best.get(query, (np.zeros(0), names[:0]))
                    if len(have) >= k:
                        own = np.flatnonzero(row >= have.min())
                        if not len(own):
                            continue
                        row, mine = row[own], names[own]
                    else:
                        mine = names
                    row, mine = np.concatenate([have, row]), np.concatenate([ids, mine])
                    if len(row) > k:
                        keep = row >= np.partition(row, len(row) - k)[len(row) - k]
                        row, mine = row[keep], mine[keep]
                    held += len(row) - len(have)
                    best[query] = row, mine
                if held > LEAST_FLUSH:
                    yield flush()
                    held = 0
        yield flush()

    return q.crossJoin(v).where("q_width = v_width").select("q_width", "q_ids", "q_data", "v_width", "v_ids", "v_data").mapInArrow(run, f"query_id {name}, id string, score double")
