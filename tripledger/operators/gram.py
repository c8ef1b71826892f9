"""Sums of matrices over all rows of a table."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

PARTIAL = "i int, v array<double>"


def _rows_of(matrix: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The rows that are not all zero, with their numbers."""
    there = np.flatnonzero(matrix.any(axis=1))
    if len(there):
        ends = np.arange(0, (len(there) + 1) * matrix.shape[1], matrix.shape[1], dtype=np.int32)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(there.astype(np.int32)),
                pa.ListArray.from_arrays(ends, pa.array(matrix[there].ravel())),
            ],
            ["i", "v"],
        )


def summed_matrix(
    df: DataFrame,
    shape: tuple[int, int],
    add: Callable[[np.ndarray, Iterable[pa.RecordBatch]], None],
) -> np.ndarray:
    """The sum of the matrices that ``add`` makes of each task's batches.

    A task adds its rows up in place and sends one matrix. Rows of one number
    meet in one task, so the driver gets a single matrix of the given shape,
    however many rows or tasks there are.
    """

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        add(total, batches)
        yield from _rows_of(total)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            values = batch.column("v").flatten().to_numpy(zero_copy_only=False)
            for i, row in zip(
                batch.column("i").to_pylist(), values.reshape(-1, shape[1]), strict=True
            ):
                held[i] = held[i] + row if i in held else row
        for i, row in held.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([i], pa.int32()), pa.array([row], pa.list_(pa.float64()))], ["i", "v"]
            )

    out = np.zeros(shape)
    merged = df.mapInArrow(partial, PARTIAL).repartition("i").mapInArrow(merge, PARTIAL)
    for batch in merged.toArrow().to_batches():
        values = batch.column("v").flatten().to_numpy(zero_copy_only=False)
        out[batch.column("i").to_numpy(zero_copy_only=False)] = values.reshape(-1, shape[1])
    return out
