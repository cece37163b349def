"""Gram matrices: sums of products of all pairs of columns in one scan."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROWS_PER_BAND = 64  # rows of a matrix that travel together


def summed_matrices(df: DataFrame, products: Callable[[pa.RecordBatch], dict[int, np.ndarray]]) -> dict[int, np.ndarray]:
    """Sums of the matrices that `products` makes of each batch, by their number.

    A task adds up its own matrices first; bands of rows are then added by number and
    band, so no task and no message holds more than a task's sums.  The driver gets
    one matrix per number, whatever the size of the table.
    """

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            if batch.num_rows:
                for k, part in products(batch).items():
                    total[k] = total[k] + part if k in total else part
        for k, matrix in total.items():
            for at in range(0, len(matrix), ROWS_PER_BAND):
                band = np.ascontiguousarray(matrix[at : at + ROWS_PER_BAND])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k], pa.int32()), pa.array([at], pa.int32()), pa.array([band.shape[1]], pa.int32()), pa.array([band.tobytes()], pa.binary())],
                    ["k", "at", "width", "band"],
                )

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int, int], np.ndarray] = {}
        for batch in batches:
            for k, at, width, raw in zip(*[c.to_pylist() for c in batch.columns]):
                band = np.frombuffer(raw, dtype=np.float64)
                sums[k, at, width] = sums[k, at, width] + band if (k, at, width) in sums else band
        for (k, at, width), band in sums.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([k], pa.int32()), pa.array([at], pa.int32()), pa.array([width], pa.int32()), pa.array([band.tobytes()], pa.binary())],
                ["k", "at", "width", "band"],
            )

    schema = "k int, at int, width int, band binary"
    rows = df.mapInArrow(local, schema).repartition("k", "at").mapInArrow(add, schema).collect()
    out: dict[int, list[np.ndarray]] = {}
    for r in sorted(rows, key=lambda r: (r["k"], r["at"])):
        out.setdefault(r["k"], []).append(np.frombuffer(r["band"], dtype=np.float64).reshape(-1, r["width"]))
    return {k: np.concatenate(bands) for k, bands in out.items()}
