"""Embeddings as whole numbers: floor(64 * component), exact in 64 bits."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugework.session import materialise

SCALE = 64
# Components beyond this, times SCALE, have no exact double that differs from its neighbours.
LARGEST = 2.0 ** 52

QUANTISED = "vec_id long, vector binary"


def rows_of(column: pa.Array, dims: int) -> np.ndarray:
    """Vectors of a binary column, a row each."""
    return np.frombuffer(b"".join(column.to_pylist()), "<i8").reshape(-1, dims)


def binaries(vectors: np.ndarray) -> pa.Array:
    width = 8 * vectors.shape[1]
    raw = np.ascontiguousarray(vectors, "<i8").tobytes()
    return pa.array([raw[at:at + width] for at in range(0, len(raw), width)], pa.binary())


def commonest_length(vectors: DataFrame, vector_column: str = "embedding") -> int:
    """The number of components that most vectors have (ties: the larger); 0 without a vector that has any."""
    lengths = vectors.filter(F.size(vector_column) > 0).groupBy(F.size(vector_column).alias("dims")).count()
    found = lengths.orderBy(F.desc("count"), F.desc("dims")).limit(1).collect()
    return found[0]["dims"] if found else 0


def quantised(vectors: DataFrame, dims: int, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """``vec_id`` and the whole numbers of each vector with exactly ``dims`` components, all of them finite.

    Written down; other rows are left out. A finite component too large to be told from its neighbours is an error.
    """

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            whole = lists.flatten()
            values = whole.to_numpy(zero_copy_only=False).astype(float).reshape(-1, dims)
            known = np.isfinite(values).all(axis=1)
            if whole.null_count:
                known &= whole.is_valid().to_numpy(zero_copy_only=False).reshape(-1, dims).all(axis=1)
            steps = np.floor(values[known] * SCALE)
            if steps.size and np.abs(steps).max() >= LARGEST:
                raise ArithmeticError(f"a component, times {SCALE}, is beyond 2^52")
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).filter(pa.array(known)), binaries(steps.astype(np.int64))], names=["vec_id", "vector"])

    rows = vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector_column).cast("array<double>").alias("vector"))
    return materialise(rows.filter(F.size("vector") == dims).mapInArrow(convert, QUANTISED), "vectors")
