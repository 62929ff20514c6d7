"""Vectors packed into rows, so that numpy compares whole blocks where Spark has put them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F


def clean(vector: Column, zero: bool) -> Column:
    """True for a vector without null or non-finite components (and, unless ``zero``, with one that is not 0)."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != float("inf")))
    some = F.exists(vector, lambda x: x != 0)
    ok = vector.isNotNull() & (F.size(vector) > 0) & finite
    return F.coalesce(ok if zero else ok & some, F.lit(False))


def matrix(column: pa.Array, dtype) -> np.ndarray:
    """Rows of a list column as a matrix."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(dtype)
    return values.reshape(len(column), -1) if len(column) else values.reshape(0, 0)


def packed(vectors: DataFrame, rows: int, dtype: str, key: str | None = None) -> DataFrame:
    """(key, ids, data, n) from (vec_id, vector[, key]): at most ``rows`` vectors of one key in a row."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        sizes: dict[int, int] = {}

        def row(k: int) -> pa.RecordBatch:
            sizes.pop(k)
            ids, data = (np.concatenate(x) for x in zip(*held.pop(k)))
            parts = [(ids[i : i + rows], data[i : i + rows]) for i in range(0, len(ids), rows)]
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([k] * len(parts), type=pa.int32()),
                    pa.array([i.tobytes() for i, _ in parts], type=pa.binary()),
                    pa.array([d.tobytes() for _, d in parts], type=pa.binary()),
                    pa.array([len(i) for i, _ in parts], type=pa.int32()),
                ],
                ["key", "ids", "data", "n"],
            )

        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column("vec_id").to_numpy(zero_copy_only=False).astype(np.int64)
            data = matrix(batch.column("vector"), dtype)
            keys = batch.column("key").to_numpy(zero_copy_only=False)
            for k in np.unique(keys):
                at = np.flatnonzero(keys == k)
                held.setdefault(int(k), []).append((ids[at], data[at]))
                sizes[int(k)] = sizes.get(int(k), 0) + len(at)
                if sizes[int(k)] >= rows:
                    yield row(int(k))
        for k in list(held):
            yield row(k)

    keyed = vectors.select("vec_id", "vector", (F.col(key) if key else F.lit(0)).cast("int").alias("key"))
    return keyed.mapInArrow(pack, "key int, ids binary, data binary, n int")


def unpacked(ids: bytes, data: bytes, dtype: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of a block."""
    own = np.frombuffer(ids, dtype=np.int64)
    return own, np.frombuffer(data, dtype=dtype).reshape(len(own), -1)


def inner(a: Column, b: Column, kind: str) -> Column:
    """Inner product of two array columns, added up in order."""
    products = F.zip_with(a, b, lambda x, y: x.cast(kind) * y.cast(kind))
    return F.aggregate(products, F.lit(0).cast(kind), lambda total, x: total + x)
