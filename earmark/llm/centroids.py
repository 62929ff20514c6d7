"""Centroid clustering of whole-numbered vectors, filtered by N-simplex projection.

The squared distances of a vector to a few pivots are whole numbers and computed once. They make the vector the
apex of a simplex over the pivots: its coordinates along the pivots and its height above them. For two apexes the
Euclidean distance with the heights on one side is a lower bound of the vectors' distance, with the heights on opposite
sides an upper bound. A round compares the cached apexes with those of the centroids, drops every centroid whose
lower bound lies above another's upper bound, and decides among the rest by exact whole-number distances.
Bounds are widened by more than their rounding error, so no nearest centroid is lost.

Tasks send one partial sum per cluster and component; the driver sees clusters x components numbers a round.

Defined results: vectors that are null, of another length, or hold null or non-finite components take no part; ties
go to the smaller number; an empty cluster keeps its centroid; repeated rows are vectors of their own; a null id is
kept and comes last among the starts; fewer vectors than clusters give fewer clusters; an empty table gives no rows;
other columns are not read. Whole-numbered components must lie within 2**27 on both sides of 0, so that distances fit
64 bits; a larger one fails with that reason.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from earmark.llm.blocks import clean, matrix
from earmark.llm.common import named, written

PIVOTS = 16
LIMIT = 1 << 27
# vectors that meet all centroids at once
BLOCK_ROWS = 2_048
# a pivot nearer than this share of the largest distance to the span of the others is left out
LEAST_HEIGHT = 0.01
# width of the bounds' safety margin, as a share of the largest squared distance
MARGIN = 1e-5


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows of ``a`` to all rows of ``b``."""
    return np.stack([((a - row) ** 2).sum(axis=1) for row in b], axis=1) if len(b) else np.zeros((len(a), 0), np.int64)


@dataclass
class Simplex:
    """Pivots and their own coordinates: pivot 0 at the origin, pivot j in the first j dimensions."""

    pivots: np.ndarray
    base: np.ndarray

    @classmethod
    def over(cls, points: np.ndarray, most: int) -> Simplex:
        """Pivots among the points: each the one farthest from those before it, unless nearly inside their span."""
        chosen, near = [0], squared(points, points[:1])[:, 0]
        scale = float(np.sqrt(max(1, squared(points, points).max())))
        out = cls(points[:1], np.zeros((1, 0)))
        for i in np.argsort(-near, kind="stable"):
            far = int(np.argmax(near))
            if len(chosen) == most or near[far] == 0:
                break
            apex = out.apexes(points[far : far + 1])[0]
            if apex[-1] > LEAST_HEIGHT * scale:
                chosen.append(far)
                base = np.zeros((len(chosen), len(chosen) - 1))
                base[:-1, : out.base.shape[1]] = out.base
                base[-1] = apex
                out = cls(points[chosen], base)
            near = np.minimum(near, squared(points, points[far : far + 1])[:, 0])
        return out

    def apexes(self, x: np.ndarray) -> np.ndarray:
        """Coordinates along the pivots and, last, the height of each row."""
        d = squared(x, self.pivots).astype(np.float64)
        y = np.zeros((len(x), len(self.pivots)))
        for j in range(1, len(self.pivots)):
            own = self.base[j]
            along = (d[:, 0] - d[:, j] + own @ own) / 2 - y[:, : j - 1] @ own[: j - 1]
            y[:, j - 1] = along / own[j - 1]
        rest = d[:, 0] - (y * y).sum(axis=1)
        y[:, -1] = np.sqrt(np.maximum(rest, 0))
        return y


def nearest(x: np.ndarray, apex: np.ndarray, centroids: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(number, squared distance) of the nearest centroid of each row, and the exact distances computed."""
    flat = ((apex[:, None, :-1] - centres[None, :, :-1]) ** 2).sum(axis=2)
    lower = flat + (apex[:, None, -1] - centres[None, :, -1]) ** 2
    upper = flat + (apex[:, None, -1] + centres[None, :, -1]) ** 2
    margin = MARGIN * (1 + upper.max(initial=0))
    at, which = np.nonzero(lower <= upper.min(axis=1, keepdims=True) + margin)
    exact = np.full(lower.shape, np.iinfo(np.int64).max)
    exact[at, which] = ((x[at] - centroids[which]) ** 2).sum(axis=1)
    best = np.argmin(exact, axis=1)
    return best, exact[np.arange(len(x)), best], len(at)


def whole(vector: Column) -> Column:
    """floor(256 * x) of each component."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * 256))


def start_vectors(vectors: DataFrame, clusters: int, seed: int) -> np.ndarray:
    """The vectors whose id has the smallest digests; at most ``clusters`` rows reach the driver."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = vectors.orderBy(digest.asc_nulls_last(), "vector").limit(clusters).collect()
    return np.array([r["vector"] for r in rows], dtype=np.int64)


def prepared(vectors: DataFrame, dimensions: int, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, vector) in whole numbers: the vectors that take part."""
    table = named(vectors, [id_col, vector_col]).toDF("vec_id", "vector")
    kept = table.filter((F.size("vector") == dimensions) & clean(F.col("vector"), True))
    inside = F.forall(whole(F.col("vector")), lambda x: F.abs(x) <= LIMIT)
    vector = F.when(inside, whole(F.col("vector"))).otherwise(
        F.raise_error(F.lit("a whole-numbered component lies beyond 2**27")).cast("array<bigint>")
    )
    return kept.select("vec_id", vector.alias("vector"))


def projected(vectors: DataFrame, simplex: Simplex) -> DataFrame:
    """(vec_id, vector, apex), written once: the distances to the pivots are never computed again."""
    kind = vectors.schema["vec_id"].dataType.simpleString()

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                apex = simplex.apexes(matrix(batch.column("vector"), np.int64))
                ends = pa.array(np.arange(len(apex) + 1, dtype=np.int32) * apex.shape[1])
                apex = pa.ListArray.from_arrays(ends, pa.array(apex.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("vector"), apex], ["vec_id", "vector", "apex"])

    return written(vectors.mapInArrow(project, f"vec_id {kind}, vector array<bigint>, apex array<double>"), "apexes")


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK_ROWS):
            part = batch.slice(at, BLOCK_ROWS)
            yield part, matrix(part.column("vector"), np.int64), matrix(part.column("apex"), np.float64)


def moved(table: DataFrame, centroids: np.ndarray, simplex: Simplex) -> np.ndarray:
    """The centroids after one round: floor of sum / count, exact."""
    centres, (k, d) = simplex.apexes(centroids), centroids.shape

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros((k, d + 1), dtype=np.int64)
        for _, x, apex in _blocks(batches):
            own, _, _ = nearest(x, apex, centroids, centres)
            order = np.argsort(own, kind="stable")
            starts = np.flatnonzero(np.diff(own[order], prepend=-1))
            totals[own[order][starts], :d] += np.add.reduceat(x[order], starts, axis=0)
            totals[:, d] += np.bincount(own, minlength=k)
        used = np.flatnonzero(totals[:, d])
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.repeat(used, d + 1).astype(np.int32)),
                pa.array(np.tile(np.arange(d + 1, dtype=np.int32), len(used))),
                pa.array(totals[used].ravel()),
            ],
            ["cluster", "pos", "total"],
        )

    sums = table.select("vector", "apex").mapInArrow(partial, "cluster int, pos int, total long")
    rows = sums.groupBy("cluster", "pos").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()  # clusters x components
    found = {(r["cluster"], r["pos"]): int(r["total"]) for r in rows}
    out = centroids.copy()
    for c in {c for c, _ in found}:
        out[c] = [found[c, i] // found[c, d] for i in range(d)]
    return out


def assigned(table: DataFrame, centroids: np.ndarray, simplex: Simplex) -> DataFrame:
    """(vec_id, cluster, distance, compared) of every vector; ``compared`` counts its exact comparisons."""
    centres, kind = simplex.apexes(centroids), table.schema["vec_id"].dataType.simpleString()

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x, apex in _blocks(batches):
            own, distance, compared = nearest(x, apex, centroids, centres)
            share = np.full(len(x), compared / len(x))
            yield pa.RecordBatch.from_arrays(
                [part.column("vec_id"), pa.array(own.astype(np.int32)), pa.array(distance), pa.array(share)],
                ["vec_id", "cluster", "distance", "compared"],
            )

    return table.mapInArrow(assign, f"vec_id {kind}, cluster int, distance long, compared double")


def cluster(
    vectors: DataFrame, *, clusters: int = 40, rounds: int = 5, seed: int = 2, dimensions: int = 64,
    pivots: int = PIVOTS, id_col: str = "vec_id", vector_col: str = "embedding",
) -> tuple[DataFrame, np.ndarray]:
    """((<id>, cluster, distance, compared), centroids) after ``rounds`` rounds and one more assignment."""
    kept = prepared(vectors, dimensions, id_col, vector_col)
    centroids = start_vectors(kept, clusters, seed)
    if not len(centroids):
        kind = kept.schema["vec_id"].dataType.simpleString()
        return vectors.sparkSession.createDataFrame([], f"`{id_col}` {kind}, cluster int, distance long, compared double"), centroids
    simplex = Simplex.over(centroids, pivots)
    table = projected(kept, simplex)
    for _ in range(rounds):
        centroids = moved(table, centroids, simplex)
    return written(assigned(table, centroids, simplex).withColumnRenamed("vec_id", id_col), "assigned"), centroids


def summary(labelled: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``labelled`` with cluster_inertia, inertia and centroid_sha256; one row per cluster is joined to the vectors."""
    spark = labelled.sparkSession
    digests = [
        (i, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(centroids.tolist())
    ]
    names = spark.createDataFrame(digests, "cluster int, centroid_sha256 string")
    sums = labelled.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    total = sums.agg(F.sum("cluster_inertia").alias("inertia"))
    facts = names.join(sums, "cluster").join(F.broadcast(total))  # at most one row per cluster
    return labelled.join(F.broadcast(facts), "cluster")
