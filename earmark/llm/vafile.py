"""Exact top-k search by a vector-approximation file.

The file holds each vector as one small cell number per dimension. A scan of the cells bounds every inner product
from below and above; a vector whose upper bound stays under the k-th largest lower bound cannot be a result.
The remaining vectors are read exactly in the order of their upper bounds: first the leading ones, which fix the
k-th exact score, then those whose bound still reaches it. The result is exact.

Queries and cells meet block by block: cell blocks are dealt to stripes, query blocks visit every stripe, and a
task keeps a query's running k-th lower bound while it goes through its blocks.

Defined results: ties go to the smaller id; rows with the query's own id are no candidates; fewer candidates than k
give fewer rows; null vectors and vectors with null or non-finite components take no part; repeated rows are
separate candidates, and a repeated query id has one answer, ranked over the pairs of all its rows; empty tables give
no rows. All vectors have one length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from earmark.llm.blocks import clean, inner, matrix, packed, unpacked
from earmark.llm.common import written

BITS = 6
CELL_ROWS = 4096
QUERY_ROWS = 256
# query blocks whose running bounds a task holds
HELD_BLOCKS = 512
MAX_STRIPES = 64


def grid(vectors: DataFrame, bits: int = BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(smallest, largest, cell width) of each dimension, in whole numbers."""
    ends = (
        vectors.select(F.posexplode("vector").alias("pos", "x"))
        .groupBy("pos").agg(F.min("x").alias("lo"), F.max("x").alias("hi")).orderBy("pos").collect()  # one row a dimension
    )
    lo, hi = (np.array([r[c] for r in ends], dtype=np.int64) for c in ("lo", "hi"))
    return lo, hi, np.maximum(1, -(-(hi - lo + 1) // (1 << bits)))


def cells(vectors: DataFrame, bounds, name: str = "cells") -> DataFrame:
    """The approximation file: (stripe, ids, data, n) with one byte per dimension."""
    lo, _, width = bounds

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                codes = (matrix(batch.column("vector"), np.int64) - lo) // width
                lists = pa.array(list(codes.astype(np.int16)), type=pa.list_(pa.int16()))
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), lists], ["vec_id", "vector"])

    coded = vectors.select("vec_id", "vector").mapInArrow(code, "vec_id long, vector array<short>")
    blocks = packed(coded, CELL_ROWS, "u1")
    return written(blocks, name)


def candidates(approximation: DataFrame, queries: DataFrame, bounds, k: int) -> DataFrame:
    """(query_id, vec_id, lower, upper): per task, all vectors that may be among a query's k best."""
    lo, hi, width = bounds
    stripes = max(1, min(MAX_STRIPES, approximation.count()))
    striped = approximation.withColumn("stripe", F.pmod(F.xxhash64("ids"), F.lit(stripes)).cast("int"))
    blocks = packed(queries, QUERY_ROWS, "i8").select(
        F.explode(F.sequence(F.lit(0), F.lit(stripes - 1))).alias("stripe"), F.col("ids").alias("q_ids"), F.col("data").alias("q_data")
    )

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, tuple[np.ndarray, list]] = {}

        def out(key: bytes) -> pa.RecordBatch:
            worst, rows = held.pop(key)
            q, ids, low, up, at = (np.concatenate(x) for x in zip(*rows))
            keep = up >= worst[at]
            return pa.RecordBatch.from_arrays(
                [pa.array(x[keep].astype(np.int64)) for x in (q, ids, low, up)], ["query_id", "vec_id", "lower", "upper"]
            )

        for batch in batches:
            for ids, data, q_ids, q_data in zip(*(batch.column(c).to_pylist() for c in ("ids", "data", "q_ids", "q_data"))):
                ids, codes = unpacked(ids, data, "u1")
                queries, q = unpacked(q_ids, q_data, "i8")
                low = lo + codes.astype(np.int64) * width
                high = np.minimum(low + width - 1, hi).astype(np.float64)
                low = low.astype(np.float64)  # whole numbers below 2 ** 53: sums are exact
                plus, minus = np.maximum(q, 0).astype(np.float64), np.minimum(q, 0).astype(np.float64)
                lower = plus @ low.T + minus @ high.T
                upper = plus @ high.T + minus @ low.T
                own = queries[:, None] == ids[None, :]
                lower[own] = upper[own] = -np.inf
                if q_ids not in held:
                    if len(held) >= HELD_BLOCKS:
                        yield out(next(iter(held)))
                    held[q_ids] = (np.full(len(queries), -np.inf), [])
                worst, rows = held[q_ids]
                if len(ids) >= k:
                    np.maximum(worst, np.partition(lower, -k, axis=1)[:, -k], out=worst)
                at, which = np.nonzero((upper >= worst[:, None]) & ~own)
                rows.append((queries[at], ids[which], lower[at, which], upper[at, which], at))
        for key in list(held):
            yield out(key)

    joined = striped.join(blocks, "stripe").select("ids", "data", "q_ids", "q_data")
    return joined.mapInArrow(scan, "query_id long, vec_id long, lower long, upper long")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, bits: int = BITS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k largest inner products of whole-numbered vectors (vec_id, vector)."""
    spark = vectors.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1024")
    vectors, queries = (
        d.filter(F.col("vec_id").isNotNull() & clean(F.col("vector"), True)).select("vec_id", "vector") for d in (vectors, queries)
    )
    bounds = grid(vectors, bits)
    if not len(bounds[0]):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    approximation = cells(vectors, bounds)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "8")  # a row holds a block
    scanned = written(candidates(approximation, queries, bounds, k), "candidates")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1024")

    best = Window.partitionBy("query_id").orderBy(F.desc("lower"))
    floor = (
        scanned.select("query_id", "lower").withColumn("_n", F.row_number().over(best)).filter(F.col("_n") <= k)
        .groupBy("query_id").agg(F.when(F.count("*") == k, F.min("lower")).alias("floor"))
    )
    left = scanned.join(floor, "query_id").filter(F.col("floor").isNull() | (F.col("upper") >= F.col("floor")))
    # a pair of ids is read once, with all its rows
    left = left.groupBy("query_id", "vec_id").agg(F.max("upper").alias("upper"))
    order = Window.partitionBy("query_id").orderBy(F.desc("upper"), "vec_id")
    left = written(left.withColumn("place", F.row_number().over(order)).select("query_id", "vec_id", "upper", "place"), "left")

    asked = queries.select(F.col("vec_id").alias("query_id"), F.col("vector").alias("q"))

    def exact(rows: DataFrame) -> DataFrame:
        read = rows.join(vectors, "vec_id").join(asked, "query_id")
        return read.select("query_id", "vec_id", inner(F.col("q"), F.col("vector"), "long").alias("score"))

    leading = written(exact(left.filter(F.col("place") <= 2 * k)), "leading")
    by_score = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    kth = (
        leading.withColumn("_n", F.row_number().over(by_score)).filter(F.col("_n") <= k)
        .groupBy("query_id").agg(F.when(F.count("*") == k, F.min("score")).alias("kth"))
    )
    open_ones = left.filter(F.col("place") > 2 * k).join(kth, "query_id")
    open_ones = open_ones.filter(F.col("kth").isNull() | (F.col("upper") >= F.col("kth")))
    ranked = leading.unionByName(exact(open_ones)).withColumn("rank", F.row_number().over(by_score))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
