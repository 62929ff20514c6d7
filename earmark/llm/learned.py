"""Approximate nearest neighbours by learned partitions.

On a bounded sample (``SAMPLE_ROWS``) the neighbour graph is built and cut into parts of equal size by
recursive spectral bisection. One small network learns the part of a vector and deals every row of the table to a
part. A second learns in which parts a vector's neighbours lie and routes a query to the most probable
parts; how many of them is set on held-out sample queries, so that ``TARGET`` of their neighbours are covered.
Inside a part candidates are compared exactly, block by block, and the best are kept.

Defined results: ties go to the smaller id; rows with the query's own id are no candidates; fewer candidates than k
give fewer rows; fewer than ``LEAST_ROWS`` rows are one part and all compared, as there is nothing to learn from; null, zero and non-finite vectors take no part;
repeated rows are separate candidates; empty tables give no rows. All vectors have one length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from earmark.llm.blocks import clean, matrix, packed, unpacked
from earmark.llm.common import written

SAMPLE_ROWS = 6_000
HELD_OUT = 600
GRAPH_NEIGHBOURS = 10
ROUTE_NEIGHBOURS = 20
PART_ROWS = 4_096  # aimed at as long as the sample can tell so many parts apart
MAX_PARTS = 256
MIN_PARTS = 8
LEAST_ROWS = 200
# blocks of a part that one task reads; larger parts are dealt to several
TASK_BLOCKS = 16
TARGET = 0.95
HIDDEN = 128
EPOCHS = 30
BLOCK_ROWS = 2_048
QUERY_ROWS = 256
HELD_BLOCKS = 512
SEED = 7


def neighbours(queries: np.ndarray, base: np.ndarray, k: int, skip_own: bool) -> np.ndarray:
    """Places of the k largest inner products, in blocks."""
    out = []
    for i in range(0, len(queries), 512):
        scores = queries[i : i + 512] @ base.T
        if skip_own:
            own = np.arange(i, i + len(scores))
            scores[own - i, own] = -np.inf
        out.append(np.argpartition(-scores, min(k, scores.shape[1] - 1), axis=1)[:, :k])
    return np.concatenate(out)


def balanced_parts(graph: np.ndarray, parts: int) -> np.ndarray:
    """Parts of equal size with few edges between them: recursive bisection at the median of the second
    eigenvector of the neighbour graph."""
    n, k = graph.shape
    source, target = np.repeat(np.arange(n), k), graph.reshape(-1)
    rng = np.random.default_rng(SEED)
    part = np.zeros(n, dtype=np.int64)
    groups = 1
    while groups < parts:
        inside = part[source] == part[target]
        a, b = source[inside], target[inside]
        degree = np.bincount(a, minlength=n) + np.bincount(b, minlength=n) + 1.0
        y = rng.standard_normal(n)
        for _ in range(60):
            spread = np.bincount(a, y[b], n) + np.bincount(b, y[a], n) + y
            y = spread / degree
            weight = np.bincount(part, degree, groups)
            y -= (np.bincount(part, y * degree, groups) / weight)[part]
            y /= np.sqrt(np.bincount(part, y * y, groups) / np.maximum(np.bincount(part, minlength=groups), 1) + 1e-30)[part]
        order = np.lexsort((y, part))
        starts = np.searchsorted(part[order], np.arange(groups))
        rank = np.empty(n, dtype=np.int64)
        rank[order] = np.arange(n) - starts[part[order]]
        sizes = np.bincount(part, minlength=groups)
        part = 2 * part + (rank >= (sizes[part] + 1) // 2)
        groups *= 2
    return part


@dataclass
class Network:
    """One hidden layer and a softmax."""

    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(x @ self.w1 + self.b1, 0) @ self.w2 + self.b2


def train_network(x: np.ndarray, targets: np.ndarray) -> Network:
    """Minimise the cross entropy to ``targets`` (rows of shares) by stochastic gradient steps with moments."""
    rng = np.random.default_rng(SEED)
    d, parts = x.shape[1], targets.shape[1]
    scale = 1 / max(1e-12, np.sqrt((x * x).mean()))
    net = Network(
        rng.standard_normal((d, HIDDEN)) * scale * np.sqrt(2 / d), np.zeros(HIDDEN),
        rng.standard_normal((HIDDEN, parts)) * np.sqrt(1 / HIDDEN), np.zeros(parts),
    )
    weights = [net.w1, net.b1, net.w2, net.b2]
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    step = 0
    for epoch in range(EPOCHS):
        rate = 3e-3 * (1 - epoch / EPOCHS)
        for rows in np.array_split(rng.permutation(len(x)), max(1, len(x) // 128)):
            hidden = np.maximum(x[rows] @ net.w1 + net.b1, 0)
            z = hidden @ net.w2 + net.b2
            p = np.exp(z - z.max(axis=1, keepdims=True))
            back = (p / p.sum(axis=1, keepdims=True) - targets[rows]) / len(rows)
            into = (back @ net.w2.T) * (hidden > 0)
            step += 1
            for i, g in enumerate((x[rows].T @ into, into.sum(axis=0), hidden.T @ back, back.sum(axis=0))):
                first[i] += 0.1 * (g - first[i])
                second[i] += 0.001 * (g * g - second[i])
                by = rate * (scale if i == 0 else 1.0)
                weights[i] -= by * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
    return net


def leading(at: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> list[np.ndarray]:
    """The k best (query, id, score) of each query, ties to the smaller id."""
    order = np.lexsort((ids, -scores, at))
    at, ids, scores = at[order], ids[order], scores[order]
    first = np.flatnonzero(np.diff(at, prepend=-1))
    rank = np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at))))
    keep = rank < k
    return [at[keep], ids[keep], scores[keep]]


def best_pairs(q: np.ndarray, x: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, inner product) of at least the k best rows of each query.

    A matrix product picks them, with a margin for its rounding; products are then added up in order, so that
    equal vectors get equal scores.
    """
    rough = q @ x.T
    rough[own] = -np.inf
    keep = ~own
    if len(x) > k:
        margin = 1e-12 * (1 + np.abs(q).sum(axis=1) * np.abs(x).max(initial=0))
        keep &= rough >= (np.partition(rough, -k, axis=1)[:, -k] - margin)[:, None]
    at, which = np.nonzero(keep)
    scores = np.zeros(len(at))
    for d in range(q.shape[1]):
        scores += q[at, d] * x[which, d]
    return at, which, scores


@dataclass
class Index:
    blocks: DataFrame  # (key, ids, data, n): key is the part
    kind: str
    router: Network | None
    parts: int
    probes: int


def learn(sample: np.ndarray, rows: int) -> tuple[Network | None, Network | None, int, int]:
    """(assigner, router, parts, probes) from a sample of a table of ``rows`` vectors."""
    if len(sample) < LEAST_ROWS:
        return None, None, 1, 1
    parts = MIN_PARTS
    while parts < MAX_PARTS and parts * PART_ROWS < rows:
        parts *= 2
    held = min(HELD_OUT, len(sample) // 8)
    held_out, x = sample[:held], sample[held:]
    part = balanced_parts(neighbours(x, x, GRAPH_NEIGHBOURS, True), parts)
    assigner = train_network(x, np.eye(parts)[part])
    dealt = np.argmax(assigner.logits(x), axis=1)

    def shares(queries: np.ndarray, own: bool) -> np.ndarray:
        near = dealt[neighbours(queries, x, ROUTE_NEIGHBOURS, own)]
        return np.stack([(near == p).mean(axis=1) for p in range(parts)], axis=1)

    router = train_network(x, shares(x, True))
    order = np.argsort(-router.logits(held_out), axis=1, kind="stable")
    covered = np.cumsum(np.take_along_axis(shares(held_out, False), order, axis=1), axis=1).mean(axis=0)
    probes = int(np.searchsorted(covered, TARGET) + 1)
    return assigner, router, parts, min(parts - 1, probes)


def build_index(vectors: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Index:
    """Index every row of (vec_id, vector); the networks are fitted on at most ``sample_rows`` rows."""
    spark = vectors.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1024")
    usable = vectors.filter(F.col("vec_id").isNotNull() & clean(F.col("vector"), False)).select("vec_id", "vector")
    rows = usable.count()
    drawn = usable.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample_rows).collect()
    sample = np.array([r["vector"] for r in drawn], dtype=np.float64)
    assigner, router, parts, probes = learn(sample, rows)
    shared = spark.sparkContext.broadcast(assigner)

    @F.arrow_udf("int")
    def part(vector: pa.Array) -> pa.Array:
        if shared.value is None:
            return pa.array(np.zeros(len(vector), dtype=np.int32))
        return pa.array(np.argmax(shared.value.logits(matrix(vector, np.float64)), axis=1).astype(np.int32))

    kind = "f4" if "float" in usable.schema["vector"].dataType.simpleString() else "f8"
    blocks = packed(usable.withColumn("part", part("vector")), BLOCK_ROWS, kind, "part")
    return Index(written(blocks, "parts"), kind, router, parts, probes)


def search(index: Index, queries: DataFrame, k: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score): the nearest found of each query (vec_id, vector) by inner product."""
    spark = queries.sparkSession
    shared = spark.sparkContext.broadcast((index.router, index.probes))
    usable = queries.filter(F.col("vec_id").isNotNull() & clean(F.col("vector"), False)).select("vec_id", "vector")

    @F.arrow_udf("array<int>")
    def route(vector: pa.Array) -> pa.Array:
        router, probes = shared.value
        if router is None:
            return pa.array([[0]] * len(vector), type=pa.list_(pa.int32()))
        order = np.argsort(-router.logits(matrix(vector, np.float64)), axis=1, kind="stable")[:, :probes]
        return pa.array(list(order.astype(np.int32)), type=pa.list_(pa.int32()))

    routed = usable.withColumn("part", F.explode(route("vector")))
    asked = written(packed(routed, QUERY_ROWS, index.kind, "part"), "asked")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "8")  # a row holds a block

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, bytes], list[np.ndarray]] = {}

        def out(key) -> pa.RecordBatch:
            at, ids, scores = held.pop(key)
            queries = np.frombuffer(key[1], dtype=np.int64)
            return pa.RecordBatch.from_arrays([pa.array(queries[at]), pa.array(ids), pa.array(scores)], ["query_id", "vec_id", "score"])

        for batch in batches:
            for part, ids, data, q_ids, q_data in zip(
                *(batch.column(c).to_pylist() for c in ("key", "ids", "data", "q_ids", "q_data"))
            ):
                ids, x = unpacked(ids, data, index_kind)
                queries, q = unpacked(q_ids, q_data, index_kind)
                at, which, scores = best_pairs(q.astype(np.float64), x.astype(np.float64), queries[:, None] == ids[None, :], k)
                key = (part, q_ids)
                if key not in held and len(held) >= HELD_BLOCKS:
                    yield out(next(iter(held)))
                both = [at, ids[which], scores]
                if key in held:
                    both = [np.concatenate(z) for z in zip(held[key], both)]
                held[key] = leading(*both, k)
        for key in list(held):
            yield out(key)

    index_kind = index.kind
    # a part of many blocks is dealt to several tasks, each with all queries of the part
    largest = index.blocks.groupBy("key").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 1
    slices = -(-largest // TASK_BLOCKS)
    dealt = index.blocks.withColumn("slice", F.pmod(F.xxhash64("ids"), F.lit(slices)).cast("int"))
    spread = asked.select(
        "key", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"), F.col("ids").alias("q_ids"), F.col("data").alias("q_data")
    )
    met = dealt.join(spread, ["key", "slice"]).select("key", "ids", "data", "q_ids", "q_data")
    found = written(met.mapInArrow(compare, "query_id long, vec_id long, score double"), "found")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1024")
    by_score = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(by_score)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
