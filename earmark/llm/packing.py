"""Large-item matching: pack documents into as few sequences of fixed length as possible.

Which lengths share a sequence depends on the histogram of lengths alone, and lengths are bounded
by the capacity, so the plan is made from at most ``capacity`` counts, however large the corpus:

1. Pieces above a third of the capacity are matched greedily, the longest with the longest that
   still fits, at most two to a sequence.
2. Smaller pieces go, longest first, into the smallest remaining gap that takes them.

The plan gives runs: pieces of one length with ranks r, r+1, ... fill sequences b, b+1, ... . Ranks
within a length are taken per (length, slice) and offset by slice counts, so one length may hold
any share of the rows. Each document is then placed by its length and rank.

Defined results: a null text is empty; an empty text is one piece holding the end id; equal texts are
placed on their own; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import bisect
import itertools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from earmark.llm.common import merged, named, sliced, small_batches, written
from earmark.llm.pieces import encoder

# characters encoded at once; pieces that a worker keeps with their ids
SLICE_CHARS = 2_000_000
KNOWN_PIECES = 200_000
# pieces of one length that one slice holds on average
SLICE_ROWS = 20_000


def plan_bins(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Runs (length, first rank, pieces, first sequence, pieces per sequence, offset)."""
    left = {n: c for n, c in counts.items() if c > 0}
    runs: list[tuple[int, int, int, int, int, int]] = []
    rank = dict.fromkeys(left, 0)
    bins = 0
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap -> runs of sequences (first, how many)

    def put(length: int, pieces: int, first: int, per: int, offset: int) -> None:
        runs.append((length, rank[length], pieces, first, per, offset))
        rank[length] += pieces

    large = sorted(n for n in left if 3 * n > capacity)
    while large:
        longest = large[-1]
        fit = bisect.bisect_right(large, capacity - longest) - 1
        partner = large[fit] if fit >= 0 else 0
        if partner == longest and left[longest] == 1:
            partner = large[fit - 1] if fit > 0 else 0
        if not partner:
            n = left[longest]
            put(longest, n, bins, 1, 0)
        elif partner == longest:
            n = left[longest] // 2
            put(longest, 2 * n, bins, 2, 0)
        else:
            n = min(left[longest], left[partner])
            put(longest, n, bins, 1, 0)
            put(partner, n, bins, 1, longest)
        for length in {longest, partner} - {0}:
            left[length] -= n * (1 + (partner == longest))
            if not left[length]:
                large.remove(length)
        gaps.setdefault(capacity - longest - partner, []).append((bins, n))
        bins += n

    gaps.pop(0, None)
    order = sorted(gaps)

    def keep(gap: int, first: int, n: int) -> None:
        if gap and n:
            if gap not in gaps:
                bisect.insort(order, gap)
                gaps[gap] = []
            gaps[gap].append((first, n))

    for length in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        count = left[length]
        while count:
            at = bisect.bisect_left(order, length)
            if at < len(order):
                gap = order[at]
                first, n = gaps[gap].pop()
                if not gaps[gap]:
                    del gaps[gap], order[at]
            else:
                gap, first, n = capacity, bins, -(-count // (capacity // length))
                bins += n
            per = gap // length
            full = min(n, count // per)
            if full:
                put(length, full * per, first, per, capacity - gap)
                count -= full * per
                keep(gap - per * length, first, full)
            if full < n and count and count < per:
                put(length, count, first + full, per, capacity - gap)
                keep(gap - count * length, first + full, 1)
                full, count = full + 1, 0
            keep(gap, first + full, n - full)
    return runs


def token_pieces(
    docs: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text",
    capacity: int = 4096, end_id: int = 1, space_counts: bool = False, with_ids: bool = False,
) -> DataFrame:
    """(<id>, piece, start, length, ids_crc32[, ids]) of every document, cut only above ``capacity``."""
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_path, space_counts, limit=KNOWN_PIECES).ids_of
        end = np.array([end_id], dtype="<u4").tobytes()
        for batch in merged(batches, SLICE_CHARS):
            for rows, texts in sliced(batch, "text", SLICE_CHARS):
                which, starts, pieces = [], [], []
                for i, ids in enumerate(encode(texts)):
                    ids += end
                    for start in range(0, len(ids), 4 * capacity):
                        which.append(i)
                        starts.append(start // 4)
                        pieces.append(ids[start : start + 4 * capacity])
                columns = [
                    rows.column("id").take(pa.array(which, type=pa.int64())),
                    pa.array([s // capacity for s in starts], type=pa.int32()),
                    pa.array(starts, type=pa.int64()),
                    pa.array([len(p) // 4 for p in pieces], type=pa.int64()),
                    pa.array([zlib.crc32(p) for p in pieces], type=pa.int64()),
                ]
                if with_ids:
                    ends = np.cumsum([0] + [len(p) // 4 for p in pieces]).astype(np.int32)
                    values = pa.array(np.frombuffer(b"".join(pieces), dtype="<i4"))
                    columns.append(pa.ListArray.from_arrays(pa.array(ends), values))
                names = [id_col, "piece", "start", "length", "ids_crc32", "ids"][: len(columns)]
                yield pa.RecordBatch.from_arrays(columns, names)

    schema = f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return named(docs, [id_col, text_col]).toDF("id", "text").mapInArrow(cut, schema)


def pack(pieces: DataFrame, capacity: int = 4096, *, id_col: str = "doc_id") -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces with a ``length`` from 1 to ``capacity``.

    ``pieces`` is read more than once: pass a written table.
    """
    spark = pieces.sparkSession
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    runs = sorted(plan_bins(counts, capacity))
    bounds: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for length, group in itertools.groupby(runs, key=lambda r: r[0]):
        own = np.array([r[1:] for r in group], dtype=np.int64)
        bounds[length] = (own[:, 0], own)
    plan = spark.sparkContext.broadcast(bounds)  # a few runs for each of at most ``capacity`` lengths

    slices = max(1, -(-max(counts.values(), default=1) // SLICE_ROWS))
    placed = pieces.withColumn("_slice", F.pmod(F.xxhash64(id_col, "piece"), F.lit(slices)).cast("int"))
    along = Window.partitionBy("length").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy("length", "_slice").agg(F.count("*").alias("_n"))
        .select("length", "_slice", F.coalesce(F.sum("_n").over(along), F.lit(0)).alias("_before"))
    )
    inside = Window.partitionBy("length", "_slice").orderBy(id_col, "piece", "ids_crc32")
    ranked = placed.join(offsets, ["length", "_slice"]).withColumn(
        "_rank", F.row_number().over(inside) - 1 + F.col("_before")
    )

    @F.arrow_udf("struct<sequence_id: long, offset: long>")
    def place(length: pa.Array, rank: pa.Array) -> pa.Array:
        lengths, ranks = length.to_numpy(), rank.to_numpy()
        sequence, offset = np.zeros(len(ranks), np.int64), np.zeros(len(ranks), np.int64)
        for n in np.unique(lengths):
            at = np.flatnonzero(lengths == n)
            firsts, own = plan.value[int(n)]
            run = own[np.searchsorted(firsts, ranks[at], side="right") - 1]
            since = ranks[at] - run[:, 0]
            sequence[at] = run[:, 2] + since // run[:, 3]
            offset[at] = run[:, 4] + since % run[:, 3] * n
        return pa.StructArray.from_arrays([pa.array(sequence), pa.array(offset)], ["sequence_id", "offset"])

    return ranked.withColumn("_at", place("length", "_rank")).select(
        *pieces.columns, F.col("_at.sequence_id").alias("sequence_id"), F.col("_at.offset").alias("offset")
    )


def packed_documents(
    docs: DataFrame, tokenizer_path: str, *, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Pieces of all documents with their places; the encoded lengths are written once."""
    pieces = token_pieces(
        docs, tokenizer_path, id_col=id_col, text_col=text_col, capacity=capacity, end_id=end_id
    )
    return pack(written(pieces, "pieces"), capacity, id_col=id_col)


def sequences(placed: DataFrame) -> DataFrame:
    """(sequence_id, ids) from placed pieces that carry ``ids``; a group holds one sequence."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return placed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))
