"""Token ids in ORC: run-length coded integers, row indexes and a Bloom filter on the document id.

``write_tokens`` range-partitions the documents by id, so that every file covers a range of ids
and its rows ascend; ORC keeps the ids of a stripe as run-length coded integers. Row indexes
(minimum and maximum of each 1,000 rows) and the Bloom filter let ``lookup`` skip files, stripes and
row groups by their metadata. Stripes are read in parallel by Spark's own splits.

Defined results: a null text is empty; an empty text has the end id alone; null document ids come
first; repeated ids stand side by side, ordered by text; an empty table gives files without rows;
columns beside id and text are not read, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import LongType

from earmark.llm.common import merged, named, sliced, small_batches
from earmark.llm.pieces import encoder

# rows of a row group that has its own index entry and Bloom filter
INDEX_STRIDE = 1_000
STRIPE_BYTES = 16 * 1024 * 1024
BLOOM_FPP = 0.01
MAX_BROADCAST_PARTS = 100_000


def write_tokens(
    docs: DataFrame, path: str, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text",
    end_id: int = 0, space_counts: bool = True, stripe_bytes: int = STRIPE_BYTES,
) -> None:
    """Write (part, part_start, <id>, n_tokens, ids) in ascending id order.

    ``part_start`` counts the ids of the same part before the document, the end id of each included.
    """
    spark = docs.sparkSession
    small_batches(spark)
    kind = docs.schema[id_col].dataType.simpleString()

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_path, space_counts).encode
        part, total = TaskContext.get().partitionId(), 0
        for batch in merged(batches):
            for rows, texts in sliced(batch, "text"):
                ids, ends = encode(texts)
                ids = np.insert(ids, ends, end_id)  # behind each document
                ends = ends + np.arange(1, len(texts) + 1)
                counts = np.diff(ends, prepend=0)
                values, offsets = pa.array(ids.view("<i4")), pa.array(np.append([0], ends).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(texts), part, dtype=np.int32)),
                        pa.array(total + ends - counts),
                        rows.column("id"),
                        pa.array(counts),
                        pa.ListArray.from_arrays(offsets, values),
                    ],
                    ["part", "part_start", id_col, "n_tokens", "ids"],
                )
                total += int(ends[-1])

    ordered = (
        named(docs, [id_col, text_col]).toDF("id", "text")
        .repartitionByRange("id")
        .sortWithinPartitions("id", "text")
    )
    schema = f"part int, part_start long, `{id_col}` {kind}, n_tokens long, ids array<int>"
    (
        ordered.mapInArrow(encoded, schema).write
        .option("compression", "zstd")
        .option("orc.stripe.size", str(stripe_bytes))
        .option("orc.row.index.stride", str(INDEX_STRIDE))
        .option("orc.bloom.filter.columns", id_col)
        .option("orc.bloom.filter.fpp", str(BLOOM_FPP))
        .orc(path)
    )


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The written rows with ``start``: the number of ids of all documents before, over all files.

    Only one total per part is summed along the parts; nothing else moves.
    """
    rows = spark.read.orc(path)
    along = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = (
        rows.groupBy("part").agg(F.sum("n_tokens").alias("_n"))
        .select("part", F.coalesce(F.sum("_n").over(along), F.lit(0)).alias("_before"))
    )
    if parts.count() <= MAX_BROADCAST_PARTS:  # two numbers a part, and a part is a task of the writer
        parts = F.broadcast(parts)
    return rows.join(parts, "part").select(
        *[c for c in rows.columns if c not in ("part", "part_start")],
        (F.col("_before") + F.col("part_start")).alias("start"),
    )


def lookup(spark: SparkSession, path: str, ids: list[int], id_col: str = "doc_id") -> DataFrame:
    """Documents by id: the filter reaches the ORC reader, which skips by indexes and Bloom filters."""
    return spark.read.orc(path).filter(F.col(id_col).isin(ids)).select(id_col, "n_tokens", "ids")


@F.arrow_udf(LongType())
def ids_crc32(ids: pa.Array) -> pa.Array:
    """Unsigned crc32 of the ids as little-endian unsigned 32-bit integers."""
    flat = ids.flatten().to_numpy(zero_copy_only=False).astype("<u4")
    bounds = np.concatenate([[0], np.cumsum([len(x) for x in ids])])
    return pa.array([zlib.crc32(flat[a:b].tobytes()) for a, b in zip(bounds[:-1], bounds[1:])], type=pa.int64())
