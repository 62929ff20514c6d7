"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from earmark.session import scratch_path

# characters of text that a task works on at once
SLICE_CHARS = 6_000_000
# bytes of Arrow batches that a task puts together
MERGED_BYTES = 6_000_000
# rows that travel to a Python worker at once; texts may be long
BATCH_ROWS = 1_000
_KEPT: dict[str, Any] = {}


def give_back() -> None:
    """Freed memory returns to the system where the C library can do so; otherwise a worker holds what it ever held."""
    gc.collect()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def kept(operator: str, make: Callable[[], Any]) -> Any:
    """What a worker keeps between the tasks of one operator; what it kept for another one is let go.

    A worker serves one stage after the other, and their tables together would not fit.
    """
    if operator not in _KEPT:
        _KEPT.clear()
        pa.default_memory_pool().release_unused()
        give_back()
        _KEPT[operator] = make()
    return _KEPT[operator]


def small_batches(spark: SparkSession) -> None:
    """Bound the rows of an Arrow batch, so that long texts do not pile up in one."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: computed once, lineage cut.

    The folder is the one that spark.checkpoint.dir names, so a lost executor loses none of it.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def merged(batches: Iterator[pa.RecordBatch], size: int = MERGED_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``size`` bytes, so that distinct words are looked up once for many texts."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.nbytes for b in held) >= size:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held = []
    if sum(b.num_rows for b in held):
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def sliced(batch: pa.RecordBatch, text: str, chars: int = SLICE_CHARS) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Parts of a batch with at most ``chars`` characters of text (or one row), null texts as empty."""
    texts = [t or "" for t in batch.column(text).to_pylist()]
    start = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > chars:
            yield batch.slice(start, i - start), texts[start:i]
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield batch.slice(start), texts[start:]


def text_slices(array: pa.Array, chars: int = SLICE_CHARS) -> Iterator[list[str]]:
    """The same for a single column of texts; null stays None."""
    part: list = []
    size = 0
    for t in array.to_pylist():
        if part and size + len(t or "") > chars:
            yield part
            part, size = [], 0
        part.append(t)
        size += len(t or "")
    if part:
        yield part


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def named(docs: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Just these columns, whatever else the table holds."""
    return docs.select(*quoted(columns))


def quoted(columns: Sequence[str]) -> list[Column]:
    """The columns of these names, whatever signs they hold."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in columns]


def free_name(columns: Sequence[str], name: str) -> str:
    """A name like this one that none of the columns has."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name
