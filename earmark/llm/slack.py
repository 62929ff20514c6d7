"""Minimum bin slack: documents packed into windows of fixed length, next to no padding, few cuts.

Documents are cut into whole windows; what is left of each is shorter than a window, so the multiset of remaining
lengths is a histogram of at most ``capacity`` counts, however large the corpus. The plan fills one window after
another: it takes the longest remaining length and finds, by subset sums over bitsets (one bit per reachable fill, one
state per length), the remaining multiset that comes closest to the capacity. The states are traced back to how
many pieces of each length the window takes, and the same choice is repeated for as many windows as the counts allow.
Where no choice fills the window, one longer remaining piece is cut to close it and its rest goes back to the multiset. The
last, partly filled window is divided at powers of two, which need no padding.

Ranks within a length are counted by the task that writes the pieces; only (task, length) counts are summed
afterwards, so no document moves and one length may hold any share of the rows.

Defined results: a null text is empty; an empty text is one piece holding the end id; equal texts are placed on their
own; null and repeated ids are documents of their own; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from earmark.llm.common import merged, named, sliced, small_batches, written
from earmark.llm.pieces import encoder

# (task, length) counts, two numbers each, that are sent to every task instead of joined by a shuffle
MAX_SENT_COUNTS = 1_000_000
# columns of a run: first rank, pieces, start of the part in its piece, its length, first sequence, pieces per
# sequence, offset of the first, number of the run's first piece among those of its choice
RUN = ("rank", "count", "start", "length", "sequence", "per", "offset", "index")


def closest_fill(counts: dict[int, int], gap: int) -> dict[int, int]:
    """How many pieces of each length fill ``gap`` as far as any choice does; long pieces are preferred."""
    lengths = sorted((n for n, c in counts.items() if c and n <= gap), reverse=True)
    reach, states, keep = 1, [], (1 << (gap + 1)) - 1
    for length in lengths:
        states.append(reach)
        left, step = min(counts[length], gap // length), 1
        while left:  # any number up to the count is a sum of these steps
            step = min(step, left)
            reach |= (reach << step * length) & keep
            left, step = left - step, 2 * step
        if reach >> gap:
            break
    total, chosen = reach.bit_length() - 1, {}
    for length, state in zip(reversed(lengths[: len(states)]), reversed(states)):
        taken = 0
        while not state >> total & 1:
            total -= length
            taken += 1
        if taken:
            chosen[length] = taken
    return chosen


class _Pieces:
    """The multiset of remaining lengths and where its pieces come from."""

    def __init__(self, counts: dict[int, int]):
        self.counts = {n: c for n, c in counts.items() if c > 0}
        # length -> runs of (length of the whole piece, first rank, pieces, start of the part)
        self.sources = {n: deque([(n, 0, c, 0)]) for n, c in self.counts.items()}
        self.runs: dict[int, list[tuple[int, ...]]] = {}

    def take(self, length: int, n: int, used: int, sequence: int, per: int, offset: int) -> None:
        """Place ``n`` pieces of this length, ``per`` to a sequence, using ``used`` of each; the rest goes back."""
        self.counts[length] -= n
        index = 0
        while n:
            whole, rank, count, start = self.sources[length].popleft()
            own = min(n, count)
            if own < count:
                self.sources[length].appendleft((whole, rank + own, count - own, start))
            self.runs.setdefault(whole, []).append((rank, own, start, used, sequence, per, offset, index))
            if used < length:
                rest = length - used
                self.counts[rest] = self.counts.get(rest, 0) + own
                self.sources.setdefault(rest, deque()).append((whole, rank, own, start + used))
            n -= own
            index += own
        if not self.counts[length]:
            del self.counts[length]


def plan_windows(counts: dict[int, int], capacity: int) -> dict[int, np.ndarray]:
    """Runs of each length, as rows of ``RUN``; every sequence is full or a power of two long."""
    left, sequence = _Pieces(counts), 0
    while left.counts:
        longest = max(left.counts)
        others = dict(left.counts)
        others[longest] -= 1
        choice = closest_fill(others, capacity - longest)
        choice[longest] = choice.get(longest, 0) + 1
        slack = capacity - sum(n * k for n, k in choice.items())
        # what no choice could use is longer than the slack
        spare = [n for n, c in left.counts.items() if c > choice.get(n, 0)] if slack else []
        if slack and not spare:
            break
        cut = max(spare, default=0)
        windows = min(left.counts[n] // (k + (n == cut)) for n, k in (choice | ({cut: choice.get(cut, 0)} if cut else {})).items() if k or n == cut)
        offset = 0
        for length in sorted(choice, reverse=True):
            left.take(length, choice[length] * windows, length, sequence, choice[length], offset)
            offset += choice[length] * length
        if cut:
            left.take(cut, windows, slack, sequence, 1, offset)
        sequence += windows
    # the last window, a power of two at a time
    rest = sum(n * c for n, c in left.counts.items())
    while rest:
        room, offset = 1 << (rest.bit_length() - 1), 0
        rest -= room
        while room:
            length = max(left.counts)
            used = min(length, room)
            left.take(length, 1, used, sequence, 1, offset)
            room, offset = room - used, offset + used
        sequence += 1
    return {n: np.array(sorted(r), dtype=np.int64) for n, r in left.runs.items()}


def token_pieces(
    docs: DataFrame, tokenizer_path: str, *, id_col: str, text_col: str, capacity: int, end_id: int, space_counts: bool,
) -> DataFrame:
    """(<id>, part, rank, piece_start, piece_length, doc_tokens, ids) of every document, in whole windows and a rest.

    ``rank`` counts the pieces of one length within the task ``part``; ``ids`` are 16-bit where the vocabulary allows.
    """
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer_path, space_counts)
        width = id_width(len(own.edge), end_id)
        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, dtype=np.int64)
        for batch in merged(batches):
            for rows, texts in sliced(batch, "text"):
                ids, ends = own.encode(texts)
                data = np.insert(ids, ends, end_id).astype(f"<u{width}")
                ends = ends + np.arange(1, len(texts) + 1)
                tokens = np.diff(ends, prepend=0)
                pieces = -(-tokens // capacity)
                of = np.repeat(np.arange(len(texts)), pieces)
                start = (np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * capacity
                length = np.minimum(capacity, tokens[of] - start)
                order = np.argsort(length, kind="stable")
                first = np.flatnonzero(np.diff(length[order], prepend=-1))
                rank = np.empty(len(of), dtype=np.int64)
                rank[order] = np.arange(len(of)) - np.repeat(first, np.diff(np.append(first, len(of))))
                rank += seen[length]
                seen += np.bincount(length, minlength=capacity + 1)
                bounds = np.append([0], np.cumsum(length)).astype(np.int32) * width
                binary = pa.Array.from_buffers(pa.binary(), len(of), [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(data.tobytes())])
                yield pa.RecordBatch.from_arrays(
                    [
                        rows.column("id").take(pa.array(of)), pa.array(np.full(len(of), part, dtype=np.int32)), pa.array(rank),
                        pa.array(start), pa.array(length), pa.array(tokens[of]), binary,
                    ],
                    [id_col, "part", "rank", "piece_start", "piece_length", "doc_tokens", "ids"],
                )

    schema = f"`{id_col}` {kind}, part int, rank long, piece_start long, piece_length long, doc_tokens long, ids binary"
    return named(docs, [id_col, text_col]).toDF("id", "text").mapInArrow(cut, schema)


def id_width(vocabulary: int, end_id: int) -> int:
    """Bytes of a stored id."""
    return 2 if max(vocabulary, end_id + 1) <= 1 << 16 else 4


def pack(pieces: DataFrame, capacity: int, width: int, *, id_col: str, with_ids: bool = False) -> DataFrame:
    """(<id>, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids]) from written ``token_pieces``."""
    spark = pieces.sparkSession
    per_task = written(pieces.groupBy("part", "piece_length").agg(F.count("*").alias("n")), "counts")
    counts = {r["piece_length"]: r["n"] for r in per_task.groupBy("piece_length").agg(F.sum("n").alias("n")).collect()}  # at most ``capacity``
    shared = spark.sparkContext.broadcast(plan_windows(counts, capacity))  # a few runs for each length
    along = Window.partitionBy("piece_length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = per_task.select("part", "piece_length", F.coalesce(F.sum("n").over(along), F.lit(0)).alias("before"))
    if per_task.count() <= MAX_SENT_COUNTS:
        before = F.broadcast(before)
    ranked = pieces.join(before, ["part", "piece_length"])
    ranked = ranked.select(
        F.col(f"`{id_col}`").alias("id"), "piece_start", "piece_length", "doc_tokens", "ids", (F.col("rank") + F.col("before")).alias("rank")
    )

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = shared.value
        for batch in batches:
            whole, rank = (batch.column(c).to_numpy() for c in ("piece_length", "rank"))
            found = []
            for n in np.unique(whole):
                at, start = np.flatnonzero(whole == n), 0
                starts = np.zeros(len(at), dtype=np.int64)
                while len(at):
                    following = []
                    for start in np.unique(starts):
                        own = at[starts == start]
                        runs = plan[int(n)]
                        runs = runs[runs[:, 2] == start]
                        run = runs[np.searchsorted(runs[:, 0], rank[own], side="right") - 1]
                        nth = run[:, 7] + rank[own] - run[:, 0]
                        found.append(np.stack([own, run[:, 2], run[:, 3], run[:, 4] + nth // run[:, 5], run[:, 6] + nth % run[:, 5] * run[:, 3]]))
                        more = run[:, 2] + run[:, 3] < n
                        following.append(np.stack([own[more], (run[:, 2] + run[:, 3])[more]]))
                    at, starts = np.concatenate(following, axis=1)
            if not found:
                continue
            of, start, length, sequence, offset = np.concatenate(found, axis=1)
            texts = batch.column("ids").to_pylist()
            ids = [np.frombuffer(texts[i], dtype=f"<u{width}")[a : a + n].astype("<u4").tobytes() for i, a, n in zip(of.tolist(), start.tolist(), length.tolist())]
            take = pa.array(of)
            columns = [
                batch.column("id").take(take), pa.array(batch.column("piece_start").to_numpy()[of] + start), pa.array(length),
                pa.array([zlib.crc32(x) for x in ids], type=pa.int64()), batch.column("doc_tokens").take(take),
                pa.array(sequence), pa.array(offset), pa.array(ids, type=pa.binary()),
            ]
            names = [id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]
            yield pa.RecordBatch.from_arrays(columns[: 7 + with_ids], names[: 7 + with_ids])

    kind = pieces.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return ranked.mapInArrow(place, schema + ", ids binary" * with_ids)


def packed_documents(
    docs: DataFrame, tokenizer_path: str, *, capacity: int = 1024, end_id: int = 0, space_counts: bool = True,
    id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False,
) -> DataFrame:
    """Pieces of all documents with their places; the encoded pieces are written once. ``with_ids`` adds the piece's
    ids as little-endian unsigned 32-bit integers."""
    pieces = token_pieces(
        docs, tokenizer_path, id_col=id_col, text_col=text_col, capacity=capacity, end_id=end_id, space_counts=space_counts
    )
    width = id_width(len(encoder(tokenizer_path, space_counts).edge), end_id)
    return pack(written(pieces, "pieces"), capacity, width, id_col=id_col, with_ids=with_ids)


def sequences(placed: DataFrame) -> DataFrame:
    """(sequence_id, ids) from placed pieces that carry ``ids``; a group holds one sequence."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return placed.groupBy("sequence_id").agg(F.concat_ws("", F.transform(parts, lambda p: F.hex(p["ids"]))).alias("hex")).select(
        "sequence_id", F.unhex("hex").alias("ids")
    )
