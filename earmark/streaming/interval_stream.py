"""Live activity intervals: the batch rules with a small typed state per label of a clip, many labels to a state row."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

ROW = ("window_idx", "start_s", "end_s", "score", "event_ms", "threshold", "release_ratio", "gap_s")
KEY = ("clip_id", "canonical_label", "no_clip")
RULE = ("min_duration_s", "min_windows")
# one entry of each list for every label of a clip in the slot
STATE = ", ".join(
    f"{part.split()[0]} array<{part.split()[1]}>" for part in (
        "clip bigint, label string, is_on boolean, last_start double, last_idx bigint, seen_ms bigint, min_duration double, "
        "min_windows bigint, start double, end double, peak double, total double, n bigint, due_ms bigint"
    ).split(", ")
)
OUTPUT = (
    "clip_id bigint, canonical_label string, start_s double, end_s double, peak_score double, "
    "confidence double, n_windows bigint"
)
NAMES = [part.split()[0] for part in OUTPUT.split(", ")]
# what is known of an interval: start, end, peak, sum of scores, windows, event time when it is surely over
NOTHING = (None,) * 6
# a label of a clip before its first window
FIRST = (False, None, None, None, 0.0, 1, *NOTHING)
# state rows that the labels of all clips share
SLOTS = 4096


def held_activity(scores: np.ndarray, threshold: np.ndarray, release: np.ndarray, before: bool) -> np.ndarray:
    """On at the threshold, off below threshold * release, else as the window before."""
    up = scores >= threshold
    decided = up | (scores < threshold * release)
    last = np.maximum.accumulate(np.where(decided, np.arange(len(scores)), -1))
    return np.where(last < 0, before, up[np.maximum(last, 0)])


def joined_intervals(opened: tuple, a, b, scores, due, gap) -> list[tuple]:
    """Intervals (start, end, peak, sum, windows, due) of active windows in order, the first going on from ``opened``."""
    if not len(a):
        return [] if opened[0] is None else [opened]
    reach = np.maximum.accumulate(np.concatenate([[-np.inf if opened[0] is None else opened[1]], b]))
    new = a > reach[:-1] + gap
    new[0] = new[0] or opened[0] is None
    goes_on = not new[0]
    new[0] = True
    at = np.flatnonzero(new)
    found = list(zip(
        a[at].tolist(), np.maximum.reduceat(b, at).tolist(), np.maximum.reduceat(scores, at).tolist(),
        np.add.reduceat(scores, at).tolist(), np.diff(np.append(at, len(a))).tolist(), np.fmax.reduceat(due, at).tolist(),
    ))
    found = [(*x[:5], None if x[5] != x[5] else int(x[5])) for x in found]
    if goes_on:
        x = found[0]
        late = max((d for d in (opened[5], x[5]) if d is not None), default=None)
        found[0] = (opened[0], max(opened[1], x[1]), max(opened[2], x[2]), opened[3] + x[3], opened[4] + x[4], late)
    elif opened[0] is not None:
        found.insert(0, opened)
    return found


def advanced(known: tuple, fresh_key: bool, rows: tuple, second_ms: int) -> tuple[tuple, list[tuple]]:
    """What is known of one label of a clip after its windows of a trigger, and the intervals that they closed."""
    (on, last_start, last_idx, seen, min_duration, min_windows), opened = known[:6], known[6:]
    idx, a, b, score, ms, threshold, release, gap, durations, numbers = rows
    if fresh_key:
        min_duration, min_windows = float(durations[0]), int(numbers[0])
    order = np.lexsort((idx, a))
    own, at = a[order], idx[order]
    fresh = np.append(True, (np.diff(own) > 0) | (np.diff(at) > 0))  # a repeated window counts once
    if last_start is not None:
        fresh &= (own > last_start) | ((own == last_start) & (at > last_idx))
    order = order[fresh]
    closed: list[tuple] = []
    if len(order):
        idx = idx[order]
        a, b, score, ms, threshold, release, gap = (x[order].astype(float) for x in (a, b, score, ms, threshold, release, gap))
        last_start, last_idx = float(a[-1]), int(idx[-1])
        if not np.isnan(ms).all():
            seen = int(ms[~np.isnan(ms)][-1])
        active = held_activity(score, threshold, release, on)
        on = bool(active[-1])
        due = ms + np.trunc((b - a + gap) * second_ms)
        found = joined_intervals(opened, *(x[active] for x in (a, b, score, due, gap)))
        if found:
            closed, opened = found[:-1], found[-1]
    return (on, last_start, last_idx, seen, min_duration, min_windows, *opened), closed


def rows_by_key(frames: list[pd.DataFrame]) -> Iterator[tuple[tuple, tuple]]:
    """(clip, label) and the arrays of its rows, in the order they came."""
    columns = {c: np.concatenate([f[c].to_numpy() for f in frames]) for c in (*KEY, *ROW, *RULE)}
    codes, names = pd.factorize(columns["canonical_label"], use_na_sentinel=False)
    clip, none = columns["clip_id"], columns["no_clip"].astype(bool)
    order = np.lexsort((codes, clip, none))
    changes = [np.diff(x[order]) != 0 for x in (codes, clip, none.astype(np.int8))]
    firsts = np.flatnonzero(np.append(True, changes[0] | changes[1] | changes[2]))
    for start, end in zip(firsts.tolist(), [*firsts[1:].tolist(), len(order)]):
        at = order[start:end]
        label = names[codes[at[0]]]
        key = (None if none[at[0]] else int(clip[at[0]]), label if isinstance(label, str) else None)
        yield key, tuple(columns[c][at] for c in (*ROW, *RULE))


def live_intervals(windows: DataFrame, *, delay: str = "1 hour", second_ms: int = 1000, slots: int = SLOTS) -> DataFrame:
    """Intervals of a stream of scored windows.

    Columns: clip_id, canonical_label, window_idx, start_s, end_s, score, event_time, and the rules
    threshold, release_ratio, gap_s, min_duration_s, min_windows (constant per label).
    An interval is closed by a later active window beyond its gap, or once the watermark passes its
    end plus the gap. Rows of a trigger are put in order; a row that starts before what its label
    has already processed is dropped as late. ``event_time`` is when a window starts; ``second_ms``
    is the event time, in milliseconds, that one second of ``start_s`` stands for.

    What is kept of a label of a clip: whether it is on, what was processed last, and the open interval. It does not grow
    with the number of windows. Labels of clips are dealt by hash to ``slots`` state rows, so that a trigger calls Python
    once a slot and not once a label, and the labels of a hot clip are spread over the tasks. A label that is off, has
    nothing open and was last seen before the watermark starts anew, so it leaves the state; a label that is on stays,
    as its next windows may hold.
    """

    def step(_: tuple, frames: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known = {(k[0], k[1]): k[2:] for k in zip(*state.get)} if state.exists else {}
        batches = [] if state.hasTimedOut else [f for f in frames if len(f)]
        over: dict[tuple, list[tuple]] = {}
        for key, rows in rows_by_key(batches) if batches else ():
            before = known.get(key)
            known[key], over[key] = advanced(before or FIRST, before is None, rows, second_ms)
        watermark, kept, waits, rest = state.getCurrentWatermarkMs(), [], [], []
        for key, own in known.items():
            on, seen, min_duration, min_windows, opened, closed = own[0], own[3], own[4], own[5], own[6:], over.get(key, [])
            if opened[0] is not None and opened[5] is not None and opened[5] < watermark:
                closed, opened = [*closed, opened], NOTHING
            if on or opened[0] is not None or seen is None or seen >= watermark:
                rest.append((*key, *own[:6], *opened))
                waits_for = opened[5] if opened[0] is not None else None if on else seen
                if waits_for is not None:
                    waits.append(waits_for)
            kept += [
                (*key, start, end, peak, total / n, n)
                for start, end, peak, total, n, _ in closed if end - start >= min_duration and n >= min_windows
            ]
        if rest:
            state.update(tuple(map(list, zip(*rest))))
            if waits:
                state.setTimeoutTimestamp(max(min(waits), watermark + 1))
        elif state.exists:
            state.remove()
        if kept:
            found = pd.DataFrame(kept, columns=NAMES)
            yield found.assign(clip_id=pd.array([k[0] for k in kept], dtype="Int64"))

    return (
        windows.withWatermark("event_time", delay)
        .withColumn("event_ms", F.unix_millis("event_time"))
        .withColumn("slot", F.pmod(F.xxhash64("clip_id", "canonical_label"), F.lit(slots)))
        .withColumn("no_clip", F.col("clip_id").isNull())
        .withColumn("clip_id", F.coalesce("clip_id", F.lit(0)))
        .groupBy("slot")
        .applyInPandasWithState(step, OUTPUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)
    )
