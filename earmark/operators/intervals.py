"""Activity intervals: hysteresis, gap merging and summaries.

Windows of a key are ordered by (start_s, window_idx). Usual keys are plain windows over the key:
one shuffle and one sort for all steps. Where a key is too large for one task, every step works on
(key, slice) instead and passes one summary row per slice along the key, so a clip that holds a third
of all windows is spread over its slices. Slices are cut along ``start_s`` by counting each key's own
rows: the other keys are one slice each. Both ways give the same rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from earmark.functions.ordered import MAX_WINDOW_ROWS, counted_slices, join_on, oversized_keys

KEYS = ("clip_id", "canonical_label")
ORDER = ("start_s", "window_idx")


def slice_for(sized: DataFrame, keys: Sequence[str], *, limit: int = MAX_WINDOW_ROWS) -> int | None:
    """Rows of a slice: None (no slicing) unless some key has more than ``limit`` rows."""
    return None if oversized_keys(sized, keys, limit) is None else limit


def _earlier(keys: Sequence[str]):
    return Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)


def _inside(keys: Sequence[str]):
    return Window.partitionBy(*keys, "_slice").orderBy(*ORDER)


def _switch(threshold: str, release_ratio: str) -> Column:
    """True where a window switches on, False where it switches off, null where it holds."""
    on = F.col("score") >= F.col(threshold)
    off = F.col("score") < F.col(threshold) * F.col(release_ratio)
    return F.when(on, True).when(off, False)


def hysteresis(
    windows: DataFrame,
    *,
    keys: Sequence[str] = KEYS,
    threshold: str = "threshold",
    release_ratio: str = "release_ratio",
    slice_rows: float | None = None,
) -> DataFrame:
    """Add ``is_active``: on at score >= threshold, off below threshold x ratio, held in between.

    The ratio must not exceed 1 (the rule dimension rejects it): then a window either switches
    on, switches off or holds, and the state is the last switch seen.
    """
    switch = _switch(threshold, release_ratio)
    if slice_rows is None:
        whole = Window.partitionBy(*keys).orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, 0)
        state = F.last(switch, ignorenulls=True).over(whole)
        return windows.withColumn("is_active", F.coalesce(state, F.lit(False)))
    return _sliced_state(windows, keys, switch, slice_rows).select(*windows.columns, "is_active")


def _sliced_state(windows: DataFrame, keys: Sequence[str], switch: Column, slice_rows: float) -> DataFrame:
    """Rows with ``is_active``, their ``_slice``, and ``_reach``: the furthest end of the active
    windows in earlier slices.

    One summary row per slice is enough for both: the state after the slice, and the furthest end
    of the windows known to be active and of those that only hold what came before.
    """
    upto = _inside(keys).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = (
        counted_slices(windows, keys, "start_s", slice_rows)
        .withColumn("_switch", switch)
        .withColumn("_state", F.last("_switch", ignorenulls=True).over(upto))
    )
    state, end = F.col("_state"), F.col("end_s")
    after = local.groupBy(*keys, "_slice").agg(
        F.max_by("_state", F.struct(*ORDER)).alias("_after"),
        F.max(F.when(state, end)).alias("_active_end"),
        F.max(F.when(state.isNull(), end)).alias("_held_end"),
    )
    earlier = _earlier(keys)
    carried = after.withColumn("_carry", F.last("_after", ignorenulls=True).over(earlier))
    known_end = F.greatest("_active_end", F.when(F.col("_carry"), F.col("_held_end")))
    passed = carried.withColumn("_known_end", known_end).select(
        *keys, "_slice", "_carry", F.max("_known_end").over(earlier).alias("_reach")
    )
    return join_on(local, passed, [*keys, "_slice"]).withColumn(
        "is_active", F.coalesce("_state", "_carry", F.lit(False))
    )


def merge_gaps(
    windows: DataFrame,
    *,
    keys: Sequence[str] = KEYS,
    gap: str = "gap_s",
    keep: Sequence[str] = (),
    slice_rows: float | None = None,
) -> DataFrame:
    """Active windows joined into ranges: a window belongs to the running range if it starts no
    later than the range's end plus the gap. Gives start, end, peak, score sum and window count.

    ``keep`` are columns constant within a key. With slices, ranges are built per slice; only the
    first and the last range of a slice can touch a neighbour, so at most two rows per slice are
    stitched.
    """
    if slice_rows is None:
        return _merge_whole(windows.filter("is_active"), keys, gap, keep)
    active = counted_slices(windows.filter("is_active"), keys, "start_s", slice_rows)
    reach = (
        active.groupBy(*keys, "_slice")
        .agg(F.max("end_s").alias("_end"))
        .select(*keys, "_slice", F.max("_end").over(_earlier(keys)).alias("_reach"))
    )
    return _merge_sliced(join_on(active, reach, [*keys, "_slice"]), keys, gap, keep)


def _merge_sliced(active: DataFrame, keys: Sequence[str], gap: str, keep: Sequence[str]) -> DataFrame:
    """Ranges per slice from active rows with ``_slice`` and ``_reach``, then stitched."""
    inside = _inside(keys)
    before = F.max("end_s").over(inside.rowsBetween(Window.unboundedPreceding, -1))
    furthest = F.greatest(before, F.col("_reach"))
    opens = furthest.isNull() | (F.col("start_s") > furthest + F.col(gap))
    piece = F.sum("_opens").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    pieces = (
        active.withColumn("_opens", opens.cast("int"))
        .withColumn("_piece", piece)
        .groupBy(*keys, "_slice", "_piece")
        .agg(
            F.min("start_s").alias("start_s"),
            F.max("end_s").alias("end_s"),
            F.max("score").alias("peak_score"),
            F.sum("score").alias("score_sum"),
            F.count("*").alias("n_windows"),
            *[F.max(c).alias(c) for c in keep],
        )
    )
    last_piece = F.max("_piece").over(Window.partitionBy(*keys, "_slice"))
    closed = (F.col("_piece") > 0) & (F.col("_piece") < F.col("_last"))
    placed = (
        pieces.withColumn("_last", last_piece)
        .withColumn("_own_slice", F.when(closed, F.col("_slice")))
        .withColumn("_own_piece", F.when(closed, F.col("_piece")))
    )
    spot = [*keys, "_own_slice", "_own_piece"]
    chain = F.sum((F.col("_piece") > 0).cast("int")).over(
        Window.partitionBy(*spot)
        .orderBy("_slice", "_piece")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        placed.withColumn("_chain", chain)
        .groupBy(*spot, "_chain")
        .agg(
            F.min("start_s").alias("start_s"),
            F.max("end_s").alias("end_s"),
            F.max("peak_score").alias("peak_score"),
            F.sum("score_sum").alias("score_sum"),
            F.sum("n_windows").alias("n_windows"),
            *[F.max(c).alias(c) for c in keep],
        )
        .drop("_own_slice", "_own_piece", "_chain")
    )


def _merge_whole(active: DataFrame, keys: Sequence[str], gap: str, keep: Sequence[str]) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(*ORDER)
    furthest = F.max("end_s").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opens = furthest.isNull() | (F.col("start_s") > furthest + F.col(gap))
    number = F.sum("_opens").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return (
        active.withColumn("_opens", opens.cast("int"))
        .withColumn("_range", number)
        .groupBy(*keys, "_range")
        .agg(
            F.min("start_s").alias("start_s"),
            F.max("end_s").alias("end_s"),
            F.max("score").alias("peak_score"),
            F.sum("score").alias("score_sum"),
            F.count("*").alias("n_windows"),
            *[F.max(c).alias(c) for c in keep],
        )
        .drop("_range")
    )


def summarise_intervals(
    ranges: DataFrame,
    *,
    keys: Sequence[str] = KEYS,
    min_duration: str = "min_duration_s",
    min_windows: str = "min_windows",
) -> DataFrame:
    """Start, end, peak and mean score of the ranges that are long enough and have enough windows."""
    long_enough = F.col("end_s") - F.col("start_s") >= F.col(min_duration)
    return ranges.filter(long_enough & (F.col("n_windows") >= F.col(min_windows))).select(
        *keys,
        "start_s",
        "end_s",
        "peak_score",
        (F.col("score_sum") / F.col("n_windows")).alias("confidence"),
        "n_windows",
    )


def activity_intervals(
    windows: DataFrame, *, keys: Sequence[str] = KEYS, slice_rows: float | None = None
) -> DataFrame:
    """Hysteresis, gap merging and summary in one go.

    ``windows`` carries its rules: threshold, release_ratio, gap_s, min_duration_s, min_windows.
    ``slice_for`` tells whether the keys need slices.
    """
    keep = ["min_duration_s", "min_windows"]
    if slice_rows is None:
        ranges = merge_gaps(hysteresis(windows, keys=keys), keys=keys, keep=keep)
    else:
        state = _sliced_state(windows, keys, _switch("threshold", "release_ratio"), slice_rows)
        ranges = _merge_sliced(state.filter("is_active"), keys, "gap_s", keep)
    return summarise_intervals(ranges, keys=keys)
