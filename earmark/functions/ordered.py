"""Exact ordered computations that never need a whole group in one task.

A running total, a rank or a percentile over a key that holds a third of the data cannot be a
plain window over that key. The helpers cut each key into contiguous slices by a rule computed
from the row itself, do the heavy work per (key, slice), and pass only slice totals along the key.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from earmark.functions.columns import BUCKETS_PER_OCTAVE, FINE_PER_OCTAVE, value_bucket
from earmark.session import stored

# rows of one group that a single task may hold as an array
MAX_GROUP_ROWS = 200_000
# rows of one group that a single task may sort in a window (it spills to disk)
MAX_WINDOW_ROWS = 5_000_000
# rows of a part of an order that one task sorts; a task may get a few parts
PART_ROWS = 250_000
# oversized keys that may be sent to every executor
MAX_BROADCAST_KEYS = 100_000


def join_on(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on equal keys where null equals null; the key columns are those of ``left``."""
    other = right.select(*[F.col(c).alias(f"_on_{c}" if c in keys else c) for c in right.columns])
    condition = F.lit(True)
    for k in keys:
        condition = condition & F.col(k).eqNullSafe(F.col(f"_on_{k}"))
    return left.join(other, condition, how).drop(*[f"_on_{k}" for k in keys])


def key_of(keys: Sequence[str]) -> Column:
    """The key columns as one value that is never null, so that rows with a null key stay in joins."""
    return F.struct(*keys) if keys else F.lit(0)


def bucket_offsets(placed: DataFrame, measures: Mapping[str, Column]) -> DataFrame:
    """Per (``_key``, ``_bucket``): each measure's sum over earlier buckets (``_<m>_offset``) and over the key (``<m>_total``).

    Fine buckets are summed along inside a coarse one, and coarse ones along the key: neither window
    grows with the rows, and no task holds a key.
    """
    coarse = F.floor(F.col("_bucket") / (FINE_PER_OCTAVE // BUCKETS_PER_OCTAVE))
    earlier = (Window.unboundedPreceding, -1)
    fine = placed.groupBy("_key", "_bucket").agg(*[e.alias(m) for m, e in measures.items()]).withColumn("_coarse", coarse)
    inside = Window.partitionBy("_key", "_coarse").orderBy("_bucket").rowsBetween(*earlier)
    along = Window.partitionBy("_key").orderBy("_coarse").rowsBetween(*earlier)
    whole = Window.partitionBy("_key")
    steps = fine.groupBy("_key", "_coarse").agg(*[F.sum(m).alias(m) for m in measures]).select(
        "_key", "_coarse",
        *[F.coalesce(F.sum(m).over(along), F.lit(0)).alias(f"_{m}_start") for m in measures],
        *[F.sum(m).over(whole).alias(f"{m}_total") for m in measures],
    )
    within = fine.select(
        "_key", "_coarse", "_bucket", *[F.coalesce(F.sum(m).over(inside), F.lit(0)).alias(f"_{m}_inside") for m in measures]
    )
    return within.join(steps, ["_key", "_coarse"]).select(
        "_key", "_bucket",
        *[(F.col(f"_{m}_start") + F.col(f"_{m}_inside")).alias(f"_{m}_offset") for m in measures],
        *[f"{m}_total" for m in measures],
    )


def counted_slices(df: DataFrame, keys: Sequence[str], order: str, slice_rows: float, name: str = "_slice") -> DataFrame:
    """Add a slice number that does not decrease along ``order``; a slice of a key starts every ``slice_rows`` rows or so.

    The cuts come from each key's own rows: a key of no more rows is one slice, and rows whose ``order`` is equal to
    about six digits stay together.
    """
    placed = df.withColumn("_bucket", value_bucket(F.col(order), FINE_PER_OCTAVE)).withColumn("_key", key_of(keys))
    offsets = bucket_offsets(placed, {"n": F.count("*")})
    cut = F.floor(F.col("_n_offset") / F.lit(float(slice_rows)))
    return placed.join(offsets, ["_key", "_bucket"]).select(*df.columns, cut.alias(name))


def running_totals(
    table: DataFrame,
    keys: Sequence[str],
    value: str,
    measures: Sequence[str],
    *,
    descending: bool = False,
    then: Sequence[str] = (),
    sized_by: DataFrame | None = None,
) -> DataFrame:
    """Add ``<m>_before`` (sum over earlier rows) and ``<m>_total`` (sum over the key) per measure.

    Order is by ``value``, then the ``then`` columns ascending; with them it must be total within a key, or rows
    that are equal in it come in any order. One range shuffle along (key, value, then) deals the rows into parts of
    about equal size (of ``PART_ROWS`` rows at most or so), whatever share a key or a value has, and the rows are stored with
    their part. Only the totals of (part, key), fewer than parts and keys together, are summed along a key.
    ``sized_by`` has as many rows and is cheaper to count.
    """
    # the caller's columns may themselves be called _key
    own = {c: f"_own_{c}" for c in table.columns}
    direction = F.col(own[value]).desc() if descending else F.col(own[value]).asc()
    order = [direction, *[F.col(own[c]).asc() for c in then]]
    placed = table.select(*[F.col(f"`{c}`").alias(n) for c, n in own.items()], key_of(keys).alias("_key"))
    # the part is read back from the written rows, so that a retry cannot deal them anew
    n = row_parts(table if sized_by is None else sized_by)
    dealt = placed.repartitionByRange("_key", *order) if n is None else placed.repartitionByRange(n, "_key", *order)
    parted = stored(dealt.withColumn("_part", F.spark_partition_id()), "ordered")
    along = Window.partitionBy("_key").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    whole, inside = Window.partitionBy("_key"), Window.partitionBy("_part", "_key").orderBy(*order)
    inside = inside.rowsBetween(Window.unboundedPreceding, -1)
    totals = parted.groupBy("_part", "_key").agg(*[F.sum(own[m]).alias(m) for m in measures]).select(
        "_part", "_key",
        *[F.coalesce(F.sum(m).over(along), F.lit(0)).alias(f"_{m}_offset") for m in measures],
        *[F.sum(m).over(whole).alias(f"{m}_total") for m in measures],
    )
    # summed along before the join, so that the rows are sorted once, for both
    together = parted if n is None else parted.repartition(n, "_part", "_key")
    summed = together.select("*", *[F.coalesce(F.sum(own[m]).over(inside), F.lit(0)).alias(f"_{m}_inside") for m in measures])
    return summed.join(totals, ["_part", "_key"]).select(
        *[F.col(n).alias(c) for c, n in own.items()],
        *[(F.col(f"_{m}_inside") + F.col(f"_{m}_offset")).alias(f"{m}_before") for m in measures],
        *[f"{m}_total" for m in measures],
    )


def row_parts(table: DataFrame, rows: int | None = None) -> int | None:
    """Parts of about ``rows`` rows each, or None where the session's shuffle partitions are enough of them.

    The session's number is fixed, so parts would grow with the table; the count reads no column it can do without.
    """
    parts = -(-table.count() // (rows or PART_ROWS))
    return parts if parts > int(table.sparkSession.conf.get("spark.sql.shuffle.partitions")) else None


def dense_index(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str, *, limit: int = MAX_WINDOW_ROWS
) -> DataFrame:
    """Position 0, 1, 2, ... within a key; the first order column must be numeric.

    With a key of more than ``limit`` rows, counts per (key, slice of the first order column) give
    each slice its offset, so a hot key is numbered by many tasks.
    """
    if oversized_keys(df, keys, limit) is None:
        position = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1
        return df.withColumn(name, position.cast("long"))
    placed = df.withColumn("_bucket", value_bucket(F.col(order[0]), FINE_PER_OCTAVE)).withColumn("_key", key_of(keys))
    offsets = bucket_offsets(placed, {"n": F.count("*")})
    inside = Window.partitionBy("_key", "_bucket").orderBy(*order)
    return (
        placed.join(offsets, ["_key", "_bucket"])
        .withColumn(name, F.row_number().over(inside) - 1 + F.col("_n_offset"))
        .select(*df.columns, F.col(name).cast("long").alias(name))
    )


def oversized_keys(df: DataFrame, keys: Sequence[str], limit: int) -> DataFrame | None:
    """Keys with more than ``limit`` rows, or None when there are none.

    Counting reads only the key columns and combines before the shuffle.
    """
    return large_keys(df.groupBy(*keys).agg(F.count("*").alias("_n")), keys, limit)


def large_keys(sizes: DataFrame, keys: Sequence[str], limit: int) -> DataFrame | None:
    """Keys whose size ``_n`` is above ``limit``, or None when there are none.

    The number found is checked here: up to MAX_BROADCAST_KEYS are marked for broadcast, more are joined by shuffle.
    """
    big = sizes.filter(F.col("_n") > limit).select(*keys)
    found = big.limit(MAX_BROADCAST_KEYS + 1).count()
    if found == 0:
        return None
    return F.broadcast(big) if found <= MAX_BROADCAST_KEYS else big


def _pick(sorted_values: Column, p: float) -> Column:
    """Linearly interpolated percentile of a non-empty ascending array."""
    rank = F.lit(float(p)) * (F.size(sorted_values) - 1)
    low = F.element_at(sorted_values, (F.floor(rank) + 1).cast("int"))
    high = F.element_at(sorted_values, (F.ceil(rank) + 1).cast("int"))
    return low + (high - low) * (rank - F.floor(rank))


def _top_mean(sorted_values: Column, fraction: float) -> Column:
    k = _top_count(F.size(sorted_values), fraction)
    top = F.slice(sorted_values, F.size(sorted_values) - k + 1, k)
    return F.aggregate(top, F.lit(0.0), lambda total, x: total + x) / k


def _top_count(n: Column, fraction: float) -> Column:
    return F.greatest(F.lit(1), F.ceil(n * F.lit(float(fraction)))).cast("int")


def order_statistics(
    df: DataFrame,
    keys: Sequence[str],
    percentiles: Mapping[str, tuple[str, float]],
    *,
    top_means: Mapping[str, tuple[str, float]] | None = None,
    aggregates: Mapping[str, Column] | None = None,
    limit: int = MAX_GROUP_ROWS,
    sizes: DataFrame | None = None,
    known_small: bool = False,
) -> DataFrame:
    """Exact percentiles ``{out: (column, p)}`` and means of the top share per key.

    Groups of at most ``limit`` rows take one shuffle: their values travel as one bounded sorted
    array. Larger groups go through value histograms and running totals instead; both are exact.
    Null values are ignored. ``aggregates`` are ordinary aggregates computed alongside.
    ``sizes`` (keys, ``_n``) holds no less than each group's rows where that is cheaper to count on a source than on a
    derived table. ``known_small`` skips the size check where the caller has made it.
    """
    tops = dict(top_means or {})
    extra = dict(aggregates or {})
    columns = list(dict.fromkeys(c for c, _ in [*percentiles.values(), *tops.values()]))
    big = None
    if not known_small:
        big = oversized_keys(df, keys, limit) if sizes is None else large_keys(sizes, keys, limit)
    usual = df if big is None else join_on(df, big, keys, "left_anti") if keys else df.limit(0)

    arrays = usual.groupBy(*keys).agg(
        *[F.sort_array(F.collect_list(c)).alias(f"_values_{c}") for c in columns],
        *[e.alias(n) for n, e in extra.items()],
    )

    def values_of(c: str) -> Column:
        return F.col(f"_values_{c}")

    result = arrays.select(
        *keys,
        *extra,
        *[
            F.when(F.size(values_of(c)) > 0, _pick(values_of(c), p)).alias(out)
            for out, (c, p) in percentiles.items()
        ],
        *[
            F.when(F.size(values_of(c)) > 0, _top_mean(values_of(c), f)).alias(out)
            for out, (c, f) in tops.items()
        ],
    )
    if big is None:
        return result
    if not keys:
        return _large_order_statistics(df, keys, columns, percentiles, tops, extra)
    large = _large_order_statistics(
        join_on(df, big, keys, "left_semi"), keys, columns, percentiles, tops, extra
    )
    return result.unionByName(large)


def _large_order_statistics(df, keys, columns, percentiles, tops, extra) -> DataFrame:
    pairs = ", ".join(f"'{c}', cast({c} as double)" for c in columns)
    hist = (
        df.selectExpr(*keys, f"stack({len(columns)}, {pairs}) as (_name, _value)")
        .filter(F.col("_value").isNotNull())
        .groupBy(*keys, "_name", "_value")
        .agg(F.count("*").alias("_n"))
    )
    ranked = running_totals(hist, [*keys, "_name"], "_value", ["_n"])
    first, after, total = F.col("_n_before"), F.col("_n_before") + F.col("_n"), F.col("_n_total")

    picks: list[Column] = []
    finals: list[Column] = []
    for out, (c, p) in percentiles.items():
        rank = F.lit(float(p)) * (total - 1)
        for side, position in (("lo", F.floor(rank)), ("hi", F.ceil(rank))):
            holds = (F.col("_name") == c) & (first <= position) & (position < after)
            picks.append(F.max(F.when(holds, F.col("_value"))).alias(f"_{out}_{side}"))
        part = F.max(F.when(F.col("_name") == c, rank - F.floor(rank)))
        picks.append(part.alias(f"_{out}_part"))
        low, high = F.col(f"_{out}_lo"), F.col(f"_{out}_hi")
        finals.append((low + (high - low) * F.col(f"_{out}_part")).alias(out))
    for out, (c, f) in tops.items():
        k = _top_count(total, f)
        taken = F.greatest(F.lit(0), after - F.greatest(first, total - k))
        counts = (F.col("_name") == c) & (taken > 0)  # no share of an infinite value is not a number
        picks.append(F.sum(F.when(counts, taken * F.col("_value") / k)).alias(f"_{out}"))
        finals.append(F.col(f"_{out}").alias(out))
    picked = ranked.groupBy(*keys).agg(*picks)
    if not keys and not extra:
        return picked.select(*finals)
    # every group has its row, also one whose values are all null
    alongside = df.groupBy(*keys).agg(*[e.alias(n) for n, e in extra.items()]) if extra else df.select(*keys).distinct()
    joined = join_on(alongside, picked, keys, "left") if keys else picked.crossJoin(alongside)
    return joined.select(*keys, *extra, *finals)


def previous_value(
    df: DataFrame, keys: Sequence[str], index: str, value: str, name: str, slice_rows: int = 65_536
) -> DataFrame:
    """Value at ``index - 1`` of the same key, for an index without gaps.

    The last row of a slice is copied into the next slice as a guide row, so ``lag`` inside
    (key, slice) sees it; no join, and a hot key is spread over its slices.
    """
    at = F.floor(F.col(index) / slice_rows)
    last_of_slice = (F.col(index) + 1) % slice_rows == 0
    copies = F.when(last_of_slice, F.array(at, at + 1)).otherwise(F.array(at))
    inside = Window.partitionBy(*keys, "_slice").orderBy(index)
    return (
        df.withColumn("_slice", F.explode(copies))
        .withColumn(name, F.lag(value).over(inside))
        .filter(F.col("_slice") == at)
        .drop("_slice")
    )


def ordered_changes(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    value: str,
    difference,
    *,
    slice_of: Column,
    total: str,
    pairs: str,
) -> DataFrame:
    """Per key: sum of ``difference(previous, current)`` over consecutive rows, and their number.

    Inside a slice ``lag`` does the work; across slices only each slice's first and last value
    are compared, one row per slice. ``slice_of`` must not decrease along ``order``.
    """
    inside = Window.partitionBy(*keys, "_slice").orderBy(order)
    stepped = df.select(*keys, order, value, slice_of.alias("_slice")).withColumn(
        "_step", difference(F.lag(value).over(inside), F.col(value))
    )
    slices = stepped.groupBy(*keys, "_slice").agg(
        F.sum("_step").alias("_sum"),
        F.count("_step").alias("_pairs"),
        F.min_by(value, order).alias("_first"),
        F.max_by(value, order).alias("_last"),
    )
    along = Window.partitionBy(*keys).orderBy("_slice")
    joins = slices.withColumn("_joint", difference(F.lag("_last").over(along), F.col("_first")))
    return joins.groupBy(*keys).agg(
        (F.coalesce(F.sum("_sum"), F.lit(0)) + F.coalesce(F.sum("_joint"), F.lit(0)))
        .cast("double")
        .alias(total),
        (F.sum("_pairs") + F.count("_joint")).alias(pairs),
    )


def with_key_totals(
    df: DataFrame, keys: Sequence[str], slice_of: Column, totals: Mapping[str, Column]
) -> DataFrame:
    """Add per-key maxima to every row without joining on the bare key.

    ``totals`` maps a name to an expression of which the maximum over the key is wanted. Maxima
    are taken per (key, slice), then along the few slices of a key, and joined on (key, slice).
    """
    placed = df.withColumn("_slice", slice_of)
    whole = Window.partitionBy(*keys)
    parts = placed.groupBy(*keys, "_slice").agg(*[F.max(e).alias(n) for n, e in totals.items()])
    joined = parts.select(*keys, "_slice", *[F.max(n).over(whole).alias(n) for n in totals])
    return placed.join(joined, [*keys, "_slice"]).drop("_slice")
