"""Small column helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

BUCKETS_PER_OCTAVE = 1024
# fine buckets: values crowded into a narrow range, say scores just below 1, still fall into many
FINE_PER_OCTAVE = 1024 * BUCKETS_PER_OCTAVE
_OCTAVE_SHIFT = 1100  # larger than any double's binary exponent


def ratio(numerator: Column, denominator: Column) -> Column:
    """``numerator / denominator`` as double, 0.0 where the denominator is 0."""
    return F.when(denominator != 0, numerator.cast("double") / denominator).otherwise(F.lit(0.0))


def share(numerator: Column, denominator: Column) -> Column:
    """``numerator / denominator`` as double, null where the denominator is 0."""
    return F.when(denominator != 0, numerator.cast("double") / denominator)


def f1_score(precision: Column, recall: Column) -> Column:
    total = precision + recall
    return F.when(total != 0, 2 * precision * recall / total).otherwise(F.lit(0.0))


def half_even_samples(seconds: float, rate: Column) -> Column:
    """Seconds to a whole number of samples, half-even, at least one."""
    return F.greatest(F.lit(1), F.bround(F.lit(float(seconds)) * rate, 0).cast("int"))


def value_bucket(value: Column, per_octave: int = BUCKETS_PER_OCTAVE) -> Column:
    """Order-preserving bucket of a number: x < y implies bucket(x) <= bucket(y), as Spark sorts.

    Null comes first, then -inf, the finite numbers, inf and NaN.

    Buckets are spaced evenly in log2, so crowding near 0 is spread over many of them. A
    float32 score has 2**23 values per octave, hence at most 8 distinct ones per fine bucket.
    The rule is plain arithmetic: every evaluation and every retry gives the same bucket.
    """
    given = value.cast("double")
    odd = F.isnan(given) | (F.abs(given) == F.lit(float("inf")))
    x = F.when(odd, F.lit(1.0)).otherwise(given)
    size = F.floor(F.log2(F.abs(x)) * per_octave) + F.lit(_OCTAVE_SHIFT * per_octave)
    last = F.lit(4 * _OCTAVE_SHIFT * per_octave).cast("long")
    # never null, so that joins on a bucket add no filter and equal scans can share one exchange
    return (
        F.when(given.isNull(), -last - 1)
        .when(F.isnan(given), last + 1)
        .when(odd, F.when(given > 0, last).otherwise(-last))
        .when(x > 0, size.cast("long"))
        .when(x < 0, -size.cast("long"))
        .otherwise(F.lit(0).cast("long"))
    )


def literal_table(spark: SparkSession, columns: str, rows: list[tuple]) -> DataFrame:
    """A configuration table of literals; ``columns`` is a DDL schema.

    It is a local relation, so Spark knows its (tiny) size and broadcasts it by itself.
    """

    def text(value: object) -> str:
        if value is None:
            return "NULL"
        if isinstance(value, str):
            return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
        if isinstance(value, float):
            return f"{value!r}D"
        return repr(value).lower() if isinstance(value, bool) else repr(value)

    fields = [part.strip().split() for part in columns.split(",")]
    values = ", ".join("(" + ", ".join(text(v) for v in row) + ")" for row in rows)
    casts = ", ".join(f"CAST({name} AS {kind}) AS {name}" for name, kind in fields)
    names = ", ".join(name for name, _ in fields)
    return spark.sql(f"SELECT {casts} FROM VALUES {values} AS t({names})")
