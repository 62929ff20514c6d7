"""Running a stream to the end of its input into a table in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from earmark.session import scratch_path


def drain(stream: DataFrame, name: str, *, mode: str = "append") -> DataFrame:
    """Process everything available, with checkpoint and output in the shared folder."""
    spark: SparkSession = stream.sparkSession
    base = scratch_path(spark, name)
    query = (
        stream.writeStream.format("parquet")
        .outputMode(mode)
        .option("path", f"{base}/rows")
        .option("checkpointLocation", f"{base}/progress")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/rows")
