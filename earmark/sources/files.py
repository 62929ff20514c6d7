"""File sources and sinks: scores, tracks, numbered lines, manifests, results, review sessions."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from earmark import constants as C
from earmark.functions.ordered import running_totals

LABELLED = "label string, target int, model_score double"
PREDICTIONS = (
    "sample_id string, dataset string, split string, label string, target int, model_score double"
)
FORM_FIELD = (
    "struct<field_name: string, instrument_label: string, decision: string>"
)
REVIEW_EVENT = (
    f"struct<field_id: string, outcome: string, original_prediction: {FORM_FIELD}, final_value: string, "
    "edit_description: string, threshold_profile_name: string, field_elapsed_seconds: double>"
)
SESSION = (
    f"analysis_id string, session_no bigint, events array<{REVIEW_EVENT}>, "
    "total_review_seconds double, baseline_manual_seconds double, model_analysis_seconds double"
)
INTERVAL = "struct<start_s: double, end_s: double, peak_score: double, confidence: double>"
RESULT = (
    "analysis_id string, schema_version string, instruments array<struct<canonical_label: string, "
    f"display_name: string, decision: string, score: double, time_ranges: array<{INTERVAL}>>>"
)
SAMPLE = (
    T.StructType()
    .add("sample_id", "string")
    .add("dataset", "string")
    .add("split", "string")
    .add("audio_path", "string")
    .add("source_url", "string")
    .add("source_license", "string")
    .add("targets", T.MapType(T.StringType(), T.BooleanType()))
    .add("source_tags", T.ArrayType(T.StringType()))
    .add("sha256", "string")
    .add("group_id", "string")
)


# --- scores -------------------------------------------------------------------

def read_scores_csv(spark: SparkSession, path: str, schema: str = LABELLED) -> DataFrame:
    """Labelled scores with a header line and a declared schema; a malformed row fails the read."""
    return spark.read.schema(schema).csv(path, header=True, mode="FAILFAST", enforceSchema=False)


def write_scores_csv(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").csv(path, header=True)


COMPARISON = {
    "stem_scores": "map<string,double>",
    "stem_energy_ratios": "map<string,double>",
    "warnings": "array<string>",
}


def write_comparison_csv(df: DataFrame, path: str) -> None:
    """Mix against fused scores: nine columns, three of them as JSON text."""
    flat = [F.to_json(c).alias(c) if c in COMPARISON else F.col(c) for c in df.columns]
    df.select(*flat).write.mode("errorifexists").option("escape", '"').csv(path, header=True)


def read_comparison_csv(spark: SparkSession, path: str) -> DataFrame:
    schema = (
        "sample_id string, dataset string, label string, target int, mix_score double, stem_scores string, "
        "fused_score double, stem_energy_ratios string, warnings string"
    )
    flat = spark.read.schema(schema).csv(path, header=True, mode="FAILFAST", escape='"', enforceSchema=False)
    return flat.select(*[F.from_json(c, COMPARISON[c]).alias(c) if c in COMPARISON else F.col(c) for c in flat.columns])


# --- tracks and licenses ------------------------------------------------------

def parse_tracks(rows: DataFrame, tag_sep: str = ",") -> DataFrame:
    """Typed tracks from text columns TRACK_ID, PATH, DURATION, TAGS."""
    number = F.regexp_replace("TRACK_ID", f"^{C.TRACK_PREFIX}", "")
    tags = F.transform(
        F.split("TAGS", f"\\Q{tag_sep}\\E"), lambda tag: F.regexp_replace(tag, f"^{C.TAG_PREFIX}", "")
    )
    return rows.select(
        F.col("TRACK_ID").alias("track_id"),
        number.cast("long").alias("numeric_id"),
        F.col("PATH").alias("path"),
        F.col("DURATION").cast("double").alias("duration_s"),
        F.array_distinct(tags).alias("tags"),
    )


def read_tracks_tsv(spark: SparkSession, path: str, tag_sep: str = ",") -> DataFrame:
    """Track list with a header; columns are found by name, others are ignored."""
    return parse_tracks(spark.read.csv(path, header=True, sep="\t"), tag_sep)


def read_numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of text files with their number, counted over the file's splits in parallel.

    A line is numbered inside its split and moved up by the lines of the splits before it, so a
    large file is read by many tasks (``spark.sql.files.maxPartitionBytes`` sets the splits).
    """
    place = ["file", "_split"]
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("_split"),
        F.col("value").alias("line"),
    )
    along = Window.partitionBy("file").orderBy("_split").rowsBetween(Window.unboundedPreceding, -1)
    offsets = lines.groupBy(*place).agg(F.count("*").alias("_n")).select(
        *place, F.coalesce(F.sum("_n").over(along), F.lit(0)).alias("_offset")
    )
    inside = Window.partitionBy(*place).orderBy("_seq")
    return (
        lines.withColumn("_seq", F.monotonically_increasing_id())
        .withColumn("_at", F.row_number().over(inside))
        .join(offsets, place)
        .select("file", (F.col("_at") - 1 + F.col("_offset")).alias("line_no"), "line")
    )


def line_offset_lookup(
    lines: DataFrame, suffix: str, offset: int = 2, *, document: str = "file", order: Sequence[str] = ("line_no",)
) -> DataFrame:
    """``line`` ending in ``suffix`` -> the line ``offset`` below it, if there is one.

    A later duplicate (by ``order``) wins. The line below is found by an equi-join on document and
    line number, so no document is ordered by a single task.
    """
    heads = lines.filter(F.col("line").endswith(suffix)).withColumn("_at", F.col("line_no") + offset)
    below = lines.select(document, F.col("line_no").alias("_at"), F.col("line").alias("value"))
    return (
        heads.join(below, [document, "_at"])
        .groupBy("line")
        .agg(F.max_by("value", F.struct(*order)).alias("value"))
    )


def with_license(tracks: DataFrame, licenses: DataFrame) -> DataFrame:
    """License per track path, or the text for a missing one."""
    return tracks.join(licenses.select(F.col("line").alias("path"), F.col("value").alias("_license")), "path", "left") \
        .withColumn("license", F.coalesce("_license", F.lit(C.MISSING_LICENSE))).drop("_license")


# --- manifests ----------------------------------------------------------------

def manifest_samples(samples: DataFrame, labels: Sequence[str] = C.TARGET_LABELS) -> DataFrame:
    """Checked manifest records: exactly the known labels as targets; group defaults to the sample."""
    keys = F.map_keys("targets")
    exact = (F.size(keys) == len(labels)) & (F.size(F.array_except(keys, F.array(*map(F.lit, labels)))) == 0)
    checked = F.when(F.coalesce(exact, F.lit(False)), F.col("targets")).otherwise(
        F.raise_error(F.concat(F.lit("manifest record without exactly the target labels: "), F.col("sample_id")))
        .cast("map<string,boolean>")
    )
    return samples.withColumn("targets", checked).withColumn("group_id", F.coalesce("group_id", "sample_id"))


def read_manifest(spark: SparkSession, path: str, *, lines: bool = False) -> DataFrame:
    """Samples of a manifest: one document with ``samples[]``, or one record per line."""
    if lines:
        return manifest_samples(spark.read.schema(SAMPLE).json(path))
    document = spark.read.schema(T.StructType().add("samples", T.ArrayType(SAMPLE)))
    samples = document.json(path, multiLine=True).select(F.explode("samples").alias("s"))
    return manifest_samples(samples.select("s.*"))


# layout of a manifest document as it is usually written: one field to a line, two spaces a level
RECORD_INDENT = "    "


def read_manifest_document(spark: SparkSession, path: str) -> DataFrame:
    """Samples of manifest documents of any size, each read by many tasks.

    Expects the indented layout (two spaces a level) with ``samples`` as the only list of objects below the top. The
    lines are read over the files' splits; a record's first and last line are known by their indent, so running
    counts of both number the records, and the lines of one record are put together and parsed.
    """
    lines = read_numbered_lines(spark, path).withColumn("line", F.rtrim("line"))
    opens = (F.col("line") == RECORD_INDENT + "{").cast("long")
    closes = F.col("line").isin(RECORD_INDENT + "}", RECORD_INDENT + "},").cast("long")
    marked = lines.select("*", opens.alias("opens"), closes.alias("closes"))
    placed = running_totals(marked, ["file"], "line_no", ["opens", "closes"], sized_by=spark.read.text(path))
    record = F.col("opens_before") + F.col("opens")
    inside = placed.withColumn("record", record).filter(F.col("record") > F.col("closes_before"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"])
    texts = inside.groupBy("file", "record").agg(F.rtrim(F.concat_ws("\n", parts), F.lit(",")).alias("text"))
    parsed = F.from_json("text", SAMPLE, {"mode": "FAILFAST"})
    return manifest_samples(texts.select(parsed.alias("s")).select("s.*"))


def write_manifest(samples: DataFrame, path: str) -> None:
    """One record per line, in (dataset, split, sample_id) order over range-partitioned files: a
    single document would push every sample through one task."""
    samples.sort("dataset", "split", "sample_id").write.mode("errorifexists").option(
        "ignoreNullFields", "false"
    ).json(path)


def targets_long(manifest: DataFrame) -> DataFrame:
    """Judged targets as rows; a null target is dropped, never read as negative."""
    return manifest.select(
        "sample_id", "dataset", "split", "group_id", F.explode("targets").alias("label", "_target")
    ).filter(F.col("_target").isNotNull()).select(
        "sample_id", "dataset", "split", "group_id", "label", F.col("_target").cast("int").alias("target")
    )


# --- nested results -------------------------------------------------------------

LABEL_RESULT = ("canonical_label", "display_name", "decision", "score")


def label_results(activity: DataFrame) -> DataFrame:
    """One row per (clip, label) with its intervals, from activity rows (one per interval, or one without)."""
    interval = F.struct("start_s", "end_s", "peak_score", "confidence")
    found = F.collect_list(F.when(F.col("start_s").isNotNull(), interval))
    rows = activity.groupBy("clip_id", *LABEL_RESULT).agg(F.sort_array(found).alias("time_ranges"))
    return rows.select(F.col("clip_id").cast("string").alias("analysis_id"), *LABEL_RESULT, "time_ranges")


def nest_results(activity: DataFrame) -> DataFrame:
    """One document per clip from activity rows.

    A document holds one clip's labels and intervals; clips are bounded by the duration gate.
    """
    return label_results(activity).groupBy("analysis_id").agg(
        F.lit("1.0.0").alias("schema_version"),
        F.sort_array(F.collect_list(F.struct(*LABEL_RESULT, "time_ranges"))).alias("instruments"),
    )


def write_results(documents: DataFrame, path: str) -> None:
    """Result documents, one JSON object per line; the committer makes the replacement atomic."""
    documents.write.mode("overwrite").json(path)


# each replacement is a generation of its own; the newest document of an analysis counts
GENERATION = "generation"


def replace_results(documents: DataFrame, path: str) -> None:
    """Result documents that replace those of their own analyses and leave all others.

    They are written beside the earlier ones as the next generation, so the files written are as many as tasks, not as
    analyses. One writer at a time; what was replaced stays in its folder.
    """
    spark, folder = documents.sparkSession, re.compile(f"/{GENERATION}=([0-9]+)/")
    try:
        written = spark.read.schema(RESULT).json(path).inputFiles()
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        written = []
    following = 1 + max((int(m.group(1)) for m in map(folder.search, written) if m), default=-1)
    sink = documents.write.mode("append").option("ignoreNullFields", "false")
    sink.json(f"{path.rstrip('/')}/{GENERATION}={following}")


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """Result documents as written, or of each analysis those of its newest generation."""
    rows = spark.read.schema(RESULT).json(path, mode="FAILFAST")
    if GENERATION not in rows.columns:
        return rows
    newest = F.max(GENERATION).over(Window.partitionBy("analysis_id"))
    return rows.withColumn("_newest", newest).filter(F.col(GENERATION) == F.col("_newest")).drop(GENERATION, "_newest")


def result_rows(documents: DataFrame) -> DataFrame:
    """One row per (document, label) from nested results."""
    return documents.select("analysis_id", F.explode("instruments").alias("r")).select("analysis_id", "r.*")


def _fixed(value: Column, digits: int) -> Column:
    """Decimal text, half-even like the values it must agree with."""
    return F.format_string(f"%.{digits}f", F.bround(value, digits))


def flatten_results(documents: DataFrame) -> DataFrame:
    """Export of nested results; overrides are not applied."""
    return export_rows(result_rows(documents))


def export_rows(results: DataFrame) -> DataFrame:
    """Export of (document, label) rows as ``label_results`` gives them: no task holds more than one label of a
    clip. The ranges of a label form one text cell."""
    ranges = F.transform(
        F.col("time_ranges"), lambda r: F.concat(_fixed(r["start_s"], 2), F.lit("-"), _fixed(r["end_s"], 2))
    )
    return results.select(
        "analysis_id",
        "canonical_label",
        "display_name",
        "decision",
        _fixed(F.col("score"), 6).alias("model_score"),
        F.concat_ws("; ", ranges).alias("time_ranges"),
    )


# --- content inventory -----------------------------------------------------------

def content_inventory(content: DataFrame, path: str = "path", body: str = "content") -> DataFrame:
    """SHA-256 and size in bytes per file or text."""
    data = F.col(body).cast("binary")
    return content.select(F.col(path).alias("path"), F.sha2(data, 256).alias("sha256"),
                          F.octet_length(data).cast("long").alias("size_bytes"))


def read_inventory(spark: SparkSession, path: str) -> DataFrame:
    """Inventory of the files below a folder. The reader lists no file without bytes, so an empty one counts as missing."""
    return content_inventory(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path))


def write_bundles(content: DataFrame, path: str, body: str = "content") -> None:
    """Many small files as members of bundles, one bundle a task: rows of ``path`` and bytes.

    A folder or file per member would make the driver list and move each of them; bundles are as many as tasks.
    """
    members = content.select("path", F.col(body).cast("binary").alias("content"))
    members.write.mode("errorifexists").parquet(path)


def read_bundles(spark: SparkSession, path: str) -> DataFrame:
    """Inventory of the members of bundles; a member without bytes is there, unlike an empty file of ``read_inventory``."""
    return content_inventory(spark.read.schema("path string, content binary").parquet(path))


def integrity_check(inventory: DataFrame, manifest: DataFrame) -> DataFrame:
    """``error`` per manifest entry: integrity_failure when missing or different, else null."""
    found = inventory.select("path", F.col("sha256").alias("_found"))
    return manifest.join(found, "path", "left").withColumn(
        "error", F.when(~F.col("sha256").eqNullSafe(F.col("_found")), "integrity_failure")
    ).drop("_found")


# --- review sessions ----------------------------------------------------------------

def append_sessions(sessions: DataFrame, path: str) -> None:
    """Add immutable review sessions to the log, one JSON payload per line."""
    sessions.write.mode("append").json(path)


def read_sessions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SESSION).json(path, mode="FAILFAST")


def read_review_events(spark: SparkSession, path: str) -> DataFrame:
    """Events of all sessions, in insertion order by (session_no, position); a session without
    events keeps one row of nulls."""
    return read_sessions(spark, path).select(
        "analysis_id", "session_no", F.posexplode_outer("events").alias("position", "e")
    ).select(
        "analysis_id",
        "session_no",
        "position",
        F.col("e.field_id").alias("field_id"),
        F.col("e.outcome").alias("outcome"),
        F.col("e.original_prediction.field_name").alias("field_name"),
        F.col("e.original_prediction.instrument_label").alias("label"),
        F.col("e.original_prediction.decision").alias("decision"),
        F.col("e.final_value").alias("final_value"),
        F.col("e.edit_description").alias("edit_description"),
        F.col("e.threshold_profile_name").alias("profile"),
        F.col("e.field_elapsed_seconds").alias("elapsed_s"),
    )
