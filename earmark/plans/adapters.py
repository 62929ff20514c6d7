"""Stand-in inputs: the given tables reshaped into score, signal, prediction and review tables.

Each adapter is a DataFrame function plus the same rows as SQL text (``ADAPTER_SQL``), so that a
query and its check start from equal inputs. The numbers carry no musical meaning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from earmark import constants as C
from earmark.functions.ordered import dense_index
from earmark.sources.dims import taxonomy_dim

RAW = C.raw_labels()
EVENT_RAW = {
    "view": "drumset",
    "click": "bassguitar",
    "purchase": "grandpiano",
    "signup": "doublebass",
    "error": "synthesizer",
}
EVENT_STEM = {"view": "drums", "click": "bass", "purchase": "vocals", "signup": "other", "error": "mix"}
EVENT_OUTCOME = dict(zip(("view", "click", "purchase", "signup", "error"), C.OUTCOMES))
EVENT_TAG = {"view": "drums", "click": "violin", "purchase": "piano", "signup": "trumpet", "error": "conga"}
STEM_LABELS = ("drums", "percussion", "bass", "electric_guitar")
SIGNAL_RATE = 100


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _case(column: Column, mapping: dict[str, str]) -> Column:
    chosen = None
    for key, value in mapping.items():
        chosen = F.when(column == key, value) if chosen is None else chosen.when(column == key, value)
    return chosen


def _case_sql(column: str, mapping: dict[str, str]) -> str:
    return "CASE " + " ".join(f"WHEN {column} = '{k}' THEN '{v}'" for k, v in mapping.items()) + " END"


def _list_sql(names) -> str:
    return "[" + ", ".join(f"'{n}'" for n in names) + "]"


def _at(names, index: Column) -> Column:
    return F.get(F.array(*map(F.lit, names)), index.cast("int"))


def _elapsed_us() -> Column:
    return F.expr("timestampdiff(MICROSECOND, timestamp_ntz'2024-01-01 00:00:00', ts)")


def frame_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clip = user, window = event, time in hours since 2024."""
    start = _elapsed_us() / F.lit(1e6) / 3600
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("clip_id"),
        _case(F.col("event_type"), EVENT_RAW).alias("raw_label"),
        F.col("event_id").alias("window_idx"),
        start.alias("start_s"),
        (start + 2.0).alias("end_s"),
        F.least(F.col("value") / 97.3, F.lit(1.0)).alias("score"),
    )


def event_time() -> Column:
    """Milliseconds since 2024 as event time, whatever the session's zone."""
    return F.timestamp_millis(F.floor(_elapsed_us() / 1000).cast("long"))


def outcome() -> Column:
    return _case(F.col("event_type"), EVENT_OUTCOME)


def streamed_scores(events: DataFrame) -> DataFrame:
    """Canonical scores straight from an event stream: each event is one window of one raw label,
    so no aggregation is needed before the stateful step."""
    start = _elapsed_us() / F.lit(1e6) / 3600
    raw = _case(F.col("event_type"), EVENT_RAW)
    dim = taxonomy_dim(events.sparkSession).select("canonical_label", "raw_label")
    return events.select(
        F.col("user_id").alias("clip_id"),
        raw.alias("raw_label"),
        F.col("event_id").alias("window_idx"),
        start.alias("start_s"),
        (start + 2.0).alias("end_s"),
        F.least(F.col("value") / 97.3, F.lit(1.0)).alias("score"),
        event_time().alias("event_time"),
    ).join(F.broadcast(dim), "raw_label")


def window_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clip = label of the embedding, one window per vector, 53 raw label scores over all 64 positions."""
    rows = dense_index(
        table(spark, sf_dir, "embeddings").select(F.col("label").cast("long").alias("clip_id"), "vec_id", "embedding"),
        ["clip_id"], ["vec_id"], "window_idx",
    )
    # 64 positions folded onto the 53 names: position modulo 53, the greatest wins
    both = F.transform(
        F.sequence(F.lit(0), F.lit(len(RAW) - 1)), lambda i: F.greatest(F.get("embedding", i), F.get("embedding", i + len(RAW)))
    )
    vector = F.transform(both, lambda x: 1 / (1 + F.exp(-(8 * x.cast("double") - 2))))
    return rows.select(
        "clip_id",
        "window_idx",
        (F.col("window_idx") * F.lit(C.CADENCE_HOP_SAMPLES / 16000)).alias("start_s"),
        (F.col("window_idx") * F.lit(C.CADENCE_HOP_SAMPLES / 16000) + F.lit(C.CADENCE_PATCH_SAMPLES / 16000)).alias("end_s"),
        vector.alias("scores"),
    )


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled predictions from line items; many tied scores."""
    target = (F.col("l_returnflag") == "R").cast("int")
    score = F.least(F.lit(1.0), F.col("l_quantity") / 100 + F.col("l_discount") + 0.3 * target)
    return table(spark, sf_dir, "lineitem").select(
        F.concat_ws(
            "-", "l_orderkey", "l_linenumber", "l_suppkey", "l_partkey",
            F.round(F.col("l_extendedprice") * 100).cast("long"),
        ).alias("sample_id"),
        F.col("l_orderkey").alias("sample_no"),
        F.col("l_orderkey").cast("string").alias("group_id"),
        F.when(F.col("l_suppkey") % 2 == 0, "set_a").otherwise("set_b").alias("dataset"),
        F.when(F.col("l_orderkey") % 10 < 3, "calibration").otherwise("evaluation").alias("split"),
        _at(C.TARGET_LABELS, F.col("l_partkey") % 10).alias("label"),
        target.alias("target"),
        score.alias("score"),
    )


def doc_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judged documents: label = task, dataset = language; some (label, dataset) cells are absent."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    judged = table(spark, sf_dir, "labels").join(docs, "doc_id")
    tasks = F.array(
        F.struct(F.lit("bass").alias("label"), F.col("quality").alias("target")),
        F.struct(F.lit("strings").alias("label"), F.when(F.col("lang") != "de", F.col("toxic")).alias("target")),
    )
    return judged.withColumn("t", F.explode(tasks)).select(
        F.col("doc_id").cast("string").alias("sample_id"),
        F.col("lang").alias("dataset"),
        F.when(F.col("doc_id") % 4 == 0, "calibration").otherwise("evaluation").alias("split"),
        F.col("t.label").alias("label"),
        F.col("t.target").alias("target"),
        ((F.col("n_chars") % 101) / F.lit(100)).alias("score"),
    )


LINE_KEY = ["l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "l_extendedprice"]


def stereo_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stereo signal per supplier, nominal rate 100 per second."""
    left = (F.col("l_quantity") - 25.5) / 50
    right = left * (0.4 + F.col("l_suppkey") % 7 * 0.2) + (F.col("l_discount") - 0.05)
    rows = table(spark, sf_dir, "lineitem").select(*LINE_KEY, left.alias("l"), right.alias("r"))
    return dense_index(rows, ["l_suppkey"], LINE_KEY[:2] + LINE_KEY[3:], "i").select(
        F.col("l_suppkey").alias("clip_id"), "i", "l", "r"
    )


def channel_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same signal as arrays of one, two or three channels; some clips silent or broken."""
    left = (F.col("l_quantity") - 25.5) / 25
    kind = F.col("l_suppkey") % 11
    l = F.when(kind == 7, 0.0).when((kind == 5) & (F.col("l_linenumber") == 3), float("nan")).otherwise(left)
    ch = (
        F.when(F.col("l_suppkey") % 3 == 1, F.array(l))
        .when(F.col("l_suppkey") % 3 == 2, F.array(l, l * 0.5))
        .otherwise(F.array(l, l * 0.5, l * 0.25))
    )
    rows = table(spark, sf_dir, "lineitem").select(*LINE_KEY, ch.alias("ch"))
    return dense_index(rows, ["l_suppkey"], LINE_KEY[:2] + LINE_KEY[3:], "i").select(
        F.col("l_suppkey").alias("clip_id"), "i", "ch"
    )


def clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One clip per supplier with suffix, rate and channel count."""
    key = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(
        key.alias("clip_id"),
        F.when(key % 13 == 6, ".txt").when(key % 2 == 0, ".WAV").otherwise(".mp3").alias("suffix"),
        F.when(key % 17 == 3, 500).when(key % 17 == 4, 1000).otherwise(16000).alias("sample_rate"),
        F.when(key % 3 == 1, 1).when(key % 3 == 2, 2).otherwise(3).alias("channels"),
    )


def spectrum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Magnitudes per (clip, frame, frequency) from embedding values."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("label").cast("long").alias("clip_id"), F.col("vec_id").alias("frame"),
        F.posexplode("embedding").alias("pos", "x"),
    ).select(
        "clip_id", "frame", (F.col("pos") * 125.0).alias("freq_hz"),
        (F.abs(F.col("x").cast("double")) + 1e-12).alias("magnitude"),
    )


def partial_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with partly judged labels."""
    k = F.explode(F.sequence(F.lit(0), F.lit(3)))
    m = (F.col("doc_id") * 7 + F.col("k") * 13) % 5
    return table(spark, sf_dir, "documents").select("doc_id", k.alias("k")).select(
        F.col("doc_id").alias("sample_id"),
        _at(C.TARGET_LABELS, F.col("k")).alias("label"),
        F.when(m == 0, True).when(m == 1, False).alias("target"),
    )


def partial_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with 20 member values and masks."""
    at = F.sequence(F.lit(0), F.lit(len(C.PARTIAL_VOCABULARY) - 1))
    return table(spark, sf_dir, "documents").select("doc_id", "n_chars").select(
        "doc_id",
        F.transform(at, lambda j: ((F.col("n_chars") + j * 37) % 100) / F.lit(100)).alias("values"),
        F.transform(at, lambda j: F.when((F.col("doc_id") + j) % 3 != 0, 1).otherwise(0)).alias("masks"),
    )


def tag_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct tags per (user, day); five at most."""
    day = F.floor(_elapsed_us() / F.lit(86_400_000_000)).cast("long")
    return (
        table(spark, sf_dir, "events")
        .select(F.concat_ws("-", "user_id", day).alias("id"), _case(F.col("event_type"), EVENT_TAG).alias("tag"))
        .groupBy("id")
        .agg(F.collect_set("tag").alias("tags"))
    )


def stem_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores per (clip, stem, label); the mix is one more stem named ``mix``."""
    return (
        table(spark, sf_dir, "events")
        .select(
            F.col("user_id").alias("clip_id"),
            _case(F.col("event_type"), EVENT_STEM).alias("stem"),
            _at(STEM_LABELS, F.col("event_id") % 4).alias("canonical_label"),
            F.least(F.col("value") / 200, F.lit(1.0)).alias("score"),
        )
        .groupBy("clip_id", "stem", "canonical_label")
        .agg(F.max("score").alias("score"))
    )


def stem_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-channel samples per (clip, stem); the stems of clip % 5 == 0 are silent."""
    loud = F.when(F.col("user_id") % 5 == 0, 0.0).otherwise(F.col("value") / 100)
    quiet = F.when(F.col("event_type") == "view", loud * (F.col("user_id") % 4) * 0.02).otherwise(loud)
    return table(spark, sf_dir, "events").filter(F.col("event_type") != "error").select(
        F.col("user_id").alias("clip_id"),
        _case(F.col("event_type"), EVENT_STEM).alias("stem"),
        quiet.alias("l"),
        (quiet * 0.5).alias("r"),
    )


def review_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    predicted = e % 4 != 3
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("session_id"),
        e.alias("seq"),
        F.concat(F.lit("field_"), (e % 8).cast("string")).alias("field_id"),
        F.when(predicted, F.concat(F.lit("name_"), (e % 3).cast("string"))).alias("field_name"),
        F.when(predicted & (e % 6 != 0), _at(C.TARGET_LABELS, e % 5)).alias("label"),
        F.when(predicted, _at(C.DECISIONS, e % 4)).alias("decision"),
        _case(F.col("event_type"), EVENT_OUTCOME).alias("outcome"),
        F.when(e % 50 == 7, -F.col("value")).otherwise(F.col("value")).alias("elapsed_s"),
        F.when(e % 31 != 5, "default").alias("profile"),
        F.col("ts"),
    )


def review_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        e.alias("session_no"),
        F.col("value").alias("total_review_s"),
        F.when(e % 3 == 1, F.col("value") * 1.5 + 3).when(e % 3 == 2, 0.0).alias("baseline_s"),
        (F.col("value") / 7).alias("model_s"),
    )


def overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("analysis_id"),
        F.col("event_id").alias("seq"),
        F.concat(F.lit("instruments."), (F.col("event_id") % 5).cast("string"), F.lit(".decision")).alias("field_path"),
        F.when(F.col("event_type") != "error", F.col("event_type")).alias("new_value"),
    )


def field_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = F.explode(F.sequence(F.lit(0), F.lit(5)))
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.min("event_type").alias("value")).select(
        F.col("user_id").alias("analysis_id"),
        paths.alias("k"),
        "value",
    ).select(
        "analysis_id", F.concat(F.lit("instruments."), F.col("k").cast("string"), F.lit(".decision")).alias("field_path"), "value"
    )


def task_patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("analysis_id"),
        F.col("event_id").alias("seq"),
        F.col("event_type").alias("status"),
        F.col("value").alias("progress"),
        F.when(F.col("event_type") == "error", F.col("props")).alias("error"),
        F.when(F.col("event_type") == "purchase", F.col("props")).alias("file_sha256"),
    )


def submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("seq"),
        F.sha2(F.col("text"), 256).alias("sha"),
        F.when(F.col("n_chars") % 4 == 0, "default").otherwise("calibrated_public_v1").alias("profile"),
        (F.col("n_chars") % 3 == 0).alias("separation"),
        F.col("lang"),
    )


_US = "(epoch_us(ts) - 1704067200000000)"
_LINE_ORDER = "l_orderkey, l_linenumber, l_partkey, l_extendedprice"

ADAPTER_SQL = {
    "frame_scores": f"""
        SELECT user_id AS clip_id, {_case_sql('event_type', EVENT_RAW)} AS raw_label, event_id AS window_idx,
               {_US} / 1e6::DOUBLE / 3600 AS start_s, {_US} / 1e6::DOUBLE / 3600 + 2.0::DOUBLE AS end_s,
               least(value / 97.3::DOUBLE, 1.0::DOUBLE) AS score
        FROM events""",
    "taxonomy": "SELECT * FROM (VALUES "
    + ", ".join(
        f"('{label}', '{C.DISPLAY_NAMES[label]}', '{raw}', {i})"
        for i, (label, (raws, _, _)) in enumerate(C.TAXONOMY.items())
        for raw in raws
    )
    + ") AS t(canonical_label, display_name, raw_label, label_no)",
    "raw_scores": f"""
        SELECT clip_id, window_idx, window_idx * {C.CADENCE_HOP_SAMPLES / 16000}::DOUBLE AS start_s,
               window_idx * {C.CADENCE_HOP_SAMPLES / 16000}::DOUBLE + {C.CADENCE_PATCH_SAMPLES / 16000}::DOUBLE AS end_s,
               ({_list_sql(RAW)})[k] AS raw_label, 1 / (1 + exp(-(8 * greatest(embedding[k], embedding[k + {len(RAW)}])::DOUBLE - 2))) AS score
        FROM (SELECT label::BIGINT AS clip_id, embedding,
                     row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS window_idx FROM embeddings),
             (SELECT unnest(range(1, {len(RAW) + 1})) AS k)""",
    "predictions": f"""
        SELECT concat_ws('-', l_orderkey, l_linenumber, l_suppkey, l_partkey, round(l_extendedprice * 100)::BIGINT) AS sample_id,
               l_orderkey AS sample_no, l_orderkey::VARCHAR AS group_id,
               CASE WHEN l_suppkey % 2 = 0 THEN 'set_a' ELSE 'set_b' END AS dataset,
               CASE WHEN l_orderkey % 10 < 3 THEN 'calibration' ELSE 'evaluation' END AS split,
               ({_list_sql(C.TARGET_LABELS)})[l_partkey % 10 + 1] AS label,
               (l_returnflag = 'R')::INT AS target,
               least(1.0::DOUBLE, l_quantity / 100 + l_discount + 0.3::DOUBLE * (l_returnflag = 'R')::INT) AS score
        FROM lineitem""",
    "doc_predictions": """
        SELECT doc_id::VARCHAR AS sample_id, lang AS dataset,
               CASE WHEN doc_id % 4 = 0 THEN 'calibration' ELSE 'evaluation' END AS split, label,
               CASE WHEN label = 'bass' THEN (SELECT max(l.quality) FROM labels l WHERE l.doc_id = d.doc_id)
                    WHEN lang <> 'de' THEN (SELECT max(l.toxic) FROM labels l WHERE l.doc_id = d.doc_id) END AS target,
               (n_chars % 101) / 100.0::DOUBLE AS score
        FROM (SELECT doc_id, lang, n_chars, unnest(['bass', 'strings']) AS label FROM documents) d
        WHERE doc_id IN (SELECT doc_id FROM labels)""",
    "stereo_samples": f"""
        SELECT l_suppkey AS clip_id, row_number() OVER (PARTITION BY l_suppkey ORDER BY {_LINE_ORDER}) - 1 AS i,
               (l_quantity - 25.5::DOUBLE) / 50 AS l,
               (l_quantity - 25.5::DOUBLE) / 50 * (0.4::DOUBLE + l_suppkey % 7 * 0.2::DOUBLE) + (l_discount - 0.05::DOUBLE) AS r
        FROM lineitem""",
    "channel_samples": f"""
        SELECT clip_id, i, CASE WHEN clip_id % 3 = 1 THEN [x] WHEN clip_id % 3 = 2 THEN [x, x * 0.5::DOUBLE]
                           ELSE [x, x * 0.5::DOUBLE, x * 0.25::DOUBLE] END AS ch
        FROM (SELECT l_suppkey AS clip_id, row_number() OVER (PARTITION BY l_suppkey ORDER BY {_LINE_ORDER}) - 1 AS i,
                     CASE WHEN l_suppkey % 11 = 7 THEN 0.0::DOUBLE
                          WHEN l_suppkey % 11 = 5 AND l_linenumber = 3 THEN 'nan'::DOUBLE
                          ELSE (l_quantity - 25.5::DOUBLE) / 25 END AS x
              FROM lineitem)""",
    "clips": """
        SELECT s_suppkey AS clip_id,
               CASE WHEN s_suppkey % 13 = 6 THEN '.txt' WHEN s_suppkey % 2 = 0 THEN '.WAV' ELSE '.mp3' END AS suffix,
               CASE WHEN s_suppkey % 17 = 3 THEN 500 WHEN s_suppkey % 17 = 4 THEN 1000 ELSE 16000 END AS sample_rate,
               CASE WHEN s_suppkey % 3 = 1 THEN 1 WHEN s_suppkey % 3 = 2 THEN 2 ELSE 3 END AS channels
        FROM supplier""",
    "spectrum": """
        SELECT label::BIGINT AS clip_id, vec_id AS frame, (k - 1) * 125.0::DOUBLE AS freq_hz,
               abs(embedding[k]::DOUBLE) + 1e-12::DOUBLE AS magnitude
        FROM embeddings, (SELECT unnest(range(1, 65)) AS k)""",
    "partial_pool": f"""
        SELECT doc_id AS sample_id, ({_list_sql(C.TARGET_LABELS[:4])})[k + 1] AS label,
               CASE (doc_id * 7 + k * 13) % 5 WHEN 0 THEN true WHEN 1 THEN false END AS target
        FROM documents, (SELECT unnest(range(0, 4)) AS k)""",
    "member_judgments": f"""
        SELECT doc_id, ({_list_sql(C.PARTIAL_VOCABULARY)})[j + 1] AS member,
               CASE WHEN (doc_id + j) % 3 <> 0 THEN ((n_chars + j * 37) % 100) / 100.0::DOUBLE >= 0.5::DOUBLE END AS judged
        FROM documents, (SELECT unnest(range(0, {len(C.PARTIAL_VOCABULARY)})) AS j)""",
    "tag_rows": f"""
        SELECT DISTINCT concat_ws('-', user_id, ({_US} // 86400000000)::BIGINT) AS id,
               {_case_sql('event_type', EVENT_TAG)} AS tag FROM events""",
    "stem_scores": f"""
        SELECT user_id AS clip_id, {_case_sql('event_type', EVENT_STEM)} AS stem,
               ({_list_sql(STEM_LABELS)})[event_id % 4 + 1] AS canonical_label,
               max(least(value / 200, 1.0::DOUBLE)) AS score
        FROM events GROUP BY ALL""",
    "stem_energy": f"""
        SELECT clip_id, stem, CASE WHEN sum(rms) OVER (PARTITION BY clip_id) = 0 THEN 0.0::DOUBLE
                              ELSE rms / sum(rms) OVER (PARTITION BY clip_id) END AS energy
        FROM (SELECT clip_id, stem, sqrt(avg((l * l + l * l * 0.25::DOUBLE) / 2)) AS rms
              FROM (SELECT user_id AS clip_id, {_case_sql('event_type', EVENT_STEM)} AS stem,
                           CASE WHEN user_id % 5 = 0 THEN 0.0::DOUBLE
                                WHEN event_type = 'view' THEN value / 100 * (user_id % 4) * 0.02::DOUBLE
                                ELSE value / 100 END AS l
                    FROM events WHERE event_type <> 'error') GROUP BY ALL)""",
    "review_events": f"""
        SELECT user_id AS session_id, event_id AS seq, 'field_' || (event_id % 8) AS field_id,
               CASE WHEN event_id % 4 <> 3 THEN 'name_' || (event_id % 3) END AS field_name,
               CASE WHEN event_id % 4 <> 3 AND event_id % 6 <> 0 THEN ({_list_sql(C.TARGET_LABELS)})[event_id % 5 + 1] END AS label,
               CASE WHEN event_id % 4 <> 3 THEN ({_list_sql(C.DECISIONS)})[event_id % 4 + 1] END AS decision,
               {_case_sql('event_type', EVENT_OUTCOME)} AS outcome,
               CASE WHEN event_id % 50 = 7 THEN -value ELSE value END AS elapsed_s,
               CASE WHEN event_id % 31 <> 5 THEN 'default' END AS profile, ts
        FROM events""",
    "review_sessions": """
        SELECT event_id AS session_no, value AS total_review_s,
               CASE event_id % 3 WHEN 1 THEN value * 1.5::DOUBLE + 3 WHEN 2 THEN 0.0::DOUBLE END AS baseline_s,
               value / 7 AS model_s FROM events""",
    "submissions": """
        SELECT doc_id AS seq, sha256(text) AS sha,
               CASE WHEN n_chars % 4 = 0 THEN 'default' ELSE 'calibrated_public_v1' END AS profile,
               (n_chars % 3 = 0)::INT AS separation, lang FROM documents""",
}


def profile_sql(name: str) -> str:
    """Thresholds of a profile as a VALUES list."""
    rows = ", ".join(
        f"('{label}', {c}::DOUBLE, {k}::DOUBLE, {str(a).lower()})" for label, (c, k, a) in C.PROFILES[name].items()
    )
    return f"SELECT * FROM (VALUES {rows}) AS t(canonical_label, candidate, confirmed, auto_confirm)"


def rules_sql() -> str:
    """Interval rules of all canonical labels as a VALUES list."""
    rows = []
    for label in C.TAXONOMY:
        rule = {**C.INTERVAL_FALLBACK, **C.INTERVAL_RULES.get(label, {})}
        enabled, least = rule["transient"]
        rows.append(
            f"('{label}', {rule['ratio']}::DOUBLE, {rule['min_duration_s']}::DOUBLE, {rule['gap_s']}::DOUBLE, {least if enabled else 1})"
        )
    return f"SELECT * FROM (VALUES {', '.join(rows)}) AS t(canonical_label, release_ratio, min_duration_s, gap_s, min_windows)"


def with_inputs(names: list[str], body: str, **more: str) -> str:
    """``body`` preceded by the named adapters (and further named queries) as CTEs."""
    parts = {name: ADAPTER_SQL[name] for name in names} | more
    return "WITH " + ",\n".join(f"{name} AS ({text})" for name, text in parts.items()) + "\n" + body
