"""Queries of the thirteen operators over the given tables, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

import public_tokenizers

from earmark.llm import alignment, bpe, centroids, language, learned, licenses, neardup, packing, pseudonyms, quality, slack, token_files, vafile
from earmark.llm.blocks import clean
from earmark.llm.common import remainder
from earmark.session import scratch_path

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECE_BPE = public_tokenizers.path("piece_bpe_32k.model")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its personal data replaced."""
    docs = pseudonyms.pseudonymise(_table(spark, sf_dir, "documents"), pseudonyms.DEMO_KEY)
    return docs.select("doc_id", "text", "kinds", "n_replaced")


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as token ids in ORC, written and read back."""
    path = scratch_path(spark, "tokens")
    token_files.write_tokens(_table(spark, sf_dir, "documents"), path, BYTE_BPE, end_id=0)
    back = token_files.read_tokens(spark, path)
    return back.select("doc_id", "start", "n_tokens", token_files.ids_crc32("ids").alias("ids_crc32"))


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose three-word shingle sets agree by 85 in 100."""
    return neardup.near_duplicates(
        _table(spark, sf_dir, "documents"), words=3, similarity=85
    )


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents packed into sequences of 4096 tokens."""
    return packing.packed_documents(_table(spark, sf_dir, "documents"), WORD_BPE, capacity=4096, end_id=1)


def op5_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five largest integer inner products of every fiftieth vector."""
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * 256))
    vectors = _table(spark, sf_dir, "embeddings").filter(clean(F.col("embedding"), True))
    vectors = vectors.select("vec_id", whole.alias("vector"))
    return vafile.top_k(vectors, vectors.filter("vec_id % 50 = 0"), k=5)


def op6_learned_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty nearest vectors found for every twentieth vector."""
    vectors = _table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    index = learned.build_index(vectors)
    return learned.search(index, vectors.filter("vec_id % 20 = 0"), k=20)


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from three quarters of them."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = remainder(F.col("doc_id"), 4) == 2
    model = language.train_prototypes(docs.filter(~held_out))
    return language.identify(docs.withColumn("held_out", held_out), model).select(
        "doc_id", "held_out", "lang_pred", "score"
    )


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of every document, learned from four fifths of the labels."""
    docs, labels = _table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "labels")
    held_out = remainder(F.col("doc_id"), 5) == 0
    model = quality.train(docs, labels.filter(~held_out))
    return quality.classify(docs.withColumn("held_out", held_out), model).select(
        "doc_id", "held_out", "score", "predicted"
    )


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and notices of every document."""
    return licenses.license_scan(_table(spark, sf_dir, "documents"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded again."""
    return bpe.round_trip(_table(spark, sf_dir, "documents"), BYTE_BPE)


def op11_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forty clusters of the vectors after five rounds."""
    labelled, found = centroids.cluster(_table(spark, sf_dir, "embeddings"), clusters=40, rounds=5, seed=2, dimensions=64)
    if not len(found):
        return spark.createDataFrame(
            [], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
        )
    return centroids.summary(labelled, found).select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links between the byte-level and the piece vocabulary of every document."""
    return alignment.aligned_documents(_table(spark, sf_dir, "documents"), BYTE_BPE, PIECE_BPE)


def op13_slack_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents packed into windows of 1024 tokens without padding."""
    return slack.packed_documents(_table(spark, sf_dir, "documents"), BYTE_BPE, capacity=1024, end_id=0)


OP5_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_sum(list_transform(list_zip(q.x, c.x), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""


def _centroid_sql(clusters: int, rounds: int) -> str:
    """The rounds of op11, one group of steps each."""
    distance = "list_sum(list_transform(list_zip(k.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
    steps = [
        """kept AS MATERIALIZED (
  SELECT row_number() OVER () AS row, vec_id,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
)""",
        f"""c0 AS MATERIALIZED (
  SELECT CAST(row_number() OVER (ORDER BY sha256('2:' || vec_id) NULLS LAST, x) - 1 AS INTEGER) AS cluster, x
  FROM kept QUALIFY cluster < {clusters}
)""",
    ]
    for i in range(rounds + 1):
        steps.append(
            f"""a{i} AS MATERIALIZED (
  SELECT k.row, k.vec_id, k.x, c.cluster, CAST({distance} AS BIGINT) AS distance FROM kept k CROSS JOIN c{i} c
  QUALIFY row_number() OVER (PARTITION BY k.row ORDER BY distance, c.cluster) = 1
)"""
        )
        if i < rounds:
            steps.append(
                f"""c{i + 1} AS MATERIALIZED (
  WITH part AS (SELECT cluster, unnest(x) AS v, generate_subscripts(x, 1) AS pos FROM a{i}),
  mean AS (
    SELECT cluster, pos, CAST(sum(v) AS HUGEINT) AS s, count(*) AS n FROM part GROUP BY cluster, pos
  ), own AS (
    SELECT cluster, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY pos) AS x FROM mean GROUP BY cluster
  )
  SELECT c.cluster, coalesce(own.x, c.x) AS x FROM c{i} c LEFT JOIN own USING (cluster)
)"""
            )
    return (
        "WITH " + ",\n".join(steps) + f"""
SELECT a.vec_id, a.cluster, a.distance,
       CAST(sum(a.distance) OVER (PARTITION BY a.cluster) AS BIGINT) AS cluster_inertia,
       CAST(sum(a.distance) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(c.x, ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} c USING (cluster)
"""
    )


def queries():
    return {
        f.__name__: f
        for f in (
            op1_pseudonyms, op2_token_files, op3_near_duplicates, op4_best_fit_packing, op5_exact_top_k,
            op6_learned_partitions, op7_language, op8_quality, op9_license_scan, op10_byte_bpe, op11_centroid_clusters,
            op12_token_alignment, op13_slack_packing,
        )
    }


def oracle_sql() -> dict[str, str]:
    return {"op5_exact_top_k": OP5_SQL, "op11_centroid_clusters": _centroid_sql(40, 5)}
