"""From raw documents to packed training sequences: filter, identify, deduplicate, pseudonymise, pack.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept. All but the last return the columns
of documents. Nulls, empty and very long texts, repeated rows and empty tables are handled as the operators say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from earmark.llm import catalog, language, neardup, packing, pseudonyms, quality
from earmark.llm.common import free_name, quoted, written

QUALITY_THRESHOLD = 0.3
WORDS, SIMILARITY = 5, 80


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, trained on all labels, does not reject."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.train(docs, labels)
    return docs.filter(quality.score_of(docs, model, F.col("text")) >= QUALITY_THRESHOLD)


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; the rejected ones have no letters. Without a language to learn all stay."""
    model = language.train_prototypes(docs)
    if not model[0]:
        return docs
    # no learned language has this name, so it marks texts without letters
    told = language.predicted(docs, model, F.col("text"))["lang_pred"]
    return docs.filter(told != language.UNKNOWN)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates: one with the smallest id, null ids last. Unlinked rows all stay.

    Rows are told apart by id and text, so a null or repeated id does not make unrelated texts copies.
    """
    row, n, size = (free_name(docs.columns, x) for x in ("_row", "_n", "_shingles"))
    text = F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256))
    rows = docs.withColumn(row, F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), text.alias("text")))
    groups = written(neardup.near_duplicates(rows, words=WORDS, similarity=SIMILARITY, id_col=row), "groups")
    kept = groups.filter("kept").groupBy(row).agg(F.count("*").alias(n), F.max("n_shingles").alias(size))
    kept = written(kept, "kept")
    left = rows.join(kept, row)
    # rows that agree in id and text are copies as well, unless the text has no words
    again = (F.col(n) > 1) & (F.col(size) > 0)
    if not kept.filter(again).isEmpty():
        left = left.filter(~again).unionByName(left.filter(again).dropDuplicates([row]))
    return left.select(*quoted(docs.columns))


def pseudonymous(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their personal data replaced."""
    return pseudonyms.pseudonymise(docs, pseudonyms.DEMO_KEY).select(*quoted(docs.columns))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all tokens in sequences of 4096."""
    return packing.packed_documents(docs, catalog.WORD_BPE)


STAGES = [
    ("quality", good_quality),
    ("language", known_language),
    ("near_duplicates", without_near_copies),
    ("pii", pseudonymous),
    ("packing", packed),
]
# tokens, learned weights and keyed permutations are beyond SQL
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
