"""From raw documents to packed training sequences, each stage on all rows that the one before it kept.

1. Documents that the quality classifier rejects go.
2. One document of each group of near-duplicates stays.
3. Documents that hold a benchmark item go.
4. Secrets in the texts are replaced by a mark.
5. What is left is cut into pieces of tokens and packed.

Defined cases: a null text is scored as an empty one, has no near-duplicate and no secret, and is packed as the end id
alone; texts of any length are read whole; rows without an id are never near-duplicates of others; of rows that share an
id, near-duplicates keep one; columns of other names are carried along to the last stage; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugework.llm import credential_links, edit_leaks, ftrl_quality, jaccard_join, slack_packing
from gaugework.llm.common import remainder, table
from gaugework.session import materialise

# Near-duplicates share so many percent of their n-grams of so many words.
NEAR_WORDS, NEAR_PERCENT = 5, 80
# Words that a worker remembers while it packs: fewer than packing alone has room for, as executors come with full heaps.
KNOWN_WORDS = 80_000

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a quality score of at least the threshold; learnt from the labels that are not held out."""
    labels = table(spark, sf_dir, "labels").filter(remainder("doc_id", 5) != 0)
    return ftrl_quality.accepted(docs, ftrl_quality.train(docs, labels))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group linked by similar word n-grams."""
    return jaccard_join.one_of_each(docs, NEAR_WORDS, NEAR_PERCENT)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return edit_leaks.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret replaced by a mark and their characters counted anew."""
    marked = credential_links.without_secrets(docs)
    if "n_chars" not in docs.columns:
        return marked
    counted = F.coalesce(F.length("text"), F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return marked.withColumn("n_chars", counted)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token ids with their sequence and place."""
    return slack_packing.pack(slack_packing.token_pieces(
        docs, slack_packing.tokenizer_path(), known_words=KNOWN_WORDS))


STAGES: list[tuple[str, Stage]] = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secrets", secrets),
    ("packing", packing),
]

# Scores, edit distances, tokens and packing are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return docs
