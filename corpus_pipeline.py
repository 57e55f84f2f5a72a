"""A corpus pipeline of five operators: toxicity, exact dedup, near-dedup, secret scans, best-fit packing."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronofact.llm.exact_dedup import exact_survivors
from chronofact.llm.packing import pack_documents
from chronofact.llm.secrets import redact_secrets
from chronofact.llm.shared import narrow_batches, scratch_path, written
from chronofact.llm.similar_texts import similar_groups
from chronofact.llm.toxicity import scored, train

#: Documents that score this or more are rejected.
TOXIC = 0.3


def numbered(docs: DataFrame, name: str) -> DataFrame:
    """(row, doc): stored rows with a number of their own; docs' columns stay inside doc, where no name can clash."""
    return written(docs.select(F.monotonically_increasing_id().alias("row"), F.struct("*").alias("doc")), name)


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that a model of labels.toxic rejects.

    Each row is scored by its text alone, null and empty ones too; null and repeated ids are rows of their own.
    """
    narrow_batches(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col("toxic").alias("label"))
    return docs.where(scored(train(docs, labels)) < TOXIC)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each text: that of largest doc_id.

    The decision is made by row. A null text counts as empty; a null doc_id is below all others; of rows that repeat id
    and text one stays; a row never goes because another row has its id.
    """
    narrow_batches(spark)
    return exact_survivors(docs)


def drop_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the row of smallest doc_id in each group of texts whose five-word shingles have Jaccard 0.8 or more.

    Links are by similarity, groups by links. The decision is made by row: of rows with one doc_id in a group one stays,
    and a row without doc_id stays only where no row of its group has one. Null and empty texts are alike.
    """
    narrow_batches(spark)
    rows = numbered(docs, "near_rows")
    parts = similar_groups(rows.select("row", "doc.text"))
    ids = rows.select(F.col("row").alias("node"), F.col("doc.doc_id").isNull().alias("no_id"), "doc.doc_id").join(parts, "node")
    kept = ids.groupBy("component").agg(F.min(F.struct("no_id", "doc_id", "node"))["node"].alias("row"))
    # Stored, so that Spark sees how few rows go before it chooses the join with whole rows.
    dropped = written(parts.select(F.col("node").alias("row")).join(kept.select("row"), "row", "left_anti"), "near_dropped")
    return rows.join(dropped, "row", "left_anti").select("doc.*")


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets in the texts; all documents stay."""
    narrow_batches(spark)
    return redact_secrets(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places all pieces of all documents in sequences of 2048 tokens."""
    narrow_batches(spark)
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", reject_toxic),
    ("exact_dedup", drop_copies),
    ("simhash_near_dedup", drop_similar),
    ("secret_scans", mask_secrets),
    ("best_fit_packing", pack_sequences),
]

#: A trained model, XXH64 fingerprints and a tokenizer are beyond SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; each but the last is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
