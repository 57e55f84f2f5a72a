"""The driver's tables in the shapes that the operators take."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as facts: a user's value of an event type; every 17th event withholds its value."""
    hidden = F.col("event_id") % 17 == 0
    return read(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        F.col("event_id").alias("snapshot_id"),
        F.concat(F.lit("Company "), F.col("user_id").cast("string")).alias("company"),
        F.lit("Usage").alias("product"),
        F.concat(F.lit("company "), F.col("user_id").cast("string")).alias("company_key"),
        F.lit("usage").alias("product_key"),
        F.col("event_type").alias("field"),
        F.when(~hidden, F.col("value").cast("string")).alias("value"),
        F.when(hidden, F.lit("not_disclosed")).otherwise(F.lit("disclosed")).alias("disclosure_status"),
        F.lit(1).alias("extraction_version"),
        F.col("ts").alias("observed_at"),
    )


#: The same in SQL.
OBSERVATIONS = """
    obs as (
      select event_id as id, event_id as snapshot_id, 'Company ' || user_id as company, 'Usage' as product,
             'company ' || user_id as company_key, 'usage' as product_key, event_type as field,
             case when event_id % 17 <> 0 then cast(value as varchar) end as value,
             case when event_id % 17 = 0 then 'not_disclosed' else 'disclosed' end as disclosure_status,
             1 as extraction_version, ts as observed_at
      from events
    )
"""


def fetched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as fetched documents: 200 items by length, a document a second, metadata from its columns."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return read(spark, sf_dir, "documents").select(
        F.concat(F.lit("sha256:"), (F.col("n_chars") % 200).cast("string")).alias("dedupe_key"),
        F.concat(F.lit("sha256:"), F.sha2(text, 256)).alias("content_hash"),
        text.alias("content_text"),
        F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id")).alias("fetched_at"),
        F.col("doc_id").alias("raw_index"),
        "source",
        F.col("source").alias("publisher"),
        F.col("lang").alias("language"),
        F.substring(text, 1, 40).alias("title"),
    )


FETCHED = """
    docs as (
      select 'sha256:' || (n_chars % 200) as dedupe_key, 'sha256:' || sha256(coalesce(text, '')) as content_hash,
             timestamp '2024-01-01' + to_seconds(doc_id) as fetched_at, doc_id as raw_index, source as publisher, lang as language
      from documents
    )
"""
