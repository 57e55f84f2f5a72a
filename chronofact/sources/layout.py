"""Tables laid out for their readers: partitioned by day, or bucketed by join key."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_by_day(rows: DataFrame, path: str, time: str, sort: list[str] | None = None) -> None:
    """Stores rows in a folder a day (column ``day``; null times have a day of their own), each written by few tasks.

    Rows are dealt by day and, within it, by the hash of ``sort`` (all columns if none is given) over four tasks at most,
    so a hot day isn't one task's; files are sorted by ``sort``, which gives their row groups narrow bounds.
    """
    dated = rows.withColumn("day", F.to_date(time))
    spread = F.pmod(F.xxhash64(*(sort or rows.columns)), F.lit(4))
    dated.repartition("day", spread).sortWithinPartitions("day", *(sort or [])).write.partitionBy("day").parquet(path)


def read_days(spark: SparkSession, path: str, first: str | None = None, end: str | None = None) -> DataFrame:
    """The rows of the days from ``first`` up to but not with ``end``; other days' folders are not opened."""
    rows = spark.read.parquet(path)
    if first is not None:
        rows = rows.where(F.col("day") >= F.lit(first).cast("date"))
    return rows if end is None else rows.where(F.col("day") < F.lit(end).cast("date"))


def write_bucketed(rows: DataFrame, path: str, key: list[str], buckets: int, name: str | None = None) -> str:
    """Stores rows in buckets by their key as a catalog table over ``path`` and names it.

    Tables with the same key and number of buckets join and aggregate by it without moving a row.
    """
    name = name or f"bucketed_{uuid.uuid4().hex}"
    rows.repartition(buckets, *key).write.option("path", path).bucketBy(buckets, *key).sortBy(*key).saveAsTable(name)
    return name
