"""Scratch tables, and functions that several operators of this subpackage use."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from chronofact.session import shared_folder


#: Rows of an Arrow batch of whole texts, some 5 MB: its buffers outside the heap count in an executor's memory as well.
BATCH = 1000


def narrow_batches(spark: SparkSession) -> None:
    """Rows go to Python in batches of BATCH rows at most, for the rest of the session; no result depends on it."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH:
        spark.conf.set(key, str(BATCH))


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it back, which cuts lineage and survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def emptied(table: DataFrame) -> None:
    """Frees the disk of a table that ``written`` made; call it only when nothing reads the table any more."""
    (path,) = {f.rsplit("/", 1)[0] for f in table.inputFiles()} or {None}
    if path:
        table.sparkSession.createDataFrame([], table.schema).write.mode("overwrite").parquet(path)
