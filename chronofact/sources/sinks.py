"""Sinks: immutable tables are appended to, states are replaced, metrics are logged."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def append_new(rows: DataFrame, path: str, key: list[str], day: str | None = None) -> None:
    """Appends the rows whose key isn't stored yet (insert or ignore); partitions by the date of ``day``.

    Of rows of the batch that share a key the least in the order of all columns is stored. One writer at a time.
    """
    spark = rows.sparkSession
    fresh = rows.groupBy(*key).agg(F.min(F.struct(*[c for c in rows.columns if c not in key], *key)).alias("r")).select(*[F.col(f"r.{c}").alias(c) for c in rows.columns])
    if exists(spark, path):
        fresh = fresh.join(spark.read.parquet(path).select(*key), key, "left_anti")
    fresh = fresh if day is None else fresh.withColumn("day", F.to_date(day))
    writer = fresh.write.mode("append")
    (writer if day is None else writer.partitionBy("day")).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a table is stored at the path, whatever the store."""
    try:
        return bool(spark.read.parquet(path).columns)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return False
        raise


def write_state(state: DataFrame, path: str, version: int) -> str:
    """Writes a table's new state beside the old ones, so that readers and retries see whole versions, and returns its path."""
    to = f"{path}/version={version:012d}"
    state.write.mode("overwrite").parquet(to)
    return to


def merge_state(state: DataFrame, table: str, key: list[str]) -> None:
    """Upserts into a catalog table of a v2 source that can merge."""
    on = F.expr(" and ".join(f"{table}.{k} <=> s.{k}" for k in key))
    state.alias("s").mergeInto(table, on).whenMatched().updateAll().whenNotMatched().insertAll().merge()


def log_metrics(metrics: DataFrame, path: str, run_id: str, key: list[str] | None = None) -> None:
    """Appends a run's metric rows to the history, once: rows of the run with the same ``key`` (default: all columns) stay as they are."""
    append_new(metrics.withColumn("run_id", F.lit(run_id)), path, ["run_id", *(key or metrics.columns)])


class InFlight:
    """Counts that a job takes of its rows while it runs, and logs once a run.

    ``rows`` gives the frame to use in the job's one action; ``log`` waits for that action.
    """

    def __init__(self, rows: DataFrame, measures: dict[str, Column]) -> None:
        self.seen = Observation()
        self.rows = rows.observe(self.seen, *[c.cast("double").alias(n) for n, c in measures.items()])

    def log(self, path: str, run_id: str) -> None:
        """Adds (metric, value, run_id) rows to the history; a run that is logged already adds nothing."""
        found = self.rows.sparkSession.createDataFrame(sorted(self.seen.get.items()), "metric string, value double")
        log_metrics(found, path, run_id, ["metric"])
