"""Session defaults used by tests and the bench; a cluster brings its own."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(name: str = "chronofact", cores: int | None = None, memory: str = "12g") -> SparkSession:
    """A local session with AQE on, UTC, and few shuffle partitions."""
    n = cores or int(os.environ.get("BENCH_CPUS", "8"))
    return (
        SparkSession.builder.master(f"local[{n}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(n))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir; it is made Spark's checkpoint folder too.

    Where the setting is missing, a local session (tests) gets a temporary folder of its own; a cluster is refused, as
    its executors would each write to their own disks.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def stored(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it back, which cuts lineage and survives lost executors."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession) -> None:
    """Sends this package to the workers of a session that would not find it by themselves.

    Workers find it where the folder that holds it is on PYTHONPATH or is the working folder; else it goes along as a zip,
    once a session.
    """
    root = Path(__file__).resolve().parents[1]
    known = [Path(p).resolve() for p in (*os.environ.get("PYTHONPATH", "").split(os.pathsep), os.getcwd()) if p]
    context = spark.sparkContext
    if root in known or any(name.startswith("chronofact-") for name in context._python_includes):
        return
    to = Path(tempfile.mkdtemp(prefix="spark-package-")) / f"chronofact-{os.getpid()}.zip"
    with zipfile.ZipFile(to, "w") as z:
        for p in [*sorted((root / "chronofact").rglob("*.py")), *root.glob("corpus_pipeline.py")]:
            z.write(p, p.relative_to(root))
    context.addPyFile(str(to))
