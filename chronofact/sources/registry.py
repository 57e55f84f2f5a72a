"""The source dimension and typed contract tables."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronofact.functions.urls import url_safety_parts

SOURCE_SCHEMA = "id string, publisher string, type string, url string, priority int, cadence_minutes int, allowed_hosts array<string>, enabled boolean"


def read_sources(spark: SparkSession, rows: Iterable[dict] | str) -> DataFrame:
    """Sources from dicts, or from a path of JSON files, with allowed_hosts defaulting to the url's own host.

    The rules are audited by ``source_problems``; a registry is bounded by hand curation and small.
    """
    df = spark.read.schema(SOURCE_SCHEMA).option("multiLine", True).option("mode", "FAILFAST").json(rows) if isinstance(rows, str) else spark.createDataFrame([{n: r.get(n) for n in (p.split()[0] for p in SOURCE_SCHEMA.split(", "))} for r in rows], SOURCE_SCHEMA)
    host = url_safety_parts(F.col("url"))["host"]
    return df.withColumn("allowed_hosts", F.when(F.size(F.coalesce("allowed_hosts", F.array().cast("array<string>"))) > 0, F.col("allowed_hosts")).otherwise(F.array_compact(F.array(host)))).withColumn("enabled", F.coalesce("enabled", F.lit(True)))


def source_problems(sources: DataFrame) -> DataFrame:
    """(id, problem) of every broken rule: unique id, https url without user-info, priority 0-3, cadence above 0."""
    p = url_safety_parts(F.col("url"))
    rows = sources.withColumn("_p", p)
    found = F.array_compact(
        F.array(
            F.when(F.coalesce("id", F.lit("")) == "", F.lit("missing id")),
            F.when(~F.col("_p.ok") | (F.coalesce("_p.scheme", F.lit("")) != "https") | F.col("_p.host").isNull(), F.lit("url is not https")),
            F.when(F.coalesce("_p.userinfo", F.lit(False)), F.lit("user-info in url")),
            F.when(~F.coalesce(F.col("priority").between(0, 3), F.lit(False)), F.lit("priority out of range")),
            F.when(~F.coalesce(F.col("cadence_minutes") > 0, F.lit(False)), F.lit("cadence not positive")),
        )
    )
    repeated = sources.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id", F.lit("repeated id").alias("problem"))
    return rows.select("id", F.explode(found).alias("problem")).unionByName(repeated)


def read_contract(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON arrays as a typed table; a row that violates the schema fails the read."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def read_contract_rows(spark: SparkSession, path: str, schema: str, required: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Files of JSON arrays -> (good rows, quarantine), where one bad row or file fails nothing else.

    A row is bad if it is no object of the schema (a field of another type, at any depth) or a ``required`` field is missing
    or null. The quarantine has file, place (in its array; null for a file that is no array), reason and raw text. Each
    file is one array and read whole by a task, so packs should come in files of some megabytes.
    """
    text = spark.read.option("wholetext", True).text(path).select(F.input_file_name().alias("file"), "value")
    split = text.withColumn("rows", F.from_json("value", "array<string>"))
    each = split.where("rows is not null").select("file", F.posexplode("rows").alias("place", "raw"))
    broken = split.where("rows is null").select("file", F.lit(None).cast("int").alias("place"), F.lit("no array").alias("reason"), F.col("value").alias("raw"))
    # Read as it is declared, with a column more that takes what doesn't fit.
    parsed = each.withColumn("row", F.from_json("raw", f"{schema}, _unfit string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_unfit"}))
    missing = F.array_compact(F.array(*[F.when(F.col(f"row.{c}").isNull(), F.lit(c)) for c in required or []])) if required else F.array().cast("array<string>")
    reason = F.when(F.col("raw").isNull() | F.col("row").isNull() | F.col("row._unfit").isNotNull(), F.lit("schema")).when(F.size(missing) > 0, F.concat(F.lit("missing "), F.array_join(missing, ", ")))
    judged = parsed.withColumn("reason", reason)
    good = judged.where("reason is null").select("row.*").drop("_unfit")
    return good, judged.where("reason is not null").select("file", "place", "reason", "raw").unionByName(broken)


def due_sources(sources: DataFrame, runs: DataFrame, now) -> DataFrame:
    """Enabled sources whose last run (source_id, finished_at) is a cadence ago, or that never ran."""
    last = runs.groupBy(F.col("source_id").alias("id")).agg(F.max("finished_at").alias("last_run"))
    due = F.col("last_run").isNull() | (F.col("last_run") + F.make_dt_interval(F.lit(0), F.lit(0), F.col("cadence_minutes")) <= now)
    return sources.where("enabled").join(last, "id", "left").where(due)
