"""Integrity audits: one row per violation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronofact.operators.fingerprints import differing_parts, only_parts

#: Tasks that count keys, for each part of the table that is read.
PARTS = 8


def audit_foreign_key(child: DataFrame, fk: str | list[str], parent: DataFrame, pk: str | list[str], name: str) -> DataFrame:
    """(audit, key, n): non-null keys of child that parent lacks, with their number of rows."""
    fk, pk = ([x] if isinstance(x, str) else x for x in (fk, pk))
    keys = child.where(F.expr(" and ".join(f"`{c}` is not null" for c in fk))).groupBy(*fk).agg(F.count("*").alias("n"))
    there = parent.select(*[F.col(p).alias(f) for p, f in zip(pk, fk, strict=True)]).distinct()
    return keys.join(there, fk, "left_anti").select(F.lit(name).alias("audit"), F.concat_ws("|", *[F.col(c).cast("string") for c in fk]).alias("key"), "n")


def audit_latest_pointers(items: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Items whose latest snapshot is missing or another item's."""
    rows = items.where("latest_snapshot_id is not null").join(snapshots.select(F.col("snapshot_id").alias("latest_snapshot_id"), F.col("item_id").alias("_owner")), "latest_snapshot_id", "left")
    return rows.where(~F.col("item_id").eqNullSafe(F.col("_owner"))).select(F.lit("latest_pointer").alias("audit"), F.col("item_id").cast("string").alias("key"), F.lit(1).cast("long").alias("n"))


def audit_matches(pointers: DataFrame, rows: DataFrame, key: str, columns: list[str], name: str) -> DataFrame:
    """Pointers whose row is missing or differs in a column."""
    joined = pointers.alias("a").join(rows.alias("b"), F.col(f"a.{key}") == F.col(f"b.{key}"), "left")
    same = F.lit(True)
    for c in columns:
        same = same & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    return joined.where(F.col(f"b.{key}").isNull() | ~same).select(F.lit(name).alias("audit"), F.col(f"a.{key}").cast("string").alias("key"), F.lit(1).cast("long").alias("n"))


def audit_unique_key(df: DataFrame, key: list[str], name: str) -> DataFrame:
    """Keys that several rows have; nulls don't count as equal.

    Keys are dealt by hash before any is counted, to PARTS tasks for each part of df, so that a task counts a bounded
    number of keys, however many df has: counting where they are read would hold nearly every key of a part.
    """
    some = df.where(F.expr(" and ".join(f"`{c}` is not null" for c in key))).select(*[F.col(f"`{c}`") for c in key])
    dealt = some.repartition(PARTS * max(1, df.rdd.getNumPartitions()), *[F.col(f"`{c}`") for c in key])
    return dealt.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1").select(F.lit(name).alias("audit"), F.concat_ws("|", *[F.col(c).cast("string") for c in key]).alias("key"), "n")


def audit_checks(df: DataFrame, key: str, checks: dict[str, Column]) -> DataFrame:
    """A row for each row of df and check that is false; a null check passes, as in SQL."""
    failed = F.array_compact(F.array(*[F.when(~c, F.lit(n)) for n, c in checks.items()]))
    return df.select(F.explode(failed).alias("audit"), F.col(key).cast("string").alias("key"), F.lit(1).cast("long").alias("n"))


def audit_provenance(facts: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Facts whose observed_at isn't their snapshot's fetched_at."""
    rows = facts.join(snapshots.select("snapshot_id", "fetched_at"), "snapshot_id", "left")
    return rows.where(~F.col("observed_at").eqNullSafe(F.col("fetched_at"))).select(F.lit("provenance").alias("audit"), F.col("id").cast("string").alias("key"), F.lit(1).cast("long").alias("n"))


def audit_append_only(before: DataFrame, after: DataFrame, key: str, columns: list[str] | None = None, fingerprints: bool = False) -> DataFrame:
    """Rows deleted, or changed in one of the immutable columns, between two versions of a table; new rows are fine.

    With ``fingerprints`` both tables are summed up first by parts of their keys, and only rows of parts that differ are
    joined: none where the tables are equal. That is worth its scan where most of a table stays as it is.
    """
    columns = [c for c in before.columns if c != key] if columns is None else columns
    if fingerprints:
        parts = differing_parts(before, after, key, columns)
        if not parts:
            return before.sparkSession.createDataFrame([], "audit string, key string, n long")
        before, after = only_parts(before, key, parts), only_parts(after, key, parts)
    joined = before.alias("b").join(after.alias("a"), F.col(f"b.{key}") == F.col(f"a.{key}"), "left")
    differ = F.array_compact(F.array(*[F.when(~F.col(f"b.{c}").eqNullSafe(F.col(f"a.{c}")), F.lit(c)) for c in columns]))
    gone = F.col(f"a.{key}").isNull()
    rows = joined.select(F.col(f"b.{key}").cast("string").alias("key"), gone.alias("_gone"), differ.alias("_d"))
    return rows.where("_gone or size(_d) > 0").select(F.when(F.col("_gone"), F.lit("deleted")).otherwise(F.concat(F.lit("changed:"), F.array_join("_d", ","))).alias("audit"), "key", F.lit(1).cast("long").alias("n"))


def audit_publication(digests: DataFrame, claims: DataFrame, citations: DataFrame) -> DataFrame:
    """Published digests without claims, with unsupported claims, or with claims that cite nothing."""
    cited = citations.select("claim_id").distinct().withColumn("_c", F.lit(True))
    sums = claims.join(cited, "claim_id", "left").groupBy("digest_id").agg(F.count("*").alias("claims"), F.count_if(~F.col("validation_status").eqNullSafe(F.lit("supported"))).alias("bad"), F.count_if(F.col("_c").isNull()).alias("uncited"))
    rows = digests.where("status = 'published'").join(sums, "digest_id", "left")
    found = F.array_compact(F.array(F.when(F.col("claims").isNull(), F.struct(F.lit("no_claims").alias("audit"), F.lit(1).cast("long").alias("n"))), F.when(F.col("bad") > 0, F.struct(F.lit("unsupported_claims").alias("audit"), F.col("bad").alias("n"))), F.when(F.col("uncited") > 0, F.struct(F.lit("uncited_claims").alias("audit"), F.col("uncited").alias("n")))))
    return rows.select(F.explode(found).alias("x"), F.col("digest_id").cast("string").alias("key")).select("x.audit", "key", "x.n")
