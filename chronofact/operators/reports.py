"""Failure isolation, tallies and statuses of collection and digest runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronofact.functions.text import bad_pub_date, digest_key, normalize_authors, normalize_tags, normalized_content, parse_pub_date
from chronofact.functions.urls import canonical_url, unsafe_reason


def normalize_entries(entries: DataFrame, sources: DataFrame) -> DataFrame:
    """Feed entries (source_id, raw_index, title, link, description, pub_date_raw, authors, categories) with their
    source's allowed_hosts and publisher -> every entry as a document, or with its first reject_reason.

    Reasons in order: no link, no title, the link's safety, the url's form, the date. One bad entry fails alone. An
    entry of an unknown source is rejected as unsafe, for it has no hosts.
    """
    rows = entries.join(sources.select(F.col("id").alias("source_id"), "publisher", "allowed_hosts"), "source_id", "left")
    hosts = F.coalesce("allowed_hosts", F.array().cast("array<string>"))
    rows = rows.select("*", unsafe_reason(F.col("link"), hosts).alias("_unsafe"), canonical_url(F.col("link")).alias("_c"))
    reason = (
        F.when(F.coalesce(F.trim("link"), F.lit("")) == "", F.lit("entry has no link"))
        .when(F.coalesce(F.trim("title"), F.lit("")) == "", F.lit("entry has no title"))
        .when(F.col("_unsafe").isNotNull(), F.concat(F.lit("unsafe entry link: "), "_unsafe"))
        .when(F.col("_c.url").isNull(), F.coalesce("_c.reason", F.lit("malformed url")))
        .when(bad_pub_date(F.col("pub_date_raw")), F.lit("unparseable pubDate"))
    )
    content = normalized_content(F.col("title"), F.col("description"))
    return rows.select(
        "source_id", "raw_index", "publisher", "title", "link", F.col("_c.url").alias("canonical_url"), digest_key(F.col("_c.url")).alias("dedupe_key"), content.alias("content_text"), digest_key(content).alias("content_hash"),
        parse_pub_date(F.col("pub_date_raw")).alias("published_at"), normalize_authors(F.col("authors")).alias("authors"), normalize_tags(F.col("categories")).alias("tags"), reason.alias("reject_reason"),
    )


def normalize_articles(articles: DataFrame, sources: DataFrame) -> DataFrame:
    """Parsed pages (source_id, url, status, title, body, canonical_url, published_at, authors, tags) -> documents, or a
    reject_reason; a page that couldn't be parsed keeps its status as the reason. The canonical link falls back to the
    requested url."""
    rows = articles.withColumnRenamed("canonical_url", "_link").join(sources.select(F.col("id").alias("source_id"), "publisher", "allowed_hosts"), "source_id", "left")
    rows = rows.withColumn("_link", F.coalesce(F.nullif(F.trim("_link"), F.lit("")), "url"))
    hosts = F.coalesce("allowed_hosts", F.array().cast("array<string>"))
    rows = rows.select("*", unsafe_reason(F.col("_link"), hosts).alias("_unsafe"), canonical_url(F.col("_link")).alias("_c"))
    reason = F.when(F.col("status") != "ok", F.col("status")).when(F.col("_unsafe").isNotNull(), F.concat(F.lit("unsafe link: "), "_unsafe")).when(F.col("_c.url").isNull(), F.coalesce("_c.reason", F.lit("malformed url")))
    content = normalized_content(F.col("title"), F.col("body"))
    return rows.select("source_id", "url", "publisher", "title", F.col("_c.url").alias("canonical_url"), digest_key(F.col("_c.url")).alias("dedupe_key"), content.alias("content_text"), digest_key(content).alias("content_hash"), "published_at", normalize_authors(F.col("authors")).alias("authors"), normalize_tags(F.col("tags")).alias("tags"), reason.alias("reject_reason"))


def collection_report(sources: DataFrame, outcomes: DataFrame, kind: str = "feed") -> DataFrame:
    """Per source: fetched, created_items, created_snapshots, unchanged, failed, status, first_reason.

    outcomes: source_id, raw_index, item_created, snapshot_created, reject_reason (null: ingested). A feed without items
    failed (an anomaly); with some failures it is partial. Articles failed only if all did; none asked for is a failure.
    """
    sums = outcomes.groupBy("source_id").agg(
        F.count("*").alias("fetched"),
        F.count_if(F.coalesce("item_created", F.lit(False))).alias("created_items"),
        F.count_if(F.coalesce("snapshot_created", F.lit(False))).alias("created_snapshots"),
        F.count_if(F.col("reject_reason").isNull() & ~F.coalesce("snapshot_created", F.lit(False))).alias("unchanged"),
        F.count_if(F.col("reject_reason").isNotNull()).alias("failed"),
        F.min(F.when(F.col("reject_reason").isNotNull(), F.struct("raw_index", "reject_reason")))["reject_reason"].alias("first_reason"),
    )
    rows = sources.select(F.col("id").alias("source_id")).join(sums, "source_id", "left").fillna(0, ["fetched", "created_items", "created_snapshots", "unchanged", "failed"])
    empty, failed = F.col("fetched") == 0, F.col("failed")
    if kind == "feed":
        status = F.when(empty, F.lit("failed")).when(failed > 0, F.lit("partial")).otherwise(F.lit("ok"))
        first = F.when(empty, F.lit("feed anomaly: no items")).otherwise(F.col("first_reason"))
    else:
        status = F.when(failed == F.col("fetched"), F.lit("failed")).when(failed > 0, F.lit("partial")).otherwise(F.lit("ok"))
        first = F.col("first_reason")
    return rows.withColumn("status", status).withColumn("first_reason", first)


def error_category(status, reason):
    """Closed vocabulary of a source's trouble; null if it is ok."""
    return (
        F.when(status == "ok", F.lit(None).cast("string"))
        .when(status == "partial", F.lit("partial_entry_failures"))
        .when(reason.startswith("fetch failed"), F.lit("fetch_failed"))
        .when(reason.startswith("parse failed"), F.lit("parse_failed"))
        .when(reason.startswith("feed anomaly"), F.lit("empty_feed"))
        .otherwise(F.lit("collection_failed"))
    )


def batch_status(reports: DataFrame) -> DataFrame:
    """All sources' reports -> one row: status, sources, and totals; items_processed counts new snapshots and unchanged."""
    sums = reports.agg(F.count("*").alias("sources"), F.count_if(F.col("status") == "ok").alias("_ok"), F.count_if(F.col("status") == "failed").alias("_failed"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("fetched", "created_items", "created_snapshots", "unchanged", "failed")])
    n = F.col("sources")
    status = F.when((n == 0) | (F.col("_failed") == n), F.lit("failed")).when(F.col("_ok") == n, F.lit("ok")).otherwise(F.lit("partial"))
    return sums.select(status.alias("status"), "sources", "fetched", "created_items", "created_snapshots", "unchanged", "failed", (F.col("created_snapshots") + F.col("unchanged")).alias("items_processed"))


def digest_run_report(outcomes: DataFrame) -> DataFrame:
    """(run_id, state, changes, claims, digest_status) per selected snapshot -> per run its counts and status.

    state: processed, failed or unresolved. A failed item makes the run partial; else it follows the digest's status.
    """
    sums = outcomes.groupBy("run_id").agg(
        F.count("*").alias("selected"), F.count_if(F.col("state") == "processed").alias("processed"), F.count_if(F.col("state") == "failed").alias("failed"), F.count_if(F.col("state") == "unresolved").alias("unresolved"),
        F.coalesce(F.sum("changes"), F.lit(0)).alias("changes"), F.coalesce(F.sum("claims"), F.lit(0)).alias("claims"), F.max("digest_status").alias("digest_status"),
    )
    status = F.when(F.col("failed") > 0, F.lit("partial")).when(F.col("digest_status").isin("published", "review"), F.col("digest_status")).otherwise(F.lit("draft"))
    return sums.withColumn("status", status).withColumn("published", F.coalesce(F.col("digest_status") == "published", F.lit(False)))


def run_health(runs: DataFrame) -> DataFrame:
    """Adds clean_zero_change (a draft that processed everything it selected and found nothing) and health.

    0: published or clean; 1: partial, review or another draft; 2: anything else.
    """
    clean = (F.col("status") == "draft") & ~F.col("published") & (F.col("selected") > 0) & (F.col("processed") == F.col("selected")) & (F.col("changes") == 0) & (F.col("claims") == 0) & (F.col("failed") == 0) & (F.col("unresolved") == 0)
    clean = F.coalesce(clean, F.lit(False))
    return runs.withColumn("clean_zero_change", clean).withColumn("health", F.when((F.col("status") == "published") | F.col("clean_zero_change"), 0).when(F.col("status").isin("partial", "review", "draft"), 1).otherwise(2))


def combined_status(collections: DataFrame, digests: DataFrame) -> DataFrame:
    """(run_id, status, created_snapshots) of collections and run reports -> run_id, combined status.

    failed collections fail; without new snapshots the run is no_updates if collection was ok, else partial; then the
    digest run decides: failed, partial, review; a healthy run that selected fewer snapshots than there were is capped;
    else published or clean_zero_change.
    """
    d = run_health(digests).select("run_id", F.col("status").alias("_d"), "health", "selected")
    rows = collections.join(d, "run_id", "left")
    status = (
        F.when(F.col("status") == "failed", F.lit("failed"))
        .when(F.col("created_snapshots") == 0, F.when(F.col("status") == "ok", F.lit("no_updates")).otherwise(F.lit("partial")))
        .when(F.coalesce("health", F.lit(2)) == 2, F.lit("failed"))
        .when(F.col("status") == "partial", F.lit("partial"))
        .when(F.col("health") == 1, F.when(F.col("_d") == "review", F.lit("review")).otherwise(F.lit("partial")))
        .when(F.col("created_snapshots") > F.col("selected"), F.lit("capped"))
        .when(F.col("_d") == "published", F.lit("published"))
        .otherwise(F.lit("clean_zero_change"))
    )
    return rows.select("run_id", status.alias("combined_status"))
