"""Items and their immutable snapshots: deduplication, upserts, latest pointers.

Documents have: dedupe_key, content_hash, content_text, fetched_at, raw_index and the metadata columns named here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronofact.functions.text import digest_key
from chronofact.functions.urls import canonical_url
from chronofact.operators.ordered import scanned

META = ["publisher", "title", "published_at", "updated_at", "authors", "tags", "language", "event_id"]


def item_id(key: str = "dedupe_key"):
    """Deterministic id of an item."""
    return F.sha2(F.concat(F.lit("item\u0001"), F.col(key)), 256)


def snapshot_id():
    """Deterministic id of a snapshot: one per item and content."""
    return F.sha2(F.concat_ws("\u0001", F.lit("snapshot"), "item_id", "content_hash"), 256)


def upsert_items(existing: DataFrame | None, docs: DataFrame) -> DataFrame:
    """One row per dedupe_key: stored rows as they are, then the earliest document by (fetched_at, raw_index) of new keys.

    Null keys are left out. -> item_id, dedupe_key, first_fetched_at, identity columns, created.
    """
    keep = [c for c in ("source_id", "canonical_url") if c in docs.columns]
    first = docs.where("dedupe_key is not null").groupBy("dedupe_key").agg(F.min_by(F.struct(F.col("fetched_at").alias("first_fetched_at"), *keep), F.struct("fetched_at", "raw_index")).alias("r"))
    new = first.select(item_id().alias("item_id"), "dedupe_key", "r.*")
    if existing is None:
        return new.withColumn("created", F.lit(True))
    known = existing.select(*new.columns)
    return known.withColumn("created", F.lit(False)).unionByName(new.join(known.select("dedupe_key"), "dedupe_key", "left_anti").withColumn("created", F.lit(True)))


def add_snapshots(existing: DataFrame | None, docs: DataFrame) -> DataFrame:
    """The new snapshots: one per item and content, the earliest document of it; stored contents come back never.

    docs has item_id. -> snapshot_id, item_id, content_hash, fetched_at and the other columns of docs.
    """
    rest = [c for c in docs.columns if c not in ("item_id", "content_hash")]
    first = docs.groupBy("item_id", "content_hash").agg(F.min_by(F.struct(*rest), F.struct("fetched_at", "raw_index")).alias("r")).select("item_id", "content_hash", "r.*")
    if existing is not None:
        first = first.join(existing.select("item_id", "content_hash"), ["item_id", "content_hash"], "left_anti")
    return first.select(snapshot_id().alias("snapshot_id"), *first.columns)


def advance_latest(items: DataFrame, new_snapshots: DataFrame) -> DataFrame:
    """Items with the pointer and metadata of their greatest (fetched_at, snapshot_id) among stored and new snapshots.

    The pointer and all metadata move together, and only to a greater tuple; ``advanced`` tells whether they moved.
    items may have latest_fetched_at, latest_snapshot_id and metadata already; else they are taken as absent.
    """
    meta = [c for c in META if c in new_snapshots.columns]
    top = new_snapshots.groupBy("item_id").agg(F.max_by(F.struct("fetched_at", "snapshot_id", *meta), F.struct("fetched_at", "snapshot_id")).alias("n"))
    kinds = dict(new_snapshots.dtypes)
    for c, kind in (("latest_fetched_at", kinds["fetched_at"]), ("latest_snapshot_id", kinds["snapshot_id"]), *((m, kinds[m]) for m in meta)):
        if c not in items.columns:
            items = items.withColumn(c, F.lit(None).cast(kind))
    moved = F.col("n").isNotNull() & (F.col("latest_fetched_at").isNull() | (F.struct("n.fetched_at", "n.snapshot_id") > F.struct(F.col("latest_fetched_at").alias("fetched_at"), F.col("latest_snapshot_id").alias("snapshot_id"))))
    names = {"latest_fetched_at": "fetched_at", "latest_snapshot_id": "snapshot_id", **{m: m for m in meta}}
    return items.join(top, "item_id", "left").withColumn("advanced", F.coalesce(moved, F.lit(False))).select(*[F.when(F.col("advanced"), F.col(f"n.{names[c]}")).otherwise(F.col(c)).alias(c) if c in names else F.col(c) for c in items.columns], "advanced")


def ingest(items: DataFrame | None, snapshots: DataFrame | None, docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A batch of documents -> (items, new snapshots, outcomes).

    Outcomes has a row per document: whether it created its item (the first by fetched_at and raw_index, which tells
    documents apart), its snapshot, and is the item's latest now.
    """
    stored = None if items is None else items
    upserted = upsert_items(stored, docs)
    keyed = docs.where("dedupe_key is not null").withColumn("item_id", item_id())
    new = add_snapshots(snapshots, keyed)
    base = upserted if items is None else upserted.join(items.select("item_id", *[c for c in items.columns if c.startswith("latest_") or c in META]), "item_id", "left")
    state = advance_latest(base, new)
    created = new.select("item_id", "content_hash", F.col("fetched_at").alias("_f"), F.col("raw_index").alias("_i"), "snapshot_id")
    earliest = keyed.groupBy("item_id").agg(F.min(F.struct("fetched_at", "raw_index")).alias("_first"))
    firsts = upserted.where("created").select("item_id").join(earliest, "item_id")
    outcome = (
        keyed.join(created, (keyed["item_id"] == created["item_id"]) & (keyed["content_hash"] == created["content_hash"]) & (F.col("fetched_at") == F.col("_f")) & (F.col("raw_index") == F.col("_i")), "left")
        .drop(created["item_id"])
        .drop(created["content_hash"])
        .join(firsts, "item_id", "left")
        .join(state.where("advanced").select("item_id", F.col("latest_snapshot_id").alias("_latest")), "item_id", "left")
    )
    first_doc = F.coalesce(F.struct("fetched_at", "raw_index") == F.col("_first"), F.lit(False))
    outcomes = outcome.select(*docs.columns, "item_id", first_doc.alias("item_created"), F.col("snapshot_id").isNotNull().alias("snapshot_created"), F.coalesce(F.col("snapshot_id") == F.col("_latest"), F.lit(False)).alias("advanced"))
    return state, new, outcomes


def snapshot_history(snapshots: DataFrame, bucket: str = "day") -> DataFrame:
    """Adds revision (from 1), previous_hash and next_fetched_at of each item's snapshots by (fetched_at, snapshot_id).

    Snapshots are sorted within an item's days (``bucket``), and days are stitched by one row each.
    """
    rows = scanned(snapshots, ["item_id"], ["fetched_at", "snapshot_id"], F.date_trunc(bucket, "fetched_at"), number="revision", lag={"previous_hash": F.col("content_hash")}, lead={"next_fetched_at": F.col("fetched_at")})
    return rows.withColumn("revision", F.col("revision").cast("int"))


def item_identity_collapse(raw: DataFrame, url: str = "raw_url") -> DataFrame:
    """Raw links -> per canonical url: its key, the number of links and of different links; bad links are left out."""
    distinct = raw.groupBy(url).agg(F.count("*").alias("n")).withColumn("canonical_url", canonical_url(F.col(url))["url"])
    return distinct.where("canonical_url is not null").groupBy("canonical_url").agg(F.sum("n").alias("links"), F.count("*").alias("variants")).withColumn("dedupe_key", digest_key(F.col("canonical_url")))
