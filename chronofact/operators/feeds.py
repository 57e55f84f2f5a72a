"""Selections, keyset feeds and pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronofact.operators.ordered import with_position


def with_windows(requests: DataFrame) -> DataFrame:
    """(digest_date, since) requests -> with window_start, window_end (end excluded) and ok.

    The window ends at the midnight after digest_date. since: null (24 hours), ``Nh``, ``Nd``, bare hours, or an ISO
    time at which it starts. A start that is no time or not before the end makes a row not ok; its window is null.
    """
    end = F.to_timestamp(F.date_add("digest_date", 1))
    n = F.regexp_extract(F.trim("since"), r"^(\d+)\s*([hd]?)$", 1).try_cast("int")
    unit = F.regexp_extract(F.trim("since"), r"^(\d+)\s*([hd]?)$", 2)
    hours = F.when(F.col("since").isNull(), F.lit(24)).when(unit == "d", n * 24).otherwise(n)
    start = F.coalesce(end - F.make_dt_interval(F.lit(0), hours, F.lit(0), F.lit(0)), F.try_to_timestamp(F.when(hours.isNull(), F.trim("since"))))
    ok = F.coalesce(start < end, F.lit(False))
    return requests.select("*", F.when(ok, start).alias("window_start"), F.when(ok, end).alias("window_end"), ok.alias("ok"))


def in_window(ts: Column, start: Column, end: Column) -> Column:
    """Half-open: the end is excluded."""
    return (ts >= start) & (ts < end)


def select_for_windows(snapshots: DataFrame, windows: DataFrame, n: int, ts: str = "fetched_at", key: str = "id") -> DataFrame:
    """For every window (window_id, window_start, window_end) its first n snapshots by (time, id), with their rank.

    Windows may overlap. They are spread over the days they touch, so the range join is an equi-join on the day. Ranks
    are taken within each day first, so that a window's rows never meet in one sort beyond n a day.
    """
    days = windows.withColumn("_day", F.explode(F.sequence(F.to_date("window_start"), F.to_date(F.col("window_end") - F.expr("interval 1 microsecond")))))
    hit = snapshots.withColumn("_day", F.to_date(ts)).join(days, "_day").where(in_window(F.col(ts), F.col("window_start"), F.col("window_end")))
    daily = hit.withColumn("_no", F.row_number().over(Window.partitionBy("window_id", "_day").orderBy(ts, key))).where(F.col("_no") <= n)
    w = Window.partitionBy("window_id").orderBy(ts, key)
    return daily.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n).drop("_day", "_no")


def select_snapshots(items: DataFrame, snapshots: DataFrame, start: Column, end: Column, limit: int | None = None) -> DataFrame:
    """Snapshots of known items in [start, end), in order of (fetched_at, id), the first ``limit`` if it is given."""
    rows = snapshots.where(in_window(F.col("fetched_at"), start, end)).join(items, "item_id").orderBy("fetched_at", "id")
    return rows if limit is None else rows.limit(limit)


def keyset_feed(rows: DataFrame, ts: str, key: str, limit: int, after: tuple | None = None, where: Column | None = None) -> DataFrame:
    """A page of a feed in descending (time, id) order: at most limit + 1 rows, the extra one telling that more follow.

    Adds position (from 1) and has_more. The redundant bound on the time alone is what reaches the Parquet scan.
    """
    if where is not None:
        rows = rows.where(where)
    if after is not None:
        kind, kid = rows.schema[ts].dataType, rows.schema[key].dataType
        t, k = F.lit(after[0]).cast(kind), F.lit(after[1]).cast(kid)
        rows = rows.where((F.col(ts) <= t) & (F.struct(F.col(ts).alias("t"), F.col(key).alias("k")) < F.struct(t.alias("t"), k.alias("k"))))
    page = rows.orderBy(F.desc(ts), F.desc(key)).limit(limit + 1)
    # The page is limit + 1 rows, so one task numbers it.
    w = Window.orderBy(F.desc(ts), F.desc(key))
    numbered = page.withColumn("position", F.row_number().over(w)).withColumn("has_more", F.count("*").over(Window.partitionBy()) > limit)
    return numbered.where(F.col("position") <= limit)


def updates_feed(items: DataFrame, limit: int, after: tuple | None = None, **filters: str) -> DataFrame:
    """Items by first_fetched_at, newest first, with equality filters, in the public projection."""
    public = ["id", "source_id", "publisher", "title", "canonical_url", "published_at", "first_fetched_at", "authors", "tags", "language", "latest_snapshot_id"]
    for name, value in filters.items():
        items = items.where(F.col(name) == value)
    page = keyset_feed(items, "first_fetched_at", "id", limit, after)
    return page.select(*[c for c in public if c in items.columns], "position", "has_more")


def changes_feed(changes: DataFrame, subjects: DataFrame, limit: int, after: tuple | None = None, detected_from=None, detected_to=None, **filters: str) -> DataFrame:
    """Changes with their subject's names, newest first, in [detected_from, detected_to)."""
    for name, value in filters.items():
        changes = changes.where(F.col(name) == value)
    if detected_from is not None:
        changes = changes.where(F.col("detected_at") >= detected_from)
    if detected_to is not None:
        changes = changes.where(F.col("detected_at") < detected_to)
    return keyset_feed(changes.join(subjects, ["company_key", "product_key"]), "detected_at", "id", limit, after)


def digests_feed(digests: DataFrame, limit: int, after: tuple | None = None, date_from=None, date_to=None) -> DataFrame:
    """Published digests by (date, id), newest first, in [date_from, date_to)."""
    rows = digests.where("status = 'published'")
    if date_from is not None:
        rows = rows.where(F.col("digest_date") >= date_from)
    if date_to is not None:
        rows = rows.where(F.col("digest_date") < date_to)
    return keyset_feed(rows, "digest_date", "id", limit, after)


def paginate_all(df: DataFrame, ts: str, key: str, page_size: int) -> DataFrame:
    """Adds position (from 0) and page (from 1) of every row in descending (time, id) order.

    Rows are sorted by ranges of (time, id), so neither a hot day nor many rows without a time end in one task (see
    ``with_position``). Every row is on one page; ties go by id. Rows without a time come last.
    """
    numbered = with_position(df, [F.desc_nulls_last(ts), F.desc(key)])
    return numbered.withColumn("page", F.floor(F.col("position") / page_size) + 1)


def latest_published(digests: DataFrame) -> DataFrame:
    """The published digest of greatest (date, id)."""
    return digests.where("status = 'published'").orderBy(F.desc("digest_date"), F.desc("id")).limit(1)


def published_by_date(digests: DataFrame, date: Column) -> DataFrame:
    """The published digests of a date."""
    return digests.where((F.col("status") == "published") & (F.col("digest_date") == date))


def capped_rows(snapshots: DataFrame, windows: DataFrame, n: int, ts: str = "fetched_at", key: str = "id") -> DataFrame:
    """Rows of each window that a selection of its first n leaves out."""
    days = windows.withColumn("_day", F.explode(F.sequence(F.to_date("window_start"), F.to_date(F.col("window_end") - F.expr("interval 1 microsecond")))))
    hit = snapshots.withColumn("_day", F.to_date(ts)).join(days, "_day").where(in_window(F.col(ts), F.col("window_start"), F.col("window_end"))).drop("_day")
    return hit.join(select_for_windows(snapshots, windows, n, ts, key).select("window_id", key), ["window_id", key], "left_anti")
