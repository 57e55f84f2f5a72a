"""Fact history: append-only records, latest pointers, field-level changes and change sets.

Facts have: id, snapshot_id, company, product, company_key, product_key, field, value, disclosure_status,
extraction_version, observed_at (and confidence and other attributes where an operator says so). The order of a key's
facts is the tuple (observed_at, snapshot_id, extraction_version, id).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronofact.functions.text import as_number, normalise_name
from chronofact.operators.ordered import as_of, scanned, with_previous

KEYS = ["company_key", "product_key", "field"]
ORDER = ["observed_at", "snapshot_id", "extraction_version", "id"]
FACT_KEY = ["snapshot_id", "company_key", "product_key", "field", "extraction_version"]
#: Attributes that a replayed fact must repeat, beside confidence.
REPLAYED = ["value", "disclosure_status", "quoted_span", "extraction_method", "extraction_model", "prompt_version", "observed_at"]


def record_facts(existing: DataFrame, new: DataFrame) -> DataFrame:
    """New facts against the stored ones -> new's columns, ``action`` (insert, replay, divergent) and ``diverges``, the attributes that differ.

    Of several new rows with one key, the first by id counts as inserted and the others are held against it. Stored rows
    are never rewritten. Confidences within 1e-6 are equal; nulls equal nulls.
    """
    here = [c for c in REPLAYED if c in new.columns]
    w = Window.partitionBy(*FACT_KEY)
    attributes = F.struct(*here, *(["confidence"] if "confidence" in new.columns else []))
    stored = existing.groupBy(*FACT_KEY).agg(F.min_by(F.struct(*[c for c in here], *(["confidence"] if "confidence" in new.columns else [])), "id").alias("_stored"))
    same = None
    for k in FACT_KEY:
        c = F.col(f"n.{k}").eqNullSafe(F.col(f"s.{k}"))
        same = c if same is None else same & c
    rows = new.withColumn("_first", F.min(F.struct(F.col("id").alias("_id"), attributes.alias("_a"))).over(w)).alias("n").join(stored.alias("s"), same, "left").select("n.*", "s._stored")
    held = F.coalesce("_stored", F.when(F.col("id") != F.col("_first._id"), F.col("_first._a")))
    rows = rows.withColumn("_held", held)
    differs = [F.when(~F.col(c).eqNullSafe(F.col(f"_held.{c}")), F.lit(c)) for c in here]
    if "confidence" in new.columns:
        differs.append(F.when(~F.coalesce(F.abs(F.col("confidence") - F.col("_held.confidence")) <= 1e-6, F.col("confidence").eqNullSafe(F.col("_held.confidence"))), F.lit("confidence")))
    diverges = F.array_compact(F.array(*differs))
    return rows.withColumn("diverges", F.when(F.col("_held").isNotNull(), diverges).otherwise(F.array().cast("array<string>"))).withColumn(
        "action", F.when(F.col("_held").isNull(), F.lit("insert")).when(F.size("diverges") == 0, F.lit("replay")).otherwise(F.lit("divergent"))
    ).drop("_first", "_stored", "_held")


def current_facts(facts: DataFrame, state: DataFrame | None = None) -> DataFrame:
    """The row with the greatest order tuple of each key, of the batch and a stored state of the same columns."""
    rows = facts if state is None else state.select(*facts.columns).unionByName(facts)
    best = rows.groupBy(*KEYS).agg(F.max_by(F.struct(*[c for c in facts.columns if c not in KEYS]), F.struct(*ORDER)).alias("_r"))
    return best.select(*[F.col(c) if c in KEYS else F.col(f"_r.{c}").alias(c) for c in facts.columns])


def read_current(current: DataFrame, facts: DataFrame, subjects: DataFrame, fields: list[str]) -> DataFrame:
    """Pointers of some subjects and fields with their evidence; subjects has company_key and product_key."""
    wanted = current.where(F.col("field").isin(*fields)).join(subjects.select("company_key", "product_key").distinct(), ["company_key", "product_key"], "left_semi").select(*KEYS, "id")
    return wanted.join(facts.drop(*KEYS), "id")


def values_equivalent(a: Column, b: Column) -> Column:
    """Null-safe: equal strings, equal numbers without ``, $ %``, else equal normalised names."""
    x, y = as_number(a, "[,$%]"), as_number(b, "[,$%]")
    return F.when(a.isNull() | b.isNull(), a.eqNullSafe(b)).otherwise((a == b) | F.when(x.isNotNull() & y.isNotNull(), x == y).otherwise(normalise_name(a) == normalise_name(b)))


def change_type(previous: Column, current: Column) -> Column:
    """disclosed, not_disclosed, increased, decreased, else changed; numbers are read from the raw strings."""
    x, y = as_number(previous), as_number(current)
    return (
        F.when(previous.isNull() & current.isNotNull(), F.lit("disclosed"))
        .when(previous.isNotNull() & current.isNull(), F.lit("not_disclosed"))
        .when(y > x, F.lit("increased"))
        .when(y < x, F.lit("decreased"))
        .otherwise(F.lit("changed"))
    )


def detect_changes(facts: DataFrame, state: DataFrame | None = None, equivalence: str = "strict", batch_id: str = "batch", bucket: str = "day") -> DataFrame:
    """Changes between successive observations of each key -> keys, company, product, change_type, previous, current,
    detected_at, change_set_id, id.

    Each observation meets the one before it in tuple order, whether or not that one changed anything, so a change cites
    the newest confirmation. First observations, corrections within a snapshot and equal values give nothing. With
    ``state``, rows at or below a key's stored tuple are late and give nothing either. ``tolerant`` equivalence ignores
    formatting; ``strict`` compares value and disclosure status. ``bucket`` is the unit of time within which rows are
    sorted together; it affects speed alone. Ids are digests of natural keys, so reruns agree.
    """
    rows = facts.withColumn("_new", F.lit(True))
    if state is not None:
        held = state.groupBy(*KEYS).agg(F.max(F.struct(*ORDER)).alias("_top"))
        rows = rows.join(held, KEYS, "left").where(F.col("_top").isNull() | (F.struct(*ORDER) > F.col("_top"))).drop("_top")
        rows = rows.unionByName(current_facts(state.select(*facts.columns)).withColumn("_new", F.lit(False)))
    seen = F.struct("value", "disclosure_status", "observed_at", "snapshot_id")
    paired = with_previous(rows, KEYS, ORDER, F.date_trunc(bucket, "observed_at"), {"previous": seen}).where("_new and previous is not null")
    p, c = F.col("previous.value"), F.col("value")
    same_status = F.col("previous.disclosure_status").eqNullSafe(F.col("disclosure_status"))
    equal = (p.eqNullSafe(c) & same_status) if equivalence == "strict" else values_equivalent(p, c)
    changed = paired.where((F.col("previous.snapshot_id") != F.col("snapshot_id")) & ~equal)
    side = ("value", "observed_at", "snapshot_id")
    return changed.select(
        *KEYS,
        "company",
        "product",
        change_type(p, c).alias("change_type"),
        F.struct(*[F.col(f"previous.{x}").alias(x) for x in side]).alias("previous"),
        F.struct(*side).alias("current"),
        F.col("observed_at").alias("detected_at"),
        change_set_id(F.lit(batch_id)).alias("change_set_id"),
        F.sha2(F.concat_ws("\u0001", *KEYS, F.col("snapshot_id").cast("string"), F.col("extraction_version").cast("string")), 256).alias("id"),
    )


def change_set_id(batch: Column) -> Column:
    """One set per batch and subject."""
    return F.sha2(F.concat_ws("\u0001", batch, "company_key", "product_key"), 256)


def change_shape_ok(previous: Column, current: Column, kind: Column) -> Column:
    """Whether a change has the sides its type needs. previous and current are structs with value and snapshot_id."""
    def grounded(x: Column) -> Column:
        return x.isNotNull() & x["value"].isNotNull() & x["snapshot_id"].isNotNull()

    withheld = current["value"].isNull() & current["snapshot_id"].isNotNull()
    opened = previous.isNull() | (previous["value"].isNull() & previous["snapshot_id"].isNotNull())
    return F.when(kind == "not_disclosed", grounded(previous) & withheld).when(kind == "disclosed", grounded(current) & opened).otherwise(grounded(previous) & grounded(current))


def assign_positions(changes: DataFrame, existing: DataFrame | None = None, bucket: str = "day") -> DataFrame:
    """Adds position, contiguous from 0 in each change set and going on after its greatest stored one.

    A set's changes are numbered by (detected_at, field, id) within its days; ``bucket`` is that unit of time.
    """
    out = scanned(changes, ["change_set_id"], ["detected_at", "field", "id"], F.date_trunc(bucket, "detected_at"), number="_number")
    out = out.withColumn("position", (F.col("_number") - 1).cast("int")).drop("_number")
    if existing is None:
        return out
    top = existing.groupBy("change_set_id").agg((F.max("position") + 1).alias("_next"))
    return out.join(top, "change_set_id", "left").withColumn("position", F.col("position") + F.coalesce("_next", F.lit(0))).drop("_next").select(*changes.columns, "position")


def build_change_sets(changes: DataFrame) -> DataFrame:
    """Positioned changes -> per subject: set ids, changes in order, snapshot ids of both sides in first-seen order.

    ``consistent`` is false where the changes of a subject disagree on their set.
    """
    items = F.array_sort(F.collect_list(F.struct("position", "id", "field", "change_type", "previous", "current")))
    grouped = changes.groupBy("company_key", "product_key").agg(items.alias("changes"), F.min("change_set_id").alias("change_set_id"), (F.min("change_set_id") == F.max("change_set_id")).alias("consistent"))
    ids = {side: F.array_distinct(F.array_compact(F.col(f"changes.{side}.snapshot_id"))) for side in ("previous", "current")}
    return grouped.select("change_set_id", "company_key", "product_key", "consistent", "changes", ids["previous"].alias("previous_snapshot_ids"), ids["current"].alias("current_snapshot_ids"))


def change_set_pages(changes: DataFrame, size: int) -> DataFrame:
    """Positioned changes -> change sets in pages of ``size`` changes, for sets too large for one row.

    change_set_id, company_key, product_key, page (from 0), changes, and the snapshots of both sides that the page is the
    first to cite, in first-seen order: end to end the pages are what ``build_change_sets`` gives.
    """
    page = F.expr(f"position div {int(size)}")
    keys = ["change_set_id", "company_key", "product_key"]
    items = F.array_sort(F.collect_list(F.struct("position", "id", "field", "change_type", "previous", "current")))
    paged = changes.groupBy(*keys, page.alias("page")).agg(items.alias("changes"))
    cited = change_set_citations(changes).groupBy("change_set_id", page.alias("page")).agg(
        *[F.array_sort(F.collect_list(F.when(F.col("side") == s, F.struct("position", "snapshot_id")))).alias(s) for s in ("previous", "current")]
    )
    ids = [F.coalesce(F.col(f"{s}.snapshot_id"), F.array()).alias(f"{s}_snapshot_ids") for s in ("previous", "current")]
    return paged.join(cited, ["change_set_id", "page"], "left").select(*keys, "page", "changes", *ids)


def change_set_citations(changes: DataFrame) -> DataFrame:
    """Positioned changes -> change_set_id, side, snapshot_id, first position, each snapshot once a side."""
    sides = F.explode(F.array(*[F.struct(F.lit(s).alias("side"), F.col(f"{s}.snapshot_id").alias("snapshot_id")) for s in ("previous", "current")]))
    rows = changes.select("change_set_id", "position", sides.alias("x")).where("x.snapshot_id is not null")
    return rows.groupBy("change_set_id", F.col("x.side").alias("side"), F.col("x.snapshot_id").alias("snapshot_id")).agg(F.min("position").alias("position"))


def changes_for_snapshots(changes: DataFrame, subjects: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Changes whose current side is one of the snapshots, with the subject's names."""
    wanted = changes.join(snapshots.select("snapshot_id").distinct(), F.col("current.snapshot_id") == F.col("snapshot_id"), "left_semi")
    names = subjects.select("company_key", "product_key", F.col("company").alias("subject_company"), F.col("product").alias("subject_product"))
    return wanted.join(names, ["company_key", "product_key"])


def changes_for_sets(changes: DataFrame, subjects: DataFrame, sets: DataFrame) -> DataFrame:
    """Positioned changes of the asked-for sets (change_set_id) with their place in them and the subject's names."""
    wanted = changes.join(sets.select("change_set_id").distinct(), "change_set_id", "left_semi")
    names = subjects.select("company_key", "product_key", F.col("company").alias("subject_company"), F.col("product").alias("subject_product"))
    return wanted.join(names, ["company_key", "product_key"])


def field_history(facts: DataFrame, bucket: str = "day") -> DataFrame:
    """Superseded facts of each key with their number in order; the current one, the last, is left out."""
    rows = scanned(facts, KEYS, ORDER, F.date_trunc(bucket, "observed_at"), number="_number", lead={"_following": F.lit(1)})
    return rows.where("_following is not null").select(*facts.columns, (F.col("_number") - 1).cast("int").alias("position"))


def history_intervals(facts: DataFrame, bucket: str = "day") -> DataFrame:
    """Runs of equal value and status of each key -> value, disclosure_status, valid_from, valid_to (null: still valid)."""
    state = F.struct("value", "disclosure_status")
    unit = F.date_trunc(bucket, "observed_at")
    starts = with_previous(facts, KEYS, ORDER, unit, {"_before": state}).where(F.col("_before").isNull() | ~F.col("_before").eqNullSafe(state))
    return scanned(starts, KEYS, ORDER, unit, lead={"valid_to": F.col("observed_at")}).select(*KEYS, "value", "disclosure_status", F.col("observed_at").alias("valid_from"), "valid_to")


def facts_as_of(facts: DataFrame, probes: DataFrame, keys: list[str] = KEYS, at: str = "observed_at", bucket: str = "day", values: tuple[str, ...] = ("value", "disclosure_status")) -> DataFrame:
    """probes (the keys and ``at``) with the values of the facts that held at their time: the last at or before it."""
    return as_of(facts.withColumn(at, F.col("observed_at")), probes, list(keys), [c for c in ORDER if c != at], at, F.date_trunc(bucket, at), list(values))
