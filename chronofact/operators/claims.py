"""Claims, their validation, and dated digests.

Claims have: digest_date, claim_id, position, text, citations (array of snapshot ids). Snapshots: snapshot_id, content_text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronofact.functions.numbers import numbers_in
from chronofact.functions.text import field_label
from chronofact.operators.fingerprints import multiset


def draft_claims(changes: DataFrame) -> DataFrame:
    """One sentence per change, and its citations: the current snapshot, then the previous one if it is another."""
    name = F.concat("company", F.lit("'s "), "product", F.lit("'s "), field_label(F.col("field")))
    old, new, kind = F.col("previous.value"), F.col("current.value"), F.col("change_type")

    def sentence(*parts: str | Column) -> Column:
        return F.concat(name, *[F.lit(p) if isinstance(p, str) else F.coalesce(p, F.lit("None")) for p in parts])

    text = (
        F.when(kind == "not_disclosed", sentence(" is no longer disclosed (previously ", old, ")."))
        .when(kind == "disclosed", sentence(" is now disclosed as ", new, "."))
        .when(kind == "increased", sentence(" increased to ", new, ", up from ", old, "."))
        .when(kind == "decreased", sentence(" decreased to ", new, ", down from ", old, "."))
        .otherwise(sentence(" changed from ", old, " to ", new, "."))
    )
    citations = F.array_distinct(F.array_compact(F.array(F.col("current.snapshot_id"), F.col("previous.snapshot_id"))))
    return changes.withColumn("text", text).withColumn("citations", citations).withColumn("validation_status", F.lit("pending"))


def validate_claims(claims: DataFrame, snapshots: DataFrame, key: str = "claim_id", check_numbers: bool = True) -> DataFrame:
    """Adds citations_exist, numbers_grounded and validation_status to every claim.

    A claim is supported if it has citations, all of known snapshots, and every number of its text is among the numbers
    of the cited contents. Without an existing citation nothing is grounded, whether or not the text has numbers. A
    snapshot's numbers are found once, by itself, and only those go with its citations; without ``check_numbers`` numbers_grounded is
    null and contents aren't read.
    """
    cited = claims.select(key, F.explode("citations").alias("snapshot_id"))
    known = snapshots.select("snapshot_id", F.lit(True).alias("_known"), *([numbers_in(F.coalesce("content_text", F.lit(""))).alias("_numbers")] if check_numbers else []))
    found = cited.join(known, "snapshot_id", "left")
    theirs = [F.array_distinct(F.flatten(F.collect_set("_numbers"))).alias("_theirs")] if check_numbers else []
    rows = claims.join(found.groupBy(key).agg(F.bool_and(F.coalesce("_known", F.lit(False))).alias("_all"), *theirs), key, "left")
    exist = F.coalesce("_all", F.lit(False))
    mine = numbers_in(F.coalesce("text", F.lit("")))
    grounded = exist & (F.size(F.array_except(mine, F.coalesce("_theirs", F.array().cast("array<string>")))) == 0) if check_numbers else F.lit(None).cast("boolean")
    ok = grounded if check_numbers else exist
    return rows.select(*[c for c in claims.columns if c != "validation_status"], exist.alias("citations_exist"), grounded.alias("numbers_grounded"), F.when(ok, F.lit("supported")).otherwise(F.lit("unsupported")).alias("validation_status"))


def assemble_digests(dates: DataFrame, claims: DataFrame) -> DataFrame:
    """Every date -> n_claims, n_unsupported and status: draft without claims, published if all are supported, else review."""
    sums = claims.groupBy("digest_date").agg(F.count("*").alias("n_claims"), F.count_if(F.col("validation_status") != "supported").alias("n_unsupported"))
    rows = dates.select("digest_date").distinct().join(sums, "digest_date", "left")
    n, bad = F.coalesce("n_claims", F.lit(0)), F.coalesce("n_unsupported", F.lit(0))
    return rows.select("digest_date", n.alias("n_claims"), bad.alias("n_unsupported"), F.when(n == 0, F.lit("draft")).when(bad == 0, F.lit("published")).otherwise(F.lit("review")).alias("status"))


def veto(digests: DataFrame, comparison_dates: DataFrame, failed_dates: DataFrame) -> DataFrame:
    """Sends a digest to review if its date has a failed item, or if it would be published with a comparison claim."""
    c = comparison_dates.select("digest_date").distinct().withColumn("_c", F.lit(True))
    f = failed_dates.select("digest_date").distinct().withColumn("_f", F.lit(True))
    rows = digests.join(c, "digest_date", "left").join(f, "digest_date", "left")
    held = F.col("_f").isNotNull() | (F.col("_c").isNotNull() & (F.col("status") == "published"))
    return rows.withColumn("status", F.when(held, F.lit("review")).otherwise(F.col("status"))).select(*digests.columns)


def claim_signature(claims: DataFrame) -> DataFrame:
    """(digest_id) -> the multiset of trimmed texts with sorted citations as a signature, and their number.

    Signatures are sums of hashes (see ``fingerprints.multiset``), so no digest's claims are gathered.
    """
    one = claims.select("digest_id", F.trim("text").alias("_text"), F.array_sort("citations").alias("_cites"))
    return one.groupBy("digest_id").agg(multiset("_text", "_cites", F.size("_cites")).alias("signature"), F.count("*").alias("n"))


def reconcile_published(new: DataFrame, new_claims: DataFrame, published: DataFrame, published_claims: DataFrame) -> DataFrame:
    """New digests against the published one of their date -> digest_id, digest_date, status, outcome, final_digest_id.

    Without a published one the new digest stands (new). With equal claims and no failed item (column ``failed``) the
    published one is reused; else the new one goes to review.
    """
    mine = claim_signature(new_claims).select("digest_id", F.col("signature").alias("_s"))
    old = published.select("digest_date", F.col("digest_id").alias("_old")).join(claim_signature(published_claims).select(F.col("digest_id").alias("_old"), F.col("signature").alias("_t")), "_old", "left")
    rows = new.join(mine, "digest_id", "left").join(old, "digest_date", "left")
    same = F.col("_s").eqNullSafe(F.col("_t")) & ~F.col("failed")
    outcome = F.when(F.col("_old").isNull(), F.lit("new")).when(same, F.lit("reuse")).otherwise(F.lit("review"))
    rows = rows.withColumn("outcome", outcome)
    return rows.select("digest_id", "digest_date", F.when(F.col("outcome") == "review", F.lit("review")).when(F.col("outcome") == "reuse", F.lit("published")).otherwise(F.col("status")).alias("status"), "outcome", F.when(F.col("outcome") == "reuse", F.col("_old")).otherwise(F.col("digest_id")).alias("final_digest_id"))


def hydrate_digests(digests: DataFrame, claims: DataFrame, citations: DataFrame, snapshots: DataFrame, items: DataFrame, changes: DataFrame | None = None) -> DataFrame:
    """digests(digest_id, digest_date, status) -> with nested claims by position, each with its citations by position.

    claims: claim_id, digest_id, position, text, validation_status, change_id; citations: claim_id, snapshot_id,
    position; snapshots: snapshot_id, item_id; items: item_id, canonical_url, title; changes: change_id, company,
    product, field. A citation whose snapshot is missing has a null url. One plan of joins, whatever the number of digests.
    """
    sourced = citations.select("claim_id", "snapshot_id", F.col("position").alias("_p")).join(snapshots.select("snapshot_id", "item_id"), "snapshot_id", "left").join(items.select("item_id", "canonical_url", "title"), "item_id", "left")
    cited = sourced.groupBy("claim_id").agg(F.array_sort(F.collect_list(F.struct(F.col("_p").alias("position"), "snapshot_id", F.col("canonical_url").alias("url"), "title"))).alias("citations"))
    rows = claims.drop("citations").join(cited, "claim_id", "left")
    fields = ["position", "claim_id", "text", "validation_status", "change_id"]
    if changes is not None:
        rows = rows.join(changes.select("change_id", F.struct("change_id", "company", "product", "field").alias("change")), "change_id", "left")
        fields.append("change")
    empty = F.array().cast(rows.schema["citations"].dataType)
    nested = rows.groupBy("digest_id").agg(F.array_sort(F.collect_list(F.struct(*fields, F.coalesce("citations", empty).alias("citations"))), lambda a, b: F.when(a["position"] < b["position"], -1).when(a["position"] > b["position"], 1).otherwise(0)).alias("claims"))
    return digests.join(nested, "digest_id", "left").withColumn("claims", F.coalesce("claims", F.array().cast(nested.schema["claims"].dataType)))


def digest_detail(hydrated: DataFrame) -> DataFrame:
    """Published digests with ``intact``: all claims supported, cited, with urls, and with their change where they name one."""
    def sound(c: Column) -> Column:
        change = (c["change_id"].isNull() | (c["change"]["change_id"] == c["change_id"])) if "change" in hydrated.schema["claims"].dataType.elementType.names else F.lit(True)
        return (c["validation_status"] == "supported") & (F.size(c["citations"]) > 0) & F.forall(c["citations"], lambda x: x["url"].isNotNull()) & F.coalesce(change, F.lit(False))

    return hydrated.where("status = 'published'").withColumn("intact", (F.size("claims") > 0) & F.forall("claims", sound))


def digest_write_rules(existing: DataFrame, new: DataFrame) -> DataFrame:
    """(digest_id, digest_date, status, signature) stored and to be written -> digest_id, action.

    insert, but reject rows that arrive published; noop for an equal replay; reject a change of a published digest, a
    change of date, or a step to published; else replace.
    """
    o, n = existing.alias("o"), new.alias("n")
    rows = n.join(o, F.col("n.digest_id") == F.col("o.digest_id"), "left")
    equal = F.col("n.digest_date").eqNullSafe(F.col("o.digest_date")) & F.col("n.status").eqNullSafe(F.col("o.status")) & F.col("n.signature").eqNullSafe(F.col("o.signature"))
    action = (
        F.when(F.col("o.digest_id").isNull(), F.when(F.col("n.status") == "published", F.lit("reject")).otherwise(F.lit("insert")))
        .when(equal, F.lit("noop"))
        .when((F.col("o.status") == "published") | ~F.col("n.digest_date").eqNullSafe(F.col("o.digest_date")) | (F.col("n.status") == "published"), F.lit("reject"))
        .otherwise(F.lit("replace"))
    )
    return rows.select("n.digest_id", action.alias("action"))


def publish(digests: DataFrame, claims: DataFrame, snapshots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Claims with their statuses, and digests with theirs: published stays, others follow their claims."""
    checked = validate_claims(claims, snapshots)
    status = assemble_digests(digests, checked).select("digest_date", F.col("status").alias("_s"))
    out = digests.join(status, "digest_date", "left").withColumn("status", F.when(F.col("status") == "published", F.col("status")).otherwise(F.coalesce("_s", "status"))).drop("_s")
    return checked, out
