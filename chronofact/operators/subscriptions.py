"""Subscription lifecycles as aggregates over event tables."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronofact.operators.ordered import scanned

# Limits of requests by scope, as (window, number).
LIMITS = {"subscribe_address": ("1 hour", 3), "subscribe_network": ("1 hour", 20), "subscription_token_network": ("10 minutes", 30)}


def subscription_state(events: DataFrame) -> DataFrame:
    """(subscription_id, consent_generation, event_type, occurred_at) -> status, generation and times per subscription.

    The greatest (generation, time, type) decides the status; suppression is final whatever follows. Times are those of
    the current generation; a request after an unsubscription is a new generation, whose other times are null.
    """
    kinds = {"consent_requested": "pending", "confirmed": "confirmed", "unsubscribed": "unsubscribed", "suppressed": "suppressed"}
    # Each generation is folded first, then the generations; both aggregations combine before the shuffle.
    gen = events.groupBy("subscription_id", "consent_generation").agg(F.max_by("event_type", F.struct("occurred_at", "event_type")).alias("last"), F.max("occurred_at").alias("updated_at"), *[F.max(F.when(F.col("event_type") == k, F.col("occurred_at"))).alias(f"{s}_at") for k, s in kinds.items()])
    fold = gen.groupBy("subscription_id").agg(F.max(F.struct("consent_generation", "last", "pending_at", "confirmed_at", "unsubscribed_at")).alias("g"), F.max("suppressed_at").alias("suppressed_at"), F.max("updated_at").alias("updated_at"))
    named = F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv])
    status = F.when(F.col("suppressed_at").isNotNull(), F.lit("suppressed")).otherwise(F.element_at(named, F.col("g.last")))
    return fold.select("subscription_id", status.alias("status"), F.col("g.consent_generation").alias("consent_generation"), F.col("g.pending_at").alias("consented_at"), F.col("g.confirmed_at").alias("confirmed_at"), F.col("g.unsubscribed_at").alias("unsubscribed_at"), "suppressed_at", "updated_at")


def live_tokens(tokens: DataFrame, subscriptions: DataFrame, now: Column) -> DataFrame:
    """Tokens that can be used now: not revoked, of the current generation, in a fitting status. Confirmation tokens are
    used once and expire; unsubscribe tokens stay usable."""
    rows = tokens.join(subscriptions.select(F.col("id").alias("subscription_id"), "status", F.col("consent_generation").alias("_g")), "subscription_id")
    confirm = (F.col("purpose") == "confirm") & (F.col("status") == "pending") & F.col("used_at").isNull() & (F.col("expires_at") > now)
    leave = (F.col("purpose") == "unsubscribe") & F.col("status").isin("confirmed", "unsubscribed")
    return rows.where(F.col("revoked_at").isNull() & (F.col("consent_generation") == F.col("_g")) & (confirm | leave)).select(*tokens.columns)


def rate_limit(requests: DataFrame, window: str, limit: int, keys: list[str], ts: str = "ts", order: str = "id", part: str = "minute") -> DataFrame:
    """Every request with its epoch-aligned window, its number in it and whether it is allowed: the first ``limit`` are.

    An identity's requests are numbered within parts of a window (``part``) and the parts are stitched by one row each, so
    no task sorts a hot identity's whole window.
    """
    rows = requests.withColumn("window_start", F.window(ts, window)["start"])
    numbered = scanned(rows, [*keys, "window_start"], [ts, order], F.date_trunc(part, ts), number="number")
    return numbered.withColumn("number", F.col("number").cast("int")).withColumn("allowed", F.col("number") <= limit)


def allowed_until(requests: DataFrame, window: str, limit: int, keys: list[str], ts: str = "ts", order: str = "id") -> DataFrame:
    """Per identity and window the (time, id) of the last request that is allowed, null while all are.

    What answers requests needs no numbers: each task keeps the ``limit`` least of an identity's requests, and these are
    merged, so a window of any size costs ``limit`` entries a task.
    """
    rows = requests.withColumn("window_start", F.window(ts, window)["start"])
    seen = F.struct(F.col(ts).alias("ts"), F.col(order).alias("id"))
    # Parts of a window keep their least first, so that what is merged is bounded.
    salted = rows.withColumn("_part", F.pmod(F.xxhash64(order), F.lit(64)))
    w = Window.partitionBy(*keys, "window_start", "_part").orderBy(ts, order)
    least = salted.withColumn("_no", F.row_number().over(w)).where(F.col("_no") <= limit)
    grouped = least.groupBy(*keys, "window_start").agg(F.slice(F.array_sort(F.collect_list(seen)), 1, limit).alias("least"))
    return grouped.select(*keys, "window_start", F.when(F.size("least") == limit, F.get("least", F.lit(limit - 1))).alias("last_allowed"))


def rate_limit_counts(requests: DataFrame, window: str, limit: int, keys: list[str], ts: str = "ts") -> DataFrame:
    """Per identity and window: requests and how many were refused."""
    rows = requests.groupBy(*keys, F.window(ts, window).alias("w")).agg(F.count("*").alias("requests"))
    return rows.select(*keys, F.col("w.start").alias("window_start"), "requests", F.greatest(F.col("requests") - limit, F.lit(0)).alias("refused"))


def retention(tokens: DataFrame, now: Column, days: int = 90) -> DataFrame:
    """Tokens to delete: the last of their expiry, use and revocation is ``days`` ago, and they are confirmations or revoked."""
    last = F.greatest("expires_at", "used_at", "revoked_at")
    return tokens.where((last <= now - F.make_dt_interval(F.lit(days))) & ((F.col("purpose") == "confirm") | F.col("revoked_at").isNotNull()))


def expired_counters(limits: DataFrame, now: Column) -> DataFrame:
    """Counters past their expiry."""
    return limits.where(F.col("expires_at") <= now)


#: An address behind its outer spaces: dotted parts before the one @, and two labels at least behind it, whose ends are no hyphens.
ADDRESS = r"(?U)^([^@.\s\x00-\x1f]+(?:\.[^@.\s\x00-\x1f]+)*)@((?:(?!-)[^@.\s\x00-\x1f]+(?<!-)\.)+(?!-)[^@.\s\x00-\x1f]+(?<!-))$"
LONGEST_ADDRESS, LONGEST_LABEL = 320, 63


@F.pandas_udf(T.StructType([T.StructField("address", T.StringType()), T.StructField("domain", T.StringType())]))
def _beyond_ascii(addresses: pd.Series) -> pd.DataFrame:
    """What Spark has no function for: NFC of an address, and the IDNA form of its domain (null if it has none)."""

    def idna(domain: str) -> str | None:
        try:
            return domain.lower().encode("idna").decode("ascii")
        except UnicodeError:
            return None

    composed = addresses.map(lambda a: unicodedata.normalize("NFC", a), na_action="ignore")
    return pd.DataFrame({"address": composed, "domain": composed.map(lambda a: idna(a.rpartition("@")[2]), na_action="ignore")})


def normalize_email(address: Column | str) -> Column:
    """NFC, IDNA lower-case domain, local part as it is; null if it is no address.

    Only addresses beyond ASCII go to Python.
    """
    raw = F.col(address) if isinstance(address, str) else address
    bare = F.regexp_replace(raw, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")
    plain = bare.rlike(r"^[\x00-\x7f]*$")
    wide = _beyond_ascii(F.when(~plain, bare))
    whole = F.when(plain, bare).otherwise(wide["address"])
    domain = F.when(plain, F.lower(F.regexp_extract(bare, ADDRESS, 2))).otherwise(F.when(wide["address"].rlike(ADDRESS), wide["domain"]))
    fits = (F.length(whole) <= LONGEST_ADDRESS) & whole.rlike(ADDRESS) & domain.rlike(rf"^[a-z0-9-]{{1,{LONGEST_LABEL}}}(?:\.[a-z0-9-]{{1,{LONGEST_LABEL}}})*$")
    return F.when(fits, F.concat_ws("@", F.regexp_extract(whole, ADDRESS, 1), domain))


def normalize_emails(addresses: DataFrame, address: str = "address") -> DataFrame:
    """Distinct normalised addresses with their number of rows; invalid and null ones together under null."""
    return addresses.groupBy(address).agg(F.count("*").alias("n")).withColumn("email", normalize_email(F.col(address))).groupBy("email").agg(F.sum("n").alias("n"))
