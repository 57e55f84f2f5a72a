"""Quality metrics of digests and change detection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronofact.functions.text import normalise_claim_text
from chronofact.operators.history import detect_changes


def citation_validity(status: Column) -> Column:
    """Aggregate: share of supported claims, 1 if there are none."""
    return F.coalesce(F.avg(F.when(status == "supported", 1.0).otherwise(0.0)), F.lit(1.0))


def unsupported_claims(status: Column) -> Column:
    """Aggregate: claims that aren't supported."""
    return F.count_if(~status.eqNullSafe(F.lit("supported")))


def duplicate_rate(claims: DataFrame) -> DataFrame:
    """(digest_id, text) -> per digest: n_claims, n_repeats after the first of equal normalised texts, duplicate_rate.

    Texts are counted by digest and text first, so a hot digest or text is folded ahead of the shuffle.
    """
    texts = claims.groupBy("digest_id", F.xxhash64(normalise_claim_text(F.col("text"))).alias("h"), normalise_claim_text(F.col("text")).alias("t")).agg(F.count("*").alias("n"))
    per = texts.groupBy("digest_id").agg(F.sum("n").alias("n_claims"), (F.sum("n") - F.count("*")).alias("n_repeats"))
    return per.withColumn("duplicate_rate", F.col("n_repeats") / F.col("n_claims"))


def change_recall(detected: DataFrame, expected: DataFrame) -> DataFrame:
    """One row: n_expected and n_found distinct (company, product, field) by raw names, and recall (1 if none is expected)."""
    keys = ["company", "product", "field"]
    want = expected.select(*keys).distinct()
    found = want.join(detected.select(*keys).distinct().withColumn("_hit", F.lit(True)), keys, "left")
    sums = found.agg(F.count("*").alias("n_expected"), F.count_if(F.col("_hit").isNotNull()).alias("n_found"))
    return sums.withColumn("recall", F.when(F.col("n_expected") == 0, F.lit(1.0)).otherwise(F.col("n_found") / F.col("n_expected")))


def evaluate(claims: DataFrame) -> DataFrame:
    """(digest_id, text, validation_status) -> per digest, and pooled over all claims (digest_id null): claims,
    unsupported claims, citation validity, repeats and duplicate rate."""
    status = F.col("validation_status")
    sums = claims.rollup("digest_id").agg(F.count("*").alias("n_claims"), unsupported_claims(status).alias("n_unsupported"), citation_validity(status).alias("citation_validity"), F.grouping("digest_id").alias("_all"))
    repeats = duplicate_rate(claims)
    both = repeats.select("digest_id", "n_repeats", F.lit(0).alias("_all")).unionByName(repeats.agg(F.sum("n_repeats").alias("n_repeats")).select(F.lit(None).cast(claims.schema["digest_id"].dataType).alias("digest_id"), "n_repeats", F.lit(1).alias("_all")))
    same = sums["digest_id"].eqNullSafe(both["digest_id"]) & (sums["_all"] == both["_all"])
    return sums.join(both, same, "left").select(sums["digest_id"], (sums["_all"] == 1).alias("pooled"), "n_claims", "n_unsupported", "citation_validity", "n_repeats", F.when(F.col("n_claims") > 0, F.col("n_repeats") / F.col("n_claims")).otherwise(F.lit(0.0)).alias("duplicate_rate"))


def replay_case(observations: DataFrame) -> DataFrame:
    """Recall of the changes in the observations marked in_detected against those in all of them, tolerant equivalence."""
    facts = observations.drop("in_detected")
    return change_recall(detect_changes(observations.where("in_detected").drop("in_detected"), equivalence="tolerant"), detect_changes(facts, equivalence="tolerant"))
