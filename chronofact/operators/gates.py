"""The cascade of evidence gates that fact candidates pass.

Candidates have: snapshot_id, field, value, disclosure_status, quoted_span, confidence, cand_pos. Snapshots have:
snapshot_id, content_text. The first failing gate is a candidate's reason.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronofact.functions.numbers import numbers_in, with_multiplied
from chronofact.functions.text import FIELD_LABELS, canonical_field, context_value, normalise_name
from chronofact.operators.resolve import contains_phrase
from chronofact.session import stored

MIN_CONFIDENCE = 0.6

# Wording that withholds a fact, families of fields, their concepts, and where clauses part.
WITHHOLDING = (
    r"(?i)\b(?:not\s+(?:yet\s+)?(?:been\s+)?(?:disclosed|announced|published|revealed|released|stated|detailed|shared|provided)"
    r"|withheld|unannounced|undisclosed|tbd|to\s+be\s+announced"
    r"|(?:details|information|pricing|scores|terms)\s+(?:are|is)\s+not\s+(?:yet\s+)?(?:public|available))\b"
)
FAMILIES = {
    "input_price_usd": "pricing",
    "output_price_usd": "pricing",
    "context_window_tokens": "context_window",
    "benchmark_scores": "benchmarks",
    "availability_regions": "regions",
    "licence_terms": "licence",
    "modalities": "modalities",
}
CONCEPTS = {
    "pricing": r"(?i)\b(?:price|pricing|cost|costs|rate|rates|fee|fees|dollar|dollars|cent|cents|currency|currencies|usd)\b|\$",
    "context_window": r"(?i)\b(?:context\s+(?:window|length|size|limit|capacity)|token\s+(?:window|limit|capacity)|(?:max|maximum)\s+context)\b",
    "benchmarks": r"(?i)\b(?:benchmark(?:s)?(?:\s+(?:score|scores|result|results|eval|evals|evaluation|evaluations))?)\b",
    "regions": r"(?i)\b(?:region|regions|country|countries|geographic\s+availability|geographies|geography|regional\s+availability)\b",
    "licence": r"(?i)\b(?:licen[sc]e|licen[sc]ing)(?:\s+terms)?\b",
    "modalities": r"(?i)\b(?:modalit(?:y|ies)|multimodal|input\s+(?:types?|formats?)|output\s+(?:types?|formats?))\b",
}
CLAUSE_ENDS = r"(?i)[.!?;\n]+|,\s*(?:but|and|while|whereas|although|however|yet)\b|\b(?:but|while|whereas|although|however)\b|--|—"


def shape_ok() -> Column:
    """not_disclosed has no value, disclosed has one; confidence is in [0, 1]."""
    status, value, c = F.col("disclosure_status"), F.col("value"), F.col("confidence")
    sides = ((status == "not_disclosed") & value.isNull()) | ((status == "disclosed") & (F.length(value) > 0))
    return F.coalesce(sides & ~F.isnan(c) & (c >= 0) & (c <= 1), F.lit(False))


def pricing_qualifier(field: Column, clause: Column) -> Column:
    """Wording for one direction of pricing supports that price alone; both or none support both."""
    i, o = clause.rlike(r"(?i)\binput\b"), clause.rlike(r"(?i)\boutput\b")
    return F.when(i == o, F.lit(True)).when(i, field == "input_price_usd").otherwise(field == "output_price_usd")


def non_disclosure_supported(field: Column, quote: Column, quote_numbers: Column) -> Column:
    """The quote has no number, and one of its clauses withholds exactly the field's family of concepts."""
    family = F.element_at(F.create_map(*[F.lit(x) for kv in FAMILIES.items() for x in kv]), field)

    def clause_ok(c: Column) -> Column:
        found = F.array_compact(F.array(*[F.when(c.rlike(p), F.lit(name)) for name, p in CONCEPTS.items()]))
        return c.rlike(WITHHOLDING) & (found == F.array(family)) & ((family != "pricing") | pricing_qualifier(field, c))

    return F.coalesce((F.size(quote_numbers) == 0) & family.isNotNull() & F.exists(F.split(quote, CLAUSE_ENDS), clause_ok), F.lit(False))


def value_supported(value: Column, quote: Column, value_numbers: Column, quote_numbers: Column) -> Column:
    """The quote has the value as a whole phrase, or all its numbers, multiplied ones written out."""
    v = normalise_name(value)
    phrase = (F.length(v) > 0) & contains_phrase(normalise_name(quote), v)
    return F.coalesce(phrase | ((F.size(value_numbers) > 0) & (F.size(F.array_except(value_numbers, quote_numbers)) == 0)), F.lit(False))


def ungrounded(candidates: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Candidates with ``_lost`` for ``_span``: whether it isn't in their snapshot's text; null spans aren't looked for.

    A missing snapshot holds nothing.
    """
    hay = snapshots.select("snapshot_id", normalise_name(F.coalesce("content_text", F.lit(""))).alias("_hay"))
    held = F.coalesce((F.col("_span") != "") & F.contains("_hay", "_span"), F.lit(False))
    return candidates.join(hay, "snapshot_id", "left").withColumn("_lost", F.col("_span").isNotNull() & ~held).drop("_hay", "_span")


def cross_contaminated(candidates: DataFrame) -> DataFrame:
    """Candidates, a row for each number, with ``_mixed``: whether the quote has all numbers of another field's value in the snapshot.

    Numbers come as sorted texts with spaces between, ``_quoted`` and ``_valued``. A candidate's first row has ``_at`` 0, its
    only one null if it has no numbers.

    Quotes and values meet on one of the value's numbers (its greatest in text order), so a snapshot with very many
    candidates forms no pairs; values of several numbers are compared with the quotes that share that one.
    """
    quote, value = (F.filter(F.split(k, " "), lambda t: t != "") for k in ("_quoted", "_valued"))
    rows = candidates.withColumns({"_quotes": quote, "_values": value}).withColumn("_most", F.array_max("_values"))
    rows = rows.select("*", F.posexplode_outer(F.array_union("_quotes", F.array_compact(F.array("_most")))).alias("_at", "_number"))
    alone, here = F.size("_values") == 1, F.col("_number") == F.col("_most")
    one, several = F.when(here & alone, F.col("field")), F.when(here & ~alone, F.struct("field", F.col("_values").alias("numbers")))
    rows = rows.select(*candidates.columns, "_at", "_number", (F.col("_at") < F.size("_quotes")).alias("_says"), one.alias("_one"), several.alias("_several"))
    w = Window.partitionBy("snapshot_id", "_number")
    rows = rows.select("*", F.min("_one").over(w).alias("_least"), F.max("_one").over(w).alias("_last"), F.collect_set("_several").over(w).alias("_sets"))
    field = F.col("field")
    other = F.coalesce((field != F.col("_least")) | (field != F.col("_last")), F.lit(False))
    others = F.exists("_sets", lambda v: (v["field"] != field) & (F.size(F.array_except(v["numbers"], quote)) == 0))
    mixed = F.col("snapshot_id").isNotNull() & F.col("_says") & (other | others)
    return rows.select(*candidates.columns, "_at", F.coalesce(mixed, F.lit(False)).alias("_mixed"))


def gate_facts(candidates: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Every candidate with its canonical field and value, ``accepted`` and the first ``reason`` against it (null if accepted).

    Reasons in order: bad_shape, conflicting_candidates, ambiguous_attribution, unknown_field, low_confidence,
    ungrounded_span, value_not_in_quote, non_disclosure_not_supported, duplicate. Conflicts and contamination are judged
    over all well-shaped candidates of a snapshot; duplicates among those that pass everything else, the first by
    cand_pos staying. A missing snapshot grounds nothing.

    Whole candidates are stored once and shuffled once, by snapshot and field. Their spans and numbers are shuffled once
    too, to the snapshot's text; what they tell against a candidate goes along with the first as a row with its ``_id``.
    """
    value = F.trim("value")
    rows = candidates.withColumn("field", canonical_field(F.col("field"))).withColumn("value", value)
    window_value = (F.col("field") == "context_window_tokens") & (F.col("disclosure_status") == "disclosed")
    rows = rows.withColumn("value", F.when(window_value, context_value(F.col("value"))).otherwise(F.col("value")))
    rows = rows.withColumn("_ok", shape_ok())
    quote, v = F.coalesce("quoted_span", F.lit("")), F.coalesce("value", F.lit(""))
    rows = rows.select("*", numbers_in(quote).alias("_quote_numbers"), numbers_in(v).alias("_value_plain"))
    rows = rows.select("*", with_multiplied(quote, F.col("_quote_numbers")).alias("_quote_all"), with_multiplied(v, F.col("_value_plain")).alias("_value_all"))
    # What a candidate shows by itself is worked out once, ahead of the joins, and stored for all of them.
    withheld = F.when(F.col("_ok") & F.col("value").isNull(), non_disclosure_supported(F.col("field"), quote, F.col("_quote_numbers")))
    backed = F.when(F.col("_ok") & F.col("value").isNotNull(), value_supported(F.col("value"), quote, F.col("_value_all"), F.col("_quote_all")))
    own = (
        F.when(~F.col("_ok"), F.lit("bad_shape"))
        .when(~F.col("field").isin(*FIELD_LABELS), F.lit("unknown_field"))
        .when(F.col("confidence") < MIN_CONFIDENCE, F.lit("low_confidence"))
        .when(F.col("value").isNotNull() & ~backed, F.lit("value_not_in_quote"))
        .when(F.col("value").isNull() & ~withheld, F.lit("non_disclosure_not_supported"))
    )
    rows = rows.select(*candidates.columns, own.alias("_own"), "_quote_numbers", "_value_plain", normalise_name(quote).alias("_span"), F.monotonically_increasing_id().alias("_id"))
    rows = stored(rows, "candidates", compression="zstd")
    # Candidates without a field stand beside their equals only.
    rows = rows.withColumn("_apart", F.when(F.col("field").isNull(), F.struct("value")))
    fits = F.col("_own").isNull() | (F.col("_own") != "bad_shape")
    early = F.coalesce(F.col("_own").isin("unknown_field", "low_confidence"), F.lit(False))
    group = ["snapshot_id", "field", "_apart"]
    numbers = [F.array_join(k, " ").alias(a) for k, a in ((F.col("_quote_numbers"), "_quoted"), (F.when(F.col("value").isNotNull(), F.col("_value_plain")).otherwise(F.array()), "_valued"))]
    shown = rows.where(fits).select(*group, "_id", *numbers, F.when(~early, F.col("_span")).alias("_span"))
    against = cross_contaminated(ungrounded(shown, snapshots)).withColumn("_lost", F.col("_lost") & (F.coalesce("_at", F.lit(0)) == 0))
    against = against.where("_lost or _mixed").select(*group, "_id", "_lost", "_mixed")
    whole = rows.select(*candidates.columns, "_apart", "_id", "_own", F.lit(True).alias("_whole"))
    every = whole.unionByName(against, allowMissingColumns=True).repartition("snapshot_id", "field")
    # The second window's keys begin the first one's, so both go by one sort. A well-shaped value tells its disclosure status too.
    one, w = Window.partitionBy(*group, "_id"), Window.partitionBy(*group)
    said = F.when(F.col("_whole") & fits, F.struct("value"))
    judged = every.withColumns({k: F.max(k).over(one) for k in ("_lost", "_mixed")}).withColumns({"_low": F.min(said).over(w), "_high": F.max(said).over(w)}).where("_whole")
    reason = (
        F.when(~fits, F.col("_own"))
        .when(F.col("snapshot_id").isNotNull() & (F.col("_low") != F.col("_high")), F.lit("conflicting_candidates"))
        .when(F.col("_mixed"), F.lit("ambiguous_attribution"))
        .when(early, F.col("_own"))
        .when(F.col("_lost"), F.lit("ungrounded_span"))
        .otherwise(F.col("_own"))
    )
    judged = judged.withColumn("reason", reason)
    # Candidates of a group that pass so far have one value: all but the first are duplicates.
    place = F.struct("cand_pos", "_id")
    judged = judged.withColumn("_first", F.min(F.when(F.col("reason").isNull(), place)).over(w))
    judged = judged.withColumn("reason", F.when(F.col("reason").isNull() & (place != F.col("_first")), F.lit("duplicate")).otherwise(F.col("reason")))
    return judged.select(*candidates.columns, "reason", F.col("reason").isNull().alias("accepted"))


def gate_counts(gated: DataFrame) -> DataFrame:
    """Candidates by reason; ``accepted`` for those without one."""
    return gated.groupBy(F.coalesce("reason", F.lit("accepted")).alias("reason")).agg(F.count("*").alias("n"))
