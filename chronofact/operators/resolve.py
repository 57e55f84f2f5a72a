"""Resolution of items to known subjects by whole phrases.

Items have: item_id, source_id, publisher, title, content_text. Phrases have: company, product, phrase, strong (false
for a bare product name, which needs corroboration).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronofact.functions.text import normalise_name

# Feeds that stand for one product.
TRUSTED_SOURCES = (("langchain_pypi", "LangChain", "LangChain"), ("langgraph_pypi", "LangChain", "LangGraph"))
MATCH_CONFIDENCE = 0.95
MIN_CONFIDENCE = 0.6
EXCERPT_CHARS = 500

#: Phrases up to which every task holds all of them.
SMALL = 5000


def alias_table(aliases: DataFrame, known_subjects: DataFrame | None = None) -> DataFrame:
    """aliases(company, product, aliases array) and known subjects -> phrases: company with product and every alias are
    strong, the product alone is not; phrases under two characters are dropped."""
    both = aliases.select("company", "product", F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases"))
    if known_subjects is not None:
        both = both.unionByName(known_subjects.select("company", "product", F.array().cast("array<string>").alias("aliases")))
    strong = F.concat(F.array(F.concat_ws(" ", "company", "product")), "aliases")
    made = both.select("company", "product", F.explode(F.concat(F.transform(strong, lambda p: F.struct(normalise_name(p).alias("phrase"), F.lit(True).alias("strong"))), F.array(F.struct(normalise_name(F.col("product")).alias("phrase"), F.lit(False).alias("strong"))))).alias("x"))
    return made.select("company", "product", "x.*").where(F.length("phrase") >= 2).groupBy("company", "product", "phrase").agg(F.max("strong").alias("strong"))


def contains_phrase(text: Column, phrase: Column) -> Column:
    """Whole-phrase containment of normalised strings."""
    return F.contains(F.concat(F.lit(" "), text, F.lit(" ")), F.concat(F.lit(" "), phrase, F.lit(" ")))


def filed_phrases(texts: DataFrame, phrases: DataFrame, text: str = "haystack", sample: float = 0.05) -> DataFrame:
    """phrases with _word, the word of each that fewest of the texts have (then the longest, then the least).

    Frequencies are counted over a sample of the texts: they decide how many candidates there are, never which phrases match.
    """
    words = phrases.select("phrase", F.explode(F.array_distinct(F.split("phrase", " "))).alias("_word")).distinct()
    seen = texts.sample(sample, 7).select(F.explode(F.array_distinct(F.split(text, " "))).alias("_word"))
    counts = seen.join(words.select("_word").distinct(), "_word", "left_semi").groupBy("_word").agg(F.count("*").alias("_n"))
    best = words.join(counts, "_word", "left").groupBy("phrase").agg(F.min_by("_word", F.struct(F.coalesce("_n", F.lit(0)), -F.length("_word"), "_word")).alias("_word"))
    return phrases.join(best, "phrase").select(*phrases.columns, "_word")


def phrase_candidates(texts: DataFrame, filed: DataFrame, key: str = "item_id", text: str = "haystack") -> DataFrame:
    """(key, phrase columns) of texts that have the word under which a phrase is filed."""
    words = texts.select(key, F.explode(F.array_distinct(F.split(text, " "))).alias("_word"))
    return words.join(filed, "_word").drop("_word")


def phrase_hits(texts: DataFrame, phrases: DataFrame, key: str = "item_id", text: str = "haystack", also: Column | None = None, most: int = SMALL) -> DataFrame:
    """(key, normalised text, ...) and phrases -> key and phrase columns of every whole-phrase occurrence, once each.

    Only texts with the word under which a phrase is filed are looked at for it. Up to ``most`` phrases, a text's words are
    held against all filing words where the text is, and candidates are verified there at once; no text is moved. Above,
    distinct words meet filing words in an equi-join, and candidates go back to their texts. ``also`` is a further
    condition over the columns of both.
    """
    filed = filed_phrases(texts, phrases, text)
    held = filed.limit(most + 1).collect()
    found = contains_phrase(F.col(text), F.col("phrase")) & (F.lit(True) if also is None else also)
    if len(held) <= most:
        index = texts.sparkSession.createDataFrame(held, filed.schema)
        wanted = F.array(*[F.lit(w) for w in sorted({r["_word"] for r in held})]) if held else F.array().cast("array<string>")
        hit = F.array_intersect(F.split(text, " "), wanted)
        # At most ``most`` phrases, so each task holds them all.
        pairs = texts.withColumn("_word", F.explode(hit)).join(F.broadcast(index), "_word")
    else:
        pairs = phrase_candidates(texts, filed, key, text).join(texts, key)
    return pairs.where(found).select(key, *phrases.columns).distinct()


def phrase_join(texts: DataFrame, phrases: DataFrame, key: str = "item_id", text: str = "haystack", most: int = SMALL) -> DataFrame:
    """Every whole-phrase occurrence (see ``phrase_hits``)."""
    return phrase_hits(texts.select(key, text), phrases, key, text, most=most)


def trusted_source_match(items: DataFrame) -> DataFrame:
    """Items of a trusted feed with its subject."""
    pairs = items.sparkSession.createDataFrame(list(TRUSTED_SOURCES), "source_id string, company string, product string")
    return items.join(F.broadcast(pairs), "source_id").select("item_id", "company", "product", F.col("source_id").alias("matched_text"))


def named_or_strong() -> Column:
    """Whether a match counts: a strong phrase, or a bare product name whose company publishes or is named in the text."""
    company = normalise_name(F.col("company"))
    return F.col("strong") | (normalise_name(F.col("publisher")) == company) | ((F.length(company) >= 2) & contains_phrase(F.col("haystack"), company))


def bare_name_gate(matches: DataFrame, items: DataFrame) -> DataFrame:
    """Matches of bare product names stay only if the publisher is the company or the text names it.

    items has item_id, publisher and haystack. Where matches are still to be found, ``gated_matches`` needs no join.
    """
    return matches.join(items.select("item_id", "publisher", "haystack"), "item_id").where(named_or_strong()).select(*matches.columns)


def gated_matches(items: DataFrame, phrases: DataFrame, most: int = SMALL) -> DataFrame:
    """Phrase matches of items (item_id, publisher, haystack) that the gate lets through, in one pass over the texts."""
    return phrase_hits(items.select("item_id", "publisher", "haystack"), phrases, also=named_or_strong(), most=most)


def with_haystack(items: DataFrame) -> DataFrame:
    """Adds the normalised title and content."""
    return items.withColumn("haystack", normalise_name(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("content_text", F.lit("")))))


def resolve(items: DataFrame, phrases: DataFrame) -> DataFrame:
    """Every item -> method, company, product, confidence, matched_text, candidates.

    A trusted feed decides first. Else one matching subject is alias_match; none is no_match with all known subjects as
    candidates (null here; join the subjects where they are needed); two or more are ambiguous_multi_subject with the
    matching ones as candidates, never guessed. matched_text is the first strong phrase in text order, else the bare name.
    """
    hay = with_haystack(items)
    hits = gated_matches(hay, phrases)
    by_subject = hits.groupBy("item_id", "company", "product").agg(F.min_by("phrase", F.struct(~F.col("strong"), F.col("phrase"))).alias("phrase"))
    found = by_subject.groupBy("item_id").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("company", "product"))).alias("candidates"), F.min(F.struct("company", "product", "phrase")).alias("one"))
    trusted = trusted_source_match(items).select("item_id", F.struct("company", "product", F.col("matched_text").alias("phrase")).alias("trusted"))
    rows = items.select("item_id").join(found, "item_id", "left").join(trusted, "item_id", "left")
    subject = F.coalesce("trusted", F.when(F.col("n") == 1, F.col("one")))
    method = F.when(subject.isNotNull(), F.lit("alias_match")).when(F.col("n") > 1, F.lit("ambiguous_multi_subject")).otherwise(F.lit("no_match"))
    return rows.select("item_id", method.alias("method"), subject["company"].alias("company"), subject["product"].alias("product"), F.when(subject.isNotNull(), F.lit(MATCH_CONFIDENCE)).otherwise(F.lit(0.0)).alias("confidence"), subject["phrase"].alias("matched_text"), F.when(F.col("trusted").isNull() & (F.col("n") > 1), F.col("candidates")).alias("candidates"))


def verbatim(text: Column, quote: Column) -> Column:
    """Whether the quote occurs in the text as it is, with no word character right before or after."""
    inner = F.replace(quote, F.lit("\\E"), F.lit("\\E\\\\E\\Q"))
    return F.coalesce((F.length(quote) > 0) & F.regexp_like(text, F.concat(F.lit("(?<![\\p{L}\\p{N}_])\\Q"), inner, F.lit("\\E(?![\\p{L}\\p{N}_])"))), F.lit(False))


def quote_supports_subject(rows: DataFrame, phrases: DataFrame, key: str, quote: str, text: str) -> DataFrame:
    """(key, company, product, quote, text) -> key, supported: the quote is verbatim and names one of the subject's phrases."""
    normal = rows.select(key, "company", "product", verbatim(F.col(text), F.col(quote)).alias("_real"), normalise_name(F.coalesce(quote, F.lit(""))).alias("_q"))
    named = normal.join(phrases.select("company", "product", "phrase"), ["company", "product"], "left")
    return named.groupBy(key).agg(F.max(F.coalesce(F.col("_real") & contains_phrase(F.col("_q"), F.col("phrase")), F.lit(False))).alias("supported"))


def judge_proposals(unresolved: DataFrame, proposals: DataFrame, phrases: DataFrame) -> DataFrame:
    """Proposals for items without a subject -> item_id, method, company, product, confidence, matched_text.

    unresolved: item_id, title, content_text, candidates (array of company and product). proposals: item_id, company,
    product, new_subject_proposal, supporting_quote, confidence. Evidence is the title and the first 500 characters. NaN
    and null confidences count as low.
    """
    rows = proposals.join(unresolved.select("item_id", "title", "content_text", "candidates"), "item_id")
    rows = rows.withColumn("_text", F.concat_ws("\n", F.coalesce("title", F.lit("")), F.substring(F.coalesce("content_text", F.lit("")), 1, EXCERPT_CHARS)))
    support = quote_supports_subject(rows, phrases, "item_id", "supporting_quote", "_text")
    rows = rows.join(support, "item_id", "left")
    sure = F.coalesce((F.col("confidence") >= MIN_CONFIDENCE) & ~F.isnan("confidence"), F.lit(False))
    proposed = (F.length("company") > 0) & (F.length("product") > 0)
    known = F.coalesce(F.exists("candidates", lambda c: (c["company"] == F.col("company")) & (c["product"] == F.col("product"))), F.lit(False))
    method = (
        F.when(~sure, F.lit("llm_low_confidence"))
        .when(F.coalesce(proposed, F.lit(False)) & known & F.coalesce("supported", F.lit(False)), F.lit("llm_resolved"))
        .when(F.coalesce(proposed, F.lit(False)) & known, F.lit("llm_unsupported_subject_evidence"))
        .when(F.coalesce(proposed, F.lit(False)), F.lit("llm_subject_not_in_candidates"))
        .otherwise(F.lit("llm_new_subject_proposal"))
    )
    rows = rows.withColumn("method", method)
    done = F.col("method") == "llm_resolved"
    matched = F.when(F.col("method").isin("llm_low_confidence", "llm_new_subject_proposal"), F.col("new_subject_proposal")).when(F.col("method") == "llm_subject_not_in_candidates", F.concat("company", F.lit(": "), "product")).otherwise(F.col("supporting_quote"))
    return rows.select("item_id", "method", F.when(done, F.col("company")).alias("company"), F.when(done, F.col("product")).alias("product"), "confidence", matched.alias("matched_text"))


def subject_registry(observations: DataFrame) -> DataFrame:
    """(company, product, created_at) -> one row per normalised key pair, with the names first seen."""
    keyed = observations.select(normalise_name(F.col("company")).alias("company_key"), normalise_name(F.col("product")).alias("product_key"), "company", "product", "created_at")
    first = keyed.groupBy("company_key", "product_key").agg(F.min(F.struct("created_at", "company", "product")).alias("r"))
    return first.select("company_key", "product_key", "r.company", "r.product", "r.created_at")


def route(resolved: DataFrame) -> DataFrame:
    """Adds the next step: extract, stop (ambiguous, for review) or propose."""
    return resolved.withColumn("next", F.when(F.col("method").isin("alias_match", "llm_resolved"), F.lit("extract")).when(F.col("method") == "no_match", F.lit("propose")).otherwise(F.lit("stop")))
