"""Numeric tokens of texts, for checking that a claim's numbers occur in its evidence."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Signs that numbers are written with, and what counts as a number, as a product's name with its version,
# and as the unit of a multiplied number.
FORMATTING = "[,$%]"
DIGITS = r"\p{Nd}++(?:\.\p{Nd}++)?+"
NUMBER = r"(?<![A-Za-z])\p{Nd}+(?:\.\p{Nd}+)?(?![A-Za-z])"
NAME = rf"[A-Za-z]+-{DIGITS}[A-Za-z]*+"
UNIT = r"(?U:\s*)([kKmM])(?![A-Za-z])"

#: One pass from left to right takes a name whole, then a number that has a unit (its digits only, as the unit may begin a
#: name), then a plain number; only the last kind has a group.
PLAIN = rf"{NAME}|(?<![A-Za-z]){DIGITS}(?={UNIT})|({NUMBER})"
#: The same for numbers with a unit: number and unit are groups 1 and 2. Digits behind a hyphen that have
#: a unit a space away are no part of a name.
MULTIPLIED = rf"[A-Za-z]+-{DIGITS}(?:[A-Za-z]++|(?![A-Za-z]|(?U:\s+)[kKmM](?![A-Za-z])))|(?<![A-Za-z])({DIGITS})(?={UNIT})"
#: What any number has, and any number with a unit, signs of FORMATTING between them included; texts without are not searched.
DIGIT = r"\p{Nd}"
HAS_UNIT = r"(?U:\p{Nd}[,$%\s]*[kKmM])"


def _none() -> Column:
    return F.array().cast("array<string>")


def _bare(text: Column) -> Column:
    return F.regexp_replace(text, FORMATTING, "")


def _found(text: Column, pattern: str, group: int) -> Column:
    """The group of every match; empty where a match lacks it."""
    return F.regexp_extract_all(_bare(text), F.lit(pattern), F.lit(group))


def _distinct(tokens: Column) -> Column:
    return F.array_sort(F.array_distinct(tokens))


def _written_out(number: Column, unit: Column) -> Column:
    """100 and K as 100000; digits that the unit leaves behind the point stay."""
    product = number.try_cast("double") * F.when(F.lower(unit) == "k", 1_000).otherwise(1_000_000)
    whole = product.try_cast("decimal(38,0)").cast("string")
    part = F.rtrim(product.try_cast("decimal(38,10)").cast("string"), F.lit("0"))
    return F.when(product == F.floor(product), whole).otherwise(part)


def numbers_in(text: Column) -> Column:
    """Distinct standalone numbers, sorted, without those of names (GPT-4o) and of multiplied numbers (100K); null of null."""
    found = _distinct(F.filter(_found(text, PLAIN, 2), lambda t: t != ""))
    return F.when(text.rlike(DIGIT), found).when(text.isNotNull(), _none())


def multiplier_numbers(text: Column) -> Column:
    """Distinct multiplied numbers written out (100K as 100000), sorted; null of null."""
    pairs = F.zip_with(_found(text, MULTIPLIED, 1), _found(text, MULTIPLIED, 2), lambda n, u: F.when(n != "", _written_out(n, u)))
    return F.when(text.rlike(HAS_UNIT), _distinct(F.array_compact(pairs))).when(text.isNotNull(), _none())


def with_multiplied(text: Column, numbers: Column) -> Column:
    """The text's ``numbers_in`` and its multiplied numbers together."""
    return F.when(text.rlike(HAS_UNIT), _distinct(F.concat(numbers, multiplier_numbers(text)))).when(text.isNotNull(), numbers)


def all_numbers(text: Column) -> Column:
    """Both kinds together."""
    return with_multiplied(text, numbers_in(text))
