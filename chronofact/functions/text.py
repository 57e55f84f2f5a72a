"""Column expressions over names, texts, dates and values."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Runs of characters that are no letters, numbers or underscores. Java's \w is ASCII, so classes are spelled out.
NON_WORD = r"[^\p{L}\p{N}_]+"
#: White space as Python sees it: Unicode's and four separators.
SPACES = r"(?U)[\s\x1c-\x1f]+"
#: Number literals that both engines read alike.
NUMERIC = r"^\s*[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?\s*$"

# The comparable fields and their labels.
FIELD_LABELS = {
    "context_window_tokens": "Context window",
    "input_price_usd": "Input price (USD)",
    "output_price_usd": "Output price (USD)",
    "benchmark_scores": "Named benchmark scores",
    "availability_regions": "Availability regions",
    "licence_terms": "Licence terms",
    "modalities": "Modalities",
}
# Reviewed spellings of one field.
FIELD_SPELLINGS = ("context_window", "Context window", "context window", "context-window")


def normalise_name(c: Column) -> Column:
    """Lower case, non-word runs to one space, trimmed."""
    return F.trim(F.regexp_replace(F.lower(c), NON_WORD, " "))


def normalise_claim_text(c: Column) -> Column:
    """Lower case, white space collapsed."""
    return F.trim(F.regexp_replace(F.lower(c), SPACES, " "))


def digest_key(c: Column) -> Column:
    """``sha256:`` and the hex digest of the UTF-8 bytes; identity of a url, hash of a content."""
    return F.concat(F.lit("sha256:"), F.sha2(F.encode(c, "UTF-8"), 256))


def normalized_content(title: Column, body: Column) -> Column:
    """Title and body with white space collapsed, joined by a blank line; empty parts are left out."""
    parts = [F.nullif(F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), SPACES, " ")), F.lit("")) for c in (title, body)]
    return F.concat_ws("\n\n", *parts)


def field_label(c: Column) -> Column:
    """The label of a field within a sentence: its first letter lower; other fields with spaces for underscores."""
    known = F.create_map(*[F.lit(x) for kv in FIELD_LABELS.items() for x in kv])
    label = F.coalesce(F.element_at(known, c), F.replace(c, F.lit("_"), F.lit(" ")))
    return F.concat(F.lower(F.substring(label, 1, 1)), F.substring(label, 2, 1 << 30))


def canonical_field(c: Column) -> Column:
    """The field that a reviewed spelling stands for; other names stay."""
    return F.when(c.isin(*FIELD_SPELLINGS), F.lit("context_window_tokens")).otherwise(c)


@F.pandas_udf(T.StringType())
def nfc(values: pd.Series) -> pd.Series:
    """Unicode NFC, for which Spark has no function."""
    return values.map(lambda v: unicodedata.normalize("NFC", v), na_action="ignore")


@F.pandas_udf(T.ArrayType(T.StringType()))
def normalize_authors(values: pd.Series) -> pd.Series:
    """NFC, trimmed, no empty ones, first of each in order."""
    return values.map(lambda vs: list(dict.fromkeys(c for v in vs if v is not None and (c := unicodedata.normalize("NFC", v).strip()))), na_action="ignore")


@F.pandas_udf(T.ArrayType(T.StringType()))
def normalize_tags(values: pd.Series) -> pd.Series:
    """As authors, case-folded before the first of each is taken."""
    return values.map(lambda vs: list(dict.fromkeys(c for v in vs if v is not None and (c := unicodedata.normalize("NFC", v).strip().casefold()))), na_action="ignore")


def filter_value(c: Column) -> Column:
    """A filter's string: NFC and trimmed, case kept."""
    return F.trim(nfc(c))


#: RFC 822 dates without their weekday, which Spark's patterns reject.
DATE_PATTERNS = ("d MMM yyyy HH:mm:ss xx", "d MMM yyyy HH:mm:ss z", "d MMM yyyy HH:mm xx", "d MMM yyyy HH:mm z", "d MMM yyyy HH:mm:ss", "d MMM yyyy HH:mm")


def parse_pub_date(c: Column) -> Column:
    """An RFC 822 date in UTC; null if absent or unparseable (see ``bad_pub_date``); no zone is UTC."""
    plain = F.regexp_replace(F.trim(c), r"^[A-Za-z]+,?\s+", "")
    return F.coalesce(*[F.try_to_timestamp(plain, F.lit(p)) for p in DATE_PATTERNS])


def bad_pub_date(c: Column) -> Column:
    """Whether a date is there and can't be parsed."""
    return c.isNotNull() & parse_pub_date(c).isNull()


def as_number(c: Column, clean: str | None = None) -> Column:
    """A value as a double if it is a plain number literal, else null; ``clean`` names characters to leave out first."""
    c = F.regexp_replace(c, clean, "") if clean else c
    return F.when(F.coalesce(c, F.lit("")).rlike(NUMERIC), F.trim(c).try_cast("double"))


def parse_price(c: Column) -> Column:
    """A strict price literal such as ``$1,234.56`` as decimal(38,9), else null."""
    return F.when(F.coalesce(c, F.lit("")).rlike(r"^\$?(\d{1,3}(,\d{3})+|\d+)(\.\d+)?$"), F.regexp_replace(c, r"[$,]", "").try_cast("decimal(38,9)"))


def parse_int(c: Column) -> Column:
    """A bare integer as decimal(38,0), else null."""
    return F.when(F.coalesce(c, F.lit("")).rlike(r"^\s*[+-]?\d+\s*$"), F.trim(c).try_cast("decimal(38,0)"))


def context_value(c: Column) -> Column:
    """``100K``, ``1.5M``, ``100,000`` -> a positive integer as string; anything else null."""
    form = r"^(?:(\d+(?:\.\d+)?)\s*([kKmM])|(\d{1,3}(?:,\d{3})+|\d+))$"
    t = F.trim(c)
    digits = F.replace(F.concat(F.regexp_extract(t, form, 1), F.regexp_extract(t, form, 3)), F.lit(","), F.lit(""))
    times = F.element_at(F.create_map(*[F.lit(x) for x in ("", 1, "K", 1000, "M", 1000000)]), F.upper(F.regexp_extract(t, form, 2)))
    # A whole, positive number: each part stands once in the expression, which keeps generated code short.
    return F.nullif(F.regexp_extract((digits.try_cast("decimal(28,9)") * times).cast("string"), r"^([1-9]\d*)(?:\.0*)?$", 1), F.lit(""))
