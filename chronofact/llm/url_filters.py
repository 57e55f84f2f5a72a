"""URL filters: pattern rules indexed by their rarest literal token."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A literal token of a url or a rule; short enough that rules nearly always hold one.
TOKEN = "[a-z0-9]+"


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host and path of a url; both empty if it is null or has no ``://``.

    The host ends at the first ``/``, ``?`` or ``#`` and has A-Z lower-cased; the path goes on to ``?`` or ``#``.
    """
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, r"(?s)^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return host, path


def rule_table(spark, rules: Iterable[tuple[str, str, str]]) -> DataFrame:
    """(host, path, action) rules -> rule, action, pattern, tokens.

    The pattern is matched against host + path of a url: the host or any subdomain, then the rule's path as a prefix.
    Only tokens that the rule's text closes off on both sides can be looked up in a url: ``/en/1`` also fits ``/en/12``,
    so a last token that the path leaves open doesn't count. A rule without any such token is a candidate for every url.
    """
    given = spark.createDataFrame([tuple(r) for r in rules], "host string, path string, action string")
    rule = F.concat("host", "path")
    return given.select(
        rule.alias("rule"),
        F.col("action"),
        F.concat(F.lit(r"(?s)^(?:[^/]*\.)?\Q"), "host", F.lit(r"\E"), F.when(F.length("path") > 0, F.concat(F.lit(r"\Q"), "path", F.lit(r"\E.*$"))).otherwise(F.lit("(?:/.*)?$"))).alias("pattern"),
        F.array_distinct(F.regexp_extract_all(F.lower(F.concat(F.col("host"), F.lit("/"), F.regexp_replace("path", r"[A-Za-z0-9]+$", ""))), F.lit(f"({TOKEN})"))).alias("tokens"),
    )


def url_tokens(host: Column, path: Column) -> Column:
    """The distinct tokens of a url, and the empty one under which rules without tokens are filed."""
    return F.array_union(F.array(F.lit("")), F.array_distinct(F.regexp_extract_all(F.concat(host, F.lit("/"), F.lower(path)), F.lit(f"({TOKEN})"))))


def filter_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", url: str = "url") -> DataFrame:
    """Adds host, path, rule and verdict to each row of pages.

    Distinct urls are exploded into tokens. Every rule is filed under the one of its tokens that the fewest urls hold,
    counted over all urls; a url's tokens fetch candidate rules by an equi-join, and only those run their regular
    expression. The longest fitting rule wins, then the first in text order; no rule gives ``default``. Repeated urls
    are judged once; null or odd urls get empty host and path and the default. Columns of pages with the names added
    here are replaced. No table is broadcast by hand: the rules are small enough or Spark shuffles both sides.
    """
    host, path = url_parts(F.col("_url"))
    seen = pages.select(F.coalesce(F.col(url), F.lit("")).alias("_url")).distinct().select("_url", host.alias("host"), path.alias("path"))
    exploded = seen.select("_url", "host", "path", F.explode(url_tokens(F.col("host"), F.col("path"))).alias("token"))
    ruled = rules.select("*", F.explode_outer(F.when(F.size("tokens") > 0, F.col("tokens")).otherwise(F.array(F.lit("")))).alias("token"))
    held = exploded.join(ruled.select("token").distinct(), "token", "left_semi").groupBy("token").agg(F.count("*").alias("urls"))
    filed = ruled.join(held, "token", "left").groupBy("rule", "action", "pattern").agg(F.min_by("token", F.struct(F.coalesce("urls", F.lit(0)).alias("urls"), F.col("token").alias("token"))).alias("token"))
    hits = exploded.join(filed, "token").where(F.expr("rlike(concat(host, path), pattern)"))
    best = hits.groupBy("_url").agg(F.min_by(F.struct("rule", "action"), F.struct((-F.length("rule")).alias("n"), F.col("rule").alias("r"), F.col("action").alias("a"))).alias("best"))
    kept = ["`" + c.replace("`", "``") + "`" for c in pages.columns if c.lower() not in ("host", "path", "rule", "verdict", "_url")]
    host, path = url_parts(F.col("_url"))
    return pages.withColumn("_url", F.coalesce(F.col(url), F.lit(""))).join(best, "_url", "left").select(*kept, host.alias("host"), path.alias("path"), F.col("best.rule").alias("rule"), F.coalesce("best.action", F.lit(default)).alias("verdict"))
