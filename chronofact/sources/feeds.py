"""Feed files as entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The tags of an item that are read; content:encoded and dc:creator lose their prefixes ahead of parsing.
ITEM = "title string, link string, description string, encoded string, guid string, pubDate string, category array<string>, author array<string>"
RSS = f"channel struct<title:string,item:array<struct<{ITEM.replace(' array', ':array').replace(' string', ':string').replace(', ', ',')}>>>"


def _clean(c: Column) -> Column:
    return F.nullif(F.trim(F.regexp_replace(c, r"^\s+|\s+$", "")), F.lit(""))


def parse_feeds(files: DataFrame, content: str = "content") -> DataFrame:
    """(source_id, content) RSS texts -> one row per item: source_id, raw_index, title, link, description, guid,
    pub_date_raw, categories, authors.

    The full content is preferred to the description; author and dc:creator share one list in document order. Empty
    texts are null. Files with a document type or that don't parse give one row with raw_index -1 and an ``error``.
    """
    text = F.col(content).cast("string")
    plain = F.regexp_replace(F.regexp_replace(text, r"(</?)content:encoded\b", "$1encoded"), r"(</?)dc:creator\b", "$1author")
    unsafe = text.rlike(r"(?i)<!DOCTYPE|<!ENTITY")
    parsed = F.from_xml(F.when(~unsafe, plain), RSS, {"mode": "PERMISSIVE"})
    rows = files.select("source_id", text.alias("_t"), unsafe.alias("_unsafe"), parsed.alias("_x"))
    broken = F.col("_unsafe") | F.col("_x.channel").isNull()
    items = F.when(broken, F.array().cast(rows.schema["_x"].dataType["channel"].dataType["item"].dataType)).otherwise(F.col("_x.channel.item"))
    out = rows.select("source_id", F.posexplode(items).alias("raw_index", "i")).select(
        "source_id", "raw_index", _clean(F.col("i.title")).alias("title"), _clean(F.col("i.link")).alias("link"), F.coalesce(_clean(F.col("i.encoded")), _clean(F.col("i.description"))).alias("description"), _clean(F.col("i.guid")).alias("guid"), _clean(F.col("i.pubDate")).alias("pub_date_raw"),
        F.array_compact(F.transform(F.coalesce("i.category", F.array().cast("array<string>")), _clean)).alias("categories"), F.array_compact(F.transform(F.coalesce("i.author", F.array().cast("array<string>")), _clean)).alias("authors"), F.lit(None).cast("string").alias("error"),
    )
    failed = rows.where(broken).select("source_id", F.lit(-1).alias("raw_index"), F.when(F.col("_unsafe"), F.lit("parse failed: document type")).otherwise(F.lit("parse failed: not RSS")).alias("error"))
    return out.unionByName(failed, allowMissingColumns=True)


def read_feed_entries(spark: SparkSession, path: str, source_id: Column | None = None) -> DataFrame:
    """The items of all feed files under a path; the source is the file's name unless it is given."""
    files = spark.read.format("binaryFile").load(path)
    name = F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1) if source_id is None else source_id
    return parse_feeds(files.select(name.alias("source_id"), F.decode("content", "UTF-8").alias("content")))
