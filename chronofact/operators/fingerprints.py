"""Order-free fingerprints of tables and of groups of rows, so that equal parts are told without a join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Seeds that make the two hashes of a row different functions.
SEEDS = (17, 71)


def multiset(*columns: Column | str) -> Column:
    """An aggregate over rows: equal for equal multisets of the columns, in any order and dealt in any way.

    Two 64-bit hashes of each row are summed as halves of 32 bits, which can't overflow below 2^31 rows. Sums combine
    before the shuffle, whatever the size of a group, and rows that repeat count as often as they do.
    """
    sums = []
    for seed in SEEDS:
        h = F.xxhash64(F.lit(seed), *columns)
        sums += [F.sum(F.shiftrightunsigned(h, 32)), F.sum(h.bitwiseAND(0xFFFFFFFF))]
    return F.concat_ws("-", F.count("*").cast("string"), *[s.cast("string") for s in sums])


def differing_parts(before: DataFrame, after: DataFrame, key: str, columns: list[str], parts: int = 64, leaves: int = 64) -> list[int]:
    """The leaves, parts of rows by the hash of their key, in which two tables differ; none if the tables are equal.

    A tree of two levels: ``parts`` of ``leaves`` each. Each table leaves one row a leaf (4096 at most), those are summed
    up to parts, and only parts that differ show their leaves.
    """
    leaf = F.pmod(F.xxhash64(F.col(key)), F.lit(parts * leaves)).cast("int")
    each = [t.groupBy(leaf.alias("leaf")).agg(multiset(F.col(key), *columns).alias(name)) for t, name in ((before, "_b"), (after, "_a"))]
    both = each[0].join(each[1], "leaf", "full").withColumn("part", F.expr(f"leaf div {leaves}"))
    tops = both.groupBy("part").agg(F.bool_and(F.col("_b").eqNullSafe(F.col("_a"))).alias("same"))
    found = both.join(tops.where("not same").select("part"), "part", "left_semi").where(~F.col("_b").eqNullSafe(F.col("_a")))
    return sorted(r["leaf"] for r in found.select("leaf").collect())


def only_parts(rows: DataFrame, key: str, wanted: list[int], parts: int = 64, leaves: int = 64) -> DataFrame:
    """The rows of some leaves of ``differing_parts``."""
    return rows.where(F.pmod(F.xxhash64(F.col(key)), F.lit(parts * leaves)).cast("int").isin(wanted))
