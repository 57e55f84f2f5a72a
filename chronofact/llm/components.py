"""Connected components of a link table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronofact.llm.shared import emptied, written


def _rows_and_sum(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("s")).first()
    return row["n"], row["s"] or 0


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(u, v) links of long ids -> (node, component), component the smallest id reachable.

    Each round hangs every node's larger neighbours under its smallest one (large star), then its smaller neighbours
    (small star). Only minima are shuffled ahead of the joins, so a hub needs no group in memory; each round is
    written to the shared folder, and the one before is emptied. Links with a null end and links to oneself are ignored; nodes without other links are
    absent.
    """
    ends = edges.where("u is not null and v is not null and u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    now = written(ends.distinct(), "star")
    state = _rows_and_sum(now)
    for _ in range(max_rounds):
        if not state[0]:
            break
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        before, now = now, written(small.where("u <> v").distinct(), "star")
        emptied(before)
        if (after := _rows_and_sum(now)) == state:
            break
        state = after
    else:
        raise RuntimeError(f"components have not settled after {max_rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select("v", "v").distinct())
