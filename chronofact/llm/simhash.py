"""SimHash near-dedup with pigeonhole blocks."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronofact.llm.components import connected_components
from chronofact.llm.shared import written

SEED, BITS = 42, 64
#: Shingles whose bits are counted at once: 64 bytes each.
COUNTED = 1 << 16


def fingerprint(text: str | None, words_in_shingle: int) -> int:
    """Signed 64-bit SimHash of the XXH64 of each word shingle, repeats included; no words give zero."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= words_in_shingle:
        return xxhash.xxh64_intdigest(joined, SEED) - (1 << BITS) * (xxhash.xxh64_intdigest(joined, SEED) >> (BITS - 1))
    starts = [0, *accumulate(len(w) + 1 for w in words)]
    ends = [e - 1 for e in starts[words_in_shingle:]]
    digest = xxhash.xxh64_digest
    ones, n = np.zeros(BITS, dtype=np.int64), len(ends)
    for at in range(0, n, COUNTED):
        part = b"".join([digest(joined[s:e], SEED) for s, e in zip(starts[at : at + COUNTED], ends[at : at + COUNTED], strict=False)])
        ones += np.unpackbits(np.frombuffer(part, dtype=np.uint8).reshape(-1, BITS // 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n).view(">i8")[0])


def fingerprints(docs: DataFrame, words_in_shingle: int = 5) -> DataFrame:
    """docs(doc_id, text) -> doc_id, fp long. A-Z count as a-z; words end at ASCII white space only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [fingerprint(x.as_py(), words_in_shingle) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64())], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


def _block_sets(distance: int, blocks: int) -> list[list[tuple[int, int]]]:
    """Every choice of blocks that a pair within the distance may share: (shift, width) of each block."""
    edges = [BITS * i // blocks for i in range(blocks + 1)]
    parts = [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]
    return [list(c) for c in combinations(parts, blocks - distance)]


def _masked(fp: Column, parts: list[tuple[int, int]]) -> Column:
    mask = sum(((1 << width) - 1) << shift for shift, width in parts)
    return fp.bitwiseAND(F.lit(mask - (1 << BITS) if mask >> (BITS - 1) else mask).cast("long"))


def close_pairs(fps: DataFrame, distance: int = 2, blocks: int = 4) -> DataFrame:
    """fps(fp), distinct -> (a, b), a < b, of all fingerprints that differ in ``distance`` bits or fewer, each pair once.

    Of ``blocks`` blocks, a pair within the distance shares blocks - distance at least. Fingerprints meet under each
    such choice of blocks, and the join verifies the Hamming distance; a pair that shares more is emitted under the
    first choice only. More blocks make the keys longer and the buckets smaller, at the price of more copies.
    """
    if not 0 <= distance < blocks <= BITS:
        raise ValueError("blocks must be over distance")
    sets = _block_sets(distance, blocks)
    keyed = fps.select("fp", F.posexplode(F.array(*[_masked(F.col("fp"), s) for s in sets])).alias("no", "block"))
    a, b = keyed.select(F.col("fp").alias("a"), "no", "block"), keyed.select(F.col("fp").alias("b"), "no", "block")
    earlier = F.lit(False)
    for i, s in enumerate(sets):
        earlier = earlier | ((F.col("no") > i) & (_masked(F.col("a"), s) == _masked(F.col("b"), s)))
    return a.join(b, ["no", "block"]).where((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance) & ~earlier).select("a", "b")


def simhash_groups(docs: DataFrame, words_in_shingle: int = 5, distance: int = 2, blocks: int = 4) -> DataFrame:
    """docs(doc_id, text) -> doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable).

    Rows of equal fingerprint are one class with one representative; only classes are joined and linked, so copies never
    make pairs. A null text is empty and has fingerprint zero, which links like any other. A row without doc_id is
    returned with its group's component_id but never names a component, unless the group has no id at all (null).
    Repeated rows are returned as often as they come. An empty table gives no rows.
    """
    rows = written(fingerprints(docs, words_in_shingle), "fingerprints")
    classes = rows.groupBy("fp").agg(F.min("doc_id").alias("rep"))
    pairs = close_pairs(classes.select("fp"), distance, blocks)
    parts = connected_components(pairs.select(F.col("a").alias("u"), F.col("b").alias("v")))
    named = classes.join(parts.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    of_fp = named.join(least, "component").select("fp", "component_id")
    return rows.join(of_fp, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
