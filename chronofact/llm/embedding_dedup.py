"""Embedding near-dedup: an exact metric range join with pivots."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronofact.llm.components import connected_components
from chronofact.llm.shared import written

#: Slack for angles and norms computed in double precision.
SLACK = 1e-7


def _vectors(batches: Iterator[pa.RecordBatch], units: bool) -> Iterator[pa.RecordBatch]:
    """(vec_id, label, embedding of doubles) -> vec_id, label, size, key and, if asked for, unit.

    The key, a 128-bit hash of the components, is null for vectors that link with nothing.
    """
    for b in batches:
        lists = b.column(2)
        flat, offsets = lists.flatten(), np.append(0, np.cumsum(np.nan_to_num(pc.list_value_length(lists).to_numpy(zero_copy_only=False)))).astype(np.int64)
        values = flat.to_numpy(zero_copy_only=False).astype(np.float64)
        size = np.diff(offsets)
        usable = pc.and_(pc.is_valid(b.column(0)), pc.is_valid(b.column(1))).to_numpy(zero_copy_only=False) & (size > 0)
        key, unit = [None] * len(size), [None] * len(size)
        for n in np.unique(size[usable]):
            rows = np.flatnonzero(usable & (size == n))
            m = values[offsets[rows][:, None] + np.arange(n)]
            # A null component is NaN here. Scaling by the largest component first keeps the norm from over- or underflowing.
            top = np.abs(m).max(axis=1)
            good = np.isfinite(top) & (top > 0)
            rows, m = rows[good], m[good]
            scaled = m / top[good, None]
            scaled /= np.sqrt((scaled * scaled).sum(axis=1))[:, None]
            for i, r in enumerate(rows):
                key[r], unit[r] = xxhash.xxh3_128_digest(m[i].tobytes()), scaled[i]
        out = [b.column(0), b.column(1), pa.array(size, pa.int32()), pa.array(key, pa.binary())]
        yield pa.RecordBatch.from_arrays(out + [pa.array(unit, pa.list_(pa.float64()))] * units, names=["vec_id", "label", "size", "key", "unit"][: 4 + units])


def _pivots(vectors: DataFrame, cell: int, most: int, most_bytes: int = 64 << 20) -> dict[tuple[int, int], np.ndarray]:
    """Some vectors of each (label, size) as pivots: one for every ``cell`` vectors, ``most`` and ``most_bytes`` in all at most.

    The driver sees counts of ``most`` groups, the numbers of the drawn vectors, and the components of the chosen ones.
    """
    counts = {(r["label"], r["size"]): r["n"] for r in vectors.groupBy("label", "size").agg(F.count("*").alias("n")).orderBy(F.desc("n")).limit(most).collect()}
    most = max(1, min(most, most_bytes // (8 * max([1, *(size for _, size in counts)]))))
    counts = dict(list(counts.items())[:most])
    share = max(1.0, sum(-(-n // cell) for n in counts.values()) / most)
    want = {k: max(1, int(-(-n // cell) / share)) for k, n in counts.items()}
    # Each vector is drawn with a chance that gives its group somewhat more pivots than wanted; the driver keeps the wanted number.
    rates = vectors.sparkSession.createDataFrame([(*k, min(1.0, (4 * w + 16) / counts[k])) for k, w in want.items()], "label int, size int, rate double")
    draw = F.pmod(F.xxhash64("rep", "label"), F.lit(1 << 20)) / float(1 << 20)
    drawn = vectors.join(F.broadcast(rates), ["label", "size"]).where(draw < F.col("rate")).select("label", "size", "rep", draw.alias("draw")).orderBy("draw", "rep").limit(8 * most + 16 * len(want))
    chosen: dict[tuple[int, int], list[int]] = {}
    for r in drawn.collect():
        mine = chosen.setdefault((r["label"], r["size"]), [])
        if len(mine) < want[r["label"], r["size"]]:
            mine.append(r["rep"])
    reps = vectors.sparkSession.createDataFrame([(x,) for mine in chosen.values() for x in mine], "rep long")
    out: dict[tuple[int, int], list] = {}
    for r in vectors.join(F.broadcast(reps), "rep").select("label", "size", "unit").toLocalIterator():
        out.setdefault((r["label"], r["size"]), []).append(r["unit"])
    return {k: np.array(v) for k, v in out.items()}


CELL = "label int, size int, cell int, home boolean, rep long, n long, unit array<double>"


def _to_cells(batches: Iterator[pa.RecordBatch], pivots: dict[tuple[int, int], np.ndarray], radius: float) -> Iterator[pa.RecordBatch]:
    """Sends each vector to the cell of its nearest pivot, and into every cell whose pivot is at most two radii further.

    If x is in its cell at pivot p and y within the radius of x is at home at q, then d(y, p) <= d(x, p) + r <=
    d(x, q) + r <= d(y, q) + 2 r: y is replicated to x's cell, and each pair meets in the home cells of both.
    """
    for b in batches:
        p = b.to_pandas()
        for key, part in p.groupby(["label", "size"], sort=False):
            units = np.stack(part["unit"].to_numpy())
            centers = pivots.get(key)
            if centers is None:
                d = np.zeros((len(part), 1))
            else:
                d = np.arccos(np.clip(units @ centers.T, -1.0, 1.0))
            near = d.argmin(axis=1)
            row, cell = np.nonzero(d <= d.min(axis=1, keepdims=True) + 2 * radius + SLACK)
            t = part.iloc[row]
            yield pa.RecordBatch.from_pandas(pd.DataFrame({"label": t["label"].astype("int32"), "size": t["size"].astype("int32"), "cell": cell.astype("int32"), "home": cell == near[row], "rep": t["rep"], "n": t["n"], "unit": t["unit"]}), preserve_index=False)


def _compare(pdf: pd.DataFrame, cosine: float) -> pd.DataFrame:
    """One block of a cell against another: (u, v, n). Rows with v null carry n links of u; the others are links that
    hold the block's linked vectors together, a star for each of its groups."""
    a, b = pdf[pdf["side"] == 0], pdf[pdf["side"] == 1]
    if a.empty or b.empty:
        return pd.DataFrame({"u": [], "v": [], "n": []})
    reps, others = a["rep"].to_numpy(), b["rep"].to_numpy()
    linked = np.stack(a["unit"].to_numpy()) @ np.stack(b["unit"].to_numpy()).T >= cosine
    linked &= reps[:, None] != others[None, :]
    n = linked @ b["n"].to_numpy().astype(np.float64)
    i, j = np.nonzero(linked)
    nodes, at = np.unique(np.concatenate([reps[i], others[j]]), return_inverse=True)
    x, y = at[: len(i)], at[len(i) :]
    low = np.arange(len(nodes))
    while True:
        m = np.minimum(low[x], low[y])
        new = low.copy()
        np.minimum.at(new, x, m)
        np.minimum.at(new, y, m)
        new = new[new]
        if (new == low).all():
            break
        low = new
    star = np.flatnonzero(low != np.arange(len(nodes)))
    hit = np.flatnonzero(n)
    return pd.DataFrame({"u": np.concatenate([reps[hit], nodes[star]]), "v": pd.array([None] * len(hit) + list(nodes[low[star]]), dtype="Int64"), "n": np.concatenate([n[hit], np.zeros(len(star))]).astype(np.int64)})


def embedding_groups(vectors: DataFrame, cosine: float = 0.98, cell: int = 4096, block: int = 2048, most_pivots: int = 4096) -> DataFrame:
    """vectors(vec_id, embedding, label) -> vec_id, n_links, component_id, kept for every row.

    Vectors of one label and one length are linked at ``cosine`` or more, in double precision. Equal vectors of a label
    (by a 128-bit hash) are one class, so copies never make pairs; classes go to the cells of pivots (a bounded sample, which affects speed
    alone) and, near a boundary, into neighbouring cells; each cell is cut into blocks, so that no task holds more than
    two blocks, and returns counts and one star for each group of linked vectors instead of all pairs. A null, empty or
    zero vector, one with null or non-finite components, or without a label or vec_id, links with nothing: no links,
    itself as component, kept. Rows that repeat a vec_id count as vectors of their own, and an equal copy of a vector
    is a link. An empty table gives no rows.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("int").alias("label"), F.col("embedding").cast("array<double>").alias("e"))
    keyed = rows.mapInArrow(lambda it: _vectors(it, False), "vec_id long, label int, size int, key binary")
    units = rows.mapInArrow(lambda it: _vectors(it, True), "vec_id long, label int, size int, key binary, unit array<double>")
    classes = written(
        units.where("key is not null")
        .groupBy("label", "size", "key").agg(F.min("vec_id").alias("least_id"), F.count("*").alias("n"), F.first("unit").alias("unit"))
        .select("label", "size", "key", "least_id", F.monotonically_increasing_id().alias("rep"), "n", "unit"),
        "classes",
    )
    lean = classes.select("label", "size", "rep", "n", "unit")
    pivots, radius = _pivots(lean, cell, most_pivots), math.acos(cosine)
    cells = written(lean.mapInArrow(lambda it: _to_cells(it, pivots, radius), CELL), "cells")
    # A cell's members are dealt to blocks by hash; each home block meets each block of all members.
    sizes = cells.groupBy("label", "size", "cell").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    dealt = cells.join(sizes, ["label", "size", "cell"]).withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    left = dealt.where("home").withColumn("other", every).select("label", "size", "cell", F.col("own").alias("i"), F.col("other").alias("j"), F.lit(0).alias("side"), "rep", "n", "unit")
    right = dealt.withColumn("other", every).select("label", "size", "cell", F.col("other").alias("i"), F.col("own").alias("j"), F.lit(1).alias("side"), "rep", "n", "unit")
    found = written(left.union(right).groupBy("label", "size", "cell", "i", "j").applyInPandas(lambda p: _compare(p, cosine), "u long, v long, n long"), "links")
    counts = found.where("v is null").groupBy("u").agg(F.sum("n").alias("links"))
    parts = connected_components(found.where("v is not null").select("u", "v"))
    named = classes.drop("unit").join(parts, F.col("rep") == F.col("node"), "left").withColumn("component", F.coalesce("component", "rep"))
    least = named.groupBy("component").agg(F.min("least_id").alias("component_id"))
    done = named.join(least, "component").join(counts, F.col("rep") == F.col("u"), "left").select("label", "size", "key", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"), "component_id")
    joined = keyed.join(done, ["label", "size", "key"], "left")
    component = F.coalesce("component_id", "vec_id")
    return joined.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
