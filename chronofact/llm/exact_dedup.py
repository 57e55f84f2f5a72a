"""Exact dedup over an extendible-hash index on shared files."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronofact.llm.shared import written

#: Bits of the hash that the directory can use; its histogram has 2^20 rows at most, whatever the input.
MAX_DEPTH = 20
#: Bytes of the texts that a task looks at together; bounds its memory, but for a single longer text.
BYTES = 4_000_000


def directory(cells: np.ndarray, sizes: np.ndarray, capacity: int, max_depth: int = MAX_DEPTH) -> np.ndarray:
    """Bytes of the directory's finest cells -> the first cell of each bucket, ascending.

    The directory starts as one bucket. While a bucket holds over ``capacity`` bytes, the directory doubles: the next
    bit of the hash divides the overfull buckets, and the others keep their depth.
    """
    total = np.zeros((1 << max_depth) + 1)
    np.add.at(total, cells + 1, sizes)
    total = total.cumsum()
    buckets, depth = np.array([0]), 0
    ends = np.array([1 << max_depth])
    while depth < max_depth:
        overfull = (total[ends] - total[buckets] > capacity) & (ends - buckets == 1 << (max_depth - depth))
        if not overfull.any():
            break
        depth += 1
        middle = buckets[overfull] + (1 << (max_depth - depth))
        buckets = np.sort(np.concatenate([buckets, middle]))
        ends = np.append(buckets[1:], 1 << max_depth)
    return buckets


def fold(batches: Iterator[pa.RecordBatch], buckets: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Folds the equal texts of a part of a batch into one entry, that of the largest doc_id, and names its bucket.

    A text with many copies leaves each part once. Columns behind doc_id, text, h and text_sha256 go along.
    """
    for whole in batches:
        for b in slices(whole, "text"):
            order = pc.sort_indices(b.select(["doc_id"]), sort_keys=[("doc_id", "descending")])
            t = pa.table({"i": order, **{c: b[c].take(order) for c in ("h", "text_sha256", "text")}})
            t = t.group_by(["h", "text_sha256", "text"], use_threads=False).aggregate([("i", "first"), ([], "count_all")])
            win = b.take(t["i_first"].combine_chunks())
            cell = (win["h"].to_numpy().view(np.uint64) >> np.uint64(64 - MAX_DEPTH)).astype(np.int64)
            bucket = pa.array(np.searchsorted(buckets, cell, side="right") - 1, pa.int32())
            entry = {"bucket": bucket, "h": win["h"], "text_sha256": win["text_sha256"], "text": win["text"], "keep_id": win["doc_id"], "n": t["count_all"].combine_chunks()}
            yield pa.RecordBatch.from_pydict(entry | {c: win[c] for c in b.schema.names[4:]})
        # What Arrow has freed goes back to the system, as the executor shares its memory with other workers.
        pa.default_memory_pool().release_unused()


def slices(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """Slices of a batch that hold some BYTES of the texts of a column, or a single larger text; rows keep their order."""
    size = pc.fill_null(pc.binary_length(batch[column]), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    part = (size.cumsum() - size) // BYTES
    start = np.flatnonzero(np.diff(part, prepend=-1))
    for at, end in zip(start, np.append(start, len(part))[1:], strict=True):
        yield batch.slice(at, end - at)


class Chains:
    """The entries of one hash value: one chain for each different text, with the place of its kept row."""

    def __init__(self) -> None:
        self.h: int | None = None
        self.links: list[list] = []
        self.out: list[tuple] = []
        self.rows: list[tuple[pa.RecordBatch, int]] = []

    def add(self, bucket: int, h: int, sha: str, text: str, keep: int | None, n: int, row: tuple[pa.RecordBatch, int] | None = None) -> None:
        if h != self.h:
            self.close()
            self.h = h
        for link in self.links:
            if link[3] == text:
                if keep is not None and (link[4] is None or keep > link[4]):
                    link[4], link[6] = keep, row
                link[5] += n
                return
            if link[2] == sha:
                raise ValueError(f"two different texts have the SHA-256 {sha}")
        self.links.append([bucket, h, sha, text, keep, n, row])

    def close(self) -> None:
        self.out += [(x[0], x[1], x[2], no, x[4], x[5]) for no, x in enumerate(self.links)]
        self.rows += [x[6] for x in self.links if x[6] is not None]
        self.links = []

    def batch(self) -> Iterator[pa.RecordBatch]:
        out, rows, self.out, self.rows = self.out, self.rows, [], []
        if out:
            found = {f.name: pa.array([x[i] for x in out], f.type) for i, f in enumerate(INDEX)}
            if rows:
                # Kept rows are gathered batch by batch; there are two where a chain began in the batch before.
                carried = pa.Table.from_batches([b.take(pa.array([i for _, i in own])) for b, own in _runs(rows)])
                found |= {c: carried[c].combine_chunks() for c in carried.schema.names}
            yield pa.RecordBatch.from_pydict(found)


def _runs(rows: list[tuple[pa.RecordBatch, int]]) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Consecutive rows of one batch together."""
    for _, run in groupby(rows, key=lambda r: id(r[0])):
        found = list(run)
        yield found[0][0], found


INDEX = pa.schema([("bucket", pa.int32()), ("h", pa.int64()), ("text_sha256", pa.string()), ("chain", pa.int32()), ("keep_id", pa.int64()), ("group_size", pa.int64())])


def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One owner's key range, sorted by hash. Holds the chains of one hash value at a time."""
    chains = Chains()
    for whole in batches:
        for b in slices(whole, "text"):
            # With columns that go along, the kept row's text goes along too.
            carried = b.select(["text", *b.schema.names[6:]]) if b.num_columns > 6 else None
            for i, row in enumerate(zip(*(b.column(c).to_pylist() for c in range(6)), strict=True)):
                chains.add(*row, None if carried is None else (carried, i))
            yield from chains.batch()
        pa.default_memory_pool().release_unused()
    chains.close()
    yield from chains.batch()


def _index(docs: DataFrame, capacity: int, carried: tuple[str, ...] = ()) -> DataFrame:
    """The index of ``exact_groups``, not stored yet; with ``carried``, then the text and those columns of each kept row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("h"), F.sha2(text, 256).alias("text_sha256"), *carried)
    sizes = docs.select(F.xxhash64(text).alias("h"), F.octet_length(text).cast("long").alias("bytes")).groupBy("h").agg(F.max("bytes").alias("bytes"))
    cells = sizes.groupBy(F.shiftrightunsigned("h", 64 - MAX_DEPTH).alias("cell")).agg(F.sum("bytes").alias("bytes")).toPandas()
    held = cells["bytes"].to_numpy(dtype=float)
    buckets = directory(cells["cell"].to_numpy(dtype=np.int64), held, max(capacity, int(held.sum()) >> 17))
    more = [rows.schema[c] for c in carried]
    entry = T.StructType.fromDDL("bucket int, h long, text_sha256 string, text string, keep_id long, n long")
    found = T.StructType.fromDDL("bucket int, h long, text_sha256 string, chain int, keep_id long, group_size long")
    with_text = [T.StructField("text", T.StringType()), *more] if carried else []
    entries = rows.mapInArrow(lambda it: fold(it, buckets), T.StructType([*entry, *more]))
    return entries.repartition("bucket").sortWithinPartitions("h").mapInArrow(own, T.StructType([*found, *with_text]))


def exact_groups(docs: DataFrame, capacity: int = 1 << 20) -> DataFrame:
    """docs(doc_id, text) -> the index: bucket, h, text_sha256, chain, keep_id (largest doc_id) and group_size of each text.

    Map tasks fold equal texts and look their hash up in the directory; each owner task gets the buckets of some key
    ranges in hash order, chains entries of equal hash, compares their bytes and writes its part of the index to shared
    files. The capacity of a bucket is 1/2^17 of the input at least, so that the directory stays under 2^18 entries.
    """
    return written(_index(docs, capacity), "exact-index")


def exact_survivors(docs: DataFrame, capacity: int = 1 << 20) -> DataFrame:
    """docs -> its columns, one row of each text: that of largest doc_id; of rows that repeat id and text, any one.

    The owners of ``exact_groups`` hand out the kept rows themselves, so whole rows are shuffled once and never joined.
    A null text counts as empty and stays null in a row that is kept; a null doc_id is below all others. Docs' other
    columns stay in a struct until the end, so no name can clash. An empty table gives no rows.
    """
    others = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    packed = docs.select("doc_id", "text", F.struct(*others).alias("doc"), F.col("text").isNull().alias("no_text"))
    kept = _index(packed, capacity, ("doc", "no_text"))
    text = F.when(~F.col("no_text"), F.col("text"))
    return kept.select(*(text.alias(c) if c == "text" else F.col(f"doc.`{c}`").alias(c) for c in docs.columns))


def exact_dedup(docs: DataFrame, capacity: int = 1 << 20) -> DataFrame:
    """docs(doc_id, text) -> doc_id, keep_id, group_size, kept, text_sha256 for every row; the largest doc_id of equal texts is kept.

    A null text counts as empty. A null doc_id is below all others, so it is kept only where no row of its group has an
    id. Rows that repeat an id and its text are all returned, count in group_size, and share one decision. An empty
    table gives no rows. Other columns are not read.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("h"), F.sha2(text, 256).alias("text_sha256"))
    # Texts with copies are stored by themselves, so that Spark sees their size before it chooses the join.
    groups = written(exact_groups(docs, capacity).where("group_size > 1").select("h", "text_sha256", "keep_id", "group_size"), "exact-groups")
    found = rows.join(groups, ["h", "text_sha256"], "left")
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return found.select("doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), F.col("doc_id").eqNullSafe(keep).alias("kept"), "text_sha256")
