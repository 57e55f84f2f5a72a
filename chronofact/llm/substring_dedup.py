"""Substring dedup: seed and extend on winnowed anchors."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronofact.llm.shared import written

#: Odd multipliers of the two polynomial hashes over words.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
WORD_CACHE = 500_000


class _Words(dict):
    """Word -> its 128-bit hash as bytes; cleared when it has grown to its bound."""

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= WORD_CACHE:
            self.clear()
        self[word] = v = xxhash.xxh3_128_digest(word)
        return v


class Hasher:
    """Hashes of word windows of one document, each from two differences of prefix sums modulo 2^64."""

    words = _Words()
    powers: tuple = ()

    def __init__(self, words: list[bytes]) -> None:
        n = len(words)
        self._grow(n + 1)
        h = np.frombuffer(b"".join(map(self.words.__getitem__, words)), dtype="<u8").reshape(-1, 2)
        self.sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(h[:, i] * self.powers[i][0][:n], dtype=np.uint64)]) for i in (0, 1)]

    @classmethod
    def _grow(cls, n: int) -> None:
        if cls.powers and len(cls.powers[0][0]) >= n:
            return
        made = []
        for base in BASES:
            both = []
            for b in (base, pow(base, -1, 1 << 64)):
                p = np.full(2 * n, b, dtype=np.uint64)
                p[0] = 1
                both.append(np.multiply.accumulate(p))
            made.append(both)
        cls.powers = tuple(made)

    def of(self, start: np.ndarray, end: np.ndarray, which: int) -> np.ndarray:
        """Hash ``which`` (0 or 1) of the words [start, end)."""
        x = (self.sums[which][end] - self.sums[which][start]) * self.powers[which][1][start]
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(32))


def anchors(words: list[bytes], window: int, seed: int) -> tuple[np.ndarray, ...]:
    """Winnowing: each window of words picks the seed (run of ``seed`` words) of least hash in it, the first if equal.

    -> for each maximal run of windows with the same pick: first window, number of windows, the pick's hash, and the
    hash of all words that the run covers. The pick depends on the window's words alone, so equal windows pick equal
    seeds at equal places.
    """
    h = Hasher(words)
    at = np.arange(len(words) - seed + 1)
    g = h.of(at, at + seed, 0)
    span = window - seed + 1
    pick = np.lib.stride_tricks.sliding_window_view(g, span).argmin(axis=1) + np.arange(len(g) - span + 1)
    first = np.flatnonzero(np.concatenate([[True], pick[1:] != pick[:-1]]))
    count = np.diff(np.append(first, len(pick)))
    return first, count, g[pick[first]].view(np.int64), h.of(first, first + count + window - 1, 1).view(np.int64)


def _split(text: str | None) -> list[bytes]:
    """Words end at ASCII white space (20, 09-0D) only, which is what bytes.split() takes as white space."""
    return (text or "").encode().split()


SEEDS = pa.schema([("doc_id", pa.int64()), ("tag", pa.int32()), ("first", pa.int32()), ("count", pa.int32()), ("anchor", pa.int64()), ("extent", pa.int64())])
#: Seeds of one output batch.
ROWS = 200_000


def _seeds(batches: Iterator[pa.RecordBatch], window: int, seed: int) -> Iterator[pa.RecordBatch]:
    def batch(found: list) -> pa.RecordBatch:
        cols = [np.concatenate([x[i] for x in found]) for i in range(6)]
        return pa.RecordBatch.from_arrays([pa.array(c).cast(f.type) for c, f in zip(cols, SEEDS, strict=True)], schema=SEEDS)

    found, size = [], 0
    for b in batches:
        for doc_id, text in zip(b.column(0), b.column(1), strict=True):
            words = _split(text.as_py())
            if len(words) < window:
                continue
            first, count, anchor, extent = anchors(words, window, seed)
            tag = _tag(text.as_py())
            found.append((np.full(len(first), doc_id.as_py()), np.full(len(first), tag), first, count, anchor, extent))
            size += len(first)
            if size >= ROWS:
                yield batch(found)
                found, size = [], 0
    if found:
        yield batch(found)


def _tag(text: str | None) -> int:
    """Tells rows apart that share a doc_id but not the text."""
    return zlib.crc32((text or "").encode()) - (1 << 31)


def _windows(groups: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """(doc_id, tag, text, runs) -> doc_id, tag, start, w0, w1: the windows of the runs, with 128-bit hashes."""
    for b in groups:
        for doc_id, tag, text, runs in zip(*(c.to_pylist() for c in b.columns), strict=True):
            h = Hasher(_split(text))
            start = np.concatenate([np.arange(r["first"], r["first"] + r["count"]) for r in runs])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(start), doc_id), pa.int64()),
                    pa.array(np.full(len(start), tag), pa.int32()),
                    pa.array(start, pa.int32()),
                    pa.array(h.of(start, start + window, 0).view(np.int64)),
                    pa.array(h.of(start, start + window, 1).view(np.int64)),
                ],
                names=["doc_id", "tag", "start", "w0", "w1"],
            )


def _cut(batches: Iterator[pd.DataFrame], window: int) -> Iterator[pd.DataFrame]:
    """Merges the runs of each document into its maximal repeats, removes their words and digests what is left."""
    for b in batches:
        out = []
        for doc_id, text, runs in zip(b["doc_id"], b["text"], b["runs"], strict=True):
            words = _split(text)
            gone = np.zeros(len(words) + 1, dtype=np.int64)
            for r in [] if runs is None else runs:
                gone[r["first"]] += 1
                gone[min(r["first"] + r["count"] + window - 1, len(words))] -= 1
            gone = gone.cumsum()[:-1] > 0
            kept = [w for w, g in zip(words, gone, strict=True) if not g] if gone.any() else words
            out.append((doc_id, len(words), int(gone.sum()), b" ".join(kept).decode()))
        yield pd.DataFrame(out, columns=["doc_id", "n_words", "n_removed", "kept"]).astype({"doc_id": "Int64"})


def repeats(docs: DataFrame, window: int = 50, seed: int | None = None) -> DataFrame:
    """docs(doc_id, text) -> doc_id, tag, first, count: runs of windows whose words also start in a smaller doc_id.

    Seed: every window picks an anchor; windows with the same pick form one seed with the extent of words around it.
    Extents that meet the same extent of a smaller document are repeats as a whole. Extend: where one anchor has several
    extents, the smallest document of each extent stretches it both ways, word by word, and each window it reaches is
    matched with those of the anchor's other extents. A window thus meets all its equals without pairs of documents,
    because minima are folded ahead of the shuffles.
    """
    seed = seed or (window + 1) // 2
    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # Seeds are few (2 in window - seed + 2 words), so they are written once and read several times.
    found = written(rows.mapInArrow(lambda it: _seeds(it, window, seed), "doc_id long, tag int, first int, count int, anchor long, extent long"), "seeds")
    extents = found.groupBy("anchor", "extent").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"))
    several = extents.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor", F.lit(True).alias("several"))
    # Extents that only one document has, at an anchor without others, repeat nothing and go no further.
    shared = written(extents.join(several, "anchor", "left").where("several or least < most").select("anchor", "extent", "least", F.coalesce("several", F.lit(False)).alias("several")), "extents")
    marks = written(found.join(shared, ["anchor", "extent"]).where("doc_id > least or several").select("doc_id", "tag", "first", "count", (F.col("doc_id") > F.col("least")).alias("whole")), "marks")
    whole = marks.where("whole").select("doc_id", "tag", "first", "count")
    stretch = marks.where("not whole").groupBy("doc_id", "tag").agg(F.collect_list(F.struct("first", "count")).alias("runs"))
    texts = rows.select("doc_id", tag_of("text").alias("tag"), "text")
    windows = written(texts.join(stretch, ["doc_id", "tag"]).select("doc_id", "tag", "text", "runs").mapInArrow(lambda it: _windows(it, window), "doc_id long, tag int, start int, w0 long, w1 long"), "windows")
    lowest = windows.groupBy("w0", "w1").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most")
    single = windows.join(lowest, ["w0", "w1"]).where("doc_id > least").select("doc_id", "tag", F.col("start").alias("first"), F.lit(1).alias("count"))
    return whole.union(single)


def tag_of(text: str):
    """The same tag in Spark."""
    return (F.crc32(F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8")) - F.lit(1 << 31)).cast("int")


def substring_dedup(docs: DataFrame, window: int = 50, seed: int | None = None) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_words, n_removed, kept: words left after removing those of repeated windows.

    A null text has no words; texts under ``window`` words lose none. A null doc_id is no smaller document and loses
    nothing. Rows that share a doc_id are one document as to order: they never remove each other's words; rows that
    repeat id and text get the same result each. Windows may overlap and repeat within a document, which alone removes
    nothing. An empty table gives no rows.
    """
    runs = repeats(docs, window, seed).groupBy("doc_id", "tag").agg(F.collect_list(F.struct("first", "count")).alias("runs"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), tag_of("text").alias("tag"), "text")
    both = rows.join(runs, ["doc_id", "tag"], "left").select("doc_id", "text", "runs")
    return both.mapInPandas(lambda it: _cut(it, window), "doc_id long, n_words long, n_removed long, kept string")
