"""Runs of periodic words, found by recursive splitting at rare words and a scan of lags."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronofact.llm.chunks import groups

WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Characters of the texts that are looked at together.
CHARS = 4_000_000


def surviving_segments(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray, times: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """[start, end) stretches of ``codes`` in which every word occurs ``times`` times or more, ``length`` words long at least.

    A word that is rarer in its segment is in no run of that many periods inside it, so it splits the segment; the parts
    are counted anew until no word is rare. Segments without a rare word are done; only the others go on.
    """
    done_starts, done_ends = [], []
    while len(starts):
        size = ends - starts
        long = size >= length
        starts, ends, size = starts[long], ends[long], size[long]
        if not len(starts):
            break
        segment = np.repeat(np.arange(len(starts)), size)
        place = np.arange(len(segment)) + np.repeat(starts - (size.cumsum() - size), size)
        _, which, count = np.unique(segment * (codes.max() + 1) + codes[place], return_inverse=True, return_counts=True)
        rare = count[which] < times
        split = np.zeros(len(starts), dtype=bool)
        split[segment[rare]] = True
        done_starts.append(starts[~split])
        done_ends.append(ends[~split])
        kept, segment = place[~rare & split[segment]], segment[~rare & split[segment]]
        if not len(kept):
            break
        new = np.ones(len(kept), dtype=bool)
        new[1:] = (np.diff(kept) > 1) | (np.diff(segment) > 0)
        first = np.flatnonzero(new)
        starts, ends = kept[first], kept[np.append(first[1:], len(kept)) - 1] + 1
    return (np.concatenate(done_starts), np.concatenate(done_ends)) if done_starts else (starts[:0], ends[:0])


def _equal_ahead(x: np.ndarray, at: int, lag: int) -> int:
    """How many places from ``at`` on equal those ``lag`` later."""
    n, step = 0, 64
    while True:
        b = x[at + n + lag : at + n + lag + step]
        a = x[at + n : at + n + len(b)]
        differ = np.flatnonzero(a != b)
        if len(differ):
            return n + int(differ[0])
        n += len(b)
        if len(b) < step:
            return n
        step *= 2


def _equal_behind(x: np.ndarray, at: int, lag: int) -> int:
    """How many places before ``at`` equal those ``lag`` later."""
    n, step = 0, 64
    while n < at:
        low = max(0, at - n - step)
        differ = np.flatnonzero(x[low : at - n] != x[low + lag : at - n + lag])
        if len(differ):
            return n + (at - n - low - 1 - int(differ[-1]))
        n, step = at - low, step * 2
    return n


def scan_lags(x: np.ndarray, power: int, length: int) -> list[tuple[int, int, int]]:
    """(start, length, period) of each run in a segment: a stretch with its smallest period, as long as it gets.

    A run of ``power`` periods q contains ``power`` multiples of q one after the other, whose words are equal. So a lag is
    looked at in multiples of itself only, which is n log n for all lags, and only where ``power`` - 1 neighbours are equal
    the stretch is followed both ways. A stretch that a smaller lag gave already has that period.
    """
    found: dict[tuple[int, int], int] = {}
    need = power - 1
    for q in range(1, len(x) // power + 1):
        grid = x[::q]
        same = grid[:-1] == grid[1:]
        hit = same[: len(same) - need + 1].copy()
        for i in range(1, need):
            hit &= same[i : len(same) - need + 1 + i]
        past = -1
        for k in np.flatnonzero(hit):
            at = int(k) * q
            if at <= past:
                continue
            low = at - _equal_behind(x, at, q)
            high = at + _equal_ahead(x, at, q) + q
            past = high - q
            if high - low >= max(length, power * q):
                found.setdefault((low, high), q)
    return sorted((low, high - low, q) for (low, high), q in found.items())


def text_runs(words: list[list[str]], power: int, length: int) -> list[list[tuple[int, int, int]]]:
    """The runs of each text, by (start, period)."""
    size = np.array([len(w) for w in words], dtype=np.int64)
    out: list[list[tuple[int, int, int]]] = [[] for _ in words]
    if not size.sum():
        return out
    codes = pa.array([w for ws in words for w in ws], pa.large_string()).dictionary_encode().indices.to_numpy().astype(np.int64)
    ends = size.cumsum()
    for a, b in zip(*surviving_segments(codes, ends - size, ends, power, length), strict=True):
        text = int(np.searchsorted(ends, a, side="right"))
        base = int(a - ends[text] + size[text])
        out[text] += [(base + s, n, q) for s, n, q in scan_lags(codes[a:b], power, length)]
    return [sorted(runs, key=lambda r: (r[0], r[2])) for runs in out]


def collapsed(words: list[str], runs: list[tuple[int, int, int]]) -> str:
    """The words that no run holds behind its first period, joined by spaces."""
    if not runs:
        return " ".join(words)
    gone = np.zeros(len(words) + 1, dtype=np.int64)
    for start, n, q in runs:
        gone[start + q] += 1
        gone[start + n] -= 1
    return " ".join([w for w, g in zip(words, gone.cumsum()[:-1].tolist(), strict=True) if not g])


def periodic_runs(docs: DataFrame, power: int = 4, length: int = 6) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_words, runs (array of start, length, period by start, then period), collapsed (text).

    A run is a stretch of words with smallest period q (words q apart are identical) that no neighbouring word extends, of
    ``power`` periods and ``length`` words at least. Words that occur fewer than ``power`` times in their segment split it,
    down to segments without such words; these are scanned at each lag in multiples of the lag. ``collapsed`` keeps a
    run's first period only, and joins what is kept by single spaces.

    Words are kept apart by space, tab and line ends (``[^\\x20\\x09-\\x0D]+``). Whole texts are looked at; a task holds
    some million characters, or one longer text. Rows are independent and nothing is shuffled: null and repeated ids pass
    through. A null or empty text has no words, no runs and an empty collapsed text. An empty table gives no rows; other
    columns of docs are left out, whatever their names.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in groups(batches, CHARS):
            words = [WORD.findall(t) for t in texts]
            runs = text_runs(words, power, length)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, pa.int64()),
                    pa.array([len(w) for w in words], pa.int64()),
                    pa.array([[{"start": s, "length": n, "period": q} for s, n, q in r] for r in runs], pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))),
                    pa.array([collapsed(w, r) for w, r in zip(words, runs, strict=True)], pa.string()),
                ],
                names=["doc_id", "n_words", "runs", "collapsed"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")
