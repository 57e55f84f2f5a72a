"""Best-fit packing by bin completion over the histogram of lengths."""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronofact.llm.chunks import groups
from chronofact.llm.shared import written
from chronofact.llm.tokens import encoder

#: Characters that are encoded together, and chunks of a cache's generation: half of what operator 4 takes, as the
#: pipeline's earlier stages leave memory in the same workers. Only time and memory depend on them.
CHARS, CACHED = 4_000_000, 120_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int, chars: int = CHARS, cached: int = CACHED) -> DataFrame:
    """docs(doc_id, text) -> the pieces of every document: ids with end_id behind them, cut only if over ``capacity``.

    All pieces of a long document have ``capacity`` ids but the first, which has what is left over.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e, end = encoder(tokenizer, cached), np.array([end_id], dtype="<u4")
        for ids, texts in groups(batches, chars):
            flat, at = e.encode(texts)
            out = []
            for doc_id, a, b in zip(ids, [0, *at[:-1]], at, strict=True):
                doc = np.concatenate([flat[a:b], end])
                first = (len(doc) - 1) % capacity + 1
                cuts = [0, *range(first, len(doc) + 1, capacity)]
                out += [(doc_id, k, s, t - s, zlib.crc32(doc[s:t].tobytes())) for k, (s, t) in enumerate(zip(cuts, cuts[1:], strict=False))]
            cols = list(zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, PIECES)


Plan = list[tuple[int, list[tuple[int, int]]]]


def lower_bound(counts: np.ndarray) -> int:
    """A number of bins that no packing of counts[length] pieces goes below.

    For each threshold up to half a bin: pieces that leave less than it have a bin each, pieces over half a bin have one
    each, and the pieces from the threshold on up to half a bin fill what room those leave, then further bins.
    """
    capacity = len(counts) - 1
    number, mass = np.cumsum(counts), np.cumsum(counts * np.arange(capacity + 1))
    half = capacity // 2
    k = np.arange(half + 1)
    alone = number[-1] - number[capacity - k]
    large, large_mass = number[capacity - k] - number[half], mass[capacity - k] - mass[half]
    small = mass[half] - mass[np.maximum(k - 1, 0)]
    further = -(-(small - (large * capacity - large_mass)) // capacity)
    return int(max(-(-mass[-1] // capacity), (alone + large + np.maximum(further, 0)).max()))


def best_fit(counts: np.ndarray) -> tuple[int, Plan]:
    """Best-fit decreasing over the histogram: each length goes where least room is left that holds it.

    Bins that were filled alike are handled as one group, so there are about as many steps as lengths.
    """
    capacity, bins = len(counts) - 1, 0
    rooms: list[int] = []
    groups: dict[int, list[tuple[int, tuple]]] = {}

    def add(room: int, n: int, filling: tuple) -> None:
        if room not in groups:
            insort(rooms, room)
            groups[room] = []
        groups[room].append((n, filling))

    for length in np.flatnonzero(counts)[::-1].tolist():
        left = int(counts[length])
        while left:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                n, filling = groups[room].pop()
                if not groups[room]:
                    del groups[room], rooms[at]
            else:
                room, filling = capacity, ()
                n = -(-left // (capacity // length))
                bins += n
            each = room // length
            full = min(n, left // each)
            if full:
                add(room - each * length, full, (*filling, (length, each)))
                left -= full * each
            if full < n and left:
                add(room - left * length, 1, (*filling, (length, left)))
                left, full = 0, full + 1
            if full < n:
                add(room, n - full, filling)
    return bins, [(n, list(filling)) for group in groups.values() for n, filling in group]


def fillings(counts: np.ndarray, room: int, most_waste: int, steps: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Undominated fillings of ``room`` that waste ``most_waste`` at most: (waste, [(length, how many)]), least waste first.

    A filling is dominated if a piece that is there fits beside it, or could take the place of one of its pieces or of
    two: what it leaves over would then go where they were. Lengths are tried from the largest, most pieces first;
    ``steps`` bounds the enumeration.
    """
    there = np.flatnonzero(counts[: room + 1])
    mass = np.concatenate([[0], np.cumsum(there * counts[there])])
    out, seen = [], 0

    def free(low: int, high: int, used: dict[int, int]) -> bool:
        """Whether a piece of a length from low to high is left."""
        i = int(np.searchsorted(there, low))
        while i < len(there) and there[i] <= high:
            if counts[there[i]] > used.get(int(there[i]), 0):
                return True
            i += 1
        return False

    def dominated(waste: int, used: dict[int, int]) -> bool:
        if waste and free(1, waste, used):
            return True
        lengths = list(used)
        if waste and any(free(x + 1, x + waste, used) for x in lengths):
            return True
        both = [x + y for i, x in enumerate(lengths) for y in lengths[i:] if x != y or used[x] > 1]
        return any(free(x, x + waste, used) for x in both)

    def visit(top: int, left: int, used: dict[int, int]) -> None:
        nonlocal seen
        seen += 1
        if seen > steps:
            return
        top = int(np.searchsorted(there[:top], left, side="right"))
        if left - mass[top] > most_waste:
            return
        if top == 0:
            if not dominated(left, used):
                out.append((left, sorted(used.items(), reverse=True)))
            return
        length = int(there[top - 1])
        for k in range(min(int(counts[length]), left // length), -1, -1):
            visit(top - 1, left - k * length, {**used, length: k} if k else used)

    visit(len(there), room, {})
    return sorted(out, key=lambda x: x[0])


def plan_bins(histogram: dict[int, int], capacity: int, nodes: int = 400, steps: int = 400) -> Plan:
    """Lengths with their numbers -> (number of bins, filling as (length, how many)) patterns that use up everything.

    Bin completion: a node of the search takes the largest length left, and branches over the undominated fillings
    around it and over how many bins are filled so (all numbers if few, else all that can be, half of them, one). At
    each node best-fit decreasing packs what is left, and the best packing seen is the incumbent; a branch ends where
    its waste, or the lower bound of what is left, leaves no packing of fewer bins. The search ends when the incumbent
    meets the lower bound, when all is searched (both: optimal), or after ``nodes`` nodes, of ``steps`` steps of
    enumeration each; then the incumbent, never worse than best-fit decreasing, stands.
    """
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in histogram.items():
        counts[length] = n
    total = int((counts * np.arange(capacity + 1)).sum())
    bound, (best, plan), seen = lower_bound(counts), best_fit(counts), 0

    def visit(left: np.ndarray, used: int, waste: int, done: Plan) -> None:
        nonlocal best, plan, seen
        seen += 1
        more, rest = best_fit(left) if done else (best, plan)
        if used + more < best:
            best, plan = used + more, done + rest
        if best == bound or seen >= nodes or not left.any() or used + lower_bound(left) >= best:
            return
        length = int(np.flatnonzero(left)[-1])
        left[length] -= 1
        found = fillings(left, capacity - length, (best - 1) * capacity - total - waste, steps)
        left[length] += 1
        for w, rest in found:
            filling = dict(rest)
            filling[length] = filling.get(length, 0) + 1
            most = min(int(left[x]) // k for x, k in filling.items())
            for times in range(most, 0, -1) if most <= 4 else (most, most // 2, 1):
                if waste + times * w > (best - 1) * capacity - total:
                    continue
                after = left.copy()
                for x, k in filling.items():
                    after[x] -= times * k
                visit(after, used + times, waste + times * w, [*done, (times, sorted(filling.items(), reverse=True))])
                if best == bound or seen >= nodes:
                    return

    if best > bound:
        visit(counts, 0, 0, [])
    return plan


def slots(plan: Plan) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, how many in a bin, first bin, offset): which pieces of a length go where."""
    out, used, first = [], {}, 0
    for times, filling in plan:
        offset = 0
        for length, k in filling:
            out.append((length, used.get(length, 0), k, first, offset))
            used[length] = used.get(length, 0) + times * k
            offset += length * k
        first += times
    return out


def pack(pieces: DataFrame, capacity: int, nodes: int = 400) -> DataFrame:
    """pieces(..., length) -> with sequence_id and offset; lengths must be 1 to ``capacity``.

    Only the histogram, ``capacity`` rows at most, reaches the driver, where the bins are planned. Pieces are numbered
    within their length by two steps, inside a stored partition and then by partition sums, so no length with very many
    pieces meets in one task; each piece then looks its number up in the plan, whose size follows ``capacity`` alone.
    """
    stored = written(pieces.withColumn("row", F.monotonically_increasing_id()), "pieces").withColumn("part", F.shiftright("row", 33))
    sums = stored.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = sums.select("length", "part", (F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).alias("before"))
    histogram = {r["length"]: r["n"] for r in sums.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    table = np.array(slots(plan_bins(histogram, capacity, nodes)), dtype=np.int64).reshape(-1, 5)
    table = table[np.lexsort((table[:, 1], table[:, 0]))]
    ranked = stored.withColumn("rank", F.row_number().over(Window.partitionBy("length", "part").orderBy("row")) - 1).join(before, ["length", "part"]).withColumn("rank", F.col("rank") + F.col("before"))
    names = pieces.columns

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Sorted by length and first rank; a rank never reaches 2^48.
        keys = (table[:, 0] << 48) + table[:, 1]
        for b in batches:
            length, rank = (b.column(b.schema.get_field_index(c)).to_numpy() for c in ("length", "rank"))
            s = table[np.searchsorted(keys, (length << 48) + rank, side="right") - 1]
            q, r = np.divmod(rank - s[:, 1], s[:, 2])
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in names), pa.array(s[:, 3] + q), pa.array(s[:, 4] + r * length)], names=[*names, "sequence_id", "offset"])

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    return ranked.select(*names, "rank").mapInArrow(place, ddl + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, nodes: int = 400, chars: int = CHARS, cached: int = CACHED) -> DataFrame:
    """docs(doc_id, text) -> one row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is its end id alone. Rows are packed as they come: null and repeated doc_ids are rows of their
    own. Ties between pieces of a length go by storage order, which affects ids of sequences alone. An empty table
    gives no rows.
    """
    return pack(token_pieces(docs, tokenizer, capacity, end_id, chars, cached), capacity, nodes)
