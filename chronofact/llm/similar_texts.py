"""SimHash near-dedup by similarity: wide fingerprints meet under choices of blocks; exact Jaccard verifies the pairs."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronofact.llm.components import connected_components
from chronofact.llm.shared import emptied, written

SEED, GOLDEN = 42, 0x9E3779B97F4A7C15
WORD_CACHE = 60_000
#: A fingerprint has WORDS words of 64 bits; its first BLOCKS bytes are the blocks.
WORDS, BLOCKS = 8, 32
#: Choices of three blocks in which any two of the blocks 1 to 31 stand together once. Two texts of Jaccard 0.8 differ
#: in some 15 % of the bits, so they agree in one choice with chance 0.02 and in one of the 155 at least with 0.95; texts
#: of Jaccard 0.85 do with 0.997.
CHOICES = np.array([(a, b, a ^ b) for a in range(1, BLOCKS) for b in range(a + 1, BLOCKS) if a ^ b > b])
#: Choices that are tried first, so that most groups are known before all choices are.
FIRST = 8
#: Candidates that differ in more bits (of 512) are not looked at: texts of Jaccard 0.8 differ in 78, give or take 8.
FAR = 92
#: Buckets of this size or less compare all their pairs across groups in the second round; larger ones go by pivots.
SMALL, PIVOTS = 8, 8
#: Rows of a batch, and shingles whose bits are counted in one byte.
ROWS, COUNTED = 256, 255
FP = [f"f{i}" for i in range(WORDS)]


class _Words(dict):
    """Word -> its XXH64 as bytes; cleared when it has grown to its bound."""

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= WORD_CACHE:
            self.clear()
        self[word] = v = xxhash.xxh64_digest(word, SEED)
        return v


_words = _Words()


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values evenly (the finalizer of SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, words_in_shingle: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word shingles; a text of fewer words (or none) is one shingle."""
    words = (text or "").encode().lower().split()
    if len(words) <= words_in_shingle:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], dtype=np.uint64)
    h = np.frombuffer(b"".join(map(_words.__getitem__, words)), dtype="<u8")
    n = len(h) - words_in_shingle + 1
    total = np.zeros(n, dtype=np.uint64)
    for i in range(words_in_shingle):
        # Each place in a shingle has an odd factor of its own.
        total += h[i : i + n] * np.uint64((2 * i + 1) * GOLDEN % (1 << 64))
    s = np.sort(mixed(total))
    return s[np.concatenate([[True], s[1:] != s[:-1]])]


def wide_fingerprint(hashes: np.ndarray) -> np.ndarray:
    """The SimHash of distinct shingles, as bytes: a bit is 1 if it is set in over half of the shingles' hashes."""
    ones = np.zeros(64 * WORDS, dtype=np.int64)
    for start in range(0, len(hashes), 16 * COUNTED):
        part = hashes[start : start + 16 * COUNTED, None]
        bits = np.unpackbits(mixed(part + np.arange(WORDS, dtype=np.uint64) * np.uint64(GOLDEN)).view(np.uint8), axis=1)
        for at in range(0, len(bits), COUNTED):
            ones += np.add.reduce(bits[at : at + COUNTED], axis=0, dtype=np.uint8)
    return np.packbits(2 * ones > len(hashes))


def sketches(rows: DataFrame, words_in_shingle: int = 5) -> DataFrame:
    """rows(row, text) -> row, n (distinct shingles), same (128-bit hash of the shingle set), the fingerprint's words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                b = whole.slice(at, ROWS)
                n, same, fps = [], [], np.zeros((b.num_rows, 8 * WORDS), dtype=np.uint8)
                for i, x in enumerate(b.column(1)):
                    s = shingles(x.as_py(), words_in_shingle)
                    n.append(len(s))
                    same.append(xxhash.xxh3_128_digest(s.tobytes()))
                    fps[i] = wide_fingerprint(s)
                words = fps.view(np.int64)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int32()), pa.array(same, pa.binary()), *(pa.array(words[:, i]) for i in range(WORDS))], names=["row", "n", "same", *FP])
        _words.clear()
        pa.default_memory_pool().release_unused()

    return rows.select("row", "text").mapInArrow(run, f"row long, n int, same binary, {', '.join(f + ' long' for f in FP)}")


def block_keys(classes: DataFrame, choices: np.ndarray) -> DataFrame:
    """classes(row, group, fingerprint's words) -> (row, group, key) for each choice of blocks; the key holds the choice and its blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                b = whole.slice(at, ROWS)
                fps = np.stack([b.column(2 + i).to_numpy() for i in range(WORDS)], axis=1).view(np.uint8)
                key = np.arange(len(choices)) << 24
                for i in range(3):
                    key = key | fps[:, choices[:, i]].astype(np.int64) << 8 * i
                row, group = (pa.array(np.repeat(b.column(i).to_numpy(), len(choices))) for i in range(2))
                yield pa.RecordBatch.from_arrays([row, group, pa.array(key.ravel())], names=["row", "group", "key"])

    return classes.select("row", "group", *FP).mapInArrow(run, "row long, group long, key long")


def prefix_keys(rows: DataFrame, percent: int, words_in_shingle: int) -> DataFrame:
    """rows(row, group, text) -> (row, group, key) for the least hashes of each shingle set, so many that two sets of the
    similarity share one: n less the least overlap with an equally large set, and one more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                b = whole.slice(at, ROWS)
                sets = [shingles(x.as_py(), words_in_shingle) for x in b.column(2)]
                least = [s[: len(s) - -(-percent * len(s) // 100) + 1] for s in sets]
                n = [len(x) for x in least]
                row, group = (pa.array(np.repeat(b.column(i).to_numpy(), n)) for i in range(2))
                yield pa.RecordBatch.from_arrays([row, group, pa.array(np.concatenate(least).view(np.int64))], names=["row", "group", "key"])
        _words.clear()

    return rows.select("row", "group", "text").mapInArrow(run, "row long, group long, key long")


def buckets(keyed: DataFrame) -> DataFrame:
    """keyed(key, row, group, ...) -> (key, row, group, ..., size, p) of the keys that rows of several groups share; size counts
    a key's rows, p is its least row and that row's group. Keys are shuffled once, by windows; they carry no sketches but for
    the few rows that are compared by pivots."""
    w = Window.partitionBy("key")
    least = F.min(F.struct("row", "group")).over(w)
    sized = keyed.select("*", F.count("*").over(w).alias("size"), least.alias("p"), F.min("group").over(w).alias("_a"), F.max("group").over(w).alias("_b"))
    return sized.where("_a <> _b").drop("_a", "_b")


def untried(pairs: DataFrame, tried: list[DataFrame]) -> DataFrame:
    """The different pairs (u, v) that are in no table of ``tried``: by one aggregation, as Spark would put an anti-join
    below ``distinct`` and make a row of each time that a pair meets."""
    marked = [x.withColumn("_old", F.lit(x is not pairs)) for x in (pairs, *tried)]
    return reduce(DataFrame.union, marked).groupBy("u", "v").agg(F.max("_old").alias("_old")).where("not _old").select("u", "v")


def likely_pairs(pairs: DataFrame, lean: DataFrame, percent: int, far: int | None) -> DataFrame:
    """The pairs (u, v) whose sketches, looked up in lean(row, n, fingerprint's words), may be of similar texts."""
    u, v = (lean.select(F.col("row").alias(e), F.struct("n", *FP).alias(f"_s{e}")) for e in "uv")
    return pairs.join(v, "v").join(u, "u").where(_likely("_su", "_sv", percent, far)).select("u", "v")


def pivot_pairs(held: DataFrame, pivots: int, percent: int, far: int | None) -> tuple[DataFrame, DataFrame]:
    """held(key, row, group, s) with sketches s -> (the pairs (u, v) of each key's rows with its pivots, the pivots (key, row));
    pivots are the least rows of each of ``pivots`` shares of a key's rows.

    The join itself looks at the sketches, so that it makes no row of a pair that is of one group, unlikely, or known to
    meet under an earlier choice: there it is made too, as each key's rows go on until all of them have met.
    """
    least = held.groupBy("key", F.pmod(F.xxhash64("row"), F.lit(pivots)).alias("_s")).agg(F.min(F.struct("row", "group", "s")).alias("p"))
    met = held.join(least, "key").where("p.group <> group").where(_likely("s", "p.s", percent, far))
    if far is not None:
        met = met.where(F.shiftright("key", 24) == _first_choice("s", "p.s"))
    return met.select(F.least("row", "p.row").alias("u"), F.greatest("row", "p.row").alias("v")), least.select("key", F.col("p.row").alias("row"))


def grouped_by(rows: DataFrame, parts: DataFrame) -> DataFrame:
    """rows(row, ...) with the column group: the row's component, or the row where it has none."""
    named = rows.join(parts.select(F.col("node").alias("row"), F.col("component").alias("group")), "row", "left")
    return named.withColumn("group", F.coalesce("group", "row"))


def grown(parts: DataFrame, links: DataFrame) -> DataFrame:
    """Components (node, component) after some more links: only links between different components are contracted."""
    names = [parts.select(F.col("node").alias(e), F.col("component").alias(f"_{e}")) for e in "uv"]
    named = links.join(names[0], "u", "left").join(names[1], "v", "left").select(F.coalesce("_u", "u").alias("u"), F.coalesce("_v", "v").alias("v"))
    new = written(named.where("u <> v").distinct(), "new_links")
    if new.isEmpty():
        emptied(new)
        return parts
    joined = connected_components(new)
    far = joined.select(F.col("node").alias("component"), F.col("component").alias("_far"))
    known = parts.join(far, "component", "left").select("node", F.coalesce("_far", "component").alias("component"))
    single = joined.join(parts.select("node"), "node", "left_anti")
    after = written(known.unionByName(single), "components")
    for table in (new, joined, parts):
        emptied(table)
    return after


def shingle_sets(rows: DataFrame, words_in_shingle: int = 5) -> DataFrame:
    """rows(row, text) -> row, hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                b = whole.slice(at, ROWS)
                sets = [shingles(x.as_py(), words_in_shingle) for x in b.column(1)]
                flat = pa.array(np.concatenate(sets).view(np.int64))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array([0, *accumulate(map(len, sets))], pa.int32()), flat)], names=["row", "hashes"])
        _words.clear()
        pa.default_memory_pool().release_unused()

    return rows.select("row", "text").mapInArrow(run, "row long, hashes array<long>")


def _likely(a: str, b: str, percent: int, far: int | None) -> Column:
    """Whether two sketches, structs of n and the fingerprint's words, may be of similar texts: by size for certain, and by
    the distance of fingerprints unless ``far`` is None."""
    sizes = F.expr(f"100 * {a}.n >= {percent} * {b}.n and 100 * {b}.n >= {percent} * {a}.n")
    if far is None:
        return sizes
    return (sum((F.bit_count(F.col(f"{a}.{f}").bitwiseXOR(F.col(f"{b}.{f}"))) for f in FP), F.lit(0)) <= far) & sizes


def _first_choice(a: str, b: str) -> Column:
    """The number of the first of the CHOICES in whose blocks two sketches agree, null if they agree in none."""
    differ = [F.col(f"{a}.{f}").bitwiseXOR(F.col(f"{b}.{f}")) for f in FP[: BLOCKS // 8]]
    agree = sum((F.when(F.shiftright(differ[i // 8], i % 8 * 8).bitwiseAND(255) == 0, 1 << i).otherwise(0) for i in range(1, BLOCKS)), F.lit(0).cast("long"))
    choices = F.lit([sum(1 << i for i in choice) for choice in CHOICES.tolist()]).cast("array<long>")
    # A function of one element, so that the blocks are compared once and not once a choice.
    first = F.transform(F.array(agree), lambda x: F.array_position(F.transform(choices, lambda c: x.bitwiseAND(c) == c), F.lit(True)))[0]
    return F.when(first > 0, first - 1)


def _links(pairs: DataFrame, held: DataFrame, percent: int) -> DataFrame:
    """The pairs whose whole shingle sets have a Jaccard similarity of ``percent`` or more."""
    both = pairs.join(held.select(F.col("row").alias("u"), F.col("hashes").alias("_hu")), "u").join(held.select(F.col("row").alias("v"), F.col("hashes").alias("_hv")), "v")
    same = both.select("u", "v", F.size(F.array_intersect("_hu", "_hv")).alias("_i"), (F.size("_hu") + F.size("_hv")).alias("_t"))
    return same.where(f"100 * _i >= {percent} * (_t - _i)").select("u", "v")


def similar_groups(rows: DataFrame, percent: int = 80, words_in_shingle: int = 5, exact: bool = False) -> DataFrame:
    """rows(row, text), row unique -> (node, component) of rows in groups; rows like no other are absent.

    Two texts are linked if the Jaccard similarity of their shingle sets is ``percent`` or more, computed over the whole
    sets. Texts of equal sets are one class, with stars to its least row. Classes meet where their fingerprints agree in
    a choice of blocks (see CHOICES for the chance), and the distance of whole fingerprints is checked before any set is
    read. A bucket's rows are first compared with its least row: under the FIRST choices, which tell most groups, then
    under all choices, where only buckets that hold several groups count. While they do, a small bucket compares all its
    pairs across groups, and a larger one is worked off by pivots, eight times as many each round, compared with rows of
    other groups only; these carry their sketches, so that only likely pairs become rows, each under its first choice. So a large group of near copies becomes one after a round or two instead of forming all its pairs,
    and a bucket is done when its rows are in one group or all pairs across groups are compared. Scratch tables are
    emptied once nothing reads them any more.

    Fingerprints miss some links (see CHOICES and FAR). With ``exact`` no link is lost: groups then also meet under the
    least hashes of their whole shingle sets, of which any two sets of the similarity share one, and no distance of
    fingerprints is asked. That makes a key of every fifth shingle, so it costs many times as much.
    """
    sketch = written(sketches(rows, words_in_shingle), "sketches")
    grouped = sketch.groupBy("same").agg(F.min(F.struct("row", "n", *FP)).alias("c"), F.count("*").alias("size"))
    # As many parts as the texts have: each row becomes 155 keys.
    classes = written(grouped.select("same", "size", "c.*").repartition(rows.rdd.getNumPartitions(), "row"), "classes")
    copies = classes.where("size > 1").select("same", F.col("row").alias("u"))
    links = [written(sketch.join(copies, "same").where("u <> row").select("u", F.col("row").alias("v")), "links")]
    emptied(sketch)
    lean = classes.drop("same", "size")
    left = written(buckets(block_keys(lean.withColumn("group", F.col("row")), CHOICES[:FIRST])), "buckets")
    tried, sets, parts, first, pivots, far = [], [], None, True, 1, FAR
    while True:
        going = left.where(f"size > {SMALL}").drop("size", "p")
        if pivots == 1:
            pairs = left.where("p.group <> group").select(F.least("row", "p.row").alias("u"), F.greatest("row", "p.row").alias("v"))
        else:
            few = left.where(f"size <= {SMALL}")
            a = few.select("key", F.col("row").alias("u"), F.col("group").alias("_a"))
            b = few.select("key", F.col("row").alias("v"), F.col("group").alias("_b"))
            pairs = a.join(b, "key").where("u < v and _a <> _b").select("u", "v")
        # A pair that meets under many keys is looked at once: pairs are made different before sketches are read.
        pairs = likely_pairs(untried(pairs, tried), lean, percent, far)
        if pivots > 1:
            if "s" not in going.columns:
                # Sketches are looked up once, and go along with the rows from here on.
                going = written(going.join(lean.select("row", F.struct("n", *FP).alias("s")), "row"), "going")
            met, least = pivot_pairs(going, pivots, percent, far)
            pairs = untried(pairs.union(met), tried)
        pairs = written(pairs, "pairs")
        if pivots <= PIVOTS:
            # Sets are read for the rows of the pairs up to the second round under all choices, and then for all rows that go on.
            wanted = pairs.select(F.col("u").alias("row")).union(pairs.select("v"))
            wanted = wanted if pivots == 1 else wanted.union(going.select("row"))
            wanted = wanted.distinct()
            if sets:
                wanted = wanted.join(reduce(DataFrame.union, [x.select("row") for x in sets]), "row", "left_anti")
            # Stored, so that Spark sees how few rows are wanted and sends these to the texts, not the texts through a shuffle.
            wanted = written(wanted, "wanted")
            sets.append(written(shingle_sets(rows.select("row", "text").join(wanted, "row", "left_semi"), words_in_shingle), "sets"))
            emptied(wanted)
        tried.append(pairs)
        links.append(written(_links(pairs, reduce(DataFrame.union, sets), percent), "links"))
        parts = connected_components(reduce(DataFrame.union, links)) if parts is None else grown(parts, links[-1])
        if first:
            after = written(buckets(block_keys(grouped_by(lean, parts), CHOICES)), "buckets")
        else:
            # Rows that served as pivots are compared with the whole bucket; the others go on while their groups differ.
            rest = left.where("row <> p.row").drop("size", "p") if pivots == 1 else going.join(least, ["key", "row"], "left_anti")
            after = written(buckets(grouped_by(rest.drop("group"), parts)), "buckets")
            if pivots == PIVOTS:
                emptied(going)
            pivots *= PIVOTS
        emptied(left)
        left, first = after, False
        if exact and far is not None and left.isEmpty():
            emptied(left)
            texts = grouped_by(lean.select("row"), parts).join(rows.select("row", "text"), "row")
            left, pivots, far = written(buckets(prefix_keys(texts, percent, words_in_shingle)), "buckets"), 1, None
        if left.isEmpty():
            for table in (classes, left, *tried, *sets, *links):
                emptied(table)
            return parts
