"""The pipeline's near-dedup stage against brute-force Jaccard."""

import random
import re

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from chronofact.llm.similar_texts import CHOICES, FAR, FP, block_keys, buckets, grown, pivot_pairs, shingles, similar_groups, sketches, untried, wide_fingerprint


def brute_sets(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def brute_kept(rows):
    sets, comp = [(i, brute_sets(t)) for i, t in rows], {i: i for i, _ in rows}
    links = [(i, j) for i, a in sets for j, b in sets if i < j and len(a & b) >= 0.8 * len(a | b)]
    for _ in range(len(rows)):
        old = dict(comp)
        for i, j in links:
            comp[i] = comp[j] = min(comp[i], comp[j])
        if old == comp:
            break
    return {i for i in comp if comp[i] == i}, links


def edited(rng, words, edits):
    out = list(words)
    for at in rng.sample(range(len(out)), edits):
        out[at] = f"new{rng.random()}"
    return out


def test_near_copies_by_jaccard(spark):
    rng = random.Random(3)
    rows = []
    for _ in range(25):
        base = [f"w{rng.randint(0, 9999)}" for _ in range(rng.randint(60, 400))]
        for e in (0, 1, 2, 4, len(base) // 50, len(base) // 40, len(base) // 15):
            rows.append((len(rows), " ".join(edited(rng, base, e))))
    big = [f"g{i}" for i in range(200)]
    rows += [(len(rows) + k, " ".join(edited(rng, big, rng.randint(0, 2)))) for k in range(60)]
    line = "one line again and again and on "
    rows += [(1000, line * 40 + "tail a b c d"), (1001, line * 9 + "tail a b c d"), (1002, ""), (1003, " \t"), (1004, "too few"), (1005, "Too  FEW")]
    kept, links = brute_kept(rows)
    docs = spark.createDataFrame([*rows, (None, rows[0][1]), (None, "alone here"), (None, "alone here"), (7, rows[7][1]), (7, "a text that no other row has at all")], "doc_id long, text string")
    got = [r["doc_id"] for r in corpus_pipeline.drop_similar(spark, docs, "").collect()]
    assert dict(corpus_pipeline.STAGES)["simhash_near_dedup"] is corpus_pipeline.drop_similar
    assert len(links) > 500 and len(kept) < 150
    # Every row that stays by brute force stays, and of those that go the keys of fingerprints find 0.95 at least.
    ids = [i for i in got if i is not None]
    assert not {*kept, 7} - {*ids} and ids.count(7) == 2 and got.count(None) == 1
    assert len({*ids} - {*kept, 7}) <= 0.05 * (len(rows) - len(kept))
    assert corpus_pipeline.drop_similar(spark, docs.limit(0), "").count() == 0


def test_the_exact_way_loses_no_link(spark):
    """All groups of brute force, those that no choice of blocks finds too."""
    rng = random.Random(11)
    rows = []
    for _ in range(30):
        base = [f"w{rng.randint(0, 9999)}" for _ in range(rng.randint(40, 200))]
        for e in (0, len(base) // 50, len(base) // 46, len(base) // 44, len(base) // 42, len(base) // 30):
            rows.append((len(rows), " ".join(edited(rng, base, e))))
    big = [f"g{i}" for i in range(120)]
    rows += [(len(rows) + k, " ".join(edited(rng, big, rng.randint(0, 4)))) for k in range(50)]
    kept, links = brute_kept(rows)
    frame = spark.createDataFrame(rows, "row long, text string")
    found = {r["node"]: r["component"] for r in similar_groups(frame, exact=True).collect()}
    assert {i for i, _ in rows if found.get(i, i) == i} == kept and all(found[a] == found[b] for a, b in links)
    assert len(links) > 300 and {*found} == {i for pair in links for i in pair}


def test_keys_are_shuffled_once(spark):
    """Buckets know their size and least row from one shuffle of the keys, which carry no sketches."""
    keyed = spark.createDataFrame([(1, 10, 10), (1, 11, 11), (1, 12, 10), (2, 10, 10), (2, 12, 10), (3, 11, 11)], "key long, row long, group long")
    got = buckets(keyed)
    assert sorted((r["key"], r["row"], r["group"], r["size"], *r["p"]) for r in got.collect()) == [(1, 10, 10, 3, 10, 10), (1, 11, 11, 3, 10, 10), (1, 12, 10, 3, 10, 10)]
    assert got._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].count("Exchange hashpartitioning") == 1


def test_pivots_make_likely_pairs_once(spark):
    """A pair of near copies meets in many buckets; the join makes a row of it in the first one only, and of no unlikely pair."""
    rng = random.Random(5)
    base = [f"g{i}" for i in range(150)]
    texts = [" ".join(edited(rng, base, rng.randint(0, 9))) for _ in range(70)]
    lean = sketches(spark.createDataFrame(list(enumerate(texts)), "row long, text string"))
    group = F.when(F.col("row") % 7 < 5, 0).otherwise(F.col("row"))
    keyed = buckets(block_keys(lean.withColumn("group", group), CHOICES))
    held = keyed.select("key", "row", "group").join(lean.select("row", F.struct("n", *FP).alias("s")), "row")
    fps = [wide_fingerprint(shingles(t)) for t in texts]
    of = [i if i % 7 >= 5 else 0 for i in range(70)]
    across = [(u, v) for u in range(70) for v in range(u + 1, 70) if of[u] != of[v]]
    met = {p: sum(bool((fps[p[0]][c] == fps[p[1]][c]).all()) for c in CHOICES) for p in across}
    far = {p: int(np.unpackbits(fps[p[0]] ^ fps[p[1]]).sum()) for p in across}
    want = {p for p in across if met[p] and far[p] <= FAR}
    # With so many shares each row is a pivot, so a pair comes from both its ends.
    pairs, least = pivot_pairs(held, 1 << 30, 80, FAR)
    got = [tuple(r) for r in pairs.collect()]
    assert {*got} == want and len(got) == 2 * len(want) and least.count() == held.count()
    assert sum(met.values()) > 5 * len(want) and any(met[p] and far[p] > FAR for p in across)
    assert re.search(r"Join .*bit_count", pairs._jdf.queryExecution().executedPlan().toString())
    # Pivots of a few shares leave no pair out either, once those that have served are gone.
    seen, rest = [], held
    for pivots in (2, 8, 1 << 30):
        pairs, least = pivot_pairs(rest, pivots, 80, FAR)
        seen += [tuple(r) for r in pairs.collect()]
        rest = rest.join(least, ["key", "row"], "left_anti")
    assert {*seen} == want and rest.count() == 0


def test_untried_pairs(spark):
    pairs, old = (spark.createDataFrame(x, "u long, v long") for x in ([(1, 2), (1, 2), (3, 4), (5, 6)], [(3, 4), (7, 8)]))
    assert sorted(map(tuple, untried(pairs, [old]).collect())) == [(1, 2), (5, 6)]
    assert sorted(map(tuple, untried(pairs, []).collect())) == [(1, 2), (3, 4), (5, 6)]


def test_components_grow(spark):
    parts = spark.createDataFrame([(1, 1), (2, 1), (5, 5), (9, 5)], "node long, component long")
    links = spark.createDataFrame([(1, 2), (9, 20), (20, 21), (2, 0), (30, 31)], "u long, v long")
    assert sorted(map(tuple, grown(parts, links).collect())) == [(0, 0), (1, 0), (2, 0), (5, 5), (9, 5), (20, 5), (21, 5), (30, 30), (31, 30)]
    assert grown(parts, links.limit(1)) is parts


def test_shingles_are_distinct_and_sorted():
    assert len(CHOICES) == 155 and len({(a, b) for t in CHOICES.tolist() for a in t for b in t if a < b}) == 155 * 3
    assert len(shingles("a b c d e " * 30)) == 5 and list(shingles("x y")) == list(shingles("X  Y"))
