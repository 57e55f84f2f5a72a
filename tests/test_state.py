"""Guarded upserts into a stored state: buckets, replays, late batches, compaction."""

import random

import pytest
from pyspark.sql import functions as F

from chronofact.sources.state import KeyedState, folders

SCHEMA = "k string, at long, no long, name string, seen_first long"


def state(spark, path, **more):
    return KeyedState(spark, path, ["k"], ["at", "no"], ["seen_first"], buckets=4, **more)


def frame(spark, rows):
    return spark.createDataFrame([(k, at, no, f"{k}-{at}-{no}", at) for k, at, no in rows], SCHEMA)


def plainly(batches):
    """The state by a loop: the first row's seen_first, the greatest tuple's others."""
    held = {}
    for rows in batches:
        for k in {r[0] for r in rows if r[0] is not None}:
            mine = [r for r in rows if r[0] == k]
            best, least = max(mine, key=lambda r: r[1:]), min(mine, key=lambda r: r[1:])
            if k not in held:
                held[k] = (best[1], best[2], f"{k}-{best[1]}-{best[2]}", least[1])
            elif best[1:] > held[k][:2]:
                held[k] = (best[1], best[2], f"{k}-{best[1]}-{best[2]}", held[k][3])
    return held


def stored(s):
    return {r["k"]: (r["at"], r["no"], r["name"], r["seen_first"]) for r in s.read().collect()}


def test_batches_in_any_order(spark, tmp_path):
    rng = random.Random(6)
    batches = [[(rng.choice([None, *map(str, range(25))]), rng.randint(0, 50), rng.randint(0, 3)) for _ in range(rng.choice([5, 40]))] for _ in range(4)]
    path = f"file://{tmp_path}/s"
    for i, rows in enumerate(batches):
        moved = {r["k"] for r in state(spark, path).upsert(frame(spark, rows), i).collect()}
        before, after = plainly(batches[:i]), plainly(batches[: i + 1])
        assert moved == {k for k in after if before.get(k) != after[k]}
        assert stored(state(spark, path)) == after
    s = state(spark, path)
    version = s.version
    assert {r["k"] for r in s.upsert(frame(spark, batches[-1]), 3).collect()} == moved and s.upsert(frame(spark, batches[0]), 0).count() == 0
    assert s.version == version and stored(s) == plainly(batches)
    # Without a number the guard alone makes a repeated batch change nothing.
    assert s.upsert(frame(spark, batches[2])).count() == 0 and stored(s) == plainly(batches)
    full = s.compact(most=1)
    assert full and all(len(fs) == 1 for fs in s.parts.values()) and stored(s) == plainly(batches)
    assert stored(state(spark, path)) == plainly(batches)
    gone = s.vacuum(versions=1)
    assert gone and stored(state(spark, path)) == plainly(batches)
    assert set(folders(spark, f"{path}/data")) == {f for fs in s.parts.values() for f in fs}


def test_only_touched_buckets_are_read_and_written(spark, tmp_path):
    path = f"file://{tmp_path}/s"
    s = state(spark, path)
    s.upsert(frame(spark, [(str(i), 1, 1) for i in range(50)]), 0)
    assert set(s.parts) == set(range(4))
    bucket = spark.range(1).select(F.pmod(F.xxhash64(F.lit("7")), F.lit(4))).first()[0]
    before = {b: list(fs) for b, fs in s.parts.items()}
    moved = s.upsert(frame(spark, [("7", 9, 1)]), 1)
    assert [r["k"] for r in moved.collect()] == ["7"]
    changed = {b for b in s.parts if s.parts[b] != before[b]}
    assert changed == {bucket} and s.parts[bucket][:1] == before[bucket]
    assert folders(spark, f"{path}/data/{s.parts[bucket][-1]}") == ["_SUCCESS", f"bucket={bucket}"]
    assert all(f"/bucket={bucket}/" in f for f in s.read([bucket]).inputFiles())
    # A late row below the stored tuple writes nothing.
    assert s.upsert(frame(spark, [("7", 3, 1)]), 2).count() == 0 and s.parts[bucket][-1].startswith("delta-000000000001")


def test_rows_are_only_added_without_an_order(spark, tmp_path):
    s = KeyedState(spark, f"file://{tmp_path}/s", ["k", "no"], first_by=["at"], buckets=4)
    assert s.upsert(frame(spark, [("a", 5, 1), ("a", 3, 1), ("b", 1, 1), (None, 1, 1)]), 0).count() == 2
    assert [r["k"] for r in s.upsert(frame(spark, [("a", 1, 1), ("c", 1, 1)]), 1).collect()] == ["c"]
    assert sorted((r["k"], r["at"]) for r in s.read().collect()) == [("a", 3), ("b", 1), ("c", 1)]
    assert sorted((r["k"], r["at"]) for r in KeyedState(spark, f"file://{tmp_path}/s", ["k", "no"], first_by=["at"]).read().collect()) == [("a", 3), ("b", 1), ("c", 1)]
    s.compact(most=0)
    assert s.read().count() == 3


def test_empty_batches_and_wrong_columns(spark, tmp_path):
    s = state(spark, f"file://{tmp_path}/s")
    with pytest.raises(ValueError, match="nothing is stored"):
        s.read()
    assert s.upsert(frame(spark, []), 0).count() == 0 and s.read().count() == 0 and s.upsert(frame(spark, []), 0).count() == 0
    s.upsert(frame(spark, [("a", 1, 1)]), 1)
    with pytest.raises(ValueError, match="differ from those stored"):
        s.upsert(frame(spark, [("a", 2, 1)]).drop("name"), 2)


def test_a_failed_batch_leaves_the_state(spark, tmp_path):
    path = f"file://{tmp_path}/s"
    s = state(spark, path)
    s.upsert(frame(spark, [("a", 1, 1), ("b", 1, 1)]), 0)
    bad = frame(spark, [("a", 2, 1)]).withColumn("name", F.raise_error(F.lit("no such name")).cast("string"))
    with pytest.raises(Exception, match="no such name"):
        s.upsert(bad, 1)
    again = state(spark, path)
    assert again.applied == 0 and stored(again) == plainly([[("a", 1, 1), ("b", 1, 1)]])
    again.upsert(frame(spark, [("a", 2, 1)]), 1)
    assert again.vacuum() == [] or stored(again)["a"][0] == 2
    # A second writer that started from the same version fails.
    s.version, s.applied = 1, 0
    with pytest.raises(Exception, match="(?i)exists"):
        s.upsert(frame(spark, [("a", 3, 1)]), 1)
