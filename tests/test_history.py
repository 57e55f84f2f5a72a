"""Fact history against a plain loop, and under shuffled, split and late input."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from chronofact.operators import history as h
from chronofact.plans.tables import observations

FACT = "id long, snapshot_id long, company string, product string, company_key string, product_key string, field string, value string, disclosure_status string, extraction_version int, observed_at timestamp"


def rows_of(seed, n=120):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        v = rng.choice(["1", "2", "10", "x", None])
        out.append((i, rng.randint(0, 60), "A", "P", rng.choice("ab"), "p", rng.choice("fg"), v, "not_disclosed" if v is None else "disclosed", rng.randint(1, 2), datetime(2024, 1, 1) + timedelta(hours=rng.randint(0, 200))))
    return out


def key(r):
    return r[10], r[1], r[9], r[0]


def loop(rows, state=None):
    """Changes by walking each key's observations in order."""
    held, out = dict(state or {}), []
    for r in sorted(rows, key=key):
        k = (r[4], r[6])
        p = held.get(k)
        if p is not None and key(r) <= key(p):
            continue
        if p is not None and p[1] != r[1] and (p[7], p[8]) != (r[7], r[8]):
            out.append((*k, p[7], r[7], p[1], r[1]))
        held[k] = r
    return sorted(out, key=str), held


def changes(df):
    return sorted(((r["company_key"], r["field"], r["previous"]["value"], r["current"]["value"], r["previous"]["snapshot_id"], r["current"]["snapshot_id"]) for r in df.collect()), key=str)


def test_changes_equal_the_loop_in_any_order(spark):
    for seed in range(3):
        rows = rows_of(seed)
        df = spark.createDataFrame(random.Random(seed).sample(rows, len(rows)), FACT).repartition(5)
        want, held = loop(rows)
        for bucket in ("day", "hour", "year"):
            assert changes(h.detect_changes(df, bucket=bucket)) == want
        assert {(r["company_key"], r["field"]): r["id"] for r in h.current_facts(df).collect()} == {k: r[0] for k, r in held.items()}


def test_late_rows_change_nothing(spark):
    rows = rows_of(9)
    first, second = rows[:70], rows[70:]
    want0, held = loop(first)
    state = h.current_facts(spark.createDataFrame(first, FACT))
    want, held = loop(second, held)
    new = spark.createDataFrame(second, FACT)
    assert changes(h.detect_changes(new, state=state)) == want
    assert {(r["company_key"], r["field"]): r["id"] for r in h.current_facts(new, state).collect()} == {k: r[0] for k, r in held.items()}


def test_types_and_tolerance(spark):
    df = spark.createDataFrame([("5", "6"), ("6", "5"), ("$5", "6"), (None, "1"), ("1", None), (None, None), ("5", "5.0")], "a string, b string")
    assert [r[0] for r in df.select(h.change_type(F.col("a"), F.col("b"))).collect()] == ["increased", "decreased", "changed", "disclosed", "not_disclosed", "changed", "changed"]
    df = spark.createDataFrame([("$5.00", "5"), ("Apache-2.0", "apache 2.0"), ("1", "2"), (None, None), ("1", None), ("5d", "5")], "a string, b string")
    assert [r[0] for r in df.select(h.values_equivalent(F.col("a"), F.col("b"))).collect()] == [True, True, False, True, False, False]


def test_shapes(spark):
    s = "struct<value:string,snapshot_id:long>"
    df = spark.createDataFrame([("not_disclosed", ("1", 1), (None, 2)), ("not_disclosed", None, (None, 2)), ("disclosed", None, ("1", 2)), ("disclosed", ("0", 1), ("1", 2)), ("other", ("1", 1), ("2", 2)), ("increased", ("1", None), ("2", 2))], f"k string, p {s}, c {s}")
    assert [r[0] for r in df.select(h.change_shape_ok(F.col("p"), F.col("c"), F.col("k"))).collect()] == [True, False, True, False, True, False]


def test_record_facts(spark):
    base = rows_of(1, 4)[:1]
    old = spark.createDataFrame(base, FACT)
    same, other = list(base[0]), list(base[0])
    same[0], other[0], other[7] = 50, 51, "changed!"
    fresh = [60, 999, *base[0][2:]]
    got = {r["id"]: (r["action"], r["diverges"]) for r in h.record_facts(old, spark.createDataFrame([tuple(same), tuple(other), tuple(fresh), (61, *fresh[1:])], FACT)).collect()}
    assert got == {50: ("replay", []), 51: ("divergent", ["value"]), 60: ("insert", []), 61: ("replay", [])}


def test_positions_go_on(spark):
    c = h.detect_changes(spark.createDataFrame(rows_of(2), FACT))
    one = h.assign_positions(c)
    n = {r["change_set_id"]: r["n"] for r in one.groupBy("change_set_id").agg(F.count("*").alias("n")).collect()}
    two = h.assign_positions(c, one)
    assert {r["change_set_id"]: r["m"] for r in two.groupBy("change_set_id").agg(F.min("position").alias("m")).collect()} == n
    assert all(r["consistent"] for r in h.build_change_sets(one).collect())


def test_change_set_pages_are_the_sets(spark, sf_dir):
    """Pages end to end give a set's changes and its snapshots in first-seen order."""
    changes = h.assign_positions(h.detect_changes(observations(spark, sf_dir)).withColumn("current", F.col("current").withField("snapshot_id", F.col("current.snapshot_id") % 40)))
    whole = {r["company_key"]: r for r in h.build_change_sets(changes).collect()}
    pages = {}
    for r in sorted(h.change_set_pages(changes, 7).collect(), key=lambda r: r["page"]):
        held = pages.setdefault(r["company_key"], ([], [], []))
        assert len(r["changes"]) <= 7
        for i, c in enumerate(("changes", "previous_snapshot_ids", "current_snapshot_ids")):
            held[i].extend(r[c])
    assert {k: tuple(v[c] for c in ("changes", "previous_snapshot_ids", "current_snapshot_ids")) for k, v in whole.items()} == pages
