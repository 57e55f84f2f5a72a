"""Scans, positions and as-of joins against plain windows and loops, with a key that holds nearly all rows."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from chronofact.operators.history import assign_positions, facts_as_of, field_history
from chronofact.operators.ordered import as_of, scanned, with_position

SCHEMA = "k string, at timestamp_ntz, id long, v int, `x.y` string"


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(12)
    made = [(rng.choice(["hot"] * 18 + ["a", None]), None if rng.random() < 0.05 else rng.randint(0, 9 * 86400), i, rng.choice([None, 1, 2, 3])) for i in range(1500)]
    df = spark.createDataFrame(made, "k string, s long, id long, v int")
    return df.select("k", F.timestamp_seconds("s").cast("timestamp_ntz").alias("at"), "id", "v", F.lit("odd").alias("x.y")).repartition(4)


def test_scan_equals_windows(spark, rows):
    bucket = F.date_trunc("day", "at")
    v = F.col("v")
    got = scanned(rows, ["k"], ["at", "id"], bucket, "no", {"before": v, "before_id": F.col("id")}, {"after": v}, {"held": v}, {"sum": v})
    w = Window.partitionBy("k").orderBy("at", "id")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    want = rows.select(
        "*", F.row_number().over(w).cast("long").alias("no"), F.lag("v").over(w).alias("before"), F.lag("id").over(w).alias("before_id"), F.lead("v").over(w).alias("after"),
        F.last("v", ignorenulls=True).over(upto).alias("held"), F.sum("v").over(upto).alias("sum"),
    )
    assert got.columns == want.columns
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    assert scanned(rows.limit(0), ["k"], ["at", "id"], bucket, "no").count() == 0


def test_no_window_sorts_a_whole_key(spark, rows):
    """Windows over rows are parted by the bucket too; those by the key alone read one row a bucket."""
    hot = rows.where("k = 'hot'").count()
    largest = rows.groupBy("k", F.date_trunc("day", "at")).count().agg(F.max("count")).first()[0]
    assert hot > 1200 and largest < hot / 6
    got = scanned(rows, ["k"], ["at", "id"], F.date_trunc("day", "at"), "no", lead={"after": F.col("v")})
    plan = got._jdf.queryExecution().optimizedPlan().toString().splitlines()
    windows = [i for i, line in enumerate(plan) if "Window [" in line]
    assert len(windows) >= 2
    for i in windows:
        spec = plan[i].rsplit("], [", 2)[-2]
        if "_bucket" not in spec:
            depth = len(plan[i]) - len(plan[i].lstrip(" :+-"))
            below = [line for line in plan[i + 1 :] if len(line) - len(line.lstrip(" :+-")) > depth]
            assert any("Aggregate [" in line for line in below[:2]), plan[i]


def test_positions_of_a_whole_table(spark, rows):
    got = with_position(rows, [F.desc_nulls_last("at"), F.desc("id")]).collect()
    want = sorted(rows.collect(), key=lambda r: (r["at"] is not None, r["at"] or 0, r["id"]) if r["at"] else (False, 0, r["id"]), reverse=True)
    assert [r["id"] for r in sorted(got, key=lambda r: r["position"])] == [r["id"] for r in want]
    assert sorted(r["position"] for r in got) == list(range(1500)) and got[0]["x.y"] == "odd"
    assert with_position(rows.limit(0), [F.desc("id")]).count() == 0


def test_as_of(spark, rows):
    facts = rows.where("id % 3 = 0").select("k", "at", "id", "v")
    probes = rows.where("id % 2 = 0").select("k", "at", F.col("id").alias("probe"), "`x.y`")
    got = {r["probe"]: (r["v"], r["id"], r["x.y"]) for r in as_of(facts, probes, ["k"], ["id"], "at", F.date_trunc("day", "at"), ["v", "id"]).collect()}
    held = facts.collect()
    for p in probes.collect():
        mine = [f for f in held if f["k"] == p["k"] and f["at"] is not None and p["at"] is not None and f["at"] <= p["at"]]
        best = max(mine, key=lambda f: (f["at"], f["id"]), default=None)
        assert got[p["probe"]] == ((best["v"], best["id"], "odd") if best else (None, None, "odd"))
    assert len(got) == probes.count()
    assert as_of(facts.limit(0), probes, ["k"], ["id"], "at", F.date_trunc("day", "at"), ["v"]).where("v is not null").count() == 0


def test_history_of_a_hot_key(spark, rows):
    """Positions, superseded facts and as-of values where one subject has nearly all rows."""
    facts = rows.select(F.coalesce("k", F.lit("none")).alias("company_key"), F.lit("p").alias("product_key"), F.lit("f").alias("field"), "id", F.col("id").alias("snapshot_id"), F.lit(1).alias("extraction_version"), F.coalesce("at", F.lit("2024-01-01").cast("timestamp_ntz")).alias("observed_at"), F.col("v").cast("string").alias("value"), F.lit("disclosed").alias("disclosure_status"))
    by = {}
    for r in sorted(facts.collect(), key=lambda r: (r["observed_at"], r["id"])):
        by.setdefault(r["company_key"], []).append(r)
    got = {(r["company_key"], r["position"]): r["id"] for r in field_history(facts).collect()}
    assert got == {(k, i): r["id"] for k, rs in by.items() for i, r in enumerate(rs[:-1])}
    probes = facts.where("id % 7 = 0").select("company_key", "product_key", "field", "observed_at", "id")
    held = {r["id"]: r["value"] for r in facts_as_of(facts, probes).collect()}
    last = {r["id"]: [x for x in rs if x["observed_at"] == r["observed_at"]][-1]["value"] for rs in by.values() for r in rs}
    assert held == {i: last[i] for i in held} and len(held) == probes.count()
    changes = facts.select(F.col("company_key").alias("change_set_id"), F.col("observed_at").alias("detected_at"), "field", "id")
    first = assign_positions(changes.where("id % 2 = 0"))
    more = assign_positions(changes.where("id % 2 = 1"), first)
    places = {}
    for r in first.union(more).collect():
        places.setdefault(r["change_set_id"], []).append(r["position"])
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
