"""Laid-out tables, contract files, metrics on the way, fingerprints, pairs by blocks and sketches."""

import itertools
import random
import re

from pyspark.sql import functions as F

from chronofact.operators import compare as x
from chronofact.operators import grouping as gr
from chronofact.operators.audits import audit_append_only
from chronofact.operators.fingerprints import differing_parts, multiset
from chronofact.sources import layout, registry, sinks


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_days_are_pruned(spark, tmp_path):
    path = f"file://{tmp_path}/facts"
    rows = spark.range(3000).select("id", F.when(F.col("id") % 50 > 0, F.timestamp_seconds(F.lit(1704067200) + F.col("id") * 600)).alias("at"))
    layout.write_by_day(rows, path, "at", ["id"])
    week = layout.read_days(spark, path, "2024-01-08", "2024-01-10")
    assert {r["day"].day for r in week.select("day").distinct().collect()} == {8, 9} and week.count() == rows.where("at >= '2024-01-08' and at < '2024-01-10'").count()
    assert re.search(r"\(day#\d+ >= 2024-01-08\), \(day#\d+ < 2024-01-10\)\], PushedFilters: \[\]", plan_of(week))
    assert layout.read_days(spark, path).count() == 3000 and layout.read_days(spark, path, end="2024-01-02").where("at is null").count() == 0
    # A dimension's filter prunes the days at run time.
    days = spark.range(20).select(F.date_add(F.lit("2024-01-01").cast("date"), F.col("id").cast("int")).alias("day"), (F.col("id") % 7).alias("weekday"))
    joined = layout.read_days(spark, path).join(days.where("weekday = 3"), "day")
    assert "dynamicpruning" in plan_of(joined) and joined.count() == rows.where("day(at) in (4, 11, 18)").count()


def test_bucketed_tables_join_in_place(spark, tmp_path):
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    a, b = (spark.range(500).select((F.col("id") % m).alias("k"), F.col("id").alias(n)) for m, n in ((50, "u"), (70, "v")))
    try:
        s, t = (spark.table(layout.write_bucketed(df, f"file://{tmp_path}/{n}", ["k"], 4)) for n, df in (("a", a), ("b", b)))
        joined = s.join(t, "k").groupBy("k").agg(F.count("*").alias("n"))
        assert "Exchange" not in plan_of(joined)
        assert sorted(joined.collect()) == sorted(a.join(b, "k").groupBy("k").agg(F.count("*").alias("n")).collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)


def test_contract_rows_are_judged_one_by_one(spark, tmp_path):
    files = {
        "good": '[{"id": "a", "n": 1, "sub": {"x": 2}}, {"id": "b", "n": null, "sub": null, "more": 5}]',
        "mixed": '[{"id": "c", "n": "two"}, {"id": "d", "sub": {"x": "y"}}, {"n": 3}, 7, null, {"id": "e", "n": 4}]',
        "broken": '[{"id": "f"}, {"id": ',
        "object": '{"id": "g"}',
        "none": "[]",
    }
    (tmp_path / "in").mkdir()
    for name, text in files.items():
        (tmp_path / "in" / f"{name}.json").write_text(text)
    good, bad = registry.read_contract_rows(spark, f"file://{tmp_path}/in", "id string, n int, sub struct<x: int>", ["id"])
    assert good.columns == ["id", "n", "sub"]
    assert sorted((r["id"], r["n"], r["sub"] and r["sub"]["x"]) for r in good.collect()) == [("a", 1, 2), ("b", None, None), ("e", 4, None)]
    got = sorted((r["file"].rsplit("/", 1)[1].split(".")[0], -1 if r["place"] is None else r["place"], r["reason"]) for r in bad.collect())
    assert [g for g in got if g[0] == "mixed"] == [("mixed", 0, "schema"), ("mixed", 1, "schema"), ("mixed", 2, "missing id"), ("mixed", 3, "schema"), ("mixed", 4, "schema")]
    assert ("broken", -1, "no array") in got and any(g[0] == "object" for g in got) and not any(g[0] in ("good", "none") for g in got)


def test_metrics_are_logged_once_a_run(spark, tmp_path):
    path = f"file://{tmp_path}/m"
    for run, n in (("r1", 10), ("r1", 99), ("r2", 5)):
        job = sinks.InFlight(spark.range(n), {"rows": F.count("*"), "most": F.max("id")})
        job.rows.write.mode("overwrite").parquet(f"file://{tmp_path}/out")
        job.log(path, run)
    assert sorted((r["run_id"], r["metric"], r["value"]) for r in spark.read.parquet(path).collect()) == [("r1", "most", 9.0), ("r1", "rows", 10.0), ("r2", "most", 4.0), ("r2", "rows", 5.0)]
    sinks.log_metrics(spark.createDataFrame([("m", 1.0)], "metric string, value double"), f"{path}2", "r1")
    sinks.log_metrics(spark.createDataFrame([("m", 1.0)], "metric string, value double"), f"{path}2", "r1")
    assert spark.read.parquet(f"{path}2").count() == 1


def test_fingerprints(spark):
    rng = random.Random(4)
    rows = [(rng.randint(0, 3), rng.choice(["x", "y", None]), rng.randint(0, 2)) for _ in range(200)]
    shuffled = rows[:]
    rng.shuffle(shuffled)
    sums = [{r["k"]: r["m"] for r in spark.createDataFrame(some, "k int, s string, n int").repartition(parts).groupBy("k").agg(multiset("s", "n").alias("m")).collect()} for some, parts in ((rows, 1), (shuffled, 5), (rows + rows[:1], 2))]
    assert sums[0] == sums[1] and {k for k in sums[0] if sums[0][k] != sums[2][k]} == {rows[0][0]}
    before = spark.range(5000).select("id", (F.col("id") % 7).alias("v"), F.lit("w").alias("w"))
    assert differing_parts(before, before.orderBy(F.desc("id")), "id", ["v", "w"]) == []
    same = audit_append_only(before, before, "id", fingerprints=True)
    assert same.count() == 0 and "Join" not in plan_of(same)
    after = before.where("id not in (5, 4000)").withColumn("v", F.when(F.col("id") == 77, 100).otherwise(F.col("v"))).union(spark.createDataFrame([(9999, 1, "new")], "id long, v long, w string"))
    parts = differing_parts(before, after, "id", ["v", "w"])
    assert 1 <= len(parts) <= 4
    got, want = (sorted(map(tuple, audit_append_only(before, after, "id", fingerprints=f).collect())) for f in (True, False))
    assert got == want == [("changed:v", "77", 1), ("deleted", "4000", 1), ("deleted", "5", 1)]


def test_pairs_by_blocks(spark):
    rng = random.Random(8)
    rows = [(f"c{i}", rng.choice(["p", "q"]), f, rng.choice(["disclosed", "disclosed", "unknown"])) for i in range(40) for f in ("f", "g")]
    grid = spark.createDataFrame(rows, "company_key string, product_key string, field string, disclosure_status string")
    shown = {f: sorted((r[0], r[1]) for r in rows if r[2] == f and r[3] == "disclosed") for f in ("f", "g")}
    want = sorted((*a, *b, f) for f, subjects in shown.items() for a, b in itertools.combinations(subjects, 2))
    for blocks in (1, 5):
        assert sorted(map(tuple, x.all_pairs(grid, blocks).collect())) == want
    counts = {(r["company_key"], r["product_key"], r["field"]): r["n"] for r in x.pair_counts(grid).collect()}
    assert counts == {(*a, f): len(s) - 1 - i for f, s in shown.items() for i, a in enumerate(s[:-1])}
    assert x.all_pairs(grid.limit(0)).count() == x.pair_counts(grid.limit(0)).count() == 0


def test_pairs_in_lists(spark):
    """Lists hold every pair once, also of subjects that stand twice, in rows far fewer than pairs."""
    rows = [(f"c{i:03}", "p", "f", "disclosed") for i in range(120)] + [("c007", "p", "f", "disclosed"), ("c007", "p", "g", "disclosed"), ("c008", "q", "g", "unknown")]
    grid = spark.createDataFrame(rows, "company_key string, product_key string, field string, disclosure_status string")
    held = x.pair_lists(grid, blocks=3, listed=25).collect()
    got = sorted((r["company_key_a"], o["company_key"]) for r in held for o in r["others"])
    keys = sorted(r[0] for r in rows if r[2] == "f")
    assert got == sorted((a, b) for a, b in itertools.combinations(keys, 2) if a != b) and {r["field"] for r in held} == {"f"}
    assert max(len(r["others"]) for r in held) <= 26 and len(held) < len(got) / 15


def test_sketches_of_runs_merge(spark):
    rows = spark.range(4000).select(F.concat(F.lit("s"), (F.col("id") % 2).cast("string")).alias("source_id"), (F.col("id") % 10).alias("run"), (F.col("id") % 1500).cast("string").alias("snapshot_id"), (F.col("id") % 4 < 2).alias("cited"), F.timestamp_seconds(F.lit(1704067200) - F.col("id")).alias("seen_at"))
    at = F.lit("2024-01-01").cast("timestamp")
    whole = {r["source_id"]: r for r in gr.freshness(gr.run_sketches(rows, at, "run")).collect()}
    for s in ("s0", "s1"):
        mine = [i for i in range(4000) if f"s{i % 2}" == s]
        r = whole[s]
        assert r["snapshots"] == len(mine)
        for name, q in (("age_50", 0.5), ("age_90", 0.9)):
            assert abs(sum(i <= r[name] for i in mine) / len(mine) - q) < 0.02
        assert abs(r["seen"] / len({i % 1500 for i in mine}) - 1) < 0.05 and abs(r["cited"] / len({i % 1500 for i in mine if i % 4 < 2}) - 1) < 0.05
