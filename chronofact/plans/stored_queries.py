"""Queries over tables that are stored first: laid out for their readers, as contract files, with metrics and sketches."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from chronofact.operators import audits as a
from chronofact.operators import grouping as gr
from chronofact.operators import history as h
from chronofact.plans.tables import OBSERVATIONS, observations, read
from chronofact.session import shared_folder
from chronofact.sources import layout, registry, sinks


def _folder(spark, name):
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def s1_sources(spark, sf_dir):
    """The problems of a registry with an entry a supplier, stored as JSON arrays and read back: insecure and signed-in urls,
    priorities and cadences out of range, and ids that two suppliers share."""
    path, k = _folder(spark, "registry"), F.col("s_suppkey")
    url = F.concat(F.when(k % 7 == 0, "http://").when(k % 11 == 0, "https://me:pw@").otherwise("https://"), F.lit("s"), k.cast("string"), F.lit(".example.org/feed"))
    row = F.to_json(F.struct(F.concat(F.lit("s"), F.when(k % 13 == 0, k - 1).otherwise(k).cast("string")).alias("id"), F.col("s_name").alias("publisher"), F.lit("rss").alias("type"), url.alias("url"), (k % 5).cast("int").alias("priority"), ((k % 9) * 60).cast("int").alias("cadence_minutes")))
    rows = read(spark, sf_dir, "supplier").select((k % 4).alias("part"), row.alias("row"))
    rows.groupBy("part").agg(F.concat(F.lit("["), F.array_join(F.collect_list("row"), ","), F.lit("]")).alias("value")).write.partitionBy("part").text(path)
    return registry.source_problems(registry.read_sources(spark, f"{path}/*/*.txt")).groupBy("problem").agg(F.count("*").alias("n"))


def s5_days(spark, sf_dir):
    """Facts stored by day, of which the second week is read: other days' files stay shut."""
    path = _folder(spark, "facts")
    layout.write_by_day(observations(spark, sf_dir), path, "observed_at", ["company_key", "field"])
    return layout.read_days(spark, path, "2024-01-08", "2024-01-15").groupBy("day", "field").agg(F.count("*").alias("n"), F.count("value").alias("disclosed"))


def s5_bucketed(spark, sf_dir):
    """Facts and current facts stored in buckets of one key, and joined without moving either."""
    facts = observations(spark, sf_dir)
    names = [layout.write_bucketed(t, _folder(spark, n), ["company_key", "field"], 8) for n, t in (("facts", facts), ("current", h.current_facts(facts)))]
    f, c = (spark.table(n) for n in names)
    both = f.join(c.select("company_key", "field", F.col("id").alias("current_id")), ["company_key", "field"])
    return both.groupBy("company_key", "field").agg(F.count_if(F.col("id") != F.col("current_id")).alias("superseded"), F.max("current_id").alias("current_id"))


def s4_contract(spark, sf_dir):
    """Conversations written as files of JSON arrays, some rows and one file of them spoilt, and read with a quarantine."""
    path = _folder(spark, "contract")
    t = read(spark, sf_dir, "conversations").withColumn("part", F.col("conv_id") % 7)
    turn = F.when(F.col("conv_id") % 5 == 3, F.concat(F.lit("no "), F.col("turn").cast("string"))).otherwise(F.col("turn").cast("string"))
    spoilt = F.when(F.col("conv_id") % 5 == 3, F.to_json(F.struct("conv_id", turn.alias("turn"), "role", "text")))
    row = F.when((F.col("conv_id") % 5 == 1) & (F.col("turn") == 2), F.to_json(F.struct("conv_id", "turn", "text"))).otherwise(F.coalesce(spoilt, F.to_json(F.struct("conv_id", "turn", "role", "text"))))
    arrays = t.groupBy("part").agg(F.concat(F.lit("["), F.array_join(F.collect_list(row), ","), F.when(F.col("part") == 6, "").otherwise("]")).alias("value"))
    arrays.write.partitionBy("part").text(path)
    good, bad = registry.read_contract_rows(spark, f"{path}/*/*.txt", "conv_id long, turn long, role string, text string", ["role"])
    found = good.groupBy().agg(F.lit("good").alias("outcome"), F.count("*").alias("n"), F.sum("turn").alias("turns"))
    return found.unionByName(bad.groupBy(F.col("reason").alias("outcome")).agg(F.count("*").alias("n"), F.lit(None).cast("long").alias("turns")))


def s7_metrics(spark, sf_dir):
    """Orders stored by status with counts taken on the way; one run's are logged twice, and stay as they are."""
    path, history = _folder(spark, "orders"), _folder(spark, "metrics")
    for status in ("F", "O", "F"):
        orders = read(spark, sf_dir, "orders").where(F.col("o_orderstatus") == status)
        job = sinks.InFlight(orders, {"rows": F.count("*"), "customers_max": F.max("o_custkey"), "urgent": F.count_if(F.col("o_orderpriority") == "1-URGENT")})
        job.rows.write.mode("overwrite").parquet(f"{path}/{status}")
        job.log(history, f"orders-{status}")
    return spark.read.parquet(history).select("run_id", "metric", "value")


def z4_freshness(spark, sf_dir):
    """Freshness and coverage of each event type from sketches stored day by day: exact counts, and whether the sketched
    figures are within their stated errors of the exact ones."""
    at = F.lit("2024-02-01").cast("timestamp")
    rows = read(spark, sf_dir, "events").select(F.col("event_type").alias("source_id"), F.to_date("ts").alias("run"), F.concat_ws("-", F.col("user_id").cast("string"), F.floor("value").cast("string")).alias("snapshot_id"), (F.col("event_id") % 3 == 0).alias("cited"), F.col("ts").alias("seen_at"))
    path = _folder(spark, "sketches")
    gr.run_sketches(rows, at).write.partitionBy("run").parquet(path)
    found = gr.freshness(spark.read.parquet(path), (0.48, 0.52))
    age = F.unix_seconds(at) - F.unix_seconds(F.col("seen_at").cast("timestamp"))
    exact = rows.groupBy("source_id").agg(F.percentile(age, 0.5).cast("long").alias("median"), F.countDistinct("snapshot_id").alias("all_seen"), F.countDistinct(F.when(F.col("cited"), F.col("snapshot_id"))).alias("all_cited"))
    return found.join(exact, "source_id").select(
        "source_id", "snapshots", "all_seen", "all_cited", F.col("median").between(F.col("age_48"), F.col("age_52")).alias("age_ok"), (F.abs(F.col("seen") / F.col("all_seen") - 1) <= 0.05).alias("seen_ok"), (F.abs(F.col("cited") / F.col("all_cited") - 1) <= 0.05).alias("cited_ok")
    )


def a5_by_parts(spark, sf_dir):
    """Line items against a version in which the orders of one day are changed or gone, by fingerprints of their parts."""
    line = F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"), F.xxhash64("*").cast("string"))
    before = read(spark, sf_dir, "lineitem").withColumn("line", line).select("line", "l_orderkey", "l_returnflag", "l_quantity")
    after = before.where("l_orderkey % 997 <> 0").withColumn("l_returnflag", F.when(F.col("l_orderkey") % 499 == 1, F.lit("X")).otherwise(F.col("l_returnflag")))
    return a.audit_append_only(before, after, "line", ["l_returnflag", "l_quantity"], fingerprints=True).groupBy("audit").agg(F.sum("n").alias("n"))


QUERIES = {q.__name__: q for q in (s1_sources, s4_contract, s5_days, s5_bucketed, s7_metrics, z4_freshness, a5_by_parts)}

ORACLES = {
    "s1_sources": """
        with r as (select s_suppkey as k, case when s_suppkey % 13 = 0 then s_suppkey - 1 else s_suppkey end as id from supplier)
        select 'url is not https' as problem, count(*) as n from r where k % 7 = 0 having n > 0 union all select 'user-info in url', count(*) as n from r where k % 7 <> 0 and k % 11 = 0 having n > 0
        union all select 'priority out of range', count(*) as n from r where k % 5 = 4 having n > 0 union all select 'cadence not positive', count(*) as n from r where k % 9 = 0 having n > 0
        union all select 'repeated id', count(*) as n from (select id from r group by id having count(*) > 1) having n > 0
    """,
    "s4_contract": """
        with r as (select *, case when conv_id % 7 = 6 then 'no array' when conv_id % 5 = 3 then 'schema' when conv_id % 5 = 1 and turn = 2 then 'missing role' else 'good' end as outcome from conversations)
        select outcome, case when outcome = 'no array' then 1 else count(*) end as n, case when outcome = 'good' then sum(turn)::bigint end as turns from r group by outcome
    """,
    "s5_days": f"with {OBSERVATIONS} select observed_at::date as day, field, count(*) as n, count(value) as disclosed from obs where observed_at >= timestamp '2024-01-08' and observed_at < timestamp '2024-01-15' group by all",
    "s5_bucketed": f"with {OBSERVATIONS} select company_key, field, count(*) - 1 as superseded, arg_max(id, (observed_at, id)) as current_id from obs group by all",
    "s7_metrics": """
        with o as (select 'orders-' || o_orderstatus as run_id, count(*)::double as rows, max(o_custkey)::double as customers_max, count(*) filter (where o_orderpriority = '1-URGENT')::double as urgent from orders where o_orderstatus in ('F', 'O') group by all)
        select run_id, metric, value from (unpivot o on rows, customers_max, urgent into name metric value value)
    """,
    "z4_freshness": """
        with r as (select event_type as source_id, user_id || '-' || floor(value)::bigint as s, event_id % 3 = 0 as cited from events)
        select source_id, count(*) as snapshots, count(distinct s) as all_seen, count(distinct case when cited then s end) as all_cited, true as age_ok, true as seen_ok, true as cited_ok from r group by all
    """,
    "a5_by_parts": "select case when l_orderkey % 997 = 0 then 'deleted' else 'changed:l_returnflag' end as audit, count(*)::bigint as n from lineitem where l_orderkey % 997 = 0 or (l_orderkey % 499 = 1 and l_returnflag <> 'X') group by all",
}
