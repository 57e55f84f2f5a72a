"""Queries of fact history and change detection, over events as observations."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronofact.operators import history as h
from chronofact.plans.tables import OBSERVATIONS, observations

#: Changes in SQL: each observation against the one before it.
CHANGES = (
    OBSERVATIONS
    + """,
    pairs as (
      select *, lag(id) over w as p_id, lag(value) over w as p_value, lag(disclosure_status) over w as p_status, lag(observed_at) over w as p_at
      from obs window w as (partition by company_key, product_key, field order by observed_at, snapshot_id, extraction_version, id)
    ),
    changes as (
      select company_key, product_key, field, company, product, id as snapshot_id, value, observed_at, p_id, p_value, p_at,
             case when p_value is null and value is not null then 'disclosed' when p_value is not null and value is null then 'not_disclosed'
                  when try_cast(value as double) > try_cast(p_value as double) then 'increased'
                  when try_cast(value as double) < try_cast(p_value as double) then 'decreased' else 'changed' end as change_type
      from pairs where p_id is not null and (value is distinct from p_value or disclosure_status is distinct from p_status)
    )
"""
)


def _changes(spark, sf_dir):
    return h.detect_changes(observations(spark, sf_dir))


def _positioned(spark, sf_dir):
    return h.assign_positions(_changes(spark, sf_dir))


def h4_fact_changes(spark, sf_dir):
    """Changes of every (user, event type)."""
    return _changes(spark, sf_dir).select(
        "company_key", "field", "change_type", F.col("previous.value").alias("previous_value"), F.col("current.value").alias("current_value"), F.col("previous.snapshot_id").alias("previous_id"), F.col("current.snapshot_id").alias("current_id"), "detected_at"
    )


def h2_current_facts(spark, sf_dir):
    return h.current_facts(observations(spark, sf_dir)).select("company_key", "field", "id", "value", "disclosure_status", "observed_at")


def h3_read_current(spark, sf_dir):
    facts = observations(spark, sf_dir)
    subjects = facts.where("cast(value as double) > 99").select("company_key", "product_key")
    return h.read_current(h.current_facts(facts), facts, subjects, ["click", "error"]).select("company_key", "field", "id", "value")


def h1_record_facts(spark, sf_dir):
    """The second half of the events replayed over the first, keyed by the hour; values differ where the hour has several."""
    facts = observations(spark, sf_dir).withColumn("snapshot_id", F.date_trunc("hour", "observed_at").cast("string"))
    out = h.record_facts(facts.where("id % 2 = 0"), facts.where("id % 2 = 1"))
    return out.select("id", "action", F.concat_ws(",", F.array_sort("diverges")).alias("diverges"))


def h4_incremental(spark, sf_dir):
    """Changes of late January against the state at its 20th."""
    facts = observations(spark, sf_dir)
    cut = F.lit("2024-01-20").cast("timestamp_ntz")
    old, new = facts.where(F.col("observed_at") < cut), facts.where(F.col("observed_at") >= cut)
    return h.detect_changes(new, state=h.current_facts(old)).select("company_key", "field", "change_type", F.col("previous.snapshot_id").alias("previous_id"), F.col("current.snapshot_id").alias("current_id"))


def h5_tolerant_changes(spark, sf_dir):
    """Changes when values that agree as whole numbers are written differently: formatting alone is no change."""
    facts = observations(spark, sf_dir).withColumn("value", F.when(F.col("id") % 2 == 0, F.concat(F.lit("$"), F.floor(F.col("value").cast("double")).cast("string"))).otherwise(F.floor(F.col("value").cast("double")).cast("string")))
    return h.detect_changes(facts, equivalence="tolerant").select("company_key", "field", "change_type", F.col("previous.snapshot_id").alias("previous_id"), F.col("current.snapshot_id").alias("current_id"))


def h6_change_types(spark, sf_dir):
    return _changes(spark, sf_dir).groupBy("field", "change_type").agg(F.count("*").alias("n"))


def h7_latest_confirmation(spark, sf_dir):
    """How old the observation is that each change cites as its previous one, in seconds, summed by key."""
    age = F.unix_micros(F.col("current.observed_at").cast("timestamp")) - F.unix_micros(F.col("previous.observed_at").cast("timestamp"))
    return _changes(spark, sf_dir).groupBy("company_key", "field").agg(F.sum(age).alias("age_us"), F.count("*").alias("n"))


def h8_change_shapes(spark, sf_dir):
    ok = h.change_shape_ok(F.col("previous"), F.col("current"), F.col("change_type"))
    return _changes(spark, sf_dir).groupBy("change_type").agg(F.count_if(ok).alias("n_ok"), F.count_if(~ok).alias("n_bad"))


def h9_change_sets(spark, sf_dir):
    return _changes(spark, sf_dir).groupBy("change_set_id", "company_key").agg(F.count("*").alias("n"))


def h10_positions(spark, sf_dir):
    return _positioned(spark, sf_dir).select("company_key", "field", F.col("current.snapshot_id").alias("current_id"), "position")


def h11_change_sets_built(spark, sf_dir):
    sets = h.build_change_sets(_positioned(spark, sf_dir))
    return sets.select("company_key", "consistent", F.size("changes").alias("n"), F.concat_ws(",", F.transform("current_snapshot_ids", lambda x: x.cast("string"))).alias("current_ids"))


def h11_change_set_pages(spark, sf_dir):
    sets = h.change_set_pages(_positioned(spark, sf_dir), 20)
    return sets.select("company_key", "page", F.size("changes").alias("n"), F.concat_ws(",", F.transform("current_snapshot_ids", lambda x: x.cast("string"))).alias("current_ids"))


def h12_citations(spark, sf_dir):
    return h.change_set_citations(_positioned(spark, sf_dir)).select("change_set_id", "side", "snapshot_id", "position")


def h13_changes_for_snapshots(spark, sf_dir):
    facts = observations(spark, sf_dir)
    subjects = facts.select("company_key", "product_key", "company", "product").distinct()
    wanted = facts.where("field = 'error'").select("snapshot_id")
    return h.changes_for_snapshots(_changes(spark, sf_dir), subjects, wanted).select("company_key", "subject_company", "field", F.col("current.snapshot_id").alias("current_id"))


def h13_changes_for_sets(spark, sf_dir):
    """Changes of the sets with more than sixty."""
    facts, changes = observations(spark, sf_dir), _positioned(spark, sf_dir)
    subjects = facts.select("company_key", "product_key", "company", "product").distinct()
    large = changes.groupBy("change_set_id").count().where("count > 60")
    return h.changes_for_sets(changes, subjects, large).select("change_set_id", "subject_company", "field", "position", F.col("current.snapshot_id").alias("current_id"))


def h14_field_history(spark, sf_dir):
    return h.field_history(observations(spark, sf_dir)).select("company_key", "field", "id", "position")


def h15_intervals(spark, sf_dir):
    facts = observations(spark, sf_dir).withColumn("value", F.when(F.col("value").isNotNull(), F.floor(F.col("value").cast("double") / 20).cast("string")))
    return h.history_intervals(facts).select("company_key", "field", "value", "disclosure_status", "valid_from", "valid_to")


def h15_as_of(spark, sf_dir):
    """Every event with what its user's last purchase up to then was worth."""
    facts = observations(spark, sf_dir).where("field = 'purchase'").select(*h.ORDER, "company_key", "value", "disclosure_status")
    probes = observations(spark, sf_dir).select("company_key", F.col("id").alias("event_id"), "observed_at")
    return h.facts_as_of(facts, probes, ["company_key"]).select("event_id", "value", "disclosure_status")


QUERIES = {f.__name__: f for f in (h1_record_facts, h2_current_facts, h3_read_current, h4_fact_changes, h4_incremental, h5_tolerant_changes, h6_change_types, h7_latest_confirmation, h8_change_shapes, h9_change_sets, h10_positions, h11_change_sets_built, h11_change_set_pages, h12_citations, h13_changes_for_snapshots, h13_changes_for_sets, h14_field_history, h15_intervals, h15_as_of)}

_SET = "sha256(concat('batch', chr(1), company_key, chr(1), product_key))"
_ID = "sha256(concat(company_key, chr(1), product_key, chr(1), field, chr(1), snapshot_id, chr(1), '1'))"
POSITIONED = CHANGES + f", pos as (select *, {_SET} as change_set_id, row_number() over (partition by company_key, product_key order by observed_at, field, {_ID}) - 1 as position from changes)"

ORACLES = {
    "h1_record_facts": f"""
        with {OBSERVATIONS}, f as (select * replace (strftime(date_trunc('hour', observed_at), '%Y-%m-%d %H:%M:%S') as snapshot_id) from obs),
        stored as (select snapshot_id, company_key, field, arg_min(struct_pack(value, disclosure_status, observed_at), id) as s from f where id % 2 = 0 group by all),
        new as (select *, first_value(id) over w as f_id, first_value(struct_pack(value, disclosure_status, observed_at)) over w as f_s from f where id % 2 = 1 window w as (partition by snapshot_id, company_key, field order by id)),
        held as (select n.*, case when s.s is not null then s.s when n.id <> n.f_id then n.f_s end as h from new n left join stored s using (snapshot_id, company_key, field))
        select id, case when h is null then 'insert' when diverges = '' then 'replay' else 'divergent' end as action, diverges from (
          select id, h, case when h is null then '' else concat_ws(',', case when disclosure_status is distinct from h.disclosure_status then 'disclosure_status' end, case when observed_at is distinct from h.observed_at then 'observed_at' end, case when value is distinct from h.value then 'value' end) end as diverges from held)
    """,
    "h2_current_facts": f"with {OBSERVATIONS} select company_key, field, id, value, disclosure_status, observed_at from obs qualify row_number() over (partition by company_key, field order by observed_at desc, snapshot_id desc) = 1",
    "h3_read_current": f"with {OBSERVATIONS}, c as (select * from obs qualify row_number() over (partition by company_key, field order by observed_at desc, snapshot_id desc) = 1) select company_key, field, id, value from c where field in ('click', 'error') and company_key in (select company_key from obs where try_cast(value as double) > 99)",
    "h4_fact_changes": f"with {CHANGES} select company_key, field, change_type, p_value as previous_value, value as current_value, p_id as previous_id, snapshot_id as current_id, observed_at as detected_at from changes",
    "h4_incremental": f"with {CHANGES} select company_key, field, change_type, p_id as previous_id, snapshot_id as current_id from changes where observed_at >= timestamp '2024-01-20'",
    "h5_tolerant_changes": f"""
        with {OBSERVATIONS}, f as (select *, floor(try_cast(value as double)) as v from obs),
        pairs as (select *, lag(id) over w as p_id, lag(v) over w as p_v from f window w as (partition by company_key, field order by observed_at, id))
        select company_key, field, case when p_v is null then 'disclosed' when v is null then 'not_disclosed' when id % 2 = 0 or p_id % 2 = 0 then 'changed' when v > p_v then 'increased' else 'decreased' end as change_type, p_id as previous_id, id as current_id
        from pairs where p_id is not null and v is distinct from p_v
    """,
    "h6_change_types": f"with {CHANGES} select field, change_type, count(*) as n from changes group by all",
    "h7_latest_confirmation": f"with {CHANGES} select company_key, field, sum(epoch_us(observed_at) - epoch_us(p_at))::bigint as age_us, count(*) as n from changes group by all",
    "h8_change_shapes": f"with {CHANGES} select change_type, count(*) as n_ok, 0::bigint as n_bad from changes group by all",
    "h9_change_sets": f"with {CHANGES} select {_SET} as change_set_id, company_key, count(*) as n from changes group by all",
    "h10_positions": f"with {POSITIONED} select company_key, field, snapshot_id as current_id, position::integer as position from pos",
    "h11_change_sets_built": f"with {POSITIONED} select company_key, true as consistent, count(*)::integer as n, string_agg(snapshot_id::varchar, ',' order by position) as current_ids from pos group by all",
    "h11_change_set_pages": f"with {POSITIONED} select company_key, position // 20 as page, count(*)::integer as n, string_agg(snapshot_id::varchar, ',' order by position) as current_ids from pos group by all",
    "h12_citations": f"with {POSITIONED} select change_set_id, side, snapshot_id, min(position)::integer as position from (select change_set_id, 'current' as side, snapshot_id, position from pos union all select change_set_id, 'previous', p_id, position from pos) group by all",
    "h13_changes_for_snapshots": f"with {CHANGES} select company_key, company as subject_company, field, snapshot_id as current_id from changes where field = 'error'",
    "h13_changes_for_sets": f"with {POSITIONED} select change_set_id, company as subject_company, field, position::integer as position, snapshot_id as current_id from pos qualify count(*) over (partition by change_set_id) > 60",
    "h14_field_history": f"with {OBSERVATIONS} select company_key, field, id, (row_number() over (partition by company_key, field order by observed_at, id) - 1)::integer as position from obs qualify row_number() over (partition by company_key, field order by observed_at desc, id desc) > 1",
    "h15_intervals": f"""
        with {OBSERVATIONS}, f as (select *, floor(try_cast(value as double) / 20)::bigint::varchar as v from obs),
        s as (select * from f window w as (partition by company_key, field order by observed_at, id) qualify lag(id) over w is null or v is distinct from lag(v) over w or disclosure_status is distinct from lag(disclosure_status) over w)
        select company_key, field, v as value, disclosure_status, observed_at as valid_from, lead(observed_at) over (partition by company_key, field order by observed_at, id) as valid_to from s
    """,
    "h15_as_of": f"""
        with {OBSERVATIONS}, facts as (select company_key, observed_at, id, value, disclosure_status from obs where field = 'purchase' qualify row_number() over (partition by company_key, observed_at order by id desc) = 1)
        select o.id as event_id, f.value, f.disclosure_status from obs o asof left join facts f on o.company_key = f.company_key and o.observed_at >= f.observed_at
    """,
}
