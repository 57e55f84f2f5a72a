"""Queries whose scenarios reach every gate and the number rules, stored tables, and SQL for queries of other modules."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from chronofact.functions.text import filter_value
from chronofact.operators import claims as c
from chronofact.operators import gates as g
from chronofact.operators import history as h
from chronofact.plans.evidence_queries import TURNS, _name
from chronofact.plans.facts_queries import CHANGES
from chronofact.session import shared_folder
from chronofact.plans.tables import FETCHED, fetched, observations, read
from chronofact.sources import sinks
from chronofact.sources.state import KeyedState


def _line_candidates(spark, sf_dir):
    """Line items as candidates of their order's text: a quantity quoted as a price or, in thousands, as a context size.

    Taxes and discounts decide what is wrong: a value missing, another number quoted, a line left out of the text, a
    price withheld; lines of one kind in an order conflict, repeat each other or quote each other's numbers.
    """
    n, tax, off = F.col("l_quantity").cast("int").cast("string"), F.round(F.col("l_tax") * 100), F.round(F.col("l_discount") * 100)
    kind = F.when(F.month("l_shipdate") == 1, F.lit("colour")).when(F.col("l_returnflag") == "A", F.lit("input_price_usd"))
    kind = kind.when(F.col("l_returnflag") == "N", F.lit("context_window")).otherwise(F.lit("output_price_usd"))
    hidden = off == 0
    size = F.concat(n, F.when(kind == "context_window", F.lit("K")).otherwise(F.lit("")))
    quoted = F.when(tax == 2, F.lit("many")).otherwise(size)
    quote = F.when(hidden, F.lit("Input pricing has not been announced")).otherwise(F.concat(F.lit("Line lists "), quoted, F.lit(" units by "), F.col("l_linenumber").cast("string")))
    lines = read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("snapshot_id"),
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_extendedprice").cast("decimal(20,2)")).alias("cand_pos"),
        kind.alias("field"),
        F.when(~hidden & (tax != 8), size).alias("value"),
        F.when(hidden, F.lit("not_disclosed")).otherwise(F.lit("disclosed")).alias("disclosure_status"),
        quote.alias("quoted_span"),
        (F.lit(1.0) - off / 20).alias("confidence"),
        tax.alias("tax"),
    )
    snaps = lines.groupBy("snapshot_id").agg(F.array_join(F.array_sort(F.collect_set(F.when(F.col("tax") != 1, F.col("quoted_span")))), ". ").alias("content_text"))
    return lines.drop("tax"), snaps


def g12_number_gates(spark, sf_dir):
    """Gates over line items; among others conflicts, contamination, duplicates and values supported by numbers."""
    return g.gate_facts(*_line_candidates(spark, sf_dir)).select("snapshot_id", "cand_pos", "field", "value", F.coalesce("reason", F.lit("accepted")).alias("reason"))


def d4_number_claims(spark, sf_dir):
    """Claims of all changes against texts of the events they cite; texts before six o'clock give whole numbers only."""
    facts = observations(spark, sf_dir)
    claims = c.draft_claims(h.detect_changes(facts)).withColumnRenamed("id", "claim_id")
    value = F.when(F.hour("observed_at") < 6, F.floor(F.col("value").cast("double")).cast("string")).otherwise(F.col("value"))
    texts = facts.select("snapshot_id", F.concat_ws(" ", "company", F.lit("reports"), value).alias("content_text"))
    checked = c.validate_claims(claims.select("claim_id", "text", "citations", F.col("current.snapshot_id").alias("current_id"), "field"), texts)
    return checked.select("current_id", "field", "citations_exist", "numbers_grounded", "validation_status")


def p13_filters(spark, sf_dir):
    """Sources as filter values: trimmed, nothing for blanks."""
    return read(spark, sf_dir, "documents").select("doc_id", filter_value(F.concat(F.lit("  "), F.coalesce("source", F.lit("")), F.lit(" "))).alias("source"))


def s6_append(spark, sf_dir):
    """Orders appended to a stored table by status, one status after another and the first once more, and read back."""
    path = f"{shared_folder(spark)}/append-{uuid.uuid4().hex}"
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"))
    for status in ("F", "O", "P", "F"):
        sinks.append_new(orders.where(F.col("o_orderstatus") == status), path, ["o_orderkey"])
    return spark.read.parquet(path).groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.sum("cents").alias("cents"))


def s6_guarded_upsert(spark, sf_dir):
    """Documents as items upserted in four batches: early ones, late ones, these again, and then those between, which are
    late and move only items that nothing newer holds. An item keeps the time of its first row and moves to greater tuples."""
    table = KeyedState(spark, f"{shared_folder(spark)}/state-{uuid.uuid4().hex}", ["dedupe_key"], ["fetched_at", "raw_index"], ["first_fetched_at"])
    docs = fetched(spark, sf_dir).select("dedupe_key", F.col("fetched_at").alias("first_fetched_at"), "fetched_at", "raw_index", "content_hash", "publisher", "language")
    third = F.ntile(3).over(Window.orderBy("day"))
    days = docs.select(F.date_trunc("minute", "fetched_at").alias("day")).distinct().withColumn("part", third)
    parts = docs.withColumn("day", F.date_trunc("minute", "fetched_at")).join(days, "day")
    for no, part in enumerate((1, 3, 3, 2)):
        table.upsert(parts.where(F.col("part") == part).drop("day", "part"), no)
    return table.read().select("dedupe_key", F.unix_seconds("first_fetched_at").alias("first_s"), "raw_index", "content_hash", "publisher", "language")


QUERIES = {q.__name__: q for q in (g12_number_gates, d4_number_claims, p13_filters, s6_append, s6_guarded_upsert)}

_NUMBERS = r"list_distinct(regexp_extract_all({}, '[0-9]+(?:\.[0-9]+)?'))"
TITLES = f"""
    words as (
      select doc_id as id, list_distinct_in_order as w, doc_id * 60 as s, (doc_id * 60) // (72 * 3600) as t from (
        select doc_id, list_filter(ws, lambda x, i: x <> '' and list_position(ws, x) = i) as list_distinct_in_order from (
          select doc_id, string_split({_name("array_to_string(regexp_split_to_array(trim(coalesce(text, '')), '\\s+')[1:12], ' ')")}, ' ') as ws from documents)
      ) where len(list_distinct_in_order) > 0
    ),
    classes as (select w, t, min(id) as id, min(s) as first_s, max(s) as last_s from words group by w, t),
    alike as (
      select least(x.id, y.id) as a, greatest(x.id, y.id) as b from classes x join classes y on x.id < y.id and abs(x.t - y.t) <= 1
      where (x.t = y.t or greatest(x.first_s - y.last_s, y.first_s - x.last_s) <= 72 * 3600)
        and len(list_intersect(x.w, y.w)) / len(list_distinct(list_concat(x.w, y.w))) >= 0.6
    )
"""
ORACLES = {
    "g12_number_gates": f"""
        with lines as (
          select l_orderkey as snapshot_id, concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice::decimal(20,2)) as cand_pos,
                 l_linenumber::varchar as line, l_quantity::int::varchar as n, round(l_tax * 100) as tax, round(l_discount * 100) as off,
                 case when month(l_shipdate) = 1 then 'colour' when l_returnflag = 'A' then 'input_price_usd' when l_returnflag = 'N' then 'context_window_tokens' else 'output_price_usd' end as field
          from lineitem
        ), c0 as (
          select *, off = 0 as hidden, n || case when field = 'context_window_tokens' then 'K' else '' end as size from lines
        ), c1 as (
          select *, case when hidden or tax = 8 then null when field = 'context_window_tokens' then n || '000' else size end as value,
                 case when hidden then 'Input pricing has not been announced' else 'Line lists ' || case when tax = 2 then 'many' else size end || ' units by ' || line end as quote,
                 hidden or tax <> 8 as shape,
                 case when hidden then [] when tax = 2 or size like '%K' then [line] else list_distinct([n, line]) end as plain,
                 case when hidden then [] when tax = 2 then [line] when size like '%K' then [n || '000', line] else list_distinct([n, line]) end as spoken
          from c0
        ), conflicts as (
          select snapshot_id, field from c1 where shape group by all having count(distinct struct_pack(value, hidden)) > 1
        ), mixed as (
          select distinct a.snapshot_id, a.cand_pos from c1 a join c1 b on a.snapshot_id = b.snapshot_id and a.field <> b.field
          where a.shape and b.shape and b.value is not null and list_contains(a.plain, b.value)
        ), content as (
          select snapshot_id, list(distinct quote) filter (where tax <> 1) as quotes from c1 group by snapshot_id
        ), judged as (
          select c1.*, case when not shape then 'bad_shape' when k.field is not null then 'conflicting_candidates' when m.cand_pos is not null then 'ambiguous_attribution'
                 when c1.field = 'colour' then 'unknown_field' when 1 - off / 20 < 0.6 then 'low_confidence'
                 when not exists (select 1 from (select unnest(quotes) as q) where starts_with(q, quote)) then 'ungrounded_span'
                 when value is not null and not list_contains(spoken, value) then 'value_not_in_quote'
                 when value is null and c1.field <> 'input_price_usd' then 'non_disclosure_not_supported' end as reason0
          from c1 left join conflicts k on k.snapshot_id = c1.snapshot_id and k.field = c1.field
          left join mixed m on m.snapshot_id = c1.snapshot_id and m.cand_pos = c1.cand_pos join content on content.snapshot_id = c1.snapshot_id
        )
        select snapshot_id, cand_pos, field, value,
               case when reason0 is not null then reason0 when row_number() over (partition by snapshot_id, field, value, hidden, reason0 is null order by cand_pos) > 1 then 'duplicate' else 'accepted' end as reason
        from judged
    """,
    "d4_number_claims": f"""
        with {CHANGES}, texts as (
          select id, concat_ws(' ', company, 'reports', case when hour(observed_at) < 6 then floor(try_cast(value as double))::bigint::varchar else value end) as content from obs
        ), claims as (
          select snapshot_id as current_id, p_id, field, concat_ws(' ', company, case when change_type in ('increased', 'decreased', 'changed', 'disclosed') then value end, case when change_type <> 'disclosed' then p_value end) as text from changes
        )
        select current_id, field, true as citations_exist, list_has_all({_NUMBERS.format("a.content || ' ' || b.content")}, {_NUMBERS.format("text")}) as numbers_grounded,
               case when numbers_grounded then 'supported' else 'unsupported' end as validation_status
        from claims join texts a on a.id = current_id join texts b on b.id = p_id
    """,
    "p13_filters": "select doc_id, nullif(trim(coalesce(source, '')), '') as source from documents",
    "s6_guarded_upsert": f"""
        with {FETCHED}, days as (select day, ntile(3) over (order by day) as part from (select distinct date_trunc('minute', fetched_at) as day from docs)),
        b as (select docs.*, case part when 1 then 0 when 3 then 1 else 3 end as no from docs join days on day = date_trunc('minute', fetched_at)),
        firsts as (select dedupe_key, arg_min(fetched_at, struct_pack(no, fetched_at, raw_index)) as first_at, max(struct_pack(fetched_at, raw_index)) as last from b group by all)
        select dedupe_key, epoch(first_at)::bigint as first_s, raw_index, content_hash, publisher, language from firsts join docs using (dedupe_key) where struct_pack(docs.fetched_at, docs.raw_index) = last
    """,
    "s6_append": "select o_orderstatus, count(*) as n, sum(round(o_totalprice * 100)::bigint)::bigint as cents from orders group by all",
    "a1_latest_pointers": f"""
        with {FETCHED}, s as (select dedupe_key, content_hash, min(raw_index) as raw_index from docs group by all), latest as (select dedupe_key, max(raw_index) as raw_index from s group by all)
        select 'latest_pointer' as audit, count(*) as n from latest where raw_index % 4 = 0 having n > 0
    """,
    "d4_validation": f"""
        with {TURNS}, said as (select claim_id, unnest(cites) as s from cl), held as (select claim_id, string_agg(t.text, ' ') as content from said join t on t.conv_id || '-' || t.turn = s group by all)
        select claim_id, good as citations_exist, good and list_has_all({_NUMBERS.format("coalesce(content, '')")}, {_NUMBERS.format("text")}) as numbers_grounded, case when numbers_grounded then 'supported' else 'unsupported' end as validation_status
        from ok join cl using (claim_id) left join held using (claim_id)
    """,
    "d11_published": f"with {TURNS} select conv_id as digest_date, case when conv_id % 9 = 0 then 'published' else status end as status from dig",
    "u4_networks": """
        select case when event_id % 9 = 0 then '2001:db8:' || case when event_id % 64 = 0 then '' else lower(to_hex(event_id % 64)) || ':' end || ':/56'
                    else '10.' || event_id % 7 || '.' || event_id % 5 || '.0/24' end as network, count(*) as n
        from events group by all
    """,
    "u6_emails": """
        select case event_id % 10 when 0 then null when 1 then 'User' || user_id || '@example.org' when 2 then null else 'user' || user_id || '@xn--bcher-kva.example' end as email, count(*) as n
        from events group by all
    """,
    "z1_similar_titles": f"with {TITLES} select a, b from alike",
    "z2_event_groups": f"""
        with recursive {TITLES}, links as (
          select a, b from alike union select b, a from alike union select c.id, w.id from words w join classes c on c.w = w.w and c.t = w.t where c.id <> w.id
          union select w.id, c.id from words w join classes c on c.w = w.w and c.t = w.t where c.id <> w.id
        ), reached as (select doc_id as id, doc_id as other from documents union select r.id, l.b from reached r join links l on l.a = r.other)
        select id, min(other) as event_id from reached group by id
    """,
}
