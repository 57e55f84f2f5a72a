"""Queries of versioning, feeds and selections, over documents, pages, orders and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronofact.functions import text as t
from chronofact.functions import urls as u
from chronofact.operators import feeds as f
from chronofact.operators import versioning as v
from chronofact.plans.tables import FETCHED, fetched, read

_EPOCH = 1704067200


def p1_canonical_urls(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", "url").withColumn("c", u.canonical_url(F.col("url"))).select("page_id", F.col("c.url").alias("canonical_url"), F.col("c.reason").alias("reason"))


def p3_dedupe_keys(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", t.digest_key(u.canonical_url(F.col("url"))["url"]).alias("dedupe_key"))


def p2_tracking_params(spark, sf_dir):
    """Query parameters of all pages by name, with their kind."""
    q = F.regexp_extract("url", r"\?([^#]*)", 1)
    name = F.explode(F.transform(F.filter(F.split(q, "&"), lambda x: x != ""), lambda x: F.substring_index(x, "=", 1)))
    return read(spark, sf_dir, "pages").select(name.alias("name")).groupBy("name").agg(F.count("*").alias("n")).withColumn("tracking", u.is_tracking_param(F.col("name")))


def p4_contents(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    return docs.select("doc_id", t.digest_key(t.normalized_content(F.col("source"), F.col("text"))).alias("content_hash"))


def p9_sanitized_urls(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", u.sanitize_url(F.col("url")).alias("url"))


def p8_url_safety(spark, sf_dir):
    """Urls by reason why they are unsafe for a source that lists one of its hosts."""
    hosts = F.array(F.lit("Spam-farm.example.org"), F.lit("tionsh.example.net"))
    return read(spark, sf_dir, "pages").select("page_id", F.coalesce(u.unsafe_reason(F.col("url"), hosts), F.lit("safe")).alias("reason"))


def p10_names(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.sha2(t.normalise_name(F.coalesce("text", F.lit(""))), 256).alias("name_sha256"))


def p12_claim_texts(spark, sf_dir):
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", t.normalise_claim_text(F.col("text")).alias("text"))


def p17_values(spark, sf_dir):
    """Prices, integers and context sizes read from the values of orders and their parts."""
    o = read(spark, sf_dir, "orders")
    price = F.concat(F.lit("$"), F.col("o_totalprice").cast("decimal(18,2)").cast("string"))
    return o.select("o_orderkey", t.parse_price(price).cast("double").alias("price"), t.parse_int(F.col("o_custkey").cast("string")).cast("long").alias("cust"), t.context_value(F.concat(F.col("o_custkey").cast("string"), F.lit("K"))).alias("context"))


def p11_field_labels(spark, sf_dir):
    name = F.when(F.col("event_type") == "click", F.lit("context_window")).otherwise(F.concat(F.col("event_type"), F.lit("_rate")))
    field = t.canonical_field(name)
    return read(spark, sf_dir, "events").groupBy(t.field_label(field).alias("label")).agg(F.count("*").alias("n"))


def c1_items(spark, sf_dir):
    docs = fetched(spark, sf_dir)
    return v.upsert_items(None, docs).select("dedupe_key", F.unix_seconds(F.col("first_fetched_at")).alias("first_fetched"), "created")


def c1_items_upserted(spark, sf_dir):
    """The second half of the documents upserted into the items of the first."""
    docs = fetched(spark, sf_dir)
    return v.upsert_items(v.upsert_items(None, docs.where("raw_index % 2 = 0")), docs.where("raw_index % 2 = 1")).select("dedupe_key", F.unix_seconds(F.col("first_fetched_at")).alias("first_fetched"), "created")


def _snapshots(spark, sf_dir):
    docs = fetched(spark, sf_dir).withColumn("item_id", v.item_id())
    return v.add_snapshots(None, docs)


def c2_snapshots(spark, sf_dir):
    return _snapshots(spark, sf_dir).select("dedupe_key", "content_hash", "raw_index")


def c3_latest(spark, sf_dir):
    docs = fetched(spark, sf_dir)
    items = v.upsert_items(None, docs)
    return v.advance_latest(items, v.add_snapshots(None, docs.withColumn("item_id", v.item_id()))).select("dedupe_key", F.unix_seconds("latest_fetched_at").alias("latest_fetched"), "publisher", "language", "advanced")


def c4_ingest_outcomes(spark, sf_dir):
    """Outcomes of the second half of the documents, ingested after the first."""
    docs = fetched(spark, sf_dir)
    items, snapshots, _ = v.ingest(None, None, docs.where("raw_index % 2 = 0"))
    _, _, outcomes = v.ingest(items, snapshots, docs.where("raw_index % 2 = 1"))
    return outcomes.select("raw_index", "item_created", "snapshot_created", "advanced")


def c5_history(spark, sf_dir):
    return v.snapshot_history(_snapshots(spark, sf_dir)).select("dedupe_key", "raw_index", "revision", "previous_hash", F.unix_seconds("next_fetched_at").alias("next_fetched"))


def c6_collapse(spark, sf_dir):
    return v.item_identity_collapse(read(spark, sf_dir, "pages").select(F.col("url").alias("raw_url"))).select("canonical_url", "links", "variants", "dedupe_key")


def _windows(spark, sf_dir):
    days = read(spark, sf_dir, "events").select(F.to_date("ts").alias("digest_date")).distinct()
    since = F.when(F.dayofmonth("digest_date") % 3 == 0, F.lit("36h")).when(F.dayofmonth("digest_date") % 3 == 1, F.lit("2d"))
    return f.with_windows(days.withColumn("since", since))


def f1_windows(spark, sf_dir):
    return _windows(spark, sf_dir).select("digest_date", "since", F.unix_seconds("window_start").alias("start_s"), F.unix_seconds("window_end").alias("end_s"), "ok")


def _event_windows(spark, sf_dir):
    w = _windows(spark, sf_dir)
    return w.select(F.col("digest_date").alias("window_id"), F.col("window_start").cast("timestamp_ntz").alias("window_start"), F.col("window_end").cast("timestamp_ntz").alias("window_end"))


def f2_window_selection(spark, sf_dir):
    ev = read(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("ts").alias("fetched_at"))
    return f.select_for_windows(ev, _event_windows(spark, sf_dir), 5).select("window_id", "id", "rank")


def f9_capped_rows(spark, sf_dir):
    ev = read(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("ts").alias("fetched_at"))
    return f.capped_rows(ev, _event_windows(spark, sf_dir), 5).groupBy("window_id").agg(F.count("*").alias("n"), F.min("id").alias("first_id"))


def f3_selection(spark, sf_dir):
    items = read(spark, sf_dir, "events").select(F.col("user_id").alias("item_id")).distinct()
    ev = read(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("item_id"), F.col("ts").alias("fetched_at"))
    a, b = (F.lit(x).cast("timestamp_ntz") for x in ("2024-01-05", "2024-01-09"))
    return f.select_snapshots(items, ev, a, b, limit=500).select("id", "item_id")


def f4_feed_page(spark, sf_dir):
    """A page of urgent orders behind a cursor."""
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_orderpriority", "o_totalprice")
    first = f.keyset_feed(o.select("o_orderkey", "o_orderdate", "o_orderpriority"), "o_orderdate", "o_orderkey", 40, where=F.col("o_orderpriority").startswith("1"))
    last = first.where("position = 20").first()
    page = f.keyset_feed(o, "o_orderdate", "o_orderkey", 20, after=(last["o_orderdate"], last["o_orderkey"]), where=F.col("o_orderpriority").startswith("1"))
    return page.select("o_orderkey", F.unix_seconds(F.col("o_orderdate").cast("timestamp")).alias("ordered"), "position", "has_more")


def f5_changes_feed(spark, sf_dir):
    """A page of events as changes, joined to their users."""
    ev = read(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("ts").alias("detected_at"), F.col("user_id").alias("company_key"), F.col("user_id").alias("product_key"), F.col("event_type").alias("field"))
    subjects = ev.select("company_key", "product_key").distinct().withColumn("company", F.concat(F.lit("Company "), F.col("company_key").cast("string")))
    a, b = (F.lit(x).cast("timestamp_ntz") for x in ("2024-01-02", "2024-01-20"))
    return f.changes_feed(ev, subjects, 50, detected_from=a, detected_to=b, field="click").select("id", "company", "position", "has_more")


def f6_digests_feed(spark, sf_dir):
    """A page of finished orders as published digests."""
    o = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.to_date("o_orderdate").alias("digest_date"), F.when(F.col("o_orderstatus") == "F", F.lit("published")).otherwise(F.lit("draft")).alias("status"))
    return f.digests_feed(o, 30, date_to=F.lit("1996-06-01").cast("date")).select("id", "digest_date", "position", "has_more")


def f7_pages(spark, sf_dir):
    return f.paginate_all(read(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate", "o_orderkey", 20).select("o_orderkey", "position", "page")


def f8_latest_published(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.to_date("o_orderdate").alias("digest_date"), F.when(F.col("o_orderstatus") == "F", F.lit("published")).otherwise(F.lit("draft")).alias("status"))
    return f.latest_published(o).select("id", "digest_date")


def f8_published_by_date(spark, sf_dir):
    """The published digests of the day with the last finished order."""
    o = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.to_date("o_orderdate").alias("digest_date"), F.when(F.col("o_orderstatus") == "F", F.lit("published")).otherwise(F.lit("draft")).alias("status"))
    last = f.latest_published(o).select(F.col("digest_date").alias("last_date"))
    return f.published_by_date(o.join(last, F.col("digest_date") == F.col("last_date")), F.col("last_date")).select("id", "digest_date")


QUERIES = {q.__name__: q for q in (p1_canonical_urls, p2_tracking_params, p3_dedupe_keys, p4_contents, p8_url_safety, p9_sanitized_urls, p10_names, p11_field_labels, p12_claim_texts, p17_values, c1_items, c1_items_upserted, c2_snapshots, c3_latest, c4_ingest_outcomes, c5_history, c6_collapse, f1_windows, f2_window_selection, f3_selection, f4_feed_page, f5_changes_feed, f6_digests_feed, f7_pages, f8_latest_published, f8_published_by_date, f9_capped_rows)}

#: Urls of the pages have plain hosts and at most the parameters page, ref and utm_source.
CANONICAL = r"""
    canon as (
      select page_id, url, regexp_replace(regexp_replace(split_part(split_part(url, '#', 1), '?', 1), '(://[^/]+/.*[^/])/+$', '\1'), '(://[^/]+)/+$', '\1/')
             || case when len(kept) > 0 then '?' || array_to_string(list_sort(kept), '&') else '' end as c
      from (select page_id, url, list_filter(string_split(split_part(split_part(url, '#', 1), '?', 2), '&'), lambda x: x <> '' and not regexp_matches(x, '^(utm_.*|ref|source)=')) as kept from pages)
    )
"""
_SPACE = r"[\s\x0B\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
WINDOWS = """
    w as (
      select d as window_id, since, e - case when since is null then interval 24 hour when since = '36h' then interval 36 hour else interval 48 hour end as s, e from (
        select distinct ts::date as d, case ts::date - date_trunc('month', ts)::date + 1 when null then null else case (day(ts)) % 3 when 0 then '36h' when 1 then '2d' end end as since, (ts::date + 1)::timestamp as e from events)
    ),
    hit as (select window_id, event_id as id, row_number() over (partition by window_id order by ts, event_id) as rank from events join w on ts >= s and ts < e)
"""
ORACLES = {
    "p1_canonical_urls": f"with {CANONICAL} select page_id, c as canonical_url, null::varchar as reason from canon",
    "p3_dedupe_keys": f"with {CANONICAL} select page_id, 'sha256:' || sha256(c) as dedupe_key from canon",
    "p2_tracking_params": "select name, count(*) as n, name like 'utm_%' or name in ('ref', 'source') as tracking from (select split_part(unnest(list_filter(string_split(split_part(split_part(url, '#', 1), '?', 2), '&'), lambda x: x <> '')), '=', 1) as name from pages) group by name",
    "p4_contents": f"select doc_id, 'sha256:' || sha256(concat_ws(chr(10) || chr(10), nullif(trim(regexp_replace(coalesce(source, ''), '{_SPACE}', ' ', 'g')), ''), nullif(trim(regexp_replace(coalesce(text, ''), '{_SPACE}', ' ', 'g')), ''))) as content_hash from documents",
    "p8_url_safety": "select page_id, case when not starts_with(url, 'https:') then 'scheme is not https' when split_part(split_part(split_part(split_part(url, '://', 2), '/', 1), '?', 1), '#', 1) in ('spam-farm.example.org', 'tionsh.example.net') then 'safe' else 'host not on the allowlist' end as reason from pages",
    "p9_sanitized_urls": "select page_id, split_part(split_part(url, '#', 1), '?', 1) as url from pages",
    "p10_names": r"select doc_id, sha256(trim(regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}_]+', ' ', 'g'))) as name_sha256 from documents",
    "p12_claim_texts": f"select conv_id, turn, trim(regexp_replace(lower(text), '{_SPACE}', ' ', 'g')) as text from conversations",
    "p17_values": "select o_orderkey, o_totalprice::decimal(18,2)::double as price, o_custkey as cust, case when o_custkey > 0 then (o_custkey * 1000)::varchar end as context from orders",
    "p11_field_labels": "select case when event_type = 'click' then 'context window' else event_type || ' rate' end as label, count(*) as n from events group by all",
    "c1_items": f"with {FETCHED} select dedupe_key, min(epoch(fetched_at))::bigint as first_fetched, true as created from docs group by all",
    "c1_items_upserted": f"with {FETCHED}, a as (select dedupe_key, min(epoch(fetched_at))::bigint as f from docs where raw_index % 2 = 0 group by all), b as (select dedupe_key, min(epoch(fetched_at))::bigint as f from docs where raw_index % 2 = 1 group by all) select dedupe_key, f as first_fetched, false as created from a union all select dedupe_key, f, true from b where dedupe_key not in (select dedupe_key from a)",
    "c2_snapshots": f"with {FETCHED} select dedupe_key, content_hash, min(raw_index) as raw_index from docs group by all",
    "c3_latest": f"with {FETCHED}, s as (select dedupe_key, content_hash, min(raw_index) as raw_index from docs group by all) select dedupe_key, epoch(fetched_at)::bigint as latest_fetched, publisher, language, true as advanced from docs where raw_index in (select max(raw_index) from s group by dedupe_key)",
    "c4_ingest_outcomes": f"""
        with {FETCHED}, a as (select * from docs where raw_index % 2 = 0), b as (select * from docs where raw_index % 2 = 1),
        latest_a as (select dedupe_key, max(first_at) as m from (select dedupe_key, content_hash, min(raw_index) as first_at from a group by all) group by all),
        new as (select dedupe_key, content_hash, min(raw_index) as first_at from b where (dedupe_key, content_hash) not in (select (dedupe_key, content_hash) from a) group by all),
        top as (select dedupe_key, max(first_at) as m from new group by all)
        select b.raw_index, b.dedupe_key not in (select dedupe_key from a) and b.raw_index = min(b.raw_index) over (partition by b.dedupe_key) as item_created, n.first_at is not null as snapshot_created,
               coalesce(n.first_at = top.m and (latest_a.m is null or top.m > latest_a.m), false) as advanced
        from b left join new n on n.dedupe_key = b.dedupe_key and n.content_hash = b.content_hash and n.first_at = b.raw_index left join top on top.dedupe_key = b.dedupe_key left join latest_a on latest_a.dedupe_key = b.dedupe_key
    """,
    "c5_history": f"with {FETCHED}, s as (select dedupe_key, content_hash, min(raw_index) as raw_index, min(fetched_at) as fetched_at from docs group by all) select dedupe_key, raw_index, (row_number() over w)::integer as revision, lag(content_hash) over w as previous_hash, epoch(lead(fetched_at) over w)::bigint as next_fetched from s window w as (partition by dedupe_key order by fetched_at)",
    "c6_collapse": f"with {CANONICAL} select c as canonical_url, count(*) as links, count(distinct url) as variants, 'sha256:' || sha256(c) as dedupe_key from canon group by c",
    "f1_windows": f"with {WINDOWS} select window_id as digest_date, since, epoch(s)::bigint as start_s, epoch(e)::bigint as end_s, true as ok from w",
    "f2_window_selection": f"with {WINDOWS} select window_id, id, rank::integer as rank from hit where rank <= 5",
    "f9_capped_rows": f"with {WINDOWS} select window_id, count(*) as n, min(id) as first_id from hit where rank > 5 group by all",
    "f3_selection": "select event_id as id, user_id as item_id from events where ts >= timestamp '2024-01-05' and ts < timestamp '2024-01-09' order by ts, event_id limit 500",
    "f4_feed_page": "with o as (select *, row_number() over (order by o_orderdate desc, o_orderkey desc) as rn, count(*) over () as n from orders where o_orderpriority like '1%') select o_orderkey, epoch(o_orderdate)::bigint as ordered, (rn - 20)::integer as position, n > 40 as has_more from o where rn between 21 and 40",
    "f5_changes_feed": "with o as (select *, row_number() over (order by ts desc, event_id desc) as rn, count(*) over () as n from events where event_type = 'click' and ts >= timestamp '2024-01-02' and ts < timestamp '2024-01-20') select event_id as id, 'Company ' || user_id as company, rn::integer as position, n > 50 as has_more from o where rn <= 50",
    "f6_digests_feed": "with o as (select *, row_number() over (order by o_orderdate::date desc, o_orderkey desc) as rn, count(*) over () as n from orders where o_orderstatus = 'F' and o_orderdate::date < date '1996-06-01') select o_orderkey as id, o_orderdate::date as digest_date, rn::integer as position, n > 30 as has_more from o where rn <= 30",
    "f7_pages": "select o_orderkey, row_number() over (order by o_orderdate desc, o_orderkey desc) - 1 as position, ((row_number() over (order by o_orderdate desc, o_orderkey desc) - 1) // 20 + 1)::bigint as page from orders",
    "f8_published_by_date": "select o_orderkey as id, o_orderdate::date as digest_date from orders where o_orderstatus = 'F' and o_orderdate::date = (select max(o_orderdate::date) from orders where o_orderstatus = 'F')",
    "f8_latest_published": "select o_orderkey as id, o_orderdate::date as digest_date from orders where o_orderstatus = 'F' order by o_orderdate::date desc, o_orderkey desc limit 1",
}
