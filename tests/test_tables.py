"""Versioning, feeds, audits, reports, subscriptions, sources and streams."""

from datetime import datetime, timedelta

import pyarrow as pa
from pyspark.sql import functions as F

from chronofact.operators import audits as a
from chronofact.operators import evaluate as e
from chronofact.operators import feeds as f
from chronofact.operators import grouping as gr
from chronofact.operators import reports as q
from chronofact.operators import subscriptions as s
from chronofact.operators import versioning as v
from chronofact.operators.ordered import with_previous
from chronofact.plans.tables import observations
from chronofact.sources import articles, sinks
from chronofact.sources.articles import extract_articles
from chronofact.sources.feeds import parse_feeds, read_feed_entries
from chronofact.sources.registry import due_sources, read_contract, read_sources, source_problems
from chronofact.streaming import jobs

T0 = datetime(2024, 1, 1)
DOC = "dedupe_key string, content_hash string, fetched_at timestamp, raw_index int, publisher string, title string"


def docs(spark, rows):
    return spark.createDataFrame([(k, h, T0 + timedelta(hours=t), i, f"p{t}", f"t{t}") for i, (k, h, t) in enumerate(rows)], DOC)


def test_return_to_older_content_makes_no_snapshot_and_late_rows_move_nothing(spark):
    items, new, outcomes = v.ingest(None, None, docs(spark, [("k", "A", 1), ("k", "B", 2), ("k", "A", 3), ("m", "A", 5)]))
    assert new.count() == 3 and items.where("dedupe_key = 'k'").first()["title"] == "t2"
    got = [(r["item_created"], r["snapshot_created"], r["advanced"]) for r in outcomes.orderBy("raw_index").collect()]
    assert got == [(True, True, False), (False, True, True), (False, False, False), (True, True, True)]
    stored, snaps = items.drop("created").cache(), new.cache()
    items2, new2, _ = v.ingest(stored, snaps, docs(spark, [("k", "C", 0), ("m", "D", 9), ("m", "A", 10)]))
    state = {r["dedupe_key"]: (r["title"], r["advanced"]) for r in items2.collect()}
    assert new2.count() == 2 and state == {"k": ("t2", False), "m": ("t9", True)}
    assert [r["revision"] for r in v.snapshot_history(new.where("dedupe_key = 'k'")).orderBy("fetched_at").collect()] == [1, 2]


def test_collapse(spark):
    raw = spark.createDataFrame([("https://x.org/a/?utm_source=f",), ("https://x.org/a",), ("https://x.org/a",), ("bad",), (None,)], "raw_url string")
    assert [(r["canonical_url"], r["links"], r["variants"]) for r in v.item_identity_collapse(raw).collect()] == [("https://x.org/a", 3, 2)]


def test_previous_over_buckets(spark):
    rows = [("k", i, i // 7) for i in range(50)] + [("m", 3, 0), (None, 1, 0), (None, 2, 9)]
    df = spark.createDataFrame(rows, "k string, o int, b int").repartition(4)
    got = {(r["k"], r["o"]): r["p"]["o"] if r["p"] else None for r in with_previous(df, ["k"], ["o"], F.col("b"), {"p": F.struct("o")}).collect()}
    assert got == {("k", i): (i - 1 if i else None) for i in range(50)} | {("m", 3): None, (None, 1): None, (None, 2): 1}


def test_windows_and_pages(spark):
    w = f.with_windows(spark.createDataFrame([("2024-01-02", None), ("2024-01-02", "2d"), ("2024-01-02", "5"), ("2024-01-02", "2024-01-01T12:00:00"), ("2024-01-02", "junk"), ("2024-01-02", "2024-02-01")], "d string, since string").select(F.to_date("d").alias("digest_date"), "since"))
    assert [(r["ok"], r["window_start"] and r["window_start"].isoformat()) for r in w.collect()] == [(True, "2024-01-02T00:00:00"), (True, "2024-01-01T00:00:00"), (True, "2024-01-02T19:00:00"), (True, "2024-01-01T12:00:00"), (False, None), (False, None)]
    rows = spark.createDataFrame([(i, T0 + timedelta(hours=5 * (i // 3))) for i in range(40)] + [(99, None)], "id int, ts timestamp")
    got = [(r["id"], r["page"]) for r in f.paginate_all(rows, "ts", "id", 7).orderBy("position").collect()]
    assert got == [(i, n // 7 + 1) for n, i in enumerate([*range(39, -1, -1), 99])]
    page = f.keyset_feed(rows.where("id < 40"), "ts", "id", 5, after=(T0 + timedelta(hours=10), 7))
    assert [(r["id"], r["has_more"]) for r in page.orderBy("position").collect()] == [(6, True), (5, True), (4, True), (3, True), (2, True)]


def test_audits(spark):
    p = spark.createDataFrame([(1,), (2,)], "id int")
    c = spark.createDataFrame([(1, 1), (2, 3), (3, 3), (4, None)], "c int, fk int")
    assert [(r["key"], r["n"]) for r in a.audit_foreign_key(c, "fk", p, "id", "x").collect()] == [("3", 2)]
    assert [(r["key"], r["n"]) for r in a.audit_unique_key(c, ["fk"], "u").collect()] == [("3", 2)]
    after = spark.createDataFrame([(1, 1), (2, 4), (9, 9)], "c int, fk int")
    assert sorted((r["audit"], r["key"]) for r in a.audit_append_only(c, after, "c").collect()) == [("changed:fk", "2"), ("deleted", "3"), ("deleted", "4")]
    assert sorted(r["key"] for r in a.audit_checks(c, "c", {"small": F.col("fk") < 3}).collect()) == ["2", "3"]


def test_reports(spark):
    src = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    out = spark.createDataFrame([("a", 0, True, True, None), ("a", 1, False, False, "bad"), ("b", 0, False, False, None)], "source_id string, raw_index int, item_created boolean, snapshot_created boolean, reject_reason string")
    r = q.collection_report(src, out)
    assert {x["source_id"]: (x["status"], x["unchanged"], x["failed"]) for x in r.collect()} == {"a": ("partial", 0, 1), "b": ("ok", 1, 0), "c": ("failed", 0, 0)}
    assert q.batch_status(r).first()["status"] == "partial" and q.batch_status(r.limit(0)).first()["status"] == "failed"


def test_evaluation(spark):
    claims = spark.createDataFrame([("d", "A  b", "supported"), ("d", "a B", "unsupported"), ("e", "x", "supported")], "digest_id string, text string, validation_status string")
    got = {(r["digest_id"], r["pooled"]): (r["n_claims"], r["n_unsupported"], round(r["citation_validity"], 3), r["n_repeats"]) for r in e.evaluate(claims).collect()}
    assert got == {("d", False): (2, 1, 0.5, 1), ("e", False): (1, 0, 1.0, 0), (None, True): (3, 1, 0.667, 1)}
    keys = spark.createDataFrame([("A", "P", "f")], "company string, product string, field string")
    assert e.change_recall(keys.limit(0), keys).first()["recall"] == 0.0 and e.change_recall(keys, keys.limit(0)).first()["recall"] == 1.0


def test_subscriptions(spark):
    ev = spark.createDataFrame([(1, 1, "consent_requested", T0), (1, 1, "confirmed", T0 + timedelta(1)), (1, 1, "unsubscribed", T0 + timedelta(2)), (1, 2, "consent_requested", T0 + timedelta(3)), (2, 1, "suppressed", T0), (2, 1, "confirmed", T0 + timedelta(1))], "subscription_id int, consent_generation int, event_type string, occurred_at timestamp")
    got = {r["subscription_id"]: (r["status"], r["consent_generation"], r["confirmed_at"]) for r in s.subscription_state(ev).collect()}
    assert got[1] == ("pending", 2, None) and got[2][0] == "suppressed"
    rq = spark.createDataFrame([(i, "x", T0 + timedelta(minutes=20 * i)) for i in range(7)], "id int, who string, ts timestamp")
    assert [r["allowed"] for r in s.rate_limit(rq, "1 hour", 2, ["who"]).orderBy("id").collect()] == [True, True, False, True, True, False, True]


def test_sources(spark, tmp_path):
    reg = read_sources(spark, [{"id": "a", "publisher": "A", "type": "rss", "url": "https://a.org/f", "priority": 1, "cadence_minutes": 60}, {"id": "a", "url": "http://b.org", "priority": 9, "cadence_minutes": 0}])
    assert reg.first()["allowed_hosts"] == ["a.org"]
    assert sorted({r["problem"] for r in source_problems(reg).collect()}) == ["cadence not positive", "priority out of range", "repeated id", "url is not https"]
    runs = spark.createDataFrame([("a", T0)], "source_id string, finished_at timestamp")
    assert due_sources(reg, runs, F.lit(T0 + timedelta(minutes=30))).count() == 1
    (tmp_path / "t.json").write_text('[{"id": "x", "n": 1}, {"id": "y", "n": null}]')
    assert read_contract(spark, f"file://{tmp_path}/t.json", "id string, n int").count() == 2
    path = f"file://{tmp_path}/snapshots"
    rows = spark.createDataFrame([("x", T0), ("x", T0), ("y", T0)], "id string, at timestamp")
    sinks.append_new(rows, path, ["id"], "at")
    assert spark.read.parquet(path).count() == 2
    sinks.append_new(spark.createDataFrame([("y", T0), ("z", T0)], "id string, at timestamp"), path, ["id"], "at")
    assert spark.read.parquet(path).count() == 3
    sinks.log_metrics(spark.createDataFrame([("m", 1.0)], "metric string, value double"), f"file://{tmp_path}/m", "r1")
    sinks.log_metrics(spark.createDataFrame([("m", 2.0)], "metric string, value double"), f"file://{tmp_path}/m", "r2")
    assert spark.read.parquet(f"file://{tmp_path}/m").count() == 2


def test_feeds(spark, tmp_path):
    rss = '<rss version="2.0" xmlns:dc="x"><channel><title>T</title><item><title> One </title><link>https://a.org/1</link><description>d</description><content:encoded><![CDATA[full <b>text</b>]]></content:encoded><author>A</author><dc:creator>B</dc:creator><author>C</author><category>x</category></item><item><title></title></item></channel></rss>'
    (tmp_path / "alpha.xml").write_text(rss)
    (tmp_path / "bad.xml").write_text("<html><p>no")
    (tmp_path / "dtd.xml").write_text('<!DOCTYPE rss><rss><channel><item><title>x</title></item></channel></rss>')
    got = {(r["source_id"], r["raw_index"]): r for r in read_feed_entries(spark, f"file://{tmp_path}").collect()}
    one = got["alpha", 0]
    assert (one["title"], one["description"], one["authors"], one["categories"]) == ("One", "full <b>text</b>", ["A", "B", "C"], ["x"])
    assert got["alpha", 1]["title"] is None and got["bad", -1]["error"] and got["dtd", -1]["error"]
    assert parse_feeds(spark.createDataFrame([("e", '<rss><channel><title>t</title></channel></rss>')], "source_id string, content string")).count() == 0


def test_articles(spark):
    body = "words " * 20
    pages = [
        f'<html><head><meta property="og:title" content="OG"><link rel="canonical" href="https://a.org/x"><meta name="author" content="Me"><meta property="article:published_time" content="2024-05-01T10:00:00Z"></head><body><nav>menu<br></nav><article><h1>H</h1>{body}<script>no()</script></article><footer>foot</footer></body></html>',
        f"<title>T</title><main><img src=x>{body}</main><p>May 3, 2024</p>",
        '<script type="application/ld+json">{"headline": "L", "datePublished": "2024-01-02", "author": {"name": "N"}}</script>' + body * 1,
        "<h1>x</h1>short",
        None,
    ]
    got = extract_articles(spark.createDataFrame([(i, h, "clash") for i, h in enumerate(pages)], "id int, html string, title string")).orderBy("id").collect()
    assert [r["status"] for r in got] == ["ok", "ok", "ok", "no substantive body", "no title"]
    assert got[0]["title"] == "OG" and got[0]["authors"] == ["Me"] and "menu" not in got[0]["body"] and "no()" not in got[0]["body"] and got[0]["published_at"] == datetime(2024, 5, 1, 10)
    assert got[1]["published_at"] == datetime(2024, 5, 3) and got[2]["title"] == "L" and got[2]["authors"] == ["N"]


def test_article_dates(spark):
    """Dates as Python's own parser reads them."""
    from datetime import UTC

    from chronofact.sources.articles import iso_time, shown_time

    texts = ["2024-05-01", "20240501", " 2024-05-01T10:11:12Z ", "2024-05-01 10:11", "2024-05-01T10", "20240501T101112", "2024-05-01T10:11:12.123456+02:30", "2024-05-01T10:11:12.5-08:00", "2024-05-01T101112+0230", "2024-13-01", "2024-02-30", "2024", "2024-05", "May 3, 2024", "", None, "2024-05-01T25:00"]

    def plain(t):
        try:
            d = datetime.fromisoformat(t.strip().replace("Z", "+00:00"))
        except (ValueError, AttributeError):
            return None
        return (d if d.tzinfo else d.replace(tzinfo=UTC)).timestamp()

    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", (F.unix_micros(iso_time(F.col("t"))) / 1e6).alias("s")).collect()
    assert {texts[r["i"]]: r["s"] for r in got} == {t: plain(t) for t in texts}
    shown = ["May 3, 2024", "Sep  12,\n2023", "September 1, 2023", "Junuary 1, 2024", None]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(shown)], "i int, t string").select("i", shown_time(F.col("t")).alias("d")).orderBy("i").collect()
    assert [r["d"] for r in got] == [datetime(2024, 5, 3), datetime(2023, 9, 12), datetime(2023, 9, 1), None, None]


def test_linked_data_and_odd_columns(spark):
    linked = '<script type="application/ld+json">{"@graph": [{"x": {"headline": "Inner"}, "author": [{"name": "No"}]}, {"headline": "Outer", "author": {"name": "A", "image": {"name": "pic"}}, "datePublished": "2024-01-02"}], "author": "B"}</script><script type="application/ld+json">{bad</script>'
    page = f"<p>{'words ' * 20}</p>" + linked
    got = extract_articles(spark.createDataFrame([(1, page, "kept")], "id int, html string, `a.b` string")).first()
    assert (got["title"], got["authors"], got["published_at"], got["status"], got["a.b"]) == ("Inner", ["A", "B"], datetime(2024, 1, 2), "ok", "kept")


def test_similar_titles(spark):
    t = [(1, "alpha beta gamma delta"), (2, "alpha beta gamma epsilon delta"), (3, "other words here now"), (4, "alpha beta gamma delta"), (5, "delta gamma beta alpha zeta")]
    df = spark.createDataFrame([(i, x, T0 + timedelta(hours=i)) for i, x in t] + [(9, t[1][1], T0 + timedelta(days=30)), (10, None, T0)], "id int, title string, published_at timestamp")
    assert sorted((r["a"], r["b"]) for r in gr.similar_titles(df, 48, 0.6).collect()) == [(1, 2), (1, 5), (2, 5)]


def test_event_groups(spark, tmp_path):
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(f"file://{tmp_path}")
    items = spark.createDataFrame([(i,) for i in range(60)], "id int")
    pairs = spark.createDataFrame([(i, i + 1) for i in range(10, 40)] + [(50, 3), (3, 59)], "a int, b int")
    got = {r["id"]: r["event_id"] for r in gr.event_groups(items, pairs).collect()}
    assert got == {i: 10 if 10 <= i <= 40 else 3 if i in (50, 59) else i for i in range(60)}


def _facts_stream(spark, sf_dir):
    return observations(spark, sf_dir).select("company_key", "product_key", "field", F.col("observed_at").cast("timestamp").alias("observed_at"), F.lpad(F.col("snapshot_id").cast("string"), 9, "0").alias("snapshot_id"), "extraction_version", F.lpad(F.col("id").cast("string"), 9, "0").alias("id"), "value", "disclosure_status", "company", "product")


def _run(spark, rows, start, root):
    """Adds rows to the stream's input and runs it to their end."""
    rows.coalesce(1).write.mode("append").parquet(f"{root}/in")
    source = spark.readStream.schema(rows.schema).parquet(f"{root}/in")
    jobs.batches_into(start(source), f"{root}/out", f"{root}/c").trigger(availableNow=True).start().awaitTermination()


def test_streams_equal_batch(spark, sf_dir, tmp_path):
    """Batches in an order that isn't that of time, within the delay; the last fact waits for the watermark."""
    from chronofact.operators.history import current_facts, detect_changes

    root, facts = f"file://{tmp_path}", _facts_stream(spark, sf_dir)
    early, rest = facts.where("observed_at < '2024-01-05'"), facts.where("observed_at >= '2024-01-05'")
    start = lambda stream: jobs.stream_changes(stream, "40 days", current_facts(early.drop("company", "product")))
    for k in (2, 0, 1):
        _run(spark, rest.where(f"id % 3 = {k}"), start, root)
    # A far fact moves the watermark past all others.
    far = rest.limit(1).withColumn("observed_at", F.lit("2025-01-01").cast("timestamp")).withColumn("company_key", F.lit("nobody"))
    _run(spark, far, start, root)
    want = sorted((r["field"], r["change_type"], r["previous"]["snapshot_id"], r["current"]["snapshot_id"]) for r in detect_changes(facts).where("detected_at >= '2024-01-05'").collect())
    got = spark.read.parquet(f"{root}/out").collect()
    assert sorted((r["field"], r["change_type"], r["previous_snapshot_id"], r["current_snapshot_id"]) for r in got) == want
    held = jobs.stream_state(spark, f"{root}/c")
    assert sorted((r["company_key"], r["field"], r["id"]) for r in held.collect()) == sorted((r["company_key"], r["field"], r["id"]) for r in current_facts(facts.drop("company", "product")).collect())
    # A late fact, at or below the held tuple, changes nothing.
    _run(spark, rest.where("id % 50 = 0").withColumn("value", F.lit("late")), start, root)
    assert spark.read.parquet(f"{root}/out").count() == len(want)


def test_idle_keys_are_forgotten(spark, tmp_path):
    schema = "company_key string, product_key string, field string, at long, snapshot_id string, extraction_version int, id string, value string, disclosure_status string"
    rows = [("a", "p", "f", 0, "s1", 1, "1", "x", "disclosed"), ("a", "p", "f", 100, "s2", 1, "2", "y", "disclosed"), ("a", "p", "f", 5000, "s3", 1, "3", "z", "disclosed"), ("b", "p", "f", 9000, "s4", 1, "4", "x", "disclosed"), ("a", "p", "f", 5000, "s0", 1, "5", None, "not_disclosed")]
    frame = spark.createDataFrame(rows, schema).withColumn("observed_at", F.timestamp_seconds(F.col("at") + 1_700_000_000)).drop("at")
    for name, idle, want in (("all", None, [("x", "y"), ("y", None), (None, "z")]), ("idle", 1_000_000, [("x", "y"), (None, "z")])):
        _run(spark, frame, lambda stream, idle=idle: jobs.stream_changes(stream, idle_ms=idle), f"file://{tmp_path}/{name}")
        got = spark.read.parquet(f"file://{tmp_path}/{name}/out").where("company_key = 'a'").orderBy("detected_at", "current_snapshot_id").collect()
        assert [(r["previous_value"], r["current_value"]) for r in got] == want


def test_stream_limits_answer_each_request(spark, tmp_path):
    """Answers over batches: the least requests of a batch take what earlier ones have left; counters close behind the watermark."""
    import random

    rng = random.Random(3)
    root, made, want, had = f"file://{tmp_path}", [], {}, {}
    for batch in range(3):
        rows = [(batch * 1000 + i, rng.choice(["a", "a", "b", None]), batch * 7200 + rng.randint(0, 7199)) for i in range(60)]
        for i, who, at in sorted(rows, key=lambda r: (r[2], r[0])):
            key = (who, at // 3600)
            had[key] = had.get(key, 0) + 1
            want[i] = had[key] <= 5
        made.append(spark.createDataFrame(rows, "id long, who string, at long").withColumn("ts", F.timestamp_seconds(F.col("at") + 1_699_999_200)).drop("at"))
    start = lambda stream: jobs.stream_rate_limit(stream, "1 hour", 5, ["who"])
    for rows in made:
        _run(spark, rows, start, root)
    assert {r["id"]: r["allowed"] for r in spark.read.parquet(f"{root}/out").collect()} == want
    counters = spark.read.format("statestore").option("path", f"{root}/c").option("stateVarName", "count").load()
    assert {(r["key"]["who"], r["value"]["n"]) for r in counters.collect()} == {(who, n) for (who, _), n in had.items()}
    late = spark.createDataFrame([(9000, "a", 10_000_000), (9001, "a", 100)], "id long, who string, at long").withColumn("ts", F.timestamp_seconds(F.col("at") + 1_699_999_200)).drop("at")
    _run(spark, late, start, root)
    assert counters.sparkSession.read.format("statestore").option("path", f"{root}/c").option("stateVarName", "count").load().count() == 1
    answers = {r["id"]: r["allowed"] for r in spark.read.parquet(f"{root}/out").collect()}
    assert answers[9000] and not answers[9001]
    before = spark.read.parquet(f"{root}/out").count()
    # A batch that is run again overwrites its own folder.
    jobs.batches_into(start(spark.readStream.schema(late.schema).parquet(f"{root}/in")), f"{root}/out", f"{root}/c").trigger(availableNow=True).start().awaitTermination()
    assert spark.read.parquet(f"{root}/out").count() == before


def test_stream_ingest_equals_batch(spark, tmp_path):
    rows = [("k", "A", 1), ("k", "B", 2), ("m", "A", 1), ("k", "A", 7), ("m", "C", 9), ("k", "D", 0)]
    df = docs(spark, rows)
    for part in ("raw_index < 3", "raw_index >= 3"):
        df.where(part).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    source = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
    jobs.stream_ingest(source, f"file://{tmp_path}/t", f"file://{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    items, new, _ = v.ingest(None, None, df)
    stored, snapshots = jobs.ingested(spark, f"file://{tmp_path}/t")
    same = ("dedupe_key", "title", "item_id", "latest_fetched_at", "latest_snapshot_id")
    assert sorted(tuple(r[c] for c in same) for r in stored.read().collect()) == sorted(tuple(r[c] for c in same) for r in items.collect())
    assert sorted(r["snapshot_id"] for r in snapshots.read().collect()) == sorted(r["snapshot_id"] for r in new.collect())


def test_ingest_needs_its_predecessor(spark, tmp_path):
    """Batches go on from the stored state; one without it fails instead of starting from nothing."""
    import shutil

    import pytest

    schema = "dedupe_key string, content_hash string, fetched_at timestamp, publisher string, raw_index long"
    source, root = str(tmp_path / "in"), f"file://{tmp_path}/out"

    def run(rows):
        spark.createDataFrame(rows, "dedupe_key string, content_hash string, at long, publisher string").selectExpr("dedupe_key", "content_hash", "timestamp_seconds(at) as fetched_at", "publisher", "at as raw_index").coalesce(1).write.mode("append").parquet(source)
        jobs.stream_ingest(spark.readStream.schema(schema).parquet(source), root, f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()

    run([("a", "x", 1, "p"), ("b", "y", 2, "p")])
    run([("a", "x", 3, "p"), ("a", "z", 4, "p"), ("c", "y", 5, "p")])
    items, snapshots = jobs.ingested(spark, root)
    got = snapshots.read().select("dedupe_key", "content_hash", "raw_index").collect()
    assert sorted(map(tuple, got)) == [("a", "x", 1), ("a", "z", 4), ("b", "y", 2), ("c", "y", 5)]
    # A batch that is run again finds its own rows and adds none.
    again = snapshots.upsert(snapshots.read().limit(0), 1)
    assert sorted(r["content_hash"] for r in again.collect()) == ["y", "z"] and snapshots.read().count() == 4
    shutil.rmtree(tmp_path / "out/items")
    with pytest.raises(Exception, match="no state to start from"):
        run([("d", "w", 6, "p")])


def test_append_takes_a_stated_row(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    rows = spark.createDataFrame([(1, "b", 2), (1, "a", 9), (2, None, 1)], "k long, v string, n int")
    sinks.append_new(rows, path, ["k"])
    sinks.append_new(rows.where("k = 2").union(spark.createDataFrame([(3, "z", 0)], rows.schema)), path, ["k"])
    assert sorted((r["k"], r["v"], r["n"]) for r in spark.read.parquet(path).collect()) == [(1, "a", 9), (2, None, 1), (3, "z", 0)]


def test_shared_folder_is_named_on_clusters():
    import pytest

    from chronofact.session import shared_folder

    class Far:
        class conf:
            get = staticmethod(lambda key, other=None: None)

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(Far)


def test_unique_keys_are_dealt_before_they_are_counted(spark):
    """No task counts the keys of the rows that it reads, of which it could hold all."""
    rows = spark.createDataFrame([(k % 50, None if k % 7 == 0 else k % 3) for k in range(400)], "k long, j long").repartition(2)
    found = a.audit_unique_key(rows, ["k", "j"], "u")
    assert found._jdf.queryExecution().executedPlan().toString().count("REPARTITION_BY_NUM") == 1
    assert found.rdd.getNumPartitions() == 2 * a.PARTS
    want = {}
    for k in range(400):
        if k % 7:
            want[f"{k % 50}|{k % 3}"] = want.get(f"{k % 50}|{k % 3}", 0) + 1
    assert {r["key"]: r["n"] for r in found.collect()} == {k: n for k, n in want.items() if n > 1}


def test_articles_are_read_a_few_pages_at_a_time():
    """A batch of any size leaves in batches of ROWS pages, in order and with its other columns."""
    n = 3 * articles.ROWS + 5
    batch = pa.RecordBatch.from_pydict({"id": pa.array(range(n)), "_html": pa.array([None if i % 9 == 0 else f"<h1>t {i}</h1>" for i in range(n)])})
    parts = list(articles._articles(iter([batch, batch.slice(0, 0)])))
    assert [p.num_rows for p in parts] == [articles.ROWS] * 3 + [5]
    got = pa.Table.from_batches(parts)
    assert got["id"].to_pylist() == list(range(n)) and got["title"].to_pylist() == [None if i % 9 == 0 else f"t {i}" for i in range(n)]
