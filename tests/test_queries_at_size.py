"""Queries on keys, texts and numbers of facts that larger tables have."""

from chronofact.plans import records_queries as rq
from chronofact.streaming import jobs


def test_networks_of_large_numbers(spark, tmp_path):
    """An IPv6 group has 16 bits: numbers beyond them are still part of an address."""
    spark.sql("select id as event_id from values (65538L), (99999L), (9L * 64 * 100000000), (10L) as t(id)").write.parquet(f"{tmp_path}/events.parquet")
    got = {r["network"]: r["n"] for r in rq.u4_networks(spark, str(tmp_path)).collect()}
    assert got == {"2001:db8:2::/56": 1, "2001:db8:1f::/56": 1, "2001:db8::/56": 1, "10.3.0.0/24": 1}


def test_titles_keep_other_references(spark, tmp_path):
    pages = [(1, "<h1>a &lt;b&gt; &amp;amp; &quot;c&quot; d &amp</h1>"), (2, "<h1>R & D &#39;x</h1>"), (3, None)]
    spark.createDataFrame(pages, "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r["page_id"]: r["title"] for r in rq.s3_titles(spark, str(tmp_path)).collect()}
    assert got == {1: "a <b> &amp; &quot;c&quot; d &amp", 2: "R & D &#39;x", 3: None}


class _Store:
    """A handle that counts what it is asked."""

    def __init__(self):
        self.calls, self.value, self.map, self.timers = 0, None, {}, []

    def getValueState(self, name, schema):  # noqa: N802
        return _Value(self)

    def getMapState(self, name, key, value):  # noqa: N802
        return _Map(self)

    def registerTimer(self, at):  # noqa: N802
        self.calls += 1
        self.timers.append(at)


class _Value:
    def __init__(self, store):
        self.store = store

    def get(self):
        self.store.calls += 1
        return self.store.value

    def update(self, value):
        self.store.calls += 1
        self.store.value = value

    def clear(self):
        self.update(None)


class _Map(_Value):
    def keys(self):
        self.store.calls += 1
        return iter(list(self.store.map))

    def getValue(self, key):  # noqa: N802
        self.store.calls += 1
        return self.store.map.get(key)

    def updateValue(self, key, value):  # noqa: N802
        self.store.calls += 1
        self.store.map[key] = value

    def removeKey(self, key):  # noqa: N802
        self.store.calls += 1
        del self.store.map[key]


class _Time:
    def __init__(self, at):
        self.getCurrentWatermarkInMs = self.getExpiryTimeInMs = lambda: at  # noqa: N815


def test_stream_store_is_asked_by_hour_and_not_by_fact():
    """3000 facts of 500 keys in three hours: the middle one is cut by the watermark, and a hot key's facts come in any order."""
    hour, store, p = jobs.SLOT_MS * 1000, _Store(), jobs._Changes(None)
    p.init(store)
    rows = [dict(zip(jobs.KEYED_COLUMNS, (f"c{i % 500}", "p", "f", i * hour // 1000, f"s{i:04d}", 1, str(i), str(i // 500), "disclosed"), strict=True)) for i in range(3000)]
    assert not list(p.handleInputRows((0,), iter(rows[::-1]), _Time(0)))
    got = [r for at in (1_500_000 * hour // 10**9, 10 * hour // 1000) for r in p.handleExpiredTimer((0,), _Time(at), _Time(at))]
    assert sorted((r["company_key"], int(r["previous_value"]), int(r["current_value"])) for r in got) == sorted((f"c{k}", v - 1, v) for k in range(500) for v in range(1, 6))
    assert not store.map and store.calls < 40
