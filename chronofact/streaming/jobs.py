"""Incremental jobs over streams of documents, observations and requests."""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from chronofact.operators.versioning import META, item_id, snapshot_id
from chronofact.sources.state import KeyedState
from chronofact.streaming.kinds import change_kind

CHANGE = "company_key string, product_key string, field string, change_type string, previous_value string, current_value string, previous_snapshot_id string, current_snapshot_id string, detected_us long"
#: Columns of a document that stay those of its item's first one.
IDENTITY = ("source_id", "canonical_url")
FACT = "observed_us long, snapshot_id string, extraction_version int, id string, value string, disclosure_status string"
CHANGE_KEYS, FACT_COLUMNS = ("company_key", "product_key", "field"), tuple(c.split()[0] for c in FACT.split(", "))
KEYED_COLUMNS, N_KEYS = CHANGE_KEYS + FACT_COLUMNS, len(CHANGE_KEYS)
KEYED_FACTS = f"array<struct<{', '.join([f'{k}: string' for k in CHANGE_KEYS] + [': '.join(c.split()) for c in FACT.split(', ')])}>>"
#: Shards of keys, width of a slot of waiting facts, and facts of a batch that a shard gathers before it stores them.
SHARDS, SLOT_MS, FLUSH = 128, 3_600_000, 20_000
CHANGE_ROW = Row(*(c.split()[0] for c in CHANGE.split(", ")))
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def ingested(spark: SparkSession, root: str, buckets: int = 64) -> tuple[KeyedState, KeyedState]:
    """The stored items and snapshots of ``stream_ingest``: items are guarded by their latest tuple, snapshots only added."""
    items = KeyedState(spark, f"{root}/items", ["dedupe_key"], ["latest_fetched_at", "latest_snapshot_id"], ["item_id", "first_fetched_at", "first_index", *IDENTITY], ["first_fetched_at", "first_index"], buckets)
    return items, KeyedState(spark, f"{root}/snapshots", ["item_id", "content_hash"], first_by=["fetched_at", "raw_index"], buckets=buckets)


def stream_ingest(docs: DataFrame, root: str, checkpoint: str, buckets: int = 64) -> DataStreamWriter:
    """Ingests a stream of documents into stored snapshots and items (see ``ingested``), at the cost of the batch and the
    buckets that it touches.

    New contents of an item are added once; the item's pointer and metadata move to the greatest (fetched_at,
    snapshot_id) of new snapshots and only forwards, so late documents are recorded and change no pointer. A batch that
    is run again finds its own snapshots and changes nothing more. A batch whose predecessor is missing fails, as its
    items would all count as new.
    """

    def batch(df: DataFrame, no: int) -> None:
        items, snapshots = ingested(df.sparkSession, root, buckets)
        if no and min(items.applied, snapshots.applied) < no - 1:
            raise RuntimeError(f"batch {no} has no state to start from: batch {no - 1} is missing in {root}")
        for state in (items, snapshots):
            if state.applied < no and state.compact():
                state.vacuum()
        keyed = df.where("dedupe_key is not null").withColumn("item_id", item_id()).withColumn("snapshot_id", snapshot_id())
        new = snapshots.upsert(keyed, no)
        identity = [c for c in IDENTITY if c in new.columns]
        pointers = new.select("dedupe_key", "item_id", F.col("fetched_at").alias("first_fetched_at"), F.col("raw_index").alias("first_index"), *identity, F.col("fetched_at").alias("latest_fetched_at"), F.col("snapshot_id").alias("latest_snapshot_id"), *[c for c in META if c in new.columns])
        items.upsert(pointers, no)

    return docs.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)


def stream_dedupe(docs: DataFrame, delay: str, ts: str = "fetched_at") -> DataFrame:
    """The first document of each key and content within the delay."""
    return docs.withWatermark(ts, delay).dropDuplicatesWithinWatermark(["dedupe_key", "content_hash"])


class _Changes(StatefulProcessor):
    """The keys of one shard: each one's greatest tuple so far, facts that wait for the watermark in slots of an hour, and a
    timer for the earliest of them.

    The store is asked by shard and slot, not by fact, and has facts as JSON, which it need not take apart. Slots are taken in order of time when the watermark is in or past
    them, one in memory at a time; a slot that it is in keeps its later facts.
    """

    def __init__(self, idle_ms: int | None) -> None:
        self.idle = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "facts string")
        self.waiting = handle.getMapState("waiting", "slot long", "facts string")

    def handleInitialState(self, key: tuple, initialState: Row, timerValues: TimerValues) -> None:
        held = _by_key(tuple(f[c] for c in KEYED_COLUMNS) for f in initialState["facts"])
        self._hold(held)
        self._wake(self._idle_at(held))

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        first, slots, n = None, {}, 0
        for r in rows:
            fact = tuple(r[c] for c in KEYED_COLUMNS)
            at = _ms(fact[N_KEYS])
            first = at if first is None else min(first, at)
            slots.setdefault(at // SLOT_MS, []).append(fact)
            n += 1
            if n % FLUSH == 0:
                self._wait(slots)
                slots = {}
        self._wait(slots)
        self._wake(first)
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        upto = max(timerValues.getCurrentWatermarkInMs() - 1, expiredTimerInfo.getExpiryTimeInMs())
        slots = sorted(k[0] for k in self.waiting.keys())
        due = [s for s in slots if s * SLOT_MS <= upto]
        if not due and self.idle is None:
            return
        value = self.held.get()
        held, wake = _by_key([f[c] for c in KEYED_COLUMNS] for f in json.loads(value[0])) if value else {}, [s * SLOT_MS for s in slots[len(due) : len(due) + 1]]
        for slot in due:
            facts = list(map(tuple, json.loads(self.waiting.getValue((slot,))[0])))
            later = [f for f in facts if _ms(f[N_KEYS]) > upto]
            for f in sorted((f for f in facts if _ms(f[N_KEYS]) <= upto), key=lambda f: _tuple(f[N_KEYS:])):
                of, fact = f[:N_KEYS], f[N_KEYS:]
                last = held.get(of)
                if last is not None and _tuple(fact) <= _tuple(last):
                    continue
                if last is not None and self.idle is not None and _ms(last[0]) + self.idle <= _ms(fact[0]):
                    last = None
                if last is not None and last[1] != fact[1] and last[4:6] != fact[4:6]:
                    yield CHANGE_ROW(*of, change_kind(last[4], fact[4]), last[4], fact[4], last[1], fact[1], fact[0])
                held[of] = fact
            if later:
                self.waiting.updateValue((slot,), (json.dumps(later),))
                wake.append(min(_ms(f[N_KEYS]) for f in later))
            else:
                self.waiting.removeKey((slot,))
        if self.idle is not None:
            held = {of: fact for of, fact in held.items() if _ms(fact[0]) + self.idle > upto}
        self._hold(held)
        self._wake(min(wake, default=None))
        self._wake(self._idle_at(held))

    def _wait(self, slots: dict[int, list]) -> None:
        for slot, facts in slots.items():
            others = self.waiting.getValue((slot,))
            self.waiting.updateValue((slot,), (json.dumps([*(json.loads(others[0]) if others else ()), *facts]),))

    def _hold(self, held: dict[tuple, tuple]) -> None:
        if held:
            self.held.update((json.dumps([dict(zip(KEYED_COLUMNS, (*of, *fact), strict=True)) for of, fact in held.items()]),))
        else:
            self.held.clear()

    def _idle_at(self, held: dict[tuple, tuple]) -> int | None:
        return None if self.idle is None or not held else min(_ms(fact[0]) for fact in held.values()) + self.idle

    def _wake(self, at: int | None) -> None:
        if at is not None:
            self.handle.registerTimer(at)

    def close(self) -> None:
        pass


def _by_key(facts: Iterable) -> dict[tuple, tuple]:
    """Facts by their keys."""
    return {tuple(f[:N_KEYS]): tuple(f[N_KEYS:]) for f in facts}


def _tuple(fact: tuple) -> tuple:
    """The order of a key's facts; nulls come first, as in Spark."""
    return tuple((v is not None, v) if v is not None else (False,) for v in fact[:4])


def _ms(micros: int) -> int:
    """Milliseconds, rounded up: a watermark there has passed the time itself."""
    return -(-micros // 1000)


def stream_changes(facts: DataFrame, delay: str = "0 seconds", state: DataFrame | None = None, idle_ms: int | None = None, shards: int = SHARDS) -> DataFrame:
    """Changes of a stream of facts, with one tuple of state for each (company, product, field).

    facts: the keys, observed_at, snapshot_id, extraction_version, id, value, disclosure_status. Facts wait until the
    watermark, ``delay`` behind the latest time seen, has passed them, and are then taken in order of their tuples however
    they arrived; later ones, at or below the held tuple, give nothing and belong in the fact table all the same. ``state``
    has the tuples to start from, one row a key, as ``history.current_facts`` gives. A key without facts for ``idle_ms``
    milliseconds is forgotten (its next fact is a first one); by default none is. The stored state can be read with
    ``stream_state``. Keys are dealt to ``shards`` by hash, and the store is asked once a shard, batch and hour of facts, which
    bounds its cost whatever the number of keys; a checkpoint keeps the number it began with. Needs the RocksDB state
    store, which is set on the session.
    """
    facts.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)

    def lean(df: DataFrame) -> DataFrame:
        at = F.col("observed_at").cast("timestamp")
        shard = F.pmod(F.xxhash64(*CHANGE_KEYS), F.lit(shards)).cast("int").alias("_shard")
        return df.select(shard, *[F.col(k).cast("string").alias(k) for k in CHANGE_KEYS], at.alias("observed_at"), F.unix_micros(at).alias("observed_us"), F.col("snapshot_id").cast("string").alias("snapshot_id"), F.col("extraction_version").cast("int").alias("extraction_version"), F.col("id").cast("string").alias("id"), "value", "disclosure_status")

    start = None if state is None else lean(state).groupBy("_shard").agg(F.collect_list(F.struct(*KEYED_COLUMNS)).alias("facts")).groupBy("_shard")
    found = lean(facts).withWatermark("observed_at", delay).groupBy("_shard").transformWithState(_Changes(idle_ms), CHANGE, "Append", "EventTime", start)
    return found.withColumn("detected_us", F.timestamp_micros("detected_us")).withColumnRenamed("detected_us", "detected_at")


def stream_state(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The held tuples of ``stream_changes`` as its checkpoint stores them: the keys and the columns of a fact."""
    held = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "held").load()
    return held.select(F.explode(F.from_json("value.facts", KEYED_FACTS)).alias("f")).select(*[F.col(f"f.{k}") for k in CHANGE_KEYS], F.timestamp_micros("f.observed_us").alias("observed_at"), *[F.col(f"f.{c}") for c in FACT_COLUMNS[1:]])


class _Limits(StatefulProcessor):
    """One identity's counter of a window: how many requests it has had. A timer closes it when the watermark passes its end."""

    def __init__(self, limit: int, columns: tuple[str, ...]) -> None:
        self.limit, self.columns = limit, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.count = handle.getValueState("count", "n long")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        *identity, end_ms = key
        if end_ms <= timerValues.getCurrentWatermarkInMs():
            return
        answer = Row(*self.columns)
        had = self.count.get()[0] if self.count.exists() else 0
        if not had:
            self.handle.registerTimer(end_ms)
        # The free places go to the least requests of the batch; only those are held.
        free, n, best = max(self.limit - had, 0), 0, []
        for r in rows:
            n += 1
            one = _Reversed((r["at_us"], r["request"]))
            if len(best) < free:
                heapq.heappush(best, one)
            else:
                out = heapq.heappushpop(best, one) if best else one
                yield answer(*identity, out.value[1], out.value[0], False)
        for one in best:
            yield answer(*identity, one.value[1], one.value[0], True)
        self.count.update((had + n,))

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        self.count.clear()
        return iter(())

    def close(self) -> None:
        pass


class _Reversed:
    """Turns the order round, so that a heap gives its greatest entry first."""

    def __init__(self, value: tuple) -> None:
        self.value = value

    def __lt__(self, other: _Reversed) -> bool:
        return self.value > other.value


def stream_rate_limit(requests: DataFrame, window: str, limit: int, keys: list[str], ts: str = "ts", request: str = "id", keep: str = "24 hours") -> DataFrame:
    """Whether each request of a stream is allowed -> keys (as text), request (as long), ts, allowed.

    Windows are aligned to the epoch. An identity has ``limit`` requests in each; earlier batches come first, and within a
    batch those of least (ts, request). A counter is closed when the watermark, ``keep`` behind the latest time, passes its
    window; requests that are later than that get no answer. Nulls in a key are an identity like others. Needs the RocksDB
    state store, which is set on the session.
    """
    requests.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    at = F.col("_at")
    rows = requests.select(*[F.col(k).cast("string").alias(k) for k in keys], F.col(ts).cast("timestamp").alias("_at"), F.col(request).cast("long").alias("request"))
    rows = rows.withColumn("at_us", F.unix_micros(at)).withColumn("_end_ms", F.unix_millis(F.window(at, window)["end"])).withWatermark("_at", keep)
    schema = f"{', '.join(f'`{k}` string' for k in keys)}, request long, at_us long, allowed boolean"
    out = rows.groupBy(*keys, "_end_ms").transformWithState(_Limits(limit, (*keys, "request", "at_us", "allowed")), schema, "Update", "EventTime")
    return out.select(*keys, F.col("request").alias(request), F.timestamp_micros("at_us").alias(ts), "allowed")


def batches_into(rows: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataStreamWriter:
    """Writes each batch of a stream to a folder of its own, which a repeated batch overwrites, so nothing is there twice."""

    def batch(df: DataFrame, no: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/batch={no:012d}")

    return rows.writeStream.foreachBatch(batch).outputMode(mode).option("checkpointLocation", checkpoint)
