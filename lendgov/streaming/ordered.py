"""Stateful processors that read a key's rows in event-time order.

Rows wait in map state, by the day in which they happened, until the key's one timer (the earliest waiting row's millisecond) says
that the watermark has passed it; then all rows up to the watermark are taken in order, day by day, and dropped from the state. So what is
written does not depend on how the stream was split into micro-batches, a task holds one day of one key at a time, state is read and
written a few times for a key and batch instead of for every row, and it holds what lies within the watermark. Rows behind the watermark are late and are dropped by Spark before they get here.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from contextlib import contextmanager
from datetime import datetime, timezone

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions.hashing import LINK_FORMATS

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


#: Rows of a key wait together by spans of a day; a task reads and writes a span at once.
SPAN_MS = 86_400_000


def _due(us: int) -> int:
    """The millisecond of a row: due when the watermark is at the row's time or past it, as rows of that time are late from then on."""
    return -(-us // 1000)


def _time(us: int) -> datetime:
    return datetime.fromtimestamp(us // 1_000_000, timezone.utc).replace(microsecond=us % 1_000_000)


@contextmanager
def state_store(spark: SparkSession):
    """These processors need the RocksDB store; a query keeps the setting it was started with."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKSDB)
    try:
        yield
    finally:
        spark.conf.unset(_PROVIDER) if before is None else spark.conf.set(_PROVIDER, before)


class InEventOrder(StatefulProcessor):
    """``step`` sees the rows of a key one by one, ordered by (time, rank, id)."""

    #: Names and types of the output after key, ts and id.
    columns: tuple[tuple[str, str], ...] = ()

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "span bigint", "found string")
        # text of [the state, when the timer is due or null, spans with waiting rows]
        self.kept = handle.getValueState("kept", "value string")

    def first(self):
        raise NotImplementedError

    def step(self, state, us: int, rank: int, row_id: int, body: str):
        """(the new state, the output's values in ``columns`` or None)"""
        raise NotImplementedError

    def _kept(self):
        return json.loads(self.kept.get()[0]) if self.kept.exists() else [self.first(), None, []]

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        new: dict[int, list] = {}
        for r in rows:
            new.setdefault(_due(r["at_us"]) // SPAN_MS, []).append([r["at_us"], r["rank"], r["id"], r["body"]])
        if not new:
            return iter(())
        state, timer, spans = self._kept()
        for span, found in new.items():
            held = json.loads(self.waiting.getValue((span,))[0]) if span in spans else []
            self.waiting.updateValue((span,), (json.dumps(held + found),))
        earliest = min(_due(r[0]) for r in new[min(new)])
        if timer is None or earliest < timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(earliest)
            timer = earliest
        self.kept.update((json.dumps([state, timer, sorted({*spans, *new})]),))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        upto = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())
        state, _, spans = self._kept()
        row = Row("key", "ts", "id", *[name for name, _ in self.columns])
        timer = None
        while spans:
            span = spans[0]
            found = sorted(json.loads(self.waiting.getValue((span,))[0]), key=lambda r: r[:3])
            taken = 0
            for us, rank, row_id, body in found:
                if _due(us) > upto:
                    break
                taken += 1
                state, values = self.step(state, us, rank, row_id, body)
                if values is not None:
                    yield row(key[0], _time(us), row_id, *values)
            rest = found[taken:]
            if rest:
                timer = _due(rest[0][0])
                if taken:
                    self.waiting.updateValue((span,), (json.dumps(rest),))
                break
            self.waiting.removeKey((span,))
            spans = spans[1:]
        if timer is not None:
            self.handle.registerTimer(timer)
        self.kept.update((json.dumps([state, timer, spans]),))

    def close(self) -> None:
        pass


class Flags(InEventOrder):
    """Consent events (rank 0, body: JSON of group and allowed) and requests (rank 1): each request with the flags of its time."""

    columns = (("flags", "string"), ("body", "string"))

    def first(self):
        return {}

    def step(self, state, us, rank, row_id, body):
        if rank == 1:
            return state, (json.dumps(state), body)
        said = json.loads(body)
        if said.get("allowed") is not None:
            state[said["group_name"]] = said["allowed"]
        return state, None


class Links(InEventOrder):
    """Hash-chain links; body: JSON of ``payload`` and ``carry`` (text that goes along)."""

    columns = (("seq", "bigint"), ("previous_hash", "string"), ("output_hash", "string"), ("carry", "string"))

    def __init__(self, link: str = "text"):
        self.format = LINK_FORMATS[link]

    def first(self):
        return [None, 0]

    def step(self, state, us, rank, row_id, body):
        previous, seq = state
        given = json.loads(body)
        before, quote, none, after = self.format
        text = given["payload"] + before + (none if previous is None else quote + previous + quote) + after
        h = hashlib.sha256(text.encode()).hexdigest()
        return [h, seq + 1], (seq + 1, previous, h, given.get("carry"))


def in_event_order(stream: DataFrame, processor: InEventOrder) -> DataFrame:
    """``stream`` (key, ts, rank, id, body), watermarked on ts, through the processor: key, ts (still the event time), id and its columns."""
    rows = stream.select("key", "ts", F.unix_micros("ts").alias("at_us"), F.col("rank").cast("int").alias("rank"), F.col("id").cast("bigint").alias("id"), "body")
    names = [("key", stream.schema["key"].dataType.simpleString()), ("ts", "timestamp"), ("id", "bigint"), *processor.columns]
    return rows.groupBy("key").transformWithState(processor, ", ".join(f"{n} {t}" for n, t in names), "append", "EventTime", eventTimeColumnName="ts")


def with_flags(stream: DataFrame) -> DataFrame:
    """Requests with ``flags`` (JSON of the groups that events have spoken of) and their ``body``."""
    return in_event_order(stream, Flags())


def links(stream: DataFrame, link: str = "text") -> DataFrame:
    """Links in event-time order: key, ts, id, seq, previous_hash, output_hash, carry."""
    return in_event_order(stream, Links(link))
