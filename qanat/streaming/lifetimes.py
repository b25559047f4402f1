"""Keyed state with event-time timers: cached entries with lifetimes, probed by a stream.

Puts and probes of a key may arrive in any order inside the watermark's delay.  A probe waits in the key's state under
a timer at its own time; when the watermark passes it, every put that could come before it has arrived, and it
is answered.  A second kind of timer empties an entry whose longest lifetime is over, so a key that is
no longer asked for keeps no payload.  State lives in RocksDB and in the query's checkpoint.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from qanat.session import ship

OUT = "key string, probe_id long, hit boolean, payload string"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Lifetimes(StatefulProcessor):
    """Rows (key, at microseconds, probe_id or null for a put, seconds of lifetime that the probe grants, payload).  The first put
    of a key counts; ``longest`` is the longest lifetime in seconds."""

    def __init__(self, longest: int):
        self.longest = longest

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entry = handle.getValueState("entry", "at long, payload string")
        self.waiting = handle.getMapState("waiting", "ms long", "probes array<struct<id: long, at: long, seconds: long>>")

    def _expiry(self, at: int) -> int:
        return (at + self.longest * 1_000_000) // 1000 + 1

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        probes: dict[int, list] = {}
        old = self.entry.get() if self.entry.exists() else None
        first = old
        for r in rows:
            if r.probe_id is None:
                put = (r.at, r.payload)
                first = put if first is None or put[0] < first[0] else first
            else:
                probes.setdefault(r.at // 1000 + 1, []).append((r.probe_id, r.at, r.seconds))
        if first is not None and (old is None or first[0] != old[0]):
            self.entry.update((first[0], first[1]))
            self.handle.registerTimer(self._expiry(first[0]))
        for ms, more in probes.items():
            held = self.waiting.getValue((ms,))[0] if self.waiting.containsKey((ms,)) else []
            self.waiting.updateValue((ms,), ([tuple(x) for x in held] + more,))
            self.handle.registerTimer(ms)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        ms = expiredTimerInfo.getExpiryTimeInMs()
        entry = self.entry.get() if self.entry.exists() else None
        out = []
        if self.waiting.containsKey((ms,)):
            for probe, at, seconds in self.waiting.getValue((ms,))[0]:
                hit = entry is not None and 0 <= at - entry[0] < seconds * 1_000_000
                out.append(Row(key=key[0], probe_id=probe, hit=hit, payload=entry[1] if hit else None))
            self.waiting.removeKey((ms,))
        if entry is not None and entry[1] is not None and ms >= self._expiry(entry[0]):
            self.entry.update((entry[0], None))  # later puts stay second
        return iter(out)


def lifetimes(rows: DataFrame, at: str, delay: str, longest: int) -> DataFrame:
    """Answers to the probes of a stream of rows (key, ``at`` timestamp, probe_id, seconds, payload): whether the key's first put
    is at most ``seconds`` old at the probe's time, and its payload.  Rows later than ``delay`` are dropped; a probe is
    answered once the watermark has passed it.  Rows without key or time are left out."""
    spark = rows.sparkSession
    ship(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    r = rows.where(F.col("key").isNotNull() & F.col(at).isNotNull()).withWatermark(at, delay)
    r = r.select(F.col("key").cast("string").alias("key"), at, F.unix_micros(at).alias("at"), F.col("probe_id").cast("long").alias("probe_id"), F.col("seconds").cast("long").alias("seconds"), F.col("payload").cast("string").alias("payload"))
    return r.groupBy("key").transformWithState(Lifetimes(longest), OUT, "append", "EventTime")
