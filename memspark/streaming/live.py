"""The operators as streams. Watermarks are a parameter: what comes later than that is left out."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from memspark.operators.ingest import EVENT_LIMIT, EVENT_MARK, filter_tools, truncate
from memspark.operators.sensitive import redact, scan_sensitive


def live_etl(events: DataFrame, key: str, tools: list[str], globs: list[str], secret: str) -> DataFrame:
    """Tool filter, truncation and redaction of each event; no state, so it is the same for a batch and a stream."""
    kept = filter_tools(events, tools, globs).withColumn("content", truncate(F.col("content"), EVENT_LIMIT, EVENT_MARK))
    return redact(scan_sensitive(kept, "content"), "content", key, secret).drop("content", "spans").withColumnRenamed("redacted", "content")


class _Thinning(StatefulProcessor):
    """Holds a key's events until the watermark has passed them, keeps those that no kept one precedes within the window, and forgets the last kept one after it.

    A key has a timer for its earliest waiting event only; when that expires, all that the watermark has passed is settled at
    once. Events wait as rows of up to ``together`` of them, as each row of state is sent and encoded alone.
    """

    together = 4096

    def __init__(self, keys: list[str], seconds: float, kind: str):
        self.row, self.gap, self.kind = Row(*keys, "_at", "event_id"), round(seconds * 1_000_000), kind

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", f"at array<long>, event_id array<{self.kind}>")
        self.last = handle.getValueState("last", "at long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        new = [(r["_at"], r["event_id"]) for r in rows]
        self.waiting.appendList(self._packed(new))
        self.handle.registerTimer(min(new)[0] // 1000 + 1)
        yield from ()

    def _packed(self, events: list[tuple]) -> list[tuple]:
        return [tuple(map(list, zip(*events[i : i + self.together], strict=True))) for i in range(0, len(events), self.together)]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs()
        before = self.last.get()  # null where there is none: every call to the state costs as much as some hundred events
        last = before = before[0] if before else None
        held = sorted(x for ats, ids in self.waiting.get() for x in zip(ats, ids, strict=True))
        passed = bisect_left(held, now, key=lambda x: x[0] // 1000)
        for at, event in held[:passed]:
            if last is None or at - last > self.gap:
                last = at
                yield self.row(*key, at, event)
        if passed:
            self.waiting.clear()
            if passed < len(held):
                self.waiting.put(self._packed(held[passed:]))
        if passed < len(held):
            self.handle.registerTimer(held[passed][0] // 1000 + 1)
        if last is not None and now * 1000 - last > self.gap:
            if before is not None:
                self.last.clear()
        elif last is not None:
            if last != before:
                self.last.update((last,))
            self.handle.registerTimer((last + self.gap) // 1000 + 2)

    def close(self) -> None:
        pass


def suppress_duplicates(events: DataFrame, keys: list[str], time: str = "ts", seconds: float = 60, late: str = "0 seconds") -> DataFrame:
    """(keys, time, event_id) of events of which none with the same key was kept within the seconds before.

    Counted from the last kept event in order of time, as drop_recent_duplicates counts: an event waits until the watermark,
    ``late`` behind the newest one, has passed it. Then state is cleared by timers. Events without a time are left out. Needs
    the RocksDB state store.
    """
    kinds = {f.name: f.dataType.simpleString() for f in events.schema}
    schema = ", ".join([*[f"`{c}` {kinds[c]}" for c in keys], "_at long", f"event_id {kinds['event_id']}"])
    timed = events.select(*keys, time, "event_id").withWatermark(time, late).filter(F.col(time).isNotNull())
    grouped = timed.withColumn("_at", F.unix_micros(F.col(time).cast("timestamp"))).groupBy(*keys)
    kept = grouped.transformWithState(statefulProcessor=_Thinning(keys, seconds, kinds["event_id"]), outputStructType=schema, outputMode="append", timeMode="EventTime")
    return kept.select(*keys, F.timestamp_micros("_at").cast(kinds[time]).alias(time), "event_id")


def live_sessions(events: DataFrame, key: str, gap: str = "300 seconds", late: str = "0 seconds", time: str = "ts") -> DataFrame:
    """Sessions closed by an idle gap: key, started, ended (the last event plus the gap), event_count."""
    w = F.session_window(time, gap)
    out = events.withWatermark(time, late).groupBy(key, w.alias("w")).agg(F.count("*").alias("event_count"))
    return out.select(key, F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "event_count")


class _Chunks(StatefulProcessor):
    """Keeps a session's events until n are there, then gives them as one chunk."""

    def __init__(self, n: int):
        self.n = n

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getListState("held", "event_id long")
        self.number = handle.getValueState("number", "chunk long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        ids = [int(r[0]) for r in self.held.get()] if self.held.exists() else []
        ids += [int(x) for x in pd.concat(list(rows)).sort_values(["ts_s", "event_id"])["event_id"]]
        chunk = int(self.number.get()[0]) if self.number.exists() else 0
        out = []
        while len(ids) >= self.n:
            out.append({"session_id": key[0], "chunk": chunk, "event_ids": ids[: self.n]})
            ids, chunk = ids[self.n :], chunk + 1
        self.held.clear()
        if ids:
            self.held.put([(x,) for x in ids])
        self.number.update((chunk,))
        if out:
            yield pd.DataFrame(out)

    def close(self) -> None:
        pass


def live_chunks(events: DataFrame, n: int = 20) -> DataFrame:
    """(session_id, chunk, event_ids) as soon as a session has n more events; needs the RocksDB state store."""
    return events.groupBy("session_id").transformWithStateInPandas(statefulProcessor=_Chunks(n), outputStructType="session_id long, chunk long, event_ids array<long>", outputMode="append", timeMode="None")


def match_tools(calls: DataFrame, results: DataFrame, within: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Results (source, tool_use_id, ts) with the name of the call before them, null if none came within the time."""
    c = calls.select("source", "tool_use_id", "tool_name", F.col("ts").alias("call_ts")).withWatermark("call_ts", late).alias("c")
    r = results.select("source", "tool_use_id", "result_id", "ts").withWatermark("ts", late).alias("r")
    same = F.expr(f"c.source = r.source and c.tool_use_id = r.tool_use_id and call_ts <= ts and call_ts >= ts - interval {within}")
    return r.join(c, same, "left").select("r.source", "r.tool_use_id", "result_id", "ts", "tool_name")


def live_counters(events: DataFrame, window: str = "1 hour", late: str = "10 minutes", time: str = "ts") -> DataFrame:
    out = events.withWatermark(time, late).groupBy(F.window(time, window).alias("w"), "type").agg(F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("start"), "type", "n")


def keep_up(stream: DataFrame, update: Callable[[DataFrame, int], None], checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Bring an index, embeddings or citation counts up to date with every micro-batch: ``update(batch, number)`` is called
    again with the same number after a failure, so it must be idempotent."""
    return stream.writeStream.foreachBatch(update).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
