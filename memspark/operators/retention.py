"""Retention: which events, summaries and entities can be archived."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memspark.operators.lifecycle import is_open

EVENT_DAYS, SUMMARY_DAYS, ENTITY_DAYS = 1, 7, 30


def protected_events(entities: DataFrame) -> DataFrame:
    """(event_id) of all source events of open todos and pinned entities."""
    keep = entities.filter(F.col("pinned") | ((F.col("type") == "todo") & (F.col("status") == "open")))
    ids = F.coalesce("source_event_ids", F.array_compact(F.array("source_event_id")))
    return keep.select(F.explode(ids).alias("event_id")).distinct()


def archivable_events(events: DataFrame, summaries: DataFrame, protected: DataFrame, now: int, days: int = EVENT_DAYS) -> DataFrame:
    """Old events that a summary's range of their session covers and that are not protected; the range test rides on an
    equi-join on the session."""
    spans = summaries.filter("start_s is not null").select("session_id", "start_s", "end_s")
    old = events.filter(F.col("ts_s") < now - days * 86400)
    covered = old.join(spans, (old["session_id"] == spans["session_id"]) & old["ts_s"].between(spans["start_s"], spans["end_s"]), "left_semi")
    return covered.join(protected, "event_id", "left_anti")


def archivable_summaries(summaries: DataFrame, now: int, days: int = SUMMARY_DAYS) -> DataFrame:
    """Old chunk summaries of sessions that have a session summary."""
    whole = summaries.filter("level = 'session'").select("session_id").distinct()
    return summaries.filter((F.col("level") == "chunk") & (F.col("end_s") < now - days * 86400)).join(whole, "session_id", "left_semi")


def archivable_entities(entities: DataFrame, now: int, days: int = ENTITY_DAYS) -> DataFrame:
    return entities.filter(~F.col("archived") & (F.col("updated_s") < now - days * 86400) & ~F.col("pinned") & ~is_open())


def compact(events: DataFrame, summaries: DataFrame, entities: DataFrame, now: int) -> DataFrame:
    """One log row: how many events, summaries and entities a run archives."""
    rows = [
        ("events_archived", archivable_events(events, summaries, protected_events(entities), now)),
        ("summaries_archived", archivable_summaries(summaries, now)),
        ("entities_archived", archivable_entities(entities, now)),
    ]
    out = None
    for name, df in rows:
        row = df.agg(F.count("*").alias(name)).withColumn("run_s", F.lit(now))
        out = row if out is None else out.join(row, "run_s")
    return out
