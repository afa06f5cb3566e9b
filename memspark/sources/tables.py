"""Sources and sinks over tables: incremental reads, discovery, idempotent import, upserts and lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def read_chat_messages(messages: DataFrame, parts: DataFrame) -> DataFrame:
    """Messages (message_id, session_id, role, ts) with their parts (message_id, number, payload JSON) put together in
    order: text is the text parts joined by line feeds, tools the names of the tool parts."""
    body = F.from_json("payload", "type string, text string, tool string")
    rows = parts.select("message_id", "number", body.alias("p"))
    joined = rows.groupBy("message_id").agg(F.array_sort(F.collect_list(F.struct("number", "p"))).alias("parts"))
    texts = F.filter("parts", lambda x: (x["p"]["type"] == "text") & x["p"]["text"].isNotNull())
    tools = F.filter("parts", lambda x: x["p"]["type"] == "tool")
    return messages.join(joined, "message_id", "left").select(
        *messages.columns, F.coalesce(F.array_join(F.transform(texts, lambda x: x["p"]["text"]), "\n"), F.lit("")).alias("text"),
        F.coalesce(F.transform(tools, lambda x: x["p"]["tool"]), F.array().cast("array<string>")).alias("tools"),
    )


def new_messages(messages: DataFrame, cursors: DataFrame) -> DataFrame:
    """Messages after their session's cursor and before its first assistant message that has no content yet."""
    fresh = messages.join(cursors, "session_id", "left").filter(F.col("cursor_s").isNull() | (F.col("ts_s") > F.col("cursor_s")))
    open_ = F.when((F.col("type") == "response") & (F.coalesce("content", F.lit("")) == ""), F.col("ts_s"))
    barrier = fresh.groupBy("session_id").agg(F.min(open_).alias("barrier_s"))
    return fresh.join(barrier, "session_id").filter("barrier_s is null or ts_s < barrier_s").drop("cursor_s", "barrier_s")


def map_feed_events(feed: DataFrame) -> DataFrame:
    """Typed feed rows (id, kind, role, content, tool, args, path, change) as events (id, type, content)."""
    args = F.substring(F.coalesce("args", F.lit("")), 1, 200)
    tool = F.coalesce("tool", F.lit("unknown"))
    kind = F.col("kind")
    type_ = (
        F.when((kind == "message.created") & (F.coalesce("content", F.lit("")) != ""), F.when(F.col("role") == "user", "prompt").otherwise("response"))
        .when(kind == "tool.invoked", "tool_call")
        .when(kind == "file.changed", "file_change")
    )
    content = (
        F.when(kind == "message.created", F.col("content"))
        .when(kind == "tool.invoked", F.when(args != "", F.concat(tool, F.lit("("), args, F.lit(")"))).otherwise(tool))
        .otherwise(F.concat(F.coalesce("change", F.lit("modified")), F.lit(": "), F.coalesce("path", F.lit("unknown"))))
    )
    return feed.select("id", type_.alias("type"), content.alias("content")).filter("type is not null")


def discover_sessions(events: DataFrame) -> DataFrame:
    """Per session: first and last time, messages of user and assistant, and the first user text as title (80 characters)."""
    user = F.when((F.col("type") == "prompt") & (F.trim("content") != ""), F.struct("ts_s", "event_id", F.substring(F.trim("content"), 1, 80).alias("title")))
    return events.groupBy("session_id").agg(
        F.min("ts_s").alias("first_s"), F.max("ts_s").alias("last_s"), F.count_if(F.col("type").isin("prompt", "response")).alias("messages"), F.min(user)["title"].alias("title")
    )


def not_imported(sources: DataFrame, imported: DataFrame, keys: list[str]) -> DataFrame:
    """Sources that have not been imported yet."""
    return sources.join(imported, keys, "left_anti")


def upsert_latest(base: DataFrame, updates: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Rows of both tables, the latest by ``order`` for every key; updates win ties."""
    both = base.withColumn("_new", F.lit(0)).unionByName(updates.withColumn("_new", F.lit(1)))
    row = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(order).desc(), F.col("_new").desc()))
    return both.withColumn("_row", row).filter("_row = 1").drop("_new", "_row")


def insert_ignore(base: DataFrame, new: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    """``base`` and those rows of ``new`` whose key it has not, the first by ``order`` of each."""
    row = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    first = new.withColumn("_row", row).filter("_row = 1").drop("_row")
    return base.unionByName(first.join(base, keys, "left_anti"))


def run_metrics(decisions: DataFrame, by: str, verdict: str, verdicts: list[str]) -> DataFrame:
    """One log row for each value of ``by``, with a counter for each verdict."""
    return decisions.groupBy(by).agg(*[F.count_if(F.col(verdict) == v).alias(f"n_{v.lower()}") for v in verdicts], F.count("*").alias("n_total"))


def append_events(events: DataFrame, path: str) -> None:
    """Append events to a table laid out by project and day."""
    day = F.to_date(F.timestamp_seconds("ts_s"))
    events.withColumn("day", day).write.mode("append").partitionBy("project_id", "day").parquet(path)


def lookup(df: DataFrame, ids: DataFrame, key: str, live_only: bool = False, types: list[str] | None = None) -> DataFrame:
    """Rows with one of the ids; optionally only those neither archived nor stale, and of some types."""
    out = df.join(ids.select(key).distinct(), key, "left_semi")
    if live_only:
        out = out.filter("not archived and not stale")
    return out.filter(F.col("type").isin(types)) if types else out
