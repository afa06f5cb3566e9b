"""Ingest: projection, filters, duplicate suppression, sessions, chunks and batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memspark.functions.checkpoints import cut
from memspark.functions.numbering import numbered

TOOL_ARGS, RESULT_HEAD, RESULT_TAIL, EVENT_LIMIT = 1500, 2500, 1500, 100_000
CUT_MARK = "\n[... truncated ...]\n"
EVENT_MARK = "\n[truncated]"
DIRECT_TYPES = ("decision", "discovery", "failure", "todo", "fact")

# Phrases that mark a sentence as worth keeping, three patterns for each type, tried in this order.
DETECT_PATTERNS = (
    ("decision", r"\b(let'?s go with|we'?ll use|we chose|decision:|going with|let'?s use)\b"),
    ("decision", r"\b(the approach (is|will be)|final (approach|decision)|settled on)\b"),
    ("decision", r"\b(switching to|migrating to|replacing .+ with)\b"),
    ("discovery", r"\b(the issue was|turns out|i found that|the root cause is)\b"),
    ("discovery", r"\b(discovered|realized that|it turns out|the problem is)\b"),
    ("discovery", r"\b(confirmed that|verified that|the fix is)\b"),
    ("failure", r"\b(this didn'?t work because|failed (to|because)|error:)\b"),
    ("failure", r"\b(cannot|can'?t|unable to) .+ because\b"),
    ("failure", r"\b(traceback|exception|segfault|crash(ed)?)\b"),
    ("todo", r"\b(we need to|next step is|still need to|todo:|to-do:)\b"),
    ("todo", r"\b(should (also )?(implement|add|fix|update|create))\b"),
    ("todo", r"\b(remaining work|outstanding (tasks?|items?))\b"),
)


def message_events(messages: DataFrame) -> DataFrame:
    """A chat message (id, role, text, tools array, files array) as prompt or response, tool_call and file_change events."""
    own = F.when(F.trim(F.coalesce("text", F.lit(""))) != "", F.struct(F.when(F.col("role") == "user", "prompt").otherwise("response").alias("type"), F.col("text").alias("content")))
    calls = F.transform("tools", lambda t: F.struct(F.lit("tool_call").alias("type"), t.alias("content")))
    changes = F.transform("files", lambda f: F.struct(F.lit("file_change").alias("type"), F.concat(F.lit("modified: "), f).alias("content")))
    every = F.array_compact(F.concat(F.array(own), calls, changes))
    return messages.select("id", F.posexplode(every).alias("number", "e")).select("id", "number", "e.type", "e.content")


def truncate(c: Column, limit: int, mark: str = "") -> Column:
    return F.when(F.length(c) > limit, F.concat(F.substring(c, 1, limit), F.lit(mark))).otherwise(c)


def truncate_head_tail(c: Column, head: int = RESULT_HEAD, tail: int = RESULT_TAIL) -> Column:
    """Long text with its middle cut out; errors often stand at the end."""
    return F.when(F.length(c) > head + tail, F.concat(F.substring(c, 1, head), F.lit(CUT_MARK), F.right(c, F.lit(tail)))).otherwise(c)


def filter_tools(events: DataFrame, tools: list[str], globs: list[str]) -> DataFrame:
    """Without calls of the named tools (the name before the parenthesis, or tool_name of a result) and without calls that a
    case-sensitive glob fits."""
    name = F.when(F.col("type") == "tool_call", F.substring_index("content", "(", 1)).when(F.col("type") == "tool_result", F.col("tool_name"))
    skip = F.coalesce(name.isin(tools), F.lit(False)) if tools else F.lit(False)
    for glob in globs:
        pattern = "".join(".*" if c == "*" else "." if c == "?" else "\\" + c if c in r"\.[]{}()+-^$|" else c for c in glob)
        skip = skip | F.coalesce((F.col("type") == "tool_call") & F.col("content").rlike(f"(?s)^{pattern}$"), F.lit(False))
    return events.filter(~skip)


def drop_recent_duplicates(events: DataFrame, keys: list[str], seconds: int = 60) -> DataFrame:
    """Events of which none with the same key was kept within the seconds before: keys, ts_s, event_id.

    The window counts from the last kept row, not from the last row. Of one second's events the smallest event_id may be
    kept. A gap longer than the window begins a run, whose first row is kept, and every row points to the first one after
    its own window; all that a run's first row leads to are kept. A row and what its window may reach lie in three
    neighbouring buckets of time, so no task holds a key; pointers are doubled until no kept row has one, so that passes
    grow with the logarithm of the longest run. Events without a time are kept; keys may be null.
    """
    key = F.struct(*[F.col(c) for c in keys])
    timed = events.filter("ts_s is not null").groupBy(key.alias("_key"), "ts_s").agg(F.min("event_id").alias("event_id"))
    width = seconds + 1
    rows = timed.withColumn("_at", F.col("ts_s").cast("long"))
    seen = F.explode(F.array(*[F.struct((F.floor(F.col("_at") / width) + i).alias("bucket"), F.lit(i).alias("from")) for i in range(3)]))
    near = rows.select("_key", "_at", seen.alias("s")).select("_key", "_at", "s.bucket", "s.from")
    # from = 0: the row stands in the bucket; 1, 2: it asks there for what follows its window
    by = Window.partitionBy("_key", "bucket")
    place = F.when(F.col("from") > 0, F.col("_at") + width).otherwise(F.col("_at"))
    order = by.orderBy(place, F.when(F.col("from") > 0, 0).otherwise(1))
    after = F.min(F.when(F.col("from") == 0, F.col("_at"))).over(order.rowsBetween(0, Window.unboundedFollowing))
    near = near.withColumn("after", F.when(F.col("from") > 0, after))
    before = near.groupBy("_key", "_at").agg(F.min("after").alias("to"))
    behind = rows.select("_key", F.col("_at").alias("from_"), F.explode(F.sequence(F.lit(0), F.lit(1))).alias("i")).select("_key", "from_", (F.floor(F.col("from_") / width) + F.col("i")).alias("bucket"), F.col("i"))
    # a run begins where no row stands within the window before: looked up in the row's own bucket and the one before
    last = F.max(F.when(F.col("side") == 0, F.col("_at"))).over(Window.partitionBy("_key", "bucket").orderBy("_at", F.col("side").desc()).rowsBetween(Window.unboundedPreceding, -1))
    stand = behind.select("_key", F.col("from_").alias("_at"), "bucket", F.lit(0).alias("side")).union(rows.select("_key", "_at", F.floor(F.col("_at") / width), F.lit(1)))
    heads = stand.withColumn("last", last).filter("side = 1").select("_key", "_at", (F.col("last").isNull() | (F.col("_at") - F.col("last") > seconds)).alias("kept"))
    state = cut(before.join(heads, ["_key", "_at"]))
    while not state.filter("kept and to is not null").isEmpty():
        hop = state.select(F.col("_key").alias("_k"), F.col("_at").alias("_hop"), F.col("to").alias("_next"))
        led = state.join(hop, (F.col("_key") == F.col("_k")) & (F.col("to") == F.col("_hop")), "left")
        own = F.struct("_at", F.col("_next").alias("to"), "kept")
        marked = F.when(F.col("kept") & F.col("to").isNotNull(), F.struct(F.col("to").alias("_at"), F.lit(None).cast("long").alias("to"), F.lit(True).alias("kept")))
        both = led.select("_key", F.explode(F.array_compact(F.array(own, marked))).alias("s")).select("_key", "s.*")
        state = cut(both.groupBy("_key", "_at").agg(F.max("to").alias("to"), F.max("kept").alias("kept")))
    kept = state.filter("kept").select(F.col("_key").alias("_k"), "_at")
    out = rows.join(kept.withColumnRenamed("_at", "_kept"), (F.col("_key") == F.col("_k")) & (F.col("_at") == F.col("_kept"))).select(*[F.col(f"_key.{c}").alias(c) for c in keys], "ts_s", "event_id")
    return out.union(events.filter("ts_s is null").select(*keys, "ts_s", "event_id"))


def direct_entities(events: DataFrame) -> DataFrame:
    """Entities from events that state one: title is the first line of the first 120 characters; a todo is open."""
    title = F.trim(F.substring_index(F.substring("content", 1, 120), "\n", 1))
    status = F.when(F.col("type") == "todo", "open")
    return events.filter(F.col("type").isin(*DIRECT_TYPES)).select(F.col("event_id").alias("source_event_id"), "type", title.alias("title"), "content", status.alias("status"))


def split_sentences(text: Column) -> Column:
    marked = F.regexp_replace(text, r"([.!?])\s+|\n+", "$1\u0001")
    return F.filter(F.transform(F.split(marked, "\u0001"), lambda s: F.trim(s)), lambda s: F.length(s) > 5)


def detect_statements(events: DataFrame, patterns: tuple = DETECT_PATTERNS) -> DataFrame:
    """The first sentence that each pattern fits, as (event_id, type, snippet); repeats of a type's snippet go.

    A sentence is tested once against every pattern, each compiled once, and gives the numbers of those that fit.
    """
    long = events.filter(F.length("content") >= 10).select("event_id", F.posexplode(split_sentences(F.col("content"))).alias("at", "sentence"))
    fits = [F.when(F.col("sentence").rlike("(?i)" + p), F.struct(F.lit(i).alias("pattern"), F.lit(t).alias("type"))) for i, (t, p) in enumerate(patterns)]
    found = long.select("event_id", "at", "sentence", F.explode(F.array_compact(F.array(*fits))).alias("fit"))
    first = found.groupBy("event_id", "fit").agg(F.min_by("sentence", "at").alias("sentence"))
    return first.select("event_id", F.col("fit.type").alias("type"), F.substring("sentence", 1, 500).alias("snippet")).distinct()


def sessionize(events: DataFrame, gap: int = 300) -> DataFrame:
    """Sessions of each source: a new one begins after an idle gap. Adds number (from 0) and session_id."""
    by = Window.partitionBy("source").orderBy("ts_s", "event_id")
    fresh = F.when(F.col("ts_s") - F.lag("ts_s").over(by) <= gap, 0).otherwise(1)
    number = F.sum("_new").over(by) - 1
    return events.withColumn("_new", fresh).withColumn("number", number).drop("_new").withColumn("session_id", F.concat_ws("-", "source", "number"))


def session_rollup(events: DataFrame, now: int, gap: int = 300) -> DataFrame:
    """Sessions from sessionized events: start, end, event_count, status, and the one they continue."""
    out = events.groupBy("source", "number", "session_id").agg(F.min("ts_s").alias("started_s"), F.max("ts_s").alias("ended_s"), F.count("*").alias("event_count"))
    status = F.when(F.col("ended_s") < now - gap, "ended").otherwise("active")
    return out.withColumn("status", status).withColumn("continuation_of", F.lag("session_id").over(Window.partitionBy("source").orderBy("number")))


def chunk_events(events: DataFrame, n: int = 20) -> DataFrame:
    """Full chunks of n events of a session in time order: session_id, chunk, event_ids, start_s, end_s."""
    by = Window.partitionBy("session_id").orderBy("ts_s", "event_id")
    rows = events.withColumn("chunk", F.floor((F.row_number().over(by) - 1) / n))
    out = rows.groupBy("session_id", "chunk").agg(F.array_sort(F.collect_list(F.struct("ts_s", "event_id"))).alias("all"))
    out = out.filter(F.size("all") == n)
    return out.select("session_id", "chunk", F.transform("all", lambda x: x["event_id"]).alias("event_ids"), F.element_at("all", 1)["ts_s"].alias("start_s"), F.element_at("all", -1)["ts_s"].alias("end_s"))


def every_nth_session(sessions: DataFrame, n: int = 5) -> DataFrame:
    """Every n-th ended session of a project, in order of its end."""
    return numbered(sessions.filter("status = 'ended'"), ["project_id"], ["ended_s", "session_id"], "ordinal").filter(F.col("ordinal") % n == 0)


def batch_events(events: DataFrame, n: int = 50) -> DataFrame:
    """Batches of at most n events of a project's (session, time) order; a batch may cross sessions."""
    rows = numbered(events.select("project_id", "session_id", "ts_s", "event_id"), ["project_id"], ["session_id", "ts_s", "event_id"])
    out = rows.groupBy("project_id", F.floor((F.col("number") - 1) / n).alias("batch")).agg(F.array_sort(F.collect_list(F.struct("number", "event_id"))).alias("all"))
    return out.select("project_id", "batch", F.transform("all", lambda x: x["event_id"]).alias("event_ids"))


def context_pressure(sessions: DataFrame, limit: int, flag_at: float = 0.8, per_message: int = 500) -> DataFrame:
    """Tokens (an estimate from messages where unknown), their ratio to the limit, and whether it is high."""
    tokens = F.coalesce("tokens", F.col("event_count") * per_message)
    ratio = F.least(F.lit(1.0), tokens / F.lit(limit))
    return sessions.select("session_id", tokens.alias("tokens"), F.round(ratio, 6).alias("ratio"), (ratio >= flag_at).alias("compress"))


def compress_context(events: DataFrame, flagged: DataFrame, n: int = 30) -> DataFrame:
    """The oldest n events of each flagged session as one summary row."""
    by = Window.partitionBy("session_id").orderBy("ts_s", "event_id")
    rows = events.join(flagged.select("session_id"), "session_id", "left_semi").withColumn("number", F.row_number().over(by)).filter(F.col("number") <= n)
    out = rows.groupBy("session_id").agg(F.min("ts_s").alias("start_s"), F.max("ts_s").alias("end_s"), F.count("*").alias("events"), F.array_sort(F.collect_list(F.struct("number", "type"))).alias("all"))
    return out.select("session_id", "start_s", "end_s", "events", F.array_join(F.transform("all", lambda x: x["type"]), ",").alias("outline"))


def compression_summaries(compressed: DataFrame, now: int) -> DataFrame:
    """Summary rows of compressed sessions (``compress_context``), a chunk each: id, session_id, level, content, range_start,
    range_end, event_count, token_count and created_s. The id is of the session and its range, so that a second run adds no other row."""
    name = F.concat_ws("-", F.lit("chunk"), "session_id", "start_s", "end_s")
    return compressed.select(
        name.alias("id"), "session_id", F.lit("chunk").alias("level"), F.col("outline").alias("content"), F.col("start_s").alias("range_start"), F.col("end_s").alias("range_end"),
        F.col("events").alias("event_count"), F.floor(F.length("outline") / 4).alias("token_count"), F.lit(now).cast("long").alias("created_s"),
    )


def count_compressions(sessions: DataFrame, summaries: DataFrame) -> DataFrame:
    """Sessions with compression_events and last_compression_s after the summaries: counts add up, the last time moves forward."""
    new = summaries.groupBy(F.col("session_id").alias("_session")).agg(F.count("*").alias("_n"), F.max("created_s").alias("_at"))
    out = sessions.join(new, F.col("session_id") == F.col("_session"), "left")
    events = (F.coalesce("compression_events", F.lit(0)) if "compression_events" in sessions.columns else F.lit(0)) + F.coalesce("_n", F.lit(0))
    last = F.greatest("last_compression_s", "_at") if "last_compression_s" in sessions.columns else F.col("_at")
    return out.withColumns({"compression_events": events, "last_compression_s": last}).drop("_session", "_n", "_at")
