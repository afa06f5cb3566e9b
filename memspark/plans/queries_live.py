"""Queries over transcripts, embeddings by a callable, and the operators as streams run to the end of a table."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memspark.functions.checkpoints import shared_folder
from memspark.functions.text import each, porter_stem
from memspark.operators import embed, search
from memspark.plans.bridge import Bridge, with_views
from memspark.sources import tables, tailing, transcripts
from memspark.streaming import live

Q, S = {}, {}


def query(name: str, sql: str | None = None, recursive: bool = False):
    def add(f):
        Q[name] = lambda spark, sf_dir: f(Bridge(spark, sf_dir))
        if sql:
            S[name] = with_views(sql, recursive)
        return f

    return add


@query("a3_read_chat_messages", """
SELECT event_id AS message_id, session_id, type AS role, ts_s, substr(content, 1, 40) || chr(10) || substr(content, 41) AS text, [substr(md5(content), 1, 4)] AS tools FROM mem_events WHERE length(content) >= 0""")
def _(b):
    e = b.events
    messages = e.selectExpr("event_id as message_id", "session_id", "type as role", "ts_s")
    part = lambda n, kind, field, value: F.struct(F.lit(n).alias("number"), F.to_json(F.struct(F.lit(kind).alias("type"), F.expr(value).alias(field))).alias("payload"))
    parts = e.select(F.col("event_id").alias("message_id"), F.explode(F.array(part(2, "text", "text", "substring(content, 41)"), part(1, "tool", "tool", "substring(md5(content), 1, 4)"), part(0, "text", "text", "substring(content, 1, 40)"))).alias("p")).select("message_id", "p.number", "p.payload")
    return tables.read_chat_messages(messages, parts)


def lines(b) -> DataFrame:
    """Conversations as lines of transcripts: user texts, and assistant turns with a text, a call, and its result in the next line."""
    user = """to_json(named_struct('type', 'user', 'timestamp', cast(ts_s as string), 'message', named_struct('role', 'user', 'content', content)))"""
    call = """to_json(named_struct('type', 'assistant', 'timestamp', cast(ts_s as string), 'message', named_struct('model', concat('m', session_id % 3), 'content', array(named_struct('type', 'text', 'text', content, 'id', null, 'name', null, 'input', null), named_struct('type', 'tool_use', 'text', null, 'id', cast(event_id as string), 'name', 'Read', 'input', named_struct('path', concat('f', event_id)))))))"""
    result = """to_json(named_struct('type', 'user', 'message', named_struct('content', array(named_struct('type', 'tool_result', 'tool_use_id', cast(event_id as string), 'content', concat('result ', event_id))))))"""
    e = b.events
    rows = e.filter("type = 'prompt'").selectExpr("session_id", "event_id * 2 as line_no", f"{user} as value").union(e.filter("type = 'response'").selectExpr("session_id", "event_id * 2", f"{call}")).union(e.filter("type = 'response'").selectExpr("session_id", "event_id * 2 + 1", f"{result}"))
    return rows.selectExpr("cast(session_id as string) as source", "line_no", "value")


def records(b) -> DataFrame:
    return lines(b).selectExpr("source", "line_no", "try_parse_json(value) as record").filter("record is not null")


def _files(b) -> str:
    """The lines as files in the shared folder, each with a line that is no JSON and an empty one."""
    top = f"{shared_folder(b.spark)}/lines-{uuid.uuid4().hex}"
    odd = b.spark.createDataFrame([("{broken",), ("",), ("[1]",)], "value string")
    lines(b).select("value").union(odd).write.text(top)
    return top


_EVENTS = """ev AS (SELECT CAST(session_id AS VARCHAR) AS source, event_id * 2 AS line_no, 0 AS number, 'prompt' AS type, trim(content) AS content, NULL AS tool_name FROM mem_events WHERE type = 'prompt' AND trim(content) <> ''
 UNION ALL SELECT CAST(session_id AS VARCHAR), event_id * 2, 0, 'response', content, NULL FROM mem_events WHERE type = 'response' AND trim(content) <> ''
 UNION ALL SELECT CAST(session_id AS VARCHAR), event_id * 2, 1, 'tool_call', 'Read({"path":"f' || event_id || '"})', 'Read' FROM mem_events WHERE type = 'response'
 UNION ALL SELECT CAST(session_id AS VARCHAR), event_id * 2 + 1, 0, 'tool_result', 'result ' || event_id, 'Read' FROM mem_events WHERE type = 'response')"""


@query("a1_read_transcripts", f"{_EVENTS} SELECT type, content FROM ev")
def _(b):
    return transcripts.map_transcript(transcripts.read_transcripts(b.spark, _files(b))).select("type", "content")


@query("a2_tail_transcripts", f"{_EVENTS} SELECT type, content FROM ev")
def _(b):
    stream = tailing.tail_transcripts(b.spark, _files(b), suffix=".txt")
    return _finished(b, transcripts.map_transcript(stream).select("type", "content"))


@query("b1_map_transcript", f"{_EVENTS} SELECT source, line_no, number, type, content FROM ev")
def _(b):
    return transcripts.map_transcript(records(b)).select("source", "line_no", "number", "type", "content")


@query("b2_tool_names", f"{_EVENTS} SELECT source, line_no, number, tool_name FROM ev")
def _(b):
    return transcripts.resolve_tool_names(transcripts.map_transcript(records(b))).select("source", "line_no", "number", "tool_name")


@query("a7_transcript_models", "SELECT CAST(session_id AS VARCHAR) AS source, 'm' || (session_id % 3) AS model FROM mem_events WHERE type = 'response' GROUP BY session_id")
def _(b):
    return transcripts.transcript_models(records(b))


@query("i30_tool_call_counts", "SELECT CAST(session_id AS VARCHAR) AS source, count(*) FILTER (type = 'response') AS calls FROM mem_events GROUP BY session_id")
def _(b):
    return transcripts.tool_call_counts(transcripts.map_transcript(records(b)), "Read")


@query("d2_build_index_stemmed")
def _(b):
    stem = F.pandas_udf(each(porter_stem), "string")
    return search.build_index(b.entities, "id", ["title", "content"], stem).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("tf"))


def _vectors(texts: list[str]) -> list[list[float]]:
    """A stand-in for an embedding model: letter counts."""
    return [[float(t.count(c)) for c in "etaoin"] for t in texts]


_LETTERS = "[" + ", ".join(f"CAST(length(t) - length(replace(t, '{c}', '')) AS DOUBLE)" for c in "etaoin") + "]"


@query("e2_embed", f"SELECT id, {_LETTERS} AS vector FROM (SELECT id, substr(concat_ws(chr(10), nullif(trim(title), ''), nullif(trim(content), '')), 1, 2000) AS t FROM mem_entities)")
def _(b):
    texts = b.entities.select("id", embed.embedding_text(["title", "content"]).alias("text"))
    return embed.embed(texts, "id", "text", _vectors, "letters|").select("id", "vector")


@query("e4_backfill", "SELECT model, count(*) AS n, CAST(sum(dim) AS BIGINT) AS dims FROM (SELECT model, dim FROM mem_embeddings UNION ALL SELECT 'm|', 6 FROM mem_entities WHERE NOT archived AND NOT stale AND id NOT IN (SELECT entity_id FROM mem_embeddings WHERE model = 'm|')) GROUP BY model")
def _(b):
    have = b.embeddings.withColumn("vector", F.col("vector").cast("array<double>"))
    return embed.backfill(b.entities, have, ["title", "content"], _vectors, "m").groupBy("model").agg(F.count("*").alias("n"), F.sum("dim").alias("dims"))


def _stream(b) -> DataFrame:
    """The events table as a stream of files."""
    schema = b.table("events").schema
    stream = b.spark.readStream.schema(schema).parquet(f"{b.sf_dir}/events.parque[t]")  # a pattern may be a file or a folder
    return stream.select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("source"), F.col("event_type").alias("type"), F.col("props").alias("content"))


def _finished(b, stream: DataFrame, mode: str = "append") -> DataFrame:
    """All that the stream gives until the table's end, through a table in the shared folder."""
    top = f"{shared_folder(b.spark)}/stream-{uuid.uuid4().hex}"
    if mode == "append":
        stream.writeStream.format("parquet").option("path", f"{top}/out").option("checkpointLocation", f"{top}/state").trigger(availableNow=True).start().awaitTermination()
    else:
        stream.writeStream.foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{top}/out")).option("checkpointLocation", f"{top}/state").outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    return b.spark.read.schema(stream.schema).parquet(f"{top}/out")


@query("m1_live_etl")
def _(b):
    events = _stream(b).withColumn("tool_name", F.lit(None).cast("string"))
    return _finished(b, live.live_etl(events, "event_id", ["read"], ["*7?"], "0123456789abcdef")).select("event_id", "type", "content")


@contextmanager
def _rocksdb(b):
    """The state store that keyed state needs, while a stream is set up and run."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = b.spark.conf.get(name)
    b.spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        b.spark.conf.set(name, before)


# the last event closes no window: the watermark stays just before it
@query("m2_suppress_duplicates", """
o AS (SELECT source, type, ts_s, event_id, row_number() OVER (PARTITION BY source, type ORDER BY ts_s, event_id) AS r FROM mem_activity WHERE ts_s < (SELECT max(ts_s) FROM mem_activity)),
w AS (SELECT source, type, ts_s, event_id, r, ts_s AS kept, TRUE AS keep FROM o WHERE r = 1
  UNION ALL SELECT o.source, o.type, o.ts_s, o.event_id, o.r, CASE WHEN o.ts_s - w.kept > 14400 THEN o.ts_s ELSE w.kept END, o.ts_s - w.kept > 14400
  FROM w JOIN o ON o.source = w.source AND o.type = w.type AND o.r = w.r + 1)
SELECT source, type, ts_s, event_id FROM w WHERE keep""", recursive=True)
def _(b):
    with _rocksdb(b):
        whole = _stream(b).withColumn("ts", F.date_trunc("second", "ts"))
        return _finished(b, live.suppress_duplicates(whole, ["source", "type"], seconds=14400)).select("source", "type", F.unix_seconds("ts").alias("ts_s"), "event_id")


@query("m3_live_sessions", """
g AS (SELECT user_id AS source, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 4 HOURS THEN 0 ELSE 1 END AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
k AS (SELECT *, sum(n) OVER (PARTITION BY source ORDER BY ts ROWS UNBOUNDED PRECEDING) AS number FROM g)
SELECT source, min(ts) AS started, max(ts) + INTERVAL 4 HOURS AS ended, count(*) AS event_count FROM k GROUP BY source, number""")
def _(b):
    return _finished(b, live.live_sessions(_stream(b), "source", "4 hours"), "complete").select("source", "started", "ended", "event_count")


@query("m4_live_chunks")
def _(b):
    with _rocksdb(b):
        events = _stream(b).select(F.col("source").alias("session_id"), F.unix_seconds("ts").alias("ts_s"), "event_id")
        return _finished(b, live.live_chunks(events, 20))


@query("m5_match_tools")
def _(b):
    calls = _stream(b).filter("type = 'click'").select("source", F.col("content").alias("tool_use_id"), F.col("type").alias("tool_name"), "ts")
    results = _stream(b).filter("type = 'view'").select("source", F.col("content").alias("tool_use_id"), F.col("event_id").alias("result_id"), "ts")
    return _finished(b, live.match_tools(calls, results, "1 day", "1 day"))


@query("m6_keep_up", "SELECT type, count(*) AS n FROM mem_activity GROUP BY type")
def _(b):
    top = f"{shared_folder(b.spark)}/counts-{uuid.uuid4().hex}"
    update = lambda df, n: df.groupBy("type").agg(F.count("*").alias("n")).write.mode("overwrite").parquet(f"{top}/batch={n}")
    live.keep_up(_stream(b), update, f"{top}-state").awaitTermination()
    return b.spark.read.schema("type string, n long").parquet(f"{top}/batch=*").groupBy("type").agg(F.sum("n").alias("n"))


@query("m7_live_counters", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type AS type, count(*) AS n FROM events GROUP BY ALL")
def _(b):
    return _finished(b, live.live_counters(_stream(b)), "complete")
