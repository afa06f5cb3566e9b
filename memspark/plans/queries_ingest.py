"""Queries over sources, sinks and ingest operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from memspark.operators import ingest
from memspark.plans.bridge import E0, NOW, Bridge, with_views
from memspark.sources import tables

Q, S = {}, {}


def query(name: str, sql: str | None = None, recursive: bool = False):
    def add(f):
        Q[name] = lambda spark, sf_dir: f(Bridge(spark, sf_dir))
        if sql:
            S[name] = with_views(sql, recursive)
        return f

    return add


_HOLES = "CASE WHEN type = 'response' AND event_id % 11 = 0 THEN '' ELSE content END"


@query("a4_new_messages", f"""
f AS (SELECT e.event_id, e.session_id, e.ts_s, e.type, {_HOLES} AS content FROM mem_events e
  LEFT JOIN (SELECT session_id, started_s + 60 AS cursor_s FROM mem_sessions WHERE session_id % 2 = 0) c USING (session_id) WHERE cursor_s IS NULL OR ts_s > cursor_s),
b AS (SELECT session_id, min(CASE WHEN type = 'response' AND content = '' THEN ts_s END) AS barrier FROM f GROUP BY session_id)
SELECT event_id, session_id, ts_s FROM f JOIN b USING (session_id) WHERE barrier IS NULL OR ts_s < barrier""")
def _(b):
    messages = b.events.withColumn("content", F.expr(_HOLES))
    cursors = b.sessions.filter("session_id % 2 = 0").selectExpr("session_id", "started_s + 60 as cursor_s")
    return tables.new_messages(messages, cursors).select("event_id", "session_id", "ts_s")


_FEED = "CASE type WHEN 'view' THEN 'message.created' WHEN 'click' THEN 'tool.invoked' WHEN 'purchase' THEN 'file.changed' ELSE 'session.created' END"


@query("a5_map_feed_events", f"""
f AS (SELECT event_id AS id, {_FEED} AS kind, source % 2 = 0 AS user, content FROM mem_activity)
SELECT id, CASE kind WHEN 'message.created' THEN CASE WHEN user THEN 'prompt' ELSE 'response' END WHEN 'tool.invoked' THEN 'tool_call' ELSE 'file_change' END AS type,
 CASE kind WHEN 'message.created' THEN content WHEN 'tool.invoked' THEN 'tool(' || content || ')' ELSE 'modified: ' || content END AS content
FROM f WHERE kind <> 'session.created' AND NOT (kind = 'message.created' AND content = '')""")
def _(b):
    feed = b.activity.selectExpr("event_id as id", f"{_FEED} as kind", "if(source % 2 = 0, 'user', 'assistant') as role", "content", "'tool' as tool", "content as args", "content as path", "cast(null as string) as change")
    return tables.map_feed_events(feed)


@query("a6_discover_sessions", """SELECT session_id, min(ts_s) AS first_s, max(ts_s) AS last_s, count(*) FILTER (type IN ('prompt', 'response')) AS messages,
 arg_min(substr(trim(content), 1, 80), ts_s * 100000 + event_id % 100000) FILTER (type = 'prompt' AND trim(content) <> '') AS title FROM mem_events GROUP BY session_id""")
def _(b):
    return tables.discover_sessions(b.events)


@query("a8_not_imported", "SELECT session_id, project_id, started_s FROM mem_sessions WHERE session_id NOT IN (SELECT session_id FROM mem_summaries WHERE level = 'session')")
def _(b):
    done = b.summaries.filter("level = 'session'").select("session_id", "project_id").distinct()
    return tables.not_imported(b.sessions, done, ["session_id", "project_id"]).select("session_id", "project_id", "started_s")


@query("a9_upsert_latest", """
u AS (SELECT source, ts_s, type FROM mem_activity WHERE type <> 'error' UNION ALL SELECT source, ts_s, 'error!' FROM mem_activity WHERE type = 'error')
SELECT source, ts_s, type FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY ts_s DESC, type = 'error!' DESC, type) AS r FROM u) WHERE r = 1""")
def _(b):
    rows = b.activity.select("source", "ts_s", "type")
    base = rows.filter("type <> 'error'").groupBy("source", "ts_s").agg(F.min("type").alias("type"))
    return tables.upsert_latest(base, rows.filter("type = 'error'").withColumn("type", F.lit("error!")), ["source"], "ts_s")


@query("a10_insert_ignore", """
a AS (SELECT entity_id, file_path, line_number FROM mem_files WHERE entity_id % 2 = 0),
n AS (SELECT entity_id, file_path, line_number + 100 AS line_number FROM mem_files)
SELECT * FROM a UNION ALL SELECT * FROM n WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.entity_id = n.entity_id AND a.file_path = n.file_path)""")
def _(b):
    base = b.files.filter("entity_id % 2 = 0")
    new = b.files.withColumn("line_number", F.col("line_number") + 100)
    return tables.insert_ignore(base, new.unionByName(new.withColumn("line_number", F.col("line_number") + 1)), ["entity_id", "file_path"], ["line_number"])


@query("a11_run_metrics", """SELECT batch, count(*) FILTER (verdict = 'ADD') AS n_add, count(*) FILTER (verdict = 'UPDATE') AS n_update,
 count(*) FILTER (verdict = 'NOOP') AS n_noop, count(*) AS n_total FROM verdicts GROUP BY batch""")
def _(b):
    return tables.run_metrics(b.verdicts, "batch", "verdict", ["ADD", "UPDATE", "NOOP"])


@query("a13_lookup", "SELECT id, type, title FROM mem_entities WHERE id IN (SELECT doc_id + 1 FROM labels) AND NOT archived AND NOT stale AND type IN ('todo', 'fact', 'decision')")
def _(b):
    ids = b.table("labels").selectExpr("doc_id + 1 as id")
    return tables.lookup(b.entities, ids, "id", True, ["todo", "fact", "decision"]).select("id", "type", "title")


@query("b3_message_events", """
m AS (SELECT event_id AS id, type, content, [substr(md5(content), 1, 4)] AS tools FROM mem_events)
SELECT id, CAST(0 AS INTEGER) AS number, type, content FROM m WHERE trim(content) <> ''
UNION ALL SELECT id, CASE WHEN trim(content) <> '' THEN 1 ELSE 0 END, 'tool_call', tools[1] FROM m
UNION ALL SELECT id, CASE WHEN trim(content) <> '' THEN 2 ELSE 1 END, 'file_change', 'modified: ' || tools[1] || '.py' FROM m""")
def _(b):
    m = b.events.selectExpr("event_id as id", "if(type = 'prompt', 'user', 'assistant') as role", "content as text", "array(substr(md5(content), 1, 4)) as tools")
    return ingest.message_events(m.withColumn("files", F.transform("tools", lambda t: F.concat(t, F.lit(".py")))))


@query("b4_truncate", """SELECT id, CASE WHEN length(content) > 1500 THEN substr(content, 1, 1500) ELSE content END AS args,
 CASE WHEN length(content) > 4000 THEN substr(content, 1, 2500) || chr(10) || '[... truncated ...]' || chr(10) || right(content, 1500) ELSE content END AS result,
 CASE WHEN length(content) > 100000 THEN substr(content, 1, 100000) || chr(10) || '[truncated]' ELSE content END AS body FROM mem_entities""")
def _(b):
    c = F.col("content")
    return b.entities.select("id", ingest.truncate(c, ingest.TOOL_ARGS).alias("args"), ingest.truncate_head_tail(c).alias("result"), ingest.truncate(c, ingest.EVENT_LIMIT, ingest.EVENT_MARK).alias("body"))


@query("b5_filter_tools", "SELECT event_id, type FROM mem_activity WHERE NOT (type = 'click' AND source % 3 = 0) AND NOT (type = 'click' AND regexp_matches(content, '^.*7.$'))")
def _(b):
    e = b.activity.selectExpr("event_id", "type as original", "if(type = 'click', 'tool_call', type) as type", "if(source % 3 = 0, concat('read(', content, ')'), content) as content", "cast(null as string) as tool_name")
    return ingest.filter_tools(e, ["read"], ["*7?"]).selectExpr("event_id", "original as type")


@query("b6_drop_recent_duplicates", """
o AS (SELECT source, type, ts_s, event_id, row_number() OVER (PARTITION BY source, type ORDER BY ts_s, event_id) AS r FROM mem_activity),
w AS (SELECT source, type, ts_s, event_id, r, ts_s AS kept, TRUE AS keep FROM o WHERE r = 1
  UNION ALL SELECT o.source, o.type, o.ts_s, o.event_id, o.r, CASE WHEN o.ts_s - w.kept > 14400 THEN o.ts_s ELSE w.kept END, o.ts_s - w.kept > 14400
  FROM w JOIN o ON o.source = w.source AND o.type = w.type AND o.r = w.r + 1)
SELECT source, type, ts_s, event_id FROM w WHERE keep""", recursive=True)
def _(b):
    return ingest.drop_recent_duplicates(b.activity, ["source", "type"], 14400)


@query("b7_direct_entities", """SELECT id AS source_event_id, type, trim(split_part(substr(content, 1, 120), chr(10), 1)) AS title, CASE WHEN type = 'todo' THEN 'open' END AS status
 FROM mem_entities WHERE type IN ('decision', 'discovery', 'failure', 'todo', 'fact')""")
def _(b):
    return ingest.direct_entities(b.entities.withColumnRenamed("id", "event_id")).drop("content")


# the shipped patterns, and some that the data hold
_PATTERNS = ingest.DETECT_PATTERNS + (("decision", r"\b(the that|and the)\b"), ("todo", r"\b(of the) .+ (er|in)\b"), ("todo", r"\b(tion|able) (the|and)\b"))


@query("b8_detect_statements", "p AS (SELECT * FROM (VALUES " + ", ".join("({}, '{}', '(?i){}')".format(i, t, p.replace("'", "''")) for i, (t, p) in enumerate(_PATTERNS)) + """) t(n, type, e)),
s AS (SELECT event_id, unnest(string_split(regexp_replace(content, '([.!?])\\s+|\\n+', '\\1' || chr(1), 'g'), chr(1))) AS raw, generate_subscripts(string_split(regexp_replace(content, '([.!?])\\s+|\\n+', '\\1' || chr(1), 'g'), chr(1)), 1) AS place
  FROM mem_events WHERE length(content) >= 10),
f AS (SELECT event_id, n, type, arg_min(trim(raw), place) AS sentence FROM s, p WHERE length(trim(raw)) > 5 AND regexp_matches(trim(raw), e) GROUP BY ALL)
SELECT DISTINCT event_id, type, substr(sentence, 1, 500) AS snippet FROM f""")
def _(b):
    return ingest.detect_statements(b.events, _PATTERNS)


@query("b9_sessionize", """
g AS (SELECT *, CASE WHEN ts_s - lag(ts_s) OVER w <= 14400 THEN 0 ELSE 1 END AS n FROM mem_activity WINDOW w AS (PARTITION BY source ORDER BY ts_s, event_id))
SELECT event_id, source, CAST(sum(n) OVER (PARTITION BY source ORDER BY ts_s, event_id ROWS UNBOUNDED PRECEDING) - 1 AS BIGINT) AS number FROM g""")
def _(b):
    return ingest.sessionize(b.activity, 14400).select("event_id", "source", "number")


@query("b11_session_rollup", f"""
g AS (SELECT *, CASE WHEN ts_s - lag(ts_s) OVER (PARTITION BY source ORDER BY ts_s, event_id) <= 14400 THEN 0 ELSE 1 END AS n FROM mem_activity),
k AS (SELECT *, CAST(sum(n) OVER (PARTITION BY source ORDER BY ts_s, event_id ROWS UNBOUNDED PRECEDING) - 1 AS BIGINT) AS number FROM g),
r AS (SELECT source, number, min(ts_s) AS started_s, max(ts_s) AS ended_s, count(*) AS event_count FROM k GROUP BY ALL)
SELECT source, number, source || '-' || number AS session_id, started_s, ended_s, event_count, CASE WHEN ended_s < {E0 + 29 * 86400} - 14400 THEN 'ended' ELSE 'active' END AS status,
 CASE WHEN number > 0 THEN source || '-' || (number - 1) END AS continuation_of FROM r""")
def _(b):
    return ingest.session_rollup(ingest.sessionize(b.activity, 14400), E0 + 29 * 86400, 14400)


@query("b10_continuations", """
g AS (SELECT *, CASE WHEN ts_s - lag(ts_s) OVER (PARTITION BY source ORDER BY ts_s, event_id) <= 14400 THEN 0 ELSE 1 END AS n FROM mem_activity),
k AS (SELECT source, CAST(sum(n) OVER (PARTITION BY source ORDER BY ts_s, event_id ROWS UNBOUNDED PRECEDING) - 1 AS BIGINT) AS number FROM g)
SELECT DISTINCT source || '-' || number AS session_id, source || '-' || (number - 1) AS continuation_of FROM k WHERE number > 0""")
def _(b):
    return ingest.session_rollup(ingest.sessionize(b.activity, 14400), NOW, 14400).filter("continuation_of is not null").select("session_id", "continuation_of")


@query("b12_chunk_events", """
c AS (SELECT *, (row_number() OVER (PARTITION BY source ORDER BY ts_s, event_id) - 1) // 20 AS chunk FROM mem_activity)
SELECT source AS session_id, chunk, list(event_id ORDER BY ts_s, event_id) AS event_ids, min(ts_s) AS start_s, max(ts_s) AS end_s FROM c GROUP BY source, chunk HAVING count(*) = 20""")
def _(b):
    return ingest.chunk_events(b.activity.withColumnRenamed("source", "session_id"), 20)


@query("b13_every_fifth_session", """SELECT session_id, project_id, ordinal FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY ended_s, session_id) AS ordinal FROM mem_sessions) WHERE ordinal % 5 = 0""")
def _(b):
    return ingest.every_nth_session(b.sessions, 5).select("session_id", "project_id", "ordinal")


@query("b14_batch_events", """
n AS (SELECT project_id, event_id, row_number() OVER (PARTITION BY project_id ORDER BY session_id, ts_s, event_id) - 1 AS number FROM mem_events)
SELECT project_id, number // 50 AS batch, list(event_id ORDER BY number) AS event_ids FROM n GROUP BY ALL""")
def _(b):
    return ingest.batch_events(b.events, 50)


@query("b15_context_pressure", """SELECT source AS session_id, count(*) * 500 AS tokens, round(least(1.0, CAST(count(*) * 500 AS DOUBLE) / 40000), 6) AS ratio, CAST(count(*) * 500 AS DOUBLE) / 40000 >= 0.8 AS compress FROM mem_activity GROUP BY source""")
def _(b):
    sessions = b.activity.groupBy(F.col("source").alias("session_id")).agg(F.count("*").alias("event_count"), F.lit(None).cast("long").alias("tokens"))
    return ingest.context_pressure(sessions, 40000)


@query("b16_compress_context", """
f AS (SELECT source FROM mem_activity GROUP BY source HAVING CAST(count(*) * 500 AS DOUBLE) / 40000 >= 0.8),
o AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY ts_s, event_id) AS n FROM mem_activity WHERE source IN (SELECT source FROM f))
SELECT source AS session_id, min(ts_s) AS start_s, max(ts_s) AS end_s, count(*) AS events, string_agg(type, ',' ORDER BY n) AS outline FROM o WHERE n <= 30 GROUP BY source""")
def _(b):
    e = b.activity.withColumnRenamed("source", "session_id")
    sessions = e.groupBy("session_id").agg(F.count("*").alias("event_count"), F.lit(None).cast("long").alias("tokens"))
    return ingest.compress_context(e, ingest.context_pressure(sessions, 40000).filter("compress"), 30)


def _compressed(b):
    e = b.activity.withColumnRenamed("source", "session_id")
    sessions = e.groupBy("session_id").agg(F.count("*").alias("event_count"), F.lit(None).cast("long").alias("tokens"))
    return sessions, ingest.compression_summaries(ingest.compress_context(e, ingest.context_pressure(sessions, 40000).filter("compress"), 30), NOW)


_COMPRESSED = f"""
f AS (SELECT source FROM mem_activity GROUP BY source HAVING CAST(count(*) * 500 AS DOUBLE) / 40000 >= 0.8),
o AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY ts_s, event_id) AS n FROM mem_activity WHERE source IN (SELECT source FROM f)),
z AS (SELECT source AS session_id, min(ts_s) AS range_start, max(ts_s) AS range_end, count(*) AS event_count, string_agg(type, ',' ORDER BY n) AS content FROM o WHERE n <= 30 GROUP BY source)"""


@query("b16_compression_summaries", f"""{_COMPRESSED} SELECT 'chunk-' || session_id || '-' || range_start || '-' || range_end AS id, session_id, 'chunk' AS level, content, range_start, range_end, event_count, length(content) // 4 AS token_count, {NOW} AS created_s FROM z""")
def _(b):
    return _compressed(b)[1]


@query("b16_session_counters", f"""{_COMPRESSED} SELECT source AS session_id, count(*) AS event_count, CASE WHEN source IN (SELECT session_id FROM z) THEN 1 ELSE 0 END AS compression_events, CASE WHEN source IN (SELECT session_id FROM z) THEN {NOW} END AS last_compression_s FROM mem_activity GROUP BY source""")
def _(b):
    sessions, summaries = _compressed(b)
    return ingest.count_compressions(sessions.drop("tokens"), summaries)


@query("b17_event_reads", """SELECT type, count(*) AS n, max(ts_s) AS newest_s, min(ts_s) AS oldest_s FROM mem_events GROUP BY type""")
def _(b):
    return b.events.groupBy("type").agg(F.count("*").alias("n"), F.max("ts_s").alias("newest_s"), F.min("ts_s").alias("oldest_s"))


@query("b17_session_events", """SELECT session_id, event_id, type, rank FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY ts_s DESC, event_id DESC) AS rank FROM mem_events WHERE type = 'prompt') WHERE rank <= 2""")
def _(b):
    by = Window.partitionBy("session_id").orderBy(F.col("ts_s").desc(), F.col("event_id").desc())
    return b.events.filter("type = 'prompt'").withColumn("rank", F.row_number().over(by)).filter("rank <= 2").select("session_id", "event_id", "type", "rank")


@query("b18_session_reads", """SELECT project_id, session_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY started_s DESC, session_id DESC) AS rank FROM mem_sessions) WHERE rank BETWEEN 11 AND 20""")
def _(b):
    by = Window.partitionBy("project_id").orderBy(F.col("started_s").desc(), F.col("session_id").desc())
    return b.sessions.withColumn("rank", F.row_number().over(by)).filter("rank between 11 and 20").select("project_id", "session_id", "rank")
