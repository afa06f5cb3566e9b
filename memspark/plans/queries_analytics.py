"""Queries over analytics and lifecycle operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from memspark.functions.checkpoints import cut
from memspark.operators import analytics, lifecycle
from memspark.plans.bridge import E0, NOW, Bridge, with_views

Q, S = {}, {}


def query(name: str, sql: str | None = None, recursive: bool = False):
    def add(f):
        Q[name] = lambda spark, sf_dir: f(Bridge(spark, sf_dir))
        if sql:
            S[name] = with_views(sql, recursive)
        return f

    return add


# Responses of the bridge quote short ids of documents: a marker made of the event's own numbers is put before the text.
_QUOTED = "concat('#', lpad(cast((session_id * 7 + event_id) % 997 as string), 8, '0'), ' mem_search mem_search_index ', content)"
_QUOTED_SQL = "'#' || lpad(CAST((session_id * 7 + event_id) % 997 AS VARCHAR), 8, '0') || ' mem_search mem_search_index ' || content"
CITED = f"""
ev AS (SELECT event_id, session_id, project_id, type, ts_s, {_QUOTED_SQL} AS content FROM mem_events),
ent AS (SELECT id, id % 5 AS project_id, short_id FROM mem_entities),
cited AS (SELECT session_id, event_id, ts_s, ent.id FROM (SELECT *, unnest(regexp_extract_all(content, '#([A-Z0-9]{{8}})\\b', 1)) AS short_id FROM ev WHERE type = 'response') q JOIN ent ON q.short_id = ent.short_id AND q.project_id = ent.project_id),
counts AS (SELECT id, count(*) AS citations, max(ts_s) AS last_s FROM cited GROUP BY id)"""


def quoted(b):
    return b.events.withColumn("content", F.expr(_QUOTED))


def cited(b):
    return analytics.citations(quoted(b), b.entities.withColumn("project_id", F.expr("id % 5")))


def _mentions(names):
    return " + ".join(f"(length(content) - length(replace(content, '{n}', ''))) // {len(n)}" for n in names)


_USAGE = f"""{CITED},
usage AS (SELECT session_id, CAST(sum(length(content) // 4) AS BIGINT) AS tokens, CAST(sum(CASE WHEN type = 'prompt' THEN {_mentions(analytics.READ_TOOLS)} ELSE 0 END) AS BIGINT) AS reads,
  CAST(sum(CASE WHEN type = 'prompt' THEN {_mentions(analytics.WRITE_TOOLS)} ELSE 0 END) AS BIGINT) AS writes, bool_or(type = 'prompt' AND contains(content, 'mem_search_index')) AS briefed FROM ev GROUP BY session_id),
full_usage AS (SELECT usage.*, coalesce(citations, 0) AS citations FROM usage LEFT JOIN (SELECT session_id, count(*) AS citations FROM cited GROUP BY session_id) USING (session_id))"""


def usage(b):
    return analytics.session_usage(quoted(b), cited(b), briefing="mem_search_index", call_type="prompt")


@query("i1_session_usage", f"{_USAGE} SELECT * FROM full_usage")
def _(b):
    return usage(b)


@query("i2_citations", f"{CITED} SELECT * FROM counts")
def _(b):
    return analytics.citation_counts(cited(b))


@query("i3_usage_summary", f"""{_USAGE} SELECT count(*) AS sessions, count(*) FILTER (reads > 0 OR briefed) AS using, CAST(sum(citations) AS BIGINT) AS citations, CAST(sum(tokens) AS BIGINT) AS tokens,
 round(CAST(count(*) FILTER (reads > 0 OR briefed) AS DOUBLE) / count(*), 6) AS rate FROM full_usage""")
def _(b):
    return analytics.usage_summary(usage(b))


@query("i4_backfill_citations", f"{CITED} SELECT e.id, coalesce(citations, 0) AS cited_count, last_s AS last_cited_s FROM mem_entities e LEFT JOIN counts c ON e.id = c.id")
def _(b):
    return analytics.backfill_citations(b.entities, analytics.citation_counts(cited(b))).select("id", "cited_count", "last_cited_s")


@query("i5_add_citations", f"{CITED} SELECT e.id, cited_count + coalesce(citations, 0) AS cited_count, greatest(updated_s, last_s) AS last_cited_s FROM mem_entities e LEFT JOIN counts c ON e.id = c.id")
def _(b):
    base = b.entities.withColumn("last_cited_s", F.col("updated_s"))
    return analytics.add_citations(base, analytics.citation_counts(cited(b))).select("id", "cited_count", "last_cited_s")


_WALK = """walk AS (SELECT src AS id, dst AS target, 1 AS hops FROM supersede_edges UNION ALL SELECT w.id, e.dst, hops + 1 FROM walk w JOIN supersede_edges e ON w.target = e.src WHERE hops < 10),
targets AS (SELECT id, arg_max(target, hops) AS target, max(hops) AS hops FROM walk GROUP BY id)"""


@query("i6_live_targets", f"{_WALK} SELECT * FROM targets", recursive=True)
def _(b):
    return analytics.live_targets(b.supersede_edges)


@query("i6_redirect_credit", f"{CITED}, {_WALK} SELECT coalesce(target, counts.id) AS id, CAST(sum(citations) AS BIGINT) AS citations, max(last_s) AS last_s FROM counts LEFT JOIN targets ON counts.id = targets.id GROUP BY 1", recursive=True)
def _(b):
    return analytics.redirect_credit(analytics.citation_counts(cited(b)), analytics.live_targets(b.supersede_edges))


@query("i8_saved_tokens", """SELECT source AS project_id, type AS tool, count(*) AS calls, CAST(sum(length(content)) AS BIGINT) AS tokens, CAST(grouping(type) AS INTEGER) AS is_total FROM mem_activity GROUP BY GROUPING SETS ((source), (source, type))""")
def _(b):
    calls = b.activity.selectExpr("source as project_id", "type as tool", "length(content) as tokens")
    return analytics.saved_tokens(calls).withColumn("is_total", F.col("is_total").cast("int"))


_STATS = """stats AS (SELECT model, task_type, count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'failed') AS failed, round(avg(eval_score) FILTER (status = 'completed'), 6) AS avg_eval,
 round(sum(cost), 2) AS cost, min(created_s) AS first_s, max(created_s) AS last_s FROM mem_tasks GROUP BY model, task_type)"""


def stats(b):
    return analytics.model_stats(b.tasks, ["model", "task_type"])


@query("i9_model_stats", f"{_STATS} SELECT model, task_type, completed, failed, avg_eval, first_s, last_s, round(cost, 0) AS cost FROM stats")
def _(b):
    return stats(b).withColumn("cost", F.round("cost", 0))


@query("i10_compare_models", """
r AS (SELECT DISTINCT c_mktsegment AS model FROM customer UNION SELECT 'UNKNOWN'),
t AS (SELECT model, count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'failed') AS failed, round(avg(eval_score) FILTER (status = 'completed'), 6) AS avg_eval FROM mem_tasks GROUP BY model)
SELECT model, coalesce(completed, 0) AS completed, coalesce(failed, 0) AS failed, avg_eval FROM r LEFT JOIN t USING (model)""")
def _(b):
    requested = b.table("customer").selectExpr("c_mktsegment as model").distinct().union(b.spark.sql("select 'UNKNOWN'"))
    return analytics.compare_models(analytics.model_stats(b.tasks, ["model"]), requested).select("model", "completed", "failed", "avg_eval")


@query("i11_eval_summary", """
e AS (SELECT 'task' AS kind, eval_score FROM mem_tasks UNION ALL SELECT 'entity', CASE WHEN id % 10 = 0 THEN NULL ELSE CAST(id % 10 AS DOUBLE) / 10 END FROM mem_entities)
SELECT kind, count(*) AS n, round(avg(eval_score), 4) AS avg_eval FROM e WHERE eval_score IS NOT NULL GROUP BY kind""")
def _(b):
    return analytics.eval_summary(b.tasks.selectExpr("'task' as kind", "eval_score"), b.entities.selectExpr("'entity' as kind", "if(id % 10 = 0, null, (id % 10) / 10.0D) as eval_score"))


@query("i11_record_evals", "SELECT id, CASE WHEN id % 3 = 0 AND id % 7 / 5.0 <= 1 THEN id % 7 / 5.0 ELSE eval_score END AS eval_score FROM mem_tasks")
def _(b):
    evals = b.tasks.filter("id % 3 = 0").selectExpr("id", "(id % 7) / 5.0D as score")
    return analytics.record_evals(b.tasks, evals, "id").select("id", "eval_score")


_GEO = "CASE WHEN list_contains(blocked, {0}) THEN 'blocked' WHEN list_contains(regions, '*') OR list_contains(regions, {0}) THEN 'available' ELSE 'unavailable' END"


@query("i12_filter_models", f"SELECT model_name, provider, round(price, 6) AS price, quality_tier FROM mem_models WHERE tools AND (price IS NULL OR price <= 5.0) AND {_GEO.format(chr(39) + '2' + chr(39))} = 'available'")
def _(b):
    return analytics.filter_models(b.models, max_price=5.0, tools=True, region="2").select("model_name", "provider", F.round("price", 6).alias("price"), "quality_tier")


@query("i13_recommend", f"""{_STATS},
u AS (SELECT s_name AS model_name, c_mktsegment AS task_type, CAST(s_suppkey % 10 AS DOUBLE) / 10 AS fit FROM supplier, (SELECT DISTINCT c_mktsegment FROM customer)),
a AS (SELECT task_type, round(10 * fit + CASE quality_tier WHEN 'frontier' THEN 8 WHEN 'strong' THEN 6 WHEN 'standard' THEN 4 WHEN 'budget' THEN 2 ELSE 1 END + 5 * coalesce(avg_eval, 0) - CASE WHEN price > 0 THEN 0.01 * price ELSE 0 END, 4) AS score, model_name AS model
  FROM u JOIN mem_models USING (model_name) LEFT JOIN (SELECT task_type AS priority, model AS segment, avg_eval FROM stats) s ON s.segment = model_name AND s.priority = task_type WHERE context_window >= 64000)
SELECT task_type, model, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY task_type ORDER BY score DESC, model) AS rank FROM a) WHERE rank <= 10""")
def _(b):
    kinds = b.table("customer").select(F.col("c_mktsegment").alias("task_type")).distinct()
    fits = b.table("supplier").selectExpr("s_name as model", "(s_suppkey % 10) / 10.0D as fit").withColumn("_one", F.lit(1)).join(kinds.withColumn("_one", F.lit(1)), "_one").drop("_one")
    return analytics.recommend(b.models, stats(b), fits, min_context=64000)


@query("i14_geo_availability", f"""
r AS (SELECT s_name AS model_name, CAST(s_suppkey % 5 AS VARCHAR) AS region FROM supplier UNION SELECT 'nobody', '1')
SELECT r.model_name, region, CASE WHEN regions IS NULL THEN 'unknown' ELSE {_GEO.format('region')} END AS verdict FROM r LEFT JOIN mem_models m ON r.model_name = m.model_name""")
def _(b):
    requests = b.table("supplier").selectExpr("s_name as model_name", "cast(s_suppkey % 5 as string) as region").union(b.spark.sql("select 'nobody', '1'"))
    return analytics.geo_availability(b.models, requests)


@query("i15_list_tasks", "SELECT model, id, rank FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY created_s, id) AS rank FROM mem_tasks WHERE status = 'pending') WHERE rank <= 20")
def _(b):
    return analytics.list_tasks(b.tasks, 20, "pending").select("model", "id", "rank")


@query("i16_task_tree", """tree AS (SELECT id AS root, id, 0 AS depth FROM mem_tasks WHERE parent_id = 0
 UNION ALL SELECT root, t.id, depth + 1 FROM tree JOIN mem_tasks t ON t.parent_id = tree.id)
SELECT root, count(*) AS tasks, max(depth) AS depth, CAST(sum(id) AS BIGINT) AS ids FROM tree GROUP BY root""", recursive=True)
def _(b):
    tree = analytics.task_tree(b.tasks, b.tasks.filter("parent_id = 0"))
    return tree.groupBy("root").agg(F.count("*").alias("tasks"), F.max("depth").alias("depth"), F.sum("id").alias("ids"))


@query("i17_update_tasks", """SELECT id, CASE WHEN id % 4 = 0 THEN ['completed', 'in_progress', 'cancelled'][CAST(id % 3 AS INTEGER) + 1] ELSE status END AS status,
 CASE WHEN id % 4 = 0 AND id % 3 <> 1 THEN coalesce(CASE WHEN status = 'completed' THEN created_s END, created_s + 60) ELSE CASE WHEN status = 'completed' THEN created_s END END AS completed_s FROM mem_tasks""")
def _(b):
    updates = b.tasks.filter("id % 4 = 0").selectExpr("id", "element_at(array('completed', 'in_progress', 'cancelled'), cast(id % 3 as int) + 1) as new_status", "created_s + 60 as at_s")
    tasks = b.tasks.withColumn("completed_s", F.when(F.col("status") == "completed", F.col("created_s")))
    return analytics.update_tasks(tasks, updates).select("id", "status", "completed_s")


@query("i18_files", """SELECT file_path, count(DISTINCT entity_id) AS n, max(updated_s) AS last_s FROM mem_files JOIN mem_entities ON entity_id = id WHERE NOT archived GROUP BY file_path ORDER BY n DESC, last_s DESC, file_path LIMIT 50""")
def _(b):
    return analytics.files_with_observations(b.files, b.entities, 50)


_FILE_LINE = """
a AS (SELECT DISTINCT './' || file_path AS asked FROM mem_files UNION SELECT DISTINCT 'other/' || split_part(file_path, '/', 3) FROM mem_files),
c AS (SELECT asked, regexp_replace(asked, '^[./]+', '') AS path FROM a),
m AS (SELECT asked, entity_id, 0 AS p FROM c JOIN mem_files ON path = file_path UNION ALL SELECT asked, entity_id, 1 FROM c JOIN mem_files ON list_extract(string_split(path, '/'), -1) = split_part(file_path, '/', 3)),
k AS (SELECT DISTINCT asked, entity_id FROM (SELECT *, min(p) OVER (PARTITION BY asked) AS best FROM m) WHERE p = best),
line AS (SELECT asked, entity_id, created_s, row_number() OVER (PARTITION BY asked ORDER BY created_s, entity_id) AS number FROM k JOIN mem_entities ON entity_id = id)"""


def timeline(b):
    paths = cut(b.file_paths)
    exact = paths.select(F.concat(F.lit("./"), "file_path").alias("asked"))
    named = paths.select(F.concat(F.lit("other/"), F.substring_index("file_path", "/", -1)).alias("asked"))
    return analytics.file_timeline(b.files, b.entities, exact.union(named).distinct(), paths)


@query("i19_file_timeline", f"{_FILE_LINE} SELECT asked, entity_id, number FROM line")
def _(b):
    return timeline(b).select("asked", "entity_id", "number")


@query("i20_file_context", f"{_FILE_LINE} SELECT asked, count(*) AS n, min(created_s) AS first_s, max(created_s) AS last_s, arg_max(entity_id, number) AS current, greatest(count(*) - 20, 0) AS cut FROM line GROUP BY asked")
def _(b):
    return analytics.file_context(timeline(b))


@query("i21_entities_by_file", "SELECT file_path, list_sort(list(DISTINCT entity_id)) AS entity_ids FROM mem_files JOIN mem_entities ON entity_id = id WHERE NOT archived GROUP BY file_path")
def _(b):
    return analytics.entities_by_file(b.files, b.entities)


@query("i22_timeline_around", """
n AS (SELECT project_id, id, row_number() OVER (PARTITION BY project_id ORDER BY created_s, id) AS r FROM mem_entities)
SELECT a.id AS anchor, x.id, CAST(x.r - a.r AS INTEGER) AS "offset" FROM n a JOIN n x ON a.project_id = x.project_id AND x.r BETWEEN a.r - 3 AND a.r + 3""")
def _(b):
    return analytics.timeline_around(b.entities, b.entities.selectExpr("id as anchor"))


@query("i23_activity_feed", """
i AS (SELECT 'entity' AS kind, id AS item_id, session_id, created_s AS at_s, title FROM mem_entities
 UNION ALL SELECT 'session', session_id, session_id, started_s, NULL FROM mem_sessions
 UNION ALL SELECT 'summary', m.id, m.session_id, ended_s, NULL FROM mem_summaries m JOIN mem_sessions s ON m.session_id = s.session_id WHERE level = 'session')
SELECT kind, item_id, i.session_id, at_s, title, status AS session_status FROM i LEFT JOIN mem_sessions s ON i.session_id = s.session_id ORDER BY at_s DESC, kind, item_id LIMIT 100""")
def _(b):
    return analytics.activity_feed(b.entities, b.sessions, b.summaries, 100)


@query("i24_pipeline_health", f"""
j AS (SELECT ts_s, CASE type WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'done' WHEN 'signup' THEN 'pending' ELSE 'running' END AS status FROM mem_activity),
a AS (SELECT count(*) AS jobs, count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'failed' AND ts_s >= {E0 + 29 * 86400} - 172800) AS failed_recently, max(ts_s) FILTER (status = 'done') AS done_s, max(ts_s) AS newest_s FROM j)
SELECT *, failed_recently > 20 OR (newest_s IS NOT NULL AND (done_s IS NULL OR newest_s - done_s > 259200)) AS ill FROM a""")
def _(b):
    jobs = b.activity.selectExpr("ts_s", "case type when 'error' then 'failed' when 'purchase' then 'done' when 'signup' then 'pending' else 'running' end as status")
    return analytics.pipeline_health(jobs, E0 + 29 * 86400)


@query("i25_work_investment", "SELECT project_id, CAST(sum(coalesce(token_count, length(content) // 4)) AS BIGINT) AS tokens FROM mem_events GROUP BY project_id")
def _(b):
    return b.events.groupBy("project_id").agg(F.sum(analytics.work_tokens(F.col("token_count"), F.col("content"))).alias("tokens"))


@query("i26_rewind_diff", """
p AS (SELECT n_nationkey AS point, 1704067200 + n_nationkey * 86400 AS at_s FROM nation)
SELECT point, at_s, (SELECT count(*) FROM mem_events WHERE ts_s > at_s) AS events, (SELECT count(*) FROM mem_entities WHERE created_s > at_s) AS entities,
 (SELECT count(*) FROM mem_tasks WHERE created_s > at_s AND status = 'completed') AS tasks FROM p""")
def _(b):
    points = b.table("nation").selectExpr("n_nationkey as point", f"{E0} + n_nationkey * 86400 as at_s")
    return analytics.rewind_diff(b.events, b.entities, b.tasks, points)


@query("i26_rewind_restore", f"SELECT id, CASE WHEN created_s > {E0 - 80000000} AND status IN ('pending', 'in_progress') THEN 'cancelled' ELSE status END AS status FROM mem_tasks")
def _(b):
    return analytics.rewind_restore(b.entities, b.tasks, E0 - 80000000)[1].select("id", "status")


@query("i27_audit", """
SELECT 'event_without_session' AS finding, count(*) AS n FROM mem_events WHERE session_id NOT IN (SELECT session_id FROM mem_sessions)
UNION ALL SELECT 'event_in_other_project', count(*) FROM mem_events e JOIN mem_sessions s USING (session_id) WHERE e.project_id <> s.project_id
UNION ALL SELECT 'entity_without_session', count(*) FROM mem_entities WHERE session_id NOT IN (SELECT session_id FROM mem_sessions)
UNION ALL SELECT 'empty_ended_session', count(*) FROM mem_sessions WHERE session_id NOT IN (SELECT session_id FROM mem_events)
UNION ALL SELECT 'file_without_entity', count(*) FROM mem_files WHERE entity_id NOT IN (SELECT id FROM mem_entities)""")
def _(b):
    return analytics.audit(b.events, b.sessions, b.entities, b.files)


@query("i28_store_stats", """
SELECT 'events' AS name, count(*) AS n FROM mem_events UNION ALL SELECT 'entities', count(*) FROM mem_entities
UNION ALL SELECT 'open_items', count(*) FROM mem_entities WHERE status IS NOT NULL AND status NOT IN ('done', 'cancelled', 'resolved') UNION ALL SELECT 'files', count(DISTINCT file_path) FROM mem_files""")
def _(b):
    return analytics.store_stats(b.events, b.entities, b.files)


@query("i29_ab_delta", """
r AS (SELECT model, cost AS b, cost * (1 + (id % 21 - 10) / 100.0) AS a FROM mem_tasks),
d AS (SELECT model, CASE WHEN b = 0 THEN 0.0 ELSE (b - a) / b * 100 END AS delta FROM r)
SELECT model, round(avg(delta), 4) AS mean_delta, round(median(delta), 4) AS median_delta, count(*) AS runs FROM d GROUP BY model""")
def _(b):
    runs = b.tasks.selectExpr("model", "cost as b", "cost * (1 + (id % 21 - 10) / 100.0D) as a")
    return analytics.ab_delta(runs, "model").select("model", F.round("mean_delta", 4).alias("mean_delta"), F.round("median_delta", 4).alias("median_delta"), "runs")


@query("i31_session_detail", """
s AS (SELECT id, (id % 100) * 100 AS source_event_id FROM mem_entities),
o AS (SELECT session_id, count(*) AS events FROM mem_events GROUP BY session_id),
j AS (SELECT session_id, count(*) AS n, list_sort(list(id)) AS ids FROM s JOIN mem_events ON event_id = source_event_id GROUP BY session_id)
SELECT session_id, events, coalesce(n, 0) AS entities, coalesce(ids, []) AS entity_ids FROM o LEFT JOIN j USING (session_id)""")
def _(b):
    return analytics.session_detail(b.events, b.entities.selectExpr("id", "(id % 100) * 100 as source_event_id"))


_OPEN = "(status IS NOT NULL AND status NOT IN ('done', 'cancelled', 'resolved'))"


@query("g1_open_items", f"SELECT project_id, type, count(*) AS n FROM mem_entities WHERE {_OPEN} GROUP BY ALL")
def _(b):
    return b.entities.filter(lifecycle.is_open()).groupBy("project_id", "type").agg(F.count("*").alias("n"))


@query("g2_resolve", f"""
c AS (SELECT *, status IS NOT NULL AND NOT {_OPEN} AS already FROM mem_entities WHERE id % 5 = 1)
SELECT id, CASE WHEN already THEN status WHEN type = 'todo' THEN 'done' ELSE 'resolved' END AS status, CASE WHEN NOT already THEN updated_s + 5 END AS resolved_s, CASE WHEN already THEN stale ELSE FALSE END AS stale, already AS unchanged FROM c""")
def _(b):
    commands = b.entities.filter("id % 5 = 1").selectExpr("id", "'closed' as note", "updated_s + 5 as at_s")
    return lifecycle.resolve(b.entities, commands).select("id", "status", "resolved_s", "stale", "unchanged")


@query("g3_reopen", f"""SELECT id, CASE WHEN o = 'reopened' THEN CASE WHEN type = 'todo' THEN 'open' ELSE 'unresolved' END ELSE status END AS status, o AS outcome FROM
 (SELECT *, CASE WHEN type NOT IN ('todo', 'failure') THEN 'unsupported' WHEN status IS NULL OR {_OPEN} THEN 'unchanged' ELSE 'reopened' END AS o FROM mem_entities WHERE id % 2 = 1)""")
def _(b):
    return lifecycle.reopen(b.entities, b.entities.filter("id % 2 = 1"))


@query("g4_commands", """SELECT id, CASE WHEN id % 6 = 0 THEN TRUE WHEN id % 6 = 1 THEN FALSE ELSE pinned END AS pinned, archived OR id % 6 = 2 AS archived, CASE WHEN id % 6 = 3 THEN updated_s + 1000 ELSE updated_s END AS updated_s FROM mem_entities""")
def _(b):
    commands = b.entities.filter("id % 6 < 4").selectExpr("id", "element_at(array('pin', 'unpin', 'archive', 'touch'), cast(id % 6 as int) + 1) as command", "updated_s + 1000 as at_s")
    return lifecycle.apply_commands(b.entities, commands).select("id", "pinned", "archived", "updated_s")


@query("g4_live", "SELECT r.id, coalesce(NOT archived AND NOT stale, FALSE) AS live FROM (SELECT doc_id + 2 AS id FROM labels) r LEFT JOIN mem_entities e ON r.id = e.id")
def _(b):
    return lifecycle.live(b.entities, b.table("labels").selectExpr("doc_id + 2 as id"))


_STOP = ", ".join(f"'{w}'" for w in lifecycle.STOPWORDS)
_CANDIDATES = f"""
dw AS (SELECT project_id, id AS driver, list_filter(regexp_split_to_array(trim(title), '\\s+'), lambda w: length(w) > 3 AND lower(w) NOT IN ({_STOP})) AS w FROM mem_entities WHERE type IN ('bugfix', 'feature', 'change') AND NOT stale),
tp AS (SELECT * FROM (SELECT project_id, id AS target, lower(title) AS title, row_number() OVER (PARTITION BY project_id ORDER BY created_s DESC, id DESC) AS n FROM mem_entities WHERE type IN ('todo', 'failure') AND status IN ('open', 'unresolved')) WHERE n <= 200),
pr AS (SELECT project_id, driver, target, n, w, len(list_filter(w, lambda x: contains(title, lower(x)))) AS hits FROM dw JOIN tp USING (project_id) WHERE len(w) >= 2),
cand AS (SELECT project_id, driver, target, hits, rank FROM (SELECT *, row_number() OVER (PARTITION BY driver ORDER BY hits DESC, n) AS rank FROM pr WHERE hits >= greatest(2, len(w) // 2)) WHERE rank <= 3)"""


@query("g5_resolution_candidates", f"{_CANDIDATES} SELECT * FROM cand")
def _(b):
    return lifecycle.resolution_candidates(b.entities)


@query("g6_claim", f"{_CANDIDATES} SELECT project_id, driver, target, hits, rank FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY driver, rank) AS n FROM cand) WHERE n = 1")
def _(b):
    return lifecycle.claim(lifecycle.resolution_candidates(b.entities))


@query("g7_discussion_guard", f"""{_CANDIDATES}, k AS (SELECT *, CASE WHEN target % 2 = 0 THEN lpad(CAST(target AS VARCHAR), 8, '0') ELSE 'none' END AS text FROM cand)
SELECT driver, target FROM k WHERE NOT contains(text, lpad(CAST(target AS VARCHAR), 8, '0'))""")
def _(b):
    found = lifecycle.resolution_candidates(b.entities).withColumn("target_key", F.expr("lpad(cast(target as string), 8, '0')"))
    sources = found.filter("target % 2 = 0").groupBy("driver").agg(F.array_join(F.collect_list("target_key"), " ").alias("text"))
    return lifecycle.discussion_guard(found, sources).select("driver", "target")


@query("g9_apply_judgements", f"""{_CANDIDATES}, v AS (SELECT *, CASE WHEN target % 13 = 0 THEN NULL WHEN target % 2 = 0 THEN 'CONFIRMED' ELSE 'REJECTED' END AS verdict, (row_number() OVER (PARTITION BY project_id ORDER BY driver, target) - 1) // 10 AS chunk FROM cand)
SELECT project_id, driver, target, chunk, CASE WHEN bool_and(verdict IS NOT NULL) OVER (PARTITION BY project_id, chunk) THEN verdict ELSE 'UNCERTAIN' END AS outcome FROM v""")
def _(b):
    found = lifecycle.resolution_candidates(b.entities)
    verdicts = found.filter("target % 13 <> 0").selectExpr("driver", "target", "if(target % 2 = 0, 'CONFIRMED', 'REJECTED') as verdict")
    return lifecycle.apply_judgements(found, verdicts)


@query("g8_widen_recall")
def _(b):
    v = b.embeddings.selectExpr("entity_id % 4 as project_id", "entity_id", "vector")
    drivers = v.filter("entity_id % 3 = 0").selectExpr("project_id", "entity_id as driver", "vector as driver_vector")
    targets = v.filter("entity_id % 3 = 1").selectExpr("project_id", "entity_id as target", "vector as target_vector")
    return lifecycle.widen_recall(drivers, targets, targets.filter("target % 7 = 0"), 0.2)


@query("g10_source_text", """
x AS (SELECT id, unnest([(id % 90) * 100, (id % 90) * 100 + 1]) AS event_id, unnest([0, 1]) AS n FROM mem_entities)
SELECT id, string_agg(content, chr(10) ORDER BY n) AS text FROM x JOIN mem_events USING (event_id) GROUP BY id""")
def _(b):
    e = b.entities.selectExpr("id", "array((id % 90) * 100, (id % 90) * 100 + 1) as source_event_ids", "cast(null as bigint) as source_event_id")
    return lifecycle.source_text(e, b.events)


@query("g11_fully_covered", f"""
x AS (SELECT id, unnest([(id % 90) * 100, (id % 90) * 100 + 1]) AS event_id FROM mem_entities WHERE NOT archived AND NOT pinned AND (status IS NULL OR {_OPEN}))
SELECT id FROM x LEFT JOIN (SELECT event_id AS e FROM mem_events WHERE session_id % 3 <> 0) c ON x.event_id = c.e GROUP BY id HAVING bool_and(e IS NOT NULL)""")
def _(b):
    e = b.entities.withColumn("source_event_ids", F.expr("array((id % 90) * 100, (id % 90) * 100 + 1)"))
    return lifecycle.fully_covered(e, b.events.filter("session_id % 3 <> 0"))


@query("g13_repair_archived", f"SELECT id, status FROM mem_entities WHERE archived AND {_OPEN} AND NOT stale AND id % 7 = 0")
def _(b):
    e = b.entities.withColumn("superseded_by", F.expr("if(id % 7 <> 0, id + 1, null)"))
    return lifecycle.repair_archived(e).select("id", "status")


@query("g14_describe_pairs", f"""{_CANDIDATES} SELECT driver, target, d.type AS driver_type, substr(d.title, 1, 200) AS driver_title, t.type AS target_type, substr(t.title, 1, 200) AS target_title
 FROM cand JOIN mem_entities d ON d.id = driver JOIN mem_entities t ON t.id = target""")
def _(b):
    return lifecycle.describe_pairs(lifecycle.resolution_candidates(b.entities), b.entities).select("driver", "target", "driver_type", "driver_title", "target_type", "target_title")
