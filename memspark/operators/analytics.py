"""Analytics: usage and citations, model and task statistics, files, timelines, health, rewind and audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memspark.functions.checkpoints import cut
from memspark.functions.numbering import numbered
from memspark.operators.lifecycle import is_open

# Tools that read from memory and tools that write to it.
READ_TOOLS = ("mem_get_briefing", "mem_search", "mem_search_by_file", "mem_search_index", "mem_get_entities", "mem_get_tasks", "mem_check_context", "mem_timeline", "mem_file_context")
WRITE_TOOLS = ("mem_ingest", "mem_pin", "mem_mark_current", "mem_mark_stale", "mem_compress_context", "mem_session_start", "mem_session_end", "mem_vault_review")
TIER_SCORES = (("frontier", 8), ("strong", 6), ("standard", 4), ("budget", 2), ("legacy", 1))


def search_tokens(text: Column) -> Column:
    """Token estimate of shown text: a quarter of its characters, one at least."""
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4))


def usage_tokens(count: Column, text: Column) -> Column:
    """Known token count, or a quarter of the characters where it is missing or 0."""
    return F.when(F.coalesce(count, F.lit(0)) > 0, count).otherwise(F.coalesce(F.floor(F.length(text) / 4), F.lit(0)))


def work_tokens(count: Column, text: Column) -> Column:
    """Known token count, or a quarter of the characters where it is null."""
    return F.coalesce(count, F.floor(F.length(text) / 4))


def mentions(text: Column, names: tuple[str, ...]) -> Column:
    """How often any of the names occurs as a substring, longer names counting for their parts too."""
    return sum((F.floor((F.length(text) - F.length(F.replace(text, F.lit(n), F.lit("")))) / len(n)) for n in names), F.lit(0).cast("long"))


def session_usage(events: DataFrame, cited: DataFrame, reads: tuple = READ_TOOLS, writes: tuple = WRITE_TOOLS, briefing: str = "mem_get_briefing", call_type: str = "tool_call") -> DataFrame:
    """Per session: tokens, reads and writes of memory in tool calls, whether a briefing was read, and citations."""
    text = F.coalesce("content", F.lit(""))
    call = F.col("type") == call_type
    used = events.groupBy("session_id").agg(
        F.sum(usage_tokens(F.col("token_count"), text)).alias("tokens"), F.sum(F.when(call, mentions(text, reads)).otherwise(0)).alias("reads"),
        F.sum(F.when(call, mentions(text, writes)).otherwise(0)).alias("writes"), F.max(call & F.contains(text, F.lit(briefing))).alias("briefed"),
    )
    tally = cited.groupBy("session_id").agg(F.count("*").alias("citations"))
    return used.join(tally, "session_id", "left").na.fill({"citations": 0})


def citations(events: DataFrame, entities: DataFrame, pattern: str = r"#([A-Z0-9]{8})\b", types: tuple[str, ...] = ("response",)) -> DataFrame:
    """(session_id, event_id, ts_s, id) of every citation of a real entity's short id in a response of its project;
    a short id that several entities of the project share is credited to none."""
    quoted = events.filter(F.col("type").isin(*types)).select("project_id", "session_id", "event_id", "ts_s", F.explode(F.regexp_extract_all("content", F.lit(pattern), F.lit(1))).alias("short_id"))
    known = entities.groupBy("project_id", "short_id").agg(F.min("id").alias("id"), F.count("*").alias("n")).filter("n = 1").drop("n")
    return quoted.join(known, ["project_id", "short_id"]).select("session_id", "event_id", "ts_s", "id")


def citation_counts(cited: DataFrame) -> DataFrame:
    return cited.groupBy("id").agg(F.count("*").alias("citations"), F.max("ts_s").alias("last_s"))


def usage_summary(usage: DataFrame) -> DataFrame:
    n = F.count("*")
    use = F.count_if((F.col("reads") > 0) | F.col("briefed"))
    return usage.agg(n.alias("sessions"), use.alias("using"), F.sum("citations").alias("citations"), F.sum("tokens").alias("tokens"), F.round(use / n, 6).alias("rate"))


def backfill_citations(entities: DataFrame, counts: DataFrame) -> DataFrame:
    """Entities with absolute citation counts; those never cited get 0."""
    return entities.drop("cited_count").join(counts, "id", "left").withColumn("cited_count", F.coalesce("citations", F.lit(0))).withColumnRenamed("last_s", "last_cited_s").drop("citations")


def add_citations(entities: DataFrame, counts: DataFrame) -> DataFrame:
    """Entities with counts added; the last citation only moves forward."""
    out = entities.join(counts, "id", "left")
    return out.withColumn("cited_count", F.col("cited_count") + F.coalesce("citations", F.lit(0))).withColumn("last_cited_s", F.greatest("last_cited_s", "last_s")).drop("citations", "last_s")


def live_targets(edges: DataFrame, max_hops: int = 10) -> DataFrame:
    """(id, target, hops): where credit for each superseded entity goes, along ``edges`` (src, dst) for at most ten hops.

    A row that has been passed already ends the walk, so cycles end; each hop is one join with the edges.
    """
    walk = edges.select(F.col("src").alias("id"), F.col("dst").alias("target"), F.array("src", "dst").alias("path"))
    step = edges.select(F.col("src").alias("_at"), F.col("dst").alias("_next"))
    for _ in range(max_hops - 1):
        more = walk.join(step, walk.target == step["_at"], "left")
        go = F.col("_next").isNotNull() & ~F.coalesce(F.array_contains("path", F.col("_next")), F.lit(False)) & (F.element_at("path", -1) == F.col("target"))
        walk = more.select("id", F.when(go, F.col("_next")).otherwise(F.col("target")).alias("target"), F.when(go, F.concat("path", F.array("_next"))).otherwise(F.col("path")).alias("path"))
    return walk.select("id", "target", (F.size("path") - 1).alias("hops"))


def redirect_credit(counts: DataFrame, targets: DataFrame) -> DataFrame:
    """Citation counts (id, citations, last_s) moved to the live rows."""
    out = counts.join(targets.select("id", "target"), "id", "left").withColumn("id", F.coalesce("target", "id"))
    return out.groupBy("id").agg(F.sum("citations").alias("citations"), F.max("last_s").alias("last_s"))


def saved_tokens(calls: DataFrame) -> DataFrame:
    """Totals by project, and by project and tool (tool null: the total)."""
    return calls.groupingSets([["project_id"], ["project_id", "tool"]], "project_id", "tool").agg(F.count("*").alias("calls"), F.sum("tokens").alias("tokens"), F.grouping("tool").alias("is_total"))


def model_stats(tasks: DataFrame, by: list[str]) -> DataFrame:
    done = F.col("status") == "completed"
    return tasks.groupBy(*by).agg(
        F.count_if(done).alias("completed"), F.count_if(F.col("status") == "failed").alias("failed"), F.round(F.avg(F.when(done, F.col("eval_score"))), 6).alias("avg_eval"),
        F.round(F.sum("cost"), 2).alias("cost"), F.min("created_s").alias("first_s"), F.max("created_s").alias("last_s"),
    )


def compare_models(stats: DataFrame, requested: DataFrame) -> DataFrame:
    """A row for every requested model, zeros for those without tasks."""
    return requested.join(stats, "model", "left").na.fill(0, ["completed", "failed", "cost"])


def eval_summary(*scored: DataFrame) -> DataFrame:
    """Number and mean score (kind, eval_score) over several tables."""
    every = scored[0]
    for s in scored[1:]:
        every = every.unionByName(s)
    return every.filter("eval_score is not null").groupBy("kind").agg(F.count("*").alias("n"), F.round(F.avg("eval_score"), 4).alias("avg_eval"))


def record_evals(rows: DataFrame, evals: DataFrame, key: str) -> DataFrame:
    """Rows with the scores of ``evals``; scores outside 0 to 1 are not taken."""
    fine = evals.filter("score between 0 and 1").select(key, "score")
    return rows.join(fine, key, "left").withColumn("eval_score", F.coalesce("score", "eval_score")).drop("score")


def geo_verdict(region: Column, regions: Column, blocked: Column) -> Column:
    return F.when(F.array_contains(blocked, region), "blocked").when(F.array_contains(regions, F.lit("*")) | F.array_contains(regions, region), "available").otherwise("unavailable")


def filter_models(models: DataFrame, provider: str | None = None, tier: str | None = None, max_price: float | None = None, tools: bool | None = None, region: str | None = None) -> DataFrame:
    """Registered models that fit; an unknown price fits every limit."""
    out = models.filter(F.col("provider") == provider) if provider else models
    out = out.filter(F.col("quality_tier") == tier) if tier else out
    out = out.filter(F.col("price").isNull() | (F.col("price") <= max_price)) if max_price is not None else out
    out = out.filter("tools") if tools else out
    return out.filter(geo_verdict(F.lit(region), F.col("regions"), F.col("blocked")) == "available") if region else out


def recommend(models: DataFrame, stats: DataFrame, use_cases: DataFrame, min_context: int | None = None, k: int = 10) -> DataFrame:
    """For each task type of ``use_cases`` (task_type, model, fit) the k best models by fit, tier, results and price."""
    tier = F.coalesce(*[F.when(F.col("quality_tier") == n, F.lit(s)) for n, s in TIER_SCORES], F.lit(3))
    seen = models.filter(F.col("context_window").isNull() | (F.col("context_window") >= min_context)) if min_context else models
    out = seen.withColumnRenamed("model_name", "model").join(use_cases, "model").join(stats.select("model", "task_type", "avg_eval"), ["model", "task_type"], "left")
    score = 10 * F.coalesce("fit", F.lit(0.0)) + tier + 5 * F.coalesce("avg_eval", F.lit(0.0)) - F.when(F.col("price") > 0, 0.01 * F.col("price")).otherwise(0.0)
    ranked = out.withColumn("score", F.round(score, 4))
    by = Window.partitionBy("task_type").orderBy(F.col("score").desc(), "model")
    return ranked.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k).select("task_type", "model", "score", "rank")


def geo_availability(models: DataFrame, requests: DataFrame) -> DataFrame:
    """Verdict of every requested (model_name, region)."""
    out = requests.join(models.select("model_name", "regions", "blocked"), "model_name", "left")
    verdict = F.when(F.col("regions").isNull(), "unknown").otherwise(geo_verdict(F.col("region"), F.col("regions"), F.col("blocked")))
    return out.select("model_name", "region", verdict.alias("verdict"))


def list_tasks(tasks: DataFrame, k: int, status: str | None = None) -> DataFrame:
    """The first k tasks of each model, by creation."""
    out = tasks.filter(F.col("status") == status) if status else tasks
    by = Window.partitionBy("model").orderBy("created_s", "id")
    return out.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k)


def task_tree(tasks: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, id, depth) of all tasks below the roots; each level is one join, repeated until no task is added. A cycle raises.

    As a task has one parent, a cycle below a root leads back to the root. Where rows give a task several parents, a tree
    deeper than there are links tells a cycle.
    """
    level = roots.select(F.col("id").alias("root"), "id", F.lit(0).alias("depth"))
    out = level
    edges = tasks.select(F.col("id").alias("child"), F.col("parent_id").alias("_parent")).filter("_parent is not null")
    depth = 0
    while True:
        depth += 1
        below = level.join(edges, level.id == edges["_parent"])
        level = cut(below.select("root", F.col("child").alias("id"), F.lit(depth).alias("depth")))
        found = level.agg(F.count("*").alias("n"), F.coalesce(F.bool_or(F.col("id") == F.col("root")), F.lit(False)).alias("back")).head()
        if found.n == 0:
            return out
        if found.back or (depth & (depth - 1) == 0 and depth >= 64 and depth > edges.count()):
            raise ValueError("tasks form a cycle")
        out = out.unionByName(level)


def update_tasks(tasks: DataFrame, updates: DataFrame) -> DataFrame:
    """Tasks with ``updates`` (id, new_status, at_s); a terminal status sets completed_s where it was not set."""
    out = tasks.join(updates, "id", "left").withColumn("status", F.coalesce("new_status", "status"))
    ended = F.col("new_status").isin("completed", "failed", "cancelled")
    return out.withColumn("completed_s", F.when(ended, F.coalesce("completed_s", "at_s")).otherwise(F.col("completed_s"))).drop("new_status", "at_s")


def files_with_observations(files: DataFrame, entities: DataFrame, k: int) -> DataFrame:
    """The k files with the most live entities: count and last update."""
    live = entities.filter("not archived").select(F.col("id").alias("entity_id"), "updated_s")
    out = files.join(live, "entity_id").groupBy("file_path").agg(F.count_distinct("entity_id").alias("n"), F.max("updated_s").alias("last_s"))
    return out.orderBy(F.col("n").desc(), F.col("last_s").desc(), "file_path").limit(k)


#: Pairs of an asked path and a file path up to which they are sent to every task.
BROADCAST_PATHS = 1 << 17


def file_timeline(files: DataFrame, entities: DataFrame, asked: DataFrame, paths: DataFrame | None = None) -> DataFrame:
    """Entities of each asked path, the oldest first: those of the exact path, else those of its file name.

    Which files a path stands for is settled on the distinct paths (``paths``, where they are known, else those of ``files``),
    so that a path with an exact file never meets all files of its name.
    """
    clean = asked.select("asked", F.regexp_replace("asked", r"^[./]+", "").alias("path"))
    known = cut((files if paths is None else paths).select("file_path").distinct())
    exact = clean.join(known, clean.path == known.file_path).select("asked", "file_path")
    others = clean.join(known, clean.path == known.file_path, "left_anti")
    named = others.join(known, F.substring_index("path", "/", -1) == F.substring_index("file_path", "/", -1)).select("asked", "file_path")
    meant = cut(exact.union(named.join(exact.select("asked"), "asked", "left_anti")).distinct())
    meant = F.broadcast(meant) if meant.limit(BROADCAST_PATHS + 1).count() <= BROADCAST_PATHS else meant
    own = files.select("entity_id", "file_path").join(entities.select(F.col("id").alias("entity_id")), "entity_id", "left_semi")
    both = own.join(meant, "file_path").select("asked", "entity_id").distinct()
    shown = both.join(entities.select(F.col("id").alias("entity_id"), "type", "title", "created_s", "status"), "entity_id")
    return shown.withColumn("number", F.row_number().over(Window.partitionBy("asked").orderBy("created_s", "entity_id")))


def file_context(timeline: DataFrame, most: int = 20) -> DataFrame:
    """Per asked path: count, first and last time, how many are cut from the timeline, and its latest entity."""
    latest = F.max_by("entity_id", F.struct("created_s", "entity_id"))  # the last number's; without it nothing need be sorted
    out = timeline.groupBy("asked").agg(F.count("*").alias("n"), F.min("created_s").alias("first_s"), F.max("created_s").alias("last_s"), latest.alias("current"))
    return out.withColumn("cut", F.greatest(F.col("n") - most, F.lit(0)))


def entities_by_file(files: DataFrame, entities: DataFrame) -> DataFrame:
    """Per file its live entities, per entity order."""
    live = entities.filter("not archived").select(F.col("id").alias("entity_id"))
    return files.join(live, "entity_id").groupBy("file_path").agg(F.array_sort(F.collect_set("entity_id")).alias("entity_ids"))


def timeline_around(entities: DataFrame, anchors: DataFrame, before: int = 3, after: int = 3) -> DataFrame:
    """(anchor, id, offset): the entities of the anchor's project around it by creation. Numbers within the project are
    given out over the cluster; the neighbours are an equi-join on project and number."""
    rows = cut(numbered(entities.select("project_id", "id", "created_s"), ["project_id"], ["created_s", "id"]))
    at = rows.join(anchors.select(F.col("anchor").alias("id")), "id").select("project_id", F.col("id").alias("anchor"), F.explode(F.sequence(F.lit(-before), F.lit(after))).alias("offset"), "number")
    near = at.select(F.col("project_id").alias("_project"), "anchor", "offset", (F.col("number") + F.col("offset")).alias("_number"))
    return near.join(rows, near["_project"].eqNullSafe(rows["project_id"]) & (near["_number"] == rows["number"])).select("anchor", "id", "offset")


def newest(entities: DataFrame, k: int = 7) -> DataFrame:
    by = Window.partitionBy("project_id").orderBy(F.col("created_s").desc(), F.col("id").desc())
    return entities.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k)


def activity_feed(entities: DataFrame, sessions: DataFrame, summaries: DataFrame, k: int) -> DataFrame:
    """The newest k of entities, sessions and session summaries together, with the session's model where known."""
    items = entities.select(F.lit("entity").alias("kind"), F.col("id").alias("item_id"), "session_id", F.col("created_s").alias("at_s"), "title")
    items = items.unionByName(sessions.select(F.lit("session").alias("kind"), F.col("session_id").alias("item_id"), "session_id", F.col("started_s").alias("at_s")), allowMissingColumns=True)
    ends = summaries.filter("level = 'session'").join(sessions.select("session_id", F.col("ended_s").alias("at_s")), "session_id")
    items = items.unionByName(ends.select(F.lit("summary").alias("kind"), F.col("id").alias("item_id"), "session_id", "at_s"), allowMissingColumns=True)
    known = sessions.select("session_id", F.col("status").alias("session_status"))
    return items.join(known, "session_id", "left").orderBy(F.col("at_s").desc(), "kind", "item_id").limit(k)


def pipeline_health(jobs: DataFrame, now: int, failures: int = 20, hours: int = 48, days: int = 3) -> DataFrame:
    """One row: job counts by status, failures of the last hours, newest done and newest event, and whether it is ill."""
    failed = F.count_if((F.col("status") == "failed") & (F.col("ts_s") >= now - hours * 3600))
    out = jobs.agg(F.count("*").alias("jobs"), F.count_if(F.col("status") == "pending").alias("pending"), failed.alias("failed_recently"), F.max(F.when(F.col("status") == "done", F.col("ts_s"))).alias("done_s"), F.max("ts_s").alias("newest_s"))
    behind = F.col("done_s").isNull() | (F.col("newest_s") - F.col("done_s") > days * 86400)
    return out.withColumn("ill", (F.col("failed_recently") > failures) | (F.col("newest_s").isNotNull() & behind))


def count_after(rows: DataFrame, at: str, points: DataFrame, name: str) -> DataFrame:
    """(point, name): how many rows have a time after the point's (point, at_s).

    Whole hours after it come from running totals over hours, the rest from an equi-join on the point's own hour.
    """
    hour = lambda c: F.floor(F.col(c) / 3600)
    timed = rows.select(F.col(at).alias("_at"), hour(at).alias("_hour"))
    asked = points.select("point", "at_s", hour("at_s").alias("_hour"))
    totals = timed.groupBy("_hour").agg(F.count("*").alias("_n")).unionByName(asked.select("_hour", F.lit(0).cast("long").alias("_n"))).groupBy("_hour").agg(F.sum("_n").alias("_n"))
    later = F.sum("_n").over(Window.orderBy(F.col("_hour").desc()).rowsBetween(Window.unboundedPreceding, -1))
    same = timed.join(asked, "_hour").filter("_at > at_s").groupBy("point").agg(F.count("*").alias("_same"))
    out = asked.join(totals.select("_hour", F.coalesce(later, F.lit(0)).alias("_later")), "_hour").join(same, "point", "left")
    return out.select("point", (F.col("_later") + F.coalesce("_same", F.lit(0))).alias(name))


def rewind_diff(events: DataFrame, entities: DataFrame, tasks: DataFrame, points: DataFrame) -> DataFrame:
    """Per rewind point (point, at_s): events and entities that came after it, and tasks created after it and completed."""
    out = points
    for rows, at, name in ((events, "ts_s", "events"), (entities, "created_s", "entities"), (tasks.filter("status = 'completed'"), "created_s", "tasks")):
        out = out.join(count_after(rows, at, points, name), "point")
    return out


def rewind_restore(entities: DataFrame, tasks: DataFrame, at: int) -> tuple[DataFrame, DataFrame]:
    """Entities with later ones archived, and tasks with later open ones cancelled."""
    late = F.col("created_s") > at
    return entities.withColumn("archived", F.col("archived") | late), tasks.withColumn("status", F.when(late & F.col("status").isin("pending", "in_progress"), "cancelled").otherwise(F.col("status")))


def audit(events: DataFrame, sessions: DataFrame, entities: DataFrame, files: DataFrame) -> DataFrame:
    """(finding, n): references that lead nowhere or into another project, and empty sessions."""
    owner = sessions.select("session_id", F.col("project_id").alias("owner"))
    checks = {
        "event_without_session": events.join(owner, "session_id", "left_anti"),
        "event_in_other_project": events.join(owner, "session_id").filter("project_id <> owner"),
        "entity_without_session": entities.join(owner, "session_id", "left_anti"),
        "empty_ended_session": sessions.filter("status = 'ended'").join(events.select("session_id"), "session_id", "left_anti"),
        "file_without_entity": files.join(entities.select(F.col("id").alias("entity_id")), "entity_id", "left_anti"),
    }
    out = None
    for name, found in checks.items():
        row = found.agg(F.count("*").alias("n")).select(F.lit(name).alias("finding"), "n")
        out = row if out is None else out.unionByName(row)
    return out


def store_stats(events: DataFrame, entities: DataFrame, files: DataFrame) -> DataFrame:
    rows = [("events", events), ("entities", entities), ("open_items", entities.filter(is_open())), ("files", files.select("file_path").distinct())]
    out = None
    for name, df in rows:
        row = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        out = row if out is None else out.unionByName(row)
    return out


def ab_delta(runs: DataFrame, by: str) -> DataFrame:
    """Per group of runs (a, b): change of b over a in percent (0 where a run of a is 0): mean and median."""
    delta = F.when(F.col("b") == 0, 0.0).otherwise((F.col("b") - F.col("a")) / F.col("b") * 100)
    return runs.withColumn("delta", delta).groupBy(by).agg(F.round(F.avg("delta"), 6).alias("mean_delta"), F.round(F.median("delta"), 6).alias("median_delta"), F.count("*").alias("runs"))


def session_detail(events: DataFrame, entities: DataFrame) -> DataFrame:
    """Per session its events and the entities whose source event is in it."""
    own = events.groupBy("session_id").agg(F.count("*").alias("events"))
    sourced = entities.join(events.select(F.col("event_id").alias("source_event_id"), F.col("session_id").alias("_session")), "source_event_id").groupBy(F.col("_session").alias("session_id")).agg(F.count("*").alias("entities"), F.array_sort(F.collect_list("id")).alias("entity_ids"))
    return own.join(sourced, "session_id", "left").select("session_id", "events", F.coalesce("entities", F.lit(0)).alias("entities"), F.coalesce("entity_ids", F.array().cast("array<bigint>")).alias("entity_ids"))
