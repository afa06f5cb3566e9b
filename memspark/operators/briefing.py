"""Briefings for all projects at once: importance, selection with floors, sections and text within a budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memspark.functions.checkpoints import cut
from memspark.functions.numbering import numbered
from memspark.operators.infer import ordered_text
from memspark.operators.lifecycle import is_open

# Weights of an entity's importance.
TYPE_WEIGHTS = (("decision", 3.0), ("discovery", 3.0), ("failure", 3.0), ("fact", 3.0), ("bugfix", 2.0), ("feature", 2.0), ("research", 2.0), ("todo", 1.0), ("change", 0.0))
PINNED, RECENCY, RECENCY_DAYS, CITED, CITED_DAYS = 8.0, 4.0, 14.0, 4.0, 30.0
MOST_ENTITIES, OPEN_FLOOR = 100, 20
SECTIONS = (("Investigated", ("research", "discovery", "failure")), ("Learned", ("fact", "decision")), ("Completed", ("bugfix", "feature", "change")), ("Next", ("todo",)))


def _age_days(ts_s: Column, now: int) -> Column:
    return F.greatest((F.lit(now) - ts_s) / 86400.0, F.lit(0.0))


def importance(now: int, cited_at: str = "created_s") -> Column:
    """Pinned boost, type weight, recency halved every 14 days, and citations on a log scale halved every 30 days."""
    weight = F.coalesce(*[F.when(F.col("type") == t, F.lit(w)) for t, w in TYPE_WEIGHTS], F.lit(0.0))
    fresh = RECENCY * F.pow(F.lit(0.5), _age_days(F.col("created_s"), now) / RECENCY_DAYS)
    cited = CITED * F.log1p(F.col("cited_count")) * F.pow(F.lit(0.5), _age_days(F.col(cited_at), now) / CITED_DAYS)
    return F.when(F.col("pinned"), PINNED).otherwise(0.0) + weight + fresh + cited


def briefing_entities(entities: DataFrame, now: int, most: int = MOST_ENTITIES, floor: int = OPEN_FLOOR, focus: str | None = None) -> DataFrame:
    """Entities of every project's briefing with score and rank: the best, all of the newest session, and open items.

    Ranks are given out over the cluster, so that a large project takes many tasks; facts of a project (its newest session,
    its stale entities, counted as suppressed) and its best open items are a few rows, joined to the ranked ones.
    """
    pool = entities.filter("not archived")
    if focus:
        pool = pool.filter(F.contains(F.lower("title"), F.lit(focus.lower())) | F.contains(F.lower("content"), F.lit(focus.lower())))
    live = pool.filter("not stale").withColumn("score", F.round(importance(now), 6))
    ranked = cut(numbered(live, ["project_id"], [F.col("score").desc(), "id"], "rank"))
    newest = F.max(F.when(~F.col("stale"), F.struct("created_s", "session_id")))["session_id"]
    facts = cut(pool.groupBy(F.col("project_id").alias("_project")).agg(F.count_if("stale").alias("suppressed"), newest.alias("_last")))
    priority = F.when(F.col("priority") == "high", 3).when(F.col("priority") == "medium", 2).otherwise(1)
    wanted = ranked.filter(F.col("type").isin("todo", "failure") & is_open())
    first = F.row_number().over(Window.partitionBy("project_id").orderBy(priority.desc(), "rank"))
    open_ = wanted.select("project_id", "rank", first.alias("_open")).filter(F.col("_open") <= floor)
    open_ = open_.select(F.col("project_id").alias("_of"), F.col("rank").alias("_rank"), F.lit(True).alias("_open"))
    out = ranked.join(facts, F.col("project_id").eqNullSafe(F.col("_project"))).join(open_, F.col("project_id").eqNullSafe(F.col("_of")) & (F.col("rank") == F.col("_rank")), "left")
    keep = (F.col("rank") <= most) | F.coalesce(F.col("session_id") == F.col("_last"), F.lit(False)) | F.col("_open").isNotNull()
    return out.filter(keep).select(*entities.columns, "suppressed", "score", "rank")


def grouped(selected: DataFrame, sessions: DataFrame) -> DataFrame:
    """(project_id, day, session_id, ids): entities by day, then session, those of unknown sessions ungrouped (null)."""
    known = sessions.select("session_id", F.lit(True).alias("_known")).distinct()
    day = F.date_format(F.timestamp_seconds("created_s"), "yyyy-MM-dd")
    out = selected.join(known, "session_id", "left").withColumn("session_id", F.when(F.col("_known"), F.col("session_id")))
    return out.groupBy("project_id", day.alias("day"), "session_id").agg(F.array_sort(F.collect_list("id")).alias("ids"))


def latest_session(entities: DataFrame, k: int = 5) -> DataFrame:
    """(project_id, section, id, number, overflow): the newest session's entities in four sections, k of each."""
    project = Window.partitionBy("project_id")
    rows = entities.filter("not archived").withColumn("_last", F.max(F.struct("created_s", "session_id")).over(project)["session_id"]).filter("session_id = _last")
    section = F.coalesce(*[F.when(F.col("type").isin(*types), name) for name, types in SECTIONS])
    rows = rows.withColumn("section", section)
    by = Window.partitionBy("project_id", "section")
    rows = rows.withColumn("number", F.row_number().over(by.orderBy(F.col("created_s").desc(), "id"))).withColumn("overflow", F.greatest(F.count("*").over(by) - k, F.lit(0)))
    return rows.filter(F.col("number") <= k).select("project_id", "section", "id", "number", "overflow")


def suggested_next(entities: DataFrame, k: int = 5) -> DataFrame:
    """(project_id, id, place): open failures first, then todos of high and of medium priority."""
    live = entities.filter(~F.col("archived") & ~F.col("stale") & is_open())
    rank = F.when(F.col("type") == "failure", 0).when((F.col("type") == "todo") & (F.col("priority") == "high"), 1).when((F.col("type") == "todo") & (F.col("priority") == "medium"), 2)
    by = Window.partitionBy("project_id").orderBy("_r", F.col("updated_s").desc(), "id")
    return live.withColumn("_r", rank).filter("_r is not null").withColumn("place", F.row_number().over(by)).filter(F.col("place") <= k).select("project_id", "id", "place")


def briefing_text(selected: DataFrame, budget: int, footer: str = "") -> DataFrame:
    """(project_id, lines, text) within a budget of tokens (a quarter of the characters): lines in order of rank until the
    next would pass the budget less the footer's, then the footer."""
    line = F.format_string("- [%s] %s", "type", "title")
    tokens = F.floor(F.length(line) / 4) + 1
    by = Window.partitionBy("project_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    kept = selected.withColumn("line", line).withColumn("used", F.sum(tokens).over(by)).filter(F.col("used") <= budget - len(footer) // 4)
    text = ordered_text(kept, ["project_id"], ["rank"], F.col("line"), "\n", "text")
    counts = kept.groupBy("project_id").agg(F.count("*").alias("lines"))
    return text.join(counts, "project_id").select("project_id", "lines", F.concat("text", F.lit(("\n" + footer) if footer else "")).alias("text"))


def compile_context(parts: DataFrame, window: int) -> DataFrame:
    """(project_id, text, tokens, tokens_saved) of parts (project_id, number, text), cut to a quarter of the window."""
    budget = window // 4
    whole = ordered_text(parts, ["project_id"], ["number"], F.col("text"), "\n\n", "whole")
    text = F.substring("whole", 1, budget * 4)
    return whole.select("project_id", text.alias("text"), F.floor(F.length(text) / 4).alias("tokens"), (4 * F.floor(F.length(text) / 4)).alias("tokens_saved"))


#: What stands behind a text that was cut.
CUT_BODY, CUT_CONTEXT = "\n[truncated]", "\n\n[... context truncated to fit token budget]"


def packed_text(parts: DataFrame, budget: int, mark: str = CUT_BODY, by: str = "project_id") -> DataFrame:
    """(by, text, tokens, lines): every group's lines within a budget of tokens, four characters each.

    ``parts`` has by, role, section, place and text. Lines of role tail are kept whole and reserved first; those of role
    body fill what is left, in order of section and place, the last one cut and ``mark`` put behind it; those of role top
    stand before them and cost nothing. Lines that can't matter, as those before them fill the budget, are left out before
    anything is gathered: a group brings little more than budget * 4 lines at most.
    """
    most = budget * 4
    order = Window.partitionBy(by, "role").orderBy("section", "place")
    lines = parts.filter("text is not null").withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= most + 2)
    long = F.length("text") + 1  # with its line feed
    lines = lines.withColumn("_start", F.coalesce(F.sum(long).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).filter((F.col("role") != "body") | (F.col("_start") <= most + 1))

    def of(role: str) -> tuple:
        chosen = F.array_sort(F.collect_list(F.when(F.col("role") == role, F.struct("section", "place", "_n", "text"))))
        return F.array_join(F.transform(chosen, lambda x: x["text"]), "\n").alias(role), F.count_if(F.col("role") == role).alias(f"{role}_lines")

    texts = lines.groupBy(by).agg(*of("top"), *of("body"), *of("tail"))
    tail = F.when(F.col("tail_lines") > 0, F.concat(F.lit("\n"), F.col("tail"))).otherwise(F.lit(""))
    room = F.greatest(F.lit(most) - F.length("_tail"), F.lit(0))
    cut_ = F.when(F.length("body") > room, F.concat(F.substring("body", F.lit(1), F.greatest(room - len(mark), F.lit(0)).cast("int")), F.lit(mark))).otherwise(F.col("body"))
    texts = texts.withColumn("_tail", tail).withColumn("_body", cut_)
    whole = F.concat(F.when(F.col("top_lines") > 0, F.concat("top", F.lit("\n\n"))).otherwise(F.lit("")), F.col("_body"), F.col("_tail"))
    return texts.select(by, whole.alias("text"), F.floor(F.length(whole) / 4).alias("tokens"), (F.length("body") > room).alias("truncated"))


def _part(df: DataFrame, role: str, section: int, place: Column, text: Column) -> DataFrame:
    return df.select("project_id", F.lit(role).alias("role"), F.lit(section).alias("section"), place.cast("long").alias("place"), text.alias("text"))


def briefing_parts(entities: DataFrame, selected: DataFrame, now: int, notes: DataFrame | None = None, health: DataFrame | None = None) -> DataFrame:
    """The lines of every project's briefing, for ``packed_text``.

    On top the health banner (``health``: project_id, banner) and the overview (``notes``: project_id, note); the body has a
    head line, the newest session's entities by section with what is left out, and the ``selected`` entities
    (briefing_entities) by rank; the tail is what is suggested next and a line on how much was read for it.
    """
    parts = []
    if health is not None:
        parts.append(_part(health, "top", 0, F.lit(0), F.concat(F.lit("! "), F.col("banner"))))
    if notes is not None:
        parts.append(_part(overview(notes.select("project_id"), notes), "top", 1, F.lit(0), F.col("overview")))
    titles = entities.select(F.col("project_id").alias("_p"), F.col("id").alias("_id"), "title", "type")

    def named(df: DataFrame) -> DataFrame:
        return df.join(titles, df["project_id"].eqNullSafe(titles["_p"]) & (df["id"] == titles["_id"]))

    facts = entities.filter("not archived").groupBy("project_id").agg(F.count("*").alias("n"), F.count_if("stale").alias("stale"), F.sum(F.floor(F.length("content") / 4)).alias("work"))
    parts.append(_part(facts, "body", 0, F.lit(0), F.format_string("# %s, %s", F.coalesce("project_id", F.lit("-")), F.date_format(F.timestamp_seconds(F.lit(now)), "yyyy-MM-dd"))))
    places = {name: 10 * (i + 1) for i, (name, _) in enumerate(SECTIONS)}
    latest = cut(named(latest_session(entities).withColumn("_s", F.coalesce(*[F.when(F.col("section") == n, F.lit(v)) for n, v in places.items()], F.lit(9)))))
    for name, section in places.items():
        own = latest.filter(F.col("section") == name)
        head = own.groupBy("project_id").agg(F.max("overflow").alias("overflow"))
        parts.append(_part(head, "body", section, F.lit(0), F.lit(f"## {name}")))
        parts.append(_part(own, "body", section, F.col("number"), F.concat(F.lit("- "), F.col("title"))))
        parts.append(_part(head.filter("overflow > 0"), "body", section, F.lit(1 << 40), F.format_string("  and %d more", "overflow")))
    parts.append(_part(facts.filter("n > stale"), "body", 80, F.lit(0), F.lit("## Memory")))
    parts.append(_part(selected, "body", 80, F.col("rank"), F.format_string("- [%s] %s", "type", "title")))
    following = named(suggested_next(entities))
    parts.append(_part(following.select("project_id").distinct(), "tail", 0, F.lit(0), F.lit("## Suggested next")))
    parts.append(_part(following, "tail", 0, F.col("place"), F.format_string("%d. %s", "place", "title")))
    read = selected.groupBy("project_id").agg(F.count("*").alias("shown"), F.sum(F.floor(F.length("title") / 4)).alias("read"))
    foot = facts.withColumnRenamed("project_id", "_q").join(read, F.col("_q").eqNullSafe(F.col("project_id")), "left").select(F.col("_q").alias("project_id"), "n", "stale", "work", "shown", "read")
    parts.append(_part(foot, "tail", 99, F.lit(0), F.format_string("%d of %d entities, %d stale; %d tokens of work", F.coalesce("shown", F.lit(0)), "n", "stale", F.coalesce("work", F.lit(0)))))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def context_parts(asks: DataFrame, lead: DataFrame, tasks: DataFrame | None = None, timelines: DataFrame | None = None, most_tasks: int = 20) -> DataFrame:
    """The lines of compiled contexts, for ``packed_text`` by context_id.

    ``asks``: context_id and focus (null: none). ``lead`` gives what comes first, of a search (context_id, place, id, type,
    detail) or of a briefing (context_id, place, detail; id and type null). Then come the newest open tasks (context_id, id,
    task_type, title, created_s) and the timelines of files (context_id, file_path, number, day, type, title).
    """
    line = F.when(F.col("id").isNull(), F.col("detail")).otherwise(F.format_string("- [%s] %s: %s", F.left(F.col("id").cast("string"), F.lit(8)), "type", "detail"))

    def part(df: DataFrame, section: int, group: Column, place: Column, text: Column) -> DataFrame:
        return df.select("context_id", F.lit("body").alias("role"), F.struct(F.lit(section).alias("part"), group.cast("string").alias("of")).alias("section"), place.cast("long").alias("place"), text.alias("text"))

    none = F.lit("")
    focused = asks.filter("focus is not null").join(lead.filter("id is not null").select("context_id").distinct(), "context_id", "left_semi")
    parts = [part(focused, 0, none, F.lit(0), F.concat(F.lit("## Context for: "), F.col("focus"), F.lit("\n"))), part(lead, 1, none, F.col("place"), line)]
    if tasks is not None:
        by = Window.partitionBy("context_id").orderBy(F.col("created_s").desc(), "id")
        first = cut(tasks.withColumn("_n", F.row_number().over(by)).filter(F.col("_n") <= most_tasks))
        parts.append(part(first.select("context_id").distinct(), 2, none, F.lit(0), F.lit("\n\n## Open Tasks\n")))
        parts.append(part(first, 2, none, F.col("_n"), F.format_string("- [%s] (%s) %s", F.left(F.col("id").cast("string"), F.lit(8)), F.coalesce("task_type", F.lit("untyped")), "title")))
    if timelines is not None:
        parts.append(part(timelines.select("context_id", "file_path").distinct(), 3, F.col("file_path"), F.lit(0), F.concat(F.lit("\n\n## File: "), F.col("file_path"), F.lit("\n"))))
        parts.append(part(timelines, 3, F.col("file_path"), F.col("number"), F.format_string("  - %s %s: %s", "day", "type", "title")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def compiled(parts: DataFrame, budget: int) -> DataFrame:
    """(context_id, text, tokens, tokens_saved) of ``context_parts`` within a budget of tokens; what reading the sources would have cost more."""
    out = packed_text(parts, budget, CUT_CONTEXT, "context_id")
    return out.select("context_id", "text", "tokens", (4 * F.col("tokens")).alias("tokens_saved"), "truncated")


def usage_calls(contexts: DataFrame, tool: str, now: int) -> DataFrame:
    """Usage rows (project_id, tool_name, tokens_saved, called_s) of a tool's calls, to be appended to the log of calls."""
    return contexts.select("project_id", F.lit(tool).alias("tool_name"), F.greatest("tokens_saved", F.lit(0)).alias("tokens_saved"), F.lit(now).cast("long").alias("called_s"))


def overview(projects: DataFrame, notes: DataFrame, tokens: int = 500) -> DataFrame:
    return projects.join(notes, "project_id", "left").select("project_id", F.substring(F.coalesce("note", F.lit("")), 1, tokens * 4).alias("overview"))
