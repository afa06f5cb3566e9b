"""Model inference in batches: prompts are assembled by joins, the caller gives the function that answers them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memspark.functions.text import each, salvage_json
from memspark.operators.ingest import batch_events, chunk_events

# Categories of a model's reply with the types of their entities.
CATEGORIES = (
    ("decisions", "decision"), ("todos", "todo"), ("facts", "fact"), ("failures", "failure"), ("discoveries", "discovery"),
    ("features", "feature"), ("bugfixes", "bugfix"), ("research", "research"), ("changes", "change"),
)
_ITEM = "array<struct<title:string,content:string,key_points:array<string>,synopsis:string,status:string,priority:string,files:array<string>>>"
REPLY = "struct<" + ",".join(f"{c}:{_ITEM}" for c, _ in CATEGORIES) + ">"
PRIOR_TITLES, NO_TITLES = 40, "(none yet)"

# File endings that make a word a file reference, and the form of one with its line.
EXTENSIONS = "py|pyi|js|jsx|ts|tsx|mjs|cjs|go|rs|java|kt|kts|c|cc|cpp|cxx|h|hpp|rb|php|sh|bash|zsh|sql|json|ya?ml|toml|md|rst|txt|html|htm|css|scss|less|vue|svelte|swift|cs|ex|exs|clj|cljs|lua|pl|proto|graphql|ini|cfg|conf|env"
ANCHOR = rf"(?<![\w/.\-])((?:[\w.\-]+/)+[\w.\-]+\.(?:{EXTENSIONS})|[\w\-]+\.(?:{EXTENSIONS}))(?::(\d+))?(?![\w:])"


def clip(c: Column, limit: int, mark: str = "...") -> Column:
    c = F.coalesce(c, F.lit(""))
    return F.when(F.length(c) > limit, F.concat(F.substring(c, 1, limit), F.lit(mark))).otherwise(c)


def ordered_text(df: DataFrame, by: list[str], order: list[str], line: Column, joiner: str, name: str) -> DataFrame:
    """Lines of each group joined in order."""
    out = df.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(*order, line.alias("_line")))).alias("_all"))
    return out.select(*by, F.array_join(F.transform("_all", lambda x: x["_line"]), joiner).alias(name))


def extraction_prompts(events: DataFrame, entities: DataFrame, n: int = 50) -> DataFrame:
    """(project_id, batch, prompt): the batch's events, a line each, behind up to 40 titles known in the first event's session."""
    batches = batch_events(events, n).select("project_id", "batch", F.posexplode("event_ids").alias("number", "event_id"))
    rows = batches.join(events.select("event_id", "session_id", "type", "content"), "event_id")
    body = ordered_text(rows, ["project_id", "batch"], ["number"], F.concat(F.lit("["), "type", F.lit("] "), "content"), "\n", "events_text")
    first = rows.filter("number = 0").select("project_id", "batch", "session_id")
    by = Window.partitionBy("session_id").orderBy(F.col("created_s").desc(), F.col("id").desc())
    known = entities.select("session_id", "created_s", "id", "title").withColumn("_n", F.row_number().over(by)).filter(F.col("_n") <= PRIOR_TITLES)
    titles = ordered_text(known, ["session_id"], ["_n"], F.concat(F.lit("- "), "title"), "\n", "titles")
    out = body.join(first, ["project_id", "batch"]).join(titles, "session_id", "left")
    return out.select("project_id", "batch", F.concat(F.lit("Known:\n"), F.coalesce("titles", F.lit(NO_TITLES)), F.lit("\nEvents:\n"), "events_text").alias("prompt"))


def infer(df: DataFrame, prompt: str, answer: Callable[[list[str]], list[str]], batch: int = 32) -> DataFrame:
    """``df`` with the reply to each prompt; a failed call fails its task, which Spark runs again."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            replies = [r for at in range(0, len(frame), batch) for r in answer(list(frame[prompt].iloc[at : at + batch]))]
            if len(replies) != len(frame):
                raise ValueError(f"{len(replies)} replies to {len(frame)} prompts")
            yield frame.assign(response=replies)

    return df.mapInPandas(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields) + ", response string")


def salvage(df: DataFrame, response: str = "response") -> DataFrame:
    """``df`` with the JSON found in each response, null where none is."""
    return df.withColumn("json", F.pandas_udf(each(salvage_json), "string")(F.col(response)))


def salvage_report(df: DataFrame, by: str) -> DataFrame:
    return df.groupBy(by).agg(F.count("*").alias("responses"), F.count("json").alias("parsed"), F.round(F.count("json") / F.count("*"), 6).alias("rate"))


def parse_extractions(df: DataFrame, key: str) -> DataFrame:
    """Entities of replies (key, json): (key, category number, number, type, title, content, synopsis, status, files).

    Items without a title are dropped; key points become bullets below the content; a todo is open.
    """
    reply = df.select(key, F.from_json("json", REPLY).alias("r")).filter("r is not null")
    rows = None
    for n, (category, kind) in enumerate(CATEGORIES):
        part = reply.select(key, F.lit(n).alias("category"), F.lit(kind).alias("type"), F.posexplode(f"r.{category}").alias("number", "item"))
        rows = part if rows is None else rows.unionByName(part)
    points = F.array_join(F.transform("item.key_points", lambda p: F.concat(F.lit("- "), p)), "\n")
    content = F.concat_ws("\n", F.nullif(F.coalesce("item.content", F.lit("")), F.lit("")), F.nullif(F.coalesce(points, F.lit("")), F.lit("")))
    status = F.coalesce("item.status", F.when(F.col("type") == "todo", "open"))
    return rows.filter("trim(coalesce(item.title, '')) <> ''").select(key, "category", "number", "type", F.trim("item.title").alias("title"), content.alias("content"), "item.synopsis", status.alias("status"), F.coalesce("item.files", F.array().cast("array<string>")).alias("files"))


def file_anchors(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, file_path, line_number): file references in a text, the first of each path."""
    found = df.select(key, F.posexplode(F.arrays_zip(F.regexp_extract_all(text, F.lit(ANCHOR), F.lit(1)).alias("path"), F.regexp_extract_all(text, F.lit(ANCHOR), F.lit(2)).alias("line"))).alias("at", "x"))
    out = found.groupBy(key, F.col("x.path").alias("file_path")).agg(F.min_by("x.line", "at").alias("line"))
    return out.select(key, "file_path", F.expr("try_cast(nullif(line, '') as bigint)").alias("line_number"))


def anchor_validity(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files with valid: null for a path that leaves the root, else whether the manifest (file_path) has it; and a note."""
    outside = F.col("file_path").startswith("/") | F.concat(F.lit("/"), "file_path", F.lit("/")).contains("/../")
    out = files.join(manifest.select("file_path").distinct().withColumn("_has", F.lit(True)), "file_path", "left")
    valid = F.when(~outside, F.coalesce("_has", F.lit(False)))
    return out.withColumn("valid", valid).withColumn("note", F.when(~F.col("valid"), F.concat(F.lit("file gone: "), "file_path"))).drop("_has")


def chunk_summaries(events: DataFrame, n: int = 20) -> DataFrame:
    """Full chunks with the prompt for their summary, their time range, and the tokens they hold."""
    chunks = chunk_events(events, n)
    rows = chunks.select("session_id", "chunk", "start_s", "end_s", F.posexplode("event_ids").alias("number", "event_id")).join(events.select("event_id", "type", "content"), "event_id")
    out = rows.groupBy("session_id", "chunk", "start_s", "end_s").agg(F.array_sort(F.collect_list(F.struct("number", F.concat(F.lit("["), "type", F.lit("] "), "content").alias("line")))).alias("_all"), F.sum(F.floor(F.length("content") / 4)).alias("tokens"))
    return out.select("session_id", "chunk", "start_s", "end_s", "tokens", F.array_join(F.transform("_all", lambda x: x["line"]), "\n").alias("prompt"))


def unsummarized(events: DataFrame, chunks: DataFrame) -> DataFrame:
    """Events that no chunk summary (session_id, start_s, end_s) of their session covers; joined on the session."""
    spans = chunks.select("session_id", "start_s", "end_s")
    return events.join(spans, (events["session_id"] == spans["session_id"]) & events["ts_s"].between(spans["start_s"], spans["end_s"]), "left_anti")


def session_summary_inputs(events: DataFrame, chunks: DataFrame) -> DataFrame:
    """Per session: the number of its chunk summaries and the text of its events that none covers."""
    rest = ordered_text(unsummarized(events, chunks), ["session_id"], ["ts_s", "event_id"], F.col("content"), "\n", "rest")
    counts = chunks.groupBy("session_id").agg(F.count("*").alias("chunks"))
    return counts.join(rest, "session_id", "full").select("session_id", F.coalesce("chunks", F.lit(0)).alias("chunks"), F.coalesce("rest", F.lit("")).alias("rest"))


def cross_session_inputs(summaries: DataFrame, sessions: DataFrame, k: int = 10) -> DataFrame:
    """Per project: the session summaries of its latest k sessions, the oldest first."""
    rows = summaries.filter("level = 'session'").join(sessions.select("session_id", "ended_s"), "session_id")
    by = Window.partitionBy("project_id").orderBy(F.col("ended_s").desc(), F.col("id").desc())
    last = rows.withColumn("_n", F.row_number().over(by)).filter(F.col("_n") <= k)
    return ordered_text(last, ["project_id"], ["ended_s", "id"], F.col("id").cast("string"), ",", "summary_ids")


def judge_prompts(pairs: DataFrame, size: int = 10) -> DataFrame:
    """(project_id, chunk, prompt) for chunks of driver and target pairs: titles cut at 200 and texts at 400 characters."""
    numbered = pairs.withColumn("_n", F.row_number().over(Window.partitionBy("project_id").orderBy("driver", "target")) - 1).withColumn("chunk", F.floor(F.col("_n") / size))
    line = F.format_string("%d. DRIVER [%d] %s\n   %s\n   TARGET [%d] %s\n   %s", (F.col("_n") % size + 1).cast("int"), "driver", clip(F.col("driver_title"), 200), clip(F.col("driver_content"), 400), "target", clip(F.col("target_title"), 200), clip(F.col("target_content"), 400))
    return ordered_text(numbered, ["project_id", "chunk"], ["_n"], line, "\n\n", "prompt")


def staleness_verdicts(df: DataFrame, text: str = "json") -> DataFrame:
    """Verdict of each reply: superseded, contradicted or coexists; anything else counts as coexists."""
    said = F.lower(F.get_json_object(text, "$.verdict"))
    return df.withColumn("verdict", F.when(said.isin("superseded", "contradicted", "coexists"), said).otherwise("coexists"))


def reextract(events: DataFrame, entities: DataFrame, answer: Callable, n: int = 50, since: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Extract anew: replacement entities, events covered by batches whose reply parsed, and a report by project.

    Archive with ``lifecycle.fully_covered`` on the covered events; failed batches cover none.
    """
    pool = events.filter(F.col("ts_s") >= since) if since is not None else events
    replies = salvage(infer(extraction_prompts(pool, entities, n), "prompt", answer))
    parsed = replies.withColumn("key", F.concat_ws("-", "project_id", "batch")).drop("prompt")
    done = parsed.filter("json is not null").select("project_id", "batch")
    covered = batch_events(pool, n).join(done, ["project_id", "batch"]).select(F.explode("event_ids").alias("event_id"))
    report = parsed.groupBy("project_id").agg(F.count("*").alias("batches"), F.count("json").alias("parsed"))
    return parse_extractions(parsed, "key"), covered, report
