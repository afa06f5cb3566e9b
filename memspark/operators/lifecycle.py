"""Lifecycle of entities: open items, commands in bulk, resolution candidates, provenance and coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memspark.functions.checkpoints import cut
from memspark.operators.embed import block_cosine

# Statuses that close an item, kinds that close items, kinds that can be closed, words that tell nothing.
CLOSED = ("done", "cancelled", "resolved")
DRIVERS, RESOLVABLE = ("bugfix", "feature", "change"), ("todo", "failure")
STOPWORDS = ("implement", "update", "add", "fix", "create", "remove", "build", "write", "setup", "configure", "install", "test", "also", "with", "from", "that", "this", "which", "where")


def is_open(status: str = "status") -> Column:
    """True for a status that is not null and does not close an item."""
    return F.coalesce(~F.col(status).isin(*CLOSED), F.lit(False))


def resolve(entities: DataFrame, commands: DataFrame) -> DataFrame:
    """Apply close commands (id, note, at_s): todo becomes done and others resolved; adds unchanged for those closed already."""
    out = entities.join(commands, "id")
    already = ~is_open() & F.col("status").isNotNull()
    status = F.when(already, F.col("status")).when(F.col("type") == "todo", "done").otherwise("resolved")
    return out.select("id", "type", status.alias("status"), F.when(already, None).otherwise(F.col("at_s")).alias("resolved_s"), F.when(already, F.col("stale")).otherwise(F.lit(False)).alias("stale"), F.when(~already, F.map_concat(F.create_map(F.lit("note"), F.col("note")))).alias("metadata"), already.alias("unchanged"))


def reopen(entities: DataFrame, commands: DataFrame) -> DataFrame:
    """Apply reopen commands (id): (id, status, outcome); only todos and failures with a status can be reopened."""
    out = entities.join(commands.select("id"), "id")
    can = F.col("type").isin(*RESOLVABLE)
    outcome = F.when(~can, "unsupported").when(F.col("status").isNull() | is_open(), "unchanged").otherwise("reopened")
    status = F.when(outcome == "reopened", F.when(F.col("type") == "todo", "open").otherwise("unresolved")).otherwise(F.col("status"))
    return out.select("id", status.alias("status"), outcome.alias("outcome"))


def apply_commands(entities: DataFrame, commands: DataFrame) -> DataFrame:
    """Pin, unpin, archive and touch commands (id, command, at_s) in bulk; the last of each kind counts."""
    per = commands.groupBy("id").agg(
        F.max_by("command", F.when(F.col("command").isin("pin", "unpin"), F.col("at_s"))).alias("pinning"),
        F.bool_or(F.col("command") == "archive").alias("_archive"), F.max(F.when(F.col("command") == "touch", F.col("at_s"))).alias("_touch"),
    )
    out = entities.join(per, "id", "left")
    return out.withColumn("pinned", F.when(F.col("pinning").isin("pin", "unpin"), F.col("pinning") == "pin").otherwise(F.col("pinned"))).withColumn("archived", F.col("archived") | F.coalesce("_archive", F.lit(False))).withColumn("updated_s", F.coalesce(F.greatest("updated_s", "_touch"), "updated_s")).drop("pinning", "_archive", "_touch")


def live(entities: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, live) of asked ids: whether each is neither archived nor stale."""
    out = ids.select("id").join(entities.select("id", "archived", "stale"), "id", "left")
    return out.select("id", F.coalesce(~F.col("archived") & ~F.col("stale"), F.lit(False)).alias("live"))


def resolution_candidates(entities: DataFrame, pool: int = 200, per_driver: int = 3) -> DataFrame:
    """(driver, target, hits, rank): open items whose titles hold enough words of a driver's title.

    A driver's words of more than three letters, stopwords left out, are looked for in the titles of the newest open items
    of its project; max(2, half of the words) must be there. The pool has a fixed size for each project, so the join
    is the drivers' words times that bound.
    """
    words = F.filter(F.split(F.trim("title"), r"\s+"), lambda w: (F.length(w) > 3) & ~F.lower(w).isin(*STOPWORDS))
    drivers = entities.filter(F.col("type").isin(*DRIVERS) & ~F.col("stale")).select("project_id", F.col("id").alias("driver"), words.alias("words")).filter(F.size("words") >= 2)
    by = Window.partitionBy("project_id").orderBy(F.col("created_s").desc(), F.col("id").desc())
    targets = entities.filter(F.col("type").isin(*RESOLVABLE) & F.col("status").isin("open", "unresolved")).withColumn("_n", F.row_number().over(by)).filter(F.col("_n") <= pool).select("project_id", F.col("id").alias("target"), F.lower("title").alias("title"), "_n")
    pairs = drivers.join(targets, "project_id").withColumn("hits", F.size(F.filter("words", lambda w: F.contains(F.col("title"), F.lower(w)))))
    pairs = pairs.filter(F.col("hits") >= F.greatest(F.lit(2), F.floor(F.size("words") / 2)))
    rank = F.row_number().over(Window.partitionBy("driver").orderBy(F.col("hits").desc(), "_n"))
    return pairs.withColumn("rank", rank).filter(F.col("rank") <= per_driver).select("project_id", "driver", "target", "hits", "rank")


def claim(candidates: DataFrame) -> DataFrame:
    """Each target goes to the first driver (by id, as drivers come in order of creation) that asks for it."""
    by = Window.partitionBy("target").orderBy("driver", "rank")
    return candidates.withColumn("_n", F.row_number().over(by)).filter("_n = 1").drop("_n")


def discussion_guard(candidates: DataFrame, sources: DataFrame) -> DataFrame:
    """Without pairs whose driver's source text (driver, text) quotes the target's full or short id."""
    out = candidates.join(sources, "driver", "left")
    text, name = F.lower(F.coalesce("text", F.lit(""))), F.lower("target_key")
    return out.filter(~(F.contains(text, name) | F.contains(text, F.right(name, F.lit(8))))).drop("text")


def apply_judgements(pairs: DataFrame, verdicts: DataFrame, size: int = 10) -> DataFrame:
    """(driver, target, outcome) of pairs in chunks; a chunk that is not wholly judged is UNCERTAIN, CONFIRMED closes."""
    numbered = pairs.withColumn("chunk", F.floor((F.row_number().over(Window.partitionBy("project_id").orderBy("driver", "target")) - 1) / size))
    out = numbered.join(verdicts, ["driver", "target"], "left")
    whole = F.bool_and(F.coalesce(F.col("verdict").isin("CONFIRMED", "REJECTED"), F.lit(False))).over(Window.partitionBy("project_id", "chunk"))
    return out.select("project_id", "driver", "target", "chunk", F.when(whole, F.col("verdict")).otherwise("UNCERTAIN").alias("outcome"))


def widen_recall(drivers: DataFrame, targets: DataFrame, claimed: DataFrame, floor: float = 0.60, per_driver: int = 3, most: int = 50) -> DataFrame:
    """Pairs of a driver and an unclaimed open item by vectors: the best three of a driver, each target to its best
    driver, the best fifty of a project. Where a sequential claim would take them in order, the best score takes them."""
    free = targets.join(claimed.select("target"), "target", "left_anti")
    ids = lambda df, who: df.select("project_id", F.col(who).alias("id"), F.col(f"{who}_vector").alias("vector"))
    pairs = cut(block_cosine(ids(drivers, "driver"), ids(free, "target"), ["project_id"], floor=floor).withColumnsRenamed({"left_id": "driver", "right_id": "target"}))
    for by, order, n in ((["driver"], [F.col("similarity").desc(), "target"], per_driver), (["target"], [F.col("similarity").desc(), "driver"], 1), (["project_id"], [F.col("similarity").desc(), "driver", "target"], most)):
        pairs = pairs.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("_n") <= n).drop("_n")
    return pairs.select("project_id", "driver", "target", "similarity")


def source_text(entities: DataFrame, events: DataFrame, joiner: str = "\n") -> DataFrame:
    """(id, text): contents of an entity's source events in the recorded order (source_event_ids, else source_event_id)."""
    ids = F.when(F.size(F.coalesce("source_event_ids", F.array().cast("array<bigint>"))) > 0, F.col("source_event_ids")).otherwise(F.array_compact(F.array("source_event_id")))
    rows = entities.select("id", F.posexplode(ids).alias("number", "event_id"))
    parts = rows.join(events.select("event_id", "content"), "event_id").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("number", "content"))).alias("parts"))
    return parts.select("id", F.array_join(F.transform("parts", lambda p: p["content"]), joiner).alias("text"))


def fully_covered(entities: DataFrame, covered: DataFrame, force: bool = False) -> DataFrame:
    """(id) of unarchived entities all of whose source events are covered; pinned and closed ones are kept unless forced."""
    pool = entities.filter("not archived")
    pool = pool if force else pool.filter(~F.col("pinned") & (F.col("status").isNull() | is_open()))
    rows = pool.select("id", F.explode("source_event_ids").alias("event_id")).join(covered.select("event_id").distinct().withColumn("_has", F.lit(True)), "event_id", "left")
    return rows.groupBy("id").agg(F.bool_and(F.coalesce("_has", F.lit(False))).alias("all")).filter("all").select("id")


def repair_archived(entities: DataFrame, since: int | None = None) -> DataFrame:
    """Archived open items without a reason to be (not stale, not superseded): to be restored."""
    out = entities.filter(F.col("archived") & is_open() & ~F.col("stale") & F.col("superseded_by").isNull())
    return out.filter(F.col("updated_s") >= since) if since is not None else out


def describe_pairs(pairs: DataFrame, entities: DataFrame) -> DataFrame:
    """Pairs with the type and title of both sides."""
    side = lambda n: entities.select(F.col("id").alias(n), F.col("type").alias(f"{n}_type"), F.substring("title", 1, 200).alias(f"{n}_title"))
    return pairs.join(side("driver"), "driver").join(side("target"), "target")
