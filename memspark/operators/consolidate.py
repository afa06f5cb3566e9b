"""Consolidation of new entities into existing ones, staleness, and transfer of citation credit."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from memspark.functions.checkpoints import cut
from memspark.functions.graph import chain_ends
from memspark.functions.numbering import numbered
from memspark.functions.text import ratio_at_least
from memspark.operators.search import query_terms, query_tokens, rank_entities, vector_rank

GATE = 0.55
VERDICTS = ("ADD", "UPDATE", "NOOP", "CONTRADICTS")
STALENESS_TYPES = ("decision", "fact", "feature", "bugfix", "todo")


def similar_entities(new: DataFrame, base: DataFrame, block: list[str], k: int = 5) -> DataFrame:
    """(id, existing_id, similarity, rank): the k most similar vectors of the same block that are not of the batch.

    The vectors of a block meet the new ones tile by tile, as matrix products, so that a large block makes no pairs.
    """
    name = F.to_json(F.struct(*block), {"ignoreNullFields": "false"}).alias("model")
    old = base.join(new.select("id"), "id", "left_anti").select(F.col("id").alias("entity_id"), name, F.size("vector").alias("dim"), "vector")
    asked = new.select(F.col("id").alias("query_id"), name, F.size("vector").alias("dim"), F.col("vector").alias("query_vector"))
    return vector_rank(old, asked, k, -1.0).select(F.col("query_id").alias("id"), F.col("entity_id").alias("existing_id"), "similarity", "rank")


def lexical_candidates(new: DataFrame, entities: DataFrame, postings: DataFrame, k: int = 5) -> DataFrame:
    """(id, existing_id): what a search of the index for each new entity's title finds first in its project and type, among
    entities that are neither archived nor stale nor new themselves."""
    asks = new.filter("title is not null and title <> ''").select(F.col("id").alias("query_id"), "title", "project_id", "type")
    others = entities.join(new.select("id"), "id", "left_anti")
    found = rank_entities(postings, others, cut(query_terms(asks, "title")), k, scope=asks.select("query_id", "project_id", "type"), stale=False)
    return found.select(F.col("query_id").alias("id"), F.col("id").alias("existing_id"))


def similar_by_text(new: DataFrame, hits: DataFrame, titles: DataFrame, k: int = 5) -> DataFrame:
    """(id, existing_id, similarity): lexical hits (id, existing_id) rescored by the similarity of lower-case titles."""
    def ratio(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([ratio_at_least(a, b, 0.0) for a, b in zip(x, y, strict=True)])

    rows = hits.join(new.select("id", F.lower("title").alias("_x")), "id").join(titles.select(F.col("id").alias("existing_id"), F.lower("title").alias("_y")), "existing_id")
    rows = rows.withColumn("similarity", F.round(F.pandas_udf(ratio, "double")("_x", "_y"), 6))
    by = Window.partitionBy("id").orderBy(F.col("similarity").desc(), "existing_id")
    return rows.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k).select("id", "existing_id", "similarity", "rank")


def gate(new: DataFrame, similar: DataFrame, threshold: float = GATE) -> DataFrame:
    """(id, best, judged): whether the best similarity is high enough to be judged; others are added unjudged."""
    best = similar.groupBy("id").agg(F.max("similarity").alias("best"))
    return new.select("id").join(best, "id", "left").withColumn("judged", F.coalesce(F.col("best") >= threshold, F.lit(False)))


def validate_verdicts(asked: DataFrame, candidates: DataFrame, verdicts: DataFrame) -> DataFrame:
    """(batch, id, verdict, existing_id): a batch of verdicts holds only if every entry asked for has exactly one verdict,
    a known one, and names a candidate of its own unless it adds; else the whole batch is added."""
    counted = asked.join(verdicts, ["batch", "id"], "left").join(candidates.select("id", "existing_id").distinct().withColumn("_known", F.lit(True)), ["id", "existing_id"], "left")
    fine = F.coalesce(F.col("verdict").isin(*VERDICTS), F.lit(False)) & ((F.col("verdict") == "ADD") | F.coalesce("_known", F.lit(False)))
    per = Window.partitionBy("batch")
    times = F.count("*").over(Window.partitionBy("batch", "id"))
    out = counted.withColumn("_n", times).withColumn("_fine", F.bool_and(fine & (F.col("_n") == 1)).over(per))
    return out.select("batch", "id", F.when(F.col("_fine"), F.col("verdict")).otherwise("ADD").alias("verdict"), F.when(F.col("_fine") & (F.col("verdict") != "ADD"), F.col("existing_id")).alias("existing_id")).distinct()


def _claims(decisions: DataFrame, dead: DataFrame) -> DataFrame:
    """Supersessions (batch, position, id, verdict, existing_id) with _wins: the first by position on an entity that is not dead."""
    gone = dead.select(F.col("id").alias("existing_id")).distinct().withColumn("_dead", F.lit(True))
    claims = decisions.filter("verdict in ('UPDATE', 'CONTRADICTS')").join(gone, "existing_id", "left")
    turn = F.row_number().over(Window.partitionBy("existing_id").orderBy("position", "id"))
    return claims.withColumn("_wins", (turn == 1) & F.col("_dead").isNull())


def apply_verdicts(decisions: DataFrame, dead: DataFrame) -> DataFrame:
    """(batch, id, outcome, target) of decisions (batch, position, id, verdict, existing_id).

    First the supersessions: of UPDATE and CONTRADICTS on one entity the first by position wins, the others add, as do
    those on an entity already dead. Then every NOOP goes to the survivor of its entity, at the end of the chain of
    supersessions where it was superseded again, and adds if that is dead or the chain is a circle. The second step sees
    all of the first, so the order of decisions does not matter to it.
    """
    claims = cut(_claims(decisions, dead))
    gone = dead.select(F.col("id").alias("_gone")).distinct()
    survivors = chain_ends(claims.filter("_wins"), "existing_id", "id").select(F.col("node").alias("existing_id"), F.col("end").alias("survivor"), F.lit(True).alias("_moved"))
    first = claims.select("batch", "id", F.when(F.col("_wins"), F.col("verdict")).otherwise("ADD").alias("outcome"), F.when(F.col("_wins"), F.col("existing_id")).alias("target"))
    noops = decisions.filter("verdict = 'NOOP'").join(survivors, "existing_id", "left").withColumn("_to", F.when(F.col("_moved"), F.col("survivor")).otherwise(F.col("existing_id")))
    noops = noops.join(gone, F.col("_to") == F.col("_gone"), "left")
    fine = F.col("_to").isNotNull() & F.col("_gone").isNull() & (F.col("_to") != F.col("id"))
    second = noops.select("batch", "id", F.when(fine, "NOOP").otherwise("ADD").alias("outcome"), F.when(fine, F.col("_to")).alias("target"))
    third = decisions.filter("verdict = 'ADD'").select("batch", "id", F.lit("ADD").alias("outcome"), F.lit(None).cast(decisions.schema["existing_id"].dataType).alias("target"))
    return first.unionByName(second).unionByName(third)


def consolidate_entities(entities: DataFrame, outcomes: DataFrame, now: int) -> DataFrame:
    """``entities`` after the outcomes of ``apply_verdicts``, in one rewrite, with ``changed``.

    What an UPDATE or CONTRADICTS supersedes becomes stale with the reason and the entity that took its place, a contradicted
    one with the time it ended (invalidated_s). What a NOOP found to be there already is archived and names its survivor,
    which counts as updated now. Citations go along the links to the entity at their end, and stay where links run in a
    circle. Entities need id, stale, archived, cited_count, updated_s; an entity archived before keeps its state.
    """
    took = outcomes.filter("outcome in ('UPDATE', 'CONTRADICTS')").groupBy(F.col("target").alias("_old")).agg(F.min_by("id", "id").alias("_by"), F.min_by("outcome", "id").alias("_how"))
    live = entities.filter("not archived").select("id")
    same = outcomes.filter("outcome = 'NOOP'").join(live, "id", "left_semi").groupBy(F.col("id").alias("_copy")).agg(F.min("target").alias("_survivor"))
    took, same = cut(took), cut(same)
    links = cut(took.select(F.col("_old").alias("src"), F.col("_by").alias("dst")).union(same.join(took.select(F.col("_old").alias("_copy")), "_copy", "left_anti").select("_copy", "_survivor")))
    ends = cut(chain_ends(links).filter("end is not null"))
    credit = ends.join(entities.select(F.col("id").alias("node"), "cited_count"), "node").groupBy(F.col("end").alias("_end")).agg(F.sum("cited_count").alias("_credit"))
    touched = same.select(F.col("_survivor").alias("_touched")).distinct()
    given = ends.select(F.col("node").alias("_giver"))
    out = entities
    for part, key in ((took, "_old"), (same, "_copy"), (credit, "_end"), (touched, "_touched"), (given, "_giver")):
        out = out.join(part, out["id"] == part[key], "left")
    old, copy = F.col("_old").isNotNull(), F.col("_copy").isNotNull()
    new = {
        "stale": F.col("stale") | old,
        "archived": F.col("archived") | copy,
        "superseded_by": F.when(old, F.col("_by")).when(copy, F.col("_survivor")).otherwise(F.col("superseded_by") if "superseded_by" in entities.columns else F.lit(None)),
        "staleness_reason": F.when(old, F.when(F.col("_how") == "UPDATE", "consolidated").otherwise("contradicted")).otherwise(F.col("staleness_reason") if "staleness_reason" in entities.columns else F.lit(None)),
        "invalidated_s": F.when(F.col("_how") == "CONTRADICTS", F.lit(now).cast("long")).otherwise(F.col("invalidated_s") if "invalidated_s" in entities.columns else F.lit(None)),
        "cited_count": F.when(F.col("_giver").isNotNull(), F.lit(0)).otherwise(F.col("cited_count")) + F.coalesce("_credit", F.lit(0)),
        "updated_s": F.when(F.col("_touched").isNotNull(), F.lit(now).cast("long")).otherwise(F.col("updated_s")),
        "changed": old | copy | F.col("_end").isNotNull() | F.col("_touched").isNotNull(),
    }
    kept = [new[c].alias(c) if c in new else F.col(c) for c in entities.columns]
    return out.select(*kept, *[v.alias(c) for c, v in new.items() if c not in entities.columns])


def decision_report(decisions: DataFrame) -> DataFrame:
    """Per bucket of decisions (verdict, judged, failed, similarity): number, least, median and most similarity."""
    bucket = F.when(F.col("verdict") != "ADD", F.col("verdict")).when(F.col("failed"), "ADD judge failed").when(F.col("judged"), "ADD judged").otherwise("ADD never asked")
    return decisions.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"), F.round(F.min("similarity"), 6).alias("least"), F.round(F.median("similarity"), 6).alias("median"), F.round(F.max("similarity"), 6).alias("most"))


def staleness_candidates(entities: DataFrame, now: int, minutes: int = 60, k: int = 5, tokens: int = 6) -> DataFrame:
    """(id, older_id, rank): for new live entities the newest older ones of the same project and type that share a word.

    The words are the first six of four letters or more. Every word has a list of its entities by time, numbered over the
    cluster; a new entity knows from its own place how many of them are older, and takes the k before it by their numbers.
    So a word that all entities hold costs k rows for each new one, and no pairs.
    """
    live = entities.filter(~F.col("stale") & ~F.col("archived") & F.col("type").isin(*STALENESS_TYPES)).filter("created_s is not null")
    text = F.concat_ws(" ", "title", "content")
    keys = ["project_id", "type", "word"]
    asks = cut(live.filter(F.col("created_s") >= now - minutes * 60).select(*keys[:2], "id", "created_s", F.explode(query_tokens(text, min_len=4, max_tokens=tokens)).alias("word")))
    lists = live.select(*keys[:2], "id", "created_s", F.explode(query_tokens(text)).alias("word")).join(asks.select(*keys).distinct(), keys, "left_semi")
    lists = cut(lists)
    # entities of one second go by falling id, so that the k before a place are the newest, ties by smaller id; an ask stands before those of its second
    both = numbered(lists.withColumn("asks", F.lit(1)).unionByName(asks.withColumn("asks", F.lit(0))), keys, ["created_s", "asks", F.col("id").desc()], "place")
    older = both.filter("asks = 0").join(numbered(asks, keys, ["created_s", F.col("id").desc()], "turn").select(*keys, "id", "turn"), [*keys, "id"])
    wanted = older.select(*keys, "id", F.explode(F.sequence(F.col("place") - F.col("turn") - (k - 1), F.col("place") - F.col("turn"))).alias("at"))
    listed = numbered(lists, keys, ["created_s", F.col("id").desc()], "at").select(*keys, "at", F.col("id").alias("older_id"), F.col("created_s").alias("older_s"))
    pairs = wanted.join(listed, [*keys, "at"]).filter("older_id <> id").select("id", "older_id", "older_s").distinct()
    by = Window.partitionBy("id").orderBy(F.col("older_s").desc(), "older_id")
    return pairs.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k).select("id", "older_id", "rank")


def mark_stale(entities: DataFrame, marks: DataFrame) -> DataFrame:
    """Entities with ``marks`` (id, by, reason) applied to those that are not stale yet; ``changed`` tells which."""
    out = entities.join(marks, "id", "left")
    change = F.col("reason").isNotNull() & ~F.col("stale")
    return out.select(*[c for c in entities.columns if c not in ("stale", "superseded_by", "staleness_reason")], (F.col("stale") | change).alias("stale"), F.when(change, F.col("by")).alias("superseded_by"), F.when(change, F.col("reason")).alias("staleness_reason"), change.alias("changed"))


def mark_current(entities: DataFrame, ids: DataFrame) -> DataFrame:
    out = entities.join(ids.select("id").distinct().withColumn("_c", F.lit(True)), "id", "left")
    return out.withColumn("stale", F.col("stale") & F.col("_c").isNull()).drop("_c")


def transfer_citations(entities: DataFrame, moves: DataFrame) -> DataFrame:
    """Citation credit moved from src to dst: counts add up, the last citation moves forward, sources become 0."""
    paid = moves.join(entities.select(F.col("id").alias("src"), F.col("cited_count").alias("n"), F.col("last_cited_s").alias("at")), "src").groupBy(F.col("dst").alias("id")).agg(F.sum("n").alias("_n"), F.max("at").alias("_at"))
    out = entities.join(paid, "id", "left").join(moves.select(F.col("src").alias("id"), F.lit(True).alias("_src")).distinct(), "id", "left")
    kept = F.when(F.col("_src").isNull(), F.col("cited_count")).otherwise(F.lit(0))
    return out.withColumn("cited_count", kept + F.coalesce("_n", F.lit(0))).withColumn("last_cited_s", F.when(F.col("_n") > 0, F.greatest("last_cited_s", "_at")).otherwise(F.col("last_cited_s"))).drop("_n", "_at", "_src")
