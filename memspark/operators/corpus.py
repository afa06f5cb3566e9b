"""Corpora: saved filter sets with their members, rebuilt and asked about."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from memspark.operators.infer import infer, ordered_text

NEWEST, WARN_TOKENS = 200, 30_000


def build_corpora(filters: DataFrame, entities: DataFrame, files: DataFrame, newest: int = NEWEST) -> DataFrame:
    """(corpus_id, id) of filters (corpus_id, project_id, types, since_s, query, file): of each corpus the newest entities
    that fit project, types and time, then those of them that hold the query and belong to the file."""
    pool = entities.filter("not archived").join(filters, "project_id")
    pool = pool.filter(F.col("types").isNull() | F.array_contains("types", F.col("type"))).filter("since_s is null or created_s >= since_s")
    by = Window.partitionBy("corpus_id").orderBy(F.col("created_s").desc(), F.col("id").desc())
    pool = pool.withColumn("_n", F.row_number().over(by)).filter(F.col("_n") <= newest)
    pool = pool.filter(F.col("query").isNull() | F.contains(F.lower(F.concat_ws(" ", "title", "content")), F.lower("query")))
    touched = files.select(F.col("entity_id").alias("id"), F.col("file_path").alias("file")).distinct()
    free = pool.filter("file is null").select("corpus_id", "id")
    return free.union(pool.filter("file is not null").join(touched, ["id", "file"], "left_semi").select("corpus_id", "id"))


def corpus_sizes(members: DataFrame, entities: DataFrame) -> DataFrame:
    """(corpus_id, entities, tokens, warn)."""
    rows = members.join(entities.select("id", F.floor(F.length("content") / 4).alias("tokens")), "id")
    return rows.groupBy("corpus_id").agg(F.count("*").alias("entities"), F.sum("tokens").alias("tokens")).withColumn("warn", F.col("tokens") > WARN_TOKENS)


def corpus_text(members: DataFrame, entities: DataFrame) -> DataFrame:
    """(corpus_id, text): type and title of the members, in order of creation."""
    rows = members.join(entities.select("id", "created_s", "type", "title"), "id")
    return ordered_text(rows, ["corpus_id"], ["created_s", "id"], F.concat(F.lit("["), "type", F.lit("] "), "title"), "\n", "text")


def rebuild(members: DataFrame, filters: DataFrame, entities: DataFrame, files: DataFrame, ids: DataFrame) -> DataFrame:
    """Members with those of the corpora ``ids`` (corpus_id) built anew."""
    fresh = build_corpora(filters.join(ids, "corpus_id", "left_semi"), entities, files)
    return members.join(ids, "corpus_id", "left_anti").unionByName(fresh)


def delete(members: DataFrame, ids: DataFrame) -> DataFrame:
    return members.join(ids, "corpus_id", "left_anti")


def ask(texts: DataFrame, questions: DataFrame, answer: Callable) -> DataFrame:
    """(corpus_id, question, response) of questions (corpus_id, question), each asked with the corpus before it."""
    prompts = questions.join(texts, "corpus_id").select("corpus_id", "question", F.concat("text", F.lit("\n\nQuestion: "), "question").alias("prompt"))
    return infer(prompts, "prompt", answer).select("corpus_id", "question", "response")
