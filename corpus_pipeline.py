"""Corpus pipeline: toxicity, line dedup, near-dedup, benchmark decontamination, and mixing to target weights.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame with the columns of documents; the last adds what the mix
takes of every document. Between stages the rows are written as Parquet and read again.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memspark.llm import decontaminate, line_dedup, simhash_dedup, source_mix, toxicity
from memspark.llm.common import read_table, shared_folder

#: Learned tagging and set similarity have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def _carried(docs: DataFrame) -> DataFrame:
    """doc_id, text and the row without it, so that an operator's outcome takes no column's place."""
    return docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`").alias(c) for c in docs.columns if c != "text"]).alias("whole"))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the field, learned from the labels, scores below one half."""
    out = toxicity.toxicity(_carried(docs), read_table(spark, sf_dir, "labels"))
    return out.filter("score < 0.5").select(*[F.col("text" if c == "text" else f"whole.`{c}`").alias(c) for c in docs.columns])


def cut_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the later copies of passages of two lines or more; those of which nothing is left go."""
    out = line_dedup.passage_dedup(_carried(docs)).filter("n_removed = 0 or n_removed < n_lines")
    n_chars = F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("whole.n_chars")).cast(docs.schema["n_chars"].dataType) if "n_chars" in docs.columns else None
    new = {"text": F.col("text"), "n_chars": n_chars}
    return out.select(*[(new[c] if c in new else F.col(f"whole.`{c}`")).alias(c) for c in docs.columns])


def drop_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every class of near-duplicates: five-word shingles, similarity 0.8 or more."""
    return simhash_dedup.similar_dedup(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth of the words is shared with the benchmark."""
    return decontaminate.drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes words from, with size, source_size, target and taken."""
    return source_mix.source_mix(docs, keep=tuple(docs.columns)).filter("taken > 0")


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", cut_lines),
    ("simhash_dedup", drop_similar),
    ("decontaminate", drop_contaminated),
    ("source_mix", mix),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    top = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{top}/{name}")
        docs = spark.read.parquet(f"{top}/{name}")
    return docs
