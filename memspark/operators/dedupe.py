"""Near-duplicate titles: signatures, blocked pairs, clusters and survivors."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memspark.functions.graph import connected_components
from memspark.functions.text import ratio_at_least

THRESHOLD, PREFIX = 0.82, 24


def signature(title: Column) -> Column:
    """Lower-case letters, digits and single spaces of a title."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(title, F.lit(""))), "[^a-z0-9 ]", " "), " +", " "))


def digit_runs(title: Column) -> Column:
    return F.array_join(F.regexp_extract_all(title, F.lit(r"(\d+)"), F.lit(1)), "-")


def signatures(entities: DataFrame, block: list[str], prefix: int = PREFIX) -> DataFrame:
    """(id, block columns, created_s, sig, digits, head) of live entities that have a title."""
    out = entities.filter("not stale and not archived").select("id", *block, "created_s", signature(F.col("title")).alias("sig"))
    return out.filter("sig <> ''").withColumn("digits", digit_runs(F.col("sig"))).withColumn("head", F.substring("sig", 1, prefix))


def duplicate_pairs(entities: DataFrame, block: list[str], threshold: float = THRESHOLD, sim: str = "ratio") -> DataFrame:
    """(a, b, similarity) with a < b: titles of one block, with the same first letters and the same digits, that are similar.

    Equal titles are collapsed before the join: each hangs on the smallest id of its title, and only different titles
    are compared, so a title that occurs thousands of times adds a row each and no pairs.
    """
    rows = signatures(entities, block)
    keys = [*block, "head", "digits"]
    heads = rows.groupBy(*keys, "sig").agg(F.min("id").alias("rep"))
    same = rows.join(heads, [*keys, "sig"]).filter("id <> rep").select(F.col("rep").alias("a"), F.col("id").alias("b"), F.lit(1.0).alias("similarity"))
    left, right = heads.select(*keys, F.col("rep").alias("a"), F.col("sig").alias("x")), heads.select(*keys, F.col("rep").alias("b"), F.col("sig").alias("y"))
    longest = F.greatest(F.length("x"), F.length("y"))
    pairs = left.join(right, keys).filter("a < b")
    if sim == "levenshtein":
        scored = pairs.filter(F.least(F.length("x"), F.length("y")) >= threshold * longest).withColumn("similarity", F.round(1 - F.levenshtein("x", "y") / longest, 6))
    else:
        pairs = pairs.filter(2 * F.least(F.length("x"), F.length("y")) >= threshold * (F.length("x") + F.length("y")))

        def ratio(x: pd.Series, y: pd.Series) -> pd.Series:
            return pd.Series([ratio_at_least(a, b, threshold) for a, b in zip(x, y, strict=True)])

        scored = pairs.withColumn("similarity", F.round(F.pandas_udf(ratio, "double")("x", "y"), 6))
    return scored.filter(F.col("similarity") >= threshold).select("a", "b", "similarity").unionByName(same)


def clusters(pairs: DataFrame) -> DataFrame:
    """(id, cluster): connected components of pairs (a, b); the cluster is its smallest id."""
    nodes = connected_components(pairs, "a", "b")
    least = nodes.groupBy("root").agg(F.min("node").alias("cluster"))
    return nodes.join(least, "root").select(F.col("node").alias("id"), "cluster")


def merge_duplicates(entities: DataFrame, members: DataFrame) -> DataFrame:
    """(id, superseded_by, stale, staleness_reason): of every cluster the oldest survives, then the smallest id."""
    rows = members.join(entities.select("id", "created_s"), "id")
    survivor = rows.groupBy("cluster").agg(F.min(F.struct("created_s", "id"))["id"].alias("survivor"))
    return rows.join(survivor, "cluster").filter("id <> survivor").select("id", F.col("survivor").alias("superseded_by"), F.lit(True).alias("stale"), F.lit("duplicate").alias("staleness_reason"))
