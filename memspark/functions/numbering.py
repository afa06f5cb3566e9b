"""Numbers of rows within groups, without a task that holds a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memspark.functions.checkpoints import cut


def numbered(df: DataFrame, by: list[str], order: list[str | Column], name: str = "number") -> DataFrame:
    """``df`` with ``name``: the place, from 1, of every row within its group ``by`` in ``order``, as row_number would give it.

    Rows are dealt out by ranges of (group, order), so that a large group takes many tasks. A task numbers its rows; those of
    a group that began in an earlier range add what lies there, a count for each range but the group's first. Null group
    values form groups of their own; rows equal in ``order`` are numbered in any order.
    """
    spread = cut(df.repartitionByRange(*by, *order, F.monotonically_increasing_id()).withColumn("_range", F.spark_partition_id()))
    counts = spread.groupBy("_range", *by).agg(F.count("*").alias("_n"))
    ahead = F.sum("_n").over(Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))  # a row for each range of a group
    ahead = cut(counts.select("_range", *by, ahead.alias("_ahead")).filter("_ahead > 0").toDF("_at", *[f"_of_{c}" for c in by], "_ahead"))
    own = F.row_number().over(Window.partitionBy("_range", *by).orderBy(*order))
    same = [F.col("_range") == F.col("_at"), *[F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in by]]
    # at most one group of a range began before it, so ``ahead`` has fewer rows than there are ranges
    out = spread.withColumn("_own", own).join(F.broadcast(ahead), same, "left")
    return out.select(*df.columns, (F.col("_own") + F.coalesce("_ahead", F.lit(0))).alias(name))
