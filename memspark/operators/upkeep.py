"""Tables that are kept up with writes, batch by batch: an inverted index, embeddings and counters in segments.

A batch writes a segment of new rows and a list of what it makes dead in earlier segments; nothing is rewritten. What is
alive is the segments less the dead. Segments that pile up are merged into a new generation. All is idempotent by the
batch's number: a batch that runs again, after a failure at any point, writes the same again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from memspark.functions.checkpoints import cut
from memspark.operators.search import build_index, within_terms


class Segments:
    """Rows by ``key`` (any number for one key) in segments below the shared folder ``path``."""

    def __init__(self, spark: SparkSession, path: str, key: str, most: int = 16):
        """``most``: segments from which on a batch merges those before it."""
        self.spark, self.path, self.key, self.most = spark, path.rstrip("/"), key, most

    def _has(self, path: str) -> bool:
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(folder)

    def _generation(self) -> tuple[int, int]:
        """The current generation and the last batch that went into its first segment; (0, -1) before any merge."""
        if not self._has(f"{self.path}/generations"):
            return 0, -1
        newest = self.spark.read.parquet(f"{self.path}/generations").orderBy(F.col("generation").desc()).head()
        return newest["generation"], newest["upto"]

    def _read(self, kind: str) -> DataFrame | None:
        at = f"{self.path}/g{self._generation()[0]}/{kind}"
        return self.spark.read.parquet(at) if self._has(at) else None

    def _write(self, df: DataFrame, kind: str, segment: int, generation: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.path}/g{generation}/{kind}/segment={segment}")

    def _alive(self, kind: str, before: int | None = None) -> DataFrame | None:
        """Rows of ``kind`` (rows, keys) that no batch, or none before ``before``, has made dead."""
        rows, dead = self._read(kind), self._read("dead")
        if rows is not None and before is not None:
            rows = rows.filter(F.col("segment") < before)
            dead = dead.filter(F.col("segment") < before)
        if rows is None:
            return None
        gone = dead.select(F.col(self.key).alias("_key"), F.col("held").alias("_held"))
        return rows.join(gone, (F.col(self.key) == F.col("_key")) & (F.col("segment") == F.col("_held")), "left_anti")

    def apply(self, number: int, rows: DataFrame, touched: DataFrame, keys: DataFrame | None = None) -> None:
        """Batch ``number`` (rising): ``touched`` has the keys that it inserts, changes or deletes, ``rows`` what they have from
        now on, ``keys`` a row (key, weight) for each key that is there from now on (default: the keys of rows, weight 1).

        Only the keys' table of earlier segments is read, not their rows.
        """
        generation, upto = self._generation()
        if number <= upto:
            return
        touched = touched.select(self.key).distinct()
        keys = (rows.select(self.key).distinct().withColumn("weight", F.lit(1).cast("long")) if keys is None else keys).select(self.key, "weight")
        held = self._alive("keys", number)
        if held is None:
            dead = touched.limit(0).select(self.key, F.lit(0).alias("held"), F.lit(0).cast("long").alias("weight"))
        else:
            dead = held.join(touched, self.key, "left_semi").select(self.key, F.col("segment").alias("held"), "weight")
        self._write(rows, "rows", number, generation)
        self._write(keys, "keys", number, generation)
        self._write(dead, "dead", number, generation)
        added = self.spark.read.parquet(f"{self.path}/g{generation}/keys/segment={number}").agg(F.count("*").alias("n"), F.coalesce(F.sum("weight"), F.lit(0)).alias("total"))
        lost = self.spark.read.parquet(f"{self.path}/g{generation}/dead/segment={number}").agg(F.count("*").alias("n"), F.coalesce(F.sum("weight"), F.lit(0)).alias("total"))
        change = added.unionByName(lost.select((-F.col("n")).alias("n"), (-F.col("total")).alias("total")))
        self._write(change.agg(F.sum("n").alias("n"), F.sum("total").alias("total")).coalesce(1), "sums", number, generation)
        if self._read("sums").count() > self.most:
            self.merge(number)

    def merge(self, upto: int) -> None:
        """One segment of what is alive after batch ``upto``, as a new generation; the one before stays for those who read it."""
        generation, _ = self._generation()
        for kind in ("rows", "keys"):
            self._write(self._alive(kind).drop("segment"), kind, upto, generation + 1)
        self._write(self._read("dead").drop("segment").limit(0), "dead", upto, generation + 1)
        self._write(self.totals(), "sums", upto, generation + 1)
        self.spark.range(1).select(F.lit(upto).alias("upto")).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/generations/generation={generation + 1}")
        old = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/g{generation - 1}")
        old.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(old, True)

    def alive(self, condition: Column | None = None) -> DataFrame:
        """All rows that are alive; a ``condition`` on them goes to the files."""
        rows = self._alive("rows")
        if rows is None:
            raise ValueError(f"no batch has been applied to {self.path}")
        return (rows if condition is None else rows.filter(condition)).drop("segment")

    def totals(self) -> DataFrame:
        """One row: n keys that are alive and the total of their weights, from a row for each segment."""
        return self._read("sums").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))


class KeptIndex:
    """An inverted index (postings of ``fields``) kept up with changes of a table."""

    def __init__(self, spark: SparkSession, path: str, key: str, fields: list[str], stem: Callable | None = None, most: int = 16):
        self.segments, self.key, self.fields, self.stem = Segments(spark, path, key, most), key, fields, stem

    def apply(self, number: int, changes: DataFrame) -> None:
        """``changes``: a row for each key touched, with its fields from now on; ``deleted`` is true where it goes."""
        there = changes.filter(~F.coalesce("deleted", F.lit(False)))
        postings = cut(build_index(there, self.key, self.fields, self.stem).repartitionByRange("term").sortWithinPartitions("term"))
        self.segments.apply(number, postings, changes, postings.filter("lead").select(self.key, F.col("dl").alias("weight")))

    def postings(self, terms: DataFrame) -> DataFrame:
        """Postings of the terms that are alive. Segments are laid out by term, so that few terms read few blocks."""
        return self.segments.alive(within_terms(terms))

    def stats(self) -> DataFrame:
        """n and avgdl, as bm25 takes them."""
        return self.segments.totals().select("n", (F.col("total") / F.col("n")).alias("avgdl"))


class KeptCounts:
    """Counters by key, such as citations, to which every batch adds: a batch's sums are a segment."""

    def __init__(self, spark: SparkSession, path: str, key: str):
        self.spark, self.path, self.key = spark, path.rstrip("/"), key

    def apply(self, number: int, rows: DataFrame) -> None:
        """``rows``: key, n and at_s of what is counted."""
        rows.groupBy(self.key).agg(F.sum("n").alias("n"), F.max("at_s").alias("at_s")).write.mode("overwrite").parquet(f"{self.path}/segment={number}")

    def totals(self) -> DataFrame:
        return self.spark.read.parquet(self.path).groupBy(self.key).agg(F.sum("n").alias("n"), F.max("at_s").alias("at_s"))


def keep_vectors(vectors: Segments, number: int, changes: DataFrame, make: Callable[[DataFrame], DataFrame]) -> None:
    """Embeddings kept up with a batch of changes: ``make`` gives the vectors (with the segments' key) of those that stay."""
    there = changes.filter(~F.coalesce("deleted", F.lit(False)))
    vectors.apply(number, cut(make(there)), changes)
