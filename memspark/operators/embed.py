"""Embedding pipeline; the caller gives the function that makes vectors of texts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memspark.operators.search import VECTORS
from memspark.sources.tables import upsert_latest

TEXT_LIMIT = 2000


def embedding_text(fields: list[str], prefix: str = "", limit: int = TEXT_LIMIT) -> Column:
    """Trimmed fields that are not empty, a line each, cut to the limit, behind the document prefix."""
    parts = [F.nullif(F.trim(F.coalesce(F.col(f), F.lit(""))), F.lit("")) for f in fields]
    return F.concat(F.lit(prefix), F.substring(F.concat_ws("\n", *parts), 1, limit))


def model_key(model: str, prefix: str) -> str:
    return f"{model}|{prefix}"


def check_vectors(vectors: list, n: int) -> int:
    """Raise unless there are n non-empty numeric vectors of one dimension; returns it."""
    if len(vectors) != n:
        raise ValueError(f"{len(vectors)} vectors for {n} texts")
    dims = {len(v) for v in vectors}
    if len(dims) > 1 or 0 in dims:
        raise ValueError(f"vectors of dimensions {sorted(dims)}")
    if any(not isinstance(x, (int, float)) or isinstance(x, bool) for v in vectors for x in v):
        raise ValueError("a vector holds something other than numbers")
    return dims.pop() if dims else 0


def embed(df: DataFrame, key: str, text: str, make: Callable[[list[str]], list[list[float]]], model: str, batch: int = 32) -> DataFrame:
    """(key, model, dim, vector) of every row, in batches of ``batch`` texts; a faulty batch raises and its task is retried."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), batch):
                part = frame.iloc[at : at + batch]
                vectors = [list(v) for v in make(list(part[text]))]
                dim = check_vectors(vectors, len(part))
                yield pd.DataFrame({key: part[key].to_numpy(), "model": model, "dim": dim, "vector": vectors})

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text).mapInPandas(run, f"{key} {kind}, model string, dim int, vector array<double>")


def missing_embeddings(entities: DataFrame, vectors: DataFrame, model: str) -> DataFrame:
    """Live entities without a vector of the model."""
    have = vectors.filter(F.col("model") == model).select(F.col("entity_id").alias("id"))
    return entities.filter("not archived and not stale").join(have, "id", "left_anti")


def backfill(entities: DataFrame, vectors: DataFrame, fields: list[str], make: Callable, model: str, prefix: str = "", limit: int | None = None) -> DataFrame:
    """``vectors`` with those of entities that lacked one, the newest first; running it again goes on with the rest."""
    key = model_key(model, prefix)
    todo = missing_embeddings(entities, vectors, key)
    todo = todo.orderBy(F.col("updated_s").desc(), "id").limit(limit) if limit else todo
    fresh = embed(todo.select(F.col("id").alias("entity_id"), embedding_text(fields, prefix).alias("text")), "entity_id", "text", make, key)
    base = vectors.select("entity_id", "model", "dim", "vector", F.lit(0).alias("version"))
    return upsert_latest(base, fresh.withColumn("version", F.lit(1)), ["entity_id", "model"], "version").drop("version")


def coverage(entities: DataFrame, vectors: DataFrame) -> DataFrame:
    """Per project: entities, those with any vector, and whether there is one."""
    have = vectors.select(F.col("entity_id").alias("id")).distinct().withColumn("has", F.lit(1))
    out = entities.join(have, "id", "left").groupBy("project_id").agg(F.count("*").alias("entities"), F.count("has").alias("embedded"))
    return out.withColumn("any_embedded", F.col("embedded") > 0)


def block_cosine(asked: DataFrame, vectors: DataFrame, block: list[str], tiles: int | None = None, floor: float = -1.0) -> DataFrame:
    """Cosine of every vector of ``asked`` with every other one of its block in ``vectors``, from ``floor`` on: block, left_id, right_id, similarity.

    Both have id, the columns of ``block`` and vector. Vectors are dealt to tiles, as many as their number needs, and the
    asked ones to all tiles of their block, so that the cosines of a tile are one matrix product however large a block is.
    A norm of zero, and vectors of another length, have similarity 0.
    """
    tiles = tiles or max(1, -(-vectors.count() // VECTORS))
    right = vectors.select(*[F.col(c).alias(c) for c in block], F.size("vector").alias("_dims"), F.pmod(F.xxhash64("id"), F.lit(tiles)).alias("_tile"), F.col("id").alias("right_id"), F.col("vector").cast("array<double>").alias("vector"))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(tiles - 1).cast("long")))
    sizes = vectors.select(*block, F.size("vector").alias("_dims")).distinct().toDF(*[f"_{c}" for c in block], "_dims")  # an asked vector meets those of other lengths as well
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in block]
    left = asked.select(*block, F.col("id").alias("left_id"), F.col("vector").cast("array<double>").alias("vector")).join(sizes, same).select(*block, "left_id", "vector", "_dims", every.alias("_tile"))
    keys = [*block, "_dims", "_tile"]
    kinds = {f.name: f.dataType.simpleString() for f in vectors.schema}
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in block) + f", left_id {kinds['id']}, right_id {kinds['id']}, similarity double"
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_products(block, floor), schema)


def _products(block: list[str], floor: float) -> Callable:
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        dims = len(right.column("vector")[0]) if right.num_rows else 0
        x = np.asarray(right.column("vector").combine_chunks().flatten()).reshape(right.num_rows, dims)
        norms, found = np.linalg.norm(x, axis=1), []
        for a in range(0, left.num_rows, 256):
            part = left.slice(a, 256)
            q = np.array([v if len(v) == dims else [0.0] * dims for v in part.column("vector").to_pylist()], np.float64).reshape(part.num_rows, dims)
            size = np.linalg.norm(q, axis=1)[:, None] * norms[None, :]
            near = np.round(np.divide(q @ x.T, size, out=np.zeros_like(size), where=size > 0), 6)
            i, j = (pa.array(v) for v in np.nonzero(near >= floor))
            table = pa.table({**{c: part.column(c).take(i) for c in block}, "left_id": part.column("left_id").take(i), "right_id": right.column("right_id").take(j), "similarity": near[near >= floor]})
            found.append(table.filter(pc.not_equal(table["left_id"], table["right_id"])))
        empty = pa.table({**{c: right.column(c).slice(0, 0) for c in block}, "left_id": left.column("left_id").slice(0, 0), "right_id": right.column("right_id").slice(0, 0), "similarity": pa.array([], pa.float64())})
        return pa.concat_tables([empty, *found])

    return run
