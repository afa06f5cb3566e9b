"""Exact top-k inner-product search by threshold aggregation without random access.

Every dimension of a block of candidates is a list sorted by value. A query reads the lists in step, from the end that
its weight favours, and adds up what it has read of every vector; what it has not yet read lies between the last value
read and the list's far end, which bounds every score from both sides. A query stops when at most a few candidates can
still be among its best k, and gets their final scores; else it reads on, and at the lists' ends all sums are final. The
best of all blocks are merged per query.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memspark.llm.common import cut

#: Vectors of a candidate block: SPREAD times the square root of their number, between these bounds.
LEAST_BLOCK, MOST_BLOCK, SPREAD = 512, 32768, 4
QUERY_BLOCK = 8192
#: Part of the lists that is read before bounds are looked at first; it doubles from look to look.
FIRST_DEPTH = 1 / 16
#: A query stops when at most FEW times k candidates can still be among its best.
FEW = 4
_QUERIES_AT_ONCE = 128
#: Scores end here; integer components end well below.
_LONG, _LARGEST = (1 << 63) - 1, 1 << 62


def _exact(matrix: np.ndarray, weights: np.ndarray) -> np.dtype:
    """The cheapest type in which all inner products are exact."""
    most = int(np.abs(matrix).max(initial=0)) * int(np.abs(weights).max(initial=0)) * max(1, matrix.shape[1])
    return np.dtype(np.float32 if most < 1 << 22 else np.float64 if most < 1 << 51 else object)


def _kth_largest(values: np.ndarray, k: int) -> np.ndarray:
    n = values.shape[1]
    return np.sort(values, axis=1)[:, n - k] if values.dtype == object else np.partition(values, n - k, axis=1)[:, n - k]


def _first(query: int, rows: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int, read: int) -> list[tuple[int, int, int, int]]:
    order = sorted(range(len(rows)), key=lambda i: (-scores[i], ids[i])) if scores.dtype == object else np.lexsort((ids, -scores))
    return [(int(query), int(ids[i]), int(scores[i]), read) for i in order[:k]]


def best_of_block(queries: np.ndarray, query_rows: np.ndarray, vectors: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int) -> list[tuple[int, int, int, int]]:
    """(query row, vector id, score, entries read per list) of every query's ``k`` best in the block but its own row."""
    kind = _exact(vectors, queries)
    n = len(ids)
    x, weights = vectors.astype(kind), queries.astype(kind)
    lists = np.sort(x, axis=0)[::-1]
    place = np.empty(x.shape, np.int32)  # of every value in its dimension's list
    np.put_along_axis(place, np.argsort(-x, axis=0, kind="stable"), np.broadcast_to(np.arange(n, dtype=np.int32)[:, None], x.shape), axis=0)
    depths = [max(min(n, 2 * k), int(n * FIRST_DEPTH))]
    while depths[-1] < n:
        depths.append(min(n, 2 * depths[-1]))
    out: list[tuple[int, int, int, int]] = []
    for a in range(0, len(queries), _QUERIES_AT_ONCE):
        active = np.arange(a, min(len(queries), a + _QUERIES_AT_ONCE))
        sums = np.zeros((len(active), n), kind)
        before = 0
        for depth in depths:
            if not len(active):
                break
            q = weights[active]
            up, down = np.where(q > 0, q, 0), np.where(q < 0, q, 0)
            from_top, from_bottom = place < depth, place >= n - depth
            sums += up @ np.where(from_top & (place >= before), x, 0).T + down @ np.where(from_bottom & (place < n - before), x, 0).T
            before = depth
            own = query_rows[active][:, None] == rows[None, :]
            if depth == n:
                keep = min(k + 1, n)
                bound = _kth_largest(sums, keep)
                for i, row, edge, mine in zip(active.tolist(), sums, bound, own, strict=True):
                    at = np.flatnonzero((row >= edge) & ~mine)
                    out += _first(query_rows[i], rows[at], ids[at], row[at], k, n)
                break
            # of what is unread, the next value at best and the last one at worst
            best = sums + ((up * lists[depth - 1]) @ (~from_top).T.astype(kind) + (down * lists[n - depth]) @ (~from_bottom).T.astype(kind))
            worst = sums + ((up * lists[-1]) @ (~from_top).T.astype(kind) + (down * lists[0]) @ (~from_bottom).T.astype(kind))
            worst[own] = best[own] = np.inf if kind == object else -np.inf
            if kind == object:
                worst[own] = best[own] = -(1 << 200)
            open_ = best >= _kth_largest(worst, min(k, n))[:, None]
            open_ &= ~own
            done = open_.sum(axis=1) <= FEW * k
            for i in np.flatnonzero(done).tolist():
                at = np.flatnonzero(open_[i])
                out += _first(query_rows[active[i]], rows[at], ids[at], x[at] @ q[i], k, depth)
            active, sums = active[~done], sums[~done]
    return out


def _search(k: int) -> Callable:
    def run(candidates: pa.Table, queries: pa.Table) -> pa.Table:
        found, n = [], candidates.num_rows
        if n and queries.num_rows:
            (q, qr), (c, cr) = ((np.array(t.column("ints").combine_chunks().flatten()).reshape(t.num_rows, -1), t.column("row").to_numpy()) for t in (queries, candidates))
            best = best_of_block(q, qr, c, cr, candidates.column("vec_id").to_numpy(), k)
            found = [(row, vec, max(-_LONG, min(_LONG, score)), depth) for row, vec, score, depth in best]
        cols = list(zip(*found, strict=True)) or [[]] * 4
        table = pa.table({name: pa.array(col, pa.int64()) for name, col in zip(("query_row", "vec_id", "score", "depth"), cols, strict=True)})
        return table.append_column("share", pa.array(np.array(cols[3], float) / max(1, n)))

    return run


def exact_top_k(vectors: DataFrame, asked: Column | str, k: int = 5, scale: int = 256) -> DataFrame:
    """The ``k`` highest integer inner products of every row that meets the condition ``asked``: query_id, rank (from 1),
    vec_id, score, read_share (part of the lists that the query read, in the mean of the blocks with a result).

    ``vectors`` needs vec_id and embedding; other columns are ignored. Components become floor(scale * x). Vectors that
    are null or empty or hold null or non-finite components take no part, nor do those with a component of 2**62 or more
    after scaling, which no long holds, nor rows without vec_id. Scores beyond a long's range count as its end. Vectors of another
    dimension than the query's are no candidates, nor is the query's own row. Ties go to the smaller vec_id. Fewer
    candidates give fewer rows, none gives none. Rows that repeat a vec_id are queries and candidates of their own.
    """
    fine = F.col("embedding").isNotNull() & F.col("vec_id").isNotNull() & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    fine = fine & F.forall("embedding", lambda x: F.abs(F.lit(float(scale)) * x.cast("double")) < float(_LARGEST))
    ints = F.transform("embedding", lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long"))
    asked = F.expr(asked) if isinstance(asked, str) else asked
    base = vectors.filter(fine).select(F.col("vec_id").cast("long").alias("vec_id"), ints.alias("ints"), F.coalesce(asked, F.lit(False)).alias("asks"), F.monotonically_increasing_id().alias("row"))
    base = cut(base.withColumn("dims", F.size("ints")).filter("dims > 0"))
    n, m = base.agg(F.count("*"), F.count_if("asks")).head()
    size = min(MOST_BLOCK, max(LEAST_BLOCK, int(SPREAD * n**0.5)))
    blocks, parts = max(1, -(-n // size)), max(1, -(-m // QUERY_BLOCK))
    every = lambda count: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(count - 1).cast("long")))
    dealt = lambda count: F.pmod(F.xxhash64("row"), F.lit(count))
    left = base.select("vec_id", "row", "ints", "dims", dealt(blocks).alias("block"), every(parts).alias("part"))
    questions = cut(base.filter("asks").select("row", "vec_id", "ints", "dims"))
    fresh = [F.col(c).alias(c) for c in ("row", "ints", "dims")]  # columns of their own, as both sides come from one table
    right = questions.select(*fresh, every(blocks).alias("block"), dealt(parts).alias("part"))
    keys = ["dims", "block", "part"]
    best = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_search(k), "query_row long, vec_id long, score long, depth long, share double")
    order = Window.partitionBy("query_row").orderBy(F.col("score").desc(), "vec_id")
    best = best.withColumn("read_share", F.avg("share").over(Window.partitionBy("query_row"))).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    names = questions.select(F.col("row").alias("query_row"), F.col("vec_id").alias("query_id"))
    return best.join(names, "query_row").select("query_id", "rank", "vec_id", "score", "read_share")
