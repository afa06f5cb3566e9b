"""Quality by importance resampling: the ratio of two hashed n-gram models, sampled by Gumbel top-k.

The raw model counts hashed words and word pairs of all documents, the target model those of labelled good ones. A
document's weight is the product of the ratios over its n-grams; adding Gumbel noise to its logarithm and keeping the
largest values draws documents without replacement in proportion to their weights.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memspark.llm.common import NOT_ALNUM, cut, fold_table, mix, pieces, prefix_hash, range_hash, word_bounds

BUCKETS = 1 << 15
#: At most so many labelled rows of good quality make the target model (a documented bound; the raw model has all rows).
TARGET_ROWS = 20_000
KEEP = 0.8
SMOOTHING = 1.0
_FIXED_POINT = 1 << 20


def _ngrams(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """First row, bucket of every n-gram and its row within the piece."""
    _, is_word = fold_table(NOT_ALNUM)
    lower = fold_table(NOT_ALNUM)[0]
    for row, data, offsets in pieces(column):
        starts, ends, first = word_bounds(is_word[data], offsets)
        words = range_hash(prefix_hash(lower[data]), starts, ends)
        of = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
        near = np.flatnonzero(of[1:] == of[:-1])
        two = mix(words[near] * np.uint64(0xD6E8FEB86659FD93) + words[near + 1])
        grams = np.concatenate([words, two]) % np.uint64(BUCKETS)
        yield row, grams.astype(np.int64), np.concatenate([of, of[near]])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for b in batches:
        good = b.column(0).to_numpy(zero_copy_only=False).astype(bool)
        for row, grams, of in _ngrams(b.column(1)):
            raw += np.bincount(grams, minlength=BUCKETS)
            target += np.bincount(grams[good[row + of]], minlength=BUCKETS)
    at = np.flatnonzero(raw)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(raw[at]), pa.array(target[at])], names=["bucket", "raw", "target"])


def _score(model) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = model.value
        for b in batches:
            total, n = np.zeros(b.num_rows), np.zeros(b.num_rows, np.int64)
            for row, grams, of in _ngrams(b.column(1)):
                size = int(of.max(initial=-1)) + 1
                total[row : row + size] += np.bincount(of, weights[grams], minlength=size)
                n[row : row + size] += np.bincount(of, minlength=size)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(total), pa.array(n)], names=["doc", "log_ratio", "n_grams"])

    return run


def target_rows(labels: DataFrame, most: int = TARGET_ROWS) -> DataFrame:
    """doc_id of at most ``most`` labelled rows of good quality, held-out rows (crc32 of doc_id, modulo 5, is 0) left out."""
    good = labels.filter("quality = 1 and doc_id is not null").filter(F.crc32(F.col("doc_id").cast("string")) % 5 != 0).select("doc_id").distinct()
    return good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def log_ratio_model(docs: DataFrame, targets: DataFrame) -> np.ndarray:
    """Logarithm of target over raw probability of every bucket; ``targets`` is bounded and is sent to the tasks."""
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    marked = texts.join(F.broadcast(targets.withColumn("good", F.lit(True))), "doc_id", "left").select(F.coalesce("good", F.lit(False)).alias("good"), "text")
    sums = marked.mapInArrow(_count, "bucket int, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for r in sums.collect():
        raw[r.bucket], target[r.bucket] = r.raw, r.target
    smooth = lambda x: (x + SMOOTHING) / (x.sum() + SMOOTHING * BUCKETS)
    return np.log(smooth(target) / smooth(raw))


def kth_largest(values: DataFrame, column: str, k: int) -> int:
    """The k-th largest value of an integer column: counts by 12 bits at a time, from the top, narrow it down."""
    low, high = values.agg(F.min(column), F.max(column)).head()
    while low < high:
        width = max(1, -(-(high - low + 1) // 4096))
        part = values.filter(F.col(column).between(low, high)).groupBy(F.expr(f"({column} - {low}) div {width}").alias("bin")).count().collect()
        for r in sorted(part, key=lambda r: -r.bin):
            if k <= r["count"]:
                low, high = low + r.bin * width, min(high, low + (r.bin + 1) * width - 1)
                break
            k -= r["count"]
    return low


def importance_resample(docs: DataFrame, labels: DataFrame, keep: float = KEEP, seed: int = 0) -> DataFrame:
    """Per document row: doc_id, log_ratio (of the document), score (mean per n-gram), key (with Gumbel noise), selected.

    ``docs`` needs doc_id and text, ``labels`` doc_id and quality; other columns are ignored. ceil(keep * rows) rows with the
    largest keys are selected; equal keys go by a hash of doc_id, and rows equal in that too go together. The noise is
    a function of seed and doc_id, so reruns agree. Null texts and texts without words have log_ratio and score 0.
    Without labelled good rows every ratio is that of an empty target. An empty table gives no rows.
    """
    model = docs.sparkSession.sparkContext.broadcast(log_ratio_model(docs, target_rows(labels)))
    kind = docs.schema["doc_id"].dataType.simpleString()
    base = docs.select("doc_id", F.col("text").cast("string")).mapInArrow(_score(model), f"doc_id {kind}, log_ratio double, n_grams long")
    chance = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 11) + 0.5) / float(1 << 53)
    base = base.withColumn("key", F.round(F.col("log_ratio") - F.log(-F.log(chance)), 6))
    base = cut(base.withColumn("_fixed", F.round(F.greatest(F.lit(-1e12), F.least(F.lit(1e12), "key")) * _FIXED_POINT).cast("long")).withColumn("_tie", F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(seed)), 1)))
    rows = base.count()
    if rows:
        k = min(rows, int(np.ceil(keep * rows)))
        edge = kth_largest(base, "_fixed", k)
        above = base.filter(F.col("_fixed") > edge).count()
        tie = kth_largest(base.filter(F.col("_fixed") == edge), "_tie", k - above)
        chosen = (F.col("_fixed") > edge) | ((F.col("_fixed") == edge) & (F.col("_tie") >= tie))
    else:
        chosen = F.lit(False)
    score = F.when(F.col("n_grams") > 0, F.col("log_ratio") / F.col("n_grams")).otherwise(F.lit(0.0))
    return base.select("doc_id", "log_ratio", score.alias("score"), "key", chosen.alias("selected"))
