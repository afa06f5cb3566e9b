"""Benchmark decontamination by winnowing.

Of every run of ``window`` words the least hash of its ``kgram``-word runs is kept, on both sides by the same rule, so a run
that a document shares with the benchmark carries the same fingerprint at the same place. Repeated choices fall together,
which thins the fingerprints. They are joined, and each hit is extended word by word to both sides as far as a run of
``window`` words around the fingerprint reaches; it counts if that makes ``window`` equal words. So every shared run is found.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memspark.llm.common import NOT_ALNUM, bit_filter, cut, fold_table, in_filter, mix, packed, pieces, prefix_hash, range_hash, text_key, unpacked, word_bounds

WINDOW = 13
KGRAM = 8
#: The filter that is sent to the tasks has at most this many bits (1 MB), whatever the benchmark's size.
FILTER_BITS = 23
_MARK = "struct<pos:int,kind:int,print:bigint,core:string,left:array<string>,right:array<string>>"


def _gram_hash(words: np.ndarray, length: int) -> np.ndarray:
    """Order-dependent hash of every run of ``length`` word hashes."""
    n = len(words) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(length):
        out = out * np.uint64(0xD6E8FEB86659FD93) + words[j : j + n]
    return mix(out + np.uint64(length))


def winnow(words: np.ndarray, of_row: np.ndarray, window: int, kgram: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the least k-gram, the leftmost of equal ones, of every run of ``window`` words of a row."""
    grams, n = _gram_hash(words, kgram), len(words) - window + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    best, place = grams[:n].copy(), np.arange(n)
    for j in range(1, window - kgram + 1):
        lower = grams[j : j + n] < best
        best[lower] = grams[j : j + n][lower]
        place[lower] = np.flatnonzero(lower) + j
    at = np.unique(place[of_row[:n] == of_row[window - 1 :]])
    return at, grams[at]


def _marks(column: pa.Array, window: int, kgram: int, short: list[int] | None, keep: np.ndarray | None) -> Iterator[tuple[int, int, list[dict]]]:
    """For each row its number, its number of words and its fingerprints with the words around them.

    A mark's kind is 0 for a winnowed k-gram, else the number of words of a whole short item. ``short``: lengths below
    ``window`` to look for; None: a row of fewer words is one run itself. ``keep``: bit filter of fingerprints.
    """
    lower, is_word = fold_table(NOT_ALNUM)
    for row, data, offsets in pieces(column):
        folded = lower[data]
        starts, ends, first = word_bounds(is_word[data], offsets)
        words = range_hash(prefix_hash(folded), starts, ends)
        counts = np.diff(first)
        of_row = np.repeat(np.arange(len(counts)), counts)
        found: list[list[dict]] = [[] for _ in range(len(counts))]

        def add(at: np.ndarray, prints: np.ndarray, kind: int, reach: int) -> None:
            if keep is not None:
                use = in_filter(prints, keep, FILTER_BITS)
                at, prints = at[use], prints[use]
            size = kind or kgram
            for s, value in zip(at.tolist(), prints.view(np.int64).tolist(), strict=True):
                d = int(of_row[s])
                low, high = max(int(first[d]), s - reach), min(int(first[d + 1]), s + size + reach)
                around = [folded[starts[j] : ends[j]].tobytes().decode() for j in range(low, high)]
                x = s - low
                found[d].append({"pos": s - int(first[d]), "kind": kind, "print": value, "core": " ".join(around[x : x + size]), "left": around[:x][::-1], "right": around[x + size :]})

        add(*winnow(words, of_row, window, kgram), 0, window - kgram)
        for length in sorted(set(counts[(counts > 0) & (counts < window)].tolist())) if short is None else short:
            prints = _gram_hash(words, length)
            inside = np.flatnonzero(of_row[: len(prints)] == of_row[length - 1 :]) if len(prints) else np.zeros(0, np.int64)
            if short is None:
                inside = inside[counts[of_row[inside]] == length]
            add(inside, prints[inside], length, 0)
        for d, marks in enumerate(found):
            yield row + d, int(counts[d]), marks


_KIND = pa.struct([("pos", pa.int32()), ("kind", pa.int32()), ("print", pa.int64()), ("core", pa.string()), ("left", pa.list_(pa.string())), ("right", pa.list_(pa.string()))])


def _benchmark_marks(window: int, kgram: int) -> Callable:
    """Marks of the items; ``context`` names a mark's words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            take, names, marks = [], [], []
            for row, _, found in _marks(b.column(1), window, kgram, None, None):
                for m in found:
                    take.append(row)
                    marks.append(m)
                    names.append(hashlib.md5("\n".join([str(m["kind"]), m["core"], " ".join(m["left"]), " ".join(m["right"])]).encode()).digest())
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(take, pa.int64())), pa.array(names, pa.binary()), pa.array(marks, _KIND)], names=["item", "context", "mark"])

    return run


def _document_marks(window: int, kgram: int, short: list[int], keep) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts, found = [], []
            for _, n, marks in _marks(b.column(1), window, kgram, short, keep.value):
                counts.append(n)
                found.append(marks)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts, pa.int64()), pa.array(found, pa.list_(_KIND))], names=["doc", "n_words", "marks"])

    return run


def _merged(found: pd.Series) -> pd.Series:
    """Sorted word ranges, overlapping and touching ones united."""
    out = []
    for spans in found:
        own: list[dict] = []
        for start, stop in sorted((s["start"], s["stop"]) for s in spans):
            if own and start <= own[-1]["stop"]:
                own[-1]["stop"] = max(own[-1]["stop"], stop)
            else:
                own.append({"start": start, "stop": stop})
        out.append(own)
    return pd.Series(out)


def _equal_words(a: str, b: str, most: int) -> Column:
    """How many words of two columns agree before the first that differ."""
    total, so_far = F.lit(0), F.lit(True)
    for i in range(most):
        so_far = so_far & F.coalesce(F.get(a, F.lit(i)) == F.get(b, F.lit(i)), F.lit(False))
        total = total + so_far.cast("int")
    return total


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, kgram: int = KGRAM) -> DataFrame:
    """Words of every document that stand in a run shared with the benchmark.

    ``docs`` needs doc_id and text, ``benchmark`` item_id and text; other columns are ignored. One row per document row:
    doc (a struct of a row's number and doc_id), n_words, n_hit, spans (merged hit word ranges, end exclusive),
    items (sorted as strings, distinct), n_items (items without item_id count as one).
    Null texts and texts without words have no words and no hits. A benchmark item shorter than ``window`` words is one
    run. Rows that repeat a doc_id with the same text give as many equal rows. An empty benchmark gives no hits.
    """
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("string").alias("text"))
    items = cut(items.mapInArrow(_benchmark_marks(window, kgram), f"item string, context binary, mark {_MARK}"))
    short = sorted(r.kind for r in items.select("mark.kind").filter("kind > 0").distinct().collect())
    sent = docs.sparkSession.sparkContext.broadcast(bit_filter(items.select(F.col("mark.print").alias("h1")), FILTER_BITS))
    base = docs.select(F.struct(F.monotonically_increasing_id().alias("row"), F.col("doc_id")).alias("doc"), F.col("text").cast("string").alias("text"))
    kind = base.schema["doc"].dataType.simpleString()
    base = cut(base.mapInArrow(_document_marks(window, kgram, short, sent), f"doc {kind}, n_words long, marks array<{_MARK}>"))
    rows = base.filter(F.size("marks") > 0).select("doc.row", F.explode("marks").alias("m")).select("row", "m.*")
    known = items.dropDuplicates(["context"]).select("context", "mark.kind", "mark.print", "mark.core", F.col("mark.left").alias("before"), F.col("mark.right").alias("after"))
    hits = rows.join(known, ["kind", "print", "core"])
    size = F.when(F.col("kind") > 0, F.col("kind")).otherwise(F.lit(kgram))
    hits = hits.select("row", "context", "kind", "pos", size.alias("size"), _equal_words("left", "before", window - kgram).alias("l"), _equal_words("right", "after", window - kgram).alias("r"))
    hits = cut(hits.filter(f"kind > 0 or l + size + r >= {window}").select("row", "context", (F.col("pos") - F.col("l")).alias("start"), (F.col("pos") + F.col("size") + F.col("r")).alias("stop")))
    spans = hits.select("row", "start", "stop").distinct().groupBy("row").agg(F.collect_list(F.struct("start", "stop")).alias("found"))
    spans = spans.select("row", F.pandas_udf(_merged, "array<struct<start:int,stop:int>>")("found").alias("spans"))
    named = hits.select("row", "context").distinct().join(items.select("context", "item").distinct(), "context")
    named = named.groupBy("row").agg(F.collect_set(F.struct("item")).alias("named"))
    out = base.select("doc", "doc.row", "n_words").join(spans, "row", "left").join(named, "row", "left")
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, x: acc + x["stop"] - x["start"])
    items_ = F.array_sort(F.array_compact(F.transform("named", lambda x: x["item"])))
    return out.select(
        "doc", "n_words", F.coalesce(n_hit, F.lit(0).cast("long")).alias("n_hit"), F.coalesce("spans", F.expr("cast(array() as array<struct<start:int,stop:int>>)")).alias("spans"),
        F.coalesce(items_, F.expr("cast(array() as array<string>)")).alias("items"), F.greatest(F.size("named"), F.lit(0)).cast("long").alias("n_items"),
    )


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, kgram: int = KGRAM) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated (a twentieth of the words is hit), spans, items."""
    hits = benchmark_hits(docs, benchmark, window, kgram)
    return hits.select(
        F.col("doc.doc_id").alias("doc_id"), "n_words", "n_hit", "n_items",
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"), "spans", "items",
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, kgram: int = KGRAM) -> DataFrame:
    """The rows of ``docs`` that ``contamination`` calls clean, whole and with all their columns.

    A twentieth of a document's words must be hit. Rows that share doc_id and text are judged alike.
    """
    hits = benchmark_hits(docs.select(F.struct("doc_id", text_key("text").alias("key")).alias("doc_id"), "text"), benchmark, window, kgram)
    bad = hits.filter("n_hit > 0 and 20 * n_hit >= n_words").select(F.col("doc.doc_id.doc_id").alias("_doc"), F.col("doc.doc_id.key").alias("_of")).distinct()
    whole = packed(docs)
    return whole.join(bad, whole["_id"].eqNullSafe(bad["_doc"]) & (whole["_key"] == bad["_of"]), "left_anti").select(*unpacked(docs, {}))
