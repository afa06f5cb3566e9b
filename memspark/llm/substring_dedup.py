"""Substring dedup by sliding sentence spans.

From every sentence a span runs over as few sentences (two at least) as hold ``least_words`` words, and to every sentence
one runs likewise from before. So each repeated run of that many words is covered whole, whatever stands around it. Spans
are hashed and joined over the whole table; sentences covered by a repeated span that is not its first copy are removed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from memspark.llm.common import SPACES, bit_filter, cut, fold_table, in_filter, mix, packed, pieces, powers, prefix_hash, range_hash, text_key, unpacked, word_bounds

LEAST_WORDS = 20
LEAST_SENTENCES = 2
#: Bits of the filter that tells a second reading which hashes may repeat: 2 MB, whatever the input.
FILTER_BITS = 24
_, _IS_WORD = fold_table(SPACES)
_IS_END = np.isin(np.arange(256), list(b".!?"))


@dataclass
class Sentences:
    """Sentences of some rows: the parts into which the rows are cut, and of each part with words its row, number and hash."""

    edges: np.ndarray
    part: np.ndarray
    row: np.ndarray
    number: np.ndarray
    words: np.ndarray
    hashed: np.ndarray


def _boundaries(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where rows are cut: after the space that follows an end mark, and after line feeds."""
    space = ~_IS_WORD[data]
    feed = data == 10
    heads = np.zeros(len(data) + 1, bool)
    heads[offsets] = True
    begins = space.copy()
    begins[1:] &= ~space[:-1] | heads[1:-1]
    run = np.cumsum(begins) - 1
    at = np.flatnonzero(begins)
    marked = np.zeros(len(at), bool)
    inner = (at > 0) & ~heads[at]
    marked[inner] = _IS_END[data[at[inner] - 1]]
    ends = np.append(~space[1:], True) | heads[1:]
    feed_ends = np.append(~feed[1:], True) | heads[1:]
    after = np.zeros(len(data), bool)
    after[space] = marked[run[space]]
    return np.flatnonzero((after & space & ends) | (feed & ~after & feed_ends)) + 1


def sentences(data: np.ndarray, offsets: np.ndarray) -> Sentences:
    """The sentences of the rows in a piece; a row's parts joined give the row."""
    edges = np.unique(np.concatenate([offsets, _boundaries(data, offsets)])) if len(data) else offsets[:1]
    starts, ends, _ = word_bounds(_IS_WORD[data], offsets)
    first = np.searchsorted(starts, edges)
    part = np.flatnonzero(np.diff(first) > 0)
    row = np.searchsorted(offsets, edges[part], "right") - 1
    begin, stop = starts[first[part]], ends[first[part + 1] - 1] if len(part) else np.zeros(0, np.int64)
    hashed = range_hash(prefix_hash(data), begin, stop)
    number = part - np.searchsorted(edges, offsets[row])
    return Sentences(edges, part, row, number, np.diff(first)[part], mix(hashed + (stop - begin).astype(np.uint64)))


def spans(s: Sentences, least_words: int = LEAST_WORDS, least: int = LEAST_SENTENCES) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First and last sentence of every span, and two hashes of it."""
    m = len(s.row)
    if m < least:
        none = np.zeros(0, np.int64)
        return none, none, none.view(np.uint64), none.view(np.uint64)
    total = np.concatenate([[0], np.cumsum(s.words)])
    every = np.arange(m)
    onward = np.maximum(every + least - 1, np.searchsorted(total, total[:-1] + least_words) - 1)
    back = np.minimum(every - least + 1, np.searchsorted(total, total[1:] - least_words, "right") - 1)
    fits, reaches = onward < m, back >= 0
    first, last = np.concatenate([every[fits], back[reaches]]), np.concatenate([onward[fits], every[reaches]])
    same = s.row[first] == s.row[last]
    both = np.unique(first[same] * m + last[same])
    first, last = both // m, both % m
    up, down = powers(m + 1)
    hashes = []
    for salt in (0, 0x51ED270B):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(s.hashed + np.uint64(salt)) * up[:m])])
        hashes.append(mix((sums[last + 1] - sums[first]) * down[first] + (last - first).astype(np.uint64)))
    return first, last, hashes[0], hashes[1]


def _hashes(least_words: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, data, offsets in pieces(b.column(0)):
                yield pa.RecordBatch.from_arrays([pa.array(spans(sentences(data, offsets), least_words)[2].view(np.int64))], names=["h1"])

    return run


def _candidates(least_words: int, keep) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = keep.value
        for b in batches:
            for row, data, offsets in pieces(b.column(2)):
                s = sentences(data, offsets)
                first, last, h1, h2 = spans(s, least_words)
                use = in_filter(h1, bits, FILTER_BITS)
                first, last, h1, h2 = first[use], last[use], h1[use], h2[use]
                take = pa.array(row + s.row[first])
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(take), b.column(1).take(take), pa.array(s.number[first].astype(np.int32)), pa.array(s.number[last].astype(np.int32)), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64))],
                    names=["doc_id", "key", "first", "last", "h1", "h2"],
                )

    return run


def repeated_sentences(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """Per document with any: doc_id, key (hash of its text) and the sorted numbers of the parts to remove."""
    text = docs.select(F.col("text").cast("string"))
    twice = cut(text.mapInArrow(_hashes(least_words), "h1 long").groupBy("h1").count().filter("count > 1").select("h1"))
    sent = docs.sparkSession.sparkContext.broadcast(bit_filter(twice, FILTER_BITS))
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", text_key("text").alias("key"), F.col("text").cast("string").alias("text"))
    rows = cut(rows.mapInArrow(_candidates(least_words, sent), f"doc_id {kind}, key long, first int, last int, h1 long, h2 long"))
    place = F.struct("doc_id", "key", "first")
    copies = rows.groupBy("h1", "h2").agg(F.min(place).alias("origin"), F.max(place).alias("end")).filter("origin <> end").select("h1", "h2", "origin")
    copies = cut(copies)  # a plain side lets Spark split the join where one span occurs very often
    later = rows.join(copies, ["h1", "h2"]).filter((F.struct("doc_id", "key", "first") != F.col("origin")))
    return later.groupBy("doc_id", "key").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.sequence("first", "last"))))).alias("gone"))


_OUTCOME = ("n_sentences", "n_removed", "n_spans")


def _without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of (row, text, gone) in; row, text without the parts ``gone``, and the counts out."""
    for b in batches:
        text, counts = b.column(1).to_pylist(), np.zeros((b.num_rows, 3), np.int64)
        for row, data, offsets in pieces(b.column(1)):
            s = sentences(data, offsets)
            bounds = np.searchsorted(s.row, np.arange(len(offsets)))
            counts[row : row + len(offsets) - 1, 0] = np.diff(bounds)
            heads = np.searchsorted(s.edges, offsets)
            for i in range(len(offsets) - 1):
                gone = b.column(2)[row + i].as_py()
                if not gone:
                    continue
                edges = s.edges[heads[i] : heads[i + 1] + 1]
                drop = np.zeros(len(edges) - 1, bool)
                drop[gone] = True
                text[row + i] = b"".join(data[x:y].tobytes() for x, y in zip(edges[:-1][~drop].tolist(), edges[1:][~drop].tolist(), strict=True)).decode()
                cuts = drop[s.number[bounds[i] : bounds[i + 1]]]
                counts[row + i, 1:] = cuts.sum(), (np.diff(np.concatenate([[0], cuts.astype(np.int8)])) == 1).sum()
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(text, pa.string()), *(pa.array(c) for c in counts.T)], names=["row", "text", *_OUTCOME])


def substring_dedup(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """``docs`` with repeated sentence spans cut out of text: its columns, then n_sentences, n_removed and n_spans
    (runs of removed sentences).

    ``docs`` needs doc_id and text. The first copy of a span, by doc_id (null first) then hash of the text then place,
    stays. Texts of fewer than two sentences or ``least_words`` words have no span; null texts stay null. Rows that
    repeat a doc_id with the same text count as one document and stay alike. An empty table gives no rows.
    """
    gone = cut(repeated_sentences(docs, least_words).select(F.col("doc_id").alias("_doc"), F.col("key").alias("_of"), F.col("gone").alias("_gone")))
    others = [F.col(f"_in.`{c}`").alias(c) for c in docs.columns if c != "text"]  # the text goes alone, not twice
    whole = packed(docs).select("_id", "_key", F.struct(*others).alias("row"), "_text")
    out = whole.join(gone, whole["_id"].eqNullSafe(gone["_doc"]) & (whole["_key"] == gone["_of"]), "left").select("row", "_text", "_gone")
    kinds = {"row": out.schema["row"].dataType, "text": StringType()} | {c: LongType() for c in _OUTCOME}
    out = out.mapInArrow(_without, StructType([StructField(c, t) for c, t in kinds.items()]))
    return out.withColumnRenamed("row", "_in").select(*unpacked(docs, {c: F.col(c) for c in ("text", *_OUTCOME)}))
