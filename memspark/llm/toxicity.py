"""Toxic spans by a linear-chain conditional random field.

Tokens are labelled from labelled documents: a word that stands in toxic documents far more often than in others is a
toxic token there. The field learns from these sequences; the marginals that forward and backward passes give for every
token of a text are gathered to a document score, and runs of toxic tokens are the offending offsets.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructField, StructType

from memspark.llm.common import NOT_ALNUM, cut, fold_table, packed, pieces, prefix_hash, range_hash, ranges, text_key, unpacked, word_bounds

#: Buckets of hashed words; at most so many labelled rows of each class to learn from, of at most so many bytes each, are
#: gathered on the driver (documented bounds: every row is scored whole, whatever its length).
BUCKETS = 1 << 17
TRAIN_ROWS = 1000
TRAIN_BYTES = 1 << 17
_SEGMENT = 64
_EPOCHS = 25


@dataclass
class Field:
    """Weights of a word's own, previous and next bucket for the toxic state, transitions, and the document model."""

    own: np.ndarray
    before: np.ndarray
    after: np.ndarray
    bias: float
    step: np.ndarray
    document: np.ndarray

    def potentials(self, words: np.ndarray, first: np.ndarray) -> np.ndarray:
        e = self.own[words] + self.bias
        if len(words) > 1:
            inner = np.ones(len(words), bool)
            inner[first[:-1][first[:-1] < len(words)]] = False
            e[1:] += np.where(inner[1:], self.before[words[:-1]], 0)
            e[:-1] += np.where(inner[1:], self.after[words[1:]], 0)
        return np.clip(e, -30, 30)


def _normal(a: np.ndarray) -> np.ndarray:
    return a / a.sum(axis=-1, keepdims=True)


def marginals(e: np.ndarray, first: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probability of the toxic state of every token, and expected transition counts.

    ``first``: index of every row's first token, one more at the end. Rows are cut into segments; the products of the
    segments' matrices carry the exact messages from one to the next, and all segments are then passed in step.
    """
    n = len(e)
    if n == 0:
        return np.zeros(0), np.zeros((2, 2))
    counts = np.diff(first)
    parts = -(-counts // _SEGMENT)
    row_first = np.concatenate([[0], np.cumsum(parts)])
    lanes = int(parts.sum())
    within = ranges(np.zeros(len(parts), np.int64), parts)
    begin = np.repeat(first[:-1], parts) + within * _SEGMENT
    size = np.minimum(_SEGMENT, np.repeat(first[1:], parts) - begin)
    weight, emit = np.exp(step), np.ones((n, 2))
    emit[:, 1] = np.exp(e)
    at = begin[None, :] + np.minimum(np.arange(_SEGMENT)[:, None], size[None, :] - 1)
    live = np.arange(_SEGMENT)[:, None] < size[None, :]
    product = np.broadcast_to(np.eye(2), (lanes, 2, 2)).copy()
    for t in range(_SEGMENT):
        on = live[t]
        new = (product @ weight) * emit[at[t]][:, None, :]
        new /= new.sum(axis=(1, 2), keepdims=True)
        product[on] = new[on]
    start, end = np.zeros((lanes, 2)), np.full((lanes, 2), 0.5)
    heads = row_first[:-1][parts > 0]
    start[heads] = [1.0, 0.0]
    deep = parts[parts > 0]
    for k in range(1, int(deep.max(initial=0))):
        on = heads[deep > k] + k
        start[on] = _normal(np.einsum("ai,aij->aj", start[on - 1], product[on - 1]))
    for k in range(int(deep.max(initial=0)) - 2, -1, -1):
        on = heads[deep > k + 1] + k
        end[on] = _normal(np.einsum("aij,aj->ai", product[on + 1], end[on + 1]))
    forward = np.zeros((_SEGMENT, lanes, 2))
    a = start
    for t in range(_SEGMENT):
        new = _normal((a @ weight) * emit[at[t]])
        a = np.where(live[t][:, None], new, a)
        forward[t] = a
    out, moves = np.zeros(n), np.zeros((2, 2))
    b = end
    for t in range(_SEGMENT - 1, -1, -1):
        on = live[t]
        both = _normal(forward[t] * b)
        out[at[t][on]] = both[on, 1]
        ahead = b * emit[at[t]]
        previous = forward[t - 1] if t else start
        pair = previous[:, :, None] * weight[None] * ahead[:, None, :]
        pair /= pair.sum(axis=(1, 2), keepdims=True)
        moves += pair[on].sum(axis=0)
        b = np.where(on[:, None], _normal(ahead @ weight.T), b)
    return out, moves


def gathered(p: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Features of every row: largest marginal, expected toxic tokens and their share."""
    rows, counts = len(first) - 1, np.diff(first)
    of = np.repeat(np.arange(rows), counts)
    most = np.zeros(rows)
    np.maximum.at(most, of, p)
    total = np.bincount(of, p, minlength=rows)
    return np.stack([np.ones(rows), most, np.log1p(total), np.log1p(100 * total / np.maximum(counts, 1))], axis=1)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit(words: np.ndarray, first: np.ndarray, toxic: np.ndarray, share: float | None = None) -> Field:
    """Learn from rows of word buckets and the rows' labels; ``share``: of toxic rows where the field will be used."""
    counts = np.diff(first)
    of = np.repeat(np.arange(len(counts)), counts)
    pairs = np.unique(of * BUCKETS + words)
    row, word = pairs // BUCKETS, pairs % BUCKETS
    bad, fine = np.bincount(word[toxic[row] == 1], minlength=BUCKETS), np.bincount(word[toxic[row] == 0], minlength=BUCKETS)
    n_bad, n_fine = max(1, int((toxic == 1).sum())), max(1, int((toxic == 0).sum()))
    odds = np.log((bad + 0.5) / (n_bad + 1)) - np.log((fine + 0.5) / (n_fine + 1))
    lexicon = (odds > 1.5) & (bad >= max(3, 0.01 * n_bad))
    y = (lexicon[words] & (toxic[of] == 1)).astype(float)
    field = Field(np.zeros(BUCKETS), np.zeros(BUCKETS), np.zeros(BUCKETS), -2.0, np.array([[1.0, -1.0], [0.0, 0.0]]), np.zeros(4))
    inner = np.ones(len(words), bool)
    inner[first[:-1][first[:-1] < len(words)]] = False
    seen = np.zeros((2, 2))
    before = np.where(inner, np.concatenate([[0.0], y[:-1]]) if len(y) else y, 0.0)
    np.add.at(seen, (before.astype(int), y.astype(int)), 1)
    speed = [np.full(BUCKETS, 1e-6) for _ in range(3)]
    bias_speed, step_speed = 1e-6, np.full((2, 2), 1e-6)
    for _ in range(_EPOCHS if len(words) else 0):
        p, moves = marginals(field.potentials(words, first), first, field.step)
        g = y - p
        for i, (table, where, what) in enumerate(((field.own, words, g), (field.before, words[:-1], np.where(inner[1:], g[1:], 0)), (field.after, words[1:], np.where(inner[1:], g[:-1], 0)))):
            slope = np.bincount(where, what, minlength=BUCKETS) - (0.01 if i == 0 else 0.5) * table
            speed[i] += slope**2
            table += 0.8 * slope / np.sqrt(speed[i])
        slope = g.sum()
        bias_speed += slope**2
        field.bias += 0.8 * slope / bias_speed**0.5
        slope = seen - moves - 0.01 * field.step
        step_speed += slope**2
        field.step = np.clip(field.step + 0.3 * slope / np.sqrt(step_speed), -6, 6)
    p, _ = marginals(field.potentials(words, first), first, field.step)
    x, w = gathered(p, first), np.zeros(4)
    for _ in range(30):  # Newton steps of a ridge logistic regression
        q = _sigmoid(x @ w)
        curve = (x * (q * (1 - q))[:, None]).T @ x + 1e-2 * np.eye(4)
        w = w + np.linalg.solve(curve, x.T @ (toxic - q) - 1e-2 * w)
    if share is not None and 0 < share < 1 and 0 < toxic.sum() < len(toxic):  # the sample's classes are not as frequent as the table's
        w[0] += np.log(share / (1 - share)) - np.log(toxic.mean() / (1 - toxic.mean()))
    field.document = w
    return field


def _buckets(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    lower, is_word = fold_table(NOT_ALNUM)
    for row, data, offsets in pieces(column):
        starts, ends, first = word_bounds(is_word[data], offsets)
        hashed = range_hash(prefix_hash(lower[data]), starts, ends) % np.uint64(BUCKETS)
        yield row, hashed.astype(np.int64), first, starts, ends, offsets


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = []
        for _, words, first, *_ in _buckets(b.column(1)):
            found += [words[x:y].astype(np.int32).tobytes() for x, y in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.binary())], names=["toxic", "words"])


def train(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> Field:
    """Fit on at most ``most`` labelled documents of each class, whole texts of at most TRAIN_BYTES, chosen by a hash of doc_id.

    Rows with crc32(doc_id as text) modulo 5 equal to 0 are held out. Only doc_id and toxic of the labels are read. Of rows
    that repeat a doc_id one is learned from.
    """
    known = labels.filter("doc_id is not null and toxic in (0, 1)").filter(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
    known = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    share = known.agg(F.avg("toxic")).head()[0]
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).filter(F.coalesce(F.octet_length("text"), F.lit(0)) <= TRAIN_BYTES)
    order = [F.xxhash64("doc_id", F.lit(1)), F.col("doc_id")]
    short = cut(known.join(texts.select("doc_id"), "doc_id", "left_semi"))  # chosen among the texts that may be learned from
    chosen = short.filter("toxic = 1").orderBy(*order).limit(most).union(short.filter("toxic = 0").orderBy(*order).limit(most))
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy(text_key("text"), "text"))
    rows = texts.join(F.broadcast(chosen), "doc_id").withColumn("copy", number).filter("copy = 1").select("toxic", "text")
    table = rows.mapInArrow(_encode, "toxic int, words binary").toArrow()
    order = sorted(range(table.num_rows), key=lambda i: (table.column(0)[i].as_py(), table.column(1)[i].as_py()))
    parts = [np.frombuffer(table.column(1)[i].as_py(), np.int32) for i in order]
    first = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
    words = np.concatenate([np.zeros(0, np.int32), *parts]).astype(np.int64)
    return fit(words, first, np.array([table.column(0)[i].as_py() for i in order], float), share)


def _tag(model, keep_text: bool) -> Callable:
    """Rows of (row, text) in; row, the text if it is to be kept, score and spans out."""
    spans_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("marginal", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field: Field = model.value
        for b in batches:
            scores, spans = np.zeros(b.num_rows), [[] for _ in range(b.num_rows)]
            for row, words, first, starts, ends, offsets in _buckets(b.column(1)):
                p, _ = marginals(field.potentials(words, first), first, field.step)
                scores[row : row + len(first) - 1] = _sigmoid(gathered(p, first) @ field.document)
                hot = np.flatnonzero(p >= 0.5)
                of = np.searchsorted(first, hot, "right") - 1
                for i, d in zip(hot.tolist(), of.tolist(), strict=True):
                    own = spans[row + d]
                    piece = {"start": int(starts[i] - offsets[d]), "end": int(ends[i] - offsets[d]), "marginal": float(p[i]), "_last": i}
                    if own and own[-1]["_last"] == i - 1:
                        own[-1] |= {"end": piece["end"], "marginal": max(own[-1]["marginal"], piece["marginal"]), "_last": i}
                    else:
                        own.append(piece)
            spans = [[{k: v for k, v in s.items() if k != "_last"} for s in own] for own in spans]
            kept = {"text": b.column(1)} if keep_text else {}
            yield pa.RecordBatch.from_pydict({"row": b.column(0), **kept, "score": pa.array(scores), "spans": pa.array(spans, spans_type)})

    return run


def toxicity(docs: DataFrame, labels: DataFrame, field: Field | None = None) -> DataFrame:
    """``docs`` with score (probability of being toxic) and spans (byte offsets of toxic runs with their marginals).

    ``docs`` needs doc_id and text, ``labels`` doc_id and toxic; other columns, labels, lang and source among them, are no
    inputs of a score. Null texts and texts without words have the score of a text without toxic words. Equal texts have
    equal scores. Without labels of a class the score is the share of the other one's. An empty table gives no rows.
    """
    model = docs.sparkSession.sparkContext.broadcast(field or train(docs, labels))
    others = [F.col(f"_in.`{c}`").alias(c) for c in docs.columns if c != "text"]  # the text goes alone, not twice
    base = packed(docs).select(F.struct(*others).alias("row"), "_text")
    span = StructType([StructField("start", LongType()), StructField("end", LongType()), StructField("marginal", DoubleType())])
    kinds = {"row": base.schema["row"].dataType, "text": StringType(), "score": DoubleType(), "spans": ArrayType(span)}
    out = base.mapInArrow(_tag(model, True), StructType([StructField(c, t) for c, t in kinds.items()]))
    return out.withColumnRenamed("row", "_in").select(*unpacked(docs, {c: F.col(c) for c in ("text", "score", "spans")}))


def toxicity_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document row: doc_id, held_out, score, predicted (1 if score >= 0.5), n_spans. A null doc_id is not held out."""
    base = docs.select("doc_id", "text")
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels))
    kind = docs.schema["doc_id"].dataType.simpleString()
    out = base.select("doc_id", F.col("text").cast("string")).mapInArrow(_tag(model, False), f"row {kind}, score double, spans array<struct<start:bigint,end:bigint,marginal:double>>")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return out.withColumnRenamed("row", "doc_id").select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("spans").alias("n_spans"))
