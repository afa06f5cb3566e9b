"""Helpers shared by the training-data operators: checkpoints, Arrow text buffers and byte hashes."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from memspark.functions.checkpoints import cut, shared_folder  # noqa: F401

PIECE_BYTES = 2 << 20


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_key(text: Column | str) -> Column:
    """64-bit hash of a whole text; with doc_id it names a document row."""
    return F.xxhash64(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")))


def packed(docs: DataFrame) -> DataFrame:
    """Rows as one struct ``_in`` beside ``_id``, ``_text`` and ``_key``, so that no column name of theirs can clash."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_in"), F.col("doc_id").alias("_id"), F.col("text").cast("string").alias("_text"), text_key("text").alias("_key"))


def unpacked(docs: DataFrame, outcome: dict[str, Column]) -> list[Column]:
    """The columns of ``docs`` out of ``_in``, then those of ``outcome``; one of the same name is replaced in its place."""
    kept = [outcome[c].alias(c) if c in outcome else F.col(f"_in.`{c}`").alias(c) for c in docs.columns]
    return kept + [v.alias(k) for k, v in outcome.items() if k not in docs.columns]


#: Values of ``some_of``; a broadcast table of them has at most so many rows, whatever the input.
PLACES = 1 << 17


def some_of(whole: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of ``whole`` (packed) that may have a match among ``keys`` (_doc, _of), and those that surely have none.

    Decided by a hash of few values, so that only the former need be shuffled to be joined.
    """
    place = lambda *c: F.pmod(F.xxhash64(*c), F.lit(PLACES))
    filled = F.broadcast(cut(keys.select(place("_doc", "_of").alias("_place")).distinct()))
    placed = place(whole["_id"], whole["_key"]) == filled["_place"]
    return whole.join(filled, placed, "left_semi"), whole.join(filled, placed, "left_anti")


def pieces(column: pa.Array, limit: int = PIECE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Cut an Arrow string column into runs of rows of about ``limit`` bytes (one row at least).

    Yields the first row, the UTF-8 bytes and the rows' offsets in them; null rows are empty.
    """
    column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if len(column) == 0:
        return
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        yield row, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def fold_table(separators: bytes | list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Byte tables: A-Z lower-cased, and whether a byte belongs to a word."""
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    is_word = np.ones(256, dtype=bool)
    is_word[list(separators)] = False
    return lower, is_word[lower]


#: Space and the ASCII controls tab to carriage return separate words.
SPACES = [0x20, *range(0x09, 0x0E)]
#: After lower-casing, ASCII other than digits and letters separates words.
NOT_ALNUM = [*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]


def word_bounds(is_word: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words in a piece, and for each row the index of its first word (one more at the end)."""
    n = len(is_word)
    if n == 0:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    begins, ends = is_word.copy(), is_word.copy()
    begins[1:] &= ~is_word[:-1]
    ends[:-1] &= ~is_word[1:]
    edge = offsets[(offsets > 0) & (offsets < n)]
    begins[edge] = is_word[edge]
    ends[edge - 1] = is_word[edge - 1]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, offsets)


BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
BASE_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))


@lru_cache(maxsize=1)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    up = np.full(size, BASE, np.uint64)
    down = np.full(size, BASE_INVERSE, np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2**64, at least ``n`` of them."""
    return _powers(max(PIECE_BYTES + 1, 1 << int(n).bit_length()))


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of unsigned 64-bit values."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Prefix sums of a polynomial hash over bytes."""
    up, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=out[1:])
    return out


def range_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the byte ranges, the same for the same bytes wherever they stand."""
    _, down = powers(len(prefix))
    return mix((prefix[ends] - prefix[starts]) * down[starts])


def ranges(first: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Concatenation of ``first[i], first[i]+1, ...`` with ``counts[i]`` values each."""
    total = int(counts.sum())
    if total == 0:
        return np.zeros(0, np.int64)
    jump = np.repeat(first - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts)
    return jump + np.arange(total)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def bit_filter(hashes: DataFrame, bits: int) -> np.ndarray:
    """Bits set at the upper ``bits`` bits of the column h1; its size does not depend on the input's."""
    at = F.shiftrightunsigned("h1", 64 - bits)
    words = hashes.select(F.shiftright(at, 5).cast("int").alias("word"), F.expr(f"cast(1 << cast(shiftrightunsigned(h1, {64 - bits}) & 31 as int) as int)").alias("bit"))
    words = words.groupBy("word").agg(F.bit_or("bit").alias("set"))
    out = np.zeros(1 << (bits - 5), np.uint32)
    for b in words.toArrow().to_batches():
        out[b.column(0).to_numpy()] = b.column(1).to_numpy().view(np.uint32)
    return out.view(np.uint8)


def in_filter(hashes: np.ndarray, filled: np.ndarray, bits: int) -> np.ndarray:
    """Which of the unsigned hashes have their bit set in a filter of ``bit_filter``."""
    at = (hashes >> np.uint64(64 - bits)).astype(np.int64)
    return (filled[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0
