"""Byte-level BPE: whole texts to token ids and back, by DuckDB queries inside every partition.

A task cuts its texts into the words of the pattern. The words it has not met yet become rows (word, position, token), one
for every byte, and a recursive query joins neighbours to the merge table and contracts every word's leftmost pair of least
rank until no pair of a word can merge. Ids are decoded by a join to the vocabulary and an aggregation in their order.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice
from operator import itemgetter

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words that are encoded or tokens that are decoded by one query; a longer text takes several.
AT_ONCE = 1 << 19
#: Words, and words with the marks beside them, whose ids a worker remembers; it forgets all of them when there are more.
REMEMBERED = 1 << 20
#: Longer words are not remembered.
LONG_WORD = 256

#: Words of more bytes have all their pairs of least rank contracted in one step.
LONG_BYTES = 24
# A row is a token: its key (word * 2**32 + first byte), the key past it, and its id. Every step contracts each word's
# leftmost pair of least rank and writes the word's tokens anew; a word's last step has its ids.
_MERGE = """
WITH RECURSIVE t(key, past, tok, step) AS (
  SELECT key, key + 1, tok, 0 FROM start
  UNION ALL
  (WITH pairs AS (SELECT a.key >> 32 AS word, a.key, b.key AS middle, b.past, merged FROM t AS a JOIN t AS b ON a.past = b.key JOIN merges ON pair = (a.tok::BIGINT << 32) | b.tok),
  least AS (SELECT word, min((merged::BIGINT << 32) | (key & 4294967295)) AS best FROM pairs GROUP BY word),
  made AS (SELECT pairs.* FROM pairs JOIN least ON pairs.word = least.word AND (merged::BIGINT << 32) | (key & 4294967295) = best)
  SELECT t.key, CASE WHEN t.key = made.key THEN made.past ELSE t.past END, CASE WHEN t.key = made.key THEN made.merged ELSE tok END, step + 1
  FROM t JOIN made ON t.key >> 32 = made.word WHERE t.key <> made.middle))
SELECT word, list(tok ORDER BY key) AS ids FROM t JOIN (SELECT key >> 32 AS word, max(step) AS last FROM t GROUP BY word) ON key >> 32 = word AND step = last GROUP BY word ORDER BY word
"""
# Of a long word a step contracts all pairs of the least rank, from the left and without overlap (every other pair of a
# chain), which comes to the same: a pair with a new token never has a lower rank than that token's own, as its merge would
# have been possible before. Its rows are replaced, a token merged into the one before it by -1.
_MERGE_LONG = """
WITH RECURSIVE t(key, past, tok) USING KEY (key) AS (
  SELECT key, key + 1, tok FROM start
  UNION ALL
  (WITH pairs AS (SELECT a.key >> 32 AS word, a.key, b.key AS middle, b.past, merged FROM t AS a JOIN t AS b ON a.past = b.key JOIN merges ON pair = (a.tok::BIGINT << 32) | b.tok WHERE a.tok >= 0),
  least AS (SELECT word, min(merged) AS merged FROM pairs GROUP BY word),
  linked AS (SELECT pairs.*, coalesce(lag(middle) OVER (PARTITION BY word ORDER BY key) = key, false) AS chained FROM pairs JOIN least USING (word, merged)),
  chains AS (SELECT *, count(*) FILTER (NOT chained) OVER (PARTITION BY word ORDER BY key) AS chain FROM linked),
  made AS (SELECT * FROM chains QUALIFY row_number() OVER (PARTITION BY word, chain ORDER BY key) % 2 = 1)
  SELECT t.key, coalesce(made.past, t.past), CASE WHEN other.word IS NOT NULL THEN -1 ELSE coalesce(made.merged, tok) END
  FROM t JOIN least ON t.key >> 32 = least.word LEFT JOIN made ON t.key = made.key LEFT JOIN made AS other ON t.key = other.middle WHERE tok >= 0))
SELECT key >> 32 AS word, list(tok ORDER BY key) AS ids FROM t WHERE tok >= 0 GROUP BY word ORDER BY word
"""
_DECODE = "SELECT doc, list(bytes ORDER BY pos) AS parts FROM tokens JOIN vocabulary USING (id) GROUP BY doc"


def read_ranks(path: str) -> dict[bytes, int]:
    """Tokens and their ranks out of a rank file, whose lines hold a token in base 64 and its rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def _as_ranges(points: list[int]) -> str:
    edges = np.split(np.array(points), np.flatnonzero(np.diff(points) > 1) + 1) if points else []
    return "".join(f"\\U{e[0]:08x}-\\U{e[-1]:08x}" for e in edges)


class Splitter:
    """The words of a text by a pattern none of whose matches goes on from other characters into white space, with letters and numbers as tiktoken knows them: its Unicode tables may be of
    another version. Texts without characters that the versions class differently, nearly all, take the plain pattern."""

    def __init__(self, pattern: str):
        import tiktoken

        every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
        single = {bytes([i]): i for i in range(256)}
        exact, other = pattern, ""
        for name in ("\\p{L}", "\\p{N}"):
            known = tiktoken.Encoding("class", pat_str=name, mergeable_ranks=single, special_tokens={})
            theirs, ours = set(known.decode(known.encode_ordinary(every))), set(regex.findall(name, every))
            less, more = _as_ranges(sorted(map(ord, ours - theirs))), _as_ranges(sorted(map(ord, theirs - ours)))
            other += less + more
            exact = exact.replace(name, f"[[{name}{more}]--[{less}]]" if less else f"[{name}{more}]")
        self.plain, self.exact = regex.compile(pattern), regex.compile(exact, regex.V1)
        self.other = re.compile(f"[{other}]") if other else None
        space = "".join(f"\\U{ord(c):08x}" for c in regex.findall(r"\s", every))
        self.unit = re.compile(f"[{space}]*[^{space}]+|[{space}]+")

    def units(self, text: str) -> Iterator[str]:
        """Parts of a text that the pattern splits by themselves: white space and what follows up to the next. Those of a long text are made as they are read."""
        return map(re.Match.group, self.unit.finditer(text)) if len(text) > AT_ONCE else iter(self.unit.findall(text))

    def words(self, unit: str) -> list[str]:
        pattern = self.exact if self.other and not unit.isascii() and self.other.search(unit) else self.plain
        return pattern.findall(unit)


class Coder:
    """Encoder and decoder of one Python worker, with its own DuckDB."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.split = Splitter(pattern)
        self.whole = {token: np.array([rank], "<u4").tobytes() for token, rank in ranks.items()}
        self.first = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        self.ids = np.array(sorted(ranks.values()))
        self.known: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "400MB", "temp_directory": ""})
        pairs = [(a, b, rank) for token, rank in ranks.items() for k in range(1, len(token)) if (a := ranks.get(token[:k])) is not None and (b := ranks.get(token[k:])) is not None]
        first, second, merged = np.array(pairs, np.int64).reshape(-1, 3).T
        self._table("merges", pa.table({"pair": (first << 32) | second, "merged": merged.astype(np.int32)}))
        self._table("vocabulary", pa.table({"id": pa.array(ranks.values(), pa.int32()), "bytes": pa.array(list(ranks), pa.binary())}))

    def _table(self, name: str, rows: pa.Table) -> None:
        self.db.register("given", rows)
        self.db.execute(f"CREATE OR REPLACE TABLE {name} AS SELECT * FROM given")
        self.db.unregister("given")

    def _learn(self, words: set[str]) -> dict[str, bytes]:
        """Ids of words that are not remembered."""
        found, rest = {}, []
        for word in words:
            ids = self.whole.get(data := word.encode())
            if ids is None:
                rest.append((len(data), word, data))
            else:
                found[word] = ids
        rest.sort(key=itemgetter(0))
        at = 0
        while at < len(rest):
            end, size = at, 0
            while end < len(rest) and (end == at or size + rest[end][0] <= AT_ONCE and (rest[at][0] > LONG_BYTES or rest[end][0] <= LONG_BYTES)):
                size += rest[end][0]
                end += 1
            lengths = np.array([n for n, _, _ in rest[at:end]])
            data = np.frombuffer(b"".join(d for _, _, d in rest[at:end]), np.uint8)
            starts = np.repeat(np.cumsum(lengths) - lengths, lengths)
            key = (np.repeat(np.arange(end - at, dtype=np.int64), lengths) << 32) | (np.arange(len(data)) - starts)
            self._table("start", pa.table({"key": key, "tok": self.first[data]}))
            ids = self.db.sql(_MERGE if rest[at][0] <= LONG_BYTES else _MERGE_LONG).to_arrow_table().column("ids").combine_chunks()
            flat, offsets = ids.flatten().to_numpy().astype("<u4").tobytes(), ids.offsets.to_numpy() * 4
            found |= {rest[at + i][1]: flat[offsets[i] : offsets[i + 1]] for i in range(end - at)}
            at = end
        return found

    def ids_of(self, units: list[str]) -> list[bytes]:
        """Ids of the units as little-endian unsigned 32-bit integers."""
        known = self.known
        if new := set(units).difference(known):
            split = {u: self.split.words(u) for u in new}
            words = self.words
            words.update(self._learn({w for some in split.values() for w in some}.difference(words)))
            known.update((u, words[some[0]] if len(some) == 1 else b"".join([words[w] for w in some])) for u, some in split.items())
        out = [known[u] for u in units]
        for memory in (self.words, known):
            if len(memory) > REMEMBERED:
                memory.clear()
        for u in [u for u in new if len(u) > LONG_WORD]:
            known.pop(u, None)
            for w in split[u]:
                self.words.pop(w, None)
        return out

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of every text; a null text is empty."""
        out, block, share = [bytearray() for _ in texts], [], []

        def flush() -> None:
            done, ids = 0, self.ids_of(block)
            for row, n in share:
                out[row] += b"".join(ids[done : done + n])
                done += n
            block.clear(), share.clear()

        for row, text in enumerate(texts):
            units = self.split.units(text or "")
            while some := list(islice(units, AT_ONCE)):
                block += some
                share.append((row, len(some)))
                if len(block) >= AT_ONCE:
                    flush()
        flush()
        return [bytes(x) for x in out]

    def decode(self, rows: list[bytes | None]) -> list[bytes]:
        """Bytes of every row of ids; null rows are empty."""
        out = [bytearray() for _ in rows]
        sizes = np.array([len(r or b"") // 4 for r in rows], np.int64)
        ids = np.frombuffer(b"".join(r or b"" for r in rows), "<u4").astype(np.int64)
        row_of = np.repeat(np.arange(len(rows)), sizes)
        for a in range(0, len(ids), AT_ONCE):
            part = ids[a : a + AT_ONCE]
            if (unknown := np.setdiff1d(part, self.ids)).size:
                raise ValueError(f"no token has the id {int(unknown[0])}")
            self.db.register("tokens", pa.table({"doc": row_of[a : a + AT_ONCE], "pos": np.arange(len(part), dtype=np.int32), "id": part.astype(np.int32)}))
            found = self.db.sql(_DECODE).to_arrow_table()
            parts = found.column("parts").combine_chunks()
            tokens = parts.flatten()
            data = memoryview(tokens.buffers()[2])  # the tokens' bytes one after the other
            ends = np.frombuffer(tokens.buffers()[1], np.int32)[tokens.offset : tokens.offset + len(tokens) + 1]
            edges = ends[parts.offsets.to_numpy() - parts.offsets[0].as_py()].tolist()
            for i, row in enumerate(found.column("doc").to_pylist()):
                out[row] += data[edges[i] : edges[i + 1]]
            self.db.unregister("tokens")
        return [bytes(x) for x in out]


_coders: dict[int, Coder] = {}


def _coder(ranks: dict[bytes, int], pattern: str) -> Coder:
    """The worker's coder, made anew only for other ranks or another pattern."""
    key = hash((pattern, frozenset(ranks.items())))
    if key not in _coders:
        _coders.clear()
        _coders[key] = Coder(ranks, pattern)
    return _coders[key]


def _slices(batches: Iterator[pa.RecordBatch], at: int, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches in runs of rows with about ``limit`` bytes in column ``at``, one row at least."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False).cumsum() if batch.num_rows else np.zeros(0)
        row = 0
        while row < batch.num_rows:
            end = max(row + 1, int(np.searchsorted(sizes, (sizes[row - 1] if row else 0) + limit, "right")))
            yield batch.slice(row, end - row)
            row = end


def _with(df: DataFrame, source: str, made: list[str], ranks: dict[bytes, int], pattern: str) -> DataFrame:
    """``df`` with the columns ``made`` of ids and decoded out of the text or ids in ``source``."""
    shared = df.sparkSession.sparkContext.broadcast(ranks)
    given = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns if c not in made]).alias("_in"), F.col(f"`{source}`").cast("binary" if source == "ids" else "string").alias("_what"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = None
        for part in _slices(batches, 1):
            coder = coder or _coder(shared.value, pattern)
            values = part.column(1).to_pylist()
            ids = coder.encode(values) if "ids" in made else values
            columns = {"ids": lambda: ids, "decoded": lambda: coder.decode(ids)}  # noqa: B023
            yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(columns[c](), pa.binary()) for c in made]], names=["_in", *made])

    schema = T.StructType([given.schema["_in"], *[T.StructField(c, T.BinaryType()) for c in made]])
    return given.mapInArrow(run, schema).select("_in.*", *made)


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, text: str = "text") -> DataFrame:
    """``docs`` with ``ids``: the token ids of every whole text, packed as little-endian unsigned 32-bit integers.

    Every match of ``pattern`` is encoded by itself; a word that is a token is that token, else the leftmost pair of least
    rank is merged until none can be. There are no special tokens: their strings are ordinary text. Null and empty texts
    have no ids, no text is cut, repeated rows stay. Columns of docs named ids are replaced. A word takes a step for every
    different rank that it merges, so a single word of hundreds of thousands of letters is slow, but right.
    """
    return _with(docs, text, ["ids"], ranks, pattern)


def decode(rows: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """``rows`` with ``decoded``: the bytes that the packed ``ids`` stand for; null and empty ids give no bytes. An id out of the vocabulary raises ValueError."""
    return _with(rows, "ids", ["decoded"], ranks, "")


def round_trip(docs: DataFrame, ranks: dict[bytes, int], pattern: str, text: str = "text") -> DataFrame:
    """``docs`` with ``ids`` as of ``encode`` and ``decoded`` as of ``decode``, by one pass over the texts."""
    return _with(docs, text, ["ids", "decoded"], ranks, pattern)


def token_digests(docs: DataFrame, ranks: dict[bytes, int], pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row of ``docs``."""
    out = round_trip(docs.select("doc_id", "text"), ranks, pattern)
    return out.select("doc_id", F.expr("cast(length(ids) div 4 as bigint)").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
