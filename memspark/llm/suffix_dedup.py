"""Exact substring dedup by longest-previous-factor arrays.

Strings of ``length`` bytes are split among tasks by anchors: the anchor of a string is the least hash of its short grams,
so equal strings have equal anchors and meet. A document's consecutive strings with one anchor make a context. Equal
contexts are counted by digest; different contexts of an anchor that share the longer stretch before or after it are laid
out as one text, a unit. Its suffix array is made by prefix doubling up to ``length`` bytes. In that order the nearest
smaller positions on both sides of a suffix are its best earlier matches, and the longer of the two common prefixes is its
longest previous factor; a string goes where that factor is ``length`` bytes. Larger positions give the later matches.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from memspark.llm.common import bit_filter, cut, in_filter, mix, packed, pieces, powers, prefix_hash, range_hash, ranges, text_key, unpacked

LENGTH = 400
GRAM = 40
#: Contexts of one unit that a task orders at once; in a larger unit the anchor is made as long as the string itself.
GROUP = 4096
#: Bits of the filter that tells the second reading which anchors may repeat: 4 MB, whatever the input.
FILTER_BITS = 25
_CHUNK = 2 << 20
#: Low bits of a gram's value that hold its place; the others are its hash, as many in every piece, so that equal strings choose alike.
_PLACE_BITS = 24
_TEXT_AT_ONCE = 1 << 20


def anchors(data: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Contexts of the rows in a piece: first string, last string, anchor's place, anchor's hash (leftmost of equal ones)."""
    n, none = len(data), np.zeros(0, np.int64)
    if n < length:
        return none, none, none, np.zeros(0, np.uint64)
    prefix = prefix_hash(data)
    _, down = powers(n + 1)
    grams = n - gram + 1
    hashed = mix((prefix[gram:] - prefix[:grams]) * down[:grams])
    bits = np.uint64(_PLACE_BITS)
    value = (hashed >> bits << bits) | np.arange(grams, dtype=np.uint64)
    width, span = 1, length - gram + 1
    while 2 * width <= span:
        value = np.minimum(value[:-width], value[width:])
        width *= 2
    if span > width:
        value = np.minimum(value[: len(value) - (span - width)], value[span - width :])
    sizes = np.diff(offsets) - length + 1
    rows = np.flatnonzero(sizes > 0)
    if not len(rows):
        return none, none, none, np.zeros(0, np.uint64)
    starts = ranges(offsets[rows], sizes[rows])
    place = (value[starts] & np.uint64((1 << int(bits)) - 1)).astype(np.int64)
    new = np.ones(len(starts), bool)
    new[1:] = (place[1:] != place[:-1]) | (starts[1:] != starts[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:] - 1, [len(starts) - 1]])
    return starts[first], starts[last], place[first], hashed[place[first]]


def _stretches(data: np.ndarray, first: np.ndarray, last: np.ndarray, place: np.ndarray, length: int, gram: int) -> tuple[pa.Array, pa.Array]:
    """Hash of what every string that begins half a stretch or more before the anchor holds, and of what every other one
    holds; null where a context has no such string."""
    half = (length - gram) // 2
    prefix = prefix_hash(data)
    before, after = place - first >= half, place - last <= half
    left, right = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
    left[before] = range_hash(prefix, place[before] - half, place[before] + gram).view(np.int64)
    right[after] = range_hash(prefix, place[after], place[after] + length - half).view(np.int64)
    return pa.array(left, mask=~before), pa.array(right, mask=~after)


def _chunked(column: pa.Array, length: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Pieces of rows; a row longer than a chunk comes in chunks that overlap by length - 1 bytes: (row, shift, bytes, offsets)."""
    for row, data, offsets in pieces(column):
        if len(offsets) > 2 or len(data) <= 2 * _CHUNK:
            yield row, 0, data, offsets
            continue
        for at in range(0, max(1, len(data) - length + 1), _CHUNK):
            part = data[at : at + _CHUNK + length - 1]
            yield row, at, part, np.array([0, len(part)])


def _anchor_hashes(length: int, gram: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, _, data, offsets in _chunked(b.column(0), length):
                yield pa.RecordBatch.from_arrays([pa.array(anchors(data, offsets, length, gram)[3].view(np.int64))], names=["h1"])

    return run


def _contexts(length: int, gram: int, sent) -> Callable:
    """Contexts whose anchors may occur more than once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filled = sent.value
        for b in batches:
            for row, shift, data, offsets in _chunked(b.column(2), length):
                first, last, place, hashed = anchors(data, offsets, length, gram)
                use = in_filter(hashed, filled, FILTER_BITS)
                first, last, place, hashed = first[use], last[use], place[use], hashed[use]
                raw = data.tobytes()
                digests = np.array([xxhash.xxh3_64_intdigest(raw[a : z + length]) for a, z in zip(first.tolist(), last.tolist(), strict=True)], np.uint64)
                left, right = _stretches(data, first, last, place, length, gram)
                of = np.searchsorted(offsets, first, "right") - 1
                begin = first - offsets[of] + shift
                take = pa.array(row + of)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(take), b.column(1).take(take), pa.array(begin), pa.array((last - first + 1).astype(np.int32)), pa.array((place - first).astype(np.int32)), pa.array(hashed.view(np.int64)), pa.array(digests.view(np.int64)), left, right],
                    names=["doc_id", "key", "start", "n", "at", "anchor", "context", "left", "right"],
                )

    return run


def suffix_ranks(text: np.ndarray, length: int) -> list[tuple[int, np.ndarray]]:
    """Ranks of all suffixes by their first 8, 16, 32 ... and at last ``length`` bytes, equal ones alike; by prefix doubling."""
    n = len(text)
    padded = np.concatenate([text, np.zeros(length + 8, np.uint8)])
    eight = np.zeros(n, np.uint64)
    for j in range(min(8, length)):
        eight = (eight << np.uint64(8)) | padded[j : j + n].astype(np.uint64)
    _, rank = np.unique(eight, return_inverse=True)
    done = min(8, length)
    levels = [(done, rank.astype(np.int32))]
    while done < length:
        step = min(done, length - done)
        after = np.zeros(n, np.int64)
        after[: n - step] = rank[step:] + 1 if n > step else 0
        _, rank = np.unique(rank.astype(np.int64) * (n + 2) + after, return_inverse=True)
        done += step
        levels.append((done, rank.astype(np.int32)))
    return levels


def _nearest(position: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest smaller value before and after every element; -1 and n where there is none.

    What lies between an element and its pointer is larger, so pointers may follow each other until they rest.
    """
    n = len(position)
    guarded = np.concatenate([position, [-1]])  # index n, which is also index -1, is smaller than all
    before, after = np.arange(n) - 1, np.append(np.arange(1, n + 1), n)
    for pointer in (before, after):
        open_ = np.arange(n)
        while len(open_):
            open_ = open_[guarded[pointer[open_]] > position[open_]]
            pointer[open_] = pointer[pointer[open_]]
    return before, after[:n]


def _common(levels: list[tuple[int, np.ndarray]], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Bytes that the suffixes i and j have in common, to the eight below, at most those of the last level."""
    whole = levels[-1][1][i] == levels[-1][1][j]
    out = np.where(whole, levels[-1][0], 0)
    left = np.flatnonzero(~whole)
    a, b, n = i[left].copy(), j[left].copy(), len(levels[0][1])
    for size, rank in levels[-2::-1]:
        inside = (a < n) & (b < n)
        same = np.zeros(len(a), bool)
        same[inside] = rank[a[inside]] == rank[b[inside]]
        out[left[same]] += size
        a[same] += size
        b[same] += size
    return out


def longest_factors(levels: list[tuple[int, np.ndarray]], starts: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Longest previous and longest next factor of the strings at ``starts`` (ascending), matches within a group only."""
    order = np.lexsort((starts, levels[-1][1][starts], group))  # the suffix array of every group
    at, own = starts[order], group[order]
    out = []
    for position in (at, len(levels[0][1]) - at):
        best = np.zeros(len(at), np.int64)
        for near in _nearest(position):
            there = np.flatnonzero((near >= 0) & (near < len(at)))
            there = there[own[near[there]] == own[there]]
            best[there] = np.maximum(best[there], _common(levels, at[there], at[near[there]]))
        back = np.zeros(len(at), np.int64)
        back[order] = best
        out.append(back)
    return out[0], out[1]


def _runs(flags: np.ndarray) -> list[list[int]]:
    """[first, stop) of every run of set flags."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return edge.reshape(-1, 2).tolist()


_RANGES = ("doc_id", "key", "start", "stop", "earlier")


def _resolve(length: int) -> Callable:
    """Contexts of whole units in, sorted by unit and place; out: ranges of the strings that match another context's."""

    def flush(held: list[tuple]) -> list[tuple]:
        texts = [h[4] for h in held]
        sizes = np.array([len(t) for t in texts], np.int64)
        text = np.frombuffer(b"".join(texts), np.uint8)
        begin = np.concatenate([[0], np.cumsum(sizes)])[:-1]
        counts = sizes - length + 1
        group = np.cumsum([i > 0 and held[i][0] != held[i - 1][0] for i in range(len(held))])
        previous, following = longest_factors(suffix_ranks(text, length), ranges(begin, counts), np.repeat(group, counts))
        edges = np.concatenate([[0], np.cumsum(counts)]).tolist()
        rows = []
        for h, a, b in zip(held, edges[:-1], edges[1:], strict=True):
            earlier = previous[a:b] >= length
            for flags, later in ((earlier, True), (earlier | (following[a:b] >= length), False)):
                rows += [(h[1], h[2], h[3] + x, h[3] + y - 1 + length, later) for x, y in _runs(flags)]
        return rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        kind = None
        for b in batches:
            kind = b.column(2).type
            for r in zip(b.column(0).to_pylist(), *(b.column(i).to_pylist() for i in (2, 3, 4, 5)), strict=True):
                if size >= _TEXT_AT_ONCE and r[0] != held[-1][0]:
                    yield _ranges(flush(held), kind)
                    held, size = [], 0
                held.append(r)
                size += len(r[4])
        if held:
            yield _ranges(flush(held), kind)

    return run


def _ranges(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [[]] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (kind, pa.int64(), pa.int64(), pa.int64(), pa.bool_()), strict=True)], names=list(_RANGES))


def _cut_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        kind = b.column(0).type
        out: list[list] = [[] for _ in range(6)]
        for doc, key, text, wanted in zip(*(b.column(i) for i in range(4)), strict=True):
            raw = (text.as_py() or "").encode()
            for w in wanted.as_py():
                for column, value in zip(out, (w["unit"], w["place"], doc.as_py(), key.as_py(), w["begin"], raw[w["begin"] : w["stop"]]), strict=True):
                    column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.binary(), kind, pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["unit", "place", "doc_id", "key", "start", "bytes"])


def _strings(length: int) -> Callable:
    """Every string of the contexts as (unit, place, doc_id, key, start, digest)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                raw, begin = b.column(5)[i].as_py(), b.column(4)[i].as_py()
                n = len(raw) - length + 1
                at = pa.array(np.full(n, i))
                digests = np.frombuffer(b"".join([xxhash.xxh3_128_digest(raw[j : j + length]) for j in range(n)]), np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([*(b.column(k).take(at) for k in range(4)), pa.array(np.arange(n) + begin), pa.array(digests[:, 0].copy()), pa.array(digests[:, 1].copy())], names=["unit", "place", "doc_id", "key", "start", "h1", "h2"])

    return run


def _sortable(kind: str, doc: str, *numbers: str) -> Column:
    """Bytes that sort as (doc, numbers) do, a null doc first."""
    flip = lambda c: F.lpad(F.hex(F.coalesce(F.col(c).cast("long"), F.lit(0)).bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")
    name = F.concat(F.hex(F.coalesce(F.col(doc), F.lit(""))), F.lit("00")) if kind == "string" else flip(doc)
    return F.unhex(F.concat(F.when(F.col(doc).isNull(), "00").otherwise("01"), name, *[flip(c) for c in numbers]))


def repeated_ranges(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, group: int = GROUP) -> DataFrame:
    """Byte ranges (start, stop) of every document covered by strings of ``length`` bytes that occur elsewhere:
    doc_id, key (hash of the text), start, stop, earlier (whether only strings with an earlier occurrence count).

    Rows with ``earlier`` true leave the first occurrence, by doc_id (null first) then hash of the text then place.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    half = (length - gram) // 2
    texts = docs.select("doc_id", text_key("text").alias("key"), F.col("text").cast("string").alias("text"))
    twice = cut(texts.select("text").mapInArrow(_anchor_hashes(length, gram), "h1 long").groupBy("h1").count().filter("count > 1").select("h1"))
    sent = docs.sparkSession.sparkContext.broadcast(bit_filter(twice, FILTER_BITS))
    found = texts.mapInArrow(_contexts(length, gram, sent), f"doc_id {kind}, key long, start long, n int, at int, anchor long, context long, left long, right long")
    found = cut(found.join(twice, found["anchor"] == twice["h1"], "left_semi"))
    context = ["anchor", "context"]
    distinct = found.groupBy(*context).agg(F.count("*").alias("copies"), F.min(F.struct("doc_id", "key", "start", "n", "at", "left", "right")).alias("first"))
    distinct = cut(distinct)
    place = F.struct("doc_id", "key", "start")
    whole = found.join(distinct.filter("copies > 1").select(*context, "first"), context)
    whole = whole.select("doc_id", "key", "start", (F.col("start") + F.col("n") - 1 + length).alias("stop"), (place != F.struct("first.doc_id", "first.key", "first.start")).alias("later"))
    both = whole.select("doc_id", "key", "start", "stop", F.lit(False).alias("earlier")).union(whole.filter("later").select("doc_id", "key", "start", "stop", F.lit(True)))

    # two contexts with a string in common share what stands after the anchor or what stands before it
    start, n, at = F.col("first.start"), F.col("first.n"), F.col("first.at")
    stop = start + n - 1 + length
    after = F.when(F.col("first.right").isNotNull(), F.struct(F.xxhash64("anchor", F.lit(1), "first.right").alias("unit"), (start + F.greatest(at - half, F.lit(0))).alias("begin"), stop.alias("stop")))
    before = F.when(F.col("first.left").isNotNull(), F.struct(F.xxhash64("anchor", F.lit(0), "first.left").alias("unit"), start.alias("begin"), F.least(stop, start + at - half + length).alias("stop")))
    sides = distinct.select("first.doc_id", "first.key", F.explode(F.array_compact(F.array(after, before))).alias("s")).select("doc_id", "key", "s.unit", "s.begin", "s.stop")
    many = cut(sides.groupBy("unit").agg(F.count("*").alias("contexts")).filter("contexts > 1"))
    wanted = sides.join(many, "unit").select("doc_id", "key", "unit", "contexts", _sortable(kind, "doc_id", "key", "begin").alias("place"), "begin", "stop")
    wanted = wanted.groupBy(F.col("doc_id").alias("_doc"), F.col("key").alias("_key")).agg(F.collect_list(F.struct("unit", "place", "begin", "stop")).alias("wanted"))
    pulled = texts.join(wanted, texts["doc_id"].eqNullSafe(wanted["_doc"]) & (texts["key"] == wanted["_key"]))
    pulled = cut(pulled.select("doc_id", "key", "text", "wanted").mapInArrow(_cut_contexts, f"unit long, place binary, doc_id {kind}, key long, start long, bytes binary"))
    hot = many.filter(F.col("contexts") > group).select("unit")
    usual = pulled.join(hot, "unit", "left_anti").repartition("unit").sortWithinPartitions("unit", "place")
    solved = usual.mapInArrow(_resolve(length), f"doc_id {kind}, key long, start long, stop long, earlier boolean")
    if hot.isEmpty():
        return both.union(solved)
    strings = pulled.join(hot, "unit", "left_semi").select(*pulled.columns).mapInArrow(_strings(length), f"unit long, place binary, doc_id {kind}, key long, start long, h1 long, h2 long")
    own = F.struct("place", "start")
    equal = cut(strings.groupBy("unit", "h1", "h2").agg(F.min(own).alias("least"), F.max(own).alias("most")).filter("least <> most").select("unit", "h1", "h2", "least"))
    met = strings.join(equal, ["unit", "h1", "h2"]).select("doc_id", "key", "start", (F.col("start") + length).alias("stop"), (own != F.col("least")).alias("later"))
    return both.union(solved).union(met.select("doc_id", "key", "start", "stop", F.lit(False))).union(met.filter("later").select("doc_id", "key", "start", "stop", F.lit(True)))


def _merged(ranges: list[dict] | None) -> list[list[int]]:
    """Maximal [start, stop) that the ranges cover."""
    merged: list[list[int]] = []
    for r in sorted(ranges or [], key=lambda r: (r["start"], r["stop"])):
        if merged and r["start"] <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], r["stop"])
        else:
            merged.append([r["start"], r["stop"]])
    return merged


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
    for b in batches:
        n_bytes, removed, later, spans, sha, texts = [], [], [], [], [], []
        for text, cuts, copies in zip(b.column(1), b.column(2), b.column(3), strict=True):
            raw = (text.as_py() or "").encode()
            merged = _merged(cuts.as_py())
            edges = [0, *(x for m in merged for x in m), len(raw)]
            kept = b"".join(raw[a:z] for a, z in zip(edges[::2], edges[1::2], strict=True))
            n_bytes.append(len(raw))
            removed.append(len(raw) - len(kept))
            later.append(sum(z - a for a, z in _merged(copies.as_py())))
            spans.append([{"start": a, "stop": z} for a, z in merged])
            sha.append(hashlib.sha256(kept).hexdigest())
            texts.append(None if text.as_py() is None else kept.decode("utf-8", "ignore"))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n_bytes, pa.int64()), pa.array(removed, pa.int64()), pa.array(later, pa.int64()), pa.array(spans, kind), pa.array(sha, pa.string()), pa.array(texts, pa.string())], names=["row", "n_bytes", "n_removed", "n_later", "spans", "kept_sha256", "kept"])


def suffix_dedup(docs: DataFrame, keep_first: bool = True, length: int = LENGTH) -> DataFrame:
    """``docs`` with repeated bytes cut out of text: its columns, then n_bytes, n_removed, n_later (bytes that later copies
    cover: what goes where the first copy stays), spans (merged byte ranges) and kept_sha256 (of the bytes left; the text
    drops a character that a cut goes through).

    ``docs`` needs doc_id and text. ``keep_first``: later copies go and the first one stays; else every copy goes. Matches
    never cross documents; overlapping ones count, and strings are judged on the input. Null texts are empty and stay
    null; texts shorter than ``length`` stay as they are. Rows that repeat a doc_id and text are each other's copies; none
    of them is the first alone, so they stay alike where the first copy stays. An empty table gives no rows.
    """
    ranges_of = lambda kind: F.collect_set(F.when(kind, F.struct("start", "stop")))
    earlier = F.col("earlier")
    cuts = repeated_ranges(docs, length).groupBy(F.col("doc_id").alias("_doc"), F.col("key").alias("_of"))
    cuts = cuts.agg(ranges_of(earlier if keep_first else ~earlier).alias("_cuts"), ranges_of(earlier).alias("_later"))
    whole = packed(docs)
    out = whole.join(cuts, whole["_id"].eqNullSafe(cuts["_doc"]) & (whole["_key"] == cuts["_of"]), "left")
    others = [c for c in docs.columns if c != "text"]  # the text goes alone, not twice
    out = out.select(F.struct(*[F.col(f"_in.`{c}`").alias(c) for c in others]).alias("row"), "_text", "_cuts", "_later")
    span = ArrayType(StructType([StructField("start", LongType()), StructField("stop", LongType())]))
    kinds = {"row": out.schema["row"].dataType, "n_bytes": LongType(), "n_removed": LongType(), "n_later": LongType(), "spans": span, "kept_sha256": StringType(), "kept": StringType()}
    out = out.mapInArrow(_remove, StructType([StructField(c, t) for c, t in kinds.items()]))
    outcome = {"text": F.col("kept")} | {c: F.col(c) for c in ("n_bytes", "n_removed", "n_later", "spans", "kept_sha256")}
    return out.withColumnRenamed("row", "_in").select(*unpacked(docs, outcome))
