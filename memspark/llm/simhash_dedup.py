"""SimHash near-duplicates by tiled exact comparison.

Fingerprints are laid out in tiles and the tiles compared pair by pair with numpy's exclusive-or and bit counts.
A tile holds fingerprints that agree in one of ``radius + 1`` bit bands (two fingerprints within the radius always agree
in one of them); a band value with many fingerprints is laid out in tiles by population count, and tile pairs whose
population counts differ by more than the radius are never made.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memspark.functions.graph import connected_components
from memspark.llm.common import bit_filter, cut, in_filter, mix, packed, ranges, some_of, text_key, unpacked

SHINGLE = 3
RADIUS = 3
SEED = 42
#: Fingerprints in a tile; a pair of tiles takes 8 * TILE**2 bytes while it is compared.
TILE = 1024
_SHINGLES_AT_ONCE = 1 << 17


def _shingle_hashes(text: str | None, shingle: int) -> Iterator[np.ndarray]:
    """Big-endian XXH64 of the word shingles of a text, repeats included, as rows of eight bytes, some at a time."""
    words = (text or "").encode().lower().split()
    if not words:
        return
    line = b" ".join(words)
    gaps = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
    starts, ends = np.concatenate([[0], gaps + 1]), np.concatenate([gaps, [len(line)]])
    k = min(shingle, len(words))
    first, last = starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist()
    digest = xxhash.xxh64_digest
    for at in range(0, len(first), _SHINGLES_AT_ONCE):
        some = b"".join([digest(line[a:b], SEED) for a, b in zip(first[at : at + _SHINGLES_AT_ONCE], last[at : at + _SHINGLES_AT_ONCE], strict=True)])
        yield np.frombuffer(some, np.uint8).reshape(-1, 8)


def _vote(hashes: list[np.ndarray] | Iterator[np.ndarray]) -> int:
    votes, n = np.zeros(64, np.int64), 0
    for some in hashes:
        votes += np.unpackbits(some, axis=1).sum(axis=0, dtype=np.int64)
        n += len(some)
    return int.from_bytes(np.packbits(2 * votes > n).tobytes(), "big")


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64-bit SimHash of the word shingles of one text, repeats included; 0 without words."""
    return _vote(_shingle_hashes(text, shingle))


def _fingerprints(shingle: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = np.array([fingerprint(x.as_py(), shingle) for x in b.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found.view(np.int64), pa.int64())], names=["doc", "fp"])

    return run


def _links(unit: np.ndarray, side: np.ndarray, fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of rows of one unit within the radius: all pairs of a single tile, or those across two tiles."""
    ones = np.bitwise_count(fp).astype(np.int16)
    order = np.lexsort((ones, side, unit))
    unit, side, bits, ones = unit[order], side[order], fp[order], ones[order]
    cuts = np.flatnonzero(np.diff(unit)) + 1
    begins, ends = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(unit)]])
    large = (side[ends - 1] > 0) | (ends - begins > 256)
    left, right = [], []
    for a, b in zip(begins[large].tolist(), ends[large].tolist(), strict=True):
        m = a + int(np.searchsorted(side[a:b], 1))
        alone = m == b
        for x in range(a, m, 256):
            y = min(m, x + 256)
            low, high = (x, b) if alone else (m, b)
            # both tiles stand by population count: what differs beyond the radius is skipped unread
            low = max(low, low + int(np.searchsorted(ones[low:high], ones[x] - radius)))
            high = low + int(np.searchsorted(ones[low:high], ones[y - 1] + radius, "right"))
            i, j = np.nonzero(np.bitwise_count(bits[x:y, None] ^ bits[None, low:high]) <= radius)
            i, j = x + i, low + j
            if alone:
                i, j = i[i < j], j[i < j]
            left.append(order[i])
            right.append(order[j])
    stop = np.repeat(np.where(large, begins, ends), ends - begins)
    rows = np.flatnonzero(np.arange(len(unit)) + 1 < stop)
    step = 1
    while len(rows):
        rows = rows[(rows + step < stop[rows])]
        rows = rows[ones[rows + step] - ones[rows] <= radius]  # sorted by population count: all farther rows differ more
        near = rows[np.bitwise_count(bits[rows] ^ bits[rows + step]) <= radius]
        left.append(order[near])
        right.append(order[near + step])
        step += 1
    return np.concatenate([np.zeros(0, np.int64), *left]), np.concatenate([np.zeros(0, np.int64), *right])


def _forest(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """For each of ``n`` rows the first row of its component."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[left], label[right])
        new = label.copy()
        np.minimum.at(new, left, low)
        np.minimum.at(new, right, low)
        np.minimum.at(new, label[left], low)
        np.minimum.at(new, label[right], low)
        new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


def _units(batches: Iterator[pa.RecordBatch], work: Callable) -> Iterator[pa.RecordBatch]:
    """Call ``work`` with tables of whole units; rows come sorted by their first column, the unit."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if b.num_rows == 0:
            continue
        unit = b.column(0).to_numpy(zero_copy_only=False)
        ready = int(np.searchsorted(unit, unit[-1]))
        if ready or (held and held[-1].column(0)[-1].as_py() != unit[0]):
            held.append(b.slice(0, ready))
            yield from work(pa.Table.from_batches(held))
            held = [b.slice(ready)]
        else:
            held.append(b)
    if held:
        yield from work(pa.Table.from_batches(held))


def _compare(radius: int, spanning: bool = True) -> Callable:
    """Links of whole units: a spanning forest of them, or for every row the nearest of those before it."""
    most = 1 << 22

    def work(table: pa.Table) -> Iterator[pa.RecordBatch]:
        unit, side, fp, node = (c.to_numpy() for c in table.columns)
        fp = fp.view(np.uint64)
        cuts = np.concatenate([np.flatnonzero(np.diff(unit)) + 1, [len(unit)]])
        load = np.cumsum(np.diff(np.concatenate([[0], cuts])) ** 2)
        marks = np.unique(cuts[np.minimum(np.searchsorted(load, np.arange(most, load[-1] + most, most)), len(cuts) - 1)])
        for a, b in zip([0, *marks[:-1].tolist()], marks.tolist(), strict=True):
            left, right = _links(unit[a:b], side[a:b], fp[a:b], radius)
            if spanning:
                root = _forest(b - a, left, right)
                at = np.flatnonzero(root != np.arange(b - a))
                to = root[at]
            else:
                early, late = np.minimum(left, right), np.maximum(left, right)
                order = np.lexsort((early, np.bitwise_count(fp[a:b][early] ^ fp[a:b][late]), late))
                at, where = np.unique(late[order], return_index=True)
                to = early[order][where]
            yield pa.RecordBatch.from_arrays([pa.array(node[a:b][at]), pa.array(node[a:b][to])], names=["src", "dst"])

    return lambda batches: _units(batches, work)


def _bands(radius: int) -> Column:
    """Keys of the ``radius + 1`` bit bands of a fingerprint."""
    n = radius + 1
    edges = [round(64 * i / n) for i in range(n + 1)]
    parts = []
    for i, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
        value = F.shiftrightunsigned("fp", a).bitwiseAND(F.lit((1 << (b - a)) - 1)) if b - a < 64 else F.col("fp")
        parts.append(F.struct(F.lit(i).alias("band"), value.alias("value")))
    return F.explode(F.array(*parts))


def fingerprint_links(fingerprints: DataFrame, radius: int = RADIUS, tile: int = TILE, bands: int | None = None, spanning: bool = True) -> DataFrame:
    """Edges (src, dst) between the nodes of ``fingerprints`` (node, kind, fp) within ``radius`` bits of each other.

    Nodes of one kind are compared that agree in one of ``bands`` bit bands: radius + 1, the default, finds all links.
    Within a pair of tiles a spanning forest of the links is returned, so that components are those of all links
    while the rows stay in proportion to the input; not ``spanning``: the nearest link of every node.
    """
    rows = fingerprints.select("node", "fp", "kind", _bands((bands or radius + 1) - 1).alias("key"), F.bit_count("fp").alias("ones"))
    rows = rows.select("node", "fp", F.xxhash64("kind", "key.band", "key.value").alias("value"), "ones")
    counted = rows.groupBy("value", "ones").count()
    hot = cut(counted.groupBy("value").agg(F.sum("count").alias("total")).filter(F.col("total") > tile).select("value"))
    usual = rows.join(hot, "value", "left_anti").select(F.col("value").alias("unit"), F.lit(0).alias("side"), "fp", "node")
    usual = usual.repartition("unit").sortWithinPartitions("unit").mapInArrow(_compare(radius, spanning), "src long, dst long")
    if hot.isEmpty():
        return usual
    many = rows.join(hot, "value").join(counted.withColumnRenamed("count", "n"), ["value", "ones"])
    chunk = F.pmod(F.xxhash64("node", F.lit(7)), F.ceil(F.col("n") / tile))
    many = cut(many.select("value", "ones", chunk.alias("chunk"), "fp", "node"))
    tiles = many.select("value", "ones", "chunk").distinct()
    first, second = (tiles.select("value", F.col("ones").alias(f"ones{i}"), F.col("chunk").alias(f"chunk{i}")) for i in (0, 1))
    pairs = first.join(second, "value").filter(
        F.col("ones1").between(F.col("ones0"), F.col("ones0") + radius) & ((F.col("ones0") < F.col("ones1")) | (F.col("chunk0") <= F.col("chunk1")))
    )
    pairs = cut(pairs.withColumn("unit", F.xxhash64("value", "ones0", "chunk0", "ones1", "chunk1")))
    sides = []
    for i in (0, 1):
        own = pairs if i == 0 else pairs.filter("ones0 <> ones1 or chunk0 <> chunk1")
        own = own.select("unit", "value", F.col(f"ones{i}").alias("ones"), F.col(f"chunk{i}").alias("chunk"))
        sides.append(many.join(own, ["value", "ones", "chunk"]).select("unit", F.lit(i).alias("side"), "fp", "node"))
    units = sides[0].union(sides[1]).repartition("unit").sortWithinPartitions("unit")
    return usual.union(units.mapInArrow(_compare(radius, spanning), "src long, dst long"))


def simhash_classes(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """Class of near-duplicates of every document row.

    ``docs`` needs doc_id and text; other columns are ignored. Returns doc_id, fingerprint (16 lower-case hex digits),
    component_id (smallest doc_id of the class). A null text has no words; texts without words have fingerprint zero and
    are linked like others. Rows that repeat a doc_id or a text share their class. A class of rows without doc_id has a
    null component_id. An empty table gives no rows.
    """
    base = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    base = cut(base.mapInArrow(_fingerprints(shingle), f"doc {kind}, fp long"))
    known = _rooted(base, radius)
    least = known.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = known.join(least, "root").select("fp", "component_id")
    return base.join(classes, "fp").select(F.col("doc").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _rooted(base: DataFrame, radius: int) -> DataFrame:
    """(fp, first, root): the fingerprints of ``base`` (doc, fp), their least doc, and a fingerprint of their class."""
    known = cut(base.groupBy("fp").agg(F.min("doc").alias("first")))
    nodes = connected_components(fingerprint_links(known.select(F.col("fp").alias("node"), F.lit(0).alias("kind"), "fp"), radius))
    return known.join(nodes, known.fp == nodes.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))


#: For documents: words of a shingle, similarity of the shingle sets, and the radius in which candidates are looked for.
WIDE_SHINGLE, SIMILARITY, WIDE_RADIUS = 5, 0.8, 14
#: Documents of the sample that tells frequent shingles, and in how many of them a frequent one is.
SAMPLE_DOCS, FREQUENT = 5_000, 3
#: Rounds in which documents are held against two holders of each of their shingles before all pairs are looked at.
STAR_ROUNDS = 1
#: Rows of one shingle that meet in a task, and documents that are held against one other in a task.
MEETING, TEXTS = 2048, 256
#: Bits of the filter that tells a second reading which hashes may repeat: 4 MB, whatever the input.
FILTER_BITS = 25


def _distinct(hashes: list[np.ndarray]) -> np.ndarray:
    return np.unique(np.concatenate([h.view(">u8").ravel() for h in hashes]).astype(np.uint64)) if hashes else np.zeros(0, np.uint64)


def shingle_set(text: str | None, shingle: int) -> np.ndarray:
    """Sorted hashes of the distinct word shingles; none without words."""
    return _distinct(list(_shingle_hashes(text, shingle)))


def _digests(distinct: np.ndarray) -> Iterator[np.ndarray]:
    """Hashes as rows of eight bytes, some at a time."""
    for at in range(0, len(distinct), _SHINGLES_AT_ONCE):
        yield distinct[at : at + _SHINGLES_AT_ONCE].astype(">u8").view(np.uint8).reshape(-1, 8)


def _prefix(distinct: np.ndarray, similarity: float, frequent: np.ndarray) -> np.ndarray:
    """The first of ``distinct`` in the order (frequent or not, hash), so many that two sets as similar share one of them."""
    late = np.zeros(len(distinct), bool)
    if len(frequent):
        late = frequent[np.minimum(np.searchsorted(frequent, distinct), len(frequent) - 1)] == distinct
    ordered = np.concatenate([distinct[~late], distinct[late]])
    return ordered[: len(ordered) - math.ceil(similarity * len(ordered) - 1e-6) + 1]


def _sized(shingle: int, similarity: float, frequent: np.ndarray) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            prints, sizes, firsts, counts = np.zeros(b.num_rows, np.uint64), [], [], []
            for i, x in enumerate(b.column(2)):
                distinct = shingle_set(x.as_py(), shingle)
                prints[i] = _vote(_digests(distinct))  # once each, as similarity counts them
                sizes.append(len(distinct))
                counts.append(np.minimum(np.bincount(distinct >> np.uint64(56), minlength=256), 255).astype(np.uint8).tobytes())
                firsts.append(_prefix(distinct, similarity, frequent).view(np.int64))
            firsts = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, firsts)]), pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *firsts])))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(prints.view(np.int64)), pa.array(sizes, pa.int64()), pa.array(counts, pa.binary()), firsts], names=["doc_id", "key", "fp", "size", "counts", "prefix"])

    return run


def _frequent(texts: DataFrame, shingle: int) -> np.ndarray:
    """Sorted hashes of shingles frequent in a sample of texts: which ones they are bears on speed, never on the result."""
    n = texts.count()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a in range(0, b.num_rows, 64):
                sets = [shingle_set(x.as_py(), shingle) for x in b.column(0).slice(a, 64)]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets).view(np.int64))], names=["hash"])

    some = texts.filter(F.pmod(F.xxhash64("key", F.lit(17)), F.lit(max(1, n // SAMPLE_DOCS))) == 0).select("text")
    often = some.mapInArrow(run, "hash long").groupBy("hash").count().filter(F.col("count") >= FREQUENT).orderBy(F.desc("count"), "hash").limit(1 << 17)
    return np.sort(np.array([r.hash for r in often.select("hash").collect()], np.int64).view(np.uint64))


def _allowed(one: np.ndarray, two: np.ndarray, total: np.ndarray, similarity: float) -> np.ndarray:
    """Whether the counts of two sets allow the similarity: they share at most the lesser count of every cell. A full cell
    (255 or more) tells nothing, and such pairs stay."""
    least = np.minimum(one, two)
    shared = least.sum(axis=1, dtype=np.int64)
    return (shared >= similarity * (total - shared) - 1e-6) | (least == 255).any(axis=1)


def _sharing(similarity: float) -> Callable:
    """Units of (unit, size, place, part, node, counts) in; pairs (a, b) out that share the unit's hash, lie in different
    parts and can be similar enough by their sizes, what stands after the hash in both, and their counts."""

    def work(table: pa.Table) -> Iterator[pa.RecordBatch]:
        unit, size, place, part, node = (c.to_numpy() for c in table.columns[:5])
        counts = np.frombuffer(b"".join(table.column(5).to_pylist()), np.uint8).reshape(-1, 256)
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(unit)) + 1, [len(unit)]])
        left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]

        def keep(i: np.ndarray, j: np.ndarray) -> None:
            most = np.minimum(size[i] - place[i], size[j] - place[j])
            ok = (part[i] != part[j]) & (most >= similarity * (size[i] + size[j] - most) - 1e-6)
            i, j = i[ok], j[ok]
            for a in range(0, len(i), 1 << 15):
                x, y = i[a : a + (1 << 15)], j[a : a + (1 << 15)]
                fits = _allowed(counts[x], counts[y], size[x] + size[y], similarity)
                left.append(np.minimum(node[x[fits]], node[y[fits]]))
                right.append(np.maximum(node[x[fits]], node[y[fits]]))

        lengths = np.diff(cuts)
        two = cuts[:-1][lengths == 2]
        keep(two, two + 1)
        for a, b in zip(cuts[:-1][lengths > 2].tolist(), cuts[1:][lengths > 2].tolist(), strict=True):
            if (part[a:b] == part[a]).all():
                continue
            for x in range(a, b, 256):
                i, j = np.meshgrid(np.arange(x, min(b, x + 256)), np.arange(x, b), indexing="ij")
                later = i < j
                keep(i[later], j[later])
        pairs = np.unique(np.stack([np.concatenate(left), np.concatenate(right)]), axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], names=["a", "b"])

    return lambda batches: _units(batches, work)


def _sets(shingle: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a in range(0, b.num_rows, 64):
                some = b.slice(a, 64)
                sets = pa.array([shingle_set(x.as_py(), shingle).tobytes() for x in some.column(1)], pa.binary())
                yield pa.RecordBatch.from_arrays([some.column(0), sets], names=["node", "shingles"])

    return run


def _verify(similarity: float) -> Callable:
    """Units of shingle sets in, the set that the others are held against first; the pairs similar enough out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, centre, against = None, None, np.zeros(0, np.uint64)
        for b in batches:
            src, dst = [], []
            for u, first, node, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3), strict=True):
                own = np.frombuffer(raw.as_buffer(), np.uint64)
                if first == 0:
                    unit, centre, against = u, node, own.copy()
                elif u == unit:
                    least, most = sorted((len(own), len(against)))
                    if least >= similarity * most - 1e-6:
                        both = np.concatenate([own, against])
                        both.sort(kind="stable")
                        shared = int((both[1:] == both[:-1]).sum())
                        if shared >= similarity * (least + most - shared) - 1e-6:
                            src.append(node)
                            dst.append(centre)
            yield pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], names=["src", "dst"])

    return run


def _repeated(sent) -> Callable:
    """Rows of (node, size, prefix) in; the prefix's hashes that may occur in another document out, with their places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(2)
            lengths = np.diff(lists.offsets.to_numpy())
            hashes, place = lists.flatten().to_numpy(), ranges(np.zeros(len(lengths), np.int64), lengths)
            use = np.flatnonzero(in_filter(hashes.view(np.uint64), sent.value, FILTER_BITS))
            take = pa.array(np.repeat(np.arange(b.num_rows), lengths)[use])
            yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), pa.array(place[use]), pa.array(hashes[use])], names=["node", "size", "place", "hash"])

    return run


def _may_be_similar(similarity: float) -> Callable:
    """Pairs with the sizes and counts of both in; those out whose counts allow the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows == 0:
                continue
            one, two = (np.frombuffer(b"".join(b.column(i).to_pylist()), np.uint8).reshape(-1, 256) for i in (3, 5))
            use = pa.array(_allowed(one, two, b.column(2).to_numpy() + b.column(4).to_numpy(), similarity))
            yield pa.RecordBatch.from_arrays([b.column(0).filter(use), b.column(1).filter(use)], names=["src", "dst"])

    return run


def _similar_pairs(pairs: DataFrame, known: DataFrame, texts: DataFrame, shingle: int, similarity: float, counted: bool = False) -> DataFrame:
    """Those of ``pairs`` (src, dst) whose whole shingle sets are similar enough.

    Counts of both sets rule most others out, unless they have (``counted``). A document's partners come to it in units of bounded size, so each set
    travels once for every partner that is a centre, and a centre once for every unit.
    """
    if not counted:
        one, two = (known.select(F.col("node").alias(f"node{i}"), F.col("size").alias(f"size{i}"), F.col("counts").alias(f"counts{i}")) for i in (1, 2))
        both = pairs.join(one, pairs["src"] == one["node1"]).join(two, F.col("dst") == two["node2"])
        pairs = cut(both.select("src", "dst", "size1", "counts1", "size2", "counts2").mapInArrow(_may_be_similar(similarity), "src long, dst long"))
    held = pairs.groupBy("dst").agg(F.ceil(F.count("*") / TEXTS).alias("parts"))
    units = pairs.join(held, "dst").withColumn("unit", F.xxhash64("dst", F.pmod(F.xxhash64("src", F.lit(5)), F.col("parts"))))
    rows = cut(units.select("unit", F.lit(1).alias("place"), F.col("src").alias("node")).union(units.select("unit", F.lit(0), "dst").distinct()))
    wanted = rows.select("node").distinct().join(known.select("node", "first"), "node").select("node", F.col("first.doc_id").alias("_doc"), F.col("first.key").alias("_of"))
    wanted = cut(wanted)
    whole = some_of(texts.select(F.col("doc_id").alias("_id"), F.col("key").alias("_key"), "text"), wanted)[0]
    found = whole.join(wanted, whole["_id"].eqNullSafe(wanted["_doc"]) & (whole["_key"] == wanted["_of"]))
    sets = found.select("node", "text").mapInArrow(_sets(shingle), "node long, shingles binary").withColumnRenamed("node", "_node")
    whole = rows.join(sets, F.col("node") == F.col("_node"))
    whole = whole.select("unit", "place", "node", "shingles").repartition("unit").sortWithinPartitions("unit", "place")
    return whole.mapInArrow(_verify(similarity), "src long, dst long")


def similar_classes(docs: DataFrame, shingle: int = WIDE_SHINGLE, similarity: float = SIMILARITY, radius: int = WIDE_RADIUS) -> DataFrame:
    """Classes of texts whose sets of word shingles have a Jaccard similarity of ``similarity`` or more: doc_id, key (hash
    of the text), component (a document's number in the class), least (whether the row is the class's first by doc_id).

    Fingerprints of one size class that agree in a bit band are compared tile by tile; the nearest within the radius are
    then compared by their whole shingle sets. That merges most copies cheaply. Pairs that it misses are found by an
    equi-join on shingles: in one order of all shingles, frequent ones last, two sets as similar share one of the first
    fifth of each. Whole sets decide again, so the classes are exact. Texts without words are one class.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select("doc_id", text_key("text").alias("key"), F.col("text").cast("string").alias("text"))
    sized = texts.mapInArrow(_sized(shingle, similarity, _frequent(texts, shingle)), f"doc_id {kind}, key long, fp long, size long, counts binary, prefix array<long>")
    base = cut(sized.withColumn("node", F.when(F.col("size") == 0, F.lit(0)).otherwise(F.col("key"))))
    known = cut(base.groupBy("node").agg(F.min(F.struct("doc_id", "key")).alias("first"), F.min("fp").alias("fp"), F.min("size").alias("size"), F.min("counts").alias("counts")))
    worded = known.filter("size > 0").select("node", F.floor(F.log(F.col("size").cast("double")) / -math.log(similarity)).alias("kind"), "fp")
    near = fingerprint_links(worded, radius, bands=RADIUS + 1, spanning=False)
    firsts = base.filter("size > 0")
    twice = cut(firsts.select(F.explode("prefix").alias("h1")).groupBy("h1").count().filter("count > 1").select("h1"))
    sent = docs.sparkSession.sparkContext.broadcast(bit_filter(twice, FILTER_BITS))
    shared = cut(firsts.select("node", "size", "prefix").mapInArrow(_repeated(sent), "node long, size long, place long, hash long").distinct())
    # all that share a hash are first held against two of its holders, chosen anew in every round and of another class
    # than themselves: that merges large groups of near copies, whose pairs are not made then
    rows, pairs, links = shared.withColumn("part", F.col("node")), near, None
    for turn in range(STAR_ROUNDS):
        rank = F.struct(F.xxhash64("part", F.lit(turn)).alias("h"), "part", F.xxhash64("node", F.lit(turn)).alias("at"), "node", "size")
        outer = rows.groupBy("hash").agg(F.min(rank).alias("low"), F.max(rank).alias("high")).filter("low.part <> high.part")
        outer = outer.select(F.col("hash").alias("_hash"), "low", "high")
        stars = rows.join(outer, rows["hash"] == outer["_hash"]).select("node", "size", "part", F.explode(F.array("low", "high")).alias("c"))
        fair = (F.col("part") != F.col("c.part")) & (F.least("size", "c.size") >= similarity * F.greatest("size", "c.size") - 1e-6)
        stars = stars.filter(fair).select(F.col("node").alias("src"), F.col("c.node").alias("dst"))
        found = _similar_pairs(cut((pairs.union(stars) if turn == 0 else stars).distinct()), known, texts, shingle, similarity)
        links = cut(found if links is None else links.union(found))
        nodes = cut(connected_components(links))
        part = nodes.select(F.col("node").alias("_node"), "root")
        rows = shared.join(part, shared["node"] == part["_node"], "left").select("node", "size", "place", "hash", F.coalesce("root", "node").alias("part"))
    # what is left: pairs of different classes that share one of their first shingles
    shared = cut(rows)
    spread = shared.groupBy("hash").agg(F.min("part").alias("least"), F.max("part").alias("most"), F.count("*").alias("n")).filter("least <> most")
    spread = cut(spread.select(F.col("hash").alias("_hash"), F.ceil(F.col("n") / MEETING).alias("tiles")))
    met = shared.join(spread, shared["hash"] == spread["_hash"]).withColumn("chunk", F.pmod(F.xxhash64("node", F.lit(19)), F.col("tiles")))
    tiled = F.transform(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1), lambda x: F.xxhash64("hash", F.least(x, F.col("chunk")), F.greatest(x, F.col("chunk"))))
    met = met.join(known.select(F.col("node").alias("_node"), "counts"), F.col("node") == F.col("_node"))
    dealt = met.select(F.explode(tiled).alias("unit"), "size", "place", "part", "node", "counts").repartition("unit").sortWithinPartitions("unit")
    apart = cut(dealt.mapInArrow(_sharing(similarity), "a long, b long").distinct().select(F.col("a").alias("src"), F.col("b").alias("dst")))
    far = _similar_pairs(apart, known, texts, shingle, similarity, counted=True)
    nodes = connected_components(far.union(nodes.filter("node <> root").selectExpr("node as src", "root as dst"))).withColumnRenamed("node", "_node")
    out = known.join(nodes, known["node"] == nodes["_node"], "left").select("node", "first", F.coalesce("root", "node").alias("component"))
    least = out.groupBy("component").agg(F.min("first").alias("least"))
    kept = out.join(least, "component").select("node", "component", "least")
    return base.select("doc_id", "key", "node").join(kept, "node").select("doc_id", "key", "component", (F.struct("doc_id", "key") == F.col("least")).alias("least"))


def similar_dedup(docs: DataFrame, shingle: int = WIDE_SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of every class the row with the smallest doc_id (null first) stays.

    Of rows that repeat a doc_id with the same text one stays; of texts without words, null ones among them, one stays.
    """
    classes = similar_classes(docs, shingle, similarity).groupBy(F.col("doc_id").alias("_doc"), F.col("key").alias("_of"))
    judged = cut(classes.agg(F.max("least").alias("_least"), F.count("*").alias("_n")).filter("not _least or _n > 1"))
    touched, others = some_of(packed(docs), judged)
    out = touched.join(judged, touched["_id"].eqNullSafe(judged["_doc"]) & (touched["_key"] == judged["_of"]), "left").filter("coalesce(_least, true)")
    number = F.row_number().over(Window.partitionBy("_id", "_key").orderBy(F.lit(0)))
    out = out.withColumn("_copy", number).filter("_copy = 1")
    return out.select(*unpacked(docs, {})).union(others.select(*unpacked(docs, {})))


#: For near copies beyond the radius: least hashes of a band, bands, the similarity of sets that links, and rounds of stars.
BAND_ROWS, MIN_BANDS, NEAR_SIMILARITY, NEAR_ROUNDS = 2, 24, 0.5, 2


def _least_hashes(distinct: np.ndarray) -> np.ndarray:
    """Keys of the bands: hashes of the least shingles in ``BAND_ROWS`` orders each. Two sets share a band's key with their
    Jaccard similarity to the power of ``BAND_ROWS``."""
    factors = mix(np.arange(1, BAND_ROWS * MIN_BANDS + 1, dtype=np.uint64)) | np.uint64(1)
    least = np.full(len(factors), ~np.uint64(0))
    for at in range(0, len(distinct), 1 << 12):
        np.minimum(least, (distinct[at : at + (1 << 12), None] * factors).min(axis=0), out=least)
    key = np.arange(MIN_BANDS, dtype=np.uint64)
    for row in least.reshape(BAND_ROWS, MIN_BANDS):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + row)
    return key


def _signatures(shingle: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            prints, sizes, counts, keys = np.zeros(b.num_rows, np.uint64), np.zeros(b.num_rows, np.int64), [], []
            for i, x in enumerate(b.column(2)):
                hashes = list(_shingle_hashes(x.as_py(), shingle))
                prints[i], distinct = _vote(hashes), _distinct(hashes)
                sizes[i] = len(distinct)
                counts.append(np.minimum(np.bincount(distinct >> np.uint64(56), minlength=256), 255).astype(np.uint8).tobytes())
                keys.append(_least_hashes(distinct).view(np.int64))
            keys = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1) * MIN_BANDS, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *keys])))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(prints.view(np.int64)), pa.array(sizes), pa.array(counts, pa.binary()), keys], names=["doc", "key", "fp", "size", "counts", "bands"])

    return run


def _shared_bands(sent) -> Callable:
    """Rows of (key, size, bands, fp) in; a row for every band that another row may have out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hashes = b.column(2).flatten().to_numpy()
            use = np.flatnonzero(in_filter(hashes.view(np.uint64), sent.value, FILTER_BITS))
            take = pa.array(use // MIN_BANDS)
            yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), pa.array(hashes[use]), b.column(3).take(take)], names=["node", "size", "hash", "fp"])

    return run


def near_copies(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, similarity: float = NEAR_SIMILARITY) -> DataFrame:
    """``simhash_classes`` with ``near_id``: the smallest doc_id of the class when near copies beyond the radius are linked too.

    Three bits hold copies with about one word in fifty changed; in a larger group most pairs differ by more. Texts that
    share a band of least hashes are held against one of the bands' holders, in ``NEAR_ROUNDS`` rounds, chosen anew among
    other classes; whole sets of distinct shingles decide (Jaccard similarity of ``similarity`` or more). So no link is
    wrong; a pair at the similarity shares a band with a chance of 1 - (1 - similarity**2)**24 (0.999 at 0.5).
    The links by fingerprints are all kept: a class of near_id is one or more classes of component_id.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select("doc_id", text_key("text").alias("key"), F.col("text").cast("string").alias("text"))
    base = cut(texts.mapInArrow(_signatures(shingle), f"doc {kind}, key long, fp long, size long, counts binary, bands array<long>"))
    prints = cut(_rooted(base, radius))
    worded = base.filter("size > 0")
    twice = worded.select(F.explode("bands").alias("h1")).groupBy("h1").count().filter("count > 1").select("h1")
    sent = docs.sparkSession.sparkContext.broadcast(bit_filter(cut(twice), FILTER_BITS))
    rows = worded.select("key", "size", "bands", "fp").mapInArrow(_shared_bands(sent), "node long, size long, hash long, fp long").distinct()
    first = F.min(F.struct(F.col("doc").alias("doc_id"), "key")).alias("first")
    known = worded.groupBy(F.col("key").alias("node")).agg(first, F.min("size").alias("size"), F.min("counts").alias("counts"), F.min("fp").alias("fp"))
    classes, links = prints.select("fp", F.col("root").alias("part")), prints.filter("fp <> root").selectExpr("fp as src", "root as dst")
    for turn in range(NEAR_ROUNDS):
        parted = cut(rows.select("node", "size", "hash", "fp").join(classes, "fp"))
        rank = F.struct(F.xxhash64("part", F.lit(turn)).alias("h"), "part", F.xxhash64("node", F.lit(turn)).alias("at"), "node", "size", "fp")
        outer = parted.groupBy("hash").agg(F.min(rank).alias("low"), F.max(rank).alias("high")).filter("low.part <> high.part")
        outer = outer.select(F.col("hash").alias("_hash"), "low", "high")
        stars = parted.join(outer, parted["hash"] == outer["_hash"]).select("node", "size", "part", "fp", F.explode(F.array("low", "high")).alias("c"))
        fair = (F.col("part") != F.col("c.part")) & (F.least("size", "c.size") >= similarity * F.greatest("size", "c.size") - 1e-6)
        stars = stars.filter(fair).groupBy("node", "fp", F.col("c.node").alias("dst"), F.col("c.fp").alias("to")).count()
        # of the holders met, a text is held against the one with which it shares the most bands
        best = stars.groupBy("node", "fp").agg(F.max(F.struct("count", "dst", "to")).alias("c"))
        best = cut(best.select(F.col("node").alias("src"), "c.dst", F.col("fp").alias("_fp"), F.col("c.to").alias("_to")))
        found = _similar_pairs(best.select("src", "dst"), known, texts, shingle, similarity)
        links = cut(links.union(found.join(best, ["src", "dst"]).select(F.col("_fp").alias("src"), F.col("_to").alias("dst"))))
        nodes = connected_components(links)
        classes = cut(prints.select("fp").join(nodes, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("root", "fp").alias("part")))
        rows = parted
    both = cut(prints.join(classes, "fp"))
    component = both.groupBy("root").agg(F.min("first").alias("component_id"))
    near = both.groupBy("part").agg(F.min("first").alias("near_id"))
    out = base.select("doc", "fp").join(both.join(component, "root").join(near, "part").select("fp", "component_id", "near_id"), "fp")
    return out.select(F.col("doc").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "near_id")
