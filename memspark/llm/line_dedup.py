"""Line dedup by content-defined chunks, with DataFrame functions only.

A document's lines are hashed; a rolling hash of neighbouring line hashes decides where a chunk begins, so a passage keeps
its chunks wherever it stands. Chunks of several lines that occur more than once go, but for the first copy, where their
bytes equal that copy's. ``passage_dedup`` chunks in two sizes (bimodal chunking): what no whole chunk takes, first copies
and seams included, is chunked again by two lines, so that a repeated passage goes whole wherever it begins and ends.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memspark.llm.common import cut, packed, some_of, text_key, unpacked

#: Hex digits that begin the rolling hash at a chunk's first line: a chunk has 16 / DIGITS lines in the mean.
DIGITS = 4
LEAST_LINES = 2


def _with(value: Column, of: Callable[[Column], Column]) -> Column:
    """``of(value)``, with the value worked out once for all lambdas in it."""
    return F.element_at(F.transform(F.array(value), of), 1)


def _lines(text: Column | str) -> Column:
    return F.split(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), "\n", -1)


def _count(array: str) -> Column:
    return F.when(F.col(array).isNull(), 0).otherwise(F.size(array))


def _spans(n: Column, digest: Callable[[Column], Column]) -> Column:
    """All chunks of ``n`` lines as array<struct<from, lines>>; ``from`` is the first line's number from 0, ``digest`` gives
    the MD5 of a line by its number."""
    roll = lambda i: F.md5(F.concat(digest(i - 1), digest(i)))
    begins = F.when(n > 1, F.filter(F.sequence(F.lit(1), n - 1), lambda i: F.substring(roll(i), 1, 1) < F.lit(f"{DIGITS:x}"))).otherwise(F.expr("cast(array() as array<int>)"))
    between = lambda e: F.transform(F.sequence(F.lit(0), F.size(e) - 2), lambda i: F.struct(F.get(e, i).alias("from"), (F.get(e, i + 1) - F.get(e, i)).alias("lines")))
    return _with(F.concat(F.array(F.lit(0)), begins, F.array(n)), between)


def _chunks(text: Column) -> Column:
    """Chunks of several lines as array<struct<from, lines, hash>>."""

    def of(hashed: Column) -> Column:
        spans = F.filter(_spans(F.size(hashed), lambda i: F.get(hashed, i)), lambda s: s["lines"] >= LEAST_LINES)
        return F.transform(spans, lambda s: F.struct(s["from"].alias("from"), s["lines"].alias("lines"), F.unhex(F.md5(F.array_join(F.slice(hashed, s["from"] + 1, s["lines"]), ""))).alias("hash")))

    return _with(F.transform(_lines(text), lambda x: F.md5(x)), of)


def repeated_chunks(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Occurrences of chunks that occur more than once: those to remove as (doc_id, key, from, lines, hash), and the
    first copies as (hash, doc_id, key, from, lines)."""
    found = cut(docs.select("doc_id", text_key("text").alias("key"), _chunks(F.col("text").cast("string")).alias("chunks")).filter(F.size("chunks") > 0))
    rows = found.select("doc_id", "key", F.explode("chunks").alias("c")).select("doc_id", "key", "c.from", "c.lines", "c.hash")
    place = F.struct("doc_id", "key", "from")
    firsts = rows.groupBy("hash").agg(F.min(place).alias("first"), F.max(place).alias("last"), F.min("lines").alias("lines")).filter("first <> last")
    firsts = cut(firsts.select("hash", "first", "lines"))
    later = rows.join(firsts.select("hash", "first"), "hash").filter((F.struct("doc_id", "key", "from") != F.col("first")))
    return later.drop("first"), firsts.select("hash", "first.doc_id", "first.key", "first.from", "lines")


def _matched(docs: DataFrame, later: DataFrame, firsts: DataFrame) -> DataFrame:
    """``docs`` packed, with ``_drops``: of their ``later`` chunks (hash, doc_id, key, from, lines, over) those whose bytes
    equal the first copy's in ``firsts``, as array<struct<from, lines, over>>; null where a document has none."""
    piece = lambda lines, at: F.array_join(F.slice(lines, at["from"] + 1, at["lines"]), "\n")
    same = lambda a, b: a["_id"].eqNullSafe(b["_doc"]) & (a["_key"] == b["_of"])
    whole = packed(docs)
    per_doc = cut(firsts.groupBy(F.col("doc_id").alias("_doc"), F.col("key").alias("_of")).agg(F.collect_set(F.struct("hash", "from", "lines")).alias("_wanted")))
    slim = some_of(whole.select("_id", "_key", "_text"), per_doc)[0]
    kept = slim.join(per_doc, same(slim, per_doc))
    kept = kept.select(F.explode(_with(_lines("_text"), lambda lines: F.transform("_wanted", lambda w: F.struct(w["hash"].alias("hash"), piece(lines, w).alias("bytes"))))).alias("w"))
    kept = cut(kept.select("w.*").groupBy("hash").agg(F.first("bytes").alias("bytes")))
    drops = cut(later.join(kept, "hash").groupBy(F.col("doc_id").alias("_doc"), F.col("key").alias("_of")).agg(F.collect_set(F.struct("from", "lines", "over", "bytes")).alias("_drops")))
    touched, others = some_of(whole, drops)
    out = touched.join(drops, same(touched, drops), "left").drop("_doc", "_of")
    equal = _with(_lines("_text"), lambda lines: F.filter("_drops", lambda d: piece(lines, d) == d["bytes"]))
    equal = F.transform(equal, lambda d: F.struct(d["from"].alias("from"), d["lines"].alias("lines"), d["over"].alias("over")))
    out = out.withColumn("_drops", F.when(F.size(equal) > 0, equal))
    return out.union(others.withColumn("_drops", F.lit(None).cast(out.schema["_drops"].dataType)))


def _left(lines: Column, gone: Column) -> Column:
    """What stands between the lines ``gone`` (ascending numbers), the document's ends counting as such."""
    between = lambda s: F.transform(F.sequence(F.lit(0), F.size(s["e"]) - 2), lambda i: F.slice(s["lines"], F.get(s["e"], i) + 2, F.get(s["e"], i + 1) - F.get(s["e"], i) - 1))
    edges = F.concat(F.array(F.lit(-1)), gone, F.array(F.size(lines)))
    return F.array_join(F.flatten(_with(F.struct(lines.alias("lines"), edges.alias("e")), between)), "\n")


def line_dedup(docs: DataFrame) -> DataFrame:
    """``docs`` with repeated multi-line chunks cut out of text: its columns, then n_lines, n_removed (lines) and
    n_chunks (removed).

    ``docs`` needs doc_id and text. The first copy, by doc_id (null first) then hash of the text then line, stays. Lines
    are what stands between line feeds; an empty or null text is one empty line and stays as it is. Rows that repeat a doc_id
    with the same text count as one document and stay alike. An empty table gives no rows.
    """
    later, firsts = repeated_chunks(docs)
    out = _matched(docs, later.withColumn("over", F.lit(False)), firsts)
    gone = F.array_sort(F.flatten(F.transform("_drops", lambda d: F.sequence(d["from"], d["from"] + d["lines"] - 1))))
    out = out.withColumn("_gone", gone)
    outcome = {
        "text": F.when(F.col("_gone").isNull(), F.col("_text")).otherwise(_left(_lines("_text"), F.col("_gone"))),
        "n_lines": F.size(_lines("_text")).cast("long"), "n_removed": _count("_gone").cast("long"), "n_chunks": _count("_drops").cast("long"),
    }
    return out.select(*unpacked(docs, outcome))


def _two_sizes(text: Column) -> Column:
    """All chunks as array<struct<from, lines, hash, pairs>>: ``hash`` is null for a single line, ``pairs`` are the chunks of
    two lines that begin in the chunk, but for two blank ones, as array<struct<from, hash>>; the last reaches into the next
    chunk. Hashes are half of a SHA-256."""
    half = lambda x: F.substring(F.unhex(F.sha2(x, 256)), 1, 16)
    hashed = F.transform(_lines(text), lambda x: F.struct(F.md5(x).alias("md5"), F.sha2(x, 256).alias("sha"), x.rlike("\\S").alias("worded")))

    def of(line: Column) -> Column:
        n = F.size(line)
        worded = lambda i: (i + 1 < n) & (F.get(line, i)["worded"] | F.get(line, i + 1)["worded"])
        pair = lambda i: F.struct(i.alias("from"), half(F.concat(F.get(line, i)["sha"], F.get(line, i + 1)["sha"])).alias("hash"))
        whole = lambda s: half(F.concat(F.lit("+"), F.array_join(F.transform(F.slice(line, s["from"] + 1, s["lines"]), lambda x: x["sha"]), "")))  # noqa: E731  no pair's hash
        pairs = lambda s: F.transform(F.filter(F.sequence(s["from"], s["from"] + s["lines"] - 1), worded), pair)
        spans = F.transform(_spans(n, lambda i: F.get(line, i)["md5"]), lambda s: F.struct(s["from"].alias("from"), s["lines"].alias("lines"), F.when(s["lines"] >= LEAST_LINES, whole(s)).alias("hash"), pairs(s).alias("pairs")))
        return F.filter(spans, lambda s: F.size(s["pairs"]) > 0)

    return _with(hashed, of)


def repeated_passages(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """As ``repeated_chunks`` in two sizes: later copies with ``over`` (whether the first line is the first copy's last),
    and the first copies. Chunks of two lines are only sought outside the later copies of larger ones: a later copy
    can't hold the first of anything."""
    place = F.struct("doc_id", "key", "from")
    more = lambda rows: cut(rows.groupBy("hash").agg(F.min(place).alias("first"), F.max(place).alias("last"), F.min("lines").alias("lines")).filter("first <> last").select("hash", "first", "lines"))
    found = cut(docs.select("doc_id", text_key("text").alias("key"), _two_sizes(F.col("text").cast("string")).alias("chunks")).filter(F.size("chunks") > 0))
    rows = found.select("doc_id", "key", F.explode("chunks").alias("c")).select("doc_id", "key", "c.*")
    large = rows.filter(F.col("hash").isNotNull())
    large_firsts = more(large)
    is_later = F.coalesce(place != F.col("first"), F.lit(False))
    large = cut(large.join(large_firsts.select("hash", "first"), "hash", "left").select("hash", "doc_id", "key", "from", "lines", is_later.alias("later"), "pairs"))
    seam = F.filter("pairs", lambda p: p["from"] == F.col("from") + F.col("lines") - 1)
    unmatched = large.select("doc_id", "key", F.when(F.col("later"), seam).otherwise(F.col("pairs")).alias("pairs")).union(rows.filter(F.col("hash").isNull()).select("doc_id", "key", "pairs"))
    small = unmatched.select("doc_id", "key", F.explode("pairs").alias("p")).select("p.hash", "doc_id", "key", "p.from", F.lit(2).alias("lines"))
    small_firsts = more(small)
    over = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("key") == F.col("first.key")) & (F.col("from") == F.col("first.from") + 1)
    small = small.join(small_firsts.select("hash", "first"), "hash").filter(place != F.col("first")).select("hash", "doc_id", "key", "from", "lines", over.alias("over"))
    later = large.filter("later").select("hash", "doc_id", "key", "from", "lines", F.lit(False).alias("over")).union(small)
    return later, large_firsts.union(small_firsts).select("hash", "first.doc_id", "first.key", "first.from", "lines")


def passage_dedup(docs: DataFrame) -> DataFrame:
    """``docs`` with repeated passages of two lines or more cut out of text: its columns, then n_lines, n_removed (lines)
    and n_chunks (runs of removed lines).

    A line goes if it and a neighbour occur as adjacent lines before: in a smaller doc_id (null first), in one of the same
    doc_id with a smaller hash of the text, or farther up; in a document's own first copy of the two it stays. Two blank
    lines alone are no passage. Otherwise as ``line_dedup``.
    """
    out = _matched(docs, *repeated_passages(docs))

    def gone(s: Column) -> Column:
        worded = lambda i: F.get(s["lines"], i).rlike("\\S") | F.get(s["lines"], i + 1).rlike("\\S")
        of = lambda d: F.flatten(F.transform(F.filter(F.sequence(d["from"], d["from"] + d["lines"] - 2), worded), lambda i: F.when(d["over"], F.array(i + 1)).otherwise(F.array(i, i + 1))))
        return F.array_sort(F.array_distinct(F.flatten(F.transform(s["drops"], of))))

    all_gone = _with(F.struct(_lines("_text").alias("lines"), F.col("_drops").alias("drops")), gone)
    out = out.withColumn("_gone", F.when(F.col("_drops").isNotNull(), all_gone))
    runs = F.size(F.filter("_gone", lambda x, i: (i == 0) | (x - F.get("_gone", i - 1) > 1)))
    removed = _count("_gone")
    outcome = {
        "text": F.when(removed > 0, _left(_lines("_text"), F.col("_gone"))).otherwise(F.col("_text")),
        "n_lines": F.size(_lines("_text")).cast("long"), "n_removed": removed.cast("long"), "n_chunks": F.when(removed > 0, runs).otherwise(0).cast("long"),
    }
    return out.select(*unpacked(docs, outcome))
