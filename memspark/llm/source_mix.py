"""Mixing sources to target weights by a low-discrepancy schedule, with DataFrame functions only.

The points of a van der Corput sequence are mapped through the sources' cumulative target shares, so each point is a slot
of one source. A source's target is cut into as many blocks of equal token number as it has slots; its slots are ranked by
time, and the r-th takes the r-th block from the source's shuffled stream of documents, which starts again when it is used
up. As the sequence's discrepancy is low, blocks are of nearly one size in all sources, and every source gives its target.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memspark.llm.common import cut, text_key

WEIGHTS = (5, 2, 1)
MOST_REPEATS = 3
#: Words of a block, or more where there would be more than MOST_SLOTS blocks.
BLOCK_TOKENS, MOST_SLOTS = 64, 1 << 20
_SLOTS_AT_ONCE = 4096
#: Blocks of a stream's cells, by which documents and slots meet.
_BLOCKS_IN_CELL = 4
WORD = r"[^\x20\x09-\x0D]+"


def size_of(text: Column | str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = MOST_REPEATS) -> DataFrame:
    """Per source: rank, source_size, total, target, and the cumulative targets before it.

    One row per source goes through an ordered window; the sources, not the documents, meet there.
    """
    by = Window.orderBy(F.col("source").asc_nulls_last())
    out = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    out = out.withColumn("rank", F.row_number().over(by) - 1)
    out = out.withColumn("weight", F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), (F.col("rank") % len(weights) + 1).cast("int")))
    full = F.lit(repeats).cast("long") * F.col("source_size")
    tight = Window.orderBy((full / F.col("weight")).asc(), "rank")
    out = out.withColumn("total", F.sum("source_size").over(Window.partitionBy()))
    before = F.coalesce(F.sum(full).over(tight.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    onward = F.sum("weight").over(tight.rowsBetween(0, Window.unboundedFollowing))
    out = out.withColumn("free", F.col("total") - before).withColumn("onward", onward)
    # the first source, by tightness, that its fair share does not fill up: it and all later ones share what is left
    level = F.when(F.col("free") * F.col("weight") <= full * F.col("onward"), F.struct(F.col("free").alias("free"), F.col("onward").alias("onward")))
    out = out.withColumn("level", F.first(level, ignorenulls=True).over(tight.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    fair = F.col("weight") * F.col("level.free") / F.col("level.onward")
    out = out.withColumn("target", F.when(full * F.col("level.onward") < F.col("weight") * F.col("level.free"), full.cast("double")).otherwise(fair))
    out = out.withColumn("whole", F.floor("target").cast("long"))
    ahead = F.coalesce(F.sum("whole").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return out.select("source", "rank", "source_size", "total", "target", "whole", ahead.alias("ahead"), F.sum("whole").over(Window.partitionBy()).alias("every"))


def block_size(targets: DataFrame, block_tokens: int = BLOCK_TOKENS) -> int:
    found = targets.select("every").head()
    return max(block_tokens, -(-(found.every if found else 0) // MOST_SLOTS))


def slots(targets: DataFrame, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """The schedule: slot (time), rank of its source, number (rank among the source's slots), and its tokens
    [first, stop) in the source's endlessly repeated stream.

    There are as many slots as blocks fill the sum of the targets. A source's slots share its target equally, to a word; one
    too small for a slot of its own has one, at the first point of its share.
    """
    found = targets.select("every").head()
    points = max(1, -(-(found.every if found else 0) // block_size(targets, block_tokens)))
    bits = max(1, math.ceil(math.log2(points)))
    edge = lambda c: F.expr(f"(cast({c} as decimal(20, 0)) * cast({1 << bits} as decimal(17, 0)) + every - 1) div every")
    own = targets.filter("whole > 0").select("rank", "source_size", "whole", edge("ahead").alias("low"), edge("ahead + whole").alias("high"))
    own = own.withColumn("low", F.least("low", F.lit((1 << bits) - 1)))
    own = own.withColumn("part", F.explode(F.sequence(F.expr(f"low div {_SLOTS_AT_ONCE}"), F.expr(f"greatest(low, high - 1) div {_SLOTS_AT_ONCE}"))))
    own = own.repartition(max(1, min(4096, (1 << bits) // _SLOTS_AT_ONCE)), "rank", "part")
    at = F.lit(_SLOTS_AT_ONCE)
    own = own.withColumn("point", F.explode(F.sequence(F.greatest("low", F.col("part") * at), F.least(F.greatest("high", F.col("low") + 1), (F.col("part") + 1) * at) - 1)))
    time = F.conv(F.reverse(F.lpad(F.bin("point"), bits, "0")), 2, 10).cast("long")
    own = own.select("rank", "source_size", "whole", time.alias("slot"), (F.col("point") == F.col("low")).alias("head"))
    # the first point stands in for a source without a point in time
    own = own.filter((F.col("slot") < points) | F.col("head")).withColumn("timely", F.col("slot") < points)
    own = own.withColumn("era", F.shiftright("slot", bits // 2))
    eras = own.groupBy("rank", "era").agg(F.count_if("timely").alias("count"))
    of_rank = Window.partitionBy("rank")
    earlier = F.coalesce(F.sum("count").over(of_rank.orderBy("era").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    eras = eras.select("rank", "era", earlier.alias("earlier"), F.sum("count").over(of_rank).alias("n"))
    own = own.hint("merge").join(eras, ["rank", "era"]).filter("timely or n = 0").withColumn("n", F.greatest("n", F.lit(1)))
    own = own.withColumn("number", F.col("earlier") + F.row_number().over(Window.partitionBy("rank", "era").orderBy("slot")) - 1)
    start, stop = (F.expr(f"(number + {i}) * (whole div n) + least(number + {i}, whole % n)") for i in (0, 1))
    return own.select("slot", "rank", "source_size", "number", start.alias("first"), stop.alias("stop")).filter("first < stop")


_OUTCOME = ("size", "source_size", "target", "taken")


def _placed(docs: DataFrame, weights: tuple[int, ...], repeats: int, block_tokens: int, seed: int, keep: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """Document rows (row, kept, size, source_size, target), and the pieces of them that slots take (row, slot, first, stop)."""
    packed = F.struct(*[F.col(f"`{c}`").alias(c) for c in keep])
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("doc_id").cast("string")))
    base = docs.select(packed.alias("kept"), F.monotonically_increasing_id().alias("row"), F.col("source"), order.alias("order"), F.col("doc_id").alias("id"), text_key("text").alias("key"), size_of("text").alias("size"))
    base = cut(base)
    targets = cut(source_targets(base.select("source", "size"), weights, repeats))
    named = targets.select(F.col("source").alias("of"), "rank", "source_size", "target")
    sourced = base.join(named, base["source"].eqNullSafe(named["of"])).drop("of", "source")
    buckets = max(1, math.isqrt(base.count()))
    bucket = F.floor(F.conv(F.substring("order", 1, 8), 16, 10).cast("long") * buckets / (1 << 32))
    worded = sourced.filter("size > 0").select("row", "rank", "order", "id", "key", "size", bucket.alias("bucket"))
    sums = worded.groupBy("rank", "bucket").agg(F.sum("size").alias("held"))
    ahead = F.coalesce(F.sum("held").over(Window.partitionBy("rank").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.coalesce(F.sum("size").over(Window.partitionBy("rank", "bucket").orderBy("order", "id", "size", "key").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = worded.withColumn("inside", inside).hint("merge").join(sums.select("rank", "bucket", ahead.alias("before")), ["rank", "bucket"])
    placed = placed.select("row", "rank", (F.col("inside") + F.col("before")).alias("start"), (F.col("inside") + F.col("before") + F.col("size")).alias("end"))
    width = block_size(targets, block_tokens) * _BLOCKS_IN_CELL
    cell = lambda c: F.expr(f"({c}) div {width}")
    blocks = placed.withColumn("cell", F.explode(F.sequence(cell("start"), cell("end - 1"))))
    used = slots(targets, block_tokens)
    used = used.withColumn("turn", F.explode(F.sequence(F.expr("first div source_size"), F.expr("(stop - 1) div source_size"))))
    used = used.select("slot", "rank", F.greatest(F.col("first") - F.col("turn") * F.col("source_size"), F.lit(0)).alias("from"), F.least(F.col("stop") - F.col("turn") * F.col("source_size"), F.col("source_size")).alias("to"))
    used = used.withColumn("cell", F.explode(F.sequence(cell("`from`"), cell("`to` - 1"))))
    low, high = F.greatest("start", "from", F.col("cell") * width), F.least("end", "to", (F.col("cell") + 1) * width)
    # a few rows burst into many after the last exchange: their size must not be taken for that of the join's sides
    pieces = blocks.hint("merge").join(used, ["rank", "cell"]).filter(low < high)
    return sourced, pieces.select("row", "slot", (low - F.col("start")).alias("first"), (high - F.col("start")).alias("stop"))


def mix_schedule(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = MOST_REPEATS, block_tokens: int = BLOCK_TOKENS, seed: int = 0) -> DataFrame:
    """The mixed order: slot (time), doc_id and the words [first, stop) of the document that come then.

    Arguments and edge cases as in ``source_mix``.
    """
    base, pieces = _placed(docs, weights, repeats, block_tokens, seed, ("doc_id",))
    return pieces.join(base.select("row", "kept.doc_id"), "row").select("slot", "doc_id", "first", "stop")


def source_mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = MOST_REPEATS, block_tokens: int = BLOCK_TOKENS, seed: int = 0, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Words that the mix takes of every document row: the columns ``keep``, size, source_size, target, taken.

    ``docs`` needs doc_id, source and text; other columns are ignored unless named in ``keep``, and those that have the name of
    an outcome give way to it. A source's stream is its documents in the order of a hash of seed and doc_id; it gives
    its target in whole words, repeats counted, so no document gives more than ``repeats`` times its size. Null texts and texts without words have size 0 and give nothing; a null source is a
    source of its own, ranked last. Rows that repeat a doc_id are documents of their own, ordered by size and a hash of
    the text. An empty table gives no rows.
    """
    keep = tuple(c for c in keep if c not in _OUTCOME)
    base, pieces = _placed(docs, weights, repeats, block_tokens, seed, keep)
    taken = pieces.groupBy("row").agg(F.sum(F.col("stop") - F.col("first")).alias("taken"))
    out = base.join(taken, "row", "left")
    return out.select(*[F.col(f"kept.`{c}`").alias(c) for c in keep], "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
