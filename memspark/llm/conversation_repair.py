"""Repair of conversation structure: the cheapest edits that make roles alternate, by a Viterbi search in parallel chunks.

Rows are sorted over the cluster by conversation and turn and cut into chunks. What may come next depends on four states
(nothing yet, after a system row, after a user row, after an assistant row), so the costs from a place to the end are a
vector of four. A conversation within one chunk is solved at once. Of a longer one every chunk runs backward from
speculative vectors, one for each state it may end in. Where all of a chunk's results differ only by constants, its costs are
known up to a constant whatever follows; fix-up passes let the other chunks run on over what follows them, twice as far with
every pass, until theirs do so too. With the costs of its end stitched in, each chunk traces the edits forward from every
state it may be entered in, entries are linked in the same way, and every chunk writes its edits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memspark.llm.common import cut

#: Rows and characters of a chunk at most, but one row at least.
CHUNK_ROWS, CHUNK_CHARS = 1024, 1 << 20
#: Cells (rows of chunks, padded) that are solved together.
CELLS = 1 << 18
SPACES = " \t\n\x0b\x0c\r"
START, SYSTEM, USER, ASSISTANT = range(4)
INITIALS = {"s": 0, "u": 1, "a": 2}
OTHER, TRUNCATED, FORCED, NO_ROW = 3, 4, 8, 16
KEEP, REROLE, DELETE, INSERT, CUT_OFF = 0, 2, 3, 2, 1
NEVER = 1 << 20
#: State after an inserted or rerolled row, and after a kept one (by initial; -1 is not allowed).
AFTER_INSERT = np.array([USER, USER, ASSISTANT, USER])
AFTER_KEEP = np.array([[SYSTEM, USER, -1, -1], [-1, USER, -1, -1], [-1, -1, ASSISTANT, -1], [-1, USER, -1, -1]])
ROLE_OF = {USER: "user", ASSISTANT: "assistant"}
PAD, D, K, R = range(4)


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Min-plus products of stacks of matrices."""
    return (a[..., :, :, None] + b[..., None, :, :]).min(axis=-2)


def _tables() -> tuple[np.ndarray, np.ndarray]:
    inserts = np.where(np.eye(4, dtype=bool), 0, NEVER)
    inserts[np.arange(4), AFTER_INSERT] = INSERT
    inserts = _times(inserts, _times(inserts, inserts))
    steps = np.full((17, 4, 4), NEVER)
    for code, q in product(range(16), range(4)):
        initial, late, forced = code & 3, CUT_OFF * (code & TRUNCATED > 0), code & FORCED
        steps[code, q, q] = DELETE
        if not forced:
            steps[code, q, AFTER_INSERT[q]] = min(steps[code, q, AFTER_INSERT[q]], REROLE + late)
            if AFTER_KEEP[q, initial] >= 0:
                steps[code, q, AFTER_KEEP[q, initial]] = min(steps[code, q, AFTER_KEEP[q, initial]], KEEP + late)
    steps[:16] = _times(np.broadcast_to(inserts, (16, 4, 4)), steps[:16])
    steps[NO_ROW] = np.where(np.eye(4, dtype=bool), 0, NEVER)
    return np.minimum(steps, NEVER), np.minimum((inserts + np.array([0, NEVER, NEVER, 0])).min(axis=1), NEVER)


#: Costs over one row (by code, state before and after), and from every state at a conversation's end.
STEPS, AT_END = _tables()
#: All cost vectors that can occur, up to constants: inserts and deletions bound how far states differ.
POSSIBLE = np.array([(x, s, u, 0) for u in range(-2, 3) for s in range(0, 3 + u) for x in range(-3, 3 + u)])


def _padded(codes: list[np.ndarray]) -> np.ndarray:
    """Codes of chunks as rows of one matrix, at its right end."""
    out = np.full((len(codes), max(map(len, codes), default=0)), NO_ROW, np.uint8)
    for row, c in zip(out, codes, strict=True):
        row[len(row) - len(c) :] = c
    return out


def _blocks(codes: list[np.ndarray]) -> Iterator[np.ndarray]:
    """Numbers of chunks of like length, so many that their matrix has about CELLS cells."""
    order = np.argsort([len(c) for c in codes], kind="stable")
    at = 0
    while at < len(order):
        end = at + 1
        while end < len(order) and (end - at + 1) * max(1, len(codes[order[end]])) <= CELLS:
            end += 1
        yield order[at:end]
        at = end


def chunk_costs(codes: list[np.ndarray]) -> np.ndarray:
    """Cheapest costs through every chunk, by the state before it and the state after it."""
    out = np.empty((len(codes), 4, 4), np.int64)
    for block in _blocks(codes):
        matrix = _padded([codes[i] for i in block])
        costs = np.broadcast_to(STEPS[NO_ROW], (len(block), 4, 4))
        for i in range(matrix.shape[1] - 1, -1, -1):
            costs = np.minimum(_times(STEPS[matrix[:, i]], costs), NEVER)
        out[block] = costs
    return out


def trace(codes: list[np.ndarray], ends: np.ndarray, entries: np.ndarray, last: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray, np.ndarray]:
    """The least cheapest edits of every chunk, given the costs at its end and the state it is entered in.

    Returns each chunk's edits (D, K, R), the inserts before each of its rows and, if it is the last one, behind them, the
    state it is left in, and what the edits cost.
    """
    edits, inserts = [None] * len(codes), [None] * len(codes)
    exits, paid = np.empty(len(codes), np.int64), np.empty(len(codes), np.int64)
    for block in _blocks(codes):
        matrix = _padded([codes[i] for i in block])
        n, width = matrix.shape
        costs = np.empty((width + 1, n, 4), np.int64)
        costs[width] = ends[block]
        for i in range(width - 1, -1, -1):
            costs[i] = (STEPS[matrix[:, i]] + costs[i + 1][:, None, :]).min(axis=2)
        lane, state, total = np.arange(n), entries[block].copy(), np.zeros(n, np.int64)
        done, added = np.zeros((n, width), np.uint8), np.zeros((n, width + 1), np.uint8)
        for i in range(width):
            code = matrix[:, i]
            late, free = CUT_OFF * (code & TRUNCATED > 0), code & FORCED == 0
            open_ = code != NO_ROW
            while open_.any():
                best = costs[i][lane, state]
                kept = AFTER_KEEP[state, code & 3]
                delete = open_ & (DELETE + costs[i + 1][lane, state] == best)
                insert = open_ & ~delete & (INSERT + costs[i][lane, AFTER_INSERT[state]] == best)
                keep = open_ & ~delete & ~insert & free & (kept >= 0) & (late + costs[i + 1][lane, kept] == best)
                rerole = open_ & ~delete & ~insert & ~keep
                for chosen, letter in ((delete, D), (keep, K), (rerole, R)):
                    done[chosen, i] = letter
                added[:, i] += insert
                total += np.select([delete, insert, keep, rerole], [DELETE, INSERT, late, REROLE + late], 0)
                state = np.where(keep, kept, np.where(insert | rerole, AFTER_INSERT[state], state))
                open_ = insert
        open_ = last[block] & (costs[width][lane, state] > 0)
        while open_.any():
            added[:, width] += open_
            total += INSERT * open_
            state = np.where(open_, AFTER_INSERT[state], state)
            open_ &= costs[width][lane, state] > 0
        for j, i in enumerate(block):
            start = width - len(codes[i])
            edits[i], inserts[i] = done[j, start:], added[j, start:]
        exits[block], paid[block] = state, total
    return edits, inserts, exits, paid


def damage(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) with faults, chosen by crc32 of ``conv_id:turn`` modulo 20: 0 drops a row, 1 empties its
    text, 2 takes its full stops, exclamation and question marks, 3 repeats it, 4 sets its role to user. Nulls, in that key too, become one space."""
    known = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), known("role").alias("role"), known("text").alias("text"),
        (F.crc32(F.concat(known("conv_id"), F.lit(":"), known("turn")).cast("binary")) % 20).alias("kind"),
    ).filter("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.array_repeat(F.lit(0), F.when(F.col("kind") == 3, 2).otherwise(1)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("_copy")).drop("_copy")


_CHUNK = (
    "conv_id long, part int, ordinal long, continues boolean, continued boolean, least_turn long, most_turn long, turns long, first_turn long, last_turn long, "
    "codes binary, digests binary, roles array<string>, texts array<string>"
)


def _chunk(conv: int | None, rows: list[tuple], part: int, ordinal: int, continues: bool, continued: bool) -> dict:
    codes, digests, known = np.empty(len(rows), np.uint8), [], set()
    for i, (_, role, text) in enumerate(rows):
        bare = text.rstrip(SPACES)
        code = INITIALS.get(role[:1], OTHER)
        mark = hashlib.blake2b(f"{conv}:{len(role)}:{role}{text}".encode(), digest_size=16).digest()
        if not bare or mark in known:
            code |= FORCED
        elif bare[-1] not in ".!?":
            code |= TRUNCATED
        known.add(mark)
        codes[i] = code
        digests.append(mark)
    turns = [t for t, _, _ in rows if t is not None]
    return {
        "conv_id": conv, "part": part, "ordinal": ordinal, "continues": continues, "continued": continued, "least_turn": turns[0] if turns else None, "most_turn": turns[-1] if turns else None,
        "turns": len(set(turns)), "first_turn": rows[0][0], "last_turn": rows[-1][0], "codes": codes.tobytes(), "digests": b"".join(digests), "roles": [r for _, r, _ in rows], "texts": [t for _, _, t in rows],
    }


def _arrow(schema: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary(), "string": pa.string(), "array<string>": pa.list_(pa.string()), "array<int>": pa.list_(pa.int32())}
    return pa.schema([(name, kinds[kind]) for name, kind in (c.strip().split(" ", 1) for c in schema.split(", "))])


def _in_batches(rows: Iterator[tuple[dict, int]], schema: str) -> Iterator[pa.RecordBatch]:
    """Record batches of about CHUNK_CHARS characters."""
    held, size, kind = [], 0, _arrow(schema)
    for row, weight in rows:
        held.append(row)
        size += weight
        if size >= CHUNK_CHARS:
            yield pa.RecordBatch.from_pylist(held, kind)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, kind)


def _cut_chunks(most: int) -> Callable:
    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, int]]:
        part, rows, conv, chars, ordinal, continues = TaskContext.get().partitionId(), [], None, 0, 0, False
        for batch in batches:
            for c, turn, role, text in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if rows and (c != conv or len(rows) >= most or chars + len(text) > CHUNK_CHARS):
                    yield _chunk(conv, rows, part, ordinal, continues, c == conv), chars + 100 * len(rows)
                    rows, chars, ordinal, continues = [], 0, ordinal + 1, c == conv
                conv = c
                rows.append((turn, role, text))
                chars += len(text)
        if rows:
            yield _chunk(conv, rows, part, ordinal, continues, False), chars

    return lambda batches: _in_batches(chunks(batches), _CHUNK)


def _chunks(rows: DataFrame, most: int) -> DataFrame:
    """Sorted chunks with a dense ``id`` and whether each is the first and the last of its conversation."""
    known = [F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")]]
    order = ["conv_id", "turn", "role", "_head", "_hash", "_row"]
    placed = rows.select(*known).select("*", F.substring("text", 1, 64).alias("_head"), F.xxhash64("text").alias("_hash"), F.monotonically_increasing_id().alias("_row"))
    chunks = cut(placed.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "turn", "role", "text").mapInArrow(_cut_chunks(most), _CHUNK))
    # one row for a partition, whatever its rows: where its numbers begin and whether its first and last chunks go on beyond it
    ends = chunks.groupBy("part").agg(F.count("*").alias("n"), F.min_by("conv_id", "ordinal").alias("head"), F.max_by("conv_id", "ordinal").alias("tail")).orderBy("part").collect()
    places, offset = [], 0
    for i, e in enumerate(ends):
        places.append((e["part"], offset, e["n"], i > 0 and ends[i - 1]["tail"] == e["head"], i + 1 < len(ends) and ends[i + 1]["head"] == e["tail"]))
        offset += e["n"]
    places = rows.sparkSession.createDataFrame(places, "part int, offset long, n long, from_before boolean, goes_on boolean")
    linked = chunks.join(F.broadcast(places), "part")
    first, last = F.expr("not (continues or (ordinal = 0 and from_before))"), F.expr("not (continued or (ordinal = n - 1 and goes_on))")
    return linked.select((F.col("offset") + F.col("ordinal")).alias("id"), first.alias("first"), last.alias("last"), *[c for c in chunks.columns if c not in ("part", "ordinal", "continues", "continued")])


def _codes(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x, np.uint8) for x in column.to_pylist()]


def _marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of rows that are neither blank nor repeated in their chunk."""
    for batch in batches:
        ids, digests, at = [], [], []
        for i, codes, data in zip(batch.column(0).to_pylist(), _codes(batch.column(1)), batch.column(2).to_pylist(), strict=True):
            for j in np.flatnonzero(codes & FORCED == 0).tolist():
                ids.append(i), digests.append(data[16 * j : 16 * j + 16]), at.append(j)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(digests, pa.binary()), pa.array(at, pa.int32())], names=["id", "digest", "at"])


def _forced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Codes with the rows ``later`` forced out, and the costs through each chunk; costs to the end, for the last one."""
    for batch in batches:
        codes = [c.copy() for c in _codes(batch.column("codes"))]
        for c, later in zip(codes, batch.column("later").to_pylist(), strict=True):
            if later:
                c[later] = (c[later] & ~np.uint8(TRUNCATED)) | FORCED
        costs = chunk_costs(codes)
        last = batch.column("last").to_numpy(zero_copy_only=False)
        costs[last] = np.minimum(costs[last] + AT_END, NEVER).min(axis=2)[:, :, None]
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), batch.column("first"), batch.column("last"), pa.array([c.tobytes() for c in codes], pa.binary()), _lists(costs.reshape(-1, 16))], names=["id", "first", "last", "codes", "costs"]
        )


def _lists(values: np.ndarray) -> pa.Array:
    return pa.FixedSizeListArray.from_arrays(pa.array(values.reshape(-1).astype(np.int32)), values.shape[1]).cast(pa.list_(pa.int32()))


def _numbers(column: pa.Array, width: int) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(-1, width)


def _parallel(costs: np.ndarray) -> np.ndarray:
    """Whether a chunk's cost vectors differ only by constants, whatever vector stands at its end."""
    found = (costs[:, None, :, :] + POSSIBLE[None, :, None, :]).min(axis=3)
    found -= found[:, :, 3:]
    return (found == found[:, :1]).all(axis=(1, 2))


def _shrunk(costs: np.ndarray) -> np.ndarray:
    """Costs less their least, as only differences matter."""
    return np.minimum(costs - costs.min(axis=(1, 2), keepdims=True), NEVER)


def _settle(links: DataFrame, join: Callable[[np.ndarray, np.ndarray], np.ndarray], settled: Callable[[np.ndarray], np.ndarray], width: int) -> DataFrame:
    """Rows (id, after, state) whose state is joined with that of ``after``, and so on, until it is settled or nothing follows.

    Passes double their reach, so that their number grows with the logarithm of the longest run of unsettled chunks.
    """
    schema = "id long, after long, state array<int>, done boolean"

    def looked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            state = _numbers(batch.column("state"), width)
            done = settled(state) | batch.column("after").is_null().to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("after"), _lists(state), pa.array(done)], names=["id", "after", "state", "done"])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            state = join(_numbers(batch.column("state"), width), _numbers(batch.column("next_state"), width))
            done = settled(state) | batch.column("next_done").to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("next_after"), _lists(state), pa.array(done)], names=["id", "after", "state", "done"])

    state = cut(links.select("id", "after", "state").mapInArrow(looked, schema))
    while not (open_ := state.filter("not done")).isEmpty():
        follow = state.select(F.col("id").alias("at"), F.col("after").alias("next_after"), F.col("state").alias("next_state"), F.col("done").alias("next_done"))
        state = cut(state.filter("done").union(open_.join(follow, F.col("after") == F.col("at")).mapInArrow(joined, schema)))
    return state.select("id", "state")


def _exits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """State that a chunk is left in, by the state it is entered in."""
    for batch in batches:
        codes, ends, n = _codes(batch.column("codes")), _numbers(batch.column("ends"), 4), batch.num_rows
        last = batch.column("last").to_numpy(zero_copy_only=False)
        _, _, exits, _ = trace([c for c in codes for _ in range(4)], np.repeat(ends, 4, axis=0), np.tile(np.arange(4), n), np.repeat(last, 4))
        yield pa.RecordBatch.from_arrays([batch.column("id"), _lists(exits.reshape(-1, 4))], names=["id", "exits"])


_PIECE = (
    "conv_id long, id long, first boolean, last boolean, least_turn long, most_turn long, turns long, first_turn long, last_turn long, "
    "blank long, duplicate long, truncated long, illegal long, first_initial int, last_initial int, cost long, edits array<string>, roles array<string>, texts array<string>"
)


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def done(batch: pa.RecordBatch) -> Iterator[tuple[dict, int]]:
        codes, last = _codes(batch.column("codes")), batch.column("last").to_numpy(zero_copy_only=False)
        edits, inserts, _, paid = trace(codes, _numbers(batch.column("ends"), 4), batch.column("entry").to_numpy().astype(np.int64), last)
        rows = batch.drop_columns(["codes", "ends"]).to_pylist()
        for row, c, edit, insert, cost in zip(rows, codes, edits, inserts, paid.tolist(), strict=True):
            initials = c & 3
            blank = [not t.strip(SPACES) for t in row["texts"]]
            legal = np.isin(initials[:-1] * 4 + initials[1:], (0 * 4 + 1, 1 * 4 + 2, 2 * 4 + 1))
            out, state, chars = [], row.pop("entry"), 0
            for i in range(len(c) + 1):
                for _ in range(int(insert[i])):
                    state = int(AFTER_INSERT[state])
                    out.append(("I", ROLE_OF[state], ""))
                if i < len(c):
                    role, text = row["roles"][i], row["texts"][i]
                    if edit[i] == D:
                        out.append(("D", role, text))
                    elif edit[i] == K:
                        state = int(AFTER_KEEP[state, initials[i]])
                        out.append(("K", role, text))
                    else:
                        state = int(AFTER_INSERT[state])
                        out.append(("R", ROLE_OF[state], text))
                    chars += len(text) + 100
            n_blank = sum(blank)
            row |= {
                "blank": n_blank, "duplicate": int((c & FORCED > 0).sum()) - n_blank, "truncated": int((c & TRUNCATED > 0).sum()), "illegal": int((~legal).sum()), "first_initial": int(initials[0]), "last_initial": int(initials[-1]),
                "cost": cost, "edits": [e for e, _, _ in out], "roles": [r for _, r, _ in out], "texts": [t for _, _, t in out],
            }
            yield row, chars

    yield from _in_batches((x for batch in batches for x in done(batch)), _PIECE)


def repair_pieces(rows: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Chunks of conversations with the edits made to them, in order of ``id``: lists edits (K keep, R rerole, D delete,
    I insert), roles and texts (those of deleted rows too), and the chunk's counts and cost.

    ``rows`` has conv_id, turn, role and text; other columns are ignored. A null conv_id is a conversation of its own, null
    turns come first, a null role or text is one space. Rows of one turn go by role, then by the text's first 64 characters
    and its hash; equal rows are adjacent. A row whose role begins with another letter than s, u or a can't be kept, nor one
    with an empty role. Nothing bounds a conversation's length: one with most of all rows is dealt out by chunks.
    """
    chunks = _chunks(rows, chunk_rows)
    ends = F.array(*[F.lit(int(v)) for v in AT_END])
    facts = ["conv_id", "id", "first", "last", "least_turn", "most_turn", "turns", "first_turn", "last_turn", "roles", "texts"]
    alone = chunks.filter("first and last").select(*facts, "codes", ends.alias("ends"), F.lit(START).alias("entry"))
    many = chunks.filter("not (first and last)")
    if many.isEmpty():
        return alone.mapInArrow(_finish, _PIECE)
    marks = many.select("id", "codes", "digests").mapInArrow(_marks, "id long, digest binary, at int")
    known = cut(marks.groupBy("digest").agg(F.min("id").alias("least"), F.count("*").alias("n")).filter("n > 1").select(F.col("digest").alias("known"), "least"))
    later = marks.join(known, (F.col("digest") == F.col("known")) & (F.col("id") > F.col("least"))).groupBy("id").agg(F.collect_list("at").alias("later"))  # a chunk's rows at most
    narrow = many.select("id", "first", "last", "codes").join(later, "id", "left")
    narrow = cut(narrow.mapInArrow(_forced, "id long, first boolean, last boolean, codes binary, costs array<int>"))
    links = narrow.select("id", F.expr("if(last, null, id + 1)").alias("after"), F.col("costs").alias("state"))

    def onward(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return _shrunk(_times(a.reshape(-1, 4, 4).astype(np.int64), b.reshape(-1, 4, 4).astype(np.int64))).reshape(-1, 16)

    settled = _settle(links, onward, lambda s: _parallel(s.reshape(-1, 4, 4).astype(np.int64)), 16)
    # the costs at the start, from any vector that may stand at the end: the last of POSSIBLE's zeros
    start = F.array(*[F.least(*[F.element_at("state", 4 * q + e + 1) for e in range(4)]) for q in range(4)])
    starts = settled.select((F.col("id") - 1).alias("before"), start.alias("starts"))
    narrow = narrow.drop("costs").join(starts, F.col("id") == F.col("before"), "left")
    narrow = cut(narrow.select("id", "first", "last", "codes", F.when(F.col("last"), ends).otherwise(F.col("starts")).alias("ends")))
    exits = narrow.mapInArrow(_exits, "id long, exits array<int>").select((F.col("id") + 1).alias("next"), "exits")
    links = narrow.join(exits, F.col("id") == F.col("next"), "left").select("id", F.expr("if(first, null, id - 1)").alias("after"), F.when(F.col("first"), F.array(*[F.lit(START)] * 4)).otherwise(F.col("exits")).alias("state"))
    entries = _settle(links, lambda a, b: np.take_along_axis(a, b, axis=1), lambda s: (s == s[:, :1]).all(axis=1), 4)
    entries = entries.select("id", F.element_at("state", 1).alias("entry"))
    solved = narrow.select("id", "codes", "ends").join(entries, "id")
    joined = many.select(*facts).join(solved, "id").select(*facts, "codes", "ends", "entry")
    return alone.union(joined).mapInArrow(_finish, _PIECE)


def repaired_turns(pieces: DataFrame) -> DataFrame:
    """The repaired conversations: conv_id, piece, place (both in order), edit, role, text; deleted rows are out."""
    lines = pieces.select("conv_id", F.col("id").alias("piece"), F.posexplode(F.arrays_zip("edits", "roles", "texts")).alias("place", "line"))
    return lines.select("conv_id", "piece", "place", F.col("line.edits").alias("edit"), F.col("line.roles").alias("role"), F.col("line.texts").alias("text")).filter("edit <> 'D'")


_OUTCOME = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Outcomes of conversations whose pieces come one after the other; hashes and counts run along."""

    def outcomes() -> Iterator[tuple[dict, int]]:
        now = None
        for batch in batches:
            for p in batch.to_pylist():
                if p["first"]:
                    now = {"conv_id": p["conv_id"], "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "cost": 0, "audit": []}
                    least, most, turns, last_turn, last_initial, digest, lines = None, None, 0, None, None, hashlib.sha256(), 0
                for c in ("blank", "duplicate", "truncated", "illegal", "cost"):
                    now[c] += p[c]
                now["audit"].append("".join(p["edits"]))
                now["illegal"] += last_initial is not None and (last_initial, p["first_initial"]) not in ((0, 1), (1, 2), (2, 1))
                turns += p["turns"] - (p["first_turn"] is not None and p["first_turn"] == last_turn)
                least, most = p["least_turn"] if least is None else least, most if p["most_turn"] is None else p["most_turn"]
                last_turn, last_initial = p["last_turn"], p["last_initial"]
                for edit, role, text in zip(p["edits"], p["roles"], p["texts"], strict=True):
                    if edit != "D":
                        digest.update(f"{chr(10) if lines else ''}{role}:{text}".encode())
                        lines += 1
                if p["last"]:
                    gaps = most - least + 1 - turns if turns else 0
                    yield now | {"gaps": gaps if gaps < 1 << 63 else None, "audit": "".join(now["audit"]), "repaired_sha256": digest.hexdigest()}, 1000

    yield from _in_batches(outcomes(), _OUTCOME)


def repair_outcomes(pieces: DataFrame) -> DataFrame:
    """A row for every conversation of ``pieces``: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256.

    A long conversation's pieces stream through one task in order, as its hash needs; only its audit, a letter for every
    edit, is held. Gaps beyond a long are null.
    """
    pieces = cut(pieces)
    alone = pieces.filter("first and last")
    lines = F.transform(F.filter(F.arrays_zip("edits", "roles", "texts"), lambda x: x["edits"] != "D"), lambda x: F.concat(x["roles"], F.lit(":"), x["texts"]))
    gaps = F.expr("case when turns = 0 then 0 else try_subtract(try_add(try_subtract(most_turn, least_turn), 1), turns) end")
    alone = alone.select("conv_id", gaps.alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", F.array_join("edits", "").alias("audit"), F.sha2(F.array_join(lines, "\n").cast("binary"), 256).alias("repaired_sha256"))
    return alone.union(pieces.filter("not (first and last)").repartition("conv_id").sortWithinPartitions("conv_id", "id").mapInArrow(_merge, _OUTCOME))


def damaged_and_repaired(conversations: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """What repair finds and makes of ``conversations`` after ``damage``, for every conv_id of the table; one that lost all rows has zeros, an empty audit and the hash of nothing."""
    found = repair_outcomes(repair_pieces(damage(conversations), chunk_rows)).withColumnRenamed("conv_id", "_conv")
    every = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct().withColumn("_all", F.lit(1))
    out = every.join(found.withColumn("_found", F.lit(True)), F.col("conv_id").eqNullSafe(F.col("_conv")), "left")
    empty = {c: F.lit(0).cast("long") for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")} | {"audit": F.lit(""), "repaired_sha256": F.sha2(F.lit(b""), 256)}
    return out.select("conv_id", *[F.when(F.col("_found"), F.col(c)).otherwise(v).alias(c) for c, v in empty.items()])
