"""Indexes, vectors and counters kept up with batches, and transcripts that grow."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from memspark.operators import ingest, search, upkeep
from memspark.sources import tailing, transcripts
from memspark.streaming import live

WORDS = ["red", "green", "blue", "wind", "sea", "Résumé", "naïve", "x1", "stone", "leaf"]


def scores(spark, postings, terms, stats=None):
    return {(r["query_id"], r["id"]): (r["bm25"], r["matched"]) for r in search.bm25(postings, terms, "id", stats=stats).collect()}


@pytest.mark.parametrize("most", [2, 16])
def test_a_kept_index_equals_a_fresh_one(spark, tmp_path, most):
    rng = random.Random(most)
    index = upkeep.KeptIndex(spark, str(tmp_path / "index"), "id", ["title", "content"], most=most)
    terms = search.query_terms(spark.createDataFrame([(1, "red sea"), (2, "resume"), (3, "nothing here"), (4, "blue leaf stone")], "query_id long, text string"), "text")
    state = {}
    for number in range(5):
        batch = []
        for key in rng.sample(range(40), 12):
            gone = rng.random() < 0.3
            row = (key, rng.choice([None, "", rng.choice(WORDS)]), " ".join(rng.choice(WORDS) for _ in range(rng.randrange(9))))
            batch.append((*row, gone))
            state.pop(key, None)
            if not gone:
                state[key] = row
        changes = spark.createDataFrame(batch, "id long, title string, content string, deleted boolean")
        index.apply(number, changes)
        if number in (1, 4):
            index.apply(number, changes)  # again, as after a failure
        fresh = search.build_index(spark.createDataFrame(list(state.values()), "id long, title string, content string"), "id", ["title", "content"])
        assert scores(spark, index.postings(terms), terms, index.stats()) == scores(spark, fresh, terms)
        assert index.stats().head()["n"] == len(state)


def test_a_batch_reads_no_rows_of_earlier_segments(spark, tmp_path):
    index = upkeep.KeptIndex(spark, str(tmp_path / "index"), "id", ["content"])
    rows = spark.createDataFrame([(i, WORDS[i % 5], False) for i in range(20)], "id long, content string, deleted boolean")
    index.apply(0, rows)
    before = {os.path.join(d, f): os.path.getmtime(os.path.join(d, f)) for d, _, names in os.walk(tmp_path / "index") for f in names}
    index.apply(1, rows.filter("id = 3").withColumn("deleted", F.lit(True)))
    after = {os.path.join(d, f): os.path.getmtime(os.path.join(d, f)) for d, _, names in os.walk(tmp_path / "index") for f in names}
    assert before.items() <= after.items()
    with pytest.raises(ValueError):
        upkeep.Segments(spark, str(tmp_path / "none"), "id").alive()


def test_counters_are_idempotent(spark, tmp_path):
    counts = upkeep.KeptCounts(spark, str(tmp_path / "counts"), "id")
    one = spark.createDataFrame([(1, 2, 10), (1, 1, 5), (2, 1, 7)], "id long, n long, at_s long")
    for number, batch in ((0, one), (1, one), (1, one)):
        counts.apply(number, batch)
    assert {tuple(r) for r in counts.totals().collect()} == {(1, 6, 10), (2, 2, 7)}


def test_both_forms_of_an_accent_are_one_token(spark):
    row = spark.createDataFrame([("résumé naïve Việt", "résumé naïve Việt")], "a string, b string")
    a, b = row.select(search.tokens(F.col("a")), search.tokens(F.col("b"))).head()
    assert a == b == ["resume", "naive", "viet"]


def test_rows_without_tokens_count_in_the_statistics(spark):
    df = spark.createDataFrame([(1, "red sea"), (2, ""), (3, None), (4, "red")], "id long, content string")
    index = search.build_index(df, "id", ["content"])
    assert index.filter("lead").count() == 4
    terms = spark.createDataFrame([(1, "red")], "query_id long, term string")
    # n = 4, df = 2, mean length 3 / 4
    idf = F.log(F.lit(1 + (4 - 2 + 0.5) / (2 + 0.5)))
    want = spark.range(1).select(F.round(idf * (2.2 / (1 + 1.2 * (0.25 + 0.75 * 1 / 0.75))), 6)).head()[0]
    assert {r["id"]: r["bm25"] for r in search.bm25(index, terms, "id").collect()}[4] == pytest.approx(want)


def follow(spark, folder, checkpoint, update, **options):
    query = tailing.tail_transcripts(spark, folder, **options).writeStream.foreachBatch(update).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def call(i):
    return json.dumps({"type": "assistant", "message": {"model": "m", "content": [{"type": "tool_use", "id": f"t{i}", "name": "Read", "input": {}}]}})


def result(i):
    return json.dumps({"type": "user", "message": {"content": [{"type": "tool_result", "tool_use_id": f"t{i}", "content": "found"}]}})


@pytest.mark.parametrize("task", [60, 1 << 25])
def test_tail_follows_growing_and_shrinking_files(spark, tmp_path, task):
    folder, seen = tmp_path / "logs", []
    folder.mkdir()
    keep = lambda df, number: seen.extend((r["source"], r["line_no"]) for r in df.collect())

    def step():
        seen.clear()
        follow(spark, str(folder), str(tmp_path / "at"), keep, taskBytes=task)
        return sorted(seen)

    line = call(1)
    (folder / "a.jsonl").write_text(f"{call(0)}\n{line[:10]}")
    assert step() == [("a", 0)]
    with (folder / "a.jsonl").open("a") as f:
        f.write(f"{line[10:]}\nnot json\n\n{result(1)}\n")
    (folder / "b.jsonl").write_text("".join(f"{call(i)}\n" for i in range(5)))
    assert step() == [("a", 1), ("a", 4), *[("b", i) for i in range(5)]]
    assert step() == []
    (folder / "a.jsonl").write_text(f"{result(7)}\n")
    assert step() == [("a", 0)]
    (folder / "b.jsonl").unlink()
    (folder / "c.txt").write_text("other\n")
    assert step() == []


def test_live_etl_and_tool_names_over_a_tailed_stream(spark, tmp_path):
    folder, table = tmp_path / "logs", str(tmp_path / "events")
    folder.mkdir()

    def update(df, number):
        events = transcripts.map_transcript(df).withColumn("event_id", F.concat_ws("-", "source", "line_no", "number"))
        live.live_etl(events, "event_id", [], [], "secret").write.mode("overwrite").parquet(f"{table}/batch={number}")

    (folder / "s.jsonl").write_text(f"{call(0)}\n{call(1)}\n{result(1)[:20]}")
    follow(spark, str(folder), str(tmp_path / "at"), update)
    with (folder / "s.jsonl").open("a") as f:
        f.write(f"{result(1)[20:]}\n{result(0)}\n")
    follow(spark, str(folder), str(tmp_path / "at"), update)
    named = transcripts.resolve_tool_names(spark.read.parquet(table)).filter("type = 'tool_result'")
    assert sorted((r["line_no"], r["tool_use_id"], r["tool_name"]) for r in named.collect()) == [(2, "t1", "Read"), (3, "t0", "Read")]


# ---- duplicates counted from the last kept row
def kept_rows(rows, seconds):
    out, last = [], {}
    for key, ts, event in sorted(rows, key=lambda r: (str(r[0]), r[1], r[2])):
        if key not in last or ts - last[key] > seconds:
            out.append((key, ts, event))
            last[key] = ts
    return out


@pytest.mark.parametrize("seconds", [0, 3, 60])
def test_recent_duplicates_against_a_scan(spark, seconds):
    rng = random.Random(seconds)
    rows = [(rng.choice(["a", "b", None]), rng.randrange(900), i) for i in range(500)] + [("dense", t, 1000 + t) for t in range(400)] + [("far", 10**9 * t, 3000 + t) for t in range(5)] + [("back", -t * 7, 4000 + t) for t in range(50)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "key string, ts_s long, event_id long, note string")
    got = ingest.drop_recent_duplicates(df, ["key"], seconds)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(kept_rows(rows, seconds), key=str)
    assert ingest.drop_recent_duplicates(df.filter("false"), ["key"], seconds).count() == 0
