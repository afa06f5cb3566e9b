"""Operators that must not gather a group: numbers, chains, candidates, packing and thinning, on hot groups and odd values."""

import json
import random
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from memspark.functions.graph import chain_ends
from memspark.functions.numbering import numbered
from memspark.operators import analytics, briefing, consolidate, embed, ingest, search
from memspark.plans.queries_live import _rocksdb
from memspark.streaming import live


def test_numbers_within_groups_over_many_ranges(spark):
    rng = random.Random(1)
    rows = [("hot", rng.randrange(1000), i) for i in range(3000)] + [(rng.choice(["a", "b", None]), rng.randrange(5), 5000 + i) for i in range(200)]
    df = spark.createDataFrame(rows, "g string, at long, id long").repartition(7)
    want = {}
    for g in ("hot", "a", "b", None):
        for n, (_, _, i) in enumerate(sorted((r for r in rows if r[0] == g), key=lambda r: (-r[1], r[2]))):
            want[i] = n + 1
    got = numbered(df, ["g"], [F.col("at").desc(), "id"])
    assert got.columns == ["g", "at", "id", "number"] and {r["id"]: r["number"] for r in got.collect()} == want
    assert numbered(df.filter("false"), ["g"], ["id"]).count() == 0


def test_chains_end_and_circles_do_not(spark):
    links = [(i, i + 1) for i in range(37)] + [(100, 101), (101, 102), (102, 100), (103, 101), (200, 200), (300, None)]
    got = {r["node"]: r["end"] for r in chain_ends(spark.createDataFrame(links, "src long, dst long")).collect()}
    assert got == {**{i: 37 for i in range(37)}, 100: None, 101: None, 102: None, 103: None, 200: None}


ENTITIES = "id long, stale boolean, archived boolean, cited_count long, updated_s long"


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_verdicts_on_entities_do_not_depend_on_row_order(spark, seed):
    decisions = [(1, 0, 10, "UPDATE", 1), (1, 1, 11, "CONTRADICTS", 1), (1, 2, 12, "NOOP", 1), (1, 3, 13, "NOOP", 2), (1, 4, 14, "ADD", None), (2, 5, 20, "CONTRADICTS", 10), (2, 6, 21, "NOOP", 3), (3, 7, 30, "UPDATE", 31), (3, 8, 31, "UPDATE", 30), (3, 9, 32, "NOOP", 30)]
    random.Random(seed).shuffle(decisions)
    df = spark.createDataFrame(decisions, "batch long, position long, id long, verdict string, existing_id long")
    entities = spark.createDataFrame([(i, i == 3, False, i, 5) for i in (1, 2, 3, 10, 11, 12, 13, 14, 20, 21, 30, 31, 32)], ENTITIES)
    outcomes = consolidate.apply_verdicts(df, entities.filter("stale or archived"))
    assert {r["id"]: (r["outcome"], r["target"]) for r in outcomes.collect()} == {
        10: ("UPDATE", 1), 11: ("ADD", None), 12: ("NOOP", 20), 13: ("NOOP", 2), 14: ("ADD", None), 20: ("CONTRADICTS", 10), 21: ("ADD", None), 30: ("UPDATE", 31), 31: ("UPDATE", 30), 32: ("ADD", None),
    }
    got = {r["id"]: r for r in consolidate.consolidate_entities(entities, outcomes, 99).collect()}
    assert (got[1].stale, got[1].superseded_by, got[1].staleness_reason, got[1].invalidated_s) == (True, 10, "consolidated", None)
    assert (got[10].superseded_by, got[10].staleness_reason, got[10].invalidated_s) == (20, "contradicted", 99)
    assert got[12].archived and got[12].superseded_by == 20 and got[20].updated_s == 99
    assert (got[1].cited_count, got[10].cited_count, got[12].cited_count, got[20].cited_count) == (0, 0, 0, 20 + 10 + 1 + 12)
    assert (got[13].archived, got[2].cited_count, got[21].archived, got[30].cited_count) == (True, 15, False, 30)
    assert not got[14].changed and not got[32].changed and len(got) == 13


def test_staleness_candidates_of_a_word_that_all_share(spark):
    rng = random.Random(3)
    rows = [(i, "p" if i % 5 else None, rng.choice(["fact", "todo"]), f"common {rng.choice(['alpha', 'beta', 'gamma'])}", "", False, False, rng.randrange(200)) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, project_id string, type string, title string, content string, stale boolean, archived boolean, created_s long")
    got = sorted(map(tuple, consolidate.staleness_candidates(df, 199, minutes=1).collect()))
    want = []
    for i, p, t, _, _, _, _, at in rows:
        if at >= 199 - 60 and p is not None:
            older = sorted((-o[7], o[0]) for o in rows if o[1] == p and o[2] == t and o[7] < at)[:5]
            want += [(i, o, n + 1) for n, (_, o) in enumerate(older)]
    assert got == sorted(want)


@pytest.mark.parametrize("budget", [3, 10, 40, 4000])
def test_text_is_packed_into_its_budget(spark, budget):
    parts = [("a", "body", 0, i, f"line {i} " + "x" * (i % 7)) for i in range(60)] + [("a", "tail", 0, 0, "end"), ("a", "top", 0, 0, "banner"), ("b", "tail", 0, 0, "only"), ("c", "body", 0, 0, "short"), ("c", "body", 0, 1, None)]
    out = {r["project_id"]: r for r in briefing.packed_text(spark.createDataFrame(parts, "project_id string, role string, section int, place long, text string"), budget).collect()}
    body = "\n".join(p[4] for p in parts[:60])
    room = max(budget * 4 - 4, 0)
    want = body if len(body) <= room else body[: max(room - len(briefing.CUT_BODY), 0)] + briefing.CUT_BODY
    assert out["a"]["text"] == "banner\n\n" + want + "\nend" and out["a"]["truncated"] == (len(body) > room)
    assert out["b"]["text"] == "\nonly" and out["c"]["text"] == ("short" if budget > 3 else out["c"]["text"])


def test_block_cosines_over_tiles(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice(["a", None]), [rng.random() for _ in range(3 if i else 2)]) for i in range(40)] + [(50, "a", [0.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "id long, k string, vector array<double>")
    got = {(r["left_id"], r["right_id"]): r["similarity"] for r in embed.block_cosine(df.filter("id % 5 = 0"), df, ["k"], tiles=3).collect()}
    norm = lambda v: sum(x * x for x in v) ** 0.5
    want = {}
    for i, k, v in rows:
        for j, m, w in rows:
            if i % 5 == 0 and i != j and k == m:
                size = norm(v) * norm(w)
                want[i, j] = round(sum(x * y for x, y in zip(v, w, strict=False)) / size, 6) if len(v) == len(w) and size else 0.0
    assert got.keys() == want.keys() and all(abs(got[p] - want[p]) < 2e-6 for p in want)


def test_stream_and_batch_drop_the_same_duplicates(spark, tmp_path):
    rng = random.Random(8)
    rows = [(rng.choice("ab"), 1_700_000_000 + rng.randrange(2000), i) for i in range(300)]
    batches = [rows[:150], rows[150:], [("z", 1_700_009_000, 900)], [("z", 1_700_019_000, 901)]]
    folder = str(tmp_path / "in")

    b = SimpleNamespace(spark=spark)
    schema = "key string, ts timestamp, event_id long"
    with _rocksdb(b):
        for batch in batches:
            spark.createDataFrame(batch, "key string, s long, event_id long").select("key", F.timestamp_seconds("s").alias("ts"), "event_id").coalesce(1).write.mode("append").parquet(folder)
            stream = live.suppress_duplicates(spark.readStream.schema(schema).parquet(folder), ["key"], seconds=60, late="3000 seconds")
            stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start().awaitTermination()
        waiting = spark.read.format("statestore").option("stateVarName", "waiting").option("flattenCollectionTypes", True).load(str(tmp_path / "at"))
        assert {r["key"]["key"] for r in waiting.select("key").distinct().collect()} <= {"z"}  # what the watermark has passed is forgotten
    got = {(r["key"], r["event_id"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = ingest.drop_recent_duplicates(spark.createDataFrame(rows, "key string, ts_s long, event_id long"), ["key"], 60)
    assert {g for g in got if g[0] != "z"} == {(r["key"], r["event_id"]) for r in want.collect()}


def test_duplicates_take_few_timers_a_key(spark, tmp_path):
    rows = [("a", 1_700_000_000 + 7 * i, i) for i in range(5000)] + [("z", 1_700_900_000, 9000)]
    folder = str(tmp_path / "in")
    spark.createDataFrame(rows, "key string, s long, event_id long").select("key", F.timestamp_seconds("s").alias("ts"), "event_id").coalesce(1).write.parquet(folder)
    with _rocksdb(SimpleNamespace(spark=spark)):
        stream = live.suppress_duplicates(spark.readStream.schema("key string, ts timestamp, event_id long").parquet(folder), ["key"], seconds=60)
        run = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start()
        run.awaitTermination()
    assert sorted(r["event_id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == list(range(0, 5000, 9))
    timers = [dict(op["customMetrics"]) for p in run.recentProgress for op in json.loads(p.json)["stateOperators"]]
    assert 0 < sum(t["numRegisteredTimers"] for t in timers) < 20  # one timer settles all that has passed, not one for every event


def _ranked(scores, able, wanted, scope, k):
    """The k best of each query by plain loops; scores: (query, id): (bm25, matched), able: id: (project, type, updated)."""
    out = {}
    for q in wanted:
        limits = [r[1:] for r in scope if r[0] == q]
        seen = [(i, *scores[q, i]) for i in able if (q, i) in scores and (not limits or any(all(x is None or x == y for x, y in zip(r, able[i][:2], strict=True)) for r in limits))]
        whole = [h for h in seen if h[2] == wanted[q]]
        top = sorted(whole or seen, key=lambda h: (-h[1], -(able[h[0]][2] if able[h[0]][2] is not None else -1e18), h[0]))[:k]
        out |= {(q, h[0]): (n, round(h[1], 6)) for n, h in enumerate(top, 1)}
    return out


def test_blocks_rank_as_all_pairs_would(spark, monkeypatch):
    monkeypatch.setattr(search, "ROWS", 40)
    monkeypatch.setattr(search, "QUERIES", 3)
    rng = random.Random(12)
    words = [f"w{i}" for i in range(30)]
    data = [(i, rng.choice("abc"), rng.choice(["fact", "todo"]), " ".join(rng.choices(words, k=rng.randint(0, 12))), rng.choice([None, *range(5)]), i % 7 == 0, i % 9 == 0) for i in range(300)]
    data += [(300 + i, "a", "fact", data[1][3], 3, False, False) for i in range(30)]  # one text many times: ties
    entities = spark.createDataFrame(data, "id long, project_id string, type string, content string, updated_s long, archived boolean, stale boolean").withColumn("title", F.lit("")).withColumn("pinned", F.lit(False)).repartition(5)
    asked = {q: sorted(set(rng.choices(words, k=rng.randint(1, 5)))) for q in range(14)} | {14: ["none"], 15: data[1][3].split()[:1] or ["w0"]}
    terms = spark.createDataFrame([(q, t) for q, ts in asked.items() for t in set(ts)], "query_id int, term string")
    limits = [(0, "a", None), (1, "b", "todo"), (2, None, "fact"), (3, None, None), (4, "a", None), (4, None, "fact"), (5, "zzz", None)]
    scope = spark.createDataFrame(limits, "query_id int, project_id string, type string")
    index = search.build_index(entities, "id", ["title", "content"])
    scores = {(r["query_id"], r["id"]): (r["bm25"], r["matched"]) for r in search.bm25(index, terms, "id").collect()}
    able = {i: (p, t, u) for i, p, t, _, u, archived, stale in data if not archived and not stale}
    wanted = {q: len(set(ts)) for q, ts in asked.items()}
    for used, rows in ((None, []), (scope, limits)):
        got = {(r["query_id"], r["id"]): (r["rank"], round(r["bm25"], 6)) for r in search.rank_entities(index, entities, terms, 5, scope=used, stale=False).collect()}
        assert got == _ranked(scores, able, wanted, rows, 5)


def test_pairs_of_queries_and_rows_are_not_written(spark):
    # every row matches every query: 3000 x 40 pairs, of which a search may write no more than its k best of each block
    entities = spark.createDataFrame([(i, f"common word{i % 50}", i) for i in range(3000)], "id long, content string, updated_s long")
    terms = spark.createDataFrame([(q, t) for q in range(40) for t in ("common", f"word{q}")], "query_id long, term string")
    best = search.best_hits(search.build_index(entities, "id", ["content"]), terms, "id", entities, "updated_s", 3)
    status, group = spark.sparkContext.statusTracker(), "pairs"
    spark.sparkContext.setJobGroup(group, group)
    assert best.count() == 120
    store = spark.sparkContext._jsc.sc().statusStore()
    stages = {s for j in status.getJobIdsForGroup(group) for s in status.getJobInfo(j).stageIds}
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    written = sum(store.lastStageAttempt(s).shuffleWriteRecords() for s in stages if status.getStageInfo(s) is not None)
    assert written < 6 * 3000  # rows and queries travel, not their pairs


def test_a_path_with_an_exact_file_does_not_meet_its_namesakes(spark):
    # 40 folders with a file of one name, 50 entities each: 2000 rows by exact paths, 80 000 if names met as well
    data = [(1000 * d + e, f"src/{d}/x.py") for d in range(40) for e in range(50)]
    files = spark.createDataFrame([*data, *data, (7, "src/lone/y.py"), (990_000, "src/gone/z.py"), (7, "lib/z.py")], "entity_id long, file_path string")
    entities = spark.createDataFrame([(i, "fact", f"t{i}", -i, "open") for i, _ in data] + [(990_001, "fact", "t", 0, "open")], "id long, type string, title string, created_s long, status string")
    asked = spark.createDataFrame([(f"./src/{d}/x.py",) for d in range(40)] + [("./no/y.py",), ("x.py",), ("src/gone/z.py",), ("nowhere.py",)], "asked string")
    spark.sparkContext.setJobGroup("paths", "paths")
    line = analytics.file_timeline(files, entities, asked)
    got = {}
    for r in line.collect():
        got.setdefault(r["asked"], {})[r["number"]] = r["entity_id"]
    store, status = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext.statusTracker()
    stages = {s for j in status.getJobIdsForGroup("paths") for s in status.getJobInfo(j).stageIds}
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    newest = sorted((i for i, _ in data), reverse=True)
    want = {f"./src/{d}/x.py": [1000 * d + e for e in reversed(range(50))] for d in range(40)} | {"x.py": newest, "./no/y.py": [7]}
    assert {a: [x[n] for n in sorted(x)] for a, x in got.items()} == want  # an exact path whose entity is gone has none, its namesakes stay out
    assert sum(store.lastStageAttempt(s).shuffleWriteRecords() for s in stages if status.getStageInfo(s) is not None) < 40_000
    context = {r["asked"]: (r["n"], r["current"], r["cut"]) for r in analytics.file_context(line).collect()}
    assert context["x.py"] == (2000, newest[-1], 1980) and context["./src/3/x.py"] == (50, 3000, 30)


def test_new_entities_search_their_own_project_and_type_only(spark):
    # 600 entities in 60 seats of 10, all titles of the same words: 200 x 600 pairs if all met
    data = [(i, f"p{i % 20}", f"t{i % 3}", "same title words", "", i, False, False, False) for i in range(600)]
    entities = spark.createDataFrame(data, "id long, project_id string, type string, title string, content string, updated_s long, pinned boolean, stale boolean, archived boolean")
    new = entities.filter("id >= 400")
    spark.sparkContext.setJobGroup("titles", "titles")
    hits = consolidate.lexical_candidates(new, entities, search.build_index(entities, "id", ["title", "content"]), 3).collect()
    store, status = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext.statusTracker()
    stages = {s for j in status.getJobIdsForGroup("titles") for s in status.getJobInfo(j).stageIds}
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    want = {(i, o) for i in range(400, 600) for o in sorted((o for o in range(400) if o % 60 == i % 60), reverse=True)[:3]}
    assert {(r["id"], r["existing_id"]) for r in hits} == want
    assert sum(store.lastStageAttempt(s).shuffleWriteRecords() for s in stages if status.getStageInfo(s) is not None) < 30_000


def test_events_rank_in_blocks_within_their_scope(spark, monkeypatch):
    monkeypatch.setattr(search, "ROWS", 16)
    events = spark.createDataFrame([(i, i % 4, i % 3, "prompt" if i % 2 else "response", "redis cache" if i % 5 else "redis", 1000 + i // 2 if i % 11 else None) for i in range(200)], "event_id long, session_id long, project_id long, type string, content string, ts_s long")
    terms = spark.createDataFrame([(q, t) for q in (1, 2, 3) for t in ("redis", "cache")] + [(4, "absent"), (5, "cache"), (5, "absent")], "query_id long, term string")
    scope = spark.createDataFrame([(1, 2, None), (2, 1, 3), (2, 1, 2)], "query_id long, project_id int, session_id int")
    got = {}
    for r in search.rank_events(search.build_index(events, "event_id", ["content"]), events, terms, 4, 2000, scope=scope).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = r["event_id"]
    order = sorted((i for i in range(200) if i % 5), key=lambda i: (-(1000 + i // 2 if i % 11 else -1), i))
    fits = {1: lambda i: i % 3 == 2, 2: lambda i: i % 3 == 1 and i % 4 in (2, 3), 3: lambda i: True, 5: lambda i: True}
    assert {q: [x[n] for n in sorted(x)] for q, x in got.items()} == {q: [i for i in order if f(i)][:4] for q, f in fits.items()}
