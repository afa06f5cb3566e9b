"""The training-data operators against brute force on small tables, and their edge cases."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

import corpus_pipeline
from memspark.functions.graph import connected_components
from memspark.llm import decontaminate, line_dedup, quality, secret_scan, simhash_dedup, source_mix, substring_dedup, suffix_dedup, topk_search, toxicity
from memspark.llm.common import NOT_ALNUM, fold_table, mix, pieces, prefix_hash, range_hash, word_bounds

WORDS = [a + b for a in ("ka", "lo", "mi", "ne", "pu", "ré", "so", "ti") for b in ("an", "bel", "cor", "dun", "ek", "fal", "gor", "hüm", "ix", "jal")]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "", ",", ".", ".\n"]) for _ in range(n))


def table(spark, texts, ids=None):
    data = [(i if ids is None else ids[i], t, "en", f"s{i % 3}" if i % 7 else None, len(t or ""), i) for i, t in enumerate(texts)]
    return spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long, size long")


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    base = [prose(rng, rng.randint(1, 300)) for _ in range(30)]
    passage = prose(rng, 120)
    out = base + [None, "", " \n ", "a", base[0], base[0], base[1] + " x", passage + "\n" + base[2], base[3] + ". " + passage, passage * 3, "\n".join([base[4]] * 4)]
    words = base[5].split(" ")
    words[len(words) // 2] = "changed"
    return [*out, " ".join(words), "é" * 900, "ab" * 700]


@pytest.fixture(scope="module")
def docs(spark, texts):
    return table(spark, texts).repartition(5).cache()


def empty(docs):
    return docs.filter("false")


# ---- op1
def brute_fingerprint(text, k=3):
    folded = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x20\x09-\x0d]+", folded)
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + k]).encode(), 42) for i in range(max(1, len(words) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(n, near):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(n):
        for j in range(i + 1, n):
            if near(i, j):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(n)]


def test_simhash_classes(docs, texts):
    prints = [brute_fingerprint(t) for t in texts]
    first = groups(len(texts), lambda i, j: (prints[i] ^ prints[j]).bit_count() <= 3)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash_dedup.simhash_classes(docs).collect()}
    assert got == {i: (f"{prints[i]:016x}", first[i]) for i in range(len(texts))}
    assert simhash_dedup.simhash_classes(empty(docs)).count() == 0


def test_near_copies_of_a_larger_group_are_found(spark):
    rng = random.Random(21)
    made = []
    for _ in range(3):
        words = [f"{rng.choice(WORDS)}{rng.randint(0, 99)}" for _ in range(120)]
        made += [" ".join(w if rng.random() > 0.04 else f"new{rng.randint(0, 9999)}" for w in words) for _ in range(25)]
    every = [*made, *[prose(rng, 80) for _ in range(20)], made[0], "", None]
    got = {r.doc_id: r for r in simhash_dedup.near_copies(table(spark, every)).collect()}
    plain = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash_dedup.simhash_classes(table(spark, every)).collect()}
    assert {i: (r.fingerprint, r.component_id) for i, r in got.items()} == plain  # what the contract fixes stays
    assert len({got[i].component_id for i in range(75)}) > 30  # three bits hold few of them together
    assert [got[i].near_id for i in range(75)] == [25 * (i // 25) for i in range(75)]
    assert [got[i].near_id for i in range(75, 95)] == [got[i].component_id for i in range(75, 95)]
    assert [got[i].near_id for i in (95, 96, 97)] == [0, 96, 96]
    assert simhash_dedup.near_copies(table(spark, every).filter("false")).count() == 0


@pytest.mark.parametrize("tile", [2, 5, 1024])
def test_tiles_find_all_links(spark, tile):
    rng = np.random.default_rng(3)
    centres = rng.integers(0, 1 << 63, 6)
    values = {int(c) for c in centres} | {int(c) ^ (1 << int(a)) ^ (1 << int(b)) for c in centres for a, b in rng.integers(0, 62, (25, 2))}
    values = sorted(values)
    want = groups(len(values), lambda i, j: (values[i] ^ values[j]).bit_count() <= 3)
    nodes = connected_components(simhash_dedup.fingerprint_links(spark.createDataFrame([(v, 0, v) for v in values], "node long, kind int, fp long"), 3, tile)).collect()
    found = {}
    for r in nodes:
        found.setdefault(r.root, set()).add(r.node)
    expected = {}
    for v, g in zip(values, want, strict=True):
        expected.setdefault(g, set()).add(v)
    assert sorted(map(sorted, found.values())) == sorted(sorted(g) for g in expected.values() if len(g) > 1)


def test_similar_dedup_keeps_one_of_each_class(spark, texts):
    rng = random.Random(9)
    long = [prose(rng, 200) for _ in range(6)]
    near = []
    for t in long:
        for _ in range(4):
            w = t.split(" ")
            w[rng.randrange(len(w))] = "zzz"
            near.append(" ".join(w))
    every = [*texts, *long, *near]
    sets = [simhash_dedup.shingle_set(t, 5) for t in every]

    def alike(i, j):
        a, b = len(sets[i]), len(sets[j])
        both = len(np.intersect1d(sets[i], sets[j]))
        return a == b == 0 or (a + b - both > 0 and both / (a + b - both) >= 0.8)

    want = sorted(set(groups(len(every), alike)))
    out = simhash_dedup.similar_dedup(table(spark, every))
    assert sorted(r.doc_id for r in out.collect()) == want and out.columns == table(spark, [""]).columns
    twice = table(spark, ["same text here", "same text here"], [4, 4])
    assert simhash_dedup.similar_dedup(twice).count() == 1


def test_similar_dedup_finds_pairs_beyond_the_radius(spark):
    rng = random.Random(21)
    pairs = []
    while len(pairs) < 4:
        words = [rng.choice(WORDS) + rng.choice(WORDS) for _ in range(60)]
        other = [*words[:-6], *(rng.choice(WORDS) + rng.choice(WORDS) for _ in range(6))]
        a, b = (simhash_dedup._vote([x.astype(">u8").view(np.uint8).reshape(-1, 8)]) for x in (simhash_dedup.shingle_set(" ".join(w), 5) for w in (words, other)))
        if (a ^ b).bit_count() > simhash_dedup.WIDE_RADIUS:
            pairs += [(" ".join(words), " ".join(other))]
    out = simhash_dedup.similar_dedup(table(spark, [t for p in pairs for t in p]))
    assert sorted(r.doc_id for r in out.collect()) == [0, 2, 4, 6]


def test_candidate_fingerprints_count_a_shingle_once(spark):
    rng = random.Random(22)
    own, loop = [rng.choice(WORDS) + rng.choice(WORDS) for _ in range(50)], ["la", "le", "li", "lo", "lu"]
    texts = [" ".join(own + loop * n) for n in (2, 20)]
    assert np.array_equal(*(simhash_dedup.shingle_set(t, 5) for t in texts))
    batch = pa.RecordBatch.from_arrays([pa.array([0, 1]), pa.array([0, 1]), pa.array(texts)], names=["doc_id", "key", "text"])
    (got,) = simhash_dedup._sized(5, 0.8, np.zeros(0, np.uint64))([batch])
    assert got.column("fp")[0] == got.column("fp")[1]
    assert [r.doc_id for r in simhash_dedup.similar_dedup(table(spark, texts)).collect()] == [0]


# ---- op2
def test_substring_dedup_keeps_the_first_copy(spark):
    rng = random.Random(1)
    passage = ". ".join(" ".join(rng.choice(WORDS) for _ in range(9)) for _ in range(7)) + "."
    clean = [". ".join(" ".join(rng.choice(WORDS) for _ in range(8)) for _ in range(6)) + "." for _ in range(3)]
    docs = table(spark, [clean[0] + "\n" + passage, passage + " " + clean[1], clean[2], None, "", "One. Two."])
    out = {r.doc_id: r for r in substring_dedup.substring_dedup(docs).collect()}
    assert out[0].n_removed == 0 and out[0].text == clean[0] + "\n" + passage
    assert out[1].text == clean[1] and out[1].n_removed == 7 and out[1].n_spans == 1
    assert [out[i].n_removed for i in (2, 3, 4, 5)] == [0, 0, 0, 0] and out[3].text is None and out[4].text == ""
    assert substring_dedup.substring_dedup(empty(docs)).count() == 0


END = re.compile(r"(?<=[.!?])[ \t\n\r\f\v]+|\n+")


def brute_parts(text):
    at = [0, *(m.end() for m in END.finditer(text)), len(text)]
    return [text[a:z] for a, z in zip(at[:-1], at[1:], strict=True) if a < z]


@given(st.lists(st.text(alphabet="abé.!? \n\t", max_size=40), min_size=1, max_size=5))
def test_sentences(texts):
    for _, data, offsets in pieces(pa.array(texts), 50):
        s = substring_dedup.sentences(data, offsets)
        got = [data[a:z].tobytes().decode() for a, z in zip(s.edges[:-1], s.edges[1:], strict=True)]
        lot = [t for t in texts if t]
        rows = [p for t in lot for p in brute_parts(t)]
        assert "".join(got) in "".join(lot) and all(g in rows for g in got)
        assert all(substring_dedup._IS_WORD[data[s.edges[p] : s.edges[p + 1]]].any() for p in s.part)


def brute_spans(texts, least_words=20):
    """Texts without the sentences that a span covers which stands before, in a text or farther up."""
    strip = " \t\n\r\f\v"
    seen, out, found = {}, [], []
    for d, t in enumerate(texts):
        full = [(i, p.strip(strip)) for i, p in enumerate(brute_parts(t or "")) if p.strip(strip)]
        size = [len(s.encode().split()) for _, s in full]
        spans = set()
        for a in range(len(full)):
            onward = next((z for z in range(a + 1, len(full)) if sum(size[a : z + 1]) >= least_words), None)
            back = next((z for z in range(a - 1, -1, -1) if sum(size[z : a + 1]) >= least_words), None)
            spans |= {(a, onward)} if onward is not None else set()
            spans |= {(back, a)} if back is not None else set()
        found.append((full, sorted(spans)))
        for a, z in sorted(spans):
            seen.setdefault("\n".join(s for _, s in full[a : z + 1]), (d, a))
    for d, t in enumerate(texts):
        full, spans = found[d]
        gone = {full[i][0] for a, z in spans if seen["\n".join(s for _, s in full[a : z + 1])] != (d, a) for i in range(a, z + 1)}
        # what lies between the first and the last sentence of a span goes with it
        for a, z in spans:
            if seen["\n".join(s for _, s in full[a : z + 1])] != (d, a):
                gone |= set(range(full[a][0], full[z][0] + 1))
        out.append(t if not gone else "".join(p for i, p in enumerate(brute_parts(t)) if i not in gone))
    return out


def test_substring_dedup_against_brute_force(spark, texts):
    rng = random.Random(31)
    ends = lambda n: ". ".join(" ".join(rng.choice(WORDS) for _ in range(k)) for k in n) + "."
    copy, passage = ends([10, 10, 10, 3]), ends([4, 9, 9, 2])
    every = [*texts, copy, copy, ends([9, 8]) + " " + passage + " " + ends([7, 3, 12]), ends([5]) + "\n" + passage + "\n\n" + ends([11, 12]), "x" * 100_000 + ". " + copy]
    out = {r.doc_id: r for r in substring_dedup.substring_dedup(table(spark, every).repartition(3)).collect()}
    want = brute_spans(every)
    assert [out[i].text for i in range(len(every))] == want
    whole = len(texts) + 1
    assert out[whole].text == "" and out[whole].n_removed == out[whole].n_sentences == 4 and out[whole].n_spans == 1
    assert "\n" + passage not in out[whole + 2].text and out[whole + 2].n_removed == 4


# ---- op3
def brute_hits(text, items):
    split = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    words, hit, found = split(text), set(), set()
    for item, body in items:
        own = split(body)
        n = min(13, len(own))
        for i in range(len(own) - n + 1) if own else ():
            for j in range(len(words) - n + 1):
                if words[j : j + n] == own[i : i + n]:
                    hit |= set(range(j, j + n))
                    found.add(str(item))
    return len(words), len(hit), ",".join(sorted(found))


def test_contamination(spark, docs, texts):
    rng = random.Random(2)
    bodies = [texts[7], texts[8][:200], "Ré-an kaan", "a", "", None, prose(rng, 40), texts[7], "\n".join([texts[9], texts[10]])]
    items = [(i + 5, b) for i, b in enumerate(bodies)]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r.items_sha256, r.contaminated) for r in decontaminate.contamination(docs, benchmark).collect()}
    for i, t in enumerate(texts):
        n, hit, found = brute_hits(t, items)
        assert got[i] == (n, hit, hashlib.sha256(found.encode()).hexdigest(), hit > 0 and 20 * hit >= n), i
    clean = decontaminate.drop_contaminated(docs, benchmark)
    assert sorted(r.doc_id for r in clean.collect()) == sorted(i for i in got if not got[i][3]) and clean.columns == docs.columns
    assert decontaminate.contamination(docs, empty(benchmark)).filter("n_hit > 0").count() == 0
    assert decontaminate.contamination(empty(docs), benchmark).count() == 0
    nameless = spark.createDataFrame([(None, texts[7]), (3, texts[7]), (3, texts[7])], "item_id long, text string")
    row = decontaminate.contamination(docs.filter("doc_id = 7"), nameless).head()
    assert (row.n_items, row.items, row.n_hit) == (2, ["3"], row.n_words)


def test_winnowing_thins_and_misses_no_shared_run(spark):
    rng = random.Random(41)
    item = [rng.choice(WORDS) for _ in range(60)] + ["la"] * 20
    benchmark = [(1, " ".join(item))]
    own = lambda n: [rng.choice(WORDS) + "q" for _ in range(n)]
    every = [" ".join(own(20) + item[a : a + n] + own(20)) for a in range(0, 40, 3) for n in (12, 13, 14, 30)] + [" ".join(own(3) + ["la"] * 50), "la " * 100_000]
    got = decontaminate.contamination(table(spark, every), spark.createDataFrame(benchmark, "item_id long, text string")).collect()
    assert {r.doc_id: (r.n_words, r.n_hit) for r in got if r.doc_id < len(every) - 1} == {i: brute_hits(t, benchmark)[:2] for i, t in enumerate(every[:-1])}
    assert [(r.n_words, r.n_hit) for r in got if r.doc_id == len(every) - 1] == [(100_000, 100_000)]
    words = np.array([hash(w) & 0xFFFFFFFF for w in own(5000)], np.uint64)
    places, _ = decontaminate.winnow(words, np.zeros(5000, np.int64), 13, 8)
    assert len(places) < 0.4 * 5000 and np.diff(places).max() <= 6


# ---- op4
def test_marginals_equal_enumeration():
    rng = np.random.default_rng(0)
    counts = [5, 0, 1, 3]
    first = np.concatenate([[0], np.cumsum(counts)])
    e, step = rng.normal(size=9), rng.normal(size=(2, 2))
    got, moves = toxicity.marginals(e, first, step)
    want, total = np.zeros(9), np.zeros((2, 2))
    for a, b in zip(first[:-1], first[1:], strict=True):
        scores = {}
        for bits in range(1 << (b - a)) if b > a else ():
            y = [bits >> i & 1 for i in range(b - a)]
            scores[tuple(y)] = math.exp(sum(e[a + i] * y[i] + step[y[i - 1] if i else 0, y[i]] for i in range(b - a)))
        z = sum(scores.values())
        for y, s in scores.items():
            for i, v in enumerate(y):
                want[a + i] += v * s / z
                total[y[i - 1] if i else 0, v] += s / z
    assert np.allclose(got, want) and np.allclose(moves, total)


def test_marginals_of_long_rows_do_not_depend_on_segments(monkeypatch):
    rng = np.random.default_rng(1)
    first, e, step = np.array([0, 700, 701, 1000]), rng.normal(size=1000), rng.normal(size=(2, 2))
    got = toxicity.marginals(e, first, step)[0]
    monkeypatch.setattr(toxicity, "_SEGMENT", 1000)
    assert np.allclose(got, toxicity.marginals(e, first, step)[0])


def test_toxicity_learns_the_training_rows_only(spark):
    rng = random.Random(4)
    bad = ["vile", "foul"]
    texts = [prose(rng, 60) + (f" {rng.choice(bad)} {prose(rng, 5)} {rng.choice(bad)}" if i % 4 == 0 else "") for i in range(200)] + [None, "", "VILE foul"]
    docs = table(spark, texts)
    labels = spark.createDataFrame([(i, int(i % 4 == 0) if zlib.crc32(str(i).encode()) % 5 else int(i % 4 != 0)) for i in range(200)], "doc_id long, toxic int")
    out = {r.doc_id: r for r in toxicity.toxicity_scores(docs, labels).collect()}
    assert all(out[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i in out)
    assert np.mean([out[i].predicted == int(i % 4 == 0) for i in range(200)]) > 0.97  # held-out labels are wrong on purpose
    assert out[200].score == out[201].score and 0 <= out[200].score < 0.5 <= out[202].score <= 1
    spans = toxicity.toxicity(docs.filter("doc_id = 202"), labels, toxicity.train(docs, labels)).head()
    assert "VILE foul".encode()[spans.spans[0].start : spans.spans[-1].end].lower() == b"vile foul"
    assert toxicity.toxicity_scores(empty(docs), labels).count() == 0
    nothing = toxicity.toxicity_scores(docs, labels.filter("false")).collect()
    assert len(nothing) == 203 and all(0 <= r.score <= 1 for r in nothing)


def hashed(word):
    data = np.frombuffer(word.encode(), np.uint8)
    return int(range_hash(prefix_hash(data), np.array([0]), np.array([len(data)]))[0])


def words_of(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def test_document_scores_against_brute_force(spark):
    rng = np.random.default_rng(12)
    n = toxicity.BUCKETS
    field = toxicity.Field(rng.normal(size=n), rng.normal(size=n) / 2, rng.normal(size=n) / 2, -1.0, rng.normal(size=(2, 2)), rng.normal(size=4))
    few = random.Random(13)
    texts = [prose(few, k) for k in (1, 2, 5, 9)] + [None, "", "...", "VILE vile"]
    got = {r.doc_id: r.score for r in toxicity.toxicity(table(spark, texts), None, field).collect()}
    for d, t in enumerate(texts):
        at = [hashed(w) % n for w in words_of(t)]
        e = [min(30, max(-30, field.own[b] + field.bias + (field.before[at[i - 1]] if i else 0) + (field.after[at[i + 1]] if i + 1 < len(at) else 0))) for i, b in enumerate(at)]
        total, on = 0.0, np.zeros(len(at))
        for bits in range(1 << len(at)):
            y = [bits >> i & 1 for i in range(len(at))]
            weight = math.exp(sum(e[i] * y[i] + field.step[y[i - 1] if i else 0, y[i]] for i in range(len(at))))
            total += weight
            on += weight * np.array(y)
        p = on / total
        x = [1, p.max(initial=0), math.log1p(p.sum()), math.log1p(100 * p.sum() / max(1, len(at)))]
        assert got[d] == pytest.approx(1 / (1 + math.exp(-float(np.dot(x, field.document)))))


def test_training_rows_are_bounded(spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    rows = [(i, f"w{j} vile" if i % 2 else f"w{j} fine") for i in range(40) for j in range(30)] + [(3, "x " * toxicity.TRAIN_BYTES)]
    docs, seen = spark.createDataFrame(rows, "doc_id long, text string"), []
    real = toxicity.fit
    toxicity.fit = lambda words, first, toxic, share=None: seen.append((len(first) - 1, len(words))) or real(words, first, toxic, share)
    try:
        toxicity.train(docs, labels, 10)
    finally:
        toxicity.fit = real
    assert seen[0][0] <= 20 and seen[0][1] <= 40


def test_training_rows_are_chosen_among_those_short_enough(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "TRAIN_BYTES", 2000)
    labels = spark.createDataFrame([(i, int(i >= 40)) for i in range(80)], "doc_id long, toxic int")
    text = lambda i: ("vile brute " if i >= 40 else "fine words ") * (1 if i < 40 or i % 8 == 1 else 400)
    docs, seen = spark.createDataFrame([(i, text(i)) for i in range(80)], "doc_id long, text string"), []
    real = toxicity.fit
    monkeypatch.setattr(toxicity, "fit", lambda words, first, toxic, share=None: seen.append(toxic) or real(words, first, toxic, share))
    toxicity.train(docs, labels, 3)
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    assert seen[0].sum() == min(3, sum(not held(i) for i in range(40, 80) if i % 8 == 1)) > 0 and len(seen[0]) == seen[0].sum() + 3


# ---- op5
def test_ratio_and_selection_against_brute_force(spark):
    rng = random.Random(14)
    texts = [prose(rng, rng.randint(0, 60)) for _ in range(50)] + [None, "", "only", "Ré. ré", "long " * 30_000]
    ids = [*range(53), 7, 7]
    docs = table(spark, texts, ids)
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(50)] + [(3, 1)], "doc_id long, quality int")
    good = {i for i in range(0, 50, 3) if zlib.crc32(str(i).encode()) % 5}

    def grams(t):
        w = [hashed(x) for x in words_of(t)]
        two = [int(mix(np.array([(a * 0xD6E8FEB86659FD93 + b) % (1 << 64)], np.uint64))[0]) for a, b in zip(w, w[1:], strict=False)]
        return [g % quality.BUCKETS for g in w + two]

    raw, target = np.ones(quality.BUCKETS), np.ones(quality.BUCKETS)
    for i, t in zip(ids, texts, strict=True):
        for g in grams(t):
            raw[g] += 1
            target[g] += i in good
    ratio = np.log(target / target.sum()) - np.log(raw / raw.sum())
    out = quality.importance_resample(docs, labels, keep=0.4)
    noise = {r.doc_id: (r.c, r.t) for r in docs.selectExpr("doc_id", "(shiftrightunsigned(xxhash64(0, cast(doc_id as string)), 11) + 0.5) / power(2d, 53) as c", "shiftrightunsigned(xxhash64(doc_id, 0), 1) as t").collect()}
    want = []
    for i, t in zip(ids, texts, strict=True):
        score = sum(ratio[g] for g in grams(t))
        want.append((i, score, score - math.log(-math.log(noise[i][0]))))
    got = sorted((r.doc_id, r.log_ratio, r.key, r.selected) for r in out.collect())
    for (i, score, key), r in zip(sorted(want), got, strict=True):
        assert i == r[0] and score == pytest.approx(r[1], abs=1e-6) and key == pytest.approx(r[2], abs=2e-6)
    first = sorted(range(55), key=lambda n: -sorted(want)[n][2])[:22]
    assert [n for n in range(55) if got[n][3]] == sorted(first)
    # equal texts and a constant noise: ties go by the hash of doc_id
    same = table(spark, ["a b c"] * 9, [5] * 9)
    assert quality.importance_resample(same, labels, keep=0.3).filter("selected").count() == 9


def test_importance_resampling(spark):
    rng = random.Random(6)
    fine = [prose(rng, 80) for _ in range(60)]
    junk = [" ".join(rng.choice("qxzjkv") * rng.randint(1, 9) for _ in range(80)) for _ in range(60)]
    docs = table(spark, [*fine, *junk, None, ""])
    labels = spark.createDataFrame([(i, int(i < 60)) for i in range(0, 120, 2)], "doc_id long, quality int")
    out = {r.doc_id: r for r in quality.importance_resample(docs, labels, keep=0.5).collect()}
    assert sum(r.selected for r in out.values()) == 61 and out[120].score == 0.0
    assert np.mean([out[i].score for i in range(60)]) > np.mean([out[i].score for i in range(60, 120)]) + 0.2
    assert sum(out[i].selected for i in range(60)) >= 58
    again = {r.doc_id: r.key for r in quality.importance_resample(docs.repartition(3), labels, keep=0.5).collect()}
    assert again == {i: r.key for i, r in out.items()}
    assert quality.importance_resample(empty(docs), labels).count() == 0


@given(st.lists(st.integers(-(1 << 40), 1 << 40), min_size=1, max_size=30))
@settings(max_examples=3, deadline=None)
def test_kth_largest(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v long").cache()
    k = random.Random(len(values)).randint(1, len(values))
    assert quality.kth_largest(df, "v", k) == sorted(values, reverse=True)[k - 1]


# ---- op6
@pytest.mark.parametrize("scale", [1.0, 1e6, 1e12])
def test_best_of_block(scale):
    rng = np.random.default_rng(8)
    x = np.floor(rng.normal(size=(300, 12)) * 40 * scale).astype(np.int64)
    x[50] = x[10]
    q, ids = x[::30], np.arange(300) * 7
    got = topk_search.best_of_block(q, np.arange(0, 300, 30), x, np.arange(300), ids, 5)
    for i in range(0, 300, 30):
        scores = sorted((-sum(int(a) * int(b) for a, b in zip(x[i], x[j], strict=True)), 7 * j) for j in range(300) if j != i)
        assert [(j, -s) for s, j in scores[:5]] == [r[1:3] for r in got if r[0] == i]


def test_queries_stop_before_the_lists_end():
    rng = np.random.default_rng(9)
    x = np.floor(rng.exponential(size=(4000, 3)) * 100).astype(np.int64)
    got = topk_search.best_of_block(x[:20], np.arange(20), x, np.arange(4000), np.arange(4000), 5)
    assert max(r[3] for r in got) < 4000  # bounds, not the end of the lists, stop them
    for i in range(20):
        scores = sorted((-int(x[i] @ x[j]), j) for j in range(4000) if j != i)
        assert [(j, -s) for s, j in scores[:5]] == [r[1:3] for r in got if r[0] == i]


def test_exact_top_k(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(v) for v in rng.normal(size=4)], "x") for i in range(60)]
    rows += [(100, None, "x"), (101, [1.0, None, 1.0, 1.0], "x"), (102, [1.0, float("nan"), 0.0, 0.0], "x"), (103, [float("inf")] * 4, "x"), (104, [9.0, 9.0], "x"), (7, rows[7][1], "x"), (20, rows[9][1], "x"), (None, rows[9][1], "x"), (110, [], "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, row string")
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in topk_search.exact_top_k(df, "vec_id % 10 = 0", 5).collect())
    ints = [(i, [math.floor(256 * float(np.float32(v))) for v in e]) for i, e, _ in [*rows[:60], *rows[65:67]]]
    want = []
    for n, (i, q) in enumerate(ints):
        if i % 10 == 0:
            best = sorted((-sum(a * b for a, b in zip(q, e, strict=True)), j) for m, (j, e) in enumerate(ints) if m != n)[:5]
            want += [(i, r + 1, j, -s) for r, (s, j) in enumerate(best)]
    assert got == sorted(want)
    assert topk_search.exact_top_k(df.filter("false"), "true").count() == 0
    assert topk_search.exact_top_k(df.filter("vec_id = 3"), "true").count() == 0


def test_huge_components_have_defined_scores(spark):
    rows = [(0, [1e12, 1.0]), (1, [1e15, 2.0]), (2, [-1e15, 3.0]), (3, [1e17, 0.0]), (4, [1e300, 0.0]), (5, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r.vec_id: r.score for r in topk_search.exact_top_k(df, "vec_id = 0", 9).collect()}
    top = (1 << 63) - 1
    assert got == {1: top, 2: -top, 5: 256_000_000_000_000 * 256 + 256 * 256}


# ---- op7
def brute_removed(texts, length, keep_first):
    raws = [(t or "").encode() for t in texts]
    seen = {}
    for i, r in enumerate(raws):
        for j in range(len(r) - length + 1):
            seen.setdefault(r[j : j + length], []).append((i, j))
    out = []
    for i, r in enumerate(raws):
        gone = np.zeros(len(r), bool)
        for j in range(len(r) - length + 1):
            places = seen[r[j : j + length]]
            if len(places) > 1 and not (keep_first and places[0] == (i, j)):
                gone[j : j + length] = True
        out.append((int(gone.sum()), hashlib.sha256(np.frombuffer(r, np.uint8)[~gone].tobytes()).hexdigest()))
    return out


@pytest.mark.parametrize("group", [1, 4096])
def test_repeated_ranges(spark, texts, group):
    docs = table(spark, texts).repartition(4)
    cuts = suffix_dedup.repeated_ranges(docs, 100, 16, group).collect()
    for keep_first in (False, True):
        want = brute_removed(texts, 100, keep_first)
        for i, t in enumerate(texts):
            gone = np.zeros(len((t or "").encode()), bool)
            for r in cuts:
                if r.doc_id == i and r.earlier == keep_first:
                    gone[r.start : r.stop] = True
            # equal texts of one row set stay alike where the first copy stays, so only different doc_ids are held here
            assert int(gone.sum()) == want[i][0], (keep_first, i)


def test_suffix_dedup(spark, texts):
    docs = table(spark, texts)
    out = {r.doc_id: r for r in suffix_dedup.suffix_dedup(docs, keep_first=False, length=100).collect()}
    want = brute_removed(texts, 100, False)
    assert {i: (r.n_removed, r.kept_sha256) for i, r in out.items()} == dict(enumerate(want))
    assert out[30].text is None and out[0].lang == "en"
    twice = table(spark, ["x" * 50 + "y" * 100] * 2, [3, 3])
    assert [r.n_removed for r in suffix_dedup.suffix_dedup(twice, False, 100).collect()] == [150, 150]
    assert suffix_dedup.suffix_dedup(empty(docs)).count() == 0


def test_first_copies_are_told_from_later_ones(spark, texts):
    docs = table(spark, texts)
    want = [n for n, _ in brute_removed(texts, 100, True)]
    for keep_first in (False, True):
        out = {r.doc_id: r.n_later for r in suffix_dedup.suffix_dedup(docs, keep_first, 100).collect()}
        assert [out[i] for i in range(len(texts))] == want, keep_first
    passage = " ".join(f"word{i}" for i in range(60))  # 60 words, 409 bytes
    shared = table(spark, [f"one {passage} end", "x" * 30, f"other {passage} tail"], [5, 6, 7])
    assert {r.doc_id: (r.n_removed, r.n_later) for r in suffix_dedup.suffix_dedup(shared, False).collect()} == {5: (411, 0), 6: (0, 0), 7: (411, 411)}


def test_long_rows_are_cut_into_chunks_without_loss(spark, monkeypatch):
    rng = random.Random(3)
    body = "".join(rng.choice("abcdefgh") for _ in range(5000))
    column = table(spark, [body + body[100:900]]).select("text").toArrow().column(0).combine_chunks()
    monkeypatch.setattr(suffix_dedup, "_CHUNK", 700)
    starts = []
    for _, shift, data, offsets in suffix_dedup._chunked(column, 100):
        first, last, _, _ = suffix_dedup.anchors(data, offsets, 100, 16)
        starts += [s + shift for a, z in zip(first, last, strict=True) for s in range(a, z + 1)]
    assert sorted(starts) == list(range(5800 - 99))


# ---- op8
def test_source_targets_fill_up(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 500), (None, 90)], "source string, size long")
    got = {r.source: (r.source_size, r.target) for r in source_mix.source_targets(sizes).collect()}
    left, weights = 1600.0, {"a": 5, "b": 2, "c": 1, None: 5}
    want = {}
    while True:
        free = {s: left * w / sum(weights.values()) for s, w in weights.items()}
        over = [s for s in free if free[s] > 3 * got[s][0]]
        if not over:
            want |= free
            break
        for s in over:
            want[s] = 3.0 * got[s][0]
            left -= want[s]
            weights.pop(s)
    assert {s: t for s, (_, t) in got.items()} == pytest.approx(want)


def test_source_mix(docs, texts):
    out = source_mix.source_mix(docs, block_tokens=16).collect()
    assert len(out) == len(texts)
    sizes = {i: len(re.findall("[^\x20\x09-\x0d]+", t or "")) for i, t in enumerate(texts)}
    taken, target = {}, {}
    for r in out:
        assert r["size"] == sizes[r.doc_id] and 0 <= r.taken <= 3 * r["size"]
        source = f"s{r.doc_id % 3}" if r.doc_id % 7 else None
        taken[source], target[source] = taken.get(source, 0) + r.taken, r.target
    assert all(taken[s] == math.floor(target[s]) for s in taken)
    pieces = source_mix.mix_schedule(docs, block_tokens=16).collect()
    words = {}
    for r in pieces:
        assert 0 <= r["first"] < r["stop"] <= sizes[r.doc_id]
        words[r.doc_id] = words.get(r.doc_id, 0) + r["stop"] - r["first"]
    assert words == {r.doc_id: r.taken for r in out if r.taken}
    again = source_mix.source_mix(docs.repartition(2), block_tokens=16).collect()
    assert {r.doc_id: r.taken for r in out} == {r.doc_id: r.taken for r in again}
    assert source_mix.source_mix(empty(docs)).count() == 0
    assert [r.taken for r in source_mix.source_mix(docs.filter("doc_id = 30")).collect()] == [0]


@pytest.mark.parametrize(("n", "sources"), [(12, 3), (300, 20), (1000, 4)])
def test_sources_reach_their_targets_on_small_tables(spark, n, sources):
    rng = random.Random(n)
    rows = [(i, " ".join(["w"] * rng.randrange(60)), f"s{i % sources}") for i in range(n)]
    taken, target = {}, {}
    for r in source_mix.source_mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), keep=("doc_id", "source")).collect():
        taken[r.source], target[r.source] = taken.get(r.source, 0) + r.taken, r.target
    assert all(abs(taken[s] - target[s]) < 1 for s in target) and len(target) == sources


def test_blocks_of_all_sources_are_of_nearly_one_size_and_bounded_in_number(spark, monkeypatch):
    targets = source_mix.source_targets(spark.createDataFrame([("a", 500_000), ("b", 70_000), (None, 4_000)], "source string, size long")).cache()
    blocks = [r.stop - r["first"] for r in source_mix.slots(targets).collect()]
    assert sum(blocks) == sum(r.whole for r in targets.collect()) and 60 <= min(blocks) and max(blocks) <= 68
    monkeypatch.setattr(source_mix, "MOST_SLOTS", 100)
    assert source_mix.slots(targets).count() <= 110


def test_schedule_is_even_over_time(spark):
    targets = source_mix.source_targets(spark.createDataFrame([("a", 5000), ("b", 5000), ("c", 5000)], "source string, size long"))
    rows = sorted((r.slot, r["rank"]) for r in source_mix.slots(targets, 16).collect())
    for part in (100, 300, 700):
        share = sum(r == 0 for _, r in rows[:part]) / part
        assert abs(share - 5 / 8) < 0.03


# ---- op9
def brute_base(text):
    text = text or ""
    spans = [(m.start(), 0, m.end()) for m in re.finditer(r"(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text) if len(m[1]) >= 6]
    spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return [f"{('assign', 'access', 'hex')[k]}:{a}:{z}" for a, k, z in sorted(spans)]


def test_secret_scan(spark):
    rng = random.Random(7)
    token = lambda alphabet, n: "".join(rng.choice(alphabet) for _ in range(n))
    b64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    random_token = token(b64, 64)
    texts = [
        "é password = \"abcdef12\" PassWord:abc secret: token: abcdefgh", "AKIA" + "B" * 16 + " xAKIAAKIA" + "C" * 11, "0" * 24 + " " + "f" * 23 + "x" + token("0123456789abcdef", 40),
        f"key {random_token} and Donaudampfschifffahrtsgesellschaft internationalizations_everywhere_here", None, "", "token=" + "a" * 5, "api_key='" + token(b64, 40) + "'" * 2, "apikey=x" * 3, "password" * 4000,
    ]
    out = {r.doc_id: r for r in secret_scan.secret_scan(table(spark, texts)).collect()}
    for i, t in enumerate(texts):
        base = brute_base(t)
        assert out[i].base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest(), (i, base, out[i].spans)
        assert [s for s in out[i].spans.split(",") if s and not s.startswith("random")] == base
        assert (out[i].n_assign, out[i].n_access, out[i].n_hex) == tuple(sum(s.startswith(k) for s in base) for k in ("assign", "access", "hex"))
    assert out[3].spans == f"random:4:{4 + len(random_token)}"
    assert secret_scan.secret_scan(table(spark, texts).filter("false")).count() == 0


def brute_battery(token):
    _, _, alphabet = next(e for e in secret_scan.ENCODINGS if re.search(e[1], token))
    codes, k, n = [alphabet.index(c) for c in token], len(alphabet), len(token)
    phi = lambda z: 0.5 * math.erfc(-z / math.sqrt(2))
    chi2 = sum((codes.count(a) - n / k) ** 2 / (n / k) for a in range(k))
    p_chi2 = 1 - phi(((chi2 / (k - 1)) ** (1 / 3) - (1 - 2 / (9 * (k - 1)))) / math.sqrt(2 / (9 * (k - 1))))
    high = [c > (k - 1) / 2 for c in codes]
    runs, up = 1 + sum(a != b for a, b in zip(high, high[1:], strict=False)), sum(high)
    mean = 1 + 2 * up * (n - up) / n
    spread = (mean - 1) * (mean - 2) / (n - 1)
    z_runs = (runs - mean) / math.sqrt(spread) if spread > 0 else 9.0
    mu = sum(codes) / n
    around = sum((c - mu) ** 2 for c in codes)
    z_serial = (sum((a - mu) * (b - mu) for a, b in zip(codes, codes[1:], strict=False)) / around + 1 / n) * math.sqrt(n) if around else 9.0
    p_random = min(p_chi2, *(2 * phi(-abs(z)) for z in (z_runs, z_serial)))
    share = {c: f / sum(secret_scan.LETTERS.values()) for c, f in secret_scan.LETTERS.items()}
    score = {c: math.log(26 * f) for c, f in share.items()}
    ave = sum(share[c] * score[c] for c in share)
    sd = math.sqrt(sum(share[c] * (score[c] - ave) ** 2 for c in share))
    letters = [c for c in token.lower() if c in share]
    likely = phi(sum(score[c] - ave for c in letters) / (secret_scan.WIDER * sd * math.sqrt(len(letters)))) if letters else 1.0
    kinds = ["d" if c.isdigit() else "u" if c.isupper() else "l" if c.islower() else c for c in token]
    changes = sum(a != b for a, b in zip(kinds, kinds[1:], strict=False))
    often = phi(-(changes - 0.5 - secret_scan.CHANGES * (n - 1)) / math.sqrt(secret_scan.CHANGES * (1 - secret_scan.CHANGES) * (n - 1)))
    inside = sum(share[c] for c in "abcdef") ** len(letters) if re.fullmatch("[0-9a-f]+|[0-9A-F]+", token) else 1.0
    q = min(1.0, max(1e-300, likely * often * inside))
    return p_random, q * (1 - math.log(q))


def test_battery_against_brute_force(spark):
    rng = random.Random(17)
    draw = lambda a, n: "".join(rng.choice(a) for _ in range(n))
    tokens = [draw(e[2], n) for e in secret_scan.ENCODINGS for n in (20, 41)] + ["a" * 20, "aB3-" * 6, "internationalizations", "path/to/some/file_name_here", "B" * 30 + "7", "AbstractSingletonProxyFactoryBean"]
    tokens = [t for t in tokens if not t.isdigit()]
    out = {r.match: r for r in secret_scan._battery(spark.createDataFrame([(t,) for t in tokens], "match string")).collect()}
    for t in tokens:
        p_random, p_text = brute_battery(t)
        assert out[t].p_random == pytest.approx(p_random, abs=1e-6) and out[t].p_text == pytest.approx(p_text, rel=1e-2, abs=1e-6), t


def test_random_tokens_of_all_encodings_are_found(spark):
    rng = random.Random(18)
    words = ["release", "version", "station", "morning", "paper", "window", "address", "service", "controller", "manager", "internal", "between", "another", "response", "general", "section"]
    draw = lambda a, n: "".join(rng.choice(a) for _ in range(n))
    join = lambda sep, cap: sep.join((w.capitalize() if cap else w) for w in rng.choices(words, k=7))
    texts = [f"{join('', True)} {join('_', False)} {join('', False)} {join('', False).upper()} {join('/', True)}" for _ in range(100)]
    for _, _, alphabet in secret_scan.ENCODINGS[1:-1]:
        texts += [f"see {draw(alphabet, 28)} now" for _ in range(30)]
    flags = {r.doc_id: r.n_random for r in secret_scan.secret_scan(table(spark, texts)).collect()}
    assert sum(flags[i] for i in range(100)) <= 0.05 * sum(flags.values()) + 5
    for e in range(len(secret_scan.ENCODINGS) - 2):
        assert sum(flags[100 + 30 * e + i] > 0 for i in range(30)) >= 26, secret_scan.ENCODINGS[1 + e][0]


# ---- op10
def test_line_dedup(spark):
    rng = random.Random(11)
    line = lambda: prose(rng, 6).replace("\n", " ")
    passage, others = [line() for _ in range(40)], [[line() for _ in range(12)] for _ in range(4)]
    texts = ["\n".join(others[0] + passage), "\n".join(others[1] + passage + others[2]), "\n".join(others[3]), None, "", "\n\n\n", "one\ntwo", "x\ny", "x\nz"]
    out = {r.doc_id: r for r in line_dedup.line_dedup(table(spark, texts)).collect()}
    assert out[0].text == texts[0] and out[0].n_removed == 0
    left = out[1].text.split("\n")
    assert [x for x in left if x in others[1] + others[2]] == others[1] + others[2] and out[1].n_removed >= 25 and len(left) + out[1].n_removed == out[1].n_lines
    assert out[2].text == texts[2] and out[3].text is None and out[4].text == ""
    same = {r.doc_id: r for r in line_dedup.line_dedup(table(spark, [texts[2], texts[2]])).collect()}
    assert same[0].n_removed == 0 and same[1].n_removed >= 8
    assert line_dedup.line_dedup(table(spark, texts).filter("false")).count() == 0


def brute_passages(texts):
    seen, out = {}, []
    for d, t in enumerate(texts):
        lines, gone = (t or "").split("\n"), set()
        for i, two in enumerate(zip(lines, lines[1:], strict=False)):
            if any(x.strip() for x in two) and (first := seen.setdefault(two, (d, i))) != (d, i):
                gone |= {i + 1} if first == (d, i - 1) else {i, i + 1}
        out.append((t if not gone else "\n".join(x for i, x in enumerate(lines) if i not in gone), len(gone)))
    return out


def test_passage_dedup_removes_short_passages_whole(spark):
    rng = random.Random(12)
    line = lambda: prose(rng, 12).replace("\n", " ")
    passages = [[line() for _ in range(n)] for n in (2, 3, 4, 5, 6)]
    own = [[line() for _ in range(5)] for _ in range(11)]
    texts = ["\n".join(own[i] + p + own[i + 1][:2]) for i, p in enumerate(passages)]
    texts += ["\n".join(own[6 + i][:3] + p + own[6 + i][3:]) for i, p in enumerate(passages)]
    texts += ["a\na\na\na", None, "", "\n\n\n", "x\ny", "x\nz", "\n\n\nq"]
    out = {r.doc_id: r for r in line_dedup.passage_dedup(table(spark, texts)).collect()}
    for i, p in enumerate(passages):
        assert out[5 + i].text.split("\n") == own[6 + i] and (out[5 + i].n_removed, out[5 + i].n_chunks) == (len(p), 1)
    assert [(out[i].text, out[i].n_removed) for i in range(len(texts))] == brute_passages(texts)
    assert out[10].text == "a\na" and [out[i].n_chunks for i in (10, 11, 14)] == [1, 0, 0]
    assert corpus_pipeline.cut_lines(spark, table(spark, texts), "").filter("doc_id = 5").first().text.split("\n") == own[6]


def test_passages_come_from_content_defined_chunks_and_equal_bytes(spark, monkeypatch):
    rng = random.Random(13)
    line = lambda: prose(rng, 6).replace("\n", " ")
    passage, own = [line() for _ in range(40)], [[line() for _ in range(9)] for _ in range(4)]
    every = ["\n".join(own[0] + passage), "\n".join(own[1] + passage + own[2]), "\n".join([*passage[30:33], *own[3], *passage[3:9], "", "", *passage[:4], "", ""]), "b\nb\nb\nb\nb", "\n".join(passage)]
    docs = table(spark, every)
    place = lambda rows: {(r.doc_id, r["from"], r["lines"]) for r in rows.collect()}
    later, firsts = line_dedup.repeated_passages(docs)
    chunks, chunk_firsts = line_dedup.repeated_chunks(docs)
    assert place(chunks) and place(chunks) <= place(later) and place(chunk_firsts) <= place(firsts)
    inside = {(d, i) for d, frm, n in place(chunks) for i in range(frm, frm + n - 1)}
    pairs = place(later) - place(chunks)
    assert {n for _, _, n in pairs} == {2} and not inside & {(d, frm) for d, frm, _ in pairs}  # two lines only where no chunk is
    out = {r.doc_id: (r.text, r.n_removed) for r in line_dedup.passage_dedup(docs).collect()}
    assert [out[i] for i in range(len(every))] == brute_passages(every)

    sha2 = line_dedup.F.sha2
    monkeypatch.setattr(line_dedup.F, "sha2", lambda c, n: sha2(line_dedup.F.substring(c, 1, 1), n))  # lines of one first letter collide
    out = {r.doc_id: r for r in line_dedup.passage_dedup(docs).collect()}
    for i, (text, n) in enumerate(brute_passages(every)):
        assert out[i].n_removed <= n and {*text.split("\n")} - {""} <= {*out[i].text.split("\n")}


# ---- shared helpers and the pipeline
@given(st.lists(st.text(alphabet="aB9é -\n", max_size=20), min_size=1, max_size=6))
def test_word_bounds(texts):
    import pyarrow as pa

    lower, is_word = fold_table(NOT_ALNUM)
    got = []
    for _, data, offsets in pieces(pa.array(texts), 16):
        starts, ends, first = word_bounds(is_word[data], offsets)
        for a, z in zip(first[:-1], first[1:], strict=True):
            got.append([lower[data[starts[i] : ends[i]]].tobytes().decode() for i in range(a, z)])
    assert got == [re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", t.lower()) for t in texts]


def test_pipeline_stages(spark, texts, tmp_path):
    rng = random.Random(12)
    docs = table(spark, [*texts, *(prose(rng, 80) + (" vile foul" if i % 4 == 0 else "") for i in range(100))])
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i + len(texts), int(i % 4 == 0)) for i in range(100)], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, texts[7])], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    now = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, now, str(tmp_path))
        assert out.columns == docs.columns, name
        out.write.parquet(str(tmp_path / name))
        now = spark.read.parquet(str(tmp_path / name))
    kept = {r.doc_id for r in now.collect()}
    assert 7 not in kept and not kept & {i + len(texts) for i in range(0, 100, 4)} and len(kept & {i + len(texts) for i in range(100) if i % 4}) == 75
    final = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in final} <= kept and all(0 < r.taken <= 3 * r["size"] for r in final)
    nothing = docs.filter("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, nothing, str(tmp_path)).count() == 0


def test_pipeline_against_brute_force(spark, texts, tmp_path):
    """Every stage on what its predecessor kept; the field's scores are held against enumeration above."""
    rng = random.Random(71)
    item = prose(rng, 40).replace("\n", " ")
    passage = "\n".join(prose(rng, 15).replace("\n", " ") for _ in range(3))
    every = [*texts, *(prose(rng, 80) + (" vile foul" if i % 4 == 0 else "") for i in range(60))]
    every += [prose(rng, 90) + " " + item, item + " " + prose(rng, 900), passage + "\n" + prose(rng, 40), prose(rng, 30) + "\n" + passage, every[50], " ".join([*every[51].split(" ")[:-1], "zzz"])]
    docs = table(spark, every)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i + len(texts), int(i % 4 == 0)) for i in range(60)], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {(r.doc_id, r.text): (r["size"], r.taken) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    scores = {r.doc_id: r.score for r in toxicity.toxicity(docs, spark.read.parquet(str(tmp_path / "labels.parquet"))).collect()}
    kept = [(i, t) for i, t in enumerate(every) if scores[i] < 0.5]
    cut = brute_passages([t for _, t in kept])
    kept = [(i, t) for (i, _), (t, n) in zip(kept, cut, strict=True) if n == 0 or n < len((t or "").split("\n")) + n and t != ""]
    sets = [simhash_dedup.shingle_set(t, 5) for _, t in kept]

    def alike(i, j):
        a, b, both = len(sets[i]), len(sets[j]), len(np.intersect1d(sets[i], sets[j]))
        return a == b == 0 or (a + b - both > 0 and both / (a + b - both) >= 0.8)

    kept = [kept[i] for i in sorted(set(groups(len(kept), alike)))]
    kept = [(i, t) for i, t in kept if not (lambda n, hit, _: hit > 0 and 20 * hit >= n)(*brute_hits(t, [(1, item)]))]
    size = {i: len(re.findall("[^\x20\x09-\x0d]+", t or "")) for i, t in kept}
    of = lambda i: f"s{i % 3}" if i % 7 else None
    sources = sorted({of(i) for i, _ in kept}, key=lambda s: (s is None, s))
    whole, left, free = {}, float(sum(size.values())), list(sources)
    weight = {s: (5, 2, 1)[n % 3] for n, s in enumerate(sources)}
    most = {s: 3 * sum(size[i] for i, _ in kept if of(i) == s) for s in sources}
    while free:
        fair = {s: left * weight[s] / sum(weight[f] for f in free) for s in free}
        over = [s for s in free if fair[s] > most[s]]
        for s in over or free:
            whole[s] = math.floor(most[s] if over else fair[s])
            left -= most[s] if over else 0
        free = [s for s in free if s in over and False or s not in whole]
    want = {}
    for s in sources:
        take, at = whole[s], 0
        stream = sorted((hashlib.md5(f"0:{i}".encode()).hexdigest(), i, t) for i, t in kept if of(i) == s and size[i])
        length = sum(size[i] for _, i, _ in stream)
        for _, i, t in stream:
            taken = take // length * size[i] + max(0, min(at + size[i], take % length) - at)
            at += size[i]
            if taken:
                want[i, t] = (size[i], taken)
    assert got == want


CLASHES = ("key", "start", "node", "row", "score", "n_lines", "n_removed", "fp", "first", "hash", "_key", "_row", "_id", "_order", "_copy", "_in", "_text", "_doc", "_of", "_place", "whole", "kept", "good", "rank", "a.b", "spans")


def test_extra_columns_with_clashing_names(spark, texts, tmp_path):
    docs = table(spark, texts[:8]).selectExpr("*", *[f"doc_id * 100 + {n} as `{c}`" for n, c in enumerate(CLASHES)])
    benchmark = spark.createDataFrame([(1, texts[0], 5, 6)], "item_id long, text string, doc_id int, print int")
    labels = spark.createDataFrame([(1, 1, 1, 7), (2, 0, 0, 8)], "doc_id long, toxic int, quality int, good int")

    def carried(out, replaced=()):
        rows = out.collect()
        assert all(c in out.columns for c in docs.columns)
        for r in rows:
            row = dict(zip(out.columns, r, strict=True))
            assert all(row[c] == row["doc_id"] * 100 + n for n, c in enumerate(CLASHES) if c not in replaced)
        return len(rows)

    assert carried(decontaminate.drop_contaminated(docs, benchmark)) == 7
    assert carried(simhash_dedup.similar_dedup(docs)) == 8
    assert carried(toxicity.toxicity(docs, labels), ("score", "spans")) == 8
    assert carried(line_dedup.line_dedup(docs), ("n_lines", "n_removed")) == carried(line_dedup.passage_dedup(docs), ("n_lines", "n_removed")) == 8
    assert carried(substring_dedup.substring_dedup(docs), ("n_removed",)) == 8
    assert carried(suffix_dedup.suffix_dedup(docs), ("n_removed", "spans")) == 8
    assert carried(source_mix.source_mix(docs, keep=tuple(docs.columns)), ("size",)) == 8
    assert simhash_dedup.simhash_classes(docs).count() == quality.importance_resample(docs, labels).count() == secret_scan.secret_scan(docs).count() == 8
    assert decontaminate.contamination(docs, benchmark).count() == 8 and source_mix.mix_schedule(docs).count() > 0
    vectors = spark.createDataFrame([(i, [1.0, float(i)], 5, 6, 7) for i in range(5)], "vec_id long, embedding array<float>, row int, ints int, `a.b` int")
    assert topk_search.exact_top_k(vectors, "vec_id = 1", 2).count() == 2
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    benchmark.write.parquet(str(tmp_path / "benchmark.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        carried(out, ("size",) if name == "source_mix" else ())
        assert name == "source_mix" or out.columns == docs.columns


def test_repeated_rows_and_very_long_texts(spark):
    rng = random.Random(51)
    long = prose(rng, 30_000)
    every = [long, long, long[:-40], "x" * 300_000, "y " * 60_000, ".\n" * 20_000, prose(rng, 50), prose(rng, 50), None, None]
    ids = [1, 1, 1, 4, 5, 6, 7, 7, 8, 8]
    docs = table(spark, every, ids)
    labels = spark.createDataFrame([(1, 1, 1), (7, 0, 0)], "doc_id long, toxic int, quality int")
    benchmark = spark.createDataFrame([(1, long[:2000])], "item_id long, text string")
    n = len(every)
    prints = {(r.doc_id, r.fingerprint) for r in simhash_dedup.simhash_classes(docs).collect()}
    assert prints == {(i, f"{brute_fingerprint(t):016x}") for i, t in zip(ids, every, strict=True)}
    assert sorted(r.doc_id for r in simhash_dedup.similar_dedup(docs).collect()) == [1, 4, 5, 6, 7, 7, 8]
    got = sorted((r.doc_id, r.n_words, r.n_hit) for r in decontaminate.contamination(docs, benchmark).collect())
    assert [g[:2] for g in got] == sorted((i, len(words_of(t))) for i, t in zip(ids, every, strict=True)) and sum(g[2] > 0 for g in got) == 3
    out = line_dedup.line_dedup(docs), substring_dedup.substring_dedup(docs), suffix_dedup.suffix_dedup(docs), toxicity.toxicity(docs, labels), quality.importance_resample(docs, labels), secret_scan.secret_scan(docs), toxicity.toxicity_scores(docs, labels)
    assert [o.count() for o in out] == [n] * 7
    passages = line_dedup.passage_dedup(docs).collect()
    assert len(passages) == n and [r.text for r in passages if r.doc_id == 6] == [brute_passages([every[5]])[0][0]]
    mixed = source_mix.source_mix(docs).collect()
    assert len(mixed) == n and all(0 <= r.taken <= 3 * r["size"] for r in mixed) and sum(r.taken for r in mixed) > 0
    again = source_mix.source_mix(docs.repartition(4)).collect()
    assert sorted((r.doc_id, r["size"], r.taken) for r in mixed) == sorted((r.doc_id, r["size"], r.taken) for r in again)
    vectors = spark.createDataFrame([(i, [float(v % 7) for v in range(500)]) for i in (1, 1, 2)], "vec_id long, embedding array<double>")
    assert [r.vec_id for r in topk_search.exact_top_k(vectors, "vec_id = 2").orderBy("rank").collect()] == [1, 1]


def test_longest_factors_against_brute_force():
    rng = np.random.default_rng(61)
    for size, length in ((300, 16), (500, 40), (200, 100)):
        text = np.repeat(rng.integers(97, 99, size), 1).astype(np.uint8)
        text[size // 2 :] = text[: size - size // 2]
        raw, starts = text.tobytes(), np.arange(size - length + 1)
        group = (starts >= size // 4).astype(int)

        def common(i, j):
            return next((n for n in range(length) if raw[i + n] != raw[j + n]), length)

        previous, following = suffix_dedup.longest_factors(suffix_dedup.suffix_ranks(text, length), starts, group)
        for i in starts:
            own = [j for j in starts if group[j] == group[i]]
            for got, want in ((previous[i], max([common(i, j) for j in own if j < i], default=0)), (following[i], max([common(i, j) for j in own if j > i], default=0))):
                assert (got == length) == (want == length) and got <= want and got >= want - want % 8 - (8 if want == length else 0), (i, got, want)
