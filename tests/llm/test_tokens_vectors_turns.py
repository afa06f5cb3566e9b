"""Whitening, conversation repair and byte-level BPE against brute force, and their edge cases."""

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from memspark.llm import byte_bpe, conversation_repair, whitening

VECTORS = "vec_id long, embedding array<double>, x string, n int"


# ---- op11
def brute_whitening(rows, k=16):
    x = np.array([[int(np.floor(64 * c)) + 1_000_000 for c in v] for _, v in rows], dtype=object)
    fit = sorted({tuple(r) for r in x.tolist()})
    n, total = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    centred = np.array([[float(n * a - s) / n for a, s in zip(r, total, strict=True)] for r in fit])
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    keep = [i for i in range(len(values))[::-1] if values[i] > 1e-9 * values[-1]][:k]
    deviation = [sum((n * a - s) ** 2 for a, s in zip(r, total, strict=True)) for r in x.tolist()]
    mean = np.array([[float(n * a - s) / n for a, s in zip(r, total, strict=True)] for r in x.tolist()])
    return n, deviation, mean @ vectors[:, keep] / np.sqrt(values[keep]), values[keep] / values.sum()


def whitened(spark, rows):
    return sorted(map(tuple, whitening.whiten(spark.createDataFrame([(i, v, "a", 1) for i, v in rows], VECTORS).repartition(3)).collect()), key=lambda r: (r[0], r[1]))


@pytest.mark.parametrize("spread", [1.0, 0.3])
def test_whitening_against_brute_force(spark, spread):
    rng = np.random.default_rng(4)
    rows = [(i, (rng.standard_normal(24) * spread ** np.arange(24) * 3 + 5).tolist()) for i in range(150)]
    rows += [(500, rows[0][1]), (501, rows[0][1])]
    out = whitened(spark, rows)
    n, deviation, expected, explained = brute_whitening(rows)
    k = expected.shape[1]
    assert n == 150 and len(out) == len(rows) * k and {r[2] for r in out} == {n}
    assert [r[3] for r in out[::k]] == deviation
    got = np.array([r[4] for r in out]).reshape(-1, k)
    flip = np.sign((got * expected).sum(axis=0))
    assert np.abs(got - expected * flip).max() < 1e-6
    assert np.abs(np.array([r[5] for r in out[:k]]) / explained - 1).max() < 1e-6
    assert max(r[6] for r in out) < 1e-6


def test_whitening_leaves_out_rows_without_a_vector(spark):
    fine = [(i, [float(i % 7), float(i % 5), 1.0]) for i in range(20)]
    odd = [(90, None), (91, [1.0, None, 2.0]), (92, [float("nan")] * 3), (93, [float("inf"), 0.0, 0.0]), (94, []), (95, [1e17, 0.0, 0.0]), (96, [1.0])]
    out = whitened(spark, fine + odd)
    assert {r[0] for r in out} == set(range(20)) and {r[1] for r in out} == {1, 2}  # the third dimension does not vary
    assert whitened(spark, odd) == [] and whitened(spark, []) == [] and whitened(spark, [(1, [2.0, 3.0])] * 3) == []


def test_large_vectors_have_exact_deviations(spark):
    rows = [(0, [1e12, 0.0]), (1, [-1e12, 1.0]), (2, [0.5, 7.0])]
    out = whitened(spark, rows)
    _, deviation, _, _ = brute_whitening(rows)
    assert [r[3] for r in out if r[1] == 1] == [d if d < 1 << 63 else None for d in deviation]


@pytest.mark.parametrize("values", [[3.0] * 30, [5.0] * 20 + [1.0] * 10, list(np.logspace(0, -8, 30)), [1.0, 1.0 + 1e-13, 0.5], [2.0]])
def test_no_eigenvalue_is_missed(values):
    turn = np.linalg.qr(np.random.default_rng(1).standard_normal((len(values), len(values))))[0]
    matrix = turn @ np.diag(values) @ turn.T
    matrix = (matrix + matrix.T) / 2
    form = whitening.tridiagonal(matrix)
    top = np.sort(values)[::-1]
    for shift in (top[0] * 1.01, (top[0] + top[-1]) / 2.3, top[-1] * 0.99):
        assert whitening.count_above(form, shift) == (top > shift).sum()
    found = [whitening.contour_components(matrix, *s) for s in whitening.slices(matrix, 16)]
    got = np.sort(np.concatenate([v for v, _ in found]))[::-1]
    assert len(got) >= min(16, len(values)) and np.abs(got[:16] - top[: len(got[:16])]).max() < 1e-12 * top[0]
    for v, q in found:
        assert np.abs(matrix @ q - q * v).max() < 1e-11 * top[0]


# ---- op12
SPACES = " \t\n\x0b\x0c\r"
INSERT = {"": "u", "s": "u", "u": "a", "a": "u"}
ROLES = {"u": "user", "a": "assistant"}


def brute_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        key = ":".join(" " if v is None else str(v) for v in (conv, turn))
        role, text = (" " if v is None else v for v in (role, text))
        kind = zlib.crc32(key.encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(turn, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))


def brute_repair(rows):
    """Least (cost, audit, lines) from every place and state to the end."""
    faults, seen = [], set()
    for _, role, text in rows:
        bare = text.strip(SPACES)
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    allowed = {("", "s"), ("", "u"), ("s", "u"), ("a", "u"), ("u", "a")}
    after = None
    for i in range(len(rows), -1, -1):
        best = {}
        for state in INSERT:
            options = [(0, "", ())] if i == len(rows) and state in ("", "a") else []
            if i < len(rows):
                _, role, text = rows[i]
                late = faults[i] == "truncated"
                cost, audit, lines = after[state]
                options.append((cost + 3, "D" + audit, lines))
                if faults[i] not in ("blank", "duplicate"):
                    for letter, to, name, price in (("K", role[:1], role, 0), ("R", INSERT[state], ROLES[INSERT[state]], 2)):
                        if letter == "R" or (state, to) in allowed:
                            cost, audit, lines = after[to]
                            options.append((cost + price + late, letter + audit, (f"{name}:{text}", *lines)))
            best[state] = min(options, default=(1 << 30, "", ()))
        for _ in range(4):
            for state, to in INSERT.items():
                cost, audit, lines = best[to]
                best[state] = min(best[state], (cost + 2, "I" + audit, (f"{ROLES[to]}:", *lines)))
        after = best
    turns = [t for t, _, _ in rows if t is not None]
    initials = [r[:1] for _, r, _ in rows]
    cost, audit, lines = after[""]
    return (
        max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
        sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False)), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest(),
    )


def turns(seed):
    rng = random.Random(seed)
    rows = []
    for conv in [*range(60), None]:
        for t in range(rng.choice([0, 1, 3, 8, 25])):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "User"])
            rows.append((conv, rng.choice([t, t, t, None, t + rng.randrange(3)]), role, rng.choice(["a.", "b!", "c", "d. ", "", "\n", None, "e?", f"f {rng.random()}."])))
    long = [(100, t, "user", f"x{t}.") for t in range(90)] + [(101, t, rng.choice(["user", "assistant"]), f"{rng.randrange(40)}.") for t in range(120)] + [(102, t % 2, "assistant", "same.") for t in range(80)]
    return rows + long


@pytest.mark.parametrize("chunk_rows", [4, 1024])
def test_repair_against_brute_force(spark, chunk_rows):
    rows = turns(chunk_rows)
    data = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, id string, cost int").repartition(3)
    out = {r[0]: tuple(r)[1:] for r in conversation_repair.damaged_and_repaired(data, chunk_rows).collect()}
    for conv in {r[0] for r in rows}:
        assert out[conv] == brute_repair(brute_damage([r for r in rows if r[0] == conv])), conv
    assert len(out) == len({r[0] for r in rows})


def test_repair_of_nothing_and_of_long_texts(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert conversation_repair.damaged_and_repaired(spark.createDataFrame([], schema)).count() == 0
    lost = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    kept = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 > 4)
    out = {r["conv_id"]: r for r in conversation_repair.damaged_and_repaired(spark.createDataFrame([(lost, 0, "user", "a."), (kept, 0, "user", "ab " * 700_000 + "."), (kept, 1 << 62, "assistant", "b")], schema)).collect()}
    assert out[lost]["audit"] == "" and out[lost]["cost"] == 0 and out[lost]["repaired_sha256"] == hashlib.sha256(b"").hexdigest()
    assert out[kept]["audit"][0] == "K" and out[kept]["gaps"] >= 0


def test_repaired_turns_alternate(spark):
    data = spark.createDataFrame(turns(9), "conv_id long, turn long, role string, text string")
    lines = conversation_repair.repaired_turns(conversation_repair.repair_pieces(data, 8)).collect()
    by_conv = {}
    for r in sorted(lines, key=lambda r: (r["conv_id"] or -1, r["piece"], r["place"])):
        by_conv.setdefault(r["conv_id"], []).append(r["role"][:1])
    assert all(re.fullmatch("(s?(ua)+)?", "".join(v)) for v in by_conv.values()) and len(by_conv) > 20


# ---- op13
@pytest.fixture(scope="module")
def ranks():
    return byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


@pytest.fixture(scope="module")
def reference(ranks):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def packed(encoding, text):
    return np.array(encoding.encode_ordinary(text or ""), "<u4").tobytes()


def odd_texts():
    rng = random.Random(2)
    kinds = ["abcdefgh", "aab", "ABCdef123 \n\t.,'", "éèçàüß漢字かな한글 😀‍", "0123456789abcdef", "՘֋࢏\U00011de0\x1c\x85​　 0a"]
    out = ["".join(rng.choice(kind) for _ in range(rng.choice([1, 2, 5, 20, 90]))) for kind in kinds for _ in range(60)]
    return [*out, None, "", " ", "<|endoftext|>", "a" * 3001, "ab" * 800, "-" * 999, " " * 400 + "x", "e" * 5 + "\r\n" * 7, "we'll they're I'D", out[7], out[7]]


def test_ids_are_those_of_the_library(spark, ranks, reference):
    texts = odd_texts()
    docs = spark.createDataFrame([(i, t, "x", 1, "y") for i, t in enumerate(texts)], "doc_id long, text string, ids string, n_tokens int, decoded string").repartition(3)
    out = {r["doc_id"]: r for r in byte_bpe.round_trip(docs, ranks, public_tokenizers.PATTERN).collect()}
    for i, t in enumerate(texts):
        assert bytes(out[i]["ids"]) == packed(reference, t), t
        assert bytes(out[i]["decoded"]) == (t or "").encode()
    digests = {r["doc_id"]: r for r in byte_bpe.token_digests(docs, ranks, public_tokenizers.PATTERN).collect()}
    assert digests[3]["n_tokens"] == len(reference.encode_ordinary(texts[3])) and digests[3]["ids_sha256"] == hashlib.sha256(packed(reference, texts[3])).hexdigest()
    back = byte_bpe.decode(byte_bpe.encode(docs, ranks, public_tokenizers.PATTERN), ranks)
    assert {r["doc_id"]: bytes(r["decoded"]) for r in back.collect()} == {i: (t or "").encode() for i, t in enumerate(texts)}
    assert byte_bpe.round_trip(docs.filter("false"), ranks, public_tokenizers.PATTERN).count() == 0


def test_coder_in_small_steps(ranks, reference, monkeypatch):
    monkeypatch.setattr(byte_bpe, "AT_ONCE", 50)
    monkeypatch.setattr(byte_bpe, "REMEMBERED", 20)
    coder = byte_bpe.Coder(ranks, public_tokenizers.PATTERN)
    texts = odd_texts()[::5]
    ids = coder.encode(texts)
    assert ids == [packed(reference, t) for t in texts] and coder.decode(ids) == [(t or "").encode() for t in texts]
    assert coder.decode([None, b""]) == [b"", b""]
    with pytest.raises(ValueError):
        coder.decode([np.array([50256], "<u4").tobytes()])
