"""Repeated strings, whitening and turn repair against brute force, and on nulls, empty and long values, ties, repeats and clashing columns."""

import collections
import hashlib
import random

import numpy as np
import pytest

from cellwright.llm import quality_knn, queries, repeats, turn_repair, whitening
from cellwright.llm.storage import Scratch

# Repeated strings -----------------------------------------------------------------


def cut_plainly(texts, length=200):
    times = collections.Counter(t[s : s + length] for t in texts for s in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for s in range(len(t) - length + 1):
            if times[t[s : s + length]] > 1:
                gone[s : s + length] = b"\1" * length
        edges = np.flatnonzero(np.diff(np.concatenate([[0], np.frombuffer(bytes(gone), np.uint8), [0]])))
        out.append((bytes(b for b, g in zip(t, gone, strict=True) if not g), [(int(a), int(b)) for a, b in edges.reshape(-1, 2)]))
    return out


def passages():
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyzéß木") for _ in range(rng.randint(2, 9))) for _ in range(400)]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    shared, border = say(60), say(90).encode()[:200].decode("utf-8", "ignore")
    texts = [None, "", "short", shared, shared, "x" * 199, "y" * 200, "z" * 201, "ab" * 150, "abc" * 3000]
    texts += [say(rng.randint(0, 40)) + shared + say(rng.randint(0, 40)) for _ in range(40)]
    texts += [say(5) + border + say(5) for _ in range(6)] + [say(60) + border[:-1] + say(3)]
    base = say(300)
    for k in range(15):  # near copies: one word differs
        w = base.split(" ")
        w[rng.randrange(300)] = f"edit{k}"
        texts.append(" ".join(w))
    once = say(200)
    return [*texts, once + "--" + once[100:700] + "--", say(2500)]


@pytest.mark.parametrize("block", [1024, 4])
def test_repeats_are_brute_force(spark, block):
    texts = passages()
    rows = spark.createDataFrame([(k // 2 if k % 5 else None, t, "c", "k", 1) for k, t in enumerate(texts)], "doc_id long, text string, cid string, kept_bytes string, spans int")
    out = repeats.cut_repeats(rows, Scratch(spark, "t"), block_pieces=block)
    assert out.columns == [*rows.columns, "kept_bytes1", "removed_spans"]
    want = collections.Counter((t, kept, tuple(spans)) for t, (kept, spans) in zip(texts, cut_plainly([(t or "").encode() for t in texts]), strict=True))
    got = collections.Counter((r.text, bytes(r.kept_bytes1), tuple((s.f, s.t) for s in r.removed_spans)) for r in out.collect())
    assert got == want and sum(bool(s) for _, _, s in want) > 60


def test_repeats_of_nothing_and_of_one_text(spark):
    schema = "doc_id long, text string"
    assert repeats.cut_repeats(spark.createDataFrame([], schema), Scratch(spark, "t")).count() == 0
    same = repeats.cut_repeats(spark.createDataFrame([(1, "q" * 150 + "w" * 60)] * 300, schema), Scratch(spark, "t")).collect()
    assert len(same) == 300 and all(r.kept_bytes == b"" and len(r.removed_spans) == 1 for r in same)
    alone = repeats.cut_repeats(spark.createDataFrame([(1, None), (None, "a")], schema), Scratch(spark, "t")).collect()
    assert {bytes(r.kept_bytes) for r in alone} == {b"", b"a"}


@pytest.mark.parametrize("length,symbol", [(24, 8), (12, 4), (3, 1)])
def test_collections_are_suffix_orders(length, symbol):
    rng = random.Random(length)
    for trial in range(40):
        pieces = [bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 90))) for _ in range(rng.randint(0, 12))]
        pieces += pieces[: trial % 3]
        want, got = collections.defaultdict(list), collections.defaultdict(list)
        for i, p in enumerate(pieces):
            for s in range(len(p) - length + 1):
                want[p[s : s + length]].append((i, s))
        for i, s, run in zip(*repeats.collection_runs(pieces, length, symbol), strict=True):
            got[run].append((int(i), int(s)))
        assert sorted(map(sorted, got.values())) == sorted(want.values())


def test_equal_windows_have_one_key():
    rng = random.Random(1)
    passage = bytes(rng.randrange(256) for _ in range(420))
    keys = []
    for _ in range(5):
        text = bytes(rng.randrange(256) for _ in range(rng.randint(0, 500))) + passage + bytes(rng.randrange(256) for _ in range(rng.randint(0, 300)))
        first, end, key, times = repeats.runs_of(text)
        assert first[0] == 0 and end[-1] == len(text) - 199 and (first[1:] == end[:-1]).all() and (end - first).max() <= repeats.STARTS
        at = text.index(passage)
        keys.append([int(key[np.searchsorted(first, s, "right") - 1]) for s in range(at, at + 221)])
    assert all(k == keys[0] for k in keys)
    assert (repeats.runs_of(b"ab" * 300)[3] == 2).all() and (repeats.runs_of(bytes(range(256)))[3] == 1).all()


# Whitening ------------------------------------------------------------------------


def whiten_plainly(vectors):
    x = [[int(np.floor(64 * float(c))) + 1_000_000 for c in v] for v in vectors]
    n, d = len(x), len(x[0])
    s = [sum(r[i] for r in x) for i in range(d)]
    y = [[n * r[i] - s[i] for i in range(d)] for r in x]
    v = np.array([[sum(r[i] * r[j] for r in y) / n**3 for j in range(d)] for i in range(d)])
    return n, [sum(c * c for c in r) for r in y], np.array(y, dtype=object) / n, v


@pytest.mark.parametrize("scale", [1.0, 1e9])
def test_whitening_is_brute_force(spark, scale):
    rng = np.random.default_rng(2)
    good = (rng.normal(size=(300, 40)) @ rng.normal(size=(40, 40)) * scale).astype(np.float32)
    rows = [(k, [float(c) for c in v], k) for k, v in enumerate(good)]
    bad = [(-1, None, 0), (-2, [1.0, None] + [0.0] * 38, 0), (-3, [float("nan")] * 40, 0), (-4, [float("inf")] + [0.0] * 39, 0)]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>, n int")
    out = {r.vec_id: r for r in whitening.whiten(df).collect()}
    n, deviation, centred, v = whiten_plainly(good)
    assert sorted(out) == list(range(300)) and all(r.n == n for r in out.values())
    assert [out[k].deviation for k in range(300)] == [s if s < 1 << 63 else None for s in deviation] and (scale > 1) == (out[0].deviation is None)
    e = np.linalg.eigvalsh(v)[::-1][:32]
    np.testing.assert_allclose(out[0].explained, e / np.trace(v), rtol=1e-9)
    w = np.array([out[k].whitened for k in range(300)])
    u = (w.T @ centred.astype(float)) / 300 / np.sqrt(e)[:, None]  # each component, from the rows it gave
    np.testing.assert_allclose(u @ u.T, np.eye(32), atol=1e-8)
    np.testing.assert_allclose(v @ u.T, u.T * e, atol=1e-8 * e[0])
    np.testing.assert_allclose(w.T @ w / 300, np.eye(32), atol=1e-9)
    assert 0 <= out[0].identity_error < 1e-9


def test_whitening_edges(spark):
    schema = "vec_id string, embedding array<float>, whitened string, vector int"
    assert whitening.whiten(spark.createDataFrame([], schema)).count() == 0
    one = whitening.whiten(spark.createDataFrame([("a", [1.0, 2.0], "w", 1)], schema)).collect()[0]
    assert (one.n, one.deviation, one.whitened, one.explained, one.identity_error) == (1, 0, [None, None], [None, None], 0.0)
    rows = [(None, [0.0, 5.0], "w", 1), ("b", [1.0, 5.0], "w", 1), ("b", [1.0, 5.0], "w", 1), ("c", [], "w", 1), ("d", [3.0], "w", 1), ("e", [-3.0], "w", 1), ("f", [3.4e38, -3.4e38, 1.0], "w", 1), ("g", [1.0, 2.0, 3.0], "w", 1)]
    out = whitening.whiten(spark.createDataFrame(rows, schema)).collect()
    by = collections.defaultdict(list)
    for r in out:
        by[r.vec_id].append(r)
    assert len(out) == 8 and by["b"][0].n == 3 and by["b"][0] == by["b"][1] and by["b"][0].deviation == 64 * 64
    assert by[None][0].whitened[1] is None and abs(by[None][0].whitened[0]) == pytest.approx(2**0.5) and by["b"][0].explained == [1.0, 0.0]
    assert by["c"][0].whitened == [] and by["d"][0].n == 2 and abs(by["d"][0].whitened[0]) == pytest.approx(1) and by["f"][0].deviation is None
    wide = spark.createDataFrame([(1, [0.0] * (whitening.MAX_LENGTH + 1))], "vec_id long, embedding array<double>")
    with pytest.raises(ValueError, match="covariance"):
        whitening.fit(wide)


def test_sums_of_squares_are_exact():
    rng = np.random.default_rng(4)
    for high in (10, 1 << 23, 1 << 40, 1 << 61):
        z = rng.integers(-high, high, size=(50, 3))
        assert list(whitening._sum_squares(z)) == [sum(int(c) ** 2 for c in col) for col in z.T] == list(whitening._sum_squares(z.astype(object)))


# Turn repair ----------------------------------------------------------------------

FOLLOWS = {0: 2, 1: 2, 2: 3, 3: 2}


def cheapest(symbols):
    """Cost and least audit, by whole strings from the right."""

    def inserted(base):
        now = dict(base)
        for _ in range(4):
            for q in range(4):
                if FOLLOWS[q] in now:
                    c, a = now[FOLLOWS[q]]
                    now[q] = min(now.get(q, (10**9, "")), (c + 3, "I" + a))
        return now

    behind = inserted({0: (0, ""), 3: (0, "")})
    for s in reversed(symbols):
        here = {}
        for q in range(4):
            ways = [("D", 4, q)]
            if s != "x":
                more = 3 if s.isupper() else 0
                ways.append(("R", more + 3, FOLLOWS[q]))
                to = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}.get((s.lower(), q))
                ways += [("K", more, to)] if to else []
            here[q] = min((c + behind[to][0], letter + behind[to][1]) for letter, c, to in ways)
        behind = inserted(here)
    return behind[0]


def repaired_plainly(turns):
    """Everything about one conversation's turns (turn, role, text)."""
    turns = sorted(((t, r if r is not None else " ", x if x is not None else " ") for t, r, x in turns), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    seen, symbols, faults = set(), [], collections.Counter()
    for _, role, text in turns:
        bare = "".join(c for c in text if c not in " \t\n\x0b\x0c\r")
        fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None
        seen.add((role, text))
        faults[fault] += 1
        known = role[:1] if role[:1] in ("s", "u", "a") else "o"
        symbols.append("x" if fault in ("blank", "duplicate") else known.upper() if fault else known)
    cost, audit = cheapest(symbols)
    rows, q, k = iter(turns), 0, []
    for letter in audit:
        _, role, text = (None, None, None) if letter == "I" else next(rows)
        new = "assistant" if q == 2 else "user"
        if letter == "D":
            continue
        k.append(f"{new if letter in 'IR' else role}:{text if letter != 'I' else ''}")
        q = 1 if letter == "K" and role[:1] == "s" else FOLLOWS[q]
    numbers = [t for t, _, _ in turns if t is not None]
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:], strict=False))
    gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    return gaps, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(k).encode()).hexdigest(), k


def talk(seed, conversations, longest):
    rng = random.Random(seed)
    roles = ["user", "assistant", "system", "tool", "", None, "user", "assistant"]
    texts = ["Yes.", "no", "Why?", "", " \n", None, "Because of é!  ", "a.b", "Go on!"]
    out = []
    for c in range(conversations):
        for k in range(rng.randint(1, longest)):
            text = rng.choice(texts) if rng.random() < 0.5 else f"Turn {rng.randrange(99)}{rng.choice(['.', '', '!'])}"
            out.append((c if c else None, rng.choice([k, k, k + 1, None, -k]), rng.choice(roles[: 2 if c % 2 else 8]), text))
    return out


@pytest.mark.parametrize("chunk", [4096, 3])
def test_repair_is_brute_force(spark, chunk):
    rows = talk(1, 60, 14) + [(1000, k, "user" if k % 2 else "assistant", f"Long {k % 150}.") for k in range(400)]
    df = spark.createDataFrame([(*r, "p", "c") for r in rows], "conv_id long, turn long, role string, text string, part string, conv string")
    fixed = turn_repair.Repair(df, Scratch(spark, "t"), chunk_rows=chunk)
    counts, audits, said = {r.conv: r for r in fixed.conversations().collect()}, {r.conv: r for r in fixed.audits().collect()}, collections.defaultdict(list)
    for r in sorted(fixed.repaired().collect(), key=lambda r: r.place):
        said[r.conv].append(f"{r.role}:{r.text}")
    for c in {r[0] for r in rows}:
        want = repaired_plainly([r[1:] for r in rows if r[0] == c])
        assert (*[counts[c][k] for k in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")], audits[c].audit, audits[c].repaired_sha256, said[c]) == want, c
    assert len(counts) == len(audits) == 61


def test_repair_of_nothing_and_of_one_repeated_turn(spark):
    schema = "conv_id string, turn int, role string, text string"
    empty = turn_repair.Repair(spark.createDataFrame([], schema), Scratch(spark, "t"))
    assert empty.conversations().count() == empty.repaired().count() == empty.audits().count() == 0
    same = turn_repair.Repair(spark.createDataFrame([("c", None, "user", "Hi." + "x" * 50_000 + ".")] * 40, schema), Scratch(spark, "t"), chunk_rows=7)
    row = same.conversations().collect()[0]
    assert (row.duplicate, row.cost, same.audits().collect()[0].audit) == (39, 39 * 4 + 3, "D" * 0 + "K" + "D" * 39 + "I")


def test_block_tables_are_every_path():
    t, rng = turn_repair.tables(), random.Random(3)
    for _ in range(500):
        symbols = "".join(rng.choice(turn_repair.SYMBOLS) for _ in range(rng.randint(0, 15)))
        codes = np.array([turn_repair.SYMBOLS.index(c) for c in symbols], dtype=int)
        v, cost, exits = turn_repair.summary(codes)
        turns = turn_repair.expand(codes, 0, turn_repair.START)
        end = turn_repair.tables_exit(codes[-1], *turns[-1]) if symbols else turn_repair.START
        assert (int(cost[0]) + t.vectors[v[0]][0], "".join(x for x, _ in turns) + "I" * turn_repair.closing(end)) == cheapest(symbols)
        assert exits[0][0] == end


def test_damage_keeps_every_conversation(spark, tmp_path):
    rows = [(k, t, r, x) for k, t, r, x in talk(2, 40, 6)] + [(k, 0, "user", "Alone.") for k in range(100, 160)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    out = {r.conv_id: r for r in queries.op12_turn_repair(spark, str(tmp_path)).collect()}
    assert set(out) == {r[0] for r in rows}
    import zlib

    for c in out:
        turns = []
        for _, t, role, text in (r for r in rows if r[0] == c):
            k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
            text = " " if text is None else text
            text = "" if k == 1 else "".join(x for x in text if x not in ".!?") if k == 2 else text
            turns += [(t, "user" if k == 4 else role, text)] * (0 if k == 0 else 2 if k == 3 else 1)
        r = out[c]
        assert (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) == repaired_plainly(turns)[:8], c
    assert any(r.audit == "" for r in out.values())


# Quality: ties and blocks ------------------------------------------------------------


def test_equally_near_neighbours_all_vote():
    copies = ["The same text, over and over; 12 times."] * 100
    model = quality_knn.fit([*copies, "Other words!", "$$$ 99"], [k % 2 for k in range(100)] + [1, 0])
    assert model.score([copies[0]])[0] == pytest.approx(0.5, abs=1e-9)
    model = quality_knn.fit([*copies, "Other words!"], [k < 25 for k in range(100)] + [1])
    assert model.score([copies[0]] * 3).tolist() == pytest.approx([0.25] * 3, abs=1e-9)


def test_a_score_does_not_depend_on_its_block(spark):
    rng = random.Random(8)
    say = lambda: " ".join(rng.choice(["Alpha", "beta", "12", "$$", "gamma,", "Delta!", "x.y"]) for _ in range(rng.randint(1, 60)))
    model = quality_knn.fit([say() for _ in range(300)], [rng.randrange(2) for _ in range(300)])
    texts = [say() for _ in range(200)]
    together = model.score(texts)
    assert [float(model.score([t])[0]) for t in texts] == together.tolist() == model.score(texts[::-1])[::-1].tolist()
    assert len(set(model.score([texts[0]] * 1500).tolist())) == 1
