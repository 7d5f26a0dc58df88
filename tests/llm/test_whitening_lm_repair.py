"""Whitening, language-model scoring and conversation repair against brute force on small fixtures."""

import functools
import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from bramble.llm import conversation_repair as CR
from bramble.llm import lm_scoring as LM
from bramble.llm import whitening as W

CONV = "conv_id long, turn long, role string, text string"


# --- whitening ------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("n", [1, 2, 3, 17, 64])
def test_leading_pairs(n):
    rng = np.random.default_rng(n)
    a = rng.standard_normal((n, n))
    for v in (a @ a.T, np.diag(np.arange(n, 0, -1.0)), np.ones((n, n)), np.eye(n), np.zeros((n, n))):
        e, x = W.leading_pairs(v, 16)
        want = np.linalg.eigvalsh(v)[::-1][:16]
        assert len(e) == (want > 1e-11 * max(want.max(), 1e-300)).sum() and np.allclose(e, want[: len(e)], rtol=1e-9, atol=1e-12)
        assert np.allclose(x.T @ x, np.eye(len(e)), atol=1e-10) and np.allclose(v @ x, x * e, atol=1e-9)


def test_sturm_count():
    rng = np.random.default_rng(0)
    d, e = rng.standard_normal(9), rng.standard_normal(8)
    values = np.linalg.eigvalsh(np.diag(d) + np.diag(e, 1) + np.diag(e, -1))
    at = np.linspace(-4, 4, 41)
    assert W.sturm_count(d, e, at).tolist() == [(values < x).sum() for x in at]


def whitened(spark, rows, **options):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3).select("*", F.lit(1).alias("d"), F.lit(1).alias("x"), F.lit(1).alias("n"))
    return W.whiten(df, **options)


def test_whitening(spark):
    rng = np.random.default_rng(5)
    base = rng.standard_normal((200, 20)) @ rng.standard_normal((20, 20))
    good = [(i, base[i].tolist()) for i in range(200)] + [(500 + i, base[7].tolist()) for i in range(30)] + [(7, base[9].tolist()), (None, base[1].tolist())]
    bad = [(900, None), (901, [None] + [0.0] * 19), (902, [math.nan] + [0.0] * 19), (903, [math.inf] * 20), (904, [])]
    got = whitened(spark, [(i, v, 0) for i, v in good + bad]).collect()
    x = {i: np.floor(64 * v).astype(np.int64) + 1_000_000 for i, v in enumerate(base)}
    fit = np.stack(list({tuple(v): v for v in x.values()}.values()))
    n, sums = len(fit), fit.sum(axis=0)
    c = fit - fit.mean(axis=0)
    values, vectors = np.linalg.eigh(c.T @ c / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    assert len(got) == len(good) * 16 and {r["n"] for r in got} == {n}
    by = {}
    for r in got:
        by.setdefault((r["vec_id"], r["component"]), []).append(r)
    for i, v in good:
        own = np.floor(64 * np.asarray(v)).astype(np.int64) + 1_000_000
        w = (own - fit.mean(axis=0)) @ vectors[:, :16] / np.sqrt(values[:16])
        for k in range(16):
            some = by[i, k + 1]
            assert any(r["deviation"] == int(((n * own - sums) ** 2).sum()) and abs(abs(r["whitened"]) - abs(w[k])) < 1e-7 for r in some)
            assert all(abs(r["explained"] - values[k] / values.sum()) < 1e-10 and r["identity_error"] < 1e-9 for r in some)


def test_whitening_edges(spark):
    assert whitened(spark, []).count() == 0
    same = whitened(spark, [(i, [1.0, 2.0], 0) for i in range(3)]).collect()
    assert [(r["component"], r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in same] == [(1, 1, 0, 0.0, 0.0, 0.0)] * 3
    two = whitened(spark, [(1, [1.0, 2.0], 0), (2, [3.0, 2.0], 0), (3, [1.0, 2.0, 3.0], 0), (4, [2.0, 2.0, 3.0], 0), (5, [1e300, 2.0, 3.0], 0)]).collect()
    assert {(r["vec_id"], r["n"]) for r in two} == {(1, 2), (2, 2), (3, 3), (4, 3), (5, 3)} and max(r["deviation"] for r in two) == (1 << 63) - 1


# --- language-model scoring -----------------------------------------------------------------------------------------


def tokens(t):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")) if w] + ["\0"]


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join(rng.choice(["The", "of", "größe", "in", "house", "a", "green", "x"]) for _ in range(n))


LM_ROWS = [(i, prose(i, 5 + i)) for i in range(120)] + [(200, None), (201, ""), (202, " \t\n "), (203, "\x0b Aa  bB\r\n"), (204, prose(9, 30_000)), (None, "nameless of"), (5, prose(5, 10)), (5, "other text"), (206, "你好   İ"), (207, "q" * 5000)]


def test_stream_and_words():
    texts = [t for _, t in LM_ROWS]
    data, sizes = LM.stream(pa.array(texts))
    want = [" ".join(tokens(t)[:-1]).encode() + b"\n" for t in texts]
    assert data.tobytes() == b"".join(want) and sizes.tolist() == [len(w) for w in want]
    words, n = LM.words_of(data, sizes)
    assert words.to_pylist() == [w for t in texts for w in tokens(t)[:-1]] and n.tolist() == [len(tokens(t)) - 1 for t in texts]


def test_contexts_see_their_own_text_only():
    alone = [LM.contexts(*LM.stream(pa.array([t]))) for _, t in LM_ROWS[:20]]
    data, sizes = LM.stream(pa.array([t for _, t in LM_ROWS[:20]]))
    for k, h in enumerate(LM.contexts(data, sizes)):
        assert h.tolist() == [x for one in alone for x in one[k].tolist()]
    h = dict(zip("abcdefgh", LM.contexts(*LM.stream(pa.array(["xy ab xy ab"])))[-1].tolist(), strict=False))
    assert len(h) == 8


def plain_bits(text, code, tables, weights):
    """One text alone, decision by decision."""
    data, sizes = LM.stream(pa.array([text], pa.string()))
    hashes, cost, moved = LM.contexts(data, sizes), 0.0, np.zeros(LM.CONTEXTS)
    symbols = code.symbols(data)
    for lo in range(0, len(data), LM.REFINE):
        grad, many = np.zeros(LM.CONTEXTS), 0
        for i in range(lo, min(lo + LM.REFINE, len(data))):
            for j in range(code.length[symbols[i]]):
                at = code.start[symbols[i]] + j
                state = [int(tables[k][LM.slots(hashes[k][i : i + 1], np.array([1]), code.node[at : at + 1], 10)][0]) for k in range(LM.CONTEXTS)]
                x = LM.ODDS[state].astype(float)
                z = float((weights[(state[-1] >> 6) * 4 + (state[-2] >> 6)] + moved) @ x)
                p = 1 / (1 + math.exp(-z))
                cost -= math.log2(p if code.bit[at] else 1 - p)
                grad += (float(code.bit[at]) - p) * x
                many += 1
        moved += LM.STEP * grad / math.sqrt(many)
    return cost


def test_bits_equal_plain_loop():
    rng = np.random.default_rng(2)
    code = LM.Code(np.bincount(LM.stream(pa.array([t for _, t in LM_ROWS]))[0], minlength=256))
    assert sum(2.0 ** -code.length) == 1 and all(code.bit[s : s + n].size == n for s, n in zip(code.start, code.length, strict=True))
    tables = [LM.BRIEF[LM.states(rng.integers(0, 40, 2 << 10))] for _ in range(LM.CONTEXTS)]
    weights = rng.random((LM.GATES, LM.CONTEXTS)).astype(np.float32)
    texts = [LM_ROWS[i][1] for i in (0, 3, 60, 119, 120, 121, 127)]
    got = LM.bits_of(*LM.stream(pa.array(texts)), code, tables, weights)
    assert np.allclose(got, [plain_bits(t, code, tables, weights) for t in texts], rtol=1e-4)


def test_bits_with_a_tree_after_each_byte():
    data, sizes = LM.stream(pa.array([t for _, t in LM_ROWS]))
    seen = Counter()
    for end, n in zip(np.cumsum(sizes), sizes, strict=True):
        seen.update(zip([LM.END, *data[end - n : end - 1].tolist()], data[end - n : end].tolist(), strict=True))
    counts = np.bincount(LM.pairs(data), minlength=1 << 16)
    assert {(int(i) >> 8, int(i) & 255): int(counts[i]) for i in np.flatnonzero(counts)} == seen
    code = LM.Code(counts)
    assert np.allclose((2.0 ** -code.length.reshape(256, 256)).sum(axis=1), 1)
    one = LM.Code(counts.reshape(256, 256).sum(axis=0))
    assert code.length[LM.pairs(data)].sum() < one.length[data].sum()
    rng = np.random.default_rng(3)
    tables = [LM.BRIEF[LM.states(rng.integers(0, 40, 2 << 10))] for _ in range(LM.CONTEXTS)]
    weights = rng.random((LM.GATES, LM.CONTEXTS)).astype(np.float32)
    texts = [LM_ROWS[i][1] for i in (0, 3, 60, 119, 120, 121, 127)] + [LM_ROWS[-1][1][:700]]
    got = LM.bits_of(*LM.stream(pa.array(texts)), code, tables, weights)
    assert np.allclose(got, [plain_bits(t, code, tables, weights) for t in texts], rtol=1e-4)


def test_slots_are_counted_once_for_each_decision(spark):
    """The states of a small model equal those of counting decision by decision, whatever the cutting into slices."""
    texts = [t for _, t in LM_ROWS if t is not None and len(t) < 9000]
    data, sizes = LM.stream(pa.array(texts))
    code = LM.Code(np.bincount(LM.pairs(data), minlength=1 << 16))
    want = np.zeros((LM.CONTEXTS, 2 << 8), dtype=np.int64)
    for k, h in enumerate(LM.contexts(data, sizes)):
        for x, symbol in zip(h, LM.pairs(data), strict=True):
            for at in range(code.start[symbol], code.start[symbol] + code.length[symbol]):
                want[k, 2 * int(LM.slots(np.array([x]), np.array([1]), code.node[at : at + 1], 8)[0]) + int(code.bit[at])] += 1
    got = LM._tables(spark.createDataFrame([(t,) for t in texts], "text string").repartition(3), code, 8)
    assert all((g == LM.states(w)).all() for g, w in zip(got, want, strict=True))


def test_lm_scoring(spark):
    docs = spark.createDataFrame(LM_ROWS, "doc_id long, text string").repartition(4).select("*", F.lit(1).alias("row"), F.lit("x").alias("word"), F.lit(2).alias("n"), F.lit(3).alias("held_out"))
    got = LM.score(docs, bits=12).collect()
    seen = Counter()
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    for i, t in LM_ROWS:
        if not held(i):
            seen.update(tokens(t))
    total, distinct = sum(seen.values()), len(seen)
    want = sorted((-1 if i is None else i, held(i), len(tokens(t)), sum(seen[w] > 0 for w in tokens(t)), total, round(sum(math.log10((seen[w] + 1) / (total + distinct + 1)) for w in tokens(t)), 6)) for i, t in LM_ROWS)
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == want
    assert all(r["score"] < 0 for r in got)
    # all words of a text cost at least what their own entropy asks for, and less than uniform bytes
    mixed = {r["doc_id"]: r for r in got}
    assert 0.2 < mixed[204]["bits_per_byte"] < 1.5
    again = {(r["doc_id"], r["n_tokens"]): r["score"] for r in LM.score(docs.repartition(2), bits=12).collect()}
    assert all(abs(again[r["doc_id"], r["n_tokens"]] - r["score"]) < 1e-3 * abs(r["score"]) for r in got)


def test_lm_weights_from_all_training_bytes(spark, monkeypatch):
    """F13 (round 4): the weights that texts start with are fitted on every decision of every training text, not on parts of
    some of them; counts by cell are those of a plain loop."""
    rng = np.random.default_rng(4)
    texts = [" ".join(rng.choice(["alpha", "beta", "gamma", "no", "\u00e9t\u00e9"], size=int(n))) for n in (900, 3, 0, 400, 77)] * 2
    data, sizes = LM.stream(pa.array(texts))
    code = LM.Code(np.bincount(LM.pairs(data), minlength=1 << 16))
    train = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    tables = LM._tables(train, code, 8)
    asked, fit = [], LM.fit_weights
    monkeypatch.setattr(LM, "fit_weights", lambda cell, n: asked.append((cell, n)) or fit(cell, n))
    weights = LM._starting_weights(train, code, tables)
    node, bit, place, _ = code.decisions(code.symbols(data))
    want = Counter()
    hashes = LM.contexts(data, sizes)
    for i in range(len(bit)):
        state = [int(tables[k][int(hashes[k][place[i]] >> 24) ^ int(node[i])]) for k in range(LM.CONTEXTS)]
        odds = [float(LM.ODDS_WITHOUT[bit[i], s]) * (1 if bit[i] else -1) for s in state]
        level = [int(np.abs(LM.CENTRES - o).argmin()) for o in odds]
        gate = int(LM.KNOWN_WITHOUT[state[-1]]) * 4 + int(LM.KNOWN_WITHOUT[state[-2]])
        want[gate * LM.SIDES**LM.CONTEXTS + sum(x * LM.SIDES**k for k, x in enumerate(level))] += 1
    (cell, n), *_ = asked
    assert int(n.sum()) == len(bit) and dict(zip(cell.tolist(), n.tolist(), strict=True)) == want
    again = LM._starting_weights(train.repartition(2), code, tables)
    assert weights.shape == (LM.GATES, LM.CONTEXTS) and (weights == again).all()


def test_lm_scoring_rare_words_and_no_training(spark, monkeypatch):
    monkeypatch.setattr(LM, "FREQUENT", 2)
    docs = spark.createDataFrame(LM_ROWS, "doc_id long, text string")
    one = sorted((r["doc_id"] or -1, r["n_known"], round(r["base_score"], 6)) for r in LM.score(docs, bits=8).collect())
    monkeypatch.undo()
    assert one == sorted((r["doc_id"] or -1, r["n_known"], round(r["base_score"], 6)) for r in LM.score(docs, bits=8).collect())
    out = next(i for i in range(1000) if zlib.crc32(str(i).encode()) % 7 == 2)
    (r,) = LM.score(spark.createDataFrame([(out, "a b")], "doc_id long, text string"), bits=8).collect()
    assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) == (3, 0, 0, 0.0) and r["score"] < 0
    assert LM.score(docs.limit(0), bits=8).count() == 0


def test_model_is_a_distribution():
    """Over all texts of a few bytes the probabilities add up to at most 1, and nearly 1 with longer ones."""
    rng = np.random.default_rng(4)
    code = LM.Code(np.bincount(np.frombuffer(b"ab\nab \n" * 9, dtype=np.uint8), minlength=256))
    tables, weights = [LM.BRIEF[LM.states(rng.integers(0, 9, 2 << 10))] for _ in range(LM.CONTEXTS)], np.full((LM.GATES, LM.CONTEXTS), 0.3, dtype=np.float32)
    texts = [" ".join(w) for n in range(4) for w in itertools.product(["a", "b", "ab"], repeat=n)]
    total = (2.0 ** -LM.bits_of(*LM.stream(pa.array(texts)), code, tables, weights)).sum()
    assert 0 < total <= 1


# --- conversation repair --------------------------------------------------------------------------------------------


def legal(initials):
    return re.fullmatch(r"(s?(ua)+)?", initials) is not None


def brute(kinds):
    """The cheapest edits with the least audit, over all edits of the rows and up to n + 2 insertions in each gap."""
    options = []
    for k in kinds:
        own = [(2, "D", "")]
        if k != "D":
            extra = 5 * k.isupper()
            own += [(extra, "K", k.lower()), (1 + extra, "R", "u"), (1 + extra, "R", "a")]
        options.append(own)
    gap = [(0, "", ""), (5, "I", "u"), (5, "I", "a"), (10, "II", "ua"), (10, "II", "au")]
    best = None
    for edits in itertools.product(*options):
        for gaps in itertools.product(gap, repeat=len(kinds) + 1):
            cost = sum(e[0] for e in edits) + sum(g[0] for g in gaps)
            if best and cost > best[0]:
                continue
            order = [x for pair in zip(gaps, edits, strict=False) for x in pair] + [gaps[-1]]
            if legal("".join(x[2] for x in order)):
                best = min(best or (99, ""), (cost, "".join(x[1] for x in order)))
    return best


def test_parse_equals_brute_force():
    for n in range(4):
        for kinds in itertools.product("suaoDUAS", repeat=n):
            if n < 3 or hash(kinds) % 5 == 0:
                assert CR.cheapest(CR.parse("".join(kinds))) == brute(kinds)


def table_parse(kinds):
    """Every span of every length with every split point."""
    n = len(kinds)
    cells = {(i, i + 1): CR.terminal(k) for i, k in enumerate(kinds)}
    for size in range(2, n + 1):
        for i in range(n - size + 1):
            some = [CR.combine(cells[i, k], cells[k, i + size]) for k in range(i + 1, i + size)]
            assert all(c == some[0] for c in some)
            cells[i, i + size] = some[0]
    return cells[0, n]


def test_all_splits_agree():
    rng = random.Random(3)
    for _ in range(20):
        kinds = "".join(rng.choice("suaouaUADuaS") for _ in range(rng.randint(1, 24)))
        assert CR.parse(kinds) == table_parse(kinds)
    long = "".join(rng.choice("suaouaUAD") for _ in range(3000))
    assert CR.combine(CR.parse(long[:1234]), CR.parse(long[1234:])) == CR.parse(long)


def plain_repair(rows):
    out, groups = {}, {}
    for conv, turn, role, text in rows:
        out.setdefault(conv, None)
        n = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if n:
            new = (turn, "user" if n == 4 else role, "" if n == 1 else re.sub("[.!?]", "", text) if n == 2 else text)
            groups.setdefault(conv, []).extend([new] * (2 if n == 3 else 1))
    for conv in out:
        own = sorted(groups.get(conv, []), key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest()))
        kinds, seen, faults = "", set(), Counter()
        for _, role, text in own:
            solid = re.sub(r"[\x20\x09-\x0D]", "", text)
            fault = "blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else ""
            seen.add((role, text))
            faults[fault] += 1
            kind = role[:1] if role[:1] in ("s", "u", "a") else "o"
            kinds += "D" if fault in ("blank", "duplicate") else kind.upper() if fault else kind
        cell = table_parse(kinds) if 0 < len(kinds) < 40 else functools.reduce(CR.combine, map(CR.terminal, kinds), CR.insertions())
        cost, audit = CR.cheapest(cell)
        told, left, state = [], iter(own), ""
        for edit in audit:
            row = next(left) if edit != "I" else None
            if edit == "K":
                told.append(f"{row[1]}:{row[2]}")
                state += row[1][:1]
            elif edit != "D":
                name = "assistant" if state[-1:] == "u" else "user"
                told.append(f"{name}:{row[2] if row else ''}")
                state += name[0]
        assert legal(state)
        turns = [r[0] for r in own if r[0] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(own))
        yield conv, gaps, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(told).encode()).hexdigest()


def test_conversation_repair(spark):
    rng = random.Random(8)
    rows = []
    for conv in range(60):
        for turn in range(rng.randint(1, 9)):
            rows.append((conv, turn * rng.choice([1, 1, 1, 3]), rng.choice(["user", "assistant", "user", "assistant", "system", "tool", ""]), rng.choice(["Hi.", "Well?", "no end", " ", "", "Word ", "End. \n", f"t{turn}!"])))
    rows += [(None, 1, "user", "Who."), (None, None, None, None), (70, None, "user", None), (70, None, "user", "a."), (70, -5, "assistant", "b."), (71, 1, None, "x."), (72, (1 << 62), "user", "x" * 100_000 + "."), (73, 3, "user", "Same."), (73, 3, "user", "Same."), (73, 3, "user", "Other.")]
    rows += [(99, t, ["user", "assistant"][t % 2] if t % 7 else "user", f"line {t % 40}.") for t in range(400)]
    df = spark.createDataFrame(rows, CONV).repartition(5).select("*", F.lit("k").alias("key"), F.lit(1).alias("kind"), F.lit(1).alias("n"), F.lit(1).alias("copies"))
    got = sorted((tuple(r) for r in CR.repair(df).collect()), key=repr)
    assert got == sorted(plain_repair(rows), key=repr)
    assert CR.repair(df.limit(0)).count() == 0
