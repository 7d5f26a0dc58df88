"""The training-data operators against brute force on small fixtures, with the edge cases that each must survive."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from bramble.llm import best_fit, embedding_join, exact_dedup, html_extract, jaccard_join, language_id, mixing, shingles, token_counts, token_files, toxicity, word_ids
from bramble.llm.common import components, new_path

tokenizers = pytest.importorskip("public_tokenizers")
WORD, PIECE = tokenizers.path("word_bpe_49k.json"), tokenizers.path("piece_bpe_32k.model")
DOC = "doc_id long, text string, lang string, source string, n_chars long"


def words(n, seed):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    """Nulls everywhere, empty and very long texts, ties, repeated rows."""
    base = words(60, 1)
    out = [(1, base), (2, base), (3, base.replace(" ", "\n", 3)), (4, None), (5, ""), (6, " \t"), (7, "a"), (8, "a b"), (9, words(9000, 2)), (None, "no id here"), (10, "dup row"), (10, "dup row")]
    out += [(20 + i, base + f" extra{i}") for i in range(6)] + [(40 + i, words(30, 40 + i)) for i in range(6)] + [(60, "héllo Straße, NAÏVE's 123 <|endoftext|> <s> 你好"), (61, base.upper())]
    return [(i, t, ("en" if (i or 0) % 2 else None), (None if (i or 0) % 5 == 0 else f"s{(i or 0) % 3}"), None if t is None else len(t)) for i, t in out]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOC).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOC)


@pytest.fixture(scope="module")
def clashing(docs):
    """Names that the operators use inside, as other columns of the input."""
    return docs.select("*", *[F.lit(1).alias(c) for c in ("len", "pfx", "norm", "word", "bits", "shard", "size", "start", "block", "held_out", "id", "label", "component", "keep_id")])


def norm(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


def test_exact_dedup(docs, none, clashing, rows):
    want = {}
    for i, t, *_ in rows:
        same = [j for j, u, *_ in rows if norm(u) == norm(t)]
        keep = min((j for j in same if j is not None), default=None)
        want.setdefault((i, keep, len(same), i == keep, hashlib.sha256(norm(t).encode()).hexdigest()), 0)
        want[(i, keep, len(same), i == keep, hashlib.sha256(norm(t).encode()).hexdigest())] += 1
    for table in (docs, clashing):
        got = {}
        for r in exact_dedup.exact_dedup(table, digest=True).collect():
            got[tuple(r)] = got.get(tuple(r), 0) + 1
        assert got == want
    assert exact_dedup.exact_dedup(none).count() == 0
    kept = [r["doc_id"] for r in exact_dedup.keep_first(docs).collect()]
    assert kept.count(10) == 1 and 1 in kept and not {2, 3} & set(kept) and None in kept


def test_keep_first_loses_no_text(spark, docs, clashing, none, rows, monkeypatch):
    monkeypatch.setattr(exact_dedup, "LARGE_ROWS", 2)
    texts = [(1, "x"), (2, "x"), (2, "unique"), (2, " unique"), (3, None), (4, ""), (None, "x"), (None, "nameless"), (None, "nameless"), (5, "long " * 50_000), (5, "long " * 50_000)]
    for n in (1, 3):
        got = exact_dedup.keep_first(spark.createDataFrame(texts, "doc_id long, text string").repartition(n)).collect()
        assert sorted((-1 if r["doc_id"] is None else r["doc_id"], norm(r["text"])) for r in got) == [(-1, "nameless"), (1, "x"), (2, " unique"), (2, "unique"), (3, ""), (5, "long " * 50_000)]
    for table in (docs, clashing):
        kept = exact_dedup.keep_first(table)
        assert kept.columns == table.columns and sorted(norm(r["text"]) for r in kept.collect()) == sorted({norm(t) for _, t, *_ in rows})
    assert exact_dedup.keep_first(none).count() == 0


def test_keep_one_loses_no_text(spark, none):
    base = words(60, 1)
    texts = [(1, base), (2, base + " tail"), (2, words(40, 2)), (None, words(30, 3)), (None, base + " end"), (None, None), (3, ""), (3, ""), (4, words(30, 3)), (5, words(20, 5))]
    got = jaccard_join.keep_one(spark.createDataFrame([(i, t, "c") for i, t in texts], "doc_id long, text string, cluster string").repartition(3)).collect()
    assert sorted((r["doc_id"] or -1, r["text"] or "") for r in got) == sorted([(1, base), (2, words(40, 2)), (-1, ""), (3, ""), (3, ""), (4, words(30, 3)), (5, words(20, 5))])
    unique = [(i, t) for i, t in texts if i not in (None, 3)][:2] + [(9, words(30, 9))]
    assert sorted(r["doc_id"] for r in jaccard_join.keep_one(spark.createDataFrame(unique, "doc_id long, text string")).collect()) == [1, 9]


def test_exact_dedup_plan_is_native(docs):
    plan = exact_dedup.exact_dedup(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_word_ids_equal_library(rows):
    import pyarrow as pa
    from tokenizers import Tokenizer

    tok, rng = Tokenizer.from_file(WORD), random.Random(3)
    alphabet = [*"abcXYZé ßñ\n\t\r\x0b\x1c\x85\xa0  12sd.,'#<|>ΣςİǅＡ́ 　你😀²¼ª", "<|endoftext|>", "'ll"]
    texts = [t for _, t, *_ in rows] + ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(1500)]
    n, ids = word_ids.encode_texts(WORD, pa.array(texts))
    want = [e.ids for e in tok.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert n.tolist() == [len(x) for x in want] and ids.tolist() == [i for x in want for i in x]


def test_token_counts(docs, none, rows):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    want = sorted(((i if i is not None else -1), len((t or "").encode()), len(model.encode(t or ""))) for i, t, *_ in rows)
    assert sorted((r[0] if r[0] is not None else -1, r[1], r[2]) for r in token_counts.token_counts(docs, PIECE).collect()) == want
    assert token_counts.token_counts(none, PIECE).count() == 0


def ids_of(rows, end):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(WORD)
    return [(i, t or "", tok.encode(t or "", add_special_tokens=False).ids + [end]) for i, t, *_ in rows]


def crc(ids):
    return zlib.crc32(np.asarray(ids, "<u4").tobytes())


def test_runs_of_reads():
    runs = list(token_files._runs(np.array([0, 0, 0, 0, 1]), np.array([0, 5, 5, 40_000, 3]), np.array([5, 2, 2, 1 << 21, 0])))
    assert runs == [(0, 0, 7, [(0, 5), (5, 2), (5, 2)]), (0, 40_000, 40_000 + (1 << 21), [(40_000, 1 << 21)]), (1, 3, 3, [(3, 0)])]


def test_token_files_round_trip(spark, docs, none, rows):
    order = sorted(ids_of(rows, 2), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    want, at = [], 0
    for i, _, ids in order:
        want.append((i, at, len(ids), crc(ids)))
        at += len(ids)
    folder = new_path(spark, "t")
    token_files.write_token_files(docs, folder, WORD, 2, keys_per_bucket=8)
    assert [tuple(r) for r in token_files.read_digests(spark, folder, docs).orderBy("start").collect()] == want
    one = token_files.read_token_files(spark, folder, spark.createDataFrame([(7,), (999,)], "doc_id long")).collect()
    assert len(one) == 1 and one[0]["ids"] == next(ids for i, _, ids in order if i == 7)
    empty = new_path(spark, "t")
    token_files.write_token_files(none, empty, WORD, 2)
    assert token_files.read_digests(spark, empty, none).count() == 0


def test_perfect_hash_is_minimal():
    keys = np.unique(np.random.default_rng(1).integers(-(2**62), 2**62, 20_000))
    levels = token_files.build_hash(keys)
    assert sorted(token_files.hash_slots(levels, keys).tolist()) == list(range(len(keys)))


def test_best_fit_packing(docs, none, rows):
    cap = 512
    want = {}
    for i, _, ids in ids_of(rows, 1):
        for p in range(0, len(ids), cap):
            key = (i, p // cap, p, len(ids[p : p + cap]), crc(ids[p : p + cap]))
            want[key] = want.get(key, 0) + 1
    out = best_fit.pack_documents(docs, WORD, capacity=cap).collect()
    got = {}
    for r in out:
        key = (r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"])
        got[key] = got.get(key, 0) + 1
    assert got == want
    bins = {}
    for r in sorted(out, key=lambda r: r["offset"]):
        assert r["offset"] == bins.get(r["sequence_id"], 0)
        bins[r["sequence_id"]] = r["offset"] + r["length"]
    total = sum(len(ids) for _, _, ids in ids_of(rows, 1))
    assert max(bins.values()) <= cap and len(bins) <= -(-total // cap) + 1
    assert best_fit.pack_documents(none, WORD).count() == 0


def test_best_fit_is_best_fit():
    rng = np.random.default_rng(2)
    sizes = rng.integers(1, 60, 300)
    bins = best_fit.best_fit(sizes, 100)
    free: dict[int, int] = {}
    for i in np.argsort(-sizes, kind="stable"):
        fits = [b for b, f in free.items() if f >= sizes[i]]
        assert (bins[i] in free) == bool(fits)
        if fits:
            assert free[bins[i]] == min(free[b] for b in fits)
        free[bins[i]] = free.get(bins[i], 100) - sizes[i]
    assert min(free.values()) >= 0


def test_mixing(docs, none, rows):
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    out = mixing.taken_words(docs, block_words=4).collect()
    assert sorted((r["doc_id"] or -1, r["size"]) for r in out) == sorted((i or -1, size(t)) for i, t, *_ in rows)
    per: dict = {}
    source = {i: s for i, _, _, s, _ in rows}
    for r in out:
        assert 0 <= r["taken"] <= 3 * r["size"]
        x = per.setdefault(source[r["doc_id"]], [0, 0, r["target"], r["source_size"]])
        x[0] += r["size"]
        x[1] += r["taken"]
    assert all(x[0] == x[3] and abs(x[1] - x[2]) <= 8 for x in per.values())
    again = mixing.taken_words(docs.repartition(5), block_words=4).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, out))
    assert mixing.taken_words(none).count() == 0


def test_mixing_targets_and_permutations():
    t = mixing.targets({"a": 100, "b": 10, "c": 1000, None: 0})
    assert t["b"] == 30 and t[None] == 0 and t["a"] == 300 and sum(t.values()) == pytest.approx(1110)
    for n in (1, 2, 3, 17, 64, 1000):
        out = mixing.permuted(np.arange(n), np.full(n, n), np.full(n, 99, dtype=np.uint64))
        assert sorted(out.tolist()) == list(range(n))
    quotas = np.asarray([1000, 3, 0, 77])
    drawn = mixing.draw_shards(quotas, 100, 5)
    assert (sum(drawn) == quotas).all() and all(d.sum() == 100 for d in drawn[:-1])


def test_mixed_documents(docs, none, rows):
    got = mixing.mixed_documents(docs, block_words=4)
    text = {i: t for i, t, *_ in rows}
    for r in got.collect():
        assert r["n_chars"] == len(r["text"])
        assert all(run in text[r["doc_id"]] for run in r["text"].split("\n")) or r["doc_id"] == 3
    assert got.columns == docs.columns and mixing.mixed_documents(none).count() == 0


def test_mixed_documents_of_equal_ids(spark):
    # one source: its words are all taken once
    texts = [(None, "a1 a2 a3"), (None, " ".join(f"b{i}" for i in range(30))), (None, None), (7, "c1"), (7, " ".join(f"d{i}" for i in range(25))), (7, None), (8, "e1 e2"), (8, "e1 e2")]
    df = spark.createDataFrame([(i, t, None, "s", None) for i, t in texts], DOC)
    mixed = [mixing.mixed_documents(df.repartition(n), block_words=4).collect() for n in (1, 3)]
    for got in mixed:
        assert sorted((r["doc_id"] or -1, w) for r in got for w in r["text"].split()) == sorted((i or -1, w) for i, t in texts for w in (t or "").split())
    assert sorted(map(repr, mixed[0])) == sorted(map(repr, mixed[1]))


def parsed(auto, texts):
    symbols = np.asarray([c for t in texts for c in t], dtype=np.uint16)
    by_place, length, before, text = language_id.lanes(symbols, np.asarray([len(t) for t in texts], dtype=np.int64))
    return np.bincount(text, weights=language_id.phrases(auto, by_place, length, before), minlength=len(texts)).tolist()


def longest_matches(sample, s):
    """Phrases of s by brute force: each the longest piece that occurs in the sample."""
    n, at = 0, 0
    while at < len(s):
        k = 1
        while at + k <= len(s) and s[at : at + k] in sample:
            k += 1
        at, n = at + max(1, k - 1), n + 1
    return n


def test_suffix_automaton_parse():
    auto = language_id.Automaton([ord(c) - 95 for c in "abracadabra"], 64)
    texts = ["abra", "cadabrac", "zzz", "abracadabraabra", "r", ""]
    assert parsed(auto, [[min(ord(c) - 95, 60) for c in s] for s in texts]) == [longest_matches("abracadabra", s) for s in texts]


@pytest.mark.parametrize("block", [3, 16, 512])
def test_texts_are_parsed_as_one_string(block, monkeypatch):
    monkeypatch.setattr(language_id, "BLOCK", block)
    rng = random.Random(9)
    for letters in (2, 5, 400):
        sample = "".join(chr(0x4E00 + rng.randrange(letters)) for _ in range(600))
        auto = language_id.Automaton([ord(c) - 0x4E00 + 2 for c in sample], letters + 3)
        texts = ["".join(chr(0x4E00 + rng.randrange(letters + 1)) for _ in range(rng.choice([0, 1, block, block + 1, 700]))) for _ in range(20)]
        # pieces of the sample itself: phrases that run over many lanes
        texts += [sample[100:500] + sample[:300], sample * 2]
        assert parsed(auto, [[min(ord(c) - 0x4E00 + 2, letters + 2) for c in t] for t in texts]) == [longest_matches(sample, t) for t in texts]


def test_one_long_text_and_many_languages():
    rng = random.Random(10)
    sample = "".join(rng.choice("abcdefgh ") for _ in range(3_000))
    auto = language_id.Automaton([ord(c) - 30 for c in sample], 100)
    text = "".join(sample[(at := rng.randrange(2_900)) : at + rng.randint(1, 40)] for _ in range(5_000))[:100_000]
    state, count = np.zeros(1, dtype=np.int32), 0
    for c in text:
        state, on = auto.step(state, np.asarray([ord(c) - 30]))
        count += int(not on[0])
    assert parsed(auto, [[ord(c) - 30 for c in text]]) == [count]
    assert count == longest_matches(sample, text)
    # what an automaton stores follows its sample, not the number of letters
    wide = language_id.Automaton([rng.randrange(2, 20_000) for _ in range(3_000)], 20_002)
    assert len(wide.check) < 20 * 3_000 + 3 * 20_002


def test_language_id(spark, none, docs):
    rng = random.Random(5)
    kinds = {"xx": "sha tion the and ing er".split(), "yy": "eau que les oir ment é".split(), "zz": "ung sch keit ein ü der".split()}
    make = lambda l: " ".join("".join(rng.choice(kinds[l]) for _ in range(rng.randint(1, 3))) for _ in range(40))
    rows = [(i, make(l), l) for i, l in enumerate([*kinds] * 60)] + [(900, None, "xx"), (901, "12 !?", "yy"), (902, make("zz"), None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in language_id.identify(df, sample_chars=3000).collect()}
    held = [i for i, _, l in rows if got[i]["held_out"] and i < 900]
    assert held and all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i in got)
    assert np.mean([got[i]["lang_pred"] == rows[i][2] for i in held]) > 0.95
    assert got[900]["lang_pred"] == got[901]["lang_pred"] == "und" and got[902]["lang_pred"] == "zz"
    assert language_id.identify(none).count() == 0 and language_id.identify(docs).count() == docs.count()


def test_language_id_of_many_letters(spark):
    # scripts of more letters than an alphabet holds, and labelled texts longer than the sample
    rng = random.Random(6)
    script = {"aa": [chr(0x4E00 + i) for i in range(900)], "bb": [chr(0xAC00 + i) for i in range(900)], "cc": [chr(0x4E00 + 450 + i) for i in range(900)]}
    odds = [1 / (i + 5) for i in range(900)]
    rows = [(i, "".join(rng.choices(script[l], odds, k=9_000 if i < 9 else 120)), l) for i, l in enumerate([*script] * 50)]
    got = {r["doc_id"]: r["lang_pred"] for r in language_id.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert np.mean([got[i] == l for i, _, l in rows if zlib.crc32(str(i).encode()) % 3 == 1]) > 0.9


def edits(a, b):
    d = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        d, old = [i], d
        for j, y in enumerate(b, 1):
            d.append(min(old[j] + 1, d[-1] + 1, old[j - 1] + (x != y)))
    return d[-1]


def test_levenshtein_automaton_equals_brute_force():
    rng, terms = random.Random(7), ["idiot", "worthless", "disgusting", "scum", "stupid", "unpleasantly"]
    lexicon = toxicity.FuzzyLexicon(terms, most_states=500)
    for _ in range(1500):
        w = list(rng.choice(terms))
        for _ in range(rng.randint(0, 3)):
            at = rng.randrange(len(w) + 1)
            w[at : at + rng.randint(0, 1)] = rng.choice(["", "x", "s", "i"])
        w = "".join(w)
        want = {(i, edits(w, t)) for i, t in enumerate(terms) if edits(w, t) <= toxicity.edits_for(t)}
        assert set(lexicon.match(w)) == want, w


def test_two_edits_in_long_terms():
    rng, terms = random.Random(8), ["idiot", "worthless", "disgusting", "scum", "unpleasantly", "unpleasant"]
    allowed, lexicon = {"scum": 0, "idiot": 1, "worthless": 1, "disgusting": 2, "unpleasantly": 2, "unpleasant": 2}, toxicity.FuzzyLexicon(terms)
    for _ in range(1500):
        w = list(rng.choice(terms))
        for _ in range(rng.randint(0, 3)):
            at = rng.randrange(len(w) + 1)
            w[at : at + rng.randint(0, 2)] = rng.choice(["", "x", "s", "ti"])
        w = "".join(w)
        assert set(lexicon.match(w)) == {(i, edits(w, t)) for i, t in enumerate(terms) if edits(w, t) <= allowed[t]}, w
    scorer = toxicity.Scorer({"disgusting": 2.0, "worthless": 2.0}, set())
    assert scorer.evidence(["disgusting", "disgustin", "disgsuting", "disgxxting", "dixgxxting", "worhtless"]) == pytest.approx([2.0, 1.4, 0.8, 0.8, 0, 0])


def test_toxicity_features_equal_brute_force():
    rng, lexicon = random.Random(11), {"disgusting": 2.0, "worthless": 3.0, "idiot": 1.5, "scum": 2.5}
    terms, clean = list(lexicon), {"idiom"}
    vocabulary = ["idiom", "idiots", "the", "a", "scums", "skum", "disgust", "worth", "less", "Café", "\U0001d4b3\U0001d4b3\U0001d4b3\U0001d4b3\U0001d4b3", "1diot"]

    def word():
        w = list(rng.choice(terms if rng.random() < 0.3 else vocabulary))
        for _ in range(rng.choice([0, 0, 1, 2, 3])):
            at = rng.randrange(len(w) + 1)
            w[at : at + rng.randint(0, 1)] = rng.choice(["", "x", "é", "s"])
        return rng.choice(["", '"', "("]) + "".join(w) + rng.choice(["", ".", '"', ",", "-" + rng.choice(terms)])

    def evidence(token):
        best = 0.0
        for w in toxicity._word.findall(token):
            for t in terms:
                d = edits(w, t)
                if d == 0 or (w not in lexicon and w not in clean and d <= toxicity.edits_for(t)):
                    best = max(best, lexicon[t] * toxicity.EDIT_FACTOR[d])
        return best

    texts = [None, "", " \n", *(" ".join(word() for _ in range(rng.randint(1, 40))) for _ in range(150)), "idiot " * 3000]
    scorer, want = toxicity.Scorer(lexicon, clean), []
    for text in texts:
        tokens = (text or "").lower().split()
        found = [(evidence(t), i) for i, t in enumerate(tokens)]
        found = [e * (toxicity.QUOTED if scorer.quoted(tokens[max(0, i - toxicity.WINDOW) : i + toxicity.WINDOW + 1], min(i, toxicity.WINDOW)) else 1) for e, i in found if e]
        want.append([sum(found), max(found, default=0), sum(found) / max(1, len(tokens))])
    for _ in range(2):
        assert scorer.features(pa.array(texts, pa.string())) == pytest.approx(np.log1p(np.asarray(want)))


def test_copies_teach_once(spark):
    text = words(60, 77) + " blorptastic"
    rows = [(i, words(40, i)) for i in range(200)] + [(1000 + i, text) for i in range(60)]
    labels = [(i, int(i % 10 == 0)) for i in range(200)] + [(1000 + i, 1) for i in range(60)]
    lexicon, *_ = toxicity.learn(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert lexicon == {}


def test_toxicity(spark, none, docs):
    rng = random.Random(9)
    rows, labels = [], []
    for i in range(600):
        w = words(30, i).split()
        bad = i % 5 == 0
        if bad:
            w[rng.randrange(30)] = rng.choice(["zwkrump", "vuxolent"])
        rows.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    rows += [(1000, words(20, 1) + " zwkrmp " + words(9, 2)), (1001, None), (1002, ""), (1003, words(10, 3) + ' he said "zwkrump" ' + words(10, 4)), (1004, words(20, 5) + " zwkrump " + words(5, 6))]
    df, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in toxicity.toxicity(df, lab).collect()}
    assert all(got[i]["predicted"] == l for i, l in labels)
    assert got[1000]["score"] > 0.5 and got[1001]["score"] == got[1002]["score"] < 0.2
    assert got[1003]["score"] < got[1004]["score"]
    assert {r["doc_id"] for r in toxicity.drop_toxic(df, lab).collect()} == {i for i in got if got[i]["predicted"] == 0}
    assert toxicity.toxicity(none, lab).count() == 0
    assert toxicity.toxicity(docs, spark.createDataFrame([(None, 1), (1, None)], "doc_id long, toxic int")).count() == docs.count()


PAGE = "<html><head><title>x</title><script>var t='</p>';</script></head><body><nav><ul><li><a href='/a'>Home</a></li></ul></nav><div class='promo box'>Same offer</div><article><h1>Title {i}</h1><p><b>First&amp; {i} <i>in</i>line.<br><p>Second\n {i} &eacute;</p></article><div>Template line</div><div id='comments'>me too {i}</div><footer>&copy; us</footer>"


def test_html_extraction(spark):
    rows = [(i, f"http://h{i % 2}.example.org/{i}", PAGE.replace("{i}", str(i))) for i in range(40)]
    rows += [(100, None, None), (101, "http://h0.example.org/x", ""), (102, "http://h9.example.org/", "<p>alone & unclosed <p>two"), (0, rows[0][1], rows[0][2])]
    got = {}
    for r in html_extract.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect():
        got.setdefault(r["page_id"], []).append(r)
    assert len(got[0]) == 2
    for i in range(40):
        assert got[i][0]["text"] == f"Title {i}\nFirst& {i} inline.\nSecond {i} é", got[i][0]["text"]
        assert got[i][0]["n_chars"] == len(got[i][0]["text"])
    assert got[100][0]["text"] == got[101][0]["text"] == "" and got[102][0]["text"] == "alone & unclosed\ntwo"
    assert html_extract.extract_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def texts_of(spark, htmls):
    rows = [(i, f"http://one.example.org/{i}", h) for i, h in enumerate(htmls)]
    return {r["page_id"]: r["text"] for r in html_extract.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}


def test_html_composite_importance(spark):
    # the content varies below the first div; the nav's does too, but it goes in any case
    got = texts_of(spark, [f"<body><div class='news'>By our staff<p>story {i}</p></div><div class='foot'>Follow us<p>Same line</p><nav><a>link {i}</a></nav></div></body>" for i in range(40)])
    assert all(got[i] == f"By our staff\nstory {i}" for i in range(40)), got[0]

    def page(i, bits):  # the texts below repeat, only which of them a page holds varies, or does not
        parts = "".join(f"<p class='{c}'>part {c}</p>" for n, c in enumerate("abcdefghijklmnopqrst") if bits >> n & 1)
        return f"<body><div class='kit'>Contents of the kit{parts}</div><h1>Set {i}</h1></body>"

    rng = random.Random(3)
    varied, fixed = texts_of(spark, [page(i, rng.getrandbits(20)) for i in range(60)]), texts_of(spark, [page(i, (1 << 20) - 1) for i in range(60)])
    assert all(varied[i] == f"Contents of the kit\nSet {i}" and fixed[i] == f"Set {i}" for i in range(60)), (varied[0], fixed[0])


def test_html_names(spark):
    forms = ["<body class='right-sidebar'><p>{t}</p>", "<body class='comment-open search'><p>{t}</p>", "<div id='page' class='has-banner'><p>{t}</p></div>", "<article class='post social'><p>{t}</p></article>"]
    forms += ["<main id='search'><p>{t}</p></main>", "<main id='search-results'><p>{t}</p></main>", "<div class='widget'><section><article><p>{t}</p></article></section></div>", "<div class='widget'><p>{t}</p></div>"]
    got = texts_of(spark, [f"<html>{f}<div class='ad'>buy {i}</div><nav>go {i}</nav></html>".replace("{t}", f"words {i}") for i, f in enumerate(forms * 5)])
    for i in range(5 * len(forms)):  # the last form has no other text than what names mark
        assert got[i] == (f"words {i}" if i % len(forms) < len(forms) - 1 else f"words {i}\nbuy {i}"), (i, got[i])
    mixed = texts_of(spark, [f"<body><p>words {i}</p><div id='comments'><p>me too {i}</p></div><div class='x sidebar'>side {i}</div></body>" for i in range(9)])
    assert all(mixed[i] == f"words {i}" for i in range(9))


COMMENTS = [
    # an article with readers' articles beside it in main, as blog engines make them
    "<main><article><h1>T {i}</h1><p>Body text {i} of the story</article><section id='comments'><ol><li class='comment'><article class='comment-body'><p>Reader {i} says hi</article><li class='comment'><article class='comment-body'><p>Other {i}</article></ol></section></main>",
    "<main><article><h1>T {i}</h1><p>Body text {i} of the story<section><article><p>Reader {i} says hi</article></section></article></main>",
    "<main><article><h1>T {i}</h1><p>Body text {i} of the story</article><div class='comment-list'><p>Reader {i} says hi</div></main>",
    "<main><h1>T {i}</h1><article><p>Body text {i} of the story</article><div class='css-{r}'><p>Reader {i} says hi</div><div hidden>secret {i}</div></main>",
    # no article: only the tree can tell
    "<div id='top'><div class='post'><h1>T {i}</h1><p>Body text {i} of the story</div><div class='c1'><div class='c2'><p>Reader {i} a</div><div class='c2'><p>Reader {i} b</div></div></div>",
    "<div class='css-{r}'><div class='css-x{r}'><h1>T {i}</h1><p>Body text {i} of the story</div><div class='css-y{r}'><div class='css-z{r}'><p>Reader {i} a</div><div class='css-z{r}'><p>Reader {i} b</div></div></div>",
    "<div class='wrap'><div class='left'><p><a href='/a'>See {i} also</a></p><p><a href='/b'>And {i} this</a></p></div><div class='right'><h1>T {i}</h1><p>Body text {i} of the story <a href='/c'>here</a> and much more of it</div></div>",
    "<div class='wrap'><section class='q{r}'><p>We use cookies on this site</section><div class='right'><h1>T {i}</h1><p>Body text {i} of the story</div><div class='k'>All rights reserved</div></div>",
]


@pytest.mark.parametrize("template", COMMENTS)
def test_html_templates_without_any_names(spark, template, monkeypatch):
    """Readers' comments, sidebars, notices and classes made anew for every page, told by structure and tree alone."""
    monkeypatch.setattr(html_extract, "NAMED", set())
    rng = random.Random(5)
    got = texts_of(spark, [f"<body><nav>go {i}</nav>{template}</body>".replace("{i}", str(i)).replace("{r}", "".join(rng.choice("abcdefghijk") for _ in range(7))) for i in range(40)])
    more = " here and much more of it" if "much more" in template else ""
    assert all(got[i] == f"T {i}\nBody text {i} of the story{more}" for i in range(40)), got[3]


def test_html_attributes():
    told = lambda html: [t for _, t, what in html_extract.Page(html).blocks if what == html_extract.CONTENT]
    assert told("<article><div data-id='related'><p>Kept 7?</div><div title='see id=ad here'><p>Kept 8?</div><div data-class=sidebar><p>Kept 9</div></article>") == ["Kept 7?", "Kept 8?", "Kept 9"]
    assert told("<body><p hidden>no</p><p data-hidden>yes</p><p HIDDEN=''>no</p><p title=hidden>too</p>") == ["yes", "too"]
    assert told("<body><div id=ad><p>no</div><div ID = 'Sidebar'><p>no</div><div class='x' class='ad'><p>first counts</div>") == ["first counts"]
    assert told("<body><div class='widget'><article><p>in</article></div>") == ["in"]
    assert told("<main><article><p>in</article><div class='widget'><article><p>out</article></div></main>") == ["in"]


def plain_entropy(features):
    n = len(features)
    return 1.0 if n < 2 else -sum(c / n * np.log(c / n) for c in (features.count(f) for f in set(features))) / np.log(n)


def test_style_tree_equals_plain_loop(spark):
    """Entropies and composite importance of a host, and of all hosts as the prior, by plain loops over the pages."""
    rng = random.Random(6)
    pages = []
    for n in range(30):
        body = "".join(f"<div class='a'><p>{rng.choice(['one', 'two', f'own {n}'])}</p>{'<h2>x</h2>' * rng.randint(0, 2)}</div>" for _ in range(rng.randint(1, 3)))
        pages.append((f"http://h{n % 2}.org/{n}", f"<body>{body}<div class='b'>same</div></body>"))
    seen = {}
    for url, html in pages:
        for path, kind, feature in html_extract.Page(html).features():
            seen.setdefault((html_extract.host_of(url), path, kind), []).append(feature)
    want = {}
    for (host, path, kind), own in seen.items():
        if kind in (html_extract.STYLE, html_extract.TEXT):
            everywhere = [f for (_, p, k), x in seen.items() if p == path and k == kind for f in x]
            weight = min(len(everywhere), html_extract.PRIOR_PAGES)
            want[host, path, kind] = (len(own) * plain_entropy(own) + weight * plain_entropy(everywhere)) / (len(own) + weight)
        else:
            want[host, path, kind] = own.count("True") / len(own)
    tree = html_extract.style_tree(spark.createDataFrame(pages, "url string, html string"))
    got = {(r["host"], r["path"], r["kind"]): r["importance"] for r in tree.collect()}
    assert got.keys() == {k for k in want if k[1].startswith("~") or len(seen[k]) >= html_extract.OWN_PAGES} and all(abs(got[k] - want[k]) < 1e-9 for k in got)
    # by hand: an element with two children of importance 0.2 and 0.6 and presentation 0.5
    c = html_extract.composite_importance({"~/a/b": 0.2, "~/a/c": 0.6}, {"~/a": 0.5})
    assert c["~/a"] == pytest.approx(max(0.6, (1 - 0.81) * 0.5 + 0.81 * 0.6)) and c["~"] == pytest.approx(0.6 * 0.9) or c["~"] == pytest.approx(0.6)


def test_html_join_equals_broadcast(spark, monkeypatch):
    rows = [(i, f"http://h{i % 3}.org/{i}", PAGE.replace("{i}", str(i)), "x", 1) for i in range(30)] + [(None, None, None, None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, host string, salt int").select("*", F.lit("p").alias("paths"), F.lit("o").alias("others"), F.lit("t").alias("text"))
    here = sorted((tuple(r) for r in html_extract.extract_text(df).collect()), key=repr)
    monkeypatch.setattr(html_extract, "BROADCAST_BYTES", 0)
    assert sorted((tuple(r) for r in html_extract.extract_text(df).collect()), key=repr) == here and len(here) == 31


def test_html_blocks():
    blocks = lambda html: [t for _, t, what in html_extract.Page(html).blocks if what == html_extract.CONTENT]
    assert blocks("<p>x<script>if (a</p>b) </script>y</p>z") == ["xy", "z"]
    assert blocks("<p>x <button>go <div>on</div></button> y <svg><text>s</text></svg>z<p>w <video>v</p>u") == ["x y z", "w", "u"]
    assert blocks("<p>a<x-y>b</x-y>c<div>d</div>e") == ["abc", "d", "e"]
    assert blocks("<p>1 < 2 <b title='>'>and</b> 3 > 2</p><p it's>fine</p><p title = \"a'>b\">so<!-- <p> --> on<? x ?></p>") == ["1 < 2 and 3 > 2", "fine", "so on"]
    assert blocks("<p>a</p><p title=\"never closed>b</p>") == ["a", "b"] and blocks("<p>a</p><p tail") == ["a"]


def test_html_of_great_length_and_depth():
    import time

    began = time.process_time()
    for html in ("<div>" * 30_000 + "deep", "<div>a" * 10_000, "<div><p>some text</p></div>" * 20_000, "<a " * 300_000, "<a '" * 200_000, "<p title=\"" * 200_000, "<" * 300_000, "<!-- " * 100_000):
        page = html_extract.Page(html)
        assert sum(len(e.path) for e, *_ in page.held) < 150_000_000
    assert html_extract.Page("<main>" + "<div class='abcdefgh'>" * 1_000 + "deep").blocks[0][0].startswith("/article/") and time.process_time() - began < 60


def find(root, i):
    while root[i] != i:
        i = root[i]
    return i


def brute_components(ids, links):
    root = {i: i for i in ids}
    for a, b in links:
        x, y = find(root, a), find(root, b)
        root[max(x, y)] = min(x, y)
    return {i: find(root, i) for i in ids}


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 340)] + [(400, 400)]
    got = dict(tuple(r) for r in components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == brute_components({i for e in edges for i in e}, edges)


def test_near_duplicate_vectors(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(6, 8))
    rows = [(i, (base[i % 6] + rng.normal(size=8) * 0.06).tolist(), i % 2) for i in range(90)] + [(200 + i, base[0].tolist(), 0) for i in range(12)]
    rows += [(300, None, 0), (301, [0.0] * 8, 0), (302, [float("nan")] + [1.0] * 7, 0), (303, base[0].tolist(), None), (None, base[0].tolist(), 0), (304, [], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    ok = [(i, np.asarray(v), l) for i, v, l in rows if i is not None and l is not None and v and np.isfinite(v).all() and np.any(v)]
    links = [(a, b) for k, (a, x, l) in enumerate(ok) for b, y, m in ok[k + 1 :] if l == m and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.98]
    comp = brute_components([i for i, *_ in rows if i is not None], links)
    n = {i: sum(i in e for e in links) for i in comp}
    for block in (4096, 16):
        got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embedding_join.near_duplicates(df, block=block).collect()}
        assert got.pop(None) == (0, None, True)
        assert got == {i: (n[i], comp[i], comp[i] == i) for i in comp}
    assert embedding_join.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<double>, label int")).count() == 0


def test_blocks_meet_in_grid_order(spark):
    """Many small blocks, so that several directions are keys; mixed lengths, repeated ids, clashing columns."""
    rng = np.random.default_rng(8)
    base = rng.normal(size=(40, 6))
    rows = [(i, (base[i % 40] + rng.normal(size=6) * 0.1).tolist(), i % 2) for i in range(400)] + [(1000 + i, base[i % 3, :4].tolist(), 0) for i in range(6)] + [(5, base[5].tolist(), 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").select("*", *[F.lit(1).alias(c) for c in ("v", "rep", "block", "copies", "n", "at", "cell")])
    ok = [(i, np.asarray(v), l) for i, v, l in rows]
    links = [(a, b) for k, (a, x, l) in enumerate(ok) for b, y, m in ok[k + 1 :] if l == m and len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.98]
    comp = brute_components([i for i, *_ in rows], links)
    assert len(links) > 300
    for block in (1, 4):
        got = {}
        for r in embedding_join.near_duplicates(df, block=block).collect():
            got.setdefault(r["vec_id"], []).append((r["n_links"], r["component_id"]))
        assert {i: c[0][1] for i, c in got.items()} == comp and len(got[5]) == 2
        assert sum(n for c in got.values() for n, _ in c) == 2 * len(links)


def test_close_blocks_equal_all_pairs(spark):
    rng = random.Random(12)
    boxes = []
    for n in range(150):
        low = [rng.uniform(-1, 1) for _ in range(5)]
        boxes.append(("x", n, *low, *[c + rng.choice([0, 0.05, 0.3]) for c in low]))
    names = [f"lo{i} double" for i in range(5)] + [f"hi{i} double" for i in range(5)]
    df = spark.createDataFrame(boxes + [("y", 900, *[0.0] * 10)], ", ".join(["label string", "block long", *names]))
    gap = lambda a, b, i: max(a[2 + i] - b[7 + i], b[2 + i] - a[7 + i], 0.0)
    want = {(a[1], b[1]) for a in boxes for b in boxes if a[1] <= b[1] and sum(gap(a, b, i) ** 2 for i in range(5)) <= 0.04} | {(900, 900)}
    got = [tuple(r) for r in embedding_join._close_blocks(df, 5, 0.2).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def shingle_set(t, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return {tuple(w)} if 0 < len(w) < k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def test_shingles(rows):
    import pyarrow as pa

    texts = [t for _, t, *_ in rows]
    for k in (1, 3, 5):
        sets = shingles.shingle_sets(pa.array(texts).slice(1), k)
        want = [shingle_set(t, k) for t in texts[1:]]
        assert [len(s) for s in sets] == [len(s) for s in want]
        for i in range(len(want)):
            for j in range(i):
                assert len(np.intersect1d(sets[i], sets[j])) == len(want[i] & want[j])


def family_rows():
    """Families of near copies of several sizes, one of them large, among unrelated and tiny texts."""
    rng, rows = random.Random(11), []
    for f, size in enumerate((2, 5, 70)):
        base = words(120, 500 + f).split()
        for i in range(size):
            w = list(base)
            for _ in range(rng.choice((0, 1, 2, 3, 4))):
                w[rng.randrange(len(w))] = f"edit{rng.randrange(10**6)}"
            rows.append((1000 * f + i, " ".join(w)))
    passage = words(50, 77)
    return rows + [(9000 + i, words(100, 9000 + i) + " " + passage + " " + words(100, 19000 + i)) for i in range(40)] + [(9100 + i, w) for i, w in enumerate(["a b c d", "a b c d", "a b c d e", "x", "x", "", None])]


@pytest.mark.parametrize("k,least,hot,block", [(3, 90, 24, 1500), (5, 80, 24, 1500), (3, 90, 3, 10)])
def test_jaccard_groups(spark, monkeypatch, k, least, hot, block):
    monkeypatch.setattr(jaccard_join, "HOT", hot)
    monkeypatch.setattr(jaccard_join, "BLOCK_DOCS", block)
    rows = family_rows()
    sets = {i: shingle_set(t, k) for i, t in rows}
    ids = sorted(sets)
    links = [(a, b) for x, a in enumerate(ids) for b in ids[x + 1 :] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b])]
    comp = brute_components(ids, links)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.near_duplicate_groups(spark.createDataFrame(rows, "doc_id long, text string"), k, least, 100).collect()}
    assert got == {i: (len(sets[i]), comp[i]) for i in ids}


def test_jaccard_edges(docs, none, clashing):
    got = jaccard_join.near_duplicate_groups(clashing, 3, 90, 100).collect()
    assert len(got) == docs.count()
    assert [(r["n_shingles"], r["component_id"]) for r in got if r["doc_id"] is None] == [(1, None)]
    assert {r["component_id"] for r in got if r["doc_id"] in (1, 2, 3, 61)} == {1}
    assert jaccard_join.near_duplicate_groups(none).count() == 0 and jaccard_join.keep_one(none).count() == 0


def test_overlaps():
    rng = np.random.default_rng(8)
    sets = [np.unique(rng.integers(0, 400, rng.integers(1, 200))).astype(np.uint64) for _ in range(60)]
    table = jaccard_join.overlaps(sets)
    for i in range(60):
        for j in range(60):
            assert table[i, j] == (0 if i == j else len(np.intersect1d(sets[i], sets[j])))


def test_prefix_rows_are_shuffled_once_and_hot_shingles_streamed(spark, monkeypatch):
    """F1, F2 (round 4): prefix rows go through one shuffle; pairs and stars are those of a plain loop over the rows of each
    shingle, also where a hot shingle's rows come in many batches."""
    rng = np.random.default_rng(9)
    monkeypatch.setattr(jaccard_join, "HOT", 3)
    gather = jaccard_join.gathered
    monkeypatch.setattr(jaccard_join, "gathered", lambda batches: gather(batches, 7))
    rows = sorted({(int(t), int(d)) for t, d in zip(rng.integers(0, 40, 300) ** 2 // 40, rng.integers(0, 60, 300), strict=True)})
    size = {d: int(rng.integers(80, 100)) for d in range(60)}
    at = {x: int(rng.integers(1, 4)) for x in rows}
    factor = {d: int(rng.integers(0, 3)) for d in range(60)}
    level = {d: 1 + jaccard_join.FACTORS[factor[d]] * (size[d] // jaccard_join.STEP) for d in range(60)}
    assert all(jaccard_join.FACTORS[jaccard_join._factor(size[d], level[d])] == jaccard_join.FACTORS[factor[d]] for d in range(60))
    docs = {}
    for t, d in rows:
        docs.setdefault(t, []).append(d)
    want, met = {(d, ds[0]) for ds in docs.values() if len(ds) > 3 for d in ds[1:]}, {}
    for t, ds in docs.items():
        for a in ds if len(ds) <= 3 else []:
            for b in ds:
                need = min(level[a], level[b])
                if b < a and max(at[t, a], at[t, b]) <= need and min(size[a], size[b]) * 100 >= 80 * max(size[a], size[b]):
                    met.setdefault((a, b), []).append(need)
    want |= {ab for ab, needs in met.items() if len(needs) >= max(needs)}
    table = spark.createDataFrame([(t, d, size[d] << 32 | factor[d] << 30 | at[t, d]) for t, d in rows], "token long, doc_id long, facts long")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    edges = jaccard_join.candidate_edges(table, 80, 100)
    got = [tuple(r) for r in edges.collect()]
    assert any(len(ds) > 14 for ds in docs.values()) and len(got) == len(set(got)) and set(got) == want
    plan = edges._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression") == 1 and "Join" not in plan


def test_texts_are_moved_packed(spark):
    """F1, F2 (round 4): what verification moves of a text takes less than its set of shingles, and gives the same set."""
    texts = pa.array([" ".join(f"word{i * i % 97} and" for i in range(400)), None, "", "one é two", "x"])
    packed, n_bytes = jaccard_join._packed(texts)
    sets = shingles.shingle_sets(texts, 3)
    again = jaccard_join._sets(packed.to_pylist(), n_bytes.to_pylist(), 3)
    assert [s.tolist() for s in again] == [s.tolist() for s in sets]
    assert len(packed[0].as_py()) * 3 < 8 * len(sets[0])
