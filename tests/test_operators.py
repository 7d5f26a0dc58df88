"""Small fixed cases and properties of the operators."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from bramble.functions import hashing as H
from bramble.functions import text as T
from bramble.operators import doctree, features, labels, labeltree, linear, matcher, metrics, split, topk, vectors, weights, wordvectors
from bramble.plans import views


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first()["x"]


def test_tokens_with_end(spark):
    cases = {"asdf asdb": ["asdf", "asdb"], "asdf\n": ["asdf", "</s>"], "\n": ["</s>"], "": [], " ": []}
    for text, want in cases.items():
        assert one(spark, T.tokens_with_end(F.col("t")), t=text) == want


def test_identifier(spark):
    p = one(spark, T.identifier_parts(F.col("t")), t="cpe:2.3:a:tianocore:edk_ii:-:*:*:*:*:*:*:*")
    assert (p["vendor"], p["product"], p["category"]) == ("tianocore", "edk_ii", "application")
    assert one(spark, T.identifier_parts(F.col("t")), t=r"cpe:2.3:h:a\:b:a\:b:1")["name"] == r"a\:b"


def test_ngrams_and_lists(spark):
    words = T.words(F.lit("red dresses"))
    assert one(spark, T.word_ngrams(words, 2), t=1) == ["red dresses"]
    assert one(spark, T.word_ngrams(words, 3), t=1) == []
    assert one(spark, T.windows(F.split(F.lit("a b c"), " "), 2), t=1) == [["a", "b"], ["b", "c"]]
    assert one(spark, T.parse_list_column(F.col("t")), t="['a', 'b c']") == ["a", "b c"]
    p = one(spark, T.parse_label_line(F.col("t")), t="__label__a __label__b red:0.5 blue __weight__:2 __tag__x")
    assert (p["labels"], [(w["word"], w["value"]) for w in p["words"]], p["weight"], p["tags"]) == (["a", "b"], [("red", 0.5), ("blue", 1.0)], 2.0, ["x"])


def test_fnv(spark):
    def fnv(text):
        h = 2166136261
        for b in text.encode():
            h = ((h ^ (b | 0xFFFFFF00 if b >= 128 else b)) * 16777619) % (1 << 32)
        return h

    for text in ("", "a", "héllo", "你"):
        assert one(spark, H.fnv1a(F.col("t")), t=text) == fnv(text)
    want = 0
    for w in ("ab", "cd"):
        want = (want * 116049371 + fnv(w)) % (1 << 64)
    assert one(spark, H.ngram_bucket(F.array(F.lit("ab"), F.lit("cd")), 1000), t=1) == want % 1000


def test_metric_smoke(spark):
    """Four documents, counted by hand: hits at ranks 1 and 3 of 4 labels, 2 of 1, 1 to 3 of 3, none of 1."""
    predicted = [(d, r + 1, l, 1.0 - r / 10) for d, ls in enumerate([[7, 2, 9], [4, 8, 6], [5, 1, 3], [2, 6, 8]]) for r, l in enumerate(ls)]
    truth = [(d, l) for d, ls in enumerate([[7, 9, 1, 3], [8], [5, 1, 3], [4]]) for l in ls]
    h = metrics.hits(spark.createDataFrame(predicted, "doc_id long, rank int, label int, score double"), spark.createDataFrame(truth, "doc_id long, label int"))
    got = {r["k"]: (round(r["p"], 4), round(r["r"], 4)) for r in metrics.macro_at_k(h, [1, 2, 3]).collect()}
    assert got == {1: (0.5, 0.1458), 2: (0.5, 0.4792), 3: (0.5, 0.625)}
    assert metrics.ndcg_at_k(h, [1]).first()["ndcg"] == pytest.approx(0.5)
    both = metrics.propensity_ndcg(h, spark.createDataFrame([(7, 2.0)], "label int, weight double"), [3], normalised=True).first()
    assert 0 < both["psndcg"] <= 1


def test_documents_without_truth_or_hits(spark):
    empty = metrics.hits(spark.createDataFrame([(0, 1, "a", 1.0)], "doc_id long, rank int, label string, score double"), spark.createDataFrame([], "doc_id long, label string"))
    assert empty.count() == 0
    assert metrics.micro(empty).first()["p"] is None


def test_identical_labels(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "a"), (1, "b"), (2, "b"), (1, "c"), (3, "d"), (3, "e")], "doc_id long, label string")
    assert {tuple(r) for r in labels.identical_pairs(rows).collect()} == {("a", "b"), ("d", "e")}
    names, merged = labels.merge_identical(rows)
    assert {r["merged"] for r in names.collect()} == {"a;b", "c", "d;e"} and merged.count() == 4


def test_label_ids_do_not_depend_on_partitions(spark):
    rows = spark.createDataFrame([(i % 50, f"l{i * 7 % 23}") for i in range(400)], "doc_id long, label string")
    for policy in ("sorted", "frequency", "first_seen"):
        a = {tuple(r) for r in labels.index_labels(rows.repartition(1), policy).collect()}
        b = {tuple(r) for r in labels.index_labels(rows.repartition(7), policy).collect()}
        assert a == b and sorted(i for _, i in a) == list(range(23))


def test_top_k_plan_is_partial(spark):
    scores = spark.range(1000).select((F.col("id") % 10).alias("doc_id"), F.col("id").alias("label"), F.rand(1).alias("score"))
    plan = topk.top_k(scores, 3)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_merging_batches_equals_scoring_all(spark):
    rows = spark.createDataFrame([(d, f"l{i}", float((d * 31 + i * 17) % 29)) for d in range(20) for i in range(30)], "doc_id long, label string, score double")
    whole = {tuple(r) for r in topk.top_k(rows, 5).select("doc_id", "rank", "label").collect()}
    parts = [rows.where(F.expr(f"cast(substr(label, 2) as int) % 3 = {b}")) for b in range(3)]
    assert {tuple(r) for r in topk.merge_batches(parts, 5).select("doc_id", "rank", "label").collect()} == whole


def test_weights(spark):
    rows = spark.createDataFrame([(i, "a") for i in range(10)] + [(0, "b")], "doc_id long, label string")
    got = {r["label"]: r["weight"] for r in weights.label_weights(rows).collect()}
    c = (math.log(10) - 1) * 2.5**0.55
    assert got["a"] == pytest.approx(1 + c * 11.5**-0.55) and got["b"] == pytest.approx(1 + c * 2.5**-0.55)


def test_split_shares(spark):
    rows = spark.createDataFrame([(i, f"l{i % 3}") for i in range(1000)], "doc_id long, label string")
    got = split.by_label(rows).groupBy("label").agg(F.count("*").alias("n"), F.sum(F.col("is_test").cast("int")).alias("t")).collect()
    assert all(abs(r["t"] - r["n"] / 4) <= 1 for r in got)


def test_complete_tree_and_problems(spark):
    ids = spark.createDataFrame([(f"l{i}", i) for i in range(7)], "label string, label_id long")
    tree = labeltree.complete_tree(ids, 2)
    rows = tree.collect()
    assert len(rows) == 13 and sum(r["label"] is not None for r in rows) == 7 and sum(r["parent"] is None for r in rows) == 1
    up = labeltree.closure(tree)
    assert up.where("ancestor = 0").count() == 13
    cycle = spark.createDataFrame([("root", "a", None), ("b", "c", "x"), ("c", "b", None)], "parent string, child string, label string")
    found = {tuple(r) for r in labeltree.problems(cycle, spark.createDataFrame([("x",), ("y",)], "label string"), "root").collect()}
    assert found == {("cycle", "b"), ("cycle", "c"), ("unreachable", "b"), ("unreachable", "c"), ("missing_label", "y")}


def test_balanced_clusters(spark):
    rows = spark.createDataFrame([(f"l{i}", f"f{i % 4}", 1.0) for i in range(20)] + [(f"l{i}", f"g{i}", 0.3) for i in range(20)], "label string, feature string, value double")
    sizes = [r["count"] for r in labeltree.balanced_clusters(rows, most_leaves=4).groupBy("path").count().collect()]
    assert sum(sizes) == 20 and max(sizes) <= 4


@pytest.mark.parametrize("arity", [2, 3, 5])
def test_balanced_clusters_are_balanced(spark, arity):
    # equal vectors on purpose: only hashes tell most of them apart
    rows = spark.createDataFrame([(f"l{i}", f"f{i % 2}", 1.0) for i in range(67)], "label string, feature string, value double")
    paths = {r["label"]: r["path"] for r in labeltree.balanced_clusters(rows, arity=arity, most_leaves=4, rounds=3).collect()}
    assert len(paths) == 67
    inner = {p[:i] for p in paths.values() for i in range(1, len(p))}
    for node in inner:
        sizes = [sum(p.startswith(node + c) for p in paths.values()) for c in "0123456789"[:arity]]
        assert max(sizes) - min(sizes) <= 1 and min(sizes) > 0
    assert all(sum(q == p for q in paths.values()) <= max(4, arity - 1) for p in paths.values())
    tree = labeltree.cluster_tree(spark.createDataFrame(list(paths.items()), "label string, path string"))
    edges = tree.where("parent is not null").select("parent", F.col("node").alias("child"), "label")
    assert labeltree.problems(edges, rows, "r").count() == 0


def test_deep_trees(spark):
    n = 1000
    chain = [("root" if i == 0 else f"n{i - 1}", f"n{i}", "x" if i == n - 1 else None) for i in range(n)]
    ring = [(f"c{(i + 1) % 5}", f"c{i}", None) for i in range(5)] + [("c2", "tail", None), ("lone", "leaf", "y")]
    edges = spark.createDataFrame(chain + ring, "parent string, child string, label string")
    labels_df = spark.createDataFrame([("x",), ("y",)], "label string")
    assert labeltree.problems(spark.createDataFrame(chain, edges.schema), labels_df.where("label = 'x'"), "root").count() == 0
    found = {tuple(r) for r in labeltree.problems(edges, labels_df, "root").collect()}
    assert found == {("cycle", f"c{i}") for i in range(5)} | {("unreachable", f"c{i}") for i in range(5)} | {("unreachable", "tail"), ("unreachable", "leaf")}
    # a second parent that leads to the root saves a child and all below it
    two = spark.createDataFrame([("a", "b", None), ("b", "a", None), ("root", "b", None), ("b", "d", "x")], edges.schema)
    assert {tuple(r) for r in labeltree.problems(two, labels_df.where("label = 'x'"), "root").collect()} == {("duplicate_child", "b")}
    tree = spark.createDataFrame([("root", None, None)] + [(c, p, l) for p, c, l in chain[:100]], "node string, parent string, label string")
    assert labeltree.closure(tree).count() == sum(range(1, 102))
    with pytest.raises(ValueError, match="cycle"):
        labeltree.closure(spark.createDataFrame([("a", "b", None), ("b", "a", None)], "node string, parent string, label string"))


@pytest.mark.parametrize("normalise", [False, True])
def test_best_first_is_exact(spark, normalise):
    rng = random.Random(11)
    tree = [(0, None, None)]
    for i in range(1, 60):
        parent = rng.choice([n for n, _, _ in tree if n < 20])
        tree.append((i, parent, None))
    inner = {p for _, p, _ in tree}
    tree = [(n, p, None if n in inner else f"l{n}") for n, p, _ in tree]
    p = {(d, n): rng.choice([0.0, 0.5, 1.0, rng.random() ** 3]) for d in range(12) for n, _, _ in tree}
    kids = {}
    for n, parent, _ in tree:
        kids.setdefault(parent, []).append(n)
    share = dict(p)
    if normalise:
        for (d, n), x in p.items():
            parent = tree[n][1]
            total = sum(p[d, m] for m in kids[parent])
            share[d, n] = x if parent is None or total == 0 else x / total
    want = {}
    for d in range(12):
        scores = []
        for n, _, label in tree:
            if label is not None:
                x, at = 1.0, n
                while at is not None:
                    x, at = x * share[d, at], tree[at][1]
                scores.append((-round(x, 9), label))
        want |= {(d, r): (label, -x) for r, (x, label) in enumerate(sorted(scores)[:4], 1)}
    frame = spark.createDataFrame(tree, "node long, parent long, label string")
    scorer = labeltree.table_scores(spark.createDataFrame([(d, n, x) for (d, n), x in p.items()], "doc_id long, node long, p double"))
    got = {(r["doc_id"], r["rank"]): (r["label"], r["score"]) for r in labeltree.best_first(spark.range(12).withColumnRenamed("id", "doc_id"), frame, scorer, 4, normalise).collect()}
    assert got.keys() == want.keys() and all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 2e-9 for k in want)


def test_node_models_see_the_documents_that_reach_them(spark):
    rng = random.Random(12)
    tree = spark.createDataFrame([("r", None, None), ("a", "r", None), ("b", "r", None), ("a1", "a", "x"), ("a2", "a", "y"), ("b1", "b", "z")], "node string, parent string, label string")
    own = {i: set(rng.sample(["x", "y", "z"], rng.randint(0, 2))) for i in range(60)}
    docs = {i: {f"f{rng.randrange(9)}": rng.random() for _ in range(3)} | {f"own{l}": 1.0 for l in ls if rng.random() < 0.8} for i, ls in own.items()}
    f = spark.createDataFrame([(i, n, x) for i, row in docs.items() for n, x in row.items()], "doc_id long, feature string, value double")
    l = spark.createDataFrame([(i, x) for i, ls in own.items() for x in ls], "doc_id long, label string")
    below = {"r": {"x", "y", "z"}, "a": {"x", "y"}, "b": {"z"}, "a1": {"x"}, "a2": {"y"}, "b1": {"z"}}
    up = {"a": "r", "b": "r", "a1": "a", "a2": "a", "b1": "b"}
    weights, constants = labeltree.train_tree(f, l, tree, rounds=3, batch=2)
    got, fixed = {(r["model"], r["feature"]): r["weight"] for r in weights.collect()}, {r["node"]: r["p"] for r in constants.collect()}
    want, p = {}, {}
    for node, labels_below in below.items():
        seen = [i for i in own if node == "r" or own[i] & below[up[node]]]
        y = {i: bool(own[i] & labels_below) for i in seen}
        if len(set(y.values())) == 1:
            assert fixed[node] == float(y[seen[0]])
            p |= {(i, node): fixed[node] for i in own}
            continue
        w, q = {}, {}
        for _ in range(3):
            g = {}
            for i in seen:
                row, sign = {**docs[i], linear.BIAS: 1.0}, 1.0 if y[i] else -1.0
                slope = -sign / (1 + math.exp(sign * sum(x * w.get(n, 0.0) for n, x in row.items())))
                for n, x in row.items():
                    g[n] = g.get(n, 0.0) + slope * x
            for n, x in g.items():
                x = x / len(seen) + (0.0 if n == linear.BIAS else 1e-6 * w.get(n, 0.0))
                q[n] = q.get(n, 0.0) + x * x
                w[n] = w.get(n, 0.0) - 0.5 * x / math.sqrt(q[n] + 1e-12)
        want |= {(node, n): x for n, x in w.items() if x}
        p |= {(i, node): 1 / (1 + math.exp(-sum(x * w.get(n, 0.0) for n, x in {**docs[i], linear.BIAS: 1.0}.items()))) for i in own}
    assert got == pytest.approx(want) and set(fixed) == {"b1"}
    scores = {(r["doc_id"], r["label"]): r["score"] for r in labeltree.predict(f, tree, weights, constants, 3).collect()}
    for i in own:
        for leaf, label in (("a1", "x"), ("a2", "y"), ("b1", "z")):
            assert scores[i, label] == pytest.approx(p[i, "r"] * p[i, up[leaf]] * p[i, leaf], abs=2e-9)


def test_side_models_fit_better_than_means(spark):
    truth, f = planted(spark)
    f = features.l2_normalise(f)
    sides = doctree.split(truth.select("doc_id").distinct().select(F.lit(0).alias("tree"), F.lit("r").alias("node"), "doc_id"), truth, most_rounds=5)
    loss = {name: doctree.side_loss(sides, f, m).first()["loss"] for name, m in (("mean", doctree.mean_models(sides, f)), ("logistic", doctree.side_models(sides, f)))}
    assert loss["logistic"] < loss["mean"]


def test_own_features_keep_weights_sparse(spark):
    truth, f = planted(spark)
    w = linear.train_in_batches(f, truth, truth, batch=3, rounds=8, own_features=True, epsilon=0.0)
    seen = truth.join(f, "doc_id").select("label", "feature").distinct()
    assert w.where(F.col("feature") != linear.BIAS).join(seen, ["label", "feature"], "left_anti").count() == 0
    assert precision_at_1(topk.top_k(linear.score(f, w), 1), truth) > 0.6
    # documents without features, and features without documents to learn from
    one = linear.train_examples(f.where("doc_id < 0"), spark.createDataFrame([(1, "m", 1), (2, "m", 0), (3, "m", 1)], "doc_id long, model string, y int"), rounds=2)
    assert [r["feature"] for r in one.collect()] == [linear.BIAS]
    assert linear.train_examples(f, spark.createDataFrame([], "doc_id long, model string, y int"), rounds=1).count() == 0


def test_split_objective_never_falls(spark):
    rows = spark.createDataFrame([(d, f"l{(d * k) % 11}") for d in range(120) for k in (1, 3)], "doc_id long, label string").distinct()
    nodes = rows.select("doc_id").distinct().select(F.lit(0).alias("tree"), F.lit("r").alias("node"), "doc_id")
    sides, before = doctree.initial_halves(nodes), 0.0
    assert abs(sides.where("side = 0").count() - sides.where("side = 1").count()) <= 1
    for _ in range(3):
        now = doctree.discounted_counts(sides, rows).first()["objective"]
        assert now >= before - 1e-6
        before, sides = now, doctree.reassign(sides, rows).drop("moved")
    leaves = doctree.cluster_forest(rows.select("doc_id").distinct(), rows, trees=2, most_in_leaf=40, most_rounds=5)
    assert leaves.groupBy("tree").count().where("count = 120").count() == 2


def planted(spark, docs=240, n=6):
    """Each label adds its own word to its documents, among common words."""
    rows = [(d, f"l{l}") for d in range(docs) for l in range(n) if (d * 7 + l * 13) % n < 2]
    labels_df = spark.createDataFrame(rows, "doc_id long, label string")
    words = [(d, "w" + l, 1.0) for d, l in rows] + [(d, f"c{(d * 5 + k) % 9}", 1.0) for d in range(docs) for k in range(3)]
    return labels_df, spark.createDataFrame(words, "doc_id long, feature string, value double")


def precision_at_1(predictions, truth):
    return metrics.macro_at_k(metrics.hits(predictions, truth), [1]).first()["p"]


def test_learners_beat_popularity(spark):
    truth, f = planted(spark)
    popular = truth.groupBy("label").count().orderBy(F.desc("count"), "label").limit(1).select("label", F.lit(1.0).alias("score"))
    floor = precision_at_1(truth.select("doc_id").distinct().crossJoin(popular).withColumn("rank", F.lit(1)), truth)
    w = linear.train_in_batches(f, truth, truth, batch=4, rounds=8)
    assert precision_at_1(topk.top_k(linear.score(f, w), 1), truth) > floor + 0.3
    models, leaves = doctree.grow_forest(features.l2_normalise(f), truth, trees=1, most_in_leaf=40, most_rounds=5)
    places = doctree.place(features.l2_normalise(f), models, leaves, 1)
    assert places.count() == 240
    assert precision_at_1(topk.top_k(doctree.mean_over_trees(places, doctree.leaf_distribution(leaves, truth), 1), 1), truth) > floor + 0.1


def test_matcher_fallback(spark):
    keys = spark.createDataFrame([(1, "red shoes"), (2, "red shoes"), (3, "blue hat")], "doc_id long, key string")
    truth = spark.createDataFrame([(1, "a"), (2, "a"), (2, "b"), (3, "c")], "doc_id long, label string")
    model = matcher.train(keys, truth)
    got = {(r["doc_id"], r["label"]) for r in matcher.predict(model, spark.createDataFrame([(9, "red shoe"), (8, "blue hat")], "doc_id long, key string")).collect()}
    assert got == {(9, "a"), (8, "c")}


def test_nearest_keys_skip_what_all_share(spark):
    """Every key holds the n-grams of one long word: they alone must make no pairs, and results equal all pairs."""
    rng = random.Random(13)
    name = lambda: "commonpart" + "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6))
    known_names = sorted({name() for _ in range(300)})
    asked_names = sorted({k[:-1] + "z" for k in known_names[:40]} | {"commonpart", "zzz"})
    asked, known = (spark.createDataFrame([(k,) for k in x], "key string") for x in (asked_names, known_names))
    vec = {}
    for r in matcher.key_vectors(asked.unionByName(known).distinct()).collect():
        vec.setdefault(r["key"], {})[r["gram"]] = r["weight"]
    want = {}
    for q in asked_names:
        sims = [(-round(sum(w * vec[k][g] for g, w in vec[q].items() if g in vec[k]), 9), k) for k in known_names if vec[q].keys() & vec[k].keys()]
        if sims:
            want[q] = min(sims)[1]
    assert {r["key"]: r["nearest"] for r in matcher.nearest_keys(asked, known).collect()} == want
    v = matcher.key_vectors(asked.unionByName(known).distinct())
    a, k = v.join(asked, "key", "left_semi"), v.join(known, "key", "left_semi").select(F.col("key").alias("nearest"), "gram", F.col("weight").alias("w"))
    named = asked.where("key <> 'commonpart'")
    pairs = matcher.candidate_keys(a.join(named, "key", "left_semi"), k).count()
    assert pairs < 0.5 * (len(asked_names) - 1) * len(known_names)


def test_fixed_candidates(spark):
    rng = random.Random(14)
    universe = spark.createDataFrame([(f"l{i}",) for i in range(30)], "label string")
    own = {d: {f"l{rng.randrange(30)}" for _ in range(rng.choice([1, 3, 20]))} for d in range(40)}
    rows = spark.createDataFrame([(d, l) for d, ls in own.items() for l in ls], "doc_id long, label string")
    out = labels.fixed_candidates(rows, universe, 8)
    got, pads = {}, set()
    for r in out.collect():
        got.setdefault(r["doc_id"], []).append((r["label"], r["own"]))
    for d, ls in own.items():
        assert len(got[d]) == 8 == len({l for l, _ in got[d]}) and sum(o for _, o in got[d]) == min(8, len(ls)) and all((l in ls) == o for l, o in got[d])
        pads.add(tuple(sorted(l for l, o in got[d] if not o)))
    assert len(pads) > 10  # documents are padded from different places
    few = labels.fixed_candidates(spark.createDataFrame([(1, "a")], "doc_id long, label string"), spark.createDataFrame([("a",), ("b",)], "label string"), 8).collect()
    assert {(r["label"], r["own"]) for r in few} == {("a", True), ("b", False)}


@pytest.mark.parametrize("logits", [False, True])
def test_shared_ensemble_equals_the_whole_one(spark, logits):
    rng = random.Random(15)
    own = spark.createDataFrame([(d, f"l{l}", round(rng.random(), 2)) for d in range(15) for l in rng.sample(range(40), rng.randint(1, 12))], "doc_id long, label string, score double")
    shared = spark.createDataFrame([(f"l{l}", round(rng.random(), 1)) for l in range(5, 45)], "label string, score double")
    everywhere = own.select("doc_id").distinct().crossJoin(shared)
    want = {tuple(r) for r in topk.sum_ensemble([own, everywhere], 6, logits=logits).select("doc_id", "rank", "label", "score").collect()}
    assert {tuple(r) for r in topk.shared_ensemble(own, shared, 6, logits=logits).select("doc_id", "rank", "label", "score").collect()} == want


def test_folds_are_equal(spark):
    for n in (0, 3, 23, 100):
        sizes = [r["count"] for r in split.folds(spark.range(n).withColumnRenamed("id", "doc_id"), 5).groupBy("fold").count().collect()]
        assert sum(sizes) == n and (not sizes or max(sizes) - min(sizes) <= 1)


def test_markup_lines(spark):
    page = "#REDIRECT [[x]]"
    text = "<p>One   Two\n[[Target|the anchor]] 42 Été\nsingle\n{{tpl|x}} a &amp; b<!-- no\n no -->"
    df = spark.createDataFrame([(page,), (text,), (None,)], "m string")
    assert [r[0] for r in df.select(T.is_redirect(F.col("m"))).collect()] == [True, False, False]
    assert df.select(T.markup_to_lines(F.col("m"))).collect()[1][0] == ["one two", "the anchor 42 été", "a b"]


def test_vectors(spark):
    v = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.6, 0.8]), ("c", [0.0, 1.0])], "id string, vector array<double>")
    got = vectors.nearest(spark.createDataFrame([("q", [2.0, 0.0])], "query string, vector array<double>"), v, 2).orderBy("rank").collect()
    assert [(r["id"], r["similarity"]) for r in got] == [("a", 1.0), ("b", 0.6)]
    grams = spark.createDataFrame([("<a>", [1.0, 3.0])], "gram string, vector array<double>")
    assert vectors.subword_vectors(spark.createDataFrame([("a",)], "word string"), grams, 3, 3).first()["vector"] == [1.0, 3.0]
    zero = spark.createDataFrame([("g", [1.0], 0.0)], "g string, vector array<double>, w double")
    assert vectors.mean_vectors(zero, "g", F.col("w")).first()["vector"] == [0.0]


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, label string")
    assert labels.index_labels(none).count() == 0 and labels.identical_pairs(none).count() == 0
    assert features.l2_normalise(spark.createDataFrame([], "doc_id long, feature string, value double")).count() == 0


def test_entry_imports():
    import __spark_entry__ as e

    assert "flagship_ranking_metrics" in e.queries() and set(e.oracle_sql()) <= set(e.queries())


def test_lines_are_numbered_over_files_and_splits(spark, tmp_path):
    from bramble.sources import readers, writers

    rng, want = random.Random(4), []
    folder = tmp_path / "parts"
    folder.mkdir()
    for part, n in enumerate([3, 400, 1, 0, 2000, 50]):
        lines = [f"{part} {i} " + "x" * rng.randint(0, 60) for i in range(n)]
        (folder / f"part-{part:05d}-a.txt").write_text("".join(f"{x}\n" for x in lines))
        want += lines
    # part numbers count, not names: Spark pads them to five digits only
    (folder / "part-100000-a.txt").write_text("last\n")
    want.append("last")
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "5k")
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        got = readers.numbered_lines(spark, str(folder))
        assert got.columns == ["line", "value"] and sorted((r["line"], r["value"]) for r in got.collect()) == list(enumerate(want))
        docs = spark.createDataFrame([(i // 2, f"text {i} " + "y" * rng.randint(0, 90), [f"l{i}", "a b"]) for i in range(900)], "doc_id long, text string, labels array<string>").repartition(7)
        texts, labels = str(tmp_path / "texts"), str(tmp_path / "labels")
        writers.text_and_labels(docs, texts, labels)
        rows = readers.aligned_files(spark, texts, labels, "train").collect()
        assert sorted(r["line"] for r in rows) == list(range(900)) and all(r["labels"] == [f"l{r['text'].split()[1]}", "a_b"] for r in rows)
        for batch in range(2):
            (tmp_path / "scores" / f"batch={batch}").mkdir(parents=True)
            for part in range(3):
                (tmp_path / "scores" / f"batch={batch}" / f"part-{part:05d}.txt").write_text("".join(f"{batch}:0.{part}{i}\n" for i in range(1, 4)))
        scored = readers.score_files(spark, str(tmp_path / "scores")).collect()
        assert sorted((r["batch"], r["line"], r["label"], r["score"]) for r in scored) == [(f"batch={b}", 3 * p + i - 1, b, float(f"0.{p}{i}")) for b in range(2) for p in range(3) for i in range(1, 4)]
    finally:
        for k, x in before.items():
            spark.conf.set(k, x)
    (tmp_path / "none").mkdir()
    assert readers.numbered_lines(spark, str(tmp_path / "none")).count() == 0


@pytest.mark.parametrize("loss", ["squared_hinge", "logistic"])
def test_linear_models_equal_plain_loops(spark, loss):
    rng = random.Random(2)
    docs = {i: {f"f{rng.randrange(12)}": rng.random() for _ in range(rng.randint(1, 5))} for i in range(40)}
    own = {i: {f"l{rng.randrange(4)}" for _ in range(rng.randint(0, 2))} for i in docs}
    f = spark.createDataFrame([(i, n, x) for i, row in docs.items() for n, x in row.items()], "doc_id long, feature string, value double")
    l = spark.createDataFrame([(i, x) for i, ls in own.items() for x in ls], "doc_id long, label string")
    w, q = {}, {}
    for _ in range(4):
        g = {}
        for i, row in docs.items():
            row = {**row, linear.BIAS: 1.0}
            for label in sorted(set().union(*own.values())):
                y, score = (1.0 if label in own[i] else -1.0), sum(x * w.get((label, n), 0.0) for n, x in row.items())
                slope = -2 * y * max(0.0, 1 - y * score) if loss == "squared_hinge" else -y / (1 + math.exp(y * score))
                for n, x in row.items():
                    g[label, n] = g.get((label, n), 0.0) + slope * x
        for (label, n), x in g.items():
            x = x / len(docs) + (0.0 if n == linear.BIAS else 1e-6 * w.get((label, n), 0.0))
            if x:
                q[label, n] = q.get((label, n), 0.0) + x * x
                w[label, n] = w.get((label, n), 0.0) - 0.5 * x / math.sqrt(q[label, n] + 1e-12)
    got = {(r["label"], r["feature"]): r["weight"] for r in linear.train_in_batches(f, l, l, batch=3, rounds=4, loss=loss).collect()}
    assert got == pytest.approx({k: x for k, x in w.items() if abs(x) > 0.01})


def test_cells_are_bounded_whatever_the_documents(monkeypatch):
    import tracemalloc

    rng = np.random.default_rng(5)
    n, width = 4_000, 100
    docs = pd.DataFrame({"f": [rng.choice(40, 4, replace=False) for _ in range(n)], "x": [rng.random(4) for _ in range(n)], "slots": [rng.choice(width, 2, replace=False) for _ in range(n)], "ys": [np.ones(2)] * n, "rest": (np.arange(n) % 5 > 0).astype(int)})
    state = pd.DataFrame({"fid": np.repeat(np.arange(-1, 40), width), "slot": np.tile(np.arange(width, dtype=np.int32), 41), "w": rng.standard_normal(41 * width)})
    whole = linear._cell_gradients(docs, state, width, "logistic", False)
    monkeypatch.setattr(linear, "CELL_NUMBERS", 5_000)
    tracemalloc.start()
    parts = linear._cell_gradients(docs, state, width, "logistic", False)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    a, b = (g.sort_values(["fid", "slot"]).reset_index(drop=True) for g in (whole, parts))
    assert np.array_equal(a[["fid", "slot"]].to_numpy(), b[["fid", "slot"]].to_numpy()) and np.allclose(a.g, b.g)
    # documents times models would be 400,000 numbers an array
    assert peak < 3_000_000


def test_window_counts_equal_windows(spark):
    from pyspark.sql import functions as F

    rng = random.Random(5)
    texts = [" ".join(rng.choice("abcdefg") for _ in range(rng.choice([0, 1, 3, 4, 5, 9, 30]))) for _ in range(60)] + [None]
    words, pairs = {}, {}
    for t in texts:
        w = (t or "").split()
        for s in range(max(1, len(w) - 3) if w else 0):
            win = w[s : s + 4]
            for x in set(win):
                words[x] = words.get(x, 0) + 1
            for i, x in enumerate(win):
                for j, y in enumerate(win):
                    if i != j and x != y:
                        pairs[x, y] = pairs.get((x, y), 0) + 1
    got = features.window_counts(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string"), F.filter(F.split("text", " "), lambda x: x != ""), 4)
    assert {tuple(r) for r in got[0].collect()} == {(k, n) for k, n in words.items()} and {tuple(r) for r in got[1].collect()} == {(*k, n) for k, n in pairs.items()}


def test_word_pairs_are_joined_once(spark):
    docs = spark.createDataFrame([(1, "a b c a"), (2, "b c d")], "doc_id long, text string")
    words = F.split("text", " ")
    n, pairs = features.window_counts(docs, words, 2)
    total = spark.createDataFrame([(5,)], "total long")
    graph = features.text_graph(docs, words, 2)
    for df in (features.pmi(n, pairs, total), graph.where("src_type = 'word'")):
        lines = [x for x in df._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in x or "Generate explode(array(" in x]
        # the other order is made above all joins
        assert "Generate" in lines[0] and "Join" in lines[1], lines
    nodes = features.graph_nodes(docs, words, F.lit(False))
    whole = features.numbered_edges(graph, nodes).collect()
    assert sorted(features.numbered_edges(features.text_graph(docs, words, 2, once=True), nodes, once=True).collect()) == sorted(whole)


def test_shared_filtered_ranks(spark):
    rng = random.Random(6)
    score = {f"l{i}": rng.randrange(6) for i in range(20)}
    facts = {(k, f"l{rng.randrange(20)}") for k in range(15) for _ in range(4)}
    gold = {k: min(l for kk, l in facts if kk == k) for k in range(15)}
    want = {(k, g, 1 + sum(x > score[g] and (k, l) not in facts for l, x in score.items())) for k, g in gold.items()}
    frames = spark.createDataFrame(list(score.items()), "label string, score long"), spark.createDataFrame(sorted(facts), "key long, label string"), spark.createDataFrame(list(gold.items()), "key long, label string")
    assert {tuple(r) for r in metrics.shared_filtered_ranks(*frames).collect()} == want


@pytest.mark.parametrize("norms", [False, True])
def test_quantized_dots_equal_dots_of_reconstructions(spark, norms):
    rng = random.Random(7)
    rows = [(i, [rng.gauss(0, 1 + i % 3) for _ in range(6)]) for i in range(60)] + [(60, [0.0] * 6), (61, None)]
    e = spark.createDataFrame(rows, "id long, vector array<double>")
    codes, books = vectors.product_quantize(e, 4, centroids=8, rounds=5, norms=norms)
    back = {r["id"]: r["vector"] for r in vectors.reconstruct(codes, books).collect()}
    assert set(back) == set(range(61)) and all(len(x) == 6 for x in back.values())
    given = dict(rows)
    pairs = spark.createDataFrame([(q, i) for q in (0, 5, 60, 99) for i in (1, 2, 60, 61, 99)], "query long, id long")
    got = {(r["query"], r["id"]): r["dot"] for r in vectors.approximate_dots(pairs, e.where("vector IS NOT NULL").withColumnRenamed("id", "query"), codes, books).collect()}
    want = {(q, i): sum(x * y for x, y in zip(given[q], back[i], strict=True)) for q in (0, 5, 60) for i in (1, 2, 60)}
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], abs_tol=1e-9) for k in want)


def test_quantize_with_a_centroid_for_each_vector_is_exact(spark):
    rows = [(i, [float(i % 4), float(i % 3), 2.0, float(i % 2)]) for i in range(24)]
    codes, books = vectors.product_quantize(spark.createDataFrame(rows, "id long, vector array<double>"), 2, centroids=32)
    assert {r["id"]: list(r["vector"]) for r in vectors.reconstruct(codes, books).collect()} == dict(rows)
    empty = spark.createDataFrame([], "id long, vector array<double>")
    codes, books = vectors.product_quantize(empty, 2)
    assert codes.count() == 0 and vectors.reconstruct(codes, books).count() == 0


@pytest.mark.parametrize("cbow", [False, True])
def test_word_vectors(spark, monkeypatch, cbow):
    """Two topics whose words never meet: words of a topic end up closer to each other than to those of the other one."""
    monkeypatch.setattr(wordvectors, "BLOCK_TOKENS", 4_000)
    rng = random.Random(16)
    topics = [["river", "water", "boats", "shore"], ["stock", "money", "bonds", "trade"]]
    texts = [(i, " ".join(rng.choice(topics[i % 2]) for _ in range(25)) + " the the") for i in range(400)] + [(900, None), (901, ""), (902, "rareword")]
    model = wordvectors.train(spark.createDataFrame(texts, "doc_id long, text string"), F.filter(F.split(F.coalesce("text", F.lit("")), " "), lambda x: x != ""), dim=8, cbow=cbow, rounds=6, rate=0.2)
    units = {(r["kind"], r["name"]): np.asarray(r["vector"]) for r in model.units.collect()}
    known = {r["token"]: np.asarray(r["vector"]) for r in model.known().collect()}
    assert set(known) == {*topics[0], *topics[1], "the"}
    cos = lambda a, b: float(a @ b / np.linalg.norm(a) / np.linalg.norm(b))
    near = [cos(known[a], known[b]) for t in topics for a in t for b in t if a < b]
    far = [cos(known[a], known[b]) for a in topics[0] for b in topics[1]]
    assert min(near) > max(far)
    grams = lambda w: {g for n in range(3, 7) for i in range(len(w) + 3 - n) if (g := f"<{w}>"[i : i + n])}
    for w, x in known.items():
        assert np.allclose(x, np.mean([units["word", w], *[units["gram", g] for g in grams(w)]], axis=0))
    unseen = {r["word"]: np.asarray(r["vector"]) for r in model.unseen(spark.createDataFrame([("waters",), ("river",), ("zzzzz",), ("waters",)], "word string")).collect()}
    assert set(unseen) == {"waters"} and np.allclose(unseen["waters"], np.mean([units["gram", g] for g in grams("waters") if ("gram", g) in units], axis=0))
    assert cos(unseen["waters"], known["river"]) > cos(unseen["waters"], known["money"])


def test_word_vector_blocks_have_tasks_of_their_own(spark, monkeypatch):
    plans, whole = [], wordvectors.stage

    def watched(df, label):
        if label == "made":
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return whole(df, label)

    monkeypatch.setattr(wordvectors, "stage", watched)
    monkeypatch.setattr(wordvectors, "BLOCK_TOKENS", 20)
    docs = spark.createDataFrame([(i, "red green blue red green") for i in range(20)], "doc_id long, text string")
    wordvectors.train(docs, T.words(F.col("text")), dim=2, rounds=1)
    # a number of tasks that is stated: bytes do not tell how long a block takes
    assert len(plans) == 1 and "hashpartitioning(block" in plans[0] and "REPARTITION_BY_NUM" in plans[0]


def test_rows_are_added_one_after_another():
    rng = np.random.default_rng(3)
    a, rows, more = rng.random((7, 3)), rng.integers(0, 7, 50), rng.random((50, 3))
    b = a.copy()
    np.add.at(a, rows, more)
    wordvectors._add(b, rows, more)
    assert (a == b).all()


def test_word_windows():
    docs = pd.DataFrame({"words": [[5, 6, 7, 8], [9]], "reach": [[1, 2, 1, 3], [2]]})
    inputs, sizes, targets = wordvectors._windows(docs, False)
    assert sorted(zip(inputs.tolist(), targets.tolist(), strict=True)) == [(5, 6), (6, 5), (6, 7), (6, 8), (7, 6), (7, 8), (8, 5), (8, 6), (8, 7)] and set(sizes) == {1}
    inputs, sizes, targets = wordvectors._windows(docs, True)
    assert targets.tolist() == [5, 6, 7, 8] and sizes.tolist() == [1, 3, 2, 3] and sorted(inputs[1:4].tolist()) == [5, 7, 8]


def test_word_vectors_of_nothing(spark):
    model = wordvectors.train(spark.createDataFrame([], "doc_id long, text string"), F.split("text", " "), rounds=1)
    assert model.known().count() == 0 and model.unseen(spark.createDataFrame([("abc",)], "word string")).count() == 0


def test_vectors_are_made_once_a_word(spark):
    """means by position equal means by cell, and nothing makes the vectors before the words are distinct."""
    rows = [(d, w) for d, text in enumerate(["a b a", "b", "c c c a", "z"]) for w in text.split()]
    tokens = spark.createDataFrame(rows, "doc_id int, token string")
    made = tokens.select("token").distinct().where("token <> 'z'").select("token", vectors.hashed_vector(F.col("token"), 3).alias("vector"))
    got = vectors.sentence_vectors(tokens, made, dim=3)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Filter" in line and "md5" in line]
    by_word = {r["token"]: np.array(r["vector"]) / np.linalg.norm(r["vector"]) for r in made.collect()}
    found = {r["doc_id"]: r["vector"] for r in got.collect()}
    other = {r["doc_id"]: r["vector"] for r in vectors.sentence_vectors(tokens, made).collect()}
    assert found.keys() == other.keys() == {0, 1, 2}
    for d in found:
        assert np.allclose(found[d], np.mean([by_word[w] for e, w in rows if e == d], axis=0)) and np.allclose(found[d], other[d])


def test_nearest_keys_by_blocks(spark):
    """blocks of a few keys find what one block finds and what all pairs give, ties by name, keys without a gram left out."""
    rng = random.Random(3)
    name = lambda: "".join(rng.choice("abc1") for _ in range(rng.randint(1, 7)))
    known_names, asked_names = sorted({name() for _ in range(60)}), sorted({name() for _ in range(60)} | {"zzz", ""})
    asked, known = (spark.createDataFrame([(k,) for k in x], "key string") for x in (asked_names, known_names))
    vec = {}
    for r in matcher.key_vectors(asked.unionByName(known).distinct()).collect():
        vec.setdefault(r["key"], {})[r["gram"]] = r["weight"]
    want = {}
    for q in asked_names:
        sims = [(-round(sum(w * vec[k][g] for g, w in vec[q].items() if g in vec[k]), 9), k) for k in known_names if vec.get(q, {}).keys() & vec[k].keys()]
        if sims:
            want[q] = (min(sims)[1], -min(sims)[0])
    for block in (7, 1000):
        got = {r["key"]: (r["nearest"], r["similarity"]) for r in matcher.nearest_keys(asked, known, block).collect()}
        assert got.keys() == want.keys()
        assert all(got[q][0] == want[q][0] and abs(got[q][1] - want[q][1]) < 2e-9 for q in want)
    assert matcher.nearest_keys(asked, known.limit(0)).count() == 0
    assert matcher.nearest_keys(asked.limit(0), known).count() == 0


def test_same_sets_are_expanded_once(spark):
    """documents with equal sets are asked for once a part, whatever their number; results are as one by one."""
    groups = [(d, g) for d in range(400) for g in ((1, 2), (2,), (3, 9), (1, 2, 3))[d % 4]]
    members = [(1, "a"), (1, "b"), (2, "b"), (2, "c"), (3, "d"), (3, "d")]
    asked = []

    def rows_of(kinds):
        asked.append(kinds.count())
        return kinds.withColumn("n", F.size("set"))

    sets = spark.createDataFrame(groups, "doc_id int, group int").groupBy("doc_id").agg(F.array_sort(F.collect_set("group")).alias("set"))
    assert labels.of_sets(sets.crossJoin(spark.range(50)).select((F.col("doc_id") * 50 + F.col("id")).alias("doc_id"), "set"), rows_of).count() == 400 * 50
    assert asked[0] == 4 * labels.SET_PARTS
    got = labels.expand_groups(spark.createDataFrame(groups, "doc_id int, group int"), spark.createDataFrame(members, "group int, label string"))
    assert sorted(map(tuple, got.collect())) == sorted({(d, l) for d, g in groups for h, l in members if g == h})
    places = [(0, "x", 1), (1, "y", 1), (0, "x", 2), (1, "z", 2), (0, "x", 3), (1, "y", 3), (1, "none", 4)]
    share = [(0, "x", "a", 0.5), (0, "x", "b", 0.25), (1, "y", "a", 1.0), (1, "z", "c", 0.5)]
    mean = doctree.mean_over_trees(spark.createDataFrame(places, "tree int, node string, doc_id int"), spark.createDataFrame(share, "tree int, node string, label string, p double"), 2)
    want = {(d, "a"): 0.75 for d in (1, 3)} | {(2, "a"): 0.25, (2, "c"): 0.25} | {(d, "b"): 0.125 for d in (1, 2, 3)}
    assert {(r["doc_id"], r["label"]): r["score"] for r in mean.collect()} == want


def test_best_first_searches_once_a_key(spark, monkeypatch):
    """node scores depend on the key, so the search takes keys, not documents."""
    from bramble.plans import registry

    registry.load()
    searched, search = [], labeltree.best_first

    def counted(docs, *rest, **options):
        searched.append(docs.distinct().count())
        return search(docs, *rest, **options)

    monkeypatch.setattr(labeltree, "best_first", counted)
    sf = "/root/testdata/sf0.001"
    registry.QUERIES["l10_best_first"](spark, sf)
    assert searched == [spark.read.parquet(f"{sf}/orders.parquet").select("o_orderpriority").distinct().count()]


def test_block_dot(spark, monkeypatch):
    """blocks and batches give what one join gives, with and without k, and no products are shuffled."""
    rng = random.Random(5)
    f = spark.createDataFrame(sorted({(d, f"f{rng.randrange(9)}"): rng.randrange(-9, 9) for d in range(40) for _ in range(4)}.items()), "k struct<doc_id:long,feature:string>, value long").select("k.doc_id", "k.feature", "value")
    w = spark.createDataFrame(sorted({(f"l{rng.randrange(12)}", f"f{rng.randrange(10)}"): rng.randrange(-3, 4) for _ in range(60)}.items()), "k struct<label:string,feature:string>, weight long").select("k.label", "k.feature", "weight")
    want = sorted(map(tuple, features.sparse_dot(f, w).collect()))
    for limits in ((4_000_000, 2_000_000, 1_000_000), (20, 30, 7)):
        for name, n in zip(("BATCH_WEIGHTS", "BLOCK_SCORES", "PRODUCTS"), limits, strict=True):
            monkeypatch.setattr(features, name, n)
        assert sorted(map(tuple, features.block_dot(f, w).collect())) == want
        best = topk.top_k(features.block_dot(f, w, 3), 3)
        assert sorted(map(tuple, best.collect())) == sorted(map(tuple, topk.top_k(features.sparse_dot(f, w), 3).collect()))
    assert features.block_dot(f.limit(0), w).count() == features.block_dot(f, w.limit(0)).count() == 0


def test_small_trees_meet_blocks_of_documents(spark, monkeypatch):
    rng = random.Random(31)
    rows = [(0, None, None), *[(i, (i - 1) // 3, None if i < 5 else f"l{i}") for i in range(1, 16)]]
    tree = spark.createDataFrame(rows, "node long, parent long, label string")
    own = {i: rng.sample([f"l{n}" for n in range(5, 15)], rng.randint(0, 3)) for i in range(40)}
    docs = {i: {f"f{n}": rng.random() for n in rng.sample(range(9), 3)} for i in own}
    f = spark.createDataFrame([(i, n, x) for i, row in docs.items() for n, x in row.items()], "doc_id long, feature string, value double")
    l = spark.createDataFrame([(i, x) for i, ls in own.items() for x in ls], "doc_id long, label string")
    # examples stand in one row a document, and are those of the training set
    paths, ids = labeltree.closure(tree), f.select("doc_id").distinct()
    packed = labeltree.packed_training_set(ids, l, tree, paths, tree.select("node", F.col("node").cast("int").alias("number"))).collect()
    assert len(packed) == len({r["doc_id"] for r in packed}) == 40
    assert {(r["doc_id"], e // 2, e % 2) for r in packed for e in r["e"]} == {tuple(r) for r in labeltree.training_set(ids, l, tree, paths).select("doc_id", "node", "y").collect()}
    # no search level by level: each document's paths are multiplied in one task, some documents at a time
    w = {(n, x): rng.gauss(0, 2) for n in range(2, 16) for x in [*(f"f{i}" for i in range(9)), linear.BIAS]}
    weights = spark.createDataFrame([(str(n), x, v) for (n, x), v in w.items()], "model string, feature string, weight double")
    constants = spark.createDataFrame([(0, 1.0), (1, 0.25)], "node long, p double")
    monkeypatch.setattr(labeltree, "best_first", None)
    monkeypatch.setattr(labeltree, "CELL_NUMBERS", 50)
    found = {(r["doc_id"], r["rank"]): (r["label"], r["score"]) for r in labeltree.predict(f, tree, weights, constants, 4, normalise=True).collect()}
    assert len(found) == 40 * 4
    for d, row in docs.items():
        p = {n: 1 / (1 + math.exp(-sum(x * w[n, name] for name, x in {**row, linear.BIAS: 1.0}.items()))) for n in range(2, 16)} | {0: 1.0, 1: 0.25}
        path = {0: 1.0}
        for n, up, _ in rows[1:]:
            path[n] = path[up] * p[n] / sum(p[m] for m, other, _ in rows if other == up)
        want = sorted((-round(path[n], 9), label) for n, _, label in rows if label)[:4]
        assert [found[d, r][0] for r in range(1, 5)] == [x for _, x in want] and [found[d, r][1] for r in range(1, 5)] == pytest.approx([-x for x, _ in want], abs=2e-9)


def test_documents_with_the_same_labels_move_together(spark, monkeypatch):
    rng = random.Random(32)
    own = {i: sorted(rng.sample("abcdefg", rng.randint(0, 3))) for i in range(300)}
    truth = spark.createDataFrame([(i, x) for i, ls in own.items() for x in ls], "doc_id long, label string")
    w = spark.createDataFrame([("a", 0.5), ("b", 3.0)], "label string, weight double")
    nodes = spark.range(300).select(F.lit(0).alias("tree"), F.when(F.col("id") < 200, "r0").otherwise("r1").alias("node"), F.col("id").alias("doc_id"))
    assert doctree.label_sets(truth)[1].count() == len({tuple(ls) for ls in own.values() if ls})
    sides = lambda: {tuple(r) for r in doctree.split(nodes, truth, w, most_rounds=4).select("node", "doc_id", "side").collect()}
    with monkeypatch.context() as m:
        m.setattr(doctree, "NODE_CELLS", 0)
        want = sides()
    # no round is a job of its own where nodes are small
    monkeypatch.setattr(doctree, "reassign", None)
    assert sides() == want and len(want) == 300


def test_cells_of_nearest_vectors():
    import inspect
    import tracemalloc

    rng = np.random.default_rng(33)
    v = [x / np.linalg.norm(x) for x in rng.integers(-2, 3, size=(300, 4)) + 0.01]
    left = pd.DataFrame({"query": range(200), "v": v[:200], "apart": [["a", "b", None][i % 3] for i in range(200)], "banned": [[i, None] for i in range(200)]})
    right = pd.DataFrame({"id": range(299, -1, -1), "v": v[::-1], "apart": [["a", "b", "c"][i % 3] for i in range(299, -1, -1)]})
    got = vectors._best_of_cell(left, right, 3).groupby("query").apply(lambda g: list(zip(g["id"], g.similarity, strict=True)), include_groups=False)
    for q in range(200):
        own = left.apart[q]
        near = sorted((-round(float(v[q] @ v[i]), 6), i) for i in range(300) if i != q and (own is None or own != ["a", "b", "c"][i % 3]))[:3]
        assert [i for i, _ in got[q]] == [i for _, i in near] and [s for _, s in got[q]] == pytest.approx([-s for s, _ in near], abs=1e-6)
    # a full cell
    sizes = [inspect.signature(vectors.nearest).parameters[n].default for n in ("query_block", "vector_block")]
    left, right = ({"v": list(rng.normal(size=(n, 8))), "apart": ["a"] * n} for n in sizes)
    left, right = pd.DataFrame(left | {"query": range(sizes[0]), "banned": [[None]] * sizes[0]}), pd.DataFrame(right | {"id": range(sizes[1])}).assign(apart="b")
    tracemalloc.start()
    vectors._best_of_cell(left, right, 5)
    assert tracemalloc.get_traced_memory()[1] < 250_000_000
    tracemalloc.stop()


def test_context_pairs_need_no_join(spark):
    rng = random.Random(34)
    # places with gaps, and a document of one word
    places = {d: sorted(rng.sample(range(60), n)) for d, n in ((1, 40), (2, 12), (3, 1))}
    rows = [(d, p, f"w{p % 7}") for d, ps in places.items() for p in ps]
    got = features.context_pairs(spark.createDataFrame(rows, "doc_id long, pos int, token string"), 3)
    word = {(d, p): t for d, p, t in rows}
    from hashlib import md5

    reach = {(d, p): int(md5(f"42|{d}|{p}".encode()).hexdigest()[:8], 16) % 3 + 1 for d, p in word}
    want = sorted((d, word[d, p], word[d, q]) for d, p in word for q in places[d] if q != p and abs(q - p) <= reach[d, p])
    assert sorted(tuple(r) for r in got.collect()) == want
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()


# --- sizes of tasks -------------------------------------------------------------------------------------------------


SMALL = "/root/testdata/sf0.001"


def test_tasks_of_order_rows_do_not_grow_with_the_tables(spark, monkeypatch):
    whole = sorted(map(tuple, views.hits(spark, SMALL).collect()))
    monkeypatch.setattr(views, "TASK_LINES", 500)
    monkeypatch.setattr(views, "FEW_PARTS", 0)
    rows = views.hits(spark, SMALL)
    parts = -(-views.table(spark, SMALL, "lineitem").count() // 500)
    # labels, predictions and their join stand by document in parts of their own number
    assert rows.rdd.getNumPartitions() == parts > 4
    assert sorted(map(tuple, rows.collect())) == whole
    most = rows.groupBy(F.spark_partition_id().alias("part")).count().agg(F.max("count")).first()[0]
    assert most < len(whole) / 4


def test_hits_count_a_label_without_a_name_as_truth_but_never_as_a_hit(spark):
    predicted = spark.createDataFrame([(1, 1, "a", 0.9), (1, 2, None, 0.5), (2, 1, "b", 0.4)], "doc_id long, rank int, label string, score double")
    truth = spark.createDataFrame([(1, "a"), (1, "a"), (1, None), (2, "c")], "doc_id long, label string")
    got = {(r.doc_id, r.rank): (r.hit, r.n_truth) for r in metrics.hits(predicted, truth).collect()}
    assert got == {(1, 1): (1, 2), (1, 2): (0, 2), (2, 1): (0, 1)}


def test_tail_scores_and_hard_negatives_do_not_move_documents_again(spark, monkeypatch):
    from bramble.plans import q_labels, q_models

    asked = {q_models.t10: None, q_models.t32: None, q_labels.t31: None}
    for q in asked:
        asked[q] = sorted(map(tuple, q(spark, SMALL).collect()))
    monkeypatch.setattr(views, "TASK_LINES", 500)
    monkeypatch.setattr(views, "FEW_PARTS", 0)
    parts = -(-views.table(spark, SMALL, "lineitem").count() // 500)
    for q, want in asked.items():
        rows = q(spark, SMALL)
        # the last step by document runs in the parts that the order rows were spread to
        assert rows.rdd.getNumPartitions() == parts > 4
        assert sorted(map(tuple, rows.collect())) == want


def test_pairs_are_hashed_as_whole_arrays(spark, monkeypatch):
    texts = [["ab", "cd", "ab", "cd"], [], ["é", "日本", "x" * 300], ["ab"], ["cd", "ab"]]
    docs = spark.createDataFrame([(t,) for t in texts], "w array<string>").coalesce(1)
    asked = spark.createDataFrame([(a, b) for t in texts for a, b in zip(t, t[1:])], "a string, b string").distinct()
    want = sorted(map(tuple, asked.select(F.concat_ws(" ", "a", "b"), H.ngram_bucket(F.array("a", "b"), 10_000_000)).collect()))
    for at_once in (1, 3, 1_000_000):
        monkeypatch.setattr(H, "WORDS_AT_ONCE", at_once)
        rows = H.pair_buckets(docs, F.col("w"), 10_000_000)
        assert sorted(map(tuple, rows.collect())) == want
    # no byte of a pair goes through a Spark loop
    assert "aggregate(" not in rows._jdf.queryExecution().toString()


def _sent_rows(spark, since):
    """The most rows that a query begun after number `since` has sent to all tasks, and the number of the last query."""
    store = spark._jsparkSession.sharedState().statusStore()
    runs, most, last = store.executionsList(), 0, -1
    for i in range(runs.size()):
        number = runs.apply(i).executionId()
        last = max(last, number)
        if number <= since:
            continue
        values, nodes = store.executionMetrics(number), store.planGraph(number).allNodes()
        for node in (nodes.apply(j) for j in range(nodes.size())):
            if node.name().startswith("BroadcastExchange"):
                metrics = node.metrics()
                for m in (metrics.apply(j) for j in range(metrics.size())):
                    if m.name() == "number of output rows" and values.get(m.accumulatorId()).isDefined():
                        most = max(most, int(values.get(m.accumulatorId()).get().replace(",", "")))
    return most, last


def test_nearest_keys_are_not_sent_to_all(spark):
    """F9 (round 4): no table of keys is broadcast, however small its files are; different n-grams are, if they are few."""
    asked = spark.range(4000).select(F.format_string("Customer#%09d", "id").alias("key"))
    known = spark.range(300).select(F.format_string("Supplier#%09d", "id").alias("key"))
    _, since = _sent_rows(spark, -1)
    grams = matcher.key_vectors(asked.unionByName(known)).select("gram").distinct().count()
    assert grams < 1500
    _, since = _sent_rows(spark, since)
    assert matcher.nearest_keys(asked, known).count() == 4000
    most, _ = _sent_rows(spark, since)
    assert most <= grams


def test_cells_are_packed_once_and_slots_have_models(spark, monkeypatch):
    """F3, F4 (round 4): the documents of a cell are made once for all rounds, as one row, and only slots that have a model are
    trained; a label's own features are those of its documents."""
    rng = random.Random(8)
    docs = {i: {f"f{rng.randrange(12)}": rng.random() for _ in range(rng.randint(1, 5))} for i in range(60)}
    own = {i: {f"l{rng.randrange(4)}" for _ in range(rng.randint(0, 2))} for i in docs}
    f = spark.createDataFrame([(i, n, x) for i, row in docs.items() for n, x in row.items()], "doc_id long, feature string, value double")
    l = spark.createDataFrame([(i, x) for i, ls in own.items() for x in ls], "doc_id long, label string")
    staged, widths, make, train = [], [], linear.stage, linear._train
    monkeypatch.setattr(linear, "stage", lambda df, label: staged.append((label, df)) or make(df, label))
    monkeypatch.setattr(linear, "_train", lambda *a: widths.append(a[4]) or train(*a))
    got = linear.train_in_batches(f, l, l, batch=1000, rounds=3, own_features=True, epsilon=0.0)
    cells = [df for label, df in staged if label == "cells"]
    assert widths == [4] and len(cells) == 1 and {"block", "batch", "f", "x"} <= set(cells[0].columns)
    assert cells[0].groupBy("block", "batch").count().where("count > 1").count() == 0
    assert {(r["label"], r["feature"]) for r in got.collect()} <= {(x, n) for i, ls in own.items() for x in ls for n in docs[i]} | {(f"l{i}", linear.BIAS) for i in range(4)}


def test_best_labels_by_rounded_score(spark):
    """F4 (round 4): the k best labels by rounded sigmoid, ties by label, are among what blocks hand on, and scores have the
    bias; labels that share no feature have no row."""
    from bramble.functions.scores import sigmoid

    rng = random.Random(5)
    f = spark.createDataFrame([(i, f"f{n}", rng.choice((0.5, 1.0, 2.0))) for i in range(80) for n in rng.sample(range(10), rng.randint(1, 4))], "doc_id long, feature string, value double")
    w = [(f"l{j}", f"f{n}", rng.choice((-30.0, -1.0, 0.3, 0.3000001, 25.0))) for j in range(30) for n in rng.sample(range(12), 4)] + [(f"l{j}", linear.BIAS, rng.choice((-0.2, 0.4))) for j in range(0, 30, 2)]
    w = spark.createDataFrame(w, "label string, feature string, weight double")
    rounded = lambda rows: topk.top_k(rows.select("doc_id", "label", F.round(sigmoid(F.col("score")), 6).alias("score")), 5)
    whole, some = linear.score(f, w), linear.best(f, w, 5)
    want = sorted((r["doc_id"], r["rank"], r["label"], r["score"]) for r in rounded(whole).collect())
    assert sorted((r["doc_id"], r["rank"], r["label"], r["score"]) for r in rounded(some).collect()) == want
    assert some.count() < whole.count()


@pytest.mark.parametrize("loss", [None, "logistic"])
def test_subtrees_grow_in_one_task_as_in_spark(spark, monkeypatch, loss):
    """F5, F11 (round 4): what grows from a node in one task is what grows level by level in Spark, leaves and models."""
    rng = random.Random(21)
    rows = {i: {f"l{rng.randrange(6)}" for _ in range(rng.randint(0, 3))} for i in range(-20, 160)}
    truth = spark.createDataFrame([(i, x) for i, ls in rows.items() for x in ls], "doc_id long, label string")
    f = spark.createDataFrame([(i, x, 1.0 + rng.random()) for i, ls in rows.items() for x in {f"f{n[1]}" for n in ls} | {f"g{rng.randrange(5)}"}], "doc_id long, feature string, value double")
    made, grow = [], doctree._subtrees
    monkeypatch.setattr(doctree, "_subtrees", lambda *a: made.append(a[3]) or grow(*a))

    def grown():
        if loss is None:
            leaves = doctree.cluster_forest(f.select("doc_id").distinct(), truth, trees=1, most_in_leaf=60)
            return sorted(map(tuple, leaves.select("tree", "node", "doc_id").collect())), {}
        models, leaves = doctree.grow_forest(f, truth, trees=1, most_in_leaf=80, classifier=loss, rounds=3)
        return sorted(map(tuple, leaves.select("tree", "node", "doc_id").collect())), {(r["tree"], r["node"], r["feature"]): r["weight"] for r in models.collect()}

    here = grown()
    assert made == [1] and len(here[0]) == len(f.select("doc_id").distinct().collect())
    monkeypatch.setattr(doctree, "NODE_DOCS", 0)
    made.clear()
    level = grown()
    assert not made and here[0] == level[0] and len({node for _, node, _ in here[0]}) > 1
    assert here[1] == pytest.approx(level[1])


def test_graph_of_numbered_texts(spark):
    """F12 (round 4): word pairs are counted as two numbers, not as two words; edges are those of the graph of words, also for
    repeated and null ids and empty texts."""
    rng = random.Random(6)
    rows = [(i // 2 if i % 9 == 0 else i, " ".join(rng.choice("abcdefgh") * rng.randint(1, 2) for _ in range(rng.randint(0, 30)))) for i in range(60)] + [(None, "a b zz"), (7, ""), (8, "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    tokens = T.words(F.col("text"))
    nodes = features.graph_nodes(docs, tokens, F.col("doc_id") % 4 == 0).cache()
    texts = features.numbered_texts(docs, tokens, nodes)
    round_ = lambda df: sorted((r["src"], r["dst"], round(r["weight"], 9)) for r in df.collect())
    want = round_(features.numbered_edges(features.text_graph(docs, tokens, once=True), nodes, once=True))
    assert len(want) > 100 and round_(features.numbered_graph(texts, nodes)) == want
    pairs = features._unordered_counts(texts, F.col("w"), 20)[1]
    assert [t for _, t in pairs.dtypes] == ["bigint"] * 3
