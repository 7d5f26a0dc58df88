"""Label trees: shapes, checks, closures, training sets, node models and path scores.

A tree is an edge table tree(node, parent, label): parent is null at the root, label is null inside.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bramble.functions.hashing import hash32
from bramble.functions.scores import sigmoid
from bramble.operators.features import l2_normalise
from bramble.operators.labels import _numbered
from bramble.operators.linear import _BIAS as BIAS_NUMBER
from bramble.operators.linear import _blocks, _feature_numbers, _numbers, score_examples, train_packed
from bramble.operators.topk import top_k
from bramble.plans.shared import drop, restage, stage

#: Gives (doc_id, node, p) for asked (doc_id, node).
Scorer = Callable[[DataFrame], DataFrame]


def complete_tree(labels: DataFrame, arity: int, seed: int | None = None) -> DataFrame:
    """The complete m-ary tree over labels(label, label_id from 0): nodes are numbered by level, the parent of i is
    floor((i - 1) / m), and the leaves are the last numbers, in label order or in a seeded one."""
    spark = labels.sparkSession
    n = labels.count()
    if not n:
        return spark.createDataFrame([], "node long, parent long, label string")
    size = -(-(arity * n - 1) // (arity - 1))
    order = [hash32(seed, "label"), "label"] if seed is not None else ["label_id"]
    leaves = _numbered(labels.select("label", "label_id"), [F.col("label_id")] if seed is None else order, "place").select((F.col("place") + size - n).alias("node"), "label")
    parent = F.when(F.col("node") > 0, F.expr(f"(node - 1) div {arity}"))
    return spark.range(size).withColumnRenamed("id", "node").join(leaves, "node", "left").select("node", parent.alias("parent"), "label")


def closure(tree: DataFrame) -> DataFrame:
    """(node, ancestor, steps): every node with itself and all above it. Path doubling: the number of joins is logarithmic
    in the depth, which has no limit; a cycle raises."""
    reach = tree.select("node", F.col("node").alias("ancestor"), F.lit(0).alias("steps")).unionByName(tree.where("parent is not null").select("node", F.col("parent").alias("ancestor"), F.lit(1).alias("steps")))
    reach, width = stage(reach, "closure"), 1
    while True:
        far = reach.where(F.col("steps") == width).select(F.col("node").alias("n"), F.col("ancestor").alias("mid"))
        up = reach.where("steps > 0").select(F.col("node").alias("mid"), F.col("ancestor"), "steps")
        more = stage(far.join(up, "mid").select(F.col("n").alias("node"), "ancestor", (F.col("steps") + width).alias("steps")), "closure")
        if not more.limit(1).count():
            return reach
        if more.where("node = ancestor").limit(1).count():
            raise ValueError("the tree has a cycle")
        reach, width = restage(reach.unionByName(more), "closure", reach, more), width * 2


def path_order(paths: DataFrame) -> DataFrame:
    """(model, place): nodes in the order of their paths from the root, so that a subtree stands together."""
    route = paths.groupBy("node").agg(F.array_sort(F.collect_list(F.struct((-F.col("steps")).alias("up"), F.col("ancestor")))).alias("p"))
    numbered = _numbered(route.select("node", F.col("p.ancestor").alias("path")), ["path", "node"], "place")
    return numbered.select(F.col("node").alias("model"), "place")


def _led(e: DataFrame, root: str, nodes: DataFrame) -> DataFrame:
    """(node, end): where the chosen parents(child, parent) of e lead by pointer doubling, after at least as many steps as
    there are nodes: the root, a node without a parent, or, from a cycle, some node of it."""
    steps, n = 1, nodes.count()
    jump = stage(nodes.join(e.select(F.col("child").alias("node"), F.col("parent").alias("end")).where(F.col("child") != root), "node", "left").select("node", F.coalesce("end", "node").alias("end")), "jump")
    while steps < n:
        far = stage(jump.select("node", F.col("end").alias("mid")).join(jump.select(F.col("node").alias("mid"), "end"), "mid").select("node", "end"), "jump")
        changed = far.join(jump.withColumnRenamed("end", "old"), "node").where("end <> old").limit(1).count()
        drop(jump)
        jump, steps = far, steps * 2
        if not changed:
            break
    return jump


def problems(edges: DataFrame, labels: DataFrame, root: str) -> DataFrame:
    """(problem, item) of edges(parent, child, label): self_parent, duplicate_child, duplicate_label, cycle (each node of a
    cycle of two or more), unreachable (not reached from the root), missing_label. No rows: the tree is sound.

    Pointers to parents are doubled, so a tree of any depth takes logarithmically many rounds; only where a child has
    several parents is the way through the others tried afterwards, once more for each that helps.
    """
    e = stage(edges.select("parent", "child", "label"), "edges")
    selfs = e.where("parent = child").select(F.lit("self_parent").alias("problem"), F.col("child").alias("item"))
    children = e.groupBy("child").count().where("count > 1").select(F.lit("duplicate_child").alias("problem"), F.col("child").alias("item"))
    twice = e.where("label is not null").groupBy("label").count().where("count > 1").select(F.lit("duplicate_label").alias("problem"), F.col("label").alias("item"))
    missing = labels.select("label").distinct().join(e, "label", "left_anti").select(F.lit("missing_label").alias("problem"), F.col("label").alias("item"))
    links = stage(e.where("parent <> child").select("parent", "child").distinct(), "links")
    nodes = stage(e.select(F.col("child").alias("node")).unionByName(e.select(F.col("parent").alias("node"))).where("node is not null").distinct(), "nodes")
    chosen = links.groupBy("child").agg(F.min("parent").alias("parent"))
    several = links.groupBy("child").count().where("count > 1").limit(1).count()
    while True:
        ends = _led(chosen, root, nodes)
        if not several:
            break
        sound = ends.where(F.col("end") == root).select("node")
        saved = links.join(sound, links["parent"] == sound["node"], "left_semi").join(sound, links["child"] == sound["node"], "left_anti").groupBy("child").agg(F.min("parent").alias("other"))
        saved = stage(saved.where(F.col("child") != root), "saved")
        if not saved.limit(1).count():
            break
        chosen = stage(chosen.join(saved, "child", "full").select("child", F.coalesce("other", "parent").alias("parent")), "chosen")
    lost = stage(e.select(F.col("child").alias("node")).distinct().join(ends.where(F.col("end") != root), "node"), "lost")
    # after so many steps every pointer that stays below no root stands on a cycle, and every node of it is stood on
    tops = nodes.join(links.where(F.col("child") != root), nodes["node"] == links["child"], "left_anti").select(F.col("node").alias("end"))
    rings = lost.select("end").distinct().join(tops, "end", "left_anti").select(F.lit("cycle").alias("problem"), F.col("end").alias("item"))
    unreachable = lost.select(F.lit("unreachable").alias("problem"), F.col("node").alias("item"))
    return selfs.unionByName(children).unionByName(twice).unionByName(missing).unionByName(rings).unionByName(unreachable)


def node_positives(doc_labels: DataFrame, tree: DataFrame, paths: DataFrame) -> DataFrame:
    """(doc_id, node): nodes above (or at) a label of the document."""
    leaves = tree.where("label is not null").select("label", "node")
    # staged, so that Spark knows how few they are and leaves the documents where they stand
    above = stage(leaves.join(paths, "node").select("label", F.col("ancestor").alias("node")), "above")
    return doc_labels.join(above, "label").select("doc_id", "node").distinct()


def training_set(docs: DataFrame, doc_labels: DataFrame, tree: DataFrame, paths: DataFrame) -> DataFrame:
    """(doc_id, node, y): positives; children of positives that are not positive are negatives; a document without labels
    is a negative of the root."""
    positive = node_positives(doc_labels, tree, paths)
    children = tree.where("parent is not null").select(F.col("parent").alias("node"), F.col("node").alias("child"))
    negative = positive.join(children, "node").select("doc_id", F.col("child").alias("node")).join(positive, ["doc_id", "node"], "left_anti")
    roots = tree.where("parent is null").select("node")
    bare = docs.select("doc_id").join(doc_labels, "doc_id", "left_anti").crossJoin(F.broadcast(roots.limit(1)))
    return positive.select("doc_id", "node", F.lit(1).alias("y")).unionByName(negative.select("doc_id", "node", F.lit(0).alias("y"))).unionByName(bare.select("doc_id", "node", F.lit(0).alias("y")))


def packed_training_set(docs: DataFrame, doc_labels: DataFrame, tree: DataFrame, paths: DataFrame, numbers: DataFrame) -> DataFrame:
    """(doc_id, e): training_set with one row a document; e holds 2 * number + y of each of its nodes by numbers(node,
    number). A label brings its path and the children along it, so documents are shuffled by their labels only."""
    numbered = lambda name: numbers.withColumnRenamed("node", name)
    children = tree.where("parent is not null").select(F.col("parent").alias("ancestor"), "node").join(numbers, "node").groupBy("ancestor").agg(F.collect_list("number").alias("below"))
    above = tree.where("label is not null").select("label", "node").join(paths, "node").join(numbered("ancestor"), "ancestor").join(children, "ancestor", "left")
    routes = stage(above.groupBy("label").agg(F.collect_list("number").alias("own"), F.flatten(F.collect_list("below")).alias("below")), "routes")
    own = doc_labels.select("doc_id", "label").repartition("doc_id").join(routes, "label").groupBy("doc_id").agg(F.array_distinct(F.flatten(F.collect_list("own"))).alias("own"), F.flatten(F.collect_list("below")).alias("below"))
    told = own.select("doc_id", F.concat(F.transform("own", lambda i: i * 2 + 1), F.transform(F.array_except("below", "own"), lambda i: i * 2)).alias("e"))
    root = tree.where("parent is null").select("node").limit(1).join(numbers, "node").select(F.array(F.col("number") * 2).alias("e"))
    return told.unionByName(docs.select("doc_id").join(doc_labels, "doc_id", "left_anti").crossJoin(F.broadcast(root)))


def constant_nodes(training: DataFrame) -> DataFrame:
    """(node, p): nodes whose examples all agree need no model."""
    return training.groupBy("node").agg(F.min("y").alias("lo"), F.max("y").alias("hi")).where("lo = hi").select("node", F.col("lo").cast("double").alias("p"))


def path_products(node_scores: DataFrame, tree: DataFrame, paths: DataFrame) -> DataFrame:
    """(doc_id, label, score): product of the node probabilities(doc_id, node, p) from the root to each leaf; exact, for
    every leaf all of whose path is scored."""
    leaves = tree.where("label is not null").select(F.col("node").alias("leaf"), "label")
    route = leaves.join(paths, leaves["leaf"] == paths["node"]).select("leaf", "label", F.col("ancestor").alias("node"))
    lengths = route.groupBy("leaf").agg(F.count("*").alias("steps"))
    sums = node_scores.join(route, "node").groupBy("doc_id", "leaf", "label").agg(F.sum(F.log(F.greatest("p", F.lit(1e-300)))).alias("s"), F.count("*").alias("k"))
    return sums.join(lengths, "leaf").where("k = steps").select("doc_id", "label", F.exp("s").alias("score"))


def normalised_children(node_scores: DataFrame, tree: DataFrame) -> DataFrame:
    """Node probabilities of siblings divided by their sum, where that exceeds 0."""
    w = Window.partitionBy("doc_id", "parent")
    rows = node_scores.join(tree.select("node", "parent"), "node")
    total = F.sum("p").over(w)
    return rows.select("doc_id", "node", F.when(F.col("parent").isNull() | (total == 0), F.col("p")).otherwise(F.col("p") / total).alias("p"))


def table_scores(node_scores: DataFrame) -> Scorer:
    """A scorer that looks probabilities(doc_id, node, p) up."""
    return lambda asked: asked.join(node_scores.select("doc_id", "node", "p"), ["doc_id", "node"])


def _grown(frontier: DataFrame, tree: DataFrame, scorer: Scorer, normalise: bool) -> DataFrame:
    """(doc_id, node, label, score) of the children of the frontier's inner nodes, path probabilities multiplied on."""
    children = tree.where("parent is not null").select(F.col("parent").alias("up"), "node", "label")
    asked = frontier.where("label is null").select("doc_id", F.col("node").alias("up"), F.col("score").alias("s")).join(children, "up")
    p = scorer(asked.select("doc_id", "node"))
    if normalise:
        p = normalised_children(p, tree)
    return asked.join(p, ["doc_id", "node"]).select("doc_id", "node", "label", (F.col("s") * F.col("p")).alias("score"))


def best_first(docs: DataFrame, tree: DataFrame, scorer: Scorer, k: int, normalise: bool = False) -> DataFrame:
    """(doc_id, rank, label, score): exactly the k labels of the largest path probability of each document, rounded to nine
    places, ties by label. scorer gives (doc_id, node, p) for asked (doc_id, node), p at most 1; a node without p ends there.

    A dive keeps the k best nodes of a document on each level; the k-th best leaf it finds is a bound, and as no path
    grows more likely, the search proper follows only nodes whose path reaches the bound. All documents take a level at
    a time; the depth has no limit.
    """
    root = tree.where("parent is null").select("node", "label")
    at_root = docs.select("doc_id").distinct().crossJoin(F.broadcast(root.limit(1)))
    begin = stage(at_root.join(scorer(at_root.select("doc_id", "node")), ["doc_id", "node"]).select("doc_id", "node", "label", F.col("p").alias("score")), "frontier")
    found, bound = None, None
    for exact in (False, True):
        frontier = begin
        found = begin.where("label is not null")
        while frontier.where("label is null").limit(1).count():
            grown = _grown(frontier, tree, scorer, normalise)
            if exact:
                kept = grown.join(bound, "doc_id", "left").where(F.col("score") >= F.coalesce("bound", F.lit(0.0))).drop("bound")
            else:
                kept = grown.withColumn("leaf", F.col("label").isNotNull())
                kept = top_k(kept, k, by=["doc_id", "leaf"], tie="node").drop("rank", "leaf")
            frontier = stage(kept, "frontier")
            found = found.unionByName(frontier.where("label is not null"))
        # a little below the k-th best: equal scores and roundings stay in
        last = top_k(found, k, tie="node").groupBy("doc_id").agg(F.min("score").alias("bound"), F.count("*").alias("n"))
        bound = stage(last.where(F.col("n") == k).select("doc_id", (F.col("bound") - 2e-9).alias("bound")), "bound") if not exact else bound
    return top_k(found.select("doc_id", "label", F.round("score", 9).alias("score")), k).select("doc_id", "rank", "label", "score")


#: Steps in which gaps between similarities are told apart; within one, labels are dealt by hash.
GAP_STEPS = 4096


def _take(rows: DataFrame, seed: str) -> DataFrame:
    """rows(path, label, gap, m) and taken: exactly the m rows of the largest gap of each path, by steps of the gap and then
    by hash. Counts by step and by hash bucket settle all but a few rows, so no path is sorted in one task."""
    keyed = rows.withColumn("step", F.floor(F.col("gap") * (GAP_STEPS / 4)).cast("int")).withColumn("h", hash32(seed, "label"))
    w = Window.partitionBy("path")

    def before(table: DataFrame, key: str) -> DataFrame:
        n = table.groupBy("path", key).agg(F.count("*").alias("many"))
        order = F.desc(key) if key == "step" else F.asc(key)
        return n.select("path", key, "many", F.coalesce(F.sum("many").over(w.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))

    first = keyed.join(before(keyed, "step"), ["path", "step"])
    border = first.where("before < m and before + many > m").select("path", "label", "h", (F.col("m") - F.col("before")).alias("m")).withColumn("bucket", F.shiftright("h", 20))
    second = border.join(before(border, "bucket"), ["path", "bucket"])
    edge = second.where("before < m and before + many > m").withColumn("r", F.row_number().over(Window.partitionBy("path", "bucket").orderBy("h", "label")))
    taken = first.where("before + many <= m").select("path", "label").unionByName(second.where("before + many <= m").select("path", "label")).unionByName(edge.where("before + r <= m").select("path", "label"))
    return rows.join(taken.withColumn("taken", F.lit(True)), ["path", "label"], "left").withColumn("taken", F.coalesce("taken", F.lit(False)))


def _dealt(gaps: DataFrame, arity: int, seed: str) -> DataFrame:
    """(path, label, n, side, own): sides of equal size, one label more or less, from gaps(path, label, n, sims): one side
    after the other takes the labels that are nearer to it than to all sides still open."""
    rest, done = gaps, None
    for side in range(arity):
        own = F.element_at("sims", side + 1)
        if side == arity - 1:
            last = rest.select("path", "label", "n", F.lit(side).alias("side"), own.alias("own"))
            return last if done is None else done.unionByName(last)
        others = F.array_max(F.slice("sims", side + 2, arity - side - 1))
        m = F.expr(f"cast(n div {arity} as long)") + (F.col("n") % arity > side).cast("long")
        cut = stage(_take(rest.withColumn("gap", own - others).withColumn("m", m), seed), "dealt")
        mine = cut.where("taken").select("path", "label", "n", F.lit(side).alias("side"), own.alias("own"))
        done = mine if done is None else done.unionByName(mine)
        rest = cut.where("not taken").drop("gap", "m", "taken")


def balanced_clusters(centroids: DataFrame, arity: int = 2, most_leaves: int = 8, rounds: int = 4, seed: int = 42, eps: float = 1e-4) -> DataFrame:
    """(label, path): hierarchical balanced k-means on label vectors(label, feature, value), all nodes of a level together.

    A node of more than most_leaves labels is split in `arity` children whose sizes differ by one at most; a path has one
    character a level (digits, then letters). Each round scores labels against their node's centroids (seeded labels at
    first) and deals them anew; a node rests when its mean similarity grows by less than eps, after `rounds` at most.
    """
    if not 2 <= arity <= 36:
        raise ValueError("arity is 2 to 36")
    most_leaves = max(most_leaves, arity - 1)
    unit = stage(l2_normalise(centroids.withColumnRenamed("label", "doc_id")).withColumnRenamed("doc_id", "label"), "unit")
    nodes, depth = stage(unit.select("label").distinct().select("label", F.lit("r").alias("path")), "nodes"), 0
    while True:  # children are smaller than their node, so this ends
        sizes = nodes.groupBy("path").agg(F.count("*").alias("n"))
        active = stage(nodes.join(sizes.where(F.col("n") > most_leaves), "path").select("path", "label", "n"), "open")
        if not active.limit(1).count():
            return nodes
        start = Window.partitionBy("path").orderBy(hash32(f"{seed}-{depth}", "label"), "label")
        # a filter on the rank: Spark keeps the first few of each task before the shuffle
        sides = stage(active.withColumn("r", F.row_number().over(start)).where(F.col("r") <= arity).select("path", "label", (F.col("r") - 1).alias("side")), "seeds")
        resting, before = None, None
        for turn in range(rounds):
            middle = unit.join(sides, "label").groupBy("path", "side", "feature").agg(F.sum("value").alias("c"))
            length = middle.groupBy("path", "side").agg(F.sqrt(F.sum(F.col("c") * F.col("c"))).alias("l"))
            middle = middle.join(length, ["path", "side"]).select("path", "side", "feature", (F.col("c") / F.col("l")).alias("c"))
            dots = unit.join(active, "label").join(middle, ["path", "feature"]).groupBy("path", "label", "side").agg(F.sum(F.col("value") * F.col("c")).alias("v"))
            sims = dots.groupBy("path", "label").agg(F.map_from_entries(F.collect_list(F.struct("side", "v"))).alias("by"))
            none = F.create_map().cast("map<int,double>")
            vector = F.transform(F.sequence(F.lit(0), F.lit(arity - 1)), lambda i: F.coalesce(F.try_element_at(F.coalesce("by", none), i), F.lit(0.0)))
            gaps = stage(active.join(sims, ["path", "label"], "left").select("path", "label", "n", vector.alias("sims")), "sims")
            dealt = stage(_dealt(gaps, arity, f"{seed}-{depth}"), "sides")
            means = stage(dealt.groupBy("path").agg(F.avg("own").alias("now")), "means")
            still = means if before is None else means.join(before.withColumnRenamed("now", "was"), "path").where(F.col("now") > F.col("was") + eps)
            rest = dealt if turn == rounds - 1 else dealt.join(still.select("path"), "path", "left_anti")
            rest = rest.select("path", "label", "side")
            resting = rest if resting is None else resting.unionByName(rest)
            if turn == rounds - 1:
                break
            sides = stage(dealt.join(still.select("path"), "path", "left_semi").select("path", "label", "side"), "going")
            active, before = active.join(sides.select("path").distinct(), "path", "left_semi"), means
            if not sides.limit(1).count():
                break
        digit = F.element_at(F.array(*[F.lit(c) for c in "0123456789abcdefghijklmnopqrstuvwxyz"[:arity]]), F.col("side") + 1)
        moved = resting.select("label", F.concat("path", digit).alias("path"))
        nodes, depth = stage(nodes.join(sizes.where(F.col("n") <= most_leaves), "path", "left_semi").select("label", "path").unionByName(moved), "nodes"), depth + 1


def cluster_tree(clusters: DataFrame) -> DataFrame:
    """The tree of balanced_clusters: inner nodes are path prefixes, labels hang below their cluster."""
    inner = clusters.select(F.explode(F.expr("transform(sequence(1, length(path)), i -> substring(path, 1, i))")).alias("node")).distinct()
    above = F.when(F.length("node") > 1, F.expr("substring(node, 1, length(node) - 1)"))
    return inner.select("node", above.alias("parent"), F.lit(None).cast("string").alias("label")).unionByName(clusters.select(F.concat(F.col("path"), F.lit(":"), "label").alias("node"), F.col("path").alias("parent"), "label"))


def hard_negatives(predictions: DataFrame, doc_labels: DataFrame, tree: DataFrame, paths: DataFrame, n: int) -> DataFrame:
    """(doc_id, node): the n best-scored labels that are not true, with the nodes above them that are not positive."""
    # a document's labels and nodes stand in one row each, so that all is joined by document
    def without(rows: DataFrame, others: DataFrame, column: str) -> DataFrame:
        known = others.groupBy("doc_id").agg(F.collect_set(column).alias("known"))
        return rows.join(known, "doc_id", "left").where(~F.coalesce(F.array_contains("known", F.col(column)), F.lit(False))).drop("known")

    wrong = top_k(without(predictions.select("doc_id", "label", "score"), doc_labels, "label"), n)
    nodes = node_positives(wrong.select("doc_id", "label"), tree, paths)
    return without(nodes, node_positives(doc_labels, tree, paths), "node")


def train_tree(features: DataFrame, doc_labels: DataFrame, tree: DataFrame, batch: int = 64, **options) -> tuple[DataFrame, DataFrame]:
    """(weights(model = node, feature, weight), constants(node, p)) of a probabilistic label tree's node models.

    A node is fitted, as a logistic model of its conditional probability, on the documents that reach it: those with a
    label below its parent (at the root: all). Nodes whose examples agree have a constant and no model. The work is that
    of the examples of the training set, whatever the number of nodes; a document's examples stand in one row.
    """
    paths = closure(tree)
    places = path_order(paths).select(F.col("model").cast("string").alias("model"), F.col("place").alias("rank"))
    models, batches = _numbers(places, batch, ["rank", "model"])
    numbers = tree.select("node", F.col("node").cast("string").alias("model")).distinct().join(models, "model").select("node", (F.col("batch") * batch + F.col("slot")).alias("number"))
    docs = features.select("doc_id").distinct().unionByName(doc_labels.select("doc_id").distinct()).distinct()
    examples = stage(packed_training_set(docs, doc_labels, tree, paths, stage(numbers, "numbers")), "examples")
    y = examples.select(F.explode("e").alias("e")).groupBy(F.shiftright("e", 1).alias("number")).agg(F.min(F.col("e") % 2).alias("lo"), F.max(F.col("e") % 2).alias("hi"))
    constant = stage(y.where("lo = hi").join(numbers, "number").select("node", F.col("lo").cast("double").alias("p")), "constants")
    weights = train_packed(features, examples, models, batches, batch, **options)
    return weights.join(constant.select(F.col("node").cast("string").alias("model")), "model", "left_anti"), constant


def model_scores(features: DataFrame, weights: DataFrame, constants: DataFrame) -> Scorer:
    """A scorer from the node models of train_tree: the sigmoid of the document's score, or the node's constant."""

    def scored(asked: DataFrame) -> DataFrame:
        fixed = asked.join(constants, "node")
        rest = asked.join(constants, "node", "left_anti").select("doc_id", F.col("node").cast("string").alias("model"), "node")
        names = rest.select("model", "node").distinct()
        p = score_examples(features, weights, rest.select("doc_id", "model")).join(names, "model").select("doc_id", "node", sigmoid(F.col("score")).alias("p"))
        return fixed.select("doc_id", "node", "p").unionByName(p)

    return scored


#: Weights and nodes of a tree that a task takes whole; probabilities and products that it holds in one array.
TREE_WEIGHTS, TREE_NODES, CELL_NUMBERS = 1_000_000, 4_096, 1_000_000


def _probabilities(docs: pd.DataFrame, nodes: pd.DataFrame) -> np.ndarray:
    """Probability of each of nodes(fixed, f, w) for each of docs(f, x): a constant, or the sigmoid of the score."""
    n = docs.f.map(len).to_numpy()
    f, x = np.concatenate(docs.f.to_numpy()), np.concatenate(docs.x.to_numpy())
    known, spot = np.unique(f, return_inverse=True)
    many = nodes.f.map(len).to_numpy()
    fid, w, node = np.concatenate(nodes.f.to_numpy()), np.concatenate(nodes.w.to_numpy()), np.repeat(np.arange(len(nodes)), many)
    z = np.zeros((len(docs), len(nodes)))
    z += np.bincount(node[fid == BIAS_NUMBER], weights=w[fid == BIAS_NUMBER], minlength=len(nodes))
    at = np.minimum(np.searchsorted(known, fid), len(known) - 1)
    met = known[at] == fid
    at, w, node = at[met], w[met], node[met]
    step = max(1, CELL_NUMBERS // len(f))
    for low in range(0, len(nodes), step):
        here = (node >= low) & (node < low + step)
        weight = np.zeros((len(known), min(step, len(nodes) - low)))
        weight[at[here], node[here] - low] = w[here]
        z[:, low : low + step] += np.add.reduceat(x[:, None] * weight[spot], np.cumsum(n) - n, axis=0)
    fixed = nodes.fixed.to_numpy(dtype=float)
    with np.errstate(over="ignore"):
        return np.where(np.isnan(fixed), 1 / (1 + np.exp(-z)), fixed)


def _best_of_block(docs: pd.DataFrame, nodes: pd.DataFrame, k: int, normalise: bool) -> pd.DataFrame:
    """(doc_id, rank, label, score) of docs(doc_id, f, x): all paths of the tree nodes(node, parent, label, fixed, f, w)
    multiplied, some documents at a time."""
    place, label = {node: i for i, node in enumerate(nodes.node)}, nodes.label.tolist()
    kids, tops = {}, []
    for i, up in enumerate(nodes.parent):
        tops += [i] if up is None else []
        kids.setdefault(place.get(up), []).append(i)
    parent, order = {}, tops[:1]
    for i in order:  # grows: a labelled node is an end
        below = kids.get(i, []) if label[i] is None else []
        parent |= dict.fromkeys(below, i)
        order += below
    leaves = sorted((i for i in order if label[i] is not None), key=lambda i: label[i])
    out, names = [], np.array([label[i] for i in leaves], dtype=object)
    sizes, begin = np.cumsum(docs.f.map(len).to_numpy() + len(nodes)), 0
    while begin < len(docs) and leaves:
        end = max(begin + 1, int(np.searchsorted(sizes, (sizes[begin - 1] if begin else 0) + CELL_NUMBERS, side="right")))
        some = docs.iloc[begin:end]
        p = _probabilities(some, nodes)
        if normalise:
            for up in order:
                below = [i for i in kids.get(up, []) if parent.get(i) == up]
                total = p[:, below].sum(axis=1, keepdims=True)
                p[:, below] = np.divide(p[:, below], total, out=p[:, below], where=total != 0)
        for i in order[1:]:
            p[:, i] *= p[:, parent[i]]
        score = np.round(p[:, leaves], 9)
        best = np.argsort(-score, axis=1, kind="stable")[:, :k]  # ties go to the first by name
        out.append(pd.DataFrame({"doc_id": some.doc_id.to_numpy().repeat(best.shape[1]), "rank": np.tile(np.arange(1, best.shape[1] + 1), len(some)), "label": names[best.ravel()], "score": np.take_along_axis(score, best, axis=1).ravel()}))
        begin = end
    return pd.concat(out) if out else pd.DataFrame({"doc_id": [], "rank": [], "label": [], "score": []})


def _predict_in_blocks(features: DataFrame, tree: DataFrame, weights: DataFrame, constants: DataFrame, k: int, normalise: bool) -> DataFrame:
    """predict of a tree that a task takes whole: blocks of packed documents meet all of its nodes."""
    names = _feature_numbers(features)
    docs = _blocks(features, names, 1)
    blocks = (docs.agg(F.max("block")).first()[0] or 0) + 1
    own = weights.join(names, "feature").groupBy(F.col("model").alias("node")).agg(F.collect_list(F.struct("fid", "weight")).alias("p"))
    fixed = constants.select(F.col("node").cast("string").alias("node"), F.col("p").alias("fixed"))
    shape = tree.select(F.col("node").cast("string").alias("node"), F.col("parent").cast("string").alias("parent"), "label")
    none = lambda kind: F.array().cast(f"array<{kind}>")
    nodes = shape.join(fixed, "node", "left").join(own, "node", "left").select("node", "parent", "label", "fixed", F.coalesce("p.fid", none("bigint")).alias("f"), F.coalesce("p.weight", none("double")).alias("w"))
    sent = stage(nodes, "nodes").withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    schema = f"doc_id {features.schema['doc_id'].dataType.simpleString()}, rank int, label string, score double"
    return docs.groupBy("block").cogroup(sent.groupBy("block")).applyInPandas(lambda d, n: _best_of_block(d, n, k, normalise), schema)


def predict(features: DataFrame, tree: DataFrame, weights: DataFrame, constants: DataFrame, k: int, normalise: bool = False) -> DataFrame:
    """(doc_id, rank, label, score): the k labels of the largest path probability of each document.

    A tree of few nodes and weights meets blocks of documents whole; a larger one is searched best first, level by level.
    """
    size = tree.agg(F.count("*").alias("nodes"), F.count_distinct("node").alias("names")).first()
    if size["nodes"] == size["names"] <= TREE_NODES and weights.count() <= TREE_WEIGHTS:
        return _predict_in_blocks(features, tree, weights, constants, k, normalise)
    return best_first(features.select("doc_id").distinct(), tree, model_scores(features, weights, constants), k, normalise)
