"""Ranking metrics from one central table hits(doc_id, rank, label, score, hit, n_truth)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hits(predictions: DataFrame, truth: DataFrame) -> DataFrame:
    """Ranked predictions(doc_id, rank, label, score) with hit (0/1) and n_truth; documents without truth are left out."""
    # a document's labels stand in one row, so that all is joined by document
    nothing = F.max(F.col("label").isNull().cast("int"))
    known = truth.groupBy("doc_id").agg(F.collect_set("label").alias("known"), nothing.alias("nothing"))
    hit = F.coalesce(F.array_contains("known", F.col("label")), F.lit(False)).cast("int")
    return predictions.join(known, "doc_id").select("doc_id", "rank", "label", "score", hit.alias("hit"), (F.size("known") + F.col("nothing")).alias("n_truth"))


def cumulative(h: DataFrame) -> DataFrame:
    """hits with the number of hits up to each rank."""
    w = Window.partitionBy("doc_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    return h.withColumn("hits_so_far", F.sum("hit").over(w))


def _at(h: DataFrame, ks: list[int]) -> DataFrame:
    """One row per document and k: hits among the first k, predictions made, truth size."""
    sums = [F.sum(F.when(F.col("rank") <= k, F.col("hit")).otherwise(0)).alias(f"h{k}") for k in ks]
    made = [F.sum((F.col("rank") <= k).cast("int")).alias(f"m{k}") for k in ks]
    docs = h.groupBy("doc_id").agg(F.first("n_truth").alias("n_truth"), *sums, *made)
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"h{k}").alias("hits"), F.col(f"m{k}").alias("made")) for k in ks]))
    return docs.select("doc_id", "n_truth", rows.alias("r")).select("doc_id", "n_truth", "r.k", "r.hits", "r.made")


def f1(p: Column, r: Column) -> Column:
    return F.when(p + r == 0, 0.0).otherwise(2 * p * r / (p + r))


def macro_at_k(h: DataFrame, ks: list[int]) -> DataFrame:
    """(k, p, r, f1): means over documents of hits / k and hits / truth; F1 of the two means."""
    m = _at(h, ks).groupBy("k").agg(F.avg(F.col("hits") / F.col("k")).alias("p"), F.avg(F.col("hits") / F.col("n_truth")).alias("r"))
    return m.withColumn("f1", f1(F.col("p"), F.col("r")))


def totals_at_k(h: DataFrame, ks: list[int]) -> DataFrame:
    """(k, correct, predicted, actual, p, r): raw totals and the ratios of totals."""
    t = _at(h, ks).groupBy("k").agg(F.sum("hits").alias("correct"), F.sum("made").alias("predicted"), F.sum("n_truth").alias("actual"))
    return t.select("*", (F.col("correct") / F.col("predicted")).alias("p"), (F.col("correct") / F.col("actual")).alias("r"))


def micro(h: DataFrame) -> DataFrame:
    """(p, r) over everything predicted."""
    docs = h.groupBy("doc_id").agg(F.sum("hit").alias("c"), F.count("*").alias("m"), F.first("n_truth").alias("t"))
    return docs.agg((F.sum("c") / F.sum("m")).alias("p"), (F.sum("c") / F.sum("t")).alias("r"))


def micro_precision_macro_recall(h: DataFrame, ks: list[int]) -> DataFrame:
    t = _at(h, ks).groupBy("k").agg((F.sum("hits") / F.sum("made")).alias("p"), F.avg(F.col("hits") / F.col("n_truth")).alias("r"))
    return t.withColumn("f1", f1(F.col("p"), F.col("r")))


def precision_percent(h: DataFrame, ks: list[int]) -> DataFrame:
    """(k, p): 100 * hits / (rows * k)."""
    return _at(h, ks).groupBy("k").agg((100 * F.sum("hits") / (F.count("*") * F.first("k"))).alias("p"))


def _discount(rank: Column) -> Column:
    return 1 / F.log2(rank + 1)


def ndcg_at_k(h: DataFrame, ks: list[int]) -> DataFrame:
    """(k, ndcg): discounted hits over the best possible with min(k, truth) hits, averaged over documents."""
    gains = [F.sum(F.when(F.col("rank") <= k, F.col("hit") * _discount(F.col("rank"))).otherwise(0.0)).alias(f"g{k}") for k in ks]
    docs = h.groupBy("doc_id").agg(F.first("n_truth").alias("t"), *gains)
    ideal = lambda k: F.aggregate(F.sequence(F.lit(1), F.least(F.lit(k), F.col("t"))), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), (F.col(f"g{k}") / ideal(k)).alias("v")) for k in ks]))
    return docs.select(rows.alias("r")).groupBy("r.k").agg(F.avg("r.v").alias("ndcg"))


def list_ndcg(relevance: Column, k: int) -> Column:
    """nDCG of a list of 0/1 relevances against the list sorted; 0 for a list without hits."""
    def gain(values: Column) -> Column:
        top = F.slice(values, 1, k)
        terms = F.transform(top, lambda x, i: x / F.log2(i + 2))
        return F.aggregate(terms, F.lit(0.0), lambda s, x: s + x)

    best = gain(F.reverse(F.array_sort(relevance)))
    return F.when(best > 0, gain(relevance) / best).otherwise(0.0)


def propensity_ndcg(h: DataFrame, weights: DataFrame, ks: list[int], normalised: bool = False) -> DataFrame:
    """(k, psndcg): hits weighed by 1 / propensity and discounted by ln(rank + 1), over the sum of the k discounts.

    With normalised=True it is divided by the best value that each document's own truth allows at its ranks instead.
    """
    w = h.join(weights, "label", "left").withColumn("w", F.coalesce("weight", F.lit(1.0)))
    gains = [F.sum(F.when(F.col("rank") <= k, F.col("hit") * F.col("w") / F.log(F.col("rank") + 1)).otherwise(0.0)).alias(f"g{k}") for k in ks]
    docs = w.groupBy("doc_id").agg(F.first("n_truth").alias("t"), F.max("w").alias("most"), *gains)
    norm = lambda k: F.lit(sum(1 / __import__("math").log(i + 1) for i in range(1, k + 1)))
    top = lambda k: norm(k) * F.col("most") if normalised else norm(k)
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), (F.col(f"g{k}") / top(k)).alias("v")) for k in ks]))
    return docs.select(rows.alias("r")).groupBy("r.k").agg(F.avg("r.v").alias("psndcg"))


def coverage(h: DataFrame, labels: DataFrame, k: int) -> DataFrame:
    """(p, r, coverage): ratios of totals at k, and distinct correctly predicted labels over all labels."""
    top = h.where(F.col("rank") <= k)
    found = top.agg(F.sum("hit").alias("c"), F.count("*").alias("m"), F.count_distinct(F.when(F.col("hit") == 1, F.col("label"))).alias("d"))
    truth = h.groupBy("doc_id").agg(F.first("n_truth").alias("t")).agg(F.sum("t").alias("t"))
    n = labels.agg(F.count_distinct("label").alias("n"))
    return found.crossJoin(truth).crossJoin(n).select((F.col("c") / F.col("m")).alias("p"), (F.col("c") / F.col("t")).alias("r"), (F.col("d") / F.col("n")).alias("coverage"))


def set_metrics(h: DataFrame, model_col: str, ks: list[int]) -> DataFrame:
    """(model, k, p, r) for several models' hits in one table."""
    sums = [F.struct(F.lit(k).alias("k"), F.sum(F.when(F.col("rank") <= k, F.col("hit")).otherwise(0)).alias("hits")) for k in ks]
    docs = h.groupBy(model_col, "doc_id").agg(F.first("n_truth").alias("t"), F.array(*sums).alias("a")).select(model_col, "t", F.explode("a").alias("r"))
    return docs.groupBy(model_col, F.col("r.k").alias("k")).agg(F.avg(F.col("r.hits") / F.col("r.k")).alias("p"), F.avg(F.col("r.hits") / F.col("t")).alias("r"))


def threshold_f1(scores: DataFrame, truth: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(micro_f1, macro_f1) of predictions with score >= threshold; a label without a true positive counts 0."""
    predicted = scores.where(F.col("score") >= threshold).select("doc_id", "label", F.lit(1).alias("p"))
    both = predicted.join(truth.select("doc_id", "label").distinct().withColumn("t", F.lit(1)), ["doc_id", "label"], "full")
    per = both.groupBy("label").agg(F.sum(F.when(F.col("p").isNotNull() & F.col("t").isNotNull(), 1).otherwise(0)).alias("tp"), F.count("p").alias("np"), F.count("t").alias("nt"))
    f = F.when(F.col("tp") == 0, 0.0).otherwise(2 * F.col("tp") / (F.col("np") + F.col("nt")))
    return per.agg((2 * F.sum("tp") / (F.sum("np") + F.sum("nt"))).alias("micro_f1"), F.avg(f).alias("macro_f1"))


def positive_precision(h: DataFrame, ks: list[int]) -> DataFrame:
    """(k, p): hits with a score above 0 among the first k, over k, averaged over documents."""
    return macro_at_k(h.withColumn("hit", F.when(F.col("score") > 0, F.col("hit")).otherwise(0)), ks).select("k", "p")


def regression_metrics(rows: DataFrame, truth: str, predicted: str) -> DataFrame:
    """(accuracy, mse, squared_correlation) from one pass of sums."""
    y, p = F.col(truth).cast("double"), F.col(predicted).cast("double")
    s = rows.agg(F.avg((y == p).cast("double")).alias("accuracy"), F.avg((y - p) * (y - p)).alias("mse"), F.count("*").alias("n"), F.sum(y).alias("sy"), F.sum(p).alias("sp"), F.sum(y * y).alias("yy"), F.sum(p * p).alias("pp"), F.sum(y * p).alias("yp"))
    n = F.col("n")
    top = F.pow(n * F.col("yp") - F.col("sy") * F.col("sp"), 2)
    below = (n * F.col("pp") - F.pow("sp", 2)) * (n * F.col("yy") - F.pow("sy", 2))
    return s.select("accuracy", "mse", (top / below).alias("squared_correlation"))


def filtered_ranks(scores: DataFrame, facts: DataFrame, gold: DataFrame) -> DataFrame:
    """(key, label, rank) of each gold label among the candidates of its key, other true facts of the key set aside."""
    known = facts.select("key", "label").distinct()
    asked = gold.select("key", F.col("label").alias("gold"))
    target = scores.join(asked, (scores["label"] == asked["gold"]) & (scores["key"] == asked["key"])).select(scores["key"], "gold", F.col("score").alias("gold_score"))
    others = scores.join(known, ["key", "label"], "left_anti")
    better = target.join(others, "key", "left").where(F.col("score") > F.col("gold_score")).groupBy("key", "gold").count()
    return target.join(better, ["key", "gold"], "left").select("key", F.col("gold").alias("label"), (F.coalesce("count", F.lit(0)) + 1).alias("rank"))


def shared_filtered_ranks(scores: DataFrame, facts: DataFrame, gold: DataFrame) -> DataFrame:
    """filtered_ranks where a label(label, score) scores the same for every key: no key meets every label.

    The rank is 1 + the labels that score more than the gold one - the key's own facts among them. Labels above a score
    are counted over distinct scores.
    """
    known = facts.select("key", "label").distinct()
    per_score = scores.groupBy("score").count()
    above = F.coalesce(F.sum("count").over(Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    target = gold.select("key", F.col("label").alias("gold")).join(scores.select(F.col("label").alias("gold"), F.col("score").alias("gold_score")), "gold")
    target = target.join(per_score.select(F.col("score").alias("gold_score"), above.alias("above")), "gold_score")
    own = known.join(scores, "label").join(target, "key").where(F.col("score") > F.col("gold_score")).groupBy("key", "gold").count()
    return target.join(own, ["key", "gold"], "left").select("key", F.col("gold").alias("label"), (1 + F.col("above") - F.coalesce("count", F.lit(0))).alias("rank"))


def question_coverage(answers: DataFrame) -> DataFrame:
    """(section, questions, known, coverage): per cent of the questions(section, right) whose words are all known."""
    n = answers.groupBy("section").agg(F.count("*").alias("questions"), F.count("right").alias("known"))
    return n.withColumn("coverage", 100 * F.col("known") / F.col("questions"))


def unknown_pairs(pairs: DataFrame) -> DataFrame:
    """(pairs, known, oov): per cent of the pairs(similarity) with an unknown word, which have no similarity."""
    n = pairs.agg(F.count("*").alias("pairs"), F.count("similarity").alias("known"))
    return n.withColumn("oov", 100 * (F.col("pairs") - F.col("known")) / F.col("pairs"))


def hits_at(ranks: DataFrame, ks: list[int]) -> DataFrame:
    return ranks.agg(*[F.avg((F.col("rank") <= k).cast("double")).alias(f"hits_at_{k}") for k in ks])


def spearman(rows: DataFrame, x: str, y: str) -> DataFrame:
    """(spearman): correlation of average ranks times 100; ties share the mean of their places.

    Ranks come from counts per distinct value, so only distinct values are put in one order.
    """
    def averaged(col: str, name: str) -> DataFrame:
        values = rows.groupBy(F.col(col).alias(f"_{name}")).count()
        before = F.coalesce(F.sum("count").over(Window.orderBy(f"_{name}").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        return values.select(f"_{name}", (before + (F.col("count") + 1) / 2).alias(name))

    rx, ry = averaged(x, "rx"), averaged(y, "ry")
    both = rows.join(rx, rows[x] == rx["_rx"]).join(ry, rows[y] == ry["_ry"])
    return both.agg((100 * F.corr("rx", "ry")).alias("spearman"))


def cross_entropy(scores: DataFrame, truth: DataFrame) -> DataFrame:
    """(loss): mean binary cross-entropy of probability scores over the scored (doc_id, label) pairs."""
    y = scores.join(truth.select("doc_id", "label").distinct().withColumn("y", F.lit(1)), ["doc_id", "label"], "left")
    p = F.greatest(F.least(F.col("score"), F.lit(1 - 1e-12)), F.lit(1e-12))
    return y.agg(F.avg(F.when(F.col("y") == 1, -F.log(p)).otherwise(-F.log(1 - p))).alias("loss"))


def section_accuracy(answers: DataFrame, semantic: list[str]) -> DataFrame:
    """(section, right, asked, accuracy) of each section and of 'semantic', 'syntactic' and 'total'.

    answers: section, right (0/1, null for a question with unknown words, which is not asked).
    """
    kind = F.when(F.col("section").isin(semantic), "semantic").otherwise("syntactic")
    known = answers.where("right is not null")
    rows = known.select(F.explode(F.array(F.col("section"), kind, F.lit("total"))).alias("section"), "right")
    return rows.groupBy("section").agg(F.sum("right").alias("right"), F.count("*").alias("asked")).withColumn("accuracy", F.col("right") / F.col("asked"))


def stop_round(costs: DataFrame, patience: int) -> DataFrame:
    """Rounds(round, cost) with stop: the cost exceeds the mean of the `patience` costs before it."""
    w = Window.orderBy("round")
    before = F.avg("cost").over(w.rowsBetween(-patience, -1))
    return costs.select("round", "cost", F.coalesce((F.row_number().over(w) > patience) & (F.col("cost") > before), F.lit(False)).alias("stop"))


def best_round(metric: DataFrame, patience: int) -> DataFrame:
    """Rounds(round, value) with best so far, rounds since the last gain, and stop after `patience` rounds without one."""
    w = Window.orderBy("round")
    best = F.max("value").over(w.rowsBetween(Window.unboundedPreceding, -1))
    gains = metric.withColumn("gain", best.isNull() | (F.col("value") > best))
    last = F.max(F.when(F.col("gain"), F.col("round"))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return gains.select("round", "value", F.max("value").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("best"), (F.col("round") - last).alias("since"), (F.col("round") - last >= patience).alias("stop"))
