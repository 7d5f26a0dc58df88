"""Top-k labels, merges of label batches and ensembles over scores(doc_id, label, score)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bramble.functions.scores import sigmoid


def top_k(scores: DataFrame, k: int, by: str | list[str] = "doc_id", score: str = "score", tie: str = "label") -> DataFrame:
    """The k best rows of each group with their rank. Spark turns the filter on the rank into a partial top-k before the
    shuffle, so no group is sorted whole."""
    keys = [by] if isinstance(by, str) else by
    ranked = scores.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(score), tie)))
    return ranked.where(F.col("rank") <= k)


def merge_batches(batches: list[DataFrame], k: int) -> DataFrame:
    """Global top-k of label batches that were scored apart: each batch's own top-k, then the best of all."""
    best = [top_k(b.select("doc_id", "label", "score"), k).drop("rank") for b in batches]
    out = best[0]
    for more in best[1:]:
        out = out.unionByName(more)
    return top_k(out, k)


def merge_numbered_batches(scores: DataFrame, k: int, batch: str = "batch") -> DataFrame:
    """As merge_batches, of any number of label batches that a column tells apart."""
    best = top_k(scores.select("doc_id", "label", "score", batch), k, by=["doc_id", batch])
    return top_k(best.drop("rank", batch), k)


def sum_ensemble(members: list[DataFrame], k: int, logits: bool = False) -> DataFrame:
    """Sum of the members' scores (through a sigmoid if they are logits) and the top-k of the sum."""
    rows = members[0].select("doc_id", "label", "score")
    for more in members[1:]:
        rows = rows.unionByName(more.select("doc_id", "label", "score"))
    score = sigmoid(F.col("score")) if logits else F.col("score")
    summed = rows.groupBy("doc_id", "label").agg(F.round(F.sum(score), 9).alias("score"))
    return top_k(summed, k)


def mean_ensemble(members: list[DataFrame], k: int) -> DataFrame:
    """Union of the members' labels; a member without the label gives 0; averages are ranked anew."""
    rows = members[0].select("doc_id", "label", "score")
    for more in members[1:]:
        rows = rows.unionByName(more.select("doc_id", "label", "score"))
    mean = rows.groupBy("doc_id", "label").agg(F.round(F.sum("score") / len(members), 9).alias("score"))
    return top_k(mean, k)


def shared_ensemble(own: DataFrame, shared: DataFrame, k: int, members: int | None = None, logits: bool = False) -> DataFrame:
    """(doc_id, label, score, rank): as sum_ensemble (mean_ensemble, where members is given) of own(doc_id, label, score) and
    a member whose scores(label, score) are the same for every document.

    The shared list is ranked once: beside its own labels, a document can only need as many of the shared ones, best
    first, as k and its own labels together. Documents are those of own.
    """
    from bramble.operators.labels import _numbered

    value = sigmoid(F.col("score")) if logits else F.col("score")
    mine = own.select("doc_id", "label", value.alias("a"))
    ranked = _numbered(shared.select("label", value.alias("b")), [F.desc("b"), "label"], "place")
    need = mine.groupBy("doc_id").agg(F.count("*").alias("m"))
    asked = need.select("doc_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") + (k - 1))).alias("place")).join(ranked, "place").select("doc_id", "label", "b")
    others = asked.join(mine, ["doc_id", "label"], "left_anti").select("doc_id", "label", F.col("b").alias("score"))
    ours = mine.join(ranked.select("label", "b"), "label", "left").select("doc_id", "label", (F.col("a") + F.coalesce("b", F.lit(0.0))).alias("score"))
    total = F.col("score") if members is None else F.col("score") / members
    return top_k(ours.unionByName(others).select("doc_id", "label", F.round(total, 9).alias("score")), k)


def over(scores: DataFrame, threshold: float) -> DataFrame:
    return scores.where(F.col("score") >= threshold)


def group_candidates(group_scores: DataFrame, label_scores: DataFrame, groups: int, labels: int) -> DataFrame:
    """Two-stage candidates: the best groups of a document, then P(group) * P(label) over their labels, best first."""
    best = top_k(group_scores, groups, score="group_score", tie="group").select("doc_id", "group", "group_score")
    both = best.join(label_scores, ["doc_id", "group"]).withColumn("score", F.round(F.col("group_score") * F.col("score"), 9))
    return top_k(both.select("doc_id", "label", "score"), labels)


def of_labels(scores: DataFrame, asked: DataFrame) -> DataFrame:
    """Scores of the asked (doc_id, label) only."""
    return scores.join(asked, ["doc_id", "label"], "left_semi")


def packed(predictions: DataFrame, limit: int | None = None) -> DataFrame:
    """(doc_id, predict): an array of (label, score), best first, cut to a limit. A document has at most k rows here."""
    rows = predictions.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("rank", "label", "score"))).alias("p"))
    arrays = F.transform("p", lambda x: F.struct(x["label"].alias("label"), x["score"].alias("score")))
    return rows.select("doc_id", (F.slice(arrays, 1, limit) if limit else arrays).alias("predict"))


def score_map(predict: Column) -> Column:
    return F.map_from_entries(predict)
