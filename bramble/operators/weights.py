"""Label weights from label frequencies, as column functions of n (rows of the label) and total (documents)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def uniform_weight() -> Column:
    return F.lit(1.0)


def propensity_weight(n: Column, total: Column, a: float = 0.55, b: float = 1.5) -> Column:
    """1 / propensity: 1 + C (n + b)^-a with C = (ln total - 1)(b + 1)^a."""
    c = (F.log(total.cast("double")) - 1) * F.pow(F.lit(b + 1), F.lit(a))
    return 1 + c * F.pow(n + b, F.lit(-a))


def negative_log_weight(n: Column, total: Column, a: float = 1.0, b: float = 1.0) -> Column:
    return F.when(n > 0, a * F.log(total / n) + b).otherwise(0.0)


def log_exp_weight(n: Column, a: float = 1.0, b: float = 1.0) -> Column:
    return F.when(n > 0, a * F.pow(F.log1p(n.cast("double")), F.lit(-b))).otherwise(0.0)


def label_weights(doc_labels: DataFrame, kind: str = "propensity") -> DataFrame:
    """(label, weight)."""
    n = doc_labels.groupBy("label").agg(F.count("*").alias("n"))
    total = doc_labels.agg(F.count_distinct("doc_id").alias("total"))
    both = n.crossJoin(F.broadcast(total))
    weight = {"uniform": uniform_weight(), "propensity": propensity_weight(F.col("n"), F.col("total")), "negative_log": negative_log_weight(F.col("n"), F.col("total")), "log_exp": log_exp_weight(F.col("n"))}[kind]
    return both.select("label", weight.alias("weight"))


def class_costs(labels: DataFrame, weights: DataFrame, cost: float = 1.0) -> DataFrame:
    """(label, cost): the base cost times a label's weight, 1 where none is given."""
    return labels.join(weights, "label", "left").select("label", (F.coalesce("weight", F.lit(1.0)) * cost).alias("cost"))
