"""Deterministic splits: by label, by size and in folds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bramble.functions.hashing import hash32


def by_label(doc_labels: DataFrame, every: int = 4, seed: int = 42) -> DataFrame:
    """(doc_id, label, is_test): a document belongs to its rarest label, and of each label's documents, in hashed order,
    every `every`-th is a test document: each label's share of test documents is within one document of the target.

    A label may own most documents, so places inside a label are taken in buckets of the hash, whose counts give offsets.
    """
    n = doc_labels.groupBy("label").agg(F.count("*").alias("n"))
    owner = doc_labels.join(n, "label").groupBy("doc_id").agg(F.min_by("label", F.struct("n", "label")).alias("label"))
    hashed = owner.withColumn("h", hash32(seed, "doc_id")).withColumn("bucket", F.shiftright("h", 22))
    sizes = hashed.groupBy("label", "bucket").count()
    before = F.coalesce(F.sum("count").over(Window.partitionBy("label").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("label", "bucket", before.alias("before"))
    place = F.row_number().over(Window.partitionBy("label", "bucket").orderBy("h", "doc_id"))
    return hashed.withColumn("r", place).join(offsets, ["label", "bucket"]).select("doc_id", "label", ((F.col("before") + F.col("r")) % every == 0).alias("is_test"))


def fixed_size(docs: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """(doc_id, is_validation): the n first documents in hashed order."""
    ordered = docs.select("doc_id").orderBy(hash32(seed, "doc_id"), "doc_id").limit(n).withColumn("is_validation", F.lit(True))
    return docs.select("doc_id").join(ordered, "doc_id", "left").select("doc_id", F.coalesce("is_validation", F.lit(False)).alias("is_validation"))


def folds(docs: DataFrame, k: int, seed: int = 42) -> DataFrame:
    """(doc_id, fold): the documents in the order of a hash, in k runs whose sizes differ by one at most, the longer runs
    first; places come from a range sort, not from a one-task window."""
    from bramble.operators.labels import _numbered

    rows = _numbered(docs.select("doc_id", hash32(seed, "doc_id").alias("_h")), ["_h", "doc_id"], "_place")
    n = rows.count()
    size, longer = n // k, n % k
    early = F.expr(f"_place div {size + 1}")
    late = F.lit(longer) + F.expr(f"(_place - {longer * (size + 1)}) div {max(size, 1)}")
    return rows.select("doc_id", F.when(F.col("_place") < longer * (size + 1), early).otherwise(late).cast("int").alias("fold"))


def per_tree_sample(docs: DataFrame, trees: int, fraction: float, seed: int = 42) -> DataFrame:
    """(tree, doc_id): a fresh hashed sample for every tree."""
    from bramble.functions.hashing import uniform

    return docs.select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree")).where(uniform(seed, "tree", "doc_id") < fraction).select("tree", "doc_id")


def per_tree_count(docs: DataFrame, trees: int, n: int, seed: int = 42) -> DataFrame:
    """(tree, doc_id): for every tree the n first documents in its own hashed order."""
    out = None
    for tree in range(trees):
        one = docs.select(F.lit(tree).alias("tree"), "doc_id").orderBy(hash32(seed, F.lit(tree), "doc_id"), "doc_id").limit(n)
        out = one if out is None else out.unionByName(one)
    return out


def last_share(docs: DataFrame, share: float = 0.1, order: str = "doc_id") -> DataFrame:
    """(doc_id, is_validation): the last share of the documents in their order, by dense numbers of a range sort."""
    from bramble.operators.labels import _numbered

    n = docs.count()
    rows = _numbered(docs.select("doc_id", F.col(order).alias("_order")), ["_order", "doc_id"], "_place")
    return rows.select("doc_id", (F.col("_place") >= n - int(n * share)).alias("is_validation"))


def bagged(docs: DataFrame, members: int, ratio: float, seed: int = 42, content: str = "doc_id") -> DataFrame:
    """(member, doc_id): a member trains on the documents whose hash, of the id or of a column of their content, falls below
    the ratio; rows of equal content share their members."""
    from bramble.functions.hashing import uniform

    rows = docs.select("doc_id", F.col(content).alias("_content"), F.explode(F.sequence(F.lit(0), F.lit(members - 1))).alias("member"))
    return rows.where(uniform(seed, "member", "_content") < ratio).select("member", "doc_id")


def shuffled(docs: DataFrame, seed: int = 42) -> DataFrame:
    """All rows in a seeded order."""
    return docs.orderBy(hash32(seed, "doc_id"), "doc_id")
