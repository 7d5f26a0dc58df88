"""Writers of the usual multi-label text formats; each returns nothing and writes one folder of part files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bramble.functions import text as X


def label_matrix(doc_labels: DataFrame, path: str) -> None:
    """CSV with one 0/1 column per label; for label sets that fit a header."""
    wide = doc_labels.groupBy("doc_id").pivot("label").agg(F.lit(1)).na.fill(0)
    wide.write.csv(path, header=True)


def label_lists(doc_labels: DataFrame, path: str) -> None:
    lists = doc_labels.groupBy("doc_id").agg(F.array_join(F.sort_array(F.collect_list("label")), ",").alias("labels"))
    lists.select(F.col("doc_id").cast("string"), "labels").write.csv(path, header=True)


def tagged_json(docs: DataFrame, path: str) -> None:
    """JSON lines of (title, tags)."""
    docs.select(F.to_json(F.struct("title", "tags")).alias("value")).write.text(path)


def sparse_lines(rows: DataFrame) -> DataFrame:
    """(doc_id, value): 'l1,l2 f:v f:v' of rows(doc_id, labels array, features array<struct<feature, value>>), by feature."""
    pairs = F.transform(F.array_sort("features"), lambda x: F.concat(x["feature"].cast("string"), F.lit(":"), X.number(x["value"])))
    return rows.select("doc_id", F.concat(F.array_join("labels", ","), F.lit(" "), F.array_join(pairs, " ")).alias("value"))


def sparse_text(rows: DataFrame, path: str, features: int, labels: int, header: bool = True) -> None:
    """One file in document order with a header 'rows features labels', or a folder of parts without."""
    lines = sparse_lines(rows)
    if not header:
        lines.sortWithinPartitions("doc_id").select("value").write.text(path)
        return
    head = rows.agg(F.concat_ws(" ", F.count("*").cast("string"), F.lit(str(features)), F.lit(str(labels))).alias("value")).withColumn("doc_id", F.lit(None).cast("long"))
    whole = head.select("doc_id", "value").unionByName(lines.select(F.col("doc_id").cast("long"), "value"))
    # a range sort writes parts in order; the header, whose key is null, is the first row of the first part
    whole.orderBy(F.col("doc_id").asc_nulls_first()).select("value").write.text(path)


def text_and_labels(docs: DataFrame, texts: str, labels: str) -> None:
    """Aligned files of docs(doc_id, text, labels): same order in both, spaces in labels become underscores.

    The order is settled once, as a number of each row, so that both files have it even where ids repeat.
    """
    from bramble.operators.labels import _numbered
    from bramble.plans.shared import stage

    lines = docs.select("doc_id", F.regexp_replace("text", r"\s+", " ").alias("text"), F.array_join(F.transform("labels", lambda x: F.replace(x, F.lit(" "), F.lit("_"))), " ").alias("l"))
    ordered = stage(_numbered(lines, ["doc_id", "text", "l"], "place"), "aligned").orderBy("place")
    ordered.select("text").write.text(texts)
    ordered.select("l").write.text(labels)


def label_lines(docs: DataFrame, path: str, prefix: str = X.LABEL_PREFIX) -> None:
    docs.select(X.label_line(F.col("labels"), F.regexp_replace("text", r"\s+", " "), prefix).alias("value")).write.text(path)


def tsv(docs: DataFrame, path: str) -> None:
    docs.select(F.concat_ws("\t", F.col("doc_id").cast("string"), F.array_join("labels", " "), F.regexp_replace("text", r"\s+", " ")).alias("value")).write.text(path)


def records(docs: DataFrame, path: str) -> None:
    """Parquet of {text, catgy: [int]}."""
    docs.select("text", F.col("label_ids").cast("array<int>").alias("catgy")).write.parquet(path)


def identical_pairs(pairs: DataFrame, path: str) -> None:
    pairs.select(F.concat_ws(" == ", "a", "b").alias("value")).write.text(path)


def predictions(predicted: DataFrame, path: str, with_scores: bool = True) -> None:
    """'doc label score label score ...' rows, best first; one part file per task."""
    best = predicted.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("rank", "label", "score"))).alias("p"))
    cells = F.transform("p", lambda x: F.concat_ws(" ", x["label"], X.number(x["score"])) if with_scores else x["label"])
    best.select(F.concat_ws(" ", F.col("doc_id").cast("string"), F.array_join(cells, " ")).alias("value")).write.text(path)


def vectors(rows: DataFrame, path: str, key: str = "id") -> None:
    """'key v1 ... vd' rows."""
    rows.select(F.concat_ws(" ", F.col(key).cast("string"), F.array_join(F.transform("vector", lambda x: X.number(x)), " ")).alias("value")).write.text(path)


def vocabulary(rows: DataFrame, path: str) -> None:
    """'token count type' rows."""
    rows.select(F.concat_ws(" ", "token", F.col("n").cast("string"), "type").alias("value")).write.text(path)


def weights(rows: DataFrame, path: str) -> None:
    rows.select("label", "weight").write.parquet(path)


def memberships(leaves: DataFrame, distribution: DataFrame, path: str) -> None:
    """JSON lines: the clusters of each document in tree order; and, in a second folder, the rounded label shares of leaves."""
    leaves.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("tree", "node"))), lambda x: x["node"]).alias("clusters")).write.json(f"{path}/rows")
    distribution.groupBy("tree", "node").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("label", F.round("p", 3).alias("p"))))).alias("labels")).write.json(f"{path}/leaves")


def model(tables: dict[str, DataFrame], path: str, settings: dict) -> None:
    """The tables of a model, each partitioned by tree where it has one, and its settings as one JSON row."""
    for name, df in tables.items():
        writer = df.write.partitionBy("tree") if "tree" in df.columns else df.write
        writer.parquet(f"{path}/{name}")
    spark = next(iter(tables.values())).sparkSession
    import json

    spark.createDataFrame([(json.dumps(settings, sort_keys=True),)], "value string").coalesce(1).write.text(f"{path}/settings")


def label_id_dump(doc_labels: DataFrame, ids: DataFrame, path: str) -> None:
    rows = doc_labels.join(ids, "label").groupBy("doc_id").agg(F.sort_array(F.collect_list("label_id")).alias("actual_labels"))
    rows.select(F.to_json(F.struct("doc_id", "actual_labels")).alias("value")).write.text(path)
