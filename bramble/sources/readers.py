"""Readers of the usual multi-label text formats, each into long tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bramble.functions import text as X
from bramble.operators import labels as L

TAGGED = T.StructType([T.StructField("title", T.StringType()), T.StructField("tags", T.ArrayType(T.StringType()))])
SCORED = T.StructType([*TAGGED.fields, T.StructField("predict", T.ArrayType(T.StructType([T.StructField("label", T.StringType()), T.StructField("score", T.DoubleType())])))])
MATCH = "array<struct<cpe23Uri:string>>"
LANDED = f"struct<result:struct<CVE_Items:array<struct<configurations:struct<nodes:array<struct<cpe_match:{MATCH},children:array<struct<cpe_match:{MATCH}>>>>>>>>>"


def label_matrix(spark: SparkSession, path: str, id_col: str, not_labels: list[str]) -> DataFrame:
    """(doc_id, label) of a CSV with one 0/1 column per label; columns are known from its header only."""
    return L.from_matrix(spark.read.csv(path, header=True), id_col, not_labels)


def label_lists(spark: SparkSession, path: str, id_col: str = "doc_id", labels_col: str = "labels") -> DataFrame:
    """(doc_id, label) of a CSV of ids and comma lists."""
    rows = spark.read.schema(f"{id_col} string, {labels_col} string").csv(path, header=True)
    return rows.select(F.col(id_col).alias("doc_id"), F.explode(F.split(labels_col, ",")).alias("label")).select("doc_id", F.trim("label").alias("label")).where("label <> ''")


def tagged_json(spark: SparkSession, path: str) -> DataFrame:
    """(title, tags) of JSON lines."""
    return spark.read.schema(TAGGED).json(path)


def numbered_lines(spark: SparkSession, path: str, per_unit: bool = False) -> DataFrame:
    """(line, value): lines of a text folder with their number from 0, in file and line order; with per_unit (unit, line,
    value), numbered in each unit: a file, or the files of one partition folder `key=value`.

    Files are ordered by the number of a part file, then by path; a file's splits by where they begin; lines of a split as
    they are read. Spark deals splits to tasks by size, so tasks do not follow that order: the lines are written out once
    with their split, and each split's offset is the number of lines in the splits before it. It is the only positional
    reader; everything else joins on keys.
    """
    from bramble.plans.shared import stage

    rows = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("begin"), F.monotonically_increasing_id().alias("seen"))
    lines = stage(rows, "lines")
    folder = F.regexp_extract("file", r"^(.*/[^/=]+=[^/]*)/[^/]*$", 1)
    unit = F.when(folder != "", folder).otherwise(F.col("file")) if per_unit else F.lit("")
    splits = lines.groupBy("file", "begin").agg(F.count("*").alias("n"), F.min("seen").alias("first")).withColumn("unit", unit)
    part = F.regexp_extract("file", r"/part-(\d+)[^/]*$", 1).try_cast("long")
    upto = Window.partitionBy("unit").orderBy(part, "file", "begin").rowsBetween(Window.unboundedPreceding, -1)
    places = splits.select("file", "begin", "unit", (F.coalesce(F.sum("n").over(upto), F.lit(0)) - F.col("first")).alias("offset"))
    numbered = lines.join(places, ["file", "begin"]).withColumn("line", F.col("offset") + F.col("seen"))
    return numbered.select(*(["unit"] if per_unit else []), "line", "value")


def sparse_pairs(tokens: Column) -> Column:
    """array<struct<feature, value>> of 'f:v' tokens."""
    return F.transform(F.filter(tokens, lambda t: t.contains(":")), lambda t: F.struct(F.split_part(t, F.lit(":"), F.lit(1)).cast("long").alias("feature"), F.split_part(t, F.lit(":"), F.lit(2)).cast("double").alias("value")))


def sparse_text(spark: SparkSession, path: str, header: bool = False) -> DataFrame:
    """(line, labels, features, ascending) of 'l1,l2 f:v f:v' rows; a row may have no labels (leading space) or no features.

    With header=True the first row, of three counts, is left out and no other. ascending tells whether feature numbers
    grow strictly from 1, as the header-less form demands.
    """
    rows = numbered_lines(spark, path)
    if header:
        rows = rows.where("line > 0").withColumn("line", F.col("line") - 1)
    first = F.regexp_extract("value", r"^([^ :]*)(?: |$)", 1)
    labels = F.filter(F.split(first, ","), lambda x: x != "")
    features = sparse_pairs(F.split("value", " +"))
    out = rows.select("line", labels.alias("labels"), features.alias("features"))
    numbers = F.col("features.feature")
    rising = F.forall(F.transform(numbers, lambda x, i: F.when(i == 0, x >= 1).otherwise(x > F.get(numbers, i - 1))), lambda ok: ok)
    return out.withColumn("ascending", F.coalesce(rising, F.lit(True)))


def checked(rows: DataFrame) -> DataFrame:
    """The rows of sparse_text; fails when it meets one whose feature numbers do not ascend."""
    return rows.where(F.when(F.col("ascending"), F.lit(True)).otherwise(F.raise_error(F.lit("feature numbers do not ascend")).cast("boolean")))


def feature_maps(spark: SparkSession, path: str) -> DataFrame:
    """(line, features map) of 'idx:value ...' rows."""
    rows = numbered_lines(spark, path)
    return rows.select("line", F.map_from_entries(sparse_pairs(F.split("value", " +"))).alias("features"))


def label_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, labels, words, weight, tags) of lines with typed tokens."""
    return numbered_lines(spark, path).select("line", X.parse_label_line(F.col("value")).alias("p")).select("line", "p.*")


def tsv(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, labels, text) of id, space-separated labels and text."""
    rows = spark.read.schema("doc_id string, labels string, text string").option("sep", "\t").option("quote", "").csv(path)
    return rows.select("doc_id", F.filter(F.split("labels", " "), lambda x: x != "").alias("labels"), "text")


def aligned_files(spark: SparkSession, texts: str, labels: str, part: str) -> DataFrame:
    """(line, text, labels, part) of two files aligned by line number."""
    t = numbered_lines(spark, texts).select("line", F.col("value").alias("text"))
    l = numbered_lines(spark, labels).select("line", F.filter(F.split("value", " "), lambda x: x != "").alias("labels"))
    return t.join(l, "line").withColumn("part", F.lit(part))


def score_files(spark: SparkSession, path: str) -> DataFrame:
    """(batch, line, label, score) of 'label:score ...' files, one file, or one folder `batch=...`, for each label batch.

    Line numbers run inside each batch; batch is the last part of the file's or folder's path.
    """
    rows = numbered_lines(spark, path, per_unit=True).withColumn("batch", F.regexp_extract("unit", r"([^/]*)$", 1))
    pairs = rows.select("batch", "line", F.explode(F.split(F.trim("value"), " +")).alias("t")).where("t <> ''")
    return pairs.select("batch", "line", F.split_part("t", F.lit(":"), F.lit(1)).cast("int").alias("label"), F.split_part("t", F.lit(":"), F.lit(2)).cast("double").alias("score"))


def label_rows(spark: SparkSession, path: str, separator: str) -> DataFrame:
    """(line, rank, label) of rows of labels: comma-separated truth or space-separated predictions."""
    rows = numbered_lines(spark, path)
    return rows.select("line", F.posexplode(F.filter(F.split(F.trim("value"), f"{separator}"), lambda x: F.trim(x) != "")).alias("p", "label")).select("line", (F.col("p") + 1).alias("rank"), F.trim("label").cast("int").alias("label"))


def word_vectors(spark: SparkSession, path: str) -> DataFrame:
    """(word, vector) of 'n dim' and 'word v1 ... vd' rows: the first row of a word, vectors of length 0 left out."""
    rows = numbered_lines(spark, path).where("line > 0").select("line", F.split(F.trim("value"), " ").alias("t"))
    v = rows.select("line", F.col("t")[0].alias("word"), F.transform(F.slice("t", F.lit(2), F.greatest(F.size("t") - 1, F.lit(0))), lambda x: x.try_cast("double")).alias("vector"))
    sound = v.where(F.exists("vector", lambda x: x != 0) & ~F.exists("vector", lambda x: x.isNull()))
    return sound.groupBy("word").agg(F.min_by("vector", "line").alias("vector"))


def tree_edges(spark: SparkSession, path: str) -> DataFrame:
    """(parent, child, label) of 'parent child [label]' rows."""
    t = F.split(F.trim("value"), " +")
    return spark.read.text(path).where("trim(value) <> ''").select(t[0].alias("parent"), t[1].alias("child"), F.get(t, F.lit(2)).alias("label"))


def label_mapping(spark: SparkSession, path: str) -> DataFrame:
    """(old, new) of 'old new' rows."""
    return spark.read.schema("old int, new int").option("sep", " ").csv(path)


def analogy_questions(spark: SparkSession, path: str) -> DataFrame:
    """(line, section, a, b, c, d): a ': name' row opens a section. Sections are joined to the rows between their headers."""
    rows = numbered_lines(spark, path)
    headers = rows.where(F.col("value").startswith(":")).select("line", F.trim(F.expr("substring(value, 2)")).alias("section"))
    until = F.lead("line", 1, 1 << 62).over(Window.orderBy("line"))
    spans = headers.select("section", F.col("line").alias("low"), until.alias("high"))
    w = F.split(F.trim("value"), " +")
    q = rows.where(~F.col("value").startswith(":")).select("line", *[w[i].alias(c) for i, c in enumerate("abcd")])
    return q.join(F.broadcast(spans), (F.col("line") > F.col("low")) & (F.col("line") < F.col("high"))).select("line", "section", "a", "b", "c", "d")


def similarity_pairs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("w1 string, w2 string, gold double").option("sep", " ").csv(path)


def landed_identifiers(docs: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """(id, identifier) of landed JSON: matches of the top nodes and of their children, of the first item."""
    parsed = docs.select(id_col, F.from_json(json_col, LANDED).alias("j"))
    nodes = F.col("j.result.CVE_Items")[0]["configurations"]["nodes"]
    found = F.flatten(F.transform(nodes, lambda n: F.concat(F.coalesce(n["cpe_match"], F.array().cast(MATCH)), F.coalesce(F.flatten(F.transform(n["children"], lambda c: c["cpe_match"])), F.array().cast(MATCH)))))
    return parsed.select(id_col, F.explode(found).alias("m")).select(id_col, F.col("m.cpe23Uri").alias("identifier"))
