"""Label tables: frequencies, filters, indexes and groups of labels that always occur together."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def from_matrix(wide: DataFrame, id_col: str, not_labels: list[str]) -> DataFrame:
    """(doc_id, label) of a wide 0/1 matrix whose label columns are known at run time only."""
    columns = [c for c in wide.columns if c != id_col and c not in not_labels]
    long = wide.unpivot([id_col], columns, "label", "value")
    return long.where(F.col("value").cast("double") == 1).select(F.col(id_col).alias("doc_id"), "label")


def counts(doc_labels: DataFrame) -> DataFrame:
    return doc_labels.groupBy("label").agg(F.count("*").alias("n"))


def frequent(doc_labels: DataFrame, least: int) -> DataFrame:
    """Rows whose label has at least `least` rows; documents left without labels disappear."""
    keep = counts(doc_labels).where(F.col("n") >= least).select("label")
    return doc_labels.join(keep, "label", "left_semi")


def unused(all_labels: DataFrame, doc_labels: DataFrame) -> DataFrame:
    """Labels of the universe that no row of this split has."""
    return all_labels.select("label").distinct().join(doc_labels, "label", "left_anti")


def thresholds(vocabulary: DataFrame, words: int, labels: int) -> DataFrame:
    """Vocabulary entries (token, n, type) with enough rows for their type."""
    return vocabulary.where(((F.col("type") == "word") & (F.col("n") >= words)) | ((F.col("type") == "label") & (F.col("n") >= labels)))


def _numbered(rows: DataFrame, order: list, name: str, start: int = 0) -> DataFrame:
    """Dense ids in an order without a one-task sort: a range sort, counts per partition, then offsets.

    The sorted rows are written out with their partition's number, so that numbers and offsets see the same partitions.
    """
    from bramble.plans.shared import stage

    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = stage(rows.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()), "numbered")
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    sizes = placed.groupBy("_part").count()
    offsets = sizes.select("_part", F.coalesce(F.sum("count").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return placed.withColumn("_row", inside).join(offsets, "_part").withColumn(name, F.col("_before") + F.col("_row") - 1 + start).drop("_part", "_row", "_before")


def index_labels(doc_labels: DataFrame, policy: str = "sorted", order_col: str = "doc_id", start: int = 0) -> DataFrame:
    """(label, label_id): ids by `sorted` label, by `frequency` (most rows first, then label) or `first_seen`.

    First seen is by (order_col, label): rows that share a place are taken in label order.
    """
    if policy == "sorted":
        return _numbered(doc_labels.select("label").distinct(), ["label"], "label_id", start)
    if policy == "frequency":
        return _numbered(counts(doc_labels), [F.desc("n"), "label"], "label_id", start).select("label", "label_id")
    if policy == "first_seen":
        first = doc_labels.groupBy("label").agg(F.min(order_col).alias("first"))
        return _numbered(first, ["first", "label"], "label_id", start).select("label", "label_id")
    raise ValueError(f"no such policy: {policy}")


def vocabulary_index(vocabulary: DataFrame) -> DataFrame:
    """(token, type, n, token_id): words before labels, most frequent first, then by token."""
    ranked = vocabulary.withColumn("_kind", (F.col("type") == "label").cast("int"))
    return _numbered(ranked, ["_kind", F.desc("n"), "token"], "token_id").select("token", "type", "n", "token_id")


def signatures(doc_labels: DataFrame) -> DataFrame:
    """(label, n, s1, s2): equal for two labels with the same documents, up to 128-bit hash collisions.

    Order-free sums are combined before the shuffle, so a label on a third of all documents is no hot group.
    """
    ids = doc_labels.select("label", "doc_id").distinct()
    h1, h2 = F.xxhash64("doc_id"), F.xxhash64("doc_id", F.lit(17))
    wrapped = F.sum(h1.cast("decimal(20,0)")).cast("decimal(38,0)")
    return ids.groupBy("label").agg(F.count("*").alias("n"), wrapped.alias("s1"), F.bit_xor(h2).alias("s2"))


def identical_pairs(doc_labels: DataFrame) -> DataFrame:
    """(a, b), a < b: labels with exactly the same documents, without comparing all pairs of labels."""
    s = signatures(doc_labels)
    l, r = s.alias("l"), s.alias("r")
    same = [F.col(f"l.{c}") == F.col(f"r.{c}") for c in ("n", "s1", "s2")]
    return l.join(r, [*same, F.col("l.label") < F.col("r.label")]).select(F.col("l.label").alias("a"), F.col("r.label").alias("b"))


def merge_identical(doc_labels: DataFrame, glue: str = ";") -> tuple[DataFrame, DataFrame]:
    """(label -> merged name, doc_labels under merged names): labels with the same documents become 'a;b;c'."""
    groups = signatures(doc_labels).groupBy("n", "s1", "s2").agg(F.sort_array(F.collect_list("label")).alias("members"))
    names = groups.select(F.explode("members").alias("label"), F.array_join("members", glue).alias("merged"))
    return names, doc_labels.join(names, "label").select("doc_id", F.col("merged").alias("label")).distinct()


def chosen_label(doc_labels: DataFrame, seed: int = 42) -> DataFrame:
    """One label per document, by seeded hash."""
    from bramble.functions.hashing import hash32

    return doc_labels.groupBy("doc_id").agg(F.min_by("label", F.struct(hash32(seed, "doc_id", "label"), "label")).alias("label"))


#: Parts of the documents that share a set, so that a set on most documents is no hot key.
SET_PARTS = 64


def of_sets(sets: DataFrame, rows_of: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Rows that depend on a document's set alone, for each document of sets(doc_id, set): they are made once a set and part,
    not once a document. rows_of gives rows(set, part, ...) for asked (set, part)."""
    from bramble.plans.shared import stage

    placed = stage(sets.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(SET_PARTS)).cast("int")), "sets")
    return placed.join(rows_of(placed.select("set", "part").distinct()), ["set", "part"]).drop("set", "part")


def expand_groups(doc_groups: DataFrame, members: DataFrame) -> DataFrame:
    """(doc_id, label): all labels of the groups of a document. Documents with the same groups are expanded together."""
    sets = doc_groups.groupBy("doc_id").agg(F.array_sort(F.collect_set("group")).alias("set"))
    labels = lambda asked: asked.withColumn("group", F.explode("set")).join(members, "group").select("set", "part", "label").distinct()
    return of_sets(sets, labels).select("doc_id", "label")


#: Labels of the pool that pads candidate lists, beyond the size of a list.
POOL = 4096


def fixed_candidates(candidates: DataFrame, all_labels: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """(doc_id, label, own): n labels per document: its candidates, thinned by seeded hash to n, then padded.

    Padding comes from one pool of n + POOL labels at most, in a rotation that begins at a place of the document's hash:
    only n places of it are read for a document, n + n of them holding enough labels that are not its own. Documents of
    fewer than n labels in all get what there is.
    """
    from bramble.functions.hashing import hash32

    own = candidates.select("doc_id", "label").distinct().withColumn("_r", F.row_number().over(Window.partitionBy("doc_id").orderBy(hash32(seed, "doc_id", "label"), "label"))).where(F.col("_r") <= n)
    packed = own.groupBy("doc_id").agg(F.collect_list("label").alias("mine"))
    pool = all_labels.select("label").distinct().orderBy(hash32(seed, "label"), "label").limit(n + POOL).agg(F.collect_list("label").alias("pool"))
    size = F.size("pool")
    begin = F.when(size > 0, (hash32(seed, "doc_id") % size).cast("int")).otherwise(0)
    turned = F.concat(F.slice("pool", begin + 1, size), F.slice("pool", F.lit(1), begin))
    # one row of bounded size goes to all documents
    lists = packed.crossJoin(F.broadcast(pool)).select("doc_id", "mine", F.slice(turned, F.lit(1), F.lit(2 * n)).alias("near"))
    pads = F.slice(F.filter("near", lambda x: ~F.array_contains("mine", x)), F.lit(1), F.lit(n) - F.size("mine"))
    rows = F.concat(F.transform("mine", lambda x: F.struct(x.alias("label"), F.lit(True).alias("own"))), F.transform(pads, lambda x: F.struct(x.alias("label"), F.lit(False).alias("own"))))
    return lists.select("doc_id", F.explode(rows).alias("e")).select("doc_id", "e.label", "e.own")
