"""The tables of the registered queries as labelled corpora, in Spark and as SQL common table expressions.

Documents are orders (labels: the brands of their parts; features: part type and size by quantity; key: the priority) or
text documents (labels: language, source, quality and toxicity).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SQL = {
    "order_labels": "SELECT DISTINCT l_orderkey AS doc_id, p_brand AS label FROM lineitem JOIN part ON l_partkey = p_partkey",
    "order_features": "SELECT l_orderkey AS doc_id, p_type || '|' || p_size AS feature, sum(l_quantity) AS value FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL",
    "order_keys": "SELECT o_orderkey AS doc_id, o_orderpriority AS key FROM orders",
    "text_labels": """SELECT doc_id, 'lang:' || lang AS label FROM documents WHERE lang IS NOT NULL
        UNION ALL SELECT doc_id, 'src:' || source FROM documents WHERE source IS NOT NULL
        UNION ALL SELECT doc_id, 'q:' || quality FROM labels WHERE quality IS NOT NULL
        UNION ALL SELECT doc_id, 'tox:' || toxic FROM labels WHERE toxic IS NOT NULL""",
    "tokens": r"""SELECT doc_id, i - 1 AS pos, w[i] AS token FROM (
        SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM (
        SELECT doc_id, list_filter(regexp_split_to_array(replace(lower(text), ',', ''), '\s+'), lambda x: x <> '') AS w FROM documents))""",
    "label_counts": "SELECT label, count(*) AS n FROM order_labels GROUP BY label",
    "key_counts": "SELECT key, label, count(*) AS n FROM order_keys JOIN order_labels USING (doc_id) GROUP BY key, label",
    "scores": """SELECT doc_id, label, round(n / sum(n) OVER (PARTITION BY doc_id), 9) AS score,
        CAST(floor((dense_rank() OVER (ORDER BY label) - 1) / 10) AS INTEGER) AS batch FROM order_keys JOIN key_counts USING (key)""",
    "top5": "SELECT * FROM (SELECT doc_id, label, score, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, label) AS rank FROM scores) WHERE rank <= 5",
    "hits": """SELECT t.doc_id, rank, t.label, t.score, CASE WHEN o.label IS NULL THEN 0 ELSE 1 END AS hit, n_truth
        FROM top5 t JOIN (SELECT doc_id, count(*) AS n_truth FROM order_labels GROUP BY doc_id) USING (doc_id)
        LEFT JOIN order_labels o ON o.doc_id = t.doc_id AND o.label = t.label""",
    "triples": """SELECT 'c' || c_custkey AS h, 'nation' AS r, 'n' || c_nationkey AS t FROM customer
        UNION ALL SELECT 's' || s_suppkey, 'nation', 'n' || s_nationkey FROM supplier
        UNION ALL SELECT 'n' || n_nationkey, 'region', 'r' || n_regionkey FROM nation""",
    "test_docs": "SELECT doc_id, ('0x' || substr(md5('42|' || doc_id), 1, 8))::BIGINT % 4 = 0 AS is_test FROM (SELECT DISTINCT doc_id FROM order_labels)",
}
_NEEDS = {"label_counts": ["order_labels"], "key_counts": ["order_keys", "order_labels"], "scores": ["key_counts"], "top5": ["scores"], "hits": ["top5", "order_labels"], "test_docs": ["order_labels"]}


def with_views(body: str, *names: str, recursive: bool = False, once: bool = False) -> str:
    """SQL that defines the named views, and those they need, before the body (more common tables may lead the body).
    once: views are computed once each."""
    order: list[str] = []

    def add(name: str) -> None:
        for need in _NEEDS.get(name, []):
            add(need)
        if name not in order:
            order.append(name)

    for n in names:
        add(n)
    ctes = ", ".join(f"{n} AS {'MATERIALIZED ' * once}({SQL[n]})" for n in order)
    head = "WITH RECURSIVE " if recursive else "WITH "
    body = body.strip()
    if not ctes:
        return body
    return head + ctes + (", " + body[5:].strip() if body.upper().startswith("WITH ") else " " + body)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


#: Order lines that a task takes, about; parts up to which Spark may send them to all tasks.
TASK_LINES, FEW_PARTS = 500_000, 100_000


def spread(spark: SparkSession, sf_dir: str, rows: DataFrame, key: str) -> DataFrame:
    """rows by key, in as many parts as the order lines need, where they are more than Spark's own number of parts can hold:
    so a task's rows do not grow with the tables. Rows spread by the same key stand together for any later step by it."""
    parts = -(-table(spark, sf_dir, "lineitem").count() // TASK_LINES)
    return rows if parts <= int(spark.conf.get("spark.sql.shuffle.partitions")) else rows.repartition(parts, key)


def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, parts = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    if parts.count() > FEW_PARTS:
        lines = spread(spark, sf_dir, lines, "l_partkey")
    return lines.join(parts, F.col("l_partkey") == F.col("p_partkey"))


def order_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = order_lines(spark, sf_dir).select(F.col("l_orderkey").alias("doc_id"), F.col("p_brand").alias("label"))
    return spread(spark, sf_dir, rows, "doc_id").distinct()


def order_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    feature = F.concat_ws("|", "p_type", F.col("p_size").cast("string"))
    rows = order_lines(spark, sf_dir).select(F.col("l_orderkey").alias("doc_id"), feature.alias("feature"), F.col("l_quantity").alias("value"))
    return spread(spark, sf_dir, rows, "doc_id").groupBy("doc_id", "feature").agg(F.sum("value").alias("value"))


def order_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.col("o_orderpriority").alias("key"))


def text_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, l = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    parts = [d.where("lang is not null").select("doc_id", F.concat(F.lit("lang:"), "lang").alias("label")), d.where("source is not null").select("doc_id", F.concat(F.lit("src:"), "source").alias("label")), l.where("quality is not null").select("doc_id", F.concat(F.lit("q:"), F.col("quality").cast("string")).alias("label")), l.where("toxic is not null").select("doc_id", F.concat(F.lit("tox:"), F.col("toxic").cast("string")).alias("label"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    from bramble.functions.text import words

    return documents(spark, sf_dir).select("doc_id", F.posexplode(words(F.col("text"))).alias("pos", "token"))


def key_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from bramble.operators.matcher import train

    return train(order_keys(spark, sf_dir), order_labels(spark, sf_dir))


def key_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(key, label, score): the frequency of a label given a key."""
    model = key_counts(spark, sf_dir)
    total = model.groupBy("key").agg(F.sum("n").alias("total"))
    return model.join(total, "key").select("key", "label", F.round(F.col("n") / F.col("total"), 9).alias("score"))


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, label, score): the frequency of a label given the document's key."""
    return order_keys(spark, sf_dir).join(key_scores(spark, sf_dir), "key").select("doc_id", "label", "score")


def batched_key_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id = key, label, score, batch): key_scores with labels in batches of ten by label order."""
    from bramble.operators.labels import index_labels

    share = key_scores(spark, sf_dir)
    ids = index_labels(share, "sorted").select("label", F.expr("cast(label_id div 10 as int)").alias("batch"))
    return share.join(ids, "label").select(F.col("key").alias("doc_id"), "label", "score", "batch")


def batched_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, label, score, batch): scores with labels in batches of ten by label order."""
    rows = batched_key_scores(spark, sf_dir).withColumnRenamed("doc_id", "key")
    return order_keys(spark, sf_dir).join(rows, "key").select("doc_id", "label", "score", "batch")


def top5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best labels of each order. They depend on the key alone, so each key is ranked once."""
    from bramble.operators.topk import top_k
    from bramble.plans.shared import stage

    # staged, so that Spark knows how few they are
    best = stage(top_k(key_scores(spark, sf_dir), 5, by="key"), "best")
    return spread(spark, sf_dir, order_keys(spark, sf_dir), "doc_id").join(best, "key").select("doc_id", "label", "score", "rank")


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    from bramble.operators.metrics import hits as make

    return make(top5(spark, sf_dir), order_labels(spark, sf_dir))


def triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, s, n = (table(spark, sf_dir, t) for t in ("customer", "supplier", "nation"))
    row = lambda df, hp, h, r, tp, t: df.select(F.concat(F.lit(hp), F.col(h).cast("string")).alias("h"), F.lit(r).alias("r"), F.concat(F.lit(tp), F.col(t).cast("string")).alias("t"))
    return row(c, "c", "c_custkey", "nation", "n", "c_nationkey").unionByName(row(s, "s", "s_suppkey", "nation", "n", "s_nationkey")).unionByName(row(n, "n", "n_nationkey", "region", "r", "n_regionkey"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")
