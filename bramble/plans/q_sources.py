"""Registered queries over sources and sinks: tables are written in a format and read back from it."""

from __future__ import annotations

from pyspark.sql import functions as F

from bramble.functions.text import number
from bramble.operators import labels as L
from bramble.operators import vectors as V
from bramble.operators import weights as W
from bramble.plans import views as v
from bramble.plans.registry import query
from bramble.plans.shared import new_path
from bramble.plans.views import with_views
from bramble.sources import readers, writers

LISTS = "lists AS (SELECT doc_id, string_agg(label, ',' ORDER BY label) AS labels FROM order_labels GROUP BY doc_id)"


def _docs(s, d):
    """(doc_id, text, labels): documents with their language and source labels, in one line each."""
    labels = v.text_labels(s, d).groupBy("doc_id").agg(F.sort_array(F.collect_list("label")).alias("labels"))
    return v.documents(s, d).join(labels, "doc_id").select("doc_id", F.trim(F.regexp_replace("text", r"\s+", " ")).alias("text"), "labels").where("text <> ''")


DOCS = r"docs AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS text, labels FROM documents JOIN (SELECT doc_id, list(label ORDER BY label) AS labels FROM text_labels GROUP BY doc_id) USING (doc_id) WHERE trim(regexp_replace(text, '\s+', ' ', 'g')) <> '')"


@query("s01_label_matrix_csv", with_views("SELECT doc_id::VARCHAR AS doc_id, label FROM order_labels", "order_labels"))
def s01(s, d):
    path = new_path(s, "matrix")
    writers.label_matrix(v.order_labels(s, d), path)
    return readers.label_matrix(s, path, "doc_id", [])


@query("s02_label_lists_csv", with_views("SELECT doc_id::VARCHAR AS doc_id, label FROM order_labels", "order_labels"))
def s02(s, d):
    path = new_path(s, "lists")
    writers.label_lists(v.order_labels(s, d), path)
    return readers.label_lists(s, path)


@query("s03_tagged_json", with_views(f"WITH {DOCS} SELECT md5(text) AS title, array_to_string(labels, ',') AS tags FROM docs", "text_labels"))
def s03(s, d):
    path = new_path(s, "json")
    writers.tagged_json(_docs(s, d).select(F.col("text").alias("title"), F.col("labels").alias("tags")), path)
    return readers.tagged_json(s, path).select(F.md5(F.col("title").cast("binary")).alias("title"), F.array_join("tags", ",").alias("tags"))


@query("k01_json_lines", with_views(f"WITH {DOCS} SELECT md5(text) AS title, len(labels)::INTEGER AS n FROM docs", "text_labels"))
def k01(s, d):
    path = new_path(s, "json")
    writers.tagged_json(_docs(s, d).select(F.col("text").alias("title"), F.col("labels").alias("tags")), path)
    return s.read.text(path).select(F.md5(F.get_json_object("value", "$.title").cast("binary")).alias("title"), F.json_array_length(F.get_json_object("value", "$.tags")).alias("n"))


def _sparse(s, d):
    """(doc_id, labels, features) with numbered labels and features."""
    ids = L.index_labels(v.order_features(s, d).select(F.col("feature").alias("label")), "sorted", start=1)
    f = v.order_features(s, d).withColumnRenamed("feature", "label").join(ids, "label").groupBy("doc_id").agg(F.collect_list(F.struct(F.col("label_id").alias("feature"), "value")).alias("features"))
    l = v.order_labels(s, d).groupBy("doc_id").agg(F.transform(F.sort_array(F.collect_list(F.expr("cast(substr(label, 7) as int)"))), lambda x: x.cast("string")).alias("labels"))
    return f.join(l, "doc_id")


SPARSE = """ids AS (SELECT feature, row_number() OVER (ORDER BY feature) AS id FROM (SELECT DISTINCT feature FROM order_features)), f AS (SELECT doc_id, string_agg(id || ':' || CAST(value AS BIGINT), ' ' ORDER BY id) AS f, count(*) AS nf, sum(value) AS total FROM order_features JOIN ids USING (feature) GROUP BY doc_id),
    l AS (SELECT doc_id, string_agg(n, ',' ORDER BY n::INTEGER) AS l, count(*) AS nl FROM (SELECT doc_id, substr(label, 7) AS n FROM order_labels) GROUP BY doc_id)"""


@query("s04_sparse_text_with_header", with_views(f"WITH {SPARSE} SELECT row_number() OVER (ORDER BY doc_id) - 1 AS line, l AS labels, nf AS features, total FROM f JOIN l USING (doc_id)", "order_labels", "order_features"))
def s04(s, d):
    path = new_path(s, "sparse")
    writers.sparse_text(_sparse(s, d), path, 1000, 25)
    rows = readers.sparse_text(s, path, header=True)
    return rows.select("line", F.array_join("labels", ",").alias("labels"), F.size("features").cast("long").alias("features"), F.aggregate("features.value", F.lit(0.0), lambda a, x: a + x).alias("total"))


@query("s05_sparse_text_checked", with_views(f"WITH {SPARSE} SELECT l AS labels, nf AS features, total FROM f JOIN l USING (doc_id)", "order_labels", "order_features"))
def s05(s, d):
    path = new_path(s, "sparse")
    writers.sparse_text(_sparse(s, d), path, 1000, 25, header=False)
    rows = readers.checked(readers.sparse_text(s, path))
    return rows.select(F.array_join("labels", ",").alias("labels"), F.size("features").cast("long").alias("features"), F.aggregate("features.value", F.lit(0.0), lambda a, x: a + x).alias("total"))


@query("k02_sparse_lines", with_views(f"WITH {SPARSE} SELECT doc_id, l || ' ' || f AS value FROM f JOIN l USING (doc_id)", "order_labels", "order_features"))
def k02(s, d):
    return writers.sparse_lines(_sparse(s, d))


@query("s06_feature_maps", with_views(f"WITH {SPARSE} SELECT nf AS features, total FROM f", "order_labels", "order_features"))
def s06(s, d):
    path = new_path(s, "features")
    writers.sparse_lines(_sparse(s, d).withColumn("labels", F.array().cast("array<string>"))).select("value").write.text(path)
    rows = readers.feature_maps(s, path)
    return rows.select(F.size("features").cast("long").alias("features"), F.aggregate(F.map_values("features"), F.lit(0.0), lambda a, x: a + x).alias("total"))


@query("s07_label_lines", with_views(f"WITH {DOCS} SELECT array_to_string(labels, ',') AS labels, len(string_split(text, ' ')) AS words FROM docs", "text_labels"))
def s07(s, d):
    path = new_path(s, "lines")
    docs = _docs(s, d).withColumn("text", F.regexp_replace("text", r"[^\w ]|_", "x"))
    writers.label_lines(docs, path)
    return readers.label_lines(s, path).select(F.array_join(F.sort_array("labels"), ",").alias("labels"), F.size("words").cast("long").alias("words"))


@query("k04_label_lines", with_views(f"WITH {DOCS} SELECT md5(array_to_string(list_transform(labels, lambda x: '__label__' || x), ' ') || ' ' || text) AS line FROM docs", "text_labels"))
def k04(s, d):
    path = new_path(s, "lines")
    writers.label_lines(_docs(s, d), path)
    return s.read.text(path).select(F.md5(F.col("value").cast("binary")).alias("line"))


@query("s08_labels_in_text", with_views(f"WITH {DOCS} SELECT doc_id, array_to_string(labels, ',') AS labels, md5(text) AS rest FROM docs", "text_labels"))
def s08(s, d):
    from bramble.functions.text import label_line, labels_in_text

    lines = _docs(s, d).select("doc_id", labels_in_text(label_line(F.col("labels"), F.col("text"))).alias("p"))
    return lines.select("doc_id", F.array_join("p.labels", ",").alias("labels"), F.md5(F.col("p.rest").cast("binary")).alias("rest"))


@query("s09_tsv", with_views(f"WITH {DOCS} SELECT doc_id::VARCHAR AS doc_id, array_to_string(labels, ',') AS labels, md5(text) AS text FROM docs", "text_labels"))
def s09(s, d):
    path = new_path(s, "tsv")
    writers.tsv(_docs(s, d), path)
    return readers.tsv(s, path).select("doc_id", F.array_join("labels", ",").alias("labels"), F.md5(F.col("text").cast("binary")).alias("text"))


@query("k05_tsv_lines", with_views(f"WITH {DOCS} SELECT md5(doc_id || chr(9) || array_to_string(labels, ' ') || chr(9) || text) AS line FROM docs", "text_labels"))
def k05(s, d):
    path = new_path(s, "tsv")
    writers.tsv(_docs(s, d), path)
    return s.read.text(path).select(F.md5(F.col("value").cast("binary")).alias("line"))


@query("s10_aligned_files", with_views(f"WITH {DOCS} SELECT row_number() OVER (ORDER BY doc_id) - 1 AS line, md5(text) AS text, array_to_string(labels, ',') AS labels, 'train' AS part FROM docs", "text_labels"))
def s10(s, d):
    texts, labels = new_path(s, "texts"), new_path(s, "labels")
    writers.text_and_labels(_docs(s, d), texts, labels)
    return readers.aligned_files(s, texts, labels, "train").select("line", F.md5(F.col("text").cast("binary")).alias("text"), F.array_join("labels", ",").alias("labels"), "part")


@query("k03_text_and_label_files", with_views(f"WITH {DOCS} SELECT array_to_string(labels, ' ') AS labels, count(*) AS n FROM docs GROUP BY 1", "text_labels"))
def k03(s, d):
    texts, labels = new_path(s, "texts"), new_path(s, "labels")
    writers.text_and_labels(_docs(s, d), texts, labels)
    return s.read.text(labels).groupBy(F.col("value").alias("labels")).agg(F.count("*").alias("n"))


@query("s11_score_files", with_views("SELECT key, label, score FROM (SELECT key, CAST(substr(label, 7) AS INTEGER) AS label, round(n / sum(n) OVER (PARTITION BY key), 6) AS score FROM key_counts)", "key_counts"))
def s11(s, d):
    from pyspark.sql import Window

    rows = v.key_counts(s, d).select("key", F.expr("cast(substr(label, 7) as int)").alias("label"), F.round(F.col("n") / F.sum("n").over(Window.partitionBy("key")), 6).alias("score"))
    path = new_path(s, "scores")
    cell = F.struct("label", F.concat_ws(":", F.col("label").cast("string"), F.format_string("%.6f", "score")).alias("t"))
    rows.groupBy("key", F.expr("label div 10").alias("batch")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(cell)), lambda x: x["t"]), " ").alias("value")).orderBy("batch", "key").select("value", "batch").write.partitionBy("batch").text(path)
    names = rows.select("key").distinct()
    numbered = L._numbered(names, ["key"], "line")
    return readers.score_files(s, path).join(numbered, "line").select("key", "label", "score")


@query("s12_label_rows", with_views("SELECT row_number() OVER (ORDER BY doc_id) - 1 AS line, labels FROM (SELECT doc_id, string_agg(n, ',' ORDER BY n::INTEGER) AS labels FROM (SELECT doc_id, substr(label, 7) AS n FROM order_labels) GROUP BY doc_id)", "order_labels"))
def s12(s, d):
    path = new_path(s, "truth")
    rows = v.order_labels(s, d).groupBy("doc_id").agg(F.array_join(F.sort_array(F.collect_list(F.expr("cast(substr(label, 7) as int)"))), ",").alias("value"))
    rows.orderBy("doc_id").select(F.concat("value", F.lit(" ")).alias("value")).write.text(path)
    back = readers.label_rows(s, path, ",")
    return back.groupBy("line").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "label"))), lambda x: x["label"].cast("string")), ",").alias("labels"))


@query("s13_word_vectors", "SELECT 'v' || vec_id AS word, len(embedding) AS dim, round(embedding[1], 5) AS first FROM embeddings")
def s13(s, d):
    path = new_path(s, "vec")
    e = v.vectors(s, d).select(F.concat(F.lit("v"), F.col("id").cast("string")).alias("id"), "vector")
    head = s.range(1).select(F.lit("0 64").alias("value"), F.lit(0).alias("o"))
    lines = e.select(F.concat_ws(" ", "id", F.array_join(F.transform("vector", lambda x: number(x, 8)), " ")).alias("value"), F.lit(1).alias("o"))
    head.unionByName(lines).orderBy("o").select("value").write.text(path)
    return readers.word_vectors(s, path).select("word", F.size("vector").cast("long").alias("dim"), F.round(F.col("vector")[0], 5).alias("first"))


@query("k10_vector_lines", "SELECT vec_id AS id, len(embedding) + 1 AS cells FROM embeddings")
def k10(s, d):
    path = new_path(s, "vec")
    writers.vectors(v.vectors(s, d), path)
    return s.read.text(path).select(F.split("value", " ").alias("t")).select(F.col("t")[0].cast("long").alias("id"), F.size("t").cast("long").alias("cells"))


@query("k09_document_vectors", with_views("SELECT doc_id::VARCHAR AS id, 3::BIGINT AS cells FROM (SELECT DISTINCT doc_id FROM order_features)", "order_features"))
def k09(s, d):
    f = v.order_features(s, d)
    wv = f.select("feature").distinct().select("feature", V.hashed_vector(F.col("feature"), 2).alias("vector"))
    path = new_path(s, "docvec")
    writers.vectors(V.mean_vectors(f.join(wv, "feature"), "doc_id", F.col("value")), path, "doc_id")
    return s.read.text(path).select(F.split("value", " ").alias("t")).select(F.col("t")[0].alias("id"), F.size("t").cast("long").alias("cells"))


@query("s14_tree_edges", "SELECT 'r' || n_regionkey AS parent, 'n' || n_nationkey AS child, n_name AS label FROM nation UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey, NULL FROM customer")
def s14(s, d):
    n, c = v.table(s, d, "nation"), v.table(s, d, "customer")
    path = new_path(s, "tree")
    lines = n.select(F.concat_ws(" ", F.concat(F.lit("r"), "n_regionkey"), F.concat(F.lit("n"), "n_nationkey"), "n_name").alias("value")).unionByName(c.select(F.concat_ws(" ", F.concat(F.lit("n"), "c_nationkey"), F.concat(F.lit("c"), "c_custkey")).alias("value")))
    lines.write.text(path)
    return readers.tree_edges(s, path)


@query("s15_label_mapping", with_views('SELECT CAST(substr(label, 7) AS INTEGER) AS old, (row_number() OVER (ORDER BY label))::INTEGER AS "new" FROM (SELECT DISTINCT label FROM order_labels)', "order_labels"))
def s15(s, d):
    path = new_path(s, "mapping")
    L.index_labels(v.order_labels(s, d), "sorted", start=1).select(F.concat_ws(" ", F.expr("substr(label, 7)"), F.col("label_id").cast("string")).alias("value")).write.text(path)
    return readers.label_mapping(s, path)


@query("s16_analogy_questions", "SELECT n_name AS section, count(*) AS questions FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY n_name")
def s16(s, d):
    c, n = v.table(s, d, "customer"), v.table(s, d, "nation")
    path = new_path(s, "questions")
    heads = n.join(c, F.col("n_nationkey") == F.col("c_nationkey"), "left_semi").select("n_nationkey", F.lit(-1).cast("long").alias("o"), F.concat(F.lit(": "), "n_name").alias("value"))
    rows = c.select(F.col("c_nationkey").alias("n_nationkey"), F.col("c_custkey").alias("o"), F.concat_ws(" ", F.lit("a"), F.lit("b"), F.concat(F.lit("c"), "c_custkey"), F.lower("c_mktsegment")).alias("value"))
    heads.unionByName(rows).orderBy("n_nationkey", "o").select("value").write.text(path)
    return readers.analogy_questions(s, path).groupBy("section").agg(F.count("d").alias("questions"))


@query("s17_similarity_pairs", "SELECT 's' || l_suppkey AS w1, 'p' || l_partkey AS w2, round(avg(l_discount), 4) AS gold FROM lineitem GROUP BY ALL")
def s17(s, d):
    path = new_path(s, "pairs")
    rows = v.table(s, d, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.round(F.avg("l_discount"), 4).alias("g"))
    rows.select(F.concat_ws(" ", F.concat(F.lit("s"), "l_suppkey"), F.concat(F.lit("p"), "l_partkey"), F.format_string("%.4f", "g")).alias("value")).write.text(path)
    return readers.similarity_pairs(s, path)


@query("s18_landed_identifiers", "SELECT event_id, 'cpe:2.3:a:' || event_type || ':k' || (props::JSON->>'k') AS identifier FROM events UNION ALL SELECT event_id, 'cpe:2.3:o:user:' || user_id FROM events")
def s18(s, d):
    e = v.table(s, d, "events").select("event_id", F.concat(F.lit("cpe:2.3:a:"), "event_type", F.lit(":k"), F.get_json_object("props", "$.k")).alias("top"), F.concat(F.lit("cpe:2.3:o:user:"), F.col("user_id").cast("string")).alias("sub"))
    match = lambda c: F.array(F.struct(F.col(c).alias("cpe23Uri")))
    node = F.struct(match("top").alias("cpe_match"), F.array(F.struct(match("sub").alias("cpe_match"))).alias("children"))
    landed = F.struct(F.struct(F.array(F.struct(F.struct(F.array(node).alias("nodes")).alias("configurations"))).alias("CVE_Items")).alias("result"))
    return readers.landed_identifiers(e.select("event_id", F.to_json(landed).alias("j")), "event_id", "j")


@query("s20_stringified_lists", with_views(f"WITH {LISTS} SELECT doc_id, labels FROM lists", "order_labels"))
def s20(s, d):
    from bramble.functions.text import parse_list_column

    lists = v.order_labels(s, d).groupBy("doc_id").agg(F.concat(F.lit("['"), F.array_join(F.sort_array(F.collect_list("label")), "', '"), F.lit("']")).alias("x"))
    return lists.select("doc_id", F.array_join(parse_list_column(F.col("x")), ",").alias("labels"))


@query("k06_records", with_views(f"WITH {DOCS} SELECT md5(text) AS text, len(labels) AS n FROM docs", "text_labels"))
def k06(s, d):
    path = new_path(s, "records")
    writers.records(_docs(s, d).withColumn("label_ids", F.sequence(F.lit(1), F.size("labels"))), path)
    return s.read.parquet(path).select(F.md5(F.col("text").cast("binary")).alias("text"), F.size("catgy").cast("long").alias("n"))


@query("k07_identical_pairs", with_views("SELECT label || ' == ' || label || '~' AS line FROM (SELECT DISTINCT label FROM order_labels) WHERE CAST(substr(label, 7) AS INTEGER) % 2 = 0", "order_labels"))
def k07(s, d):
    from bramble.plans.q_labels import cloned

    path = new_path(s, "pairs")
    writers.identical_pairs(L.identical_pairs(cloned(s, d)), path)
    return s.read.text(path).select(F.col("value").alias("line"))


@query("k08_predictions", with_views("SELECT doc_id || ' ' || string_agg(label, ' ' ORDER BY rank) AS line FROM top5 GROUP BY doc_id", "top5"))
def k08(s, d):
    path = new_path(s, "predictions")
    writers.predictions(v.top5(s, d), path, with_scores=False)
    return s.read.text(path).select(F.col("value").alias("line"))


@query("k11_vocabulary", with_views("SELECT token || ' ' || count(*) || ' word' AS line FROM tokens GROUP BY token", "tokens"))
def k11(s, d):
    path = new_path(s, "vocabulary")
    writers.vocabulary(v.tokens(s, d).groupBy("token").agg(F.count("*").alias("n")).withColumn("type", F.lit("word")), path)
    return s.read.text(path).select(F.col("value").alias("line"))


@query("k12_weights", with_views("SELECT label, round(power(ln(1 + n), -1), 6) AS weight FROM label_counts", "label_counts"))
def k12(s, d):
    path = new_path(s, "weights")
    writers.weights(W.label_weights(v.order_labels(s, d), "log_exp"), path)
    return s.read.parquet(path).select("label", F.round("weight", 6).alias("weight"))


@query("k13_memberships", with_views("SELECT doc_id, key AS cluster, labels, total FROM order_keys JOIN (SELECT DISTINCT doc_id FROM order_labels) USING (doc_id) JOIN (SELECT key, count(*) AS labels, round(sum(p), 6) AS total FROM (SELECT key, round(n / size, 3) AS p FROM key_counts JOIN (SELECT key, count(*) AS size FROM order_keys JOIN (SELECT DISTINCT doc_id FROM order_labels) USING (doc_id) GROUP BY key) USING (key)) GROUP BY key) USING (key)", "key_counts"))
def k13(s, d):
    from bramble.operators.doctree import leaf_distribution

    leaves = v.order_keys(s, d).join(v.order_labels(s, d), "doc_id", "left_semi").select(F.lit(0).alias("tree"), F.col("key").alias("node"), "doc_id")
    path = new_path(s, "clusters")
    writers.memberships(leaves, leaf_distribution(leaves, v.order_labels(s, d)), path)
    shares = s.read.schema("tree int, node string, labels map<string, double>").json(f"{path}/leaves").select(F.col("node").alias("cluster"), F.size("labels").cast("long").alias("labels"), F.round(F.aggregate(F.map_values("labels"), F.lit(0.0), lambda a, x: a + x), 6).alias("total"))
    rows = s.read.schema("doc_id long, clusters array<string>").json(f"{path}/rows").select("doc_id", F.explode("clusters").alias("cluster"))
    return rows.join(shares, "cluster").select("doc_id", "cluster", "labels", "total")


@query("k14_model_tables", with_views("SELECT key AS node, label, round(n / size, 6) AS p FROM key_counts JOIN (SELECT key, count(*) AS size FROM order_keys JOIN (SELECT DISTINCT doc_id FROM order_labels) USING (doc_id) GROUP BY key) USING (key)", "key_counts"))
def k14(s, d):
    from bramble.operators.doctree import leaf_distribution

    leaves = v.order_keys(s, d).join(v.order_labels(s, d), "doc_id", "left_semi").select(F.lit(0).alias("tree"), F.col("key").alias("node"), "doc_id")
    path = new_path(s, "model")
    writers.model({"leaf_probs": leaf_distribution(leaves, v.order_labels(s, d))}, path, {"trees": 1})
    return s.read.parquet(f"{path}/leaf_probs").select("node", "label", F.round("p", 6).alias("p"))


@query("k15_label_id_dump", with_views("WITH i AS (SELECT label, row_number() OVER (ORDER BY label) - 1 AS id FROM (SELECT DISTINCT label FROM order_labels)) SELECT doc_id, '[' || string_agg(id, ',' ORDER BY id) || ']' AS actual_labels FROM order_labels JOIN i USING (label) GROUP BY doc_id", "order_labels"))
def k15(s, d):
    path = new_path(s, "dump")
    rows = v.order_labels(s, d)
    writers.label_id_dump(rows, L.index_labels(rows, "sorted"), path)
    return s.read.text(path).select(F.get_json_object("value", "$.doc_id").cast("long").alias("doc_id"), F.get_json_object("value", "$.actual_labels").alias("actual_labels"))
