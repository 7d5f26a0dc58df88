"""Registered queries over labels, scores and ranking metrics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from bramble.operators import features as X
from bramble.operators import labels as L
from bramble.operators import matcher, metrics, topk, weights
from bramble.operators import vectors as V
from bramble.plans import views as v
from bramble.plans.registry import query
from bramble.plans.shared import stage
from bramble.plans.views import with_views

R6 = lambda *cs: [F.round(c, 6).alias(c) for c in cs]


@query("a01_label_frequency", with_views("SELECT label, n FROM label_counts", "label_counts"))
def a01(s, d):
    return L.counts(v.order_labels(s, d))


@query("a02_word_counts", with_views("SELECT token, count(*) AS n, count(DISTINCT doc_id) AS docs FROM tokens GROUP BY token", "tokens"))
def a02(s, d):
    per_doc = v.tokens(s, d).groupBy("token", "doc_id").agg(F.count("*").alias("k"))
    return per_doc.groupBy("token").agg(F.sum("k").alias("n"), F.count("*").alias("docs"))


@query("a02_corpus_totals", with_views("SELECT (SELECT count(*) FROM tokens) AS tokens, count(*) AS documents, (SELECT count(DISTINCT token) FROM tokens) AS words FROM documents", "tokens"))
def a02b(s, d):
    t = v.tokens(s, d).agg(F.count("*").alias("tokens"), F.count_distinct("token").alias("words"))
    return t.crossJoin(v.documents(s, d).agg(F.count("*").alias("documents"))).select("tokens", "documents", "words")


@query("a03_matcher_counts", with_views("SELECT key, label, n FROM key_counts", "key_counts"))
def a03(s, d):
    return v.key_counts(s, d)


@query("a04_above_average", with_views("SELECT key, label, n FROM (SELECT *, avg(n) OVER (PARTITION BY key) AS m FROM key_counts) WHERE n >= m", "key_counts"))
def a04(s, d):
    return matcher.above_average(v.key_counts(s, d)).select("key", "label", "n")


CLONED = "cloned AS (SELECT doc_id, label FROM order_labels UNION ALL SELECT doc_id, label || '~' FROM order_labels WHERE CAST(substr(label, 7) AS INTEGER) % 2 = 0)"


def cloned(s, d):
    labels = v.order_labels(s, d)
    twin = labels.where("cast(substr(label, 7) as int) % 2 = 0").select("doc_id", F.concat("label", F.lit("~")).alias("label"))
    return labels.unionByName(twin)


@query("a05_merge_identical_labels", with_views(f"""WITH {CLONED}, sig AS (SELECT label, string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) AS s FROM cloned GROUP BY label)
    SELECT string_agg(label, ';' ORDER BY label) AS merged, count(*) AS members FROM sig GROUP BY s""", "order_labels"))
def a05(s, d):
    names, _ = L.merge_identical(cloned(s, d))
    return names.groupBy("merged").agg(F.count("*").alias("members"))


@query("j03_identical_label_pairs", with_views(f"""WITH {CLONED}, sig AS (SELECT label, string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) AS s FROM cloned GROUP BY label)
    SELECT l.label AS a, r.label AS b FROM sig l JOIN sig r ON l.s = r.s AND l.label < r.label""", "order_labels"))
def j03(s, d):
    return L.identical_pairs(cloned(s, d))


@query("a06_uniform_weights", with_views("SELECT label, 1.0::DOUBLE AS weight FROM label_counts", "label_counts"))
def a06(s, d):
    return weights.label_weights(v.order_labels(s, d), "uniform")


N = "(SELECT count(DISTINCT doc_id) FROM order_labels)"


@query("a07_propensity_weights", with_views(f"SELECT label, round(1 + (ln({N}) - 1) * power(2.5, 0.55) * power(n + 1.5, -0.55), 6) AS weight FROM label_counts", "label_counts"))
def a07(s, d):
    return weights.label_weights(v.order_labels(s, d), "propensity").select("label", *R6("weight"))


@query("a08_negative_log_weights", with_views(f"SELECT label, round(ln({N} / n) + 1, 6) AS weight FROM label_counts", "label_counts"))
def a08(s, d):
    return weights.label_weights(v.order_labels(s, d), "negative_log").select("label", *R6("weight"))


@query("a09_log_exp_weights", with_views("SELECT label, round(power(ln(1 + n), -1), 6) AS weight FROM label_counts", "label_counts"))
def a09(s, d):
    return weights.label_weights(v.order_labels(s, d), "log_exp").select("label", *R6("weight"))


@query("s19_weights_to_propensity", with_views(f"SELECT label, round(1 / (1 + (ln({N}) - 1) * power(2.5, 0.55) * power(n + 1.5, -0.55)), 6) AS propensity FROM label_counts", "label_counts"))
def s19(s, d):
    kept = stage(weights.label_weights(v.order_labels(s, d), "propensity"), "weights")
    return kept.select("label", F.round(1 / F.col("weight"), 6).alias("propensity"))


def _scored_keys(s, d):
    return v.key_scores(s, d).withColumnRenamed("key", "doc_id")


def _popular(s, d):
    """(label, score): the share of each label, the same for every document."""
    counts = L.counts(v.order_labels(s, d))
    return counts.crossJoin(F.broadcast(counts.agg(F.sum("n").alias("total")))).select("label", F.round(F.col("n") / F.col("total"), 9).alias("score"))


def _of_keys(s, d, ranked):
    """Rows ranked once a key (doc_id = key), for each document of the key."""
    return v.order_keys(s, d).join(ranked.withColumnRenamed("doc_id", "key"), "key").drop("key")


MACRO = """SELECT k, round(avg(h / k), 6) AS p, round(avg(h / t), 6) AS r, round(2 * avg(h / k) * avg(h / t) / (avg(h / k) + avg(h / t)), 6) AS f1
    FROM (SELECT doc_id, k, any_value(n_truth) AS t, sum(CASE WHEN rank <= k THEN hit ELSE 0 END) AS h FROM hits, (SELECT unnest([1, 2, 3]) AS k) GROUP BY doc_id, k) GROUP BY k"""


@query("a20_macro_metrics", with_views(MACRO, "hits"))
def a20(s, d):
    return metrics.macro_at_k(v.hits(s, d), [1, 2, 3]).select("k", *R6("p", "r", "f1"))


PER = "(SELECT doc_id, k, any_value(n_truth) AS t, sum(CASE WHEN rank <= k THEN hit ELSE 0 END) AS h, count(CASE WHEN rank <= k THEN 1 END) AS m FROM hits, (SELECT unnest([1, 3, 5]) AS k) GROUP BY doc_id, k)"


@query("a21_totals", with_views(f"SELECT k, sum(h)::BIGINT AS correct, sum(m)::BIGINT AS predicted, sum(t)::BIGINT AS actual, round(sum(h) / sum(m), 6) AS p, round(sum(h) / sum(t), 6) AS r FROM {PER} GROUP BY k", "hits"))
def a21(s, d):
    return metrics.totals_at_k(v.hits(s, d), [1, 3, 5]).select("k", "correct", "predicted", "actual", *R6("p", "r"))


@query("a22_micro", with_views("SELECT round(sum(h) / sum(m), 6) AS p, round(sum(h) / sum(t), 6) AS r FROM (SELECT sum(hit) AS h, count(*) AS m, any_value(n_truth) AS t FROM hits GROUP BY doc_id)", "hits"))
def a22(s, d):
    return metrics.micro(v.hits(s, d)).select(*R6("p", "r"))


@query("a23_micro_precision_macro_recall", with_views(f"SELECT k, round(p, 6) AS p, round(r, 6) AS r, round(CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END, 6) AS f1 FROM (SELECT k, sum(h) / sum(m) AS p, avg(h / t) AS r FROM {PER} GROUP BY k)", "hits"))
def a23(s, d):
    return metrics.micro_precision_macro_recall(v.hits(s, d), [1, 3, 5]).select("k", *R6("p", "r", "f1"))


@query("a24_precision_percent", with_views(f"SELECT k, round(100 * sum(h) / (count(*) * k), 6) AS p FROM {PER} GROUP BY k", "hits"))
def a24(s, d):
    return metrics.precision_percent(v.hits(s, d), [1, 3, 5]).select("k", *R6("p"))


@query("a25_ndcg", with_views("""SELECT k, round(avg(g / i), 6) AS ndcg FROM (SELECT doc_id, k, sum(CASE WHEN rank <= k THEN hit / log2(rank + 1) ELSE 0 END) AS g,
    list_sum([1 / log2(x + 1) FOR x IN range(1, least(k, any_value(n_truth)) + 1)]) AS i FROM hits, (SELECT unnest([1, 3, 5]) AS k) GROUP BY doc_id, k) GROUP BY k""", "hits"))
def a25(s, d):
    return metrics.ndcg_at_k(v.hits(s, d), [1, 3, 5]).select("k", *R6("ndcg"))


@query("a26_list_ndcg", with_views("""SELECT round(avg(CASE WHEN b > 0 THEN g / b ELSE 0 END), 6) AS ndcg FROM (SELECT doc_id, sum(CASE WHEN rank <= 3 THEN hit / log2(rank + 1) ELSE 0 END) AS g,
    coalesce(list_sum([1 / log2(x + 1) FOR x IN range(1, least(3, sum(hit))::BIGINT + 1)]), 0) AS b FROM hits GROUP BY doc_id)""", "hits"))
def a26(s, d):
    lists = v.hits(s, d).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("rank", "hit"))).alias("x"))
    return lists.agg(F.round(F.avg(metrics.list_ndcg(F.col("x.hit"), 3)), 6).alias("ndcg"))


@query("a27_propensity_ndcg", with_views(f"""WITH w AS (SELECT label, 1 + (ln({N}) - 1) * power(2.5, 0.55) * power(n + 1.5, -0.55) AS w FROM label_counts)
    SELECT k, round(avg(g / list_sum([1 / ln(x + 1) FOR x IN range(1, k + 1)])), 6) AS psndcg FROM (SELECT doc_id, k, sum(CASE WHEN rank <= k THEN hit * w / ln(rank + 1) ELSE 0 END) AS g
    FROM hits JOIN w USING (label), (SELECT unnest([1, 3, 5]) AS k) GROUP BY doc_id, k) GROUP BY k""", "hits", "label_counts"))
def a27(s, d):
    return metrics.propensity_ndcg(v.hits(s, d), weights.label_weights(v.order_labels(s, d)), [1, 3, 5]).select("k", *R6("psndcg"))


@query("a28_coverage", with_views("""SELECT round(sum(h) / sum(m), 6) AS p, round(sum(h) / sum(t), 6) AS r, round(any_value(c) / (SELECT count(DISTINCT label) FROM order_labels), 6) AS coverage
    FROM (SELECT sum(hit) AS h, count(*) AS m, any_value(n_truth) AS t FROM hits WHERE rank <= 3 GROUP BY doc_id), (SELECT count(DISTINCT label) AS c FROM hits WHERE hit = 1 AND rank <= 3)""", "hits"))
def a28(s, d):
    return metrics.coverage(v.hits(s, d), v.order_labels(s, d), 3).select(*R6("p", "r", "coverage"))


@query("a29_models_and_ensemble", with_views("""WITH pop AS (SELECT doc_id, label, n::DOUBLE / (SELECT sum(n) FROM label_counts) AS score FROM order_keys, label_counts),
    rows AS (SELECT 'by key' AS model, doc_id, label, score FROM scores UNION ALL SELECT 'popular', doc_id, label, round(score, 9) FROM pop
    UNION ALL SELECT 'sum', doc_id, label, round(s.score + round(p.score, 9), 9) FROM scores s JOIN pop p USING (doc_id, label)),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY model, doc_id ORDER BY score DESC, label) AS rank FROM rows),
    h AS (SELECT model, r.doc_id, rank, (o.label IS NOT NULL)::INTEGER AS hit, t FROM ranked r JOIN (SELECT doc_id, count(*) AS t FROM order_labels GROUP BY doc_id) USING (doc_id)
      LEFT JOIN order_labels o ON o.doc_id = r.doc_id AND o.label = r.label WHERE rank <= 5)
    SELECT model, k, round(avg(c / k), 6) AS p, round(avg(c / t), 6) AS r FROM (SELECT model, doc_id, k, any_value(t) AS t, sum(CASE WHEN rank <= k THEN hit ELSE 0 END) AS c
    FROM h, (SELECT unnest([1, 3, 5]) AS k) GROUP BY model, doc_id, k) GROUP BY model, k""", "scores", "label_counts"))
def a29(s, d):
    # scores depend on a document's key alone: members are ranked and summed once a key
    by_key, popular = stage(_scored_keys(s, d), "by-key"), stage(_popular(s, d), "popular")
    head = popular.orderBy(F.desc("score"), "label").limit(5).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "label")))
    same = by_key.select("doc_id").distinct().crossJoin(F.broadcast(head)).select("doc_id", "label", "score", "rank")
    truth = stage(v.order_labels(s, d), "truth")
    tops = [topk.top_k(by_key, 5).withColumn("model", F.lit("by key")), same.withColumn("model", F.lit("popular")), topk.shared_ensemble(by_key, popular, 5).withColumn("model", F.lit("sum"))]
    rows = tops[0]
    for t in tops[1:]:
        rows = rows.unionByName(t)
    rows = _of_keys(s, d, rows)
    sizes = truth.groupBy("doc_id").agg(F.count("*").alias("n_truth"))
    h = rows.join(sizes, "doc_id").join(truth.withColumn("hit", F.lit(1)), ["doc_id", "label"], "left").withColumn("hit", F.coalesce("hit", F.lit(0)))
    return metrics.set_metrics(h, "model", [1, 3, 5]).select("model", "k", *R6("p", "r"))


@query("a30_threshold_f1", with_views("""WITH p AS (SELECT doc_id, label FROM scores WHERE score >= 0.04), b AS (SELECT coalesce(p.label, o.label) AS label, (p.label IS NOT NULL AND o.label IS NOT NULL)::INTEGER AS tp,
    (p.label IS NOT NULL)::INTEGER AS np, (o.label IS NOT NULL)::INTEGER AS nt FROM p FULL JOIN order_labels o ON o.doc_id = p.doc_id AND o.label = p.label),
    l AS (SELECT label, sum(tp) AS tp, sum(np) AS np, sum(nt) AS nt FROM b GROUP BY label)
    SELECT round(2 * sum(tp) / (sum(np) + sum(nt)), 6) AS micro_f1, round(avg(CASE WHEN tp = 0 THEN 0 ELSE 2 * tp / (np + nt) END), 6) AS macro_f1 FROM l""", "scores", "order_labels"))
def a30(s, d):
    return metrics.threshold_f1(v.scores(s, d), v.order_labels(s, d), 0.04).select(*R6("micro_f1", "macro_f1"))


@query("a31_positive_precision", with_views(f"SELECT k, round(avg(h / k), 6) AS p FROM (SELECT doc_id, k, sum(CASE WHEN rank <= k AND score > 0 THEN hit ELSE 0 END) AS h FROM hits, (SELECT unnest([1, 3, 5]) AS k) GROUP BY doc_id, k) GROUP BY k", "hits"))
def a31(s, d):
    return metrics.positive_precision(v.hits(s, d), [1, 3, 5]).select("k", *R6("p"))


@query("a32_regression_metrics", """SELECT round(avg((l_quantity = round(l_extendedprice / 1500))::INTEGER), 6) AS accuracy, round(avg(power(l_quantity - round(l_extendedprice / 1500), 2)), 6) AS mse,
    round(power(corr(l_quantity, round(l_extendedprice / 1500)), 2), 6) AS squared_correlation FROM lineitem""")
def a32(s, d):
    rows = v.table(s, d, "lineitem").select("l_quantity", F.round(F.col("l_extendedprice") / 1500).alias("guess"))
    return metrics.regression_metrics(rows, "l_quantity", "guess").select(*R6("accuracy", "mse", "squared_correlation"))





@query("a33_filtered_hits", """WITH sup AS (SELECT l_orderkey % 500 AS key, l_suppkey AS label, count(*) AS n FROM lineitem GROUP BY ALL), pop AS (SELECT label, sum(n) AS score FROM sup GROUP BY label),
    gold AS (SELECT key, min(label) AS label FROM sup GROUP BY key), r AS (SELECT g.key, g.label, 1 + count(o.label) AS rank FROM gold g JOIN pop p ON p.label = g.label
    LEFT JOIN pop o ON o.score > p.score AND NOT EXISTS (SELECT 1 FROM sup f WHERE f.key = g.key AND f.label = o.label) GROUP BY g.key, g.label)
    SELECT round(avg((rank <= 1)::INTEGER), 6) AS hits_at_1, round(avg((rank <= 10)::INTEGER), 6) AS hits_at_10 FROM r""")
def a33(s, d):
    facts = v.table(s, d, "lineitem").select((F.col("l_orderkey") % 500).alias("key"), F.col("l_suppkey").alias("label"))
    popular = facts.groupBy("label").agg(F.count("*").alias("score"))
    gold = facts.groupBy("key").agg(F.min("label").alias("label"))
    return metrics.hits_at(metrics.shared_filtered_ranks(popular, facts, gold), [1, 10]).select(*R6("hits_at_1", "hits_at_10"))


@query("j13_filtered_ranks", """WITH sup AS (SELECT DISTINCT l_orderkey % 500 AS key, l_suppkey AS label FROM lineitem), pop AS (SELECT l_suppkey AS label, count(*) AS score FROM lineitem GROUP BY 1),
    gold AS (SELECT key, max(label) AS label FROM sup GROUP BY key) SELECT g.key, g.label, 1 + count(o.label) AS rank FROM gold g JOIN pop p ON p.label = g.label
    LEFT JOIN pop o ON o.score > p.score AND NOT EXISTS (SELECT 1 FROM sup f WHERE f.key = g.key AND f.label = o.label) GROUP BY g.key, g.label""")
def j13(s, d):
    rows = v.table(s, d, "lineitem").select((F.col("l_orderkey") % 500).alias("key"), F.col("l_suppkey").alias("label"))
    popular = rows.groupBy("label").agg(F.count("*").alias("score"))
    gold = rows.groupBy("key").agg(F.max("label").alias("label"))
    return metrics.shared_filtered_ranks(popular, rows, gold)


@query("a34_section_accuracy", """WITH a AS (SELECT n_name AS section, (c_acctbal > 0)::INTEGER AS ok FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_acctbal IS NOT NULL),
    r AS (SELECT section, ok FROM a UNION ALL SELECT CASE WHEN section IN ('NATION_0', 'NATION_1') THEN 'semantic' ELSE 'syntactic' END, ok FROM a UNION ALL SELECT 'total', ok FROM a)
    SELECT section, sum(ok)::BIGINT AS "right", count(*) AS asked, round(sum(ok) / count(*), 6) AS accuracy FROM r GROUP BY section""")
def a34(s, d):
    c, n = v.table(s, d, "customer"), v.table(s, d, "nation")
    answers = c.join(F.broadcast(n), F.col("n_nationkey") == F.col("c_nationkey")).select(F.col("n_name").alias("section"), (F.col("c_acctbal") > 0).cast("int").alias("right"))
    return metrics.section_accuracy(answers, ["NATION_0", "NATION_1"]).select("section", "right", "asked", *R6("accuracy"))


@query("a35_spearman", """WITH x AS (SELECT l_quantity, l_discount, rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2 AS rx,
    rank() OVER (ORDER BY l_discount) + (count(*) OVER (PARTITION BY l_discount) - 1) / 2 AS ry FROM lineitem) SELECT round(100 * corr(rx, ry), 6) AS spearman FROM x""")
def a35(s, d):
    return metrics.spearman(v.table(s, d, "lineitem").select("l_quantity", "l_discount"), "l_quantity", "l_discount").select(*R6("spearman"))


@query("a34_question_coverage", """SELECT n_name AS section, count(*) AS questions, count(CASE WHEN c_acctbal > 0 THEN 1 END) AS known, round(100 * count(CASE WHEN c_acctbal > 0 THEN 1 END) / count(*), 6) AS coverage FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY n_name""")
def a34b(s, d):
    c, n = v.table(s, d, "customer"), v.table(s, d, "nation")
    answers = c.join(n, F.col("n_nationkey") == F.col("c_nationkey")).select(F.col("n_name").alias("section"), F.when(F.col("c_acctbal") > 0, 1).alias("right"))
    return metrics.question_coverage(answers).select("section", "questions", "known", *R6("coverage"))


@query("a35_unknown_pairs", "SELECT count(*) AS pairs, count(CASE WHEN vec_id + 490 IN (SELECT vec_id FROM embeddings) THEN 1 END) AS known, round(100 * count(CASE WHEN vec_id + 490 NOT IN (SELECT vec_id FROM embeddings) THEN 1 END) / count(*), 6) AS oov FROM embeddings")
def a35b(s, d):
    from bramble.operators import vectors as V

    e = v.vectors(s, d)
    pairs = e.select(F.col("id").alias("w1"), (F.col("id") + 490).alias("w2"), F.lit(1.0).alias("gold"))
    return metrics.unknown_pairs(V.pair_similarity(pairs, e)).select("pairs", "known", *R6("oov"))


@query("a36_cross_entropy", with_views("""SELECT round(avg(CASE WHEN o.label IS NULL THEN -ln(1 - score) ELSE -ln(score) END), 6) AS loss FROM scores s LEFT JOIN order_labels o ON o.doc_id = s.doc_id AND o.label = s.label""", "scores", "order_labels"))
def a36(s, d):
    return metrics.cross_entropy(v.scores(s, d), v.order_labels(s, d)).select(*R6("loss"))


@query("a37_class_costs", with_views("SELECT label, CASE WHEN n % 2 = 0 THEN 2.0 * n ELSE 2.0 END::DOUBLE AS cost FROM label_counts", "label_counts"))
def a37(s, d):
    n = L.counts(v.order_labels(s, d))
    return weights.class_costs(n.select("label"), n.where("n % 2 = 0").select("label", F.col("n").cast("double").alias("weight")), 2.0)


@query("a38_corpus_totals", with_views("SELECT (SELECT count(DISTINCT doc_id) FROM order_labels) AS docs, (SELECT count(DISTINCT label) FROM order_labels) AS labels, (SELECT count(DISTINCT feature) FROM order_features) AS features, (SELECT round(count(*) / count(DISTINCT doc_id), 6) FROM order_labels) AS mean_labels", "order_labels", "order_features"))
def a38(s, d):
    l = v.order_labels(s, d).agg(F.count_distinct("doc_id").alias("docs"), F.count_distinct("label").alias("labels"), F.count("*").alias("rows"))
    f = v.order_features(s, d).agg(F.count_distinct("feature").alias("features"))
    return l.crossJoin(f).select("docs", "labels", "features", F.round(F.col("rows") / F.col("docs"), 6).alias("mean_labels"))


# --- windows, ids and top-k -----------------------------------------------------------------------------------------


@query("w01_top_k", with_views("SELECT doc_id, rank, label, score FROM top5", "top5"))
def w01(s, d):
    return topk.top_k(v.scores(s, d).select("doc_id", "label", "score"), 5).select("doc_id", "rank", "label", "score")


@query("w02_first_seen_ids", with_views("SELECT label, row_number() OVER (ORDER BY f, label) - 1 AS label_id FROM (SELECT label, min(doc_id) AS f FROM order_labels GROUP BY label)", "order_labels"))
def w02(s, d):
    return L.index_labels(v.order_labels(s, d), "first_seen")


@query("w03_cumulative_hits", with_views("SELECT doc_id, rank, hit, sum(hit) OVER (PARTITION BY doc_id ORDER BY rank)::BIGINT AS hits_so_far FROM hits", "hits"))
def w03(s, d):
    return metrics.cumulative(v.hits(s, d)).select("doc_id", "rank", "hit", "hits_so_far")


@query("w04_frequency_ids", with_views("""WITH voc AS (SELECT token, count(*) AS n, 'word' AS type FROM tokens GROUP BY token UNION ALL SELECT label, count(*), 'label' FROM text_labels GROUP BY label)
    SELECT token, type, n, row_number() OVER (ORDER BY type = 'label', n DESC, token) - 1 AS token_id FROM voc""", "tokens", "text_labels"))
def w04(s, d):
    words = v.tokens(s, d).groupBy("token").agg(F.count("*").alias("n")).withColumn("type", F.lit("word"))
    labels = v.text_labels(s, d).groupBy(F.col("label").alias("token")).agg(F.count("*").alias("n")).withColumn("type", F.lit("label"))
    return L.vocabulary_index(words.unionByName(labels))


@query("w05_sorted_ids", with_views("SELECT label, row_number() OVER (ORDER BY label) - 1 AS label_id FROM (SELECT DISTINCT label FROM order_labels)", "order_labels"))
def w05(s, d):
    return L.index_labels(v.order_labels(s, d), "sorted")


COSTS = "costs AS (SELECT year(o_orderdate) * 12 + month(o_orderdate) AS round, round(avg(o_totalprice), 4) AS cost FROM orders GROUP BY 1)"


def _costs(s, d):
    return v.table(s, d, "orders").groupBy((F.year("o_orderdate") * 12 + F.month("o_orderdate")).alias("round")).agg(F.round(F.avg("o_totalprice"), 4).alias("cost"))


@query("w11_moving_stop", f"WITH {COSTS} SELECT round, cost, coalesce(row_number() OVER (ORDER BY round) > 3 AND cost > avg(cost) OVER (ORDER BY round ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), false) AS stop FROM costs")
def w11(s, d):
    return metrics.stop_round(_costs(s, d), 3)


@query("w12_best_round", f"""WITH {COSTS}, g AS (SELECT round, cost, coalesce(cost > max(cost) OVER (ORDER BY round ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS gain, max(cost) OVER (ORDER BY round) AS best FROM costs),
    l AS (SELECT *, max(CASE WHEN gain THEN round END) OVER (ORDER BY round) AS last FROM g) SELECT round, cost AS value, best, round - last AS since, round - last >= 5 AS stop FROM l""")
def w12(s, d):
    return metrics.best_round(_costs(s, d).withColumnRenamed("cost", "value"), 5)


@query("l01_merge_batches", with_views("SELECT doc_id, rank, label, score FROM top5", "top5"))
def l01(s, d):
    # scores depend on a document's key alone: batches are merged once a key
    return _of_keys(s, d, topk.merge_numbered_batches(v.batched_key_scores(s, d), 5)).select("doc_id", "rank", "label", "score")


@query("l02_truncated_predictions", with_views("SELECT doc_id, string_agg(label, ',' ORDER BY rank) AS labels FROM top5 WHERE rank <= 3 GROUP BY doc_id", "top5"))
def l02(s, d):
    return topk.packed(v.top5(s, d), 3).select("doc_id", F.array_join("predict.label", ",").alias("labels"))


@query("l03_most_frequent", with_views("SELECT key, label, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY score DESC, label) AS rank FROM (SELECT key, label, round(n / sum(n) OVER (PARTITION BY key), 9) AS score FROM key_counts)) WHERE rank <= 4", "key_counts"))
def l03(s, d):
    return matcher.most_frequent(v.key_counts(s, d), 4).select("key", "label", "score", "rank")


@query("l07_head", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 100")
def l07(s, d):
    return v.table(s, d, "orders").select("o_orderkey", "o_totalprice").orderBy("o_orderkey").limit(100)


@query("l08_head_words", with_views("SELECT token, n FROM (SELECT token, count(*) AS n FROM tokens GROUP BY token) ORDER BY n DESC, token LIMIT 200", "tokens"))
def l08(s, d):
    return v.tokens(s, d).groupBy("token").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "token").limit(200)


GROUPS = """WITH gs AS (SELECT key, g, sum(n) / sum(sum(n)) OVER (PARTITION BY key) AS gscore FROM (SELECT *, CAST(substr(label, 7) AS INTEGER) % 5 AS g FROM key_counts) GROUP BY key, g),
    bg AS (SELECT key, g, round(gscore, 9) AS gscore FROM gs QUALIFY row_number() OVER (PARTITION BY key ORDER BY round(gscore, 9) DESC, g) <= 2),
    ls AS (SELECT key, CAST(substr(label, 7) AS INTEGER) % 5 AS g, label, round(n / sum(n) OVER (PARTITION BY key, CAST(substr(label, 7) AS INTEGER) % 5), 9) AS lscore FROM key_counts)"""


def _groups(s, d):
    m = v.key_counts(s, d).withColumn("group", F.expr("cast(substr(label, 7) as int) % 5"))
    from pyspark.sql import Window

    by_group = m.groupBy("key", "group").agg(F.sum("n").alias("n"))
    gs = by_group.select("key", "group", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("key")), 9).alias("group_score"))
    ls = m.select("key", "group", "label", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("key", "group")), 9).alias("score"))
    return gs.withColumnRenamed("key", "doc_id"), ls.withColumnRenamed("key", "doc_id")


@query("l09_group_candidates", with_views(GROUPS + "SELECT key, label, round(gscore * lscore, 9) AS score FROM bg JOIN ls USING (key, g) QUALIFY row_number() OVER (PARTITION BY key ORDER BY round(gscore * lscore, 9) DESC, label) <= 6", "key_counts"))
def l09(s, d):
    gs, ls = _groups(s, d)
    return topk.group_candidates(gs, ls, 2, 6).select(F.col("doc_id").alias("key"), "label", "score")


@query("t23_candidate_scores", with_views(GROUPS + "SELECT key, label, round(gscore * lscore, 9) AS score FROM bg JOIN ls USING (key, g)", "key_counts"))
def t23(s, d):
    gs, ls = _groups(s, d)
    return topk.group_candidates(gs, ls, 2, 1_000).select(F.col("doc_id").alias("key"), "label", "score")


# --- sets -----------------------------------------------------------------------------------------------------------


@query("u01_tagged_union", with_views("SELECT doc_id, CASE WHEN is_test THEN 'test' ELSE 'train' END AS part FROM test_docs", "test_docs"))
def u01(s, d):
    from bramble.functions.hashing import hash32

    docs = v.order_labels(s, d).select("doc_id").distinct().withColumn("t", hash32(42, "doc_id") % 4 == 0)
    return docs.where(~F.col("t")).select("doc_id", F.lit("train").alias("part")).unionByName(docs.where("t").select("doc_id", F.lit("test").alias("part")))


@query("u02_candidate_union", with_views("SELECT DISTINCT key, label FROM (SELECT key, label FROM key_counts QUALIFY row_number() OVER (PARTITION BY key ORDER BY n DESC, label) <= 5 UNION ALL SELECT key, label FROM key_counts QUALIFY row_number() OVER (PARTITION BY key ORDER BY n, label) <= 5)", "key_counts"))
def u02(s, d):
    m = v.key_counts(s, d)
    best = topk.top_k(m, 5, by="key", score="n").select("key", "label")
    least = topk.top_k(m.withColumn("m", -F.col("n")), 5, by="key", score="m").select("key", "label")
    return best.union(least).distinct()


@query("u03_intersection_size", with_views("SELECT doc_id, sum(hit)::INTEGER AS shared FROM hits GROUP BY doc_id", "hits"))
def u03(s, d):
    p = v.top5(s, d).groupBy("doc_id").agg(F.collect_set("label").alias("p"))
    t = v.order_labels(s, d).groupBy("doc_id").agg(F.collect_set("label").alias("t"))
    return p.join(t, "doc_id").select("doc_id", F.size(F.array_intersect("p", "t")).alias("shared"))


@query("u04_missing_labels", with_views("SELECT label FROM (SELECT DISTINCT p_brand AS label FROM part) WHERE label NOT IN (SELECT label FROM label_counts WHERE n >= (SELECT avg(n) FROM label_counts))", "label_counts"))
def u04(s, d):
    n = L.counts(v.order_labels(s, d))
    mean = n.agg(F.avg("n").alias("m"))
    return L.unused(v.table(s, d, "part").select(F.col("p_brand").alias("label")), n.crossJoin(mean).where("n >= m").select("label"))


@query("u05_inverse_triples", with_views("SELECT '__label__' || h AS target, '0_' || r || ' ' || t AS line FROM triples UNION SELECT '__label__' || t, h || ' 1_' || r FROM triples", "triples"))
def u05(s, d):
    t = v.triples(s, d)
    there = t.select(F.concat(F.lit("__label__"), "h").alias("target"), F.concat(F.lit("0_"), "r", F.lit(" "), "t").alias("line"))
    back = t.select(F.concat(F.lit("__label__"), "t").alias("target"), F.concat("h", F.lit(" 1_"), "r").alias("line"))
    return there.union(back).distinct()


@query("u06_distinct_words", with_views("SELECT DISTINCT token FROM tokens", "tokens"))
def u06(s, d):
    return v.tokens(s, d).select("token").distinct()


# --- filters and joins ----------------------------------------------------------------------------------------------


@query("p01_unused_labels", with_views("SELECT label FROM (SELECT DISTINCT label FROM text_labels) WHERE label NOT IN (SELECT t.label FROM text_labels t JOIN labels l ON l.doc_id = t.doc_id WHERE toxic = 1)", "text_labels"))
def p01(s, d):
    rows = v.text_labels(s, d)
    toxic = v.table(s, d, "labels").where("toxic = 1").select("doc_id")
    return L.unused(rows, rows.join(toxic, "doc_id", "left_semi"))


@query("p02_frequent_labels", with_views("SELECT doc_id, label FROM order_labels WHERE label IN (SELECT label FROM label_counts WHERE n >= (SELECT median(n) FROM label_counts))", "label_counts"))
def p02(s, d):
    rows = v.order_labels(s, d)
    middle = L.counts(rows).agg(F.median("n").alias("m")).first()["m"]
    return L.frequent(rows, middle or 0)


@query("p03_vocabulary_thresholds", with_views("""SELECT token, n, type FROM (SELECT token, count(*) AS n, 'word' AS type FROM tokens GROUP BY token UNION ALL SELECT label, count(*), 'label' FROM text_labels GROUP BY label)
    WHERE (type = 'word' AND n >= 5) OR (type = 'label' AND n >= 20)""", "tokens", "text_labels"))
def p03(s, d):
    words = v.tokens(s, d).groupBy("token").agg(F.count("*").alias("n")).withColumn("type", F.lit("word"))
    labels = v.text_labels(s, d).groupBy(F.col("label").alias("token")).agg(F.count("*").alias("n")).withColumn("type", F.lit("label"))
    return L.thresholds(words.unionByName(labels), 5, 20)


@query("p04_distinct_tags", "SELECT l_orderkey AS doc_id, count(DISTINCT p_brand)::INTEGER AS tags FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1")
def p04(s, d):
    tags = v.order_lines(s, d).groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.collect_list("p_brand").alias("tags"))
    return tags.select("doc_id", F.size(F.array_distinct("tags")).alias("tags"))


@query("p05_without_invalid", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def p05(s, d):
    return v.table(s, d, "orders").join(v.table(s, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").select("o_orderkey")


@query("p06_train_rows", with_views("SELECT doc_id, label FROM order_labels WHERE doc_id IN (SELECT doc_id FROM test_docs WHERE NOT is_test)", "test_docs"))
def p06(s, d):
    from bramble.functions.hashing import hash32

    rows = v.order_labels(s, d)
    train = rows.select("doc_id").distinct().where(hash32(42, "doc_id") % 4 != 0)
    return rows.join(train, "doc_id", "left_semi")


@query("p16_heavy_features", with_views("SELECT doc_id, feature, value FROM order_features WHERE value >= 40", "order_features"))
def p16(s, d):
    return X.heavy(v.order_features(s, d), 40)


@query("p17_score_threshold", with_views("SELECT doc_id, label, score FROM scores WHERE score >= 0.042", "scores"))
def p17(s, d):
    return topk.over(v.scores(s, d), 0.042).select("doc_id", "label", "score")


@query("p18_sparse_weights", with_views("SELECT label, feature, weight FROM (SELECT label, feature, round(avg(value) / 50 - 0.5, 6) AS weight FROM order_labels JOIN order_features USING (doc_id) GROUP BY ALL) WHERE abs(weight) > 0.01", "order_labels", "order_features"))
def p18(s, d):
    w = v.order_labels(s, d).join(v.order_features(s, d), "doc_id").groupBy("label", "feature").agg(F.round(F.avg("value") / 50 - 0.5, 6).alias("weight"))
    return X.sparsify(w)


@query("p24_seeded_order", "SELECT o_orderkey AS doc_id, row_number() OVER (ORDER BY ('0x' || substr(md5('42|' || o_orderkey), 1, 8))::BIGINT, o_orderkey) - 1 AS place FROM orders")
def p24(s, d):
    from bramble.functions.hashing import hash32

    docs = v.table(s, d, "orders").select(F.col("o_orderkey").alias("doc_id"), hash32(42, "o_orderkey").alias("h"))
    return L._numbered(docs, ["h", "doc_id"], "place").select("doc_id", "place")


@query("p25_one_label", with_views("SELECT doc_id, label FROM order_labels QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY ('0x' || substr(md5('42|' || doc_id || '|' || label), 1, 8))::BIGINT, label) = 1", "order_labels"))
def p25(s, d):
    return L.chosen_label(v.order_labels(s, d))


@query("j01_first_match", "SELECT o_orderkey AS doc_id, p_brand AS label FROM orders JOIN (SELECT l_orderkey, min_by(l_partkey, l_linenumber * 1000000 + l_partkey) AS pk FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey JOIN part ON p_partkey = pk")
def j01(s, d):
    first = v.table(s, d, "lineitem").groupBy("l_orderkey").agg(F.min_by("l_partkey", F.col("l_linenumber").cast("long") * 1_000_000 + F.col("l_partkey")).alias("pk"))
    o = v.table(s, d, "orders")
    return o.join(first, F.col("l_orderkey") == F.col("o_orderkey")).join(v.table(s, d, "part"), F.col("p_partkey") == F.col("pk")).select(F.col("o_orderkey").alias("doc_id"), F.col("p_brand").alias("label"))


@query("j02_semi_and_anti", "SELECT c_custkey, c_custkey IN (SELECT o_custkey FROM orders) AS has_orders FROM customer")
def j02(s, d):
    c, o = v.table(s, d, "customer").select("c_custkey"), v.table(s, d, "orders")
    on = F.col("c_custkey") == F.col("o_custkey")
    return c.join(o, on, "left_semi").withColumn("has_orders", F.lit(True)).unionByName(c.join(o, on, "left_anti").withColumn("has_orders", F.lit(False)))


@query("j04_exact_key_join", with_views("SELECT doc_id, label, n FROM order_keys LEFT JOIN (SELECT * FROM key_counts WHERE n >= 50) USING (key)", "key_counts"))
def j04(s, d):
    return v.order_keys(s, d).join(v.key_counts(s, d).where("n >= 50"), "key", "left").select("doc_id", "label", "n")


@query("j06_prediction_hits", with_views("SELECT doc_id, rank, label, score, hit, n_truth::INTEGER AS n_truth FROM hits", "hits"))
def j06(s, d):
    return v.hits(s, d)


@query("j07_vocabulary_join", with_views("WITH voc AS (SELECT token, row_number() OVER (ORDER BY count(*) DESC, token) - 1 AS token_id FROM tokens GROUP BY token HAVING count(*) >= 10) SELECT doc_id, pos, token_id FROM tokens JOIN voc USING (token)", "tokens"))
def j07(s, d):
    t = v.tokens(s, d)
    n = t.groupBy("token").agg(F.count("*").alias("n")).where("n >= 10").withColumn("type", F.lit("word"))
    return t.join(L.vocabulary_index(n).select("token", "token_id"), "token").select("doc_id", "pos", "token_id")


@query("j08_feature_remap", with_views("WITH ids AS (SELECT feature, row_number() OVER (ORDER BY feature) AS id FROM (SELECT DISTINCT feature FROM order_features JOIN test_docs USING (doc_id) WHERE NOT is_test)) SELECT doc_id, id, value FROM order_features JOIN test_docs USING (doc_id) JOIN ids USING (feature) WHERE is_test", "order_features", "test_docs", once=True))
def j08(s, d):
    from bramble.functions.hashing import hash32

    f = v.order_features(s, d).withColumn("t", hash32(42, "doc_id") % 4 == 0)
    ids = L.index_labels(f.where(~F.col("t")).select(F.col("feature").alias("label")), "sorted", start=1)
    return f.where("t").join(ids, f["feature"] == ids["label"]).select("doc_id", F.col("label_id").alias("id"), "value")


@query("j09_label_remap", with_views("""WITH o AS (SELECT label, min(is_test::INTEGER * 1000000000000 + doc_id) AS f FROM order_labels JOIN test_docs USING (doc_id) GROUP BY label), ids AS (SELECT label, row_number() OVER (ORDER BY f, label) AS id FROM o)
    SELECT doc_id, id FROM order_labels JOIN ids USING (label)""", "order_labels", "test_docs"))
def j09(s, d):
    from bramble.functions.hashing import hash32

    rows = v.order_labels(s, d)
    placed = rows.withColumn("at", (hash32(42, "doc_id") % 4 == 0).cast("long") * 1_000_000_000_000 + F.col("doc_id"))
    ids = L.index_labels(placed, "first_seen", "at", 1)
    return rows.join(ids, "label").select("doc_id", F.col("label_id").alias("id"))


WEIGHTS = "w AS (SELECT label, feature, round(avg(value) / 50 - 0.5, 6) AS weight FROM order_labels JOIN order_features USING (doc_id) GROUP BY ALL)"


def whole_scores(features, w, k=None):
    """Scores summed in whole millionths, so that no engine's order of adding shows."""
    return X.block_dot(features.withColumn("value", F.col("value").cast("long")), w.withColumn("weight", F.round(F.col("weight") * 1_000_000).cast("long")), k)


def feature_weights(s, d, features=None):
    return v.order_labels(s, d).join(features if features is not None else v.order_features(s, d), "doc_id").groupBy("label", "feature").agg(F.round(F.avg("value") / 50 - 0.5, 6).alias("weight"))


@query("j10_sparse_dot", with_views(f"WITH {WEIGHTS} SELECT doc_id, label, sum(CAST(value AS BIGINT) * CAST(round(weight * 1000000) AS BIGINT))::BIGINT AS score FROM order_features JOIN w USING (feature) GROUP BY doc_id, label", "order_labels", "order_features"))
def j10(s, d):
    f = stage(v.order_features(s, d), "features")
    return whole_scores(f, stage(feature_weights(s, d, f), "weights"))


@query("t12_score_all_labels", with_views(f"WITH {WEIGHTS}, sc AS (SELECT doc_id, label, sum(CAST(value AS BIGINT) * CAST(round(weight * 1000000) AS BIGINT))::BIGINT AS score FROM order_features JOIN w USING (feature) GROUP BY doc_id, label) SELECT doc_id, label, score FROM sc QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, label) <= 5", "order_labels", "order_features"))
def t12(s, d):
    f = stage(v.order_features(s, d), "features")
    return topk.top_k(whole_scores(f, stage(feature_weights(s, d, f), "weights"), 5), 5).select("doc_id", "label", "score")


@query("j14_expand_groups", with_views("SELECT DISTINCT o.doc_id, m.label FROM order_labels o JOIN (SELECT DISTINCT label, CAST(substr(label, 7) AS INTEGER) % 5 AS g FROM order_labels) m ON CAST(substr(o.label, 7) AS INTEGER) % 5 = m.g", "order_labels"))
def j14(s, d):
    rows = v.order_labels(s, d).withColumn("group", F.expr("cast(substr(label, 7) as int) % 5"))
    return L.expand_groups(rows.select("doc_id", "group").distinct(), rows.select("group", "label").distinct())


@query("j16_leaf_payload", with_views("SELECT doc_id, label, round(n / size, 6) AS p FROM order_keys JOIN key_counts USING (key) JOIN (SELECT key, count(*) AS size FROM order_keys GROUP BY key) USING (key)", "key_counts"))
def j16(s, d):
    sizes = v.order_keys(s, d).groupBy("key").agg(F.count("*").alias("size"))
    payload = v.key_counts(s, d).join(sizes, "key").select("key", "label", F.round(F.col("n") / F.col("size"), 6).alias("p"))
    return v.order_keys(s, d).join(payload, "key").select("doc_id", "label", "p")


NEAR = """WITH q AS (SELECT * FROM embeddings WHERE vec_id % 50 = 0), p AS (SELECT q.vec_id AS query, e.vec_id AS id, round(list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6) AS similarity FROM q JOIN embeddings e ON q.vec_id <> e.vec_id)
    SELECT query, row_number() OVER (PARTITION BY query ORDER BY similarity DESC, id) AS rank, id, similarity FROM p QUALIFY rank <= 5"""


@query("j12_nearest_vectors", NEAR)
def j12(s, d):
    e = v.vectors(s, d)
    q = e.where("id % 50 = 0").select(F.col("id").alias("query"), "vector")
    return V.nearest(q, e, 5, banned=q.select("query", F.col("query").alias("id")))


@query("l06_nearest_not_banned", NEAR.replace("q.vec_id <> e.vec_id", "q.vec_id <> e.vec_id AND q.label <> e.label"))
def l06(s, d):
    e = v.vectors(s, d)
    q = e.where("id % 50 = 0").select(F.col("id").alias("query"), "vector", "label")
    return V.nearest(q, e, 5, apart="label")


@query("j15_pair_similarity", "SELECT a.vec_id AS w1, a.vec_id + 490 AS w2, a.label::DOUBLE AS gold, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS similarity FROM embeddings a LEFT JOIN embeddings b ON b.vec_id = a.vec_id + 490")
def j15(s, d):
    e = v.vectors(s, d)
    pairs = e.select(F.col("id").alias("w1"), (F.col("id") + 490).alias("w2"), F.col("label").cast("double").alias("gold"))
    return V.pair_similarity(pairs, e)


@query("j17_pretrained_merge", "SELECT token, (SELECT count(*) FROM embeddings e WHERE e.vec_id = token) > 0 AS given, 64 AS dim FROM (SELECT DISTINCT o_custkey AS token FROM orders)")
def j17(s, d):
    voc = v.table(s, d, "orders").select(F.col("o_custkey").alias("token")).distinct()
    e = v.vectors(s, d).select(F.col("id").alias("word"), "vector")
    merged = V.with_pretrained(voc, e, 64)
    return merged.join(e.select(F.col("word").alias("token"), F.lit(True).alias("g")), "token", "left").select("token", F.coalesce("g", F.lit(False)).alias("given"), F.size("vector").alias("dim"))


@query("l04_largest_vectors", "SELECT vec_id AS id, round(sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))), 6) AS norm FROM embeddings ORDER BY vec_id = 7 DESC, norm DESC, id LIMIT 50")
def l04(s, d):
    return V.largest(v.vectors(s, d), 50, first=7).select("id", "norm")


# --- ensembles ------------------------------------------------------------------------------------------------------


POP = "pop AS (SELECT doc_id, label, round(n / (SELECT sum(n) FROM label_counts), 9) AS score FROM order_keys, label_counts)"


@query("t20_mean_ensemble", with_views(f"WITH {POP}, m AS (SELECT doc_id, label, round(sum(score) / 2, 9) AS score FROM (SELECT doc_id, label, score FROM top5 UNION ALL SELECT doc_id, label, score FROM pop) GROUP BY ALL) SELECT doc_id, label, score FROM m QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, label) <= 5", "top5", "label_counts"))
def t20(s, d):
    best = topk.top_k(_scored_keys(s, d), 5).drop("rank")
    return _of_keys(s, d, topk.shared_ensemble(best, _popular(s, d), 5, members=2)).select("doc_id", "label", "score")


@query("t22_sum_ensemble", with_views(f"WITH {POP}, m AS (SELECT doc_id, label, round(sum(1 / (1 + exp(-score))), 9) AS score FROM (SELECT doc_id, label, score FROM scores UNION ALL SELECT doc_id, label, score FROM pop) GROUP BY ALL) SELECT doc_id, label, round(score, 6) AS score FROM m QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, label) <= 5", "scores", "label_counts"))
def t22(s, d):
    return _of_keys(s, d, topk.shared_ensemble(_scored_keys(s, d), _popular(s, d), 5, logits=True)).select("doc_id", "label", F.round("score", 6).alias("score"))


@query("t28_asked_probabilities", with_views("SELECT s.doc_id, s.label, s.score FROM scores s JOIN order_labels o ON o.doc_id = s.doc_id AND o.label = s.label", "scores", "order_labels"))
def t28(s, d):
    return topk.of_labels(v.scores(s, d), v.order_labels(s, d)).select("doc_id", "label", "score")


@query("t30_popularity", with_views(f"WITH {POP} SELECT doc_id, label, score FROM pop QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, label) <= 5", "order_keys", "label_counts"))
def t30(s, d):
    counts = L.counts(v.order_labels(s, d))
    total = counts.agg(F.sum("n").alias("total"))
    head = counts.crossJoin(total).select("label", F.round(F.col("n") / F.col("total"), 9).alias("score")).orderBy(F.desc("score"), "label").limit(5)
    return v.order_keys(s, d).select("doc_id").crossJoin(F.broadcast(head)).select("doc_id", "label", "score")


@query("t31_fixed_candidates", with_views("SELECT doc_id, least(count(*), 12) AS own, least((SELECT count(*) FROM label_counts), 12) AS candidates, 0::BIGINT AS foreign_own FROM order_labels GROUP BY doc_id", "label_counts"))
def t31(s, d):
    rows = v.order_labels(s, d)
    got = L.fixed_candidates(rows, rows, 12)
    # what is said to be a document's own, must be; padding must not be, and no label may come twice
    checked = got.join(rows.groupBy("doc_id").agg(F.collect_set("label").alias("true")), "doc_id", "left")
    wrong = F.col("own") != F.coalesce(F.array_contains("true", F.col("label")), F.lit(False))
    return checked.groupBy("doc_id").agg(F.sum(F.col("own").cast("long")).alias("own"), F.count_distinct("label").alias("candidates"), F.sum(wrong.cast("long")).alias("foreign_own"))
