"""The flagship plan: scored labels against truth, as precision, recall, F1 and nDCG at several k."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bramble.operators import metrics
from bramble.plans import views
from bramble.plans.registry import query
from bramble.plans.views import with_views

SQL = with_views("""WITH m AS (SELECT doc_id, k, any_value(n_truth) AS t, sum(CASE WHEN rank <= k THEN hit ELSE 0 END) AS h, sum(CASE WHEN rank <= k THEN hit / log2(rank + 1) ELSE 0 END) AS g,
    list_sum([1 / log2(x + 1) FOR x IN range(1, least(k, any_value(n_truth)) + 1)]) AS i FROM hits, (SELECT unnest([1, 3, 5]) AS k) GROUP BY doc_id, k)
    SELECT k, round(avg(h / k), 6) AS p, round(avg(h / t), 6) AS r, round(2 * avg(h / k) * avg(h / t) / (avg(h / k) + avg(h / t)), 6) AS f1, round(avg(g / i), 6) AS ndcg FROM m GROUP BY k""", "hits")


@query("flagship_ranking_metrics", SQL)
def ranking_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders are documents, the brands of their parts the labels; the scorer is the frequency of a brand given the priority."""
    hits = views.hits(spark, sf_dir)
    both = metrics.macro_at_k(hits, [1, 3, 5]).join(metrics.ndcg_at_k(hits, [1, 3, 5]), "k")
    return both.select("k", *[F.round(c, 6).alias(c) for c in ("p", "r", "f1", "ndcg")])
