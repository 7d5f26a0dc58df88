"""Scoring of documents as they arrive, and running metrics over what was scored."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bramble.operators import metrics, topk


def score_stream(arriving: DataFrame, model: DataFrame, truth: DataFrame, out: str, checkpoint: str, k: int = 5) -> None:
    """Score a stream(doc_id, key) with model(key, label, score) and append its hits to a table; returns when the stream is
    drained. The batch scorer runs on each micro-batch, since ranks over an unbounded stream do not exist."""

    def one(batch: DataFrame, epoch: int) -> None:
        best = topk.top_k(batch.join(model, "key").select("doc_id", "label", "score"), k)
        # a batch that is replayed after a failure overwrites its own folder
        metrics.hits(best, truth).write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    arriving.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def running_metrics(spark: SparkSession, hits_path: str, checkpoint: str, ks: list[int], name: str = "bramble_running") -> DataFrame:
    """(k, hits, predicted) over a stream of hits, as a complete-mode aggregate that is updated with every batch."""
    schema = spark.read.parquet(hits_path).schema
    rows = spark.readStream.schema(schema).parquet(hits_path)
    at = rows.select(F.explode(F.array(*[F.when(F.col("rank") <= k, F.lit(k)) for k in ks])).alias("k"), "hit").where("k is not null")
    sums = at.groupBy("k").agg(F.sum("hit").alias("hits"), F.count("*").alias("predicted"))
    query = sums.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.table(name)
