"""Helpers that the training-data operators share: shared-folder tables, hashing, connected components."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a split of labelled data: crc32(doc_id as text) mod 3 = 1 is held out.
HELD_OUT_MOD, HELD_OUT_REST = 3, 1


#: What a Python worker keeps between tasks, of one operator at a time.
_kept: dict[str, dict] = {}


def worker_cache(owner: str) -> dict:
    """The worker's store of an operator. Workers outlive tasks and operators: asking for another one drops the last."""
    if owner not in _kept:
        _kept.clear()
        _kept[owner] = {}
    return _kept[owner]


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or, where unset, a fresh local one (tests)."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.conf.get("bramble.shared.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        os.makedirs("/tmp/checkpoints", exist_ok=True)
        root = "file://" + tempfile.mkdtemp(prefix="bramble-", dir="/tmp/checkpoints")
        spark.conf.set("bramble.shared.dir", root)
    return root.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/bramble-{uuid.uuid4().hex[:12]}-{label}"


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: cuts lineage and survives lost executors."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_staged(df: DataFrame) -> None:
    """Delete the files behind a staged table that nothing reads any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop shuffle files and broadcasts that no plan refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def held_out(id_col: str) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % HELD_OUT_MOD == HELD_OUT_REST, F.lit(False))


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def spanning(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fewer edges with the same connected components: label propagation over the batch's distinct ends."""
    nodes, inverse = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y, label = inverse[: len(a)], inverse[len(a) :], np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        new = new[new]
        if (new == label).all():
            return nodes, nodes[label]
        label = new


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, component): component is the smallest node reachable over the undirected edges.

    Alternating large-star and small-star rounds; each round is written to the shared folder, so lineage stays
    short and a lost executor costs one round at most. Only a count of changed rows reaches the driver.
    Self-loops keep isolated nodes; null ends are dropped. No edges give an empty table.
    """
    pairs = (
        edges.select(F.col(a).alias("u"), F.col(b).alias("v"))
        .where("u is not null and v is not null")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct()
    )
    cur = stage(pairs, "cc")
    for _ in range(max_rounds):
        both = cur.where("u <> v")
        both = both.unionByName(both.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # large-star: every larger neighbour of u points at the smallest of u and its neighbours
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        # small-star: u and its smaller neighbours point at the smallest of them
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low2, "u")
        small = (
            joined.select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(joined.select("u", F.col("m").alias("v")))
            .where("u <> v")
            .distinct()
        )
        nxt = stage(small, "cc")
        # a forest of stars is reached when no node is both a leaf and a root, and each leaf has one root
        state = nxt.groupBy("u").agg(F.count("*").alias("n")).agg(F.count("*").alias("leaves"), F.max("n").alias("most")).first()
        tangled = nxt.select("u").join(nxt.select(F.col("v").alias("u")), "u", "left_semi").limit(1).count() if state["leaves"] else 0
        if not tangled and (state["most"] or 1) == 1:
            break
        cur = nxt
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    nodes = pairs.select(F.col("u").alias("node")).unionByName(pairs.select(F.col("v").alias("node"))).distinct()
    return nodes.join(nxt.select(F.col("u").alias("node"), F.col("v").alias("root")), "node", "left").select(
        "node", F.coalesce("root", "node").alias("component")
    )
